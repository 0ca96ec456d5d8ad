"""Dimension tables: languages, locations, hosts, prompts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stripped
from ..schema import Prompt


def read_languages(spark: SparkSession, path: str) -> DataFrame:
    """(name, code) of a JSON array of objects with these keys; of several rows with one name the last counts."""
    rows = spark.read.schema("payload string").text(path, wholetext=True).select(F.posexplode(F.from_json("payload", "array<struct<name:string,code:string>>")).alias("ord", "x"))
    return last_wins(rows.select("ord", "x.*"))


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    """(name, code) of a JSON array of objects with name and country_code; codes in lower case, the last row of a name counts."""
    rows = spark.read.schema("payload string").text(path, wholetext=True).select(F.posexplode(F.from_json("payload", "array<struct<name:string,country_code:string>>")).alias("ord", "x"))
    return last_wins(rows.select("ord", "x.name", F.lower("x.country_code").alias("code")))


def last_wins(rows: DataFrame) -> DataFrame:
    """(ord, name, code) to (name, code)."""
    return rows.where("name is not null").groupBy("name").agg(F.max_by("code", "ord").alias("code"))


def with_code(df: DataFrame, dim: DataFrame, name: str, code: str | None, into: str, what: str) -> DataFrame:
    """df with the lower-cased code given, or else looked up by exact name; an unknown name is an error that the code column itself raises."""
    given = F.nullif(F.col(code), F.lit("")) if code else F.lit(None).cast("string")
    found = df.join(dim.select(F.col("name").alias("__name"), F.col("code").alias("__code")), F.col(name) == F.col("__name"), "left")
    error = F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(F.col(name), F.lit("null"))))
    return found.withColumn("__new", F.lower(F.coalesce(given, F.col("__code"), error.cast("string")))).drop("__name", "__code", *([into] if into in df.columns else [])).withColumnRenamed("__new", into)


def split_domains(domains: Column) -> Column:
    """Comma-separated domains as an array, each trimmed; empty ones stay."""
    return F.transform(F.split(domains, ","), stripped)


def hosts(spark: SparkSession, items: Iterable[tuple[str, str | list[str]]]) -> DataFrame:
    """(ord, name, domains) of hosts given as (name, domains); domains as a list or separated by commas."""
    rows = [(i, name, None if isinstance(d, list) else d, d if isinstance(d, list) else None) for i, (name, d) in enumerate(items)]
    df = spark.createDataFrame(rows, "ord int, name string, text string, list array<string>")
    return df.select("ord", "name", F.coalesce("list", split_domains(F.col("text"))).alias("domains"))


def prompts(spark: SparkSession, items: Iterable[Prompt]) -> DataFrame:
    rows = [(i, p.name, p.context, p.system_prompt, list(p.allowed_classes)) for i, p in enumerate(items)]
    return spark.createDataFrame(rows, "ord int, name string, context string, system_prompt string, allowed_classes array<int>")


def checked_prompts(df: DataFrame) -> DataFrame:
    """df, whose allowed_classes raise an error where one is negative."""
    error = F.raise_error(F.concat(F.lit("negative class in prompt "), F.col("name")))
    return df.withColumn("allowed_classes", F.when(F.forall("allowed_classes", lambda c: c >= 0), F.col("allowed_classes")).otherwise(error.cast("array<int>")))
