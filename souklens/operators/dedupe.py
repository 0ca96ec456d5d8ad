"""Repeated URLs: within a run, and seen in earlier runs."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CURRENT_RUN, PREVIOUS_RUN, flagged


def seen_urls(df: DataFrame) -> DataFrame:
    return df.where("url is not null").select("url").distinct()


#: Buckets of a store of seen urls.
BUCKETS = 64


def _store(spark: SparkSession, path: str, buckets: int) -> str:
    """The name of the table that this session has for the store; the files are the store, whatever session wrote them."""
    name = f"seen_{hashlib.sha256(f'{path} {buckets}'.encode()).hexdigest()[:24]}"
    spark.sql(f"create table if not exists {name} (url string) using parquet clustered by (url) sorted by (url) into {int(buckets)} buckets location '{path}/{int(buckets)}'")
    spark.catalog.refreshTable(name)
    return name


def stored_seen(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The urls of the store at path, which add_seen() fills; empty before that. A join with it by url shuffles the other side alone, as the store lies in buckets by url."""
    return spark.table(_store(spark, path, buckets))


def add_seen(urls: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Adds urls (url) that the store at path does not have yet; each bucket gets one file more. Nulls are left out."""
    name = _store(urls.sparkSession, path, buckets)
    new = seen_urls(urls).join(urls.sparkSession.table(name), "url", "left_anti")
    new.repartition(buckets, "url").write.mode("append").format("parquet").bucketBy(buckets, "url").sortBy("url").saveAsTable(name)


def flag_previous_runs(df: DataFrame, seen: DataFrame) -> DataFrame:
    """Flags unflagged rows whose url is in seen (url)."""
    known = df.join(seen_urls(seen).withColumnRenamed("url", "__url"), F.col("url") == F.col("__url"), "left")
    return flagged(known, F.col("__url").isNotNull(), PREVIOUS_RUN).drop("__url")


def flag_current_run(df: DataFrame, run: str = "run_id", order: tuple[str, ...] = ("search_ord", "position")) -> DataFrame:
    """Flags all unflagged rows of a url in a run but the first in order; flagged rows do not count.

    The first place of each url is an aggregate with partial sums, joined back, so that one url with very many rows is
    neither sorted in one task nor kept in one.
    """
    first = df.where(~F.col("filtered")).groupBy(F.col(run).alias("__run"), F.col("url").alias("__url")).agg(F.min(F.struct(*order)).alias("__first"))
    joined = df.join(first, (F.col(run) == F.col("__run")) & (F.col("url") == F.col("__url")), "left")
    return flagged(joined, F.struct(*order) > F.col("__first"), CURRENT_RUN).drop("__run", "__url", "__first")


def new_seen_urls(df: DataFrame, seen: DataFrame) -> DataFrame:
    """Urls of unflagged rows that seen does not have yet; to be appended to it."""
    return seen_urls(df.where(~F.col("filtered"))).join(seen_urls(seen), "url", "left_anti")
