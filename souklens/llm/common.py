"""What several operators of this subpackage share: words, free column names, intermediate tables and connected components."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import Scratch

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: Rows of two long columns that are sent to all executors instead of being shuffled: 16 MB.
MAX_BROADCAST = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blank_separated(text: Column | str) -> Column:
    """The words of a text as an array; empty for null, empty and blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def free_name(taken: Iterable[str], wish: str) -> str:
    """The wish, with as many underscores behind it as make it unlike every taken name, case aside."""
    small = {x.lower() for x in taken}
    while wish.lower() in small:
        wish += "_"
    return wish


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, which has `rows` rows of a few numbers each, with a hint to broadcast it if that is within the bound."""
    return F.broadcast(df) if rows <= MAX_BROADCAST else df


def beside(df: DataFrame, rows: int, scratch: Scratch) -> DataFrame:
    """An aggregate to join with: broadcast if that is within the bound, else a table of its own, so that adaptive execution may split the other side's hot keys."""
    return small(df, rows) if rows <= MAX_BROADCAST else scratch.write(df)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (src, dst), both long; component is the smallest node reachable.

    Alternates the large-star and small-star steps until no edge moves, some log2 of the longest path's length rounds.
    Every step is an aggregation by node (with partial sums) and an equi-join with its result. Up to MAX_BROADCAST rows
    that result is broadcast; a larger one is a table of its own, so that adaptive execution may split a hub's edges.
    Self loops, repeated edges and nulls are left out; an empty input gives an empty table.
    """
    scratch = Scratch(edges.sparkSession, "components")
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    e = scratch.write(e.where("u is not null and v is not null and u <> v").distinct())
    before = _fingerprint(e)
    while before[0]:
        nodes = 2 * before[0]  # at most
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = beside(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), nodes, scratch)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large if nodes <= MAX_BROADCAST else scratch.write(large)
        low = beside(large.groupBy("u").agg(F.min("v").alias("m")), nodes, scratch)
        moved = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        after = scratch.write(moved.where("u <> v").distinct())
        scratch.done(e)
        e, last, before = after, before, _fingerprint(after)
        if last == before:
            break
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _fingerprint(e: DataFrame) -> tuple:
    row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]
