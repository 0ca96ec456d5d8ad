"""Ranks within groups, and the first rows of each group by an order, without all rows of a group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import Scratch

SALTS = 64
#: Up to this limit the last step of first_rows may have SALTS times as many rows of a group in one task; above it all rows are placed.
MOST = 10_000


def placed(df: DataFrame, group: str | Sequence[str], order: Sequence[Column], into: str, scratch: Scratch) -> DataFrame:
    """df with `into`: each row's place in its group by order, from 0.

    Rows are sorted in ranges of (group, order), so that a large group lies in many tasks and a small one in one. A
    row's place in its range, less that of the group's first row there, plus the group's rows in earlier ranges, is its
    place in the group; beside the rows only these counts, one for each group and range, are shuffled. The sorted rows
    are a table of their own, since ranges may differ from one run of a plan to the next. Rows that are equal in order
    have their places in any order; null is a group like others. An empty table gives an empty one.
    """
    by = [group] if isinstance(group, str) else list(group)
    keys = [F.col(c) for c in by]
    rows = scratch.write(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = rows.groupBy(*by, part.alias("__part")).agg(F.count("*").alias("n"), F.min("__at").alias("first"))
    earlier = F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = counts.select(*[F.col(c).alias(f"__{c}") for c in by], "__part", (earlier - F.col("first")).alias("__before"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], part == F.col("__part"))
    return rows.join(before, same).withColumn(into, (F.col("__at") + F.col("__before")).cast("int")).drop("__at", "__part", "__before", *[f"__{c}" for c in by])


def first_rows(df: DataFrame, group: str | Sequence[str], order: Sequence[Column], limit: int | Column, salt: Column, into: str, most: int | None = None) -> DataFrame:
    """The `limit` first rows of each group, with their place from 0 in `into`: first of each part of a group by salt, then of the parts' firsts.

    order is total; salt is anything that spreads a group's rows. most: what no limit exceeds; where that is above MOST
    the limits may leave most of a large group, so all rows are placed by ranges instead.
    """
    most = limit if isinstance(limit, int) else most
    limit = F.lit(limit) if isinstance(limit, int) else limit
    if most is not None and most > MOST:
        return placed(df, group, order, into, Scratch(df.sparkSession, "places")).where(F.col(into) < limit)
    by = [group] if isinstance(group, str) else list(group)
    part = W.partitionBy(*by, "__salt").orderBy(*order)
    few = df.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(SALTS))).withColumn("__n", F.row_number().over(part)).where(F.col("__n") <= limit)
    return few.drop("__salt", "__n").withColumn(into, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(into) <= limit).withColumn(into, F.col(into) - 1)
