"""Mixing sources to target weights: budgets go down a domain-language-source tree, each leaf gives a seeded prefix of its tokens."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import Scratch
from .common import blank_separated, free_name, small

LEVELS = ("domain", "lang", "source")
#: Ranges of each leaf's seeded order, and parts of the range in which its budget ends.
BUCKETS = 1024

#: Which sources make up a domain, as (pattern, domain); others are "other".
DOMAINS = (("^src[0-4]$", "web"), ("^src[5-9]$", "books"), ("^src1[0-4]$", "forums"), ("^src1[5-9]$", "news"))
#: Weights by path; siblings without one weigh 1.
WEIGHTS = {("web",): 4.0, ("books",): 3.0, ("forums",): 1.0, ("news",): 2.0, ("other",): 0.5, ("web", "en"): 3.0, ("news", "de"): 2.0}


def domain_of(source: Column, domains=DOMAINS) -> Column:
    out = F.lit("other")
    for pattern, name in reversed(domains):
        out = F.when(source.rlike(pattern), name).otherwise(out)
    return out


def _poured(children: DataFrame, parent: list[str]) -> DataFrame:
    """children (parent's columns, weight, capacity, budget of the parent) with `share`: the budget by weight, where what exceeds a child's capacity goes to the siblings that have room.

    A child is full if the level at which it would be, filled up with all that are sooner full, needs no more than the
    budget; the others share the rest. A window of a parent's children holds one row for each, never their documents.
    """
    ratio = F.when((F.col("weight") > 0) & (F.col("capacity") > 0), F.col("capacity") / F.col("weight"))
    within = W.partitionBy(*(parent or [F.lit(0)]))
    sooner = within.orderBy(F.asc_nulls_last("ratio")).rangeBetween(W.unboundedPreceding, 0)
    a = children.withColumn("ratio", ratio).withColumn("open", F.when(F.col("ratio").isNotNull(), F.col("weight")).otherwise(0.0)).withColumn("room", F.when(F.col("ratio").isNotNull(), F.col("capacity")).otherwise(0.0))
    level = F.sum("room").over(sooner) + F.col("ratio") * (F.sum("open").over(within) - F.sum("open").over(sooner))
    a = a.withColumn("full", F.coalesce(level <= F.col("budget"), F.lit(False)))
    left = F.col("budget") - F.sum(F.when(F.col("full"), F.col("room")).otherwise(0.0)).over(within)
    by = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("open"))).over(within)
    part = F.when(by > 0, F.greatest(left, F.lit(0.0)) * F.col("open") / by).otherwise(0.0)
    return a.withColumn("share", F.when(F.col("full"), F.col("room")).otherwise(part)).drop("ratio", "open", "room", "full")


def budgets(leaves: DataFrame, total: float, weights: Mapping[tuple, float], max_epochs: int = 1) -> DataFrame:
    """leaves (domain, lang, source, t) with share: the tokens to take from each leaf, a whole number.

    A leaf holds max_epochs times its tokens t at most, an inner node what its leaves hold. A node's budget is shared
    among its children by weight; a child takes no more than it holds, and the rest goes to its siblings. Only what a
    whole subtree can't take reaches the siblings of its root, and so on upwards. Siblings without a weight weigh 1.
    Levels are shared out one after the other, from the root; any number of leaves, none of them on the driver.
    """
    spark, cap = leaves.sparkSession, F.col("t") * F.lit(float(max_epochs))
    above = leaves.agg(F.least(F.lit(float(total)), F.coalesce(F.sum(cap), F.lit(0.0))).alias("budget"))
    for i in range(1, len(LEVELS) + 1):
        path, parent = list(LEVELS[:i]), list(LEVELS[: i - 1])
        given = [(*k, float(w)) for k, w in weights.items() if len(k) == i]
        by = spark.createDataFrame(given, ", ".join(f"{c} string" for c in path) + ", given double")
        held = leaves.groupBy(*path).agg(F.sum(cap).alias("capacity"), F.sum("t").alias("t"))
        children = (held.join(above, parent) if parent else held.crossJoin(above)).join(F.broadcast(by), path, "left").withColumn("weight", F.coalesce("given", F.lit(1.0)))  # above is one row for no parent; weights are a parameter
        shared = _poured(children, parent)
        above = shared.select(*path, F.col("share").alias("budget"))
    return shared.select(*LEVELS, "t", F.floor(F.col("share") + 1e-6).cast("long").alias("share"))


def _edge(parts: DataFrame, leaf: list[str]) -> DataFrame:
    """Of parts (leaf, b, t, before, rest) the last of each leaf that begins before the rest is used up: leaf, b, before (the tokens ahead of it), rest."""
    ahead = W.partitionBy(*leaf).orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    begun = parts.withColumn("before", F.col("before") + F.coalesce(F.sum("t").over(ahead), F.lit(0))).where("before < rest")
    return begun.groupBy(*leaf).agg(F.max(F.struct("b", "before", "rest")).alias("x")).select(*leaf, "x.*")


def mixed(
    docs: DataFrame, weights: Mapping[tuple, float] = WEIGHTS, fraction: float = 0.5, total: int | None = None, max_epochs: int = 1, seed: int = 1,
    domain: Column | None = None, text: str = "text", doc_id: str = "doc_id", tokens: Column | None = None, epoch: str | None = "epoch", into_domain: str | None = "domain",
) -> DataFrame:
    """docs' rows that make up a mixture of `total` tokens (or `fraction` of all tokens), with the epoch they are taken in.

    Each leaf of (domain, lang, source) has its budget from budgets(). Its documents are in an order of their own in each
    epoch, by a hash of seed, epoch, doc_id and text; whole epochs are taken while the budget lasts, and of the next one
    the documents that begin within what is left, so a leaf exceeds its budget by less than one document. Tokens are
    blank-separated words unless a column is given, whose null and negative values count as 0. Null or empty lang, source
    or domain make one leaf ""; texts without tokens are taken with those around them; equal rows, and others of one
    place in the order, are taken together. Columns called as `epoch` or `into_domain` are replaced (None: not added),
    all others pass through, whatever their names. An empty table gives an empty one.

    No leaf is collected or sorted: tokens are summed in BUCKETS ranges of the order (with partial sums), those of the
    range in which a budget ends in BUCKETS parts of it, and only such a part, a millionth of the leaf, is put in order.
    """
    spark, own = docs.sparkSession, [c for c in docs.columns if c not in (epoch, into_domain)]
    scratch, leaf = Scratch(spark, "mixing"), [free_name(docs.columns, f"m_{c}") for c in LEVELS]
    flat = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    of_row = dict(zip(leaf, (flat(domain if domain is not None else domain_of(F.col("source"))), flat(F.col("lang")), flat(F.col("source"))), strict=True))
    place = lambda e: F.xxhash64(F.lit(seed), e.cast("int"), F.col(doc_id), F.xxhash64(text))
    bucket = lambda h, n: F.floor((h / F.lit(2.0**64) + 0.5) * n)
    counted = F.greatest(F.lit(0), F.coalesce(tokens if tokens is not None else F.size(blank_separated(F.col(text))), F.lit(0))).cast("long")

    slim = docs.select(*[c.alias(k) for k, c in of_row.items()], counted.alias("t"), F.array(*[place(F.lit(e)) for e in range(max_epochs)]).alias("h"))
    sums = scratch.write(slim.select(*leaf, "t", F.posexplode("h").alias("e", "h")).groupBy(*leaf, "e", bucket(F.col("h"), BUCKETS).alias("b")).agg(F.sum("t").alias("t")))
    leaves = sums.where("e = 0").groupBy(*leaf).agg(F.sum("t").alias("t"))
    goal = total if total is not None else fraction * (leaves.agg(F.sum("t")).first()[0] or 0)
    shares = budgets(leaves.toDF(*LEVELS, "t"), goal, weights, max_epochs).toDF(*leaf, "t", "share")
    goals = scratch.write(shares.select(*leaf, F.when(F.col("t") > 0, F.expr("share div t")).otherwise(0).alias("whole"), F.when(F.col("t") > 0, F.expr("share % t")).otherwise(0).alias("rest")))
    n = goals.count()

    ends = _edge(sums.join(small(goals, n), leaf).where("e = whole and rest > 0").withColumn("before", F.lit(0).cast("long")), leaf)
    ends = scratch.write(ends.join(goals.select(*leaf, "whole"), leaf))
    rows = docs.select(*[c.alias(k) for k, c in of_row.items()], F.array(*[place(F.lit(e)) for e in range(max_epochs)]).alias("h"), counted.alias("t"))
    inside = rows.join(small(ends, n), leaf).withColumn("h", F.get("h", F.col("whole").cast("int"))).where(bucket(F.col("h"), BUCKETS) == F.col("b"))
    keyed = scratch.write(inside.groupBy(*leaf, "before", "rest", "h", bucket(F.col("h"), BUCKETS**2).alias("b")).agg(F.sum("t").alias("t")))
    part = scratch.write(_edge(keyed.groupBy(*leaf, "before", "rest", "b").agg(F.sum("t").alias("t")), leaf))
    last = _edge(keyed.drop("before", "rest").join(part, [*leaf, "b"]).select(*leaf, F.col("h").alias("b"), "t", "before", "rest"), leaf).select(*leaf, F.col("b").alias("last"))
    plan = scratch.write(goals.join(last, leaf, "left").select(*leaf, F.struct("whole", "last").alias("plan")))
    scratch.done(sums, goals, ends, keyed, part)

    given, times, turn = (free_name([*docs.columns, *leaf], x) for x in ("plan", "times", "turn"))
    whole, end = F.col(f"{given}.whole"), F.col(f"{given}.last")
    b = docs.withColumns(of_row).join(small(plan.withColumnRenamed("plan", given), n), leaf)
    b = b.withColumn(times, whole + F.when(end.isNotNull() & (place(whole) <= end), 1).otherwise(0)).where(F.col(times) > 0)
    b = b.withColumn(turn, F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1)))
    added = [F.col(c).alias(name) for c, name in ((leaf[0], into_domain), (turn, epoch)) if name]
    return b.select(*[F.col(c) for c in own], *added)
