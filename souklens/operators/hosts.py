"""Marketplace lookup and host exclusion."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULT_MARKETPLACE


def _same(by: Sequence[str], key: Column, other: str) -> Column:
    """The join condition: equal keys, and equal columns `by`, which the other side has with two underscores before."""
    return reduce(Column.__and__, [F.col(c) == F.col(f"__{c}") for c in by], key == F.col(other))


def with_marketplace(df: DataFrame, hosts: DataFrame | None, domain: str = "domain", by: Sequence[str] = ()) -> DataFrame:
    """df with marketplace_name: the first host in list order that has the domain, case aside; else the default. by: columns of both, such as run_id, whose rows have hosts of their own."""
    if hosts is None:
        return df.withColumn("marketplace_name", F.lit(DEFAULT_MARKETPLACE))
    own = [F.col(c).alias(f"__{c}") for c in by]
    flat = hosts.select("ord", "name", *by, F.explode("domains").alias("d")).groupBy(*own, F.lower("d").alias("__domain")).agg(F.min_by("name", "ord").alias("__market"))
    joined = df.drop("marketplace_name").join(flat, _same(by, F.lower(domain), "__domain"), "left")
    return joined.withColumn("marketplace_name", F.coalesce("__market", F.lit(DEFAULT_MARKETPLACE))).drop("__domain", "__market", *[f"__{c}" for c in by])


def exclude_hosts(df: DataFrame, excluded: DataFrame | None, domain: str = "domain", case_sensitive: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """df without rows whose domain is exactly one of the excluded hosts' domains (with equal columns `by`); subdomains stay."""
    if excluded is None:
        return df
    same = F.col if case_sensitive else F.lower
    own = [F.col(c).alias(f"__{c}") for c in by]
    gone = excluded.select(*own, F.explode("domains").alias("__gone")).withColumn("__gone", same("__gone")).distinct()
    return df.join(gone, _same(by, same(domain), "__gone"), "left_anti")
