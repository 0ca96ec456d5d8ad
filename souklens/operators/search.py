"""Search over a page table, rank limits, and the product record of a hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens, visible_text
from ..functions.urls import domain, in_country
from ..schema import COUNTRY, flagged
from .hosts import exclude_hosts, with_marketplace
from .top import first_rows

#: Wanted tokens that are sent to all pages.
FEW = 200


def first_hits(hits: DataFrame, limit: str = "num_results") -> DataFrame:
    """Of each search the hits with a position below its limit; positions count from 0."""
    return hits.where(F.col("position") < F.col(limit))


def wanted_tokens(requests: DataFrame) -> DataFrame:
    """search_id, num_results, sites, n_want and token: one row for each distinct token of a request's term."""
    wanted = requests.select("search_id", "num_results", "sites", F.array_distinct(tokens(F.col("term"))).alias("want"))
    return wanted.select("search_id", "num_results", "sites", F.size("want").alias("n_want"), F.explode("want").alias("token"))


def allowed(host: Column, sites: Column) -> Column:
    """Whether a domain is one of the sites or below one; no or null sites allow every domain."""
    return F.coalesce(F.size(sites), F.lit(0)).isin(0, -1) | F.exists(sites, lambda s: (host == s) | F.endswith(host, F.concat(F.lit("."), s)))


def ranked_hits(found: DataFrame, requests: DataFrame) -> DataFrame:
    """search_id, page_id, url, score and position of the first num_results of each search by score, then page_id, then url."""
    most = requests.agg(F.max("num_results")).first()[0]  # a request table is small; its largest limit decides how ranks are found
    ranked = first_rows(found, "search_id", [F.desc("score"), F.asc("page_id"), F.asc("url")], F.col("num_results"), F.struct("page_id", "url"), "position", most or 0)
    return ranked.select("search_id", "page_id", "url", "score", "position")


def search_pages(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """search_id, page_id, url, score and position of the pages that hold all tokens of a request's term.

    requests: search_id, term, num_results and sites (array, may be null or empty). The score is how often the tokens
    occur in the visible text; order: score, then page_id and url. With sites, a page's domain has to be one of them or
    below one. Up to FEW wanted tokens go to the pages, so that no other token leaves them; ids, urls and counts are
    shuffled. Many searches of one table do better with an index (index.indexed_search).
    """
    wanted = wanted_tokens(requests)
    found = tokens(visible_text(F.col("html")))
    if wanted.select("token").distinct().limit(FEW + 1).count() <= FEW:
        pages = pages.crossJoin(F.broadcast(wanted.agg(F.collect_set("token").alias("wanted"))))  # one row
        found = F.filter(found, lambda t: F.array_contains("wanted", t))
    words = pages.select("page_id", "url", domain(F.col("url")).alias("d"), F.explode(found).alias("token"))
    found = words.join(wanted, "token").where(allowed(F.col("d"), F.col("sites"))).groupBy("search_id", "num_results", "n_want", "page_id", "url").agg(F.count("*").alias("score"), F.count_distinct("token").alias("n")).where("n = n_want")
    return ranked_hits(found, requests)


def products(hits: DataFrame, requests: DataFrame, country: str | None, marketplaces: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """Hits (search_id, position, url) as product records: domain, marketplace, country flag; excluded hosts are gone.

    requests: search_id, search_ord, search_term, search_term_type, and run_id and country where they differ by search:
    without `country` each search has its own, and tables of hosts with a run_id hold for that run alone.
    """
    own = [c for c in ("run_id", "country") if c in requests.columns]
    by = lambda table: ["run_id"] if table is not None and "run_id" in table.columns else []
    code = F.lit(country) if country else F.col("country")
    rows = hits.join(requests.select("search_id", "search_ord", "search_term", "search_term_type", *own), "search_id").withColumn("domain", domain(F.col("url")))
    rows = with_marketplace(rows, marketplaces, by=by(marketplaces)).withColumns({"filtered": F.lit(False), "filtered_at_stage": F.lit(None).cast("string")})
    return exclude_hosts(flagged(rows, ~in_country(F.col("url"), code), COUNTRY), excluded, by=by(excluded)).drop("country")


def hit_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("search_id").agg(F.count("*").alias("n_hits"))
