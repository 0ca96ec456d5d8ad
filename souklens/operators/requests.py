"""Request tables: search strings, search requests and keyword requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import KEYWORD_LIMIT


def sites(hosts: DataFrame) -> DataFrame:
    """One row: all domains of all hosts in order, as an array."""
    return hosts.agg(F.array_sort(F.collect_list(F.struct("ord", "domains"))).alias("x")).select(F.flatten(F.col("x.domains")).alias("sites"))


def run_sites(hosts: DataFrame) -> DataFrame:
    """run_id and all domains of its hosts in order, from rows (run_id, ord, domains)."""
    return hosts.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("ord", "domains"))).alias("x")).select("run_id", F.flatten(F.col("x.domains")).alias("sites"))


def search_string(term: Column, site_list: Column) -> Column:
    """The term, restricted to sites if there are any."""
    return F.when(F.size(site_list) > 0, F.concat(term, F.lit(" site:"), F.array_join(site_list, " OR site:"))).otherwise(term)


def search_requests(terms: DataFrame, language: str, language_code: str, location: str, location_code: str, hosts: DataFrame | None = None) -> DataFrame:
    """terms (search_term, search_term_type, num_results) with the parameters of a search service."""
    listed = terms.join(sites(hosts)) if hosts is not None else terms.withColumn("sites", F.array().cast("array<string>"))
    cc, upper = location_code.lower(), location_code.upper()
    return listed.withColumns({
        "engine": F.lit("google"), "q": search_string(F.col("search_term"), F.coalesce("sites", F.array().cast("array<string>"))), "google_domain": F.lit(f"google.{cc}"), "location_requested": F.lit(location),
        "location_used": F.lit(location), "tbs": F.lit(f"ctr:{upper}&cr:country{upper}"), "gl": F.lit(cc), "hl": F.lit(language_code), "num": F.col("num_results"),
    })


def keyword_requests(seeds: DataFrame, run: DataFrame, limit: int = KEYWORD_LIMIT) -> DataFrame:
    """One row for each seed, run (language, location) and source; only requests for suggestions say what to include."""
    both = seeds.crossJoin(run).withColumn("source", F.explode(F.array(F.lit("suggested"), F.lit("related"))))  # run is one row for each language and location of a run
    own = F.col("source") == "suggested"
    return both.select("seed", F.col("language").alias("language_name"), F.col("location").alias("location_name"), F.lit(limit).alias("limit"), "source", F.when(own, True).alias("include_serp_info"), F.when(own, True).alias("include_seed_keyword"))


def search_terms(initial: DataFrame, enriched: DataFrame, num_results: int, per_term: int) -> DataFrame:
    """Initial terms (search_term) and then enriched ones (search_term), with type and number of results."""
    typed = lambda df, kind, n: df.select("search_term", F.lit(kind).alias("search_term_type"), F.lit(n).alias("num_results"))
    return typed(initial, "initial", num_results).unionByName(typed(enriched, "enriched", per_term))
