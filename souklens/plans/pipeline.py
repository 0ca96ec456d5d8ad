"""The whole run as one plan: search terms, hits, flags, details, labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.classify import classify
from ..operators.dedupe import flag_current_run, flag_previous_runs
from ..operators.keywords import requested_terms
from ..operators.products import flag_probability, with_details
from ..operators.requests import keyword_requests, run_sites
from ..operators.search import products, search_pages
from ..schema import PROBABILITY_THRESHOLD, Prompt
from ..shared import Scratch
from ..sources.dims import with_code


def annotate(hits: DataFrame, requests: DataFrame, country: str | None, details: DataFrame, seen: DataFrame | None = None, marketplaces: DataFrame | None = None, excluded: DataFrame | None = None, threshold: float = PROBABILITY_THRESHOLD, each: bool = False) -> DataFrame:
    """All hits that are not excluded, with details and the first stage that flagged them.

    requests: run_id, search_id, search_ord, search_term, search_term_type (and country, as in operators.search.products);
    hits: search_id, position, url; details: as sources.replies.product_details. A hit whose url has several details
    has the fullest; with `each` it has a row for every one of them, flagged and labelled for itself.
    """
    rows = products(hits, requests, country, marketplaces, excluded)
    if seen is not None:
        rows = flag_previous_runs(rows, seen)
    return flag_probability(with_details(flag_current_run(rows), details, each), threshold)


def run(hits: DataFrame, requests: DataFrame, country: str | None, details: DataFrame, prompts: Sequence[Prompt] | DataFrame, predict: Callable[[pd.DataFrame], pd.Series], **more) -> DataFrame:
    """annotate(), then the labels of all prompts for the rows that no stage flagged."""
    record = ["run_id", "search_id", "position", "search_term", "search_term_type", "url", "marketplace_name", "domain", "product_name", "product_price", "product_description", "product_images", "probability", "filtered", "filtered_at_stage"]
    return classify(annotate(hits, requests, country, details, **more).select(*map(F.col, record)), prompts, predict)


def search_table(runs: DataFrame, docs: DataFrame, n_terms: int, per_term: int) -> DataFrame:
    """The searches of runs: the initial term first, then up to n_terms enriched ones by rank, with per_term results each.

    runs: run_id, search_term, language, location, num_results, and maybe sites and country, one row for each run; docs:
    doc_id, text, lang, from which the keyword requests are answered. Columns: run_id, search_id, search_ord,
    search_term, search_term_type, term, num_results, sites, country.
    """
    none = {"sites": F.lit(None).cast("array<string>"), "country": F.lit(None).cast("string")}
    runs = runs.withColumns({c: x for c, x in none.items() if c not in runs.columns})
    seeds = runs.select(F.col("search_term").alias("seed")).distinct()
    asked = keyword_requests(seeds, runs.select("language", "location").distinct(), n_terms)
    asked = asked.join(runs.select(F.col("search_term").alias("seed"), F.col("language").alias("language_name")).distinct(), ["seed", "language_name"], "left_semi")
    terms = requested_terms(docs, asked, n_terms).select(F.col("seed").alias("search_term"), F.col("lang").alias("language"), "text", "rank")
    own = runs.select("run_id", F.lit(0).alias("search_ord"), "search_term", F.lit("initial").alias("search_term_type"), F.col("num_results").cast("int").alias("num_results"), *none)
    more = runs.join(terms, ["search_term", "language"]).select("run_id", F.col("rank").alias("search_ord"), F.col("text").alias("search_term"), F.lit("enriched").alias("search_term_type"), F.lit(per_term).alias("num_results"), *none)
    search_id = F.concat_ws("/", "run_id", F.col("search_ord").cast("string"))
    return own.unionByName(more).withColumns({"search_id": search_id, "term": F.col("search_term")})


def enriched_run(runs: DataFrame, docs: DataFrame, pages: DataFrame, country: str | None, details: Callable[[DataFrame], DataFrame], prompts: Sequence[Prompt] | DataFrame, predict: Callable[[pd.DataFrame], pd.Series], n_terms: int, per_term: int, **more) -> DataFrame:
    """From seeds to labels: keyword requests, ranked terms, searches, hits, flags, details and labels of all runs.

    runs and docs: as search_table; pages: page_id, url, html; details: makes the details of pages; more: as annotate.
    Searches and hits are written once, as several steps read them; details are made of all pages whose url was hit, of
    those too that no search found themselves, and of no others.
    """
    scratch = Scratch(runs.sparkSession, "enriched")
    searches = scratch.write(search_table(runs, docs, n_terms, per_term))
    hits = scratch.write(search_pages(pages, searches))
    found = pages.join(hits.select("url").distinct(), "url", "left_semi")
    return run(hits, searches, country, details(found), prompts, predict, **more)


def own_settings(runs: DataFrame, languages: DataFrame, locations: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """runs with what each of them looks up for itself: language and country as codes, and the sites of its hosts.

    runs: run_id, search_term, language and location by name, language_code and location_code (null or empty where they
    are to be looked up), num_results; hosts: run_id, ord, name, domains. A run without hosts searches everywhere. An
    unknown language or location without a code is an error.
    """
    coded = with_code(with_code(runs, languages, "language", "language_code", "language_code", "language"), locations, "location", "location_code", "country", "location")
    coded = coded.withColumn("language", F.col("language_code")).drop("language_code", "location_code")
    return coded.join(run_sites(hosts), "run_id", "left") if hosts is not None else coded


def runs_with_own_settings(runs: DataFrame, docs: DataFrame, pages: DataFrame, details: Callable[[DataFrame], DataFrame], languages: DataFrame, locations: DataFrame, hosts: DataFrame | None, excluded: DataFrame | None, prompts: DataFrame, predict: Callable[[pd.DataFrame], pd.Series], n_terms: int, per_term: int, **more) -> DataFrame:
    """enriched_run for runs that differ in country, allowed hosts, excluded hosts and prompts, all by run_id.

    runs: as own_settings; hosts and excluded: run_id, ord, name, domains; prompts: as operators.classify.run_prompts.
    """
    own = own_settings(runs, languages, locations, hosts)
    return enriched_run(own, docs, pages, None, details, prompts, predict, n_terms, per_term, marketplaces=hosts, excluded=excluded, **more)
