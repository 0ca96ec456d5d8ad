"""Keyword tables from a corpus, and the ranking of suggested and related terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens
from .top import first_rows

#: Seeds that are sent to all documents.
FEW = 10_000


def _holding(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """doc, the columns of seeds, want, words, at (places, from 0, where the seed's tokens stand) for the documents that hold a seed.

    Seeds with a column lang meet the documents of that language alone.

    Documents meet seeds by the seed's first token, so no document is paired with a seed that it can't hold. Up to FEW
    seeds, of which this is checked, go to the documents; more are joined with each document's distinct tokens. A
    document is a doc_id; a row without one is a document of its own.
    """
    by = ["token", "lang"] if "lang" in seeds.columns else ["token"]
    s = seeds.withColumn("want", tokens(F.col("seed"))).where("size(want) > 0").distinct().withColumn("token", F.col("want")[0])
    doc = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string")))
    d = docs.select(doc.alias("doc"), tokens(F.col("text")).alias("words"), *by[1:])
    if few := s.limit(FEW + 1).count() <= FEW:
        d = d.crossJoin(F.broadcast(s.agg(F.collect_set("token").alias("firsts"))))  # one row
    met = d.select("doc", "words", *by[1:], F.explode(F.array_intersect("words", "firsts") if few else F.array_distinct("words")).alias("token")).join(F.broadcast(s) if few else s, by).drop("token")
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.slice("words", i + 1, F.size("want")) == F.col("want"))
    return met.withColumn("at", places).where("size(at) > 0")


SOURCES = ("suggested", "related")


def term_counts(docs: DataFrame, seeds: DataFrame, sources: Sequence[str] = SOURCES, least: int = 4) -> DataFrame:
    """The columns of seeds (seed, and lang if there is one), source, text and volume: the number of documents in which a seed has the term; both sources from one pass over the documents.

    suggested: n-grams around a seed, up to two tokens longer; related: tokens of `least` characters or more in the
    documents that hold the seed. A document gives each term once, so documents are counted as rows, in partial sums
    before any shuffle; only those whose doc_id occurs more than once are told apart by it.
    """
    held, n = _holding(docs, seeds), F.size("want")
    grams = lambda more: F.transform(F.filter(F.array_distinct(F.flatten(F.transform("at", lambda i: F.sequence(i - more, i)))), lambda i: (i >= 0) & (i + n + more <= F.size("words"))), lambda i: F.array_join(F.slice("words", i + 1, n + more), " "))
    found = {"suggested": F.array_distinct(F.concat(*[grams(more) for more in (0, 1, 2)])), "related": F.filter(F.array_distinct("words"), lambda w: F.length(w) >= least)}
    of = lambda source: F.transform(found[source], lambda t: F.struct(F.lit(source).alias("source"), t.alias("text")))
    twice = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("__doc")).agg(F.count("*").alias("n")).where("n > 1").select("__doc")
    if twice.limit(FEW + 1).count() <= FEW:
        held = held.join(F.broadcast(twice), F.col("doc") == F.col("__doc"), "left")
    else:
        held = held.withColumn("__doc", F.col("doc"))
    terms = held.select("__doc", *seeds.columns, F.explode(F.concat(*[of(s) for s in sources])).alias("t")).select("__doc", *seeds.columns, "t.*")
    volume = F.count_if(F.col("__doc").isNull()) + F.count_distinct("__doc")
    return terms.groupBy(*seeds.columns, "source", "text").agg(volume.alias("volume"))


def _limited(terms: DataFrame, limit: int | None, keys: Sequence[str] = ("seed",)) -> DataFrame:
    return first_rows(terms, keys, [F.desc("volume"), F.asc("text")], F.col("limit") if limit is None else limit, F.col("text"), "ord")


def _of_source(docs: DataFrame, seeds: DataFrame, limit: int | None, source: str, least: int = 4) -> DataFrame:
    return _limited(term_counts(docs, seeds, [source], least).drop("source"), limit, seeds.columns)


def suggest_terms(docs: DataFrame, seeds: DataFrame, limit: int | None = None) -> DataFrame:
    """The columns of seeds (seed; lang and limit, if there are any), text, volume, ord: the suggested terms of term_counts, the first by volume and text.

    Without `limit` each seed's own counts, a column of seeds.
    """
    return _of_source(docs, seeds, limit, "suggested")


def related_terms(docs: DataFrame, seeds: DataFrame, limit: int | None = None, least: int = 4) -> DataFrame:
    """As suggest_terms: the related terms of term_counts."""
    return _of_source(docs, seeds, limit, "related", least)


def both_terms(docs: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """suggest_terms and related_terms in one, with a column source, from one pass over the documents."""
    return _limited(term_counts(docs, seeds), limit, [*seeds.columns, "source"])


def requested_terms(docs: DataFrame, requests: DataFrame, n: int) -> DataFrame:
    """seed, lang, text, volume, rank: the n best terms for each seed and language of keyword requests.

    requests: as requests.keyword_requests; a request is answered from the documents (doc_id, text, lang) in its
    language, with as many terms as its limit says.
    """
    asked = requests.select("seed", F.col("language_name").alias("lang"), "limit", "source").distinct()
    counts = term_counts(docs, asked.select("seed", "lang").distinct()).join(asked, ["seed", "lang", "source"])
    return ranked(_limited(counts, None, ["seed", "lang", "source", "limit"]).drop("limit"), n)


def ranked(terms: DataFrame, n: int) -> DataFrame:
    """The n terms of each seed (and language, if there is one) with the largest volume (0 at least), the seed itself aside; ties: suggested first, then their order.

    terms: seed, maybe lang, source, text, volume, ord.
    """
    keys = [c for c in terms.columns if c not in ("source", "text", "volume", "ord")]
    placed = terms.where("text <> seed").withColumn("o", F.struct((F.col("source") != "suggested").alias("s"), "ord"))
    best = placed.groupBy(*keys, "text").agg(F.greatest(F.lit(0), F.max("volume")).alias("volume"), F.min("o").alias("o"))
    order = W.partitionBy(*keys).orderBy(F.desc("volume"), F.asc("o"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(*keys, "text", "volume", "rank")


def rank_terms(suggested: DataFrame, related: DataFrame, n: int) -> DataFrame:
    """ranked() of two tables of terms, each without a source."""
    return ranked(suggested.withColumn("source", F.lit("suggested")).unionByName(related.withColumn("source", F.lit("related"))), n)
