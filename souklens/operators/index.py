"""An inverted index of a page table: postings by token, written once, from which searches read their own tokens' buckets alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens, visible_text
from ..functions.urls import domain
from ..shared import Scratch
from .search import allowed, ranked_hits, wanted_tokens

#: Buckets of tokens, and parts of a bucket by page, so that a very frequent token fills several files.
BUCKETS, PARTS = 64, 8
POSTINGS = "token string, page long, domain string, count long, bucket int"


def _bucket(token: str, buckets: int):
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def write_index(pages: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Writes the index of pages (page_id, url, html) to path: `pages` (page, page_id, url) and `postings` (token, page, domain, count) in a folder for each bucket, sorted by token.

    A page is a pair of page_id and url; rows that repeat one add to its counts, as in search.search_pages. Html is read
    and cut into tokens once, into a table of one row for each row of pages. Null html has no tokens.
    """
    scratch = Scratch(pages.sparkSession, "index")
    words = pages.select("page_id", "url", tokens(visible_text(F.col("html"))).alias("words"))
    rows = scratch.write(words.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "words"))
    first = rows.groupBy("page_id", "url").agg(F.min("row").alias("page"), F.count("*").alias("n"))
    named = scratch.write(first)
    named.select("page", "page_id", "url").write.parquet(f"{path}/pages")
    # Only rows whose page has another row as well are looked up; mostly there are none.
    twice = rows.select("row", "page_id", "url").join(named.where("n > 1"), (rows["page_id"].eqNullSafe(named["page_id"])) & (rows["url"].eqNullSafe(named["url"]))).select("row", "page")
    own = rows.join(twice, "row", "left").select(F.coalesce("page", "row").alias("page"), domain(F.col("url")).alias("domain"), F.explode("words").alias("token"))
    postings = own.groupBy("token", "page", "domain").agg(F.count("*").alias("count")).withColumn("bucket", _bucket("token", buckets))
    postings.repartition("bucket", F.pmod("page", F.lit(PARTS))).sortWithinPartitions("bucket", "token", "page").write.partitionBy("bucket").parquet(f"{path}/postings")
    pages.sparkSession.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/settings")
    scratch.done(rows, named)


def indexed_search(spark: SparkSession, path: str, requests: DataFrame) -> DataFrame:
    """The rows of search.search_pages(pages, requests), from the index of these pages at path.

    Only folders of buckets that hold a wanted token are read, a page with its tokens' counts is one group of as many
    rows as the request has tokens, and urls are looked up for pages that have them all. No html is read.
    """
    buckets = spark.read.parquet(f"{path}/settings").first()["buckets"]
    wanted = wanted_tokens(requests)
    mine = [r["bucket"] for r in wanted.select(_bucket("token", buckets).alias("bucket")).distinct().collect()]  # no more than there are buckets
    postings = spark.read.schema(POSTINGS).parquet(f"{path}/postings").where(F.col("bucket").isin(mine)).drop("bucket")
    found = postings.join(wanted, "token").where(allowed(F.col("domain"), F.col("sites")))
    found = found.groupBy("search_id", "num_results", "n_want", "page").agg(F.sum("count").alias("score"), F.count("*").alias("n")).where("n = n_want")
    return ranked_hits(found.join(spark.read.parquet(f"{path}/pages"), "page"), requests)
