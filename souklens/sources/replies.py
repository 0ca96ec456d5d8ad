"""Landed JSON replies as tables. Missing or null containers have no rows; what can't be used goes to a quarantine table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DETAIL_REPLY, RELATED_REPLY, SEARCH_REPLY, SUGGESTED_REPLY


#: What each kind of reply is read by.
KINDS = {"search": SEARCH_REPLY, "suggested": SUGGESTED_REPLY, "related": RELATED_REPLY, "details": DETAIL_REPLY}


def unreadable(replies: DataFrame, kind: str, payload: str = "payload") -> DataFrame:
    """The replies of a kind (KINDS) that can't be read whole, with their payload and a reason: no reply (null), no JSON, or other shape (JSON of which some part isn't what the kind has there).

    The other functions read what they can of such a reply; here it is kept as it came, so that nothing is lost unseen.
    """
    read = F.from_json(payload, f"{KINDS[kind]}, __corrupt string", {"columnNameOfCorruptRecord": "__corrupt"})
    a = replies.withColumn("__r", read)
    bad = F.col("__r").isNull() | F.col("__r.__corrupt").isNotNull()
    why = F.when(F.col(payload).isNull(), "no reply").when(F.trim(payload).eqNullSafe("") | F.try_parse_json(payload).isNull(), "no JSON").otherwise("other shape")
    array = F.coalesce(F.trim(payload).startswith("["), F.lit(False))  # of which from_json would take the first element
    return a.where(bad | array).drop("__r").withColumn("reason", why)


def search_hits(replies: DataFrame, payload: str = "payload") -> DataFrame:
    """One row for each link, with its rank as position; all columns of replies but the payload stay."""
    parsed = replies.withColumn("__r", F.from_json(payload, SEARCH_REPLY))
    keep = [c for c in replies.columns if c != payload]
    return parsed.select(*keep, F.posexplode("__r.organic_results").alias("position", "__x")).select(*keep, "position", F.col("__x.link").alias("url"))


def usable_hits(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits with a link, and those without."""
    return hits.where("url is not null"), hits.where("url is null").withColumn("reason", F.lit("no link"))


def keyword_items(replies: DataFrame, kind: str, payload: str = "payload") -> DataFrame:
    """(text, volume) of every item of suggested or related replies, in order: ord counts through tasks, results and items."""
    keep = [c for c in replies.columns if c != payload]
    a = replies.withColumn("__r", F.from_json(payload, SUGGESTED_REPLY if kind == "suggested" else RELATED_REPLY))
    a = a.select(*keep, F.posexplode("__r.tasks").alias("__i", "__t"))
    a = a.select(*keep, "__i", F.posexplode("__t.result").alias("__j", "__u"))
    a = a.select(*keep, "__i", "__j", F.posexplode("__u.items").alias("__k", "__x"))
    x = "__x" if kind == "suggested" else "__x.keyword_data"
    return a.select(*keep, F.struct("__i", "__j", "__k").alias("ord"), F.col(f"{x}.keyword").alias("text"), F.col(f"{x}.keyword_info.search_volume").alias("volume"))


def usable_keywords(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    bad = F.col("text").isNull() | F.col("volume").isNull()
    return items.where(~bad), items.where(bad).withColumn("reason", F.when(F.col("text").isNull(), "no text").otherwise("no volume"))


def image_urls(product: Column) -> Column:
    """The main image first, then the others; null and empty ones are left out, repeated ones stay; no product gives none."""
    others = F.transform(F.coalesce(product["images"], F.array().cast("array<struct<url:string>>")), lambda i: i["url"])
    return F.coalesce(F.filter(F.concat(F.array(product["mainImage"]["url"]), others), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def product_details(replies: DataFrame, url: str = "url", payload: str = "payload") -> DataFrame:
    """url and the five fields of detail replies; a probability that is no number is null."""
    p = F.col("__r.product")
    return replies.withColumn("__r", F.from_json(payload, DETAIL_REPLY)).select(
        url, p["name"].alias("product_name"), p["price"].alias("product_price"), p["description"].alias("product_description"),
        image_urls(p).alias("product_images"), p["metadata"]["probability"].try_cast("double").alias("probability"),
    )
