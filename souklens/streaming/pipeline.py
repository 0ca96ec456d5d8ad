"""The stages of a run on a stream of hits."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.classify import classify
from ..operators.products import flag_probability, with_details
from ..operators.search import products
from ..schema import PROBABILITY_THRESHOLD, Prompt
from .dedupe import batch_sink, flag_by_rank, flag_known, flag_repeated

DETAILS = "url string, product_name string, product_price string, product_description string, product_images array<string>, probability double"


def flagged_hits(hits: DataFrame, requests: DataFrame, country: str | None, seen: DataFrame, marketplaces: DataFrame | None = None, excluded: DataFrame | None = None, ttl_ms: int | None = None, time: str | None = None, wait_ms: int = 0) -> DataFrame:
    """A stream of hits (search_id, position, url) as product records, flagged by country, known urls and repetition; all other tables are static.

    With `time`, a column of hits with a watermark, the first of a url is the one of lowest search and position, as in a
    batch (dedupe.flag_by_rank); without it, the first to arrive. Each hit comes out once.
    """
    rows = flag_known(products(hits, requests, country, marketplaces, excluded), seen)
    return flag_by_rank(rows, time, wait_ms) if time else flag_repeated(rows, ttl_ms)


def detailing_sink(path: str, store: str, details: Callable[[DataFrame], DataFrame], prompts: Sequence[Prompt], predict: Callable[[pd.DataFrame], pd.Series], threshold: float = PROBABILITY_THRESHOLD, each: bool = False) -> Callable[[DataFrame, int], None]:
    """A sink for flagged_hits that adds details, the probability flag and labels; rows go to path/out, in a folder for each batch.

    details makes the details (DETAILS) of a table of urls. It is asked once for each url: what it made is kept in
    store, a folder for each batch, and a batch looks up its own urls there, asking for those alone that no earlier
    batch has asked for. A batch that comes again replaces its rows and details.
    """

    def sink(batch: DataFrame, i: int) -> None:
        spark = batch.sparkSession
        batch_sink(f"{path}/flagged")(batch, i)
        rows = spark.read.schema(batch.schema).parquet(f"{path}/flagged/batch={i}")
        urls = rows.where("url is not null").select("url").distinct()
        spark.createDataFrame([], DETAILS).write.mode("ignore").parquet(f"{store}/batch=-1")
        stored = lambda: spark.read.schema(f"{DETAILS}, batch long").parquet(store)
        new = urls.join(stored().where(F.col("batch") < i).select("url"), "url", "left_anti")
        asked = new.join(details(new).select(*[x.split()[0] for x in DETAILS.split(", ")]), "url", "left")  # a url without details is not asked for again
        asked.write.mode("overwrite").parquet(f"{store}/batch={i}")
        mine = stored().where(F.col("batch") <= i).drop("batch").join(urls, "url", "left_semi")
        batch_sink(f"{path}/out")(classify(flag_probability(with_details(rows, mine, each), threshold), prompts, predict), i)

    return sink
