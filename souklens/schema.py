"""Record schemas, stage labels and constants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

#: Labels of the stage that flagged a row.
COUNTRY = "country code filtering"
CURRENT_RUN = "URL collection (current run deduplication)"
PREVIOUS_RUN = "URL collection (previous run deduplication)"
PROBABILITY = "Zyte probability threshold"
STAGES = (COUNTRY, PREVIOUS_RUN, CURRENT_RUN, PROBABILITY)
#: Defaults.
DEFAULT_MARKETPLACE = "Google"
KEYWORD_LIMIT = 10
PROBABILITY_THRESHOLD = 0.1
DEFAULT_LABEL = -1

#: The record that all stages annotate; classifications maps prompt names to labels.
PRODUCT = (
    "search_term string, search_term_type string, url string, marketplace_name string, domain string, product_name string, product_price string, "
    "product_description string, product_images array<string>, probability double, classifications map<string,int>, filtered boolean, filtered_at_stage string"
)
SEARCH_REPLY = "organic_results array<struct<link:string>>"
SUGGESTED_REPLY = "tasks array<struct<result:array<struct<items:array<struct<keyword:string,keyword_info:struct<search_volume:bigint>>>>>>>"
RELATED_REPLY = "tasks array<struct<result:array<struct<items:array<struct<keyword_data:struct<keyword:string,keyword_info:struct<search_volume:bigint>>>>>>>>"
DETAIL_REPLY = "url string, statusCode string, product struct<name:string,price:string,description:string,mainImage:struct<url:string>,images:array<struct<url:string>>,metadata:struct<probability:string>>"


@dataclass(frozen=True)
class Prompt:
    name: str
    context: str
    system_prompt: str
    allowed_classes: tuple[int, ...]

    def __post_init__(self):
        if any(not isinstance(c, int) or isinstance(c, bool) or c < 0 for c in self.allowed_classes):
            raise ValueError(f"prompt {self.name}: classes have to be whole numbers from 0")


def flagged(df, condition, stage: str):
    """Flags unflagged rows that fulfil condition; the first stage that flags a row keeps it. A null condition does not flag."""
    hit = ~F.col("filtered") & F.coalesce(condition, F.lit(False))
    return df.withColumn("filtered_at_stage", F.when(hit, F.lit(stage)).otherwise(F.col("filtered_at_stage"))).withColumn("filtered", F.col("filtered") | F.coalesce(condition, F.lit(False)))
