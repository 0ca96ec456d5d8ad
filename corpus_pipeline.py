"""A corpus pipeline: quality rules, near duplicates, personal data, mixture, tokens. Each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souklens.llm import mixing, ngram_jaccard, pii, quality, sentencepiece_codec
from souklens.llm.queries import MODEL, pii_key
from souklens.shared import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule go. A null or empty text breaks the rule on the number of words; repeated rows are judged one by one, other columns stay."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays. Null, empty and blank texts link with nothing and stay; of rows that repeat a doc_id one stays, rows without one all do; other columns stay."""
    return ngram_jaccard.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by pseudonyms and n_chars set to the text's new length. Null and empty texts stay, repeated rows have equal results, other columns stay."""
    out = pii.pseudonymised(docs, pii_key(spark))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns) if "n_chars" in docs.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the tokens, by the weights of domains, languages and sources; one epoch at most. A null or empty language or source makes one leaf; texts without tokens are taken with those around them, equal rows together; other columns stay, an empty table gives an empty one."""
    return mixing.mixed(docs, epoch=None, into_domain=None)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ids, n_tokens and round_trip to the documents. Null and empty texts have no ids; repeated rows have equal ids; columns of these three names are replaced."""
    return sentencepiece_codec.encoded(docs, MODEL)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("PII", personal_data), ("mixing", mixture), ("SentencePiece", tokens)]

#: SQL has no Feistel permutation and no Viterbi search; tests hold the pipeline to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents in turn; each one's rows are written to the shared folder and read again, so that a lost executor costs one stage at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = shared_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
    return docs
