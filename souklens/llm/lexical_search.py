"""Ranked lexical search: one automaton of all items' terms is sent to the documents and counts their terms directly in the text.

No index of the documents is made. The texts are scanned twice: once for the statistics (documents that hold each term,
number of documents and of terms), once for the scores, of which each task keeps the best of every item.
"""

from __future__ import annotations

import math

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import Scratch

#: What a term is made of, and the constants of the weights and scores.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Pairs of item and term that one automaton holds; more are scanned for in several rounds. Scores stay exact in doubles up to here.
BLOCK = 200_000
#: Documents that are scored together, and cells of their table of scores.
TOGETHER, CELLS = 256, 4_000_000
#: Places of the statistics of all documents, beside the terms'.
DOCUMENTS, TERMS = -1, -2
#: Bytes to bytes: A-Z to lower case, all that separates terms to a space. Whatever lies beyond ASCII belongs to a term, so UTF-8 needs no decoding.
PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms(text: Column) -> Column:
    """The terms of a text as an array, in order, A-Z in lower case; empty for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


class Matcher:
    """The automaton of a list of terms. Each stands between spaces, so that it is found as a whole term alone; neighbours share the space between them."""

    def __init__(self, words: list[str]):
        self.n, self.automaton = len(words), ahocorasick.Automaton()
        for i, w in enumerate(words):
            self.automaton.add_word(f" {w.encode().decode('latin-1')} ", i)
        self.automaton.make_automaton()

    def count(self, text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
        """The number of terms in a text, the places of those that the automaton holds, and how often each occurs."""
        plain = b" " + (text or "").encode().translate(PLAIN) + b" "
        blank = np.frombuffer(plain, np.uint8) == 0x20
        hits = np.fromiter((i for _, i in self.automaton.iter(plain.decode("latin-1"))), np.int64)
        held, tf = np.unique(hits, return_counts=True)
        return int(np.count_nonzero(blank[:-1] & ~blank[1:])), held, tf


def _statistics(slim: DataFrame, words) -> dict[int, int]:
    """The documents that hold each term, by its place; under DOCUMENTS and TERMS how many documents with terms there are, and how many terms."""

    def work(batches):
        matcher, df, documents, total = Matcher(words.value), None, 0, 0
        df = np.zeros(matcher.n, np.int64)
        for batch in batches:
            for text in batch.column(1).to_pylist():
                n, held, _ = matcher.count(text)
                df[held] += 1
                documents, total = documents + (n > 0), total + n
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*held.tolist(), DOCUMENTS, TERMS], pa.int64()), pa.array([*df[held].tolist(), documents, total], pa.int64())], names=["term", "n"])

    rows = slim.mapInArrow(work, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # bounded by the automaton's terms
    return {r["term"]: r["n"] for r in rows}


class Best:
    """The best k documents of each item so far, by score and then doc_id; a null doc_id comes last."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.kept = np.zeros((0, 4), np.int64)  # item, -score, whether the id is null, id
        self.more, self.size = [], 0

    def offer(self, scores: np.ndarray, ids: np.ndarray, absent: np.ndarray) -> None:
        rows, items = np.nonzero(scores >= self.least)
        self.more.append(np.stack([items, -scores[rows, items].astype(np.int64), absent[rows], ids[rows]], axis=1))
        self.size += len(rows)
        if self.size > 4 * self.k * len(self.least) + 10_000:
            self.prune()

    def prune(self) -> np.ndarray:
        all_ = np.concatenate([self.kept, *self.more])
        all_ = all_[np.lexsort(all_.T[::-1])]
        starts = np.searchsorted(all_[:, 0], np.arange(len(self.least)))
        place = np.arange(len(all_)) - starts[all_[:, 0]]
        self.kept, self.more, self.size = all_[place < self.k], [], 0
        last = all_[place == self.k - 1]
        self.least[last[:, 0]] = -last[:, 1]
        return self.kept


def _best_of_tasks(slim: DataFrame, words, weights: np.ndarray, first: np.ndarray, items: np.ndarray, n_items: int, documents: int, total: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each item in each task. items[first[t]:first[t + 1]] are the items that hold term t."""
    together = max(1, min(TOGETHER, CELLS // n_items))

    def work(batches):
        matcher, best = Matcher(words.value), Best(n_items, k)
        for batch in batches:
            ids = batch.column(0)
            numbers, absent = np.asarray(ids.fill_null(0).to_numpy(zero_copy_only=False), np.int64), np.asarray(ids.is_null().to_numpy(zero_copy_only=False), np.int64)
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), together):
                cells, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for row, text in enumerate(texts[at : at + together]):
                    n, held, tf = matcher.count(text)
                    if len(held):
                        m = 100 - 90 + (90 * n * documents) // total
                        part = weights[held] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
                        size = first[held + 1] - first[held]
                        place = np.arange(size.sum()) + np.repeat(first[held] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
                        cells.append(row * n_items + items[place])
                        parts.append(np.repeat(part, size))
                rows = len(texts[at : at + together])
                scores = np.bincount(np.concatenate(cells), np.concatenate(parts), rows * n_items).reshape(rows, n_items)
                best.offer(scores, numbers[at : at + rows], absent[at : at + rows])
        kept = best.prune()
        yield pa.RecordBatch.from_arrays([pa.array(kept[:, 0]), pa.array(kept[:, 3], mask=kept[:, 2] == 1), pa.array(-kept[:, 1])], names=["item", "doc_id", "score"])

    return slim.mapInArrow(work, "item long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (int, from 1), doc_id (long), score (long): the k documents with the highest scores for each item, of those above 0.

    Terms and scores are those of terms() and of the contract's formula: saturating term frequencies, document length
    against the mean, and the logarithm of a term's rarity, in whole numbers. Equal scores go by doc_id, nulls last.

    Each automaton holds BLOCK pairs of item and term; larger item tables are dealt over several, each of which scans
    the documents anew, so that what is broadcast has a bound. A task keeps k documents for each item of its automaton
    and scores at most CELLS cells at a time; only these k leave it. Whole texts, all documents, nothing else shuffled.

    Nulls: a null text has no terms and is in no result; a null doc_id is a document like others. Rows of items with
    one item_id (null is one, too) are one item with the terms of all; an item without terms, or whose terms are in no
    document, has no rows. Repeated rows of docs are documents of their own. Empty tables give an empty result; other
    columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "terms")
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pairs = scratch.write(items.select(F.col(item_id).alias("item_id"), F.explode(terms(F.col(item_text))).alias("term")).distinct())
    rounds = math.ceil(2 * pairs.count() / BLOCK)
    out = spark.createDataFrame([], pairs.select("item_id").schema.add("rank", "integer").add("doc_id", "long").add("score", "long"))
    for r in range(rounds):
        mine = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == r).groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))
        mine = mine.collect()  # some half of BLOCK pairs
        places: dict[str, int] = {}
        at = np.array([places.setdefault(t, len(places)) for x in mine for t in x["terms"]], np.int64)
        owner = np.repeat(np.arange(len(mine)), [len(x["terms"]) for x in mine])
        if not mine:
            continue
        order = np.argsort(at, kind="stable")
        first = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(places)))])
        words = spark.sparkContext.broadcast(list(places))
        found = _statistics(slim, words)
        documents, total = found.get(DOCUMENTS) or 0, found.get(TERMS) or 0
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * found.get(t, 0) + 1))) for t in range(len(places))], np.int64)
        if not total:
            continue
        best = _best_of_tasks(slim, words, weights, first, owner[order], len(mine), documents, total, k)
        place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        ids = spark.createDataFrame([(i, x["item_id"]) for i, x in enumerate(mine)], pairs.select(F.lit(0).cast("long").alias("item"), "item_id").schema)
        named = best.withColumn("rank", place).where(F.col("rank") <= k).join(F.broadcast(ids), "item")
        out = out.unionByName(named.select("item_id", "rank", "doc_id", "score"))
    return out
