"""Token counts: Aho-Corasick finds all pieces of a unigram vocabulary in a segment; dynamic programming carries the best score and its number of pieces."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .unigram import Vocabulary

#: Segments whose counts a task remembers; then it starts anew.
REMEMBER = 400_000


class Counter:
    """Counts pieces without keeping paths.

    Ties follow the tokenizer: paths are extended from left to right and replaced only by a strictly better score, so
    of equal scores the one whose last piece starts first stays. A character that is no piece by itself counts as
    unknown, at the lowest score less a penalty; with byte pieces it becomes as many pieces as it has UTF-8 bytes.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.seen = vocabulary, {}
        self.automaton = ahocorasick.Automaton()
        for piece, (_, score) in vocabulary.pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.ready = bool(vocabulary.pieces)
        if self.ready:
            self.automaton.make_automaton()

    def segment(self, text: str) -> int:
        v, n = self.vocabulary, len(text)
        single = [c in v.pieces for c in text]
        best, count = [0.0] + [None] * n, [0] * (n + 1)
        hits = self.automaton.iter(text) if self.ready else iter(())
        hit = next(hits, None)
        for end in range(1, n + 1):
            top = None
            while hit is not None and hit[0] < end:  # the longest first: the start moves from left to right
                size, score = hit[1]
                value = best[end - size] + score
                if top is None or value > top:
                    top, count[end] = value, count[end - size] + 1
                hit = next(hits, None)
            if not single[end - 1]:
                value = best[end - 1] + v.unknown_score
                if top is None or value > top:
                    top, count[end] = value, count[end - 1] + len(v.unknown_ids(text[end - 1]))
            best[end] = top
        return count[n]

    def text(self, text: str) -> int:
        seen, total = self.seen, 0
        for x in self.vocabulary.segments(text):
            n = seen.get(x)
            if n is None:
                if len(seen) >= REMEMBER:
                    seen.clear()
                n = seen[x] = self.segment(x)
            total += n
        return total


def counted(docs: DataFrame, model: str | Vocabulary, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """docs with a long column `into`: the pieces of each whole text; 0 for null and empty texts.

    All other columns pass through, one called `into` is replaced. One pass, no shuffle; the vocabulary is broadcast,
    its size bounded by MAX_PIECES. Without byte pieces each unknown character counts as one piece.
    """
    own = [c for c in docs.columns if c != into]
    shared = docs.sparkSession.sparkContext.broadcast(model if isinstance(model, Vocabulary) else Vocabulary.load(model))
    schema = docs.select(*own).schema.add(into, "long")

    def work(batches):
        counter = Counter(shared.value)
        for batch in batches:
            counts = [counter.text(x) if x else 0 for x in batch.column(len(own)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(own))], pa.array(counts, pa.int64())], names=[*own, into])

    return docs.select(*own, F.col(text).alias("__text")).mapInArrow(work, schema)


def counts_only(docs: DataFrame, model: str | Vocabulary, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and n_tokens of every row; the text itself goes to the workers but not back.

    Null and empty texts have 0 tokens, a null doc_id stays null, repeated rows have a row each, an empty table gives an
    empty one. Other columns are not read, whatever their names; very long texts are counted whole, segment by segment.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model if isinstance(model, Vocabulary) else Vocabulary.load(model))
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = slim.select("doc_id").schema.add("n_tokens", "long")

    def work(batches):
        counter = Counter(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([counter.text(x) if x else 0 for x in batch.column(1).to_pylist()], pa.int64())], names=["doc_id", "n_tokens"])

    return slim.mapInArrow(work, schema)
