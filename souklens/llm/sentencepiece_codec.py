"""SentencePiece encoding and decoding: distinct marked words in order, as a trie walked depth first; words share the forward scores of their common prefix."""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .unigram import MARK, Vocabulary

#: Distinct segments that a task remembers, and pieces in them.
REMEMBER, PIECES = 300_000, 2_000_000
#: Segments that are looked up at a time, bytes of text that make up a slice, and ids that are decoded at a time.
SEGMENTS, SLICE, IDS = 65_536, 1 << 20, 1 << 18


def shared_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while a[low] == b[low]:
        low += 1
    return low


def backward_trie(v: Vocabulary) -> dict:
    """The pieces from their last character to their first. A node is [next nodes by character, id, score] of the piece that ends here; its id is -1 if none does."""
    root: dict = {}
    for piece, (i, score) in v.pieces.items():
        nodes = root
        for c in reversed(piece):
            node = nodes.setdefault(c, [{}, -1, 0.0])
            nodes = node[0]
        node[1:] = i, score
    return root


class Chunks(dict):
    """The bytes of each id; none for ids that aren't there."""

    def __missing__(self, i: int | None) -> bytes:
        return b""


def best_paths(words: Iterable[str], v: Vocabulary, trie: dict | None = None) -> Iterator[tuple[str, list[int]]]:
    """Each distinct word with the ids of its best path, in the order of the words.

    Sorted words are the leaves of a trie in depth-first order; the stacks of forward scores and last pieces are cut
    back to the prefix shared with the word before and only go on from there. Ties as in token_count.Counter: pieces
    that end at a place are met from the shortest to the longest, so of equal scores the last met stays.
    """
    trie = backward_trie(v) if trie is None else trie
    unknown = v.unknown_score
    score, start, piece = array("d", [0.0]), array("i", [0]), array("i", [-1])
    before = ""
    for word in sorted(set(words)):
        at = shared_prefix(before, word)
        del score[at + 1 :], start[at + 1 :], piece[at + 1 :]
        for end in range(at + 1, len(word) + 1):
            begin = end - 1
            node = trie.get(word[begin])
            top, origin, best = (score[begin] + unknown if node is None or node[1] < 0 else float("-inf")), begin, -1
            while node is not None:
                nodes, i, gain = node
                if i >= 0 and (value := score[begin] + gain) >= top:
                    top, origin, best = value, begin, i
                if not nodes or not begin:
                    break
                begin -= 1
                node = nodes.get(word[begin])
            score.append(top)
            start.append(origin)
            piece.append(best)
        path, end = [], len(word)
        while end:
            path.append(v.unknown_ids(word[end - 1]) if piece[end] < 0 else [piece[end]])
            end = start[end]
        yield word, [i for ids in reversed(path) for i in ids]
        before = word


class Codec:
    """Encodes texts by a table of the segments met so far, which is bounded: beyond REMEMBER segments or PIECES pieces it starts anew."""

    def __init__(self, v: Vocabulary):
        self.v, self.trie = v, backward_trie(v)
        self._clear()
        self.chunks = Chunks({i: p.replace(MARK, " ").encode("utf-8", "surrogatepass") for i, p in v.by_id.items()} | {i: bytes([b]) for b, i in enumerate(v.byte_ids)})

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.ends = array("i"), array("i", [0])

    def _ids(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all segments one after the other, and how many each has."""
        if len(self.index) > REMEMBER or len(self.flat) > PIECES:
            self._clear()
        for s, ids in best_paths(set(segments).difference(self.index), self.v, self.trie):
            self.index[s] = len(self.ends) - 1
            self.flat.extend(ids)
            self.ends.append(len(self.flat))
        rows = np.fromiter(map(self.index.__getitem__, segments), np.int32, len(segments))
        flat, ends = np.frombuffer(self.flat, np.int32), np.frombuffer(self.ends, np.int32)
        first, n = ends[rows], ends[rows + 1] - ends[rows]
        places = np.repeat(first - (np.cumsum(n, dtype=np.int32) - n), n) + np.arange(n.sum(), dtype=np.int32)
        return flat[places] if len(places) else np.empty(0, np.int32), n

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has. SEGMENTS segments and a block's are looked at together at most, whatever the texts' lengths."""
        parts, per_text = [np.empty(0, np.int32)], np.zeros(len(texts), np.int64)
        segments, owners = [], []  # owners: (text, how many segments)

        def flush() -> None:
            ids, n = self._ids(segments)
            parts.append(ids)
            first = np.cumsum([0, *(k for _, k in owners)])[:-1]
            np.add.at(per_text, [t for t, _ in owners], np.add.reduceat(n, first))
            segments.clear()
            owners.clear()

        for t, text in enumerate(texts):
            for more in self.v.segment_lists(text):
                segments += more
                owners.append((t, len(more)))
                if len(segments) >= SEGMENTS:
                    flush()
        if segments:
            flush()
        return np.concatenate(parts), per_text

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """Bytes become characters again (what isn't UTF-8 becomes U+FFFD), marks spaces; the space in front goes. Null and unknown ids stand for nothing."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) and len(ids) <= IDS else ids
        text = b"".join([b"".join(map(self.chunks.__getitem__, ids[i : i + IDS].tolist() if isinstance(ids, np.ndarray) else ids[i : i + IDS])) for i in range(0, len(ids), IDS)]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in parts of some `most` bytes of text, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def encoded(docs: DataFrame, model: str | Vocabulary, text: str = "text", ids: str = "ids", n: str = "n_tokens", exact: str = "round_trip", keep_text: bool = True) -> DataFrame:
    """docs with the ids of each whole text (array of int), their number, and whether decoding gives the text back.

    A null text has null ids, 0 tokens and a null round trip; an empty one no ids and true. A text with U+2581 in it
    does not come back, as in the library: the mark stands for a space. Other columns pass through, those with the three
    new names are replaced; with keep_text=False the text stays behind. Repeated rows stay, an empty table gives an empty
    one. No shuffle; a task holds a slice of some SLICE bytes of text, or one longer text.
    """
    own = [c for c in docs.columns if c not in (ids, n, exact) and (keep_text or c != text)]
    shared = docs.sparkSession.sparkContext.broadcast(model if isinstance(model, Vocabulary) else Vocabulary.load(model))
    schema = docs.select(*own).schema.add(ids, T.ArrayType(T.IntegerType())).add(n, "long").add(exact, "boolean")

    def work(batches):
        codec = Codec(shared.value)
        for whole in batches:
            for batch in slices(whole, len(own)):
                texts = batch.column(len(own)).to_pylist()
                flat, sizes = codec.encode(texts)
                ends = np.cumsum(sizes)
                nulls = np.array([x is None for x in texts], bool)
                same = [None if x is None else codec.decode(flat[e - s : e]) == x for x, s, e in zip(texts, sizes, ends, strict=True)]
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=np.append(nulls, False))
                lists = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*[batch.column(j) for j in range(len(own))], lists, pa.array(sizes, pa.int64()), pa.array(same, pa.bool_())], names=[*own, ids, n, exact])

    return docs.select(*own, F.col(text).alias("__text")).mapInArrow(work, schema)


def decoded(docs: DataFrame, model: str | Vocabulary, ids: str = "ids", into: str = "text") -> DataFrame:
    """docs with the text that `ids` stand for; null for null ids, "" for none.

    Null ids within an array and ids that the vocabulary doesn't have stand for nothing. Rows, their order and repeated
    ones stay; other columns pass through, one called `into` is replaced. No shuffle.
    """
    own = [c for c in docs.columns if c != into]
    shared = docs.sparkSession.sparkContext.broadcast(model if isinstance(model, Vocabulary) else Vocabulary.load(model))
    schema = docs.select(*own).schema.add(into, "string")

    def work(batches):
        codec = Codec(shared.value)
        for batch in batches:
            texts = [None if x is None else codec.decode(x) for x in (y.as_py() for y in batch.column(len(own)))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(own))], pa.array(texts, pa.string())], names=[*own, into])

    return docs.select(*own, F.col(ids).alias("__ids")).mapInArrow(work, schema)
