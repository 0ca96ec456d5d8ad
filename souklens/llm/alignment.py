"""Alignment of two tokenizers: which tokens of one overlap which of the other, how often each pair of ids does so in all documents, and which pairs are an id's most frequent.

1. Each text is encoded by both. A task sorts its records (pair of ids, document, number of links) and spills them as
   zstd runs, split by the B id's remainder (radix); the runs are rows of a table in the shared folder.
2. Runs of one radix are dealt into groups of about GROUP records, so that a frequent id fills many groups. Each group
   merges its runs' pairs with a heap, B id by B id, and counts them; the counts of a pair's groups are added up, and the
   largest count of each B id is found.
3. The counts go back to the groups that hold the pair, where each run streams its documents' shares: links of best
   pairs, and the sum of counts. A document's shares are added up.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from ..shared import Scratch

#: Remainders of B ids by which runs are split; records of a run before it is split; records of a group of runs.
RADICES, RUN, GROUP = 16, 1_000_000, 2_000_000
#: Characters of texts that are looked at together, and new segments that are encoded together.
CHUNK, TOGETHER = 2_000_000, 20_000
#: Segments that a task remembers, and their characters; then it starts anew.
REMEMBER, REMEMBER_CHARS = 300_000, 8_000_000
#: A space between characters that are no white space: no token of either tokenizer reaches over it, so segments are encoded on their own.
CUT = re.compile(r" (?=\S)(?<=\S )")
MARK = "▁"

DOCUMENT = ("n_a", "n_b", "n_groups", "n_links")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, all others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Both tokenizers, and a table of segments whose tokens and links are known. Segments are numbered in the order in which they are added."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = Tokenizer.from_str(a_json), SentencePieceProcessor(model_proto=b_model)
        self.a.encode_special_tokens = True
        size, alphabet = self.a.get_vocab_size(), byte_alphabet()
        self.n_a = size
        self.a_bytes = [bytes(map(alphabet.__getitem__, x)) if (x := self.a.id_to_token(i) or "") and set(x) <= alphabet.keys() else (x or "").encode() for i in range(size)]
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(MARK, " ").encode()
        self.b_bytes = [piece(i) for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = np.array([len(x) for x in self.a_bytes]), np.array([len(x) for x in self.b_bytes])
        self.texts = [f"{i}{c}" for i in range(size) for c in ",|"] + [f"{i}{c}" for i in range(len(self.b_bytes)) for c in ",;\n"]
        self.forget()

    def forget(self) -> None:
        self.known, self.chars, self.groups = {}, 0, []
        self.sizes, self.links, self.first = array("q"), array("q"), array("q", [0])  # sizes: DOCUMENT and whether the bytes are right

    def full(self) -> bool:
        return len(self.known) > REMEMBER or self.chars > REMEMBER_CHARS

    def add(self, segments: list[str]) -> None:
        plain = [f" {s}".encode() for s in segments]
        tokens_a = [x.ids for x in self.a.encode_batch_fast([f" {s}" for s in segments], add_special_tokens=False)]
        tokens_b = self.b.encode(segments, num_threads=1)
        n, size = len(segments), np.array([len(x) for x in plain])
        many_a, many_b = (np.array([len(x) for x in ids]) for ids in (tokens_a, tokens_b))
        a, b = (np.fromiter(itertools.chain.from_iterable(ids), np.int64, m.sum()) for ids, m in ((tokens_a, many_a), (tokens_b, many_b)))
        right = self._right(plain, a, many_a, self.a_bytes, self.a_size) & self._right(plain, b, many_b, self.b_bytes, self.b_size)
        a, b = a[np.repeat(right, many_a)], b[np.repeat(right, many_b)]
        counts, links, groups = self._align(a, b, np.cumsum(size[right]))
        sizes = np.zeros((n, 5), np.int64)
        sizes[right] = np.stack([many_a[right], many_b[right], *counts, np.ones(len(groups), np.int64)], axis=1)
        self.known.update(zip(segments, range(len(self.known), len(self.known) + n), strict=True))
        self.chars += sum(map(len, segments))
        rest = iter(groups)
        self.groups += [next(rest) if x else "" for x in right.tolist()]
        self.first.frombytes((len(self.links) + np.cumsum(sizes[:, 3])).tobytes())
        self.links.frombytes(links.tobytes())
        self.sizes.frombytes(sizes.tobytes())

    @staticmethod
    def _right(plain: list[bytes], ids: np.ndarray, many: np.ndarray, texts: list[bytes], size: np.ndarray) -> np.ndarray:
        """Whether each segment's tokens give back its bytes."""
        joined, until = b"".join([texts[i] for i in ids.tolist()]), np.concatenate([[0], np.cumsum(size[ids])])[np.cumsum(many)].tolist()
        return np.array([joined[s:e] == x for s, e, x in zip([0, *until], until, plain)], bool)

    def _align(self, a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, list[str]]:
        """Of segments one behind the other, whose tokens are a and b and which end at these bytes: numbers of groups and links; the links, B id * size of A + A id, one for each stretch between neighbouring token ends; the groups as text."""
        end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        stretch, common = np.union1d(end_a, end_b), np.intersect1d(end_a, end_b, assume_unique=True)
        links = b[np.searchsorted(end_b, stretch)] * self.n_a + a[np.searchsorted(end_a, stretch)]
        counts = [np.bincount(np.searchsorted(ends, x), minlength=len(ends)) for x in (common, stretch)]
        # The text of each token with what follows it: "," within a group, "|" behind its A part, ";" behind its B part, a line's end behind a segment.
        follow_a, follow_b = np.isin(end_a, common).astype(np.int64), np.isin(end_b, common).astype(np.int64) + np.isin(end_b, ends)
        code = np.concatenate([a * 2 + follow_a, 2 * self.n_a + b * 3 + follow_b])
        order = np.argsort(np.concatenate([np.searchsorted(common, end_a) * 2, np.searchsorted(common, end_b) * 2 + 1]), kind="stable")
        return counts, links, "".join([self.texts[c] for c in code[order].tolist()]).split("\n")[:-1]

    def numbers(self, texts: list[str | None]) -> list[list[int]]:
        """The numbers of each text's segments; new ones are added, many at a time."""
        parts = [CUT.split(t) if t else [] for t in texts]
        new = [s for s in dict.fromkeys(itertools.chain.from_iterable(parts)) if s not in self.known]
        for i in range(0, len(new), TOGETHER):
            self.add(new[i : i + TOGETHER])
        return [[self.known[s] for s in p] for p in parts]


class Spill:
    """Records of links (pair, document, count) that become runs once there are many."""

    def __init__(self, n_a: int, radices: int):
        self.n_a, self.radices, self.parts, self.size = n_a, radices, [], 0

    def add(self, pairs: np.ndarray, documents: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((pairs, documents, counts))
        self.size += len(pairs)

    def runs(self) -> Iterator[dict]:
        """What has been added, sorted by pair and document and summed: a run for each radix. head: pairs with their number of documents and of links; tail: documents with their links."""
        if not self.size:
            return
        pairs, documents, counts = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        order = np.lexsort((documents, pairs))
        pairs, documents, counts = pairs[order], documents[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]) | (documents[1:] != documents[:-1])]))
        pairs, documents, counts = pairs[first], documents[first], np.add.reduceat(counts, first)
        radix = pairs // self.n_a % self.radices
        for r in np.unique(radix):
            mine = radix == r
            p, d, c = pairs[mine], documents[mine], counts[mine]
            starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            head = np.stack([p[starts], np.diff(np.append(starts, len(p))), np.add.reduceat(c, starts)])
            yield {"radix": int(r), "records": len(p), "head": _packed(head.astype(np.int64)), "tail": _packed(np.stack([d, c]).astype(np.uint32))}


def _packed(rows: np.ndarray) -> bytes:
    return zstandard.compress(rows.tobytes(), 3)


def _unpacked(data: bytes, rows: int, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind).reshape(rows, -1)


def _spilled(docs: DataFrame, a_path: str, b_path: str, text: str, doc_id: str, radices: int) -> DataFrame:
    """Rows of two kinds: documents (radix is null) and runs. row numbers the documents of all tasks; a run's documents count from `row` of the run."""
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        files = docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, radix int, records long, head binary, tail binary"
    arrow = pa.schema([*[(n, pa.int64()) for n in ("row", "doc_id", *DOCUMENT)], ("groups_sha256", pa.string()), ("radix", pa.int32()), ("records", pa.int64()), ("head", pa.binary()), ("tail", pa.binary())])

    def work(batches):
        encoder, row = Encoder(*files.value), 0
        base, spill = TaskContext.get().partitionId() << 33, Spill(encoder.n_a, radices)
        as_batch = lambda rows: pa.RecordBatch.from_pylist(rows, schema=arrow)
        runs = lambda: (as_batch([{"row": base, **x}]) for x in spill.runs())
        for batch in batches:
            ids, texts, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            while at < len(ids):
                if encoder.full():
                    encoder.forget()
                until, size = at, 0
                while until < len(ids) and size < CHUNK:
                    size, until = size + len(texts[until] or ""), until + 1
                chunk = encoder.numbers(texts[at:until])
                sizes, links, first = np.array(encoder.sizes).reshape(-1, 5), np.array(encoder.links), np.array(encoder.first)
                rows, kept = [], []
                for k, numbers in enumerate(chunk):
                    total = sizes[numbers].sum(axis=0) if numbers else np.zeros(5, np.int64)
                    right = bool(numbers) and total[4] == len(numbers)
                    groups = hashlib.sha256(";".join([encoder.groups[i] for i in numbers]).encode()).hexdigest() if right else ""
                    rows.append({"row": base + row + k, "doc_id": ids[at + k], **dict(zip(DOCUMENT, total.tolist() if right else [0] * 4)), "groups_sha256": groups})
                    kept.append(numbers if right else [])
                lengths = [len(x) for x in kept]
                n = max(1, len(sizes))
                seen, times = np.unique(np.repeat(np.arange(len(kept)), lengths) * n + np.fromiter(itertools.chain.from_iterable(kept), np.int64, sum(lengths)), return_counts=True)
                segment, document = seen % n, seen // n + row
                many = first[segment + 1] - first[segment]
                place = np.arange(many.sum()) + np.repeat(first[segment] - np.concatenate([[0], np.cumsum(many)])[:-1], many)
                spill.add(links[place], np.repeat(document, many), np.repeat(times, many))
                yield as_batch(rows)
                at, row = at + len(chunk), row + len(chunk)
                if spill.size >= RUN:
                    yield from runs()
        yield from runs()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, schema)


def _slices(head: bytes, n_a: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A run's pairs, B id by B id: the id, A ids, numbers of links."""
    pairs, _, links = _unpacked(head, 3, np.int64)
    b, a = pairs // n_a, pairs % n_a
    starts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    for s, e in itertools.pairwise([*starts.tolist(), len(b)]):
        yield int(b[s]), a[s:e], links[s:e]


def _merged(heads: list[bytes], n_a: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The pairs of all runs, merged by a heap in order of B id: the id, its A ids, and the links of each."""
    first = lambda x: x[0]
    for b, parts in itertools.groupby(heapq.merge(*[_slices(h, n_a) for h in heads], key=first), key=first):
        _, a, links = zip(*parts, strict=True)
        ids, at = np.unique(np.concatenate(a), return_inverse=True)
        yield b, ids, np.bincount(at, np.concatenate(links)).astype(np.int64)


def _counted(docs: DataFrame, a_path: str, b_path: str, text: str, doc_id: str, radices: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, int]:
    """Documents, runs with their groups, the counts of each group, the counts of all with whether they are the B id's highest, and A's size."""
    n_a = Tokenizer.from_file(a_path).get_vocab_size()
    spilled = scratch.write(_spilled(docs, a_path, b_path, text, doc_id, radices))
    runs = spilled.where("radix is not null")
    groups = runs.groupBy("radix").agg(F.greatest(F.ceil(F.sum("records") / GROUP), F.lit(1)).alias("groups"))  # a row for each radix
    runs = runs.join(F.broadcast(groups), "radix").select("row", "radix", F.pmod(F.xxhash64("row", "head"), "groups").alias("part"), "head", "tail")

    def count(key, rows):
        heads = [x.as_py() for x in rows["head"]]
        found = list(_merged(heads, n_a))
        names, sizes = ["radix", "part", "b", "a", "n"], [len(ids) for _, ids, _ in found]
        n = sum(sizes)
        return pa.table([pa.array([key[0].as_py()] * n, pa.int32()), pa.array([key[1].as_py()] * n, pa.int64()), pa.array(np.repeat([b for b, _, _ in found], sizes)), pa.array(np.concatenate([x for _, x, _ in found])), pa.array(np.concatenate([x for _, _, x in found]))], names=names)

    parts = scratch.write(runs.select("radix", "part", "head").groupBy("radix", "part").applyInArrow(count, "radix int, part long, b long, a long, n long"))
    counts = parts.groupBy("b", "a").agg(F.sum("n").alias("total"))
    most = counts.groupBy("b").agg(F.max("total").alias("most"))  # a row for each B id, so no more than B's vocabulary
    return spilled.where("radix is null"), runs, parts, scratch.write(counts.join(F.broadcast(most), "b").select("b", "a", "total", (F.col("total") == F.col("most")).alias("best"))), n_a


def pair_counts(docs: DataFrame, a_path: str, b_path: str, text: str = "text", doc_id: str = "doc_id", radices: int = RADICES) -> DataFrame:
    """a, b, total, best: how often tokens of each pair of ids overlap in all documents, and whether no other A id does so more often with this B id. As aligned()."""
    return _counted(docs, a_path, b_path, text, doc_id, radices, Scratch(docs.sparkSession, "alignment"))[3].select("a", "b", "total", "best")


def aligned(docs: DataFrame, a_path: str, b_path: str, text: str = "text", doc_id: str = "doc_id", radices: int = RADICES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum (long), groups_sha256 for each row of docs, whose texts are encoded by A (a byte-level BPE in a tokenizer file) and B (a SentencePiece BPE model).

    A encodes a space and the text, B the text, to which it adds the space; special tokens are neither added nor seen in
    texts. Groups end where tokens of both end. A link is a token of A and one of B that share bytes. n_best: links whose
    pair is as frequent in all documents as any other of its B id; count_sum: the frequencies of all links' pairs.

    Whole texts and all documents. Null and empty texts, and those whose tokens don't give back the text's bytes, have
    zeros and an empty groups_sha256, and count nowhere. Repeated rows are documents of their own, whatever their doc_id
    (null is allowed). An empty table gives an empty one; other columns are not read.

    A task holds a table of REMEMBER segments and RUN records; a group holds about GROUP records. Of B's ids, no more
    than `radices`-th parts of the vocabulary share a run; take more of them for larger corpora, as each group then holds
    fewer pairs. Runs are rows of a table, so a lost executor costs no more than the step that reads them.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    documents, runs, parts, counts, n_a = _counted(docs, a_path, b_path, text, doc_id, radices, scratch)
    back = parts.select("radix", "part", "b", "a").join(counts, ["b", "a"])

    def share(key, runs, counts):
        order = np.argsort(code := np.asarray(counts["b"]) * n_a + np.asarray(counts["a"]))
        code, total, best = code[order], np.asarray(counts["total"])[order], np.asarray(counts["best"].combine_chunks().cast(pa.int64()))[order]
        out = []
        for base, head, tail in zip(*[runs[c].to_pylist() for c in ("row", "head", "tail")], strict=True):
            pairs, sizes, _ = _unpacked(head, 3, np.int64)
            document, links = _unpacked(tail, 2, np.uint32).astype(np.int64)
            at = np.repeat(np.searchsorted(code, pairs), sizes)
            order = np.argsort(document, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(document[order]) > 0]))
            out.append(pa.table([pa.array(base + document[order][first]), *[pa.array(np.add.reduceat((x[at] * links)[order], first)) for x in (best, total)]], names=["row", "n_best", "count_sum"]))
        return pa.concat_tables(out)

    shares = runs.groupBy("radix", "part").cogroup(back.groupBy("radix", "part")).applyInArrow(share, "row long, n_best long, count_sum long")
    sums = shares.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    sum_of = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return documents.join(sums, "row", "left").select("doc_id", *DOCUMENT, sum_of("n_best"), sum_of("count_sum"), "groups_sha256")
