"""Alignment of two tokenizers against whole texts encoded at once and all pairs of tokens compared by their bytes."""

import hashlib
import random
from collections import Counter

import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from souklens.llm import alignment
from souklens.llm.queries import BYTE_BPE, MODEL

WORDS = "the of and river Stone lighthouse Übermut ñandú don't 12345 3.14 (x) naïveté 東京都 😀 internationalization <|endoftext|> <s> a b x\ty é́ 　".split(" ")
ODD = [None, "", " ", "  two  spaces ", " lead", "trail ", "a▁b", "▁", "line\n\nbreak \n x", "tab\t\tend", "<0x41> <unk>", "x" * 3000, "\x00nul \x1f x", "'s 's'll", "a  b c   d", "日本語 テキスト", "  x  y", "﷽ ａｂｃ ﬁ"]


def some_docs(n=60, seed=4):
    r = random.Random(seed)
    texts = [" ".join(r.choice(WORDS) for _ in range(r.randrange(1, 60))) for _ in range(n)]
    return [(i, t) for i, t in enumerate([*texts, *ODD])] + [(0, texts[0]), (None, texts[1]), (200, " ".join(f"w{i} tower" for i in range(4000)))]


def expected(rows):
    a, b = Tokenizer.from_file(BYTE_BPE), SentencePieceProcessor(model_file=MODEL)
    a.encode_special_tokens = True
    byte = alignment.byte_alphabet()
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    done, counts = [], Counter()
    for d, t in rows:
        ids_a, ids_b = a.encode(" " + (t or ""), add_special_tokens=False).ids, b.encode(t or "")
        bytes_a, bytes_b = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a], [b_bytes(i) for i in ids_b]
        if not t or b"".join(bytes_a) != (" " + t).encode() or b"".join(bytes_b) != (" " + t).encode():
            done.append((d, None, None))
            continue
        spans = []
        for ids, parts in ((ids_a, bytes_a), (ids_b, bytes_b)):
            at, own = 0, []
            for i, x in zip(ids, parts, strict=True):
                own.append((at, at + len(x), i))
                at += len(x)
            spans.append(own)
        links = [(x[2], y[2]) for x in spans[0] for y in near(spans[1], x) if x[0] < y[1] and y[0] < x[1]]
        ends = sorted({x[1] for x in spans[0]} & {x[1] for x in spans[1]})
        groups = ";".join("|".join(",".join(str(i) for s, e, i in own if lo <= s and e <= hi) for own in spans) for lo, hi in zip([0, *ends], ends)) if len(t) < 20_000 else None
        counts.update(links)
        done.append((d, links, (len(ids_a), len(ids_b), len(ends), groups)))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for d, links, rest in done:
        if links is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
        else:
            *sizes, groups = rest
            out.append((d, *sizes, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), groups and hashlib.sha256(groups.encode()).hexdigest()))
    return out, counts


def near(spans, x):
    """Those of spans that may overlap x: by bisection of their ends, then up to the first that starts behind x."""
    lo, hi = 0, len(spans)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if spans[mid][1] <= x[0] else (lo, mid)
    while lo < len(spans) and spans[lo][0] < x[1]:
        yield spans[lo]
        lo += 1


@pytest.mark.parametrize("small", [False, True])
def test_all_documents(spark, monkeypatch, small):
    if small:  # many runs, groups and tables of segments
        for name, value in (("RUN", 50), ("GROUP", 200), ("CHUNK", 300), ("REMEMBER", 20)):
            monkeypatch.setattr(alignment, name, value)
    rows = some_docs()
    docs = spark.createDataFrame([(*x, "extra", 1) for x in rows], "doc_id long, text string, head string, part int")
    got = sorted(map(tuple, alignment.aligned(docs.repartition(3), BYTE_BPE, MODEL, radices=5).collect()), key=str)
    want, counts = expected(rows)
    blank = lambda r: (*r[:7], None) if r[0] == 200 else r
    assert [blank(x) for x in got] == sorted(want, key=str)
    pairs = alignment.pair_counts(docs, BYTE_BPE, MODEL).collect()
    assert {(x["a"], x["b"]): x["total"] for x in pairs} == dict(counts)
    assert {x["b"] for x in pairs if x["best"]} == {y for _, y in counts}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.aligned(docs, BYTE_BPE, MODEL).collect() == []
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, alignment.aligned(only, BYTE_BPE, MODEL).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
