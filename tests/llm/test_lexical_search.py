"""Ranked lexical search against a count of whole words and the formula, on texts with odd separators."""

import math
import re
from collections import Counter

from souklens.llm import lexical_search as ls

DOCS = [
    (0, "The river, the stone; THE light"), (1, "river river-river RIVER"), (2, "a_b'c stone\nstone\tÜber über ÜBER"), (3, None), (4, ""), (5, " .,;\n"), (6, "thethe the1 1the 1"), (7, "stone"), (8, "stone"), (None, "stone"),
    (9, " ".join(f"w{i % 977} stone light" for i in range(20_000))), (7, "stone"), (10, "x" * 100_000 + " light"), (11, "é ü 😀   light\x00light"),
]
ITEMS = [(0, "the the light"), (1, "Stone über Über 1 w5"), (2, None), (3, "   "), (4, "absent words"), (5, "river"), (5, "light"), (None, "the stone"), (6, "é ü 😀"), (7, "a b c")]


def words(t):
    return re.findall(ls.TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def expected(docs, items, k=10):
    counts = [Counter(words(t)) for _, t in docs]
    n_docs, total = sum(bool(c) for c in counts), sum(map(lambda c: sum(c.values()), counts))
    df = Counter(t for c in counts for t in c)
    own = {}
    for i, t in items:
        own.setdefault(i, set()).update(words(t))
    out = []
    for i, ts in own.items():
        found = []
        for (d, _), c in zip(docs, counts, strict=True):
            m = 10 + 90 * sum(c.values()) * n_docs // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def tables(spark):
    d = spark.createDataFrame([(*x, "extra", 1) for x in DOCS], "doc_id long, text string, term string, item long")
    return d, spark.createDataFrame([(*x, "extra") for x in ITEMS], "item_id long, text string, doc_id string")


def test_ranked(spark):
    d, i = tables(spark)
    out = ls.ranked(d.repartition(5), i)
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "int", "bigint", "bigint"]
    assert rows(out) == expected(DOCS, ITEMS) and rows(ls.ranked(d.repartition(3), i, k=2)) == expected(DOCS, ITEMS, 2)


def test_several_automata_and_pruning(spark, monkeypatch):
    d, i = tables(spark)
    monkeypatch.setattr(ls, "BLOCK", 8)
    monkeypatch.setattr(ls, "TOGETHER", 2)
    assert rows(ls.ranked(d.coalesce(1), i, k=1)) == expected(DOCS, ITEMS, 1)


def test_best_prunes_without_loss():
    import numpy as np

    r = np.random.default_rng(1)
    best, all_ = ls.Best(3, 4), []
    for b in range(300):
        scores = r.integers(0, 30, (100, 3))
        ids = np.arange(b * 100, b * 100 + 100)
        best.offer(scores.astype(float), ids, np.zeros(100, np.int64))
        all_ += [(i, -int(scores[d, i]), int(ids[d])) for d in range(100) for i in range(3) if scores[d, i] > 0]
    want = [x for i in range(3) for x in sorted(y for y in all_ if y[0] == i)[:4]]
    assert [(a, b, d) for a, b, _, d in best.prune().tolist()] == want


def test_empty(spark):
    d, i = tables(spark)
    for a, b in ((d.limit(0), i), (d, i.limit(0)), (d.where("text is null"), i), (d, i.where("item_id in (2, 3)"))):
        assert ls.ranked(a, b).collect() == []
