"""Exact top-k search against all pairs in whole numbers: clustered vectors, copies, ties, odd values and many small tiles."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from souklens.llm import vector_search as vs

SCHEMA = "vec_id long, embedding array<float>, place string, tile int"


def some_vectors(n=700, dim=12, seed=5):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(9)]
    out = []
    for i in range(n):
        v = [c + r.gauss(0, 0.2) for c in r.choice(centres)] if i % 3 else [r.gauss(0, 1) * 10 ** r.randrange(-2, 3) for _ in range(dim)]
        out.append((i, v))
    out += [(n + i, list(out[7][1])) for i in range(150)]  # a large group of copies
    out += [(2000 + i, [float(i % 3)] * dim) for i in range(60)]  # ties
    odd = [None, [], [], [None] + [1.0] * 11, [math.nan] * 12, [math.inf] * 12, [0.0] * 12, [1.0], [2.0], [-3.0, 4.0], [3e38] * 12, [-3e38] * 12]
    out += [(3000 + 50 * i, v) for i, v in enumerate(odd)] + [out[50], out[50], (None, out[3][1]), (None, out[50][1])]
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in out]


def expected(rows, every=50, k=5):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, v) in enumerate(whole):
        if q is not None and q % every == 0:
            found = [(-max(1 - 2**63, min(2**63 - 1, sum(x * y for x, y in zip(v, w, strict=True)))), c is None, c or 0, c) for b, (c, w) in enumerate(whole) if a != b and len(v) == len(w)]
            out += [(q, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*x, "extra", 1) for x in rows], SCHEMA)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(("tile", "block"), [(4096, 2048), (64, 3)])
def test_all_pairs(spark, monkeypatch, tile, block):
    monkeypatch.setattr(vs, "TILE", tile)
    monkeypatch.setattr(vs, "BLOCK", block)
    rows = some_vectors()
    assert found(vs.searched(frame(spark, rows).repartition(3), F.col("vec_id") % 50 == 0)) == expected(rows)


def test_bounds_leave_out_without_loss():
    r = np.random.default_rng(2)
    centres = np.repeat(r.normal(0, 400, (20, 8)), 8, axis=1)  # smooth vectors: few segments say much
    x = np.floor(centres[r.integers(0, 20, 3000)] + r.normal(0, 20, (3000, 64)))
    q, all_ = x[:50], x[:50] @ x.T
    least = np.sort(all_, axis=1)[:, -5]
    i, j = vs.survivors(q, x, least)
    kept = np.zeros(all_.shape, bool)
    kept[i, j] = True
    assert kept[all_ >= least[:, None]].all() and kept.mean() < 0.2
    assert (vs.scores(q, x, i, j) == all_[i, j]).all()


def test_few_and_empty(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (50, [-0.001, 0.5])]
    assert found(vs.searched(frame(spark, rows), F.col("vec_id") % 50 == 0)) == expected(rows)
    assert vs.searched(frame(spark, []), F.col("vec_id") % 50 == 0).collect() == []
    assert vs.searched(frame(spark, rows[:1]), F.col("vec_id") % 50 == 0).collect() == []
    assert vs.searched(frame(spark, rows[1:2]), F.col("vec_id") % 50 == 0).collect() == []
