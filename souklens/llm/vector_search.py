"""Exact top-k search by inner product: statistics of segments bound every score from above, coarse to fine; what survives is computed exactly.

Of two vectors cut into the same segments, a segment of w components adds w * (product of its means) to the inner
product, and w * (product of its deviations) at most. With the norms that is the lower bound of their distance; the
bound of the score itself leaves the norms out. Finer segments give closer bounds.

1. Vectors are ordered by norm and means of their segments and cut into tiles; queries, in the same order, into blocks.
2. Each query is searched in its own tile. Its k-th score there is the least that any other candidate needs.
3. Pairs of block and tile stay if the extremes of their statistics allow such a score for any of their members.
4. In each pair that stays, the bounds of single pairs are worked out from one segment to many, for survivors only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import Scratch
from .common import small

#: Rows of a tile and of a block of queries; a task holds one of each.
TILE, BLOCK = 4096, 2048
#: Segments of a vector, from coarse to fine, and then half as many as it has components. The extremes of tiles are of ENVELOPE segments.
SEGMENTS, ENVELOPE = (1, 4, 16), 16
#: Cells of a table of bounds, and pairs whose vectors are gathered at one time.
CELLS, PAIRS = 4_000_000, 50_000
#: Up to this share of survivors single pairs are computed, above it whole tables.
FEW = 0.125
#: What rounding may do to a bound, as a share of the product of the norms.
SLACK = 1e-9
#: Inner products of whole numbers below it are exact in doubles.
EXACT = 2.0**53

ROWS = "dim int, tile long, query long, query_id long, vec_id long, place long, score long"
EXTREMES = "low array<double>, high array<double>, spread array<double>"


def statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of each row's segments, both times the root of the segment's length: products need no weights."""
    parts = np.array_split(x, segments, axis=1)
    root = np.sqrt([p.shape[1] for p in parts])
    with np.errstate(over="ignore", invalid="ignore"):
        return np.stack([p.mean(1) for p in parts], 1) * root, np.stack([p.std(1) for p in parts], 1) * root


def levels(dim: int) -> list[int]:
    return sorted({s for s in (*SEGMENTS, dim // 2) if 0 < s < dim})


def survivors(q: np.ndarray, x: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs whose score may be `least` or more, row by row of q: bounds by ever more segments, each for what the one before left."""
    with np.errstate(over="ignore", invalid="ignore"):
        slack = SLACK * np.linalg.norm(q, axis=1) * np.max(np.linalg.norm(x, axis=1), initial=0)
        need = least - slack
        alive, pairs = np.ones((len(q), len(x)), bool), None
        for s in levels(q.shape[1]):
            of_q, of_x = np.hstack(statistics(q, s)), np.hstack(statistics(x, s))
            if pairs is None and np.count_nonzero(alive) > FEW * alive.size:
                alive &= ~(of_q @ of_x.T < need[:, None])  # what is no number stays
            else:
                i, j = pairs if pairs is not None else np.nonzero(alive)
                keep = ~(_products(of_q, of_x, i, j) < need[i])
                pairs = i[keep], j[keep]
    return pairs if pairs is not None else np.nonzero(alive)


def _products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", a[i[s : s + PAIRS]], b[j[s : s + PAIRS]]) for s in range(0, len(i), PAIRS)]])


def scores(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The inner products of pairs of rows of whole numbers, as longs; what is beyond a long is held at its end."""
    with np.errstate(over="ignore"):
        most = np.max(np.linalg.norm(q, axis=1), initial=0) * np.max(np.linalg.norm(x, axis=1), initial=0)
    if most < EXACT:
        return ((q @ x.T)[i, j] if len(i) > FEW * len(q) * len(x) else _products(q, x, i, j)).astype(np.int64)
    whole = [[int(v) for v in row] for row in q], [[int(v) for v in row] for row in x]
    return np.array([max(1 - 2**63, min(2**63 - 1, sum(map(int.__mul__, whole[0][a], whole[1][b])))) for a, b in zip(i, j, strict=True)], np.int64)


class Part:
    """The rows of a tile or block: ids, whether they are null, places and vectors."""

    def __init__(self, rows: pa.Table):
        ids = rows["vec_id"].combine_chunks()
        self.absent, self.ids = np.asarray(ids.is_null()), np.asarray(ids.fill_null(0))
        self.places, self.tiles, self.n = np.asarray(rows["place"]), np.asarray(rows["tile"]), len(rows)
        flat = rows["v"].combine_chunks().flatten()
        self.v = np.asarray(flat, float).reshape(self.n, len(flat) // max(1, self.n))

    def take(self, keep: np.ndarray) -> Part:
        out = object.__new__(Part)
        out.absent, out.ids, out.places, out.tiles, out.v = (x[keep] for x in (self.absent, self.ids, self.places, self.tiles, self.v))
        out.n = len(out.ids)
        return out

    def extremes(self) -> tuple[list, list, list]:
        means, deviations = statistics(self.v, min(ENVELOPE, self.v.shape[1])) if self.v.shape[1] else (np.zeros((self.n, 0)),) * 2
        return means.min(0).tolist(), means.max(0).tolist(), deviations.max(0).tolist()


def best(queries: Part, own: Part, least: np.ndarray, k: int, elsewhere: bool) -> Iterator[dict]:
    """The k best rows of `own` for each query, of those with `least` or more: by score, then id (nulls last), then place. elsewhere: queries of that tile are left out."""
    step = max(1, CELLS // max(1, own.n))
    for at in range(0, queries.n, step):
        q, need = queries.take(np.arange(at, min(at + step, queries.n))), least[at : at + step]
        i, j = survivors(q.v, own.v, need)
        other = q.tiles[i] != own.tiles[j] if elsewhere else q.places[i] != own.places[j]
        i, j = i[other], j[other]
        score = scores(q.v, own.v, i, j)
        i, j, score = (x[score >= need[i]] for x in (i, j, score))
        order = np.lexsort((own.places[j], own.ids[j], own.absent[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        i, j, score = i[first], j[first], score[first]
        yield {
            "query": pa.array(q.places[i]), "query_id": pa.array(q.ids[i], mask=q.absent[i]), "vec_id": pa.array(own.ids[j], mask=own.absent[j]), "place": pa.array(own.places[j]), "score": pa.array(score),
        }


def _order_key(v: np.ndarray) -> np.ndarray:
    """Norms by fifths of a power of two, then the means of four segments by turns, bit by bit: rows that are near in it tend to be near."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        norm = np.linalg.norm(v, axis=1)
        share = np.nan_to_num(statistics(v, min(4, v.shape[1]))[0] / norm[:, None]) if v.shape[1] else np.zeros((len(v), 0))
        high = np.clip(np.nan_to_num(np.log2(norm) * 5, posinf=6000, neginf=-6000), -6000, 6000).astype(np.int64) + 6000
    cells, key = np.clip((share + 1) * 128, 0, 255).astype(np.int64), np.zeros(len(v), np.int64)
    for bit in range(7, -1, -1):
        for c in range(cells.shape[1]):
            key = key * 2 + (cells[:, c] >> bit & 1)
    return (high << 32) + key


def _whole(batches, scale: float):
    """Adds dim, the order key and the vector of whole numbers; vectors that are beyond doubles once scaled are left out."""
    for batch in batches:
        of = batch.column("vector")
        sizes, flat, starts = np.asarray(pc.list_value_length(of)), np.asarray(of.flatten(), float), np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(of)))])
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            with np.errstate(over="ignore"):
                v = np.floor(scale * flat[starts[at][:, None] + np.arange(dim)])
            fit = np.isfinite(v).all(axis=1)
            at, v = at[fit], v[fit]
            kept = batch.take(pa.array(at))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * dim, pa.int32()), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([kept.column("vec_id"), kept.column("is_query"), pa.array(np.full(len(at), dim), pa.int32()), pa.array(_order_key(v)), lists], names=["vec_id", "is_query", "dim", "key", "v"])


def _numbered(rows: DataFrame, size: int, into: str, scratch: Scratch, place: str) -> DataFrame:
    """rows, written in their order, with `place` and `into`: every `size` rows have one number. What precedes each partition is a table of one row for each."""
    part = F.shiftright(place, 33)
    stored = scratch.write(rows.withColumn(place, F.monotonically_increasing_id()))
    counts = stored.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    offsets = F.broadcast(counts.select("part", before.alias("before")))
    return stored.join(offsets, part == F.col("part")).withColumn(into, F.floor((F.col("before") + F.col(place).bitwiseAND(2**33 - 1)) / size)).drop("part", "before")


def _bound(q: str, x: str) -> Column:
    """The most that a pair of members can score, by the extremes of both."""
    a, b = F.col(q), F.col(x)
    corners = lambda i: F.greatest(*[F.get(a[s], i) * F.get(b[t], i) for s in ("low", "high") for t in ("low", "high")]) + F.get(a["spread"], i) * F.get(b["spread"], i)
    return F.aggregate(F.filter(F.sequence(F.lit(0), F.size(a["low"])), lambda i: i < F.size(a["low"])), F.lit(0.0), lambda acc, i: acc + corners(i))


def searched(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score (long): for each row that is_query says the k other rows with the highest inner products.

    Components become floor(scale * x) first, so scores are whole numbers and exact (beyond a long they are held at its
    end). Equal scores go by vec_id, nulls last. All rows are candidates, also for rows of the same id: only the
    query's own row is left out. Rows with equal ids are rows of their own; each of several queries with one id has its
    ranks. Fewer than k others: all of them.

    Vectors that are null, hold nulls or what is not finite (also once scaled) take no part; vectors of different
    lengths never meet; empty ones score 0. An empty table gives an empty result. Other columns are not read.

    Tiles and blocks have TILE and BLOCK rows at most, whatever their values, so that equal vectors fill many of them; a
    task holds one of each. In the worst case, when no bound excludes any pair of block and tile, every block meets every tile.
    """
    scratch = Scratch(vectors.sparkSession, "search")
    usable = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    slim = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where(usable)
    whole = slim.mapInArrow(lambda batches: _whole(batches, scale), "vec_id long, is_query boolean, dim int, key long, v array<double>")
    order = ["dim", "key", "vec_id"]
    tiled = _numbered(whole.repartitionByRange(*order).sortWithinPartitions(*order), TILE, "tile", scratch, "place").drop("key")

    def within(key, rows):
        part, extremes = Part(rows), pa.struct([(n, pa.list_(pa.float64())) for n in ("low", "high", "spread")])
        names = ["dim", "tile", "query", "query_id", "vec_id", "place", "score", "extremes"]
        nothing = [pa.nulls(1, pa.int64())] * 5
        dim, tile = key[0].as_py(), key[1].as_py()
        yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([tile], pa.int64()), *nothing, pa.array([dict(zip(("low", "high", "spread"), part.extremes(), strict=True))], extremes)], names=names)
        queries = part.take(np.asarray(rows["is_query"]))
        for found in best(queries, part, np.full(queries.n, -np.inf), k, elsewhere=False):
            n = len(found["query"])
            yield pa.RecordBatch.from_arrays([pa.array([dim] * n, pa.int32()), pa.array([tile] * n, pa.int64()), *found.values(), pa.nulls(n, extremes)], names=names)

    near = scratch.write(tiled.groupBy("dim", "tile").applyInArrow(lambda key, rows: pa.Table.from_batches(list(within(key, rows))), f"{ROWS}, extremes struct<low:array<double>,high:array<double>,spread:array<double>>"))
    tiles = near.where("extremes is not null").select("dim", "tile", F.col("extremes").alias("of_tile"))
    near = near.where("extremes is null").select("query", "query_id", "vec_id", "place", "score")
    least = near.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    asked = tiled.where("is_query").join(least, F.col("place") == F.col("query"), "left").select("dim", "tile", "vec_id", "place", "v", "least")
    blocked = scratch.write(_numbered(asked.repartitionByRange("dim", "place").sortWithinPartitions("dim", "place"), BLOCK, "block", scratch, "number"))

    def outline(key, rows):
        return pa.Table.from_arrays([pa.array([x], t) for x, t in zip((key[0].as_py(), key[1].as_py()), (pa.int32(), pa.int64()), strict=True)] + [pa.array([x], pa.list_(pa.float64())) for x in Part(rows).extremes()], names=["dim", "block", "low", "high", "spread"])

    lowest = blocked.groupBy("dim", "block").agg(F.when(F.count("least") == F.count("*"), F.min("least")).alias("least"))
    blocks = blocked.groupBy("dim", "block").applyInArrow(outline, f"dim int, block long, {EXTREMES}").select("dim", "block", F.struct("low", "high", "spread").alias("of_block")).join(lowest, ["dim", "block"])
    bound = _bound("of_block", "of_tile")
    slack = F.greatest(F.abs(bound), F.lit(1.0)) * SLACK
    cells = scratch.write(blocks.join(tiles, "dim").where(F.col("least").isNull() | ~(bound + slack < F.col("least"))).select("dim", "block", "tile"))
    pairs = small(cells, cells.count())

    def across(key, queries, rows):
        asked = Part(queries.rename_columns([{"of": "tile"}.get(c, c) for c in queries.column_names]))
        known = queries["least"].combine_chunks()
        least = np.where(np.asarray(known.is_null()), -np.inf, np.asarray(known.fill_null(0)).astype(float))  # rounding keeps the order
        return pa.concat_tables([pa.table(x) for x in best(asked, Part(rows), least, k, elsewhere=True)])

    left = blocked.withColumnRenamed("tile", "of").join(pairs, ["dim", "block"]).select("dim", "block", "tile", "of", "vec_id", "place", "v", "least")
    right = tiled.join(pairs, ["dim", "tile"]).select("dim", "block", "tile", "vec_id", "place", "v")
    key = ["dim", "block", "tile"]
    far = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda key, a, b: across(key, a.drop_columns(["tile"]), b), "query long, query_id long, vec_id long, place long, score long")
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "place"))
    return near.unionByName(far).withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
