"""Embedding near-dedup: binary codes under random rotations, with correction factors; estimates with bounds decide which pairs are recomputed exactly.

1. Equal vectors are one class. Each class has a code (signs of its rotated coordinates), the code's correction factor
   and, from further rotations, a key for each of several bands.
2. Classes with one key of one band are in a bucket. There the codes alone, 16 bytes a vector, tell which members may
   have a partner: codes that differ in more bits than those of a pair at the threshold ever do can't be partners.
   Buckets that are left with the members of an earlier one are dropped: all their pairs have met.
3. Only then do the vectors go to the buckets. The inner product of each pair of unit vectors is estimated from one's
   rotated coordinates and the other's code (unbiased once divided by the stored factor); pairs whose upper confidence
   bound is below the threshold are dropped, all others computed in double precision.
4. Links are counted where they are found, in the first band that a pair shares: a class's number of links, and one edge
   to the first member of its part of the bucket. No pair is ever listed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Scratch
from .common import beside, connected_components, small

THRESHOLD = 0.95
#: The chance that a pair at the threshold meets in no band; closer pairs have less.
MISS = 1e-6
#: The chance that the codes of a pair at the threshold differ in more bits than are allowed.
FAR = 1e-9
#: Half-width of the confidence bound in the estimate's own scale; beyond it lies a chance of about 2 * exp(-WIDTH**2 / 2).
WIDTH = 5.5
#: Vectors in a block: larger buckets are cut into blocks, and each pair of blocks is a unit of its own.
BLOCK = 256
#: Pairs that are estimated at a time.
PAIRS = 1 << 18
SEED = 11


def rotations(dim: int, bits: int, seed: int = SEED) -> np.ndarray:
    """dim x bits: columns of random orthogonal matrices."""
    draw, out = np.random.default_rng(seed), []
    for _ in range(-(-bits // dim)):
        q, r = np.linalg.qr(draw.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.concatenate(out, axis=1)[:, :bits]


def bands_for(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Bits in a band, so that unlike vectors seldom meet, and bands, so that pairs at the threshold surely do."""
    rows = max(8, math.ceil(math.log2(max(n, 2))) + 2)
    agree = (1 - math.acos(threshold) / math.pi) ** rows
    return rows, math.ceil(math.log(miss) / math.log1p(-agree))


def most_unlike(bits: int, threshold: float = THRESHOLD, far: float = FAR) -> int:
    """Bits in which the codes of a pair at the threshold differ at most, but for a chance of `far`: the tail of a binomial distribution."""
    p, tail, k = math.acos(threshold) / math.pi, 1.0, -1
    while k < bits and tail > far:
        k += 1
        tail -= math.comb(bits, k) * p**k * (1 - p) ** (bits - k)
    return k


def band_keys(unit: np.ndarray, rotation: np.ndarray, rows: int) -> np.ndarray:
    """One whole number for each vector and band, from the signs of its rotated coordinates."""
    signs = (unit @ rotation >= 0).reshape(len(unit), -1, rows)
    return signs @ (np.int64(1) << np.arange(rows, dtype=np.int64))


def coded(unit: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs of the rotated coordinates, packed, and the inner product of each vector with its own code."""
    turned = unit @ rotation
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1])


def signs_of(codes: np.ndarray, dim: int) -> np.ndarray:
    return np.unpackbits(codes, axis=1, count=dim).astype(np.float64) * 2 - 1


def estimates(turned: np.ndarray, signs: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of rotated queries with the vectors behind signs, row by row, and the half-width of their bounds."""
    dim = turned.shape[1]
    estimate = np.einsum("ij,ij->i", turned, signs) / math.sqrt(dim) / factors
    return estimate, WIDTH * np.sqrt(np.maximum(1 - factors**2, 0)) / factors / math.sqrt(max(dim - 1, 1))


def _usable(embedding: str) -> str:
    """Vectors with a direction: neither null nor empty, every component finite, not all zero."""
    return f"{embedding} is not null and size({embedding}) > 0 and forall({embedding}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({embedding}, x -> x <> 0)"


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # first, lest squares leave the range of doubles
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Where rows with equal values in all columns begin and end."""
    if not len(columns[0]):
        return []
    cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(columns[0])], strict=True))


def _grouped(batches, key: str, of):
    """Applies of() to tables of whole runs of `key`, which is sorted."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
        if not len(table):
            continue
        keys = table.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))  # the last run may go on in the next batch
        if cut:
            yield of(table.slice(0, cut))
        rest = table.slice(cut)
    if rest is not None and len(rest):
        yield of(rest)


def _sketch(classes: DataFrame, rows: int, bands: int) -> DataFrame:
    """node, dim, code, factor and keys of classes (node, v)."""

    def work(batches):
        turned: dict[int, tuple] = {}
        for batch in batches:
            vectors = batch.column(1).to_pylist()
            for dim in {len(v) for v in vectors}:
                if dim not in turned:
                    turned[dim] = rotations(dim, dim, SEED + 1), rotations(dim, rows * bands)
                own = np.array([i for i, v in enumerate(vectors) if len(v) == dim])
                unit = _unit(np.array([vectors[i] for i in own], np.float64))
                code, factor = coded(unit, turned[dim][0])
                keys = band_keys(unit, turned[dim][1], rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(own)), pa.array([dim] * len(own), pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(factor), pa.array(list(keys), pa.list_(pa.int64()))],
                    names=["node", "dim", "code", "factor", "keys"],
                )

    return classes.mapInArrow(work, "node long, dim int, code binary, factor double, keys array<long>")


def _doubtful(s: DataFrame, threshold: float) -> DataFrame:
    """(unit, dim, band, i, j, own, node): members of bucket blocks i and j that may have a partner in the other one, by codes alone."""
    placed = s.select("node", "dim", F.posexplode("keys").alias("band", "key"))
    crowded = placed.groupBy("dim", "band", "key").agg(F.count("*").alias("n")).where("n > 1")
    m = placed.join(crowded, ["dim", "band", "key"])
    m = m.withColumn("blocks", F.ceil(F.col("n") / BLOCK)).withColumn("own", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    m = m.select("node", "dim", "band", "key", "own", i.alias("i"), j.alias("j"), F.xxhash64("dim", "band", "key", i, j).alias("unit"))
    dealt = m.join(s.select("node", "code"), "node").repartition("unit").sortWithinPartitions("unit", "dim", "band", "key", "i", "j", "node")
    names = ["unit", "dim", "band", "i", "j", "own", "node"]

    def work(batches):
        most: dict[int, int] = {}

        def of(table: pa.Table) -> pa.RecordBatch:
            d = {c: table.column(c).to_numpy() for c in (*names, "key")}
            codes, keep = table.column("code").to_pylist(), np.zeros(len(table), bool)
            for lo, hi in _runs(*(d[c] for c in ("unit", "dim", "band", "key", "i", "j"))):
                if hi - lo < 2:
                    continue
                dim = int(d["dim"][lo])
                limit = most.get(dim) if dim in most else most.setdefault(dim, most_unlike(dim, threshold))
                if hi - lo == 2:  # most buckets
                    keep[lo:hi] = (int.from_bytes(codes[lo]) ^ int.from_bytes(codes[lo + 1])).bit_count() <= limit and (d["i"][lo] == d["j"][lo] or d["own"][lo] != d["own"][lo + 1])
                    continue
                signs = signs_of(np.stack([np.frombuffer(c, np.uint8) for c in codes[lo:hi]]), dim).astype(np.float32)
                near = signs @ signs.T >= dim - 2 * limit
                np.fill_diagonal(near, False)
                if d["i"][lo] != d["j"][lo]:
                    near &= d["own"][lo:hi, None] != d["own"][None, lo:hi]
                keep[lo:hi] = near.any(axis=1)
            return pa.RecordBatch.from_arrays([pa.array(d[c][keep]) for c in names], names=names)

        yield from _grouped(batches, "unit", of)

    return dealt.mapInArrow(work, "unit long, dim int, band int, i int, j int, own int, node long")


def _new_units(doubtful: DataFrame) -> DataFrame:
    """doubtful without the units whose members, in the same blocks, are those of a unit of an earlier band."""
    sums = doubtful.groupBy("unit", "dim", "band", "i", "j").agg(F.sum(F.xxhash64("node", F.when(F.col("i") != F.col("j"), F.col("own"))).cast("decimal(38,0)")).alias("members"), F.count("*").alias("n"))
    first = sums.groupBy("members", "n").agg(F.min(F.struct("band", "unit")).alias("x")).select("x.unit")
    return doubtful.join(first, "unit", "left_semi")


def _links(classes: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(node, links, root) of classes (node, v, size), several rows for a class: their links add up, their roots connect it."""
    rows, bands = bands_for(classes.count(), threshold)
    s = scratch.write(_sketch(classes.select("node", "v"), rows, bands))
    doubtful = scratch.write(_doubtful(s, threshold))
    placed = _new_units(doubtful).join(s.select("node", "code", "factor"), "node").join(classes.select("node", "v", "size"), "node")
    dealt = placed.repartition("unit").sortWithinPartitions("unit", "dim", "band", "i", "j", "node")

    def work(batches):
        turned: dict[int, tuple] = {}

        def of(table: pa.Table) -> pa.RecordBatch:
            d = {c: table.column(c).to_numpy() for c in ("unit", "dim", "band", "i", "j", "own", "node", "factor", "size")}
            vectors, codes, out, pairs = table.column("v").combine_chunks(), table.column("code").to_pylist(), [], []
            runs = _runs(*(d[c] for c in ("unit", "dim", "band", "i", "j")))

            def compare(dim: int) -> None:
                """Pairs of places in the table, of one dimension: estimate, bound, exact product, first band."""
                if not pairs:
                    return
                a, b = np.concatenate(pairs, axis=1)
                pairs.clear()
                if dim not in turned:
                    turned[dim] = rotations(dim, dim, SEED + 1), rotations(dim, rows * bands)
                places = np.unique(np.concatenate([a, b]))
                a, b = np.searchsorted(places, a), np.searchsorted(places, b)
                unit = _unit(np.array([vectors[int(p)].values.to_numpy() for p in places], np.float64))
                signs = signs_of(np.stack([np.frombuffer(codes[p], np.uint8) for p in places]), dim)
                estimate, width = estimates((unit @ turned[dim][0])[a], signs[b], d["factor"][places][b])
                may = estimate + width >= threshold
                a, b = a[may], b[may]
                near = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
                a, b = a[near], b[near]
                if not len(a):
                    return
                keys, band = band_keys(unit, turned[dim][1], rows), d["band"][places][a]
                first = (np.argmax(keys[a] == keys[b], axis=1) == band) if len(a) else np.empty(0, bool)
                a, b, node, size, unit_of = a[first], b[first], d["node"][places], d["size"][places], d["unit"][places]
                links = np.bincount(a, size[b], len(places)) + np.bincount(b, size[a], len(places))
                root = np.arange(len(places))
                while True:
                    low = root.copy()
                    np.minimum.at(low, a, root[b])
                    np.minimum.at(low, b, low[a])
                    if (low == root).all():
                        break
                    root = low
                assert (unit_of[a] == unit_of[b]).all()
                met = links > 0
                out.append((node[met], links[met].astype(np.int64), node[root[met]]))

            total, before = 0, None
            for lo, hi in runs:
                dim = int(d["dim"][lo])
                if total >= PAIRS or dim != before:
                    compare(before)
                    total, before = 0, dim
                x, y = np.triu_indices(hi - lo, 1)
                if d["i"][lo] != d["j"][lo]:
                    apart = d["own"][lo + x] != d["own"][lo + y]
                    x, y = x[apart], y[apart]
                pairs.append(np.stack([lo + x, lo + y]))
                total += len(x)
            compare(before)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *(x[k] for x in out)])) for k in range(3)], names=["node", "links", "root"])

        yield from _grouped(batches, "unit", of)

    links = scratch.write(dealt.mapInArrow(work, "node long, links long, root long"))
    scratch.done(s, doubtful)
    return links


def deduplicated(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors, whatever else it has.

    Two vectors link when the cosine in double precision is at least the threshold. n_links counts the other rows linked
    directly, equal vectors included; component_id is the smallest vec_id reachable, the row's own included; kept is
    true where both are the same. Null, empty and zero vectors and those with a null, NaN or infinite component link
    with nothing, as do vectors of different lengths. Rows with a null vec_id count as vectors but have a null
    component_id and are not kept. A vec_id that occurs twice has two rows, each judged by its own vector. An empty
    table gives an empty one.
    """
    scratch = Scratch(vectors.sparkSession, "embeddings")
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    usable = v.where(_usable("v"))
    by_vector = usable.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"))
    classes = scratch.write(by_vector.withColumn("node", F.monotonically_increasing_id()))  # the table fixes the numbers
    links = _links(classes.select("node", "v", "size"), threshold, scratch)
    most = links.count()
    found = connected_components(links.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    linked = scratch.write(classes.select("node", "rep").join(small(found, most), "node"))
    least = beside(linked.groupBy("component").agg(F.min("rep").alias("least")), most, scratch)
    per_node = linked.join(least, "component").select("node", "least").join(small(links.groupBy("node").agg(F.sum("links").alias("links")), most), "node")
    per_class = classes.join(small(per_node, 2 * most), "node", "left").select("v", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    good = usable.join(scratch.write(per_class), "v").select("vec_id", "n_links", "component_id")
    bad = v.where(f"not coalesce({_usable('v')}, false)").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    named = F.when(F.col("vec_id").isNotNull(), F.col("component_id"))
    return good.unionByName(bad).withColumn("component_id", named).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
