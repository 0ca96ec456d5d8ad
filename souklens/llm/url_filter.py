"""URL filters: rules in sorted arrays of 64-bit digests that tasks memory-map and probe by binary search."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import Scratch
from .common import free_name

#: The rules (host, path, verdict) of the registered query.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Rule tables of up to so many rows go to the executors as one array; larger ones stay there, in shards of so many rows.
SHARD = 200_000
#: Candidate strings that are looked up in a shard at a time.
CANDIDATES = 1_000_000

_PARTS = re.compile(r"://([^/?#]*)([^?#]*)")
_SMALL = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
_OPEN: dict[str, DigestArray] = {}
_SENT: set[tuple[str, str]] = set()


def split_url(url: str | None) -> tuple[str, str]:
    m = _PARTS.search(url) if url else None
    return (m[1].translate(_SMALL), m[2]) if m else ("", "")


def candidates(host: str, path: str, host_lengths: list[int], path_lengths: list[int]) -> list[bytes]:
    """Every string that a rule for this URL can have; only lengths, in bytes, that some rule has."""
    h, p, out = host.encode("utf-8", "surrogatepass"), path.encode("utf-8", "surrogatepass"), []
    heads = [p[:n] for n in path_lengths if n <= len(p)]
    for n in host_lengths if h else ():
        if n == len(h) or 0 < n < len(h) and h[-n - 1 : -n] == b".":
            out += [h[-n:] + x for x in heads]
    return out


class DigestArray:
    """Rules as files: sorted digests, offsets into one blob of the rules' strings, and verdicts."""

    def __init__(self, folder: str, name: str):
        load = lambda part: np.load(os.path.join(folder, f"{name}.{part}.npy"), mmap_mode="r")
        self.keys, self.offsets, self.blob, self.hosts, self.verdicts = map(load, ("keys", "offsets", "blob", "hosts", "verdicts"))
        self.host_lengths, self.path_lengths = (load(x).tolist() for x in ("host_lengths", "path_lengths"))

    @staticmethod
    def write(rules: Iterable[tuple[str, str, str]], folder: str) -> str:
        """Writes the files of normalised rules; returns their name, which follows from the contents."""
        rows = sorted((xxhash.xxh64_intdigest((h + p).encode()), (h + p).encode(), len(h.encode()), len(p.encode()), v == "block") for h, p, v in rules)
        name = "urls-" + hashlib.sha256(repr(rows).encode()).hexdigest()[:24]
        put = lambda part, x, kind: np.save(os.path.join(folder, f"{name}.{part}.npy"), np.asarray(x, dtype=kind))
        put("keys", [r[0] for r in rows], np.uint64)
        put("offsets", np.cumsum([0, *[len(r[1]) for r in rows]]), np.int64)
        put("blob", np.frombuffer(b"".join(r[1] for r in rows), np.uint8), np.uint8)
        put("hosts", [r[2] for r in rows], np.int32)
        put("verdicts", [r[4] for r in rows], np.bool_)
        put("host_lengths", sorted({r[2] for r in rows}), np.int32)
        put("path_lengths", sorted({r[3] for r in rows}), np.int32)
        return name

    PARTS = ("keys", "offsets", "blob", "hosts", "verdicts", "host_lengths", "path_lengths")

    def lookup(self, wanted: list[bytes], digest=xxhash.xxh64_intdigest) -> dict[bytes, int]:
        """The row of each string that is a rule: a binary search of the digests, then the stored strings themselves."""
        if not wanted or not len(self.keys):
            return {}
        digests = np.fromiter(map(digest, wanted), np.uint64, len(wanted))
        low, high = np.searchsorted(self.keys, digests, "left"), np.searchsorted(self.keys, digests, "right")
        found = {}
        for i in np.flatnonzero(high > low):
            for row in range(low[i], high[i]):
                if self.blob[self.offsets[row] : self.offsets[row + 1]].tobytes() == wanted[i]:
                    found[wanted[i]] = row
        return found


def _local(spark: SparkSession, rules: list[tuple[str, str, str]]) -> str:
    """Makes the array known to all executors, which fetch it from the driver; returns its name."""
    folder = os.path.realpath(tempfile.mkdtemp(prefix="digests-"))
    name = DigestArray.write(rules, folder)
    if (spark.sparkContext.applicationId, name) in _SENT:
        return name
    _SENT.add((spark.sparkContext.applicationId, name))
    for part in DigestArray.PARTS:
        spark.sparkContext.addFile(os.path.join(folder, f"{name}.{part}.npy"))
    return name


def normalised(rules: DataFrame) -> DataFrame:
    """host (A-Z in lower case), path and verdict of rules, one row for each string host+path.

    A null path counts as empty; rules without a host or verdict are left out. Of rules with one string, "block" goes
    before "allow", then the longer host. Another verdict is an error.
    """
    small_host = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    wrong = F.raise_error(F.concat(F.lit("verdict has to be allow or block: "), F.col("verdict"))).cast("boolean")
    r = rules.where("host <> '' and verdict is not null").select(small_host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.when(F.col("verdict").isin("allow", "block"), F.col("verdict") == "block").otherwise(wrong).alias("blocks"))
    best = r.groupBy(F.concat("host", "path").alias("rule")).agg(F.max(F.struct("blocks", F.length("host").alias("n"), "host", "path")).alias("x"))
    return best.select("x.host", "x.path", F.when(F.col("x.blocks"), "block").otherwise("allow").alias("verdict"))


def _best(found: list[tuple[bytes, int, bool]], default: str) -> tuple[str | None, str]:
    """Rule and verdict of the longest string in found (string, length of its host, whether it blocks); of two as long the one with the longer host."""
    if not found:
        return None, default
    rule, _, blocks = max(found, key=lambda x: (len(x[0].decode("utf-8", "surrogatepass")), x[1], x[0]))
    return rule.decode("utf-8", "surrogatepass"), "block" if blocks else "allow"


def judged(pages: DataFrame, rules: DataFrame | Iterable[tuple[str, str, str]] = RULES, url: str = "url", default: str = "allow", shard: int = SHARD) -> DataFrame:
    """pages with host, path, rule and verdict ("allow" or "block") of each url.

    The host stands after the first "://", up to "/", "?", "#" or the end, A-Z in lower case; the path from there to
    "?", "#" or the end. A null url, or one without "://", has empty ones. A rule (host, path, verdict), see normalised(),
    fits its host and all subdomains if the url's path starts with its path; the longest string host+path in
    code points wins, of two as long the longer host. Without one, rule is null and verdict the default. Columns of pages with the four
    names are replaced; all others pass through. Repeated, very long and empty urls and empty tables give as many rows
    as they have.

    Rules are normalised in Spark and kept in digest arrays of `shard` rows at most. One array goes to the executors as
    files, memory-mapped there, so that the workers of a machine share one copy. Of several, each stays with a task,
    and the distinct candidates of the urls come to the array that their digest belongs to. Both ways look up the same
    candidates in the same arrays.
    """
    spark = pages.sparkSession
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    table = rules if isinstance(rules, DataFrame) else spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")
    table = normalised(table.select("host", "path", "verdict"))
    few = table.limit(shard + 1).collect()  # `shard` rules and one more at most
    if len(few) > shard:
        return _sharded(pages, table, url, default, own, shard)
    name, at = _local(spark, [tuple(r) for r in few]), len(own)
    schema = pages.select(*own).schema.add("host", "string").add("path", "string").add("rule", "string").add("verdict", "string")

    def judge(batches):
        array = _OPEN.get(name) or _OPEN.setdefault(name, DigestArray(SparkFiles.getRootDirectory(), name))
        for batch in batches:
            parts = [split_url(x) for x in batch.column(at).to_pylist()]
            options = [candidates(*x, array.host_lengths, array.path_lengths) for x in parts]
            found = array.lookup(list({x for xs in options for x in xs}))
            best = [_best([(x, int(array.hosts[found[x]]), bool(array.verdicts[found[x]])) for x in xs if x in found], default) for xs in options]
            new = [[h for h, _ in parts], [p for _, p in parts], [r for r, _ in best], [v for _, v in best]]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(at)], *[pa.array(x, pa.string()) for x in new]], names=[*own, "host", "path", "rule", "verdict"])

    return pages.select(*own, F.col(url).alias(free_name(own, "of_url"))).mapInArrow(judge, schema)


def _sharded(pages: DataFrame, rules: DataFrame, url: str, default: str, own: list[str], shard: int) -> DataFrame:
    """The same with several digest arrays, by ranges of the digest: rules and candidates of a range meet in one task, or in several if the candidates are many."""
    scratch = Scratch(pages.sparkSession, "urls")
    rules = scratch.write(rules)
    n_shards = -(-rules.count() // shard)
    lengths = rules.agg(F.collect_set(F.octet_length("host")), F.collect_set(F.octet_length("path"))).first()  # numbers up to the longest string's length
    host_lengths, path_lengths = map(sorted, lengths)

    def digest_range(text: bytes) -> int:
        return xxhash.xxh64_intdigest(text) * n_shards >> 64

    def of_rules(batches):
        for batch in batches:
            where = [digest_range((h + p).encode()) for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(where, pa.int64())], names=["host", "path", "verdict", "shard"])

    def of_urls(batches):
        for batch in batches:
            for u in batch.column(0).to_pylist():
                some = candidates(*split_url(u), host_lengths, path_lengths)
                yield pa.RecordBatch.from_arrays([pa.array([u] * len(some), pa.string()), pa.array(some, pa.binary()), pa.array(map(digest_range, some), pa.int64())], names=["url", "text", "shard"])

    wanted = scratch.write(pages.select(F.col(url).alias("url")).where("url is not null").distinct().mapInArrow(of_urls, "url string, text binary, shard long"))
    asked = scratch.write(wanted.select("shard", "text").distinct())
    parts = -(-asked.count() // (n_shards * CANDIDATES)) or 1
    held = rules.mapInArrow(of_rules, "host string, path string, verdict string, shard long").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(parts)).cast("long"))

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        with tempfile.TemporaryDirectory(prefix="digests-") as folder:
            array = DigestArray(folder, DigestArray.write(zip(*(left.column(c).to_pylist() for c in ("host", "path", "verdict")), strict=True), folder))
            found = array.lookup(right.column("text").to_pylist())
            return pa.table({"text": pa.array(list(found), pa.binary()), "n": pa.array([int(array.hosts[i]) for i in found.values()], pa.int64()), "blocks": pa.array([bool(array.verdicts[i]) for i in found.values()], pa.bool_())})

    hits = held.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInArrow(probe, "text binary, n long, blocks boolean")
    best = scratch.write(wanted.join(hits, "text").groupBy("url").agg(F.max(F.struct(F.length(F.col("text").cast("string")).alias("size"), "n", "text", "blocks")).alias("best")))
    schema = pages.select(*own).schema.add("host", "string").add("path", "string").add("rule", "string").add("verdict", "string")
    key, hit = free_name(pages.columns, "of_url"), free_name(pages.columns, "best")
    rows = pages.join(best.withColumnsRenamed({"url": key, "best": hit}), pages[url] == F.col(key), "left")

    def judge(batches):
        for batch in batches:
            parts = [split_url(x) for x in batch.column(len(own)).to_pylist()]
            chosen = [_best([] if x is None else [(x["text"], x["n"], x["blocks"])], default) for x in batch.column(len(own) + 1).to_pylist()]
            new = [[h for h, _ in parts], [p for _, p in parts], [r for r, _ in chosen], [v for _, v in chosen]]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(own))], *[pa.array(x, pa.string()) for x in new]], names=[*own, "host", "path", "rule", "verdict"])

    return rows.select(*[pages[c] for c in own], pages[url].alias(key), F.col(hit)).mapInArrow(judge, schema)
