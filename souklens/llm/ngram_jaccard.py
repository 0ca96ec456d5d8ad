"""N-gram Jaccard join: a token-group matrix over sets of word shingles.

1. Each text becomes its set of 64-bit shingle hashes; texts with equal sets are one class, compared once.
2. Linked sets share some of their first tokens in any common order. Classes that share too few of their first tokens,
   by hash, with other classes are done.
3. The others are partitioned into groups of similar ones: sorted by the smallest token that they share with another
   class, and cut into groups of bounded size. Each group's token union is stored once, its members as places in it.
4. The matrix of tokens and groups: a member has links outside its group only if enough of its tokens stand in other
   groups' unions. The rarest tokens of these members are joined with the groups that have them, which bounds the overlap
   of each group's queries with another group's union; pairs of groups below the bound are never opened.
5. Each group is opened with itself, and with the groups that qualify. A query with too few tokens in the other union is
   dropped; the intersections of all others come from one matrix product. Links are counted, not listed: a member's
   number of links, and one edge to the first member of its part of the group.

No step misses a link: prefixes and unions give upper bounds, whatever the texts (equal 64-bit hashes aside).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Scratch
from .common import beside, connected_components, free_name, small

SHINGLE = 5
#: Members and tokens in a group; a larger set is a group of its own.
MEMBERS, TOKENS = 256, 1 << 18
#: Columns of the token matrix that are multiplied at a time, and tokens that are sorted at a time.
COLUMNS, SORTED = 4096, 1 << 18
#: Distinct words whose hashes a task remembers.
REMEMBER = 200_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes: A-Z in lower case, words between blanks; fewer than SHINGLE words are one shingle."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.words = size, _Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # of bytes: ASCII letters and blanks alone
        if not words:
            return np.empty(0, np.uint64)
        if len(self.words) > REMEMBER:
            self.words.clear()
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        k = min(self.size, len(h))
        rolled = h[: len(h) - k + 1].copy()
        for i in range(1, k):
            rolled = rolled * _FACTOR + h[i : len(h) - k + 1 + i]
        return np.unique(_mixed(rolled + np.uint64(k)))


class Bounds:
    """What a link at `percent` implies for a set of n tokens, n a number or an array."""

    def __init__(self, percent: int):
        self.percent = percent

    def shared(self, n):
        """Tokens that it has in common with each set it is linked to."""
        return -(-self.percent * n // 100)

    def largest(self, n, common):
        """The size of the largest set that it may be linked to with so many tokens in common."""
        return (100 + self.percent) * common // self.percent - n

    def spare(self, n):
        """First tokens, beyond those that may all be its own, that are looked at."""
        return np.maximum(1, n * self.percent // 800)

    def first(self, n):
        """How many of its first tokens are looked at: at least spare(n) of them are common ones, if there is a link."""
        return n - self.shared(n) + self.spare(n)

    def met(self, n):
        """First tokens that are first tokens of the other set too; that set has shared(n) tokens or more."""
        return self.spare(self.shared(n))

    def linked(self, inter, a, b):
        return 100 * inter >= self.percent * (a + b - inter)


def _signed(tokens: np.ndarray) -> np.ndarray:
    return tokens.view(np.int64)


def _arrays(column, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def sketched(rows: DataFrame, bounds: Bounds, size: int = SHINGLE) -> DataFrame:
    """row, doc, n, set (a digest of 128 bits, null for empty sets) and first (its first tokens by hash) of rows (row, doc, text)."""

    def work(batches):
        shingles = Shingler(size)
        for batch in batches:
            n, sets, first = [], [], []
            for text in batch.column(2):
                tokens = shingles(text.as_py())
                n.append(len(tokens))
                sets.append(xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None)
                first.append(tokens[: bounds.first(len(tokens))].tobytes() if len(tokens) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(first, pa.binary())], names=["row", "doc", "n", "set", "first"])

    return rows.mapInArrow(work, "row long, doc long, n long, set binary, first binary")


def _in_parts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys (the first column) and tokens, each token with its key, some SORTED tokens at a time."""
    keys, tokens, total = [], [], 0
    for key, some in zip(batch.column(0).to_numpy(), batch.column(column), strict=True):
        keys.append(key)
        tokens.append(np.frombuffer(some.as_py(), np.uint64))
        total += len(tokens[-1])
        if total >= SORTED:
            yield np.repeat(keys, [len(x) for x in tokens]), np.concatenate(tokens)
            keys, tokens, total = [], [], 0
    if keys:
        yield np.repeat(keys, [len(x) for x in tokens]), np.concatenate(tokens)


def _shared(sets: DataFrame) -> DataFrame:
    """(key, token) for the tokens of sets (key long, tokens binary; keys are unique) that stand in another set too.

    Tokens are sorted by value within hash partitions, so equal ones are neighbours. Those that meet before the shuffle
    need no more than one row there that stands for all of them, so a token of very many sets is no hot spot.
    """

    def deal(batches):
        for batch in batches:
            for keys, tokens in _in_parts(batch, 1):
                order = np.argsort(tokens, kind="stable")
                t, k = tokens[order], keys[order]
                same = t[1:] == t[:-1]
                here = np.append(same, False) | np.append(False, same)  # found already; one row tells the others
                lead = here & ~np.append(False, same)
                alone, n = ~here, int(here.sum())
                route = np.concatenate([_signed(t[alone]), _signed(t[lead]), _signed(_mixed(k[here].view(np.uint64) * _FACTOR))])
                null_key = np.concatenate([np.zeros(alone.sum(), bool), np.ones(lead.sum(), bool), np.zeros(n, bool)])
                known = np.concatenate([np.zeros(len(route) - n, bool), np.ones(n, bool)])
                key = np.concatenate([k[alone], np.zeros(lead.sum(), np.int64), k[here]])
                token = np.concatenate([np.zeros(len(route) - n, np.int64), _signed(t[here])])
                yield pa.RecordBatch.from_arrays([pa.array(route), pa.array(key, mask=null_key), pa.array(token, mask=~known)], names=["route", "key", "token"])

    def match(batches):
        last, held, told = None, None, False  # route and key of the last row, and whether it has been found
        for batch in batches:
            route, key, token = (batch.column(i) for i in range(3))
            known, named = token.is_valid().to_numpy(zero_copy_only=False), key.is_valid().to_numpy(zero_copy_only=False)
            key = key.fill_null(0).to_numpy()
            r, k, has = route.to_numpy()[~known], key[~known], named[~known]
            found = [key[known]], [token.fill_null(0).to_numpy()[known]]
            if len(r):
                before = np.zeros(len(r), bool)
                if last is not None:
                    r, k, has, before = np.append(last, r), np.append(held or 0, k), np.append(held is not None, has), np.append(told, before)
                same = r[1:] == r[:-1]
                shared = np.append(same, False) | np.append(False, same) | before
                new = shared & has & ~before
                found[0].append(k[new])
                found[1].append(r[new])
                last, held, told = r[-1], int(k[-1]) if has[-1] else None, bool(shared[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in found], names=["key", "token"])

    dealt = sets.mapInArrow(deal, "route long, key long, token long").repartition("route").sortWithinPartitions("route")
    return dealt.mapInArrow(match, "key long, token long")


def _token_sets(docs: DataFrame, wanted: DataFrame, n_wanted: int, size: int) -> DataFrame:
    """node, weight, k1, k2 and tokens (sorted 64-bit hashes) of the classes in wanted (node, set, rep, weight, k1, k2); a class may come twice."""
    reps = wanted.select(F.col("rep").alias("doc")).distinct()
    texts = docs.join(small(reps, n_wanted), "doc", "left_semi").select("text")

    def work(batches):
        shingles = Shingler(size)
        for batch in batches:
            sets = [shingles(x.as_py()).tobytes() for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(map(xxhash.xxh3_128_digest, sets), pa.binary()), pa.array(sets, pa.binary())], names=["set", "tokens"])

    made = texts.mapInArrow(work, "set binary, tokens binary")
    return made.join(small(wanted.drop("rep"), 3 * n_wanted), "set").select("node", "weight", "k1", "k2", "tokens")


_GROUP = "grp long, nodes binary, weights binary, sizes binary, tokens binary, at binary, ends binary"
_NAMES = ["grp", "nodes", "weights", "sizes", "tokens", "at", "ends"]


def _row(nodes: np.ndarray, weights: np.ndarray, sizes: np.ndarray, union: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple:
    return int(nodes[0]), *(x.tobytes() for x in (nodes.astype(np.int64), weights.astype(np.int64), sizes.astype(np.int64), union, at.astype(np.int32), ends.astype(np.int64)))


def _batch(rows: list[tuple], names: list[str] = _NAMES) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 0 else pa.binary()) for i, c in enumerate(columns)], names=names)


class Group:
    """A row of the groups' table: the union of its members' tokens, and each member as places in it."""

    def __init__(self, nodes, weights, sizes, tokens, at, ends):
        as_ = np.frombuffer
        self.nodes, self.weights, self.sizes, self.union, self.at, self.ends = as_(nodes, np.int64), as_(weights, np.int64), as_(sizes, np.int64), as_(tokens, np.uint64), as_(at, np.int32), as_(ends, np.int64)
        self.member = np.repeat(np.arange(len(self.nodes)), np.diff(self.ends, prepend=0))

    def matrix(self, places: np.ndarray, rows: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Ones where a member of `rows` has a token whose place is lo to hi - 1; places are those of the union's tokens, -1 for none."""
        to = np.full(len(self.nodes), -1)
        to[rows] = np.arange(len(rows))
        place, member = places[self.at], to[self.member]
        inside = (place >= lo) & (place < hi) & (member >= 0)
        out = np.zeros((len(rows), hi - lo), np.float32)
        out[member[inside], place[inside] - lo] = 1
        return out


def _cut(sets: DataFrame) -> DataFrame:
    """The groups of sets (node, weight, k1, k2, tokens)."""

    def close(members: list[tuple]) -> tuple:
        tokens = [m[3] for m in members]
        union, at = np.unique(np.concatenate(tokens), return_inverse=True)
        sizes = np.array([len(x) for x in tokens])
        return _row(np.array([m[0] for m in members]), np.array([m[1] for m in members]), sizes, union, at, np.cumsum(sizes))

    def work(batches):
        open_, total = [], 0
        for batch in batches:
            done = []
            for node, weight, k1, tokens in zip(*(batch.column(c).to_pylist() for c in ("node", "weight", "k1", "tokens")), strict=True):
                if open_ and open_[-1][0] == node:
                    continue
                tokens = np.frombuffer(tokens, np.uint64)
                if open_ and (open_[-1][2] != k1 or len(open_) >= MEMBERS or total + len(tokens) > TOKENS):
                    done.append(close(open_))
                    open_, total = [], 0
                open_.append((node, weight, k1, tokens))
                total += len(tokens)
            yield _batch(done)
        if open_:
            yield _batch([close(open_)])

    keys = ["k1", "k2", "node"]
    return sets.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(work, _GROUP)


_SIZES = ("need", "smallest", "largest", "reach_from", "reach_to")


def _sizes(n: np.ndarray, outside: np.ndarray, bounds: Bounds) -> tuple[int, ...]:
    """_SIZES of members with n tokens, so many of which stand in other groups."""
    return tuple(int(x) for x in (bounds.met(n).min(), n.min(), n.max(), bounds.shared(n).min(), bounds.largest(n, outside).max()))


def _able(groups: DataFrame, cells: DataFrame, bounds: Bounds) -> DataFrame:
    """Groups of the members that may have links outside, with `probes` (their rarest tokens), `need` (how many of them a pair of groups has to share), and the range of sizes that they have and that their partners may have.

    A member has no more in common with a set elsewhere than its tokens that stand in other groups. So pages of one
    template, which share its tokens but have too many of their own, reach no partner of their own size.
    cells: (key, token) of the tokens that stand in several groups.
    """
    often = cells.groupBy("token").agg(F.count("*").alias("often"))
    of = cells.join(often, "token").groupBy(F.col("key").alias("grp")).agg(F.sort_array(F.collect_list(F.struct("token", "often"))).alias("cells"))
    rows = groups.join(of, "grp").select(*_NAMES, F.col("cells.token").alias("token"), F.col("cells.often").alias("often"))

    def work(batches):
        for batch in batches:
            done = []
            for row in zip(*batch.columns, strict=True):
                g, often = Group(*(x.as_py() for x in row[1:7])), np.zeros(0, np.int64)
                often = np.zeros(len(g.union), np.int64)
                often[np.searchsorted(g.union, row[7].values.to_numpy().view(np.uint64))] = row[8].values.to_numpy()
                outside = np.bincount(g.member, often[g.at] > 0, len(g.nodes)).astype(np.int64)
                able = np.flatnonzero(outside >= bounds.shared(g.sizes))
                if not len(able):
                    continue
                probes, parts = [], []
                for m in able:
                    at = g.at[g.ends[m - 1] if m else 0 : g.ends[m]]
                    at = at[often[at] > 0]
                    parts.append(at)
                    n = g.sizes[m]
                    probes.append(at[np.lexsort((at, often[at]))[: bounds.first(n) - (n - len(at))]])
                kept, at = np.unique(np.concatenate(parts), return_inverse=True)
                new = _row(g.nodes[able], g.weights[able], g.sizes[able], g.union[kept], at, np.cumsum([len(x) for x in parts]))
                done.append((int(row[0].as_py()), *new[1:], _signed(g.union[np.unique(np.concatenate(probes))]), *_sizes(g.sizes[able], outside[able], bounds)))
            numbers = [pa.array([d[8 + i] for d in done], pa.int64()) for i in range(len(_SIZES))]
            yield pa.RecordBatch.from_arrays([*_batch([d[:7] for d in done]).columns, pa.array([d[7] for d in done], pa.list_(pa.int64())), *numbers], names=[*_NAMES, "probes", *_SIZES])

    return rows.mapInArrow(work, _GROUP + ", probes array<long>" + "".join(f", {c} long" for c in _SIZES))


def _qualifying(able: DataFrame) -> DataFrame:
    """Pairs (g, h) of groups that share as many probes as a link between them would have them share, and have members of sizes that the other's may be linked to."""
    probes = able.select("grp", *_SIZES, F.explode("probes").alias("token"))
    a, b = (probes.select(F.col("grp").alias(g), "token", *[F.col(c).alias(f"{c}_{g}") for c in _SIZES]) for g in "gh")
    fit = " and ".join(f"smallest_{x} <= reach_to_{y} and largest_{x} >= reach_from_{y}" for x, y in ("gh", "hg"))
    met = a.join(b, "token").where(f"g < h and {fit}").groupBy("g", "h", "need_g", "need_h").agg(F.count("*").alias("met"))
    return met.where("met >= greatest(need_g, need_h)").select("g", "h")


def _links(a: Group, b: Group | None, bounds: Bounds) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes, links, roots) of the members of a, and of b, that are linked with one of the other group; without b, within a."""
    if b is None:
        b, counts = a, np.bincount(a.at, minlength=len(a.union))
        common = counts > 1
        of_a = of_b = np.where(common, np.cumsum(common) - 1, -1)
        rows = cols = np.arange(len(a.nodes))
    else:
        where = np.searchsorted(b.union, a.union)
        where[where == len(b.union)] = 0
        common = b.union[where] == a.union if len(b.union) else np.zeros(len(a.union), bool)
        of_a, of_b = np.where(common, np.cumsum(common) - 1, -1), np.full(len(b.union), -1)
        of_b[where[common]] = np.arange(common.sum())
        rows, cols = (np.flatnonzero(np.bincount(g.member, p[g.at] >= 0, len(g.nodes)) >= bounds.shared(g.sizes)) for g, p in ((a, of_a), (b, of_b)))
    if not len(rows) or not len(cols):
        return []
    inter = np.zeros((len(rows), len(cols)), np.float32)
    for lo in range(0, n := int(common.sum()), COLUMNS):
        left = a.matrix(of_a, rows, lo, min(lo + COLUMNS, n))
        inter += left @ (left if b is a else b.matrix(of_b, cols, lo, min(lo + COLUMNS, n))).T
    inter = inter.astype(np.int64)
    near = bounds.linked(inter, a.sizes[rows][:, None], b.sizes[cols][None, :])
    if b is a:
        np.fill_diagonal(near, False)
    label_a, label_b = np.arange(len(rows)), np.arange(len(cols)) + (0 if b is a else len(rows))
    far = len(rows) + len(cols)
    while True:
        new_a = np.minimum(label_a, np.where(near, label_b[None, :], far).min(axis=1))
        new_b = new_a if b is a else np.minimum(label_b, np.where(near, new_a[:, None], far).min(axis=0))
        if (new_a == label_a).all() and (new_b == label_b).all():
            break
        label_a, label_b = new_a, new_b
    nodes = np.concatenate([a.nodes[rows], b.nodes[cols]])
    sides = [(a, rows, near @ b.weights[cols], label_a)] + ([] if b is a else [(b, cols, near.T @ a.weights[rows], label_b)])
    return [(g.nodes[own][links > 0], links[links > 0], nodes[label[links > 0]]) for g, own, links, label in sides]


def _opened(rows: DataFrame, bounds: Bounds, pairs: bool) -> DataFrame:
    """(node, links, root) for each member with links in an opened group, or pair of groups: links with the other's rows, and one member that it is connected with."""

    def work(batches):
        for batch in batches:
            out = []
            for row in zip(*batch.columns, strict=True):
                parts = [x.as_py() for x in row]
                out += _links(Group(*parts[:6]), Group(*parts[6:]) if pairs else None, bounds)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *(x[i] for x in out)])) for i in range(3)], names=["node", "links", "root"])

    return rows.mapInArrow(work, "node long, links long, root long")


def _classes(d: DataFrame, bounds: Bounds, size: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The sketch of every row; and the classes of equal sets: set, node (the class's number, that of one of its rows), rep (its smallest doc_id), n, class_size."""
    s = scratch.write(sketched(d.select(F.monotonically_increasing_id().alias("row"), "doc", "text"), bounds, size))
    by_set = s.where("set is not null").groupBy("set").agg(F.min("row").alias("node"), F.min("doc").alias("rep"), F.max("n").alias("n"), F.count("*").alias("class_size"))
    return s, scratch.write(by_set)


def _joined(d: DataFrame, s: DataFrame, classes: DataFrame, percent: int, size: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """(node, links, root) for the classes that are linked with others, several rows for a class: their links add up, their roots connect it; and a bound for the number of these classes."""
    bounds = Bounds(percent)
    named = classes.where("rep is not null")
    first = s.join(small(named.select(F.col("node").alias("row")), named.count()), "row", "left_semi").select(F.col("row").alias("key"), "first")
    met = _shared(first).groupBy(F.col("key").alias("node")).agg(F.count("*").alias("met"), F.min("token").alias("k1"), F.max("token").alias("k2"))
    need = f"greatest(1L, (({percent} * n + 99) div 100) * {percent} div 800)"
    wanted = scratch.write(named.join(met, "node").where(f"met >= {need}").select("node", "set", "rep", F.col("class_size").alias("weight"), "k1", "k2"))
    n = wanted.count()
    sets = scratch.write(_token_sets(d, wanted, n, size))
    groups = scratch.write(_cut(sets))
    scratch.done(sets, wanted)
    cells = scratch.write(_shared(groups.select(F.col("grp").alias("key"), "tokens")))
    able = scratch.write(_able(groups, cells, bounds))
    body = _NAMES[1:]
    side = lambda g: able.select(F.col("grp").alias(g), *[F.col(c).alias(f"{g}_{c}") for c in body])
    across = _qualifying(able).join(side("g"), "g").join(side("h"), "h").select(*[f"{g}_{c}" for g in "gh" for c in body])
    within = groups.where("length(nodes) > 8").select(*body)
    out = scratch.write(_opened(within, bounds, False).unionByName(_opened(across, bounds, True)))
    scratch.done(groups, cells, able)
    return out, n


def grouped(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = 80, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, class_size and n_links for every row of docs.

    Two documents link when 100 * |A and B| >= percent * |A or B|, A and B their sets of distinct shingles of `size`
    words; component_id is the smallest doc_id reachable by links, the document's own included, n_links the number of
    other rows that it links with, copies included. Null, empty and blank texts have no shingles and link with nothing.
    Rows with a null doc_id have a null component_id and are not compared (unless another row has their very set). A
    doc_id that occurs twice has two rows, each with the component of its own text. class_size counts the rows with
    exactly this set. Other columns are not read; doc_id must be a whole number. An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    d = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    s, classes = _classes(d, Bounds(percent), size, scratch)
    links, most = _joined(d, s, classes, percent, size, scratch)
    found = connected_components(links.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    linked_ = scratch.write(classes.select("node", "rep").join(small(found, most), "node"))
    least = beside(linked_.groupBy("component").agg(F.min("rep").alias("least")), most, scratch)
    per_node = linked_.join(least, "component").select("node", "least").join(small(links.groupBy("node").agg(F.sum("links").alias("links")), most), "node")
    per_set = scratch.write(classes.join(small(per_node, 2 * most), "node", "left").select("set", "class_size", F.coalesce("least", "rep").alias("component"), (F.col("class_size") - 1 + F.coalesce("links", F.lit(0))).alias("links")))
    out = s.select("doc", "n", "set").join(per_set, "set", "left")  # a plain scan: adaptive execution splits a set that many rows have only where both sides are mere shuffles
    return out.select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"),
    )


def pairs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = 80, size: int = SHINGLE) -> DataFrame:
    """Links (a, b) between the smallest doc_ids of classes of equal sets; they connect the same documents as all links do.

    Null, empty and blank texts and rows without a doc_id have none; repeated rows are one class; an empty table gives
    an empty one. How many links each document has is in grouped().
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    d = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    s, classes = _classes(d, Bounds(percent), size, scratch)
    named = lambda x, y: classes.select(F.col("node").alias(x), F.col("rep").alias(y))
    edges = _joined(d, s, classes, percent, size, scratch)[0].where("node <> root").select("node", "root").distinct()
    return edges.join(named("node", "a"), "node").join(named("root", "b"), "root").select("a", "b")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = 80, size: int = SHINGLE) -> DataFrame:
    """One document of each group of linked ones: that with the smallest doc_id. Of several rows with one doc_id one stays, rows without doc_id all stay. All columns stay as they are, whatever their names."""
    scratch, n = Scratch(docs.sparkSession, "jaccard"), free_name(docs.columns, "gone")
    g = grouped(docs, text, doc_id, percent, size).where("doc_id is not null")
    g = scratch.write(g.groupBy("doc_id").agg(F.bool_and(F.col("component_id") != F.col("doc_id")).alias("gone"), F.count("*").alias("n")))
    gone = g.where("gone").select(F.col("doc_id").alias(n))
    kept = docs.join(small(gone, gone.count()), docs[doc_id].cast("long") == F.col(n), "left_anti")
    if g.where("n > 1 and not gone").isEmpty():
        return kept
    nulls = kept.where(F.col(doc_id).isNull())
    return kept.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id]).unionByName(nulls)
