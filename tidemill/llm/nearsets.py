"""The pipeline's near-dedup: texts whose sets of word shingles have a Jaccard similarity of 0.8 or more, none missed and none more.

SimHash components (``simhash.covering_links``) and rare shared shingles bring most near-duplicates together first. What
these miss is found by prefixes of the sets, which all pairs that similar share; by then most groups are one component
and are left alone. Every link is verified by the sets themselves. No task holds more than two blocks of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import CHUNK, bit_counts, majority, shingle_hashes
from .simhash import covering_links
from .stars import components
from .work import erase, mapped, shuffles_freed, sized_join, skew_join, width, written, written_at

WORDS, LEAST_MAP = 5, 64
#: A block of a group holds this many nodes and shingles at most, or one node.
BLOCK_NODES, BLOCK_SHINGLES = 4096, 4_000_000
SAMPLED, COMMON = 4_000, 200_000
NO_ID = -(2**63)
Links = Iterator[tuple[bytes, bytes]]


def shingle_set(text: bytes) -> np.ndarray:
    """The hashes of the distinct shingles of WORDS words of a whole text, in order."""
    found = list(shingle_hashes(text, WORDS))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def parity_map(h: np.ndarray) -> bytes:
    """For each of as many bins as there are hashes, rounded up to a power of two of LEAST_MAP at least, whether it holds an odd number of them.

    Two maps of one length differ in no more bits than two sets in elements.
    """
    bins = max(LEAST_MAP, 1 << (len(h) - 1).bit_length()) if len(h) else LEAST_MAP
    return np.packbits((np.bincount((h % np.uint64(bins)).astype(np.int64), minlength=bins) & 1).astype(bool), bitorder="little").tobytes()


def prefix(h: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The n - ceil(0.8 n) + 1 first shingles of a set of n, in one order for all sets: those not in ``common`` first, then by count.

    Two sets with a Jaccard similarity of 0.8 share 0.8 of the larger at least, and so one of these, whatever the order.
    """
    rank = np.zeros(len(h), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        rank = np.where(common[at] == h, counts[at], 0)
    return h[np.lexsort((h, rank))[: len(h) - (4 * len(h) + 4) // 5 + 1]] if len(h) else h


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and counts of shingles that several of a sample of documents hold. They only order the prefixes: any will do."""
    share = min(1.0, SAMPLED / max(1, docs.count()))
    some = docs.filter(F.pmod(F.xxhash64(F.lit(7), "text"), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.col("text").cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for x in b.column("t"):
                held.append(shingle_set(x.as_py() or b"").view(np.int64))
                size += len(held[-1])
                if size > CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held))], names=["h"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held))], names=["h"])

    found = mapped(some, run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 2").orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h, n = found.column("h").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def sketches(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, row, node, n, fp, bits, keys): a digest of a whole text's set of shingles, its size, SimHash, parity map and prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))
    kinds = {"node": pa.binary(), "n": pa.int64(), "fp": pa.int64(), "bits": pa.binary(), "keys": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = shared.value
        for b in batches:
            rows = []
            for x in b.column("t"):
                h = shingle_set(x.as_py() or b"")
                fp = majority(bit_counts(h), len(h)) if len(h) else 0
                rows.append((hashlib.blake2b(h.tobytes(), digest_size=16).digest(), len(h), fp - (1 << 64) if fp >> 63 else fp, parity_map(h), prefix(h, common, counts).tobytes()))
            own = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), *own], names=["doc_id", "row", *kinds])

    x = docs.select("doc_id", F.xxhash64(F.lit(5), "text").alias("row"), F.col("text").cast("binary").alias("t"))
    return mapped(x, run, "doc_id long, row long, node binary, n long, fp long, bits binary, keys binary")


def _split(rows: DataFrame, packed: str, name: str, own: list[str]) -> DataFrame:
    """Rows (name, own): one for each integer of eight bytes in ``packed``; own are integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(packed).to_pylist()
            values = np.frombuffer(b"".join(x), np.int64)
            times = [len(v) // 8 for v in x]
            owners = [np.repeat(b.column(c).to_numpy(), times) for c in own]
            for at in range(0, len(values), CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array(v[at : at + CHUNK]) for v in (values, *owners)], names=[name, *own])

    return mapped(rows.select(packed, *own), run, ", ".join(f"{c} long" for c in (name, *own)))


#: The last bits of an id tell the node's size, as a power of STEP; sets of 0.8 differ by NEAR_SIZES such steps at most.
SIZE_BITS, STEP, NEAR_SIZES = 12, 1.01, 24


def node_id() -> Column:
    """A hash of the node, whose last bits tell its size."""
    size = F.floor(F.log(F.col("n")) / F.log(F.lit(STEP)))
    return F.xxhash64("node").bitwiseAND(F.lit(-(1 << SIZE_BITS))).bitwiseOR(F.coalesce(size, F.lit(0)).cast("long"))


def _most(ids: np.ndarray) -> np.ndarray:
    """How many shingles the nodes of some ids have at most."""
    return np.ceil(STEP ** ((ids & ((1 << SIZE_BITS) - 1)) + 1)).astype(np.int64)


def of_near_sizes(ids: np.ndarray) -> np.ndarray:
    """The ids whose size is near that of another of them, in their order."""
    size = ids & ((1 << SIZE_BITS) - 1)
    order = np.argsort(size, kind="stable")
    close = np.diff(size[order]) <= NEAR_SIZES
    keep = np.zeros(len(ids), bool)
    keep[order[1:]] |= close
    keep[order[:-1]] |= close
    return ids[keep]


class _Blocks:
    """Cuts the ids of keys, which come in order, into blocks; ids alone with their key, or with ids of other sizes, are left out."""

    def __init__(self):
        self.key, self.rows = None, []
        self._open()
        self.at = 0

    def _open(self) -> None:
        self.ids, self.count, self.weight = [], 0, 0

    def _close(self, more: bool) -> None:
        if self.count > 1 or self.at or more:
            cut, ids = more or self.at > 0, np.concatenate(self.ids)
            ids = ids if cut else of_near_sizes(ids)
            if len(ids):
                self.rows.append((self.key, self.at, cut, ids.tobytes()))
            self.at += 1
        self._open()

    def add(self, key: int, ids: np.ndarray) -> None:
        n = _most(ids)
        if key != self.key:
            self.end()
            self.key = key
        while len(ids):
            fit = int(np.searchsorted(np.cumsum(n), BLOCK_SHINGLES - self.weight, "right"))
            take = min(len(ids), BLOCK_NODES - self.count, max(fit, 0 if self.count else 1))
            if take <= 0:
                self._close(True)
                continue
            self.ids.append(ids[:take])
            self.count += take
            self.weight += int(n[:take].sum())
            ids, n = ids[take:], n[take:]

    def end(self) -> None:
        if self.count:
            self._close(False)
        self.at = 0

    def out(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["g", "blk", "cut", "ids"])


def groups(rows: DataFrame) -> DataFrame:
    """Rows (g, blk, cut, ids): ids that share a key (columns h, id), packed and in order, in blocks; cut where a key has several.

    A set of one block is there once, however many keys its ids share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _Blocks()
        for b in batches:
            if not len(b):
                continue
            h, ids = (b.column(c).to_numpy() for c in ("h", "id"))
            starts = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
            ends = np.append(starts[1:], len(h))
            some = ends - starts > 1
            some[[0, -1]] = True  # the rest may be in the batches beside this one
            for s, e in zip(starts[some].tolist(), ends[some].tolist()):
                made.add(int(h[s]), ids[s:e])
            yield made.out()
        made.end()
        yield made.out()

    dealt = rows.select("h", "id").repartition(width(rows.sparkSession), "h").sortWithinPartitions("h", "id")
    found = mapped(dealt, run, "g long, blk long, cut boolean, ids binary")
    return found.withColumn("g", F.when(F.col("cut"), F.xxhash64(F.lit(1), "g")).otherwise(F.xxhash64("ids"))).distinct()


def _by_unit(rows: DataFrame, columns: list[str], found: Callable[..., Iterator[tuple]], made: dict[str, Callable] | None = None) -> DataFrame:
    """Rows (u, a, b) that ``found`` makes of the columns of all rows of a unit u, as lists; of columns in ``made``, of what it makes of each value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, [[] for _ in columns]

        def links() -> Iterator[pa.RecordBatch]:
            some = list(found(*held)) if len(held[0]) > 1 else []
            for at in range(0, len(some), CHUNK):
                part = some[at : at + CHUNK]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(part), pa.int64()), *(pa.array([p[i] for p in part], pa.binary()) for i in (0, 1))], names=["u", "a", "b"])

        for b in batches:
            if not len(b):
                continue
            u = b.column("u").to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(u[1:] != u[:-1]) + 1, [len(u)]]).tolist()
            for s, e in zip(cut, cut[1:]):
                if u[s] != key:
                    yield from links()
                    key, held = int(u[s]), [[] for _ in columns]
                for x, c in zip(held, columns):
                    f, part = (made or {}).get(c), b.column(c)[s:e]
                    x += [f(y.as_py()) for y in part] if f else part.to_pylist()
        yield from links()

    dealt = rows.select("u", *columns).repartition(width(rows.sparkSession), "u").sortWithinPartitions("u", "node")
    return mapped(dealt, run, "u long, a binary, b binary")


class _Maps:
    """Parity maps of several sets. Those of 0.8 have maps of one length, or of that and half of it, to which the longer one folds."""

    def __init__(self, maps: list[bytes]):
        self.size = np.array([len(x) for x in maps], np.int64)
        self.rows, self.maps = np.zeros((2, len(maps)), np.int64), {}  # each set's rows among the maps of its own length and of half of it
        for size in np.unique(self.size).tolist():
            at = np.flatnonzero(self.size == size)
            own = np.frombuffer(b"".join([maps[i] for i in at]), np.uint64).reshape(len(at), -1)
            self._add(0, size, at, own)
            if size > LEAST_MAP // 8:
                self._add(1, size // 2, at, own[:, : size // 16] ^ own[:, size // 16 :])

    def _add(self, kind: int, size: int, at: np.ndarray, own: np.ndarray) -> None:
        before = self.maps.get(size)
        self.rows[kind, at] = np.arange(len(at)) + (0 if before is None else len(before))
        self.maps[size] = own if before is None else np.concatenate([before, own])

    def differ(self, one: int, others: np.ndarray) -> np.ndarray:
        """In how many bits the map of one set differs from those of others, all of its length, twice or half of it."""
        out = np.zeros(len(others), np.int64)
        for size in (self.size[one] // 2, self.size[one]):
            some = np.minimum(self.size[others], self.size[one]) == size
            if some.any():
                maps, at = self.maps[int(size)], others[some]
                rows = np.where(self.size[at] == size, self.rows[0, at], self.rows[1, at])
                own = self.rows[0 if size == self.size[one] else 1, one]
                out[some] = np.bitwise_count(maps[rows] ^ maps[own]).sum(axis=1, dtype=np.int64)
        return out


def _can_be_near(n: np.ndarray, maps: _Maps, one: int, others: np.ndarray) -> np.ndarray:
    """False where sizes or parity maps rule out 0.8: sets that share that differ in a ninth of their sizes' sum at most."""
    both = n[others] + n[one]
    near = 9 * np.abs(n[others] - n[one]) <= both
    near[near] = 9 * maps.differ(one, others[near]) <= both[near]
    return near


def _possible(node: list[bytes], n: list[int], bits: list[bytes], root: list[int]) -> Links:
    """Rows (least node, node) of the components of a unit by pairs of different roots that can be near; those alone are left out."""
    n, maps, root, todo = np.array(n), _Maps(bits), np.array(root), np.arange(len(node))
    while len(todo) > 1:
        first, todo = int(todo[0]), todo[1:]
        front, alone = [first], True
        while front and len(todo):
            x = front.pop()
            other = np.flatnonzero(root[todo] != root[x])
            near = other[_can_be_near(n, maps, x, todo[other])]
            for y in todo[near].tolist():
                yield node[first], node[y]
                front.append(y)
                alone = False
            todo = np.delete(todo, near)
        if not alone:
            yield node[first], node[first]


def _shared(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets is 0.8 or more."""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def _spanning(node: list[bytes], sets: list[np.ndarray], root: list[int]) -> Links:
    """Verified links that span the components of a unit, in which rows of one root are joined from the start."""
    n, maps, root = np.array(list(map(len, sets))), _Maps([parity_map(x) for x in sets]), np.array(root)
    for x in range(len(node) - 1):
        others = np.flatnonzero(root[x + 1 :] != root[x]) + x + 1
        if len(others):
            others = others[_can_be_near(n, maps, x, others)]
        for y in others.tolist():
            if root[y] != root[x] and _shared(sets[x], sets[y]):
                yield node[x], node[y]
                root[root == root[y]] = root[x]


def _texts(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (node, t): a text of each of the nodes wanted, dealt by node."""
    first = written(nodes.join(wanted, "node", "left_semi").select(F.coalesce("least.doc_id", F.lit(NO_ID)).alias("_doc"), F.col("least.row").alias("_row"), "node"))
    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_doc"), F.xxhash64(F.lit(5), "text").alias("_row"), F.col("text").cast("binary").alias("t"))
    return sized_join(texts, first, ["_doc", "_row"], F.monotonically_increasing_id()).select("node", "t").dropDuplicates(["node"])


def _verified(docs: DataFrame, nodes: DataFrame, possible: DataFrame) -> DataFrame:
    """Links (a, b) among rows (u, node, root): pairs of a unit that have 0.8, as many as span its components.

    Texts are shuffled, which compress, and the sets are made of them where they meet.
    """
    texts = _texts(docs, nodes, possible.select("node").distinct())
    return written(_by_unit(possible.join(texts, "node"), ["node", "t", "root"], _spanning, {"t": shingle_set}).select("a", "b"))


def _simhash_units(nodes: DataFrame) -> DataFrame:
    """Rows (u, id) of SimHash components, in blocks picked by hash."""
    prints = written(nodes.groupBy("fp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s")))
    roots = components(covering_links(prints))
    of = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "c", "s", F.coalesce("root", "fp").alias("root"))
    total = of.groupBy("root").agg(F.sum("c").alias("all"), F.sum("s").alias("weight")).filter("all > 1")
    blocks = F.greatest(F.ceil(F.col("all") / BLOCK_NODES), F.ceil(F.col("weight") / BLOCK_SHINGLES))
    of = written(of.join(total.select("root", blocks.alias("blocks")), "root").select("fp", "c", "root", "blocks"))
    x = skew_join(nodes.select("id", "fp"), of, ["fp"], "c", nodes.count())
    return x.select(F.xxhash64(F.lit(2), "root", F.pmod("id", "blocks")).alias("u"), "id")


def _first_units(found: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (u, id): each id with one of its groups' blocks, the same as that of other ids like it in most cases, and the first ids of all blocks of a group."""
    one = ids.groupBy("id").agg(F.min(F.xxhash64("g", "blk")).alias("u")).select("u", "id")
    digits = F.hex(F.substring("ids", 1, 8))  # packed least byte first
    first = F.conv(F.concat(*(F.substring(digits, at, 2) for at in range(15, 0, -2))), 16, -10).cast("long")
    ahead = found.filter("cut").select(F.xxhash64(F.lit(3), "g", F.expr(f"blk div {BLOCK_NODES}")).alias("u"), first.alias("id"))
    return one.unionByName(ahead)


def _open_units(found: DataFrame, ids: DataFrame, at: DataFrame) -> DataFrame:
    """Rows (u, id) of the groups that still are of several roots; a group in blocks as all pairs of these that don't have one and the same."""
    x = ids.join(at.select("id", "root"), "id")
    several = x.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("g")
    x = written(x.join(several, "g", "left_semi"))
    whole = x.join(found.filter("NOT cut").select("g"), "g", "left_semi").select(F.xxhash64("g", "blk").alias("u"), "id")
    blocks = x.join(found.filter("cut").select("g").distinct(), "g", "left_semi")
    span = blocks.groupBy("g", "blk").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    other = span.select("g", F.col("blk").alias("blk2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = span.join(other, "g").filter("blk <= blk2 AND NOT (lo = hi AND lo2 = hi2 AND lo = lo2)")
    pairs = pairs.select("g", F.xxhash64("g", "blk", "blk2").alias("u"), F.explode(F.array_distinct(F.array("blk", "blk2"))).alias("blk"))
    return whole.unionByName(blocks.join(pairs, ["g", "blk"]).select("u", "id"))


def _bounded(star: DataFrame, at: DataFrame) -> DataFrame:
    """Rows (u, node, root) of stars (u, a, b): those of one least node a are one unit, so that texts come together once, where they all fit into two blocks."""
    x = star.select("u", F.xxhash64("a").alias("a"), F.col("b").alias("node")).join(at.select("node", "n", "root"), "node")
    x = written(x)
    own = x.dropDuplicates(["a", "node"])
    most = own.groupBy("a").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s")).filter((F.col("c") > 2 * BLOCK_NODES) | (F.col("s") > 2 * BLOCK_SHINGLES)).select("a")
    most = written(most)
    small = own.join(most, "a", "left_anti").select(F.col("a").alias("u"), "node", "root")
    return small.unionByName(x.join(most, "a", "left_semi").select(F.xxhash64("u", "a").alias("u"), "node", "root").distinct())


def near_links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) that span the components of nodes: pairs whose sets have a Jaccard similarity of 0.8 or more, and no others."""
    at = nodes.filter("n > 0").select("id", "node", "n", "bits", "keys", "fp")
    found = written(groups(_split(at, "keys", "h", ["id"])))
    ids = _split(found, "ids", "id", ["g", "blk"])
    light = at.drop("keys", "fp").withColumn("root", F.col("id"))
    units = _simhash_units(at).unionByName(_first_units(found, ids)).distinct()
    star = _by_unit(units.join(light, "id"), ["node", "n", "bits", "root"], _possible)
    some = written(star.select(F.xxhash64("u", "a").alias("u"), F.col("b").alias("node")).join(light.select("node", "root"), "node"))
    links = _verified(docs, nodes, some)
    # what these left apart
    roots = components(links)
    now = written(light.drop("root").join(roots, "node", "left").withColumn("root", F.xxhash64(F.coalesce("root", "node"))))
    units = _open_units(found, ids, now)
    star = _by_unit(units.join(now, "id"), ["node", "n", "bits", "root"], _possible)
    return links.unionByName(_verified(docs, nodes, _bounded(star, now)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of documents, without all but the smallest doc_id of each group of near-duplicates.

    Texts are linked if the Jaccard similarity of their sets of distinct shingles of five words is 0.8 or more; groups
    are closed transitively. Null, empty and blank texts are one group. Of rows with one doc_id and text one stays. A
    null doc_id counts as the largest. Columns of any name stay as they are.
    """
    spark = docs.sparkSession
    last, id_, row = F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(NO_ID)), F.xxhash64(F.lit(5), "text")
    with shuffles_freed(spark):
        full, path = written_at(sketches(docs))
        made = written(full.select("doc_id", "row", "node"))
        nodes = full.groupBy("node").agg(F.min(F.struct(last, "doc_id", "row")).alias("least"), F.count(F.lit(1)).alias("c"), *(F.first(x).alias(x) for x in ("n", "fp", "bits", "keys")))
        nodes = written(nodes.withColumn("id", node_id()))
        erase(spark, path)
        roots = components(near_links(docs, nodes))
        named = nodes.select("node", "least", "c").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        kept = named.groupBy("root").agg(F.min("least").alias("k"), F.count(F.lit(1)).alias("m"))
        of = written(skew_join(named.select("root", "node", "c"), kept, ["root"], "m", nodes.count()).select("node", "c", "k"))
        rows = skew_join(made.select("node", id_.alias("_id"), F.col("row").alias("_row")), of, ["node"], "c", made.count())
        rows = rows.groupBy("_id", "_row").agg(F.count(F.lit(1)).alias("times"), F.first(F.coalesce("k.doc_id", F.lit(NO_ID))).alias("kid"), F.first("k.row").alias("krow"))
        rows = written(rows.select("_id", "_row", ((F.col("_id") == F.col("kid")) & (F.col("_row") == F.col("krow"))).alias("stays"), "times").filter("NOT stays OR times > 1"))
    x = docs.select(F.struct("*").alias("_own"), id_.alias("_id"), row.alias("_row"))
    alone = sized_join(x, rows.select("_id", "_row"), ["_id", "_row"], F.monotonically_increasing_id(), "left_anti")
    again = rows.filter("stays").select("_id", "_row")
    if again.isEmpty():
        return alone.select("_own.*")
    one = sized_join(x, again, ["_id", "_row"], F.monotonically_increasing_id(), "left_semi").dropDuplicates(["_id", "_row"])
    return alone.unionByName(one).select("_own.*")
