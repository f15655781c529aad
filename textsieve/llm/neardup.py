"""Near-duplicates of word shingles by an LSH forest, confirmed on full sets.

Words are runs of anything but ASCII white space after A-Z became a-z; a document's set is its distinct shingles of so
many words (with fewer words, the whole sequence; without words, nothing). Documents with equal sets are one class from
the start: one node, whose copies are never compared.

A node has TREES * DEPTH minimum hashes. Tree t orders all nodes by their hashes from the t-th group on, around the
ring, so an order can be followed to any depth. Nodes that share the first DEPTH hashes of an order form a region; a
pair of similarity 0.8 shares none of the 48 regions with a chance of about 5e-7.

1. Neighbours: within a region the order goes on with the following hashes, so that the neighbours of a node have the
   longest prefixes in common with it. Orders are range-partitioned, so a crowded region is spread over many tasks. Each
   node's BEST neighbours (most trees, then longest prefix) are confirmed and joined to components.
2. Depth by region: a region whose nodes are all in one component is done. Where several components meet, FEW nodes or
   less are compared in pairs. A more crowded region is split further: more minimum hashes can't do that, as texts of
   similarity 0.75 share them nearly as often as texts of 0.8. Its node with the most company becomes the pivot, to
   which every other is compared. Then a node goes on, in a region of the next level each, under the shingles by which
   it can still be linked across components (see `_deeper`), and these smaller regions are treated in the same way,
   until none is crowded. As a shingle outside the core is in at most half of the members drawn for it, a region has
   about half of the nodes of the one above it at most; each level draws anew, so one unlucky draw does not last.

A pair is first compared by bitmaps of its sets, 8 bits a shingle: they differ in no more bits than the sets do in
shingles, so a pair whose bitmaps differ too much for the threshold is none, without doubt. The others are confirmed on
full sets. No region is cut or capped, and pairs inside a component, however large, are never listed.

Shingles are 64-bit hashes, and so are nodes. Defined cases: a null or empty text has the empty set and is linked with
nothing; rows with a null id take part and get the smallest id of their component (null if there is none); repeated rows
are one node; documents share a component if they are reachable by links; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textsieve.llm.bytehash import NOT_SPACE, mix, raw, slices, word_hashes
from textsieve.llm.common import Workspace, bitmap, connected_components, split_by_keys, texts

TREES, DEPTH, MORE, BEST = 48, 6, 2, 3
HASHES = TREES * DEPTH
FEW, SAMPLE = 8, 64
BATCH_BYTES = 4 << 20
RARITY_BITS = 16
DEEPER = {"kind": np.int32, "key": np.int64, "group": np.int64, "node": np.int64, "root": np.int64, "n": np.int32, "room": np.float64, "mask": np.int64}
_rng = np.random.Generator(np.random.PCG64(71))
_A = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    data, offsets = raw(column)
    h, owner = word_hashes(data, offsets, NOT_SPACE)
    begins = np.searchsorted(owner, np.arange(len(offsets)))
    n = len(h) - size + 1
    g = np.zeros(max(n, 0), np.uint64)
    for k in range(size):
        g += h[k : k + len(g)] * _STEP[k % 64]
    g = mix(g)
    for i, j in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if j - i >= size:
            yield np.unique(g[i : j - size + 1])
        elif j > i:  # fewer words: the sequence, marked by its length
            x = np.uint64(0)
            for k in range(j - i):
                x = x + h[i + k] * _STEP[k % 64]
            yield mix(np.array([x + np.uint64(j - i)], np.uint64))
        else:
            yield np.empty(0, np.uint64)


def node_of(s: np.ndarray) -> int | None:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)) if len(s) else None


def signature(s: np.ndarray) -> np.ndarray:
    """Minimum hashes, 32 bits each."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        np.minimum(low, (s[i : i + 2048, None] * _A + _B).min(0), out=low)
    return low >> np.uint64(32)


def _regions(sig: np.ndarray) -> np.ndarray:
    """Of signatures (n, HASHES): the region in each tree, a hash of the tree and its first DEPTH hashes."""
    first = np.zeros((len(sig), TREES), np.uint64) + np.arange(1, TREES + 1, dtype=np.uint64)
    for k in range(DEPTH):
        first = mix(first * _STEP[k] + sig[:, k::DEPTH])
    return first.view(np.int64)


def _list_array(values: np.ndarray, lengths: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(values))


def _signed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in (part for b in batches for part in slices(b, "text", BATCH_BYTES)):
                sizes, nodes, regions = [], [], []
                for s in shingle_sets(batch.column("text"), size):
                    sizes.append(len(s))
                    nodes.append(node_of(s))
                    if len(s):
                        regions.append(signature(s))
                flat = _regions(np.stack(regions)).ravel() if regions else np.empty(0, np.int64)
                columns = [batch.column("doc_id"), batch.column("mark"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), _list_array(flat, [TREES * (n > 0) for n in sizes])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "n", "node", "regions"])

    return run


def _unpacked(words: tuple[int, DataFrame]) -> np.ndarray:
    """A bitmap's words of 64 bits; 2^MAP_BITS of `common` at most."""
    bits, table = words
    out, found = np.zeros(1 << (bits - 6), np.uint64), table.toArrow()
    out[found["w"].to_numpy()] = found["m"].to_numpy().view(np.uint64)
    return out


def set_bits(s: np.ndarray) -> bytes:
    """A bitmap of a set, a power of two of 8 bits a shingle or more; the low bits of a hash are its place."""
    m = 1 << max(6, (8 * len(s) - 1).bit_length())
    out = np.zeros(m, np.uint8)
    out[(s & np.uint64(m - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def differing_bits(x: bytes, y: bytes) -> int:
    """In how many bits two bitmaps differ, the larger one folded to the size of the smaller."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    n = min(len(a), len(b))
    a, b = (np.bitwise_or.reduce(v.reshape(-1, n), 0) for v in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def _sets(size: int, sent):
    """Of the texts whose ids' hashes are marked: the node, the set, its bitmap, and in each tree the region and the next
    MORE hashes as one number."""

    def packed(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        sig = np.stack([signature(s) for s in sets]) if sets else np.empty((0, HASHES), np.uint64)
        ring = np.roll(sig, -DEPTH, 1)
        labels = ((ring[:, ::DEPTH] << np.uint64(32)) | ring[:, 1::DEPTH]).view(np.int64)
        values = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
        each = [TREES] * len(sets)
        columns = [pa.array(ids, pa.int64()), pa.array([node_of(s) for s in sets], pa.int64()), _list_array(values, [len(s) for s in sets]), pa.array([set_bits(s) for s in sets], pa.binary()), _list_array(_regions(sig).ravel(), each), _list_array(labels.ravel(), each)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "set", "bits", "regions", "labels"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        shift = np.uint64(64 - (len(words).bit_length() - 1) - 6)
        with np.errstate(over="ignore"):
            for batch in batches:
                at = batch.column("h").to_numpy().view(np.uint64) >> shift
                hit = (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
                for part in slices(batch.filter(pa.array(hit)), "text", BATCH_BYTES):
                    ids, sets, total = [], [], 0
                    for i, s in zip(part.column("doc_id").to_pylist(), shingle_sets(part.column("text"), size), strict=True):
                        if len(s):
                            ids.append(i)
                            sets.append(s)
                            total += len(s)
                        if total > 1 << 18:
                            yield packed(ids, sets)
                            ids, sets, total = [], [], 0
                    yield packed(ids, sets)

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that follow each other in sorted rows, with how many more hashes they share; kind 1 marks the partition's
    first and last row, to be paired later."""
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    names = ["kind", "a", "b", "depth", "region", "label"]
    last = first = None
    for batch in batches:
        node, region, label = (batch.column(c).to_numpy() for c in ("node", "region", "label"))
        if not len(node):
            continue
        if last is not None:
            node, region, label = (np.concatenate(([x], y)) for x, y in zip(last, (node, region, label), strict=True))
        first = first or (node[0], region[0], label[0])
        last = (node[-1], region[-1], label[-1])
        i = np.flatnonzero(region[1:] == region[:-1])
        depth = (label[i] == label[i + 1]).astype(np.int32) + (label[i] >> 32 == label[i + 1] >> 32)
        zero = np.zeros(len(i), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((zero, node[i], node[i + 1], depth, region[i], label[i]), kinds, strict=True)], names)
    if first is not None:
        rows = [(1, int(x[0]), None, 0, int(x[1]), int(x[2])) for x in (first, last)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def _alike(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("x", "y", "nx", "ny"))
            keep = pa.array([(100 + percent) * differing_bits(x, y) <= (100 - percent) * (nx + ny) for x, y, nx, ny in zip(*columns, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int, work: Workspace) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on full sets; bitmaps come first and leave few others."""

    def sides(df: DataFrame, *columns: Column) -> DataFrame:
        own = lambda node, x: sets.select(F.col("node").alias(node), *(c.alias(f"{n}{x}") for n, c in zip(("", "n"), columns)))
        return df.join(own("a", "x"), "a").join(own("b", "y"), "b")

    bits = sides(pairs.select("a", "b"), F.col("bits"), F.size("set")).select("a", "b", "x", "y", "nx", "ny")
    likely = work.write(bits.mapInArrow(_alike(percent), "a long, b long"), "likely")
    both = F.size(F.array_intersect("x", "y"))
    xy = sides(likely, F.col("set")).withColumn("both", both).where(100 * F.col("both") >= percent * (F.size("x") + F.size("y") - F.col("both")))
    return xy.select("a", "b")


def _rarity(sets: DataFrame) -> np.ndarray:
    """How many shingles of sets hash to each of 2^RARITY_BITS buckets: a fixed size for any number of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << RARITY_BITS, np.int64)
        for batch in batches:
            n += np.bincount(_bucket(batch.column(0).flatten().to_numpy().view(np.uint64)), minlength=len(n))
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n[k])], ["k", "n"])

    out = np.zeros(1 << RARITY_BITS, np.int64)
    found = sets.select("set").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # 2^RARITY_BITS rows at most
    out[found["k"].to_numpy()] = found["n"].to_numpy()
    return out


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - RARITY_BITS)).astype(np.int64)


def _consensus(members: DataFrame, sets: DataFrame, level: int) -> DataFrame:
    """(group, core) for members (group, node, m): the shingles of more than half of about SAMPLE members of each group.

    What follows holds for any core; a good one only makes the next regions small.
    """
    drawn = members.where(F.pmod(F.xxhash64("node", F.lit(level)), F.ceil(F.col("m") / SAMPLE)) == 0)
    drawn = drawn.select("group", "node").join(sets.select("node", "set"), "node")
    n = drawn.groupBy("group").agg(F.count(F.lit(1)).alias("drawn"))
    each = drawn.select("group", F.explode("set").alias("shingle")).groupBy("group", "shingle").agg(F.count(F.lit(1)).alias("c"))
    return each.join(n, "group").where("2 * c > drawn").groupBy("group").agg(F.collect_list("shingle").alias("core"))  # 2 mean set sizes at most


def _size_class(n: int) -> int:
    """Sizes within an eighth of each other, about."""
    return int(8 * math.log(max(n, 1)))


def _deeper(sent, percent: int):
    """Where a member of a group, set x, goes on, given a core P that all members share: A = x - P, R = P - x.

    A link needs 0.8 of the larger set in common, so of the first |x| - 0.8 |x| + 1 shingles of x in one order for all,
    one is among those of its partner. The order puts A before what lies in P, and rare shingles first. So x is placed
    under the first of A (kind 0).

    If A has fewer shingles than that (x is near), a link to a near y that has no shingle of A in common lies within P:
    |P| - |R(x) u R(y)| >= c (|x| + |y|), c = 0.8 / 1.8. With room(x) = |P| - |R(x)| - c |x| that is
    c |y| + |R(y) - R(x)| <= room(x). Near members are listed by a class of sizes (kind 1), and those outside the pivot's
    component under each class that leaves them room (kind 2). A mask of R in 64 bits bounds |R(y) - R(x)| from below.
    """
    c = percent / (100 + percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = sent.value
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            out: list[list[np.ndarray]] = [[] for _ in DEEPER]
            columns = (batch.column(k) for k in ("group", "node", "root", "outside", "x", "core"))
            for group, node, root, outside, x, core in zip(*(v.to_pylist() if k < 4 else v for k, v in enumerate(columns)), strict=True):
                x = np.sort(x.values.to_numpy().view(np.uint64))
                core = np.sort(core.values.to_numpy().view(np.uint64)) if core.is_valid else np.empty(0, np.uint64)
                more, less = np.setdiff1d(x, core, True), np.setdiff1d(core, x, True)
                first = len(x) + (-percent * len(x)) // 100 + 1
                top = more[np.lexsort((more, rarity[_bucket(more)]))][:first]
                room = len(core) - len(less) - c * len(x)
                mask = int(np.bitwise_or.reduce(np.uint64(1) << (less & np.uint64(63)), initial=np.uint64(0)).view(np.int64))
                mine = [(0, mix(top + mix(np.array([group], np.int64).view(np.uint64))).view(np.int64))]
                if len(more) < first:
                    mine.append((1, np.array([_size_class(len(x))])))
                    if outside:
                        least, most = -(-percent * len(x) // 100), min(int((room + 1e-9) / c), len(x) * 100 // percent)
                        mine.append((2, np.arange(_size_class(least), _size_class(most) + 1 if most >= least else 0)))
                for kind, keys in mine:
                    values = (kind, keys, group, node, root, len(x), room, mask)
                    for column, v, t in zip(out, values, DEEPER.values(), strict=True):
                        column.append(v if v is keys else np.full(len(keys), v, t))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else np.empty(0, t), pa.from_numpy_dtype(t)) for v, t in zip(out, DEEPER.values(), strict=True)], list(DEEPER))

    def quiet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            yield from run(batches)

    return quiet


def _within_core(deeper: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of near members of different components that have room for a link within the core."""
    c = percent / (100 + percent)
    side = lambda k, s: deeper.where(F.col("kind") == k).select("group", F.col("key").alias("sizes"), *(F.col(v).alias(f"{v}_{s}") for v in ("node", "root", "n", "room", "mask")))
    fits = lambda x, y: c * F.col(f"n_{y}") + F.bit_count(F.col(f"mask_{y}").bitwiseAND(F.bitwise_not(f"mask_{x}"))) <= F.col(f"room_{x}") + 1e-6
    met = side(2, "x").join(side(1, "y"), ["group", "sizes"]).where((F.col("root_x") != F.col("root_y")) & fits("x", "y") & fits("y", "x"))
    return met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, mark, n, node, root, component_id) for every row of docs; mark is xxhash64 of the text."""
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "neardup")
    rows = texts(docs).withColumn("mark", F.xxhash64("text"))
    signed = work.write(rows.mapInArrow(_signed(shingle), "doc_id long, mark long, n long, node long, regions array<bigint>"), "signed")
    placed = signed.select("node", F.explode("regions").alias("region"))
    shared = placed.groupBy("region").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("region")
    shared = work.write(shared, "shared")
    wanted = placed.join(shared, "region").select("node").distinct()
    reps = work.write(signed.select("node", "doc_id").join(wanted, "node").groupBy("node").agg(F.min("doc_id").alias("rep")), "reps")
    sent = spark.sparkContext.broadcast(_unpacked(bitmap(reps.select(F.xxhash64("rep").alias("k")))))
    made = rows.select("doc_id", F.xxhash64("doc_id").alias("h"), "text").mapInArrow(_sets(shingle, sent), "doc_id long, node long, set array<bigint>, bits binary, regions array<bigint>, labels array<bigint>")
    made = made.join(reps, "node").where(F.col("doc_id").eqNullSafe(F.col("rep"))).drop("doc_id", "rep")
    sets = work.write(made.dropDuplicates(["node"]), "sets")
    orders = sets.select("node", F.explode(F.arrays_zip("regions", "labels")).alias("o")).select("node", F.col("o.regions").alias("region"), F.col("o.labels").alias("label"))
    orders = work.write(orders.join(shared, "region").select("node", "region", "label"), "orders")

    # 1. neighbours in the sorted orders
    sorted_rows = orders.repartitionByRange("region", "label", "node").sortWithinPartitions("region", "label", "node").select("node", "region", "label")
    found = work.write(sorted_rows.mapInArrow(_neighbours, "kind int, a long, b long, depth int, region long, label long"), "neighbours")
    across = Window.orderBy("region", "label", "a")  # two rows of each partition
    edge = found.where("kind = 1").dropDuplicates(["region", "label", "a"]).withColumn("p", F.lag(F.struct("region", "a")).over(across)).where("p.region = region").select("a", F.col("p.a").alias("b"), F.lit(0).alias("depth"))
    pairs = found.where("kind = 0").select("a", "b", "depth").union(edge).where("a <> b")
    pairs = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("trees"), F.sum("depth").alias("depth"))
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "trees", "depth"))
    mine = Window.partitionBy("a").orderBy(F.col("trees").desc(), F.col("depth").desc(), "b")  # 2 * TREES neighbours at most
    best = both.withColumn("k", F.row_number().over(mine)).where(F.col("k") <= BEST).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    roots = work.write(connected_components(_confirm(best, sets, percent, work), work), "roots")
    work.drop("neighbours", "shared", "cc0", "likely")

    # 2. regions where components meet, level by level
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    regions, more, level, rarity = orders.select("region", "node"), None, 0, None
    while True:
        step = work.again()

        def rooted(df: DataFrame, node: str = "node", root: str = "root") -> DataFrame:
            return df.join(roots.select(F.col("node").alias(node), F.col("root").alias(root)), node, "left").withColumn(root, F.coalesce(root, node))  # noqa: B023

        inside = step.write(rooted(regions), "inside")
        mixed = inside.groupBy("region", "root").agg(F.count(F.lit(1)).alias("c"), F.sum(F.xxhash64("node") % (1 << 40)).alias("h"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x"))
        mixed = mixed.groupBy("region").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("same"), F.sum("h").alias("h"), F.bit_xor("x").alias("x"), F.max(F.struct("c", "root")).alias("top"))
        mixed = step.write(mixed.select("region", "m", "h", "x", F.col("top.root").alias("top"), ((F.col("m") * F.col("m") - F.col("same")) / 2).alias("cross")).where("cross > 0"), "mixed")
        total = mixed.agg(F.sum("cross"), F.sum("m")).first()
        if not total[1] and more is None:
            break
        every = (total[0] or 0) <= FEW * (total[1] or 0)
        few = F.lit(True) if every else F.col("cross") <= FEW * F.col("m")
        once = mixed.groupBy("m", "h", "x").agg(F.min(F.struct("region", "top", few.alias("few"))).alias("r")).select("r.*", "m")  # regions of the same nodes (count, sum and parity of 104 hashed bits) are one
        inside = step.write(inside.join(once, "region"), "open")
        # of each pair one is outside the largest component: no region is joined with itself
        left = inside.where("few and root <> top").select("region", F.col("node").alias("a"), F.col("root").alias("ra"))
        right = inside.where("few").select("region", F.col("node").alias("b"), F.col("root").alias("rb"), (F.col("root") == F.col("top")).alias("inner"))
        tests = left.join(right, "region").where("ra <> rb and (inner or a < b)").select(*pair("a", "b"))
        large = inside.where("not few")
        members = None
        if not every and large.limit(1).count():
            mine = Window.partitionBy("node")  # TREES rows of a node at most
            placed = step.write(large.select("region", "node", F.struct(F.sum("m").over(mine).alias("company"), "node").alias("p")), "large")
            pivots = placed.groupBy("region").agg(F.max("p").alias("p"))
            if level == 0:  # regions with the same pivot are one group; a region takes the best pivot of its nodes
                placed = placed.drop("p").join(pivots, "region").withColumn("p", F.max("p").over(mine))
                pivots = placed.groupBy("region").agg(F.max("p").alias("p"))
            # later each stays alone, so that groups shrink
            placed = placed.select("region", "node").join(pivots.select("region", F.col("p.node").alias("pivot")), "region")
            members = step.write(placed.select((F.col("pivot") if level == 0 else F.col("region")).alias("group"), "pivot", "node").distinct(), "members")
            tests = tests.union(rooted(rooted(members), "pivot", "rp").where("root <> rp").select(*pair("pivot", "node")))
        if more is not None:
            tests = tests.union(rooted(rooted(more, "a", "ra"), "b", "rb").where("ra <> rb").select("a", "b"))
        links = step.write(_confirm(tests.distinct(), sets, percent, step), "links")
        if links.limit(1).count():
            roots = work.write(connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links), step), f"roots{level}")
        if members is None:
            break
        placed = rooted(rooted(members), "pivot", "rp").select("group", "node", "root", (F.col("root") != F.col("rp")).alias("outside"))
        placed = step.write(placed, "placed")
        still = placed.groupBy("group").agg(F.max("outside").alias("any"), F.count(F.lit(1)).alias("m")).where("any").select("group", "m")
        placed = step.write(placed.join(still, "group"), "left")
        cores = _consensus(placed, sets, level)
        rarity = spark.sparkContext.broadcast(_rarity(sets)) if rarity is None else rarity
        with_sets = placed.join(sets.select("node", F.col("set").alias("x")), "node").join(cores, "group", "left")
        kinds = "kind int, key long, group long, node long, root long, n int, room double, mask long"
        deeper = step.write(with_sets.select("group", "node", "root", "outside", "x", "core").mapInArrow(_deeper(rarity, percent), kinds), "deeper")
        more = work.write(_within_core(deeper, percent), f"more{level}")
        lists = deeper.where("kind = 0").select(F.col("key").alias("region"), "node", "root")
        useful = lists.groupBy("region").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("region")
        regions = work.write(lists.join(useful, "region").select("region", "node").distinct(), f"regions{level}")
        step.clear()
        level += 1
    work.drop("orders", "sets")
    named = signed.select("doc_id", "mark", "n", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = work.write(named.select("doc_id", "mark", "n", "node", "root"), "named")
    least = named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return named.join(least, "root", "left").select("doc_id", "mark", "n", "node", "root", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: that of the smallest id. Rows without words all stay, rows that repeat in full once.

    Only rows that may have to go are joined; the others' texts are not moved.
    """
    work = Workspace(docs.sparkSession, "keepone")
    found = work.write(near_duplicates(docs, shingle, percent), "found")
    # of rows that repeat an id, the one whose text hashes lowest
    one = found.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("m"))
    judged = found.where("root is not null").groupBy("root", "doc_id", "mark").agg(F.count(F.lit(1)).alias("n")).join(one, "root")
    stays = F.col("doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("mark") == F.col("m.mark"))
    judged = judged.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), stays.alias("_stays"), "n").where("n > 1 or not _stays")
    judged = work.write(judged.groupBy("_id", "_mark").agg(F.max("_stays").alias("_stays")), "judged")
    work.drop("found")
    names = docs.columns
    rows = docs.toDF(*(f"c{k}" for k in range(len(names))))  # by position, so that no name can clash
    doc_id, text = (F.col(f"c{names.index(c)}") for c in ("doc_id", "text"))
    others, maybe = split_by_keys(rows, F.xxhash64(doc_id.cast("long")), judged.select(F.xxhash64("_id").alias("k")))
    condition = doc_id.cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_mark"))
    untouched = maybe.join(judged, condition, "left").where("_stays is null").select(*rows.columns)
    once = maybe.join(judged.where("_stays"), condition, "left_semi").dropDuplicates([f"c{names.index(c)}" for c in ("doc_id", "text")])
    return others.unionByName(untouched).unionByName(once).toDF(*names)
