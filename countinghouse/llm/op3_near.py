"""MinHash near-dedup over an LSH forest.

1. Each document's set of word shingles becomes a digest, a size and a
   signature of TREES x DEPTH min-hashes. Equal sets collapse to one node, the
   smallest doc_id that has the set, so copies never make pairs.
2. Every tree sorts the nodes by its own DEPTH min-hashes. Nodes with a common
   prefix are a region; in the sorted order a node's neighbours are those with
   the longest common prefix, so a region of up to WINDOW + 1 nodes is compared
   whole at depth 1, and a crowded one at whatever depth leaves so few. In
   crowded regions each node also meets the region's smallest doc_id at
   several depths. The order is range partitioned, so that no region, however
   large, lies in one task; rows at the edges of partitions meet in a second,
   small step, across partitions of few rows or none. Then each region of depth 1 that is larger than WINDOW + 1 and
   whose nodes these steps left in several families is compared whole, by
   pairs of blocks: two nodes with a first min-hash in common always meet.
3. Neighbours whose sizes or whole signatures rule a link out (a signature five
   standard deviations below the threshold) go. The rest join nodes into
   families, in which all links lie; a task hands on only a node's family, not
   its pairs. A family of bounded size is compared whole, on full sets, in one
   pass over their shared shingles: this finds the one link of a text that is
   almost, but not quite, similar enough to hundreds. A larger family is first
   compared by stretches of the orders of BIG_TREES trees, which joins most of
   it; what stays apart is divided into blocks of half the bounded size, and all
   pairs of blocks whose nodes aren't yet joined are dealt to tasks. So classes
   within a family depend neither on its size nor on partitions.
4. Links join into components; the smallest doc_id stands for each.

A pair with similarity 0.8 shares the first min-hash of a tree with
probability 0.8, so all of 8 trees miss it with probability 2.6e-6.

Defined results: a document without words or text has an empty set, links with
nothing and is kept; a row without an id is alone, kept, with a null
component_id; rows that repeat a doc_id and its text share a set and a result;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions, table
from .graph import components
from .words import Hasher, lower_table, mix, run_starts, spaced_table, text_chunks, word_spans

TREES, DEPTH, WINDOW = 8, 8, 8
LEADER_DEPTHS = (1, 2, 4, 8)
PERCENT = 80
#: Of TREES * DEPTH min-hashes, the least that must agree for a pair to be confirmed: 4.8 standard deviations below 80 %.
LEAST_AGREEING = 36
#: Nodes that a task sorts and compares at a time, and nodes a partition of the order should have at least.
BLOCK_NODES, LEAST_NODES = 1 << 16, 1024
#: Nodes of a block of a crowded region.
REGION_NODES = 8192
#: Families that are compared in one piece have at most so many nodes, and shingles in all; pairs of blocks of larger ones too, about.
FAMILY_NODES, FAMILY_SHINGLES = 4096, 2_000_000
#: Orders in which a larger family is compared by stretches before its blocks are.
BIG_TREES = 4
#: Shingles of more nodes of a family than this are counted by a matrix product.
_DENSE = 48
_DIGEST = "set_a long, set_b long"
_TREE = "tree int, prefix binary, node long, size long, mini binary"


def _multipliers(n: int):
    seed = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seed[:n] | np.uint64(1), seed[n:]


def shingle_sets(column, width: int):
    """For each chunk of a column of texts: (first row, end row, sorted distinct shingle hashes, edges by row)."""
    hasher, spaced, lower = Hasher(), spaced_table(), lower_table()
    for lo, hi, data, offsets in text_chunks(column):
        data = lower[data]
        starts, ends, bounds = word_spans(data, offsets, spaced)
        first, last, docs = run_starts(bounds, width, short=True)
        hashes = hasher.of_runs(hasher.of_words(data, starts, ends), first, last)
        edge = np.searchsorted(docs, np.arange(hi - lo + 1))
        sets = [np.unique(hashes[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
        sizes = np.array([len(s) for s in sets], np.int64)
        yield lo, hi, (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.append(0, np.cumsum(sizes))


def _features(width: int):
    def run(batches):
        a, b = _multipliers(TREES * DEPTH)
        for batch in batches:
            for lo, hi, hashes, edges in shingle_sets(batch["text"], width):
                sizes = np.diff(edges)
                has = np.flatnonzero(sizes)
                digest = np.zeros((2, hi - lo), np.uint64)
                signature = np.zeros((hi - lo, TREES * DEPTH), ">u4")
                if len(has):
                    at = edges[:-1][has]
                    digest[0, has] = np.add.reduceat(mix(hashes), at)
                    digest[1, has] = np.add.reduceat(mix(hashes ^ np.uint64(0xA0761D6478BD642F)), at)
                    for k in range(TREES * DEPTH):
                        signature[has, k] = np.minimum.reduceat(hashes * a[k] + b[k], at) >> np.uint64(32)
                empty = sizes == 0
                blobs = [s.tobytes() for s in signature]
                columns = [batch["doc_id"][lo:hi], pa.array(sizes)]
                columns += [pa.array(d.view(np.int64), mask=empty) for d in digest] + [pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_a", "set_b", "signature"])

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def features(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, the set's digest (null if empty) and its signature, a row for each row of docs."""
    return _rows(docs).mapInArrow(_features(width), f"doc_id long, n_shingles long, {_DIGEST}, signature binary")


def _order(nodes: DataFrame) -> DataFrame:
    """The nodes once for each tree, in the tree's order, over partitions that have all about as many."""
    n = max(1, min(partitions(nodes.sparkSession), TREES * nodes.count() // LEAST_NODES))
    bytes_ = 4 * DEPTH
    # Of each min-hash the last byte, which is enough to estimate how many agree.
    mini = F.unhex(F.regexp_replace(F.hex("signature"), "......(..)", "$1"))
    trees = nodes.select("node", "size", "signature", mini.alias("mini")).select(
        F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "node", "size", "signature", "mini"
    )
    rows = trees.select("tree", F.expr(f"substring(signature, tree * {bytes_} + 1, {bytes_})").alias("prefix"), "node", "size", "mini")
    return rows.repartitionByRange(n, "tree", "prefix", "node").sortWithinPartitions("tree", "prefix", "node")


class _Nodes:
    """Sorted rows of the order as arrays."""

    def __init__(self, batch):
        n = len(batch)
        self.tree = batch["tree"].to_numpy()
        self.node, self.size = batch["node"].to_numpy(), batch["size"].to_numpy()
        self.prefix = np.frombuffer(b"".join(batch["prefix"].to_pylist()), ">u4").reshape(n, DEPTH)
        self.mini = np.frombuffer(b"".join(batch["mini"].to_pylist()), np.uint8).reshape(n, TREES * DEPTH)

    def common(self) -> np.ndarray:
        """How many min-hashes each row shares with the row before it; 0 across trees."""
        same = np.logical_and.accumulate(self.prefix[1:] == self.prefix[:-1], axis=1).sum(axis=1)
        return np.append(0, np.where(self.tree[1:] == self.tree[:-1], same, 0))

    def likely(self, i, j):
        """Those of the pairs of rows that sizes and signatures leave possible, as (a, b), a < b."""
        keep = (self.node[i] != self.node[j]) & (100 * np.minimum(self.size[i], self.size[j]) >= PERCENT * np.maximum(self.size[i], self.size[j]))
        i, j = i[keep], j[keep]
        keep = (self.mini[i] == self.mini[j]).sum(axis=1) >= LEAST_AGREEING
        a, b = self.node[i[keep]], self.node[j[keep]]
        return np.minimum(a, b), np.maximum(a, b)

    def neighbours(self):
        common, reach, out = self.common(), None, []
        for step in range(1, min(WINDOW, len(self.node) - 1) + 1):
            # Rows i and i + step share what all steps between them share.
            reach = common[1:] if reach is None else np.minimum(reach[:-1], common[step:])
            i = np.flatnonzero(reach > 0)
            out.append(self.likely(i, i + step))
        return out

    def leaders(self):
        common, out, first = self.common(), [], []
        for depth in LEADER_DEPTHS:
            new = common < depth
            start = np.flatnonzero(new)
            region = np.cumsum(new) - 1
            least = np.minimum.reduceat(self.node, start)[region]
            at = np.flatnonzero(self.node == least)
            lead = at[np.unique(region[at], return_index=True)[1]]
            crowded = np.diff(np.append(start, len(new)))[region] > WINDOW + 1
            i = np.flatnonzero(crowded)
            out.append(self.likely(i, lead[region[i]]))
            first.append(int(lead[-1]))
        return out, first


def spanned(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of some sorted distinct nodes the smallest that pairs (a, b) reach from it."""
    a, b = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return nodes[label]
        label = new


def _links(found):
    """Pairs (root, node) that join what pairs (a, b) join, a row a node at most."""
    a, b = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    nodes = np.unique(np.concatenate([a, b]))
    root = spanned(nodes, a, b)
    other = root != nodes
    return pa.array(root[other]), pa.array(nodes[other])


_ROWS = ["tree", "prefix", "node", "size", "mini"]
#: What part of its partition a row at an edge is: the first rows, the last ones, or all of a partition with fewer than WINDOW rows.
_HEAD, _TAIL, _WHOLE = 0, 1, 2


def _forest(batches):
    """Pairs (a, b) that join the families within a partition of the order, and its rows at the edges, for _edges."""
    part = TaskContext.get().partitionId()
    held, waiting, size, seen, head = None, [], 0, 0, None

    def compare(rows):
        nodes = _Nodes(rows)
        leaders, first = nodes.leaders()
        a, b = _links(nodes.neighbours() + leaders)
        n = len(a)
        out = pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), a, b, *[pa.nulls(n, rows.schema.field(c).type) for c in _ROWS]], ["part", "side", "a", "b", *_ROWS])
        last = sorted({*range(max(0, len(rows) - WINDOW), len(rows)), *first})
        return out, rows.take(pa.array(last))

    def whole(tables):
        return pa.Table.from_batches(tables).combine_chunks().to_batches()[0]

    for batch in batches:
        if not len(batch):
            continue
        waiting.append(batch)
        size += len(batch)
        seen += len(batch)
        if size >= BLOCK_NODES:
            rows = whole([*([held] if held is not None else []), *waiting])
            head = rows.slice(0, WINDOW) if head is None else head
            out, held = compare(rows)
            waiting, size = [], 0
            yield out
    if waiting:
        rows = whole([*([held] if held is not None else []), *waiting])
        head = rows.slice(0, WINDOW) if head is None else head
        out, held = compare(rows)
        yield out
    for side, rows in ((_HEAD, head), (_TAIL, held)) if seen >= WINDOW else ((_WHOLE, head),) if seen else ():
        n = len(rows)
        yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([side] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *[rows[c] for c in _ROWS]], ["part", "side", "a", "b", *_ROWS])


def _edges(group: pa.Table) -> pa.Table:
    """Pairs among the last rows of a partition, small partitions after it, and the first rows of the next larger one."""
    rows = group.select(_ROWS).sort_by([("tree", "ascending"), ("prefix", "ascending"), ("node", "ascending")])
    nodes = _Nodes(rows.combine_chunks().to_batches()[0])
    out, _ = nodes.leaders()
    a, b = _links(nodes.neighbours() + out)
    return pa.table({"a": a, "b": b})


def candidates(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: distinct pairs of nodes that join all which a tree puts next to each other and the signatures don't rule out."""
    out = cut(_order(nodes).mapInArrow(_forest, f"part int, side int, a long, b long, {_TREE}"))
    inner = out.where(F.col("part").isNull()).select("a", "b")
    ends = out.where(F.col("part").isNotNull()).drop("a", "b")
    # Partitions without rows don't show, and those of a few rows lie between the larger ones: a row a partition, in one window.
    parts = ends.groupBy("part").agg(F.max((F.col("side") != _WHOLE).cast("int")).alias("large"))
    parts = parts.select("part", F.sum("large").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)).alias("place"))
    edge = F.col("place") - F.when(F.col("side") == _HEAD, 1).otherwise(0)
    outer = ends.join(F.broadcast(parts), "part").withColumn("edge", edge).groupBy("edge").applyInArrow(_edges, "a long, b long")
    return inner.unionByName(outer).distinct()


def _alike(known, size, mini):
    """Pairs of known classes that rows (in order of size) join whose sizes and signatures leave a link possible."""
    found, mini = [], np.ascontiguousarray(mini.T)
    for lo in range(0, len(size), 256):
        hi = min(len(size), lo + 256)
        end = int(np.searchsorted(PERCENT * size, 100 * size[hi - 1], side="right"))
        agreeing = np.zeros((hi - lo, end - lo), np.uint8)
        for row in mini:
            agreeing += row[lo:hi, None] == row[None, lo:end]
        i, j = np.nonzero(agreeing >= LEAST_AGREEING)
        i, j = i + lo, j + lo
        keep = (known[i] != known[j]) & (100 * np.minimum(size[i], size[j]) >= PERCENT * np.maximum(size[i], size[j]))
        a, b = known[i[keep]], known[j[keep]]
        classes = np.unique(np.concatenate([a, b]))
        root = spanned(classes, a, b)
        found.append((root[root != classes], classes[root != classes]))
    return found


def _regions(batches):
    """From rows sorted by group (region, i, j) and size: pairs (a, b) of known classes that each group joins."""
    held = None

    def groups(rows, last):
        """(links of the groups of rows, the rows from the last group on, which may go on)"""
        keys = np.stack([rows[c].to_numpy() for c in ("region", "i", "j")])
        starts = np.append(0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1)
        ends = np.append(starts[1:], rows.num_rows) if last else starts[1:]
        known, size = rows["known"].to_numpy(), rows["size"].to_numpy()
        mini, found = np.frombuffer(b"".join(rows["mini"].to_pylist()), np.uint8).reshape(-1, TREES * DEPTH), []
        for a, b in zip(starts.tolist(), ends.tolist()):
            if (known[a:b] != known[a]).any():
                found += _alike(known[a:b], size[a:b], mini[a:b])
        a, b = _links(found)
        return pa.RecordBatch.from_arrays([a, b], ["a", "b"]), rows.slice(int(starts[-1]))

    for batch in batches:
        if len(batch):
            rows = pa.Table.from_batches([batch])
            out, held = groups(rows if held is None else pa.concat_tables([held, rows]).combine_chunks(), last=False)
            yield out
    if held is not None:
        yield groups(held, last=True)[0]


def _crowded(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b): pairs of known classes (of nodes: node, known) that nodes with a common first min-hash join, from all regions that neighbours don't compare whole."""
    first = F.expr(f"conv(hex(substring(signature, tree * {4 * DEPTH} + 1, 4)), 16, 10)").cast("long")
    trees = nodes.join(known, "node").select(F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "node", "known", "signature")
    rows = trees.select((F.col("tree").cast("long") * F.lit(1 << 32) + first).alias("region"), "node", "known", F.lit(1).alias("weight")).distinct()
    many = rows.groupBy("region").agg(F.count("*").alias("n"), F.min("known").alias("least"), F.max("known").alias("most")).where((F.col("n") > WINDOW + 1) & (F.col("least") < F.col("most")))
    pairs = _block_pairs(cut(rows.join(many.select("region"), "region")), "region", REGION_NODES)
    mini = F.unhex(F.regexp_replace(F.hex("signature"), "......(..)", "$1")).alias("mini")
    dealt = pairs.join(nodes.select("node", "size", mini), "node").select(F.col("group.key").alias("region"), "group.i", "group.j", "known", "size", "mini")
    dealt = dealt.repartition(partitions(nodes.sparkSession), "region", "i", "j").sortWithinPartitions("region", "i", "j", "size")
    return dealt.mapInArrow(_regions, "a long, b long").distinct()


def _families_of(nodes: DataFrame) -> DataFrame:
    """(node, family) for the nodes that candidates join, all of them."""
    near = components(cut(candidates(nodes))).withColumnRenamed("root", "near")
    known = cut(nodes.select("node").distinct().join(near, "node", "left").select("node", "near", F.coalesce("near", "node").alias("known")))
    more = components(cut(_crowded(nodes, known.select("node", "known")))).select(F.col("node").alias("known"), "root")
    both = known.join(more, "known", "left").where("near IS NOT NULL OR root IS NOT NULL")
    return both.select("node", F.coalesce("root", "known").alias("family"))


def _set_rows(width: int):
    def run(batches):
        for batch in batches:
            for lo, hi, hashes, edges in shingle_sets(batch["text"], width):
                blobs = [hashes[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch["doc_id"][lo:hi], pa.array(blobs, pa.binary())], ["node", "shingles"])

    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share (above the diagonal)."""
    m = len(sets)
    values, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    run = np.cumsum(np.append(False, values[1:] != values[:-1]))
    size = np.bincount(run)[run]
    counts = np.zeros(m * m, np.float32)
    few = (size > 1) & (size <= _DENSE)
    i_run, i_owner = run[few], owner[few]
    for step in range(1, _DENSE):
        same = np.flatnonzero(i_run[:-step] == i_run[step:])
        if not len(same):
            break
        code, n = np.unique(i_owner[same] * m + i_owner[same + step], return_counts=True)
        counts[code] += n
    counts = counts.reshape(m, m)
    many = size > _DENSE
    column = np.unique(run[many], return_inverse=True)[1]
    owner = owner[many]
    for lo in range(0, int(column.max()) + 1 if len(column) else 0, 2048):
        part = (column >= lo) & (column < lo + 2048)
        has = np.zeros((m, 2048), np.float32)
        has[owner[part], column[part] - lo] = 1
        counts += np.triu(has @ has.T, 1)
    return counts


def classes_of(nodes: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each of some sorted nodes the smallest node that links between their sets reach; equal nodes are one."""
    shared, size = shared_counts(sets), np.array([len(s) for s in sets], np.int64)
    at_a, at_b = [np.flatnonzero(nodes[1:] == nodes[:-1])], [np.flatnonzero(nodes[1:] == nodes[:-1]) + 1]
    for i in range(len(nodes)):  # a row at a time; counts below 2**24 are exact in 32 bits
        j = np.flatnonzero(shared[i])
        c = shared[i, j].astype(np.int64)
        j = j[100 * c >= percent * (size[i] + size[j] - c)]
        at_a.append(np.full(len(j), i))
        at_b.append(j)
    place = np.arange(len(nodes))
    return nodes[spanned(place, np.concatenate(at_a), np.concatenate(at_b))]


def _families(percent: int, stretch: tuple[int, int] | None = None):
    """From sets in order, (node, root) of what links join: within each group, or in overlapping stretches of so many nodes and shingles."""

    def run(batches):
        now, nodes, sets, size = None, [], [], 0

        def settle():
            order = np.argsort(np.array(nodes, np.int64), kind="stable")
            sorted_ = np.array(nodes, np.int64)[order]
            out = classes_of(sorted_, [sets[i] for i in order], percent)
            return pa.RecordBatch.from_arrays([pa.array(sorted_), pa.array(out)], ["node", "root"])

        for batch in batches:
            for group, node, shingles in zip(batch["group"].to_pylist(), batch["node"].to_pylist(), batch["shingles"]):
                full = stretch is not None and (len(nodes) >= stretch[0] or size >= stretch[1])
                if nodes and (group != now or full):
                    yield settle()
                    half = len(nodes) // 2 + 1 if group == now else len(nodes)
                    del nodes[:half], sets[:half]
                    size = sum(map(len, sets))
                now = group
                nodes.append(node)
                sets.append(np.frombuffer(shingles.as_buffer(), np.uint64))
                size += len(sets[-1])
        if nodes:
            yield settle()

    return run


def _block_pairs(rows: DataFrame, key: str, most: int, most_weight: int | None = None) -> DataFrame:
    """rows (key, known, node, weight, ...) dealt out as groups (key, first block, second block).

    Each two rows of a key whose known classes differ meet in at least one
    group. A block has about `most` rows and `most_weight` weight. A known class
    above that has blocks of its own, which don't meet each other; a key all of
    whose rows are of one class goes.
    """

    def blocks(n, weight):
        needed = F.ceil(F.col(n) / most)
        return needed if most_weight is None else F.greatest(needed, F.ceil(F.col(weight) / most_weight))

    classes = rows.groupBy(key, "known").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    classes = cut(classes.withColumn("blocks", blocks("n", "w")).withColumn("own", F.col("blocks") > 1))
    small, whole = ~F.col("own"), F.when(F.col("own"), F.col("blocks")).otherwise(0)
    keys = classes.groupBy(key).agg(
        F.count("*").alias("classes"), F.sum(whole).alias("owned"), F.sum(F.when(small, F.col("n")).otherwise(0)).alias("rest"), F.sum(F.when(small, F.col("w")).otherwise(0)).alias("rest_w")
    )
    keys = keys.where("classes > 1").withColumn("mixed", blocks("rest", "rest_w")).select(key, "mixed", (F.col("mixed") + F.col("owned")).alias("total"))
    # The few large classes of a key take the blocks after the mixed ones.
    before = F.sum("blocks").over(Window.partitionBy(key).orderBy("known"))
    large = classes.where("own").select(key, "known", (before - F.col("blocks")).alias("at"), "blocks")
    places = classes.select(key, "known").join(keys, key).join(large, [key, "known"], "left")
    lo, hi = F.coalesce(F.col("mixed") + F.col("at"), F.lit(0)), F.coalesce(F.col("mixed") + F.col("at") + F.col("blocks"), F.col("mixed"))
    places = places.select(key, "known", "total", F.col("at").isNotNull().alias("own"), lo.alias("lo"), hi.alias("hi"))
    placed = rows.join(places, [key, "known"]).withColumn("block", F.col("lo") + F.pmod(F.xxhash64("node"), F.col("hi") - F.col("lo")))
    # A mixed block also meets itself, which counts where it is the only one; a class's own block meets all outside the class.
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("total") - 1), lambda j: F.when(F.col("own"), (j < F.col("lo")) | (j >= F.col("hi"))).otherwise((j != F.col("block")) | (F.col("total") == 1)))
    dealt = placed.withColumn("other", F.explode(others))
    group = F.struct(F.col(key).alias("key"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return dealt.withColumn("group", group).drop(key, "weight", "total", "own", "lo", "hi", "block", "other")


def _big_family_roots(sets: DataFrame, nodes: DataFrame, large: DataFrame, percent: int, most: tuple[int, int]) -> DataFrame:
    """(node, root) for the nodes of large families (node, family), as all pairs of a family give them."""
    bytes_ = 4 * DEPTH
    places = nodes.join(large, "node").select("node", F.explode(F.sequence(F.lit(0), F.lit(BIG_TREES - 1))).alias("group"), "signature")
    places = places.select("node", "group", F.expr(f"substring(signature, group * {bytes_} + 1, {bytes_})").alias("prefix"))
    rows = sets.join(places, "node").select("group", "prefix", "node", "shingles")
    n = partitions(sets.sparkSession)
    dealt = rows.repartitionByRange(n, "group", "prefix", "node").sortWithinPartitions("group", "prefix", "node")

    def links(found):
        return cut(found.where("node != root").select(F.col("root").alias("a"), F.col("node").alias("b")).distinct())

    near = links(dealt.select("group", "node", "shingles").mapInArrow(_families(percent, most), "node long, root long"))
    sizes = nodes.groupBy("node").agg(F.sum("size").alias("weight"))
    apart = large.join(sizes, "node").join(components(near), "node", "left").select("family", F.coalesce("root", "node").alias("known"), "node", "weight")
    pairs = _block_pairs(cut(apart), "family", max(1, most[0] // 2), max(1, most[1] // 2))
    dealt = sets.join(pairs, "node").select("group", "node", "shingles").repartition(n, "group").sortWithinPartitions("group", "node")
    return components(near.unionByName(links(dealt.mapInArrow(_families(percent), "node long, root long"))))


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id that links reach) and kept (it is that one)."""
    rows = cut(features(docs, width))
    known = rows.where(F.col("doc_id").isNotNull() & F.col("set_a").isNotNull())
    nodes = cut(known.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("size"), F.first("signature").alias("signature")))
    members = _families_of(nodes).join(nodes.groupBy("node").agg(F.sum("size").alias("size")), "node")
    sizes = members.groupBy("family").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    whole = (F.col("n") <= FAMILY_NODES) & (F.col("shingles") <= FAMILY_SHINGLES)
    members = cut(members.join(sizes.select("family", whole.alias("whole")), "family").select("node", "family", "whole"))
    texts = _rows(docs)
    texts = texts.join(members.select(F.col("node").alias("needed")), texts["doc_id"] == F.col("needed"), "left_semi")
    sets = texts.mapInArrow(_set_rows(width), "node long, shingles binary").where(F.length("shingles") > 0).dropDuplicates(["node", "shingles"])

    large = members.where("NOT whole").select("node", "family")
    any_large = large.limit(1).count() > 0
    sets = cut(sets) if any_large else sets
    inside = sets.join(members.where("whole").select("node", F.col("family").alias("group")), "node").select("group", "node", "shingles")
    dealt = inside.repartition(partitions(docs.sparkSession), "group").sortWithinPartitions("group", "node")
    roots = dealt.mapInArrow(_families(percent), "node long, root long")
    if any_large:
        roots = roots.unionByName(_big_family_roots(sets, nodes, large, percent, (FAMILY_NODES, FAMILY_SHINGLES)))
    roots = roots.groupBy("node").agg(F.min("root").alias("root"))

    classes = nodes.join(roots, "node", "left").select("set_a", "set_b", F.coalesce("root", "node").alias("component_id"))
    # A row that has no set or no id is alone; it stays out of the join, where all of them would meet on one key.
    linked = known.join(classes, ["set_a", "set_b"]).select("doc_id", "n_shingles", "component_id")
    alone = rows.where(F.col("doc_id").isNull() | F.col("set_a").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each group of near duplicates, the smallest doc_id; all columns stay as they are."""
    gone = near_duplicates(docs, width, percent).where(~F.col("kept")).select(F.col("doc_id").alias("_gone_id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone_id"], "left_anti")


def op3_near(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT x, b FROM reach JOIN links ON y = a),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
