"""N-gram Jaccard self-join by signature trees, as components.

A text's set holds the hashes of its distinct windows of ``n`` words (a shorter
text is one window). Texts with equal sets are one class, told apart by a
64-bit digest of the set. Two classes link if ``den * |A and B| >= num * |A or B|``.

1. Screening, exact. In hash order the first 2p + 1 members of a set, where
   p = size - ceil(num / den * size) + 1, share at least p + 1 members with those of
   any linked set. Of them each class keeps the p + 1 rarest (by document
   count, ties by hash); members that no other class has are counted as such and
   not kept. Linked classes share a kept member. Text that many documents have
   in common is rarest last, so it brings nothing to most of them.
2. Classes that share kept members, directly or through others, form clusters.
   Large clusters are cut into blocks of like size.
3. In a block the classes are leaves of a signature tree, sorted by their
   smallest members. Inner nodes hold the OR of the token bitmaps, the size range
   and the largest number of members hidden behind shared bits. A dual traversal
   drops node pairs whose largest possible overlap is too small, or whose leaves
   are in one component already, and compares the rest exactly.
4. Blocks of one cluster meet through one leader of each component; block pairs
   that are not in one component then are traversed in full. A cluster of near
   copies thus costs one pass and its leaders, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import connected_components
from tidemark.llm.words import Words, grams, mix, segments
from tidemark.session import written

FAN = 16
BLOCK_ROWS = 1000
BLOCK_MEMBERS = 2_000_000  # shingles of all sets of a block
_U = np.uint64


def sets_of(w: Words, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    gram, first = grams(w, n)
    bounds = np.searchsorted(first, w.bounds)
    found = []
    for i in range(w.rows):
        words = w.ids[w.bounds[i]:w.bounds[i + 1]]
        if len(words) >= n:
            found.append(np.unique(gram[bounds[i]:bounds[i + 1]]))
        elif len(words):
            total = _U(len(words))
            with np.errstate(over="ignore"):
                for x in words:
                    total = total * _U(0x9E3779B97F4A7C15) + x
            found.append(mix(np.array([total], np.uint64)))
        else:
            found.append(words[:0])
    return found


def digest(members: np.ndarray) -> int:
    """A 64-bit digest of a set, as a signed number."""
    if not len(members):
        return 0
    with np.errstate(over="ignore"):
        value = mix(np.array([np.bitwise_xor.reduce(mix(members + _U(1))) + mix(members).sum(dtype=np.uint64) * _U(len(members))]))[0]
    return int(value.view(np.int64))


def class_of(text: Column, n: int) -> Column:
    """Struct of the set's size and digest."""

    @F.arrow_udf("struct<size:bigint,node:bigint>")
    def run(column: pa.Array) -> pa.Array:
        found = [s for w in segments(column, True) for s in sets_of(w, n)]
        return pa.StructArray.from_arrays([pa.array([len(s) for s in found], pa.int64()), pa.array([digest(s) for s in found], pa.int64())],
                                          ["size", "node"])

    return run(text)


def prefix_length(size: int, num: int, den: int) -> int:
    return size - -(-num * size // den) + 1


def _prefixes(n: int, num: int, den: int):
    """Rows ``member, node, size`` of the first 2p + 1 members; a task gives each class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for w in segments(batch.column(0), True):
                members, nodes, sizes = [], [], []
                for s in sets_of(w, n):
                    node = digest(s)
                    if not len(s) or node in seen:
                        continue
                    seen.add(node)
                    members.append(s[:2 * prefix_length(len(s), num, den) + 1])
                    nodes.append(node)
                    sizes.append(len(s))
                if nodes:
                    count = [len(m) for m in members]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(members).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), count)),
                         pa.array(np.repeat(np.array(sizes, np.int64), count))], ["member", "node", "size"])

    return run


def _first_texts(n: int):
    """Rows ``node, text``; a task gives each class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            column = batch.column(0)
            for w in segments(column, True):
                nodes = [digest(s) if len(s) else None for s in sets_of(w, n)]
                keep = [i for i, x in enumerate(nodes) if x is not None and not (x in seen or seen.add(x))]
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in keep], pa.int64()),
                                                  column.slice(w.first, w.rows).take(pa.array(keep, pa.int64()))], ["node", "text"])

    return run


class Tree:
    """A signature tree over sets and the links found so far."""

    def __init__(self, sets: list[np.ndarray], roots: np.ndarray, num: int, den: int):
        order = sorted(range(len(sets)), key=lambda i: (tuple(sets[i][:2].tolist()), len(sets[i])))
        self.order = order
        self.sets = [sets[i] for i in order]
        self.root = roots[order].copy()
        self.num, self.den = num, den
        self.links: list[tuple[int, int]] = []
        size = np.array([len(s) for s in self.sets], np.int64)
        bits = 1 << max(9, int(2 * size.max()).bit_length())
        maps = np.zeros((len(size), bits // 64), np.uint64)
        for i, s in enumerate(self.sets):
            at = s & _U(bits - 1)
            np.bitwise_or.at(maps[i], (at >> _U(6)).astype(np.int64), _U(1) << (at & _U(63)))
        hidden = size - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        # levels[0] are the leaves; node i of level k covers leaves [i * FAN^k, (i + 1) * FAN^k).
        self.levels = [(maps, size, size, hidden)]
        while len(self.levels[-1][1]) > 1:
            m, low, high, h = self.levels[-1]
            cut = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_or.reduceat(m, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut),
                                np.maximum.reduceat(h, cut)))

    def _possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of nodes ``a`` x ``b`` could hold a link, by sizes and largest overlap."""
        m, low, high, hidden = self.levels[level]
        overlap = np.bitwise_count(m[a][:, None, :] & m[b][None, :, :]).sum(axis=2).astype(np.int64) + np.minimum(hidden[a][:, None], hidden[b][None, :])
        la, lb, ha, hb = low[a][:, None], low[b][None, :], high[a][:, None], high[b][None, :]
        sizes = (self.den * ha >= self.num * lb) & (self.den * hb >= self.num * la)
        return sizes & ((self.num + self.den) * np.minimum(overlap, np.minimum(ha, hb)) >= self.num * (la + lb))

    def _one(self, level: int, a: int, b: int) -> bool:
        """Whether all leaves of both nodes are in one component."""
        span = FAN ** level
        left, right = self.root[a * span:(a + 1) * span], self.root[b * span:(b + 1) * span]
        return bool((left == left[0]).all() and (right == left[0]).all())

    def _compare(self, i: int, j: int) -> None:
        x, y = self.sets[i], self.sets[j]
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        common = int((y[at] == x).sum())
        if self.den * common >= self.num * (len(x) + len(y) - common):
            self.links.append((i, j))
            keep, gone = sorted((self.root[i], self.root[j]))
            self.root[self.root == gone] = keep

    def join(self) -> None:
        """Dual traversal of the tree with itself; parts low in the tree come first."""
        for level in range(1, len(self.levels)):
            for node in range(len(self.levels[level][1])):
                self._inside(level, node)

    def _inside(self, level: int, node: int) -> None:
        """Pairs of different children of one node (of leaves: all pairs)."""
        children = np.arange(node * FAN, min((node + 1) * FAN, len(self.levels[level - 1][1])))
        self._pairs(level - 1, children, children, same=True)

    def _pairs(self, level: int, a: np.ndarray, b: np.ndarray, same: bool = False) -> None:
        possible = self._possible(level, a, b)
        for i, j in zip(*np.nonzero(possible)):
            if same and i >= j:
                continue
            x, y = int(a[i]), int(b[j])
            if self._one(level, x, y):
                continue
            if level == 0:
                self._compare(x, y)
            else:
                below = len(self.levels[level - 1][1])
                self._pairs(level - 1, np.arange(x * FAN, min((x + 1) * FAN, below)), np.arange(y * FAN, min((y + 1) * FAN, below)))

    def roots(self) -> np.ndarray:
        """The root of each set, in the order given."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = self.root
        return out


def _join_block(n: int, num: int, den: int):
    """``node, root`` within one block: the smallest label of the classes it links to."""

    def run(rows: pa.Table) -> pa.Table:
        nodes = rows.column("node").to_numpy()
        _, first = np.unique(nodes, return_index=True)  # a class may come from several tasks
        rows = rows.take(pa.array(first))
        nodes, labels = rows.column("node").to_numpy(), rows.column("label").to_numpy()
        sets = [s for chunk in rows.column("text").chunks for w in segments(chunk, True) for s in sets_of(w, n)]
        tree = Tree(sets, labels.astype(np.int64), num, den)
        tree.join()
        return pa.table({"node": pa.array(nodes, pa.int64()), "label": pa.array(labels, pa.int64()), "root": pa.array(tree.roots(), pa.int64())})

    return run


def _traverse(rows: DataFrame, key: list[str], n: int, num: int, den: int) -> DataFrame:
    return rows.select(*key, "node", "label", "text").groupBy(*key).applyInArrow(_join_block(n, num, den), "node bigint, label bigint, root bigint")


def kept_members(docs: DataFrame, text: str, n: int, num: int, den: int) -> DataFrame:
    """``member, node, size``: the rarest members of each class that others have too (see 1. above)."""
    rows = docs.select(F.col(text).alias("text")).mapInArrow(_prefixes(n, num, den), "member bigint, node bigint, size bigint")
    shared = rows.groupBy("member").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("df")).filter("low < high")
    found = rows.join(shared.select("member", "df"), "member").groupBy("node").agg(
        F.sort_array(F.collect_set(F.struct("df", "member"))).alias("common"), F.max("size").alias("size"))
    p = F.col("size") - F.ceil(F.lit(num) * F.col("size") / F.lit(den)) + 1
    alone = F.least(F.col("size"), 2 * p + 1) - F.size("common")
    return found.withColumn("keep", p + 1 - alone).filter("keep > 0").select(
        F.explode(F.expr("slice(common, 1, cast(keep as int))")).alias("c"), "node", "size").select("c.member", "node", "size")


def link_classes(docs: DataFrame, text: str, n: int, num: int, den: int) -> DataFrame:
    """``node, label`` of the classes that have a link; the label is the component's smallest node."""
    kept = written(kept_members(docs, text, n, num, den), "ngram-kept")
    hub = kept.groupBy("member").agg(F.min("node").alias("b"))
    clusters = written(connected_components(kept.join(hub, "member").select(F.col("node").alias("a"), "b")), "ngram-clusters")
    sizes = kept.select("node", "size").distinct()
    # Blocks: classes of like size, so many that rows and members stay within bounds.
    level = F.floor(F.log(F.col("size")) / 0.2)
    nodes = clusters.join(sizes, "node").select("node", F.col("label").alias("cluster"), "size", level.alias("level"))
    counts = nodes.groupBy("cluster", "level").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_MEMBERS)).alias("cuts"))
    # Small clusters are one block whatever their sizes.
    whole = nodes.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("members"))
    small = (F.col("rows") <= BLOCK_ROWS) & (F.col("members") <= BLOCK_MEMBERS)
    block = F.when(small, F.lit("")).otherwise(F.concat_ws("-", "level", F.pmod(F.xxhash64("node"), "cuts")))
    nodes = nodes.join(counts, ["cluster", "level"]).join(whole, "cluster").select(
        "node", "cluster", "size", block.alias("block"))
    texts = docs.select(F.col(text).alias("text")).mapInArrow(_first_texts(n), "node bigint, text string").join(nodes, "node")
    texts = written(texts.withColumn("label", F.col("node")), "ngram-texts")
    first = written(_traverse(texts, ["cluster", "block"], n, num, den), "ngram-links")
    many = texts.filter("block <> ''")
    if many.isEmpty():
        return first.filter("node <> root").select("node", F.col("root").alias("label"))
    edges = first.select(F.col("node").alias("a"), F.col("root").alias("b"))
    # Leaders of the blocks' components meet.
    labels = first.select("node", F.col("root").alias("found"))
    leaders = many.join(labels, "node").filter("node = found").drop("found")
    second = written(_traverse(_spread(leaders), ["cluster", "block"], n, num, den), "ngram-links")
    edges = edges.unionByName(second.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = connected_components(edges).select("node", F.col("label").alias("known"))
    now = many.drop("label").join(known, "node", "left").withColumn("label", F.coalesce("known", "node")).drop("known")
    now = written(now, "ngram-texts")
    blocks = now.groupBy("cluster", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("size").alias("least"), F.max("size").alias("most"))
    a, b = blocks.alias("a"), blocks.alias("b")
    pairs = a.join(b, (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.block") < F.col("b.block"))
                   & (F.lit(den) * F.col("a.most") >= F.lit(num) * F.col("b.least")) & (F.lit(den) * F.col("b.most") >= F.lit(num) * F.col("a.least"))
                   & ((F.col("a.low") != F.col("b.high")) | (F.col("a.high") != F.col("b.low"))))
    pairs = pairs.select(F.col("a.cluster").alias("cluster"), F.col("a.block").alias("one"), F.col("b.block").alias("two"))
    pairs = written(pairs.withColumn("block", F.explode(F.array("one", "two"))), "ngram-pairs")
    third = written(_traverse(now.join(pairs, ["cluster", "block"]), ["cluster", "one", "two"], n, num, den), "ngram-links")
    third = third.select(F.col("label").alias("a"), F.col("root").alias("b"))
    return connected_components(edges.unionByName(third)).filter("node <> label")


def _spread(leaders: DataFrame) -> DataFrame:
    """Leaders of a cluster in one block, or in as many as keep each within bounds."""
    counts = leaders.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_MEMBERS)).alias("cuts"))
    return leaders.drop("block").join(counts, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("cuts"))).drop("cuts")


def components(docs: DataFrame, key: str, text: str, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Key, ``n_shingles, node, component_id`` of each row.

    ``component_id`` is the smallest key reachable by links. Null, empty and
    word-free texts have an empty set and their own key. Repeated rows stay;
    null keys are no one's component unless all keys of the component are null.
    """
    rows = docs.select(F.col(key).alias("key"), class_of(F.col(text), n).alias("c")).select("key", F.col("c.size").alias("n_shingles"), "c.node")
    rows = written(rows, "ngram-rows")
    links = written(link_classes(docs, text, n, num, den), "ngram-labels")
    nodes = rows.filter("n_shingles > 0").groupBy("node").agg(F.min("key").alias("least"))
    joined = nodes.join(links, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    placed = joined.join(least, "label").select("node", "component_id")
    full = rows.filter("n_shingles > 0").join(placed, "node")
    empty = rows.filter("n_shingles = 0").withColumn("component_id", F.col("key"))
    return full.select("key", "n_shingles", "node", "component_id").unionByName(empty.select("key", "n_shingles", "node", "component_id")).select(
        F.col("key").alias(key), "n_shingles", "node", "component_id")
