"""SimHash near-duplicates, linked through vantage-point trees.

A fingerprint has a bit set where over half of the document's shingle hashes have
it.  Equal fingerprints are one node, so exact copies never meet again.  Nodes
within ``radius`` bits are found with one vantage-point tree for each of ``blocks``
blocks of the 64 bits, whose metric is the Hamming distance on its block:

* Two fingerprints within ``radius`` bits are within budget ``b_t`` on some block when
  ``sum(b_t + 1) > radius``, so each tree only has to answer its own small budget.
* Trees are grown on a sample of the fingerprints.  A node's vantage point is one of
  its own points, its radius their median distance; points within go to one side, the
  others to the other, until a leaf holds about ``LEAF_POINTS``.  A leaf is a shard.
* Every fingerprint lives in one leaf of each tree.  By the triangle inequality, one
  that lies inside a node's ball and no more than the budget away from its border also
  visits the other side, as a guest, and a guest goes wherever the bound lets it.  Of a
  pair that a border parts, the inner one visits the outer one's leaf.

A tree on all 64 bits would be exact too, but distances of unrelated fingerprints
crowd around 32 there, so four bits to either side of a border hold most of them and
nearly every branch is visited.

Inside a shard all points are compared exactly on the full 64 bits, and only a
spanning forest of the links leaves the task, so a dense group of near copies costs
no more output rows than it has members.  A shard of more than ``LEAF_LIMIT`` points,
such as many near copies that are equal on a block, is cut into a grid of chunk pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestitch.llm.base import arrow_ready, raw_texts
from lodestitch.operators.components import connected_components
from lodestitch.operators.scratch import Scratch

SEED = 42
#: Points that live in one leaf, about, and points that a shard may hold uncut.
LEAF_POINTS, LEAF_LIMIT = 768, 6_144
#: Fingerprints that the trees are grown on: this share of all, and this many at most; they go to the driver.
SAMPLE_SHARE, SAMPLE_POINTS = 0.25, 1 << 20
#: Points of the sample that a leaf has at least, and points tried as vantage points.
_LEAF_SAMPLE, _TRIES = 8, 6
_GROW_POINTS = 4_096


def fingerprint(text: bytes | None, words_per_shingle: int = 4) -> int:
    """The 64-bit SimHash of one text, unsigned; 0 for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= words_per_shingle:
        hashes = [digest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths) + np.arange(len(words))
        first = (ends - lengths)[: len(words) - words_per_shingle + 1].tolist()
        last = ends[words_per_shingle - 1 :].tolist()
        hashes = [digest(joined[a:b], SEED) for a, b in zip(first, last)]
    counts = np.zeros(64, np.int64)
    h = np.array(hashes, dtype="<u8")
    for at in range(0, len(h), 65_536):
        bits = np.unpackbits(h[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * counts > len(h)).astype(np.uint64)).sum(dtype=np.uint64))


def fingerprints(rows: DataFrame, words_per_shingle: int = 4) -> DataFrame:
    """``(key, fp)`` for rows of ``(key, text)``; fp is the fingerprint as a signed long, key of any type."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, words_per_shingle) for t in raw_texts(batch, 1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["key", "fp"])

    return arrow_ready(rows.select("key", F.col("text").cast("string"))).mapInArrow(prints, f"key {rows.schema['key'].dataType.simpleString()}, fp long")


def budgets(radius: int, blocks: int) -> list[int]:
    """Budgets that add up to ``radius - blocks + 1``, so that a linked pair keeps one of them."""
    spare = radius - blocks + 1
    if spare < 0:
        return [0] * (radius + 1) + [-1] * (blocks - radius - 1)
    return [spare // blocks + (1 if t < spare % blocks else 0) for t in range(blocks)]


@dataclass
class Tree:
    """A vantage-point tree on the bits of ``mask``.

    Inner node ``i`` has the ball ``(vantage[i], radius[i])`` and the children
    ``inside[i]`` and ``outside[i]``; a leaf has a radius of -1.
    """

    mask: int
    budget: int
    vantage: np.ndarray
    radius: np.ndarray
    inside: np.ndarray
    outside: np.ndarray

    def places(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, leaf, home) of all leaves that points live in or visit."""
        bits = fp & np.uint64(self.mask)
        point, node, home, done = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.ones(len(fp), bool), []
        while len(point):
            at_leaf = self.radius[node] < 0
            done.append((point[at_leaf], node[at_leaf], home[at_leaf]))
            point, node, home = point[~at_leaf], node[~at_leaf], home[~at_leaf]
            away = np.bitwise_count(bits[point] ^ self.vantage[node]).astype(np.int64)
            far, near = away + self.budget > self.radius[node], away - self.budget <= self.radius[node]
            inner = away <= self.radius[node]
            go_in, go_out = np.where(home, inner, near), far  # of home points, those inside are guests beyond the border
            moves = [(point[go_in], self.inside[node[go_in]], home[go_in]), (point[go_out], self.outside[node[go_out]], (home & ~inner)[go_out])]
            point, node, home = (np.concatenate(x) for x in zip(*moves))
        return tuple(np.concatenate(x) for x in zip(*done))


def grow(sample: np.ndarray, mask: int, budget: int, leaf: int) -> Tree:
    """A tree whose leaves hold ``leaf`` points of the sample or fewer, unless they are all as far from each other."""
    points = np.sort(sample & np.uint64(mask))
    rng = np.random.default_rng(SEED)
    vantage, radius, inside, outside = [np.uint64(0)], [-1], [-1], [-1]
    open_ = [(0, points)]
    while open_:
        node, own = open_.pop()
        if len(own) <= leaf:
            continue
        some = own if len(own) <= _GROW_POINTS else rng.choice(own, _GROW_POINTS, replace=False)
        best = None
        for v in rng.choice(some, min(_TRIES, len(some)), replace=False):
            away = np.bitwise_count(some ^ v).astype(np.int64)
            middle = int(np.median(away))
            for r in (middle - 1, middle):
                inner = (away <= r).sum()
                if 0 < inner < len(some):
                    # points on the border become guests; a lopsided ball makes a deep tree
                    cost = (budget > 0) * ((away <= r) & (away + budget > r)).sum() / len(some) + abs(inner / len(some) - 0.5)
                    if best is None or cost < best[0]:
                        best = (cost, v, r)
        if best is None:
            continue
        _, vantage[node], radius[node] = best
        inner = np.bitwise_count(own ^ vantage[node]).astype(np.int64) <= radius[node]
        inside[node], outside[node] = len(radius), len(radius) + 1
        for part in (own[inner], own[~inner]):
            open_.append((len(radius), part))
            vantage.append(np.uint64(0)), radius.append(-1), inside.append(-1), outside.append(-1)
    return Tree(mask, budget, np.array(vantage, np.uint64), *(np.array(x, np.int64) for x in (radius, inside, outside)))


def forest(sample: np.ndarray, radius: int, blocks: int, leaf: int) -> list[Tree]:
    edges = [64 * t // blocks for t in range(blocks + 1)]
    masks = [((1 << top) - 1) ^ ((1 << low) - 1) for low, top in zip(edges[:-1], edges[1:])]
    return [grow(sample, mask, budget, leaf) for mask, budget in zip(masks, budgets(radius, blocks)) if budget >= 0]


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent[x]]
        if np.array_equal(up, parent[x]):
            return up
        parent[x] = up


def shard_forest(fp: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between all points and the home points of one shard."""
    order = np.argsort(fp, kind="stable")
    fp, home = fp[order], home[order]
    parent = np.arange(len(fp))
    at_home = np.flatnonzero(home)
    targets = fp[at_home]
    rows = max(1, (1 << 18) // max(1, len(targets)))  # a tile that caches hold
    for start in range(0, len(fp), rows):
        away = np.bitwise_count(fp[start : start + rows, None] ^ targets[None, :])
        near = (away <= radius) & (away > 0)
        for i in np.flatnonzero(near.any(axis=1)):
            group = _roots(parent, np.append(at_home[near[i]], start + i))
            parent[group] = group.min()
    root = _roots(parent, np.arange(len(fp)))
    linked = root != np.arange(len(fp))
    return fp[linked], fp[root[linked]]


def link(prints: DataFrame, store: Scratch, radius: int = 4, blocks: int = 3) -> DataFrame:
    """Edges ``(a, b)`` between fingerprints that span all links within ``radius``.

    ``prints`` has every ``fp`` once.
    """
    n = max(1, prints.count())
    share = min(SAMPLE_SHARE, SAMPLE_POINTS / n)
    picked = F.pmod(F.xxhash64("fp"), F.lit(1 << 40)) < int(share * (1 << 40))
    sample = np.array([r.fp for r in prints.where(picked).select("fp").collect()], np.int64).view(np.uint64)
    trees = prints.sparkSession.sparkContext.broadcast(forest(sample, radius, blocks, max(_LEAF_SAMPLE, int(LEAF_POINTS * share))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for number, tree in enumerate(trees.value):
                point, leaf, home = tree.places(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(point), number, np.int32)), pa.array(leaf), pa.array(fp[point]), pa.array(home)], names=["tree", "shard", "fp", "home"])

    spread = store.write(arrow_ready(prints.select("fp")).mapInArrow(place, "tree int, shard long, fp long, home boolean"))
    keys = ["tree", "shard"]
    # At most one row for each LEAF_LIMIT points; Spark broadcasts it if it is small.
    cut = F.ceil(F.col("points") / F.lit(LEAF_LIMIT // 2)).cast("int").alias("cuts")
    heavy = store.write(spread.groupBy(keys).agg(F.count(F.lit(1)).alias("points")).where(F.col("points") > LEAF_LIMIT).select(*keys, cut), 1)
    # A grid over the heavy shards: chunk pairs (i, j) meet in one group each.
    own = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda j: F.struct(F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j")))
    met = spread.join(heavy, keys, "left").withColumn("cuts", F.coalesce("cuts", F.lit(1))).withColumn("own", own).withColumn("meet", F.explode(meets)).select("fp", *keys, "home", "meet.i", "meet.j")

    def search(group: pa.Table) -> pa.Table:
        a, b = shard_forest(group["fp"].to_numpy().view(np.uint64), group["home"].to_numpy(), radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return met.groupBy(*keys, "i", "j").applyInArrow(search, "a long, b long")


def groups(prints: DataFrame, store: Scratch, radius: int = 4, blocks: int = 3) -> DataFrame:
    """``(fp, component)`` for every distinct ``fp`` of ``prints``: steps of ``radius`` bits or fewer connect a component."""
    distinct = store.write(prints.select("fp").distinct())
    found = connected_components(store.write(link(distinct, store, radius, blocks)), "a", "b", store).withColumnRenamed("node", "fp")
    return store.write(distinct.join(found, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4, radius: int = 4, blocks: int = 3) -> DataFrame:
    """Groups documents whose fingerprints are connected by steps of ``radius`` bits or fewer.

    Returns ``(doc_id, fp, component_id)``, one row per input row; component_id is
    the smallest doc_id of the group.  Other columns of ``docs`` are ignored.

    * A null or blank text has fingerprint zero and links like any other.
    * Repeated rows give repeated results; rows that share a doc_id link by their texts only.
    * A row with a null doc_id links like any other and never names its group; the
      component of a group of such rows alone is null.
    * An empty table gives an empty result.
    """
    store = Scratch(docs.sparkSession, "simhash")
    prints = store.write(fingerprints(docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text")), words_per_shingle).withColumnRenamed("key", "doc_id"))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    member = groups(prints, store, radius, blocks).join(least, "fp")
    names = member.groupBy("component").agg(F.min("least").alias("component_id"))
    # Written, so that a join on a very common fingerprint meets a plain table and Spark can split it.
    labels = store.write(member.join(names, "component").select("fp", "component_id"))
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
