"""Connected components by repeated contraction.

Each round maps every vertex to the best vertex of its closed neighbourhood and
replaces the graph by its image, so edges inside a contracted group vanish.  Even
rounds rank vertices by id (a star collapses in one round), odd rounds by a hash
seeded with the round (a long path still shrinks by a constant share), so the
number of rounds is logarithmic whatever the shape.  Once the image has
``LOCAL_EDGES`` edges or fewer, as small graphs have from the start, one task ends the
job in memory.  All state lives in scratch tables; the driver sees only edge counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestitch.operators.scratch import Scratch

#: Edges a single file of an intermediate table holds, about.
_EDGES_PER_FILE = 400_000
#: Edges that one task may hold: the bound below which no further round is worth its jobs.
LOCAL_EDGES = 200_000


def _least_reachable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(node, target)``: the smallest vertex that each vertex of a bounded edge table reaches."""
    held = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches]
    if not held:
        return
    nodes, ends = np.unique(np.concatenate([x for pair in zip(*held) for x in pair]), return_inverse=True)
    a, b = np.split(ends.ravel(), 2)
    label = np.arange(len(nodes))
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(up := label[label], label):
            label = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "target"])


def connected_components(edges: DataFrame, left: str, right: str, store: Scratch) -> DataFrame:
    """Vertices of ``edges`` with the smallest vertex reachable from each.

    Returns ``(node BIGINT, component BIGINT)``, one row per vertex that has an
    edge to another vertex.  Self loops, repeated edges, and edges with a null end
    are ignored; an empty edge table gives an empty result.
    """
    u, v = F.col(left).cast("long"), F.col(right).cast("long")
    level = store.write(edges.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"), (u.isNull() | v.isNull()).alias("bad")).where("not bad and u <> v").select("u", "v").distinct())
    maps: list[DataFrame] = []
    first = n = level.count()
    round_no = 0
    while n:
        if n <= LOCAL_EDGES:
            maps.append(store.write(level.coalesce(1).mapInArrow(_least_reachable, "node long, target long")))
            break
        files = 1 + n // _EDGES_PER_FILE
        rank = (lambda c: F.struct(c.alias("r"), c.alias("id"))) if round_no % 2 == 0 else (lambda c, k=round_no: F.struct(F.xxhash64(c, F.lit(k)).alias("r"), c.alias("id")))
        ends = level.select(F.col("u").alias("node"), F.col("v").alias("other")).unionAll(level.select(F.col("v").alias("node"), F.col("u").alias("other")))
        best = ends.groupBy("node").agg(F.min(rank(F.col("other"))).alias("b")).select("node", F.least("b", rank(F.col("node"))).getField("id").alias("target"))
        best = store.write(best, files)
        maps.append(best)
        a = best.select(F.col("node").alias("u"), F.col("target").alias("tu"))
        b = best.select(F.col("node").alias("v"), F.col("target").alias("tv"))
        image = level.join(a, "u").join(b, "v").where("tu <> tv").select(F.least("tu", "tv").alias("u"), F.greatest("tu", "tv").alias("v")).distinct()
        level = store.write(image, files)
        n, round_no = level.count(), round_no + 1
    if not maps:
        return level.select(F.col("u").alias("node"), F.col("v").alias("component"))
    label = maps[0]
    for later in maps[1:]:
        step = later.select(F.col("node").alias("target"), F.col("target").alias("next"))
        label = label.join(step, "target", "left").select("node", F.coalesce("next", "target").alias("target"))
    if len(maps) > 1:
        label = store.write(label, 1 + first // _EDGES_PER_FILE)
    least = label.groupBy("target").agg(F.least(F.min("node"), F.min("target")).alias("component"))
    return label.join(least, "target").select("node", "component")
