"""Exact cosine links between embeddings by a range join of chunks.

Vectors are normalised and rotated by a seeded orthogonal matrix, which spreads their
variance evenly over the coordinates.  Equal vectors are one class with a multiplicity.
Classes are dealt out by ranges of a cell, the signs of their leading coordinates, so
that similar ones lie together, and packed into chunks: one row each, with the box of
its points.  Two unit vectors of cosine ``c`` or more are ``2 - 2 c`` apart at most,
squared, so two chunks meet only if their boxes are not farther apart.

Chunks are joined by Spark as scans of one written table (no shuffle, no broadcast, no
list of pairs): every class is written once and no copies of it are made, whatever the
number of chunks that its own meets.  Disk stays in proportion to the rows; what
repeats is reading.

Within a pair of chunks, tiles of rows whose boxes are too far apart are left out.  For
the others the coordinates are cut into ``blocks`` subspaces: the cosine is at most the
product over the first half of them, plus the product of the two vectors' lengths in
each other one.  This bound is one matrix product; few unrelated pairs pass.  Those are
looked at whole, in single precision with its error allowed for, and in double precision
wherever that leaves a doubt.  What leaves a pair of chunks is bounded by its rows: a
count of links for each vector, and a spanning forest of the links.

Vectors without any structure lie in boxes that all meet.  Then every pair of classes is
in one product, and the work grows with the square of their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestitch.llm.base import arrow_ready
from lodestitch.operators.components import connected_components
from lodestitch.operators.scratch import Scratch

#: Points that a chunk may hold, and bytes of their vectors.
CELL_LIMIT = 32_768
CELL_BYTES = 16 << 20
#: Points that a chunk is meant to hold, and chunks that a table is cut into before they grow beyond the least.
CELL_TARGET, CELL_LEAST, CELLS = 24_576, 4_096, 8
SEED = 17
#: Coordinates whose signs are the cell.
_SIGNS = 24
#: Rows of either chunk in one product, and links that are held before they are merged.
_TILE, _HELD = 512, 1 << 20
#: Share of a tile that may pass the bound before the tile is multiplied whole.
_DENSE = 64


@cache
def rotation(dims: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def cuts(dims: int, blocks: int) -> list[slice]:
    edges = np.linspace(0, dims, min(blocks, dims) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]


def slack(dims: int | Column) -> float | Column:
    """More than a product of two unit vectors of single precision can be off."""
    return (dims + 16) * 2.0**-21


def usable(vector: Column) -> Column:
    """Whether a vector links at all: it has components, none null or non-finite, one not zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that squares neither overflow nor vanish; no digit is lost."""
    v = v.astype(np.float64)
    power = -np.frexp(np.maximum(v.max(axis=1), -v.min(axis=1)))[1][:, None]
    return v * np.ldexp(1.0, power) if np.abs(power).max(initial=0) < 500 else np.ldexp(v, power)


def _turned(v: np.ndarray) -> np.ndarray:
    """The unit vectors of rows, rotated, in single precision."""
    v = _scaled(v)
    return (v @ rotation(v.shape[1]) / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]).astype(np.float32)


class Points:
    """The vectors of a chunk, with all that its meetings need of them."""

    def __init__(self, v: np.ndarray, blocks: int):
        self.v, self.unit = v, _turned(v)
        parts = cuts(v.shape[1], blocks)
        head = (len(parts) + 1) // 2
        lengths = [np.sqrt(np.einsum("ij,ij->i", self.unit[:, p], self.unit[:, p]))[:, None] for p in parts[head:]]
        self.bound = np.hstack([self.unit[:, : parts[head - 1].stop], *lengths])

    def __len__(self) -> int:
        return len(self.unit)

    @cached_property
    def boxes(self) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest coordinates of the tiles."""
        n, dims = self.unit.shape
        even = n - n % _TILE
        tiles = [t for t in (self.unit[:even].reshape(-1, _TILE, dims), self.unit[None, even:]) if t.size]
        return np.concatenate([t.min(axis=1) for t in tiles]), np.concatenate([t.max(axis=1) for t in tiles])

    def cosines(self, rows: np.ndarray, other: Points, others: np.ndarray) -> np.ndarray:
        """In double precision, of the vectors as they came."""
        a, b = _scaled(self.v[rows]), _scaled(other.v[others])
        return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def _meeting(x: Points, y: Points, least: float) -> np.ndarray:
    """Which tiles of two chunks have boxes near enough."""
    (xl, xh), (yl, yh) = x.boxes, y.boxes
    gap = np.maximum(0, np.maximum(xl[:, None] - yh[None], yl[None] - xh[:, None])).astype(np.float64)
    return (gap * gap).sum(axis=2) <= 2 - 2 * least + 2 * slack(x.unit.shape[1])


def chunk_links(x: Points, y: Points, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the linked pairs of two chunks (``i < j`` if they are the same one), tile by tile."""
    same, doubt = x is y, slack(x.unit.shape[1])
    right = [np.ascontiguousarray(y.bound[first : first + _TILE].T) for first in range(0, len(y), _TILE)]
    full = np.empty((_TILE, _TILE), np.float32)
    for s, t in np.argwhere(_meeting(x, y, least)):
        if same and t < s:
            continue
        top, first = s * _TILE, t * _TILE
        left = x.bound[top : top + _TILE]
        tile = np.matmul(left, right[t], out=full if (len(left), right[t].shape[1]) == full.shape else None)
        if tile.max() < least - doubt:
            continue
        some = np.flatnonzero(tile.max(axis=1) >= least - doubt)
        i, j = np.nonzero(tile[some] >= least - doubt)
        if len(i) * _DENSE > tile.size:
            tile = x.unit[top : top + _TILE] @ y.unit[first : first + _TILE].T
            i, j = np.nonzero(tile >= least - doubt)
            cosine = tile[i, j]
            i, j = i + top, j + first
        else:
            i, j = some[i] + top, j + first
            cosine = np.einsum("ij,ij->i", x.unit[i], y.unit[j])
        ok = cosine >= least + doubt
        unsure = np.flatnonzero(~ok & (cosine >= least - doubt))
        if len(unsure):
            ok[unsure] = x.cosines(i[unsure], y, j[unsure]) >= least
        if same:
            ok &= i < j
        yield i[ok], j[ok]


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label``, the least node of each node's component, with more edges, by hooking and jumping."""
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(up := label[label], label):
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def meet(x: Points, y: Points, sizes: tuple[np.ndarray, np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row of two chunks with multiplicities ``sizes``, and the least row linked, rows of ``y`` after those of ``x``."""
    after = 0 if x is y else len(x)
    degree, label = np.zeros(after + len(y)), np.arange(after + len(y))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for i, j in chunk_links(x, y, least):
        if not len(i):
            continue
        for rows, others, weights in ((i, j, sizes[1]), (j + after, i, sizes[0])):
            start = rows.min()
            more = np.bincount(rows - start, weights[others])
            degree[start : start + len(more)] += more
        a, b = i, j + after
        open_ = label[a] != label[b]
        if open_.any():
            held.append((a[open_], b[open_]))
        if sum(len(h[0]) for h in held) > _HELD:
            label, held = _joined(label, *map(np.concatenate, zip(*held))), []
    if held:
        label = _joined(label, *map(np.concatenate, zip(*held)))
    return degree, label


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` with the length of their vectors, ``dims``, and the cell they lie in."""
    schema = T.StructType([*rows.schema.fields, T.StructField("dims", T.IntegerType()), T.StructField("cell", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch["v"]
            widths = v.value_lengths().to_numpy(zero_copy_only=False)
            cell = np.zeros(len(widths), np.int64)
            for dims in np.unique(widths).tolist():
                here = np.flatnonzero(widths == dims)
                signs = _turned(v.take(pa.array(here)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))[:, :_SIGNS] > 0
                cell[here] = signs @ (1 << np.arange(signs.shape[1])[::-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(widths.astype(np.int32)), pa.array(cell)], names=schema.names)

    return arrow_ready(rows).mapInArrow(place, schema)


def _chunks(classes: DataFrame, rows: int, single: bool) -> DataFrame:
    """Classes ``(a, b, least, size, v, dims, cell)``, of ``rows`` rows at most, in chunks, one row each.

    A class is known by a number, ``chunk`` plus its place, never by an id, which rows may share.
    """
    limit, most, kind = CELL_LIMIT, CELL_BYTES, np.float32 if single else np.float64
    order = ["dims", "cell", "a", "b"]
    target = min(CELL_TARGET, max(CELL_LEAST, rows // CELLS))
    dealt = classes.repartitionByRange(max(1, math.ceil(rows / target)), *order).sortWithinPartitions(*order)
    longs = ("a", "b", "least", "size")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = TaskContext.get().partitionId() << 33, []

        def chunk() -> pa.RecordBatch:
            nonlocal at, held
            part, held = pa.Table.from_batches(held).combine_chunks().to_batches()[0], []
            dims = part["dims"][0].as_py()
            v = part["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(kind)
            unit = _turned(v)
            lists = [pa.array([x]) for x in (unit.min(axis=0), unit.max(axis=0))] + [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part[c]) for c in longs]
            out = pa.RecordBatch.from_arrays([pa.array([at]), pa.array([dims], pa.int32()), *lists, pa.array([v.tobytes()], pa.binary())], names=["chunk", "dims", "lo", "hi", *longs, "v"])
            at += len(part)
            return out

        for batch in batches:
            dims, start = batch["dims"].to_numpy(), 0
            while start < len(dims):
                same = held and held[0]["dims"][0].as_py() == dims[start]
                room = max(1, min(limit, most // (int(dims[start]) * kind().itemsize))) - sum(map(len, held))
                if held and (not same or room <= 0):
                    yield chunk()
                    continue
                stop = start + min(room, int(np.searchsorted(dims[start:], dims[start], "right")))
                held.append(batch.slice(start, stop - start))
                start = stop
        if held:
            yield chunk()

    return dealt.mapInArrow(pack, "chunk long, dims int, lo array<float>, hi array<float>, a array<long>, b array<long>, least array<long>, size array<long>, v binary")


def _links(chunks: DataFrame, least: float, blocks: int, single: bool) -> DataFrame:
    """``(rep, root, links)``: counts of links that add up, and edges that span them."""
    kind = np.float32 if single else np.float64
    columns = ("chunk", "dims", "lo", "hi", "size", "v")
    x, y = (chunks.select(*(F.col(c).alias(f"{c}_{side}") for c in columns)) for side in "xy")
    over = lambda p, q: F.aggregate(F.zip_with(p, q, lambda lo, hi: F.greatest((lo - hi).cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, d: s + d * d)
    near = over(F.col("lo_x"), F.col("hi_y")) + over(F.col("lo_y"), F.col("hi_x")) <= 2 - 2 * least + 2 * slack(F.col("dims_x"))
    met = x.hint("shuffle_replicate_nl").join(y, (F.col("chunk_x") <= F.col("chunk_y")) & (F.col("dims_x") == F.col("dims_y")) & near)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, x = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                dims = batch["dims_x"][row].as_py()
                points = lambda side: Points(np.frombuffer(batch[f"v_{side}"][row].as_buffer(), kind).reshape(-1, dims), blocks)  # noqa: B023, E731
                a, b = batch["chunk_x"][row].as_py(), batch["chunk_y"][row].as_py()
                if a != left:
                    left, x = a, points("x")
                y = x if a == b else points("y")
                sizes = tuple(batch[f"size_{side}"][row].values.to_numpy() for side in "xy")
                degree, label = meet(x, y, sizes, least)
                ids = b + np.arange(len(y)) if a == b else np.concatenate([a + np.arange(len(x)), b + np.arange(len(y))])
                hit = np.flatnonzero(degree)
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(ids[label[hit]]), pa.array(degree[hit].astype(np.int64))], names=["rep", "root", "links"])

    return met.select("chunk_x", "chunk_y", "dims_x", "size_x", "size_y", "v_x", "v_y").mapInArrow(links, "rep long, root long, links long")


def link(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, blocks: int = 4) -> DataFrame:
    """Links between vectors of cosine ``least`` or more, and their components.

    Returns ``(vec_id, n_links, component_id, kept)`` per input row: links count other
    rows, component_id is the least vec_id that links reach, and the row with that id
    is kept.

    * Null, empty and zero vectors, and those with null or non-finite components, link
      with nothing and are their own components.  Vectors of different lengths never link.
    * Repeated rows are vectors of their own: equal vectors link with each other.
    * A row with a null id counts as a link of others.  It never names a component, but
      gets the component of its equals or neighbours; alone it has a null one.
    * Other columns are ignored, whatever their names.  An empty table gives an empty result.
    """
    store = Scratch(embeddings.sparkSession, "vectors")
    single = embeddings.schema[vector_col].dataType == T.ArrayType(T.FloatType())
    kind = "float" if single else "double"  # components of single precision travel as such, and are doubles wherever they are compared
    vector = F.transform(F.col(vector_col).cast(f"array<{kind}>"), lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x))
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("v")).withColumn("ok", usable(F.col("v")))
    # Equal vectors are grouped by two hashes: 128 bits.
    hashes = (F.xxhash64("v"), F.xxhash64(F.lit(1), "v", F.size("v")))
    rows = rows.select("vec_id", "v", *(F.when(F.col("ok"), h).alias(c) for c, h in zip("ab", hashes)))
    classes = _placed(rows.where(F.col("a").isNotNull())).groupBy("a", "b").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("size"), F.first("v").alias("v"), F.min("dims").alias("dims"), F.min("cell").alias("cell"))
    chunks = store.write(_chunks(classes, embeddings.count(), single))
    # Dealt out, so that the many tasks of the join write no file each.
    found = store.write(_links(chunks, least, blocks, single).repartition("rep"))
    degrees = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = connected_components(found, "rep", "root", store).withColumnRenamed("node", "rep")
    members = chunks.select("chunk", F.posexplode(F.arrays_zip("a", "b", "least", "size")).alias("pos", "m")).select((F.col("chunk") + F.col("pos")).alias("rep"), "m.*")
    # Most classes link with no other, and few rows need the number of a component.
    names = members.join(comps, "rep").groupBy("component").agg(F.min("least").alias("component_id"))
    linked = store.write(degrees.join(comps, "rep").join(names, "component").select("rep", "links", "component_id", F.lit(True).alias("linked")))
    labels = members.join(linked, "rep", "left")
    component_id = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least"))
    # Written, so that a join on a very common vector meets a plain table and Spark can split it.
    labels = store.write(labels.select("a", "b", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), component_id.alias("component_id")))
    out = rows.select("vec_id", "a", "b").join(labels, ["a", "b"], "left")
    component = F.when(F.col("a").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
