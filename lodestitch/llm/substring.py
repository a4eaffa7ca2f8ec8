"""Removal of repeated word sequences by level-wise doubling.

Level one looks at word windows of half the final length.  Every full window
contains ``window - base + 1`` of them; the one with the least hash (its anchor)
depends on the window's words alone, so a repeated window has a repeated anchor and
only anchors have to be counted.  Consecutive windows with one anchor form a run.

Level two doubles the length, for windows of runs whose anchor repeats, and for no
others: first whole runs are compared by their content, then the windows of one
representative of every distinct run.  What still repeats there is removed wherever
an earlier occurrence exists; nothing survives for another level.

Before any exchange a task settles what it can among its own rows: of many equal
keys it ships the earliest only and marks the rest as settled.  A passage that a
third of all documents share thus sends one row per task to its reducer.  The shuffle
of the texts by document serves both joins that need them.

A document is known by its id ``d`` and a number ``h`` that is zero where the id has one
text only, and the text's 64-bit hash where several texts share the id, as all those
without one do.  What is found in a text therefore never touches another.

Hashes: an anchor is 64 bits, and runs and windows are told apart by their own 64
bits together with those of the anchor.  Words are remembered up to a number of bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestitch.llm.base import arrow_ready, raw_texts, slices
from lodestitch.operators.scratch import Scratch

#: Text that a task gathers before it settles equal keys among its rows.
BLOCK_BYTES = 48 << 20
#: Bytes of words that a task remembers the hashes of, and bytes that a word counts for besides its own.
CACHE_BYTES, _WORD_BYTES = 64 << 20, 120
_NULL_ID = (1 << 63) - 1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _WordHashes(dict):
    room = CACHE_BYTES

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        self.room -= len(word) + _WORD_BYTES
        if self.room < 0:
            self.clear()
            self.room = CACHE_BYTES - len(word) - _WORD_BYTES
        if self.room > 0:
            self[word] = value
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    return x ^ (x >> np.uint64(29))


def ngram_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every window of ``length`` words, by doubling."""
    if len(words) < length:
        return words[:0]
    if length == 1:
        return _mix(words)
    half = length // 2
    h = ngram_hashes(words, half)
    out = _mix(h[: len(words) - 2 * half + 1] * _B + _mix(h[half : half + len(words) - 2 * half + 1]))
    if length % 2:
        out = _mix(out[:-1] * _B + words[length - 1 :])
    return out


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    rest = width - size
    return np.minimum(a[: len(a) - rest], a[rest:]) if rest else a


def _joined(doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with neighbouring ones of a document made one."""
    order = np.lexsort((start, doc[:, 1], doc[:, 0]))
    doc, start, end = doc[order], start[order], (start + count)[order]
    head = np.ones(len(doc), bool)
    head[1:] = (doc[1:] != doc[:-1]).any(axis=1) | (start[1:] > end[:-1])
    at = np.flatnonzero(head)
    last = np.append(at[1:], len(doc)) - 1 if len(at) else at
    return doc[at], start[at], end[last] - start[at]


class _Hasher:
    """Runs of windows of a list of texts; the word cache lives as long as the task."""

    def __init__(self, window: int):
        self.window, self.base = window, (window + 1) // 2
        self.cache = _WordHashes()

    def runs(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """(text index, start, count, anchor) of each run, the hashes of all windows, where
        each run's begin, and whether a run may hold one window twice."""
        get, parts, counts = self.cache.__getitem__, [], []
        for text in texts:
            words = text.split()
            counts.append(len(words))
            parts.append(np.fromiter(map(get, words), np.uint64, len(words)))
        words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        counts = np.array(counts, dtype=np.int64)
        offset = np.cumsum(counts) - counts
        small = ngram_hashes(words, self.base)
        step = self.window - self.base
        if len(words) < self.window:
            none = np.zeros(0, np.int64)
            return none, none, none, small[:0], small[:0], none, none > 0
        anchor = _sliding_min(small, step + 1)
        full = _mix(small[: len(anchor)] * _B + _mix(small[step : step + len(anchor)]))
        starts = np.maximum(counts - self.window + 1, 0)
        of = np.repeat(np.arange(len(texts)), starts)
        within = np.arange(len(of)) - np.repeat(np.cumsum(starts) - starts, starts)
        at = offset[of] + within
        anchor, full = anchor[at], full[at]
        first = np.ones(len(of), bool)
        first[1:] = (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])
        heads = np.flatnonzero(first)
        size = np.diff(np.append(heads, len(of)))
        # A window that comes again in its own run repeats the anchor a few words on.
        echo = np.zeros(len(small) + 1, np.int64)
        for lag in range(1, step + 1):
            echo[1 : len(small) - lag + 1] |= small[:-lag] == small[lag:]
        echo = np.cumsum(echo)
        loops = (size > step + 1) | (echo[at[heads] + size + step] > echo[at[heads]])
        return of[heads], within[heads], size, anchor[heads], full, heads, loops


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _settle(keys: tuple[np.ndarray, ...], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are the earliest of their key here, and those that come after another row."""
    order = np.lexsort((start, doc[:, 1], doc[:, 0], *keys))
    new = np.ones(len(order), bool)
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    new[1:] = ~same
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    d, s = doc[order], start[order]
    later = (d != d[head]).any(axis=1) | (s != s[head])
    return order[new], order[later]


def _spread(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A key of its own for each settled row, so that no reducer gets many of them."""
    d = doc.view(np.uint64)
    return _signed(_mix(_mix(d[:, 0] + d[:, 1] * _A) * _B + start.astype(np.uint64)))


def _documents(batch: pa.RecordBatch, first: int) -> np.ndarray:
    """Rows ``(d, h)`` of two columns of a batch."""
    return np.column_stack([batch.column(first + i).to_numpy(zero_copy_only=False) for i in range(2)])


def _columns(k1: np.ndarray, k2: np.ndarray, doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> list[pa.Array]:
    return [pa.array(k1), pa.array(k2), pa.array(doc[:, 0]), pa.array(doc[:, 1]), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))]


def repeated_spans(docs: DataFrame, window: int = 20) -> DataFrame:
    """``(d, h, spans)`` per document that loses words: packed ``start << 32 | count`` runs of windows.

    ``docs`` has ``doc_id``, ``d`` and ``h`` (long, the last two never null) and ``text``.
    """

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = _Hasher(window), [], 0

        def flush() -> pa.RecordBatch:
            key, doc, start, known = (np.concatenate(x) for x in zip(*held))
            first = np.ones(len(key), bool)
            order = np.argsort(key, kind="stable")
            again = np.zeros(len(key), bool)
            again[1:] = key[order][1:] == key[order][:-1]
            first[order] = ~again
            known[order[1:]] |= again[1:]
            known[order[:-1]] |= again[1:]
            key = np.where(first, _signed(key), _spread(doc, start))
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc[:, 0]), pa.array(doc[:, 1]), pa.array(start.astype(np.int32)), pa.array(known)], names=["k", "d", "h", "s", "known"])

        for batch in batches:
            texts, ids = raw_texts(batch, 2), _documents(batch, 0)
            for a, b in slices(texts):
                of, start, _, anchor, _, _, loops = hasher.runs([t or b"" for t in texts[a:b]])
                held.append((anchor, ids[a:b][of], start, loops))
                size += sum(len(t or b"") for t in texts[a:b])
                if size >= BLOCK_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = _Hasher(window), [], 0
        names = ["k1", "k2", "d", "h", "s", "n", "windows", "known"]

        def flush() -> Iterator[pa.RecordBatch]:
            span, anchor, doc, start, count = (np.concatenate([h[i] for h in held]) for i in range(5))
            blobs = [x for h in held for x in h[5]]
            ship, settled = _settle((span, anchor), doc, start)
            yield pa.RecordBatch.from_arrays([*_columns(_signed(span[ship]), _signed(anchor[ship]), doc[ship], start[ship], count[ship]), pa.array([blobs[i] for i in ship.tolist()], pa.binary()), pa.array(np.zeros(len(ship), bool))], names=names)
            d, s, n = _joined(doc[settled], start[settled], count[settled])
            yield pa.RecordBatch.from_arrays([*_columns(_spread(d, s), np.zeros(len(d), np.int64), d, s, n), pa.array([b""] * len(d), pa.binary()), pa.array(np.ones(len(d), bool))], names=names)

        for batch in batches:
            texts, ids, chosen = raw_texts(batch, 2), _documents(batch, 0), batch.column(3)
            for a, b in slices(texts):
                of, start, count, anchor, full, heads, _ = hasher.runs([t or b"" for t in texts[a:b]])
                part = chosen.slice(a, b - a)
                want_of = np.repeat(np.arange(b - a), part.value_lengths().to_numpy(zero_copy_only=False))
                want = (want_of << 32) | part.flatten().to_numpy(zero_copy_only=False)
                keep = np.flatnonzero(np.isin((of << 32) | start, want))
                place = np.arange(len(full)) - np.repeat(heads, count) if len(full) else np.zeros(0, np.int64)
                span = np.add.reduceat(_mix(full + place.astype(np.uint64) * _B), heads) if len(heads) else full[:0]
                raw = full.astype("<u8").tobytes()
                blobs = [raw[8 * h : 8 * (h + c)] for h, c in zip(heads[keep].tolist(), count[keep].tolist())]
                held.append((span[keep], anchor[keep], ids[a:b][of[keep]], start[keep], count[keep], blobs))
                size += 100 * len(keep) + sum(map(len, blobs))
                if size >= BLOCK_BYTES:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, anchor, doc, start = (np.concatenate(x) for x in zip(*held))
            ship, settled = _settle((key, anchor), doc, start)
            yield emit(_signed(key[ship]), _signed(anchor[ship]), doc[ship], start[ship], np.ones(len(ship)), False)
            d, s, n = _joined(doc[settled], start[settled], np.ones(len(settled), np.int64))
            yield emit(_spread(d, s), np.zeros(len(d), np.int64), d, s, n, True)

        def emit(k1, k2, doc, start, count, known: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*_columns(k1, k2, doc, start, count), pa.array(np.full(len(doc), known))], names=["k1", "k2", "d", "h", "s", "n", "known"])

        for batch in batches:
            doc = _documents(batch, 1)
            k2, start, count = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 3, 4))
            gone = batch.column(6).to_numpy(zero_copy_only=False)
            if gone.any():
                d, s, n = _joined(doc[gone], start[gone], count[gone])
                yield emit(_spread(d, s), np.zeros(len(d), np.int64), d, s, n, True)
            stay = np.flatnonzero(~gone)
            if len(stay):
                hashes = np.frombuffer(b"".join(batch.column(5).take(pa.array(stay)).to_pylist()), "<u8")
                n = count[stay]
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                held.append((hashes, np.repeat(k2[stay].view(np.uint64), n), np.repeat(doc[stay], n, axis=0), np.repeat(start[stay], n) + place))
                size += 32 * len(hashes)
            if size >= BLOCK_BYTES:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    found = docs.select("d", "h", "text").mapInArrow(anchors, "k long, d long, h long, s int, known boolean")
    repeated = found.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("k"))).where("known or c > 1")
    starts = repeated.groupBy("d", "h").agg(F.collect_list(F.col("s").cast("long")).alias("starts"))
    # With doc_id, though it is not needed here: so both joins read the same columns, and the texts are dealt out once.
    runs = docs.join(starts, ["d", "h"]).select("d", "h", "text", "starts", "doc_id").mapInArrow(extend, "k1 long, k2 long, d long, h long, s int, n int, windows binary, known boolean")
    order = Window.partitionBy("k1", "k2").orderBy("d", "h", "s")
    judged = runs.withColumn("gone", F.col("known") | (F.rank().over(order) > 1)).select("k2", "d", "h", "s", "n", "windows", "gone")
    single = judged.mapInArrow(unfold, "k1 long, k2 long, d long, h long, s int, n int, known boolean")
    removed = single.withColumn("gone", F.col("known") | (F.rank().over(order) > 1)).where("gone")
    return removed.groupBy("d", "h").agg(F.collect_list(F.shiftleft(F.col("s").cast("long"), 32).bitwiseOR(F.col("n").cast("long"))).alias("spans"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, d, h, text)`` per row of ``docs``."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = base.withColumn("d", F.coalesce("doc_id", F.lit(_NULL_ID)))
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    # Ids with several texts: written, so that Spark knows whether they are few enough to broadcast.
    several = base.groupBy("d").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).where("low <> high").select("d", F.lit(True).alias("several"))
    several = Scratch(docs.sparkSession, "substring").write(several)
    return base.join(several, "d", "left").select("doc_id", "d", F.when(F.col("several"), mark).otherwise(F.lit(0).cast("long")).alias("h"), "text")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, with_text: bool = True) -> DataFrame:
    """Removes every word covered by a window of ``window`` words that also starts earlier.

    Earlier means in a document with a smaller id, or further ahead in the same one.
    Windows are judged on the input.  Words are runs of characters other than ASCII
    white space.  Returns ``(doc_id, n_words, n_removed, kept_sha256)`` per input row,
    and the kept words joined by single spaces as ``text`` if ``with_text``.

    * A null text has no words; a text shorter than a window loses none.
    * Rows with the same doc_id and text are one document, so plain repetitions of a row
      change nothing.  Rows with the same doc_id and different texts are documents of
      their own, in the order of a hash of their texts; so are the rows without an id,
      which come after all others.
    * Of equal windows the first in order stays; an empty table gives an empty result.
    * Other columns are ignored, whatever their names.
    """
    base = arrow_ready(_keyed(docs, id_col, text_col))
    spans = repeated_spans(base, window)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = raw_texts(batch, 1), batch.column(2).to_pylist()
            total, gone, digest, kept_text = [], [], [], []
            for text, marks in zip(texts, spans):
                words = (text or b"").split()
                cover = np.zeros(len(words) + 1, np.int64)
                for mark in marks or ():
                    start, end = mark >> 32, (mark >> 32) + (mark & 0xFFFFFFFF) + window - 1
                    if start < len(words):
                        cover[start] += 1
                        cover[min(end, len(words))] -= 1
                lost = np.cumsum(cover[:-1]) > 0
                kept = b" ".join([w for w, x in zip(words, lost.tolist()) if not x] if lost.any() else words)
                total.append(len(words))
                gone.append(int(lost.sum()))
                digest.append(hashlib.sha256(kept).hexdigest())
                kept_text.append(kept.decode() if with_text else None)
            columns = [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept_text, pa.string())] * with_text, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * with_text)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text
    return base.join(spans, ["d", "h"], "left").select("doc_id", "text", "spans").mapInArrow(finish, schema)
