"""Benchmark decontamination with a distributed positional inverted index.

The index is cut by document: each block of about ``BLOCK_BYTES`` of text is one row
of a stored table and holds, for every term of the block, the sorted positions of its
tokens.  A term in half of all documents is thus spread over all blocks, and a query
needs no shuffle: a document's postings are all in one row.

A phrase is looked up from its rarest term in the block.  That term's positions, less
its place in the phrase, are the candidate starts; they are intersected with the lists
of the other terms, adjusted likewise, from rare to frequent.  What is left are exact
phrase matches.  Proximity matches ask that all terms lie within the phrase's length
and ``slop`` more words, in any order.

A block looks up each distinct word of the phrases once and then only phrases whose
words it all has.  The phrases go to all tasks, ``MAX_PHRASE_WORDS`` words of them at a time.  A larger
benchmark is looked up in as many passes over the index as that takes, one after the
other: the driver and the tasks hold the phrases of one pass, whose hits are written
before the next is made.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestitch.llm.base import arrow_ready, raw_texts
from lodestitch.operators.scratch import Scratch

BLOCK_BYTES = 8 << 20
#: Words of benchmark text that are broadcast at once: the proven bound.
MAX_PHRASE_WORDS = 400_000
WINDOW = 10

#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space.
_FOLD = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

_INDEX = "block string, docs binary, null_docs binary, starts binary, sizes binary, terms binary, bounds binary, postings binary"


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = WINDOW) -> DataFrame:
    """One row per block: documents, their first positions, terms and postings.

    ``gap`` empty positions after each document keep phrases inside one document.
    """

    def pack(ids: list, texts: list[bytes | None]) -> pa.RecordBatch:
        number: dict[bytes, int] = {}
        parts, starts, at = [], [0], 0
        for text in texts:
            words = tokens(text)
            parts.append((at, np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))))
            at += len(words) + gap
            starts.append(at)
        term = np.concatenate([p for _, p in parts])
        place = np.concatenate([np.arange(a, a + len(p), dtype=np.int32) for a, p in parts])
        names = sorted(number)
        rank = np.empty(len(number), np.int32)
        rank[[number[n] for n in names]] = np.arange(len(names), dtype=np.int32)
        term = rank[term] if len(names) else term
        order = np.argsort(term, kind="stable")
        bounds = np.searchsorted(term[order], np.arange(len(names) + 1)).astype(np.int32)
        place = place[order]
        delta = np.diff(place, prepend=np.int32(0)).astype(np.int32)
        null = np.array([i is None for i in ids])
        sizes = np.array([len(p) for _, p in parts], np.int32)
        row = [np.array([i or 0 for i in ids], np.int64), null, np.array(starts, np.int32), sizes, b" ".join(names), bounds, delta]
        packed = [pa.array([x if isinstance(x, bytes) else x.tobytes()], pa.binary()) for x in row]
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *packed], names=[c.split()[0] for c in _INDEX.split(", ")])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), raw_texts(batch, 1)):
                ids.append(i)
                texts.append(t)
                size += len(t or b"")
                if size >= BLOCK_BYTES:
                    yield pack(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield pack(ids, texts)

    return arrow_ready(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))).mapInArrow(blocks, _INDEX)


class Block:
    """One row of the index, opened."""

    def __init__(self, docs: bytes, null_docs: bytes, starts: bytes, sizes: bytes, terms: bytes, bounds: bytes, postings: bytes):
        self.docs = [None if n else d for d, n in zip(np.frombuffer(docs, np.int64).tolist(), np.frombuffer(null_docs, bool).tolist())]
        self.starts = np.frombuffer(starts, np.int32)
        self.sizes = np.frombuffer(sizes, np.int32).astype(np.int64)
        self.number = {t: i for i, t in enumerate(terms.split())}
        self.bounds = np.frombuffer(bounds, np.int32)
        self.places = np.cumsum(np.frombuffer(postings, np.int32), dtype=np.int32)

    def postings(self, term: int) -> np.ndarray:
        return self.places[self.bounds[term] : self.bounds[term + 1]]

    def rare_first(self, phrase: tuple[bytes, ...]) -> list[tuple[int, int]] | None:
        """(term, offset) from the rarest term on; None if a term does not occur."""
        found = []
        for offset, word in enumerate(phrase):
            term = self.number.get(word)
            if term is None:
                return None
            found.append((self.bounds[term + 1] - self.bounds[term], term, offset))
        return [(t, o) for _, t, o in sorted(found)]

    def phrase(self, phrase: tuple[bytes, ...]) -> np.ndarray:
        """Positions at which the phrase starts."""
        order = self.rare_first(phrase)
        if not order:
            return np.zeros(0, np.int32)
        term, offset = order[0]
        starts = self.postings(term) - offset
        for term, offset in order[1:]:
            if not len(starts):
                break
            other = self.postings(term)
            at = np.searchsorted(other, starts + offset)
            starts = starts[(at < len(other)) & (other[np.minimum(at, len(other) - 1)] == starts + offset)]
        return starts

    def near(self, phrase: tuple[bytes, ...], slop: int) -> np.ndarray:
        """Positions of the rarest term at which all terms lie within the phrase's length and ``slop``."""
        order = self.rare_first(tuple(dict.fromkeys(phrase)))
        if not order:
            return np.zeros(0, np.int32)
        span, pivot = len(phrase) + slop, self.postings(order[0][0])
        doc = np.searchsorted(self.starts, pivot, side="right")
        best = np.zeros(len(pivot), bool)
        for back in range(span):  # the window of `span` words that begins `back` words before the pivot
            low = np.maximum(pivot - back, self.starts[doc - 1])
            ok = np.ones(len(pivot), bool)
            for term, _ in order[1:]:
                other = self.postings(term)
                at = np.searchsorted(other, low)
                ok &= (at < len(other)) & (other[np.minimum(at, len(other) - 1)] < np.minimum(pivot - back + span, self.starts[doc]))
            best |= ok
        return pivot[best]


class Phrases:
    """Phrases with the ids of their items, and a table of their words by number."""

    def __init__(self, items: dict[tuple[bytes, ...], set]):
        self.phrases, self.items = list(items), list(items.values())
        number: dict[bytes, int] = {}
        rows = [[number.setdefault(w, len(number)) for w in p] for p in self.phrases]
        self.vocabulary = list(number)
        width = max(map(len, rows), default=1)
        # Shorter phrases are filled up with a word that every block has.
        self.words = np.array([r + [len(number)] * (width - len(r)) for r in rows], np.int32).reshape(-1, width)

    def within(self, block: Block) -> Iterator[tuple[tuple[bytes, ...], set]]:
        """Phrases all of whose words occur in the block."""
        present = np.fromiter((w in block.number for w in self.vocabulary), bool, len(self.vocabulary))
        held = np.append(present, True)[self.words].all(axis=1)
        return ((self.phrases[i], self.items[i]) for i in np.flatnonzero(held).tolist())


def phrases(benchmark: DataFrame, item_col: str, text_col: str, window: int, parts: int, part: int) -> Phrases:
    """The windows of one part of the benchmark, each with the ids of the items that have it."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part)
    found: dict[tuple[bytes, ...], set] = defaultdict(set)
    for row in rows.toLocalIterator():
        words = tokens((row.t or "").encode())
        for at in range(max(1, len(words) - window + 1)) if words else ():
            found[tuple(words[at : at + window])].add(row.i)
    return Phrases(found)


def find(index: DataFrame, shared: Broadcast, slop: int | None = None) -> DataFrame:
    """``(block, place, doc_id, n_words, hits, items)`` per document; hits are packed ``start << 32 | length``.

    ``shared`` are the phrases, broadcast.  With ``slop`` the hits are proximity matches,
    whose length is one word.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, *row in zip(*(c.to_pylist() for c in batch.columns)):
                block = Block(*row)
                hits: dict[int, set] = defaultdict(set)
                items: dict[int, set] = defaultdict(set)
                for phrase, names in shared.value.within(block):
                    places = block.phrase(phrase) if slop is None else block.near(phrase, slop)
                    for place, doc in zip(places.tolist(), (np.searchsorted(block.starts, places, side="right") - 1).tolist()):
                        hits[doc].add((place - int(block.starts[doc])) << 32 | (len(phrase) if slop is None else 1))
                        items[doc] |= names
                n = range(len(block.docs))
                columns = [pa.array([name] * len(n)), pa.array(n, pa.int64()), pa.array(block.docs, pa.int64()), pa.array(block.sizes, pa.int64())]
                columns += [pa.array([sorted(hits.get(d, ())) for d in n], pa.list_(pa.int64())), pa.array([sorted(x for x in items.get(d, ()) if x is not None) for d in n], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "place", "doc_id", "n_words", "hits", "items"])

    return index.mapInArrow(search, "block string, place long, doc_id long, n_words long, hits array<long>, items array<string>")


def covered(hits: Column) -> Column:
    """Number of words in the union of sorted packed hits."""
    start, size = lambda h: F.shiftright(h, 32), lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def step(acc: Column, h: Column) -> Column:
        end = F.greatest(acc["end"], start(h) + size(h))
        return F.struct((acc["n"] + end - F.greatest(acc["end"], F.least(start(h), end))).alias("n"), end.alias("end"))

    return F.aggregate(hits, zero, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """Words of each document that lie in a window of the benchmark.

    Returns ``(doc_id, n_words, n_hit, items, hits)`` per input row: items are the ids
    (as strings, sorted) of benchmark items of which a window occurs, hits the places.
    A window is ``window`` words of an item in a row, or all of a shorter item.

    * Null texts have no words, and items without words have no window.
    * Windows of items with a null id count as hits but name no item; items with one
      id are one item.  Repeated rows and null doc_ids of documents pass through.
    * An empty benchmark hits nothing; an empty table gives an empty result.
    """
    store = Scratch(docs.sparkSession, "postings")
    index = store.write(build_index(docs, id_col, text_col, window))
    total = benchmark.select(F.sum(F.length(F.col(item_text_col).cast("string")))).first()[0] or 0
    parts = 1 + total // (2 * MAX_PHRASE_WORDS)
    context = docs.sparkSession.sparkContext
    share = lambda part: context.broadcast(phrases(benchmark, item_col, item_text_col, window, parts, part))
    if parts == 1:
        out = find(index, share(0), slop)
    else:
        found = []
        for part in range(parts):
            shared = share(part)
            hits = find(index, shared, slop)
            # All documents come from the first pass, and what is hit from any.
            found.append(store.write(hits if part == 0 else hits.where(F.size("hits") > 0)))
            shared.destroy()
        out = found[0]
        for more in found[1:]:
            out = out.unionAll(more)
        both = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
        out = out.groupBy("block", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), both("hits").alias("hits"), both("items").alias("items"))
    return out.select("doc_id", "n_words", covered(F.col("hits")).alias("n_hit"), "items", "hits")
