"""Token counts by a linear longest-match automaton.

The vocabulary is a trie whose nodes carry a failure link and the number of pieces
that are popped when it is taken.  A word is read once, byte by byte: where the trie
has no edge, the popped pieces are counted and the walk goes on from the failure
link, so greedy longest-match word pieces are counted in linear time and never built.

The automaton grows with the vocabulary alone; it is built on the driver and
broadcast.  Tasks remember the counts of words they have seen, up to a bound.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestitch.llm.base import arrow_ready, raw_texts

#: Words that a task remembers, and bytes of the longest: the bound of its cache.
_CACHE_WORDS, _CACHE_WORD = 1_000_000, 64
#: Most pieces a vocabulary may have: the bound of what is broadcast.
MAX_PIECES = 2_000_000


class Automaton:
    """Counts greedy longest-match pieces of words.

    ``initial`` pieces may begin a word, ``inner`` pieces continue one.  A word that
    cannot be covered is one unknown piece.
    """

    ROOT, INNER, NONE = 0, 1, -1

    def __init__(self, initial: Iterable[bytes], inner: Iterable[bytes]):
        self.edges: dict[int, int] = {}
        parent, final = [self.NONE, self.NONE], {}
        size = 0
        for root, pieces in ((self.ROOT, initial), (self.INNER, inner)):
            for piece in pieces:
                node = root
                for byte in piece:
                    key = node << 8 | byte
                    following = self.edges.get(key)
                    if following is None:
                        following = self.edges[key] = len(parent)
                        parent.append(node)
                    node = following
                if piece:
                    final[node] = True
                size += 1
        if size > MAX_PIECES:
            raise ValueError(f"vocabulary of {size} pieces; {MAX_PIECES} at most are broadcast")
        self.fail = [self.NONE] * len(parent)
        self.pops = [0] * len(parent)
        children: dict[int, list[tuple[int, int]]] = {}
        for key, node in self.edges.items():
            children.setdefault(key >> 8, []).append((key & 255, node))
        queue = deque((self.ROOT, self.INNER))
        while queue:
            above = queue.popleft()
            for byte, node in children.get(above, ()):
                if node in final:
                    self.fail[node], self.pops[node] = self.INNER, 1
                else:
                    at, popped = self.fail[above], self.pops[above]
                    while at != self.NONE and at << 8 | byte not in self.edges:
                        popped += self.pops[at]
                        at = self.fail[at]
                    if at != self.NONE:
                        self.fail[node], self.pops[node] = self.edges[at << 8 | byte], popped
                queue.append(node)

    def count(self, word: bytes) -> int:
        """Pieces of one word; 0 for an empty word."""
        edges, fail, pops = self.edges, self.fail, self.pops
        node, total = self.ROOT, 0
        for byte in word:
            while (following := edges.get(node << 8 | byte)) is None:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = following
        while node > self.INNER:
            total += pops[node]
            node = fail[node]
            if node < 0:
                return 1
        return total


def byte_level_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces of a byte-level vocabulary file: those that begin with a space begin a word."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    # The byte-level alphabet: printable characters stand for themselves, the rest for 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    pieces = [bytes(byte_of[c] for c in token) for token in vocabulary if all(c in byte_of for c in token)]
    return [p for p in pieces if p[:1] == b" "], [p for p in pieces if p[:1] != b" "]


def count_tokens(docs: DataFrame, automaton: Automaton, id_col: str = "doc_id", text_col: str = "text", before_word: bytes = b" ") -> DataFrame:
    """``(doc_id, n_words, n_tokens)`` per input row.

    Words are runs of characters other than ASCII white space, and ``before_word`` is
    put before each, as byte-level vocabularies want it.  A null or blank text has no
    tokens; repeated rows and null ids pass through; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = shared.value.count

        class Seen(dict):
            def __missing__(self, word: bytes) -> int:
                value = count(before_word + word)
                if len(word) <= _CACHE_WORD:
                    if len(self) >= _CACHE_WORDS:
                        self.clear()
                    self[word] = value
                return value

        seen = Seen()
        for batch in batches:
            words, tokens = [], []
            for text in raw_texts(batch, 1):
                split = (text or b"").split()
                words.append(len(split))
                tokens.append(sum(map(seen.__getitem__, split)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return arrow_ready(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))).mapInArrow(rows, "doc_id long, n_words long, n_tokens long")
