"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear SVM.

The kernel of two words sums over their common subsequences of ``ORDER`` letters,
each weighted down by its gaps, and is normalised by length.  Words are compared by
letters only, in lower case, and lone letters in a row are read as one word, so
``m-o-r-o-n``, ``m o r o n`` and ``morxon`` all stay close to the word they disguise.

The training set is the distinct sentences of a bounded sample of labelled texts, each
with the label of its text, or 0 if a text labelled 0 has it as well.  A sentence is a
bag of words to the SVM: all words of a sentence labelled 0 are negative examples, and
a sentence labelled 1 has witnesses, or none if it is a harmless one of its text.
Witnesses are words that hold a letter sequence which sentences labelled 1 have far
more often than chance would give them.  Landmarks are drawn from witnesses and other
words, and a squared-hinge SVM is fitted on their Nystroem features.  A text scores by
its two worst words, which may be one word used twice, through a logistic curve fitted
on the sample: a word that only looks like an insult rarely comes twice.  Only texts
and labels are used.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestitch.llm.base import arrow_ready

#: Texts of either label that a fit takes at most; it picks them by a hash of their id.
MAX_TOXIC, MAX_CLEAN = 1_200, 3_600
#: Turns in which harmless words that score high join the negative examples, and words looked at.
MINING_TURNS, MINED_WORDS = 4, 80_000
#: Texts of the sample on which the logistic curve is fitted.
CURVE_TEXTS = 1_500
ORDER, DECAY = 3, 0.7
MAX_STEMS, MAX_LANDMARKS = 48, 128
#: How much likelier, at least, a text labelled 1 has to be for a sequence to be looked into.
LEAST_ODDS = 3.0
#: Longer words are scored in pieces of this many letters, one from every so many on, so that any 18 lie whole in one.
PIECE, STRIDE = 24, 6
THRESHOLD = 0.3
#: Steepest curve, so that words near the border keep middling scores.
MAX_SLOPE = 8.0
#: Least slope for the worst word, so that of two texts the one with the worse word never scores lower for it.
MIN_SLOPE = 0.1
#: Letters of the words whose scores a task remembers, with so many on top for each word.
_CACHE_LETTERS, _WORD_LETTERS = 150_000_000, 90
_NOT_LETTER = re.compile(r"[^\w\s]+|[\d_]+")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+|[\r\n]+")
_LONE = re.compile(r"(?<!\S)\w(?:\s\w){2,}(?!\S)")


def words_of(text: str | None) -> Counter:
    """Words of a text and their uses, by first use: letters only, lower case, runs of lone letters joined.

    Marks enclose every word, so that the kernel can tell where it begins and ends.
    """
    plain = _NOT_LETTER.sub("", (text or "").lower())
    words = Counter(plain.split())
    words.update("".join(run.split()) for run in _LONE.findall(plain))
    return Counter({f"^{w}$": n for w, n in words.items()})


def sentences_of(text: str | None) -> list[str]:
    """The sorted words of each sentence that has any, repeats included, in one string."""
    return [" ".join(sorted(words.elements())) for part in _SENTENCE_END.split(text or "") if (words := words_of(part))]


def _by_label(toxic: list[list[str]], clean: list[list[str]]) -> tuple[list[set[str]], list[set[str]]]:
    """Words of the distinct sentences of either label, by the first text that has them: copies teach nothing twice."""
    seen: set[str] = set()
    held: dict[str, str] = {}
    out: list[list[set[str]]] = []
    for texts in (clean, toxic):
        out.append([])
        for text in texts:
            new = [s for s in dict.fromkeys(text) if s not in seen]
            seen.update(new)
            out[-1].append({held.setdefault(w, w) for s in new for w in s.split(" ")})
    return out[1], out[0]


def _by_length(words: list[str], most: int = 4096) -> Iterator[tuple[list[int], np.ndarray]]:
    """Places of words of one length, and their characters, one row per position."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    start = 0
    while start < len(order):
        size, end = len(words[order[start]]), start + 1
        while end < len(order) and end - start < most and len(words[order[end]]) == size:
            end += 1
        places = order[start:end]
        if size:
            yield places, np.array([words[i] for i in places], dtype=f"<U{size}").view(np.uint32).reshape(len(places), size).T
        start = end


class Landmarks:
    """The landmarks' subsequences as a table.

    A subsequence of three letters is one cell of ``(letter, letter, letter)``, so the
    kernel of a word with all landmarks is a sum of table rows over the word's triples.
    """

    def __init__(self, marks: list[str]):
        self.marks = marks
        self.letters = np.array(sorted({ord(c) for w in marks for c in w}), dtype=np.uint32)
        n = len(self.letters) + 1
        self.table = np.zeros((n**3, len(marks)), np.float32)
        for k, mark in enumerate(marks):
            codes = self._codes(np.array([[ord(c)] for c in mark], dtype=np.uint32))[:, 0]
            for i in range(len(mark)):
                for j in range(i + 1, len(mark)):
                    for l in range(j + 1, len(mark)):
                        self.table[(codes[i] * n + codes[j]) * n + codes[l], k] += DECAY ** (l - i + 1)
        self.own = (self.table**2).sum(axis=0)

    def _codes(self, chars: np.ndarray) -> np.ndarray:
        """Numbers of letters; 0 for those that no landmark has."""
        if not len(self.letters):
            return np.zeros(chars.shape, np.intp)
        at = np.minimum(np.searchsorted(self.letters, chars), len(self.letters) - 1)
        return np.where(self.letters[at] == chars, at + 1, 0).astype(np.intp)

    def sums(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """Sum of table cells over the triples of each word, weighted by their spans."""
        n = len(self.letters) + 1
        out = np.zeros((len(words), *table.shape[1:]), np.float32)
        for places, chars in _by_length(words, 4096 if table.ndim == 1 else 512):
            c, total = self._codes(chars), np.zeros((len(places), *table.shape[1:]), np.float32)
            for i in range(len(c)):
                for j in range(i + 1, len(c)):
                    two = (c[i] * n + c[j]) * n
                    for l in range(j + 1, len(c)):
                        total += DECAY ** (l - i + 1) * table[two + c[l]]
            out[places] = total
        return out

    def similarity(self, words: list[str]) -> np.ndarray:
        """The kernel with every landmark, normalised by both lengths."""
        return self.sums(words, self.table) / np.sqrt(np.maximum(self_kernel(words)[:, None] * self.own, 1e-12))


def kernel(words: list[str], marks: list[str]) -> np.ndarray:
    """Gap-weighted subsequence kernel of order ``ORDER``, not normalised."""
    held = Landmarks(marks)
    return held.sums(words, held.table)


def self_kernel(words: list[str]) -> np.ndarray:
    """The kernel of each word with itself, by dynamic programming over all letters."""
    out = np.zeros(len(words), np.float32)
    for places, s in _by_length(words):
        width, n = s.shape
        prime = [np.ones((width + 1, n), np.float32)] + [np.zeros((width + 1, n), np.float32) for _ in range(ORDER - 1)]
        total = np.zeros(n, np.float32)
        for i in range(width):
            same = s == s[i]
            total += DECAY**2 * (same * prime[ORDER - 1][:width]).sum(axis=0)
            for q in range(ORDER - 1, 0, -1):
                run = np.zeros(n, np.float32)
                gain = (DECAY**2 * same) * prime[q - 1][:width]
                prime[q] *= DECAY
                for j in range(width):
                    run *= DECAY
                    run += gain[j]
                    prime[q][j + 1] += run
        out[places] = total
    return out


@dataclass
class Model:
    """Landmarks and weights of the word scorer, and the curve from scores to probabilities."""

    marks: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    bias: float = -1.0
    slope: float = 0.0
    offset: float = -20.0
    #: Weight of the second worst word beside the worst.
    second: float = 0.0

    def __post_init__(self):
        self.landmarks = Landmarks(self.marks)
        # The weighted sum over landmarks is a sum over their subsequences: one table, one look-up a triple.
        scale = np.asarray(self.weights) / np.sqrt(np.maximum(self.landmarks.own, 1e-12)) if self.marks else np.zeros(0, np.float32)
        self.table = (self.landmarks.table @ scale).astype(np.float32)

    def words(self, words: list[str]) -> np.ndarray:
        """SVM scores of words; those too short for the kernel get the bias."""
        out = np.full(len(words), self.bias, np.float32)
        if not self.marks:
            return out
        pieces: list[tuple[int, str]] = []
        for i, word in enumerate(words):
            if ORDER <= len(word) <= PIECE:
                pieces.append((i, word))
            elif len(word) > PIECE:
                pieces += [(i, word[a : a + PIECE]) for a in range(0, len(word) - PIECE + STRIDE, STRIDE)]
        texts = [w for _, w in pieces]
        score = self.landmarks.sums(texts, self.table) / np.sqrt(np.maximum(self_kernel(texts), 1e-12)) + self.bias
        long = np.full(len(words), -np.inf, np.float32)
        np.maximum.at(long, [i for i, _ in pieces], score)
        return np.where(np.isfinite(long), long, out)

    def worst(self, words: Counter, known: dict[str, float]) -> tuple[float, float, str | None]:
        """The scores of a text's two worst words, none below -1, where the SVM calls a word harmless, and the worst word."""
        if not words:
            return -1.0, -1.0, None
        values = list(map(known.__getitem__, words))
        first = max(values)
        at = values.index(first)
        word = next(islice(words, at, None))
        if words[word] == 1:
            values[at] = -1.0
        return max(first, -1.0), max(max(values), -1.0), word

    def probability(self, worst: np.ndarray) -> np.ndarray:
        """Of texts, one row of ``worst`` each."""
        return 1 / (1 + np.exp(-np.clip(worst @ np.array([self.slope, self.second]) + self.offset, -30, 30)))


def _grams(word: str) -> set[str]:
    return {word[a : a + n] for n in range(4, 9) for a in range(len(word) - n + 1)}


def _stems(toxic: list[set[str]], clean: list[set[str]]) -> list[str]:
    """Letter sequences that mark sentences labelled 1 beyond chance, over all sequences tried.

    Sentences of one text count once, as they share a writer.  Only words count that hardly any other clean text has,
    given how many toxic ones do: a harmless word that begins like an insult is common there and would hide it.
    """
    freq = Counter(w for words in clean for w in words)
    seen = Counter(w for words in toxic for w in words)
    toxic = [{w for w in words if freq[w] <= max(1, 0.1 * seen[w])} for words in toxic]
    clean = [{w for w in words if freq[w] - 1 <= max(1, 0.1 * seen[w])} for words in clean]
    t = Counter()
    for words in toxic:
        t.update({g for w in words for g in _grams(w)})
    t = Counter({g: n for g, n in t.items() if n >= 3})
    c = Counter()
    for words in clean:
        c.update({g for w in words for g in _grams(w) if g in t})
    share = len(toxic) / max(1, len(toxic) + len(clean))
    need = math.log(max(2, len(t))) + 3

    def gain(g: str) -> float:
        a, b = t[g], c[g]
        n = a + b
        if a * (1 - share) < LEAST_ODDS * b * share:
            return 0.0
        return a * math.log(a / (n * share)) + (b * math.log(b / (n * (1 - share))) if b else 0.0)

    ranked = sorted(((gain(g), len(g), g) for g in t), key=lambda x: (-round(x[0], 6), -x[1], x[2]))
    chosen: list[str] = []
    used: set[str] = set()
    for value, _, g in ranked:
        if value < need or len(chosen) == MAX_STEMS:
            break
        thirds = {g[i : i + 3] for i in range(len(g) - 2)}
        if not thirds & used:
            chosen.append(g)
            used |= thirds
    return chosen


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(x1.shape[1])
    reg = np.full(len(w), ridge)
    reg[-1] = 1e-6
    loss = lambda v: 0.5 * (reg * v * v).sum() + 0.5 * (cost * np.maximum(1 - y * (x1 @ v), 0) ** 2).sum()
    now = loss(w)
    for _ in range(100):
        margin = 1 - y * (x1 @ w)
        on = margin > 0
        xa, ca = x1[on], cost[on]
        grad = reg * w - xa.T @ (ca * y[on] * margin[on])
        hess = np.diag(reg) + (xa * ca[:, None]).T @ xa
        step, size = np.linalg.solve(hess, grad), 1.0
        while (after := loss(w - size * step)) > now and size > 1e-6:
            size /= 2
        if now - after < 1e-9 * now:
            break
        w, now = w - size * step, after
    return w[:-1], float(w[-1])


def _logistic(z: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Slopes of a weighted logistic curve, by projected Newton steps: the first one from ``MIN_SLOPE``, all to ``MAX_SLOPE``."""
    x = np.hstack([z, np.ones((len(z), 1))])
    low, high = np.array([MIN_SLOPE] + [0.0] * (z.shape[1] - 1) + [-np.inf]), np.array([MAX_SLOPE] * z.shape[1] + [np.inf])
    a = np.zeros(x.shape[1])
    a[0] = 1.0
    start, pull = a.copy(), np.array([1e-3] * z.shape[1] + [1e-9])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        grad = x.T @ (cost * (p - y)) + pull * (a - start)
        free = ~(((a <= low) & (grad > 0)) | ((a >= high) & (grad < 0)))
        hess = (x * (cost * p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.zeros(len(a))
        step[free] = np.clip(np.linalg.solve(hess[np.ix_(free, free)], grad[free]), -2, 2)
        a = np.clip(a - step, low, high)
        if np.abs(step).max() < 1e-6:
            break
    return a[:-1]


def train(toxic_texts: list[list[str]], clean_texts: list[list[str]], prior: float) -> Model:
    """Fits the model on the sentences of labelled texts; ``prior`` is the share of label 1 in all labels.

    Bounds of the fit, besides the texts: 4,000 positive words and 400 disguises of them,
    by use; as negative ones 2,000 words that hold a sequence, 6,000 that share three letters
    with one, 2,000 by use and 4,000 spread over the others; up to 2,000 more in each of
    ``MINING_TURNS`` turns, out of ``MINED_WORDS``.  The curve is fitted on a third of
    ``CURVE_TEXTS`` of label 1 and the rest of label 0.  They bound training alone: scores
    are of all words of whole texts.
    """
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    toxic, clean = _by_label(toxic_texts, clean_texts)
    flat = Model(offset=math.log(prior / (1 - prior)))
    stems = _stems(toxic, clean) if toxic and clean else []
    if not stems:
        return flat
    freq = Counter(w for words in clean for w in words)
    marked: dict[str, Counter] = defaultdict(Counter)
    for words in toxic:
        for w in words:
            for s in stems:
                if s in w:
                    marked[s][w] += 1
    # A sequence that only comes along with stronger ones (an ending they share) teaches nothing.
    for i, s in reversed(list(enumerate(stems))):
        uses = {w: n for w, n in marked[s].items() if freq[w] <= 0.1 * n}
        if sum(n for w, n in uses.items() if any(x in w for x in stems[:i])) >= 0.6 * sum(uses.values()):
            stems.remove(s)
    positive = Counter()
    for found in (marked[s] for s in stems):
        for w, n in found.items():
            if freq[w] <= 0.1 * n:
                positive[w] = max(positive[w], n)
    good = [w for w, _ in sorted(positive.items(), key=lambda x: (-x[1], x[0]))[:4000] if ORDER <= len(w) <= PIECE]
    # Disguises of the commonest words, with a letter put in, are positive examples too.
    for k, w in enumerate(good[:400]):
        cut = 2 + (7 * k + len(w)) % max(1, len(w) - 3)
        disguised = w[:cut] + "abcdefghijklmnopqrstuvwxyz"[(11 * k + 5) % 26] + w[cut:]
        if not freq[disguised] and disguised not in positive and len(disguised) <= PIECE:
            positive[disguised] = max(1, positive[w] // 2)
            good.append(disguised)
    thirds = {s[i : i + 3] for s in stems for i in range(len(s) - 2)}
    by_use = [w for w, _ in sorted(freq.items(), key=lambda x: (-x[1], x[0])) if ORDER <= len(w) <= PIECE]
    close = [w for w in by_use if w not in positive and any(w[i : i + 3] in thirds for i in range(len(w) - 2))]
    decoys = [w for w in close if any(s in w for s in stems)]
    bad = list(dict.fromkeys(decoys[:2000] + close[:6000] + by_use[:2000] + by_use[2000 :: max(1, len(by_use) // 4000)][:4000]))
    if not good or not bad:
        return flat
    marks = list(stems)
    for s in stems:
        marks += [w for w, _ in sorted(marked[s].items(), key=lambda x: (-x[1], x[0])) if w in positive and len(w) <= 13][:3]
    for s in stems:
        marks += [w for w in decoys if s in w and len(w) <= 13][:2]
    marks = list(dict.fromkeys(marks + [w for w in close if len(w) <= 12][:16]))[:MAX_LANDMARKS]
    held = Landmarks(marks)
    centre = held.similarity(marks)
    values, vectors = np.linalg.eigh(centre.astype(np.float64))
    keep = values > 1e-4
    root = vectors[:, keep] / np.sqrt(values[keep])
    chosen = set(bad)
    rest = [w for w in by_use if w not in positive and w not in chosen][:MINED_WORDS]
    hard = set(decoys)
    x_good, x_bad = _features(good, held, root), _features(bad, held, root)
    for turn in range(MINING_TURNS):
        groups = [[1 + math.log(positive[w]) for w in good], [(1 + math.log(freq[w])) * (w in hard) for w in bad], [(1 + math.log(freq[w])) * (w not in hard) for w in bad]]
        cost = np.concatenate([1_000 * np.array(groups[0]) / sum(groups[0]), sum(1_000 * np.array(g) / max(sum(g), 1e-9) for g in groups[1:])])
        w, bias = _svm(np.vstack([x_good, x_bad]), np.array([1.0] * len(good) + [-1.0] * len(bad)), cost)
        model = Model(marks, (root @ w).astype(np.float32), bias)
        if turn == 0:
            x_rest = _features(rest, held, root)
        value = x_rest @ w + bias
        worst = [i for i in np.argsort(-value, kind="stable")[:2000].tolist() if value[i] > -0.7 and rest[i] not in chosen]
        if not worst:
            break
        bad += [rest[i] for i in worst]
        chosen.update(rest[i] for i in worst)
        hard.update(rest[i] for i in worst)
        x_bad = np.vstack([x_bad, x_rest[worst]])
    half = CURVE_TEXTS // 3
    texts = [Counter(w for s in text for w in s.split(" ")) for text in toxic_texts[:half] + clean_texts[-(CURVE_TEXTS - half) :]]
    label = np.array([1.0] * len(toxic_texts[:half]) + [0.0] * (len(texts) - len(toxic_texts[:half])))
    all_words = sorted(set().union(*texts))
    score = dict(zip(all_words, model.words(all_words).tolist()))
    worst = np.array([model.worst(words, score)[:2] for words in texts])
    weight = np.where(label > 0, prior / max(1, label.sum()), (1 - prior) / max(1, (1 - label).sum())) * len(label)
    model.slope, model.second = map(float, _logistic(worst, label, weight))
    # The curve crosses the threshold where the sample's F1 is best.
    model.offset = math.log(THRESHOLD / (1 - THRESHOLD)) - _best_cut(worst @ np.array([model.slope, model.second]), label, weight)
    return model


def _best_cut(z: np.ndarray, y: np.ndarray, cost: np.ndarray) -> float:
    """Cut of best weighted F1; in the middle between the two values it falls between."""
    order = np.argsort(-z, kind="stable")
    z, y, cost = z[order], y[order], cost[order]
    hit, said = np.cumsum(cost * y), np.cumsum(cost)
    f1 = 2 * hit / (said + (cost * y).sum())
    f1[:-1][z[:-1] == z[1:]] = -1
    at = int(np.argmax(f1))
    return float((z[at] + z[at + 1]) / 2) if at + 1 < len(z) else float(z[at])


def _features(words: list[str], held: Landmarks, root: np.ndarray) -> np.ndarray:
    """Nystroem features of words."""
    out = np.empty((len(words), root.shape[1]))
    for a in range(0, len(words), 5_000):
        out[a : a + 5_000] = held.similarity(words[a : a + 5_000]) @ root
    return out


def held_out(doc_id):
    """Rows that no fit may see."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Trains on at most ``MAX_TOXIC`` + ``MAX_CLEAN`` labelled texts that are not held out.

    A doc_id with several labels has the largest; null ids and labels are left out.
    """
    seen = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y is not null").where(~held_out(F.col("i"))).groupBy("i").agg(F.max("y").alias("y"))
    n = {r.y: r.n for r in seen.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("i")
    some = seen.where("y > 0").orderBy(order, "i").limit(MAX_TOXIC).unionAll(seen.where("y <= 0").orderBy(order, "i").limit(MAX_CLEAN))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = ["\n".join(sentences_of(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bags, pa.string()), batch.column(2)], names=["i", "bags", "y"])

    texts = arrow_ready(docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(some), "i").select("i", "t", "y")).mapInArrow(split, "i long, bags string, y int")
    rows = sorted(((zlib.crc32(str(r.i).encode()), r.i, r.bags, r.y) for r in texts.collect()), key=lambda r: r[:3])
    return train(*[[[s for s in bags.split("\n") if s] for _, _, bags, y in rows if (y > 0) == bad] for bad in (True, False)], n.get(1, 0) / max(1, sum(n.values())))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, score, worst)`` per input row, and the columns to ``keep``.

    ``worst`` is the word the score is due to.  A null or empty text has no word and
    scores as the most harmless one; repeated rows and null ids pass through; an empty
    table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        known: dict[str, float] = {}
        size = 0
        for batch in batches:
            texts = [words_of(t) for t in batch.column(1).to_pylist()]
            if size > _CACHE_LETTERS:
                known.clear()
                size = 0
            fresh = list(set().union(*texts) - known.keys())
            known.update(zip(fresh, held.words(fresh).tolist()))
            size += sum(map(len, fresh)) + _WORD_LETTERS * len(fresh)
            top = [held.worst(words, known) for words in texts]
            p = held.probability(np.array([t[:2] for t in top], dtype=np.float64).reshape(-1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array([t[2] for t in top], pa.string()), *batch.columns[2:]], names=names)

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)])
    names = ["doc_id", "score", "worst", *[f"keep_{i}" for i in range(len(keep))]]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("worst", T.StringType()), *[T.StructField(f"keep_{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]])
    out = arrow_ready(base).mapInArrow(rows, schema)
    return out.withColumnsRenamed({f"keep_{i}": c for i, c in enumerate(keep)}) if keep else out
