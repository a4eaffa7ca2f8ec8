import itertools
import random

import numpy as np

from lodestitch.llm import toxicity


def brute_kernel(s, t):
    total = 0.0
    subs = lambda w: list(itertools.combinations(range(len(w)), toxicity.ORDER))
    for a in subs(s):
        for b in subs(t):
            if all(s[i] == t[j] for i, j in zip(a, b)):
                total += toxicity.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def test_kernel_against_definition():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(3, 8))) for _ in range(12)]
    got = toxicity.kernel(words, words[:7])
    want = np.array([[brute_kernel(s, t) for t in words[:7]] for s in words])
    assert np.allclose(got, want, rtol=1e-4)
    assert np.allclose(toxicity.self_kernel(words), [brute_kernel(s, s) for s in words], rtol=1e-4)


def test_words():
    assert toxicity.words_of("Mo-Ron, m o r o n 12 Ünd") == {"^moron$": 2, "^ünd$": 1, "^m$": 1, "^o$": 2, "^r$": 1, "^n$": 1}
    assert not toxicity.words_of(None) and toxicity.sentences_of(None) == []
    assert toxicity.sentences_of("By a, by. C? ...\nD.e") == ["^a$ ^by$ ^by$", "^c$", "^de$"]


def test_copies_teach_nothing_twice():
    one, two = toxicity._by_label([["^x$ ^y$", "^z$"], ["^x$ ^y$"], ["^z$", "^q$ ^q$"]], [["^z$"], [], ["^z$", "^k$"]])
    assert (one, two) == ([{"^x$", "^y$"}, set(), {"^q$"}], [{"^z$"}, set(), {"^k$"}])


def test_two_worst_words():
    model = toxicity.Model(bias=-2.0)
    known = {"a": 1.0, "b": 3.0, "c": -2.0}
    got = [model.worst(toxicity.Counter(words), known) for words in ("", "c", "bac", "cabb", "ccc")]
    assert got == [(-1.0, -1.0, None), (-1.0, -1.0, "c"), (3.0, 1.0, "b"), (3.0, 3.0, "b"), (-1.0, -1.0, "c")]


def corpus(n, seed):
    rng = random.Random(seed)
    syllables = ["ba", "ten", "or", "li", "qua", "st", "ing", "mer", "of", "re", "du", "ka"]
    rows = []
    for d in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 60))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["gruzwik", "floxnard" + rng.choice(syllables)]))
        rows.append((d, " ".join(words), toxic))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(1500, 1)
    docs = spark.createDataFrame([(d, t, "x") for d, t, _ in rows], "doc_id long, text string, score string").repartition(4)
    labels = spark.createDataFrame([(d, y, 1) for d, _, y in rows] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model).withColumn("held", toxicity.held_out(toxicity.F.col("doc_id"))).where("held").collect()
    label = {d: y for d, _, y in rows}
    assert len(out) > 300
    wrong = sum((r.score >= toxicity.THRESHOLD) != bool(label[r.doc_id]) for r in out)
    assert wrong <= 0.03 * len(out)
    tricky = spark.createDataFrame([(1, "ba gru-zwik of"), (2, "ba g r u z w i k of"), (3, "ba gruzxwik of"), (4, None), (5, ""), (None, "of"), (6, "ba" * 50_000), (6, "ba" * 50_000)], "doc_id long, text string")
    score = {str(r.doc_id): r.score for r in toxicity.score(tricky, model).collect()}
    assert min(score["1"], score["2"]) >= 0.3 and score["3"] > 10 * score["5"] and max(score[k] for k in ("4", "5", "None")) < 0.3
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, none)).first().score < 0.3
