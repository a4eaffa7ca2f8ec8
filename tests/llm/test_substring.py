import hashlib
import random

from lodestitch.llm import substring


def brute(rows, window):
    first = {}
    words = {}
    for doc, text in rows:
        words.setdefault((doc is None, doc or 0), []).append((text or "").split(" ") if text else [])
    for key in sorted(words):
        for w in words[key]:
            for i in range(len(w) - window + 1):
                g = tuple(w[i : i + window])
                first[g] = min(first.get(g, (key, i)), (key, i))
    out = {}
    for key, texts in words.items():
        for w in texts:
            gone = [False] * len(w)
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < (key, i):
                    gone[i : i + window] = [True] * window
            kept = " ".join(x for x, g in zip(w, gone) if not g)
            out[None if key[0] else key[1]] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def run(spark, rows, window=20):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(df.repartition(3), window=window).collect()}


def test_against_brute_force(spark):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for d in range(120):
        words = [rng.choice("abcdefghijklmnop") + str(rng.randrange(40)) for _ in range(rng.randrange(0, 120))]
        if d % 3 == 0:
            a = rng.randrange(0, 30)
            at = rng.randrange(0, len(words) + 1)
            words[at:at] = passage[a : a + rng.randrange(15, 31)]
        if d % 7 == 0:
            words += ["la"] * rng.randrange(15, 50)
        if d % 11 == 0:
            words += ["x", "y", "z"] * rng.randrange(5, 20)
        if d % 13 == 0 and rows:
            words = rows[rng.randrange(len(rows))][1].split()
        rows.append((d, " ".join(words)))
    for window in (20, 7):
        assert run(spark, rows, window) == brute(rows, window)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(25))
    rows = [(1, None), (2, ""), (3, long), (4, long), (None, long), (5, "short one")]
    got = run(spark, rows)
    assert got[1][:2] == got[2][:2] == (0, 0)
    assert got[3][1] == 0 and got[4][1] == 25 and got[None][1] == 25 and got[5][1] == 0


def test_repeated_rows_are_one_document(spark):
    long = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(3, long), (3, long), (9, long)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substring.remove_repeats(df).collect()) == [(3, 0), (3, 0), (9, 25)]


def test_texts_that_share_an_id_keep_what_is_theirs(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(25)) for x in "abc")
    for shared in (None, 7):
        rows = [(1, a), (shared, a), (shared, b), (shared, c + " " + a), (shared, ""), (shared, None), (2, "x")]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.text) for r in substring.remove_repeats(df).collect())
        want = [(1, 25, 0, a), (shared or 0, 25, 25, ""), (shared or 0, 25, 0, b), (shared or 0, 50, 25, c), (shared or 0, 0, 0, ""), (shared or 0, 0, 0, ""), (2, 1, 0, "x")]
        assert got == sorted(want)
    df = spark.createDataFrame([(None, a), (5, b + " " + b), (None, b + " y"), (5, a), (None, a)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring.remove_repeats(df).collect())
    assert got == [(0, 25, 25), (0, 25, 25), (0, 26, 25), (5, 25, 0), (5, 50, 25)]
    # the largest id is not mixed up with a missing one
    top = (1 << 63) - 1
    df = spark.createDataFrame([(top, a), (None, b)], "doc_id long, text string")
    assert {(r.doc_id, r.n_removed, r.text) for r in substring.remove_repeats(df).collect()} == {(top, 0, a), (None, 0, b)}


def test_word_cache_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(substring, "CACHE_BYTES", 1000)
    cache = substring._WordHashes()
    cache.room = 1000
    for word in [b"a" * 5000, b"b", b"c" * 300, b"d" * 400, b"b"] * 3:
        assert cache[word] == substring.xxhash.xxh64_intdigest(word)
        assert sum(map(len, cache)) <= 1000


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, d string, spans string, k long, h int, several int")
    assert substring.remove_repeats(df).count() == 0
    df = spark.createDataFrame([(1, "a b", "x", "y", 3, 4, 5)], "doc_id long, text string, d string, spans string, k long, h int, several int")
    assert substring.remove_repeats(df).collect()[0].text == "a b"
