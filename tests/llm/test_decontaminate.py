import random
import re

from lodestitch.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, bench, window=10):
    wins = {}
    for i, t in bench:
        w = words(t)
        for a in range(max(1, len(w) - window + 1)) if w else ():
            wins.setdefault(tuple(w[a : a + window]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for g, names in wins.items():
            for a in range(len(w) - len(g) + 1):
                if tuple(w[a : a + len(g)]) == g:
                    hit |= set(range(a, a + len(g)))
                    items |= {str(n) for n in names if n is not None}
        out[d] = (len(w), len(hit), sorted(items))
    return out


def run(spark, docs, bench, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(bench, "item_id long, text string")
    return {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(d, b, **more).collect()}


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    bench = [(i, " ".join(rng.choice(["The", "of", "é", "b-c", "x1"]) + str(rng.randrange(6)) for _ in range(rng.randrange(0, 30)))) for i in range(30)] + [(None, "null item, with words"), (3, "again item three")]
    docs = []
    for d in range(80):
        w = [rng.choice(["the", "of", "É", "b c", "x1"]) + str(rng.randrange(6)) for _ in range(rng.randrange(0, 200))]
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w) + 1) :][:0] = [""]
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(bench)[1].upper().split(" ")[rng.randrange(6) :]
        docs.append((d, ", ".join(w)))
    docs += [(900, None), (901, ""), (902, "null\nITEM with. words")]
    assert run(spark, docs, bench) == brute(docs, bench)
    monkeypatch.setattr(decontaminate, "MAX_PHRASE_WORDS", 300)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2_000)
    assert run(spark, docs, bench) == brute(docs, bench)


def test_edges(spark):
    assert run(spark, [], [(1, "a b")]) == {}
    assert run(spark, [(1, "a b"), (None, "c")], []) == {1: (2, 0, []), None: (1, 0, [])}


def test_proximity(spark):
    docs = [(1, "red fox jumps over"), (2, "fox was quickly red jumps"), (3, "red " + "pad " * 9 + "fox jumps"), (4, "red"), (5, "fox jumps")]
    near = run(spark, docs, [(7, "red fox jumps")], slop=2)
    assert {d for d, r in near.items() if r[2]} == {1, 2}
