import random
from collections import Counter

import corpus_pipeline as pipeline
from test_decontaminate import brute as leaks
from test_secrets import ASSIGN
from test_simhash import brute_fingerprint, components

from lodestitch.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ba", "ten", "or", "li", "qua", "ing", "mer", "of", "re", "du"]) for _ in range(rng.randrange(1, 4)))
    bench = [(i, " ".join(word() for _ in range(14))) for i in range(5)]
    docs, labels = [], []
    for d in range(n):
        words = [word() for _ in range(rng.randrange(30, 90))]
        toxic = int(d % 6 == 0)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["gruzwik", "floxnard"])
        if d % 17 == 1:
            words[5:5] = bench[d % 5][1].split()
        if d % 19 == 2:
            words[3:3] = ["password:", "hunter2hunter2"]
        text = " ".join(words)
        if d % 23 == 3 and docs:
            text = docs[-1][1]
        docs.append((d, text, "en", f"s{d % 3}", len(text)))
        labels.append((d, 1, toxic))
    return docs, labels, bench


def test_stages(spark, tmp_path):
    docs, labels, bench = make(900, 4)
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = pipeline.run(spark, str(tmp_path))
    got = {r.doc_id: r for r in out.collect()}
    insult = lambda t: "gruzwik" in t or "floxnard" in t
    clean = {d: t for d, t, *_ in docs if not insult(t)}
    prints = {d: brute_fingerprint(t) for d, t in clean.items()}
    groups = components(prints)
    first = {d: t for d, t in clean.items() if groups[d] == d}
    hits = leaks(list(first.items()), bench)
    want = {d: ASSIGN.sub("[secret]", t) for d, t in first.items() if not hits[d][1]}
    assert {d: r.text for d, r in got.items()} == want
    assert all(r.n_chars == len(r.text) and r["size"] == len(r.text.split()) and 0 <= r.taken <= 3 * r["size"] for r in got.values())


CLASH = "_score int, _turn int, __pair int, __spans int, size int, Target string, `a.b c` int, doc int, key int, row int, fp int, score int, cuts int"


def test_hostile_columns_and_nulls(spark, tmp_path):
    leak = " ".join(f"leak{i}" for i in range(12))
    docs = [(None, None, None, None, None), (1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "one text without an id", "en", None, 0), (None, "quite another one here", "en", None, 0), (None, leak, "en", "a", 0)]
    docs += [(7, "alpha beta gamma delta epsilon", "en", "a", 0), (7, "password: hunter2hunter2 is what they use", "en", "a", 0), (8, "alpha beta gamma delta epsilon", "en", "b", 0)]
    own = tuple(range(13))
    for name, rows, schema in (("documents", [(*r, *own[:5], "t", *own[6:]) for r in docs], f"{SCHEMA}, {CLASH}"), ("labels", [], "doc_id long, quality int, toxic int"), ("benchmark", [(1, leak)], "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = pipeline.run(spark, str(tmp_path))
    first = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert out.columns == [{"size": "size_input", "Target": "Target_input"}.get(c, c) for c in first.columns] + ["size", "source_size", "target", "taken"]
    got = out.collect()
    want = [(1, None), (None, "one text without an id"), (None, "quite another one here"), (7, "alpha beta gamma delta epsilon"), (7, "[secret] is what they use")]
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)
    assert all(tuple(r)[5:18] == (*own[:5], "t", *own[6:]) for r in got)
    assert all(r["size"] == len((r.text or "").split()) and r.taken is not None for r in got)
    first = first.limit(0)
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, first, str(tmp_path)).columns == first.columns
        first = stage(spark, first, str(tmp_path))
        assert first.count() == 0
    assert pipeline.mix_sources(spark, first, str(tmp_path)).count() == 0


def test_near_copies_are_decided_by_row(spark, tmp_path):
    text = "one two three four five six seven"
    docs = [(None, text, "en", "a", 0), (None, text, "en", "a", 0), (None, "no copy at all", "en", "a", 0), (5, text, "en", "b", 0), (5, text, "en", "b", 0), (9, text, "en", "c", 0), (5, "another text of its own", "en", "b", 0), (None, "no copy at all", "en", "z", 0)]
    got = pipeline.drop_near_copies(spark, spark.createDataFrame(docs, SCHEMA).repartition(3), str(tmp_path))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(5, text), (5, "another text of its own"), (None, "no copy at all")], key=str)


def test_contamination_is_decided_by_row(spark, tmp_path):
    leak = " ".join(f"leak{i}" for i in range(12))
    texts = {None: ["clean one", leak, "clean two", None], 7: ["clean three", leak + " and more"], 8: [leak]}
    docs = [(d, t, "en", "a", 0) for d, ts in texts.items() for t in ts]
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = pipeline.drop_contaminated(spark, spark.createDataFrame(docs, SCHEMA), str(tmp_path))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {(r.doc_id, r.text) for r in got.collect()} == {(d, t) for d, t, *_ in docs if not t or "leak" not in t}


def test_every_row_gets_its_own_share_of_the_mix(spark, tmp_path):
    rng = random.Random(3)
    docs = [(rng.choice([None, 1, 2, d]), " ".join(["w"] * rng.randrange(60)), "en", rng.choice(["a", "b", None]), 0) for d in range(300)]
    df = spark.createDataFrame(docs, SCHEMA)
    out = pipeline.mix_sources(spark, df, str(tmp_path))
    assert out.columns == [*df.columns, "size", "source_size", "target", "taken"]
    got = out.collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(docs)
    assert all(r["size"] == len(r.text.split()) for r in got)
    key = lambda r: (r.doc_id, r.source, r["size"], r.source_size, r.target, r.taken)
    assert Counter(map(key, got)) == Counter(map(key, mixing.mix(df).collect()))


def test_the_mix_leaves_texts_where_they_are(spark, tmp_path):
    df = spark.createDataFrame([(d, f"text {d}", "en", "ab"[d % 2], 0) for d in range(50)], SCHEMA)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = pipeline.mix_sources(spark, df, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
