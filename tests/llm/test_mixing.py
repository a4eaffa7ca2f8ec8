import random
from collections import Counter

from lodestitch.llm import mixing


def targets(sizes, weights=(5, 2, 1)):
    """Shares by weight, the excess over three times a source's size dealt out again until none is left."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed.update({s: 3.0 * sizes[s] for s in over})


def sainte_lague(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


def test_apportion(spark):
    rng = random.Random(4)
    for trial in range(6):
        rows = [(g, k, rng.choice([0.0, 1.0, 2.0, 3.5, 10.0, 1000.0]) * rng.randrange(1, 4), 3 + 7 * g * trial) for g in range(3) for k in range(rng.randrange(1, 9))]
        df = spark.createDataFrame(rows, "g long, k long, v double, s long")
        got = {(r.g, r.k): r.quota for r in mixing.apportion(df, ["g"], "k", "v", "s").collect()}
        for g in range(3):
            part = [r for r in rows if r[0] == g]
            want = sainte_lague([r[2] for r in part], part[0][3]) if sum(r[2] for r in part) else [0] * len(part)
            assert [got[g, r[1]] for r in part] == want


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_DOCS", 40)
    rng = random.Random(5)
    names = ["b", "a", "Z", "é", None, "tiny", "c"]
    rows = [(d, " ".join(["w"] * rng.randrange(0, 80)), names[min(6, int(rng.expovariate(0.7)))] if d % 90 else "tiny") for d in range(1500)]
    rows += [(5000, None, "a"), (5001, " \t", "empty"), (None, "x y", "b"), (3, "again", "b"), (3, "again", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], 64)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string, target string, rank int")
    assert mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None, "t", 1)], empty.schema)
    assert [(r.size, r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0, 0.0, 0)]


def test_whole_rows_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_DOCS", 40)
    rng = random.Random(6)
    rows = [(rng.choice([None, 1, 2, d, d]), " ".join(["w"] * rng.choice([0, 1, 7, rng.randrange(60)])), rng.choice(["a", "a", "a", "b", None]), "blank" if d % 50 else None) for d in range(1200)]
    rows += [(d, " ", "empty", None) for d in range(3)] + [(None, None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, rank string").repartition(5)
    plain = Counter(map(tuple, mixing.mix(df).collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = mixing.mix_whole(df, ("text", "rank"))
        assert Counter(tuple(r)[:6] for r in got.collect()) == plain
        assert Counter((r.doc_id, r.text, r.source, r.rank) for r in got.collect()) == Counter(rows)
        assert sorted(map(str, got.collect())) == sorted(map(str, got.repartition(3).collect()))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
        far = mixing.mix_whole(df, ("text", "rank")).collect()
        assert Counter(tuple(r)[:6] for r in far) == plain and Counter((r.doc_id, r.text, r.source, r.rank) for r in far) == Counter(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    empty = df.limit(0)
    assert mixing.mix_whole(empty, ("text",)).count() == 0
