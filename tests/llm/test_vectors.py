import random
from pathlib import Path

import numpy as np

from lodestitch.llm import vectors
from lodestitch.operators import scratch


def brute(rows, least=0.9):
    good = {}
    for i, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i in good:
        for j in good:
            if i < j and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.sqrt((good[i] @ good[i]) * (good[j] @ good[j])) >= least:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    names = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[root(i)] = min(d, names.get(root(i), d))
    return sorted(((d, links[i], names.get(root(i)), d is not None and d == names.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    return sorted((tuple(r) for r in vectors.link(df, **more).collect()), key=str)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_LIMIT", 128)
    monkeypatch.setattr(vectors, "CELL_TARGET", 30)
    rng = np.random.default_rng(8)
    rows = []
    for d in range(500):
        if d % 3 and rows:
            base = np.array(rows[rng.integers(len(rows))][1]) + rng.normal(0, rng.choice([0.0, 0.02, 0.06]), 32)
        else:
            base = rng.normal(0, 1 / np.sqrt(32), 32)
        rows.append((d, (base * rng.choice([1.0, 0.3, 20.0])).tolist()))
    want = brute(rows)
    assert sum(r[1] for r in want) > 300
    assert run(spark, rows) == want
    for blocks in (1, 8):
        assert run(spark, rows, blocks=blocks) == want


def test_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [0.0, 1.0]), (10, [1e-200, 0.0]), (11, [-1.0, -0.0])]
    want = brute([(d, [x * 1e200 for x in v] if d == 10 else v) for d, v in rows])
    assert run(spark, rows) == want
    assert run(spark, []) == []


def test_threshold_and_extra_columns(spark):
    # cosines of exactly 0.9 in double precision, and next to it
    rows = [(1, [1.0, 0.0]), (2, [0.9, float(np.sqrt(1 - 0.81))]), (3, [0.8, -0.6]), (4, [4.0, 0.0])]
    assert run(spark, rows) == brute(rows)
    cosine = brute(rows, 0.8)
    assert run(spark, rows, least=0.8) == cosine and cosine != brute(rows)
    names = "vec_id long, embedding array<float>, rep long, k string, v int, size int, q int, meets int"
    got = vectors.link(spark.createDataFrame([(i, v, 1, "x", 2, 3, 4, 5) for i, v in rows], names))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((r.vec_id, r.n_links) for r in got.collect()) == [(1, 1), (2, 0), (3, 0), (4, 1)]  # 0.9 is less in single precision


def test_dense_group_counts_every_link_once(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_LIMIT", 64)
    rng = np.random.default_rng(2)
    centre = rng.normal(0, 1, 24)
    rows = [(d, (centre + rng.normal(0, 0.2, 24)).tolist()) for d in range(400)]
    want = brute(rows)
    assert sum(r[1] for r in want) > 50_000
    assert run(spark, rows) == want


def written(spark):
    """Bytes that Spark has shuffled, and bytes of all scratch tables."""
    no_quantiles = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, no_quantiles, None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size())) + sum(f.stat().st_size for f in Path(scratch.scratch_root(spark)).rglob("*.parquet"))


def test_disk_stays_in_proportion_to_the_rows(spark, monkeypatch):
    # many cells or chunks, as on a large table, of vectors without structure: nothing is copied to all that it meets
    monkeypatch.setattr(vectors, "CELL_LIMIT", 200)
    monkeypatch.setattr(vectors, "CELL_TARGET", 100)
    x = np.random.default_rng(5).standard_normal((4_000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    before = written(spark)
    assert all(r.kept for r in vectors.link(df).collect())
    assert written(spark) - before < 6 * x.nbytes  # four times the table, files of a hundred rows included


def test_chunks_of_many_tiles(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((900, 40))
    x = np.vstack([x, x[rng.integers(900, size=1_500)] + rng.normal(0, 0.35, (1_500, 40)), x[0] + rng.normal(0, 0.2, (600, 40))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    assert near.sum() > 300_000
    names = np.arange(len(x))
    while not np.array_equal(less := np.minimum(names, np.where(near, names, len(x)).min(axis=1)), names):
        names = less
    want = sorted(zip(names.tolist(), near.sum(axis=1).tolist()))
    got = run(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    assert sorted((r[2], r[1]) for r in got) == want
    monkeypatch.setattr(vectors, "_HELD", 50)
    halves = [vectors.Points(h, 4) for h in np.array_split(x, 2)]
    ones = [np.ones(len(h)) for h in halves]
    degree, label = vectors.meet(*halves, ones, 0.9)
    cross = near[: len(halves[0]), len(halves[0]) :]
    assert degree.tolist() == [*cross.sum(axis=1), *cross.sum(axis=0)]
    assert all(label[i] == label[len(halves[0]) + j] for i, j in np.argwhere(cross))
