import csv
import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestitch import cli, schema
from lodestitch.operators import blocking, evaluate, review, scoring
from lodestitch.operators import components
from lodestitch.operators.components import connected_components
from lodestitch.operators.normalize import normalize
from lodestitch.operators.resolve import Thresholds, resolve
from lodestitch.operators.scratch import Scratch
from lodestitch.plans.linkage import Linkage
from lodestitch.sources import datagen, files
from lodestitch.sources.state import Store, pack_tokens, unpack_tokens


def entity(i, name, address="123 main street", city="denver", postal="80202"):
    return (i, i, name, address, city, postal, "", sorted(set(name.split())), "s")


@pytest.fixture(scope="module")
def made(spark):
    out = datagen.generate(spark, 200, seed=33)
    out.loaded, out.truth, out.source_rows = out.loaded.cache(), out.truth.cache(), out.source_rows.cache()
    return out


@pytest.fixture(scope="module")
def result(made):
    return Linkage().run(made.loaded, made.truth)


def test_generator(spark, made):
    again = datagen.generate(spark, 200, seed=33).loaded
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, made.loaded.collect()))
    assert made.loaded.groupBy("source", "external_id").count().where("count > 1").isEmpty()
    assert made.truth.select("true_entity_id").distinct().count() == 200
    assert made.loaded.select("source").distinct().count() == 3


def test_quality(result):
    m = result.metrics
    assert m["blocking_recall"] >= 0.85 and m["full_dataset_precision"] >= 0.85 and m["full_dataset_recall"] >= 0.6
    assert m["n_matches"] + m["n_no_matches"] + m["n_review_queue"] == m["n_candidate_pairs"]
    assert 0 < m["hand_label_sample_size"] <= 300


def test_blocking_rules(spark):
    rows = [entity(i, "acme industrial") for i in range(1, 61)]
    df = lambda r: spark.createDataFrame(r, schema.NORMALIZED)
    one = {"np": blocking.name_prefix_postal}
    assert blocking.block(df(rows), 60, one).count() == 60 * 59 // 2
    assert blocking.block(df(rows + [entity(61, "acme industrial")]), 60, one).count() == 0
    assert blocking.skipped_blocks(df(rows), 59, one).count() == 1
    two = blocking.block(df([entity(1, "acme industrial"), entity(2, "zcme industrial", postal="90000", city="")]))
    assert two.count() == 0
    pairs = blocking.block(df(rows[:5])).collect()
    assert sorted(p.id for p in pairs) == list(range(1, 11)) and all(p.entity_a_id < p.entity_b_id and p.blocking_key.startswith("np:") for p in pairs)
    stats = blocking.blocking_stats(df(rows[:5])).first()
    assert (stats.n_entities, stats.full_pairwise_comparisons, stats.candidate_pairs, stats.reduction_ratio) == (5, 10, 10, 0.0)


def score(spark, a, b):
    e = spark.createDataFrame([a, b], schema.NORMALIZED)
    pairs = spark.createDataFrame([(1, a[0], b[0], "k", None)], schema.PAIRS)
    return scoring.score_pairs(pairs, e).first().similarity_score


def test_scores(spark):
    acme = entity(1, "acme industrial inc")
    assert score(spark, acme, entity(2, "acme industrial inc")) > 0.95
    assert score(spark, acme, entity(2, "zebra quartz llc", "9 far road", "boston", "02101")) < 0.45
    assert score(spark, acme, entity(2, "acme industral inc")) > 0.83
    assert score(spark, acme, entity(2, "acme industrial inc", "77 other avenue", "tulsa", "74103")) < 0.83
    assert score(spark, acme, entity(2, "acme industrial inc", "", "", "")) == pytest.approx(0.34 + 0.1 + 0.26 + 0.06 + 0.03)


def test_logistic(spark):
    e = spark.createDataFrame([entity(1, "acme industrial"), entity(2, "acme industrial"), entity(3, "zebra quartz", "9 far road", "boston", "02101")], schema.NORMALIZED)
    examples = spark.createDataFrame([(1, 2, 1.0), (1, 3, 0.0), (2, 3, 0.0)], "entity_a_id long, entity_b_id long, label double")
    pairs = spark.createDataFrame([(1, 1, 2, "k", None), (2, 1, 3, "k", None)], schema.PAIRS)
    with pytest.raises(RuntimeError):
        scoring.score_pairs(pairs, e, scoring.LogisticScorer())
    p = {r.id: r.similarity_score for r in scoring.score_pairs(pairs, e, scoring.LogisticScorer().fit(examples, e)).collect()}
    assert p[1] > p[2]


def decided(spark, rows, **t):
    df = spark.createDataFrame([(i + 1, a, b, "k", s) for i, (a, b, s) in enumerate(rows)], schema.PAIRS)
    out = resolve(df, Thresholds(**t) if t else Thresholds())
    return {r.id: r.decision for r in out.pairs.collect()}, sorted((tuple(r.entity_ids), r.status) for r in out.clusters.collect())


def test_resolution(spark):
    got, _ = decided(spark, [(1, 2, 0.95), (3, 4, 0.2), (5, 6, 0.65), (7, 8, 0.8), (9, 10, 0.5), (11, 12, float("nan"))], match=0.8, no_match=0.5)
    assert list(got[i] for i in range(1, 7)) == ["match", "no_match", "review", "match", "no_match", "review"]
    got, clusters = decided(spark, [(1, 2, 0.9), (2, 3, 0.9)])
    assert clusters == [((1, 2, 3), "resolved")]
    got, clusters = decided(spark, [(1, 2, 0.9), (2, 3, 0.9), (1, 3, 0.1), (3, 9, 0.1), (7, 8, 0.9)])
    assert clusters == [((1, 2, 3), "flagged_conflict"), ((7, 8), "resolved")]
    assert got == {1: "review", 2: "review", 3: "review", 4: "review", 5: "match"}
    with pytest.raises(Exception, match="similarity_score"):
        decided(spark, [(1, 2, None)])


@pytest.mark.parametrize("local", [0, components.LOCAL_EDGES])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(components, "LOCAL_EDGES", local)
    edges = [(i, i + 1) for i in range(1, 300)] + [(500, x) for x in range(501, 560)] + [(600, 601), (601, 602), (602, 600), (700, 700), (None, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b", Scratch(spark, "t")).collect()}
    assert {got[i] for i in range(1, 301)} == {1} and {got[i] for i in range(500, 560)} == {500} and {got[i] for i in (600, 601, 602)} == {600} and 700 not in got


def test_measures(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "a long, b long")
    ids = spark.createDataFrame([(1, "E1"), (2, "E1"), (3, "E1"), (4, "E2"), (5, "E3")], "id long, true_entity_id string")
    assert sorted(map(tuple, evaluate.true_pairs(ids).collect())) == [(1, 2), (1, 3), (2, 3)]
    r = evaluate.pairwise_prf(pairs([(1, 2), (5, 6)]), pairs([(1, 2)]), pairs([(1, 2), (5, 6), (8, 9)])).first()
    assert (r.precision, r.recall, r.tn) == (0.5, 1.0, 1)
    r = evaluate.pairwise_prf(pairs([]), pairs([(3, 4)])).first()
    assert (r.precision, r.recall, r.f1, r.fn) == (0.0, 0.0, 0.0, 1)
    rows = [(i, i, i + 1000, "k", s) for i, s in enumerate([0.95] * 50 + [0.65] * 20 + [0.1] * 50)]
    df = spark.createDataFrame(rows, schema.PAIRS)
    for draw in (evaluate.hand_label_sample, evaluate.hand_label_sample_exact):
        sample = draw(df, ids, 30).collect()
        assert len(sample) == 30 and sum(r.similarity_score == 0.65 for r in sample) == 10


def test_review(spark, tmp_path):
    e = spark.createDataFrame([entity(1, "acme"), entity(2, "acme", postal="90000"), entity(3, "acme", "", "", "")], schema.NORMALIZED)
    pairs = spark.createDataFrame([(1, 1, 2, "k", 0.7), (2, 1, 3, "k", 0.65)], schema.PAIRS)
    rows = {r.id: r for r in review.explain(pairs, e).collect()}
    assert "postal code" in rows[1].disagreements and "name (substring)" in rows[1].agreements and not rows[1].uncertain
    assert rows[2].uncertain == ["street address", "postal code", "city"]
    assert "score=0.700" in review.format_explanation(rows[1]) and "missing data" not in review.format_explanation(rows[1])
    with review.export_queue(review.explain(pairs, e), tmp_path / "q.csv").open() as f:
        out = list(csv.DictReader(f))
    assert [r["pair_id"] for r in out] == ["1", "2"] and out[0]["reviewer_decision"] == "" and tuple(out[0]) == review.COLUMNS


def test_store(spark, tmp_path):
    with Store(spark, str(tmp_path)) as store:
        assert store.read("raw_entities").count() == 0
        store.reset()
        store.decide(5, "review")
        store.decide(5, "match", reviewer="ann")
        store.decide(5, "match")
        for seq in ("match", "no_match", "match", "no_match"):
            store.decide(6, seq)
        assert [tuple(r)[:2] for r in store.decisions().where("pair_id = 6").collect()] == [(6, "no_match")]
        assert [tuple(r)[:3] for r in store.decisions().where("pair_id = 5").collect()] == [(5, "match", "ann")]
        with pytest.raises(ValueError):
            store.decide(5, "maybe")
    row = spark.createDataFrame([(["a", "b"],)], "t array<string>").select(unpack_tokens(pack_tokens(F.col("t")))).first()
    assert row[0] == ["a", "b"]


def test_sources_and_cli(spark, tmp_path, made, capsys):
    data, db = str(tmp_path / "data"), str(tmp_path / "db")
    assert cli.main(["run-all", "--data-dir", data], spark) == 1
    datagen.write_dataset(made, data)
    loaded = files.load_all_sources(spark, data)
    want = made.loaded.select("source", "external_id", "raw_name", "raw_address", "city", "postal_code")
    assert sorted(map(tuple, loaded.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    os.remove(f"{data}/source_crm.csv")
    assert files.load_all_sources(spark, data).where("source = 'crm'").count() == 0
    datagen.write_dataset(made, data)
    out = str(tmp_path / "report.json")
    assert cli.main(["run-all", "--data-dir", data, "--db", db, "--report-out", out], spark) == 0
    assert json.loads(open(out).read())["n_entities"] == made.loaded.count()
    store = Store(spark, db)
    waiting = [r.id for r in store.review_queue().select("id").orderBy("id").collect()]
    assert waiting
    assert cli.main(["review-queue", "--db", db, "--limit", "2"], spark) == 0
    assert f"pair_id={waiting[0]}" in capsys.readouterr().out
    assert cli.main(["submit-review", str(waiting[0]), "match", "--db", db, "--reviewer", "kim"], spark) == 0
    assert waiting[0] not in [r.id for r in store.review_queue().collect()]
    assert cli.main(["submit-review", "999999", "no_match", "--db", db], spark) == 0
    assert "does not wait" in capsys.readouterr().out
    assert cli.main(["export-review-queue", "--db", db, "--out", str(tmp_path / "q.csv")], spark) == 0
    assert len((tmp_path / "q.csv").read_text().splitlines()) == len(waiting)


def test_structured_fields(spark):
    raw = spark.createDataFrame([(1, "crm", "x", "Acme", "Kerkstraat 12", "Amsterdam", "1017 ab")], schema.LOADED)
    on = normalize(raw, use_structured_fields=True).first()
    assert (on.normalized_city, on.normalized_postal_code) == ("amsterdam", "1017AB")
    off = normalize(raw).first()
    assert (off.normalized_city, off.normalized_postal_code) == ("", "")


# What the published source files give.
PUBLISHED = {
    "n_entities": 971,
    "n_candidate_pairs": 1219,
    "n_true_match_pairs": 957,
    "blocking_recall": 0.877742946708464,
    "blocking_missed": 117,
    "full_dataset_precision": 0.9243792325056434,
    "full_dataset_recall": 0.8557993730407524,
    "full_dataset_f1": 0.8887683125339121,
    "n_matches": 886,
    "n_no_matches": 133,
    "n_review_queue": 200,
    "n_clusters": 300,
    "n_flagged_conflict_clusters": 0,
    "hand_label_sample_size": 300,
    "hand_label_precision": 0.9301310043668122,
    "hand_label_recall": 0.9726027397260274,
    "hand_label_f1": 0.9508928571428571,
    "hand_label_tp": 213,
    "hand_label_fp": 16,
    "hand_label_fn": 6,
    "hand_label_tn": 65,
}


def published_folder():
    """``LINKAGE_DATA``, or a ``data`` folder beside the repository that holds the published files."""
    near = sorted(p.parent for p in Path(__file__).resolve().parents[2].glob("*/data/ground_truth.csv"))
    return os.environ.get("LINKAGE_DATA") or (str(near[0]) if near else None)


@pytest.mark.skipif(published_folder() is None, reason="no folder of published source files")
def test_published_numbers(spark):
    folder = published_folder()
    m = Linkage(exact_sample=True).run(files.load_all_sources(spark, folder), files.load_ground_truth(spark, f"{folder}/ground_truth.csv")).metrics
    assert {k: m[k] for k in PUBLISHED} == pytest.approx(PUBLISHED, abs=1e-12) and len(m) == len(PUBLISHED)
