"""The whole run: normalize, block, score, resolve, evaluate."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestitch.operators import evaluate
from lodestitch.operators.blocking import block
from lodestitch.operators.normalize import attach_truth, normalize, with_ids
from lodestitch.operators.resolve import Resolution, Thresholds, resolve
from lodestitch.operators.scoring import score_pairs
from lodestitch.operators.scratch import Scratch


@dataclass
class Result:
    raw: DataFrame
    entities: DataFrame
    pairs: DataFrame
    resolution: Resolution
    id_to_true: DataFrame | None = None
    metrics: dict = field(default_factory=dict)
    sample: DataFrame | None = None


@dataclass
class Linkage:
    thresholds: Thresholds = Thresholds()
    scorer: object = None
    max_block_size: int = 60
    use_structured_fields: bool = False
    sample_size: int = 300
    #: Draw the hand-label sample with Python's generator, on the driver.
    exact_sample: bool = False

    def run(self, loaded: DataFrame, truth: DataFrame | None = None) -> Result:
        """``loaded`` has the columns of raw entities, and ``source_order`` and ``row`` for their order."""
        store = Scratch(loaded.sparkSession, "linkage")
        raw = store.write(with_ids(loaded).select("id", "source", "external_id", "raw_name", "raw_address", "city", "postal_code"))
        entities = store.write(normalize(raw, self.use_structured_fields))
        pairs = store.write(score_pairs(block(entities, self.max_block_size), entities, self.scorer))
        found = resolve(pairs, self.thresholds)
        found = Resolution(store.write(found.pairs), found.members, found.clusters)
        result = Result(raw, entities, pairs, found)
        if truth is not None:
            result.id_to_true = store.write(attach_truth(raw, truth))
            self._measure(result)
        return result

    def _measure(self, r: Result) -> None:
        true = evaluate.true_pairs(r.id_to_true)
        recall = evaluate.blocking_recall(r.pairs, true).first()
        full = evaluate.pairwise_prf(evaluate.ordered(r.resolution.where("match")), true).first()
        counts = {row.decision: row.n for row in r.resolution.pairs.groupBy("decision").agg(F.count(F.lit(1)).alias("n")).collect()}
        clusters = {row.status: row.n for row in r.resolution.clusters.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        r.metrics = {
            "n_entities": r.entities.count(),
            "n_candidate_pairs": r.pairs.count(),
            "n_true_match_pairs": recall.tp + recall.fn,
            "blocking_recall": recall.recall,
            "blocking_missed": recall.fn,
            "full_dataset_precision": full.precision,
            "full_dataset_recall": full.recall,
            "full_dataset_f1": full.f1,
            "n_matches": counts.get("match", 0),
            "n_no_matches": counts.get("no_match", 0),
            "n_review_queue": counts.get("review", 0),
            "n_clusters": sum(clusters.values()),
            "n_flagged_conflict_clusters": clusters.get("flagged_conflict", 0),
        }
        if self.sample_size:
            draw = evaluate.hand_label_sample_exact if self.exact_sample else evaluate.hand_label_sample
            r.sample = Scratch(r.pairs.sparkSession, "sample").write(draw(r.pairs, r.id_to_true, self.sample_size))
            part = evaluate.evaluate_sample(r.resolution.pairs, r.sample).first()
            r.metrics |= {"hand_label_sample_size": r.sample.count()} | {f"hand_label_{k}": part[k] for k in ("precision", "recall", "f1", "tp", "fp", "fn", "tn")}
