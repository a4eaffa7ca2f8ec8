"""From scores to decisions, clusters and a review queue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestitch.operators.components import connected_components
from lodestitch.operators.scratch import Scratch


@dataclass(frozen=True)
class Thresholds:
    match: float = 0.75
    no_match: float = 0.60


def classify(score: Column, t: Thresholds = Thresholds()) -> Column:
    """match, no_match or review; bounds belong to the outer bands, NaN is for review, null an error."""
    return (
        F.when(score.isNull(), F.raise_error(F.lit("a pair has no similarity_score; score pairs before resolving them")).cast("string"))
        .when(F.isnan(score), "review")
        .when(score >= t.match, "match")
        .when(score <= t.no_match, "no_match")
        .otherwise("review")
    )


@dataclass
class Resolution:
    """``pairs`` has every pair with ``decision``, ``first_decision`` and ``demoted``."""

    pairs: DataFrame
    members: DataFrame
    clusters: DataFrame

    def where(self, decision: str) -> DataFrame:
        return self.pairs.where(F.col("decision") == decision)


def resolve(scored: DataFrame, thresholds: Thresholds = Thresholds()) -> Resolution:
    """Decides pairs, clusters the matches and demotes what touches a contradicted cluster.

    A cluster is flagged when a no_match pair lies inside of it.  Every match or no_match
    pair with an end in a flagged cluster goes to review; clusters are not formed anew.
    """
    store = Scratch(scored.sparkSession, "resolve")
    banded = store.write(scored.withColumn("first_decision", classify(F.col("similarity_score"), thresholds)))
    matches = banded.where("first_decision = 'match'")
    members = store.write(connected_components(matches, "entity_a_id", "entity_b_id", store).select(F.col("component").alias("cluster_id"), F.col("node").alias("entity_id")))
    label = lambda s: members.select(F.col("entity_id").alias(f"entity_{s}_id"), F.col("cluster_id").alias(f"cluster_{s}"))
    against = banded.where("first_decision = 'no_match'").join(label("a"), "entity_a_id").join(label("b"), "entity_b_id")
    flagged = store.write(against.where("cluster_a = cluster_b").select(F.col("cluster_a").alias("cluster_id")).distinct(), 1)
    touched = members.join(flagged, "cluster_id", "left_semi").select("entity_id")
    mark = lambda s: touched.select(F.col("entity_id").alias(f"entity_{s}_id"), F.lit(True).alias(f"touch_{s}"))
    marked = banded.join(mark("a"), "entity_a_id", "left").join(mark("b"), "entity_b_id", "left")
    demoted = (F.col("touch_a").isNotNull() | F.col("touch_b").isNotNull()) & (F.col("first_decision") != "review")
    pairs = marked.select(*scored.columns, "first_decision", demoted.alias("demoted"), F.when(demoted, "review").otherwise(F.col("first_decision")).alias("decision"))
    status = members.join(flagged.withColumn("bad", F.lit(True)), "cluster_id", "left")
    clusters = status.groupBy("cluster_id").agg(F.array_sort(F.collect_list("entity_id")).alias("entity_ids"), F.when(F.max("bad"), "flagged_conflict").otherwise("resolved").alias("status"))
    return Resolution(pairs, members, clusters)
