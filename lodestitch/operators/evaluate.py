"""Measures against ground truth, and hand-label samples."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bands of the hand-label sample; they are apart from the decision thresholds.
HIGH, LOW = 0.83, 0.55


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def true_pairs(id_to_true: DataFrame) -> DataFrame:
    """All pairs ``(a, b)``, ``a < b``, of one true entity."""
    left = id_to_true.select("true_entity_id", F.col("id").alias("a"))
    right = id_to_true.select("true_entity_id", F.col("id").alias("b"))
    return left.join(right, "true_entity_id").where("a < b").select("a", "b")


def ordered(pairs: DataFrame, a: str = "entity_a_id", b: str = "entity_b_id") -> DataFrame:
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def blocking_recall(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """One row ``(recall, tp, fn)``."""
    hit = truth.join(ordered(candidates).withColumn("hit", F.lit(1)), ["a", "b"], "left")
    tp, fn = F.count("hit"), F.count_if(F.col("hit").isNull())
    return hit.agg(tp.alias("tp"), fn.alias("fn")).select(ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), "tp", "fn")


def pairwise_prf(predicted: DataFrame, truth: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """One row of precision, recall, F1 and counts; true negatives only within a universe."""
    sets = [predicted.select("a", "b", F.lit(1).alias("k")), truth.select("a", "b", F.lit(2).alias("k"))]
    if universe is not None:
        sets.append(universe.select("a", "b", F.lit(4).alias("k")))
    every = sets[0]
    for more in sets[1:]:
        every = every.unionAll(more)
    kinds = every.groupBy("a", "b").agg(F.bit_or("k").alias("k"))
    p, t, u = (F.col("k").bitwiseAND(x) > 0 for x in (1, 2, 4))
    return prf(kinds.agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t & u).alias("tn")))


def prf(counts: DataFrame) -> DataFrame:
    both = counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return both.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("precision", "recall", "f1", "tp", "fp", "fn", "tn")


def band(score: Column) -> Column:
    s = F.coalesce(score, F.lit(0.0))
    return F.when(s >= HIGH, "high").when(s <= LOW, "low").otherwise("mid")


def label_pairs(pairs: DataFrame, id_to_true: DataFrame) -> DataFrame:
    """Adds ``hand_label`` from the truth; a pair with an unknown end is no match."""
    side = lambda s: id_to_true.select(F.col("id").alias(f"entity_{s}_id"), F.col("true_entity_id").alias(f"true_{s}"))
    joined = pairs.join(side("a"), "entity_a_id", "left").join(side("b"), "entity_b_id", "left")
    return joined.withColumn("hand_label", F.when(F.col("true_a") == F.col("true_b"), "match").otherwise("no_match")).drop("true_a", "true_b")


def hand_label_sample(pairs: DataFrame, id_to_true: DataFrame, size: int = 300, seed: int = 99) -> DataFrame:
    """Stratified sample: up to a third from the middle band, the rest from the others.

    Distributed and repeatable: rows are drawn in the order of a seeded hash.
    """
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    mid = pairs.where(band(F.col("similarity_score")) == "mid").orderBy(draw, "id").limit(size // 3)
    some = mid.select("id").count()
    rest = pairs.where(band(F.col("similarity_score")) != "mid").orderBy(draw, "id").limit(size - some)
    return label_pairs(mid.unionAll(rest), id_to_true)


def hand_label_sample_exact(pairs: DataFrame, id_to_true: DataFrame, size: int = 300, seed: int = 99) -> DataFrame:
    """The sample that Python's own generator draws over pairs in id order.

    For parity with published numbers on small tables: ids and bands come to the driver.
    """
    rows = pairs.select("id", band(F.col("similarity_score")).alias("band")).orderBy("id").collect()
    strata = {b: [r.id for r in rows if r.band == b] for b in ("high", "mid", "low")}
    rng = random.Random(seed)
    chosen = rng.sample(strata["mid"], min(len(strata["mid"]), size // 3))
    others = strata["high"] + strata["low"]
    rng.shuffle(others)
    chosen += others[: size - len(chosen)]
    ids = pairs.sparkSession.createDataFrame([(i,) for i in chosen], "id long")
    return label_pairs(pairs.join(F.broadcast(ids), "id", "left_semi"), id_to_true)


def evaluate_sample(decided: DataFrame, sample: DataFrame) -> DataFrame:
    """Measures of match decisions within a labelled sample, by pair id."""
    joined = sample.select("id", "hand_label").join(decided.select("id", "decision"), "id", "left")
    p, t = F.coalesce(F.col("decision") == "match", F.lit(False)), F.col("hand_label") == "match"
    return prf(joined.agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn")))


def score_bands(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(band(F.col("similarity_score")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def per_stratum_sample(pairs: DataFrame, per_band: int, seed: int = 99) -> DataFrame:
    """At most ``per_band`` pairs of each band, in the order of a seeded hash."""
    turn = F.row_number().over(Window.partitionBy("band").orderBy(F.xxhash64(F.lit(seed), "id"), "id"))
    return pairs.withColumn("band", band(F.col("similarity_score"))).withColumn("turn", turn).where(F.col("turn") <= per_band).drop("turn")
