"""Pair features and scorers.

A scorer turns a table of pairs with feature columns into one with ``similarity_score``:
anything with a ``score(features) -> DataFrame`` will do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestitch.functions.similarity import string_features
from lodestitch.operators.scratch import Scratch
from lodestitch.schema import FEATURES

# Weights of the features.
WEIGHTS = {"name_token_sort": 0.34, "name_partial": 0.10, "name_jaro_winkler": 0.26, "address_token_sort": 0.12, "postal_match": 0.12, "city_similarity": 0.06}
_TEXT = ("normalized_name", "normalized_address", "normalized_city", "normalized_postal_code", "source")


def pair_texts(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """Pairs with the texts of both ends, as ``*_a`` and ``*_b``."""
    side = lambda s: entities.select(F.col("id").alias(f"entity_{s}_id"), *[F.col(c).alias(f"{c}_{s}") for c in _TEXT])
    return pairs.join(side("a"), "entity_a_id").join(side("b"), "entity_b_id")


def add_features(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds the six features; each string is compared once, in one Arrow exchange.

    A missing address counts 0, a missing postal code or city is neutral at 0.5.
    """
    both = pair_texts(pairs, entities)
    col = lambda c: (F.coalesce(F.col(f"{c}_a"), F.lit("")), F.coalesce(F.col(f"{c}_b"), F.lit("")))
    filled = lambda c: (col(c)[0] != "") & (col(c)[1] != "")
    raw = both.withColumn("_f", string_features(*col("normalized_name"), *col("normalized_address"), *col("normalized_city")))
    return raw.select(
        *both.columns,
        "_f.name_token_sort",
        "_f.name_partial",
        "_f.name_jaro_winkler",
        F.when(filled("normalized_address"), F.col("_f.address_token_sort")).otherwise(F.lit(0.0)).alias("address_token_sort"),
        F.when(filled("normalized_postal_code"), (col("normalized_postal_code")[0] == col("normalized_postal_code")[1]).cast("double")).otherwise(F.lit(0.5)).alias("postal_match"),
        F.when(filled("normalized_city"), F.col("_f.city_ratio")).otherwise(F.lit(0.5)).alias("city_similarity"),
    )


def weighted_score() -> Column:
    total = F.lit(0.0)
    for name in FEATURES:
        total = total + F.col(name) * F.lit(WEIGHTS[name])
    return total


class HeuristicScorer:
    """Weighted sum of the features."""

    name = "heuristic"

    def score(self, features: DataFrame) -> DataFrame:
        return features.withColumn("similarity_score", weighted_score())


@dataclass
class LogisticScorer:
    """Logistic regression on the features, with unit L2 cost as is common elsewhere."""

    name: str = "logistic"
    model: object = None

    def fit(self, examples: DataFrame, entities: DataFrame) -> LogisticScorer:
        """``examples``: ``(entity_a_id, entity_b_id, label)``."""
        rows = self._vector(add_features(examples, entities).select(*FEATURES, F.col("label").cast("double").alias("label")))
        rows = Scratch(examples.sparkSession, "logistic").write(rows.select(*FEATURES, "label"))
        n = rows.count()
        self.model = LogisticRegression(regParam=1.0 / max(1, n), elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-8).fit(self._vector(rows))
        return self

    @staticmethod
    def _vector(rows: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)

    def score(self, features: DataFrame) -> DataFrame:
        if self.model is None:
            raise RuntimeError("fit the scorer before scoring with it")
        out = self.model.transform(self._vector(features))
        return out.withColumn("similarity_score", vector_to_array("probability").getItem(1)).drop("features", "probability", "rawPrediction", "prediction")


def score_pairs(pairs: DataFrame, entities: DataFrame, scorer=None) -> DataFrame:
    """Pairs with their score filled in."""
    return (scorer or HeuristicScorer()).score(add_features(pairs.drop("similarity_score"), entities)).select("id", "entity_a_id", "entity_b_id", "blocking_key", "similarity_score")
