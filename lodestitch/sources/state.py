"""Durable state as Parquet tables: entities, pairs, and an append-only decision log.

Uniqueness comes from folding rows by their sequence number, so writers only append.
"""

from __future__ import annotations

import secrets
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestitch import schema


def first_write_wins(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(seq))
    return rows.withColumn("_t", turn).where("_t = 1").drop("_t")


def last_write_wins(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r")).select(*keys, "_r.*")


def canonical_pairs(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """Pairs with ordered ends; the first blocking key stays."""
    ends = rows.select(F.least("entity_a_id", "entity_b_id").alias("entity_a_id"), F.greatest("entity_a_id", "entity_b_id").alias("entity_b_id"), "blocking_key", seq)
    return ends.groupBy("entity_a_id", "entity_b_id").agg(F.min_by("blocking_key", F.col(seq)).alias("blocking_key"), F.min(seq).alias(seq))


def update_scores(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    new = scores.select("id", F.col("similarity_score").alias("_s"))
    return pairs.join(new, "id", "left").withColumn("similarity_score", F.coalesce("_s", "similarity_score")).select(*pairs.columns)


def fold_decisions(log: DataFrame, seq: str = "seq") -> DataFrame:
    """Latest decision of each pair; reviewer and label are the latest that were given."""
    latest = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c)
    return log.groupBy("pair_id").agg(F.max_by("decision", F.col(seq)).alias("decision"), latest("reviewer"), latest("hand_label"), F.min(seq).alias("id"))


def pack_tokens(tokens):
    return F.array_join(tokens, ",")


def unpack_tokens(text):
    return F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda t: t != "")


class Store:
    """Tables in one folder; usable as a context manager."""

    TABLES = {"raw_entities": schema.RAW, "normalized_entities": schema.NORMALIZED, "candidate_pairs": schema.PAIRS, "resolution_decisions": schema.DECISIONS + ", seq bigint"}

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, str(path).rstrip("/")

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Nothing is held open; every write is already durable."""

    def reset(self) -> None:
        for name, ddl in self.TABLES.items():
            self.spark.createDataFrame([], ddl).write.mode("overwrite").parquet(f"{self.path}/{name}")

    def read(self, name: str, ordered: bool = True) -> DataFrame:
        try:
            rows = self.spark.read.schema(self.TABLES[name]).parquet(f"{self.path}/{name}")
        except AnalysisException:
            rows = self.spark.createDataFrame([], self.TABLES[name])
        return rows.orderBy("id") if ordered else rows

    def write(self, name: str, rows: DataFrame, mode: str = "append") -> None:
        columns = [c.split()[0] for c in self.TABLES[name].split(", ")]
        rows.select(*columns).write.mode(mode).parquet(f"{self.path}/{name}")

    def save_run(self, raw: DataFrame, normalized: DataFrame, decided: DataFrame) -> None:
        """Replaces everything, earlier decisions included."""
        self.reset()
        self.write("raw_entities", raw, "overwrite")
        self.write("normalized_entities", normalized, "overwrite")
        self.write("candidate_pairs", decided, "overwrite")
        none = F.lit(None).cast("string")
        self.write("resolution_decisions", decided.select("id", F.col("id").alias("pair_id"), "decision", none.alias("reviewer"), none.alias("hand_label"), F.lit(0).cast("bigint").alias("seq")), "overwrite")

    def decide(self, pair_id: int, decision: str, reviewer: str | None = None, hand_label: str | None = None) -> None:
        """Appends to the log; the fold makes it an upsert."""
        if decision not in ("match", "no_match", "review"):
            raise ValueError(f"not a decision: {decision}")
        # Nanoseconds, so that writers need no common counter; the last three digits tell apart those of one moment.
        seq = time.time_ns() // 1000 * 1000 + secrets.randbelow(1000)
        row = self.spark.createDataFrame([(pair_id, pair_id, decision, reviewer, hand_label, seq)], self.TABLES["resolution_decisions"])
        self.write("resolution_decisions", row)

    def decisions(self) -> DataFrame:
        return fold_decisions(self.read("resolution_decisions", False)).orderBy("pair_id")

    def review_queue(self) -> DataFrame:
        """Pairs whose latest decision is to review them."""
        waiting = self.decisions().where("decision = 'review'").select(F.col("pair_id").alias("id"))
        return self.read("candidate_pairs", False).join(waiting, "id", "left_semi")
