"""Candidate pairs from several blocking keys.

A strategy is a Column builder.  Keys are exploded once, blocks outside the size limits
are dropped before the self-join, and a pair keeps the key of the first strategy that
proposed it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestitch.functions import text as T
from lodestitch.operators.numbering import number_rows


def _tokens() -> Column:
    own = F.col("name_core_tokens")
    return F.when(F.size(own) > 0, own).otherwise(T.words(F.col("normalized_name")))


def _key(prefix: str, left: Column, right: Column) -> Column:
    return F.when((left != "") & (right != ""), F.concat(F.lit(prefix), left, F.lit("|"), right)).otherwise(F.lit(""))


def name_prefix_postal() -> Column:
    place = T.first_filled(F.left("normalized_postal_code", F.lit(3)), F.left("normalized_city", F.lit(3)))
    return _key("np:", F.left(F.array_join(_tokens(), ""), F.lit(3)), place)


def sorted_initials_city() -> Column:
    return _key("si:", F.array_join(F.array_sort(F.transform(_tokens(), lambda t: F.left(t, F.lit(1)))), ""), F.col("normalized_city"))


def phonetic_city() -> Column:
    return _key("ph:", F.array_join(F.array_sort(F.transform(_tokens(), T.soundex)), ""), F.col("normalized_city"))


STRATEGIES: dict[str, Callable[[], Column]] = {"name_prefix_postal": name_prefix_postal, "sorted_initials_city": sorted_initials_city, "phonetic_city": phonetic_city}


def keys(entities: DataFrame, strategies: dict[str, Callable[[], Column]] | None = None) -> DataFrame:
    """``(id, strategy, key)`` of all filled keys; strategy is its place in the dict."""
    made = [F.struct(F.lit(i).alias("strategy"), f().alias("key")) for i, f in enumerate((strategies or STRATEGIES).values())]
    return entities.select("id", F.explode(F.array(*made)).alias("k")).select("id", "k.strategy", "k.key").where("key <> ''")


def blocks(entities: DataFrame, strategies=None) -> DataFrame:
    """``(strategy, key, members, first)``: size and smallest id of each block."""
    return keys(entities, strategies).groupBy("strategy", "key").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("first"))


def block(entities: DataFrame, max_block_size: int = 60, strategies=None) -> DataFrame:
    """Candidate pairs ``(id, entity_a_id, entity_b_id, blocking_key, similarity_score)``.

    The quadratic step is bounded by ``max_block_size``; larger blocks propose nothing,
    and ``skipped_blocks`` reports them.  Pair ids follow strategy, block and members.
    """
    kept = blocks(entities, strategies).where(F.col("members").between(2, max_block_size)).select("strategy", "key", "first")
    member = keys(entities, strategies).join(kept, ["strategy", "key"])
    left, right = member.withColumnRenamed("id", "a"), member.select("strategy", "key", F.col("id").alias("b"))
    pairs = left.join(right, ["strategy", "key"]).where("a < b")
    best = pairs.groupBy("a", "b").agg(F.min(F.struct("strategy", "first", "key")).alias("k"))
    return number_pairs(best.select("k.*", "a", "b"))


def number_pairs(pairs: DataFrame) -> DataFrame:
    """Consecutive ids by strategy, first member of the block and ends."""
    numbered = number_rows(pairs, ["strategy", "first", "a", "b"])
    return numbered.select("id", F.col("a").alias("entity_a_id"), F.col("b").alias("entity_b_id"), F.col("key").alias("blocking_key"), F.lit(None).cast("double").alias("similarity_score"))


def skipped_blocks(entities: DataFrame, max_block_size: int = 60, strategies=None) -> DataFrame:
    return blocks(entities, strategies).where(F.col("members") > max_block_size).drop("first")


def blocking_stats(entities: DataFrame, max_block_size: int = 60) -> DataFrame:
    """One row: entities, all pairs, candidates, and the share of pairs saved."""
    n = entities.agg(F.count(F.lit(1)).alias("n_entities"))
    c = block(entities, max_block_size).agg(F.count(F.lit(1)).alias("candidate_pairs"))
    full = (F.col("n_entities") * (F.col("n_entities") - 1) / 2).cast("long")
    both = n.withColumn("one", F.lit(1)).join(c.withColumn("one", F.lit(1)), "one").withColumn("full_pairwise_comparisons", full)
    ratio = F.when(F.col("full_pairwise_comparisons") > 0, 1 - F.col("candidate_pairs") / F.col("full_pairwise_comparisons")).otherwise(F.lit(0.0))
    return both.select("n_entities", "full_pairwise_comparisons", "candidate_pairs", ratio.alias("reduction_ratio"))
