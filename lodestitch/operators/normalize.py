"""Entities in one comparable form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestitch.functions import text as T
from lodestitch.operators.numbering import number_rows


def with_ids(loaded: DataFrame, *order: str) -> DataFrame:
    """Consecutive ids from 1 in the given order."""
    return number_rows(loaded, list(order or ("source_order", "row")))


def normalize(entities: DataFrame, use_structured_fields: bool = False) -> DataFrame:
    """Normalized view of raw entities.

    City and postal code come from the free-text address unless ``use_structured_fields``
    is set and the source's own fields hold something.  A row without an id refers to raw
    entity -1.
    """
    e = entities.withColumn("_n", T.name_parts(F.col("raw_name")))
    city, postal = T.city_from_address(F.col("raw_address")), T.postal_from_address(F.col("raw_address"))
    if use_structured_fields:
        city, postal = T.first_filled(T.city_name(F.col("city")), city), T.first_filled(T.postal_code(F.col("postal_code")), postal)
    return e.select(
        F.col("id").cast("long").alias("id"),
        F.coalesce(F.col("id").cast("long"), F.lit(-1)).alias("raw_entity_id"),
        F.col("_n.normalized_name").alias("normalized_name"),
        T.address_text(F.col("raw_address")).alias("normalized_address"),
        city.alias("normalized_city"),
        postal.alias("normalized_postal_code"),
        F.col("_n.legal_suffix").alias("legal_suffix"),
        F.col("_n.name_core_tokens").alias("name_core_tokens"),
        "source",
    )


def attach_truth(raw: DataFrame, truth: DataFrame, strict: bool = True) -> DataFrame:
    """``(id, true_entity_id)``; with ``strict`` an entity without truth is an error, else it is left out."""
    joined = raw.select("id", "source", "external_id").join(truth.select("source", "external_id", "true_entity_id"), ["source", "external_id"], "left" if strict else "inner")
    true = F.col("true_entity_id")
    if strict:
        true = F.when(true.isNull(), F.raise_error(F.concat(F.lit("no ground truth for "), "source", F.lit("/"), "external_id"))).otherwise(true)
    return joined.select("id", true.cast("string").alias("true_entity_id"))
