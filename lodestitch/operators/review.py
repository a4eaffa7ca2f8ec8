"""Why a pair is in the review queue, for people."""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lodestitch.operators.scoring import add_features
from lodestitch.schema import FEATURES

# How features are called in explanations.
LABELS = {
    "name_token_sort": "name (word-order-independent)",
    "name_partial": "name (substring)",
    "name_jaro_winkler": "name (character-level)",
    "address_token_sort": "street address",
    "postal_match": "postal code",
    "city_similarity": "city",
}
COLUMNS = ("pair_id", "score", "source_a", "name_a", "address_a", "source_b", "name_b", "address_b", "agrees_on", "disagrees_on", "missing_data", "reviewer_decision")
_FIELD = {"address_token_sort": "normalized_address", "postal_match": "normalized_postal_code", "city_similarity": "normalized_city"}
AGREE, DISAGREE = 0.85, 0.5


def explain(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """Pairs with features and three lists of labels: ``agreements``, ``disagreements``, ``uncertain``.

    A field missing on either side is uncertain, whatever its feature; names never are.
    """
    marks = []
    for name in FEATURES:
        field = _FIELD.get(name)
        missing = (F.coalesce(f"{field}_a", F.lit("")) == "") | (F.coalesce(f"{field}_b", F.lit("")) == "") if field else F.lit(False)
        state = F.when(missing, "uncertain").when(F.col(name) >= AGREE, "agreements").when(F.col(name) <= DISAGREE, "disagreements")
        marks.append(F.struct(F.lit(LABELS[name]).alias("label"), state.alias("state")))
    pick = lambda s: F.transform(F.filter("_m", lambda m: m["state"] == s), lambda m: m["label"]).alias(s)
    full = add_features(pairs, entities)
    return full.withColumn("_m", F.array(*marks)).select(*full.columns, *[pick(s) for s in ("agreements", "disagreements", "uncertain")])


def format_explanation(row: Row) -> str:
    """Text of one explained pair."""
    side = lambda s: f"[{row[f'source_{s}']}]: {row[f'normalized_name_{s}']} | {row[f'normalized_address_{s}']} | {row[f'normalized_city_{s}']} {row[f'normalized_postal_code_{s}']}"
    lines = [f"--- pair_id={row.id}  score={row.similarity_score:.3f} (review band) ---", f"  A {side('a')}", f"  B {side('b')}"]
    for title, labels in (("agrees on:    ", row.agreements), ("disagrees on: ", row.disagreements), ("missing data: ", row.uncertain)):
        if labels:
            lines.append(f"  {title} {', '.join(labels)}")
    return "\n".join(lines)


def export_queue(explained: DataFrame, path: str | Path) -> Path:
    """One CSV file for reviewers, in pair order; rows stream through the driver."""
    path = Path(path)
    with path.open("w", newline="", encoding="utf-8") as file:
        out = csv.writer(file)
        out.writerow(COLUMNS)
        for r in explained.orderBy("id").toLocalIterator():
            place = lambda s: f"{r[f'normalized_address_{s}']}, {r[f'normalized_city_{s}']} {r[f'normalized_postal_code_{s}']}"
            lists = ["; ".join(x) for x in (r.agreements, r.disagreements, r.uncertain)]
            out.writerow([r.id, f"{r.similarity_score:.3f}", r.source_a, r.normalized_name_a, place("a"), r.source_b, r.normalized_name_b, place("b"), *lists, ""])
    return path
