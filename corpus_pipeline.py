"""Five stages that turn ``documents`` into a mixed, clean corpus.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept.
All but the last return the columns of ``documents``.  ``run`` writes the result of
every stage to the shared scratch folder and reads it back for the next.

A stage carries the whole row along in one struct, so whatever columns ``documents``
has besides its own, under whatever names, none is touched or mistaken for another.
Rows are told apart by what they hold, never by doc_id alone, which may be null or
shared; where a rule needs an order, rows without a doc_id come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestitch.llm import decontaminate, mixing, secrets, simhash, toxicity
from lodestitch.llm.base import table
from lodestitch.operators.scratch import Scratch


def _whole(docs: DataFrame) -> Column:
    """The row as one struct."""
    return F.struct(*["`" + c.replace("`", "``") + "`" for c in docs.columns])


def _columns(docs: DataFrame, doc: str = "doc") -> list[Column]:
    return [F.col(doc).getField(c).alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of the toxicity model."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select(_whole(docs).alias("doc")), model, "doc.doc_id", "doc.text", keep=("doc",))
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(*_columns(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every SimHash group: the one with the smallest id.

    Of rows with that id the one whose text has the smallest hash stays, and of rows that
    share id and text the one whose other columns do.  A group without any id keeps one too.
    """
    store = Scratch(spark, "copies")
    whole = docs.select(_whole(docs).alias("doc"))
    key = [F.xxhash64("doc.doc_id", "doc.text").alias("a"), F.xxhash64(F.lit(1), "doc.text", "doc.doc_id").alias("b")]
    prints = store.write(simhash.fingerprints(whole.select(F.struct(F.col("doc.doc_id").cast("long").alias("id"), *key).alias("key"), F.col("doc.text").alias("text"))).select("key.*", "fp"))
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "a", "b")).alias("first")
    kept = store.write(prints.join(simhash.groups(prints, store), "fp").groupBy("component").agg(first).select("first.a", "first.b"))
    plain = [F.col("doc").getField(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    rows = whole.select(*key, "doc").join(kept, ["a", "b"], "left_semi")
    once = rows.groupBy("a", "b").agg(F.min_by("doc", F.xxhash64(*plain)).alias("doc"))
    return once.select(*_columns(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    key = F.xxhash64("doc.text")  # a text decides for itself, whatever rows share its doc_id
    whole = docs.select(_whole(docs).alias("doc")).select(key.alias("key"), "doc")
    found = decontaminate.contamination(whole.select(F.col("key").alias("doc_id"), F.col("doc.text").alias("text")), table(spark, sf_dir, "benchmark"))
    hit = Scratch(spark, "hits").write(found.where("n_hit > 0").select(F.col("doc_id").alias("key")).distinct())
    return whole.join(hit, "key", "left_anti").select(*_columns(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars brought up to date."""
    clean = secrets.redact(docs)
    size = F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return clean.select(*[size if c == "n_chars" else F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with size, their source's size and target, and how many of their words the mix takes.

    An input column of one of these names, in any case of letters, comes out with ``_input`` added to its name.
    """
    new = ["size", "source_size", "target", "taken"]
    taken = {c.lower() for c in docs.columns} | set(new)
    names = []
    for c in docs.columns:
        name = c
        while c.lower() in new and name.lower() in taken:
            name += "_input"
        taken.add(name.lower())
        names.append(name)
    mixed = mixing.mix_whole(docs.select(_whole(docs).alias("doc")), ("doc",), "doc.doc_id", "doc.text", "doc.source")
    return mixed.select(*[F.col("doc").getField(c).alias(n) for c, n in zip(docs.columns, names)], *new)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("source mixing", mix_sources),
]

#: The model of the first stage is beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    store = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = store.write(stage(spark, docs, sf_dir))
    return docs
