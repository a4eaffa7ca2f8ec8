"""Adapters from three source schemas to raw entities, and ground truth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the source files.
REGISTRY = ("reg_id", "legal_name", "street_address", "city", "postal_code", "country", "incorporation_year")
DIRECTORY = ("dir_id", "company_name", "full_address", "phone", "category")
CRM = ("crm_id", "account_name", "billing_street", "billing_city", "billing_zip", "industry")
TRUTH = ("source", "external_id", "true_entity_id", "is_confusable_distinct")


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """All columns as text, empty where missing; ``row`` keeps the order of the file."""
    schema = ", ".join(f"{c} string" for c in columns)
    raw = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(str(path))
    return raw.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns]).withColumn("row", F.monotonically_increasing_id())


def joined(*parts: str) -> Column:
    return F.array_join(F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda p: p != ""), ", ")


def adapt(rows: DataFrame, source: str, key: str, name: str, address: Column, city: str | None, postal: str | None) -> DataFrame:
    field = lambda c: F.col(c) if c else F.lit("")
    return rows.select(F.lit(source).alias("source"), F.col(key).alias("external_id"), F.col(name).alias("raw_name"), address.alias("raw_address"), field(city).alias("city"), field(postal).alias("postal_code"), "row")


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    return adapt(read_csv(spark, path, REGISTRY), "registry", "reg_id", "legal_name", joined("street_address", "city", "postal_code"), "city", "postal_code")


def load_directory(spark: SparkSession, path: str) -> DataFrame:
    return adapt(read_csv(spark, path, DIRECTORY), "directory", "dir_id", "company_name", F.col("full_address"), None, None)


def load_crm(spark: SparkSession, path: str) -> DataFrame:
    """The address has no postal code, as the source keeps that apart."""
    return adapt(read_csv(spark, path, CRM), "crm", "crm_id", "account_name", joined("billing_street", "billing_city"), "billing_city", "billing_zip")


LOADERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"registry": load_registry, "directory": load_directory, "crm": load_crm}


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(str(path)).schema
    except AnalysisException:
        return False
    return True


def load_all_sources(spark: SparkSession, folder: str) -> DataFrame:
    """All sources that are there, with ``source_order`` and ``row`` for ids."""
    found = [load(spark, f"{folder}/source_{name}.csv").withColumn("source_order", F.lit(i)) for i, (name, load) in enumerate(LOADERS.items()) if exists(spark, f"{folder}/source_{name}.csv")]
    if not found:
        raise FileNotFoundError(f"no source file in {folder}")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def load_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    rows = read_csv(spark, path, TRUTH)
    return rows.select("source", "external_id", "true_entity_id", (F.col("is_confusable_distinct").cast("int") != 0).alias("is_confusable_distinct"))
