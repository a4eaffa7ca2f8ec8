"""Consecutive numbers in a total order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestitch.operators.scratch import Scratch


def number_rows(rows: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Adds ``name``: 1, 2, ... by ``order``, which has to be distinct.

    Rows are dealt out by ranges of the order and written once, so that ranges and
    their sizes agree; only the ranges' sizes are summed up in one place.
    """
    cut = Scratch(rows.sparkSession, "numbering").write(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    numbered = cut.withColumn("_i", within).join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range")
    return numbered.withColumn(name, (F.col("_before") + F.col("_i")).cast("long")).drop("_range", "_before", "_i")
