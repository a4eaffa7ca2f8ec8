"""Durable intermediate tables.

Iterative and multi-pass operators cut their lineage by writing an intermediate
table to the folder the cluster names in ``spark.checkpoint.dir`` and reading it
back.  Such a table survives the loss of any executor, is written exactly once
and is visible to every node.  Only where the setting is absent and the master is
local (tests, a laptop) does the process make a folder of its own; a cluster without
the setting is an error.

Results may read these tables for as long as the session lives, so they go when it
ends: every folder is handed to its file system to be deleted on exit.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared scratch folder of this session."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder; a cluster needs one that all its nodes share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lodestitch-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return _own[0]


class Scratch:
    """Writes tables below one fresh folder of the shared scratch space."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(folder)
        system.deleteOnExit(folder)

    def write(self, df: DataFrame, files: int | None = None) -> DataFrame:
        """Materialise ``df`` and return a scan of it.

        ``files`` merges small outputs without another shuffle.
        """
        self._n += 1
        path = f"{self.path}/t{self._n}"
        schema = df.schema
        (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(schema).parquet(path)
