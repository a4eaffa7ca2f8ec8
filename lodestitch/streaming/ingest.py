"""Continuous ingestion of raw entities into the state tables.

Each micro-batch is normalized and appended; the first row of a ``(source,
external_id)`` wins, also over batches, and within a batch the one with the least name
and address.  Ids are a hash of that key, so that batches need not agree on a counter.
Raw and normalized rows are each written for the keys that their own table lacks, so a
batch that is replayed after a failure adds what is missing and nothing twice, wherever
the failure came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestitch.operators.normalize import normalize
from lodestitch.sources.state import Store

_KEY = ["source", "external_id"]


def key_id():
    return F.xxhash64(*_KEY).bitwiseAND(F.lit((1 << 62) - 1))


def append_batch(batch: DataFrame, store: Store) -> None:
    rest = [c for c in batch.columns if c not in _KEY]
    order = F.struct(*[c for c in ("raw_name", "raw_address") if c in rest])
    once = batch.groupBy(*_KEY).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*_KEY, "_r.*").withColumn("id", key_id())
    # Raw rows first: what a failed run has left of a batch is what its normalized rows must come from.
    store.write("raw_entities", once.join(store.read("raw_entities", False).select(*_KEY), _KEY, "left_anti"))
    known = store.read("raw_entities", False).join(batch.select(*_KEY).distinct(), _KEY, "left_semi")
    store.write("normalized_entities", normalize(known).join(store.read("normalized_entities", False).select("raw_entity_id"), "raw_entity_id", "left_anti"))


def ingest(stream: DataFrame, store: Store, checkpoint: str, **options) -> StreamingQuery:
    """Starts the query; ``stream`` has source, external_id, raw_name and raw_address."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: append_batch(batch, store)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(options or {"availableNow": True})).start()
