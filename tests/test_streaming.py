from lodestitch.sources.state import Store
from lodestitch.streaming.ingest import append_batch, ingest

SCHEMA = "source string, external_id string, raw_name string, raw_address string"


def test_ingest(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    source = str(tmp_path / "in")
    for batch in ([("a", "1", "Acme Inc.", "1 Oak St, Reno"), ("a", "1", "Later", "x")], [("a", "1", "Again", "x"), ("a", "2", "Beta LLC", "2 Elm St, Reno")]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        ingest(spark.readStream.schema(SCHEMA).parquet(source), store, str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.external_id for r in store.read("raw_entities").collect()) == ["1", "2"]
    assert sorted(r.normalized_name for r in store.read("normalized_entities").collect())[1] == "beta llc"


def test_replay_after_a_failure_between_the_writes(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "db"))
    batch = spark.createDataFrame([("a", "1", "Acme Inc.", "1 Oak St, Reno"), ("a", "1", "Acme Later", "x"), ("a", "2", "Beta LLC", "2 Elm St, Reno")], SCHEMA)
    write = Store.write
    for table in ("normalized_entities", "raw_entities"):

        def failing(self, name, rows, mode="append", table=table):
            if name == table:
                raise OSError("lost")
            write(self, name, rows, mode)

        monkeypatch.setattr(Store, "write", failing)
        try:
            append_batch(batch, store)
        except OSError:
            pass
        monkeypatch.setattr(Store, "write", write)
        append_batch(batch, store)
        append_batch(batch, store)
        assert sorted((r.external_id, r.raw_name) for r in store.read("raw_entities").collect()) == [("1", "Acme Inc."), ("2", "Beta LLC")]
        assert store.read("normalized_entities").count() == 2
