import time

import pytest
from pyspark.sql import functions as F

from corpusflow.operators.embedding import hash_provider
from corpusflow.plans.ingestion import corpus_store
from corpusflow.sources.snapshots import SnapshotStore
from corpusflow.streaming import jobs as J


def ingest(spark, store, src, check, seen=None, order=None):
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    J.incremental_ingest(stream, store, "pages", ["page_id"], check, (lambda df, _: seen.append(df.count())) if seen is not None else None, order).awaitTermination()


def test_incremental_ingest_skips_unchanged_pages(spark, tmp_path):
    seen, src, store = [], str(tmp_path / "in"), SnapshotStore(spark, str(tmp_path / "table"), {"pages": ["page_id"]}, buckets=4)
    rows = lambda x: spark.createDataFrame(x, "page_id long, text string").coalesce(1)
    rows([(1, "a"), (2, "b")]).write.mode("append").parquet(src)
    ingest(spark, store, src, str(tmp_path / "check"), seen)
    rows([(1, "a"), (2, "c"), (3, "d")]).write.mode("append").parquet(src)
    ingest(spark, store, src, str(tmp_path / "check"), seen)
    assert seen == [2, 2]
    assert sorted((r["page_id"], r["text"]) for r in store.read("pages").collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_last_version_of_a_page_stays_however_the_stream_is_cut(spark, tmp_path):
    rows = [(1, "old", 1), (1, "newest", 5), (1, "middle", 3), (2, "only", 2), (3, "b", 4), (3, "a", 9), (2, "only", 8), (2, "between", 6)]
    for many in (1, len(rows)):
        src, store = str(tmp_path / f"in{many}"), SnapshotStore(spark, str(tmp_path / f"t{many}"), {"pages": ["page_id"]}, buckets=4)
        for i in range(0, len(rows), len(rows) // many):
            spark.createDataFrame(rows[i : i + len(rows) // many], "page_id long, text string, line long").coalesce(1).write.mode("append").parquet(src)
        ingest(spark, store, src, str(tmp_path / f"c{many}"), order=["line"])
        assert sorted((r["page_id"], r["text"], r["line"]) for r in store.read("pages").collect()) == [(1, "newest", 5), (2, "only", 8), (3, "a", 9)]


PAGE = "book_id int, page_id long, character_id string, character_name string, text string, line long"


def test_a_stream_of_pages_becomes_documents_chunks_and_embeddings(spark, tmp_path):
    src, counted, calls = str(tmp_path / "in"), [], spark.sparkContext.accumulator(0)
    store = corpus_store(spark, str(tmp_path / "corpus"), buckets=4)
    own = hash_provider(4)

    def provider(texts):
        calls.add(len(texts))
        return own(texts)

    def go(rows):
        spark.createDataFrame(rows, PAGE).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(PAGE).parquet(src)
        J.corpus_ingest(stream, store, provider, str(tmp_path / "check"), ["line"], lambda df, _: counted.append(df.first())).awaitTermination()
        return counted[-1]

    first = go([(1, 1, "a", "A", "one text.", 1), (1, 2, "b", "B", "another text.", 2), (1, 3, None, "C", "no identity", 3)])
    assert (first["pages_new"], first["pages_skipped"], first["embedded_chunks"], calls.value) == (2, 1, 2, 2)
    again = go([(1, 1, "a", "A", "one text.", 4), (1, 2, "b", "B", "another text, edited.", 5)])
    assert (again["pages_unchanged"], again["pages_updated"], again["chunks_updated"], calls.value) == (1, 1, 1, 3)
    late = go([(1, 2, "b", "B", "another text, as it was before.", 3)])
    assert (late["pages_updated"], late["embedded_chunks"], calls.value) == (0, 0, 3)
    assert sorted((r["page_id"], r["text"]) for r in store.read("documents").collect()) == [(1, "one text."), (2, "another text, edited.")]
    assert store.read("chunks").join(store.read("embeddings").where("embedding IS NOT NULL"), ["document_id", "chunk_index", "chunk_hash"]).count() == store.read("chunks").count() == 2


def test_two_versions_without_an_order_are_an_error(spark):
    df = lambda rows: spark.createDataFrame(rows, "page_id long, content_hash string")
    assert J.last_versions(df([(1, "a"), (1, "a"), (None, "b")]), ["page_id"]).count() == 2
    with pytest.raises(Exception, match="two versions"):
        J.last_versions(df([(1, "a"), (1, "b")]), ["page_id"]).collect()


def test_cut_segments():
    assert J.cut_segments("one. two! three") == (["one.", "two!"], " three")
    assert J.cut_segments("word " * 10, 12)[0][0] == "word word"
    assert J.cut_segments("x" * 25, 10) == (["x" * 10, "x" * 10], "x" * 5)


def test_segments_of_out_of_order_pieces(spark, tmp_path):
    text = "First one. Second [1] one! Then a tail"
    pieces = [("g", i, text[i * 5 : i * 5 + 5], i == 7) for i in range(8)]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else batches go on until the timers are due
    spark.createDataFrame(pieces[::-1], "generation_id string, seq long, piece string, final boolean").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("generation_id string, seq long, piece string, final boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    J.segment_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("segment").select("text").collect()
    assert [r[0] for r in got] == ["First one.", "Second one!", "Then a tail"]


def test_deltas(spark):
    df = spark.createDataFrame([("مَا",), ("ذَا",)], "piece string")
    assert "".join(r[0] for r in J.strip_deltas(df).select(F.col("piece")).collect()) == "ماذا"


def test_deltas_of_a_stream(spark, tmp_path):
    spark.createDataFrame([("g", 0, "مَا"), ("g", 1, "ذَا")], "generation_id string, seq long, piece string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("generation_id string, seq long, piece string").parquet(str(tmp_path / "in"))
    J.strip_deltas(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [r["piece"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()] == ["ما", "ذا"]


def test_state_expires_and_an_id_is_used_again(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "generation_id string, seq long, piece string, final boolean"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def go(rows, finished_ms=2000, stale_ms=60_000):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        J.segment_stream(stream, finished_ms, stale_ms).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["generation_id"], r["segment"], r["text"]) for r in spark.read.schema("generation_id string, segment long, text string").parquet(out).collect())

    assert go([("g", 0, "One. ", False), ("g", 1, None, False), ("g", 3, "late.", None), ("h", 1, "waits", None)]) == [("g", 0, "One.")]
    first = [("g", 0, "One."), ("g", 1, "Two, late."), ("g", 2, "End")]
    assert go([("g", 2, "Two, ", False), ("g", 4, "End", True), ("g", 0, "again. ", False)]) == first
    time.sleep(3)
    assert go([("g", 0, "Another. ", False), ("h", 0, "it ", True)])[:2] == [("g", 0, "Another."), ("g", 0, "One.")]


def test_stale_pieces_are_forgotten(spark, tmp_path):
    schema = "generation_id string, seq long, piece string, final boolean"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def go(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        J.segment_stream(stream, 1000, 1500).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    go([("g", 0, "not ended ", False), ("g", 2, "early. ", False)])
    time.sleep(3)
    go([("g", 0, "Fresh. ", False), ("g", 1, "one. ", False)])
    assert sorted(r["text"] for r in spark.read.parquet(out).collect()) == ["Fresh.", "one."]


def test_new_pages_are_added_and_full_buckets_rewritten(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("corpusflow.sources.snapshots.PARTS", 3)
    src, store = str(tmp_path / "in"), SnapshotStore(spark, str(tmp_path / "table"), {"pages": ["page_id"]}, buckets=1)
    counts = []
    for k in range(5):
        spark.createDataFrame([(k, f"text {k}"), (k + 100, "other")], "page_id long, text string").coalesce(1).write.mode("append").parquet(src)
        ingest(spark, store, src, str(tmp_path / "check"))
        counts.append(len(store.manifest()["folders"]))
    assert counts[:3] == [1, 2, 3] and counts[3] < 3  # nothing is rewritten before a bucket is full
    assert sorted(r["page_id"] for r in store.read("pages").collect()) == sorted([*range(5), *range(100, 105)])
