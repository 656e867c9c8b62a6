"""Snapshot stores in buckets, and the ingest that publishes three tables together."""

from pathlib import Path

import pytest

from corpusflow.operators.embedding import hash_provider
from corpusflow.plans import ingestion as I
from corpusflow.sources.snapshots import COMPLETE, SnapshotStore

PAGE = "book_id int, page_id long, character_id string, character_name string, text string, dataset_dir string"
PLACE = ["document_id", "chunk_index", "chunk_hash"]


def numbers(spark, ids, text="t"):
    return spark.createDataFrame([(i, f"{text}{i}") for i in ids], "id long, text string")


def size(path: Path) -> int:
    return sum(p.stat().st_size for p in path.rglob("*.parquet"))


def test_a_small_batch_writes_its_own_buckets(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path), {"rows": ["id"]}, buckets=200)
    store.write({"rows": spark.range(20_000).selectExpr("id", "repeat(sha2(string(id), 256), 8) AS text")})
    whole = size(tmp_path / "data" / "v=00000001")
    batch = spark.range(7, 8).selectExpr("id", "'new' AS text")
    touched = store.touched(batch, "rows")
    before = store.read("rows", touched)
    assert len(touched) == 1 and before.count() < 200
    store.write({"rows": before.where("id <> 7").unionByName(batch)}, touched)
    assert size(tmp_path / "data" / "v=00000002") < 0.02 * whole
    assert store.read("rows").count() == 20_000 and [r["text"] for r in store.read("rows").where("id = 7").collect()] == ["new"]
    assert store.read("rows", version=1).where("text = 'new'").count() == 0  # the version before is readable


def test_versions_go_and_what_is_held_stays(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path), {"rows": ["id"]}, buckets=4)
    store.write({"rows": numbers(spark, range(40))})
    for k in range(4):
        batch = numbers(spark, [k], "edit")
        touched = store.touched(batch, "rows")
        store.write({"rows": store.read("rows", touched).where(f"id <> {k}").unionByName(batch)}, touched)
    assert store.versions() == [4, 5]
    for version in store.versions():
        assert sorted(r["id"] for r in store.read("rows", version=version).collect()) == list(range(40))
    held = {f for v in store.versions() for f in store.manifest(v)["folders"].values()}
    on_disk = {str(p.relative_to(tmp_path)) for p in (tmp_path / "data").glob("*/rows/*=*")}
    assert on_disk == held
    empty = store.touched(numbers(spark, [1]), "rows")
    store.write({"rows": store.read("rows", empty).limit(0)}, empty)
    assert all(r["id"] != 1 for r in store.read("rows").collect())
    with pytest.raises(ValueError, match="not among"):
        store.write({"rows": numbers(spark, range(40))}, [0])
    assert store.read("rows").count() > 0


def test_runs_that_stop_leave_the_version_before(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path), {"rows": ["id"]}, buckets=4)
    assert not store.exists()
    for _ in range(3):  # first writes that stop before their mark
        number = store.write({"rows": numbers(spark, range(3))})
        (tmp_path / f"v={number:08d}" / COMPLETE).unlink()
        (tmp_path / "_CREATED").unlink()
        assert not store.exists()
        with pytest.raises(FileNotFoundError):
            store.read("rows")
    store.write({"rows": numbers(spark, range(5))})
    assert store.read("rows").count() == 5 and len(list((tmp_path / "data").iterdir())) == 1
    number = store.write({"rows": numbers(spark, range(9))})
    (tmp_path / f"v={number:08d}" / COMPLETE).unlink()
    assert store.read("rows").count() == 5
    (tmp_path / f"v={store.versions()[0]:08d}" / COMPLETE).unlink()
    with pytest.raises(RuntimeError, match="no complete"):
        store.exists()


def pages(spark, rows):
    return spark.createDataFrame([(1, i, who, who, text, "set") for i, who, text in rows], PAGE)


def test_runs_and_an_edit(spark, tmp_path):
    store, calls = I.corpus_store(spark, str(tmp_path), buckets=4), spark.sparkContext.accumulator(0)

    def provider(texts):
        calls.add(len(texts))
        return hash_provider(4)(texts)

    run = lambda rows: I.ingest_pages(store, pages(spark, rows), provider, most=8, overlap=2, least=2).first()
    long = " ".join(f"sentence number {i}." for i in range(9))
    rows = [(1, "a", long), (2, "b", "short text."), (3, "", "nobody's")]
    first = run(rows)
    assert (first["pages_seen"], first["pages_new"], first["pages_skipped"]) == (2, 2, 1) and first["chunks_new"] == first["embedded_chunks"] == calls.value > 3
    second = run(rows)
    assert (second["pages_unchanged"], second["pages_new"], second["chunks_new"], second["chunks_updated"], second["embedded_chunks"]) == (2, 0, 0, 0, 0)
    assert calls.value == first["embedded_chunks"]
    third = run([(1, "a", long + " The end is new."), (2, "b", "short text.")])
    assert (third["pages_updated"], third["pages_unchanged"]) == (1, 1) and third["chunks_unchanged"] > 0 and 0 < third["embedded_chunks"] < first["embedded_chunks"]
    assert calls.value == first["embedded_chunks"] + third["embedded_chunks"]
    shorter = run([(1, "a", "short now.")])
    assert shorter["chunks_deleted"] > 0 and store.read("chunks").count() == 2
    nothing = run([(1, "a", " ")])  # no chunk is left
    assert nothing["chunks_deleted"] == 1 and store.read("chunks").count() == store.read("embeddings").count() == 1 and store.read("documents").count() == 2


def test_one_failing_character_leaves_nothing(spark, tmp_path):
    store = I.corpus_store(spark, str(tmp_path), buckets=4)

    def flaky(texts):
        if any("BOOM" in t for t in texts):
            raise RuntimeError("no answer")
        return hash_provider(4)(texts)

    rows = [(1, "ok1", "a sound text."), (2, "bad", "a text with BOOM in it."), (3, "bad", "a sound page of it."), (4, "ok2", "another sound text.")]
    stats = I.ingest_missing_characters(store, pages(spark, rows).coalesce(1), flaky).first()
    assert (stats["characters_checked"], stats["characters_added"], stats["characters_failed"]) == (3, 2, 1)
    assert sorted(r["character_id"] for r in store.read("documents").collect()) == ["ok1", "ok2"]
    assert store.read("chunks").count() == store.read("embeddings").count() == 2
    # again: those that are stored are not looked at, the one that failed is tried
    rows = [(1, "ok1", "edited."), (2, "bad", "mended."), (9, "ok2", "one page more.")]
    stats = I.ingest_missing_characters(store, pages(spark, rows), hash_provider(4)).first()
    assert (stats["pages_seen"], stats["characters_checked"], stats["characters_added"], stats["characters_failed"]) == (1, 1, 1, 0)
    assert {r["text"] for r in store.read("documents").collect()} == {"a sound text.", "another sound text.", "mended."}
    # a stored character whose edit fails stays as it was
    stats = I.ingest_pages(store, pages(spark, [(1, "ok1", "BOOM now."), (4, "ok2", "edited well.")]), flaky, unit="character_id").first()
    assert stats["characters_failed"] == 1
    assert {r["text"] for r in store.read("documents").collect()} == {"a sound text.", "edited well.", "mended."}
    joined = store.read("chunks").join(store.read("embeddings").where("embedding IS NOT NULL"), PLACE)
    assert {r["chunk_text"] for r in joined.collect()} == {"a sound text.", "edited well.", "mended."}
    with pytest.raises(RuntimeError, match="no answer"):
        I.ingest_pages(store, pages(spark, [(1, "ok1", "BOOM now.")]), flaky)
    assert store.read("documents").count() == 3


def test_a_run_writes_what_changed(spark, tmp_path):
    store = I.corpus_store(spark, str(tmp_path), buckets=4)
    run = lambda rows: I.ingest_pages(store, pages(spark, rows), hash_provider(4)).first()
    rows = [(i, "a", f"page {i} has a text of its own.") for i in range(40)]
    run(rows)
    first = {f for f in store.manifest()["folders"].values()}
    run(rows)
    assert set(store.manifest()["folders"].values()) == first and size(tmp_path / "data" / "v=00000002") == 0  # nothing was written again
    run([(90, "b", "a new page."), (91, "b", "a new page.")])
    assert first < set(store.manifest()["folders"].values())  # new pages are added to what is there
    assert store.read("documents").count() == store.read("chunks").count() == store.read("embeddings").count() == 42
    stats = run([(90, "b", "a page that was edited."), (3, "a", "edited too."), (3, "a", "edited too.")])
    assert (stats["pages_updated"], stats["chunks_updated"], stats["embedded_chunks"]) == (2, 2, 2)
    texts = {r["page_id"]: r["text"] for r in store.read("documents").collect()}
    chunks = {r["page_id"]: r["chunk_text"] for r in store.read("chunks").join(store.read("embeddings"), PLACE).collect()}
    assert len(texts) == 42 and chunks == texts and texts[3] == "edited too." and texts[90] == "a page that was edited."
