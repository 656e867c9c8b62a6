"""Line numbers over splits and files, many dataset folders, and calls that a restart does not repeat."""

import json
from collections import Counter

import pytest

from corpusflow.operators import classification as K
from corpusflow.operators import embedding as E
from corpusflow.plans import ingestion as I
from corpusflow.sources import pages as P

PAGE = {"book_id": 1, "book_title": "b", "author": "a", "collection": "c", "caliph_id": "x", "caliph_name": "n", "page_id": 1, "printed_page": "5", "url": "u", "text": "t"}


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_lines_of_split_files_have_their_numbers(spark, tmp_path, small_splits):
    for name, n in (("b.txt", 900), ("a.txt", 700), ("c.txt", 3)):
        (tmp_path / name).write_text("".join(f"{name} {i + 1} {'x' * (i % 37)}\n" for i in range(n)))
    lines = P.numbered_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
    got = lines.collect()
    assert len(got) == 1603
    for r in got:
        name, line = r["value"].split()[:2]
        assert r["file"].endswith(name) and r["line"] == int(line)
        assert r["line_no"] == r["line"] + {"a.txt": 0, "b.txt": 700, "c.txt": 1600}[name]


def test_a_result_log_over_several_files(spark, tmp_path, small_splits):
    for name, status in (("1.jsonl", "failed"), ("2.jsonl", "completed")):
        (tmp_path / name).write_text("\n".join(json.dumps({"custom_id": f"s{i}::c1d1", "status": status, "response": {"content": "y" * 40}}) for i in range(60)) + "\n\n")
    log = P.read_result_log(spark, str(tmp_path))
    latest = {r["custom_id"]: (r["status"], r["n_attempts"], r["first_line"]) for r in K.latest_status(log).collect()}
    assert latest == {f"s{i}::c1d1": ("completed", 2, i + 1) for i in range(60)}
    (tmp_path / "3.jsonl").write_text("\n" * 7 + "[1, 2")
    with pytest.raises(Exception, match=r"3.jsonl:8: not a JSON object"):
        P.read_result_log(spark, str(tmp_path)).collect()


def test_errors_of_pages_name_file_and_line(spark, tmp_path, small_splits):
    rows = [json.dumps(PAGE | {"page_id": i}) for i in range(50)]
    (tmp_path / "x_pages.jsonl").write_text("\n".join(rows))
    assert P.read_jsonl_pages(spark, str(tmp_path)).count() == 50
    for bad, message in ((json.dumps({k: v for k, v in PAGE.items() if k != "text"}), "missing text"), ("{", "not a JSON"), (json.dumps(PAGE | {"page_id": "seven"}), "not a JSON")):
        (tmp_path / "x_pages.jsonl").write_text("\n".join([*rows[:40], "", bad, *rows[40:]]))
        with pytest.raises(Exception, match=rf"x_pages.jsonl:42: {message}"):
            P.read_jsonl_pages(spark, str(tmp_path)).select("page_id").collect()


def test_many_folders_are_two_scans(spark, tmp_path):
    for i in range(300):
        folder = tmp_path / f"set {i}+"
        if i % 3 == 0:
            (folder / "pages").mkdir(parents=True)
            (folder / "pages" / "7.json").write_text(json.dumps({"page_id": i, "character_id": "c", "character_name": "n", "text": "t"}, indent=1))
        else:
            folder.mkdir()
            (folder / ("x_pages.jsonl" if i % 3 == 1 else "readme.txt")).write_text(json.dumps(PAGE | {"page_id": i}) + "\n")
    (tmp_path / "set 0+" / "y_pages.jsonl").write_text("not read: page files win")
    pages, skipped = P.discover_datasets(spark, str(tmp_path))
    assert {(r["dataset_dir"], r["page_id"]) for r in pages.select("dataset_dir", "page_id").collect()} == {(f"set {i}+", i) for i in range(300) if i % 3 < 2}
    assert len(skipped) == 100
    scans = pages._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert scans <= 4  # of lines there is one more for each sum of lines
    assert P.discover_datasets(spark, str(tmp_path / "nothing")) == (None, [])


def test_a_run_that_stopped_calls_only_what_is_absent(spark, tmp_path):
    log, stop = str(tmp_path / "log"), tmp_path / "stop"
    calls = tmp_path / "calls"
    calls.mkdir()
    stop.write_text("")

    def provider(texts):
        if stop.exists() and len(list(calls.iterdir())) >= 20:
            raise SystemExit  # as if the process were killed after half of the calls
        for t in texts:
            with (calls / t.replace(" ", "_")).open("a") as f:
                f.write("x")
        return [[float(t.split()[1])] for t in texts]

    df = spark.createDataFrame([(i, f"prompt {i % 40}") for i in range(80)] + [(99, None)], "id int, text string")
    with pytest.raises(Exception):  # noqa: B017
        E.answer_logged(df, provider, "text", log, batch=1)
    done = E.answer_log(spark, log, "array<float>").count()
    stop.unlink()
    got = {r["id"]: r["answer"] for r in E.answer_logged(df, provider, "text", log, batch=1).collect()}
    assert got == {i: [float(i % 40)] for i in range(80)} | {99: None}
    called = Counter({p.name: len(p.read_text()) for p in calls.iterdir()})
    assert len(called) == 40 and 16 <= done <= 24
    assert set(called.values()) <= {1, 2} and sum(called.values()) <= 40 + 4  # twice only what the four tasks were in when they were stopped
    E.answer_logged(df, provider, "text", log).collect()
    assert sum(len(p.read_text()) for p in calls.iterdir()) == sum(called.values())


def test_a_failing_prompt_fails_alone(spark, tmp_path):
    def flaky(texts):
        if any("BOOM" in t for t in texts):
            raise RuntimeError("no answer")
        return E.hash_provider(4)(texts)

    page = "book_id int, page_id long, character_id string, character_name string, text string"
    pages = spark.createDataFrame([(1, 1, "a", "a", "sound."), (1, 2, "b", "b", "BOOM.")], page)
    store = I.corpus_store(spark, str(tmp_path / "corpus"), buckets=2)
    stats = I.ingest_pages(store, pages, flaky, unit="character_id", log=str(tmp_path / "log")).first()
    assert (stats["characters_added"], stats["characters_failed"]) == (1, 1) and [r["text"] for r in store.read("documents").collect()] == ["sound."]
    stats = I.ingest_pages(store, pages, E.hash_provider(4), unit="character_id", log=str(tmp_path / "log")).first()
    assert (stats["characters_added"], stats["characters_failed"], stats["pages_unchanged"]) == (1, 0, 1)
    assert E.answer_log(spark, str(tmp_path / "log"), "array<float>").count() == 2
