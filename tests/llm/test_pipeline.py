from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import corpus_pipeline
from corpusflow.llm.packing import CAPACITY
from corpusflow.llm.shingles import shingle_sets


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    import numpy as np
    import pyarrow as pa

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(seen["language_id"]) >= 0.97 * len(given)
    last = {r["text"]: r["doc_id"] for r in sorted(seen["language_id"], key=lambda r: r["doc_id"])}
    assert sorted(r["doc_id"] for r in seen["exact_dedup"]) == sorted(last.values())
    rows = sorted(seen["exact_dedup"], key=lambda r: r["doc_id"])
    sets = shingle_sets(pa.array([r["text"] for r in rows]))
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for k in range(i):
            both = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[k]) - both):
                lo, hi = sorted((find(i), find(k)))
                top[hi] = lo
    assert sorted(r["doc_id"] for r in seen["ngram_jaccard"]) == [r["doc_id"] for i, r in enumerate(rows) if find(i) == i]
    kept = {r["doc_id"] for r in seen["source_mixing"]}
    assert kept and kept <= {r["doc_id"] for r in seen["ngram_jaccard"]}
    assert {r["doc_id"] for r in seen["packing"]} == kept
    size = Counter()
    for r in seen["packing"]:
        size[r["sequence_id"]] += r["length"]
    assert max(size.values()) <= CAPACITY
    ran = corpus_pipeline.run(spark, sf_dir).collect()
    strip = lambda rows: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows)
    assert strip(ran) == strip(seen["packing"])


def test_stages_keep_rows_with_null_and_repeated_ids(spark, sf_dir, table):
    def run(stage, rows):
        return sorted(((r["doc_id"], r["text"]) for r in stage(spark, table(rows), sf_dir).collect()), key=str)

    words = lambda k: " ".join(f"word{'abcdefghij'[(i * k) % 10]} thing{'klmnopqrst'[(i + k) % 10]}" for i in range(1, 30))
    one, two, three = words(3), words(7), words(9)
    near = f"{one} and"
    rows = [(None, one), (None, two), (5, one), (5, one), (6, three), (6, two), (7, three), (7, three), (6, None), (8, "12 34")]
    lang = run(corpus_pipeline.language_id, rows)
    assert lang == sorted([(i, t) for i, t in rows if t and t != "12 34"], key=str)
    exact = run(corpus_pipeline.exact_dedup, rows)
    assert exact == sorted([(5, one), (6, two), (7, three), (6, None), (8, "12 34")], key=str)
    assert run(corpus_pipeline.exact_dedup, [(None, one), (None, one), (None, two)]) == sorted([(None, one), (None, two)], key=str)
    jaccard = run(corpus_pipeline.ngram_jaccard, [(None, two), (5, one), (5, near), (6, three), (6, one), (4, None), (None, "")])
    assert jaccard == sorted([(None, two), (5, one), (6, three), (4, None), (None, "")], key=str) or jaccard == sorted([(None, two), (5, near), (6, three), (4, None), (None, "")], key=str)
    mixed = run(corpus_pipeline.source_mixing, [(None, two), (None, two)])
    assert len(mixed) in (0, 2)
    packed = corpus_pipeline.packing(spark, table([(None, one), (5, two), (5, two)]), sf_dir).select("doc_id").collect()
    assert sorted(str(r["doc_id"]) for r in packed) == ["5", "5", "None"]


def test_stages_take_an_empty_table(spark, sf_dir, table):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table([]), sf_dir).count() == 0


def test_stages_take_extra_columns_with_names_of_their_own(spark, sf_dir):
    fields = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, kept boolean, prob double, topic string, _row_key long, uid long, name string, component_id long, n_tokens long"
    text = "these are some plain words of english text that were written for a test"
    rows = [(i, f"{text} {i}" if i else text, "en", "s", 1, "x", 0.1, False, 0.2, "t", 5, 6, "n", 7, 8) for i in range(3)]
    docs = spark.createDataFrame(rows, fields)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns
        assert {tuple(r) for r in got.collect()} <= set(rows), name
    assert corpus_pipeline.packing(spark, docs, sf_dir).count() == 3


def test_two_runs_at_once_do_not_touch_each_others_tables(spark, sf_dir):
    with ThreadPoolExecutor(2) as pool:
        runs = [pool.submit(lambda: sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, sf_dir).collect())) for _ in range(2)]
        one, two = (r.result() for r in runs)
    assert one and one == two
