import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from corpusflow.llm import language_id as lang


def test_held_out_accuracy_on_the_given_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = lang.op3_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert held and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) >= 0.95


def test_defined_cases(spark, table):
    rng = random.Random(2)
    en = lambda n: " ".join(rng.choice("the of and that was with from this have".split()) for _ in range(n))
    de = lambda n: " ".join(rng.choice("der und nicht über straße schön auch ein".split()) for _ in range(n))
    rows = [(i, en(20), "en") for i in range(40)] + [(100 + i, de(20), "de") for i in range(40)]
    rows += [(200, None, "en"), (201, "", "de"), (202, "123 ... ,", "en"), (203, "the", None), (204, de(60_000), None), (204, de(60_000), None), (None, en(5), "en")]
    got = lang.identify(table(rows)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["lang_pred"])
    assert by[200] == by[201] == by[202] == ["und"] and by[203] == ["en"] and by[204] == ["de", "de"] and by[None] == ["en"]
    assert all(by[i] == ["en"] and by[100 + i] == ["de"] for i in range(40))


def test_without_labels_or_rows(spark, table):
    got = lang.identify(table([(1, "abc", None), (2, "def", None)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 2
    assert lang.identify(table([])).count() == 0


def test_slices_of_a_long_text_count_each_gram_once(monkeypatch):
    text = "abcdeß" * 50
    batch = pa.RecordBatch.from_pydict({"text": [text, "xy"]})

    def grams():
        found = []
        for chars, bounds, rows in lang._texts(batch):
            for n in lang.ORDERS:
                lo, hi = lang._windows(bounds, rows, n)
                g = lang._grams(chars, n, 1024) if len(chars) >= n else np.zeros(0, np.int64)
                for r, i, j in zip(rows, lo, hi, strict=True):
                    found += [(int(r), n, int(x)) for x in g[i:j]]
        return sorted(found)

    whole = grams()
    monkeypatch.setattr(lang, "_SLICE", 17)
    assert grams() == whole and len(whole) == (300 + 299 + 298) + (2 + 1)


def bucket_of(gram):
    mask = (1 << 64) - 1
    code = 0
    for ch in gram:
        code = (code * 0x1F0A3 + ord(ch)) & mask
    code = (code + len(gram)) * 0x9E3779B97F4A7C15 & mask
    code ^= code >> 29
    return (code * 0xBF58476D1CE4E5B9 & mask) >> (64 - (lang.BUCKETS.bit_length() - 1))


def grams_of(text):
    folded = "".join((ch.lower() if len(ch.lower()) == 1 else ch) if ch.isalpha() else " " for ch in text)
    return Counter(bucket_of(folded[i : i + n]) for n in lang.ORDERS for i in range(len(folded) - n + 1))


def test_query_against_plain_naive_bayes(spark, sf_dir):
    """Every document of the given table, its n-grams counted one by one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    counted = {r["doc_id"]: grams_of(r["text"]) for r in docs}
    counts, rows = {}, Counter()
    for r in docs:
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            counts.setdefault(r["lang"], Counter()).update(counted[r["doc_id"]])
            rows[r["lang"]] += 1
    total = {x: sum(c.values()) + 0.5 * lang.BUCKETS for x, c in counts.items()}
    for r in lang.op3_language_id(spark, sf_dir).collect():
        scores = {x: math.log(rows[x] / sum(rows.values())) + sum(n * math.log((counts[x][b] + 0.5) / total[x]) for b, n in counted[r["doc_id"]].items()) for x in counts}
        best = max(sorted(scores), key=scores.get)
        score = 1 / sum(math.exp(v - scores[best]) for v in scores.values())
        assert r["lang_pred"] == best and abs(r["score"] - score) < 1e-3


def test_letters_of_all_planes_and_a_dirty_language_column(spark, table, monkeypatch):
    rare = chr(0x32010)
    got = lang.identify(table([(i, rare * 20, "zz") for i in range(5)] + [(9, "abc", "en"), (10, rare, None)])).collect()
    assert {r["lang_pred"] for r in got if r["doc_id"] == 10} == {"zz"}
    monkeypatch.setattr(lang, "count_grams", None)  # is not reached
    dirty = table([(i, "text", f"lang{i}") for i in range(lang.MOST_LANGUAGES + 1)])
    try:
        lang.train(dirty)
        raise AssertionError("no error")
    except ValueError as e:
        assert "languages" in str(e)


def test_the_sample_is_bounded_without_ids_too(spark, table):
    rows = [(None, f"text {i % 30}", "en") for i in range(60)] + [(1, f"one id {i}", "en") for i in range(40)] + [(i, "own id", "en") for i in range(100, 140)]
    for most in (1, 10, 30, 90):
        assert lang.sample(table(rows), most).count() == most
    assert lang.sample(table(rows), 1000).count() == len(rows)


def test_short_texts_at_the_end_of_a_batch(spark, table):
    rows = [(i, "the and of this", "en") for i in range(9)]
    for last in ("a", "ab", "", None, "é"):
        got = lang.identify(table([*rows, (100, last, None)]).coalesce(1)).collect()
        assert {r["lang_pred"] for r in got if r["doc_id"] == 100} == {"en" if last else "und"}
