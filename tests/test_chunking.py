import itertools
import random
import re
import time

import public_tokenizers
from pyspark.sql import functions as F

from corpusflow.operators import chunking as C

WS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"


def packed(segments, sizes, most, overlap, least, count):
    """The packing rule, told by places: where chunks end and start follows from sums of tokens alone."""
    total = [0, *itertools.accumulate(sizes)]
    spans, start, begin = [], 0, 0  # a span starts at ``start``; the segment at ``begin`` belongs to it whatever its size
    while begin < len(segments):
        stop = next((k for k in range(begin + 1, len(segments)) if total[k + 1] - total[start] > most), len(segments))
        spans.append((start, stop))
        fits = [k for k in range(start, stop) if total[stop] - total[k] <= overlap]
        start, begin = min([*fits, stop - 1]), stop
    made = [(" ".join(segments[i:j]), total[j] - total[i]) for i, j in spans]
    if len(made) > 1 and made[-1][1] < least:
        whole = made[-2][0] + " " + made[-1][0]
        made[-2:] = [(whole, count(whole))]
    return made


def reference(text, most, overlap, least):
    parts = [p.split() for line in text.split("\n") for p in re.split(r"(?<=[.!؟])\s+", line) if p.split()]
    raw = [p.strip() for line in text.split("\n") for p in re.split(r"(?<=[.!؟])\s+", line) if p.split()]
    segments = [s for words, whole in zip(parts, raw, strict=True) for s in ([whole] if len(words) <= most else [" ".join(words[k : k + most]) for k in range(0, len(words), most)])]
    return packed(segments, [len(s.split()) for s in segments], most, overlap, least, lambda x: len(x.split()))


def sentences_of(text):
    return [p.strip() for line in text.split("\n") for p in re.split(r"(?<=[.!؟])\s+", line.strip()) if p.strip()]


def test_documents_against_the_rule(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = {}
    for r in C.chunk_text(docs, most=60, overlap=10, least=15).collect():
        got.setdefault(r["doc_id"], []).append((r["chunk_index"], r["chunk_text"], r["token_count"]))
    for r in docs.collect():
        want = reference(r["text"], 60, 10, 15)
        assert sorted(got.get(r["doc_id"], [])) == [(i, t, k) for i, (t, k) in enumerate(want)]


def test_blank_short_and_long_texts(spark):
    rows = [(1, ""), (2, " \n "), (3, "one."), (4, "w " * 130), (5, ". ".join(f"a{i} b c" for i in range(200)) + "."), (6, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {}
    for r in C.chunk_text(df, most=50, overlap=10, least=5).collect():
        got.setdefault(r["doc_id"], []).append((r["chunk_text"], r["token_count"]))
    assert set(got) == {3, 4, 5} and got[3] == [("one.", 1)]
    assert got[4] == reference("w " * 130, 50, 10, 5)
    assert got[5] == reference(rows[4][1], 50, 10, 5)
    assert set(rows[4][1].split()) <= {w for t, _ in got[5] for w in t.split()}


def test_random_sentences_against_the_rule(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(" ".join(["w"] * rng.choice([1, 2, 3, 9, 14, 30])) + rng.choice([". ", "! ", ".\n", "؟ "]) for _ in range(rng.randint(1, 40)))) for i in range(60)]
    for most, overlap, least in ((12, 4, 3), (10, 0, 1), (25, 30, 12)):
        got = {}
        for r in C.chunk_text(spark.createDataFrame(rows, "doc_id int, text string"), most=most, overlap=overlap, least=least).collect():
            got.setdefault(r["doc_id"], []).append((r["chunk_index"], r["chunk_text"], r["token_count"]))
        assert {k: sorted(v) for k, v in got.items()} == {i: [(k, *x) for k, x in enumerate(reference(t, most, overlap, least))] for i, t in rows}


def test_plan_is_native_and_without_a_shuffle(spark, sf_dir):
    plan = C.chunk_text(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))


def test_counters_of_bytes_and_of_a_vocabulary(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    tokens = lambda x: tokenizer.encode(x, add_special_tokens=False)

    def cut_bpe(x, most):
        e = tokens(x)
        starts = [0, *(e.offsets[i][0] for i in range(most, len(e.ids), most)), len(x)]
        return [(x[i:j], min(most, len(e.ids) - k * most)) for k, (i, j) in enumerate(zip(starts[:-1], starts[1:], strict=True)) if x[i:j]]

    size = lambda x: -(-len(x.encode()) // 4)
    cut_bytes = lambda x, most: [(x, size(x))] if size(x) <= most else [(x[i : i + most], size(x[i : i + most])) for i in range(0, len(x), most)]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(80).collect()]
    rows += [(-1, "وقال ابن معين إن أبا بكر الصديق رضي الله عنه كان أول من آمن من الرجال " * 20), (-2, "a😀" * 300), (-3, ""), (-4, None), (-5, "one. <|endoftext|> two. three.")]
    for counter, cut, count in ((C.BYTES4, cut_bytes, size), (C.bpe(public_tokenizers.path("byte_bpe_50k.json")), cut_bpe, lambda x: len(tokens(x).ids))):
        got = {}
        for r in C.chunk_text(spark.createDataFrame(rows, "doc_id int, text string"), most=50, overlap=12, least=20, counter=counter).collect():
            got.setdefault(r["doc_id"], []).append((r["chunk_index"], r["chunk_text"], r["token_count"]))
        for doc, text in rows:
            made = [p for x in sentences_of(text or "") for p in cut(x, 50)]
            want = packed([p[0] for p in made], [p[1] for p in made], 50, 12, 20, count)
            assert sorted(got.get(doc, [])) == [(i, *w) for i, w in enumerate(want)], doc


def test_time_grows_with_sentences(spark):
    def seconds(n):
        df = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("word number "), i.cast("string"), F.lit("."))), " ").alias("text"))
        began = time.time()
        assert C.chunk_text(df, most=12, overlap=3, least=2).count() > n / 5
        return time.time() - began

    seconds(2_000)
    assert seconds(120_000) < 4 * seconds(30_000) + 10


def test_tokens_of_words_add_up():
    counts = C.word_counts(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["don't <|endoftext|> we're 's x", "a b, c.", "été 12 ab3   end", "two  spaces", "tab\t here", "no break", ""]
    found = counts.of(texts)
    whole = [len(counts.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [f for f in found if f >= 0] == [w for f, w in zip(found, whole, strict=True) if f >= 0]
    assert [f >= 0 for f in found] == [True, True, False, False, False, True, False]
