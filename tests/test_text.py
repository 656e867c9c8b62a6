import hashlib
import html
import re
import unicodedata
from html.entities import html5
from random import Random

import pyarrow as pa
from pyspark.sql import functions as F

from corpusflow.functions import html as H
from corpusflow.functions import text as T


def one(spark, value, *columns):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_cleaning(spark):
    x = F.col("x")
    r = one(spark, "[[heading]\n \n[[-\n]]\na  \n\n\n\nb ]", T.clean_text(x), T.clean_line(F.lit("‏a \tb ‎")))
    assert r["c0"] == "heading\na\nb" and r["c1"] == "a b"
    assert one(spark, "﻿===== p =====\r\na  \n\n\n\nb​", T.clean_source_text(x))["c0"] == "a\n\nb"


def test_arabic(spark):
    x = F.col("x")
    r = one(spark, "مَاذَا أإآى", T.strip_diacritics(x), T.normalize_for_match(x), T.contains_arabic(x), T.stable_character_id(x))
    assert r["c0"] == "ماذا أإآى" and r["c1"] == "ماذا اااي" and r["c2"]
    assert r["c3"] == "siyar_" + hashlib.sha256("ماذا اااي".encode()).hexdigest()[:16]
    assert one(spark, "ﬁ ２", T.normalize_for_match(x))["c0"] == unicodedata.normalize("NFKC", "ﬁ ２")
    assert one(spark, "غضيف بن الحارث بن زنيم السكوني", T.stable_character_id(x))["c0"] == "siyar_6ba5623d4a72be3b"
    assert one(spark, "ج ٢٣", T.arabic_number_to_int(x), T.arabic_number_to_int(F.lit("none")))["c0"] == 23


def test_segments(spark):
    x = F.col("x")
    r = one(spark, "أ. ب. ج.", T.sentences(x), T.speech_segments(x))
    assert r["c0"] == r["c1"] == ["أ.", "ب.", "ج."]
    r = one(spark, "كلمة " * 200, T.speech_segments(x, 100))["c0"]
    assert all(len(s) <= 100 for s in r) and " ".join(r).split() == ["كلمة"] * 200
    assert one(spark, " \n ", T.sentences(x), T.speech_segments(x))["c1"] == []
    assert one(spark, "one. two", T.speech_segments(x))["c0"] == ["one.", "two"]
    assert one(spark, "y" * 250, T.speech_segments(x, 100))["c0"] == ["y" * 100, "y" * 100, "y" * 50]


def test_small_functions(spark):
    x = F.col("x")
    r = one(
        spark, "2026-08-12", T.hash_rotation_index(x, F.lit(7)), T.estimate_tokens(x), T.to_int_or_null(F.lit(" 12 ")), T.to_int_or_null(F.lit("x")), T.strip_citation_markers(F.lit("a [1] b［٢］")), T.page_label(F.lit(""), F.lit(5)),
        T.safe_filename(F.lit("a/b: c")), T.safe_filename(F.lit("//")), T.normalize_categories(F.lit('[" a ", "", "b"]')), T.normalize_categories(F.lit("a, b")), T.dedupe_labels(F.array(F.lit(" a"), F.lit("b"), F.lit("a "), F.lit(""))),
        T.strip_closing(F.lit("assistant"), F.lit("x\n\n" + T.CLOSING_QUESTION)),
    )
    assert list(r) == [3, 3, 12, None, "a b", "5", "ab_c", "unknown_character", ["a", "b"], [], ["a", "b"], "x"]


def test_page_extraction(spark):
    body = "<p>نص طويل بما يكفي ليكون صفحة كاملة</p>"
    page = lambda inner, title="x": f"<html><title>{title}</title><script>var a='</p>';</script><body>{inner}</body></html>"
    crumbs = f"<i>{H.CRUMBS_START}:</i><a>فهرس الكتاب</a><a>الصحابة</a><b>+</b><b>-</b><a>١٢ - أبو فلان</a><i>التشكيل</i>"
    rows = [
        (1, "u", page(f"{crumbs}<p>{H.PAGE_START}</p>{body}<p>{H.NEXT_SECTION}</p><p>z</p><p>{H.PAGE_END}</p>", "كتاب ج ٢ ص ١٥")),
        (2, "u", page(body)), (3, "u", page(f"<p>{H.PAGE_START}</p><p>short</p><p>{H.PAGE_END}</p>")),
    ]
    pages, rejects = H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    r = pages.collect()
    assert len(r) == 1 and (r[0]["printed_volume"], r[0]["printed_page"], r[0]["entry_name"], r[0]["source_section"], r[0]["next_section_trimmed"]) == (2, 15, "أبو فلان", "الصحابة", True)
    assert r[0]["text"] == "نص طويل بما يكفي ليكون صفحة كاملة" and r[0]["content_hash"] == hashlib.sha256(r[0]["text"].encode()).hexdigest()
    assert sorted((x["page_id"], x["reason"]) for x in rejects.collect()) == [(2, "no start or end marker"), (3, "text too short or not Arabic")]


def test_character_references_of_every_kind(spark):
    names = [x for n in html5 for x in (f"&{n}", f"a&{n}b;", f"&{n.rstrip(';')} c", f"&&{n}&{n[:-1]}")]
    numbers = [0, 1, 9, 11, 13, 31, 65, 127, 128, 129, 150, 159, 160, 233, 0x7FF, 0x800, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1F600, 0x1FFFE, 0x10FFFF, 0x110000, 2**31, 2**40, 10**12, 2**70]
    rows = names + [f"x&#{pad}{n};y&#x{n:X}z&#X{n:x}; &#{n}" for n in numbers for pad in ("", "000")]
    rows += ["", "no reference", "& ;&;&#;&#x;&#xg;", "&unknown;", "&notit;", "AT&T", "&amp;amp;", "a&lt", "&" * 5, "&" + "a" * 40 + ";", "&#12a;", "é&eacute;&nbsp;&hellip;"]
    df = spark.createDataFrame([(r,) for r in [*rows, None]], "t string").repartition(4)
    out = df.select("t", H.unescape(F.col("t")).alias("u"))
    assert "EvalPython" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.collect()
    assert [(r["t"], r["u"], html.unescape(r["t"])) for r in got if r["t"] is not None and r["u"] != html.unescape(r["t"])][:5] == []
    assert [r["u"] for r in got if r["t"] is None] == [None]


def test_speech_segments_split_their_text_once(spark):
    df = spark.createDataFrame([("a. b",)], "t string").select(F.explode(T.speech_segments(F.upper("t"))).alias("s"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("upper(") == 1
    assert [r["s"] for r in df.collect()] == ["A.", "B"]


def test_inert_texts_do_not_reach_the_composition(spark):
    got = []

    def compose(c):
        got.append(c)
        return c

    df = spark.createDataFrame([("أحمد été, Ñandú",), ("ﬁne",), ("é",)], "t string")
    T.normalize_for_match(F.col("t"), compose)
    assert [r[0] is None for r in df.select(got[0]).collect()] == [True, False, False]
    assert [r[0] for r in df.select(T.normalize_for_match(F.col("t"))).collect()] == ["احمد été, Ñandú", "fine", "é"]


def test_classes_for_java_are_those_of_the_sql(spark):
    marks, inert = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{m[1]:0>8}", T.MARKS)), re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{m[1]:0>8}", f"[{T.INERT}]"))
    every = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([("".join(every),)], "t string").select(F.explode(F.split("t", "")).alias("c"))
    got = df.groupBy(F.col("c").rlike(T.BLANK), F.col("c").rlike(T.MARK), F.col("c").rlike(T.UNSETTLED)).agg(F.sort_array(F.collect_list("c"))).collect()
    want = {}
    for c in every:
        want.setdefault((c in T.BLANKS, bool(marks.match(c)), not inert.match(c)), []).append(c)
    assert {tuple(r)[:3]: r[3] for r in got} == want


def test_composition_answers_in_small_batches():
    texts = pa.array(["ﬁ", None, "x"] * 100)
    got = list(T.nfkc.func(iter([texts, texts[:0]])))
    assert max(map(len, got)) == 64 and [x for a in got for x in a.to_pylist()] == ["fi", None, "x"] * 100


def test_cheaper_patterns_find_what_plain_ones_find(spark):
    random, ws = Random(5), f"[{re.escape(T.BLANKS)}]"
    texts = ["".join(random.choices("ab.!؟[]+- \n\t 　é", weights=[6, 6, 3, 1, 2, 3, 3, 1, 1, 8, 3, 1, 1, 1, 1], k=random.randint(0, 40))) for _ in range(3000)] + ["]", "a ]", "[- a", "[ ]"]

    def cleaned(t):
        lines = [x for x in (x.strip(T.BLANKS) for x in t.split("\n")) if not re.fullmatch(r"\[+-?|\]+", x)]
        return "\n".join(x for x in (re.sub(rf"{ws}*\]+\Z", "", re.sub(rf"\A\[+-?{ws}*", "", x), count=1) for x in lines) if x).strip(T.BLANKS)

    def sentences(t):
        return [x for line in t.split("\n") for x in re.split(rf"(?<=[.!؟]){ws}+", line.strip(T.BLANKS)) if x]

    x = F.col("t")
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.clean_text(x).alias("c"), T.sentences(x).alias("s"), T.count_words(T.strip(x)).alias("n"))
    got = out.collect()
    assert [r for r in got if (r["c"], r["s"], r["n"]) != (cleaned(r["t"]), sentences(r["t"]), len(re.split(ws + "+", r["t"].strip(T.BLANKS))))][:3] == []
