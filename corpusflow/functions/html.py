"""Text of HTML pages, by regular expressions over an ``html`` column."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import text as T

# Markers and labels of the scraped site.
PAGE_START, PAGE_END = "تحميل الصفحة السابقة", "تحميل الصفحة التالية"
CRUMBS_START = "مسار الصفحة الحالية"
CRUMBS_STOP = ["+ - التشكيل", "+- التشكيل", "التشكيل"]
CRUMBS_NOISE = ["فهرس الكتاب", "سير أعلام النبلاء - ط الرسالة", "سير أعلام النبلاء ط الرسالة", "بحــث", "بحث"]
SITE_SUFFIX = r"-{WS}*المكتبة الشاملة{WS}*\z"
TITLE_ENTRY = r"كتاب سير أعلام النبلاء (?:- )?ط الرسالة{WS}*-{WS}*(.+)\z"
SECTION_LABELS = ["الصحابة", "السابقون الأولون", "تابع: الطبقة الأولى - الصحابة", "ومن بقايا صغار الصحابة", "ومن صغار الصحابة", "كبار التابعين"]
NEXT_SECTION = "كبار التابعين"
LINE_END = r"\r\n|[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
NUMBERED = r"\A[0-9\x{660}-\x{669}]+{WS}*-{WS}*"


def _ws(pattern: str) -> str:
    return pattern.replace("{WS}", T.WS)


def _utf8(cp: Column) -> Column:
    """The character of a code point, from the bytes of its UTF-8."""
    tail = lambda shift: F.lit(0x80) + F.shiftright(cp, shift).bitwiseAND(0x3F)
    two = (F.lit(0xC0) + F.shiftright(cp, 6)) * 0x100 + tail(0)
    three = ((F.lit(0xE0) + F.shiftright(cp, 12)) * 0x100 + tail(6)) * 0x100 + tail(0)
    four = (((F.lit(0xF0) + F.shiftright(cp, 18)) * 0x100 + tail(12)) * 0x100 + tail(6)) * 0x100 + tail(0)
    value = F.when(cp < 0x80, cp).when(cp < 0x800, two).when(cp < 0x10000, three).otherwise(four)
    return F.unhex(F.lpad(F.hex(value), F.when(cp < 0x80, 2).when(cp < 0x800, 4).when(cp < 0x10000, 6).otherwise(8), F.lit("0"))).cast("string")


def _table(pairs: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")


def _numeric(s: Column) -> Column:
    """``#`` and digits, or ``#x`` and hexadecimal ones, as browsers read them."""
    digits = F.regexp_extract(s, "#[xX]?0*([0-9a-fA-F]*)", 1)
    digits = F.when(digits == "", "0").otherwise(digits)
    cp = F.when(F.length(digits) > 8, F.lit(0x7FFFFFFF)).when(s.rlike("^#[xX]"), F.conv(digits, 16, 10).cast("long")).otherwise(F.conv(digits, 10, 10).cast("long")).cast("long")
    # references to 0x80 to 0x9f mean the characters that Windows has there
    windows = {str(n): bytes([n]).decode("cp1252") if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(n) for n in range(0x80, 0xA0)}
    named = F.try_element_at(_table(windows | {"0": "\ufffd", "13": "\r"}), cp.cast("string"))
    none = cp.between(1, 8) | (cp == 11) | cp.between(14, 31) | cp.between(0x7F, 0x9F) | cp.between(0xFDD0, 0xFDEF) | (cp.bitwiseAND(0xFFFE) == 0xFFFE)
    return F.coalesce(named, F.when(cp.between(0xD800, 0xDFFF) | (cp > 0x10FFFF), "\ufffd").when(none, "").otherwise(_utf8(cp)))


def _named(s: Column) -> Column:
    """A name with its semicolon, or the longest that needs none at the beginning of ``s``."""
    short = {k: v for k, v in html5.items() if not k.endswith(";")}
    begins = [F.when(F.length(s) > k, F.concat(F.try_element_at(_table({n: v for n, v in short.items() if len(n) == k}), F.substring(s, 1, k)), F.substr(s, F.lit(k + 1)))) for k in sorted({len(n) for n in short}, reverse=True)]
    common = {k: html5[k] for k in ("amp;", "lt;", "gt;", "quot;", "nbsp;")}  # looked at first, as a map is read from its beginning
    return F.coalesce(F.try_element_at(_table(common), s), F.try_element_at(_table(html5), s), *begins, F.concat(F.lit("&"), s))


#: A character reference.
REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def unescape(c: Column) -> Column:
    """Character references decoded, named ones included: the parts between them, and each by itself."""
    decoded = F.transform(F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(1)), lambda s: F.when(s.startswith("#"), _numeric(s)).otherwise(_named(s)))
    joined = F.array_join(F.zip_with(F.split(c, REFERENCE), F.concat(decoded, F.array(F.lit(""))), lambda text, ref: F.concat(text, ref)), "")
    return F.when(c.contains("&"), joined).otherwise(c)


def strip_non_content(c: Column) -> Column:
    return F.regexp_replace(c, r"(?is)<(script|style|noscript|svg)\b.*?</\1\s*>", "")


def raw_lines(c: Column) -> Column:
    """Text nodes end to end, with line feeds for tags and comments; entities still escaped. A quoted value of a tag may hold ``>``."""
    return F.regexp_replace(strip_non_content(c), r"""(?s)<!--.*?-->|<[!/?a-zA-Z][^>=]*+(?:=\s*+(?:"[^"]*"|'[^']*')?+[^>=]*+)*+>""", "\n")


def html_lines(unescaped: Column) -> Column:
    """Non-empty cleaned lines of unescaped ``raw_lines``."""
    return F.filter(F.transform(F.split(unescaped, LINE_END), T.clean_line), lambda x: x != "")


def title_text(c: Column) -> Column:
    return F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title\s*>", 1)


def printed_meta(title: Column) -> Column:
    """``volume, page`` of a page title."""
    number = r"{WS}*([0-9\x{660}-\x{669}]+)"
    of = lambda letter: T.arabic_number_to_int(F.regexp_extract(title, _ws(letter + number), 1))
    return F.struct(of("ج").alias("volume"), of("ص").alias("page"))


def title_entry(title: Column) -> Column:
    bare = F.regexp_replace(T.clean_line(title), _ws(r"{WS}*" + SITE_SUFFIX), "")
    return F.nullif(T.clean_line(F.regexp_extract(bare, _ws(TITLE_ENTRY), 1)), F.lit(""))


def breadcrumb(lines: Column, legacy: bool = False) -> Column:
    """Lines after the first marker up to a stop; the tree's ``+`` and ``-`` buttons count as noise unless ``legacy``."""
    starts = F.transform(lines, lambda x: x.startswith(CRUMBS_START))
    after = F.slice(lines, F.coalesce(F.nullif(F.array_position(starts, True), F.lit(0)).cast("int"), F.size(lines)) + 1, F.greatest(F.size(lines), F.lit(1)))
    stops = F.transform(after, lambda x: x.isin(CRUMBS_STOP) | x.startswith(PAGE_START))
    until = F.coalesce(F.nullif(F.array_position(stops, True), F.lit(0)).cast("int") - 1, F.size(after))
    noise = CRUMBS_NOISE if legacy else [*CRUMBS_NOISE, "+", "-"]
    return F.filter(F.slice(after, 1, until), lambda x: ~x.isin(noise))


def entry_and_section(crumbs: Column, title: Column) -> Column:
    """``entry, section``: the last numbered crumb and the one before it, else the title unless that is a section's label."""
    clean = F.filter(crumbs, lambda x: (x != "") & ~x.startswith("الجزء "))
    last = F.try_element_at(clean, F.lit(-1))
    numbered = F.coalesce(last.rlike(_ws(NUMBERED)), F.lit(False))
    bare = lambda c: T.strip(F.regexp_replace(c, _ws(r"\A{WS}*" + NUMBERED.removeprefix(r"\A")), ""))
    from_crumb = F.nullif(F.when(numbered, bare(last)), F.lit(""))
    from_title = F.when(~T.normalize_for_match(title, compose=lambda c: c).isin([s.replace("أ", "ا") for s in SECTION_LABELS]), bare(title))
    return F.struct(F.coalesce(from_crumb, from_title).alias("entry"), F.when(numbered, F.try_element_at(clean, F.lit(-2))).otherwise(last).alias("section"))


def body_between(lines: Column, start: str = PAGE_START, end: str = PAGE_END) -> Column:
    """Lines strictly between the first ``start`` and the next ``end``, or null."""
    at = F.array_position(lines, start).cast("int")
    after = F.slice(lines, at + 1, F.greatest(F.size(lines), F.lit(1)))
    stop = F.array_position(after, end).cast("int")
    return F.when((at > 0) & (stop > 0), F.slice(after, 1, F.greatest(stop - 1, F.lit(0))))


def trim_at_section(lines: Column, label: str = NEXT_SECTION) -> Column:
    """``lines, trimmed``: cut before the first line that names the next section."""
    hits = F.transform(lines, lambda x: T.normalize_for_match(x, compose=lambda c: c).contains(label))
    at = F.array_position(hits, True).cast("int")
    return F.struct(F.when(at > 0, F.slice(lines, 1, F.greatest(at - 1, F.lit(0)))).otherwise(lines).alias("lines"), (at > 0).alias("trimmed"))


def crosses_boundary(section: Column, crumbs: Column, label: str = NEXT_SECTION) -> Column:
    """Whether section or breadcrumb already belong to the next section."""
    has = lambda c: F.coalesce(c.contains(label), F.lit(False))
    return has(section) | F.exists(crumbs, has)


def extract_pages(df: DataFrame, start: str = PAGE_START, end: str = PAGE_END, least: int = 20, arabic: bool = True) -> tuple[DataFrame, DataFrame]:
    """Pages (page_id, url, html) as text rows, and rejects (page_id, reason)."""
    # exploding a list of one keeps what follows from working out title and lines again wherever they are named
    read = F.struct(T.clean_line(unescape(title_text(F.col("html")))).alias("title"), html_lines(unescape(raw_lines(F.col("html")))).alias("lines"))
    opened = df.select(*[c for c in df.columns if c != "html"], F.explode(F.array(read)).alias("_read")).select("*", "_read.*").drop("_read")
    named = opened.withColumn("breadcrumb", breadcrumb(F.col("lines"))).withColumn("meta", printed_meta(F.col("title")))
    named = named.withColumn("named", entry_and_section(F.col("breadcrumb"), title_entry(F.col("title")))).withColumn("body", body_between(F.col("lines"), start, end))
    cut = named.withColumn("cut", trim_at_section(F.col("body"))).withColumn("text", T.strip(F.array_join("cut.lines", "\n")))
    short = (F.length("text") < least) | (~T.contains_arabic(F.col("text")) if arabic else F.lit(False))
    reason = F.when(F.col("body").isNull(), "no start or end marker").when(short, "text too short or not Arabic")
    judged = cut.withColumn("reason", reason)
    pages = judged.where("reason IS NULL").select(
        "page_id", "url", F.col("meta.volume").alias("printed_volume"), F.col("meta.page").alias("printed_page"), F.col("named.entry").alias("entry_name"),
        F.col("named.section").alias("source_section"), "breadcrumb", "text", T.content_hash(F.col("text")).alias("content_hash"), F.col("cut.trimmed").alias("next_section_trimmed"),
    )
    return pages, judged.where("reason IS NOT NULL").select("page_id", "reason")
