"""Scalar text functions as native column expressions.

White space means Unicode's, as Python's ``str.strip`` has it; neither Java's
``\\s`` nor SQL's ``trim`` do, so one explicit class is used everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from unicodedata import normalize

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Character classes, in a spelling that Java and RE2 both read.
WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
MARKS = r"[\x{610}-\x{61a}\x{64b}-\x{65f}\x{670}\x{6d6}-\x{6ed}]"
ARABIC = r"[\x{600}-\x{6ff}]"
ARABIC_DIGITS, ASCII_DIGITS = "٠١٢٣٤٥٦٧٨٩", "0123456789"
CLOSING_QUESTION = "ماذا تريد أن تعرف أيضاً عن هذه الشخصية العظيمة؟"
CLOSING_QUESTION_SPOKEN = "مَاذَا تُرِيدُ أَنْ تَعْرِفَ أَيْضاً عَنْ هَذِهِ الشَّخْصِيَّةِ الْعَظِيمَةِ؟"

STRIP = rf"\A{WS}+|{WS}+\z"


#: The characters of WS.
BLANKS = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# The same classes for Java alone: a class asks its ranges one by one, so what most characters are not in is asked first.
BLANK = rf"[\x{{9}}-\x{{20}}\x{{85}}\x{{a0}}\x{{1680}}-\x{{3000}}&&{WS}]"
#: A blank but a space, or a second one.
UNEVEN = rf"[\x{{9}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}-\x{{3000}}&&{WS}]|  "
MARK = rf"[\x{{610}}-\x{{6ed}}&&{MARKS}]"
#: Characters that NFKC leaves as they are in any company: it changes none of them, and none joins the one before.
INERT = r"\x{0}-\x{9f}\x{a1}-\x{a7}\x{a9}\x{ab}-\x{ae}\x{b0}\x{b1}\x{b6}\x{b7}\x{bb}\x{bf}-\x{131}\x{134}-\x{13e}\x{141}-\x{148}\x{14a}-\x{17e}\x{410}-\x{44f}\x{60c}\x{61b}\x{61f}-\x{64a}\x{660}-\x{66f}\x{671}-\x{674}\x{2010}\x{2012}-\x{2016}\x{2018}-\x{2023}"
UNSETTLED = rf"[\x{{a0}}-\x{{10ffff}}&&[^{INERT}]]"


def strip(c: Column) -> Column:
    """Only the ends are looked at; a pattern would try each blank of the text."""
    return F.btrim(c, F.lit(BLANKS))


def clean_text(c: Column) -> Column:
    """Drop bracket artefacts of scraped headings, line by line, and blank lines."""
    lines = F.transform(F.split(c, "\n"), strip)
    words = F.filter(lines, lambda x: ~((x.startswith("[") | x.startswith("]")) & x.rlike(r"\A(\[+-?|\]+)\z")))
    opened = F.transform(words, lambda x: F.when(x.startswith("["), F.regexp_replace(x, rf"\A\[+-?{BLANK}*", "")).otherwise(x))
    bare = F.transform(opened, lambda x: F.when(x.endswith("]"), F.regexp_replace(x, rf"{BLANK}*\]+\z", "")).otherwise(x))
    return F.array_join(F.filter(bare, lambda x: x != ""), "\n")  # no line has blanks at its ends


def clean_line(c: Column) -> Column:
    """Remove direction marks, collapse blanks, strip."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"[\x{200e}\x{200f}]", ""), r"[ \t\x{a0}]+", " "))


def clean_source_text(c: Column) -> Column:
    """Remove byte order marks, separator lines and blank runs."""
    out = F.regexp_replace(c, r"[\x{feff}\x{200b}]", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\r\n?", "\n"), r"(?m)^=====[^\n]*=====[ \t]*$", "")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return strip(out)


def count_words(c: Column) -> Column:
    """Words of a text without blanks at its ends. Single spaces are only counted, as a split compiles its pattern for each text."""
    return F.when(c.rlike(UNEVEN), F.size(F.split(c, BLANK + "+"))).otherwise(F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1)


def strip_diacritics(c: Column) -> Column:
    return F.regexp_replace(c, MARK, "")


@F.arrow_udf(StringType())
def nfkc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Unicode compatibility composition, which Spark has no function for; few texts at a time are Python strings, and each few are a batch of the answer, so only what came in is held whole."""
    for texts in batches:
        for at in range(0, len(texts), 64):
            yield pa.array([None if t is None else normalize("NFKC", t) for t in texts[at : at + 64].to_pylist()], pa.string())


def normalize_for_match(c: Column, compose=nfkc) -> Column:
    """Arabic spelling variants to one form. NFKC changes no text of inert characters, so such rows go to the UDF as null: neither their bytes nor their work reach Python."""
    bare = strip_diacritics(c)
    folded = F.translate(F.coalesce(compose(F.when(bare.rlike(UNSETTLED), bare)), bare), "أإآى", "اااي")
    return strip(F.regexp_replace(folded, BLANK + "+", " "))


def contains_arabic(c: Column) -> Column:
    return c.rlike(ARABIC)


def content_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def stable_character_id(name: Column, compose=nfkc) -> Column:
    return F.concat(F.lit("siyar_"), F.substring(content_hash(normalize_for_match(name, compose)), 1, 16))


def arabic_number_to_int(c: Column) -> Column:
    """The first run of digits, Arabic or ASCII, or null."""
    return F.regexp_extract(F.translate(c, ARABIC_DIGITS, ASCII_DIGITS), "[0-9]+", 0).try_cast("int")


def to_int_or_null(c: Column) -> Column:
    return F.when(strip(c).rlike(r"\A[+-]?[0-9]+\z"), strip(c)).try_cast("int")


def estimate_tokens(c: Column) -> Column:
    """0 for empty text, else a quarter of its UTF-8 bytes, rounded up."""
    return F.when(c.isNull() | (c == ""), F.lit(0)).otherwise(F.ceil(F.octet_length(c) / 4)).cast("int")


def strip_citation_markers(c: Column) -> Column:
    return strip(F.regexp_replace(c, WS + r"*[\[\x{ff3b}][0-9\x{660}-\x{669}]+[\]\x{ff3d}]", ""))


def strip_closing(role: Column, content: Column, closing: str = CLOSING_QUESTION) -> Column:
    """Assistant texts without the closing question that they were stored with."""
    suffix = "\n\n" + closing
    return F.when((role == "assistant") & content.endswith(suffix), F.left(content, F.length(content) - len(suffix))).otherwise(content)


def page_label(printed_page: Column, page_id: Column) -> Column:
    return F.coalesce(F.nullif(printed_page, F.lit("")), page_id.cast("string"))


def citation(book: Column, author: Column, label: Column, url: Column) -> Column:
    return F.concat(book, F.lit("، "), author, F.lit("، صفحة "), label, F.lit(" — "), url)


def safe_filename(c: Column, most: int = 72) -> Column:
    """A file name from a person's name."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r'[\\/:*?"<>|]+', "")
    kept = F.regexp_replace(bare, r"[^\p{L}\p{N}_\x{600}-\x{6ff} -]+", "")
    joined = F.regexp_replace(strip(kept), WS + "+", "_")
    cut = F.substring(F.regexp_replace(joined, r"\A[_.-]+|[_.-]+\z", ""), 1, most)
    return F.when(cut == "", "unknown_character").otherwise(cut)


def sentences(c: Column) -> Column:
    """Segments that end at a line feed or at white space after ``.``, ``!`` or ``؟``; a stripped line's segments have no white space at their ends."""
    # blanks are found first, as few characters are
    parts = F.flatten(F.transform(F.split(c, "\n"), lambda line: F.split(strip(line), rf"{BLANK}(?<=[.!؟]{BLANK}){BLANK}*")))
    return F.filter(parts, lambda x: x != "")


def speech_segments(c: Column, most: int = 300) -> Column:
    """Every terminated sentence whole; an unterminated tail is wrapped at blanks to ``most`` characters."""
    # one pass; a pattern for whole sentences would rescan the tail from each place. Parts and tail are bound, as each use would compute them again
    bound = lambda x, use: F.transform(F.array(x), use)[0]
    wrap = lambda tail: F.when(F.length(tail) <= most, F.array(tail)).otherwise(_wrapped(tail, most))
    every = bound(F.split(c, r"(?<=[.!؟\n])"), lambda parts: F.concat(F.slice(parts, 1, F.size(parts) - 1), bound(strip(F.element_at(parts, -1)), wrap)))
    return F.filter(F.transform(every, strip), lambda x: x != "")


def _wrapped(tail: Column, most: int) -> Column:
    # the tail's words fold into lines; a word longer than a line is cut hard
    pieces = F.flatten(F.transform(F.split(tail, " "), lambda w: F.when(F.length(w) <= most, F.array(w)).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.length(w) - 1) / most).cast("int")), lambda i: F.substring(w, i * most + 1, F.lit(most))))))
    # lines that are full, and the line that grows: the list is only copied when a line is full
    begin = F.struct(F.array().cast("array<string>").alias("full"), F.lit(None).cast("string").alias("line"))
    add = lambda acc, w: F.when(acc["line"].isNull(), F.struct(acc["full"].alias("full"), w.alias("line"))).when(
        F.length(acc["line"]) + 1 + F.length(w) <= most, F.struct(acc["full"].alias("full"), F.concat(acc["line"], F.lit(" "), w).alias("line"))
    ).otherwise(F.struct(F.concat(acc["full"], F.array(acc["line"])).alias("full"), w.alias("line")))
    return F.aggregate(pieces, begin, add, lambda acc: F.concat(acc["full"], F.array(acc["line"])))


def hash_rotation_index(key: Column, n: Column) -> Column:
    """The 256-bit sha256 of ``key`` modulo ``n``, folded digit by digit."""
    digits = F.transform(F.split(F.sha2(key.cast("binary"), 256), ""), lambda d: F.conv(d, 16, 10).cast("long"))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda acc, d: (acc * 16 + d) % n)


def dedupe_labels(c: Column) -> Column:
    """Trimmed labels without blanks, each at its first place."""
    return F.array_distinct(F.filter(F.transform(c, strip), lambda x: x != ""))


def normalize_categories(c: Column) -> Column:
    """Labels of a JSON list in a string; anything else has none."""
    return F.coalesce(F.filter(F.transform(F.from_json(c, "array<string>"), strip), lambda x: x != ""), F.array().cast("array<string>"))
