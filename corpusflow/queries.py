"""Queries over the given tables, one per operator or small group of them, with DuckDB SQL.

``documents`` stands in for pages (source: character, lang: collection),
``embeddings`` for chunks with vectors, ``conversations`` for message logs,
``nation`` for the roster.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import html as H
from corpusflow.functions import text as T
from corpusflow.operators import biographies as B
from corpusflow.operators import chunking as C
from corpusflow.operators import classification as K
from corpusflow.operators import conversations as V
from corpusflow.operators import embedding as E
from corpusflow.operators import merge as M
from corpusflow.operators import retrieval as R
from corpusflow.operators import roster as O
from corpusflow.plans import ingestion as I
from corpusflow.plans.session import read_table
from corpusflow.plans.staging import Staging
from corpusflow.sources import pages as P
from corpusflow.sources import sinks as S
from corpusflow.sources.snapshots import SnapshotStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '{T.STRIP}', '', 'g')"


# ---- text ----


def clean_sql(text: str) -> str:
    """SQL for T.clean_text."""
    lines = f"list_filter(list_transform(string_split({text}, chr(10)), lambda x: {_strip('x')}), lambda x: NOT regexp_matches(x, '^(\\[+-?|\\]+)$'))"
    bare = f"list_transform({lines}, lambda x: regexp_replace(regexp_replace(x, '^\\[+-?{T.WS}*', ''), '{T.WS}*\\]+$', ''))"
    return _strip(f"array_to_string(list_filter({bare}, lambda x: x <> ''), chr(10))")


_DIRTY = "'[[' || text || chr(10) || ']' || chr(10) || '[+ ' || lang || ' ]]'"


@query(f"SELECT doc_id, {clean_sql(_DIRTY)} AS cleaned FROM documents")
def clean_documents(spark, d):
    docs = read_table(spark, d, "documents")
    dirty = F.concat(F.lit("[["), F.col("text"), F.lit("\n]\n[+ "), F.col("lang"), F.lit(" ]]"))
    return docs.select("doc_id", T.clean_text(dirty).alias("cleaned"))


@query(f"""
WITH t AS (SELECT doc_id, chr(65279) || '===== page =====' || chr(13) || chr(10) || text || '  ' || chr(10) || chr(10) || chr(10) || chr(10) || 'end ' AS x FROM documents)
SELECT doc_id, {_strip(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '[\x{feff}\x{200b}]', '', 'g'), '\r\n?', chr(10), 'g'), '(?m)^=====[^\n]*=====[ \t]*$', '', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} AS cleaned FROM t
""")
def clean_source_text(spark, d):
    dirty = F.concat(F.lit("﻿===== page =====\r\n"), F.col("text"), F.lit("  \n\n\n\nend "))
    return read_table(spark, d, "documents").select("doc_id", T.clean_source_text(dirty).alias("cleaned"))


@query(f"SELECT doc_id, regexp_replace('مَاذَا ' || text || 'ٰ ۖ', '{T.MARKS}', '', 'g') AS bare, regexp_matches(text, '{T.ARABIC}') AS arabic FROM documents")
def strip_marks(spark, d):
    marked = F.concat(F.lit("مَاذَا "), F.col("text"), F.lit("ٰ ۖ"))
    return read_table(spark, d, "documents").select("doc_id", T.strip_diacritics(marked).alias("bare"), T.contains_arabic(F.col("text")).alias("arabic"))


@query("SELECT doc_id, TRY_CAST(nullif(regexp_extract(translate('ج ' || translate(CAST(n_chars AS VARCHAR), '0123456789', '٠١٢٣٤٥٦٧٨٩') || ' ص 7', '٠١٢٣٤٥٦٧٨٩', '0123456789'), '[0-9]+'), '') AS INTEGER) AS volume FROM documents")
def digits_to_int(spark, d):
    arabic = F.concat(F.lit("ج "), F.translate(F.col("n_chars").cast("string"), T.ASCII_DIGITS, T.ARABIC_DIGITS), F.lit(" ص 7"))
    return read_table(spark, d, "documents").select("doc_id", T.arabic_number_to_int(arabic).alias("volume"))


@query(f"""
WITH n AS (SELECT doc_id, {_strip(f"regexp_replace(translate(regexp_replace('  أَ ' || text, '{T.MARKS}', '', 'g'), 'أإآى', 'اااي'), '{T.WS}+', ' ', 'g')")} AS name FROM documents)
SELECT doc_id, name, 'siyar_' || substr(sha256(name), 1, 16) AS character_id FROM n
""")
def normalize_match_ids(spark, d):
    name = F.concat(F.lit("  أَ "), F.col("text"))
    return read_table(spark, d, "documents").select("doc_id", T.normalize_for_match(name).alias("name"), T.stable_character_id(name).alias("character_id"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def doc_hashes(spark, d):
    return read_table(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT doc_id, CAST(CASE WHEN text IS NULL OR text = '' THEN 0 ELSE ceil(strlen(text) / 4.0) END AS INTEGER) AS tokens FROM documents")
def token_estimates(spark, d):
    return read_table(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


def _sentences(text: str) -> str:
    """SQL for T.sentences; RE2 has no lookbehind, so a separator is put in first."""
    parts = f"flatten(list_transform(string_split({text}, chr(10)), lambda l: string_split(regexp_replace(l, '([.!؟]){T.WS}+', '\\1' || chr(1), 'g'), chr(1))))"
    return f"list_filter(list_transform({parts}, lambda x: {_strip('x')}), lambda x: x <> '')"


@query(f"SELECT doc_id, unnest(range(1, len(s) + 1)) - 1 AS segment, unnest(s) AS text FROM (SELECT doc_id, {_sentences('text')} AS s FROM documents)")
def sentence_segments(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("segment", "text"))
    return docs.withColumn("segment", F.col("segment").cast("long"))


_SPEECH = f"""
WITH src AS (SELECT doc_id, {_strip(r"regexp_replace(text || ' [1] ' || repeat(lang, 200), '" + T.WS + r"*[\[\x{ff3b}][0-9\x{660}-\x{669}]+[\]\x{ff3d}]', '', 'g')")} AS x FROM documents),
p AS (SELECT doc_id, string_split(regexp_replace(x, '([.!؟\n])', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM src),
t AS (SELECT doc_id, parts[1:len(parts) - 1] AS ended, {_strip("parts[len(parts)]")} AS tail FROM p),
w AS (SELECT doc_id, ended, tail, flatten(list_transform(string_split(tail, ' '), lambda y: CASE WHEN length(y) <= 300 THEN [y] ELSE list_transform(range(0, (length(y) - 1) // 300 + 1), lambda i: substr(y, i * 300 + 1, 300)) END)) AS ws FROM t),
n AS (SELECT doc_id, ws, list_transform(range(0, len(ws) + 1), lambda k: CAST(coalesce(list_sum(list_transform(ws[1:k], lambda y: length(y) + 1)), 0) AS BIGINT)) AS p FROM w WHERE length(tail) > 300),
wrapped AS (WITH RECURSIVE r AS (
  SELECT doc_id, 0 AS line, 1::BIGINT AS lo, coalesce(list_filter(range(2, len(ws) + 1), lambda j: p[j + 1] - 1 > 300)[1], len(ws) + 1) - 1 AS hi FROM n
  UNION ALL SELECT r.doc_id, line + 1, r.hi + 1, coalesce(list_filter(range(r.hi + 2, len(n.ws) + 1), lambda j: n.p[j + 1] - n.p[r.hi + 1] - 1 > 300)[1], len(n.ws) + 1) - 1 FROM r JOIN n ON n.doc_id = r.doc_id WHERE r.hi < len(n.ws)
) SELECT * FROM r),
lines AS (SELECT doc_id, list(array_to_string(ws[lo:hi], ' ') ORDER BY line) AS l FROM wrapped JOIN n USING (doc_id) GROUP BY doc_id),
s AS (SELECT doc_id, list_filter(list_transform(ended || coalesce(l, [tail]), lambda x: {_strip("x")}), lambda x: x <> '') AS s FROM t LEFT JOIN lines USING (doc_id))
SELECT doc_id, CAST(unnest(range(1, len(s) + 1)) - 1 AS INTEGER) AS segment, unnest(s) AS text FROM s
"""


@query(_SPEECH)
def speech_segments(spark, d):
    docs = read_table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(T.speech_segments(T.strip_citation_markers(F.concat("text", F.lit(" [1] "), F.repeat("lang", 200))))).alias("segment", "text"))


@query(f"""
WITH t AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'assistant' THEN text || chr(10) || chr(10) || {q(T.CLOSING_QUESTION)} ELSE text END || '' AS stored FROM conversations)
SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN text ELSE stored END AS content, {_strip("regexp_replace(text || ' [12] x［٣］', '" + T.WS + r"*[\[\x{ff3b}][0-9\x{660}-\x{669}]+[\]\x{ff3d}]', '', 'g')")} AS unmarked FROM t
""")
def closing_and_citations(spark, d):
    c = read_table(spark, d, "conversations")
    stored = F.when(F.col("role") == "assistant", F.concat("text", F.lit("\n\n" + T.CLOSING_QUESTION))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", T.strip_closing(F.col("role"), stored).alias("content"), T.strip_citation_markers(F.concat("text", F.lit(" [12] x［٣］"))).alias("unmarked"))


@query(f"""
SELECT doc_id, CASE WHEN c = '' THEN 'unknown_character' ELSE c END AS folder FROM (
  SELECT doc_id, substr(regexp_replace(regexp_replace({_strip(r"regexp_replace(regexp_replace(text || '/*?' || lang, '[\\/:*?" + chr(34) + r"<>|]+', '', 'g'), '[^\p{L}\p{N}_\x{600}-\x{6ff} -]+', '', 'g')")}, '{T.WS}+', '_', 'g'), '\\A[_.-]+|[_.-]+\\z', '', 'g'), 1, 72) AS c FROM documents)
""")
def safe_filenames(spark, d):
    return read_table(spark, d, "documents").select("doc_id", T.safe_filename(F.concat("text", F.lit("/*?"), "lang")).alias("folder"))


@query("SELECT doc_id, list_distinct_ordered AS labels FROM (SELECT doc_id, lang || '|' || source AS list_distinct_ordered FROM documents)")
def category_labels(spark, d):
    docs = read_table(spark, d, "documents")
    raw = F.to_json(F.array(F.concat(F.lit(" "), "lang"), "source", F.lit(" "), "lang"))
    return docs.select("doc_id", F.array_join(T.dedupe_labels(T.normalize_categories(raw)), "|").alias("labels"))


# ---- chunks ----

_MOST, _OVERLAP, _LEAST = 60, 10, 15


def chunk_sql(source: str, most: int, overlap: int, least: int, bytes4: bool = False) -> str:
    """CTEs that end in ``chunk (doc, chunk_index, chunk_text, token_count)`` of ``source`` (doc, text): a step is a chunk, found by sums of tokens."""
    w = f"list_filter(regexp_split_to_array(x, '{T.WS}+'), lambda y: y <> '')"
    quarter = lambda x: f"CAST(ceil(strlen({x}) / 4.0) AS BIGINT)"
    n = quarter("x") if bytes4 else f"len({w})"
    cut = f"list_transform(range(0, (length(x) - 1) // {most} + 1), lambda i: substr(x, i * {most} + 1, {most}))" if bytes4 else f"list_transform(range(1, len({w}) + 1, {most}), lambda i: array_to_string(({w})[i:i + {most - 1}], ' '))"
    both = quarter("t || ' ' || t2") if bytes4 else "n + n2"
    return f"""
seg AS (SELECT doc, flatten(list_transform({_sentences("text")}, lambda x: CASE WHEN {n} <= {most} THEN [x] ELSE {cut} END)) AS s FROM ({source})),
one AS (SELECT doc, unnest(s) AS x, unnest(range(1, len(s) + 1)) AS i FROM seg),
sums AS (SELECT doc, i, sum({n}) OVER (PARTITION BY doc ORDER BY i) AS p FROM one),
arr AS (SELECT seg.doc, s, p FROM seg JOIN (SELECT doc, [0] || list(CAST(p AS BIGINT) ORDER BY i) AS p FROM sums GROUP BY doc) USING (doc)),
-- of chunk k: its first segment lo, its last one hi, and the next segment at, 0 if there is none; p[j + 1] is the sum up to segment j
walk AS (
  SELECT doc, 0 AS k, 1::BIGINT AS lo, coalesce(list_filter(range(2, len(s) + 1), lambda j: p[j + 1] > {most})[1], len(s) + 1) - 1 AS hi FROM arr WHERE len(s) > 0
),
steps AS (WITH RECURSIVE r AS (
  SELECT * FROM walk
  UNION ALL
  SELECT doc, k + 1, lo, coalesce(list_filter(range(begins + 1, len(s) + 1), lambda j: p[j + 1] - p[lo] > {most})[1], len(s) + 1) - 1 FROM (
    SELECT r.doc, r.k, arr.s, arr.p, r.hi + 1 AS begins, least(r.hi, coalesce(list_filter(range(r.lo, r.hi + 1), lambda m: arr.p[r.hi + 1] - arr.p[m] <= {overlap})[1], r.hi)) AS lo
    FROM r JOIN arr ON arr.doc = r.doc WHERE r.hi < len(arr.s))
) SELECT * FROM r),
cut AS (SELECT doc, k, array_to_string(s[lo:hi], ' ') AS t, p[hi + 1] - p[lo] AS n, max(k) OVER (PARTITION BY doc) AS last FROM steps JOIN arr USING (doc)),
ended AS (SELECT *, last > 0 AND max(n) FILTER (WHERE k = last) OVER (PARTITION BY doc) < {least} AS short, lead(t) OVER (PARTITION BY doc ORDER BY k) AS t2, lead(n) OVER (PARTITION BY doc ORDER BY k) AS n2 FROM cut),
chunk AS (SELECT doc, CAST(k AS INTEGER) AS chunk_index, CASE WHEN short AND k = last - 1 THEN t || ' ' || t2 ELSE t END AS chunk_text, CAST(CASE WHEN short AND k = last - 1 THEN {both} ELSE n END AS INTEGER) AS token_count FROM ended WHERE NOT (short AND k = last))
"""


_CHUNKS = "WITH " + chunk_sql("SELECT doc_id AS doc, text FROM documents", _MOST, _OVERLAP, _LEAST)


def _chunks(spark, d):
    return C.chunk_text(read_table(spark, d, "documents").select("doc_id", "text"), most=_MOST, overlap=_OVERLAP, least=_LEAST)


@query(_CHUNKS + "SELECT doc AS doc_id, chunk_index, chunk_text, token_count FROM chunk")
def chunks(spark, d):
    return _chunks(spark, d)


@query(_CHUNKS + "SELECT doc AS doc_id, count(*) AS n_chunks, max(token_count) AS most_tokens, CAST(sum(token_count) AS BIGINT) AS tokens FROM chunk GROUP BY doc")
def chunk_overlap_stats(spark, d):
    return _chunks(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max("token_count").alias("most_tokens"), F.sum("token_count").alias("tokens"))


@query("WITH " + chunk_sql("SELECT doc_id AS doc, text FROM documents", 90, 20, 30, bytes4=True) + "SELECT doc AS doc_id, chunk_index, chunk_text, token_count FROM chunk")
def chunks_bytes4(spark, d):
    return C.chunk_text(read_table(spark, d, "documents").select("doc_id", "text"), most=90, overlap=20, least=30, counter=C.BYTES4)


@query()
def chunks_bpe(spark, d):
    """Chunks of the default size by a public vocabulary."""
    import public_tokenizers

    return C.chunk_text(read_table(spark, d, "documents").select("doc_id", "text"), counter=C.bpe(public_tokenizers.path("byte_bpe_50k.json")))


# ---- merge ----

_SOURCE = "SELECT 1 AS book_id, doc_id AS page_id, CASE WHEN doc_id % 7 = 0 THEN text || ' edited' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0"
_TARGET = "SELECT 1 AS book_id, doc_id AS page_id, text FROM documents WHERE doc_id % 5 <> 0"
_MERGED = f"""
SELECT coalesce(s.page_id, t.page_id) AS page_id, CASE WHEN t.page_id IS NULL THEN 'new' WHEN s.page_id IS NULL THEN 'kept' WHEN s.text <> t.text THEN 'updated' ELSE 'unchanged' END AS action,
       sha256(coalesce(s.text, t.text)) AS content_hash, coalesce(s.text, t.text) AS text
FROM ({_SOURCE}) s FULL JOIN ({_TARGET}) t ON s.page_id = t.page_id
"""


def _versions(spark, d):
    """The stored pages, and a later state of the source: some edited, some gone, some new."""
    docs = read_table(spark, d, "documents").select(F.lit(1).alias("book_id"), F.col("doc_id").alias("page_id"), "text")
    edited = docs.withColumn("text", F.when(F.col("page_id") % 7 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")))
    return M.content_hash(edited.where("page_id % 11 <> 0")), M.content_hash(docs.where("page_id % 5 <> 0"))


@query(f"SELECT page_id, action, content_hash FROM ({_MERGED})")
def merge_documents(spark, d):
    return M.merge_documents(*_versions(spark, d), ["book_id", "page_id"]).select("page_id", F.col("_action").alias("action"), "content_hash")


def _page_chunks(pages):
    cut = C.chunk_text(pages.select(M.document_id("book_id", "page_id").alias("document_id"), "text"), most=_MOST, overlap=_OVERLAP, least=_LEAST)
    return cut.withColumn("chunk_hash", T.content_hash(F.col("chunk_text")))


def _chunk_merge(spark, d):
    source, target = _versions(spark, d)
    merged = M.merge_documents(source, target, ["book_id", "page_id"])
    old = _page_chunks(target).withColumn("embedding", F.array(F.lit(1.0)))
    return merged, M.merge_chunks(_page_chunks(merged.where("_action IN ('new', 'updated')")), old)


_CHUNK_MERGE = f"""
WITH m AS MATERIALIZED ({_MERGED}),
{chunk_sql("SELECT 'n' || page_id AS doc, text FROM m WHERE action IN ('new', 'updated') UNION ALL SELECT 'o' || page_id, text FROM (" + _TARGET + ")", _MOST, _OVERLAP, _LEAST)},
n AS (SELECT substr(doc, 2) AS page, chunk_index, sha256(chunk_text) AS h FROM chunk WHERE doc[1] = 'n'), o AS (SELECT substr(doc, 2) AS page, chunk_index, sha256(chunk_text) AS h FROM chunk WHERE doc[1] = 'o'),
c AS (SELECT sha256('1|' || coalesce(n.page, o.page)) AS document_id, coalesce(n.chunk_index, o.chunk_index) AS chunk_index, coalesce(n.h, o.h) AS chunk_hash,
  CASE WHEN n.h IS NOT NULL AND o.h IS NULL THEN 'new' WHEN n.h <> o.h THEN 'updated' WHEN n.h = o.h THEN 'unchanged' WHEN o.page IN (SELECT page FROM n) THEN 'deleted' ELSE 'kept' END AS action
  FROM n FULL JOIN o ON n.page = o.page AND n.chunk_index = o.chunk_index)
"""


@query(_CHUNK_MERGE + "SELECT document_id, chunk_index, chunk_hash, action IN ('new', 'updated') AS to_embed, action FROM c")
def merge_chunks(spark, d):
    return _chunk_merge(spark, d)[1].select("document_id", "chunk_index", "chunk_hash", F.col("embedding").isNull().alias("to_embed"), F.col("_action").alias("action"))


@query(_CHUNK_MERGE + """
, a AS (SELECT doc_id FROM documents WHERE doc_id % 11 = 0), e AS (SELECT document_id, count(*) FILTER (WHERE action IN ('new', 'updated')) AS todo FROM c GROUP BY document_id),
u AS (SELECT 's' || (CAST(page_id AS BIGINT) % 20) AS who, page_id FROM m WHERE action = 'new'), f AS (SELECT who, bool_or(page_id % 13 = 0) AS failed FROM u GROUP BY who)
SELECT (SELECT count(*) FROM m WHERE action <> 'kept') AS pages_seen, (SELECT count(*) FROM a) AS pages_skipped, (SELECT count(*) FROM m WHERE action = 'new') AS pages_new, (SELECT count(*) FROM m WHERE action = 'updated') AS pages_updated,
  (SELECT count(*) FROM m WHERE action = 'unchanged') AS pages_unchanged, count(*) FILTER (WHERE action = 'new') AS chunks_new, count(*) FILTER (WHERE action = 'updated') AS chunks_updated, count(*) FILTER (WHERE action = 'unchanged') AS chunks_unchanged,
  count(*) FILTER (WHERE action = 'deleted') AS chunks_deleted, (SELECT CAST(sum(ceil(todo / 64.0)) AS BIGINT) FROM e) AS embedding_calls, count(*) FILTER (WHERE action IN ('new', 'updated')) AS embedded_chunks,
  (SELECT count(*) FROM f) AS characters_checked, (SELECT count(*) FROM f WHERE NOT failed) AS characters_added, (SELECT count(*) FROM f WHERE failed) AS characters_failed FROM c
""")
def ingest_stats(spark, d):
    merged, cut = _chunk_merge(spark, d)
    rejects = read_table(spark, d, "documents").where("doc_id % 11 = 0").select("doc_id")
    who = F.concat(F.lit("s"), (F.col("page_id") % 20).cast("string"))
    characters = merged.where("_action = 'new'").groupBy(who.alias("character_id")).agg(F.bool_or(F.col("page_id") % 13 == 0).alias("failed"))
    return M.ingestion_stats(merged, cut, rejects, characters)


@query("""
WITH t AS (SELECT doc_id, doc_id // 3 AS page_id, sha256(text) AS h, row_number() OVER w AS r, count(*) OVER (PARTITION BY doc_id // 3) AS n, lag(sha256(text)) OVER w AS p FROM documents WINDOW w AS (PARTITION BY doc_id // 3 ORDER BY doc_id))
SELECT page_id, max(doc_id) AS last_id, max(n) AS n_seen, CAST(sum(CASE WHEN r > 1 AND h <> p THEN 1 ELSE 0 END) AS BIGINT) AS n_changes FROM t GROUP BY page_id
""")
def dedupe_source_pages(spark, d):
    docs = M.content_hash(read_table(spark, d, "documents").withColumn("page_id", F.floor(F.col("doc_id") / 3)))
    return M.dedupe_source_pages(docs, ["page_id"], ["doc_id"]).select("page_id", F.col("doc_id").alias("last_id"), "n_seen", "n_changes")


def _stored(spark, d):
    docs = read_table(spark, d, "documents")
    return docs.select(M.document_id("doc_id").alias("document_id"), F.col("source").alias("caliph_id"), F.concat(F.lit("name of "), "source").alias("caliph_name"), F.col("doc_id").alias("page_id"), "text")


@query("""
SELECT source AS character_id, min(lang) AS dataset_dir, count(*) AS n_pages FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE source LIKE 'src1%') GROUP BY source
""")
def missing_characters(spark, d):
    source = read_table(spark, d, "documents").select(F.col("source").alias("character_id"), F.col("lang").alias("dataset_dir"))
    return M.missing_characters(source, _stored(spark, d).where("caliph_id LIKE 'src1%'"))


@query("SELECT sha256(CAST(doc_id AS VARCHAR)) AS document_id, source AS caliph_id, len(string_split(text, chr(10))) AS n_chunks FROM documents WHERE source <> 'src3'")
def delete_cascade(spark, d):
    stored = _stored(spark, d)
    lines = stored.select("document_id", F.explode(F.split("text", "\n")).alias("chunk"))
    docs, left = M.delete_character(stored, lines, "src3")
    return docs.join(left.groupBy("document_id").agg(F.count("*").alias("n_chunks")), "document_id").select("document_id", "caliph_id", "n_chunks")


@query("SELECT source AS caliph_id, count(*) AS n_documents, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n_chunks, 'name of ' || source AS caliph_name FROM documents GROUP BY source")
def delete_preview(spark, d):
    stored = _stored(spark, d)
    return M.delete_preview(stored, stored.select("document_id", F.explode(F.split("text", "\n")).alias("chunk")))


@query("SELECT DISTINCT source AS caliph_id FROM documents WHERE source LIKE 'src1%'")
def distinct_characters(spark, d):
    return O.distinct_characters(_stored(spark, d), "src1")


@query("SELECT doc_id AS page_id, CASE WHEN source IN ('src1', 'src2') THEN 'first' WHEN lang = 'fr' THEN 'french' ELSE 'none' END AS era FROM documents")
def era_lookup(spark, d):
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.col("source").alias("character_id"), F.col("lang").alias("collection"))
    return O.era_for_page(docs, {"src1": "first", "src2": "first"}, {"fr": "french"}, "none").select("page_id", "era")


@query("SELECT doc_id AS page_id, 'no character_id/character_name in source record' AS reason FROM documents WHERE doc_id % 9 = 0 OR lang = 'es'")
def identity_rejects(spark, d):
    docs = read_table(spark, d, "documents")
    named = docs.select(F.col("doc_id").alias("page_id"), F.when(F.col("doc_id") % 9 != 0, F.col("source")).alias("character_id"), F.when(F.col("lang") == "es", "").otherwise(F.col("lang")).alias("character_name"))
    return P.split_identity_rejects(named)[1]


@query("SELECT doc_id, 'text|url' AS missing FROM documents WHERE doc_id % 13 = 0")
def cached_record_rejects(spark, d):
    docs = read_table(spark, d, "documents")
    broken = docs.select("doc_id", F.col("doc_id").alias("page_id"), F.when(F.col("doc_id") % 13 != 0, F.col("text")).alias("text"), F.when(F.col("doc_id") % 13 != 0, F.lit("u")).alias("url"), F.lit("h").alias("content_hash"))
    return P.validate_cached_records(broken, ("text", "url", "page_id", "content_hash"))[1].select("doc_id", F.array_join("missing", "|").alias("missing"))


# ---- embeddings and retrieval ----


@query("""
SELECT doc_id, CAST(list_sum(list_transform(range(0, 48), lambda i: CAST('0x' || substr(h, 2 * (i % 32) + 1, 2) AS BIGINT) * (i + 1))) AS BIGINT) AS checksum
FROM (SELECT doc_id, sha256(text) AS h FROM documents)
""")
def fake_embeddings(spark, d):
    v = read_table(spark, d, "documents").select("doc_id", E.hash_embedding(F.col("text"), 48).alias("v"))
    total = F.aggregate(F.transform("v", lambda x, i: F.round(x * 255).cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return v.select("doc_id", total.alias("checksum"))


def _hits_sql(k: int, where: str = "TRUE", queries: str = "q.vec_id % 25 = 0") -> str:
    return f"""
  SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, s AS score FROM (
    SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS s,
           row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 12) DESC, c.vec_id) AS rank
    FROM embeddings q JOIN embeddings c ON {where} WHERE {queries}) WHERE rank <= {k}"""


def _vectors(spark, d):
    e = read_table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), "embedding", "label"), e.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


@query(f"SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM ({_hits_sql(5)})")
def retrieve_topk(spark, d):
    return R.retrieve(*_vectors(spark, d)).withColumn("score", F.round("score", 6))


@query(f"SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM ({_hits_sql(5, 'q.label = c.label')})")
def retrieve_filtered(spark, d):
    return R.retrieve(*_vectors(spark, d), filters="label").withColumn("score", F.round("score", 6))


_F_CHARACTER, _F_ERA, _F_BOOK = "'c' || (vec_id % 6)", "'e' || label", "'b' || (vec_id % 4)"


@query(f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, {_F_CHARACTER} AS ch, {_F_ERA} AS er, {_F_BOOK} AS bk FROM embeddings),
a AS (SELECT vec_id, v, CASE WHEN vec_id // 25 % 2 = 0 THEN ch END AS ch, CASE WHEN vec_id // 50 % 2 = 0 THEN er END AS er, CASE WHEN vec_id // 100 % 2 = 0 THEN bk END AS bk FROM e WHERE vec_id % 25 = 0),
h AS (SELECT a.vec_id AS query_id, e.vec_id AS chunk_id, list_cosine_similarity(a.v, e.v) AS s FROM a JOIN e ON (a.ch IS NULL OR a.ch = e.ch) AND (a.er IS NULL OR a.er = e.er) AND (a.bk IS NULL OR a.bk = e.bk)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, chunk_id) AS INTEGER) AS rank FROM h)
SELECT query_id, rank, 'chunk-' || chunk_id AS chunk_id, round(s, 6) AS score FROM r WHERE rank <= 5
""")
def retrieve_by_filters(spark, d):
    """Questions that restrict character, era and book, each or not, over chunks with ids that are strings."""
    e = read_table(spark, d, "embeddings")
    named = e.select("vec_id", "embedding", F.concat(F.lit("c"), F.col("vec_id") % 6).alias("character"), F.concat(F.lit("e"), "label").alias("era"), F.concat(F.lit("b"), F.col("vec_id") % 4).alias("book"))
    some = lambda c, n: F.when(F.floor(F.col("vec_id") / n) % 2 == 0, F.col(c)).alias(c)
    asks = named.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "embedding", some("character", 25), some("era", 50), some("book", 100))
    # padded, so that ids sort as their numbers do
    chunks = named.select(F.concat(F.lit("chunk-"), F.lpad("vec_id", 12, "0")).alias("chunk_id"), "embedding", "character", "era", "book")
    hits = R.retrieve(chunks, asks, filters=("character", "era", "book"))
    return hits.select("query_id", "rank", F.concat(F.lit("chunk-"), F.substring("chunk_id", 7, 12).cast("long")).alias("chunk_id"), F.round("score", 6).alias("score"))


@query()
def centroid_recall(spark, d):
    """Of each question's five best chunks but itself, by the exact search, how many the lists of its nearest centroids hold, and the share of chunks that was read."""
    c, asks = _vectors(spark, d)
    staging = Staging(spark)
    index = R.build_lists(c, f"{staging.root}/lists")
    others = lambda hits: hits.where("query_id <> chunk_id").select("query_id", "chunk_id")
    exact = others(R.retrieve(c, asks, 6))
    found = others(R.search_lists(index, asks, 6)).withColumn("hit", F.lit(1))
    rows = exact.join(found, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))
    sizes = index.assigned.groupBy("list").count()
    read = R.probed_lists(index, asks).join(sizes, "list", "left").groupBy("query_id").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows_read"))
    return rows.join(read, "query_id").crossJoin(c.agg(F.count("*").alias("n"))).select("query_id", "wanted", "found", F.round(F.col("rows_read") / F.col("n"), 4).alias("read"))


def _chunk_meta(spark, d):
    e = read_table(spark, d, "embeddings")
    return e.select(
        F.col("vec_id").alias("chunk_id"), F.concat(F.lit("chunk "), "vec_id").alias("text"), F.concat(F.lit("c"), "label").alias("character"), F.concat(F.lit("name "), "label").alias("character_name"),
        F.concat(F.lit("book "), "label").alias("book_title"), F.lit("author").alias("author"), F.col("vec_id").alias("page_id"), F.when(F.col("vec_id") % 3 == 0, F.lit("")).when(F.col("vec_id") % 3 == 1, F.concat(F.lit("p"), "vec_id")).alias("printed_page"),
        F.concat(F.lit("https://x/"), "vec_id").alias("source_url"),
    )


_LABEL = "CASE WHEN c.vec_id % 3 = 1 THEN 'p' || c.vec_id ELSE CAST(c.vec_id AS VARCHAR) END"


@query(f"SELECT h.query_id, h.rank, 'book ' || c.label || '، author، صفحة ' || {_LABEL} || ' — https://x/' || c.vec_id AS citation FROM ({_hits_sql(5)}) h JOIN embeddings c ON c.vec_id = h.chunk_id")
def citations(spark, d):
    return R.with_citations(R.retrieve(*_vectors(spark, d)), _chunk_meta(spark, d)).select("query_id", "rank", "citation")


@query(f"""
SELECT query_id, string_agg('[' || h.rank || '] الكتاب: book ' || c.label || ' | المؤلف: author | الشخصية: name ' || c.label || ' | الصفحة: ' || {_LABEL} || ' | الرابط: https://x/' || c.vec_id || chr(10) || 'chunk ' || c.vec_id, chr(10) || chr(10) ORDER BY h.rank) AS context,
       count(*) AS n_citations, string_agg(h.rank || ':book ' || c.label || ':author:c' || c.label || ':' || {_LABEL} || ':https://x/' || c.vec_id || ':' || CAST(round(h.score * 1000) AS BIGINT), '|' ORDER BY h.rank) AS cited FROM ({_hits_sql(5)}) h JOIN embeddings c ON c.vec_id = h.chunk_id GROUP BY query_id
""")
def build_citations(spark, d):
    hits = R.with_citations(R.retrieve(*_vectors(spark, d)), _chunk_meta(spark, d))
    line = lambda c: F.concat_ws(":", c["index"], c["book_title"], c["author"], c["character"], c["page"], c["source_url"], F.round(c["score"] * 1000).cast("long"))
    return R.format_context(hits).select("query_id", "context", F.size("citations").cast("long").alias("n_citations"), F.array_join(F.transform("citations", line), "|").alias("cited"))


@query(f"SELECT query_id, round(max(score), 6) AS top_score, max(score) >= 0.35 AS grounded FROM ({_hits_sql(5, 'q.vec_id <> c.vec_id')}) GROUP BY query_id")
def grounding_gate(spark, d):
    c, asks = _vectors(spark, d)
    hits = R.retrieve(c, asks, 6)  # one more, for the query's own row
    return R.grounding(hits.where("query_id <> chunk_id"), 0.35).withColumn("top_score", F.round("top_score", 6))


def _ranked_sql(vector: str, table: str) -> str:
    """Best five of all chunks for each ``query_id`` of a table with a vector."""
    cos = f"list_cosine_similarity({vector}, CAST(c.embedding AS DOUBLE[]))"
    return f"SELECT * FROM (SELECT q.query_id, c.vec_id AS chunk_id, {cos} AS score, CAST(row_number() OVER (PARTITION BY q.query_id ORDER BY round({cos}, 12) DESC, c.vec_id) AS INTEGER) AS rank FROM {table} q CROSS JOIN embeddings c) WHERE rank <= 5"


@query(f"""
WITH a AS (SELECT vec_id AS query_id, CAST(CASE WHEN vec_id % 2 = 0 THEN list_reverse(embedding) ELSE embedding END AS DOUBLE[]) AS v, list_transform(embedding, lambda x: CAST(x + 0.01::FLOAT AS DOUBLE)) AS w FROM embeddings WHERE vec_id % 25 = 0),
h AS ({_ranked_sql("q.v", "a")}), g AS (SELECT query_id, max(score) >= 0.6 AS grounded FROM h GROUP BY query_id),
b AS (SELECT * FROM a WHERE query_id NOT IN (SELECT query_id FROM g WHERE grounded)), s AS ({_ranked_sql("q.w", "b")}),
cleared AS (SELECT query_id FROM s GROUP BY query_id HAVING max(score) >= 0.6)
SELECT query_id, rank, chunk_id, round(score, 6) AS score, FALSE AS retried FROM h WHERE query_id NOT IN (SELECT query_id FROM cleared)
UNION ALL SELECT query_id, rank, chunk_id, round(score, 6), TRUE FROM s WHERE query_id IN (SELECT query_id FROM cleared)
""")
def retry_rewrite(spark, d):
    c, asks = _vectors(spark, d)
    badly = asks.withColumn("embedding", F.when(F.col("query_id") % 2 == 0, F.reverse("embedding")).otherwise(F.col("embedding")))  # these find nothing close
    again = asks.select("query_id", F.lit("rewritten").alias("rewritten"), F.transform("embedding", lambda x: x + F.lit(0.01).cast("float")).alias("embedding"))
    return R.retry_with_rewrite(R.retrieve(c, badly), again, c, least=0.6).withColumn("score", F.round("score", 6))


@query()
def lsh_recall(spark, d):
    """Of questions that are chunks moved by a third of another chunk: whether the near one is found, and the share of chunks that was compared."""
    c, asks = _vectors(spark, d)
    other = c.select((F.col("chunk_id") - 1).alias("query_id"), F.col("embedding").alias("noise"))
    asks = asks.join(other, "query_id").select("query_id", F.zip_with("embedding", "noise", lambda x, y: x + y / 3).alias("embedding"))
    near = R.lsh_candidates(c, asks).groupBy("query_id").agg(F.count("*").alias("compared"), F.max((F.col("chunk_id") == F.col("query_id")).cast("int")).alias("found"))
    all_ = c.agg(F.count("*").alias("n"))
    return asks.select("query_id").join(near, "query_id", "left").crossJoin(all_).select("query_id", F.coalesce("found", F.lit(0)).alias("found"), F.round(F.coalesce("compared", F.lit(0)) / F.col("n"), 4).alias("compared"))  # one row of a count


# ---- conversations ----


def _log(spark, d):
    return read_table(spark, d, "conversations").select(F.col("conv_id").alias("conversation_id"), "turn", "role", F.col("text").alias("content"))


_HIST = "SELECT a.conv_id, a.turn, a.role, a.text, b.turn AS bt, b.role AS br, b.text AS bx FROM (SELECT *, row_number() OVER w AS k FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) a LEFT JOIN (SELECT *, row_number() OVER w AS k FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) b ON a.conv_id = b.conv_id AND b.k BETWEEN a.k - 8 AND a.k - 1"


@query(f"SELECT conv_id AS conversation_id, turn, coalesce(string_agg(br || ':' || bx, '|' ORDER BY bt), '') AS history FROM ({_HIST}) GROUP BY conv_id, turn")
def history_window(spark, d):
    lines = F.transform("history", lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return V.history_window(_log(spark, d)).select("conversation_id", "turn", F.array_join(lines, "|").alias("history"))


@query(f"""
SELECT conv_id AS conversation_id, turn, NOT coalesce(bool_or(br = 'assistant'), FALSE) AS first_message, coalesce(arg_max(bx, bt) FILTER (WHERE br = 'user') || chr(10), '') || any_value(text) AS query
FROM ({_HIST}) WHERE role = 'user' GROUP BY conv_id, turn
""")
def retrieval_query(spark, d):
    h = V.history_window(_log(spark, d)).where("role = 'user'")
    return h.select("conversation_id", "turn", V.is_first_message(F.col("history")).alias("first_message"), V.retrieval_query(F.col("history"), F.col("content")).alias("query"))


@query("""
SELECT a.conv_id AS conversation_id, a.turn, string_agg(DISTINCT b.text, '|' ORDER BY b.text) AS asked FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn <= a.turn AND b.role = 'user' WHERE a.role = 'user' GROUP BY a.conv_id, a.turn
""")
def already_asked(spark, d):
    return V.already_asked(_log(spark, d)).withColumn("asked", F.array_join("asked", "|"))


_FIRST_RULE, _SYSTEM = "أجب بإيجاز.", "راوٍ لسيرة "


@query(f"""
SELECT conv_id AS conversation_id, turn, count(bt) + 2 AS n_messages, {q(_SYSTEM)} || 'conv ' || conv_id || CASE WHEN coalesce(bool_or(br = 'assistant'), FALSE) THEN '' ELSE chr(10) || {q(_FIRST_RULE)} END AS system_text,
       {q(V.QUESTION)} || any_value(text) || {q(V.SOURCES.replace(chr(10), chr(7)))} || {q(V.NO_SOURCES)} || {q(V.ANSWER_RULE.replace(chr(10), chr(7)))} AS user_text FROM ({_HIST}) WHERE role = 'user' GROUP BY conv_id, turn
""".replace(chr(7), "' || chr(10) || '"))
def chat_messages(spark, d):
    h = V.history_window(_log(spark, d)).where("role = 'user'").withColumn("context", F.lit(""))
    m = V.chat_messages(h, F.concat(F.lit(_SYSTEM), F.lit("conv "), F.col("conversation_id")), _FIRST_RULE)
    return m.select("conversation_id", "turn", F.size("messages").cast("long").alias("n_messages"), F.col("messages")[0]["content"].alias("system_text"), F.try_element_at("messages", F.lit(-1))["content"].alias("user_text"))


def _lit(x: str) -> str:
    return q(x).replace("\n", "' || chr(10) || '")


@query(f"""
WITH h AS ({_HIST}), l AS (SELECT conv_id, turn, any_value(text) AS text, list(CASE WHEN br = 'user' THEN {q(V.USER)} ELSE {q(V.NARRATOR)} END || ': ' || bx ORDER BY bt) FILTER (WHERE bt IS NOT NULL) AS lines FROM h WHERE role = 'user' GROUP BY conv_id, turn)
SELECT conv_id AS conversation_id, turn, {q(V.CHARACTER)} || 'conv ' || conv_id || {_lit(V.CONTEXT)} || CASE WHEN lines IS NULL THEN {q(V.NO_CONTEXT)} ELSE array_to_string(lines[-4:], chr(10)) END || {_lit(V.CURRENT)} || text || {_lit(V.REWRITE)} AS rewrite FROM l
""")
def rewrite_prompt(spark, d):
    h = V.history_window(_log(spark, d)).where("role = 'user'")
    return V.rewrite_prompt(h, F.concat(F.lit("conv "), F.col("conversation_id"))).select("conversation_id", "turn", "rewrite")


@query(f"""
WITH a AS (SELECT a.conv_id, a.turn, list(DISTINCT b.text ORDER BY b.text) AS asked FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn <= a.turn AND b.role = 'user' WHERE a.role = 'user' GROUP BY a.conv_id, a.turn)
SELECT conv_id AS conversation_id, turn, CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 2 END AS slots,
  {q(V.CHARACTER)} || 'conv ' || conv_id || {_lit(V.AUDIENCE)} || CASE WHEN conv_id % 2 = 0 THEN {q(V.CHILD)} ELSE {q(V.ADULT)} END || {_lit(chr(10) + chr(10) + V.QUESTION)} || text || {_lit(V.ANSWER)} || 'the answer'
  || {_lit(V.USED_SOURCES)} || CASE WHEN turn = 0 THEN {q(V.NO_USED_SOURCES)} ELSE 'ctx' END || {_lit(V.ASKED)} || array_to_string(list_transform(asked, lambda x: '- ' || x), chr(10)) || {_lit(V.SUGGEST)} AS prompt
FROM conversations JOIN a USING (conv_id, turn) WHERE role = 'user'
""")
def suggestions_prompt(spark, d):
    log = _log(spark, d)
    turns = log.where("role = 'user'").join(V.already_asked(log), ["conversation_id", "turn"])
    mode = F.when(F.col("conversation_id") % 2 == 0, "kids").otherwise("adults")
    turns = turns.withColumn("mode", mode).withColumn("answer", F.lit("the answer")).withColumn("context", F.when(F.col("turn") == 0, "").otherwise("ctx"))
    turns = turns.withColumn("predefined", V.predefined_suggestions(F.col("mode"), F.array().cast("array<string>")))
    return V.suggestions_prompt(turns, F.concat(F.lit("conv "), F.col("conversation_id"))).select("conversation_id", "turn", "slots", "prompt")


@query(f"""
WITH a AS (SELECT conv_id, list(DISTINCT text) AS asked FROM conversations WHERE role = 'user' GROUP BY conv_id),
t AS (SELECT c.conv_id, c.turn, c.text, coalesce(a.asked, []) AS asked FROM conversations c LEFT JOIN a USING (conv_id) WHERE role = 'assistant'),
p AS (SELECT *, CASE WHEN conv_id % 2 = 0 THEN [{", ".join(map(q, V.KIDS_QUESTIONS))}] WHEN conv_id % 3 = 0 THEN [{q(V.ADULTS_QUESTION)}, {q(V.ROLE_QUESTIONS["فقيه"])}] ELSE [{q(V.ADULTS_QUESTION)}] END AS own FROM t)
SELECT conv_id AS conversation_id, turn, array_to_string((own || ['more', text, 'last'])[1:3], '|') AS suggestions FROM p
""")
def suggestions(spark, d):
    log = _log(spark, d)
    asked = log.where("role = 'user'").groupBy("conversation_id").agg(F.collect_set("content").alias("asked"))
    turns = log.where("role = 'assistant'").join(asked, "conversation_id", "left").withColumn("asked", F.coalesce("asked", F.array().cast("array<string>")))
    mode = F.when(F.col("conversation_id") % 2 == 0, "kids").otherwise("adults")
    roles = F.when(F.col("conversation_id") % 3 == 0, F.array(F.lit("تاجر"), F.lit("فقيه"))).otherwise(F.array().cast("array<string>"))
    own = V.predefined_suggestions(mode, roles)
    out = V.combine_suggestions(own, F.array(F.lit(" more "), F.col("content"), F.lit(""), F.lit("last")), F.col("asked"))
    return turns.select("conversation_id", "turn", F.array_join(out, "|").alias("suggestions"))


@query(f"""
SELECT conv_id AS generation_id, string_agg(text, '' ORDER BY turn) || chr(10) || chr(10) || {q(T.CLOSING_QUESTION)} AS content, string_agg(text, '' ORDER BY turn) || chr(10) || chr(10) || {q(T.CLOSING_QUESTION_SPOKEN)} AS spoken,
  CASE WHEN conv_id % 3 = 0 THEN 'more|' || conv_id END AS suggestions FROM conversations GROUP BY conv_id
""")
def finalize_answer(spark, d):
    pieces = _log(spark, d).select(F.col("conversation_id").alias("generation_id"), F.col("turn").alias("seq"), F.col("content").alias("piece"))
    ids = pieces.select("generation_id").distinct()
    more = ids.select("generation_id", F.when(F.col("generation_id") % 3 == 0, F.array(F.lit("more"), F.col("generation_id").cast("string"))).otherwise(F.array().cast("array<string>")).alias("suggestions"))
    extra = F.from_json("extra", "diacritized_content string, suggestions array<string>")
    return V.finalize_answer(pieces, more).select("generation_id", "content", extra["diacritized_content"].alias("spoken"), F.array_join(extra["suggestions"], "|").alias("suggestions"))


@query("SELECT conv_id AS conversation_id, count(*) AS n_messages, sha256(string_agg(turn || ':' || role || ':' || text, ',' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def export_conversation(spark, d):
    e = V.export_conversation(_log(spark, d))
    return e.select("conversation_id", "n_messages", T.content_hash(F.array_join(F.transform("messages", lambda m: F.concat(m["turn"], F.lit(":"), m["role"], F.lit(":"), m["content"])), ",")).alias("digest"))


@query("SELECT conv_id AS conversation_id, greatest(timestamp '2024-01-01', timestamp '2024-01-01' + to_hours(max(turn))) AS updated_at FROM conversations GROUP BY conv_id")
def touch_conversations(spark, d):
    log = _log(spark, d).withColumn("created_at", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(turn as int))"))
    conversations = log.select("conversation_id").distinct().withColumn("updated_at", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    return V.append_messages(conversations, log.limit(0), log)[0]


@query("""
SELECT conv_id AS conversation_id, turn, CASE WHEN conv_id % 5 = 0 THEN 'conversation not found' WHEN conv_id % 7 = 0 THEN 'character mismatch' WHEN conv_id % 10 = 3 THEN 'character not found' END AS reject_reason FROM conversations WHERE role = 'user'
""")
def resolve_conversation(spark, d):
    log = _log(spark, d)
    ids = F.col("conversation_id")
    slug = F.concat(F.lit("c"), (ids % 10).cast("string"))
    known = log.select("conversation_id").distinct().where(ids % 5 != 0).select("conversation_id", slug.alias("character_slug"), F.lit("kids").alias("mode"))
    characters = log.select((ids % 10).alias("n")).distinct().select(F.concat(F.lit("c"), "n").alias("slug"), (F.col("n") != 3).alias("is_active"), F.lit("x").alias("name_ar"))
    asked = log.where("role = 'user'").withColumn("character_slug", F.when(ids % 7 == 0, F.lit("other")).otherwise(slug)).withColumn("mode", F.lit(None).cast("string"))
    return V.resolve_conversation(asked, known, characters).select("conversation_id", "turn", "reject_reason")


@query("""
WITH t AS (SELECT conv_id, turn, role, regexp_replace(text, ' \\[1\\]', '') AS s FROM conversations)
SELECT conv_id AS conversation_id, turn, CASE WHEN role <> 'assistant' THEN 'not an assistant message' WHEN s = '' THEN 'empty' WHEN length(s) > 400 THEN 'too long' END AS reject_reason,
       CASE WHEN role = 'assistant' AND length(s) BETWEEN 1 AND 400 THEN s END AS speech FROM t
""")
def speech_text(spark, d):
    log = _log(spark, d).withColumn("extra", F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.concat("content", F.lit(" [1]")).alias("diacritized_content")))))
    return V.message_speech_text(log, 400).select("conversation_id", "turn", "reject_reason", "speech")


@query("SELECT conv_id AS conversation_id, turn, CASE WHEN length(text) > 300 THEN 'too long' END AS reason FROM conversations WHERE role = 'user'")
def message_limits(spark, d):
    return _log(spark, d).where("role = 'user'").select("conversation_id", "turn", V.validate_message(F.col("content"), 300).alias("reason"))


# ---- biographies ----


def _pages(spark, d):
    docs = read_table(spark, d, "documents")
    has = F.col("doc_id") % 3 != 1
    return docs.select(
        F.concat("lang", F.lit("-"), F.floor(F.col("doc_id") / 200)).alias("book_id"), F.col("doc_id").alias("page_id"), F.when(has, F.concat(F.lit("p"), (F.floor(F.col("doc_id") / 20) % 4).cast("string"))).alias("character_id"),
        F.when(has & (F.col("doc_id") % 2 == 0), F.concat(F.lit("name "), "source")).alias("character_name"), F.when(has, F.concat(F.lit("entry "), "source")).alias("entry_name"),
        F.when(F.col("doc_id") % 5 != 0, F.col("doc_id").cast("string")).alias("printed_page"), F.lit(1).alias("printed_volume"), F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("u"), "doc_id")).alias("url"), "text",
    )


_RESOLVED = """
WITH p AS (SELECT lang || '-' || (doc_id // 200) AS book_id, doc_id AS page_id, CASE WHEN doc_id % 3 <> 1 THEN 'p' || ((doc_id // 20) % 4) END AS own,
                  CASE WHEN doc_id % 3 <> 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'name ' || source ELSE 'entry ' || source END END AS name, text,
                  CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id AS VARCHAR) END AS printed_page, CASE WHEN doc_id % 4 <> 0 THEN 'u' || doc_id END AS url FROM documents),
n AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
             first_value(own IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY page_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a,
             last_value(name IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bn FROM p),
r AS (SELECT *, CASE WHEN own IS NOT NULL THEN 'source' WHEN a = b THEN 'inferred' ELSE 'unassigned' END AS assignment, coalesce(own, CASE WHEN a = b THEN b END) AS id, coalesce(name, CASE WHEN a = b THEN bn END) AS who FROM n),
s AS (SELECT *, CASE WHEN id IS NOT NULL AND id IS DISTINCT FROM lag(id) OVER (PARTITION BY book_id ORDER BY page_id) THEN 1 ELSE 0 END AS st FROM r),
i AS (SELECT *, CASE WHEN id IS NOT NULL THEN sum(st) OVER (PARTITION BY book_id ORDER BY page_id) END AS island FROM s)
"""


def _islands(spark, d):
    return B.split_contiguous(B.resolve_character_context(_pages(spark, d)))


@query(_RESOLVED + "SELECT book_id, page_id, assignment, id AS resolved_id, who AS resolved_name, CAST(coalesce(island, 0) AS BIGINT) AS island FROM i")
def islands(spark, d):
    return _islands(spark, d).select("book_id", "page_id", "assignment", "resolved_id", "resolved_name", F.coalesce("island", F.lit(0)).alias("island"))


_BIO_TEXT = f"array_to_string(list_filter(list({_strip('text')} ORDER BY page_id), lambda x: x <> ''), chr(10) || chr(10))"


@query(_RESOLVED + f"""
SELECT book_id, CAST(island AS BIGINT) AS sequence, id || '_' || min(page_id) AS biography_id, arg_min(who, page_id) AS character_name, count(*) AS n_pages, arg_min(printed_page, page_id) FILTER (WHERE printed_page IS NOT NULL) AS printed_page_start,
       arg_max(printed_page, page_id) FILTER (WHERE printed_page IS NOT NULL) AS printed_page_end, coalesce(string_agg(url, ',' ORDER BY page_id), '') AS urls, sha256({_BIO_TEXT}) AS content_hash
FROM i WHERE island IS NOT NULL GROUP BY book_id, island, id
""")
def biographies(spark, d):
    b = B.aggregate_biographies(_islands(spark, d))
    return b.select("book_id", "sequence", "biography_id", "character_name", F.size("page_ids").cast("long").alias("n_pages"), "printed_page_start", "printed_page_end", F.array_join("urls", ",").alias("urls"), "content_hash")


@query(_RESOLVED + "SELECT count(*) AS n_pages, count(*) FILTER (WHERE assignment = 'source') AS n_source, count(*) FILTER (WHERE assignment = 'inferred') AS n_inferred, count(*) FILTER (WHERE assignment = 'unassigned') AS n_unassigned, count(DISTINCT id) AS n_characters, min(page_id) AS first_page_id, max(page_id) AS last_page_id FROM i")
def manifest(spark, d):
    return B.manifest(_islands(spark, d))


@query("SELECT 'entry ' || source AS entry_name, count(*) AS n_pages, min(doc_id) AS first_page_id FROM documents WHERE doc_id % 3 <> 1 GROUP BY source")
def entry_counts(spark, d):
    return B.entry_counts(_pages(spark, d))


@query("SELECT source AS source_section, count(*) AS n_pages FROM documents WHERE doc_id % 5 <> 0 GROUP BY source")
def section_counts(spark, d):
    docs = read_table(spark, d, "documents")
    return B.section_counts(docs.select(F.when(F.col("doc_id") % 5 != 0, F.col("source")).when(F.col("doc_id") % 2 == 0, "").alias("source_section")))


@query("""
WITH t AS (SELECT *, CASE WHEN doc_id % 6 = 0 THEN 'sha256:' || sha256(text) ELSE 'page:' || (doc_id // 4) END AS page_key FROM documents)
SELECT page_key, n_seen, doc_id AS seq FROM (SELECT page_key, doc_id, count(*) OVER (PARTITION BY lang, page_key) AS n_seen, row_number() OVER (PARTITION BY lang, page_key ORDER BY length(text) DESC, doc_id) AS r FROM t) WHERE r = 1
""")
def dedupe_pages(spark, d):
    docs = read_table(spark, d, "documents")
    pages = docs.select(F.col("lang").alias("dataset_id"), F.when(F.col("doc_id") % 6 != 0, F.floor(F.col("doc_id") / 4)).alias("page_id"), F.col("doc_id").alias("seq"), "text")
    return B.dedupe_pages(pages).select("page_key", "n_seen", "seq")


_MERGED_BIO = """
SELECT source AS slug, count(*) AS n_pages, string_agg('[SOURCE_PAGE dataset=' || lang || CASE WHEN doc_id % 6 <> 0 THEN ' | page_id=' || doc_id ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN ' | printed_page=' || n_chars ELSE '' END || ' | url=u' || doc_id || ']' || chr(10) || text, chr(10) || chr(10)
  ORDER BY doc_id % 6 = 0, CASE WHEN doc_id % 6 <> 0 THEN doc_id END, CASE WHEN doc_id % 6 = 0 THEN lpad(CAST(doc_id AS VARCHAR), 12, '0') END) AS rendered FROM documents GROUP BY source
"""


#: Biographies of more bytes are not rendered as one value: the limit of tokens of a request.
_MOST_BYTES = 4 * K.MOST_TOKENS


def _biography_pages(spark, d):
    docs = read_table(spark, d, "documents")
    pages = docs.select(
        F.col("source").alias("character_id"), F.col("lang").alias("dataset_id"), F.when(F.col("doc_id") % 6 != 0, F.col("doc_id")).alias("page_id"), F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")).alias("printed_page"),
        F.concat(F.lit("u"), "doc_id").alias("url"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("source_file"), "text",
    )
    rendered = B.biography_pages(pages)
    return rendered, B.biography_sizes(rendered)


@query(f"SELECT slug AS character_id, n_pages, length(rendered) AS n_chars, CASE WHEN strlen(rendered) <= {_MOST_BYTES} THEN sha256(rendered) END AS digest FROM ({_MERGED_BIO})")
def merged_biography(spark, d):
    rendered, sizes = _biography_pages(spark, d)
    made = B.merge_biography(rendered, sizes, _MOST_BYTES).select("character_id", T.content_hash(F.col("rendered")).alias("digest"))
    return sizes.join(made, "character_id", "left").select("character_id", "n_pages", "n_chars", "digest")


@query(f"SELECT source AS character_id, doc_id AS seq, sha256(r) AS digest FROM (SELECT source, doc_id, '[SOURCE_PAGE dataset=' || lang || CASE WHEN doc_id % 6 <> 0 THEN ' | page_id=' || doc_id ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN ' | printed_page=' || n_chars ELSE '' END || ' | url=u' || doc_id || ']' || chr(10) || text AS r FROM documents)")
def biography_pages(spark, d):
    return _biography_pages(spark, d)[0].select("character_id", F.col("place.source_file").cast("long").alias("seq"), T.content_hash(F.col("rendered")).alias("digest"))


@query("SELECT source AS character_id, arg_min(lang, doc_id) AS character_name, min(doc_id) AS page_id_start, CAST(row_number() OVER (ORDER BY min(doc_id), source) + 4 AS INTEGER) AS sort_order FROM documents GROUP BY source")
def canonical_metadata(spark, d):
    docs = read_table(spark, d, "documents")
    return B.canonical_metadata(docs.select(F.col("source").alias("character_id"), F.col("lang").alias("character_name"), F.col("doc_id").alias("page_id_start"), F.lit("f").alias("source_file")))


# ---- roster ----


def _roster(spark, d):
    n, r = read_table(spark, d, "nation"), read_table(spark, d, "region")
    joined = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    return joined.select(
        F.lower("n_name").alias("slug"), F.col("n_name").alias("name_ar"), F.lower("r_name").alias("era"), F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise("odd").alias("group_name"), (F.col("n_nationkey") % 6 != 5).alias("is_active"),
        F.col("n_nationkey").alias("sort_order"), F.when(F.col("n_nationkey") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lower("r_name"), F.lit("x"), F.lower("r_name"))).alias("categories"),
        F.when(F.col("n_nationkey") % 3 == 0, F.lit("placeholder")).when(F.col("n_nationkey") % 3 == 1, F.lit("")).otherwise(F.lit("kept")).alias("short_description"),
    )


_ROSTER = """
WITH c AS (SELECT lower(n_name) AS slug, n_nationkey AS k, lower(r_name) AS era, n_nationkey % 6 <> 5 AS active, n_nationkey % 4 = 0 AS bare, CASE n_nationkey % 3 WHEN 0 THEN 'placeholder' WHEN 1 THEN '' ELSE 'kept' END AS descr FROM nation JOIN region ON n_regionkey = r_regionkey)
"""


@query(_ROSTER + "SELECT slug, k AS sort_order FROM c WHERE active AND era = 'asia' AND NOT bare")
def roster_list(spark, d):
    r = _roster(spark, d)
    return O.list_characters(r, O.category_bridge(r), era="asia", category="x").select("slug", "sort_order")


@query(_ROSTER + "SELECT slug, era || '|x' AS categories FROM c WHERE NOT bare")
def roster_categories(spark, d):
    return O.character_categories(O.category_bridge(_roster(spark, d))).withColumn("categories", F.array_join("categories", "|"))


@query("SELECT lower(n_name) AS slug, count(*) AS n_suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 2 = 1 GROUP BY n_name")
def seed_roster(spark, d):
    s, n = read_table(spark, d, "supplier"), read_table(spark, d, "nation")
    found = s.join(n, s["s_nationkey"] == n["n_nationkey"]).groupBy(F.lower("n_name").alias("character_id")).agg(F.count("*").alias("n_suppliers"))
    return O.seed_roster(found, _roster(spark, d).where("group_name = 'even'"))


@query(_ROSTER + "SELECT slug, CASE WHEN descr = 'placeholder' THEN '' ELSE descr END AS short_description, descr = 'placeholder' AS reset FROM c")
def reset_descriptions(spark, d):
    return O.reset_descriptions(_roster(spark, d), "placeholder").select("slug", "short_description", "reset")


@query("SELECT lower(n_name) AS slug, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'companions' END AS group_name, n_nationkey % 2 = 1 AS changed FROM nation")
def backfill_group(spark, d):
    r = _roster(spark, d)
    return O.backfill(r, "group_name", F.when(F.col("group_name") == "odd", "companions").otherwise(F.col("group_name"))).select("slug", "group_name", "changed")


@query(_ROSTER + """
, a AS (SELECT list(slug ORDER BY k, slug) AS slugs FROM c WHERE active), e AS (SELECT DISTINCT CAST(ts AS DATE) AS story_date FROM events),
o AS (SELECT story_date, (SELECT slug FROM c WHERE k = day(story_date)) AS slug FROM e WHERE day(story_date) < 12)
SELECT e.story_date, CASE WHEN c.slug IS NOT NULL THEN o.slug ELSE slugs[1 + CAST(list_reduce(list_transform(string_split(sha256(CAST(e.story_date AS VARCHAR)), ''), lambda x: CAST(strpos('0123456789abcdef', x) - 1 AS BIGINT)), lambda s, x: (s * 16 + x) % len(slugs), 0::BIGINT) AS BIGINT)] END AS slug, c.slug IS NOT NULL AS curated
FROM e CROSS JOIN a LEFT JOIN o USING (story_date) LEFT JOIN (SELECT slug FROM c WHERE active) c ON c.slug = o.slug
""")
def story_rotation(spark, d):
    days = read_table(spark, d, "events").select(F.to_date("ts").alias("story_date"))
    r = _roster(spark, d)
    overrides = days.distinct().where(F.dayofmonth("story_date") < 12).join(r, F.dayofmonth("story_date") == F.col("sort_order")).select("story_date", "slug")
    return O.story_of_day(days, overrides, r)


@query(_ROSTER + "SELECT slug, CAST(row_number() OVER (ORDER BY slug) - 1 AS INTEGER) AS place, CASE WHEN bare THEN '' ELSE era || '|x|' || era END AS categories, descr AS short_description FROM c")
def export_snapshot(spark, d):
    snapshot = O.export_snapshot(_roster(spark, d))
    keys = snapshot.select(F.posexplode(F.json_object_keys("snapshot")).alias("place", "slug"))
    values = snapshot.select(F.explode(F.from_json("snapshot", "map<string,struct<categories:array<string>,short_description:string>>")).alias("slug", "v"))
    return keys.join(values, "slug").select("slug", "place", F.array_join("v.categories", "|").alias("categories"), "v.short_description")


@query(_ROSTER + "SELECT slug, CASE WHEN k % 2 = 0 THEN 'new' WHEN bare THEN '' ELSE era || '|x|' || era END AS categories, CASE WHEN k % 2 = 0 AND k % 5 <> 0 THEN 'from snapshot' ELSE descr END AS short_description, k % 2 = 0 AS changed FROM c")
def snapshot_sync(spark, d):
    r = _roster(spark, d)
    snapshot = r.where("group_name = 'even'").select("slug", F.array(F.lit("new")).alias("categories"), F.when(F.col("sort_order") % 5 != 0, "from snapshot").otherwise(" ").alias("short_description"))
    synced = O_sync(r, snapshot)
    return synced.select("slug", F.array_join("categories", "|").alias("categories"), "short_description", "changed")


def O_sync(roster, snapshot):
    return K.sync_snapshot(roster, snapshot)[0]


@query(_ROSTER + """
SELECT slug, k AS sort_order, CASE WHEN k % 2 = 0 THEN 'generated' ELSE descr END AS short_description FROM c UNION ALL SELECT 'zz' || r_regionkey, 25 + r_regionkey, 'generated' FROM region
""")
def merge_generated(spark, d):
    r = _roster(spark, d)
    made = r.where("group_name = 'even'").select("slug").unionByName(read_table(spark, d, "region").select(F.concat(F.lit("zz"), "r_regionkey").alias("slug"))).withColumn("short_description", F.lit("generated"))
    return K.merge_generated(r, made).select("slug", F.col("sort_order").cast("int").alias("sort_order"), "short_description")


# ---- classification ----


def _work(spark, d):
    r = _roster(spark, d)
    slugs = read_table(spark, d, "nation").select(F.concat(F.lit("src"), "n_nationkey").alias("character_id"), F.lower("n_name").alias("slug"))
    rename = lambda df: df.join(slugs, "character_id").drop("character_id").withColumnRenamed("slug", "character_id")
    rendered, sizes = _biography_pages(spark, d)
    return *K.worklist(r, rename(sizes)), rename(rendered), rename(sizes)


_WORK = _ROSTER + f", b AS (SELECT * FROM ({_MERGED_BIO})), w AS (SELECT c.slug, bare, trim(descr) = '' AS want_d, b.rendered FROM c LEFT JOIN b ON b.slug = 'src' || c.k WHERE active AND (bare OR trim(descr) = ''))"


@query(_WORK + "SELECT slug, slug || '::c' || CASE WHEN bare THEN 1 ELSE 0 END || 'd' || CASE WHEN want_d THEN 1 ELSE 0 END AS custom_id FROM w WHERE rendered IS NOT NULL")
def worklist(spark, d):
    return _work(spark, d)[0].select("slug", "custom_id")


@query(_WORK + "SELECT slug FROM w WHERE rendered IS NULL")
def worklist_missing(spark, d):
    return _work(spark, d)[1]


_TOKENS = "CAST(ceil(strlen('slug: ' || slug || chr(10) || chr(10) || rendered) / 4.0) + 2 AS BIGINT)"


@query(_WORK + f"SELECT count(rendered) AS n_requests, CAST(coalesce(sum(length(rendered)), 0) AS BIGINT) AS n_chars, CAST(coalesce(sum({_TOKENS}), 0) AS BIGINT) AS tokens, count(*) FILTER (WHERE {_TOKENS} > 20000) AS n_oversized, count(*) - count(rendered) AS n_missing, count(*) FILTER (WHERE {_TOKENS} > 20000) > 0 OR count(*) > count(rendered) AS blocked FROM w")
def preflight(spark, d):
    ready, missing, *_ = _work(spark, d)
    return K.preflight(K.request_sizes(ready, "classify"), missing, 20_000)


@query(_WORK + f"""SELECT slug || '::c' || CASE WHEN bare THEN 1 ELSE 0 END || 'd' || CASE WHEN want_d THEN 1 ELSE 0 END AS custom_id, 'system|user' AS roles, sha256('slug: ' || slug || chr(10) || chr(10) || rendered) AS digest FROM w WHERE rendered IS NOT NULL AND {_TOKENS} <= {K.MOST_TOKENS}""")
def requests(spark, d):
    ready, _, rendered, sizes = _work(spark, d)
    made = K.requests(ready, B.merge_biography(rendered, sizes, _MOST_BYTES), "classify")
    parsed = made.select("custom_id", F.from_json("request", "custom_id string, messages array<struct<role:string,content:string>>").alias("r"))
    return parsed.where("custom_id = r.custom_id").select("custom_id", F.array_join("r.messages.role", "|").alias("roles"), T.content_hash(F.col("r.messages")[1]["content"]).alias("digest"))


@query(_WORK + f"SELECT slug || '::c' || CASE WHEN bare THEN 1 ELSE 0 END || 'd' || CASE WHEN want_d THEN 1 ELSE 0 END AS custom_id, CAST({_TOKENS} AS INTEGER) AS tokens FROM w WHERE rendered IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 5")
def largest_requests(spark, d):
    return K.largest_requests(K.request_sizes(_work(spark, d)[0], "classify"), 5)


def _results(spark, d):
    """A result log from the labels: one line a row, ids of a few forms."""
    rows = read_table(spark, d, "labels")
    i = F.col("doc_id")
    content = F.to_json(F.struct(
        F.array(
            F.struct(F.lit("quality ").alias("label"), F.array((i % 50).cast("int"), (i % 7).cast("int")).alias("evidence_page_ids"), F.lit("r").alias("reason")),
            F.struct(F.lit("unknown").alias("label"), F.array((i % 50).cast("int")).alias("evidence_page_ids"), F.lit("r").alias("reason")),
            F.struct(F.lit("toxic").alias("label"), F.array(F.lit(-1), (i % 40).cast("int")).alias("evidence_page_ids"), F.lit("r").alias("reason")),
        ).alias("categories"), F.concat(F.lit("about "), i.cast("string")).alias("short_description")))
    return rows.select(
        F.when(i % 17 == 0, F.lit("broken")).otherwise(F.concat(F.lit("s"), (i % 30).cast("string"), F.lit("::c1d0"))).alias("custom_id"), F.when((F.col("toxic") == 1) | (i % 30 < 6), "failed").otherwise("completed").alias("status"),
        F.lit("run").alias("run_id"), i.alias("line_no"), F.when(i % 19 == 0, F.lit("[]")).otherwise(content).alias("content"), (i % 100).cast("int").alias("prompt_tokens"), F.col("quality").alias("completion_tokens"),
    )


_RESULTS = """
WITH l AS (SELECT doc_id AS line_no, CASE WHEN doc_id % 17 = 0 THEN 'broken' ELSE 's' || (doc_id % 30) || '::c1d0' END AS custom_id, CASE WHEN toxic = 1 OR doc_id % 30 < 6 THEN 'failed' ELSE 'completed' END AS status, doc_id % 100 AS p, quality AS c, doc_id % 19 = 0 AS bad FROM labels)
"""


@query(_RESULTS + "SELECT custom_id, CASE WHEN bool_or(status = 'completed') THEN 'completed' ELSE 'failed' END AS status, count(*) AS n_attempts, min(line_no) AS first_line FROM l WHERE custom_id <> 'broken' GROUP BY custom_id")
def latest_status(spark, d):
    return K.latest_status(_results(spark, d))


@query(_RESULTS + "SELECT count(*) AS n_results, count(*) FILTER (WHERE status = 'completed') AS n_succeeded, count(*) FILTER (WHERE status = 'failed') AS n_failed, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens FROM l")
def usage_totals(spark, d):
    return K.usage_totals(_results(spark, d))


@query("SELECT doc_id % 4 AS part, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'run' || (doc_id % 4) END AS run_id FROM labels GROUP BY 1, 2")
def run_id(spark, d):
    log = read_table(spark, d, "labels").select((F.col("doc_id") % 4).alias("part"), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("run"), F.col("doc_id") % 12)).otherwise(F.concat(F.lit("run"), F.col("doc_id") % 4)).alias("run_id"))
    return K.run_id(log, "part")


@query(_RESULTS + "SELECT custom_id, CASE WHEN k % 2 = 1 THEN 'not in roster' WHEN k % 3 = 0 THEN 'no biography' END AS blocked_by FROM (SELECT custom_id, min(line_no % 30) AS k FROM l WHERE custom_id <> 'broken' GROUP BY custom_id HAVING NOT bool_or(status = 'completed'))")
def retry_candidates(spark, d):
    log = _results(spark, d)
    n = log.select((F.col("line_no") % 30).alias("n")).distinct()
    slug = F.concat(F.lit("s"), F.col("n").cast("string"))
    return K.retry_candidates(log, n.where("n % 2 = 0").select(slug.alias("slug"), F.lit(True).alias("is_active")), n.where("n % 3 <> 0").select(slug.alias("character_id"))).select("custom_id", "blocked_by")


def _validated(spark, d):
    parsed = K.parse_results(_results(spark, d)).where("failure IS NULL")
    one = parsed.groupBy("slug").agg(F.max_by("parsed", "parsed.short_description").alias("parsed"), F.max("parsed.short_description").alias("description"))
    pages = read_table(spark, d, "documents").select(F.concat(F.lit("s"), (F.col("doc_id") % 30).cast("string")).alias("slug"), (F.col("doc_id") % 45).cast("int").alias("page_id"))
    taxonomy = spark.createDataFrame([("quality",), ("toxic",), ("extra",)], "label string")
    return one, K.validate_evidence(one, pages, taxonomy, ["extra"])


_VALID = _RESULTS + """
, g AS (SELECT CAST(substr(split_part(custom_id, '::', 1), 2) AS BIGINT) AS k, max('about ' || line_no) AS descr FROM l WHERE status = 'completed' AND custom_id <> 'broken' AND NOT bad GROUP BY 1),
v AS (SELECT k, descr, CAST(substr(descr, 7) AS BIGINT) AS i FROM g), pg AS (SELECT DISTINCT doc_id % 30 AS k, doc_id % 45 AS page_id FROM documents),
f AS (SELECT k, descr, EXISTS (SELECT 1 FROM pg WHERE pg.k = v.k AND page_id IN (i % 50, i % 7)) AS ql, EXISTS (SELECT 1 FROM pg WHERE pg.k = v.k AND page_id = i % 40) AS tx FROM v)
"""


@query(_VALID + "SELECT 's' || k AS slug, CASE WHEN ql THEN 'quality|' ELSE '' END || CASE WHEN tx THEN 'toxic|' ELSE '' END || 'extra' AS labels FROM f")
def validate_evidence(spark, d):
    return _validated(spark, d)[1].select("slug", F.array_join("labels", "|").alias("labels"))


@query(_VALID + "SELECT 's' || n AS slug, CASE WHEN f.k IS NULL THEN 'old' ELSE CASE WHEN ql THEN 'quality|' ELSE '' END || CASE WHEN tx THEN 'toxic|' ELSE '' END || 'extra' END AS categories, 'before' AS short_description, f.k IS NOT NULL AS changed FROM (SELECT DISTINCT doc_id % 30 AS n FROM labels) LEFT JOIN f ON f.k = n")
def apply_classification(spark, d):
    one, labels = _validated(spark, d)
    updates = one.join(labels, "slug").select("slug", F.lit(True).alias("want_categories"), F.lit(False).alias("want_description"), "labels", "description")
    roster = read_table(spark, d, "labels").select(F.concat(F.lit("s"), (F.col("doc_id") % 30).cast("string")).alias("slug")).distinct().withColumn("categories", F.array(F.lit("old"))).withColumn("short_description", F.lit("before"))
    return K.apply_classification(roster, updates).withColumn("categories", F.array_join("categories", "|"))


# ---- HTML, files, streams ----


def _html_lines(html: str) -> str:
    """SQL for H.html_lines; RE2 has no back references, so each kind of element goes on its own. Only references that the given pages hold are known."""
    out = html
    for tag in ("script", "style", "noscript", "svg"):
        out = f"regexp_replace({out}, '(?is)<{tag}\\b.*?</{tag}\\s*>', '', 'g')"
    out = f"regexp_replace({out}, '(?s)<!--.*?-->|<[!/?a-zA-Z][^>]*>', chr(10), 'g')"
    for name, c in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"')):
        out = f"replace({out}, '{name}', '{c}')"
    out = f"regexp_replace({out}, '&amp;?', '&', 'g')"
    clean = _strip(r"regexp_replace(regexp_replace(x, '[\x{200e}\x{200f}]', '', 'g'), '[ \t\x{a0}]+', ' ', 'g')")
    return f"list_filter(list_transform(string_split_regex({out}, '{H.LINE_END}'), lambda x: {clean}), lambda x: x <> '')"


@query(f"SELECT page_id, CAST(len(l) AS INTEGER) AS n_lines, sha256(array_to_string(l, chr(10))) AS content_hash FROM (SELECT page_id, {_html_lines('html')} AS l FROM pages)")
def html_pages(spark, d):
    pages = read_table(spark, d, "pages").withColumn("lines", H.html_lines(H.unescape(H.raw_lines(F.col("html")))))
    return pages.select("page_id", F.size("lines").alias("n_lines"), T.content_hash(F.array_join("lines", "\n")).alias("content_hash"))


_BODY = "نص عربي طويل يكفي للاختبار هنا"


@query(f"""
WITH l AS (SELECT page_id, url, {_html_lines('html')} AS l FROM pages WHERE page_id % 3 <> 0), b AS (SELECT page_id, url, '{_BODY}' || CASE WHEN len(l) > 0 THEN chr(10) || array_to_string(l, chr(10)) ELSE '' END AS text FROM l)
SELECT page_id, url, 2 AS printed_volume, 15 AS printed_page, sha256(text) AS content_hash FROM b
""")
def html_extract(spark, d):
    """Pages in the markers of the scraped site, two of three, through the whole extraction."""
    p = lambda x: F.lit(f"<p>{x}</p>")
    body = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("<title>ج ٢ ص ١٥</title>"), p("before"), p(H.PAGE_START), p(_BODY), F.col("html"), p(H.PAGE_END), p("after"))).otherwise(F.col("html"))
    return H.extract_pages(read_table(spark, d, "pages").withColumn("html", body))[0].select("page_id", "url", "printed_volume", "printed_page", "content_hash")


@query(f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'no start or end marker' ELSE 'text too short or not Arabic' END AS reason FROM pages WHERE page_id % 3 = 0 OR page_id % 3 = 1 AND NOT regexp_matches(array_to_string({_html_lines('html')}, chr(10)), '{T.ARABIC}')")
def html_rejects(spark, d):
    """Pages without markers, with markers around a text that is not Arabic, and good ones."""
    p = lambda x: F.lit(f"<p>{x}</p>")
    more = F.when(F.col("page_id") % 3 == 2, p(_BODY)).otherwise(F.lit(""))
    body = F.when(F.col("page_id") % 3 != 0, F.concat(p(H.PAGE_START), more, F.col("html"), p(H.PAGE_END))).otherwise(F.col("html"))
    return H.extract_pages(read_table(spark, d, "pages").withColumn("html", body))[1]


@query(r"SELECT page_id, coalesce(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\s*>', 1), '') AS title FROM pages")
def html_titles(spark, d):
    return read_table(spark, d, "pages").select("page_id", H.title_text(F.col("html")).alias("title"))


@query(f"SELECT source AS book, doc_id AS page_id, sha256('===== page_id=' || doc_id || ' | volume=1 | page=' || coalesce(CAST(nullif(n_chars % 4, 0) AS VARCHAR), 'None') || ' =====' || chr(10) || {_strip('text')}) AS digest FROM documents")
def review_text(spark, d):
    pages = read_table(spark, d, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page_id"), F.lit(1).alias("printed_volume"), F.nullif(F.col("n_chars") % 4, F.lit(0)).alias("printed_page"), "text")
    return S.review_text(pages, "book").select("book", "page_id", T.content_hash(F.col("block")).alias("digest"))


@query("SELECT doc_id AS page_id, source AS character_id, lang AS collection, CAST(n_chars AS VARCHAR) AS printed_page, sha256(text) AS content_hash FROM documents")
def jsonl_round_trip(spark, d):
    docs = read_table(spark, d, "documents")
    rows = docs.select(
        F.lit(1).alias("book_id"), F.lit("b").alias("book_title"), F.lit("a").alias("author"), F.col("lang").alias("collection"), F.col("source").alias("caliph_id"), F.lit("n").alias("caliph_name"),
        F.col("doc_id").alias("page_id"), F.col("n_chars").cast("string").alias("printed_page"), F.lit("u").alias("url"), "text",
    )
    root = Staging(spark).root
    S.write_jsonl(rows, f"{root}/rows_pages.jsonl")
    pages = P.load_source_pages(spark, root)
    return pages.select(F.col("page_id").cast("long"), "character_id", "collection", "printed_page", T.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT doc_id AS page_id, sha256(text) AS content_hash FROM documents")
def stream_ingest(spark, d):
    from corpusflow.streaming.jobs import incremental_ingest

    root = Staging(spark).root
    read_table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), "text").write.parquet(f"{root}/in")
    stream = spark.readStream.schema("page_id long, text string").option("maxFilesPerTrigger", 4).parquet(f"{root}/in")
    store = SnapshotStore(spark, f"{root}/table", {"pages": ["page_id"]}, buckets=8)
    incremental_ingest(stream, store, "pages", ["page_id"], f"{root}/checkpoint").awaitTermination()
    return store.read("pages").select("page_id", "content_hash")


_EDIT = "doc_id % 7 = 0"


@query(f"""
WITH {chunk_sql(f"SELECT 'o' || doc_id AS doc, {clean_sql('text')} AS text FROM documents UNION ALL SELECT 'n' || doc_id, {clean_sql("text || ' edited'")} FROM documents WHERE {_EDIT}", _MOST, _OVERLAP, _LEAST)},
o AS (SELECT substr(doc, 2) AS page, chunk_index, chunk_text FROM chunk WHERE doc[1] = 'o'), n AS (SELECT substr(doc, 2) AS page, chunk_index, chunk_text FROM chunk WHERE doc[1] = 'n'),
e AS (SELECT CASE WHEN o.page IS NULL THEN 'new' WHEN n.page IS NULL THEN 'deleted' WHEN o.chunk_text = n.chunk_text THEN 'unchanged' ELSE 'updated' END AS action
  FROM n FULL JOIN (SELECT * FROM o WHERE page IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE {_EDIT})) o ON o.page = n.page AND o.chunk_index = n.chunk_index),
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE {_EDIT}) AS edited FROM documents),
k AS (SELECT count(*) FILTER (WHERE action = 'new') AS added, count(*) FILTER (WHERE action = 'updated') AS updated, count(*) FILTER (WHERE action = 'unchanged') AS same, count(*) FILTER (WHERE action = 'deleted') AS gone FROM e)
SELECT 1 AS run, c.n AS pages_seen, c.n AS pages_new, 0::BIGINT AS pages_updated, 0::BIGINT AS pages_unchanged, (SELECT count(*) FROM o) AS chunks_new, 0::BIGINT AS chunks_updated, 0::BIGINT AS chunks_unchanged, 0::BIGINT AS chunks_deleted, (SELECT count(*) FROM o) AS embedded_chunks FROM c
UNION ALL SELECT 2, c.n, 0, 0, c.n, 0, 0, 0, 0, 0 FROM c
UNION ALL SELECT 3, c.n, 0, c.edited, c.n - c.edited, k.added, k.updated, k.same, k.gone, k.added + k.updated FROM c CROSS JOIN k
""")
def ingest_runs(spark, d):
    """Counters of three runs of the whole ingest over all documents: into an empty store, of the same pages again, and after an edit."""
    docs = read_table(spark, d, "documents")
    pages = docs.select(F.lit(1).alias("book_id"), F.col("doc_id").alias("page_id"), F.col("source").alias("character_id"), F.col("lang").alias("character_name"), "text")
    edited = pages.withColumn("text", F.when(F.col("page_id") % 7 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")))
    store = I.corpus_store(spark, f"{Staging(spark).root}/corpus", buckets=16)
    counters = ["pages_seen", "pages_new", "pages_updated", "pages_unchanged", "chunks_new", "chunks_updated", "chunks_unchanged", "chunks_deleted", "embedded_chunks"]
    out = None
    for run, batch in enumerate((pages, pages, edited), 1):
        stats = I.ingest_pages(store, batch, E.hash_provider(32), most=_MOST, overlap=_OVERLAP, least=_LEAST).select(F.lit(run).alias("run"), *counters)
        out = stats if out is None else out.unionByName(stats)
    return out
