"""Spelling variant grouping by permuterm rotations.

Every word, marked by a terminator, is rotated to each of its places. The
rotation that ends in a character, without that character, is what all words that
differ from it there have in common: words with another character at this
place have the same prefix, and the word without the character has it as one of
its whole rotations. So replacements, insertions and deletions are equal prefixes
of sorted rotations. Rotations are dealt by prefix and sorted, and each run of one prefix
is scanned; a word leaves a run with the number of its neighbours there and the best of them,
not with pairs.

A run holds one whole word and at most one word for every character that may be
edited, so by ``ALPHABET`` it has 91 rows at most, however common words are. Counts are
summed in the tasks before they are shuffled.

Defined cases: null text has no words; a null doc_id is empty where an edit reads
it; rows that share a doc_id count each; very long texts are read in pieces that
end between words; ties go to the word that is smaller by code points; an empty
table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import documents, shuffle_partitions, slices, utf8
from corpusflow.plans.staging import Staging

#: Characters of a word once A-Z is lower-cased: 26 and 64.
ALPHABET = "a-zÀ-ÿ"
TERMINATOR = "$"
LEAST_CHARS, LEAST_COUNT = 5, 3
#: Distinct words that a task counts before it sends them on, and characters of a text that it reads at once.
HELD, PIECE = 200_000, 1 << 20

Edit = Callable[[str, str], str]


def deleted_point(doc_id: str, run: str, every: int = 97) -> str:
    """``run``, in one of ``every`` cases without one code point, by the crc32 of document and run."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    at = h % len(run)
    return run if h % every else run[:at] + run[at + 1 :]


def _runs(text: str, pattern: re.Pattern) -> Iterator[list[str]]:
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if rest := pattern.match(text, end - 1):  # a run that the cut would part
            end = rest.end()
        yield pattern.findall(text, at, end)
        at = end


def word_counts(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, edit: Edit | None = None) -> DataFrame:
    """``word, n`` of all words of ``docs`` (doc_id, text), A-Z lower-cased; ``edit`` may change a document's run of letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, held = re.compile(f"[{ALPHABET}]+"), Counter()

        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for whole in batches:
            for batch in slices(whole, "text"):
                raw, at = utf8(batch.column("text"))
                lowered = raw.tobytes().lower()  # of bytes, which lowers A-Z alone
                for doc, i, j in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own = Counter()
                    for runs in _runs(lowered[i:j].decode(errors="replace"), pattern):
                        own.update(runs)
                    for r, n in own.items():
                        word = edit(doc, r) if edit else r
                        if len(word) >= least_chars:
                            held[word] += n
                    if len(held) >= HELD:
                        yield send()
                        held.clear()
        yield send()

    named = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    counted = named.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """``key, word, n, cut, indel``: all rotations of each word whole, and without the letter that they end in (``cut``).

    ``indel`` marks the first of equal adjacent letters: deleting any of them gives the same word, which counts once.
    """
    word, size = F.col("word"), F.length("word")
    rotated = lambda i, skip: F.concat(F.substr(word, i + 1 + skip), F.lit(TERMINATOR), F.substr(word, F.lit(1), i))
    first = lambda i: (i == 0) | (F.substr(word, i + 1, F.lit(1)) != F.substr(word, i, F.lit(1)))
    row = lambda key, cut, indel: F.struct(key.alias("key"), cut.alias("cut"), indel.alias("indel"))
    whole = F.transform(F.sequence(F.lit(0), size), lambda i: row(rotated(i, 0), F.lit(False), F.lit(True)))
    cut = F.transform(F.sequence(F.lit(0), size - 1), lambda i: row(rotated(i, 1), F.lit(True), first(i)))
    return words.select("word", "n", F.explode(F.concat(whole, cut)).alias("r")).select("r.key", "word", "n", "r.cut", "r.indel")


def neighbours(words: DataFrame) -> DataFrame:
    """``word, n_near, best``: of each word that has near words their number, and the one of largest ``n`` (``rank`` is -n)."""
    dealt = rotations(words).repartition(shuffle_partitions(words.sparkSession), "key").sortWithinPartitions("key")
    member = F.struct((-F.col("n")).alias("rank"), "word", "cut", "indel")
    scanned = dealt.groupBy("key").agg(F.array_sort(F.collect_list(member)).alias("run")).where(F.size("run") > 1)  # 91 members at most

    def near(me: Column, x: Column) -> Column:
        return F.when(me["cut"] & x["cut"], me["word"] != x["word"]).otherwise((me["cut"] != x["cut"]) & me["indel"] & x["indel"])

    left = F.transform("run", lambda me: F.struct(me["word"].alias("word"), F.filter("run", lambda x: near(me, x)).alias("near")))
    each = scanned.select(F.explode(left).alias("m")).where(F.size("m.near") > 0)
    best = F.struct(F.col("m.near")[0]["rank"].alias("rank"), F.col("m.near")[0]["word"].alias("word"))
    rows = each.select("m.word", F.size("m.near").alias("n_near"), best.alias("best"))
    return rows.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, staging: Staging) -> DataFrame:
    """``word, root``: the end of each word's chain of ``forms`` (word, form), by doubling of steps.

    A form occurs at least twice as often as its word, so chains end, and are short.
    """
    now = staging.table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staging.table(now.join(onward, "root", "left"), "roots")
        now = moved.select("word", F.coalesce("next", "root").alias("root"))
        if moved.where("next IS NOT NULL").isEmpty():
            return now


def spelling_variants(docs: DataFrame, staging: Staging | None = None, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, edit: Edit | None = None) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: each word with the near word that it is a variant of, and the end of that chain."""
    staging = staging or Staging(docs.sparkSession)
    words = staging.table(word_counts(docs, least_chars, least_count, edit), "words")
    taken = -F.col("best.rank") >= 2 * F.col("n")
    found = words.join(neighbours(words), "word", "left").select(
        "word", F.when(taken, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, -F.col("best.rank")).alias("form_n")
    )
    found = staging.table(found, "forms")
    ends = roots(found.where("form IS NOT NULL").select("word", "form"), staging)
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir), edit=deleted_point)


# crc32 a bit at a time: a byte comes with the first of its eight steps
_CRC = """xor(list_reduce([4294967295] || flatten(list_transform(flatten(list_transform(string_split(doc_id || ':' || run, ''),
  lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195::BIGINT, CAST(unicode(c) - 64 AS BIGINT)] END)), lambda b: [b, 0, 0, 0, 0, 0, 0, 0])),
  lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"""

OP12_SQL = f"""
WITH RECURSIVE seen AS (
  SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{c0}}-\\x{{ff}}]+')) AS run FROM documents) GROUP BY doc_id, run
), hashed AS (SELECT run, n, {_CRC} AS h FROM seen),
w AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cut AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN w ON w.word = c.head || c.tail
  UNION SELECT w.word, c.word FROM cut c JOIN w ON w.word = c.head || c.tail
), best AS (SELECT near.word, count(*) AS n_near, min(struct_pack(rank := -o.n, other := other)) AS b FROM near JOIN w o ON o.word = other GROUP BY near.word),
formed AS MATERIALIZED (
  SELECT w.word, CASE WHEN -b.rank >= 2 * n THEN b.other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.rank >= 2 * n THEN -b.rank END AS form_n FROM w LEFT JOIN best ON best.word = w.word
), chain AS (SELECT word, word AS root, 0 AS step FROM formed UNION ALL SELECT chain.word, f.form, step + 1 FROM chain JOIN formed f ON f.word = chain.root WHERE f.form IS NOT NULL),
ended AS (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word)
SELECT formed.word, form, root, n, n_near, form_n FROM formed JOIN ended ON ended.word = formed.word
"""
