"""Language identification by multinomial naive Bayes over hashed character n-grams.

A text's characters are lower-cased, everything but letters becomes a space, and
all n-grams of 1 to 3 characters are hashed into a fixed number of buckets. Training
counts n-grams per language on a bounded sample of labelled rows in Spark; the
matrix of log-probabilities (buckets x languages, a fixed size) is broadcast,
and whole texts are scored as sparse sums of its rows in numpy.

Defined cases: null text, empty text and text without a letter are ``und`` with
score 0; ties go to the language that sorts first; without any labelled row all
texts are ``und``; repeated rows are predicted each; very long texts are scored
in slices of bounded size; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusflow.llm.common import documents, slices, utf8

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: At most so many labelled rows are learnt from: those whose doc_id hashes lowest.
TRAINING_ROWS = 20_000
#: More languages than this are refused, so that the broadcast matrix stays below 32 MB.
MOST_LANGUAGES = 256
UNKNOWN = "und"
SCORED = "doc_id long, lang_pred string, score double"
_FOLD: list[np.ndarray] = []
_SLICE = 1 << 20


def _fold() -> np.ndarray:
    """For each code point its lower-cased form if it is a letter, else a space."""
    if not _FOLD:
        table = np.full(0x110000, 32, dtype=np.uint32)
        for cp in range(0x110000):
            if (c := chr(cp)).isalpha():
                low = c.lower()
                table[cp] = ord(low) if len(low) == 1 else cp
        _FOLD.append(table)
    return _FOLD[0]


def _characters(raw: np.ndarray) -> np.ndarray:
    return _fold()[np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype="<u4")]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Folded characters of some texts or of a slice of one: characters, offsets of the parts, row of each part.

    About ``_SLICE`` bytes are unfolded at once, as each takes some tens of bytes on the way. A
    slice of a text is followed by the characters that its last n-grams reach
    into; its offsets are 0, the end of its own characters and the end of all.
    """
    first = 0
    for part in slices(batch, "text", _SLICE):
        raw, at = utf8(part.column("text"))
        begins = (raw & 0xC0) != 0x80  # bytes that begin a character
        if part.num_rows > 1:
            yield _characters(raw), np.concatenate(([0], np.cumsum(begins)))[at], np.arange(first, first + part.num_rows)
        else:
            for lo in range(0, max(len(raw), 1), _SLICE):
                ends = [min(len(raw), k) for k in (lo, lo + _SLICE, lo + _SLICE + 4 * max(ORDERS))]
                ends = [k if k in (0, len(raw)) else k + int(np.argmax(np.append(begins[k : k + 4], True))) for k in ends]
                own, following = _characters(raw[ends[0] : ends[1]]), _characters(raw[ends[1] : ends[2]])[: max(ORDERS) - 1]
                yield np.concatenate((own, following)), np.array([0, len(own), len(own) + len(following)]), np.array([first])
        first += part.num_rows


def _grams(chars: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each character; the last n-1 have none."""
    code = chars.astype(np.uint64)
    for k in range(1, n):
        code = code[:-1] * np.uint64(0x1F0A3) + chars[k:]
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    with np.errstate(over="ignore"):
        code = (code + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
        return ((code * np.uint64(0xBF58476D1CE4E5B9)) >> shift).astype(np.int64)


def _windows(bounds: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's n-grams start and end among ``_grams``' results."""
    if len(rows) == 1 and len(bounds) == 3:  # a slice of one text, with what follows it
        lo, hi = np.array([0]), np.array([min(bounds[1], max(0, bounds[2] - n + 1))])
    else:
        lo, hi = bounds[:-1], np.maximum(bounds[:-1], bounds[1:] - n + 1)
    most = max(0, int(bounds[-1]) - n + 1)  # a short text at the end begins behind the last n-gram
    return np.minimum(lo, most), np.minimum(np.maximum(lo, hi), most)


def count_grams(labelled: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``lang, bucket, n`` over the texts of ``labelled`` (text, lang); bucket -1 counts the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for row in langs:
                counts.setdefault(row, np.zeros(buckets + 1, dtype=np.int64))[buckets] += 1
            for chars, bounds, rows in _texts(batch):
                for n in ORDERS:
                    lo, hi = _windows(bounds, rows, n)
                    grams = _grams(chars, n, buckets) if len(chars) >= n else np.zeros(0, np.int64)
                    for r, i, j in zip(rows, lo, hi, strict=True):
                        if j > i:
                            counts[langs[r]][:buckets] += np.bincount(grams[i:j], minlength=buckets)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            bucket = np.where(at == buckets, -1, at)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(bucket), pa.array(c[at])], ["lang", "bucket", "n"])

    return labelled.select("text", "lang").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def sample(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` of ``rows`` (doc_id, text, lang): those whose doc_id hashes lowest; where rows without id or with one id are too many, those of them whose whole row does."""

    def lowest(rows: DataFrame, *by: str) -> tuple[DataFrame, int | None]:
        drawn = rows.withColumn("_draw", F.xxhash64(*[F.col(c).cast("string") for c in by]))
        last = drawn.select("_draw").orderBy("_draw").limit(most).agg(F.max("_draw"), F.count("*")).first()
        return drawn, last[0] if last[1] == most else None

    drawn, last = lowest(rows, "doc_id")
    if last is None:
        return rows
    kept = drawn.where(F.col("_draw") <= last)
    if kept.select("_draw").limit(most + 1).count() <= most:
        return kept
    drawn, last = lowest(kept.drop("_draw"), "doc_id", "text", "lang")
    below = drawn.where(F.col("_draw") < last)
    return below.unionByName(drawn.where(F.col("_draw") == last).limit(most - below.count()))  # rows that are equal


def train(labelled: DataFrame, training_rows: int = TRAINING_ROWS, buckets: int = BUCKETS, smoothing: float = 0.5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-priors and the (buckets x languages) log-probabilities from ``labelled`` (doc_id, text, lang).

    Rows with null text or lang are left out. With more than ``training_rows`` of
    them those with the lowest hash of doc_id count.
    """
    rows = sample(labelled.where("text IS NOT NULL AND lang IS NOT NULL"), training_rows)
    if rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:  # before anything is counted by language
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    found = count_grams(rows, buckets).collect()  # languages x (buckets + 1) rows at most
    langs = sorted({r["lang"] for r in found})
    place = {lang: k for k, lang in enumerate(langs)}
    counts, seen = np.zeros((buckets, len(langs))), np.zeros(len(langs))
    for r in found:
        if r["bucket"] < 0:
            seen[place[r["lang"]]] = r["n"]
        else:
            counts[r["bucket"], place[r["lang"]]] = r["n"]
    counts += smoothing
    return langs, np.log(seen / max(1, seen.sum())), np.log(counts / counts.sum(axis=0, keepdims=True))


def predict(docs: DataFrame, langs: list[str], prior: np.ndarray, logs: np.ndarray, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, lang_pred, score`` of ``docs`` (doc_id, text); the score is the posterior of the language.

    Columns named in ``carry`` (none of these three) come along, so that a filter needs no join.
    """
    carry = carry or []
    given = docs.select(F.col("doc_id").cast("long"), "text", *[c for c in carry if c != "text"])
    schema = StructType([*StructType.fromDDL(SCORED).fields, *[given.schema[c] for c in carry]])
    model = docs.sparkSession.sparkContext.broadcast((langs, prior, np.ascontiguousarray(logs.T, dtype=np.float32)))
    buckets = logs.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, first, table = model.value
        labels = np.array([*names, UNKNOWN], dtype=object)
        for batch in batches:
            total = np.tile(first, (batch.num_rows, 1))
            letters = np.zeros(batch.num_rows, dtype=np.int64)
            for chars, bounds, rows in _texts(batch):
                lo, hi = _windows(bounds, rows, 1)
                known = np.concatenate(([0], np.cumsum(chars != 32)))
                letters[rows] += known[hi] - known[lo]
                for n in ORDERS:
                    if len(chars) < n:
                        continue
                    grams = _grams(chars, n, buckets)
                    lo, hi = _windows(bounds, rows, n)
                    for k in range(len(names)):
                        sums = np.concatenate(([0.0], np.cumsum(table[k].take(grams), dtype=np.float64)))
                        total[rows, k] += sums[hi] - sums[lo]
            best, score = np.full(batch.num_rows, len(names)), np.zeros(batch.num_rows)
            if names:
                best = total.argmax(axis=1)
                score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                best[letters == 0], score[letters == 0] = len(names), 0.0
            columns = [batch.column("doc_id"), pa.array(labels[best], pa.string()), pa.array(score), *map(batch.column, carry)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", *carry])

    return given.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a row is kept from training: a quarter of all, by crc32 of the id as text."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2


def identify(docs: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """Train on the labelled rows of ``docs`` that are not held out, then predict all."""
    return predict(docs, *train(docs.where(~F.coalesce(held_out(), F.lit(False))), training_rows))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(documents(spark, sf_dir))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
