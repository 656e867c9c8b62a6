"""A training-data pipeline over ``documents``: each stage reads what the one before it kept.

Every stage but the last returns the columns of its input. All decide row by
row, so null and repeated doc_ids lose and bring back nothing: language ID and
mixing carry rows through their operator, exact dedup and the Jaccard join stage
their input with a row key. Of exact copies the row with the largest doc_id stays,
of a near-duplicate component the one with the smallest; null ids count as
smallest, and of rows with one doc_id one stays. Mixing keeps or leaves rows with
one doc_id alike if their cell is one. An empty table passes all stages as such.

A stage stages tables in the shared folder: below ``staging``, which the caller
clears when the stage's result is written, else until the application ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.exact_dedup import exact_duplicates
from corpusflow.llm.language_id import UNKNOWN, held_out, predict, train
from corpusflow.llm.packing import pack_documents
from corpusflow.llm.signature_join import jaccard_components
from corpusflow.llm.source_mixing import mix
from corpusflow.plans.staging import Staging

#: A document stays if its language is known with this posterior at least.
LEAST_SCORE = 0.5


def _keyed(docs: DataFrame, staging: Staging) -> tuple[DataFrame, str]:
    """``docs`` staged with a row key, so that every reader sees the same one, and the key's name."""
    key = "_row_key"
    while key in docs.columns:
        key += "_"
    return staging.table(docs.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def _only(keyed: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """The rows of ``keyed`` whose key is among ``kept``; both sides may be large."""
    return keyed.join(kept.hint("merge"), key, "left_semi").drop(key)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str, staging: Staging | None = None) -> DataFrame:
    model = train(docs.where(~F.coalesce(held_out(), F.lit(False))))
    own = {c: "text" if c == "text" else f"_row_{c}" for c in docs.columns}
    rows = docs.select("doc_id", "text", *[F.col(c).alias(to) for c, to in own.items() if c != "text"])
    found = predict(rows, *model, carry=list(own.values())).where(f"lang_pred <> '{UNKNOWN}' AND score >= {LEAST_SCORE}")
    return found.select(*[F.col(to).alias(c) for c, to in own.items()])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, staging: Staging | None = None) -> DataFrame:
    staging = staging or Staging(spark)
    keyed, key = _keyed(docs, staging)
    with Staging(spark) as inner:
        kept = staging.table(exact_duplicates(keyed, inner, key=key).where("kept").select(key), "kept")
    return _only(keyed, kept, key).select(docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str, staging: Staging | None = None) -> DataFrame:
    staging = staging or Staging(spark)
    keyed, key = _keyed(docs, staging)
    with Staging(spark) as inner:
        found = jaccard_components(keyed.select(F.col(key).alias("doc_id"), "text"), inner).select(F.col("doc_id").alias(key), "component_id")
        first = found.join(keyed.select(key, "doc_id"), key).groupBy("component_id").agg(F.min(F.struct("doc_id", key)).alias("first"))
        kept = staging.table(first.select(f"first.{key}"), "kept")
    return _only(keyed, kept, key).select(docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str, staging: Staging | None = None) -> DataFrame:
    own = {c: c if c in ("doc_id", "text", "lang", "source") else f"_row_{c}" for c in docs.columns}
    mixed = mix(docs.select(*[F.col(c).alias(to) for c, to in own.items()]), staging=staging or Staging(spark))
    return mixed.where("kept").select(*[F.col(to).alias(c) for c, to in own.items()])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str, staging: Staging | None = None) -> DataFrame:
    return pack_documents(docs, staging=staging or Staging(spark))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("source_mixing", source_mixing),
    ("packing", packing),
]

#: Language identification, near-duplicate components and packing are beyond SQL; tests/llm holds a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what all stages keep of ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        written = Staging(spark)
        with Staging(spark) as own:
            docs = written.table(stage(spark, docs, sf_dir, own), name)
        if before:
            before.clear()
        before = written
    packed = STAGES[-1][1](spark, docs, sf_dir)  # stages its pieces, and reads ``docs`` no more
    before.clear()
    return packed
