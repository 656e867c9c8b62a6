"""Batched inference over pending rows through a user's function."""

from __future__ import annotations

import contextlib
import hashlib
import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

BATCH = 64


def hash_embedding(text: Column, size: int = 1536) -> Column:
    """A deterministic stand-in: byte i of the text's sha256 (cyclic) over 255."""
    value = lambda d, i: (F.conv(F.substring(d, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0).cast("float")
    once = F.transform(F.array(F.sha2(text.cast("binary"), 256)), lambda d: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: value(d, i)))[0]  # bound, so that each text is digested once
    return F.slice(F.flatten(F.array_repeat(once, -(-size // 32))), 1, size)


def hash_provider(size: int = 1536) -> Callable[[list[str]], list[list[float]]]:
    """A provider that needs no model: the same vectors as ``hash_embedding``."""

    def provide(texts: list[str]) -> list[list[float]]:
        digests = [hashlib.sha256(t.encode()).digest() for t in texts]
        return [[d[i % 32] / 255.0 for i in range(size)] for d in digests]

    return provide


def with_retries(call: Callable, attempts: int = 5, most_wait: float = 20.0) -> Callable:
    """``call`` again after a random, growing wait when it raises, ``attempts`` times in all."""

    def tried(batch):
        for k in range(attempts):
            try:
                return call(batch)
            except Exception:
                if k + 1 == attempts:
                    raise
                time.sleep(random.uniform(0, min(most_wait, 0.1 * 2**k)))

    return tried


def embed_pending(df: DataFrame, provider: Callable[[list[str]], list[list[float]]], text: str = "text", batch: int = BATCH, concurrency: int | None = None, within: str | None = None) -> DataFrame:
    """``df`` (with ``text`` and ``embedding``) where null embeddings are filled, and ``error`` where the provider failed.

    Rows that have one never reach the provider. ``concurrency`` bounds the partitions that call it. A call
    has rows of one value of ``within`` only, so that a failure is that value's own.
    """
    pending = df.where("embedding IS NULL")
    if concurrency:
        pending = pending.repartition(concurrency)
    if within:
        pending = pending.sortWithinPartitions(within)
    schema = df.drop("embedding", "error").schema.add("embedding", ArrayType(FloatType())).add("error", "string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            whole = [own for _, own in frame.groupby(within, sort=False, dropna=False)] if within else [frame]
            for part in (own.iloc[at : at + batch].copy() for own in whole for at in range(0, len(own), batch)):
                try:
                    part["embedding"], part["error"] = pd.Series(list(provider(part[text].tolist())), index=part.index), None
                except Exception as e:
                    part["embedding"], part["error"] = None, f"{type(e).__name__}: {e}"
                yield part[schema.names]

    done = df.where("embedding IS NOT NULL").withColumn("error", F.lit(None).cast("string"))
    return done.select(*schema.names).unionByName(pending.drop("error").select(*[c for c in schema.names if c not in ("embedding", "error")]).mapInPandas(run, schema))


def isolate_failures(df: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """Rows of groups without any error, and ``group, n_failed`` of the others, of which nothing is kept."""
    failed = df.groupBy(group).agg(F.count_if(F.col("error").isNotNull()).alias("n_failed")).where("n_failed > 0")
    return df.join(failed, group, "left_anti"), failed


def answer_log(spark: SparkSession, log: str, answer: str) -> DataFrame:
    """``key, answer`` of an append-only log; ``key`` is the sha256 of a prompt."""
    schema = f"key string, answer {answer}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).parquet(log) if there else spark.createDataFrame([], schema)


def answer_logged(df: DataFrame, provider: Callable[[list[str]], list], prompt: str, log: str, answer: str = "array<float>", batch: int = BATCH) -> DataFrame:
    """``df`` with ``answer`` (of the type ``answer``) from a log at ``log``, which is first completed by calls of ``provider``.

    A prompt that the log has is never called again, and one that is in several rows is called once. A task makes one call and puts its
    answers into the log as soon as it ends, so that a run that stops loses only the calls that it is in; the next one calls only what is absent.
    If a call fails its prompts are called one by one, and those that fail then are left out of the log: their ``answer`` is null.
    """
    spark = df.sparkSession
    keyed = df.withColumn("_key", F.sha2(F.col(prompt).cast("binary"), 256))
    absent = keyed.where(F.col(prompt).isNotNull()).groupBy(F.col("_key").alias("key")).agg(F.first(prompt).alias("prompt")).join(answer_log(spark, log, answer), "key", "left_anti")
    schema = f"key string, answer {answer}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                keys, prompts = part["key"].tolist(), part["prompt"].tolist()
                try:
                    rows = list(zip(keys, provider(prompts), strict=True))
                except Exception:
                    rows = []
                    for key, one in zip(keys, prompts, strict=True):
                        with contextlib.suppress(Exception):
                            rows.append((key, provider([one])[0]))
                yield pd.DataFrame(rows, columns=["key", "answer"])

    n = absent.count()
    if n:
        dealt = absent.repartition(-(-n // batch), "key")
        # a task's file is moved to its place when the task ends, not when all have
        dealt.mapInPandas(run, schema).write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(log)
    known = answer_log(spark, log, answer).dropDuplicates(["key"]).withColumnRenamed("key", "_key")
    return keyed.join(known, "_key", "left").drop("_key")


def infer_json(df: DataFrame, call: Callable[[str], str], prompt: str, answer: str) -> DataFrame:
    """``df`` with ``raw``, ``parsed`` (by the schema ``answer``), ``status`` and an error; every row is kept."""
    schema = df.schema.add("raw", "string").add("error_type", "string").add("error_message", "string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for p in frame[prompt]:
                try:
                    raw = call(p)
                    out.append((raw, None, None) if raw and raw.strip() else (None, "EmptyResponse", "no content"))
                except Exception as e:
                    out.append((None, type(e).__name__, str(e)))
            yield frame.assign(raw=[o[0] for o in out], error_type=[o[1] for o in out], error_message=[o[2] for o in out])[schema.names]

    df = df.select("*").mapInPandas(run, schema)
    is_object = F.get_json_object("raw", "$").startswith("{")
    bad = F.col("raw").isNotNull() & ~F.coalesce(is_object, F.lit(False))
    df = df.withColumn("error_type", F.when(bad, "NotAnObject").otherwise(F.col("error_type"))).withColumn("error_message", F.when(bad, "answer is no JSON object").otherwise(F.col("error_message")))
    return df.withColumn("parsed", F.when(~bad, F.from_json("raw", answer))).withColumn("status", F.when(F.col("error_type").isNull(), "completed").otherwise("failed"))
