"""Exact deduplication by deterministic block naming.

Texts are cut into blocks of a fixed number of UTF-8 bytes. Distinct blocks are
sorted and named by integers; then the names of adjacent pairs are named the
same way, level by level, until a document has one name. Equal names mean equal
texts: nothing is hashed into an identity, so nothing can collide.

A map task writes a block once and refers to it from its other copies, so a
text that a third of all documents share reaches the sort once per task. All
later steps move integers.

Defined cases: null counts as empty, and empty texts equal each other; of equal
texts the row with the largest doc_id stays (null ids count as smallest, and of
rows with one doc_id one stays); an empty table gives no rows; other columns
are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import documents, shuffle_partitions, utf8
from corpusflow.plans.staging import Staging

BLOCK_BYTES = 4096
#: Bytes of distinct blocks that a task remembers before it starts afresh.
REMEMBERED = 48 << 20
BLOCKS = "uid long, doc_id long, pos int, n_blocks int, first_uid long, first_pos int, block binary, text_sha256 string"


def cut_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, key: str | None = None) -> DataFrame:
    """One row per block. ``uid`` names the row of the document (by ``key``, if given); ``first_*`` the task's first copy of the block, which alone carries it."""
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        count = TaskContext.get().partitionId() << 33
        seen: dict[bytes, tuple[int, int]] = {}
        held = 0
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                raw, at = utf8(batch.column("text"))
                raw = raw.tobytes()
                rows = []
                uids = batch.column("uid").to_pylist() if key else range(count, count + batch.num_rows)
                count += batch.num_rows
                for uid, doc, i, j in zip(uids, batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    n = max(1, -(-(j - i) // block_bytes))
                    sha = hashlib.sha256(raw[i:j]).hexdigest()
                    for pos in range(n):
                        block = raw[i + pos * block_bytes : min(j, i + (pos + 1) * block_bytes)]
                        first = seen.setdefault(block, (uid, pos))
                        new = first == (uid, pos)
                        rows.append((uid, doc, pos, n, *first, block if new else None, None if pos else sha))
                        held += len(block) * new
                    if held > REMEMBERED:
                        seen, held = {}, 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text", *([F.col(key).alias("uid")] if key else [])).mapInArrow(run, BLOCKS)


def name_blocks(blocks: DataFrame) -> DataFrame:
    """``uid, pos, n_blocks, name``: equal blocks sort into one run and take the place of its first row as their name."""
    placed = (
        blocks.where(F.col("block").isNotNull()).select("uid", "pos", "block")
        .repartition(shuffle_partitions(blocks.sparkSession), "block").sortWithinPartitions("block")
        .withColumn("place", F.monotonically_increasing_id())
    )
    names = placed.select(F.col("uid").alias("first_uid"), F.col("pos").alias("first_pos"), F.min("place").over(Window.partitionBy("block")).alias("name"))
    return blocks.drop("doc_id", "block", "text_sha256").join(names, ["first_uid", "first_pos"]).select("uid", "pos", "n_blocks", "name")


def name_pairs(level: DataFrame, staging: Staging) -> DataFrame:
    """The next level: names of adjacent pairs; an odd last name pairs with -1."""
    pairs = staging.table(
        level.groupBy("uid", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
        ),
        "pairs",
    )
    names = staging.table(
        pairs.select("left", "right").distinct().sortWithinPartitions("left", "right").withColumn("name", F.monotonically_increasing_id()), "names"
    )
    return pairs.join(names, ["left", "right"]).select("uid", "pos", "name")


def identities(docs: DataFrame, staging: Staging, block_bytes: int = BLOCK_BYTES, key: str | None = None) -> DataFrame:
    """``uid, doc_id, text_sha256, level, name``: equal ``(level, name)`` if and only if equal text."""
    blocks = staging.table(cut_blocks(docs, block_bytes, key), "blocks")
    heads = blocks.where("pos = 0").select("uid", "doc_id", "n_blocks", "text_sha256")
    most = heads.agg(F.max("n_blocks")).first()[0] or 1
    named = staging.table(name_blocks(blocks), "level-0")
    done = [named.where("n_blocks = 1").select("uid", F.lit(0).alias("level"), "name")]
    level, depth = named.where("n_blocks > 1").select("uid", "pos", "name"), 0
    while most > 1:
        depth, most = depth + 1, -(-most // 2)
        level = staging.table(name_pairs(level, staging), f"level-{depth}")
        ended = level.groupBy("uid").agg(F.max("pos").alias("last"), F.max("name").alias("name"))
        done.append(ended.where("last = 0").select("uid", F.lit(depth).alias("level"), "name"))
        if most > 1:
            level = level.join(ended.where("last > 0").select("uid"), "uid", "left_semi")
    ends = done[0]
    for d in done[1:]:
        ends = ends.unionByName(d)
    return heads.drop("n_blocks").join(ends, "uid")


def exact_duplicates(docs: DataFrame, staging: Staging | None = None, block_bytes: int = BLOCK_BYTES, key: str | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs`` (doc_id, text), and ``key``, a unique long of each row, if given."""
    staging = staging or Staging(docs.sparkSession)
    named = staging.table(identities(docs, staging, block_bytes, key), "identities")
    several = staging.table(
        named.groupBy("level", "name").agg(F.max(F.struct("doc_id", "uid")).alias("keep"), F.count("*").alias("n")).where("n > 1"), "groups"
    )
    joined = named.join(several, ["level", "name"], "left")
    return joined.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("keep.uid") == F.col("uid"))).alias("kept"),
        "text_sha256",
        *([F.col("uid").alias(key)] if key else []),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


OP9_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM d WINDOW w AS (PARTITION BY text)
"""
