"""Exact top-k inner-product search on impact-ordered indexes.

Vectors are quantised to integers. Candidates are dealt into blocks; each block
gets an index whose posting segments hold, for one dimension and one level of
the component, the rows that have it. A query reads segments by descending
quantised impact (score at a time) and adds their upper impact to accumulators,
counting each row's dimensions that were read. The frontier's impact bounds every
segment unread, so a row can gain at most that much in each dimension that it
still lacks. Reading stops when this proves that few rows can still
be among the k best; those are scored exactly. No row is left out without proof.

Defined cases: a vector that is null or holds a null or non-finite component is
neither query nor candidate; shorter vectors count as padded with zeros; ties
go to the smaller vec_id; a query's own vec_id is no candidate of it; repeated
rows are candidates each; a row without vec_id is neither, as nothing could name it; a
component beyond 2**24 after quantising, up to which sums are exact, is an error; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import groups, shuffle_partitions

SCALE = 256
K = 5
#: A component's largest size after quantising.
LARGEST = 1 << 24
#: Candidates in a block and queries in a block: what one task holds. A row is sent once for each block of the other side.
BLOCK_ROWS, QUERY_ROWS = 8192, 4096
#: Candidates in a block where there are too few to fill all tasks.
LEAST_ROWS = 1024
#: Values of a component in one level: the coarser, the fewer segments and the wider the slack of a score.
LEVEL = 4
#: Shares of the postings after which the proof is tried, and the share of rows that is few.
STOPS, FEW = (0.6, 0.78, 0.84, 0.89, 0.94), 0.03


def quantise(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, or null if the vector takes no part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    too_large = F.raise_error(F.lit(f"a component is beyond {LARGEST} after quantising")).cast("long")
    floored = lambda y: F.when(F.abs(y) <= LARGEST, F.floor(y).cast("long")).otherwise(too_large)
    return F.when(finite, F.transform(vector, lambda x: floored(F.lit(scale) * x.cast("double"))))


class ImpactIndex:
    """Posting segments of a block of integer vectors; rows are in order of their ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, level: int = LEVEL):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        dims, low, high, rows, length = [], [], [], [], []
        for d in range(vectors.shape[1]):
            column = self.vectors[:, d]
            by = np.argsort(column // level, kind="stable")
            cuts = np.flatnonzero(np.diff((column // level)[by])) + 1
            for part in np.split(by, cuts):
                dims.append(d)
                low.append(column[part].min())
                high.append(column[part].max())
                length.append(len(part))
                rows.append(part)
        self.dim, self.low, self.high = np.array(dims, dtype=np.int64), np.array(low), np.array(high)
        self.length = np.array(length, dtype=np.int64)
        self.rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        self.first = np.flatnonzero(np.diff(self.dim, prepend=-1))  # the first segment of each dimension

    def search(self, query: np.ndarray, own: int, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the ``k`` best rows other than ``own``, best first."""
        possible = self.possible(query, own, k)
        exact = self.vectors[possible] @ query
        first = np.lexsort((self.ids[possible], -exact))[:k]
        return self.ids[possible[first]], exact[first]

    def possible(self, query: np.ndarray, own: int, k: int = K) -> np.ndarray:
        """Rows other than ``own`` that may be among the ``k`` best; all others are proven not to be."""
        n, size = len(self.ids), len(query)
        possible = np.flatnonzero(self.ids != own)
        if not size or len(possible) <= 4 * k:
            return possible
        q = query[self.dim]
        best, least = np.where(q > 0, q * self.high, q * self.low), np.where(q > 0, q * self.low, q * self.high)
        base = np.minimum.reduceat(least, self.first)
        gain = best - base[self.dim]  # what a segment can add to the least of its dimension
        slack = int(np.maximum.reduceat(best - least, self.first).sum())
        order = np.argsort(-gain, kind="stable")
        order = order[: np.searchsorted(-gain[order], 0)]  # segments without gain change nothing
        read, done = np.cumsum(self.length[order]), 0
        got, lacks = np.zeros(n), np.full(n, size)
        lacks -= np.bincount(self._postings(np.flatnonzero(gain == 0)), minlength=n)
        for goal in (*(n * size * np.array(STOPS)), np.inf):
            stop = int(np.searchsorted(read, goal, side="right"))
            if stop > done:
                part = order[done:stop]
                rows = self._postings(part)
                got += np.bincount(rows, np.repeat(gain[part], self.length[part]), n)
                lacks -= np.bincount(rows, minlength=n)
                done = stop
            frontier = gain[order[done]] if done < len(order) else 0
            unread = gain.copy()
            unread[order[:done]] = 0
            rest = np.minimum(lacks[possible] * frontier, np.maximum.reduceat(unread, self.first).sum())
            score = got[possible]
            proof = np.partition(score, len(score) - k)[len(score) - k] - slack  # the k-th best has this at least
            possible = possible[score + rest >= proof]
            if len(possible) <= max(4 * k, FEW * n):
                break
        return possible

    def _postings(self, segments: np.ndarray) -> np.ndarray:
        """The rows of some segments, end to end."""
        length = self.length[segments]
        return self.rows[np.repeat(self.start[segments] - np.concatenate(([0], np.cumsum(length)))[:-1], length) + np.arange(length.sum())]


def _matrix(table: pa.Table, size: int) -> np.ndarray:
    column = table.column("v").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0)
    values, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    at = at - at[0]
    lengths = np.diff(at)
    out = np.zeros((len(lengths), size), dtype=np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - at[row]] = values
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` for integer vectors (vec_id, v) and queries (vec_id, v).

    Each block of queries meets each block of candidates in one task, which
    returns k rows a query; a window takes the k best of those.
    """
    spark = vectors.sparkSession
    vectors, queries = vectors.where("vec_id IS NOT NULL"), queries.where("vec_id IS NOT NULL")
    counts = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first(), queries.agg(F.count("*")).first()
    spread = min(shuffle_partitions(spark), -(-counts[0][0] // min(block_rows, LEAST_ROWS)))  # no fewer blocks than tasks, if there are rows for them
    blocks, query_blocks, size = max(-(-counts[0][0] // block_rows), spread, 1), -(-counts[1][0] // query_rows) or 1, counts[0][1]
    block = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = vectors.select(block(blocks, 1).alias("b"), each(query_blocks).alias("qb"), F.lit(0).alias("asks"), "vec_id", "v").unionByName(
        queries.select(each(blocks).alias("b"), block(query_blocks, 2).alias("qb"), F.lit(1).alias("asks"), "vec_id", "v")
    )
    fields = "query_id long, vec_id long, score long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for table in groups(batches, ["b", "qb", "asks"]):
            ids, matrix = table.column("vec_id").to_numpy(), _matrix(table, size)
            if not table.column("asks")[0].as_py():
                index, place = ImpactIndex(ids, matrix), (table.column("b")[0], table.column("qb")[0])
                continue
            if index is None or place != (table.column("b")[0], table.column("qb")[0]):
                continue  # no candidates here
            out: list[list] = [[], [], []]
            for own, query in zip(ids.tolist(), matrix, strict=True):
                found, score = index.search(query, own, k)
                for column, values in zip(out, ([own] * len(found), found, score), strict=True):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["query_id", "vec_id", "score"])

    dealt = rows.repartition(shuffle_partitions(spark), "b", "qb").sortWithinPartitions("b", "qb", "asks")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return dealt.mapInArrow(run, fields).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = given.select("vec_id", quantise(F.col("embedding")).alias("v")).where(F.col("v").isNotNull())
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP2_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
