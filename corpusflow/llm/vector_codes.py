"""Vector code compression: product codes from integer codebooks, with entries found by GNAT.

A vector's components are quantised to integers and cut into equal consecutive
parts. Every part position has a codebook, which starts as the parts of the
first vectors by id and is improved by rounds of assigning all vectors and
taking each entry to its parts' componentwise floor of the mean. A vector's code is the
numbers of its parts' nearest entries.

The nearest entry is found by a geometric near-neighbour access tree (Brin 1995)
over a codebook: a node has split points, each with the entries nearest to it below, and
stores the range of distances from every split point to the entries below every other.
A query's distances to the split points eliminate whole subtrees by the
triangle inequality, strictly and with a margin for rounding, so that what could tie
is still looked at; distances and ties are decided in integers.

Tasks hold the codebooks (fixed in size) and one batch, and add up their parts; sums
are grouped by Spark, and only a row for each component of the codebooks reaches the driver.

Defined cases: a vector that is null or holds a null or non-finite component is
left out; shorter vectors count as padded with zeros to the longest, and that to a
multiple of the parts; a component beyond 2**24 after quantising is an error; null ids
come last in the order that starts codebooks, and of rows with one id the smaller
vector comes first; of ``n`` rows fewer than the entries there are ``n`` entries; an
empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.plans.staging import Staging

SCALE = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Split points of a node, and entries that a node compares one by one.
SPLITS, LEAF = 8, 8
#: A component's largest size after quantising.
LARGEST = 1 << 24


class Gnat:
    """Exact nearest entries of one codebook; ``compared`` counts the distances that were computed."""

    def __init__(self, entries: np.ndarray, splits: int = SPLITS, leaf: int = LEAF):
        self.entries, self.compared = entries, 0
        self.root = self._node(np.arange(len(entries)), splits, leaf)

    def _squared(self, queries: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        gap = queries[:, None, :] - self.entries[numbers][None, :, :]
        return np.einsum("ijk,ijk->ij", gap, gap)

    def _node(self, numbers: np.ndarray, splits: int, leaf: int) -> tuple:
        """``(numbers of split points, subtrees, least and greatest distance by split point and subtree)``."""
        if len(numbers) <= leaf:
            return numbers, [], None, None
        far = self._squared(self.entries[numbers], numbers[:1])[:, 0]
        chosen = [0]
        while len(chosen) < splits and far.max() > 0:  # farthest first
            chosen.append(int(far.argmax()))
            far = np.minimum(far, self._squared(self.entries[numbers], numbers[chosen[-1:]])[:, 0])
        if len(chosen) == 1:  # all are equal
            return numbers, [], None, None
        rest = np.setdiff1d(np.arange(len(numbers)), chosen)
        to = self._squared(self.entries[numbers[rest]], numbers[chosen])
        own = to.argmin(axis=1)
        kids, low, high = [], [], []
        for k in range(len(chosen)):
            if (mine := own == k).any():
                kids.append(self._node(numbers[rest[mine]], splits, leaf))
                low.append(np.sqrt(to[mine].min(axis=0)))
                high.append(np.sqrt(to[mine].max(axis=0)))
        return numbers[chosen], kids, low, high

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of ``queries`` the number of its nearest entry, of equals the lowest, and the squared distance."""
        best, number = np.full(len(queries), np.iinfo(np.int64).max), np.full(len(queries), len(self.entries))
        self._visit(self.root, queries, np.arange(len(queries)), best, number)
        return number, best

    def _visit(self, node: tuple, queries: np.ndarray, rows: np.ndarray, best: np.ndarray, number: np.ndarray) -> None:
        points, kids, low, high = node
        squared = self._squared(queries[rows], points)
        self.compared += squared.size
        least = squared.min(axis=1)
        first = np.where(squared == least[:, None], points, len(self.entries)).min(axis=1)
        better = (least < best[rows]) | (least == best[rows]) & (first < number[rows])
        best[rows[better]], number[rows[better]] = least[better], first[better]
        away = np.sqrt(squared)
        for kid, lo, hi in zip(kids, low or (), high or (), strict=True):
            reach = np.sqrt(best[rows])
            margin = 1e-9 * (away + hi + reach[:, None])  # far above the error of a few rounded operations
            apart = np.maximum(away - hi, lo - away) - margin > reach[:, None]
            left = rows[~apart.any(axis=1)]
            if len(left):
                self._visit(kid, queries, left, best, number)


def matrix(column: pa.Array, size: int, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a column of lists of doubles take part, and those quantised, as rows of ``size`` integers."""
    lengths = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null component is NaN
    row = np.repeat(np.arange(len(column)), lengths)
    takes = ~np.asarray(column.is_null())
    takes[row[~np.isfinite(values)]] = False
    place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = takes[row]
    floored = np.floor(scale * values[inside])
    if len(floored) and np.abs(floored).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} after quantising")
    out = np.zeros((len(column), size), dtype=np.int64)
    out[row[inside], place[inside]] = floored
    return takes, out[takes]


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.withColumn("embedding", F.col("embedding").cast("array<double>"))


def first_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> np.ndarray:
    """Codebooks (part, entry, place) of the first vectors by id."""
    takes = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = _vectors(rows).where(takes)
    width = -(-(kept.agg(F.max(F.size("embedding"))).first()[0] or 0) // parts)
    chosen = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").select("embedding").limit(entries).collect()
    _, first = matrix(pa.array([r[0] for r in chosen], pa.list_(pa.float64())), parts * width, scale)
    return first.reshape(len(chosen), parts, width).transpose(1, 0, 2)


def _assigned(batch: pa.RecordBatch, trees: list[Gnat], codebooks: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which rows take part, and their parts, entries and squared distances, by part."""
    parts, _, width = codebooks.shape
    takes, whole = matrix(batch.column("embedding"), parts * width, scale)
    cut = whole.reshape(len(whole), parts, width).transpose(1, 0, 2)
    found = [tree.nearest(own) for tree, own in zip(trees, cut, strict=True)]
    return takes, cut, np.array([f[0] for f in found]), np.array([f[1] for f in found])


def improved(rows: DataFrame, codebooks: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Codebooks after one round: each entry becomes the floor of the mean of its parts; one without parts stays."""
    parts, entries, width = codebooks.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(book) for book in codebooks]
        total, count = np.zeros(codebooks.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            _, cut, number, _ = _assigned(batch, trees, codebooks, scale)
            for part in range(parts):
                count[part] += np.bincount(number[part], minlength=entries)
                np.add.at(total[part], number[part], cut[part])
        at = np.nonzero(np.repeat((count > 0)[:, :, None], width, axis=2))
        columns = [*at, total[at], count[at[:2]]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "entry", "place", "total", "n"])

    rounded = _vectors(rows.select("embedding")).mapInArrow(sums, "part long, entry long, place long, total long, n long")
    out = codebooks.copy()
    for part, entry, place, total, n in rounded.groupBy("part", "entry", "place").agg(F.sum("total"), F.sum("n")).collect():  # a row for each component of the codebooks
        out[part, entry, place] = total // n
    return out


def encoded(rows: DataFrame, codebooks: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, code, error`` of the rows that take part."""
    schema = rows.select("vec_id", "label").schema.add("code", "string").add("error", "long")

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(book) for book in codebooks]
        for batch in batches:
            takes, _, number, squared = _assigned(batch, trees, codebooks, scale)
            own = batch.filter(pa.array(takes))
            code = [bytes(x).hex() for x in number.T.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("label"), pa.array(code, pa.string()), pa.array(squared.sum(axis=0), pa.int64())], schema.names)

    return _vectors(rows.select("vec_id", "label", "embedding")).mapInArrow(codes, schema)


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code, error`` of ``vectors`` (vec_id, embedding, label), and the codebooks that codes refer to."""
    if entries > 256:
        raise ValueError("a code has one byte a part, so at most 256 entries")
    rows = vectors.select("vec_id", "embedding", "label")
    codebooks = first_codebooks(rows, parts, entries, scale)
    if not codebooks.size:  # no vectors, or none with a component
        rounds = 0
    for _ in range(rounds):
        codebooks = improved(rows, codebooks, scale)
    return encoded(rows, codebooks, scale), codebooks


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, codebooks = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    codes = Staging(spark).table(codes, "codes")
    by = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    joined = codes.join(by, codes["label"].eqNullSafe(by["_label"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def _assign_sql(codebook: str) -> str:
    """Each part with its nearest entry of a codebook table (part, entry, c)."""
    return f"""SELECT vec_id, part, p, min(struct_pack(d := d, entry := entry)) AS best FROM (
  SELECT x.vec_id, x.part, x.p, b.entry, list_sum(list_transform(range(1, 5), lambda i: (x.p[i] - b.c[i]) * (x.p[i] - b.c[i]))) AS d FROM x JOIN {codebook} b ON b.part = x.part
) GROUP BY vec_id, part, p"""


def _round_sql(name: str, before: str) -> str:
    mean = ", ".join(f"CAST(floor(CAST(sum(p[{i}]) AS DOUBLE) / count(*)) AS BIGINT)" for i in range(1, 5))
    return f"""a_{name} AS MATERIALIZED ({_assign_sql(before)}),
{name} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM {before} b LEFT JOIN (SELECT part, best.entry AS entry, [{mean}] AS c FROM a_{name} GROUP BY part, best.entry) m ON m.part = b.part AND m.entry = b.entry)"""


#: For vectors of 64 components and unique ids, as the given ones are.
OP13_SQL = f"""
WITH e AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (SELECT vec_id, part, v[4 * part + 1:4 * part + 4] AS p FROM e CROSS JOIN range(16) t(part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, p AS c FROM x WHERE vec_id IN (SELECT vec_id FROM e ORDER BY vec_id LIMIT 64)),
{_round_sql("b1", "b0")},
{_round_sql("b2", "b1")},
f AS MATERIALIZED ({_assign_sql("b2")}),
s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2),
r AS (SELECT vec_id, string_agg(printf('%02x', CAST(best.entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM f GROUP BY vec_id)
SELECT r.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY e.label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN e ON e.vec_id = r.vec_id CROSS JOIN s
"""
