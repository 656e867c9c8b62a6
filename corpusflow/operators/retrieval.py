"""Filtered cosine top-k for many queries at once, and what is built on the hits."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from corpusflow.functions import text as T

K, MIN_SCORE = 5, 0.28
#: Chunks and queries that meet in one task.
CHUNK_ROWS, QUERY_ROWS = 8192, 1024
#: Filters of one search: a chunk may be sent once for each combination of them.
MOST_FILTERS = 6
#: Lists of an index, chunks that its centroids are trained on at most, and lists that a query reads.
LISTS, SAMPLE_ROWS, NPROBE = 64, 50_000, 40
# Replies when the sources do not cover a question.
FALLBACK = {
    "kids": "لا تتوفر لديّ معلومات كافية في المصادر المتاحة للإجابة عن هذا السؤال بدقة. جرّب أن تسأل عن جانب آخر من القصة!",
    "adults": "لا تتوفر في المصادر التاريخية المسترجعة معلومات كافية للإجابة عن هذا السؤال بدقة. يمكنك إعادة صياغة السؤال أو طرح سؤال آخر متعلق بهذه الشخصية.",
}


def cosine(a: Column, b: Column) -> Column:
    """Native cosine of two vectors, null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _unit(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of length 1; NaN for one without length or with a null component."""
    flat = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(vectors), -1) if len(flat) else np.zeros((len(vectors), 0))
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm == 0, np.nan, norm)


def _best(row: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, to 12 digits, ties to the earlier; only what reaches the k-th is sorted."""
    rounded = -np.nan_to_num(np.round(row, 12), nan=-9.0)
    if len(row) > k:
        rows = np.flatnonzero(rounded <= np.partition(rounded, k - 1)[k - 1])
        return rows[np.argsort(rounded[rows], kind="stable")][:k]
    return np.argsort(rounded, kind="stable")


def retrieve(chunks: DataFrame, queries: DataFrame, k: int = K, filters: str | tuple[str, ...] = ()) -> DataFrame:
    """``query_id, rank, chunk_id, score``: the ``k`` chunks of highest cosine, ties to the smaller chunk_id; ids are of any type.

    Blocks of queries (query_id, embedding) meet blocks of chunks (chunk_id, embedding) and only the
    ``k`` best of each meeting are shuffled. Of the columns in ``filters``, which both sides
    have, those that are not null in a query must be equal in a chunk. Chunks are sent under the
    combinations of filters that queries really use, each joined by its values, so a chunk travels only to queries
    that may see it. Chunks of another length than a query's are none of its candidates. Those
    without embedding are left out; without length, or with a null component, they come last, with a null score.
    """
    filters = (filters,) if isinstance(filters, str) else tuple(filters)
    if len(filters) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters, as they may be combined")
    has = F.col("embedding").isNotNull()
    used = functools.reduce(lambda a, b: a + b, [F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(filters)], F.lit(0))

    def tag(mask: Column) -> Column:
        """The length of the vector, which filters count, and their values."""
        value = [F.when(mask.bitwiseAND(1 << i) != 0, F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))).otherwise("") for i, c in enumerate(filters)]
        return F.concat(F.size("embedding").cast("string"), F.lit(","), mask.cast("string"), *[F.concat(F.lit(","), v) for v in value])  # null where a chunk lacks a value

    queries = queries.where(has)
    masks = [0] if not filters else [r[0] for r in queries.select(used.alias("m")).distinct().collect()]  # at most 2 ** MOST_FILTERS
    queries = queries.select(F.col("query_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), tag(used).alias("tag"))
    sent = F.array_compact(F.array(*[tag(F.lit(m)) for m in masks])) if masks else F.array().cast("array<string>")
    chunks = chunks.where(has).select(F.col("chunk_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), F.explode(sent).alias("tag"))
    # how many blocks each tag has on either side; only tags that queries have
    count = lambda df, rows, name: df.groupBy("tag").agg(F.ceil(F.count("*") / rows).cast("int").alias(name))
    sizes = count(chunks, CHUNK_ROWS, "nc").join(count(queries, QUERY_ROWS, "nq"), "tag")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    columns = ["tag", "c", "q", "chunk_id", "query_id", "embedding"]
    kinds = chunks.schema["id"].dataType, queries.schema["id"].dataType
    rows = chunks.join(sizes, "tag").select("*", deal("nc").alias("c"), each("nq").alias("q"), F.col("id").alias("chunk_id"), F.lit(None).cast(kinds[1]).alias("query_id"), F.lit(False).alias("asks")).select(*columns, "asks").unionByName(
        queries.join(sizes, "tag").select("*", each("nc").alias("c"), deal("nq").alias("q"), F.lit(None).cast(kinds[0]).alias("chunk_id"), F.col("id").alias("query_id"), F.lit(True).alias("asks")).select(*columns, "asks")
    )
    schema = StructType([StructField("query_id", kinds[1]), StructField("chunk_id", kinds[0]), StructField("score", DoubleType())])

    def meet(block: pa.Table) -> pa.Table:
        asks = block.column("asks")
        a, b = block.filter(pc.invert(asks)).sort_by("chunk_id"), block.filter(asks)
        ids, who = a.column("chunk_id").combine_chunks(), b.column("query_id").combine_chunks()
        found, counts, scores = [], [], []
        if len(a) and len(b):
            for row in _unit(b.column("embedding")) @ _unit(a.column("embedding")).T:
                best = _best(row, k)
                found.append(best)
                counts.append(len(best))
                scores.append(row[best])
        take = lambda column, places: column.take(pa.array(np.concatenate(places) if places else np.zeros(0, np.int64)))
        asked = take(who, [np.repeat(np.arange(len(counts)), counts)])
        return pa.table([asked, take(ids, found), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=schema.names)

    # dealt anew, as the joins above may leave all rows of a tag in one task, and Spark would meet them there
    best = rows.repartition("tag", "c", "q").groupBy("tag", "c", "q").applyInArrow(meet, schema)
    best = best.withColumn("score", F.nanvl("score", F.lit(None).cast("double")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last(F.round("score", 12)), "chunk_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def grounding(hits: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """``query_id, top_score, grounded``: whether the best hit reaches ``least``."""
    return hits.groupBy("query_id").agg(F.max("score").alias("top_score")).withColumn("grounded", F.coalesce(F.col("top_score") >= least, F.lit(False)))


def fallback(mode: Column) -> Column:
    return F.when(mode == "kids", FALLBACK["kids"]).otherwise(FALLBACK["adults"])


def retry_with_rewrite(hits: DataFrame, rewrites: DataFrame, chunks: DataFrame, k: int = K, least: float = MIN_SCORE) -> DataFrame:
    """Hits after a second search of ungrounded queries that have a rewritten one (query_id, rewritten, embedding); kept only if it is grounded."""
    grounded = grounding(hits, least)
    again = rewrites.where(T.strip(F.col("rewritten")) != "").join(grounded.where("grounded").select("query_id"), "query_id", "left_anti")
    second = retrieve(chunks, again, k)
    cleared = grounding(second, least).where("grounded").select("query_id")
    return (
        hits.join(cleared, "query_id", "left_anti").withColumn("retried", F.lit(False))
        .unionByName(second.join(cleared, "query_id", "left_semi").withColumn("retried", F.lit(True)))
    )


def with_citations(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the chunk's text fields, the page label and a citation line; metadata is joined for the hits only."""
    label = T.page_label(F.col("printed_page"), F.col("page_id"))
    joined = hits.join(chunks, "chunk_id")
    return joined.withColumn("page", label).withColumn("citation", T.citation(F.col("book_title"), F.col("author"), F.col("page"), F.col("source_url")))


def format_context(hits: DataFrame) -> DataFrame:
    """``query_id, context, citations``: numbered source blocks, and the citation structs (null when there are none)."""
    block = F.concat(
        F.lit("["), F.col("rank"), F.lit("] الكتاب: "), F.col("book_title"), F.lit(" | المؤلف: "), F.col("author"), F.lit(" | الشخصية: "), F.col("character_name"),
        F.lit(" | الصفحة: "), F.col("page"), F.lit(" | الرابط: "), F.col("source_url"), F.lit("\n"), F.col("text"),
    )
    cited = F.struct(F.col("rank").alias("index"), "book_title", "author", "character", "character_name", "page", "source_url", F.col("score"))
    rows = hits.withColumn("_b", F.struct("rank", block.alias("block"), cited.alias("cited")))
    grouped = rows.groupBy("query_id").agg(F.array_sort(F.collect_list("_b")).alias("_b"))
    return grouped.select("query_id", F.array_join(F.col("_b.block"), "\n\n").alias("context"), F.when(F.size("_b") > 0, F.col("_b.cited")).alias("citations"))


# ---- approximate search ----


def _bands(size: int, tables: int, bits: int):
    """Keys of ``tables`` bands of ``bits`` signs: on which side of random hyperplanes a vector lies."""

    @F.pandas_udf("array<long>")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        planes = np.random.default_rng(7).normal(size=(size, tables * bits))
        for s in batches:
            sides = (np.array(s.tolist(), dtype=np.float64).reshape(-1, size) @ planes > 0).reshape(len(s), tables, bits)
            yield pd.Series(list((sides << np.arange(bits)).sum(axis=2) * tables + np.arange(tables)))

    return keys


def lsh_candidates(chunks: DataFrame, queries: DataFrame, tables: int = 16, bits: int = 10) -> DataFrame:
    """``query_id, chunk_id, score`` of pairs that agree in all signs of one band at least, with their cosine.

    Vectors at a cosine c agree in a sign with probability 1 - acos(c) / pi; by
    these defaults those at 0.9 meet with 0.98, and of random ones 1.5 % do.
    """
    size = chunks.where("embedding IS NOT NULL").select(F.max(F.size("embedding"))).first()[0] or 0
    band = _bands(size, tables, bits)
    keyed = lambda df, name: df.where("embedding IS NOT NULL").select(name, F.col("embedding").alias(f"{name}_v"), F.explode(band("embedding")).alias("band"))
    met = keyed(chunks, "chunk_id").join(keyed(queries, "query_id"), "band").drop("band").dropDuplicates(["query_id", "chunk_id"])
    return met.select("query_id", "chunk_id", cosine(F.col("query_id_v"), F.col("chunk_id_v")).alias("score"))


def lsh_neighbours(chunks: DataFrame, queries: DataFrame, k: int = K, tables: int = 16, bits: int = 10) -> DataFrame:
    """Approximate hits by signs of random projections: ``query_id, rank, chunk_id, score``; ``retrieve`` is the exact search."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last(F.round("score", 12)), "chunk_id"))
    return lsh_candidates(chunks, queries, tables, bits).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


class Lists:
    """Chunks in lists by their nearest centroid: ``assigned`` has (list, chunk_id, embedding), ``centroids`` a row each, of length 1."""

    def __init__(self, assigned: DataFrame, centroids: np.ndarray):
        self.assigned, self.centroids = assigned, centroids


def train_centroids(chunks: DataFrame, lists: int = LISTS, sample_rows: int = SAMPLE_ROWS, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Centroids of directions (spherical k-means) of at most ``sample_rows`` chunks of the commonest length, those whose id hashes lowest."""
    lengths = chunks.where("embedding IS NOT NULL").groupBy(F.size("embedding").alias("size")).count()
    size = lengths.orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    rows = chunks.where(F.size("embedding") == (size[0]["size"] if size else 0)).select(F.xxhash64(F.col("chunk_id").cast("string"), F.lit(seed)).alias("h"), "chunk_id", F.col("embedding").cast("array<double>").alias("embedding"))
    sample = rows.orderBy("h", "chunk_id").limit(sample_rows).select("embedding").toArrow()  # bounded by ``sample_rows``
    if not sample.num_rows:
        return np.zeros((0, 0))
    unit = np.nan_to_num(_unit(sample.column("embedding")))
    centroids = unit[np.random.default_rng(seed).permutation(len(unit))[: min(lists, len(unit))]].copy()
    for _ in range(rounds):
        own = (unit @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, unit)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centroids)
    return centroids


def _probed(df: DataFrame, centroids: np.ndarray, n: int, keep: list[str]) -> DataFrame:
    """``df`` with ``list``, a row for each of its ``n`` nearest centroids."""
    schema = StructType([StructField("list", IntegerType()), *[df.schema[c] for c in keep]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.nan_to_num(_unit(pa.chunked_array([batch.column("embedding")]))) @ centroids.T
            order = np.argsort(-near, axis=1, kind="stable")[:, :n].astype(np.int32)
            rows = np.repeat(np.arange(len(order)), order.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(order.ravel()), *[batch.column(c).take(pa.array(rows)) for c in keep]], schema.names)

    return df.where((F.size("embedding") == centroids.shape[1]) & F.col("embedding").isNotNull()).select(keep).mapInArrow(run, schema)


def build_lists(chunks: DataFrame, path: str, lists: int = LISTS, sample_rows: int = SAMPLE_ROWS) -> Lists:
    """Write every chunk (chunk_id, embedding) of the centroids' length to the list of its nearest centroid, a folder each below ``path``."""
    centroids = train_centroids(chunks, lists, sample_rows)
    rows = chunks.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"))
    if centroids.size:
        assigned = _probed(rows, centroids, 1, ["chunk_id", "embedding"])
    else:
        assigned = rows.limit(0).select(F.lit(0).alias("list"), "chunk_id", "embedding")
    assigned.hint("rebalance", F.col("list")).write.mode("overwrite").partitionBy("list").parquet(path)
    schema = StructType([*rows.schema.fields, StructField("list", IntegerType())])
    return Lists(chunks.sparkSession.read.schema(schema).parquet(path), centroids)


def probed_lists(index: Lists, queries: DataFrame, nprobe: int = NPROBE) -> DataFrame:
    """``list, query_id, embedding``: the lists that each query reads."""
    asks = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return _probed(asks, index.centroids, nprobe, ["query_id", "embedding"])


def search_lists(index: Lists, queries: DataFrame, k: int = K, nprobe: int = NPROBE) -> DataFrame:
    """Approximate hits ``query_id, rank, chunk_id, score``: the exact search of each query's ``nprobe`` nearest lists.

    Only lists that a query probes are read: they are folders, and their numbers go into the scan.
    """
    if not index.centroids.size:
        return retrieve(index.assigned, queries, k)
    probes = probed_lists(index, queries, nprobe)
    wanted = [r[0] for r in probes.select("list").distinct().collect()]  # at most as many as centroids
    # a query meets each of its lists as an own query of that list, and the best of these are its hits
    hits = retrieve(index.assigned.where(F.col("list").isin(wanted)), probes.select(F.struct("query_id", "list").alias("query_id"), "embedding", "list"), k, "list")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last(F.round("score", 12)), "chunk_id"))
    return hits.select("query_id.query_id", "chunk_id", "score").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")
