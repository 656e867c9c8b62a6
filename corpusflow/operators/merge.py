"""Changes by content hash: what is new, updated, unchanged or gone.

Both sides are joined once on their key. The result carries the action, so
that costly steps (chunking, embedding) run on changed rows only, and counters
come from the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions import text as T

#: Numbers of the filter that is broadcast.
MARKS = 1 << 22


def document_id(*keys: str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).cast("binary"), 256)


def dedupe_source_pages(pages: DataFrame, keys: list[str], order: list[str], hash_col: str = "content_hash") -> DataFrame:
    """The last row of each key in ``order``, with ``n_seen`` and how often a later row differs from the one before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.when(~F.col(hash_col).eqNullSafe(F.lag(hash_col).over(w)) & (F.row_number().over(w) > 1), 1).otherwise(0)
    whole = Window.partitionBy(*keys)
    ranked = pages.withColumn("_r", F.row_number().over(w)).withColumn("_n", F.count("*").over(whole)).withColumn("_c", changed)
    ranked = ranked.withColumn("n_changes", F.sum("_c").over(whole))
    return ranked.where("_r = _n").withColumn("n_seen", F.col("_n")).drop("_r", "_n", "_c")


def merge_documents(source: DataFrame, target: DataFrame, keys: list[str], hash_col: str = "content_hash", delete_missing: bool = False, refresh: list[str] | None = None) -> DataFrame:
    """``target`` after ``source`` with ``_action``: new, updated, unchanged, kept (only in target) or deleted.

    Changed rows take all columns of the source, unchanged ones keep the target's,
    but for the columns in ``refresh``.
    """
    s, t = source.alias("s"), target.alias("t")
    on = [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    s_in, t_in = F.col("s._in").isNotNull(), F.col("t._in").isNotNull()
    joined = source.withColumn("_in", F.lit(1)).alias("s").join(target.withColumn("_in", F.lit(1)).alias("t"), on, "full_outer")
    same = F.col(f"s.{hash_col}").eqNullSafe(F.col(f"t.{hash_col}"))
    action = F.when(s_in & ~t_in, "new").when(s_in & t_in & ~same, "updated").when(s_in & t_in, "unchanged").otherwise("deleted" if delete_missing else "kept")
    fresh = s_in & (~t_in | ~same)
    columns = [F.when(s_in & F.lit(c in (refresh or [])) | fresh, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in target.columns]
    return joined.select(*columns, action.alias("_action"))


def _marked(df: DataFrame, ids: DataFrame, keys: list[str], how: str) -> DataFrame:
    mark = F.pmod(F.xxhash64(*keys), F.lit(MARKS)).alias("_mark")
    return df.withColumn("_mark", mark).join(F.broadcast(ids.select(mark).distinct()), "_mark", how).drop("_mark")


def _same_keys(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    joined = a.alias("a").join(b.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], how)
    return joined.select("a.*", *[f"b.{c}" for c in b.columns if c not in keys]) if how == "inner" else joined


def rows_of(df: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose keys are in ``ids`` (a staged table, keys once each), with the other columns of ``ids``.

    Rows that cannot be meant stay where they are: a filter by a hash of the keys, at most ``MARKS`` numbers, is broadcast, and only what it passes is shuffled to be compared.
    """
    return _same_keys(_marked(df, ids, keys, "left_semi"), ids, keys, "inner")


def rows_without(df: DataFrame, ids: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose keys are not in ``ids``, as two tables: those that have stayed in their tasks and those that were shuffled."""
    return _marked(df, ids, keys, "left_anti"), _same_keys(_marked(df, ids, keys, "left_semi"), ids, keys, "left_anti")


def merge_chunks(new: DataFrame, old: DataFrame, keys: tuple[str, str] = ("document_id", "chunk_index")) -> DataFrame:
    """Chunks of changed documents against stored ones: new, updated (embedding cleared), unchanged, deleted, or kept (document not in ``new``)."""
    doc, index = keys
    touched = new.select(doc).distinct().withColumn("_touched", F.lit(True))
    n = new.withColumn("_in", F.lit(1)).alias("n")
    o = old.join(touched, doc, "left").withColumn("_in", F.lit(1)).alias("o")
    joined = n.join(o, [F.col(f"n.{doc}") == F.col(f"o.{doc}"), F.col(f"n.{index}") == F.col(f"o.{index}")], "full_outer")
    n_in, o_in = F.col("n._in").isNotNull(), F.col("o._in").isNotNull()
    same = F.col("n.chunk_hash").eqNullSafe(F.col("o.chunk_hash"))
    action = F.when(n_in & ~o_in, "new").when(n_in & ~same, "updated").when(n_in, "unchanged").when(F.col("o._touched"), "deleted").otherwise("kept")
    columns = [F.when(n_in & ~(o_in & same), F.col(f"n.{c}") if c in new.columns else F.lit(None)).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns]
    return joined.select(*columns, action.alias("_action"))


def ingestion_stats(documents: DataFrame, chunks: DataFrame, rejects: DataFrame | None = None, characters: DataFrame | None = None, batch: int = 64, embedded: str | None = None) -> DataFrame:
    """One row of 14 counters from the actions of both merges.

    ``rejects`` are pages without an identity, ``characters`` (failed) those that
    were looked at for missing ones. A document's chunks are embedded in calls of ``batch``; ``embedded`` names
    a column of ``chunks`` that says which were, by default all that are new or updated.
    """
    count = lambda kind, *actions: F.count_if(F.col("_action").isin(*actions)).alias(kind)
    d = documents.agg(count("pages_seen", "new", "updated", "unchanged"), count("pages_new", "new"), count("pages_updated", "updated"), count("pages_unchanged", "unchanged"))
    kinds = [(f"chunks_{k}", k) for k in ("new", "updated", "unchanged", "deleted")]
    by_document = chunks.groupBy("document_id").agg(*[count(*k) for k in kinds], F.count_if(F.col(embedded)).alias("embedded_chunks") if embedded else count("embedded_chunks", "new", "updated"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    c = by_document.agg(*[total(k, k) for k, _ in kinds], total(F.ceil(F.col("embedded_chunks") / batch), "embedding_calls"), total("embedded_chunks", "embedded_chunks"))
    rows = lambda df, *columns: df.agg(*columns) if df is not None else documents.limit(0).agg(*[F.lit(0).cast("long").alias(n) for n in ("characters_checked", "characters_added", "characters_failed")])
    who = rows(characters, F.count("*").alias("characters_checked"), F.count_if(~F.col("failed")).alias("characters_added"), F.count_if("failed").alias("characters_failed"))
    skipped = (rejects if rejects is not None else documents.limit(0)).agg(F.count("*").alias("pages_skipped"))
    names = ["pages_seen", "pages_skipped", "pages_new", "pages_updated", "pages_unchanged", *[k for k, _ in kinds], "embedding_calls", "embedded_chunks", "characters_checked", "characters_added", "characters_failed"]
    return d.crossJoin(skipped).crossJoin(c).crossJoin(who).select(*names)  # one row each


def missing_characters(source: DataFrame, documents: DataFrame) -> DataFrame:
    """Characters of the source without a stored document; of several datasets the first by name."""
    absent = source.join(documents.select(F.col("caliph_id").alias("character_id")).distinct(), "character_id", "left_anti")
    return absent.groupBy("character_id").agg(F.min("dataset_dir").alias("dataset_dir"), F.count("*").alias("n_pages"))


def delete_character(documents: DataFrame, chunks: DataFrame, character_id: str) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks without a character's."""
    left = documents.where(~F.col("caliph_id").eqNullSafe(F.lit(character_id)))
    return left, chunks.join(left.select("document_id"), "document_id", "left_semi")


def delete_preview(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per character what a delete would take: documents, chunks, one name."""
    counted = chunks.groupBy("document_id").agg(F.count("*").alias("c"))
    return documents.join(counted, "document_id", "left").groupBy("caliph_id").agg(
        F.count("*").alias("n_documents"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_chunks"), F.min_by("caliph_name", "page_id").alias("caliph_name")
    )


def content_hash(df: DataFrame, text: str = "text", to: str = "content_hash") -> DataFrame:
    return df.withColumn(to, T.content_hash(F.col(text)))
