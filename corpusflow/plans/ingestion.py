"""Pages to documents, chunks and embeddings, published together.

A batch of pages is compared by content hash with the documents that are stored; only what is new or
changed is chunked, and only chunks whose text is new or changed are embedded. All of it reads and
writes the buckets that the batch touches, those without updated rows by adding to them, and one mark publishes the three tables. A unit (a character)
of which any chunk could not be embedded leaves nothing of this batch in any of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import text as T
from corpusflow.operators import chunking as C
from corpusflow.operators import embedding as E
from corpusflow.operators import merge as M
from corpusflow.plans.staging import Staging
from corpusflow.sources.pages import split_identity_rejects
from corpusflow.sources.snapshots import BUCKETS, SnapshotStore

KEYS = ["book_id", "page_id"]
TABLES = {"documents": ["document_id"], "chunks": ["document_id"], "embeddings": ["document_id"]}
Provider = Callable[[list[str]], list[list[float]]]


def corpus_store(spark: SparkSession, path: str, buckets: int = BUCKETS, keep: int = 2) -> SnapshotStore:
    return SnapshotStore(spark, path, TABLES, buckets, keep)


def last_versions(batch: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per key: the last in ``order``, of equals the one with the largest hash. Without ``order`` two texts of one key are an error."""
    text_hash = F.coalesce("content_hash", F.lit(""))
    row = F.max_by(F.struct(*batch.columns), F.struct(*(order or []), text_hash))
    if not order:
        two = F.raise_error(F.lit(f"two versions of one key ({', '.join(keys)}) in a batch; name the columns that order them"))
        row = F.when(F.min(text_hash) == F.max(text_hash), row).otherwise(two.cast(batch.schema))
    return batch.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(row.alias("_p")).select("_p.*")


def one_version(staging: Staging, batch: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """``last_versions`` that moves no row whose key is in the batch once."""
    many = staging.table(batch.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys), "many")
    if many.isEmpty():
        return batch
    stayed, moved = M.rows_without(batch, many, keys)
    return stayed.unionByName(moved).unionByName(last_versions(M.rows_of(batch, many, keys), keys, order))


class Comparison:
    """A batch against a table of a store by content hash, on keys and hashes alone; texts move once, into the version to come.

    ``plan`` has keys, content_hash, order and ``_action`` of the batch's rows. ``put`` writes those that are new or updated, ``replace`` what
    becomes of the buckets in which rows are updated. Buckets with new rows only are not rewritten. The batch is read several times.
    """

    def __init__(self, staging: Staging, store: SnapshotStore, table: str, batch: DataFrame, keys: list[str], order: list[str] | None, newer_only: bool):
        self.staging, self.store, self.table, self.keys, self.order = staging, store, table, keys, order or []
        self.touched = store.touched(batch, table)
        self.source = one_version(staging, batch, keys, order)
        self.stored = store.read(table, self.touched) if store.exists() else batch.limit(0)
        narrow = list(dict.fromkeys([*keys, "content_hash", *self.order]))
        source, target = self.source.select(*narrow), self.stored.select(*narrow)
        newer_only = bool(order) and newer_only and store.exists()
        if newer_only:
            s, t = source.alias("s"), target.alias("t")
            older = F.struct(*[F.col(f"s.{c}") for c in order]) < F.struct(*[F.col(f"t.{c}") for c in order])
            source = s.join(t, [*self._same("s", "t"), older], "left_anti")
        self.plan = staging.table(M.merge_documents(source, target, keys, refresh=order).where("_action <> 'kept'"), "plan")
        self.actions = {r["_action"]: r["count"] for r in self.plan.groupBy("_action").count().collect()}
        self.all_new = set(self.actions) <= {"new"} and not newer_only
        self.number = store.begin()

    def _same(self, a: str, b: str) -> list[Column]:
        return [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in self.keys]

    def put(self) -> DataFrame:
        """New and updated rows with ``_action``, as they lie in the store."""
        rows = self.source.select(*self.stored.columns)
        if self.all_new:
            rows = rows.withColumn("_action", F.lit("new"))
        else:
            rows = M.rows_of(rows, self.plan.where("_action IN ('new', 'updated')").select(*self.keys, "_action"), self.keys)
        self.part = self.store.put(self.number, self.table, self.table, rows)
        return self.store.read_folders(list(self.part.values()), rows.schema)

    def moved(self) -> DataFrame:
        """Keys and order of unchanged rows that are stored with another place in the order."""
        same = self.plan.where("_action = 'unchanged'").select(*self.keys, *self.order)
        if not self.order:
            return same.limit(0)
        s, t = same.alias("s"), self.stored.alias("t")
        other = ~F.struct(*[F.col(f"s.{c}") for c in self.order]).eqNullSafe(F.struct(*[F.col(f"t.{c}") for c in self.order]))
        return s.join(t, [*self._same("s", "t"), other], "left_semi")

    def replace(self, updated: DataFrame, dependent: list[str]) -> tuple[set[int], dict[str, list[dict[int, str]]]]:
        """The buckets that are rewritten, and of each table what they keep: all but the rows of ``updated`` (keys), here also those that have moved in the order, which are written with their new place."""
        store, keys = self.store, self.keys
        moved = self.staging.table(self.moved(), "moved")
        replaced = set(store.touched(updated, self.table)) | set(store.touched(moved, self.table))
        for table in (self.table, *dependent):
            replaced |= store.full(table) & set(self.touched)
        parts: dict[str, list[dict[int, str]]] = {table: [] for table in (self.table, *dependent)}
        if replaced:
            gone = self.staging.table(updated.select(*keys).unionByName(moved.select(*keys)), "gone")
            for table in parts:
                stayed, shuffled = M.rows_without(store.read(table, sorted(replaced)), updated if table != self.table else gone, keys)
                parts[table] += [store.put(self.number, table, f"{table}-stayed", stayed, deal=False), store.put(self.number, table, f"{table}-kept", shuffled)]
            if self.order:
                again = M.rows_of(self.stored.drop(*self.order), moved, keys).select(*self.stored.columns)
                parts[self.table].append(store.put(self.number, self.table, f"{self.table}-moved", again))
        return replaced, parts


def ingest_pages(
    store: SnapshotStore, pages: DataFrame, provider: Provider, order: list[str] | None = None, unit: str | None = None, carry: tuple[str, ...] = ("character_id", "page_id"),
    most: int = C.MAX_TOKENS, overlap: int = C.OVERLAP, least: int = C.MIN_TOKENS, batch: int = E.BATCH, newer_only: bool = False, log: str | None = None,
) -> DataFrame:
    """Ingest ``pages`` (book_id, page_id, character_id, character_name, text, ...) into a ``corpus_store``; one row of counters.

    Of a page's versions the last in ``order`` counts; with ``newer_only`` one that is older in it than the
    stored one is left out. Chunks carry the columns of ``carry``. Without
    ``unit`` a failing call of ``provider`` fails the batch; else the values of that column stand or fall alone, and pages of those that
    fail stay as they were stored. Pages that were stored and are not in the batch are kept. With ``log`` vectors go into a log in that
    folder as calls end, and what it has is not called again, so a run that stopped goes on where it was.
    """
    spark = store.spark
    place, key = ["document_id", "chunk_index", "chunk_hash"], ["document_id"]
    with Staging(spark) as staging:
        good, rejects = split_identity_rejects(pages)
        hashed = good.withColumn("content_hash", T.content_hash(F.col("text"))).withColumn("document_id", M.document_id(*KEYS))
        own = Comparison(staging, store, "documents", hashed, key, order, newer_only)
        number, had = own.number, store.exists()
        changed = own.put()

        # changed documents lie by buckets, so their chunks do, where they are made
        cleaned = changed.select("document_id", *carry, "_action", T.clean_text(F.col("text")).alias("text"))
        cut = C.chunk_text(cleaned, most=most, overlap=overlap, least=least).withColumn("chunk_hash", T.content_hash(F.col("chunk_text")))
        parts = {"documents": [own.part], "chunks": [store.put(number, "chunks", "chunks", cut, deal=False)]}
        schemas = {"documents": own.stored.schema, "chunks": cut.drop("_action").schema}
        cut = store.read_folders(list(parts["chunks"][0].values()), cut.schema)
        # what is updated meets its stored chunks; what is new has none
        updated = staging.table(changed.where("_action = 'updated'").select("document_id"), "updated")
        wide = [*place, "chunk_text", *([unit] if unit in carry else []), "embedding", "_action"]
        pending = cut.where("_action = 'new'").withColumn("embedding", F.lit(None).cast("array<float>")).select(*wide)
        gone = cut.limit(0).select("document_id", "_action")
        if own.actions.get("updated"):
            now = cut.where("_action = 'updated'").drop("_action").withColumn("embedding", F.lit(None).cast("array<float>"))
            old = M.rows_of(store.read("embeddings", store.touched(updated, "documents")), updated, key)
            old = old.select([F.col(c) if c in old.columns else F.lit(None).cast(now.schema[c].dataType).alias(c) for c in wide if c != "_action"])
            merged = M.merge_chunks(now.select(*old.columns), old)
            merged = merged.withColumn("_action", F.when(F.col("_action") == "kept", "deleted").otherwise(F.col("_action")))  # its document has no chunks any more
            # an unchanged chunk is needed for its vector only
            merged = staging.table(store.dealt("chunks", merged.select(*wide)), "merged")
            pending = pending.unionByName(merged.where("_action <> 'deleted'"))
            gone = merged.where("_action = 'deleted'").select("document_id", "_action")
        whose = F.col(unit) if unit in carry else F.lit(None).cast("string")
        tagged = pending.withColumn("_unit", whose)
        if unit and unit not in carry:
            tagged = pending.join(changed.select("document_id", F.col(unit).alias("_unit")), "document_id")
        asked = F.col("_action").isin("new", "updated")
        if log:
            logged = E.answer_logged(tagged.where(asked).drop("embedding"), provider, "chunk_text", log, batch=batch).withColumnRenamed("answer", "embedding")
            called = logged.withColumn("error", F.when(F.col("embedding").isNull(), "no answer"))
            called = called.unionByName(tagged.where(~asked).withColumn("error", F.lit(None).cast("string")))
        else:
            called = E.embed_pending(tagged.select(*[c for c in tagged.columns if c != unit]), provider, "chunk_text", batch, within="_unit" if unit else None)
        called = called.select(*place, F.col("embedding").cast("array<float>").alias("embedding"), "_unit", "_action", "error")
        parts["embeddings"] = [store.put(number, "embeddings", "embeddings", called, deal=bool(log))]
        schemas["embeddings"] = called.select(*place, "embedding").schema
        embedded = store.read_folders(list(parts["embeddings"][0].values()), called.schema)
        failures = embedded.where("error IS NOT NULL")
        failing = not failures.isEmpty()
        if failing and not unit:
            raise RuntimeError(f"embedding failed: {failures.select('error').first()[0]}")
        failed = failures.select(F.col("_unit").alias("_failed")).distinct()
        if failing:
            # documents that failed stay as they were before
            lost = staging.table(changed.join(failed, F.col(unit) == F.col("_failed"), "left_semi").select("document_id"), "lost")
            for table, made in (("documents", changed), ("chunks", cut), ("embeddings", embedded)):
                stayed, shuffled = M.rows_without(made, lost, key)
                parts[table] = [store.put(number, table, f"{table}-good", stayed, deal=False), store.put(number, table, f"{table}-sound", shuffled)]
            updated = staging.table(updated.join(lost, "document_id", "left_anti"), "published")
        if had:
            replaced, kept = own.replace(updated, ["chunks", "embeddings"])
            parts = {table: made + kept[table] for table, made in parts.items()}
        else:
            replaced = set()
        characters = None
        if unit:
            every = changed.select(F.col(unit).alias("_u")).distinct()
            characters = every.join(failed, F.col("_u") == F.col("_failed"), "left").select(F.col("_failed").isNotNull().alias("failed"))
        done = embedded.select("document_id", "_action", (asked & F.col("error").isNull()).alias("_done")).unionByName(gone.withColumn("_done", F.lit(False)))
        stats = M.ingestion_stats(own.plan, done, rejects, characters, batch, embedded="_done")
        counters = spark.createDataFrame(stats.collect(), stats.schema)  # one row, as its tables are about to go
        store.publish(number, parts, schemas, replaced)
        if failing:
            for table in parts:
                store.drop(number, table)
        return counters


def ingest_missing_characters(store: SnapshotStore, pages: DataFrame, provider: Provider, **settings) -> DataFrame:
    """Ingest the characters of ``pages`` (with dataset_dir) that have no stored document, each by itself; one row of counters.

    A character of several datasets comes from the first by name. Those that are stored are not looked at, whatever their pages hold.
    """
    known = store.read("documents").select(F.col("character_id").alias("caliph_id")) if store.exists() else pages.limit(0).select(F.col("character_id").alias("caliph_id"))
    absent = M.missing_characters(pages, known).select("character_id", "dataset_dir")
    nobody = pages.where("character_id IS NULL OR character_id = ''")
    return ingest_pages(store, pages.join(absent, ["character_id", "dataset_dir"], "left_semi").unionByName(nobody.select(pages.columns)), provider, unit="character_id", **settings)
