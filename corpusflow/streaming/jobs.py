"""Structured Streaming jobs: incremental ingest, sentence segments of token streams, delta stripping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusflow.functions import text as T
from corpusflow.plans.ingestion import Comparison, Provider, ingest_pages, last_versions  # noqa: F401 - the tests take it from here
from corpusflow.plans.staging import Staging
from corpusflow.sources.snapshots import SnapshotStore

MOST_CHARS = 300
ENDS = ".!؟\n"


def incremental_ingest(
    stream: DataFrame, store: SnapshotStore, table: str, keys: list[str], checkpoint: str, changed: Callable[[DataFrame, int], None] | None = None, order: list[str] | None = None
) -> StreamingQuery:
    """Merge each batch of pages into a table of a store by content hash; ``changed`` gets the new and updated rows, once each.

    A batch reads and writes the buckets of its own keys only, and rewrites those with updated rows; the table is bucketed by ``keys``. Of the versions of a page the
    last in ``order`` (columns, such as a file and a line, or a time) stays, in a batch and against the table, so the table does
    not depend on how the stream is cut. Without ``order`` a later batch wins, and
    two texts of one page in a batch are an error. A batch that is repeated after
    a failure finds its rows unchanged.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        with Staging(batch.sparkSession) as staging:
            own = Comparison(staging, store, table, batch.withColumn("content_hash", T.content_hash(F.col("text"))), keys, order, newer_only=True)
            if not own.touched:
                return
            had, rows = store.exists(), own.put()
            if changed:
                changed(rows, epoch)
            updated = staging.table(own.plan.where("_action = 'updated'").select(*keys), "updated")
            replaced, kept = own.replace(updated, []) if had else (set(), {table: []})
            store.publish(own.number, {table: [own.part, *kept[table]]}, {table: own.stored.schema}, replaced)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def corpus_ingest(stream: DataFrame, store: SnapshotStore, provider: Provider, checkpoint: str, order: list[str] | None = None, counted: Callable[[DataFrame, int], None] | None = None, **settings) -> StreamingQuery:
    """``ingest_pages`` for each batch of a stream of pages: documents, chunks and embeddings under one mark; ``counted`` gets each batch's counters."""

    def ingest(batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():
            return
        counters = ingest_pages(store, batch, provider, order, newer_only=bool(order), **settings)
        if counted:
            counted(counters, epoch)

    return stream.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cut_segments(buffer: str, most: int = MOST_CHARS) -> tuple[list[str], str]:
    """Complete segments of a buffer and what is left: ends of sentences cut, and a tail longer than ``most`` is cut at its last blank."""
    out, start = [], 0
    for i, c in enumerate(buffer):
        if c in ENDS:
            out.append(buffer[start : i + 1])
            start = i + 1
    rest = buffer[start:]
    while len(rest) > most:
        at = rest.rfind(" ", 0, most + 1)
        at = at if at > 0 else most
        out.append(rest[:at])
        rest = rest[at:].lstrip(" ")
    return [s for s in (x.strip() for x in out) if s], rest


class Segmenter(StatefulProcessor):
    """State of one generation: text not yet cut with the next place and the number of segments, and by place the pieces that came early.

    All of it goes by itself: ``stale_ms`` after its last change, or, when the last piece has been cut, at once, but for a mark
    that stays for ``finished_ms`` and lets pieces that come again do nothing. After that the id may name another generation.
    """

    def __init__(self, finished_ms: int = 300_000, stale_ms: int = 900_000):
        self.finished_ms, self.stale_ms = finished_ms, stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "buffer string, next long, n long, last long", self.stale_ms)
        self.early = handle.getMapState("early", "seq long", "piece string", self.stale_ms)
        self.finished = handle.getValueState("finished", "n long", self.finished_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        if self.finished.exists():
            return
        buffer, place, n, last = self.open.get() if self.open.exists() else ("", 0, 0, -1)
        came: dict[int, str] = {}
        for frame in rows:
            for seq, piece, final in zip(frame["seq"], frame["piece"], frame["final"], strict=True):
                if seq >= place:
                    came[int(seq)] = "" if piece is None or piece != piece else piece  # a null piece has no text
                if final is True or final == 1:
                    last = int(seq)
        while place in came or self.early.containsKey((place,)):
            if place in came:
                buffer += came.pop(place)
            else:
                buffer += self.early.getValue((place,))[0]
                self.early.removeKey((place,))
            place += 1
        segments, buffer = cut_segments(buffer)
        if 0 <= last < place:
            segments += [buffer.strip()] if buffer.strip() else []
            self.open.clear()
            self.early.clear()
            self.finished.update((n + len(segments),))
        else:
            self.open.update((buffer, place, n + len(segments), last))
            for seq, piece in came.items():
                self.early.updateValue((seq,), (piece,))
        if segments:
            yield pd.DataFrame([(key[0], n + i, s) for i, s in enumerate(segments)], columns=["generation_id", "segment", "text"])

    def close(self) -> None:
        pass


def segment_stream(pieces: DataFrame, finished_ms: int = 300_000, stale_ms: int = 900_000) -> DataFrame:
    """``generation_id, segment, text`` from a stream of pieces (generation_id, seq, piece, final), in any order; needs the RocksDB state store."""
    cutter = Segmenter(finished_ms, stale_ms)
    cut = pieces.groupBy("generation_id").transformWithStateInPandas(cutter, "generation_id string, segment long, text string", "Append", "ProcessingTime")
    return cut.withColumn("text", T.strip_citation_markers(F.col("text"))).where("text <> ''")


def strip_deltas(stream: DataFrame, column: str = "piece") -> DataFrame:
    """Diacritics off each piece of a stream: per piece is the same as on the whole."""
    return stream.withColumn(column, T.strip_diacritics(F.col(column)))
