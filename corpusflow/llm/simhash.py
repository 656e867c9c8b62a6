"""SimHash near-duplicates by a segment-popcount embedding.

A text's fingerprint has a bit for each bit of its word shingles' 64-bit hashes,
set where more than half of these have it. Fingerprints that differ in at most
``MOST`` bits link, and documents in one component of links are near-duplicates.

A fingerprint is cut into segments of two bits, and its point is the number of bits set in
each. Two fingerprints differ in at least as many bits as the Manhattan distance of their
points, so links lie within ``MOST`` of each other on that grid. One half of the segments then holds at most
half of the distance: on the grid of this half both points are within half of that of
a common cell. Each fingerprint is sent to its own cell and those one step (``STEPS``) away,
33 at most for each half, and what meets in a cell is verified exactly.

A cell's fingerprints are compared in tasks that read sorted cells: small cells pair by pair,
larger ones by a search from the frontier of what is linked, which looks at those
only that it has not reached. Out go stars, a row for each linked fingerprint, never pairs. A cell of more than
``CELL`` fingerprints is read through without being held and goes on to a finer grid, with the cells
of the other half's quarters (one of the two holds half of what distance is left), and what is still larger is cut into
blocks, each pair of which meets in a task. No cell is capped.

Equal fingerprints become one before all this, so copies cost a row each, once.

Defined cases: a text of fewer words than a shingle is one shingle of all of them; without words, empty or null,
its fingerprint is zero, linked like any other; rows with one doc_id are documents
each; a null doc_id counts only where a component has no other; very long texts are whole;
an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import documents, shuffle_partitions, slices, utf8
from corpusflow.llm.graph import components
from corpusflow.plans.staging import Staging

WORDS, SEED = 4, 42
MOST, STEPS = 4, 1
#: Fingerprints of a cell that one task holds; of a block of a larger one; of a cell that is compared pair by pair.
CELL, BLOCK, PAIRED = 1 << 15, 1 << 14, 512
#: Shingles of one text, and pairs, that are looked at together.
_SHINGLES, _PAIRS = 1 << 16, 1 << 20
_ODD = np.uint64(0x5555555555555555)


def bit_counts(words: list[bytes], size: int = WORDS, seed: int = SEED) -> tuple[np.ndarray, int]:
    """How many hashes of the shingles of ``words`` have each bit (the lowest first), and how many there are."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    count = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _SHINGLES):
        i, j = starts[at : min(n, at + _SHINGLES)].tolist(), ends[min(size, len(words)) - 1 + at :][:_SHINGLES].tolist()
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(i, j, strict=False)], dtype=np.uint64)
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return count, n


def fingerprint(text: bytes, size: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint of a text in UTF-8, A-Z lower-cased and cut at ASCII white space."""
    words = text.lower().split()  # of bytes: both know ASCII alone
    if not words:
        return 0
    count, n = bit_counts(words, size, seed)
    return int(np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, fp`` of every row of ``docs`` (doc_id, text); ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                raw, at = utf8(batch.column("text"))
                raw = raw.tobytes()
                found = np.array([fingerprint(raw[i:j], size, seed) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def embedded(fp: np.ndarray) -> np.ndarray:
    """The points of fingerprints: 32 fields of two bits, each the number of bits set in its segment."""
    return (fp & _ODD) + ((fp >> np.uint64(1)) & _ODD)


def cells(fp: np.ndarray, low: int, fields: int) -> tuple[np.ndarray, np.ndarray]:
    """``row, cell``: the cells of the grid of ``fields`` segments from ``low`` on that are within a step of each point."""
    point = (embedded(fp) >> np.uint64(2 * low)) & np.uint64((1 << 2 * fields) - 1)
    rows, found = [np.arange(len(fp))], [point]
    for f in range(fields):
        one = np.uint64(1 << 2 * f)
        here = (point >> np.uint64(2 * f)) & np.uint64(3)
        for stays, moved in ((here < 2, point + one), (here > 0, point - one)):  # a cell between two points is between their values
            rows.append(np.flatnonzero(stays))
            found.append(moved[stays])
    return np.concatenate(rows), np.concatenate(found)


def _first_cells(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``row, key``: a fingerprint's cells on the grids of both halves; a key holds the half and the cell."""
    both = [cells(fp, 16 * half, 16) for half in (0, 1)]
    return np.concatenate([b[0] for b in both]), np.concatenate([(b[1] << np.uint64(1)) | np.uint64(half) for half, b in enumerate(both)])


def _finer_cells(fp: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``_first_cells``, of rows that have met in ``key``: with the cells of each quarter of the half that it does not hold."""
    rows, keys = [], []
    for half in (0, 1):
        own = np.flatnonzero((key & np.uint64(1)) == half)
        for quarter in (0, 1):
            row, cell = cells(fp[own], 16 * (1 - half) + 8 * quarter, 8)
            rows.append(own[row])
            keys.append((((key[own][row] << np.uint64(1)) | np.uint64(quarter)) << np.uint64(16)) | cell)
    return np.concatenate(rows), np.concatenate(keys)


def _stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest row of each row's component, of ``n`` rows with links ``a, b``."""
    top = np.arange(n)
    while True:
        least = np.minimum(top[a], top[b])
        now = top.copy()
        np.minimum.at(now, top[a], least)
        np.minimum.at(now, top[b], least)
        now = now[now]
        if (now == top).all():
            return top
        top = now


def _paired(fp: np.ndarray, start: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """Stars (the row that each row links to, itself if none) of small cells, every pair of which is compared, some at once."""
    row = np.arange(size.sum()) + np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size)
    later = np.repeat(start + size, size) - row - 1  # rows of the cell behind each
    top = np.arange(len(fp))
    ends = np.cumsum(later)
    at = 0
    while at < len(row):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, side="right")))
        n = later[at:stop]
        a = np.repeat(row[at:stop], n)
        b = a + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + 1
        linked = np.bitwise_count(fp[a] ^ fp[b]) <= most
        if linked.any():
            top = _joined(top, a[linked], b[linked])
        at = stop
    return top


def _joined(top: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    own = np.flatnonzero(top != np.arange(len(top)))
    return _stars(np.concatenate((a, own)), np.concatenate((b, top[own])), len(top))


def _reached(fp: np.ndarray, most: int) -> np.ndarray:
    """Stars of one larger cell, by search: what a frontier reaches is not looked at again."""
    top, left = np.arange(len(fp)), np.arange(len(fp))
    while len(left):
        first, frontier, left = left[0], left[:1], left[1:]
        while len(frontier) and len(left):
            some = frontier[: max(1, _PAIRS // len(left))]
            hit = (np.bitwise_count(fp[some][:, None] ^ fp[left][None, :]) <= most).any(axis=0)
            top[left[hit]] = first
            frontier = np.concatenate((frontier[len(some) :], left[hit]))
            left = left[~hit]
    return top


def linked_in_cells(keyed: DataFrame, keys: list[str], most: int = MOST, cell: int = CELL) -> DataFrame:
    """``a, b, key`` of fingerprints (``fp``) dealt by ``keys``: with a null ``key`` a link of a star, else ``a`` of a cell that is too large to be held.

    ``keyed`` has no fingerprint twice in a cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        large = None  # the cell that is being read through
        names = ["a", "b", "key"]

        def links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            fp = rows.column("fp").to_numpy().view(np.uint64)
            change = np.zeros(len(fp), dtype=bool)
            for k in keys:
                v = rows.column(k).to_numpy()
                change[1:] |= v[1:] != v[:-1]
            start = np.concatenate(([0], np.flatnonzero(change)))
            size = np.diff(np.append(start, len(fp)))
            small = (size > 1) & (size <= PAIRED)
            top = _paired(fp, start[small], size[small], most)
            for s, n in zip(start[size > PAIRED].tolist(), size[size > PAIRED].tolist(), strict=True):
                top[s : s + n] = s + _reached(fp[s : s + n], most)
            a = np.flatnonzero(top != np.arange(len(top)))
            a, b = fp[a].view(np.int64), fp[top[a]].view(np.int64)
            both = np.unique(np.stack((np.maximum(a, b), np.minimum(a, b))), axis=1)  # cells repeat what near ones have found
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.nulls(both.shape[1], pa.int64())], names)

        def passed(batch: pa.RecordBatch) -> pa.RecordBatch:
            none = pa.nulls(batch.num_rows, pa.int64())
            return pa.RecordBatch.from_arrays([batch.column("fp"), none, batch.column(keys[0])], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [batch.column(k).to_numpy() for k in keys]
            last = tuple(v[-1] for v in ids)
            same = np.logical_and.reduce([v == v[-1] for v in ids])
            begins = int(np.argmax(same))  # where the batch's last cell begins
            if large is not None:
                ends = int(np.argmin(np.append(np.logical_and.reduce([v == x for v, x in zip(ids, large, strict=True)]), False)))
                if ends:
                    yield passed(batch.slice(0, ends))
                if ends == batch.num_rows:
                    continue
                large, batch, begins = None, batch.slice(ends), max(0, begins - ends)
            if begins or (held and tuple(held[-1].column(k)[-1].as_py() for k in keys) != last):
                held.append(batch.slice(0, begins))
                yield from links(pa.Table.from_batches(held).combine_chunks())
                held = []
            held.append(batch.slice(begins))
            if len(keys) == 1 and sum(b.num_rows for b in held) > cell:  # ``held`` is one cell, as yet
                for b in held:
                    yield passed(b)
                held, large = [], last
        if held:
            yield from links(pa.Table.from_batches(held).combine_chunks())

    dealt = keyed.repartition(shuffle_partitions(keyed.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.select("fp", *keys).mapInArrow(run, "a long, b long, key long")


def _keyed(rows: DataFrame, finer: bool) -> DataFrame:
    """``key, fp``: rows for each cell of fingerprints (``fp``, and with ``finer`` the ``key`` of a cell)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            row, key = _finer_cells(fp, batch.column("key").to_numpy().view(np.uint64)) if finer else _first_cells(fp)
            out = pa.table([pa.array(key.view(np.int64)), pa.array(fp[row].view(np.int64))], names=["key", "fp"])
            yield from out.to_batches(max_chunksize=50_000)

    return rows.select("fp", *(["key"] if finer else [])).mapInArrow(run, "key long, fp long")


def _blocked(rows: DataFrame, block: int) -> DataFrame:
    """``key, i, j, fp``: cells (``key, fp``) cut into blocks of about ``block`` rows, each sent once for each block that it meets, its own included."""
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    dealt = rows.join(sizes, "key").withColumn("own", own).select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    return dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")


def links(fps: DataFrame, staging: Staging, most: int = MOST, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """``a, b`` that connect what links of at most ``most`` bits connect, of distinct fingerprints (``fp``)."""
    if most > 4 * STEPS + 1:
        raise ValueError(f"cells {STEPS} step apart find links of at most {4 * STEPS + 1} bits")
    found = []
    rows, keyed = fps, _keyed(fps, False)
    for level in (0, 1):
        made = staging.table(linked_in_cells(keyed, ["key"], most, cell), f"links-{level}")
        found.append(made.where("key IS NULL").select("a", "b"))
        rows = made.where("key IS NOT NULL").select("key", F.col("a").alias("fp"))
        if rows.isEmpty():
            break
        keyed = _keyed(rows, True)
    else:
        found.append(staging.table(linked_in_cells(_blocked(rows, block), ["key", "i", "j"], most), "links-2").select("a", "b"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def near_duplicates(docs: DataFrame, staging: Staging | None = None, most: int = MOST, size: int = WORDS, seed: int = SEED, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs`` (doc_id, text); the id is the component's smallest doc_id."""
    staging = staging or Staging(docs.sparkSession)
    marks = staging.table(fingerprints(docs, size, seed), "fingerprints")
    first = staging.table(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    tied = components(links(first.select("fp"), staging, most, cell, block), staging)
    ends = tied.select(F.col("a").alias("fp"), F.col("b").alias("top")).unionByName(tied.select(F.col("b").alias("fp"), F.col("b").alias("top")).distinct())
    least = staging.table(ends.join(first, "fp").groupBy("top").agg(F.min("first").alias("component_id")), "components")
    of = first.join(ends.join(least, "top").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return marks.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
