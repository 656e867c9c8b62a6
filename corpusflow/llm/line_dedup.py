"""Line deduplication by pairwise alignment.

The result is that of aligning each document with every earlier one that shares lines
with it, by patience diff (anchors are lines that occur once in both, the rarest
common line where there is none), and deleting the aligned common blocks of
``min_chars`` characters from the later document, the one with the larger doc_id. Pairs that can change
nothing are not aligned, however many documents hold a line:

* Rows with the same lines are copies. The later ones lose all lines to the first and take no other part.
* Lines that no other text has match nothing, so a text's shape, its shared lines in order with a
  mark for whatever lies between, decides all of its alignments. Texts of one shape lose to the first of them
  whatever they could lose to others, so only that one meets the first texts of other shapes. Shapes are what is sent and aligned, not texts.
* A block is long enough only if it holds a window of lines: the shortest run of ``min_chars`` characters from a
  line on, or back to a line. A text meets only holders of its windows.
* Holders of a window are numbered in order. A text is aligned with the first one, then with the next seven, the
  next 56, and so on (``GROWTH``), by those of its windows that still have a line that is not deleted. It ends when
  all are deleted, which a common passage mostly is after its first holder, or when no holder is left.

A first document of a line has no earlier one to lose it to, so of every line
one copy at least is left. All alignments are of the documents as given. Lines are
equal by 64-bit hashes, shapes by 128 bits of theirs; texts are not compared again.

Defined cases: null text counts as empty, one empty line; blank lines never
make a pair but go with a block around them; of rows with one doc_id the order
of reading decides which is later; blocks under ``min_chars`` characters stay;
``from_ids`` are the documents whose alignment has taken lines, of those that were aligned;
an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import documents, groups, shuffle_partitions
from corpusflow.plans.staging import Staging

MIN_CHARS = 20
#: A text meets as many times more holders of a window in each round.
GROWTH = 8
BLANK = 0
#: What stands for a stretch of unshared lines in a shape, and for that of the other text: they match nothing.
APART, OTHER = 1, 2


def align(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Common blocks (start in a, start in b, lines) of two lists of line hashes, in order."""
    matched: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            matched.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            matched.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        in_a, in_b = Counter(a[i0:i1]), Counter(b[j0:j1])
        common = [h for h in in_a if h in in_b and h != BLANK]
        if not common:
            continue
        where = {b[j]: j for j in range(j1 - 1, j0 - 1, -1)}
        once = [(i, where[a[i]]) for i in range(i0, i1) if in_a[a[i]] == 1 and in_b.get(a[i]) == 1 and a[i] != BLANK]
        if not once:  # the rarest common line stands in, at its first places
            rarest = min(common, key=lambda h: (in_a[h] * in_b[h], a.index(h, i0, i1)))
            once = [(a.index(rarest, i0, i1), where[rarest])]
        anchors = _rising(once)
        for (i, j), (i_next, j_next) in zip([(i0 - 1, j0 - 1), *anchors], [*anchors, (i1, j1)], strict=True):
            todo.append((i + 1, i_next, j + 1, j_next))
        matched += anchors
    blocks: list[tuple[int, int, int]] = []
    for i, j in sorted(matched):
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1] = (*blocks[-1][:2], blocks[-1][2] + 1)
        else:
            blocks.append((i, j, 1))
    return blocks


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, in order of the first, whose second rises."""
    ends: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(ends, j)
        before[k] = last[at - 1] if at else -1
        ends[at : at + 1], last[at : at + 1] = [j], [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def line_table(docs: DataFrame, staging: Staging) -> DataFrame:
    """``uid, doc_id, text, hashes, chars, lines_hash`` of each row; the hash of a blank line is 0, that of all lines has 128 bits."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n")
    stripped = F.transform(lines, lambda x: F.trim(x, F.lit(" \t\r")))
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), text.alias("text"),
        F.transform(stripped, lambda x: F.when(x == "", F.lit(BLANK)).otherwise(F.xxhash64(x))).alias("hashes"),
        F.transform(stripped, F.length).alias("chars"),
    )
    return staging.table(rows.withColumn("lines_hash", F.struct(F.xxhash64("hashes").alias("one"), F.xxhash64(F.lit(1), "hashes").alias("two"))), "lines")


def copies(table: DataFrame, staging: Staging) -> DataFrame:
    """``uid, first_uid, first_id``: rows whose lines an earlier row has all, with the first such row."""
    rows = table.select("uid", "lines_hash", F.struct("doc_id", "uid").alias("place"))
    several = staging.table(rows.groupBy("lines_hash").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last").drop("last"), "copied")
    found = rows.join(several, "lines_hash").where(F.col("uid") != F.col("first.uid"))
    return staging.table(found.select("uid", F.col("first.uid").alias("first_uid"), F.col("first.doc_id").alias("first_id")), "copies")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _windows(stretch: np.ndarray, line: np.ndarray, lines: np.ndarray, chars: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of shared lines in order, by ``stretch`` (those with blank lines only between them): first and last row of each window, and its hash."""
    n = len(lines)
    at = np.arange(n)
    ends = np.searchsorted(stretch, stretch, side="right") - 1
    starts = np.searchsorted(stretch, stretch, side="left")
    gap = np.diff(line, prepend=line[:1]).astype(np.uint64)
    own, after = _mix(lines), _mix(lines + gap * np.uint64(0xD6E8FEB86659FD93))
    up = np.cumprod(np.concatenate(([1], np.full(n, 0x1F0A3))).astype(np.uint64))
    down = np.cumprod(np.concatenate(([1], np.full(n, pow(0x1F0A3, -1, 1 << 64)))).astype(np.uint64))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(after * down[:n], dtype=np.uint64)))
    held = np.concatenate(([0], np.cumsum(chars)))
    e = np.searchsorted(held, held[:-1] + min_chars, side="left") - 1
    b = np.searchsorted(held, held[1:] - min_chars, side="right") - 1
    forward, back = np.flatnonzero(e <= ends), np.flatnonzero(b >= starts)
    i, e = np.unique(np.concatenate((np.stack((forward, e[forward])), np.stack((b[back], back))), axis=1), axis=1)
    rest = (total[e + 1] - total[i + 1]) * up[e]
    return i, e, _mix(own[i] * up[e - i] + rest + (e - i).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


SHAPES = "uid long, doc_id long, n_lines int, shape binary, tokens array<long>, lines array<int>, chars array<int>, windows array<struct<key:long,start:int,stop:int>>"


def _shapes(rows: pa.Table, min_chars: int) -> pa.RecordBatch:
    """``SHAPES`` of whole documents from their shared lines, by ``uid`` and ``rank`` (place among lines that are not blank)."""
    column = {c: rows.column(c).to_numpy() for c in ("uid", "rank", "line", "hash", "chars", "before", "after", "last", "n_lines")}
    uid, rank, line, before = column["uid"], column["rank"], column["line"], column["before"]
    n = len(uid)
    first = np.append(True, uid[1:] != uid[:-1])
    follows = np.append(False, ~first[1:] & (rank[1:] == rank[:-1] + 1))
    ends = np.append(first[1:], True)
    # each line's tokens: a mark, the blank lines before it, itself, and at the end of a stretch the blank lines behind it and at the end of a text a mark
    mark = ~follows & ~(first & (rank == 0))
    behind = np.where(np.append(~follows[1:], True), column["after"], 0)
    closing = ends & (column["last"] == 0)
    size = mark + before + 1 + behind + closing
    stop = np.cumsum(size)
    start = stop - size
    own = start + mark + before
    tokens, chars = np.full(stop[-1], BLANK, np.int64), np.zeros(stop[-1], np.int32)
    tokens[own], chars[own] = column["hash"], column["chars"]
    lines = (np.arange(stop[-1]) - np.repeat(own, size) + np.repeat(line, size)).astype(np.int32)
    for place in (start[mark], stop[closing] - 1):
        tokens[place], lines[place] = APART, -1
    with np.errstate(over="ignore"):
        i, e, key = _windows(np.cumsum(~follows), line, column["hash"].view(np.uint64), column["chars"], min_chars)
    row = np.flatnonzero(first)
    at = np.append(start[row], stop[-1]).astype(np.int32)
    raw = tokens.tobytes()
    shape = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    windows = pa.StructArray.from_arrays([pa.array(key.view(np.int64)), pa.array(line[i].astype(np.int32)), pa.array((line[e] + 1).astype(np.int32))], ["key", "start", "stop"])
    lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(v)) for v in (tokens, lines, chars)]
    cuts = np.append(np.searchsorted(i, row), len(i)).astype(np.int32)
    taken = pa.array(row)
    columns = [pa.array(uid[row]), rows.column("doc_id").combine_chunks().take(taken), pa.array(column["n_lines"][row]), pa.array(shape, pa.binary()), *lists, pa.ListArray.from_arrays(pa.array(cuts), windows)]
    return pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "n_lines", "shape", "tokens", "lines", "chars", "windows"])


def shape_table(table: DataFrame, staging: Staging, min_chars: int = MIN_CHARS) -> DataFrame:
    """``SHAPES`` of each text of ``table`` (none twice) that shares a line with another."""
    own = F.transform(F.arrays_zip("hashes", "chars"), lambda x, i: F.struct(x["hashes"].alias("hash"), x["chars"].alias("chars"), i.alias("line")))
    kept = table.select("uid", "doc_id", F.size("hashes").alias("n_lines"), F.filter(own, lambda x: x["hash"] != BLANK).alias("own"))
    beside = lambda i, k, other: F.coalesce(F.get("own", i + k)["line"], other)
    full = F.transform("own", lambda x, i: F.struct(
        x["hash"].alias("hash"), x["chars"].alias("chars"), x["line"].alias("line"), (x["line"] - F.when(i == 0, -1).otherwise(beside(i, -1, F.lit(-1))) - 1).alias("before"),
        (beside(i, 1, F.col("n_lines")) - x["line"] - 1).alias("after"), (i + 1 == F.size("own")).cast("int").alias("last"),
    ))
    lines = kept.select("uid", "doc_id", "n_lines", F.posexplode(full).alias("rank", "x")).select("uid", "doc_id", "n_lines", "rank", "x.*")
    each = table.select(F.explode(F.array_distinct("hashes")).alias("hash")).where(F.col("hash") != BLANK)
    shared = staging.table(each.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            uid = batch.column("uid").to_numpy()
            last = int(np.searchsorted(uid, uid[-1]))  # the last document may go on in the next batch
            if last or (held and held[-1].column("uid")[-1].as_py() != uid[0]):
                held.append(batch.slice(0, last))
                yield _shapes(pa.Table.from_batches(held).combine_chunks(), min_chars)
                held = []
            held.append(batch.slice(last))
        if held:
            yield _shapes(pa.Table.from_batches(held).combine_chunks(), min_chars)

    dealt = lines.join(shared, "hash", "left_semi").select("uid", "doc_id", "rank", "line", "hash", "chars", "before", "after", "last", "n_lines")
    dealt = dealt.repartition(shuffle_partitions(table.sparkSession), "uid").sortWithinPartitions("uid", "rank")
    return staging.table(dealt.mapInArrow(run, SHAPES), "shapes")


def numbered(holders: DataFrame, staging: Staging) -> DataFrame:
    """``key, uid, n``: the holders of each key (key, doc_id, uid) with their places in order, from 0; a key's holders may fill many tasks."""
    ranged = holders.repartitionByRange(shuffle_partitions(holders.sparkSession), "key", "doc_id", "uid").sortWithinPartitions("key", "doc_id", "uid")
    placed = staging.table(ranged.select("key", "uid", F.monotonically_increasing_id().alias("at")), "placed")
    begins, before = [], 0
    for task, rows in sorted(placed.groupBy(F.shiftright("at", 33).alias("task")).agg(F.count("*")).collect()):  # a row for each task
        begins.append((task, before))
        before += rows
    begins = F.broadcast(placed.sparkSession.createDataFrame(begins, "task long, before long"))
    counted = placed.withColumn("task", F.shiftright("at", 33)).join(begins, "task").select("key", "uid", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("place"))
    first = counted.groupBy("key").agg(F.min("place").alias("first"))
    return staging.table(counted.join(first, "key").select("key", "uid", (F.col("place") - F.col("first")).alias("n")), "numbered")


def aligned(pairs: DataFrame, shapes: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``uid, first_id, start, stop``: the blocks of lines that texts lose to earlier ones, of ``pairs`` (uid, first_uid)."""
    other = shapes.select(F.col("uid").alias("first_uid"), F.col("doc_id").alias("first_id"), F.col("tokens").alias("first_tokens"))
    joined = pairs.join(other, "first_uid").join(shapes.select("uid", "tokens", "lines", "chars"), "uid").select("uid", "first_id", "first_tokens", "tokens", "lines", "chars")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out: list[list] = [[], [], [], []]
                for uid, first, theirs, ours, lines, chars in zip(*(part.column(c).to_pylist() for c in ("uid", "first_id", "first_tokens", "tokens", "lines", "chars")), strict=True):
                    for i, _, n in align(ours, [OTHER if x == APART else x for x in theirs]):
                        if sum(chars[i : i + n]) >= min_chars:
                            for column, v in zip(out, (uid, first, lines[i], lines[i + n - 1] + 1), strict=True):
                                column.append(v)
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["uid", "first_id", "start", "stop"])

    return joined.mapInArrow(blocks, "uid long, first_id long, start int, stop int")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _still_open(windows: DataFrame, found: DataFrame) -> DataFrame:
    """``windows`` (uid, start, stop) of which not every line is in a range of ``found``."""
    ranges = F.array_sort(F.collect_set(F.struct("start", "stop")))  # of one text's lines
    last = lambda acc: F.element_at(acc, -1)
    add = lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).when(
        x["start"] <= last(acc)["stop"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["stop"], x["stop"]).alias("stop"))))
    ).otherwise(F.concat(acc, F.array(x)))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    gone = found.groupBy("uid").agg(ranges.alias("r")).select("uid", F.aggregate("r", none, add).alias("gone"))
    inside = F.exists("gone", lambda r: (r["start"] <= F.col("start")) & (F.col("stop") <= r["stop"]))
    return windows.join(gone, "uid", "left").where(~F.coalesce(inside, F.lit(False))).drop("gone")


def lost_blocks(shapes: DataFrame, staging: Staging, min_chars: int = MIN_CHARS, growth: int = GROWTH) -> DataFrame:
    """``uid, first_id, start, stop`` of all blocks that texts lose, by ``shape_table``."""
    firsts = staging.table(shapes.groupBy("shape").agg(F.min(F.struct("doc_id", "uid")).alias("first")).select("shape", F.col("first.uid").alias("first_uid")), "firsts")
    members = staging.table(shapes.select("uid", "shape").join(firsts, "shape").select("uid", "first_uid"), "members")
    own = shapes.join(members.where("uid = first_uid").select("uid").hint("merge"), "uid", "left_semi")
    windows = staging.table(own.select("uid", "doc_id", F.explode("windows").alias("w")).select("uid", "doc_id", "w.*"), "windows")
    several = windows.groupBy("key").agg(F.min("uid").alias("one"), F.max("uid").alias("another")).where("one < another").select("key")
    held = numbered(windows.select("key", "doc_id", "uid").distinct().join(several, "key", "left_semi"), staging)
    digits = lambda n: F.when(n == 0, 0).otherwise(F.floor(F.log(float(growth), n + F.lit(0.5))).cast("int") + 1)  # noqa: E731 - the round in which a holder's turn comes
    held = staging.table(held.withColumn("turn", digits(F.col("n"))), "holders")
    rest = staging.table(windows.join(held.where("n > 0").select("key", "uid", "n"), ["key", "uid"]).select("key", "uid", "n", "start", "stop"), "open")
    tried, found, turn = [], [], 0
    while True:
        now = held.where(F.col("turn") == turn).select("key", F.col("uid").alias("first_uid"), F.col("n").alias("before"))
        pairs = rest.select("key", "uid", "n").distinct().join(now, "key").where("before < n").select("uid", "first_uid").distinct()
        if tried:
            pairs = pairs.join(_union(tried), ["uid", "first_uid"], "left_anti")
        else:
            pairs = pairs.unionByName(members.where("uid <> first_uid"))
        tried.append(staging.table(pairs, f"pairs-{turn}"))
        found.append(staging.table(aligned(tried[-1], shapes, min_chars), f"blocks-{turn}"))
        more = rest.where(F.col("n") > F.lit(growth**turn))  # holders that have not had their turn
        rest = staging.table(_still_open(more, _union(found)), f"open-{turn}")
        if rest.isEmpty():
            return _union(found)
        turn += 1


def removals(table: DataFrame, blocks: DataFrame, copied: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``uid, keep, n_removed, from_ids``: the line ranges [start, stop) that stay, of documents that lose lines.

    A row of ``copied`` is one block with its first copy, if it is long enough.
    """
    sizes = table.select("uid", F.size("hashes").alias("n_lines"))
    whole = table.join(copied.hint("merge"), "uid").where(F.aggregate("chars", F.lit(0), lambda acc, x: acc + x) >= min_chars)
    whole = whole.select("uid", "first_id", F.lit(0).alias("start"), F.size("hashes").alias("stop"))
    found = blocks.unionByName(whole).join(sizes, "uid")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["uid"]):
            keep, at, n = [], 0, table.column("n_lines")[0].as_py()
            for start, stop in zip(table.column("start").to_pylist(), table.column("stop").to_pylist(), strict=True):
                if start > at:
                    keep.append({"start": at, "stop": start})
                at = max(at, stop)
            if at < n:
                keep.append({"start": at, "stop": n})
            kept = sum(k["stop"] - k["start"] for k in keep)
            ids = sorted({i for i in table.column("first_id").to_pylist() if i is not None})
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([table.column("uid")[0].as_py()], pa.int64()),
                    pa.array([keep], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                    pa.array([n - kept], pa.int32()), pa.array([ids], pa.list_(pa.int64())),
                ],
                ["uid", "keep", "n_removed", "from_ids"],
            )

    dealt = found.repartition(shuffle_partitions(table.sparkSession), "uid").sortWithinPartitions("uid", "start", "stop", "first_id")
    return dealt.mapInArrow(merge, "uid long, keep array<struct<start:int,stop:int>>, n_removed int, from_ids array<long>")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, staging: Staging | None = None, growth: int = GROWTH) -> DataFrame:
    """``doc_id, text, n_lines, n_removed, from_ids``: each row's text without blocks that earlier documents have."""
    staging = staging or Staging(docs.sparkSession)
    table = line_table(docs, staging)
    copied = copies(table, staging)
    shapes = shape_table(table.join(copied.select("uid").hint("merge"), "uid", "left_anti"), staging, min_chars)
    cut = staging.table(removals(table, lost_blocks(shapes, staging, min_chars, growth), copied, min_chars), "removals")
    lines = F.split("text", "\n")
    left = F.array_join(F.flatten(F.transform("keep", lambda r: F.slice(lines, r["start"] + 1, r["stop"] - r["start"]))), "\n")
    return table.select("uid", "doc_id", "text", F.size("hashes").alias("n_lines")).join(cut.hint("merge"), "uid", "left").select(
        "doc_id", F.when(F.col("keep").isNull(), F.col("text")).otherwise(left).alias("text"), "n_lines",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("from_ids", F.array().cast("array<long>")).alias("from_ids"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "from_ids")
