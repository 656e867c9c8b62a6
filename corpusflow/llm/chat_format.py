"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the
context, and only that reply is trainable. A conversation that does not end
with an assistant turn gets a last example without a trainable part, so that no
turn is lost.

A turn is written ``### ROLE: TEXT</turn>`` and a line feed. A backslash goes before every
``\\``, ``<`` and ``#`` of roles and texts (in roles before ``:`` too), so
control strings inside texts cannot be taken for marks, and removing it
restores them.

Defined cases: null text and null role count as empty; rows with one ``turn``
order by role and text; repeated rows are turns each; a row with null conv_id
is a conversation of its own, as nothing says which it belongs to; an empty table gives no rows; other columns are not read,
whatever their names. A task holds one conversation at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import groups, shuffle_partitions

EXAMPLES = "conv_id long, lone long, example int, text string, loss_start int, loss_end int, whole boolean"
_TEXT, _ROLE, _BACK = re.compile(r"[\\<#]"), re.compile(r"[\\<#:]"), re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^:\\]|\\.)*+): ((?:[^<\\]|\\.)*+)</turn>\n", re.S)
_FLUSH = 8 << 20


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as written, and where its escaped text starts and ends."""
    head = "### " + _ROLE.sub(r"\\\g<0>", role) + ": "
    body = _TEXT.sub(r"\\\g<0>", text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def parse_turns(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text; anything else in it is an error."""
    turns, at = [], 0
    while at < len(text):
        found = _TURN.match(text, at)
        if not found:
            raise ValueError(f"no turn starts at {at}")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def expand(conversations: DataFrame) -> DataFrame:
    """``conv_id, lone, example, text, loss_start, loss_end, whole`` from rows (conv_id, turn, role, text).

    ``lone`` tells conversations with null conv_id apart, and is null for others.
    The loss mask is the code points from ``loss_start`` to ``loss_end`` (null: none);
    ``whole`` marks the example that holds all turns.
    """
    names = [c.split()[0] for c in EXAMPLES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for table in groups(batches, ["conv_id", "lone"]):
            conv, lone = (table.column(c)[0].as_py() for c in ("conv_id", "lone"))
            turns = [(r or "", t or "") for r, t in zip(table.column("role").to_pylist(), table.column("text").to_pylist(), strict=True)]
            prefix, example = "", 0
            for k, (role, text) in enumerate(turns):
                written, start, end = format_turn(role, text)
                at, prefix = len(prefix), prefix + written
                last, trained = k == len(turns) - 1, role == "assistant"
                if trained or last:
                    rows.append((conv, lone, example, prefix, at + start if trained else None, at + end if trained else None, last))
                    held += len(prefix)
                    example += 1
                    if held > _FLUSH:
                        yield out()
                        rows, held = [], 0
        if rows:
            yield out()

    lone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    own = conversations.select(F.col("conv_id").cast("long"), lone.alias("lone"), F.col("turn").cast("long"), "role", "text")
    dealt = own.repartition(shuffle_partitions(own.sparkSession), "conv_id", "lone").sortWithinPartitions("conv_id", "lone", "turn", "role", "text")
    return dealt.select("conv_id", "lone", "role", "text").mapInArrow(run, EXAMPLES)


def read_back(examples: DataFrame) -> DataFrame:
    """What formatted examples hold, by conversation: turns of the whole one, and the text under all loss masks in order."""
    fields = "conv_id long, lone long, example int, n_turns long, turns_sha256 string, loss string, chars long"
    names = [c.split()[0] for c in fields.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, lone, example, text, start, end, whole in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "lone", "example", "text", "loss_start", "loss_end", "whole")), strict=True):
                loss = None if start is None else unescape(text[start:end])
                turns = parse_turns(text) if whole else None
                sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest() if whole else None
                rows.append((conv, lone, example, len(turns) if whole else None, sha, loss, len(text)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    loss = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))), lambda x: x["loss"]), "")
    by_conv = examples.mapInArrow(run, fields).groupBy("conv_id", "lone").agg(
        F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), loss.alias("loss"), F.sum("chars").alias("formatted_chars")
    )
    return by_conv.select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars"
    )


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    hostile = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)], "conv_id long, turn long, role string, text string")
    return read_back(expand(given.unionByName(more)))


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, NULL, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, NULL, 1, 'assistant', '\### Assistant: </turn> ok'
), t AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id, lone) AS n,
         sum(14 + length(regexp_replace(role, '[\\<#:]', '__', 'g')) + length(regexp_replace(text, '[\\<#]', '__', 'g'))) OVER (w ROWS UNBOUNDED PRECEDING) AS prefix
  FROM c WINDOW w AS (PARTITION BY conv_id, lone ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(prefix) FILTER (WHERE role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id, lone
"""
