"""Best-fit packing of documents into sequences of bounded length.

Best-two-fit: a bin is filled greedily, then its smallest document is replaced
with two unpacked documents that fit the gap, grown by that document, more
tightly. Documents of equal length are interchangeable, so bins are planned on
the histogram of lengths: a plan is a list of bin patterns with a multiplicity,
at most ``capacity`` counts are all that the driver sees, and Spark deals the
places out by the rank of a piece among those of its length.

Defined cases: null and empty texts are one piece of the separator alone;
repeated rows, also with one doc_id, are packed each; an empty table gives no
rows; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import documents, shuffle_partitions, slices
from corpusflow.plans.staging import Staging

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"
#: Words kept by a worker, and the longest word that is kept.
KEPT_WORDS, KEPT_CHARS = 700_000, 48
MARKS = string.punctuation
#: Letters whose lower case depends on their place or is more than one character.
UNEVEN = "\u03a3\u0130"

#: Characters of one long text that are cut into words at once.
PART_CHARS = 1 << 20


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds(dict):
    """Ids of white-space separated chunks as little-endian bytes, each found once by the tokenizer.

    The vocabulary is of words with ends: its pre-tokenizer never joins
    characters across white space, so a text's ids are those of its chunks.
    Added tokens, such as ``<|endoftext|>``, are found before any pre-tokenizer
    runs: a chunk that may hold one goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.plain = set(" .,")
        self.tokenizer = Tokenizer.from_file(path)
        tokens = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(tokens.values()) + 1, dtype=bool)
        self.ends[[i for t, i in tokens.items() if t.endswith("</w>")]] = True
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(c.isspace() for t in self.added for c in t):
            raise ValueError("an added token holds white space, at which texts are cut")

    def encode(self, chunks: list[str]) -> list[bytes]:
        out = []
        for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False):
            ids = e.ids
            out.append(struct.pack(f"<{len(ids)}I", *ids))
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The same for chunks of letters only, which are one word each: in one text, cut at the ends of words."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words) or cuts[-1] != len(ids):
            return self.encode(words)
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip([0, *(4 * cuts[:-1]).tolist()], (4 * cuts).tolist(), strict=True)]

    def __missing__(self, chunk: str) -> bytes:
        word = chunk.strip(MARKS)
        head = chunk[: chunk.find(word)] if word else ""
        if any(t in chunk.lower() for t in self.added):
            found = self.encode([chunk])[0]
        elif word and word.isalpha() and "'" not in head and not any(c in UNEVEN for c in word) and (word != chunk or word != word.lower()):
            found = self[head] + self[word.lower()] + self[chunk[len(head) + len(word) :]]  # the pre-tokenizer cuts here
        else:
            found = self.encode([chunk])[0] if chunk else b""
        if len(chunk) <= KEPT_CHARS:
            self[chunk] = found
        return found

    def learn(self, texts: list[list[str]]) -> None:
        """Find the ids of all new words of ``texts`` in few calls; chunks with marks wait for ``__missing__``."""
        if len(self) > KEPT_WORDS:
            self.clear()
        unknown = [c for c in set().union(*texts) if c not in self and len(c) <= KEPT_CHARS]
        new = {c for c in unknown if c.isalpha()}
        new.update(c for c in {c.strip(MARKS).lower() for c in unknown if c not in new} if c not in self and c.isalpha())
        new = list(new)
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            self.update(zip(part, self.encode_words(part), strict=True))

    def chunks(self, text: str) -> list[str]:
        """Parts of a text whose ids, end to end, are the text's.

        Only spaces and line feeds cut a text, for any text. If it has nothing but letters, digits,
        white space and single full stops and commas, these are cut off as well
        and letters are lower-cased, as pre-tokenizer and normalizer would: fewer different parts.
        """
        text = text.replace("\n", " ")
        other = set(text).difference(self.plain)
        if other and all(c.isalnum() and c not in UNEVEN for c in other):
            self.plain.update(other)
            other = None
        if not other and not any(t.isalnum() for t in self.added) and not any(pair in text for pair in ("..", ",,", ".,", ",.")):
            text = text.lower().replace(".", " .").replace(",", " ,")
        return text.split(" ")


_WORDS: dict[str, WordIds] = {}


def _words(path: str) -> WordIds:
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def _parts(text: str, most: int) -> Iterator[str]:
    """A text in parts of about ``most`` characters, cut at spaces and line feeds, where ids never depend on what is beyond."""
    at = 0
    while len(text) - at > most:
        cut = max(text.rfind(" ", at + 1, at + most), text.rfind("\n", at + 1, at + most))
        if cut < 0:
            cut = min((k for k in (text.find(" ", at + most), text.find("\n", at + most)) if k >= 0), default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def _text_ids(words: WordIds, texts: list[str | None], most: int = PART_CHARS) -> list[bytes]:
    """The ids of each text."""
    if len(texts) == 1:
        ids = []
        for part in _parts(texts[0] or "", most):
            chunks = words.chunks(part)
            words.learn([chunks])
            ids.append(b"".join(map(words.__getitem__, chunks)))
        return [b"".join(ids)]
    cut = [words.chunks(t or "") for t in texts]
    words.learn(cut)
    return [b"".join(map(words.__getitem__, chunks)) for chunks in cut]


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, separator: int = 0, with_ids: bool = False) -> DataFrame:
    """Tokenise whole texts, end each with ``separator`` and cut those longer than ``capacity``.

    With ``with_ids`` a last column ``ids`` holds the piece's ids as an array.
    """
    path = path or tokenizer_path()
    width, end = 4 * capacity, struct.pack("<I", separator)
    schema = PIECES + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        for whole in batches:
            for batch in slices(whole, "text"):  # of some bytes; a longer text is in parts
                rows: list[list] = [[] for _ in names]
                for doc, ids in zip(batch.column("doc_id").to_pylist(), _text_ids(words, batch.column("text").to_pylist()), strict=True):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), width)):
                        part = ids[start : start + width]
                        values = [doc, piece, start // 4, len(part) // 4, zlib.crc32(part)]
                        for column, v in zip(rows, values + [np.frombuffer(part, "<u4").astype(np.int32)] * with_ids, strict=True):
                            column.append(v)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=False)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bin patterns ``(multiplicity, [(length, how many), ...])`` that use up ``counts`` of lengths."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit into {capacity}")
        left[length] += n
    plan = []
    while left.any():
        free = left.copy()
        chosen: list[int] = []
        gap = capacity
        while gap:  # greedily, the longest that fits
            fits = np.flatnonzero(free[: gap + 1])
            if not len(fits):
                break
            chosen.append(int(fits[-1]))
            free[fits[-1]] -= 1
            gap -= int(fits[-1])
        while gap and len(chosen) > 1:  # the smallest gives way to two that fill more
            smallest = min(chosen)
            room = gap + smallest
            lengths = np.flatnonzero(free[:room])
            if not len(lengths):
                break
            mate = np.searchsorted(lengths, room - lengths, side="right") - 1
            same = (mate >= 0) & (lengths[mate] == lengths) & (free[lengths] < 2)
            mate = np.where(same, mate - 1, mate)
            total = np.where(mate >= 0, lengths + lengths[np.maximum(mate, 0)], 0)
            best = int(np.argmax(total))
            if total[best] <= smallest:
                break
            chosen.remove(smallest)
            free[smallest] += 1
            for length in (int(lengths[best]), int(lengths[mate[best]])):
                chosen.append(length)
                free[length] -= 1
            gap = room - int(total[best])
        kinds = sorted({c: chosen.count(c) for c in chosen}.items(), reverse=True)
        times = min(int(left[c]) // k for c, k in kinds)
        for c, k in kinds:
            left[c] -= times * k
        plan.append((times, kinds))
    return plan


def slots(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """The plan as ranges of ranks: a range starts at (length, rank) and fills ``per`` places of each of its bins."""
    rows, taken, first = [], {}, 0
    for times, kinds in plan:
        offset = 0
        for length, per in kinds:
            start = taken.get(length, 0)
            rows.append((length, start, per, first, offset))
            taken[length] = start + times * per
            offset += length * per
        first += times
    rows.sort()
    names = ("length", "start", "per", "sequence", "offset")
    return dict(zip(names, np.array(rows, dtype=np.int64).reshape(-1, 5).T, strict=True))


def pack(pieces: DataFrame, staging: Staging, capacity: int = CAPACITY) -> DataFrame:
    """Give every row of a staged table of pieces its ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    ranges = spark.sparkContext.broadcast(slots(plan_bins(counts, capacity)))

    # the rank among pieces of one length: within a salt by a window, across salts by running counts
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shuffle_partitions(spark))))
    before = staging.table(
        salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "salt", F.coalesce("before", F.lit(0)).alias("before")),
        "before",
    )
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("own", F.row_number().over(own) - 1).join(before.hint("merge"), ["length", "salt"])  # grows with the partitions; both sides are dealt alike
    columns = [c.split()[0] for c in PIECES.split(", ")]
    ranked = ranked.select(*columns, (F.col("own") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ranges.value
        wide = int(r["start"].max(initial=0)) + 1
        keys = r["length"] * wide + r["start"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            i = np.searchsorted(keys, length * wide + np.minimum(rank, wide - 1), side="right") - 1
            turn, slot = np.divmod(rank - r["start"][i], r["per"][i])
            arrays = [batch.column(c) for c in columns] + [pa.array(r["sequence"][i] + turn), pa.array(r["offset"][i] + slot * length)]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(place, PLACED)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, separator: int = 0, staging: Staging | None = None) -> DataFrame:
    """Tokenise, cut and pack ``docs`` (doc_id, text); one row per piece."""
    staging = staging or Staging(docs.sparkSession)
    pieces = staging.table(token_pieces(docs, path, capacity, separator), "pieces")
    return pack(pieces, staging, capacity)


def sequences(docs: DataFrame, placed: DataFrame, path: str | None = None, capacity: int = CAPACITY, separator: int = 0) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, ids, doc_ids``; a sequence is at most ``capacity`` ids."""
    ids = token_pieces(docs, path, capacity, separator, with_ids=True).select("doc_id", "piece", "ids")
    parts = placed.join(ids, ["doc_id", "piece"]).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.col("parts.doc_id").alias("doc_ids"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
