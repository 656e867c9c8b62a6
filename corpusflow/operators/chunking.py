"""Token-bounded chunks with overlap, as a fold over segment lengths.

The fold, the one sequential step, is a native higher-order aggregate over
the segments' lengths, and chunks are slices of the segments. What a token is, is told by a counter: ``words`` and
``bytes4`` are native; ``bpe`` has a public vocabulary count sentences, a column of lists in Arrow batches.
A document is one row and one value; its chunks need no shuffle, and time grows with its sentences.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import text as T

MAX_TOKENS, OVERLAP, MIN_TOKENS = 400, 60, 40
#: Segments that are folded at once.
_BLOCK = 256


@dataclass(frozen=True)
class Counter:
    """``cut(sentences, most)``: a list of sentences as segments ``text, n`` of at most ``most`` tokens each; ``count(text)``: the tokens of one text."""

    cut: Callable[[Column, int], Column]
    count: Callable[[Column], Column]


def _cut_each(count: Callable[[Column], Column], pieces: Callable[[Column, int], Column]) -> Callable[[Column, int], Column]:
    def cut(sentences: Column, most: int) -> Column:
        one = lambda s: F.struct(s.alias("text"), count(s).alias("n"))
        return F.flatten(F.transform(sentences, lambda s: F.when(count(s) <= most, F.array(one(s))).otherwise(F.transform(pieces(s, most), one))))

    return cut


def _word_pieces(sentences: Column, most: int) -> Column:
    """Sentences have no white space at their ends, so cutting at white space gives their words."""
    part = lambda own, i: F.struct(F.array_join(F.slice(own, i, F.lit(most)), " ").alias("text"), F.least(F.lit(most), F.size(own) - i + 1).alias("n"))
    cut = lambda own: F.transform(F.sequence(F.lit(1), F.size(own), F.lit(most)), lambda i: part(own, i))
    sized = lambda s: F.transform(
        F.array(T.count_words(s)), lambda n: F.when(n > most, F.transform(F.array(F.split(s, T.BLANK + "+")), cut)[0]).otherwise(F.array(F.struct(s.alias("text"), n.alias("n"))))
    )[0]
    return F.flatten(F.transform(sentences, sized))


def _character_pieces(s: Column, most: int) -> Column:
    """A character has four bytes at most, so ``most`` of them are ``most`` tokens at most."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / most).cast("int")), lambda i: F.substr(s, i * most + 1, F.lit(most)))


def _bytes4(s: Column) -> Column:
    return F.ceil(F.octet_length(s) / 4).cast("int")


#: Words between white space; a long sentence is cut at them.
WORDS = Counter(_word_pieces, lambda s: T.count_words(T.strip(s)))
#: A quarter of the UTF-8 bytes, rounded up; a long sentence is cut at characters.
BYTES4 = Counter(_cut_each(_bytes4, _character_pieces), _bytes4)


class WordCounts:
    """Tokens of sentences by those of their words, each counted once by the tokenizer.

    A byte-level pre-tokenizer puts a space only before what follows it, so where single spaces stand between words a text's tokens are those of its
    first word and of a space and a word, for each other one. A text with other white space at such a place, which may go either way, gets -1, to be counted whole.
    Other kinds of tokenizer are never cut at words.
    """

    KEPT_WORDS, KEPT_CHARS = 700_000, 48

    def __init__(self, tokenizer):
        pre = json.loads(tokenizer.to_str())
        kind = pre.get("pre_tokenizer") or {}
        self.tokenizer = tokenizer
        self.able = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not pre.get("normalizer") and all(t.get("special") for t in pre["added_tokens"])
        self.known: dict[str, int] = {}

    def of(self, sentences: list[str]) -> list[int]:
        if not self.able:
            return [-1] * len(sentences)
        split = [s.replace(" ", "\n ").split("\n") if "\n" not in s else None for s in sentences]
        if len(self.known) > self.KEPT_WORDS:
            self.known.clear()
        new = list({w for words in split if words for w in words if w not in self.known})
        if new:
            plain = [w for w in new if w.strip(" ") and w.lstrip(" ") == w.strip()]
            found = dict.fromkeys(new, -1) | {w: len(e.ids) for w, e in zip(plain, self.tokenizer.encode_batch_fast(plain, add_special_tokens=False), strict=True)}
            self.known.update((w, n) for w, n in found.items() if len(w) <= self.KEPT_CHARS)
            known = self.known.get
            value = lambda w: known(w) if len(w) <= self.KEPT_CHARS else found[w]
        else:
            value = self.known.__getitem__
        out = []
        for words in split:
            each = list(map(value, words)) if words else [-1]
            out.append(-1 if min(each) < 0 else sum(each))
        return out


@functools.lru_cache(maxsize=2)
def word_counts(path: str) -> WordCounts:
    """One for all tasks of a Python worker, so that words are counted once a worker."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return WordCounts(tokenizer)


def bpe(path: str) -> Counter:
    """Tokens of the vocabulary file ``path``, which all executors see; a long sentence is cut where a token begins, and no character is lost or said twice."""

    def load():
        return word_counts(path).tokenizer

    def cutter(most: int):
        kind = pa.struct([("text", pa.string()), ("n", pa.int32())])

        @F.arrow_udf("array<struct<text:string,n:int>>")
        def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            counts = word_counts(path)
            tokenizer = counts.tokenizer
            for lists in batches:
                ends, texts, tokens = [0], [], []
                for at in range(0, len(lists), 64):
                    for sentences in lists[at : at + 64].to_pylist():
                        own = sentences or []
                        for text, n in zip(own, counts.of(own), strict=True):
                            if 0 <= n <= most:
                                texts.append(text)
                                tokens.append(n)
                                continue
                            e = tokenizer.encode(text, add_special_tokens=False)
                            size, places = len(e.ids), e.offsets  # each use of them makes a list
                            cuts = [0, *(places[i][0] for i in range(most, size, most)), len(text)]
                            for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                                if text[i:j]:
                                    texts.append(text[i:j])
                                    tokens.append(min(most, size - k * most))
                        ends.append(len(texts))
                values = pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(tokens, pa.int32())], fields=list(kind))
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

        return cut

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = load()
        for s in batches:
            yield s.map(lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids), na_action="ignore")

    return Counter(lambda sentences, most: cutter(most)(sentences), count)


def segments(text: Column, most: int = MAX_TOKENS, counter: Counter = WORDS) -> Column:
    """Sentences with their tokens, ``text, n``; those longer than ``most`` tokens are cut."""
    return counter.cut(T.sentences(text), most)


def fold(tokens: Column, most: int, overlap: int, least: int) -> Column:
    """Chunks ``lo, hi, tok, lo2, hi2`` over 1-based segments of ``tokens`` words each; ``lo2`` to ``hi2`` is a short end that was merged in, 0 if none.

    One pass that only looks back when a chunk is full: at most ``overlap`` segments,
    as each has a word at least. ``tokens`` must be a plain column, as it is read at places.
    """
    chunk = lambda lo, hi, tok, lo2=F.lit(0), hi2=F.lit(0): F.struct(lo.alias("lo"), hi.alias("hi"), tok.alias("tok"), lo2.alias("lo2"), hi2.alias("hi2"))
    state = lambda i, lo, held, last, out: F.struct(i.alias("i"), lo.alias("lo"), held.alias("held"), last.alias("last"), out.alias("out"))
    kind = "struct<lo:int,hi:int,tok:int,lo2:int,hi2:int>"
    none, nothing = F.lit(None).cast(kind), F.array().cast(f"array<{kind}>")

    def carried(acc: Column) -> Column:
        """The last segment, always, and earlier ones while they fit: how many more, and all their words."""
        first = F.greatest(acc["lo"], acc["i"] - overlap)
        earlier = F.when(first < acc["i"], F.transform(F.sequence(acc["i"] - 1, first, F.lit(-1)), lambda j: F.element_at(tokens, j))).otherwise(F.array().cast("array<int>"))
        begin = F.struct(F.element_at(tokens, acc["i"]).alias("held"), F.lit(0).alias("n"), F.lit(True).alias("open"))
        more = lambda a, t: F.when(
            a["open"] & (a["held"] + t <= overlap), F.struct((a["held"] + t).alias("held"), (a["n"] + 1).alias("n"), F.lit(True).alias("open"))
        ).otherwise(F.struct(a["held"].alias("held"), a["n"].alias("n"), F.lit(False).alias("open")))
        return F.aggregate(earlier, begin, more)

    def step(acc: Column, t: Column) -> Column:
        ends = (acc["held"] > 0) & (acc["held"] + t > most)
        more = F.when(acc["last"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["last"])))  # the last chunk is held apart, as the end may go into it
        c = carried(acc)
        return F.when(ends, state(acc["i"] + 1, acc["i"] - c["n"], c["held"] + t, chunk(acc["lo"], acc["i"], acc["held"]), more)).otherwise(
            state(acc["i"] + 1, acc["lo"], acc["held"] + t, acc["last"], acc["out"])
        )

    def block(acc: Column, b: Column) -> Column:
        own = F.transform(F.sequence(b, F.least(b + (_BLOCK - 1), F.size(tokens))), lambda j: F.element_at(tokens, j))
        folded = F.aggregate(own, state(acc["i"], acc["lo"], acc["held"], acc["last"], nothing), step)
        return F.transform(F.array(folded), lambda x: state(x["i"], x["lo"], x["held"], x["last"], F.concat(acc["out"], x["out"])))[0]

    def finish(acc: Column) -> Column:
        last, end = acc["last"], chunk(acc["lo"], acc["i"], acc["held"])
        merged = F.array(chunk(last["lo"], last["hi"], last["tok"] + acc["held"], acc["lo"], acc["i"]))
        ending = F.when(last.isNull(), F.array(end)).when(acc["held"] < least, merged).otherwise(F.array(last, end))
        return F.when(acc["i"] == 0, nothing).otherwise(F.concat(acc["out"], ending))

    # a fold copies its state at each step, so chunks gather by blocks of segments
    blocks = F.when(F.size(tokens) > 0, F.sequence(F.lit(1), F.size(tokens), F.lit(_BLOCK))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(blocks, state(F.lit(0), F.lit(1), F.lit(0), none, nothing), block, finish)


def chunk_text(df: DataFrame, text: str = "text", most: int = MAX_TOKENS, overlap: int = OVERLAP, least: int = MIN_TOKENS, counter: Counter = WORDS) -> DataFrame:
    """``df`` without ``text``, one row per chunk: ``chunk_index, chunk_text, token_count``.

    A chunk's tokens are those of its segments; a last chunk of fewer than ``least`` goes into the one before, whose text is then counted anew.
    """
    keep = [c for c in df.columns if c != text]
    split = df.select(*keep, segments(F.col(text), most, counter).alias("_s"))  # a null text explodes to no row; a filter on it would compute a derived text twice
    sized = split.select(*keep, F.transform("_s", lambda x: x["text"]).alias("_segments"), F.transform("_s", lambda x: x["n"]).alias("_tokens"))
    part = lambda lo, hi: F.array_join(F.transform(F.sequence(lo, hi), lambda j: F.element_at("_segments", j)), " ")  # noqa: E731 - a slice would unfold the whole list each time
    whole = lambda x: F.when(x["lo2"] > 0, F.concat(part(x["lo"], x["hi"]), F.lit(" "), part(x["lo2"], x["hi2"]))).otherwise(part(x["lo"], x["hi"]))
    made = F.transform(fold(F.col("_tokens"), most, overlap, least), lambda x: F.struct(whole(x).alias("text"), x["tok"].alias("tok"), (x["lo2"] > 0).alias("merged")))
    rows = sized.select(*keep, F.posexplode(made).alias("chunk_index", "_chunk"))
    count = F.col("_chunk.tok") if counter is WORDS else F.coalesce(counter.count(F.when(F.col("_chunk.merged"), F.col("_chunk.text"))), F.col("_chunk.tok"))  # words add up
    return rows.select(*keep, "chunk_index", F.col("_chunk.text").alias("chunk_text"), count.alias("token_count"))
