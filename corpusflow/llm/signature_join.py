"""N-gram Jaccard self-join by signature trees.

Documents are sets of hashed word shingles; two link when their Jaccard
similarity reaches a threshold. Equal sets become one class. Links are found by
trees whose nodes hold the OR of their documents' token bitmaps and the range of
their sizes: two nodes are walked together only while the largest overlap that
bitmaps and sizes allow could still be a link; leaf pairs are compared exactly.

Trees are built over groups that no link leaves: any two linked sets share
``SHARED`` tokens (or all that they must share, if fewer) among the first
``size - ceil(threshold * size) + SHARED`` of each in one common order, rare tokens
first (by a count over all documents, in hashed counters of fixed size), so
components of "shares as many such tokens, with sizes close enough" are a
partition. Pairs are counted where at most ``RUN`` sets share a token; a token of more joins all
of them, so a pair that shares one is together without being counted. One shared token would not do: texts that have
a phrase in common by chance grow with the square of the table, and chain up to one group.
A task joins its own documents that share a token of more than ``RUN`` before it sends
any: of each run of close sizes only the first and last of each size class go
on, which is all that others can be close to. So a token that a third of all documents
have costs a few rows a task, and nothing is dropped. Equal sets are one node all the way.

Within groups bitmaps go first, and texts follow only for documents to which
these allow a link. A group larger than ``BLOCK`` is cut into blocks; all blocks hold a
few common pivots (its first document and some others), which joins most of it. What
stays apart meets the whole group in wider blocks, first as bitmaps of ``SPARSE`` bits a token, so that nodes of
several documents still tell them apart: two trees are walked together layer by layer, and most pairs end above the leaves.
The texts that are still allowed follow. No pair is capped. A wide block has up to ``WIDE`` documents and ``TOKENS``
tokens, or a ``SPREAD``-th of its group if that is less, so its memory is bounded and a group spreads over tasks.

Defined cases: documents without words, with null or empty text are linked with
nothing; a text of fewer than five words is one shingle of all of them; rows
that share a doc_id count as one node; rows without one are nodes by their text, and a component's id is null
only if none of its documents has one; very long texts are whole sets like any
other; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import documents, groups, shuffle_partitions, slices
from corpusflow.llm.graph import components
from corpusflow.llm.shingles import shingle_sets
from corpusflow.plans.staging import Staging

PERCENT = 75
#: Documents without an id are nodes from here on, by their text, so that they are no component's smallest if another has an id.
NO_ID = 1 << 62
#: Documents in one block of a large group, and pivots that all its blocks hold.
BLOCK, PIVOTS = 64, 4
#: Most documents and tokens in a wide block, the number of wide blocks that a group has at least if it is not small, and bits of a bitmap for each token there.
WIDE, TOKENS, SPREAD, SPARSE = 4096, 4_000_000, 32, 32
#: Prefix tokens that two sets share at least to be of one group, and the most sets that share a token and are still looked at pair by pair.
SHARED, RUN = 3, 8
#: Prefix tokens that one table of candidate search holds on average.
PART_TOKENS = 4_000_000
#: Counters of token frequency: 2 ** 24 of 2 bytes, the largest thing broadcast. They hold 1365 * log2(1 + count), which no count outgrows.
COUNTER_BITS, STEPS = 24, 1365
_LEAF, _FANOUT = 4, 4
_REMEMBERED = 1_000_000


def prefix_length(size: int, percent: int = PERCENT) -> int:
    return min(size, size - -(-percent * size // 100) + SHARED)


def class_of(key: bytes) -> int:
    """A set's node in the candidate search, from its digest."""
    return int.from_bytes(key[:8], "big") >> 1


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    """The token bitmap of a set, as 64-bit words."""
    flags = np.zeros(bits, dtype=bool)
    flags[(tokens >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)] = True
    return np.packbits(flags).view(np.uint64)


def bitmap_bits(most: int) -> int:
    """The bitmap size for sets of at most ``most`` tokens: twice as many bits, within 2**8 and 2**16."""
    return 1 << min(16, max(8, (2 * most - 1).bit_length()))


class SignatureTree:
    """A tree over documents' sizes and bitmaps, which must be equally long for trees that meet; with ``sets`` leaf pairs can be compared."""

    def __init__(self, sizes: list[int], bitmaps: list[np.ndarray], sets: list[np.ndarray] | None = None):
        self.sets = sets
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        self.words, self.low, self.high, self.excess, self.below = [], [], [], [], []
        for i in order:
            self._add(bitmaps[i], sizes[i], sizes[i], sizes[i] - int(np.bitwise_count(bitmaps[i]).sum()), i)
        layer, width = list(range(len(order))), _LEAF
        while len(layer) > 1:
            parents = []
            for at in range(0, len(layer), width):
                kids = layer[at : at + width]
                self._add(np.bitwise_or.reduce([self.words[k] for k in kids]), min(self.low[k] for k in kids), max(self.high[k] for k in kids), max(self.excess[k] for k in kids), kids)
                parents.append(len(self.words) - 1)
            layer, width = parents, _FANOUT
        self.root = layer[0] if layer else None

    @classmethod
    def of(cls, sets: list[np.ndarray], bits: int | None = None) -> SignatureTree:
        bits = bits or bitmap_bits(max(map(len, sets), default=1))
        return cls([len(x) for x in sets], [bitmap(x, bits) for x in sets], sets)

    def _add(self, words, low, high, excess, below) -> None:
        for column, v in ((self.words, words), (self.low, low), (self.high, high), (self.excess, excess), (self.below, below)):
            column.append(v)

    def may_link(self, a: int, other: SignatureTree, b: int, percent: int) -> bool:
        """Whether bitmaps and sizes allow a link between documents below two nodes."""
        if 100 * self.high[a] < percent * other.low[b] or 100 * other.high[b] < percent * self.low[a]:
            return False
        need = -(-percent * (self.low[a] + other.low[b]) // (100 + percent))
        most = int(np.bitwise_count(self.words[a] & other.words[b]).sum()) + min(self.excess[a], other.excess[b])
        return min(most, self.high[a], other.high[b]) >= need


def tree_links(left: SignatureTree, right: SignatureTree, linked: list[int], percent: int = PERCENT, shift: int = 0) -> Iterator[tuple[int, int]]:
    """Links between two trees, or within one, that join what ``linked`` (a union-find forest) still holds apart.

    Documents of ``right`` are numbered after those of ``left`` by ``shift``. Trees without sets give
    all pairs that bitmaps and sizes allow, and join nothing.
    """

    def top(i: int) -> int:
        while linked[i] != i:
            linked[i] = linked[linked[i]]
            i = linked[i]
        return i

    if left.root is None or right.root is None:
        return
    todo = [(left.root, right.root)]
    while todo:
        a, b = todo.pop()
        one, two = left.below[a], right.below[b]
        if left is right and a == b:
            if not isinstance(one, int):
                todo += [(x, y) for k, x in enumerate(one) for y in one[k:]]
            continue
        ends = isinstance(one, int) and isinstance(two, int)
        if ends and top(one) == top(two + shift):
            continue
        if not left.may_link(a, right, b, percent):
            continue
        if ends and left.sets is None:
            yield one, two + shift
        elif ends:
            x, y = left.sets[one], right.sets[two]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                linked[max(top(one), top(two + shift))] = min(top(one), top(two + shift))
                yield one, two + shift
        elif isinstance(two, int) or (not isinstance(one, int) and left.high[a] - left.low[a] >= right.high[b] - right.low[b]):
            todo += [(x, b) for x in one]
        else:
            todo += [(a, y) for y in two]


class _Layers:
    """A signature tree's columns as arrays."""

    def __init__(self, tree: SignatureTree):
        self.words = np.stack(tree.words)
        self.low, self.high, self.excess = (np.array(x, dtype=np.int64) for x in (tree.low, tree.high, tree.excess))
        self.first = np.array([-1 if isinstance(x, int) else x[0] for x in tree.below])
        self.kids = np.array([0 if isinstance(x, int) else len(x) for x in tree.below])
        self.document = np.array([x if isinstance(x, int) else -1 for x in tree.below])


def _opened(nodes: np.ndarray, other: np.ndarray, tree: _Layers) -> tuple[np.ndarray, np.ndarray]:
    """The children of ``nodes``, each with its parent's partner."""
    n = tree.kids[nodes]
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(tree.first[nodes], n) + nth, np.repeat(other, n)


def allowed_pairs(left: SignatureTree, right: SignatureTree, comps: np.ndarray, percent: int = PERCENT, step: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Document pairs of two trees that sizes and bitmaps allow and ``comps`` (left's, then right's) holds apart, as arrays, with the number of node pairs looked at.

    A dual traversal of many node pairs at a time; ``step`` bounds the bytes of bitmaps that are compared at once.
    """
    if left.root is None or right.root is None:
        return
    a_tree, b_tree, shift = _Layers(left), _Layers(right), sum(isinstance(x, int) for x in left.below)
    most = max(1, step // a_tree.words[0].nbytes)
    todo = [(np.array([left.root]), np.array([right.root]))]
    while todo:
        a, b = todo.pop()
        if len(a) > most:
            todo += [(a[:-most], b[:-most])]
            a, b = a[-most:], b[-most:]
        looked = len(a)
        keep = (100 * a_tree.high[a] >= percent * b_tree.low[b]) & (100 * b_tree.high[b] >= percent * a_tree.low[a])
        ends = (a_tree.kids[a] == 0) & (b_tree.kids[b] == 0)
        keep[ends] &= comps[a_tree.document[a[ends]]] != comps[shift + b_tree.document[b[ends]]]
        a, b = a[keep], b[keep]
        need = -(-percent * (a_tree.low[a] + b_tree.low[b]) // (100 + percent))
        shared = np.bitwise_count(a_tree.words[a] & b_tree.words[b]).sum(axis=1, dtype=np.int64) + np.minimum(a_tree.excess[a], b_tree.excess[b])
        keep = np.minimum(np.minimum(shared, a_tree.high[a]), b_tree.high[b]) >= need
        a, b = a[keep], b[keep]
        ends = (a_tree.kids[a] == 0) & (b_tree.kids[b] == 0)
        yield a_tree.document[a[ends]], b_tree.document[b[ends]], looked
        a, b = a[~ends], b[~ends]
        # the side of the wider range of sizes is opened, or the one that is no leaf
        one = (b_tree.kids[b] == 0) | ((a_tree.kids[a] > 0) & (a_tree.high[a] - a_tree.low[a] >= b_tree.high[b] - b_tree.low[b]))
        down, partner = _opened(a[one], b[one], a_tree)
        if len(down):
            todo.append((down, partner))
        down, partner = _opened(b[~one], a[~one], b_tree)
        if len(down):
            todo.append((partner, down))


def folded(words: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap of fewer bits from a longer one."""
    flags = np.unpackbits(words.view(np.uint8))
    return words if len(flags) == bits else np.packbits(flags.reshape(bits, -1).any(axis=1)).view(np.uint64)


def counter_chunks(spark: SparkSession) -> int:
    """Into how many ranges the counters are dealt: a power of two that follows the shuffle's width."""
    return 1 << min(12, max(6, (shuffle_partitions(spark) - 1).bit_length()))


def token_sets(docs: DataFrame, staging: Staging) -> DataFrame:
    """Staged ``doc_id, n, key, sig`` of each row (the key digests the set, null if empty; ``sig`` is its bitmap), and each task's token counters in chunks."""
    fields = "doc_id long, n long, key binary, sig binary, chunk int, seen binary, dense boolean, places binary, counts binary"
    names = [c.split()[0] for c in fields.split(", ")]
    chunks = counter_chunks(docs.sparkSession)
    per = (1 << COUNTER_BITS) // chunks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, seen = np.zeros(1 << COUNTER_BITS, dtype=np.int32), set()
        for whole in batches:
            for batch in slices(whole, "text"):
                keys, n, sigs = [], [], []
                for tokens in shingle_sets(batch.column("text")):
                    key = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None
                    if key and key not in seen:
                        counters[(tokens >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)] += 1
                        if len(seen) < _REMEMBERED:
                            seen.add(key)
                    keys.append(key)
                    n.append(len(tokens))
                    sigs.append(bitmap(tokens, bitmap_bits(len(tokens))).tobytes() if key else None)
                none = [pa.nulls(len(n), t) for t in (pa.int32(), pa.binary(), pa.bool_(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), *none], names)
        for chunk in range(chunks):  # which counters are used, as places or as bits, and places and counts of those above one
            part = counters[chunk * per : (chunk + 1) * per]
            used, more = np.flatnonzero(part), np.flatnonzero(part > 1)
            if len(used):
                dense = 32 * len(used) > per
                seen_bytes = np.packbits(part > 0).tobytes() if dense else used.astype("<u4").tobytes()
                row = [None, None, None, None, chunk, seen_bytes, dense, more.astype("<u4").tobytes(), part[more].astype("<i4").tobytes()]
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.bool_(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    return staging.table(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, fields), "sets")


def token_counters(found: DataFrame) -> np.ndarray:
    """The counters of all tasks, summed, on a scale of logarithms: a fixed number."""
    chunks = counter_chunks(found.sparkSession)
    per = (1 << COUNTER_BITS) // chunks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.zeros(0, dtype=np.int64)

        def out() -> pa.RecordBatch:
            scaled = np.minimum(STEPS * np.log2(1.0 + own), 2**16 - 1).astype("<u2")
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([scaled.tobytes()])], ["chunk", "counts"])

        for batch in batches:  # in order of chunks; one range of counters is held, and what one task has found of it
            for chunk, seen, dense, places, counts in zip(*(batch.column(c) for c in ("chunk", "seen", "dense", "places", "counts")), strict=True):
                if chunk.as_py() != at:
                    if at is not None:
                        yield out()
                    at, own = chunk.as_py(), np.zeros(per, dtype=np.int64)
                if dense.as_py():
                    own += np.unpackbits(np.frombuffer(seen.as_py(), np.uint8))
                else:
                    own[np.frombuffer(seen.as_py(), "<u4")] += 1
                own[np.frombuffer(places.as_py(), "<u4")] += np.frombuffer(counts.as_py(), "<i4") - 1
        if at is not None:
            yield out()

    parts = found.where(F.col("chunk").isNotNull()).select("chunk", "seen", "dense", "places", "counts").repartition(shuffle_partitions(found.sparkSession), "chunk")
    out = np.zeros(1 << COUNTER_BITS, dtype=np.uint16)
    for r in parts.sortWithinPartitions("chunk").mapInArrow(run, "chunk int, counts binary").toLocalIterator():  # 32 MB in all
        out[r["chunk"] * per : (r["chunk"] + 1) * per] = np.frombuffer(r["counts"], "<u2")
    return out


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that connect what ``a`` and ``b`` do."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        old = label.copy()
        low = np.minimum(label[x], label[y])
        for end in (x, y, old[x], old[y]):
            np.minimum.at(label, end, low)
        while not np.array_equal(label[label], label):
            label = label[label]
        if np.array_equal(old, label):
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def shared_runs(token: np.ndarray, size: np.ndarray, node: np.ndarray, many: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Of rows ``token, size, node``: edges that join sets with a token of more than ``RUN``, or one marked as ``many``, and else all pairs ``a, b`` with the tokens that they share and those that a link needs."""
    order = np.lexsort((node, size, token))
    token, size, node, many = token[order], size[order], node[order], many[order]
    first = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])))) if len(token) else np.zeros(0, np.int64)
    many = np.logical_or.reduceat(many, first) if len(first) else many
    token, size, node = token[first], size[first], node[first]
    close = (token[1:] == token[:-1]) & (100 * size[:-1] >= percent * size[1:])
    run = np.concatenate(([0], np.cumsum(~close)))[: len(token)]
    many = ((np.bincount(run) > RUN) | (np.bincount(run, many) > 0))[run]
    at = np.flatnonzero(close & many[1:])
    one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, min(RUN, len(token))):
        one.append(np.flatnonzero(~many[:-d] & (run[:-d] == run[d:]) & (100 * size[:-d] >= percent * size[d:])))
        two.append(one[-1] + d)
    i, j = np.concatenate(one), np.concatenate(two)
    a, b, need = np.maximum(node[i], node[j]), np.minimum(node[i], node[j]), np.minimum(SHARED, -(-percent * size[j] // 100))
    order = np.lexsort((b, a))
    a, b, need = a[order], b[order], need[order]
    start = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, np.int64)
    return node[at], node[at + 1], (a[start], b[start], np.diff(np.append(start, len(a))), need[start])


def candidate_edges(docs: DataFrame, counters: np.ndarray, percent: int = PERCENT, tokens_in_all: int = 0) -> DataFrame:
    """Edges ``a, b`` of sets (``class_of``) whose components hold every link: those that share enough prefix tokens and may by their sizes link.

    Tokens are dealt into parts by their hash, so many that a part has some ``PART_TOKENS`` of the ``tokens_in_all`` at most.
    """
    spark = docs.sparkSession
    parts = max(2 * shuffle_partitions(spark), -(-tokens_in_all * (100 - percent) // (100 * PART_TOKENS)))
    shared = spark.sparkContext.broadcast(counters)
    fields = "part int, docs binary, sizes binary, owner binary, tokens binary, a binary, b binary"
    names = [c.split()[0] for c in fields.split(", ")]
    width = max(0.99 * np.log(100 / percent), 1e-9)  # sizes of one class are close enough to link

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        count, seen = shared.value, set()
        turn = TaskContext.get().partitionId()
        ids: list[int] = []
        sizes: list[int] = []
        tokens: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            flat, node, size = np.concatenate(tokens), np.array(ids), np.array(sizes)
            owner = np.repeat(np.arange(len(ids)), [len(t) for t in tokens])
            order = np.lexsort((size[owner], flat))
            flat, owner = flat[order], owner[order]
            n = size[owner]
            close = (flat[1:] == flat[:-1]) & (100 * n[:-1] >= percent * n[1:])
            run = np.concatenate(([0], np.cumsum(~close)))
            many = (np.bincount(run) > RUN)[run]
            kind = np.floor(np.log(n) / width)
            new = np.concatenate(([True], ~close | (kind[1:] != kind[:-1])))
            sent = np.flatnonzero(~many | new | np.concatenate((new[1:], [True])))
            at = np.flatnonzero(close & many[1:] & (node[owner[1:]] != node[owner[:-1]]))
            own = _forest(node[owner[at]], node[owner[at + 1]]) if len(at) else (np.zeros(0, np.int64),) * 2
            flat, owner, many = flat[sent], owner[sent], many[sent]
            part = (flat % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            rows = [(turn % parts, b"", b"", b"", b"", own[0].astype("<i8").tobytes(), own[1].astype("<i8").tobytes())]  # what this task has joined itself
            for p in np.flatnonzero(np.diff(cuts)):
                mine = order[cuts[p] : cuts[p + 1]]
                used, place = np.unique(owner[mine], return_inverse=True)
                marked = place.astype("<u4") | (many[mine].astype("<u4") << np.uint32(31))
                rows.append((int(p), node[used].astype("<i8").tobytes(), size[used].astype("<i4").tobytes(), marked.tobytes(), flat[mine].astype("<u8").tobytes(), b"", b""))
            kinds = [pa.int32(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        held = 0
        for whole in batches:
            for batch in slices(whole, "text"):
                for doc, found in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text")), strict=True):
                    if doc is None or not len(found):
                        continue
                    key = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                    if key in seen:
                        continue
                    if len(seen) < _REMEMBERED:
                        seen.add(key)
                    often = count[(found >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
                    first = prefix_length(len(found), percent)
                    ids.append(class_of(key))
                    sizes.append(len(found))
                    tokens.append(found[np.lexsort((found, often))[:first]])
                    held += first
                if held > 1_500_000:
                    yield out()
                    ids, sizes, tokens, held, turn = [], [], [], 0, turn + 1
        if ids:
            yield out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_a, held_b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for table in groups(batches, ["part"]):
            columns = {c: [np.frombuffer(x, k) for x in table.column(c).to_pylist()] for c, k in (("docs", "<i8"), ("sizes", "<i4"), ("owner", "<u4"), ("tokens", "<u8"), ("a", "<i8"), ("b", "<i8"))}
            place = [o & np.uint32(0x7FFFFFFF) for o in columns["owner"]]
            node = np.concatenate([d[o] for d, o in zip(columns["docs"], place, strict=True)])
            size = np.concatenate([s[o] for s, o in zip(columns["sizes"], place, strict=True)]).astype(np.int64)
            many = np.concatenate(columns["owner"]) >> np.uint32(31) > 0
            a, b, pairs = shared_runs(np.concatenate(columns["tokens"]), size, node, many, percent)
            a, b = np.concatenate((held_a, a, *columns["a"])), np.concatenate((held_b, b, *columns["b"]))
            if len(a):
                held_a, held_b = _forest(a, b)
            yield from batches_of(*pairs)
        yield from batches_of(held_a, held_b, *np.zeros((2, len(held_a)), np.int64))

    def batches_of(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(columns[0]), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 50_000]) for x in columns], ["a", "b", "shared", "need"])

    packed = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(emit, fields)
    dealt = packed.repartition(shuffle_partitions(spark), "part").sortWithinPartitions("part")
    met = dealt.mapInArrow(meet, "a long, b long, shared long, need long")
    return met.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("need").alias("need")).where("shared >= need").select("a", "b")


def possible_nodes(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``cluster, node`` of those ``rows`` (cluster, node, n, sig) to which sizes and bitmaps allow a link with another node of their cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["cluster"]):
            nodes, sizes, sigs = (table.column(c).to_pylist() for c in ("node", "n", "sig"))
            bits = 8 * min(map(len, sigs))
            tree = SignatureTree(sizes, [folded(np.frombuffer(x, np.uint64), bits) for x in sigs])
            found = {nodes[i] for pair in tree_links(tree, tree, list(range(len(nodes))), percent) for i in pair}
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([table.column("cluster")[0].as_py()] * len(found), sorted(found))], ["cluster", "node"])

    return rows.repartition(shuffle_partitions(rows.sparkSession), "cluster").sortWithinPartitions("cluster").mapInArrow(run, "cluster long, node long")


def _with_texts(rows: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(texts, "node").repartition(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)


def links_within(rows: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """What is connected inside each (cluster, block) of ``rows`` (cluster, block, node): ``a, b``, each node with the smallest that it is linked to over others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["cluster", "block"]):
            table = table.combine_chunks()
            nodes = table.column("node").to_pylist()
            sets = [s for chunk in table.to_batches() for s in shingle_sets(chunk.column("text"))]
            tree = SignatureTree.of(sets)
            linked = list(range(len(sets)))
            for _ in tree_links(tree, tree, linked, percent):
                pass
            least = list(nodes)
            for i, up in enumerate(linked):  # a document's way up leads to smaller places only
                linked[i] = linked[up]
                least[linked[i]] = min(least[linked[i]], nodes[i])
            found = [(n, least[up]) for n, up in zip(nodes, linked, strict=True) if n != least[up]]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    return _with_texts(rows, texts, ["cluster", "block"]).mapInArrow(run, "a long, b long")


def links_between(rows: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links between the two sides of each (cluster, one, two) of ``rows`` (cluster, one, two, side, node, comp), where ``comp`` differs."""
    keys = ["cluster", "one", "two"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, keys):
            sides: list[tuple[list, list, list]] = [([], [], []), ([], [], [])]
            for batch in table.to_batches():
                values = (batch.column(c).to_pylist() for c in ("side", "node", "comp"))
                for side, node, comp, tokens in zip(*values, shingle_sets(batch.column("text")), strict=True):
                    for column, v in zip(sides[side], (node, comp, tokens), strict=True):
                        column.append(v)
            nodes, comps = (sides[0][k] + sides[1][k] for k in (0, 1))
            first: dict[int, int] = {}
            linked = [first.setdefault(c, i) for i, c in enumerate(comps)]
            bits, n = bitmap_bits(max(map(len, sides[0][2] + sides[1][2]), default=1)), len(sides[0][0])
            found = [(nodes[i], nodes[j]) for i, j in tree_links(SignatureTree.of(sides[0][2], bits), SignatureTree.of(sides[1][2], bits), linked, percent, n)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    return _with_texts(rows, texts, keys).mapInArrow(run, "a long, b long")


def signatures(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``node, size, words``: size and bitmap of each of ``rows`` (node, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(batch.column("text"))
                words = [bitmap(s, n).tobytes() for s, n in zip(sets, batch.column("bits").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(map(len, sets), pa.int64()), pa.array(words, pa.binary())], ["node", "size", "words"])

    return rows.join(texts, "node").select("node", "bits", "text").mapInArrow(run, "node long, size long, words binary")


def possible_pairs(rows: DataFrame, signed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of ``rows`` (cluster, one, two, side, node, comp) that bitmaps allow a link to another component on the other side."""
    keys = ["cluster", "one", "two"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, keys):
            rows = list(zip(*(table.column(c).to_pylist() for c in ("side", "node", "comp", "size", "words")), strict=True))
            sides = [[r for r in rows if r[0] == k] for k in (0, 1)]
            both = sides[0] + sides[1]
            trees = [SignatureTree([r[3] for r in side], [np.frombuffer(r[4], np.uint64) for r in side]) for side in sides]
            found: set[int] = set()
            for one, two, _ in allowed_pairs(*trees, np.array([r[2] for r in both]), percent):
                found.update(one.tolist(), (two + len(sides[0])).tolist())
            if found:
                same = [[table.column(c)[0].as_py()] * len(found) for c in keys]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*same, *zip(*(both[i][:3] for i in sorted(found)), strict=True)], kinds, strict=True)], [*keys, "side", "node", "comp"])

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    return _with_texts(rows, signed, keys).mapInArrow(run, "cluster long, one int, two int, side int, node long, comp long")


def _each(n: str) -> F.Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _deal(node: str, n: str, seed: int) -> F.Column:
    return F.pmod(F.xxhash64(node, F.lit(seed)), F.col(n)).cast("int")


def jaccard_components(docs: DataFrame, staging: Staging | None = None, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs`` (doc_id, text)."""
    staging = staging or Staging(docs.sparkSession)
    by_text = F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("text"), 2)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), by_text).alias("doc_id"), "text")
    found = token_sets(docs, staging)
    counters = token_counters(found)

    # equal sets are one class, named by its smallest doc_id
    sets = found.where(F.col("n").isNotNull()).select("doc_id", "n", "key", "sig")
    several = staging.table(sets.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c"), "classes")
    held = F.shiftrightunsigned(F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long"), 1)  # class_of, of a class's first document
    owned = staging.table(sets.drop("sig").join(several, "key", "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"), F.when(F.coalesce("rep", "doc_id") == F.col("doc_id"), held).alias("class")), "owned")

    tokens = sets.agg(F.sum("n")).first()[0] or 0
    apart = components(candidate_edges(docs, counters, percent, tokens), staging)
    nodes = apart.select(F.col("a").alias("class"), F.col("b").alias("cluster")).unionByName(apart.select(F.col("b").alias("class"), F.col("b").alias("cluster")).distinct())
    members = staging.table(nodes.join(owned.where(F.col("class").isNotNull()), "class").select("cluster", F.col("rep").alias("node")).distinct(), "members")
    sized = staging.table(
        members.groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("c"), F.min(F.struct("node")).alias("p0"), *[F.min(F.struct(F.xxhash64("node", F.lit(s)), "node")).alias(f"p{s}") for s in range(1, PIVOTS)]).where("c > 1"),
        "clusters",
    )
    # bitmaps first: in a group of one block, texts are only read where these allow a link
    rows = staging.table(members.join(sized.select("cluster", "blocks"), "cluster"), "rows")
    small = rows.where("blocks = 1").select("cluster", "node").join(sets.where("sig IS NOT NULL").select(F.col("doc_id").alias("node"), "n", "sig").hint("merge"), "node")
    possible = possible_nodes(small, percent).withColumn("blocks", F.lit(1))
    rows = staging.table(rows.where("blocks > 1").select("cluster", "node", "blocks").unionByName(possible), "open-rows")
    wanted = staging.table(rows.select("node").distinct(), "wanted")
    texts = staging.table(docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(wanted.hint("merge"), "node", "left_semi"), "texts")
    own = rows.select("cluster", _deal("node", "blocks", 0).alias("block"), "node")
    large = sized.where("blocks > 1")
    pivots = large.select("cluster", _each("blocks").alias("block"), F.array_distinct(F.array(*[f"p{s}.node" for s in range(PIVOTS)])).alias("nodes")).select("cluster", "block", F.explode("nodes").alias("node"))
    links = staging.table(links_within(staging.table(own.unionByName(pivots).distinct(), "blocks"), texts, percent), "links")
    joined = components(links, staging)

    if large.limit(1).count():  # what stays apart in large groups meets all other blocks
        comp = joined.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        placed = staging.table(
            members.join(large.select("cluster", "blocks"), "cluster").join(comp, "node", "left").select("cluster", "blocks", "node", F.coalesce("comp", "node").alias("comp")), "placed"
        )
        main = placed.groupBy("cluster", "comp").agg(F.count("*").alias("c")).groupBy("cluster").agg(F.max(F.struct("c", "comp")).alias("main"), F.sum("c").alias("all"))
        main = main.where(F.col("main.c") < F.col("all")).select("cluster", F.col("main.comp").alias("main"), "all", (F.col("all") - F.col("main.c")).alias("rest"))
        most = placed.join(owned.select(F.col("doc_id").alias("node"), "n"), "node").groupBy("cluster").agg(F.max("n").alias("n"))
        bits = F.least(F.lit(1 << 16), F.greatest(F.lit(1 << 8), F.pow(F.lit(2), F.ceil(F.log2(SPARSE * F.col("n"))))).cast("int"))
        wide = F.greatest(F.lit(block), F.least(F.lit(WIDE), F.floor(TOKENS / F.col("n")), F.ceil(F.col("all") / SPREAD)))
        main = staging.table(main.join(most, "cluster").select("cluster", "main", bits.alias("bits"), F.ceil(F.col("rest") / wide).cast("int").alias("rests"), F.ceil(F.col("all") / wide).cast("int").alias("alls")), "main")
        open_ = staging.table(placed.join(main, "cluster").select("cluster", "node", "comp", "main", "bits", "rests", "alls"), "open")
        signed = staging.table(signatures(open_.select("node", "bits"), texts), "signatures")
        rest = open_.where("comp <> main").select("cluster", _deal("node", "rests", 1).alias("one"), _each("alls").alias("two"), F.lit(0).alias("side"), "node", "comp")
        every = open_.select("cluster", _each("rests").alias("one"), _deal("node", "alls", 0).alias("two"), F.lit(1).alias("side"), "node", "comp")
        possible = staging.table(possible_pairs(staging.table(rest.unionByName(every), "pairs"), signed, percent), "possible")
        more = staging.table(links_between(possible, texts, percent), "more-links")
        joined = components(joined.unionByName(more), staging)

    ends = joined.select(F.col("a").alias("rep"), F.col("b").alias("component"))
    given = lambda c: F.when(c < NO_ID, c)
    return owned.join(ends, "rep", "left").select(given(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), given(F.coalesce("component", "rep")).alias("component_id"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))
