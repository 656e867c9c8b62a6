import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusflow.llm import vector_codes as V


def expected(rows, parts, entries, rounds):
    """Codes, errors, and the codebooks' digest, in plain Python."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = max((len(v) for _, v, _ in kept), default=0)
    width = -(-size // parts)
    kept = [(i, v + [0] * (parts * width - len(v)), label) for i, v, label in kept]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    start = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in start] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda book, x: min((apart(x, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            by = {}
            for _, v, _ in kept:
                by.setdefault(nearest(books[p], cut(v, p))[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(by[k]) for c in zip(*by[k], strict=True)] if k in by else e for k, e in enumerate(books[p])]
    out = []
    for i, v, label in kept:
        found = [nearest(books[p], cut(v, p)) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 3, 50, 1 << 22]), st.integers(1, 80), st.integers(1, 4))
def test_gnat_finds_the_first_nearest(seed, spread, entries, width):
    rng = np.random.default_rng(seed)
    book = rng.integers(-spread, spread + 1, (entries, width))
    queries = np.concatenate((rng.integers(-2 * spread, 2 * spread + 1, (40, width)), book[:10]))
    number, squared = V.Gnat(book).nearest(queries)
    all_ = ((queries[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert number.tolist() == all_.argmin(axis=1).tolist() and squared.tolist() == all_.min(axis=1).tolist()


def test_gnat_leaves_out_subtrees():
    rng = np.random.default_rng(1)
    tree, queries = V.Gnat(rng.integers(-40, 40, (64, 4))), rng.integers(-40, 40, (2000, 4))
    tree.nearest(queries)
    assert tree.compared < 0.7 * 64 * 2000


def make(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit(1)).withColumn("error", F.lit("x"))


@pytest.mark.parametrize("entries", [4, 64])
def test_against_brute_force(spark, entries):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=10)], int(i) % 3 or None) for i in rng.permutation(120)]
    rows += [(200 + i, [0.5] * 10, 7) for i in range(20)] + [(None, [0.25] * 10, 7), (5, [1.0, -2.0], None), (5, [1.0, -2.0], None), (300, [], 1)]
    rows += [(400, None, 1), (401, [1.0, None], 1), (402, [float("nan")] * 10, 1), (403, [float("-inf")] * 10, 1)]
    codes, books = V.compress(make(spark, rows).repartition(4), parts=4, entries=entries)
    out, sha = expected(rows, 4, entries, V.ROUNDS)
    assert sorted(map(repr, map(tuple, codes.collect()))) == sorted(map(repr, out)) and V.digest(books) == sha


def test_few_and_no_vectors(spark):
    codes, books = V.compress(make(spark, []))
    assert codes.count() == 0 and books.size == 0
    codes, _ = V.compress(make(spark, [(1, [], 1), (2, None, 1)]))
    assert [tuple(r) for r in codes.collect()] == [(1, 1, "00" * V.PARTS, 0)]
    with pytest.raises(Exception, match="beyond"):
        V.compress(make(spark, [(1, [1e30], 1)]))[0].count()


def test_given_vectors(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    out, sha = expected(rows, V.PARTS, V.ENTRIES, V.ROUNDS)
    by = {}
    for _, label, _, e in out:
        by[label] = by.get(label, 0) + e
    got = {tuple(r) for r in V.op13_vector_codes(spark, sf_dir).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()}
    assert got == {(i, code, e, by[label], sha) for i, label, code, e in out}
