import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusflow.llm import topk_search as t


def expected(rows, k):
    ok = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q, v in ok.items():
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in ok.items() if i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("blocks", [(7, 2), (t.BLOCK_ROWS, t.QUERY_ROWS)])
def test_against_brute_force(spark, blocks):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(150)] + [(200 + i, [0.5] * 8) for i in range(30)]
    rows += [(400, None), (450, [1.0, None]), (500, [float("nan")] * 8), (550, [float("inf")] * 8), (600, [0.25, 0.5]), (650, [])]
    given_ = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("b", F.lit(2))
    vectors = given_.select("vec_id", t.quantise(F.col("embedding")).alias("v")).where("v IS NOT NULL")
    got = t.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5, *blocks).collect()
    assert {tuple(r) for r in got} == expected(rows, 5) and len(got) == len(expected(rows, 5))


def test_few_and_no_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, v array<long>")
    two = make([(0, [1, 2]), (1, [3, 4])])
    assert [tuple(r) for r in t.top_k(two, two.where("vec_id = 0")).collect()] == [(0, 1, 1, 11)]
    assert t.top_k(make([]), make([])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 2, 40]))
def test_index_stops_only_on_proof(seed, spread):
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-60 * spread, 60 * spread, (300, 6))
    vectors[rng.integers(0, 300, 80)] = vectors[0]
    ids = rng.permutation(1000)[:300]
    index = t.ImpactIndex(ids, vectors)
    query = vectors[rng.integers(300)]
    found, score = index.search(query, int(ids[3]), 5)
    best = sorted((-int(v @ query), int(i)) for i, v in zip(ids, vectors, strict=True) if i != ids[3])[:5]
    assert [(-s, i) for s, i in zip(score.tolist(), found.tolist(), strict=True)] == best


def test_proof_stops_early_on_the_given_table():
    import pyarrow.parquet as pq

    e = pq.read_table("/root/testdata/sf0.1/embeddings.parquet", columns=["vec_id", "embedding"]).to_pandas()
    ids, v = e["vec_id"].to_numpy(), np.floor(256 * np.stack(e["embedding"].to_numpy()).astype(np.float64)).astype(np.int64)
    index = t.ImpactIndex(ids, v)
    for i in np.flatnonzero(ids % 50 == 0):
        possible = index.possible(v[i], int(ids[i]))
        assert len(possible) < 0.1 * len(ids)
        scores = v @ v[i]
        best = sorted((-int(scores[j]), int(ids[j])) for j in range(len(ids)) if j != i)[:5]
        assert {x for _, x in best} <= set(ids[possible].tolist())


def test_rows_without_id_and_oversized_components(spark):
    rows = spark.createDataFrame([(None, [1, 2]), (50, [3, 4]), (3, [5, 6]), (None, None)], "vec_id long, v array<long>").where("v IS NOT NULL")
    assert [tuple(r) for r in t.top_k(rows, rows.where("vec_id % 50 = 0")).collect()] == [(50, 1, 3, 39)]
    raw = spark.createDataFrame([(1, [65536.0]), (2, [-65536.0])], "vec_id long, embedding array<float>")
    assert sorted(r[0][0] for r in raw.select(t.quantise(F.col("embedding"))).collect()) == [-(1 << 24), 1 << 24]
    with pytest.raises(Exception, match="beyond"):
        spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<float>").select(t.quantise(F.col("embedding"))).collect()
