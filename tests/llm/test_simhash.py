import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusflow.llm import simhash as S


def by_definition(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def by_pairs(prints, most=4):
    top = list(range(len(prints)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB É\t\n \x1fc", max_size=60))
def test_fingerprint(text):
    assert S.fingerprint(text.encode()) == by_definition(text)


def test_fingerprint_of_a_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(S, "_SHINGLES", 7)
    text = " ".join(f"w{i % 13}x{i}" for i in range(100))
    assert S.fingerprint(text.encode()) == by_definition(text)


def flipped(rng, n, base, most):
    out = {int(base)}
    while len(out) < n:
        x = int(base)
        for b in rng.choice(64, rng.integers(0, most + 1), replace=False):
            x ^= 1 << int(b)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("cell, block", [(S.CELL, S.BLOCK), (20, S.BLOCK), (4, 3)])
def test_links_against_all_pairs(spark, cell, block):
    """With all cells held, with finer grids, and with finer grids and blocks."""
    from corpusflow.llm.graph import components
    from corpusflow.plans.staging import Staging

    rng = np.random.default_rng(5)
    prints = set(rng.integers(0, 2**64, 150, dtype=np.uint64).tolist()) | set(flipped(rng, 120, 0, 5)) | set(flipped(rng, 60, 2**64 - 1, 9)) | set(flipped(rng, 60, rng.integers(0, 2**64, dtype=np.uint64), 12))
    prints = sorted(prints)
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    staging = Staging(spark)
    pairs = S.links(spark.createDataFrame([(x,) for x in signed], "fp long"), staging, cell=cell, block=block)
    tied = {r["a"]: r["b"] for r in components(pairs, staging).collect()}
    got, expected = {}, {}
    for x, top in zip(signed, by_pairs(prints), strict=True):
        got.setdefault(tied.get(x, x), set()).add(x)
        expected.setdefault(top, set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 4))
def test_linked_prints_share_a_cell_of_both_grids(seed, flips):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**64, dtype=np.uint64)
    b = a
    for bit in rng.choice(64, flips, replace=False):
        b ^= np.uint64(1 << int(bit))
    _, ka = S._first_cells(np.array([a]))
    _, kb = S._first_cells(np.array([b]))
    shared = np.intersect1d(ka, kb)
    assert len(shared) and len(set(ka.tolist())) == len(ka)
    for key in shared:
        finer = [set(S._finer_cells(np.array([x]), np.array([key]))[1].tolist()) for x in (a, b)]
        assert finer[0] & finer[1]


def test_search_and_pairs_agree():
    rng = np.random.default_rng(3)
    fp = np.array(flipped(rng, 300, 0, 6), dtype=np.uint64)
    expected = by_pairs([int(x) for x in fp])
    assert S._reached(fp, 4).tolist() == expected
    assert S._paired(fp, np.array([0]), np.array([300]), 4).tolist() == expected


def test_documents(spark, table):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(5, base), (2, base + " more"), (9, base.upper()), (7, None), (3, ""), (8, " \t\n"), (4, "one"), (4, "one"), (None, "two words"), (None, base), (11, "ONE"), (12, "quite another text of some words here")]
    got = S.near_duplicates(table(rows).repartition(3)).collect()
    prints = [by_definition(t) for _, t in rows]
    top, least = by_pairs(prints), {}
    for (d, _), t in zip(rows, top, strict=True):
        least[t] = min((x for x in (d, least.get(t)) if x is not None), default=None)
    expected = [(d, f"{p:016x}", least[t]) for (d, _), p, t in zip(rows, prints, top, strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


def test_given_documents_and_none(spark, table, sf_dir):
    given_rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    prints = [by_definition(t) for _, t in given_rows]
    top = by_pairs(prints)
    least = {}
    for (d, _), t in zip(given_rows, top, strict=True):
        least[t] = min(d, least.get(t, d))
    got = {tuple(r) for r in S.op11_simhash(spark, sf_dir).collect()}
    assert got == {(d, f"{p:016x}", least[t]) for (d, _), p, t in zip(given_rows, prints, top, strict=True)}
    assert S.near_duplicates(table([])).count() == 0
