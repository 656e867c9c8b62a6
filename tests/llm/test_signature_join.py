import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusflow.llm import signature_join as j
from corpusflow.llm.shingles import shingle_sets


def shingles(text):
    w = (text or "").encode().lower().split()
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def expected(rows):
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    top = {d: d for d, _ in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and 100 * len(x & y) >= 75 * len(x | y):
            lo, hi = sorted((find(a), find(b)))
            top[hi] = lo
    return {(d, len(s), find(d)) for d, s in sets}


def edited(words, rng, share):
    return " ".join(rng.choice(["zq", "yk", "xv"]) + str(rng.randrange(10**6)) if rng.random() < share else w for w in words)


def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocab) for _ in range(120)]
    texts = [None, "", "   ", "one two", "One TWO", "one two three four five six", "ÀB c d e f", "àb c d e f"]
    texts += [edited(base, rng, 0.02) for _ in range(40)] + [edited(base, rng, 0.012) for _ in range(40)]  # a large group, near the threshold
    texts += [" ".join(base)] * 5 + [" ".join(base[:60])] * 2
    for _ in range(30):  # small groups and single texts of several sizes
        own = [rng.choice(vocab) for _ in range(rng.choice([5, 6, 9, 40, 300]))]
        texts += [" ".join(own), edited(own, rng, 0.02), " ".join(own + base[:30])]
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [8, 64])
def test_components_against_brute_force(spark, table, block):
    rows = corpus()
    got = j.jaccard_components(table(rows).repartition(4), block=block).collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got} == expected(rows)


def test_repeated_rows_null_ids_and_long_words(spark, table):
    long = "x" * 70_000 + " a b c d e"
    got = j.jaccard_components(table([(3, long), (2, long + " "), (3, long), (None, "q w e r t y"), (9, "z" * 70_001 + " a b c d e")])).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in got) == [(-1, 2, -1), (2, 2, 2), (3, 2, 2), (3, 2, 2), (9, 2, 9)]


def test_empty_table(spark, table):
    assert j.jaccard_components(table([])).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=30), min_size=1, max_size=40), st.sampled_from([50, 75, 90]))
def test_tree_finds_all_links(sets, percent):
    rng = np.random.default_rng(3)
    names = rng.integers(0, 2**63, 41).astype(np.uint64) * np.uint64(2)
    arrays = [np.unique(names[sorted(s)]) for s in sets]
    tree = j.SignatureTree.of(arrays, 256)
    linked = list(range(len(sets)))
    for a, b in j.tree_links(tree, tree, linked, percent):
        assert 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])

    def top(i):
        while linked[i] != i:
            i = linked[i]
        return i

    for a, b in itertools.combinations(range(len(sets)), 2):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            assert top(a) == top(b)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tAbCé\x0b\x1c", max_size=40), min_size=1, max_size=6))
def test_shingles_are_those_of_the_words(texts):
    import pyarrow as pa

    got = shingle_sets(pa.array(texts))
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    for (a, x), (b, y) in itertools.combinations(zip(texts, got, strict=True), 2):
        assert len(np.intersect1d(x, y)) == len(shingles(a) & shingles(b))


def test_rows_without_id(spark, table):
    """Each is a document; a component has no id only if none of its documents has one."""
    from corpusflow.llm.signature_join import jaccard_components

    base = " ".join(f"w{i}" for i in range(40))
    rows = [(None, "one two three four five six"), (4, "one two three four five six"), (None, "another text of more than five words"), (8, None), (None, base), (9, base + " more"), (None, base + " and more of it")]
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in jaccard_components(table(rows)).collect())
    assert got == [(0, 2, 4), (0, 3, 0), (0, 36, 9), (0, 40, 9), (4, 2, 4), (8, 0, 8), (9, 37, 9)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=25), max_size=30), st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=25), max_size=30), st.sampled_from([50, 75]), st.sampled_from([100, 1 << 20]))
def test_layered_traversal_finds_all_links_between_components(left, right, percent, step):
    rng = np.random.default_rng(3)
    names = rng.integers(0, 2**63, 31).astype(np.uint64) * np.uint64(2)
    arrays = [[np.unique(names[sorted(s)]) for s in side] for side in (left, right)]
    comps = np.array([len(s) % 5 for s in left + right])
    found = set()
    for a, b, _ in j.allowed_pairs(*(j.SignatureTree.of(x, 256) for x in arrays), comps, percent, step):
        found.update(zip(a.tolist(), b.tolist(), strict=True))
    for a, b in found:
        assert comps[a] != comps[len(left) + b]
    for a, x in enumerate(left):
        for b, y in enumerate(right):
            if comps[a] != comps[len(left) + b] and 100 * len(x & y) >= percent * len(x | y):
                assert (a, b) in found


def chain(documents, length=60, step=12, twins=50):
    """Windows over one sequence of words, which share a fifth or more with the next but do not link, and a few that differ from their window in the last word alone."""
    words = [f"w{i}" for i in range(documents * step + length)]
    rows = [(i, " ".join(words[i * step : i * step + length])) for i in range(documents)]
    return rows + [(documents + k, " ".join([*words[i * step : i * step + length - 1], "other"])) for k, i in enumerate(range(0, documents, documents // twins))]


def test_a_chained_group_without_links(spark, table):
    """One group of shared rare shingles, in which only the twins link."""
    rows = chain(1500)
    got = {r["doc_id"]: r["component_id"] for r in j.jaccard_components(table(rows).repartition(4)).collect()}
    assert got == {i: i if i < 1500 else (i - 1500) * 30 for i in range(1550)}


def test_most_pairs_end_above_the_leaves():
    """Unrelated documents of one size: node pairs looked at are far fewer than document pairs."""
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64)) for _ in range(1024)]
    tree = j.SignatureTree.of(sets, 1 << 14)
    looked = sum(n for _, _, n in j.allowed_pairs(tree, tree, np.tile(np.arange(1024), 2)))
    assert looked < 1024**2 / 4


def test_one_phrase_in_common_makes_no_group(spark, table):
    """Each text shares a phrase with the next, in an order of tokens that does not know rare ones; only twins are candidates."""
    phrase = lambda i: " ".join(f"p{i}w{k}" for k in range(5))
    rows = [(i, f"{phrase(i)} {phrase(i + 1)}") for i in range(2000)] + [(10_000 + i, f"{phrase(i)} {phrase(i + 1)} {'more ' * i}") for i in range(1, 3)]
    edges = j.candidate_edges(table(rows).repartition(4), np.zeros(1 << j.COUNTER_BITS, np.uint16)).collect()
    assert 1 <= len(edges) <= 3


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=25), min_size=1, max_size=40), st.sampled_from([50, 75, 90]), st.integers(0, 9))
def test_shared_runs_join_all_links(sets, percent, seed):
    rng = np.random.default_rng(seed)
    rank = rng.permutation(31)
    nodes = rng.permutation(len(sets))
    rows = [(t, len(s), nodes[i], rng.random() < 0.05) for i, s in enumerate(sets) for t in sorted(s, key=rank.__getitem__)[: j.prefix_length(len(s), percent)]]
    token, size, node, many = (np.array(c) for c in zip(*rows, strict=True))
    a, b, pairs = j.shared_runs(token.astype(np.uint64), size, node, many, percent)
    edges = [*zip(a.tolist(), b.tolist(), strict=True), *((x, y) for x, y, shared, need in zip(*pairs, strict=True) if shared >= need)]
    top = list(range(len(sets)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for x, y in edges:
        top[find(x)] = find(y)
    for (x, s), (y, t) in itertools.combinations(zip(nodes, sets, strict=True), 2):
        if 100 * len(s & t) >= percent * len(s | t):
            assert find(x) == find(y)
