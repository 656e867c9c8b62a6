import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusflow.llm import spelling as P


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows, edit=True):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if edit and h % 97 == 0 else run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}
    form, out = {}, set()
    nears = {w: [v for v in n if near(w, v)] for w in n}
    for w, vs in nears.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(nears[w]), n[form[w]] if form[w] else None))
    return out


def test_against_all_pairs(spark, table):
    words = ["aabbcc", "aabbc", "abbcc", "aabbcd", "aabbccc", "ÀÉÎõÿ", "àÉÎõÿ", "ÀÉÎõ", "hello", "hallo", "hello", "helloo", "xhello", "jello", "hell", "banana", "bananas", "bananna", "zzzzz", "zzzzzz", "zzzzzzz"]
    rows = [(i, " ".join(f"{w} " * (1 + (i * k) % 4) for k, w in enumerate(words))) for i in range(40)]
    rows += [(1, "HELLO Hello hello$hello"), (None, "hello hallo " * 3), (50, None), (51, ""), (51, "banana" * 3 + "×÷ word" * 4)]
    got = P.spelling_variants(table(rows).repartition(3), edit=P.deleted_point).collect()
    assert {tuple(r) for r in got} == expected(rows) and len(got) == len(expected(rows))


def test_chains_and_ties(spark, table):
    chain = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96, "ccccc": 4, "ccccd": 8, "cccce": 8}
    rows = [(1, " ".join(w for w, n in chain.items() for _ in range(n)))]
    got = {tuple(r) for r in P.spelling_variants(table(rows)).collect()}
    assert got == expected(rows, edit=False)
    assert {r[2] for r in got if r[0].startswith(("a", "b"))} == {"bbbbb"} and ("ccccc", "ccccd", "ccccd", 4, 2, 8) in got


def test_given_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in P.op12_spelling_variants(spark, sf_dir).collect()} == expected(rows)


def test_no_documents(spark, table):
    assert P.spelling_variants(table([])).count() == 0
    assert P.spelling_variants(table([(1, None), (2, "a bc")])).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab .É", max_size=60), st.integers(1, 9))
def test_long_texts_in_pieces(text, piece):
    pattern, before = re.compile(f"[{P.ALPHABET}]+"), P.PIECE
    try:
        P.PIECE = piece
        assert [r for runs in P._runs(text, pattern) for r in runs] == pattern.findall(text)
    finally:
        P.PIECE = before
