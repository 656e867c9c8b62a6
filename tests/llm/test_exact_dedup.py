import hashlib
from collections import defaultdict

from corpusflow.llm.exact_dedup import exact_duplicates


def expected(rows):
    by = defaultdict(list)
    for d, t in rows:
        by[t or ""].append(d)
    return {(d, max(by[t or ""]), len(by[t or ""]), d == max(by[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows}


def test_block_naming_against_brute_force(spark, table):
    long = "é" * 50 + "abc" * 40
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, long), (6, long), (7, long + "x"), (8, "x" + long), (9, "A"), (10, "a "), (11, long[:-1]), (12, "ab" * 8), (13, "ab" * 16), (14, "ab" * 16)]
    for block in (4, 16, 4096):
        got = exact_duplicates(table(rows).repartition(3), block_bytes=block).collect()
        assert {tuple(r) for r in got} == expected(rows) and len(got) == len(rows)


def test_repeated_rows_keep_one(spark, table):
    got = exact_duplicates(table([(1, "t"), (1, "t"), (1, "u"), (None, "t")])).collect()
    assert sorted((r["doc_id"] or 0, r["keep_id"], r["group_size"]) for r in got) == [(0, 1, 3), (1, 1, 1), (1, 1, 3), (1, 1, 3)]
    assert sum(r["kept"] for r in got) == 2


def test_empty_table(spark, table):
    assert exact_duplicates(table([])).count() == 0
