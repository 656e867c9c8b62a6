import random

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusflow.llm import line_dedup as d

A, B, C = "a passage of some words that is long", "another passage that is long as well", "a third passage, long too, and shared"


def test_later_documents_lose_common_blocks(spark, table):
    rows = [
        (1, f"{A}\n{B}\nown line of the first document"), (2, f"start of the second text\n{A}\n{B}\nend of the second text"), (3, f"{B}\n{C}\n\nown of three is here"),
        (4, f"{C}\n  {A}  \nshort\n{C}"), (5, "short"), (6, None), (7, ""), (8, "\n\n"), (9, A),
    ]
    got = {r["doc_id"]: r for r in d.dedup_lines(table(rows).repartition(3)).collect()}
    assert got[1]["n_removed"] == 0
    assert got[2]["text"] == "start of the second text\nend of the second text" and got[2]["from_ids"] == [1]
    assert got[3]["text"] == f"{C}\n\nown of three is here"
    assert got[4]["n_removed"] >= 2 and "short" in got[4]["text"]
    assert got[5]["text"] == "short" and got[6]["text"] == "" and got[8]["n_lines"] == 3
    assert got[9]["text"] == "" and got[9]["n_removed"] == 1


def test_each_line_is_left_once_and_nothing_else_goes(spark, table):
    rng = random.Random(4)
    lines = [f"line number {i} with enough characters" for i in range(40)]
    rows = [(i, "\n".join(rng.choice(lines) if rng.random() < 0.5 else f"own {i} {k} of this document only" for k in range(12))) for i in range(60)]
    rows += [(100, rows[3][1]), (100, rows[3][1])]
    got = d.dedup_lines(table(rows)).collect()
    assert len(got) == len(rows)
    left = [line for r in got for line in r["text"].split("\n") if line]
    before = {line for _, t in rows for line in t.split("\n")}
    assert set(left) == before
    assert all(left.count(f"own {i} 0 of this document only") <= 1 for i in range(60) if i != 3)
    assert sum(len(t.split("\n")) for _, t in rows) == sum(r["n_lines"] for r in got)
    assert d.dedup_lines(table([])).count() == 0


def every_pair(rows, min_chars=d.MIN_CHARS):
    """What stays of each row if it is aligned with every earlier one that shares a line."""
    out, before = {}, []
    for doc, text in sorted(rows):
        lines = text.split("\n")
        hashes = [hash(x.strip(" \t\r")) or 1 if x.strip(" \t\r") else 0 for x in lines]
        gone = set()
        for other in before:
            for i, _, n in d.align(hashes, other):
                if sum(len(x.strip(" \t\r")) for x in lines[i : i + n]) >= min_chars:
                    gone |= set(range(i, i + n))
        before.append(hashes)
        out[doc] = [x for i, x in enumerate(lines) if i not in gone and x.strip(" \t\r")]
    return out


def left_of(spark, table, rows, growth=d.GROWTH):
    return {r["doc_id"]: [x for x in r["text"].split("\n") if x.strip(" \t\r")] for r in d.dedup_lines(table(rows).repartition(3), growth=growth).collect()}


def test_given_documents_lose_what_aligning_every_pair_takes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: [x for x in r["text"].split("\n") if x.strip(" \t\r")] for r in d.dedup_lines(docs).collect()}
    want = every_pair(rows)
    assert [k for k in want if got[k] != want[k]] == []


def test_lines_of_many_texts(spark, table):
    """Common lines, in any order and number, with rounds of a few holders."""
    for seed in range(3):
        rng = random.Random(seed)
        lines = [f"w{i}" + rng.choice(["", " and more", " and a good deal more"]) for i in range(90) for _ in range(6)]
        rng.shuffle(lines)
        rows = [(i, "\n".join(lines[i * 9 : i * 9 + 9] + [""] * rng.randint(0, 2))) for i in range(60)]
        rows += [(100 + i, rng.choice(rows)[1]) for i in range(20)]
        rows += [(200 + i, "\n".join(rng.sample(rng.choice(rows)[1].split("\n"), 3))) for i in range(10)]
        assert left_of(spark, table, rows, growth=2 + seed) == every_pair(rows)


def test_null_ids_and_copies_of_copies(spark, table):
    rows = [(None, f"{A}\n{B}"), (None, f"{A}\n{B}"), (5, f"{A} \n{B}"), (6, f"{A}\n\n{B}"), (7, "short"), (8, "short")]
    got = d.dedup_lines(table(rows)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, ""), (0, f"{A}\n{B}"), (5, ""), (6, ""), (7, "short"), (8, "short")]


def test_blocks_meet_a_holder_in_their_order_and_length(spark, table):
    crossed = [(1, f"{A}\n{B}"), (2, f"{B}\n{A}"), (3, f"{B}\n{A}")]
    short = [(11, "first r1"), (12, "r2 short"), (13, "r3 short"), (14, "r4 short"), (15, "first r1\nr2 short\nr3 short\nr4 short"), (16, "first r1\nr2 short\nr3 short\nr4 short")]
    halves = [(21, "seven x1\nseven x2"), (22, "seven x2\nseven x3"), (23, "seven x1\nseven x2\nseven x3"), (24, "seven x1\nseven x2\nseven x3")]
    blanks = [(31, "nine abc1\nnine abc2"), (32, "nine abc1\n\nnine abc2 longer"), (33, "nine abc1\n\nnine abc2 longer")]
    twice = [(41, C), (42, f"{C}\nx of 42\n{C}"), (43, f"{C}\ny of 43\n{C}")]
    rows = crossed + short + halves + blanks + twice
    got = left_of(spark, table, rows)
    assert got == every_pair(rows)
    assert got[3] == got[16] == got[24] == got[33] == [] and got[43] == ["y of 43"]


def test_copies_go_as_if_every_pair_were_aligned(spark, table):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, "\n".join(rng.choice(words) + rng.choice(["", " and more"]) for _ in range(rng.randint(1, 9)))) for i in range(40)]
    rows += [(100 + i, rng.choice(rows)[1]) for i in range(40)]
    got, want = left_of(spark, table, rows), every_pair(rows)
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=20), st.lists(st.integers(0, 6), max_size=20))
def test_blocks_are_common_and_rise(a, b):
    at = (0, 0)
    for i, j, n in d.align(a, b):
        assert n > 0 and i >= at[0] and j >= at[1] and a[i : i + n] == b[j : j + n]
        at = (i + n, j + n)
    if a and a == b:
        assert d.align(a, b) == [(0, 0, len(a))]
