import pytest
from pyspark.sql import functions as F

from corpusflow.llm import source_mixing as m
from corpusflow.plans.staging import Staging


CELLS = "source string, lang string, topic string, tokens long"


def shares(cells, probs):
    """Marginal shares of the kept tokens."""
    tokens = {c[:3]: c[3] for c in cells}
    weight = {(r["source"], r["lang"], r["topic"]): r["prob"] * tokens[r["source"], r["lang"], r["topic"]] for r in probs}
    out = [{}, {}, {}]
    for key, w in weight.items():
        for k in range(3):
            out[k][key[k]] = out[k].get(key[k], 0) + w / sum(weight.values())
    return out


def test_raking_reaches_all_targets(spark):
    cells = [("a", "en", "x", 900), ("a", "fr", "y", 50), ("b", "en", "y", 200), ("b", "fr", "x", 100), ("c", "en", "x", 30), ("c", "fr", "y", 70)]
    targets = {"source": {"a": 1, "b": 1, "c": 2}, "lang": {"en": 0.7, "fr": 0.3}, "topic": {"x": 0.5, "y": 0.5}}
    made, missed = m.rake(spark.createDataFrame(cells, CELLS), Staging(spark), targets)
    probs = made.collect()
    assert max(r["prob"] for r in probs) == 1 and missed <= m.TOLERANCE
    for k, d in enumerate(m.DIMENSIONS):
        for value, share in targets[d].items():
            assert shares(cells, probs)[k][value] == pytest.approx(share / sum(targets[d].values()), abs=1e-6)


def test_default_targets_hold_in_production_rounds(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    named = docs.select("source", "lang", m.coarse_topic(F.col("text")).alias("topic"), m.token_estimate(F.col("text")).alias("t"))
    cells = [tuple(r) for r in named.groupBy("source", "lang", "topic").agg(F.sum("t")).collect()]
    cells += [("hot", "en", "general", 10**7), ("one language", "pt", "general", 40)]  # sources of one language each
    made, missed = m.rake(spark.createDataFrame(cells, CELLS), Staging(spark))
    assert missed <= m.TOLERANCE
    total = sum(c[3] for c in cells)
    wanted = {c[:3]: (c[3] / total) ** m.SMOOTHING for c in cells}
    got = shares(cells, made.collect())
    for k in range(3):
        goal = {}
        for key, w in wanted.items():
            goal[key[k]] = goal.get(key[k], 0) + w / sum(wanted.values())
        assert max(abs(got[k][x] - v) for x, v in goal.items()) < 1e-6


def test_targets_that_contradict_each_other_are_an_error(spark):
    cells = spark.createDataFrame([("a", "en", "x", 90), ("b", "fr", "x", 10)], CELLS)
    with pytest.raises(ValueError, match="missed by 0"):
        m.rake(cells, Staging(spark), {"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.5, "fr": 0.5}, "topic": {"x": 1}}, most_rounds=5)
    with pytest.raises(ValueError, match="shares"):
        m.rake(cells, Staging(spark), {"lang": {"en": 0}})
    kept = m.rake(cells, Staging(spark), {"source": {"a": 1}})[0].collect()
    assert {r["source"]: r["prob"] for r in kept} == {"a": 1.0, "b": 0.0}


def test_defined_cases(spark, table):
    rows = [(i, "word " * 10, "en", "a") for i in range(200)] + [(300, None, None, None), (301, "", "en", "a"), (302, "x" * 40_000, "fr", "b"), (5, "word " * 10, "en", "a")]
    docs = table(rows).drop("n_chars")
    got = m.mix(docs, topic=F.lit("t")).select("doc_id", "n_tokens", "prob", "kept").collect()
    assert len(got) == len(rows)
    assert all(r["prob"] is not None and r["kept"] is not None for r in got)
    assert len({r["kept"] for r in got if r["doc_id"] == 5}) == 1
    again = m.mix(docs.repartition(5), topic=F.lit("t")).select("doc_id", "n_tokens", "prob", "kept").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert m.mix(table([])).count() == 0


def test_no_tokens_at_all_keeps_everything(spark, table):
    got = m.mix(table([(1, None), (2, "")])).collect()
    assert [r["kept"] for r in got] == [True, True]


def test_rows_without_id_are_drawn_by_text(spark, table):
    rows = [(None, f"text of row {i}", "en", "a") for i in range(400)] + [(None, f"much longer text of row {i} " * 40, "fr", "b") for i in range(400)]
    got = m.mix(table(rows), topic=F.lit("t"), targets={"lang": {"en": 0.5, "fr": 0.5}}).select("lang", "prob", "kept").collect()
    low = [r for r in got if r["prob"] < 1]
    share = sum(r["kept"] for r in low) / len(low)
    assert low and abs(share - low[0]["prob"]) < 0.1
