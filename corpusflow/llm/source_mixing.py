"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted in cells of source, language and topic. The cells' token
weights are raked in turn to the target share of every source, language and
topic until all three hold to ``TOLERANCE``; a document is then kept with the
probability that its cell calls for, scaled so that the most wanted cell keeps
everything. The draw is a hash of the id, or of the text where there is none, so a run can be repeated.

A raked weight is the cell's share times a factor of its source and one of its
pair of language and topic. Sources may be many: they stay a distributed table of one row
each, with its shares by pair. Pairs are few (at most ``MOST_PAIRS``, else an
error): each round sums them over all sources, and rescales the sums to languages and topics.

Without explicit targets, those of a smoothed corpus count: the marginals of
the cells' shares to the power ``SMOOTHING``. One distribution has all of them, so
they never contradict each other. With explicit targets the dimensions that have
none are left as they are; targets that no weights can meet are an error that names the deviation left.

Defined cases: null source, lang and topic count as ``unknown``; null and empty
texts have no tokens and the probability of their cell; a cell without tokens keeps
everything, and so does a table without any; a target without
documents, or documents without a target, get no weight; repeated rows with one doc_id, or without one and with one text, are kept or left alike;
an empty table gives no rows; columns of the input with the names made here are
replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import documents
from corpusflow.plans.staging import Staging

DIMENSIONS = ("source", "lang", "topic")
#: Without explicit targets a cell with a share s of the corpus is wanted in proportion to s ** SMOOTHING.
SMOOTHING = 0.9
#: Raking ends when no target share is missed by more than this, and fails after so many rounds.
TOLERANCE, MOST_ROUNDS = 1e-12, 100
MOST_PAIRS = 4096
SEED = "mix"


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up."""
    return F.coalesce(F.ceil(F.octet_length(text) / 4), F.lit(0)).cast("long")


def coarse_topic(text: Column) -> Column:
    """A coarse topic from what a text mentions."""
    return (
        F.when(text.rlike("[Ll]icense|[Cc]opyright"), "legal").when(text.rlike("@|https?://"), "contact")
        .when(text.rlike("[0-9]"), "figures").when(F.octet_length(text) >= 8000, "long").otherwise("general")
    )


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number from 0 up to 1 that depends on the id, or without one on the text, and on the seed alone."""
    of = F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(F.concat(of, F.lit(":" + seed)).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def _targets(given: dict[str, float]) -> dict[str, float]:
    total = math.fsum(given.values())
    if not total > 0 or min(given.values()) < 0:
        raise ValueError("targets must be shares of which none is negative and one is above 0")
    return {k: v / total for k, v in given.items()}


def _marginals(pairs: list[tuple[str, str]], values: list[float], k: int) -> dict[str, float]:
    out: dict[str, float] = {}
    for pair, v in zip(pairs, values, strict=True):
        out[pair[k]] = out.get(pair[k], 0.0) + v
    return out


def rake(
    cells: DataFrame, staging: Staging, targets: dict[str, dict[str, float]] | None = None, smoothing: float = SMOOTHING, tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS
) -> tuple[DataFrame, float]:
    """Staged ``cells`` (source, lang, topic, tokens) with ``prob``, the probability that their documents are kept, and the largest deviation from a target."""
    everything = cells.agg(F.sum("tokens")).first()[0]
    if not everything:
        return cells.select(*DIMENSIONS, F.lit(1.0).alias("prob")), 0.0
    given = {d: _targets(t) for d, t in (targets or {}).items()}
    shares = cells.where("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(everything))).withColumn("wanted", F.pow("share", F.lit(smoothing)))
    rows = shares.groupBy("lang", "topic").agg(F.sum("wanted").alias("wanted")).orderBy("lang", "topic").limit(MOST_PAIRS + 1).collect()
    if len(rows) > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} pairs of language and topic; a coarser topic is needed")
    pairs, wanted = [(r["lang"], r["topic"]) for r in rows], [r["wanted"] for r in rows]
    total = math.fsum(wanted)
    goal = {d: given.get(d) if given else {k: v / total for k, v in _marginals(pairs, wanted, i).items()} for i, d in enumerate(DIMENSIONS[1:])}

    # one row a source: its shares by pair, and its target
    place = F.element_at(F.create_map(*[F.lit(x) for i, (a, b) in enumerate(pairs) for x in (f"{a}\0{b}", i)]), F.concat("lang", F.lit("\0"), "topic"))
    entries = F.map_from_entries(F.collect_list(F.struct(place, "share")))  # at most MOST_PAIRS
    vector = F.transform(F.sequence(F.lit(0), F.lit(len(pairs) - 1)), lambda i: F.coalesce(F.try_element_at("by_pair", i), F.lit(0.0)))
    own = F.lit(None).cast("double") if given else F.col("wanted") / F.lit(total)  # null: no target
    if "source" in given:
        own = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in given["source"].items() for x in kv]), F.col("source")), F.lit(0.0))
    sources = staging.table(shares.groupBy("source").agg(entries.alias("by_pair"), F.sum("wanted").alias("wanted")).select("source", own.alias("target"), vector.alias("shares")), "sources")

    def dot(factors: list[float]) -> Column:
        return F.aggregate(F.zip_with("shares", F.lit(factors), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)

    def scaled(factors: list[float]) -> Column:
        return F.when(F.col("target").isNull(), F.lit(1.0)).otherwise(F.coalesce(F.try_divide(F.col("target"), dot(factors)), F.lit(0.0)))

    factors, before, missed = [1.0] * len(pairs), None, [math.inf] * 2
    for _ in range(most_rounds):
        # sums of the pairs once each source holds its target, and how far sources were off after the round before
        off = F.coalesce(F.abs(scaled(before) * dot(factors) - F.col("target")), F.lit(0.0)) if before else F.lit(math.inf)
        sums = sources.select(scaled(factors).alias("f"), off.alias("off"), F.posexplode("shares").alias("pair", "share")).groupBy("pair").agg(F.sum(F.col("f") * F.col("share")).alias("s"), F.max("off").alias("off")).collect()
        missed[0] = max(r["off"] for r in sums)
        if max(missed) <= tolerance:
            break
        before, s = factors, [0.0] * len(pairs)
        for r in sums:
            s[r["pair"]] = r["s"] * factors[r["pair"]]
        fresh = list(factors)
        for i, d in enumerate(DIMENSIONS[1:]):
            if goal[d] is None:
                continue
            now = _marginals(pairs, s, i)
            by = {k: goal[d].get(k, 0.0) / v if v else 0.0 for k, v in now.items()}
            s, fresh = ([x * by[p[i]] for x, p in zip(column, pairs, strict=True)] for column in (s, fresh))
        factors, now = fresh, _marginals(pairs, s, 0)
        missed[1] = max([abs(now.get(k, 0.0) - v) for k, v in (goal["lang"] or {}).items()] + [abs(math.fsum(s) - 1)])
    else:
        raise ValueError(f"after {most_rounds} rounds a target share is missed by {max(missed):.3g}; the targets contradict each other or the cells")
    names = F.element_at(F.array(*[F.struct(F.lit(a).alias("lang"), F.lit(b).alias("topic")) for a, b in pairs]), F.col("pair") + 1)
    found = sources.select("source", scaled(before).alias("f"), F.posexplode(F.zip_with("shares", F.lit(factors), lambda a, b: F.when(a > 0, b))).alias("pair", "g")).where("g IS NOT NULL")
    raked = staging.table(found.select("source", names.alias("n"), (F.col("f") * F.col("g")).alias("factor")).select("source", "n.*", "factor"), "factors")
    most = raked.agg(F.max("factor")).first()[0]
    prob = F.round(F.try_divide(F.col("factor"), F.lit(most)), 9)
    return cells.join(raked, list(DIMENSIONS), "left").select(*DIMENSIONS, F.coalesce(prob, F.lit(1.0)).alias("prob")), max(missed)


def mix(docs: DataFrame, topic: Column | None = None, targets: dict[str, dict[str, float]] | None = None, staging: Staging | None = None, smoothing: float = SMOOTHING, seed: str = SEED) -> DataFrame:
    """``docs`` with ``topic, n_tokens, prob, kept``; text itself is only read for topic and tokens."""
    staging = staging or Staging(docs.sparkSession)
    named = docs.withColumn("topic", F.coalesce(topic if topic is not None else coarse_topic(F.col("text")), F.lit("unknown"))).withColumn("n_tokens", token_estimate(F.col("text")))
    keys = [F.coalesce(F.col(d), F.lit("unknown")).alias(d) for d in DIMENSIONS]
    cells = staging.table(named.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens")), "cells")
    probs = staging.table(rake(cells, staging, targets, smoothing)[0], "probabilities")
    probs = probs.select(*[F.col(d).alias(f"_cell_{d}") for d in DIMENSIONS], F.col("prob").alias("_cell_prob"))
    same = [F.coalesce(F.col(d), F.lit("unknown")) == F.col(f"_cell_{d}") for d in DIMENSIONS]
    out = named.drop("prob", "kept").join(probs, same, "left").withColumn("prob", F.col("_cell_prob"))
    return out.withColumn("kept", draw(F.col("doc_id"), F.col("text"), seed) < F.col("prob")).drop("_cell_prob", *[f"_cell_{d}" for d in DIMENSIONS])


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "source", "lang", "topic", "n_tokens", F.round("prob", 6).alias("prob"), "kept")


#: More rounds than raking needs on the given tables (5 to 11).
SQL_ROUNDS = 24


def _op5_sql() -> str:
    steps = [f"""
WITH d AS (
  SELECT doc_id, source, lang,
         CASE WHEN regexp_matches(text, '[Ll]icense|[Cc]opyright') THEN 'legal' WHEN regexp_matches(text, '@|https?://') THEN 'contact'
              WHEN regexp_matches(text, '[0-9]') THEN 'figures' WHEN strlen(text) >= 8000 THEN 'long' ELSE 'general' END AS topic,
         CAST(coalesce(ceil(strlen(text) / 4.0), 0) AS BIGINT) AS n_tokens
  FROM documents
), c0 AS (
  SELECT coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL
), c1 AS (SELECT *, tokens / sum(tokens) OVER () AS share FROM c0
), c2 AS (SELECT *, pow(share, {SMOOTHING}) / sum(pow(share, {SMOOTHING})) OVER () AS wanted FROM c1
), r0 AS (SELECT source, lang, topic, share, share AS w, {", ".join(f"sum(wanted) OVER (PARTITION BY {x}) AS t_{x}" for x in DIMENSIONS)} FROM c2
)"""]
    n = 0
    for _ in range(SQL_ROUNDS):
        for x in DIMENSIONS:
            n += 1
            steps.append(f", r{n} AS (SELECT * REPLACE (w * t_{x} / sum(w) OVER (PARTITION BY {x}) AS w) FROM r{n - 1})")
    steps.append(f"""
, f AS (SELECT source, lang, topic, coalesce(round((w / share) / max(w / share) OVER (), 9), 1) AS prob FROM r{n})
SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(f.prob, 6) AS prob,
       CAST('0x' || substr(md5(CAST(d.doc_id AS VARCHAR) || ':{SEED}'), 1, 8) AS BIGINT) / 4294967296.0 < f.prob AS kept
FROM d JOIN f ON coalesce(d.source, 'unknown') = f.source AND coalesce(d.lang, 'unknown') = f.lang AND d.topic = f.topic
""")
    return "".join(steps)


OP5_SQL = _op5_sql()
