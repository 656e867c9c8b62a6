"""Bookkeeping of model classifications: requests, results, evidence, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import text as T

MOST_TOKENS = 125_000
RESPONSE = "struct<categories:array<struct<label:string,evidence_page_ids:array<int>,reason:string>>,short_description:string>"
CUSTOM_ID = r"\A(.+)::c([01])d([01])\z"


def custom_id(slug: Column, want_categories: Column, want_description: Column) -> Column:
    flag = lambda c: F.when(c, "1").otherwise("0")
    return F.concat(slug, F.lit("::c"), flag(want_categories), F.lit("d"), flag(want_description))


def parse_custom_id(c: Column) -> Column:
    """``slug, want_categories, want_description``, or null if it is none."""
    part = lambda i: F.regexp_extract(c, CUSTOM_ID, i)
    return F.when(c.rlike(CUSTOM_ID), F.struct(part(1).alias("slug"), (part(2) == "1").alias("want_categories"), (part(3) == "1").alias("want_description")))


def worklist(roster: DataFrame, sizes: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Active characters that lack categories or a description, with the sizes of their biography (character_id, n_pages, n_chars, n_bytes); and those without one."""
    need_c = F.lit(force) | (F.size(F.coalesce("categories", F.array())) == 0)
    need_d = F.lit(force) | (T.strip(F.coalesce("short_description", F.lit(""))) == "")
    todo = roster.where("is_active").withColumn("want_categories", need_c).withColumn("want_description", need_d).where("want_categories OR want_description")
    joined = todo.join(sizes.select(F.col("character_id").alias("slug"), "n_pages", "n_chars", "n_bytes"), "slug", "left")
    ready = joined.where("n_pages IS NOT NULL").withColumn("custom_id", custom_id(F.col("slug"), F.col("want_categories"), F.col("want_description")))
    return ready, joined.where("n_pages IS NULL").select("slug")


def _head(slug: Column) -> Column:
    return F.concat(F.lit("slug: "), slug, F.lit("\n\n"))


def request_sizes(ready: DataFrame, system: str) -> DataFrame:
    """``custom_id, slug, n_chars, tokens`` of the requests that ``ready`` calls for, before any is made."""
    user = F.ceil((F.octet_length(_head(F.col("slug"))) + F.col("n_bytes")) / 4).cast("int")
    return ready.select("custom_id", "slug", "n_chars", (user + T.estimate_tokens(F.lit(system))).alias("tokens"))


def requests(ready: DataFrame, biographies: DataFrame, system: str, most: int = MOST_TOKENS) -> DataFrame:
    """``custom_id, slug, request``, the request as JSON, for those of at most ``most`` tokens; ``biographies`` has (character_id, rendered)."""
    fitting = request_sizes(ready, system).where(F.col("tokens") <= most).select("custom_id", "slug")
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    body = F.struct(F.col("custom_id"), F.array(message("system", F.lit(system)), message("user", F.concat(_head(F.col("slug")), F.col("rendered")))).alias("messages"))
    return fitting.join(biographies.select(F.col("character_id").alias("slug"), "rendered"), "slug").select("custom_id", "slug", F.to_json(body).alias("request"))


def preflight(made: DataFrame, missing: DataFrame, most: int = MOST_TOKENS) -> DataFrame:
    """One row: totals, oversized and missing ones; any of either blocks a run."""
    totals = made.agg(F.count("*").alias("n_requests"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("n_chars"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count_if(F.col("tokens") > most).alias("n_oversized"))
    both = totals.crossJoin(missing.agg(F.count("*").alias("n_missing")))  # one row each
    return both.withColumn("blocked", (F.col("n_oversized") > 0) | (F.col("n_missing") > 0))


def largest_requests(made: DataFrame, n: int = 10) -> DataFrame:
    return made.select("custom_id", "tokens").orderBy(F.desc("tokens"), "custom_id").limit(n)


def usage_totals(log: DataFrame) -> DataFrame:
    """One row over a result log (status, prompt_tokens, completion_tokens)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return log.agg(F.count("*").alias("n_results"), F.count_if(F.col("status") == "completed").alias("n_succeeded"), F.count_if(F.col("status") == "failed").alias("n_failed"), total("prompt_tokens"), total("completion_tokens"))


def latest_status(log: DataFrame) -> DataFrame:
    """Per custom id: whether any attempt completed, attempts, first line. Ids of another form are left out."""
    return log.where(F.col("custom_id").rlike(CUSTOM_ID)).groupBy("custom_id").agg(
        F.when(F.bool_or(F.col("status") == "completed"), "completed").otherwise("failed").alias("status"), F.count("*").alias("n_attempts"), F.min("line_no").alias("first_line")
    )


def run_id(log: DataFrame, *by: str) -> DataFrame:
    """One row, or one for each ``by``: the log's run id if it has one only."""
    return log.groupBy(*by).agg(F.when(F.min("run_id") == F.max("run_id"), F.min("run_id")).alias("run_id"))


def retry_candidates(log: DataFrame, roster: DataFrame, biographies: DataFrame) -> DataFrame:
    """Requests that only failed, with what would block another try."""
    failed = latest_status(log).where("status = 'failed'").withColumn("slug", parse_custom_id(F.col("custom_id"))["slug"])
    known = roster.where("is_active").select("slug", F.lit(True).alias("_known"))
    written = biographies.select(F.col("character_id").alias("slug"), F.lit(True).alias("_written"))
    joined = failed.join(known, "slug", "left").join(written, "slug", "left")
    return joined.withColumn("blocked_by", F.when(F.col("_known").isNull(), "not in roster").when(F.col("_written").isNull(), "no biography")).drop("_known", "_written")


def parse_results(log: DataFrame) -> DataFrame:
    """Completed results as ``slug, want_*, parsed``; what cannot be parsed has a ``failure``."""
    parsed = F.from_json("content", RESPONSE)
    df = log.where("status = 'completed'").withColumn("_id", parse_custom_id(F.col("custom_id"))).withColumn("parsed", parsed)
    failure = F.when(F.col("_id").isNull(), "bad custom id").when(~F.coalesce(F.col("content").rlike(r"\A[ \t\r\n]*\{"), F.lit(False)) | F.col("parsed").isNull(), "not a JSON object")
    return df.withColumn("failure", failure).select("custom_id", "_id.*", "parsed", "failure")


def validate_evidence(results: DataFrame, pages: DataFrame, taxonomy: DataFrame, required: list[str] | None = None) -> DataFrame:
    """``slug, labels``: labels of the taxonomy that cite a page of the slug, with those pages, in the order of the answer.

    ``results`` has (slug, parsed), ``pages`` (slug, page_id), ``taxonomy`` (label). Labels in
    ``required`` are added at the end where they are missing.
    """
    labels = results.select("slug", F.posexplode("parsed.categories").alias("pos", "c")).select("slug", "pos", T.strip(F.col("c.label")).alias("label"), F.col("c.evidence_page_ids").alias("ids"))
    known = labels.join(taxonomy.select("label").distinct(), "label", "left_semi")
    cited = known.select("slug", "pos", "label", F.posexplode("ids").alias("at", "page_id")).join(pages.select("slug", "page_id").distinct(), ["slug", "page_id"], "left_semi")
    by_label = cited.groupBy("slug", "label").agg(F.min("pos").alias("pos"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "at", "page_id"))), lambda x: x["page_id"])).alias("page_ids"))
    rows = by_label.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("pos", "label", "page_ids"))).alias("l"))
    every = results.select("slug").distinct().join(rows, "slug", "left")
    names = F.coalesce(F.col("l.label"), F.array().cast("array<string>"))
    more = F.array(*[F.lit(x) for x in required or []]).cast("array<string>")
    return every.select("slug", F.concat(names, F.array_except(more, names)).alias("labels"), F.coalesce(F.transform("l", lambda x: F.struct(x["label"].alias("label"), x["page_ids"].alias("page_ids"))), F.array()).alias("evidence"))


def apply_classification(roster: DataFrame, updates: DataFrame) -> DataFrame:
    """``roster`` with wanted fields of ``updates`` (slug, want_categories, want_description, labels, description) and ``changed``; a blank description never erases one."""
    new = updates.select("slug", "want_categories", "want_description", "labels", F.nullif(T.strip(F.col("description")), F.lit("")).alias("_d"), F.lit(True).alias("_hit"))
    joined = roster.join(new, "slug", "left")
    categories = F.when(F.col("want_categories"), F.col("labels")).otherwise(F.col("categories"))
    description = F.when(F.col("want_description"), F.coalesce("_d", "short_description")).otherwise(F.col("short_description"))
    changed = F.coalesce(F.col("_hit"), F.lit(False)) & ~(categories.eqNullSafe(F.col("categories")) & description.eqNullSafe(F.col("short_description")))
    out = joined.withColumn("changed", changed).withColumn("_c", categories).withColumn("short_description", description)
    return out.withColumn("categories", F.col("_c")).select(*roster.columns, "changed")


def sync_snapshot(roster: DataFrame, snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``roster`` after a snapshot (slug, categories, short_description) with ``changed``, and the snapshot's unknown slugs."""
    new = snapshot.select("slug", F.col("categories").alias("_c"), F.nullif(T.strip(F.col("short_description")), F.lit("")).alias("_d"))
    joined = roster.join(new, "slug", "left")
    categories, description = F.coalesce("_c", "categories"), F.coalesce("_d", "short_description")
    changed = ~(categories.eqNullSafe(F.col("categories")) & description.eqNullSafe(F.col("short_description")))
    synced = joined.select(*[c for c in roster.columns if c not in ("categories", "short_description")], categories.alias("categories"), description.alias("short_description"), changed.alias("changed"))
    return synced, snapshot.join(roster.select("slug"), "slug", "left_anti").select("slug")


def merge_generated(existing: DataFrame, generated: DataFrame) -> DataFrame:
    """``existing`` (slug, sort_order, ...) with generated AI fields by slug; new slugs are appended after the last."""
    fields = [c for c in ("name_ar", "categories", "short_description") if c in generated.columns]
    e, g = existing.alias("e"), generated.withColumn("_in", F.lit(1)).alias("g")
    last = existing.agg(F.coalesce(F.max("sort_order"), F.lit(0)).alias("_last"))
    fresh = generated.join(existing.select("slug"), "slug", "left_anti").groupBy().agg(F.array_sort(F.collect_set("slug")).alias("_new"))  # appended roster entries, a small list
    joined = e.join(g, "slug", "full_outer").crossJoin(last).crossJoin(fresh)  # one row each
    columns = []
    for c in existing.columns:
        if c in fields:
            columns.append(F.coalesce(F.col(f"g.{c}"), F.col(f"e.{c}")).alias(c))
        elif c == "sort_order":
            columns.append(F.coalesce(F.col("e.sort_order"), F.col("_last") + F.array_position("_new", F.col("slug"))).alias(c))
        else:
            columns.append(F.col("slug") if c == "slug" else F.col(f"e.{c}"))
    return joined.select(*columns)
