"""The roster of characters: listings, categories, seeds, daily rotation, resets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import text as T

# Eras by character and by collection, and the label for none.
CHARACTER_ERAS = {"abu_bakr": "الخلافة الراشدة", "umar": "الخلافة الراشدة", "uthman": "الخلافة الراشدة", "ali": "الخلافة الراشدة"}
COLLECTION_ERAS = {"الصحابة": "الصحابة"}
NO_ERA = "غير محدد"


def era_for_page(pages: DataFrame, characters: dict[str, str] | None = None, collections: dict[str, str] | None = None, default: str = NO_ERA) -> DataFrame:
    """``pages`` with ``era``: by character, else by collection, else the default. Both maps are configuration."""
    look = lambda m, c: F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), c) if m else F.lit(None).cast("string")
    by_character = look(CHARACTER_ERAS if characters is None else characters, F.col("character_id"))
    return pages.withColumn("era", F.coalesce(by_character, look(COLLECTION_ERAS if collections is None else collections, F.col("collection")), F.lit(default)))


def list_characters(roster: DataFrame, bridge: DataFrame | None = None, era: str | None = None, group: str | None = None, category: str | None = None) -> DataFrame:
    """Active characters that meet all given filters, in roster order."""
    out = roster.where("is_active")
    if era is not None:
        out = out.where(F.col("era") == era)
    if group is not None:
        out = out.where(F.col("group_name") == group)
    if category is not None:
        out = out.join(bridge.where(F.col("label") == category).select("slug"), "slug", "left_semi")
    return out.orderBy("sort_order", "slug")


def character_categories(bridge: DataFrame) -> DataFrame:
    """``slug, categories``: labels by position."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "label")))
    return bridge.groupBy("slug").agg(F.transform(ordered, lambda x: x["label"]).alias("categories"))


def category_bridge(characters: DataFrame) -> DataFrame:
    """``slug, position, label`` of characters with a list of labels."""
    return characters.select("slug", F.posexplode(T.dedupe_labels(F.col("categories"))).alias("position", "label"))


def seed_roster(canonical: DataFrame, roster: DataFrame) -> DataFrame:
    """Canonical characters that the roster does not have yet."""
    return canonical.withColumnRenamed("character_id", "slug").join(roster.select("slug"), "slug", "left_anti")


def story_of_day(dates: DataFrame, overrides: DataFrame, roster: DataFrame) -> DataFrame:
    """``story_date, slug, curated``: the override of the day if its character is active, else a rotation over the active roster."""
    active = roster.where("is_active")
    order = active.agg(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "slug"))), lambda x: x["slug"]).alias("slugs"))  # the roster as one array, one row
    chosen = overrides.join(active.select("slug"), "slug", "left_semi").select("story_date", F.col("slug").alias("_chosen"))
    days = dates.select("story_date").distinct().join(chosen, "story_date", "left").crossJoin(order)
    index = T.hash_rotation_index(F.col("story_date").cast("string"), F.assert_true(F.size("slugs") > 0, "no active character").isNull().cast("int") * F.size("slugs"))
    return days.select("story_date", F.coalesce("_chosen", F.try_element_at("slugs", (index + 1).cast("int"))).alias("slug"), F.col("_chosen").isNotNull().alias("curated"))


def reset_descriptions(roster: DataFrame, placeholder: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``roster`` with blank descriptions where they are the placeholder, or for all but ``keep``; ``reset`` marks them."""
    hit = F.col("short_description") == placeholder if placeholder is not None else ~F.col("slug").isin(keep or [])
    hit = F.coalesce(hit & (F.coalesce("short_description", F.lit("")) != ""), F.lit(False))
    return roster.withColumn("reset", hit).withColumn("short_description", F.when(hit, "").otherwise(F.col("short_description")))


def backfill(df: DataFrame, to: str, value: Column) -> DataFrame:
    """Set ``to`` where it differs from ``value``; ``changed`` marks the rows."""
    differs = ~F.col(to).eqNullSafe(value)
    return df.withColumn("changed", differs).withColumn(to, F.when(differs, value).otherwise(F.col(to)))


def distinct_characters(documents: DataFrame, prefix: str | None = None) -> DataFrame:
    out = documents.select("caliph_id").distinct()
    return out.where(F.col("caliph_id").startswith(prefix)) if prefix else out


def export_snapshot(roster: DataFrame) -> DataFrame:
    """One row ``snapshot``: JSON of all characters by slug, keys in order. The roster is a small table."""
    value = F.struct("categories", "short_description")
    entries = F.array_sort(F.collect_list(F.struct("slug", value.alias("v"))))
    return roster.agg(F.to_json(F.map_from_entries(entries)).alias("snapshot"))
