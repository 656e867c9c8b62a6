"""Pages assigned to biographies: identity from neighbours, islands, aggregates.

Windows are over a book's ranges of ``SEGMENT`` page ids, and what each range needs of those before and
behind it (the nearest identity, the number of islands) is carried over by a table with a row for each range, so a book of any size
spreads over all tasks. A biography (an island) is the largest text that becomes one value. A character's pages of all books stay
one row each: their sizes are summed first, and only characters below a bound are rendered as one text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from corpusflow.functions import text as T

#: Page ids of one book that one window is over.
SEGMENT = 4096


def _segmented(pages: DataFrame, book: str, segment: int) -> DataFrame:
    """``pages`` with ``_key``: the book and a range of ``segment`` page ids, which windows are over instead of the whole book."""
    place = F.coalesce(F.floor(F.col("page_id") / segment), F.lit(-(1 << 62)))  # pages without an id come first
    return pages.withColumn("_key", F.struct(F.col(book).alias("book"), place.alias("place")))


def _carries(ends: DataFrame) -> tuple[WindowSpec, WindowSpec]:
    """What lies before and behind each range of a book, of a table that has a row for each range: frames that only grow."""
    by = Window.partitionBy("_key.book")
    before = lambda order: by.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return before(F.asc("_key.place")), before(F.desc("_key.place"))


def resolve_character_context(pages: DataFrame, book: str = "book_id", segment: int = SEGMENT) -> DataFrame:
    """``pages`` (page_id, character_id, character_name, entry_name) with resolved identity and ``assignment``.

    An explicit identity (an id and a name, the entry's if there is no other)
    is kept as ``source``. Others are ``inferred`` if the nearest explicit ones
    before and after are of one character, else ``unassigned``.
    """
    blank = lambda c: F.nullif(T.strip(F.col(c)), F.lit(""))
    name = F.coalesce(blank("character_name"), blank("entry_name"))
    own = F.when(blank("character_id").isNotNull() & name.isNotNull(), F.struct(blank("character_id").alias("id"), name.alias("name")))
    df = _segmented(pages.withColumn("_own", own), book, segment)
    given = df.where("_own IS NOT NULL").groupBy("_key").agg(F.min_by("_own", "page_id").alias("first"), F.max_by("_own", "page_id").alias("last"))
    ends = df.select("_key").distinct().join(given, "_key", "left")
    earlier, later = _carries(ends)
    ends = ends.select("_key", F.last("last", ignorenulls=True).over(earlier).alias("_earlier"), F.last("first", ignorenulls=True).over(later).alias("_later"))
    nearest = lambda order: F.last("_own", ignorenulls=True).over(Window.partitionBy("_key").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_after", nearest(F.desc("page_id"))).withColumn("_before", nearest(F.asc("page_id"))).join(ends, "_key")
    before, after = F.coalesce("_before", "_earlier"), F.coalesce("_after", "_later")
    shared = F.when(before["id"] == after["id"], before)
    kind = F.when(F.col("_own").isNotNull(), "source").when(shared.isNotNull(), "inferred").otherwise("unassigned")
    who = F.coalesce("_own", shared)
    return df.select(*[F.col(c) for c in pages.columns], kind.alias("assignment"), who["id"].alias("resolved_id"), who["name"].alias("resolved_name"))


def split_contiguous(pages: DataFrame, book: str = "book_id", segment: int = SEGMENT) -> DataFrame:
    """``pages`` with ``island``: runs of one character, numbered in page order; an unassigned page ends a run and has none."""
    w = Window.partitionBy("_key").orderBy("page_id")
    starts = F.col("resolved_id").isNotNull() & ~F.col("resolved_id").eqNullSafe(F.lag("resolved_id").over(w))
    counted = lambda df: df.withColumn("_n", F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # a range's first page begins a run of its own, unless the range before ends in the same character
    narrow = counted(_segmented(pages.select(book, "page_id", "resolved_id"), book, segment))
    who = F.struct("resolved_id")
    ends = narrow.groupBy("_key").agg(F.max("_n").alias("n"), F.min_by(who, F.struct("page_id", "_n")).alias("first"), F.max_by(who, F.struct("page_id", "_n")).alias("last"))
    over = Window.partitionBy("_key.book").orderBy("_key.place")
    goes_on = F.coalesce(F.col("first.resolved_id") == F.lag("last.resolved_id").over(over), F.lit(False))
    ends = ends.withColumn("_same", F.when(goes_on, 1).otherwise(0))
    ends = ends.select("_key", "_same", F.coalesce(F.sum(F.col("n") - F.col("_same")).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    df = counted(_segmented(pages, book, segment)).join(ends, "_key")
    return df.select(*pages.columns, F.when(F.col("resolved_id").isNotNull(), F.col("_earlier") + F.col("_n") - F.col("_same")).alias("island"))


def aggregate_biographies(pages: DataFrame, book: str = "book_id") -> DataFrame:
    """One row per island, its pages in order."""
    page = F.struct("page_id", "printed_volume", "printed_page", "url", T.strip(F.col("text")).alias("text"))
    rows = pages.where("island IS NOT NULL").groupBy(book, F.col("island").alias("sequence"), F.col("resolved_id").alias("character_id")).agg(
        F.min_by("resolved_name", "page_id").alias("character_name"), F.array_sort(F.collect_list(page)).alias("pages")
    )
    present = lambda field: F.filter(F.col(f"pages.{field}"), lambda x: x.isNotNull())
    text = F.array_join(F.filter(F.col("pages.text"), lambda x: x != ""), "\n\n")
    first, last = lambda c: F.try_element_at(present(c), F.lit(1)), lambda c: F.try_element_at(present(c), F.lit(-1))
    return rows.withColumn("text", text).select(
        book, "sequence", "character_id", "character_name",
        F.concat("character_id", F.lit("_"), F.col("pages.page_id")[0].cast("string")).alias("biography_id"),
        F.col("pages.page_id").alias("page_ids"), first("printed_page").alias("printed_page_start"), last("printed_page").alias("printed_page_end"),
        first("printed_volume").alias("volume_start"), last("printed_volume").alias("volume_end"), present("url").alias("urls"), "text", T.content_hash(F.col("text")).alias("content_hash"),
    )


def entry_counts(pages: DataFrame) -> DataFrame:
    """Pages per entry with its first page; blank names are left out."""
    return pages.where(T.strip(F.col("entry_name")) != "").groupBy("entry_name").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page_id"))


def section_counts(pages: DataFrame) -> DataFrame:
    """Pages per source section; blank names are left out."""
    return pages.where(F.coalesce("source_section", F.lit("")) != "").groupBy("source_section").agg(F.count("*").alias("n_pages"))


def manifest(pages: DataFrame) -> DataFrame:
    """One row of totals over resolved pages."""
    kind = lambda k: F.count_if(F.col("assignment") == k).alias(f"n_{k}")
    return pages.agg(F.count("*").alias("n_pages"), kind("source"), kind("inferred"), kind("unassigned"), F.countDistinct("resolved_id").alias("n_characters"), F.min("page_id").alias("first_page_id"), F.max("page_id").alias("last_page_id"))


def dedupe_pages(pages: DataFrame) -> DataFrame:
    """One page per (dataset, page_id), or per text without one: the longer text, of equals the one seen first (``seq``)."""
    key = F.when(F.col("page_id").isNotNull(), F.concat(F.lit("page:"), F.col("page_id").cast("string"))).otherwise(F.concat(F.lit("sha256:"), T.content_hash(F.col("text"))))
    best = F.max_by(F.struct(*pages.columns), F.struct(F.length("text"), -F.col("seq")))
    return pages.groupBy("dataset_id", key.alias("page_key")).agg(best.alias("_p"), F.count("*").alias("n_seen")).select("page_key", "n_seen", "_p.*")


def biography_pages(pages: DataFrame) -> DataFrame:
    """``character_id, place, page_id, rendered``: each page under its source line, and where it stands: those with an id first."""
    part = lambda name, c: F.concat(F.lit(f"{name}="), F.col(c).cast("string"))
    head = F.concat(F.lit("[SOURCE_PAGE "), F.concat_ws(" | ", part("dataset", "dataset_id"), part("page_id", "page_id"), part("printed_page", "printed_page"), part("url", "url")), F.lit("]"))
    place = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "source_file")
    return pages.select("character_id", place.alias("place"), "page_id", F.concat(head, F.lit("\n"), F.col("text")).alias("rendered"))


def biography_sizes(rendered: DataFrame) -> DataFrame:
    """``character_id, n_pages, n_chars, n_bytes`` of the text that a character's pages make, blank lines between them; no text is joined."""
    total = lambda f: F.sum(f("rendered")) + 2 * (F.count("*") - 1)
    return rendered.groupBy("character_id").agg(F.count("*").alias("n_pages"), total(F.length).alias("n_chars"), total(F.octet_length).alias("n_bytes"))


def merge_biography(rendered: DataFrame, sizes: DataFrame, most_bytes: int) -> DataFrame:
    """``character_id, n_pages, page_ids, rendered``: the whole text of characters that take at most ``most_bytes``."""
    small = rendered.join(sizes.where(F.col("n_bytes") <= most_bytes).select("character_id"), "character_id", "left_semi")
    rows = small.groupBy("character_id").agg(F.count("*").alias("n_pages"), F.array_sort(F.collect_list(F.struct("place", "rendered"))).alias("p"))
    return rows.select("character_id", "n_pages", F.filter(F.col("p.place.page_id"), lambda x: x.isNotNull()).alias("page_ids"), F.array_join(F.col("p.rendered"), "\n\n").alias("rendered"))


def canonical_metadata(biographies: DataFrame, first_order: int = 5) -> DataFrame:
    """One row per character: the metadata of its first biography by page, and its place in the roster.

    The roster is a small table, numbered by one global order."""
    first = F.min_by(F.struct("character_name", "page_id_start"), F.struct("page_id_start", "source_file"))
    rows = biographies.groupBy("character_id").agg(first.alias("f"))
    order = F.row_number().over(Window.orderBy("f.page_id_start", "character_id")) + F.lit(first_order - 1)
    return rows.select("character_id", F.col("f.character_name").alias("character_name"), F.col("f.page_id_start").alias("page_id_start"), order.alias("sort_order"))
