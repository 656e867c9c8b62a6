"""Writers: JSON lines, review texts, manifests, folders, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import text as T


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def page_block(pages: DataFrame) -> Column:
    """A page's text under its header line."""
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    head = F.concat(F.lit("===== page_id="), show("page_id"), F.lit(" | volume="), show("printed_volume"), F.lit(" | page="), show("printed_page"), F.lit(" =====\n"))
    return F.concat(head, T.strip(F.col("text")))


def review_text(pages: DataFrame, by: str) -> DataFrame:
    """``by, page_id, block``: a row for each page, so that a book of any size is no single value."""
    return pages.select(by, "page_id", page_block(pages).alias("block"))


def write_review_text(pages: DataFrame, by: str, path: str) -> None:
    """A folder for each ``by``; its files, in the order of their names, are its pages in order, with blank lines between."""
    ordered = review_text(pages, by).repartitionByRange(by, "page_id").sortWithinPartitions(by, "page_id")
    ordered.select(F.concat("block", F.lit("\n")).alias("value"), by).write.mode("overwrite").partitionBy(by).text(path)


def write_manifest(one_row: DataFrame, path: str) -> None:
    one_row.coalesce(1).write.mode("overwrite").json(path)


def folder_name(biographies: DataFrame) -> DataFrame:
    return biographies.withColumn("folder", F.format_string("%04d_%s", F.col("page_ids")[0], T.safe_filename(F.col("character_name"))))


def write_biographies(biographies: DataFrame, pages: DataFrame, path: str, book: str = "book_id") -> None:
    """A folder for each biography: ``metadata.json``, ``pages.jsonl`` and ``raw.txt``, each a folder of part files; the whole tree is replaced.

    ``pages`` are the resolved pages (``island``) that the biographies were made of.
    Pages of no biography go to ``unassigned_pages.jsonl``, which is there only if there are any; its files, in the order of their names, are these pages in order.
    """
    named = folder_name(biographies)
    meta = named.select("folder", F.lit("metadata.json").alias("file"), F.lit(None).cast("long").alias("page_id"), F.to_json(F.struct(*[c for c in named.columns if c != "text"])).alias("value"))
    own = pages.where("island IS NOT NULL").join(named.select(book, F.col("sequence").alias("island"), "folder", "biography_id", F.col("character_name").alias("_name")), [book, "island"])
    page = F.struct(*[c for c in pages.columns if c not in ("island", "character_name")], F.col("_name").alias("character_name"), "biography_id")
    lines = own.select("folder", F.lit("pages.jsonl").alias("file"), F.col("page_id").cast("long").alias("page_id"), F.to_json(page).alias("value"))
    raw = own.select("folder", F.lit("raw.txt").alias("file"), F.col("page_id").cast("long").alias("page_id"), F.concat(page_block(own), F.lit("\n")).alias("value"))
    every = meta.unionByName(lines).unionByName(raw).repartitionByRange("folder", "file", "page_id").sortWithinPartitions("folder", "file", "page_id")
    every.select("value", "folder", "file").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("folder", "file").text(path)
    rest = pages.where("island IS NULL").drop("island")
    if not rest.isEmpty():
        rest.repartitionByRange(book, "page_id").sortWithinPartitions(book, "page_id").write.mode("overwrite").json(f"{path}/unassigned_pages.jsonl")


def write_requests(requests: DataFrame, path: str) -> None:
    requests.select(F.col("request").alias("value")).write.mode("overwrite").text(path)


def write_audit(evidence: DataFrame, path: str) -> None:
    evidence.select(F.to_json(F.struct(*evidence.columns)).alias("value")).write.mode("overwrite").text(path)
