"""Readers of page datasets. Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.functions import text as T

JSONL_PAGE = "book_id int, book_title string, author string, collection string, caliph_id string, caliph_name string, page_id int, printed_page string, url string, text string"
PAGE_JSON = (
    "book_id int, book_title string, author string, dataset_id string, dataset_name string, layer int, source_group string, person_category string, character_id string, "
    "character_name string, page_id int, url string, scraped_at string, printed_volume int, printed_page int, entry_name string, source_section string, breadcrumb array<string>, "
    "text string, content_hash string, next_section_trimmed boolean"
)
SOURCE_PAGE = ["book_id", "book_title", "author", "collection", "character_id", "character_name", "page_id", "printed_page", "url", "text", "printed_volume", "entry_name", "source_section"]
#: Fixed value: the file that repeats all others.
COMBINED = "rashidun_pages.jsonl"


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, line, line_no, value`` of text files: the line's number in its file, from 1, and in all files, in the order of their paths.

    A large file is read in splits by many tasks. Lines are numbered within their split, where rows stay in order, and
    splits are counted; sums of the counts before each, a row a split, make these numbers those of the file and of all files.
    """
    at = F.col("_metadata")
    place = F.monotonically_increasing_id()
    lines = spark.read.text(paths).select("value", at["file_path"].alias("file"), at["file_block_start"].alias("_start"), place.alias("_place"))
    splits = lines.groupBy("file", "_start").agg(F.count("*").alias("n"), F.min("_place").alias("_first"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    in_file = splits.withColumn("_in_file", before(Window.partitionBy("file").orderBy("_start")))
    files = splits.groupBy("file").agg(F.sum("n").alias("n"))
    files = files.select("file", before(Window.orderBy("file")).alias("_in_all"))  # a row for each file
    counted = lines.join(in_file.join(files, "file").drop("n"), ["file", "_start"])
    line = F.col("_place") - F.col("_first") + F.col("_in_file") + 1
    return counted.select("file", line.alias("line"), (line + F.col("_in_all")).alias("line_no"), "value")


def _objects(lines: DataFrame, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """``lines`` with ``r``, each line as an object of ``schema``; blank lines are left out.

    A line that is none, or lacks a field of ``required``, is an error that names file and line.
    """
    parsed = F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    read = lines.where(T.strip(F.col("value")) != "").withColumn("r", parsed)
    fault = F.when(F.col("r").isNull() | F.col("r._corrupt").isNotNull(), "not a JSON object of the expected form")
    for name in required:
        fault = fault.when(F.col(f"r.{name}").isNull(), f"missing {name}")
    where = F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit(": "), fault)
    return read.where(F.when(where.isNotNull(), F.raise_error(where).cast("boolean")).otherwise(F.lit(True)))


def _required(df: DataFrame, names: list[str]) -> DataFrame:
    """Fail on a row that lacks one of ``names``, as a missing key would."""
    for n in names:
        df = df.where(F.assert_true(F.col(n).isNotNull(), f"missing {n}").isNull())
    return df


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df``, or an error that names the columns it lacks."""
    if absent := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df


def to_source_page(df: DataFrame, more: list[str] | None = None) -> DataFrame:
    """Either shape as source pages: ``printed_page`` is a string, ids and collection have one name; columns of ``more`` come along."""
    has = set(df.columns)
    own = {
        "character_id": "character_id" if "character_id" in has else "caliph_id",
        "character_name": "character_name" if "character_name" in has else "caliph_name",
        "collection": "collection" if "collection" in has else "source_group",
    }
    out = []
    for c in SOURCE_PAGE:
        name = own.get(c, c)
        col = F.col(name) if name in has else F.lit(None)
        if c == "collection" and name == "source_group":
            col = F.coalesce(col, F.lit(""))
        out.append(col.cast("int" if c in ("book_id", "page_id", "printed_volume") else "string").alias(c))
    return df.select(*out, *(more or []))


def read_jsonl_pages(spark: SparkSession, path: str) -> DataFrame:
    """All ``*_pages.jsonl`` of a folder, files or folders of part files, but the combined one; a malformed line, or one that lacks a field, is an error that names file and line."""
    return _jsonl_pages(spark, [p for p in _exists(spark, f"{path}/*_pages.jsonl") if p.rsplit("/", 1)[-1] != COMBINED]).drop("file", "line")


def _jsonl_pages(spark: SparkSession, paths: list[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], f"{JSONL_PAGE}, file string, line long")
    required = tuple(c for c in spark.createDataFrame([], JSONL_PAGE).columns if c != "printed_page")
    return _objects(numbered_lines(spark, paths), JSONL_PAGE, required).select("r.*", "file", "line").drop("_corrupt")


def read_page_json(spark: SparkSession, path: str) -> DataFrame:
    """One object per file below ``pages/``."""
    return spark.read.schema(PAGE_JSON).option("multiLine", True).option("mode", "FAILFAST").json(f"{path}/pages/*.json")


def _exists(spark: SparkSession, pattern: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [str(f.getPath()) for f in found] if found else []


def load_source_pages(spark: SparkSession, path: str) -> DataFrame:
    """Source pages of a folder in either shape; page files win."""
    if _exists(spark, f"{path}/pages/*.json"):
        return to_source_page(read_page_json(spark, path))
    if _exists(spark, f"{path}/*_pages.jsonl"):
        return to_source_page(read_jsonl_pages(spark, path))
    raise ValueError(f"no known dataset format in {path}")


def discover_datasets(spark: SparkSession, root: str) -> tuple[DataFrame | None, list[str]]:
    """Source pages of all folders below ``root`` with ``dataset_dir``, and the folders of no known format.

    Folders are listed once, and each format is one scan, whatever their number.
    """
    folders = sorted(_exists(spark, f"{root}/*"))
    with_pages = {p.rsplit("/", 2)[0] for p in _exists(spark, f"{root}/*/pages/*.json")}
    lines = [p for p in _exists(spark, f"{root}/*/*_pages.jsonl") if p.rsplit("/", 1)[-1] != COMBINED]
    named = lambda pattern: F.try_url_decode(F.replace(F.regexp_extract("file", pattern, 1), F.lit("+"), F.lit("%2B")))  # noqa: E731 - paths are escaped
    found = []
    if with_pages:
        read = read_page_json(spark, f"{root}/*").withColumn("file", F.col("_metadata.file_path"))
        found.append(to_source_page(read, ["file"]).withColumn("dataset_dir", named(r"([^/]+)/pages/[^/]+$")))
    known = with_pages | {p.rsplit("/", 1)[0] for p in _exists(spark, f"{root}/*/*_pages.jsonl")}
    if own := [p for p in lines if p.rsplit("/", 1)[0] not in with_pages]:
        found.append(to_source_page(_jsonl_pages(spark, own), ["file"]).withColumn("dataset_dir", named(r"([^/]+)/[^/]+_pages\.jsonl(?:/[^/]+)?$")))
    out = found[0].unionByName(found[1]) if len(found) > 1 else found[0] if found else None
    return out.drop("file") if out is not None else None, [p for p in folders if p not in known]


def split_identity_rejects(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages with an identity, and ``page_id, reason`` of the others."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    bad = blank("character_id") | blank("character_name")
    return pages.where(~bad), pages.where(bad).select("page_id", F.lit("no character_id/character_name in source record").alias("reason"))


def read_pages_strict(spark: SparkSession, path: str) -> DataFrame:
    """JSONL pages that must have an id and a text, in page order; an empty file is an error."""
    df = spark.read.schema(PAGE_JSON).option("mode", "FAILFAST").json(path)
    if df.isEmpty():
        raise ValueError(f"no pages in {path}")
    return _required(df, ["page_id", "text"]).orderBy("page_id")


def validate_cached_records(df: DataFrame, names: tuple[str, ...] = ("page_id", "url", "text", "content_hash")) -> tuple[DataFrame, DataFrame]:
    """Records that have all fields, and the others with ``missing``."""
    missing = F.array_compact(F.array(*[F.when(F.col(n).isNull(), n) for n in names]))
    tagged = df.withColumn("missing", missing)
    return tagged.where(F.size("missing") == 0).drop("missing"), tagged.where(F.size("missing") > 0)


def read_biography_segments(spark: SparkSession, root: str) -> DataFrame:
    """Pages of all biography folders by character; a folder without pages gives its ``raw.txt`` as one.

    Folders are ``NAME/metadata.json`` and so on, or as ``write_biographies`` leaves them, ``folder=NAME/file=metadata.json``.
    """
    written = bool(_exists(spark, f"{root}/folder=*"))
    at = lambda file: f"{root}/folder=*/file={file}" if written else f"{root}/*/{file}"
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/folder=([^/]+)/" if written else r"([^/]+)/[^/]+$", 1)
    meta = spark.read.schema("character_id string, character_name string, dataset_id string").option("multiLine", not written).json(at("metadata.json")).withColumn("folder", folder)
    fields = "page_id int, printed_page int, url string, text string"
    pages = spark.createDataFrame([], f"{fields}, folder string")
    if _exists(spark, at("pages.jsonl")):
        pages = spark.read.schema(fields).json(at("pages.jsonl")).withColumn("folder", folder)
    if _exists(spark, at("raw.txt")):
        raw = spark.read.text(at("raw.txt"), wholetext=True).select(F.col("value").alias("text"), folder.alias("folder"))
        pages = pages.unionByName(raw.join(pages.select("folder").distinct(), "folder", "left_anti"), allowMissingColumns=True)
    return pages.join(meta, "folder").withColumn("source_file", F.col("folder"))


def read_result_log(spark: SparkSession, path: str) -> DataFrame:
    """Result lines of one or several files with ``line_no``, their order of reading over all of them; a line that is no object is an error that names its place."""
    schema = "custom_id string, status string, run_id string, response struct<id:string,model:string,content:string,usage:struct<prompt_tokens:int,completion_tokens:int>>, error struct<type:string,message:string>"
    parsed = _objects(numbered_lines(spark, path), schema)
    return parsed.select("line_no", "r.custom_id", "r.status", "r.run_id", F.col("r.response.content").alias("content"), F.col("r.response.usage.prompt_tokens").alias("prompt_tokens"), F.col("r.response.usage.completion_tokens").alias("completion_tokens"), "r.error")


def read_batch_output(spark: SparkSession, path: str) -> DataFrame:
    """Batch API lines as ``custom_id, status_code, content, status``."""
    schema = "custom_id string, response struct<status_code:int,body:struct<choices:array<struct<message:struct<content:string>>>>>, error string"
    df = spark.read.schema(schema).json(path)
    content = F.get("response.body.choices", F.lit(0))["message"]["content"]
    ok = (F.col("response.status_code") == 200) & content.isNotNull()
    return df.select("custom_id", F.col("response.status_code").alias("status_code"), content.alias("content"), F.when(ok, "completed").otherwise("failed").alias("status"))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """``slug, categories, short_description`` of a snapshot: a map by slug, a list, or either below ``characters``; a missing or broken file gives no rows."""
    fields = "categories:array<string>,short_description:string"
    empty = spark.createDataFrame([], "slug string, categories array<string>, short_description string")
    if not _exists(spark, path):
        return empty
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("v"))
    inner = F.coalesce(F.get_json_object("v", "$.characters"), F.col("v"))
    by_slug = text.select(F.explode(F.from_json(F.when(inner.startswith("{"), inner), f"map<string,struct<{fields}>>")).alias("slug", "x")).where("x IS NOT NULL").select("slug", "x.*")
    listed = text.select(F.explode(F.from_json(F.when(inner.startswith("["), inner), f"array<struct<slug:string,{fields}>>")).alias("x")).where("x.slug IS NOT NULL").select("x.*")
    return empty.unionByName(by_slug).unionByName(listed)
