"""Snapshot stores: tables in buckets, whose versions are published together.

Every table of a store is split by a hash of its key into a fixed number of buckets. A
version is a manifest: of each table and bucket the folders that hold its rows. A write
replaces some buckets, in folders of its own, and its manifest names these and, for all other
buckets, the folders of the version before. So what a small batch writes follows the
buckets that it touches, not the store.

Rows that replace nothing are added: their folders join those that a bucket has, and nothing is rewritten.
A bucket of ``PARTS`` folders or more is rewritten as one by the next batch that touches it.

A version is in force from the moment that its mark is there, for all tables at once.
Nothing else is replaced or renamed, so a run that stops at any point leaves the
version before in force, and a reader that has begun keeps its version while it is among the last ``keep``.
"""

from __future__ import annotations

import json
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A version's folder holds its manifest, and this file once it is complete; the store's folder holds the other once a version ever was.
COMPLETE, CREATED = "_COMPLETE", "_CREATED"
BUCKETS, KEEP = 64, 2
#: Folders that a bucket may have.
PARTS = 32
#: The column that folders of buckets are named by.
BUCKET = "snapshot_bucket"


class SnapshotStore:
    """Tables in ``path``: ``tables`` has the columns by which each is bucketed. Tables with equal columns and values have equal buckets.

    ``buckets`` counts for a new store; an old one keeps its own. A bucket may have several files, so their number decides
    how much a small batch rewrites, not how large a table can be. Two writers at once are an error of the later one.
    """

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, list[str]], buckets: int = BUCKETS, keep: int = KEEP):
        self.spark, self.path, self.tables, self.keep = spark, path.rstrip("/"), tables, keep
        self._new_buckets = buckets

    # ---- folders ----

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("v").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, pattern: str) -> list[str]:
        """Paths below the store's folder, relative to it."""
        depth = pattern.count("/") + 1
        return ["/".join(str(f.getPath()).split("/")[-depth:]) for f in self._fs().globStatus(self._at(pattern)) or []]

    def _numbers(self, pattern: str) -> list[int]:
        return sorted(int(re.search(r"v=(\d+)", p)[1]) for p in self._listed(pattern))

    def versions(self) -> list[int]:
        """Numbers of the complete versions, in order."""
        return self._numbers(f"v=*/{COMPLETE}")

    def exists(self) -> bool:
        """Whether a version was ever completed; if one was and none is left, that is an error, not an empty store."""
        done = self.versions()
        if not done and self._fs().exists(self._at(CREATED)):
            raise RuntimeError(f"{self.path} has had versions but has no complete one")
        return bool(done)

    def manifest(self, version: int | None = None) -> dict:
        """``buckets, schemas, folders`` of a version, the last one by default."""
        if version is None:
            if not self.exists():
                raise FileNotFoundError(f"no complete version in {self.path}")
            version = self.versions()[-1]
        lines = self.spark.read.text(f"{self.path}/v={version:08d}/manifest.json").collect()  # a row for each table and bucket
        out: dict = {"buckets": 0, "schemas": {}, "folders": {}}
        for entry in (json.loads(r[0]) for r in lines):
            if "buckets" in entry:
                out["buckets"] = entry["buckets"]
            elif "schema" in entry:
                out["schemas"][entry["table"]] = StructType.fromJson(entry["schema"])
            else:
                out["folders"][entry["table"], entry["bucket"], entry.get("part", 0)] = entry["folder"]
        return out

    # ---- buckets ----

    def buckets(self) -> int:
        return self.manifest()["buckets"] if self.exists() else self._new_buckets

    def bucket(self, table: str, n: int) -> Column:
        return F.pmod(F.xxhash64(*self.tables[table]), F.lit(n)).cast("int")

    def touched(self, rows: DataFrame, table: str) -> list[int]:
        """The buckets of ``rows``, at most all."""
        return sorted(r[0] for r in rows.select(self.bucket(table, self.buckets()).alias("b")).distinct().collect())

    def read(self, table: str, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """A table of a version, or some of its buckets only."""
        manifest = self.manifest(version)
        wanted = None if buckets is None else set(buckets)
        folders = [f for (t, b, _), f in sorted(manifest["folders"].items()) if t == table and (wanted is None or b in wanted)]
        return self.read_folders(folders, manifest["schemas"][table])

    def read_folders(self, folders: list[str], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def full(self, table: str) -> set[int]:
        """Buckets with ``PARTS`` folders or more."""
        many = Counter(b for t, b, _ in self.manifest()["folders"] if t == table) if self.exists() else {}
        return {b for b, n in many.items() if n >= PARTS}

    def write(self, rows: dict[str, DataFrame], touched: list[int] | None = None) -> int:
        """Publish a version in which the ``touched`` buckets (all, if None) of the named tables hold ``rows``, and the number of that version.

        Other buckets, and other tables, stay as they are.
        """
        number, n = self.begin(), self.buckets()
        changed = set(range(n) if touched is None else touched)
        parts = {table: [self.put(number, table, table, df)] for table, df in rows.items()}
        for table, made in parts.items():
            if other := {b for part in made for b in part} - changed:
                raise ValueError(f"rows of {table} lie in bucket {min(other)}, which is not among those to be written")
        return self.publish(number, parts, {t: df.schema for t, df in rows.items()}, changed)

    def begin(self) -> int:
        """The number of a version to come."""
        return max([*self._numbers("v=*"), *self._numbers("data/v=*")], default=0) + 1

    def dealt(self, table: str, df: DataFrame) -> DataFrame:
        """``df`` dealt by buckets, so that each has few files."""
        return df.withColumn(BUCKET, self.bucket(table, self.buckets())).hint("rebalance", F.col(BUCKET)).drop(BUCKET)

    def put(self, number: int, table: str, name: str, df: DataFrame, deal: bool = True) -> dict[int, str]:
        """Write rows of a table of a version to come, and the folder of each bucket. Without ``deal`` rows stay in their tasks, for those that come from folders of buckets."""
        out = df.withColumn(BUCKET, self.bucket(table, self.buckets()))
        place = f"data/v={number:08d}/{name}"
        (out.hint("rebalance", F.col(BUCKET)) if deal else out).write.option("compression", "zstd").partitionBy(BUCKET).parquet(f"{self.path}/{place}")
        return {int(f.rsplit("=", 1)[1]): f for f in self._listed(f"{place}/{BUCKET}=*")}

    def drop(self, number: int, name: str) -> None:
        """Take back what ``put`` wrote."""
        self._fs().delete(self._at(f"data/v={number:08d}/{name}"), True)

    def publish(self, number: int, parts: dict[str, list[dict[int, str]]], schemas: dict[str, StructType], replaced: set[int]) -> int:
        """A version in which the named tables have ``parts``: in ``replaced`` buckets instead of what these hold, in others besides it."""
        old = self.manifest() if self.exists() else {"buckets": self._new_buckets, "schemas": {}, "folders": {}}
        folders = {k: f for k, f in old["folders"].items() if k[0] not in parts or k[1] not in replaced}
        for table, made in parts.items():
            for part in made:
                for b, folder in part.items():
                    folders[table, b, 1 + max((k[2] for k in folders if k[:2] == (table, b)), default=-1)] = folder
        schemas = {**old["schemas"], **schemas}
        lines = [{"buckets": old["buckets"]}, *({"table": t, "schema": s.jsonValue()} for t, s in schemas.items()), *({"table": t, "bucket": b, "part": p, "folder": f} for (t, b, p), f in sorted(folders.items()))]
        self._put(f"v={number:08d}/manifest.json", "\n".join(map(json.dumps, lines)))
        self._put(f"v={number:08d}/{COMPLETE}", "")
        if not self._fs().exists(self._at(CREATED)):
            self._put(CREATED, "")
        self._clean(number)
        return number

    def _put(self, name: str, text: str) -> None:
        out = self._fs().create(self._at(name), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _clean(self, newest: int) -> None:
        """Delete versions before the last ``keep``, what only they hold, and what stopped runs have left."""
        done, fs = self.versions(), self._fs()
        stays = done[-self.keep :]
        held = {f for v in stays for f in self.manifest(v)["folders"].values()}
        for v in done[: -self.keep]:
            for folder in set(self.manifest(v)["folders"].values()) - held:
                fs.delete(self._at(folder), True)
            fs.delete(self._at(f"v={v:08d}"), True)
        for v in {*self._numbers("v=*"), *self._numbers("data/v=*")} - set(done):
            if v < newest:
                for name in (f"v={v:08d}", f"data/v={v:08d}"):
                    # a version that is gone may have folders that are still held
                    if not any(f.startswith(f"{name}/") for f in held):
                        fs.delete(self._at(name), True)
