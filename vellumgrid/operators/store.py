"""Tables of documents, chunks and vectors: upserts, lookups, deletes, checks.

Each function maps tables to tables; ``TableStore`` keeps them as versions in
Parquet, a change writing what it touches and a new manifest.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vellumgrid.config import StorageError


def upsert(table: DataFrame, changes: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``table`` with ``changes`` by key; the columns ``keep`` stay as they were
    in rows that exist. The last of several changes of a key counts in no order,
    so changes are expected to have distinct keys."""
    old = table.withColumn("_old", F.lit(True))
    new = changes.dropDuplicates([key]).withColumn("_new", F.lit(True))
    both = old.alias("o").join(new.alias("n"), key, "full_outer")
    cols = []
    for c in table.columns:
        if c == key:
            cols.append(F.col(key))
        elif c not in changes.columns:
            cols.append(F.col(f"o.{c}").alias(c))
        elif c in keep:
            cols.append(F.when(F.col("_old"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
        else:
            cols.append(F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return both.select(*cols)


def updated(table: DataFrame, key: str, value: str, changes: dict[str, object]) -> DataFrame:
    """One row's columns set; unchanged without changes."""
    for name, new in changes.items():
        table = table.withColumn(name, F.when(F.col(key) == value, F.lit(new)).otherwise(F.col(name)))
    return table


def without(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti")


def delete_document(documents: DataFrame, chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and, with them, their chunks."""
    return without(documents, ids, "doc_id"), without(chunks, ids, "doc_id")


def by_key(table: DataFrame, key: str, value: object) -> DataFrame:
    return table.filter(F.col(key) == value)


def by_section(chunks: DataFrame, doc_id: object, section: str) -> DataFrame:
    return chunks.filter((F.col("doc_id") == doc_id) & (F.col("section") == section)).orderBy("created_at")


def checked_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """Vector rows; one of another length fails the job when it is read."""
    bad = F.raise_error(F.concat(F.lit("vector of wrong length: "), F.col("chunk_id"))).cast(vectors.schema["embedding"].dataType)
    return vectors.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(bad))


def missing(expected: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Expected keys that the store lacks."""
    return expected.select(key).distinct().join(stored.select(key), key, "left_anti")


class Conflict(StorageError):
    """Another writer published the next version first."""


class TableStore:
    """Named Parquet tables under one folder.

    A table keyed by a column lies in ``BUCKETS`` buckets of its key's hash. A
    version is a small manifest that names the data folder of each bucket; a change
    writes new folders for the buckets that it touches alone, and the manifest keeps
    the rest. Manifests are published by a rename; of two with one number the earlier
    counts, and the other's writer starts again from it. Older versions stay until
    ``prune``, so readers are never disturbed."""

    BUCKETS = 64

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def _fs(self, path: str):
        p = self._jvm(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _versions(self, name: str) -> list[str]:
        """Names of the manifests that count, by number."""
        fs, p = self._fs(f"{self.root}/{name}/manifests")
        if not fs.exists(p):
            return []
        first: dict[int, tuple[int, str]] = {}
        for s in fs.listStatus(p):
            label = s.getPath().getName()
            number = int(label.split("-")[0])
            first[number] = min(first.get(number, (2**63, "")), (s.getModificationTime(), label))
        return [first[k][1] for k in sorted(first)]

    def _manifest(self, name: str, version: str) -> dict:
        fs, p = self._fs(f"{self.root}/{name}/manifests/{version}")
        stream = fs.open(p)
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def has(self, name: str) -> bool:
        return bool(self._versions(name))

    def read(self, name: str) -> DataFrame:
        versions = self._versions(name)
        if not versions:
            raise StorageError(f"no table {name}")
        return self._read(name, self._manifest(name, versions[-1]))

    def _read(self, name: str, manifest: dict, buckets: list[str] | None = None) -> DataFrame:
        parts = [p for k, p in manifest["parts"].items() if buckets is None or k in buckets]
        schema = StructType.fromJson(manifest["schema"])
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}/{p}" for p in parts])

    def _publish(self, name: str, number: int, manifest: dict) -> None:
        label = f"{number:08d}-{uuid.uuid4().hex[:12]}"
        fs, staged = self._fs(f"{self.root}/{name}/staged/{label}")
        out = fs.create(staged)
        out.write(json.dumps(manifest).encode())
        out.close()
        target = self._jvm(f"{self.root}/{name}/manifests/{label}")
        fs.mkdirs(target.getParent())
        if not fs.rename(staged, target):
            raise StorageError(f"{name}: the version could not be published")
        counts = [v for v in self._versions(name) if int(v.split("-")[0]) == number]
        if counts != [label]:
            fs.delete(target, False)
            raise Conflict(f"{name}: version {number} was published by another writer")

    def replace(self, name: str, rows: DataFrame) -> DataFrame:
        """A new version of these rows alone, in the order and files they come in."""
        versions = self._versions(name)
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{name}/{folder}")
        manifest = {"schema": rows.schema.jsonValue(), "parts": {"all": folder}, "key": None}
        self._publish(name, int(versions[-1].split("-")[0]) + 1 if versions else 1, manifest)
        return self.read(name)

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.BUCKETS)).cast("string")

    def _change(self, name: str, key: str, touched: DataFrame, change) -> None:
        """The next version: ``change`` maps the rows of the buckets that the keys
        ``touched`` fall in."""
        versions = self._versions(name)
        manifest = self._manifest(name, versions[-1])
        if manifest["key"] != key:  # a table not yet in buckets of this key is dealt to them once
            manifest = self._dealt(name, self._read(name, manifest), key, {})
        buckets = [r.b for r in touched.select(self._bucket(key).alias("b")).distinct().collect()]  # at most BUCKETS
        now = change(self._read(name, manifest, buckets))
        new = self._dealt(name, now, key, {k: p for k, p in manifest["parts"].items() if k not in buckets})
        self._publish(name, int(versions[-1].split("-")[0]) + 1, new)

    def _dealt(self, name: str, rows: DataFrame, key: str, parts: dict) -> dict:
        folder = f"data/{uuid.uuid4().hex}"
        dealt = rows.withColumn("_bucket", self._bucket(key))
        dealt.repartition(self.BUCKETS, "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{name}/{folder}")
        fs, p = self._fs(f"{self.root}/{name}/{folder}")
        made = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
        return {"schema": rows.schema.jsonValue(), "key": key, "parts": parts | {m.split("=")[1]: f"{folder}/{m}" for m in made if m.startswith("_bucket=")}}

    def _retried(self, attempt, tries: int = 5):
        for k in range(tries):
            try:
                return attempt()
            except Conflict:
                if k == tries - 1:
                    raise

    def upsert(self, name: str, rows: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
        if not self.has(name):
            try:
                self._publish(name, 1, self._dealt(name, rows.dropDuplicates([key]), key, {}))
                return self.read(name)
            except Conflict:
                pass
        self._retried(lambda: self._change(name, key, rows, lambda old: upsert(old, rows, key, keep)))
        return self.read(name)

    def append(self, name: str, rows: DataFrame) -> None:
        """Rows of a log: files are added, none is rewritten."""
        rows.write.mode("append").parquet(f"{self.root}/{name}/log")

    def log(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/log")

    def delete(self, name: str, ids: DataFrame, key: str) -> int:
        """The number of rows deleted."""
        gone = self.read(name).join(ids.select(key).distinct(), key, "left_semi").count()
        if gone:
            self._retried(lambda: self._change(name, key, ids, lambda old: without(old, ids, key)))
        return gone

    def prune(self, name: str) -> None:
        """Delete the manifests before the newest, and the data that it doesn't name."""
        versions = self._versions(name)
        if not versions:
            return
        used = {p.split("/")[1] for p in self._manifest(name, versions[-1])["parts"].values()}
        for folder, kept in (("manifests", {versions[-1]}), ("data", used)):
            fs, p = self._fs(f"{self.root}/{name}/{folder}")
            for s in fs.listStatus(p):
                if s.getPath().getName() not in kept:
                    fs.delete(s.getPath(), True)
