"""Shared helpers: durable intermediate tables, Arrow text batches, hashing."""

from __future__ import annotations

import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.shipping import importable

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Rows of an Arrow batch. Texts are long: Spark's 10,000 rows of them fill an executor's memory.
BATCH_ROWS = 2500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(rows)) > BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share.

    It lies in ``spark.checkpoint.dir``; where that is unset and all tasks run on
    this machine (local tests), a temporary folder takes its place.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = getattr(shared_dir, "_own", None)
        if base is None:
            base = shared_dir._own = tempfile.mkdtemp(prefix="vellumgrid-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _fs(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> bool:
    fs, p = _fs(spark, old)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new)
    fs.mkdirs(target.getParent())
    return fs.rename(p, target)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there,
    and losing an executor loses nothing."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


class Scratch:
    """Intermediate tables of one operator: called like ``materialise``, it
    deletes all it wrote when the ``with`` block ends. What is returned must be
    materialised apart from it."""

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        out, path = stored(df, name)
        self.paths.append((df.sparkSession, path))
        return out

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for spark, path in self.paths:
            remove(spark, path)


def hot_keys(many: DataFrame, key: str, weight: str | None = None, share: int = 200) -> list[tuple[int, int]]:
    """(key, pieces) of the keys that hold more than one in ``share`` of the rows of
    ``many`` (or of the sum of its column ``weight``); there are at most ``share``
    of them. A piece is one such part."""
    counts = many.groupBy(key).agg((F.sum(weight) if weight else F.count("*")).alias("c"))
    n = many.agg(F.sum(weight)).head()[0] if weight else many.count()
    return [(r[key], -(-r.c * share // n)) for r in counts.filter(F.col("c") * share > n).collect()] if n else []


def spread_join(many: DataFrame, one: DataFrame, key: str, hot: list[tuple[int, int]], how: str = "inner", also: tuple[str, ...] = ()) -> DataFrame:
    """``many`` joined with ``one`` by a column of longs (and those of ``also``), the
    hot keys' rows dealt to several tasks: their rows of ``one`` are repeated, once
    for each piece."""
    if not hot:
        return many.join(one, [key, *also], how)
    rows = F.array(*[F.struct(F.lit(k).cast("long").alias(key), F.lit(n).cast("long").alias("_pieces")) for k, n in hot])
    known = F.broadcast(many.sparkSession.range(1).select(F.inline(rows)))  # at most ``share`` rows
    dealt = many.join(known, key, "left")
    # by the row's hash: a task that runs again deals the same
    dealt = dealt.withColumn("_piece", F.coalesce(F.pmod(F.xxhash64(*many.columns), F.col("_pieces")), F.lit(0)).cast("long")).drop("_pieces")
    copied = one.join(known, key, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_pieces", F.lit(1)) - 1))).drop("_pieces")
    return dealt.join(copied, [key, "_piece", *also], how).drop("_piece")


def crc_fold(column: str, modulus: int) -> Column:
    """crc32 of the column's decimal text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (shift-multiply avalanche)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n+1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]]
    return raw, offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 4_000_000):
    """Cut a record batch so that each piece has about ``limit`` bytes of text;
    a single longer text is a piece of its own."""
    _, offs = text_buffers(batch.column(column))
    start, n = 0, batch.num_rows
    while start < n:
        stop = int(np.searchsorted(offs, offs[start] + limit, side="right")) - 1
        stop = min(n, max(stop, start + 1))
        yield batch.slice(start, stop - start)
        start = stop


#: Bytes that belong to words: ASCII letters and digits and all of UTF-8's
#: multi-byte characters; everything else separates.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[c for c in range(128) if chr(c).isalnum()]] = True
WORD_BYTE[128:] = True

_POWER = np.uint64(0x2545F4914F6CDD1D)
_INVERSE = np.uint64(pow(0x2545F4914F6CDD1D, -1, 2**64))
_powers: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        full = np.full(max(n, 2 * len(have), 1 << 16), base, np.uint64)
        full[0] = 1
        have = _powers[kind] = np.cumprod(full, dtype=np.uint64)
    return have


def words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of the (lower-cased) texts, the n+1 offsets of each
    text's words, and the words' first bytes. A text's end ends a word."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64), np.zeros(0, np.int64)
    inside = WORD_BYTE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts_of_text = offs[:-1][offs[:-1] < len(raw)]
    first[starts_of_text] = inside[starts_of_text]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power("p", _POWER, len(raw))[: len(raw)], out=sums[1:])
    hashes = (sums[end] - sums[begin]) * _power("i", _INVERSE, len(raw))[begin]
    hashes = mix64(hashes + (end - begin).astype(np.uint64))
    return hashes, np.searchsorted(begin, offs), begin


_MULTIPLIERS = np.array([0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def shingles(hashes: np.ndarray, offs: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words within a text, with the text's
    number. A text of fewer words (but at least one) has one run, of them all."""
    n = np.diff(offs)
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(hashes)) - offs[:-1][owner] if len(hashes) else np.zeros(0, np.int64)
    keep = (place + size <= n[owner]) | ((place == 0) & (n[owner] < size)) if len(hashes) else np.zeros(0, bool)
    at = np.flatnonzero(keep)
    total = np.zeros(len(at), np.uint64)
    for k in range(size):
        there = at + k
        ok = (place[at] + k) < n[owner[at]]
        total[ok] = mix64(total[ok] + hashes[there[ok]] * _MULTIPLIERS[k % 5] + np.uint64(k + 1))
    return total, owner[at]


def crc32_ids(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def ragged(flat: np.ndarray, offs: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of rows ``pick`` of a ragged array, and each row's length."""
    n = (offs[1:] - offs[:-1])[pick]
    total = int(n.sum())
    if not total:
        return flat[:0], n
    at = np.arange(total) + np.repeat(offs[:-1][pick] - (np.cumsum(n) - n), n)
    return flat[at], n
