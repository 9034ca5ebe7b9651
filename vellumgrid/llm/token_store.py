"""Content-addressed store of token ids.

Each document's ids (with end id 0) are cut into chunks where a rolling hash of
the last eight ids meets a mask, so equal stretches are cut alike wherever they
stand. A chunk's name is the SHA-256 of its bytes; ``chunks`` holds each name
once, ``recipes`` holds, in ascending doc_id order, the names and lengths of a
document's chunks and their Merkle root, and ``manifest`` the Merkle root of
each recipe shard and of the whole store. Ids are stored as little-endian
unsigned integers of 2 bytes (vocabularies up to 65,536 ids) or 4.

One shuffle moves the chunks, deduplicated within each task first, so a chunk
of thousands of copies moves once a task. ``read_digests`` reads the files back
without moving the chunks again: every chunk is hashed where it is read (a
mismatch fails the job), its CRC is taken over the ids as 4-byte integers, and
CRCs of a document's chunks are joined by the algebra of CRC-32
(crc(a+b) = crc(a)*x^(8*len(b)) xor crc(b)), which is an xor over rows.

Edge cases: null or empty text gives the end id alone; texts of any length are
encoded whole; a special token's string in a text gives its id, as the library's
plain call does; repeated doc_ids are kept, each as a document of its own, and so
tie on the id alone: they stand in the order of their roots; null doc_ids come first; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumgrid.llm import bpe, common

WINDOW, LEAST, MASK, MOST = 8, 128, 511, 4096
_ROWS = "kind int, name binary, payload binary, doc_id long, n_tokens long, sizes array<int>, root binary"


def cuts(ids: np.ndarray, offs: np.ndarray, least: int = LEAST, mask: int = MASK, most: int = MOST) -> list[np.ndarray]:
    """Ends of the chunks of each document of a flat id array."""
    h = np.zeros(len(ids), np.uint32)
    for k in range(WINDOW):  # the sum of a polynomial over the last ids
        h[k:] += (ids[: len(ids) - k].astype(np.uint32) + np.uint32(1)) * np.uint32(pow(0x01000193, k + 1, 2**32))
    h ^= h >> np.uint32(15)
    marks = np.flatnonzero((h & np.uint32(mask)) == 0) + 1
    lo = np.searchsorted(marks, offs[:-1] + WINDOW)  # a window lies within its document
    hi = np.searchsorted(marks, offs[1:], side="left")
    out = []
    for a, b, begin, end in zip(lo.tolist(), hi.tolist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        ends, at = [], begin
        for m in marks[a:b].tolist():
            while m - at > most:
                at += most
                ends.append(at)
            if m - at >= least:
                ends.append(m)
                at = m
        while end - at > most:
            at += most
            ends.append(at)
        if end > at:
            ends.append(end)
        out.append(np.array(ends, np.int64))
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary SHA-256 tree; a level's odd last node goes up as it is."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    while len(leaves) > 1:
        pairs = [hashlib.sha256(b"\x01" + leaves[k] + leaves[k + 1]).digest() for k in range(0, len(leaves) - 1, 2)]
        leaves = pairs + leaves[len(leaves) - len(leaves) % 2 :]
    return leaves[0]


def _encode(path: str, width: int, seen_limit: int = 60_000):
    kind = f"<u{width}"

    def run(batches):
        code = bpe.encoder(path)
        seen: set[bytes] = set()
        for whole in batches:
            for batch in common.slices(whole, "text", 2_000_000):
                ids, n = code.encode(batch.column("text"))
                full = np.zeros(len(ids) + len(n), np.uint32)  # each document ends with id 0
                ends = np.cumsum(n + 1)
                body = np.ones(len(full), bool)
                body[ends - 1] = False
                full[body] = ids
                offs = np.concatenate([[0], ends])
                stored = full.astype(kind)
                names, payloads, recipe, sizes, roots = [], [], [], [], []
                for k, doc_ends in enumerate(cuts(full, offs)):
                    at, own = int(offs[k]), []
                    for end in doc_ends.tolist():
                        data = stored[at:end].tobytes()
                        name = hashlib.sha256(data).digest()
                        own.append(name)
                        if name not in seen:
                            seen.add(name)
                            names.append(name)
                            payloads.append(data)
                        at = end
                    recipe.append(b"".join(own))
                    sizes.append(np.diff(doc_ends, prepend=offs[k]).tolist())
                    roots.append(merkle(own))
                if len(seen) > seen_limit:
                    seen.clear()
                docs, c = len(recipe), len(names)
                void = lambda k, t: pa.nulls(k, t)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([0] * c + [1] * docs, pa.int32()),
                        pa.array(names + [hashlib.sha256(r + str(d).encode()).digest() for r, d in zip(roots, batch.column("doc_id").to_pylist(), strict=True)], pa.binary()),
                        pa.array(payloads + recipe, pa.binary()),
                        pa.concat_arrays([void(c, pa.int64()), batch.column("doc_id").cast(pa.int64())]),
                        pa.concat_arrays([void(c, pa.int64()), pa.array(n + 1, pa.int64())]),
                        pa.array([None] * c + sizes, pa.list_(pa.int32())),
                        pa.array([None] * c + roots, pa.binary()),
                    ],
                    ["kind", "name", "payload", "doc_id", "n_tokens", "sizes", "root"],
                )

    return run


def write(docs: DataFrame, root: str, vocabulary: str | None = None) -> None:
    """Encode ``docs`` (doc_id, text) and write the store to ``root``."""
    spark = docs.sparkSession
    path = vocabulary or bpe.default_vocabulary()
    width = 2 if bpe.encoder(path).vocabulary <= 1 << 16 else 4
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_encode(path, width), _ROWS)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # equal chunks meet in one partition, one from each task; the first stays
    turn = F.row_number().over(Window.partitionBy("name").orderBy("kind"))
    once = rows.repartition(parts, "name").withColumn("turn", turn).filter("turn = 1 or kind = 1").drop("turn")
    once.write.option("compression", "zstd").partitionBy("kind").parquet(f"{root}/objects")
    recipes = _objects(spark, root, 1)
    ordered = recipes.repartitionByRange(parts, "doc_id", "root").sortWithinPartitions("doc_id", "root")
    ordered.mapInArrow(
        _shard, "shard int, place long, doc_id long, n_tokens long, local_start long, sizes array<int>, names binary, root binary, chain binary"
    ).write.option("compression", "zstd").parquet(f"{root}/recipes")
    last = F.max_by(F.struct("chain", (F.col("local_start") + F.col("n_tokens")).alias("n_tokens")), "place")
    tops = spark.read.parquet(f"{root}/recipes").groupBy("shard").agg(last.alias("x"), F.count("*").alias("n_docs")).select("shard", "n_docs", "x.*")
    # one row a shard: as many as there are shuffle partitions
    known = sorted(tops.collect(), key=lambda r: r.shard)
    start, out = 0, []
    for r in known:
        out.append((r.shard, start, r.n_docs, r.n_tokens, bytes(r.chain), width))
        start += r.n_tokens
    top = merkle([r[4] for r in out])
    spark.createDataFrame(
        [(*r, top) for r in out], "shard int, start long, n_docs long, n_tokens long, shard_root binary, width int, root binary"
    ).coalesce(1).write.parquet(f"{root}/manifest")


def _objects(spark: SparkSession, root: str, kind: int) -> DataFrame:
    return spark.read.schema(_ROWS).parquet(f"{root}/objects").filter(F.col("kind") == kind)


def _shard(batches):
    """Numbers a sorted partition's documents and chains their roots."""
    from pyspark import TaskContext

    shard, place, start, chain = TaskContext.get().partitionId(), 0, 0, hashlib.sha256(b"").digest()
    for batch in batches:
        n = np.asarray(batch.column("n_tokens").to_pylist(), np.int64)
        starts = start + np.cumsum(n) - n
        chains = []
        for r in batch.column("root").to_pylist():
            chain = hashlib.sha256(chain + r).digest()
            chains.append(chain)
        rows = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(rows, shard), pa.int32()), pa.array(place + np.arange(rows), pa.int64()), batch.column("doc_id"), batch.column("n_tokens"),
                pa.array(starts, pa.int64()), batch.column("sizes"), batch.column("payload"), batch.column("root"), pa.array(chains, pa.binary()),
            ],
            ["shard", "place", "doc_id", "n_tokens", "local_start", "sizes", "names", "root", "chain"],
        )
        place, start = place + rows, start + int(n.sum())


_POLY = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of reflected polynomials modulo CRC-32's."""
    p, m, b = np.zeros(len(a), np.uint32), np.uint32(1 << 31), b.astype(np.uint32)
    for _ in range(32):
        p ^= np.where(a & m, b, np.uint32(0))
        m >>= np.uint32(1)
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), _POLY, np.uint32(0))
    return p


def _shift(length: np.ndarray) -> np.ndarray:
    """x^(8*length) for byte lengths."""
    out = np.full(len(length), 1 << 31, np.uint32)
    power = np.array([1 << 23], np.uint32)  # x^8
    left = length.astype(np.int64)
    while left.any():
        odd = (left & 1).astype(bool)
        out[odd] = _times(out[odd], np.repeat(power, odd.sum()))
        power = _times(power, power)
        left >>= 1
    return out


def _verify(width: int):
    def run(batches):
        for batch in batches:
            names, data = batch.column("name").to_pylist(), batch.column("payload").to_pylist()
            crcs = np.zeros(len(names), np.int64)
            for k, (name, body) in enumerate(zip(names, data, strict=True)):
                if hashlib.sha256(body).digest() != name:
                    raise ValueError("a stored chunk does not match its name")
                crcs[k] = zlib.crc32(np.frombuffer(body, f"<u{width}").astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(crcs, pa.int64())], ["name", "crc"])

    return run


def _leaves(batches):
    """A row for each chunk of a recipe: its name and the bytes that follow it in the document."""
    for batch in batches:
        sizes, names, roots = batch.column("sizes").to_pylist(), batch.column("names").to_pylist(), batch.column("root").to_pylist()
        out, rest, rows = [], [], []
        for k, (size, joined, root) in enumerate(zip(sizes, names, roots, strict=True)):
            own = [joined[i : i + 32] for i in range(0, len(joined), 32)]
            if merkle(own) != root:
                raise ValueError("a recipe does not match its Merkle root")
            out += own
            rest += (4 * (np.sum(size) - np.cumsum(size))).tolist()
            rows += [k] * len(own)
        pick = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("shard").take(pick), batch.column("place").take(pick), pa.array(out, pa.binary()), pa.array(rest, pa.int64())],
            ["shard", "place", "name", "rest"],
        )


def _terms(batches):
    for batch in batches:
        crc = batch.column("crc").to_numpy(zero_copy_only=False).astype(np.uint32)
        rest = batch.column("rest").to_numpy(zero_copy_only=False)
        term = _times(_shift(rest), crc).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("place"), pa.array(term, pa.int64())], ["shard", "place", "term"])


def read_digests(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, from the files."""
    manifest = spark.read.parquet(f"{root}/manifest")
    first = manifest.select("width").head()
    width = first.width if first else 4
    recipes = spark.read.parquet(f"{root}/recipes")
    chunks = _objects(spark, root, 0).select("name", "payload").mapInArrow(_verify(width), "name binary, crc long")
    leaves = recipes.select("shard", "place", "sizes", "names", "root").mapInArrow(_leaves, "shard int, place long, name binary, rest long")
    found = leaves.join(chunks, "name").select("shard", "place", "rest", "crc")
    terms = found.mapInArrow(_terms, "shard int, place long, term long")
    # a chunk that is missing leaves fewer terms than the recipe has
    crcs = terms.groupBy("shard", "place").agg(F.bit_xor("term").alias("ids_crc32"), F.count("*").alias("found"))
    whole = recipes.select("shard", "place", "doc_id", "n_tokens", "local_start", F.size("sizes").alias("n_chunks")).join(
        F.broadcast(manifest.select("shard", "start")), "shard"
    )
    checked = F.when(F.col("found") == F.col("n_chunks"), F.col("ids_crc32")).otherwise(F.raise_error(F.lit("chunks are missing")).cast("long"))
    return whole.join(crcs, ["shard", "place"], "left").select(
        "doc_id", (F.col("start") + F.col("local_start")).alias("start"), "n_tokens", checked.alias("ids_crc32"), "n_chunks"
    )


def read_documents(spark: SparkSession, root: str, doc_ids: list[int]) -> dict[int, list[np.ndarray]]:
    """The ids of a few documents, rebuilt from their chunks."""
    manifest = spark.read.parquet(f"{root}/manifest").select("width").head()
    rows = spark.read.parquet(f"{root}/recipes").filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "names").collect()
    need = {bytes(r.names)[i : i + 32] for r in rows for i in range(0, len(r.names), 32)}
    wanted = spark.createDataFrame([(bytearray(x),) for x in need], "name binary")
    have = {bytes(r.name): bytes(r.payload) for r in _objects(spark, root, 0).join(wanted, "name", "left_semi").select("name", "payload").collect()}
    out: dict[int, list[np.ndarray]] = {}
    for r in rows:
        body = b"".join(have[bytes(r.names)[i : i + 32]] for i in range(0, len(r.names), 32))
        out.setdefault(r.doc_id, []).append(np.frombuffer(body, f"<u{manifest.width}").astype(np.uint32))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = common.shared_dir(spark, "token-store")
    write(common.table(spark, sf_dir, "documents"), root)
    return read_digests(spark, root)
