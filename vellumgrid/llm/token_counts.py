"""Token counts kept as additive rollups under signed changes.

Every change of the corpus is a row ``(doc_id, op, source, lang,
tokenizer_version, n_tokens, old_n_tokens)``: ``insert`` adds a document,
``delete`` takes one away (``old_n_tokens``, or ``n_tokens`` where that is
null), ``revise`` replaces ``old_n_tokens`` by ``n_tokens``. A document that
moves to another source or language is a delete and an insert. A batch is summed
to one signed row per (source, lang, version).

Commits are idempotent also under races and deaths. An attempt at a batch writes
to staging and is renamed, whole, to a name of its own below the batch's folder;
of a batch's attempts the earliest counts and the others are ignored, so two
writers of one batch need no lock. ``compact`` writes the totals together with
the names of the batches in them, and publishes both by one rename as the next
generation; readers take the newest generation and the batches it doesn't name.
A generation's batches are deleted only by the compaction after it, so a reader
of the one before still finds its files. Whatever dies midway leaves only
folders that no reader looks at.

Edge cases: null text counts as the empty text (0 tokens); a text of any length
is counted whole; null source or lang is a group of its own; repeated rows count
as often as they stand in the batch; attempts of the same age go by name; an
empty batch commits and changes nothing; an unknown ``op``, or a count that its
``op`` needs and lacks, fails the batch; other columns are ignored; groups whose
totals all reach 0 are not returned.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.llm import bpe, common

KEYS = ["source", "lang", "tokenizer_version"]
_DELTA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``docs`` (text among its columns) reduced to doc_id, source, lang and
    ``n_tokens``, the number of ids of the whole text."""
    path = vocabulary or bpe.default_vocabulary()

    def run(batches):
        code = bpe.encoder(path)
        for whole in batches:
            for batch in common.slices(whole, "text"):
                _, n = code.encode(batch.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("source"), batch.column("lang"), pa.array(n, pa.int64())],
                    ["doc_id", "source", "lang", "n_tokens"],
                )

    picked = docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("text").cast("string")
    )
    return picked.mapInArrow(run, "doc_id long, source string, lang string, n_tokens long")


def signed(changes: DataFrame) -> DataFrame:
    """One signed row per change."""
    op = F.coalesce("op", F.lit("null"))
    new, old = F.col("n_tokens").cast("long"), F.col("old_n_tokens").cast("long")
    lacks = lambda x: F.coalesce(x, F.raise_error(F.concat(F.lit("a count is missing for: "), op)).cast("long"))
    bad = F.raise_error(F.concat(F.lit("unknown op: "), op)).cast("long")
    docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(bad)
    tokens = F.when(op == "insert", lacks(new)).when(op == "delete", -lacks(F.coalesce(old, new))).when(op == "revise", lacks(new) - lacks(old)).otherwise(bad)
    return changes.select(*KEYS, docs.cast("long").alias("n_docs"), tokens.cast("long").alias("n_tokens"))


def _name(batch_id: str) -> str:
    return hashlib.sha256(batch_id.encode()).hexdigest()[:32]


class TokenRollup:
    """Rollup tables under ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _list(self, path: str) -> list[tuple[int, str]]:
        """(modification time, name) of a folder's entries, in this order."""
        fs, place = common._fs(self.spark, f"{self.root}/{path}")
        if not fs.exists(place):
            return []
        return sorted((s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(place))

    def _snapshot(self) -> str | None:
        """The newest generation; of equal numbers the smallest name."""
        names = [name for _, name in self._list("snapshots")]
        return min(names, key=lambda name: (-int(name.split("-")[0]), name)) if names else None

    def _folded(self, snapshot: str | None) -> DataFrame:
        if snapshot is None:
            return self.spark.createDataFrame([], "batch string")
        return self.spark.read.schema("batch string").parquet(f"{self.root}/snapshots/{snapshot}/batches")

    def _open(self, snapshot: str | None) -> list[tuple[str, str]]:
        """(batch, attempt) of the batches that ``snapshot`` doesn't name."""
        there = [(batch, self._list(f"deltas/{batch}")) for _, batch in self._list("deltas")]
        there = [(batch, found[0][1]) for batch, found in there if found]
        if snapshot is None or not there:
            return there
        have = self.spark.createDataFrame([(batch,) for batch, _ in there], "batch string")
        known = {r.batch for r in have.join(self._folded(snapshot), "batch", "left_semi").collect()}  # batches since the last compaction
        return [x for x in there if x[0] not in known]

    def committed(self, batch_id: str) -> bool:
        name = _name(batch_id)
        return bool(self._list(f"deltas/{name}")) or not self._folded(self._snapshot()).filter(F.col("batch") == name).isEmpty()

    def stage(self, changes: DataFrame) -> str:
        """A batch's sums, written where no reader looks."""
        staging = f"{self.root}/staging/{uuid.uuid4().hex}"
        signed(changes).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.parquet(staging)
        return staging

    def publish(self, batch_id: str, staging: str) -> bool:
        """Make a staged attempt visible; False where another one counts."""
        own = staging.rpartition("/")[2]
        if not common.rename(self.spark, staging, f"{self.root}/deltas/{_name(batch_id)}/{own}"):
            raise RuntimeError("the batch could not be published")
        first = self._list(f"deltas/{_name(batch_id)}")[0][1]
        return first == own and self._folded(self._snapshot()).filter(F.col("batch") == _name(batch_id)).isEmpty()

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch once; False where it had been applied before."""
        return False if self.committed(batch_id) else self.publish(batch_id, self.stage(changes))

    def _sums(self, snapshot: str | None, batches: list[tuple[str, str]]) -> DataFrame:
        parts = [f"{self.root}/deltas/{batch}/{attempt}" for batch, attempt in batches]
        if snapshot is not None:
            parts.append(f"{self.root}/snapshots/{snapshot}/totals")
        if not parts:
            return self.spark.createDataFrame([], _DELTA)
        rows = self.spark.read.schema(_DELTA).parquet(*parts)
        out = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return out.filter((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def totals(self) -> DataFrame:
        snapshot = self._snapshot()
        return self._sums(snapshot, self._open(snapshot))

    def compact(self) -> None:
        """Publish a generation that holds all batches now visible, then delete
        those of the generation before."""
        snapshot = self._snapshot()
        batches = self._open(snapshot)
        folded = self._folded(snapshot)
        fresh = f"{self.root}/staging/{uuid.uuid4().hex}"
        self._sums(snapshot, batches).coalesce(1).write.parquet(f"{fresh}/totals")
        folded.unionByName(self.spark.createDataFrame([(b,) for b, _ in batches], "batch string")).coalesce(1).write.parquet(f"{fresh}/batches")
        number = 1 + (int(snapshot.split("-")[0]) if snapshot else 0)
        if not common.rename(self.spark, fresh, f"{self.root}/snapshots/{number:012d}-{uuid.uuid4().hex}"):
            raise RuntimeError("the generation could not be published")
        old = {r.batch for r in folded.filter(F.col("batch").isin([b for _, b in self._list("deltas")])).collect()}
        for batch in old:
            common.remove(self.spark, f"{self.root}/deltas/{batch}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents after six batches: the table as inserts, the same
    again (which changes nothing), every count revised, the revisions taken back,
    every document deleted, and all inserted anew; with a compaction midway."""
    docs = common.table(spark, sf_dir, "documents")
    rows, path = common.stored(count_tokens(docs).withColumn("tokenizer_version", F.lit("byte_bpe_50k")), "token-counts")
    change = lambda op, new, old=None: rows.select(*KEYS, F.lit(op).alias("op"), new.alias("n_tokens"), (F.lit(None) if old is None else old).cast("long").alias("old_n_tokens"))
    n = F.col("n_tokens")
    rollup = TokenRollup(spark, common.shared_dir(spark, "token-rollup"))
    rollup.commit("inserts", change("insert", n))
    rollup.commit("inserts", change("insert", n))
    rollup.commit("revisions", change("revise", n + 1, n))
    rollup.commit("corrections", change("revise", n, n + 1))
    rollup.compact()
    rollup.commit("deletes", change("delete", n))
    rollup.commit("inserted anew", change("insert", n))
    common.remove(spark, path)
    return rollup.totals()


def brute(rows: list[dict], path: str | None = None) -> dict[tuple, tuple[int, int]]:
    """The same totals by a plain loop, for tests."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path or bpe.default_vocabulary())
    out: dict[tuple, np.ndarray] = {}
    for r in rows:
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        out[(r["source"], r["lang"])] = out.get((r["source"], r["lang"]), np.zeros(2, int)) + [1, n]
    return {k: tuple(v.tolist()) for k, v in out.items()}
