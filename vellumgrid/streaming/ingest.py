"""Streaming ingestion: files or tables that grow, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.config import Settings
from vellumgrid.operators import chunking
from vellumgrid.operators.store import TableStore

#: The states of an ingestion job, in order.
STATES = ["pending", "parsing", "chunking", "embedding", "indexing", "extracting", "populating", "completed"]


def document_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def ingest(stream: DataFrame, store: TableStore, checkpoint: str, settings: Settings = Settings(), chunker=chunking.chunks):
    """Start a query that upserts documents and their chunks, and a row a batch
    in ``ingestion_jobs``, which names the documents that failed. Upserts by key
    make a repeated batch harmless. A batch that fails is cut in halves, by the
    documents' hash, until the failing documents stand alone; the rest is stored."""

    def stored(rows: DataFrame) -> None:
        store.upsert("documents", rows.select(F.col("doc_id").cast("string"), "text"), "doc_id")
        store.upsert("chunks", chunker(chunking.sections(rows), settings), "chunk_id")

    def attempt(rows: DataFrame, bit: int = 0) -> list[tuple[str, str]]:
        """(doc_id, message) of the documents that failed."""
        try:
            stored(rows)
            return []
        except Exception as e:
            few = rows.select("doc_id").limit(2).collect()
            if len(few) < 2 or bit >= 60:
                return [(str(r.doc_id), str(e)[:500]) for r in few]
            half = F.shiftright(F.xxhash64("doc_id"), bit).bitwiseAND(F.lit(1).cast("long"))
            return attempt(rows.filter(half == 0), bit + 1) + attempt(rows.filter(half == 1), bit + 1)

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows = rows.dropDuplicates(["doc_id"]).persist()
        n = rows.count()
        bad = attempt(rows) if n else []
        state = STATES[-1] if not bad else "failed" if len(bad) == n else "completed with errors"
        error = "; ".join(f"{d}: {m}" for d, m in bad) or None
        store.upsert("ingestion_jobs", spark.createDataFrame([(f"batch-{number}", state, n, error)], "job_id string, status string, documents long, error string"), "job_id")
        rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_errors(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events and errors per window of a stream of (ts, event_type); later events than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("n"), F.sum((F.col("event_type") == "error").cast("long")).alias("errors"))


def job_status(log: DataFrame) -> DataFrame:
    """The latest state of each job of a log (job_id, state, at)."""
    return log.groupBy("job_id").agg(F.max_by("state", "at").alias("status"), F.max("at").alias("updated_at"), F.count("*").alias("n_changes"))
