"""The two entry points: ingest documents, answer questions."""

from __future__ import annotations

import time
import uuid
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.config import EngineError, RetrievalError, Settings
from vellumgrid.functions import text as T
from vellumgrid.functions import vectors as V
from vellumgrid.operators import answer, chunking, entities, graph, graph_retrieval, retrieval
from vellumgrid.operators.store import TableStore
from vellumgrid.shipping import importable
from vellumgrid.streaming.ingest import STATES

_JOB = "job_id string, status string, parents long, children long, error string"
MODES = ("VECTOR", "GRAPH", "HYBRID")


def hashed_embedding(text: Column) -> Column:
    return V.hashed_terms(T.bm25_tokens(text), 64)


class Engine:
    """Tables under ``root`` and the models in use; the defaults run offline."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings = Settings(), embed=hashed_embedding, relevance=retrieval.lexical_relevance, generate=answer.extractive, support=answer.overlap_support, extract=entities.extract):
        self.spark, self.store, self.settings = importable(spark), TableStore(spark, root), settings
        self.embed, self.relevance, self.generate, self.support, self.extract = embed, relevance, generate, support, extract
        self.index = retrieval.KeywordIndex(spark, f"{root.rstrip('/')}/keywords")
        self.degraded: list[str] = []
        self._workers = ThreadPoolExecutor(1)  # ingestion rewrites shared tables: one job at a time

    def _has(self, name: str) -> bool:
        return self.store.has(name)

    def ingest(self, sections: DataFrame, job_id: str = "job", edges: DataFrame | None = None) -> DataFrame:
        """Store section rows (doc_id, title, section_id, heading, level, text):
        chunks, vectors, entities and edges, step by step; then the job's record.
        A failing step leaves the state it failed in and its message."""
        state, error = STATES[0], None
        try:
            state = "chunking"
            self.store.upsert("documents", sections.select("doc_id", "title").dropDuplicates(["doc_id"]), "doc_id")
            chunks = self.store.upsert("chunks", chunking.chunks(sections, self.settings), "chunk_id")
            fresh = chunks.join(sections.select("doc_id").distinct(), "doc_id", "left_semi")
            state = "embedding"
            self.store.upsert("embeddings", fresh.select("chunk_id", self.embed(F.col("text")).alias("embedding")), "chunk_id")
            state = "indexing"
            self.index.build(chunks)
            state = "extracting"
            self.store.upsert("entities", self.extract(fresh.select("chunk_id", "text")).dropDuplicates(["entity_id"]), "entity_id")
            state = "populating"
            known = self.store.read("entities")
            new = graph.mentions_edges(known, chunks)
            if edges is not None:
                new = new.unionByName(graph.valid_edges(edges, known))
            self.store.upsert("edges", new, "rel_id")
            state = STATES[-1]
        except Exception as e:
            state, error = f"failed in {state}", str(e)[:500]
        n = self.store.read("chunks").groupBy("chunk_type").count().collect() if self._has("chunks") else []  # two rows
        counts = {r.chunk_type: r["count"] for r in n}
        row = [(job_id, state, counts.get("parent", 0), counts.get("child", 0), error)]
        return self.store.upsert("ingestion_jobs", self.spark.createDataFrame(row, _JOB), "job_id").filter(F.col("job_id") == job_id)

    def submit(self, sections: DataFrame, job_id: str, edges: DataFrame | None = None) -> Future:
        """Ingest in the background: the job is pending until a worker takes it up;
        ``job`` tells its state at any time."""
        pending = [(job_id, STATES[0], 0, 0, None)]
        self.store.upsert("ingestion_jobs", self.spark.createDataFrame(pending, _JOB), "job_id")
        return self._workers.submit(self.ingest, sections, job_id, edges)

    def job(self, job_id: str) -> DataFrame:
        return self.store.read("ingestion_jobs").filter(F.col("job_id") == job_id)

    def _graph_side(self, names: list[str], pattern: str) -> tuple[DataFrame, DataFrame]:
        """Chunks and facts that the question's pattern retrieves."""
        nodes = self.store.read("entities")
        found = graph_retrieval.retrieve(nodes, self.store.read("edges"), self.store.read("chunks"), names, pattern, min(3, self.settings.max_depth))
        return found.chunks.distinct(), graph.facts(found.edges, nodes).select(F.col("rel_id").alias("ord"), "fact")

    def _keywords(self, question: str) -> DataFrame:
        """Scores from the keyword index; none where it is missing or broken, so that
        the answer rests on vectors alone."""
        try:
            scored = self.index.scores(question, self.settings)
            return retrieval.top(scored, self.settings.bm25_top_k)
        except Exception as e:
            self.degraded.append(f"keyword search left out: {str(e)[:200]}")
            return self.spark.createDataFrame([], "chunk_id string, score double, rank long")

    def query(self, question: str, mode: str | None = None) -> DataFrame:
        """The answer's row; the request goes to the log ``requests``, failures too."""
        begun, error = time.time(), None
        self.degraded.clear()
        try:
            return self._answer(question, mode)
        except Exception as e:
            error = f"{type(e).__name__}: {str(e)[:300]}"
            raise
        finally:
            row = [(uuid.uuid4().hex, question, mode, round(time.time() - begun, 3), "; ".join(self.degraded) or None, error)]
            self.store.append("requests", self.spark.createDataFrame(row, "request_id string, question string, mode string, seconds double, degraded string, error string"))

    def _answer(self, question: str, mode: str | None) -> DataFrame:
        """One row: answer, mode, pattern, context and its citations, those that
        the answer uses, and the faithfulness report."""
        question = question.strip()
        if not question:
            raise RetrievalError("the query is empty")
        if mode is not None and mode not in MODES:
            raise EngineError(f"unknown mode: {mode}")
        q = F.lit(question)
        route = self.spark.range(1).select(T.query_mode(q).alias("mode"), T.query_pattern(q).alias("pattern"), T.mentions(q).alias("names"), self.embed(q).alias("v")).head()
        mode, s = mode or route.mode, self.settings
        chunks = self.store.read("chunks")
        nothing = self.spark.createDataFrame([], "chunk_id string, score double")
        side, found, facts = nothing, self.spark.createDataFrame([], "chunk_id string"), self.spark.createDataFrame([], "ord string, fact string")
        if mode != "GRAPH":
            near = retrieval.top(retrieval.vector_scores(self.store.read("embeddings"), list(route.v)), s.vector_top_k, s.similarity_threshold)
            words = self._keywords(question)
            side = retrieval.reciprocal_ranks(near, words, s.rrf_k).select("chunk_id", "score").orderBy(F.desc("score"), "chunk_id").limit(s.top_k)
        if mode != "VECTOR":
            found, facts = self._graph_side(list(route.names), route.pattern)
        fused = retrieval.fused(mode, side, found, s).orderBy(F.desc("combined_score"), "chunk_id").limit(s.top_k)
        best = retrieval.reranked(chunks.join(fused, "chunk_id"), question, s.rerank_top_k, self.relevance)
        ranked = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "chunk_id", "doc_id", "section", "breadcrumbs", "text"))).alias("x"))
        ranked = ranked.select(F.posexplode("x").alias("rank", "c")).select(F.col("rank").cast("long"), "c.chunk_id", "c.doc_id", "c.section", "c.breadcrumbs", "c.text")
        context = answer.assembled(question, ranked, facts, s)
        body = F.regexp_replace("context_text", r"(?s)^.*?Relevant Document Excerpts:\n\n", "")
        cite = F.concat(F.lit(" ["), F.get(F.map_keys("citations"), F.lit(0)), F.lit("]"))
        said = context.withColumn("answer", F.concat(F.coalesce(self.generate(q, body), F.lit("")), F.coalesce(cite, F.lit(""))))
        said = answer.grounded(said.withColumn("context_citations", F.map_keys("citations"))).withColumn("answer_id", F.lit("0"))
        report = answer.faithfulness(said.select("answer_id", "answer", body.alias("context")), s, self.support)
        return said.join(report, "answer_id").select(
            "answer", F.lit(mode).alias("mode"), F.lit(route.pattern).alias("pattern"), "context_text", "citations", "citations_used", "token_count", "faithfulness_score", "warnings"
        )
