"""Keyword, vector and hybrid retrieval, fusion and reranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumgrid.config import RetrievalError, Settings
from vellumgrid.functions import text as T
from vellumgrid.functions import vectors as V
from vellumgrid.operators.durable import durable, spread
from vellumgrid.operators.store import TableStore


def _terms(chunks: DataFrame) -> DataFrame:
    body = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.coalesce("breadcrumbs", F.lit("")))
    return spread(chunks.select("chunk_id", "text", "breadcrumbs")).select("chunk_id", T.bm25_tokens(body).alias("terms"))


def postings(chunks: DataFrame) -> DataFrame:
    """chunk_id, term, tf and dl (the chunk's number of terms). A chunk lies in one
    partition, so its terms are counted there; nothing is shuffled."""
    # sorted terms: equal ones stand side by side, and a term's count is the distance to its next change
    rows = _terms(chunks).select("chunk_id", F.size("terms").cast("long").alias("dl"), F.array_sort("terms").alias("t"))
    ends = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: (i == F.size("t")) | (F.get("t", i) != F.get("t", i - 1)))
    rows = rows.filter("dl > 0").select("chunk_id", "dl", "t", ends.alias("ends"))
    each = F.transform("ends", lambda e, k: F.struct(F.get("t", e - 1).alias("term"), (e - F.when(k > 0, F.get("ends", k - 1)).otherwise(0)).cast("long").alias("tf")))
    return rows.select("chunk_id", "dl", F.explode(each).alias("p")).select("chunk_id", "p.term", "p.tf", "dl")


def corpus_statistics(chunks: DataFrame) -> DataFrame:
    """One row: n (chunks) and avgdl."""
    return _terms(chunks).agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("avgdl"))


class KeywordIndex:
    """Postings of a corpus in files: ``postings`` (term, chunk_id, tf, dl) in order
    of terms, so that a question's few terms read few row groups; ``lengths``, a
    row for each chunk; and ``statistics``, one row. Building replaces the folder's
    index by a version of its own; the newest whole one counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, TableStore(spark, root)

    def build(self, chunks: DataFrame) -> KeywordIndex:
        fresh = self.store.replace("terms", _terms(chunks).select("chunk_id", F.size("terms").cast("long").alias("dl"), "terms"))
        lengths = fresh.select("chunk_id", "dl")
        self.store.replace("statistics", lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).coalesce(1))
        rows = fresh.select("chunk_id", "dl", F.explode("terms").alias("term")).groupBy("term", "chunk_id", "dl").agg(F.count("*").alias("tf"))
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.store.replace("postings", rows.repartitionByRange(parts, "term", "chunk_id").sortWithinPartitions("term", "chunk_id"))
        for name in ("terms", "statistics", "postings"):
            self.store.prune(name)
        return self

    @property
    def exists(self) -> bool:
        return self.store.has("postings")

    def scores(self, question: str, settings: Settings = Settings(), include_zero: bool = False) -> DataFrame:
        """chunk_id and BM25 score of the chunks that hold a term of the question
        (of all chunks with ``include_zero``)."""
        asked = question_terms(self.spark, question)
        if not asked:
            return self.spark.createDataFrame([], "chunk_id string, score double")
        stats = self.store.read("statistics").head()
        times = F.create_map(*[F.lit(x) for t in dict.fromkeys(asked) for x in (t, asked.count(t))])
        held = self.store.read("postings").filter(F.col("term").isin(list(dict.fromkeys(asked))))
        df = held.groupBy("term").agg(F.count("*").alias("df"))  # a row a term
        norm = settings.k1 * (1 - settings.b + settings.b * F.col("dl") / stats.avgdl)
        weight = F.element_at(times, F.col("term")) * idf(F.lit(stats.n), F.col("df"), settings.idf) * F.col("tf") * (settings.k1 + 1) / (F.col("tf") + norm)
        out = held.join(F.broadcast(df), "term").groupBy("chunk_id").agg(F.round(F.sum(weight), 6).alias("score"))
        if include_zero:
            out = self.store.read("terms").select("chunk_id").join(out, "chunk_id", "left").select("chunk_id", F.coalesce("score", F.lit(0.0)).alias("score"))
        return out


def question_terms(spark: SparkSession, question: str) -> list[str]:
    if not question.strip():
        raise RetrievalError("the query is empty")
    return [r.t for r in spark.range(1).select(F.explode(T.bm25_tokens(F.lit(question))).alias("t")).collect()]


def idf(n: Column, df: Column, kind: str) -> Column:
    raw = F.log((n - df + 0.5) / (df + 0.5))
    return {"okapi": raw, "okapi_floor": F.greatest(raw, F.lit(0.01)), "plus1": F.log(1 + (n - df + 0.5) / (df + 0.5))}[kind]


def bm25_scores(chunks: DataFrame, question: str, settings: Settings = Settings(), include_zero: bool = False) -> DataFrame:
    """chunk_id and score of a table without an index: one pass over its texts, in
    which the question's few terms are counted inside the row."""
    spark = chunks.sparkSession
    asked = question_terms(spark, question)
    if not asked:
        return spark.createDataFrame([], "chunk_id string, score double")
    terms = list(dict.fromkeys(asked))
    held = lambda t: F.filter("terms", lambda x: x == F.lit(t))
    counts = [F.size(held(t)).alias(f"tf{k}") for k, t in enumerate(terms)]
    rows = durable(_terms(chunks).select("chunk_id", F.size("terms").alias("dl"), *counts))  # numbers only
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{k}") > 0).cast("long")).alias(f"df{k}") for k in range(len(terms))]).head()
    norm = settings.k1 * (1 - settings.b + settings.b * F.col("dl") / stats.avgdl)
    weight = [asked.count(t) * idf(F.lit(stats.n), F.lit(stats[f"df{k}"]), settings.idf) * F.col(f"tf{k}") * (settings.k1 + 1) / (F.col(f"tf{k}") + norm) for k, t in enumerate(terms)]
    held = reduce(lambda a, b: a | b, [F.col(f"tf{k}") > 0 for k in range(len(terms))])
    return (rows if include_zero else rows.filter(held)).select("chunk_id", F.round(reduce(lambda a, b: a + b, weight), 6).alias("score"))


def top(scored: DataFrame, k: int, least: float | None = None) -> DataFrame:
    """The k best rows by score, then chunk_id, with rank from 0. The sort runs
    on the k rows that each partition keeps."""
    rows = scored if least is None else scored.filter(F.col("score") >= least)
    best = rows.select("chunk_id", "score").orderBy(F.desc("score"), "chunk_id").limit(k)  # k rows
    return best.withColumn("rank", (F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")) - 1).cast("long"))


def vector_scores(vectors: DataFrame, question: list[float], where: dict | None = None) -> DataFrame:
    """chunk_id and cosine score of (chunk_id, embedding, ...) rows; equality
    filters apply before."""
    for name, value in (where or {}).items():
        vectors = vectors.filter(F.col(name) == value)
    if not question:
        raise RetrievalError("the query vector is empty")
    asked = F.array(*[F.lit(float(x)) for x in question])
    return vectors.select("chunk_id", F.round(V.cosine(F.col("embedding"), asked), 6).alias("score"))


def reciprocal_ranks(vector: DataFrame, keyword: DataFrame, k: int = 60) -> DataFrame:
    """Fused ranking of two (chunk_id, score, rank) lists; ranks from 0."""
    v = vector.select("chunk_id", F.col("score").alias("vector_score"), F.col("rank").alias("vr"))
    b = keyword.select("chunk_id", F.col("score").alias("bm25_score"), F.col("rank").alias("br"))
    both = v.join(b, "chunk_id", "full_outer")
    part = lambda c: F.coalesce(1 / (F.lit(float(k)) + F.col(c)), F.lit(0.0))
    source = F.when(F.col("vr").isNotNull() & F.col("br").isNotNull(), "vector+bm25").when(F.col("vr").isNotNull(), "vector").otherwise("bm25")
    return both.select(
        "chunk_id", F.round(part("vr") + part("br"), 6).alias("score"), source.alias("retrieval_source"),
        F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"),
    )


def weighted(vector_side: DataFrame, graph_side: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Union of the two sides' chunks; the vector side's score at its weight, and
    the graph's weight for a chunk that the graph found."""
    both = vector_side.select("chunk_id", "score").join(graph_side.select("chunk_id", F.lit(1.0).alias("g")).distinct(), "chunk_id", "full_outer")
    score = settings.vector_weight * F.coalesce("score", F.lit(0.0)) + settings.graph_weight * F.coalesce("g", F.lit(0.0))
    source = F.when(F.col("score").isNotNull() & F.col("g").isNotNull(), "vector+graph").when(F.col("g").isNotNull(), "graph").otherwise("vector")
    return both.select("chunk_id", F.round(score, 6).alias("combined_score"), source.alias("retrieval_source"))


def fused(mode: str, vector_side: DataFrame, graph_side: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Fusion by the query's mode."""
    if mode == "VECTOR":
        return vector_side.select("chunk_id", F.col("score").alias("combined_score"), F.lit("vector").alias("retrieval_source"))
    if mode == "GRAPH":
        return graph_side.select("chunk_id", F.lit(1.0).alias("combined_score"), F.lit("graph").alias("retrieval_source")).distinct()
    return weighted(vector_side, graph_side, settings)


def lexical_relevance(question: Column, text: Column) -> Column:
    """Offline stand-in for a cross-encoder: a logit from the share of the
    question's terms that the text holds."""
    asked, held = F.array_distinct(T.bm25_tokens(question)), F.array_distinct(T.bm25_tokens(text))
    return 6 * F.size(F.array_intersect(asked, held)) / F.greatest(F.size(asked), F.lit(1)) - 3


def reranked(chunks: DataFrame, question: str, k: int = 5, relevance=lexical_relevance) -> DataFrame:
    """The k chunks of highest sigmoid relevance; ``relevance`` maps two columns
    to a logit (a vectorised model function fits)."""
    score = F.round(T.sigmoid(relevance(F.lit(question), F.col("text"))), 6)
    return chunks.withColumn("score", score).orderBy(F.desc("score"), "chunk_id").limit(k)
