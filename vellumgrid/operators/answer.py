"""Context for an answer, grounded answers, and how faithful they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumgrid.config import Settings
from vellumgrid.functions import text as T

MARGIN = 2000  # characters of context that an entailment check reads


def assembled(question: str, chunks: DataFrame, fact_rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row: context_text, citations (a map from doc:section to its chunk) and
    token_count. ``chunks`` (rank, chunk_id, doc_id, section, breadcrumbs, text)
    are the few ranked ones, ``fact_rows`` (ord, fact).

    The question and all facts stay; chunks follow in rank order until the whole
    would pass the token limit. Facts cite the first chunk; of chunks that share
    a citation the last one kept stands for it."""
    spark = chunks.sparkSession
    cite = F.concat_ws(":", "doc_id", "section")
    piece = F.concat(F.lit("["), cite, F.lit("] ("), "breadcrumbs", F.lit(")\n"), "text", F.lit("\n\n"))
    packed = chunks.select(F.struct("rank", "chunk_id", "doc_id", "section", "breadcrumbs", cite.alias("cite"), piece.alias("piece")).alias("c"))
    rows = packed.agg(F.array_sort(F.collect_list("c")).alias("cs")).crossJoin(fact_rows.agg(F.array_sort(F.collect_list(F.struct("ord", "fact"))).alias("fs")))
    first = F.get(F.col("cs"), F.lit(0))["cite"]
    lines = F.transform("fs", lambda f, i: F.concat((i + 1).cast("string"), F.lit(". "), f["fact"], F.coalesce(F.concat(F.lit(" ["), first, F.lit("]")), F.lit("")), F.lit("\n")))
    head = F.concat(F.lit(f"Query: {question}\n\n"), F.when(F.size("fs") > 0, F.concat(F.lit("Knowledge Graph Facts:\n"), F.array_join(lines, ""), F.lit("\n"))).otherwise(""), F.when(F.size("cs") > 0, "Relevant Document Excerpts:\n\n").otherwise(""))
    rows = rows.withColumn("head", head)
    start = F.struct(F.length("head").cast("long").alias("n"), F.lit(True).alias("open"), F.lit(0).alias("kept"))

    def step(acc: Column, c: Column) -> Column:
        n = acc["n"] + F.length(c["piece"])
        ok = acc["open"] & (F.floor(n / 4) <= settings.max_context_tokens)
        return F.struct(F.when(ok, n).otherwise(acc["n"]).alias("n"), ok.alias("open"), (acc["kept"] + F.when(ok, 1).otherwise(0)).alias("kept"))

    kept = F.slice("cs", F.lit(1), F.aggregate("cs", start, step)["kept"])
    rows = rows.withColumn("kept", F.when(F.size("cs") > 0, kept).otherwise(F.col("cs")))
    text = F.concat("head", F.array_join(F.transform("kept", lambda c: c["piece"]), ""))
    cited = F.when((F.size("fs") > 0) & (F.size("kept") == 0) & (F.size("cs") > 0), F.slice("cs", 1, 1)).otherwise(F.col("kept"))
    _ = spark
    keys = F.array_distinct(F.transform(cited, lambda c: c["cite"]))
    last = F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(cited, lambda c: c["cite"] == k), -1)["chunk_id"].alias("value")))
    return rows.select(text.alias("context_text"), F.map_from_entries(last).alias("citations"), T.token_count(text).alias("token_count"), F.size("kept").cast("long").alias("n_chunks"))


def grounded(answers: DataFrame) -> DataFrame:
    """Rows (answer, context_citations array) with the valid citations of the answer."""
    return answers.withColumn("citations_used", F.array_intersect(T.citations(F.col("answer")), F.col("context_citations")))


def extractive(question: Column, context: Column) -> Column:
    """Offline stand-in for a generator: the context's sentence that shares most terms with the question."""
    asked = F.array_distinct(T.bm25_tokens(question))
    ranked = F.transform(T.sentences(context), lambda s, i: F.struct(F.size(F.array_intersect(asked, F.array_distinct(T.bm25_tokens(s)))).alias("n"), (-i).alias("i"), s.alias("s")))
    return F.array_max(ranked)["s"]


def overlap_support(claim: Column, context: Column, least: float = 0.5) -> Column:
    """Offline stand-in for entailment: enough of the claim's terms are in the context's head."""
    terms = F.array_distinct(T.bm25_tokens(claim))
    held = F.array_intersect(terms, T.bm25_tokens(F.substring(context, 1, MARGIN)))
    return (F.size(terms) > 0) & (F.size(held) >= least * F.size(terms))


def faithfulness(answers: DataFrame, settings: Settings = Settings(), support=overlap_support) -> DataFrame:
    """Rows (answer_id, answer, context) with their claims' support; an answer
    without claims is faithful."""
    rows = answers.withColumn("claims", T.claims(F.col("answer")))
    rows = rows.withColumn("supported", F.size(F.filter("claims", lambda c: support(c, F.col("context")))).cast("long")).withColumn("total", F.size("claims").cast("long"))
    score = F.when(F.col("total") == 0, 1.0).otherwise(F.col("supported") / F.col("total"))
    low = F.when(score < settings.faithfulness_threshold, F.lit("low faithfulness score"))
    some = F.when(F.col("total") > F.col("supported"), F.concat((F.col("total") - F.col("supported")).cast("string"), F.lit(" unsupported claims")))
    return rows.select("answer_id", F.col("total").alias("total_claims"), F.col("supported").alias("supported_claims"), F.round(score, 6).alias("faithfulness_score"), F.concat_ws("; ", low, some).alias("warnings"))
