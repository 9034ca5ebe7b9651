"""Queries of context, answers, stores, metrics and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.config import Settings
from vellumgrid.functions import text as T
from vellumgrid.operators import answer, graph, graph_retrieval, metrics, store
from vellumgrid.plans import base
from vellumgrid.plans.base import EDGES, ENTITIES, SENTENCE_LIST, TERMS
from vellumgrid.plans.retrieval import BM25_TOP, QUESTION, bm25_top
from vellumgrid.streaming.ingest import job_status

LIMIT = 1500


def context(s: SparkSession, d: str) -> DataFrame:
    """The context of the ten best chunks and the facts around one entity."""
    chunks = bm25_top(s, d).join(base.chunks(s, d), "chunk_id").select("rank", "chunk_id", "doc_id", "section", "breadcrumbs", "text")
    nodes = base.entities(s, d)
    name = nodes.filter("entity_id = 'part_0'").select("name").head().name
    e = graph_retrieval.retrieve(nodes, base.edges(s, d), base.chunks(s, d), [name], "integration", 1).edges
    f = graph.facts(e, nodes).select(F.col("rel_id").alias("ord"), "fact")
    out = answer.assembled(QUESTION, chunks, f, Settings(max_context_tokens=LIMIT))
    return out.select(F.md5("context_text").alias("context_md5"), "token_count", "n_chunks", F.size("citations").cast("long").alias("n_citations"), F.array_join(F.sort_array(F.map_keys("citations")), "|").alias("cited"))


CONTEXT = f"""WITH RECURSIVE {ENTITIES}, {EDGES}, best AS ({BM25_TOP.replace("WITH ", "WITH ", 1)}),
c AS (SELECT rank, chunk_id, chunk_id || ':' || source AS cite, '[' || chunk_id || ':' || source || '] (Corpus > ' || source || ')' || chr(10) || text || chr(10) || chr(10) AS piece
  FROM best JOIN documents ON chunk_id = CAST(doc_id AS VARCHAR)),
f AS (SELECT row_number() OVER (ORDER BY rel_id) AS i, a.canonical_name || ' ' || rel_type || ' ' || b.canonical_name AS fact FROM edg JOIN ent a ON src = a.entity_id JOIN ent b ON dst = b.entity_id
  WHERE rel_id IN (SELECT rel_id FROM (SELECT DISTINCT rel_id, CASE WHEN src IN (SELECT entity_id FROM ent WHERE name = z OR canonical_name = z) THEN src ELSE dst END AS near_, CASE WHEN src IN (SELECT entity_id FROM ent WHERE name = z OR canonical_name = z) THEN dst ELSE src END AS other
    FROM edg, (SELECT name AS z FROM ent WHERE entity_id = 'part_0') WHERE rel_type IN ('DEPENDS_ON', 'INTEGRATES_WITH') AND (src IN (SELECT entity_id FROM ent WHERE name = z OR canonical_name = z) OR dst IN (SELECT entity_id FROM ent WHERE name = z OR canonical_name = z)))
    ORDER BY near_, other, rel_id LIMIT 20)),
h AS (SELECT 'Query: {QUESTION}' || chr(10) || chr(10) || 'Knowledge Graph Facts:' || chr(10) || (SELECT string_agg(i || '. ' || fact || ' [' || (SELECT cite FROM c WHERE rank = 0) || ']' || chr(10), '' ORDER BY i) FROM f)
  || chr(10) || 'Relevant Document Excerpts:' || chr(10) || chr(10) AS head),
r AS (SELECT c.*, head, (len(head) + sum(len(piece)) OVER (ORDER BY rank)) // 4 AS used FROM c, h),
bad AS (SELECT coalesce(min(rank), 99) AS b FROM r WHERE used > {LIMIT}), k AS (SELECT * FROM r, bad WHERE rank < b)
SELECT md5(max(h.head) || coalesce(string_agg(piece, '' ORDER BY rank), '')) AS context_md5, CAST(len(max(h.head) || coalesce(string_agg(piece, '' ORDER BY rank), '')) // 4 AS BIGINT) AS token_count,
  count(k.chunk_id) AS n_chunks, CASE WHEN count(k.chunk_id) = 0 THEN 1 ELSE count(DISTINCT cite) END AS n_citations,
  CASE WHEN count(k.chunk_id) = 0 THEN (SELECT cite FROM c WHERE rank = 0) ELSE array_to_string(list_sort(list(DISTINCT cite)), '|') END AS cited FROM h LEFT JOIN k ON true"""


def _turns(s: SparkSession, d: str) -> DataFrame:
    """Assistant turns as answers, each row one; the user's texts of the turn before
    as context, the empty text where there is none."""
    c = base.table(s, d, "conversations")
    a = c.filter("role = 'assistant'").select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn", F.md5("text")).alias("answer_id"), F.col("text").alias("answer")).distinct()
    u = c.filter("role = 'user'").groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.array_join(F.sort_array(F.collect_list("text")), "\n").alias("context"))
    return a.join(u, ["conv_id", "turn"], "left").select("answer_id", "answer", F.coalesce("context", F.lit("")).alias("context"))


def claim_rows(s: SparkSession, d: str) -> DataFrame:
    """Claims of every answer."""
    rows = _turns(s, d).withColumn("claims", T.claims(F.col("answer")))
    return rows.select("answer_id", F.size("claims").cast("long").alias("n_claims"), F.md5(F.array_join("claims", "|")).alias("claims_md5"))


TURNS = """a AS (SELECT DISTINCT conv_id, turn, concat_ws('-', conv_id, turn, md5(text)) AS answer_id, text AS answer FROM conversations WHERE role = 'assistant'),
u AS (SELECT conv_id, turn + 1 AS turn, array_to_string(list_sort(list(text)), chr(10)) AS context FROM conversations WHERE role = 'user' GROUP BY ALL),
t AS (SELECT answer_id, answer, coalesce(context, '') AS context FROM a LEFT JOIN u ON a.conv_id = u.conv_id AND a.turn = u.turn),
cl AS (SELECT answer_id, context, list_filter(list_transform(regexp_split_to_array(regexp_replace(answer, '\\[[^\\]]+\\]', '', 'g'), '[.!?]+'), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13))), lambda x: len(x) > 10) AS claims FROM t)"""
CLAIMS = f"WITH {TURNS} SELECT answer_id, len(claims) AS n_claims, md5(array_to_string(claims, '|')) AS claims_md5 FROM cl"


def faithful(s: SparkSession, d: str) -> DataFrame:
    """Faithfulness of every answer to the turn before it."""
    return answer.faithfulness(_turns(s, d)).select("answer_id", "total_claims", "supported_claims", "faithfulness_score", "warnings")


FAITHFUL = f"""WITH {TURNS}, w AS (SELECT answer_id, {TERMS.format("left(context, 2000)")} AS held, unnest(claims) AS claim FROM cl),
v AS (SELECT answer_id, list_distinct({TERMS.format("claim")}) AS terms, held FROM w),
s AS (SELECT answer_id, count(*) FILTER (len(terms) > 0 AND len(list_filter(terms, lambda x: list_contains(held, x))) >= 0.5 * len(terms)) AS ok, count(*) AS n FROM v GROUP BY answer_id),
r AS (SELECT cl.answer_id, CAST(len(claims) AS BIGINT) AS total_claims, coalesce(ok, 0) AS supported_claims, CASE WHEN len(claims) = 0 THEN 1.0 ELSE round(CAST(coalesce(ok, 0) AS DOUBLE) / len(claims), 6) END AS faithfulness_score FROM cl LEFT JOIN s USING (answer_id))
SELECT answer_id, total_claims, supported_claims, CAST(faithfulness_score AS DOUBLE) AS faithfulness_score, concat_ws('; ', CASE WHEN faithfulness_score < 0.8 THEN 'low faithfulness score' END,
  CASE WHEN total_claims > supported_claims THEN (total_claims - supported_claims) || ' unsupported claims' END) AS warnings FROM r"""


def citations(s: SparkSession, d: str) -> DataFrame:
    """Valid citations of synthetic answers over all documents."""
    docs = base.table(s, d, "documents").select("doc_id", "source", "lang")
    own, other = F.concat_ws(":", F.col("doc_id").cast("string"), "source"), F.concat_ws(":", F.col("lang"), "source")
    text = F.concat(F.lit("See ["), own, F.lit("] and ["), other, F.lit("], again ["), own, F.lit("] but not [x] or [a:b:c]."))
    rows = docs.select("doc_id", text.alias("answer"), F.array(own, F.lit("other:1")).alias("context_citations"))
    out = answer.grounded(rows)
    return out.select("doc_id", F.array_join(T.citations(F.col("answer")), "|").alias("found"), F.array_join("citations_used", "|").alias("used"))


CITATIONS = "SELECT doc_id, doc_id || ':' || source || '|' || lang || ':' || source AS found, doc_id || ':' || source AS used FROM documents"


def extract_answer(s: SparkSession, d: str) -> DataFrame:
    """The offline generator's sentence for every user turn over its answer."""
    t = _turns(s, d)
    return t.select("answer_id", F.md5(answer.extractive(F.col("context"), F.col("answer"))).alias("answer_md5"))


EXTRACTED_ANSWERS = f"""WITH {TURNS}, se AS (SELECT answer_id, context, answer AS text FROM t), sl AS (SELECT answer_id, list_distinct({TERMS.format("context")}) AS asked, {SENTENCE_LIST} AS st FROM se),
each AS (SELECT answer_id, asked, unnest(st) AS s, unnest(generate_series(1, len(st))) AS i FROM sl WHERE len(st) > 0),
r AS (SELECT answer_id, s, row_number() OVER (PARTITION BY answer_id ORDER BY len(list_intersect(asked, list_distinct({TERMS.format("s")}))) DESC, i) AS o FROM each)
SELECT sl.answer_id, md5(r.s) AS answer_md5 FROM sl LEFT JOIN r ON sl.answer_id = r.answer_id AND o = 1"""


def upserts(s: SparkSession, d: str) -> DataFrame:
    """Customers updated from orders: status of the latest, balance kept."""
    c = base.table(s, d, "customer").select("c_custkey", "c_acctbal", F.col("c_mktsegment").alias("status"))
    o = base.table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"), F.lit(0.0).alias("c_acctbal"))
    return store.upsert(c, o, "c_custkey", keep=("c_acctbal",))


UPSERTS = """WITH o AS (SELECT o_custkey AS k, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY o_custkey)
SELECT coalesce(c_custkey, k) AS c_custkey, CASE WHEN c_custkey IS NULL THEN 0.0 ELSE c_acctbal END AS c_acctbal, coalesce(o.status, c_mktsegment) AS status FROM customer FULL JOIN o ON c_custkey = k"""


def deletes(s: SparkSession, d: str) -> DataFrame:
    """Toxic documents deleted, their vectors found missing or left over."""
    docs = base.table(s, d, "documents").select("doc_id", "source")
    vecs = base.table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    bad = base.table(s, d, "labels").filter("toxic = 1").select("doc_id")
    kept, left = store.delete_document(docs, vecs, bad)
    lost = store.missing(kept, left, "doc_id").withColumn("lost", F.lit(1))
    return kept.join(lost, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n_docs"), F.count("lost").alias("n_without_vector"))


DELETES = """WITH k AS (SELECT * FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id)), v AS (SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT source, count(*) AS n_docs, count(*) FILTER (doc_id NOT IN (SELECT vec_id FROM v)) AS n_without_vector FROM k GROUP BY source"""


def lookups(s: SparkSession, d: str) -> DataFrame:
    """Rows by key, by section, and counts."""
    c = base.chunks(s, d).withColumn("created_at", F.col("chunk_id"))
    part = lambda n, rows: rows.agg(F.lit(n).alias("lookup"), F.count("*").alias("n"), F.coalesce(F.min("chunk_id"), F.lit("")).alias("first"))
    return part("by_id", store.by_key(c, "chunk_id", "17")).unionByName(part("absent", store.by_key(c, "chunk_id", "none"))).unionByName(part("by_section", store.by_section(c, "17", "src17"))).unionByName(part("all", c))


LOOKUPS = """WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS k, source FROM documents)
SELECT 'by_id' AS lookup, count(*) AS n, coalesce(min(k), '') AS first FROM c WHERE k = '17' UNION ALL SELECT 'absent', count(*), coalesce(min(k), '') FROM c WHERE k = 'none'
UNION ALL SELECT 'by_section', count(*), coalesce(min(k), '') FROM c WHERE k = '17' AND source = 'src17' UNION ALL SELECT 'all', count(*), coalesce(min(k), '') FROM c"""


def histograms(s: SparkSession, d: str) -> DataFrame:
    """Duration histogram of every event type."""
    return metrics.histogram(base.table(s, d, "events"), "event_type", "value")


HISTOGRAMS = "SELECT event_type, count(value) AS n, round(sum(value), 4) AS total, " + ", ".join(f"CAST(count(*) FILTER (value <= {b}) AS BIGINT) AS le_{b.replace('.', '_')}" for b in ("0.1", "0.5", "1.0", "2.0", "5.0", "10.0", "30.0", "60.0")) + " FROM events GROUP BY event_type"


#: Bounds of the queries' histogram; an error of the percentile is under 5.
BOUNDS = [5.0 * k for k in range(1, 41)]


def windows(s: SparkSession, d: str) -> DataFrame:
    """Requests, errors and the histogram's 95th percentile in five-minute windows."""
    return metrics.windows(base.table(s, d, "events"), "5 minutes", 300, BOUNDS).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


PER_WINDOW = """g AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS st, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, list(value) FILTER (value IS NOT NULL) AS vs FROM events GROUP BY 1),
h AS (SELECT *, coalesce(len(vs), 0) AS nv, list_transform(generate_series(1, 40), lambda k: len(list_filter(vs, lambda v: v <= 5.0 * k))) AS cs FROM g),
i AS (SELECT *, len(list_filter(cs, lambda c: c < 0.95 * nv)) AS full_ FROM h),
w AS (SELECT st, n, errors, CASE WHEN full_ >= 40 THEN 200.0 ELSE 5.0 * full_ + 5.0 * (0.95 * nv - CASE WHEN full_ = 0 THEN 0 ELSE cs[full_] END) / (cs[full_ + 1] - CASE WHEN full_ = 0 THEN 0 ELSE cs[full_] END) END AS p FROM i)"""
WINDOWS = f"""WITH {PER_WINDOW} SELECT strftime(st, '%Y-%m-%d %H:%M:%S') AS start, n, errors, round(n / 300.0, 6) AS rate, round(errors / 300.0, 6) AS error_rate, round(CAST(errors AS DOUBLE) / n, 6) AS error_ratio, round(p, 6) AS p95 FROM w"""


def alerts(s: SparkSession, d: str) -> DataFrame:
    """A17, alert rules: windows in which a rule holds twice running, over midnight too."""
    w = metrics.windows(base.table(s, d, "events"), "5 minutes", 300, BOUNDS)
    rules = {"HighErrorShare": ("error_ratio", 0.2), "SlowQueries": ("p95", 90.0), "HighErrorRate": ("error_rate", 0.002)}
    return metrics.alerts(w, rules, 2, 5).select("alert", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"))


ALERTS = f"""WITH {PER_WINDOW}, m AS (SELECT st, round(errors / 300.0, 6) AS er, round(CAST(errors AS DOUBLE) / n, 6) AS ra, round(p, 6) AS p FROM w),
l AS (SELECT 'HighErrorShare' AS alert, st FROM m WHERE ra > 0.2 UNION ALL SELECT 'SlowQueries', st FROM m WHERE p > 90 UNION ALL SELECT 'HighErrorRate', st FROM m WHERE er > 0.002)
SELECT a.alert, strftime(a.st, '%Y-%m-%d %H:%M:%S') AS start FROM l a JOIN l b ON a.alert = b.alert AND a.st = b.st + INTERVAL 5 MINUTE"""


def advice(s: SparkSession, d: str) -> DataFrame:
    """Advice on tables often read whole; each user's events as a table's scans."""
    e = base.table(s, d, "events")
    usage = e.groupBy(F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("table_name")).agg((F.count("*") * 15).alias("seq_scan"), (F.sum("event_id") * 10).alias("seq_tup_read"))
    return metrics.index_advice(usage)


ADVICE = """WITH u AS (SELECT 't' || user_id AS table_name, count(*) * 15 AS seq_scan, CAST(sum(event_id) * 10 AS BIGINT) AS seq_tup_read FROM events GROUP BY user_id)
SELECT table_name, seq_scan, 'Table ' || table_name || ' has ' || seq_scan || ' sequential scans, averaging ' || (seq_tup_read // seq_scan) || ' rows; partition or sort it by its filtered columns' AS advice FROM u WHERE seq_scan > 100 AND seq_tup_read // seq_scan > 1000"""


def silent(s: SparkSession, d: str) -> DataFrame:
    """Ten-minute windows without a request."""
    w = metrics.windows(base.table(s, d, "events"), "10 minutes", 600, BOUNDS)
    return metrics.silent(w, 10).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"))


SILENT = """WITH w AS (SELECT DISTINCT time_bucket(INTERVAL 10 MINUTE, ts) AS st FROM events)
SELECT strftime(x, '%Y-%m-%d %H:%M:%S') AS start FROM (SELECT unnest(generate_series((SELECT min(st) FROM w), (SELECT max(st) FROM w), INTERVAL 10 MINUTE)) AS x) WHERE x NOT IN (SELECT st FROM w)"""


def jobs(s: SparkSession, d: str) -> DataFrame:
    """The latest state of every user's job, from the event log."""
    e = base.table(s, d, "events").select(F.col("user_id").cast("string").alias("job_id"), F.col("event_type").alias("state"), F.struct("ts", "event_id").alias("at"))
    return job_status(e).select("job_id", "status", "n_changes")


JOBS = "SELECT CAST(user_id AS VARCHAR) AS job_id, max_by(event_type, (ts, event_id)) AS status, count(*) AS n_changes FROM events GROUP BY user_id"


def batch_sizes(s: SparkSession, d: str) -> DataFrame:
    """The embedding batch of every source."""
    r = base.table(s, d, "documents").groupBy("source").agg(F.avg(F.length("text")).alias("m"))
    return r.select("source", T.batch_size(F.col("m")).cast("long").alias("batch"))


BATCH_SIZES = "SELECT source, CAST(CASE WHEN avg(len(text)) / 4 < 100 THEN 64 WHEN avg(len(text)) / 4 < 300 THEN 32 ELSE 16 END AS BIGINT) AS batch FROM documents GROUP BY source"

QUERIES = {
    "context_assembly": (context, CONTEXT), "claims": (claim_rows, CLAIMS), "faithfulness": (faithful, FAITHFUL), "citations": (citations, CITATIONS),
    "extractive_answer": (extract_answer, EXTRACTED_ANSWERS), "store_upsert": (upserts, UPSERTS), "store_delete": (deletes, DELETES), "store_lookup": (lookups, LOOKUPS),
    "metric_histograms": (histograms, HISTOGRAMS), "metric_windows": (windows, WINDOWS), "metric_alerts": (alerts, ALERTS), "index_advice": (advice, ADVICE), "silent_windows": (silent, SILENT),
    "job_status": (jobs, JOBS), "batch_sizes": (batch_sizes, BATCH_SIZES),
}
