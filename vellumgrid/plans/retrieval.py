"""Queries of text, chunks and retrieval."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.config import Settings
from vellumgrid.functions import text as T
from vellumgrid.functions import vectors as V
from vellumgrid.operators import chunking, retrieval
from vellumgrid.operators.durable import shared
from vellumgrid.operators.store import TableStore, by_key
from vellumgrid.plans.base import CHUNKS, EVERY_MENTION, MENTIONED, SENTENCE_LIST, TERMS, chunks, keyword_index, table
from vellumgrid.sources import documents
from vellumgrid.sources.documents import page_sections

QUESTION = "Licensed under the Apache License of a worthless idiot"
WORDS = TERMS.format("text || ' ' || breadcrumbs")


def sentences(s: SparkSession, d: str) -> DataFrame:
    """Sentences of every document and their tokens."""
    rows = table(s, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("ord", "sentence"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(T.token_count(F.col("sentence"))).alias("n_tokens"), F.max(F.length("sentence")).cast("long").alias("longest"))


SENTENCES = r"""
SELECT doc_id, count(*) AS n_sentences, CAST(sum(len(x) // 4) AS BIGINT) AS n_tokens, CAST(max(len(x)) AS BIGINT) AS longest FROM (
  SELECT doc_id, trim(unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))), chr(32) || chr(9) || chr(10) || chr(13)) AS x FROM documents)
WHERE x <> '' GROUP BY doc_id"""


def parent_chunks(s: SparkSession, d: str) -> DataFrame:
    """Parent chunks of all documents."""
    return chunking.parents(chunking.sections(table(s, d, "documents"))).select("chunk_id", "doc_id", "breadcrumbs", "token_count", F.md5("text").alias("text_md5"))


PARENT_CHUNKS = rf"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS body, text,
  left(coalesce(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1], 'Untitled'), 100) AS title FROM documents WHERE text IS NOT NULL),
f AS (SELECT *, {SENTENCE_LIST} AS st FROM d),
n AS (SELECT *, list_transform(st, lambda x: len(x) // 4) AS ns FROM f),
k AS (SELECT *, CASE WHEN len(body) // 4 <= 2048 THEN body ELSE array_to_string(list_filter(st, lambda x, i: list_sum(ns[1:i]) <= 2048), ' ') END AS kept FROM n)
SELECT doc_id || '_s1_parent' AS chunk_id, doc_id, title || ' > Document Content' AS breadcrumbs, CAST(len(kept) // 4 AS BIGINT) AS token_count, md5(kept) AS text_md5 FROM k WHERE kept <> ''"""


def child_chunks(s: SparkSession, d: str) -> DataFrame:
    """Child chunks of all documents, at a size that makes several."""
    rows = chunking.children(chunking.sections(table(s, d, "documents")), Settings(child_size=128, overlap=30))
    return rows.select("chunk_id", "doc_id", "parent_chunk_id", "child_index", "token_count", F.md5("text").alias("text_md5"))


#: Children of at most 128 tokens that overlap by 30. ``bits`` are the parts of a long
#: sentence: pieces up to a comma, semicolon or colon, and the words of longer pieces after a mark.
CHILD_CHUNKS = rf"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, {SENTENCE_LIST} AS st FROM d),
o AS (SELECT doc_id, unnest(st) AS s, unnest(generate_series(1, len(st))) AS i FROM f WHERE len(st) > 0),
l AS (SELECT doc_id, i, s, flatten(list_transform(regexp_extract_all(s, '[^,;:]*[,;:]?'), lambda p: CASE WHEN len(p) // 4 > 128
    THEN list_concat([{{'k': 'f', 't': ''}}], list_transform(list_filter(regexp_split_to_array(p, '\s+'), lambda w: w <> ''), lambda w: {{'k': 'w', 't': w}})) ELSE [{{'k': 'p', 't': p}}] END)) AS bits
  FROM o WHERE len(s) // 4 > 128),
r AS (SELECT doc_id, i, list_reduce(list_concat([{{'done': CAST([] AS VARCHAR[]), 'now': '', 'k': '', 't': ''}}], list_transform(bits, lambda b: {{'done': CAST([] AS VARCHAR[]), 'now': '', 'k': b.k, 't': b.t}})),
    lambda a, b: {{
      'done': CASE WHEN (b.k = 'f' AND trim(a.now, chr(32) || chr(9) || chr(10) || chr(13)) <> '') OR (b.k = 'p' AND (len(a.now) + len(b.t)) // 4 > 128 AND trim(a.now, chr(32) || chr(9) || chr(10) || chr(13)) <> '')
          THEN list_append(a.done, trim(a.now, chr(32) || chr(9) || chr(10) || chr(13))) WHEN b.k = 'w' AND a.now <> '' AND (len(a.now) + 1 + len(b.t)) // 4 > 128 THEN list_append(a.done, a.now) ELSE a.done END,
      'now': CASE WHEN b.k = 'f' THEN '' WHEN b.k = 'w' THEN CASE WHEN a.now = '' OR (len(a.now) + 1 + len(b.t)) // 4 > 128 THEN b.t ELSE a.now || ' ' || b.t END
          WHEN (len(a.now) + len(b.t)) // 4 > 128 AND trim(a.now, chr(32) || chr(9) || chr(10) || chr(13)) <> '' THEN b.t ELSE a.now || b.t END,
      'k': b.k, 't': b.t}}) AS x FROM l),
c AS (SELECT doc_id, i, CASE WHEN trim(x.now, chr(32) || chr(9) || chr(10) || chr(13)) <> '' THEN list_append(x.done, trim(x.now, chr(32) || chr(9) || chr(10) || chr(13))) ELSE x.done END AS cut FROM r),
e AS (SELECT doc_id, list({{'done': CAST([] AS VARCHAR[]), 'now': CAST([] AS VARCHAR[]), 's': s, 'cut': cut}} ORDER BY i) AS es FROM o LEFT JOIN c USING (doc_id, i) GROUP BY doc_id),
g AS (SELECT doc_id, list_reduce(list_concat([{{'done': CAST([] AS VARCHAR[]), 'now': CAST([] AS VARCHAR[]), 's': '', 'cut': CAST(NULL AS VARCHAR[])}}], es), lambda a, b: {{
    'done': CASE WHEN len(b.s) // 4 > 128 THEN list_concat(CASE WHEN len(a.now) > 0 THEN list_append(a.done, array_to_string(a.now, ' ')) ELSE a.done END, b.cut)
        WHEN len(a.now) > 0 AND list_sum(list_transform(a.now, lambda y: len(y) // 4)) + len(b.s) // 4 > 128 THEN list_append(a.done, array_to_string(a.now, ' ')) ELSE a.done END,
    'now': CASE WHEN len(b.s) // 4 > 128 THEN CAST([] AS VARCHAR[])
        WHEN len(a.now) > 0 AND list_sum(list_transform(a.now, lambda y: len(y) // 4)) + len(b.s) // 4 > 128
          THEN list_append(list_filter(a.now, lambda y, j: list_sum(list_transform(a.now[j:], lambda z: len(z) // 4)) <= 30), b.s) ELSE list_append(a.now, b.s) END,
    's': b.s, 'cut': b.cut}}) AS x FROM e),
h AS (SELECT doc_id, CASE WHEN len(x.now) > 0 THEN list_append(x.done, array_to_string(x.now, ' ')) ELSE x.done END AS children FROM g),
k AS (SELECT doc_id, unnest(children) AS body, unnest(generate_series(0, len(children) - 1)) AS n FROM h WHERE len(children) > 0)
SELECT doc_id || '_s1_child_' || n AS chunk_id, doc_id, doc_id || '_s1_parent' AS parent_chunk_id, n AS child_index, CAST(len(body) // 4 AS BIGINT) AS token_count, md5(body) AS text_md5 FROM k"""


def term_counts(s: SparkSession, d: str) -> DataFrame:
    """Document frequency and count of every index term."""
    return retrieval.postings(chunks(s, d)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


TERM_COUNTS = f"WITH {CHUNKS}, w AS (SELECT chunk_id, unnest({WORDS}) AS term FROM chk) SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS cf FROM w GROUP BY term"


def corpus(s: SparkSession, d: str) -> DataFrame:
    """A10: chunks and mean length."""
    return retrieval.corpus_statistics(chunks(s, d)).select("n", F.round("avgdl", 6).alias("avgdl"))


CORPUS = f"WITH {CHUNKS} SELECT count(*) AS n, round(avg(len({WORDS})), 6) AS avgdl FROM chk"

SCORES = f"""{CHUNKS},
words AS (SELECT chunk_id, {WORDS} AS terms FROM chk), stats AS (SELECT count(*) AS n, avg(len(terms)) AS a FROM words),
q AS (SELECT DISTINCT unnest({TERMS.format("'" + QUESTION + "'")}) AS term),
tf AS (SELECT chunk_id, len(terms) AS dl, term, len(list_filter(terms, lambda x: x = term)) AS tf FROM words, q),
df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY term),
bm AS (SELECT chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 6) AS score
  FROM tf JOIN df USING (term), stats WHERE tf > 0 GROUP BY chunk_id)"""


def bm25(s: SparkSession, d: str) -> DataFrame:
    """BM25 score of every chunk that holds a term of the question."""
    return keyword_index(s, d).scores(QUESTION)


def bm25_top(s: SparkSession, d: str) -> DataFrame:
    """The ten best chunks (the flagship query)."""
    return retrieval.top(bm25(s, d), 10)


BM25_TOP = f"WITH {SCORES} SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) - 1 AS rank FROM bm ORDER BY score DESC, chunk_id LIMIT 10"


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding", "label")


def _question(s: SparkSession, d: str) -> list[float]:
    """The first vector as the question's: one row."""
    row = table(s, d, "embeddings").filter("vec_id = 0").select("embedding").head()
    return list(row.embedding)


def vector_top(s: SparkSession, d: str) -> DataFrame:
    """The hundred vectors nearest to vector 0."""
    return retrieval.top(retrieval.vector_scores(_vectors(s, d), _question(s, d)), 100)


COSINE = """vs AS (SELECT CAST(e.vec_id AS VARCHAR) AS chunk_id, e.label, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"""
VECTOR_TOP = f"WITH {COSINE} SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) - 1 AS rank FROM vs ORDER BY score DESC, chunk_id LIMIT 100"


def vector_filtered(s: SparkSession, d: str) -> DataFrame:
    """A payload filter before the search and a threshold on scores."""
    return retrieval.top(retrieval.vector_scores(_vectors(s, d), _question(s, d), {"label": 2}), 50, 0.1)


VECTOR_FILTERED = f"WITH {COSINE} SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) - 1 AS rank FROM vs WHERE label = 2 AND score >= 0.1 ORDER BY score DESC, chunk_id LIMIT 50"


def unit_vectors(s: SparkSession, d: str) -> DataFrame:
    """Vectors at unit length, with the sum and the norm of each."""
    u = table(s, d, "embeddings").select("vec_id", F.posexplode(V.normalised(F.col("embedding"))).alias("i", "x"))
    return u.groupBy("vec_id").agg(F.round(F.sqrt(F.sum(F.col("x") * F.col("x"))), 6).alias("norm"), F.round(F.sum("x"), 5).alias("total"))


UNIT_VECTORS = """WITH n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS l FROM embeddings)
SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: (x / l) * (x / l)))), 6) AS norm, round(list_sum(list_transform(v, lambda x: x / l)), 5) AS total FROM n"""


def hybrid(s: SparkSession, d: str) -> DataFrame:
    """Reciprocal rank fusion of the two hundreds."""
    return retrieval.reciprocal_ranks(vector_top(s, d), retrieval.top(bm25(s, d), 100))


BOTH = f"""{SCORES}, {COSINE},
vt AS (SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) - 1 AS r FROM vs ORDER BY score DESC, chunk_id LIMIT 100),
bt AS (SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) - 1 AS r FROM bm ORDER BY score DESC, chunk_id LIMIT 100),
rrf AS (SELECT coalesce(v.chunk_id, b.chunk_id) AS chunk_id, round(coalesce(1.0 / (60.0 + v.r), 0.0) + coalesce(1.0 / (60.0 + b.r), 0.0), 6) AS score,
  CASE WHEN v.r IS NOT NULL AND b.r IS NOT NULL THEN 'vector+bm25' WHEN v.r IS NOT NULL THEN 'vector' ELSE 'bm25' END AS retrieval_source,
  coalesce(v.score, 0.0) AS vector_score, coalesce(b.score, 0.0) AS bm25_score FROM vt v FULL JOIN bt b ON v.chunk_id = b.chunk_id)"""
HYBRID = f"WITH {BOTH} SELECT chunk_id, CAST(score AS DOUBLE) AS score, retrieval_source, CAST(vector_score AS DOUBLE) AS vector_score, CAST(bm25_score AS DOUBLE) AS bm25_score FROM rrf"


def fused_chunks(s: SparkSession, d: str) -> DataFrame:
    """Weighted fusion with chunks of the graph, then the fetch."""
    graph = table(s, d, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("chunk_id")).distinct()
    scored = retrieval.fused("HYBRID", hybrid(s, d).select("chunk_id", "score"), graph)
    return scored.join(chunks(s, d).select("chunk_id", "section"), "chunk_id").select("chunk_id", "section", "combined_score", "retrieval_source")


FUSED = f"""WITH {BOTH}, g AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS chunk_id FROM labels WHERE toxic = 1),
f AS (SELECT coalesce(r.chunk_id, g.chunk_id) AS chunk_id, CAST(round(0.6 * coalesce(r.score, 0.0) + 0.4 * (CASE WHEN g.chunk_id IS NULL THEN 0.0 ELSE 1.0 END), 6) AS DOUBLE) AS combined_score,
  CASE WHEN r.chunk_id IS NOT NULL AND g.chunk_id IS NOT NULL THEN 'vector+graph' WHEN g.chunk_id IS NOT NULL THEN 'graph' ELSE 'vector' END AS retrieval_source
  FROM rrf r FULL JOIN g ON r.chunk_id = g.chunk_id)
SELECT f.chunk_id, c.section, combined_score, retrieval_source FROM f JOIN chk c ON f.chunk_id = c.chunk_id"""


def rerank(s: SparkSession, d: str) -> DataFrame:
    """The five chunks of highest lexical relevance."""
    return retrieval.reranked(chunks(s, d), QUESTION).select("chunk_id", "section", "score")


RERANK = f"""WITH {CHUNKS}, q AS (SELECT list_distinct({TERMS.format("'" + QUESTION + "'")}) AS t)
SELECT chunk_id, section, round(1 / (1 + exp(-(6.0 * len(list_intersect(t, list_distinct({TERMS.format("text")}))) / len(t) - 3))), 6) AS score
FROM chk, q ORDER BY score DESC, chunk_id LIMIT 5"""


def questions(s: SparkSession, d: str) -> DataFrame:
    """Mentions, pattern and route of every user turn."""
    u = table(s, d, "conversations").filter("role = 'user'")
    names = T.mentions(F.col("text"))
    return u.select("conv_id", "turn", T.query_pattern(F.col("text")).alias("pattern"), F.size(names).cast("long").alias("n_mentions"), F.array_join(F.slice(names, 1, 3), "|").alias("first_mentions"), T.query_mode(F.col("text")).alias("mode"))


def _pattern_sql(low: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({low}, '{'|'.join(keys)}') THEN '{kind}'" for kind, keys in T.PATTERN_KEYWORDS.items()) + " ELSE 'general' END"


QUESTIONS = f"""WITH q AS (SELECT conv_id, turn, text, {EVERY_MENTION.format("text")} AS ev, {_pattern_sql("lower(text)")} AS pattern FROM conversations WHERE role = 'user'),
l AS (SELECT *, list_transform(ev, lambda x: lower(x)) AS lo FROM q), m AS (SELECT *, {MENTIONED} AS ms FROM l)
SELECT conv_id, turn, pattern, CAST(len(ms) AS BIGINT) AS n_mentions, array_to_string(ms[1:3], '|') AS first_mentions,
  CASE WHEN pattern IN ('dependency', 'integration', 'workflow', 'conflict') THEN 'GRAPH' WHEN pattern = 'general' AND len(ms) = 0 THEN 'VECTOR' ELSE 'HYBRID' END AS mode FROM m"""


def routed(s: SparkSession, d: str) -> DataFrame:
    """C4: routes of a model's JSON replies, made from the events' properties."""
    e = table(s, d, "events")
    mode = F.when(F.col("event_id") % 4 == 0, "vector").when(F.col("event_id") % 4 == 1, "GRAPH").when(F.col("event_id") % 4 == 2, "hybrid").otherwise("other")
    reply = F.concat(F.lit('Sure: {"mode": "'), mode, F.lit('", "confidence": '), (F.col("event_id") % 10 / 10).cast("string"), F.lit("} done"))
    return e.groupBy(T.routed_mode(F.when(F.col("event_id") % 13 > 0, reply).otherwise("no json")).alias("mode")).agg(F.count("*").alias("n"))


ROUTED = """SELECT CASE WHEN event_id % 13 = 0 OR event_id % 4 = 3 OR (event_id % 10) / 10 < 0.7 THEN 'HYBRID' WHEN event_id % 4 = 0 THEN 'VECTOR' WHEN event_id % 4 = 1 THEN 'GRAPH' ELSE 'HYBRID' END AS mode, count(*) AS n FROM events GROUP BY 1"""


def chunk_ids(s: SparkSession, d: str) -> DataFrame:
    """The vector store's key of every chunk."""
    return chunks(s, d).select("chunk_id", T.chunk_uuid(F.col("chunk_id")).alias("point_id"))


CHUNK_IDS = f"""WITH h AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, sha1(unhex('{T.DNS_NAMESPACE}') || encode(CAST(doc_id AS VARCHAR))) AS h FROM documents)
SELECT chunk_id, left(h, 8) || '-' || h[9:12] || '-5' || h[14:16] || '-' || '89ab'[(CAST('0x' || h[17] AS INTEGER) % 4) + 1] || h[18:20] || '-' || h[21:32] AS point_id FROM h"""


def names(s: SparkSession, d: str) -> DataFrame:
    """Canonical names and ids of suppliers, customers and parts."""
    raw = table(s, d, "part").select(F.concat("p_name", F.lit(" System")).alias("name")).union(table(s, d, "nation").select(F.concat("n_name", F.lit("  Module"))))
    raw = raw.union(table(s, d, "region").select("r_name")).distinct()
    canonical = T.normalise_name(F.col("name"))
    return raw.select("name", canonical.alias("canonical_name"), T.entity_id(canonical, F.lit("c1")).alias("entity_id"))


NAMES = r"""WITH raw AS (SELECT p_name || ' System' AS name FROM part UNION SELECT n_name || '  Module' FROM nation UNION SELECT r_name FROM region),
a AS (SELECT name, regexp_replace(trim(name), '\s+', ' ', 'g') AS one FROM raw),
b AS (SELECT name, one, string_split(one, ' ')[1] AS head, regexp_replace(one, ' (System|Module|Service|Application|Process|Workflow|Rule|Field)$', '') AS base FROM a),
c AS (SELECT name, CASE WHEN len(one) <= 6 AND one = upper(one) AND regexp_matches(one, '\p{L}') THEN one
  WHEN len(head) <= 6 AND head = upper(head) AND regexp_matches(head, '\p{L}') THEN head
  WHEN contains(base, ' ') THEN array_to_string(list_transform(string_split(base, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') ELSE base END AS canonical_name FROM b)
SELECT name, canonical_name, 'ent_' || left(sha256(lower(canonical_name)), 8) || '_c1' AS entity_id FROM c"""


def event_properties(s: SparkSession, d: str) -> DataFrame:
    """JSON out of free text, leniently; totals per type."""
    e = table(s, d, "events")
    text = F.concat(F.lit("```json\n"), "props", F.lit("\n``` done"))
    k = F.from_json(T.fenced_json(text), "k long")["k"]
    return e.groupBy("event_type").agg(F.count(k).alias("n_parsed"), F.sum(k).alias("total"), F.max(k).alias("largest"))


EVENT_PROPERTIES = """SELECT event_type, count(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS n_parsed, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total,
max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS largest FROM events GROUP BY event_type"""


def web_pages(s: SparkSession, d: str) -> DataFrame:
    """Titles and headings of all web pages."""
    p = page_sections(table(s, d, "pages"))
    return p.select("doc_id", "title", F.size("headings").cast("long").alias("n_headings"), F.coalesce(F.get("headings", F.lit(0)), F.lit("")).alias("first_heading"))


WEB_PAGES = r"""WITH c AS (SELECT CAST(page_id AS VARCHAR) AS doc_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS title,
  regexp_extract_all(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1) AS h FROM pages)
SELECT doc_id, title, len(h) AS n_headings, coalesce(trim(regexp_replace(regexp_replace(h[1], '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), '') AS first_heading FROM c"""


def _files(s: SparkSession, d: str) -> DataFrame:
    """Documents as files: even ids .docx, whose first line is a heading for every
    fourth id and then each fourth line; the others .pdf, ten lines a page; every
    fifth id of a kind that isn't read."""
    rows = table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(frames):
        for frame in frames:
            out = []
            for k, text in zip(frame["doc_id"], frame["text"], strict=True):
                lines = [x for x in text.split("\n") if x.strip()]
                if k % 5 == 4:
                    out.append((f"/in/{k}.txt", b""))
                elif k % 2 == 0:
                    styles = ["Heading 1" if i == 0 and k % 4 == 0 else "Heading 2" if i % 4 == 3 else "Normal" for i in range(len(lines))]
                    out.append((f"/in/{k}.docx", documents.docx_bytes(list(zip(styles, lines, strict=True)))))
                else:
                    out.append((f"/in/{k}.pdf", documents.pdf_bytes([lines[i : i + 10] for i in range(0, len(lines), 10)])))
            yield pd.DataFrame(out, columns=["path", "content"])

    return rows.mapInPandas(run, "path string, content binary")


def parsed_files(s: SparkSession, d: str) -> DataFrame:
    """Files of two kinds parsed to titles and sections, others told as errors."""
    p = documents.parsed(_files(s, d))
    heads = F.transform("sections", lambda x: F.concat(x["section_id"], F.lit(":"), x["level"].cast("string"), F.lit(":"), x["heading"], F.lit("="), x["text"]))
    return p.select("doc_id", "title", F.size("sections").cast("long").alias("n_sections"), F.md5(F.array_join(heads, "|")).alias("sections_md5"), F.col("error").isNotNull().alias("failed"))


PARSED_FILES = r"""WITH d AS (SELECT doc_id, list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13)) <> ''), lambda x: trim(x, chr(32) || chr(9) || chr(13))) AS ls FROM documents),
w AS (SELECT doc_id, ls, unnest(ls) AS line, unnest(generate_series(0, len(ls) - 1)) AS i FROM d WHERE doc_id % 5 <> 4 AND len(ls) > 0),
dx AS (SELECT doc_id, line, i, CASE WHEN i = 0 AND doc_id % 4 = 0 THEN 1 WHEN i % 4 = 3 THEN 2 ELSE 0 END AS lv FROM w WHERE doc_id % 2 = 0),
dn AS (SELECT *, sum(CASE WHEN lv > 0 OR i = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM dx),
ds AS (SELECT doc_id, sec, max(lv) AS lv, max(CASE WHEN lv > 0 THEN line END) AS head, coalesce(string_agg(CASE WHEN lv = 0 THEN line END, chr(10) ORDER BY i), '') AS body FROM dn GROUP BY doc_id, sec),
dr AS (SELECT doc_id, count(*) AS n, md5(string_agg('s' || sec || ':' || CASE WHEN lv = 0 THEN 1 ELSE lv END || ':' || coalesce(head, 'Introduction') || '=' || body, '|' ORDER BY sec)) AS m FROM ds GROUP BY doc_id),
px AS (SELECT doc_id, i // 10 AS pg, i, regexp_replace(line, '[^\x{00}-\x{ff}]', '?', 'g') AS line FROM w WHERE doc_id % 2 = 1),
pp AS (SELECT doc_id, pg, string_agg(line, chr(10) ORDER BY i) AS body FROM px GROUP BY doc_id, pg),
pr AS (SELECT doc_id, count(*) AS n, md5(string_agg('s' || (pg + 1) || ':1:Page ' || (pg + 1) || '=' || body, '|' ORDER BY pg)) AS m, left(string_split(min_by(body, pg), chr(10))[1], 100) AS title FROM pp GROUP BY doc_id)
SELECT CAST(d.doc_id AS VARCHAR) AS doc_id,
  CASE WHEN d.doc_id % 5 = 4 THEN NULL WHEN d.doc_id % 2 = 1 THEN pr.title WHEN len(ls) = 0 THEN CAST(d.doc_id AS VARCHAR) WHEN d.doc_id % 4 = 0 THEN ls[1] ELSE left(ls[1], 100) END AS title,
  CASE WHEN d.doc_id % 5 = 4 THEN NULL WHEN d.doc_id % 2 = 1 THEN pr.n ELSE coalesce(dr.n, 0) END AS n_sections,
  CASE WHEN d.doc_id % 5 = 4 THEN NULL WHEN d.doc_id % 2 = 1 THEN pr.m ELSE coalesce(dr.m, md5('')) END AS sections_md5,
  d.doc_id % 5 = 4 OR (d.doc_id % 2 = 1 AND pr.n IS NULL) AS failed
FROM d LEFT JOIN dr ON d.doc_id = dr.doc_id LEFT JOIN pr ON d.doc_id = pr.doc_id"""


def vector_store(s: SparkSession, d: str) -> DataFrame:
    """Vectors upserted, read by key, counted and deleted, in a stored table."""
    rows = _vectors(s, d)
    held = TableStore(s, shared(s, "vector-store"))
    held.replace("embeddings", rows)
    changed = rows.filter("label = 3").select("chunk_id", F.transform("embedding", lambda x: x * 2).alias("embedding"), F.lit(99).alias("label"))
    fresh = rows.filter("label = 4").withColumn("chunk_id", F.concat(F.lit("new"), "chunk_id"))
    held.upsert("embeddings", changed.unionByName(fresh), "chunk_id")
    held.delete("embeddings", rows.filter("label = 5").select("chunk_id"), "chunk_id")
    now = held.read("embeddings")
    one = lambda name, part: part.agg(F.lit(name).alias("lookup"), F.count("*").alias("n"), F.round(F.sum(F.get("embedding", F.lit(0)).cast("double")), 3).alias("total"))
    return one("count", now).unionByName(one("by_key", by_key(now, "chunk_id", "17"))).unionByName(one("by_label", now.filter("label = 99")))


VECTOR_STORE = """WITH v AS (SELECT CAST(vec_id AS VARCHAR) AS k, CAST(embedding[1] AS DOUBLE) AS x, label FROM embeddings),
n AS (SELECT k, CASE WHEN label = 3 THEN 2 * x ELSE x END AS x, CASE WHEN label = 3 THEN 99 ELSE label END AS label FROM v WHERE label <> 5 UNION ALL SELECT 'new' || k, x, label FROM v WHERE label = 4)
SELECT 'count' AS lookup, count(*) AS n, round(sum(x), 3) AS total FROM n UNION ALL SELECT 'by_key', count(*), round(sum(x), 3) FROM n WHERE k = '17' UNION ALL SELECT 'by_label', count(*), round(sum(x), 3) FROM n WHERE label = 99"""

QUERIES = {
    "sentences": (sentences, SENTENCES), "parent_chunks": (parent_chunks, PARENT_CHUNKS), "child_chunks": (child_chunks, CHILD_CHUNKS), "term_counts": (term_counts, TERM_COUNTS),
    "corpus_statistics": (corpus, CORPUS), "bm25_scores": (bm25, f"WITH {SCORES} SELECT chunk_id, score FROM bm"), "bm25_top": (bm25_top, BM25_TOP),
    "vector_top": (vector_top, VECTOR_TOP), "vector_filtered": (vector_filtered, VECTOR_FILTERED), "unit_vectors": (unit_vectors, UNIT_VECTORS),
    "hybrid_rrf": (hybrid, HYBRID), "weighted_fusion": (fused_chunks, FUSED), "rerank": (rerank, RERANK), "question_routing": (questions, QUESTIONS), "reply_routing": (routed, ROUTED), "chunk_keys": (chunk_ids, CHUNK_IDS),
    "entity_names": (names, NAMES), "event_properties": (event_properties, EVENT_PROPERTIES), "web_pages": (web_pages, WEB_PAGES), "parsed_files": (parsed_files, PARSED_FILES), "vector_store": (vector_store, VECTOR_STORE),
}
