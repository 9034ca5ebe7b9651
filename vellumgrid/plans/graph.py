"""Queries of the property graph, entities, conflicts and rules."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.functions import text as T
from vellumgrid.operators import conflicts, entities, graph, graph_retrieval
from vellumgrid.plans import base
from vellumgrid.plans.base import CANONICAL, EDGES, ENTITIES, EVERY_MENTION, MENTIONED, SENTENCE_LIST, trail_sql

GRAPH = f"WITH RECURSIVE {ENTITIES}, {EDGES}"
ANY = "'DEPENDS_ON', 'INTEGRATES_WITH', 'NEXT_STEP', 'APPLIES_TO', 'SAME_AS'"
BOTH_WAYS = "both_ways AS (SELECT rel_id, rel_type, src, dst FROM edg UNION ALL SELECT rel_id, rel_type, dst, src FROM edg WHERE src <> dst)"
TURNED = "turned AS (SELECT rel_id, rel_type, dst AS src, src AS dst FROM edg)"


def _seeds(s: SparkSession, d: str, kind: str | None = None) -> DataFrame:
    e = base.entities(s, d)
    return (e if kind is None else e.filter(F.col("entity_type") == kind)).select(F.col("entity_id").alias("id"))


def _path(rows: DataFrame) -> DataFrame:
    return rows.withColumn("path", F.array_join("nodes", ">"))


def edge_tables(s: SparkSession, d: str) -> DataFrame:
    """Valid edges by type."""
    held = graph.valid_edges(base.edges(s, d), base.entities(s, d))
    return held.groupBy("rel_type").agg(F.count("*").alias("n"), F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst"))


EDGE_TABLES = f"{GRAPH} SELECT rel_type, count(*) AS n, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst FROM edg GROUP BY rel_type"


def mention_edges(s: SparkSession, d: str) -> DataFrame:
    """Chunks that mention entities, by type."""
    ents = base.entities(s, d)
    m = graph.mentions_edges(ents, base.chunks(s, d)).join(ents.select(F.col("entity_id").alias("dst"), "entity_type"), "dst")
    return m.groupBy(F.col("src").alias("chunk_id")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("entity_type")), ",").alias("types"))


MENTION_EDGES = f"""{GRAPH} SELECT source_chunk_id AS chunk_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT entity_type)), ',') AS types
FROM ent SEMI JOIN documents ON CAST(documents.doc_id AS VARCHAR) = ent.source_chunk_id GROUP BY source_chunk_id"""


def structure(s: SparkSession, d: str) -> DataFrame:
    """Structure edges of all chunks, by type."""
    c = base.chunks(s, d).withColumn("parent_chunk_id", F.lit(None).cast("string"))
    return graph.structure_edges(c).groupBy("rel_type").agg(F.count("*").alias("n"), F.countDistinct("src").alias("n_src"))


STRUCTURE = """WITH e AS (SELECT DISTINCT 'CONTAINS' AS rel_type, CAST(doc_id AS VARCHAR) AS src, doc_id || '_' || replace(source, ' ', '_') AS dst FROM documents
UNION ALL SELECT DISTINCT 'HAS_CHUNK', doc_id || '_' || replace(source, ' ', '_'), CAST(doc_id AS VARCHAR) FROM documents)
SELECT rel_type, count(*) AS n, count(DISTINCT src) AS n_src FROM e GROUP BY rel_type"""


def dependency_paths(s: SparkSession, d: str) -> DataFrame:
    """Forward and backward dependency trails of all systems."""
    return _path(graph.dependencies(base.edges(s, d), _seeds(s, d, "System"), 3)).select("start", "end", "direction", "len", "path")


DEPENDENCY_PATHS = f"""{GRAPH}, seeds AS (SELECT entity_id AS id FROM ent WHERE entity_type = 'System'),
turned AS (SELECT rel_id, rel_type, dst AS src, src AS dst FROM edg), {trail_sql(3, "f", "edg", "seeds", "'DEPENDS_ON'")}, {trail_sql(3, "b", "turned", "seeds", "'DEPENDS_ON'")}
SELECT start, tip AS "end", 'forward' AS direction, len(rels) AS len, array_to_string(nodes, '>') AS path FROM f WHERE len(rels) > 0
UNION ALL SELECT start, tip, 'backward', len(rels), array_to_string(nodes, '>') FROM b WHERE len(rels) > 0"""


def impact(s: SparkSession, d: str) -> DataFrame:
    """Impact radius of every entity."""
    return graph.impact_radius(base.edges(s, d), _seeds(s, d), 3)


IMPACT = f"""{GRAPH}, seeds AS (SELECT entity_id AS id FROM ent), turned AS (SELECT rel_id, rel_type, dst AS src, src AS dst FROM edg),
{trail_sql(3, "f", "edg", "seeds", "'DEPENDS_ON'")}, {trail_sql(3, "b", "turned", "seeds", "'DEPENDS_ON'")}
SELECT start AS id, count(DISTINCT tip) AS impact_radius FROM (SELECT start, tip FROM f UNION ALL SELECT start, tip FROM b) GROUP BY start"""


def cycles(s: SparkSession, d: str) -> DataFrame:
    """Circular dependencies of every entity."""
    return graph.cycles(base.edges(s, d), _seeds(s, d), 4).select("start", F.array_join("cycle", ">").alias("cycle"))


CYCLES = f"""{GRAPH}, seeds AS (SELECT entity_id AS id FROM ent), {trail_sql(4, "f", "edg", "seeds", "'DEPENDS_ON'")},
c AS (SELECT start, list_filter(nodes, lambda x, i: list_position(nodes, x) = i) AS u FROM f WHERE len(rels) > 0 AND start = tip)
SELECT DISTINCT start, array_to_string(u, '>') AS cycle FROM c WHERE len(u) > 1"""


def integration(s: SparkSession, d: str) -> DataFrame:
    """The shortest paths between two parts."""
    return _path(graph.integration_paths(base.edges(s, d), "part_0", "part_10", 4)).select("len", "path")


INTEGRATION = f"""{GRAPH}, seeds AS (SELECT 'part_0' AS id), both_ways AS (SELECT rel_id, rel_type, src, dst FROM edg UNION ALL SELECT rel_id, rel_type, dst, src FROM edg WHERE src <> dst),
{trail_sql(4, "f", "both_ways", "seeds", "'DEPENDS_ON', 'INTEGRATES_WITH'")}
SELECT len(rels) AS len, array_to_string(nodes, '>') AS path FROM f WHERE tip = 'part_10' AND len(rels) > 0 ORDER BY len(rels), nodes, rels LIMIT 10"""


def neighbours(s: SparkSession, d: str) -> DataFrame:
    """Neighbours of every entity over edges of any type."""
    return graph.near_counts(base.grouped_edges(s, d), _seeds(s, d))


NEIGHBOURS = f"""{GRAPH}, seeds AS (SELECT entity_id AS id FROM ent), both_ways AS (SELECT rel_id, rel_type, src, dst FROM edg UNION ALL SELECT rel_id, rel_type, dst, src FROM edg WHERE src <> dst),
{trail_sql(2, "f", "both_ways", "seeds", ANY)}
SELECT start, count(DISTINCT tip) AS n_near, count(*) AS n_paths FROM f WHERE len(rels) > 0 AND start <> tip GROUP BY start"""


def chains(s: SparkSession, d: str) -> DataFrame:
    """Process chains of all workflows."""
    c = graph.process_chains(base.edges(s, d), _seeds(s, d, "Workflow"))
    return c.select("workflow", F.array_join("path", ">").alias("path"), "branches", "complete")


CHAINS = f"""{GRAPH}, nx AS (SELECT src, dst FROM edg WHERE rel_type = 'NEXT_STEP'), deg AS (SELECT src, count(*) AS o FROM nx GROUP BY src),
w AS (SELECT entity_id AS workflow, entity_id AS tip, [entity_id] AS path FROM ent WHERE entity_type = 'Workflow'
  UNION ALL SELECT w.workflow, n.dst, list_append(w.path, n.dst) FROM w JOIN nx n ON w.tip = n.src WHERE len(w.path) < 20 AND NOT list_contains(w.path, n.dst)),
leaf AS (SELECT w.* FROM w ANTI JOIN nx ON w.tip = nx.src)
SELECT workflow, array_to_string(path, '>') AS path, (SELECT count(*) FROM (SELECT unnest(path) AS p) JOIN deg ON deg.src = p WHERE o > 1) AS branches, true AS complete FROM leaf"""


def gaps(s: SparkSession, d: str) -> DataFrame:
    """Gaps of all workflows' chains."""
    e, w = base.edges(s, d), _seeds(s, d, "Workflow")
    return graph.process_gaps(graph.process_chains(e, w), e, w)


GAPS = f"{GRAPH} SELECT entity_id AS workflow, 'workflow has no steps' AS gap FROM ent WHERE entity_type = 'Workflow' AND entity_id NOT IN (SELECT src FROM edg WHERE rel_type = 'NEXT_STEP')"


def fact_rows(s: SparkSession, d: str) -> DataFrame:
    """A fact for every edge."""
    return graph.facts(base.edges(s, d), base.entities(s, d))


FACTS = f"{GRAPH} SELECT rel_id, a.canonical_name || ' ' || rel_type || ' ' || b.canonical_name AS fact FROM edg JOIN ent a ON src = a.entity_id JOIN ent b ON dst = b.entity_id"


def path_assembly(s: SparkSession, d: str) -> DataFrame:
    """Nodes, relationships and chunks of the integration paths."""
    e = base.edges(s, d)
    nodes, rels, chunks = graph.path_parts(graph.integration_paths(e, "part_0", "part_10", 4), base.entities(s, d), e)
    part = lambda kind, rows, c: rows.select(F.lit(kind).alias("part"), F.col(c).alias("id"))
    return part("node", nodes, "entity_id").unionByName(part("edge", rels, "rel_id")).unionByName(part("chunk", chunks, "chunk_id"))


PATH_ASSEMBLY = f"""{GRAPH}, seeds AS (SELECT 'part_0' AS id), both_ways AS (SELECT rel_id, rel_type, src, dst FROM edg UNION ALL SELECT rel_id, rel_type, dst, src FROM edg WHERE src <> dst),
{trail_sql(4, "f", "both_ways", "seeds", "'DEPENDS_ON', 'INTEGRATES_WITH'")}, p AS (SELECT nodes, rels FROM f WHERE tip = 'part_10' AND len(rels) > 0 ORDER BY len(rels), nodes, rels LIMIT 10),
n AS (SELECT DISTINCT unnest(nodes) AS id FROM p)
SELECT 'node' AS part, id FROM n UNION ALL SELECT 'edge', x FROM (SELECT DISTINCT unnest(rels) AS x FROM p) UNION ALL SELECT 'chunk', x FROM (SELECT DISTINCT source_chunk_id AS x FROM ent JOIN n ON ent.entity_id = n.id)"""


def type_counts(s: SparkSession, d: str) -> DataFrame:
    """Entities by type, with predicates on chunk and name."""
    e = base.entities(s, d)
    return e.groupBy("entity_type").agg(F.count("*").alias("n"), F.count_if(F.startswith("source_chunk_id", F.lit("1"))).alias("n_prefix"), F.count_if(F.contains("name", F.lit("ring"))).alias("n_ring"), F.countDistinct("canonical_name").alias("n_canonical"))


TYPE_COUNTS = f"{GRAPH} SELECT entity_type, count(*) AS n, count(*) FILTER (starts_with(source_chunk_id, '1')) AS n_prefix, count(*) FILTER (contains(name, 'ring')) AS n_ring, count(DISTINCT canonical_name) AS n_canonical FROM ent GROUP BY entity_type"


def extracted(s: SparkSession, d: str) -> DataFrame:
    """Typed names extracted from every document's whole text, with
    the sentence of each, by canonical name."""
    e = entities.extract(base.chunks(s, d).select("chunk_id", "text"))
    return e.groupBy("canonical_name", "entity_type").agg(
        F.countDistinct("source_chunk_id").alias("n_chunks"), F.countDistinct("name").alias("n_names"), F.sum(F.length("context")).alias("context_chars"), F.countDistinct("entity_id").alias("n_ids")
    )


EXTRACTED = rf"""WITH m1 AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, text, {EVERY_MENTION.format("text")} AS ev FROM documents WHERE text IS NOT NULL),
m2 AS (SELECT *, list_transform(ev, lambda x: lower(x)) AS lo FROM m1), m AS (SELECT chunk_id, text, {MENTIONED} AS ms FROM m2),
sp AS (SELECT chunk_id, text, unnest(ms) AS name, 'System' AS label FROM m
  UNION ALL SELECT chunk_id, text, unnest(list_distinct(regexp_extract_all(text, '{entities.LABELLED["MONEY"]}'))), 'Field' FROM m
  UNION ALL SELECT chunk_id, text, unnest(list_distinct(regexp_extract_all(text, '{entities.LABELLED["DATE"]}'))), 'Field' FROM m),
raw AS (SELECT * FROM sp WHERE trim(name) <> ''),
{CANONICAL},
t AS (SELECT c.*, CASE WHEN string_split(trim(name), ' ')[-1] IN ('Workflow', 'Process') THEN 'Workflow' WHEN string_split(trim(name), ' ')[-1] = 'Rule' THEN 'Rule'
  WHEN string_split(trim(name), ' ')[-1] = 'Field' THEN 'Field' ELSE label END AS entity_type,
  coalesce(list_filter({SENTENCE_LIST}, lambda x: contains(x, name))[1], left(text, 200)) AS context FROM c)
SELECT canonical_name, entity_type, count(DISTINCT chunk_id) AS n_chunks, count(DISTINCT name) AS n_names, CAST(sum(len(context)) AS BIGINT) AS context_chars,
  count(DISTINCT 'ent_' || left(sha256(lower(canonical_name)), 8) || '_' || chunk_id) AS n_ids FROM t GROUP BY canonical_name, entity_type"""


def deduplicated(s: SparkSession, d: str) -> DataFrame:
    """The entity of longest context of every canonical name."""
    return entities.deduplicated(base.entities(s, d)).select("entity_id", "canonical_name", "context")


DEDUPLICATED = f"""{GRAPH} SELECT entity_id, canonical_name, context FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(canonical_name) ORDER BY len(context) DESC, pos) AS r FROM ent) WHERE r = 1"""


def _named(s: SparkSession, d: str) -> DataFrame:
    return base.table(s, d, "part").select(F.lit("Part").alias("entity_type"), F.col("p_name").alias("canonical_name"), F.col("p_name").alias("name")).distinct()


def similar(s: SparkSession, d: str) -> DataFrame:
    """Similar names of parts."""
    return entities.similar_pairs(_named(s, d), 0.6).select(F.col("ca").alias("a"), F.col("cb").alias("b"), "similarity")


#: Similarity of every pair of names, as the reference formula says it.
INITIALS = "array_to_string(list_transform(regexp_split_to_array(trim({0}), '\\s+'), lambda w: left(w, 1)), '')"
PAIRS = rf"""n AS (SELECT DISTINCT p_name AS x, lower(p_name) AS l FROM part),
p AS (SELECT a.x AS a, b.x AS b, round(least(1.0, greatest(0.0, 1 - levenshtein(a.l, b.l) / CAST(greatest(len(a.l), len(b.l)) AS DOUBLE))
  + CASE WHEN contains(a.l, b.l) OR contains(b.l, a.l) THEN 0.3 ELSE 0 END
  + CASE WHEN (len(a.l) >= 3 AND starts_with({INITIALS.format("b.l")}, a.l)) OR (len(b.l) >= 3 AND starts_with({INITIALS.format("a.l")}, b.l)) THEN 0.5 ELSE 0 END), 6) AS similarity
  FROM n a JOIN n b ON a.x <> b.x)"""
SIMILAR = f"WITH {PAIRS} SELECT a, b, similarity FROM p WHERE a < b AND similarity >= 0.6"


def _resolved(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = _named(s, d)
    pairs = entities.similar_pairs(n, 0.75).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    clusters = entities.connected(pairs, n.select(F.col("canonical_name").alias("id")))
    rows = n.select(
        F.col("canonical_name").alias("entity_id"), "entity_type", "name", "canonical_name", F.lit("").alias("context"), F.create_map(F.lit("a"), F.lit("b")).alias("properties"),
        F.col("canonical_name").alias("source_chunk_id"), F.conv(F.substring(F.md5("name"), 1, 8), 16, 10).cast("long").alias("pos"),
    )
    return rows, clusters, entities.canonical(rows, clusters)


def resolved(s: SparkSession, d: str) -> DataFrame:
    """Clusters of names at similarity 0.75, their canonical form and members."""
    return _resolved(s, d)[2].select("cluster", "name", "mention_count", F.size("aliases").cast("long").alias("n_aliases"))


CHOSEN = f"""{PAIRS}, r AS (SELECT x AS id, x AS tip FROM n UNION SELECT r.id, p.b FROM r JOIN p ON r.tip = p.a AND similarity >= 0.75),
c AS (SELECT id, min(tip) AS cluster FROM r GROUP BY id),
k AS (SELECT cluster, id, row_number() OVER (PARTITION BY cluster ORDER BY len(id) DESC, CAST('0x' || left(md5(id), 8) AS BIGINT)) AS o, count(*) OVER (PARTITION BY cluster) AS mention_count FROM c)"""
RESOLVED = f"WITH RECURSIVE {CHOSEN} SELECT cluster, id AS name, mention_count, mention_count - 1 AS n_aliases FROM k WHERE o = 1"


def same_as(s: SparkSession, d: str) -> DataFrame:
    """Edges from every member of a cluster to its canonical entity."""
    return entities.same_as(*_resolved(s, d)).select("rel_id", "rel_type", "src", "dst")


SAME_AS = f"WITH RECURSIVE {CHOSEN} SELECT 'same_as_' || a.id || '_' || b.id AS rel_id, 'SAME_AS' AS rel_type, a.id AS src, b.id AS dst FROM k a JOIN k b ON a.cluster = b.cluster AND b.o = 1 AND a.o > 1"


def conflict_pairs(s: SparkSession, d: str) -> DataFrame:
    """Conflicting properties of mentions of one name."""
    return conflicts.property_conflicts(base.entities(s, d))


CONFLICT_PAIRS = f"""{GRAPH}, pr AS (SELECT entity_id, entity_type, lower(canonical_name) AS n, 'size' AS key, size AS value FROM ent UNION ALL SELECT entity_id, entity_type, lower(canonical_name), 'kind', kind FROM ent)
SELECT a.entity_id AS a, b.entity_id AS b, a.key, a.value AS value_a, b.value AS value_b FROM pr a JOIN pr b ON a.entity_type = b.entity_type AND a.n = b.n AND a.key = b.key AND a.entity_id < b.entity_id AND a.value <> b.value"""


def conflict_classes(s: SparkSession, d: str) -> DataFrame:
    """Conflicting values of one name, with the mentions' numbers."""
    return conflicts.conflict_classes(base.entities(s, d))


CONFLICT_CLASSES = f"""{GRAPH}, pr AS (SELECT entity_id, entity_type, lower(canonical_name) AS name, 'size' AS key, size AS value FROM ent UNION ALL SELECT entity_id, entity_type, lower(canonical_name), 'kind', kind FROM ent),
v AS (SELECT entity_type, name, key, value, count(DISTINCT entity_id) AS size, min(entity_id) AS first FROM pr GROUP BY ALL)
SELECT a.entity_type, a.name, a.key, a.value AS value_a, a.size AS size_a, a.first AS first_a, b.value AS value_b, b.size AS size_b, b.first AS first_b FROM v a JOIN v b ON a.entity_type = b.entity_type AND a.name = b.name AND a.key = b.key AND a.value < b.value"""


def conflict_list(s: SparkSession, d: str) -> DataFrame:
    """Conflicts with kind and severity."""
    e = base.entities(s, d)
    return conflicts.listed(conflicts.edges(conflicts.property_conflicts(e)), e).select("src", "dst", "conflict_type", "severity", "severity_score", "reason")


CONFLICT_LIST = f"""{GRAPH}, c AS ({CONFLICT_PAIRS.split("UNION ALL SELECT entity_id, entity_type, lower(canonical_name), 'kind', kind FROM ent)")[0].split(", pr AS (")[1]}
  UNION ALL SELECT entity_id, entity_type, lower(canonical_name), 'kind', kind FROM ent),
pairs AS (SELECT a.entity_id AS src, b.entity_id AS dst, a.entity_type AS t, list_sort(list(a.key || ': ' || a.value || ' vs ' || b.value)) AS rs FROM c a JOIN c b
  ON a.entity_type = b.entity_type AND a.n = b.n AND a.key = b.key AND a.entity_id < b.entity_id AND a.value <> b.value GROUP BY ALL),
k AS (SELECT *, CASE t WHEN 'Rule' THEN 'rule' WHEN 'Workflow' THEN 'workflow' ELSE 'property' END AS conflict_type,
  CASE t WHEN 'System' THEN 5 WHEN 'PaymentMode' THEN 4 WHEN 'Workflow' THEN 3 WHEN 'Rule' THEN 3 ELSE 2 END + CASE t WHEN 'Rule' THEN 3 WHEN 'Workflow' THEN 2 ELSE 1 END AS total FROM pairs)
SELECT src, dst, conflict_type, CASE WHEN total >= 7 THEN 'critical' WHEN total >= 5 THEN 'high' WHEN total >= 3 THEN 'medium' ELSE 'low' END AS severity,
CAST(CASE WHEN total >= 7 THEN 4 WHEN total >= 5 THEN 3 WHEN total >= 3 THEN 2 ELSE 1 END AS BIGINT) AS severity_score, array_to_string(rs, '; ') AS reason FROM k"""


def _rules(s: SparkSession, d: str) -> DataFrame:
    r = base.entities(s, d).filter("entity_type = 'Rule'")
    text = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("IF amount > "), F.col("pos").cast("string"), F.lit(" AND type = 'NEFT'"))).when(F.col("pos") % 3 == 1, "IF amount > 0")
    scope = F.when(F.col("pos") % 2 == 0, "specific").otherwise("general")
    return r.select(F.col("entity_id").alias("rule_id"), text.alias("conditions"), scope.alias("scope"), (F.col("pos") % 5).cast("long").alias("priority"))


def rules(s: SparkSession, d: str) -> DataFrame:
    """Every rule's specificity and rank."""
    r = _rules(s, d)
    targets = conflicts.rule_targets(r, base.edges(s, d), base.entities(s, d))
    return conflicts.ranked_rules(conflicts.specificity(r, targets)).select("rule_id", "n_targets", "specificity", "rank")


RULES = f"""{GRAPH}, ru AS (SELECT entity_id AS rule_id, CASE pos % 3 WHEN 0 THEN 'IF amount > ' || pos || ' AND type = ''NEFT''' WHEN 1 THEN 'IF amount > 0' END AS c, CASE WHEN pos % 2 = 0 THEN 5 ELSE 1 END AS sc, pos % 5 AS priority FROM ent WHERE entity_type = 'Rule'),
tg AS (SELECT e.src AS rule_id, count(DISTINCT e.dst) AS n, bool_or(t.entity_type IN ('System', 'PaymentMode')) AS imp FROM edg e JOIN ent t ON e.dst = t.entity_id WHERE e.rel_type = 'APPLIES_TO' AND t.entity_type <> 'Rule' GROUP BY e.src),
sp AS (SELECT ru.rule_id, coalesce(n, 0) AS n_targets, priority, round(CASE WHEN n > 0 THEN 10.0 / n ELSE 1 END + CASE WHEN c IS NULL THEN 0 ELSE 2 * (len(regexp_extract_all(c, 'AND')) + len(regexp_extract_all(c, 'OR')) + len(regexp_extract_all(c, 'IF')) + 1) END
  + sc + CASE WHEN imp THEN 3 ELSE 0 END, 6) AS specificity FROM ru LEFT JOIN tg ON ru.rule_id = tg.rule_id)
SELECT rule_id, n_targets, CAST(specificity AS DOUBLE) AS specificity, row_number() OVER (ORDER BY specificity DESC, priority DESC, rule_id) AS rank FROM sp"""


def overlaps(s: SparkSession, d: str) -> DataFrame:
    """Rules that apply to one entity."""
    return conflicts.grouped_overlaps(_rules(s, d), base.grouped_edges(s, d), base.entities(s, d))


OVERLAPS = f"""{GRAPH}, tg AS (SELECT DISTINCT e.src AS rule_id, e.dst AS entity_id FROM edg e JOIN ent t ON e.dst = t.entity_id WHERE e.rel_type = 'APPLIES_TO' AND t.entity_type <> 'Rule')
SELECT a.rule_id, b.rule_id AS other_rule, a.entity_id FROM tg a JOIN tg b ON a.entity_id = b.entity_id AND a.rule_id <> b.rule_id"""


def common(s: SparkSession, d: str) -> DataFrame:
    """Names that occur in two or more documents."""
    return conflicts.common_entities(base.entities(s, d))


COMMON = f"{GRAPH} SELECT canonical_name, count(DISTINCT doc_id) AS n_docs, count(*) AS n_mentions FROM ent GROUP BY canonical_name HAVING count(DISTINCT doc_id) > 1"


def groups(s: SparkSession, d: str) -> DataFrame:
    """Entities and chunks of each document."""
    return conflicts.document_groups(base.entities(s, d))


GROUPS = f"{GRAPH} SELECT doc_id, count(DISTINCT entity_id) AS n_entities, count(DISTINCT source_chunk_id) AS n_chunks FROM ent GROUP BY doc_id"


def differences(s: SparkSession, d: str) -> DataFrame:
    """Property differences of same-named entities of two documents."""
    e = base.entities(s, d).withColumn("name", F.col("canonical_name"))
    return conflicts.value_differences(e).select("entity_id_a", "entity_id_b", "key", "value_a", "value_b")


DIFFERENCES = f"""{GRAPH}, pr AS (SELECT entity_id, doc_id, canonical_name AS n, 'size' AS key, size AS value FROM ent UNION ALL SELECT entity_id, doc_id, canonical_name, 'kind', kind FROM ent)
SELECT a.entity_id AS entity_id_a, b.entity_id AS entity_id_b, a.key, a.value AS value_a, b.value AS value_b FROM pr a JOIN pr b ON a.n = b.n AND a.key = b.key AND a.doc_id < b.doc_id AND a.value <> b.value"""


def rel_types(s: SparkSession, d: str) -> DataFrame:
    """Relationship types that one document has and another lacks."""
    e = base.entities(s, d).select(F.col("entity_id").alias("src"), (F.col("pos") % 200).alias("doc_id"))
    return conflicts.type_differences(base.edges(s, d).join(e, "src").select("doc_id", "rel_type").distinct())


REL_TYPES = f"""{GRAPH}, dt AS (SELECT pos % 200 AS doc_id, list_sort(list(DISTINCT rel_type)) AS t FROM edg JOIN ent ON src = entity_id GROUP BY pos % 200)
SELECT a.doc_id, b.doc_id AS other_doc, array_to_string(list_filter(a.t, lambda x: NOT list_contains(b.t, x)), ',') AS only_here FROM dt a JOIN dt b ON a.doc_id <> b.doc_id
WHERE len(list_filter(a.t, lambda x: NOT list_contains(b.t, x))) > 0"""


def _name(s: SparkSession, d: str, where: str, column: str = "canonical_name") -> str:
    """A name out of the data: that of the first entity by id that meets a condition."""
    return base.entities(s, d).filter(where).orderBy("entity_id").select(column).head()[0]


def _edges_with_copies(s: SparkSession, d: str) -> graph.Grouped:
    """The edges, and SAME_AS edges between entities of one canonical name."""
    e = base.entities(s, d).select("canonical_name", "pos")
    first = e.groupBy("canonical_name").agg(F.min("pos").alias("top"))
    same = e.join(first, "canonical_name").filter("pos <> top")
    part = lambda c: F.concat(F.lit("part_"), F.col(c).cast("string"))
    made = same.select(F.concat(F.lit("SAME_AS_"), F.col("pos").cast("string"), F.lit("_"), F.col("top").cast("string")).alias("rel_id"), F.lit("SAME_AS").alias("rel_type"), part("pos").alias("src"), part("top").alias("dst"))
    e = base.grouped_edges(s, d)
    return replace(e, plain=e.plain.unionByName(made))


COPIES = f"""{EDGES.replace("edg AS (", "plain_edges AS (")},
edg AS (SELECT * FROM plain_edges UNION ALL SELECT 'SAME_AS_' || pos || '_' || top, 'SAME_AS', 'part_' || pos, 'part_' || top FROM (SELECT pos, min(pos) OVER (PARTITION BY canonical_name) AS top FROM ent) WHERE pos <> top)"""


def _seeds_sql(name: str, where: str, column: str = "canonical_name", cte: str = "seeds") -> str:
    """CTE ``seeds``: entities that bear the name of the first entity that meets a condition."""
    return f"""{cte}_name AS (SELECT {column} AS nm FROM ent WHERE {where} ORDER BY entity_id LIMIT 1), {cte} AS (SELECT DISTINCT entity_id AS id FROM ent, {cte}_name WHERE name = nm OR canonical_name = nm)"""


#: Nodes, edges and chunks of the paths ``p`` and, with ``seeds``, of these.
PARTS = """held AS (SELECT DISTINCT unnest(nodes) AS id FROM p{0}), rl AS (SELECT DISTINCT unnest(rels) AS id FROM p)
SELECT {1}'node' AS part, id FROM held UNION ALL SELECT {1}'edge', id FROM rl UNION ALL SELECT {1}'chunk', id FROM (SELECT DISTINCT source_chunk_id AS id FROM ent SEMI JOIN held ON entity_id = held.id)"""
WITH_SEEDS = " UNION SELECT id FROM seeds"


def integration_single(s: SparkSession, d: str) -> DataFrame:
    """What one entity integrates with or depends on."""
    names = [_name(s, d, "entity_id = 'part_3'")]
    return graph_retrieval.retrieve(base.entities(s, d), base.grouped_edges(s, d), base.chunks(s, d), names, "integration", 2).parts()


INTEGRATION_SINGLE = f"""{GRAPH}, {_seeds_sql("n", "entity_id = 'part_3'")}, {BOTH_WAYS}, {trail_sql(2, "f", "both_ways", "seeds", "'DEPENDS_ON', 'INTEGRATES_WITH'")},
p AS (SELECT nodes, rels FROM f WHERE len(rels) > 0 ORDER BY len(rels), nodes, rels LIMIT 20), {PARTS.format("", "")}"""


def integration_pair(s: SparkSession, d: str) -> DataFrame:
    """Paths between two named entities."""
    names = [_name(s, d, f"entity_id = '{x}'", "name") for x in ("part_0", "part_10")]
    return graph_retrieval.retrieve(base.entities(s, d), base.grouped_edges(s, d), base.chunks(s, d), names, "integration", 4).parts()


INTEGRATION_PAIR = f"""{GRAPH}, {_seeds_sql("n", "entity_id = 'part_0'", "name")}, {_seeds_sql("n", "entity_id = 'part_10'", "name", "others")}, {BOTH_WAYS},
{trail_sql(4, "f", "both_ways", "seeds", "'DEPENDS_ON', 'INTEGRATES_WITH'")},
p AS (SELECT nodes, rels FROM f SEMI JOIN others ON f.tip = others.id WHERE len(rels) > 0 ORDER BY len(rels), nodes, rels LIMIT 10), {PARTS.format("", "")}"""


def workflow_lookup(s: SparkSession, d: str) -> DataFrame:
    """Steps of the workflows whose name holds a word."""
    return graph_retrieval.retrieve(base.entities(s, d), base.grouped_edges(s, d), base.chunks(s, d), ["ring"], "workflow", 3).parts()


WORKFLOW_LOOKUP = f"""{GRAPH}, seeds AS (SELECT entity_id AS id FROM ent WHERE (entity_type = 'Workflow' OR contains(name, 'Flow') OR contains(name, 'Process')) AND (name = 'ring' OR canonical_name = 'ring' OR contains(name, 'ring'))),
{trail_sql(3, "p", "edg", "seeds", "'NEXT_STEP'")}, {PARTS.format("", "")}"""


def rule_lookup(s: SparkSession, d: str) -> DataFrame:
    """What a named rule applies to, and which rules apply to a named entity."""
    names = [_name(s, d, "entity_type = 'Rule'", "name"), _name(s, d, "entity_type = 'System'")]
    return graph_retrieval.retrieve(base.entities(s, d), base.grouped_edges(s, d), base.chunks(s, d), names, "rule", 2).get("applies")


RULE_NAMES = f"""{_seeds_sql("n", "entity_type = 'Rule'", "name", "one")}, {_seeds_sql("n", "entity_type = 'System'", "canonical_name", "two")},
ids AS (SELECT id FROM one UNION SELECT id FROM two), rl AS (SELECT entity_id AS id FROM ent WHERE entity_type = 'Rule'),
seeds AS (SELECT id FROM ids SEMI JOIN rl USING (id)), targets AS (SELECT id FROM ids ANTI JOIN rl USING (id))"""
RULE_LOOKUP = f"""{GRAPH}, {RULE_NAMES}, {TURNED}, {trail_sql(2, "f", "edg", "seeds", "'APPLIES_TO'")}, {trail_sql(2, "b", "turned", "targets", "'APPLIES_TO'")}
SELECT start AS rule_id, tip AS entity_id FROM f WHERE len(rels) > 0 UNION SELECT tip, start FROM b SEMI JOIN rl ON b.tip = rl.id WHERE len(rels) > 0"""


def rules_all(s: SparkSession, d: str) -> DataFrame:
    """G9 without names: the first rules and what they apply to."""
    return graph_retrieval.retrieve(base.entities(s, d), base.grouped_edges(s, d), base.chunks(s, d), [], "rule", 2).get("applies")


RULES_ALL = f"""{GRAPH}, seeds AS (SELECT entity_id AS id FROM ent WHERE entity_type = 'Rule' ORDER BY 1 LIMIT 50), {trail_sql(2, "f", "edg", "seeds", "'APPLIES_TO'")}
SELECT DISTINCT start AS rule_id, tip AS entity_id FROM f WHERE len(rels) > 0"""


def conflict_lookup(s: SparkSession, d: str) -> DataFrame:
    """Conflicts of a named entity, with kind and severity."""
    e = base.entities(s, d)
    found = conflicts.edges(conflicts.property_conflicts(e))
    names = [found.join(e.select(F.col("entity_id").alias("src"), "canonical_name"), "src").agg(F.min("canonical_name").alias("x")).head().x or ""]
    return graph_retrieval.retrieve(e, found, base.chunks(s, d), names, "conflict").get("conflicts").select("src", "dst", "conflict_type", "severity", "severity_score", "reason")


CONFLICT_LOOKUP = f"SELECT l.* FROM ({CONFLICT_LIST}) l SEMI JOIN ({GRAPH}, cn AS (SELECT entity_id, canonical_name FROM ent), l2 AS ({CONFLICT_LIST}) SELECT entity_id FROM cn WHERE canonical_name = (SELECT min(canonical_name) FROM cn JOIN l2 ON entity_id = l2.src OR entity_id = l2.dst)) x ON l.src = x.entity_id OR l.dst = x.entity_id"


def _twin(s: SparkSession, d: str, column: str) -> str:
    """The name, or canonical name, of an entity whose canonical name several chunks
    mention: of the first such name the last bearer."""
    e = base.entities(s, d)
    many = e.groupBy("canonical_name").agg(F.countDistinct("source_chunk_id").alias("n"), F.max_by("name", "pos").alias("name")).filter("n > 1")
    return many.orderBy("canonical_name").select(column).head()[0]


TWIN = "many AS (SELECT canonical_name, max_by(name, pos) AS name FROM ent GROUP BY canonical_name HAVING count(DISTINCT source_chunk_id) > 1), twin AS (SELECT * FROM many ORDER BY canonical_name LIMIT 1)"


def comparison_single(s: SparkSession, d: str) -> DataFrame:
    """One entity, with all that is the same as it, by document."""
    return graph_retrieval.retrieve(base.entities(s, d), _edges_with_copies(s, d), base.chunks(s, d), [_twin(s, d, "name")], "comparison", 1).get("groups")


COMPARISON_SINGLE = f"""WITH RECURSIVE {ENTITIES}, {COPIES}, {TWIN}, seeds AS (SELECT DISTINCT entity_id AS id FROM ent, twin WHERE ent.name = twin.name OR ent.canonical_name = twin.name), {BOTH_WAYS}, {trail_sql(2, "f", "both_ways", "seeds", "'SAME_AS'")}
SELECT DISTINCT source_chunk_id AS doc_id, entity_id, source_chunk_id AS chunk_id FROM ent SEMI JOIN f ON ent.entity_id = f.tip SEMI JOIN documents ON source_chunk_id = CAST(documents.doc_id AS VARCHAR)"""


def comparison_differences(s: SparkSession, d: str) -> DataFrame:
    """Properties in which the bearers of one canonical name differ between documents."""
    names = [_twin(s, d, "canonical_name")]
    found = graph_retrieval.retrieve(base.entities(s, d).withColumn("name", F.col("canonical_name")), _edges_with_copies(s, d), base.chunks(s, d), names, "comparison", 1)
    return found.get("differences").select("entity_id_a", "entity_id_b", "key", "value_a", "value_b")


COMPARISON_DIFFERENCES = f"""WITH {ENTITIES}, {TWIN}, own AS (SELECT * FROM ent WHERE canonical_name = (SELECT canonical_name FROM twin)),
pr AS (SELECT entity_id, source_chunk_id AS doc, 'size' AS key, size AS value FROM own UNION ALL SELECT entity_id, source_chunk_id, 'kind', kind FROM own)
SELECT a.entity_id AS entity_id_a, b.entity_id AS entity_id_b, a.key, a.value AS value_a, b.value AS value_b FROM pr a JOIN pr b ON a.key = b.key AND a.doc < b.doc AND a.value <> b.value"""


def comparison_pair(s: SparkSession, d: str) -> DataFrame:
    """Two entities, all paths around them and their chunks."""
    names = [_name(s, d, f"entity_id = '{x}'", "name") for x in ("part_1", "part_2")]
    return graph_retrieval.retrieve(base.entities(s, d), _edges_with_copies(s, d), base.chunks(s, d), names, "comparison", 2).parts()


COMPARISON_PAIR = f"""WITH RECURSIVE {ENTITIES}, {COPIES}, {_seeds_sql("n", "entity_id = 'part_1'", "name", "one")}, {_seeds_sql("n", "entity_id = 'part_2'", "name", "two")},
seeds AS (SELECT id FROM one UNION SELECT id FROM two), {BOTH_WAYS}, {trail_sql(2, "p", "both_ways", "seeds", ANY)},
held AS (SELECT DISTINCT unnest(nodes) AS id FROM p), rl AS (SELECT DISTINCT unnest(rels) AS id FROM p)
SELECT 'node' AS part, id FROM held UNION ALL SELECT 'edge', id FROM rl UNION ALL SELECT 'chunk', id FROM (SELECT DISTINCT source_chunk_id AS id FROM ent SEMI JOIN seeds ON entity_id = seeds.id SEMI JOIN documents ON source_chunk_id = CAST(documents.doc_id AS VARCHAR))"""


def general_lookup(s: SparkSession, d: str) -> DataFrame:
    """The surroundings of a named entity over edges of any type."""
    names = [_name(s, d, "entity_id = 'part_5'")]
    return graph_retrieval.retrieve(base.entities(s, d), base.grouped_edges(s, d), base.chunks(s, d), names, "general", 2).parts()


GENERAL_LOOKUP = f"""{GRAPH}, {_seeds_sql("n", "entity_id = 'part_5'")}, {BOTH_WAYS}, {trail_sql(2, "f", "both_ways", "seeds", ANY)},
p AS (SELECT nodes, rels FROM f WHERE len(rels) > 0 ORDER BY len(rels), nodes, rels LIMIT 50), {PARTS.format(WITH_SEEDS, "")}"""

#: A question for each executor; the name stands in quotes.
ASKED = {
    "integration": ('Which parts connect to "{}"?', "entity_id = 'part_3'"), "general": ('What is "{}"?', "entity_id = 'part_5'"), "workflow": ('Show the steps of "{}"', None),
}


def dispatched(s: SparkSession, d: str) -> DataFrame:
    """G1: several questions, each routed by its own words to its executor."""
    out = None
    for kind, (question, where) in ASKED.items():
        q = F.lit(question.format(_name(s, d, where) if where else "ring"))
        route = s.range(1).select(T.query_pattern(q).alias("pattern"), F.slice(T.mentions(q), 1, 1).alias("names")).head()
        found = graph_retrieval.retrieve(base.entities(s, d), base.grouped_edges(s, d), base.chunks(s, d), list(route.names), route.pattern, 3 if kind == "workflow" else 2).parts()
        found = found.select(F.lit(route.pattern).alias("pattern"), "part", "id")
        out = found if out is None else out.unionByName(found)
    return out


DISPATCHED = f"SELECT 'integration' AS pattern, part, id FROM ({INTEGRATION_SINGLE}) UNION ALL SELECT 'general', part, id FROM ({GENERAL_LOOKUP}) UNION ALL SELECT 'workflow', part, id FROM ({WORKFLOW_LOOKUP})"

QUERIES = {
    "edge_tables": (edge_tables, EDGE_TABLES), "mention_edges": (mention_edges, MENTION_EDGES), "structure_edges": (structure, STRUCTURE),
    "dependency_paths": (dependency_paths, DEPENDENCY_PATHS), "impact_radius": (impact, IMPACT), "circular_dependencies": (cycles, CYCLES),
    "integration_paths": (integration, INTEGRATION), "neighbours": (neighbours, NEIGHBOURS), "process_chains": (chains, CHAINS), "process_gaps": (gaps, GAPS),
    "graph_facts": (fact_rows, FACTS), "path_assembly": (path_assembly, PATH_ASSEMBLY), "entity_types": (type_counts, TYPE_COUNTS),
    "entity_extraction": (extracted, EXTRACTED), "entity_dedup": (deduplicated, DEDUPLICATED), "entity_similarity": (similar, SIMILAR),
    "entity_resolution": (resolved, RESOLVED), "same_as": (same_as, SAME_AS), "property_conflicts": (conflict_pairs, CONFLICT_PAIRS),
    "conflict_list": (conflict_list, CONFLICT_LIST), "conflict_classes": (conflict_classes, CONFLICT_CLASSES), "rule_ranking": (rules, RULES), "rule_overlaps": (overlaps, OVERLAPS), "common_entities": (common, COMMON),
    "document_groups": (groups, GROUPS), "value_differences": (differences, DIFFERENCES), "type_differences": (rel_types, REL_TYPES),
    "graph_integration_single": (integration_single, INTEGRATION_SINGLE), "graph_integration_pair": (integration_pair, INTEGRATION_PAIR), "workflow_lookup": (workflow_lookup, WORKFLOW_LOOKUP),
    "rule_lookup": (rule_lookup, RULE_LOOKUP), "rules_all": (rules_all, RULES_ALL), "conflict_lookup": (conflict_lookup, CONFLICT_LOOKUP), "comparison_single": (comparison_single, COMPARISON_SINGLE),
    "comparison_differences": (comparison_differences, COMPARISON_DIFFERENCES), "comparison_pair": (comparison_pair, COMPARISON_PAIR), "general_lookup": (general_lookup, GENERAL_LOOKUP),
    "graph_dispatch": (dispatched, DISPATCHED),
}
