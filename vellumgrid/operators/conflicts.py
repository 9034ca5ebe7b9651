"""Conflicts between mentions, their kind and severity; business rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumgrid.operators.durable import durable
from vellumgrid.operators.entities import IGNORED_PROPERTIES
from vellumgrid.operators.graph import Grouped

#: Fixed values.
IMPORTANCE = {"System": 5, "PaymentMode": 4, "Workflow": 3, "Rule": 3, "Field": 2}
#: Rules of a group that are dealt to one task, and entities that pairs of rules meet as one
#: list; of eights, which Parquet packs into whole bytes.
BLOCK = 128


def property_conflicts(mentions: DataFrame) -> DataFrame:
    """a, b, key, value_a, value_b: mentions of one type and lower-cased canonical
    name whose chunks exist and that give a property different values.

    Properties are joined on (name, key), not mention by mention, and only
    differing values meet."""
    rows = mentions.filter("source_chunk_id is not null").select("entity_id", "entity_type", F.lower("canonical_name").alias("n"), F.explode("properties").alias("key", "value"))
    rows = rows.filter(F.col("value").isNotNull() & ~F.col("key").isin(IGNORED_PROPERTIES))
    a = rows.select("entity_type", "n", "key", F.col("entity_id").alias("a"), F.col("value").alias("value_a"))
    b = rows.select("entity_type", "n", "key", F.col("entity_id").alias("b"), F.col("value").alias("value_b"))
    return a.join(b, ["entity_type", "n", "key"]).filter("a < b and value_a <> value_b").select("a", "b", "key", "value_a", "value_b")


def conflict_classes(mentions: DataFrame) -> DataFrame:
    """The conflicts of ``property_conflicts`` between values in place of mentions: for
    each type, name and property every two differing values, with the number and the
    first of the mentions that give each. A name borne by very many mentions has as
    many rows as its values have pairs."""
    rows = mentions.filter("source_chunk_id is not null").select("entity_id", "entity_type", F.lower("canonical_name").alias("n"), F.explode("properties").alias("key", "value"))
    rows = rows.filter(F.col("value").isNotNull() & ~F.col("key").isin(IGNORED_PROPERTIES))
    held = rows.groupBy("entity_type", "n", "key", "value").agg(F.countDistinct("entity_id").alias("size"), F.min("entity_id").alias("first"))
    side = lambda c: held.select("entity_type", "n", "key", *[F.col(x).alias(f"{x}_{c}") for x in ("value", "size", "first")])
    return side("a").join(side("b"), ["entity_type", "n", "key"]).filter("value_a < value_b").withColumnRenamed("n", "name")


def edges(found: DataFrame) -> DataFrame:
    """Two directed edges for each conflicting pair, with all reasons."""
    each = F.concat("key", F.lit(": "), "value_a", F.lit(" vs "), "value_b")
    pairs = found.groupBy("a", "b").agg(F.array_join(F.sort_array(F.collect_list(each)), "; ").alias("reason"))
    one = pairs.select(F.concat_ws("_", F.lit("conflict"), "a", "b").alias("rel_id"), F.lit("CONFLICTS_WITH").alias("rel_type"), F.col("a").alias("src"), F.col("b").alias("dst"), "reason")
    two = pairs.select(F.concat_ws("_", F.lit("conflict"), "b", "a").alias("rel_id"), F.lit("CONFLICTS_WITH").alias("rel_type"), F.col("b").alias("src"), F.col("a").alias("dst"), "reason")
    return one.unionByName(two)


def category(type_a: Column, type_b: Column, given: Column | None = None) -> Column:
    inferred = F.when((type_a == "Rule") | (type_b == "Rule"), "rule").when((type_a == "Workflow") | (type_b == "Workflow"), "workflow").otherwise("property")
    return inferred if given is None else F.coalesce(given, inferred)


def importance(kind: Column) -> Column:
    out = None
    for name, value in IMPORTANCE.items():
        out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
    return out.otherwise(1)


def severity(type_a: Column, type_b: Column, kind: Column) -> Column:
    weight = F.when(kind == "rule", 3).when(kind == "workflow", 2).otherwise(1)
    total = F.greatest(importance(type_a), importance(type_b)) + weight
    return F.when(total >= 7, "critical").when(total >= 5, "high").when(total >= 3, "medium").otherwise("low")


def severity_score(level: Column) -> Column:
    return F.when(level == "critical", 4).when(level == "high", 3).when(level == "medium", 2).when(level == "low", 1).otherwise(0)


def listed(conflict_edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row for each unordered pair, with kind and severity, worst first when ordered by severity_score."""
    names = nodes.select("entity_id", "entity_type", "canonical_name", "source_chunk_id")
    a = names.select(F.col("entity_id").alias("src"), F.col("entity_type").alias("type_a"), F.col("source_chunk_id").alias("chunk_a"))
    b = names.select(F.col("entity_id").alias("dst"), F.col("entity_type").alias("type_b"), F.col("source_chunk_id").alias("chunk_b"))
    once = conflict_edges.filter("src < dst").join(a, "src").join(b, "dst")
    kind = category(F.col("type_a"), F.col("type_b"))
    out = once.select("src", "dst", kind.alias("conflict_type"), severity(F.col("type_a"), F.col("type_b"), kind).alias("severity"), "reason", "chunk_a", "chunk_b")
    return out.withColumn("severity_score", severity_score(F.col("severity")).cast("long"))


def rule_targets(rules: DataFrame, edges_: DataFrame, nodes: DataFrame) -> DataFrame:
    """rule_id, entity_id, entity_type of what each rule applies to."""
    applies = edges_.filter("rel_type = 'APPLIES_TO'").select(F.col("src").alias("rule_id"), F.col("dst").alias("entity_id")).distinct()
    return applies.join(rules.select("rule_id"), "rule_id", "left_semi").join(nodes.select("entity_id", "entity_type"), "entity_id").filter("entity_type <> 'Rule'")


def specificity(rules: DataFrame, targets: DataFrame) -> DataFrame:
    """rules (rule_id, conditions, scope, priority) with their specificity."""
    stats = targets.groupBy("rule_id").agg(F.countDistinct("entity_id").alias("n"), F.max(F.col("entity_type").isin("System", "PaymentMode")).alias("important"))
    hits = lambda w: F.regexp_count(F.col("conditions"), F.lit(w))
    has = F.col("conditions").isNotNull() & (F.col("conditions") != "")
    condition = F.when(has, 2.0 * (hits("AND") + hits("OR") + hits("IF") + 1)).otherwise(0.0)
    scope = F.when(F.lower("scope").isin("specific", "targeted"), 5).when(F.lower("scope").isin("general", "broad"), 1).otherwise(3)
    value = F.when(F.col("n") > 0, 10.0 / F.col("n")).otherwise(1.0) + condition + scope + F.when(F.col("important"), 3).otherwise(0)
    return rules.join(stats, "rule_id", "left").select(*rules.columns, F.coalesce("n", F.lit(0)).alias("n_targets"), F.round(value, 6).alias("specificity"))


def ranked_rules(scored: DataFrame) -> DataFrame:
    """rank by specificity, then priority, then id. Ranks come from counts of
    larger keys per partition, so no task sees all rows. The ranges are drawn from a
    sample; rows and counts must come of one and the same draw, so it is kept."""
    spark = scored.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = scored.withColumn("o", F.struct((-F.col("specificity")).alias("s"), (-F.col("priority")).alias("p"), "rule_id"))
    split = rows.repartitionByRange(parts, "o").withColumn("part", F.spark_partition_id())
    local = durable(split.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("o"))))
    sizes = local.groupBy("part").agg(F.max("k").alias("n"))  # a row a partition
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(F.broadcast(before.select("part", "before")), "part").select(*scored.columns, (F.col("before") + F.col("k")).cast("long").alias("rank"))


def rule_overlaps(targets: DataFrame) -> DataFrame:
    """Ordered pairs of rules that share an entity. Targets are made distinct before
    they meet, so the pairs are distinct as they come and are not shuffled."""
    held = targets.select("entity_id", "rule_id").distinct()
    return held.join(held.withColumnRenamed("rule_id", "other_rule"), "entity_id").filter("rule_id <> other_rule").select("rule_id", "other_rule", "entity_id")


def _blocks(rows: DataFrame, node: str) -> DataFrame:
    """Members of each group, (group, ``node``), numbered off in blocks of ``BLOCK``."""
    k = F.row_number().over(Window.partitionBy("group").orderBy(node))
    return rows.withColumn("block", F.floor((k - 1) / BLOCK).cast("int"))


def grouped_overlaps(rules: DataFrame, edges_: Grouped, nodes: DataFrame) -> DataFrame:
    """``rule_overlaps`` of edges of which groups stand for some: a group's rules and
    entities meet in place of its targets. Its rows grow with the cube of a group, so
    its rules are dealt out in blocks, and a pair of rules meets a block of entities
    as a list: the ids recur at short distance, in which files of columns take a
    fraction of the space."""
    given = rule_targets(rules, edges_.plain, nodes).select("rule_id", "entity_id").distinct()
    known = rules.select(F.col("rule_id").alias("node")).distinct()
    ends = nodes.filter("entity_type <> 'Rule'").select(F.col("entity_id").alias("node")).distinct()
    held = edges_.left.join(known, "node", "left_semi").select("group", F.col("node").alias("rule_id"))
    to = edges_.right.join(ends, "node", "left_semi").select("group", F.col("node").alias("entity_id"))
    other = held.withColumnRenamed("rule_id", "other_rule")
    dealt = _blocks(held, "rule_id")
    each = dealt.select("group", "block").distinct()
    lists = _blocks(to, "entity_id").groupBy("group", F.col("block").alias("k")).agg(F.collect_list("entity_id").alias("entities"))
    parts = int(rules.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    put = lambda rows: rows.repartition(parts, "group", "block")  # noqa: E731  # a set number: few rows would be put into few tasks
    met = put(dealt).join(put(lists.join(each, "group")), ["group", "block"]).join(put(other.join(each, "group")), ["group", "block"])
    pairs = met.filter("rule_id <> other_rule").select("rule_id", "other_rule", F.explode("entities").alias("entity_id"))
    mixed = given.join(to, "entity_id").join(other, "group").filter("rule_id <> other_rule").select("rule_id", "other_rule", "entity_id")
    turned = mixed.select(F.col("other_rule").alias("rule_id"), F.col("rule_id").alias("other_rule"), "entity_id")
    return rule_overlaps(given).unionByName(pairs).unionByName(mixed).unionByName(turned)


def common_entities(entities: DataFrame) -> DataFrame:
    """Canonical names in two or more documents, with the documents' number."""
    return entities.groupBy("canonical_name").agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_mentions")).filter("n_docs > 1")


def document_groups(entities: DataFrame) -> DataFrame:
    """Per document its distinct entities and chunks."""
    return entities.groupBy("doc_id").agg(F.countDistinct("entity_id").alias("n_entities"), F.countDistinct("source_chunk_id").alias("n_chunks"))


def value_differences(entities: DataFrame) -> DataFrame:
    """Same-named entities of two documents that differ in a property; a missing
    one counts as null."""
    rows = entities.select("doc_id", "name", "entity_id", "properties")
    a = rows.select("name", *[F.col(c).alias(f"{c}_a") for c in ("doc_id", "entity_id", "properties")])
    b = rows.select("name", *[F.col(c).alias(f"{c}_b") for c in ("doc_id", "entity_id", "properties")])
    pairs = a.join(b, "name").filter("doc_id_a < doc_id_b")
    keys = F.array_union(F.map_keys("properties_a"), F.map_keys("properties_b"))
    each = pairs.withColumn("key", F.explode(keys))
    each = each.withColumn("value_a", F.try_element_at("properties_a", F.col("key"))).withColumn("value_b", F.try_element_at("properties_b", F.col("key")))
    return each.filter(~F.col("value_a").eqNullSafe(F.col("value_b"))).select("name", "doc_id_a", "doc_id_b", "entity_id_a", "entity_id_b", "key", "value_a", "value_b")


def type_differences(doc_edges: DataFrame) -> DataFrame:
    """Ordered pairs of documents and the relationship types that only the first
    has, of (doc_id, rel_type) rows. Documents with the same set of types are one
    class; classes are compared, which are as few as sets of types occur."""
    sets = doc_edges.groupBy("doc_id").agg(F.sort_array(F.collect_set("rel_type")).alias("types")).withColumn("kind", F.array_join("types", ","))
    kinds = sets.select("kind", "types").distinct()
    other = kinds.select(F.col("kind").alias("other_kind"), F.col("types").alias("other_types"))
    only = F.array_join(F.array_except("types", "other_types"), ",")
    pairs = kinds.join(F.broadcast(other), F.col("kind") != F.col("other_kind")).select("kind", "other_kind", only.alias("only_here")).filter("only_here <> ''")
    rest = sets.select(F.col("doc_id").alias("other_doc"), F.col("kind").alias("other_kind"))
    return sets.select("doc_id", "kind").join(pairs, "kind").join(rest, "other_kind").select("doc_id", "other_doc", "only_here")
