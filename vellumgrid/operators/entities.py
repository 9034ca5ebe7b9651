"""Entities: extraction, deduplication, resolution to canonical ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumgrid.functions import text as T
from vellumgrid.operators.durable import durable, spread

#: Fixed values.
TYPES = ["System", "PaymentMode", "Workflow", "Rule", "Field"]
IGNORED_PROPERTIES = ["extraction_method", "spacy_label", "start_char", "end_char", "source_chunk_ids", "mention_count", "aliases"]


#: Amounts and dates, as their recogniser's labels.
LABELLED = {"MONEY": r"(?:[$€£₹]|Rs\.? ?)[0-9][0-9,.]*(?: (?:lakh|crore|million|billion)s?)?", "DATE": r"[0-9]{4}-[0-9]{2}-[0-9]{2}"}


def _rows(found: DataFrame, properties: Column) -> DataFrame:
    canonical = T.normalise_name(F.col("name"))
    return found.select(
        T.entity_id(canonical, F.col("chunk_id")).alias("entity_id"), "entity_type", "name", canonical.alias("canonical_name"),
        F.col("chunk_id").alias("source_chunk_id"), T.entity_context(F.col("text"), F.col("name"), F.col("joined")).alias("context"), properties.alias("properties"),
    )


def _named_type(name: Column, other: Column) -> Column:
    """The type that a name's last word says, else ``other``."""
    last = F.substring_index(F.trim(name), " ", -1)
    return F.when(last.isin("Workflow", "Process"), "Workflow").when(last == "Rule", "Rule").when(last == "Field", "Field").otherwise(other)


def from_labels(rows: DataFrame) -> DataFrame:
    """Entities of a recogniser's output: (chunk_id, text, spans), a span being a
    text and its label."""
    # sentences are split once a text, before its spans become rows
    rows = rows.select("chunk_id", "text", "spans", T.joined_sentences(F.col("text")).alias("joined"))
    found = rows.select("chunk_id", "text", "joined", F.explode("spans").alias("s")).select("chunk_id", "text", "joined", F.col("s.text").alias("name"), F.col("s.label").alias("label"))
    typed = found.filter(F.trim("name") != "").withColumn("entity_type", _named_type(F.col("name"), T.ner_type(F.col("label"))))
    return _rows(typed, F.create_map(F.lit("extraction_method"), F.lit("ner"), F.lit("spacy_label"), F.col("label")))


def from_replies(rows: DataFrame) -> DataFrame:
    """Entities of a model's JSON replies: (chunk_id, text, reply). Entries without
    a name are left out; an unknown type is a System; a reply that isn't JSON has none."""
    each = T.json_array(F.col("reply"), "struct<name:string,type:string,properties:map<string,string>>")
    rows = rows.select("chunk_id", "text", each.alias("found"), T.joined_sentences(F.col("text")).alias("joined"))
    found = rows.select("chunk_id", "text", "joined", F.explode("found").alias("e")).select("chunk_id", "text", "joined", F.col("e.name").alias("name"), F.col("e.type").alias("type"), F.col("e.properties").alias("given"))
    typed = found.filter(F.coalesce(F.trim("name"), F.lit("")) != "").withColumn("entity_type", F.when(F.col("type").isin(TYPES), F.col("type")).otherwise("System"))
    return _rows(typed, F.map_concat(F.coalesce("given", F.create_map().cast("map<string,string>")), F.create_map(F.lit("extraction_method"), F.lit("llm"))))


def extract(chunks: DataFrame) -> DataFrame:
    """Offline extraction: the mention rules on each chunk's text as organisations,
    amounts and dates by their forms. A recogniser's or a model's output may take
    its place."""
    spans = lambda values, label: F.transform(F.array_distinct(values), lambda v: F.struct(v.alias("text"), F.lit(label).alias("label")))
    text = F.coalesce(F.col("text"), F.lit(""))
    every = [spans(T.mentions(text), "ORG"), *[spans(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), label) for label, pattern in LABELLED.items()]]
    return from_labels(spread(chunks.select("chunk_id", "text")).select("chunk_id", "text", F.concat(*every).alias("spans")))


def deduplicated(entities: DataFrame, pos: str = "pos") -> DataFrame:
    """Per lower-cased canonical name the entity of the longest context; the first
    by ``pos`` among equals. An arg-max aggregate, combined before the shuffle."""
    best = F.max_by(F.struct(*entities.columns), F.struct(F.length(F.coalesce("context", F.lit(""))), -F.col(pos)))
    return entities.groupBy(F.lower("canonical_name").alias("_k")).agg(best.alias("x")).select("x.*")


def _grams(word: str, size: int) -> Column:
    """The runs of ``size`` characters, numbered where one recurs."""
    runs = F.transform(F.sequence(F.lit(1), F.length(word) - size + 1), lambda i: F.substring(F.col(word), i, F.lit(size)))
    runs = F.when(F.length(word) >= size, runs).otherwise(F.array().cast("array<string>"))
    return F.transform(runs, lambda g, i: F.concat(g, F.lit("\x01"), F.size(F.filter(F.slice(runs, F.lit(1), i + 1), lambda x: x == g)).cast("string")))


def _prefixes(words: DataFrame, size: int, need: Column) -> DataFrame:
    """entity_type, w, g: each word's rarest grams, as many as any partner that
    shares ``need`` of them must meet one."""
    flat = words.select("entity_type", "w", F.explode(_grams("w", size)).alias("g"))
    often = flat.groupBy("entity_type", "g").agg(F.count("*").alias("f"))
    ranked = flat.join(often, ["entity_type", "g"]).groupBy("entity_type", "w").agg(F.sort_array(F.collect_list(F.struct("f", "g"))).alias("gs"))
    keep = F.size("gs") - F.greatest(need, F.lit(1)) + 1
    return ranked.select("entity_type", "w", F.explode(F.slice("gs", F.lit(1), F.greatest(keep, F.lit(1)))).alias("s")).select("entity_type", "w", F.col("s.g").alias("g"))


def _meeting(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("entity_type", F.col("w").alias("x"), "g").join(b.select("entity_type", F.col("w").alias("y"), "g"), ["entity_type", "g"]).filter("x <> y").select("entity_type", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def similar_pairs(entities: DataFrame, least: float = 0.85) -> DataFrame:
    """entity_type, ca, na, cb, nb and similarity of all pairs of distinct names of
    one type that reach ``least``, the first before the second; names compare once
    however many entities bear them.

    Candidates miss no such pair. Where neither name holds the other nor is its
    acronym, the canonical names' similarity must reach x = (least - 0.3) / 0.7, so at
    most (1 - x) of the longer one's n characters are edited: they share xn characters
    and, each edit costing two, n - 1 - 2(1 - x)n pairs of characters; a prefix filter
    over rare ones finds them (over pairs where that number is one or more for the
    longer name, over characters for two short names). A name that another holds
    shares all its runs; an acronym is a beginning of the other's initials; equal
    names meet as they are."""
    forms = entities.select("entity_type", "canonical_name", "name").distinct()
    words = forms.select("entity_type", F.lower("canonical_name").alias("w")).distinct()
    x = max((least - 1e-6 - 0.3) / 0.7, 0.01)
    n = F.size("gs")
    share = lambda m: F.ceil(m * x - F.lit(1e-9)).cast("int")
    pairs_of = lambda m: F.ceil(m * (2 * x - 1) - 1 - F.lit(1e-9)).cast("int")  # noqa: E731  (grows with m, so it holds for a longer partner)
    short = words.filter(pairs_of(F.length("w")) < 1) if x > 0.5 else words
    chars = _prefixes(short, 1, share(n))
    found = _meeting(chars, chars)
    if x > 0.5:
        twos = _prefixes(words, 2, pairs_of(n + 1))
        found = found.unionByName(_meeting(twos, twos))
    # holding: the rarest run of the shorter name lies in the longer one
    for size, part in ((2, words.filter(F.length("w") >= 2)), (1, words.filter(F.length("w") == 1))):
        every = words.select("entity_type", "w", F.explode(F.array_distinct(F.transform(_grams("w", size), lambda g: F.substring_index(g, "\x01", 1)))).alias("g"))
        often = every.groupBy("entity_type", "g").agg(F.count("*").alias("f"))
        rare = every.join(part, ["entity_type", "w"], "left_semi").join(often, ["entity_type", "g"]).groupBy("entity_type", "w").agg(F.min(F.struct("f", "g")).alias("s")).select("entity_type", "w", F.col("s.g").alias("g"))
        found = found.unionByName(_meeting(rare, every).filter(F.contains("x", F.col("y")) | F.contains("y", F.col("x"))))
    first = words.withColumn("i", T.initials(F.col("w"))).filter(F.length("i") >= 3)
    begun = first.select("entity_type", "w", F.explode(F.transform(F.sequence(F.lit(3), F.length("i")), lambda k: F.left(F.col("i"), k))).alias("g"))
    found = found.unionByName(_meeting(words.select("entity_type", "w", F.col("w").alias("g")), begun)).distinct()
    found = found.unionByName(words.select("entity_type", F.col("w").alias("x"), F.col("w").alias("y")))
    side = lambda c, k: forms.select("entity_type", F.lower("canonical_name").alias(k), F.col("canonical_name").alias(f"c{c}"), F.col("name").alias(f"n{c}"))
    met = found.join(side("a", "x"), ["entity_type", "x"]).join(side("b", "y"), ["entity_type", "y"]).filter("ca <> cb or na <> nb")
    turned = met.select("entity_type", *[F.when(F.expr("(ca, na) < (cb, nb)"), F.col(c)).otherwise(F.col(d)).alias(c) for c, d in (("ca", "cb"), ("na", "nb"), ("cb", "ca"), ("nb", "na"))]).distinct()
    return turned.withColumn("similarity", F.round(T.entity_similarity(F.col("ca"), F.col("cb"), F.col("na"), F.col("nb")), 6)).filter(F.col("similarity") >= least)


def connected(edges: DataFrame, nodes: DataFrame, rounds: int = 50) -> DataFrame:
    """id and cluster: the smallest id reachable. Minimum labels travel along the
    edges and through their own labels until none changes; each round is
    checkpointed to the shared folder where there is one."""
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("other"))).distinct()
    labels = nodes.select("id", F.col("id").alias("cluster")).distinct()
    both = durable(both)
    for _ in range(rounds):
        heard = both.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("cluster").alias("heard"))
        moved = labels.join(heard, "id", "left").select("id", "cluster", F.least("cluster", F.coalesce("heard", "cluster")).alias("to"))
        jumped = moved.join(labels.select(F.col("id").alias("to"), F.col("cluster").alias("via")), "to")
        new = jumped.select("id", F.least("to", "via").alias("new"), "cluster")
        new = durable(new)
        labels = new.select("id", F.col("new").alias("cluster"))
        if new.filter("new <> cluster").isEmpty():
            return labels
    raise RuntimeError("clusters did not settle")


def canonical(entities: DataFrame, clusters: DataFrame, pos: str = "pos") -> DataFrame:
    """Each cluster's canonical entity with the members' chunks, number and other
    names. The score favours long names, then contexts, then many properties."""
    rows = entities.join(clusters.withColumnRenamed("id", "entity_id"), "entity_id")
    score = 10 * F.length("canonical_name") + F.length(F.coalesce("context", F.lit(""))) + 5 * F.size(F.map_keys("properties"))
    best = F.max_by(F.struct("entity_id", "entity_type", "name", "canonical_name"), F.struct(score, -F.col(pos)))
    merged = rows.groupBy("cluster").agg(best.alias("x"), F.sort_array(F.collect_set("source_chunk_id")).alias("source_chunk_ids"), F.count("*").alias("mention_count"), F.sort_array(F.collect_set("name")).alias("names"))
    return merged.select("cluster", "x.*", "source_chunk_ids", "mention_count", F.array_except("names", F.array("x.name")).alias("aliases"))


def same_as(entities: DataFrame, clusters: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges from every other member to its canonical entity."""
    member = clusters.select(F.col("id").alias("src"), "cluster").join(chosen.select("cluster", F.col("entity_id").alias("dst")), "cluster").filter("src <> dst")
    return member.select(F.concat_ws("_", F.lit("same_as"), "src", "dst").alias("rel_id"), F.lit("SAME_AS").alias("rel_type"), "src", "dst")
