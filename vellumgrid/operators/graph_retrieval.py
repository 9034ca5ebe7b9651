"""What a graph question retrieves, by its pattern.

Each executor takes the tables of nodes and edges (``graph.Grouped`` too, but for
dependencies and conflicts) and the names that a question mentions, and returns a ``Subgraph``: tables of nodes, relationships and chunk ids,
and what the pattern adds (cycles, chains, rules, conflicts, document groups, ...).
Nothing runs until a table is read. Limits are features of the question patterns;
ties at a limit go by the paths' length, nodes and edges.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumgrid.operators import conflicts, graph

MENTIONS, SAME_AS = "MENTIONS", "SAME_AS"
#: Parts of names that mark workflows, and how many paths, rules or conflicts a pattern returns.
WORKFLOW_MARKS = ["Flow", "Process"]
PAIR_PATHS, SINGLE_PATHS, GENERAL_PATHS, ALL_RULES, ALL_CONFLICTS = 10, 20, 50, 50, 50


@dataclass
class Subgraph:
    nodes: DataFrame
    edges: DataFrame
    chunks: DataFrame
    more: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)

    def get(self, name: str) -> DataFrame:
        return self.more[name]()

    def parts(self) -> DataFrame:
        """part and id of all nodes, edges and chunks."""
        named = lambda part, rows, c: rows.select(F.lit(part).alias("part"), F.col(c).alias("id")).distinct()
        return named("node", self.nodes, "entity_id").unionByName(named("edge", self.edges, "rel_id")).unionByName(named("chunk", self.chunks, "chunk_id"))


def relations(edges: DataFrame | graph.Grouped) -> DataFrame | graph.Grouped:
    """Edges between entities."""
    if isinstance(edges, graph.Grouped):
        return replace(edges, plain=relations(edges.plain))
    return edges.filter(F.col("rel_type") != MENTIONS)


def seeds(nodes: DataFrame, names: list[str]) -> DataFrame:
    """``id`` of the nodes whose name or canonical name is one of ``names``."""
    return graph.named(nodes, names).select(F.col("entity_id").alias("id")).distinct()


def _of(nodes: DataFrame, edges: DataFrame, ids: DataFrame, rels: DataFrame, **more: Callable[[], DataFrame]) -> Subgraph:
    """The subgraph of ids (``id``) and edges (``rel_id``; with grouped ones also src, dst)."""
    held = nodes.join(ids.select(F.col("id").alias("entity_id")).distinct(), "entity_id", "left_semi")
    chunks = held.filter("source_chunk_id is not null").select(F.col("source_chunk_id").alias("chunk_id")).distinct()
    kept = edges.among(rels) if isinstance(edges, graph.Grouped) else edges.join(rels.select("rel_id").distinct(), "rel_id", "left_semi")
    return Subgraph(held, kept, chunks, more)


def _of_paths(nodes: DataFrame, edges: DataFrame, paths: DataFrame, also: DataFrame | None = None, **more: Callable[[], DataFrame]) -> Subgraph:
    ids = paths.select(F.explode("nodes").alias("id"))
    ids = ids if also is None else ids.unionByName(also.select("id"))
    return _of(nodes, edges, ids, graph.hops_of(paths), **more)


def dependency(nodes: DataFrame, edges: DataFrame, names: list[str], depth: int) -> Subgraph:
    """Trails of dependencies ahead and behind, their cycles and the impact radius."""
    known = seeds(nodes, names)
    paths = graph.dependencies(relations(edges), known, depth)
    return _of_paths(nodes, edges, paths, known, trails=lambda: paths, cycles=lambda: graph.cycles(edges, known, depth), impact=lambda: graph.impact_radius(edges, known, depth))


def integration(nodes: DataFrame, edges: DataFrame | graph.Grouped, names: list[str], depth: int) -> Subgraph:
    """The shortest paths between the first two names; with one name, its paths of
    integrations and dependencies to any entity."""
    from_ = seeds(nodes, names[:1])
    paths = graph.trails(relations(edges), from_, depth, directed=False, types=["INTEGRATES_WITH", "DEPENDS_ON"])
    if len(names) > 1:
        paths = paths.join(seeds(nodes, names[1:2]).select(F.col("id").alias("end")), "end", "left_semi")
    paths = paths.orderBy("len", "nodes", "rels").limit(PAIR_PATHS if len(names) > 1 else SINGLE_PATHS)
    return _of_paths(nodes, edges, paths, trails=lambda: paths)


def workflows(nodes: DataFrame, names: list[str]) -> DataFrame:
    """Workflows, by type or by a mark in their name, that a name equals or lies within."""
    marked = F.col("entity_type") == "Workflow"
    for mark in WORKFLOW_MARKS:
        marked = marked | F.contains("name", F.lit(mark))
    hit = F.col("name").isin(names) | F.col("canonical_name").isin(names)
    for name in names:
        hit = hit | F.contains("name", F.lit(name))
    return nodes.filter(F.coalesce(marked & hit, F.lit(False))).select(F.col("entity_id").alias("id")).distinct()


def workflow(nodes: DataFrame, edges: DataFrame | graph.Grouped, names: list[str], depth: int) -> Subgraph:
    """Steps of the matching workflows, their chains from start to end, and gaps."""
    found = workflows(nodes, names)
    paths = graph.trails(edges, found, depth, least=0, types=["NEXT_STEP"])
    chains = lambda: graph.process_chains(edges, found)
    return _of_paths(nodes, edges, paths, trails=lambda: paths, chains=chains, gaps=lambda: graph.process_gaps(chains(), edges, found))


def rule(nodes: DataFrame, edges: DataFrame | graph.Grouped, names: list[str], depth: int) -> Subgraph:
    """Rules by name, or that apply to a named entity, within ``depth`` steps; all
    rules (the first by id, up to the limit) without names. ``applies`` has rule_id,
    entity_id: for a rule matched by its name all targets, else the named ones."""
    rules = nodes.filter("entity_type = 'Rule'").select(F.col("entity_id").alias("id")).distinct()
    if not names:
        chosen, others = rules.orderBy("id").limit(ALL_RULES), None
    else:
        known = seeds(nodes, names)
        chosen, others = known.join(rules, "id", "left_semi"), known.join(rules, "id", "left_anti")
    ahead = graph.trails(edges, chosen, depth, types=["APPLIES_TO"])
    applies = graph.reached(edges, chosen, depth, ["APPLIES_TO"]).select(F.col("start").alias("rule_id"), F.col("end").alias("entity_id"))
    held, ids = graph.hops_of(ahead), chosen
    if others is not None:
        behind, only = graph.turned(edges), rules.select(F.col("id").alias("end"))
        back = graph.trails(behind, others, depth, types=["APPLIES_TO"]).join(only, "end", "left_semi")
        named = graph.reached(behind, others, depth, ["APPLIES_TO"]).join(only, "end", "left_semi")
        applies = applies.unionByName(named.select(F.col("end").alias("rule_id"), F.col("start").alias("entity_id"))).distinct()
        held, ids = held.unionByName(graph.hops_of(back)), chosen.unionByName(named.select(F.col("end").alias("id")))
    ids = ids.unionByName(applies.select(F.col("entity_id").alias("id")))
    targets = applies.join(nodes.select("entity_id", "entity_type"), "entity_id")
    return _of(nodes, edges, ids, held, applies=lambda: applies, overlaps=lambda: conflicts.rule_overlaps(targets))


def conflict(nodes: DataFrame, edges: DataFrame, names: list[str]) -> Subgraph:
    """Conflicts of the named entities, or the worst of all; with kind and severity."""
    found = edges.filter("rel_type = 'CONFLICTS_WITH'")
    if names:
        known = seeds(nodes, names)
        ends = found.select("rel_id", F.explode(F.array("src", "dst")).alias("id")).join(known, "id", "left_semi").select("rel_id").distinct()
        pairs = found.join(ends, "rel_id", "left_semi")
    else:
        pairs = found
    once = pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *([F.col("reason")] if "reason" in edges.columns else [F.lit("").alias("reason")])).groupBy("src", "dst").agg(F.min("reason").alias("reason"))
    listed = conflicts.listed(once, nodes)
    if not names:
        listed = listed.orderBy(F.desc("severity_score"), "src", "dst").limit(ALL_CONFLICTS)
    ids = listed.select(F.explode(F.array("src", "dst")).alias("id"))
    ends = listed.select("src", "dst")
    both = ends.unionByName(ends.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return _of(nodes, edges, ids, found.join(both, ["src", "dst"], "left_semi"), conflicts=lambda: listed)


def _grouped(nodes: DataFrame, chunks: DataFrame, own: DataFrame) -> DataFrame:
    """doc_id, entity_id, chunk_id of the entities ``own`` and the chunks that mention them."""
    held = nodes.join(own.select(F.col("id").alias("entity_id")).distinct(), "entity_id", "left_semi")
    return held.select("entity_id", F.col("source_chunk_id").alias("chunk_id")).join(chunks.select("chunk_id", "doc_id"), "chunk_id").select("doc_id", "entity_id", "chunk_id").distinct()


def comparison(nodes: DataFrame, edges: DataFrame | graph.Grouped, chunks: DataFrame, names: list[str], depth: int) -> Subgraph:
    """Two entities, or one with all that SAME_AS joins to it in two steps, side by
    side: their surroundings, their chunks by document, the names that several of
    these documents share, and properties that differ between documents."""
    links = relations(edges)
    if len(names) < 2:
        known = seeds(nodes, names)
        same = graph.trails(links, known, 2, least=0, directed=False, types=[SAME_AS]).select(F.col("end").alias("id")).distinct()
        groups = _grouped(nodes, chunks, same)
        own = groups.select(F.col("entity_id").alias("id")).distinct()
    else:
        own = seeds(nodes, names[:2])
        groups = _grouped(nodes, chunks, own)
    paths = graph.trails(links, own, depth, directed=False)
    placed = nodes.drop("doc_id").join(groups.select("entity_id", "doc_id").distinct(), "entity_id")
    here = nodes.drop("doc_id").join(chunks.select(F.col("chunk_id").alias("source_chunk_id"), "doc_id"), "source_chunk_id").join(groups.select("doc_id").distinct(), "doc_id", "left_semi")
    pairs = lambda: seeds(nodes, names[:1]).select(F.col("id").alias("one")).crossJoin(F.broadcast(seeds(nodes, names[1:2]).select(F.col("id").alias("other"))))  # noqa: E731  (bearers of two names)
    out = _of_paths(
        nodes, edges, paths, own, groups=lambda: groups, pairs=pairs, common=lambda: conflicts.common_entities(here), differences=lambda: conflicts.value_differences(placed)
    )
    out.chunks = groups.select("chunk_id").distinct()
    return out


def general(nodes: DataFrame, edges: DataFrame | graph.Grouped, names: list[str], depth: int) -> Subgraph:
    """Named entities and the paths around them over edges of any type."""
    known = seeds(nodes, names)
    paths = graph.neighbourhood(relations(edges), known, depth).orderBy("len", "nodes", "rels").limit(GENERAL_PATHS)
    return _of_paths(nodes, edges, paths, known, trails=lambda: paths)


def retrieve(nodes: DataFrame, edges: DataFrame | graph.Grouped, chunks: DataFrame, names: list[str], pattern: str, depth: int = 3) -> Subgraph:
    """The subgraph of a question: its names and pattern choose the executor. Without
    names only rules and conflicts have an answer; the others' is empty."""
    if pattern == "rule":
        return rule(nodes, edges, names, depth)
    if pattern == "conflict":
        return conflict(nodes, edges, names)
    if pattern == "comparison" and names:
        return comparison(nodes, edges, chunks, names, depth)
    run = {"dependency": dependency, "integration": integration, "workflow": workflow}.get(pattern, general)
    return run(nodes, edges, names, depth)
