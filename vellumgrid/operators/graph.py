"""Property graph: building its tables, bounded paths, and what is read off them.

Nodes are (entity_id, entity_type, name, canonical_name, source_chunk_id, ...),
edges are (rel_id, rel_type, src, dst). Paths are trails: an edge occurs once in
a path, nodes may recur. Each hop is one equi-join of the open paths with the
edges, ids only; properties are joined at the end. Where many nodes each have an
edge to the same many others, ``Grouped`` keeps the two sides in place of the edges.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumgrid.operators.durable import durable, stored


@dataclass
class Grouped:
    """Edges in rows, and edges of one type by groups: every left member of a group
    has one to every right member. ``left`` and ``right`` are (group, node, part), each
    row once; the two parts make the rel_id. A node lies in one group at most, and no
    edge by groups is among the rows."""

    plain: DataFrame
    rel_type: str
    left: DataFrame
    right: DataFrame
    flipped: bool = False

    def _sides(self, onward: bool = True) -> tuple[DataFrame, DataFrame]:
        """(group, src, a) and (group, dst, b) of the edges, or of the turned ones."""
        one, other = (self.left, self.right) if onward else (self.right, self.left)
        return one.select("group", F.col("node").alias("src"), F.col("part").alias("a")), other.select("group", F.col("node").alias("dst"), F.col("part").alias("b"))

    def _id(self, onward: bool = True):
        return F.concat("a", "b") if onward != self.flipped else F.concat("b", "a")

    def _rows(self, joined: DataFrame) -> DataFrame:
        return joined.select(self._id().alias("rel_id"), F.lit(self.rel_type).alias("rel_type"), "src", "dst")

    def rows(self) -> DataFrame:
        """Every edge as a row."""
        src, dst = self._sides()
        return self.plain.select("rel_id", "rel_type", "src", "dst").unionByName(self._rows(src.join(dst, "group")))

    def turned(self) -> Grouped:
        return replace(self, plain=turned(self.plain), left=self.right, right=self.left, flipped=not self.flipped)

    def among(self, hops: DataFrame) -> DataFrame:
        """The edges that ``hops`` (rel_id, src, dst, either way round) go along."""
        hops = hops.select("rel_id", "src", "dst")
        both = hops.unionByName(hops.select("rel_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
        src, dst = self._sides()
        held = self._rows(both.withColumnRenamed("rel_id", "r").join(src, "src").join(dst, ["group", "dst"]).filter(F.col("r") == self._id())).distinct()
        return self.plain.join(hops.select("rel_id").distinct(), "rel_id", "left_semi").select("rel_id", "rel_type", "src", "dst").unionByName(held)


def turned(edges: DataFrame | Grouped) -> DataFrame | Grouped:
    """Each edge the other way round."""
    return edges.turned() if isinstance(edges, Grouped) else edges.select("rel_id", "rel_type", F.col("dst").alias("src"), F.col("src").alias("dst"))


def upsert_nodes(rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row a key; the last by ``order`` wins."""
    if order is None:
        return rows.dropDuplicates([key])
    packed = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.col(order)).alias("x"))
    return packed.select("x.*")


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes, one for each (src, rel_type, dst)."""
    ids = nodes.select(F.col("entity_id").alias("id")).distinct()
    held = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return held.groupBy("src", "rel_type", "dst").agg(F.min("rel_id").alias("rel_id")).select("rel_id", "rel_type", "src", "dst")


def mentions_edges(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk -MENTIONS-> entity, where the entity's source chunk exists."""
    pairs = entities.select(F.col("source_chunk_id").alias("chunk_id"), "entity_id").join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi").distinct()
    return pairs.select(F.concat_ws("_", F.lit("mentions"), "chunk_id", "entity_id").alias("rel_id"), F.lit("MENTIONS").alias("rel_type"), F.col("chunk_id").alias("src"), F.col("entity_id").alias("dst"))


def structure_edges(chunks: DataFrame) -> DataFrame:
    """Document -CONTAINS-> section, section -HAS_CHUNK-> chunk, parent -CONTAINS-> child."""
    section = F.concat("doc_id", F.lit("_"), F.replace(F.col("section"), F.lit(" "), F.lit("_")))
    rel = lambda t, a, b: (F.lit(t).alias("rel_type"), a.alias("src"), b.alias("dst"))
    one = chunks.select(*rel("CONTAINS", F.col("doc_id"), section)).distinct()
    two = chunks.select(*rel("HAS_CHUNK", section, F.col("chunk_id"))).distinct()
    ids = chunks.select(F.col("chunk_id").alias("parent_chunk_id")).distinct()
    three = chunks.filter("parent_chunk_id is not null").join(ids, "parent_chunk_id", "left_semi").select(*rel("CONTAINS", F.col("parent_chunk_id"), F.col("chunk_id"))).distinct()
    return one.unionByName(two).unionByName(three)


def symmetric(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, once where it is a loop."""
    back = edges.filter("src <> dst").select("rel_id", "rel_type", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("rel_id", "rel_type", "src", "dst").unionByName(back)


def trails(edges: DataFrame | Grouped, seeds: DataFrame, hops: int, least: int = 1, directed: bool = True, types: list[str] | None = None) -> DataFrame:
    """start, end, len, nodes, rels of every trail of ``least`` to ``hops`` edges
    from the seeds (a column ``id``)."""
    if not 1 <= hops <= 5:
        raise ValueError("hops must lie between 1 and 5")
    grouped = edges if isinstance(edges, Grouped) and (not types or edges.rel_type in types) else None
    edges = edges.plain if isinstance(edges, Grouped) else edges
    if types:
        edges = edges.filter(F.col("rel_type").isin(types))
    steps = (edges if directed else symmetric(edges)).select(F.col("rel_id").alias("r"), "src", "dst")
    none = F.array().cast("array<string>")
    open_ = seeds.select(F.col("id").alias("start"), F.col("id").alias("end"), F.array("id").alias("nodes"), none.alias("rels")).distinct()
    found = [open_] if least == 0 else []
    held = ["start", "nodes", "rels", "r", "dst"]
    for hop in range(1, hops + 1):
        met = open_.join(steps, open_.end == steps.src).select(*held)
        for onward in (True,) if directed else (True, False):
            if grouped:
                src, dst = grouped._sides(onward)
                through = open_.join(src, open_.end == src.src).join(dst, "group").withColumn("r", grouped._id(onward))
                met = met.unionByName((through if onward else through.filter("src <> dst")).select(*held))
        open_ = met.filter(~F.array_contains("rels", F.col("r"))).select(
            "start", F.col("dst").alias("end"), F.array_append("nodes", F.col("dst")).alias("nodes"), F.array_append("rels", F.col("r")).alias("rels")
        )
        if hop >= least:
            found.append(open_)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("start", "end", F.size("rels").cast("long").alias("len"), "nodes", "rels")


def reached(edges: DataFrame | Grouped, seeds: DataFrame, hops: int, types: list[str]) -> DataFrame:
    """start and end of the trails of 1 to ``hops`` directed edges, each pair once.
    Pairs are deduplicated hop by hop, through groups as (start, group), so trails
    aren't enumerated. A walk that repeats an edge holds a shorter one that doesn't,
    with the same ends."""
    grouped = edges if isinstance(edges, Grouped) and edges.rel_type in types else None
    plain = edges.plain if isinstance(edges, Grouped) else edges
    steps = plain.filter(F.col("rel_type").isin(types)).select(F.col("src").alias("at"), F.col("dst").alias("end")).distinct()
    front = seeds.select(F.col("id").alias("start"), F.col("id").alias("at")).distinct()
    out = None
    for _ in range(hops):
        met = front.join(steps, "at").select("start", "end")
        if grouped:
            src, dst = grouped._sides()
            met = met.unionByName(front.join(src, front.at == src.src).select("start", "group").distinct().join(dst, "group").select("start", F.col("dst").alias("end")))
        met = met.distinct()
        out = met if out is None else out.unionByName(met)
        front = met.withColumnRenamed("end", "at")
    return out.distinct()


def hops_of(paths: DataFrame) -> DataFrame:
    """rel_id, src, dst of the steps of paths, each once."""
    at = F.posexplode("rels").alias("i", "rel_id")
    return paths.select("nodes", at).select("rel_id", F.element_at("nodes", F.col("i") + 1).alias("src"), F.element_at("nodes", F.col("i") + 2).alias("dst")).distinct()


def dependencies(edges: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """Forward and backward DEPENDS_ON trails of the seeds, with their direction."""
    ahead = trails(edges, seeds, hops, types=["DEPENDS_ON"]).withColumn("direction", F.lit("forward"))
    behind = trails(turned(edges), seeds, hops, types=["DEPENDS_ON"]).withColumn("direction", F.lit("backward"))
    return ahead.unionByName(behind)


def impact_radius(edges: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """id and the number of distinct nodes that depend on it or that it depends
    on, itself counted. Reached nodes are deduplicated hop by hop, so paths are
    not enumerated."""
    deps = edges.filter("rel_type = 'DEPENDS_ON'")
    reached = []
    for src, dst in (("src", "dst"), ("dst", "src")):
        steps = deps.select(F.col(src).alias("at"), F.col(dst).alias("to")).distinct()
        front = seeds.select("id", F.col("id").alias("at")).distinct()
        reached.append(front)
        for _ in range(hops):
            front = front.join(steps, "at").select("id", F.col("to").alias("at")).distinct()
            reached.append(front)
    every = reached[0]
    for more in reached[1:]:
        every = every.unionByName(more)
    return every.distinct().groupBy("id").agg(F.count("*").alias("impact_radius"))


def cycles(edges: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """Circular dependencies through a seed: its distinct nodes in order. Loops of
    one node are left out."""
    closed = trails(edges, seeds, hops, types=["DEPENDS_ON"]).filter("start = end")
    return closed.select("start", F.array_distinct("nodes").alias("cycle")).filter(F.size("cycle") > 1).distinct()


def integration_paths(edges: DataFrame, one: str, other: str, hops: int = 3, most: int = 10) -> DataFrame:
    """The shortest undirected paths between two nodes."""
    seeds = edges.sparkSession.createDataFrame([(one,)], "id string")
    paths = trails(edges, seeds, hops, directed=False, types=["INTEGRATES_WITH", "DEPENDS_ON"]).filter(F.col("end") == other)
    return paths.orderBy("len", "nodes", "rels").limit(most)


def neighbourhood(edges: DataFrame | Grouped, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """Undirected trails of any type."""
    return trails(edges, seeds, hops, directed=False)


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, kept, with numbers ``k`` from 1 on."""
    placed = stored(rows.withColumn("m", F.monotonically_increasing_id()).withColumn("p", F.shiftright("m", 33)), name)
    sizes = placed.groupBy("p").agg(F.count("*").alias("n"))  # a row a partition
    before = sizes.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(before), "p").withColumn("k", F.col("before") + F.col("m").bitwiseAND((1 << 33) - 1) + 1).drop("m", "p", "before")


def near_counts(edges: Grouped, seeds: DataFrame) -> DataFrame:
    """start, n_near, n_paths: of the undirected trails of one and two edges of any
    type from each seed to another node, the number of distinct ends, and of trails.
    Exact, and neither trails nor edges by groups are enumerated.

    With d(m) the edges at m, loops once, the trails of two edges are the loops at v
    times its other edges, and for each edge to another m d(m) less the edges that lead
    back; groups add their sums. Ends are a group's members, where v has an edge in it,
    counted whole; the members that neighbours over plain edges have in their groups,
    whole too; the plain neighbours of v's neighbours in its group, the same for all
    its members of a kind; and the rest, v's plain neighbours and theirs, row by row.
    A node is one long: its group's number, its own, and whether it is left, right."""
    plain = edges.plain.filter("src is not null and dst is not null").select("src", "dst")
    wanted = seeds.filter("id is not null").select("id").distinct()
    sides = edges.left.select("group", F.col("node").alias("id"), F.lit(2).alias("side")).unionByName(edges.right.select("group", F.col("node").alias("id"), F.lit(1).alias("side")))
    sides = sides.filter("id is not null").groupBy("group", "id").agg(F.bit_or("side").alias("side"))
    groups = _numbered(sides.select("group").distinct(), "groups").withColumnRenamed("k", "g")
    placed = sides.join(groups, "group").select("id", "g", "side")
    every = wanted.unionByName(plain.select(F.col("src").alias("id"))).unionByName(plain.select(F.col("dst").alias("id"))).unionByName(placed.select("id")).distinct()
    known = every.join(placed, "id", "left").join(wanted.withColumn("wanted", F.lit(True)), "id", "left")
    code = F.shiftleft(F.coalesce("g", F.lit(0)).cast("long"), 34).bitwiseOR(F.shiftleft(F.col("k").cast("long"), 2)).bitwiseOR(F.coalesce("side", F.lit(0)).cast("long"))
    nodes = stored(_numbered(known, "numbered").select("id", code.alias("v"), F.coalesce("wanted", F.lit(False)).alias("wanted")), "nodes")
    group = lambda c: F.shiftright(F.col(c) if isinstance(c, str) else c, 34)
    left = lambda c: F.shiftright(F.col(c) if isinstance(c, str) else c, 1).bitwiseAND(1)
    right = lambda c: (F.col(c) if isinstance(c, str) else c).bitwiseAND(F.lit(1).cast("long"))
    half = plain.join(nodes.select(F.col("id").alias("src"), F.col("v").alias("a")), "src").join(nodes.select(F.col("id").alias("dst"), F.col("v").alias("b")), "dst").select("a", "b")
    ways = half.select(F.col("a").alias("v"), F.col("b").alias("m")).unionByName(half.filter("a <> b").select(F.col("b").alias("v"), F.col("a").alias("m")))
    pairs = stored(ways.groupBy("v", "m").agg(F.count("*").alias("c")), "pairs")  # loops once
    apart = pairs.filter("v <> m")
    met = F.when((group("v") > 0) & (group("v") == group("m")), left("v") * right("m") + left("m") * right("v")).otherwise(0)  # edges by groups between v and m
    own = apart.groupBy("v").agg(F.sum("c").alias("p"), F.sum(F.col("c") * F.col("c") + 2 * F.col("c") * met).alias("back"), F.collect_list("m").alias("near"))
    size = nodes.filter(group("v") > 0).groupBy(group("v").alias("g")).agg(F.sum(left("v")).alias("nl"), F.sum(right("v")).alias("nr"), F.sum(left("v") * right("v")).alias("nb"))
    x = nodes.join(own, "v", "left").join(pairs.filter("v = m").select("v", F.col("c").alias("loops")), "v", "left").join(size.withColumnRenamed("g", "h"), group("v") == F.col("h"), "left").drop("h")
    x = x.fillna(0, ["p", "back", "loops", "nl", "nr", "nb"]).withColumn("l", left("v")).withColumn("r", right("v"))
    by = F.col("l") * (F.col("nr") - F.col("r")) + F.col("r") * (F.col("nl") - F.col("l"))
    x = x.withColumn("others", F.col("p") + by).withColumn("loops", F.col("loops") + F.col("l") * F.col("r")).withColumn("d", F.col("others") + F.col("loops"))
    both, lone, rone = F.col("nb") - F.col("l") * F.col("r"), F.col("nl") - F.col("nb") - F.col("l") * (1 - F.col("r")), F.col("nr") - F.col("nb") - F.col("r") * (1 - F.col("l"))
    x = x.withColumn("back", F.col("back") + F.when(F.col("l") + F.col("r") > 0, (F.col("l") + F.col("r")) * (F.col("l") + F.col("r")) * both + F.col("r") * lone + F.col("l") * rone).otherwise(0))
    x = stored(x.withColumn("inside", (F.col("l") * F.col("nr") + F.col("r") * F.col("nl")) > 0), "degrees")
    sums = x.filter(group("v") > 0).groupBy(group("v").alias("h")).agg(F.sum(F.col("l") * F.col("d")).alias("dl"), F.sum(F.col("r") * F.col("d")).alias("dr"))
    two = apart.join(x.select(F.col("v").alias("m"), F.col("near").alias("far"), "d"), "m").groupBy("v").agg(F.sum(F.col("c") * F.col("d")).alias("pd"), F.collect_list(F.coalesce("far", F.array().cast("array<bigint>"))).alias("far"))
    x = x.filter("wanted").join(two, "v", "left").join(sums, group("v") == F.col("h"), "left").drop("h").fillna(0, ["pd", "dl", "dr"])
    through = F.col("l") * (F.col("dr") - F.col("r") * F.col("d")) + F.col("r") * (F.col("dl") - F.col("l") * F.col("d"))
    paths = F.col("others") + F.col("loops") * F.col("others") + F.col("pd") + through - F.col("back")
    empty = F.array().cast("array<bigint>")
    near = F.coalesce("near", empty)
    kind = F.when(F.col("inside"), group("v") * 4 + F.col("l") * 2 + F.col("r"))
    mine = F.when(F.col("inside"), group("v")).otherwise(-1)
    whole = lambda side: F.array_distinct(F.transform(F.filter(near, lambda u: (group(u) > 0) & (group(u) != mine) & (side(u) > 0)), group))
    x = stored(
        x.select("id", "v", paths.alias("n_paths"), kind.alias("kind"), mine.alias("mine"), F.when(F.col("inside"), F.col("nl") + F.col("nr") - F.col("nb") - 1).otherwise(0).alias("members"),
                 whole(left).alias("rights"), whole(right).alias("lefts"), F.array_distinct(F.concat(near, F.flatten(F.coalesce("far", F.array().cast("array<array<bigint>>"))))).alias("ends")), "ends")
    # plain neighbours of a group's members, outside of the group: of the right ones for kinds with left, of the left ones for kinds with right
    kinds = x.filter("kind is not null").select("kind").distinct()
    of = F.filter(F.array(F.when(left("v") > 0, 1), F.lit(2) * right("v"), F.lit(3)), lambda k: k > 0)
    beside = apart.filter((group("v") > 0) & (group("v") != group("m"))).select(F.explode(F.transform(of, lambda k: group("v") * 4 + k)).alias("kind"), F.col("m").alias("w"))
    beside = stored(beside.join(kinds, "kind", "left_semi").distinct(), "beside")
    spots = beside.groupBy("kind", group("w").alias("h")).agg(F.count("*").alias("n"), F.sum(left("w")).alias("ln"), F.sum(right("w")).alias("rn"), F.sum(left("w") * right("w")).alias("bn"))
    total = beside.groupBy("kind").agg(F.count("*").alias("shared"))
    def held(l, r, b):  # noqa: E306  (members of a group taken whole, by its left and right sides)
        return F.when(F.col("hr") & F.col("hl"), F.col(l) + F.col(r) - F.col(b)).when(F.col("hr"), F.col(r)).otherwise(F.col(l))
    seen = x.select("v", "kind", F.explode(F.array_union("rights", "lefts")).alias("h"), "rights", "lefts").select("v", "kind", "h", F.array_contains("rights", F.col("h")).alias("hr"), F.array_contains("lefts", F.col("h")).alias("hl"))
    # a left neighbour has the right side, a right one the left side
    seen = seen.join(size.withColumnRenamed("g", "h"), "h").join(spots, ["kind", "h"], "left").fillna(0, ["ln", "rn", "bn"])
    seen = seen.groupBy("v").agg(F.sum(held("nl", "nr", "nb") - held("ln", "rn", "bn")).alias("whole"))
    rest = x.select("v", "kind", "mine", "rights", "lefts", F.explode("ends").alias("w")).filter("v <> w").filter(group("w") != F.col("mine"))
    covered = ((right("w") > 0) & F.array_contains("rights", group("w"))) | ((left("w") > 0) & F.array_contains("lefts", group("w")))
    rest = rest.filter(~covered).select("v", "kind", "w").join(beside, ["kind", "w"], "left_anti").groupBy("v").agg(F.count("*").alias("single"))
    out = x.select("id", "v", "kind", "members", "n_paths").join(seen, "v", "left").join(rest, "v", "left").join(total, "kind", "left").fillna(0, ["whole", "single", "shared"])
    return out.select(F.col("id").alias("start"), (F.col("members") + F.col("whole") + F.col("shared") + F.col("single")).cast("long").alias("n_near"), F.col("n_paths").cast("long").alias("n_paths")).filter("n_near > 0")


def process_chains(steps: DataFrame, workflows: DataFrame, depth: int = 20) -> DataFrame:
    """Every simple path of NEXT_STEP edges from a workflow (column ``id``) to a
    step without a successor (complete), or to a repeat or the depth limit
    (incomplete), with the number of its branch points."""
    nexts = durable(steps.filter("rel_type = 'NEXT_STEP'").select(F.col("src").alias("at"), F.col("dst").alias("to")).distinct())
    degree = nexts.groupBy("at").agg(F.count("*").alias("out"))
    open_ = workflows.select(F.col("id").alias("workflow"), F.col("id").alias("at"), F.array("id").alias("path"), F.lit(0).cast("long").alias("branches")).distinct()
    done = []
    for _ in range(depth):
        open_ = durable(open_)
        if open_.isEmpty():
            break
        forked = open_.join(degree, "at", "left").withColumn("branches", F.col("branches") + F.when(F.col("out") > 1, 1).otherwise(0))
        done.append(forked.filter("out is null").select("workflow", "path", "branches", F.lit(True).alias("complete")))
        further = forked.filter("out is not null").join(nexts, "at")
        done.append(further.filter(F.array_contains("path", F.col("to"))).select("workflow", "path", "branches", F.lit(False).alias("complete")).distinct())
        open_ = further.filter(~F.array_contains("path", F.col("to"))).select("workflow", F.col("to").alias("at"), F.array_append("path", F.col("to")).alias("path"), "branches")
    done.append(open_.select("workflow", "path", "branches", F.lit(False).alias("complete")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def process_gaps(chains: DataFrame, steps: DataFrame, workflows: DataFrame) -> DataFrame:
    """workflow and message: chains cut short, and workflows without a step."""
    short = chains.filter("not complete").select("workflow", F.concat(F.lit("incomplete chain ends at "), F.element_at("path", -1)).alias("gap"))
    linked = steps.filter("rel_type = 'NEXT_STEP'").select(F.col("src").alias("id")).distinct()
    alone = workflows.select("id").distinct().join(linked, "id", "left_anti").select(F.col("id").alias("workflow"), F.lit("workflow has no steps").alias("gap"))
    return short.distinct().unionByName(alone)


def path_parts(paths: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The distinct nodes, relationships and source chunks of paths."""
    ids = paths.select(F.explode("nodes").alias("entity_id")).distinct()
    rels = paths.select(F.explode("rels").alias("rel_id")).distinct()
    held = nodes.join(ids, "entity_id", "left_semi")
    return held, edges.join(rels, "rel_id", "left_semi"), held.select(F.col("source_chunk_id").alias("chunk_id")).filter("chunk_id is not null").distinct()


def facts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A sentence for each edge whose ends exist; conflicts carry their reason."""
    names = nodes.select(F.col("entity_id").alias("id"), "canonical_name")
    a, b = names.select(F.col("id").alias("src"), F.col("canonical_name").alias("a")), names.select(F.col("id").alias("dst"), F.col("canonical_name").alias("b"))
    reason = F.col("reason") if "reason" in edges.columns else F.lit(None).cast("string")
    tail = F.when((F.col("rel_type") == "CONFLICTS_WITH") & reason.isNotNull(), F.concat(F.lit(" (reason: "), reason, F.lit(")"))).otherwise("")
    return edges.join(a, "src").join(b, "dst").select("rel_id", F.concat("a", F.lit(" "), "rel_type", F.lit(" "), "b", tail).alias("fact"))


def named(nodes: DataFrame, names: list[str]) -> DataFrame:
    """Nodes whose name or canonical name is one of a question's names: a union of two equi-filters."""
    return nodes.filter(F.col("name").isin(names)).unionByName(nodes.filter(F.col("canonical_name").isin(names) & ~F.coalesce(F.col("name").isin(names), F.lit(False))))
