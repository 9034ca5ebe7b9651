"""Operators on small hand-made inputs with known answers."""

from __future__ import annotations

import io
import zipfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellumgrid.config import ConfigurationError, ParsingError, RetrievalError, Settings
from vellumgrid.functions import text as T
from vellumgrid.operators import answer, chunking, conflicts, entities, graph, metrics, retrieval, store
from vellumgrid.sources import documents


def value(spark, column):
    return spark.range(1).select(column.alias("x")).head().x


def test_settings_are_checked():
    with pytest.raises(ConfigurationError):
        Settings(vector_weight=0.7, graph_weight=0.4)
    with pytest.raises(ConfigurationError):
        Settings(max_depth=6)
    with pytest.raises(ConfigurationError):
        Settings(child_size=10, overlap=10)


def test_text_functions(spark):
    lit = F.lit
    assert value(spark, T.sentences(lit("One. Two!  Three? "))) == ["One.", "Two!", "Three?"]
    assert value(spark, T.bm25_tokens(lit("The NEFT system's (RTGS), Ärger 5G!"))) == ["the", "NEFT", "systems", "RTGS", "ärger", "5G"]
    assert value(spark, T.normalise_name(lit("  core  banking System"))) == "Core Banking"
    assert value(spark, T.normalise_name(lit("NEFT Module"))) == "NEFT"
    assert value(spark, T.normalise_name(lit("IMPS"))) == "IMPS"
    assert value(spark, T.mentions(lit('What does "Core Banking" need from NEFT and Core Banking?'))) == ["Core Banking", "NEFT"]
    assert value(spark, T.query_pattern(lit("What systems depend on NEFT?"))) == "dependency"
    assert value(spark, T.query_pattern(lit("Show the payment workflow"))) == "workflow"
    assert value(spark, T.query_pattern(lit("hello"))) == "general"
    assert value(spark, T.routed_mode(lit('```json\n{"mode": "graph", "confidence": 0.9}\n```'))) == "GRAPH"
    assert value(spark, T.routed_mode(lit('{"mode": "graph", "confidence": 0.5}'))) == "HYBRID"
    assert value(spark, T.routed_mode(lit("no json"))) == "HYBRID"
    assert value(spark, T.json_array(lit('so: ["a", "b"] end'))) == ["a", "b"]
    assert value(spark, T.json_array(lit("none"))) == []
    assert value(spark, T.acronym_of(lit("neft"), lit("national electronic funds transfer")))
    assert not value(spark, T.acronym_of(lit("ne"), lit("national electronic")))
    assert value(spark, T.citations(lit("a [d1:s] b [x] c [d1:s] [a:b:c] [d2:t]"))) == ["d1:s", "d2:t"]
    assert value(spark, T.claims(lit("A long enough claim [d:s]. Short. Another fine claim!"))) == ["A long enough claim", "Another fine claim"]
    assert value(spark, T.masked_connection(lit("postgresql://u:secret@h/db"))) == "postgresql://u:****@h/db"
    assert value(spark, T.ner_type(lit("MONEY"))) == "Field" and value(spark, T.ner_type(lit("??"))) == "System"


def test_similarity(spark):
    s = T.entity_similarity(F.lit("NEFT"), F.lit("NEFT System"), F.lit("NEFT"), F.lit("NEFT System"))
    assert value(spark, s) == pytest.approx(4 / 11 + 0.3)
    s = T.entity_similarity(F.lit("neft"), F.lit("national electronic funds transfer"), F.lit("neft"), F.lit("x"))
    assert 0.5 <= value(spark, s) <= 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab ,;:", min_size=1, max_size=60).filter(str.strip), max_size=12))
def test_packing_keeps_every_word(parts):
    packed = chunking.pack(parts, 8, 3)
    have = " ".join(packed).split()
    for part in parts:
        for word in part.split():
            assert word in have or any(word in h or h in word for h in have)


def test_packing_overlaps():
    a, b, c = "a" * 40, "b" * 20, "c" * 40
    assert chunking.pack([a, b, c], 16, 5) == [f"{a} {b}", f"{b} {c}"]


def test_parents_stop_at_the_limit(spark):
    rows = spark.createDataFrame([("d", "t", "s1", "h", 1, "A" * 30 + ". " + "B" * 30 + ". " + "C" * 30 + ".")], "doc_id string, title string, section_id string, heading string, level int, text string")
    got = chunking.parents(rows, Settings(parent_size=16, child_size=10, overlap=2)).head()
    assert got.text == "A" * 30 + ". " + "B" * 30 + "." and got.breadcrumbs == "t > h"
    assert chunking.parents(rows, Settings(parent_size=5, child_size=5, overlap=2)).count() == 0


def test_rrf_and_weights(spark):
    v = spark.createDataFrame([("a", 0.9, 0), ("b", 0.8, 1)], "chunk_id string, score double, rank long")
    k = spark.createDataFrame([("b", 3.0, 0)], "chunk_id string, score double, rank long")
    got = {r.chunk_id: r for r in retrieval.reciprocal_ranks(v, k).collect()}
    assert got["b"].score == pytest.approx(1 / 61 + 1 / 60, abs=1e-6) and got["b"].retrieval_source == "vector+bm25"
    assert got["a"].bm25_score == 0.0
    w = {r.chunk_id: r.combined_score for r in retrieval.weighted(v, spark.createDataFrame([("c",)], "chunk_id string")).collect()}
    assert w == {"a": 0.54, "b": 0.48, "c": 0.4}
    with pytest.raises(RetrievalError):
        retrieval.bm25_scores(v, " ")


def edges(spark, rows, kind="DEPENDS_ON"):
    return spark.createDataFrame([(f"r{k}", kind, a, b) for k, (a, b) in enumerate(rows)], "rel_id string, rel_type string, src string, dst string")


def test_trails_and_cycles(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "a")])
    seeds = spark.createDataFrame([("a",)], "id string")
    assert {tuple(r.cycle) for r in graph.cycles(e, seeds, 3).collect()} == {("a", "b", "c")}
    radius = graph.impact_radius(e, seeds, 3).head().impact_radius
    assert radius == 3
    assert graph.trails(e, seeds, 1, least=0).count() == 3
    with pytest.raises(ValueError):
        graph.trails(e, seeds, 6)


def test_process_chains_and_gaps(spark):
    e = edges(spark, [("w", "s1"), ("s1", "s2"), ("s1", "s3"), ("s3", "w")], "NEXT_STEP")
    w = spark.createDataFrame([("w",), ("alone",)], "id string")
    chains = graph.process_chains(e, w)
    got = {(r.workflow, tuple(r.path), r.branches, r.complete) for r in chains.collect()}
    assert got == {("w", ("w", "s1", "s2"), 1, True), ("w", ("w", "s1", "s3"), 1, False), ("alone", ("alone",), 0, True)}
    assert {(r.workflow, r.gap) for r in graph.process_gaps(chains, e, w).collect()} == {("w", "incomplete chain ends at s3"), ("alone", "workflow has no steps")}


def grouped(spark):
    """Rules r1, r2 on r1, r2, a, b; r3 on r3, c; and edges in rows."""
    plain = edges(spark, [("a", "c"), ("c", "d"), ("d", "a"), ("d", "d"), ("r1", "a"), ("b", "r3"), ("e", "f"), ("c", "a")])
    left = spark.createDataFrame([(1, "r1", "A_r1_"), (1, "r2", "A_r2_"), (2, "r3", "A_r3_")], "group int, node string, part string")
    right = spark.createDataFrame([(1, x, x) for x in ("r1", "r2", "a", "b")] + [(2, x, x) for x in ("r3", "c")], "group int, node string, part string")
    return graph.Grouped(plain, "APPLIES_TO", left, right)


def test_groups_give_the_trails_of_their_edges(spark):
    g = grouped(spark)
    rows = g.rows()
    assert rows.filter("rel_type = 'APPLIES_TO'").count() == 10 and rows.select("rel_id").distinct().count() == rows.count()
    seeds = spark.createDataFrame([("r1",), ("a",), ("e",)], "id string")
    plain = lambda f: sorted(map(tuple, f.collect()), key=str)
    for directed, types in ((True, None), (False, None), (True, ["APPLIES_TO"]), (False, ["DEPENDS_ON"])):
        one, two = graph.trails(g, seeds, 2, directed=directed, types=types), graph.trails(rows, seeds, 2, directed=directed, types=types)
        assert plain(one) == plain(two)
        used = two.select(F.explode("rels").alias("rel_id")).distinct()
        assert plain(g.among(graph.hops_of(two))) == plain(rows.join(used, "rel_id", "left_semi").select("rel_id", "rel_type", "src", "dst"))
    for e in (g, rows, graph.turned(g), graph.turned(rows)):
        assert plain(graph.reached(e, seeds, 2, ["APPLIES_TO"])) == plain(graph.trails(e, seeds, 2, types=["APPLIES_TO"]).select("start", "end").distinct())


def test_counts_of_near_nodes_without_their_trails(spark):
    """Against the trails themselves; sides of groups overlap, are apart, or lack a partner."""
    import random

    rnd = random.Random(5)
    names = [f"n{k}" for k in range(40)]
    for case in range(2):
        plain = edges(spark, [(rnd.choice(names), rnd.choice(names)) for _ in range(35)])
        where = {n: rnd.randrange(5) for n in names[:30]}
        one = [(g, n, f"A_{n}_") for n, g in where.items() if g and rnd.random() < 0.4]
        two = [(g, n, n) for n, g in where.items() if g and rnd.random() < (0.7 if case else 0.4)]
        side = "group int, node string, part string"
        g = graph.Grouped(plain, "APPLIES_TO", spark.createDataFrame(one, side), spark.createDataFrame(two, side))
        seeds = spark.createDataFrame([(n,) for n in [*names, "alone"]], "id string")
        want = graph.neighbourhood(g.rows(), seeds, 2).filter("start <> end").groupBy("start").agg(F.countDistinct("end").alias("n_near"), F.count("*").alias("n_paths"))
        assert sorted(map(tuple, graph.near_counts(g, seeds).collect())) == sorted(map(tuple, want.collect()))


def test_overlaps_of_grouped_rules(spark):
    g = grouped(spark)
    more = spark.createDataFrame([("x1", "APPLIES_TO", "r9", "a"), ("x2", "APPLIES_TO", "r9", "z"), ("x3", "APPLIES_TO", "r3", "z")], g.plain.schema)
    g = graph.Grouped(g.plain.unionByName(more), g.rel_type, g.left, g.right)
    nodes = spark.createDataFrame([(n, "Rule" if n[0] == "r" else "Field") for n in ("r1", "r2", "r3", "r9", "a", "b", "c", "z", "z")], "entity_id string, entity_type string")
    rules = nodes.filter("entity_type = 'Rule'").select(F.col("entity_id").alias("rule_id"))
    targets = conflicts.rule_targets(rules, g.rows(), nodes)
    got = sorted(map(tuple, conflicts.grouped_overlaps(rules, g, nodes).collect()))
    assert got == sorted(map(tuple, conflicts.rule_overlaps(targets).collect())) and len(got) == 2 + 2 + 4 + 2


def test_overlaps_of_groups_in_blocks(spark, monkeypatch, tmp_path):
    """Blocks lose no pair and repeat none, one group is dealt to several tasks, and
    the rows take a fraction of a byte where ids of over a byte recur."""
    side = "group int, node string, part string"
    none = edges(spark, []).select("rel_id", "rel_type", "src", "dst")

    def made(sizes):
        rules_ = [(g, f"r{g}_{k}") for g, (n, _) in enumerate(sizes) for k in range(n)]
        to = [(g, f"e{g}_{k}") for g, (_, n) in enumerate(sizes) for k in range(n)]
        one, two = (spark.createDataFrame([(g, n, n) for g, n in rows], side) for rows in (rules_, rules_ + to))
        nodes = spark.createDataFrame([(n, "Rule") for _, n in rules_] + [(n, "Field") for _, n in to], "entity_id string, entity_type string")
        return conflicts.grouped_overlaps(spark.createDataFrame([(n,) for _, n in rules_], "rule_id string"), graph.Grouped(none, "APPLIES_TO", one, two), nodes)

    made([(20, 1101)]).write.parquet(str(tmp_path / "out"))
    n = spark.read.parquet(str(tmp_path / "out")).count()
    assert n == 20 * 19 * 1101 and sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < n / 5
    monkeypatch.setattr(conflicts, "BLOCK", 8)
    sizes = [(50, 21), (9, 8), (1, 5), (3, 0)]
    frame = made(sizes)
    want = sorted((f"r{g}_{a}", f"r{g}_{b}", f"e{g}_{k}") for g, (m, n) in enumerate(sizes) for a in range(m) for b in range(m) if a != b for k in range(n))
    assert sorted(map(tuple, frame.collect())) == want
    assert frame.filter("rule_id like 'r0%'").select(F.spark_partition_id()).distinct().count() > 1


def test_rule_edges_where_groups_share_a_part(spark, duck, tmp_path):
    """Groups stand in for the rule edges; a key in two groups gives its edges once."""
    from vellumgrid.plans import base

    duck.sql("SELECT 0 AS doc_id").write_parquet(str(tmp_path / "documents.parquet"))
    duck.sql("""SELECT * FROM (VALUES (1, 'A', 'PROMO', 1), (2, 'A', 'LARGE', 1), (1, 'B', 'PROMO', 1), (2, 'B', 'PROMO', 1), (3, 'C', 'PROMO', 2), (3, 'C', 'LARGE', 2),
      (4, 'C', 'PROMO', 2), (5, NULL, 'PROMO', 2), (6, 'C', NULL, 2)) AS t(p_partkey, p_brand, p_type, p_size)""").write_parquet(str(tmp_path / "part.parquet"))
    sql = "WITH part AS (FROM '" + str(tmp_path / "part.parquet") + "'), " + base.EDGES + " SELECT rel_id, src, dst FROM edg WHERE rel_type = 'APPLIES_TO'"
    e = base.grouped_edges(spark, str(tmp_path))
    assert sorted(map(tuple, e.rows().filter("rel_type = 'APPLIES_TO'").select("rel_id", "src", "dst").collect())) == sorted(duck.sql(sql).fetchall())
    assert e.left.count() == 2 and e.plain.filter("rel_type = 'APPLIES_TO'").count() == 4


def test_edges_need_both_ends(spark):
    n = spark.createDataFrame([("a",), ("b",)], "entity_id string")
    assert [(r.src, r.dst) for r in graph.valid_edges(edges(spark, [("a", "b"), ("a", "b"), ("a", "x")]), n).collect()] == [("a", "b")]


def test_severity_and_rules(spark):
    level = lambda a, b, k: value(spark, conflicts.severity(F.lit(a), F.lit(b), F.lit(k)))
    assert level("System", "System", "workflow") == "critical" and level("PaymentMode", "Field", "property") == "high"
    assert level("Workflow", "Field", "property") == "medium" and level("Entity", "Entity", "property") == "low"
    rules = spark.createDataFrame([("r1", "IF amount > 1000 AND type = 'NEFT'", "specific", 1), ("r2", "IF amount > 0", "general", 1), ("r3", None, None, 2)], "rule_id string, conditions string, scope string, priority long")
    targets = spark.createDataFrame([("r1", "e1", "System"), ("r2", "e1", "Field"), ("r2", "e2", "Field")], "rule_id string, entity_id string, entity_type string")
    got = {r.rule_id: (r.specificity, r.rank) for r in conflicts.ranked_rules(conflicts.specificity(rules, targets)).collect()}
    assert got == {"r1": (24.0, 1), "r2": (10.0, 2), "r3": (4.0, 3)}
    assert conflicts.rule_overlaps(targets).count() == 2


def test_ranks_of_more_rules_than_a_sample_holds(spark):
    rules = spark.range(0, 40000, 1, 4).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("rule_id"), (F.xxhash64("id") % 5).alias("priority"), (F.xxhash64("id") % 1000 / 8.0).alias("specificity"), F.lit("general").alias("scope"))
    got = conflicts.ranked_rules(rules).collect()
    assert [r.rule_id for r in sorted(got, key=lambda r: r.rank)] == [r.rule_id for r in sorted(got, key=lambda r: (-r.specificity, -r.priority, r.rule_id))]
    assert {r.rank for r in got} == set(range(1, 40001))


def test_property_conflicts(spark):
    schema = "entity_id string, entity_type string, canonical_name string, source_chunk_id string, properties map<string,string>"
    m = spark.createDataFrame([("e1", "P", "NEFT", "c1", {"limit": "2", "aliases": "x"}), ("e2", "P", "neft", "c2", {"limit": "5", "aliases": "y"}), ("e3", "P", "RTGS", "c3", {"limit": "9"}), ("e4", "P", "NEFT", None, {"limit": "7"})], schema)
    found = conflicts.property_conflicts(m)
    assert [(r.a, r.b, r.key) for r in found.collect()] == [("e1", "e2", "limit")]
    assert conflicts.edges(found).count() == 2


def test_resolution(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "a string, b string")
    nodes = spark.createDataFrame([(i,) for i in "abcxyz"], "id string")
    got = {r.id: r.cluster for r in entities.connected(pairs, nodes).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}


def test_context_limits(spark):
    chunks = spark.createDataFrame([(0, "c1", "d", "s", "b", "x" * 40), (1, "c2", "d", "s", "b", "y" * 400)], "rank long, chunk_id string, doc_id string, section string, breadcrumbs string, text string")
    facts = spark.createDataFrame([("1", "A DEPENDS_ON B")], "ord string, fact string")
    row = answer.assembled("q", chunks, facts, Settings(max_context_tokens=60)).head()
    assert row.n_chunks == 1 and row.citations == {"d:s": "c1"} and "1. A DEPENDS_ON B [d:s]" in row.context_text
    row = answer.assembled("q", chunks, facts.limit(0)).head()
    assert row.citations == {"d:s": "c2"} and "Facts" not in row.context_text


def test_faithfulness_without_claims(spark):
    rows = spark.createDataFrame([("1", "No.", "text")], "answer_id string, answer string, context string")
    r = answer.faithfulness(rows).head()
    assert (r.total_claims, r.faithfulness_score, r.warnings) == (0, 1.0, "")


def test_store(spark, tmp_path):
    t = store.TableStore(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", "old", 1), ("b", "old", 1)], "doc_id string, title string, created long")
    t.upsert("documents", rows, "doc_id")
    t.upsert("documents", spark.createDataFrame([("a", "new", 2), ("c", "new", 2)], rows.schema), "doc_id", keep=("created",))
    assert sorted(map(tuple, t.read("documents").collect())) == [("a", "new", 1), ("b", "old", 1), ("c", "new", 2)]
    assert t.delete("documents", spark.createDataFrame([("a",), ("zz",)], "doc_id string"), "doc_id") == 1
    assert t.delete("documents", spark.createDataFrame([("zz",)], "doc_id string"), "doc_id") == 0
    t.prune("documents")
    assert t.read("documents").count() == 2
    other = store.TableStore(spark, str(tmp_path))
    number = int(t._versions("documents")[-1].split("-")[0]) + 1
    manifest = t._manifest("documents", t._versions("documents")[-1])
    t._publish("documents", number, manifest)
    with pytest.raises(store.Conflict):  # a second writer of the same number
        other._publish("documents", number, manifest)
    listed, stale = other._versions, iter([other._versions("documents")[:-1]])
    other._versions = lambda name: next(stale, None) or listed(name)  # it has seen the version before only
    other.upsert("documents", spark.createDataFrame([("d", "late", 3)], rows.schema), "doc_id")
    assert sorted(r.doc_id for r in t.read("documents").collect()) == ["b", "c", "d"]
    files = {p for p in t._manifest("documents", t._versions("documents")[-1])["parts"].values()}
    t.upsert("documents", spark.createDataFrame([("d", "again", 3)], rows.schema), "doc_id")
    assert len(files - set(t._manifest("documents", t._versions("documents")[-1])["parts"].values())) == 1  # one bucket is rewritten
    with pytest.raises(Exception, match="wrong length"):
        store.checked_vectors(spark.createDataFrame([("a", [1.0])], "chunk_id string, embedding array<double>"), 2).collect()


def _docx(paras):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paras)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_documents_source(spark, tmp_path):
    (tmp_path / "spec.docx").write_bytes(_docx([("Normal", "before"), ("Heading1", "Title here"), ("Normal", "one"), ("Normal", "two"), ("Heading2", "Part"), ("Normal", "three")]))
    page = zlib.compress(b"BT /F1 12 Tf (Hello \\(pdf\\)) Tj 0 -14 Td (second line) Tj ET")
    (tmp_path / "page.pdf").write_bytes(b"%PDF-1.4\n1 0 obj <</Length 9>>\nstream\n" + page + b"\nendstream endobj\n")
    (tmp_path / "bad.docx").write_bytes(b"nothing")
    (tmp_path / "other.txt").write_bytes(b"x")
    got = {r.doc_id: r for r in documents.read(spark, str(tmp_path)).collect()}
    assert got["spec"].title == "Title here" and [(s.section_id, s.heading, s.text) for s in got["spec"].sections] == [("s1", "Introduction", "before"), ("s2", "Title here", "one\ntwo"), ("s3", "Part", "three")]
    assert got["page"].sections[0].text == "Hello (pdf)\nsecond line" and got["page"].sections[0].page_numbers == [1]
    assert "not a .docx" in got["bad"].error and "unsupported" in got["other"].error
    with pytest.raises(ParsingError):
        documents.pdf(b"no", "x")
    cmap = b"begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <00480069> <0002> <2192> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0058> <0059>] endbfrange"
    inner = b"7 0 5 30 <</Font <</F2 5 0 R>> >>       <</Type /Font /ToUnicode 9 0 R>>"
    head = inner.index(b"<<")
    inner = b"7 0 5 %d " % (inner.index(b"<</Type") - head) + inner[head:]
    first = inner.index(b"<<")
    stream = lambda n, d, b: b"%d 0 obj <<%s /Length %d>>\nstream\n" % (n, d, len(zlib.compress(b))) + zlib.compress(b) + b"\nendstream endobj\n"
    whole = b"%PDF-1.5\n" + stream(3, b"/Type /ObjStm /N 2 /First %d" % first, inner) + stream(9, b"", cmap) + stream(4, b"", b"BT /F2 9 Tf <0001> Tj <00020010> Tj 0 -9 Td [<0012> 5 <0021>] TJ /F9 9 Tf (\\101\\(b) Tj ET")
    assert documents.pdf(whole, "x")[1][0]["text"] == "Hi\u2192a\ncYA(b"
    assert documents.heading_level("Heading 3") == 3 and documents.heading_level("Title") == 1 and documents.heading_level("Heading x") == 0


def test_alert_hold(spark):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,5*id,0) AS start, CASE WHEN id = 2 THEN 0.0 ELSE 1.0 END AS p95 FROM range(6)")
    got = metrics.alerts(rows, {"slow": ("p95", 0.5)}, 2).collect()
    assert sorted(r.start.minute for r in got) == [5, 20, 25]
    night = spark.sql("SELECT timestamp'2024-01-01 23:50:00' + make_interval(0,0,0,0,0,5*id,0) AS start, 1.0 AS p95 FROM range(5) WHERE id <> 3")
    assert sorted(r.start.minute for r in metrics.alerts(night, {"slow": ("p95", 0.5)}, 2).collect()) == [0, 55]


def test_histogram_quantile(spark):
    counts = F.array(*[F.lit(x).cast("long") for x in (10, 50, 90)])
    q = lambda p, n=100: spark.range(1).select(metrics.quantile(p, counts, F.lit(n), [1.0, 2.0, 4.0]).alias("x")).head().x
    assert [round(q(p), 6) for p in (0.05, 0.1, 0.3, 0.9, 0.95)] == [0.5, 1.0, 1.5, 4.0, 4.0]


def test_chunk_uuid(spark):
    import uuid

    ids = ["c1", "doc_s1_parent", "ünï"]
    got = spark.createDataFrame([(x,) for x in ids], "x string").select(T.chunk_uuid(F.col("x")).alias("u")).collect()
    assert [r.u for r in got] == [str(uuid.uuid5(uuid.NAMESPACE_DNS, x)) for x in ids]


def test_streaming_ingest(spark, tmp_path):
    from vellumgrid.streaming import ingest

    (tmp_path / "in").mkdir()
    t = store.TableStore(spark, str(tmp_path / "tables"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for batch in ([(1, "First text. More.", "en", "s", 1)], [(1, "Changed text.", "en", "s", 1), (2, "Other.", "en", "s", 1)]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(str(tmp_path / "in"))
        q = ingest.ingest(ingest.document_stream(spark, str(tmp_path / "in")), t, str(tmp_path / "cp"))
        q.awaitTermination(120)
    assert {r.doc_id: r.text for r in t.read("documents").collect()} == {"1": "Changed text.", "2": "Other."}
    assert t.read("ingestion_jobs").filter("status = 'completed'").count() == 2
