"""Ingest and query from end to end, and the model adapters."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vellumgrid.config import EngineError, RetrievalError, Settings
from vellumgrid.operators import adapters
from vellumgrid.plans.engine import Engine

SECTIONS = [
    ("doc1", "NEFT Spec", "s1", "Overview", 1, "NEFT is a payment mode for retail transfers. It depends on Core Banking for settlement."),
    ("doc1", "NEFT Spec", "s2", "Limits", 2, "The NEFT limit is two lakhs for each day."),
    ("doc2", "RTGS Spec", "s1", "Overview", 1, "RTGS settles large value transfers at once."),
]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("engine")), Settings(similarity_threshold=0.2))
    rows = spark.createDataFrame(SECTIONS, "doc_id string, title string, section_id string, heading string, level int, text string")
    job = e.ingest(rows, "j1").head()
    assert (job.status, job.parents, job.children, job.error) == ("completed", 3, 3, None)
    return e


def test_keyword_question(engine):
    r = engine.query("What is the NEFT limit?").head()
    assert "two lakhs" in r.answer and r.mode == "HYBRID" and r.faithfulness_score == 1.0
    assert "doc1:Limits" in r.citations and set(r.citations_used) <= set(r.citations)


def test_modes(engine):
    assert engine.query("limit of transfers", "VECTOR").head().mode == "VECTOR"
    r = engine.query("What systems depend on NEFT?").head()
    assert r.mode == "GRAPH" and r.pattern == "dependency" and "NEFT" in r.context_text
    with pytest.raises(RetrievalError):
        engine.query("  ")
    with pytest.raises(EngineError):
        engine.query("x", "OTHER")


def test_repeated_ingest_changes_nothing(engine, spark):
    rows = spark.createDataFrame(SECTIONS, "doc_id string, title string, section_id string, heading string, level int, text string")
    assert engine.ingest(rows, "j2").head().children == 3


def test_background_jobs(engine, spark):
    schema = "doc_id string, title string, section_id string, heading string, level int, text string"
    jobs = [engine.submit(spark.createDataFrame([(f"bg{k}", "Spec", "s1", "Overview", 1, f"Background text number {k}.")], schema), f"bg{k}") for k in range(2)]
    assert engine.job("bg1").head().status in ("pending", "completed")
    assert [j.result(300).head().status for j in jobs] == ["completed", "completed"]
    assert engine.job("bg1").head().status == "completed"
    assert {"bg0", "bg1"} <= {r.doc_id for r in engine.store.read("chunks").collect()}


def test_adapters(spark):
    upper = adapters.vectorised(lambda xs: [x.upper() for x in xs], "string")
    assert spark.range(1).select(upper(F.lit("a")).alias("x")).head().x == "A"

    def broken(xs, ys):
        raise OSError("gone")

    score = adapters.vectorised(broken, "double", 0.0, attempts=2, first=0.0)
    assert spark.range(1).select(score(F.lit("a"), F.lit("b")).alias("x")).head().x == 0.0
    waits = adapters.pauses(5, 1.0, 2.0, 3.0, random.Random(1))
    assert len(waits) == 4 and all(0.5 <= w <= 4.5 for w in waits)
    calls = []
    assert adapters.cached(lambda x: calls.append(x) or x)([1, 1, 2]) == [1, 1, 2] and calls == [1, 2]


def test_adapter_isolates_failing_rows(spark):
    def picky(xs):
        if any("bad" in x for x in xs):
            raise OSError("refused")
        return [x.upper() for x in xs]

    safe = adapters.vectorised(picky, "string", "?", attempts=1)
    rows = spark.createDataFrame([(k, "bad" if k == 5 else f"v{k}") for k in range(9)], "k int, v string").coalesce(1)
    assert [r.x for r in rows.select("k", safe("v").alias("x")).orderBy("k").collect()] == ["?" if k == 5 else f"V{k}" for k in range(9)]


def test_batches_and_sizes():
    calls = []
    assert adapters.batched(lambda xs: calls.append(len(xs)) or [2 * x for x in xs], 4)(list(range(10))) == [2 * x for x in range(10)]
    assert calls == [4, 4, 2]
    assert [adapters.adaptive_size(t, 2.0, 10, 100) for t in (0.0, 0.1, 1.0, 40.0)] == [100, 100, 20, 10]


def test_index_and_degradation(engine, spark):
    asked = "NEFT limit of two lakhs"
    from vellumgrid.operators import retrieval

    chunks = engine.store.read("chunks")
    whole = {r.chunk_id: r.score for r in retrieval.bm25_scores(chunks, asked, include_zero=True).collect()}
    assert {r.chunk_id: r.score for r in engine.index.scores(asked, include_zero=True).collect()} == whole and len(whole) == chunks.count()
    assert {r.chunk_id: r.score for r in engine.index.scores(asked).collect()} == {c: s for c, s in whole.items() if s}
    kept, engine.index = engine.index, retrieval.KeywordIndex(spark, engine.store.root + "/nowhere")
    try:
        r = engine.query("What is the NEFT limit?").head()
        assert r.answer and engine.degraded
    finally:
        engine.index = kept
    log = engine.store.log("requests")
    assert log.filter("degraded is not null").count() == 1 and log.filter("error like 'RetrievalError%'").count() >= 1


def test_graph_patterns(spark):
    from vellumgrid.operators import graph_retrieval as R

    names = ["A", "B", "C", "Pay Flow", "Step", "Rule X", "Rule Y"]
    kinds = ["System", "System", "PaymentMode", "Entity", "Entity", "Rule", "Rule"]
    nodes = spark.createDataFrame([(n, k, n, n.upper(), f"c{i}", {"limit": str(i)}) for i, (n, k) in enumerate(zip(names, kinds, strict=True))], "entity_id string, entity_type string, name string, canonical_name string, source_chunk_id string, properties map<string,string>")
    links = [("DEPENDS_ON", "A", "B"), ("INTEGRATES_WITH", "B", "C"), ("NEXT_STEP", "Pay Flow", "Step"), ("APPLIES_TO", "Rule X", "Rule Y"), ("APPLIES_TO", "Rule Y", "A"), ("CONFLICTS_WITH", "A", "C"), ("CONFLICTS_WITH", "C", "A"), ("SAME_AS", "B", "A"), ("MENTIONS", "c0", "A")]
    edges = spark.createDataFrame([(f"{t}-{a}-{b}", t, a, b, "limit: 0 vs 2") for t, a, b in links], "rel_id string, rel_type string, src string, dst string, reason string")
    chunks = spark.createDataFrame([(f"c{i}", f"d{i % 2}") for i in range(7)], "chunk_id string, doc_id string")
    ask = lambda pattern, *asked, depth=2: R.retrieve(nodes, edges, chunks, list(asked), pattern, depth)
    ids = lambda sub: {r.entity_id for r in sub.nodes.collect()}
    assert ids(ask("dependency", "A")) == {"A", "B"} and ask("dependency", "A").get("impact").head().impact_radius == 2
    assert ids(ask("integration", "A", "C")) == {"A", "B", "C"} and ids(ask("integration", "A", depth=1)) == {"A", "B"}
    flow = ask("workflow", "Pay")
    assert ids(flow) == {"Pay Flow", "Step"} and [r.path for r in flow.get("chains").collect()] == [["Pay Flow", "Step"]] and flow.get("gaps").count() == 0
    applies = lambda *asked: {(r.rule_id, r.entity_id) for r in ask("rule", *asked).get("applies").collect()}
    assert applies("Rule X") == {("Rule X", "Rule Y"), ("Rule X", "A")} and applies("A") == {("Rule Y", "A"), ("Rule X", "A")}
    assert applies() == {("Rule X", "Rule Y"), ("Rule X", "A"), ("Rule Y", "A")}
    for found in (ask("conflict"), ask("conflict", "C")):
        assert [(r.src, r.dst, r.severity) for r in found.get("conflicts").collect()] == [("A", "C", "high")] and ids(found) == {"A", "C"}
    assert ask("conflict", "B").get("conflicts").count() == 0
    one = ask("comparison", "A", depth=1)
    assert {(r.doc_id, r.entity_id) for r in one.get("groups").collect()} == {("d0", "A"), ("d1", "B")}
    two = ask("comparison", "A", "B", depth=1)
    assert [(r.one, r.other) for r in two.get("pairs").collect()] == [("A", "B")] and {r.chunk_id for r in two.chunks.collect()} == {"c0", "c1"}
    assert ids(ask("general", "STEP")) == {"Pay Flow", "Step"} and ids(ask("general")) == set() == ids(ask("comparison"))


def test_typed_entities(spark):
    from vellumgrid.operators import entities

    text = "NEFT Module moved Rs 500 on 2024-05-06. The Limit Rule holds."
    rows = spark.createDataFrame([("c1", text)], "chunk_id string, text string")
    got = {r.name: r.entity_type for r in entities.extract(rows).collect()}
    assert got["NEFT"] == "System" and got["Rs 500"] == "Field" and got["2024-05-06"] == "Field" and got["The Limit Rule"] == "Rule"
    reply = '```json\n[{"name": "NEFT", "type": "PaymentMode", "properties": {"limit": "2"}}, {"name": "Odd", "type": "Thing"}, {"type": "Rule"}]\n```'
    made = entities.from_replies(spark.createDataFrame([("c1", text, reply), ("c2", text, "no json")], "chunk_id string, text string, reply string")).collect()
    assert {(r.name, r.entity_type, r.properties.get("limit")) for r in made} == {("NEFT", "PaymentMode", "2"), ("Odd", "System", None)}


def test_similar_pairs_miss_none(spark):
    import itertools
    import random as rnd

    from vellumgrid.functions import text as T
    from vellumgrid.operators import entities

    r = rnd.Random(4)
    base = ["Settlement", "Zettlement", "core banking system", "cbs", "Core Banking", "a", "ab", "NEFT", "NEFT System", "national electronic funds transfer", "payment gateway", "payment gatewai", "paymnt gateway"]
    names = sorted({*base, *["".join(r.choice("abc ") for _ in range(r.randint(1, 9))).strip() or "x" for _ in range(40)]})
    frame = spark.createDataFrame([("System", n, n) for n in names], "entity_type string, canonical_name string, name string")
    every = spark.createDataFrame(list(itertools.combinations(names, 2)), "a string, b string").select("a", "b", F.round(T.entity_similarity(F.col("a"), F.col("b"), F.col("a"), F.col("b")), 6).alias("s"))
    scores = {(x.a, x.b): x.s for x in every.collect()}
    for least in (0.85, 0.6):
        got = {tuple(sorted((x.ca, x.cb))): x.similarity for x in entities.similar_pairs(frame, least).collect()}
        assert got == {p: s for p, s in scores.items() if s >= least}
    assert ("Settlement", "Zettlement") in {p for p, s in scores.items() if s >= 0.85}


def test_streaming_isolates_a_bad_document(spark, tmp_path):
    from vellumgrid.operators import chunking, store
    from vellumgrid.streaming import ingest

    def chunker(rows, settings):
        bad = F.when(F.contains("text", F.lit("POISON")), F.raise_error(F.lit("cannot be parsed")).cast("string")).otherwise(F.col("text"))
        return chunking.chunks(rows.withColumn("text", bad), settings)

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(k, "POISON" if k == 3 else f"Text {k}.", "en", "s", 1) for k in range(6)], schema).write.parquet(str(tmp_path / "in"))
    t = store.TableStore(spark, str(tmp_path / "tables"))
    ingest.ingest(ingest.document_stream(spark, str(tmp_path / "in")), t, str(tmp_path / "cp"), chunker=chunker).awaitTermination(240)
    job = t.read("ingestion_jobs").head()
    assert job.status == "completed with errors" and job.error.startswith("3: ") and job.documents == 6
    assert {r.doc_id for r in t.read("chunks").collect()} == {"0", "1", "2", "4", "5"}
