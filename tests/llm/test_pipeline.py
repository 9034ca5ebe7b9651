"""Each stage of the pipeline against brute force or SQL, on its own input."""

from __future__ import annotations

import pytest

from vellumgrid.llm import common, decontamination, line_templates, near_duplicates
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_near_duplicates import brute as duplicates

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline

    docs, out = common.table(spark, SMALL, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        new = common.materialise(stage(spark, docs, SMALL), f"test-{name}")
        out.append((name, docs, new))
        docs = new
    return {name: (old, new) for name, old, new in out}


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_columns(stages):
    for name, (_, new) in stages.items():
        assert name == "pieces" or new.columns == common.DOC_COLUMNS


def test_language_keeps_clean_documents(stages):
    old, new = map(texts, stages["language"])
    assert {d: t for d, t in old.items() if any(c.isalpha() for c in t)} == new


def test_lines(stages, duck):
    old, new = stages["line_dedup"]
    have = old.toPandas()  # noqa: F841
    duck.execute("CREATE OR REPLACE TEMP TABLE stage_docs AS SELECT * FROM have")
    rows = duck.sql(line_templates.ORACLE.replace("FROM documents", "FROM stage_docs")).fetchall()
    assert texts(new) == {d: t for d, _, n, t in rows if n == 0 or t.strip()}
    assert all(r.n_chars == len(r.text) for r in new.collect())


def test_near_duplicates(stages):
    old, new = map(texts, stages["near_duplicates"])
    classes = duplicates(list(old.items()))
    assert new == {d: t for d, t in old.items() if classes[d] == d}


def test_decontamination(stages, spark):
    old, new = map(texts, stages["decontamination"])
    items = [(r.item_id, r.text) for r in common.table(spark, SMALL, "benchmark").collect()]
    bad = {d for d, _ in leaks(list(old.items()), items)}
    assert new == {d: t for d, t in old.items() if d not in bad}


def test_pieces(stages):
    old, new = stages["pieces"]
    rows = new.collect()
    assert {r.doc_id for r in rows} == set(texts(old)) and all(r.round_trip for r in rows)


def test_rows_without_ids(spark):
    """They are compared, kept and left out like the rest."""
    item = common.table(spark, SMALL, "benchmark").filter("text is not null").orderBy("item_id").head().text
    text = lambda c: " ".join(f"{c}{j}" for j in range(60))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (None, text("b") + " more"), (1, text("c")), (None, text("c") + " more"), (None, item)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    once = near_duplicates.stage(spark, docs, SMALL)
    found = sorted((r.doc_id or 0, r.text[:2]) for r in once.collect())
    assert found == sorted([(0, "a0"), (0, "b0"), (1, "c0"), (0, item[:2])])
    assert sorted(r.text[:2] for r in decontamination.stage(spark, once, SMALL).collect()) == ["a0", "b0", "c0"]


def test_shared_ids_are_judged_by_text(spark):
    item = common.table(spark, SMALL, "benchmark").filter("text is not null").orderBy("item_id").head().text
    rows = [(1, "clean words " * 20), (1, f"before {item} after"), (1, f"before {item} after"), (2, "clean words " * 20), (None, f"{item}"), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(((r.doc_id, r.text) for r in decontamination.stage(spark, docs, SMALL).collect()), key=str) == sorted([rows[0], rows[3], rows[5]], key=str)
