from __future__ import annotations

import math
import operator

import numpy as np
import pytest

from vellumgrid.llm import vector_search


def brute(rows, queries, k):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    out = []
    for q in queries:
        qv = min(v for i, v in whole if i == q)
        best = [(-sum(map(operator.mul, qv, v)), i) for i, v in whole if i != q and len(v) == len(qv)]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(best)[:k], 1)]
    return sorted(out)


def answers(frame):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in frame.collect())


def test_matches_sql(same):
    same(vector_search.query, vector_search.ORACLE)


@pytest.mark.parametrize("block", [3, 2048])
def test_brute_force_with_ties_and_copies(spark, block):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(120)]
    rows += [(200 + i, rows[7][1]) for i in range(30)] + [(5, rows[5][1]), (9, rows[3][1])]
    docs = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<double>, id int, score int, cells int").repartition(5)
    asked = docs.filter("vec_id % 10 = 0 or vec_id = 9")
    assert answers(vector_search.top_k(docs, asked, 5, block, rows=16)) == brute(rows, {i for i, _ in rows if i % 10 == 0 or i == 9}, 5)


def test_edges(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (50, [1.0, 0.5]), (6, [1.0]), (None, [1.0, 1.0])]
    docs = spark.createDataFrame(rows, schema)
    got = answers(vector_search.top_k(docs, docs.filter("vec_id % 50 = 0")))
    assert got == [(0, 1, 50, 256 * 256 + 512 * 128), (50, 1, 0, 256 * 256 + 512 * 128)]
    none = spark.createDataFrame([], schema)
    assert vector_search.top_k(none, none).count() == 0
    assert vector_search.top_k(docs, none).count() == 0


def test_large_components(spark):
    """Finite vectors of any size take part; what 64 bits can't hold fails."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(40)] + [(50, [5e6, 1.0, -3.0, 0.25]), (51, [5e6, 2.0, 7.0, 9.0]), (52, [1e6, -1e6, 1e6 + 1, -1e6])]
    rows += [(60 + i, [4e6 + i / 256, -3e6, 5e6, 1.25]) for i in range(20)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert answers(vector_search.top_k(docs, docs.filter("vec_id % 10 = 0"))) == brute(rows, {i for i, _ in rows if i % 10 == 0}, 5)
    huge = spark.createDataFrame([(0, [1e12, 1e12]), (1, [1e12, 1e12])], docs.schema)
    with pytest.raises(Exception, match="beyond 64-bit integers"):
        vector_search.top_k(huge, huge).collect()
    huge = spark.createDataFrame([(0, [1e30]), (1, [1.0])], docs.schema)
    with pytest.raises(Exception, match="beyond 64-bit integers"):
        vector_search.top_k(huge, huge).collect()


def test_several_lengths(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [3.0]), (3, [1.0]), (4, [2.0]), (10, [1.0, 1.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert answers(vector_search.top_k(docs, docs)) == brute(rows, range(5), 5) + brute(rows, [10], 5)


def test_bounds_leave_few_exact_reads():
    rng = np.random.default_rng(5)
    v = np.floor(256 * rng.normal(size=(4000, 32))).astype(np.int64)
    q = v[:20]
    cells = vector_search.Cells.between(int(v.min()), -700, 700, int(v.max()))
    low, high = cells.bounds(q, cells.of(v))
    exact = v @ q.T
    assert (low <= exact).all() and (exact <= high).all()
    floors = -np.sort(-low, axis=0)[4]
    assert ((high >= floors[None, :]).any(axis=1)).mean() < 0.2
