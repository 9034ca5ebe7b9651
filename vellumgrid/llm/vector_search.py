"""Exact top-k by inner product over vector-approximation files.

Every component is an integer; a vector-approximation row keeps, for each
component, the cell (one of 128 levels: equal widths between the table's 0.1 %
and 99.9 % quantiles, and one level beyond them on either side) that holds it, so
a query's score with a row lies between bounds read off the cells alone. A first
pass over the approximations finds, for each query, the k-th largest lower bound
of all rows; a second one the rows that some query's upper bound still admits.
Only these rows' exact vectors are read: in each partition in descending order of
their upper bounds, until the next bound is under the k-th score found. Partial
answers of k rows a query and partition are ranked by a window.

Queries are taken in blocks of at most ``block`` ids, one job a block, so what
is sent to executors has a fixed size however many queries there are.

Edge cases: vectors that are null or empty, or hold null or non-finite components,
take no part; finite ones of any size do (floor(256 * component) must be under
2**63, as must the scores returned, else the job fails; sums that could pass 2**63
are taken over Python's integers); a null id takes no part; vectors of several
lengths are each compared with those of their own; equal scores go to the smaller
id; rows that repeat an id are candidates each, and a query id that repeats is
asked once, with its smallest vector; no row of a query's own id is among its
answers; an empty table has an empty answer; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumgrid.llm import common

LEVELS = 128
_ANSWER = "query_id long, vec_id long, score double"
_EXACT = "query_id long, vec_id long, score long"


def integers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``id`` and ``v``: floor(scale * component) of every usable vector."""

    def whole(x):
        y = F.lit(float(scale)) * x.cast("double")
        finite = y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf"))  # others' vectors are left out
        return F.when(F.abs(y) < 2.0**63, F.floor(y)).when(finite, F.raise_error(F.lit("a component is beyond 64-bit integers")).cast("long")).cast("long")

    finite = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & finite).select(
        F.col(id_col).cast("long").alias("id"), F.transform(F.col(vec_col), whole).alias("v")
    )


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows by score, then smaller id."""
    keep = np.lexsort((ids, -scores))[:k]
    return ids[keep], scores[keep]


class Cells:
    """Levels between ascending edges; a level holds edges[i] .. edges[i + 1] - 1."""

    def __init__(self, edges: list[int]):
        self.edges = np.array(edges, np.int64)

    @classmethod
    def between(cls, low: int, a: int, b: int, high: int, levels: int = LEVELS) -> Cells:
        """Equal widths from a to b, one level each for low .. a - 1 and b + 1 .. high."""
        inner = [a + (b + 1 - a) * k // (levels - 2) for k in range(levels - 1)]
        return cls(sorted({low, *inner, min(high + 1, 2**63 - 1)}))

    def of(self, v: np.ndarray) -> np.ndarray:
        return np.clip(np.searchsorted(self.edges, v, side="right") - 1, 0, len(self.edges) - 2).astype(np.uint8)

    def bounds(self, q: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of q . v for every row of ``cells`` and query,
        widened by what rounding may lose."""
        a, b = self.edges[:-1].astype(np.float64), self.edges[1:].astype(np.float64) - 1
        low, high = a[cells], b[cells]
        up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
        most = np.abs(q).astype(np.float64).sum(axis=1) * float(np.abs(self.edges.astype(np.float64)).max())
        slack = np.where(most < 2.0**52, 0.0, most * (q.shape[1] + 4) * 2.0**-51)  # integers under 2**53: exact
        return low @ up.T + high @ down.T - slack, high @ up.T + low @ down.T + slack


def _scores(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of rows with one query."""
    if float(np.abs(v.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).sum()) < 2.0**62:
        return v @ q
    out = v.astype(object) @ q.astype(object)
    if any(not -(2**63) <= x < 2**63 for x in out):
        raise OverflowError("a score is beyond 64-bit integers")
    return out.astype(np.int64)


def approximations(vectors: DataFrame, dim: int, cells: Cells) -> DataFrame:
    """The vector-approximation file: row, id, cells and exact vector, both packed."""

    def run(batches):
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            pack = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pack(cells.of(v)), pack(v.astype("<i8"))], ["row", "id", "cells", "exact"])

    return vectors.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "v").mapInArrow(run, "row long, id long, cells binary, exact binary")


def _unpack(column: pa.Array, kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


def _parts(batches, rows: int):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _answers(q_ids, found, kind):
    n = [len(i) for i, _ in found]
    if sum(n):
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(q_ids, n)), pa.array(np.concatenate([i for i, _ in found])), pa.array(np.concatenate([s for _, s in found]).astype(kind))],
            ["query_id", "vec_id", "score"],
        )


def _floors(q_ids, q, cells: Cells, k: int, rows: int):
    """Each query's k largest lower bounds in this partition."""

    def run(batches):
        found = [(np.zeros(0, np.int64), np.zeros(0)) for _ in q_ids]
        least = np.full(len(q_ids), -np.inf)
        for part in _parts(batches, rows):
            ids = part.column("id").to_numpy()
            low, _ = cells.bounds(q, _unpack(part.column("cells"), "u1", q.shape[1]))
            low[ids[:, None] == q_ids[None, :]] = -np.inf
            for j in np.flatnonzero((low > least[None, :]).any(axis=0)):
                near = np.flatnonzero(low[:, j] > least[j])
                have, scores = found[j]
                found[j] = _best(np.concatenate([have, ids[near]]), np.concatenate([scores, low[near, j]]), k)
                if len(found[j][0]) == k:
                    least[j] = found[j][1][-1]
        yield from _answers(q_ids, found, np.float64)

    return run


def _admitted(q_ids, q, floors, cells: Cells, rows: int):
    """The rows that the upper bound of some query admits."""

    def run(batches):
        for part in _parts(batches, rows):
            _, high = cells.bounds(q, _unpack(part.column("cells"), "u1", q.shape[1]))
            high[part.column("id").to_numpy()[:, None] == q_ids[None, :]] = -np.inf
            keep = ((high >= floors[None, :]) & (high > -np.inf)).any(axis=1)
            yield pa.RecordBatch.from_arrays([part.column("row").filter(pa.array(keep))], ["row"])

    return run


def _search(q_ids, q, floors, cells: Cells, k: int, rows: int, step: int = 64):
    """Exact scores in descending order of upper bounds, until certain."""

    def run(batches):
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in q_ids]
        for part in _parts(batches, rows):
            ids = part.column("id").to_numpy()
            exact = _unpack(part.column("exact"), "<i8", q.shape[1])
            _, high = cells.bounds(q, cells.of(exact))
            high[ids[:, None] == q_ids[None, :]] = -np.inf
            for j in np.flatnonzero((high >= floors[None, :]).any(axis=0)):
                have, scores = found[j]
                floor = max(floors[j], scores[k - 1] if len(scores) == k else -np.inf)
                near = np.flatnonzero((high[:, j] >= floor) & (high[:, j] > -np.inf))
                near = near[np.argsort(-high[near, j], kind="stable")]
                for s in range(0, len(near), step):
                    if len(scores) == k and high[near[s], j] < scores[k - 1]:
                        break  # no later row can reach the k-th score
                    now = near[s : s + step]
                    have, scores = _best(np.concatenate([have, ids[now]]), np.concatenate([scores, _scores(exact[now], q[j])]), k)
                found[j] = have, scores
        yield from _answers(q_ids, found, np.int64)

    return run


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    """Each query's k best rows with their ranks."""
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", turn).filter(F.col("rank") <= k)


def _blocks(asked: DataFrame, block: int) -> list[tuple[int, int]]:
    """Ranges of ids that hold at most ``block`` of them: a fuller range is halved."""
    first, out = asked.agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).head(), []
    todo = [(first.a, first.b, first.n)] if first.n else []
    while todo:
        a, b, n = todo.pop()
        if n <= block:
            out.append((a, b))
            continue
        middle = asked.filter(F.col("id").between(a, b)).approxQuantile("id", [0.5], 0.01)[0]
        middle = min(max(int(middle), a), b - 1)
        for lo, hi in ((a, middle), (middle + 1, b)):
            if c := asked.filter(F.col("id").between(lo, hi)).count():
                todo.append((lo, hi, c))
    return sorted(out)


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 2048, id_col: str = "vec_id", vec_col: str = "embedding", rows: int = 2048
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of ``vectors`` for
    each row of ``queries`` (same columns), those of its own id left out."""
    spark = vectors.sparkSession
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    usable = integers(vectors, id_col, vec_col)
    wanted = integers(queries, id_col, vec_col)
    with common.Scratch() as keep:
        # the lengths of vectors are few
        for dim in sorted(r.d for r in wanted.select(F.size("v").alias("d")).distinct().collect()):
            own = usable.filter(F.size("v") == dim)
            parts = own.select(F.explode("v").alias("x"))
            edge = parts.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.percentile_approx("x", [0.001, 0.999], 10_000).alias("p")).head()
            if edge.low is None:
                continue
            cells = Cells.between(edge.low, edge.p[0], edge.p[1], edge.high)
            file = keep(approximations(own, dim, cells), "va-file")
            asked = keep(wanted.filter(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v")), "va-queries")
            for a, b in _blocks(asked, block):
                some = asked.filter(F.col("id").between(a, b)).orderBy("id").collect()  # at most ``block`` rows
                q_ids, q = np.array([r.id for r in some], np.int64), np.array([r.v for r in some], np.int64)
                low = _ranked(file.select("id", "cells").mapInArrow(_floors(q_ids, q, cells, k, rows), _ANSWER), k)
                known = {r.query_id: r.score for r in low.filter(F.col("rank") == k).collect()}
                floors = np.array([known.get(i, -np.inf) for i in q_ids.tolist()], np.float64)
                admitted = file.select("row", "id", "cells").mapInArrow(_admitted(q_ids, q, floors, cells, rows), "row long")
                exact = file.select("row", "id", "exact").join(admitted, "row", "left_semi")
                best = _ranked(exact.select("id", "exact").mapInArrow(_search(q_ids, q, floors, cells, k, rows), _EXACT), k)
                out = out.unionByName(common.materialise(best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "va-answer"))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM s
)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5
"""
