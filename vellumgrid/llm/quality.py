"""Quality classifier: a generalised additive model with pairwise interactions.

Shape features of a text (shares of character classes, word and line lengths,
repetition) are cut into bins at quantiles. Cyclic boosting visits the features
in turn and adds a small step of a shallow tree over that feature's bins alone;
when single features are done, the pairs that explain most of what is left are
boosted the same way on two-dimensional bins. What remains is a lookup table a
feature and a pair, so a score is an intercept plus table entries, added for all
rows at once.

Learning uses at most ``most`` labelled rows (a documented bound; those with the
smallest hash of doc_id), so the fit has one size. Features are computed once,
in one pass over whole texts; learning and scoring read the features.

Edge cases: null and empty texts have all features 0 and are scored like any
other; a doc_id labelled more than once has the mean of its labels, and counts
as 1 from 0.5, and if its texts differ the one of least features is learned from;
null labels are ignored; texts of any length are read whole; values that tie fall
into one bin, and of cuts that gain the same the first is made; with no labels, or labels of one kind
only, every score is the share of ones (0.5 with none); repeated rows are scored
as often as they stand; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.llm import common

FEATURES = [
    "log_bytes", "upper", "lower", "digit", "blank", "line_end", "comma_stop", "shout", "bar", "odd", "wide", "log_words", "word_mean", "word_spread",
    "line_mean", "distinct_words", "odd_words", "capital_words", "repeated_words",
]
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate(["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r", "\n", ".,;:'\"()-", "!?", "|<>{}[]"]):
    for _c in _chars:
        _CLASS[ord(_c)] = _k + 1
_CLASS[[c for c in range(128) if not _CLASS[c]]] = 9
_CLASS[128:] = 10


def features(texts: pa.Array) -> np.ndarray:
    """(n, len(FEATURES)) features of whole texts."""
    raw, offs = common.text_buffers(texts)
    n = len(offs) - 1
    out = np.zeros((n, len(FEATURES)))
    if not len(raw):
        return out
    size = np.diff(offs).astype(np.float64)
    full = np.maximum(size, 1)
    owner = np.repeat(np.arange(n), np.diff(offs))
    kind = _CLASS[raw]
    counts = np.bincount(owner * 11 + kind, minlength=n * 11).reshape(n, 11)
    out[:, 0] = np.log1p(size)
    out[:, 1:11] = counts[:, 1:11] / full[:, None]
    inside = ~np.isin(kind, (4, 5))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = offs[:-1][size > 0]
    first[starts] = inside[starts]
    begin = np.flatnonzero(first)
    own = owner[begin]
    number = np.bincount(own, minlength=n)
    some = np.maximum(number, 1)
    edges = np.concatenate([[0], np.cumsum(inside)])
    length = np.diff(np.append(edges[begin], edges[-1])).astype(np.float64)
    mean = np.bincount(own, weights=length, minlength=n) / some
    out[:, 11] = np.log1p(number)
    out[:, 12] = mean
    out[:, 13] = np.sqrt(np.maximum(np.bincount(own, weights=length**2, minlength=n) / some - mean**2, 0))
    out[:, 14] = np.log1p(size / (counts[:, 5] + 1))
    hashes, at, _ = common.words(raw, offs)
    if len(hashes):
        who = np.repeat(np.arange(n), np.diff(at))
        order = np.lexsort((hashes, who))
        h, w = hashes[order], who[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
        out[:, 15] = np.bincount(w[fresh], minlength=n) / np.maximum(np.diff(at), 1)
        again = (hashes[1:] == hashes[:-1]) & (who[1:] == who[:-1])
        out[:, 18] = np.bincount(who[1:][again], minlength=n) / np.maximum(np.diff(at), 1)
    strange = np.concatenate([[0], np.cumsum(kind == 9)])
    ends = np.append(begin[1:], len(raw))
    out[:, 16] = np.bincount(own, weights=strange[ends] > strange[begin], minlength=n) / some
    out[:, 17] = np.bincount(own, weights=kind[begin] == 1, minlength=n) / some
    return out


def _split(g: np.ndarray, h: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """Steps of a shallow tree over ordered bins: the best cuts, one after another."""
    gs, hs = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    cuts = [0, len(g)]
    worth = lambda a, b: (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + 1.0)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            c = np.arange(a + 1, b)
            c = c[(hs[c] - hs[a] >= least) & (hs[b] - hs[c] >= least)]
            if len(c):
                gain = (gs[c] - gs[a]) ** 2 / (hs[c] - hs[a] + 1.0) + (gs[b] - gs[c]) ** 2 / (hs[b] - hs[c] + 1.0) - worth(a, b)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), int(c[k]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    step = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        step[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + 1.0)
    return step


class AdditiveModel:
    """Intercept, edges of bins, a table for each feature and for each chosen pair."""

    def __init__(self, bins: int = 32, rounds: int = 150, pair_bins: int = 8, pairs: int = 6, rate: float = 0.1, leaves: int = 3, least: float = 2.0):
        self.bins, self.rounds, self.pair_bins, self.n_pairs = bins, rounds, pair_bins, pairs
        self.rate, self.leaves, self.least = rate, leaves, least
        self.intercept, self.edges, self.tables, self.pairs = 0.0, [], [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        share = float(y.mean()) if len(y) else 0.5
        if not len(y) or share in (0.0, 1.0):
            self.intercept = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
            return self
        self.intercept = float(np.log(share / (1 - share)))
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._bins(x)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        f = np.full(len(y), self.intercept)
        for _ in range(self.rounds):
            for k, table in enumerate(self.tables):
                p = 1 / (1 + np.exp(-f))
                g, h = np.bincount(b[k], weights=y - p, minlength=len(table)), np.bincount(b[k], weights=p * (1 - p), minlength=len(table))
                step = self.rate * _split(g, h, self.leaves, self.least)
                table += step
                f += step[b[k]]
        coarse = [(c * self.pair_bins) // len(t) for c, t in zip(b, self.tables, strict=True)]
        p = 1 / (1 + np.exp(-f))
        gains = []
        for i in range(len(b)):
            for j in range(i):
                cell = coarse[i] * self.pair_bins + coarse[j]
                g, h = np.bincount(cell, weights=y - p), np.bincount(cell, weights=p * (1 - p))
                gains.append((float((g**2 / (h + 5.0)).sum()), i, j))
        self.pairs = [[i, j, np.zeros((self.pair_bins, self.pair_bins))] for _, i, j in sorted(gains, reverse=True)[: self.n_pairs]]
        for _ in range(self.rounds // 3):
            for i, j, table in self.pairs:
                p = 1 / (1 + np.exp(-f))
                cell = coarse[i] * self.pair_bins + coarse[j]
                g = np.bincount(cell, weights=y - p, minlength=self.pair_bins**2).reshape(table.shape)
                h = np.bincount(cell, weights=p * (1 - p), minlength=self.pair_bins**2).reshape(table.shape)
                step = self._quarters(g, h) * self.rate
                table += step
                f += step.ravel()[cell]
        return self

    def _quarters(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The tree that cuts both axes once where it gains most."""
        gs, hs = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0))), np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        m, best = len(g), (-1.0, 1, 1)
        box = lambda s, a, b, c, d: s[b, d] - s[a, d] - s[b, c] + s[a, c]
        for r in range(1, m):
            for c in range(1, m):
                gain = sum(box(gs, a, b, x, y) ** 2 / (box(hs, a, b, x, y) + 5.0) for a, b in ((0, r), (r, m)) for x, y in ((0, c), (c, m)))
                best = max(best, (float(gain), r, c))
        _, r, c = best
        step = np.zeros_like(g)
        for a, b in ((0, r), (r, m)):
            for x, y in ((0, c), (c, m)):
                step[a:b, x:y] = box(gs, a, b, x, y) / (box(hs, a, b, x, y) + 5.0)
        return step

    def _bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)]

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.intercept)
        if self.tables:
            b = self._bins(x)
            for k, table in enumerate(self.tables):
                f += table[b[k]]
            for i, j, table in self.pairs:
                f += table[(b[i] * self.pair_bins) // len(self.tables[i]), (b[j] * self.pair_bins) // len(self.tables[j])]
        return 1 / (1 + np.exp(-f))


def featurise(docs: DataFrame) -> DataFrame:
    """doc_id and ``x``, the packed features."""

    def run(batches):
        for whole in batches:
            for batch in common.slices(whole, "text"):
                x = features(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in x.astype("<f8")], pa.binary())], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, x binary")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, len(FEATURES))


def learn(known: DataFrame, labels: DataFrame, label: str = "quality", most: int = 20_000) -> AdditiveModel:
    """A model from featurised rows and (doc_id, label) rows."""
    marks = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(F.col(label)) >= 0.5).cast("int").alias("y"))
    total = marks.count()
    turn = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000))
    if total > most:
        marks = marks.filter(turn < int(1_000_000 * most / total))
    # the bound holds in expectation; the limit makes it strict
    rows = known.join(marks, "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")).select("doc_id", "x", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).toArrow()
    if not rows.num_rows:
        return AdditiveModel().fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return AdditiveModel().fit(_matrix(rows.column("x")), rows.column("y").to_numpy().astype(np.float64))


def score(known: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id and score of featurised rows."""
    sent = known.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sent.value.score(_matrix(batch.column("x"))), pa.float64())], ["doc_id", "score"])

    return known.mapInArrow(run, "doc_id long, score double")


THRESHOLD = 0.3


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = common.materialise(featurise(common.table(spark, sf_dir, "documents")), "quality-features")
    held = common.crc_fold("doc_id", 5) == 0
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "quality").filter(~held)
    model = learn(known.filter(~held), labels)
    return score(known, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
