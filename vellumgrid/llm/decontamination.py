"""Benchmark decontamination: a BM25 index of test items, queried by passages.

The test items are the indexed side. A posting's impact is its BM25 weight
divided by the item's score with itself, so a passage that holds the whole item
scores 1, whatever the item's length. Every text is cut into overlapping windows
(three times the longest item, half overlapping, so an occurrence up to half
longer than its item lies within one window) and each window retrieves all items that reach ``threshold``:
block-max WAND with items in blocks of eight, where the sum of a window's terms'
largest impacts, first over all items, then over each block, skips what cannot
reach the threshold, and only the rest is scored. What is retrieved is verified:
an item's five-word runs are split in a question half and an answer half; the
window must hold 0.8 or more of the runs of both together and 0.5 or more of each
half's, so an edited word, which takes up to five runs, may lie in either half.

Document frequencies count all items. Items are sent to executors in shards of
at most ``shard_bytes`` of text; more items than that make more shards, each a
pass over the documents.

Edge cases: null, empty and wordless texts or items match nothing; texts and items
of any length are read whole; every item that reaches the threshold is returned, so
ties need no order (of a pair's windows the one of highest score, then overlaps,
is reported); rows with a null item_id take no part; an item under five words is one run of all its words (and has no answer half); repeated items
and repeated documents are answered once; other columns are ignored; with no
items or no documents the answer is empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.llm import common

K1, B, SIZE, BLOCK = 1.5, 0.75, 5, 8
_OUT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offs = common.text_buffers(pc.utf8_lower(texts.fill_null("")))
    hashes, at, _ = common.words(raw, offs)
    return hashes, at


def statistics(items: DataFrame) -> tuple[DataFrame, int, float]:
    """Document frequency of each term over all items, their number, mean length."""

    def run(batches):
        for batch in batches:
            hashes, at = _hashed(batch.column("text"))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(at))
            pair = np.unique(np.stack([owner.astype(np.uint64), hashes]), axis=1) if len(hashes) else np.zeros((2, 0), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(pair[1].view(np.int64)), pa.array(np.ones(pair.shape[1], np.int64))], ["term", "df"])

    def lengths(batches):
        for batch in batches:
            _, at = _hashed(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(at))], ["dl"])

    size = items.select("text").mapInArrow(lengths, "dl long").filter("dl > 0").agg(F.count("*").alias("n"), F.avg("dl").alias("a"), F.max("dl").alias("m")).head()
    return items.select("text").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")), size


class Index:
    """Postings of a shard of items, with normalised impacts and block maxima."""

    def __init__(self, ids: np.ndarray, texts: list[str], df: dict[int, int], n: int, mean: float, window: int):
        hashes, at = _hashed(pa.array(texts, pa.string()))
        self.ids, self.window = ids, window
        count = len(ids)
        self.terms, which = np.unique(hashes, return_inverse=True)
        owner = np.repeat(np.arange(count), np.diff(at))
        pair, tf = np.unique(which.astype(np.int64) * max(count, 1) + owner, return_counts=True)
        term, item = pair // max(count, 1), pair % max(count, 1)  # by term, then item
        freq = np.array([df[t] for t in self.terms.view(np.int64).tolist()], np.float64)
        idf = np.log(1 + (n - freq + 0.5) / (freq + 0.5))
        dl = np.diff(at)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[item] / mean))
        impact = weight / np.maximum(np.bincount(item, weights=weight, minlength=count), 1e-12)[item]
        edge = np.arange(len(self.terms) + 1)
        self.items, self.impact, self.offs = item, impact, np.searchsorted(term, edge)
        # the largest impact of each term in each block of items, and over all
        self.n_blocks = (count + BLOCK - 1) // BLOCK
        spot = term * max(self.n_blocks, 1) + item // BLOCK
        first = np.flatnonzero(np.diff(spot, prepend=-1))
        self.block_max = np.maximum.reduceat(impact, first) if len(first) else impact
        self.blocks, self.block_offs = (item // BLOCK)[first], np.searchsorted(term[first], edge)
        self.all_max = np.maximum.reduceat(impact, self.offs[:-1]) if len(self.terms) else impact
        keys, own = common.shingles(hashes, at, SIZE)
        self.runs = []
        for k in range(count):
            mine = keys[own == k]
            half = (len(mine) + 1) // 2
            self.runs.append((np.unique(mine[:half]), np.unique(mine[half:]), min(int(dl[k]), SIZE)))

    def retrieve(self, hashes: np.ndarray, at: np.ndarray, threshold: float) -> list[tuple[int, int, int, int, float]]:
        """(text, first word, last word, item, score) of every window and item that reach the threshold."""
        n = np.diff(at)
        half = self.window // 2
        numbers = np.maximum(1, -(-(n - half) // half)) * (n > 0)  # windows of each text
        text = np.repeat(np.arange(len(n)), numbers)
        turn = np.arange(len(text)) - np.repeat(np.cumsum(numbers) - numbers, numbers)
        start = at[:-1][text] + turn * half
        stop = np.minimum(start + self.window, at[1:][text])
        if not len(text) or not len(self.terms):
            return []
        place = np.searchsorted(self.terms, hashes)
        place[place == len(self.terms)] = 0
        known = np.flatnonzero(self.terms[place] == hashes)
        term = place[known]
        # a known word lies in one or two windows of its text
        owner = np.repeat(np.arange(len(n)), n)[known]
        first = np.cumsum(numbers) - numbers
        last = np.minimum((known - at[:-1][owner]) // half, numbers[owner] - 1)
        win = np.concatenate([first[owner] + last, (first[owner] + last - 1)[last > 0]])
        term = np.concatenate([term, term[last > 0]])
        inside = np.concatenate([known, known[last > 0]]) < stop[win]
        pair = np.unique(win[inside].astype(np.int64) * len(self.terms) + term[inside])
        win, term = pair // len(self.terms), pair % len(self.terms)
        bound = np.bincount(win, weights=self.all_max[term], minlength=len(text))
        live = np.flatnonzero(bound >= threshold - 1e-9)
        out = []
        begin, end = np.searchsorted(win, live), np.searchsorted(win, live + 1)
        for lo in range(0, len(live), 512):
            some = live[lo : lo + 512]
            at_ = slice(begin[lo], end[min(lo + 512, len(live)) - 1])
            chosen = np.isin(win[at_], some)
            t, own = term[at_][chosen], np.searchsorted(some, win[at_][chosen])
            spread, sizes = common.ragged(np.arange(len(self.blocks)), self.block_offs, t)
            upper = np.bincount(np.repeat(own, sizes) * self.n_blocks + self.blocks[spread], weights=self.block_max[spread], minlength=len(some) * self.n_blocks)
            hot = np.unique(np.flatnonzero(upper >= threshold - 1e-9) // self.n_blocks)
            edges = np.searchsorted(own, np.arange(len(some) + 1))
            for i in hot.tolist():
                picked, _ = common.ragged(np.arange(len(self.items)), self.offs, t[edges[i] : edges[i + 1]])
                alive = upper[i * self.n_blocks + self.items[picked] // BLOCK] >= threshold - 1e-9
                picked = picked[alive]  # only blocks that can reach the threshold are scored
                scores = np.bincount(self.items[picked], weights=self.impact[picked], minlength=len(self.ids))
                w = int(some[i])
                out += [(int(text[w]), int(start[w]), int(stop[w]), j, float(scores[j])) for j in np.flatnonzero(scores >= threshold - 1e-9).tolist()]
        return out

    def verify(self, hashes: np.ndarray, a: int, b: int, item: int) -> tuple[float, float, float]:
        """The overlaps of the question half, of the answer half and of both."""
        question, answer, size = self.runs[item]
        keys, _ = common.shingles(hashes[a:b], np.array([0, b - a]), size)
        if size < SIZE:  # a short item's run has its own length
            keys = _short(hashes[a:b], size)
        share = lambda x: float(np.isin(x, keys).mean()) if len(x) else 1.0
        q, a_ = share(question), share(answer)
        return q, a_, (q * len(question) + a_ * len(answer)) / max(len(question) + len(answer), 1)


def _short(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words as an item of just these words has them."""
    m = len(hashes) - size + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    flat = np.concatenate([hashes[k : k + size] for k in range(m)])
    return common.shingles(flat, np.arange(m + 1) * size, SIZE)[0]


def contaminated(
    docs: DataFrame, items: DataFrame, threshold: float = 0.5, least: float = 0.8, shard_bytes: int = 8_000_000, half_least: float = 0.5
) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every verified pair."""
    spark = docs.sparkSession
    items = items.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    frequencies, size = statistics(items)
    empty = spark.createDataFrame([], _OUT)
    if not size.n:
        return empty
    total = items.agg(F.sum(F.octet_length("text")).alias("b")).head().b
    shards = max(1, -(-2 * total // shard_bytes))  # half full on average
    window = 3 * max(32, int(size.m))
    out = None
    for shard in range(shards):
        own = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == shard) if shards > 1 else items
        rows = sorted((r.item_id, r.text) for r in own.collect())
        if not rows:
            continue
        if shards == 1:
            df = {r.term: r.df for r in frequencies.collect()}
        else:
            mine = own.select("text").mapInArrow(_term_rows, "term long").distinct()
            df = {r.term: r.df for r in frequencies.join(mine, "term", "left_semi").collect()}
        index = Index(np.array([i for i, _ in rows], np.int64), [t for _, t in rows], df, size.n, size.a, window)
        found = _scan(docs, spark.sparkContext.broadcast(index), threshold, least, half_least)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return empty
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("x")).select("doc_id", "item_id", "x.*")


def _term_rows(batches):
    for batch in batches:
        hashes, _ = _hashed(batch.column("text"))
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(hashes).view(np.int64))], ["term"])


def _scan(docs: DataFrame, sent, threshold: float, least: float, half_least: float) -> DataFrame:
    def run(batches):
        index = sent.value
        for whole in batches:
            for batch in common.slices(whole, "text", 4_000_000):
                hashes, at = _hashed(batch.column("text"))
                ids, rows = batch.column("doc_id").to_pylist(), []
                for text, a, b, item, score in index.retrieve(hashes, at, threshold):
                    question, answer, whole = index.verify(hashes, a, b, item)
                    if whole >= least - 1e-9 and min(question, answer) >= half_least:
                        rows.append((ids[text], int(index.ids[item]), score, question, answer))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item, by id and text: rows that share an
    id, or have none, are judged each by its own text."""
    keyed = docs.withColumn("_key", F.xxhash64(F.col("doc_id").cast("long"), "text"))
    bad = contaminated(keyed.select(F.col("_key").alias("doc_id"), "text"), common.table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_key")).distinct()
    return keyed.join(bad, "_key", "left_anti").select(*common.DOC_COLUMNS)
