"""Language identification by n-gram filters that hold a bit for each language.

A Bloom filter of ``2**bits`` slots keeps a bit mask a slot, bit l standing for
language l: an n-gram sets its language's bit in each of its slots, and the AND
of an n-gram's slots gives all languages that contain it at once. A text's
n-grams are looked up together; the count of each language's bits, less the
count that false positives alone would give (from the filter's fill), decides.

Learning reads texts and non-null languages of the rows given. It is fitted on
at most about ``sample`` documents of each language (a documented bound; taken
by the hash of the id), of which each language gives its most frequent n-grams;
one is kept for a language where its relative frequency is at least a fifth of
the highest over languages, so a few wrongly labelled documents teach nothing.

Edge cases: null text, empty text and text without letters give ``und`` with
score 0; texts of any length are read whole; ties go to the language that sorts first; a table without any labelled
row gives ``und`` for every text; repeated rows are scored as often as they
stand; other columns are ignored. The filter's size is fixed, so what is sent
to executors does not grow with the corpus.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.llm import common

N, PROBES, BITS = 3, 3, 18
_table: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """For each code point: its lower case where it is a letter, else a blank."""
    if "t" not in _table:
        out = np.full(sys.maxunicode + 1, 32, np.uint32)
        for c in range(sys.maxunicode + 1):
            if (s := chr(c)).isalpha():
                low = s.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _table["t"] = out
    return _table["t"]


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all n-grams of the texts' letters (runs of other characters are
    one blank, also around the text), each with the text's number; and which
    texts have a letter."""
    joined = "\x00".join(f" {t or ''} " for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    ends = points == 0
    lens = np.array([len(t or "") + 2 for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), lens + 1)[:-1] if len(texts) else np.zeros(0, np.int64)
    low = _letters()[points]
    blank = low == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # the first blank of a run
    if len(keep):
        keep[0] = True
    starts = np.cumsum(lens + 1) - (lens + 1)
    keep[starts] = True
    low, owner, ends = low[keep].astype(np.uint64), owner[keep], ends[keep]
    has = np.zeros(len(texts), bool)
    has[owner[low != 32]] = True
    m = len(low) - N + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has
    code = np.zeros(m, np.uint64)
    for k in range(N):
        code = (code << np.uint64(21)) | low[k : k + m]
    ok = (owner[:m] == owner[N - 1 :]) & (low[1 : m + 1] != 32)
    return code[ok], owner[:m][ok], has


def _slots(codes: np.ndarray, bits: int) -> list[np.ndarray]:
    h = common.mix64(codes + np.uint64(0x1234567))
    return [((h >> np.uint64(k * 20)) & np.uint64((1 << bits) - 1)).astype(np.int64) for k in range(PROBES)]


class Filters:
    """The fitted filters: ``masks`` has ceil(languages / 64) words a slot."""

    def __init__(self, languages: list[str], masks: np.ndarray, bits: int):
        self.languages, self.masks, self.bits = languages, masks, bits
        flags = [((masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))]
        self.false = np.array(flags, np.float64) ** PROBES

    def counts(self, codes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each text: the hits of each language, and the n-grams."""
        total = np.bincount(owner, minlength=n)
        hits = np.zeros((n, len(self.languages)))
        if not len(codes):
            return hits, total
        slots = _slots(codes, self.bits)
        for word in range(self.masks.shape[1]):
            mask = self.masks[slots[0], word]
            for s in slots[1:]:
                mask &= self.masks[s, word]
            for k in range(word * 64, min(len(self.languages), word * 64 + 64)):
                hit = (mask >> np.uint64(k - word * 64)) & np.uint64(1)
                hits[:, k] = np.bincount(owner, weights=hit, minlength=n)
        return hits, total

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        codes, owner, has = ngrams(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        hits, total = self.counts(codes, owner, len(texts))
        wrong = np.minimum(self.false, 0.999)
        real = np.clip((hits - total[:, None] * wrong) / (1 - wrong), 0, None)
        best = real.argmax(axis=1)
        score = np.where(has & (total > 0), real.max(axis=1) / np.maximum(total, 1), 0.0)
        return [self.languages[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)], np.clip(score, 0, 1)


def fit(rows: DataFrame, sample: int = 5000, most: int = 20_000, bits: int = BITS) -> Filters:
    """Filters from the columns doc_id, text and lang of ``rows``."""
    known = rows.filter(F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not sizes:
        return Filters([], np.zeros((1 << bits, 1), np.uint64), bits)
    share = F.lit(None)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample / n))).otherwise(share)
    drawn = (F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000)) / 1_000_000) < share

    def run(batches):
        for whole in batches:
            for batch in common.slices(whole, "text", 1_000_000):
                codes, owner, _ = ngrams(batch.column("text").to_pylist())
                langs = batch.column("lang").dictionary_encode()
                which = langs.indices.to_numpy(zero_copy_only=False)[owner].astype(np.uint64)
                both, n = np.unique(np.stack([which, codes]), axis=1, return_counts=True) if len(codes) else (np.zeros((2, 0), np.uint64), np.zeros(0, int))
                yield pa.RecordBatch.from_arrays(
                    [langs.dictionary.take(pa.array(both[0].astype(np.int64))), pa.array(both[1].astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"]
                )

    grams = known.filter(drawn).mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the most frequent n-grams: a threshold on the count, found from its histogram, bounds what is kept
    level = F.floor(F.log2("n") * 8).cast("int")
    graded, path = common.stored(grams.withColumn("level", level), "language-grams")
    totals, floors = {}, {}
    by_lang: dict[str, list] = {}
    for r in graded.groupBy("lang", "level").agg(F.count("*").alias("c"), F.sum("n").alias("s")).collect():
        by_lang.setdefault(r.lang, []).append((r.level, r.c, r.s))
    keep = F.lit(False)
    for lang, levels in by_lang.items():
        totals[lang] = sum(s for _, _, s in levels)
        have = 0
        for at, c, _ in sorted(levels, reverse=True):
            if have + c > most and have:
                break
            have, floors[lang] = have + c, at
        keep = keep | ((F.col("lang") == lang) & (F.col("level") >= floors[lang]))
    languages = sorted(sizes)
    picked = graded.filter(keep).select("lang", "gram", "n").toArrow()  # about ``most`` rows a language
    common.remove(rows.sparkSession, path)
    where = {lang: k for k, lang in enumerate(languages)}
    own = np.array([where[x] for x in picked.column("lang").to_pylist()], np.int64)
    codes = picked.column("gram").to_numpy()
    rate = picked.column("n").to_numpy() / np.array([totals.get(lang, 1) for lang in languages])[own] if len(own) else np.zeros(0)
    masks = np.zeros((1 << bits, (len(languages) + 63) // 64), np.uint64)
    if len(own):
        grams_, at = np.unique(codes, return_inverse=True)
        high = np.zeros(len(grams_))
        np.maximum.at(high, at, rate)
        good = rate >= 0.2 * high[at]
        for k in range(len(languages)):
            for s in _slots(codes[good & (own == k)].astype(np.uint64), bits):
                masks[s, k // 64] |= np.uint64(1 << (k % 64))
    return Filters(languages, masks, bits)


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """The columns of ``docs`` with lang_pred and score."""
    spark = docs.sparkSession
    names = {"lang_pred", "score"} & set(docs.columns)
    kept = docs.drop(*names)
    sent = spark.sparkContext.broadcast(filters)  # 2**bits slots: 2 MB for each 64 languages

    def run(batches):
        for whole in batches:
            for batch in common.slices(whole, "text", 1_000_000):
                pred, score = sent.value.predict(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"]
                )

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType(list(kept.schema.fields)).add("lang_pred", StringType()).add("score", DoubleType())
    return kept.mapInArrow(run, schema)


HELD_OUT = 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held = common.crc_fold("doc_id", 3) == HELD_OUT
    filters = fit(docs.filter(~held).select("doc_id", "lang", "text"))
    scored = identify(docs.select("doc_id", "text"), filters)
    return scored.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: those without a letter go, and those of
    whose n-grams less than a tenth belong to the best language."""
    held = common.crc_fold("doc_id", 3) == HELD_OUT
    filters = fit(docs.filter(~held).select("doc_id", "lang", "text"))
    scored = identify(docs.select(*common.DOC_COLUMNS), filters)
    return scored.filter((F.col("lang_pred") != "und") & (F.col("score") >= 0.1)).select(*common.DOC_COLUMNS)
