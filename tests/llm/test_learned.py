"""Language identification and the quality classifier: held-out accuracy and edge cases."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from vellumgrid.llm import common, language, quality

TABLES = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in common.table(spark, TABLES, "documents").collect()}
    rows = language.query(spark, TABLES).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert len(held) > 200 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    train = [(k, "the quick brown fox and the lazy dog", "en") for k in range(20)] + [(100 + k, "der schnelle braune fuchs und der faule hund", "de") for k in range(20)] + [(300, "x", None), (301, None, "en")]
    filters = language.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    docs = [(1, None), (2, ""), (3, "123 !!"), (4, "the dog"), (5, "und der hund " * 20_000), (4, "the dog")]
    got = sorted((r.doc_id, r.lang_pred) for r in language.identify(spark.createDataFrame([(a, b, "c", 1) for a, b in docs], "doc_id long, text string, lang_pred string, score int"), filters).collect())
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "de")]
    nothing = language.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert nothing.predict(["text"])[0] == ["und"]


def test_false_positives_are_corrected():
    masks = np.zeros((1 << 10, 1), np.uint64)
    masks[:900] = 1  # language 0's bits are set nearly everywhere
    f = language.Filters(["a", "b"], masks, 10)
    for s in language._slots(language.ngrams(["some words of b"])[0], 10):
        f.masks[s, 0] |= np.uint64(2)
    assert f.predict(["some words of b"])[0] == ["b"]


def test_quality_of_held_out_documents(spark):
    labels = {r.doc_id: r.quality for r in common.table(spark, TABLES, "labels").collect()}
    rows = [r for r in quality.query(spark, TABLES).collect() if r.held_out and r.doc_id in labels]
    good, bad = ([r.score for r in rows if labels[r.doc_id] == y] for y in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 1, "x"), (2, "", 1, "x"), (3, "word " * 50_000, 1, "x"), (3, "word " * 50_000, 1, "x"), (None, "t", 1, "x")], "doc_id long, text string, score int, x string")
    known = quality.featurise(docs)
    for labels in ([], [(1, 1)], [(1, 1), (2, 0), (2, 0), (3, None), (None, 1)]):
        model = quality.learn(known, spark.createDataFrame(labels, "doc_id long, quality int"))
        scores = [r.score for r in quality.score(known, model).collect()]
        assert len(scores) == 5 and all(0 <= s <= 1 for s in scores)
    assert quality.featurise(docs.limit(0)).count() == 0


def test_additive_model_learns_interactions():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    s = quality.AdditiveModel(rounds=60).fit(x[:2000], y[:2000]).score(x[2000:])
    assert ((s > 0.5) == y[2000:]).mean() > 0.9


def test_features_of_slices_equal_those_of_single_texts():
    texts = ["A b, c!\nline two", "", "ünïcode wörds", "x" * 1000, "end "]
    whole = quality.features(pa.array(texts))
    assert np.allclose(whole, np.vstack([quality.features(pa.array([t])) for t in texts]))


def plain_score(model, row):
    """A score by single steps over the fitted tables."""
    f, places = model.intercept, []
    for value, edges, table in zip(row, model.edges, model.tables, strict=True):
        place = sum(1 for e in edges if e <= value)
        places.append((place * model.pair_bins) // len(table))
        f += table[place]
    for i, j, table in model.pairs:
        f += table[places[i]][places[j]]
    return 1 / (1 + math.exp(-f))


def plain_features(text):
    """Some of the features by plain counting."""
    data = text.encode()
    words = re.findall(r"[^ \t\r\n]+", text)
    lens = [len(w.encode()) for w in words]
    share = lambda cs: sum(c in cs for c in text) / max(len(data), 1)
    return {
        "log_bytes": math.log1p(len(data)), "upper": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digit": share("0123456789"), "line_end": share("\n"), "shout": share("!?"),
        "log_words": math.log1p(len(words)), "word_mean": sum(lens) / max(len(lens), 1), "line_mean": math.log1p(len(data) / (text.count("\n") + 1)),
    }


def test_quality_equals_brute_force(spark):
    small = "/root/testdata/sf0.001"
    docs = common.table(spark, small, "documents")
    known = quality.featurise(docs)
    model = quality.learn(known, common.table(spark, small, "labels").select("doc_id", "quality"))
    assert len(model.pairs) == 6
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = {r.doc_id: np.frombuffer(r.x, "<f8") for r in known.collect()}
    for d, t in texts.items():
        for name, value in plain_features(t).items():
            assert abs(rows[d][quality.FEATURES.index(name)] - value) < 1e-9
    for r in quality.score(known, model).collect():
        assert abs(r.score - plain_score(model, rows[r.doc_id])) < 1e-9


def test_quality_learns_the_same_from_any_order(spark):
    rows = [(k % 40, f"text {k} " * (k % 9 + 1) + "!" * (k % 4)) for k in range(80)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    models = [quality.learn(quality.featurise(spark.createDataFrame(x, "doc_id long, text string").repartition(n)), labels) for x, n in ((rows, 1), (rows[::-1], 3))]
    assert all((a == b).all() for a, b in zip(models[0].tables, models[1].tables, strict=True))


def brute_language(train, texts):
    """Predictions with exact sets of n-grams in place of filters."""

    def grams(t):
        flat = " " + re.sub(r"[\W\d_]+", " ", t).strip(" ").lower() + " "
        return [flat[i : i + 3] for i in range(len(flat) - 2) if flat[i + 1] != " "]

    counts = {}
    for t, lang in train:
        counts.setdefault(lang, Counter()).update(grams(t or ""))
    totals, rates = {lang: sum(c.values()) for lang, c in counts.items()}, {}
    for lang, c in counts.items():
        levels = Counter(math.floor(math.log2(n) * 8) for n in c.values())
        have, floor = 0, None
        for level in sorted(levels, reverse=True):
            if have and have + levels[level] > 20_000:
                break
            have, floor = have + levels[level], level
        for g, n in c.items():
            if math.floor(math.log2(n) * 8) >= floor:
                rates.setdefault(g, {})[lang] = n / totals[lang]
    sets = {lang: {g for g, r in rates.items() if r.get(lang, 0) >= 0.2 * max(r.values()) and lang in r} for lang in counts}
    out = []
    for t in texts:
        if not any(c.isalpha() for c in t or ""):
            out.append(("und", 0.0))
            continue
        own = grams(t)
        hits = {lang: sum(g in s for g in own) for lang, s in sets.items()}
        best = min(hits, key=lambda x: (-hits[x], x))
        out.append((best, hits[best] / max(len(own), 1)))
    return out


def test_language_equals_brute_force(spark):
    small = "/root/testdata/sf0.001"
    rows = common.table(spark, small, "documents").collect()
    learn = [(r.text, r.lang) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.lang is not None]
    want = dict(zip([r.doc_id for r in rows], brute_language(learn, [r.text for r in rows]), strict=True))
    for r in language.query(spark, small).collect():
        assert r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 0.05, r.doc_id


def test_language_ties_go_to_the_first(spark):
    train = [(k, "shared words only", lang) for k, lang in enumerate(["fr", "en", "de"] * 5)]
    filters = language.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert filters.predict(["shared words"])[0] == ["de"]
