from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from vellumgrid.llm import common, near_duplicates

SMALL = "/root/testdata/sf0.001"


def runs(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(rows, counted=True):
    sets = {}
    for d, t in rows:
        own = runs(t)
        sets.setdefault(d, []).append(own if counted else Counter(set(own)))
    label = {d: d for d in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        for x in sets[a]:
            for y in sets[b]:
                if (not x and not y) or (x and y and (x & y).total() / (x | y).total() >= 0.8):
                    label[max(root(a), root(b))] = min(root(a), root(b))
    return {d: root(d) for d in sets}


def got(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, 1, 2, 3, 4) for d, t in rows], "doc_id long, text string, a int, rep int, label int, band int")
    return {r.doc_id: r.class_id for r in near_duplicates.classes(docs, **options).collect()}


def test_smallest_tables(spark):
    docs = [(r.doc_id, r.text) for r in common.table(spark, SMALL, "documents").collect()]
    found = {r.doc_id: r.class_id for r in near_duplicates.query(spark, SMALL).collect()}
    assert found == brute(docs)


def test_families_at_every_distance(spark):
    """Copies with more and more edits: bands hold several classes at once."""
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    rows = []
    for k in range(90):
        words = list(base)
        for at in rng.choice(200, k % 12, replace=False):
            words[at] = f"e{rng.integers(10**6)}"
        rows.append((k, " ".join(words)))
    assert got(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "..."), (4, "one two"), (5, "One, two!"), (6, "one"), (7, "x " * 60_000), (8, "x " * 60_000), (9, "one two three four five six"), (9, "one two")]
    assert got(spark, rows) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 9: 4}
    assert got(spark, []) == {}


@pytest.mark.parametrize("weighted", [False, True])
def test_signatures_estimate_similarity(weighted):
    rng = np.random.default_rng(2)
    pairs, estimates = [], []
    for _ in range(40):
        keys = common.mix64(rng.integers(0, 2**62, 300).astype(np.uint64))
        w = rng.integers(1, 6, 300).astype(float) if weighted else np.ones(300)
        v = np.where(rng.random(300) < 0.3, 0, w)
        pairs.append(np.minimum(w, v).sum() / np.maximum(w, v).sum())
        own = np.repeat([0, 1], [300, int((v > 0).sum())])
        s = near_duplicates.darts(np.concatenate([keys, keys[v > 0]]), np.concatenate([w, v[v > 0]]), own, 2)
        estimates.append((s[0] == s[1]).mean())
    assert abs(np.mean(estimates) - np.mean(pairs)) < 0.02


def test_repeated_ids_of_different_texts(spark):
    """Every text of an id is compared, whichever other texts the id has."""
    text = lambda k: " ".join(f"t{k}w{j}" for j in range(60))
    rows = [(k, text(k)) for k in range(10, 16)] + [(k, text(k + 100)) for k in range(10, 16)]
    rows += [(k + 20, text(k) + " more") for k in range(10, 16)] + [(k + 40, text(k + 100) + " more") for k in range(10, 16)]
    found = got(spark, rows)
    assert found == brute(rows) and all(found[k + 20] == found[k + 40] == k for k in range(10, 16))


@pytest.mark.parametrize("counted", [True, False])
def test_repeated_passages_weigh(spark, counted):
    """Texts of repeated passages: alike as sets are many, alike with their counts few."""
    rng = np.random.default_rng(9)
    passages = [" ".join(f"p{k}w{rng.integers(10**6)}" for _ in range(30)) for k in range(4)]
    rows = []
    for k in range(40):
        times = rng.integers(1, 6, 4)
        rows.append((k, " ".join(passages[j] for j in range(4) for _ in range(int(times[j])))))
    found = got(spark, rows, counted=counted)
    assert found == brute(rows, counted)
    assert len(set(found.values())) > 1 if counted else len(set(found.values())) == 1


def test_hot_leaders_are_dealt(spark):
    """Many near copies of one text: one band, leader and hub for nearly all rows."""
    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in range(120)]
    rows = [(k, " ".join([*base, f"own{k}"])) for k in range(300)] + [(1000 + k, " ".join(f"z{x}" for x in rng.integers(0, 10**6, 50))) for k in range(100)]
    assert got(spark, rows) == {d: 0 if d < 1000 else d for d, _ in rows}


def test_stage_keeps_one_row_of_each_class(spark):
    text = " ".join(f"w{k}" for k in range(50))
    other = " ".join(f"v{k}" for k in range(50))
    rows = [(1, text), (1, text), (2, text), (3, other), (3, text + " end"), (None, other), (None, "alone"), (None, "alone"), (7, None), (8, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _key int")
    out = sorted(((r.doc_id, r.text) for r in near_duplicates.stage(spark, docs, SMALL).collect()), key=str)
    assert out == sorted([(1, text), (3, other), (None, "alone"), (7, None)], key=str)


def test_intermediates_are_deleted(spark):
    written = []
    before = common.stored
    try:
        common.stored = lambda df, name: written.append(before(df, name)) or written[-1]
        got(spark, [(1, "a b c d e f"), (2, "a b c d e f g"), (3, "x")])
    finally:
        common.stored = before
    assert len(written) > 10 and not any(common.exists(spark, path) for _, path in written)
