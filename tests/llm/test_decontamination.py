from __future__ import annotations

import re

from vellumgrid.llm import common, decontamination

SMALL = "/root/testdata/sf0.001"


def runs(text, size=5):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return [tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


def brute(docs, items):
    out = set()
    for d, t in docs:
        for i, x in items:
            mine = runs(x)
            if not mine:
                continue
            have = set(runs(t, len(mine[0])))
            half = (len(mine) + 1) // 2
            share = lambda p: sum(r in have for r in set(p)) / len(set(p)) if p else 1
            if share(mine[:half]) >= 0.8 and share(mine[half:]) >= 0.8:
                out.add((d, i))
    return out


def pairs(rows):
    return {(r.doc_id, r.item_id) for r in rows.collect()}


def test_smallest_tables(spark):
    docs = [(r.doc_id, r.text) for r in common.table(spark, SMALL, "documents").collect()]
    items = [(r.item_id, r.text) for r in common.table(spark, SMALL, "benchmark").collect()]
    assert pairs(decontamination.query(spark, SMALL)) == brute(docs, items)


def test_edges_and_shards(spark):
    item = " ".join(f"q{k}" for k in range(40))
    items = [(1, item), (2, None), (3, ""), (4, "two words"), (5, item), (6, "..."), (7, " ".join(f"long{k}" for k in range(1500)))]
    docs = [(1, "start " * 500 + item + " end" * 300), (2, None), (3, ""), (4, "some two words here"), (5, " ".join(item.split()[:20])), (1, item), (6, item.upper().replace(" ", ", ")), (7, "pad " * 2000 + items[-1][1])]
    d = spark.createDataFrame([(a, b, 0.5, 1) for a, b in docs], "doc_id long, text string, score double, item_id int")
    i = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, doc_id int")
    want = brute(docs, items)
    assert (7, 7) in want and (1, 1) in want and (6, 5) in want and (4, 4) in want and (5, 1) not in want
    assert pairs(decontamination.contaminated(d, i)) == want
    assert pairs(decontamination.contaminated(d, i, shard_bytes=200)) == want
    assert pairs(decontamination.contaminated(d.limit(0), i)) == set() == pairs(decontamination.contaminated(d, i.limit(0)))


def test_an_edited_word_in_one_half(spark):
    """One word changed, at every place: found where 0.8 of all runs are left."""
    words = [f"q{k}" for k in range(40)]
    rows = [(k, " ".join(["new" if j == k else w for j, w in enumerate(words)])) for k in range(40)]
    rows += [(100 + k, " ".join(["new" if j in (k, k + 5) else w for j, w in enumerate(words)])) for k in range(5, 30)]
    mine = set(runs(" ".join(words)))
    want = {(d, 1) for d, t in rows if len(mine & set(runs(t))) >= 0.8 * len(mine)}
    assert {(k, 1) for k in range(40)} <= want and (115, 1) not in want
    d = spark.createDataFrame(rows, "doc_id long, text string")
    i = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert pairs(decontamination.contaminated(d, i)) == want
