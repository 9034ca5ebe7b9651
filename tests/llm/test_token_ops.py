"""Token counts, the token store and the encoder under them."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumgrid.llm import bpe, token_counts, token_store

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_tokens string, kind int, name string, payload string"
ROWS = [
    (3, "plain text here", "en", "a", "x", 1, "n", "p"), (1, None, None, None, "x", 1, "n", "p"), (2, "", "en", "a", "x", 1, "n", "p"),
    (5, "word " * 30_000, "en", "a", "x", 1, "n", "p"), (4, "  odd \n\n blanks\t <|endoftext|> ", "de", "b", "x", 1, "n", "p"),
    (3, "plain text here", "en", "a", "x", 1, "n", "p"), (6, "word " * 30_000 + "end", "en", "a", "x", 1, "n", "p"), (None, "no id", "en", "a", "x", 1, "n", "p"),
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n\t.'é\x00\x1c\xa0 日"), max_size=30), max_size=6))
def test_encoder_equals_the_library(library, texts):
    code = bpe.encoder(bpe.default_vocabulary())
    ids, n = code.encode(texts)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_encoder_with_a_small_cache(library):
    code = bpe.CachedEncoder(bpe.default_vocabulary(), limit=50)
    for k in range(20):
        text = " ".join(f"w{k}x{j} the" for j in range(30))
        ids, _ = code.encode([text])
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(code.index) < 50 + 100


def test_counts_equal_brute_force(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = {(r.source, r.lang): 0 for r in token_counts.count_tokens(docs).collect()}
    for r in token_counts.count_tokens(docs).collect():
        got[(r.source, r.lang)] += r.n_tokens
    want = token_counts.brute([{"text": r[1], "lang": r[2], "source": r[3]} for r in ROWS])
    assert got == {k: v[1] for k, v in want.items()}


BATCH = "doc_id long, op string, source string, lang string, tokenizer_version string, n_tokens long, old_n_tokens long, extra int"


@pytest.fixture
def batch(spark):
    return lambda *rows: spark.createDataFrame([(*r, 1) for r in rows], BATCH)


def test_special_token_strings(library):
    ids, _ = bpe.encoder(bpe.default_vocabulary()).encode(["a <|endoftext|> b"])
    assert ids.tolist() == library.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]


def test_signed_batches(batch, spark, tmp_path):
    rollup = token_counts.TokenRollup(spark, str(tmp_path / "r"))
    assert rollup.totals().count() == 0
    assert rollup.commit("b1", batch((1, "insert", "s", "en", "v", 10, None), (2, "insert", "s", None, "v", 5, None)))
    assert not rollup.commit("b1", batch((1, "insert", "s", "en", "v", 10, None)))
    assert rollup.commit("b2", batch((1, "revise", "s", "en", "v", 12, 10), (2, "delete", "s", None, "v", None, 5)))
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "v", 1, 12)]
    rollup.compact()
    assert not rollup.commit("b2", batch((1, "revise", "s", "en", "v", 99, 12)))
    assert rollup.commit("b3", batch())
    assert rollup.commit("b4", batch((3, "insert", "t", "en", "v", 1, None)))
    rollup.compact()
    assert not rollup.committed("b9") and rollup.committed("b1") and rollup.committed("b4")
    assert sorted(map(tuple, rollup.totals().collect())) == [("s", "en", "v", 1, 12), ("t", "en", "v", 1, 1)]
    with pytest.raises(Exception, match="unknown op"):
        rollup.commit("b5", batch((3, "other", "t", "en", "v", 1, None)))
    with pytest.raises(Exception, match="a count is missing for: revise"):
        rollup.commit("b5", batch((3, "revise", "t", "en", "v", 1, None)))
    assert not rollup.committed("b5")


def test_racing_writers_count_once(batch, spark, tmp_path):
    one, two = (token_counts.TokenRollup(spark, str(tmp_path / "r")) for _ in range(2))
    rows = batch((1, "insert", "s", "en", "v", 10, None))
    first, second = one.stage(rows), two.stage(rows)  # both have found the batch missing
    assert one.publish("b", first)
    assert not two.publish("b", second)
    assert [tuple(r) for r in one.totals().collect()] == [("s", "en", "v", 1, 10)]
    one.compact()
    late = two.stage(rows)
    assert not two.publish("b", late)  # after the batch was folded
    two.compact()
    assert [tuple(r) for r in two.totals().collect()] == [("s", "en", "v", 1, 10)]


@pytest.mark.parametrize("call", ["stage", "publish", "totals", "batches", "rename", "remove"])
def test_death_at_each_step(batch, spark, tmp_path, monkeypatch, call):
    """A writer or a compaction that dies changes no total; the next try goes through."""
    rollup = token_counts.TokenRollup(spark, str(tmp_path / "r"))
    rollup.commit("b1", batch((1, "insert", "s", "en", "v", 10, None)))
    rollup.compact()
    rollup.commit("b2", batch((2, "insert", "s", "en", "v", 1, None)))
    want = [("s", "en", "v", 2, 11)]

    class Death(Exception):
        pass

    def dies(*_, **__):
        raise Death

    with monkeypatch.context() as m, pytest.raises(Death):
        if call in ("stage", "publish"):
            m.setattr(rollup, call, dies)
            rollup.commit("b3", batch((3, "insert", "s", "en", "v", 5, None)))
        else:
            name = {"totals": "_sums", "batches": "_folded"}.get(call)
            m.setattr(rollup, name, dies) if name else m.setattr(token_counts.common, call, dies)
            rollup.compact()
    assert [tuple(r) for r in rollup.totals().collect()] == want
    rollup.compact()
    assert rollup.commit("b3", batch((3, "insert", "s", "en", "v", 5, None)))
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "v", 3, 16)]


def test_count_query_equals_brute_force(spark):
    import pyarrow.parquet as pq

    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in token_counts.query(spark, SMALL).collect()}
    assert got == token_counts.brute(pq.read_table(f"{SMALL}/documents.parquet").to_pylist())


def test_store_query_equals_brute_force(spark, library):
    import pyarrow.parquet as pq

    got, start = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.query(spark, SMALL).collect()}, 0
    for r in sorted(pq.read_table(f"{SMALL}/documents.parquet").to_pylist(), key=lambda r: r["doc_id"]):
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        assert got[r["doc_id"]] == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_store_round_trip(spark, tmp_path, library):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    root = str(tmp_path / "store")
    token_store.write(docs, root)
    got = token_store.read_digests(spark, root).collect()
    want, start = [], 0
    for doc, text in sorted(((r[0] if r[0] is not None else -1), r[1] or "") for r in ROWS):
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        want.append((None if doc < 0 else doc, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    key = lambda r: r[1]
    assert sorted([(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got], key=key) == want
    chunks = spark.read.parquet(root + "/objects").filter("kind = 0")
    assert chunks.count() == chunks.select("name").distinct().count()
    back = token_store.read_documents(spark, root, [4])
    assert back[4][0].tolist() == [*library.encode(ROWS[4][1], add_special_tokens=False).ids, 0]


def test_store_of_nothing(spark, tmp_path):
    token_store.write(spark.createDataFrame([], SCHEMA), str(tmp_path / "s"))
    assert token_store.read_digests(spark, str(tmp_path / "s")).count() == 0


def test_equal_stretches_share_chunks():
    rng = np.random.default_rng(1)
    body = rng.integers(0, 50_000, 20_000).astype(np.uint32)
    a, b = body, np.concatenate([body[:7000], [5, 6, 7], body[7000:]]).astype(np.uint32)
    names = []
    for x in (a, b):
        ends = token_store.cuts(x, np.array([0, len(x)]))[0].tolist()
        names.append({x[i:j].tobytes() for i, j in zip([0, *ends[:-1]], ends, strict=True)})
        assert ends[-1] == len(x) and max(np.diff([0, *ends])) <= token_store.MOST
    assert len(names[0] & names[1]) >= 0.8 * len(names[0])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=40), min_size=1, max_size=6))
def test_crc_algebra(parts):
    rest = np.array([sum(map(len, parts[k + 1 :])) for k in range(len(parts))])
    terms = token_store._times(token_store._shift(rest), np.array([zlib.crc32(p) for p in parts], np.uint32))
    assert int(np.bitwise_xor.reduce(terms)) == zlib.crc32(b"".join(parts))
