from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumgrid.llm import pieces


@pytest.fixture(scope="module")
def code():
    return pieces.Pieces(pieces.default_vocabulary())


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=pieces.default_vocabulary())


def split(ids, n):
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] if len(n) else []


PARTS = st.sampled_from([*"abcdeilnorst.,'éß日😀\n\t\x00▁<1", " ", "  ", " " * 17, "the", "ing", "ooo", "http://", "<s>"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=20).map("".join), min_size=1, max_size=8))
def test_ids_equal_the_library(code, library, texts):
    assert split(*code.encode(texts)) == library.encode(texts)


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("abeilnorst.日"), min_size=1, max_size=30))
def test_viterbi_equals_merges(code, word):
    ids, _ = code.viterbi([word, word[::-1], word])
    plain = [code.number[t] for w in (word, word[::-1], word) for t in pieces.merged(list(w), code.ranks) if t in code.number]
    assert [i for i in ids.tolist() if i not in code.bytes_] == plain


def test_known_segmentation(library, code):
    ids, _ = code.encode(["The quick brown"])
    assert [library.id_to_piece(i) for i in ids.tolist()] == ["▁The", "▁quick", "▁brown"]


@pytest.mark.parametrize("size", [400_000, 1_100_000])
def test_words_of_any_length(code, library, size):
    rng = np.random.default_rng(size)
    word = "".join("abcdefghijklmnopqrstuvwxyz"[k] for k in rng.integers(0, 26, size))
    assert split(*code.encode([word, "a"])) == library.encode([word, "a"])


def test_small_cache(library):
    code = pieces.Pieces(pieces.default_vocabulary(), limit=10)
    for k in range(5):
        texts = [f"word{k} other{j} the" for j in range(20)]
        assert split(*code.encode(texts)) == library.encode(texts)


def test_query_equals_the_library(spark, library):
    import pyarrow.parquet as pq

    small = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_pieces, r.ids_crc32, r.round_trip) for r in pieces.query(spark, small).collect()}
    docs = pq.read_table(f"{small}/documents.parquet").to_pylist()
    ids = library.encode([r["text"] or "" for r in docs])
    assert got == {r["doc_id"]: (len(i), zlib.crc32(np.array(i, "<u4").tobytes()), True) for r, i in zip(docs, ids, strict=True)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_round_trip(code, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, n = code.encode(texts)
    assert code.decode(ids, n) == [t.replace("▁", " ") for t in texts]


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "  two  blanks "), (4, "x" * 20_000), (5, "tail\n"), (5, "tail\n"), (None, "no id"), (6, "word " * 40_000)]
    docs = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, n_pieces int, piece_ids string")
    out = pieces.encoded(docs)
    assert all(r.round_trip and r.ids_crc32 == zlib.crc32(bytes(r.piece_ids)) and r.n_pieces * 4 == len(r.piece_ids) for r in out.collect())
    back = sorted(((r.doc_id, r.text) for r in pieces.decoded(out).collect()), key=str)
    assert back == sorted([(a, b or "") for a, b in rows], key=str)
    assert pieces.encoded(docs.limit(0)).count() == 0
