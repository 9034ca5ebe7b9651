"""SentencePiece encoding and decoding by a batched numpy Viterbi search.

The ids are those of the library. A vocabulary file of merges defines, for each
text, one segmentation: the best-ranked pair of neighbours is merged, the
leftmost of equals first, until no pair is a piece. Every beginning of such a
segmentation is the segmentation of its own text, so a dynamic program over the
text's places finds it: at a place ends the longest piece that may follow the
last piece at its own start. Whether piece ``t`` may follow piece ``u`` depends on
the two alone: their merges are undone in turn, latest first, and no two symbols
that stand beside each other meanwhile may have a piece that merges earlier than
either is used up. (The sum of the file's scores, its merge ranks, would give
other ids. A file whose merges aren't ordered like that is refused.)

Words of one length form a matrix and advance together: the hashes of all
substrings of one size are looked up in the sorted keys of that size's pieces,
hits are compared character by character, and at each place the maximum over
starts is kept as the backpointer. A character in no piece is written as its
UTF-8 bytes' pieces. Texts are cut at blanks and between ASCII characters that no
piece holds side by side; each distinct word is searched once per worker.

Edge cases: null and empty texts have no ids and decode to the empty text; a
``▁`` in the text is a blank to the vocabulary, so it decodes to a blank; texts
and words of any length are encoded whole; repeated rows are encoded as often as
they stand; at each place one piece fits, so there are no ties; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.llm import bpe, common

BLANK = "▁"
_P = np.uint64(0x27D4EB2F165667C5)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _points(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le", "replace"), np.uint32)


def merged(symbols: list[str], rank: dict[str, float]) -> list[str]:
    """The segmentation by merges, step by step: the best pair, the leftmost first."""
    import heapq

    n = len(symbols)
    part, after, before = list(symbols), [*range(1, n), -1], list(range(-1, n - 1))
    heap = [(rank[a + b], k, a + b) for k, (a, b) in enumerate(itertools.pairwise(part)) if a + b in rank]
    heapq.heapify(heap)
    while heap:
        _, k, both = heapq.heappop(heap)
        j = after[k]
        if part[k] is None or j < 0 or part[k] + part[j] != both:
            continue
        part[k], part[j] = both, None
        after[k] = after[j]
        if after[j] >= 0:
            before[after[j]] = k
        for x, y in ((before[k], k), (k, after[k])):
            if x >= 0 and y >= 0 and part[x] + part[y] in rank:
                heapq.heappush(heap, (rank[part[x] + part[y]], x, part[x] + part[y]))
    return [x for x in part if x is not None]


class _Less(dict):
    """Ranks under a bound: the pieces there are before that merge."""

    def __init__(self, ranks: dict[str, int], bound: int):
        self.ranks, self.bound = ranks, bound

    def __contains__(self, t: object) -> bool:
        return self.ranks.get(t, self.bound) < self.bound

    def __getitem__(self, t: str) -> int:
        return self.ranks[t]


class Pieces:
    """A vocabulary with its search tables."""

    def __init__(self, path: str, limit: int = 300_000):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.size, self.limit = model.get_piece_size(), limit
        texts = [model.id_to_piece(k) for k in range(self.size)]
        plain = [k for k in range(self.size) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))]
        self.bytes_ = np.full(256, model.unk_id(), np.int64)
        for k in range(self.size):
            if model.is_byte(k):
                self.bytes_[int(texts[k][1:-1], 16)] = k
        self.number = {texts[k]: k for k in plain}
        self.ranks = {texts[k]: -model.get_score(k) for k in plain}
        if any(BLANK in t.lstrip(BLANK) for t in self.number):
            raise ValueError("a piece goes on after a blank")
        # runs of blanks are segmented apart; the pieces of words
        usual = sorted((t for t in self.number if len(t) == 1 or t.strip(BLANK)), key=self.ranks.get)
        self._merges(usual)
        by_length: dict[int, list[str]] = {}
        for t in usual:
            if self.stable[self.number[t]]:
                by_length.setdefault(len(t), []).append(t)
        self.tables = {}
        for n, own in by_length.items():
            rows = np.stack([_points(t) for t in own])
            keys = np.zeros(len(own), np.uint64)
            for c in range(n):
                keys = keys * _P + rows[:, c].astype(np.uint64) + np.uint64(1)
            order = np.argsort(keys, kind="stable")
            self.tables[n] = (keys[order], rows[order], np.array([self.number[t] for t in own], np.int32)[order])
        # bytes that stand side by side in a piece
        self.beside = np.zeros(1 << 16, bool)
        for t in self.number:
            data = np.frombuffer(t.replace(BLANK, " ").encode(), np.uint8).astype(np.int64)
            self.beside[data[:-1] * 256 + data[1:]] = True
        wide = np.arange(1 << 16)
        self.beside[(wide >= 128 * 256) | (wide % 256 >= 128)] = True  # characters beyond ASCII stay whole
        self.known_pairs, self.pair_valid = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        # what each id decodes to
        surface = [bytes([int(t[1:-1], 16)]) if model.is_byte(k) else b"" if model.is_control(k) else (" ⁇ " if model.is_unknown(k) else t.replace(BLANK, " ")).encode() for k, t in enumerate(texts)]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_offs = np.concatenate([[0], np.cumsum([len(s) for s in surface])])
        self._clear()

    def _merges(self, usual: list[str]) -> None:
        """Each piece's rank, its last merge, and all pairs of pieces that make one."""
        self.rank = np.full(self.size, -1, np.int64)  # characters are there from the start
        self.left, self.right = np.full(self.size, -1, np.int64), np.full(self.size, -1, np.int64)
        self.stable = np.zeros(self.size, bool)
        ranks = {t: k for k, t in enumerate(usual)}
        pairs = []
        for t, r in ranks.items():
            k = self.number[t]
            if len(t) == 1:
                self.stable[k] = True
                continue
            self.rank[k] = r
            pairs += [(self.number[t[:c]], self.number[t[c:]], r) for c in range(1, len(t)) if t[:c] in ranks and t[c:] in ranks]
            halves = merged(list(t), _Less(ranks, r))
            if len(halves) == 2 and halves[0] + halves[1] == t:
                self.left[k], self.right[k] = (self.number[h] for h in halves)
                self.stable[k] = True
        if len({self.ranks[t] for t in usual if len(t) > 1}) < sum(len(t) > 1 for t in usual):
            raise ValueError("two pieces have one rank")
        table = np.array(pairs, np.int64).reshape(-1, 3)
        keys = table[:, 0] * self.size + table[:, 1]
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], table[order, 2]

    def _fits(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether pieces ``t`` may follow pieces ``u``; after a character of no piece (-1) all may."""
        out = np.ones(len(u), bool)
        ask = np.flatnonzero(u >= 0)
        key = u[ask] * self.size + t[ask]
        slot = (common.mix64(key) & np.uint64(len(self.known_pairs) - 1)).astype(np.int64)
        known = self.known_pairs[slot] == key
        out[ask[known]] = self.pair_valid[slot[known]]
        ask, key, slot = ask[~known], key[~known], slot[~known]
        if len(ask):
            fresh, back = np.unique(key, return_inverse=True)
            valid = self._undo(fresh // self.size, fresh % self.size)
            out[ask] = valid[back]
            self.known_pairs[slot], self.pair_valid[slot] = key, valid[back]
            again = self.known_pairs[slot] != key  # several pairs met in one slot: the last one's answer is there
            if again.any():
                self.known_pairs[slot[again]] = -1
        return out

    def _undo(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The test of ``_fits``: symbols a and b, each used up at a rank, side by side."""
        out = np.ones(len(a), bool)
        at = np.arange(len(a))
        never = np.iinfo(np.int64).max
        end_a, end_b = np.full(len(a), never), np.full(len(a), never)
        while len(at):
            key = a * self.size + b
            slot = np.searchsorted(self.pair_keys, key)
            slot[slot == len(self.pair_keys)] = 0
            r = np.where(self.pair_keys[slot] == key, self.pair_ranks[slot], never)
            crossed = (r < end_a) & (r <= end_b) & (r < never)  # of equal ranks the left one merges first
            out[at[crossed]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~crossed & ((ra >= 0) | (rb >= 0))
            undo_a = ra > rb
            end_a, end_b = np.where(undo_a, ra, end_a), np.where(undo_a, end_b, rb)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            at, a, b, end_a, end_b = at[go], a[go], b[go], end_a[go], end_b[go]
        return out

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.offs = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and their numbers."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        results: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # word, place, id
        for n in np.unique(lens[lens > 0]).tolist():
            at = np.flatnonzero(lens == n)
            step = max(1, 200_000 // n)
            for lo in range(0, len(at), step):
                part = at[lo : lo + step]
                w, p, i = self._search(_points("".join([words[k] for k in part.tolist()])).reshape(len(part), n))
                results.append((part[w], p, i))
        if not results:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        w, p, i = (np.concatenate(x) for x in zip(*results, strict=True))
        order = np.lexsort((p, w))
        return i[order], np.bincount(w, minlength=len(words))

    def _hits(self, m: np.ndarray) -> dict[int, np.ndarray]:
        """For each size: the piece that ends at each place, or -1."""
        rows, n = m.shape
        out, keys = {}, np.zeros((rows, n + 1), np.uint64)
        for size in range(1, min(n, max(self.tables)) + 1):
            keys = keys[:, :-1] * _P + m[:, size - 1 :].astype(np.uint64) + np.uint64(1)
            if size not in self.tables:
                continue
            known, codes, ids = self.tables[size]
            slot = np.searchsorted(known, keys.ravel())
            slot[slot == len(known)] = 0
            hit = np.flatnonzero(known[slot] == keys.ravel())
            row, start, slot = hit // keys.shape[1], hit % keys.shape[1], slot[hit]
            same = np.ones(len(hit), bool)
            for c in range(size):
                same &= m[row, start + c] == codes[slot, c]
            if same.any():
                out[size] = np.full((rows, n + 1), -1, np.int32)
                out[size][row[same], start[same] + size] = ids[slot[same]]
        return out

    def _search(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All rows of one length together: (row, place, id) of the pieces."""
        rows, n = m.shape
        hits = self._hits(m)
        sizes = sorted(hits, reverse=True)
        some = {size: (hits[size] >= 0).any(axis=0).tolist() for size in sizes}
        back, piece = np.zeros((rows, n + 1), np.int8), np.full((rows, n + 1), -1, np.int64)
        for end in range(1, n + 1):
            left = None  # rows without a piece so far; all of them at first
            for size in sizes:
                if not some[size][end]:
                    continue
                ids = hits[size][:, end] if left is None else hits[size][left, end]
                at = np.flatnonzero(ids >= 0)
                t, row = ids[at].astype(np.int64), at if left is None else left[at]
                if size < end:
                    ok = self._fits(piece[row, end - size], t)
                    t, row = t[ok], row[ok]
                piece[row, end], back[row, end] = t, size
                left = np.flatnonzero(back[:, end] == 0)
                if not len(left):
                    break
            else:
                left = np.flatnonzero(back[:, end] == 0)
                back[left, end] = 1  # a character of no piece
        out_w, out_p, out_i = [], [], []
        row, at = np.arange(rows), np.full(rows, n, np.int64)
        while len(row):
            ids = piece[row, at]
            place = at * 8
            known = ids >= 0
            out_w.append(row[known])
            out_p.append(place[known])
            out_i.append(ids[known])
            for r, a in zip(row[~known].tolist(), at[~known].tolist(), strict=True):
                data = chr(int(m[r, a - 1])).encode("utf-8", "replace")
                out_w.append(np.full(len(data), r))
                out_p.append(a * 8 + np.arange(len(data)))
                out_i.append(self.bytes_[np.frombuffer(data, np.uint8)])
            at = at - back[row, at]
            row, at = row[at > 0], at[at > 0]
        return np.concatenate(out_w), np.concatenate(out_p), np.concatenate(out_i)

    def _blanks(self, n: int) -> list[int]:
        return [self.number[t] for t in merged([BLANK] * n, self.ranks)] if n else []

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, blanks before them included. A run of blanks merges after
        all else, so of several only the last one belongs to the word."""
        bodies, runs = [], []
        for k, w in enumerate(words):
            text = w.decode()
            body = text.lstrip(" ")
            blanks = len(text) - len(body)
            bodies.append(BLANK + body if blanks and body else body)
            if blanks > 1 or not body:
                runs.append((k, blanks))
        ids, n = self.viterbi(bodies)
        if not runs:
            return ids, n
        ends = np.concatenate([[0], np.cumsum(n)])
        rows = np.split(ids, ends[1:-1])
        alone = self.number.get(BLANK, -1)
        for k, blanks in runs:
            if len(rows[k]) == 0:
                rows[k] = np.array(self._blanks(blanks), np.int64)
            elif rows[k][0] == alone:
                rows[k] = np.concatenate([np.array(self._blanks(blanks), np.int64), rows[k][1:]])
            else:
                rows[k] = np.concatenate([np.array(self._blanks(blanks - 1), np.int64), rows[k]])
        return np.concatenate(rows), np.array([len(r) for r in rows], np.int64)

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of ids of each text."""
        column = texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.string())
        column = pc.replace_substring(column.fill_null(""), BLANK, " ")
        column = pc.if_else(pc.equal(column, ""), "", pc.binary_join_element_wise("", column, " "))
        raw, offs = common.text_buffers(column)
        if not len(raw):
            return np.zeros(0, np.int64), np.zeros(len(offs) - 1, np.int64)
        edge = np.zeros(len(raw) + 1, bool)
        edge[1:-1] = ~self.beside[raw[:-1].astype(np.int32) * 256 + raw[1:]]
        blank = raw == 32
        edge[1:-1] |= blank[1:] & ~blank[:-1]
        edge[1:-1] &= ~blank[:-1]  # blanks stay with the word after them
        edge[offs] = True
        begin = np.flatnonzero(edge[:-1])
        names, which = bpe.distinct(raw, begin)
        if len(self.index) > self.limit:
            self._clear()
        slot = np.fromiter(map(self.index.get, names, itertools.repeat(-1)), np.int64, len(names))
        unseen = np.flatnonzero(slot < 0)
        if len(unseen):
            fresh = [names[k] for k in unseen.tolist()]
            ids, n = self._words(fresh)
            slot[unseen] = np.arange(len(self.index), len(self.index) + len(fresh))
            self.index.update(zip(fresh, slot[unseen].tolist(), strict=True))
            self.flat = np.concatenate([self.flat, ids])
            self.offs = np.concatenate([self.offs, self.offs[-1] + np.cumsum(n)])
        ids, n = common.ragged(self.flat, self.offs, slot[which])
        ends = np.concatenate([[0], np.cumsum(n)])
        return ids, np.diff(ends[np.searchsorted(begin, offs)])

    def decode(self, ids: np.ndarray, n: np.ndarray) -> list[str]:
        data, sizes = common.ragged(self.surface, self.surface_offs, ids)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = ends[np.concatenate([[0], np.cumsum(n)])]
        raw = data.tobytes()
        out = [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return [t[1:] if t.startswith(" ") else t for t in out]


_loaded: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encoded(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit
    integers), round_trip (the ids decode to the text, its ``▁`` as blanks) and,
    ``with_ids``, piece_ids in that binary form."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        code = loaded(path)
        for whole in batches:
            for batch in common.slices(whole, "text", 2_000_000):
                ids, n = code.encode(batch.column("text"))
                back = pa.array(code.decode(ids, n), pa.string())
                ends = np.concatenate([[0], np.cumsum(n)])
                small = ids.astype("<u4")
                packed = [small[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                same = pc.equal(pc.replace_substring(batch.column("text").fill_null(""), BLANK, " "), back)
                cols = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([zlib.crc32(x) for x in packed], pa.int64()), same]
                names = ["doc_id", "n_pieces", "ids_crc32", "round_trip"]
                if with_ids:
                    cols.append(pa.array(packed, pa.binary()))
                    names.append("piece_ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean" + (", piece_ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def decoded(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and text of rows with piece_ids."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        code = loaded(path)
        for batch in batches:
            packed = batch.column("piece_ids").to_pylist()
            n = np.array([len(x or b"") // 4 for x in packed], np.int64)
            ids = np.frombuffer(b"".join(x or b"" for x in packed), "<u4").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(code.decode(ids, n), pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), "piece_ids").mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(common.table(spark, sf_dir, "documents"), with_ids=False)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encoded(docs)
