"""Byte-level BPE encoding with the tokenizers library, word pieces cached.

Texts are cut where the usual pattern of byte-level vocabularies always starts a
new pre-token, and the stretches between are encoded alone. The cuts are found
on the bytes of a whole batch, Arrow's dictionary encoding keeps each distinct
stretch of the batch once, and each goes through the library once per worker;
documents are then assembled by array gathers.
"""

from __future__ import annotations

import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa

from vellumgrid.llm.common import ragged, text_buffers

#: ASCII white space, and the control characters that some patterns count so.
_WHITE = np.zeros(256, bool)
_WHITE[[*range(9, 14), *range(28, 33)]] = True
#: Letters are 1, punctuation is 2; an apostrophe may open a contraction, so it is neither.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[c for c in range(128) if chr(c).isalpha()]] = 1
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = 2
#: UTF-8 of white space beyond ASCII.
_WIDE = tuple(chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def _wide_at(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether one of the wide white space characters begins at each place."""
    out = np.zeros(len(at), bool)
    for k in np.flatnonzero(np.isin(raw[at], [w[0] for w in _WIDE])).tolist():
        out[k] = raw[at[k] : at[k] + 3].tobytes().startswith(_WIDE)
    return out


def _inside(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Those places whose neighbours on both sides are no white space."""
    at = at[(at > 0) & (at < len(raw) - 1)]
    at = at[~_WHITE[raw[at - 1]] & ~_WHITE[raw[at + 1]]]
    two, three = np.maximum(at - 2, 0), np.maximum(at - 3, 0)
    bad = _wide_at(raw, at + 1) | (_wide_at(raw, two) & (raw[two] == 0xC2)) | (_wide_at(raw, three) & (raw[three] >= 0xE0))
    return at[~bad]


def stretches(raw: np.ndarray, offs: np.ndarray, special: re.Pattern | None = None) -> np.ndarray:
    """The first byte of each stretch of the texts. Stretches begin at texts'
    starts, at single spaces, before and after single line ends, and where ASCII
    or Latin-1 letters meet ASCII punctuation, apostrophes left aside: a new
    pre-token begins at each of these. Special tokens are stretches of their own."""
    kind = _CLASS[raw]
    latin = np.flatnonzero(raw[:-1] == 0xC3)
    latin = latin[(raw[latin + 1] != 0x97) & (raw[latin + 1] != 0xB7)]
    kind[latin] = kind[latin + 1] = 1
    text = np.zeros(len(raw) + 1, bool)
    text[offs] = True
    edge = text.copy()
    edge[1:-1] |= (kind[:-1] ^ kind[1:]) == 3
    for mark in (32, 10):
        at = _inside(raw, np.flatnonzero(raw == mark))
        at = at[~text[at] & ~text[at + 1]]  # not a text's own first or last character
        edge[at] = True
        if mark == 10:
            edge[at + 1] = True
    for m in special.finditer(raw.tobytes()) if special else ():
        if not text[m.start() + 1 : m.end()].any():
            edge[m.start() + 1 : m.end()] = False
            edge[[m.start(), m.end()]] = True
    return np.flatnonzero(edge[:-1])


def distinct(raw: np.ndarray, begin: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct stretches, and for each stretch the number of its own."""
    places = np.append(begin, len(raw)).astype(np.int32)
    rows = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(raw))])
    coded = rows.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class CachedEncoder:
    """Encodes texts to the ids that the library gives for the whole text.

    When the cache holds ``limit`` stretches, those met most often stay and make
    up at most half of it, so memory is bounded. A special token's string in a
    text gives its id, as the library's plain call does.
    """

    def __init__(self, path: str, limit: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.vocabulary = self.library.get_vocab_size()
        blank = self.library.encode(" ", add_special_tokens=False).tokens[0]
        self.opens = np.zeros(self.vocabulary, bool)  # ids whose bytes begin with a space
        for token, k in self.library.get_vocab().items():
            self.opens[k] = token.startswith(blank)
        self.line_end = self.library.encode("\n", add_special_tokens=False).ids[-1]
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        added = made["added_tokens"]
        before = made["pre_tokenizer"] or {}
        #: other files' texts are encoded whole
        self.usual = (before.get("type"), before.get("add_prefix_space"), before.get("use_regex"), made["normalizer"]) == ("ByteLevel", False, True, None) and not any(
            t["single_word"] or t["lstrip"] or t["rstrip"] or not t["content"].strip() for t in added
        )
        names = sorted((t["content"].encode() for t in added), key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, names))) if names else None
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.offs = np.zeros(1 << 14, np.int64)
        self.hits = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _thin(self) -> None:
        """Keep the stretches met often, up to half the limit."""
        n = len(self.index)
        hits = self.hits[:n]
        floor = max(2, int(np.partition(hits, n - self.limit // 2)[n - self.limit // 2]) + 1) if n > self.limit // 2 else 2
        keep = np.flatnonzero(hits >= floor)
        names = list(self.index)  # in the order of their numbers
        kept = [names[k] for k in keep.tolist()]
        flat, lens = ragged(self.flat, self.offs[: n + 1], keep)
        flat = flat.copy()
        self._clear()
        self._add(kept, flat, lens)

    def _learn(self, new: list[bytes]) -> None:
        """Stretches without white space but for a first space go to the library
        many to a text: ids that begin with a space, or line ends put between
        them, tell them apart."""
        for k in range(0, len(new), 20_000):
            spaced, bare, odd = [], [], []
            for p in new[k : k + 20_000]:
                word = p.decode()
                cut = word.split()
                if len(cut) == 1 and word == cut[0]:
                    bare.append((p, word))
                elif len(cut) == 1 and word == " " + cut[0]:
                    spaced.append((p, word))
                else:
                    odd.append((p, word))
            for group, mark in ((spaced, ""), (bare, "\n")):
                texts = [mark + mark.join([w for _, w in group[j : j + 500]]) for j in range(0, len(group), 500)]
                part = self.library.encode_batch_fast(texts, add_special_tokens=False)
                ids = np.fromiter(itertools.chain.from_iterable(e.ids for e in part), np.uint32)
                starts = ids == self.line_end if mark else self.opens[ids]
                begin = np.flatnonzero(starts)
                if len(begin) != len(group):
                    raise ValueError("the vocabulary joins words across white space")
                n = np.diff(np.append(begin, len(ids)))
                self._add([p for p, _ in group], ids[~starts] if mark else ids, n - 1 if mark else n)
            part = self.library.encode_batch_fast([w for _, w in odd], add_special_tokens=False)
            rows = [e.ids for e in part]
            self._add([p for p, _ in odd], np.fromiter(itertools.chain.from_iterable(rows), np.uint32), np.fromiter(map(len, rows), np.int64, len(rows)))

    def _add(self, names: list[bytes], ids: np.ndarray, n: np.ndarray) -> None:
        count, need = len(self.index), self.used + len(ids)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(need, len(self.flat)), np.uint32)])
        if count + len(n) + 1 > len(self.offs):
            self.offs = np.concatenate([self.offs, np.zeros(max(count + len(n) + 1, len(self.offs)), np.int64)])
        self.flat[self.used : need] = ids
        self.offs[count + 1 : count + len(n) + 1] = self.used + np.cumsum(n)
        self.used = need
        if len(self.hits) < len(self.offs):
            self.hits = np.concatenate([self.hits, np.zeros(len(self.offs) - len(self.hits), np.int64)])
        self.index.update(zip(names, range(count, count + len(n)), strict=True))

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of ids of each text."""
        raw, offs = text_buffers(texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.string()))
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
        begin = stretches(raw, offs, self.special) if self.usual else np.unique(offs[:-1][np.diff(offs) > 0])
        names, which = distinct(raw, begin)
        if len(self.index) > self.limit:
            self._thin()
        slot = np.fromiter(map(self.index.get, names, itertools.repeat(-1)), np.int64, len(names))
        unseen = np.flatnonzero(slot < 0)
        if len(unseen):
            fresh = [names[k] for k in unseen.tolist()]
            self._learn(fresh)
            slot[unseen] = np.fromiter(map(self.index.__getitem__, fresh), np.int64, len(fresh))
        self.hits[slot] += np.bincount(which, minlength=len(names))
        ids, n = ragged(self.flat, self.offs[: len(self.index) + 1], slot[which])
        ends = np.concatenate([[0], np.cumsum(n)])
        return ids, np.diff(ends[np.searchsorted(begin, offs)])


_encoders: dict[str, CachedEncoder] = {}


def encoder(path: str) -> CachedEncoder:
    """One encoder per worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = CachedEncoder(path)
    return _encoders[path]
