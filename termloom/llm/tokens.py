"""Whole texts to token ids with a `tokenizers` file, each distinct piece of text encoded once per worker.

Both supported kinds of file split a text before they merge bytes, and never join what lies on two sides of a cut made
here: before a run of ASCII blanks, and between an ASCII letter and an ASCII mark other than the apostrophe. Pieces
between cuts are looked up by a 64-bit code in a bounded table that holds their bytes; only unseen ones reach the
tokenizer, and what is found is compared byte by byte. Texts that hold anything whose meaning may reach across a cut
(other blanks, a special token's opening, a capital sigma), or a piece whose code belongs to another one, are encoded whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import _SPACE, HASHED, same_spans, span_codes, spread
from .workers import keeps

#: Distinct pieces, and bytes of them, that a worker remembers; the table starts anew beyond either.
REMEMBERED, REMEMBERED_BYTES = 1 << 21, 1 << 26

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) != "'"]] = True

#: What makes a text be encoded whole.
_WHOLE = r"<\||Σ|[\x00-\x08\x0e-\x1f\x7f]|\x{85}|\x{a0}|\x{1680}|[\x{2000}-\x{200f}]|\x{2028}|\x{2029}|\x{202f}|\x{205f}|\x{2060}|\x{3000}|\x{feff}"


class _Memo:
    """Open addressing from 64-bit codes to id lists, filled and read by whole arrays; pieces with hashed codes are kept too."""

    def __init__(self, entries: int) -> None:
        self.limit = entries
        self.mask = (1 << (entries * 2 - 1).bit_length()) - 1
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(self.mask + 1, np.uint64)
        self.entry = np.zeros(self.mask + 1, np.int32)
        self.start = np.zeros(self.limit + 1, np.int64)
        self.n = 0
        self.ids = np.zeros(1 << 16, np.uint32)
        self.text = np.zeros(1 << 16, np.uint8)
        self.span = np.zeros((self.limit + 1, 2), np.int64)
        self.used = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry numbers, -1 where unknown."""
        slot = (h & np.uint64(self.mask)).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == h, self.entry[slot], -1)
        left = np.flatnonzero((key != h) & (key != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            key = self.keys[slot[left]]
            hit = key == h[left]
            out[left[hit]] = self.entry[slot[left[hit]]]
            left = left[~hit & (key != 0)]
        return out

    def add(self, h: np.ndarray, lists: list[list[int]], data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Distinct unknown codes with their ids, and the pieces ``data[start:end]`` themselves."""
        kept = np.where(h >= np.uint64(HASHED), end - start, 0)
        _, at = spread(start, kept)
        while len(self.text) < self.used + len(at) + 8:
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        self.text[self.used : self.used + len(at)] = data[at]
        ends = self.used + kept.cumsum()
        self.span[self.n : self.n + len(h)] = np.stack([ends - kept, ends], axis=1)
        self.used += len(at)
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        end = self.start[self.n] + counts.cumsum()
        self.start[self.n + 1 : self.n + 1 + len(h)] = end
        while len(self.ids) < end[-1]:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.start[self.n] : end[-1]] = np.fromiter((i for x in lists for i in x), np.uint32, int(counts.sum()))
        number = np.arange(self.n, self.n + len(h), dtype=np.int32)
        slot, left = (h & np.uint64(self.mask)).astype(np.int64), np.arange(len(h))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = h[free]
            won = free[self.keys[slot[free]] == h[free]]
            self.entry[slot[won]] = number[won]
            left = left[self.keys[slot[left]] != h[left]]
            slot[left] = (slot[left] + 1) & self.mask
        self.n += len(h)


class Encoder:
    """``blanks``: whether the file's tokens hold the blanks before a word (byte-level files) or drop them."""

    def __init__(self, path: str, blanks: bool) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.blanks = blanks
        self.memo = _Memo(REMEMBERED)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        blank = _SPACE[data]
        begins, before = np.zeros(len(data) + 1, bool), np.ones(len(data) + 1, bool)
        before[1:-1] = blank[:-1]
        before[offsets[:-1]] = True
        begins[:-1] = _MARK[data]
        begins[1:-1] &= _LETTER[data[:-1]]
        begins[0] = False
        if self.blanks:
            begins[:-1] |= blank & ~before[:-1]
            begins[offsets[:-1][np.diff(offsets) > 0]] = True
            start = np.flatnonzero(begins[:-1])
            return start, np.append(start[1:], len(data))
        begins[:-1] |= ~blank & before[:-1]
        ends = np.zeros(len(data) + 1, bool)
        ends[1:] = begins[1:]
        ends[1:-1] |= blank[1:] & ~blank[:-1]
        ends[offsets[1:]] = True
        ends[1:] &= ~blank
        return np.flatnonzero(begins[:-1]), np.flatnonzero(ends[1:]) + 1

    def encode(self, texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, given also as one run of bytes, and where each text's ids begin."""
        start, end = self._pieces(data, offsets)
        h = span_codes(data, start, end)  # never 0: no piece is empty
        entry = self.memo.find(h)
        new, at = np.unique(h[entry < 0], return_index=True)
        if len(new):
            if self.memo.n + len(new) > self.memo.limit or self.memo.used > REMEMBERED_BYTES:
                self.memo.clear()
                if len(h) > self.memo.limit:
                    self.memo = _Memo(len(h))
                new, at = np.unique(h, return_index=True)
                where = at
            else:
                where = np.flatnonzero(entry < 0)[at]
            raw = data.tobytes()
            lists = self._encode([raw[s:e].decode() for s, e in zip(start[where].tolist(), end[where].tolist())])
            self.memo.add(new, lists, data, start[where], end[where])
            entry = self.memo.find(h)
        hashed = np.flatnonzero(h >= np.uint64(HASHED))
        span = self.memo.span[entry[hashed]]
        foreign = hashed[~same_spans(data, start[hashed], end[hashed], self.memo.text, span[:, 0], span[:, 1], slack=True)]
        count = self.memo.start[entry + 1] - self.memo.start[entry]
        total = np.concatenate([[0], count.cumsum()])
        ids = self.memo.ids[np.repeat(self.memo.start[entry] - total[:-1], count) + np.arange(total[-1])]
        first = total[np.searchsorted(start, offsets)]
        whole = pc.match_substring_regex(texts.fill_null(""), _WHOLE).to_numpy(zero_copy_only=False).copy()
        whole[np.searchsorted(offsets, start[foreign], "right") - 1] = True
        whole = np.flatnonzero(whole)
        if len(whole):
            own = dict(zip(whole.tolist(), self._encode(texts.take(pa.array(whole)).to_pylist())))
            parts = [np.array(own[i], np.uint32) if i in own else ids[first[i] : first[i + 1]] for i in range(len(texts))]
            ids, first = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, first


_encoders: dict[tuple[str, bool], Encoder] = {}
keeps("tokens", _encoders.clear)


def encoder(path: str, blanks: bool) -> Encoder:
    """This worker's encoder of a file."""
    if (path, blanks) not in _encoders:
        _encoders[path, blanks] = Encoder(path, blanks)
    return _encoders[path, blanks]


def with_end(ids: np.ndarray, first: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids followed by ``end_id``."""
    out = np.insert(ids, first[1:], end_id)
    return out, first + np.arange(len(first))
