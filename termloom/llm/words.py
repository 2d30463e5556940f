"""Vectorised word kernels shared by the text operators.

Everything here works on the UTF-8 bytes of a whole Arrow batch with NumPy, a slice of documents at a time, so that
memory follows ``SLICE_BYTES`` (or the longest single document) and never the batch or the partition.
A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``; those bytes never occur inside a multi-byte character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Documents are handled in slices of about so many bytes.
SLICE_BYTES = 1 << 20

_U = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (multiply, xor-shift, three rounds)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def _mix63(x: np.ndarray) -> np.ndarray:
    """The same on 63-bit words: one-to-one there."""
    low = _U((1 << 63) - 1)
    x = x ^ (x >> _U(31))
    x = (x * _U(0xD6E8FEB86659FD93)) & low
    x ^= x >> _U(32)
    x = (x * _U(0xD6E8FEB86659FD93)) & low
    return x ^ (x >> _U(32))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The lowest k bytes of a 64-bit word.
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)
#: Codes from here on are hashes; smaller ones stand for one span each.
HASHED = 1 << 63
#: Spans up to so many bytes are read in blocks of eight, all at once; longer ones one by one.
IN_BLOCKS = 512


def _eights(data: np.ndarray, slack: bool = False) -> np.ndarray:
    """The eight bytes from every byte on as a little-endian word; zeros behind the end, where there is no ``slack``."""
    if not slack:
        data = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), 0, (1,))


def span_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit code for each of the spans ``data[start:end]``, the same for equal spans everywhere.

    A span of up to seven bytes has a code of its own, below ``HASHED``. A longer one has a hash: blocks of eight bytes go
    one after another through a mixing that is not linear. Hashes may collide; :func:`settled` finds out.
    """
    eights, size = _eights(data), (end - start).astype(np.int64)
    first = eights[start] & _BYTES[np.minimum(size, 8)]
    out = _mix63(first | (size.astype(_U) << _U(56)) & _U(HASHED - 1))
    long = np.flatnonzero(size > 7)
    if len(long):
        s, size = start[long], size[long]
        h = mix64(first[long] ^ size.astype(_U) * _U(0xA24BAED4963EE407))
        at, live = 8, np.flatnonzero((size > 8) & (size <= IN_BLOCKS))
        while len(live):
            block = eights[s[live] + at] & _BYTES[np.minimum(size[live] - at, 8)]
            h[live] = mix64(h[live] * _U(_MULT) ^ block)
            at += 8
            live = live[size[live] > at]
        for i in np.flatnonzero(size > IN_BLOCKS).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(data[s[i] : s[i] + size[i]].data, digest_size=8).digest(), "little")
        out[long] = h | _U(HASHED)
    return out


def same_spans(x: np.ndarray, xs: np.ndarray, xe: np.ndarray, y: np.ndarray, ys: np.ndarray, ye: np.ndarray, slack: bool = False) -> np.ndarray:
    """Whether ``x[xs:xe]`` and ``y[ys:ye]`` are the same bytes, for many pairs of spans; ``slack``: y has eight bytes to spare."""
    size = (xe - xs).astype(np.int64)
    same = size == ye - ys
    a = _eights(x)
    b = a if x is y else _eights(y, slack)
    at, live = 0, np.flatnonzero(same & (size > 0) & (size <= IN_BLOCKS))
    while len(live):
        unlike = ((a[xs[live] + at] ^ b[ys[live] + at]) & _BYTES[np.minimum(size[live] - at, 8)]) != 0
        same[live[unlike]] = False
        at += 8
        live = live[~unlike]
        live = live[size[live] > at]
    for i in np.flatnonzero(same & (size > IN_BLOCKS)).tolist():
        same[i] = np.array_equal(x[xs[i] : xe[i]], y[ys[i] : ye[i]])
    return same


def settled(data: np.ndarray, start: np.ndarray, end: np.ndarray, code: np.ndarray) -> np.ndarray:
    """``code`` such that, among these spans, equal codes mean equal bytes.

    Hashed codes are sorted and neighbours of one code compared byte by byte. Where any differ, the spans of that code
    get codes by their bytes, which no other span here has.
    """
    long = np.flatnonzero(code >= _U(HASHED))
    order = long[np.argsort(code[long], kind="stable")]
    twin = np.flatnonzero(code[order[1:]] == code[order[:-1]])
    i, j = order[twin], order[twin + 1]
    bad = ~same_spans(data, start[i], end[i], data, start[j], end[j])
    if not bad.any():
        return code
    out, taken, names, fresh = code.copy(), set(code[long].tolist()), {}, HASHED
    for k in long[np.isin(code[long], np.unique(code[i[bad]]))].tolist():
        raw = data[start[k] : end[k]].tobytes()
        if raw not in names:
            while fresh in taken:
                fresh += 1
            names[raw], fresh = fresh, fresh + 1
        out[k] = names[raw]
    return out


def packed_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes | None]]]:
    """(first row, plain values) of a column of zstd frames, unpacked for some ``limit`` of plain bytes at a time, or one
    value; the frames say how long they are. Null stays null."""
    import zstandard

    unpacker, first, held, n_held = zstandard.ZstdDecompressor(), 0, [], 0
    for row, x in enumerate(column):
        n = zstandard.frame_content_size(x.as_buffer()) if x.is_valid else 0
        if held and n_held + n > limit:
            yield first, held
            first, held, n_held = row, [], 0
        held.append(unpacker.decompress(x.as_buffer()) if x.is_valid else None)
        n_held += n
    if held:
        yield first, held


class Words(NamedTuple):
    """The words of some consecutive documents: byte spans in ``data``, their codes, and each document's first word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    code: np.ndarray
    first: np.ndarray  # of each document, and the number of words at the end


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, byte offsets of the rows) for slices of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    begins = inside[1:] & ~inside[:-1]
    ends = inside[:-1] & ~inside[1:]
    cut = offsets[1:-1]  # a document's end ends its last word
    both = cut[inside[cut] & inside[cut + 1]]
    begins[both] = True
    ends[both] = True
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return Words(data, start, end, span_codes(data, start, end), np.searchsorted(start, offsets))


def plain(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space after each, and the byte spans of the words there."""
    length = words.end - words.start
    end = (length + 1).cumsum() - 1
    out = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, np.uint8)
    # a word may begin where one ends, between documents
    inside, there = np.zeros(len(words.data) + 1, np.int8), np.ones(len(out), bool)
    inside[words.start] += 1
    inside[words.end] -= 1
    there[end] = False
    out[there] = words.data[inside.cumsum(dtype=np.int8)[:-1].view(bool)]
    return out, end - length, end


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and value of every element of the runs first[i], first[i] + 1, ... of count[i] elements."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(int(count.sum())) - np.repeat(np.concatenate([[0], count.cumsum()[:-1]]) - first, count) if len(count) else owner


def run_codes(code: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` consecutive codes, built from runs of one, two, four and so on."""
    done, out, power = 0, None, code
    while size >> done:
        if size >> done & 1:
            at = size & ((1 << done) - 1)
            out = power if out is None else mix64(out[: len(power) - at if at else None] * _U(0xC2B2AE3D27D4EB4F) + power[at:])
        done += 1
        if size >> done:
            step = 1 << done - 1
            power = mix64(power[:-step] * _U(_MULT) + power[step:]) if len(power) > step else power[:0]
        if out is not None and not len(power):
            return out[:0]
    return out


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of words, first shingle of each document) of every run of ``size`` consecutive words.

    A document of fewer words gives its whole sequence as one shingle, one without words gives none.
    """
    count = np.diff(words.first)
    have = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(have)])
    doc, at = spread(words.first[:-1], have)
    return at, np.minimum(count, size)[doc], first


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, the same for equal shingles everywhere, and each document's first one."""
    at, length, first = shingles(words, size)
    out = np.zeros(len(at), _U)
    codes = np.concatenate([words.code, np.zeros(size, _U)])
    for k in range(size):
        use = k < length
        out = out * _U(0xC2B2AE3D27D4EB4F) + np.where(use, codes[at + k] ^ _U(0x165667B19E3779F9 * (k + 1) % (1 << 64)), _U(0))
    return mix64(out + length.astype(_U)), first


def shingle_names(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers of all shingles, equal for two of these documents' shingles exactly if the shingles are the same words;
    each document's first one, and a bound of the numbers."""
    at, length, first = shingles(words, size)
    kinds, word = np.unique(settled(words.data, words.start, words.end, words.code), return_inverse=True)
    base, word = len(kinds) + 1, np.concatenate([word.astype(np.int64) + 1, np.zeros(size, np.int64)])
    out, bound = np.zeros(len(at), np.int64), 1
    for k in range(size):
        if bound * base >= 1 << 62:
            kinds, out = np.unique(out, return_inverse=True)
            out, bound = out.astype(np.int64), max(1, len(kinds))
        out = out * base + np.where(k < length, word[at + k], 0)
        bound *= base
    kinds, out = np.unique(out, return_inverse=True)
    return out.astype(np.int64), first, max(1, len(kinds))
