"""Chunkers: pure SQL by words, Python by a moving cursor."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def words(s: Column) -> Column:
    return F.filter(F.split(F.coalesce(s, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def word_blocks(docs: DataFrame, sizes: tuple[int, ...] = (500, 100, 20), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, chunk_id, start_word, chunk): blocks of words without overlap, all sizes in one pass."""
    split = docs.select(id_col, words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    sized = split.withColumn("size", F.explode(F.array(*map(F.lit, sizes))))
    starts = sized.select(id_col, "size", "w", F.posexplode(F.expr("sequence(0, size(w) - 1, size)")).alias("chunk_id", "start_word"))
    return starts.select(id_col, "size", "chunk_id", "start_word", F.array_join(F.slice("w", F.col("start_word") + 1, F.col("size")), " ").alias("chunk"))


def feature_blocks(docs: DataFrame, sizes: tuple[int, ...] = (500, 100, 20), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, chunk_id, n_chars, words, kata, latin, number, capitals): lengths and counts for features of the blocks of
    :func:`word_blocks`, without their texts.

    Blocks of the sizes' greatest common divisor are searched once; blocks of each size are sums of these. ``docs`` has
    each document once.
    """
    step = math.gcd(*sizes)
    counts = ("n_chars", *text.feature_counts(F.lit("")))
    split = docs.select(id_col, words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    parts = F.transform(F.expr(f"sequence(0, size(w) - 1, {step})"), lambda at: F.array_join(F.slice("w", at + 1, step), " "))
    small = split.select(id_col, F.posexplode(parts).alias("block", "part")).select(id_col, "block", F.length("part").alias("n_chars"), *[c.alias(n) for n, c in text.feature_counts(F.col("part")).items()])
    sized = small.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).withColumn("chunk_id", F.expr(f"int(block div (size div {step}))"))
    sums = sized.groupBy(id_col, "size", "chunk_id").agg(*[F.sum(c).alias(c) for c in counts], F.count(F.lit(1)).alias("__n"))
    return sums.withColumn("n_chars", F.col("n_chars") + F.col("__n") - 1).drop("__n")  # a blank between blocks


def word_windows(docs: DataFrame, size: int = 100, least: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_id, start_word, n_words, chunk): windows at half a size from one another, none under ``least`` words."""
    step = size // 2
    split = docs.select(id_col, words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = split.select(id_col, "w", F.explode(F.expr(f"sequence(0, size(w) - 1, {step})")).alias("start_word"))
    cut = starts.select(id_col, F.expr(f"start_word div {step}").cast("int").alias("chunk_id"), "start_word", F.slice("w", F.col("start_word") + 1, size).alias("p")).where(F.size("p") >= least)
    return cut.select(id_col, "chunk_id", "start_word", F.size("p").alias("n_words"), F.array_join("p", " ").alias("chunk"))


def sentences(s: Column, mark: str = "。") -> Column:
    """Parts between marks, a line break counting as one; blank ones dropped."""
    return F.filter(F.split(F.replace(s, F.lit("\n"), F.lit(mark)), F.lit("\\Q" + mark + "\\E")), lambda x: F.trim(x) != "")


def char_windows(s: str, size: int = 2000, overlap: int = 200, marks: tuple[str, ...] = ("。", "．", "\n", "！", "？", ". ")) -> list[str]:
    """Windows of characters that end after the last mark in their second half, marks in order of priority. The places of
    marks are found once and looked up by bisection."""
    if not overlap < size // 2:
        raise ValueError("overlap must be under half the size")
    places = [(len(m), [x.start() for x in re.finditer(f"(?={re.escape(m)})", s)]) for m in marks]

    def stop(begin: int) -> int:
        """Where the window that begins here ends."""
        if begin + size >= len(s):
            return len(s)
        for length, starts in places:
            last = bisect_right(starts, begin + size - length) - 1
            if last >= 0 and starts[last] >= begin + size // 2:
                return starts[last] + length
        return begin + size

    spans = [(0, stop(0))] if s else []
    while spans and spans[-1][1] < len(s):
        begin = spans[-1][1] - overlap
        spans.append((begin, stop(begin)))
    return [s[begin:end] for begin, end in spans]


def pack_sentences(s: str, size: int = 4000, overlap: int = 400, marks: str = "。．！？\n") -> list[str]:
    """Sentences packed up to ``size``; the next pack starts within the last ``overlap`` characters, after their first mark."""
    pieces, start = [], 0
    for i, c in enumerate(s):
        if c in marks:
            pieces.append(s[start : i + 1])
            start = i + 1
    pieces.append(s[start:])
    packs, current = [], ""
    for piece in pieces:
        if current and len(current) + len(piece) > size:
            packs.append(current)
            tail = current[-overlap:]
            first = next((i for i, c in enumerate(tail) if c in marks), None)
            current = tail if first is None else tail[first + 1 :]
        current += piece
    packs.append(current)
    return [p.strip() for p in packs if p.strip()]


def paragraphs(s: str, size: int = 500, mark: str = "。", fewest: int = 5) -> list[str]:
    """Paragraphs, long ones packed by sentences; a text of few chunks is packed anew, five sentences at most in each."""
    out = []
    for part in s.split("\n\n"):
        if not part.strip():
            continue
        if len(part) <= 2 * size:
            out.append(part)
            continue
        current = ""
        for piece in part.split(mark):
            if not piece.strip():
                continue
            if current and len(current) + len(piece) >= size:
                out.append(current)
                current = ""
            current += piece + mark
        if current:
            out.append(current)
    if len(out) >= fewest:
        return out
    out, current, n = [], "", 0
    for piece in s.split(mark):
        if not piece.strip():
            continue
        current, n = current + piece + mark, n + 1
        if n >= 5 or len(current) > size:
            out.append(current)
            current, n = "", 0
    return [*out, current] if current else out


def pack_bytes(s: str, size: int = 40000, mark: str = "。") -> list[str]:
    """The text as it is up to ``size`` UTF-8 bytes; else its sentences packed to less than that, one alone if it must."""
    if len(s.encode()) <= size:
        return [s] if s.strip() else []
    out, current, n = [], "", 0
    for piece in s.split(mark):
        piece += mark
        k = len(piece.encode())
        if current and n + k >= size:
            out.append(current)
            current, n = "", 0
        current, n = current + piece, n + k
    return [x for x in [*out, current] if x.strip()]


def _split(s: str, sep: str, keep: bool) -> list[str]:
    """Parts that aren't empty; with ``keep`` a separator is the head of the part behind it."""
    parts = s.split(sep) if sep else list(s)
    if keep and sep:
        parts[1:] = [sep + x for x in parts[1:]]
    return [x for x in parts if x]


def _packed(parts: list[str], sep: str, size: int, overlap: int) -> list[str]:
    """Parts joined up to ``size``; a pack begins with the last parts of the one before, ``overlap`` characters at most."""
    out: list[str] = []
    held: list[str] = []
    length = lambda xs: sum(map(len, xs)) + len(sep) * max(0, len(xs) - 1)
    for part in parts:
        if held and length([*held, part]) > size:
            out.append(sep.join(held))
            while held and (length(held) > overlap or length([*held, part]) > size):
                held = held[1:]
        held.append(part)
    return [x.strip() for x in [*out, sep.join(held)] if x.strip()]


def recursive(s: str, size: int = 500, overlap: int = 50, separators: tuple[str, ...] = ("\n\n", "\n", "。", "、", " ", ""), keep_separator: bool = True) -> list[str]:
    """Split at the first separator that occurs and pack what is shorter than ``size``; a part that isn't stands between
    packs and is split at the separators that follow. Chunks are stripped."""
    at = next((i for i, x in enumerate(separators) if x == "" or x in s), len(separators) - 1)
    sep, rest = separators[at], separators[at + 1 :]
    out: list[str] = []
    short: list[str] = []
    for part in _split(s, sep, keep_separator):
        if len(part) < size:
            short.append(part)
            continue
        out += _packed(short, "" if keep_separator else sep, size, overlap)
        short = []
        out += recursive(part, size, overlap, rest, keep_separator) if rest else [part]
    return out + _packed(short, "" if keep_separator else sep, size, overlap)


def chunked(docs: DataFrame, cut: Callable[[str], list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_id, chunk) by a Python policy, in Arrow batches; null texts give no chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k, c) for i, s in zip(batch[id_col], batch["__t"]) if isinstance(s, str) for k, c in enumerate(cut(s))]
            yield pd.DataFrame(rows, columns=[id_col, "chunk_id", "chunk"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, F.col(text_col).alias("__t")).mapInPandas(run, f"{id_col} {kind}, chunk_id int, chunk string")
