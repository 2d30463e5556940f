"""Language ID by rank-order profiles: a text's most frequent n-grams against each language's, by out-of-place distance.

N-grams are runs of one to three letters in lower case with one blank at each word's border. A profile is the ``TOP``
most frequent n-grams of all labelled texts of a language, in order (count first, then code). A text's distance is the
sum over its own ``TOP`` n-grams of how far each is out of place, ``TOP`` for one that the profile lacks.
Profiles are collected: they are ``TOP`` rows a language, bounded by the number of languages and not by the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import text_slices
from .workers import keeps, task

TOP = 400
#: What a text without a letter is.
UNDETERMINED = "und"
#: Counts of so many n-grams are held before they are handed on.
HELD = 1 << 18

_table: list[np.ndarray] = []
keeps("langid", _table.clear)


def _letters() -> np.ndarray:
    """By code point: the lower-case letter in 20 bits, 0 for anything else; made once per worker."""
    if not _table:
        out = np.zeros(0x110000, np.int64)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                out[i] = ord(low) if len(low) == 1 else i
        _table.append(out & 0xFFFFF)
    return _table[0]


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, document, code number) of every n-gram of some texts; codes are distinct and ascending."""
    chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    begin = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    code = _letters()[chars]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(begin))
    letter = code > 0
    # a blank before each text and after each run of letters
    after = letter.copy()
    after[:-1] &= ~letter[1:] | (doc[1:] != doc[:-1])
    keep = np.flatnonzero(letter)
    copies = 1 + after[keep].astype(np.int64)
    run, run_doc = np.repeat(code[keep], copies), np.repeat(doc[keep], copies)
    run[np.cumsum(copies)[after[keep]] - 1] = 0
    head = np.searchsorted(run_doc, np.unique(run_doc))
    run, run_doc = np.insert(run, head, 0), np.insert(run_doc, head, run_doc[head] if len(head) else [])
    if not len(run):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    names, small = np.unique(run, return_inverse=True)
    same2 = run_doc[1:] == run_doc[:-1]
    same3 = same2[1:] & same2[:-1]
    one = np.flatnonzero(run > 0)
    two = np.flatnonzero(same2)
    three = np.flatnonzero(same3 & (run[1:-1] > 0))
    documents = np.concatenate([run_doc[one], run_doc[two], run_doc[three]])

    def pack(x: np.ndarray, bits: int) -> np.ndarray:
        tag = 3 * bits
        return np.concatenate([x[one] | 1 << tag, x[two] << bits | x[two + 1] | 2 << tag, x[three] << 2 * bits | x[three + 1] << bits | x[three + 2] | 3 << tag])

    bits = max(1, int(len(names) - 1).bit_length())
    if bits <= 7:  # few letters: a table instead of a sort
        local = pack(small, bits)
        seen = np.zeros(4 << 3 * bits, bool)
        seen[local] = True
        found = np.flatnonzero(seen)
        number = np.zeros(len(seen), np.int32)
        number[found] = np.arange(len(found))
        which = number[local].astype(np.int64)
        tag, mask = found >> 3 * bits, (1 << bits) - 1
        x, y, z = names[found >> 2 * bits & mask], names[found >> bits & mask], names[found & mask]
        codes = np.where(tag == 1, z, np.where(tag == 2, y << 20 | z, x << 40 | y << 20 | z)) | tag << 60
        return codes, documents, which
    codes, which = np.unique(pack(run, 20), return_inverse=True)
    return codes, documents, which


@task("langid")
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return codes, np.bincount(at, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            codes, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], names=["lang", "gram", "n"])

    for batch in batches:
        for row, end, data, offsets in text_slices(batch.column(1)):
            codes, doc, which = grams(data, offsets)
            if not len(codes):
                continue
            langs, of = np.unique(np.array(batch.column(0).slice(row, end - row).to_pylist(), object), return_inverse=True)
            table = np.bincount(of[doc] * len(codes) + which, minlength=len(langs) * len(codes)).reshape(len(langs), -1)
            for lang, n in zip(langs, table):
                some = np.flatnonzero(n)
                held.setdefault(lang, []).append((codes[some], n[some]))
                size += len(some)
            if size > HELD:
                held = {k: [merged(v)] for k, v in held.items()}
                size = sum(len(v[0][0]) for v in held.values())
                if size > HELD // 2:
                    yield from rows()
                    held, size = {}, 0
    yield from rows()


def profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, rank): the ``TOP`` most frequent n-grams of each non-null language, over all its texts."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= TOP).select("lang", "gram", "rank")


def _distances(data: np.ndarray, offsets: np.ndarray, known: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(number of n-grams compared, distance to each profile) of some texts."""
    n = len(offsets) - 1
    codes, doc, which = grams(data, offsets)
    used, far = np.zeros(n, np.int64), np.zeros((n, len(known)), np.int64)
    if not len(codes):
        return used, far
    cells, count = np.zeros(0, np.int64), None
    width = len(codes)
    if n * width <= 1 << 24:
        table = np.bincount(doc * width + which, minlength=n * width)
        cells = np.flatnonzero(table)
        count = table[cells]
    else:
        cells, count = np.unique(doc * width + which, return_counts=True)
    own, gram = cells // width, cells % width
    order = np.lexsort((gram, -count, own))
    own, gram = own[order], gram[order]
    place = np.arange(len(own)) - np.searchsorted(own, own)
    top = place < TOP
    own, gram, place = own[top], gram[top], place[top]
    used = np.bincount(own, minlength=n)
    for k, (names, ranks) in enumerate(known):
        at = np.minimum(np.searchsorted(names, codes), len(names) - 1)
        rank = np.where(names[at] == codes, ranks[at], -1)[gram]
        far[:, k] = np.bincount(own, np.where(rank < 0, TOP, np.minimum(np.abs(rank - place), TOP)), n)
    return used, far


@task("langid")
def _predict(batches: Iterator[pa.RecordBatch], langs: list[str], known: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, offsets in text_slices(batch.column(0)):
            used, far = _distances(data, offsets, known)
            best = far.argmin(axis=1) if langs else np.zeros(end - row, np.int64)
            score = np.zeros(end - row)
            some = used > 0 if langs else np.zeros(end - row, bool)
            score[some] = 1 - far[some, best[some]] / (used[some] * float(TOP))
            names = [langs[b] if s else UNDETERMINED for b, s in zip(best.tolist(), some.tolist())]
            rest = batch.slice(row, end - row)
            yield pa.RecordBatch.from_arrays([*rest.columns[1:], pa.array(names, pa.string()), pa.array(score)], names=[*rest.schema.names[1:], "lang_pred", "score"])


def predict(docs: DataFrame, known: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with ``lang_pred`` and ``score`` (1 less the distance as a share of the largest possible).

    Null texts, texts without a letter, and all texts if there is no profile are ``und`` with score 0. Of profiles
    equally far the language that sorts first wins. Only the text is an input. Rows that repeat an id are predicted one by
    one; columns that aren't kept don't matter, whatever their names; an empty table gives an empty one.
    """
    held: dict[str, list[tuple[int, int]]] = {}
    for lang, gram, rank in known.collect():
        held.setdefault(lang, []).append((gram, rank - 1))
    langs = sorted(held)
    tables = []
    for lang in langs:
        pairs = np.array(sorted(held[lang]), np.int64)
        tables.append((pairs[:, 0].copy(), pairs[:, 1].copy()))
    rows = docs.select(F.col(text_col).cast("string").alias("__text"), *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(lambda it: _predict(it, langs, tables), f"{fields}{', ' if fields else ''}lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no profile learns from: crc32 of the id as text leaves 2 on division by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
