"""Substring dedup by super-k-mer partitioning.

A window is ``size`` consecutive words. Its minimiser is the smallest hash among its runs of ``MINI`` words; consecutive
windows of one minimiser travel together as one packed string to the minimiser's bucket, where windows are sorted, those
of one hash compared word by word, and counted. A sender packs what it has for a bucket into one compressed record; it
holds each distinct string of a slice once, with the places where it occurs. What comes back are word ranges per document.

A bucket beyond ``BUCKET_LIMIT`` (its minimiser is in very many windows) is not gathered: its records are cut again, one
at a time, at the minimisers of longer runs, in the end of whole windows, and dealt to buckets of their own. What is too
large even then is about few windows with very many places: its records stay apart, give the smallest document of each of
their windows, and get back those of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written
from .words import HASHED, Words, mix64, packed_slices, plain, run_codes, settled, span_codes, spread, text_slices, words_of
from .workers import task

#: Bytes of text for each bucket, on average, and of packed strings in one at most before it is cut again.
BUCKET_BYTES, BUCKET_LIMIT = 4 << 20, 48 << 20
#: Bytes of text that are cut together, and bytes of strings that are held before they are packed and sent.
SENT_BYTES, HELD_BYTES = 2 << 20, 32 << 20
PACK_LEVEL = 6
#: Words of a minimiser, and share of a window's words of those that large buckets are cut by, in turn.
MINI = 3
AGAIN = (0.6, 1.0, 1.0)
#: Buckets that a large one becomes.
PARTS = 256

SENT = "bucket long, n long, packed binary"
FOUND = f"doc long, mark long, lo long, hi long, {SENT}"


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """The smallest of every ``span`` neighbours."""
    have = 1
    while 2 * have <= span:
        values, have = np.minimum(values[:-have], values[have:]), 2 * have
    return np.minimum(values[: len(values) - (span - have)], values[span - have :]) if have < span else values


class _Packer:
    """Strings for buckets, compressed once enough are held."""

    def __init__(self) -> None:
        import zstandard

        self.packer, self.held, self.n = zstandard.ZstdCompressor(level=PACK_LEVEL), {}, 0

    def add(self, bucket: int, docs: np.ndarray, marks: np.ndarray, strings: np.ndarray, owners: np.ndarray, froms: np.ndarray, n_words: np.ndarray, text: np.ndarray) -> None:
        """``owners`` are numbers in ``docs``, ``strings`` numbers of strings; each word of ``text`` has a space behind it."""
        parts = [np.array([len(n_words), len(strings), len(docs), len(text)], np.int64), docs.astype(np.int64), marks.astype(np.int64), *(x.astype(np.uint32) for x in (strings, owners, froms, n_words)), text]
        part = b"".join(x.tobytes() for x in parts)
        self.held.setdefault(bucket, []).append(part)
        self.n += len(part)

    def packed(self) -> Iterator[pa.RecordBatch]:
        names = sorted(self.held)
        for at in range(0, len(names), 64):
            raw = [b"".join(self.held[x]) for x in names[at : at + 64]]
            columns = [pa.array(names[at : at + 64], pa.int64()), pa.array(list(map(len, raw)), pa.int64()), pa.array(list(map(self.packer.compress, raw)), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "n", "packed"])
        self.held, self.n = {}, 0


def _parts(blob: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """(docs, marks, strings, owners, froms, n_words, text) of every part of a record, as they were added."""
    import zstandard

    raw, at = zstandard.ZstdDecompressor().decompress(blob), 0
    while at < len(raw):
        n, m, k, n_bytes = np.frombuffer(raw, np.int64, 4, at).tolist()
        at += 32
        own = [np.frombuffer(raw, np.int64, k, at), np.frombuffer(raw, np.int64, k, at + 8 * k)]
        at += 16 * k
        for x in (m, m, m, n):
            own.append(np.frombuffer(raw, np.uint32, x, at).astype(np.int64))
            at += 4 * x
        yield (*own, np.frombuffer(raw, np.uint8, n_bytes, at))
        at += n_bytes


def _strings(least: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, number of windows) of the runs of windows that share a minimiser and an owner."""
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(new)
    return head, np.diff(np.append(head, len(least)))


@task()
def _send(batches: Iterator[pa.RecordBatch], size: int, buckets: int) -> Iterator[pa.RecordBatch]:
    packer = _Packer()
    for batch in batches:
        docs, marks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        for row, _, data, offsets in text_slices(batch.column(2), SENT_BYTES):
            words = words_of(data, offsets, lower=False)
            n_windows = np.maximum(np.diff(words.first) - size + 1, 0)
            doc, at = spread(words.first[:-1], n_windows)
            if not len(at):
                continue
            text, start, end = plain(words)
            mini = min(MINI, size)
            least = _least(run_codes(words.code, mini), size - mini + 1)[at]
            head, windows = _strings(least, doc)
            s, e = start[at[head]], end[at[head] + windows + size - 2]
            # the same string of one slice travels once: ends and sums as a hash, then bytes
            whole, total = run_codes(words.code, size), np.concatenate([np.zeros(1, np.uint64), mix64(words.code).cumsum()])
            from_, to = at[head], at[head] + windows - 1
            code = mix64(whole[from_] * np.uint64(0x9E3779B97F4A7C15) + whole[to]) + mix64(total[to + size] - total[from_])
            _, one, which = np.unique(settled(text, s, e, code | np.uint64(HASHED)), return_index=True, return_inverse=True)
            bucket = (least[head[one]] % np.uint64(buckets)).astype(np.int64)
            by_bucket = np.argsort(bucket, kind="stable")
            place = np.empty(len(one), np.int64)
            place[by_bucket] = np.arange(len(one))
            order = np.argsort(place[which], kind="stable")
            string_of = place[which][order]
            occurs = head[order]
            doc_of, from_ = doc[occurs], at[occurs] - words.first[doc[occurs]]
            s, e, n_of = s[one][by_bucket], e[one][by_bucket] + 1, (windows[one] + size - 1)[by_bucket]
            edges = np.flatnonzero(np.diff(bucket[by_bucket], prepend=-1, append=buckets))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                a, b = np.searchsorted(string_of, [lo, hi])
                there, local = np.unique(doc_of[a:b], return_inverse=True)
                _, chars = spread(s[lo:hi], e[lo:hi] - s[lo:hi])
                packer.add(int(bucket[by_bucket[lo]]), docs[row + there], marks[row + there], string_of[a:b] - lo, local, from_[a:b], n_of[lo:hi], text[chars])
            if packer.n >= HELD_BYTES:
                yield from packer.packed()
    yield from packer.packed()


def _cut_again(blob: bytes, bucket: int, size: int, level: int, packer: _Packer) -> None:
    """A large bucket's record dealt to buckets of its own, by the minimisers of longer runs."""
    run = max(1, round(AGAIN[level] * size))
    for docs, marks, strings, owners, froms, n_words, text in _parts(blob):
        end = np.flatnonzero(text == 0x20)
        start = np.concatenate([[0], end[:-1] + 1])
        code = span_codes(text, start, end)
        string, at = spread(np.concatenate([[0], n_words.cumsum()[:-1]]), n_words - size + 1)
        least = mix64(_least(run_codes(code, run), size - run + 1)[at] + np.uint64(level + 1))
        head, windows = _strings(least, string)
        to = (least[head] % np.uint64(PARTS)).astype(np.int64)
        # every place of a string becomes one of each of its parts
        first = np.searchsorted(string[head], np.arange(len(n_words) + 1))
        place, part = spread(first[strings], np.diff(first)[strings])
        offset = at[head] - at[np.searchsorted(string, string[head])]
        for k in np.unique(to).tolist():
            mine = np.flatnonzero(to == k)
            number = np.full(len(head), -1, np.int64)
            number[mine] = np.arange(len(mine))
            here = number[part] >= 0
            there, local = np.unique(owners[place[here]], return_inverse=True)
            s, e = start[at[head[mine]]], end[at[head[mine]] + windows[mine] + size - 2] + 1
            _, chars = spread(s, e - s)
            packer.add(bucket * PARTS + k, docs[there], marks[there], number[part[here]], local, froms[place[here]] + offset[part[here]], windows[mine] + size - 1, text[chars])


def _settled_windows(code: np.ndarray, at: np.ndarray, size: int, hashes: np.ndarray, order: np.ndarray) -> np.ndarray | None:
    """Hashes such that equal ones mean equal windows; None where ``hashes`` are such, in ``order``, already.

    ``code`` are settled codes of words, so neighbours of one hash are compared word by word.
    """
    twin = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    i, j = at[order[twin]], at[order[twin + 1]]
    bad = np.zeros(len(twin), bool)
    for k in range(size):
        bad |= code[i + k] != code[j + k]
    if not bad.any():
        return None
    out, taken, names, fresh = hashes.copy(), set(hashes.tolist()), {}, 0
    for k in np.flatnonzero(np.isin(hashes, np.unique(hashes[order[twin[bad]]]))).tolist():
        raw = code[at[k] : at[k] + size].tobytes()
        if raw not in names:
            while fresh in taken:
                fresh += 1
            names[raw], fresh = fresh, fresh + 1
        out[k] = names[raw]
    return out


def _bucket(blobs: list[bytes], size: int) -> pa.RecordBatch | None:
    """Word ranges, by document, that windows of smaller documents cover."""
    held: list[list[np.ndarray]] = [[] for _ in range(7)]
    n_docs = n_strings = 0
    for blob in blobs:
        for docs, marks, strings, owners, froms, lengths, text in _parts(blob):
            for to, x in zip(held, (docs, marks, strings + n_strings, owners + n_docs, froms, lengths, text)):
                to.append(x)
            n_docs, n_strings = n_docs + len(docs), n_strings + len(lengths)
    docs, marks, strings, owners, froms, lengths, text = map(np.concatenate, held)
    end = np.flatnonzero(text == 0x20)
    start = np.concatenate([[0], end[:-1] + 1])
    code = settled(text, start, end, span_codes(text, start, end))
    counts = lengths - size + 1
    string_of, at = spread(np.concatenate([[0], lengths.cumsum()[:-1]]), counts)
    hashes = run_codes(code, size)[at]
    order = np.argsort(hashes, kind="stable")
    if (better := _settled_windows(code, at, size, hashes, order)) is not None:
        hashes = better
        order = np.argsort(hashes, kind="stable")
    doc_of = docs[owners]
    lowest = np.full(n_strings, np.iinfo(np.int64).max)
    highest = np.full(n_strings, np.iinfo(np.int64).min)
    np.minimum.at(lowest, strings, doc_of)
    np.maximum.at(highest, strings, doc_of)
    run = np.flatnonzero(np.diff(hashes[order].view(np.int64), prepend=~hashes[order][:1].view(np.int64)))
    least = np.minimum.reduceat(lowest[string_of[order]], run)
    smallest = np.empty(len(hashes), np.int64)
    smallest[order] = np.repeat(least, np.diff(np.append(run, len(order))))
    some = np.zeros(n_strings, bool)
    some[string_of[smallest < highest[string_of]]] = True
    occurs = np.flatnonzero(some[strings])
    first = np.concatenate([[0], counts.cumsum()])
    of, at = spread(first[strings[occurs]], counts[strings[occurs]])
    if not len(of):
        return None
    lost = smallest[at] < doc_of[occurs][of]
    begins = lost.copy()
    begins[1:] &= ~(lost[:-1] & (of[1:] == of[:-1]))
    ends = lost.copy()
    ends[:-1] &= ~(lost[1:] & (of[1:] == of[:-1]))
    b, e = np.flatnonzero(begins), np.flatnonzero(ends)
    own = occurs[of[b]]
    base = froms[own] - first[strings[own]]
    return pa.RecordBatch.from_arrays([pa.array(docs[owners[own]]), pa.array(marks[owners[own]]), pa.array(base + at[b]), pa.array(base + at[e] + size)], names=["doc", "mark", "lo", "hi"])


def _windows(blob: bytes, size: int) -> Iterator[tuple[bytes, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(window, its place in its string, documents, marks and first words of the string's places) of a record of few strings."""
    for docs, marks, strings, owners, froms, n_words, text in _parts(blob):
        end = np.flatnonzero(text == 0x20)
        start = np.concatenate([[0], end[:-1] + 1])
        raw, order = text.tobytes(), np.argsort(strings, kind="stable")
        edge, first = np.searchsorted(strings[order], np.arange(len(n_words) + 1)), np.concatenate([[0], n_words.cumsum()])
        for s, n in enumerate(n_words.tolist()):
            own = order[edge[s] : edge[s + 1]]
            at = (docs[owners[own]], marks[owners[own]], froms[own])
            for k in range(n - size + 1):
                i = first[s] + k
                yield raw[start[i] : end[i + size - 1]], k, *at


@task()
def _minima(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(record, window, least): the smallest document of each window of a record."""
    for batch in batches:
        for record, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            least: dict[bytes, int] = {}
            for window, _, docs, _, _ in _windows(blob.as_py(), size):
                least[window] = min(int(docs.min()), least.get(window, 1 << 63))
            yield pa.RecordBatch.from_arrays([pa.array([record] * len(least), pa.string()), pa.array(list(least), pa.binary()), pa.array(list(least.values()), pa.int64())], names=["record", "window", "least"])


@task()
def _above(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The places of a record's windows in documents above the smallest of all."""
    for batch in batches:
        for blob, least in zip(batch.column(0), batch.column(1)):
            smallest = {x["window"]: x["least"] for x in least.as_py()}
            for window, k, docs, marks, froms in _windows(blob.as_py(), size):
                lost = docs > smallest[window]
                if lost.any():
                    lo = froms[lost] + k
                    yield pa.RecordBatch.from_arrays([pa.array(docs[lost]), pa.array(marks[lost]), pa.array(lo), pa.array(lo + size)], names=["doc", "mark", "lo", "hi"])


def _hot_ranges(records: DataFrame, size: int) -> DataFrame:
    """(doc, mark, lo, hi) of records that are all about few windows with very many places.

    Such a bucket isn't gathered: the smallest document of a window is a minimum, so every record gives its own, they are
    joined by the window's bytes into those of all, and every record gets those of its windows back.
    """
    named = records.select(F.sha2("packed", 256).alias("record"), "packed")
    own = written(named.mapInArrow(lambda it: _minima(it, size), "record string, window binary, least long"), "minima")
    least = own.groupBy("window").agg(F.min("least").alias("least"))
    back = own.select("record", "window").distinct().join(least, "window").groupBy("record").agg(F.collect_list(F.struct("window", "least")).alias("windows"))
    return named.join(back, "record").select("packed", "windows").mapInArrow(lambda it: _above(it, size), "doc long, mark long, lo long, hi long")


@task()
def _count(batches: Iterator[pa.RecordBatch], size: int, level: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: the ranges found there, or the records of a bucket too large to be gathered, cut again as
    long as there are levels, and as they are after that."""
    schema = pa.schema([(x, pa.binary() if x == "packed" else pa.int64()) for x in ("doc", "mark", "lo", "hi", "bucket", "n", "packed")])
    packer, bucket, held, n_held = _Packer(), None, [], 0

    def rows(found: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([found.column(f.name) if f.name in found.schema.names else pa.nulls(found.num_rows, f.type) for f in schema], schema=schema)

    def closed() -> Iterator[pa.RecordBatch]:
        if held and (out := _bucket(held, size)) is not None:
            yield rows(out)
        held.clear()

    for batch in batches:
        for name, n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if name != bucket:
                yield from closed()
                bucket, n_held = name, 0
            held.append(blob.as_py())
            n_held += n
            while n_held > BUCKET_LIMIT and held:
                if level < len(AGAIN):
                    _cut_again(held.pop(), bucket, size, level, packer)
                else:
                    yield rows(pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n]), pa.array([held.pop()], pa.binary())], names=["bucket", "n", "packed"]))
                if packer.n >= HELD_BYTES:
                    yield from map(rows, packer.packed())
    yield from closed()
    yield from map(rows, packer.packed())


def repeated_ranges(docs: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, mark, lo, hi): word ranges covered by windows that also start in a document with a smaller id.

    ``mark`` is the text's crc32, which tells rows that repeat an id apart. Rows with a null id take no part.
    """
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("doc"), F.crc32(F.col(text_col).cast("binary")).alias("mark"), F.col(text_col).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(1, -(-n_bytes // BUCKET_BYTES))
    # a task for each bucket as long as they are few, so that a task's share doesn't follow the input
    n = max(1, min(buckets, 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    sent, out, level = rows.mapInArrow(lambda it: _send(it, size, buckets), SENT), None, 0
    while True:
        dealt = sent.repartitionById(n, F.pmod(F.xxhash64("bucket") if level else F.col("bucket"), F.lit(n)).cast("int")).sortWithinPartitions("bucket")
        found = written(dealt.mapInArrow(lambda it, level=level: _count(it, size, level), FOUND), "ranges")
        ranges = found.where("doc IS NOT NULL").select("doc", "mark", "lo", "hi")
        out = ranges if out is None else out.unionAll(ranges)
        sent, level = found.where("packed IS NOT NULL").select("bucket", "n", "packed"), level + 1
        if sent.isEmpty():
            return out
        if level > len(AGAIN):
            return out.unionAll(_hot_ranges(sent, size))


@task()
def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, for the way to their ranges."""
    import zstandard

    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        stored = pa.array([packer.compress(x.as_buffer()) for x in batch.column(2).cast(pa.binary())], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), stored], names=["own", "crc", "stored"])


@task()
def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, plain_texts in packed_slices(batch.column(1)):
            part = batch.slice(row, len(plain_texts))
            yield from _without(part.column(0), pa.array(plain_texts, pa.binary()).cast(pa.string()), part.column(2))


def _without(ids: pa.Array, texts: pa.Array, ranges: pa.Array) -> Iterator[pa.RecordBatch]:
    for row, end, data, offsets in text_slices(texts):
        words = words_of(data, offsets, lower=False)
        cover = np.zeros(len(words.start) + 1, np.int32)
        for i in range(row, end):
            if ranges[i].is_valid:
                own = ranges[i].values
                np.add.at(cover, words.first[i - row] + own.field("lo").to_numpy(), 1)
                np.add.at(cover, words.first[i - row] + own.field("hi").to_numpy(), -1)
        kept = cover.cumsum()[:-1] == 0
        left = np.concatenate([[0], kept.cumsum()])[words.first]
        text, _, stop = plain(Words(words.data, words.start[kept], words.end[kept], words.code[kept], left))
        edge = np.concatenate([[0], stop + 1])
        lo, hi = edge[left[:-1]], np.maximum(edge[left[1:]] - 1, edge[left[:-1]])
        raw = text.tobytes()
        n_words = np.diff(words.first)
        columns = [ids.slice(row, end - row), pa.array(n_words), pa.array(n_words - np.diff(left)), pa.array([raw[a:b] for a, b in zip(lo.tolist(), hi.tolist())], pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc", "n_words", "n_removed", "kept"])


def dedup_windows(docs: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept) for every row: its words without those covered by a window of a smaller document.

    Windows are judged on the input. Null and empty texts have no words; texts of fewer than ``size`` words lose none.
    Rows that repeat an id are one document, a null id neither loses words nor takes any. Other columns don't matter.
    """
    found = repeated_ranges(docs, size, id_col, text_col).groupBy("doc", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    rows = docs.select(F.col(id_col).cast("long").alias("own"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("own", F.crc32(F.col("text").cast("binary")).alias("crc"), "text").mapInArrow(_squeeze, "own long, crc long, stored binary")
    rows = rows.join(found, (rows["own"] == found["doc"]) & (rows["crc"] == found["mark"]), "left").select("own", "stored", "ranges")
    return rows.mapInArrow(_keep, "doc long, n_words long, n_removed long, kept string").withColumnRenamed("doc", id_col)
