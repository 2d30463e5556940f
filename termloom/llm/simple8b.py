"""Token files in Simple-8b: a selector packs a varying count of ids into each 64-bit word.

Ids are coded in blocks of ``BLOCK``; the index of every block's first word is kept, so that blocks decode independently
and all at once. The top four bits of a word select how many ids of how many bits it holds; selector 0 is the escape:
the following word holds one id in full. A file row is a shard of consecutive documents: its partition and place there,
the number of ids before it in its partition, its documents' ids and lengths, block offsets and words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .tokens import encoder, with_end
from .words import text_slices
from .workers import task

BLOCK = 128
#: A shard closes once it holds so many ids.
SHARD_IDS = 1 << 18
#: (ids, bits of each) by selector; 0 is the escape, 15 a run of zeros.
COUNTS = np.array([1, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 120])
WIDTHS = np.array([64, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0])

SHARD = "part int, seq int, before long, n_ids long, doc_ids array<long>, lengths array<long>, blocks binary, words binary"


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, index of each block's first word) of unsigned 64-bit values."""
    v = values.astype(np.uint64)
    n = len(v)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    at = np.arange(n)
    last = np.minimum((at // BLOCK + 1) * BLOCK, n)
    best = np.where(v >> np.uint64(60) > 0, 0, 1).astype(np.int8)
    for s in range(2, 16):
        small = v < (np.uint64(1) << np.uint64(WIDTHS[s]))
        if not small.any():
            break
        ends = np.minimum.accumulate(np.where(small, n, at)[::-1])[::-1]
        best[ends >= np.minimum(at + COUNTS[s], last)] = s
    begin = np.arange(0, n, BLOCK)
    pos, stop = begin.copy(), np.minimum(begin + BLOCK, n)
    starts, blocks = [], []
    live = np.arange(len(begin))
    while len(live):  # one word of every open block at a time
        starts.append(pos[live])
        blocks.append(live)
        pos[live] += COUNTS[best[pos[live]]]
        live = live[pos[live] < stop[live]]
    start, block = np.concatenate(starts), np.concatenate(blocks)
    order = np.argsort(start)  # starts ascend within and over blocks
    start, block = start[order], block[order]
    selector = best[start]
    place = np.concatenate([[0], np.cumsum(np.where(selector == 0, 2, 1))])
    words = np.zeros(place[-1], np.uint64)
    for s in np.unique(selector):
        of = np.flatnonzero(selector == s)
        if s == 0:
            words[place[of] + 1] = v[start[of]]
            continue
        word = np.full(len(of), np.uint64(s) << np.uint64(60))
        for k in range(COUNTS[s] if WIDTHS[s] else 0):
            i = start[of] + k
            use = i < stop[block[of]]
            word[use] |= v[i[use]] << np.uint64(k * WIDTHS[s])
        words[place[of]] = word
    return words, place[np.searchsorted(start, begin)].astype(np.uint32)


def decode(words: np.ndarray, blocks: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of :func:`encode`'s output."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selector == 0).tolist():
        if not raw[i] and i + 1 < len(raw):  # an escape's second word may look like anything
            raw[i + 1] = True
    place = np.flatnonzero(~raw)
    selector = selector[place]
    count = COUNTS[selector]
    ahead = np.concatenate([[0], np.cumsum(count)])[:-1]
    block = np.searchsorted(blocks, place, "right") - 1
    head = np.searchsorted(place, blocks)
    start = block * BLOCK + ahead - ahead[head][block]
    stop = np.minimum((block + 1) * BLOCK, n)
    for s in np.unique(selector):
        of = np.flatnonzero(selector == s)
        if s == 0:
            out[start[of]] = words[place[of] + 1]
            continue
        word, mask = words[place[of]], (np.uint64(1) << np.uint64(WIDTHS[s])) - np.uint64(1)
        for k in range(COUNTS[s] if WIDTHS[s] else 0):
            i = start[of] + k
            use = i < stop[of]
            out[i[use]] = (word[use] >> np.uint64(k * WIDTHS[s])) & mask
    return out


@task("tokens")
def _shards(batches: Iterator[pa.RecordBatch], path: str, blanks: bool, end_id: int) -> Iterator[pa.RecordBatch]:
    part, seq, before = TaskContext.get().partitionId(), 0, 0
    ids: list[np.ndarray] = []
    docs: list = []
    lengths: list[np.ndarray] = []

    def close() -> pa.RecordBatch:
        nonlocal seq, before
        own = np.concatenate(ids)
        words, blocks = encode(own)
        row = [[part], [seq], [before], [len(own)], [docs[:]], [np.concatenate(lengths)], [blocks.tobytes()], [words.tobytes()]]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        seq, before = seq + 1, before + len(own)
        ids.clear(), docs.clear(), lengths.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types)], names=["part", "seq", "before", "n_ids", "doc_ids", "lengths", "blocks", "words"])

    for batch in batches:
        texts = batch.column(1)
        for row, end, data, offsets in text_slices(texts):
            found, first = with_end(*encoder(path, blanks).encode(texts.slice(row, end - row), data, offsets), end_id)
            ids.append(found)
            docs.extend(batch.column(0).slice(row, end - row).to_pylist())
            lengths.append(np.diff(first))
            if sum(map(len, ids)) >= SHARD_IDS:
                yield close()
    if ids:
        yield close()


def write_ids(docs: DataFrame, path: str, blanks: bool, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of every text, each followed by ``end_id``, in ascending order of ``id_col``; returns the files' rows.

    Null texts are empty; null ids come first, rows that repeat an id follow one another in the order of their texts' hashes.
    Other columns don't matter; an empty table gives no file rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "doc").sortWithinPartitions("doc", F.xxhash64("text"))
    return written(rows.mapInArrow(lambda it: _shards(it, path, blanks, end_id), SHARD), "ids")


@task("tokens")
def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            part, before, n, docs, lengths, blocks, words = (batch.column(k)[i] for k in range(7))
            ids = decode(np.frombuffer(words.as_py(), np.uint64), np.frombuffer(blocks.as_py(), np.uint32), n.as_py())
            length = lengths.values.to_numpy()
            end = np.cumsum(length)
            offsets = np.concatenate([[0], end * 4])
            if offsets[-1] >= 1 << 31:
                data = pa.array([ids[e - k : e].astype("<u4").tobytes() for e, k in zip(end, length)], pa.large_binary()).cast(pa.binary())
            else:
                data = pa.BinaryArray.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
            columns = [pa.array(np.full(len(length), part.as_py(), np.int32)), docs.values, pa.array(before.as_py() + end - length), pa.array(length), data]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "doc", "at", "n_tokens", "ids"])


def read_ids(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids) of every document in the files; ids are little-endian unsigned 32-bit integers.

    ``start`` needs the ids of all partitions before: one row per partition of the writer, so that table is bounded by
    the writer's partition count and may be broadcast.
    """
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    bases = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    columns = files.select("part", "before", "n_ids", "doc_ids", "lengths", "blocks", "words")
    rows = columns.mapInArrow(_unpack, "part int, doc long, at long, n_tokens long, ids binary")
    return rows.join(F.broadcast(bases), "part").select(F.col("doc").alias(id_col), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")
