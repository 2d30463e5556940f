"""Exact top-k inner products over a bit-sliced index.

Attributes are quantised to integers and stored by blocks of rows as bitmaps: slice j of an attribute has bit j of every
row's value (two's complement). A query's scores come from adding the slices, shifted by the query's own bits, with
bitmap arithmetic: carry-save adders of and, or, xor over whole words, all queries of a block at once. The result is
again bit-sliced. Rows are then selected from the most significant slice downward; rows that tie at the boundary are
resolved exactly by id.

A stated set of queries meets all rows in blocks: tasks take (block of rows, group of queries), and each gives at most
``k`` rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workers import task

#: Rows of an index block and queries of a group: at least, and at most.
BLOCK_ROWS, GROUP_QUERIES = (1 << 13, 1 << 17), (1 << 10, 1 << 14)
#: Numbers of a block's and of a group's vectors at most: sides are the shorter, the longer the vectors.
TILE_NUMBERS = 1 << 23
#: Tiles (a block against a group) that a task slot gets before tiles grow.
TILES = 4
#: Queries whose bitmaps are worked on together.
TOGETHER = 32
#: Quantised values are longs; a component beyond them is an error.
LIMIT = float(1 << 63)


def quantised(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): floor(scale * x) of every component. Vectors that are null or hold a null or a non-finite component, and
    rows with a null id, are left out; a finite component whose value passes a long fails the query."""
    scaled = lambda x: x.cast("double") * F.lit(float(scale))
    values = F.transform(F.col(vector_col), lambda x: F.when(F.abs(scaled(x)) < F.lit(LIMIT), F.floor(scaled(x))).otherwise(F.raise_error(F.lit("a vector's quantised component passes 63 bits")).cast("long")))
    fine = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(fine)
    return rows.select(F.col(id_col).cast("long").alias("id"), values.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, shorter ones filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(np.asarray(column.offsets)) if len(column) else np.zeros(0, np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = flat
    return out


def slices_of(values: np.ndarray) -> np.ndarray:
    """[attribute, slice, word] bitmaps of rows of integers; the last slice is the sign."""
    width = max(int(values.max(initial=1)).bit_length(), int(-1 - values.min(initial=0)).bit_length()) + 1
    n, n_attr = values.shape
    out = np.zeros((n_attr, width, -(-n // 64)), np.uint64)
    own = np.zeros(-(-n // 64) * 64, np.int64)
    for d in range(n_attr):  # one attribute's bits are spread at a time, whatever the vectors' length
        own[:n] = values[:, d]
        for j in range(width):
            out[d, j] = np.packbits((own >> j & 1).astype(np.uint8), bitorder="little").view(np.uint64)
    return out


def add_products(slices: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """[slice, query, word]: two's complement slices of every row's inner product with every query."""
    n_attr, width, words = slices.shape
    q_width = max(1, int(max(np.abs(queries).max(initial=0), 1)).bit_length() + 1)
    out_width = width + q_width + int(n_attr).bit_length()
    columns: list[list[np.ndarray]] = [[] for _ in range(out_width + 1)]
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    negative = 0  # what inverted partial products leave to be corrected, a constant

    def reduce(w: int, keep: int) -> None:
        """Full adders until at most ``keep`` bitmaps of weight 2^w are left."""
        own = columns[w]
        while len(own) > max(keep, 2):
            a, b, c = own.pop(), own.pop(), own.pop()
            half = a ^ b
            own.append(half ^ c)
            if w + 1 < out_width:
                columns[w + 1].append((a & b) | (half & c))

    # a sign bit has negative weight: -x * 2^w is (1 - x) * 2^w - 2^w
    for w in range(width + q_width - 1):
        for i in range(max(0, w - width + 1), min(q_width, w + 1)):
            j = w - i
            flip = (i == q_width - 1) != (j == width - 1)
            masks = np.where((queries >> i) & 1, full, np.uint64(0))
            for d in range(n_attr):
                part = masks[:, d, None] & slices[d, j][None, :]
                columns[w].append(~part if flip else part)
                if flip:
                    negative -= 1 << w
                if len(columns[w]) > 8:
                    reduce(w, 6)
    shape = (len(queries), words)
    negative %= 1 << out_width
    out = np.zeros((out_width, *shape), np.uint64)
    carry = np.zeros(shape, np.uint64)
    for w in range(out_width):
        if negative >> w & 1:
            columns[w].append(np.full(shape, full))
        columns[w].append(carry)
        while len(columns[w]) > 2:
            reduce(w, 2)
        a = columns[w][0]
        b = columns[w][1] if len(columns[w]) > 1 else np.zeros(shape, np.uint64)
        out[w] = a ^ b
        carry = a & b
        columns[w] = []
    return out


def whole_numbers(bits: np.ndarray) -> np.ndarray:
    """Values of [slice, row] bits, the last slice the sign. A value that doesn't fit a long is an error."""
    if len(bits) > 64:
        if (bits[63:] != bits[-1]).any():
            raise OverflowError("a score among the best passes 63 bits")
        bits = bits[:64]
    bits = bits.astype(np.int64)
    return (bits[:-1] << np.arange(len(bits) - 1)[:, None]).sum(axis=0) - (bits[-1] << (len(bits) - 1))


def select_top(score: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of each query's ``k`` highest scores among the allowed rows, ties to smaller ids.

    From the most significant slice downward: rows surely in, and rows still equal to the boundary. With the boundary
    rows the count passes ``k`` only after the last slice; they tie then, and the smallest ids of them are taken.
    """
    sure, edge = np.zeros_like(allowed), allowed.copy()
    have = np.zeros(len(allowed), np.int64)
    for w in range(len(score) - 1, -1, -1):
        ones = edge & (~score[w] if w == len(score) - 1 else score[w])
        n = have + np.bitwise_count(ones).sum(axis=1, dtype=np.int64)
        over = (n > k)[:, None]
        sure = np.where(over, sure, sure | ones)
        edge = np.where(over, ones, edge & ~ones)
        have = np.where(n > k, have, n)

    def rows(bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q, word = np.nonzero(bitmap)
        bits = np.unpackbits(bitmap[q, word].view(np.uint8).reshape(len(q), 8), axis=1, bitorder="little")
        at, bit = np.nonzero(bits)
        return q[at], word[at] * 64 + bit

    q, row = rows(sure)
    tq, trow = rows(edge)
    order = np.lexsort((ids[trow], tq))
    tq, trow = tq[order], trow[order]
    nth = np.arange(len(tq)) - np.searchsorted(tq, tq)
    take = nth < (k - have)[tq]
    return np.concatenate([q, tq[take]]), np.concatenate([row, trow[take]])


@task()
def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block: one bit-sliced record of each block."""
    block, held = None, []

    def record() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        values = _matrix(table.column("v"))
        s = slices_of(values)
        ids = table.column("id").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([s.shape[0]], pa.int32()), pa.array([s.shape[1]], pa.int32()), pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([s.tobytes()], pa.binary())], names=["block", "n_attr", "width", "ids", "slices"])

    for batch in batches:
        key = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for s, e in zip(edges, edges[1:]):
            if s == e:
                continue
            if held and key[s] != block:
                yield record()
                held = []
            block = int(key[s])
            held.append(batch.slice(s, e - s))
    if held:
        yield record()


def tile(n_rows: int, n_queries: int, slots: int, width: int = 64) -> tuple[int, int]:
    """(rows of a block, queries of a group): doubled from the least while tiles suffice, as every row goes to each group
    and every query to each block. What is shuffled falls with a tile's sides; vectors of ``width`` numbers bound them."""
    most = max(64, TILE_NUMBERS // max(1, width))
    block, group = min(BLOCK_ROWS[0], most), min(GROUP_QUERIES[0], most)
    while True:
        wider = (2 * block, group) if 2 * block <= min(BLOCK_ROWS[1], most) and (2 * group > min(GROUP_QUERIES[1], most) or block // group <= 8) else (block, 2 * group)
        if wider[1] > min(GROUP_QUERIES[1], most) or -(-n_rows // wider[0]) * -(-n_queries // wider[1]) < TILES * slots:
            return block, group
        block, group = wider


def build_index(rows: DataFrame, block_rows: int = BLOCK_ROWS[0]) -> DataFrame:
    """(block, n_attr, width, ids, slices) of quantised rows (id, v), dealt evenly to blocks by a hash of the id."""
    blocks = max(1, -(-rows.count() // block_rows))
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), "id", "v")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(min(n, blocks), "block").sortWithinPartitions("block")
    return dealt.mapInArrow(_pack, "block long, n_attr int, width int, ids binary, slices binary")


def _search(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """One index block against one group of queries."""
    found: list[np.ndarray] = []
    q_ids = right.column("query").to_numpy() if right.num_rows else np.zeros(0, np.int64)
    queries = _matrix(right.column("v")) if right.num_rows else np.zeros((0, 0), np.int64)
    for i in range(left.num_rows):
        ids = np.frombuffer(left.column("ids")[i].as_py(), np.int64)
        n_attr, width = left.column("n_attr")[i].as_py(), left.column("width")[i].as_py()
        slices = np.frombuffer(left.column("slices")[i].as_py(), np.uint64).reshape(n_attr, width, -1)
        both = min(n_attr, queries.shape[1])  # attributes that either lacks are zero
        real = np.packbits(np.arange(slices.shape[2] * 64) < len(ids), bitorder="little").view(np.uint64)
        for at in range(0, len(q_ids), TOGETHER):
            own = q_ids[at : at + TOGETHER]
            allowed = np.repeat(real[None, :], len(own), axis=0)
            order = np.argsort(ids, kind="stable")
            lo, hi = np.searchsorted(ids[order], own, "left"), np.searchsorted(ids[order], own, "right")
            for q in np.flatnonzero(hi > lo):  # a query's own rows are no candidates
                for row in order[lo[q] : hi[q]]:
                    allowed[q, row // 64] &= ~(np.uint64(1) << np.uint64(row % 64))
            score = add_products(slices[:both], queries[at : at + TOGETHER, :both])
            q, row = select_top(score, allowed, ids, k)
            bits = (score[:, q, row // 64] >> (row % 64).astype(np.uint64)[None, :]) & np.uint64(1)
            found.append(np.stack([own[q], ids[row], whole_numbers(bits)], axis=1))
    out = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return pa.table({"query_id": out[:, 0].copy(), "vec_id": out[:, 1].copy(), "score": out[:, 2].copy()})


def top_k(index: DataFrame, queries: DataFrame, k: int = 5, group_queries: int = GROUP_QUERIES[0]) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest inner products, ties to smaller ids, rank from 1.

    ``queries(id, v)`` is a stated set. Rows with the query's own id are no candidates. Rows that repeat an id are rows
    of their own; of queries that repeat an id with other vectors each row's best candidates compete.
    """
    queries = queries.distinct()
    groups = max(1, -(-queries.count() // group_queries))
    blocks = (index.agg(F.max("block")).first()[0] or 0) + 1
    left = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = queries.select(F.col("id").alias("query"), "v", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("group"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(lambda x, y: _search(x, y, k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
