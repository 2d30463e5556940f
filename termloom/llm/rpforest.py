"""Approximate nearest neighbours by cosine over a forest of random-projection trees.

A tree cuts unit vectors at every level by one random direction, the directions of a tree orthonormal, at the medians of a
bounded sample. A node's priority for a query is the sum of the squared distances from the query to the cuts it lies
behind: no row of the node is nearer than that. All trees share one priority queue: a query takes leaves of any tree in
order of priority. It takes some first, which tells how near its ``k``-th neighbour is at most, then all leaves up to
``reach`` times that squared distance. ``reach`` is learnt from the sample: it is where so many of the sample's own exact
neighbours lie. The candidates of these leaves are ranked by exact cosines of the original vectors.

Leaves are cut to blocks of bounded size, so a leaf that very many rows share (equal vectors lie in one) is dealt to many
tasks; queries that take a leaf meet all its blocks in groups of bounded size. ``reach=1`` searches exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .workers import task

#: Trees, rows of a leaf that a tree aims at, and levels at most.
TREES, LEAF_ROWS, LEVELS = 8, 128, 14
#: Rows and numbers of the sample that cuts are learnt from, at most, and rows of it whose exact neighbours tell the reach.
SAMPLE_ROWS, SAMPLE_NUMBERS, SAMPLE_ASKED = 1 << 14, 1 << 21, 256
#: Share of the sample's neighbours that the reach takes in.
SHARE = 0.95
#: Candidates that a query's first leaves have, at least.
FIRST = 512
#: Rows of a block and queries of a group: at most, and for vectors of at most so many numbers.
BLOCK_ROWS, GROUP_QUERIES, TILE_NUMBERS = 2048, 512, 1 << 19
#: Cosines by matrix products differ from exact ones by less.
CLOSE = 1e-9


@dataclass(frozen=True)
class Forest:
    """``directions[tree, level, component]``, the cuts of a tree's nodes level by level, and the reach of a search."""

    directions: np.ndarray
    cuts: np.ndarray
    reach: float

    @property
    def levels(self) -> int:
        return self.directions.shape[1]

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        """[row, tree]: the leaf of every vector."""
        out = np.zeros((len(unit), len(self.directions)), np.int64)
        for t, (d, cuts) in enumerate(zip(self.directions, self.cuts)):
            along = unit @ d.T
            node = np.zeros(len(unit), np.int64)
            for level in range(self.levels):
                node = 2 * node + 1 + (along[:, level] > cuts[node])
            out[:, t] = node - len(cuts)
        return out

    def probes(self, unit: np.ndarray, sizes: np.ndarray, first: int, limit: float | None = None) -> Iterator[tuple[int, int]]:
        """(tree, leaf) in order of priority: those that hold the ``first`` candidates by ``sizes``, or all behind them up
        to a ``limit``. The queue holds the farther sides of the cuts that were met, over all trees."""
        along = self.directions @ unit
        heap = [(0.0, t, 0, 0) for t in range(len(self.directions))]
        have = 0
        while heap:
            far, t, level, node = heappop(heap)
            if limit is not None and far > limit:
                return
            while level < self.levels:
                off = along[t, level] - self.cuts[t, node]
                heappush(heap, (far + off * off, t, level + 1, 2 * node + 1 + int(off <= 0)))
                node, level = 2 * node + 1 + int(off > 0), level + 1
            leaf = node - self.cuts.shape[1]
            if sizes[t, leaf]:
                if (have < first) == (limit is None):
                    yield t, leaf
                have += int(sizes[t, leaf])
            if limit is None and have >= first:
                return


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that no square overflows or vanishes: cosines stay what they are."""
    _, e = np.frexp(np.abs(v).max(axis=1, initial=0))
    return np.ldexp(v, -e[:, None])


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(np.asarray(column.offsets)) if len(column) else np.zeros(0, np.int64)
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def unit_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) in double precision. Vectors that are null, all zero, or hold a null or a non-finite component, and rows
    with a null id, take no part. Vectors of different lengths meet as if the shorter had zeros behind it."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine)


def _cuts(along: np.ndarray) -> np.ndarray:
    """Medians of every node of a tree, level by level; a node without rows of the sample is cut at zero."""
    n, levels = along.shape
    cuts, node = np.zeros((1 << levels) - 1), np.zeros(n, np.int64)
    for level in range(levels):
        order = np.lexsort((along[:, level], node))
        own, at = np.unique(node[order], return_index=True)
        size = np.diff(np.append(at, n))
        cuts[own] = along[order[at + (size - 1) // 2], level]
        node = 2 * node + 1 + (along[:, level] > cuts[node])
    return cuts


def grow(rows: DataFrame, k: int = 5, trees: int = TREES, seed: int = 11) -> Forest:
    """A forest for ``rows(id, v)``, learnt from a sample of at most ``SAMPLE_ROWS`` rows and ``SAMPLE_NUMBERS`` numbers: the
    rows of the smallest hashes. Trees are as deep as the number of all rows asks for and the sample allows."""
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return Forest(np.zeros((trees, 0, 1)), np.zeros((trees, 0)), 1.0)
    most = max(2, min(SAMPLE_ROWS, SAMPLE_NUMBERS // width))
    sample = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most).select("v").toArrow()
    unit = _unit(_scaled(_matrix(sample.column("v"), width)))
    levels = max(0, min(LEVELS, width, int(np.log2(max(1, n / LEAF_ROWS))), int(np.log2(max(1, len(unit) / 8)))))
    rng = np.random.default_rng(seed)
    directions = np.stack([np.linalg.qr(rng.normal(size=(width, max(1, levels))))[0][:, :levels].T for _ in range(trees)])
    forest = Forest(directions, np.stack([_cuts(unit @ d.T) for d in directions]), 1.0)
    return Forest(forest.directions, forest.cuts, _reach(forest, unit, k))


def _reach(forest: Forest, unit: np.ndarray, k: int) -> float:
    """The least share of the squared distance to the ``k``-th neighbour at which leaves of any tree hold ``SHARE`` of the
    sample's exact neighbours."""
    if forest.levels == 0 or len(unit) <= k:
        return 1.0
    asked = unit[:SAMPLE_ASKED]
    near = asked @ unit.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -2.0
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    far = np.maximum(0.0, 2 - 2 * np.take_along_axis(near, best, axis=1))
    lowest = np.full(best.shape, np.inf)
    for d, cuts in zip(forest.directions, forest.cuts):
        along, own = asked @ d.T, unit @ d.T
        node, behind = np.zeros(best.shape, np.int64), np.zeros(best.shape)
        for level in range(forest.levels):
            off = along[:, level, None] - cuts[node]
            side = own[best, level] > cuts[node]
            behind += np.where(side != (off > 0), off * off, 0.0)
            node = 2 * node + 1 + side
        lowest = np.minimum(lowest, behind)
    kth = far.max(axis=1, keepdims=True)
    share = np.where(kth > 0, lowest / np.where(kth > 0, kth, 1), 0.0)
    return float(min(1.0, np.quantile(share, SHARE)))


@task()
def _place(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    """(tree, leaf, id, v) of every row, once a tree."""
    width, trees = forest.directions.shape[2], len(forest.directions)
    step = max(1, TILE_NUMBERS // width)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            leaves = forest.leaves(_unit(_scaled(_matrix(part.column(1), width))))
            for t in range(trees):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, t, np.int32)), pa.array(leaves[:, t]), part.column(0), part.column(1)], names=["tree", "leaf", "id", "v"])


def index(rows: DataFrame, forest: Forest) -> DataFrame:
    """(tree, leaf, block, ids, vectors): every row once a tree, in blocks of a leaf of some ``BLOCK_ROWS`` rows at most."""
    width = max(1, forest.directions.shape[2])
    most = max(1, min(BLOCK_ROWS, TILE_NUMBERS // width))
    placed = rows.mapInArrow(lambda it: _place(it, forest), "tree int, leaf long, id long, v array<double>")
    counts = placed.select("tree", "leaf").groupBy("tree", "leaf").count().withColumn("blocks", F.ceil(F.col("count") / (0.75 * most)))
    dealt = placed.join(counts.select("tree", "leaf", "blocks"), ["tree", "leaf"]).withColumn("block", F.pmod(F.xxhash64("id", "v"), F.col("blocks")))
    return dealt.groupBy("tree", "leaf", "block").agg(F.collect_list("id").alias("ids"), F.collect_list("v").alias("vectors"))


@task()
def _probe(batches: Iterator[pa.RecordBatch], forest: Forest, sizes: np.ndarray, first: int) -> Iterator[pa.RecordBatch]:
    """Queries (id, ask, v, floor) once for every leaf that they take: the first, or those behind where there is a floor."""
    width = forest.directions.shape[2]
    step = max(1, TILE_NUMBERS // width // 256)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            own, trees, leaves = [], [], []
            floors = part.column(3).to_pylist()
            for i, unit in enumerate(_unit(_scaled(_matrix(part.column(2), width)))):
                limit = None if floors[i] is None else forest.reach * (2 - 2 * floors[i]) + CLOSE
                for t, leaf in forest.probes(unit, sizes, first, limit):
                    own.append(i), trees.append(t), leaves.append(leaf)
                    if len(own) == 4096:
                        yield _rows(part, own, trees, leaves)
                        own, trees, leaves = [], [], []
            yield _rows(part, own, trees, leaves)


def _rows(part: pa.RecordBatch, own: list[int], trees: list[int], leaves: list[int]) -> pa.RecordBatch:
    part = part.take(pa.array(own, pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(trees, pa.int32()), pa.array(leaves, pa.int64()), *part.columns], names=["tree", "leaf", *part.schema.names])


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of pairs of scaled rows, the same for the same two vectors wherever they lie."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


@task()
def _tiles(batches: Iterator[pa.RecordBatch], k: int, width: int) -> Iterator[pa.RecordBatch]:
    """(ids, vectors, asked, asks, floors, asked vectors) of a block and a group: at most ``k`` ids of each query there."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, asked, asks = (batch.column(c)[i].values.to_numpy() for c in (0, 2, 3))
            floor = batch.column(4)[i].values.fill_null(-2.0).to_numpy(zero_copy_only=False)
            v, q = (_scaled(_matrix(batch.column(c)[i].values, width)) for c in (1, 5))
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], v[order]
            near = _unit(q) @ _unit(v).T
            lo, hi = np.searchsorted(ids, asked, "left"), np.searchsorted(ids, asked, "right")
            for row in np.flatnonzero(hi > lo):
                near[row, lo[row] : hi[row]] = -np.inf
            by_id = np.maximum.reduceat(near, np.flatnonzero(np.diff(ids, prepend=ids[0] - 1 if ids[0] > np.iinfo(np.int64).min else ids[0] + 1)), axis=1)
            kth = -np.partition(-by_id, k - 1, axis=1)[:, k - 1] if by_id.shape[1] > k else np.full(len(q), -2.0)
            row, col = np.nonzero(near >= np.maximum(floor, np.maximum(kth, -2.0))[:, None] - CLOSE)
            # scores of equal vectors are equal, so ties go by id here as in the whole
            score = np.concatenate([exact(q[row[at : at + 4096]], v[col[at : at + 4096]]) for at in range(0, len(row), 4096)] or [np.zeros(0)])
            order = np.lexsort((ids[col], -score, row))
            row, vec, score = row[order], ids[col][order], score[order]
            once = np.ones(len(row), bool)
            if by_id.shape[1] < len(ids):  # an id that repeats is found once, by its nearest row
                _, at = np.unique(np.stack([row, vec]), axis=1, return_index=True)
                once[:] = False
                once[at] = True
                row, vec, score = row[once], vec[once], score[once]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            row = row[best]
            yield pa.RecordBatch.from_arrays([pa.array(asked[row]), pa.array(asks[row]), pa.array(vec[best]), pa.array(score[best])], names=["query_id", "ask", "vec_id", "score"])


def search(rows: DataFrame, asked: DataFrame, forest: Forest, k: int = 5, first: int = FIRST) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found of every row of ``asked(id, v)``, by exact cosine in double
    precision, ties to smaller ids, rank from 1.

    Rows with the query's own id are no candidates. An id that repeats is found once, by its nearest row; of queries that
    repeat an id with other vectors each row's candidates compete.
    """
    width = max(1, forest.directions.shape[2])
    blocks = written(index(rows, forest), "leaves")
    asked = asked.distinct().withColumn("ask", F.xxhash64("v"))
    groups = max(1, -(-asked.count() // max(1, min(GROUP_QUERIES, TILE_NUMBERS // width))))
    sizes = np.zeros((len(forest.directions), 1 << forest.levels), np.int64)
    # a row for each leaf of the forest at most
    known = blocks.groupBy("tree", "leaf").agg(F.sum(F.size("ids")).alias("n")).toArrow()
    sizes[known.column("tree").to_numpy(), known.column("leaf").to_numpy()] = known.column("n").to_numpy()

    def met(queries: DataFrame) -> DataFrame:
        probes = queries.select("id", "ask", "v", "floor").mapInArrow(lambda it: _probe(it, forest, sizes, max(first, 2 * k)), "tree int, leaf long, id long, ask long, v array<double>, floor double")
        probes = probes.withColumn("group", F.pmod(F.xxhash64("id", "ask"), F.lit(groups)))
        held = probes.groupBy("tree", "leaf", "group").agg(F.collect_list(F.struct("id", "ask", "floor", "v")).alias("q"))
        tiles = held.join(blocks, ["tree", "leaf"]).select("ids", "vectors", F.col("q.id").alias("asked"), F.col("q.ask").alias("asks"), F.transform("q", lambda x: x["floor"]).alias("floors"), F.col("q.v").alias("qs"))
        return tiles.mapInArrow(lambda it: _tiles(it, k, width), "query_id long, ask long, vec_id long, score double")

    by_row, by_id = Window.partitionBy("query_id", "ask").orderBy(F.desc("score"), "vec_id"), Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = written(met(asked.withColumn("floor", F.lit(None).cast("double"))), "near")
    once = near.groupBy("query_id", "ask", "vec_id").agg(F.max("score").alias("score"))
    kth = once.withColumn("rank", F.row_number().over(by_row)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), "ask", F.col("score").alias("floor"))
    # a query that has not met k rows yet takes all leaves
    limits = asked.join(kth, ["id", "ask"], "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
    found = near.unionAll(met(limits)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(by_id)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
