"""An index of vectors in lists around centroids, kept as a table whose partitions are the lists.

Centroids are learnt from a bounded sample; every row lies in the list of its nearest centroid. A query reads the lists
whose centroids are nearest and compares with all rows there; how many lists it takes is learnt from the sample too, and
taking all of them is the exact search. An upsert rewrites only the lists that lose or gain rows.

In a search, rows travel once for each group of lists of the other side, not for each list: a query says by bits which lists of
a group it asks for. There are as many groups of a small table as of a large one, until their size is at its bound.

The table is ``path/lists/list=n`` and ``path/centroids``; the latter also holds how many lists a search takes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .vectors import NEAR, _matrix, _nearest

#: Rows and numbers of the sample at most, rows of it whose exact neighbours tell how many lists to take, and rounds.
SAMPLE_ROWS, SAMPLE_NUMBERS, SAMPLE_ASKED, ROUNDS = 1 << 14, 1 << 21, 256, 8
#: Lists at most, and rows that a list aims at.
MOST_LISTS, LIST_ROWS = 1 << 12, 1 << 10
#: Share of the sample's neighbours that the lists taken hold.
SHARE = 0.95
#: Groups of lists that a search aims at on each side, rows of a group at least, and its numbers at most.
GROUPS, LEAST_ROWS, MOST_NUMBERS = 8, 1 << 10, 1 << 23
#: Queries and rows that are compared at once, and by how much rounding to 12 digits moves a weight at most.
TILE_ASKED, TILE_ROWS, CLOSE = 512, 1 << 10, 1e-11


@dataclass(frozen=True)
class Centroids:
    """Unit vectors, and how many of the nearest lists a search takes."""

    vectors: np.ndarray
    take: int


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _lists(m: np.ndarray, centroids: np.ndarray, take: int = 1) -> np.ndarray:
    """[row, take]: the nearest centroids of every row, the nearest first, ties to the smaller number."""
    return np.argsort(-np.round(m @ centroids.T, 12), axis=1, kind="stable")[:, :take]


def rows_of(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of the rows that have an id and a vector without nulls."""
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda x: x.isNull()))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))


def train(rows: DataFrame, lists: int | None = None, k: int = 12, seed: int = 5) -> Centroids:
    """Centroids of ``rows(id, v)``: means of directions over ``ROUNDS`` rounds on the sample, which are the rows of the
    smallest hashes. There are as many lists as the number of all rows asks for and the sample allows."""
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n or not width:
        return Centroids(np.zeros((1, max(1, width or 1))), 1)
    most = max(1, min(SAMPLE_ROWS, SAMPLE_NUMBERS // width))
    sample = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most).select("v").toArrow()
    m = _matrix(sample, "v")
    lists = lists or int(min(MOST_LISTS, max(1, n / LIST_ROWS), max(1, len(m) / 8)))
    centroids = m[np.random.default_rng(seed).permutation(len(m))[: min(lists, len(m))]].copy()
    for _ in range(ROUNDS):
        own = _lists(m, centroids)[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, m)
        filled = np.bincount(own, minlength=len(centroids)) > 0
        centroids[filled] = _unit(sums[filled])
    return Centroids(centroids, _take(m, centroids, k))


def _take(m: np.ndarray, centroids: np.ndarray, k: int) -> int:
    """The least number of lists that hold ``SHARE`` of the exact neighbours of the sample's rows."""
    asked = m[:SAMPLE_ASKED]
    if len(m) <= k:
        return len(centroids)
    near = asked @ m.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -2
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    order = _lists(asked, centroids, len(centroids))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None, :].repeat(len(asked), 0), axis=1)
    at = np.take_along_axis(place, _lists(m, centroids)[:, 0][best], axis=1)
    return int(np.quantile(at, SHARE, method="higher")) + 1


def listed(rows: DataFrame, centroids: Centroids, take: int = 1) -> DataFrame:
    """(id, v, list): every row in its ``take`` nearest lists."""
    take = min(take, len(centroids.vectors))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = pa.Table.from_batches([batch.slice(at, 1024)])
                own = _lists(_matrix(part, "v"), centroids.vectors, take)
                yield pa.RecordBatch.from_arrays([part.column("id").combine_chunks(), part.column("v").combine_chunks(), pa.array(list(own.astype(np.int32)), pa.list_(pa.int32()))], names=["id", "v", "lists"])

    return rows.select("id", "v").mapInArrow(work, "id long, v array<double>, lists array<int>").select("id", "v", F.explode("lists").alias("list"))


def build(vectors: DataFrame, path: str, lists: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> Centroids:
    """The index of a table, made anew; of rows that repeat an id one stays."""
    rows = rows_of(vectors, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    centroids = train(rows, lists)
    spark = vectors.sparkSession
    table = [(i, [float(x) for x in c], centroids.take) for i, c in enumerate(centroids.vectors)]
    spark.createDataFrame(table, "list int, centroid array<double>, take int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    _write(listed(rows, centroids), f"{path}/lists", "overwrite")
    return centroids


def _write(rows: DataFrame, path: str, mode: str) -> None:
    """A list's rows come together for its files, a large list's from several tasks."""
    salted = rows.repartition("list", F.pmod(F.xxhash64("id"), F.lit(8)))
    salted.write.mode(mode).option("partitionOverwriteMode", "dynamic" if mode == "overwrite" and path.endswith("lists") else "static").partitionBy("list").parquet(path)


def centroids_of(spark: SparkSession, path: str) -> Centroids:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # one for each list, MOST_LISTS at most
    return Centroids(np.array([r["centroid"] for r in rows]), rows[0]["take"])


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, v array<double>, list int").parquet(f"{path}/lists")


def upsert(path: str, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> list[int]:
    """Put ``vectors`` into an index, in the place of rows of the same ids; the numbers of the lists that were rewritten.

    Which lists lose a row is found by ids alone. The rows of the lists that change are written aside first, so a job that
    fails leaves the index as it was or as it is to be, list by list.
    """
    spark = vectors.sparkSession
    rows = rows_of(vectors, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    aside = f"{path}/incoming-{uuid.uuid4().hex}"
    listed(rows, centroids_of(spark, path)).write.parquet(f"{aside}/rows")
    incoming = spark.read.parquet(f"{aside}/rows")
    stored = _stored(spark, path)
    loses = stored.select("id", "list").join(incoming.select("id"), "id", "left_semi").select("list")
    touched = sorted(r["list"] for r in loses.unionAll(incoming.select("list")).distinct().collect())  # at most all lists
    if touched:
        own = stored.where(F.col("list").isin(touched)).join(incoming.select("id"), "id", "left_anti")
        own.unionByName(incoming).write.parquet(f"{aside}/lists")
        left = spark.read.parquet(f"{aside}/lists")
        _write(left, f"{path}/lists", "overwrite")
        emptied = set(touched) - {r["list"] for r in left.select("list").distinct().collect()}
        for n in emptied:
            _remove(spark, f"{path}/lists/list={n}")
    _remove(spark, aside)
    return touched


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _order(centroids: np.ndarray) -> np.ndarray:
    """The numbers of the lists, near ones together: halves along the direction of most spread, cut again."""
    if len(centroids) < 3:
        return np.arange(len(centroids))
    off = centroids - centroids.mean(axis=0)
    along = np.argsort(off @ np.linalg.svd(off, full_matrices=False)[2][0], kind="stable") if np.isfinite(off).all() else np.arange(len(off))
    return np.concatenate([half[_order(centroids[half])] for half in np.array_split(along, 2)])


def _dealt(rows: DataFrame, centroids: np.ndarray, block: int | None) -> tuple[np.ndarray, np.ndarray]:
    """[list]: the first group of a list's ``rows``, and how many groups it has; a group is some lists or a part of one."""
    sizes = np.zeros(len(centroids), np.int64)
    for r in rows.groupBy("list").count().collect():  # at most all lists
        sizes[r["list"]] = r["count"]
    most = block or max(1, min(max(LEAST_ROWS, -(-int(sizes.sum()) // GROUPS)), MOST_NUMBERS // max(1, centroids.shape[1])))
    first, parts = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // most))
    at = held = 0
    for i in _order(centroids):
        if held and held + sizes[i] > most:
            at, held = at + 1, 0
        first[i], held = at, held + sizes[i]
        if parts[i] > 1:
            at, held = at + int(parts[i]), 0
    return first, parts


def _asks(rows: DataFrame, centroids: Centroids, take: int, dealt: tuple[np.ndarray, np.ndarray], members: list[np.ndarray] | None = None) -> DataFrame:
    """Rows with their own group ``a``, once for each group ``b`` of which they ask for a list: (a, b, id, v, asks), where ``asks``
    has a bit for each of the ``members[b]``. Without ``members`` (a, list), the lists that rows of a group ask for."""
    first, parts = dealt

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lists = _lists(_matrix(pa.Table.from_batches([part]), "v"), centroids.vectors, take)
                own = first[lists[:, 0]] + part.column("salt").to_numpy() % parts[lists[:, 0]]
                if members is None:
                    pairs = np.unique(own[:, None] * len(first) + lists)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs // len(first)), pa.array(pairs % len(first))], names=["a", "list"])
                    continue
                asked = np.zeros((len(lists), len(first)), bool)
                np.put_along_axis(asked, lists, True, axis=1)
                for b, its in enumerate(members):
                    some = np.flatnonzero(asked[:, its].any(axis=1))
                    if len(some):
                        bits = [row.tobytes() for row in np.packbits(asked[some][:, its], axis=1)]
                        sent = part.take(pa.array(some))
                        yield pa.RecordBatch.from_arrays([pa.array(own[some]), pa.array(np.full(len(some), b)), sent.column("id"), sent.column("v"), pa.array(bits, pa.binary())], names=["a", "b", "id", "v", "asks"])

    salted = rows.select("id", "v", F.xxhash64("id").alias("salt"))
    return salted.mapInArrow(work, "a long, list long" if members is None else "a long, b long, id long, v array<double>, asks binary")


def _among(x: pa.Table, y: pa.Table, its: np.ndarray, k: int, least: float) -> pa.Table:
    """(src, dst, weight): the ``k`` rows of y nearest to each row of x among those of the lists ``its`` that it asks for, ties
    to the smaller id. It goes by tiles, of which only what may be among the best is sorted."""
    y = y.sort_by([("list", "ascending"), ("other", "ascending")])
    src, dst, lists = x.column("id").to_numpy(), y.column("other").to_numpy(), y.column("list").to_numpy()
    ma, mb = _matrix(x, "v"), _matrix(y, "w")
    asks = np.unpackbits(np.frombuffer(b"".join(x.column("asks").to_pylist()), np.uint8).reshape(len(src), -1), axis=1, count=len(its))
    fine = np.isfinite(ma).all(axis=1)  # others have no cosine with anything
    if not np.isfinite(mb).all():
        keep = np.isfinite(mb).all(axis=1)
        dst, lists, mb = dst[keep], lists[keep], mb[keep]
    # the best so far: weights, the same to 12 digits, and ids
    weight, score, near = np.full((len(src), k), -2.0), np.full((len(src), k), -2.0), np.full((len(src), k), np.iinfo(np.int64).max)
    for i, n in enumerate(its):
        lo, hi = np.searchsorted(lists, n, "left"), np.searchsorted(lists, n, "right")
        rows = np.flatnonzero((asks[:, i] > 0) & fine)
        for q in (rows[at : at + TILE_ASKED] for at in range(0, len(rows), TILE_ASKED)):
            for s, e in ((at, min(hi, at + TILE_ROWS)) for at in range(lo, hi, TILE_ROWS)):
                w = ma[q] @ mb[s:e].T
                own = np.minimum(np.searchsorted(dst[s:e], src[q]), e - s - 1)
                itself = dst[s:e][own] == src[q]
                w[itself, own[itself]] = -2
                floor = score[q, -1]
                if e - s > k and (floor == -2).any():
                    new = floor == -2
                    floor[new] = np.partition(w[new], e - s - k, axis=1)[:, e - s - k]
                r, c = np.divmod(np.flatnonzero(w >= np.maximum(floor - CLOSE, max(least, -1.5))[:, None]), e - s)
                found, rounded, other = w[r, c], np.round(w[r, c], 12), dst[s + c]
                last = (score[q[r], -1], near[q[r], -1])
                better = (rounded > last[0]) | ((rounded == last[0]) & (other < last[1]))
                if not better.any():
                    continue
                r, found, rounded, other = r[better], found[better], rounded[better], other[better]
                met = np.unique(r)
                own = np.concatenate([r, np.repeat(met, k)])
                found, rounded, other = (np.concatenate([new, old[q[met]].ravel()]) for new, old in ((found, weight), (rounded, score), (other, near)))
                order = np.lexsort((other, -rounded, own))
                own = own[order]
                order = order[np.arange(len(own)) - np.searchsorted(own, own) < k]
                for held, new in ((weight, found), (score, rounded), (near, other)):
                    held[q[met]] = new[order].reshape(len(met), k)
    r, c = np.nonzero(score > -2)
    return pa.table({"src": src[r], "dst": near[r, c], "weight": weight[r, c]})


def search(path: str, asked: DataFrame, k: int = 12, least: float = -1.0, take: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", block: int | None = None) -> DataFrame:
    """(src, dst, weight): the ``k`` rows of the index most similar to each row of ``asked``, of at least ``least``, its own id
    left out, ties to the smaller id. ``take`` lists are read for a row, by default as many as the index was built for; all
    of them make the search exact.

    Files of lists that no row asks for aren't read. Rows of the index and rows that ask lie in groups, by their nearest list, of
    ``block`` rows at most (by default an eighth of all); groups meet where a row of one asks for a list of the other.
    """
    spark = asked.sparkSession
    centroids = centroids_of(spark, path)
    take = min(take or centroids.take, len(centroids.vectors))
    rows = rows_of(asked, id_col, vector_col)
    own = _dealt(listed(rows, centroids).select("list"), centroids.vectors, block)
    askers: dict[int, list[int]] = {}
    for r in _asks(rows, centroids, take, own).distinct().collect():  # groups and lists that meet
        askers.setdefault(r["list"], []).append(r["a"])
    targets = _stored(spark, path).where(F.col("list").isin(sorted(askers)))
    first, parts = _dealt(targets.select("list"), centroids.vectors, block)
    members = [np.array([n for n in askers if first[n] <= b < first[n] + parts[n]], np.int64) for b in range(int((first + parts).max()))]
    left = _asks(rows, centroids, take, own, members)
    meet = spark.createDataFrame([(n, int(first[n]), int(parts[n]), a) for n, a in askers.items()], "list int, first long, parts long, a array<long>")
    right = targets.join(F.broadcast(meet), "list").select(F.explode("a").alias("a"), (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("b"), F.col("id").alias("other"), F.col("v").alias("w"), "list")

    def compare(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return _nearest(np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0, np.int64), np.zeros((0, 0)), k, least)
        return _among(x, y, members[key[1].as_py()], k, least)

    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(compare, NEAR)
    w = Window.partitionBy("src").orderBy(F.desc(F.round("weight", 12)), "dst")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("src", "dst", "weight")
