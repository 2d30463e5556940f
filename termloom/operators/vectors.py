"""Vector operators on arrays of floats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .groups import per_key


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors and zero norms; null for null vectors."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).when(a.isNotNull() & b.isNotNull(), F.lit(0.0))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    m = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _nearest(a: np.ndarray, ma: np.ndarray, b: np.ndarray, mb: np.ndarray, k: int, least: float) -> pa.Table:
    """(src, dst, weight): the ``k`` rows of b nearest to each row of a, by the ids a and b; ties to the smaller id."""
    src, dst, weight = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    if len(a) and len(b):
        order = np.argsort(b, kind="stable")
        b, mb = b[order], mb[order]
        for at in range(0, len(a), 256):
            s = ma[at : at + 256] @ mb.T
            s[a[at : at + 256, None] == b[None, :]] = -2
            s[s < least] = -2
            best = np.argsort(-np.round(s, 12), axis=1, kind="stable")[:, :k]
            q, r = np.nonzero(np.take_along_axis(s, best, 1) > -2)
            src.append(a[at + q])
            dst.append(b[best[q, r]])
            weight.append(s[q, best[q, r]])
    return pa.table({"src": np.concatenate(src), "dst": np.concatenate(dst), "weight": np.concatenate(weight)})


NEAR = "src long, dst long, weight double"


def knn_within(vectors: DataFrame, within: str, k: int = 12, least: float = 0.30, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(src, dst, weight): for every vector its ``k`` most similar others of at least ``least`` among those of its key.

    A key's vectors meet in one task and nowhere else; a key is a document's terms, some hundreds.
    """
    rows = vectors.where(F.col(vector_col).isNotNull()).select(within, F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    def work(table: pa.Table) -> pa.Table:
        ids, m = table.column("id").to_numpy(), _matrix(table, "v")
        return _nearest(ids, m, ids, m, k, least)

    return per_key(rows, within, work, NEAR)


def knn(vectors: DataFrame, k: int = 12, least: float = 0.30, id_col: str = "vec_id", vector_col: str = "embedding", asked: DataFrame | None = None, block: int = 1 << 14) -> DataFrame:
    """(src, dst, weight): for every vector, or every one of a stated set ``asked``, its ``k`` most similar others of at
    least ``least`` in the whole table, ties to the smaller id.

    Exact: each block of sources meets each block of targets in one task as two matrices, and only ``k`` rows a source and
    block leave it. Rows are shuffled once for each block of the other side, so a large table wants a stated set; graphs
    of a document's terms have :func:`knn_within`.
    """
    of = lambda df: df.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    targets, sources = of(vectors), of(vectors if asked is None else asked)
    count = lambda df: max(1, -(-df.count() // block))
    n, m = count(targets), count(sources)
    left = sources.withColumn("lb", F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    right = targets.toDF("other", "w").withColumn("b2", F.pmod(F.xxhash64("other"), F.lit(n)).cast("int")).withColumn("b1", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return _nearest(np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0, np.int64), np.zeros((0, 0)), k, least)
        return _nearest(x.column("id").to_numpy(), _matrix(x, "v"), y.column("other").to_numpy(), _matrix(y, "w"), k, least)

    found = left.groupBy("lb", "rb").cogroup(right.groupBy("b1", "b2")).applyInArrow(compare, NEAR)
    w = Window.partitionBy("src").orderBy(F.desc(F.round("weight", 12)), "dst")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("src", "dst", "weight")


def zipped(rows: DataFrame, vectors: DataFrame, place: str) -> DataFrame:
    """``rows`` with the vectors of the same place; null for a place that has none."""
    return rows.join(vectors, place, "left")


def build_store(chunks: DataFrame, path: str, vector_col: str = "embedding") -> None:
    """A table of chunks with their vectors and a preview, made anew."""
    kept = chunks.select("chunk_id", "text", vector_col, F.substring("text", 1, 100).alias("preview"))
    kept.write.mode("overwrite").parquet(path)


def similar_chunks(neighbours: DataFrame, chunks: DataFrame, most: int = 5, furthest: float = 0.5) -> DataFrame:
    """(src, context): the texts of a chunk's nearest others within a distance, joined; a marker where there is none."""
    near = neighbours.withColumn("distance", 2 - 2 * F.col("weight")).where(F.col("distance") < furthest)
    w = Window.partitionBy("src").orderBy("distance", "dst")
    near = near.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    texts = near.join(chunks.select(F.col("chunk_id").alias("dst"), "text"), "dst").groupBy("src").agg(F.array_sort(F.collect_list(F.struct("k", "text"))).alias("t"))
    joined = texts.select("src", F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("context"))
    return chunks.select(F.col("chunk_id").alias("src")).join(joined, "src", "left").withColumn("context", F.coalesce("context", F.lit("none")))
