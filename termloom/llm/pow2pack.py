"""Packing by power-of-two decomposition: every document is cut into pieces of binary length and pieces of equal length
share a bucket. A piece is a sequence of its own, so no sequence crosses documents and none is padded.
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

PIECE = "doc long, start long, length long, doc_tokens long, part int, slot long, ids binary"


def cuts(lengths: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces: as many of ``longest`` (a power of two) as fit, then the binary digits of the rest."""
    full, rest = lengths // longest, lengths % longest
    digits = longest >> np.arange(1, int(longest).bit_length())
    has = (rest[:, None] & digits[None, :]) > 0
    count = full + has.sum(axis=1)
    doc = np.repeat(np.arange(len(lengths)), count)
    length = np.full(len(doc), longest, np.int64)
    first = np.concatenate([[0], count.cumsum()])
    row, col = np.nonzero(has)
    nth = np.arange(len(row)) - np.concatenate([[0], has.sum(axis=1).cumsum()])[row]
    length[first[row] + full[row] + nth] = digits[col]
    end = length.cumsum()
    start = end - length - np.concatenate([[0], lengths.cumsum()])[doc]
    return doc, start, length


@task("tokens")
def _pieces(batches: Iterator[pa.RecordBatch], path: str, blanks: bool, end_id: int, longest: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    used = np.zeros(int(longest).bit_length(), np.int64)  # pieces so far of each length
    for batch in batches:
        texts = batch.column(1)
        for row, end, data, offsets in text_slices(texts):
            ids, first = with_end(*encoder(path, blanks).encode(texts.slice(row, end - row), data, offsets), end_id)
            doc, start, length = cuts(np.diff(first), longest)
            kind = np.round(np.log2(length)).astype(np.int64)
            order = np.argsort(kind, kind="stable")
            per = np.bincount(kind, minlength=len(used))
            slot = np.empty(len(kind), np.int64)
            slot[order] = np.arange(len(kind)) - np.concatenate([[0], per.cumsum()])[kind[order]]
            slot += used[kind]
            used += per
            at = np.concatenate([[0], length.cumsum() * 4])
            if at[-1] >= 1 << 31:
                binary = pa.array([ids[e // 4 - k : e // 4].astype("<u4").tobytes() for e, k in zip(at[1:], length)], pa.binary())
            else:
                binary = pa.BinaryArray.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
            columns = [batch.column(0).slice(row, end - row).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(np.diff(first)[doc]), pa.array(np.full(len(doc), part, np.int32)), pa.array(slot), binary]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "start", "length", "doc_tokens", "part", "slot", "ids"])


def pieces(docs: DataFrame, path: str, blanks: bool, end_id: int, longest: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces with their ids, its place among equal lengths in its partition, and no shuffle.

    Null texts are empty and give the end id alone; a null id and rows that repeat an id are documents of their own.
    Other columns don't matter, whatever their names; an empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _pieces(it, path, blanks, end_id, longest), PIECE).withColumnRenamed("doc", id_col)


def number_sequences(found: DataFrame) -> DataFrame:
    """``found`` with ``sequence_id`` and ``offset`` in place of its partition and slot.

    Ids are dense and ordered by bucket, longest first, so a bucket is one range of ids. The pieces are written once,
    then counted by (length, partition of the writer); running sums are taken per length over those counts only.
    """
    found = written(found, "pieces")
    counts = found.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    within = counts.withColumn("within", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
    buckets = counts.groupBy("length").agg(F.sum("n").alias("n"))
    buckets = buckets.select("length", (F.sum("n").over(Window.orderBy(F.desc("length"))) - F.col("n")).alias("first"))
    bases = within.join(F.broadcast(buckets), "length").select("length", "part", (F.col("first") + F.col("within")).alias("base"))
    numbered = found.join(bases, ["length", "part"]).withColumn("sequence_id", F.col("base") + F.col("slot")).withColumn("offset", F.lit(0).cast("long"))
    return numbered.drop("part", "slot", "base")
