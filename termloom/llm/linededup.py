"""Line dedup: hashes are range-partitioned with documents and positions as the secondary sort, first occurrences are
streamed off the sorted rows, and what comes back is a compressed bitmap of kept lines per document, never text.

Main path: DataFrame functions only. Rows hold 16-byte line digests; a line that a third of all documents share is
spread over the ranges of (digest, document), is counted by partial sums, and its way back is a plain equi-join that
adaptive execution may split. A bitmap is a list of (word index, 64 drop bits); words without a dropped line are
absent, so a document that loses nothing has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: A digest's occurrences meet its owner in so many groups.
SALTS = 16
#: Characters stripped at both ends of a line.
BLANKS = " \t\n\x0b\f\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def stripped(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def folded(line: Column) -> Column:
    """Equal for two lines exactly if they are equal but for the case of A-Z; only to be hashed.

    ASCII lines are lower-cased as they are. Of other lines the UTF-8 bytes are lower-cased as Latin-1 characters: that
    shifts some lead bytes besides A-Z, but a shifted lead byte is followed by fewer continuation bytes than an
    unshifted one of that value, so different lines stay different.
    """
    as_bytes = F.decode(F.encode(line, "UTF-8"), "ISO-8859-1")
    return F.lower(F.when(F.octet_length(line) == F.length(line), line).otherwise(as_bytes))


def line_occurrences(docs: DataFrame, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, sig, pos, h): every line whose key has at least ``min_chars`` code points; sig tells texts of one id apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("sig"), F.posexplode(_lines(text)).alias("pos", "line"))
    keyed = lines.where(F.length("line") >= min_chars).withColumn("line", stripped(F.col("line")))
    return keyed.where(F.length("line") >= min_chars).select("doc", "sig", "pos", F.unhex(F.md5(folded(F.col("line")))).alias("h"))


def repeated_lines(occurrences: DataFrame, min_docs: int, partitions: int | None = None) -> DataFrame:
    """(h, owner): digests of lines found in at least ``min_docs`` documents, and the largest document of each."""
    if partitions is None:
        partitions = int(occurrences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = occurrences.select("h", "doc", "pos").repartitionByRange(partitions, "h", "doc").sortWithinPartitions("h", "doc", "pos")
    first = in_order.withColumn("n", F.row_number().over(Window.partitionBy("h", "doc").orderBy("pos"))).where("n = 1")
    return first.groupBy("h").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("owner")).where(F.col("n_docs") >= min_docs).select("h", "owner")


def drop_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, sig, bits): per document the compressed bitmap ``array<struct<w, b>>`` of the lines it loses, w ascending."""
    found = written(line_occurrences(docs, min_chars, id_col, text_col), "lines")
    repeated = repeated_lines(found, min_docs).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
    lost = salted.join(repeated, ["h", "salt"]).where(~F.col("doc").eqNullSafe(F.col("owner")))
    words = lost.groupBy("doc", "sig", F.expr("pos div 64").cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, pos % 64))").alias("b"))
    return words.groupBy("doc", "sig").agg(F.array_sort(F.collect_list(F.struct("w", "b"))).alias("bits"))


def _dense(bits: Column) -> Column:
    """The bitmap as one long per 64 lines, up to the last word that is present; linear in its length."""
    before = F.concat(F.array(F.lit(-1)), F.transform(bits, lambda x: x["w"]))
    padded = F.zip_with(bits, F.slice(before, 1, F.size(bits)), lambda x, w: F.concat(F.array_repeat(F.lit(0).cast("long"), x["w"] - w - 1), F.array(x["b"])))
    return F.flatten(padded)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``__kept`` (the text without its lost lines), ``__n_lines`` and ``__n_dropped``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumn("__sig", F.xxhash64(text))
    marks = bitmaps.select(F.col("doc").alias("__doc"), F.col("sig").alias("__sig2"), _dense(F.col("bits")).alias("__dense"))
    joined = keyed.join(marks, keyed[id_col].eqNullSafe(F.col("__doc")) & (F.col("__sig") == F.col("__sig2")), "left").drop("__doc", "__sig", "__sig2")
    lines = _lines(text)
    kept = F.filter(lines, lambda _, i: F.coalesce(F.get(F.col("__dense"), F.floor(i / 64).cast("int")), F.lit(0).cast("long")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i % 64)) == 0)
    joined = joined.withColumn("__n_lines", F.size(lines).cast("long")).withColumn("__keep", F.when(F.col("__dense").isNotNull(), kept))
    return (
        joined.withColumn("__n_dropped", F.when(F.col("__keep").isNull(), F.lit(0)).otherwise(F.col("__n_lines") - F.size("__keep")).cast("long"))
        .withColumn("__kept", F.when(F.col("__keep").isNull(), text).otherwise(F.array_join("__keep", "\n")))
        .drop("__dense", "__keep")
    )


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop repeated lines everywhere but in the largest document that holds them.

    Null and empty texts are one empty line. Rows that repeat an id count as one document; each keeps its own lines.
    A null id is a document smaller than any other. Other columns pass through; an empty table gives an empty one.
    """
    return apply_bitmaps(docs, drop_bitmaps(docs, min_chars, min_docs, id_col, text_col), id_col, text_col)
