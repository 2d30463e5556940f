"""Search in a dictionary by posting lists, in place of a scan for each request.

``path/grams/part=n`` holds, by a hash of the gram, which headwords hold it: grams of one to three characters of the
headword in lower case. ``path/synonyms/part=n`` holds synonyms as they are, ``path/rows/part=n`` the rows by a hash of the
headword. A search reads the parts of its own grams, counts which headwords have them all, and compares only those.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of each table, and characters of a gram at most.
PARTS, GRAM = 64, 3


def _part(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(PARTS)).cast("int")


def _grams(word: Column) -> Column:
    def of(k: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.length(word) - k + 1), lambda i: F.substring(word, i, k))
        return F.when(F.length(word) >= k, runs).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*map(of, range(1, GRAM + 1))))


def build(stored: DataFrame, path: str) -> None:
    """The index of ``stored(headword, synonyms, confidence, updated_at, ...)``, made anew; rows without a headword are left
    out. A gram that very many headwords hold is dealt to several files of its part."""
    rows = stored.where("headword IS NOT NULL")
    grams = rows.select("headword", F.explode(_grams(F.lower("headword"))).alias("gram"))
    synonyms = rows.select("headword", F.explode("synonyms").alias("synonym"))
    for name, table, key in (("grams", grams, "gram"), ("synonyms", synonyms, "synonym"), ("rows", rows, "headword")):
        dealt = table.withColumn("part", _part(F.col(key))).repartition("part", F.pmod(F.xxhash64("headword"), F.lit(4)))
        dealt.sortWithinPartitions("part", key).write.mode("overwrite").partitionBy("part").parquet(f"{path}/{name}")


def literals(query: str) -> list[str]:
    """What stands between the wildcards % and _ of a query in lower case; a backslash and what it escapes are left out."""
    return [x for x in re.split(r"\\.|[%_\\]", query, flags=re.DOTALL) if x]


def _of(spark: SparkSession, path: str, key: str, values: list[str]) -> DataFrame:
    """The rows of some keys, from their parts alone."""
    wanted = spark.createDataFrame([(v,) for v in values], f"{key} string")
    parts = sorted(r["p"] for r in wanted.select(_part(F.col(key)).alias("p")).distinct().collect())  # PARTS at most
    return spark.read.parquet(path).where(F.col("part").isin(parts) & F.col(key).isin(values))


def search(spark: SparkSession, path: str, query: str, most: int = 10) -> DataFrame:
    """What :func:`dictionary.search` finds: headwords like ``%query%`` in any case, or a synonym equal to it, newest and surest
    first; % and _ are wildcards. Of a query without any literal character all rows are read."""
    pieces = [p.lower() for p in literals(query)]
    grams = sorted({p[i : i + min(GRAM, len(p))] for p in pieces for i in range(max(1, len(p) - GRAM + 1))})
    like = F.col("headword").ilike(f"%{query}%")
    rows = spark.read.parquet(f"{path}/rows").drop("part") if not grams else None
    synonyms = _of(spark, f"{path}/synonyms", "synonym", [query]).select("headword").distinct()
    if rows is None:
        holds = _of(spark, f"{path}/grams", "gram", grams).groupBy("headword").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams))
        hit = holds.select("headword").where(like).union(synonyms).distinct().withColumn("part", _part(F.col("headword")))
        found = spark.read.parquet(f"{path}/rows").join(hit, ["part", "headword"], "left_semi").drop("part")
    else:
        found = rows.where(like).union(rows.join(synonyms, "headword", "left_semi").where(~F.coalesce(like, F.lit(False))))
    return found.orderBy(F.desc("updated_at"), F.desc("confidence"), "headword").limit(most)
