"""The term dictionary: merging, snapshots with upserts, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A stored dictionary's columns.
DDL = "headword STRING NOT NULL, synonyms ARRAY<STRING>, definition STRING, category STRING, confidence DOUBLE, source_docs ARRAY<STRING>, embedding ARRAY<FLOAT>, created_at TIMESTAMP, updated_at TIMESTAMP"


def _union(col: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(col))))


def merge_terms(rows: DataFrame, order: str = "ord") -> DataFrame:
    """One row a term: frequencies summed, contexts joined in order, the best score, the longest definition (the first of
    equals) and the first metadata."""
    contexts = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, "contexts"))), lambda x: x["contexts"]))
    definition = F.max_by("definition", F.struct(F.length(F.coalesce("definition", F.lit(""))), -F.col(order)))
    return rows.groupBy("term").agg(F.sum("frequency").alias("frequency"), F.max("score").alias("score"), definition.alias("definition"), contexts.alias("contexts"), F.min_by("metadata", order).alias("metadata"))


def merge_headwords(rows: DataFrame, order: str = "ord") -> DataFrame:
    """One row a headword in any case: synonyms and sources united, distinct definitions joined, the first category."""
    category = F.min_by("category", F.when(F.col("category").isNotNull(), F.col(order)))
    definitions = F.array_join(F.array_sort(F.collect_set(F.nullif("definition", F.lit("")))), " / ")
    return rows.groupBy(F.lower("headword").alias("key")).agg(F.min_by("headword", order).alias("headword"), _union("synonyms").alias("synonyms"), definitions.alias("definition"), category.alias("category"), _union("source_docs").alias("source_docs"))


def merge_loose(rows: DataFrame, order: str = "ord") -> DataFrame:
    """As :func:`merge_headwords` on the trimmed headword, with the first definition and category that aren't empty."""
    first = lambda c: F.min_by(c, F.when(F.coalesce(c, F.lit("")) != "", F.col(order)))
    return rows.groupBy(F.lower(F.trim("headword")).alias("key")).agg(F.min_by("headword", order).alias("headword"), _union("synonyms").alias("synonyms"), first("definition").alias("definition"), first("category").alias("category"))


def upsert(stored: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """The next snapshot. Synonyms and sources unite, a new definition counts unless empty, category and embedding unless
    null, confidence is the larger, and ``updated_at`` moves; both sides hold a headword once."""
    o, n = stored.alias("o"), incoming.alias("n")
    new = lambda c: F.col(f"n.{c}")
    old = lambda c: F.col(f"o.{c}")
    hit = new("headword").isNotNull()
    empty = F.array().cast("array<string>")
    either = lambda c: F.array_sort(F.array_union(F.coalesce(old(c), empty), F.coalesce(new(c), empty)))
    return o.join(n, old("headword") == new("headword"), "full_outer").select(
        F.coalesce(new("headword"), old("headword")).alias("headword"),
        either("synonyms").alias("synonyms"),
        F.coalesce(F.nullif(new("definition"), F.lit("")), old("definition"), new("definition")).alias("definition"),
        F.coalesce(new("category"), old("category")).alias("category"),
        F.greatest(new("confidence"), old("confidence")).alias("confidence"),
        either("source_docs").alias("source_docs"),
        F.coalesce(new("embedding"), old("embedding")).alias("embedding"),
        F.coalesce(old("created_at"), now).alias("created_at"),
        F.when(hit, now).otherwise(old("updated_at")).alias("updated_at"),
    )


def search(stored: DataFrame, query: str, most: int = 10) -> DataFrame:
    """Headwords like ``%query%`` in any case, or a synonym equal to it; newest and surest first. % and _ stay wildcards."""
    hit = F.col("headword").ilike(f"%{query}%") | F.array_contains("synonyms", query)
    return stored.where(hit).orderBy(F.desc("updated_at"), F.desc("confidence"), "headword").limit(most)


def create(spark: SparkSession, name: str, path: str) -> None:
    """The stored dictionary's table, made where there is none. One headword a row is what :func:`upsert` keeps."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({DDL}) USING parquet LOCATION '{path}'")
