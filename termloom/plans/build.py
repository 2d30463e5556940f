"""Building a dictionary from documents in two passes over a provider, and searching it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import text
from ..operators import chunkers, dictionary, passes, stats
from ..sources.provider import Provider, embed
from ..sources.shared import cut


def chunks_of(docs: DataFrame, config: EngineConfig) -> DataFrame:
    """(doc_id, chunk_id, chunk): normalised texts in packs of sentences."""
    size, overlap, marks = config.chunk_size, config.overlap, config.profile.sentence_marks
    normal = docs.select("doc_id", text.normalise(F.col("text")).alias("text"))
    return chunkers.chunked(normal, lambda s: chunkers.pack_sentences(s, size, overlap, marks))


def build_dictionary(docs: DataFrame, provider: Provider, config: EngineConfig | None = None) -> DataFrame:
    """Dictionary rows: terms of every chunk, merged by headword, consolidated in batches, with vectors and sources.

    Replies are checkpointed before they are used again, so that none is paid for twice.
    """
    config = config or EngineConfig()
    found = cut(passes.extract_terms(chunks_of(docs, config), provider))
    found = found.withColumn("source", F.col("doc_id").cast("string")).withColumn("source_docs", F.array("source"))
    ranked = found.withColumn("ord", F.struct("doc_id", "chunk_id", "ord"))
    merged = cut(passes.with_sources(passes.consolidate(ranked, provider), found.select("headword", "source")))
    vectors = embed(merged, provider, "headword", config.batch_size)
    stamp = F.lit(None).cast("timestamp")
    return vectors.select("headword", "synonyms", "definition", "category", F.lit(1.0).alias("confidence"), "source_docs", F.col("embedding").cast("array<float>").alias("embedding"), stamp.alias("created_at"), stamp.alias("updated_at"))


def update_store(spark: SparkSession, path: str, incoming: DataFrame) -> DataFrame:
    """The next snapshot of the store under ``path``: what is there, if anything, with the incoming rows put in."""
    snapshots = sorted(r["n"] for r in _snapshots(spark, path))
    stored = spark.read.parquet(f"{path}/snapshot={snapshots[-1]}") if snapshots else spark.createDataFrame([], incoming.schema)
    out = f"{path}/snapshot={snapshots[-1] + 1 if snapshots else 0}"
    dictionary.upsert(stored, incoming, F.current_timestamp()).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def _snapshots(spark: SparkSession, path: str) -> list[dict[str, int]]:
    """Numbers of the snapshots that were written whole."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.globStatus(jvm.org.apache.hadoop.fs.Path(path, "snapshot=*/_SUCCESS")) or []
    return [{"n": int(f.getPath().getParent().getName().split("=")[1])} for f in found]


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest snapshot."""
    return spark.read.parquet(f"{path}/snapshot={max(r['n'] for r in _snapshots(spark, path))}")


def search(spark: SparkSession, path: str, query: str, most: int = 10) -> DataFrame:
    return dictionary.search(latest(spark, path), query, most)


def statistics(spark: SparkSession, path: str) -> DataFrame:
    return stats.dictionary_statistics(latest(spark, path))
