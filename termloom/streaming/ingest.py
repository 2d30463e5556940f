"""Continuous ingestion: documents that arrive are scored and merged into the dictionary, a snapshot for each batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import dictionary, dictionary_log

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def ingest(spark: SparkSession, path: str, store: str, checkpoint: str, terms_of: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Read new Parquet files of documents under ``path`` and upsert ``terms_of`` them into snapshots under ``store``.

    Batch n writes ``store/snapshot=n`` from the snapshot before it and replaces a partial one, so that a batch that is
    run again gives the same rows.
    """

    def merge(batch: DataFrame, n: int) -> None:
        session = batch.sparkSession
        incoming = terms_of(batch)
        stored = session.createDataFrame([], incoming.schema) if n == 0 else session.read.parquet(f"{store}/snapshot={n - 1}")
        dictionary.upsert(stored, incoming, F.lit(n).cast("timestamp")).write.mode("overwrite").parquet(f"{store}/snapshot={n}")

    stream = spark.readStream.schema(DOCUMENTS).parquet(path)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_log(spark: SparkSession, path: str, store: str, checkpoint: str, terms_of: Callable[[DataFrame], DataFrame], compact_every: int = 8) -> StreamingQuery:
    """As :func:`ingest`, into a log: batch n appends its own changes and nothing else is rewritten, but for a new snapshot
    once ``compact_every`` batches are open. :func:`dictionary_log.read` has the dictionary."""

    def merge(batch: DataFrame, n: int) -> None:
        done = dictionary_log._listed(batch.sparkSession, f"{store}/snapshots", "upto=")
        if not done or done[-1] < n:  # else the batch is in a snapshot already and is run again
            dictionary_log.append(store, n, terms_of(batch), F.lit(n).cast("timestamp"))
            dictionary_log.compact(batch.sparkSession, store, compact_every)

    stream = spark.readStream.schema(DOCUMENTS).parquet(path)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
