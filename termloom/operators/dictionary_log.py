"""The dictionary as a log: batches of changes beside a snapshot, merged when they are read, compacted now and then.

A batch costs what it holds, not what the dictionary holds. ``store/deltas/batch=n`` has the rows of batch n, and
``store/snapshots/upto=n`` all that batches up to n made; the latter counts once it is complete. A batch that is written
again replaces itself. Reading takes the newest complete snapshot and the batches after it in one aggregation, which
gives what :func:`dictionary.upsert` gives batch by batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .dictionary import DDL

#: Of a snapshot and of a batch's rows.
COLUMNS = tuple(part.split()[0] for part in DDL.split(", "))
SCHEMA = DDL.replace(" NOT NULL", "")


def _listed(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers of complete tables under a path, in order."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    names = [(f.getPath().getName(), f.getPath()) for f in files.listStatus(where)]
    whole = [n for n, p in names if n.startswith(prefix) and files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.removeprefix(prefix)) for n in whole)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def append(store: str, batch: int, incoming: DataFrame, now: Column) -> None:
    """Write the changes of a batch, a row a headword, with the time at which they count."""
    incoming.select(*[c for c in COLUMNS if c not in ("created_at", "updated_at")], now.alias("stamp")).write.mode("overwrite").parquet(f"{store}/deltas/batch={batch}")


def start(store: str, rows: DataFrame, batch: int = -1) -> None:
    """A snapshot of a dictionary that is there already."""
    rows.select(*COLUMNS).write.mode("overwrite").parquet(f"{store}/snapshots/upto={batch}")


def read(spark: SparkSession, store: str) -> DataFrame:
    """The dictionary as the log has it: one shuffle of the snapshot and of the batches after it."""
    return _merged(spark, store)[0]


def _merged(spark: SparkSession, store: str) -> tuple[DataFrame, int | None]:
    snapshots = _listed(spark, f"{store}/snapshots", "upto=")
    upto = snapshots[-1] if snapshots else None
    batches = [b for b in _listed(spark, f"{store}/deltas", "batch=") if upto is None or b > upto]
    rows = spark.createDataFrame([], SCHEMA) if upto is None else spark.read.schema(SCHEMA).parquet(f"{store}/snapshots/upto={upto}")
    if not batches:
        return rows.select(*COLUMNS), upto
    kinds = {c: t for c, t in (part.split(" ", 1) for part in SCHEMA.split(", "))}
    schema = ", ".join(f"{c} {t}" for c, t in kinds.items() if c not in ("created_at", "updated_at")) + ", stamp TIMESTAMP"
    changes = None
    for b in batches:
        own = spark.read.schema(schema).parquet(f"{store}/deltas/batch={b}").withColumn("__at", F.lit(b).cast("long"))
        own = own.withColumn("created_at", F.col("stamp")).withColumn("updated_at", F.col("stamp")).drop("stamp")
        changes = own if changes is None else changes.unionByName(own)
    every = rows.withColumn("__at", F.lit(-(1 << 62)).cast("long")).unionByName(changes)
    latest = lambda c, kept: F.max_by(c, F.when(kept, F.col("__at"))).alias(c)
    known = lambda c: F.col(c).isNotNull()
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))))).alias(c)
    # the last definition that says something; else an empty one, if there is any
    definition = F.coalesce(F.max_by("definition", F.when(F.coalesce("definition", F.lit("")) != "", F.col("__at"))), F.max("definition")).alias("definition")
    merged = every.groupBy("headword").agg(union("synonyms"), definition, latest("category", known("category")), F.max("confidence").alias("confidence"), union("source_docs"), latest("embedding", known("embedding")), F.min("created_at").alias("created_at"), latest("updated_at", known("updated_at")))
    return merged.select(*COLUMNS), batches[-1]


def compact(spark: SparkSession, store: str, least: int = 8) -> bool:
    """A new snapshot once ``least`` batches have come since the last; what it replaces goes when it is complete."""
    snapshots, batches = _listed(spark, f"{store}/snapshots", "upto="), _listed(spark, f"{store}/deltas", "batch=")
    open_ = [b for b in batches if not snapshots or b > snapshots[-1]]
    if len(open_) < max(1, least):
        return False
    merged, upto = _merged(spark, store)
    merged.write.mode("overwrite").parquet(f"{store}/snapshots/upto={upto}")
    for n in snapshots:
        _remove(spark, f"{store}/snapshots/upto={n}")
    for b in batches:
        _remove(spark, f"{store}/deltas/batch={b}")
    return True
