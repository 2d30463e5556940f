"""Where intermediate tables go: the folder that the cluster names in ``spark.checkpoint.dir``.

Tables are removed once what was made of them is written itself (:func:`release`), the rest when the driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths of this driver's tables that are still there, in the order of writing.
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder. A temporary one is set only where the session names none and runs on one machine."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="termloom-")
        context.setCheckpointDir(named)
    return named


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder: its lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.parquet(path)
    out._written_at = path
    return out


def mark() -> int:
    """What :func:`release` takes: how many tables have been written."""
    return len(_written)


def release(since: int, *keep: DataFrame) -> None:
    """Remove the tables written since a mark, but for those kept. Nothing that is still to be computed may need them."""
    kept = {getattr(df, "_written_at", None) for df in keep}
    gone = [x for x in _written[since:] if x[1] not in kept]
    _written[since:] = [x for x in _written[since:] if x[1] in kept]
    for spark, path in gone:
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):  # a session that has ended, or a gateway that is gone
            remove(spark, path)
