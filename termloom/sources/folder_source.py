"""A data source of documents in folders, for ``spark.read.format("termloom")`` and SQL, and a stream of new ones."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import readers

SCHEMA = "path string, file_name string, file_type string, file_size long, text string, error string"


@dataclass
class Files(InputPartition):
    """Files that one task reads."""

    paths: list[str]


class FolderReader(DataSourceReader):
    """Lists a folder on the driver, names and sizes only, and reads its files in tasks of some ``bytes_per_task``."""

    def __init__(self, options: dict) -> None:
        self.path = options.get("path")
        if not self.path:
            raise ValueError("the source needs a path")
        self.recursive = str(options.get("recursive", "false")).lower() == "true"
        self.bytes_per_task = int(options.get("bytesPerTask", 128 << 20))

    def _files(self) -> Iterator[tuple[str, int]]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=self.recursive))
        for f in sorted(found, key=lambda f: f.path):
            if f.type == fs.FileType.File and f.extension.lower() in readers.TYPES:
                yield f.path, f.size

    def partitions(self) -> list[Files]:
        out: list[Files] = []
        size = 0
        for path, n in self._files():
            if not out or size + n > self.bytes_per_task:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(path)
            size += n
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            name, text, error, size = path.rsplit("/", 1)[-1], None, None, None
            kind = readers.TYPES[name.rsplit(".", 1)[-1].lower()]
            try:
                with system.open_input_file(path) as f:
                    raw = f.read()
                size, text = len(raw), readers.parse(kind, raw)
            except Exception as e:  # noqa: BLE001 - a file that can't be read is a row with its error
                error = f"{type(e).__name__}: {e}"
            yield path, name, kind, size, text, error


class FolderSource(DataSource):
    """Documents of a folder (``path``, an absolute path or a URI that pyarrow knows) or of one file, a row a file of a known
    type; ``recursive`` goes into folders, ``bytesPerTask`` bounds what a task reads unless one file is larger."""

    @classmethod
    def name(cls) -> str:
        return "termloom"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> FolderReader:
        return FolderReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FolderSource)


def new_documents(spark: SparkSession, path: str, most_files: int = 1000) -> DataFrame:
    """A stream of the files that come into a folder, read by their types, each content once.

    Spark's file source keeps in its checkpoint which files were taken. A file that holds what another held before is
    dropped by the digest of its content, whose state is spread over the cluster by its key and grows with the number of
    different contents. A file that can't be read is a row with its error; an empty file gives no row.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in readers.TYPES.items() for x in kv])
    rows = files.option("maxFilesPerTrigger", most_files).load(path).withColumn("file_type", F.element_at(known, extension)).where("file_type IS NOT NULL")
    rows = rows.withColumn("content_hash", F.sha2("content", 256)).dropDuplicates(["content_hash", "file_type"])
    return readers.parsed(rows.select("path", "file_type", F.col("length").alias("file_size"), "content_hash", "content"))
