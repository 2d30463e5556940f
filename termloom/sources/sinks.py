"""Sinks: nested JSON, CSV, run logs, dictionary snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nested_results(terms: DataFrame, file_col: str = "file_path", contexts: int = 3) -> DataFrame:
    """One row a file with its terms in order of score, ``contexts`` of each at most."""
    cut = terms.withColumn("contexts", F.slice(F.coalesce("contexts", F.array().cast("array<string>")), 1, contexts))
    item = F.struct(*[c for c in ("term", "definition", "score", "frequency", "contexts") if c in cut.columns])
    ordered = F.array_sort(F.collect_list(F.struct((-F.coalesce("score", F.lit(0.0))).alias("s"), F.col("term").alias("t"), item.alias("item"))))
    return cut.groupBy(file_col).agg(F.transform(ordered, lambda x: x["item"]).alias("terms"))


def run_metadata(terms: DataFrame, **facts: str) -> DataFrame:
    """One row about a run: the counts of its terms and what is given, as ``metadata``."""
    counted = terms.agg(F.count(F.lit(1)).alias("total_terms"), F.count_distinct("term").alias("unique_terms"))
    return counted.select(F.struct("total_terms", "unique_terms", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("extraction_date"), *[F.lit(v).alias(k) for k, v in facts.items()]).alias("metadata"))


def write_json(terms: DataFrame, path: str, file_col: str = "file_path", **facts: str) -> None:
    """A folder ``results`` with a line a file and one ``metadata`` with the run's one line."""
    nested_results(terms, file_col).write.mode("overwrite").json(f"{path}/results")
    run_metadata(terms, **facts).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def csv_rows(terms: DataFrame, file_col: str = "file_path") -> DataFrame:
    return terms.select(F.col(file_col).alias("file"), "term", F.format_string("%.3f", F.col("score").cast("double")).alias("score"), "frequency", "definition")


def write_csv(terms: DataFrame, path: str, file_col: str = "file_path") -> None:
    csv_rows(terms, file_col).write.mode("overwrite").csv(path, header=True)


def save(terms: DataFrame, path: str, kind: str = "json", file_col: str = "file_path") -> None:
    if kind not in ("json", "csv"):
        raise ValueError(f"no such format: {kind}")
    {"json": write_json, "csv": write_csv}[kind](terms, path, file_col)


#: Columns of a review file, as far as they exist.
REVIEW = ("term", "perplexity", "frequency", "priority_score", "c_value", "tfidf", "definition")


def review_rows(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in REVIEW if c in df.columns])


def write_review(df: DataFrame, path: str, bom: bool = True) -> None:
    """One file for a spreadsheet, a byte order mark at its head; a review is a bounded report."""
    rows = review_rows(df)
    head = rows.columns[0]
    named = rows.withColumnRenamed(head, ("\ufeff" if bom else "") + head)
    named.coalesce(1).write.mode("overwrite").csv(path, header=True, encoding="UTF-8")


def write_rows(df: DataFrame, path: str) -> None:
    """Results or statistics as JSON lines."""
    df.write.mode("overwrite").json(path)


def excluded(terms: DataFrame) -> DataFrame:
    """Terms that validation dropped, with its reason."""
    return terms.where("NOT kept").select("term", "score", "frequency", "reason")


def write_excluded(terms: DataFrame, path: str, stamp: str) -> str:
    """The dropped terms in a folder that carries the time of the run; returns its path."""
    out = f"{path}/excluded_terms_{stamp}"
    write_rows(excluded(terms), out)
    return out


def write_dictionary(stored: DataFrame, path: str) -> None:
    """The dictionary without vectors, a line a headword."""
    write_rows(stored.drop("embedding"), path)


def write_evaluation(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """Evaluated terms by class (unknown, known, error) and the row that counts them."""
    label = F.when(F.col("error").isNotNull(), "error").when(F.col("is_unknown"), "unknown").otherwise("known")
    rows.withColumn("class", label).write.mode("overwrite").partitionBy("class").json(f"{path}/terms")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def envelope(done: DataFrame, source: str, version: str = "1") -> DataFrame:
    """One row: what a preprocessing run read and all its documents. For runs of a bounded size; others keep a table."""
    documents = done.where("error IS NULL AND coalesce(text, '') <> ''")
    items = F.array_sort(F.collect_list(F.struct(*[c for c in done.columns if c != "error"])))
    facts = F.struct(F.lit(source).alias("source_directory"), F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("text_length"), F.lit(0)).cast("long").alias("total_characters"), F.lit(version).alias("preprocessor_version"))
    return documents.agg(facts.alias("metadata"), items.alias("documents"))


def read_envelope(spark, path: str) -> DataFrame:
    """The documents of envelopes, a row each."""
    return spark.read.json(path, multiLine=True).select(F.explode("documents").alias("d")).select("d.*")


def listing(spark, path: str) -> DataFrame:
    """The log of preprocessing runs, the newest first."""
    return spark.read.parquet(path).orderBy(F.desc("processed_at"), "source")


def buckets(df: DataFrame, label: str = "confidence", score: str = "perplexity") -> DataFrame:
    """(label, n, terms): each class with its terms in ascending order of score."""
    item = F.struct(score, "term", "frequency")
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(item)).alias("terms"))


def append_log(done: DataFrame, path: str, source: str) -> None:
    """One row of a preprocessing run, appended to the log of runs."""
    done.agg(F.lit(source).alias("source"), F.current_timestamp().alias("processed_at"), F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("text_length"), F.lit(0)).alias("characters")).write.mode("append").parquet(path)
