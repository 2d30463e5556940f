"""What users build on: their own extractors, functions of SQL, and tables as text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .operators.groups import inside
from .sources import readers

#: What an extractor gives for each document.
TERMS = "term string, definition string, score double, frequency long, contexts array<string>"


class Extractor(Protocol):
    """Gives (doc_id, term, definition, score, frequency, contexts) for documents (doc_id, text)."""

    def extract(self, docs: DataFrame) -> DataFrame: ...


class FromFunction:
    """An extractor from a plain function of one text, run on Arrow batches. It gives rows (term, definition, score,
    frequency, contexts); shorter ones are filled with nulls. A text that it fails on gives no row."""

    def __init__(self, function: Callable[[str], list[tuple]]) -> None:
        self.function = function

    def extract(self, docs: DataFrame) -> DataFrame:
        function, kind = self.function, dict(docs.dtypes)["doc_id"]
        names = [x.split()[0] for x in TERMS.split(", ")]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for i, s in zip(batch["doc_id"], batch["text"]):
                    try:
                        found = function(s) if isinstance(s, str) else []
                    except Exception:  # noqa: BLE001 - a user's function may raise anything
                        found = []
                    rows += [(i, *r, *[None] * (len(names) - len(r))) for r in found]
                yield pd.DataFrame(rows, columns=["doc_id", *names])

        return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, {TERMS}")


class FromPlan:
    """An extractor from a plan over documents that gives (doc_id, term, frequency, score), such as
    :func:`termloom.plans.extract.compound_terms` or :func:`~termloom.plans.extract.graph_terms`."""

    def __init__(self, plan: Callable[[DataFrame], DataFrame]) -> None:
        self.plan = plan

    def extract(self, docs: DataFrame) -> DataFrame:
        rows = self.plan(docs)
        return rows.select("doc_id", "term", F.lit(None).cast("string").alias("definition"), "score", "frequency", F.lit(None).cast("array<string>").alias("contexts"))


def extract_from_directory(spark: SparkSession, path: str, extractor: Extractor, recursive: bool = False, options: readers.Options = readers.Options()) -> DataFrame:  # noqa: B008 - frozen
    """An extractor's terms of every file of a folder, or of one file, with the file's path as ``doc_id``; files that
    can't be read or are empty give none."""
    files = readers.read_directory(spark, path, recursive=recursive, options=options).where("error IS NULL AND coalesce(text, '') <> ''")
    return extractor.extract(files.select(F.col("path").alias("doc_id"), "text"))


#: Functions of SQL, by name: parameters and the expression; Catalyst puts it in place of the call.
FUNCTIONS = {
    "termloom_base_score": ("tfidf DOUBLE, c_value DOUBLE", "DOUBLE", "0.3 * tfidf + 0.7 * c_value"),
    "termloom_statistical_score": ("c_value DOUBLE, tfidf DOUBLE, frequency BIGINT", "DOUBLE", "0.5 * c_value + 30 * tfidf + 0.2 * ln(frequency + 1)"),
    "termloom_priority_score": ("statistical DOUBLE, perplexity DOUBLE, probability DOUBLE", "DOUBLE", "0.4 * coalesce(statistical, 0) + 0.4 * (100 - coalesce(perplexity, 50)) + 20 * coalesce(probability, 0.1)"),
    "termloom_perplexity": ("logprobs ARRAY<DOUBLE>", "DOUBLE", "CASE WHEN size(logprobs) > 0 THEN exp(-(aggregate(logprobs, 0D, (s, x) -> s + x) / size(logprobs))) END"),
    "termloom_count_apart": ("s STRING, t STRING", "BIGINT", "CASE WHEN length(t) > 0 THEN CAST((length(s) - length(replace(s, t, ''))) / length(t) AS BIGINT) ELSE 0 END"),
}


def register(spark: SparkSession) -> None:
    """Make the operators that are plain expressions functions of the session's SQL."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")


def shown(df: DataFrame, n: int = 20, width: int = 100) -> str:
    """The first ``n`` rows as a table of text."""
    rows = [[("" if v is None else str(v))[:width] for v in r] for r in df.limit(n).collect()]
    table = [list(df.columns), *rows]
    sizes = [max(len(r[k]) for r in table) for k in range(len(df.columns))]
    return "\n".join(" | ".join(v.ljust(s) for v, s in zip(r, sizes)).rstrip() for r in table)


class _CompoundTerms:
    """Handler of the table function: terms of the documents of a table, its id and any other columns passed on."""

    @staticmethod
    def analyze(docs: AnalyzeArgument, longest: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not docs.isTable:
            raise ValueError("the first argument must be a table: termloom_terms(TABLE(docs))")
        kept = [f for f in docs.dataType.fields if f.name.lower() != "text"]
        if len(kept) == len(docs.dataType.fields):
            raise ValueError("the table needs a column text")
        if longest is not None and not (longest.isConstantExpression and isinstance(longest.value, int) and longest.value > 0):
            raise ValueError("the most words of a term must be a constant number from 1")
        taken = {f.name.lower() for f in kept} & {"term", "frequency", "c_value"}
        if taken:
            raise ValueError(f"columns of the result are in the table already: {sorted(taken)}")
        schema = StructType([*kept, StructField("term", StringType()), StructField("frequency", LongType()), StructField("c_value", DoubleType())])
        return AnalyzeResult(schema=schema)

    def eval(self, row: Row, longest: int = 3) -> Iterator[tuple]:
        values = row.asDict()
        name = next(n for n in values if n.lower() == "text")
        text, kept = values[name], tuple(v for n, v in values.items() if n != name)
        counts: Counter[str] = Counter()
        for run in re.split(r"[^\w\s\-]+", text or ""):
            words = re.findall(r"[^\W_][\w\-]*", run)
            counts.update(" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1))
        terms = sorted(counts)
        held: dict[int, list[int]] = {}
        for whole, own in inside(terms, 2):
            for part in own:
                held.setdefault(part, []).append(counts[terms[whole]])
        for i, t in enumerate(terms):
            mean = sum(held[i]) / len(held[i]) if i in held else 0.0
            yield (*kept, t, counts[t], max(0.0, math.log2(len(t) + 1) * (counts[t] - mean)))


def register_functions(spark: SparkSession) -> None:
    """``SELECT * FROM termloom_terms(TABLE(docs), 3)`` in the session's SQL: for every row of a table with a column
    ``text``, its n-grams of up to three words that no mark divides, their frequency and C-value, beside the row's other
    columns. Null texts give no row. Each row is worked on where it is: nothing is shuffled."""
    spark.udtf.register("termloom_terms", F.udtf(_CompoundTerms))
