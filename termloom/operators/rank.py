"""Ranking: penalties among contained terms, cut-offs, classes, reviews, ordered sets."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .candidates import with_containers
from .groups import fields, inside, per_key


def top_per(df: DataFrame, k: int, *keys: str, score: str = "score", term: str = "term") -> DataFrame:
    """The ``k`` best rows of every key, ties to the smaller term, with ``rank`` from 1."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), term)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top(df: DataFrame, k: int, score: str = "score", term: str = "term") -> DataFrame:
    return df.orderBy(F.desc(score), term).limit(k)


def _penalty() -> Column:
    f, m = F.col("frequency"), F.col("__most")
    return F.when(m > 0.10 * f, F.when(m / f > 0.2, 0.2).otherwise(0.4)).otherwise(F.lit(1.0))


def substring_penalty(scored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``penalty``: 0.2 or 0.4 where the most frequent container has over a fifth or a tenth of a term's frequency, else 1."""
    return with_containers(scored, id_col).withColumn("penalty", _penalty()).drop("__mean", "__most")


def _factors(terms: list[str], frequency: list[int], parts: dict[int, list[int]] | None = None) -> list[float]:
    """What is left of each term's score once long terms have penalised the terms they contain."""
    factor, done = [1.0] * len(terms), [False] * len(terms)
    parts = dict(inside(terms, 1)) if parts is None else parts
    for i in sorted(parts, key=lambda i: (-len(terms[i]), terms[i])):
        if done[i] or not frequency[i] > 3:
            continue
        for j in parts[i]:
            if frequency[i] > 0.05 * frequency[j]:
                factor[j] *= 0.5 if frequency[i] > 0.2 * frequency[j] else 0.7
                done[j] = True
    return factor


def compound_priority(scored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``factor``: long terms that nothing has penalised penalise the terms they contain, longest first.

    The order decides, so a document's terms are worked on together; its group is bounded by the document.
    """
    rows = scored.select(id_col, "term", "frequency")

    def work(table: pa.Table) -> pa.Table:
        return table.append_column("factor", pa.array(_factors(table.column("term").to_pylist(), table.column("frequency").to_pylist()), pa.float64()))

    return per_key(rows, id_col, work, f"{fields(rows)}, factor double")


def both_penalties(scored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``scored`` with the ``penalty`` of :func:`substring_penalty` and the ``factor`` of :func:`compound_priority`, for
    which a document's terms meet once."""
    columns = [id_col, *[c for c in scored.columns if c != id_col]]
    rows = scored.select(*columns)

    def work(table: pa.Table) -> pa.Table:
        terms, frequency = table.column("term").to_pylist(), table.column("frequency").to_pylist()
        most = [0] * len(terms)
        parts = dict(inside(terms, 1))
        for i, own in parts.items():
            for j in own:
                if len(terms[j]) > 1:
                    most[j] = max(most[j], frequency[i])
        table = table.append_column("__most", pa.array([m or None for m in most], pa.int64()))
        return table.append_column("factor", pa.array(_factors(terms, frequency, parts), pa.float64()))

    found = per_key(rows, id_col, work, f"{fields(rows)}, __most long, factor double")
    return found.withColumn("penalty", _penalty()).select(*scored.columns, "penalty", "factor")


def _steps(scored: DataFrame, id_col: str, high: int) -> DataFrame:
    """``scored`` with the place ``i`` of a term, best first, the number ``n`` of its document's terms, the relative drop
    ``rate`` before it, and whether the running sum has ``reached`` its share there."""
    order = Window.partitionBy(id_col).orderBy(F.desc("score"), "term")
    whole = Window.partitionBy(id_col)
    ranked = scored.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(whole))
    ranked = ranked.withColumn("rate", F.when((F.col("i") >= 1) & (F.col("i") < F.least(F.col("n") - 1, F.lit(high))) & (F.col("score") > 0), (F.lag("score").over(order) - F.col("score")) / F.col("score")))
    head = F.when(F.col("i") < high, F.col("score")).otherwise(0.0)
    running = F.round(F.sum(head).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), 9)
    return ranked.withColumn("reached", (F.col("i") < high) & (running >= F.round(0.8 * F.sum(head).over(whole), 9)))


#: What the cut-off is worked out from: aggregates of a document's steps.
MEASURES = {"best": lambda: F.max("rate"), "mean": lambda: F.avg("rate"), "at": lambda: F.max_by("i", F.struct("rate", -F.col("i"))), "part": lambda: F.min(F.when(F.col("reached"), F.col("i") + 1))}


def _cutoff(low: int, high: int) -> tuple[Column, Column, Column]:
    """(elbow, contribution, cutoff) from the measures and ``n``."""
    elbow = F.when(F.col("best") > 2 * F.col("mean"), F.least(F.floor(1.2 * F.col("at")), F.lit(high))).otherwise(low).cast("long")
    elbow, contribution = F.coalesce(elbow, F.lit(low).cast("long")), F.coalesce("part", F.lit(high)).cast("long")
    cut = F.when(F.col("n") <= low, F.col("n")).otherwise(F.greatest(F.lit(low), F.least(elbow, contribution, F.col("n"), F.lit(high))))
    return elbow, contribution, cut.cast("long")


def elbow_cutoff(scored: DataFrame, id_col: str = "doc_id", low: int = 20, high: int = 100) -> DataFrame:
    """(id, n, elbow, contribution, cutoff): how many terms are worth validating.

    The elbow is 1.2 times the place of the largest relative drop (the first such) if it is over twice the mean drop, at
    most ``high``, else ``low``. Contribution is the first place at which the running sum reaches eight tenths of the
    top ``high``. The cut-off is the smaller, within ``low`` and ``high``; up to ``low`` terms are all kept.
    """
    steps = _steps(scored.select(id_col, "term", "score"), id_col, high)
    per = steps.groupBy(id_col).agg(F.max("n").alias("n"), *[f().alias(name) for name, f in MEASURES.items()])
    elbow, contribution, cutoff = _cutoff(low, high)
    return per.select(id_col, "n", elbow.alias("elbow"), contribution.alias("contribution"), cutoff.alias("cutoff"))


def within_cutoff(scored: DataFrame, most: int, id_col: str = "doc_id", low: int = 20, high: int = 100) -> DataFrame:
    """The rows of ``scored`` within the cut-off of :func:`elbow_cutoff`, ``most`` a document at most, with ``rank`` from 1.

    One sort of each document's rows gives places and measures; nothing is joined back.
    """
    whole = Window.partitionBy(id_col)
    steps = _steps(scored, id_col, high).select("*", *[f().over(whole).alias(name) for name, f in MEASURES.items()])
    kept = steps.where((F.col("i") < most) & (F.col("i") < _cutoff(low, high)[2]))
    return kept.select(*scored.columns, (F.col("i") + 1).alias("rank"))


def three_way(p: Column, low: float = 30.0, high: float = 70.0) -> Column:
    """Low perplexity is high confidence; both ends are medium."""
    return F.when(p < low, "high").when(p > high, "low").otherwise("medium")


def by_steps(p: Column, first: float, second: float) -> Column:
    return F.when(p < first, "high_confidence").when(p < second, "medium_confidence").otherwise("low_confidence")


def short_steps(p: Column, first: float = 20.0, second: float = 50.0) -> Column:
    return F.when(p < first, "high").when(p < second, "medium").otherwise("low")


def inverted(p: Column, high: float = 25.0, medium: float = 15.0) -> Column:
    """High perplexity is high confidence."""
    return F.when(p > high, "high_confidence").when(p > medium, "medium_confidence").otherwise("low_confidence")


def dynamic_confidence(df: DataFrame, col: str = "perplexity") -> DataFrame:
    """Classes by the 70th and 90th percentile of values other than 50, where three or more are left; else fixed ones."""
    marks = df.where(F.col(col) != 50.0).agg(F.count(F.lit(1)).alias("__n"), F.percentile(col, 0.7).alias("__p70"), F.percentile(col, 0.9).alias("__p90"))
    p = F.col(col)
    moving = F.when(p > F.col("__p90"), "high_confidence").when(p > F.col("__p70"), "medium_confidence").otherwise("low_confidence")
    return df.join(F.broadcast(marks)).withColumn("confidence", F.when(F.col("__n") >= 3, moving).otherwise(inverted(p))).drop("__n", "__p70", "__p90")


def hotspots(chunks: DataFrame, *keys: str, col: str = "perplexity", factor: float = 1.5) -> DataFrame:
    """``is_hotspot``: above the mean by over ``factor`` population deviations within the keys."""
    w = Window.partitionBy(*keys)
    return chunks.withColumn("is_hotspot", F.col(col) > F.round(F.avg(col).over(w) + factor * F.stddev_pop(col).over(w), 9))


def review(df: DataFrame, most: int = 50) -> DataFrame:
    """Candidates of low and medium confidence, best priority first."""
    return df.where(F.col("confidence").isin("low", "medium")).orderBy(F.desc("priority_score"), "term").limit(most)


def first_of_equals(df: DataFrame, key: str, order: str, most: int, *groups: str) -> DataFrame:
    """Rows without later equals of ``key``, in order, at most ``most`` of a group."""
    once = df.withColumn("__k", F.row_number().over(Window.partitionBy(*groups, key).orderBy(order))).where("__k = 1")
    return once.withColumn("__k", F.row_number().over(Window.partitionBy(*groups).orderBy(order))).where(F.col("__k") <= most).drop("__k")


def colour(s: Column) -> Column:
    """How a score is shown."""
    return F.when(s > 0.7, "green").when(s > 0.4, "yellow").otherwise("red")


def band(s: Column) -> Column:
    return F.when(s < 0.4, "low").when(s < 0.6, "fair").when(s < 0.8, "good").otherwise("high")


def unknown_first(df: DataFrame) -> DataFrame:
    """Explicitly unknown terms first, errors last."""
    return df.orderBy(F.when(F.col("is_unknown"), -1.0).when(F.col("similarity") < 0, 999.0).otherwise(F.col("similarity")), "term")
