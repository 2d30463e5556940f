"""Merged sketches against exact statistics of all rows."""

import math
import random
from bisect import bisect_left, bisect_right

import numpy as np
import pytest

from termloom.operators import sketches

ROWS = "key string, term string, score double"


def made(n, seed):
    r = random.Random(seed)
    return [("hot" if r.random() < 0.7 else r.choice("abc"), f"t{int(r.expovariate(1 / 4000))}", r.choice((r.gauss(50, 20), 50.0, float(r.randrange(100))))) for _ in range(n)]


def near(values, got, q, allowed=0.02):
    """Whether some rank of a value is near the asked one."""
    low, high = bisect_left(values, got) / len(values), bisect_right(values, got) / len(values)
    return low - allowed <= q <= high + allowed


def test_batches_merge_to_the_whole(spark):
    parts = [made(n, seed) for seed, n in enumerate((20_000, 1, 9_000, 500))]
    batches = None
    for rows in parts:
        one = sketches.batch(spark.createDataFrame(rows, ROWS), "score", "term", "key")
        batches = one if batches is None else batches.unionAll(one)
    every = [x for rows in parts for x in rows]
    got = {r["key"]: r for r in sketches.summary(sketches.merged(batches, "key"), "key").collect()}
    assert set(got) == {k for k, _, _ in every}
    for key, r in got.items():
        values = sorted(s for k, _, s in every if k == key)
        assert (r["rows"], r["n"], r["lowest"], r["highest"]) == (len(values), len(values), values[0], values[-1])
        assert r["mean"] == pytest.approx(np.mean(values)) and r["sigma"] == pytest.approx(np.std(values))
        assert all(near(values, r[c], q) for c, q in (("median", 0.5), ("p70", 0.7), ("p90", 0.9)))
        terms = len({t for k, t, _ in every if k == key})
        assert abs(r["distinct_items"] - terms) <= max(1, 5 * 1.04 / math.sqrt(1 << 12) * terms)
    # merging in steps and at once count the same rows
    whole = sketches.summary(sketches.merged(sketches.merged(batches, "key"))).first()
    values = sorted(s for _, _, s in every)
    assert whole["rows"] == len(every) and near(values, whole["p90"], 0.9) and near(values, whole["median"], 0.5)


def test_nulls_and_empty_tables(spark):
    rows = [("a", None, None), ("a", "t", float("nan")), ("a", "t", 2.0), ("b", None, None), (None, "u", 1.0)]
    got = {r["key"]: r for r in sketches.summary(sketches.merged(sketches.batch(spark.createDataFrame(rows, ROWS), "score", "term", "key"), "key"), "key").collect()}
    assert (got["a"]["rows"], got["a"]["n"], got["a"]["median"], got["a"]["distinct_items"]) == (3, 1, 2.0, 1)
    assert (got["b"]["rows"], got["b"]["n"], got["b"]["mean"], got["b"]["median"], got["b"]["distinct_items"]) == (1, 0, None, None, 0)
    assert got[None]["p90"] == 1.0
    none = spark.createDataFrame([], ROWS)
    assert sketches.batch(none, "score", "term", "key").count() == 0
    r = sketches.summary(sketches.merged(sketches.batch(none, "score", "term"))).first()
    assert (r["rows"], r["n"], r["mean"], r["p70"], r["distinct_items"]) == (0, 0, None, None, 0)
    clash = spark.createDataFrame([("x", 1.0, "n")], "rows string, n double, key string")
    r = sketches.summary(sketches.batch(clash, "n", "rows", "key"), "key").first()
    assert (r["key"], r["rows"], r["median"], r["distinct_items"]) == ("n", 1, 1.0, 1)


def test_features_of_blocks_add_up(spark):
    from pyspark.sql import functions as F

    from termloom.functions import text
    from termloom.operators import chunkers

    words = ["ABC", "12.5", "アンモニア", "x", "Fuel", "IMO-2", "　", "3"]
    docs = spark.createDataFrame([(i, " ".join(random.Random(i).choices(words, k=n))) for i, n in enumerate((0, 1, 19, 20, 21, 100, 101, 1234))] + [(99, None), (98, " ")], "doc_id long, text string")
    blocks = chunkers.word_blocks(docs).select("doc_id", "size", "chunk_id", F.length("chunk").alias("n_chars"), *[c.alias(n) for n, c in text.feature_counts(F.col("chunk")).items()])
    got = chunkers.feature_blocks(docs)
    assert got.columns == blocks.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, blocks.collect())) and got.count() > 90
