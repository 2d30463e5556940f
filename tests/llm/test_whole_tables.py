"""Queries take all of their input: no document or vector is left out beforehand."""

import math

import numpy as np
import pytest

import corpus_pipeline
from termloom.llm import bitslice, mixing, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("size", [1e4, 1e6])
def test_search_takes_large_components(spark, size):
    rng = np.random.default_rng(3)
    v = [*rng.normal(0, 1, (40, 4)).tolist(), *rng.normal(0, size, (10, 4)).tolist()]
    rows = bitslice.quantised(spark.createDataFrame(list(enumerate(v)), "id long, e array<double>"), 256, "id", "e").cache()
    q = [[math.floor(256 * x) for x in e] for e in v]
    expected = []
    for i in range(len(q)):
        best = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in range(len(q)) if j != i)[:5]
        expected += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted(map(tuple, bitslice.top_k(bitslice.build_index(rows, 16), rows, 5).collect())) == expected


def test_scores_beyond_a_long_are_errors(spark):
    rows = lambda x: bitslice.quantised(spark.createDataFrame([(1, [x]), (2, [x])], "id long, e array<double>"), 256, "id", "e")
    with pytest.raises(Exception, match="63 bits"):
        bitslice.top_k(bitslice.build_index(rows(1e8)), rows(1e8), 5).collect()
    with pytest.raises(Exception, match="63 bits"):
        rows(1e18).collect()
    bits = lambda n, width: np.array([[n >> k & 1] for k in range(width)], np.uint64)
    assert [bitslice.whole_numbers(bits(n, w))[0] for n, w in ((-5, 4), (5, 64), (-(1 << 63), 70), ((1 << 63) - 1, 70))] == [-5, 5, -(1 << 63), (1 << 63) - 1]


def test_mixture_has_a_place_for_every_label(spark, tmp_path):
    labels = [("en", "src0"), (None, "src0"), ("it", "src7"), ("en", None), ("fr", "elsewhere"), (None, None), ("it", "elsewhere")]
    rows = [(i, "a b c", *x, 5) for i, x in enumerate(labels)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs, queries.MIX, queries.mix_levels(), share=1.0, epochs=1, seed=7).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(7)) and all(r["full_epochs"] == 1 for r in got)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    taken = queries.op1_mix_sources(spark, str(tmp_path)).collect()
    assert 12 - len(rows) < sum(3 * r["full_epochs"] + r["last_tokens"] for r in taken) <= 12 and {r["doc_id"] for r in taken} > {0}


def test_missing_language_label_is_filled(spark):
    rows = [(i, "the and of with for that " * 5, "en" if i else None, "src0", 125) for i in range(4)]
    got = corpus_pipeline.language(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted((r["doc_id"], r["lang"]) for r in got) == [(i, "en") for i in range(4)]
