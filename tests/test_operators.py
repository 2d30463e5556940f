"""Operators against values worked out by hand and against plain Python."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.functions import text
from termloom.operators import candidates, chunkers, contexts, dictionary, graph, perplexity, rank, stats, vectors
from termloom.sources import provider, readers, sinks


def one(spark, value, **columns):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])
    return df.select(value).first()[0]


@pytest.mark.parametrize(
    "term, idf, speciality, kind",
    [("エンジン", 2.526, 0.219, "一般語"), ("クランクケース", 7.581, 0.658, "専門用語"), ("ガス燃料噴射弁", 9.115, 0.792, "専門用語"), ("こと", 0.105, 0.009, "一般語"), ("削減", 2.526, 0.219, "一般語"), ("IMO", 6.496, 0.564, "準専門用語"), ("アンモニアガス", 6.898, 0.599, "準専門用語"), ("100", 1.204, 0.105, "一般語"), ("混焼率", 8.079, 0.702, "専門用語")],
)
def test_general_idf(spark, term, idf, speciality, kind):
    r = stats.general_idf(spark.createDataFrame([(term,)], "term string")).first()
    assert (round(r["idf"], 3), round(r["speciality"], 3), r["class"]) == (idf, speciality, kind)


def test_perplexities(spark):
    assert round(one(spark, perplexity.perplexity(F.array(F.lit(-2.3), F.lit(-0.5), F.lit(-0.1)))), 3) == 2.629
    assert round(one(spark, perplexity.perplexity(F.array(F.lit(-2.5)))), 2) == 12.18
    assert round(one(spark, stats.priority_score(F.lit(3.76), F.lit(29.4), F.lit(0.09))), 3) == 31.544
    assert one(spark, perplexity.chunk_perplexity(F.lit("score: 101"))) == 5.0
    assert one(spark, perplexity.chunk_perplexity(F.lit("none"))) == 50.0
    assert one(spark, perplexity.token_probability(F.lit(0.5), F.lit(None).cast("double"), F.lit(0.5))) == pytest.approx(0.4)
    assert one(spark, perplexity.weighted(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0))) == 80.0
    assert one(spark, perplexity.consistency(F.lit("abcd"), F.array(F.lit("不明"), F.lit("不明")))) == 40 + 30 - 10
    assert one(spark, perplexity.robust_median(F.array(*map(F.lit, [1.0, 10.0, 20.0, 100.0])))) == 15.0
    assert one(spark, perplexity.split_points(F.lit("abcdefg"))) == [2, 3, 4]
    assert one(spark, perplexity.kept_verdict(F.lit("YES | d"), F.lit(0.1), F.lit(None).cast("string"))) is True
    assert one(spark, perplexity.kept_verdict(F.lit(None).cast("string"), F.lit(0.4), F.lit("content_filter"))) is False


def test_masked_and_term_tokens(spark):
    tokens = F.array(F.struct(F.lit("foo").alias("token"), F.lit(-1.0).alias("logprob"), F.array(F.struct(F.lit("x").alias("token"), F.lit(-2.0).alias("logprob")), F.struct(F.lit("ammonia").alias("token"), F.lit(-0.5).alias("logprob"))).alias("top")))
    found = perplexity.masked(tokens, F.lit("z"), F.lit("ammonia"))
    assert one(spark, found["rank"]) == 2 and one(spark, found["perplexity"]) == pytest.approx(math.exp(0.5))
    none = perplexity.masked(tokens, F.lit("z"), F.lit("q"))
    assert (one(spark, none["rank"]), one(spark, none["perplexity"])) == (11, 100.0)
    assert one(spark, perplexity.term_logprob(tokens, F.lit("zz"))) == -3.0


def test_occurrences(spark):
    assert one(spark, text.count_apart(F.col("s"), F.col("t")), s="aaaa", t="aa") == 2
    assert one(spark, F.size(text.places(F.col("s"), F.col("t"))), s="aaaa", t="aa") == 3
    assert one(spark, text.places_apart(F.col("s"), F.col("t")), s="xaaaxaa", t="aa") == [2, 6]
    assert one(spark, text.count_apart(F.col("s"), F.col("t")), s="abc", t="") == 0


@pytest.mark.parametrize("s, expected", [("アン\nモニア", "アンモニア"), ("6L28\nADF", "6L28ADF"), ("漢字\nかな", "漢字かな"), ("カナ\n漢", "カナ漢"), ("ab\ncd", "ab\ncd")])
def test_rejoin_broken(spark, s, expected):
    assert one(spark, text.rejoin_broken(F.lit(s))) == expected


def test_text_predicates(spark):
    assert one(spark, text.normalise(F.lit("Ａ　Ｂ\n c "))) == "A B c"
    assert one(spark, text.normalise_term(F.lit("ｶﾞｽ−１"))) == "ガス-1"
    assert one(spark, text.technical_term(F.lit("6L28"))) and not one(spark, text.technical_term(F.lit("ab")))
    assert one(spark, text.valid_compound(F.lit("混焼率"))) and not one(spark, text.valid_compound(F.lit("これ")))
    assert not one(spark, text.valid_term(F.lit("その他など"))) and one(spark, text.valid_term(F.lit("燃料")))
    assert one(spark, text.string_similarity(F.lit("abcd"), F.lit("bcde"))) == 0.75
    assert one(spark, text.domain_of(F.lit("燃料エンジン"))) == "engineering"
    assert one(spark, text.choice_perplexity(F.lit(" c."))) == 28.0
    assert one(spark, text.preview(F.lit("a" * 100))) == "a" * 77 + "..."


FREQ = "doc_id long, term string, frequency long"


def test_containment_scores(spark):
    terms = spark.createDataFrame([(1, "abc", 5), (1, "ab", 9), (1, "bb", 20), (1, "xabcx", 1), (2, "ab", 3)], FREQ)
    got = {(r["doc_id"], r["term"]): r["c_value"] for r in stats.c_value(terms, 1).collect()}
    assert got[1, "ab"] == pytest.approx(math.log2(3) * (9 - 3))
    assert got[1, "abc"] == pytest.approx(2 * (5 - 1))
    assert got[2, "ab"] == pytest.approx(math.log2(3) * 3)
    p = {(r["doc_id"], r["term"]): r["penalty"] for r in rank.substring_penalty(terms).collect()}
    assert (p[1, "ab"], p[1, "abc"], p[1, "bb"]) == (0.2, 0.4, 1.0)
    ghg = spark.createDataFrame([(1, "GHG", 42)], FREQ)
    assert stats.c_value(ghg, 1).first()["c_value"] == 84.0


def test_min_max_is_half_where_flat(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 3.0), (2, 1.0), (2, 3.0)], "k long, v double")
    assert sorted(r["o"] for r in stats.min_max(df, "v", "o", "k").collect()) == [0.0, 0.5, 0.5, 1.0]


def brute_priority(terms):
    order = sorted(terms, key=lambda t: (-len(t), t))
    factor, done = dict.fromkeys(order, 1.0), set()
    for i, long in enumerate(order):
        if long in done:
            continue
        for short in order[i + 1 :]:
            if short in long and short != long and terms[long] > 3 and terms[long] > 0.05 * terms[short]:
                factor[short] *= 0.5 if terms[long] > 0.2 * terms[short] else 0.7
                done.add(short)
    return factor


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.text("ab", min_size=1, max_size=5), st.integers(1, 60), min_size=1, max_size=12))
def test_compound_priority(terms):
    assert dict(zip(terms, rank._factors(list(terms), list(terms.values())))) == pytest.approx(brute_priority(terms))


@pytest.mark.parametrize("n", [1, 19, 20, 21, 120])
def test_cutoff_bounds(spark, n):
    rows = spark.createDataFrame([(1, f"t{i:03}", 1.0 / (i + 1)) for i in range(n)], "doc_id long, term string, score double")
    r = rank.elbow_cutoff(rows).first()
    assert r["cutoff"] == (n if n <= 20 else r["cutoff"]) and min(n, 20) <= r["cutoff"] <= 100


def test_cutoff_of_zeros(spark):
    rows = spark.createDataFrame([(1, f"t{i:03}", 0.0) for i in range(30)], "doc_id long, term string, score double")
    assert rank.elbow_cutoff(rows).first()["elbow"] == 20


def test_classes_at_their_bounds(spark):
    assert [one(spark, rank.three_way(F.lit(p))) for p in (29.9, 30.0, 70.0, 70.1)] == ["high", "medium", "medium", "low"]
    assert [one(spark, rank.by_steps(F.lit(p), 20.0, 50.0)) for p in (19.9, 20.0, 50.0)] == ["high_confidence", "medium_confidence", "low_confidence"]
    assert [one(spark, rank.inverted(F.lit(p))) for p in (25.1, 25.0, 15.0)] == ["high_confidence", "medium_confidence", "low_confidence"]


def test_dynamic_confidence(spark):
    few = spark.createDataFrame([("a", 50.0), ("b", 40.0), ("c", 10.0)], "term string, perplexity double")
    assert [r["confidence"] for r in rank.dynamic_confidence(few).orderBy("term").collect()] == ["high_confidence", "high_confidence", "low_confidence"]
    many = spark.createDataFrame([(str(i), float(i)) for i in range(1, 12)], "term string, perplexity double")
    got = {r["term"]: r["confidence"] for r in rank.dynamic_confidence(many).collect()}
    assert got["11"] == "high_confidence" and got["9"] == "medium_confidence" and got["8"] == "low_confidence"


def test_three_chunks_never_are_hotspots(spark):
    three = spark.createDataFrame([(1, 15.2), (1, 18.7), (1, 85.3)], "doc_id long, perplexity double")
    assert rank.hotspots(three, "doc_id").where("is_hotspot").count() == 0
    four = spark.createDataFrame([(1, 10.0)] * 4 + [(1, 90.0)], "doc_id long, perplexity double")
    assert rank.hotspots(four, "doc_id").where("is_hotspot").count() == 1


def test_ordered_set(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "o long, t string").withColumn("g", F.lit(1))
    assert [r["t"] for r in rank.first_of_equals(df, "t", "o", 2, "g").orderBy("o").collect()] == ["a", "b"]


@settings(max_examples=60, deadline=None)
@given(st.text("ab.\n ", max_size=120))
def test_cursor_chunks_cover_the_text(s):
    chunks = chunkers.char_windows(s, 20, 4, (".", "\n"))
    at = 0
    for c in chunks:
        found = s.find(c, max(0, at - 4))
        assert 0 <= found <= at
        at = max(at, found + len(c))
    assert at == len(s) and (bool(chunks) == bool(s))


def test_packers():
    assert chunkers.pack_sentences("", 10, 2) == []
    assert chunkers.pack_sentences("aaaa。bbbb。cccc。", 10, 3) == ["aaaa。bbbb。", "cccc。"]
    assert len(chunkers.paragraphs("あ。" * 30)) == 6
    assert chunkers.paragraphs(" a \n\nb\n\nc\n\nd\n\ne") == [" a ", "b", "c", "d", "e"]
    assert chunkers.char_windows("a" * 15 + ". " + "b" * 30, 20, 4, (". ",)) == ["a" * 15 + ". ", "aa. " + "b" * 16, "b" * 18]
    assert chunkers.pack_bytes("ああ。いい。う。", 14) == ["ああ。", "いい。", "う。。"] and chunkers.pack_bytes("ab", 5) == ["ab"]
    assert chunkers.recursive("aa bb cc", 4, 0, (" ", "")) == ["aa", "bb", "cc"]
    assert chunkers.recursive("a b c d", 3, 1, (" ", ""), keep_separator=False) == ["a b", "b c", "c d"]
    # a long part stands between packs and is split on its own
    assert chunkers.recursive("ab\n\ncdefgh ij\n\nk l", 5, 0, ("\n\n", " ", "")) == ["ab", "cde", "fgh", "ij", "k l"]
    assert all(len(c) <= 20 for c in chunkers.recursive("word " * 40, 20, 5))
    with pytest.raises(ValueError):
        chunkers.char_windows("abc", 10, 5)


def test_word_chunks_join_to_the_text(spark):
    docs = spark.createDataFrame([(1, " a b  c\nd e f g "), (2, ""), (3, None)], "doc_id long, text string")
    got = chunkers.word_blocks(docs, (3,)).orderBy("chunk_id").collect()
    assert " ".join(r["chunk"] for r in got) == "a b c d e f g" and {r["doc_id"] for r in got} == {1}
    assert chunkers.word_windows(docs, 4, 2).count() == 3


def test_runs_and_patterns(spark):
    rows = [(1, 0, "燃料", "N"), (1, 1, "噴射", "N"), (1, 2, "の", "P"), (1, 3, "弁", "N")]
    tagged = spark.createDataFrame(rows, "doc_id long, pos int, term string, tag string")
    assert sorted(r["words"] for r in candidates.runs(tagged, F.col("tag") == "N").collect()) == [["弁"], ["燃料", "噴射"]]
    got = {r["term"] for r in candidates.tag_patterns(tagged, [("N", "N"), ("N", "P", "N")], "P").collect()}
    assert got == {"燃料噴射", "噴射弁"}
    assert one(spark, candidates.may_join(F.lit("混焼"), F.lit("率"))) and not one(spark, candidates.may_join(F.lit("12"), F.lit("率")))


def test_contexts(spark):
    found = lambda s, *t, **k: contexts.occurrences(spark.createDataFrame([(1, s, list(t))], "doc_id long, text string, terms array<string>"), **k)
    assert [r[0] for r in found("0123456789xx0123456789", "xx", window=3).select(contexts.kwic()).collect()] == ["...789xx012..."]
    assert [r[0] for r in found("あ。い燃料う。え", "燃料").select(contexts.real_mask()).collect()] == ["い[MASK]う。"]
    assert [r["at"] for r in found("aaaa", "aa", overlapping=True).orderBy("ord").collect()] == [1, 2, 3]
    assert [(r["found"], r["left"]) for r in found("xAb ab", "aB", "", any_case=True).orderBy("ord").collect()] == [("Ab", "x"), ("ab", "xAb ")]
    assert found(None, "a").count() == 0
    assert one(spark, contexts.mask_quality(F.lit("[MASK]"))) == pytest.approx(0.5 * 0.7 * 0.6)
    terms = spark.createDataFrame([("燃料",), ("foo",)], "term string")
    assert contexts.template_masks(terms).count() == 8
    assert {r["term"] for r in contexts.domain_masks(terms).collect()} == {"燃料"}
    real = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z")], "term string, ord int, masked_text string")
    assert [r["masked_text"] for r in contexts.combine([(real, 2), (real, 2)], 5).orderBy("place").collect()] == ["x", "y"]
    assert contexts.quotas(5) == (2, 2, 1, 1)


def test_merge_terms_keeps_the_first_of_equals(spark):
    rows = spark.createDataFrame([("a", 1, 0.5, 0, "xx", ["c0"], "m0"), ("a", 2, 0.9, 1, "yy", ["c1"], "m1")], "term string, frequency long, score double, ord long, definition string, contexts array<string>, metadata string")
    r = dictionary.merge_terms(rows).first()
    assert (r["frequency"], r["score"], r["definition"], r["contexts"], r["metadata"]) == (3, 0.9, "xx", ["c0", "c1"], "m0")


def test_upsert_rules_and_repeats(spark):
    schema = "headword string, synonyms array<string>, definition string, category string, confidence double, source_docs array<string>, embedding array<float>, created_at timestamp, updated_at timestamp"
    stored = spark.createDataFrame([("a", ["x"], "old", "k", 0.9, ["1"], [1.0], None, None)], schema)
    new = spark.createDataFrame([("a", ["y", "x"], "", None, 0.5, ["2"], None, None, None), ("b", [], "d", None, 0.1, [], None, None, None)], schema)
    now = F.lit("2024-01-01").cast("timestamp")
    once = dictionary.upsert(stored, new, now)
    r = once.where("headword = 'a'").first()
    assert (r["synonyms"], r["definition"], r["category"], r["confidence"], r["source_docs"], r["embedding"]) == (["x", "y"], "old", "k", 0.9, ["1", "2"], [1.0])
    assert sorted(map(tuple, dictionary.upsert(once, new, now).drop("created_at").collect()), key=str) == sorted(map(tuple, once.drop("created_at").collect()), key=str)
    found = dictionary.search(once.withColumn("headword", F.concat("headword", F.lit("%q"))), "A%Q")
    assert found.count() == 1 and dictionary.search(once, "y").first()["headword"] == "a"


def test_pagerank_of_one_graph():
    p = np.full(4, 0.25)
    r = graph.power_iteration(4, np.array([0, 1]), np.array([1, 2]), np.ones(2), p, 0.85, 1e-10, 200)
    assert r.sum() == pytest.approx(1) and r[1] > r[0] == pytest.approx(r[2]) and r[3] < r[0]


def test_pagerank_ways_agree(spark):
    nodes = spark.createDataFrame([(1, i, 1.0 + i) for i in range(6)], "doc_id long, id long, base_score double")
    nodes = graph.personalisation(nodes, 0.7, "doc_id")
    edges = spark.createDataFrame([(1, 0, 1, 0.5), (1, 1, 2, 0.9), (1, 0, 3, 0.4)], "doc_id long, src long, dst long, weight double")
    a = {r["id"]: r["pagerank"] for r in graph.pagerank(nodes.select("doc_id", "id", "p"), edges, tol=1e-12, rounds=500).collect()}
    b = {r["id"]: r["pagerank"] for r in graph.pagerank_steps(nodes.select("id", "p"), edges, 40).collect()}
    assert a == pytest.approx(b, abs=1e-4) and sum(a.values()) == pytest.approx(1)
    zero = graph.personalisation(nodes.withColumn("base_score", F.lit(0.0)), 0.7, "doc_id")
    assert {round(r["p"], 6) for r in zero.collect()} == {round(1 / 6, 6)}


def test_knn_excludes_itself(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = {(r["src"], r["dst"]) for r in vectors.knn(rows, 12, 0.3).collect()}
    assert got == {(1, 2), (2, 1)}


def test_providers(spark):
    df = spark.createDataFrame([("a",), ("b",)], "term string")
    rows, new = provider.embed_cached(df, spark.createDataFrame([], "key string, embedding array<double>"), provider.Stub(8))
    assert {len(r["embedding"]) for r in rows.collect()} == {8} and new.count() == 2
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert provider.with_retry(flaky, sleep=lambda s: None) == "ok"


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("日本".encode("shift-jis"))
    (tmp_path / "b.html").write_text("<p>x<script>no</script></p><p> y </p>")
    (tmp_path / "c.md").write_text("# T\n\n* a **b**\n\n```py\nz = 1\n```\n")
    (tmp_path / "d.bin").write_bytes(b"\0")
    (tmp_path / "e.docx").write_bytes(b"broken")
    got = {r["file_name"]: r for r in readers.read_directory(spark, str(tmp_path)).collect()}
    assert got["a.txt"]["text"] == "日本" and got["b.html"]["text"] == "x\ny" and got["c.md"]["text"] == "T\na b\nz = 1"
    assert "d.bin" not in got and got["e.docx"]["text"] is None and got["e.docx"]["error"]
    counts = readers.preprocess_counts(readers.preprocess(readers.read_directory(spark, str(tmp_path)))).first()
    assert (counts["processed"], counts["failed"], counts["skipped"]) == (3, 1, 0)


def test_terms_files(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"metadata": {}, "results": [{"file_path": "f", "terms": [{"term": "a", "definition": "d", "score": 0.5}]}]}')
    (tmp_path / "u.json").write_text('{"results": [')
    rows = readers.read_terms(spark, str(tmp_path))
    assert [(r["term"], r["frequency"], r["contexts"]) for r in rows.collect()] == [("a", 1, [])]
    sinks.save(rows, str(tmp_path / "out"), "csv")
    assert spark.read.csv(str(tmp_path / "out"), header=True).first()["score"] == "0.500"
    with pytest.raises(ValueError):
        sinks.save(rows, str(tmp_path / "x"), "xml")
