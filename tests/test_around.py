"""What stands around a document's terms, worked out where the document is, against the columns and against plain Python."""

import math
import random
import re

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from termloom.config import JAPANESE, LATIN
from termloom.functions import fixed, text
from termloom.operators import around, candidates, contexts, parts, passes, stats
from termloom.sources import provider

SIGNS = ["ab", "abab", "Ab1", "é", "カタ", "漢字", "ひら", ".", "。", " ", "  ", "\n", chr(0x3000), chr(0x2028), chr(0x1c), "-", "[MASK]", "a", "[MASK", "😀"]


def made(spark, n=60, seed=5):
    rand = random.Random(seed)
    texts = ["".join(rand.choice(SIGNS) for _ in range(rand.randint(0, 120))) for _ in range(n)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(n, None), (n + 1, ""), (n + 2, "ab"), (None, "ab ab ab")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def targets(docs):
    return candidates.term_counts(docs).where("frequency >= 2 and doc_id is not null")


def listed(docs):
    return docs.join(targets(docs).groupBy("doc_id").agg(F.collect_list("term").alias("terms")), "doc_id").select("doc_id", "text", "terms")


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_kinds_and_blanks_are_those_of_the_patterns():
    kinds = fixed.CONTEXT_RUNS.split("|")
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x11000)]):
        k = around._KIND[min(ord(c), 0x9FA6)]
        assert k == next((i for i, p in enumerate(kinds, 1) if re.fullmatch(p, c)), 0), c
    assert len(around.BLANKS) == 25


def test_context_words_meet_in_one_task(spark):
    docs = made(spark)
    found = around.context_words(docs, 2)
    assert shuffles(found) == 1  # the texts alone: neither terms nor words are dealt out
    assert rows_of(found) == rows_of(stats.term_contexts(docs, targets(docs)))


def test_masks_of_all_places_meet_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(around, "BLOCK", 7)
    docs = made(spark)
    for window in (50, 4):
        found = around.real_masks(docs, 2, window, ".")
        assert shuffles(found) == 1
        old = contexts.occurrences(listed(docs), window).select("doc_id", "term", "ord", contexts.real_mask(".").alias("masked_text"))
        assert rows_of(found.withColumn("quality", F.round("quality", 9))) == rows_of(old.withColumn("quality", F.round(contexts.mask_quality(F.col("masked_text")), 9)))


def test_weights_and_containers_meet_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(around, "LOOKED_AT", 5)
    docs = made(spark, seed=6)
    found = around.weighed_terms(docs, 2)
    assert shuffles(found) == 1
    terms = targets(docs)
    old = candidates.with_containers(terms).join(stats.mean_weights(stats.term_contexts(docs, terms)), ["doc_id", "term"], "left")
    r = lambda df: sorted(map(str, df.select("doc_id", "term", "frequency", "__mean", "__most", F.round("weight", 9)).collect()))
    assert r(found) == r(old)


def test_places_that_overlap_are_left_out():
    for s, terms in (("aaaaa", ["aa", "a", "aaa"]), ("ababababab", ["abab", "ba", ""]), ("x", ["y"])):
        got = [(terms[t], int(a), int(k)) for _, ts, at, ord_ in around.places([s, None, ""], terms) for t, a, k in zip(ts, at, ord_)]
        assert sorted(got) == sorted((t, a, k) for t in terms for k, (a, _) in enumerate(text.spans(s, t)))


def test_contexts_of_a_quota(spark):
    docs = made(spark, seed=7)
    old = contexts.occurrences(listed(docs), 3, 2).select("doc_id", "term", "ord", contexts.plain_context().alias("context"))
    assert rows_of(around.plain_contexts(docs, 2, 3, 2)) == rows_of(old)
    rows = spark.createDataFrame([("t", 0, k, m) for k, m in enumerate("aabc")] + [("t", 1, 1, "a"), ("u", 1, 1, "z")], "term string, source int, ord int, masked_text string")
    found = contexts.combined(rows, [3, 1], 3)
    assert shuffles(found) == 1  # once by term, not for each step
    assert rows_of(found) == [("t", 1, "a"), ("t", 2, "b"), ("u", 1, "z")]


PATTERNS = [("noun", "noun"), ("noun", "noun", "noun"), ("noun", "suffix"), ("noun", "particle", "noun")]
PIECES = ["カタカナ", "漢字", "機", "の", "ひらが", "性", "化", "的", "7", "12", "AB", "Ab", "x1", "-", " ", "。", "とは", "é", "概要", "９"]


def pieces(spark, seed):
    rand = random.Random(seed)
    texts = ["".join(rand.choice(PIECES) for _ in range(rand.randint(0, 60))) for _ in range(50)]
    return spark.createDataFrame([*enumerate(texts), (90, None), (91, ""), (92, "機")], "doc_id long, text string").repartition(3)


def test_patterns_of_tags_are_found_without_windows(spark):
    docs = pieces(spark, 8)
    found = candidates.document_patterns(docs, PATTERNS, "particle", "A", JAPANESE)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert shuffles(found) == 1 and "Window" not in plan
    assert rows_of(found) == rows_of(candidates.tag_patterns(candidates.tagged(docs, "A", JAPANESE), PATTERNS, "particle"))


def test_joined_runs_are_cut_without_windows(spark):
    docs = pieces(spark, 9)
    found = candidates.joined_runs(docs, "particle", "A", JAPANESE)
    assert shuffles(found) == 1 and "Window" not in found._jdf.queryExecution().executedPlan().toString()
    before = F.lag("term").over(Window.partitionBy("doc_id").orderBy("pos"))
    kept = candidates.tagged(docs, "A", JAPANESE).where("tag <> 'particle'").withColumn("fresh", ~F.coalesce(candidates.may_join(before, F.col("term")), F.lit(True)))
    old = candidates.runs(kept, F.lit(True), new_run=F.col("fresh")).select("doc_id", F.array_join("words", "").alias("term"))
    assert rows_of(found) == rows_of(old.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n")))


def test_generic_candidates_are_counted_without_windows(spark):
    docs = pieces(spark, 10)
    for profile in (JAPANESE, LATIN):
        found = candidates.generic_candidates(docs, PATTERNS, "particle", profile)
        assert shuffles(found) == 1 and "Window" not in found._jdf.queryExecution().executedPlan().toString()
        short, modes = candidates.tagged(docs, "A", profile), candidates.multi_mode_nouns(docs, profile)
        compound = candidates.tag_patterns(short, PATTERNS, "particle").unionAll(candidates.noun_sequences(candidates.noun_runs(short, profile), profile.joiner))
        every = modes.select("doc_id", "term").unionAll(compound).distinct().where(text.basic_filter(F.col("term")))
        old = candidates.boundary_frequency(short, every).join(modes, ["doc_id", "term"], "left").select("doc_id", "term", F.coalesce("modes", F.lit(0)), "frequency")
        assert rows_of(found) == rows_of(old)
    terms = found.withColumn("frequency", F.col("frequency"))
    weights = {(r["doc_id"], r["term"]): r["weight"] for r in stats.context_weights(docs, terms).collect()}
    own = around.weighed(docs, terms).collect()
    assert len(own) == len(weights) and all(r["weight"] == weights[r["doc_id"], r["term"]] or abs(r["weight"] - weights[r["doc_id"], r["term"]]) < 1e-9 for r in own)


def test_meaningful_terms_are_left_where_the_text_is(spark):
    docs = pieces(spark, 11)
    ends = fixed.MEANINGFUL_PARTS[:4]
    made_of = lambda s: F.flatten(F.transform(F.regexp_extract_all(s, F.lit("[ァ-ヴー一-龥A-Z]+"), F.lit(0)), lambda w: F.array(w, *[x for e in ends for x in (F.concat(w, F.lit(e)), F.lit(e))])))
    found = candidates.meaningful_terms(docs, made_of(F.col("text")))
    assert shuffles(found) == 1  # the texts: terms were dealt out twice, and their pairs
    terms = docs.select("doc_id", F.explode(made_of(F.col("text"))).alias("term")).distinct().withColumn("frequency", F.lit(1).cast("long"))
    assert rows_of(found) == rows_of(candidates.prune_parts(terms).select("doc_id", "term")) and found.count()


def test_parts_meet_by_equality(spark, monkeypatch):
    """Terms that share their grams aren't compared with each other; long containers go by grams, with the same result."""
    rand = random.Random(12)
    words = {"".join(rand.choice("abé漢") for _ in range(rand.randint(1, 9))) for _ in range(300)} | {"", "😀a", "b😀a", "ab" * 30}
    df = spark.createDataFrame([(w, i + 1) for i, w in enumerate(sorted(words))] + [(None, 5)], "term string, frequency long")
    by = {r["term"]: r["frequency"] for r in df.collect()}
    pairs = sorted((t, c, by[c]) for t in words for c in words if len(t) >= 2 and t != c and t in c)
    usual_only = df.where("term is null or length(term) <= 40")
    plan = parts.containment(usual_only)._jdf.queryExecution().executedPlan().toString()
    assert "Contains(" not in plan and "gram" not in plan
    for usual in (40, 5, 0):
        assert rows_of(parts.containment(df, usual=usual)) == pairs
        monkeypatch.setattr(parts, "USUAL", usual)
        got = {r["term"]: (r["containers"], round(r["c_value"], 9)) for r in parts.c_value(df).collect()}
        for t in words:
            held = [n for p, _, n in pairs if p == t]
            value = max(0.0, math.log2(len(t) + 1) * (by[t] - (sum(held) / len(held) if held else 0.0)))
            assert got[t] == (len(held), round(value, 9))


def test_sentences_of_terms_meet_in_one_task(spark):
    docs = spark.createDataFrame([(1, "the station is old. the house is new! the station and the house\nshort"), (2, None), (3, ""), (None, "the station is old.")], "doc_id long, text string")
    terms = spark.createDataFrame([(1, "station"), (1, "house"), (1, "none"), (2, "a"), (3, "b"), (None, "station")], "doc_id long, term string")
    found = passes.held_sentences(docs, terms, ".!?\n", 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert shuffles(found) == 1 and "Join" not in plan  # no text is copied to each of its terms
    old = docs.select("doc_id", text.sentences_of(F.col("text"), ".!?\n").alias("all")).join(terms, "doc_id")
    old = old.select("doc_id", "term", F.slice(F.filter("all", lambda x: F.contains(x, F.col("term"))), 1, 2).alias("sentences"))
    assert rows_of(found) == rows_of(old.where(F.size("sentences") > 0))


def test_a_table_is_given_for_many_calls(spark):
    asked = []

    def call(prompts):
        asked.append(len(prompts))
        return [p.upper() for p in prompts]

    frames = []

    class Rows:
        columns, sparkSession, dtypes = ["p"], spark, [("p", "string")]

        def mapInPandas(self, run, schema):
            frames.extend(run(iter([pd.DataFrame({"p": [f"a{i}" for i in range(23)]})])))

    provider._mapped(Rows(), "p", "reply", "string", call, 5)
    assert asked == [5, 5, 5, 5, 3]  # calls are as they were
    assert len(frames) == 1 and frames[0]["reply"].tolist() == [f"A{i}" for i in range(23)]
