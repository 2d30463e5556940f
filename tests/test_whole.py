"""Queries take all of their input: no document or term is left out beforehand."""

from collections import Counter

from termloom.plans.catalog import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, path, *texts):
    rows = [(i, s, "en", "src0", len(s)) for i, s in texts]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_dictionary_of_odd_and_even_documents(spark, tmp_path):
    d = documents(spark, tmp_path, (1, "station " * 3), (2, "nation " * 3))
    assert {r["headword"] for r in QUERIES["dictionary_search"](spark, d).collect()} == {"station", "nation"}
    assert QUERIES["dictionary_stats"](spark, d).first()["terms"] == 2


TEXT = "alpha beta gamma delta omega alpha beta gamma delta. sub subalpha sub once"


def test_every_repeated_term_has_contexts_masks_and_neighbours(spark, tmp_path):
    d = documents(spark, tmp_path, (1, TEXT))
    kwic, masks, near = (QUERIES[n](spark, d).collect() for n in ("kwic", "mask_real", "cooccur_words"))
    many = {"alpha", "beta", "gamma", "delta", "sub"}
    assert {r["term"] for r in kwic} == {r["term"] for r in masks} == {r["term"] for r in near} == many
    assert sum(r["term"] == "alpha" for r in kwic) == 3 and max(r["rank"] for r in near) == 3
    words, n = TEXT.split(), Counter()
    for i, at in enumerate(words):
        for k in set(range(max(0, i - 5), min(len(words), i + 6))) - {i}:
            n.update((t, "before" if k < i else "after", words[k]) for t in many if t in at)
    assert all(r["n"] == n[r["term"], r["side"], r["word"]] for r in near)
    assert {(r["term"], r["side"]): r["word"] for r in near if r["rank"] == 1} == {g: min((-n[x], x[2]) for x in n if x[:2] == g)[1] for g in {x[:2] for x in n}}


def test_every_term_of_a_turn_is_in_context(spark, tmp_path):
    spark.createDataFrame([("c", 0, "user", "station of Stations")], "conv_id string, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert {(r["term"], r["n"]) for r in QUERIES["kwic_turns"](spark, str(tmp_path)).collect()} == {("station", 1), ("of", 1), ("Stations", 1)}
