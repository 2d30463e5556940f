"""The driver's contract, the streaming sink, and the plans of hot paths."""

import os
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from termloom.operators import candidates, dictionary, graph, rank, stats, vectors
from termloom.plans import extract
from termloom.plans.catalog import ORACLE, QUERIES
from termloom.sources import provider
from termloom.streaming import ingest

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
#: Queries that Python decides: tested against plain Python elsewhere.
NO_TWIN = {
    "byte_chunks", "compound_priority", "compound_terms", "document_pagerank", "evaluation_files", "generic_perplexities", "generic_terms", "graph_terms", "input_perplexities", "packed_chunks", "paragraph_chunks", "precise_probabilities",
    "indexed_neighbours", "learnt_lexicon", "pagerank_converged", "segmented_compounds", "segmented_nouns", "segmented_subtypes", "segmented_tokens",
    "recursive_chunks", "sentence_perplexities", "separator_chunks", "string_similarities", "template_perplexities", "term_perplexities",
}


#: Twins that take seconds even on the smallest tables, or whose rules others test.
SLOW = {"cvalue_v2", "cvalue_v3", "pagerank_steps", "fuse_scores", "reweighted_edges", "similar_contexts", "generic_score", "statistical_masks", "context_words", "excluded_file", "stats_file", "review_candidates", "run_statistics", "term_statistics", "elbow_cutoff", "minmax_blend"}


def test_twins_belong_to_queries():
    assert set(QUERIES) - set(ORACLE) == NO_TWIN and set(ORACLE) <= set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_library_stands_without_the_subpackage(tmp_path):
    root = Path(entry.__file__).parent
    (tmp_path / "__spark_entry__.py").symlink_to(root / "__spark_entry__.py")
    (tmp_path / "termloom").mkdir()
    for p in (root / "termloom").iterdir():
        if p.name != "llm":
            (tmp_path / "termloom" / p.name).symlink_to(p)
    code = "import sys; sys.path.insert(0, '.'); import importlib.util as u; s = u.spec_from_file_location('e', '__spark_entry__.py'); m = u.module_from_spec(s); s.loader.exec_module(m); print(len(m.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert out.stdout.strip() == str(len(QUERIES)), out.stderr


def rounded(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@needs_data
@pytest.mark.parametrize("name", sorted(set(ORACLE) - SLOW))
def test_queries_equal_their_twins(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "pages", "conversations", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    twin = con.sql(ORACLE[name])
    columns = sorted(twin.columns)
    ours = QUERIES[name](spark, SMALL)
    assert sorted(ours.columns) == columns
    assert rounded(map(tuple, ours.select(*columns).collect())) == rounded(con.sql(f"SELECT {', '.join(columns)} FROM twin").fetchall())


@needs_data
def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_containment_meets_in_documents(spark):
    terms = spark.createDataFrame([(1, "abc", 2), (1, "ab", 2)], "doc_id long, term string, frequency long")
    for df in (candidates.containment(terms), stats.c_value(terms)):
        assert "Cartesian" not in plan(df) and "NestedLoop" not in plan(df) and plan(df).count("Exchange") == 1


def test_a_very_long_token(spark):
    """Work follows the letters of terms: a hundred thousand of them in one are nothing special."""
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(100_000))
    terms = spark.createDataFrame([(1, long, 3), (1, long[5000:5009], 4), (1, "zzzzzzzz", 1)], "doc_id long, term string, frequency long")
    began = time.perf_counter()
    got = {r["term"]: r for r in rank.substring_penalty(stats.c_value(terms)).collect()}
    assert time.perf_counter() - began < 30
    assert got[long[5000:5009]]["penalty"] == 0.2 and got["zzzzzzzz"]["penalty"] == 1.0


def test_nearest_of_a_key_meet_there_alone(spark):
    rows = [(k, 10 * k + i, [1.0, i / 10, float(k)]) for k in range(3) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, vec_id long, embedding array<double>")
    near = vectors.knn_within(df, "doc_id", k=2)
    assert all(r["src"] // 10 == r["dst"] // 10 for r in near.collect()) and near.count() == 30
    assert plan(vectors.knn_within(df, "doc_id", k=2)).count("Exchange") == 1
    own = {(r["src"], r["dst"]) for k in range(3) for r in vectors.knn(df.where(f"doc_id = {k}"), k=2).collect()}
    assert {(r["src"], r["dst"]) for r in near.collect()} == own
    asked = vectors.knn(df, k=3, asked=df.where("vec_id = 11")).collect()
    assert {r["src"] for r in asked} == {11} and len(asked) == 3


def test_whole_tables_are_scaled_by_one_row(spark):
    nodes = spark.createDataFrame([(1, 1.0), (2, 4.0)], "id long, base_score double")
    assert "SinglePartition" not in plan(graph.personalisation(nodes)).split("Aggregate")[0]
    assert [round(r["o"], 6) for r in stats.min_max(nodes, "base_score", "o").orderBy("id").collect()] == [0.0, 1.0]


@needs_data
def test_scans_read_only_their_columns(spark):
    text = plan(QUERIES["term_frequency"](spark, SMALL))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_ranks_in_one_task_equal_the_joined_ones(spark):
    """Neighbours, sentences and PageRank of a document made where it is, against the operators in a row."""
    import random

    from pyspark.sql import functions as F

    from termloom.operators import chunkers, graph, stats, vectors

    rng = random.Random(2)
    words = ["net", "work", "network", "data", "base", "set", "x"]
    texts = [". ".join(" ".join(rng.choices(words, k=rng.randint(0, 5))) for _ in range(9)) for _ in range(4)]
    docs = spark.createDataFrame([*enumerate(texts), (1, "data base. net"), (5, None), (6, "x. y")], "doc_id long, text string")
    rows = [(d, 10 * d + i, w, float(i * (d != 3)), None if (d, i) == (2, 3) else [rng.random() - 0.3 for _ in range(5)]) for d in (0, 1, 2, 3, 5) for i, w in enumerate(words)]
    kept = spark.createDataFrame(rows, "doc_id long, id long, term string, base_score double, embedding array<double>")
    got = {r["id"]: r["pagerank"] for r in graph.document_ranks(kept, docs, chunkers.sentences(F.col("text"), ".")).collect()}
    edges = graph.undirected(vectors.knn_within(kept, "doc_id", id_col="id"))
    sentences = docs.select("doc_id", F.posexplode(chunkers.sentences(F.col("text"), ".")).alias("chunk_id", "chunk"))
    held = stats.substring_counts(sentences, kept.select("doc_id", "term")).join(kept, ["doc_id", "term"])
    together = graph.sentence_pairs(held.select("doc_id", F.col("chunk_id").alias("sentence"), F.col("id").alias("term")), "doc_id")
    edges = graph.reweight(edges, together).join(kept.select(F.col("id").alias("src"), "doc_id"), "src")
    want = {r["id"]: r["pagerank"] for r in graph.pagerank(graph.personalisation(kept, 0.7, "doc_id").select("doc_id", "id", "p"), edges).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_candidates_are_scored_where_they_are_found(spark):
    """One task of a document gives what the operators in a row give, and a small table keeps the session's tasks."""
    from termloom.functions import text
    from termloom.operators import chunkers

    texts = ["日本語の解析データ。解析データはデータの解析" * 9, None, "", "alpha beta-2 alpha ことデータこと IT2 ガソリンもの解析など. alpha beta", "x", "a b. " * 300]
    docs = spark.createDataFrame([*enumerate(texts), (None, "データ解析 alpha")], "doc_id long, text string")
    cut = lambda s: chunkers.paragraphs(s, 50, ".")
    counts = candidates.statistical_candidates(docs)
    want = stats.substring_tfidf(stats.c_value(counts), docs.where("doc_id IS NOT NULL"), cut).where("doc_id IS NOT NULL")
    flat = lambda df: sorted(map(str, df.select("doc_id", "term", "frequency", "c_value", "tfidf").collect()))
    found = stats.candidate_scores(docs, cut)
    assert flat(found.where("doc_id IS NOT NULL")) == flat(want) and found.where("doc_id IS NULL").count()
    valid = counts.where(~text.valid_term(F.col("term")) & ~F.col("term").rlike("^[A-Za-z0-9-]+$"))
    assert counts.rdd.getNumPartitions() == 4 and not valid.count()


def test_nouns_are_found_where_the_text_is(spark):
    """Singles, nouns of all modes and sequences of one task are those of the tables of tokens; texts are read once."""
    from termloom.config import JAPANESE

    texts = ["日本語の解析データ。解析データはデータの解析こと", None, "", "alpha beta-2 IT2 ガソリン解析など ABC 12 日本データ解析", "漢", "データ解析性日本 データこと解析"]
    docs = spark.createDataFrame([*enumerate(texts), (None, "データ解析 alpha")], "doc_id long, text string")
    want = set()
    for kind, rows in (("single", candidates.single_nouns(candidates.tagged(docs, "A", JAPANESE)).withColumn("n", F.lit(1))), ("modes", candidates.multi_mode_nouns(docs, JAPANESE).withColumnRenamed("modes", "n")), ("sequence", candidates.noun_sequences(candidates.document_noun_runs(docs, "A", JAPANESE)).withColumn("n", F.lit(1)))):
        want |= {(r["doc_id"], kind, r["term"], r["n"]) for r in rows.collect()}
    got = [tuple(r) for r in candidates.document_nouns(docs, JAPANESE).collect()]
    assert set(got) == want and len(got) == len(want) and {k for _, k, _, _ in got} == {"single", "modes", "sequence"}
    assert plan(QUERIES["noun_candidates"](spark, SMALL)).count("Scan parquet") <= 2


def test_graph_terms(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma alpha beta. gamma alpha delta beta delta. " * 5)], "doc_id long, text string")
    got = extract.graph_terms(docs, provider.Stub(16)).collect()
    assert {"alpha", "beta", "gamma", "delta", "alpha beta"} <= {r["term"] for r in got} and all(0 <= r["score"] <= 1 for r in got)
    assert 0.5 < sum(r["pagerank"] for r in got) <= 1 + 1e-9


def test_ingest_upserts_each_batch(spark, tmp_path):
    def terms(batch):
        counts = candidates.term_counts(batch).withColumn("score", F.col("frequency").cast("double"))
        return extract.dictionary_rows(counts)

    docs = tmp_path / "docs"
    for k, s in enumerate(("alpha beta", "beta gamma")):
        spark.createDataFrame([(k, s, "en", "s", len(s))], ingest.DOCUMENTS).write.mode("append").parquet(str(docs))
        q = ingest.ingest(spark, str(docs), str(tmp_path / "store"), str(tmp_path / "check"), terms)
        q.awaitTermination()
    got = {r["headword"]: r["source_docs"] for r in spark.read.parquet(str(tmp_path / "store/snapshot=1")).collect()}
    assert got == {"alpha": ["0"], "beta": ["0", "1"], "gamma": ["1"]}
    assert dictionary.search(spark.read.parquet(str(tmp_path / "store/snapshot=1")), "BET").first()["headword"] == "beta"
