"""Segmentation by a lexicon, parts of the whole vocabulary, the index of vectors, PageRank and the dictionary's log."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.operators import dictionary, dictionary_index, dictionary_log, graph, parts, segment, stats, vector_index, vectors

COSTS = {"a": 5, "b": 7, "ab": 9, "ba": 12, "aba": 14, "bab": 13, "abab": 20, "c": 50}


def paths(run, costs):
    """Every way through the lattice, with its cost."""
    if not run:
        yield 0, []
    for k in range(1, len(run) + 1):
        cost = costs.get(run[:k], segment.UNKNOWN_COST if k == 1 else None)
        if k == 1 and cost is not None:
            cost = min(cost, segment.UNKNOWN_COST)
        if cost is not None:
            for rest, words in paths(run[k:], costs):
                yield cost + rest, [run[:k], *words]


def best(run, costs):
    """The cheapest; of equal ones that with the longest last word, and so on backwards."""
    return min(paths(run, costs), key=lambda p: (p[0], [-len(w) for w in reversed(p[1])]))[1]


@settings(max_examples=150, deadline=None)
@given(st.text("abcx", max_size=9), st.sets(st.sampled_from(sorted(COSTS)), max_size=8))
def test_the_cheapest_path_is_found(run, words):
    costs = {w: COSTS[w] for w in words}
    assert segment.Segmenter(segment.Lexicon(costs, {})).path(run) == best(run, costs)


def test_modes_cut_ever_finer(spark):
    costs = {"データ": 4000, "ベース": 4500, "データベース": 7000, "管理": 4000, "データベース管理": 9500, "システム": 4000, "を": 3000}
    kinds = {w: ("noun", "common") for w in costs} | {"を": ("particle", "case")}
    entries = spark.createDataFrame([(w, c, *kinds[w]) for w, c in costs.items()], "word string, cost int, tag string, subtype string")
    docs = spark.createDataFrame([(1, "データベース管理システムをIT-2で。"), (2, None), (3, ""), (4, " 、。")], "doc_id long, text string")
    rows = segment.segmented(docs, segment.lexicon(entries)).orderBy("mode", "pos").collect()
    by = {m: [(r["term"], r["tag"], r["subtype"]) for r in rows if r["mode"] == m] for m in "ABC"}
    assert [t for t, _, _ in by["C"]] == ["データベース管理", "システム", "を", "IT-2", "で"]
    assert [t for t, _, _ in by["B"]][:3] == ["データベース", "管理", "システム"] and [t for t, _, _ in by["A"]][:4] == ["データ", "ベース", "管理", "システム"]
    assert by["C"][2] == ("を", "particle", "case") and by["C"][3] == ("IT-2", "noun", "unknown")
    assert {r["doc_id"] for r in rows} == {1}
    # a mark or a change of what is cut leaves a position out, and so ends a run of nouns
    pos = [r["pos"] for r in rows if r["mode"] == "C"]
    assert pos == [0, 1, 2, 4, 6]
    nouns = {(r["term"], r["modes"]) for r in segment.multi_mode_nouns(segment.segmented(docs, segment.lexicon(entries))).collect()}
    assert ("システム", 3) in nouns and ("データ", 1) in nouns and not any(t == "を" for t, _ in nouns)
    with pytest.raises(ValueError, match="at most"):
        segment.lexicon(entries, most=3)


def test_documents_are_segmented_where_they_are(spark, tmp_path):
    """Nouns, subtypes, n-grams and counts made inside a task are those of the table of tokens; a file of one part is dealt out."""
    from termloom.operators import candidates

    costs = {"データ": 4000, "ベース": 4500, "データベース": 7000, "管理": 4000, "データベース管理": 9500, "システム": 4000, "を": 3000, "AB": 9000}
    kinds = {w: ("noun", "common") for w in costs} | {"を": ("particle", "case"), "管理": ("noun", "verbal"), "AB": (None, None)}
    words = segment.Lexicon(costs, kinds)
    texts = ["データベース管理システムをIT-2で。", None, "", "管理システム管理システム漢字AB 12 データ,データ管理", "システム" * 40, "データベース管理システム。データベース管理システム"]
    rows = [*enumerate(texts), (None, "管理システム"), (7, "を"), (8, "7 x-1")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    docs = segment.dealt(spark.read.parquet(f"{tmp_path}/docs"))
    assert docs.rdd.getNumPartitions() == 4
    flat = lambda df: sorted(map(str, df.collect()))
    tokens = lambda modes: segment.segmented(docs, words, modes)
    assert flat(segment.document_nouns(docs, words)) == flat(candidates.single_nouns(tokens("A")))
    assert flat(segment.document_subtypes(docs, words)) == flat(segment.multi_mode_nouns(tokens("ABC")))
    grams = candidates.noun_runs(tokens("C")).select("doc_id", F.explode(candidates.ngrams(F.col("words"), 2, 3)).alias("term"))
    assert flat(segment.document_compounds(docs, words)) == flat(grams.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("frequency")))
    counted = tokens("ABC").groupBy("mode", "term", "tag", "subtype").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))
    assert flat(segment.token_counts(docs, words)) == flat(counted)
    twice = docs.where("doc_id = 3").unionAll(docs.where("doc_id = 3"))
    assert flat(segment.document_nouns(segment.dealt(twice), words)) == flat(segment.document_nouns(segment.dealt(docs.where("doc_id = 3")), words))


@pytest.mark.parametrize("alphabet", ["abé", "".join(map(chr, range(0x4E00, 0x4E00 + 400))), "漢🎉a"])
def test_substrings_are_counted(alphabet):
    rng = random.Random(5)
    runs = ["".join(rng.choices(alphabet, k=rng.randint(0, 20))) for _ in range(80)] + [""]
    for longest in (1, 3, 8):
        got = Counter()
        for batch in segment.substrings(runs, longest):
            got.update(dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())))
        assert got == Counter(r[i : i + k] for r in runs for k in range(1, longest + 1) for i in range(len(r) - k + 1))


def learnt(texts, rounds, longest, least, most, whole):
    """The same lexicon in plain Python."""
    import re

    runs = [p for t in texts for p in re.findall(f"{whole}|[a-z]+", t or "") if not re.fullmatch(whole, p)]
    counts = Counter(r[i : i + k] for r in runs for k in range(1, longest + 1) for i in range(len(r) - k + 1))
    known = sorted(((w, n) for w, n in counts.items() if n >= least or len(w) == 1), key=lambda x: (-x[1] * len(x[0]), x[0]))[:most]
    for _ in range(rounds):
        total = sum(n for _, n in known)
        costs = {w: round(1000 * (math.log(total) - math.log(n))) for w, n in known}
        used = Counter()
        for r in runs:
            value, back = [0], [0]
            for e in range(1, len(r) + 1):
                ways = [(value[e - 1] + segment.UNKNOWN_COST, -1, False)] + [(value[e - k] + costs[r[e - k : e]], -k, True) for k in range(1, min(e, longest) + 1) if r[e - k : e] in costs]
                c, k, _ = min(ways, key=lambda w: (w[0], w[1], not w[2]))
                value.append(c)
                back.append(-k)
            e = len(r)
            while e:
                if r[e - back[e] : e] in costs:
                    used[r[e - back[e] : e]] += 1
                e -= back[e]
        known = [(w, used.get(w, 1)) for w, _ in known if w in used or len(w) == 1]
    total = sum(n for _, n in known)
    return {w: round(1000 * (math.log(total) - math.log(n))) for w, n in known}


def test_a_lexicon_is_learnt(spark, monkeypatch):
    monkeypatch.setattr(segment, "HELD_SEEDS", 50)
    rng = random.Random(3)
    words = ["net", "work", "data", "base", "network", "set"]
    texts = ["".join(rng.choices(words, k=rng.randint(1, 30))) + rng.choice([".", "7x", ""]) for _ in range(60)] + [None, "", "7"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["word"]: r["cost"] for r in segment.learn(docs, 2, 7, 3, 300, "[a-z]+", "[0-9]+").collect()}
    assert got == learnt(texts, 2, 7, 3, 300, "[0-9]+")
    assert {"network", "data", "set"} <= set(got)
    assert segment.learn(docs.limit(0), 1).count() == 0


def contained(rows, shortest=2):
    return {(a, b, n) for a, _ in rows for b, n in rows if len(a) >= shortest and a != b and a in b}


@pytest.mark.parametrize("meet", [1, 1 << 16])
def test_parts_of_a_vocabulary(spark, meet):
    rng = random.Random(9)
    words = {"".join(rng.choices("ab日", k=rng.randint(1, 9))) for _ in range(300)} | {"aaaa", "a" * 40, "x", "", "é", "aé", "a" * 3000 + "b" * 5}
    rows = [(w, rng.randint(1, 9)) for w in sorted(words)]
    df = spark.createDataFrame([*rows, (None, 3)], "term string, frequency long")
    for shortest in (1, 2, 4):
        got = [tuple(r) for r in parts.containment(df, shortest, meet=meet).collect()]
        assert len(got) == len(set(got)) and set(got) == {x for x in contained(rows, shortest) if x[0]}
    assert parts.containment(df.limit(0)).count() == 0


def test_corpus_c_values(spark):
    rows = [("net", 5), ("network", 3), ("networks", 2), ("work", 4), ("zz", 9)]
    df = spark.createDataFrame(rows, "term string, frequency long")
    got = {r["term"]: (r["containers"], round(r["c_value"], 9)) for r in parts.c_value(df).collect()}
    assert got["net"] == (2, round(math.log2(4) * (5 - 2.5), 9)) and got["networks"] == (0, round(math.log2(9) * 2, 9))
    one = stats.c_value(df.withColumn("doc_id", F.lit(1))).collect()
    assert {r["term"]: round(r["c_value"], 9) for r in one} == {t: v for t, (_, v) in got.items()}


@pytest.mark.parametrize("kind", ["uniform", "clusters"])
def test_index_finds_neighbours(spark, tmp_path, kind):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(4000, 16))
    if kind == "clusters":
        v = rng.normal(size=(30, 16))[rng.integers(0, 30, 4000)] + 0.3 * v
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(None, [1.0] * 16), (9000, None)], "vec_id long, embedding array<double>").cache()
    c = vector_index.build(df, str(tmp_path / "x"), lists=40)
    asked = df.where("vec_id % 20 = 0")
    exact = {(r["src"], r["dst"]) for r in vectors.knn(df.where("vec_id IS NOT NULL"), 10, -1.0, asked=asked).collect()}
    got = {(r["src"], r["dst"]) for r in vector_index.search(str(tmp_path / "x"), asked, 10).collect()}
    assert len(got) == len(exact) == 2000 and len(got & exact) >= 0.9 * len(exact) and c.take < 40
    whole = {(r["src"], r["dst"]) for r in vector_index.search(str(tmp_path / "x"), asked, 10, take=40, block=64).collect()}
    assert whole == exact
    # files of other lists aren't read
    one = vector_index.search(str(tmp_path / "x"), df.where("vec_id = 20"), 5, take=1)
    assert "PartitionFilters: [" in one._jdf.queryExecution().toString() and one.count() == 5


def _shuffled(spark):
    """Bytes that the session's stages have written to shuffles so far."""
    sc, gateway = spark.sparkContext, spark.sparkContext._gateway
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_rows_travel_once_for_a_group_of_lists(spark, tmp_path):
    """A search that takes eight times the lists shuffles no more, and finds the same."""
    rng = np.random.default_rng(10)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(4000, 32)))], "vec_id long, embedding array<double>").cache()
    exact = {(r["src"], r["dst"]) for r in vectors.knn(df, 4, -1.0).collect()}
    moved = []
    for lists in (10, 80):
        path = str(tmp_path / f"x{lists}")
        vector_index.build(df, path, lists=lists)
        before = _shuffled(spark)
        got = {(r["src"], r["dst"]) for r in vector_index.search(path, df, 4, take=lists).collect()}
        moved.append(_shuffled(spark) - before)
        assert got == exact
    assert 0 < moved[1] < 1.5 * moved[0]


@pytest.mark.parametrize("block", [None, 50])
def test_index_searches_odd_rows(spark, tmp_path, block):
    """Lists that one group can't hold, equal vectors, rows without a direction, ids that are asked for and not there."""
    rng = np.random.default_rng(11)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(400, 5)))]
    rows += [(-i, [1.0, 2.0, 0.0, 0.0, 0.0]) for i in range(1, 300)] + [(900, [0.0] * 5), (901, [float("nan")] * 5), (902, [float("inf"), 1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").cache()
    asked = df.unionByName(spark.createDataFrame([(7000, [1.0, 1.0, 0.0, 0.0, 0.0])], df.schema))
    path = str(tmp_path / "x")
    vector_index.build(df, path, lists=9)
    for least in (-1.0, 0.3):
        exact = {(r["src"], r["dst"], round(r["weight"], 9)) for r in vectors.knn(df, 6, least, asked=asked).collect()}
        got = [(r["src"], r["dst"], round(r["weight"], 9)) for r in vector_index.search(path, asked, 6, least, take=9, block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == exact
    assert vector_index.search(path, asked.limit(0), 6, block=block).count() == 0
    vector_index.build(df.limit(0), str(tmp_path / "e"))
    assert vector_index.search(str(tmp_path / "e"), df.limit(0), 6, block=block).count() == 0


def test_index_takes_rows_in(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = {i: x.tolist() for i, x in enumerate(rng.normal(size=(300, 6)))}
    frame = lambda d: spark.createDataFrame(list(d.items()), "vec_id long, embedding array<double>")
    path = str(tmp_path / "x")
    vector_index.build(frame(rows), path, lists=12)
    before = {r["list"]: r["n"] for r in vector_index._stored(spark, path).groupBy("list").agg(F.count("id").alias("n")).collect()}
    new = {5: [-x for x in rows[5]], 6: rows[6], 1000: [1.0] * 6}
    touched = vector_index.upsert(path, frame(new))
    assert touched == sorted(touched) and len(touched) < len(before)
    rows |= new
    got = {r["id"]: r["v"] for r in vector_index._stored(spark, path).collect()}
    assert got == rows and vector_index._stored(spark, path).count() == len(rows)
    assert vector_index.upsert(path, frame(new).limit(0)) == []
    # a list that loses all of its rows
    lonely = min(before, key=lambda n: before[n])
    gone = {r["id"]: [-1.0 * x for x in r["v"]] for r in vector_index._stored(spark, path).where(f"list = {lonely}").collect()}
    vector_index.upsert(path, frame(gone))
    assert {r["id"]: r["v"] for r in vector_index._stored(spark, path).collect()} == rows | gone
    vector_index.build(frame({}), str(tmp_path / "e"))


def test_pagerank_stops_by_its_rule(spark):
    rng = random.Random(4)
    n = 60
    edges = {(a, b): rng.random() + 0.1 for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(150)) if a < b and a % 9 and b % 9}
    p = np.array([rng.random() for _ in range(n)])
    p /= p.sum()
    nodes = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "id long, p double")
    links = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, weight double")
    src, dst = (np.array([e[k] for e in edges]) for k in (0, 1))
    for tol, rounds in ((1e-4, 100), (1e-7, 100), (1e-12, 3), (1e-5, 4)):
        want = graph.power_iteration(n, src, dst, np.array(list(edges.values())), p, 0.85, tol, rounds)
        got = {r["id"]: r["pagerank"] for r in graph.pagerank_large(nodes, links, tol=tol, rounds=rounds).collect()}
        assert max(abs(got[i] - want[i]) for i in range(n)) < 1e-12
    assert graph.pagerank_large(nodes.limit(0), links).count() == 0
    alone = {r["id"]: r["pagerank"] for r in graph.pagerank_large(nodes, links.limit(0)).collect()}
    assert max(abs(alone[i] - p[i]) for i in range(n)) < 1e-3


WORDS = ["net", "Network", "working", "a%b", "50_x", "ß", "Straße", "日本語", "", "x"]


def batch(spark, rng, n):
    """Rows of the dictionary, a headword once; nulls and empty values among them."""
    rows = []
    for w in rng.sample(WORDS, n):
        some = lambda: rng.choice([None, [], rng.sample(["net", "s", "t", "TION"], 2)])
        rows.append((w, some(), rng.choice([None, "", f"d{rng.random()}"]), rng.choice([None, "c", "e"]), rng.choice([None, rng.random()]), some(), rng.choice([None, [rng.random()]]), None, None))
    return spark.createDataFrame(rows, dictionary_log.SCHEMA)


def shown(df):
    return sorted((r["headword"], *(tuple(r[c]) if isinstance(r[c], list) else r[c] for c in dictionary_log.COLUMNS[1:])) for r in df.collect())


@pytest.mark.parametrize("every", [2, 99])
def test_the_log_gives_what_upserts_give(spark, tmp_path, every):
    rng, store = random.Random(every), str(tmp_path / "log")
    assert dictionary_log.read(spark, store).count() == 0
    whole = spark.createDataFrame([], dictionary_log.SCHEMA)
    for n in range(5):
        rows, now = batch(spark, rng, rng.randint(1, 8)).cache(), F.lit(1000 + n).cast("timestamp")
        whole = dictionary.upsert(whole, rows, now).cache()
        dictionary_log.append(store, n, rows, now)
        if n == 1:
            dictionary_log.append(store, n, rows, now)  # a batch that is run again
        dictionary_log.compact(spark, store, every)
        assert shown(dictionary_log.read(spark, store)) == shown(whole)
    assert len(dictionary_log._listed(spark, f"{store}/snapshots", "upto=")) == (every == 2)


def test_ingestion_appends(spark, tmp_path):
    from termloom.operators import candidates
    from termloom.plans import extract
    from termloom.streaming import ingest

    def terms(batch):
        return extract.dictionary_rows(candidates.term_counts(batch).withColumn("score", F.col("frequency").cast("double")))

    for k, s in enumerate(("alpha beta", "beta gamma", "gamma delta")):
        spark.createDataFrame([(k, s, "en", "s", len(s))], ingest.DOCUMENTS).write.mode("append").parquet(str(tmp_path / "docs"))
        ingest.ingest_log(spark, str(tmp_path / "docs"), str(tmp_path / "log"), str(tmp_path / "check"), terms, 2).awaitTermination()
    got = {r["headword"]: r["source_docs"] for r in dictionary_log.read(spark, str(tmp_path / "log")).collect()}
    assert got == {"alpha": ["0"], "beta": ["0", "1"], "gamma": ["1", "2"], "delta": ["2"]}


def test_search_by_grams_finds_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(1)
    rows = [(w + s, rng.choice([None, [], ["net", "a%b"], [w.upper()]]), rng.choice([None, 0.5, rng.random()]), None) for w in WORDS for s in ("", "s", "NET", "%", "-日本")] + [(None, ["net"], 1.0, None)]
    stored = spark.createDataFrame(rows, "headword string, synonyms array<string>, confidence double, updated_at timestamp").cache()
    dictionary_index.build(stored, str(tmp_path / "i"))
    plain = stored.where("headword IS NOT NULL")
    for q in ("net", "NET", "n", "ne", "%", "a%b", "_x", "50_", "日本", "nothing", "", "e%s", "STRASSE", "straße", "S"):
        want = [tuple(r) for r in dictionary.search(plain, q, 100).select("headword", "confidence").collect()]
        assert [tuple(r) for r in dictionary_index.search(spark, str(tmp_path / "i"), q, 100).select("headword", "confidence").collect()] == want, q
    text = dictionary_index.search(spark, str(tmp_path / "i"), "network")._jdf.queryExecution().toString()
    assert "PartitionFilters" in text
