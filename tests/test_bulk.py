"""Steps that work on many rows at once, against what works on one."""

import random
from collections import Counter

from termloom.config import JAPANESE
from termloom.operators import candidates, contexts, segment, stats


def test_paths_of_many_runs_equal_those_of_one(monkeypatch):
    monkeypatch.setattr(segment, "LATTICE", 64)
    monkeypatch.setattr(segment, "LONG_RUN", 25)
    rand = random.Random(1)
    for _ in range(60):
        signs = "abcé漢"[: rand.randint(1, 5)]
        costs = {"".join(rand.choice(signs) for _ in range(rand.randint(1, 4))): rand.choice([0, 1, 5, 5, 9000, 19999, 20000, 45000]) for _ in range(rand.randint(0, 12))}
        by = segment.Segmenter(segment.Lexicon(costs, {}))
        runs = ["".join(rand.choice(signs + "z") for _ in range(rand.randint(0, 30))) for _ in range(30)]
        assert by.paths(runs) == [by.path(r) for r in runs]


def test_substrings_are_counted_by_number():
    rand = random.Random(2)
    signs = "".join(map(chr, range(0x4E00, 0x4E00 + 900)))
    for alphabet in ("ab", signs):  # the latter's numbers don't fit beyond six characters
        runs = ["".join(rand.choice(alphabet) for _ in range(rand.randint(0, 40))) for _ in range(50)]
        got = Counter()
        for batch in segment.substrings(runs, 8):
            got.update(dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())))
        assert got == Counter(r[i : i + k] for r in runs for k in range(1, 9) for i in range(len(r) - k + 1))


def test_neighbours_of_a_document_are_counted_in_one_task(spark):
    """Against plain Python, and without the window that held every word's neighbours."""
    rand = random.Random(3)
    texts = {i: [rand.choice(["ab", "abc", "b", "ca", "é", "z"]) for _ in range(rand.randint(0, 40))] for i in range(6)}
    words = spark.createDataFrame([(i, p, w) for i, ws in texts.items() for p, w in enumerate(ws)], "doc_id long, pos int, word string")
    targets = spark.createDataFrame([(i, t) for i in texts for t in ("ab", "b", "é", "none")], "doc_id long, term string")
    found = contexts.around_words(words, targets, 3, 2)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    want = set()
    for i, ws in texts.items():
        for t in ("ab", "b", "é", "none"):
            for side in ("before", "after"):
                n = Counter(v for p, w in enumerate(ws) if t in w for v in (ws[max(0, p - 3) : p] if side == "before" else ws[p + 1 : p + 4]))
                want |= {(i, t, side, v, k, r + 1) for r, (v, k) in enumerate(sorted(n.items(), key=lambda x: (-x[1], x[0]))[:2])}
    assert {tuple(r) for r in found.collect()} == want


def test_terms_of_a_document_are_counted_and_compared_in_one_task(spark):
    """Against the operators that it stands for, a repeated and a null id, a null and an empty text among the rows; the
    texts are dealt out once."""
    docs = spark.createDataFrame([(1, "The engine's engines ENGINE engine_room en"), (2, None), (3, ""), (None, "aa aaa aa"), (1, "engine room rooms")], "doc_id long, text string")
    counts = candidates.term_counts(docs)
    found = candidates.document_terms(docs)
    key = lambda rows: sorted(map(repr, map(tuple, rows)))
    assert key(found.select("doc_id", "term", "frequency", "__mean", "__most").collect()) == key(candidates.with_containers(counts).select("doc_id", "term", "frequency", "__mean", "__most").collect())
    words = {(r["doc_id"], r["term"]): r["frequency"] for r in stats.word_counts(docs, counts.where("doc_id = 1")).collect()}
    assert words == {(r["doc_id"], r["term"]): r["words"] for r in found.where("doc_id = 1").collect()}
    assert {r["squares"] for r in found.where("doc_id = 1").collect()} == {sum(n * n for n in words.values())}
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_noun_runs_are_cut_where_the_text_is(spark):
    """Equal to the window over tokens, without a shuffle; n-grams of a repeated id are added up in one."""
    docs = spark.createDataFrame([(1, "ガス燃料 12 噴射弁のA1ガス"), (2, None), (3, ""), (4, "機関式の燃料性ガス機関 燃料性")], "doc_id long, text string")
    found = candidates.document_noun_runs(docs, "A", JAPANESE)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted((r["doc_id"], r["run"], tuple(r["words"])) for r in df.collect())
    assert rows(found) == rows(candidates.noun_runs(candidates.tagged(docs, "A", JAPANESE), JAPANESE))
    twice = docs.unionAll(docs)
    counts = candidates.statistical_candidates(twice, JAPANESE)
    assert counts._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    once = {(r["doc_id"], r["term"]): 2 * r["frequency"] for r in candidates.statistical_candidates(docs, JAPANESE).collect()}
    assert once and once == {(r["doc_id"], r["term"]): r["frequency"] for r in counts.collect()}
