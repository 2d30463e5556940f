"""Passes over a provider, against plain Python and worked values."""

import difflib
import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from termloom.config import LATIN
from termloom.operators import passes, perplexity
from termloom.plans.catalog import QUERIES
from termloom.sources import provider


def tokens(s):
    import regex

    return regex.findall(LATIN.token, s)


def digest(s, n):
    return int(hashlib.md5(s.encode()).hexdigest()[:n], 16)


def generated(prompt):
    """What the stub generates: the last five words with their log probabilities."""
    return [(w, -digest(f"{w}|{k}", 4) / 10000) for k, w in enumerate(prompt.split()[-5:])]


def direct(prompt, term):
    said = generated(prompt)
    whole = "".join(w for w, _ in said)
    if term in whole or whole in term:
        own = [lp for w, lp in said if any(c in w for c in term)]
        if own:
            return math.exp(-sum(own) / len(own))
    for w, lp in said:
        for c, x in ((w, lp), (w.upper(), lp - 1)):
            if term in c or c in term:
                return math.exp(-x)
    return None


def steps(prompt, term):
    said, lps = "", []
    for i in range(min(5, len(term))):
        got = generated(prompt + said)
        if got:
            w, lp = got[0]
            target = term[i : i + len(w)]
            lps.append(lp if w == target else lp - 1 if w.upper() == target else -5.0)
            said += w
            if term in said:
                break
    return math.exp(-sum(lps) / len(lps)) if lps else None


def places(s, t):
    at, out = s.find(t), []
    while at >= 0:
        out.append(at)
        at = s.find(t, at + 1)
    return out


TEXTS = [(1, "a station and the station of a nation and the station again"), (2, "short"), (3, "word " * 60 + "ends with a word and ENDS")]


@pytest.fixture(scope="module")
def items(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("items")
    spark.createDataFrame(TEXTS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_input_perplexity(spark, items):
    expected = []
    for i, s in TEXTS:
        for t in dict.fromkeys([*tokens(s), "zzz"]):
            found, samples = places(s, t), []
            for at in found[:3]:
                if at >= 10:
                    prefix = s[:at][-200:]
                    samples += [p for p in (direct(prefix, t), steps(prefix, t)) if p is not None]
            mean = sum(samples) / len(samples) if samples else None
            label = "not_found" if not found else "medium" if mean is None else "high" if mean < 20 else "medium" if mean < 50 else "low"
            expected.append((i, t, round(100.0 if not found else 50.0 if mean is None else mean, 6), label, len(samples)))
    got = [tuple(r[c] for c in ("item_id", "term", "perplexity", "confidence", "samples")) for r in QUERIES["input_perplexities"](spark, items).collect()]
    assert [g[:2] + g[3:] for g in sorted(got)] == [e[:2] + e[3:] for e in sorted(expected)]
    assert [g[2] for g in sorted(got)] == pytest.approx([e[2] for e in sorted(expected)], abs=1e-5)


def test_sentences_and_templates(spark, items):
    got = {(r["item_id"], r["term"]): r["perplexity"] for r in QUERIES["sentence_perplexities"](spark, items).collect()}
    for (i, t), p in got.items():
        said, run, lp = generated(dict(TEXTS)[i].split(t)[0]), "", None
        for w, x in said:
            run += w
            if t.lower() in run.lower():
                lp = x
                break
        assert p == pytest.approx(50.0 if lp is None else min(95.0, max(5.0, math.exp(-lp) * 10)), abs=1e-5)
    assert len(got) == sum(len(set(tokens(s))) for _, s in TEXTS)
    found = {r["term"]: r["perplexity"] for r in QUERIES["template_perplexities"](spark, items).collect()}
    for t, p in found.items():
        lps = []
        for head in ("the station and the house ", "a word of the night ", "the station and the house "):
            said, run, lp = generated(head), "", None
            for w, x in said:
                run += w
                if t in run:
                    lp = x
                    break
            if lp is None:
                lp = next((x for w, y in said for c, x in ((w, y), (w.upper(), y - 1)) if t in c), None)
            lps += [lp] if lp is not None else []
        assert (p is None) == (not lps) and (p is None or p == pytest.approx(min(100.0, max(5.0, math.exp(-sum(lps) / len(lps)))), abs=1e-5))
    assert any(p is not None for p in found.values())


def test_string_similarities(spark, items):
    rows = QUERIES["string_similarities"](spark, items).collect()
    assert rows and all(r["ratio"] == pytest.approx(difflib.SequenceMatcher(None, r["a"], r["b"]).ratio(), abs=1e-6) for r in rows)


def test_failed_calls_leave_their_values(spark, monkeypatch):
    class Failing(provider.Stub):
        def complete(self, prompts):
            raise OSError("no answer")

        embed = generate = complete

    monkeypatch.setattr(provider, "FIRST_WAIT", 0.0)
    terms = spark.createDataFrame([("alpha", 0.9, "d"), ("beta", 0.2, "d")], "term string, score double, definition string")
    kept = passes.validate(terms, Failing()).collect()
    assert all(r["kept"] for r in kept)  # an error that is no filter keeps
    rows = passes.similarity_rows(passes.context_free(terms, Failing()), provider.Stub(8)).collect()
    assert {r["similarity"] for r in rows} == {-1.0} and all(r["error"] for r in rows)
    assert {r["perplexity"] for r in passes.choice_perplexity(terms, Failing()).collect()} == {25.0}
    assert {len(r["embedding"]) for r in provider.embed_one(terms, Failing()).collect()} == {0}
    assert {r["embedding"] for r in provider.embed_unit(terms, Failing()).select("embedding").collect()} == {None}
    bad = provider.with_defaults(provider.complete(terms, Failing(), "term"), {"score": 80.0}).collect()
    assert {r["score"] for r in bad} == {80.0}


def test_filtered_replies_keep_by_score(spark):
    rows = spark.createDataFrame([("x", 0.6, "content_filter"), ("y", 0.5, "content_filter"), ("z", 0.0, "Timeout")], "term string, score double, error string")
    got = rows.select("term", perplexity.kept_verdict(F.lit(None).cast("string"), F.col("score"), F.col("error")).alias("kept")).collect()
    assert {r["term"]: r["kept"] for r in got} == {"x": True, "y": False, "z": True}


def test_replies_that_are_no_json_give_nothing(spark):
    chunks = spark.createDataFrame([(1, 0, "something longer"), (2, 0, None)], "doc_id long, chunk_id int, chunk string")
    assert passes.extract_terms(chunks, provider.Stub(style="none")).count() == 0
    found = passes.extract_terms(chunks, provider.Stub(style="terms")).collect()
    assert [r["headword"] for r in found] == ["something"]


def test_batches_are_consolidated(spark):
    class Same(provider.Stub):
        def complete(self, prompts):
            return ['{"terms": [{"headword": "one", "definition": "of a batch"}]}' for _ in prompts]

    rows = spark.createDataFrame([(f"h{i}", [f"s{i}"], "d", None, ["x"], i) for i in range(70)], "headword string, synonyms array<string>, definition string, category string, source_docs array<string>, ord long")
    plain = passes.consolidate(rows, provider.Stub(style="none")).collect()
    assert sorted(r["headword"] for r in plain) == sorted(f"h{i}" for i in range(70))
    merged = passes.consolidate(rows, Same()).collect()
    assert {r["headword"] for r in merged} == {"one"} and 1 <= len(merged) <= 3 and merged[0]["synonyms"] == []


def test_generic_evaluation_falls_back_to_looks(spark):
    terms = spark.createDataFrame([("NOX1", 1), ("plain", 9)], "term string, frequency long")
    samples = spark.createDataFrame([("plain", 20.0), ("plain", 30.0), ("plain", 101.0), ("NOX1", 5.0)], "term string, perplexity double")
    got = {r["term"]: (r["perplexity"], r["confidence"]) for r in passes.generic_evaluation(samples, terms).collect()}
    assert got == {"plain": (25.0, "medium_confidence"), "NOX1": (45.0, "high_confidence")}
    assert [r["term"] for r in passes.needing_direct(samples, terms).collect()] == ["NOX1"]


def test_steps_of_a_term_that_is_foreseen(spark):
    class Knows(provider.Stub):
        def generate(self, prompts):
            return [[{"token": "x" if len(p) > 4 else "ab"[len(p) - 3], "logprob": -0.5, "top": [{"token": "c", "logprob": -2.0}]}] for p in prompts]

    of = lambda t: passes.stepwise(spark.createDataFrame([("xxx", t)], "context string, term string"), Knows()).first()["p"]
    assert of("ab") == pytest.approx(math.exp(0.5))
    assert of("abc") == pytest.approx(math.exp((0.5 + 0.5 + 2.0) / 3))  # the candidate counts
    assert of("zb") == pytest.approx(math.exp((5.0 + 0.5) / 2))


def test_terms_without_log_probabilities_fall_back(spark, items):
    both = {r["term"]: r["perplexity"] for r in QUERIES["term_perplexities"](spark, items).collect()}
    terms = spark.createDataFrame([(t,) for t in both], "term string")
    first = {r["term"]: r["perplexity"] for r in passes.template_perplexity(terms, provider.Stub(), ("the station and the house {}", "a word of the night {}")).collect()}
    second = {r["term"]: r["perplexity"] for r in passes.fallback_perplexity(terms, provider.Stub(style="varied")).collect()}
    assert both == pytest.approx({t: second[t] if p is None else p for t, p in first.items()}, abs=1e-5) and None in first.values()


def varied(p):
    return f"{'不明 ' if digest(p, 2) % 4 == 0 else ''}{'x' * (digest(p, 2) % 20)} {digest(p, 2) % 11}"


def test_precise_probabilities(spark, items):
    context = {}
    for _, s in TEXTS:
        for t in tokens(s):
            context[t] = min(s, context.get(t, s))
    expected = {}
    for t, s in context.items():
        if len(t) < 4:
            partial = 0.2
        else:
            tried = [t in varied(f"{passes.COMPLETE}\n{t[:at]}\n{k}").strip(" ") for at in (len(t) // 3, len(t) // 2, len(t) * 2 // 3) for k in (1, 2, 3)]
            partial = sum(tried) / 9
        general = min(1.0, (digest(f"{passes.GENERALITY}\n{t}", 2) % 11) / 10)
        if len(t) % 3 > 0:
            said = varied(f"{passes.FILL}\n{s.replace(t, '[MASK]')}").strip(" ")
            value = 0.4 * partial + 0.4 * difflib.SequenceMatcher(None, t, said).ratio() + 0.2 * general
        else:
            value = 0.4 * partial + 0.4 * general
        expected[t] = round(min(1.0, value), 6)
    assert {r["term"]: r["probability"] for r in QUERIES["precise_probabilities"](spark, items).collect()} == pytest.approx(expected, abs=1e-6)


def test_generic_terms_by_all_methods(spark):
    texts = [(1, "The injector sprays fuel. An injector of the engine leaks here! Nothing else is said"), (2, "short. fuel")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    asked = [(1, "injector", 2), (1, "fuel", 1), (1, "absent", 1), (2, "fuel", 1)]
    terms = spark.createDataFrame(asked, "doc_id long, term string, frequency long")
    expected = []
    for i, t, f in asked:
        held = [x for x in (x.strip(" ") for x in re.split(r"[.!?\n]+", dict(texts)[i])) if 10 < len(x) < 200 and t in x]
        samples = []
        for x in held[:2]:
            run, lp = "", None
            for w, y in generated(x.split(t)[0]):
                run += w
                if t.lower() in run.lower():
                    lp = y
                    break
            samples.append(50.0 if lp is None else min(95.0, max(5.0, math.exp(-lp) * 10)))
        for x in held[:2]:
            lp = next((y for w, z in generated(x.replace(t, "[MASK]")) for c, y in ((w, z), (w, z), (w.upper(), z - 1)) if t in c), None)
            samples += [] if lp is None else [min(100.0, max(5.0, -lp * 10))]
        if len(samples) < 2:
            samples.append({0: 10.0, 1: 18.0, 2: 28.0, 3: 40.0}.get(digest(f"{passes.CHOICE}\n{t}", 2) % 5, 25.0))
        sane = sorted(p for p in samples if 5 < p < 100)
        p = (sane[(len(sane) - 1) // 2] + sane[len(sane) // 2]) / 2
        expected.append((i, t, f, round(p, 6), "high_confidence" if p > 25 else "medium_confidence" if p > 15 else "low_confidence"))
    got = passes.evaluate_generic(docs, terms, provider.Stub(style="letter")).collect()
    assert sorted((r["doc_id"], r["term"], r["frequency"], round(r["perplexity"], 6), r["confidence"]) for r in got) == sorted(expected)


def Counting(path, fails=""):  # noqa: N802 - a class made here travels to the workers by value
    class Counts(provider.Stub):
        """Writes down what it is asked, from whichever worker."""

        def _told(self, prompts):
            import os

            with open(path, "a") as f:
                f.writelines(f"{os.getpid()}\t{p!r}\n" for p in prompts)
            if fails and any(fails in p for p in prompts):
                raise OSError("no answer")

        def complete(self, prompts):
            self._told(prompts)
            return super().complete(prompts)

        def generate(self, prompts):
            self._told(prompts)
            return super().generate(prompts)

    return Counts()


def asked_of(path):
    return [line.split("\t")[1] for line in path.read_text().splitlines()] if path.exists() else []


def test_prompts_are_sent_once(spark, tmp_path):
    said = tmp_path / "said"
    places = spark.createDataFrame([(1, "alpha", 0, "some words that stand before it "), (1, "beta", 0, "other words that stand before it ")], "item_id long, term string, ord int, prefix string")
    out = passes.input_perplexity(places, Counting(str(said)), "item_id")
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInPandas") <= 1
    assert out.count() == 2
    asked = asked_of(said)
    assert len(asked) == len(set(asked)) and sum(p.endswith("before it '") for p in asked) == 2
    said.write_text("")
    docs = spark.createDataFrame([(1, "The alpha is here. An alpha is there. No beta.")], "doc_id long, text string")
    terms = spark.createDataFrame([(1, "alpha", 2), (1, "gamma", 1)], "doc_id long, term string, frequency long")
    assert passes.evaluate_generic(docs, terms, Counting(str(said))).count() == 2
    assert len(asked_of(said)) == len(set(asked_of(said)))


def test_replies_are_kept(spark, tmp_path):
    said = tmp_path / "said"
    kept = provider.Stored(Counting(str(said)), str(tmp_path / "replies"), in_flight=2)
    rows = spark.createDataFrame([(i, None if i == 7 else f"p{i % 3}") for i in range(10)], "id long, prompt string")
    plain = sorted((r["id"], r["reply"], r["error"]) for r in provider.complete(rows, provider.Stub()).collect())
    for _ in range(2):
        assert sorted((r["id"], r["reply"], r["error"]) for r in provider.complete(rows, kept).collect()) == plain
    assert sorted(asked_of(said)) == ["'p0'", "'p1'", "'p2'"]
    tokens = provider.generate(rows, kept).where("id = 1").first()["tokens"]
    assert [t["token"] for t in tokens] == ["p1"] and len(asked_of(said)) == 6


def test_a_failed_batch_is_asked_row_by_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(provider, "FIRST_WAIT", 0.0)
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "id long, prompt string").coalesce(1)
    got = {r["id"]: (r["reply"] is None, r["error"]) for r in provider.complete(rows, Counting(str(tmp_path / "a"), "p3")).collect()}
    assert got == {i: (i == 3, "OSError" if i == 3 else None) for i in range(5)}
    kept = provider.Stored(Counting(str(tmp_path / "b"), "p3"), str(tmp_path / "replies"))
    assert {r["id"]: r["error"] for r in provider.complete(rows, kept).collect()} == {i: "Unanswered" if i == 3 else None for i in range(5)}
    mended = provider.Stored(Counting(str(tmp_path / "c")), str(tmp_path / "replies"))
    assert all(r["error"] is None for r in provider.complete(rows, mended).collect()) and asked_of(tmp_path / "c") == ["'p3'"]


def test_evaluation_by_a_provider(spark, tmp_path):
    from termloom.plans import extract

    docs = spark.createDataFrame([(1, "alpha beta gamma alpha delta"), (2, "beta gamma beta omega"), (3, None), (4, "")], "doc_id long, text string")
    model = Counting(str(tmp_path / "said"))
    model.style = "varied"
    rows = extract.evaluated_by_provider(docs, model, most=3, completed=2).collect()
    prompts = asked_of(tmp_path / "said")
    assert prompts and not {p for p in prompts if prompts.count(p) > 1}  # none twice, though documents share terms
    looks = {(r["doc_id"], r["term"]): r for r in extract.evaluated_terms(docs, most=3).collect()}
    assert {(r["doc_id"], r["term"]): r["score"] for r in rows} == {k: r["score"] for k, r in looks.items()} and len(rows) == 6
    terms = spark.createDataFrame([(t,) for t in {r["term"] for r in rows}], "term string")
    said = {r["term"]: r["perplexity"] for r in passes.term_perplexity(terms, provider.Stub(style="varied")).collect()}
    sure = {r["term"]: r["probability"] for r in passes.generation_probability(terms, provider.Stub(style="varied")).collect()}
    for r in rows:
        assert r["perplexity"] == pytest.approx(said[r["term"]])
        assert r["token_probability"] == pytest.approx(sure[r["term"]] if r["rank"] <= 2 else 0.1)
        assert r["priority_score"] == pytest.approx(0.4 * r["score"] + 0.4 * (100 - r["perplexity"]) + 20 * r["token_probability"])
        assert r["confidence"] == ("high" if r["perplexity"] < 30 else "low" if r["perplexity"] > 70 else "medium")
