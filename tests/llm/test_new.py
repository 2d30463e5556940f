"""Projection forests, repair of conversations and the audit of filters."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termloom.llm import filteraudit, queries, rpforest, turnrepair

CONVERSATIONS = "conv_id long, turn long, role string, text string"


# --- op12 ---


def lattice(rows, first=0):
    """(cost, audit, repaired) by a table over all rows and states, every node's best in whole strings."""
    accepted = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    best = {0: (0, "", ())}

    def closed(best):
        for _ in range(4):
            for state in list(best):
                cost, audit, out = best[state]
                for letter, to in accepted[state].items():
                    if letter != "s":
                        way = (cost + 3, audit + "I", (*out, ("user" if letter == "u" else "assistant", "")))
                        if to not in best or way[:2] < best[to][:2]:
                            best[to] = way
        return best

    for role, text, fault in rows:
        new = {}
        for state, (cost, audit, out) in closed(best).items():
            ways = [(state, (cost + 4, audit + "D", out))]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                for letter, to in accepted[state].items():
                    if role[:1] == letter:
                        ways.append((to, (cost + more, audit + "K", (*out, (role, text)))))
                    if letter != "s":
                        ways.append((to, (cost + more + 3, audit + "R", (*out, ("user" if letter == "u" else "assistant", text)))))
            for to, way in ways:
                if to not in new or way[:2] < new[to][:2]:
                    new[to] = way
        best = new
    best = closed(best)
    return min(best[s][:3] for s in (0, 3) if s in best)


def expected(data):
    """Reports of (conv_id, turn, role, text) rows, damaged and repaired in plain Python."""
    out, by = {}, {}
    for conv, turn, role, text in data:
        by.setdefault(conv, [])
        blank = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            by[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in rows:
            core = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, kept = lattice([(r, t, f) for (_, r, t), f in zip(rows, faults)])
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (conv, gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


ROLES = ["user", "assistant", "system", "tool", "", None, "u", "Assistant", "é"]
TEXTS = ["Yes.", "No", "", " \n", "What?", None, "so it is. \t", "a" * 50, "日本。", "Yes."]


def some(rng, conv, n):
    return [(conv, rng.choice([k, k, k, None, k // 2]), rng.choice(ROLES), rng.choice(TEXTS)) for k in range(n)]


def test_conversations_are_repaired(spark):
    rng = random.Random(2)
    data = [r for c in [None, *range(120)] for r in some(rng, c, rng.randint(1, 9))]
    data += [(c, t, ("user", "assistant")[t % 2], f"Turn {t}.") for c in range(200, 260) for t in range(6)]
    data += [(300, -5, "user", "x."), (300, (1 << 62), "assistant", "y."), (301, None, "user", "q?"), (301, None, "user", "q?")]
    df = spark.createDataFrame(data, CONVERSATIONS)
    want, got = expected(data), {r["conv_id"]: tuple(r) for r in turnrepair.repair(turnrepair.damaged(df)).collect()}
    assert got == want
    assert turnrepair.repair(turnrepair.damaged(df.limit(0))).count() == 0
    # a conversation of whose rows none is left
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    one = spark.createDataFrame([(gone, 1, "user", "x.")], CONVERSATIONS)
    assert tuple(turnrepair.repair(turnrepair.damaged(one)).first()) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_rows_are_what_the_report_says(spark):
    rng = random.Random(5)
    data = [r for c in range(60) for r in some(rng, c, rng.randint(1, 7))]
    rows = turnrepair.damaged(spark.createDataFrame(data, CONVERSATIONS))
    reports = turnrepair.repair(rows)
    by = {r["conv_id"]: [] for r in reports.collect()}
    for r in sorted(turnrepair.repaired(rows, reports).collect(), key=lambda r: r["place"]):
        by[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in by.items()} == {r["conv_id"]: r["repaired_sha256"] for r in reports.collect()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "x"]), st.sampled_from([0, 0, 1, 2, 3])), max_size=14), st.integers(1, 5))
def test_segments_give_what_the_whole_gives(rows, length):
    whole = turnrepair.search([(r[:1], f) for r, f in rows], 0, True)
    ((state, (cost, audit)),) = whole.items()
    faults = ["", "blank", "duplicate", "truncated"]
    assert (cost, audit) == lattice([(r, "t", faults[f]) for r, f in rows])[:2] and state in turnrepair.ENDS
    known = turnrepair._Conversation(1)
    for i, (role, fault) in enumerate(rows):
        known.add(i, role, b"t", fault)
        if len(known.rows) == length:
            known.advance(last=False)
    assert known.report()[6:8] == (cost, audit)


def test_a_long_conversation_is_searched_in_segments(spark):
    n = 3 * turnrepair.SEGMENT_ROWS + 17
    data = [(7, t, ("user", "assistant", "tool")[t % 3], f"Turn {t}" + "." * (t % 5 > 0)) for t in range(n)]
    got = turnrepair.repair(turnrepair.damaged(spark.createDataFrame(data, CONVERSATIONS))).collect()
    assert [tuple(r) for r in got] == [expected(data)[7]]


def test_extra_columns_of_conversations(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.", 5, "x"), (1, 1, "assistant", "Yes.", 6, "y")], CONVERSATIONS + ", copy int, fault string")
    assert turnrepair.repair(turnrepair.damaged(df)).columns[0] == "conv_id"


# --- op13 ---

DOCS = "doc_id long, text string, source string"


def audited(docs, labels):
    """The audit by filtering again for every order."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for d, text, _ in docs:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    rows = []
    for d, text, source in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {x for x, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), re.search("[#$%&*|]", text), d is not None and first[text] < d)) if bad}
        rows.append((source or "", d, fails))
    out = []
    removed_by = {}
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {r[0] for r in rows}:
            left = [r for r in rows if r[0] == part]
            for k, x in enumerate(order):
                here = [r for r in left if x in r[2]]
                whole = [r for r in rows if r[0] == part and x in r[2]]
                left = [r for r in left if x not in r[2]]
                removed_by[part, x] = removed_by.get((part, x), 0) + len(here)
                out.append((part, order, k + 1, len(left), len(here), len(whole) - len(here), sum(r[2] == {x} for r in whole), sum(r[1] in good for r in here), sum(r[1] in toxic for r in here), x))
    return sorted((*r[:9], removed_by[r[0], r[9]]) for r in out)


def filters_of(spark, docs, labels, path):
    spark.createDataFrame(docs, DOCS).selectExpr("*", "'x' AS part", "1 AS mask", "2 AS n", "3 AS cls", "4 AS doc").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    got = queries.op13_filter_audit(spark, str(path))
    return sorted(map(tuple, got.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()))


def test_filters_are_audited(spark, tmp_path):
    rng = random.Random(8)
    word = [f"w{i}" for i in range(400)] + ["ABC", "#", "x|y"]
    texts = [" ".join(rng.choices(word, k=rng.choice([3, 150, 250, 700]))) for _ in range(25)] + [None, "", " ", "word " * 300, "é" * 3000, "A" * 5, "long " * 20_000]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["s", "t", None, ""])) for _ in range(90)]
    docs += [docs[0], docs[0], (7, "same id, other text", "s"), (7, "same id, more text!", "s")]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d in range(40)] + [(3, 1, 1), (None, 1, 1), (1000, 1, 1)]
    assert filters_of(spark, docs, labels, tmp_path / "a") == audited(docs, labels)
    assert filters_of(spark, [], [], tmp_path / "b") == []
    assert filters_of(spark, [(1, "x", "s")], [], tmp_path / "c") == audited([(1, "x", "s")], [])


def test_texts_of_one_class_are_compared_whole(spark, monkeypatch):
    """With hashes that always collide, texts of one length are still told apart."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(filteraudit, "block_hashes", lambda text, n: F.transform(F.split(text, ""), lambda _: F.lit(7).cast("long")))
    texts = ["aa", "bb", "aa", "bb", "cc", "cc", "aa", "dd"]
    docs = spark.createDataFrame([(i, "p", t) for i, t in enumerate(texts)] + [(0, "p", "aa"), (0, "p", "ee")], "doc long, part string, text string")
    got = sorted((r["doc"], r["mask"]) for r in filteraudit.flagged(docs, {"A": F.lit(False)}, "E").collect())
    assert got == [(0, 0), (0, 0), (0, 0), (1, 0), (2, 2), (3, 2), (4, 0), (5, 2), (6, 2), (7, 0)]


# --- op11 ---


def nearest(rows, k=5):
    """{query row's id: [(vec_id, score)]} by comparing all; an id counts by its nearest row."""
    width = max((len(v) for _, v in rows), default=0)
    m = np.array([[*v, *[0.0] * (width - len(v))] for _, v in rows])
    m = m / np.abs(m).max(axis=1, keepdims=True)
    u = m / np.sqrt((m * m).sum(axis=1, keepdims=True))
    ids = np.array([i for i, _ in rows])
    out = {}
    for q in np.flatnonzero(ids % 50 == 0):
        s = u @ u[q]
        best = {}
        for i, x in zip(ids.tolist(), s.tolist()):
            if i != ids[q]:
                best[i] = max(x, best.get(i, -2))
        best = {**{v: x for v, x in out.get(int(ids[q]), [])}, **{i: max(x, dict(out.get(int(ids[q]), [])).get(i, -2)) for i, x in best.items()}}
        out[int(ids[q])] = sorted(best.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]
    return out


def found(spark, rows, **kw):
    df = rpforest.unit_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding").cache()
    out = {}
    for r in sorted(rpforest.search(df, df.where("id % 50 = 0"), rpforest.grow(df), **kw).collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("kind", ["uniform", "clusters", "equal"])
def test_forest_finds_nine_of_ten(spark, kind):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 24))
    v = rng.normal(size=(6000, 24))
    if kind == "clusters":
        v = centres[rng.integers(0, 40, 6000)] + 0.3 * v
    if kind == "equal":
        v[rng.random(6000) < 0.4] = centres[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got, want = found(spark, rows), nearest(rows)
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    exact = {(q, i): s for q in want for i, s in want[q]}
    assert all(math.isclose(s, exact[q, i], rel_tol=1e-12, abs_tol=1e-14) for q in got for i, s in got[q] if (q, i) in exact)
    if kind == "equal":  # ties of equal vectors go to the smallest ids
        same = [i for i, x in rows if x == centres[0].tolist()]
        for q in got:
            if q in set(same):
                assert [i for i, _ in got[q]] == [i for i in same if i != q][:5]


def test_a_reach_of_one_is_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(3000, 8)))]
    df = rpforest.unit_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding").cache()
    forest = rpforest.grow(df)
    assert forest.levels >= 4 and forest.reach < 1
    whole = rpforest.Forest(forest.directions, forest.cuts, 1.0)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in rpforest.search(df, df.where("id % 50 = 0"), whole, first=8).collect()}
    assert got == {(q, k + 1): i for q, x in nearest(rows).items() for k, (i, _) in enumerate(x)}


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1e300]), (50, [1e-300, 1e-300]), (1, [1.0]), (2, [2.0, 2.0]), (3, [0.0, 0.0]), (4, []), (5, None), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 1.0]), (9, [-1.0, 0.0, 0.0]), (2, [3.0, 3.0]), (2, [3.0, 3.0])]
    want = nearest([r for r in rows if r[0] in (0, 50, 1, 2, 9)])
    got = found(spark, rows)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert got[0][0] == (1, 1.0) and len(got[0]) == 4
    assert found(spark, [(3, [0.0])]) == {} and found(spark, [(50, [2.0])]) == {}
