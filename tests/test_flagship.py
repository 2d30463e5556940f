"""The end-to-end plans against plain Python that works on one document after another."""

import math
import os
import re
from collections import Counter, defaultdict
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pytest

from termloom.config import LATIN
from termloom.functions import fixed
from termloom.operators import chunkers
from termloom.operators.candidates import MODES
from termloom.plans.catalog import QUERIES
from termloom.sources.provider import Stub

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


def half_up(x, digits=9):
    return float(Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def texts():
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    return {int(i): s for i, s in zip(docs["doc_id"], docs["text"]) if isinstance(s, str)}


def scaled(values):
    low, high = min(values), max(values)
    return [0.5 if low == high else (v - low) / (high - low) for v in values]


def containers(counts, shortest=2):
    """Term to the frequencies of the terms that hold it."""
    found = defaultdict(list)
    for whole, n in counts.items():
        parts = {whole[a:b] for a in range(len(whole)) for b in range(a + shortest, len(whole) + 1)} - {whole}
        for p in parts & counts.keys():
            found[p].append(n)
    return found


def c_values(counts, weight):
    held = containers(counts)
    return {t: max(0.0, weight(len(t)) * (n - (sum(held[t]) / len(held[t]) if held[t] else 0))) for t, n in counts.items()}


def tokens(s, mode="A"):
    kinds = []
    for t in re.findall(MODES[mode], s):
        if re.fullmatch("[0-9]+", t):
            kind = "number"
        elif t.lower() in LATIN.stop_words or re.fullmatch("[ぁ-ん]{1,2}", t):
            kind = "particle"
        elif t in fixed.JOINING_SUFFIXES:
            kind = "suffix"
        else:
            kind = "other" if re.fullmatch("[ぁ-ん]+", t) else "noun"
        kinds.append((t, kind))
    return kinds


def noun_runs(toks):
    runs = [[]]
    for t, kind in toks:
        if kind in ("noun", "suffix") and t not in fixed.STOP_WORDS:
            runs[-1].append(t)
        elif runs[-1]:
            runs.append([])
    return [r for r in runs if r]


def valid(t):
    return t not in fixed.STOP_WORDS and not any(len(t) > len(x) and (t.startswith(x) or t.endswith(x)) for x in fixed.STOP_WORDS)


def compound_base(s, mark="."):
    """Term to [frequency, tfidf, c_value, score] of the compound candidates of a text."""
    counts = Counter()
    for run in noun_runs(tokens(s)):
        for n in range(1, 11):
            for i in range(len(run) - n + 1):
                t = " ".join(run[i : i + n])
                if 2 <= len(t) <= 20 and valid(t):
                    counts[t] += 1
    counts.update(t for t in re.findall("[ァ-ヴー]+", s) if valid(t))
    counts.update(re.findall(r"[A-Za-z][A-Za-z0-9\-]*[A-Za-z0-9]", s))
    counts = {t: n for t, n in counts.items() if len(t) > 1}
    if not counts:
        return {}
    chunks = chunkers.paragraphs(s, 500, mark)
    c = c_values(counts, lambda n: math.log2(n + 1))
    tfidf = {}
    for t in counts:
        per = [k for k in (x.count(t) for x in chunks) if k]
        tfidf[t] = (1 + math.log(max(per))) * (math.log((len(chunks) + 1) / (len(per) + 1)) + 1) if per else 0.0
    terms = list(counts)
    both = zip(terms, scaled([tfidf[t] for t in terms]), scaled([c[t] for t in terms]))
    return {t: [counts[t], tfidf[t], c[t], half_up(0.3 * x + 0.7 * y)] for t, x, y in both if counts[t] >= 2}


def penalty(n, most):
    return 1.0 if most is None or not most > 0.10 * n else 0.2 if most / n > 0.2 else 0.4


def factors(counts):
    """Terms from the longest on; one that nothing has penalised and that occurs over three times penalises its parts."""
    out, done = dict.fromkeys(counts, 1.0), set()
    for whole in sorted(counts, key=lambda t: (-len(t), t)):
        if whole in done or counts[whole] <= 3:
            continue
        for part in counts:
            if part != whole and part in whole and counts[whole] > 0.05 * counts[part]:
                out[part] *= 0.5 if counts[whole] > 0.2 * counts[part] else 0.7
                done.add(part)
    return out


def cutoff(scores, low=20, high=100):
    """How many of the scores, best first, are kept."""
    n = len(scores)
    if n <= low:
        return n
    rates = [(scores[i - 1] - scores[i]) / scores[i] if scores[i] > 0 else None for i in range(1, min(n - 1, high))]
    sane = [r for r in rates if r is not None]
    elbow = low
    if sane and max(sane) > 2 * sum(sane) / len(sane):
        elbow = min(math.floor(1.2 * (rates.index(max(sane)) + 1)), high)
    total, run, part = half_up(0.8 * sum(scores[:high])), 0.0, high
    for i, x in enumerate(scores[:high]):
        run += x
        if half_up(run) >= total:
            part = i + 1
            break
    return max(low, min(elbow, part, n, high))


def ranked(score, most=50):
    order = sorted(score, key=lambda t: (-score[t], t))
    return order[: min(most, cutoff([score[t] for t in order]))]


def same(got, expected, digits=6):
    """Rows by (document, term), numbers to some digits."""
    assert got.keys() == expected.keys()
    for key, row in expected.items():
        assert got[key] == pytest.approx(row, abs=10**-digits), key


def test_compound_terms(spark):
    expected = {}
    for i, s in texts().items():
        base = compound_base(s)
        counts = {t: v[0] for t, v in base.items()}
        held, factor = containers(counts), factors(counts)
        score = {t: half_up(base[t][3] * penalty(n, max(held[t], default=None)) * factor[t]) for t, n in counts.items()}
        expected |= {(i, t): (*base[t][:3], factor[t], score[t], k) for k, t in enumerate(ranked(score), 1)}
    rows = QUERIES["compound_terms"](spark, SMALL).collect()
    same({(r["doc_id"], r["term"]): tuple(r[c] for c in ("frequency", "tfidf", "c_value", "factor", "score", "rank")) for r in rows}, expected)


def technical(t):
    both = re.search("[A-Za-z]", t) and re.search("[0-9]", t)
    return bool(both or (re.fullmatch("[ア-ヴー・]+", t) and len(t) >= 3) or re.fullmatch("[A-Z]{2,}", t))


def valid_compound(t):
    looks = (re.search("[A-Za-z]", t) and re.search("[0-9]", t)) or re.search("[ア-ヴー]", t) or t.endswith(fixed.TECHNICAL_SUFFIXES) or re.fullmatch("[一-龥]{3,}", t)
    return 3 <= len(t) <= 20 and t not in fixed.COMPOUND_COMMON and bool(looks)


def generic_scores(s):
    """Term to (frequency, modes, score) of the generic candidates of a text."""
    modes = Counter()
    for mode in MODES:
        modes.update({t for t, kind in tokens(s, mode) if (kind in ("noun", "number") and len(t) >= 2) or technical(t)})
    short = tokens(s)
    compound = {" ".join(r) for r in noun_runs(short) if 2 <= len(r) <= 4}
    for pattern in (("noun", "noun"), ("noun", "noun", "noun"), ("noun", "suffix"), ("noun", "particle", "noun")):
        for i in range(len(short) - len(pattern) + 1):
            part = short[i : i + len(pattern)]
            if tuple(k for _, k in part) == pattern:
                compound.add("".join(t for t, k in part if k != "particle"))
    every = [t for t in {*modes, *filter(valid_compound, compound)} if 2 <= len(t) <= 30 and not t.isdigit() and t not in fixed.COMMON_WORDS]
    words = [t for t, _ in short]
    spelt = Counter("".join(words[i : i + n]) for n in range(1, 5) for i in range(len(words) - n + 1))
    counts = {t: max(1, spelt[t] + (t in words)) for t in every}
    c = c_values(counts, lambda n: math.log2(max(2, n)))
    around = {}
    for t in counts:
        around[t], at = set(), s.find(t)
        while at >= 0:
            near = re.findall(fixed.CONTEXT_RUNS, s[max(0, at - 30) : at] + s[at + len(t) : at + len(t) + 30])
            around[t].update(near[:3], near[-3:])
            at = s.find(t, at + len(t))
    shared = Counter(w for found in around.values() for w in found)
    out = {}
    for t, n in counts.items():
        mean = sum(shared[w] for w in around[t]) / len(around[t]) if around[t] else None
        nc = c[t] if mean is None else 0.8 * c[t] + 0.2 * c[t] * mean
        size = len(t)
        length = 10 if 4 <= size <= 10 else 8 if 10 < size <= 15 else 3 if size < 4 else 1
        looks = (8 if re.search("[A-Z0-9]{2,}", t) else 0) + (5 if re.search("[ア-ヴー]", t) else 0)
        out[t] = n, modes[t], half_up(nc * 5 + math.log(n + 1) * 3 + length + modes[t] * 5 + looks)
    return out


def test_generic_terms(spark):
    rows = QUERIES["generic_terms"](spark, SMALL).collect()
    got = defaultdict(dict)
    for r in rows:
        got[r["doc_id"]][r["term"]] = (r["frequency"], r["modes"], r["score"], r["rank"])
    for i, s in texts().items():
        all_ = generic_scores(s)
        # sums in another order may differ in the last digit kept, so equal scores at the border may change places
        order = sorted(all_, key=lambda t: (-all_[t][2], t))[:30]
        own = got.pop(i, {})
        assert len(own) == len(order)
        least = all_[order[-1]][2] if order else 0
        for t, (n, m, score, _) in own.items():
            assert (n, m) == all_[t][:2] and score == pytest.approx(all_[t][2], abs=1e-6) and score >= least - 1e-6
        assert {t for t in order if all_[t][2] > least + 1e-6} <= own.keys()
        assert [own[t][2] for t in sorted(own, key=lambda t: own[t][3])] == sorted((v[2] for v in own.values()), reverse=True)
    assert not got


def nearest(ids, m, k=12, least=0.30):
    """Undirected edges {(smaller, larger): weight} between each row and its nearest others."""
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    near, edges = m @ m.T, {}
    for i, a in enumerate(ids):
        others = sorted((-round(near[i, j], 12), b, j) for j, b in enumerate(ids) if j != i and near[i, j] >= least)
        for _, b, j in others[:k]:
            edges[min(a, b), max(a, b)] = max(near[i, j], edges.get((min(a, b), max(a, b)), 0))
    return edges


def pagerank(base, edges):
    """Node to its rank, by a matrix of all nodes."""
    ids = sorted(base)
    at = {x: i for i, x in enumerate(ids)}
    p = np.array([max(base[x], 0.0) ** 0.7 for x in ids])
    p = p / p.sum() if p.sum() > 0 else np.full(len(ids), 1 / len(ids))
    w = np.zeros((len(ids), len(ids)))
    for (a, b), x in edges.items():
        w[at[a], at[b]] = w[at[b], at[a]] = x
    degree = w.sum(1)
    move = np.where(degree[:, None] > 0, w / np.where(degree > 0, degree, 1)[:, None], p)
    for bound in (1e-4, 1e-3):
        x = np.full(len(ids), 1 / len(ids))
        for _ in range(100):
            x, before = 0.85 * x @ move + 0.15 * p, x
            if abs(x - before).sum() < len(ids) * bound:
                return dict(zip(ids, x))
    return dict(zip(ids, x))


def test_document_pagerank(spark):
    got = {(r["graph"], r["id"]): r["pagerank"] for r in QUERIES["document_pagerank"](spark, SMALL).collect()}
    table = pd.read_parquet(f"{SMALL}/embeddings.parquet")
    expected = {}
    for g, rows in table.groupby(table["vec_id"] // 64):
        ids = [int(x) for x in rows["vec_id"]]
        ranks = pagerank({x: x % 7 + 1.0 for x in ids}, nearest(ids, np.stack(rows["embedding"]).astype(float)))
        expected |= {(int(g), x): v for x, v in ranks.items()}
    same(got, expected, 5)


def test_graph_terms(spark):
    listed = {t.casefold() for t in fixed.GENERIC_WORDS + fixed.LAYOUT_WORDS}
    expected, stub = {}, Stub(64)
    for i, s in texts().items():
        base = {t: v for t, v in compound_base(s).items() if t not in listed}
        kept = sorted(base, key=lambda t: (-base[t][3], t))[:300]
        if not kept:
            continue
        edges = nearest(kept, np.array(stub.embed(kept), dtype=float))
        pieces = [x for x in s.replace("\n", ".").split(".") if x.strip(" ")]
        together = {e: sum(e[0] in x and e[1] in x for x in pieces) for e in edges}
        ranks = pagerank({t: base[t][3] for t in kept}, {e: w * (1 + 0.3 * math.log(1 + together[e])) for e, w in edges.items()})
        both = zip(kept, scaled([ranks[t] for t in kept]), scaled([base[t][3] for t in kept]))
        score = {t: half_up(0.6 * x + 0.4 * y) for t, x, y in both}
        expected |= {(i, t): (base[t][0], base[t][3], score[t]) for t in ranked(score)}
    rows = QUERIES["graph_terms"](spark, SMALL).collect()
    same({(r["doc_id"], r["term"]): (r["frequency"], r["base_score"], r["score"]) for r in rows}, expected, 5)
