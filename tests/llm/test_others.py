"""Mixing, fingerprints, search, archive and language ID."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.llm import bitslice, imatch, langid, mixing, queries, warc

TREE = {"a": (3, {"en": (2, {"s": (1, None), "t": (1, None)}), "fr": (1, {"s": (1, None)})}), "b": (1, {"en": (1, {"u": (1, None)})})}
LEAVES = mixing.leaves(TREE)


def test_shortage_goes_to_siblings_first():
    supply = {("a", "en", "s"): 10, ("a", "en", "t"): 500, ("a", "fr", "s"): 500, ("b", "en", "u"): 500}
    got = mixing.allocate(TREE, supply, 400)
    assert got == {("a", "en", "s"): 10, ("a", "en", "t"): 190, ("a", "fr", "s"): 100, ("b", "en", "u"): 100}
    poor = dict.fromkeys(supply, 10) | {("b", "en", "u"): 1000}
    assert mixing.allocate(TREE, poor, 400) == {**dict.fromkeys(LEAVES, 10), ("b", "en", "u"): 370}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 200), min_size=4, max_size=4), st.integers(0, 1000))
def test_budget_is_met_or_all_is_given(have, budget):
    supply = dict(zip(LEAVES, have))
    got = mixing.allocate(TREE, supply, budget)
    assert all(0 <= got[p] <= supply[p] for p in LEAVES)
    assert min(budget, sum(have)) - 8 <= sum(got.values()) <= budget


LEVELS = lambda: (F.col("d"), F.col("lang"), F.col("source"))
MIXED = "doc_id long, text string, d string, lang string, source string, tokens string, rest long"


def test_mixing(spark):
    rng = random.Random(1)
    data = [(i, "w " * rng.randint(0, 9), *rng.choice(LEAVES), "x", 1) for i in range(300)] + [(400, None, "a", "en", "s", "x", 1), (401, "w", None, "en", "s", "x", 1), (402, "w", "a", None, None, "x", 1), (3, "w w", "a", "en", "s", "x", 1), (3, "w w", "a", "en", "s", "x", 1)]
    df = spark.createDataFrame(data, MIXED)
    got = mixing.mix(df, TREE, LEVELS(), 1.2, 3, 5).collect()
    by = {}
    for d in data:
        if tuple(d[2:5]) in LEAVES:
            by.setdefault(tuple(d[2:5]), []).append((d[0], len((d[1] or "").split())))
    supply = {p: 3 * sum(n for _, n in v) for p, v in by.items()}
    given = mixing.allocate(TREE, supply, sum(s // 3 for s in supply.values()) * 1_200_000 // 1_000_000)
    expected = []
    for path, docs in by.items():
        full, rest = divmod(given[path], sum(n for _, n in docs))
        order = sorted(docs, key=lambda x: (hashlib.md5(f"5|{full}|{x[0]}".encode()).hexdigest(), x[0], x[1]))
        for i, n in order:
            take = max(0, min(n, rest))
            rest -= n
            if full or take:
                expected.append((i, *path, n, full, take))
    assert sorted((r["doc_id"], r["domain"], r["language"], r["origin"], r["tokens"], r["full_epochs"], r["last_tokens"]) for r in got) == sorted(expected)
    assert mixing.mix(df.limit(0), TREE, LEVELS(), 0.5, 1, 5).count() == 0


def test_fingerprints(spark):
    rng = random.Random(4)
    word = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.sample(word, 40)) for _ in range(100)] + [None, "", "!!", "one", texts_end := "a b c", texts_end]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    slots = imatch.lexicon(df, low=0.02, high=0.9).scalar()
    got = {r["doc_id"]: r["p"] for r in imatch.fingerprinted(df, slots, "text", "p").collect()}
    assert got[104] == got[105] and got[100] == got[101] != got[102] and len({str(v) for v in got.values()}) == 104
    one = lambda x, y: spark.range(1).select(imatch.likeness(F.lit(x), F.lit(y))).first()[0]
    assert one(got[0], got[0]) == 1.0 and one(got[0], got[1]) < 0.3
    near = spark.createDataFrame([(texts[0],), (texts[0].rsplit(" ", 1)[0],)], "text string")
    a, b = (r["p"] for r in imatch.fingerprinted(near, slots, "text", "p").collect())
    assert one(a, b) > 0.2
    assert imatch.fingerprinted(df.limit(0), slots, "text", "p").count() == 0


def test_a_lexicon_beyond_its_bound_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(imatch, "MOST_TERMS", 3)
    df = spark.createDataFrame([(i, "a b c d") for i in range(4)], "doc_id long, text string")
    with pytest.raises(Exception, match="raise low"):
        imatch.fingerprinted(df, imatch.lexicon(df, low=0.1, high=1.0).scalar(), "text", "p").collect()


@pytest.mark.parametrize("n, size", [(1, 1000), (2, 1000), (50, 3), (50, 1000)])
def test_next_rows(spark, monkeypatch, n, size):
    monkeypatch.setattr(imatch, "BUCKET_DOCS", size)
    ids = random.Random(n).sample(range(-100, 1000), n)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in imatch.with_next(df, ["text"]).collect()}
    order = sorted(ids, reverse=True)
    assert got == {i: f"t{order[(k + 1) % n]}" for k, i in enumerate(order)}


def test_next_of_ties_and_nulls(spark):
    df = spark.createDataFrame([(2, "a"), (2, "b"), (1, "c"), (None, "d")], "doc_id long, text string")
    got = {r["text"]: r["next_text"] for r in imatch.with_next(df, ["text"], tie_col="text").collect()}
    assert got == {"a": "b", "b": "c", "c": "d", "d": "a"}


def brute_top(rows, ask, k):
    q = {i: [math.floor(256 * x) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i in q:
        if i % ask == 0:
            s = sorted(((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i))[:k]
            out += [(i, n + 1, j, -v) for n, (v, j) in enumerate(s)]
    return sorted(out)


def test_tiles_grow_with_the_table():
    assert bitslice.tile(500, 10, 8) == (1 << 13, 1 << 10)
    block, group = bitslice.tile(10**9, 2 * 10**7, 1000)
    assert (block, group) == (1 << 17, 1 << 14)
    assert all(-(-n // b) * -(-n // 50 // g) >= 4 * 200 or (b, g) == (1 << 13, 1 << 10) for n in (10**5, 10**7, 10**8) for b, g in [bitslice.tile(n, n // 50, 200)])


@pytest.mark.parametrize("n, block", [(1, 64), (7, 64), (300, 64), (300, 1000)])
def test_search(spark, n, block):
    rng = np.random.default_rng(n)
    v = np.round(rng.normal(0, 0.3, (n, 6)), 1).tolist()  # coarse, so that scores tie
    data = [(i, x) for i, x in enumerate(v)] + ([(1000, None), (1001, [1.0, float("nan")] * 3), (1002, [None] * 6), (1050, [float("inf")] * 6)] if n > 1 else [])
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    rows = bitslice.quantised(df, 256, "vec_id", "embedding").cache()
    got = bitslice.top_k(bitslice.build_index(rows, block), rows.where("id % 10 = 0"), 5)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute_top(data, 10, 5)


def test_search_of_nothing(spark):
    rows = bitslice.quantised(spark.createDataFrame([], "vec_id long, embedding array<double>"), 256, "vec_id", "embedding")
    assert bitslice.top_k(bitslice.build_index(rows), rows, 5).count() == 0


def test_slices_add_up():
    rng = np.random.default_rng(0)
    rows, q = rng.integers(-300, 300, (100, 5)), rng.integers(-40, 40, (3, 5))
    s = bitslice.add_products(bitslice.slices_of(rows), q)
    bits = np.unpackbits(s.view(np.uint8), axis=2, bitorder="little")[:, :, :100].astype(np.int64)
    weight = 1 << np.arange(len(s) - 1)
    assert ((bits[:-1] * weight[:, None, None]).sum(axis=0) - (bits[-1] << (len(s) - 1)) == q @ rows.T).all()


PAGES = "page_id long, url string, html string, digest string, owner long"


def parsed(raw):
    """(WARC fields, HTTP header lines, block) of one record, by the format's rules alone."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    assert version == "WARC/1.1"
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    assert len(fields) == len(lines) and re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", fields["warc-record-id"])
    n = int(fields["content-length"])
    assert rest[n:] == b"\r\n\r\n" and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["warc-date"])
    http, _, block = rest[:n].partition(b"\r\n\r\n")
    return fields, http.decode().split("\r\n"), block


def test_archive(spark):
    big, other = "x" * 100, "é" * 50
    data = [(3, "http://a\r\nb", big), (1, None, big), (2, "u", big), (4, "u", "x" * 99), (5, "u", "x" * 99), (6, "u", None), (7, "u", ""), (8, "u", other), (9, "u", other), (1, None, big), (10, "u", "y" * 300_000)]
    df = spark.createDataFrame([(*d, "z", 0) for d in data], PAGES)
    archive = warc.write_archive(df)
    got = sorted((r["page_id"], r["record_type"], r["refers_to"], bytes(r["payload"]), r["payload_digest"]) for r in warc.read_archive(archive).collect())
    least = {}
    for i, _, h in data:
        p = (h or "").encode()
        least[p] = min(least.get(p, i), i)
    expected = []
    for i, _, h in data:
        p = (h or "").encode()
        again = len(p) >= 100 and least[p] != i
        expected.append((i, "revisit" if again else "response", least[p] if again else None, p, hashlib.sha256(p).hexdigest()))
    assert [tuple(map(str, x)) for x in got] == [tuple(map(str, x)) for x in sorted(expected, key=lambda x: (x[0], x[1]))]
    assert archive.payloads.count() == len(least)
    records = {r["page_id"]: bytes(r["record"]) for r in warc.read_archive(archive).collect()}
    kinds = {r[0]: (r[1], r[3]) for r in expected}
    ids = {i: parsed(raw)[0]["warc-record-id"] for i, raw in records.items()}
    assert len(set(ids.values())) == len(ids)
    for i, raw in records.items():
        head, http, block = parsed(raw)
        assert {"warc-date", "warc-record-id", "content-type", "warc-target-uri"} <= set(head) and head["warc-type"] == kinds[i][0]
        assert http[0] == "HTTP/1.1 200 OK" and f"Content-Length: {len(kinds[i][1])}" in http
        assert block == (kinds[i][1] if kinds[i][0] == "response" else b"")
        assert head["warc-payload-digest"] == "sha256:" + hashlib.sha256(kinds[i][1]).hexdigest()
        if kinds[i][0] == "revisit":
            assert head["warc-refers-to"] == ids[least[kinds[i][1]]] and head["warc-profile"].endswith("identical-payload-digest")
    assert parsed(records[3])[0]["warc-target-uri"] == "http://a%0D%0Ab"
    assert warc.read_archive(warc.write_archive(df.limit(0))).count() == 0


def test_spoiled_payloads_are_found(spark):
    archive = warc.write_archive(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string"))
    spoiled = warc.Archive(archive.headers, archive.payloads.where("false"))
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(spoiled).collect()


def test_languages(spark):
    rng = random.Random(9)
    say = {"en": "the and of with for that".split(), "de": "der und für mit nicht über".split(), "ja": "これ それ ため こと もの".split()}
    data = [(i, " ".join(rng.choice(say[k]) for _ in range(30)), k) for i, k in enumerate(random.Random(1).choices(list(say), k=120))]
    data += [(500, None, "en"), (501, "", "de"), (502, "123 !?", "en"), (503, "the and of", None), (504, "der " * 20000, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("held_out", langid.held_out())
    got = {r["doc_id"]: r for r in langid.predict(df, langid.profiles(df.where("NOT held_out")), keep=("doc_id", "held_out")).collect()}
    assert len(got) == len(data)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert all(got[i]["lang_pred"] == k and 0 < got[i]["score"] <= 1 for i, _, k in data[:120])
    assert [got[i]["lang_pred"] for i in (500, 501, 502, 503, 504)] == ["und"] * 3 + ["en", "de"]
    none = langid.predict(df, langid.profiles(df.limit(0))).collect()
    assert {r["lang_pred"] for r in none} == {"und"} and {r["score"] for r in none} == {0.0}


def brute_grams(text):
    """The n-grams of one to three letters of a text in order of frequency, then of their codes."""
    out = Counter()
    runs = re.findall(r"[^\W\d_]+", text.lower())
    line = " " + "".join(r + " " for r in runs) if runs else ""
    for n in (1, 2, 3):
        out.update(g for g in (line[i : i + n] for i in range(len(line) - n + 1)) if g != " " and not (n == 3 and g[1] == " "))
    code = lambda g: sum((0 if c == " " else ord(c)) << 20 * k for k, c in enumerate(reversed(g))) | len(g) << 60
    return sorted(out, key=lambda g: (-out[g], code(g))), out


def test_languages_by_the_rule(spark, monkeypatch):
    """Profiles and out-of-place distances in plain Python, ties and all."""
    rng = random.Random(12)
    say = {"en": "the and of with for that house".split(), "de": "der und für mit nicht über haus".split(), "fr": "le et de avec pour que maison".split()}
    data = [(i, " ".join(rng.choice(say[k] + say["en"][:2]) for _ in range(rng.randint(1, 25))) + "! 7", k if rng.random() < 0.9 else None) for i, k in enumerate(rng.choices(list(say), k=90))]
    data += [(200, None, "en"), (201, "?", "de"), (202, "a", None), (202, "a", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("held_out", langid.held_out())
    learnt = [(t, k) for i, t, k in data if k and t and zlib.crc32(str(i).encode()) % 4 != 2]
    profile = {}
    for lang in say:
        total = Counter()
        for t, k in learnt:
            if k == lang:
                total.update(brute_grams(t)[1])
        code = lambda g: sum((0 if c == " " else ord(c)) << 20 * k for k, c in enumerate(reversed(g))) | len(g) << 60
        profile[lang] = {g: n for n, g in enumerate(sorted(total, key=lambda g: (-total[g], code(g)))[: langid.TOP])}
    expected = []
    for i, t, _ in data:
        own = brute_grams(t or "")[0][: langid.TOP]
        far = {k: sum(min(langid.TOP, abs(p[g] - n)) if g in p else langid.TOP for n, g in enumerate(own)) for k, p in profile.items()}
        best = min(sorted(far), key=far.get)
        expected.append((i, best, round(1 - far[best] / (len(own) * langid.TOP), 9)) if own else (i, "und", 0.0))
    got = langid.predict(df, langid.profiles(df.where("NOT held_out"))).collect()
    assert sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in got) == sorted(expected)


def brute_prints(texts, low, high, corpus=None):
    """Fingerprints of texts, the lexicon taken from all of them."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    hashed = lambda x, seed=42: xxhash.xxh64(x, seed=seed).intdigest()

    def of_list(xs):
        h = 42
        for x in xs:
            h = hashed((x & (1 << 64) - 1).to_bytes(8, "little"), h)
        return h

    terms_of = lambda texts: [sorted({signed(hashed(w.encode())) for w in re.split(r"[^\w]+|_", (t or "").lower()) if w}) for t in texts]
    terms, corpus = terms_of(texts), texts if corpus is None else corpus
    count = Counter(x for t in terms_of(corpus) for x in t)
    lexicon = {x for x, n in count.items() if n > 1 and low * len(corpus) <= n <= high * len(corpus)}
    out = []
    for t, own in zip(texts, terms):
        chosen = [x for x in own if x in lexicon]
        chosen = chosen if len(chosen) >= imatch.FEWEST else own
        prints = [of_list(chosen)]
        subsets = [chosen] * imatch.SEEDS
        for r in imatch.RATES:
            for s in range(imatch.SEEDS):
                bits = lambda x, s=s: (x if s < 4 else hashed((x & (1 << 64) - 1).to_bytes(8, "little"))) & (1 << 64) - 1
                subsets[s] = [x for x in subsets[s] if not bits(x) >> 16 + 10 * (s % 4) + r - 1 & 1]
                prints.append(of_list(subsets[s]) if subsets[s] else None)
        out.append(prints if own else [hashed((t or "").encode())])
    return out


def test_fingerprints_by_the_rule(spark, tmp_path):
    """The query's columns against plain Python: edits, nulls, repeated rows, ties, long texts, other columns."""
    rng = random.Random(7)
    pool = [f"w{i}" for i in range(400)] + ["é日", "Ünder"]
    weights = [1 / (k + 1) for k in range(len(pool))]
    texts = [" ".join(rng.choices(pool, weights, k=rng.randint(0, 60))) for _ in range(80)] + [None, "", "!!", "Aé" * 3001, "x y", "x y"]
    rows = [(i * 3, t, "prints") for i, t in enumerate(texts)] + [(0, texts[0], "prints")]
    spark.createDataFrame(rows, "doc_id long, text string, prints string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(queries.op2_imatch_fingerprints(spark, str(tmp_path)).collect(), key=lambda r: (-r["doc_id"], r["edited_sha256"]))
    order = sorted(((i, t or "") for i, t, _ in rows), key=lambda x: -x[0])
    every = [t for _, t in order]
    edited = [t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][1][: len(t) // 2] for k, (_, t) in enumerate(order)]
    own = brute_prints(every, imatch.LOW, imatch.HIGH)
    others = brute_prints(edited, imatch.LOW, imatch.HIGH, every)  # edited texts by the lexicon of the texts
    shown = lambda p: "-".join("." if x is None else f"{x:x}" for x in p)
    assert len(got) == len(order)
    for r, (i, t), p, e, q in zip(got, order, own, edited, others, strict=True):
        assert r["edited_fingerprint"] == shown(q).lower()
        assert (r["doc_id"], r["n_chars"], r["fingerprint"]) == (i, len(t), shown(p).lower())
        assert r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
    for k, r in enumerate(got):
        mine, other = r["fingerprint"].split("-"), r["edited_fingerprint"].split("-")
        after = got[(k + 1) % len(got)]["fingerprint"].split("-")
        for name, x, y in (("near_edited", mine, other), ("near_next", mine, after)):
            wide = max(len(x), len(y))
            x, y = x + ["."] * (wide - len(x)), y + ["."] * (wide - len(y))
            some = [(a, b) for a, b in zip(x, y) if (a, b) != (".", ".")]
            assert r[name] == pytest.approx(sum(a == b for a, b in some) / len(some) if some else 0.0)


def test_grams_of_mixed_letters():
    data = np.frombuffer("Ab a".encode(), np.uint8)
    codes, doc, which = langid.grams(data, np.array([0, 4]))
    pack = lambda s: sum((0 if c == " " else ord(c)) << 20 * k for k, c in enumerate(reversed(s))) | len(s) << 60
    count = dict(zip(codes.tolist(), np.bincount(which).tolist()))
    assert count == {pack(g): n for g, n in {"a": 2, "b": 1, " a": 2, "ab": 1, "b ": 1, "a ": 1, " ab": 1, "ab ": 1, " a ": 1}.items()}


def test_every_operator_has_its_query():
    names = sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert set(queries.ORACLE) <= set(queries.QUERIES)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_their_twins(spark, name):
    import duckdb

    small, con = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    twin = con.sql(queries.ORACLE[name])
    columns = sorted(twin.columns)
    ours = queries.QUERIES[name](spark, small)
    assert sorted(ours.columns) == columns
    assert sorted(map(repr, map(tuple, ours.select(*columns).collect()))) == sorted(map(repr, con.sql(f"SELECT {', '.join(columns)} FROM twin").fetchall()))


def test_slices_are_cut_by_bytes():
    """Batches of packed texts are unpacked a slice at a time, not a number of rows at a time."""
    import pyarrow as pa
    import zstandard

    from termloom.llm.words import packed_slices

    packer = zstandard.ZstdCompressor(level=1)
    plain = [b"ab" * 300, None, b"", b"x" * 5000, b"yy", b"z" * 900]
    column = pa.array([None if x is None else packer.compress(x) for x in plain], pa.binary())
    got = list(packed_slices(column, 1000))
    assert [x for _, part in got for x in part] == plain and [row for row, _ in got] == [0, 3, 4]


@pytest.mark.parametrize("which", ["superkmer", "warc"])
def test_many_long_texts_in_a_batch_keep_memory(which):
    """Three hundred texts of 8 MB in one batch: what a worker holds stays under 500 MB."""
    import subprocess
    import sys

    code = """
import resource, sys
import pyarrow as pa, zstandard, hashlib
from termloom.llm import superkmer, warc
text = ("word " * (8 * 1024 * 1024 // 5)).encode()
blob = zstandard.ZstdCompressor(level=3).compress(text)
n = 300
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
if sys.argv[1] == "superkmer":
    ranges = pa.array([None] * n, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([blob] * n), ranges], names=["own", "stored", "ranges"])
    rows = sum(b.num_rows for b in superkmer._keep(iter([batch])))
else:
    digest = hashlib.sha256(text).hexdigest()
    batch = pa.RecordBatch.from_arrays([pa.array(["h"] * n), pa.array([digest] * n), pa.array([blob] * n)], names=["header", "named", "stored"])
    rows = sum(b.num_rows for b in warc._restore(iter([batch])))
assert rows == n
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss) // 1024)
"""
    if which == "superkmer":
        code = code.replace("n = 300", "n = 40")  # as long a batch, and a tenth of the time
    out = subprocess.run([sys.executable, "-c", code, which], capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) < 500


def test_slices_of_wide_vectors_keep_memory():
    """768 components: bits are spread an attribute at a time, and a block's side follows the width."""
    import tracemalloc

    block, group = bitslice.tile(10**9, 2 * 10**7, 1000, 768)
    assert block * 768 <= bitslice.TILE_NUMBERS and group * 768 <= bitslice.TILE_NUMBERS
    values = np.random.default_rng(1).integers(-300, 300, (block, 768))
    tracemalloc.start()
    s = bitslice.slices_of(values)
    assert tracemalloc.get_traced_memory()[1] < s.nbytes + (40 << 20)
    tracemalloc.stop()
    bits = np.unpackbits(s.view(np.uint8), axis=2, bitorder="little")[:, :, : len(values)].astype(np.int64)
    weights = 1 << np.arange(s.shape[1])
    weights[-1] *= -1
    assert ((bits * weights[None, :, None]).sum(axis=1).T == values).all()
