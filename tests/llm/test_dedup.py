"""Line dedup, substring dedup and near-dedup against plain Python."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import zstandard
from pyspark.sql import functions as F

from termloom.llm import components, linededup, minhash, superkmer
from termloom.llm import words as minhash_words

DOCS = "doc_id long, text string, pos string, h long"
LONG = "A line that is longer than twenty characters"


def rows(spark, pairs):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in pairs], DOCS)


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", s or "")


def brute_lines(pairs):
    key = lambda line: lower(line.strip(" \t\n\x0b\f\r"))
    holders = {}
    for i, t in pairs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in pairs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 3 and max(holders[key(x)]) != i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def line_result(df):
    return sorted((r["doc_id"], r["__n_lines"], r["__n_dropped"], r["__kept"]) for r in linededup.dedup_lines(df).collect())


def test_line_dedup_of_odd_texts(spark):
    long_doc = "\n".join([LONG] * 200 + [f"line number {i} of a very long text" for i in range(200)])
    pairs = [(1, LONG), (2, f"  {LONG.upper()}\t\nshort\n{LONG}"), (3, f"own\n{LONG}"), (4, None), (5, ""), (6, "\n\n"), (7, long_doc), (8, "É" + LONG), (9, "é" + LONG), (10, "É" + LONG.upper()), (11, "É" + LONG)]
    assert line_result(rows(spark, pairs)) == brute_lines(pairs)


def test_line_dedup_of_repeated_rows_and_null_ids(spark):
    pairs = [(1, LONG), (1, LONG), (1, LONG + "\nb"), (2, LONG)]
    assert line_result(rows(spark, pairs)) == brute_lines(pairs)  # two documents hold it
    got = linededup.dedup_lines(rows(spark, [(None, LONG), (1, LONG), (2, LONG)])).collect()
    assert {r["doc_id"]: r["__kept"] for r in got} == {None: "", 1: "", 2: LONG}


def test_line_dedup_random(spark):
    rng = random.Random(3)
    pool = [LONG + str(i) for i in range(12)] + ["x", "", "  "]
    pairs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 150)))) for i in range(40)]
    assert line_result(rows(spark, pairs)) == brute_lines(pairs)


def test_bitmaps_hold_dropped_words_only(spark):
    text = "\n".join(["a" * 30 + str(i) for i in range(130)] + [LONG])
    maps = linededup.drop_bitmaps(rows(spark, [(1, text), (2, LONG), (3, LONG)])).collect()
    assert {r["doc"]: [tuple(b) for b in r["bits"]] for r in maps} == {1: [(2, 4)], 2: [(0, 1)]}


@pytest.mark.parametrize("make", [linededup.dedup_lines, superkmer.dedup_windows, minhash.near_duplicates])
def test_empty_tables(spark, make):
    assert make(rows(spark, [])).count() == 0


def brute_windows(pairs, size):
    first = {}
    for i, t in pairs:
        w = words(t)
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, i), i) if i is not None else first.get(key)
    out = []
    for i, t in pairs:
        w = words(t)
        dead = set()
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                dead.update(range(k, k + size))
        out.append((i, len(w), len(dead), " ".join(x for k, x in enumerate(w) if k not in dead)))
    return sorted(out)


def window_result(df, size):
    return sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in superkmer.dedup_windows(df, size).collect())


def test_window_dedup(spark, monkeypatch):
    monkeypatch.setattr(superkmer, "BUCKET_BYTES", 2000)
    rng = random.Random(5)
    pool = [" ".join(rng.choice("ab cd efg é 日本 the".split()) for _ in range(rng.randint(5, 40))) for _ in range(8)]
    pairs = [(i, "  ".join(rng.choice(pool) + rng.choice(["\n", "\t", " x "]) for _ in range(rng.randint(0, 5)))) for i in range(60)]
    pairs += [(100, None), (101, ""), (102, " \n "), (103, pool[0] * 30), (104, pool[0] * 30), (104, pool[0]), (104, pool[0])]
    for size in (5, 13):
        assert window_result(rows(spark, pairs), size) == brute_windows(pairs, size)


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


def test_windows_of_colliding_words(spark):
    """Words on which linear hashes modulo 2^64 collide, as the one that differs."""
    pairs = []
    for k, n in enumerate((1024, 2048)):
        x, y = thue_morse(n)
        shared = " ".join(f"s{k}w{i}" for i in range(12))
        pairs += [(4 * k, f"{shared} {x}"), (4 * k + 1, f"{shared} {y}"), (4 * k + 2, f"{x} {shared}"), (4 * k + 3, f"{x} {shared}")]
    assert window_result(rows(spark, pairs), 13) == brute_windows(pairs, 13)


def test_windows_whose_hashes_all_collide(spark, monkeypatch):
    monkeypatch.setattr(superkmer, "run_codes", lambda code, size: np.zeros(max(0, len(code) - size + 1), np.uint64))
    rng = random.Random(8)
    pairs = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))) for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs]), pa.array([0] * 40), pa.array([t for _, t in pairs])], names=["d", "m", "t"])
    sent = [x.as_py() for r in superkmer._send([batch], 5, 1) for x in r.column(2)]
    dead = {i: set() for i, _ in pairs}
    for r in superkmer._bucket(sent, 5).to_pylist():
        dead[r["doc"]].update(range(r["lo"], r["hi"]))
    assert [len(dead[i]) for i, _ in pairs] == [n for _, _, n, _ in brute_windows(pairs, 5)]


def test_one_run_in_every_window(monkeypatch):
    """A hot minimiser: its bucket is cut again and again, and no bucket that is gathered is larger than the limit."""
    monkeypatch.setattr(superkmer, "BUCKET_LIMIT", 20_000)
    rng = random.Random(4)
    pairs = [(i, " ".join(f"x y z {rng.choice('abcdefghij')}{rng.randrange(30)}" for _ in range(rng.randint(20, 60)))) for i in range(150)]
    pairs += [(200 + i, pairs[i][1]) for i in range(20)]
    monkeypatch.setattr(superkmer, "_least", lambda values, span, least=superkmer._least: np.zeros(len(values) - span + 1, np.uint64) if span > 5 else least(values, span))
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs]), pa.array([0] * len(pairs)), pa.array([t for _, t in pairs])], names=["d", "m", "t"])
    level, sent = 0, pa.Table.from_batches(superkmer._send([batch], 13, 1))
    gathered, gather, dead = [], superkmer._bucket, {i: set() for i, _ in pairs}

    def watched(blobs, size):
        gathered.append(sum(len(zstandard.ZstdDecompressor().decompress(b)) for b in blobs))
        return gather(blobs, size)

    monkeypatch.setattr(superkmer, "_bucket", watched)
    while sent.num_rows:
        found = pa.Table.from_batches(superkmer._count(sent.sort_by("bucket").to_batches(), 13, level))
        for r in found.filter(pc.is_valid(found["doc"])).to_pylist():
            dead[r["doc"]].update(range(r["lo"], r["hi"]))
        sent, level = found.filter(pc.is_valid(found["packed"])).select(["bucket", "n", "packed"]), level + 1
    assert level > 1 and max(gathered) <= 20_000
    assert [len(dead[i]) for i, _ in pairs] == [n for _, _, n, _ in brute_windows(pairs, 13)]


def test_a_passage_with_very_many_places(spark, monkeypatch):
    """What can't be cut stays in its records, which learn the smallest document of their windows, and is not gathered."""
    monkeypatch.setattr(superkmer, "BUCKET_LIMIT", 2000)
    monkeypatch.setattr(superkmer, "AGAIN", (1.0,))
    monkeypatch.setattr(superkmer, "HELD_BYTES", 1000)
    monkeypatch.setattr(superkmer, "SENT_BYTES", 500)
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(20))
    pairs = [(i, f"{rng.choice('abc')} {passage} " + " ".join(rng.choice("xyz") for _ in range(20))) for i in rng.sample(range(1000), 150)]
    pairs += [(2000, passage + " " + passage)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs]), pa.array([7] * len(pairs)), pa.array([t for _, t in pairs])], names=["d", "m", "t"])
    hot, gathered, dead = 0, [], {i: set() for i, _ in pairs}
    gather = superkmer._bucket
    monkeypatch.setattr(superkmer, "_bucket", lambda blobs, size: gathered.append(sum(len(zstandard.ZstdDecompressor().decompress(b)) for b in blobs)) or gather(blobs, size))
    level, sent = 0, pa.Table.from_batches(superkmer._send([batch], 13, 2))
    while sent.num_rows:
        if level > 1:
            hot = sent.num_rows
            rows = [r.asDict() for r in superkmer._hot_ranges(spark.createDataFrame([(bytes(x),) for x in sent["packed"].to_pylist()], "packed binary"), 13).collect()]
            sent = sent.slice(0, 0)
        else:
            found = pa.Table.from_batches(superkmer._count(sent.sort_by("bucket").to_batches(), 13, level))
            rows = found.filter(pc.is_valid(found["doc"])).to_pylist()
            sent, level = found.filter(pc.is_valid(found["packed"])).select(["bucket", "n", "packed"]), level + 1
        for r in rows:
            assert r["mark"] == 7
            dead[r["doc"]].update(range(r["lo"], r["hi"]))
    assert hot and max(gathered, default=0) <= 2000
    expected = {i: n for i, _, n, _ in brute_windows(pairs, 13)}
    assert {i: len(x) for i, x in dead.items()} == expected


def brute_near(pairs, size=5, percent=75):
    sets = []
    for i, t in pairs:
        w = words(lower(t or ""))
        sets.append((i, {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()))
    comp = {i: i for i, _ in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                comp[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def near_result(df):
    return sorted(tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in minhash.near_duplicates(df).collect())


def test_near_duplicates_of_families(spark):
    """Families whose members lie on both sides of the threshold, chains that only other members link, and copies."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    pairs, n = [], 0
    for _ in range(6):
        base = [word() for _ in range(60)]
        for _ in range(10):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(60)] = word()
            pairs.append((n, " ".join(own)))
            n += 1
    chain = [word() for _ in range(80)]
    for k in range(8):  # each shares enough with the next alone
        pairs.append((n, " ".join(chain[k * 4 :] + [word() for _ in range(0)])))
        n += 1
    pairs += [(n, None), (n + 1, ""), (n + 2, "one two"), (n + 3, "ONE  two"), (n + 4, pairs[3][1].upper()), (n + 5, "x " * 5000)]
    rng.shuffle(pairs)
    assert near_result(rows(spark, pairs)) == brute_near(pairs)


@pytest.mark.parametrize("bound", [("CHUNK", 16), ("CHUNK_BYTES", 2000)])
def test_near_duplicates_of_one_large_group(spark, monkeypatch, bound):
    """Chunks of a group are bounded by members and by bytes of their sets; neither changes the result."""
    monkeypatch.setattr(minhash, *bound)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(50)]
    pairs = [(i, " ".join(w if rng.random() > 0.06 else f"u{rng.random()}" for w in base)) for i in range(120)]
    assert near_result(rows(spark, pairs)) == brute_near(pairs)


def test_near_duplicates_of_colliding_words(spark):
    """Words on which linear hashes modulo 2^64 collide make different sets."""
    pairs = []
    for n in (1024, 2048):
        pairs += [(len(pairs) + k, x) for k, x in enumerate(thue_morse(n))]
        pairs += [(len(pairs) + k, f"{x} b c d e") for k, x in enumerate(thue_morse(n))]
    assert near_result(rows(spark, pairs)) == brute_near(pairs)


def test_shingles_are_compared_as_words(monkeypatch):
    monkeypatch.setattr(minhash_words, "span_codes", lambda d, s, e: np.full(len(s), minhash_words.HASHED, np.uint64))
    texts = ["one two three four five six", "one two three four five seven", "ONE two three four five six", "", "one two"]
    _, _, data, offsets = next(minhash_words.text_slices(pa.array(texts)))
    names, first, kinds = minhash_words.shingle_names(minhash_words.words_of(data, offsets, True), 5)
    sets = [set(names[a:b].tolist()) for a, b in zip(first, first[1:])]
    assert sets[0] == sets[2] and len(sets[0] & sets[1]) == 1 and len(sets[0] | sets[1]) == 3 and not sets[3] and len(sets[4]) == 1 and max(names) < kinds


def test_one_leader_of_many():
    """A leader's candidates in several groups, in slices that begin amid a group."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(40)]
    pairs = [(i, " ".join([*base, f"u{i}"] if not i or rng.random() > 0.3 else [rng.choice(base + [f"v{rng.randrange(50)}"]) for _ in base])) for i in range(80)]
    table = pa.table({"a": [0] * 80, "salt": [0] * 80, "b": [None, *range(1, 80)], "text": [t for _, t in pairs]})
    got = [r["b"] for r in pa.Table.from_batches(minhash._confirm(iter(table.to_batches(7)), 5, 75)).to_pylist()]
    link = {i: {tuple(words(lower(t))[k : k + 5]) for k in range(len(words(t)) - 4)} for i, t in pairs}
    assert got == [i for i in range(1, 80) if 100 * len(link[0] & link[i]) >= 75 * len(link[0] | link[i])] and len(got) > 20


def test_null_ids_and_repeated_rows_are_kept(spark):
    t = " ".join(f"w{i}" for i in range(20))
    got = near_result(rows(spark, [(5, t), (5, t), (7, t)]))
    assert got == [(5, 16, 5, True), (5, 16, 5, True), (7, 16, 5, False)]
    r = minhash.near_duplicates(rows(spark, [(None, t), (1, t)])).where("doc_id IS NULL").first()
    assert r["kept"] and r["component_id"] is None


def test_estimate_of_equal_and_unlike_sets(spark):
    docs = rows(spark, [(1, " ".join(f"a{i}" for i in range(200))), (2, " ".join(f"a{i}" for i in range(200)) + " b"), (3, " ".join(f"c{i}" for i in range(200)))])
    s = minhash.signatures(docs).select("doc", "bits")
    got = {(r["x"], r["y"]): r["e"] for r in s.toDF("x", "bx").crossJoin(s.toDF("y", "by")).select("x", "y", minhash.estimate(F.col("bx"), F.col("by")).alias("e")).collect()}
    assert got[1, 1] == 1.0 and got[1, 2] > 0.9 and got[1, 3] < 0.2


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(200, 200 + i) for i in range(1, 30)]
    comp = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(len(comp)):
        for a, b in edges:
            if a != b:
                comp[a] = comp[b] = min(comp[a], comp[b])
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["comp"] for r in got} == comp


def test_digests_of_kept_texts(spark):
    got = superkmer.dedup_windows(rows(spark, [(1, " a\tb ")])).select(F.sha2("kept", 256)).first()[0]
    assert got == hashlib.sha256(b"a b").hexdigest()
