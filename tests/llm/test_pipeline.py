"""The pipeline against a brute-force version of all its stages."""

import hashlib
import importlib
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from termloom.llm import mixing, queries

sys.path.insert(0, str(Path(__file__).parent))
dedup = importlib.import_module("test_dedup")


@pytest.fixture(scope="module")
def data():
    rng = random.Random(6)
    say = {"en": "the and of with for that is this".split(), "de": "der und für mit nicht über ist das".split()}
    line = "this line of more than twenty characters comes again"
    rows = []
    for i in range(90):
        lang = rng.choice(list(say))
        words = [rng.choice(say[lang]) + str(rng.randrange(9)) * rng.randrange(2) for _ in range(rng.randint(20, 60))]
        text = " ".join(words[:15]) + ("\n" + line if rng.random() < 0.3 else "") + "\n" + " ".join(words[15:])
        rows.append((i, text, lang, f"src{rng.randrange(20)}", len(text)))
    rows += [(100 + k, rows[k][1], rows[k][2], "src0", rows[k][4]) for k in range(6)]
    rows += [(110 + k, rows[k][1] + " more", rows[k][2], "src1", rows[k][4] + 5) for k in range(6)]
    return rows + [(200, None, "en", "src0", None), (201, "123 456", "en", "src0", 7), (202, "", None, "src3", 0), (203, "the and of with", None, None, 15)]


def brute(rows):
    # language: every text with a letter scores well over the floor here
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    kept = {i: text for i, _, _, text in dedup.brute_lines([(r[0], r[1]) for r in rows])}
    rows = [(r[0], kept[r[0]], r[2], r[3]) for r in rows]
    near = {i: k for i, _, _, k in dedup.brute_near([(r[0], r[1]) for r in rows])}
    rows = [r for r in rows if near[r[0]]]
    domain = {s: d for d, ss in queries._SOURCES.items() for s in ss}
    leaf, count = {}, {}
    for i, text, lang, source in rows:
        path = (domain.get(source), lang, source)
        if path in set(mixing.leaves(queries.MIX)):
            leaf.setdefault(path, []).append(i)
            count[i] = len((text or "").split())
    supply = {p: sum(count[i] for i in ids) for p, ids in leaf.items()}
    given = mixing.allocate(queries.MIX, supply, sum(supply.values()) * 900_000 // 1_000_000)
    taken, text_of = set(), {i: text for i, text, _, _ in rows}
    for path, ids in leaf.items():
        full, rest = divmod(given.get(path, 0), supply[path]) if supply[path] else (0, 0)
        for i in sorted(ids, key=lambda i: hashlib.md5(f"7|{full}|{i}".encode()).hexdigest()):
            if full or min(count[i], rest) > 0:
                taken.add(i)
            if not full and 0 < rest < count[i]:  # cut where the budget ends
                text_of[i] = re.match(rf"(?:[ \t-\r]*[^ \t-\r]+){{{rest}}}", text_of[i])[0]
            rest = max(0, rest - count[i])
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for i, _, _, _ in rows:
        if i in taken:
            ids, at = [*tokenizer.encode(text_of[i], add_special_tokens=False).ids, 0], 0
            lengths = [1024] * (len(ids) // 1024) + [1 << k for k in range(9, -1, -1) if len(ids) % 1024 >> k & 1]
            for n in lengths:
                out.append((i, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids)))
                at += n
    return sorted(out)


def test_pipeline(spark, data, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(tuple(r[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")) for r in got) == brute(data)
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))


def test_stages_keep_the_columns(spark, data):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in (data, []):
        df = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, df, "").columns == list(corpus_pipeline.COLUMNS)
            if not rows:
                assert stage(spark, df, "").count() == 0


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, long, "en", "a", 1), (5, long + " x", "en", "b", 2), (5, other, "en", "c", 3), (7, other + " y", "de", "d", 4), (9, None, None, None, None), (9, None, None, None, None), (None, long, "en", "e", 5)]
    rows += [(11, "repeated words of one row", "en", "f", 6)] * 3
    got = corpus_pipeline.near(spark, spark.createDataFrame(rows, schema), "").collect()
    assert sorted((str(r["doc_id"]), r["source"] or "") for r in got) == [("1", "a"), ("11", "f"), ("5", "c"), ("9", ""), ("None", "e")]


def test_unlike_texts_are_rejected(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, "the and of with for that is this", "en", "src0", 30) for i in range(8)] + [(20, "где кто мир ночь", None, "src0", 15), (21, "ζηθ the", "en", "src0", 7)]
    got = corpus_pipeline.language(spark, spark.createDataFrame(rows, schema), "").collect()
    assert 20 not in {r["doc_id"] for r in got} and {0, 21} <= {r["doc_id"] for r in got}


def test_the_budget_holds_to_the_token(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, " a\tb  c d\ne f g ", "en", "src0", 16) for i in range(9)]
    got = corpus_pipeline.mixture(spark, spark.createDataFrame(rows, schema), "").collect()
    assert sum(len(r["text"].split()) for r in got) == 63 * 9 // 10 and sorted(len(r["text"].split()) for r in got) == [7] * 8
    rows = rows[:7]
    got = corpus_pipeline.mixture(spark, spark.createDataFrame(rows, schema), "").collect()
    cut = [r for r in got if len(r["text"].split()) < 7]
    assert sum(len(r["text"].split()) for r in got) == 49 * 9 // 10 and [(r["text"], r["n_chars"]) for r in cut] == [(" a\tb", 4)]
