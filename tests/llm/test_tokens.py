"""Token files and packing: exact round trips."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from termloom.llm import pow2pack, simple8b, tokens
from termloom.llm.words import text_slices

FILES = [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)]
ODD = ["", " ", "don't. he'll,x", "a.Σ Σa", "<|endoftext|> x", "x  y", "it's. I'VE?no", "\n\n x", "end \n", "日本。語", None, "ab " * 3000]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 70000) | st.just(0), max_size=700))
def test_coding_is_exact(values):
    v = np.array(values, np.uint64)
    words, blocks = simple8b.encode(v)
    assert (simple8b.decode(words, blocks, len(v)) == v).all() and len(blocks) == -(-len(v) // simple8b.BLOCK)


def test_small_ids_are_small():
    v = np.full(10_000, 300, np.uint64)
    assert len(simple8b.encode(v)[0]) <= 10_000 / 6 + 200


@pytest.mark.parametrize("name, blanks", FILES)
@settings(max_examples=30, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("ab Z.,'\n\t é—Σ<|>0٣!日\r\x0b\xa0 "), max_size=30), max_size=8))
def test_encoder_equals_the_library(name, blanks, texts):
    import pyarrow as pa

    path = public_tokenizers.path(name)
    whole = Tokenizer.from_file(path)
    column = pa.array([*texts, *ODD], pa.string())
    own = tokens.encoder(path, blanks)
    for row, end, data, offsets in text_slices(column, 200):
        ids, first = own.encode(column.slice(row, end - row), data, offsets)
        for i in range(end - row):
            assert ids[first[i] : first[i + 1]].tolist() == whole.encode(column[row + i].as_py() or "", add_special_tokens=False).ids


def test_table_starts_anew(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "REMEMBERED", 4)
    own = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), True)
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    column = pa.array([" ".join(f"w{i}" for i in range(k, k + 9)) for k in range(0, 30, 3)])
    for row, end, data, offsets in text_slices(column, 30):
        ids, first = own.encode(column.slice(row, end - row), data, offsets)
        assert ids.tolist() == [x for i in range(row, end) for x in whole.encode(column[i].as_py(), add_special_tokens=False).ids]


def docs(spark, pairs):
    return spark.createDataFrame([(i, t, 7) for i, t in pairs], "doc_id long, text string, ids long")


PAIRS = [(5, "five words are in here"), (-3, None), (1, ""), (2, "x y " * 2000), (9, "last"), (9, "last"), (4, "don't <|endoftext|>")]


def test_files_in_order(spark):
    name, blanks = FILES[0]
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    files = simple8b.write_ids(docs(spark, PAIRS), public_tokenizers.path(name), blanks, 1)
    got = sorted(map(tuple, simple8b.read_ids(files).select("doc_id", "start", "n_tokens", "ids").collect()))
    expected, at = [], 0
    for i, t in sorted(PAIRS, key=lambda p: p[0]):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        expected.append((i, at, len(ids), np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert [(a, b, c, bytes(d)) for a, b, c, d in got] == sorted(expected)
    assert simple8b.read_ids(simple8b.write_ids(docs(spark, []), public_tokenizers.path(name), blanks, 1)).count() == 0


def test_null_ids_come_first(spark):
    name, blanks = FILES[0]
    files = simple8b.write_ids(docs(spark, [(1, "a"), (None, "b c")]), public_tokenizers.path(name), blanks, 1)
    assert {r["doc_id"]: r["start"] for r in simple8b.read_ids(files).collect()} == {None: 0, 1: 3}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5000), min_size=1, max_size=20))
def test_cuts(lengths):
    doc, start, length = pow2pack.cuts(np.array(lengths), 1024)
    for i, n in enumerate(lengths):
        s, k = start[doc == i], length[doc == i]
        assert k.sum() == n and (s == k.cumsum() - k).all() and all(x & (x - 1) == 0 and x <= 1024 for x in k.tolist())
        rest = k[k < 1024]
        assert len(set(rest.tolist())) == len(rest)


def test_packing(spark):
    name, blanks = FILES[1]
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    found = pow2pack.number_sequences(pow2pack.pieces(docs(spark, PAIRS), public_tokenizers.path(name), blanks, 0)).collect()
    assert sorted(r["sequence_id"] for r in found) == list(range(len(found)))
    lengths = [r["length"] for r in sorted(found, key=lambda r: r["sequence_id"])]
    assert lengths == sorted(lengths, reverse=True)  # a bucket is one range of ids
    for i, t in PAIRS[:5]:
        if i == 9:
            continue
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted((r for r in found if r["doc_id"] == i), key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in own) == np.array(ids, "<u4").tobytes()
        assert {r["doc_tokens"] for r in own} == {len(ids)} and {r["offset"] for r in own} == {0}
    assert zlib.crc32(b"") == 0
    assert pow2pack.number_sequences(pow2pack.pieces(docs(spark, []), public_tokenizers.path(name), blanks, 0)).count() == 0


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("name, blanks", FILES)
@pytest.mark.parametrize("flat", [False, True])
def test_pieces_that_share_a_code(name, blanks, flat, monkeypatch):
    """Words on which linear hashes collide, and codes that collide by force: equality is decided by bytes."""
    import pyarrow as pa

    if flat:
        real = tokens.span_codes
        monkeypatch.setattr(tokens, "span_codes", lambda *a: np.where(real(*a) >= np.uint64(tokens.HASHED), np.uint64(tokens.HASHED), real(*a)))
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    own = tokens.Encoder(public_tokenizers.path(name), blanks)
    column = pa.array([f"{x} b {y} longerword otherword" for n in (1024, 2048) for x, y in (thue_morse(n), thue_morse(n)[::-1])] + ["", "longerword", "otherword and"])
    for row, end, data, offsets in text_slices(column, 5000):
        ids, first = own.encode(column.slice(row, end - row), data, offsets)
        for i in range(end - row):
            assert ids[first[i] : first[i + 1]].tolist() == whole.encode(column[row + i].as_py(), add_special_tokens=False).ids
