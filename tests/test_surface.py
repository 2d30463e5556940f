"""The data source, the stream of new files and the table function."""

import math
import re
from collections import Counter

import pytest

from termloom import surface
from termloom.sources import folder_source


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "files"
    (at / "deep").mkdir(parents=True)
    (at / "a.txt").write_text("one text")
    (at / "b.HTML").write_text("<p>two</p>")
    (at / "c.md").write_text("# three")
    (at / "bad.docx").write_bytes(b"no container")
    (at / "skipped.bin").write_bytes(b"x")
    (at / "empty.txt").write_text("")
    (at / "deep" / "d.txt").write_text("four")
    return at


@pytest.mark.parametrize("size", [1, 10, 1 << 20])
def test_folders_are_read_by_format(spark, folder, size):
    folder_source.register(spark)
    read = spark.read.format("termloom").option("bytesPerTask", size)
    rows = {r["file_name"]: r for r in read.load(str(folder)).collect()}
    assert {n: r["text"] for n, r in rows.items()} == {"a.txt": "one text", "b.HTML": "two", "c.md": "three", "bad.docx": None, "empty.txt": ""}
    assert rows["bad.docx"]["error"].startswith("BadZipFile") and all(r["error"] is None for n, r in rows.items() if n != "bad.docx")
    assert rows["a.txt"]["file_size"] == 8 and rows["b.HTML"]["file_type"] == "html"
    assert read.option("recursive", "true").load(str(folder)).count() == 6
    assert [r["text"] for r in read.load(f"file://{folder}/a.txt").collect()] == ["one text"]
    assert read.load(str(folder)).rdd.getNumPartitions() == {1: 6, 10: 5, 1 << 20: 1}[size]  # sizes 8, 10, 12, 7, 4 and 0


def test_an_empty_folder_has_no_rows(spark, tmp_path):
    folder_source.register(spark)
    assert spark.read.format("termloom").load(str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="path"):
        spark.read.format("termloom").load().count()


def test_new_files_come_once(spark, folder, tmp_path):
    def run():
        found = folder_source.new_documents(spark, str(folder))
        found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["path"].rsplit("/", 1)[1], r["text"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = run()
    assert first == [("a.txt", "one text"), ("b.HTML", "two"), ("bad.docx", None), ("c.md", "three")]
    (folder / "again.txt").write_text("one text")
    (folder / "new.txt").write_text("five")
    assert run() == sorted([*first, ("new.txt", "five")])
    assert run() == sorted([*first, ("new.txt", "five")])


def expected(s, longest):
    counts = Counter()
    for run in re.split(r"[.,;!?]", s):
        words = run.split()
        counts.update(" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1))
    out = {}
    for t, n in counts.items():
        held = [m for u, m in counts.items() if t != u and t in u and len(t) > 1]
        out[t] = (n, round(max(0.0, math.log2(len(t) + 1) * (n - (sum(held) / len(held) if held else 0))), 9))
    return out


def test_terms_by_sql(spark):
    surface.register_functions(spark)
    texts = [(1, "gas fuel engine, gas fuel valve; gas fuel engine", "x"), (2, None, "y"), (3, "", "y"), (4, "a b a b a", None)]
    spark.createDataFrame(texts, "doc_id long, text string, source string").createOrReplaceTempView("surface_docs")
    for longest in (3, 1):
        rows = spark.sql(f"SELECT * FROM termloom_terms(TABLE(surface_docs), {longest})").collect()
        assert {r["doc_id"] for r in rows} == {1, 4} and {r["source"] for r in rows} == {"x", None}
        for i, s, _ in (texts[0], texts[3]):
            assert {r["term"]: (r["frequency"], round(r["c_value"], 9)) for r in rows if r["doc_id"] == i} == expected(s, longest)
    best = spark.sql("SELECT doc_id, max_by(term, c_value) AS t FROM termloom_terms(TABLE(SELECT doc_id, text FROM surface_docs)) GROUP BY doc_id ORDER BY doc_id").collect()
    assert [r["t"] for r in best][0] == "gas fuel engine"
    for bad in ("termloom_terms(1)", "termloom_terms(TABLE(SELECT 1 AS x))", "termloom_terms(TABLE(SELECT 'a' AS text, 1 AS term))", "termloom_terms(TABLE(surface_docs), 0)"):
        with pytest.raises(Exception):
            spark.sql(f"SELECT * FROM {bad}").collect()
