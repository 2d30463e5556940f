"""Readers, sinks, settings, command lines and what users build on."""

import json
import re
import threading
import urllib.error
import urllib.request
import zlib

import pytest
from pyspark.sql import functions as F

from termloom import cli, config, surface
from termloom.operators import chunkers
from termloom.plans import build, extract
from termloom.sources import provider, readers, shared, sinks


def pdf(*pages, deflated=False):
    out = b"%PDF-1.4\n"
    for k, text in enumerate(pages):
        body = b"BT /F1 12 Tf " + b" ".join(b"(%s) Tj 0 -14 Td" % line.encode("latin-1") for line in text.split("\n")) + b" ET"
        body = zlib.compress(body) if deflated else body
        out += b"%d 0 obj << /Length %d >> stream\n%s\nendstream endobj\n" % (k + 1, len(body), body)
    return out


@pytest.mark.parametrize("deflated", [False, True])
def test_pdf_options(deflated):
    raw = pdf("one\ntwo \\(x\\)", "", "three", deflated=deflated)
    assert readers.parse("pdf", raw) == "one\ntwo (x)\n\nthree"
    assert readers.parse("pdf", raw, readers.Options(page_marks=True, joiner="\n")) == "[Page 1]\none\ntwo (x)\n[Page 3]\nthree"
    with pytest.raises(Exception):
        readers.parse("pdf", b"%PDF-1.4 nothing")


def test_pages_are_repaired():
    assert readers.rejoined("アン\nモニア 6L28\nADF") == "アンモニア 6L28ADF"


def test_a_failing_parser_gives_way(monkeypatch):
    def fails(raw):
        raise ValueError("broken")

    monkeypatch.setattr(readers, "_pypdf", fails)
    assert readers.parse("pdf", pdf("text")) == "text"
    monkeypatch.setattr(readers, "_pypdf", lambda raw: ["first"])
    assert readers.parse("pdf", pdf("text")) == "first"


def test_decoding():
    raw = "～①".encode("cp932")
    assert readers.decode(raw, readers.MORE_TRIALS) == "～①"
    with pytest.raises(ValueError):
        readers.decode(b"\xff\xfe\xfd", readers.TWO_TRIALS, strict=True)
    assert readers.decode(b"a\xff", ("utf-8",)) == "a"
    assert readers.parse("text", "漢".encode("euc-jp")) != "" and readers.parse("text", b"a\xff", readers.Options(trials=())) == "a"


def test_markdown_and_html_options():
    source = "# T[^n]\n\n```py\nx = 1\n```\n[^n]: a note\n"
    assert readers.markdown_text(source, keep_code=True, footnotes=True) == "Tn\n[CODE: x = 1]\na note"
    assert readers.markdown_text("a\n\nb") == "a\nb"
    page = "<p>a<b>b</b></p><nav>n</nav>"
    assert readers.html_text(page, "") == "abn" and readers.html_text(page, dropped=("nav",)) == "a\nb"


def test_html_lines_equal_their_twin(spark):
    """A reference cut off before its semicolon, a ``<`` that begins no tag, a null and an empty page."""
    import duckdb

    from termloom.plans.catalog import ORACLE

    pages = ["<title>token = &quot</title>a &quot;b&quot; &amp;&amp c &copy; &am &copy", "x<br>a < b", None, "", "<p>&amp;quot;</p><!-- x --><p", "<script>a < b</script>c<!-- d -->e"]
    rows = list(enumerate(pages))
    made = spark.createDataFrame(rows, "page_id long, html string")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    found = readers.html_lines(made).select("page_id", F.md5("text").alias("text_md5"), "n_lines").collect()
    assert {tuple(r) for r in found} == set(con.sql(ORACLE["html_text_lines"]).fetchall())
    assert readers.html_text("a &quot b") == 'a " b'


def test_word_tables():
    import io
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = f"<w:document {w}><w:body><w:p><w:r><w:t>para</w:t></w:r></w:p><w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr></w:tbl></w:body></w:document>"
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", body)
    assert readers.parse("word", held.getvalue()) == "para\n\na | b"
    assert readers.parse("word", held.getvalue(), readers.Options(tables=False)) == "para"


def test_review_has_a_mark(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0)], "term string, perplexity double")
    sinks.write_review(rows, str(tmp_path / "r"))
    raw = next((tmp_path / "r").glob("*.csv")).read_bytes()
    assert raw.startswith("﻿term,perplexity".encode())


def test_json_has_facts_of_the_run(spark, tmp_path):
    rows = spark.createDataFrame([("f", "a", "d", 0.5, 2, ["1", "2", "3", "4"])], "file_path string, term string, definition string, score double, frequency long, contexts array<string>")
    sinks.write_json(rows, str(tmp_path / "o"), extractor="statistical")
    facts = json.loads(next((tmp_path / "o/metadata").glob("*.json")).read_text())["metadata"]
    assert (facts["total_terms"], facts["unique_terms"], facts["extractor"]) == (1, 1, "statistical")
    assert len(json.loads(next((tmp_path / "o/results").glob("*.json")).read_text())["terms"][0]["contexts"]) == 3


def test_settings(tmp_path):
    path = tmp_path / "c.yml"
    path.write_text("llm:\n  model: x # not ours\nembedding:\n  batch_size: 7\nfilters:\n  min_freq: 3\nchunks:\n  size: 50\n  overlap: 5\nlanguage:\n  profile: 'japanese'\nparallelism: 2\n")
    got = config.load(str(path))
    assert (got.batch_size, got.min_frequency, got.chunk_size, got.overlap, got.profile) == (7, 3, 50, 5, config.JAPANESE)
    assert config.EngineConfig() == config.EngineConfig(**vars(config.EngineConfig()))
    with pytest.raises(ValueError):
        config.parse_yaml("nonsense")


def test_settings_act(spark):
    docs = spark.createDataFrame([(1, "alpha beta alpha beta gamma. " * 3)], "doc_id long, text string")
    few = extract.scored_terms(docs, config.EngineConfig(min_frequency=5)).collect()
    assert {r["term"] for r in few} == {"alpha", "beta"}
    chunks = build.chunks_of(docs, config.EngineConfig(chunk_size=30, overlap=0)).collect()
    assert len(chunks) == 3


@pytest.fixture
def corpus(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("Ammonia engines burn ammonia fuel. The injector sprays ammonia fuel. " * 3)
    (folder / "b.html").write_text("<p>Injectors of engines. The injector of the engine leaks.</p>")
    return folder


def test_command_lines(spark, corpus, tmp_path, capsys):
    run = lambda *argv: cli.main([str(x) for x in argv], spark)
    run("init", "--config", tmp_path / "t.yml")
    assert config.load(str(tmp_path / "t.yml")) == config.EngineConfig()
    with pytest.raises(SystemExit):
        run("init", "--config", tmp_path / "t.yml")
    run("statistical", corpus, "-o", tmp_path / "s")
    rows = spark.read.json(str(tmp_path / "s/results")).select(F.explode("terms.term").alias("t")).collect()
    assert {"ammonia", "fuel", "ammonia fuel"} <= {r["t"] for r in rows}
    run("statistical", corpus, "-o", tmp_path / "g", "--graph", "--format", "csv")
    assert spark.read.csv(str(tmp_path / "g"), header=True).count() > 0
    run("evaluate", corpus, "-o", tmp_path / "e", "--pilot", "--provider", "stub:varied")
    asked = spark.read.json(str(tmp_path / "e/results")).collect()
    assert len({r["perplexity"] for r in asked}) > 2 and all(5 <= r["perplexity"] <= 100 and 0 <= r["token_probability"] <= 1 for r in asked)
    run("evaluate", corpus, "-o", tmp_path / "looks", "--pilot", "--looks")
    assert "token_probability" not in spark.read.json(str(tmp_path / "looks/results")).columns
    assert spark.read.json(str(tmp_path / "e/results")).groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 10
    run("generic", corpus, "-o", tmp_path / "d", "--provider", "stub:letter")
    classes = spark.read.json(str(tmp_path / "d")).collect()
    assert {r["confidence"] for r in classes} <= {"high_confidence", "medium_confidence", "low_confidence"} and all(r["n"] == len(r["terms"]) for r in classes)
    docs = cli._documents(spark, str(corpus))
    assert sum(r["n"] for r in classes) == extract.generic_terms(docs).count()
    run("dictionary", corpus, "-o", tmp_path / "k", "--provider", "stub:terms")
    run("dictionary", corpus, "-o", tmp_path / "k", "--provider", "stub:terms")
    assert build.latest(spark, str(tmp_path / "k")).count() > 0 and len(list((tmp_path / "k").glob("snapshot=*"))) == 2
    capsys.readouterr()
    run("search", tmp_path / "k", "--query", "injector")
    assert "injector" in capsys.readouterr().out.lower()
    with cli.served(spark, str(tmp_path / "k"), 0) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        at = f"http://127.0.0.1:{server.server_address[1]}"
        rows = json.loads(urllib.request.urlopen(f"{at}/terms?q=injector&limit=1").read())
        assert len(rows) == 1 and "injector" in rows[0]["headword"].lower() and "embedding" not in rows[0]
        for bad in ("/nothing", "/terms?limit=x"):
            with pytest.raises(urllib.error.HTTPError):
                urllib.request.urlopen(at + bad)
        server.shutdown()
    run("extract", corpus, "-o", tmp_path / "x", "--provider", "stub:terms")
    assert spark.read.json(str(tmp_path / "x/results")).count() == 2
    run("extract", corpus, "-o", tmp_path / "y", "--provider", "stub:candidates", "--two-stage")
    found = spark.read.json(str(tmp_path / "y/results")).select(F.explode("terms").alias("t")).select("t.*").collect()
    assert found and all(r["definition"] == f"{r['term']} defined" and 0.1 <= r["score"] <= 1.0 for r in found)
    run("preprocess", corpus, "-o", tmp_path / "p", "-e", ".txt")
    run("preprocess", corpus, "-o", tmp_path / "p", "-l")
    assert str(corpus) in capsys.readouterr().out
    assert sinks.read_envelope(spark, str(tmp_path / "p/envelope")).count() == 1
    (tmp_path / "t.json").write_text(json.dumps({"results": [{"file_path": "f", "terms": [{"term": "alpha", "definition": "d", "score": 0.1}, {"term": "beta", "definition": "e", "score": 0.1}]}]}))
    run("unknown", tmp_path / "t.json", "-o", tmp_path / "u", "--provider", "stub:doubt")
    assert spark.read.json(str(tmp_path / "u/summary")).first()["total"] == 2


def test_an_extractor_of_ones_own(spark, corpus):
    def shouts(s):
        if "leaks" in s:
            raise ValueError
        return [(w, None, 1.0, 1) for w in s.split() if w[0].isupper()]

    found = surface.extract_from_directory(spark, str(corpus), surface.FromFunction(shouts)).collect()
    assert {r["term"] for r in found} == {"Ammonia", "The"} and all(r["doc_id"].endswith("a.txt") and r["contexts"] is None for r in found)
    planned = surface.extract_from_directory(spark, str(corpus), surface.FromPlan(extract.compound_terms)).collect()
    assert "ammonia fuel" in {r["term"] for r in planned}
    assert surface.shown(spark.createDataFrame([(1, "x")], "a long, bb string")) == "a | bb\n1 | x"


def test_functions_of_sql(spark):
    surface.register(spark)
    got = spark.sql("SELECT termloom_priority_score(3.76D, 29.4D, 0.09D) AS a, termloom_perplexity(array(-2.3D, -0.5D, -0.1D)) AS b, termloom_count_apart('aaaa', 'aa') AS c").first()
    assert (round(got["a"], 3), round(got["b"], 3), got["c"]) == (31.544, 2.629, 2)


def test_a_shared_folder_is_asked_for():
    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

            @staticmethod
            def getConf():  # noqa: N802
                return {}

            @staticmethod
            def getCheckpointDir():  # noqa: N802
                return None

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session)


def plain_paragraphs(s, size, mark):
    """The rule once more, over lists of pieces."""
    chunks = []
    for part in s.split("\n\n"):
        if not part.strip():
            continue
        if len(part) <= 2 * size:
            chunks.append(part)
            continue
        pack = []
        for x in (x for x in part.split(mark) if x.strip()):
            if pack and sum(map(len, pack)) + len(x) >= size:
                chunks.append("".join(pack))
                pack = []
            pack.append(x + mark)
        chunks += ["".join(pack)] if pack else []
    if len(chunks) >= 5:
        return chunks
    chunks, pack = [], []
    for x in (x for x in s.split(mark) if x.strip()):
        pack.append(x + mark)
        if len(pack) == 5 or sum(map(len, pack)) > size:
            chunks.append("".join(pack))
            pack = []
    return [*chunks, "".join(pack)] if pack else chunks


def plain_recursive(s, size, overlap, separators):
    """The rule once more, with places in the text instead of parts."""
    sep = next(x for x in separators if x in s)
    later = separators[separators.index(sep) + 1 :]
    edges = [0, *([m.start() for m in re.finditer(re.escape(sep), s)] if sep else range(1, len(s))), len(s)]
    parts = [s[a:b] for a, b in zip(edges, edges[1:]) if a < b]
    out, run = [], []

    def close():
        first = 0
        while first < len(run):
            last = first
            while last < len(run) and len("".join(run[first : last + 1])) <= size:
                last += 1
            out.append("".join(run[first:last]))
            if last == len(run):
                break
            first = next(k for k in range(first, last + 1) if len("".join(run[k:last])) <= overlap and len("".join(run[k : last + 1])) <= size)
        run.clear()

    for part in parts:
        if len(part) < size:
            run.append(part)
        else:
            close()
            out += plain_recursive(part, size, overlap, later) if later else [part]
    close()
    return [x.strip() for x in out if x.strip()]


def plain_packs(s, size, overlap):
    packs, now = [], ""
    for sentence in re.findall(r"[^。\n]*[。\n]|[^。\n]+$", s):
        if now and len(now) + len(sentence) > size:
            packs.append(now)
            tail = now[max(0, len(now) - overlap) :]
            mark = re.search("[。\n]", tail)
            now = tail[mark.end() :] if mark else tail
        now += sentence
    return [p.strip() for p in [*packs, now] if p.strip()]


def test_packed_texts_by_the_rules():
    import random

    rng = random.Random(5)
    for _ in range(300):
        s = "".join(rng.choice(["ab", "。", "\n\n", " ", "xyz。", "長い文"]) for _ in range(rng.randint(0, 60)))
        assert chunkers.paragraphs(s, 12) == plain_paragraphs(s, 12, "。")
        packs = chunkers.pack_bytes(s, 30)
        if len(s.encode()) <= 30:
            assert packs == ([s] if s.strip() else [])
        else:
            assert "".join(packs) == s + "。" and all(len(p.encode()) < 30 or p.count("。") == 1 for p in packs)
        pieces = chunkers.recursive(s, 10, 3)
        assert all(0 < len(p) <= 10 for p in pieces) and pieces == plain_recursive(s, 10, 3, ["\n\n", "\n", "。", "、", " ", ""])
        got = chunkers.pack_sentences(s, 14, 4, "。\n")
        assert got == plain_packs(s, 14, 4)


def test_embeddings_of_known_texts_are_not_made_again(spark):
    df = spark.createDataFrame([("ab  c",), ("d",)], "term string")
    rows, new = provider.embed_cached(df, spark.createDataFrame([], "key string, embedding array<double>"), provider.Stub(8))
    cache = new.cache()
    assert cache.count() == 2 and all(sum(x * x for x in r["embedding"]) == pytest.approx(1) for r in rows.collect())
    _, again = provider.embed_cached(spark.createDataFrame([("ab c",), ("e",)], "term string"), cache, provider.Stub(8))
    assert again.count() == 1
