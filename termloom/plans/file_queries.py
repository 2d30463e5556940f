"""Queries of sources, sinks and the dictionary: tables written in the shared folder and read back, with DuckDB twins."""

from __future__ import annotations

import io
import uuid
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..config import EngineConfig
from ..operators import around, candidates, contexts, dictionary, passes, rank, stats
from ..sources import readers, sinks
from ..sources.provider import Stub
from ..sources.shared import shared_dir
from .oracle import CNT, EVAL, HEAD, TARGETS, TOKEN, ORACLE, places
from .registry import query, twin
from .term_queries import KANA, SPELT, kana


def _folder(df: DataFrame, name: str) -> str:
    return f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


_FILE = "text || chr(10)"


@twin(f"SELECT item_id, 'text' AS file_type, 'txt' AS extension, octet_length(encode({_FILE})) AS file_size, left(sha256({_FILE}), 16) AS content_hash, length(text) + 1 AS text_length FROM benchmark")
@query
def directory_texts(benchmark):
    """Texts written as files, a folder each, found again and read by their types."""
    path = _folder(benchmark, "texts")
    benchmark.select("item_id", "text").write.partitionBy("item_id").text(path)
    done = readers.preprocess(readers.read_directory(benchmark.sparkSession, path, recursive=True))
    return done.select(F.regexp_extract("path", r"item_id=(\d+)/", 1).cast("long").alias("item_id"), "file_type", "extension", "file_size", "content_hash", F.col("text_length").cast("long").alias("text_length"))


@twin("SELECT 3 + 0 * count(*) AS files, count(*) AS processed, CAST(0 AS BIGINT) AS failed, CAST(0 AS BIGINT) AS skipped, CAST(sum(length(text) + 1) AS BIGINT) AS total_characters FROM benchmark".replace("3 + 0 * count(*)", "count(*)"))
@query
def directory_counts(benchmark):
    """Counters of a preprocessing run."""
    path = _folder(benchmark, "counted")
    benchmark.select("item_id", "text").write.partitionBy("item_id").text(path)
    done = readers.preprocess(readers.read_directory(benchmark.sparkSession, path, recursive=True))
    return readers.preprocess_counts(done).select((F.col("processed") + F.col("failed") + F.col("skipped")).alias("files"), "processed", "failed", "skipped", F.col("total_characters").cast("long").alias("total_characters"))


#: Words of an item in ASCII, and files made of them: two pages, the first blank; Markdown; bytes that are no UTF-8.
_ASCII = "array_to_string(regexp_extract_all(text, '[A-Za-z]+'), ' ')"


def _made(benchmark: DataFrame, kind: str, content) -> DataFrame:
    return benchmark.select("item_id", F.lit(kind).alias("file_type"), content.cast("binary").alias("content"))


@twin(f"""WITH a AS (SELECT item_id, {_ASCII} AS a FROM benchmark)
SELECT item_id, 'pages' AS kind, md5('A1' || chr(10) || 'B2' || chr(10) || chr(10) || a) AS text_md5 FROM a
UNION ALL SELECT item_id, 'marked', md5('[Page 2]' || chr(10) || 'A1' || chr(10) || 'B2' || chr(10) || '[Page 3]' || chr(10) || a) FROM a
UNION ALL SELECT item_id, 'repaired', md5('A1B2' || chr(10) || a) FROM a
UNION ALL SELECT item_id, 'markdown', md5('Head' || chr(10) || a || chr(10) || 'x = 1' || chr(10) || 'end 1') FROM a
UNION ALL SELECT item_id, 'code', md5('Head' || chr(10) || a || chr(10) || '[CODE: x = 1]' || chr(10) || 'end 1' || chr(10) || 'the note') FROM a
UNION ALL SELECT item_id, 'html', md5('Head' || chr(10) || a || chr(10) || 'menu') FROM a
UNION ALL SELECT item_id, 'bare html', md5('Head |' || a) FROM a
UNION ALL SELECT item_id, 'ignored', md5(a || 'z') FROM a
UNION ALL SELECT item_id, 'strict', NULL FROM a
UNION ALL SELECT item_id, 'empty', NULL FROM a""")
@query
def parsed_files(benchmark):
    """Files of every kind, read with every option; what can't be read is null."""
    words = F.array_join(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), " ")
    page = lambda shown: F.concat(F.lit("9 0 obj stream\nBT "), shown, F.lit(" ET\nendstream\n"))
    pdf = F.concat(F.lit("%PDF-1.4\n"), page(F.lit("( ) Tj")), page(F.lit("(A1) Tj 0 -9 Td (B2) Tj")), page(F.concat(F.lit("("), words, F.lit(") Tj"))))
    markdown = F.concat(F.lit("# Head\n\n* **"), words, F.lit("**\n\n```py\nx = 1\n```\n> end [^1]\n\n[^1]: the note\n"))
    plain = F.concat(F.lit("# Head\n\n* **"), words, F.lit("**\n\n```py\nx = 1\n```\n> end 1\n"))
    html = F.concat(F.lit("<style>p{}</style><h1> Head </h1><p>"), words, F.lit("</p><nav>menu</nav>"))
    bad = F.concat(words.cast("binary"), F.unhex(F.lit("FF")), F.lit("z").cast("binary"))
    o = readers.Options
    cases = [
        ("pages", "pdf", pdf, o()), ("marked", "pdf", pdf, o(page_marks=True, joiner="\n")), ("repaired", "pdf", pdf, o(repair=True, joiner="\n")),
        ("markdown", "markdown", plain, o()), ("code", "markdown", markdown, o(keep_code=True, footnotes=True)),
        ("html", "html", html, o()), ("bare html", "html", html, o(separator="|", dropped=("style", "nav"))),
        ("ignored", "text", bad, o(trials=("utf-8",))), ("strict", "text", bad, o(trials=("utf-8",), strict=True)), ("empty", "pdf", F.lit("%PDF-1.4"), o()),
    ]
    out = None
    for name, kind, content, options in cases:
        found = readers.parsed(_made(benchmark, kind, content), options).select("item_id", F.lit(name).alias("kind"), F.md5("text").alias("text_md5"))
        out = found if out is None else out.unionAll(found)
    return out


_UPPER = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


@twin(f"SELECT item_id, md5(translate(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '\\s', ' ', 'g'), '{_UPPER[0]}', '{_UPPER[1]}') || chr(10) || 'END ' || item_id) AS text_md5 FROM benchmark")
@query
def mapped_pdfs(benchmark):
    """Files whose font has codes of its own and a map to Unicode, which here gives capitals, with pages and fonts in
    an object stream."""
    maps = "2 beginbfrange <0000> <0060> <0000> <007B> <FFFF> <007B> endbfrange 1 beginbfrange <0061> <007A> <0041> endbfrange"
    objects = ["<</Type/Catalog/Pages 2 0 R>>", "<</Type/Pages/Kids[3 0 R]/Resources<</Font<</F1 4 0 R>>>>>>", "<</Type/Page/Contents 6 0 R>>", "<</Type/Font/Subtype/Type0/Encoding/Identity-H/ToUnicode 5 0 R>>"]
    starts = [sum(len(x) + 1 for x in objects[:k]) for k in range(4)]
    head = " ".join(f"{k} {at}" for k, at in enumerate(starts, 1)) + "\n"
    stream = lambda n, extra, data: F.concat(F.lit(f"{n} 0 obj\n<<{extra}>>\nstream\n"), data, F.lit("\nendstream\nendobj\n"))
    codes = lambda s: F.concat(F.lit("<"), F.hex(F.encode(s, "UTF-16BE")), F.lit("> Tj"))
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    page = F.concat(F.lit("BT /F1 9 Tf "), codes(text), F.lit(" 0 -9 Td "), codes(F.concat(F.lit("end "), F.col("item_id").cast("string"))), F.lit(" ET"))
    file = F.concat(F.lit("%PDF-1.5\n"), stream(7, f"/Type/ObjStm/N 4/First {len(head)}", F.lit(head + "\n".join(objects))), stream(5, "", F.lit(f"1 begincodespacerange <0000> <FFFF> endcodespacerange {maps}")), stream(6, "", page), F.lit("trailer <</Root 1 0 R>>"))
    return readers.parsed(_made(benchmark, "pdf", file)).select("item_id", F.md5("text").alias("text_md5"))


@F.pandas_udf(BinaryType())
def _word_file(text: pd.Series, cell: pd.Series) -> pd.Series:
    """Word files of two paragraphs, a blank one and a table of two cells."""

    def made(t: str, c: str) -> bytes:
        p = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"
        table = "<w:tbl><w:tr>" + "".join(f"<w:tc>{p.format(escape(x))}</w:tc>" for x in (" item ", c)) + "</w:tr></w:tbl>"
        body = p.format("Head &amp; more") + p.format(" ") + table + p.format(escape(t))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
        return out.getvalue()

    return pd.Series([made(t, c) for t, c in zip(text, cell)])


@twin("""SELECT item_id, 'tables' AS kind, md5('Head & more' || chr(10) || chr(10) || 'item | ' || item_id || chr(10) || chr(10) || text) AS text_md5 FROM benchmark
UNION ALL SELECT item_id, 'paragraphs', md5('Head & more' || chr(10) || chr(10) || text) FROM benchmark UNION ALL SELECT item_id, 'broken', NULL FROM benchmark""")
@query
def word_files(benchmark):
    """Word files with their tables in place and without them; one that is no container is null."""
    made = benchmark.select("item_id", F.lit("word").alias("file_type"), _word_file("text", F.col("item_id").cast("string")).alias("content"))
    broken = _made(benchmark, "word", F.col("text"))
    cases = [("tables", made, readers.Options()), ("paragraphs", made, readers.Options(tables=False)), ("broken", broken, readers.Options())]
    out = None
    for name, rows, options in cases:
        found = readers.parsed(rows, options).select("item_id", F.lit(name).alias("kind"), F.md5("text").alias("text_md5"))
        out = found if out is None else out.unionAll(found)
    return out


@twin("SELECT vec_id AS chunk_id, 'text ' || vec_id AS preview, len(embedding) AS dim FROM embeddings")
@query
def vector_store(embeddings):
    """V5: chunks stored with their vectors, anew each time."""
    from ..operators import vectors

    chunks = embeddings.select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("text"), "embedding")
    path = _folder(embeddings, "store")
    vectors.build_store(chunks.limit(1), path)
    vectors.build_store(chunks, path)
    return embeddings.sparkSession.read.parquet(path).select("chunk_id", "preview", F.size("embedding").cast("long").alias("dim"))


_LINES = r"""x0 AS (SELECT page_id, replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)\b.*?</(script|style)>', chr(10), 'g'), '(?s)<!--.*?-->', chr(10), 'g'), '<[^>]*>', chr(10), 'g'), '&copy;', '©') AS t0 FROM pages),
x AS (SELECT page_id, regexp_replace(replace(replace(t0, '&middot;', '·'), '&quot;', chr(34)), '&amp;?', '&', 'g') AS t FROM x0),
l AS (SELECT page_id, list_filter(list_transform(string_split(t, chr(10)), lambda s: trim(s, ' ')), lambda s: s <> '') AS l FROM x)"""


@twin(f"WITH {_LINES} SELECT page_id, md5(array_to_string(l, chr(10))) AS text_md5, len(l) AS n_lines FROM l")
def html_text_lines() -> None:
    """Only the twin: the query stands with the first ones."""


_SCORED = f"{CNT}, sc AS (SELECT doc_id, term, frequency, round(frequency / 7.0, 6) AS score FROM cnt WHERE frequency >= 2)"


def _scored(documents: DataFrame) -> DataFrame:
    """Terms as a terms file holds them."""
    counts = candidates.term_counts(documents).where("frequency >= 2").withColumn("score", F.round(F.col("frequency") / 7.0, 6))
    some = F.transform(F.sequence(F.lit(1), F.least(F.col("frequency"), F.lit(5)).cast("int")), lambda i: F.concat(F.lit("c"), i.cast("string")))
    return counts.select(F.col("doc_id").cast("string").alias("file_path"), "term", F.concat(F.lit("about "), "term").alias("definition"), "score", "frequency", some.alias("contexts"))


@twin(f"WITH {_SCORED} SELECT doc_id::VARCHAR AS file_path, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) - 1 AS INTEGER) AS ord, term, score::DOUBLE AS score, frequency, least(frequency, 3) AS n_contexts FROM sc")
@query
def terms_files(documents):
    """Results written as nested JSON and read flat."""
    path = _folder(documents, "results")
    sinks.save(_scored(documents), path, "json")
    rows = documents.sparkSession.read.schema("file_path string, terms array<struct<term:string,definition:string,score:double,frequency:long,contexts:array<string>>>").json(f"{path}/results")
    out = rows.select("file_path", F.posexplode("terms").alias("ord", "t")).select("file_path", "ord", "t.*")
    return out.select("file_path", "ord", "term", "score", "frequency", F.size("contexts").cast("long").alias("n_contexts"))


@twin(f"WITH {_SCORED} SELECT doc_id::VARCHAR AS file, term, printf('%.3f', score) AS score, frequency::VARCHAR AS frequency, 'about ' || term AS definition FROM sc")
@query
def terms_csv(documents):
    """A row a term, scores with three digits."""
    path = _folder(documents, "csv")
    sinks.save(_scored(documents), path, "csv")
    return documents.sparkSession.read.csv(path, header=True)


@twin(f"WITH {EVAL}, g AS (SELECT term, max(priority_score) AS priority_score, min(confidence) AS confidence FROM ev GROUP BY term), r AS (SELECT term, priority_score FROM g WHERE confidence IN ('low', 'medium') ORDER BY priority_score DESC, term LIMIT 50) SELECT term, round(priority_score + 2.55e-8, 6) AS priority_score FROM r")
@query
def review_file(documents):
    """The review, as a file with a byte order mark, read back."""
    from . import extract

    rows = extract.evaluated_terms(documents).groupBy("term").agg(F.max("priority_score").alias("priority_score"), F.min("confidence").alias("confidence"))
    path = _folder(documents, "review")
    sinks.write_review(rank.review(rows), path)
    back = documents.sparkSession.read.csv(path, header=True, inferSchema=False)
    return back.select(F.col(back.columns[0]).alias("term"), F.round(F.col("priority_score").cast("double") + 2.55e-8, 6).alias("priority_score"))


@twin(f"WITH {EVAL}, n AS (SELECT count(*) AS total, count(*) FILTER (WHERE confidence = 'high') AS high FROM ev) SELECT total, high FROM n")
@query
def stats_file(documents):
    """Run statistics written and read back."""
    from . import extract

    path = _folder(documents, "stats")
    sinks.write_rows(extract.run_statistics(extract.evaluated_terms(documents)), path)
    return documents.sparkSession.read.json(path).select("total", "high")


@twin("SELECT 'a' AS source, count(*) AS files, CAST(sum(length(text)) AS BIGINT) AS characters FROM documents UNION ALL SELECT 'b', count(*), CAST(sum(length(text)) AS BIGINT) FROM benchmark")
@query
def run_log(documents, benchmark):
    """Runs appended to a log and listed."""
    path = _folder(documents, "log")
    for name, rows in (("a", documents), ("b", benchmark)):
        sinks.append_log(rows.select(F.length("text").alias("text_length")), path, name)
    return sinks.listing(documents.sparkSession, path).select("source", "files", F.col("characters").cast("long").alias("characters"))


@twin("SELECT item_id::VARCHAR AS file_name, length(text) AS text_length, md5(text) AS text_md5, count(*) OVER () AS total_files FROM benchmark")
@query
def envelope_file(benchmark):
    """One nested file with all documents of a run, and its documents again."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("file_name"), "text", F.length("text").alias("text_length"), F.lit(None).cast("string").alias("error"))
    path = _folder(benchmark, "envelope")
    sinks.write_rows(sinks.envelope(rows, "here"), path)
    spark = benchmark.sparkSession
    total = spark.read.json(path, multiLine=True).select(F.col("metadata.total_files").alias("total_files"))
    return sinks.read_envelope(spark, path).join(F.broadcast(total)).select("file_name", F.col("text_length").cast("long").alias("text_length"), F.md5("text").alias("text_md5"), "total_files")


@twin(f"WITH {CNT}, v AS (SELECT term, CAST(sum(frequency) AS BIGINT) AS frequency, round(1 - 1 / (sum(frequency) + 1), 6) AS score, md5('{passes.VALIDATE}' || chr(10) || term) AS m FROM cnt GROUP BY term) SELECT term, score, frequency, substr(m, 1, 8) AS reason FROM v WHERE CAST(('0x' || substr(m, 1, 2)) AS BIGINT) % 2 = 1")
@query
def excluded_file(documents):
    """Terms that validation dropped, in a folder with the run's time."""
    terms = candidates.term_counts(documents).groupBy("term").agg(F.sum("frequency").alias("frequency")).withColumn("score", F.round(1 - 1 / (F.col("frequency") + 1), 6))
    path = sinks.write_excluded(passes.validate(terms, Stub(style="verdict")), _folder(documents, "excluded"), "20240101_000000")
    return documents.sparkSession.read.schema("term string, score double, frequency long, reason string").json(path)


@twin(f"WITH {HEAD}, m AS (SELECT key AS headword, list_sort(list_distinct(flatten(list(synonyms)))) AS s, array_to_string(list_sort(list_distinct(list(definition))), ' / ') AS definition FROM hw GROUP BY key) SELECT headword, array_to_string(s, ',') AS synonyms, definition FROM m")
@query
def dictionary_file(documents):
    """The dictionary exported without vectors, read back."""
    from .queries import _dictionary, _headwords

    path = _folder(documents, "dictionary")
    sinks.write_dictionary(_dictionary(_headwords(documents)), path)
    rows = documents.sparkSession.read.schema("headword string, synonyms array<string>, definition string").json(path)
    return rows.select("headword", F.array_join("synonyms", ",").alias("synonyms"), "definition")


@query
def evaluation_files(benchmark):
    """Evaluated terms by class, and how many there are of each; the counts are those of ``unknown_summary``."""
    from .reply_queries import _evaluated

    rows, path = _evaluated(benchmark), _folder(benchmark, "evaluation")
    sinks.write_evaluation(rows.select("term", "similarity", "is_unknown", "error"), stats.evaluation_summary(rows), path)
    return benchmark.sparkSession.read.schema("term string, similarity double, class string").json(f"{path}/terms").groupBy("class").agg(F.count(F.lit(1)).alias("n"))


_SHAPES = ORACLE["feature_perplexity"].removeprefix("WITH ")


@twin(f"WITH fp AS (WITH {_SHAPES}), t AS (SELECT confidence, perplexity, term FROM fp), u AS (SELECT DISTINCT confidence, perplexity, term FROM t) SELECT confidence, count(*) AS n, arg_min(term, (perplexity, term)) AS first, max(perplexity) AS highest FROM u GROUP BY confidence")
@query
def result_buckets(documents):
    """Classes with their terms in order of score, written and read back."""
    from .queries import _features

    rows = _features(documents).withColumn("confidence", rank.inverted(F.col("perplexity"), 30.0, 20.0)).select("confidence", "perplexity", "term").distinct().withColumn("frequency", F.lit(1))
    path = _folder(documents, "buckets")
    sinks.write_rows(sinks.buckets(rows), path)
    back = documents.sparkSession.read.schema("confidence string, n long, terms array<struct<perplexity:double,term:string,frequency:int>>").json(path)
    return back.select("confidence", "n", F.col("terms")[0]["term"].alias("first"), F.element_at("terms", -1)["perplexity"].alias("highest"))


_BY_DOC = f"{CNT}, ws AS (SELECT term, frequency / 10 AS score, doc_id AS ord, doc_id % 50 AS doc, source || ':' || term AS definition FROM cnt JOIN documents USING (doc_id))"


@twin(f"WITH {_BY_DOC}, g AS (SELECT doc, term, max(score) AS score, arg_max(definition, (length(definition), -ord)) AS definition FROM ws GROUP BY ALL) SELECT doc, term, definition, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, term) AS k FROM g) WHERE k <= 30")
@query
def merged_extractions(documents):
    """K6: terms of one document from many chunks, here of fifty groups of documents: longest definition, best score, the best thirty."""
    rows = candidates.term_counts(documents).join(documents.select("doc_id", "source"), "doc_id")
    rows = rows.select((F.col("doc_id") % 50).alias("doc"), "term", (F.col("frequency") / 10).alias("score"), F.col("doc_id").alias("ord"), F.concat("source", F.lit(":"), "term").alias("definition"))
    return passes.merge_extracted(rows, 30, "doc").select("doc", "term", "definition", F.round("score", 6).alias("score"))


@twin(f"""WITH {HEAD}, l AS (SELECT '  ' || headword || ' ' AS headword, lower(headword) AS key, synonyms, CASE WHEN ord % 3 > 0 THEN definition || ord ELSE '' END AS definition, CASE WHEN ord % 5 > 1 THEN category ELSE '' END AS category, ord FROM hw)
SELECT key, array_to_string(list_sort(list_distinct(flatten(list(synonyms)))), ',') AS synonyms, arg_min(definition, ord) FILTER (WHERE definition <> '') AS definition, arg_min(category, ord) FILTER (WHERE coalesce(category, '') <> '') AS category FROM l GROUP BY key""")
@query
def merge_loose(documents):
    """K7: headwords merged without blanks and case, first values that aren't empty."""
    from .queries import _headwords

    rows = _headwords(documents).withColumn("headword", F.concat(F.lit("  "), "headword", F.lit(" ")))
    rows = rows.withColumn("definition", F.when(F.col("ord") % 3 > 0, F.concat("definition", F.col("ord").cast("string"))).otherwise(F.lit("")))
    rows = rows.withColumn("category", F.when(F.col("ord") % 5 > 1, F.col("category")).otherwise(F.lit("")))
    out = dictionary.merge_loose(rows)
    return out.select("key", F.array_join("synonyms", ",").alias("synonyms"), "definition", "category")


@twin("SELECT column_name AS name, data_type AS type FROM (VALUES ('headword', 'string'), ('synonyms', 'array<string>'), ('definition', 'string'), ('category', 'string'), ('confidence', 'double'), ('source_docs', 'array<string>'), ('embedding', 'array<float>'), ('created_at', 'timestamp'), ('updated_at', 'timestamp')) t(column_name, data_type)")
@query
def dictionary_ddl(region):
    """K4: the stored table's columns, from a table that was created."""
    spark = region.sparkSession
    path = _folder(region, "created")
    name = f"terms_{uuid.uuid4().hex}"
    dictionary.create(spark, name, path)
    rows = [(f.name, f.dataType.simpleString()) for f in spark.table(name).schema]
    spark.sql(f"DROP TABLE {name}")
    return spark.createDataFrame(rows, "name string, type string")


_DOMAINS = "engineering", "chemistry", "ai_ml"


def _domain_twin() -> str:
    from ..functions import fixed

    rows = [(d, k, t.replace("{keyword}", w[k % len(w)])) for d, (w, ts) in fixed.DOMAIN_TEMPLATES.items() for k, t in enumerate(ts) if k < 2]
    cases = "CASE " + " ".join(f"WHEN regexp_matches(t, '{'|'.join(w)}') THEN '{d}'" for d, w in fixed.DOMAIN_KEYWORDS.items()) + " END"
    words = ", ".join(f"'{w[0]}'" for w in fixed.DOMAIN_KEYWORDS.values())
    values = ", ".join(f"('{d}', '{m}')" for d, _, m in rows)
    return f"WITH tm AS (SELECT DISTINCT w || [{words}, ''][1 + length(w) % 4] AS t FROM (SELECT unnest(regexp_extract_all({KANA}, '{SPELT}')) AS w FROM documents)), d AS (SELECT t AS term, {cases} AS domain FROM tm), v(domain, masked_text) AS (VALUES {values}) SELECT term, d.domain, masked_text FROM d JOIN v ON d.domain = v.domain"


@twin(_domain_twin())
@query
def domain_masks(documents):
    """Masked templates of a term's domain."""
    from ..functions import fixed

    words = documents.select(F.explode(F.regexp_extract_all(kana(), F.lit(SPELT), F.lit(0))).alias("w")).distinct()
    ends = F.array(*[F.lit(w[0]) for w in fixed.DOMAIN_KEYWORDS.values()], F.lit(""))
    return contexts.domain_masks(words.select(F.concat("w", F.get(ends, F.length("w") % 4)).alias("term")).distinct())


_AROUND = ORACLE["cooccur_words"].removeprefix("WITH ")


@twin(f"WITH ar AS (WITH {_AROUND}) SELECT doc_id, term, side AS direction, word AS cooccurrence, CASE WHEN side = 'before' THEN word || '[MASK]' ELSE '[MASK]' || word END AS masked_text FROM ar WHERE rank = 1")
@query
def statistical_masks(documents):
    """M4: the mask beside the word that is most often next to a term."""
    from ..operators import chunkers
    from .queries import _targets

    words = documents.select("doc_id", F.posexplode(chunkers.words(F.col("text"))).alias("pos", "word"))
    return contexts.statistical_masks(contexts.around_words(words, _targets(documents)))


@twin(f"""WITH {CNT}, {TARGETS}, {places('tg')}, r AS (SELECT doc_id || '|' || term AS term, k AS ord, md5(substr(text, greatest(st - 3, 1), least(6, least(st - 1, 3) + length(term) + 3))) AS masked_text FROM pl),
t AS (SELECT DISTINCT term, 1 AS ord, 'template' AS masked_text FROM r), p AS (SELECT term, masked_text, n AS place FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY ord) AS n FROM r) WHERE n <= 2 UNION ALL SELECT term, masked_text, 10001 FROM t),
o AS (SELECT term, masked_text, min(place) AS place FROM p GROUP BY ALL) SELECT term, CAST(n AS INTEGER) AS place, masked_text FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY place) AS n FROM o) WHERE n <= 3""")
@query
def combined_masks(documents):
    """Quotas of contexts from several sources, without repeats."""
    found = around.plain_contexts(documents, EngineConfig().min_frequency, 3, 2)  # as many of a term as its quota takes
    real = F.struct(F.lit(0).alias("source"), "ord", F.md5(F.substring("context", 1, 6)).alias("masked_text"))
    made = F.struct(F.lit(1).alias("source"), F.lit(1).alias("ord"), F.lit("template").alias("masked_text"))
    each = F.when(F.col("ord") == 0, F.array(real, made)).otherwise(F.array(real))
    rows = found.select(F.concat(F.col("doc_id").cast("string"), F.lit("|"), "term").alias("term"), F.inline(each))
    return contexts.combined(rows, [2, 1], 3)


@twin(f"WITH b AS (SELECT item_id, regexp_extract_all(text, '{TOKEN}') AS w FROM benchmark) SELECT item_id, CAST(w[1] AS VARCHAR) AS first, round(0.3 * length(w[1]) + 0.7 * len(w), 6)::DOUBLE AS base FROM b")
@query
def sql_functions(benchmark):
    """Operators as functions of SQL."""
    from .. import surface

    spark = benchmark.sparkSession
    surface.register(spark)
    benchmark.createOrReplaceTempView("termloom_items")
    rows = spark.sql(f"SELECT item_id, regexp_extract_all(text, '{TOKEN.replace(chr(92), chr(92) * 2)}', 0) AS w FROM termloom_items")
    rows.createOrReplaceTempView("termloom_words")
    return spark.sql("SELECT item_id, w[0] AS first, round(termloom_base_score(length(w[0]), size(w)), 6) AS base FROM termloom_words")
