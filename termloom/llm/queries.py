"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitslice, filteraudit, imatch, langid, linededup, minhash, mixing, pow2pack, rpforest, simple8b, superkmer, turnrepair, warc
from .store import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Sources by domain, five to each; the weights of domains, of languages everywhere, and of the first source of a domain.
DOMAINS = {"web": 5, "books": 3, "forums": 2, "manuals": 2}
LANGUAGES = {"en": 6, "fr": 2, "de": 2, "es": 1}
FIRST_SOURCE = 2
_SOURCES = {d: [f"src{5 * i + k}" for k in range(5)] for i, d in enumerate(DOMAINS)}
#: The weight of what is in none of these: other languages in each domain, and a domain of other sources. Its label is null.
REST = 1
_LANGUAGES = {**LANGUAGES, None: REST}
MIX = {d: (w, {x: (v, {s: (1 if k else FIRST_SOURCE, None) for k, s in enumerate(_SOURCES[d])}) for x, v in _LANGUAGES.items()}) for d, w in DOMAINS.items()}
MIX[None] = (REST, {x: (v, {None: (1, None)}) for x, v in _LANGUAGES.items()})
_DOMAIN_SQL = "CASE " + " ".join(f"WHEN source IN ({', '.join(map(repr, s))}) THEN '{d}'" for d, s in _SOURCES.items()) + " END"


def mix_levels() -> tuple[Column, Column, Column]:
    """Domain, language and source of a document; null where the tree has no such name, for its leaves of the rest."""
    listed = lambda c, names: F.when(F.col(c).isin(*names), F.col(c))
    return F.expr(_DOMAIN_SQL), listed("lang", LANGUAGES), listed("source", [s for names in _SOURCES.values() for s in names])



def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken to target weights; see :func:`mixing.mix` for nulls, repeats and empty tables."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    taken = mixing.mix(docs, MIX, mix_levels(), share=0.6, epochs=4, seed=7)
    return taken.select("doc_id", "domain", "lang", "source", "tokens", "full_epochs", "last_tokens")


def _filled(level: str, parent: str, above: str) -> str:
    """Water-filling of every parent's budget ``b`` over its children's caps ``c`` and weights ``w``, in integers."""
    return f"""
{level}_o AS (
  SELECT n.*, a.b, sum(n.c) OVER f - n.c AS done, sum(n.w) OVER p - (sum(n.w) OVER f - n.w) AS open
  FROM {level}_n n JOIN {above} a USING ({parent})
  WINDOW p AS (PARTITION BY {parent}), f AS (PARTITION BY {parent} ORDER BY n.c / n.w, n.name ROWS UNBOUNDED PRECEDING)),
{level}_s AS (SELECT *, c * open <= (b - done) * w AS sat FROM {level}_o),
{level}_t AS (
  SELECT *, sum(CASE WHEN sat THEN c ELSE 0 END) OVER p AS used, sum(CASE WHEN sat THEN 0 ELSE w END) OVER p AS rest_w
  FROM {level}_s WINDOW p AS (PARTITION BY {parent}))"""


_SPEC = ", ".join(f"('{d}', {DOMAINS[d]}, '{x}', {v}, '{s}', {1 if k else FIRST_SOURCE})" for d in DOMAINS for x, v in LANGUAGES.items() for k, s in enumerate(_SOURCES[d]))
_SHARE = "CAST(CASE WHEN sat THEN c ELSE ((b - used) * w) // rest_w END AS BIGINT)"
OP1_SQL = f"""
WITH spec(domain, dw, lang, lw, source, sw) AS (VALUES {_SPEC}),
docs AS (SELECT d.doc_id, s.domain, d.lang, d.source, CAST(len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens
         FROM documents d JOIN spec s ON d.lang = s.lang AND d.source = s.source),
have AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS n FROM docs GROUP BY ALL),
caps AS (SELECT s.*, 4 * coalesce(h.n, 0) AS c FROM spec s LEFT JOIN have h USING (domain, lang, source)),
top AS (SELECT 0 AS one, CAST(sum(n) AS BIGINT) * 600000 // 1000000 AS b FROM have),
d_n AS (SELECT 0 AS one, domain AS name, dw AS w, CAST(sum(c) AS BIGINT) AS c FROM caps GROUP BY domain, dw),
{_filled("d", "one", "top")},
d_b AS (SELECT name AS domain, {_SHARE} AS b FROM d_t),
l_n AS (SELECT domain, lang AS name, lw AS w, CAST(sum(c) AS BIGINT) AS c FROM caps GROUP BY domain, lang, lw),
{_filled("l", "domain", "d_b")},
l_b AS (SELECT domain, name AS lang, {_SHARE} AS b FROM l_t),
s_n AS (SELECT domain, lang, source AS name, sw AS w, c FROM caps),
{_filled("s", "domain, lang", "l_b")},
plan AS (SELECT t.domain, t.lang, t.name AS source, {_SHARE} AS b FROM s_t t),
leaf AS (SELECT p.domain, p.lang, p.source, CASE WHEN h.n > 0 THEN p.b // h.n ELSE 0 END AS full_epochs, CASE WHEN h.n > 0 THEN p.b % h.n ELSE 0 END AS rest
         FROM plan p JOIN have h USING (domain, lang, source)),
placed AS (
  SELECT d.*, l.full_epochs, l.rest,
         sum(d.tokens) OVER (PARTITION BY d.domain, d.lang, d.source ORDER BY md5('7|' || l.full_epochs || '|' || d.doc_id), d.doc_id ROWS UNBOUNDED PRECEDING) - d.tokens AS before
  FROM docs d JOIN leaf l USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens, CAST(full_epochs AS BIGINT) AS full_epochs, CAST(greatest(0, least(tokens, rest - before)) AS BIGINT) AS last_tokens
FROM placed WHERE full_epochs > 0 OR greatest(0, least(tokens, rest - before)) > 0
"""


def op2_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text. Null texts are empty; rows that repeat an id follow one another
    by a hash of their texts; of an empty table nothing is returned."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    slots = imatch.lexicon(docs).scalar()
    rows = imatch.fingerprinted(docs, slots, "text", "prints").withColumn("tie", F.xxhash64("text"))
    rows = imatch.with_next(rows, ["text", "prints"], tie_col="tie").withColumn("n_chars", F.length("text").cast("long"))
    half = F.expr("cast(n_chars div 2 as int)")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    rows = imatch.fingerprinted(rows.withColumn("edited", edited), slots, "edited", "edited_prints")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        imatch.printed(F.col("prints")).alias("fingerprint"),
        imatch.printed(F.col("edited_prints")).alias("edited_fingerprint"),
        imatch.likeness(F.col("prints"), F.col("edited_prints")).alias("near_edited"),
        imatch.likeness(F.col("prints"), F.col("next_prints")).alias("near_next"),
    )


def op3_bitslice_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stated query's best rows; see :func:`bitslice.quantised` and :func:`bitslice.top_k` for nulls, repeats and ties."""
    rows = written(bitslice.quantised(_table(spark, sf_dir, "embeddings"), 256, "vec_id", "embedding"), "vectors")
    asked = rows.where("id % 50 = 0")
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    block, group = bitslice.tile(n, asked.count(), int(spark.conf.get("spark.sql.shuffle.partitions")), width)
    index = written(bitslice.build_index(rows, block), "slices")
    return bitslice.top_k(index, asked, 5, group).select(F.col("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")


OP3_SQL = """
WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.id AS query_id, c.id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the lines that a larger document repeats; see :func:`linededup.dedup_lines` for nulls and repeats."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("__kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT r, doc_id, pos,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k, line
  FROM (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM docs)),
shared AS (
  SELECT k, max(doc_id) AS owner FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT l.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE s.k IS NOT NULL AND s.owner <> l.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE s.k IS NULL OR s.owner = l.doc_id), '')) AS kept_sha256
FROM lines l LEFT JOIN shared s ON l.k = s.k
GROUP BY l.r, l.doc_id
"""

def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of whole texts; see :func:`minhash.near_duplicates` for nulls, repeats and empty tables."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents")).drop("sig")


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, written to the archive and put together again; ``record_sha256`` is the digest of its bytes.
    See :func:`warc.write_archive` for nulls, repeated and empty payloads."""
    records = warc.read_archive(warc.write_archive(_table(spark, sf_dir, "pages")))
    return records.select("page_id", F.length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", F.sha2("record", 256).alias("record_sha256"))


def _record_id(page: str) -> str:
    h = f"md5('termloom|' || coalesce({page}::VARCHAR, '') || '|' || payload_digest)"
    part = lambda at, n: f"substr({h}, {at}, {n})"
    return f"'<urn:uuid:' || {part(1, 8)} || '-' || {part(9, 4)} || '-3' || {part(14, 3)} || '-8' || {part(18, 3)} || '-' || {part(21, 12)} || '>'"


_CRLF = "chr(13) || chr(10)"
OP5_SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, encode(coalesce(html, '')) AS body FROM pages),
q AS (SELECT page_id, url, html, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS owner FROM q),
k AS (SELECT *, CASE WHEN payload_bytes < 100 OR page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
             'HTTP/1.1 200 OK' || {_CRLF} || 'Content-Type: text/html; charset=utf-8' || {_CRLF} || 'Content-Length: ' || payload_bytes || {_CRLF} || {_CRLF} AS http FROM r),
h AS (SELECT *, array_to_string(list_filter([
  'WARC/1.1', 'WARC-Type: ' || record_type, 'WARC-Record-ID: ' || {_record_id('page_id')}, 'WARC-Date: {warc.NO_DATE}',
  'WARC-Target-URI: ' || replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A'), 'Content-Type: application/http;msgtype=response',
  'WARC-Payload-Digest: sha256:' || payload_digest,
  CASE WHEN record_type = 'revisit' THEN 'WARC-Refers-To: ' || {_record_id('owner')} END,
  CASE WHEN record_type = 'revisit' THEN 'WARC-Profile: {warc.PROFILE}' END,
  'Page-ID: ' || coalesce(page_id::VARCHAR, ''),
  CASE WHEN record_type = 'revisit' THEN 'Refers-To-Page-ID: ' || owner END,
  'Content-Length: ' || (length(http) + CASE WHEN record_type = 'revisit' THEN 0 ELSE payload_bytes END)
], lambda x: x IS NOT NULL), {_CRLF}) || {_CRLF} || {_CRLF} || http AS header FROM k)
SELECT page_id, payload_bytes, payload_digest, record_type, CASE WHEN record_type = 'revisit' THEN owner END AS refers_to,
       sha256(header || CASE WHEN record_type = 'response' THEN html ELSE '' END || {_CRLF} || {_CRLF}) AS record_sha256
FROM h
"""


def op6_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the windows of words that a smaller document repeats; see :func:`superkmer.dedup_windows`."""
    return superkmer.dedup_windows(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
o AS (SELECT k, min(doc_id) AS owner FROM g GROUP BY k),
c AS (SELECT DISTINCT doc_id, i + d AS pos FROM (SELECT g.doc_id, g.i, unnest(range(13)) AS d FROM g JOIN o USING (k) WHERE owner < doc_id)),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w),
l AS (SELECT p.doc_id, count(*) AS n_words, count(c.pos) AS n_removed, string_agg(word, ' ' ORDER BY p.pos) FILTER (WHERE c.pos IS NULL) AS kept
      FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.pos = c.pos GROUP BY p.doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN l USING (doc_id)
"""

OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM g a JOIN g b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM m JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 75 * (x.n + y.n - both_)),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b),
k AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(k.c, w.doc_id) AS component_id, coalesce(k.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learnt from the rows that are not held out; see :func:`langid.predict`."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", langid.held_out().alias("held_out"))
    return langid.predict(docs, langid.profiles(docs.where("NOT held_out")), keep=("doc_id", "held_out"))


#: crc32 of a number's digits, and the grams of every run of letters with a blank on both sides.
OP7_SQL = rf"""
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc),
d AS (SELECT doc_id, lang, lower(coalesce(text, '')) AS s,
      xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c // 256, crc[CAST(xor(c, b) % 256 AS INTEGER) + 1])), 4294967295) % 4 = 2 AS held_out FROM documents, t),
w AS (SELECT doc_id, ' ' || run || ' ' AS p, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(s, '\p{{L}}+')) AS run FROM d) GROUP BY ALL),
g AS (SELECT doc_id, substr(p, i, k) AS g, c FROM (SELECT *, unnest(range(1, length(p) - k + 2)) AS i FROM (SELECT *, unnest([1, 2, 3]) AS k FROM w)) WHERE substr(p, i, k) <> ' '),
dg AS (SELECT doc_id, g, sum(c) AS n FROM g GROUP BY ALL),
own AS (SELECT * FROM (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(g), g) - 1 AS place FROM dg) WHERE place < {langid.TOP}),
prof AS (SELECT * FROM (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, length(g), g) - 1 AS rank FROM dg JOIN d USING (doc_id) WHERE lang IS NOT NULL AND NOT held_out GROUP BY lang, g) WHERE rank < {langid.TOP}),
far AS (SELECT o.doc_id, l.lang, count(*) AS used, sum(coalesce(least({langid.TOP}, abs(p.rank - o.place)), {langid.TOP})) AS far
        FROM own o CROSS JOIN (SELECT DISTINCT lang FROM prof) l LEFT JOIN prof p ON p.lang = l.lang AND p.g = o.g GROUP BY ALL),
best AS (SELECT doc_id, arg_min(lang, (far, lang)) AS lang_pred, 1 - CAST(min(far) AS DOUBLE) / (any_value(used) * {langid.TOP}.0) AS score FROM far GROUP BY doc_id)
SELECT d.doc_id, held_out, coalesce(lang_pred, '{langid.UNDETERMINED}') AS lang_pred, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM d LEFT JOIN best USING (doc_id)
"""


def tokenizer_file(name: str) -> str:
    """Where the installed tokenizer files are, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_simple8b_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, written to files and read back; see :func:`simple8b.write_ids` for nulls and repeats."""
    files = simple8b.write_ids(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), blanks=False, end_id=1)
    return simple8b.read_ids(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_pow2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of binary length of every text; see :func:`pow2pack.pieces` for nulls and repeats."""
    found = pow2pack.pieces(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), blanks=True, end_id=0)
    found = pow2pack.number_sequences(found.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op11_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stated query's nearest rows by cosine; see :func:`rpforest.unit_rows` for nulls and repeats, :func:`rpforest.search` for ties."""
    rows = written(rpforest.unit_rows(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vectors")
    found = rpforest.search(rows, rows.where("id % 50 = 0"), rpforest.grow(rows), k=5)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest edits of every damaged conversation; see :func:`turnrepair.repair` for nulls, ties and repeats."""
    return turnrepair.repair(turnrepair.damaged(_table(spark, sf_dir, "conversations")))


#: Rows after damage, their faults, and the cheapest (cost, audit) of every state of the grammar, row after row; inserts close
#: over the states before each row. Keys are costs of nine digits and the audit, so that the least string is the cheapest.
def _more(key: str, cost: str, letter: str) -> str:
    return f"lpad(CAST(CAST(substr({key}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({key}, 10) || '{letter}'"


#: A row's edits: s0 is nothing yet, s1 a system row, s2 a user row last, s3 an assistant row last.
_EDITED = f"""
SELECT conv_id, roles, faults, next AS pos, {_more("s0", "4", "D")} AS s0, least({_more("s1", "4", "D")}, CASE WHEN keep AND r = 's' THEN {_more("s0", "more", "K")} END) AS s1,
       least({_more("s2", "4", "D")}, CASE WHEN keep AND r = 'u' THEN {_more("least(s0, s1, s3)", "more", "K")} END, CASE WHEN keep THEN {_more("least(s0, s1, s3)", "more + 3", "R")} END) AS s2,
       least({_more("s3", "4", "D")}, CASE WHEN keep AND r = 'a' THEN {_more("s2", "more", "K")} END, CASE WHEN keep THEN {_more("s2", "more + 3", "R")} END) AS s3
FROM (SELECT *, pos + 1 AS next, roles[pos + 1][1] AS r, faults[pos + 1] NOT IN (1, 2) AS keep, CASE faults[pos + 1] WHEN 3 THEN 3 ELSE 0 END AS more FROM w WHERE pos < len(roles))"""
_USER = f"SELECT *, least(s2, {_more('least(s0, s1, s3)', '3', 'I')}) AS u FROM ({_EDITED})"
OP12_SQL = rf"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c // 256, crc[CAST(xor(c, b) % 256 AS INTEGER) + 1])), 4294967295) % 20 AS kind FROM conversations, t),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
      unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE kind <> 0),
f AS (SELECT *, row_number() OVER c AS i, lag(substr(role, 1, 1)) OVER c AS before,
             CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1
                  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 2
                  WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 3 ELSE 0 END AS fault
      FROM d WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
v AS (SELECT conv_id, list(role ORDER BY i) AS roles, list(text ORDER BY i) AS texts, list(fault ORDER BY i) AS faults,
             coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
             count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || substr(role, 1, 1) NOT IN ('su', 'ua', 'au')) AS illegal
      FROM f GROUP BY conv_id),
w AS (
  SELECT conv_id, roles, faults, 0 AS pos, '000000000' AS s0, CAST(NULL AS VARCHAR) AS s1, '000000003I' AS s2, '000000006II' AS s3 FROM v
  UNION ALL SELECT conv_id, roles, faults, pos, s0, s1, u, least(s3, {_more("u", "3", "I")}) FROM ({_USER})),
best AS (SELECT conv_id, least(s0, s3) AS best FROM w WHERE pos = len(roles)),
a AS (SELECT conv_id, CAST(substr(best, 1, 9) AS BIGINT) AS cost, substr(best, 10) AS audit FROM best),
e AS (SELECT conv_id, unnest(string_split(audit, '')) AS l, generate_subscripts(string_split(audit, ''), 1) AS p FROM a WHERE audit <> ''),
n AS (SELECT *, count(*) FILTER (WHERE l <> 'I') OVER o AS nth, count(*) FILTER (WHERE l <> 'D') OVER o AS place FROM e WINDOW o AS (PARTITION BY conv_id ORDER BY p)),
m AS (SELECT n.conv_id, l, place, CASE WHEN l <> 'I' THEN roles[nth] END AS role, CASE WHEN l <> 'I' THEN texts[nth] END AS text FROM n JOIN v ON v.conv_id IS NOT DISTINCT FROM n.conv_id WHERE l <> 'D'),
y AS (SELECT *, max(CASE WHEN place = 1 AND l = 'K' AND role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS system FROM m),
h AS (SELECT conv_id, sha256(string_agg(CASE WHEN l = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY place)) AS hash FROM y GROUP BY conv_id),
c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(hash, sha256('')) AS repaired_sha256
FROM c LEFT JOIN v ON v.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM c.conv_id
"""


#: The first four filters of the audit; E finds the duplicates.
def _failures() -> dict[str, Column]:
    text, words = F.col("text"), filteraudit.words(F.col("text"))
    return {"A": F.size(words) < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), "C": 100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 2 * F.length("text").cast("long"), "D": text.rlike("[#$%&*|]")}


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every order of five filters removes, step by step and by source; see :func:`filteraudit.flagged` for nulls and
    repeats, :func:`filteraudit.labelled` for labels. Of an empty table nothing is returned."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("part"), "text")
    flags = filteraudit.flagged(docs, _failures(), "E")
    return filteraudit.audit(filteraudit.labelled(flags, _table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")), "ABCDE")


OP13_SQL = r"""
WITH l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS later FROM d),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
             + CASE WHEN 100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(text) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN later THEN 16 ELSE 0 END AS mask
      FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
st AS (SELECT filter_order, step, bits[step] AS own, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before FROM o, (SELECT unnest(range(1, 6)) AS step))
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
       CAST(coalesce(sum(n) FILTER (WHERE mask & (before | own) = 0), 0) AS BIGINT) AS kept,
       CAST(coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & before = 0), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & before <> 0), 0) AS BIGINT) AS redundant,
       CAST(coalesce(sum(n) FILTER (WHERE mask = own), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(good) FILTER (WHERE mask & own <> 0 AND mask & before = 0), 0) AS BIGINT) AS good_lost,
       CAST(coalesce(sum(toxic) FILTER (WHERE mask & own <> 0 AND mask & before = 0), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(n * 120 // nullif(bit_count(mask), 0)) FILTER (WHERE mask & own <> 0), 0) AS BIGINT) AS shapley
FROM c, st GROUP BY part, filter_order, step
"""


QUERIES = {"op1_mix_sources": op1_mix_sources, "op2_imatch_fingerprints": op2_imatch_fingerprints, "op3_bitslice_topk": op3_bitslice_topk, "op4_line_dedup": op4_line_dedup, "op5_warc_archive": op5_warc_archive, "op6_superkmer_dedup": op6_superkmer_dedup, "op7_language_id": op7_language_id, "op8_simple8b_ids": op8_simple8b_ids, "op9_pow2_packing": op9_pow2_packing, "op10_minhash_near_dedup": op10_minhash_near_dedup, "op11_rp_forest": op11_rp_forest, "op12_turn_repair": op12_turn_repair, "op13_filter_audit": op13_filter_audit}
ORACLE = {"op1_mix_sources": OP1_SQL, "op3_bitslice_topk": OP3_SQL, "op4_line_dedup": OP4_SQL, "op5_warc_archive": OP5_SQL, "op6_superkmer_dedup": OP6_SQL, "op7_language_id": OP7_SQL, "op10_minhash_near_dedup": OP10_SQL, "op12_turn_repair": OP12_SQL, "op13_filter_audit": OP13_SQL}
