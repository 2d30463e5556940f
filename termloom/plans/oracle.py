"""DuckDB twins of the queries, written apart from the Spark plans: nested loops and windows where those use equi-joins."""

from __future__ import annotations

from ..config import LATIN
from ..functions import fixed

TOKEN = LATIN.token
STOP = ", ".join(f"'{w}'" for w in LATIN.stop_words)

TOK = f"tok AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS t FROM documents))"
CNT = f"{TOK}, cnt AS (SELECT doc_id, term, count(*) AS frequency FROM tok GROUP BY ALL)"
WORDS = r"wl AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents WHERE len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) > 0)"
WINDOWS = f"""{WORDS}, win AS (
  SELECT doc_id, CAST(s // 50 AS INTEGER) AS chunk_id, CAST(s AS INTEGER) AS start_word, list_slice(w, s + 1, s + 100) AS p
  FROM (SELECT doc_id, w, unnest(range(0, len(w), 50)) AS s FROM wl)),
winx AS (SELECT *, CAST(len(p) AS INTEGER) AS n_words, array_to_string(p, ' ') AS chunk FROM win WHERE len(p) >= 10)"""
TFIDF = f"""{WINDOWS},
ct AS (SELECT doc_id, chunk_id, term, count(*) AS tf FROM (SELECT doc_id, chunk_id, unnest(regexp_extract_all(chunk, '{TOKEN}')) AS term FROM winx) GROUP BY ALL),
nch AS (SELECT doc_id, count(*) AS n FROM winx GROUP BY ALL),
tfi AS (SELECT doc_id, term, (1 + ln(max(tf))) * (ln((any_value(n) + 1) / (count(*) + 1)) + 1) AS tfidf FROM ct JOIN nch USING (doc_id) GROUP BY doc_id, term)"""


def _pairs(source: str, shortest: int = 2) -> str:
    """(doc_id, term, container, cf): parts of the lengths that a document's terms have, met by equality."""
    lengths = f"SELECT DISTINCT doc_id, length(term) AS k FROM {source} WHERE length(term) >= {shortest}"
    parts = f"SELECT doc_id, container, cf, substr(container, i, k) AS term FROM (SELECT c.doc_id, c.term AS container, c.frequency AS cf, k, unnest(range(1, length(c.term) - k + 2)) AS i FROM {source} c JOIN ({lengths}) l ON c.doc_id = l.doc_id AND l.k < length(c.term))"
    return f"SELECT DISTINCT p.doc_id, p.term, p.container, p.cf FROM ({parts}) p SEMI JOIN {source} a ON p.doc_id = a.doc_id AND p.term = a.term"


def _cvalue(weight: str, source: str = "cnt") -> str:
    return f"con AS (SELECT doc_id, term, avg(cf) AS m FROM ({_pairs(source)}) GROUP BY ALL), cv AS (SELECT c.*, greatest(0.0, {weight} * (c.frequency - coalesce(con.m, 0.0))) AS c_value FROM {source} c LEFT JOIN con USING (doc_id, term))"


W1, W2, W3 = "log2(length(c.term) + 1)", "log2(length(c.term))", "log2(greatest(2, length(c.term)))"
SCORED = f"""{CNT}, {TFIDF}, {_cvalue(W1)},
both_ AS (SELECT cv.*, coalesce(tfidf, 0.0) AS tfidf FROM cv LEFT JOIN tfi USING (doc_id, term)),
nrm AS (SELECT *,
  CASE WHEN max(tfidf) OVER d = min(tfidf) OVER d THEN 0.5 ELSE (tfidf - min(tfidf) OVER d) / (max(tfidf) OVER d - min(tfidf) OVER d) END AS tn,
  CASE WHEN max(c_value) OVER d = min(c_value) OVER d THEN 0.5 ELSE (c_value - min(c_value) OVER d) / (max(c_value) OVER d - min(c_value) OVER d) END AS cn
  FROM both_ WINDOW d AS (PARTITION BY doc_id)),
scored AS (SELECT doc_id, term, frequency, tfidf, c_value, round(0.3 * tn + 0.7 * cn, 9) AS score FROM nrm WHERE frequency >= 2)"""


def _elbow(source: str) -> str:
    return f"""
rk AS (SELECT doc_id, term, score, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n, lag(score) OVER o AS prev FROM {source} WINDOW o AS (PARTITION BY doc_id ORDER BY score DESC, term)),
rt AS (SELECT *, CASE WHEN i >= 1 AND i < least(n - 1, 100) AND score > 0 THEN (prev - score) / score END AS rate,
         round(sum(CASE WHEN i < 100 THEN score ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY score DESC, term ROWS UNBOUNDED PRECEDING), 9) AS run,
         round(0.8 * sum(CASE WHEN i < 100 THEN score ELSE 0 END) OVER (PARTITION BY doc_id), 9) AS goal FROM rk),
pr AS (SELECT doc_id, max(n) AS n, max(rate) AS best, avg(rate) AS mean, min(CASE WHEN i < 100 AND run >= goal THEN i + 1 END) AS part FROM rt GROUP BY doc_id),
fa AS (SELECT rt.doc_id, min(i) AS fi FROM rt JOIN pr USING (doc_id) WHERE rate = best GROUP BY rt.doc_id),
eb AS (SELECT pr.doc_id, n, CAST(CASE WHEN best > 2 * mean THEN least(floor(1.2 * fi), 100) ELSE 20 END AS BIGINT) AS elbow, CAST(coalesce(part, 100) AS BIGINT) AS contribution FROM pr LEFT JOIN fa USING (doc_id)),
cu AS (SELECT *, CAST(CASE WHEN n <= 20 THEN n ELSE greatest(20, least(elbow, contribution, n, 100)) END AS BIGINT) AS cutoff FROM eb)"""


def _penalty(source: str) -> str:
    return f"mx AS (SELECT doc_id, term, max(cf) AS m FROM ({_pairs(source)}) GROUP BY ALL), pen AS (SELECT s.*, CASE WHEN m > 0.1 * s.frequency THEN CASE WHEN m / s.frequency > 0.2 THEN 0.2 ELSE 0.4 END ELSE 1.0 END AS penalty FROM {source} s LEFT JOIN mx USING (doc_id, term))"


PPL = "CAST(least(60.0, greatest(10.0, 20 + CASE WHEN regexp_matches(term, '[A-Z][0-9]|[0-9][A-Z]') THEN 15 ELSE 0 END + CASE WHEN length(term) > 8 THEN 10 WHEN length(term) > 5 THEN 5 ELSE 0 END + CASE WHEN regexp_matches(term, '^[ァ-ヴー]+$') AND length(term) > 4 THEN 8 ELSE 0 END + CASE WHEN frequency = 1 THEN 10 WHEN frequency = 2 THEN 5 ELSE 0 END + CASE WHEN regexp_matches(term, '^[A-Z]{2,}$') THEN 12 ELSE 0 END)) AS DOUBLE)"
PPT = f"{CNT}, pp AS (SELECT *, {PPL} AS perplexity FROM cnt)"
L2 = r"wc AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents) GROUP BY ALL), lf AS (SELECT cnt.doc_id, cnt.term, coalesce(n, 0) AS n FROM cnt LEFT JOIN wc USING (doc_id, term)), lt AS (SELECT *, CASE WHEN sum(n * n) OVER d > 0 THEN n / sqrt(sum(n * n) OVER d) ELSE 0.0 END AS tfidf FROM lf WINDOW d AS (PARTITION BY doc_id))"
EVAL = f"""{CNT}, {_cvalue(W2)}, {L2},
l2 AS (SELECT cv.*, tfidf FROM cv JOIN lt USING (doc_id, term)),
sc AS (SELECT *, round(0.5 * c_value + 30 * tfidf + 0.2 * ln(frequency + 1), 9) AS score FROM l2),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM sc) WHERE rank <= 100),
ev AS (SELECT *, round(0.4 * score + 0.4 * (100 - perplexity) + 20 * 0.1, 9) AS priority_score, CASE WHEN perplexity < 30 THEN 'high' WHEN perplexity > 70 THEN 'low' ELSE 'medium' END AS confidence FROM (SELECT *, {PPL} AS perplexity FROM tp))"""


def _nc() -> str:
    context = "substr(text, greatest(st - 30, 1), least(st - 1, 30)) || substr(text, st + length(term), 30)"
    return f"""{CNT}, c2 AS (SELECT * FROM cnt WHERE frequency >= 2), {_cvalue(W3, 'c2')}, {places('c2')},
cw AS (SELECT doc_id, term, regexp_extract_all({context}, '[ぁ-ん]+|[ァ-ヴー]+|[一-龥]+|[A-Za-z0-9]+') AS w FROM pl),
nb AS (SELECT DISTINCT doc_id, term, unnest(list_concat(list_slice(w, 1, 3), list_slice(w, greatest(len(w) - 2, 1), len(w)))) AS word FROM cw),
wt AS (SELECT doc_id, term, avg(w) AS m FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, word) AS w FROM nb) GROUP BY ALL),
nc AS (SELECT cv.*, coalesce(0.8 * c_value + 0.2 * c_value * m, c_value) AS nc_value FROM cv LEFT JOIN wt USING (doc_id, term))"""


SENT = f"sen AS (SELECT doc_id, i AS sentence, unnest(list_distinct(regexp_extract_all(s, '{TOKEN}'))) AS term FROM (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split_regex(text, '[.!?\\n]+') AS p FROM documents)))"
COSINE = "list_sum(list_transform(list_zip(a, b), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
NORM = "sqrt(list_sum(list_transform({0}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"
SIM = f"sim AS (SELECT vec_id, label, round({COSINE} / ({NORM.format('a')} * {NORM.format('b')}), 9) AS similarity, label = 0 AS is_unknown FROM (SELECT x.vec_id, x.label, x.embedding AS a, y.embedding AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1))"
KNN = f"""pr AS (SELECT x.vec_id AS src, y.vec_id AS dst, x.embedding AS a, y.embedding AS b FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id),
ws AS (SELECT src, dst, {COSINE} / ({NORM.format('a')} * {NORM.format('b')}) AS weight FROM pr),
kn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(weight, 12) DESC, dst) AS r FROM ws WHERE weight >= 0.3) WHERE r <= 12),
edges AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(weight) AS weight FROM kn GROUP BY 1, 2)"""
GRAMS = f"""{TOK}, nx AS (SELECT doc_id, term AS t1, lower(term) IN ({STOP}) AS s1, lead(term) OVER w AS n2, lead(term, 2) OVER w AS n3, lag(term) OVER w AS p FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ns AS (SELECT doc_id, t1, CASE WHEN lower(n2) NOT IN ({STOP}) THEN n2 END AS t2, CASE WHEN lower(n2) NOT IN ({STOP}) AND lower(n3) NOT IN ({STOP}) THEN n3 END AS t3, p IS NULL OR lower(p) IN ({STOP}) AS first FROM nx WHERE NOT s1)"""


def places(source: str, table: str = "documents", keys: str = "doc_id", lower: bool = False) -> str:
    """pl(keys, term, text, k, st): the k-th of a term's places that don't overlap, from running lengths of what is between."""
    t, s = ("lower(text)", "lower(term)") if lower else ("text", "term")
    return f"""ps AS (SELECT {keys}, term, string_split({t}, {s}) AS p FROM {table} JOIN {source} USING ({keys})),
pu AS (SELECT {keys}, term, unnest(p) AS part, generate_subscripts(p, 1) AS k, len(p) AS np FROM ps),
pc AS (SELECT {keys}, term, k, np, CAST(1 + sum(length(part)) OVER (PARTITION BY {keys}, term ORDER BY k) + (k - 1) * length(term) AS BIGINT) AS st FROM pu),
pl AS (SELECT pc.*, text FROM pc JOIN {table} USING ({keys}) WHERE k < np)"""


QUALITY = "CAST(least(1.0, CASE WHEN length(masked_text) < 10 THEN 0.5 WHEN length(masked_text) > 200 THEN 0.8 ELSE 1.0 END * CASE WHEN (instr(masked_text, '[MASK]') - 1) / length(masked_text) < 0.1 OR (instr(masked_text, '[MASK]') - 1) / length(masked_text) > 0.9 THEN 0.7 ELSE 1.0 END * CASE WHEN regexp_matches(masked_text, '[。、]') THEN 1.1 ELSE 1.0 END * CASE WHEN nw < 5 THEN 0.6 WHEN nw > 15 THEN 1.2 ELSE 1.0 END) AS DOUBLE)"
TARGETS = "tg AS (SELECT doc_id, term FROM cnt WHERE frequency >= 2)"
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
HEAD = f"""{CNT}, hw AS (SELECT term AS headword, lower(term) AS key, ['x-' || term, term || '-' || lang] AS synonyms, lang || ' word' AS definition, CASE WHEN lang <> 'en' THEN lang END AS category, source, doc_id AS ord FROM cnt JOIN documents USING (doc_id) WHERE frequency >= 2)"""

_VALID = f"(term NOT IN ({STOP}) AND len(list_filter([{STOP}], lambda x: length(term) > length(x) AND (starts_with(term, x) OR ends_with(term, x)))) = 0)"


def _merged(name: str, where: str) -> str:
    return f"""{name} AS (SELECT h.key AS headword, list_sort(list_distinct(flatten(list(synonyms)))) AS synonyms, array_to_string(list_sort(list_distinct(list(definition))), ' / ') AS definition, arg_min(category, ord) FILTER (WHERE category IS NOT NULL) AS category, list_sort(list_distinct(list(source))) AS sources FROM hw h WHERE {where} GROUP BY h.key),
{name}c AS (SELECT *, len(synonyms) / 10 AS confidence FROM {name})"""


_DF = ", ".join(f"('{t}', {n})" for t, n in fixed.DOC_FREQ.items())
_GUESS = "CASE WHEN length(term) <= 2 THEN 5000 WHEN length(term) >= 8 THEN 50 ELSE 500 END"
_GUESS = f"CASE WHEN len(regexp_extract_all(term, '[ァ-ヴー]')) >= 0.5 * length(term) THEN least({_GUESS}, 200) ELSE {_GUESS} END"
_GUESS = f"CASE WHEN regexp_matches(term, '[A-Za-z0-9]') THEN least({_GUESS}, 100) ELSE {_GUESS} END"


def _template(kind: str, part: str, words: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"[{listed}][CAST(('0x' || substr(md5(term || '|{kind}|{part}'), 1, 8)) AS BIGINT) % {len(words)} + 1]"


_TEMPLATES = " UNION ALL ".join(f"SELECT term, '{k}' AS type, {_template(k, 'head', h)} || {_template(k, 'tail', t)} AS masked_text FROM tm" for k, (h, t) in fixed.MASK_TEMPLATES.items())
FEATURES = {
    "technical_density": "CASE WHEN nw > 0 THEN (k3 + e3 + nu) / nw ELSE 0.0 END",
    "mixed_ratio": "CASE WHEN nw > 0 THEN (k3 + e3) / nw ELSE 0.0 END",
    "abbreviations": "CASE WHEN nw > 0 THEN ab ELSE 0 END",
}


def _raw_features(col: str) -> str:
    return rf"len(list_filter(string_split_regex({col}, '\s+'), lambda x: x <> '')) AS nw, len(regexp_extract_all({col}, '[ア-ヴー]{{3,}}')) AS k3, len(regexp_extract_all({col}, '[A-Za-z]{{3,}}')) AS e3, len(regexp_extract_all({col}, '\d+\.?\d*')) AS nu, len(regexp_extract_all({col}, '[A-Z]{{2,}}')) AS ab"


ORACLE = {
    "term_score_topk": f"WITH {SCORED}, {_penalty('scored')}, fin AS (SELECT doc_id, term, frequency, tfidf, c_value, round(score * penalty, 9) AS score FROM pen), {_elbow('fin')} SELECT r.doc_id, r.term, f.frequency, round(f.tfidf, 6) AS tfidf, round(f.c_value, 6) AS c_value, round(f.score + 2.55e-8, 6) AS score, r.i + 1 AS rank FROM rk r JOIN fin f USING (doc_id, term) JOIN cu USING (doc_id) WHERE r.i < least(cutoff, 50)",
    "term_frequency": f"WITH {CNT} SELECT * FROM cnt",
    "term_frequency_min2": f"WITH {CNT} SELECT * FROM cnt WHERE frequency >= 2",
    "doc_profile": f"SELECT doc_id, left(sha256(text), 16) AS content_hash, length(text) AS text_length, octet_length(encode(text)) AS n_bytes, round({FEATURES['technical_density']}, 6) AS technical_density, round({FEATURES['mixed_ratio']}, 6) AS mixed_ratio, {FEATURES['abbreviations']} AS abbreviations, regexp_matches(text, '[A-Za-z0-9]') AS has_alnum FROM (SELECT *, {_raw_features('text')} FROM documents)",
    "corpus_idf": f"WITH {CNT}, df AS (SELECT term, count(*) AS doc_freq FROM cnt GROUP BY term), tb(term, n) AS (VALUES {_DF}), i AS (SELECT df.term, doc_freq, ln(100001.0 / (coalesce(tb.n, {_GUESS.replace('term', 'df.term')}) + 1)) AS idf FROM df LEFT JOIN tb ON df.term = tb.term), s AS (SELECT *, least(1.0, idf / ln(100001)) AS sp FROM i) SELECT term, doc_freq, round(idf, 6) AS idf, round(sp, 6) AS speciality, CASE WHEN sp < 0.3 THEN '一般語' WHEN sp < 0.6 THEN '準専門用語' ELSE '専門用語' END AS class FROM s",
    "word_chunks_multi": f"WITH {WORDS} SELECT doc_id, size, CAST(s // size AS INTEGER) AS chunk_id, CAST(s AS INTEGER) AS start_word, md5(array_to_string(list_slice(w, s + 1, s + size), ' ')) AS chunk_md5 FROM (SELECT doc_id, w, size, unnest(range(0, len(w), size)) AS s FROM wl, (SELECT unnest([500, 100, 20]) AS size))",
    "word_windows_half": f"WITH {WINDOWS} SELECT doc_id, chunk_id, start_word, n_words, md5(chunk) AS chunk_md5 FROM winx",
    "tfidf_chunk": f"WITH {TFIDF} SELECT doc_id, term, round(tfidf, 6) AS tfidf FROM tfi",
    "tfidf_l2": f"WITH {CNT}, {L2} SELECT doc_id, term, n AS frequency, round(tfidf, 6) AS tfidf FROM lt",
    "cvalue_v1": f"WITH {CNT}, {_cvalue(W1)} SELECT doc_id, term, frequency, round(c_value, 6) AS c_value FROM cv",
    "cvalue_v2": f"WITH {CNT}, {_cvalue(W2)} SELECT doc_id, term, frequency, round(c_value, 6) AS c_value FROM cv",
    "cvalue_v3": f"WITH {CNT}, {_cvalue(W3)} SELECT doc_id, term, frequency, round(c_value, 6) AS c_value FROM cv",
    "minmax_blend": f"WITH {SCORED} SELECT doc_id, term, round(score + 2.55e-8, 6) AS score FROM scored",
    "statistical_priority": f"WITH {EVAL} SELECT doc_id, term, round(score + 2.55e-8, 6) AS score, perplexity, round(priority_score + 2.55e-8, 6) AS priority_score, confidence, rank FROM ev",
    "nc_value": f"WITH {_nc()} SELECT doc_id, term, round(nc_value, 6) AS nc_value FROM nc",
    "generic_score": f"WITH {_nc()} SELECT doc_id, term, round(nc_value * 5 + ln(frequency + 1) * 3 + CASE WHEN length(term) BETWEEN 4 AND 10 THEN 10 WHEN length(term) BETWEEN 11 AND 15 THEN 8 WHEN length(term) BETWEEN 2 AND 3 THEN 3 ELSE 1 END + 5 + CASE WHEN regexp_matches(term, '[A-Z0-9]{{2,}}') THEN 8 ELSE 0 END + CASE WHEN regexp_matches(term, '[ア-ヴー]') THEN 5 ELSE 0 END, 6) AS score FROM nc",
    "substring_penalty": f"WITH {CNT}, c2 AS (SELECT * FROM cnt WHERE frequency >= 2), {_penalty('c2')} SELECT doc_id, term, frequency, CAST(penalty AS DOUBLE) AS penalty FROM pen",
    "elbow_cutoff": f"WITH {SCORED}, {_elbow('scored')} SELECT doc_id, n, elbow, contribution, cutoff FROM cu",
    "prune_parts": f"WITH {CNT}, lost AS (SELECT DISTINCT doc_id, term FROM ({_pairs('cnt')})) SELECT doc_id, term, frequency FROM cnt ANTI JOIN lost USING (doc_id, term) WHERE length(term) >= 3",
    "token_ngrams": f"WITH {GRAMS} SELECT doc_id, term, count(*) AS frequency FROM (SELECT doc_id, t1 AS term FROM ns UNION ALL SELECT doc_id, t1 || ' ' || t2 FROM ns WHERE t2 IS NOT NULL UNION ALL SELECT doc_id, t1 || ' ' || t2 || ' ' || t3 FROM ns WHERE t3 IS NOT NULL) WHERE length(term) BETWEEN 2 AND 60 AND {_VALID} GROUP BY ALL",
    "compound_prefixes": f"WITH {GRAMS} SELECT doc_id, term, count(*) AS frequency FROM (SELECT doc_id, t1 || ' ' || t2 AS term FROM ns WHERE first AND t2 IS NOT NULL UNION ALL SELECT doc_id, t1 || ' ' || t2 || ' ' || t3 FROM ns WHERE first AND t3 IS NOT NULL) WHERE length(term) BETWEEN 3 AND 60 AND {_VALID} GROUP BY ALL",
    "kwic": f"WITH {CNT}, {TARGETS}, {places('tg')}, e AS (SELECT *, greatest(st - 50, 1) AS s, least(st + length(term) - 1 + 50, length(text)) AS e FROM pl WHERE k <= 3) SELECT doc_id, term, CAST(k - 1 AS INTEGER) AS ord, CASE WHEN s > 1 THEN '...' ELSE '' END || substr(text, s, e - s + 1) || CASE WHEN e < length(text) THEN '...' ELSE '' END AS context FROM e",
    "mask_real": f"WITH {CNT}, {TARGETS}, {places('tg')}, lr AS (SELECT *, substr(text, greatest(st - 50, 1), least(st - 1, 50)) AS l, substr(text, st + length(term), 50) AS r FROM pl), m AS (SELECT doc_id, term, CAST(k - 1 AS INTEGER) AS ord, {STRIP.format("string_split(l, '.')[-1] || '[MASK]' || CASE WHEN instr(r, '.') > 0 THEN left(r, instr(r, '.')) ELSE r END")} AS masked_text FROM lr) SELECT doc_id, term, ord, masked_text, round({QUALITY}, 6) AS quality FROM (SELECT *, len(list_filter(string_split_regex(masked_text, '\\s+'), lambda x: x <> '')) AS nw FROM m)",
    "boundary_frequency": f"WITH {CNT}, tm AS (SELECT doc_id, term FROM cnt WHERE frequency >= 2), g AS (SELECT doc_id, term, 1 AS single FROM tok UNION ALL SELECT doc_id, term || ' ' || nx, 0 FROM (SELECT *, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS nx FROM tok) WHERE nx IS NOT NULL), c AS (SELECT doc_id, term, count(*) AS n, max(single) AS single FROM g GROUP BY ALL) SELECT doc_id, term, CAST(greatest(1, coalesce(n, 0) + coalesce(single, 0)) AS BIGINT) AS frequency FROM tm LEFT JOIN c USING (doc_id, term)",
    "longest_terms": f"WITH {CNT} SELECT doc_id, term, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(term) DESC, term) AS rank FROM cnt) WHERE rank <= 100",
    "stopword_anti": f"WITH {CNT} SELECT * FROM cnt WHERE term NOT IN ({STOP})",
    "feature_perplexity": f"WITH {PPT} SELECT doc_id, term, perplexity, CASE WHEN perplexity > 30 THEN 'high_confidence' WHEN perplexity > 20 THEN 'medium_confidence' ELSE 'low_confidence' END AS confidence FROM pp",
    "confidence_static": f"WITH {PPT} SELECT doc_id, term, CASE WHEN perplexity < 30 THEN 'high' WHEN perplexity > 70 THEN 'low' ELSE 'medium' END AS three_way, CASE WHEN perplexity < 20 THEN 'high_confidence' WHEN perplexity < 50 THEN 'medium_confidence' ELSE 'low_confidence' END AS steps, CASE WHEN perplexity > 25 THEN 'high_confidence' WHEN perplexity > 15 THEN 'medium_confidence' ELSE 'low_confidence' END AS inverted FROM pp",
    "confidence_dynamic": f"WITH {PPT}, q AS (SELECT quantile_cont(perplexity, 0.7) AS p70, quantile_cont(perplexity, 0.9) AS p90 FROM pp WHERE perplexity <> 50) SELECT CASE WHEN perplexity > p90 THEN 'high_confidence' WHEN perplexity > p70 THEN 'medium_confidence' ELSE 'low_confidence' END AS confidence, count(*) AS n, min(perplexity) AS lowest, max(perplexity) AS highest FROM pp, q GROUP BY 1",
    "hotspots": f"WITH {WORDS}, bl AS (SELECT doc_id, size, CAST(s // size AS INTEGER) AS chunk_id, array_to_string(list_slice(w, s + 1, s + size), ' ') AS chunk FROM (SELECT doc_id, w, size, unnest(range(0, len(w), size)) AS s FROM wl, (SELECT unnest([500, 100, 20]) AS size))), f AS (SELECT *, {_raw_features('chunk')} FROM bl), p AS (SELECT *, least(95.0, 40.0 + CASE WHEN {FEATURES['technical_density']} > 0.3 THEN 20.0 ELSE 0.0 END + CASE WHEN {FEATURES['mixed_ratio']} > 0.2 THEN 15.0 ELSE 0.0 END + CASE WHEN {FEATURES['abbreviations']} > 2 THEN 10.0 ELSE 0.0 END) + length(chunk) / 100 AS perplexity FROM f) SELECT doc_id, size, chunk_id, round(perplexity, 6) AS perplexity, perplexity > round(avg(perplexity) OVER w + 1.5 * stddev_pop(perplexity) OVER w, 9) AS is_hotspot FROM p WINDOW w AS (PARTITION BY doc_id, size)",
    "cooccur_sentence": f"WITH {CNT}, {SENT}, fs AS (SELECT s.* FROM sen s SEMI JOIN (SELECT * FROM cnt WHERE frequency >= 2) USING (doc_id, term)) SELECT x.doc_id, x.term AS a, y.term AS b, count(*) AS n FROM fs x JOIN fs y ON x.doc_id = y.doc_id AND x.sentence = y.sentence AND x.term < y.term GROUP BY ALL",
    "cooccur_words": f"WITH {CNT}, {WORDS}, {TARGETS}, wp AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM wl), hw AS (SELECT w.doc_id, w.word AS at_word, t.term FROM (SELECT DISTINCT doc_id, word FROM wp) w JOIN tg t ON w.doc_id = t.doc_id AND contains(w.word, t.term)), nn AS (SELECT a.doc_id, a.word AS at_word, CASE WHEN b.pos < a.pos THEN 'before' ELSE 'after' END AS side, b.word, count(*) AS n FROM wp a JOIN (SELECT doc_id, word, pos, unnest([-5, -4, -3, -2, -1, 1, 2, 3, 4, 5]) AS d FROM wp) b ON a.doc_id = b.doc_id AND a.pos = b.pos + b.d GROUP BY ALL), n AS (SELECT doc_id, term, side, word, CAST(sum(n) AS BIGINT) AS n FROM nn JOIN hw USING (doc_id, at_word) GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, term, side ORDER BY n DESC, word) AS rank FROM n) WHERE rank <= 3",
    "knn_graph": f"WITH {KNN} SELECT src, dst, round(weight, 5) AS weight FROM edges",
    "personalised_weights": "SELECT vec_id AS id, round(pow(label + 1, 0.7) / sum(pow(label + 1, 0.7)) OVER (), 9) AS p FROM embeddings",
    "cosine_pairs": f"WITH {SIM} SELECT vec_id, round(similarity, 6) AS similarity FROM sim",
    "similarity_stats": f"WITH {SIM} SELECT count(*) AS n, round(avg(similarity), 6) AS mean, round(median(similarity), 6) AS median, round(stddev_pop(similarity), 6) AS sigma, round(min(similarity), 6) AS lowest, round(max(similarity), 6) AS highest FROM sim WHERE similarity >= 0 AND NOT is_unknown",
    "threshold_counts": f"WITH {SIM} SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (WHERE similarity >= 0 AND similarity < t) AS n FROM sim, (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.8]) AS t) GROUP BY t",
    "unknown_terms": f"WITH {SIM}, v AS (SELECT *, CASE WHEN is_unknown THEN 0.0 ELSE similarity END AS value FROM sim) SELECT vec_id, round(value, 6) AS similarity, is_unknown AS explicit, is_unknown OR value < 0.7 AS unknown, CASE WHEN value < 0.4 THEN 'low' WHEN value < 0.6 THEN 'fair' WHEN value < 0.8 THEN 'good' ELSE 'high' END AS band FROM v",
    "mask_templates": f"WITH tm AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{TOKEN}')) AS term FROM benchmark) {_TEMPLATES}",
    "occurrence_counts": "SELECT item_id, CAST((length(text) - length(replace(text, t, ''))) / length(t) AS BIGINT) AS apart, len(list_filter(range(1, length(text)), lambda i: substr(text, i, 2) = t)) AS overlapping, len(string_split(text, t)) - 1 AS places FROM (SELECT *, substr(text, 3, 2) AS t FROM benchmark)",
    "token_perplexity": f"WITH t AS (SELECT item_id, regexp_extract_all(text, '{TOKEN}') AS k FROM benchmark), l AS (SELECT item_id, k[1] AS f, unnest(k) AS tok, generate_subscripts(k, 1) - 1 AS i FROM t), p AS (SELECT *, -(CAST(('0x' || substr(md5(tok || '|' || i), 1, 4)) AS BIGINT) / 10000) AS lp FROM l) SELECT item_id, count(*) AS n_tokens, round(exp(-avg(lp)), 6) AS perplexity, round(coalesce(avg(lp) FILTER (WHERE contains(tok, f) OR contains(f, tok)), -3.0), 6) AS term_logprob FROM p GROUP BY item_id",
    "merge_terms": f"WITH {CNT} SELECT term, CAST(sum(frequency) AS BIGINT) AS frequency, round(max(frequency / 10), 6) AS score, arg_max(source || ':' || term, (length(source), -doc_id)) AS definition, count(*) AS n_contexts, arg_min(source, doc_id) AS metadata FROM cnt JOIN documents USING (doc_id) GROUP BY term",
    "merge_headwords": f"WITH {HEAD}, {_merged('m', 'true')} SELECT headword AS key, array_to_string(synonyms, ',') AS synonyms, definition, category, array_to_string(sources, ',') AS source_docs FROM m",
    "dictionary_upsert": f"WITH {HEAD}, {_merged('o', 'ord % 2 = 0')}, {_merged('n', 'ord % 2 = 1')} SELECT coalesce(n.headword, o.headword) AS headword, array_to_string(list_sort(list_distinct(list_concat(coalesce(o.synonyms, []), coalesce(n.synonyms, [])))), ',') AS synonyms, coalesce(nullif(n.definition, ''), o.definition, n.definition) AS definition, coalesce(n.category, o.category) AS category, round(greatest(n.confidence, o.confidence), 6) AS confidence, array_to_string(list_sort(list_distinct(list_concat(coalesce(o.sources, []), coalesce(n.sources, [])))), ',') AS source_docs, n.headword IS NOT NULL AS touched FROM oc o FULL JOIN nc n ON o.headword = n.headword",
    "dictionary_search": f"WITH {HEAD}, {_merged('o', 'true')} SELECT headword, round(confidence, 6) AS confidence FROM oc WHERE headword ILIKE '%TION%' OR list_contains(synonyms, 'TION') ORDER BY confidence DESC, headword LIMIT 10",
    "dictionary_stats": f"WITH {HEAD}, {_merged('o', 'true')} SELECT count(*) AS terms, count(*) FILTER (WHERE len(synonyms) > 0) AS with_synonyms, count(*) FILTER (WHERE coalesce(definition, '') <> '') AS with_definition, count(*) FILTER (WHERE coalesce(category, '') <> '') AS with_category, round(avg(len(synonyms)), 6) AS avg_synonyms FROM o",
    "term_statistics": f"WITH {SCORED}, s6 AS (SELECT doc_id, term, frequency, round(score + 2.55e-8, 6) AS score FROM scored) SELECT count(DISTINCT doc_id) AS files, count(*) AS terms, count(DISTINCT term) AS distinct_terms, round(avg(score), 5) AS avg_score, round(max(score), 5) AS max_score, round(min(score), 5) AS min_score, round(avg(frequency), 5) AS avg_frequency, max(frequency) AS max_frequency FROM s6",
    "run_statistics": f"WITH {EVAL}, n AS (SELECT count(*) AS total, count(*) FILTER (WHERE confidence = 'high') AS high, count(*) FILTER (WHERE confidence = 'medium') AS medium, count(*) FILTER (WHERE confidence = 'low') AS low FROM ev) SELECT *, round(coalesce(high / nullif(total, 0), 0.0), 6) AS auto_approved_ratio, round(coalesce((medium + low) / nullif(total, 0), 0.0), 6) AS manual_review_ratio FROM n",
    "review_candidates": f"WITH {EVAL}, g AS (SELECT term, max(priority_score) AS priority_score, min(confidence) AS confidence FROM ev GROUP BY term) SELECT term, round(priority_score + 2.55e-8, 6) AS priority_score, confidence FROM g WHERE confidence IN ('low', 'medium') ORDER BY g.priority_score DESC, term LIMIT 50",
    "graph_semi": f"WITH {CNT}, {SENT}, fq AS (SELECT doc_id, term FROM cnt WHERE frequency >= 2), ins AS (SELECT s.* FROM sen s SEMI JOIN fq USING (doc_id, term)) SELECT DISTINCT a.doc_id, a.term FROM ins a JOIN ins b ON a.doc_id = b.doc_id AND a.sentence = b.sentence AND a.term <> b.term",
    "doc_dedup": "SELECT left(sha256(text), 16) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "sentence_split": "WITH p AS (SELECT doc_id, list_filter(string_split(replace(text, chr(10), '.'), '.'), lambda x: trim(x, ' ') <> '') AS s FROM documents) SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS ord, md5(unnest(s)) AS sentence_md5 FROM p",
}
