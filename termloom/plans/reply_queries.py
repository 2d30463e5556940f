"""Queries of what is read from a provider's replies. The stub's replies follow from digests, so DuckDB can give them too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import chunkers, graph, passes, perplexity, rank, stats, vectors
from ..sources.provider import Stub, embed_one, embed_unit
from ..sources.shared import cut
from .oracle import CNT, COSINE, KNN, NORM, TOKEN, WINDOWS
from .registry import query, twin

_WORDS = f"b AS (SELECT item_id, text, regexp_extract_all(text, '{TOKEN}') AS w FROM benchmark), tm AS (SELECT DISTINCT unnest(w) AS term FROM b)"


def _tokens(c: str = "text") -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def _terms(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.explode(_tokens()).alias("term")).distinct()


#: Upper case of a-z alone: engines differ on other letters.
_AZ = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _up(c: Column) -> Column:
    return F.translate(c, *_AZ)


def _sql_up(c: str) -> str:
    return f"translate({c}, '{_AZ[0]}', '{_AZ[1]}')"


def _digest(c: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(c), 1, digits), 16, 10).cast("long")


def _sql_digest(c: str, digits: int) -> str:
    return f"CAST(('0x' || substr(md5({c}), 1, {digits})) AS BIGINT)"


_D = _sql_digest("term", 2)
_REPLY = f"CASE {_D} % 6 WHEN 0 THEN 'YES | ' || term || ' | x' WHEN 1 THEN ' no | ' || term WHEN 2 THEN 'b) ' || term WHEN 3 THEN 'score ' || ({_D} % 120) || '/10' WHEN 4 THEN '不明 ' || term || ' おそらく' ELSE term END"
_INT = "nullif(regexp_extract(r, '([0-9]+)', 1), '')"


@twin(f"""WITH {_WORDS}, r AS (SELECT term, {_D} AS d, {_REPLY} AS r FROM tm), i AS (SELECT *, CAST({_INT} AS DOUBLE) AS n FROM r)
SELECT term, CASE WHEN starts_with(upper(trim(r, ' ')), 'YES') THEN true WHEN starts_with(upper(trim(r, ' ')), 'NO') THEN false END AS yes,
CASE WHEN instr(r, '|') > 0 THEN trim(substr(r, instr(r, '|') + 1), ' ') END AS rest, n AS first_integer,
CASE upper(substr(trim(r, ' '), 1, 1)) WHEN 'A' THEN 10.0 WHEN 'B' THEN 18.0 WHEN 'C' THEN 28.0 WHEN 'D' THEN 40.0 ELSE 25.0 END::DOUBLE AS choice,
len(list_filter([{', '.join(f"'{w}'" for w in fixed.UNCERTAIN)}], lambda k: contains(r, k))) AS doubt,
CASE WHEN n IS NOT NULL THEN greatest(5.0, 105 - n) ELSE 50.0 END::DOUBLE AS chunk_perplexity, coalesce(5 + 9.5 * n, 50.0)::DOUBLE AS comprehension, round(coalesce(n / 10, 0.4), 6)::DOUBLE AS generality,
round(greatest(5.0, 105 - 10 * ((d % 12 + 5.0) / 2)), 6)::DOUBLE AS naturalness, round(least(100.0, greatest(5.0, 0.4 * d + 0.3 * 50 + 0.3 * 60)), 6)::DOUBLE AS weighted,
round(CASE WHEN length(term) < 3 THEN 0.1 ELSE 0.7 * (d / 256.0) + 0.3 * 0.4 END, 6)::DOUBLE AS generation, round(CASE WHEN d > 0 THEN least(100.0, greatest(5.0, -ln(d / 256.0) * 10)) END, 6)::DOUBLE AS mask FROM i""")
@query
def reply_parsing(benchmark):
    """T24 to T27, L8, L13, L18, L22 to L24, L27 on replies of all kinds."""
    d, t = _digest(F.col("term"), 2), F.col("term")
    kind = lambda k: d % 6 == k
    said = F.when(kind(0), F.concat(F.lit("YES | "), t, F.lit(" | x"))).when(kind(1), F.concat(F.lit(" no | "), t)).when(kind(2), F.concat(F.lit("b) "), t))
    said = said.when(kind(3), F.concat(F.lit("score "), (d % 120).cast("string"), F.lit("/10"))).when(kind(4), F.concat(F.lit("不明 "), t, F.lit(" おそらく"))).otherwise(t)
    rows = _terms(benchmark).withColumn("r", said).withColumn("d", d)
    r, x = F.col("r"), F.col("d").cast("double")
    yes, rest = text.verdict(r)
    found = {
        "yes": yes, "rest": rest, "first_integer": text.first_integer(r), "choice": text.choice_perplexity(r), "doubt": text.uncertain_words(r).cast("long"), "chunk_perplexity": perplexity.chunk_perplexity(r),
        "comprehension": perplexity.comprehension(r), "generality": F.round(perplexity.generality(r), 6), "naturalness": F.round(perplexity.naturalness(F.array(x % 12, F.lit(5.0))), 6),
        "weighted": F.round(perplexity.weighted(x, F.lit(50.0), F.lit(60.0)), 6), "generation": F.round(perplexity.generation_probability(t, x / 256, F.lit(0.4)), 6), "mask": F.round(perplexity.mask_perplexity(x / 256), 6),
    }
    return rows.select("term", *[c.alias(n) for n, c in found.items()])


def _sql_prompt(head: str, term: str = "term") -> str:
    return f"'{head.replace(chr(39), chr(39) * 2)}' || chr(10) || {term}"


@twin(f"""WITH {CNT}, v AS (SELECT term, sum(frequency) AS frequency, round(1 - 1 / (sum(frequency) + 1), 6) AS score, md5({_sql_prompt(passes.VALIDATE)}) AS m FROM cnt GROUP BY term),
k AS (SELECT *, CAST(('0x' || substr(m, 1, 2)) AS BIGINT) % 2 = 0 AS kept FROM v)
SELECT term, score, CAST(frequency AS BIGINT) AS frequency, kept, CASE WHEN kept THEN substr(m, 1, 8) END AS definition, CASE WHEN NOT kept THEN substr(m, 1, 8) END AS reason FROM k""")
@query
def provider_verdicts(documents):
    """Terms kept and dropped by a verdict each."""
    from ..operators import candidates

    terms = candidates.term_counts(documents).groupBy("term").agg(F.sum("frequency").alias("frequency"))
    scored = terms.withColumn("score", F.round(1 - 1 / (F.col("frequency") + 1), 6))
    return passes.validate(scored, Stub(style="verdict")).select("term", "score", "frequency", "kept", "definition", "reason")


_LONG = "w AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{8,}'))) AS w FROM benchmark)"


@twin(f"WITH {_LONG} SELECT item_id, CAST(0 AS INTEGER) AS chunk_id, w AS headword, upper(w) AS synonyms, 'about ' || w AS definition FROM w")
@query
def provider_terms(benchmark):
    """Terms of every chunk from replies in JSON."""
    chunks = benchmark.select("item_id", F.lit(0).alias("chunk_id"), F.lower("text").alias("chunk"))
    found = passes.extract_terms(chunks, Stub(style="terms"), "item_id")
    return found.select("item_id", "chunk_id", "headword", F.array_join("synonyms", ",").alias("synonyms"), "definition")


@twin(f"WITH {_LONG} SELECT w AS headword, upper(w) AS synonyms, 'about ' || w AS definition, array_to_string(list_sort(list(item_id::VARCHAR)), ',') AS sources FROM w GROUP BY w")
@query
def provider_dictionary(benchmark):
    """Extracted terms merged, sent to be consolidated and kept where the reply can't be read, with their sources."""
    chunks = benchmark.select("item_id", F.lit(0).alias("chunk_id"), F.lower("text").alias("chunk"))
    found = passes.extract_terms(chunks, Stub(style="terms"), "item_id").withColumn("source", F.col("item_id").cast("string")).withColumn("source_docs", F.array("source"))
    found = cut(found.withColumn("ord", F.col("item_id") * 10000 + F.col("ord")))
    merged = passes.consolidate(found, Stub(style="none"))
    out = passes.with_sources(merged, found.select("headword", "source"))
    return out.select("headword", F.array_join("synonyms", ",").alias("synonyms"), "definition", F.array_join("source_docs", ",").alias("sources"))


@twin(f"WITH {_LONG}, i AS (SELECT *, {_sql_digest('w', 2)} % 12 AS importance FROM w) SELECT item_id, w AS term, CAST(importance AS INTEGER) AS importance, w || ' defined' AS definition FROM i WHERE importance BETWEEN 1 AND 10")
@query
def provider_candidates(benchmark):
    """Candidates with their importance, then definitions by contexts."""
    chunks = benchmark.select("item_id", F.lower("text").alias("chunk"))
    contexts = benchmark.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), F.lit(0)))).alias("term"), F.lit("here").alias("context"))
    return passes.two_stage(chunks, contexts, Stub(style="candidates"), "item_id")


def _sql_embed(t: str) -> str:
    part = lambda k: f"list_transform(range(32), lambda i: CAST(('0x' || substr(sha256('{k}|' || {t}), CAST(2 * i + 1 AS BIGINT), 2)) AS INTEGER) - 127.5)"
    return f"list_concat({part(0)}, {part(1)})"


_UNKNOWN = f"""{_WORDS}, f AS (SELECT term, 'what ' || term || ' is' AS definition, CASE WHEN {_sql_digest(_sql_prompt(passes.CONTEXT_FREE), 2)} % 4 = 0 THEN '不明 ' ELSE 'known ' END || term AS free FROM tm),
e AS (SELECT *, {_sql_embed('definition')} AS a, {_sql_embed('free')} AS b FROM f),
s AS (SELECT term, contains(free, '不明') AS explicit, {COSINE} / ({NORM.format('a')} * {NORM.format('b')}) AS similarity FROM e),
u AS (SELECT term, CASE WHEN explicit THEN 0.0 ELSE similarity END AS similarity, explicit, explicit OR coalesce(similarity >= 0 AND similarity < 0.05, false) AS is_unknown, similarity AS raw FROM s)"""


def _evaluated(benchmark: DataFrame) -> DataFrame:
    """Terms with a definition, one without context, and the decision."""
    rows = _terms(benchmark).withColumn("definition", F.concat(F.lit("what "), "term", F.lit(" is")))
    rows = passes.similarity_rows(passes.context_free(rows, Stub(style="doubt")), Stub(64))
    return passes.unknown_terms(rows, 0.05)


@twin(f"WITH {_UNKNOWN} SELECT term, round(CASE WHEN explicit THEN 0.0 WHEN raw >= 0 THEN raw END, 6) AS similarity, explicit AS explicitly_unknown, is_unknown FROM u")
@query
def unknown_evaluation(benchmark):
    """Terms that are unknown without context."""
    return _evaluated(benchmark).select("term", F.round("similarity", 6).alias("similarity"), "explicitly_unknown", "is_unknown")


@twin(f"WITH {_UNKNOWN} SELECT count(*) AS total, count(*) FILTER (WHERE is_unknown) AS unknown, count(*) FILTER (WHERE is_unknown AND explicit) AS explicitly_unknown, count(*) FILTER (WHERE is_unknown AND NOT explicit) AS unknown_by_similarity, count(*) FILTER (WHERE NOT is_unknown) AS known, CAST(0 AS BIGINT) AS errors FROM u")
@query
def unknown_summary(benchmark):
    """A20."""
    return stats.evaluation_summary(_evaluated(benchmark))


@twin(f"WITH {_UNKNOWN} SELECT term FROM u ORDER BY CASE WHEN explicit THEN -1.0 WHEN raw < 0 THEN 999.0 ELSE raw END, term LIMIT 50")
@query
def unknown_ranking(benchmark):
    """Explicitly unknown terms first, errors last; the first fifty."""
    rows = _terms(benchmark).withColumn("definition", F.concat(F.lit("what "), "term", F.lit(" is")))
    rows = passes.similarity_rows(passes.context_free(rows, Stub(style="doubt")), Stub(64))
    return rank.unknown_first(rows.withColumn("similarity", F.round("similarity", 12))).limit(50).select("term")


#: Tokens of a response: log probabilities from digests, candidates in upper case and as they are.
_LP = lambda t, i: f"-({_sql_digest(f'{t} || {chr(39)}|{chr(39)} || {i}', 4)} / 10000)"
_RESPONSES = f"""b AS (SELECT item_id, regexp_extract_all(text, '{TOKEN}') AS w FROM benchmark),
k AS (SELECT item_id, w, generate_subscripts(w, 1) AS i, unnest(w) AS tok FROM b), lp AS (SELECT *, {_LP('tok', '(i - 1)')} AS lp FROM k)"""


def _responses(benchmark: DataFrame) -> DataFrame:
    lp = lambda t, i: -(_digest(F.concat(t, F.lit("|"), i.cast("string")), 4).cast("double") / 10000)
    one = lambda t, i: F.struct(t.alias("token"), lp(t, i).alias("logprob"))
    token = lambda t, i: F.struct(t.alias("token"), lp(t, i).alias("logprob"), F.array(F.struct(_up(t).alias("token"), (lp(t, i) - 1).alias("logprob")), one(t, i)).alias("top"))
    return benchmark.select("item_id", F.transform(_tokens(), token).alias("tokens"))


@twin(f"""WITH {_RESPONSES}, q AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN w[4] WHEN 1 THEN {_sql_up('w[2]')} ELSE 'no such' END AS term, w[1] AS first, w FROM b),
c AS (SELECT lp.item_id, q.term, lp.i, 1 AS rank, {_sql_up('tok')} AS cand, lp - 1 AS clp FROM lp JOIN q USING (item_id) UNION ALL SELECT lp.item_id, q.term, lp.i, 2, tok, lp FROM lp JOIN q USING (item_id)),
h AS (SELECT item_id, arg_min(clp, (i, rank)) AS lp, arg_min(rank, (i, rank)) AS rank FROM c WHERE contains(cand, term) GROUP BY item_id),
f AS (SELECT item_id, lp AS flp FROM lp WHERE i = 1)
SELECT q.item_id, q.term, round(CASE WHEN h.rank IS NOT NULL THEN exp(-h.lp) WHEN q.item_id % 6 = 2 THEN exp(-flp) ELSE 100.0 END, 6) AS perplexity, round(CASE WHEN h.rank IS NOT NULL THEN h.lp WHEN q.item_id % 6 = 2 THEN flp ELSE -4.6 END, 6) AS logprob, CAST(CASE WHEN h.rank IS NOT NULL THEN h.rank WHEN q.item_id % 6 = 2 THEN 1 ELSE 11 END AS INTEGER) AS rank
FROM q LEFT JOIN h USING (item_id) JOIN f USING (item_id)""")
@query
def masked_predictions(benchmark):
    """What a masked term's answers say of it."""
    w = F.transform("tokens", lambda x: x["token"])
    term = F.when(F.col("item_id") % 3 == 0, F.get(w, F.lit(3))).when(F.col("item_id") % 3 == 1, _up(F.get(w, F.lit(1)))).otherwise(F.lit("no such"))
    rows = _responses(benchmark).withColumn("term", term)
    predicted = F.when(F.col("item_id") % 6 == 2, F.concat(F.lit(" "), "term")).otherwise(F.lit("other"))
    found = perplexity.masked(F.col("tokens"), predicted, F.col("term"))
    return rows.select("item_id", "term", F.round(found["perplexity"], 6).alias("perplexity"), F.round(found["logprob"], 6).alias("logprob"), found["rank"].alias("rank"))


@twin(f"WITH {_RESPONSES} SELECT item_id, CAST(i - 1 AS INTEGER) AS pos, tok AS token, round(exp(lp), 6) AS prob, CAST(2 AS BIGINT) AS n_candidates, {_sql_up('tok')} AS first, round(exp(lp - 1), 6) AS first_prob FROM lp WHERE i <= 10")
@query
def token_details(benchmark):
    """L2: the first ten tokens and their candidates."""
    rows = _responses(benchmark).select("item_id", F.posexplode(perplexity.details(F.col("tokens"))).alias("pos", "d"))
    first = F.get("d.top_candidates", F.lit(0))
    return rows.select("item_id", "pos", F.col("d.token").alias("token"), F.round("d.prob", 6).alias("prob"), F.size("d.top_candidates").cast("long").alias("n_candidates"), first["token"].alias("first"), F.round(first["prob"], 6).alias("first_prob"))


@twin(f"""WITH {_RESPONSES}, q AS (SELECT *, w[greatest(1, len(w) // 2)] AS term FROM b), s AS (SELECT lp.item_id, q.term, lp.i, lp.lp, array_to_string(list_slice(lp.w, 1, lp.i), '') AS run FROM lp JOIN q USING (item_id)),
f AS (SELECT item_id, arg_min(lp, i) FILTER (WHERE contains(run, term)) AS a, arg_min(lp, i) FILTER (WHERE contains(lower(run), lower(term))) AS b, avg(lp) FILTER (WHERE i <= 3) AS m FROM s GROUP BY item_id)
SELECT q.item_id, q.term, round(a, 6) AS logprob, round(CASE WHEN b IS NULL THEN 50.0 ELSE least(95.0, greatest(5.0, exp(-b) * 10)) END, 6) AS scaled, round(least(100.0, greatest(5.0, exp(-m) * 10)), 6) AS forced FROM q JOIN f USING (item_id)""")
@query
def cumulative_logprobs(benchmark):
    """The token with which the running text first holds a term, scaled, and of a favoured beginning."""
    w = F.transform("tokens", lambda x: x["token"])
    rows = _responses(benchmark).withColumn("term", F.get(w, F.greatest(F.lit(1), F.floor(F.size(w) / 2)).cast("int") - 1))
    tokens, term = F.col("tokens"), F.col("term")
    scaled = passes.scaled_perplexity(passes.cumulative_logprob(tokens, term, any_case=True))
    return rows.select("item_id", "term", F.round(passes.cumulative_logprob(tokens, term), 6).alias("logprob"), F.round(scaled, 6).alias("scaled"), F.round(passes.forced_perplexity(tokens, F.lit(3)), 6).alias("forced"))


@twin(f"WITH {_WORDS}, s AS (SELECT {_D} % 9 AS k, CASE WHEN {_D} % 5 > 0 AND {_D} % 9 <> 4 THEN {_D} / 3.0 + 1 END AS p FROM tm), g AS (SELECT k, avg(p) AS p FROM s GROUP BY k) SELECT k, round(coalesce(p, 50.0), 6)::DOUBLE AS perplexity, round(coalesce(-ln(p), -3.9), 6)::DOUBLE AS avg_logprob, CASE WHEN p IS NULL THEN 'medium' WHEN p < 20 THEN 'high' WHEN p < 50 THEN 'medium' ELSE 'low' END AS confidence FROM g")
@query
def mean_perplexities(benchmark):
    """L3: means over contexts, with what stands for none."""
    d = _digest(F.col("term"), 2)
    rows = _terms(benchmark).select((d % 9).alias("k"), F.when((d % 5 > 0) & (d % 9 != 4), d / 3.0 + 1).alias("perplexity"))
    out = perplexity.mean_perplexity(rows, "k")
    return out.select("k", F.round("perplexity", 6).alias("perplexity"), F.round("avg_logprob", 6).alias("avg_logprob"), "confidence")


@twin(f"""WITH {_WORDS}, d AS (SELECT term, {_D} AS d, CASE WHEN {_D} % 7 = 0 THEN [] ELSE [term, '不明 ' || term || term, repeat('x', CAST({_D} % 40 AS INTEGER)) || ' おそらく'] END AS defs FROM tm),
v AS (SELECT *, coalesce(list_var_pop(list_transform(defs, lambda x: CAST(length(x) AS DOUBLE))), 0.0) AS var FROM d)
SELECT term, round(CASE WHEN len(defs) = 0 THEN 80.0 ELSE 40 + least(var / 10, 20.0) + 15 * 2 - CASE WHEN length(term) >= 4 THEN 10 ELSE 0 END - CASE WHEN regexp_matches(term, '[ア-ヴー]{{3,}}') THEN 5 ELSE 0 END - CASE WHEN regexp_matches(term, '[A-Z]{{2,}}') THEN 5 ELSE 0 END END, 6)::DOUBLE AS consistency FROM v""")
@query
def consistency_scores(benchmark):
    """How far a term's definitions agree."""
    d, t = _digest(F.col("term"), 2), F.col("term")
    defs = F.array(t, F.concat(F.lit("不明 "), t, t), F.concat(F.repeat(F.lit("x"), (d % 40).cast("int")), F.lit(" おそらく")))
    defs = F.when(d % 7 == 0, F.array().cast("array<string>")).otherwise(defs)
    return _terms(benchmark).select("term", F.round(perplexity.consistency(t, defs), 6).alias("consistency"))


@twin(f"""WITH {_WORDS}, d AS (SELECT term, length(term) AS n, {_D} AS d FROM tm), p AS (SELECT *, d / 257.0 AS a, CASE WHEN d % 3 > 0 THEN (d % 16) / 17.0 END AS b, (d % 10) / 10.0 AS c FROM d)
SELECT term, round(least(1.0, greatest(0.0, CASE WHEN b IS NOT NULL THEN 0.4 * a + 0.4 * b + 0.2 * c ELSE 0.4 * a + 0.4 * c END)), 6)::DOUBLE AS probability, CASE WHEN n >= 4 THEN array_to_string([n // 3, n // 2, n * 2 // 3], ',') ELSE '' END AS points FROM p""")
@query
def token_probabilities(benchmark):
    """Weighed probabilities, and where terms are cut."""
    d, t = _digest(F.col("term"), 2), F.col("term")
    p = perplexity.token_probability(d / 257.0, F.when(d % 3 > 0, (d % 16) / 17.0), (d % 10) / 10.0)
    return _terms(benchmark).select("term", F.round(p, 6).alias("probability"), F.array_join(perplexity.split_points(t).cast("array<string>"), ",").alias("points"))


_SHAPE = "CAST(least(60.0, greatest(10.0, 20 + CASE WHEN regexp_matches(term, '[A-Z][0-9]|[0-9][A-Z]') THEN 15 ELSE 0 END + CASE WHEN length(term) > 8 THEN 10 WHEN length(term) > 5 THEN 5 ELSE 0 END + CASE WHEN regexp_matches(term, '^[ァ-ヴー]+$') AND length(term) > 4 THEN 8 ELSE 0 END + CASE WHEN frequency = 1 THEN 10 WHEN frequency = 2 THEN 5 ELSE 0 END + CASE WHEN regexp_matches(term, '^[A-Z]{2,}$') THEN 12 ELSE 0 END)) AS DOUBLE)"


@twin(f"""WITH {_WORDS}, s AS (SELECT term, unnest([{_D} * 1.0, {_D} / 4.0, {_D} / 16.0]) AS p FROM tm), m AS (SELECT term, median(p) AS m FROM s WHERE p > 5 AND p < 100 GROUP BY term),
a AS (SELECT tm.term, 1 + {_D} % 3 AS frequency, m FROM tm LEFT JOIN m ON tm.term = m.term), l AS (SELECT *, {_SHAPE} AS looks FROM a)
SELECT term, round(coalesce(m, looks), 6)::DOUBLE AS perplexity, CASE WHEN m > 25 THEN 'high_confidence' WHEN m > 15 THEN 'medium_confidence' WHEN m IS NOT NULL THEN 'low_confidence' WHEN looks > 30 THEN 'high_confidence' WHEN looks > 20 THEN 'medium_confidence' ELSE 'low_confidence' END AS confidence FROM l""".replace("1 + CAST(('0x' || substr(md5(term)", "1 + CAST(('0x' || substr(md5(tm.term)"))
@query
def generic_evaluation(benchmark):
    """The median of sane samples, or the term's looks."""
    d = _digest(F.col("term"), 2)
    terms = _terms(benchmark).withColumn("frequency", 1 + d % 3)
    samples = terms.select("term", F.explode(F.array(d * 1.0, d / 4.0, d / 16.0)).alias("perplexity"))
    out = passes.generic_evaluation(samples, terms)
    return out.select("term", F.round("perplexity", 6).alias("perplexity"), "confidence")


@twin(f"""WITH {WINDOWS}, t AS (SELECT doc_id, chunk_id, list_slice(p, greatest(len(p) - 4, 1), len(p)) AS l FROM winx), k AS (SELECT doc_id, chunk_id, unnest(l) AS w, generate_subscripts(l, 1) - 1 AS i FROM t),
p AS (SELECT doc_id, chunk_id, exp(-avg({_LP('w', 'i')})) AS perplexity FROM k GROUP BY ALL)
SELECT doc_id, chunk_id, round(perplexity, 6) AS perplexity, round(-ln(perplexity), 6) AS avg_logprob, perplexity > round(avg(perplexity) OVER w + 1.5 * stddev_pop(perplexity) OVER w, 9) AS is_hotspot FROM p WINDOW w AS (PARTITION BY doc_id)""")
@query
def document_profile(documents):
    """Perplexity of word windows and its hot spots."""
    windows = chunkers.word_windows(documents).select("doc_id", "chunk_id", "chunk")
    out = passes.document_profile(windows, Stub(), "doc_id")
    return out.select("doc_id", "chunk_id", F.round("perplexity", 6).alias("perplexity"), F.round("avg_logprob", 6).alias("avg_logprob"), "is_hotspot")


@twin(f"WITH {_WORDS}, d AS (SELECT term, {_sql_digest(_sql_prompt(passes.CHOICE), 2)} % 5 AS d FROM tm) SELECT term, CASE d WHEN 0 THEN 10.0 WHEN 1 THEN 18.0 WHEN 2 THEN 28.0 WHEN 3 THEN 40.0 ELSE 25.0 END::DOUBLE AS perplexity FROM d")
@query
def choice_perplexities(benchmark):
    """A choice from A to D."""
    return passes.choice_perplexity(_terms(benchmark), Stub(style="letter")).select("term", "perplexity")


@twin(f"""WITH {_WORDS}, c AS (SELECT term, unnest([length(term) // 3, length(term) // 2, length(term) * 2 // 3]) AS place FROM tm WHERE length(term) >= 4), t AS (SELECT *, unnest(['er', 'en', 'on']) AS ending FROM c),
h AS (SELECT term, place, contains('it is ' || substr(term, 1, place) || ending, term) AS hit, contains('it is ' || substr(term, 1, place) || ending, term) AND place > 1 AND 6 + place + 2 <= length(term) + 3 AS tight FROM t),
p AS (SELECT term, avg(hit::INT) AS p, avg(tight::INT) FILTER (WHERE place > 1) AS s FROM h GROUP BY term)
SELECT tm.term, round(CASE WHEN length(tm.term) < 4 THEN 0.2 ELSE p END, 6)::DOUBLE AS partial, round(CASE WHEN length(tm.term) < 4 THEN 0.2 ELSE s END, 6)::DOUBLE AS strict FROM tm LEFT JOIN p ON tm.term = p.term""")
@query
def partial_completions(benchmark):
    """How often terms are completed from parts of them, loosely and strictly."""
    loose = passes.partial_completion(_terms(benchmark), Stub(style="ending"))
    strict = passes.partial_completion(_terms(benchmark), Stub(style="ending"), strict=True).withColumnRenamed("partial", "strict")
    return loose.join(strict, "term").select("term", F.round("partial", 6).alias("partial"), F.round("strict", 6).alias("strict"))


def _sql_varied(p: str) -> str:
    d = _sql_digest(p, 2)
    return f"CASE WHEN {d} % 4 = 0 THEN '不明 ' ELSE '' END || repeat('x', {d} % 20) || ' ' || ({d} % 11)"


def _sql_score(p: str) -> str:
    return f"CAST({_sql_digest(p, 2)} % 11 AS DOUBLE)"


_MEAN = " + ".join(_sql_score(_sql_prompt(passes.NATURAL, "replace('" + x + "', '{}', term)")) for x in passes.SENTENCES)


@twin(f"""WITH {_WORDS}, d AS (SELECT term, [{', '.join(_sql_varied(_sql_prompt(passes.BRIEF, f"term || chr(10) || '{k}'")) for k in (1, 2, 3))}] AS defs, {_sql_score(_sql_prompt(passes.DIFFICULTY))} AS c, ({_MEAN}) / 3 AS n FROM tm),
s AS (SELECT *, 40 + least(list_var_pop(list_transform(defs, lambda x: CAST(length(x) AS DOUBLE))) / 10, 20.0) + 15 * len(list_filter(defs, lambda x: contains(x, '不明'))) - CASE WHEN length(term) >= 4 THEN 10 ELSE 0 END - CASE WHEN regexp_matches(term, '[A-Z]{{2,}}') THEN 5 ELSE 0 END AS a FROM d)
SELECT term, round(least(100.0, greatest(5.0, 0.4 * a + 0.3 * (5 + 9.5 * c) + 0.3 * greatest(5.0, 105 - 10 * n))), 5)::DOUBLE AS perplexity FROM s""")
@query
def fallback_perplexities(benchmark):
    """L18, L21 to L23 with their calls: definitions, difficulty and naturalness, weighed."""
    return passes.fallback_perplexity(_terms(benchmark), Stub(style="varied")).select("term", F.round("perplexity", 5).alias("perplexity"))


@query
def term_perplexities(benchmark):
    """L19, then L18 where it gives none; both have queries of their own."""
    found = passes.term_perplexity(_terms(benchmark), Stub(style="varied"), ("the station and the house {}", "a word of the night {}"))
    return found.select("term", F.round("perplexity", 5).alias("perplexity"))


@twin(f"""WITH {_WORDS}, c AS (SELECT term, unnest([length(term) // 3, length(term) // 2, length(term) * 2 // 3]) AS place FROM tm WHERE length(term) >= 4), t AS (SELECT *, unnest([1, 2, 3]) AS attempt FROM c),
h AS (SELECT term, avg(contains(trim({_sql_varied(_sql_prompt(passes.COMPLETE, "substr(term, 1, place) || chr(10) || attempt"))}, ' '), term)::INT) AS p FROM t WHERE place > 1 GROUP BY term),
g AS (SELECT tm.term, CASE WHEN length(tm.term) < 4 THEN 0.2 ELSE p END AS p, least(1.0, {_sql_score(_sql_prompt(passes.GENERALITY, 'tm.term'))} / 10) AS g FROM tm LEFT JOIN h ON tm.term = h.term)
SELECT term, round(CASE WHEN length(term) < 3 THEN 0.1 ELSE 0.7 * p + 0.3 * g END, 6)::DOUBLE AS probability FROM g""")
@query
def generation_probabilities(benchmark):
    """L13, L24 with their calls: strict completion and generality."""
    return passes.generation_probability(_terms(benchmark), Stub(style="varied")).select("term", F.round("probability", 6).alias("probability"))


@query
def precise_probabilities(benchmark):
    """L10, L12, L13 with their calls; tested against plain Python."""
    rows = benchmark.select(F.explode(F.array_distinct(_tokens())).alias("term"), "text").groupBy("term").agg(F.min("text").alias("context"))
    rows = rows.withColumn("context", F.when(F.length("term") % 3 > 0, F.col("context")))
    return passes.precise_probability(rows, Stub(style="varied")).select("term", F.round("probability", 6).alias("probability"))


@query
def generic_perplexities(documents):
    """The engine's limit of 30 best terms of every document evaluated by all methods; tested against plain
    Python."""
    from . import extract

    terms = extract.evaluated_terms(documents, most=30).select("doc_id", "term", "frequency")
    out = passes.evaluate_generic(documents, cut(terms), Stub(style="letter"))
    return out.select("doc_id", "term", "frequency", F.round("perplexity", 6).alias("perplexity"), "confidence")


@query
def input_perplexities(benchmark):
    """How well a model foresees terms in their text; tested against plain Python."""
    from ..operators import contexts

    rows = benchmark.select("item_id", "text", F.array_distinct(F.concat(_tokens(), F.array(F.lit("zzz")))).alias("terms"))
    found = contexts.occurrences(rows, 1 << 20, 3, overlapping=True, keys=("item_id",)).select("item_id", "term", "ord", F.col("left").alias("prefix"))
    every = rows.select("item_id", F.explode("terms").alias("term")).join(found, ["item_id", "term"], "left")
    out = passes.input_perplexity(cut(every), Stub(), "item_id")
    return out.select("item_id", "term", F.round("perplexity", 6).alias("perplexity"), "confidence", "samples")


@query
def sentence_perplexities(benchmark):
    """Terms behind what stands before them in a sentence; tested against plain Python."""
    parts = benchmark.select("item_id", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("ord", "sentence"))
    rows = parts.withColumn("term", F.explode(F.array_distinct(_tokens("sentence"))))
    out = passes.sentence_perplexity(rows, Stub(), "item_id")
    return out.select("item_id", "term", F.round("perplexity", 6).alias("perplexity"))


@query
def template_perplexities(benchmark):
    """Terms behind the beginnings of templates that hold words of theirs; tested against plain Python."""
    out = passes.template_perplexity(_terms(benchmark), Stub(), ("the station and the house {}", "a word of the night {}", "the station and the house {}"))
    return out.select("term", F.round("perplexity", 6).alias("perplexity"))


@query
def string_similarities(benchmark):
    """Matching blocks of neighbouring words; tested against plain Python."""
    w = _tokens()
    pairs = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b")))
    rows = benchmark.where(F.size(w) > 1).select(F.inline(pairs)).distinct()
    return rows.select("a", "b", F.round(text.string_similarity(F.col("a"), F.col("b")), 6).alias("ratio"))


@twin(f"WITH {_WORDS}, e AS (SELECT term, {_sql_embed('term')} AS a FROM tm) SELECT term, round(a[1] / {NORM.format('a')}, 6) AS first, round(a[64] / {NORM.format('a')}, 6) AS last FROM e")
@query
def embedded_terms(benchmark):
    """Vectors of length 1 of terms, met by their place."""
    terms = _terms(benchmark)
    rows = vectors.zipped(terms, embed_unit(terms, Stub(64)).select("term", "embedding"), "term")
    one = embed_one(terms, Stub(64)).select("term", F.size("embedding").alias("n"))
    return rows.join(one, "term").where("n = 64").select("term", F.round(F.get("embedding", F.lit(0)), 6).alias("first"), F.round(F.get("embedding", F.lit(63)), 6).alias("last"))


@twin(f"""WITH {KNN}, d AS (SELECT src, dst, 2 - 2 * weight AS distance FROM kn WHERE 2 - 2 * weight < 1.2), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(distance, 12), dst) AS k FROM d),
t AS (SELECT src, string_agg('text ' || dst, chr(10) || chr(10) ORDER BY k) AS context FROM r WHERE k <= 5 GROUP BY src)
SELECT v.vec_id AS src, coalesce(context, 'none') AS context FROM embeddings v LEFT JOIN t ON v.vec_id = t.src""")
@query
def similar_contexts(embeddings):
    """V4: the texts of a chunk's nearest others within a distance."""
    near = vectors.knn(embeddings).withColumn("weight", F.round("weight", 12))
    chunks = embeddings.select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("text"))
    return vectors.similar_chunks(near, chunks, 5, 1.2)


@twin(f"WITH {KNN} SELECT src, dst, round(weight * (1 + 0.3 * ln(1 + CASE WHEN (src + dst) % 5 > 0 THEN (src + dst) % 5 ELSE 0 END)), 5) AS weight FROM edges")
@query
def reweighted_edges(embeddings):
    """Edges that weigh more where their ends occur together."""
    edges = cut(graph.undirected(vectors.knn(embeddings)))
    together = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), ((F.col("src") + F.col("dst")) % 5).alias("n")).where("n > 0")
    return graph.reweight(edges, together).select("src", "dst", F.round("weight", 5).alias("weight"))


_PAGES = 20
_RANKS = f"""{KNN}, ends AS (SELECT src AS u, dst AS v, weight AS w FROM edges UNION ALL SELECT dst, src, weight FROM edges), deg AS (SELECT u, sum(w) AS d FROM ends GROUP BY u),
links AS MATERIALIZED (SELECT ends.u, v, w / d AS share FROM ends JOIN deg USING (u)), nodes AS MATERIALIZED (SELECT vec_id AS id, label + 1.0 AS base_score, pow(label + 1, 0.7) / sum(pow(label + 1, 0.7)) OVER () AS p, count(*) OVER () AS n, deg.u IS NULL AS loose FROM embeddings LEFT JOIN deg ON vec_id = deg.u),
r0 AS MATERIALIZED (SELECT id, 1.0 / n AS x FROM nodes)""" + "".join(
    f""", r{k} AS MATERIALIZED (SELECT nodes.id, 0.85 * (coalesce(g.s, 0.0) + l.lost * p) + 0.15 * p AS x FROM nodes LEFT JOIN (SELECT v, sum(share * x) AS s FROM links JOIN r{k - 1} ON u = r{k - 1}.id GROUP BY v) g ON nodes.id = g.v, (SELECT coalesce(sum(x) FILTER (WHERE loose), 0.0) AS lost FROM r{k - 1} JOIN nodes USING (id)) l)"""
    for k in range(1, _PAGES + 1)
)


@twin(f"WITH {_RANKS} SELECT id, round(x, 8) AS pagerank FROM r{_PAGES}")
def pagerank_steps() -> None:
    """Only the twin: the query stands with the first ones."""


@twin(f"WITH {_RANKS}, b AS (SELECT id, base_score, x FROM r{_PAGES} JOIN nodes USING (id)) SELECT id, round(0.6 * (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) + 0.4 * (base_score - min(base_score) OVER ()) / (max(base_score) OVER () - min(base_score) OVER ()), 5) AS score FROM b")
def fuse_scores() -> None:
    """Only the twin: the query stands with the first ones."""


@query
def document_pagerank(embeddings):
    """G1, G4 within a key: PageRank of the graph of every 64 vectors, so that graphs grow in number and not in size; tested
    against plain Python."""
    rows = embeddings.withColumn("graph", F.expr("vec_id div 64"))
    near = cut(vectors.knn_within(rows, "graph"))
    edges = graph.undirected(near).withColumn("graph", F.expr("src div 64"))
    nodes = graph.personalisation(rows.select("graph", F.col("vec_id").alias("id"), (F.col("vec_id") % 7 + 1).cast("double").alias("base_score")), 0.7, "graph")
    return graph.pagerank(nodes.select("graph", "id", "p"), edges, "graph").withColumn("pagerank", F.round("pagerank", 6))


@query
def graph_terms(documents):
    """Terms ranked by the graph of their document, with the stub's vectors."""
    from . import extract

    out = extract.graph_terms(documents.select("doc_id", "text"), Stub(64), mark=".")
    return out.select("doc_id", "term", "frequency", F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))
