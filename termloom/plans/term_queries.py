"""Queries of the operators on texts, terms and their ranking, each with its DuckDB twin.

The tables are in Latin letters. Where an operator's rules are about kana and kanji, letters are exchanged for them one
by one, in Spark and in DuckDB alike, so that every rule acts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import JAPANESE, EngineConfig
from ..functions import fixed, text
from ..operators import around, candidates, chunkers, contexts, rank, stats
from . import extract
from .oracle import CNT, STRIP, TARGETS, TOK, TOKEN, WINDOWS, _pairs, places
from .registry import query, twin

#: Letters and what stands for them.
LETTERS, SIGNS = "abcdefghijklmnopqrstuvwxyz", "ア7燃漢た機弁ともガトー率のン性式めスこ料2BQX。"
SPELT = "[ァ-ヴー一-龥ぁ-ん0-9A-Z]+"
KANA = f"translate(lower(text), '{LETTERS}', '{SIGNS}')"


def kana(c: str = "text") -> Column:
    return F.translate(F.lower(c), LETTERS, SIGNS)


def _in_kana(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", kana().alias("text"))


def _listed(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_LETTERS_DIGITS = "(regexp_matches(t, '[A-Za-z]') AND regexp_matches(t, '[0-9]'))"
_FEATURES = f"({_LETTERS_DIGITS} OR regexp_matches(t, '[ア-ヴー]') OR regexp_matches(t, '({'|'.join(fixed.TECHNICAL_SUFFIXES)})$') OR regexp_full_match(t, '[一-龥]{{3,}}'))"
_VALID = f"(t NOT IN ({_listed(fixed.STOP_WORDS)}) AND len(list_filter([{_listed(fixed.STOP_WORDS)}], lambda x: length(t) > length(x) AND (starts_with(t, x) OR ends_with(t, x)))) = 0)"
_COMPOUND = f"(length(t) BETWEEN 3 AND 20 AND t NOT IN ({_listed(fixed.COMPOUND_COMMON)}) AND {_FEATURES})"
_TECHNICAL = f"({_LETTERS_DIGITS} OR (regexp_full_match(t, '[ア-ヴー・]+') AND length(t) >= 3) OR regexp_full_match(t, '[A-Z]{{2,}}'))"
_DOMAIN = "CASE " + " ".join(f"WHEN regexp_matches(t, '{'|'.join(w)}') THEN '{d}'" for d, w in fixed.DOMAIN_KEYWORDS.items()) + " ELSE 'general' END"
_DISTINCT = f"tm AS (SELECT DISTINCT unnest(regexp_extract_all({KANA}, '{SPELT}')) AS t FROM documents)"


def _distinct(documents: DataFrame) -> DataFrame:
    return documents.select(F.explode(F.regexp_extract_all(kana(), F.lit(SPELT), F.lit(0))).alias("term")).distinct()


@twin(f"""WITH {_DISTINCT} SELECT t AS term, regexp_matches(t, '[A-Za-z0-9]') AS has_alnum, len(regexp_extract_all(t, '[ァ-ヴー]')) >= 0.5 * length(t) AS katakana_heavy,
{_TECHNICAL} AS technical, {_FEATURES} AS features, {_COMPOUND} AS compound, length(t) BETWEEN 2 AND 30 AND NOT regexp_full_match(t, '[0-9]+') AND t NOT IN ({_listed(fixed.COMMON_WORDS)}) AS basic,
{_VALID} AS valid, {_DOMAIN} AS domain, CASE WHEN length(t) > 6 THEN substr(t, 1, 3) || '...' ELSE t END AS preview FROM tm""")
@query
def term_predicates(documents):
    """T13 to T19, T29, T30 on every distinct word in kana and kanji."""
    t = F.col("term")
    found = {"has_alnum": text.has_alnum(t), "katakana_heavy": text.katakana_heavy(t), "technical": text.technical_term(t), "features": text.technical_features(t), "compound": text.valid_compound(t), "basic": text.basic_filter(t), "valid": text.valid_term(t), "domain": text.domain_of(t), "preview": text.preview(t, 6)}
    return _distinct(documents).select("term", *[c.alias(n) for n, c in found.items()])


@twin(f"WITH {_DISTINCT} SELECT t AS term FROM tm WHERE length(nfc_normalize(t)) > 1 AND t NOT IN ({_listed(fixed.GENERIC_WORDS + fixed.LAYOUT_WORDS)})")
@query
def prefiltered_terms(documents):
    """No generic and no layout words."""
    return candidates.prefilter(_distinct(documents))


@twin(f"""WITH {_DISTINCT}, g AS (SELECT t, CASE WHEN length(t) <= 2 THEN 5000 WHEN length(t) >= 8 THEN 50 ELSE 500 END AS a, len(regexp_extract_all(t, '[ァ-ヴー]')) >= 0.5 * length(t) AS k, regexp_matches(t, '[A-Za-z0-9]') AS n FROM tm),
tb(t, n) AS (VALUES {', '.join(f"('{t}', {n})" for t, n in fixed.DOC_FREQ.items())}),
f AS (SELECT g.t, coalesce(tb.n, least(CASE WHEN k THEN least(a, 200) ELSE a END, CASE WHEN g.n THEN 100 ELSE 5000 END)) AS df FROM g LEFT JOIN tb ON g.t = tb.t),
i AS (SELECT t, ln(100001.0 / (df + 1)) AS idf FROM f)
SELECT t AS term, round_even(idf, 3) AS idf, round_even(least(1.0, idf / ln(100001)), 3) AS speciality, CASE WHEN idf / ln(100001) < 0.3 THEN '一般語' WHEN idf / ln(100001) < 0.6 THEN '準専門用語' ELSE '専門用語' END AS class FROM i""")
@query
def term_speciality(documents):
    """A13 to A15 with three digits."""
    return stats.rounded_idf(stats.general_idf(_distinct(documents))).select("term", "idf", "speciality", "class")


_REJOIN = f"replace({KANA}, ' ', chr(10))"
for _a, _b in (("[ァ-ヶー]+", "[ァ-ヶー]+"), ("[一-龥]+", "[ぁ-ん]+"), ("[A-Z0-9]+", "[A-Z0-9]+"), ("[ァ-ヶー]+", "[一-龥]+"), ("[一-龥]+", "[一-龥]+")):
    _REJOIN = f"regexp_replace({_REJOIN}, '({_a})' || chr(10) || '({_b})', '\\1\\2', 'g')"


@twin(rf"""SELECT doc_id, md5(trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g'), ' ')) AS normal, md5(translate(nfc_normalize({KANA}), '−～', '-~')) AS normal_term, md5({_REJOIN}) AS rejoined,
md5(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')) AS cache_key, contains(text, 'tion') AS holds, len(regexp_extract_all({KANA}, '[ァ-ヴー]+')) AS katakana_runs FROM documents""")
@query
def text_cleaning(documents):
    """T1 to T4, T9 and T28."""
    s = F.col("text")
    found = {"normal": F.md5(text.normalise(s)), "normal_term": F.md5(text.normalise_term(kana())), "rejoined": F.md5(text.rejoin_broken(F.replace(kana(), F.lit(" "), F.lit("\n")))), "cache_key": text.cache_key(s), "holds": F.contains(s, F.lit("tion")), "katakana_runs": F.size(candidates.katakana_runs(kana())).cast("long")}
    return documents.select("doc_id", *[c.alias(n) for n, c in found.items()])


_ALNUM = r"[A-Za-z][A-Za-z0-9\-]*[A-Za-z0-9]"


@twin(rf"""WITH k AS (SELECT doc_id, text AS latin, {KANA} AS s FROM documents),
p AS (SELECT doc_id, unnest(list_distinct(list_concat(list_concat(regexp_extract_all(s, '[ア-ヴー]{{3,}}'), regexp_extract_all(s, '[A-Z]{{2,}}(?:-[0-9]+)?')), regexp_extract_all(s, '[A-Za-z]+[ア-ヴー]+|[ア-ヴー]+[A-Za-z]+')))) AS term FROM k),
a AS (SELECT doc_id, unnest(regexp_extract_all(latin, '{_ALNUM}')) AS term FROM k)
SELECT doc_id, 'pattern' AS kind, term, count(*) AS n FROM p GROUP BY ALL UNION ALL SELECT doc_id, 'alnum', term, count(*) FROM a GROUP BY ALL""")
@query
def pattern_terms(documents):
    """Terms by their patterns, distinct in a document, and runs of letters and digits."""
    s = kana()
    one = documents.select("doc_id", F.lit("pattern").alias("kind"), F.explode(candidates.pattern_candidates(s)).alias("term"))
    two = documents.select("doc_id", F.lit("alnum").alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(_ALNUM), F.lit(0))).alias("term"))
    return one.unionAll(two).groupBy("doc_id", "kind", "term").agg(F.count(F.lit(1)).alias("n"))


@twin(rf"""WITH {CNT}, {TARGETS}, sn AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]+'), lambda x: trim(x, ' ')), lambda x: length(x) > 10 AND length(x) < 200) AS s FROM documents),
f AS (SELECT tg.doc_id, tg.term, list_slice(list_filter(s, lambda x: contains(x, tg.term)), 1, 3) AS s FROM tg JOIN sn USING (doc_id))
SELECT doc_id, term, CAST(len(s) AS INTEGER) AS n, md5(array_to_string(s, '|')) AS sentences_md5,
md5(coalesce(list_sort(list_transform(s, lambda x, i: {{'n': length(x), 'i': i, 'x': x}}))[1]['x'], term || 'について')) AS shortest_md5,
md5(array_to_string(list_transform(list_slice(s, 1, 2), lambda x: replace(x, term, '[MASK]')), '|')) AS masked_md5 FROM f""")
@query
def term_sentences(documents):
    """The first sentences that hold a term, the shortest of them, and the first two masked."""
    sentences = text.sentences_of(F.col("text"), ".!?\n")
    listed = documents.join(_targets(documents).groupBy("doc_id").agg(F.collect_list("term").alias("terms")), "doc_id").select("doc_id", sentences.alias("all"), "terms")
    each = F.transform("terms", lambda t: F.struct(t.alias("term"), F.slice(F.filter("all", lambda x: F.contains(x, t)), 1, 3).alias("s")))
    rows = listed.select("doc_id", F.inline(each))
    masked = contexts.masked_sentences(F.col("s"), F.col("term"))
    return rows.select("doc_id", "term", F.size("s").alias("n"), F.md5(F.array_join("s", "|")).alias("sentences_md5"), F.md5(text.shortest_sentence(F.col("s"), F.col("term"))).alias("shortest_md5"), F.md5(F.array_join(masked, "|")).alias("masked_md5"))


def _targets(documents: DataFrame) -> DataFrame:
    return candidates.term_counts(documents).where("frequency >= 2").select("doc_id", "term")


#: Tokens of a mode with their tags, in SQL.
def _tagged(mode: str, name: str) -> str:
    suffixes = _listed(fixed.JOINING_SUFFIXES)
    kinds = f"CASE WHEN regexp_full_match(term, '[0-9]+') THEN 'number' WHEN regexp_full_match(term, '[ぁ-ん]{{1,2}}') THEN 'particle' WHEN term IN ({suffixes}) THEN 'suffix' WHEN regexp_full_match(term, '[ぁ-ん]+') THEN 'other' ELSE 'noun' END"
    return f"{name} AS (SELECT *, {kinds} AS tag FROM (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all({KANA}, '{candidates.MODES[mode]}') AS w FROM documents)))"


_RUNS = f"""{_tagged('A', 'ta')}, nn AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM ta WHERE tag IN ('noun', 'suffix') AND term NOT IN ({_listed(fixed.STOP_WORDS)})),
ru AS (SELECT doc_id, g, list(term ORDER BY pos) AS w FROM nn GROUP BY doc_id, g)"""


@twin(f"WITH {_tagged('A', 'ta')}, {_tagged('B', 'tb')}, {_tagged('C', 'tc')} SELECT mode, tag, term, count(*) AS n FROM (SELECT 'A' AS mode, * FROM ta UNION ALL SELECT 'B', * FROM tb UNION ALL SELECT 'C', * FROM tc) GROUP BY ALL")
@query
def tagged_tokens(documents):
    """Tokens of the three modes and their tags."""
    out = None
    for mode in candidates.MODES:
        found = candidates.tagged(_in_kana(documents), mode, JAPANESE).select(F.lit(mode).alias("mode"), "tag", "term")
        out = found if out is None else out.unionAll(found)
    return out.groupBy("mode", "tag", "term").agg(F.count(F.lit(1)).alias("n"))


@twin(f"""WITH {_RUNS}, {_tagged('B', 'tb')}, {_tagged('C', 'tc')},
s AS (SELECT DISTINCT doc_id, term FROM ta WHERE tag = 'noun' AND length(term) >= 2 AND term NOT IN ({_listed(fixed.FUNCTION_WORDS)})),
m AS (SELECT doc_id, term, count(DISTINCT mode) AS n FROM (SELECT 'A' AS mode, * FROM ta UNION ALL SELECT 'B', * FROM tb UNION ALL SELECT 'C', * FROM tc) WHERE (tag IN ('noun', 'number') AND length(term) >= 2) OR {_TECHNICAL.replace('(t,', '(term,').replace('length(t)', 'length(term)')} GROUP BY doc_id, term),
q AS (SELECT DISTINCT doc_id, t FROM (SELECT doc_id, array_to_string(w, '') AS t FROM ru WHERE len(w) BETWEEN 2 AND 4) WHERE {_COMPOUND})
SELECT doc_id, 'single' AS kind, term, CAST(1 AS BIGINT) AS n FROM s UNION ALL SELECT doc_id, 'modes', term, n FROM m UNION ALL SELECT doc_id, 'sequence', t, 1 FROM q""")
@query
def noun_candidates(documents):
    """Single nouns, nouns of all modes, and sequences of nouns."""
    return candidates.document_nouns(_in_kana(documents), JAPANESE)


_LEADS = "SELECT doc_id, term, tag, lead(term) OVER o AS t2, lead(tag) OVER o AS g2, lead(term, 2) OVER o AS t3, lead(tag, 2) OVER o AS g3 FROM ta WINDOW o AS (PARTITION BY doc_id ORDER BY pos)"


@twin(f"""WITH {_tagged('A', 'ta')}, ld AS ({_LEADS}), c AS (
SELECT doc_id, term || t2 AS t FROM ld WHERE tag = 'noun' AND g2 = 'noun' UNION SELECT doc_id, term || t2 || t3 FROM ld WHERE tag = 'noun' AND g2 = 'noun' AND g3 = 'noun'
UNION SELECT doc_id, term || t2 FROM ld WHERE tag = 'noun' AND g2 = 'suffix' UNION SELECT doc_id, term || t3 FROM ld WHERE tag = 'noun' AND g2 = 'particle' AND g3 = 'noun')
SELECT doc_id, t AS term FROM c WHERE {_COMPOUND}""")
@query
def pattern_compounds(documents):
    """C11: compounds by patterns of tags, particles left out."""
    return candidates.document_patterns(_in_kana(documents), [("noun", "noun"), ("noun", "noun", "noun"), ("noun", "suffix"), ("noun", "particle", "noun")], "particle", "A", JAPANESE)


@twin(f"""WITH {_tagged('A', 'ta')}, nn AS (SELECT *, lag(pos) OVER o AS p, lag(term) OVER o AS q FROM ta WHERE tag <> 'particle' WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
j AS (SELECT *, p IS NULL OR pos - p <> 1 OR NOT (NOT (regexp_full_match(q, '[0-9]+') OR regexp_full_match(term, '[0-9]+')) AND (NOT (length(q) = 1 OR length(term) = 1) OR (term IN ({_listed(fixed.JOINING_SUFFIXES)}) AND length(q) >= 2))) AS fresh FROM nn),
g AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM j)
SELECT doc_id, t AS term, count(*) AS n FROM (SELECT doc_id, run, string_agg(term, '' ORDER BY pos) AS t FROM g GROUP BY doc_id, run) GROUP BY ALL""")
@query
def joined_nouns(documents):
    """Runs of tokens that may join."""
    return candidates.joined_runs(_in_kana(documents), "particle", "A", JAPANESE)


_PARTS = _listed(fixed.MEANINGFUL_PARTS)
_ENDS = f"[{_listed(fixed.MEANINGFUL_PARTS[:4])}]"


@twin(f"""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all({KANA}, '{SPELT}')) AS w FROM documents),
k AS (SELECT DISTINCT doc_id, unnest([w, w || {_ENDS}[1 + length(w) % 4], {_ENDS}[1 + length(w) % 4], substr(w, 1, 2) || {_ENDS}[1 + length(w) % 4]]) AS term FROM w), c AS (SELECT doc_id, term, 1 AS frequency FROM k),
p AS ({_pairs('c', 3)}), lost AS (SELECT DISTINCT doc_id, term FROM p WHERE NOT (NOT (ends_with(container, term) AND length(term) < 0.6 * length(container)) AND NOT (starts_with(container, term) AND length(term) < 0.6 * length(container)) AND (ends_with(container, term) OR starts_with(container, term)) AND term IN ({_PARTS})))
SELECT doc_id, term FROM c ANTI JOIN lost USING (doc_id, term) WHERE length(term) >= 3""")
@query
def meaningful_parts(documents):
    """Terms that are no part of a longer one, or a part with a meaning of its own."""
    found = F.array_distinct(F.regexp_extract_all(kana(), F.lit(SPELT), F.lit(0)))
    end = lambda w: F.get(F.array(*map(F.lit, fixed.MEANINGFUL_PARTS[:4])), F.length(w) % 4)
    terms = F.flatten(F.transform(found, lambda w: F.array(w, F.concat(w, end(w)), end(w), F.concat(F.substring(w, 1, 2), end(w)))))
    return candidates.meaningful_terms(documents, terms)


_GRAMS_OF_RUNS = "SELECT doc_id, array_to_string(list_slice(w, i, i + n - 1), '') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT doc_id, w, unnest(range({0}, least(len(w), {1}) + 1)) AS n FROM ru))"


@twin(rf"""WITH {_RUNS}, g AS ({_GRAMS_OF_RUNS.format(1, 10)}),
c AS (SELECT doc_id, t, count(*) AS n FROM g WHERE length(t) BETWEEN 2 AND 20 AND {_VALID} GROUP BY ALL),
k AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({KANA}, '[ァ-ヴー]+')) AS t FROM documents) WHERE {_VALID} GROUP BY ALL),
a AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({KANA}, '{_ALNUM}')) AS t FROM documents) GROUP BY ALL)
SELECT doc_id, t AS term, CAST(sum(n) AS BIGINT) AS frequency FROM (SELECT * FROM c UNION ALL SELECT * FROM k UNION ALL SELECT * FROM a) WHERE length(t) > 1 GROUP BY ALL""")
@query
def statistical_candidates(documents):
    """Every n-gram of a run of nouns, katakana, words of letters and digits, in one count."""
    return candidates.statistical_candidates(_in_kana(documents), JAPANESE)


@twin(f"""WITH {_RUNS}, c AS (SELECT doc_id, term AS t FROM ta WHERE tag = 'noun' AND length(term) >= 2 UNION {_GRAMS_OF_RUNS.format(2, 4)})
SELECT doc_id, t AS term, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(t) DESC, t) AS rank FROM c) WHERE rank <= 100""")
@query
def position_ngrams(documents):
    """Nouns and n-grams of two to four nouns in a row, the hundred longest."""
    docs = _in_kana(documents)
    found = candidates.position_ngrams(candidates.tagged(docs, "A", JAPANESE), run_table=candidates.document_noun_runs(docs, "A", JAPANESE))
    return found.select("doc_id", "term", F.col("rank").cast("long").alias("rank"))


@twin(f"WITH {CNT}, tm AS (SELECT doc_id, term FROM cnt WHERE frequency >= 2), g AS (SELECT doc_id, term FROM tok UNION ALL SELECT doc_id, term || ' ' || nx FROM (SELECT *, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS nx FROM tok) WHERE nx IS NOT NULL), c AS (SELECT doc_id, term, count(*) AS n FROM g GROUP BY ALL) SELECT doc_id, term, CAST(greatest(1, coalesce(n, 0)) AS BIGINT) AS frequency FROM tm LEFT JOIN c USING (doc_id, term)")
@query
def boundary_counts(documents):
    """Token windows that spell a term, without one more for a single token."""
    return candidates.boundary_frequency(candidates.tokens(documents), _targets(documents), 2, False, " ")


@twin(f"WITH {TOK}, t AS (SELECT DISTINCT coalesce(lang, 'en') = 'en' AS en, term FROM tok JOIN documents USING (doc_id)) SELECT a.term FROM t a ANTI JOIN (SELECT term FROM t WHERE NOT en) b ON a.term = b.term WHERE a.en")
@query
def terms_of_one_side(documents):
    """The terms that English documents hold and the others don't."""
    terms = candidates.tokens(documents).join(documents.select("doc_id", F.coalesce("lang", F.lit("en")).alias("lang")), "doc_id")
    return candidates.difference(terms.where("lang = 'en'").select("term").distinct(), terms.where("lang <> 'en'"), "term")


@twin(f"""WITH {CNT}, {TARGETS}, {WINDOWS}, c AS (SELECT x.doc_id, x.chunk_id, t.term, CAST((length(x.chunk) - length(replace(x.chunk, t.term, ''))) / length(t.term) AS BIGINT) AS tf FROM winx x JOIN tg t ON x.doc_id = t.doc_id AND contains(x.chunk, t.term)),
n AS (SELECT doc_id, count(*) AS n FROM winx GROUP BY ALL) SELECT doc_id, term, round((1 + ln(max(tf))) * (ln((any_value(n) + 1) / (count(*) + 1)) + 1), 6) AS tfidf FROM c JOIN n USING (doc_id) GROUP BY doc_id, term""")
@query
def substring_tfidf(documents):
    """TF-IDF of terms counted as substrings of word windows."""
    windows = chunkers.word_windows(documents)
    counts = stats.substring_counts(windows, _targets(documents))
    found = stats.chunk_tfidf(counts, windows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks")))
    return found.select("doc_id", "term", F.round("tfidf", 6).alias("tfidf"))


_AROUND = "substr(text, greatest(st - 30, 1), least(st - 1, 30)) || substr(text, st + length(term), 30)"


@twin(f"""WITH {CNT}, {TARGETS}, {places('tg')}, w AS (SELECT doc_id, term, regexp_extract_all({_AROUND}, '{stats.CONTEXT_RUNS}') AS w FROM pl)
SELECT DISTINCT doc_id, term, unnest(list_concat(list_slice(w, 1, 3), list_slice(w, greatest(len(w) - 2, 1), len(w)))) AS word FROM w""")
@query
def context_words(documents):
    """The words around a term's occurrences."""
    return around.context_words(documents, EngineConfig().min_frequency)


def _sep(c: str, window: int) -> str:
    """What is behind the first kind of mark that is early in a context."""
    cases = " ".join(f"WHEN instr({c}, {m}) - 1 BETWEEN 1 AND {window - 1} THEN substr({c}, instr({c}, {m}) + 1)" for m in ("'.'", "'!'", "chr(10)"))
    return f"CASE {cases} ELSE {c} END"


def _tail(mark: str, window: int) -> str:
    at = f"(length(h) - instr(reverse(h), {mark}))"
    return f" WHEN {at} > length(h) - {window} AND {at} < length(h) - 1 THEN substr(h, 1, {at} + 1)"


@twin(f"""WITH {CNT}, {TARGETS}, {places('tg')}, c AS (SELECT doc_id, term, k, substr(text, greatest(st - 100, 1), least(st - 1 + length(term) + 100, length(text)) - greatest(st - 100, 1) + 1) AS x FROM pl WHERE k <= 3),
h AS (SELECT doc_id, term, k, {_sep('x', 100)} AS h FROM c), e AS (SELECT *, CASE {_tail("'.'", 100)} {_tail("'!'", 100)} {_tail('chr(10)', 100)} ELSE h END AS e FROM h)
SELECT doc_id, term, CAST(k - 1 AS INTEGER) AS ord, md5({STRIP.format('e')}) AS context_md5 FROM e""")
@query
def kwic_sentences(documents):
    """Contexts trimmed to sentences."""
    listed = documents.join(_targets(documents).groupBy("doc_id").agg(F.collect_list("term").alias("terms")), "doc_id").select("doc_id", "text", "terms")
    found = contexts.occurrences(listed, 100, 3)
    return found.select("doc_id", "term", "ord", F.md5(contexts.kwic_sentence(100, (".", "!", "\n"))).alias("context_md5"))


@twin(f"""WITH t AS (SELECT conv_id, turn, text, unnest(list_distinct(regexp_extract_all(text, '{TOKEN}'))) AS term FROM conversations),
ps AS (SELECT conv_id, turn, text, term, string_split(lower(text), lower(term)) AS p FROM t), pu AS (SELECT conv_id, turn, text, term, unnest(p) AS part, generate_subscripts(p, 1) AS k, len(p) AS np FROM ps),
pc AS (SELECT *, CAST(1 + sum(length(part)) OVER (PARTITION BY conv_id, turn, term ORDER BY k) + (k - 1) * length(term) AS BIGINT) AS st FROM pu),
c0 AS (SELECT conv_id, turn, term, k, substr(text, greatest(st - 150, 1), least(st - 1, 150) + length(term) + 150) AS x FROM pc WHERE k < np AND k <= 5),
h AS (SELECT conv_id, turn, term, k, {_sep('x', 75)} AS h FROM c0), c AS (SELECT conv_id, turn, term, k, {STRIP.format('CASE ' + _tail("'.'", 75) + _tail("'!'", 75) + _tail('chr(10)', 75) + ' ELSE h END')} AS x FROM h)
SELECT conv_id, turn, term, count(DISTINCT x) AS n, md5(arg_min(x, k)) AS first_md5 FROM c GROUP BY ALL""")
def kwic_turns() -> None:
    """Only the twin: the query stands with the first ones."""


@twin(f"""WITH b AS (SELECT item_id, text, regexp_extract_all(text, '{TOKEN}') AS w FROM benchmark), t AS (SELECT DISTINCT item_id, text, unnest(list_concat(w, ['zzz'])) AS term FROM b),
o AS (SELECT item_id, term, text, unnest(list_filter(range(1, length(text) - length(term) + 2), lambda i: substr(text, i, length(term)) = term)) AS st FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id, term ORDER BY st) AS k FROM o),
c AS (SELECT item_id, term, list(substr(text, greatest(st - 50, 1), least(st - 1, 50) + length(term) + 50) ORDER BY k) FILTER (WHERE k <= 3) AS x, list(substr(text, greatest(st - 50, 1), least(st - 1, 50)) ORDER BY k) FILTER (WHERE k <= 3) AS l FROM r GROUP BY ALL),
a AS (SELECT t.item_id, t.term, coalesce(x, []) AS x, coalesce(l, []) AS l FROM t LEFT JOIN c USING (item_id, term))
SELECT item_id, term, md5(array_to_string(list_slice(CASE WHEN len(x) < 1 THEN list_concat(x, ['この' || term || 'は重要な専門用語です。']) ELSE x END, 1, 3), '|')) AS contexts_md5,
md5(array_to_string(list_slice(CASE WHEN len(l) < 2 THEN list_concat(l, ['この' || term || 'は', '重要な' || term]) ELSE l END, 1, 3), '|')) AS prefixes_md5 FROM a""")
@query
def made_contexts(benchmark):
    """Contexts and prefixes of terms, overlapping places included, made ones where there are too few."""
    w = F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))
    rows = benchmark.select("item_id", "text", F.array_distinct(F.concat(w, F.array(F.lit("zzz")))).alias("terms"))
    found = contexts.occurrences(rows, 50, 3, overlapping=True, keys=("item_id",))
    item = F.struct("ord", contexts.plain_context().alias("x"), F.col("left").alias("l"))
    lists = found.groupBy("item_id", "term").agg(F.array_sort(F.collect_list(item)).alias("c"))
    every = rows.select("item_id", F.explode("terms").alias("term")).join(lists, ["item_id", "term"], "left")
    of = lambda f: F.transform("c", lambda x: x[f])
    full = contexts.or_made(of("x"), F.col("term"), 1, 3, (fixed.MADE_CONTEXT,))
    before = contexts.or_made(of("l"), F.col("term"), 2, 3, fixed.MADE_OPENINGS)
    return every.select("item_id", "term", F.md5(F.array_join(full, "|")).alias("contexts_md5"), F.md5(F.array_join(before, "|")).alias("prefixes_md5"))


@twin(f"""WITH {CNT}, p AS (SELECT doc_id, term, frequency, CAST(('0x' || substr(md5(term), 1, 4)) AS BIGINT) / 655.36 AS p FROM cnt)
SELECT doc_id, term, CASE WHEN p < 30 THEN 'high_confidence' WHEN p < 70 THEN 'medium_confidence' ELSE 'low_confidence' END AS steps, CASE WHEN p < 20 THEN 'high' WHEN p < 50 THEN 'medium' ELSE 'low' END AS short_steps, CASE WHEN p / 100 > 0.7 THEN 'green' WHEN p / 100 > 0.4 THEN 'yellow' ELSE 'red' END AS colour FROM p""")
@query
def confidence_labels(documents):
    """Classes by their bounds, long and short, and colours."""
    p = F.conv(F.substring(F.md5("term"), 1, 4), 16, 10).cast("double") / 655.36
    rows = candidates.term_counts(documents).withColumn("p", p)
    return rows.select("doc_id", "term", rank.by_steps(F.col("p"), 30.0, 70.0).alias("steps"), rank.short_steps(F.col("p")).alias("short_steps"), rank.colour(F.col("p") / 100).alias("colour"))


@twin(f"""WITH {TOK}, l AS (SELECT doc_id, lower(term) AS term, pos FROM tok), f AS (SELECT doc_id, term, min(pos) AS pos FROM l GROUP BY ALL)
SELECT doc_id, term FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM f) WHERE k <= 20""")
@query
def first_words(documents):
    """A document's first twenty different words."""
    rows = candidates.tokens(documents).select("doc_id", "pos", F.lower("term").alias("term"))
    return rank.first_of_equals(rows, "term", "pos", 20, "doc_id").select("doc_id", "term")


@query
def compound_terms(documents):
    """Entry A whole, on compound candidates. Its order-dependent penalty has no twin: it is tested against plain Python."""
    return extract.compound_terms(documents).withColumn("rank", F.col("rank").cast("long"))


@query
def generic_terms(documents):
    """C14: the generic extractor's best terms."""
    return extract.generic_terms(documents).withColumn("rank", F.col("rank").cast("long"))


def _cut_at(at: str) -> str:
    """Where a window of 2,000 characters from ``at`` ends: behind the last mark in its second half."""
    half = f"substr(text, {at} + 1001, 1000)"
    behind = "".join(f" WHEN contains({half}, {m}) THEN {at} + 1000 + length({half}) - instr(reverse({half}), reverse({m})) + 1" for m in ("'. '", "chr(10)", "'!'", "'?'", "'.'"))
    return f"CASE WHEN {at} + 2000 >= length(text) THEN length(text){behind} ELSE {at} + 2000 END"


@twin(f"""WITH RECURSIVE r AS (SELECT doc_id, 0 AS n, CAST(0 AS BIGINT) AS start, CAST({_cut_at('0')} AS BIGINT) AS e FROM documents WHERE length(text) > 0
UNION ALL SELECT doc_id, n + 1, e - 200, CAST({_cut_at('(e - 200)')} AS BIGINT) FROM r JOIN documents USING (doc_id) WHERE e < length(text))
SELECT doc_id, CAST(n AS INTEGER) AS chunk_id, md5(substr(text, start + 1, e - start)) AS chunk_md5, e - start AS n_chars FROM r JOIN documents USING (doc_id)""")
def cursor_chunks() -> None:
    """Only the twin: the query stands with the first ones."""


@query
def paragraph_chunks(documents):
    """H3: paragraphs or packed sentences; tested against a version of its own."""
    found = chunkers.chunked(documents, lambda s: chunkers.paragraphs(s, 500, "."))
    return found.select("doc_id", "chunk_id", F.md5("chunk").alias("chunk_md5"))


@query
def byte_chunks(documents):
    """H4: sentences packed by bytes."""
    found = chunkers.chunked(documents, lambda s: chunkers.pack_bytes(s, 2000, "."))
    return found.select("doc_id", "chunk_id", F.octet_length("chunk").cast("long").alias("n_bytes"))


@query
def separator_chunks(documents):
    """H7 without separators."""
    cut = lambda s: chunkers.recursive(s, 2000, 200, ("\n\n", "\n", ".", ",", " ", ""), keep_separator=False)
    return chunkers.chunked(documents, cut).select("doc_id", "chunk_id", F.md5("chunk").alias("chunk_md5"))

