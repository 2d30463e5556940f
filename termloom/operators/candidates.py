"""Candidate terms: tokens, runs of tokens, compounds, and their counts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LATIN, LanguageProfile
from ..functions import fixed, text
from .groups import fields, inside, per_key


def tokens(docs: DataFrame, profile: LanguageProfile = LATIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, term): tokens in order. A tokenizer adapter may stand in for this: any such table will do."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(profile.token), F.lit(0))
    return docs.select(F.col(id_col), F.posexplode(found).alias("pos", "term"))


#: What one token is: runs of one script (A), runs of scripts that make up words (B), whole words with hyphens (C).
MODES = {
    "A": "[ァ-ヴー]+|[一-龥]+|[ぁ-ん]+|[0-9]+|[A-Za-zÀ-ɏ]+",
    "B": "[ァ-ヴー一-龥]+|[ぁ-ん]+|[0-9A-Za-zÀ-ɏ]+",
    "C": r"[ァ-ヴー一-龥0-9A-Za-zÀ-ɏ][ァ-ヴー一-龥0-9A-Za-zÀ-ɏ\-]*|[ぁ-ん]+",
}


def tag(term: Column, profile: LanguageProfile = LATIN) -> Column:
    """A token's kind by its looks: number, particle, suffix, other or noun. A tagger's column may stand in for this."""
    listed = F.lower(term).isin(*profile.stop_words) if profile.stop_words else F.lit(False)
    kinds = F.when(term.rlike("^[0-9]+$"), "number").when(listed | term.rlike("^[ぁ-ん]{1,2}$"), "particle")
    return kinds.when(term.isin(*fixed.JOINING_SUFFIXES), "suffix").when(term.rlike("^[ぁ-ん]+$"), "other").otherwise("noun")


def tagged(docs: DataFrame, mode: str = "A", profile: LanguageProfile = LATIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, term, tag): tokens of a mode in order."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(MODES[mode]), F.lit(0))
    return docs.select(F.col(id_col), F.posexplode(found).alias("pos", "term")).withColumn("tag", tag(F.col("term"), profile))


def single_nouns(tokens_: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, term): distinct nouns of two or more characters that are no digits and no function words."""
    kept = tokens_.where((F.col("tag") == "noun") & (F.length("term") >= 2) & ~F.col("term").isin(*fixed.FUNCTION_WORDS))
    return kept.select(id_col, "term").distinct()


def multi_mode_nouns(docs: DataFrame, profile: LanguageProfile = LATIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, modes): nouns and numbers of two or more characters, and technical terms, in how many modes."""
    term = F.col("term")
    out = None
    for mode in MODES:
        found = tagged(docs, mode, profile, id_col, text_col)
        kept = found.where((F.col("tag").isin("noun", "number") & (F.length(term) >= 2)) | text.technical_term(term)).select(id_col, "term", F.lit(mode).alias("mode"))
        out = kept if out is None else out.unionAll(kept)
    return out.groupBy(id_col, "term").agg(F.count_distinct("mode").alias("modes"))


def noun_runs(tokens_: DataFrame, profile: LanguageProfile = LATIN, id_col: str = "doc_id") -> DataFrame:
    """(id, run, words): runs of nouns; stop words and numbers end one."""
    return runs(tokens_, F.col("tag").isin("noun", "suffix") & ~F.col("term").isin(*fixed.STOP_WORDS), id_col)


def noun_sequences(run_table: DataFrame, joiner: str = "", sizes: tuple[int, int] = (2, 4), id_col: str = "doc_id") -> DataFrame:
    """(id, term): whole runs of two to four nouns that make a valid compound."""
    kept = run_table.where(F.size("words").between(*sizes)).select(id_col, F.array_join("words", joiner).alias("term"))
    return kept.where(text.valid_compound(F.col("term"))).distinct()


def position_ngrams(tokens_: DataFrame, joiner: str = "", most: int = 100, id_col: str = "doc_id", run_table: DataFrame | None = None) -> DataFrame:
    """(id, term, rank): nouns of two or more characters and n-grams of two to four nouns in a row, longest first. The runs of
    nouns may be given."""
    nouns = tokens_.where(F.col("tag") == "noun")
    grams = (noun_runs(tokens_, id_col=id_col) if run_table is None else run_table).select(id_col, F.explode(ngrams(F.col("words"), 2, 4, joiner)).alias("term"))
    return longest_first(nouns.where(F.length("term") >= 2).select(id_col, "term").unionAll(grams).distinct(), most, id_col)


def statistical_candidates(docs: DataFrame, profile: LanguageProfile = LATIN, longest: int = 10, id_col: str = "doc_id", text_col: str = "text", measured: Callable[[list[str], list[str]], dict[str, pa.Array]] | None = None, more: str = "") -> DataFrame:
    """(id, term, frequency) from three sources in one count: every n-gram of a run of nouns, runs of katakana, words of
    letters and digits; none of one character. ``measured`` makes the columns ``more`` of a document's terms and texts, which
    come with the containers that :func:`with_containers` adds; a document's text is dealt out once."""
    tokens_, in_run = _noun_tokens(profile, text_col)
    none, s = F.array().cast("array<string>"), F.col(text_col)
    alnum = F.regexp_extract_all(s, F.lit(r"[A-Za-z][A-Za-z0-9\-]*[A-Za-z0-9]"), F.lit(0))
    made = [F.coalesce(c, none).alias(n) for n, c in (("__t", tokens_), ("__k", katakana_runs(s)), ("__a", alnum))]
    made += [F.coalesce(in_run(tokens_), F.array().cast("array<boolean>")).alias("__in"), *([s.alias("__s")] if measured else [])]
    joiner, chars = profile.joiner, 2 * longest
    stop = tuple(fixed.STOP_WORDS)

    def work(table: pa.Table) -> pa.Table:
        grams, kata, alnum = Counter(), Counter(), Counter()
        for own, inside_ in zip(table.column("__t").to_pylist(), table.column("__in").to_pylist()):
            for words in _cut_runs(own, inside_):
                grams.update(_bounded(words, joiner, longest, chars))
        for counts, name in ((kata, "__k"), (alnum, "__a")):
            for own in table.column(name).to_pylist():
                counts.update(own)
        for t, n in (grams + kata).items():
            if not t.startswith(stop) and not t.endswith(stop):  # as text.valid_term
                alnum[t] += n
        terms = [t for t in alnum if len(t) > 1]
        frequency = [alnum[t] for t in terms]
        columns: dict[str, pa.Array] = {"frequency": pa.array(frequency, pa.int64())}
        if measured:
            columns["__mean"], columns["__most"] = _containers(terms, frequency, 2)
            columns |= measured(terms, table.column("__s").drop_null().to_pylist())
        return _one_column(table, id_col, terms, **columns)

    added = f", __mean double, __most long, {more}" if measured else ""
    return per_key(docs.select(id_col, text_col), id_col, work, f"`{id_col}` {dict(docs.dtypes)[id_col]}, term string, frequency long{added}", made, spread=True)


def _noun_tokens(profile: LanguageProfile, text_col: str, mode: str = "A") -> tuple[Column, Callable[[Column], Column]]:
    """The tokens of a text as an array, and which of such an array's belong to runs of nouns."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(MODES[mode]), F.lit(0))
    return found, lambda ts: F.transform(ts, lambda x: tag(x, profile).isin("noun", "suffix") & ~x.isin(*fixed.STOP_WORDS))


def _cut_runs(tokens_: list[str], in_run: list[bool]) -> Iterator[list[str]]:
    own: list[str] = []
    for t, kept in zip(tokens_, in_run):
        if kept:
            own.append(t)
        elif own:
            yield own
            own = []
    if own:
        yield own


def _bounded(words: list[str], joiner: str, longest: int, chars: int) -> Iterator[str]:
    """The n-grams of a run of 2 to ``chars`` characters."""
    for at in range(len(words)):
        gram = words[at]
        for end in range(at + 1, min(at + longest, len(words)) + 1):
            if len(gram) > chars:
                break
            if len(gram) >= 2:
                yield gram
            if end < len(words):
                gram += joiner + words[end]


def document_noun_runs(docs: DataFrame, mode: str = "A", profile: LanguageProfile = LATIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, run, words) as :func:`noun_runs` of :func:`tagged` texts, cut where each text is; ``docs`` has each document once."""
    tokens_, in_run = _noun_tokens(profile, text_col, mode)
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col), tokens_.alias("__t")).withColumn("__in", in_run(F.col("__t")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                row, run, words = [], [], []
                for i, (own, inside_) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    for n, w in enumerate(_cut_runs(own, inside_), 1):
                        row.append(i)
                        run.append(n)
                        words.append(w)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array(run, pa.int64()), pa.array(words, pa.list_(pa.string()))], names=[id_col, "run", "words"])

    return rows.mapInArrow(work, f"`{id_col}` {dict(rows.dtypes)[id_col]}, run long, words array<string>")


def term_counts(docs: DataFrame, profile: LanguageProfile = LATIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, frequency) of all tokens."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(profile.token), F.lit(0))
    return docs.select(F.col(id_col), F.explode(found).alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("frequency"))


def document_terms(docs: DataFrame, profile: LanguageProfile = LATIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, frequency, words, squares, __mean, __most) of all tokens: :func:`term_counts` with how often a term is a
    lower-cased run of word characters, the sum of these counts' squares over the document's terms, and what
    :func:`with_containers` adds.

    A document's text is dealt out once; its tokens are counted and compared in one task.
    """
    found = F.regexp_extract_all(F.col(text_col), F.lit(profile.token), F.lit(0))
    lower = F.regexp_extract_all(F.lower(text_col), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    made = [F.coalesce(c, F.array().cast("array<string>")).alias(n) for n, c in (("__t", found), ("__w", lower))]

    def work(table: pa.Table) -> pa.Table:
        counts = Counter(x for own in table.column("__t").to_pylist() for x in own)
        spelt = Counter(x for own in table.column("__w").to_pylist() for x in own)
        terms, frequency = list(counts), list(counts.values())
        words = [spelt[t] for t in terms]
        mean, most = _containers(terms, frequency, 2)
        columns = {"term": pa.array(terms, pa.string()), "frequency": pa.array(frequency, pa.int64()), "words": pa.array(words, pa.int64()), "squares": pa.array([sum(n * n for n in words)] * len(terms), pa.int64()), "__mean": mean, "__most": most}
        return pa.table({id_col: table.column(id_col).take(pa.array([0] * len(terms), pa.int64())), **columns})

    return per_key(docs.select(id_col, text_col), id_col, work, f"`{id_col}` {dict(docs.dtypes)[id_col]}, term string, frequency long, words long, squares long, __mean double, __most long", made, spread=True)


def katakana_runs(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("[ァ-ヴー]+"), F.lit(0))


def pattern_candidates(s: Column) -> Column:
    """Katakana, abbreviations and mixed words of a text, distinct."""
    mixed = F.regexp_extract_all(s, F.lit("[A-Za-z]+[ア-ヴー]+|[ア-ヴー]+[A-Za-z]+"), F.lit(0))
    kata = F.regexp_extract_all(s, F.lit("[ア-ヴー]{3,}"), F.lit(0))
    return F.array_union(F.array_union(kata, F.regexp_extract_all(s, F.lit(r"[A-Z]{2,}(?:-\d+)?"), F.lit(0))), mixed)


def runs(tagged: DataFrame, in_run: Column, id_col: str = "doc_id", new_run: Column | None = None) -> DataFrame:
    """(id, run, words): maximal runs of consecutive positions where ``in_run`` holds; ``new_run`` also starts one."""
    w = Window.partitionBy(id_col).orderBy("pos")
    kept = tagged.withColumn("__new", F.coalesce(new_run, F.lit(False)) if new_run is not None else F.lit(False)).where(in_run)
    starts = (F.col("pos") - F.lag("pos", 1, -2).over(w) != 1) | F.col("__new")
    kept = kept.withColumn("run", F.sum(starts.cast("int")).over(w))
    return kept.groupBy(id_col, "run").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("words"))


def ngrams(words: Column, shortest: int, longest: int, joiner: str = "", prefixes_only: bool = False) -> Column:
    """All joined n-grams of a run, or only those at its start."""
    size = F.size(words)
    top = F.least(size, F.lit(longest))
    lengths = F.when(top >= shortest, F.sequence(F.lit(shortest), top)).otherwise(F.array().cast("array<int>"))
    if prefixes_only:
        return F.transform(lengths, lambda n: F.array_join(F.slice(words, 1, n), joiner))
    return F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(words, i, n), joiner))))


def compounds(run_table: DataFrame, profile: LanguageProfile = LATIN, shortest: int = 1, longest: int = 10, chars: tuple[int, int] = (2, 20), prefixes_only: bool = False, id_col: str = "doc_id", stop: tuple[str, ...] = fixed.STOP_WORDS) -> DataFrame:
    """(id, term, frequency) of the n-grams of runs within the bounds on characters that are valid terms."""
    # n-grams beyond the characters aren't built: each of their words and joiners takes one at least
    longest = min(longest, (chars[1] + len(profile.joiner)) // (1 + len(profile.joiner)))
    grams = run_table.select(id_col, F.explode(ngrams(F.col("words"), shortest, longest, profile.joiner, prefixes_only)).alias("term"))
    grams = grams.where(F.length("term").between(*chars) & text.valid_term(F.col("term"), stop))
    return grams.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("frequency"))


def may_join(prev: Column, cur: Column) -> Column:
    """Whether two neighbouring nouns may join: no numbers; a single character only as one of the joining suffixes."""
    digits = prev.rlike(r"(?U)^\d+$") | cur.rlike(r"(?U)^\d+$")
    single = (F.length(prev) == 1) | (F.length(cur) == 1)
    suffix = cur.isin(*fixed.JOINING_SUFFIXES) & (F.length(prev) >= 2)
    return ~digits & (~single | suffix)


def tag_patterns(tagged: DataFrame, patterns: list[tuple[str, ...]], skipped: str, id_col: str = "doc_id") -> DataFrame:
    """(id, term) of consecutive tokens whose tags follow one of the patterns; tokens tagged ``skipped`` are left out."""
    w = Window.partitionBy(id_col).orderBy("pos")
    out = None
    for pattern in patterns:
        hit = F.lit(True)
        parts = []
        for k, tag in enumerate(pattern):
            hit = hit & F.coalesce(F.lead("tag", k).over(w) == tag, F.lit(False)) if k else F.col("tag") == tag
            if tag != skipped:
                parts.append(F.lead("term", k).over(w) if k else F.col("term"))
        found = tagged.select(id_col, hit.alias("hit"), F.concat(*parts).alias("term")).where("hit").select(id_col, "term")
        out = found if out is None else out.unionAll(found)
    return out.where(text.valid_compound(F.col("term"))).distinct()


@cache
def _tagger(stop_words: tuple[str, ...]) -> Callable[[str], str]:
    """:func:`tag` of a string that holds no line break, as no token of :data:`MODES` does; a worker's own."""
    listed, suffixes = frozenset(stop_words), frozenset(fixed.JOINING_SUFFIXES)
    number, particle, other = map(re.compile, ("[0-9]+", "[ぁ-ん]{1,2}", "[ぁ-ん]+"))

    @lru_cache(1 << 16)
    def kind(t: str) -> str:
        if number.fullmatch(t):
            return "number"
        if t.lower() in listed or particle.fullmatch(t):
            return "particle"
        return "suffix" if t in suffixes else "other" if other.fullmatch(t) else "noun"

    return kind


@cache
def _mode_nouns(stop_words: tuple[str, ...]) -> Callable[[str], bool]:
    """Whether :func:`multi_mode_nouns` takes a token."""
    kind, letters, digits, kana, capitals = _tagger(stop_words), *map(re.compile, ("[A-Za-z]", "[0-9]", "[ア-ヴー・]+", "[A-Z]{2,}"))

    @lru_cache(1 << 16)
    def taken(t: str) -> bool:
        technical = (letters.search(t) and digits.search(t)) or (kana.fullmatch(t) and len(t) >= 3) or capitals.fullmatch(t)
        return bool(technical) or (kind(t) in ("noun", "number") and len(t) >= 2)

    return taken


def _spelt(table: pa.Table, text_col: str, mode: str) -> list[list[str]]:
    """The tokens of each of a document's texts."""
    found = re.compile(MODES[mode]).findall
    return [found(s) for s in table.column(text_col).to_pylist() if s]


def _pattern_terms(words: list[str], tags: list[str], patterns: list[tuple[str, ...]], skipped: str) -> set[str]:
    """What tokens that follow a pattern of tags spell, without those tagged ``skipped``."""
    kinds, found = np.array(tags, object), set()
    for pattern in patterns:
        n = len(words) - len(pattern) + 1
        if n < 1:
            continue
        hit = np.ones(n, bool)
        for k, kind in enumerate(pattern):
            hit &= kinds[k : k + n] == kind
        kept = [k for k, kind in enumerate(pattern) if kind != skipped]
        found.update("".join([words[i + k] for k in kept]) for i in hit.nonzero()[0].tolist())
    return found


def _one_column(table: pa.Table, id_col: str, terms: list[str], **more: pa.Array) -> pa.Table:
    return pa.table({id_col: table.column(id_col).take(pa.array(np.zeros(len(terms), np.int64))), "term": pa.array(terms, pa.string()), **more})


def document_patterns(docs: DataFrame, patterns: list[tuple[str, ...]], skipped: str, mode: str = "A", profile: LanguageProfile = LATIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term) as :func:`tag_patterns` of :func:`tagged` texts, found where each text is."""
    stop_words = tuple(profile.stop_words)

    def work(table: pa.Table) -> pa.Table:
        kind = _tagger(stop_words)
        found = set().union(*[_pattern_terms(words, [kind(w) for w in words], patterns, skipped) for words in _spelt(table, text_col, mode)])
        return _one_column(table, id_col, list(found))

    found = per_key(docs.select(id_col, text_col), id_col, work, f"`{id_col}` {dict(docs.dtypes)[id_col]}, term string", spread=True)
    return found.where(text.valid_compound(F.col("term")))


def joined_runs(docs: DataFrame, skipped: str, mode: str = "A", profile: LanguageProfile = LATIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, n): how often tokens in a row that may join (:func:`may_join`) spell a term, found where each text is; a
    token tagged ``skipped`` ends a run."""
    stop_words, suffixes = tuple(profile.stop_words), frozenset(fixed.JOINING_SUFFIXES)

    def join(a: str, b: str) -> bool:
        return not (a.isdecimal() or b.isdecimal()) and (not (len(a) == 1 or len(b) == 1) or (b in suffixes and len(a) >= 2))

    def work(table: pa.Table) -> pa.Table:
        kind, counts = _tagger(stop_words), Counter()
        for words in _spelt(table, text_col, mode):
            own: list[str] = []
            for w in words:
                left_out = kind(w) == skipped
                if own and (left_out or not join(own[-1], w)):
                    counts["".join(own)] += 1
                    own = []
                if not left_out:
                    own.append(w)
            if own:
                counts["".join(own)] += 1
        return _one_column(table, id_col, list(counts), n=pa.array(counts.values(), pa.int64()))

    return per_key(docs.select(id_col, text_col), id_col, work, f"`{id_col}` {dict(docs.dtypes)[id_col]}, term string, n long", spread=True)


def generic_candidates(docs: DataFrame, patterns: list[tuple[str, ...]], skipped: str, profile: LanguageProfile = LATIN, sizes: tuple[int, int] = (2, 4), longest: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, modes, frequency): the nouns of all modes (:func:`multi_mode_nouns`; ``modes`` is 0 for others), patterns of
    tags and whole runs of ``sizes`` nouns, with :func:`boundary_frequency` of up to ``longest`` tokens. A document's text is
    dealt out once; its tokens and their windows don't leave its task."""
    stop = frozenset(fixed.STOP_WORDS)
    joiner, stop_words = profile.joiner, tuple(profile.stop_words)

    def work(table: pa.Table) -> pa.Table:
        kind, taken = _tagger(stop_words), _mode_nouns(stop_words)
        modes: Counter = Counter()
        for mode in MODES:
            modes.update(filter(taken, set(chain.from_iterable(_spelt(table, text_col, mode)))))
        compound: set[str] = set()
        texts = _spelt(table, text_col, "A")
        for words in texts:
            tags = [kind(w) for w in words]
            compound |= _pattern_terms(words, tags, patterns, skipped)
            runs_ = _cut_runs(words, [g in ("noun", "suffix") and w not in stop for w, g in zip(words, tags)])
            compound.update(joiner.join(w) for w in runs_ if sizes[0] <= len(w) <= sizes[1])
        terms = list(modes.keys() | compound)
        known, counts, single = set(terms), Counter(), set()
        for words in texts:
            single.update(known.intersection(words))
            for n in range(1, longest + 1):
                counts.update(filter(known.__contains__, map("".join, zip(*[words[k:] for k in range(n)]))))
        frequency = pa.array([max(1, counts[t] + (t in single)) for t in terms], pa.int64())
        return _one_column(table, id_col, terms, modes=pa.array([modes[t] for t in terms], pa.int64()), compound=pa.array([t in compound for t in terms], pa.bool_()), frequency=frequency)

    found = per_key(docs.select(id_col, text_col), id_col, work, f"`{id_col}` {dict(docs.dtypes)[id_col]}, term string, modes long, compound boolean, frequency long", spread=True)
    kept = (F.col("modes") > 0) | (F.col("compound") & text.valid_compound(F.col("term")))
    return found.where(kept & text.basic_filter(F.col("term"))).select(id_col, "term", "modes", "frequency")


def document_nouns(docs: DataFrame, profile: LanguageProfile = LATIN, sizes: tuple[int, int] = (2, 4), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, term, n): :func:`single_nouns` of :func:`tagged` texts (``single``, 1), :func:`multi_mode_nouns` (``modes``,
    in how many) and :func:`noun_sequences` (``sequence``, 1), found where each text is."""
    stop, function_words, stop_words = frozenset(fixed.STOP_WORDS), frozenset(fixed.FUNCTION_WORDS), tuple(profile.stop_words)

    def work(table: pa.Table) -> pa.Table:
        kind, taken = _tagger(stop_words), _mode_nouns(stop_words)
        modes: Counter = Counter()
        for mode in MODES:
            modes.update(filter(taken, set(chain.from_iterable(_spelt(table, text_col, mode)))))
        texts = _spelt(table, text_col, "A")
        single = [t for t in set(chain.from_iterable(texts)) if len(t) >= 2 and t not in function_words and kind(t) == "noun"]
        runs_ = chain.from_iterable(_cut_runs(words, (kind(w) in ("noun", "suffix") and w not in stop for w in words)) for words in texts)
        sequences = list({"".join(w) for w in runs_ if sizes[0] <= len(w) <= sizes[1]})
        kinds = ["single"] * len(single) + ["modes"] * len(modes) + ["sequence"] * len(sequences)
        n = [1] * len(single) + list(modes.values()) + [1] * len(sequences)
        found = _one_column(table, id_col, [*single, *modes, *sequences], n=pa.array(n, pa.int64()))
        return found.add_column(1, "kind", pa.array(kinds, pa.string()))

    found = per_key(docs.select(id_col, text_col), id_col, work, f"`{id_col}` {dict(docs.dtypes)[id_col]}, kind string, term string, n long", spread=True)
    return found.where((F.col("kind") != "sequence") | text.valid_compound(F.col("term")))


def boundary_frequency(token_table: DataFrame, terms: DataFrame, longest: int = 4, plus_single: bool = True, joiner: str = "", id_col: str = "doc_id") -> DataFrame:
    """(id, term, frequency): token windows that spell a term, one more if a single token does, at least 1."""
    w = Window.partitionBy(id_col).orderBy("pos")
    grams = None
    for n in range(1, longest + 1):
        joined = F.concat_ws(joiner, *[F.lead("term", k).over(w) if k else F.col("term") for k in range(n)])
        whole = F.lead("pos", n - 1).over(w).isNotNull() if n > 1 else F.lit(True)
        part = token_table.select(id_col, joined.alias("term"), F.lit(n == 1).alias("single"), whole.alias("whole")).where("whole").drop("whole")
        grams = part if grams is None else grams.unionAll(part)
    counts = grams.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("single").cast("int")).alias("single"))
    joined = terms.join(counts, [id_col, "term"], "left")
    extra = F.coalesce("single", F.lit(0)) if plus_single else F.lit(0)
    return joined.select(id_col, "term", F.greatest(F.lit(1), F.coalesce("n", F.lit(0)) + extra).cast("long").alias("frequency"))


def containment(terms: DataFrame, id_col: str = "doc_id", shortest: int = 2) -> DataFrame:
    """(id, term, container, container_frequency) for terms that are proper substrings of others of the same document.

    ``terms`` holds each term of a document once. A document's terms meet in one task, in one automaton.
    """
    rows = terms.select(id_col, "term", "frequency")

    def work(table: pa.Table) -> pa.Table:
        pairs = [(i, j) for i, parts in inside(table.column("term").to_pylist(), shortest) for j in parts]
        whole, part = (pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1))
        container = table.take(whole)
        return pa.table({id_col: container.column(id_col), "term": table.column("term").take(part), "container": container.column("term"), "container_frequency": container.column("frequency")})

    kinds = dict(rows.dtypes)
    return per_key(rows, id_col, work, f"{id_col} {kinds[id_col]}, term string, container string, container_frequency {kinds['frequency']}")


def _containers(terms: list[str | None], frequency: list[int], shortest: int) -> tuple[pa.Array, pa.Array]:
    """The mean and the largest frequency of each term's containers, null without any."""
    total, count, most = [0] * len(frequency), [0] * len(frequency), [0] * len(frequency)
    for i, parts in inside(terms, shortest):
        for j in parts:
            total[j] += frequency[i]
            count[j] += 1
            most[j] = max(most[j], frequency[i])
    mean = pa.array([t / n if n else None for t, n in zip(total, count)], pa.float64())
    return mean, pa.array([m if n else None for m, n in zip(most, count)], pa.int64())


def with_containers(terms: DataFrame, id_col: str = "doc_id", shortest: int = 2) -> DataFrame:
    """``terms`` with ``__mean`` and ``__most``: the mean and the largest frequency of a term's containers, null without any."""
    columns = [id_col, *[c for c in terms.columns if c != id_col]]

    def work(table: pa.Table) -> pa.Table:
        mean, most = _containers(table.column("term").to_pylist(), table.column("frequency").to_pylist(), shortest)
        return table.append_column("__mean", mean).append_column("__most", most)

    return per_key(terms.select(*columns), id_col, work, f"{fields(terms.select(*columns))}, __mean double, __most long", spread=True).select(*terms.columns, "__mean", "__most")


def meaningful_part(part: Column, whole: Column) -> Column:
    """A part at either end, at least six tenths of the whole there, and one of the words with a meaning of their own."""
    short = F.length(part) < 0.6 * F.length(whole)
    ends, starts = F.endswith(whole, part), F.startswith(whole, part)
    return ~(ends & short) & ~(starts & short) & (ends | starts) & part.isin(*fixed.MEANINGFUL_PARTS)


def prune_parts(terms: DataFrame, id_col: str = "doc_id", keep: Callable[[Column, Column], Column] = meaningful_part) -> DataFrame:
    """Terms of three or more characters that are no part of a longer one, or a part worth keeping."""
    lost = containment(terms, id_col, 3).where(~keep(F.col("term"), F.col("container"))).select(id_col, "term").distinct()
    return terms.where(F.length("term") >= 3).join(lost, [id_col, "term"], "left_anti")


def _meaningful(part: str, whole: str) -> bool:
    """:func:`meaningful_part` of two strings."""
    ends, starts = whole.endswith(part), whole.startswith(part)
    return (ends or starts) and len(part) >= 0.6 * len(whole) and part in fixed.MEANINGFUL_PARTS


def meaningful_terms(docs: DataFrame, made: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term) as :func:`prune_parts` of the distinct terms of the array ``made`` of a document's text: the text is dealt
    out, and terms are made, compared and left out where it is."""

    def work(table: pa.Table) -> pa.Table:
        terms = list(dict.fromkeys(x for own in table.column("__t").to_pylist() if own for x in own))
        lost = {j for i, parts in inside(terms, 3) for j in parts if not _meaningful(terms[j], terms[i])}
        return _one_column(table, id_col, [t for j, t in enumerate(terms) if t is not None and len(t) >= 3 and j not in lost])

    return per_key(docs.select(id_col, text_col), id_col, work, f"`{id_col}` {dict(docs.dtypes)[id_col]}, term string", [made.alias("__t")], spread=True)


def without(terms: DataFrame, words: tuple[str, ...], col: str = "term") -> DataFrame:
    """Terms that are none of the words (a list of fixed size, broadcast)."""
    listed = terms.sparkSession.createDataFrame([(w,) for w in words], f"{col} string")
    return terms.join(F.broadcast(listed), col, "left_anti")


def difference(terms: DataFrame, others: DataFrame, *keys: str) -> DataFrame:
    """Terms that the others don't hold."""
    return terms.join(others.select(*keys).distinct(), list(keys), "left_anti")


def prefilter(terms: DataFrame) -> DataFrame:
    """No generic or layout words and no single characters, after NFKC."""
    normal = terms.withColumn("__n", text.nfkc(F.col("term"))).where(F.length("__n") > 1)
    listed = terms.sparkSession.createDataFrame([(w,) for w in fixed.GENERIC_WORDS + fixed.LAYOUT_WORDS], "__n string")
    return normal.join(F.broadcast(listed), "__n", "left_anti").drop("__n")


def longest_first(terms: DataFrame, most: int = 100, id_col: str = "doc_id") -> DataFrame:
    w = Window.partitionBy(id_col).orderBy(F.length("term").desc(), "term")
    return terms.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
