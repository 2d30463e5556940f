"""Scalar text operators as column expressions; Python only where Spark has no such function."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType

from . import fixed


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(DoubleType())
def string_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two strings."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def squeeze(s: Column) -> Column:
    """Whitespace of any kind to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def normalise(s: Column) -> Column:
    return squeeze(nfkc(s))


def normalise_term(s: Column) -> Column:
    return F.translate(nfkc(s), "−～", "-~")


_KATA, _KANJI, _HIRA, _CODE = "[ァ-ヶー]+", "[一-龥]+", "[ぁ-ん]+", "[A-Z0-9]+"
#: What belongs together on both sides of a line break, in this order.
BROKEN = ((_KATA, _KATA), (_KANJI, _HIRA), (_CODE, _CODE), (_KATA, _KANJI), (_KANJI, _KANJI))


def rejoin_broken(s: Column) -> Column:
    """Words that a line break cuts: five rules, in their order."""
    for a, b in BROKEN:
        s = F.regexp_replace(s, f"({a})\n({b})", "$1$2")
    return s


def count_apart(s: Column, t: Column) -> Column:
    """Occurrences of ``t`` that don't overlap, from the left; 0 for an empty one."""
    n = (F.length(s) - F.length(F.replace(s, t, F.lit("")))) / F.length(t)
    return F.when(F.length(t) > 0, n).otherwise(0).cast("long")


def spans(s: str, t: str, overlapping: bool = False, any_case: bool = False) -> Iterator[tuple[int, int]]:
    """Where ``t`` is in ``s``, from the left, in one search through it; nowhere if it is empty."""
    if any_case:
        yield from (m.span() for m in re.finditer(re.escape(t), s, re.IGNORECASE) if t)
        return
    at = s.find(t) if t else -1
    while at >= 0:
        yield at, at + len(t)
        at = s.find(t, at + (1 if overlapping else len(t)))


def _places(overlapping: bool):
    @F.pandas_udf(ArrayType(IntegerType()))
    def places_of(s: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else [a + 1 for a, _ in spans(x, y, overlapping)] for x, y in zip(s, t)], dtype=object)

    return places_of


def places(s: Column, t: Column) -> Column:
    """1-based places of ``t``, overlapping ones included."""
    return _places(True)(s, t)


def places_apart(s: Column, t: Column) -> Column:
    """1-based places of ``t`` that don't overlap."""
    return _places(False)(s, t)


def has_alnum(t: Column) -> Column:
    return t.rlike("[A-Za-z0-9]")


def katakana_heavy(t: Column) -> Column:
    return F.regexp_count(t, F.lit("[ァ-ヴー]")) >= 0.5 * F.length(t)


def _letters_digits(t: Column) -> Column:
    return t.rlike("[A-Za-z]") & t.rlike("[0-9]")


def technical_term(t: Column) -> Column:
    return _letters_digits(t) | (t.rlike("^[ア-ヴー・]+$") & (F.length(t) >= 3)) | t.rlike("^[A-Z]{2,}$")


def technical_features(t: Column) -> Column:
    ends = F.lit(False)
    for s in fixed.TECHNICAL_SUFFIXES:
        ends = ends | t.endswith(s)
    return _letters_digits(t) | t.rlike("[ア-ヴー]") | ends | t.rlike("^[一-龥]{3,}$")


def valid_compound(t: Column) -> Column:
    return F.length(t).between(3, 20) & ~t.isin(*fixed.COMPOUND_COMMON) & technical_features(t)


def basic_filter(t: Column) -> Column:
    return F.length(t).between(2, 30) & ~t.rlike(r"(?U)^\d+$") & ~t.isin(*fixed.COMMON_WORDS)


def valid_term(t: Column, stop: tuple[str, ...] = fixed.STOP_WORDS) -> Column:
    """No stop word, and none at either end of a longer term."""
    words = F.array(*map(F.lit, stop)) if stop else F.array().cast("array<string>")
    edge = F.exists(words, lambda x: (F.length(t) > F.length(x)) & (F.startswith(t, x) | F.endswith(t, x)))
    return ~F.array_contains(words, t) & ~edge


def feature_counts(s: Column) -> dict[str, Column]:
    """What the features of a text are worked out from. No match holds a blank, so counts of parts between blanks add up."""
    words = F.size(F.filter(F.split(s, r"(?U)\s+"), lambda w: w != ""))
    patterns = {"kata": "[ア-ヴー]{3,}", "latin": "[A-Za-z]{3,}", "number": r"\d+\.?\d*", "capitals": "[A-Z]{2,}"}
    return {"words": words} | {name: F.regexp_count(s, F.lit(p)) for name, p in patterns.items()}


def features_from(counts: dict[str, Column]) -> dict[str, Column]:
    """Technical density, mixed ratio and number of abbreviations; zeros without words."""
    words, kata, latin, number = (counts[c] for c in ("words", "kata", "latin", "number"))
    some = lambda c: F.when(words > 0, c).otherwise(F.lit(0.0))
    return {"technical_density": some((kata + latin + number) / words), "mixed_ratio": some((kata + latin) / words), "abbreviations": F.when(words > 0, counts["capitals"]).otherwise(0).cast("long")}


def features(s: Column) -> dict[str, Column]:
    """The features of a text."""
    return features_from(feature_counts(s))


def sentences_of(s: Column, marks: str = "。！？\n") -> Column:
    """Sentences of 11 to 199 characters."""
    return F.filter(F.transform(F.split(s, f"[{marks}]+"), lambda x: F.trim(x)), lambda x: (F.length(x) > 10) & (F.length(x) < 200))


def sentences_with(s: Column, t: Column, marks: str = "。！？\n", most: int = 3) -> Column:
    """The first such sentences that hold the term."""
    return F.slice(F.filter(sentences_of(s, marks), lambda x: F.contains(x, t)), 1, most)


def cache_key(s: Column) -> Column:
    """Digest of the normalised text."""
    return F.md5(normalise(s))


def shortest_sentence(sentences: Column, t: Column, made: str = fixed.MADE_SENTENCE) -> Column:
    """The shortest of the sentences, the first of equals; one that is made where there is none."""
    ranked = F.array_sort(F.transform(sentences, lambda x, i: F.struct(F.length(x).alias("n"), i.alias("i"), x.alias("x"))))
    return F.coalesce(F.get(ranked, F.lit(0))["x"], F.replace(F.lit(made), F.lit("{}"), t))


def first_integer(s: Column) -> Column:
    found = F.regexp_extract(s, r"(\d+)", 1)
    return F.when(found != "", found.cast("double"))


def uncertain_words(s: Column) -> Column:
    """How many of the words of uncertainty a text holds."""
    return F.size(F.filter(F.array(*map(F.lit, fixed.UNCERTAIN)), lambda k: F.contains(s, k)))


def verdict(reply: Column) -> tuple[Column, Column]:
    """(yes?, rest) of a reply ``YES | definition`` or ``NO | reason``; null for anything else."""
    parts = F.split(reply, r"\|", 2)
    rest = F.trim(F.get(parts, F.lit(1)))
    head = F.upper(F.trim(reply))
    return F.when(F.startswith(head, F.lit("YES")), F.lit(True)).when(F.startswith(head, F.lit("NO")), F.lit(False)), rest


def choice_perplexity(reply: Column) -> Column:
    """Choice A to D as a perplexity, 25 for none."""
    c = F.upper(F.substring(F.trim(reply), 1, 1))
    return F.when(c == "A", 10.0).when(c == "B", 18.0).when(c == "C", 28.0).when(c == "D", 40.0).otherwise(25.0)


def preview(s: Column, n: int = 80) -> Column:
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n - 3), F.lit("..."))).otherwise(s)


def domain_of(t: Column) -> Column:
    out = None
    for name, words in fixed.DOMAIN_KEYWORDS.items():
        hit = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(t, w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general")
