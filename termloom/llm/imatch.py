"""I-Match fingerprints: the terms of a text within a band of inverse document frequency, distinct and sorted, are hashed
once for each of several randomised subsets of the lexicon.

Main path: DataFrame functions only. The lexicon holds the terms found in between ``low`` and ``high`` of all documents.
Document frequencies sum to (documents x distinct terms of each), so at most (mean distinct terms) / ``low`` terms reach
the band's floor: the lexicon's size is bounded whatever the corpus' size, and it travels as one scalar. It is a table
of 2^16 short lists addressed by hash, so a term is looked up in constant time inside its own row and no text is
exploded or shuffled to be fingerprinted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of all documents that a term of the lexicon is found in.
LOW, HIGH = 0.001, 0.2
#: Subsets of the lexicon: the whole of it, and for each rate r SEEDS of them that hold a term with probability 2^-r.
#: A subset tells texts apart by degrees where it holds a few of their terms: short texts have dense ones for that, long
#: texts sparse ones. Subsets of one seed are nested, so each is cut from the one before it.
RATES, SEEDS = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10), 8
#: Terms that the lexicon holds at most; beyond them it is an error to be met by a higher ``low``.
MOST_TERMS = 1 << 23
#: Below so many terms within the band, all terms of a text are its lexicon.
FEWEST = 3
_SLOTS = 1 << 16


def terms(text: Column) -> Column:
    """Hashes of the distinct terms (runs of letters and digits, in lower case), ascending."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"))
    return F.array_sort(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """One row, ``slots``: the lexicon's terms in 2^16 lists by their lowest bits."""
    rows = docs.select(F.explode(terms(F.col(text_col))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    kept = rows.where(F.col("n") > 1).join(F.broadcast(total)).where((F.col("n") >= F.col("total") * low) & (F.col("n") <= F.col("total") * high))
    slots = kept.groupBy(F.col("t").bitwiseAND(F.lit(_SLOTS - 1)).cast("int").alias("slot")).agg(F.collect_list("t").alias("ts"))
    empty = F.lit(None).cast("array<bigint>")
    by_slot = slots.agg(F.array_sort(F.collect_list(F.struct("slot", "ts"))).alias("all"))
    # gaps between slots are filled, so that a slot is found by its place
    before = F.concat(F.array(F.lit(-1)), F.transform("all", lambda x: x["slot"]))
    dense = F.zip_with("all", F.slice(before, 1, F.size("all")), lambda x, b: F.concat(F.array_repeat(empty, x["slot"] - b - 1), F.array(x["ts"])))
    size = F.aggregate("all", F.lit(0), lambda n, x: n + F.size(x["ts"]))
    fits = F.when(size <= MOST_TERMS, F.flatten(dense)).otherwise(F.raise_error(F.lit("the lexicon has too many terms: raise low")).cast("array<array<bigint>>"))
    return by_slot.select(fits.alias("slots"))


def _next(rate: int, seed: int) -> Callable[[Column], Column]:
    """Whether a term of a seed's subset is in the next sparser one: one bit of the term, or of its hash for later seeds."""

    def in_next(t: Column) -> Column:
        bits = t if seed < 4 else F.xxhash64(t)
        return F.shiftrightunsigned(bits, 16 + 10 * (seed % 4) + rate - 1).bitwiseAND(F.lit(1).cast("long")) == 0

    return in_next


def fingerprinted(df: DataFrame, slots: Column, text_col: str, out: str) -> DataFrame:
    """``df`` with ``out``, ``array<bigint>``: a hash of the chosen terms for every subset of the lexicon, null for none.

    The first subset is the whole lexicon. Equal texts have equal fingerprints; a text with fewer than ``FEWEST`` terms
    of the lexicon uses all its terms, one without terms (null, empty, marks only) has its own hash alone.
    """

    def listed(table: Column, t: Column) -> Column:
        return F.coalesce(F.array_contains(F.get(table, t.bitwiseAND(F.lit(_SLOTS - 1)).cast("int")), t), F.lit(False))

    df = df.withColumn("__all", terms(F.col(text_col)))
    # a scalar subquery may not be written inside a higher-order function; the optimiser inlines this single use of it
    df = df.withColumn("__slots", slots).withColumn("__in", F.transform(F.array("__slots"), lambda table: F.filter("__all", lambda t: listed(table, t)))[0]).drop("__slots")
    df = df.withColumn("__in", F.when(F.size("__in") >= FEWEST, F.col("__in")).otherwise(F.col("__all")))
    df = df.withColumns({f"__s{s}": F.col("__in") for s in range(SEEDS)}).withColumn("__p", F.array(F.xxhash64("__in")))
    # one projection a rate: each subset is cut once from the one before it, and hashed
    for r in RATES:
        df = df.withColumns({f"__s{s}": F.filter(f"__s{s}", _next(r, s)) for s in range(SEEDS)})
        hashes = [F.when(F.size(f"__s{s}") > 0, F.xxhash64(f"__s{s}")) for s in range(SEEDS)]
        df = df.withColumn("__p", F.concat("__p", F.array(*hashes)))
    own = F.array(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return df.withColumn(out, F.when(F.size("__all") > 0, F.col("__p")).otherwise(own)).drop("__all", "__in", "__p", *[f"__s{s}" for s in range(SEEDS)])


def printed(prints: Column) -> Column:
    """The fingerprint as text."""
    return F.array_join(F.transform(prints, lambda h: F.lower(F.hex(h))), "-", ".")


def likeness(x: Column, y: Column) -> Column:
    """Share of the subsets present in either fingerprint whose hashes are equal."""
    either = F.size(F.filter(F.zip_with(x, y, lambda a, b: F.coalesce(a, b)), lambda v: v.isNotNull()))
    equal = F.size(F.filter(F.zip_with(x, y, lambda a, b: a == b), lambda v: v))
    return F.coalesce(equal / either, F.lit(0.0)).cast("double")


#: Documents of a bucket of neighbouring ids, and the most buckets; the buckets' bounds and heads are broadcast.
BUCKET_DOCS, MOST_BUCKETS = 1000, 1 << 16


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are not above ``key``; searched in two steps of about a square root each."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    listed = lambda xs: "array(" + ", ".join(f"{x}L" if x > -(2**63) else "-9223372036854775807L - 1" for x in xs) + ")"
    coarse = F.expr(listed(bounds[::step]))
    fine = F.expr("array(" + ", ".join(listed(bounds[i : i + step]) for i in range(0, len(bounds), step)) + ")")
    c = F.size(F.filter(coarse, lambda b: b <= key))
    return F.when(c == 0, F.lit(0)).otherwise((c - 1) * step + F.size(F.filter(F.get(fine, c - 1), lambda b: b <= key)))


def with_next(df: DataFrame, columns: list[str], id_col: str = "doc_id", tie_col: str | None = None) -> DataFrame:
    """``df`` with ``next_<c>`` for each of ``columns``: its value in the row with the next smaller id, after the last in the first.

    Rows are dealt to buckets of neighbouring ids and shuffled once; the head of each bucket also travels to the bucket
    above it, where it follows the last row. Rows that repeat an id follow one another in the order of ``tie_col``;
    a null id is the smallest. A single row is its own next.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    keyed = df.withColumn("__key", key)
    n = df.count()
    buckets = min(MOST_BUCKETS, n // BUCKET_DOCS)
    bounds: list[int] = []
    if buckets > 1:
        shares = F.expr("array(" + ", ".join(f"{i / buckets:.17g}D" for i in range(1, buckets)) + ")")
        bounds = sorted(set(df.select(key.alias("k")).agg(F.percentile_approx("k", shares, max(10_000, 4 * buckets)).alias("b")).first()["b"]))
    keyed = keyed.withColumn("__bucket", _bucket(F.col("__key"), bounds))
    heads = df.select(key.alias("k")).groupBy(_bucket(F.col("k"), bounds).alias("b")).agg(F.max("k").alias("__head"))
    w = Window.orderBy("b")
    heads = heads.select("__head", F.coalesce(F.lead("b").over(w), F.min("b").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("__above"))
    keyed = keyed.join(F.broadcast(heads), keyed["__key"] == heads["__head"], "left")
    own = F.struct(F.col("__bucket").alias("b"), F.lit(0).alias("sent"))
    both = F.array(own, F.struct(F.col("__above").alias("b"), F.lit(1).alias("sent")))
    placed = keyed.withColumn("__to", F.explode(F.when(F.col("__above").isNotNull(), both).otherwise(F.array(own)))).drop("__head", "__above", "__bucket")
    placed = placed.withColumn("__b", F.col("__to.b")).withColumn("__sent", F.col("__to.sent")).drop("__to")
    order = [F.col("__sent"), F.col("__key").desc()] + ([F.col(tie_col)] if tie_col else [])
    lead = F.lead(F.struct(*columns)).over(Window.partitionBy("__b").orderBy(*order))
    out = placed.withColumn("__next", lead).where("__sent = 0")
    for c in columns:
        out = out.withColumn(f"next_{c}", F.when(F.col("__next").isNull(), F.col(c)).otherwise(F.col(f"__next.{c}")))
    return out.drop("__next", "__b", "__sent", "__key")
