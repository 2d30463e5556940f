"""Perplexity arithmetic on captured responses: pure columns, no calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text

#: Tokens of a response: array<struct<token, logprob, top: array<struct<token, logprob>>>>.


def perplexity(logprobs: Column) -> Column:
    """exp(-mean); null for none."""
    return F.when(F.size(logprobs) > 0, F.exp(-(F.aggregate(logprobs, F.lit(0.0), lambda s, x: s + x) / F.size(logprobs))))


def term_logprob(tokens: Column, term: Column) -> Column:
    """Mean log probability of the tokens that hold the term or are part of it as they stand, -3 for none."""
    own = F.transform(F.filter(tokens, lambda x: F.contains(x["token"], term) | F.contains(term, x["token"])), lambda x: x["logprob"])
    return F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda s, x: s + x) / F.size(own)).otherwise(F.lit(-3.0))


def details(tokens: Column, most: int = 10, candidates: int = 3) -> Column:
    """The first tokens with their probabilities, each with its first candidates and theirs."""
    shown = lambda x: F.struct(x["token"].alias("token"), x["logprob"].alias("logprob"), F.exp(x["logprob"]).alias("prob"))
    of = lambda x: F.struct(x["token"].alias("token"), x["logprob"].alias("logprob"), F.exp(x["logprob"]).alias("prob"), F.transform(F.slice(x["top"], 1, candidates), shown).alias("top_candidates"))
    return F.transform(F.slice(tokens, 1, most), of)


def mean_perplexity(contexts: DataFrame, *keys: str) -> DataFrame:
    """(keys, perplexity, avg_logprob, confidence) over contexts (keys, perplexity); 50, -3.9 and medium for none."""
    out = contexts.groupBy(*keys).agg(F.avg("perplexity").alias("perplexity"))
    out = out.withColumn("avg_logprob", F.coalesce(-F.log("perplexity"), F.lit(-3.9)))
    known = F.when(F.col("perplexity").isNull(), "medium").when(F.col("perplexity") < 20, "high").when(F.col("perplexity") < 50, "medium").otherwise("low")
    return out.withColumn("confidence", known).withColumn("perplexity", F.coalesce("perplexity", F.lit(50.0)))


def masked(tokens: Column, predicted: Column, term: Column) -> dict[str, Column]:
    """Perplexity, log probability and rank of a masked term: the first candidate that holds it, else an exact answer, else 100."""
    flat = F.flatten(F.transform(tokens, lambda t: F.transform(t["top"], lambda c, i: F.struct(c["logprob"].alias("lp"), (i + 1).alias("rank"), F.contains(c["token"], term).alias("hit")))))
    hit = F.get(F.filter(flat, lambda x: x["hit"]), F.lit(0))
    first = F.get(tokens, F.lit(0))["logprob"]
    exact = F.coalesce((F.trim(predicted) == term) & first.isNotNull(), F.lit(False))
    pick = lambda a, b, c: F.when(hit.isNotNull(), a).when(exact, b).otherwise(c)
    return {"perplexity": pick(F.exp(-hit["lp"]), F.exp(-first), F.lit(100.0)), "logprob": pick(hit["lp"], first, F.lit(-4.6)), "rank": pick(hit["rank"], F.lit(1), F.lit(11)).cast("int")}


def from_features(features: dict[str, Column]) -> Column:
    """An estimate from a text's features alone: 40 and more, 95 at most."""
    more = F.when(features["technical_density"] > 0.3, 20.0).otherwise(0.0) + F.when(features["mixed_ratio"] > 0.2, 15.0).otherwise(0.0)
    return F.least(F.lit(95.0), 40.0 + more + F.when(features["abbreviations"] > 2, 10.0).otherwise(0.0))


def from_term(term: Column, frequency: Column) -> Column:
    """An estimate from a term's shape and frequency: 20 and more, within 10 and 60."""
    n = F.length(term)
    score = F.lit(20.0) + F.when(term.rlike("[A-Z][0-9]|[0-9][A-Z]"), 15).otherwise(0) + F.when(n > 8, 10).when(n > 5, 5).otherwise(0)
    score = score + F.when(term.rlike("^[ァ-ヴー]+$") & (n > 4), 8).otherwise(0) + F.when(frequency == 1, 10).when(frequency == 2, 5).otherwise(0)
    return F.least(F.lit(60.0), F.greatest(F.lit(10.0), score + F.when(term.rlike("^[A-Z]{2,}$"), 12).otherwise(0)))


def chunk_perplexity(reply: Column) -> Column:
    """From a reply with a score: 105 less it, at least 5; 50 for none."""
    score = text.first_integer(reply)
    return F.when(score.isNotNull(), F.greatest(F.lit(5.0), 105 - score)).otherwise(F.lit(50.0))


def token_probability(partial: Column, context: Column, similarity: Column) -> Column:
    """Weighted 0.4, 0.4, 0.2 in this order; the method that is missing shifts the later ones up, and weights aren't scaled."""
    value = F.when(context.isNotNull(), 0.4 * partial + 0.4 * context + 0.2 * similarity).otherwise(0.4 * partial + 0.4 * similarity)
    return F.when(value.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))


def generation_probability(term: Column, partial: Column, generality: Column) -> Column:
    return F.when(F.length(term) < 3, 0.1).otherwise(0.7 * partial + 0.3 * generality)


def split_points(term: Column) -> Column:
    """Where a term is cut for completion: a third, a half, two thirds; none under four characters."""
    n = F.length(term)
    at = lambda a, b: F.floor(n * a / b).cast("int")
    return F.when(n >= 4, F.array(at(1, 3), at(1, 2), at(2, 3))).otherwise(F.array().cast("array<int>"))


def weighted(consistency: Column, comprehension: Column, naturalness: Column) -> Column:
    value = 0.4 * consistency + 0.3 * comprehension + 0.3 * naturalness
    return F.when(value.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(5.0), value))).otherwise(F.lit(80.0))


def consistency(term: Column, definitions: Column) -> Column:
    """40, up to 20 for the variance of definitions' lengths, 15 a word of uncertainty, less for terms that look technical."""
    lengths = F.transform(definitions, lambda d: F.length(d).cast("double"))
    n = F.size(definitions)
    total, squares = (F.aggregate(lengths, F.lit(0.0), f) for f in (lambda s, x: s + x, lambda s, x: s + x * x))
    variance = F.when(n > 1, squares / n - (total / n) * (total / n)).otherwise(0.0)
    doubt = F.aggregate(F.transform(definitions, text.uncertain_words), F.lit(0), lambda s, x: s + x)
    shape = F.when(F.length(term) >= 4, 10).otherwise(0) + F.when(term.rlike("[ア-ヴー]{3,}"), 5).otherwise(0) + F.when(term.rlike("[A-Z]{2,}"), 5).otherwise(0)
    return F.when(n == 0, F.lit(80.0)).otherwise(40 + F.least(variance / 10, F.lit(20.0)) + 15 * doubt - shape)


def comprehension(reply: Column) -> Column:
    return F.coalesce(5 + 9.5 * text.first_integer(reply), F.lit(50.0))


def naturalness(scores: Column) -> Column:
    mean = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / F.size(scores)
    return F.when(F.size(scores) > 0, F.greatest(F.lit(5.0), 105 - 10 * mean)).otherwise(F.lit(40.0))


def mask_perplexity(p: Column) -> Column:
    return F.when(p > 0, F.least(F.lit(100.0), F.greatest(F.lit(5.0), -F.log(p) * 10)))


def generality(reply: Column) -> Column:
    return F.coalesce(text.first_integer(reply) / 10, F.lit(0.4))


def robust_median(values: Column) -> Column:
    """Median of the values between 5 and 100, both excluded."""
    sane = F.array_sort(F.filter(values, lambda v: (v > 5) & (v < 100)))
    n = F.size(sane)
    mid = (F.get(sane, F.floor((n - 1) / 2).cast("int")) + F.get(sane, F.floor(n / 2).cast("int"))) / 2
    return F.when(n > 0, mid)


def unknown(definition: Column, original: Column, threshold: float = 0.7, similarity: Column | None = None) -> dict[str, Column]:
    """Similarity and whether a term is unknown: words of uncertainty in the context-free definition decide before it."""
    explicit = F.coalesce(text.uncertain_words(definition) > 0, F.lit(False))
    value = F.when(explicit, 0.0).otherwise(similarity)
    return {"similarity": value, "explicitly_unknown": explicit, "is_unknown": explicit | F.coalesce(value < threshold, F.lit(False))}


def kept_verdict(reply: Column, score: Column, error: Column) -> Column:
    """Whether validation keeps a term: a filtered reply by its score, another error always, else a yes."""
    yes, _ = text.verdict(reply)
    return F.when(error == "content_filter", score > 0.5).when(error.isNotNull(), F.lit(True)).otherwise(F.coalesce(yes, F.lit(False)))


UNCERTAIN = fixed.UNCERTAIN
