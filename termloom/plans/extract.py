"""End-to-end plans over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import text
from ..operators import around, candidates, chunkers, graph, passes, perplexity, rank, stats, vectors
from ..sources.provider import Provider, embed
from ..sources.shared import cut


def window_tfidf(docs: DataFrame, config: EngineConfig, size: int = 100, least: int = 10) -> DataFrame:
    """(doc_id, term, tfidf) with whole-token counts in word windows of half overlap (:func:`chunkers.word_windows`).

    Tokens hold no blanks, so a window of an even ``size`` is two neighbouring blocks of half its size: tokens are counted
    once, in blocks, and a term's blocks are added up in their order. All rows of a (document, term) stay where one shuffle
    has put them. ``docs`` has each document once.
    """
    if size % 2:
        raise ValueError("the size of a window must be even")
    step, n = size // 2, F.size("w")
    split = docs.select("doc_id", chunkers.words(F.col("text")).alias("w")).where(n > 0)
    parts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int")), lambda b: F.array_join(F.slice("w", b * step + 1, step), " "))
    windows = F.when(n >= least, F.floor((n - least) / step) + 1).otherwise(0).cast("int")
    blocks = split.select("doc_id", windows.alias("n_chunks"), F.posexplode(parts).alias("block", "part"))
    found = blocks.select("doc_id", "n_chunks", "block", F.explode(F.regexp_extract_all("part", F.lit(config.profile.token), F.lit(0))).alias("term")).repartition("doc_id", "term")
    counts = found.groupBy("doc_id", "term", "block").agg(F.count(F.lit(1)).alias("n"), F.first("n_chunks").alias("n_chunks"))
    w = Window.partitionBy("doc_id", "term").orderBy("block")
    after = F.when(F.lead("block").over(w) == F.col("block") + 1, F.lead("n").over(w)).otherwise(0)
    lonely = (F.col("block") > 0) & (F.col("block") <= F.col("n_chunks")) & (F.coalesce(F.lag("block").over(w), F.lit(-1)) != F.col("block") - 1)
    both = counts.select("doc_id", "term", "n_chunks", F.when(F.col("block") < F.col("n_chunks"), F.col("n") + after).alias("own"), F.when(lonely, F.col("n")).alias("before"))
    per = both.groupBy("doc_id", "term").agg(F.max(F.greatest("own", "before")).alias("tf"), (F.count("own") + F.count("before")).alias("df"), F.first("n_chunks").alias("n_chunks"))
    return per.where("df > 0").select("doc_id", "term", stats.tfidf().alias("tfidf"))


def scored_terms(docs: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """(doc_id, term, frequency, tfidf, c_value, score): TF-IDF and C-value of all candidates, scaled within the document,
    then candidates of ``min_frequency``, blended. Rare terms set the scales and contain others before they go."""
    config = config or EngineConfig()
    counts = candidates.document_terms(docs, config.profile).drop("words", "squares")
    both = stats.c_value(counts).join(window_tfidf(docs, config), ["doc_id", "term"], "left").withColumn("tfidf", F.coalesce("tfidf", F.lit(0.0)))
    both = stats.min_max(stats.min_max(both, "tfidf", "tfidf_norm", "doc_id"), "c_value", "c_norm", "doc_id")
    kept = both.where(F.col("frequency") >= config.min_frequency)
    return kept.withColumn("score", F.round(stats.base_score(F.col("tfidf_norm"), F.col("c_norm")), 9)).select("doc_id", "term", "frequency", "tfidf", "c_value", "score")


def statistical_terms(docs: DataFrame, config: EngineConfig | None = None, most: int = 50) -> DataFrame:
    """Entry A: scored, penalised, cut where the scores fall off, ``most`` a document at most."""
    scored = rank.substring_penalty(scored_terms(docs, config))
    scored = scored.withColumn("score", F.round(F.col("score") * F.col("penalty"), 9))
    return rank.within_cutoff(scored, most).select("doc_id", "term", "frequency", "tfidf", "c_value", "score", "rank")


def compound_scores(docs: DataFrame, config: EngineConfig | None = None, mark: str = ".", size: int = 500) -> DataFrame:
    """As :func:`scored_terms` on candidates from three sources: n-grams of noun runs, katakana, words of letters and
    digits; TF-IDF counts substrings of paragraphs or packed sentences of some ``size``."""
    config = config or EngineConfig()
    both = stats.candidate_scores(docs, lambda s: chunkers.paragraphs(s, size, mark), config.profile)
    both = stats.min_max(stats.min_max(both, "tfidf", "tfidf_norm", "doc_id"), "c_value", "c_norm", "doc_id")
    kept = both.where(F.col("frequency") >= config.min_frequency)
    return kept.withColumn("score", F.round(stats.base_score(F.col("tfidf_norm"), F.col("c_norm")), 9)).select("doc_id", "term", "frequency", "tfidf", "c_value", "score")


def compound_terms(docs: DataFrame, config: EngineConfig | None = None, most: int = 50, mark: str = ".") -> DataFrame:
    """Entry A whole: compound candidates, both penalties, the cut where scores fall off, ``most`` a document at most."""
    scored = rank.both_penalties(compound_scores(docs, config, mark))
    scored = scored.withColumn("score", F.round(F.col("score") * F.col("penalty") * F.col("factor"), 9))
    return rank.within_cutoff(scored, most).select("doc_id", "term", "frequency", "tfidf", "c_value", "factor", "score", "rank")


def generic_terms(docs: DataFrame, config: EngineConfig | None = None, most: int = 30) -> DataFrame:
    """Candidates of all tokenizer modes, tag patterns and noun sequences, scored by frequency at token borders, C- and
    NC-value, the best ``most`` of a document."""
    config = config or EngineConfig()
    patterns = [("noun", "noun"), ("noun", "noun", "noun"), ("noun", "suffix"), ("noun", "particle", "noun")]
    found = candidates.generic_candidates(docs, patterns, "particle", config.profile)
    scored = stats.nc_value(stats.c_value(around.weighed(docs, found), 3))
    scored = scored.withColumn("score", F.round(stats.generic_score(F.col("nc_value"), F.col("frequency"), F.col("term"), F.col("modes")), 9))
    return rank.top_per(scored, most, "doc_id").select("doc_id", "term", "frequency", "modes", "score", "rank")


def graph_terms(docs: DataFrame, provider: Provider, config: EngineConfig | None = None, nodes: int = 300, most: int = 50, mark: str = ".") -> DataFrame:
    """Entry A with a graph: the best ``nodes`` compound candidates that are no generic words, their base scores spread
    over similar terms of the document, weighed by the sentences that hold both, cut where scores fall off."""
    base = candidates.prefilter(compound_scores(docs, config, mark)).withColumn("base_score", F.col("score"))
    kept = rank.top_per(base, nodes, "doc_id").drop("score", "rank").withColumn("id", F.xxhash64("doc_id", "term"))
    ranked = graph.document_ranks(embed(kept, provider).drop("error"), docs, chunkers.sentences(F.col("text"), mark))
    fused = graph.fuse(ranked, 0.6, "doc_id").drop("id").withColumn("score", F.round("score", 9))
    return rank.within_cutoff(fused, most)


def statistically_best(docs: DataFrame, config: EngineConfig, most: int) -> DataFrame:
    """(doc_id, term, frequency, c_value, tfidf, score, rank): the ``most`` best terms of a document by statistics alone."""
    norm = F.sqrt("squares")
    both = stats.c_value(candidates.document_terms(docs, config.profile), 2).withColumn("tfidf", F.when(norm > 0, F.col("words") / norm).otherwise(F.lit(0.0))).drop("words", "squares")
    scored = both.withColumn("score", F.round(stats.statistical_score(F.col("c_value"), F.col("tfidf"), F.col("frequency")), 9))
    return rank.top_per(scored, most, "doc_id")


def evaluated_terms(docs: DataFrame, config: EngineConfig | None = None, most: int = 100) -> DataFrame:
    """Entry C without a remote model: statistical score, a perplexity from features, priority and class."""
    best = statistically_best(docs, config or EngineConfig(), most).withColumn("perplexity", perplexity.from_term(F.col("term"), F.col("frequency")))
    best = best.withColumn("priority_score", F.round(stats.priority_score(F.col("score"), F.col("perplexity"), F.lit(None).cast("double")), 9))
    return best.withColumn("confidence", rank.three_way(F.col("perplexity")))


def evaluated_by_provider(docs: DataFrame, provider: Provider, config: EngineConfig | None = None, most: int = 100, completed: int = 20) -> DataFrame:
    """Entry C with a model: as :func:`evaluated_terms`, with the perplexity that the provider's log probabilities or, where
    these give none, its judgements give a term (50 where all calls fail), and for the ``completed`` best of a document how
    surely the model completes the term; 0.1 for the others.

    What a model says of a term doesn't depend on the document, so each of the distinct terms is asked about once.
    """
    best = cut(statistically_best(docs, config or EngineConfig(), most))
    said = cut(passes.term_perplexity(best.select("term").distinct(), provider))
    sure = cut(passes.generation_probability(best.where(F.col("rank") <= completed).select("term").distinct(), provider))
    rows = best.join(said.select("term", "perplexity"), "term", "left").withColumn("perplexity", F.coalesce("perplexity", F.lit(50.0)))
    rows = rows.join(sure.select("term", F.col("probability").alias("__p")), "term", "left")
    rows = rows.withColumn("token_probability", F.when(F.col("rank") <= completed, F.coalesce("__p", F.lit(0.1))).otherwise(0.1)).drop("__p")
    rows = rows.withColumn("priority_score", F.round(stats.priority_score(F.col("score"), F.col("perplexity"), F.col("token_probability")), 9))
    return rows.withColumn("confidence", rank.three_way(F.col("perplexity")))


def run_statistics(evaluated: DataFrame) -> DataFrame:
    """Counts of the classes and the shares approved without and with review; 0 where there is nothing."""
    counted = evaluated.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("confidence") == c).alias(c) for c in ("high", "medium", "low")])
    share = lambda c: F.coalesce(F.try_divide(c, F.col("total")), F.lit(0.0))
    return counted.withColumn("auto_approved_ratio", share(F.col("high"))).withColumn("manual_review_ratio", share(F.col("medium") + F.col("low")))


def dictionary_rows(terms: DataFrame) -> DataFrame:
    """Scored terms as dictionary rows, one a headword."""
    rows = terms.groupBy("term").agg(F.sum("frequency").alias("n"), F.max("score").alias("confidence"), F.array_sort(F.collect_set(F.col("doc_id").cast("string"))).alias("source_docs"))
    empty = F.array().cast("array<string>")
    return rows.select(F.col("term").alias("headword"), empty.alias("synonyms"), F.lit("").alias("definition"), F.lit(None).cast("string").alias("category"), "confidence", "source_docs", F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"))

