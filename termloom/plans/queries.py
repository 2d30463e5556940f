"""A query for every operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LATIN, EngineConfig
from ..functions import text
from ..operators import around, candidates, chunkers, contexts, dictionary, graph, perplexity, rank, stats, vectors
from ..sources import readers
from ..sources.shared import cut
from . import extract
from .registry import query


def _r(c, n: int = 6):
    return F.round(c, n)


def _off_tie(c: str):
    """Six digits of a value that was rounded to nine: moved off ties first, on which engines disagree."""
    return F.round(F.col(c) + 2.55e-8, 6)


def _counts(docs: DataFrame) -> DataFrame:
    return candidates.term_counts(docs)


def _targets(docs: DataFrame) -> DataFrame:
    """The terms of a document that get contexts, masks and neighbours: all of the engine's least frequency."""
    return _counts(docs).where(F.col("frequency") >= EngineConfig().min_frequency).select("doc_id", "term")


@query
def term_score_topk(documents):
    out = extract.statistical_terms(documents)
    return out.select("doc_id", "term", "frequency", _r("tfidf").alias("tfidf"), _r("c_value").alias("c_value"), _off_tie("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def term_frequency(documents):
    return _counts(documents)


@query
def term_frequency_min2(documents):
    return _counts(documents).where("frequency >= 2")


@query
def doc_profile(documents):
    f = text.features(F.col("text"))
    return readers.preprocess(documents).select("doc_id", "content_hash", F.col("text_length").cast("long").alias("text_length"), F.octet_length("text").cast("long").alias("n_bytes"), _r(f["technical_density"]).alias("technical_density"), _r(f["mixed_ratio"]).alias("mixed_ratio"), f["abbreviations"].alias("abbreviations"), text.has_alnum(F.col("text")).alias("has_alnum"))


@query
def corpus_idf(documents):
    terms = _counts(documents).groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"))
    return stats.general_idf(terms).select("term", "doc_freq", _r("idf").alias("idf"), _r("speciality").alias("speciality"), "class")


@query
def word_chunks_multi(documents):
    return chunkers.word_blocks(documents).select("doc_id", "size", "chunk_id", "start_word", F.md5("chunk").alias("chunk_md5"))


@query
def word_windows_half(documents):
    return chunkers.word_windows(documents).select("doc_id", "chunk_id", "start_word", "n_words", F.md5("chunk").alias("chunk_md5"))


@query
def tfidf_chunk(documents):
    return extract.window_tfidf(documents, EngineConfig()).select("doc_id", "term", _r("tfidf").alias("tfidf"))


@query
def tfidf_l2(documents):
    return stats.tfidf_l2(stats.word_counts(documents, _counts(documents))).select("doc_id", "term", "frequency", _r("tfidf").alias("tfidf"))


def _cvalue(variant: int) -> None:
    def run(documents):
        return stats.c_value(_counts(documents), variant).select("doc_id", "term", "frequency", _r("c_value").alias("c_value"))

    run.__name__ = f"cvalue_v{variant}"
    query(run)


for _v in (1, 2, 3):
    _cvalue(_v)


@query
def minmax_blend(documents):
    return extract.scored_terms(documents).select("doc_id", "term", _off_tie("score").alias("score"))


@query
def statistical_priority(documents):
    out = extract.evaluated_terms(documents)
    return out.select("doc_id", "term", _off_tie("score").alias("score"), "perplexity", _off_tie("priority_score").alias("priority_score"), "confidence", F.col("rank").cast("long").alias("rank"))


def _nc(documents: DataFrame) -> DataFrame:
    """NC-value of terms of the engine's least frequency, by the words around their occurrences."""
    return stats.nc_value(stats.c_value(around.weighed_terms(documents, EngineConfig().min_frequency), 3))


@query
def nc_value(documents):
    out = _nc(documents)
    return out.select("doc_id", "term", _r("nc_value").alias("nc_value"))


@query
def generic_score(documents):
    scored = _nc(documents)
    return scored.select("doc_id", "term", _r(stats.generic_score(F.col("nc_value"), F.col("frequency"), F.col("term"), F.lit(1))).alias("score"))


@query
def substring_penalty(documents):
    return rank.substring_penalty(_counts(documents).where("frequency >= 2")).select("doc_id", "term", "frequency", "penalty")


@query
def compound_priority(documents):
    return rank.compound_priority(_counts(documents).where("frequency >= 2")).withColumn("factor", _r("factor"))


@query
def elbow_cutoff(documents):
    return rank.elbow_cutoff(extract.scored_terms(documents))


@query
def prune_parts(documents):
    return candidates.prune_parts(_counts(documents)).select("doc_id", "term", "frequency")


@query
def token_ngrams(documents):
    """Runs of tokens that aren't stop words, and their n-grams up to three."""
    found = candidates.tokens(documents)
    runs = candidates.runs(found, ~F.lower("term").isin(*LATIN.stop_words))
    return candidates.compounds(runs, LATIN, 1, 3, (2, 60), stop=LATIN.stop_words)


@query
def compound_prefixes(documents):
    found = candidates.tokens(documents)
    runs = candidates.runs(found, ~F.lower("term").isin(*LATIN.stop_words))
    return candidates.compounds(runs, LATIN, 2, 3, (3, 60), prefixes_only=True, stop=LATIN.stop_words)


@query
def boundary_frequency(documents):
    terms = _counts(documents).where("frequency >= 2").select("doc_id", "term")
    return candidates.boundary_frequency(candidates.tokens(documents), terms, 2, True, " ")


@query
def longest_terms(documents):
    return candidates.longest_first(_counts(documents)).select("doc_id", "term", F.col("rank").cast("long").alias("rank"))


@query
def stopword_anti(documents):
    return candidates.without(_counts(documents), LATIN.stop_words).select("doc_id", "term", "frequency")


def _features(documents: DataFrame) -> DataFrame:
    counts = _counts(documents)
    return counts.withColumn("perplexity", perplexity.from_term(F.col("term"), F.col("frequency")))


@query
def feature_perplexity(documents):
    return _features(documents).select("doc_id", "term", "perplexity", rank.inverted(F.col("perplexity"), 30.0, 20.0).alias("confidence"))


@query
def confidence_static(documents):
    p = F.col("perplexity")
    return _features(documents).select("doc_id", "term", rank.three_way(p).alias("three_way"), rank.by_steps(p, 20.0, 50.0).alias("steps"), rank.inverted(p).alias("inverted"))


@query
def confidence_dynamic(documents):
    return rank.dynamic_confidence(_features(documents)).groupBy("confidence").agg(F.count(F.lit(1)).alias("n"), F.min("perplexity").alias("lowest"), F.max("perplexity").alias("highest"))


@query
def hotspots(documents):
    blocks = chunkers.feature_blocks(documents)
    found = text.features_from({c: F.col(c) for c in ("words", "kata", "latin", "number", "capitals")})
    scored = blocks.withColumn("perplexity", perplexity.from_features(found) + F.col("n_chars") / 100)
    return rank.hotspots(scored, "doc_id", "size").select("doc_id", "size", "chunk_id", _r("perplexity").alias("perplexity"), "is_hotspot")


@query
def cooccur_sentence(documents):
    parts = documents.select("doc_id", F.posexplode(F.split("text", r"[.!?\n]+")).alias("sentence", "s"))
    words = parts.select("doc_id", "sentence", F.explode(F.array_distinct(F.regexp_extract_all("s", F.lit(LATIN.token), F.lit(0)))).alias("term"))
    frequent = _counts(documents).where("frequency >= 2").select("doc_id", "term")
    return graph.sentence_pairs(words.join(frequent, ["doc_id", "term"], "left_semi"), "doc_id")


@query
def cooccur_words(documents):
    words = documents.select("doc_id", F.posexplode(chunkers.words(F.col("text"))).alias("pos", "word"))
    return contexts.around_words(words, _targets(documents)).select("doc_id", "term", "side", "word", "n", F.col("rank").cast("long").alias("rank"))


@query
def knn_graph(embeddings):
    return graph.undirected(vectors.knn(embeddings)).select("src", "dst", _r("weight", 5).alias("weight"))


def _nodes(embeddings: DataFrame) -> DataFrame:
    return graph.personalisation(embeddings.select(F.col("vec_id").alias("id"), (F.col("label") + 1).cast("double").alias("base_score")))


@query
def personalised_weights(embeddings):
    return _nodes(embeddings).select("id", _r("p", 9).alias("p"))


@query
def pagerank_steps(embeddings):
    edges = cut(graph.undirected(vectors.knn(embeddings)))
    return graph.pagerank_steps(_nodes(embeddings).select("id", "p"), edges, 20).select("id", _r("pagerank", 8).alias("pagerank"))


@query
def fuse_scores(embeddings):
    edges = cut(graph.undirected(vectors.knn(embeddings)))
    ranked = graph.pagerank_steps(_nodes(embeddings).select("id", "p"), edges, 20)
    both = ranked.join(_nodes(embeddings).select("id", "base_score"), "id")
    return graph.fuse(both).select("id", _r("score", 5).alias("score"))


def _similarities(embeddings: DataFrame) -> DataFrame:
    """Each vector against the next, as a term's two definitions would be; label 0 is explicitly unknown."""
    other = embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return embeddings.join(other, "vec_id").select("vec_id", "label", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 9).alias("similarity"), (F.col("label") == 0).alias("is_unknown"))


@query
def cosine_pairs(embeddings):
    return _similarities(embeddings).select("vec_id", _r("similarity").alias("similarity"))


@query
def similarity_stats(embeddings):
    s = stats.similarity_statistics(_similarities(embeddings))
    return s.select("n", *[_r(c).alias(c) for c in ("mean", "median", "sigma", "lowest", "highest")])


@query
def threshold_counts(embeddings):
    return stats.below_thresholds(_similarities(embeddings))


@query
def unknown_terms(embeddings):
    rows = _similarities(embeddings).withColumn("said", F.when(F.col("is_unknown"), "それは不明です").otherwise("a definition"))
    found = perplexity.unknown(F.col("said"), F.lit("another"), 0.7, F.col("similarity"))
    return rows.select("vec_id", _r(found["similarity"]).alias("similarity"), found["explicitly_unknown"].alias("explicit"), found["is_unknown"].alias("unknown"), rank.band(found["similarity"]).alias("band"))


def _with_targets(documents: DataFrame) -> DataFrame:
    """(doc_id, text, terms): every document with the list of its targets."""
    return documents.join(_targets(documents).groupBy("doc_id").agg(F.collect_list("term").alias("terms")), "doc_id").select("doc_id", "text", "terms")


@query
def kwic(documents):
    return contexts.occurrences(_with_targets(documents), 50, 3).select("doc_id", "term", "ord", contexts.kwic().alias("context"))


@query
def mask_real(documents):
    return around.real_masks(documents, EngineConfig().min_frequency, 50, ".").withColumn("quality", _r("quality"))


@query
def mask_templates(benchmark):
    terms = benchmark.select(F.explode(F.regexp_extract_all("text", F.lit(LATIN.token), F.lit(0))).alias("term")).distinct()
    return contexts.template_masks(terms)


@query
def occurrence_counts(benchmark):
    """Non-overlapping and overlapping occurrences of two letters of every benchmark item in its own text."""
    t = F.substring("text", 3, 2)
    return benchmark.select("item_id", text.count_apart(F.col("text"), t).alias("apart"), F.size(text.places(F.col("text"), t)).cast("long").alias("overlapping"), F.size(text.places_apart(F.col("text"), t)).cast("long").alias("places"))


def _logprobs(benchmark: DataFrame) -> DataFrame:
    """A response for every item: log probabilities that follow from its tokens' digests."""
    lp = lambda t, i: -(F.conv(F.substring(F.md5(F.concat(t, F.lit("|"), i.cast("string"))), 1, 4), 16, 10).cast("double") / 10000)
    tokens = F.transform(F.regexp_extract_all("text", F.lit(LATIN.token), F.lit(0)), lambda t, i: F.struct(t.alias("token"), lp(t, i).alias("logprob")))
    return benchmark.select("item_id", tokens.alias("tokens"))


@query
def token_perplexity(benchmark):
    rows = _logprobs(benchmark)
    first = F.get("tokens", F.lit(0))["token"]
    return rows.select("item_id", F.size("tokens").cast("long").alias("n_tokens"), _r(perplexity.perplexity(F.transform("tokens", lambda x: x["logprob"]))).alias("perplexity"), _r(perplexity.term_logprob(F.col("tokens"), first)).alias("term_logprob"))


@query
def merge_terms(documents):
    rows = _counts(documents).join(documents.select("doc_id", "source"), "doc_id")
    rows = rows.select("term", "frequency", (F.col("frequency") / 10).alias("score"), F.col("doc_id").alias("ord"), F.concat("source", F.lit(":"), "term").alias("definition"), F.array(F.col("doc_id").cast("string")).alias("contexts"), F.col("source").alias("metadata"))
    out = dictionary.merge_terms(rows)
    return out.select("term", "frequency", _r("score").alias("score"), "definition", F.size("contexts").cast("long").alias("n_contexts"), "metadata")


def _headwords(documents: DataFrame) -> DataFrame:
    counts = _counts(documents).where("frequency >= 2").join(documents.select("doc_id", "lang", "source"), "doc_id")
    return counts.select(F.col("term").alias("headword"), F.array(F.concat(F.lit("x-"), "term"), F.concat("term", F.lit("-"), "lang")).alias("synonyms"), F.concat("lang", F.lit(" word")).alias("definition"), F.when(F.col("lang") != "en", F.col("lang")).alias("category"), F.array("source").alias("source_docs"), F.col("doc_id").alias("ord"))


@query
def merge_headwords(documents):
    out = dictionary.merge_headwords(_headwords(documents))
    return out.select("key", F.array_join("synonyms", ",").alias("synonyms"), "definition", "category", F.array_join("source_docs", ",").alias("source_docs"))


def _dictionary(rows: DataFrame) -> DataFrame:
    """A stored dictionary of all the headwords in ``rows``."""
    merged = dictionary.merge_headwords(rows)
    stamp = F.lit(None).cast("timestamp")
    return merged.select(F.col("key").alias("headword"), "synonyms", "definition", "category", (F.size("synonyms") / 10).alias("confidence"), "source_docs", F.lit(None).cast("array<float>").alias("embedding"), stamp.alias("created_at"), stamp.alias("updated_at"))


def _half(documents: DataFrame, odd: int) -> DataFrame:
    """A dictionary from the documents of even or of odd ids: the two sides of an upsert."""
    return _dictionary(_headwords(documents).where(F.col("ord") % 2 == odd))


@query
def dictionary_upsert(documents):
    out = dictionary.upsert(_half(documents, 0), _half(documents, 1), F.lit("2024-01-01").cast("timestamp"))
    return out.select("headword", F.array_join("synonyms", ",").alias("synonyms"), "definition", "category", _r("confidence").alias("confidence"), F.array_join("source_docs", ",").alias("source_docs"), F.col("updated_at").isNotNull().alias("touched"))


@query
def dictionary_search(documents):
    out = dictionary.search(_dictionary(_headwords(documents)), "TION", 10)
    return out.select("headword", _r("confidence").alias("confidence"))


@query
def dictionary_stats(documents):
    s = stats.dictionary_statistics(_dictionary(_headwords(documents)))
    return s.withColumn("avg_synonyms", _r("avg_synonyms"))


@query
def term_statistics(documents):
    rows = extract.scored_terms(documents).withColumn("score", _off_tie("score"))
    s = stats.term_statistics(rows)
    return s.select("files", "terms", "distinct_terms", *[_r(c, 5).alias(c) for c in ("avg_score", "max_score", "min_score", "avg_frequency")], "max_frequency")


@query
def run_statistics(documents):
    s = extract.run_statistics(extract.evaluated_terms(documents))
    return s.select("total", "high", "medium", "low", _r("auto_approved_ratio").alias("auto_approved_ratio"), _r("manual_review_ratio").alias("manual_review_ratio"))


@query
def review_candidates(documents):
    rows = extract.evaluated_terms(documents).groupBy("term").agg(F.max("priority_score").alias("priority_score"), F.min("confidence").alias("confidence"))
    return rank.review(rows).select("term", _off_tie("priority_score").alias("priority_score"), "confidence")


@query
def graph_semi(documents):
    """Terms of a document that some sentence puts next to another frequent term."""
    parts = documents.select("doc_id", F.posexplode(F.split("text", r"[.!?\n]+")).alias("sentence", "s"))
    words = parts.select("doc_id", "sentence", F.explode(F.array_distinct(F.regexp_extract_all("s", F.lit(LATIN.token), F.lit(0)))).alias("term"))
    frequent = _counts(documents).where("frequency >= 2").select("doc_id", "term")
    inside = words.join(frequent, ["doc_id", "term"], "left_semi")
    shared = inside.groupBy("doc_id", "sentence").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return frequent.join(inside.join(shared, ["doc_id", "sentence"], "left_semi"), ["doc_id", "term"], "left_semi")


@query
def doc_dedup(documents):
    return documents.groupBy(F.left(F.sha2("text", 256), F.lit(16)).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query
def html_text_lines(pages):
    return readers.html_lines(pages).select("page_id", F.md5("text").alias("text_md5"), "n_lines")


@query
def cursor_chunks(documents):
    cut = lambda s: chunkers.char_windows(s, 2000, 200, (". ", "\n", "!", "?", "."))
    return chunkers.chunked(documents, cut).select("doc_id", "chunk_id", F.md5("chunk").alias("chunk_md5"), F.length("chunk").cast("long").alias("n_chars"))


@query
def packed_chunks(documents):
    cut = lambda s: chunkers.pack_sentences(s, 4000, 400, ".!?\n")
    return chunkers.chunked(documents, cut).select("doc_id", "chunk_id", F.md5("chunk").alias("chunk_md5"))


@query
def recursive_chunks(documents):
    cut = lambda s: chunkers.recursive(s, 500, 50, ("\n\n", "\n", ".", ",", " ", ""))
    return chunkers.chunked(documents, cut).select("doc_id", "chunk_id", F.md5("chunk").alias("chunk_md5"))


@query
def sentence_split(documents):
    parts = documents.select("doc_id", F.posexplode(chunkers.sentences(F.col("text"), ".")).alias("ord", "sentence"))
    return parts.select("doc_id", "ord", F.md5("sentence").alias("sentence_md5"))


@query
def kwic_turns(conversations):
    """Every term of every turn, in context and in any case: how many contexts differ, and the first one."""
    terms = F.array_distinct(F.regexp_extract_all("text", F.lit(LATIN.token), F.lit(0)))
    found = contexts.occurrences(conversations.withColumn("terms", terms), 150, 5, any_case=True, keys=("conv_id", "turn"))
    found = found.select("conv_id", "turn", "term", "ord", contexts.kwic_sentence(75, (".", "!", "\n")).alias("context"))
    per = found.groupBy("conv_id", "turn", "term").agg(F.count_distinct("context").alias("n"), F.min_by("context", "ord").alias("context"))
    return per.select("conv_id", "turn", "term", "n", F.md5("context").alias("first_md5"))
