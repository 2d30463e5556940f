"""Passes over a provider: prompts as columns, replies as columns, and what is read from them.

Every pass returns a plain DataFrame. Replies are paid for: a pass writes those that it uses twice itself, and a ``Stored``
provider keeps all replies in a table that passes and runs share. A failed batch is asked again row by row; what fails
then leaves an error and the values that stand for one.
"""

from __future__ import annotations

from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..sources.provider import Provider, complete, embed, generate, stepped
from ..sources.shared import cut
from . import perplexity, rank, vectors
from .contexts import masked_sentences
from .dictionary import merge_headwords
from .groups import fields, per_key

#: What an extraction replies with.
TERMS = "struct<terms:array<struct<headword:string,synonyms:array<string>,definition:string,category:string>>>"
CANDIDATES = "struct<candidates:array<struct<term:string,importance:int>>>"


def prompt(head: str, *parts: Column) -> Column:
    return F.concat(F.lit(head + "\n"), F.concat_ws("\n", *parts))


EXTRACT = 'List the technical terms of the text as JSON {"terms": [{"headword", "synonyms", "definition", "category"}]}.'
CONSOLIDATE = 'Merge what means the same and reply with JSON {"terms": [...]} alike.'
VALIDATE = "Is this a technical term? Reply YES | definition or NO | reason."
CHOOSE = 'List up to 20 candidate terms with an importance from 1 to 10 as JSON {"candidates": [{"term", "importance"}]}.'
DEFINE = "Define the term by its contexts."
CONTEXT_FREE = "Define the term without any context. Say so if you don't know it."
CONTINUE = "Continue the text."
CHOICE = "How special is the term? Reply A (general), B, C or D (very special)."
COMPLETE = "Complete the term."


def _stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def extract_terms(chunks: DataFrame, provider: Provider, id_col: str = "doc_id") -> DataFrame:
    """(id, chunk_id, headword, synonyms, definition, category, ord) from chunks (id, chunk_id, chunk), each sent whole;
    headwords of two or more characters as they come. What a reply says is stripped, blank synonyms and headwords go; a
    reply that is no such JSON gives no term."""
    asked = chunks.withColumn("prompt", prompt(EXTRACT, F.col("chunk")))
    got = complete(asked.select(id_col, "chunk_id", "prompt"), provider).withColumn("r", F.from_json("reply", TERMS))
    terms = got.select(id_col, "chunk_id", F.posexplode("r.terms").alias("ord", "t")).select(id_col, "chunk_id", "ord", "t.*")
    kept = terms.where((F.length("headword") >= 2) & (_stripped(F.col("headword")) != "") & F.col("definition").isNotNull())
    synonyms = F.filter(F.transform(F.coalesce("synonyms", F.array().cast("array<string>")), _stripped), lambda x: x != "")
    return kept.select(id_col, "chunk_id", _stripped(F.col("headword")).alias("headword"), synonyms.alias("synonyms"), _stripped(F.col("definition")).alias("definition"), _stripped(F.col("category")).alias("category"), "ord")


def merge_extracted(terms: DataFrame, most: int = 30, id_col: str = "doc_id") -> DataFrame:
    """One row a term of a document: the longest definition (the first of equals), the best score, the ``most`` best."""
    longest = F.max_by("definition", F.struct(F.length(F.coalesce("definition", F.lit(""))), -F.col("ord")))
    merged = terms.groupBy(id_col, "term").agg(longest.alias("definition"), F.max("score").alias("score"))
    return rank.top_per(merged, most, id_col)


def consolidate(headwords: DataFrame, provider: Provider, batch: int = 30) -> DataFrame:
    """(headword, synonyms, definition, category) after the merge by equal headwords and one call for each ``batch`` of
    them; where a reply can't be read its batch stays as it was. Batches are dealt by a hash of the headword."""
    merged = merge_headwords(headwords).select("key", "headword", "synonyms", "definition", "category")
    n = F.ceil(F.count(F.lit(1)) / batch).cast("int").alias("__n")
    dealt = merged.join(F.broadcast(merged.agg(n))).withColumn("__b", F.pmod(F.xxhash64("key"), F.greatest("__n", F.lit(1))).cast("int"))
    item = F.struct("key", "headword", "synonyms", "definition", "category")
    rows = dealt.groupBy("__b").agg(F.array_sort(F.collect_list(item)).alias("items"))
    asked = rows.withColumn("prompt", prompt(CONSOLIDATE, F.to_json(F.struct(F.transform("items", lambda x: x.dropFields("key")).alias("terms")))))
    got = complete(asked, provider).withColumn("r", F.from_json("reply", TERMS))
    plain = F.transform("items", lambda x: x.dropFields("key"))
    said = F.transform("r.terms", lambda x: F.struct(x["headword"].alias("headword"), F.coalesce(x["synonyms"], F.array().cast("array<string>")).alias("synonyms"), x["definition"].alias("definition"), x["category"].alias("category")))
    return got.select(F.inline(F.when(F.size(F.coalesce("r.terms", F.array().cast("array<struct<headword:string,synonyms:array<string>,definition:string,category:string>>"))) > 0, said).otherwise(plain)))


def with_sources(terms: DataFrame, sources: DataFrame) -> DataFrame:
    """Provenance of merged headwords, looked up by headword in any case from (headword, source); none is an empty list."""
    known = sources.groupBy(F.lower("headword").alias("__k")).agg(F.array_sort(F.collect_set("source")).alias("source_docs"))
    joined = terms.join(known, F.lower("headword") == F.col("__k"), "left").drop("__k")
    return joined.withColumn("source_docs", F.coalesce("source_docs", F.array().cast("array<string>")))


def validate(terms: DataFrame, provider: Provider) -> DataFrame:
    """``terms`` (term, score, ...) with ``kept``, ``definition`` and ``reason``: a yes keeps, a no or anything else drops; a
    filtered reply keeps by its score, any other error always."""
    got = complete(terms.withColumn("prompt", prompt(VALIDATE, F.col("term"))), provider)
    yes, rest = text.verdict(F.col("reply"))
    kept = perplexity.kept_verdict(F.col("reply"), F.col("score"), F.col("error"))
    out = got.withColumn("kept", kept).withColumn("definition", F.when(F.col("kept") & yes, rest)).withColumn("reason", F.when(~F.col("kept"), F.when(~F.coalesce(yes, F.lit(True)), rest).otherwise(F.lit("no verdict"))))
    return out.drop("prompt", "reply", "error")


def chosen(chunks: DataFrame, provider: Provider, id_col: str = "doc_id") -> DataFrame:
    """(id, term, importance): candidates of every chunk with the greatest importance of each, from 1 to 10."""
    asked = chunks.select(id_col, prompt(CHOOSE, F.col("chunk")).alias("prompt"))
    got = complete(asked, provider).select(id_col, F.explode(F.from_json("reply", CANDIDATES)["candidates"]).alias("c"))
    return got.select(id_col, "c.*").where(F.col("importance").between(1, 10)).groupBy(id_col, "term").agg(F.max("importance").alias("importance"))


def defined(best: DataFrame, contexts: DataFrame, provider: Provider, id_col: str = "doc_id") -> DataFrame:
    """(id, term, importance, definition): candidates (id, term, importance) defined by their contexts (id, term, context)."""
    joined = contexts.groupBy(id_col, "term").agg(F.array_join(F.array_sort(F.collect_list("context")), "\n").alias("contexts"))
    rows = best.join(joined, [id_col, "term"], "left").withColumn("prompt", prompt(DEFINE, F.col("term"), F.coalesce("contexts", F.lit(""))))
    return complete(rows, provider).select(id_col, "term", "importance", F.col("reply").alias("definition"))


def two_stage(chunks: DataFrame, contexts: DataFrame, provider: Provider, id_col: str = "doc_id") -> DataFrame:
    """(id, term, importance, definition): candidates of every chunk, then a definition of each by its contexts."""
    return defined(chosen(chunks, provider, id_col), contexts, provider, id_col)


def context_free(terms: DataFrame, provider: Provider) -> DataFrame:
    """``terms`` (term, ...) with ``context_free_definition`` and ``error``."""
    asked = terms.withColumn("prompt", prompt(CONTEXT_FREE, F.col("term")))
    return complete(asked, provider, size=1).withColumnRenamed("reply", "context_free_definition").drop("prompt")


def similarity_rows(terms: DataFrame, provider: Provider) -> DataFrame:
    """Rows (term, definition, context_free_definition, error) with ``similarity`` of the two definitions, -1 for an error,
    and ``is_unknown`` by the words of doubt."""
    one = embed(terms, provider, "definition").withColumnRenamed("embedding", "__a").withColumnRenamed("error", "__e") if "error" not in terms.columns else embed(terms.withColumnRenamed("error", "__e"), provider, "definition").withColumnRenamed("embedding", "__a").drop("error")
    two = embed(one, provider, "context_free_definition")
    bad = F.col("__e").isNotNull() | F.col("error").isNotNull() | F.col("__a").isNull() | F.col("embedding").isNull()
    doubt = F.coalesce(text.uncertain_words(F.col("context_free_definition")) > 0, F.lit(False))
    value = F.when(bad, F.lit(-1.0)).otherwise(vectors.cosine(F.col("__a"), F.col("embedding")))
    return two.withColumn("similarity", value).withColumn("is_unknown", doubt).withColumn("error", F.coalesce("__e", "error")).drop("__a", "__e", "embedding")


def unknown_terms(rows: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Evaluated rows of :func:`similarity_rows` with the decision: words of doubt first, then the similarity."""
    known = F.when(F.col("similarity") >= 0, F.col("similarity"))
    found = perplexity.unknown(F.col("context_free_definition"), F.col("definition"), threshold, known)
    out = rows.withColumns({"__" + k: v for k, v in found.items()}).drop("similarity", "is_unknown")
    return out.withColumnsRenamed({"__similarity": "similarity", "__explicitly_unknown": "explicitly_unknown", "__is_unknown": "is_unknown"})


def document_profile(windows: DataFrame, provider: Provider, *keys: str) -> DataFrame:
    """Windows (keys, chunk) with ``perplexity`` of their tokens, ``avg_logprob`` and ``is_hotspot`` within the keys."""
    got = generate(windows.withColumnRenamed("chunk", "prompt"), provider)
    lp = F.transform("tokens", lambda x: x["logprob"])
    scored = got.withColumn("perplexity", perplexity.perplexity(lp)).withColumn("avg_logprob", -F.log("perplexity"))
    return rank.hotspots(scored, *keys).drop("prompt", "tokens", "error")


def direct_generation(tokens: Column, term: Column) -> Column:
    """Perplexity of a term in a continuation: of the tokens that share a letter with it, if the continuation holds the
    term or is part of it; else of the first candidate that does."""
    said = F.array_join(F.transform(tokens, lambda x: x["token"]), "")
    letters = F.split(term, "")
    near = F.filter(tokens, lambda x: F.exists(letters, lambda c: (c != "") & F.contains(x["token"], c)))
    tops = F.flatten(F.transform(tokens, lambda x: x["top"]))
    hit = F.get(F.filter(tops, lambda c: F.contains(c["token"], term) | F.contains(term, c["token"])), F.lit(0))
    own = perplexity.perplexity(F.transform(near, lambda x: x["logprob"]))
    return F.coalesce(F.when(F.contains(said, term) | F.contains(term, said), own), F.exp(-hit["logprob"]))


def cumulative_logprob(tokens: Column, term: Column, any_case: bool = False) -> Column:
    """Log probability of the token with which the running text first holds the term, else of the first candidate that does."""
    fold = F.lower if any_case else (lambda c: c)
    running = F.transform(tokens, lambda x, i: F.struct(F.array_join(F.transform(F.slice(tokens, F.lit(1), i + 1), lambda y: y["token"]), "").alias("s"), x["logprob"].alias("lp")))
    first = F.get(F.filter(running, lambda r: F.contains(fold(r["s"]), fold(term))), F.lit(0))["lp"]
    if any_case:
        return first
    tops = F.flatten(F.transform(tokens, lambda x: x["top"]))
    return F.coalesce(first, F.get(F.filter(tops, lambda c: F.contains(c["token"], term)), F.lit(0))["logprob"])


def scaled_perplexity(logprob: Column, most: float = 95.0) -> Column:
    """Ten times the perplexity of a log probability, within 5 and ``most``; 50 for none."""
    return F.when(logprob.isNotNull(), F.least(F.lit(most), F.greatest(F.lit(5.0), F.exp(-logprob) * 10))).otherwise(F.lit(50.0))


def forced_perplexity(tokens: Column, n_ids: Column) -> Column:
    """Of as many tokens of a continuation as the term has ids, the first of which was favoured."""
    lp = F.slice(F.transform(tokens, lambda x: x["logprob"]), F.lit(1), n_ids)
    return F.when((F.size(lp) > 0) & (n_ids > 0), scaled_perplexity(-F.log(perplexity.perplexity(lp)), 100.0)).otherwise(F.lit(50.0))


def input_perplexity(places: DataFrame, provider: Provider, *keys: str) -> DataFrame:
    """(keys, term, perplexity, confidence, samples) from (keys, term, ord, prefix): how well a model foresees a term.

    Up to three places with ten characters or more before them count; each gives the perplexity of a continuation and
    one of up to five steps of a token each. Terms without a place have 100, without a sample 50.
    """
    few = places.where((F.col("ord").isNull()) | ((F.col("ord") < 3) & (F.length("prefix") >= 10)))
    asked = few.where("ord IS NOT NULL").withColumn("context", F.substring("prefix", -200, 200))
    # written, as both ways use the replies
    replied = cut(generate(asked.withColumn("prompt", F.col("context")), provider))
    direct = replied.withColumn("p", direct_generation(F.col("tokens"), F.col("term")))
    steps = stepwise(replied, provider)
    samples = direct.select(*keys, "term", "p").unionAll(steps.select(*keys, "term", "p"))
    per = samples.groupBy(*keys, "term").agg(F.avg("p").alias("p"), F.count("p").alias("samples"))
    every = places.groupBy(*keys, "term").agg(F.count("ord").alias("n"))
    out = every.join(per, [*keys, "term"], "left")
    value = F.when(F.col("n") == 0, F.lit(100.0)).otherwise(F.coalesce("p", F.lit(50.0)))
    label = F.when(F.col("n") == 0, "not_found").when(F.col("p").isNull(), "medium").otherwise(rank.short_steps(F.col("p")))
    return out.select(*keys, "term", value.alias("perplexity"), label.alias("confidence"), F.coalesce("samples", F.lit(0).cast("long")).alias("samples"))


def stepwise(asked: DataFrame, provider: Provider, most: int = 5) -> DataFrame:
    """Rows (context, term, ...) with ``p``: the perplexity of up to five tokens foreseen one by one; a token that is
    neither the term's next letters nor a candidate for them counts as -5. A column ``tokens`` has the replies to the
    contexts, if they were asked for before."""
    rows = asked if "tokens" in asked.columns else generate(asked.withColumn("prompt", F.col("context")), provider).drop("prompt", "error")
    return stepped(rows, provider, most).withColumn("p", perplexity.perplexity(F.col("lps"))).drop("lps", "tokens", "prompt", "error")


TEMPLATES = fixed.PERPLEXITY_TEMPLATES


def template_perplexity(terms: DataFrame, provider: Provider, templates: tuple[str, ...] = TEMPLATES) -> DataFrame:
    """``terms`` with ``perplexity``: from the mean log probability of the term behind the beginnings of three templates,
    within 5 and 100; null where none gives one."""
    heads = sorted({t.split("{}")[0] for t in templates})
    # the beginnings don't hold the term: one call each, one row of them all goes to every term
    said = generate(terms.sparkSession.createDataFrame([(h,) for h in heads], "prompt string").coalesce(1), provider)
    said = cut(said.agg(F.collect_list(F.struct("prompt", "tokens")).alias("__said")))
    got = terms.select("term").distinct().join(F.broadcast(said)).select("term", F.inline("__said"))
    got = got.withColumn("lp", cumulative_logprob(F.col("tokens"), F.col("term")))
    weights = {t.split("{}")[0]: sum(x.split("{}")[0] == t.split("{}")[0] for x in templates) for t in templates}
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("prompt")]
    per = got.where("lp IS NOT NULL").groupBy("term").agg((F.sum(F.col("lp") * weight) / F.sum(weight)).alias("lp"))
    p = F.least(F.lit(100.0), F.greatest(F.lit(5.0), F.exp(-F.col("lp"))))
    return terms.join(per.select("term", p.alias("perplexity")), "term", "left")


def sentence_perplexity(sentences: DataFrame, provider: Provider, *keys: str) -> DataFrame:
    """(keys, term, perplexity): of a term behind what stands before it in up to two sentences (keys, term, ord, sentence)."""
    few = sentences.where("ord < 2").withColumn("prompt", F.expr("split_part(sentence, term, 1)"))
    got = generate(few, provider).withColumn("p", scaled_perplexity(cumulative_logprob(F.col("tokens"), F.col("term"), any_case=True)))
    return got.groupBy(*keys, "term").agg(F.avg("p").alias("perplexity"))


def choice_perplexity(terms: DataFrame, provider: Provider) -> DataFrame:
    """``terms`` with ``perplexity`` by a choice from A to D; 25 for anything else."""
    got = complete(terms.withColumn("prompt", prompt(CHOICE, F.col("term"))), provider)
    return got.withColumn("perplexity", F.coalesce(text.choice_perplexity(F.col("reply")), F.lit(25.0))).drop("prompt", "reply", "error")


def partial_completion(terms: DataFrame, provider: Provider, tries: int = 3, strict: bool = False) -> DataFrame:
    """``terms`` with ``partial``: how often a term is completed from a third, a half and two thirds of it, over some tries;
    0.2 for terms under four characters. ``strict``: not from one character, and with three more at most."""
    places = F.transform(F.array_distinct("__p"), lambda x: F.struct(x.alias("at"), F.size(F.filter("__p", lambda y: y == x)).alias("weight")))  # equal places are one prompt
    parts = terms.where(F.length("term") >= 4).select("term", perplexity.split_points(F.col("term")).alias("__p")).select("term", F.inline(places))
    tried = (parts.where("at > 1") if strict else parts).withColumn("try", F.explode(F.sequence(F.lit(1), F.lit(tries))))
    head = F.substring("term", F.lit(1), F.col("at"))
    got = complete(tried.withColumn("prompt", prompt(COMPLETE, head, F.col("try").cast("string"))), provider)
    said = F.trim("reply")
    fits = F.contains(said, F.col("term")) & ((F.length(said) <= F.length("term") + 3) if strict else F.lit(True))
    hit = F.coalesce(fits, F.lit(False))
    per = got.groupBy("term").agg((F.sum(hit.cast("double") * F.col("weight")) / F.sum("weight")).alias("partial"))
    return terms.join(per, "term", "left").withColumn("partial", F.when(F.length("term") < 4, F.lit(0.2)).otherwise(F.col("partial")))


def _asked(terms: DataFrame, provider: Provider, head: str, parts: list[Column], out: str, key: str = "term") -> DataFrame:
    """(term, out): the replies to a prompt for each of the parts, in their order, none for failed calls."""
    rows = terms.select(key, F.posexplode(F.array(*parts)).alias("part", "said")).withColumn("prompt", prompt(head, F.col("said")))
    got = complete(rows, provider).where("reply IS NOT NULL")
    return got.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "reply"))), lambda x: x["reply"]).alias(out))


BRIEF = "Define the term in at most 30 characters, or say that you don't know it."
DIFFICULTY = "How hard is the term to understand, from 1 to 10? Reply with the number."
NATURAL = "How natural is the sentence, from 1 to 10? Reply with the number."
GENERALITY = "How general is the term, from 1 to 10? Reply with the number."
FILL = "Which term stands for [MASK]?"
SENTENCES = fixed.NATURAL_SENTENCES


def fallback_perplexity(terms: DataFrame, provider: Provider) -> DataFrame:
    """``terms`` (distinct) with ``perplexity``: how far three definitions agree, how hard the term is said to be and how
    natural three sentences with it are, weighed; within 5 and 100."""
    t, none = F.col("term"), F.array().cast("array<string>")
    out = terms.select("term").distinct()
    out = out.join(_asked(out, provider, BRIEF, [F.concat(t, F.lit(f"\n{k}")) for k in (1, 2, 3)], "__d"), "term", "left")
    out = out.join(_asked(out, provider, DIFFICULTY, [t], "__c"), "term", "left")
    out = out.join(_asked(out, provider, NATURAL, [F.replace(F.lit(s), F.lit("{}"), t) for s in SENTENCES], "__n"), "term", "left")
    scores = F.filter(F.transform(F.coalesce("__n", none), text.first_integer), lambda x: x.isNotNull())
    value = perplexity.weighted(perplexity.consistency(t, F.coalesce("__d", none)), perplexity.comprehension(F.get("__c", F.lit(0))), perplexity.naturalness(scores))
    return terms.join(out.select("term", value.alias("perplexity")), "term", "left")


def term_perplexity(terms: DataFrame, provider: Provider, templates: tuple[str, ...] = TEMPLATES) -> DataFrame:
    """``terms`` with ``perplexity`` from log probabilities, and from the fallback where these give none."""
    first = cut(template_perplexity(terms, provider, templates))  # used twice, paid for once
    rest = fallback_perplexity(first.where("perplexity IS NULL").drop("perplexity"), provider)
    return first.where("perplexity IS NOT NULL").unionByName(rest)


def generality(terms: DataFrame, provider: Provider) -> DataFrame:
    """``terms`` with ``generality`` from a score of ten, at most 1; 0.4 for none."""
    said = _asked(terms.select("term").distinct(), provider, GENERALITY, [F.col("term")], "__g")
    out = terms.join(said, "term", "left")
    return out.withColumn("generality", F.least(F.lit(1.0), perplexity.generality(F.get("__g", F.lit(0))))).drop("__g")


def generation_probability(terms: DataFrame, provider: Provider) -> DataFrame:
    """``terms`` with ``probability``: strict completion and generality, weighed; 0.1 under three characters."""
    rows = generality(partial_completion(terms, provider, strict=True), provider)
    return rows.withColumn("probability", perplexity.generation_probability(F.col("term"), F.col("partial"), F.col("generality"))).drop("partial", "generality")


def context_probability(rows: DataFrame, provider: Provider) -> DataFrame:
    """Rows (term, context, ...) with ``context_probability``: how like the term what is said to stand in its place is; null
    without a context, 0.3 for a failed call."""
    asked = rows.withColumn("prompt", prompt(FILL, F.replace("context", F.col("term"), F.lit("[MASK]"))))
    got = complete(asked, provider)
    value = F.when(F.col("error").isNotNull(), F.lit(0.3)).otherwise(text.string_similarity(F.col("term"), F.trim("reply")))
    return got.withColumn("context_probability", F.when(F.col("context").isNotNull(), value)).drop("prompt", "reply", "error")


def precise_probability(rows: DataFrame, provider: Provider) -> DataFrame:
    """Rows (term, context) with ``probability`` by completion, context and generality."""
    found = context_probability(generality(partial_completion(rows, provider), provider), provider)
    value = perplexity.token_probability(F.col("partial"), F.col("context_probability"), F.col("generality"))
    return found.withColumn("probability", value).drop("partial", "generality", "context_probability")


def mask_samples(sentences: DataFrame, provider: Provider, *keys: str) -> DataFrame:
    """(keys, term, perplexity) from rows (keys, term, sentences): up to two masked sentences each, by the probability of
    the first token or candidate that holds the term; none where there is no such."""
    rows = sentences.select(*keys, "term", F.explode(masked_sentences(F.col("sentences"), F.col("term"))).alias("prompt"))
    own = lambda x: F.array(F.struct(x["token"].alias("token"), x["logprob"].alias("logprob")))
    said = F.flatten(F.transform("tokens", lambda x: F.concat(own(x), x["top"])))
    hit = F.get(F.filter(said, lambda c: F.contains(c["token"], F.col("term"))), F.lit(0))["logprob"]
    return generate(rows, provider).select(*keys, "term", perplexity.mask_perplexity(F.exp(hit)).alias("perplexity")).where("perplexity IS NOT NULL")


def held_sentences(docs: DataFrame, terms: DataFrame, marks: str = ".!?\n", most: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, sentences): the first ``most`` sentences of a text that hold each of its document's terms (id, term), for
    terms that have any. Texts and terms of a document meet in one task; sentences are not copied to each term."""
    none = F.lit(None).cast("string")
    own = terms.where(F.col(id_col).isNotNull()).select(id_col, "term", none.alias("s"))
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, none.alias("term"), F.col(text_col).alias("s"))

    def work(table: pa.Table) -> pa.Table:
        listed = [t for t in table.column("term").to_pylist() if t is not None]
        found = [(t, own) for sentences in table.column("__all").to_pylist() if sentences for t in listed if (own := list(islice((s for s in sentences if t in s), most)))]
        names, held = ([x[k] for x in found] for k in (0, 1))
        ids = table.column(id_col).take(pa.array([0] * len(found), pa.int64()))
        return pa.table({id_col: ids, "term": pa.array(names, pa.string()), "sentences": pa.array(held, pa.list_(pa.string()))})

    after = [F.col("term"), text.sentences_of(F.col("s"), marks).alias("__all")]
    return per_key(own.unionAll(texts), id_col, work, f"{fields(docs.select(id_col))}, term string, sentences array<string>", after, spread=True)


def evaluate_generic(docs: DataFrame, terms: DataFrame, provider: Provider, marks: str = ".!?\n") -> DataFrame:
    """(doc_id, term, frequency, perplexity, confidence) of documents' terms (doc_id, term, frequency): samples from
    sentences, from masks, and a direct choice where there are fewer than two."""
    held = held_sentences(docs, terms, marks)
    each = held.select("doc_id", "term", F.posexplode("sentences").alias("ord", "sentence"))
    said = sentence_perplexity(each, provider, "doc_id", "ord").select("doc_id", "term", "perplexity")
    samples = cut(said.unionAll(mask_samples(held, provider, "doc_id")))  # used twice, paid for once
    few = needing_direct(samples, terms, "doc_id")
    direct = choice_perplexity(few.select("doc_id", "term"), provider).select("doc_id", "term", "perplexity")
    return generic_evaluation(samples.unionAll(direct), terms, "doc_id")


def generic_evaluation(samples: DataFrame, terms: DataFrame, *keys: str) -> DataFrame:
    """``terms`` (keys, term, frequency) with ``perplexity`` and ``confidence``: the median of the sane samples (keys, term,
    perplexity) of all methods; by the term's looks, with wider bounds, where there is none."""
    per = samples.groupBy(*keys, "term").agg(perplexity.robust_median(F.collect_list("perplexity")).alias("__m"))
    out = terms.join(per, [*keys, "term"], "left")
    looks = perplexity.from_term(F.col("term"), F.col("frequency"))
    label = F.when(F.col("__m").isNotNull(), rank.inverted(F.col("__m"))).otherwise(rank.inverted(looks, 30.0, 20.0))
    return out.withColumn("confidence", label).withColumn("perplexity", F.coalesce("__m", looks)).drop("__m")


def needing_direct(samples: DataFrame, terms: DataFrame, *keys: str, fewest: int = 2) -> DataFrame:
    """Terms with fewer samples than two: those that get the direct choice too."""
    per = samples.groupBy(*keys, "term").agg(F.count("perplexity").alias("__n"))
    return terms.join(per, [*keys, "term"], "left").where(F.coalesce("__n", F.lit(0)) < fewest).drop("__n")

