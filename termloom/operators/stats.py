"""Statistical scores: TF-IDF, C-value, NC-value, blends, general-corpus frequency, summaries."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LATIN, LanguageProfile
from ..functions import fixed, text
from .candidates import statistical_candidates, with_containers
from .contexts import occurrences
from .groups import counted, fields, per_key


def chunk_tfidf(counts: DataFrame, sizes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, term, tfidf) from counts (id, chunk_id, term, tf) and the number of chunks (id, n_chunks).

    idf = ln((N + 1) / (df + 1)) + 1 and the score is the largest (1 + ln tf) * idf, so only the largest tf is needed.
    """
    per = counts.where("tf > 0").groupBy(id_col, "term").agg(F.max("tf").alias("tf"), F.count(F.lit(1)).alias("df"))
    return per.join(sizes, id_col).select(id_col, "term", tfidf().alias("tfidf"))


def tfidf() -> Column:
    """The score from the columns tf, df and n_chunks."""
    return (1 + F.log("tf")) * (F.log((F.col("n_chunks") + 1) / (F.col("df") + 1)) + 1)


def _in_chunks(terms: list[str], texts: list[str], cut: Callable[[str], list[str]]) -> dict[str, pa.Array]:
    chunks = [c for s in texts for c in cut(s)]
    tf, df = [0] * len(terms), [0] * len(terms)
    for _, j, n in counted(terms, chunks):
        tf[j], df[j] = max(tf[j], n), df[j] + 1
    return {"tf": pa.array(tf, pa.int64()), "df": pa.array(df, pa.int64()), "n_chunks": pa.array([len(chunks)] * len(terms), pa.int64())}


def candidate_scores(docs: DataFrame, cut: Callable[[str], list[str]], profile: LanguageProfile = LATIN) -> DataFrame:
    """(doc_id, term, frequency, tfidf, c_value) of :func:`candidates.statistical_candidates`, as :func:`c_value` and
    :func:`substring_tfidf` make them: terms are found, compared and searched for in one task of their document."""
    found = statistical_candidates(docs, profile, measured=lambda terms, texts: _in_chunks(terms, texts, cut), more="tf long, df long, n_chunks long")
    return c_value(found).withColumn("tfidf", F.when(F.col("tf") > 0, tfidf()).otherwise(0.0)).drop("tf", "df", "n_chunks")


def substring_tfidf(terms: DataFrame, docs: DataFrame, cut: Callable[[str], list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``terms`` (distinct in a document) with ``tfidf`` from their occurrences as substrings of the chunks that ``cut``
    makes of the document's text; 0 for one that occurs in none.

    A document's text and terms meet in one task, where the text is cut and searched once for all terms.
    """
    others = [c for c in terms.columns if c != id_col]
    rows = terms.select(id_col, *others, F.lit(None).cast("string").alias("__text")).unionByName(docs.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("__text")), allowMissingColumns=True)

    def work(table: pa.Table) -> pa.Table:
        is_term = table.column("__text").is_null()
        own = table.filter(is_term).drop_columns("__text")
        for name, values in _in_chunks(own.column("term").to_pylist(), table.column("__text").drop_null().to_pylist(), cut).items():
            own = own.append_column(name, values)
        return own

    found = per_key(rows, id_col, work, f"{fields(terms.select(id_col, *others))}, tf long, df long, n_chunks long", spread=True)
    return found.select(*terms.columns, F.when(F.col("tf") > 0, tfidf()).otherwise(0.0).alias("tfidf"))


def substring_counts(chunks: DataFrame, terms: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, chunk_id, term, tf): occurrences that don't overlap of each of a document's terms in each of its chunks.

    A document's terms and chunks (id, chunk_id, chunk) meet in one task, its terms in one automaton.
    """
    none = F.lit(None)
    rows = terms.select(id_col, none.cast("int").alias("chunk_id"), F.col("term").alias("s")).unionAll(chunks.select(id_col, F.col("chunk_id").cast("int"), F.col("chunk").alias("s")))

    def work(table: pa.Table) -> pa.Table:
        is_term = table.column("chunk_id").is_null()
        words, texts = table.filter(is_term), table.filter(pc.invert(is_term))
        found = list(counted(words.column("s").to_pylist(), texts.column("s").to_pylist()))
        at, term, n = (pa.array([x[k] for x in found], pa.int64()) for k in range(3))
        own = texts.take(at)
        return pa.table({id_col: own.column(id_col), "chunk_id": own.column("chunk_id"), "term": words.column("s").take(term), "tf": n})

    return per_key(rows, id_col, work, f"{id_col} {dict(rows.dtypes)[id_col]}, chunk_id int, term string, tf long")


def word_counts(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``terms`` with ``frequency``: how often the term is a lower-cased run of word characters; 0 for one that is none."""
    words = docs.select(id_col, F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("term"))
    counts = words.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("frequency"))
    return terms.select(id_col, "term").join(counts, [id_col, "term"], "left").withColumn("frequency", F.coalesce("frequency", F.lit(0).cast("long")))


def tfidf_l2(counts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Single-document TF-IDF: counts over their Euclidean norm in the document; :func:`word_counts` gives the counts."""
    norm = F.sqrt(F.sum(F.col("frequency") * F.col("frequency")).over(Window.partitionBy(id_col)))
    return counts.withColumn("tfidf", F.when(norm > 0, F.col("frequency") / norm).otherwise(F.lit(0.0)))


#: Weight of a term's length in each variant of the C-value.
LENGTH_WEIGHT = {1: lambda n: F.log2(n + 1), 2: lambda n: F.log2(n), 3: lambda n: F.log2(F.greatest(F.lit(2), n))}


def c_value(terms: DataFrame, variant: int = 1, id_col: str = "doc_id") -> DataFrame:
    """``terms`` with ``c_value`` = weight(length) * (frequency - mean frequency of containers), not below 0. Terms that
    come with their containers (:func:`candidates.document_terms`) are not compared again."""
    weight = LENGTH_WEIGHT[variant](F.length("term"))
    value = F.greatest(F.lit(0.0), weight * (F.col("frequency") - F.coalesce("__mean", F.lit(0.0))))
    known = terms if "__mean" in terms.columns else with_containers(terms, id_col)
    return known.withColumn("c_value", value).drop("__mean", "__most")


CONTEXT_RUNS = fixed.CONTEXT_RUNS


def context_words(prefix: Column, suffix: Column, runs: str = CONTEXT_RUNS) -> Column:
    """The first three and the last three runs of what stands around an occurrence."""
    words = F.regexp_extract_all(F.concat(prefix, suffix), F.lit(runs), F.lit(0))
    tail = F.when(F.size(words) > 3, F.slice(words, -3, 3)).otherwise(words)
    return F.array_union(F.slice(words, 1, 3), tail)


def term_contexts(documents: DataFrame, terms: DataFrame, window: int = 30, id_col: str = "doc_id") -> DataFrame:
    """(id, term, word): the distinct context words of a term's occurrences, from ``window`` characters on both sides."""
    listed = documents.join(terms.groupBy(id_col).agg(F.collect_list("term").alias("terms")), id_col)
    found = occurrences(listed, window, keys=(id_col,))
    return found.select(id_col, "term", F.explode(context_words(F.col("left"), F.col("right"))).alias("word")).distinct()


def context_weights(documents: DataFrame, terms: DataFrame, window: int = 30, id_col: str = "doc_id") -> DataFrame:
    """(id, term, weight): the mean, over a term's context words, of the number of the document's terms that share the word;
    null for a term without any. The words are those of :func:`term_contexts`, counted where the document is."""
    listed = documents.join(terms.groupBy(id_col).agg(F.collect_list("term").alias("terms")), id_col).select(id_col, "text", "terms")
    runs = re.compile(CONTEXT_RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                row, names, means = [], [], []
                for i, (s, own) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    held: dict[str, set[str]] = {}
                    for t in own or ():
                        found = held.setdefault(t, set())
                        for a, b in text.spans(s or "", t):
                            words = runs.findall(s[max(0, a - window) : a] + s[b : b + window])
                            found.update(words[:3], words[-3:])
                    shared = Counter(w for found in held.values() for w in found)
                    for t, found in held.items():
                        row.append(i)
                        names.append(t)
                        means.append(sum(shared[w] for w in found) / len(found) if found else None)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array(names, pa.string()), pa.array(means, pa.float64())], names=[id_col, "term", "weight"])

    return listed.mapInArrow(run, f"`{id_col}` {dict(listed.dtypes)[id_col]}, term string, weight double")


def mean_weights(contexts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, term, weight) from a table of contexts (id, term, word)."""
    weight = F.count(F.lit(1)).over(Window.partitionBy(id_col, "word"))
    return contexts.withColumn("__w", weight).groupBy(id_col, "term").agg(F.avg("__w").alias("weight"))


def nc_value(scored: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """``nc_value`` = 0.8 C + 0.2 C * mean weight of the context words, C without any; a word's weight is the number of
    the document's terms that share it (:func:`context_weights`, :func:`mean_weights`). Without ``weights``, ``scored`` has
    its own (:func:`around.weighed_terms`)."""
    if weights is None:
        return scored.withColumn("nc_value", F.coalesce(0.8 * F.col("c_value") + 0.2 * F.col("c_value") * F.col("weight"), F.col("c_value"))).drop("weight")
    mean = weights.select(id_col, "term", F.col("weight").alias("__mean"))
    value = F.coalesce(0.8 * F.col("c_value") + 0.2 * F.col("c_value") * F.col("__mean"), F.col("c_value"))
    return scored.join(mean, [id_col, "term"], "left").withColumn("nc_value", value).drop("__mean")


def generic_score(nc: Column, frequency: Column, term: Column, modes: Column) -> Column:
    n = F.length(term)
    length = F.when(n.between(4, 10), 10).when((n > 10) & (n <= 15), 8).when((n >= 2) & (n < 4), 3).otherwise(1)
    return nc * 5 + F.log(frequency + 1) * 3 + length + modes * 5 + F.when(term.rlike("[A-Z0-9]{2,}"), 8).otherwise(0) + F.when(term.rlike("[ア-ヴー]"), 5).otherwise(0)


def min_max(df: DataFrame, col: str, out: str, *keys: str) -> DataFrame:
    """Scaled to 0..1 within the keys, or over the whole table by one aggregate row; 0.5 where all are equal."""
    w = Window.partitionBy(*keys)
    low, high = (F.min(col).over(w), F.max(col).over(w)) if keys else (F.col("__low"), F.col("__high"))
    if not keys:
        df = df.join(F.broadcast(df.agg(F.min(col).alias("__low"), F.max(col).alias("__high"))))
    return df.withColumn(out, F.when(high == low, F.lit(0.5)).otherwise((F.col(col) - low) / (high - low))).drop("__low", "__high")


def base_score(tfidf: Column, c_value: Column) -> Column:
    return 0.3 * tfidf + 0.7 * c_value


def statistical_score(c_value: Column, tfidf: Column, frequency: Column) -> Column:
    return 0.5 * c_value + 30 * tfidf + 0.2 * F.log(frequency + 1)


def priority_score(statistical: Column, perplexity: Column, probability: Column) -> Column:
    p = F.coalesce(perplexity, F.lit(50.0))
    return 0.4 * F.coalesce(statistical, F.lit(0.0)) + 0.4 * (100 - p) + 20 * F.coalesce(probability, F.lit(0.1))


def general_idf(terms: DataFrame, total: int = fixed.TOTAL_DOCS) -> DataFrame:
    """``terms`` with ``idf`` from the general table, else from length, katakana and letters; ``speciality`` and class."""
    table = terms.sparkSession.createDataFrame(list(fixed.DOC_FREQ.items()), "term string, __df long")
    n = F.length("term")
    by_length = F.when(n <= 2, 5000).when(n >= 8, 50).otherwise(500)
    guess = F.when(text.katakana_heavy(F.col("term")), F.least(by_length, F.lit(200))).otherwise(by_length)
    guess = F.when(text.has_alnum(F.col("term")), F.least(guess, F.lit(100))).otherwise(guess)
    out = terms.join(F.broadcast(table), "term", "left")
    out = out.withColumn("idf", F.log(F.lit(float(total + 1)) / (F.coalesce("__df", guess) + 1))).drop("__df")
    out = out.withColumn("speciality", F.least(F.lit(1.0), F.col("idf") / math.log(total + 1)))
    kind = F.when(F.col("speciality") < 0.3, "一般語").when(F.col("speciality") < 0.6, "準専門用語").otherwise("専門用語")
    return out.withColumn("class", kind)


def rounded_idf(scored: DataFrame) -> DataFrame:
    """``idf`` and ``speciality`` with three digits, halves to the even one."""
    return scored.withColumns({c: F.bround(c, 3) for c in ("idf", "speciality")})


def evaluation_summary(rows: DataFrame) -> DataFrame:
    """Of evaluated terms (similarity, is_unknown, explicitly_unknown, error): unknown ones, of these by words of doubt
    and by similarity alone, known ones and errors."""
    bad, unknown = F.col("error").isNotNull(), F.coalesce("is_unknown", F.lit(False))
    explicit = F.coalesce("explicitly_unknown", F.lit(False))
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~bad & unknown).alias("unknown"),
        F.count_if(~bad & unknown & explicit).alias("explicitly_unknown"),
        F.count_if(~bad & unknown & ~explicit).alias("unknown_by_similarity"),
        F.count_if(~bad & ~unknown).alias("known"),
        F.count_if(bad).alias("errors"),
    )


def term_statistics(terms: DataFrame, file_col: str = "doc_id") -> DataFrame:
    """One row about scored terms; counts of an empty table are 0 and its means null."""
    return terms.agg(
        F.count_distinct(file_col).alias("files"),
        F.count(F.lit(1)).alias("terms"),
        F.count_distinct("term").alias("distinct_terms"),
        F.avg("score").alias("avg_score"),
        F.max("score").alias("max_score"),
        F.min("score").alias("min_score"),
        F.avg("frequency").alias("avg_frequency"),
        F.max("frequency").alias("max_frequency"),
    )


def dictionary_statistics(terms: DataFrame) -> DataFrame:
    return terms.agg(
        F.count(F.lit(1)).alias("terms"),
        F.count_if(F.size("synonyms") > 0).alias("with_synonyms"),
        F.count_if(F.coalesce("definition", F.lit("")) != "").alias("with_definition"),
        F.count_if(F.coalesce("category", F.lit("")) != "").alias("with_category"),
        F.avg(F.size("synonyms")).alias("avg_synonyms"),
    )


def similarity_statistics(rows: DataFrame) -> DataFrame:
    """Of valid similarities of terms that are not explicitly unknown; population deviation."""
    valid = rows.where("similarity >= 0 AND NOT is_unknown")
    return valid.agg(F.count(F.lit(1)).alias("n"), F.avg("similarity").alias("mean"), F.median("similarity").alias("median"), F.stddev_pop("similarity").alias("sigma"), F.min("similarity").alias("lowest"), F.max("similarity").alias("highest"))


def below_thresholds(rows: DataFrame, thresholds: tuple[float, ...] = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8)) -> DataFrame:
    """(threshold, n): valid similarities below each threshold, in one pass."""
    counted = rows.agg(*[F.count_if((F.col("similarity") >= 0) & (F.col("similarity") < t)).alias(f"n{i}") for i, t in enumerate(thresholds)])
    pairs = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"n{i}").alias("n")) for i, t in enumerate(thresholds)])
    return counted.select(F.inline(pairs))
