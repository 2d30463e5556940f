"""From raw documents to packed sequences: language ID, line dedup, near-dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import langid, linededup, minhash, mixing, pow2pack
from termloom.llm.queries import MIX, mix_levels, tokenizer_file
from termloom.llm.store import mark, release, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Texts less alike to every language's profile than this are rejected.
LEAST_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the labelled languages, which is their label where they have none. Null texts and
    texts without a letter go; rows that repeat an id are judged one by one."""
    known = langid.profiles(docs)
    found = langid.predict(docs, known, keep=COLUMNS).where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a larger document repeats; null texts become empty ones."""
    kept = linededup.dedup_lines(docs.select(*COLUMNS)).withColumn("text", F.col("__kept")).withColumn("n_chars", F.length("text").cast("long"))
    return kept.select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id. Rows that repeat an id are judged by their own
    texts; of rows that repeat both one stays. Null ids and empty texts stay."""
    return minhash.one_of_each(docs, minhash.near_duplicates(docs)).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, by the target weights; no document twice. The document at which a leaf's budget ends is
    cut there, so that the budget holds to the token. Documents without a token, null texts among them, go."""
    taken = mixing.mix(docs.select(*COLUMNS), MIX, mix_levels(), share=0.9, epochs=1, seed=7)
    cut = (F.col("full_epochs") == 0) & (F.col("last_tokens") < F.col("tokens"))
    taken = taken.withColumn("text", F.when(cut, mixing.first_tokens(F.col("text"), F.col("last_tokens"))).otherwise(F.col("text")))
    return taken.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of binary length, each a sequence; an empty text is its end id alone."""
    found = pow2pack.pieces(docs, tokenizer_file("byte_bpe_50k.json"), blanks=True, end_id=0)
    found = pow2pack.number_sequences(found.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language), ("line_dedup", lines), ("minhash_near_dedup", near), ("mix_sources", mixture), ("pow2_packing", packed)]

#: Language ID, MinHash components and tokenizers are beyond SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        release(since, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
