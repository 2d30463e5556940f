"""Remote models behind one interface; the stub answers without a network and always alike."""

from __future__ import annotations

import hashlib
import json
import random
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cache_key


#: A generated token with its log probability and its candidates.
TOKENS = "array<struct<token:string,logprob:double,top:array<struct<token:string,logprob:double>>>>"


class Provider(Protocol):
    def complete(self, prompts: list[str]) -> list[str | None]: ...

    def generate(self, prompts: list[str]) -> list[list[dict] | None]: ...

    def embed(self, texts: list[str]) -> list[list[float] | None]: ...


def _digest(s: str, digits: int) -> int:
    return int(hashlib.md5(s.encode()).hexdigest()[:digits], 16)


def _words(s: str) -> list[str]:
    """The different words of eight or more letters in the lines behind the first, in order."""
    return list(dict.fromkeys(re.findall("[A-Za-z]{8,}", s.partition("\n")[2])))


#: What a stub replies, by style: a verdict, the words of the text as terms or candidates, a letter, a doubtful definition.
STYLES: dict[str, Callable[[str], str]] = {
    "yes": lambda p: f"YES | {hashlib.md5(p.encode()).hexdigest()[:8]} {_digest(p, 2) % 10}",
    "verdict": lambda p: f"{'YES' if _digest(p, 2) % 2 == 0 else 'NO'} | {hashlib.md5(p.encode()).hexdigest()[:8]}",
    "terms": lambda p: json.dumps({"terms": [{"headword": w, "synonyms": [w.upper()], "definition": f"about {w}", "category": None} for w in _words(p)]}),
    "candidates": lambda p: json.dumps({"candidates": [{"term": w, "importance": _digest(w, 2) % 12} for w in _words(p)]}) if "candidates" in p else f"{p.splitlines()[1]} defined",
    "letter": lambda p: "ABCDE"[_digest(p, 2) % 5],
    "doubt": lambda p: f"{'不明' if _digest(p, 2) % 4 == 0 else 'known'} {p.splitlines()[-1]}",
    "ending": lambda p: f"it is {p.splitlines()[1]}{('er', 'en', 'on')[int(p.splitlines()[2]) - 1]}",
    "varied": lambda p: f"{'不明 ' if _digest(p, 2) % 4 == 0 else ''}{'x' * (_digest(p, 2) % 20)} {_digest(p, 2) % 11}",
    "none": lambda p: "nothing",
}


class Stub:
    """Answers from digests of what is asked."""

    def __init__(self, dim: int = 64, style: str = "yes") -> None:
        self.dim, self.style = dim, style

    def complete(self, prompts: list[str]) -> list[str | None]:
        return [STYLES[self.style](p) for p in prompts]

    def generate(self, prompts: list[str]) -> list[list[dict] | None]:
        """The last five words of the prompt once more, with log probabilities from their digests, each with two candidates."""
        out = []
        for p in prompts:
            tokens = []
            for k, w in enumerate((p or "").split()[-5:]):
                lp = -_digest(f"{w}|{k}", 4) / 10000
                tokens.append({"token": w, "logprob": lp, "top": [{"token": w, "logprob": lp}, {"token": w.upper(), "logprob": lp - 1}]})
            out.append(tokens)
        return out

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        out = []
        for t in texts:
            raw = b"".join(hashlib.sha256(f"{k}|{t}".encode()).digest() for k in range(-(-self.dim // 32)))[: self.dim]
            v = [b - 127.5 for b in raw]
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v])
        return out


def with_retry(call: Callable, tries: int = 4, first: float = 1.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep):
    """Call until it succeeds, waiting twice as long each time, with a tenth of jitter."""
    for k in range(tries):
        try:
            return call()
        except Exception:  # noqa: BLE001 - a client may raise anything
            if k == tries - 1:
                raise
            sleep(min(most, first * 2**k) * (1 + 0.1 * random.random()))


#: Rows that are given on at once, whatever a call takes.
GIVEN = 1 << 10
#: Seconds before the second try of a call.
FIRST_WAIT = 1.0


def _called(prompts: list, call: Callable[[list], list], wait: float) -> tuple[list, list[str | None]]:
    """(replies, errors) of prompts that aren't null, which aren't sent; a batch that fails is asked once more row by row."""
    asked = [i for i, p in enumerate(prompts) if p is not None]
    replies: list = [None] * len(prompts)
    errors: list[str | None] = [None] * len(prompts)
    if not asked:
        return replies, errors
    try:
        for i, reply in zip(asked, with_retry(lambda: call([prompts[i] for i in asked]), first=wait)):
            replies[i] = reply
    except Exception as e:  # noqa: BLE001 - a client may raise anything
        for i in asked:
            try:
                replies[i] = call([prompts[i]])[0] if len(asked) > 1 else None
                errors[i] = None if len(asked) > 1 else type(e).__name__
            except Exception as own:  # noqa: BLE001 - a failed row has a null and its error
                errors[i] = type(own).__name__
    return replies, errors


def _mapped(df: DataFrame, col: str, out: str, kind: str, call: Callable[[list[str]], list], size: int) -> DataFrame:
    wait = FIRST_WAIT
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", {out} {kind}, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # a call takes ``size`` prompts; a table for each call would cost more than many a reply
            for at in range(0, len(batch), GIVEN):
                part = batch.iloc[at : at + GIVEN]
                prompts, replies, errors = part[col].tolist(), [], []
                for lo in range(0, len(prompts), size):
                    said, failed = _called(prompts[lo : lo + size], call, wait)
                    replies += said
                    errors += failed
                yield part.assign(**{out: pd.Series(replies, part.index, dtype=object), "error": pd.Series(errors, part.index, dtype=object)})

    return df.mapInPandas(run, schema)


class Stored:
    """A provider whose replies are kept in a table under ``path`` and paid for once, whichever pass asks.

    A pass asks for its distinct prompts that the table lacks, writes the replies, and reads all of them back; failed calls
    aren't kept, so they are asked again by the next pass. ``in_flight`` bounds the tasks that call at a time, and with it
    the calls. The table has a folder for each kind of call; replies that two runs wrote at a time are alike to its reader:
    the first of them counts.
    """

    def __init__(self, provider: Provider, path: str, in_flight: int = 16) -> None:
        self.provider, self.path, self.in_flight = provider, path, in_flight

    def answered(self, df: DataFrame, col: str, out: str, kind: str, method: str, size: int) -> DataFrame:
        spark, folder = df.sparkSession, f"{self.path}/{method}"
        schema = f"key string, {out} {kind}"
        keyed = df.withColumn("__key", cache_key(F.col(col)))
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(folder)
        there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        known = spark.read.schema(schema).parquet(folder) if there else spark.createDataFrame([], schema)
        asked = keyed.where(F.col(col).isNotNull()).select(F.col("__key").alias("key"), F.col(col).alias("prompt")).dropDuplicates(["key"])
        new = asked.join(known.select("key"), "key", "left_anti").repartition(self.in_flight, "key")
        got = _mapped(new, "prompt", out, kind, getattr(self.provider, method), size)
        got.where("error IS NULL").select("key", out).write.mode("append").parquet(folder)
        kept = spark.read.schema(schema).parquet(folder).groupBy("key").agg(F.min_by(out, F.xxhash64(F.to_json(F.struct(out)))).alias(out))
        joined = keyed.join(kept.withColumnRenamed("key", "__key").withColumn("__there", F.lit(True)), "__key", "left")
        missing = F.col(col).isNotNull() & F.col("__there").isNull()
        return joined.withColumn("error", F.when(missing, F.lit("Unanswered"))).select(*df.columns, out, "error")


def _asked(df: DataFrame, provider: Provider, col: str, out: str, kind: str, method: str, size: int) -> DataFrame:
    if isinstance(provider, Stored):
        return provider.answered(df, col, out, kind, method, size)
    return _mapped(df, col, out, kind, getattr(provider, method), size)


def complete(df: DataFrame, provider: Provider, prompt_col: str = "prompt", size: int = 5) -> DataFrame:
    """``df`` with ``reply`` and ``error``; a null prompt isn't sent. Write the rows before they are used twice, or give a
    :class:`Stored` provider: a retry must not pay twice."""
    return _asked(df, provider, prompt_col, "reply", "string", "complete", size)


def generate(df: DataFrame, provider: Provider, prompt_col: str = "prompt", size: int = 5) -> DataFrame:
    """``df`` with ``tokens`` (token, logprob, candidates) and ``error``; a null prompt isn't sent."""
    return _asked(df, provider, prompt_col, "tokens", TOKENS, "generate", size)


def stepped(df: DataFrame, provider: Provider, most: int, size: int = 5) -> DataFrame:
    """``df`` (context, term, tokens, ...) with ``lps``: log probabilities of up to ``most`` tokens that spell the term, foreseen
    one by one. ``tokens`` are the replies to the contexts themselves, so the first step is not asked again.

    All steps of a row are one task's: rows of a batch take each step together, and those that have spelt their term or
    run out of it are left out. A token that is neither the term's next letters nor has a candidate for them counts as -5.
    """
    inner, wait = (provider.provider if isinstance(provider, Stored) else provider), FIRST_WAIT
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", lps array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), size):
                part = batch.iloc[at : at + size]
                contexts, terms = part["context"].tolist(), part["term"].tolist()
                said, lps = [""] * len(part), [[] for _ in terms]
                replies = list(part["tokens"])
                for i in range(most):
                    live = [len(t) > i and (i == 0 or t not in s) for t, s in zip(terms, said)]
                    if i:
                        replies, _ = _called([c + s if on else None for c, s, on in zip(contexts, said, live)], inner.generate, wait)
                    for k, (on, tokens) in enumerate(zip(live, replies)):
                        if not on or tokens is None or not len(tokens):
                            continue
                        first = tokens[0]
                        target = terms[k][i : i + len(first["token"])]
                        others = [c["logprob"] for c in first["top"] if c["token"] == target]
                        lps[k].append(first["logprob"] if first["token"] == target else others[0] if others else -5.0)
                        said[k] += first["token"]
                yield part.assign(lps=pd.Series(lps, part.index, dtype=object))

    return df.mapInPandas(run, schema)


def embed(df: DataFrame, provider: Provider, text_col: str = "term", size: int = 100) -> DataFrame:
    """``df`` with ``embedding``, null for each row of a failed batch, and ``error``."""
    return _asked(df, provider, text_col, "embedding", "array<double>", "embed", size)


def embed_unit(df: DataFrame, provider: Provider, text_col: str = "term", size: int = 100) -> DataFrame:
    """As :func:`embed`, vectors of length 1; zeros stay."""
    n = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    return embed(df, provider, text_col, size).withColumn("embedding", F.when(n > 0, F.transform("embedding", lambda x: x / n)).otherwise(F.col("embedding")))


def embed_one(df: DataFrame, provider: Provider, text_col: str = "term") -> DataFrame:
    """One call a row, an empty vector for an error."""
    return embed(df, provider, text_col, 1).withColumn("embedding", F.coalesce("embedding", F.array().cast("array<double>")))


def with_defaults(df: DataFrame, values: dict[str, float | str]) -> DataFrame:
    """The values that stand for a failed call in the columns named."""
    return df.withColumns({c: F.when(F.col("error").isNotNull(), F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def embed_cached(df: DataFrame, cache: DataFrame, provider: Provider, text_col: str = "term") -> tuple[DataFrame, DataFrame]:
    """(rows with embeddings, new cache rows): only texts whose digest the cache lacks are embedded."""
    keyed = df.withColumn("key", cache_key(F.col(text_col)))
    new = embed_unit(keyed.join(cache, "key", "left_anti").select("key", text_col).dropDuplicates(["key"]), provider, text_col).where("error IS NULL").select("key", "embedding")
    return keyed.join(cache.select("key", "embedding").unionByName(new), "key", "left").drop("key"), new
