"""Which terms of a whole vocabulary are parts of others.

A container of usual length gives out its substrings, which meet the terms that they equal: work and shuffles follow the
characters of the vocabulary and the pairs that are found, however large it is. What a longer container holds would grow with
the square of its length; these are joined by the rarest gram of each term. A container holds every gram of a part, so each
term is sent to the one of its grams that fewest of them hold, each container to those of its grams that some term was sent
to, and what meets there is compared. A gram at which very many would meet is dealt out: its containers over as many tasks as
it needs, its terms to all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut
from .stats import LENGTH_WEIGHT

#: Characters of a gram; shorter terms are grams themselves.
GRAM = 3
#: Characters of a container that gives out all its substrings.
USUAL = 40
#: Pairs that meet at a gram in one task, on average at most.
MEET = 1 << 16


def _grams(term: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters."""
    many = F.transform(F.sequence(F.lit(1), F.length(term) - size + 1), lambda i: F.substring(term, i, size))
    return F.array_distinct(F.when(F.length(term) >= size, many).otherwise(F.array().cast("array<string>")))


def _substrings(term: Column, shortest: int) -> Column:
    """The distinct proper substrings of ``shortest`` or more characters."""
    n, none = F.length(term), F.array().cast("array<string>")
    of = lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(term, i, k))
    every = F.flatten(F.transform(F.sequence(F.lit(shortest), n - 1), of))
    return F.array_distinct(F.when(n > shortest, every).otherwise(none))


def containment(vocabulary: DataFrame, shortest: int = 2, gram: int = GRAM, meet: int = MEET, usual: int = USUAL) -> DataFrame:
    """(term, container, container_frequency) for terms of ``shortest`` or more characters that are proper substrings of
    others of ``vocabulary(term, frequency)``, which holds each term once; nulls take no part.

    A null or empty vocabulary gives nothing. Containers of up to ``usual`` characters give out their substrings; the others
    are met at grams.
    """
    rows = cut(vocabulary.where("term IS NOT NULL").select("term", "frequency"))
    held = rows.where(F.length("term") <= usual).select(F.col("term").alias("container"), F.col("frequency").alias("container_frequency"), F.explode(_substrings(F.col("term"), shortest)).alias("term"))
    found = held.join(rows.select("term"), "term").select("term", "container", "container_frequency")
    long = rows.where(F.length("term") > usual)
    return found if long.isEmpty() else found.unionAll(_by_grams(rows, long, shortest, gram, meet))


def _by_grams(rows: DataFrame, containers: DataFrame, shortest: int, gram: int, meet: int) -> DataFrame:
    """:func:`containment` of ``rows`` in some of them, by the rarest gram of each term."""
    t = F.col("term")
    own = F.when(F.length(t) >= gram, _grams(t, gram)).otherwise(F.array(t))
    asked = rows.where(F.length(t) >= shortest).select("term", F.explode(own).alias("gram"))
    # a container is longer than its parts; short terms are looked for among grams of their own lengths
    sizes = range(min(shortest, gram), gram + 1)
    every = F.array_distinct(F.concat(*[F.when(F.length(t) > k if k < gram else F.length(t) > shortest, _grams(t, k)).otherwise(F.array().cast("array<string>")) for k in sizes]))
    held = containers.select(F.col("term").alias("container"), F.col("frequency").alias("container_frequency"), F.explode(every).alias("gram"))
    places = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # grams that no container holds have no part; of the others a term takes the rarest
    chosen = asked.join(places, "gram").groupBy("term").agg(F.min(F.struct("n", "gram")).alias("g")).select("term", "g.gram", "g.n")
    chosen = cut(chosen)
    parts = chosen.groupBy("gram").agg(F.greatest(F.lit(1), F.ceil(F.max("n") * F.count(F.lit(1)) / meet)).cast("int").alias("parts"))
    left = chosen.join(parts, "gram").select("term", "gram", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = held.join(parts, "gram").select("container", "container_frequency", "gram", F.pmod(F.xxhash64("container"), F.col("parts")).cast("int").alias("part"))
    met = left.join(right, ["gram", "part"]).where((F.length("container") > F.length("term")) & F.contains("container", "term"))
    return met.select("term", "container", "container_frequency")


def c_value(vocabulary: DataFrame, variant: int = 1) -> DataFrame:
    """``vocabulary`` with ``containers`` and ``c_value``: the weight of a term's length times its frequency less the mean
    frequency of the terms that contain it, over the whole corpus; 0 at least. Variants differ in the weight."""
    weight = LENGTH_WEIGHT[variant](F.length("term"))
    rows = cut(vocabulary)
    spelt = rows.where("term IS NOT NULL").select("term", "frequency")
    held = spelt.where(F.length("term") <= USUAL).select("frequency", F.explode(_substrings(F.col("term"), 2)).alias("term"))
    # summed where the containers are, so a part of very many is no task's burden
    sums = held.groupBy("term").agg(F.sum("frequency").alias("__s"), F.count(F.lit(1)).alias("__n"))
    long = spelt.where(F.length("term") > USUAL)
    if not long.isEmpty():
        more = _by_grams(spelt, long, 2, GRAM, MEET).groupBy("term").agg(F.sum("container_frequency").alias("__s"), F.count(F.lit(1)).alias("__n"))
        sums = sums.unionAll(more).groupBy("term").agg(F.sum("__s").alias("__s"), F.sum("__n").alias("__n"))
    joined = rows.join(sums, "term", "left").withColumn("containers", F.coalesce("__n", F.lit(0).cast("long")))
    return joined.withColumn("c_value", F.greatest(F.lit(0.0), weight * (F.col("frequency") - F.coalesce(F.col("__s") / F.col("__n"), F.lit(0.0))))).drop("__s", "__n")
