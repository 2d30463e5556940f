"""How filters of a corpus act upon one another: what each order of them removes, step by step.

Every document gets a mask of the filters that it fails. Masks are counted by part, with partial aggregation, and all that
is asked of any order follows from at most 2^n counts of a part: nothing is filtered again and again.

Exact duplicates, the one filter that looks at the whole table, are found by partition refinement. Texts are split by
their number of code points, then by the hash of one block after another, each block four times as long as the one
before, and classes of one document are dropped after every split. What is left is compared with the whole text of its
class's smallest id; what differs (hashes may collide) is classed once more among its like. Only then are masks counted.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

#: Code points of the first block of a text; block i is 4^i times as long.
FIRST_BLOCK = 256
#: Where blocks begin, as far as a string can reach.
_STARTS = [FIRST_BLOCK * (4**i - 1) // 3 for i in range(12)]


def words(text: Column) -> Column:
    """The maximal runs of characters outside ``\\x20\\x09-\\x0D``."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]"), "")


def block_hashes(text: Column, n: Column) -> Column:
    """A 64-bit hash of every block of a text of ``n`` code points; none for an empty one."""
    return F.array_compact(F.array(*[F.when(n > s, F.xxhash64(F.substring(text, s + 1, 3 * s + FIRST_BLOCK))) for s in _STARTS]))


def _class(n: Column, hashes: Column) -> Column:
    """The class of a text after all splits: its length and one block's hash after another."""
    return F.aggregate(hashes, n.cast("long"), lambda so_far, h: F.xxhash64(so_far, h))


def refined(rows: DataFrame) -> DataFrame:
    """(cls, lead): classes that more than one of ``rows(doc, n, hashes)`` have after all splits, and their smallest ids.

    A split is a count by class with partial sums and a join that adaptive execution may divide, so a class of very many
    copies costs no task more than its share. There are as many splits as the longest of the texts left has blocks.
    """
    live, k = rows.select("doc", "hashes", F.col("n").cast("long").alias("cls")), 0
    while True:
        several = live.groupBy("cls").count().where("count > 1").select("cls")
        live = written(live.join(several, "cls", "left_semi"), "refined")
        if live.where(F.size("hashes") > k).isEmpty():
            return live.groupBy("cls").agg(F.min("doc").alias("lead"))
        live, k = live.withColumn("cls", F.when(F.size("hashes") > k, F.xxhash64("cls", F.col("hashes")[k])).otherwise(F.col("cls"))), k + 1


def flagged(docs: DataFrame, fails: dict[str, Column], duplicates: str) -> DataFrame:
    """(doc, part, mask) of every row of ``docs(doc, part, text)``: bit i of the mask is set where the i-th filter fails.

    ``fails`` are conditions on ``text`` by letter, in the order of their bits; the letter ``duplicates`` has the next
    bit: the same text stands in a row with a smaller id. Rows that repeat an id are no duplicates of one another; a null
    id is no duplicate, nor does it make one. Null texts are empty.
    """
    if duplicates in fails:
        raise ValueError(f"{duplicates} is a filter already")
    docs = docs.select("doc", F.coalesce("part", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    mask, bit = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails.values())), F.lit(0)), 1 << len(fails)
    hashed = docs.withColumn("n", F.length("text")).withColumn("hashes", block_hashes(F.col("text"), F.col("n"))).withColumn("cls", _class(F.col("n"), F.col("hashes")))
    facts = written(hashed.select("doc", "part", "n", "hashes", "cls", mask.alias("mask")), "facts")
    classes = written(refined(facts), "classes")
    out = facts.join(classes, "cls", "left_anti").select("doc", "part", "mask")
    texts = hashed.select("doc", "part", "text", "cls").join(classes, "cls")
    open_ = written(texts.select("cls", "lead", "doc", "part", mask.alias("mask"), "text"), "copies")
    while True:
        # a row of the smallest id and its text; one of them, where ids repeat
        leads = open_.where("doc = lead").groupBy("cls").agg(F.min("text").alias("lead_text"))
        same = F.col("lead").isNull() | (F.col("text") == F.col("lead_text"))
        later = F.coalesce(F.col("doc") > F.col("lead"), F.lit(False))
        met = open_.join(leads, "cls", "left").select("cls", "doc", "part", "mask", same.alias("same"), later.alias("later"), F.when(~same, F.col("text")).alias("text"))
        met = written(met, "met")
        out = out.unionAll(met.where("same").select("doc", "part", (F.col("mask") + F.when(F.col("later"), bit).otherwise(0)).alias("mask")))
        left = met.where("NOT same").select("cls", "doc", "part", "mask", "text")
        if left.isEmpty():
            return out
        open_ = written(left.join(left.groupBy("cls").agg(F.min("doc").alias("lead")), "cls"), "copies")


def audit(flags: DataFrame, letters: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part of
    ``flags(part, mask, good, toxic)``, every order of ``letters`` and every step of it.

    Bit i of a mask belongs to letter i; ``good`` and ``toxic`` are 0 or 1. ``shapley`` is what the step's filter removes,
    summed over all orders: of the orders in which a mask's filters stand, each comes first in an equal number. What a
    step removes depends on which filters stood before it, not on their order, so each such set is worked out once.
    """
    cells = flags.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    cells = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    orders: dict[tuple[int, int], list[str]] = {}
    for order in permutations(letters):
        for k, letter in enumerate(order):
            orders.setdefault((sum(1 << letters.index(x) for x in order[:k]), 1 << letters.index(letter)), []).append("".join(order))
    steps = F.array(*[F.struct(F.lit(before).alias("before"), F.lit(own).alias("own"), F.lit(before.bit_count() + 1).alias("step"), F.lit(names).alias("orders")) for (before, own), names in orders.items()])
    rows = cells.withColumn("at", F.explode(steps)).select("part", "cells", "at.*")
    before, own, total = F.col("before"), F.col("own"), sum(1 for _ in permutations(letters))

    def counted(value: str, met) -> Column:
        return F.aggregate(F.filter("cells", lambda c: met(c["mask"])), F.lit(0).cast("long"), lambda a, c: a + c[value])

    fails, earlier = (lambda m: m.bitwiseAND(own) != 0), (lambda m: m.bitwiseAND(before) != 0)
    here = lambda m: fails(m) & ~earlier(m)
    shapley = F.aggregate(F.filter("cells", lambda c: fails(c["mask"])), F.lit(0).cast("long"), lambda a, c: a + (c["n"] * total / F.bit_count(c["mask"])).cast("long"))
    rows = rows.select(
        "part", "step", "orders",
        counted("n", lambda m: m.bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"),
        counted("n", here).alias("removed"),
        counted("n", lambda m: fails(m) & earlier(m)).alias("redundant"),
        counted("n", lambda m: m == own).alias("unique_fails"),
        counted("good", here).alias("good_lost"),
        counted("toxic", here).alias("toxic_lost"),
        shapley.alias("shapley"),
    )
    return rows.select("part", F.explode("orders").alias("filter_order"), "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def labelled(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) of ``flags``: 1 where any label of the id says quality=1, or toxic=1; ids without a label
    and null ids are neither."""
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("doc")).agg(one("quality"), one("toxic"))
    rows = flags.join(known, "doc", "left")
    return rows.select("part", "mask", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
