"""Mixing sources to target weights by hierarchical budgeting.

Weights are a tree, domain over language over source. A budget of tokens runs down the tree in proportion to weights;
what a child can't use (its tokens times the epochs allowed) goes to its siblings first, and to its parent's siblings
only where the whole family is short. Each leaf then takes a prefix of its stream of seeded epochs: every epoch is the
leaf's documents in the order of a hash of seed, epoch and id, so the prefix is some full epochs and the head of one more.

All arithmetic is in integers. Leaves are those of the tree, so per-leaf tables are bounded by it and are broadcast or
collected; texts are never shuffled but for those in the one hash bucket of a leaf where its prefix ends.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Documents of a leaf in one hash bucket of an epoch's order, on average and at most; digits of a bucket's name.
BUCKET_DOCS, DIGITS = 1000, 3

Path = tuple[str | None, ...]
Tree = Mapping[str | None, tuple[int, "Tree | None"]]
LEVELS = ("domain", "language", "origin")


def leaves(tree: Tree, path: Path = ()) -> list[Path]:
    """The paths of all leaves with a positive weight all the way."""
    out = []
    for name, (weight, below) in tree.items():
        if weight > 0:
            out += leaves(below, (*path, name)) if below else [(*path, name)]
    return out


def allocate(tree: Tree, supply: Mapping[Path, int], budget: int, path: Path = ()) -> dict[Path, int]:
    """Tokens for every leaf: at most its supply, at most ``budget`` together; shares are rounded down."""

    def cap(name: str | None) -> int:
        below = tree[name][1]
        own = (*path, name)
        return sum(supply.get((*own, *leaf), 0) for leaf in leaves(below)) if below else supply.get(own, 0)

    caps = {name: cap(name) for name, (weight, _) in tree.items() if weight > 0}
    given: dict[str | None, int] = {}
    unmet, left = dict(caps), budget
    while unmet:
        total = sum(tree[name][0] for name in unmet)
        short = [name for name in unmet if unmet[name] * total <= left * tree[name][0]]
        if not short:
            given |= {name: left * tree[name][0] // total for name in unmet}
            break
        for name in short:
            given[name] = unmet.pop(name)
        left -= sum(given[name] for name in short)
    out: dict[Path, int] = {}
    for name, share in given.items():
        below = tree[name][1]
        out |= allocate(below, supply, share, (*path, name)) if below else {(*path, name): share}
    return out


def n_tokens(text: Column) -> Column:
    """Words: runs outside ASCII blanks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def first_tokens(text: Column, n: Column) -> Column:
    """A text up to the end of its ``n``-th word."""
    parts = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", (n + 1).cast("int"))
    return F.array_join(F.slice(parts, F.lit(1), n.cast("int")), "")


def _at_leaves(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of a broadcast table of leaves; a null name is a name like others."""
    named = table.withColumnsRenamed({c: f"__{c}" for c in LEVELS})
    same = F.lit(True)
    for c in LEVELS:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(F.broadcast(named), same, how).drop(*[f"__{c}" for c in LEVELS])


def mix(docs: DataFrame, tree: Tree, levels: tuple[Column, Column, Column], share: float, epochs: int, seed: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` that are taken, with ``domain``, ``language``, ``origin``, ``tokens``, ``full_epochs`` and ``last_tokens``.

    The budget is ``share`` of the tokens of all leaves, rounded down. A document is in every full epoch, and gives
    ``last_tokens`` of its first tokens to the last one: all of them but for the document at which the prefix ends.
    Documents outside the tree and documents taken for no token are left out; a null label is in the tree where the tree
    names None. Rows that repeat an id are documents of their own. Columns of ``docs`` that have one of the added names give way to it.
    """
    spark = docs.sparkSession
    named = docs.withColumns(dict(zip(LEVELS, levels))).withColumn("tokens", n_tokens(F.col(text_col)))
    paths = leaves(tree)
    names = spark.createDataFrame(paths, "domain string, language string, origin string")
    supply = _at_leaves(named.groupBy(*LEVELS).agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("docs")), names).collect()
    have = {tuple(r[c] for c in LEVELS): r["n"] for r in supply}
    digits = DIGITS  # the bucket in which a prefix ends is sorted in one task: its size doesn't follow the leaf's
    while 16**digits * BUCKET_DOCS < max((r["docs"] for r in supply), default=0):
        digits += 1
    budget = sum(have.values()) * round(share * 1_000_000) // 1_000_000
    given = allocate(tree, {path: n * epochs for path, n in have.items()}, budget)
    parts = [(*path, *divmod(given.get(path, 0), have[path])) for path in paths if have.get(path)]
    plan = spark.createDataFrame(parts, "domain string, language string, origin string, full_epochs long, rest long")
    key = F.concat_ws("|", F.lit(str(seed)), F.col("full_epochs").cast("string"), F.col(id_col).cast("string"))
    named = named.drop("full_epochs", "rest", "last_tokens")
    rows = _at_leaves(named, plan).withColumn("__h", F.md5(key)).withColumn("__b", F.substring("__h", 1, digits))
    sums = rows.groupBy(*LEVELS, "rest", "__b").agg(F.sum("tokens").alias("n"))
    upto = sums.withColumn("before", F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("__b")) - F.col("n"))
    ends = upto.where("before < rest AND before + n >= rest").select(*LEVELS, F.col("__b").alias("__end"), F.col("before").alias("__base"))
    rows = _at_leaves(rows, ends, "left")
    place = F.when(F.col("__end").isNull(), F.lit(0).cast("long")).when(F.col("__b") < F.col("__end"), F.col("tokens")).otherwise(F.lit(0).cast("long"))
    clear = rows.where("__end IS NULL OR __b <> __end").withColumn("last_tokens", place)
    w = Window.partitionBy(*LEVELS).orderBy("__h", id_col, "tokens", F.xxhash64(text_col)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = rows.where("__b = __end").withColumn("__before", F.col("__base") + F.sum("tokens").over(w) - F.col("tokens"))
    edge = edge.withColumn("last_tokens", F.greatest(F.lit(0).cast("long"), F.least("tokens", F.col("rest") - F.col("__before")))).drop("__before")
    both = clear.unionByName(edge).where("full_epochs > 0 OR last_tokens > 0")
    added = (*LEVELS, "tokens", "full_epochs", "last_tokens")
    return both.select(*[c for c in docs.columns if c not in added], *added)
