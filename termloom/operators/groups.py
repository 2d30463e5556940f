"""Work on the rows of one key together, streamed: a task sorts its rows by key and holds one key's rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame


def per_key(df: DataFrame, key: str, work: Callable[[pa.Table], pa.Table | Iterator[pa.Table]], schema: str, after: list[Column] | None = None, spread: bool = False) -> DataFrame:
    """``work`` on the table of each key's rows; a key is the bound of what a task holds. Null keys are one key. ``after`` are
    the columns that ``work`` takes besides the key, made of the rows once they are where they belong. ``work`` may give
    several tables. ``spread`` keeps the session's number of partitions: for work whose results are many times its input,
    by whose bytes Spark would put all of it into few tasks."""

    def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = work(pa.Table.from_batches(held))
        for table in [made] if isinstance(made, pa.Table) else made:
            yield from table.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(0)
            differs = pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)), True).to_numpy(zero_copy_only=False)
            edges = [0, *(differs.nonzero()[0] + 1).tolist(), batch.num_rows]
            for s, e in zip(edges, edges[1:]):
                own = column[s].as_py()
                if held and (own != last):
                    yield from done(held)
                    held = []
                held.append(batch.slice(s, e - s))
                last = own
        if held:
            yield from done(held)

    columns = [key, *[c for c in df.columns if c != key]]
    dealt = (int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key) if spread else (key,)
    rows = df.select(*columns).repartition(*dealt).sortWithinPartitions(key)
    return (rows if after is None else rows.select(key, *after)).mapInArrow(run, schema)


def inside(terms: list[str | None], shortest: int) -> Iterator[tuple[int, list[int]]]:
    """(container, the terms that are proper parts of it) among distinct terms, by one automaton of them all.

    The work grows with the terms' characters and the matches, whatever their lengths.
    """
    import ahocorasick

    machine = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        if t is not None and len(t) >= max(1, shortest):
            machine.add_word(t, i)
    if not len(machine):
        return
    machine.make_automaton()
    for i, t in enumerate(terms):
        if t is not None and len(t) > shortest:
            found = {j for _, j in machine.iter(t)}
            found.discard(i)
            if found:
                yield i, sorted(found)


def counted(terms: list[str | None], texts: list[str | None]) -> Iterator[tuple[int, int, int]]:
    """(text, term, occurrences that don't overlap, from the left) of all terms in each text, by one automaton."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        if t:
            machine.add_word(t, i)
    if not len(machine):
        return
    machine.make_automaton()
    sizes = [len(t or "") for t in terms]
    for k, s in enumerate(texts):
        if not s:
            continue
        count: dict[int, int] = {}
        free: dict[int, int] = {}
        for end, i in machine.iter(s):
            if end - sizes[i] >= free.get(i, -1):
                count[i] = count.get(i, 0) + 1
                free[i] = end
        yield from ((k, i, n) for i, n in count.items())


def fields(df: DataFrame) -> str:
    """The schema of ``df`` as text."""
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
