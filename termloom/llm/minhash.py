"""MinHash near-dedup with b-bit signatures.

Texts become sets of word shingles, texts of equal words are folded, and each set's minima give band keys. Of the minima
only the low bits are kept, packed in longs. Candidates are, per band bucket, the members against the bucket's leader; the
collision-corrected estimate from bit counts drops pairs far below the threshold and full sets confirm the rest, shingles
being compared as words and not by hashes. Members that a leader leaves in other components elect a new one among them,
``ROUNDS`` times; what is left then is compared bit by bit inside tasks, in blocks, and only pairs that pass the estimate
leave the task. Components follow from confirmed links alone.

Nothing is capped: a bucket of any size is cut in chunks whose pairs go to different tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import mark, release, written
from .words import mix64, plain, shingle_hashes, shingle_names, text_slices, words_of
from .workers import task

#: 32 bands of 4 minima: a pair at 0.75 is missed with probability (1 - 0.75^4)^32 = 6e-6.
BANDS, ROWS = 32, 4
#: Bytes of SHA-256 by which texts of equal words are known.
SAME_BYTES = 20
#: Bits kept of each minimum, and how many of them fit a long.
LOW_BITS = 4
PER_LONG = 64 // LOW_BITS
#: Groups that the members of one bucket are dealt to when they meet what is known of it.
SALTS = 8
#: Members of a bucket that one task compares with as many others, and bytes of their folded sets: at most, on average.
CHUNK, CHUNK_BYTES = 2048, 16 << 20

_N = BANDS * ROWS
_seed = mix64(np.arange(1, 2 * _N + 1, dtype=np.uint64))
_A = (_seed[:_N] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (_seed[_N:] >> np.uint64(32)).astype(np.uint32)

#: Elections of leaders before members that are left open are compared in blocks.
ROUNDS = 3

SIGNATURE = "doc long, sig long, n_shingles long, same binary, bands array<long>, bits array<long>"


def _minima(shingles: np.ndarray) -> np.ndarray:
    folded = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(_N, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(folded), 512):
        out = np.minimum(out, (_A[:, None] * folded[None, at : at + 512] + _B[:, None]).min(axis=1))
    return out


def _sketch(minima: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and packed low bits of rows of minima."""
    rows = minima.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for k in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
    low = ((minima * np.uint32(0x9E3779B1)) >> np.uint32(32 - LOW_BITS)).astype(np.uint64).reshape(len(rows), -1, PER_LONG)
    bits = np.bitwise_or.reduce(low << (np.arange(PER_LONG, dtype=np.uint64) * np.uint64(LOW_BITS)), axis=2)
    return key.view(np.int64), bits.view(np.int64)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.ravel()))


@task()
def _sign(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sigs = batch.column(0), batch.column(1)
        for row, end, data, offsets in text_slices(batch.column(2)):
            words = words_of(data, offsets, lower=True)
            names, first, kinds = shingle_names(words, size)
            hashes, _ = shingle_hashes(words, size)
            n = end - row
            doc = np.repeat(np.arange(n), np.diff(first))
            keys, one = np.unique(doc * kinds + names, return_index=True)
            edge = np.searchsorted(keys, np.arange(n + 1) * kinds)
            own = hashes[one]
            minima = np.zeros((n, _N), np.uint32)
            for i in np.flatnonzero(np.diff(edge)):
                minima[i] = _minima(own[edge[i] : edge[i + 1]])
            bands, bits = _sketch(minima)
            text, start, stop = plain(words)
            lo = np.append(start, len(text))[words.first]
            same = [hashlib.sha256(text[a:b].data).digest()[:SAME_BYTES] if a < b else None for a, b in zip(lo[:-1].tolist(), lo[1:].tolist())]
            columns = [ids.slice(row, n), sigs.slice(row, n), pa.array(np.diff(edge)), pa.array(same, pa.binary()), _lists(bands), _lists(bits)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "sig", "n_shingles", "same", "bands", "bits"])


def signatures(docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: a hash of its text that tells rows of one id apart, set size, digest of the words in
    order (null for none), band keys and packed low bits."""
    return docs.select(F.col(id_col).cast("long").alias("doc"), row_hash(F.col(text_col)).alias("sig"), F.col(text_col).cast("string").alias("text")).mapInArrow(lambda it: _sign(it, size), SIGNATURE)


def row_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def floor_of_estimate(threshold: float, sigmas: float = 6.0) -> int:
    """The least number of equal low-bit fields at which a pair stays a candidate.

    At similarity s fields agree with probability p = s + (1 - s) / 2^b, the collision-corrected estimate being
    (agreeing / n - 2^-b) / (1 - 2^-b). The floor lies ``sigmas`` standard deviations below the threshold's p.
    """
    chance = 2.0**-LOW_BITS
    p = threshold + (1 - threshold) * chance
    return max(0, math.floor(_N * (p - sigmas * math.sqrt(p * (1 - p) / _N))))


def agreeing(x: Column, y: Column) -> Column:
    """Number of equal low-bit fields of two packed signatures, by exclusive or and bit counts."""

    def differing(a: Column, b: Column) -> Column:
        z = a.bitwiseXOR(b)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        return F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))

    return F.lit(_N) - F.aggregate(F.zip_with(x, y, differing), F.lit(0), lambda s, d: s + d)


def estimate(x: Column, y: Column) -> Column:
    """Collision-corrected similarity from two packed signatures."""
    chance = 2.0**-LOW_BITS
    return F.greatest(F.lit(0.0), (agreeing(x, y) / F.lit(float(_N)) - F.lit(chance)) / F.lit(1 - chance))


@task()
def _confirm(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (a, salt, b, text) sorted by (a, salt, b nulls first): the leader's own text, then its candidates' texts.

    Slices of rows are compared at once, shingles by numbers that are exact within a slice; a slice that begins amid a
    group has the group's leader before it. Only a leader's text is held, whatever the number of its candidates.
    """
    leader: bytes = b""
    for batch in batches:
        for at, end, _, _ in text_slices(batch.column(3)):
            part = batch.slice(at, end - at)
            leads = part.column(2).is_null().to_numpy(zero_copy_only=False)
            column, texts = part.column(3), part.column(3)
            if not leads[0]:
                texts = pa.concat_arrays([pa.array([leader], pa.binary()).cast(texts.type), texts])
                leads = np.concatenate([[True], leads])
            head = np.flatnonzero(leads)
            of = head[np.cumsum(leads) - 1]
            leader = texts[int(of[-1])].as_buffer().to_pybytes()
            _, _, data, offsets = next(text_slices(texts, 1 << 62))
            names, first, kinds = shingle_names(words_of(data, offsets, lower=True), size)
            rows = np.repeat(np.arange(len(texts)), np.diff(first))
            keys = np.unique(rows * kinds + names)
            rows = keys // kinds
            n = np.bincount(rows, minlength=len(texts))
            probe = of[rows] * kinds + keys % kinds
            hit = keys[np.minimum(np.searchsorted(keys, probe), len(keys) - 1)] == probe if len(keys) else np.zeros(0, bool)
            both = np.bincount(rows, hit, minlength=len(texts)).astype(np.int64)
            keep = ~leads & (both > 0) & (100 * both >= percent * (n + n[of] - both))
            yield part.select([0, 2]).filter(pa.array(keep[len(texts) - len(column) :]))


def _of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted documents. Their number grows with the corpus, so texts meet them by a shuffle at every size."""
    return docs.join(wanted.hint("merge"), "doc", "left_semi")


def _confirmed(pairs: DataFrame, sets: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` that pass the estimate and then the comparison of full sets.

    A leader's candidates are dealt to groups of about ``CHUNK`` by a salt. Its text goes once to each group and not to
    each pair, so that no task holds more than one leader's text and gathers no more than a group.
    """
    least = floor_of_estimate(percent / 100)
    short = sets.select("rep", "bits")
    near = pairs.join(short.toDF("a", "bits_a"), "a").join(short.toDF("b", "bits_b"), "b")
    near = written(near.where(agreeing(F.col("bits_a"), F.col("bits_b")) >= least).select("a", "b"), "near")
    wanted = near.select(F.col("a").alias("doc")).unionAll(near.select("b")).distinct()
    texts = written(_of(docs, wanted), "texts")
    heads = written(near.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("groups")), "heads")
    salt = F.pmod(F.xxhash64("b"), F.col("groups")).cast("int")
    members = near.join(heads, "a").select("a", salt.alias("salt"), "b")
    of_b = members.hint("merge").join(texts.toDF("b", "text"), "b").select("a", "salt", "b", "text")
    of_a = heads.hint("merge").join(texts.toDF("a", "text"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = of_a.unionAll(of_b).repartition(n, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(lambda it: _confirm(it, size, percent), "a long, b long")


@task()
def _compact(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(rep, compact): the set's hashes folded to 32 bits, sorted."""
    for batch in batches:
        for row, end, data, offsets in text_slices(batch.column(1)):
            shingles, first = shingle_hashes(words_of(data, offsets, lower=True), size)
            folded = (shingles >> np.uint64(32)).astype(np.uint32)
            sets = [np.unique(folded[first[i] : first[i + 1]]).tobytes() for i in range(end - row)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(sets, pa.binary())], names=["rep", "compact"])


@task()
def _blocks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, i, j): pairs of one group's members that differ in component and look similar enough.

    A pair is judged in the first bucket that its members share: if one of them led there, it was confirmed or refused
    before. The estimate goes first, then the folded sets, with an allowance for shingles that fold together.
    """
    least = floor_of_estimate(percent / 100)

    def compare(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows)
        rep, comp, chunk = (table.column(c).to_numpy() for c in ("rep", "comp", "chunk"))
        bits, bands = (np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in table.column(c).chunks]).reshape(len(rep), -1) for c in ("bits", "bands"))
        bits = bits.view(np.uint64)
        sets = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("compact")]
        key, i, j = (table.column(c)[0].as_py() for c in ("key", "i", "j"))
        left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        found: list[tuple[int, int]] = []
        for at in range(0, len(left), 64):
            rows_ = left[at : at + 64]
            open_ = comp[rows_][:, None] != comp[right][None, :]
            if i == j:
                open_ &= rows_[:, None] < right[None, :]
            if not open_.any():
                continue
            z = bits[rows_][:, None, :] ^ bits[right][None, :, :]
            z |= z >> np.uint64(1)
            z |= z >> np.uint64(2)
            differ = np.bitwise_count(z & np.uint64(0x1111111111111111)).sum(axis=2, dtype=np.int32)
            a, b = np.nonzero(open_ & (_N - differ >= least))
            a, b = rows_[a], right[b]
            for lo in range(0, len(a), 4096):
                x, y = a[lo : lo + 4096], b[lo : lo + 4096]
                same = bands[x] == bands[y]
                mine = bands[x, same.argmax(axis=1)] == key
                for p, q in zip(x[mine].tolist(), y[mine].tolist()):
                    both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                    both += 2 + (len(sets[p]) * len(sets[q]) >> 29)
                    if 100 * both >= percent * (len(sets[p]) + len(sets[q]) - both):
                        found.append((min(rep[p], rep[q]), max(rep[p], rep[q])))
        if found:
            pairs = np.array(found, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    group, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, i, j = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key", "i", "j"))
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for s, e in zip(edges, edges[1:]):
            own = (key[s], i[s], j[s])
            if held and own != group:
                yield from compare(held)
                held = []
            group = own
            held.append(batch.slice(s, e - s))
    if held:
        yield from compare(held)


def _salted(members: DataFrame, buckets: DataFrame) -> DataFrame:
    """Members of the buckets, with the bucket's columns; a large bucket's members meet it in ``SALTS`` groups."""
    several = buckets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = members.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
    return dealt.join(several, ["key", "salt"]).drop("salt")


def _in_components(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members (key, rep) of the buckets that hold more than one component, with ``comp`` and the bucket's ``size``."""
    of = members.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    of = written(of, "members")
    mixed = of.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi")
    return written(_salted(of, mixed.select("key", "size")), "mixed")


def _open_pairs(rows: DataFrame, sets: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Candidates between members of one bucket that are in different components."""
    wanted = rows.select(F.col("rep").alias("doc")).distinct()
    compact = _of(docs, wanted).mapInArrow(lambda it: _compact(it, size), "rep long, compact binary")
    known = written(sets.select("rep", "bits", "bands").join(compact, "rep"), "compact")
    sizes = rows.join(known.select("rep", F.length("compact").alias("bytes")), "rep").groupBy("key").agg(F.sum("bytes").alias("bytes"))
    rows = rows.join(sizes, "key").join(known, "rep")
    rows = rows.withColumn("chunks", F.greatest(F.ceil(F.col("size") / CHUNK), F.ceil(F.col("bytes") / CHUNK_BYTES)).cast("int"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("key", F.least("chunk", "j").alias("i"), F.greatest("chunk", "j").alias("j"), "rep", "comp", "chunk", "bits", "bands", "compact")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(lambda it: _blocks(it, percent), "a long, b long").distinct()


def _joined(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (node, comp) after more links between nodes."""
    if comps is None:
        return components(links)
    links = written(links, "confirmed")
    if links.isEmpty():
        return comps
    named = comps.toDF("node", "c")
    for end in ("a", "b"):
        links = links.join(named.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    above = components(links).toDF("c", "top")
    known = comps.toDF("node", "c").unionAll(above.join(comps, above["c"] == comps["node"], "left_anti").select("c", "c"))
    return written(known.join(above, "c", "left").select("node", F.coalesce("top", "c").alias("comp")), "components")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, sig) for every row: documents linked at 100 * both >= percent * either.

    Texts without words (null, empty) have the empty set and link with nothing. Rows that repeat an id follow their own
    text, which ``sig`` tells; a null id is never linked, its component is null and it is kept. An empty table gives an
    empty result. Other columns don't matter.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    signed = written(signatures(docs, size, "doc", "text"), "signatures")
    several = signed.where("doc IS NOT NULL").groupBy("doc").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo <> hi")
    if several.isEmpty():
        return _near(docs, signed, size, percent).withColumnRenamed("doc", id_col)
    # ids with several texts: each such row is a node of its own, and components take the smallest id of their rows
    several = written(several.select("doc"), "several")
    low, high = docs.agg(F.min("doc"), F.max("doc")).first()
    if high >= 1 << 62 and low <= -(1 << 62):
        raise ValueError("ids leave no room for the rows that repeat one with other texts")
    node = F.monotonically_increasing_id() + F.lit(high) + 1 if high < 1 << 62 else F.lit(low) - 1 - F.monotonically_increasing_id()
    flagged = docs.join(several.withColumn("flag", F.lit(True)), "doc", "left")
    named = written(flagged.withColumn("own", F.when(F.col("flag"), node).otherwise(F.col("doc"))), "named")
    docs = named.select(F.col("own").alias("doc"), "text")
    found = _near(docs, written(signatures(docs, size, "doc", "text"), "signatures"), size, percent)
    found = found.join(named.where("flag").select(F.col("own").alias("doc"), F.col("doc").alias("real")), "doc", "left").withColumn("real", F.coalesce("real", "doc"))
    found = written(found, "found")
    least = found.groupBy("component_id").agg(F.min("real").alias("least"))
    out = found.join(least, "component_id", "left").select(F.col("real").alias(id_col), "n_shingles", F.col("least").alias("component_id"), "sig")
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))).select(id_col, "n_shingles", "component_id", "kept", "sig")


def _near(docs: DataFrame, signed: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc, n_shingles, component_id, kept, sig) of rows of which those of one id have one text."""
    sets = signed.where("same IS NOT NULL AND doc IS NOT NULL").groupBy("same")
    sets = written(sets.agg(F.min("doc").alias("rep"), F.first("bands").alias("bands"), F.first("bits").alias("bits")), "sets")
    members = sets.select("rep", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = written(_salted(members, buckets).withColumn("comp", F.col("rep")), "buckets")
    comps, since = None, mark()
    for _ in range(ROUNDS):
        leaders = rows.groupBy("key").agg(F.min(F.struct("rep", "comp")).alias("l")).select("key", "l.*").toDF("key", "leader", "leader_comp")
        met = written(_salted(rows, leaders), "met")
        stars = met.where("rep <> leader AND comp <> leader_comp").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
        comps = _joined(comps, _confirmed(stars, sets, docs, size, percent))
        # a leader has met all the others: those go on without it
        rows = _in_components(met.where("rep <> leader").select("key", "rep"), comps)
        release(since, comps, rows)
        if rows.isEmpty():
            break
    else:
        comps = _joined(comps, _confirmed(_open_pairs(rows, sets, docs, size, percent), sets, docs, size, percent))
        release(since, comps)
    of_set = sets.select("same", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("same", F.coalesce("comp", "rep").alias("comp"))
    out = signed.select("doc", "sig", "n_shingles", "same").join(of_set, "same", "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc").isNotNull(), F.col("comp"))).otherwise(F.col("doc"))
    out = out.select("doc", "n_shingles", component.alias("component_id"), "sig")
    return out.withColumn("kept", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True))).select("doc", "n_shingles", "component_id", "kept", "sig")


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that near_duplicates' result keeps, rows that repeat both id and text once. All columns stay."""
    found = written(found, "near")
    rows = docs.withColumn("__sig", row_hash(F.col(text_col)))
    at = lambda x: rows[id_col].eqNullSafe(x["__doc"]) & (rows["__sig"] == x["__of"])
    named = lambda x: x.select(F.col(id_col).alias("__doc"), F.col("sig").alias("__of"))
    gone = named(found.where("NOT kept"))
    again = written(named(found.where("kept")).groupBy("__doc", "__of").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "again")
    left = rows.join(gone, at(gone), "left_anti")
    if not again.isEmpty():
        rows = left
        left = rows.join(again, at(again), "left_anti").unionByName(rows.join(again, at(again), "left_semi").dropDuplicates([id_col, "__sig"]))
    return left.drop("__sig")
