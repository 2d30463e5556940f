"""Content-addressed WARC archive: payload bytes are stored once under their SHA-256, record headers exactly and apart,
and a join on the digest puts the original records together again.

A page gives one record. Of records with equal payloads of at least ``least`` bytes the one with the smallest page id is
a response, the others revisit it; smaller payloads are responses every time, and are stored once all the same.
Payloads are compressed one by one, as records of an archive are, before they are dealt out by digest. Both tables are
Parquet in the shared folder; their rows are deterministic, so a lost executor's files are made again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written
from .words import SLICE_BYTES, packed_slices
from .workers import task

#: Header lines end so.
CRLF = "\r\n"


@dataclass(frozen=True)
class Archive:
    """``headers(page_id, digest, header)`` and ``payloads(digest, stored)``, the latter compressed."""

    headers: DataFrame
    payloads: DataFrame


#: The date of records whose capture time isn't known.
NO_DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page: Column, digest: Column) -> Column:
    """A name-based UUID of a page and its payload."""
    h = F.md5(F.concat(F.lit("termloom|"), page, F.lit("|"), digest))
    part = lambda at, n: F.substring(h, at, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-3"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def http_header(n_bytes: Column) -> Column:
    """The header of the response that a payload is taken to be from."""
    lines = [F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), n_bytes.cast("string"))]
    return F.concat(F.array_join(F.array(*lines), CRLF), F.lit(CRLF + CRLF))


def _header(kind: Column, date: str) -> Column:
    """A WARC/1.1 header and the HTTP header behind it, blank lines included; line breaks in a URL are percent-coded.

    A revisit holds the HTTP header alone. The page's number is a field of its own.
    """
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    page, owner = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("page_id", "owner"))
    http, revisit = http_header(F.col("n_bytes")), kind == "revisit"
    named = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    lines = [
        F.lit("WARC/1.1"),
        named("WARC-Type", kind),
        named("WARC-Record-ID", record_id(page, F.col("digest"))),
        named("WARC-Date", F.lit(date)),
        named("WARC-Target-URI", url),
        named("Content-Type", F.lit("application/http;msgtype=response")),
        named("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, named("WARC-Refers-To", record_id(owner, F.col("digest")))),
        F.when(revisit, named("WARC-Profile", F.lit(PROFILE))),
        named("Page-ID", page),
        F.when(revisit, named("Refers-To-Page-ID", owner)),
        named("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n_bytes"))).cast("string")),
    ]
    return F.concat(F.array_join(F.array_compact(F.array(*lines)), CRLF), F.lit(CRLF + CRLF), http)


@task()
def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, stored) of payloads, one at a time: a batch holds what is compressed of some slice of them."""
    import zstandard

    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        digests, stored, n_held = [], [], 0
        for x in batch.column(0):
            raw = x.as_buffer()
            digests.append(hashlib.sha256(raw).hexdigest())
            stored.append(packer.compress(raw))
            n_held += len(stored[-1])
            if n_held >= SLICE_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(digests), pa.array(stored, pa.binary())], names=["digest", "stored"])
                digests, stored, n_held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(stored, pa.binary())], names=["digest", "stored"])


@task()
def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(header, payload); a payload that is missing or not what its digest says ends the job."""
    for batch in batches:
        digests = batch.column(1)
        for row, payloads in packed_slices(batch.column(2)):
            for digest, payload in zip(digests.slice(row, len(payloads)).to_pylist(), payloads):
                if payload is None or hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"payload does not match digest {digest}")
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(payloads)), pa.array(payloads, pa.binary())], names=["header", "payload"])


def write_archive(pages: DataFrame, least: int = 100, date: str = NO_DATE) -> Archive:
    """Write the records of ``pages(page_id, url, html)``.

    ``date`` is the records' time of capture. Null html is an empty payload, a null url an empty one. Rows that repeat a page id and a payload are alike. A null
    page id sorts last: it is a response only where no other page has the payload, and nothing refers to it.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    facts = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.sha2(payload, 256).alias("digest"), F.length(payload).cast("long").alias("n_bytes"))
    owners = facts.groupBy("digest").agg(F.min("page_id").alias("owner"))
    # a digest that very many pages share meets its owner in several groups
    owners_at = owners.select("digest", "owner", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    owned = facts.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(16)).cast("int")).join(owners_at, ["digest", "salt"])
    first = (F.col("n_bytes") < least) | F.col("owner").isNull() | F.coalesce(F.col("page_id") == F.col("owner"), F.lit(False))
    kind = F.when(first, F.lit("response")).otherwise(F.lit("revisit"))
    headers = written(owned.select("page_id", "digest", _header(kind, date).alias("header")), "headers")
    stored = pages.select(payload.alias("payload")).mapInArrow(_compress, "digest string, stored binary")
    return Archive(headers, written(stored.groupBy("digest").agg(F.first("stored").alias("stored")), "payloads"))


def read_archive(archive: Archive) -> DataFrame:
    """(page_id, url, record_type, payload_digest, refers_to, payload, record): every record, put together and verified.

    ``record`` is what a WARC file holds: headers, the payload unless the record revisits, and two line breaks. A payload
    that does not have its digest, or is missing, is an error.
    """
    # a digest that very many headers share lies on the left side only, where adaptive execution may split it
    rows = archive.headers.join(archive.payloads, "digest", "left")
    rows = rows.withColumn("named", F.regexp_extract("header", r"\r\nWARC-Payload-Digest: sha256:([0-9a-f]{64})\r\n", 1))
    rows = rows.select("header", "named", "stored").mapInArrow(_restore, "header string, payload binary")

    def named(name: str, value: str) -> Column:
        found = F.regexp_extract("header", rf"\r\n{name}: {value}\r\n", 1)
        return F.when(found != "", found)

    kind = named("WARC-Type", "([a-z]+)")
    body = F.when(kind == "response", F.col("payload")).otherwise(F.lit(b""))
    record = F.concat(F.encode("header", "UTF-8"), body, F.lit((CRLF + CRLF).encode()))
    return rows.select(
        named("Page-ID", "(-?[0-9]+)").cast("long").alias("page_id"),
        F.regexp_extract("header", r"\r\nWARC-Target-URI: ([^\r\n]*)\r\n", 1).alias("url"),
        kind.alias("record_type"),
        named("WARC-Payload-Digest", "sha256:([0-9a-f]{64})").alias("payload_digest"),
        named("Refers-To-Page-ID", "(-?[0-9]+)").cast("long").alias("refers_to"),
        "payload",
        record.alias("record"),
    )
