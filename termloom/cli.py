"""Command lines: ``python -m termloom.cli COMMAND ...``. Sessions and clusters are Spark's own settings."""

from __future__ import annotations

import argparse
import json
import os
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import surface
from .config import PROFILES, TEMPLATE, EngineConfig, load
from .operators import contexts, passes, rank, stats
from .plans import build, extract
from .sources import readers, sinks
from .sources.provider import Provider, Stub
from .sources.shared import cut


def provider_of(name: str, dim: int = 64) -> Provider:
    """A provider by name: the stub with vectors of ``dim`` numbers, or ``module:callable`` that makes one and knows where its credentials are."""
    if name == "stub" or name.startswith("stub:"):
        return Stub(dim, name.partition(":")[2] or "yes")
    import importlib

    module, _, made = name.partition(":")
    return getattr(importlib.import_module(module), made)()


def _documents(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    files = readers.read_directory(spark, path, recursive=recursive, other_as_text=not os.path.isdir(path))
    return files.where("error IS NULL AND coalesce(text, '') <> ''").select(F.col("path").alias("doc_id"), "text")


def _as_terms(found: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    return found.select(F.col("doc_id").alias("file_path"), "term", F.lit("").alias("definition"), "score", "frequency", empty.alias("contexts"))


def init(spark: SparkSession, a: argparse.Namespace) -> None:
    """Write a file of settings."""
    if os.path.exists(a.config):
        raise SystemExit(f"{a.config} is there already")
    with open(a.config, "w", encoding="utf-8") as f:
        f.write(TEMPLATE)


def statistical(spark: SparkSession, a: argparse.Namespace) -> None:
    """Entry A: compound terms of every document, with ``--graph`` ranked by its graph."""
    docs = _documents(spark, a.input, a.recursive)
    mark = a.settings.profile.sentence_marks[0]
    found = extract.graph_terms(docs, a.provider, a.settings) if a.graph else extract.compound_terms(docs, a.settings, mark=mark)
    sinks.save(_as_terms(found), a.output, a.format)
    print(surface.shown(stats.term_statistics(found)))


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Entry C: scored and classified terms; ``--pilot`` ten, ``--limit N``, ``--full`` a hundred. ``--looks`` asks no
    provider and judges terms by their looks."""
    most = 10 if a.pilot else 100 if a.full else a.limit
    docs = _documents(spark, a.input, a.recursive)
    rows = cut(extract.evaluated_terms(docs, a.settings, most) if a.looks else extract.evaluated_by_provider(docs, a.provider, a.settings, most))
    sinks.write_rows(rows, f"{a.output}/results")
    sinks.write_rows(extract.run_statistics(rows), f"{a.output}/stats")
    sinks.write_review(rank.review(rows), f"{a.output}/review")
    print(surface.shown(extract.run_statistics(rows)))


def generic(spark: SparkSession, a: argparse.Namespace) -> None:
    """Entry D: the generic extractor's terms of each document in classes by what a provider foresees of them: in their
    sentences, behind masks, and by a direct choice where that gives too little."""
    docs = _documents(spark, a.input, a.recursive)
    terms = cut(extract.generic_terms(docs, a.settings, a.limit).select("doc_id", "term", "frequency"))
    found = cut(passes.evaluate_generic(docs, terms, a.provider, a.settings.profile.sentence_marks))
    sinks.write_rows(sinks.buckets(rank.dynamic_confidence(found)), a.output)


def dictionary(spark: SparkSession, a: argparse.Namespace) -> None:
    """Entry B: build or update the dictionary."""
    built = build.build_dictionary(_documents(spark, a.input, a.recursive), a.provider, a.settings)
    store = build.update_store(spark, a.output, built)
    sinks.write_dictionary(store, f"{a.output}/export")
    print(surface.shown(build.statistics(spark, a.output)))


def search(spark: SparkSession, a: argparse.Namespace) -> None:
    """Terms of the dictionary like a query."""
    print(surface.shown(build.search(spark, a.input, a.query, a.limit).select("headword", "synonyms", "definition", "confidence")))


def extracted(spark: SparkSession, a: argparse.Namespace) -> None:
    """Terms that a provider finds in every document; with ``--two-stage`` candidates first, definitions by contexts then."""
    docs = cut(_documents(spark, a.input, a.recursive))
    chunks = build.chunks_of(docs, a.settings)
    if a.two_stage:
        found = cut(passes.chosen(chunks, a.provider))
        listed = docs.join(found.groupBy("doc_id").agg(F.collect_list("term").alias("terms")), "doc_id")
        seen = contexts.occurrences(listed, 150, 5, any_case=True).select("doc_id", "term", contexts.kwic_sentence(75).alias("context"))
        found = passes.defined(found, seen, a.provider).withColumn("score", F.col("importance") / 10)
    else:
        terms = passes.extract_terms(chunks, a.provider).select("doc_id", F.col("headword").alias("term"), "definition", F.lit(0.0).alias("score"), F.struct("chunk_id", "ord").alias("o"))
        found = passes.merge_extracted(terms.withColumn("ord", F.col("o.chunk_id") * 10000 + F.col("o.ord")), a.limit)
    empty = F.array().cast("array<string>")
    sinks.save(found.select(F.col("doc_id").alias("file_path"), "term", "definition", "score", F.lit(1).cast("long").alias("frequency"), empty.alias("contexts")), a.output, a.format)


def served(spark: SparkSession, path: str, port: int, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that answers ``GET /terms?q=...&limit=...`` from the newest snapshot; the caller runs and closes it."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            url = urlsplit(self.path)
            asked = parse_qs(url.query)
            if url.path != "/terms":
                self.send_error(404)
                return
            try:
                most = min(1000, max(1, int(asked.get("limit", ["10"])[0])))
            except ValueError:
                self.send_error(400)
                return
            rows = build.search(spark, path, asked.get("q", [""])[0], most).drop("embedding").collect()
            body = json.dumps([r.asDict() for r in rows], default=str, ensure_ascii=False).encode()
            self.send_response(200)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args: object) -> None:
            """Nothing is logged."""

    return ThreadingHTTPServer((host, port), Handler)


def serve(spark: SparkSession, a: argparse.Namespace) -> None:
    """Serve searches of the dictionary."""
    with served(spark, a.input, a.port) as server:
        server.serve_forever()


def preprocess(spark: SparkSession, a: argparse.Namespace) -> None:
    """Read files once and keep their texts; ``--list`` shows the runs so far."""
    if a.list:
        print(surface.shown(sinks.listing(spark, f"{a.output}/index")))
        return
    done = readers.preprocess(readers.read_directory(spark, a.input, recursive=a.recursive))
    if a.extension:
        done = done.where(F.col("extension").isin(*[x.lstrip(".").lower() for x in a.extension]))
    done = done.cache()
    sinks.write_rows(sinks.envelope(done, a.input), f"{a.output}/envelope")
    sinks.append_log(done.where("error IS NULL"), f"{a.output}/index", a.input)
    print(surface.shown(readers.preprocess_counts(done)))


def unknown(spark: SparkSession, a: argparse.Namespace) -> None:
    """Entry E: terms of a terms file that a model doesn't know without context."""
    terms = readers.read_terms(spark, a.input).select("term", "definition")
    rows = passes.similarity_rows(passes.context_free(terms, a.provider), a.provider).cache()
    found = passes.unknown_terms(rows, a.settings.similarity_threshold)
    sinks.write_evaluation(found, stats.evaluation_summary(found), a.output)
    print(surface.shown(stats.evaluation_summary(found)))
    print(surface.shown(stats.similarity_statistics(rows)))


COMMANDS = {"extract": extracted} | {f.__name__: f for f in (init, statistical, evaluate, generic, dictionary, search, serve, preprocess, unknown)}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="termloom")
    commands = top.add_subparsers(dest="command", required=True)
    for name, f in COMMANDS.items():
        p = commands.add_parser(name, help=(f.__doc__ or "").splitlines()[0])
        if name != "init":
            p.add_argument("input")
        p.add_argument("-o", "--output", default="termloom_out")
        p.add_argument("-r", "--recursive", action="store_true")
        p.add_argument("-l", "--list", action="store_true")
        p.add_argument("-e", "--extension", action="append", default=[])
        p.add_argument("--config", default="termloom.yml")
        p.add_argument("--profile", choices=sorted(PROFILES))
        p.add_argument("--provider", default="stub")
        p.add_argument("--format", choices=("json", "csv"), default="json")
        p.add_argument("--graph", action="store_true")
        p.add_argument("--limit", type=int, default=30)
        p.add_argument("--pilot", action="store_true")
        p.add_argument("--full", action="store_true")
        p.add_argument("--looks", action="store_true")
        p.add_argument("--query", default="%")
        p.add_argument("--port", type=int, default=8000)
        p.add_argument("--two-stage", action="store_true")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    settings = load(a.config) if a.command != "init" and os.path.exists(a.config) else EngineConfig()
    a.settings = settings if not a.profile else EngineConfig(**{**vars(settings), "profile": PROFILES[a.profile]})
    a.provider = provider_of(a.provider, a.settings.embedding_dim)
    COMMANDS[a.command](spark or SparkSession.builder.appName("termloom").getOrCreate(), a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
