"""Command line: python -m fathomline.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from fathomline import __version__
from fathomline.operators import formats, results, search
from fathomline.operators.index import read_lookup
from fathomline.plans import pipeline
from fathomline.plans.progress import Progress
from fathomline.schema import KEYS, QuerySet, check_key


def _shown(c: argparse.ArgumentParser) -> None:
    c.add_argument("--page", type=int, default=0)
    c.add_argument("--save")
    for flag in ("--no-empty", "--no-hashes", "--email-only", "--password-only", "--json"):
        c.add_argument(flag, action="store_true")


def _lookups(spark: SparkSession, given: list[str]) -> dict[str, DataFrame]:
    found = {}
    for each in given:
        key, _, path = each.partition("=")
        found[check_key(key, KEYS)] = read_lookup(spark, path)
    return found


def _print(found: results.ResultSet, a: argparse.Namespace) -> None:
    print(json.dumps(found.to_dict()) if a.json else results.table_text(found, a.no_empty, a.no_hashes, a.email_only, a.password_only))


def _ask(a: argparse.Namespace) -> None:
    """Asks a server, without Spark; saving adds the fetched page's lines to a file."""
    from fathomline.server import Client

    body = Client(a.url, a.token, a.timeout, not a.skip_verify, a.proxy).query(QuerySet(**{a.key: a.value}, page=a.page))
    found = results.ResultSet(body["count"], body["page"], body["pages"], body["results"])
    _print(found, a)
    if a.save:
        with open(a.save, "a", encoding="utf-8") as f:
            f.writelines(line + "\n" for line in results.fetched_lines(found, a.no_empty, a.no_hashes, a.email_only, a.password_only))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fathomline")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("normalize", help="raw lines to JSON records")
    c.add_argument("target", nargs="+")
    c.add_argument("--output", required=True)
    c.add_argument("--format", default="colon-newline", choices=formats.supported())
    c.add_argument("--recursive", action="store_true")
    c.add_argument("--skip-prefix")
    c.add_argument("--skip-suffix")
    c.add_argument("--overwrite", action="store_true", help="replace the output in place of adding to it")
    c.add_argument("--progress", action="store_true")
    c = sub.add_parser("dedup", help="distinct lines")
    c.add_argument("target", nargs="+")
    c.add_argument("--output", required=True)
    c.add_argument("--append", action="store_true")
    c.add_argument("--seen", help="table of lines that earlier runs emitted")
    c.add_argument("--save", help="table to add the emitted lines to")
    c.add_argument("--progress", action="store_true")
    c = sub.add_parser("index", help="a sorted lookup of one key")
    c.add_argument("records")
    c.add_argument("--output", required=True)
    c.add_argument("--key", default="email", choices=KEYS)
    c.add_argument("--partitions", type=int)
    c.add_argument("--offsets", action="store_true", help="an unsorted index of the offsets in one file, for sort")
    c.add_argument("--progress", action="store_true")
    c = sub.add_parser("sort", help="an index of offsets in the order of its digests")
    c.add_argument("index")
    c.add_argument("--output", required=True)
    c.add_argument("--partitions", type=int, default=200)
    c.add_argument("--progress", action="store_true")
    c = sub.add_parser("auto", help="distinct records and the lookups of several keys")
    c.add_argument("input")
    c.add_argument("--output", required=True)
    c.add_argument("--keys", default="user,email")
    c.add_argument("--recursive", action="store_true")
    c.add_argument("--partitions", type=int)
    c = sub.add_parser("search", help="equality search in a lookup")
    c.add_argument("lookup", help="a lookup of the key, or with --lines a sorted index of offsets")
    c.add_argument("key", choices=KEYS)
    c.add_argument("value")
    c.add_argument("--lines", help="the file of JSON lines that the offsets are of")
    _shown(c)
    c = sub.add_parser("query", help="ask a server")
    c.add_argument("key", choices=KEYS)
    c.add_argument("value")
    c.add_argument("--url", required=True)
    c.add_argument("--token", default="")
    c.add_argument("--timeout", type=float, default=30)
    c.add_argument("--proxy")
    c.add_argument("--skip-verify", action="store_true", help="take any certificate")
    _shown(c)
    c = sub.add_parser("serve", help="answer JSON requests over HTTP")
    c.add_argument("lookups", nargs="+", metavar="KEY=LOOKUP", help="a lookup for each key to be answered")
    c.add_argument("--host", default="127.0.0.1")
    c.add_argument("--port", type=int, default=8888)
    c.add_argument("--paged", action="store_true")
    c.add_argument("--certificate")
    c.add_argument("--private-key")
    sub.add_parser("version")
    sub.add_parser("template", help="the default curation as JSON")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    if a.command == "version":
        print(__version__)
        return 0
    if a.command == "template":
        print(json.dumps(pipeline.Curation.template(), indent=2))
        return 0
    if a.command == "query":
        _ask(a)
        return 0
    progress = Progress() if getattr(a, "progress", False) else None
    spark = spark or SparkSession.builder.appName("fathomline").getOrCreate()
    if a.command == "normalize":
        pipeline.normalize_stage(spark, a.target, a.output, a.format, a.recursive, a.skip_prefix, a.skip_suffix, overwrite=a.overwrite, progress=progress)
    elif a.command == "dedup":
        pipeline.dedup_stage(spark, a.target, a.output, a.append, a.seen, a.save, progress)
    elif a.command == "index" and a.offsets:
        pipeline.offsets_stage(spark, a.records, a.output, a.key, progress)
    elif a.command == "index":
        pipeline.index_stage(spark, a.records, a.output, a.key, a.partitions, progress)
    elif a.command == "sort":
        pipeline.sort_stage(spark, a.index, a.output, a.partitions, progress)
    elif a.command == "auto":
        made = pipeline.curate(spark, pipeline.Curation(a.input, a.output, tuple(a.keys.split(",")), a.recursive, a.partitions))
        print(json.dumps({"records": made.records, "lookups": made.lookups}))
    elif a.command == "serve":
        from fathomline.server import serve

        serve(_lookups(spark, a.lookups), a.host, a.port, a.paged, a.certificate, a.private_key)
    else:
        rows = search.search_stored(spark, a.lookup, a.lines, a.key, a.value) if a.lines else read_lookup(spark, a.lookup)
        found = results.handle_paged(rows, QuerySet(**{a.key: a.value}, page=a.page))
        if a.save:
            page = results.shown(search.search(rows, a.key, a.value), a.no_empty, a.no_hashes)
            results.save(page, a.save, email_only=a.email_only, password_only=a.password_only)
        _print(found, a)
    for line in progress.lines() if progress else ():
        print(line, file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
