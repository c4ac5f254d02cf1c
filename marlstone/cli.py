"""Command line: prepare manifests, look at models and prices, estimate and run benchmarks, build reports, look after the store, run queries."""

from __future__ import annotations

import argparse
import json
import pathlib
import uuid

from . import queries
from .operators.money import global_stats
from .operators.store import Store
from .plans import commands, config
from .plans.backend import BACKENDS
from .reports import render, tables
from .session import session

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="marlstone")
    own = p.add_subparsers(dest="command", required=True)
    own.add_parser("version")
    own.add_parser("queries")
    query = own.add_parser("query", help="run a query over a folder of tables")
    query.add_argument("name", choices=sorted(queries.QUERIES))
    query.add_argument("tables")
    query.add_argument("--out", help="write Parquet there in place of showing rows")
    made = {name: own.add_parser(name, help=text) for name, text in {
        "prepare": "write the manifests", "models": "list the models", "pricing": "listed against configured prices",
        "estimate": "what benchmarks would cost", "run": "ask, score, and write a summary",
    }.items()}
    for sub in made.values():
        sub.add_argument("config", help="a file or folder of settings")
    made["prepare"].add_argument("--force", action="store_true")
    made["prepare"].add_argument("--only", choices=commands.MANIFESTS)
    made["models"].add_argument("--check", metavar="LISTING", help="a listing's JSON to compare with")
    made["pricing"].add_argument("listing")
    made["pricing"].add_argument("--save", action="store_true")
    for name in ("estimate", "run"):
        made[name].add_argument("--model", required=name == "run")
        made[name].add_argument("--benchmark", choices=commands.BENCHMARKS)
        made[name].add_argument("--language")
    made["run"].add_argument("--run-id")
    made["run"].add_argument("--judge", help="the name of a judge in the settings")
    made["run"].add_argument("--listing", help="a listing's JSON: refuse what the model doesn't take")
    made["run"].add_argument("--backend", choices=sorted(BACKENDS), default="stub")
    for flag in ("--dry-run", "--retry-failed", "--force"):
        made["run"].add_argument(flag, action="store_true")
    report = own.add_parser("report", help="render summaries into a folder")
    report.add_argument("summaries")
    report.add_argument("out")
    for name in ("stats", "clear-failed"):
        cache = own.add_parser(f"cache-{name}")
        cache.add_argument("store")
        if name == "clear-failed":
            cache.add_argument("--model")
            cache.add_argument("--benchmark")
    return p


def _settled(args: argparse.Namespace) -> None:
    """A command that works from settings."""
    path, spark = pathlib.Path(args.config), session()
    tree = config.load_folder(args.config) if path.is_dir() else config.load(path.read_text(encoding="utf-8"))
    match args.command:
        case "prepare":
            for x in commands.prepare(spark, tree, args.force, args.only):
                print(f"{x.name}: {x.status}, {x.count} records")
        case "models":
            commands.models_table(spark, tree, args.check).show(truncate=False)
        case "pricing":
            commands.pricing(spark, tree, args.listing, args.save).show(truncate=False)
        case "estimate":
            commands.estimate(spark, tree, args.model, args.benchmark, args.language).show(truncate=False)
        case "run":
            made = commands.run(spark, tree, args.model, args.run_id or uuid.uuid4().hex[:12], BACKENDS[args.backend](), args.benchmark, args.language, args.dry_run, args.retry_failed, args.force, args.listing, args.judge)
            print(json.dumps({k: made[k] for k in ("run_id", "status", "pending", "stopped", "cost") if k in made}, default=str))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(VERSION)
    elif args.command == "queries":
        print("\n".join(sorted(queries.QUERIES)))
    elif args.command in ("prepare", "models", "pricing", "estimate", "run"):
        _settled(args)
    elif args.command == "query":
        df = queries.QUERIES[args.name](session(), args.tables)
        df.write.mode("overwrite").parquet(args.out) if args.out else df.show(truncate=False)
    elif args.command == "report":
        out = pathlib.Path(args.out)
        out.mkdir(parents=True, exist_ok=True)

        def write(name: str, content: str | bytes) -> None:
            (out / name).write_bytes(content if isinstance(content, bytes) else content.encode())

        print("\n".join(render.generate(tables.read_summaries(session(), args.summaries), write)))
    elif args.command == "cache-stats":
        global_stats(Store(session(), args.store).rows("inference_results")).orderBy("model_id", "benchmark", "status").show(truncate=False)
    elif args.command == "cache-clear-failed":
        print(Store(session(), args.store).clear_failed(args.model, args.benchmark))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
