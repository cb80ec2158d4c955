"""Command line: ``python -m mendspan.cli --db FOLDER scan --source TREE`` and so on."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession

from mendspan import __version__
from mendspan.operators import directories, report
from mendspan.plans.library import Library
from mendspan.sources.store import Store

# The share of cores and of memory that each preset takes.
THROTTLES = {"background": (0.5, 0.8), "balanced": (0.9, 0.85), "fullspeed": (1.0, 0.95), "custom": (0.9, 0.85)}


def is_prerelease(version: str) -> bool:
    """Whether a version is one before a release: it has letters after its numbers, such as 1.2.0-rc1."""
    return any(c.isalpha() for c in version.lstrip("vV"))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mendspan")
    p.add_argument("--db", default="mendspan-catalog")
    p.add_argument("--log-level", default="WARN")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    scan = sub.add_parser("scan")
    scan.add_argument("--source", required=True)
    scan.add_argument("--label")
    scan.add_argument("--resume", action=argparse.BooleanOptionalAction, default=True)
    scan.add_argument("--skip-indexed", action=argparse.BooleanOptionalAction, default=True)
    scan.add_argument("--min-media-ratio", type=float, default=directories.MEDIA_RATIO)
    scan.add_argument("--exclude", action="append", default=[])
    scan.add_argument("--force-rescan", action="store_true")
    scan.add_argument("--list-only", action="store_true")
    for name in ("quickhash", "fullhash", "analyze"):
        stage = sub.add_parser(name)
        stage.add_argument("--throttle", choices=THROTTLES, default="balanced")
        stage.add_argument("--cpu", type=float)
        stage.add_argument("--ram", type=float)
        if name == "analyze":
            stage.add_argument("--limit", type=int)
    sub.add_parser("cluster").add_argument("--hamming", type=int, default=8)
    sub.add_parser("select")
    org = sub.add_parser("organize")
    org.add_argument("--output", required=True)
    org.add_argument("--dry-run", action="store_true")
    every = sub.add_parser("all")
    every.add_argument("--source", required=True)
    every.add_argument("--output", required=True)
    every.add_argument("--label")
    every.add_argument("--dry-run", action="store_true")
    sub.add_parser("status")
    sub.add_parser("drives")
    return p


def cores(args: argparse.Namespace) -> int:
    """Cores of a local session: by the preset, or ``--cpu`` per cent of them."""
    share = args.cpu / 100 if getattr(args, "cpu", None) else THROTTLES[getattr(args, "throttle", "fullspeed")][0]
    return max(1, int((os.cpu_count() or 1) * share))


def memory(args: argparse.Namespace) -> int | None:
    """MB of a local session: by the preset, or ``--ram`` per cent of all; Spark's own choice for other commands."""
    if not hasattr(args, "throttle"):
        return None
    share = args.ram / 100 if args.ram else THROTTLES[args.throttle][1]
    total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") >> 20
    return max(1024, int(total * share))


def session(args: argparse.Namespace) -> SparkSession:
    """The session of ``spark-submit``, or a local one of so many cores."""
    builder = SparkSession.builder.appName("mendspan").config("spark.sql.session.timeZone", "UTC")
    if "PYSPARK_GATEWAY_PORT" not in os.environ and "PYSPARK_SUBMIT_ARGS" not in os.environ:
        builder = builder.master(f"local[{cores(args)}]")
        if (mb := memory(args)) is not None:
            builder = builder.config("spark.driver.memory", f"{mb}m")
    return builder.getOrCreate()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or session(args)
    spark.sparkContext.setLogLevel(args.log_level)
    library = Library(Store(spark, args.db))
    run = {
        "quickhash": library.quickhash,
        "fullhash": library.fullhash,
        "analyze": lambda: library.analyze(args.limit),
        "cluster": lambda: library.cluster(args.hamming),
        "select": lambda: {"clusters": library.select().count()},
        "organize": lambda: library.organize(args.output, args.dry_run),
        "all": lambda: library.run_all(args.source, args.output, args.label, args.dry_run),
        "status": library.status,
    }
    if args.command == "scan" and args.list_only:
        for r in directories.print_tree(library.discover(args.source, args.min_media_ratio)).toLocalIterator():
            print(r["line"])
    elif args.command == "scan":
        print(json.dumps(library.scan(args.source, args.label, tuple(args.exclude), resume=args.resume, skip_indexed=args.skip_indexed, force=args.force_rescan)))
    elif args.command == "drives":
        for r in report.drives(library.store.read("drives")).toLocalIterator():
            print(f"{r['volume_serial']}  {r['label']}  {r['source_root']}")
    else:
        print(json.dumps(run[args.command](), default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
