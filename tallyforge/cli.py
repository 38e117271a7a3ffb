"""The command line (API-1, API-2): ``python -m tallyforge process -p a.yaml [b.yaml] | list | version``."""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Sequence
from pathlib import Path
from typing import Any

import yaml

from tallyforge import __version__, registry


def merged(paths: Sequence[str]) -> dict[str, Any]:
    """Root keys of later files replace those of earlier ones."""
    out: dict[str, Any] = {}
    for p in paths:
        own = yaml.safe_load(Path(p).read_text())
        if not isinstance(own, dict):
            raise ValueError(f"{p} isn't a mapping")
        out |= own
    return out


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tallyforge", description="Quality metrics of datasets on Spark.")
    top.add_argument("-v", "--verbose", action="count", default=0)
    top.add_argument("-q", "--quiet", action="store_true")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("version")
    commands.add_parser("list")
    process = commands.add_parser("process")
    process.add_argument("-p", "--process-config", nargs="+", required=True, metavar="FILE")
    process.add_argument("--save-config", metavar="FILE", help="writes the merged configuration")
    return top


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.ERROR if args.quiet else [logging.WARNING, logging.INFO, logging.DEBUG][min(args.verbose, 2)])
    if args.command == "version":
        print(__version__)
        return 0
    if args.command == "list":
        from tallyforge.plans import job  # noqa: F401  registers the processors

        for group in registry.GROUPS:
            print(f"{group}: {', '.join(sorted(registry.found(group)))}")
        return 0
    config = merged(args.process_config)
    if args.save_config:
        Path(args.save_config).write_text(yaml.safe_dump(config, sort_keys=False))
    from pyspark.sql import SparkSession

    from tallyforge.plans.job import run

    spark = SparkSession.builder.appName("tallyforge").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for table, path in run(spark, config).paths.items():
        print(f"{table}: {path}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
