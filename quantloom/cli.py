"""Command line: convert, reformat, annotate."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from quantloom.errors import ConversionError


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("quantloom").getOrCreate()


def main(args: list[str] | None = None) -> int:
    """0: done; 1: refused with a message; 2: wrong use."""
    top = argparse.ArgumentParser(prog="quantloom")
    sub = top.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert")
    c.add_argument("input")
    c.add_argument("levels", nargs="*")
    c.add_argument("--rule", required=True)
    c.add_argument("--parameters", help="JSON file of search parameters")
    c.add_argument("--output", required=True)
    c.add_argument("--prune", action="store_true")
    c.add_argument("--timings")
    r = sub.add_parser("reformat")
    r.add_argument("input")
    r.add_argument("output")
    r.add_argument("--level")
    a = sub.add_parser("annotate")
    a.add_argument("input")
    a.add_argument("annotation")
    a.add_argument("output")
    a.add_argument("--unmatched", choices=("keep", "error", "drop"), default="keep")
    a.add_argument("--include")
    own = top.parse_args(args)
    from quantloom import api
    from quantloom.sources.delimited import read_inferred

    try:
        spark = _session()
        if own.command == "convert":
            parameters = json.loads(Path(own.parameters).read_text()) if own.parameters else None
            job = api.Compiler.from_rule(spark, own.input, own.rule, own.levels or None, parameters).compile()
            groups = api.observation_groups(job.parse(own.prune))
            for group in groups:
                path = own.output if len(groups) == 1 else str(Path(own.output).with_stem(f"{Path(own.output).stem}.{'-'.join(group.levels)}"))
                api.write_levels(group, path)
                api.publish(group, path)
            if own.timings:
                Path(own.timings).write_text(json.dumps(job.timings, indent=1))
        elif own.command == "reformat":
            result = api.read_levels(spark, own.input, own.level)
            api.write_levels(result, own.output)
            api.publish(result, own.output)
        else:
            result, _ = api.annotate_all(api.read_levels(spark, own.input), read_inferred(spark, own.annotation), unmatched=own.unmatched, include=own.include)
            api.write_levels(result, own.output)
            api.publish(result, own.output)
    except ConversionError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
