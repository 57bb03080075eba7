"""The command line: ``python -m canopyloom FOLDER QUERY`` answers a query from the tables of a folder.

Parameters come from the defaults, then from the environment (CANOPYLOOM_MICRO_BUDGET
and the like), then from options. The providers are given as module:function: ``embed``
turns the query into a vector, ``generate`` a prompt into an answer, ``translate`` a
query into keywords. Exit codes: 0 answered, 1 failed, 2 wrong arguments.
"""

from __future__ import annotations

import argparse
import dataclasses
import importlib
import sys
from collections.abc import Callable, Sequence

from canopyloom.params import MacroParams, MicroParams, from_environment


def provider(name: str | None) -> Callable | None:
    """The function that module:function names."""
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("canopyloom", description="Answers a query from a hierarchical corpus.")
    out.add_argument("folder", help="folder or URI of the corpus tables")
    out.add_argument("query")
    out.add_argument("--mode", choices=("micro", "macro"), default="micro")
    out.add_argument("--format", choices=("text", "json", "markdown"), default="text")
    out.add_argument("--output", help="write the answer to this file")
    out.add_argument("--embed", required=True, metavar="MODULE:FUNCTION")
    out.add_argument("--generate", metavar="MODULE:FUNCTION")
    out.add_argument("--translate", metavar="MODULE:FUNCTION")
    out.add_argument("--cache", help="folder of expanded queries")
    for kind, prefix in ((MicroParams, "micro"), (MacroParams, "macro")):
        for f in dataclasses.fields(kind):
            cast = {bool: lambda x: x.lower() in ("1", "true", "yes")}.get(type(f.default), type(f.default))
            out.add_argument(f"--{prefix}-{f.name.replace('_', '-')}", type=cast, default=None, metavar=str(f.default))
    return out


def main(argv: Sequence[str] | None = None, spark=None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        from pyspark.sql import SparkSession

        from canopyloom.plans import answer
        from canopyloom.shipping import ship
        from canopyloom.sources import tables

        spark = spark or SparkSession.builder.getOrCreate()
        ship(spark)
        kind = MicroParams if args.mode == "micro" else MacroParams
        own = {f.name: getattr(args, f"{args.mode}_{f.name}") for f in dataclasses.fields(kind)}
        params = dataclasses.replace(from_environment(kind, args.mode), **{k: x for k, x in own.items() if x is not None})
        corpus = tables.load_all(spark, args.folder)
        units, reports = tables.retrieval_views(corpus)
        cache = tables.QueryCache(args.cache) if args.cache else None
        expansion = answer.expand_query(args.query, provider(args.translate), cache)
        vector = provider(args.embed)(expansion.expanded or args.query)
        result = answer.answer(units, reports, corpus.relationships, args.query, vector, args.mode, params, provider(args.generate), expansion=expansion)
        text = answer.render(result, args.format)
    except Exception as e:  # whatever fails is told, and is exit code 1
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    if args.output:
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(text + "\n")
    else:
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
