"""Command line: ``python -m spanloom FOLDER COMMAND [ARGUMENT ...]``; rows as JSON."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine

COMMANDS = {
    "read": ("read", 1), "scan": ("scan", 0), "search": ("search", 2), "retrieve": ("retrieve", 1), "fast-context": ("fast_context", 1),
    "graph-build": ("graph_build", 0), "graph-inspect": ("graph_inspect", 1), "impact": ("impact", 1), "tests": ("tests", 1),
    "index-build": ("index_build", 0), "index-status": ("index_status", 0), "index-dirty": ("index_dirty", 0), "index-validate": ("index_validate", 0),
    "index-update": ("index_update", 0), "index-purge": ("index_purge", 0), "context-lite": ("context_lite", 0), "bench-warm": ("bench_warm", 1),
    "store-status": ("store_status", 1), "store-build": ("store_build", 0), "store-purge": ("store_purge", 0), "derived-validate": ("derived_validate", 0),
    "derived-build": ("derived_build", 0), "derived-inspect": ("derived_inspect", 1), "derived-purge": ("derived_purge", 0),
    "dense-build": ("dense_build", 0), "dense-search": ("dense_search", 1), "dense-purge": ("dense_purge", 0),
    "provider-status": ("provider_status", 0), "provider-audit": ("provider_audit", 0), "version": ("version", 0), "citations-validate": ("validate_citations", 1),
}


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="spanloom", description=__doc__)
    parser.add_argument("folder")
    parser.add_argument("command", choices=sorted(COMMANDS))
    parser.add_argument("argument", nargs="*")
    parser.add_argument("--root", help="folder of the engine's tables")
    parser.add_argument("--experimental", action="store_true")
    given = parser.parse_args(arguments)
    name, most = COMMANDS[given.command]
    if len(given.argument) > most:
        parser.error(f"{given.command} takes {most} arguments at most")
    spark = SparkSession.builder.appName("spanloom").getOrCreate()
    engine = Engine.over_folder(spark, given.folder, given.root)
    values = list(given.argument)
    if name == "validate_citations":
        values = [spark.read.text(values[0], wholetext=True)]
    options = {"experimental": True} if given.experimental and name in ("derived_build", "dense_build") else {}
    found = getattr(engine, name)(*values, **options)
    if isinstance(found, DataFrame):
        for row in found.toJSON().toLocalIterator():
            print(row)
    else:
        print(found)


if __name__ == "__main__":
    main()
