"""Command line. Exit codes: 0 done, 1 a run failed, 2 usage or settings."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

from . import __version__


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("logweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _text(path: str) -> str:
    if path == "-":
        return sys.stdin.read()
    with open(path, encoding="utf-8") as f:
        return f.read()


def _put(path: str, text: str) -> None:
    if path == "-":
        sys.stdout.write(text)
        return
    from .sources.sinks import publish

    temporary = f"{path}.tmp{os.getpid()}"
    with open(temporary, "w", encoding="utf-8") as f:
        f.write(text)
    publish(temporary, path)


def _import(a) -> int:
    from .operators.route import parse_lines
    from .plans.rules import load_rules
    from .sources.lines import read_lines
    from .sources.settings import resolve_compression, resolve_row_group
    from .sources.sinks import write_outputs

    rules = load_rules(a.rules)
    codec, level = resolve_compression({"codec": a.compression, "level": a.compression_level}, rules.compression)
    limit = resolve_row_group({"max_rows": a.max_rows_per_row_group}, rules.row_group)
    lines = read_lines(_spark(), a.inputs).persist()
    failed = [(r["source"], r["error"]) for r in lines.where("error is not null").collect()]
    for source, error in failed:
        logging.error("%s: %s", source, error)
    written = write_outputs(parse_lines(lines.where("error is null"), rules), a.out, codec, level, limit)
    for name, n in written.items():
        logging.info("%s: %d rows", name or "unmatched", n)
    return 1 if failed else 0


def _info(a) -> int:
    from .operators.tools import column_info, footers

    bad = [p for p in a.files if not os.path.exists(p)]
    for p in bad:
        print(f"{p}: cannot be read", file=sys.stderr)
    good = [p for p in a.files if p not in bad]
    spark = _spark()
    per = [json.loads(x) for x in column_info(spark, good).toJSON().collect()] if good else []
    files = [json.loads(x) for x in footers(spark, good).select("path", "size", "rows", "row_groups", "version", "created_by").distinct().toJSON().collect()] if good else []
    for f in files:
        f["columns"] = sorted((c for c in per if c["path"] == f["path"]), key=lambda c: c["column"])
    if a.format == "json":
        print(json.dumps(files))
    else:
        for f in files:
            print(f"{f['path']}: {f['rows']} rows, {f['row_groups']} row groups, {f['size']} bytes, {f['created_by']}")
            for c in f["columns"]:
                print(f"  {c['column']}: {c['n_values']} values, {c['compressed']} of {c['uncompressed']} bytes" + (f" ({c['pct']:.1f} %)" if "pct" in c else ""))
    return 1 if bad else 0


def _cat(a) -> int:
    from .operators.tools import concat_parquet

    concat_parquet(_spark(), a.sources, a.output, {"codec": a.compression, "level": a.compression_level}, a.max_rows_per_row_group)
    return 0


def _dump(a) -> int:
    import tempfile

    from .operators.tools import dump

    if a.dst != "-":
        dump(_spark(), a.src, a.dst)
        return 0
    with tempfile.TemporaryDirectory() as d:
        dump(_spark(), a.src, f"{d}/dump")
        sys.stdout.write(_text(f"{d}/dump"))
    return 0


def _restore(a) -> int:
    from .operators.tools import restore
    from .sources.settings import ALIASES, SettingsError

    if a.compression_level in ALIASES and not a.compression:
        raise SettingsError("a named level needs --compression")
    restore(_spark(), a.src, a.dst, {"codec": a.compression, "level": a.compression_level})
    return 0


def _rewrite(a) -> int:
    from .plans import rewrite

    text, n = getattr(rewrite, a.command)(_text(a.src))
    _put(a.dst, text)
    logging.info("%d rules rewritten", n)
    return 0


def _constant(a) -> int:
    from .plans import rewrite

    print({"scaffold": lambda: rewrite.SCAFFOLD, "schema": lambda: json.dumps(rewrite.json_schema(), indent=2), "version": lambda: f"logweave {__version__}"}[a.command](), end="" if a.command == "scaffold" else "\n")
    return 0


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="logweave")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name, run, *places, settings=False):
        p = sub.add_parser(name)
        for x in places:
            p.add_argument(x.rstrip("+"), **({"nargs": "+"} if x.endswith("+") else {}))
        if settings:
            p.add_argument("--compression")
            p.add_argument("--compression-level")
            p.add_argument("--max-rows-per-row-group", type=int)
        p.add_argument("--log-format", choices=["text", "json"], default="text")
        p.add_argument("-v", action="store_true")
        p.set_defaults(run=run)
        return p

    p = command("import", _import, "inputs+", settings=True)
    p.add_argument("--rules", required=True)
    p.add_argument("--out", default="./out")
    command("info", _info, "files+").add_argument("--format", choices=["text", "json"], default="text")
    command("cat", _cat, "sources+", settings=True).add_argument("--output", required=True)
    command("dump", _dump, "src", "dst")
    command("restore", _restore, "src", "dst", settings=True)
    for name in ("expand", "collapse"):
        command(name, _rewrite, "src", "dst")
    for name in ("scaffold", "schema", "version"):
        command(name, _constant)
    try:
        a = top.parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    fmt = '{"time":"%(asctime)s","level":"%(levelname)s","msg":"%(message)s"}' if a.log_format == "json" else "%(asctime)s %(levelname)s %(message)s"
    logging.basicConfig(level=logging.DEBUG if a.v else logging.INFO, format=fmt, stream=sys.stderr)
    from .sources.settings import SettingsError

    try:
        return a.run(a)
    except SettingsError as e:
        logging.error("%s", e)
        return 2
    except Exception as e:  # noqa: BLE001
        logging.error("%s", e)
        return 1


if __name__ == "__main__":
    sys.exit(main())
