"""Command line: documents in, reports out.

    python -m leafwork.cli INPUT --output DIR [--html] [--json] [--xlsx] [--extract] [--text] [--sources] [--crops]

Exit codes: 0 all done, 1 the run failed, 2 the input is not there or not what was said.
"""

from __future__ import annotations

import argparse
import sys
import uuid
from pathlib import Path

from .config import Settings, default_output_dir, input_path, logger, session
from .plans.process import LAYOUT, TEXT, process
from .sources import sinks
from .sources.versions import Folder
from .streaming import jobs

ON, OFF = ("html", "json", "xlsx", "extract", "sources", "crops"), ("markdown", "summary", "compress_images")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="leafwork", description="Turn documents into tables and reports.")
    p.add_argument("input", nargs="?", help="Parquet of layout blocks, or of (doc_id, text) with --text; asked for if left out")
    p.add_argument("-o", "--output", "--output-dir", dest="output", help="folder of the results; else OUTPUT_DIR, a desktop folder or ./outputs")
    p.add_argument("--output-name", default="", help="what the names of all files begin with; else the documents' own")
    p.add_argument("--text", action="store_true", help="the input holds plain texts")
    p.add_argument("--image-format", choices=["png", "jpg"])
    for name in ON:
        p.add_argument(f"--{name}", action="store_true")
    for name in OFF:
        p.add_argument(f"--no-{name.replace('_', '-')}", dest=name, action="store_false")
    return p


def settings_of(args: argparse.Namespace, env: dict[str, str] | None = None) -> Settings:
    """Options given stand above those of the environment."""
    base = Settings.from_env(env)
    given = {n: True for n in ON if getattr(args, n)} | {n: False for n in OFF if not getattr(args, n)}
    if args.image_format:
        given["image_format"] = args.image_format
    return Settings(**(base.__dict__ | given))


def unusable(spark, source: str, text: bool) -> str:
    """Why an input cannot be taken, or ""."""
    if not source:
        return "no input given"
    if not Folder(spark, source).exists():
        return f"input does not exist: {source}"
    try:
        have = set(spark.read.parquet(source).columns)
    except Exception as e:  # whatever Spark says of files that are no table
        return f"input is not Parquet: {source} ({jobs.reason(e, 120)})"
    missing = {"doc_id", "text"} - have if text else {"doc_id", "page", "lines"} - have
    return f"input has no column {', '.join(sorted(missing))}: {source}" if missing else ""


def run(argv: list[str] | None = None, ask=input, spark=None, provider=None) -> dict:
    """What the command does, as a dict; ``code`` is its exit code."""
    args = parser().parse_args(argv)
    source = input_path(args.input if args.input else ask("input: "))
    out = str(Path(args.output) if args.output else default_output_dir())
    settings, spark = settings_of(args), spark or session()
    if why := unusable(spark, source, args.text):
        return {"ok": False, "code": 2, "error": why, "warnings": [why], "paths": {}, "output_dir": out}
    file = None
    if "://" not in out:
        Path(out).mkdir(parents=True, exist_ok=True)
        file = Path(out) / "processing.log"
    names = None
    rows = spark.read.parquet(source)
    if "name" in rows.columns:
        names = rows.select("doc_id", "name").distinct()
    record = jobs.reporter(spark, f"{out}/status", uuid.uuid4().hex)
    result = process(rows, out, TEXT if args.text else LAYOUT, settings, provider, names=names, prefix=args.output_name, progress=record, log=logger(file))
    return result | {"output_dir": Path(out), "log": str(file or ""), "code": 0 if result["ok"] else 1}


def main(argv: list[str] | None = None, ask=input, spark=None) -> int:
    result = run(argv, ask, spark)
    print(sinks.serialized(result), file=sys.stdout if result["ok"] else sys.stderr)
    return result["code"]


if __name__ == "__main__":
    sys.exit(main())
