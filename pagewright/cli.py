"""Command line: parse files, or run a benchmark manifest."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .functions.paths import distinct_outputs
from .operators.batch import run_batch, run_benchmark
from .sources import sinks
from .sources.config import Config
from .sources.files import expand_inputs
from .sources.readers import read_documents
from .sources.service import POLICIES, check_models, device

_SERVICE = ("api_command", "api_host", "api_port", "api_start_timeout", "api_url", "auto_install_runtime", "device", "download_dir", "model_dir", "model_policy", "model_source", "runtime_package")


def _flags(command: argparse.ArgumentParser, *names: str) -> None:
    for name in names:
        command.add_argument(f"--{name}", action="store_true")


def build_parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pagewright")
    commands = top.add_subparsers(dest="command", required=True)
    p = commands.add_parser("parse")
    p.add_argument("inputs", nargs="+")
    _flags(p, "batch", "skip-existing", "metrics", "auto-install-runtime")
    for option in ("engine", "device", "model-dir", "download-dir", "api-url", "api-host", "api-command", "model-source", "runtime-package", "output", "output-dir"):
        p.add_argument(f"--{option}")
    for number, kind in {"max-workers": int, "api-start-timeout": float, "api-port": int}.items():
        p.add_argument(f"--{number}", type=kind)
    p.add_argument("--model-policy", choices=POLICIES)
    p.add_argument("--format", default="markdown")
    b = commands.add_parser("benchmark")
    b.add_argument("manifest")
    _flags(b, "auto-install-runtime")
    for option, default in {"max-workers": 1, "format": "json", "output-dir": "reports"}.items():
        b.add_argument(f"--{option}", default=default, type=type(default))
    for option in ("engine", "api-url", "device", "model-dir", "download-dir", "runtime-package"):
        b.add_argument(f"--{option}")
    return top


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    top = build_parser()
    args = top.parse_args(arguments)
    config = Config()
    engine = args.engine or config.get("default_pdf_engine")
    service = config.engine(engine, **{k: getattr(args, k, None) for k in _SERVICE})
    if "model_policy" in service:  # an engine that is a service: what it would refuse is refused here
        try:
            check_models(service)
            device(service.get("device", "auto"), gpu=False)
        except (RuntimeError, ValueError) as e:
            print(e, file=sys.stderr)
            return 1
    workers = args.max_workers or min(4, os.cpu_count() or 1)
    spark = spark or SparkSession.builder.master(f"local[{workers}]").config("spark.ui.enabled", "false").getOrCreate()
    if args.command == "benchmark":
        _, summary = run_benchmark(spark, args.manifest, args.output_dir, args.engine, args.format)
        print(json.dumps(summary, ensure_ascii=False, indent=2, default=str))
        return 0
    if args.batch and (args.metrics or args.skip_existing or args.max_workers):
        _, summary = run_batch(spark, args.inputs, args.output_dir or "out", engine, args.format, args.metrics, skip_existing=args.skip_existing)
        print(json.dumps(summary, ensure_ascii=False, indent=2, default=str))
        return 0
    sources = expand_inputs(args.inputs)
    if not args.batch and len(sources) != 1:
        top.error("parse takes one input unless --batch is given")
    docs = sinks.rendered(read_documents(spark, sources, engine), args.format)
    rows = {r.source: r for r in docs.select("source", "output", "error_class", "error_message").collect()} if not args.batch else {}
    if args.batch:
        names = distinct_outputs(sources, args.format)
        named = spark.createDataFrame(list(zip(sources, names)), "source string, output_path string")
        failed = docs.where("error_class is not null").select("source", "error_message").collect()
        if failed:
            print(f"{failed[0].source}: {failed[0].error_message}", file=sys.stderr)
            return 1
        written = sinks.write_documents(docs.join(named, "source"), args.output_dir or "out").collect()
        return int(any(r.error_class for r in written))
    row = rows[sources[0]]
    if row.error_class:
        print(f"{row.source}: {row.error_message}", file=sys.stderr)
        return 1
    target = args.output or (os.path.join(args.output_dir, distinct_outputs(sources, args.format)[0]) if args.output_dir else None)
    if target:
        os.makedirs(os.path.dirname(os.path.abspath(target)), exist_ok=True)
        with open(target, "w", encoding="utf-8") as f:
            f.write(row.output)
    else:
        print(row.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
