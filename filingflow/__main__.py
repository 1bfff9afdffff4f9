"""Command line: ``python -m filingflow unpack|mirror|units|translate|config``. Known errors go to stderr with exit code 2."""

from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Callable
from functools import partial

from .config import TEMPLATE, Config, FilingError, Model, loads, need_model
from .session import local_session


#: Below the log of answers, where Spark's readers pass by names with an underscore.
JOURNAL = "_journal"


def _load(file: str | None) -> Config:
    if not file:
        return Config()
    with open(file, encoding="utf-8") as f:
        return loads(f.read())


def provider_factory(name: str, model: Model) -> Callable:
    """A factory from ``module:function``, a function of the model's settings that makes a provider; one runs per partition."""
    module, _, function = name.partition(":")
    try:
        return partial(getattr(importlib.import_module(module), function), model)
    except (ImportError, AttributeError) as e:
        raise FilingError(f"no provider {name}: {e}") from e


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="filingflow")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, text in (("unpack", "split bundles below a folder into files"), ("mirror", "unpack what a mirror has of a ticker and form"), ("translate", "translate pages below a folder"), ("units", "write the units of pages below a folder as Parquet")):
        own = commands.add_parser(name, help=text)
        own.add_argument("source")
        own.add_argument("output")
        own.add_argument("--overwrite", action="store_true")
        if name == "mirror":
            own.add_argument("--ticker", required=True)
            own.add_argument("--form", required=True)
            own.add_argument("--after", help="YYYY-MM-DD")
            own.add_argument("--before", help="YYYY-MM-DD")
            own.add_argument("--limit", type=int)
        if name == "translate":
            own.add_argument("--config", required=True)
            own.add_argument("--provider", required=True, help="module:function that makes a provider of a model's settings")
            own.add_argument("--cache", help="folder of the log of answers, read first and appended to")
    check = commands.add_parser("config", help="print a template, or check a file")
    check.add_argument("file", nargs="?")
    return parser


def _unpack(spark, args, rows) -> None:
    from .plans.translate import unpack
    from .sources.sink import write_files

    files, documents = unpack(rows)
    if documents.isEmpty():
        raise FilingError("no documents found")
    print(write_files(files, args.output, args.overwrite), "files")


def _translate(spark, args) -> None:
    from pyspark.sql import functions as F

    from .operators import cache as C
    from .plans.translate import outputs, translate
    from .sources.files import read_pages
    from .sources.sink import write_files
    from .stages import Files

    config = _load(args.config)
    model, second = need_model(config), config.fallback_model
    source, output = Files(spark, args.source), Files(spark, args.output)
    if source.real == output.real:
        raise FilingError("output must not be the source")
    if not source.exists():
        raise FilingError(f"no such file or folder: {args.source}")
    pages = read_pages(spark, str(source))
    log = Files(spark, args.cache) if args.cache and config.cache.enabled else None
    known = C.read_log(spark, str(log), pages) if log and log.exists() else None
    journal = f"{log}/{JOURNAL}" if log else None
    ran = translate(pages, provider_factory(args.provider, model), provider_factory(args.provider, second) if second else None, known, config, run=C.next_run(known) if known is not None else 1, journal=journal)
    # names follow the folders below the source, which is a prefix of each page's address; a single page has its own name
    below = F.regexp_replace(F.substr("doc_id", F.lit(len(str(source)) + 1)), "^/+", "")
    names = pages.select("doc_id", F.when(below == "", F.element_at(F.split("doc_id", "/"), -1)).otherwise(below).alias("name"))
    print(write_files(outputs(ran, names, config), str(output), args.overwrite), "files")
    if log:
        C.append(ran.cache_rows, str(log))
        Files(spark, ran.stages.base).remove()  # the log of answers has them now


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        if args.command == "config":
            print(_load(args.file) if args.file else TEMPLATE, end="" if not args.file else "\n")
            return 0
        from .operators.html_units import extract_units
        from .sources.files import read_mirror, read_pages, read_submissions

        spark = local_session()
        if args.command == "unpack":
            _unpack(spark, args, read_submissions(spark, args.source))
        elif args.command == "mirror":
            wanted = spark.createDataFrame([(args.ticker, args.form, args.after, args.before, args.limit)], "ticker string, form string, after string, before string, limit int")
            _unpack(spark, args, read_mirror(spark, args.source, wanted))
        elif args.command == "translate":
            _translate(spark, args)
        else:
            extract_units(read_pages(spark, args.source)).write.mode("overwrite" if args.overwrite else "errorifexists").parquet(args.output)
    except (FilingError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
