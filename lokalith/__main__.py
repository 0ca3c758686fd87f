"""Command line: ``python -m lokalith extract|tables|strings|search|translate|encode|patch ...``. Paths may be of any file system Spark reads."""

from __future__ import annotations

import argparse
import functools
import importlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lokalith.plans import catalogs
from lokalith.sources import locres


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lokalith", description=__doc__)
    jobs = top.add_subparsers(dest="job", required=True)
    one = jobs.add_parser("extract", help="assets and string tables of a directory to one catalog")
    many = jobs.add_parser("tables", help="string tables of a directory to one catalog each")
    for job in (one, many):
        job.add_argument("source")
        job.add_argument("target")
        job.add_argument("--path", default="", help="only files whose path holds this")
    for flag, text in {
        "--all": "folders without text too", "--skip-uasset": "no packages", "--skip-uexp": "no exports", "--no-underscore": "no sources with an underscore",
        "--no-uppercase": "no sources all in upper case", "--hash": "checksum in the key", "--url": "file in the key", "--table-format": "bars instead of commas, no header",
        "--qmarks": "sources quoted, translations as they are",
    }.items():
        one.add_argument(flag, action="store_true", help=text)
    for flag, text in {"--skipped": "folder for records without a valid hash", "--duplicates": "folder for keys with different texts"}.items():
        one.add_argument(flag, default="", help=text)
    for job in (one, many):
        job.add_argument("--damaged", default="", help="folder for string tables that can't be read")
    strings = jobs.add_parser("strings", help="raw copies of the string tables of a directory")
    strings.add_argument("source")
    strings.add_argument("target")
    strings.add_argument("--path", default="", help="only files whose path holds this")
    find = jobs.add_parser("search", help="texts of a directory that hold a part, as JSON lines in a folder")
    find.add_argument("source")
    find.add_argument("part")
    find.add_argument("target")
    speak = jobs.add_parser("translate", help="ask for the blank translations of a catalog; a repeated run asks for what is missing")
    speak.add_argument("csv")
    speak.add_argument("target")
    speak.add_argument("--with", dest="asker", required=True, metavar="MODULE:FUNCTION", help="takes a request and returns the answer")
    speak.add_argument("--lang", default="", help="given to the function as lang")
    speak.add_argument("--journal", default="", help="folder of paid answers; by default beside the catalog")
    speak.add_argument("--batch-size", type=int, default=150)
    speak.add_argument("--parallel", type=int, default=1)
    one.add_argument("--headmark", nargs=2, default=("", ""), metavar=("FIRST", "LAST"), help="first and last line")
    encode = jobs.add_parser("encode", help="a catalog to a string table")
    encode.add_argument("csv")
    encode.add_argument("target")
    encode.add_argument("--number", type=int, help="explicit version number of a compact table")
    encode.add_argument("--encrypted", action="store_true")
    patch = jobs.add_parser("patch", help="translations of a catalog into encrypted string tables")
    patch.add_argument("template")
    patch.add_argument("csv")
    patch.add_argument("target")
    for job in (encode, patch):
        job.add_argument("--key", default="", help="cipher key, 64 hex digits")
        job.add_argument("--mark", help="end mark of encrypted values")
    return top


def run(spark: SparkSession, argv: list[str]) -> dict:
    """The counters of the job."""
    a = parser().parse_args(argv)
    if a.job == "extract":
        done = catalogs.extract_directory(
            spark, a.source, a.target, part=a.path, all_folders=a.all, skip_packages=a.skip_uasset, skip_exports=a.skip_uexp, no_underscore=a.no_underscore,
            no_uppercase=a.no_uppercase, with_hash=a.hash, with_url=a.url, table=a.table_format, banner=a.headmark[0], footer=a.headmark[1], plain_translation=a.qmarks,
            skipped=a.skipped, duplicates=a.duplicates, damaged=a.damaged,
        )
    elif a.job == "tables":
        done = catalogs.extract_tables(spark, a.source, a.target, a.path, a.damaged)
    elif a.job == "strings":
        done = catalogs.dump_tables(spark, a.source, a.target, a.path)
    elif a.job == "search":
        catalogs.search(spark, a.source, a.part).write.mode("overwrite").json(a.target)
        done = spark.read.schema("src_path string").json(a.target).agg(F.count(F.lit(1)).alias("found"))
    elif a.job == "translate":
        module, _, name = a.asker.partition(":")
        ask = getattr(importlib.import_module(module), name)
        ask = functools.partial(ask, lang=a.lang) if a.lang else ask
        done = catalogs.translate_catalog(spark, a.csv, a.target, ask, a.journal or a.csv.rstrip("/") + ".journal", a.batch_size, a.parallel)
    else:
        key = F.lit(bytes.fromhex(a.key)) if a.key else None
        if a.job == "encode":
            done = catalogs.encode_catalog(spark, a.csv, a.target, locres.ENCRYPTED if a.encrypted else locres.COMPACT, a.number, key, a.mark)
        else:
            if key is None or a.mark is None:
                raise SystemExit("patch needs --key and --mark")
            done = catalogs.patch_tables(spark, a.template, a.csv, a.target, key, a.mark)
    return done.head().asDict()


if __name__ == "__main__":
    import sys

    print(run(SparkSession.builder.appName("lokalith").getOrCreate(), sys.argv[1:]))
