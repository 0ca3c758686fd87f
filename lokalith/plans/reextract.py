"""Extraction again: only files that were added or changed since the last run are read, removed ones lose their rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lokalith.schema import CATALOG
from lokalith.sources import binscan
from lokalith.streaming.store import Store
from lokalith.workspace import settled

LISTING = "path string, length long, modified timestamp, sha256 string"
Reader = Callable[[DataFrame], DataFrame]


def listing(spark: SparkSession, source: str, glob: str = "*") -> DataFrame:
    """``path, length, modified`` of the files below ``source``; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(source)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """``path, change`` (``added``, ``touched``, ``removed``) of two listings; files of equal length and time are left out."""
    old = before.select(F.col("path").alias("_path"), F.col("length").alias("_length"), F.col("modified").alias("_modified"))
    both = now.join(old, F.col("path") == F.col("_path"), "full_outer")
    change = F.when(F.col("_path").isNull(), "added").when(F.col("path").isNull(), "removed").when((F.col("length") != F.col("_length")) | (F.col("modified") != F.col("_modified")), "touched")
    return both.select(F.coalesce("path", "_path").alias("path"), change.alias("change"), "length", "modified").where("change is not null")


#: Files up to here are read as one value where there is a reader of ranges for larger ones; a task holds one a few times.
WHOLE_BYTES = 16 << 20


def refresh(spark: SparkSession, source: str, state: str, read: Reader, glob: str = "*", buckets: int = 64, read_large: Reader | None = None) -> tuple[DataFrame, dict]:
    """``(rows, counters)``: catalog rows of all files below ``source``, of which ``read(files)`` gets the added and changed ones.

    ``read`` takes ``path, content`` and gives catalog rows with the file in ``src_path``; with ``read_large``, which takes ``path, length``
    and gives the same, files over WHOLE_BYTES go there, and no task holds one. Listings and rows are kept below ``state``. A
    file whose length or time differs is read; if its SHA-256 is the old one it counts as unchanged. Rows of removed files go.
    A run that dies between its two commits is repeated: rows first, then the listing that says they are there.
    """
    files = Store(spark, f"{state}/files", LISTING, ["path"], buckets)
    rows = Store(spark, f"{state}/rows", CATALOG, ["src_path"], buckets)
    before = files.read()
    differs = settled(changes(listing(spark, source, glob), before), "changes")
    present = differs.where("change <> 'removed'").select("path", "length")
    known = before.select("path", F.col("sha256").alias("_old"))
    same = F.coalesce(F.col("sha256") == F.col("_old"), F.lit(False))
    large = None
    if read_large is not None:
        long = F.col("length") > WHOLE_BYTES
        large = settled(binscan.with_digests(present.where(long)).join(known, "path", "left").withColumn("same", same).drop("_old"), "digests")
        present = present.where(~long)
    wanted = present.select("path")
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    paths = [r.path for r in wanted.limit(LISTED + 1).collect()]
    # few files are named to the reader, so no other is opened; of many, the semi join keeps the rest from the scanner
    named = len(paths) <= LISTED and not any(set("[]{}*?\\") & set(p) for p in paths)  # the reader takes such names for patterns
    found = content.load(paths if named else source) if paths else spark.createDataFrame([], "path string, length long, content binary")
    found = (found if large is None else found.where(F.col("length") <= WHOLE_BYTES)).select("path", "content")
    found = found.join(wanted, "path", "left_semi").withColumn("sha256", F.sha2("content", 256))
    told = settled(found.join(known, "path", "left").withColumn("same", same).drop("_old"), "contents")
    changed = told.where("not same")
    digests = told.select("path", "sha256", "same")
    if large is not None:
        digests = digests.unionByName(large.select("path", "sha256", "same"))
    gone = differs.where("change = 'removed'").select("path")
    keys = digests.where("not same").select("path").unionByName(gone).withColumnRenamed("path", "src_path")
    if keys.limit(1).count():
        fresh = settled(read(changed.select("path", "content")), "fresh")
        if large is not None:
            fresh = fresh.unionByName(settled(read_large(large.where("not same").select("path", "length")), "fresh").select(*fresh.columns))
        rows.commit(keys, lambda batch, old: old.join(batch, "src_path", "left_anti").unionByName(fresh.select(*old.columns)))
    new = differs.join(digests.select("path", "sha256"), "path").select("path", "length", "modified", "sha256")
    if differs.limit(1).count():
        files.commit(differs.select("path"), lambda batch, old: old.join(batch, "path", "left_anti").unionByName(new))
    counts = {r["change"]: r["n"] for r in differs.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
    counters = {k: counts.get(k, 0) for k in ("added", "touched", "removed")} | {"read": digests.count(), "changed": digests.where("not same").count()}
    return rows.read(), counters


#: So many files at most are named one by one to the reader.
LISTED = 10_000
