"""The jobs of the command line: directories to catalogs, catalogs to string tables, patches of string tables.

Each takes folders, writes folders and returns counters as a one-row DataFrame or a list of written files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lokalith.functions import text
from lokalith.operators import catalog
from lokalith.plans import extract, translate
from lokalith.schema import catalog_from
from lokalith.sources import binscan, files, locres, locres_format, locres_parts
from lokalith.workspace import exists, forget, settled

SIDECAR = ".locreshashes"
_MARK = "\x01"


def read_tables(spark: SparkSession, source: str, part: str = "") -> DataFrame:
    """``path, container, content`` of the string tables below ``source``; paths that differ in case only count once a container."""
    found = files.binary_files(spark, source, "*.[lL][oO][cC][rR][eE][sS]")
    plain = F.lower(F.replace("path", F.lit("\\"), F.lit("/")))
    return found.where(F.contains(plain, F.lit(part.replace("\\", "/").lower()))).select("path", extract.container_of(source).alias("container"), "content")


def decorated(rows: DataFrame, with_hash: bool, with_url: bool) -> DataFrame:
    """Keys with the checksum of their source and the file they come from in front, after conflicts were found on plain keys."""
    crc = text.string_crc32(F.col("source")).cast("string") if with_hash else None
    return rows.withColumn("key", text.decorated_key(F.col("key"), crc, F.coalesce("url", "src_path") if with_url else None)) if with_hash or with_url else rows


def merged_with(rows: DataFrame, old: DataFrame, group: str | None = None) -> DataFrame:
    """``rows`` merged with an earlier catalog ``ord, key, source, translation`` (and ``group``), with ``state``."""
    named = lambda df: df if group is None else df.withColumn("key", F.concat_ws(_MARK, group, "key"))
    out = catalog.merge(named(rows), catalog.collapse_old(named(old)))
    if group is None:
        return out
    return out.withColumn(group, F.substring_index("key", _MARK, 1)).withColumn("key", F.substr("key", F.length(group) + 2))


def counted_tables(tables: DataFrame) -> tuple[DataFrame, Observation, Observation]:
    """Decoded ``tables``, and what their one reading will have counted: ``processed`` files, and ``damaged`` ones, which give no entry."""
    read, bad = Observation(), Observation()
    seen = tables.select("path", "content").observe(read, F.count(F.lit(1)).alias("processed"))
    return locres.decoded(seen).observe(bad, F.count_if(F.col("error").isNotNull()).alias("damaged")), read, bad


def extract_directory(
    spark: SparkSession, source: str, target: str, exports: DataFrame | None = None, part: str = "", all_folders: bool = False, skip_packages: bool = False, skip_exports: bool = False,
    no_underscore: bool = False, no_uppercase: bool = False, with_hash: bool = False, with_url: bool = False, table: bool = False, banner: str = "", footer: str = "",
    plain_translation: bool = False, skipped: str = "", duplicates: str = "", damaged: str = "",
) -> DataFrame:
    """One catalog of all assets and string tables below ``source``, merged with what lies at ``target``; returns the merge counters,
    with the string tables ``processed`` and ``damaged``.

    Hashes of string tables go to ``target`` + SIDECAR, of the extracted rows only. Folders for reports, where given: ``skipped``
    gets the records without a valid hash, ``duplicates`` the rows of keys with different texts in one file, ``damaged``
    the tables that could not be read (``path, error`` as JSON).
    """
    options = {"part": part, "all_folders": all_folders, "skip_packages": skip_packages, "skip_exports": skip_exports}
    large = extract.large_assets(spark, source, **options)
    told = extract.asset_records(extract.read_assets(spark, source, **options), large if large.limit(1).count() else None)
    decoded, read, bad = counted_tables(read_tables(spark, source, part))
    entries = settled(decoded, "tables")
    found = extract.scan_assets(None, exports, entries.where("error is null"), no_underscore, no_uppercase, told)
    rows = settled(decorated(found, with_hash, with_url), "extracted")
    if skipped:
        files.write_skipped(binscan.rejected(told).where("reason = 'hash'"), skipped)
    if duplicates:
        conflicts = catalog.conflict_report(extract.asset_rows(None, exports, told=told))
        catalog.by_key(conflicts).select("src_path", "namespace", "key", "source").write.mode("overwrite").json(duplicates)
    if damaged:
        entries.where("error is not null").select("path", "error").write.mode("overwrite").json(damaged)
    files.sidecar_json(rows.withColumn("src_path", F.lit(""))).select("json").write.mode("overwrite").text(target + SIDECAR)
    old = files.read_catalog(spark, target) if exists(spark, target) else spark.createDataFrame([], "ord long, key string, source string, translation string")
    merged = settled(merged_with(rows, old), "merged")  # written first, as the earlier catalog lies where the new one goes
    files.write_catalog(merged, target, table=table, banner=banner, footer=footer, plain_translation=plain_translation, with_hash=with_hash, with_url=with_url)
    return _counters(merged, read, bad, [told, entries, rows, merged])


def _counters(merged: DataFrame, read: Observation, bad: Observation, cut: list[DataFrame]) -> DataFrame:
    spark = merged.sparkSession
    counts = catalog.merge_counters(merged).head().asDict() | {"processed": read.get.get("processed", 0), "damaged": bad.get.get("damaged", 0)}
    forget(*cut)
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{name} long" for name in counts))


def extract_tables(spark: SparkSession, source: str, target: str, part: str = "", damaged: str = "") -> DataFrame:
    """A folder of catalogs, one for each string table below ``source``, merged with what lies at ``target``; returns the merge counters,
    with the tables ``processed`` and ``damaged``.

    Of repeated keys of a table the first stays; conflicts, noise and developer namespaces are not looked for here.
    """
    read, bad = Observation(), Observation()
    tables = read_tables(spark, source, part)
    every = locres.grouped_entries(tables, tables.observe(read, F.count(F.lit(1)).alias("processed")))
    entries = settled(every.observe(bad, F.count_if(F.col("error").isNotNull()).alias("damaged")), "tables")
    if damaged:
        entries.where("error is not null").select("path", "container", "error").write.mode("overwrite").json(damaged)
    usable = locres.keyed(entries.where("error is null"))
    held = usable.select("csv_base_name", "key", text.escape(F.col("value")).alias("source"), F.lit("").alias("translation"), "ns_hash", "key_hash", "ord")
    rows = settled(catalog.first_wins(held, "csv_base_name", "key"), "extracted")
    files.sidecar_json(rows, "csv_base_name").write.mode("overwrite").partitionBy("csv_base_name").text(target + SIDECAR)
    old = spark.createDataFrame([], "csv_base_name string, ord long, key string, source string, translation string")
    if exists(spark, target):
        old = files.read_catalog(spark, target, "csv_base_name")
    merged = settled(merged_with(rows, old, "csv_base_name"), "merged")
    files.write_catalog_folder(merged, target)
    return _counters(merged, read, bad, [entries, rows, merged])


def translate_catalog(
    spark: SparkSession, csv: str, target: str, ask: Callable[[str], str], journal: str, size: int = 150, parallel: int = 1, attempts: int = translate.ATTEMPTS, delay: float = translate.FIRST_DELAY,
) -> DataFrame:
    """The catalog at ``csv`` with its blank translations asked for, at ``target`` (which may be ``csv``); returns ``batches, accepted, requests, open``.

    ``open`` is what is left without a translation. Run it again with the same ``journal`` to ask for that only.
    """
    counters: list = []
    done = settled(translate.translate(catalog_rows(spark, csv), ask, journal, size, parallel, attempts, delay, counters), "translated")
    files.write_catalog(done, target)
    left = catalog.open_rows(done).count()
    forget(done)
    return spark.createDataFrame([(*counters[0], left)], "batches long, accepted long, requests long, open long")


def search(spark: SparkSession, source: str, part: str) -> DataFrame:
    """``src_path, key, source`` of every text in assets and string tables below ``source`` that holds ``part``."""
    assets = extract.asset_rows(extract.read_assets(spark, source))
    entries = locres.decoded(read_tables(spark, source).select("path", "content")).where("error is null")
    rows = assets.select("src_path", "key", "source").unionByName(entries.select(F.col("path").alias("src_path"), text.composite_key(F.col("ns"), F.col("key")).alias("key"), text.escape(F.col("value")).alias("source")))
    return catalog.text_search(rows, part)


def dump_tables(spark: SparkSession, source: str, target: str, part: str = "") -> DataFrame:
    """Raw copies of the string tables below ``source``, named after the container where base names repeat; returns ``tables, bytes``."""
    tables = read_tables(spark, source, part)
    named = catalog.disambiguated_names(tables.select("path", "container").distinct()).select(F.col("path").alias("_p"), F.col("container").alias("_c"), "csv_base_name")
    joined = tables.join(named, (F.col("path") == F.col("_p")) & F.col("container").eqNullSafe(F.col("_c")))
    made = files.dump(joined.select(F.concat("csv_base_name", F.lit(".locres")).alias("name"), "content"), target)
    return made.agg(F.count(F.lit(1)).alias("tables"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def catalog_rows(spark: SparkSession, csv: str) -> DataFrame:
    """A catalog with its stored hashes, where it has any, in the order of its lines."""
    lines = files.read_catalog(spark, csv)
    rows = catalog_from(lines, key=F.col("key"), namespace=F.col("namespace"), source=F.col("source"), translation=F.col("translation"), src_path=F.lit(csv.rstrip("/")), ord=F.col("ord"))
    if not exists(spark, csv + SIDECAR):
        return rows
    return catalog.sidecar_join(rows, files.sidecar_rows(spark.read.text(csv + SIDECAR), "value"))


def encode_catalog(spark: SparkSession, csv: str, target: str, version: int = locres.COMPACT, number: int | None = None, key: Column | None = None, mark: str | None = None) -> DataFrame:
    """``<base name of the catalog>.locres`` below ``target``; returns what a reader counts in it."""
    rows = catalog_rows(spark, csv)
    locres_parts.write_tables(rows, target, version=version, number=number, key=key, mark=mark)
    back = locres_format.load(spark, target, "ns", "value", "error").where("error is null")
    return catalog.verify_counters(back.select(F.col("ns").alias("namespace"), F.col("value").alias("source")))


def patch_tables(spark: SparkSession, template: str, csv: str, target: str, key: Column, mark: str) -> DataFrame:
    """The encrypted string tables at ``template`` with the translations of ``csv``, below ``target``; returns the patch counters."""
    _, told = locres_parts.patch_tables(template, catalog_rows(spark, csv), target, key, mark)
    return catalog.patch_counters(told)
