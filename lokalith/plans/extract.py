"""Whole chains: documents or files to catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lokalith.functions import predicates, text
from lokalith.operators import catalog
from lokalith.schema import catalog_from
from lokalith.sources import binscan, files
from lokalith.workspace import settled

#: Extensions of assets, and the folder that no project text lies in.
ASSETS, ENGINE_FOLDER = (".uasset", ".uexp", ".umap"), "Engine/"

_ASSET_GLOB = "*.{" + ",".join("".join(f"[{x.lower()}{x.upper()}]" for x in e[1:]) for e in ASSETS) + "}"
#: Files up to here are read as one value, larger ones by ranges.
WHOLE_BYTES = 256 << 20


def document_catalog(documents: DataFrame) -> DataFrame:
    """Documents as a catalog: key from the first word, namespace from the source, escaped text, a file a language."""
    whole = F.coalesce("text", F.lit(""))
    return catalog_from(documents, key=F.split_part(whole, F.lit(" "), F.lit(1)), namespace=F.col("source"), source=text.escape(whole), src_path=F.col("lang"), ord=F.col("doc_id"))


def flagship(documents: DataFrame) -> DataFrame:
    return catalog.extract(document_catalog(documents)).select("key", "namespace", "source").orderBy("namespace", "key")


def asset_paths(listing: DataFrame, path: str = "path", part: str = "", all_folders: bool = False, skip_packages: bool = False, skip_exports: bool = False) -> DataFrame:
    """Of a listing the assets: by extension, outside the engine's folder and, unless ``all_folders``, those without text."""
    c = F.col(path)
    keep = predicates.has_extension(c, *ASSETS) & ~F.contains(c, F.lit(ENGINE_FOLDER))
    if part:
        keep = keep & F.contains(F.lower(c), F.lit(part.lower()))
    if not all_folders:
        keep = keep & ~binscan.outside_text(c)
    for skip, extension in ((skip_packages, ".uasset"), (skip_exports, ".uexp")):
        if skip:
            keep = keep & ~c.endswith(extension)
    return listing.where(keep)


def container_of(source: str) -> Column:
    """The folder a file was unpacked to, directly below ``source``; '' where it lies in ``source`` itself."""
    plain = "/" + source.rstrip("/").split(":", 1)[-1].lstrip("/")
    return F.regexp_extract("path", rf"\Q{plain}\E/+([^/]+)/", 1)


def read_assets(spark, path: str, **options) -> DataFrame:
    """``path, container, content`` of the assets below ``path``; extensions are matched before any byte is read.

    One virtual path may come from several containers.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", _ASSET_GLOB).load(path)
    return asset_paths(found.where(F.col("length") <= WHOLE_BYTES), **options).select("path", container_of(path).alias("container"), "content")


def large_assets(spark, path: str, **options) -> DataFrame:
    """``path, length`` of the assets that :func:`read_assets` leaves out, as one value can't hold them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", _ASSET_GLOB).load(path)
    return asset_paths(found.where(F.col("length") > WHOLE_BYTES), **options).select("path", "length")


def asset_kind(path: Column, content: Column) -> Column:
    """Kind of an asset: packages by their header, all by the path rules."""
    return binscan.export_kind(F.when(path.endswith(".uasset"), content).otherwise(F.lit(b"")), path)


def asset_records(assets: DataFrame | None, large: DataFrame | None = None) -> DataFrame:
    """Every record and kind of ``assets(path, content)`` in one pass over the bytes, written down: see :func:`binscan.tagged`.

    ``large(path, length)`` are files that do not fit into one value; of these the head is read for the kind, and ranges for the records.
    """
    told = None if assets is None else binscan.tagged(assets.withColumn("kind", asset_kind(F.col("path"), F.col("content"))))
    if large is not None:
        kinds = settled(binscan.with_heads(large).select("path", "length", asset_kind(F.col("path"), F.col("content")).alias("kind")), "large")
        others = kinds.where("kind <> 'none'").select("path", F.col("kind").alias("what"), *[F.lit(None).cast(t).alias(n) for n, t in (("ord", "long"), ("key", "string"), ("source", "string"), ("reason", "string"))])
        ranged = others.unionByName(binscan.tagged_ranges(kinds.where("kind = 'none'")))
        told = ranged if told is None else told.unionByName(ranged)
    return settled(told, "records")


def asset_rows(assets: DataFrame | None, exports: DataFrame | None = None, strict_anti: bool = False, told: DataFrame | None = None) -> DataFrame:
    """``assets(path, content)`` -> catalog rows of every kind, a bag. ``told`` are their records, where they are known already.

    Files of no kind are scanned for both kinds of record; package records stay where the file has no export record, or one
    with another key (``strict_anti``: none with that key). Sounds and textures hold no text. Tables and blueprints
    are read from ``exports(path, json)``, what a package reader made of them; without it they give nothing.
    """
    told = asset_records(assets) if told is None else told
    first, second = binscan.accepted(told, "export"), binscan.accepted(told, "package")
    kept = catalog.other_key_semi(second, first, group="path", strict_anti=strict_anti)
    records = first.unionByName(kept).select("path", "ord", F.lit("").alias("namespace"), "key", "source")
    if exports is not None:
        wanted = exports.join(told.where("what in ('table', 'blueprint')").select("path").distinct(), "path", "left_semi")
        objects = files.walk_json(wanted, "json", "path").withColumn("source", text.escape(F.col("source")))
        records = records.unionByName(objects.select("path", "ord", "namespace", "key", "source"))
    return catalog_from(records, key=F.col("key"), namespace=F.col("namespace"), source=F.col("source"), src_path=F.col("path"), ord=F.col("ord"))


def large_rows(large: DataFrame) -> DataFrame:
    """As :func:`asset_rows`, of ``large(path, length)``: files that are scanned by ranges."""
    return asset_rows(None, told=asset_records(None, large))


def scan_assets(
    assets: DataFrame | None, exports: DataFrame | None = None, tables: DataFrame | None = None, no_underscore: bool = False, no_uppercase: bool = False, told: DataFrame | None = None,
) -> DataFrame:
    """The whole chain over assets: rows of every kind, optional row filters, conflicts, last writers, string tables, noise.

    ``tables(ns, ns_hash, key, key_hash, value, path, ord)`` are decoded string tables; of these only keys that assets
    do not have, and values that are not blank, are added.
    """
    rows = asset_rows(assets, exports, told=told)
    found = catalog.last_rows(rows, predicates.wanted_source(F.col("source"), no_underscore, no_uppercase))
    if tables is not None:
        more = catalog_from(
            tables, key=text.composite_key(F.col("ns"), F.col("key")), namespace=F.col("ns"), source=text.escape(F.col("value")), ns_hash=F.col("ns_hash"), key_hash=F.col("key_hash"),
            src_path=F.col("path"), ord=F.col("ord"),
        )
        found = catalog.union_missing(found, more)
    return found.where(~predicates.is_not_allowed(F.col("source")))
