"""Registered queries of byte ranges, the data source, rejects, re-extraction and program versions, with their SQL."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lokalith.oracle import ESC as _ESC
from lokalith.plans import catalogs, extract, reextract
from lokalith.registry import query
from lokalith.registry import table as _t
from lokalith.sources import binscan, files, locres_format, locres_parts, pieces, programs
from lokalith.sources.locres import encoded
from lokalith.workspace import fresh_path

c = F.col


def _little(n: Column, width: int = 4) -> Column:
    """A number as little-endian bytes."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(255)), 2, "0") for k in range(width)]))


def _export(key: Column, body: Column) -> Column:
    return F.concat(F.lit(b"--"), key.cast("binary"), F.lit(b"\0"), _little(F.octet_length(body) + 1), body, F.lit(b"\0"))


def _export_files(spark, d) -> str:
    """A folder of exports of many records; every fifth has a hash of zeros, every seventh a text that starts with three zero bytes."""
    key = F.when(c("doc_id") % 5 == 0, F.repeat(F.lit("0"), 32)).otherwise(F.upper(F.md5(c("doc_id").cast("string"))))
    body = F.when(c("doc_id") % 7 == 0, F.concat(F.lit(b"\0\0\0"), c("text").cast("binary"))).otherwise(c("text").cast("binary"))
    docs = _t(spark, d, "documents").where("text is not null").select("doc_id", F.concat(F.lit("e"), c("doc_id") % 20, F.lit(".uexp")).alias("name"), _export(key, body).alias("one"))
    path = fresh_path(spark, "files")
    pieces.dump_pieces(docs, path, "name", "one", "doc_id")
    return path


def _told(spark, path: str, split_bytes: int = 128 << 20, kinds: tuple[str, ...] = ("export",)) -> DataFrame:
    """Tagged records of the files below ``path``, scanned by ranges."""
    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    return binscan.tagged_ranges(listed, split_bytes, kinds)


def _name() -> Column:
    return F.regexp_extract("path", r"[^/]*\z", 0).alias("name")


def _dumped(spark, made: DataFrame, name: str = "files") -> str:
    path = fresh_path(spark, name)
    files.dump(made, path).write.format("noop").mode("overwrite").save()
    return path


_EXPORTS = (
    "SELECT 'e' || (doc_id % 20) || '.uexp' AS name, doc_id % 5 = 0 AS bad, doc_id % 7 = 0 AS zero, CASE WHEN doc_id % 5 = 0 THEN repeat('0', 32) ELSE upper(md5(CAST(doc_id AS VARCHAR))) END AS key, "
    f"{_ESC.format('text')} AS source FROM documents WHERE text IS NOT NULL"
)


@query(f"SELECT name, key, source FROM ({_EXPORTS}) WHERE NOT bad AND NOT zero AND length(source) <> 1")
def byte_range_scan(spark, d):
    """Files scanned by ranges of 64 KB, records across their borders included."""
    told = _told(spark, _export_files(spark, d), 64 << 10, ("export", "package"))
    return binscan.accepted(told, "export").select(_name(), "key", "source")


_UNDER = "'file:/data/in/' || CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'p' || page_id || '/' WHEN 2 THEN 'a b+[1]/deep/' ELSE '/twice//' END || md5(url) || '.uasset'"


@query(f"SELECT page_id, CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'p' || page_id WHEN 2 THEN 'a b+[1]' ELSE 'twice' END AS container FROM (SELECT page_id, {_UNDER} AS path FROM pages)")
def asset_containers(spark, d):
    """The container of each file: the folder directly below the source."""
    k = c("page_id") % 4
    below = F.when(k == 0, "").when(k == 1, F.concat(F.lit("p"), "page_id", F.lit("/"))).when(k == 2, "a b+[1]/deep/").otherwise("/twice//")
    paths = _t(spark, d, "pages").select("page_id", F.concat(F.lit("file:/data/in/"), below, F.md5("url"), F.lit(".uasset")).alias("path"))
    return paths.select("page_id", extract.container_of("file:///data/in/").alias("container"))


@query(
    f"SELECT name, CASE WHEN bad THEN 'hash' WHEN zero THEN 'decode' ELSE 'short' END AS reason, count(*) AS n, CAST(sum(CASE WHEN bad THEN 34 END) AS BIGINT) AS line_length FROM ({_EXPORTS}) "
    "WHERE bad OR zero OR length(source) = 1 GROUP BY 1, 2 "
    f"UNION ALL SELECT name, 'accepted', count(*), NULL FROM ({_EXPORTS}) WHERE NOT (bad OR zero OR length(source) = 1) GROUP BY 1"
)
def rejected_records(spark, d):
    """One scan, two outputs: accepted and rejected records are all candidates; the lines of those without a valid hash as they are reported."""
    told = _told(spark, _export_files(spark, d))
    lost = binscan.rejected(told)
    line = F.length(F.concat(c("line"), F.lit("\r")))
    lost = lost.groupBy(_name(), "reason").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(c("reason") == "hash", line)).alias("line_length"))
    kept = told.where("reason is null").groupBy(_name()).agg(F.count(F.lit(1)).alias("n"))
    return lost.unionByName(kept.select("name", F.lit("accepted").alias("reason"), "n", F.lit(None).cast("long").alias("line_length")))


@query("SELECT '0' || repeat('0', 31) || ',' || chr(13) AS line FROM documents WHERE text IS NOT NULL AND doc_id % 5 = 0")
def skipped_lines(spark, d):
    """The report of skipped lines, as the scan hands it out, written and read again."""
    told = _told(spark, _export_files(spark, d))
    path = fresh_path(spark, "skipped")
    files.write_skipped(binscan.rejected(told).where("reason = 'hash'"), path)
    return spark.read.option("lineSep", "\n").text(path).select(c("value").alias("line"))


@query("SELECT count(DISTINCT doc_id) AS processed, count(*) FILTER (WHERE doc_id % 10 = 0) AS damaged FROM documents")
def process_counters(spark, d):
    """Tables read and tables that are damaged, counted by the pass that decodes them."""
    rows = _t(spark, d, "documents").select(
        c("doc_id").cast("string").alias("src_path"), c("doc_id").alias("ord"), F.lit("").alias("namespace"), F.lit(0).cast("long").alias("ns_hash"), F.lit("k").alias("key"),
        F.lit(0).cast("long").alias("key_hash"), F.lit(1).cast("long").alias("source_crc"), c("lang").alias("value"),
    )
    made = encoded(rows).select(c("src_path").alias("path"), F.when(c("src_path").cast("long") % 10 == 0, F.lit(b"no table")).otherwise(c("content")).alias("content"))
    entries, read, bad = catalogs.counted_tables(made)
    entries.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(read.get["processed"], bad.get["damaged"])], "processed long, damaged long")


@query("SELECT 's' || source || '.locres' AS file, lang AS ns, 'k' || doc_id AS key, text AS value FROM documents WHERE lang IN ('en', 'fr') AND ends_with(source, '1') AND text IS NOT NULL")
def locres_source(spark, d):
    """String tables through the data source: files and namespaces are chosen by the reader."""
    rows = _t(spark, d, "documents").where("text is not null").select(
        F.concat(F.lit("s"), "source").alias("src_path"), c("doc_id").alias("ord"), c("lang").alias("namespace"), F.lit(0).cast("long").alias("ns_hash"), F.concat(F.lit("k"), "doc_id").alias("key"),
        F.lit(0).cast("long").alias("key_hash"), F.lit(1).cast("long").alias("source_crc"), c("text").alias("value"),
    )
    path = fresh_path(spark, "tables")
    locres_parts.write_encoded(rows, path, name=c("src_path"))
    chosen = locres_format.load(spark, path, "path", "ns", "key", "value").where(F.contains("path", F.lit("1.locres")) & c("ns").isin("en", "fr"))
    return chosen.select(F.regexp_extract("path", r"[^/]*\z", 0).alias("file"), "ns", "key", "value")


@query(
    "SELECT upper(md5(CAST(doc_id AS VARCHAR))) AS key, " + _ESC.format("CASE WHEN doc_id % 20 = 4 THEN 'new: ' || text ELSE text END") + " AS source FROM documents "
    "WHERE text IS NOT NULL AND doc_id % 20 <> 6 AND length(" + _ESC.format("text") + ") <> 1 OR (text IS NOT NULL AND doc_id % 20 = 4)"
)
def reextract_changes(spark, d):
    """A second extraction of a folder in which one file was added, one changed and one removed: the rows of a full one."""
    docs = _t(spark, d, "documents").where("text is not null")

    def write(which: DataFrame) -> None:
        text = F.when((c("doc_id") % 20 == 4) & c("again"), F.concat(F.lit("new: "), "text")).otherwise(c("text"))
        one = _export(F.upper(F.md5(c("doc_id").cast("string"))), text.cast("binary"))
        pieces.dump_pieces(which.select("doc_id", F.concat(F.lit("e"), c("doc_id") % 20, F.lit(".uexp")).alias("name"), one.alias("one")), path, "name", "one", "doc_id")

    path, state = fresh_path(spark, "assets"), fresh_path(spark, "state")
    write(docs.where("doc_id % 20 <> 5").withColumn("again", F.lit(False)))
    reextract.refresh(spark, path, state, extract.asset_rows, buckets=8, read_large=extract.large_rows)
    write(docs.where("doc_id % 20 in (4, 5)").withColumn("again", F.lit(True)))
    files.dump(spark.createDataFrame([("e6.uexp", bytearray())], "name string, content binary"), path).write.format("noop").mode("overwrite").save()
    rows, _ = reextract.refresh(spark, path, state, extract.asset_rows, buckets=8, read_large=extract.large_rows)
    return rows.select("key", "source")


def _program(before: bool) -> bytes:
    """A small program of the public format, up to the numbers of its version or what follows them."""
    fixed_at = 6 + 32 + 2
    version = struct.pack("<HHH", fixed_at + 52, 52, 0) + "VS_VERSION_INFO\0".encode("utf-16-le") + b"\0\0" + programs.FIXED_MARK + struct.pack("<I", 0x10000)
    if not before:
        return bytes(28)
    folder = lambda name, at, more: struct.pack("<12xHHII", 0, 1, name, at | more << 31)
    tree = folder(programs.VERSION_TYPE, 24, 1) + folder(1, 48, 1) + folder(1033, 72, 0) + struct.pack("<IIII", 0x1000 + 88, fixed_at + 52, 0, 0) + version
    optional = struct.pack("<H110x", 0x20B) + bytes(16) + struct.pack("<II", 0x1000, len(tree) + 44) + bytes(104)
    head = struct.pack("<2s58xI", b"MZ", 64) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x8664, 1, 0, 0, 0, len(optional), 0) + optional
    place = len(head) + 40
    return head + struct.pack("<8s4I16x", b".rsrc", len(tree) + 44, 0x1000, len(tree) + 44, place) + tree


_PROGRAMS = (
    "SELECT s_nationkey AS root, CASE s_suppkey % 3 WHEN 0 THEN 'Game' || s_suppkey || '.exe' WHEN 1 THEN 'Engine/Binaries/Win64/p' || s_suppkey || '.exe' ELSE 'Game/Binaries/Win64/q' || s_suppkey || '.exe' END AS path, "
    "CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE s_suppkey % 4 + 2 END AS major, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE s_suppkey % 28 END AS minor FROM supplier"
)


@query(
    f"WITH p AS ({_PROGRAMS}), m AS (SELECT root, arg_min(major, path) FILTER (NOT contains(path, '/')) AS main, arg_min('UE' || major || '_' || minor, path) FILTER (NOT contains(path, '/')) AS main_v, "
    "arg_min('UE' || major || '_' || minor, path) FILTER (contains(path, 'Engine/Binaries/Win64/')) AS engine_v, arg_min('UE' || major || '_' || minor, path) FILTER (contains(path, 'Binaries/Win64/')) AS other_v FROM p GROUP BY root), "
    "v AS (SELECT root, CASE WHEN main >= 4 THEN main_v ELSE engine_v END AS v, other_v FROM m) SELECT root, CASE WHEN v = 'UE0_0' THEN other_v ELSE v END AS version FROM v"
)
def program_versions(spark, d):
    """Versions from the resources of program files, one program a supplier, one title a nation."""
    k = c("s_suppkey")
    folder = F.when(k % 3 == 0, "Game").when(k % 3 == 1, "Engine/Binaries/Win64/p").otherwise("Game/Binaries/Win64/q")
    major, minor = F.when(k % 5 == 0, 0).otherwise(k % 4 + 2), F.when(k % 5 == 0, 0).otherwise(k % 28)
    # each pair is the low half first: minor and major of the file, then of the product
    content = F.concat(F.lit(_program(True)), _little(F.lit(7), 2), _little(major, 2), F.lit(bytes(4)), _little(minor, 2), _little(major, 2), F.lit(bytes(4)), F.lit(_program(False)))
    made = _t(spark, d, "supplier").select(c("s_nationkey").alias("root"), F.concat(folder, k, F.lit(".exe")).alias("inside"), F.concat(F.lit("s"), k, F.lit(".exe")).alias("name"), content.alias("content"))
    path = _dumped(spark, made.select("name", "content"), "programs")
    read = programs.program_versions(spark.read.format("binaryFile").load(path).select("path")).withColumn("name", F.regexp_extract("path", r"[^/]*\z", 0)).drop("path")
    known = made.select("root", "name", c("inside").alias("path")).join(read, "name")
    return programs.engine_versions(known)
