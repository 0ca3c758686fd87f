"""Text-based sources and sinks: catalog CSV, hash sidecar, journal, nested JSON, string tables."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lokalith.functions import text
from lokalith.operators.catalog import csv_lines, in_csv_order

_FIELD = r'(?:^|,)("(?:[^"]++|"")*+"|[^,]*+)'


def csv_cells(line: Column) -> Column:
    """Cells of one line: comma-separated, quoted cells with doubled quotes."""
    cells = F.regexp_extract_all(line, F.lit(_FIELD), F.lit(1))
    return F.transform(cells, lambda c: F.when(c.startswith('"') & (F.length(c) > 1), F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))


def load_catalog(lines: DataFrame, column: str = "value", *keep: str) -> DataFrame:
    """``keep..., key, source, translation, namespace``; header lines (third cell ``Translation``) are skipped, short lines padded."""
    cells = lines.select(*keep, csv_cells(F.col(column)).alias("c"))
    cell = lambda n: F.coalesce(F.get("c", F.lit(n)), F.lit(""))
    rows = cells.select(*keep, cell(0).alias("key"), cell(1).alias("source"), cell(2).alias("translation")).where("translation <> 'Translation'")
    return rows.withColumn("namespace", text.namespace_of(F.col("key")))


def text_lines(spark, path: str, *keep: str) -> DataFrame:
    """``keep..., value, ord``: lines numbered from 0 in the order of part numbers, file names and places in the file.

    Splits of the files (as many as scan tasks, however they are packed) are counted and shifted by those before; lines are not sorted.
    """
    meta = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    lines = spark.read.text(path).select(*keep, "value", *meta, F.monotonically_increasing_id().alias("_id"))
    part = F.coalesce(F.regexp_extract("_file", r"part-(\d+)[^/]*\z", 1).try_cast("long"), F.lit(-1))
    splits = lines.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(part, "_file", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifted = splits.select("_file", "_block", (before - F.col("_first")).alias("_shift"))
    return lines.join(shifted, ["_file", "_block"]).select(*keep, "value", (F.col("_id") + F.col("_shift")).alias("ord"))


def read_catalog(spark, path: str, *keep: str) -> DataFrame:
    """``keep..., ord, key, source, translation, namespace`` in the order of the lines, also of a catalog in several parts."""
    return load_catalog(text_lines(spark, path, *keep), "value", *keep, "ord")


def csv_header(with_hash: bool = False, with_url: bool = False) -> str:
    return f"{'[url]' if with_url else ''}{'[key][hash]' if with_hash else 'key'},source,Translation"


def catalog_lines(
    rows: DataFrame, table: bool = False, banner: str = "", footer: str = "", plain_translation: bool = False, with_hash: bool = False, with_url: bool = False
) -> DataFrame:
    """``place, line, sort_key``: banner, header, rendered rows and footer, by place and then in CSV order.

    ``table`` separates by ``|`` and leaves the header out. An empty catalog gives the fixed lines only.
    """
    lines = csv_lines(rows, "|" if table else ",", plain_translation)
    fixed = [(0, banner)] * bool(banner) + [(1, csv_header(with_hash, with_url))] * (not table) + [(3, footer)] * bool(footer)
    out = lines.select(F.lit(2).alias("place"), "line", "sort_key")
    return out.unionByName(rows.sparkSession.createDataFrame([(n, x, "") for n, x in fixed], "place int, line string, sort_key string")) if fixed else out


def write_catalog(rows: DataFrame, path: str, collation: str | None = None, **options) -> None:
    """Sorted lines; a range sort, so the parts in name order are the file. Options as :func:`catalog_lines`."""
    in_csv_order(catalog_lines(rows, **options), "place", collation=collation).select("line").write.mode("overwrite").text(path)


def write_catalog_folder(rows: DataFrame, path: str, name: str = "csv_base_name") -> None:
    """One sorted folder of lines for each value of ``name``; files of one name are not merged into one task."""
    lines = csv_lines_by(rows, name)
    lines.repartitionByRange(name, "sort_key", "line").sortWithinPartitions(name, "sort_key", "line").select(name, "line").write.mode("overwrite").partitionBy(name).text(path)


def csv_lines_by(rows: DataFrame, name: str) -> DataFrame:
    held = rows.select(F.col(name).alias("_name"), "key", "source", "translation")
    line = F.concat_ws(",", *[text.csv_field(F.col(x)) for x in ("key", "source", "translation")])
    return held.select(F.col("_name").alias(name), line.alias("line"), F.when(F.instr(line, "::") > 0, F.substring_index(line, "::", 1)).otherwise(line).alias("sort_key"))


def skipped_lines(rows: DataFrame, column: str = "line") -> DataFrame:
    """``line``: rejected text, escaped, with the carriage return that ends it."""
    return rows.select(F.concat(text.escape(F.coalesce(column, F.lit(""))), F.lit("\r")).alias("line"))


def write_skipped(rows: DataFrame, path: str, column: str = "line", append: bool = False) -> None:
    """Replaces what an earlier run left unless ``append``. Without a path nothing is written."""
    if path:
        skipped_lines(rows, column).write.mode("append" if append else "overwrite").text(path)


#: Entries of one JSON object of a sidecar, about.
SIDECAR_ENTRIES = 100_000


def sidecar_json(rows: DataFrame, group: str = "src_path", entries: int = SIDECAR_ENTRIES) -> DataFrame:
    """``group, json``: objects key -> [ns_hash, key_hash]; rows with both 0 are left out, later keys win.

    A group of more than ``entries`` keys is dealt to several objects by the hash of the key, so none is gathered
    whole; readers take any number of objects.
    """
    kept = rows.where("ns_hash <> 0 or key_hash <> 0").groupBy(group, "key").agg(F.max_by(F.array("ns_hash", "key_hash"), "ord").alias("v"))
    parts = kept.groupBy(F.col(group).alias("_g")).agg((F.floor((F.count(F.lit(1)) - 1) / entries) + 1).alias("_parts"))
    dealt = kept.join(parts, F.col(group).eqNullSafe(F.col("_g"))).withColumn("_part", F.pmod(F.xxhash64("key"), F.col("_parts")))
    return dealt.groupBy(group, "_part").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "v"))))).alias("json")).drop("_part")


def sidecar_rows(df: DataFrame, column: str = "json") -> DataFrame:
    """``hash_key, ns_hash, key_hash``; objects that do not parse, and arrays of fewer than two, give nothing."""
    parsed = df.select(F.explode(F.from_json(column, "map<string, array<bigint>>")).alias("hash_key", "v"))
    return parsed.where("size(v) >= 2").select("hash_key", F.col("v")[0].alias("ns_hash"), F.col("v")[1].alias("key_hash"))


def journal_rows(lines: DataFrame, column: str = "value", order: str = "ord") -> DataFrame:
    """``source, translation`` of tab-separated lines; a tab in front is ignored, the last line of a source wins."""
    tab = F.instr(column, "\t")
    split = lines.where(tab > 1).select(F.substr(F.col(column), F.lit(1), tab - 1).alias("source"), F.substr(F.col(column), tab + 1).alias("translation"), order)
    return split.groupBy("source").agg(F.max_by("translation", order).alias("translation"))


def _objects(root: object) -> Iterator[dict]:
    """Objects at any depth, parents before children, without recursion."""
    todo = [root]
    while todo:
        node = todo.pop()
        if isinstance(node, dict):
            yield node
            todo += reversed(list(node.values()))
        elif isinstance(node, list):
            todo += reversed(node)


def walk_json(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """Objects at any depth with ``Namespace`` and non-empty ``Key`` and ``SourceString``: ``keep..., ord, namespace, key, source``.

    ``ord`` is the number of the object among those of its text, parents before children. A null ``Namespace`` is the empty one; an
    object without the field is none.

    Each text is parsed and walked once, inside Arrow batches; matched objects are searched as well. Texts that do not
    parse, null and empty ones, and ones nested deeper than the parser goes (thousands of levels) give nothing.
    Values that are no strings are taken as their JSON.
    """
    fields = ("Namespace", "Key", "SourceString")

    def told(value: object) -> str | None:
        return value if value is None or isinstance(value, str) else json.dumps(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, found = [], []
            for k, raw in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                try:
                    root = json.loads(raw or "null")
                except (ValueError, RecursionError):
                    continue
                n = 0
                for node in _objects(root):
                    values = [told(node.get(f)) for f in fields]
                    if fields[0] in node and values[1] and values[2]:
                        source.append(k)
                        found.append([n, values[0] or "", *values[1:]])
                        n += 1
            rows = batch.take(pa.array(source, pa.int32()))
            told_ = [pa.array([v[i] for v in found], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *told_], names=[*keep, "ord", "namespace", "key", "source"])

    rows = df.select(*keep, F.col(column).alias("_json"))
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kept}{', ' if keep else ''}ord long, namespace string, key string, source string")


def string_tables(df: DataFrame, namespace: str, entries: str) -> DataFrame:
    return df.select(F.col(namespace).alias("namespace"), F.explode(entries).alias("key", "source"))


def binary_files(spark, path: str, glob: str = "*") -> DataFrame:
    """``path, length, content`` of every file below ``path``, empty ones too, which Spark's own reader leaves out.

    Their names come from the reader's listing, which the driver holds anyway.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "length", "content")
    listed = [(re.sub(r"\Afile:/+", "file:/", unquote(p)),) for p in found.inputFiles()]
    if not listed:
        return found
    empty = spark.createDataFrame(listed, "path string").join(found.select("path"), "path", "left_anti")
    return found.unionByName(empty.select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")))


def manifest(spark, path: str) -> DataFrame:
    """Path, size and SHA-256 of every file below ``path``; :meth:`orderBy` the path for the printed list."""
    files = binary_files(spark, path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def containers(spark, path: str) -> DataFrame:
    """``path, length`` of archive containers below ``path``; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{utoc,pak}").load(path)
    return container_paths(found.select("path", "length"))


def container_paths(files: DataFrame, path: str = "path") -> DataFrame:
    """Of a listing, the containers: their extensions, inside a ``Content/Paks`` folder."""
    plain = F.replace(F.col(path), F.lit("\\"), F.lit("/"))
    return files.where(plain.rlike(r"\.(?:utoc|pak)\z") & F.contains(plain, F.lit("/Content/Paks")))


def dump(files: DataFrame, target: str, name: str = "name") -> DataFrame:
    """Copies ``content`` of each row to ``target/<name>``, byte for byte: ``name, bytes``, lazily.

    Any file system pyarrow opens. A file is written under a name of its own and renamed; rows of one name overwrite
    each other, so names should be made distinct before. Null content is an empty file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(target)
        store.create_dir(folder, recursive=True)
        for batch in batches:
            sizes = []
            for own, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = content.as_py() or b""
                draft = f"{folder}/.draft-{uuid.uuid4().hex}"
                try:
                    with store.open_output_stream(draft, compression=None) as out:
                        out.write(raw)
                    store.move(draft, f"{folder}/{own}")
                except BaseException:  # nothing half-written stays, whatever ended it
                    if store.get_file_info(draft).type != fs.FileType.NotFound:
                        store.delete_file(draft)
                    raise
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return files.select(F.col(name).alias("name"), "content").mapInArrow(run, "name string, bytes long")
