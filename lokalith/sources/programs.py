"""Versions of Windows programs from their own files: a reader of the version resource, by ranges.

Of a program only its headers, the entries of its resource tree on the way to the version, and the version block are read.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lokalith.sources.binscan import opened_file

#: Fixed values of the format: the type of version resources, and the mark of the block with the numbers.
VERSION_TYPE, FIXED_MARK = 16, bytes.fromhex("BD04EFFE")
#: Folders that programs of the engine lie in, the reporter that is none of the title's, and the first version with its number in the file.
ENGINE_FOLDER, PROGRAM_FOLDER, REPORTER, FIRST_MAJOR = "Engine/Binaries/Win64/", "Binaries/Win64/", "CrashReportClient.exe", 4

Reader = Callable[[int, int], bytes]


def _numbers(read_at: Reader, at: int, form: str) -> tuple:
    raw = read_at(at, struct.calcsize("<" + form))
    return struct.unpack("<" + form, raw)


def _sections(read_at: Reader) -> tuple[list[tuple[int, int, int]], int]:
    """``(address, size, place in the file)`` of each section, and the address of the resource tree."""
    if read_at(0, 2) != b"MZ":
        raise ValueError("no program")
    (pe,) = _numbers(read_at, 0x3C, "I")
    if read_at(pe, 4) != b"PE\0\0":
        raise ValueError("no program")
    count, optional = _numbers(read_at, pe + 6, "H12xH")
    (magic,) = _numbers(read_at, pe + 24, "H")
    (resources,) = _numbers(read_at, pe + 24 + (96 if magic == 0x10B else 112) + 16, "I")
    out = []
    for k in range(count):
        size, address, raw_size, place = _numbers(read_at, pe + 24 + optional + 40 * k + 8, "4I")
        out.append((address, max(size, raw_size), place))
    return out, resources


def version_of(read_at: Reader) -> tuple[tuple[int, int, int, int], tuple[int, int, int, int]]:
    """File and product version, four numbers each; ValueError or struct.error where the program has none or is cut."""
    sections, root = _sections(read_at)

    def place_of(address: int) -> int:
        for start, size, place in sections:
            if start <= address < start + size:
                return address - start + place
        raise ValueError("address outside of every section")

    def children(at: int) -> Iterator[tuple[int, int]]:
        named, numbered = _numbers(read_at, at + 12, "HH")
        for k in range(named + numbered):
            yield _numbers(read_at, at + 16 + 8 * k, "II")

    if not root:
        raise ValueError("no resources")
    top = place_of(root)
    kinds = [child for name, child in children(top) if name == VERSION_TYPE]
    if not kinds:
        raise ValueError("no version")
    at = kinds[0]
    for _ in range(2):  # by name and by language: the first of each
        if not at >> 31:
            break
        at = next(child for _, child in children(top + (at & 0x7FFFFFFF)))
    address, size = _numbers(read_at, top + at, "II")
    block = read_at(place_of(address), min(size, 1 << 16))
    mark = block.find(FIXED_MARK)
    if mark < 0:
        raise ValueError("no version")
    parts = struct.unpack_from("<4I", block, mark + 8)
    halves = [h for p in parts for h in (p >> 16, p & 0xFFFF)]
    return tuple(halves[:4]), tuple(halves[4:])


_VERSIONS = "file_major int, file_minor int, product_major int, product_minor int"


def program_versions(programs: DataFrame) -> DataFrame:
    """``programs(path, ...)`` with ``file_major, file_minor, product_major, product_minor``; null where the file has no version that can be read."""
    names = [f.split(" ")[0] for f in _VERSIONS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path in batch.column(batch.schema.get_field_index("path")).to_pylist():
                try:
                    with opened_file(path) as f:
                        file, product = version_of(lambda at, n, f=f: f.read_at(n, at))
                    rows.append((file[0], file[1], product[0], product[1]))
                except (ValueError, struct.error, OSError, StopIteration):
                    rows.append((None,) * 4)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int32()) for c in zip(*rows, strict=True))], names=[*batch.schema.names, *names])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in programs.schema)
    return programs.mapInArrow(run, f"{kept}, {_VERSIONS}")


def _first(where: Column) -> Column:
    """Aggregate: version of the program with the smallest path that meets a condition."""
    version = F.struct("file_major", F.coalesce(F.concat(F.lit("UE"), "file_major", F.lit("_"), "product_minor"), F.lit("")).alias("version"))
    return F.min_by(version, F.when(where, F.col("path")))


def engine_versions(programs: DataFrame, root: str = "root") -> DataFrame:
    """``root, version`` of ``programs(root, path, file_major, product_minor)``, paths relative to the root, of files that end in ``.exe``.

    The program directly in the root counts where it is of version 4 or later, else the engine's. One without numbers (``UE0_0``)
    is replaced by the first program in the folder of programs that is not the reporter. Null where there is none.
    """
    path = F.replace("path", F.lit("\\"), F.lit("/"))
    exe = programs.where(F.lower("path").endswith(".exe")).withColumn("path", path)
    inside = lambda folder: F.contains(F.concat(F.lit("/"), F.col("path")), F.lit("/" + folder))
    own = exe.groupBy(root).agg(
        _first(~F.contains("path", F.lit("/"))).alias("main"), _first(inside(ENGINE_FOLDER)).alias("engine"),
        _first(inside(PROGRAM_FOLDER) & ~F.contains("path", F.lit(REPORTER))).alias("other"),
    )
    chosen = F.when(F.col("main.file_major") >= FIRST_MAJOR, F.col("main.version")).otherwise(F.col("engine.version"))
    told = own.select(root, F.when(chosen == "UE0_0", F.col("other.version")).otherwise(chosen).alias("version"))
    return told.select(root, F.nullif("version", F.lit("")).alias("version"))
