"""Versions of programs, masked search over batches, and the search of texts."""

import re

import pytest
from pyspark.sql import functions as F

from lokalith.functions import text
from lokalith.sources import programs
from lokalith.sources.files import binary_files, manifest
from tests.programs import program


@pytest.mark.parametrize("wide", [True, False])
def test_version_of_a_program(wide):
    raw = program((4, 27, 2, 1), (4, 26, 0, 9), wide)
    read = []

    def read_at(at, n):
        read.append(n)
        return raw[at : at + n]

    assert programs.version_of(read_at) == ((4, 27, 2, 1), (4, 26, 0, 9)) and max(read) < 200


def test_broken_programs_have_no_version(spark, tmp_path):
    raw = program(lead=50)
    cases = {"ok": raw, "empty": b"", "text": b"MZ only", "none": program(versions=False), "no_pe": raw.replace(b"PE\0\0", b"XX\0\0")}
    cases |= {f"cut{n}": raw[:n] for n in range(1, len(raw) - 60, 97)}
    for name, content in cases.items():
        (tmp_path / f"{name}.exe").write_bytes(content)
    files = binary_files(spark, str(tmp_path)).select("path").unionByName(spark.createDataFrame([("/no/such.exe",)], "path string"))
    got = {re.sub(r".*/", "", r["path"]): (r["file_major"], r["product_minor"]) for r in programs.program_versions(files).collect()}
    assert got.pop("ok.exe") == (5, 3) and set(got.values()) == {(None, None)} and len(got) == len(cases)


def test_which_program_counts(spark):
    rows = [
        ("new", "Game.exe", 5, 3), ("new", "Engine/Binaries/Win64/CrashReportClient.exe", 5, 1),
        ("old", "Game.exe", 1, 0), ("old", "Engine\\Binaries\\Win64\\CrashReportClient.exe", 4, 27),
        ("zero", "Engine/Binaries/Win64/CrashReportClient.exe", 0, 0), ("zero", "Game/Binaries/Win64/Game-Shipping.exe", 4, 25), ("zero", "x.dll", 5, 5),
        ("none", "Game.exe", None, None), ("bare", "sub/Game.exe", 5, 0),
    ]
    got = programs.engine_versions(spark.createDataFrame(rows, "root string, path string, file_major int, product_minor int"))
    assert dict(map(tuple, got.collect())) == {"new": "UE5_3", "old": "UE4_27", "zero": "UE4_25", "none": None, "bare": None}


@pytest.mark.parametrize("pattern", [[97, None, 97], [97], [None, None], [97, 97, None, 98]])
def test_masked_search_of_many_rows_equals_a_plain_one(spark, pattern):
    texts = [b"", b"a", b"aa", b"a" * 5000, b"ab" * 40, None, b"", b"xaab", b"b\0a\na", None] * 3
    plain = lambda t: [i for i in range(len(t) - len(pattern) + 1) if all(p is None or t[i + k] == p for k, p in enumerate(pattern))]
    df = spark.createDataFrame([(n, None if t is None else bytearray(t)) for n, t in enumerate(texts)], "n int, b binary").repartition(2)
    got = {r["n"]: r["f"] for r in df.select("n", text.masked_finds(F.col("b"), pattern).alias("f")).collect()}
    assert got == {n: None if t is None else plain(t) for n, t in enumerate(texts)}


def test_empty_files_are_listed(spark, tmp_path):
    """Spark's reader of whole files leaves them out."""
    (tmp_path / "a b%20é.bin").write_bytes(b"")
    (tmp_path / "c.bin").write_bytes(b"x")
    assert sorted((r["path"].rsplit("/", 1)[1], r["length"]) for r in manifest(spark, str(tmp_path)).collect()) == [("a b%20é.bin", 0), ("c.bin", 1)]
