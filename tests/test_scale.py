"""What must hold at any size: journals that survive, ranges that equal whole files, stores that keep what they had."""

import json
import os
import random
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lokalith import workspace
from lokalith.functions import predicates, text
from lokalith.operators import catalog
from lokalith.plans import catalogs, extract, reextract, translate
from lokalith.queries import oracle_sql, queries
from lokalith.schema import catalog_from
from lokalith.sources import binscan, files, journal, locres, locres_format, locres_parts, pieces
from lokalith.streaming.incremental import catalog_store, merge_stream
from lokalith.streaming.store import Conflict, Store

KEY, MARK = b"0123456789abcdef0123456789abcdef", "|end|"


def rows_of(spark, rows):
    df = spark.createDataFrame(rows, "src_path string, ord long, key string, source string, namespace string")
    return catalog_from(df, **{c: F.col(c) for c in df.columns})


# -- journal ----------------------------------------------------------------------------------------------------------


def test_answers_of_a_task_that_dies_are_not_paid_for_again(spark, tmp_path):
    """The worker process is killed after seven of ten batches; the next run asks for three."""
    rows = rows_of(spark, [("f", n, f"k{n}", f"text {n}", "") for n in range(40)])
    asked, path = tmp_path / "asked", str(tmp_path / "journal")
    asked.mkdir()

    def ask(payload):
        if len(list(asked.iterdir())) == 7 and not (tmp_path / "killed").exists():
            (tmp_path / "killed").touch()
            os._exit(1)
        (asked / str(len(list(asked.iterdir())))).write_text(payload)
        return payload.upper()

    with pytest.raises(Exception, match="(?i)python worker|aborted"):
        translate.translate(rows, ask, path, size=4).count()
    assert len(list(asked.iterdir())) == 7 and journal.read(spark, path).count() == 28
    counters = []
    got = {r["source"]: r["translation"] for r in translate.translate(rows, ask, path, size=4, counters=counters).collect()}
    assert got == {f"text {n}": f"TEXT {n}" for n in range(40)} and counters[0].requests == 3 and len(list(asked.iterdir())) == 10


def test_segments_are_read_before_asking(tmp_path):
    first = journal.Segments(str(tmp_path / "j"), "run1")
    name = first.name_of(["f", 1], ["a", "b"])
    assert first.known(name) is None
    first.refuse(name, "why")
    assert first.known(name) == (None, "why") and journal.Segments(str(tmp_path / "j"), "run2").known(name) is None
    first.commit(name, [("a", "x \n"), ("b", "")])
    assert journal.Segments(str(tmp_path / "j"), "run2").known(name) == (["x \n", ""], None)
    assert not [p for p in os.listdir(tmp_path / "j") if p.startswith(".draft")]


def test_segments_lie_compressed_and_those_of_before_are_read(spark, tmp_path):
    path, body = tmp_path / "j", "the same words\u2028 ü " * 500
    own = journal.Segments(str(path), "run")
    own.commit("new", [("a", body), ("b", "\ud800")])
    (path / "seg-old.json").write_text(json.dumps({"at": 1, "source": "c", "translation": "old"}) + "\n" + json.dumps({"at": 1, "source": "a", "translation": "earlier"}) + "\n")
    assert sum(f.stat().st_size for f in path.glob("seg-new*")) < len(body) / 10
    assert own.known("new") == ([body, "\ud800"], None) and own.known("old") == (["old", "earlier"], None)
    for _ in range(2):
        got = {r["source"]: r["translation"] for r in journal.read(spark, str(path)).where("source <> 'b'").collect()}
        assert got == {"a": body, "c": "old"}
        journal.compact(spark, str(path))
    assert not list(path.glob("seg-*"))


def test_shuffles_go_with_a_tidy_query(spark):
    from lokalith.workspace import tidy

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with pytest.raises(ZeroDivisionError), tidy(spark):
        assert spark.conf.get(name) == "true"
        raise ZeroDivisionError
    assert spark.conf.get(name) == before


def test_journal_parts_become_one(spark, tmp_path):
    path = str(tmp_path / "j")
    assert journal.read(spark, path).count() == 0
    odd = [("\0", "a"), ("tab\t", "line\n\r "), ("twice", "old"), ("", "of nothing")]
    journal.append(spark.createDataFrame(odd, "source string, translation string"), path)
    segments = journal.Segments(path, "r")
    segments.commit("x", [("twice", "new")])
    wanted = sorted([*odd[:2], ("twice", "new"), ("", "of nothing")])
    assert sorted(map(tuple, journal.read(spark, path).collect())) == wanted
    journal.compact(spark, path)
    assert sorted(map(tuple, journal.read(spark, path).collect())) == wanted
    assert len([p for p in os.listdir(path) if not p.startswith(".")]) == 1


def test_translate_job(spark, tmp_path, monkeypatch):
    from lokalith.__main__ import run

    csv = str(tmp_path / "c")
    files.write_catalog(spark.createDataFrame([("a", "one", ""), ("b", "two", "zwei"), ("c", "　", ""), ("d", "three", " ")], "key string, source string, translation string"), csv)
    (tmp_path / "asker.py").write_text("def ask(payload, lang=''):\n    return '|||'.join(f'{s}-{lang}' for s in payload.split('|||'))\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    import asker

    __import__("pyspark").cloudpickle.register_pickle_by_value(asker)
    job = ["translate", csv, csv, "--with", "asker:ask", "--lang", "de", "--batch-size", "1"]
    assert run(spark, job) == {"batches": 2, "accepted": 2, "requests": 2, "open": 0}
    assert {r["key"]: r["translation"] for r in files.read_catalog(spark, csv).collect()} == {"a": "one-de", "b": "zwei", "c": "", "d": "three-de"}
    assert run(spark, job)["requests"] == 0


# -- rows that must not get lost ---------------------------------------------------------------------------------------


def test_order_of_a_catalog_in_parts_is_that_of_its_part_numbers(spark, tmp_path):
    (tmp_path / "part-00000").write_text("a::1,x,\n")
    (tmp_path / "part-00001").write_text("".join(f"b::{n},{'y' * 50},\n" for n in range(400)))
    (tmp_path / "part-00010").write_text("c::1,z,\nb::7,last,\n")
    got = [r["key"] for r in files.read_catalog(spark, str(tmp_path)).orderBy("ord").collect()]
    assert got == ["a::1", *(f"b::{n}" for n in range(400)), "c::1", "b::7"]
    assert [r["ord"] for r in files.read_catalog(spark, str(tmp_path)).orderBy("ord").collect()] == list(range(403))


def test_order_holds_where_files_are_split(spark, tmp_path):
    lines = [f"k{n},{'s' * (n % 90)},\n" for n in range(3000)]
    (tmp_path / "one.csv").write_text("".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        rows = files.read_catalog(spark, str(tmp_path / "one.csv"))
        assert rows.rdd.getNumPartitions() > 1
        assert [r["key"] for r in rows.orderBy("ord").collect()] == [f"k{n}" for n in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_blanks_of_unicode(spark):
    blanks = [None, "", " ", "\t\r\n", "　", " ", "\u0085", "  "]
    df = spark.createDataFrame([(n, s) for n, s in enumerate([*blanks, "x", "​", "　x"])], "n int, s string")
    assert [r["b"] for r in df.select("n", predicates.is_blank(F.col("s")).alias("b")).orderBy("n").collect()] == [True] * 8 + [False] * 3
    rows = spark.createDataFrame([("　", ""), ("a", "　"), ("b", "done")], "source string, translation string")
    assert [r["source"] for r in catalog.open_rows(rows).collect()] == ["a"]
    filled = catalog.backfill(rows, spark.createDataFrame([("a", "A"), ("b", "B")], "source string, translation string"))
    assert {r["source"]: r["translation"] for r in filled.collect()} == {"　": "", "a": "A", "b": "done"}


def test_null_namespace_is_the_empty_one(spark):
    text = '[{"Namespace": null, "Key": "k", "SourceString": "s"}, {"Key": "none", "SourceString": "s"}, {"Namespace": "n", "Key": "k", "SourceString": "t", "in": {"Namespace": "", "Key": "x", "SourceString": 5}}]'
    got = files.walk_json(spark.createDataFrame([(1, text)], "id int, j string"), "j", "id").collect()
    assert [tuple(r) for r in got] == [(1, 0, "", "k", "s"), (1, 1, "n", "k", "t"), (1, 2, "", "x", "5")]


def test_damaged_tables_and_rejected_records_are_reported(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    good = locres.encode([("ns", 0, "k1", 0, 1, "table text")])
    (source / "good.locres").write_bytes(good)
    (source / "cut.locres").write_bytes(good[:-20])
    (source / "none.locres").write_bytes(b"")
    record = lambda h, s: h + b"\0" + struct.pack("<i", len(s) + 1) + s + b"\0"
    (source / "a.uexp").write_bytes(record(b"0" * 32, b"lost") + record(b"D41D8CD98F00B204E9800998ECF8427E", b"first text") + record(b"D41D8CD98F00B204E9800998ECF8427E", b"x"))
    (source / "b.uasset").write_bytes(b"".join(b"\x29\x01" + s + b"\x00\x1f" + b"A41D8CD98F00B204E9800998ECF8427E\0\0" for s in (b"one text", b"other text")))
    done = catalogs.extract_directory(spark, str(source), target, skipped=f"{target}.skipped", duplicates=f"{target}.twice", damaged=f"{target}.bad").head()
    assert (done.extracted, done.processed, done.damaged) == (2, 3, 2)
    assert [r["value"] for r in spark.read.option("lineSep", "\n").text(f"{target}.skipped").collect()] == ["0" * 32 + ",\r"]
    assert [r["source"] for r in spark.read.json(f"{target}.twice").collect()] == ["one text", "other text"]
    assert sorted(r["path"].rsplit("/", 1)[1] for r in spark.read.json(f"{target}.bad").collect()) == ["cut.locres", "none.locres"]
    many = catalogs.extract_tables(spark, str(source), str(tmp_path / "folder"), damaged=f"{target}.bad2").head()
    assert (many.extracted, many.processed, many.damaged) == (1, 3, 2)


def test_sparse_orders_are_split(spark):
    rows = spark.range(20_000).select(F.lit("one").alias("src_path"), F.xxhash64("id").alias("ord"), F.col("id"))
    made = catalog.running(rows, "src_path", amount=F.lit(2), width=1000)
    got = made.orderBy("ord").collect()
    assert [r["index"] for r in got] == list(range(20_000)) and [r["before"] for r in got] == list(range(0, 40_000, 2))
    plan = made._jdf.queryExecution().toString()
    assert "approx" in plan


# -- ranges of files ----------------------------------------------------------------------------------------------------


def _noise(rng: random.Random) -> bytes:
    digest = lambda: bytes(rng.choice(b"0123456789ABCDEF") for _ in range(32))
    out = []
    for _ in range(rng.randint(0, 14)):
        k = rng.random()
        if k < 0.25:
            t = bytes(rng.choice(b"ab\x00\x29\x01\x1fF") for _ in range(rng.randint(0, 40)))
            out.append(digest() + b"\0" + struct.pack("<i", len(t) + 1) + t + b"\0")
        elif k < 0.55:
            lead, body = rng.choice([b"", b"\x1f", b"xx\x29\x01\x1f"]), rng.choice([b"a", b"hello", b"", b"\0", b"\0a"])
            out.append(b"\x29\x01" + lead + body + b"\x00\x1f" + rng.choice([digest(), b"0" * 32, b" " + digest()[:31]]) + rng.choice([b"", b"\0\0"]))
        else:
            out.append(rng.choice([digest()[: rng.randint(1, 32)], b"\x29\x01" * rng.randint(1, 4), b"\x00\x1f", bytes(rng.randrange(256) for _ in range(rng.randint(0, 20)))]))
    return b"".join(out)


def _taken(data: bytes, find, split: int) -> list[int]:
    found = set()
    for start in range(0, max(len(data), 1), split):
        found |= set(find(binscan.Span(lambda at, n: data[at : at + n], len(data), start), start, min(start + split, len(data))))
    at, out = 0, []
    for offset, following, _, _ in sorted(found):
        if offset >= at:
            out.append(offset)
            at = following
    return out


@pytest.mark.parametrize(("find", "records"), [(binscan.export_candidates, binscan.export_records), (binscan.package_candidates, binscan.package_records)])
def test_ranges_of_every_size_find_the_records_of_the_whole_file(find, records):
    rng = random.Random(3)
    found = 0
    for _ in range(400):
        data = _noise(rng)
        whole = [r[0] for r in records(data)]
        found += len(whole)
        for split in (1, 3, 7, 16, 50, 1000):
            assert _taken(data, find, split) == whole
    assert found > 100


def test_ranges_read_no_further_than_they_reach():
    """Work of all ranges over a file without marks, and over one with starts but a single separator, stays near its size."""
    for data, after in ((b"-" * 300_000, -1), ((b"-" * 98 + b"\x29\x01") * 3000 + b"\x00\x1f" + b"-" * 34, 300_000)):
        read = [0]

        def read_at(at, n, data=data, read=read):
            read[0] += len(data[at : at + n])
            return data[at : at + n]

        for start in range(0, 299_000, 1000):
            assert not list(binscan.package_candidates(binscan.Span(read_at, len(data), start, 4096), start, start + 1000, after))
        assert read[0] < 12 * len(data)
    read[0] = 0
    for start in range(0, 300_000, 1000):  # starts alone are not looked for behind the range either
        list(binscan.package_candidates(binscan.Span(lambda at, n: read_at(at, n, b"-" * 300_000), 300_000, start), start, start + 1000))
    assert read[0] < 2 * 300_000


def test_known_separators_give_the_records_of_the_whole_file():
    rng = random.Random(4)
    for _ in range(200):
        data = _noise(rng)
        for split in (1, 3, 16, 50):
            for start in range(0, len(data), split):
                end = min(start + split, len(data))
                span = lambda start=start: binscan.Span(lambda at, n: data[at : at + n], len(data), start)
                known = list(binscan.package_candidates(span(), start, end, data.find(binscan.PACKAGE_SEPARATOR, end)))
                assert known == list(binscan.package_candidates(span(), start, end))


def test_tagged_ranges_equal_tagged_files(spark, tmp_path):
    rng = random.Random(5)
    for n in range(12):
        (tmp_path / f"f{n}.uexp").write_bytes(b"".join(_noise(rng) for _ in range(20)))
    (tmp_path / "empty.uexp").write_bytes(b"")
    read = spark.read.format("binaryFile").load(str(tmp_path))
    whole = sorted(map(str, binscan.tagged(read.select("path", "content", F.lit("none").alias("kind"))).collect()))
    for split in (100, 1 << 20):
        assert sorted(map(str, binscan.tagged_ranges(read.select("path", "length"), split).collect())) == whole
    kinds = {r["reason"] for r in binscan.tagged(read.select("path", "content", F.lit("none").alias("kind"))).collect()}
    assert {None, "decode", "short"} <= kinds and len(whole) > 100


def test_large_files_go_by_ranges(spark, tmp_path, monkeypatch):
    (tmp_path / "x").mkdir()
    digest = b"D41D8CD98F00B204E9800998ECF8427E"
    (tmp_path / "x" / "a.uexp").write_bytes(b"-" * 3000 + digest + b"\0" + struct.pack("<i", 10) + b"asset txt\0")
    (tmp_path / "x" / "s.uasset").write_bytes(b"SoundWave" + b"-" * 3000)
    monkeypatch.setattr(extract, "WHOLE_BYTES", 1000)
    large = extract.large_assets(spark, str(tmp_path))
    assert extract.read_assets(spark, str(tmp_path)).count() == 0 and large.count() == 2
    told = extract.asset_records(extract.read_assets(spark, str(tmp_path)), large)
    assert sorted((r["what"], r["source"]) for r in told.collect()) == [("export", "asset txt"), ("sound", None)]


def _short_texts(spark, folder) -> str:
    """A folder whose documents are texts of no, one and two characters and null, under ids that give every kind of record."""
    texts = ["", None, "a", '"', "\n", "ab", "x y"]
    spark.createDataFrame([(n, texts[n % 7 - n // 35]) for n in range(140)], "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def _as_its_sql(spark, folder: str, name: str) -> list:
    """The rows of a query over a folder with documents, where they are those of its SQL."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, queries()[name](spark, folder).collect()))
    assert got == sorted(con.execute(oracle_sql()[name]).fetchall())
    return got


def test_package_scan_has_the_empty_texts_of_its_sql(spark, tmp_path):
    got = _as_its_sql(spark, _short_texts(spark, tmp_path), "package_scan")
    assert sum(source == "" for _, _, source in got) > 10


@pytest.mark.parametrize("name", ["uasset_scan", "uexp_scan"])
def test_scans_of_one_record_have_the_empty_texts_of_their_sql(spark, tmp_path, name):
    assert sum(source == "" for _, _, source in _as_its_sql(spark, _short_texts(spark, tmp_path), name)) > 10


# -- string tables by ranges ----------------------------------------------------------------------------------------------


def _catalog(spark, n=300):
    rng = random.Random(n)
    text = lambda: rng.choice(["", "plain", "mit Ümlaut", "日本", "x" * 200, "a\\nb"])
    rows = [(f"out/f{k % 3}.csv", k, f"k{k}" if k % 17 else "", text(), ["", "ns", "ключ"][k * 7 % 3], rng.choice(["", "done"]), k % 5, k % 7) for k in range(n)]
    df = spark.createDataFrame(rows, "src_path string, ord long, key string, source string, namespace string, translation string, ns_hash long, key_hash long")
    return catalog_from(df, **{c: F.col(c) for c in df.columns})


@pytest.mark.parametrize("part_bytes", [500, 4000, 64 << 20])
@pytest.mark.parametrize(("version", "number"), [(locres.COMPACT, None), (locres.COMPACT, 1), (locres.ENCRYPTED, None)])
def test_tables_by_ranges_have_the_bytes_of_the_encoder(spark, tmp_path, part_bytes, version, number):
    rows = _catalog(spark)
    sealed = {"key": F.lit(KEY), "mark": MARK} if version == locres.ENCRYPTED else {}
    sizes = locres_parts.write_tables(rows, str(tmp_path), version=version, number=number, part_bytes=part_bytes, **sealed)
    for r in locres.encoded(locres.table_rows(rows, version, **sealed), version=version, number=number).collect():
        name = r["src_path"].split("/")[1].replace(".csv", ".locres")
        assert (tmp_path / name).read_bytes() == bytes(r["content"]) and sizes[name] == len(r["content"])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["_manifest.json", "f0.locres", "f1.locres", "f2.locres"]


def test_patch_by_ranges_equals_the_patch_of_whole_files(spark, tmp_path):
    locres_parts.write_tables(_catalog(spark), str(tmp_path / "t"), version=locres.ENCRYPTED, key=F.lit(KEY), mark=MARK)
    tables = spark.read.format("binaryFile").option("pathGlobFilter", "*.locres").load(str(tmp_path / "t")).select("path", "content")
    new = spark.createDataFrame([(f"ns::k{k}", "s", f"neu {k}", k) for k in range(0, 300, 2)] + [("ns::k1", "　", "　", 900)], "key string, source string, translation string, ord long")
    whole = {r["path"].rsplit("/", 1)[1]: bytes(r["content"]) for r in locres.patch_files(tables, new, F.lit(KEY), MARK).collect()}
    for part_bytes in (300, 1 << 20):
        target = tmp_path / f"p{part_bytes}"
        _, told = locres_parts.patch_tables(str(tmp_path / "t"), new, str(target), F.lit(KEY), MARK, part_bytes)
        assert {p.name: p.read_bytes() for p in target.iterdir() if p.name != "_manifest.json"} == whole
    assert catalog.patch_counters(told).head() == catalog.patch_counters(locres.patched_strings(tables, new, F.lit(KEY), MARK)).head()
    (tmp_path / "t" / "broken.locres").write_bytes(b"broken")
    with pytest.raises(ValueError, match="broken"):
        locres_parts.patch_tables(str(tmp_path / "t"), new, str(tmp_path / "q"), F.lit(KEY), MARK)


def test_patching_writes_no_sealed_text_but_the_tables(spark, tmp_path, monkeypatch):
    """Sealed texts don't compress, so what lies on disk on the way is plain, compressed or read again from the tables; shuffled files go with their query."""
    body = "the same plain words " * 500
    rows = spark.createDataFrame([("f", n, "ns", 7, f"k{n}", n, 3, f"{n} {body}") for n in range(40)], "src_path string, ord long, namespace string, ns_hash long, key string, key_hash long, source_crc long, value string")
    seal = lambda value: text.encrypt_value(value, F.lit(KEY), MARK)
    kept, settled = {}, workspace.settled

    def watched(df, name):
        out = settled(df, name)
        folder = out.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
        kept[name] = sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder))
        return out

    monkeypatch.setattr(locres_parts, "settled", watched)
    locres_parts.write_encoded(rows, str(tmp_path / "t"), version=locres.ENCRYPTED, part_bytes=100_000, seal=seal)
    new = spark.createDataFrame([("ns::k3", "s", "neu", 1)], "key string, source string, translation string, ord long")
    sizes, told = locres_parts.patch_tables(str(tmp_path / "t"), new, str(tmp_path / "p"), F.lit(KEY), MARK, part_bytes=100_000)
    assert sum(sizes.values()) > 500_000 and kept and max(kept.values()) < 100_000
    values = {r["key"]: r["value"] for r in told.collect()}
    assert values == {f"ns::k{n}": "neu" if n == 3 else f"{n} {body}" for n in range(40)}


def test_encoded_tables_by_ranges_are_told_by_their_group(spark, tmp_path):
    rows = [(g, n, None if n == 1 else "ns", 0, f"k{n}", 0, 1, "v" * n) for g in ("a/b %41", None) for n in range(40)]
    df = spark.createDataFrame(rows, "src_path string, ord long, namespace string, ns_hash long, key string, key_hash long, source_crc long, value string")
    locres_parts.write_encoded(df, str(tmp_path), part_bytes=500)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.locres").load(str(tmp_path))
    made = {r["g"]: bytes(r["content"]) for r in files.select(locres_parts.group_of(F.col("path")).alias("g"), "content").collect()}
    assert made == {r["src_path"]: bytes(r["content"]) for r in locres.encoded(df).collect()} and set(made) == {"a/b %41", None}
    (tmp_path / "bad.locres").write_bytes(b"bad")
    whole = locres.inspected(locres.binary_files(spark, str(tmp_path), "*.locres"))
    assert sorted(map(str, locres_parts.inspected(spark, str(tmp_path)).collect())) == sorted(map(str, whole.collect()))


def test_batches_of_entries_are_bounded_by_their_bytes(tmp_path, monkeypatch):
    raw = locres.encode([("ns", 0, f"k{n}", 0, 1, "v" * 2000) for n in range(500)])
    (tmp_path / "a.locres").write_bytes(raw)
    monkeypatch.setattr(locres_format, "HELD", 100_000, raising=False)
    reader = locres_format.LocresReader({"path": str(tmp_path)}, StructType.fromDDL(locres_format.SCHEMA))
    sizes = [b.num_rows for p in reader.partitions() for b in reader.read(p)]
    assert sum(sizes) == 500 and max(sizes) < 60
    whole = list(locres._whole(raw))
    monkeypatch.setattr(locres, "HELD", 1000)
    assert list(locres._whole(raw)) == whole and len(whole) == 500


# -- data source ------------------------------------------------------------------------------------------------------------


def test_source_equals_the_decoder_and_pushes_conditions(spark, tmp_path):
    locres_parts.write_tables(_catalog(spark), str(tmp_path))
    (tmp_path / "bad.locres").write_bytes(b"bad")
    plain = locres.read_locres(spark, str(tmp_path))
    load = locres_format.load(spark, str(tmp_path))
    assert load.columns == plain.columns and sorted(map(str, load.collect())) == sorted(map(str, plain.collect()))
    one = load.where("path like '%f1%' and ns = 'ns'")
    chosen = load.where(F.contains("path", F.lit("f1")) & F.col("ns").isin("ns", "other"))
    assert sorted(map(str, chosen.collect())) == sorted(map(str, one.collect())) and chosen.count() > 10
    plan = chosen._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "Contains(" not in plan and " IN (" not in plan  # both conditions are the reader's
    assert locres_format.load(spark, str(tmp_path), "ns", "key").columns == ["ns", "key"]
    assert locres_format.load(spark, str(tmp_path)).where("path = 'no such'").count() == 0


def test_source_reads_no_strings_where_no_value_is_asked_for(spark):
    raw = locres.encode([("ns", 0, f"k{n}", 0, 1, "v" * 500) for n in range(5000)])
    read = lambda at, n: raw[at : at + n]
    totals = []
    for with_values in (False, True):
        streams: list = []
        rows = list(locres_format.entries_of(read, len(raw), None, with_values, streams))
        assert [r[:6] for r in rows] == [e[:6] for e in locres.decode(raw)[1]]
        totals.append(sum(s.total for s in streams))
    assert [r[6] for r in rows] == ["v" * 500] * 5000
    assert totals[0] < len(raw) / 2 < len(raw) < totals[1]


def test_sink_leaves_all_or_nothing(spark, tmp_path):
    locres_format.register(spark)
    target = tmp_path / "sink"
    good = spark.createDataFrame([(f"n{k}.locres", bytearray(b"x" * k)) for k in range(5)], "name string, content binary")
    assert locres_format.save(good, str(target)) == {f"n{k}.locres": k for k in range(5)}
    fails = good.withColumn("content", F.when(F.col("name") == "n3.locres", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content"))).withColumn("name", F.concat(F.lit("m"), "name"))
    with pytest.raises(Exception, match="lost"):
        locres_format.save(fails.repartition(5), str(target))
    assert sorted(p.name for p in target.iterdir()) == ["_manifest.json", *(f"n{k}.locres" for k in range(5))]
    assert locres_format.save(good.limit(1), str(target), overwrite=True) == {"n0.locres": 0}
    assert sorted(p.name for p in target.iterdir()) == ["_manifest.json", "n0.locres"]


def test_skipped_lines_hand_no_file_to_a_task(spark, sf, monkeypatch):
    """Nothing larger than one record goes to Python, neither where the files are built nor where they are scanned."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").select((F.octet_length("text") + 3 + 44).alias("n"), F.expr("doc_id % 20").alias("file"))
    record = docs.agg(F.max("n")).head()[0]
    assert docs.groupBy("file").agg(F.sum("n").alias("n")).agg(F.max("n")).head()[0] > record
    kind, seen = type(docs), []
    run = kind.mapInArrow

    def watched(self, *args, **kwargs):
        held = [c for c, t in self.dtypes if t == "binary"]
        if held:
            seen.append(self.agg(F.max(F.greatest(*[F.octet_length(c) for c in held], F.lit(0)))).head()[0])
        return run(self, *args, **kwargs)

    monkeypatch.setattr(kind, "mapInArrow", watched)
    lines = queries()["skipped_lines"](spark, sf)
    assert seen and max(seen) <= record
    assert {r["line"] for r in lines.collect()} == {"0" * 32 + ",\r"}


def test_package_scan_holds_no_file(spark, sf, monkeypatch):
    """Nothing larger than one record goes to Python or is put together in the JVM."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").select((F.octet_length("text") + 54).alias("n"), F.expr("doc_id % 50").alias("file"))
    record = docs.agg(F.max("n")).head()[0]
    assert docs.groupBy("file").agg(F.sum("n").alias("n")).agg(F.max("n")).head()[0] > record
    kind, seen = type(docs), []
    run = kind.mapInArrow

    def watched(self, *args, **kwargs):
        held = [c for c, t in self.dtypes if t == "binary"]
        if held:
            seen.append(self.agg(F.max(F.greatest(*[F.octet_length(c) for c in held], F.lit(0)))).head()[0])
        return run(self, *args, **kwargs)

    monkeypatch.setattr(kind, "mapInArrow", watched)
    rows = queries()["package_scan"](spark, sf)
    assert seen and max(seen) <= record
    assert rows.count() > 100 and rows.select("path").distinct().count() == 50


def test_pieces_lie_compressed_until_they_are_joined(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("f", n, b"same bytes " * 1000) for n in range(40)], "name string, at long, piece binary")
    sizes, save = [], locres_format.save

    def watched(joined, target):
        for r in joined.collect():
            sizes.extend(store.get_file_info(name).size for store, name in map(locres_format.opened, r["parts"]))
        return save(joined, target)

    monkeypatch.setattr(locres_format, "save", watched)
    assert pieces.dump_pieces(rows, str(tmp_path / "made"), "name", "piece", "at") == {"f": 440_000}
    assert (tmp_path / "made" / "f").read_bytes() == b"same bytes " * 40_000 and 0 < sum(sizes) < 44_000


def test_skipped_lines_batches_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    """One file of 30 MB: what Python gets and gives at once is bounded by Arrow's limit and by that of records, not by the file."""
    record, rows = 100_000, 300
    docs = spark.range(rows).select((F.col("id") * 20 + 5).alias("doc_id"), F.repeat(F.lit("abcdefghij"), record // 10).alias("text"))
    docs.write.parquet(f"{tmp_path}/in/documents.parquet")
    seen = tmp_path / "seen"
    seen.mkdir()
    kind = type(docs)
    run = kind.mapInArrow

    def watched(self, function, schema, *args, **kwargs):
        def noted(batches, what):
            for batch in batches:
                (seen / f"{what}-{batch.nbytes}").touch()
                yield batch

        return run(self, lambda batches: noted(function(noted(batches, "in")), "out"), schema, *args, **kwargs)

    monkeypatch.setattr(kind, "mapInArrow", watched)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    try:
        assert [r["line"] for r in queries()["skipped_lines"](spark, f"{tmp_path}/in").collect()] == ["0" * 32 + ",\r"] * rows
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    largest = {what: max(int(p.name.split("-")[1]) for p in seen.iterdir() if p.name.startswith(what)) for what in ("in", "out")}
    assert record < largest["in"] < (4 << 20) + 2 * record and record < largest["out"] < binscan.HELD + 2 * record


def test_pieces_make_files_over_parts_and_batches(spark, tmp_path):
    rows = spark.range(600).select((F.col("id") % 3).cast("string").alias("name"), F.when(F.col("id") % 7 > 0, F.col("id").cast("string").cast("binary")).alias("piece"), (600 - F.col("id")).alias("ord"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = pieces.dump_pieces(rows.repartition(5), f"file://{tmp_path}/out", "name", "piece", "ord")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    wanted = {str(k): b"".join(b"%d" % n for n in reversed(range(600)) if n % 3 == k and n % 7) for k in range(3)}
    assert {k: (tmp_path / "out" / k).read_bytes() for k in wanted} == wanted and sizes == {k: len(v) for k, v in wanted.items()}


# -- stores -------------------------------------------------------------------------------------------------------------------

SCHEMA = "key string, source string, translation string"


def _frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_store_rewrites_only_the_buckets_of_its_keys(spark, tmp_path):
    store = catalog_store(spark, str(tmp_path / "s"), 16)
    first = store.commit(_frame(spark, [(f"k{n}", "a", "") for n in range(100)]), catalog.merge, "stream", 0)
    second = store.commit(_frame(spark, [("k7", "b", "B")]), catalog.merge, "stream", 1)
    assert len(second["touched"]) == 1 and sum(first["data"][b] != second["data"][b] for b in first["data"]) == 1
    assert store.commit(_frame(spark, [("k8", "b", "B")]), catalog.merge, "stream", 1)["version"] == 1  # a repeated batch
    held = {r["key"]: r["translation"] for r in store.read().collect()}
    assert len(held) == 100 and held["k7"] == "a" and held["k8"] == ""
    assert {r["key"]: r["translation"] for r in store.read(first).collect()}["k7"] == ""
    assert store.vacuum(3600) == 0 and store.vacuum(-1) == 1
    assert store.read().count() == 100 and len(os.listdir(tmp_path / "s" / "manifest")) <= 2
    store.commit(_frame(spark, [("k9", "", "")]), lambda batch, old: old.where("key <> 'k9'"))
    assert store.read().count() == 99


def test_store_refuses_a_slower_writer(spark, tmp_path):
    store = catalog_store(spark, str(tmp_path / "s"), 2)
    store.commit(_frame(spark, [("a", "", "")]), catalog.merge)
    other = Store(spark, str(tmp_path / "s"), SCHEMA, ["key"], 2)

    def slow(batch, old):
        other.commit(_frame(spark, [("b", "", "")]), catalog.merge)
        return catalog.merge(batch, old)

    with pytest.raises(Conflict):
        store.commit(_frame(spark, [("c", "", "")]), slow)
    assert sorted(r["key"] for r in store.read().collect()) == ["a", "b"]
    with pytest.raises(ValueError, match="buckets"):
        store.commit(_frame(spark, [("a", "", "")]), lambda batch, old: _frame(spark, [(f"x{n}", "", "") for n in range(50)]))


def test_a_new_checkpoint_goes_on_from_the_store(spark, tmp_path):
    inbox, store = str(tmp_path / "in"), str(tmp_path / "store")
    for n, checkpoint in enumerate(("cp1", "cp1", "cp2")):
        _frame(spark, [(f"k{n}", "s", ""), ("all", f"s{n}", "")]).write.mode("append").parquet(inbox)
        merge_stream(spark.readStream.schema(SCHEMA).parquet(inbox), store, str(tmp_path / checkpoint), buckets=4).awaitTermination(120)
    got = {r["key"]: r["source"] for r in catalog_store(spark, store).read().collect()}
    assert set(got) == {"k0", "k1", "k2", "all"}


def _shuffled(spark):
    gateway = spark.sparkContext._gateway
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(n).shuffleWriteBytes() for n in range(stages.size()))


def test_a_merge_shuffles_batch_and_store_once_each(spark, tmp_path):
    """Texts that can't be compressed: two batches and the store between them are moved, each once."""
    inbox, store, own = str(tmp_path / "in"), str(tmp_path / "store"), random.Random(7)
    rows = [(f"k{n % 1900}", own.randbytes(500).hex(), "T" if n % 3 else "") for n in range(2000)]
    before = _shuffled(spark)
    for n in range(2):
        _frame(spark, [(k, f"{n}{s}", t if n == 0 else "") for k, s, t in rows]).coalesce(1).write.mode("append").parquet(inbox)
        merge_stream(spark.readStream.schema(SCHEMA).parquet(inbox), store, str(tmp_path / "cp"), buckets=8).awaitTermination(120)
    shuffled, one = _shuffled(spark) - before, 1900 * 1000
    assert shuffled < 4 * one  # three and what is around them
    files_of = [len([f for f in os.listdir(p) if f.startswith("part-")]) for p in (tmp_path / "store" / "data").glob("*/_bucket=*")]
    assert len(files_of) == 16 and max(files_of) <= 200 / 8
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    texts, kept = {}, {}
    for k, s, t in rows:
        texts.setdefault(k, s)
        kept[k] = t or kept.get(k, "")
    got = {r["key"]: (r["source"], r["translation"]) for r in catalog_store(spark, store).read().collect()}
    assert got == {k: (f"1{s}", kept[k] or f"0{s}") for k, s in texts.items()}


def test_a_store_of_before_keeps_its_hash(spark, tmp_path):
    store, inbox = catalog_store(spark, str(tmp_path / "s"), 4), str(tmp_path / "in")
    store.hash = "xxhash64"
    store.commit(_frame(spark, [(f"k{n}", "a", "") for n in range(50)]), catalog.merge)
    named = tmp_path / "s" / "manifest" / "v-000000000000.json"
    named.write_text(json.dumps({k: v for k, v in json.loads(named.read_text()).items() if k != "hash"}))
    (tmp_path / "s" / "manifest" / ".v-000000000000.json.crc").unlink(missing_ok=True)
    _frame(spark, [(f"k{n}", "b", "B") for n in range(3)]).write.parquet(inbox)
    merge_stream(spark.readStream.schema(SCHEMA).parquet(inbox), store.path, str(tmp_path / "cp"), buckets=4).awaitTermination(120)
    got = {r["key"]: r["source"] for r in catalog_store(spark, store.path).read().collect()}
    assert got == {f"k{n}": "b" if n < 3 else "a" for n in range(50)}


def test_second_extraction_reads_changed_files_only(spark, tmp_path):
    source, state = tmp_path / "in", str(tmp_path / "state")
    source.mkdir()
    record = lambda n, s: b"%032X" % (n + 1000) + b"\0" + struct.pack("<i", len(s) + 1) + s + b"\0"
    for n in range(6):
        (source / f"f[{n}].uexp").write_bytes(record(n, b"text %d" % n))
    seen = []

    def read(found):
        seen.append(found.count())
        return extract.asset_rows(found)

    texts = lambda df: sorted(r["source"] for r in df.collect())
    rows, counters = reextract.refresh(spark, str(source), state, read, buckets=8)
    assert counters == {"added": 6, "touched": 0, "removed": 0, "read": 6, "changed": 6} and texts(rows) == [f"text {n}" for n in range(6)]
    (source / "f[1].uexp").write_bytes(record(1, b"changed"))
    os.utime(source / "f[2].uexp", (1, 1))
    (source / "f[3].uexp").unlink()
    (source / "f[9].uexp").write_bytes(record(9, b"new"))
    rows, counters = reextract.refresh(spark, str(source), state, read, buckets=8)
    assert counters == {"added": 1, "touched": 2, "removed": 1, "read": 3, "changed": 2}
    assert texts(rows) == texts(extract.asset_rows(extract.read_assets(spark, str(source)))) == ["changed", "new", "text 0", "text 2", "text 4", "text 5"]
    assert reextract.refresh(spark, str(source), state, read, buckets=8)[1]["read"] == 0 and seen == [6, 2]


def test_second_extraction_reads_large_files_by_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reextract, "WHOLE_BYTES", 200, raising=False)
    source, state = tmp_path / "in", str(tmp_path / "state")
    source.mkdir()
    record = lambda n, s: b"%032X" % (n + 1000) + b"\0" + struct.pack("<i", len(s) + 1) + s + b"\0"
    for n in range(4):
        (source / f"f{n}.uexp").write_bytes(b"-" * (300 * (n % 2)) + record(n, b"text %d" % n))
    seen = []

    def large(found):
        seen.append(sorted(r["path"][-7:] for r in found.collect()))
        return extract.large_rows(found)

    run = lambda: reextract.refresh(spark, str(source), state, extract.asset_rows, buckets=4, read_large=large)
    rows, counters = run()
    assert sorted(r["source"] for r in rows.collect()) == [f"text {n}" for n in range(4)] and (counters["read"], counters["changed"]) == (4, 4)
    (source / "f1.uexp").write_bytes(b"-" * 400 + record(1, b"changed"))
    os.utime(source / "f3.uexp", (1, 1))
    rows, counters = run()
    assert sorted(r["source"] for r in rows.collect()) == ["changed", "text 0", "text 2", "text 3"] and (counters["read"], counters["changed"]) == (2, 1)
    assert seen == [["f1.uexp", "f3.uexp"], ["f1.uexp"]]


def test_notes_and_names_of_a_journal_take_one_call(spark, tmp_path, monkeypatch):
    segments = journal.Segments(str(tmp_path), "r")
    for n in range(30):
        segments.commit(f"a{n}", [(f"s{n}", f"t{n}")])
        segments.refuse(f"b{n}", "no")
    assert segments.known("b3") == (None, "no") and segments.known("a3") == (["t3"], None)
    calls = []
    monkeypatch.setattr(journal, "listed", lambda *a: calls.append(a) or [])
    monkeypatch.setattr(journal, "remove", lambda s, p, remove=journal.remove: calls.append(p) or remove(s, p))
    assert journal.read(spark, str(tmp_path)).count() == 30
    journal.clear_notes(spark, str(tmp_path), "r")
    assert len(calls) == 1 and segments.known("b3") is None
