"""Catalog engine: worked examples, round trips, and the predicate table."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from lokalith.functions import predicates, text
from lokalith.functions.hashes import city64
from lokalith.operators import catalog
from lokalith.plans import extract, translate
from lokalith.schema import catalog_from
from lokalith.sources import binscan, files, journal, locres
from tests.plain_city import city64 as plain_city64

#: Fixed value: a compact string table of two entries.
GOLDEN = bytes.fromhex(
    "0E147475674A03FC4A15909DC3377F1B 01 7F00000000000000 01000000 00000000 02000000"
    "21000000 4645443931324244344434314137343633464644383242424531363542444532 00 CE2EC3F0 00000000"
    "21000000 4642313946344443344235304333434339363735354442413234343430383433 00 08B6A584 01000000"
    "02000000"
    "47000000 416C6C6F777320666F72206F70656E696E6720616E6420636C6F73696E67206120226761746522"
    "20746F20636F6E74726F6C2074686520657865637574696F6E20666C6F772E 00"
    "34000000 416C7465726E61746573206265747765656E204120616E642042206F7574707574732C207374617274696E6720776974682041 00"
)


def test_golden_table():
    assert len(GOLDEN) == 262
    head, entries = locres.decode(GOLDEN)
    assert head["version"] == 1 and head["offset"] == 127 and head["end"] == 262
    assert [(e[0], e[2], e[5]) for e in entries] == [("", "FED912BD4D41A7463FFD82BBE165BDE2", 0), ("", "FB19F4DC4B50C3CC96755DBA24440843", 1)]
    assert [e[4] for e in entries] == [locres.string_crc(e[6]) for e in entries] == [0xF0C32ECE, 0x84A5B608]
    assert locres.encode([(*e[:5], e[6]) for e in entries]) == GOLDEN
    assert locres.inspect(GOLDEN)["consistent"]


@pytest.mark.parametrize("version,number", [(locres.COMPACT, None), (locres.COMPACT, 1), (locres.ENCRYPTED, None)])
def test_table_round_trip(version, number):
    entries = [("ns", 7, "k", 8, 9, "value"), ("", 0, "ключ", 1, 2, ""), ("ns", 7, "k2", 3, 4, "emoji 😀"), ("x", 1, "", 1, 1, "dropped")]
    data = locres.encode(entries, version, number)
    if number is None:
        head, found = locres.decode(data)
        hashed = version == locres.ENCRYPTED
        want = [(a, h if hashed else 0, k, kh if hashed else 0, crc, v) for a, h, k, kh, crc, v in (entries[0], entries[2], entries[1])]
        assert [(e[0], e[1] if e[0] else e[1], e[2], e[3], e[4], e[6]) for e in found] == want
        assert head["keys_end"] == head["offset"]
    else:
        assert struct.unpack_from("<i", data, 17)[0] == 1


PREDICATES = [
    ("TextBlockDefaultValue", True), ("None", True), ("", True), ("  ", True), ("a", True), ("ab", False), ("aaaa", True), ("....", True), ("12345", True), ("True", True),
    ("Привет2", True), ("ключ три", False), ("false", False), ("FALSE", False), ("true ", True), ("Level2 start", True), ("start level 2", False), ("a/b/c", True), ("a/b", False),
    ('x"/a/b/', False), ("D41D8CD98F00B204E9800998ECF8427E", True), ("d41d8cd9-8f00-b204-e980-0998ecf8427e", True), ("²³", True), (" 7 up", False),
]


def test_predicates(spark):
    df = spark.createDataFrame(PREDICATES, "s string, bad boolean")
    assert df.where(predicates.is_not_allowed(F.col("s")) != F.col("bad")).collect() == []


def test_text_functions(spark):
    df = spark.createDataFrame([("a\r\nb", "a<cf>b"), ('\t"\n\n', '\\t""\\n\\n')], "s string, e string")
    assert df.where(text.escape(F.col("s")) != F.col("e")).count() == 0
    csv = spark.createDataFrame([("a,b", '"a,b"'), ('say "x"', '"say ""x"""'), ('say ""x""', '"say ""x"""')], "s string, e string")
    assert csv.where(text.csv_field(F.col("s")) != F.col("e")).count() == 0
    keys = spark.createDataFrame(
        [("N", "N::N::k", "k", "N::k"), ("", "k", "k", "k"), ("a\\Eb", "a\\Eb::k", "k", "k"), ("N", "M::k", "M::k", "M::k")],
        "n string, k string, bare string, one string",
    )
    got = keys.select("bare", text.actual_key(F.col("n"), F.col("k")).alias("b"), "one", text.without_one_prefix(F.col("n"), F.col("k")).alias("o")).collect()
    assert all(r["bare"] == r["b"] and r["one"] == r["o"] for r in got)
    crc = spark.createDataFrame([("Alternates between A and B outputs, starting with A",), ("😀x",)], "s string").select("s", text.string_crc32(F.col("s")).alias("crc")).collect()
    assert [r["crc"] for r in crc] == [locres.string_crc(r["s"]) for r in crc] and crc[0]["crc"] == 0x84A5B608


def test_value_cipher(spark):
    key = F.lit(bytes(range(32)))
    df = spark.createDataFrame([("plain",), ("",), ("äöü 😀" * 9,), ("exactly 11",)], "s string")
    done = df.select(
        "s", text.decrypt_value(text.encrypt_value(F.col("s"), key, "|end|"), key, "|end|").alias("back"),
        text.decrypt_value(F.lit("no cipher"), key, "|end|").alias("bad"),
    )
    assert all(r["s"] == r["back"] and r["bad"] == "" for r in done.collect())


def test_merge_rules(spark):
    new = spark.createDataFrame([("1", "new", ""), ("2", "s", ""), ("3", "s", ""), ("5", "n", "")], "key string, source string, translation string")
    old = spark.createDataFrame(
        [("1", "old", "", 1), ("2", "s", "t", 2), ("3", "s", "", 3), ("4", "only", "x", 4), ("2", "s", "", 5)],
        "key string, source string, translation string, ord int",
    )
    merged = catalog.merge(new, catalog.collapse_old(old))
    assert sorted(map(tuple, merged.collect())) == [
        ("1", "new", "old", "merged"), ("2", "s", "t", "merged"), ("3", "s", "", "merged"), ("4", "only", "x", "added"), ("5", "n", "", "new"),
    ]
    assert tuple(catalog.merge_counters(merged).head()) == (4, 3, 1, 5)


def test_binary_scans(spark):
    digest = b"D41D8CD98F00B204E9800998ECF8427E"
    export = b"xx" + digest + b"\0" + struct.pack("<i", 6) + b"hello\0" + digest + b"\0" + struct.pack("<i", -5)
    package = b"\x29\x01\x1f\x1ftext here\x00\x1f" + digest + b"\x29\x01zz"
    df = spark.createDataFrame([("a", bytearray(export)), ("b", bytearray(b"")), ("c", None)], "path string, content binary")
    assert [(r["path"], r["key"], r["source"]) for r in binscan.scan(df, "export").collect()] == [("a", digest.decode(), "hello")]
    df = spark.createDataFrame([("a", bytearray(package))], "path string, content binary")
    assert [(r["key"], r["source"]) for r in binscan.scan(df, "package").collect()] == [(digest.decode(), "text here")]


def test_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("N::k", 'say "x", y', "t"), ("b", "plain", "")], "key string, source string, translation string")
    files.write_catalog(rows, str(tmp_path / "csv"))
    back = files.read_catalog(spark, str(tmp_path / "csv")).collect()
    assert sorted((r["key"], r["source"], r["translation"], r["namespace"]) for r in back) == [("N::k", 'say "x", y', "t", "N"), ("b", "plain", "", "")]
    rows.write.parquet(str(tmp_path / "t"))
    assert files.manifest(spark, str(tmp_path / "t")).count() > 0
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.locres").write_bytes(GOLDEN)
    assert locres.read_locres(spark, str(tmp_path / "d")).count() == 2


def test_json_walk_has_no_depth_limit(spark):
    def nested(n, key):
        text = f'{{"Namespace": "n", "Key": "{key}", "SourceString": "braces }}}} {{{{ [ \\\\\\" in a string"}}'
        for k in range(n):
            text = f'{{"a": {text}}}' if k % 2 else f"[{text}]"
        return text

    df = spark.createDataFrame([(n, nested(n, f"k{n}")) for n in (0, 7, 8, 14, 400)] + [(99, "[" * 40), (100, None)], "id int, j string")
    assert sorted((r["id"], r["key"]) for r in files.walk_json(df, "j", "id").collect()) == [(0, "k0"), (7, "k7"), (8, "k8"), (14, "k14"), (400, "k400")]
    assert files.walk_json(df.where("id in (99, 100)"), "j", "id").count() == 0


def test_stream_merges_batches(spark, tmp_path):
    from lokalith.streaming.incremental import catalog_store, merge_stream

    schema = "key string, source string, translation string"
    for n, rows in enumerate(([("1", "a", "t")], [("1", "b", ""), ("2", "c", "")])):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        merge_stream(stream, str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination(60)
    got = catalog_store(spark, str(tmp_path / "store")).read().collect()
    assert sorted(map(tuple, got)) == [("1", "b", "t"), ("2", "c", "")]


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["key", "namespace", "source"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def rows_of(spark, rows):
    df = spark.createDataFrame(rows, "src_path string, ord long, key string, source string, namespace string")
    return catalog_from(df, **{c: F.col(c) for c in df.columns})


def test_extract_order(spark):
    """Conflicts are found before noise goes; the last file, then the last row, writes a key; developer rows do not write."""
    rows = rows_of(spark, [
        ("a", 1, "k1", "good text", ""), ("a", 2, "k1", "None", ""),
        ("a", 9, "k2", "first file", ""), ("b", 1, "k2", "second file", ""),
        ("a", 3, "k3", "same text", "x"), ("a", 4, "k3", "same text", "y"),
        ("a", 5, "k4", "kept text", "x"), ("b", 6, "k4", "other text", "UMG"), ("b", 7, "k5", "12345", ""),
    ])
    got = sorted((r["key"], r["source"], r["namespace"]) for r in catalog.extract(rows).collect())
    assert got == [("k2", "second file", ""), ("k3", "same text", "y"), ("k4", "kept text", "x")]
    assert catalog.extract(rows.where("false")).count() == 0


def test_package_records():
    good, other = b"D41D8CD98F00B204E9800998ECF8427E", b"E41D8CD98F00B204E9800998ECF8427E"
    one = lambda body, digest: b"\x29\x01" + body + b"\x00\x1f" + digest
    data = one(b"first", good) + b"zz" + one(b"second", good)
    assert [(d, s) for _, d, s, _ in binscan.package_records(data)] == [(good.decode(), "first"), (good.decode(), "second")]
    data = one(b"bad \x29\x01inner", b"0" * 32) + one(b"after", other)
    assert [s for _, _, s, _ in binscan.package_records(data)] == ["after"]
    data = one(b"x", good) + b"--" + one(b"noise\x29\x01\x1f\x1ftext", good)
    assert [s for _, _, s, _ in binscan.package_records(data)] == ["text"]
    assert [(s, r) for _, _, s, r in binscan.package_records(one(b"?it\x19 s\0", good))] == [("it\x19 s\0", True)]
    assert [s for _, _, s, _ in binscan.package_records(one(b"\0\0\0abc", good))] == ["\0\0abc"]
    assert list(binscan.package_records(b"")) == list(binscan.package_records(b"\x29\x01 no end")) == []


def test_asset_kinds_and_reader(spark, tmp_path):
    digest = b"D41D8CD98F00B204E9800998ECF8427E"
    export = digest + b"\0" + struct.pack("<i", 6) + b"hello\0"
    for name, raw in {
        "p1/Game/a.uexp": export, "p1/Game/Sound/b.uexp": export, "p1/Engine/c.uexp": export, "p2/Game/d.UMAP": b"\x29\x01map text\x00\x1f" + digest,
        "p2/Game/e.uasset": b"SoundWave\x29\x01noise\x00\x1f" + digest, "p2/Game/f.txt": export,
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    found = extract.read_assets(spark, str(tmp_path))
    assert sorted((r["path"].rsplit("/", 1)[1], r["container"]) for r in found.collect()) == [("a.uexp", "p1"), ("d.UMAP", "p2"), ("e.uasset", "p2")]
    assert sorted(r["source"] for r in extract.scan_assets(found).collect()) == ["map text"]  # one key, the later path writes it
    assert sorted(r["source"] for r in extract.asset_rows(found).collect()) == ["hello", "map text"]
    assert extract.read_assets(spark, str(tmp_path), part="/P1/", all_folders=True).count() == 2


def test_journal_round_trip(spark, tmp_path):
    path = str(tmp_path / "journal")
    odd = [('say ""x""', "t\\n1"), ("tab\there", "line\nend\r"), ("back\\slash \\t", ""), ("twice", "old")]
    journal.append(spark.createDataFrame(odd, "source string, translation string"), path)
    journal.append(spark.createDataFrame([("twice", "new")], "source string, translation string"), path)
    assert sorted(map(tuple, journal.read(spark, path).collect())) == sorted([*odd[:3], ("twice", "new")])


def test_translation_asks_again_only_for_what_is_missing(spark, tmp_path):
    rows = rows_of(spark, [("f", n, f"k{n}", f"text {n % 7}", "") for n in range(20)]).withColumn("translation", F.when(F.col("ord") == 19, "own").otherwise(""))
    asked = spark.sparkContext.accumulator(0)

    def ask(payload):
        asked.add(len(payload.split("|||")))
        return payload.upper() + "|||extra" if "text 2" in payload and fail else payload.upper()

    fail = True
    first = translate.translate(rows, ask, str(tmp_path / "j"), size=3)
    got = {r["ord"]: r["translation"] for r in first.collect()}
    assert got[3] == "TEXT 3" and got[0] == got[2] == "" and asked.value == 7
    assert got[19] == "TEXT 5"  # a source that was asked for overwrites its twins
    fail, before = False, asked.value
    got = {r["ord"]: r["translation"] for r in translate.translate(rows, ask, str(tmp_path / "j"), size=3).collect()}
    assert all(got[n] == f"TEXT {n % 7}" for n in range(19)) and asked.value - before == 3 and got[19] == "own"


def test_requests_are_retried():
    def server(errors):
        def ask(payload):
            if errors:
                raise errors.pop(0)
            return payload

        return ask

    waits = []
    assert translate.ask_with_retry(server([OSError("a"), OSError("b")]), "p", wait=waits.append) == ("p", None, 3) and waits == [2.0, 4.0]
    assert translate.ask_with_retry(server([OSError("x")] * 3), "p", wait=waits.append) == (None, "x", 3)
    assert translate.ask_with_retry(server([translate.Refused("no key")]), "p", wait=waits.append) == (None, "no key", 1)


def test_one_group_is_numbered_in_ranges(spark):
    rows = spark.range(3000).select(F.lit("one").alias("src_path"), (F.col("id") * 7 % 3001).alias("ord"), F.lit("abc").alias("key"))
    got = catalog.running(rows, "src_path", amount=F.length("key"), width=100).orderBy("ord").collect()
    assert [r["index"] for r in got] == list(range(3000)) and [r["before"] for r in got] == list(range(0, 9000, 3))
    many = rows.select("src_path", F.col("ord").cast("string").alias("key"), F.lit(1).alias("ns_hash"), F.lit(2).alias("key_hash"), "ord")
    objects = files.sidecar_json(many, entries=1000)
    assert objects.count() == 3 and files.sidecar_rows(objects).count() == 3000


def test_csv_options_and_order(spark, tmp_path):
    rows = spark.createDataFrame([("b", "x", ""), ("a::2", "x,y", "t"), ("a::10", 'q"', None), ("B", "x", "")], "key string, source string, translation string")
    path = str(tmp_path / "c")
    lines = lambda: [line for f in sorted(p for p in (tmp_path / "c").iterdir() if p.name.startswith("part")) for line in f.read_text().splitlines()]
    files.write_catalog(rows, path, banner="# b", footer="# e")
    assert lines() == ["# b", "key,source,Translation", "B,x,", 'a::10,"q""",', 'a::2,"x,y",t', "b,x,", "# e"]
    files.write_catalog(rows, path, collation="UNICODE", table=True)
    assert lines() == ['a::10|"q"""|', 'a::2|"x,y"|t', "b|x|", "B|x|"]
    assert files.csv_header(True, True) == "[url][key][hash],source,Translation"
    files.write_skipped(spark.createDataFrame([("a\tb",)], "line string"), str(tmp_path / "s"))
    files.write_skipped(spark.createDataFrame([("c",)], "line string"), str(tmp_path / "s"), append=True)
    assert sorted(r["value"] for r in spark.read.option("lineSep", "\n").text(str(tmp_path / "s")).collect()) == ["a\\tb\r", "c\r"]
    files.write_skipped(rows, "", "key")


def test_table_with_version_number_decodes():
    entries = [("ns", 0, "k", 0, 9, "value"), ("ns", 0, "k2", 0, 3, "")]
    head, found = locres.decode(locres.encode(entries, locres.COMPACT, 1))
    assert head["number"] == 1 and [(e[0], e[2], e[4], e[6]) for e in found] == [("ns", "k", 9, "value"), ("ns", "k2", 3, "")]


def test_golden_table_through_dataframes(spark, tmp_path):
    strings = [
        ("FED912BD4D41A7463FFD82BBE165BDE2", 'Allows for opening and closing a ""gate"" to control the execution flow.'),
        ("FB19F4DC4B50C3CC96755DBA24440843", "Alternates between A and B outputs, starting with A"),
    ]
    rows = rows_of(spark, [("x/golden.csv", n, k, v, "") for n, (k, v) in enumerate(strings)])
    written = locres.write_locres(rows, str(tmp_path / "out")).collect()
    assert [tuple(r) for r in written] == [("golden.locres", 262)] and (tmp_path / "out" / "golden.locres").read_bytes() == GOLDEN


def test_patch_keeps_the_template(spark):
    key, mark = F.lit(bytes(range(32))), "|end|"
    rows = rows_of(spark, [("f", n, k, v, "ns") for n, (k, v) in enumerate((("ns::a", "one"), ("b", "two"), ("c", "three")))])
    made = locres.encoded(locres.table_rows(rows, locres.ENCRYPTED, key, mark), version=locres.ENCRYPTED).select(F.col("src_path").alias("path"), "content")
    template = bytes(made.head()["content"])
    catalog_rows = spark.createDataFrame(
        [("ns::a", "x", "eins", 1), ("ns::a", "x", "uno", 2), ("ns::b", "zwei", " ", 3), ("ns::c", "", "", 4)],
        "key string, source string, translation string, ord int",
    )
    frame = spark.createDataFrame([("f", bytearray(template))], "path string, content binary")
    patched = bytes(locres.patch_files(frame, catalog_rows, key, mark).head()["content"])
    at = locres.header_of(template)["offset"]
    assert patched[:at] == template[:at] and locres.inspect(patched)["consistent"]
    entries = locres.decoded(spark.createDataFrame([("f", bytearray(patched))], "path string, content binary"))
    assert [r["v"] for r in entries.orderBy("ord").select(text.decrypt_value(F.col("value"), key, mark).alias("v")).collect()] == ["uno", "zwei", "three"]
    assert tuple(catalog.patch_counters(locres.patched_strings(frame, catalog_rows, key, mark)).head()) == (2, 1, 3)
    assert [(e[1], e[3]) for e in locres.decode(template)[1]] == [(plain_city64("ns".encode("utf-16-le")) >> 32, plain_city64(k.encode("utf-16-le")) >> 32) for k in "abc"]
    with pytest.raises(Exception, match="only encrypted tables"):
        locres.table_strings(spark.createDataFrame([("g", bytearray(GOLDEN))], "path string, content binary")).count()


def test_string_keys_last_wins(spark):
    entries = spark.createDataFrame([("f", 0, "n", "a", 1), ("f", 0, "n", "b", 2), ("f", 1, "n", "c", 3)], "path string, str_idx int, ns string, key string, ord int")
    assert sorted((r["str_idx"], r["key"]) for r in locres.string_keys(entries).collect()) == [(0, "b"), (1, "c")]


def test_city_hash():
    assert plain_city64(b"") == 0x9AE16A3B2F90404F and plain_city64(b"a") == 0xB3454265B6DF75E3
    rng = random.Random(1)
    texts = [rng.randbytes(n) for n in [*range(300), *(rng.randrange(3000) for _ in range(100))]]
    rng.shuffle(texts)
    assert [int(h) for h in city64(texts)] == [plain_city64(t) for t in texts] and len(city64([])) == 0


def test_masked_search(spark):
    df = spark.createDataFrame([(bytearray(b"aXaYaa\x00a"),), (bytearray(b"zz"),), (bytearray(b""),)], "b binary")
    assert [r["f"] for r in df.select(text.masked_finds(F.col("b"), [ord("a"), None, ord("a")]).alias("f")).collect()] == [[0, 2, 5], [], []]


def test_grouped_names_get_their_container(spark):
    raw = locres.encode([("", 0, "k", 0, 1, "v")])
    frame = spark.createDataFrame([("x/Game.locres", "p1", bytearray(raw)), ("y/game.locres", "p2", bytearray(raw))], "path string, container string, content binary")
    assert sorted((r["csv_base_name"], r["container"], r["key"]) for r in locres.grouped(frame).collect()) == [("Game_p1", "p1", "k"), ("game_p2", "p2", "k")]


def test_command_line(spark, tmp_path):
    """Assets and tables to a catalog, translated by hand, merged again, encoded, and patched into an encrypted template."""
    from lokalith.__main__ import run

    digest = b"D41D8CD98F00B204E9800998ECF8427E"
    (tmp_path / "in" / "p1").mkdir(parents=True)
    (tmp_path / "in" / "p1" / "a.uexp").write_bytes(digest + b"\0" + struct.pack("<i", 10) + b"asset txt\0")
    raw = locres.encode([("ns", 5, "k1", 6, 1, "table text"), ("ns", 5, "k2", 7, 1, "None"), ("ns", 5, "k3", 8, 1, "")], locres.ENCRYPTED)
    (tmp_path / "in" / "p1" / "Game.locres").write_bytes(raw)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    assert run(spark, ["extract", source, target]) == {"extracted": 2, "merged": 0, "added": 0, "total": 2, "processed": 1, "damaged": 0}
    rows = {r["key"]: (r["source"], r["translation"]) for r in files.read_catalog(spark, target).collect()}
    assert rows == {digest.decode(): ("asset txt", ""), "ns::k1": ("table text", "")}
    done = spark.createDataFrame([("ns::k1", "table text", "Tisch"), ("gone", "old", "alt")], "key string, source string, translation string")
    files.write_catalog(done, target)
    assert run(spark, ["extract", source, target, "--path", "GAME"]) == {"extracted": 1, "merged": 1, "added": 1, "total": 2, "processed": 1, "damaged": 0}
    assert run(spark, ["encode", target, str(tmp_path / "made"), "--number", "1"]) == {"namespaces": 2, "entries": 2, "filled": 2}
    back = {(r["ns"], r["key"]): r["value"] for r in locres.read_locres(spark, str(tmp_path / "made")).collect()}
    assert back == {("ns", "k1"): "Tisch", ("", "gone"): "alt"}
    sealed = ["--encrypted", "--key", "00" * 32, "--mark", "|end|"]
    run(spark, ["encode", target, str(tmp_path / "sealed"), *sealed])
    stored = {(r["ns"], r["key"]): (r["ns_hash"], r["key_hash"]) for r in locres.read_locres(spark, str(tmp_path / "sealed")).collect()}
    assert stored["ns", "k1"] == (5, 6) and stored["", "gone"] == (0, plain_city64("gone".encode("utf-16-le")) >> 32)
    files.write_catalog(spark.createDataFrame([("ns::k1", "x", "neu")], "key string, source string, translation string"), str(tmp_path / "more"))
    assert run(spark, ["patch", str(tmp_path / "sealed" / "out.locres"), str(tmp_path / "more"), str(tmp_path / "patched"), *sealed[1:]]) == {"translated": 1, "kept": 1, "total": 2}
    assert (tmp_path / "patched" / "out.locres").exists()
    assert run(spark, ["tables", source, str(tmp_path / "folder")]) == {"extracted": 3, "merged": 0, "added": 0, "total": 3, "processed": 1, "damaged": 0}
    assert run(spark, ["tables", source, str(tmp_path / "folder")]) == {"extracted": 3, "merged": 3, "added": 0, "total": 3, "processed": 1, "damaged": 0}
    with pytest.raises(SystemExit):
        run(spark, ["patch", "a", "b", "c"])
