"""Compiled string tables: codec, reader, writer, patch and verification.

Decoding and encoding work on one file at a time inside Arrow batches, as a string table is one file with offsets
from its start; everything else is DataFrame operations. Values of encrypted tables are encrypted and decrypted by
Column expressions; key and end mark are the caller's.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lokalith.functions import predicates, text
from lokalith.functions.hashes import city64
from lokalith.operators.catalog import disambiguated_names
from lokalith.sources.files import binary_files, dump

#: Fixed values of the format: magic, and the version number of encrypted files.
MAGIC = bytes.fromhex("0E147475674A03FC4A15909DC3377F1B")
COMPACT, ENCRYPTED, ENCRYPTED_VERSION = 1, 3, 10100
ENTRY = "ns string, ns_hash bigint, key string, key_hash bigint, source_crc bigint, str_idx int, value string"


def pack_string(s: str) -> bytes:
    if not s:
        return struct.pack("<i", 0)
    if s.isascii():
        return struct.pack("<i", len(s) + 1) + s.encode() + b"\0"
    raw = s.encode("utf-16-le", "surrogatepass")
    return struct.pack("<i", -(len(raw) // 2 + 1)) + raw + b"\0\0"


def string_crc(s: str) -> int:
    raw = s.encode("utf-16-le", "surrogatepass")
    return zlib.crc32(b"".join(raw[i : i + 2] + b"\0\0" for i in range(0, len(raw), 2)))


class _Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def number(self, form: str) -> int:
        (value,) = struct.unpack_from("<" + form, self.data, self.at)
        self.at += struct.calcsize("<" + form)
        return value

    def string(self) -> str:
        n = self.number("i")
        width = 1 if n >= 0 else 2
        raw = self.data[self.at : self.at + abs(n) * width]
        self.at += abs(n) * width
        return raw.decode("latin-1" if n >= 0 else "utf-16-le", "replace")[:-1] if n else ""


def header_of(data: bytes, size: int | None = None) -> dict:
    """Version, flags, string-table offset and start of the key section; ``data`` may be the head of a file of ``size`` bytes."""
    if data[:16] != MAGIC:
        raise ValueError("no string table")
    r, version = _Reader(data, 17), data[16]
    number = encrypted = 0
    if version == ENCRYPTED:
        number = r.number("i")
        encrypted = r.number("i") if number >= ENCRYPTED_VERSION else int(number >= 10000)
    elif version == COMPACT and struct.unpack_from("<q", data, 17)[0] >= (len(data) if size is None else size):
        number = r.number("i")  # compact with an explicit version number
    offset = r.number("q")
    entries = r.number("I") if version == ENCRYPTED else None
    return {"version": version, "number": number, "encrypted": bool(encrypted), "offset": offset, "entries": entries, "keys_at": r.at}


def strings_of(data: bytes, head: dict) -> tuple[list[str], int]:
    """All strings of the table and where it ends."""
    strings, r = [], _Reader(data, head["offset"])
    for _ in range(r.number("I")):
        strings.append(r.string())
        if head["version"] == ENCRYPTED:
            r.number("i")
    return strings, r.at


def decode(data: bytes) -> tuple[dict, list[tuple]]:
    """Header and entries ``(ns, ns_hash, key, key_hash, source_crc, str_idx, value)`` in file order."""
    head = header_of(data)
    hashed = head["version"] == ENCRYPTED
    strings, head["end"] = strings_of(data, head)
    r, out = _Reader(data, head["keys_at"]), []
    for _ in range(r.number("I")):
        ns_hash = r.number("I") if hashed else 0
        ns = r.string()
        for _ in range(r.number("I")):
            key_hash = r.number("I") if hashed else 0
            key, crc, at = r.string(), r.number("I"), r.number("i")
            out.append((ns, ns_hash, key, key_hash, crc, at, strings[at] if 0 <= at < len(strings) else ""))
    head["keys_end"] = r.at
    return head, out


def encode(entries: Iterable[tuple], version: int = COMPACT, number: int | None = None) -> bytes:
    """Entries ``(ns, ns_hash, key, key_hash, source_crc, value)`` in order; namespaces in order of appearance.

    ``number`` writes the explicit version number of a compact file. Values of an encrypted file come encrypted.
    """
    groups: dict[str, list[tuple]] = {}
    for e in entries:
        if e[2]:
            groups.setdefault(e[0], []).append(e)
    hashed, values, keys = version == ENCRYPTED, [], [struct.pack("<I", len(groups))]
    for ns, own in groups.items():
        keys.append((struct.pack("<I", own[0][1]) if hashed else b"") + pack_string(ns) + struct.pack("<I", len(own)))
        for _, _, key, key_hash, crc, value in own:
            keys.append((struct.pack("<I", key_hash) if hashed else b"") + pack_string(key) + struct.pack("<Ii", crc, len(values)))
            values.append(pack_string(value) + (struct.pack("<i", 1) if hashed else b""))
    head = MAGIC + bytes([version])
    if hashed:
        head += struct.pack("<ii", ENCRYPTED_VERSION, 1)
    elif number is not None:
        head += struct.pack("<i", number)
    count = struct.pack("<I", len(values)) if hashed else b""
    body = b"".join(keys)
    return head + struct.pack("<q", len(head) + 8 + len(count) + len(body)) + count + body + struct.pack("<I", len(values)) + b"".join(values)


#: Bytes of one batch of rows, about, and of the largest file whose entries are all held at once.
HELD = 8 << 20


def _whole(data: bytes) -> Iterator[tuple]:
    """Entries of :func:`decode` with their numbers, of a large table as a stream, once it is known that nothing in it is damaged."""
    if len(data) <= HELD:
        yield from ((*e, n) for n, e in enumerate(decode(data)[1]))
        return
    from lokalith.sources.locres_format import entries_of

    read_at = lambda at, n: data[at : at + n]
    for _ in entries_of(read_at, len(data)):
        pass
    yield from entries_of(read_at, len(data))


def decoded(files: DataFrame) -> DataFrame:
    """``files(path, content)`` -> one row per entry; damaged files give one row with ``error`` set."""
    names = ["path", *(f.split(" ")[0] for f in ENTRY.split(", ")), "ord", "error"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string()]

    def told(path: str, content: bytes) -> Iterator[tuple]:
        try:
            for e in _whole(content):
                yield path, *e, None
        except (ValueError, struct.error, IndexError) as e:
            yield path, *[None] * 8, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            rows, held = [], 0
            for path, content in zip(batch.column(0), batch.column(1), strict=True):  # of the contents one is held at a time
                for row in told(path.as_py(), content.as_py()):
                    rows.append(row)
                    held += len(row[7] or "") + 256
                    if held > HELD:
                        yield made(rows)
                        rows, held = [], 0
            if rows:
                yield made(rows)

    return files.select("path", "content").mapInArrow(run, f"path string, {ENTRY}, ord long, error string")


def read_locres(spark, path: str) -> DataFrame:
    """Entries of all string tables below ``path``; names are pruned before any byte is read."""
    return decoded(binary_files(spark, path, "*.locres"))


def encoded(rows: DataFrame, group: str = "src_path", version: int = COMPACT, number: int | None = None) -> DataFrame:
    """One file per group: ``group, content``; rows are a catalog with ``value`` and ``source_crc``.

    A task holds one group at a time: its entries' texts and the file, some 5 times the file in memory (measured: 165 MB for a file
    of 31 MB); larger tables are written by ranges (:func:`lokalith.sources.locres_parts.write_encoded`). ``number`` writes the
    explicit version number of a compact file.
    """
    kind = rows.schema[group].dataType.simpleString()
    columns = ["namespace", "ns_hash", "key", "key_hash", "source_crc", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple] = []
        now, made, held = None, [], 0
        kept = pa.string()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], kept), pa.array([m[1] for m in made], pa.binary())], names=[group, "content"])

        for batch in batches:
            kept = batch.column(0).type
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for name, *entry in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if own and name != now:
                        made.append((now, encode(own, version, number)))
                        held, own = held + len(made[-1][1]) + 64, []
                        if held > HELD:
                            yield out()
                            made, held = [], 0
                    now = name
                    own.append(tuple(entry))
        if own:
            made.append((now, encode(own, version, number)))
        if made:
            yield out()

    wanted = rows.select(group, "ord", *columns).repartition(group).sortWithinPartitions(group, "ord").select(group, *columns)
    return wanted.mapInArrow(run, f"{group} {kind}, content binary")


@F.arrow_udf(LongType())
def fallback_hash(texts: pa.Array) -> pa.Array:
    """Upper half of CityHash64 over the UTF-16 text, 0 for an empty one.

    For keys without a stored hash only: which half a reader expects depends on what built the file.
    """
    raw = [(t or "").encode("utf-16-le", "surrogatepass") for t in texts.to_pylist()]
    upper = (city64(raw) >> 32).astype("int64")
    return pa.array(np.where([not t for t in raw], 0, upper), pa.int64())


def table_rows(rows: DataFrame, version: int = COMPACT, key: Column | None = None, mark: str | None = None, sealed: bool = True) -> DataFrame:
    """Catalog rows as string-table entries, ready for :func:`encoded`.

    Keys lose every leading ``namespace::``, empty ones are dropped; ``source_crc`` is of the unescaped source; ``value``
    is the translation, else the source, unescaped. Encrypted tables need the caller's ``key`` and ``mark``, and keys
    and namespaces whose stored hash is 0 get the fallback hash. Values that are not ``sealed`` here are left to the writer.
    """
    bare = rows.withColumn("key", text.actual_key(F.col("namespace"), F.col("key"))).where("key <> ''")
    out = bare.withColumn("source_crc", text.string_crc32(text.unescape(F.col("source")))).withColumn("value", text.effective_text(F.col("translation"), F.col("source")))
    if version != ENCRYPTED:
        return out
    if key is None or mark is None:
        raise ValueError("an encrypted table needs a key and a mark")
    stored = lambda name, of: F.when(F.col(name) != 0, F.col(name)).otherwise(fallback_hash(F.col(of)))
    hashed = out.withColumn("ns_hash", stored("ns_hash", "namespace")).withColumn("key_hash", stored("key_hash", "key"))
    return hashed.withColumn("value", text.encrypt_value(F.col("value"), key, mark)) if sealed else hashed


def write_locres(
    rows: DataFrame, target: str, group: str = "src_path", version: int = COMPACT, number: int | None = None, key: Column | None = None,
    mark: str | None = None,
) -> DataFrame:
    """Writes one ``<base name>.locres`` for each group below ``target``: ``name, bytes``, lazily."""
    files = encoded(table_rows(rows, version, key, mark), group, version, number)
    return dump(files.select(F.concat(text.base_name(F.col(group)), F.lit(".locres")).alias("name"), "content"), target)


def table_strings(files: DataFrame) -> DataFrame:
    """``path, str_idx, raw`` of every string of encrypted tables with an explicit flag; other files are an error."""
    names = ["path", "str_idx", "raw"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                head = header_of(content)
                if head["version"] != ENCRYPTED or head["number"] < ENCRYPTED_VERSION or not head["encrypted"]:
                    raise ValueError(f"{path}: only encrypted tables can be patched")
                found, _ = strings_of(content, head)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array(range(len(found)), pa.int32()), pa.array(found, pa.string())], names=names)

    return files.select("path", "content").mapInArrow(run, "path string, str_idx int, raw string")


def string_keys(entries: DataFrame) -> DataFrame:
    """``path, str_idx, ns, key``: of entries that share a string the last one in the file names it."""
    last = entries.groupBy("path", "str_idx").agg(F.max_by(F.struct("ns", "key"), "ord").alias("r"))
    return last.select("path", "str_idx", "r.ns", "r.key")


def patched_strings(files: DataFrame, catalog: DataFrame, key: Column, mark: str) -> DataFrame:
    """``path, str_idx, key, value, translated`` of every string of the templates.

    ``catalog(key, source, translation, ord)`` holds composite keys; of a repeated key the last row counts, its source where the
    translation is blank, rows with neither not at all. A translation that is empty once unescaped keeps the original.
    """
    return patched_from(table_strings(files), decoded(files), catalog, key, mark)


def patched_from(strings: DataFrame, entries: DataFrame, catalog: DataFrame, key: Column, mark: str) -> DataFrame:
    """As :func:`patched_strings`, from strings and entries that are known."""
    plain = F.when(~predicates.is_blank(F.col("translation")), F.col("translation")).otherwise(F.coalesce("source", F.lit("")))
    usable = catalog.select(F.col("key").alias("c_key"), plain.alias("t"), "ord").where(~predicates.is_blank(F.col("t")))
    new = usable.groupBy("c_key").agg(F.max_by("t", "ord").alias("t")).select("c_key", text.unescape(F.col("t")).alias("t"))
    kept = strings.select("path", "str_idx", text.decrypt_value(F.col("raw"), key, mark).alias("old"))  # sealed texts don't compress in a shuffle
    named = kept.join(string_keys(entries), ["path", "str_idx"], "left").withColumn("c_key", text.composite_key(F.col("ns"), F.col("key")))
    joined = named.join(new, "c_key", "left").withColumn("translated", F.coalesce(F.col("t") != "", F.lit(False)))
    return joined.select(
        "path", "str_idx", F.col("c_key").alias("key"),
        F.when(F.col("translated"), F.col("t")).otherwise(F.col("old")).alias("value"), "translated",
    )


def patch_files(files: DataFrame, catalog: DataFrame, key: Column, mark: str) -> DataFrame:
    """``path, content``: each template with its header and keys as they are and a string table of the patched values."""
    sealed = patched_strings(files, catalog, key, mark).select("path", "str_idx", text.encrypt_value(F.col("value"), key, mark).alias("raw"))

    def run(template: pa.Table, strings: pa.Table) -> pa.Table:
        rows = template.to_pylist()
        for row in rows:
            raw = row["content"]
            values = strings.sort_by("str_idx").column("raw").to_pylist()
            table = b"".join(pack_string(v) + struct.pack("<i", 1) for v in values)
            row["content"] = raw[: header_of(raw)["offset"]] + struct.pack("<I", len(values)) + table
        return pa.Table.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("content", pa.binary())]))

    return files.select("path", "content").groupBy("path").cogroup(sealed.groupBy("path")).applyInArrow(run, "path string, content binary")


def patched(entries: DataFrame, translations: DataFrame) -> DataFrame:
    """Entries of a template with translated values by composite key; ``translated`` says which were."""
    t = translations.select(F.col("key").alias("t_key"), F.col("value").alias("t_value"))
    joined = entries.join(t, text.composite_key(F.col("ns"), F.col("key")) == F.col("t_key"), "left")
    done = F.coalesce(F.col("t_value") != "", F.lit(False))
    return joined.withColumn("value", F.when(done, F.col("t_value")).otherwise(F.col("value"))).withColumn("translated", done).drop("t_key", "t_value")


def inspect(data: bytes) -> dict:
    """Diagnostics: header, counts, and whether the key section ends where the strings begin."""
    head, entries = decode(data)
    return head | {
        "namespaces": len({e[0] for e in entries}), "keys": len(entries), "filled": sum(bool(e[6]) for e in entries),
        "consistent": head["keys_end"] == head["offset"] and head["end"] == len(data),
    }


def inspected(files: DataFrame) -> DataFrame:
    """``path, version, encrypted, namespaces, keys, filled, consistent, error``: diagnostics of each file."""
    names = ["path", "version", "encrypted", "namespaces", "keys", "filled", "consistent", "error"]
    kinds = [pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = inspect(content)
                    row = [path, *(found[n] for n in names[1:-1]), None]
                except (ValueError, struct.error, IndexError) as e:
                    row = [path, *[None] * 6, str(e)]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

    schema = "path string, version int, encrypted boolean, namespaces int, keys long, filled long, consistent boolean, error string"
    return files.select("path", "content").mapInArrow(run, schema)


def grouped(files: DataFrame, keep_blank: bool = False, entries: DataFrame | None = None) -> DataFrame:
    """Entries of ``files(path, container, content)`` (or known ``entries`` of ``files(path, container)``), with ``csv_base_name`` of their file; without a value only if ``keep_blank``.

    Names are told apart before any table is decoded: where two base names are equal, all get their container.
    """
    entries = grouped_entries(files, entries=entries).where("error is null").drop("error")
    return entries if keep_blank else entries.where("value <> ''")


def grouped_entries(files: DataFrame, read: DataFrame | None = None, entries: DataFrame | None = None) -> DataFrame:
    """As :func:`grouped`, blank values and a row with ``error`` for each damaged file included; ``read`` is what is decoded, the same files,
    ``entries`` (with ``container``) what is decoded already."""
    named = disambiguated_names(files.select("path", "container").distinct()).withColumnRenamed("path", "n_path").withColumnRenamed("container", "n_container")
    told = entries
    if told is None:
        found = decoded((files if read is None else read).select(F.to_json(F.struct("path", "container")).alias("path"), "content"))
        origin = F.from_json("path", "path string, container string")
        told = found.withColumn("o", origin).withColumn("path", F.col("o.path")).withColumn("container", F.col("o.container")).drop("o")
    return told.join(named, (F.col("path") == F.col("n_path")) & F.col("container").eqNullSafe(F.col("n_container"))).drop("n_path", "n_container")


def keyed(entries: DataFrame) -> DataFrame:
    """Grouped mode: entries under their composite key; empty keys are dropped, blank values stay."""
    return entries.where("key <> ''").withColumn("key", text.composite_key(F.col("ns"), F.col("key")))
