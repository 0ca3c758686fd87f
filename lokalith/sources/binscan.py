"""Text records inside unpacked binary assets, and the classifier of asset headers.

Files that fit into one value are scanned whole; larger ones by byte ranges, with the same records (:func:`tagged_ranges`).
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lokalith.functions import predicates, text

#: Byte signatures by kind, in order of precedence, and path rules of which the last one wins.
SIGNATURES = {
    "sound": [b"SoundWave", b"libVorbis", b"LipSyncFrameSequence"],
    "texture": [b"PF_DXT5", b"B8G8R8A8"],
    "blueprint": [b"BlueprintGeneratedClass", b"TextProperty"],
    "table": [b"StringTable", b"DataTable", bytes.fromhex("00220480"), bytes.fromhex("000000000064C100000000")],
}
PATH_KINDS = [("/Blueprints/", "blueprint"), ("/DataTables/", "table"), ("BP_", "blueprint"), ("/DT_", "table"), ("/DA_", "table")]
#: Folders without text.
NO_TEXT_FOLDERS = ["/sound/", "/effects/", "/fx/", "/vfx/", "/meshes/", "/mesh/", "/textures/", "/megascans/", "/music/"]
HEADER_BYTES = 1024
#: Start, separator and filler byte of a record in a package.
PACKAGE_START, PACKAGE_SEPARATOR, PACKAGE_FILLER = b"\x29\x01", b"\x00\x1f", b"\x1f"

#: Texts of one batch of records, about.
HELD = 8 << 20

_HASH = re.compile(rb"[0-9A-Fa-f]{32}")


def export_kind(content: Column, path: Column) -> Column:
    head = F.decode(F.substring(content, 1, HEADER_BYTES), "ISO-8859-1")
    kind = F.lit("none")
    for name, patterns in reversed(SIGNATURES.items()):
        kind = F.when(F.greatest(*[F.instr(head, p.decode("latin-1")) for p in patterns]) > 0, F.lit(name)).otherwise(kind)
    for part, name in PATH_KINDS:
        kind = F.when(F.contains(path, F.lit(part)), F.lit(name)).otherwise(kind)
    return kind


def outside_text(path: Column) -> Column:
    return F.lower(path).rlike("|".join(map(re.escape, NO_TEXT_FOLDERS)))


def export_records(data: bytes) -> Iterator[tuple[int, str, str, bool]]:
    """``(offset, hash, text, repair)``: 32 hex digits, a byte, a little-endian size, the text and its terminator."""
    at = 0
    while m := _HASH.search(data, at):
        i = m.start()
        if i + 37 > len(data):
            return
        (size,) = struct.unpack_from("<i", data, i + 33)
        end = i + 36 + size
        if size <= 0 or end > len(data):
            at = i + 1
            continue
        yield i, m.group().decode(), data[i + 37 : end].decode("utf-8", "replace"), False
        at = max(end, i + 1)


def _valid(digest: bytes) -> bool:
    """As :func:`lokalith.functions.predicates.is_valid_hash`, for bytes that are hex digits already."""
    return not digest.isdigit() and len(set(digest)) > 1


def _final_units(s: str, repair: bool) -> int:
    """UTF-16 units of the text as it is kept."""
    for old, new in [*(text.REPAIRS if repair else []), *([("\0", "")] if repair else []), *text.ESCAPES]:
        s = s.replace(old, new)
    return len(s.encode("utf-16-le", "surrogatepass")) // 2


def package_records(data: bytes) -> Iterator[tuple[int, str, str, bool]]:
    """``(offset, hash, text, repair)``: start mark, text, separator and 32 bytes of hash; ``repair`` where the text had
    to be read byte for byte.

    A text begins again behind a start mark with a filler byte inside it, and behind leading fillers. After a
    record with an invalid hash, or a text of one unit, the search goes on one byte after its start mark.
    """
    at = 0
    while (i := data.find(PACKAGE_START, at)) >= 0:
        at = i + 1
        j = data.find(PACKAGE_SEPARATOR, i + 2)
        if j < 0:
            return
        if j == i + 2:
            continue
        raw = data[i + 2 : j]
        if PACKAGE_START + PACKAGE_FILLER in raw and (k := raw.find(PACKAGE_START[1:] + PACKAGE_FILLER, 1)) >= 0:
            raw = raw[k + 2 :]
        raw = raw.lstrip(PACKAGE_FILLER) or raw[-1:]
        digest = data[j + 2 : j + 34].strip()
        if not _HASH.fullmatch(digest) or not _valid(digest):
            continue
        s = raw.decode("utf-8", "replace")
        repair = "\0" in s
        s = raw.decode("latin-1")[1:] if repair else s
        if _final_units(s, repair) == 1:
            continue
        yield i, digest.decode(), s, repair
        at = j + 36


def scan(files: DataFrame, kind: str) -> DataFrame:
    """``files(path, content)`` -> ``path, ord, key, source`` (escaped), valid hashes only.

    ``kind`` is ``export`` or ``package``. Texts of one character are left out. Of an export the first record of each
    key stays, and texts that start with three zero bytes are left out; of a package every record stays, so that
    conflicts are seen later. Null and empty content gives nothing.
    """
    told = tagged(files.select("path", "content", F.lit("none").alias("kind")), (kind,))
    return accepted(told, kind)


_TAGGED = "path string, what string, ord long, key string, raw string, repair boolean"
_TAGGED_KINDS = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()]


def tagged(files: DataFrame, kinds: tuple[str, ...] = ("export", "package")) -> DataFrame:
    """``files(path, content, kind)`` -> ``path, what, ord, key, source, reason``: one pass for every kind of record and of file.

    Files whose ``kind`` is ``none`` are scanned for records (``what`` says which); ``reason`` is null where one is accepted, else
    ``hash`` (no valid hash), ``decode`` (an export text that starts with three zero bytes) or ``short`` (one
    character). Every other file gives one row with its kind in ``what``. Null and empty content gives no record.
    """
    scanners = {"export": export_records, "package": package_records}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for n in range(batch.num_rows):  # of the contents one is held at a time
                path, kind = batch.column(0)[n].as_py(), batch.column(1)[n].as_py()
                content = batch.column(2)[n].as_py() or b""
                found = [(path, kind, None, None, None, None)] if kind != "none" else ((path, what, *r) for what in kinds for r in scanners[what](content))
                for row in found:
                    rows.append(row)
                    held += len(row[4] or "") + 256
                    if held > HELD:
                        yield _batch(rows)
                        rows, held = [], 0
            if rows:
                yield _batch(rows)

    needed = F.when(F.col("kind") == "none", F.col("content"))
    return _judged(files.select("path", "kind", needed.alias("content")).mapInArrow(run, _TAGGED))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _TAGGED_KINDS, strict=True)], names=[f.split(" ")[0] for f in _TAGGED.split(", ")])


def _judged(found: DataFrame) -> DataFrame:
    source = text.escape(F.when(F.col("repair"), text.repair_latin1(F.col("raw"))).otherwise(F.col("raw")))
    record = F.col("what").isin("export", "package")
    reason = (
        F.when(record & ~predicates.is_valid_hash(F.col("key")), "hash")
        .when((F.col("what") == "export") & ~predicates.is_valid_decode(F.col("raw")), "decode")
        .when(record & (text.utf16_length(F.col("source")) == 1), "short")
    )
    return found.withColumn("source", source).select("path", "what", "ord", "key", "source", reason.alias("reason"))


def accepted(told: DataFrame, kind: str) -> DataFrame:
    """Of tagged records the accepted ones of a kind: of an export the first of each key, of a package all."""
    kept = told.where((F.col("what") == kind) & F.col("reason").isNull()).select("path", "ord", "key", "source")
    if kind == "package":
        return kept
    firsts = kept.groupBy("path", "key").agg(F.min_by(F.struct("ord", "source"), "ord").alias("r"))
    return firsts.select("path", "r.ord", "key", "r.source")


def rejected(told: DataFrame) -> DataFrame:
    """``path, ord, reason, line`` of the records that were not accepted; ``line`` is what the report of skipped lines shows."""
    return told.where("reason is not null").select("path", "ord", "reason", F.concat("key", F.lit(","), F.when(F.col("reason") != "hash", F.col("source")).otherwise("")).alias("line"))


class Span:
    """Bytes of a file from ``start`` on, read as far as they are needed; what lies before :meth:`forget` goes."""

    STEP = 1 << 20

    def __init__(self, read_at, size: int, start: int, step: int = STEP):
        self.read_at, self.size, self.base, self.data, self.step = read_at, size, start, b"", step

    def need(self, end: int) -> None:
        end = min(end, self.size)
        have = self.base + len(self.data)
        if end > have:
            self.data += self.read_at(have, min(max(end, have + self.step), self.size) - have)

    def cut(self, start: int, end: int) -> bytes:
        self.need(end)
        return self.data[start - self.base : end - self.base]

    def find(self, what: bytes, start: int, before: int | None = None) -> int:
        """The first place at or after ``start`` and, if given, before ``before``; -1 where there is none. No more is read, nothing is kept on the way."""
        at, stop = start, self.size if before is None else min(before + len(what) - 1, self.size)
        while at < stop:
            inside = at >= self.base and at + len(what) <= self.base + len(self.data)
            part, base = (self.data, self.base) if inside else (self.read_at(at, min(self.step, stop - at)), at)
            i = part.find(what, at - base, stop - base)
            if i >= 0:
                return base + i
            if base + len(part) >= stop:
                return -1
            at = base + len(part) - len(what) + 1
        return -1

    def forget(self, before: int, unless: int = 4 << 20) -> None:
        if before - self.base > unless:
            self.data, self.base = self.data[before - self.base :], before


def export_candidates(span: Span, start: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """``(offset, next, from, to)`` of every place in ``[start, end)`` where an export record could begin, and where its text is."""
    for at in range(start, end, Span.STEP):
        stop = min(at + Span.STEP, end)
        for m in _ANY_HASH.finditer(span.cut(at, stop + 31)):
            i = at + m.start()
            if i >= stop or i + 37 > span.size:
                break
            (size,) = struct.unpack("<i", span.cut(i + 33, i + 37))
            if size > 0 and i + 36 + size <= span.size:
                yield i, max(i + 36 + size, i + 1), i + 37, i + 36 + size
        span.forget(stop)


_ANY_HASH = re.compile(rb"(?=[0-9A-Fa-f]{32})")


def package_candidates(span: Span, start: int, end: int, after: int | None = None) -> Iterator[tuple[int, int, int, int]]:
    """The same for package records. Of the starts that share a separator, those more than a record's tail behind the separator before
    are left out but for the first that is accepted: nothing before them can end later.

    ``after`` is the first separator at or behind ``end`` (-1: none), where it is known; else the file is read up to there.
    """

    def separator_from(at: int) -> int:
        if after is None:
            return span.find(PACKAGE_SEPARATOR, at)
        inside = span.find(PACKAGE_SEPARATOR, at, end) if at < end else -1
        return inside if inside >= 0 else after  # a start mark on the border leaves no room for a separator there

    separator = judged = early = -1
    tail, taken, valid = start + 36, False, False
    i = start - 1
    while (i := span.find(PACKAGE_START, i + 1, end)) >= 0:
        if separator < i + 2:
            before, separator, taken = separator, separator_from(i + 2), False
            if separator < 0:
                return
            if early < 0:  # the last one that a record of an earlier range can end at
                early = separator_from(start + 1)
            tail = max([start, before, *([early] if early < separator else [])]) + 36
        if not taken and separator > i + 2:
            if separator != judged:
                judged, valid = separator, _digest(span.read_at(separator + 2, min(32, span.size - separator - 2)))
            span.forget(i, 0)
            found = next(package_records(span.cut(i, separator + 34)), None) if valid else None
            if found is not None and found[0] == 0:
                yield i, separator + 36, i, separator + 34
                taken = i >= tail


def _digest(raw: bytes) -> bool:
    digest = raw.strip()
    return bool(_HASH.fullmatch(digest)) and _valid(digest)


def opened_file(path: str):
    """A file for reading at any place, by a path of any file system that pyarrow opens."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(re.sub(r"\Afile:/(?!/)", "file:///", path))
    return store.open_input_file(name)


def with_heads(files: DataFrame) -> DataFrame:
    """``files(path, length)`` with their first bytes as ``content``, for the classifier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = []
            for path in batch.column(0).to_pylist():
                with opened_file(path) as f:
                    heads.append(f.read_at(HEADER_BYTES, 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.binary())], names=["path", "length", "content"])

    return files.select("path", "length").mapInArrow(run, "path string, length long, content binary")


def with_digests(files: DataFrame) -> DataFrame:
    """``files(path, length)`` with their ``sha256``; a file is read as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                digest = hashlib.sha256()
                with opened_file(path) as f:
                    while data := f.read(Span.STEP):
                        digest.update(data)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=["path", "length", "sha256"])

    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path", "length").repartition(tasks, "path").mapInArrow(run, "path string, length long, sha256 string")


def tagged_ranges(files: DataFrame, split_bytes: int = 128 << 20, kinds: tuple[str, ...] = ("export", "package")) -> DataFrame:
    """As :func:`tagged`, of ``files(path, length)`` of any size: the records of the whole-file scan, whatever ``split_bytes`` is.

    Byte ranges are scanned by tasks of their own for every place where a record could begin, reading beyond the range as
    far as one needs. Each range first tells its first separator of packages, so that none looks for the next one through the
    ranges behind it. Which of the places a scan from the start of the file would take is found by one pass over their
    offsets, in order: the next one taken is the first behind the end of the last. Then the texts of these are read. Files are
    opened by path, on any file system that pyarrow opens. Ranges and places are small rows behind which there are many
    bytes, so they are dealt to ``spark.sql.shuffle.partitions`` tasks whatever their own size is.
    """
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    ranges = files.select("path", "length", F.explode(starts).alias("start")).select("path", "length", "start", F.least(F.col("start") + split_bytes, "length").alias("end"))
    schema = "path string, what string, offset long, next long, low long, high long"
    kept = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kept, strict=True)], names=names)

    def span_of(f, length: int, start: int, end: int) -> Span:
        return Span(lambda at, n: f.read_at(n, at), length, start, min(Span.STEP, max(end - start, 4096)))

    def separators(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts = []
            for path, length, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with opened_file(path) as f:
                    firsts.append(span_of(f, length, start, end).find(PACKAGE_SEPARATOR, start, end))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(firsts, pa.int64())], names=["path", "length", "start", "end", "first"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, start, end, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with opened_file(path) as f:
                    for what in kinds:
                        rows, span = [], span_of(f, length, start, end)
                        for found in export_candidates(span, start, end) if what == "export" else package_candidates(span, start, end, after):
                            rows.append((path, what, *found))
                            if len(rows) >= 10_000:
                                yield batch_of(rows)
                                rows = []
                        if rows:
                            yield batch_of(rows)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        for batch in batches:
            keep = []
            for k, (path, what, offset, following) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                if (path, what) != now:
                    now, at = (path, what), 0
                if offset >= at:
                    keep.append(k)
                    at = following
            yield batch.take(pa.array(keep, pa.int64()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, f = None, None
        for batch in batches:
            rows, held = [], 0
            for path, what, offset, _, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != opened:
                    if f is not None:
                        f.close()
                    opened, f = path, opened_file(path)
                raw = f.read_at(high - low, low)
                if what == "export":
                    rows.append((path, what, offset, f.read_at(32, offset).decode(), raw.decode("utf-8", "replace"), False))
                else:
                    _, key, own, repair = next(package_records(raw))
                    rows.append((path, what, offset, key, own, repair))
                held += len(raw) + 256
                if held > HELD:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)
        if f is not None:
            f.close()

    if "package" in kinds:
        told = ranges.repartition(tasks, "path", "start").mapInArrow(separators, "path string, length long, start long, end long, first long")
        behind = Window.partitionBy("path").orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, -1)
        ranges = told.withColumn("after", F.coalesce(F.min(F.when(F.col("first") >= 0, F.col("first"))).over(behind), F.lit(-1).cast("long"))).drop("first")
    else:
        ranges = ranges.withColumn("after", F.lit(-1).cast("long"))
    places = ranges.repartition(tasks, "path", "start").mapInArrow(look, schema)
    chain = places.repartition("path", "what").sortWithinPartitions("path", "what", "offset").mapInArrow(follow, schema)
    dealt = chain.repartition(tasks, "path", F.floor(F.col("offset") / split_bytes)).sortWithinPartitions("path", "offset")
    return _judged(dealt.mapInArrow(read, _TAGGED))
