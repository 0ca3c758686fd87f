"""String tables as a Spark data source: ``spark.read.format("locres")`` and a committed sink of whole files.

The reader has a partition a file and reads it as a stream, so a table of any size takes little memory: of its strings only
their places are kept. Conditions on ``path`` choose files before any is opened, conditions on ``ns`` choose
namespaces; where the schema that is asked for has no ``value``, the string section is not read. A damaged file gives a row with
``error``, behind the entries of whole batches before the damage.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from lokalith.sources.locres import ENCRYPTED, ENTRY, HELD, header_of
from lokalith.workspace import tidy

SCHEMA = f"path string, {ENTRY}, ord long, error string"
_KINDS = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
_ROWS = 10_000
#: Ending of parts that lie compressed until they are joined.
PACKED = ".zst"


def opened(uri: str):
    """File system and path of a URI, also of one with a single slash."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"\Afile:/(?!/)", "file:///", uri))


class Stream:
    """Numbers and strings of a file in order, through a buffer; ``total`` counts the bytes that were read from the file."""

    STEP = 1 << 20

    def __init__(self, read_at, size: int, at: int = 0, step: int = STEP):
        self.read_at, self.size, self.at, self.step = read_at, size, at, step
        self.base, self.data, self.total = at, b"", 0

    def take(self, n: int) -> bytes:
        low = self.at - self.base
        if low < 0 or low + n > len(self.data):
            self.base, low = self.at, 0
            self.data = self.read_at(self.at, min(max(n, self.step), max(self.size - self.at, 0)))
            self.total += len(self.data)
        self.at += n
        return self.data[low : low + n]

    def number(self, form: str) -> int:
        return struct.unpack("<" + form, self.take(struct.calcsize("<" + form)))[0]

    def string(self) -> str:
        n = self.number("i")
        raw = self.take(abs(n) * (1 if n >= 0 else 2))
        return raw.decode("latin-1" if n >= 0 else "utf-16-le", "replace")[:-1] if n else ""

    def skip_string(self) -> None:
        n = self.number("i")
        self.at += abs(n) * (1 if n >= 0 else 2)


def entries_of(read_at, size: int, namespaces: set[str] | None = None, with_values: bool = True, streams: list | None = None) -> Iterator[tuple]:
    """``(ns, ns_hash, key, key_hash, source_crc, str_idx, value, ord)`` of one table, as :func:`locres.decode` has them; value None without values."""
    keys = Stream(read_at, size)
    head = header_of(keys.take(min(64, size)), size)
    hashed, places, values = head["version"] == ENCRYPTED, array("q"), None
    if with_values:
        walk = Stream(read_at, size, head["offset"])
        for _ in range(walk.number("I")):
            places.append(walk.at)
            walk.skip_string()
            if hashed:
                walk.number("i")
        values = Stream(read_at, size, head["offset"])
    if streams is not None:
        streams += [keys, *([walk, values] if with_values else [])]
    keys.at, ord_ = head["keys_at"], 0
    for _ in range(keys.number("I")):
        ns_hash = keys.number("I") if hashed else 0
        ns = keys.string()
        wanted = namespaces is None or ns in namespaces
        for _ in range(keys.number("I")):
            key_hash = keys.number("I") if hashed else 0
            key = keys.string()
            crc, at = keys.number("I"), keys.number("i")
            if wanted:
                value = None
                if values is not None:
                    value = ""
                    if 0 <= at < len(places):
                        values.at = places[at]
                        value = values.string()
                yield ns, ns_hash, key, key_hash, crc, at, value, ord_
            ord_ += 1


def inspect_stream(read_at, size: int) -> dict:
    """As :func:`locres.inspect`, of a file that is read as a stream; of each string one byte is kept, whether it is filled."""
    keys = Stream(read_at, size)
    head = header_of(keys.take(min(64, size)), size)
    hashed, full = head["version"] == ENCRYPTED, bytearray()
    walk = Stream(read_at, size, head["offset"])
    for _ in range(walk.number("I")):
        n = walk.number("i")
        walk.at += abs(n) * (1 if n >= 0 else 2)
        full.append(abs(n) > 1)
        if hashed:
            walk.number("i")
    keys.at, names, count, filled = head["keys_at"], set(), 0, 0
    for _ in range(keys.number("I")):
        if hashed:
            keys.number("I")
        ns = keys.string()
        for _ in range(keys.number("I")):
            if hashed:
                keys.number("I")
            keys.skip_string()
            keys.number("I")
            at = keys.number("i")
            names.add(ns)
            count += 1
            filled += 0 <= at < len(full) and full[at]
    return head | {"namespaces": len(names), "keys": count, "filled": filled, "consistent": keys.at == head["offset"] and walk.at == size}


class LocresReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.names = options["path"], schema.names
        self.path_tests: list[tuple[str, object]] = []
        self.namespaces: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 - the interface's name
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("path",) and isinstance(f, (EqualTo, In, StringStartsWith, StringContains)):
                self.path_tests.append((type(f).__name__, tuple(f.value) if isinstance(f.value, (list, tuple)) else f.value))
            elif column == ("ns",) and isinstance(f, (EqualTo, In)):
                given = set(f.value) if isinstance(f, In) else {f.value}
                self.namespaces = given if self.namespaces is None else self.namespaces & given
            elif not (column == ("path",) and isinstance(f, IsNotNull)):  # no path is null
                yield f

    def _wanted(self, path: str) -> bool:
        tests = {"EqualTo": lambda v: path == v, "In": lambda v: path in v, "StringStartsWith": path.startswith, "StringContains": lambda v: v in path}
        return all(tests[kind](value) for kind, value in self.path_tests)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, top = opened(self.path)
        prefix = f"{self.path.split(':', 1)[0]}:" if re.match(r"\A\w+:", self.path) else "file:"
        info = store.get_file_info(top)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(top, recursive=True))
        named = [(f"{prefix}{f.path}", f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".locres")]
        return [InputPartition(x) for x in sorted(named) if self._wanted(x[0])] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        path, size = partition.value
        store, name = opened(path)
        fields = dict(f.strip().split(" ") for f in SCHEMA.split(", "))
        order = ["ns", "ns_hash", "key", "key_hash", "source_crc", "str_idx", "value", "ord"]

        def batch(rows: list[tuple], error: str | None = None) -> pa.RecordBatch:
            columns = {n: [r[k] for r in rows] for k, n in enumerate(order)} | {"path": [path] * len(rows), "error": [error] * len(rows)}
            return pa.RecordBatch.from_arrays([pa.array(columns[n], _KINDS.get(fields[n], pa.int64())) for n in self.names], names=list(self.names))

        with store.open_input_file(name) as f:
            rows: list[tuple] = []
            held = 0
            try:
                for row in entries_of(lambda at, n: f.read_at(n, at), size, self.namespaces, "value" in self.names):
                    rows.append(row)
                    held += len(row[6] or "")
                    if len(rows) >= _ROWS or held > HELD:
                        yield batch(rows)
                        rows, held = [], 0
            except (ValueError, struct.error, IndexError) as e:
                rows = []  # what came before the damage may have gone out already
                yield batch([(None,) * len(order)], str(e))
            if rows:
                yield batch(rows)


class Committed(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class LocresWriter(DataSourceArrowWriter):
    """Files of ``name`` with ``content``, or with the bytes of ``parts`` in order; visible together when the job is committed.

    Tasks write below a hidden folder. The commit renames the files and leaves ``_manifest.json`` with names and sizes; an
    abort removes the folder. Parts are copied through a small buffer.
    """

    COPY = 8 << 20

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex

    def _staging(self, folder: str) -> str:
        return f"{folder}/.staging-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Committed:
        store, folder = opened(self.path)
        store.create_dir(self._staging(folder), recursive=True)
        done = []
        for batch in iterator:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]  # of the contents one is held at a time
                draft = f"{self._staging(folder)}/{uuid.uuid4().hex}"  # a task that runs again writes another
                with store.open_output_stream(draft, compression=None) as out:
                    if row.get("content") is not None:
                        out.write(row["content"])
                    for part in row.get("parts") or []:
                        self._copy(part, out)
                done.append((row["name"], draft))
        return Committed(done)

    def _copy(self, part: str, out) -> None:
        uri, _, span = part.partition("#")  # a part may be the first bytes of a file: path#length
        store, name = opened(uri)
        with store.open_input_stream(name, compression="zstd" if name.endswith(PACKED) else None) as f:
            left = int(span) if span else None
            while data := f.read(self.COPY if left is None else min(self.COPY, left)):
                out.write(data)
                left = None if left is None else left - len(data)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = opened(self.path)
        files = dict(x for m in messages if m is not None for x in m.files)
        store.create_dir(folder, recursive=True)
        if self.overwrite:
            from pyarrow import fs

            for f in store.get_file_info(fs.FileSelector(folder)):
                if f.type == fs.FileType.File and not f.base_name.startswith(".") and f.base_name not in files:
                    store.delete_file(f.path)
        sizes = {}
        for name, draft in sorted(files.items()):
            sizes[name] = store.get_file_info(draft).size
            store.move(draft, f"{folder}/{name}")
        with store.open_output_stream(f"{folder}/_manifest.json", compression=None) as out:
            out.write(json.dumps({"run": self.run, "files": sizes}).encode())
        self._clear(store, folder)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, store, folder: str) -> None:
        from pyarrow import fs

        if store.get_file_info(self._staging(folder)).type != fs.FileType.NotFound:
            store.delete_dir(self._staging(folder))


class LocresSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "locres"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> LocresReader:
        return LocresReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> LocresWriter:
        return LocresWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LocresSource)


def load(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Entries of all string tables below ``path``; of the given columns only, if any are."""
    register(spark)
    wanted = ", ".join(f.strip() for f in SCHEMA.split(", ") if not columns or f.strip().split(" ")[0] in columns)
    return spark.read.format("locres").schema(wanted).load(path)


def save(files: DataFrame, target: str, overwrite: bool = False) -> dict[str, int]:
    """Writes ``files(name, content)`` or ``files(name, parts)`` below ``target``, all or none; returns sizes by name. ``overwrite`` removes other files there."""
    register(files.sparkSession)
    columns = [F.col("name")] + [F.col(c) for c in ("content", "parts") if c in files.columns]
    with tidy(files.sparkSession):
        files.select(*columns).write.format("locres").mode("overwrite" if overwrite else "append").save(target)
    store, folder = opened(target)
    with store.open_input_stream(f"{folder}/_manifest.json", compression=None) as f:
        return json.loads(f.read())["files"]
