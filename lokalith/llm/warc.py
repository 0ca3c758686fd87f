"""WARC archives: writer with revisit records, and a reader that salvages what damage leaves.

Writer: one gzip member per record, files named by task in the given folder. Of equal payloads of at least
``REVISIT_BYTES`` the one with the smallest id is a response; the others are revisit records that name it.

Reader: a member is checked (gzip CRC, version line, header, length, block and payload digests). After a failed check it
searches for the next member, or in plain archives the next version line, that parses; everything between is
logged as a quarantined byte gap, and later records are read as usual.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lokalith.llm.shared import fresh_path, lookup, materialise, text_of

REVISIT_BYTES = 100
#: Bytes of a file after which a task starts another one.
FILE_BYTES = 128 << 20
_VERSION = re.compile(rb"WARC/\d\.\d\r\n")
_ONCE = {b"warc-type", b"warc-record-id", b"warc-date", b"content-length"}
_MEMBER = b"\x1f\x8b\x08"
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _line(value: object) -> bytes:
    return str(value).encode("utf-8", "surrogatepass").replace(b"\r", b"%0D").replace(b"\n", b"%0A")


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object = None) -> bytes:
    """One uncompressed record; a revisit where ``refers_to`` is given."""
    block = _HTTP % len(payload)
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: <urn:page:%s>" % _line("" if page_id is None else page_id)]
    head += [b"WARC-Date: 1970-01-01T00:00:00Z", b"WARC-Target-URI: " + _line(url)] if url is not None else [b"WARC-Date: 1970-01-01T00:00:00Z"]
    head.append(b"WARC-Payload-Digest: sha256:" + digest.encode())
    if refers_to is None:
        block += payload
    else:
        head += [b"WARC-Refers-To: <urn:page:%s>" % _line(refers_to), b"WARC-Profile: " + _PROFILE]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    head.append(b"WARC-Block-Digest: sha256:" + hashlib.sha256(block).hexdigest().encode())
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` below ``path`` (any file system pyarrow opens); returns ``file, records`` per file, lazily.

    Null html is an empty payload; a null id is never the one that others revisit while there is another. Rows that
    repeat the smallest id of a payload are responses each. An empty table writes no file. Pages of frequent
    payloads spread over all tasks (:func:`lokalith.llm.shared.lookup`). A task writes under names of its own and renames, so a repeated task leaves the same files.
    """
    html = text_of(html_col)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    firsts = materialise(rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")), "payloads")
    found = lookup(rows, firsts, "digest", "first", "n", "page_id", "url")
    revisits = (F.octet_length("html") >= REVISIT_BYTES) & ~F.col("page_id").eqNullSafe(F.col("first"))
    planned = found.select("page_id", "url", "html", "digest", F.when(revisits, F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        number, made, n, out, draft = TaskContext.get().partitionId(), 0, 0, None, ""
        for batch in batches:
            for page_id, url, text, digest, refers_to in zip(*batch.columns, strict=True):
                if out is None:
                    draft = f"{folder}/.draft-{uuid.uuid4().hex}"
                    out = store.open_output_stream(draft, compression=None)
                member = zlib.compressobj(3, zlib.DEFLATED, 31)
                raw = record(page_id.as_py(), url.as_py(), text.as_py().encode(), digest.as_py(), refers_to.as_py())
                out.write(member.compress(raw) + member.flush())
                n += 1
                if out.tell() >= FILE_BYTES:
                    out.close()
                    store.move(draft, f"{folder}/part-{number:08d}-{made:04d}.warc.gz")
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([n])], names=["file", "records"])
                    made, n, out = made + 1, 0, None
        if out is not None:
            out.close()
            store.move(draft, f"{folder}/part-{number:08d}-{made:04d}.warc.gz")
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([n])], names=["file", "records"])

    return planned.mapInArrow(run, "file long, records long")


def parse(data: bytes, at: int = 0, limit: int | None = None) -> tuple[dict | None, int, str]:
    """The record at ``at``: ``(record, end, "")``, or ``(None, at, reason)``."""
    if not (m := _VERSION.match(data, at)):
        return None, at, "version line"
    end = data.find(b"\r\n\r\n", m.end())
    if end < 0:
        return None, at, "header"
    header = {}
    for line in data[m.end() : end].split(b"\r\n"):
        key, colon, value = line.partition(b":")
        key = key.strip().lower()
        if not colon or key in _ONCE and key in header:  # a field twice: a cut header runs into the next record's
            return None, at, "header"
        header[key] = value.strip()
    if not (size := header.get(b"content-length", b"")).isdigit():
        return None, at, "length"
    start, stop = end + 4, end + 4 + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        return None, at, "length"
    told = header.get(b"warc-block-digest", b"")
    if told.startswith(b"sha256:") and told[7:].decode("latin-1") != hashlib.sha256(data[start:stop]).hexdigest():
        return None, at, "digest"
    block, kind = data[start:stop], header.get(b"warc-type", b"").decode("latin-1")
    payload = block.partition(b"\r\n\r\n")[2] if b"application/http" in header.get(b"content-type", b"") else block
    digest = header.get(b"warc-payload-digest", b"").decode("latin-1")
    if kind == "response" and digest.startswith("sha256:") and digest[7:] != hashlib.sha256(payload).hexdigest():
        return None, at, "digest"
    text = {k: header.get(k, b"").decode("utf-8", "replace") for k in (b"warc-record-id", b"warc-refers-to", b"warc-target-uri")}
    return {
        "kind": kind, "record_id": text[b"warc-record-id"], "refers_to": text[b"warc-refers-to"] or None, "url": text[b"warc-target-uri"] or None,
        "payload": payload if kind != "revisit" else None, "digest": digest.removeprefix("sha256:") or None,
    }, stop + 4, ""


def _member(data: bytes, at: int) -> tuple[bytes | None, int, str]:
    unzip = zlib.decompressobj(31)
    try:
        out = unzip.decompress(data[at:] if at else data)
    except zlib.error:
        return None, at, "gzip"
    if not unzip.eof:
        return None, at, "gzip"
    return out, len(data) - len(unzip.unused_data), ""


def _records(data: bytes) -> Iterator[tuple[int, int, dict | None, str]]:
    """Records and gaps of uncompressed bytes: ``(offset, length, record or None, reason)``."""
    at, gap, why = 0, None, ""
    while 0 <= at < len(data):
        found, end, reason = parse(data, at)
        if found is None:
            if gap is None:
                gap, why = at, reason
            m = _VERSION.search(data, at + 1)
            at = m.start() if m else -1
            continue
        if gap is not None:
            yield gap, at - gap, None, why
            gap = None
        yield at, end - at, found, ""
        at = end
    if gap is not None:
        yield gap, len(data) - gap, None, why


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, str]]:
    """``(offset, length, record, "")`` for each record and ``(offset, length, None, reason)`` for each gap, in order.

    A gzip member may hold several records: the first carries the member's offset and length, the others its offset
    and length 0, and what does not parse inside it is a gap of length 0 whose reason names the bytes of the member.
    So the lengths add up to the file.
    """
    if not (data[:3] == _MEMBER or (not _VERSION.match(data) and (z := data.find(_MEMBER)) >= 0 and (z < (v.start() if (v := _VERSION.search(data)) else len(data))))):
        yield from _records(data)
        return
    at, gap, why = 0, None, ""
    view = memoryview(data)
    while 0 <= at < len(data):
        window = 1 << 16  # a member is tried on growing windows, so a file is not copied for each
        while True:
            inner, end, reason = _member(bytes(view[at : at + window]), 0)
            if inner is not None or at + window >= len(data):
                break
            window *= 8
        inside = list(_records(inner)) if inner is not None else []
        if not any(r for _, _, r, _ in inside):
            reason = inside[0][3] if inside else reason or "header"
            if gap is None:
                gap, why = at, reason
            at = data.find(_MEMBER, at + 1)
            continue
        if gap is not None:
            yield gap, at - gap, None, why
            gap = None
        size = end
        for k, n, found, reason in inside:
            yield at, size, found, reason and f"{reason}, bytes {k} to {k + n} of the member"
            size = 0
        at += end
    if gap is not None:
        yield gap, len(data) - gap, None, why


def read_warc(spark, path: str, with_payload: bool = True) -> DataFrame:
    """Records and gaps of all archives below ``path``.

    ``file, offset, length, kind`` (response, revisit, ... or ``gap``), ``reason`` (of a gap), ``record_id, url,
    refers_to, header_digest, payload_bytes, payload_digest`` (of the payload as read) and ``payload``. A file is
    read whole by one task; the writer starts a new file at FILE_BYTES. Empty files give no row; a payload that is empty
    has 0 bytes, that of a revisit is null.
    """
    names = [
        "file", "offset", "length", "kind", "reason", "record_id", "url", "refers_to", "header_digest", "payload_bytes", "payload_digest",
        *(["payload"] if with_payload else []),
    ]
    kinds = [
        pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(),
        *([pa.binary()] if with_payload else []),
    ]

    def rows(name: str, data: bytes) -> Iterator[list]:
        for at, size, r, why in salvage(data):
            if r is None:
                yield [name, at, size, "gap", why, *[None] * (len(names) - 5)]
            else:
                body = r["payload"]
                told = [None, None] if body is None else [len(body), hashlib.sha256(body).hexdigest()]
                yield [name, at, size, r["kind"], None, r["record_id"], r["url"], r["refers_to"], r["digest"], *told, *([body] if with_payload else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held: list[list] = []
                for row in rows(name, content.as_py()):
                    held.append(row)
                    if len(held) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    schema = "file string, offset long, length long, kind string, reason string, record_id string, url string, refers_to string, header_digest string, payload_bytes long, payload_digest string"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path).select("path", "content")
    return files.mapInArrow(run, schema + (", payload binary" if with_payload else ""))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back, one row per page.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``; a revisit takes length and digest from the
    response it names. A byte gap in what was just written is an error. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()
    path = fresh_path(spark, "warc")
    if materialise(write_warc(pages, path, id_col, url_col, html_col), "warc-files").isEmpty():
        return spark.createDataFrame([], f"page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}")
    number = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(.*)>$", 1), F.lit("")).cast(kind)
    found = materialise(read_warc(spark, path, with_payload=False).drop("url"), "warc-records")
    if gaps := found.where("kind = 'gap'").count():
        raise RuntimeError(f"{gaps} byte gaps in the archives below {path}")
    read = found.drop("file", "offset", "length", "reason")
    told = read.select(number(F.col("record_id")).alias("page_id"), "kind", number(F.col("refers_to")).alias("refers_to"), "header_digest", "payload_bytes", "payload_digest")
    full = told.where("kind = 'response'").select(F.col("page_id").alias("r_id"), F.col("payload_digest").alias("r_digest"), F.col("payload_bytes").alias("r_bytes")).distinct()
    joined = told.join(full, (told["refers_to"] == full["r_id"]) & (told["header_digest"] == full["r_digest"]), "left")
    return joined.select(
        "page_id", F.coalesce("payload_bytes", "r_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "r_digest").alias("payload_digest"),
        F.col("kind").alias("record_type"), "refers_to",
    )
