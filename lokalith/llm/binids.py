"""Token-id files as directly addressable codes: any token is read without decoding a block.

An id is split into 8-bit chunks, lowest first. Level 0 holds the first chunk of every id; a continuation bitmap
says which ids go on, and level 1 holds the next chunk of those only, and so forth. A rank directory (ones before
every 512 bits) gives an id's place in the next level in constant time.

File layout, little endian: ``LKDA``, u16 version 2, u16 levels, u64 documents, u64 tokens, u64 documents without an
id (they come first, and hold 0 as id); document ids i64 each;
document starts u64 each plus the end; then for each level u64 chunks, the chunks, padding to 8 bytes, the bitmap
in u64 words, the directory u64 each. The last level has an empty bitmap all the same.

Files hold ascending ranges of document ids and are numbered in that order.
"""

from __future__ import annotations

import mmap
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lokalith.llm.shared import fresh_path, materialise, text_of
from lokalith.llm.tokens import encoder

MAGIC, VERSION, RANK_BITS = b"LKDA", 2, 512
_HEAD = struct.Struct("<4sHHQQQ")
#: Bytes of text that one file takes, about.
FILE_BYTES = 16 << 20
#: Documents that are encoded together; tokens, about, that are decoded together.
ENCODE_ROWS, DECODE_TOKENS = 512, 1 << 18


def encode_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One file for documents in order, those without an id first; ``ids`` are all their ids, concatenated."""
    left, levels = np.asarray(ids, dtype=np.uint32), []
    while True:
        more = left > 0xFF
        words = np.zeros(-(-len(left) // 64) * 8, dtype=np.uint8)
        packed = np.packbits(more, bitorder="little")
        words[: len(packed)] = packed
        ones = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.int64))[:-1]]) if len(more) else np.zeros(0)
        chunks = (left & 0xFF).astype(np.uint8).tobytes()
        levels.append(struct.pack("<Q", len(left)) + chunks + b"\0" * (-len(chunks) % 8) + words.tobytes() + ones.astype("<u8").tobytes())
        left = left[more] >> 8
        if not len(left):
            break
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    nulls = sum(d is None for d in doc_ids)
    named = np.array([0] * nulls + list(doc_ids[nulls:]), dtype="<i8")
    return _HEAD.pack(MAGIC, VERSION, len(levels), len(doc_ids), int(starts[-1]), nulls) + named.tobytes() + starts.tobytes() + b"".join(levels)


class IdFile:
    """Reads what :func:`encode_file` wrote: ``get(k)`` for one token, ``slice(a, b)`` and ``document(d)`` for neighbours.

    ``data`` is any buffer. Nothing is copied or decoded on opening, so over a memory map (:meth:`mapped`) a token costs a
    few pages of the file, however large it is.
    """

    @classmethod
    def mapped(cls, path: str) -> IdFile:
        """Over a memory map of a local file."""
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def __init__(self, data):
        magic, version, levels, docs, self.tokens, self.nulls = _HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token-id file")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.starts = np.frombuffer(data, "<u8", docs + 1, at + 8 * docs).astype(np.int64)
        at += 8 * docs + 8 * (docs + 1)
        self.levels = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", data, at)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n + -n % 8
            bits = np.frombuffer(data, np.uint8, -(-n // 64) * 8, at)
            at += len(bits)
            ones = np.frombuffer(data, "<u8", -(-n // RANK_BITS), at)
            at += 8 * len(ones)
            self.levels.append((chunks, bits, ones))

    def _rank(self, level: int, k: int) -> int:
        """Ids before ``k`` of the level that go on."""
        _, bits, ones = self.levels[level]
        block = min(k // RANK_BITS, len(ones) - 1)
        part = np.unpackbits(bits[block * RANK_BITS // 8 : (k + 7) >> 3], bitorder="little")[: k - block * RANK_BITS]
        return int(ones[block]) + int(part.sum())

    def get(self, k: int) -> int:
        value, shift = 0, 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[k]) << shift
            if not bits[k >> 3] >> (k & 7) & 1:
                break
            k, shift = self._rank(level, k), shift + 8
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids ``a`` to ``b``: of each level the neighbours that belong to them, found by rank."""
        values, place = np.zeros(b - a, dtype=np.uint32), np.arange(b - a)
        for level, (chunks, bits, _) in enumerate(self.levels):
            if a == b:
                break
            values[place] |= chunks[a:b].astype(np.uint32) << np.uint32(8 * level)
            more = np.unpackbits(bits[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 :][: b - a].astype(bool)
            place = place[more]
            a = self._rank(level, a)
            b = a + len(place)
        return values

    def all(self) -> np.ndarray:
        return self.slice(0, self.tokens)

    def document(self, d: int) -> np.ndarray:
        return self.slice(int(self.starts[d]), int(self.starts[d + 1]))


def write_ids(df: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """Write ``df`` as files ``part-<n>.lkda`` below ``path`` (any file system pyarrow opens), ascending by id.

    Returns one row per file: ``file, documents, tokens``. A task writes under a name of its own and renames, so
    a repeated or speculative task leaves the same file. Null texts are empty, null ids come first, repeated rows as
    often as they come, in the order of their texts' hashes. An empty table writes no file.
    """
    text = text_of(text_col)
    total = df.agg(F.sum(F.octet_length(text))).head()[0] or 0
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    files = int(1 + total // FILE_BYTES)
    ordered = rows.repartitionByRange(files, "doc_id", "h").sortWithinPartitions("doc_id", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        enc, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        doc_ids, lengths, parts = [], [], []
        for batch in (rows.slice(k, ENCODE_ROWS) for rows in batches for k in range(0, rows.num_rows, ENCODE_ROWS)):
            doc_ids += batch.column(0).to_pylist()
            for data in enc.encode_many(batch.column(1).to_pylist()):
                parts.append(data + end)
                lengths.append(len(parts[-1]) // 4)
        if not doc_ids:
            return
        number = TaskContext.get().partitionId()
        joined = np.frombuffer(b"".join(parts), dtype="<u4")
        parts.clear()
        data = encode_file(doc_ids, np.array(lengths), joined)
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        draft, final = f"{folder}/.draft-{uuid.uuid4().hex}", f"{folder}/part-{number:08d}.lkda"
        with store.open_output_stream(draft) as out:
            out.write(data)
        store.move(draft, final)
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(doc_ids)]), pa.array([sum(lengths)])], names=["file", "documents", "tokens"])

    return ordered.select("doc_id", "text").mapInArrow(run, "file long, documents long, tokens long")


def read_ids(spark, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document of the files below ``path``: ``doc_id, file, start_in_file, n_tokens, ids_crc32`` (and ``ids``)."""
    names = ["doc_id", "file", "start_in_file", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                source = IdFile(content.as_buffer())
                number, docs, at = int(name.rsplit("part-", 1)[1].split(".")[0]), len(source.doc_ids), 0
                while at < docs:  # whole documents, about DECODE_TOKENS at once
                    until = max(at + 1, int(np.searchsorted(source.starts, source.starts[at] + DECODE_TOKENS, side="right")) - 1)
                    starts = source.starts[at : until + 1]
                    data = source.slice(int(starts[0]), int(starts[-1])).astype("<u4").tobytes()
                    cut = [data[4 * a : 4 * b] for a, b in zip(starts - starts[0], starts[1:] - starts[0], strict=False)]
                    named = pa.array(source.doc_ids[at:until], mask=np.arange(at, until) < source.nulls)
                    columns = [named, pa.array(np.full(len(cut), number)), pa.array(starts[:-1]), pa.array(np.diff(starts)), pa.array([zlib.crc32(x) for x in cut], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*columns, *([pa.array(cut, pa.binary())] if with_ids else [])], names=names)
                    at = until

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.lkda").load(path).select("path", "content")
    return files.mapInArrow(run, "doc_id long, file long, start_in_file long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def with_global_start(spark, manifest: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all documents before. The manifest has one short row per file."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    shift = manifest.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("shift"))
    return docs.join(shift, "file").withColumn("start", F.col("shift") + F.col("start_in_file"))


def round_trip(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder and read every document back: ``doc_id, start, n_tokens, ids_crc32`` (and ``ids``).

    Where ``df`` is empty so is the result.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "ids")
    manifest = materialise(write_ids(df, path, tokenizer, id_col, text_col, end_id), "manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))
    out = with_global_start(spark, manifest, read_ids(spark, path, with_ids))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
