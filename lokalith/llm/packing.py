"""Best-fit-decreasing packing of tokenized documents, exact over the whole corpus.

Best fit decides by length only, and equal lengths are interchangeable. So the documents are tokenized once
into a table in the shared folder, and the driver packs the *histogram* of lengths: at most ``capacity``
numbers, whatever the corpus holds. It keeps the open sequences grouped by remaining room and finds the
tightest room that fits with a segment tree, in logarithmic time a step; all pieces of a length move through a
group at once. That is best-fit decreasing to the piece, and its plan is a short list of ranges: "pieces number
a..b of length n go to sequences from s on, k in each, from offset o". Pieces are numbered within their length
by window over (length, bucket) plus the counts of earlier buckets, where buckets split frequent lengths.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lokalith.llm.shared import materialise, text_of
from lokalith.llm.tokens import encoder

#: Pieces in a bucket of one length, about.
BUCKET_ROWS = 1024
#: Documents that are encoded together.
ENCODE_ROWS = 512


class RoomTree:
    """Segment tree over remaining rooms 0..capacity; a leaf is set while some open sequence has that room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)

    def set(self, room: int, value: bool) -> None:
        k = room + self.size
        self.any[k] = value
        while k > 1:
            k //= 2
            self.any[k] = self.any[2 * k] | self.any[2 * k + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least ``least`` that is set."""
        k = least + self.size
        if self.any[k]:
            return least
        while k > 1:
            if k % 2 == 0 and self.any[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.any[2 * k] else 2 * k + 1
                return k - self.size
            k //= 2
        return None


def best_fit_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing of ``{length: count}`` -> ranges ``(length, first, count, sequence, each, offset)``.

    Pieces ``first .. first + count - 1`` of that length fill sequences from ``sequence`` on with ``each`` pieces,
    the first at ``offset``.
    """
    tree, rooms, plan, opened = RoomTree(capacity), {}, [], 0

    def add(room: int, start: int, n: int) -> None:
        if n and room:
            rooms.setdefault(room, []).append((start, n))
            tree.set(room, True)

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} outside 1..{capacity}")
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, start, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            else:
                start, n = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    tree.set(room, False)
            each = room // length
            full = min(n, left // each)
            add(room - each * length, start, full)
            if full:
                plan.append((length, rank, full * each, start, each, capacity - room))
                rank, left = rank + full * each, left - full * each
            if left and full < n:
                plan.append((length, rank, left, start + full, left, capacity - room))
                add(room - left * length, start + full, 1)
                add(room, start + full + 1, n - full - 1)
                left = 0
            else:
                add(room, start + full, n - full)
    return plan


def token_pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """``doc_id, row_key, piece, start, length, ids_crc32`` (and ``ids``, little-endian uint32): a row per piece."""
    names = ["doc_id", "row_key", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for part in (batch.slice(k, ENCODE_ROWS) for batch in batches for k in range(0, batch.num_rows, ENCODE_ROWS)):
            source, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, data in enumerate(enc.encode_many(part.column(2).to_pylist())):
                data += end
                n = len(data) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    source.append(k)
                    piece.append(p)
                    start.append(a)
                    length.append(b - a)
                    own = data[4 * a : 4 * b]
                    crc.append(zlib.crc32(own))
                    if with_ids:
                        ids.append(own)
            keep = pa.array(source, type=pa.int32())
            columns = [part.column(0).take(keep), part.column(1).take(keep), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(ids, pa.binary())] if with_ids else [])], names=names)

    rows = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text_of(text_col)).alias("row_key"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, row_key long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``).

    A document is its ids and the end id; null and empty texts are the end id alone. Longer ones are cut so that
    only the first piece may be short. Sequences are filled without gaps from offset 0. Repeated rows are packed
    as often as they come, null ids like others; an empty table gives an empty result.
    """
    spark = df.sparkSession
    pieces = materialise(token_pieces(df, tokenizer, id_col, text_col, capacity, end_id, with_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    plan = best_fit_plan(histogram, capacity)
    ranges: dict[int, list] = {}
    for length, *rest in plan:
        ranges.setdefault(length, []).append(rest)

    buckets = 1 + sum(histogram.values()) // BUCKET_ROWS
    columns = ["doc_id", "row_key", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    spread = pieces.select(*columns).withColumn("bucket", F.pmod(F.xxhash64("row_key", "piece"), F.lit(buckets)))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = pieces.groupBy("length", F.pmod(F.xxhash64("row_key", "piece"), F.lit(buckets)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row_key", "piece"))
    ranked = spread.withColumn("within", within).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("within") - 1)

    shared = spark.sparkContext.broadcast({n: (np.array([r[0] for r in rs]), np.array(rs)) for n, rs in ranges.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = [], []
            for n, rank in zip(batch.column("length").to_pylist(), batch.column("rank").to_pylist(), strict=True):
                firsts, rows = shared.value[n]
                first, _, start, each, base = rows[bisect_right(firsts, rank) - 1]
                sequence.append(int(start + (rank - first) // each))
                offset.append(int(base + (rank - first) % each * n))
            kept = [batch.column(c) for c in out]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*out, "sequence_id", "offset"])

    out = [c for c in columns if c != "row_key"]
    schema = ", ".join(f"{c} {ranked.schema[c].dataType.simpleString()}" for c in out)
    return ranked.select(*out, "rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")
