"""Files that are put together from the bytes of many rows; no task holds a file."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lokalith.sources import locres_format
from lokalith.workspace import forget, fresh_path, remove, settled


def dump_pieces(rows: DataFrame, target: str, name: str, piece: str, *order: str) -> dict[str, int]:
    """Writes one file for each ``name`` below ``target``, its ``piece`` bytes in ``order``: sizes by name.

    Rows are range-sorted; every task streams its range to one part a name, compressed, and the parts are joined through a small buffer.
    Null pieces are empty.
    """
    spark = rows.sparkSession
    folder = fresh_path(spark, "pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = locres_format.opened(folder)
        store.create_dir(path, recursive=True)
        part, now, out = TaskContext.get().partitionId(), None, None
        try:
            for batch in batches:
                made = []
                for own, raw in zip(batch.column(0), batch.column(1), strict=True):
                    if out is None or own.as_py() != now:
                        if out is not None:
                            out.close()
                        now, unique = own.as_py(), uuid.uuid4().hex + locres_format.PACKED  # a task that runs again leaves the first one unused
                        out = store.open_output_stream(f"{path}/{unique}", compression="zstd")
                        made.append((now, part, f"{folder}/{unique}"))
                    out.write(raw.as_py() or b"")
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["name", "part", "at"])
        finally:
            if out is not None:
                out.close()

    try:
        wanted = rows.select(F.col(name).alias("name"), F.col(piece).alias("piece"), *[F.col(x).alias(f"_o{k}") for k, x in enumerate(order)])
        keys = ["name", *[f"_o{k}" for k in range(len(order))]]
        ranged = wanted.repartitionByRange(*keys).sortWithinPartitions(*keys).select("name", "piece")
        parts = settled(ranged.mapInArrow(run, "name string, part long, at string"), "parts")
        joined = parts.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "at"))), lambda p: p["at"]).alias("parts"))
        sizes = locres_format.save(joined, target)
        forget(parts)
        return sizes
    finally:
        remove(spark, folder)
