"""The journal of paid answers: a folder of committed segments that a crash cannot lose.

Every accepted batch is one segment, compressed, written under a name of its own and renamed by the task that asked, before the task goes
on. A segment's name is the digest of its batch, so a task that runs again finds what it paid for. Refused batches leave a
note of the run, so that a repeated task of this run does not ask again and a later run does.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lokalith.workspace import any_matches, listed, remove

PAIR = "at long, source string, translation string"


class Segments:
    """Task side of a journal folder, on any file system that pyarrow opens."""

    def __init__(self, path: str, run: str):
        from pyarrow import fs

        self.store, self.folder = fs.FileSystem.from_uri(path)
        self.run, self.files = run, fs
        self.store.create_dir(self.folder, recursive=True)

    @staticmethod
    def name_of(*parts: object) -> str:
        return hashlib.sha256(json.dumps(parts, default=str).encode()).hexdigest()

    def _read(self, name: str) -> str | None:
        if self.store.get_file_info(f"{self.folder}/{name}").type == self.files.FileType.NotFound:
            return None
        with self.store.open_input_stream(f"{self.folder}/{name}", compression=None) as f:
            body = f.read()
        return (gzip.decompress(body) if name.endswith(".gz") else body).decode()

    def _write(self, name: str, body: str) -> None:
        draft = f"{self.folder}/.draft-{uuid.uuid4().hex}"
        with self.store.open_output_stream(draft, compression=None) as out:
            out.write(gzip.compress(body.encode(), 4, mtime=0) if name.endswith(".gz") else body.encode())
        self.store.move(draft, f"{self.folder}/{name}")

    def known(self, name: str) -> tuple[list[str] | None, str | None] | None:
        """Translations of a committed segment or the note on a refused one of this run; None where there is neither."""
        body = self._read(f"seg-{name}.json.gz")
        if body is None:
            body = self._read(f"seg-{name}.json")  # of a journal of before
        if body is not None:
            return [json.loads(line)["translation"] for line in body.splitlines()], None
        note = self._read(f".refused-{self.run}/{name}")
        return None if note is None else (None, note)

    def commit(self, name: str, pairs: Iterable[tuple[str, str]]) -> None:
        at = time.time_ns()
        self._write(f"seg-{name}.json.gz", "".join(json.dumps({"at": at, "source": s, "translation": t}) + "\n" for s, t in pairs))

    def refuse(self, name: str, why: str) -> None:
        self.store.create_dir(f"{self.folder}/.refused-{self.run}", recursive=True)
        self._write(f".refused-{self.run}/{name}", why)


def append(rows: DataFrame, path: str) -> None:
    """Adds ``source, translation`` of a table as one part of the journal."""
    at = F.lit(time.time_ns())
    told = rows.select(at.alias("at"), *[F.coalesce(F.col(x), F.lit("")).alias(x) for x in ("source", "translation")])
    told.write.option("compression", "gzip").json(f"{path.rstrip('/')}/base-{uuid.uuid4().hex}")


def _parts(spark: SparkSession, path: str) -> list[str]:
    path = path.rstrip("/")
    return [f"{path}/{glob}" for glob in ("seg-*.json", "seg-*.json.gz", "base-*/part-*") if any_matches(spark, f"{path}/{glob}")]


def read(spark: SparkSession, path: str) -> DataFrame:
    """``source, translation`` of all parts; of a source the last answer wins (of one moment, the greatest). None yet: no rows."""
    parts = _parts(spark, path)
    if not parts:
        return spark.createDataFrame([], "source string, translation string")
    lines = spark.read.schema(PAIR).option("encoding", "UTF-8").json(parts)
    last = lines.where("source is not null").groupBy("source").agg(F.max(F.struct("at", "translation")).alias("r"))  # one copy of each translation is shuffled
    return last.select("source", "r.translation")


def compact(spark: SparkSession, path: str) -> None:
    """All parts as one; what was read is removed once the new part is complete. A crash between leaves pairs twice, which changes nothing."""
    path = path.rstrip("/")
    old = [p for glob in ("seg-*.json", "seg-*.json.gz", "base-*") for p in listed(spark, f"{path}/{glob}")]
    if not old:
        return
    lines = spark.read.schema(PAIR).option("encoding", "UTF-8").json(_parts(spark, path)).where("source is not null")
    last = lines.groupBy("source").agg(F.max(F.struct("at", "translation")).alias("r")).select("r.at", "source", "r.translation")
    last.write.option("compression", "gzip").json(f"{path}/base-{uuid.uuid4().hex}")
    for p in old:
        remove(spark, p)


def clear_notes(spark: SparkSession, path: str, run: str) -> None:
    remove(spark, f"{path.rstrip('/')}/.refused-{run}")
