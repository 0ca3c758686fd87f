"""A keyed table of hash buckets with versions: a change rewrites the buckets of its keys only, and becomes visible at once.

``manifest/v-<n>.json`` names the folders that make up version ``n``; the greatest is the current one. A version is
committed by renaming its manifest into place, which fails if another writer was faster. Folders of data are never
changed, so readers of an older version are not disturbed; :meth:`Store.vacuum` removes what is old enough.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lokalith.workspace import listed, read_text, remove, rename, write_text

Fold = Callable[[DataFrame, DataFrame], DataFrame]

#: Shuffle partitions of a fold that is written where it lies, at least.
FINE = 200


class Conflict(Exception):
    """Another writer has committed this version."""


class Store:
    """Rows of ``schema`` below ``path``, dealt to ``buckets`` by the hash of the columns ``key``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        now = self.current()
        self.buckets = now["buckets"] if now else buckets
        self.hash = now.get("hash", "xxhash64") if now else "hash"  # stores of before deal by the other one

    def bucket(self) -> Column:
        return F.pmod(getattr(F, self.hash)(*self.key), F.lit(self.buckets)).cast("int")

    def partitions(self) -> int:
        """A number of shuffle partitions that suits the buckets: rows that Spark deals to so many by the key lie with rows of their own bucket only.

        Spark deals by the remainder of the same hash, so a multiple of ``buckets`` does. At least FINE, as adaptive execution joins small ones.
        """
        return self.buckets * math.ceil(max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), FINE) / self.buckets)

    def current(self) -> dict | None:
        """The newest manifest; None where nothing was committed yet."""
        found = listed(self.spark, f"{self.path}/manifest/v-*.json")
        return json.loads(read_text(self.spark, found[-1])) if found else None

    def read(self, version: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Rows of a version (the current one by default), of these buckets only if given."""
        version = version or self.current()
        held = {} if version is None else version["data"]
        paths = [f"{self.path}/data/{held[str(b)]}" for b in (range(self.buckets) if buckets is None else buckets) if str(b) in held]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def commit(self, batch: DataFrame, fold: Fold, stream: str = "", number: int | None = None, dealt: bool = False) -> dict:
        """Version ``n + 1``: in the buckets that ``batch`` touches ``fold(batch, rows there)``, the others as they are.

        ``number`` counts the batches of ``stream``; one that is already part of the store changes nothing, so a repeated
        batch counts once. A stream that is new to a store that exists goes on from what it holds. Rows are shuffled by bucket before they
        are written, unless the fold has ``dealt`` them by the key to :meth:`partitions`; then they are written where they lie.
        """
        now = self.current() or {"version": -1, "buckets": self.buckets, "data": {}, "streams": {}}
        if number is not None and now["streams"].get(stream, -1) >= number:
            return now
        touched = sorted(r[0] for r in batch.select(self.bucket().alias("b")).distinct().collect())  # at most as many as there are buckets
        name = uuid.uuid4().hex
        made = fold(batch, self.read(now, touched) if now["version"] >= 0 else self.read({"data": {}}))
        columns = [f.strip().split(" ")[0] for f in self.schema.split(",")]
        out = made.select(*columns).withColumn("_bucket", self.bucket())
        if not dealt or self.hash != "hash":
            out = out.hint("rebalance", F.col("_bucket"))
        out.write.partitionBy("_bucket").option("compression", "zstd").parquet(f"{self.path}/data/{name}")
        written = {p.rsplit("=", 1)[1]: f"{name}/_bucket={p.rsplit('=', 1)[1]}" for p in listed(self.spark, f"{self.path}/data/{name}/_bucket=*")}
        if not set(written) <= {str(b) for b in touched}:
            raise ValueError("the fold gave rows of buckets that its batch does not touch")
        kept = {b: p for b, p in now["data"].items() if int(b) not in touched}
        streams = now["streams"] | ({stream: number} if number is not None else {})
        new = {"version": now["version"] + 1, "buckets": self.buckets, "hash": self.hash, "data": kept | written, "streams": streams, "at": time.time(), "touched": touched}
        target = f"{self.path}/manifest/v-{new['version']:012d}.json"
        draft = f"{self.path}/manifest/.draft-{name}"
        write_text(self.spark, draft, json.dumps(new))
        if not rename(self.spark, draft, target):
            remove(self.spark, draft)
            remove(self.spark, f"{self.path}/data/{name}")
            raise Conflict(f"version {new['version']} of {self.path} exists")
        return new

    def vacuum(self, seconds: float) -> int:
        """Removes versions superseded more than ``seconds`` ago and data that no remaining one names; returns the number of versions removed.

        ``seconds`` must be longer than any reader or writer takes.
        """
        names = listed(self.spark, f"{self.path}/manifest/v-*.json")
        versions = [json.loads(read_text(self.spark, p)) for p in names]
        limit = time.time() - seconds
        old = [n for n, later in enumerate(versions[1:]) if later["at"] < limit]
        named = {p for n, v in enumerate(versions) if n not in old for p in v["data"].values()}
        for n in old:  # manifests first, so that none names what is gone
            remove(self.spark, names[n])
        for p in {p for n in old for p in versions[n]["data"].values()} - named:
            remove(self.spark, f"{self.path}/data/{p}")
        return len(old)
