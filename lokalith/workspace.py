"""The folder that driver and executors share, for what a job writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a temporary one on a single machine; an error on a cluster."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if not root:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _LOCAL.setdefault(sc.applicationId, "")
        if not root:
            own = tempfile.mkdtemp(prefix="lokalith-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            root = _LOCAL[sc.applicationId] = f"file://{own}"
            sc.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/lokalith/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def listed(spark: SparkSession, glob: str) -> list[str]:
    """Paths that match, in order of their names; none where the folder is missing."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(glob)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return sorted(s.getPath().toString() for s in found or [])


def any_matches(spark: SparkSession, glob: str) -> bool:
    """Whether any path matches; the paths stay in the JVM."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(glob)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def read_text(spark: SparkSession, path: str) -> str:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).open(hadoop)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, body: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop, True)
    try:
        stream.write(bytearray(body.encode()))
    finally:
        stream.close()


def rename(spark: SparkSession, source: str, target: str) -> bool:
    """False where ``target`` exists or the file system refuses."""
    a, b = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    store = a.getFileSystem(spark._jsc.hadoopConfiguration())
    return not store.exists(b) and store.rename(a, b)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Inside, what a query has shuffled goes when it ends, not when the driver happens to collect garbage. For queries that run once."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def settled(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: a cut of lineage that survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Deletes what :func:`settled` wrote for these, once nothing reads it any more."""
    for df in frames:
        for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
            remove(df.sparkSession, path)


def remove_cut_points(spark: SparkSession) -> None:
    """Delete every table that this application has cut off."""
    remove(spark, f"{shared_dir(spark)}/lokalith/{spark.sparkContext.applicationId}")
