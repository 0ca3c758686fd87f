"""Shared folder, table access and cut points used by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lokalith import workspace
from lokalith.workspace import shared_dir


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; known to the innermost :func:`scratch`."""
    path = workspace.fresh_path(spark, name)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut of lineage that survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what was cut off inside. What outlives it must be written elsewhere before."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> tuple[DataFrame, str]:
    """The result of ``make`` in the shared folder, and its path; what was cut off on the way is deleted."""
    path = fresh_path(spark, name)
    with scratch(spark):
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove_cut_points(spark: SparkSession) -> None:
    """Delete every table that this application has cut off."""
    remove(spark, f"{shared_dir(spark)}/lokalith/{spark.sparkContext.applicationId}")


#: A key that this part of all rows or more have is frequent; there are at most so many.
FREQUENT = 1000


def lookup(rows: DataFrame, found: DataFrame, key: str, value: str, count: str, *spread_by: str) -> DataFrame:
    """``rows`` with ``value`` from ``found(key, value, count)``, which has one row a key and is written down already.

    ``count`` says how many rows have the key. Frequent keys, FREQUENT at most, are looked up by broadcast, and their rows
    are dealt by the hash of ``spread_by``, so no task gets them all; the others meet by a shuffled join.
    """
    total = found.agg(F.sum(count)).head()[0] or 0
    frequent = found.where(F.col(count) * FREQUENT >= total).select(key, F.struct(value).alias("_known"))
    spread = F.when(F.col("_known").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(*spread_by))
    dealt = rows.join(F.broadcast(frequent), key, "left").withColumn("_spread", spread)
    rest = found.select(key, F.col(value).alias("_value"), F.lit(0).cast("long").alias("_spread"))
    told = F.when(F.col("_known").isNull(), F.col("_value")).otherwise(F.col(f"_known.{value}"))
    return dealt.join(rest, [key, "_spread"], "left").select(*rows.columns, told.alias(value))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The column as a string, null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold_of(id_column: str, modulus: int = 4) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
