"""The translation chain: journal, first row of each source, batches, requests, accepted answers, journal, catalog."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lokalith.operators import catalog
from lokalith.sources import journal as journal_files
from lokalith.workspace import settled, tidy

SEPARATOR = "|||"
#: Requests of one batch, and seconds before the second one, doubled before each further one.
ATTEMPTS, FIRST_DELAY = 3, 2.0


class Refused(Exception):
    """The other side will not answer this request however often it is sent."""


def ask_with_retry(ask: Callable[[str], str], payload: str, attempts: int = ATTEMPTS, delay: float = FIRST_DELAY, wait: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None, int]:
    """``(answer, error, requests)``; :class:`Refused` ends at once, any other error after ``attempts``."""
    error = None
    for n in range(1, attempts + 1):
        try:
            return ask(payload), None, n
        except Refused as e:
            return None, str(e), n
        except Exception as e:  # noqa: BLE001 - whatever a client raises counts as a failed request
            error = str(e)
        if n < attempts:
            wait(delay * 2 ** (n - 1))
    return None, error, attempts


def requested(batches: DataFrame, ask: Callable[[str], str], journal: str, run: str, parallel: int = 1, attempts: int = ATTEMPTS, delay: float = FIRST_DELAY) -> DataFrame:
    """``batches(group..., batch, n, sources)`` with ``payload`` (made of the sources where it isn't there, behind the shuffle), ``accepted, error, requests``; at most
    ``parallel`` requests run at once, one a partition.

    An answer with as many segments as sources is accepted and committed to ``journal`` before the next request; others are noted as
    refused for this ``run``. A task that is run again reads both first, so it asks only for what it had not been answered.
    """
    names = [*batches.columns, "accepted", "error", "requests"]

    def run_batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = journal_files.Segments(journal, run)

        def one(name: str, sources: list[str], payload: str) -> tuple[bool, str | None, int]:
            known = segments.known(name)
            if known is not None:
                return known[0] is not None, known[1], 0
            answer, error, n = ask_with_retry(ask, payload, attempts, delay)
            found = [] if answer is None else answer.split(SEPARATOR)
            if len(found) == len(sources):
                segments.commit(name, zip(sources, (x.strip(" ") for x in found), strict=True))
                return True, None, n
            why = error if answer is None else f"{len(found)} segments for {len(sources)} sources"
            segments.refuse(name, why or "")
            return False, why, n

        for part in parts:
            rows = part.select(["sources", "payload"]).to_pylist()
            own = part.drop_columns(["sources", "payload"]).to_pylist()
            done = [one(segments.name_of(list(o.values()), r["sources"]), r["sources"], r["payload"]) for o, r in zip(own, rows, strict=True)]
            columns = [pa.array([f[k] for f in done], kind) for k, kind in enumerate((pa.bool_(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=names)

    dealt = batches.repartition(parallel)
    if "payload" not in names:
        dealt, names = dealt.withColumn("payload", payload_of(F.col("sources"))), [*batches.columns, "payload", "accepted", "error", "requests"]
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)
    return dealt.mapInArrow(run_batches, f"{kept}, accepted boolean, error string, requests int")


def payload_of(sources: Column) -> Column:
    """The request for these sources."""
    return F.array_join(F.transform(sources, lambda s: F.replace(s, F.lit(SEPARATOR), F.lit(""))), SEPARATOR)


def batches_with_sources(rows: DataFrame, size: int = 150, group: str = "src_path") -> DataFrame:
    """``group, batch, n, sources``: the sources behind the segments of :func:`catalog.translation_batches`."""
    numbered = catalog.running(catalog.open_rows(rows).select(group, "ord", "source"), group).withColumn("batch", F.floor(F.col("index") / size))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "source"))), lambda x: x["source"])
    return numbered.groupBy(group, "batch").agg(F.count(F.lit(1)).alias("n"), parts.alias("sources"))


def translate(
    rows: DataFrame, ask: Callable[[str], str], journal: str, size: int = 150, parallel: int = 1, attempts: int = ATTEMPTS, delay: float = FIRST_DELAY, counters: list | None = None,
) -> DataFrame:
    """``rows`` with translations; a restart asks only for what the journal below ``journal`` does not hold.

    Blank translations are taken from the journal. Of each source the first row decides whether it is asked for.
    Each batch is in the journal once it is answered, so each is paid for once even if this run dies; then every row of a source
    that was asked for takes its translation, also one that had another. ``counters`` gets a row ``batches, accepted, requests``.
    """
    spark, run = rows.sparkSession, uuid.uuid4().hex
    filled = catalog.backfill(rows, journal_files.read(spark, journal))
    # written down: what is open must not be worked out again when the journal has grown, nor for each pass of the numbering
    waiting = settled(catalog.open_rows(catalog.unique_sources(filled)).select("src_path", "ord", "source", "translation"), "asked")
    asked = waiting.select("source")
    told = requested(batches_with_sources(waiting, size), ask, journal, run, parallel, attempts, delay)
    with tidy(spark):
        done = told.agg(F.count(F.lit(1)).alias("batches"), F.count_if("accepted").alias("accepted"), F.coalesce(F.sum("requests"), F.lit(0)).alias("requests")).head()
    if counters is not None:
        counters.append(done)
    journal_files.clear_notes(spark, journal, run)
    return catalog.apply_translations(filled, journal_files.read(spark, journal).join(asked, "source", "left_semi"))
