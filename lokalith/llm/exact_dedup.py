"""Exact de-duplication: group by a 128-bit content hash, compare bytes inside the groups.

Plan. A partial aggregate on ``(hash, text)`` runs before the one shuffle of texts, so a group that holds a
third of all rows leaves each map task as a single row. The text is part of the grouping key: Spark compares
its bytes, and two texts with one hash stay two groups. What goes back to the single rows is narrow
(hash, SHA-256, kept id, count) and joins without any text; a hot group there is an ordinary skewed
equi-join that adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lokalith.llm.shared import text_of


def content_hash(text: Column) -> Column:
    """128 bits: MD5 as 16 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hash128: Callable[[Column], Column] = content_hash
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``keep`` is ``"min"`` or ``"max"``: which id of equal texts stays. Null texts count as empty. Rows that
    repeat both id and text are the same document: each is returned, all with the same flag. A null id never
    stays while the group has another; if all are null, ``keep_id`` is null and the rows count as kept. An
    empty table gives an empty result. Columns other than the two named ones are not read.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep must be 'min' or 'max'")
    pick = F.min if keep == "min" else F.max
    text = text_of(text_col)
    rows = df.select(F.col(id_col).alias("doc_id"), hash128(text).alias("h"), F.sha2(text, 256).alias("text_sha256"))
    groups = (
        df.select(F.col(id_col).alias("i"), hash128(text).alias("h"), text.alias("t"))
        .groupBy("h", "t")
        .agg(pick("i").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", F.sha2("t", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    return rows.join(groups, ["h", "text_sha256"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hash128: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The rows that stay, one per distinct text, with all columns of ``df``.

    One shuffle: the other columns travel as a struct beside the grouping key. Null and empty texts are one
    group. Rows that repeat id and text leave exactly one.
    """
    pick = F.min_by if keep == "min" else F.max_by
    others = [c for c in df.columns if c != text_col]
    null_rank = F.col(id_col).isNull() if keep == "min" else F.col(id_col).isNotNull()
    grouped = (
        df.select(
            hash128(text_of(text_col)).alias("h"),
            text_of(text_col).alias("t"),
            F.struct(*[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(others)], F.col(text_col).isNull().alias("no_text")).alias("r"),
            F.struct(null_rank.alias("n"), F.col(id_col).alias("i")).alias("o"),
        )
        .groupBy("h", "t")
        .agg(pick("r", "o").alias("r"))
    )
    back = {c: F.col(f"r.c{n}") for n, c in enumerate(others)}
    back[text_col] = F.when(~F.col("r.no_text"), F.col("t"))
    return grouped.select(*[back[c].alias(c) for c in df.columns])
