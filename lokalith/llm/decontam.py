"""Benchmark decontamination as a prefix-filtered containment join, in DataFrame operations only.

An item is cut into windows of ten words (a shorter item is one window). Containment must be complete, so the
necessary prefix of a window is one token: its rarest word by the counts over the whole corpus. Documents are
read as ``(position, word)``, joined on that prefix token, bounded by position and length, and a candidate is
verified word by word over the window. Scan, split, explode, join and verification are one stage without a
shuffle: the benchmark's windows are broadcast in blocks of checked size, one pass over the documents each.
Only verified hits are shuffled, and the items of a window are joined to its hits.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lokalith.llm.shared import materialise, text_of

WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Bytes of windows that one pass may broadcast.
BLOCK_BYTES = 32 << 20


def words_of(text: Column) -> Column:
    """Words of a text with A-Z (and no other letter) in lower case."""
    plain = F.octet_length(text) == F.length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(low, WORD_GAP), "")


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``(w, len, item)``: each distinct window of each item, its words space-joined. Items without a word have none."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(text_of(text_col)).alias("ws")).where("size(ws) > 0")
    at = items.select("item", "ws", F.explode(F.sequence(F.lit(0), F.greatest(F.size("ws") - window, F.lit(0)))).alias("at"))
    cut = at.select("item", F.slice("ws", F.col("at") + 1, F.lit(window)).alias("ws"))
    return cut.select(F.array_join("ws", " ").alias("w"), F.size("ws").alias("len"), "item").distinct()


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), words_of(text).alias("ws"))


def _blocks(small: DataFrame, key: str, size: Column) -> list[DataFrame]:
    """``small`` in parts by hash of ``key``, none of more than BLOCK_BYTES unless a single row is."""
    told = small.agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows"), F.max(size).alias("most")).head()
    n = 1 + 2 * (told["bytes"] or 0) // BLOCK_BYTES
    part = lambda n: F.pmod(F.xxhash64(key), F.lit(n))
    while 1 < n < told["rows"] and (small.groupBy(part(n)).agg(F.sum(size).alias("b")).agg(F.max("b")).head()[0] or 0) > max(BLOCK_BYTES, told["most"]):
        n *= 2
    return [small.where(part(n) == k) if n > 1 else small for k in range(n)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def prefix_windows(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Distinct windows with their prefix token and its place; those with a word that no document has are left out."""
    words = materialise(windows.select("w", "len").distinct().select("w", "len", F.posexplode(F.split("w", " ")).alias("off", "token")), "window-words")
    vocabulary = words.select("token").distinct()
    said = docs.select(F.explode("ws").alias("token"))
    counts = _union([said.join(F.broadcast(v), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n")) for v in _blocks(vocabulary, "token", F.octet_length("token") + 32)])
    rare = words.join(counts, "token", "left").groupBy("w").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "off")).alias("p"), F.first("len").alias("len"))
    return materialise(rare.where("p.n > 0").select("w", "len", "p.token", "p.off"), "prefixes")


def window_hits(docs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``(doc_id, h, at, len, w)`` for every occurrence of a window in a document; items are joined to hits, not broadcast."""
    placed = docs.select("doc_id", "h", "ws", F.posexplode("ws").alias("pos", "token"))
    size = F.octet_length("w") * 2 + 96
    at = F.col("pos") - F.col("off")
    found = []
    for block in _blocks(prefixes, "w", size):
        verified = (placed["token"] == block["token"]) & (at >= 0) & (at + F.col("len") <= F.size("ws")) & (F.array_join(F.slice("ws", at + 1, F.col("len")), " ") == F.col("w"))
        found.append(placed.join(F.broadcast(block), verified).select("doc_id", "h", at.alias("at"), "len", "w"))
    return _union(found)


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, h, n_words, n_hit, items, contaminated``.

    ``n_hit`` counts the words inside any occurrence of a window, ``items`` lists (sorted as strings) the items
    with one. Null texts have no words; items without a word have no window; a null item id shows as the empty
    string. Rows are told apart by id and text, so a repeated id does not mix texts, and repeated rows get the
    same answer each. Empty tables on either side give no hits. ``h`` is a hash of the text.
    """
    keyed = _keyed(docs, id_col, text_col)
    windows = materialise(item_windows(benchmark, item_col, item_text_col, window), "windows")
    hits = materialise(window_hits(keyed, prefix_windows(keyed, windows)), "hits")
    places = F.transform(F.collect_set(F.struct("at", "len")), lambda x: F.sequence(x["at"], x["at"] + x["len"] - 1))
    covered = hits.groupBy("doc_id", "h").agg(F.size(F.array_distinct(F.flatten(places))).cast("long").alias("n_hit"))
    named = hits.select("doc_id", "h", "w").distinct().join(windows.select("w", "item"), "w").groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("item")).alias("items"))
    n = named.select(F.col("doc_id").alias("d"), F.col("h").alias("k"), "items")
    found = covered.join(n, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("k"))).select("doc_id", "h", "n_hit", "items")
    f = found.select(F.col("doc_id").alias("found_id"), F.col("h").alias("found_h"), "n_hit", "items")
    rows = keyed.select("doc_id", "h", F.size("ws").cast("long").alias("n_words"))
    joined = rows.join(f, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("h") == F.col("found_h")), "left")
    return joined.select(
        "doc_id", "h", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names: str) -> DataFrame:
    """``docs`` without the rows that hold a whole window of an item; all columns stay.

    Null and empty texts hold none and stay, as does everything where the benchmark is empty. Rows are told apart by id
    and text, null ids too, so a repeated id loses only the texts that hit; repeated rows go or stay together.
    """
    keyed = _keyed(docs, id_col, text_col)
    prefixes = prefix_windows(keyed, materialise(item_windows(benchmark, **names), "windows"))
    gone = window_hits(keyed, prefixes).select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h")).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone["gone_id"]) & (F.xxhash64(text_of(text_col)) == gone["gone_h"]), "left_anti")
