"""Spelling variants: a trie self-join with active-node sets over a prefix-partitioned vocabulary.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. The edit lies either behind
the first half of the shorter word or before it, so near words share that half as a prefix or the other as a suffix.
Every word is dealt to the partitions of both halves, for its own length and for the next shorter one: a partition holds
words ``left + inner + right`` with the same ``left`` and ``right``, whose ``inner`` parts have ``m`` or ``m + 1`` code points. It
is a trie of the inner parts, down which each node passes its active nodes (those within distance one) to its
children; terminal nodes that are active for each other with distance one are a pair. Partitions that are too large are
halved again in the same way, so none grows with the vocabulary and no pair is lost or found twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lokalith.llm.shared import lookup, materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A maximal run of letters; and a partition of more words is halved, unless its inner parts are of one code point or two.
RUN, PARTITION_WORDS = r"[A-Za-zÀ-ÿ]+", 4096
_SHARED = ["m", "left", "right"]


def planted_words(docs: DataFrame, least: int = 7, every: int = 31, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``word, n``: runs of letters of whole texts, A-Z lower-cased, with a slip in every ``every``-th, of ``least`` code points or more.

    Of the occurrences whose ``crc32(<doc_id>:<run>)`` is a multiple of ``every`` the code point ``crc32 % length`` is deleted. A null
    text has no words; a null id counts as the empty text.
    """
    long_runs = RUN.replace("+", f"{{{least},}}")  # a maximal run that is shorter can't give a word
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(long_runs), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substr("run", F.lit(1), at), F.substr(F.col("run"), at + 2))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % every == 0, slipped).otherwise(F.col("run")).alias("word"))
    return counted(words.where(F.length("word") >= least))


def counted(words: DataFrame) -> DataFrame:
    """``word, n`` of a table of occurrences; added up before the shuffle."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _dealt(parts: DataFrame) -> DataFrame:
    """Rows ``m, left, inner, right`` as members of the two halves of their partitions; ``m`` is the length of the shorter inner parts.

    A shorter part is cut behind ``m // 2``: the prefix half keeps what follows as the inner part, the suffix half what precedes.
    """
    half = F.floor(F.col("m") / 2).cast("int")
    tail = (F.col("m") - half).cast("int")
    keep = F.length("inner") - tail
    prefix = F.struct(tail.alias("m"), F.concat("left", F.substr("inner", F.lit(1), half)).alias("left"), F.substr(F.col("inner"), half + 1).alias("inner"), F.col("right").alias("right"))
    suffix = F.struct(half.alias("m"), F.col("left").alias("left"), F.substr("inner", F.lit(1), keep).alias("inner"), F.concat(F.substr(F.col("inner"), keep + 1), "right").alias("right"))
    return parts.select(F.explode(F.array(prefix, suffix)).alias("p")).select("p.*")


def _whole(vocabulary: DataFrame) -> DataFrame:
    """The vocabulary by length: each word among those of its own length and, as the longer one, among the next shorter."""
    n = F.length("word")
    return vocabulary.select("word", F.explode(F.array(n, n - 1)).alias("m")).where("m > 0").select("m", F.lit("").alias("left"), F.col("word").alias("inner"), F.lit("").alias("right"))


class Trie:
    """Nodes as rows of three lists: parent's children by code point, and whether a word ends here."""

    def __init__(self, words: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        for word in words:
            at = 0
            for c in word:
                nxt = self.children[at].get(c)
                if nxt is None:
                    nxt = self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                at = nxt
            self.ends[at] = word

    def passed_down(self, active: dict[int, int], c: str) -> dict[int, int]:
        """Active nodes (node: distance, one at most) of the child by ``c``, from those of its parent.

        The child is an active node's child by ``c`` (same distance), the active node itself (``c`` deleted), or one of
        its other children (``c`` replaced); below a match at distance 0 one inserted code point is free.
        """
        out: dict[int, int] = {}
        for node, d in active.items():
            own = self.children[node].get(c)
            if own is not None:
                if out.get(own, 2) > d:
                    out[own] = d
                if d == 0:
                    for below in self.children[own].values():
                        out.setdefault(below, 1)
            if d == 0:
                out.setdefault(node, 1)
                for other in self.children[node].values():
                    out.setdefault(other, 1)
        return out

    def pairs(self) -> Iterator[tuple[str, str]]:
        """Words at distance one, each pair once. Depth first, without recursion."""
        first = {0: 0} | dict.fromkeys(self.children[0].values(), 1)
        todo = [(0, first)]
        while todo:
            node, active = todo.pop()
            word = self.ends[node]
            if word is not None:
                for other, d in active.items():
                    if d == 1 and other < node and (near := self.ends[other]) is not None:
                        yield word, near
            for c, child in self.children[node].items():
                todo.append((child, self.passed_down(active, c)))


def partition_pairs(m: int, left: str, right: str, inner: list[str]) -> Iterator[tuple[str, str]]:
    """Near words of one partition, as whole words. Both parts longer than ``m``, and pairs that a prefix half finds, are left out."""
    for a, b in Trie(inner).pairs():
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        if len(short) != m or (right and long.startswith(short)):
            continue
        yield left + a + right, left + b + right


def near_pairs(vocabulary: DataFrame, partition_words: int = PARTITION_WORDS) -> DataFrame:
    """``a, b``: the pairs of different words of ``vocabulary(word)`` at distance one, each once. Nulls and repeats count once or not at all."""
    parts = _dealt(_whole(vocabulary.select("word").where("word is not null").distinct()))
    small = None
    while True:
        parts = materialise(parts, "parts")
        key = F.struct(*_SHARED)
        sizes = materialise(parts.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).select("key", "n", ((F.col("n") > partition_words) & (F.col("key.m") > 1)).alias("large")), "sizes")
        if not sizes.where("large").limit(1).count():
            small = parts if small is None else small.unionByName(parts)
            break
        told = materialise(lookup(parts.withColumn("key", key), sizes, "key", "large", "n", "inner").drop("key"), "told")
        fine = told.where(~F.col("large")).drop("large")
        small = fine if small is None else small.unionByName(fine)
        parts = _dealt(told.where("large").drop("large"))
    gathered = small.groupBy(*_SHARED).agg(F.collect_list("inner").alias("inner")).where(F.size("inner") > 1)
    tasks = int(small.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gathered = gathered.repartition(tasks)  # small in bytes, long in work: not to be packed into a few tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [p for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for p in partition_pairs(*row)]
            for at in range(0, len(found), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found[at : at + (1 << 16)], strict=True)], names=["a", "b"])

    return gathered.mapInArrow(run, "a string, b string")


def near_counts(vocabulary: DataFrame, pairs: DataFrame) -> DataFrame:
    """``word, n, n_near, near_n, near``: number of near words, and of these the most frequent (ties: the smallest)."""
    n = lambda side: vocabulary.select(F.col("word").alias(side), F.col("n").alias(f"n_{side}"))
    both = pairs.join(n("a"), "a").join(n("b"), "b")
    ends = both.select(F.explode(F.array(*[F.struct(F.col(x).alias("word"), F.col(y).alias("other"), F.col(f"n_{y}").alias("m")) for x, y in ("ab", "ba")])).alias("p")).select("p.*")
    best = ends.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("r"))
    told = vocabulary.select("word", "n").join(best, "word", "left")
    return told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("r.m")).alias("near_n"), F.col("r.other").alias("near"))


def with_roots(forms: DataFrame) -> DataFrame:
    """``word, form, ...`` with ``root``: forms followed to the last. Each form is some times as frequent as its word, so chains are short; every round doubles the steps."""
    linked = materialise(forms.where("form is not null").select("word", F.col("form").alias("root")), "links")
    while True:
        step = linked.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        further = materialise(linked.join(step, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "links")
        linked = further.drop("moved")
        if not further.where("moved").limit(1).count():
            break
    return forms.join(linked, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(words: DataFrame, least_n: int = 2, ratio: int = 10, partition_words: int = PARTITION_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of ``words(word, n)`` with ``n`` of ``least_n`` or more.

    A word's form is its near word of largest ``n`` (ties: smallest in code-point order) where that is ``ratio`` times its own
    or more, else null; ``root`` is the last form of the chain, the word itself without one. Words may be of any length.
    An empty table gives no rows; other columns are ignored.
    """
    vocabulary = materialise(words.where((F.col("n") >= least_n) & F.col("word").isNotNull()).select("word", "n"), "vocabulary")
    told = near_counts(vocabulary, near_pairs(vocabulary, partition_words))
    known = F.col("near_n") >= ratio * F.col("n")
    forms = materialise(told.select("word", "n", "n_near", F.when(known, F.col("near")).alias("form"), F.when(known, F.col("near_n")).alias("form_n")), "forms")
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")
