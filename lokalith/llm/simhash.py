"""SimHash near-duplicate groups by a generalised pigeonhole over correlated bit partitions.

1. Each document gets a 64-bit fingerprint and, where asked for, a wide one of 128 bits over longer shingles (Arrow batches).
2. Equal fingerprints become one node. All later steps see nodes only, so groups of copies cost nothing.
3. From all nodes: a 64 x 64 bit co-occurrence matrix (fixed size). Bits that vary together are put in the
   same partition, and a dynamic program gives each partition its own threshold ``t_i`` with
   ``sum(t_i) = max_distance - partitions + 1`` (``-1``: not probed), at the least cost: keys that a node emits, and pairs that
   then share a key, counted on the pairs of a sample of nodes, as bits of one partition are not independent. Two fingerprints within ``max_distance`` then agree up
   to ``t_i`` bits in at least one partition.
4. Probe: a node emits one key for each way of ignoring ``t_i`` bits of partition ``i``. Keys are counted by partial sums, and
   those of a single node leave at once; counts of frequent keys are looked up by broadcast, so their nodes stay spread.
5. Verify: within a key all pairs are compared by exclusive or and bit count, many keys at a time, and only links that
   join two so far separate parts of the key's nodes are emitted. So no link between different texts is lost and a
   key never gives more links than nodes. Keys of more than ``TILE`` nodes are cut into tiles, and each pair of tiles
   is a task of its own, so none is gathered whole.
6. Components of those links; every document reads its component over its node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations
from math import acos, comb, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lokalith.llm.components import components
from lokalith.llm.shared import lookup, materialise, text_of

BITS, WIDE_BITS = 64, 128
#: Cost of comparing a pair, where counting, moving and sorting a key is 1. Measured: 20 ns a pair in keys of 64 nodes or more, 8 microseconds a key.
PAIR_COST = 1 / 400
#: Nodes whose pairs the plan's estimates are counted on.
PLAN_SAMPLE = 2048
#: Nodes of a key that are verified in one go.
TILE = 4096
_BLOCK = 1 << 15


def _sketch(words: list[bytes], width: int, digest: Callable[[bytes, int], bytes], bits: int) -> bytes:
    """Big-endian bits that are set in over half of the digests (seed 42) of the shingles, repeats included."""
    if not words:
        return bytes(bits // 8)
    width = min(width, len(words))
    joined = b" ".join(words)
    ends = [e + n for n, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends[:-1])]
    last, n = ends[width - 1 :], len(words) - width + 1
    total = np.zeros(bits, dtype=np.int64)
    for at in range(0, n, _BLOCK):
        raw = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[at : at + _BLOCK], last[at : at + _BLOCK], strict=False)])
        total += np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, bits // 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > n).tobytes()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of the word shingles of ``text`` (XXH64), repeats included; 0 without a word."""
    from xxhash import xxh64_digest

    return int.from_bytes(_sketch(words_of(text), width, xxh64_digest, BITS), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, wide_width: int | None = None) -> DataFrame:
    """``(doc_id, h, fp, w1, w2)``: one row per input row; ``fp`` as a signed long, ``h`` a hash of the text, ``w1`` and
    ``w2`` the halves of the wide fingerprint of ``wide_width`` words (XXH3, 128 bits), 0 where none is asked for.

    Null and empty texts have fingerprints 0; null ids and repeated rows come as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest, xxh64_digest

        for batch in batches:
            raw = bytearray()
            for t in batch.column(2):
                words = words_of(t.as_py())
                raw += _sketch(words, width, xxh64_digest, BITS)
                raw += _sketch(words, wide_width, xxh3_128_digest, WIDE_BITS) if wide_width else bytes(WIDE_BITS // 8)
            three = np.frombuffer(bytes(raw), dtype=">i8").astype(np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(three[:, k]) for k in range(3))], names=["doc_id", "h", "fp", "w1", "w2"])

    text = text_of(text_col)
    rows = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, h long, fp long, w1 long, w2 long")


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of nodes and the 64 x 64 counts of bits set together, over all nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(fps), _BLOCK):
                bits = ((fps[at : at + _BLOCK, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
                total += bits.T @ bits
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS)), pa.array(list(total.astype(np.int64)))], names=["bit", "n"])

    rows = nodes.select("fp").mapInArrow(run, "bit long, n array<long>").groupBy("bit").agg(*[F.sum(F.col("n")[j]).alias(f"n{j}") for j in range(BITS)])
    both = np.zeros((BITS, BITS))
    for row in rows.collect():  # 64 rows at most
        both[row["bit"]] = row[1:]
    return nodes.count(), both


def correlated_partitions(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size; each grows by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    scale = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    corr, free, out = np.abs(cov / scale), set(range(BITS)), []
    for k in range(parts):
        size = (BITS - sum(map(len, out))) // (parts - k)
        group = [max(sorted(free), key=lambda b: sum(corr[b, x] for x in free if x != b))]
        free.discard(group[0])
        while len(group) < size:
            group.append(max(sorted(free), key=lambda b: corr[b, group].mean()))
            free.discard(group[-1])
        out.append(sorted(group))
    return out


def shared_keys(p: np.ndarray, sample: np.ndarray, bits: list[int], distance: int) -> list[float]:
    """For each threshold up to ``distance`` the keys that two nodes share on average: counted over all pairs of the sampled fingerprints,
    and no less than independent bits would give, so that pairs too rare for the sample count as well."""
    same = 1 - 2 * p * (1 - p)  # two nodes agree in a bit
    agree, ignored = float(np.prod(same[bits])), [1.0] + [0.0] * distance
    for b in bits:  # elementary symmetric sums: over all choices of ignored bits, how much likelier the rest agrees
        for t in range(distance, 0, -1):
            ignored[t] += ignored[t - 1] / max(float(same[b]), 1e-9)
    masked = sample & np.uint64(sum(1 << b for b in bits))
    differ = np.zeros(len(bits) + 1)
    for k in range(1, len(masked)):
        differ += np.bincount(np.bitwise_count(masked[k:] ^ masked[:-k]), minlength=len(differ))
    pairs = max(differ.sum(), 1)
    # two nodes that differ in h bits agree on the keys that ignore these and any t - h others
    counted = [sum(differ[h] * comb(len(bits) - h, t - h) for h in range(min(t, len(bits)) + 1)) / pairs for t in range(distance + 1)]
    return [max(c, agree * ignored[t]) for t, c in enumerate(counted)]


def allocate(n: int, p: np.ndarray, groups: list[list[int]], distance: int, sample: np.ndarray) -> tuple[float, list[int]]:
    """Thresholds of the partitions by dynamic programming: the least keys, plus pairs that share one, a node."""
    spend = distance - len(groups) + 1
    costs = []
    for bits in groups:
        shared = shared_keys(p, sample, bits, distance)
        costs.append({-1: 0.0} | {t: comb(len(bits), t) + PAIR_COST * n * shared[t] for t in range(min(distance, len(bits)) + 1)})
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        best = {total: min((b + c, [*ts, t]) for s, (b, ts) in best.items() for t, c in cost.items() if s + t == total) for total in {s + t for s in best for t in cost}}
    return best.get(spend, (float("inf"), []))


def probe_masks(n: int, both: np.ndarray, distance: int, sample: np.ndarray) -> list[int]:
    """Masks of the bits that a key keeps: one for each partition probed and each choice of ignored bits."""
    p = np.diag(both) / max(n, 1)
    found = [(*allocate(n, p, g, distance, sample), g) for g in (correlated_partitions(n, both, k) for k in range(1, distance + 2))]
    _, thresholds, groups = min(found, key=lambda x: x[0])
    return [sum(1 << b for b in bits if b not in out) for bits, t in zip(groups, thresholds, strict=True) if t >= 0 for out in combinations(bits, t)]


def sampled(nodes: DataFrame, rows: int = PLAN_SAMPLE) -> np.ndarray:
    """Fingerprints of the ``rows`` nodes with the smallest hashes: what the plan's estimates, and nothing else, are counted on."""
    kept = nodes.select("fp", F.xxhash64("node", "fp").alias("h")).orderBy("h", "fp").limit(rows).collect()
    return np.array([r["fp"] for r in kept], dtype=np.int64).view(np.uint64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def verified(key: np.ndarray, node: np.ndarray, sketches: list[np.ndarray], distance: int, wide_distance: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Links between the nodes of each run of equal ``key``: those within the distances, as few as keep what they connect."""
    n = len(key)
    parent = np.arange(n)
    cut = np.flatnonzero(np.concatenate([key[1:] != key[:-1], [True]])) + 1 if n else np.zeros(0, dtype=np.int64)
    left = np.repeat(cut, np.diff(np.concatenate([[0], cut]))) - np.arange(n)  # rows of the key from here on
    fp, w1, w2 = sketches
    rows, k, a, b = np.flatnonzero(left > 1), 1, [], []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return int(x)

    root = parent.copy()
    while len(rows):
        i = rows[root[rows] != root[rows + k]]
        near = np.bitwise_count(fp[i] ^ fp[i + k]) <= distance
        if wide_distance is not None:
            i = i[near]
            near = np.bitwise_count(w1[i] ^ w1[i + k]) + np.bitwise_count(w2[i] ^ w2[i + k]) <= wide_distance
        i = i[near]
        for x in i.tolist():
            u, v = find(x), find(x + k)
            if u != v:
                parent[max(u, v)] = min(u, v)
                a.append(x)
                b.append(x + k)
        if len(i):
            root = parent[parent]
            while (root != parent).any():
                parent[:] = root
                root = parent[parent]
        k += 1
        rows = rows[left[rows] > k]
    return node[a], node[b]


def _arrays(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    node, *sketches = (table.column(c).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(c).to_numpy() for c in ("node", "fp", "w1", "w2"))
    return node, [x.astype(np.int64).view(np.uint64) for x in sketches]


def near_links(nodes: DataFrame, distance: int = 2, wide_distance: int | None = None) -> DataFrame:
    """``nodes(node, fp, w1, w2)`` -> links ``(a, b)`` of nodes whose fingerprints differ in ``distance`` bits at most and,
    where it is given, whose wide ones differ in ``wide_distance`` bits at most.

    Every link is of that kind, and whatever such links connect is connected. An empty table gives none.
    """
    if distance < 0:
        raise ValueError("distance must not be negative")
    n, both = bit_statistics(nodes)
    masks = [_signed(m) for m in probe_masks(n, both, distance, sampled(nodes))]
    each = nodes.select("node", "fp", "w1", "w2", F.explode(F.array(*map(F.lit, masks))).alias("mask"))
    keys = each.withColumn("key", F.struct("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("value"))).drop("mask")
    counts = materialise(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("many", F.col("n")), "keys")
    shared = lookup(keys, counts, "key", "many", "n", "node").where("many is not null")
    shared = materialise(shared.select("key.*", F.col("many").alias("n"), "node", "fp", "w1", "w2"), "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def links(table: pa.Table) -> pa.RecordBatch:
            mask, value = (table.column(c).to_numpy() for c in ("mask", "value"))
            key = np.cumsum(np.concatenate([[0], (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])]))
            node, sketches = _arrays(table)
            a, b = verified(key, node, sketches, distance, wide_distance)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            mask, value = (table.column(c).to_numpy() for c in ("mask", "value"))
            other = np.flatnonzero((mask != mask[-1]) | (value != value[-1]))
            whole = int(other[-1]) + 1 if len(other) else 0  # the last key may go on in the next batch
            if whole:
                yield links(table.slice(0, whole))
            held = table.slice(whole).combine_chunks()
        if held is not None and held.num_rows:
            yield links(held)

    few = shared.where(F.col("n") <= TILE).repartition("mask", "value").sortWithinPartitions("mask", "value")
    found = few.mapInArrow(run, "a long, b long")
    large = shared.where(F.col("n") > TILE)
    if large.isEmpty():
        return found.distinct()

    def tile(table: pa.Table) -> pa.Table:
        node, sketches = _arrays(table)
        a, b = verified(np.zeros(len(node), dtype=np.int64), node, sketches, distance, wide_distance)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    cut = large.withColumn("tiles", F.floor((F.col("n") - 1) / TILE) + 1).withColumn("r", F.pmod(F.xxhash64("node"), "tiles"))
    paired = cut.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).select(
        "mask", "value", F.least("r", "o").alias("lo"), F.greatest("r", "o").alias("hi"), "node", "fp", "w1", "w2",
    )
    more = paired.groupBy("mask", "value", "lo", "hi").applyInArrow(tile, "a long, b long")
    return found.unionByName(more).distinct()


def _grouped(docs: DataFrame, distance: int, wide_distance: int | None = None) -> DataFrame:
    """``docs(doc_id, h, fp, w1, w2)`` with ``lead``, the smallest ``(id, h)`` of the component; null ids come after all others.

    Equal sketches, compared as they are, become one numbered node: its documents are never told apart.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), F.col("h").alias("h"))
    own = docs.withColumn("sketch", F.struct("fp", "w1", "w2"))
    each = own.groupBy("sketch").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n"))
    nodes = materialise(each.select("sketch", "sketch.*", "first", "n", F.monotonically_increasing_id().alias("node")), "nodes")
    roots = components(near_links(nodes, distance, wide_distance)).withColumnRenamed("node", "of")
    placed = nodes.join(roots, nodes["node"] == roots["of"], "left").select("sketch", "node", "first", "n", F.coalesce("root", "node").alias("root"))
    placed = materialise(placed, "placed")
    lowest = materialise(placed.groupBy("root").agg(F.min("first").alias("lead"), F.count(F.lit(1)).alias("m")), "leads")
    leads = materialise(lookup(placed.select("sketch", "node", "n", "root"), lowest, "root", "lead", "m", "node"), "node-leads")
    return lookup(own, leads.select("sketch", "lead", "n"), "sketch", "lead", "n", "doc_id", "h")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """One row per input row: ``doc_id, fp, component_id`` (the smallest id of the component).

    Null, empty and blank texts have fingerprint 0 and link like any other. Fewer than ``width`` words: the
    whole sequence is the one shingle. Repeated rows, and rows of one id, are returned as often as they come. Null ids
    are ignored for ``component_id`` (null where a component has no other). An empty table gives an empty result.
    """
    docs = materialise(fingerprints(df, id_col, text_col, width), "fingerprints")
    return _grouped(docs, distance).select("doc_id", "fp", F.col("lead.id").alias("component_id"))


def wide_bound(similarity: float) -> int:
    """Bits of the wide fingerprint in which texts of that Jaccard similarity differ, plus one standard deviation.

    Sets of equal size and similarity ``s`` have the cosine ``2 s / (1 + s)``; a bit differs with the angle's share of pi.
    """
    share = acos(2 * similarity / (1 + similarity)) / pi
    return round(WIDE_BITS * share + sqrt(WIDE_BITS * share * (1 - share)))


def keep_first(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 7, wide_width: int = 5, similarity: float = 0.8
) -> DataFrame:
    """``df`` with one document of each component, that with the smallest id; all columns stay.

    Two texts are linked where their fingerprints of ``width`` words differ in ``distance`` bits at most, and their wide
    fingerprints of ``wide_width`` words in no more than texts of that Jaccard ``similarity`` mostly do
    (:func:`wide_bound`). A document is an id with a text: where an id repeats with other texts each is judged by
    its own, and of one id's texts in one component that with the smallest hash stays; rows that repeat both are
    the same document and stay together. A null id stays only where its component has no other. Null and empty
    texts are one group. An empty table stays empty.
    """
    docs = materialise(fingerprints(df, id_col, text_col, width, wide_width), "fingerprints")
    mine = F.col("doc_id").eqNullSafe(F.col("lead.id")) & (F.col("h") == F.col("lead.h"))
    grouped = _grouped(docs, distance, wide_bound(similarity))
    gone = grouped.where(~mine).select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h")).distinct()
    return df.join(gone, df[id_col].eqNullSafe(gone["gone_id"]) & (F.xxhash64(text_of(text_col)) == gone["gone_h"]), "left_anti")
