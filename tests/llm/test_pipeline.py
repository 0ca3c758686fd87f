"""The pipeline: every stage on edge cases, and the whole against brute force for its parts."""

import zlib
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lokalith.llm import toxicity
from lokalith.llm.shared import fold_of, table
from lokalith.llm.tokens import encoder
from tests.llm.test_operators import GPT, ROWS, brute_contamination, brute_fingerprint, plain_toxicity


@pytest.fixture(scope="module")
def odd(spark, sf):
    rows = [(d, t, "en", s, len(t or "")) for d, t, s in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("keep_id", F.lit(1)).withColumn("fp", F.lit("x"))


def brute_wide(text):
    ws = (text or "").encode().lower().split()
    grams = [b" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))] if ws else []
    h = [xxhash.xxh3_128_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(128) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_near_copies(docs):
    """Smallest id of each document's component: every pair compared, 7 of 64 bits and 23 of 128 at most."""
    prints = {d: (brute_fingerprint(t), brute_wide(t)) for d, t in docs}
    part = {d: {d} for d in prints}
    for x, (f, w) in prints.items():
        for y, (g, v) in prints.items():
            if y < x and part[x] is not part[y] and (f ^ g).bit_count() <= 7 and (w ^ v).bit_count() <= 23:
                part[x] |= part[y]
                for k in part[y]:
                    part[k] = part[x]
    return {d: min(p) for d, p in part.items()}


def test_stages_on_edges(spark, sf, odd):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.where("false"), sf).count() == 0, name
        out = stage(spark, odd, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == odd.columns, name
        assert out.count() > 0


def test_run_matches_brute_force(spark, sf):
    """Every stage recomputed plainly over all documents: scores, copies, pairs, windows, tokens and best fit."""
    docs, enc = table(spark, sf, "documents"), encoder(GPT)
    model = toxicity.learn(docs, table(spark, sf, "labels"), fold_of("doc_id") != 2)
    clean = [(r["doc_id"], r["text"]) for r in docs.collect() if plain_toxicity(model, r["text"])[1] < 0.3]
    assert len(clean) > 0.8 * docs.count()
    last = {}
    for d, t in clean:
        last[t] = max(d, last.get(t, d))
    first = brute_near_copies([(d, t) for t, d in last.items()])
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    want = {d: t for t, d in last.items() if first[d] == d and not brute_contamination(t, items)[1]}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, sf).collect():
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == want.keys()
    lengths = []
    for d, t in want.items():
        data, at = enc.whole(t or "") + bytes(4), 0
        for n, (piece, start, length, crc) in enumerate(sorted(pieces[d])):
            assert (piece, start) == (n, at) and crc == zlib.crc32(data[4 * at : 4 * (at + length)]) and (length == 2048 or n == 0)
            at += length
            lengths.append(length)
        assert 4 * at == len(data)
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        room = min(fit) if fit else 2048
        if fit:
            rooms.remove(room)
        rooms.append(room - n)
    assert len(sequences) == len(rooms)
    for own in sequences.values():
        assert [a for a, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
