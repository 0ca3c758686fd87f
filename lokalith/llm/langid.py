"""Language identification by compression.

For each language a zstandard dictionary holds raw text of it. A text is compressed whole with every dictionary;
the language whose dictionary makes it smallest wins. Dictionaries are digested once per worker. All texts are compressed
with the same settings, where four matching bytes already count. A narrow margin between the two smallest sizes,
relative to the text, marks the row as rejected.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lokalith.llm.shared import text_of

UNKNOWN = "und"
#: Bound of the training sample: about so many rows a language, about so many of all languages (so fewer of each where there are
#: more than 256 of them, one at least), at most twice as many; a stretch of so many characters of each.
SAMPLE_ROWS, SAMPLE_CHARS, ALL_ROWS = 400, 300, 102_400
DICTIONARY_BYTES = 112 << 10
#: Settings of the compressor, fixed so that they do not follow input sizes.
SETTINGS = {"window_log": 21, "hash_log": 17, "chain_log": 17, "search_log": 2, "min_match": 4, "target_length": 32, "strategy": 6}
#: A margin of fewer bytes per byte of text is narrow.
NARROW = 0.01
_OTHER = re.compile(r"[\W\d_]+")


def normal(text: str) -> bytes:
    """The letters of the whole text in lower case; whatever lies between them is one space."""
    return f" {_OTHER.sub(' ', text.lower()).strip()} ".encode()


def learn(df: DataFrame, usable: Column, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> dict[str, bytes]:
    """Raw dictionaries by language from the rows of ``df`` where ``usable`` and ``lang_col`` is not null.

    Every language is learned. The sample is bounded: about SAMPLE_ROWS rows a language and ALL_ROWS in all, by hash of id and
    text (the lowest hash of a language in any case) at a rate that follows from the counts over all rows; equal texts of a language are one row, and of all these
    the first by hash up to twice the expected number. Of each text SAMPLE_CHARS characters are taken, from a
    place that its hash decides. Null and empty texts are not used.
    """
    text = text_of(text_col)
    rows = df.where(usable & F.col(lang_col).isNotNull() & (F.length(text) > 0)).select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"), F.xxhash64(id_col, text).alias("h"))
    found = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("lowest")).collect()  # a row a language
    counts = {r["lang"]: r["n"] for r in found}
    if not counts:
        return {}
    each = max(1, min(SAMPLE_ROWS, ALL_ROWS // len(counts)))
    told = [(r["lang"], math.ceil(min(1.0, each / r["n"]) * (1 << 20)), r["lowest"]) for r in found]
    rates = df.sparkSession.createDataFrame(told, "lang string, rate long, lowest long")
    place = F.pmod(F.xxhash64("text"), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)).cast("int") + 1
    chosen = rows.join(rates, "lang").where((F.pmod("h", F.lit(1 << 20)) < F.col("rate")) | (F.col("h") == F.col("lowest"))).groupBy("lang", F.xxhash64("text").alias("t")).agg(F.min(F.substr("text", place, F.lit(SAMPLE_CHARS))).alias("text"))
    sample = chosen.orderBy(F.xxhash64("t", "lang"), "lang").limit(2 * each * len(counts)).collect()
    out: dict[str, bytes] = {}
    for lang in sorted(counts):
        out[lang] = b"".join(normal(r["text"]) for r in sample if r["lang"] == lang)[-DICTIONARY_BYTES:]
    return {lang: raw for lang, raw in out.items() if len(raw) >= 8}


def _compressor(raw: bytes):
    import zstandard as z

    settings = z.ZstdCompressionParameters(**SETTINGS, write_content_size=False, write_checksum=False, write_dict_id=False)
    dictionary = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=settings)
    return z.ZstdCompressor(dict_data=dictionary, compression_params=settings)


@lru_cache(maxsize=4)
def _compressors(model: tuple[tuple[str, bytes], ...]) -> list:
    return [_compressor(raw) for _, raw in model]


def classify(text: str | None, model: tuple[tuple[str, bytes], ...]) -> tuple[str, float, bool]:
    """``(language, score, rejected)``; UNKNOWN with score 0 where the text is null, has no letter, or nothing was learned."""
    if text is None or not model or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, True
    data = normal(text)
    sizes = [len(c.compress(data)) for c in _compressors(model)]
    best = min(range(len(sizes)), key=sizes.__getitem__)
    others = [s - sizes[best] for k, s in enumerate(sizes) if k != best]
    score = 1 / (1 + sum(math.exp(-min(d, 700) / 2) for d in others))
    return model[best][0], score, bool(others) and min(others) < NARROW * len(data)


def identify(df: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, lang_pred, score, rejected``.

    Null texts and texts without a letter are ``und`` with score 0 and rejected, as is everything where no
    language was learned. Equal sizes go to the language first in alphabetical order. Repeated rows get equal answers;
    an empty table gives an empty result.
    """
    model = df.sparkSession.sparkContext.broadcast(tuple(sorted(dictionaries.items())))  # DICTIONARY_BYTES a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, rejected = zip(*(classify(t, model.value) for t in batch.column(1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs), pa.array(np.array(scores)), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
