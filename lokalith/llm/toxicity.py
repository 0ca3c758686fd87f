"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. As in zstandard's own trainer each
is made of segments of its class's text, picked by the weight of the short strings (``GRAM`` characters) they cover.
Weight is the G statistic by which a string sets rows of the class apart from the other rows of its language, in
being there and in being there twice; both classes are held to one threshold. Segments may be words, parts of words or
several words, whatever stands out by itself. A text is compressed whole, in windows of ``WINDOW`` words, with both
dictionaries. What the toxic one saves over the ordinary one, less an allowance a word, is the text's gain. The
least length of a match, the allowance and a monotone calibration of the gain, a lower bound of the share of toxic
rows, are learned by cross-validation: on training rows scored with dictionaries of the other folds.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from math import log, sqrt
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lokalith.llm.shared import text_of

#: Bound of the training sample: about so many rows of each class, at most twice as many, so many characters of each.
SAMPLE_ROWS, SAMPLE_CHARS = 1500, 20_000
WINDOW, GRAM = 4, 5
#: Least lengths of a match that are tried, and the other settings of the compressor, fixed so that they do not follow input sizes.
LEAST_MATCH = (5, 6)
#: A longer one, which sees less, must be better by so much F1.
MARGIN = 0.015
SETTINGS = {"window_log": 17, "hash_log": 15, "chain_log": 15, "search_log": 4, "target_length": 999, "strategy": 7}
#: A string counts from so many rows and so large a G statistic on, and from such a part of its language's largest.
LEAST_ROWS, LEAST_G, PART = 3, 30.0, 0.2
#: A segment ends where the weight falls below such a part of its peak.
SLOPE = 1 / 3
#: Segments of a language and class at most.
SEGMENTS = 256
FOLDS = 5
#: Standard errors that a score lies below the share of its step.
ERRORS = 2.0
CARRIER = b"#0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ#"
_BETWEEN = re.compile(r"[\W_]+")

#: Toxic and ordinary dictionary, least match, allowance a word, steps of the gain, shares of toxic rows.
Model = tuple[bytes, bytes, int, float, tuple[int, ...], tuple[float, ...]]
#: Text, language, toxic.
Row = tuple[str, str, int]


def normal(text: str) -> str:
    """Letters and digits of the whole text in lower case; whatever lies between them is one space."""
    return f" {_BETWEEN.sub(' ', text.lower()).strip()} "


def _g(a: int, n: int, b: int, m: int) -> float:
    """G statistic of ``a`` of ``n`` rows of a class against ``b`` of ``m`` others; negative where it is the rarer there."""
    share = (a + b) / (n + m)
    g = 2 * sum(x * log(x / k / p) for x, k, p in ((a, n, share), (n - a, n, 1 - share), (b, m, share), (m - b, m, 1 - share)) if x)
    return g if a * m > b * n else -g


class Counts:
    """Rows of one class that hold each string once or more, and twice or more."""

    def __init__(self, texts: list[str] = ()):
        self.rows, self.once, self.twice = len(texts), Counter(), Counter()
        for text in texts:
            own = Counter(text[i : i + GRAM] for i in range(len(text) - GRAM + 1))
            self.once.update(own.keys())
            self.twice.update(s for s, n in own.items() if n > 1)

    def less(self, other: Counts) -> Counts:
        out = Counts()
        out.rows, out.once, out.twice = self.rows - other.rows, self.once.copy(), self.twice.copy()
        out.once.subtract(other.once)
        out.twice.subtract(other.twice)
        return out

    @staticmethod
    def total(parts: list[Counts]) -> Counts:
        out = Counts()
        for part in parts:
            out.rows += part.rows
            out.once.update(part.once)
            out.twice.update(part.twice)
        return out


def weights(own: Counts, other: Counts) -> dict[str, float]:
    """Strings that set rows of a class apart, with both G statistics added up."""
    if not own.rows or not other.rows:
        return {}
    n, m, found = own.rows, other.rows, {}
    for s, a in own.once.items():
        if a >= LEAST_ROWS and a * m > other.once[s] * n:
            g = _g(a, n, other.once[s], m) + _g(own.twice[s], n, other.twice[s], m)
            if g >= LEAST_G:
                found[s] = g
    return found


def cuts(text: str, weight: dict[str, float]) -> list[str]:
    """Stretches of a text around each peak of the weight, none overlapping another."""
    v, out = [weight.get(text[i : i + GRAM], 0.0) for i in range(len(text) - GRAM + 1)], []
    for start in (i for i in range(len(v)) if v[i] and not (i and v[i - 1])):
        stop = start
        while stop + 1 < len(v) and v[stop + 1]:
            stop += 1
        spans = [(start, stop)]
        while spans:
            a, b = spans.pop()
            if a > b:
                continue
            x = y = max(range(a, b + 1), key=v.__getitem__)
            top = SLOPE * v[x]
            while x > a and v[x - 1] >= top:
                x -= 1
            while y < b and v[y + 1] >= top:
                y += 1
            out.append(text[x : y + GRAM])
            spans += [(a, x - GRAM), (y + GRAM, b)]
    return out


def segments(own: list[str], other: list[str], weight: dict[str, float]) -> list[str]:
    """Stretches that set rows of a class apart as they stand, the ones that do so most first.

    A stretch is judged by where it is cut out itself: one that is frequent only inside a stronger one is not taken.
    """
    if not weight:
        return []
    counts = [[Counter(), Counter()], [Counter(), Counter()]]
    for side, texts in enumerate((own, other)):
        for text in texts:
            found = Counter(cuts(text, weight))
            counts[side][0].update(found.keys())
            counts[side][1].update(s for s, n in found.items() if n > 1)
    n, m, left, picked = len(own), len(other), dict(weight), []
    apart = {s: sum(_g(counts[0][k][s], n, counts[1][k][s], m) for k in (0, 1)) for s, a in counts[0][0].items() if a >= LEAST_ROWS}
    for s in sorted((s for s, g in apart.items() if g >= LEAST_G), key=lambda s: (-apart[s], s)):
        parts = [s[i : i + GRAM] for i in range(len(s) - GRAM + 1)]
        if len(picked) < SEGMENTS and sum(left.get(x, 0.0) for x in parts) >= LEAST_G:
            picked.append(s)
            left.update((x, 0.0) for x in parts)
    return picked


def _pair(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """Both dictionaries, of one length, so that what follows the segments lies at the same distance."""
    raw = ["".join(found[::-1]).encode() for found in (toxic, ordinary)]
    size = max(map(len, raw))
    return tuple(x.rjust(size) + b" " + CARRIER for x in raw)


class Trainer:
    """Counts of each language, class and fold, so that each fold's dictionaries cost no further pass over the texts."""

    def __init__(self, rows: list[Row]):
        self.rows = [(normal(t), lang, y, crc32(t.encode("utf-8", "surrogatepass")) % FOLDS) for t, lang, y in rows]
        self.langs = sorted({lang for _, lang, _ in rows})
        self.parts = {(lang, y, k): Counts(self.texts(lang, y, [k])) for lang in self.langs for y in (0, 1) for k in range(FOLDS)}
        self.all = {(lang, y): Counts.total([self.parts[lang, y, k] for k in range(FOLDS)]) for lang in self.langs for y in (0, 1)}

    def texts(self, lang: str, toxic: int, folds: list[int]) -> list[str]:
        return [t for t, x, y, k in self.rows if x == lang and y == toxic and k in folds]

    def dictionaries(self, without: int | None = None) -> tuple[bytes, bytes]:
        """Toxic and ordinary dictionary of all folds, or of all but one."""
        folds, found = [k for k in range(FOLDS) if k != without], ([], [])
        for lang in self.langs:
            counts = [self.all[lang, y] if without is None else self.all[lang, y].less(self.parts[lang, y, without]) for y in (1, 0)]
            both = weights(*counts), weights(*counts[::-1])
            least = PART * max((g for weight in both for g in weight.values()), default=0.0)
            for k, weight in enumerate(both):
                own, other = self.texts(lang, 1 - k, folds), self.texts(lang, k, folds)
                found[k].extend(segments(own, other, {s: g for s, g in weight.items() if g >= least}))
        return _pair(*found)


def _compressor(raw: bytes, least: int):
    import zstandard as z

    settings = z.ZstdCompressionParameters(**SETTINGS, min_match=least, write_content_size=False, write_checksum=False, write_dict_id=False)
    dictionary = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=settings)
    return z.ZstdCompressor(dict_data=dictionary, compression_params=settings)


class Scorer:
    def __init__(self, toxic: bytes, ordinary: bytes, least: int = LEAST_MATCH[0], allowance: float = 0.0):
        self.toxic, self.ordinary, self.allowance = _compressor(toxic, least), _compressor(ordinary, least), allowance

    def saved(self, text: str | None) -> tuple[int, int]:
        """Bytes that the toxic dictionary saves over all windows, and the number of words."""
        words = normal(text or "").encode().split()
        windows = (CARRIER + b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, len(words), WINDOW))
        return sum(len(self.ordinary.compress(x)) - len(self.toxic.compress(x)) for x in windows), len(words)

    def gain(self, text: str | None) -> int:
        """Tenths of a byte."""
        return net(*self.saved(text), self.allowance)


def net(saved: int, words: int, allowance: float) -> int:
    return round(10 * (saved - allowance * words))


@lru_cache(maxsize=4)
def scorer(toxic: bytes, ordinary: bytes, least: int, allowance: float) -> Scorer:
    return Scorer(toxic, ordinary, least, allowance)


def best_f1(gains: list[int], marks: list[int], weight: tuple[float, float]) -> float:
    """Largest F1 of any threshold; rows of class ``y`` weigh ``weight[y]``."""
    best, hits, n, total = 0.0, 0.0, 0.0, weight[1] * sum(marks)
    for _, y in sorted(zip(gains, marks, strict=True), key=lambda x: (-x[0], x[1])):
        n, hits = n + weight[y], hits + weight[y] * y
        best = max(best, 2 * hits / (n + total))
    return best


def calibrate(gains: list[int], toxic: list[int], weight: tuple[float, float] = (1.0, 1.0)) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """Steps ``(gain, lower bound of the share of toxic rows from there on)``, not falling, by pooling adjacent violators."""
    counts: dict[int, list[int]] = {}
    for g, y in zip(gains, toxic, strict=True):
        counts.setdefault(g, [0, 0])[y] += 1
    pools: list[list[float]] = []  # gain, toxic weight, weight, rows
    for g in sorted(counts):
        a, b = counts[g]
        pools.append([g, weight[1] * b + 0.1, weight[0] * a + weight[1] * b + 0.5, a + b + 0.5])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            _, h, n, rows = pools.pop()
            pools[-1] = [pools[-1][0], pools[-1][1] + h, pools[-1][2] + n, pools[-1][3] + rows]
    shares = [(h / n, rows) for _, h, n, rows in pools]
    return tuple(int(p[0]) for p in pools), tuple(accumulate((max(0.0, x - ERRORS * sqrt(x * (1 - x) / n)) for x, n in shares), max))


def fit(rows: list[Row], weight: tuple[float, float] = (1.0, 1.0)) -> Model | None:
    """Dictionaries, allowance and calibration; ``weight`` is by which each class of the sample counts. None where a class is missing."""
    if len({y for _, _, y in rows}) < 2:
        return None
    trainer, best = Trainer(rows), None
    pairs = [trainer.dictionaries(without=k) for k in range(FOLDS)]
    marks = [y for _, _, y, _ in trainer.rows]
    for least in LEAST_MATCH:
        judges = [Scorer(*pair, least) for pair in pairs]
        saved = [judges[k].saved(text) for text, _, _, k in trainer.rows]
        mean = [sum(s for (s, _), y in zip(saved, marks, strict=True) if y == k) / max(1, sum(n for (_, n), y in zip(saved, marks, strict=True) if y == k)) for k in (0, 1)]
        for allowance in (mean[0] + part * (mean[1] - mean[0]) for part in (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6)):
            gains = [net(s, n, allowance) for s, n in saved]
            found = best_f1(gains, marks, weight) - MARGIN * (least - LEAST_MATCH[0]), least, allowance, gains
            best = found if best is None or found[0] > best[0] else best
    _, least, allowance, gains = best
    return (*trainer.dictionaries(), least, allowance, *calibrate(gains, marks, weight))


def learn(df: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang") -> Model | None:
    """Dictionaries and calibration from the labelled rows of ``df`` where ``usable``; None where a class is missing.

    The sample of labels is bounded: SAMPLE_ROWS a class by hash of the id at a rate from the counts over all labels,
    which is what is broadcast, and of what joins, equal texts being one, the 4 * SAMPLE_ROWS first by hash of the
    text, so that ids that repeat do not grow it. Of a text longer than SAMPLE_CHARS a stretch of that length at a
    place that its hash decides is learned from. Null ids and labels are not used; without ``lang_col`` all rows are of one language.
    The language is a stratum of the training rows only; scores do not read it.
    """
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).where(usable).groupBy(F.col(id_col).alias("i")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    rate = F.when(F.col("y") == 1, F.lit(int(min(1.0, SAMPLE_ROWS / counts[1]) * (1 << 20)))).otherwise(F.lit(int(min(1.0, SAMPLE_ROWS / counts[0]) * (1 << 20))))
    chosen = marked.where(F.pmod(F.xxhash64("i"), F.lit(1 << 20)) < rate)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col in df.columns else F.lit("")
    text = text_of(text_col)
    place = F.pmod(F.xxhash64(text), F.greatest(F.lit(1), F.length(text) - SAMPLE_CHARS + 1)).cast("int") + 1
    slices = df.select(F.col(id_col).alias("i"), F.xxhash64(text).alias("h"), F.substr(text, place, F.lit(SAMPLE_CHARS)).alias("text"), lang.alias("lang"))
    joined = slices.join(F.broadcast(chosen), "i").groupBy("h").agg(F.max("y").alias("y"), F.min("text").alias("text"), F.min("lang").alias("lang"))
    rows = joined.orderBy(F.xxhash64("h"), "h").limit(4 * SAMPLE_ROWS).collect()
    sample: list[Row] = [(r["text"], r["lang"], r["y"]) for r in rows]  # in the order of a hash
    sizes = Counter(y for _, _, y in sample)
    if len(sizes) < 2:
        return None
    return fit(sample, (counts[0] / sizes[0], counts[1] / sizes[1]))


def score(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per input row: ``doc_id, gain, score, predicted``.

    Null and empty texts have gain 0. Without a model every score is 0. Repeated rows get equal answers; an
    empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # a few hundred segments a language at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared.value is None:
                gains, scores = np.zeros(batch.num_rows, dtype=np.int32), np.zeros(batch.num_rows)
            else:
                *judged, steps, shares = shared.value
                judge = scorer(*judged)
                gains = np.array([judge.gain(t.as_py()) for t in batch.column(1)], dtype=np.int32)
                scores = np.array([shares[max(0, bisect_right(steps, g) - 1)] for g in gains.tolist()], dtype=np.float64)
            columns = [batch.column(0), pa.array(gains), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "gain", "score", "predicted"])

    rows = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, gain int, score double, predicted int")


def drop_toxic(df: DataFrame, model: Model | None, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``df`` that score below ``threshold``, with all columns; one pass, no shuffle.

    Only the text goes to Python. Null and empty texts stay, as their gain is 0, unless the calibration puts even that at the
    threshold; without a model all rows stay. Repeated rows are kept or dropped together; an empty table stays empty.
    """
    if model is None:
        return df
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        *judged, steps, shares = shared.value
        judge = scorer(*judged)
        return pa.array([shares[max(0, bisect_right(steps, judge.gain(t.as_py())) - 1)] < threshold for t in texts], pa.bool_())

    return df.where(clean(text_of(text_col)))
