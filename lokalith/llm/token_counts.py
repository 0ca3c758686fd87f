"""Token counts by section from one encoding of the whole document.

The document is encoded once, with character offsets; the spans of its tokens are interval-joined to the spans of
its sections by binary search over the sections' starts. The rule for tokens at a boundary: a token belongs to the section
that holds most of its characters, the earlier one at a tie; a token that touches no section (a separator)
belongs to the nearest section before it, or to the first one. So the counts of a document add up to its tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lokalith.llm.shared import text_of
from lokalith.llm.tokens import encoder


def line_sections(text: str) -> list[tuple[int, int]]:
    """Character spans of the lines of a text, without their newlines; an empty text has one empty section."""
    spans, at = [], 0
    for line in text.split("\n"):
        spans.append((at, at + len(line)))
        at += len(line) + 1
    return spans


def attribute(spans: np.ndarray, sections: np.ndarray) -> np.ndarray:
    """Section of each token span; both arrays hold ``(start, end)``, sections ascending and disjoint."""
    starts, ends = sections[:, 0], sections[:, 1]
    first = np.clip(np.searchsorted(starts, spans[:, 0], side="right") - 1, 0, None)
    last = np.clip(np.searchsorted(starts, np.maximum(spans[:, 1] - 1, spans[:, 0]), side="right") - 1, first, None)
    best, most = first.copy(), np.zeros(len(spans), dtype=np.int64)
    for step in range(int((last - first).max(initial=0)) + 1):
        at = np.minimum(first + step, last)
        overlap = np.minimum(spans[:, 1], ends[at]) - np.maximum(spans[:, 0], starts[at])
        better = overlap > most
        best[better], most[better] = at[better], overlap[better]
    return best


def section_counts(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", sections=line_sections, batch: int = 256) -> DataFrame:
    """One row per section: ``doc_id, section, start_char, end_char, n_tokens, doc_tokens``.

    ``sections`` gives ascending disjoint character spans of a text (at least one). Null texts are empty: one
    section, no token. Repeated rows and null ids are returned as they come; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for rows in batches:
            for k in range(0, rows.num_rows, batch):
                part = rows.slice(k, batch)
                texts = part.column(1).to_pylist()
                source, number, start, end, count, total = [], [], [], [], [], []
                for j, (text, spans) in enumerate(zip(texts, enc.spans_many(texts), strict=True)):
                    cuts = np.array(sections(text), dtype=np.int64).reshape(-1, 2)
                    source += [j] * len(cuts)
                    number += range(len(cuts))
                    start += cuts[:, 0].tolist()
                    end += cuts[:, 1].tolist()
                    count += np.bincount(attribute(spans, cuts), minlength=len(cuts)).tolist()
                    total += [len(spans)] * len(cuts)
                ids = part.column(0).take(pa.array(source, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, end, count, total))],
                    names=["doc_id", "section", "start_char", "end_char", "n_tokens", "doc_tokens"],
                )

    rows = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, section int, start_char long, end_char long, n_tokens long, doc_tokens long")
