"""Token counts of sections, from one encoding of each whole document.

A document is encoded once; its tokens' character spans are joined to the spans of
its sections. A token that crosses a boundary is counted by a stated rule.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.bpe import default_tokenizer, encoder, token_spans
from chronoweave.llm.common import column_of, map_arrow, texts_of

#: first: the section of the token's first character. largest: the section with most of
#: its characters, the earlier on a tie. shared: each section by its part of the characters.
RULES = ("first", "largest", "shared")
ENCODE_ROWS = 256

SCHEMA = "doc_id long, section long, first_char long, end_char long, n_tokens double, n_crossing long, doc_tokens long"


def line_sections(text: str) -> np.ndarray:
    """First characters of the sections of a text: its lines, line breaks included."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.flatnonzero(points == 10) + 1
    return np.concatenate([[0], starts[starts < len(points)]])


def attribute(first: np.ndarray, end: np.ndarray, starts: np.ndarray, length: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and crossing tokens of each section.

    first, end: spans of the tokens, in order. starts: first characters of the
    sections, ascending, the first 0; they reach to the next start, the last to length.
    """
    n = len(starts)
    a = np.searchsorted(starts, first, "right") - 1
    b = np.searchsorted(starts, end - 1, "right") - 1
    crossing = np.flatnonzero(b > a)
    if rule == "first" or not len(crossing):
        counts = np.bincount(a, minlength=n).astype(np.float64)
    else:
        counts = np.bincount(a[b == a], minlength=n).astype(np.float64)
    crossed = np.zeros(n, np.int64)
    bounds = np.append(starts, length)
    for t in crossing.tolist():
        sections = np.arange(a[t], b[t] + 1)
        crossed[sections] += 1
        if rule != "first":
            part = np.minimum(bounds[sections + 1], end[t]) - np.maximum(bounds[sections], first[t])
            if rule == "largest":
                counts[sections[int(np.argmax(part))]] += 1
            else:
                counts[sections] += part / part.sum()
    return counts, crossed


def section_token_counts(docs: DataFrame, tokenizer: str | None = None, rule: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each line of each whole text, and of the document.

    A row per section, numbered from 0; n_tokens of a document's sections add up to
    doc_tokens. n_crossing counts tokens that lie in this section and another. Null and
    empty texts have one section without tokens. Repeated rows and ids give repeated
    rows; null ids stay null; other columns, of any name, are not read.
    Row by row, no shuffle.
    """
    if rule not in RULES:
        raise ValueError(f"rule {rule!r}: one of {', '.join(RULES)}")
    tokenizer = tokenizer or default_tokenizer()

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc, texts = encoder(tokenizer), texts_of(batch)
        out: list[list[np.ndarray]] = [[] for _ in range(6)]
        repeats = []
        for k in range(0, len(texts), ENCODE_ROWS):
            some = texts[k : k + ENCODE_ROWS]
            for text, data in zip(some, enc.encode(some), strict=True):
                ids = np.frombuffer(data, enc.dtype)
                starts = line_sections(text)
                n = len(starts)
                first, end = token_spans(ids, text, enc.id_bytes) if len(ids) else (np.empty(0, np.int64),) * 2
                counts, crossed = attribute(first, end, starts, len(text), rule)
                repeats.append(n)
                for column, values in zip(out, (np.arange(n), starts, np.append(starts[1:], len(text)), counts, crossed, np.full(n, len(ids))), strict=True):
                    column.append(values)
        rows = np.repeat(np.arange(len(texts)), repeats)
        kinds = [np.int64, np.int64, np.int64, np.float64, np.int64, np.int64]
        return pa.record_batch([column_of(batch, "doc_id").take(pa.array(rows)), *(pa.array(np.concatenate(c).astype(t)) for c, t in zip(out, kinds, strict=True))], ["doc_id", "section", "first_char", "end_char", "n_tokens", "n_crossing", "doc_tokens"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), count, SCHEMA)
