"""Token counts by offset-mapped attribution.

Each document is encoded once, as a whole. Token spans follow from the tokens' byte lengths and are interval-joined to the sections of the
document, so a token that crosses a boundary is counted by an explicit rule and never twice:

``first``   the section that holds the token's first byte (the default)
``middle``  the section that holds the token's middle byte (of two, the earlier)
``share``   each section by the share of the token's bytes that it holds
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare
from .tokens import default_vocabulary, vocabulary

RULES = ("first", "middle", "share")


def count_within(starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each interval [a, b) under a rule; token spans are ascending and touch each other. Intervals may overlap or leave gaps."""
    if rule == "share":
        edges = np.append(starts, ends[-1:])
        if not len(edges):
            return np.zeros(len(a))
        return np.interp(b, edges, np.arange(len(edges), dtype=float)) - np.interp(a, edges, np.arange(len(edges), dtype=float))
    at = starts if rule == "first" else (starts + ends - 1) // 2
    return (np.searchsorted(at, b) - np.searchsorted(at, a)).astype(float)


def attribute_tokens(docs: DataFrame, ident: str = "doc_id", text: str = "text", sections: str | None = None, rule: str = "first", path: str | None = None) -> DataFrame:
    """One row per section: ident, section (its number from 0), name, char_start, char_end, n_tokens (double), doc_tokens.

    ``sections`` names a column array<struct<name:string,start:int,end:int>> of half-open character spans. Without it the sections are the
    text's lines, each with its line feed, so their counts add up to doc_tokens. Null and empty texts have one empty section of no tokens;
    a null or empty list gives no rows; spans are clipped to the text. Other columns are ignored; an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    prepare(docs.sparkSession)
    path = path or default_vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for x in batches:
            texts = x.column(1)
            for a, b, ids, places in vocab.encode(texts):
                row, number, name, lo, hi, got, whole = [], [], [], [], [], [], []
                for k in range(b - a):
                    raw = np.frombuffer((texts[a + k].as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
                    ends = np.cumsum(vocab.n_bytes[ids[places[k] : places[k + 1]]])
                    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
                    char_at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # byte of each character
                    if sections is None:
                        feeds = np.flatnonzero(raw == 10) + 1
                        s = np.concatenate([[0], feeds[feeds < len(raw)]]).astype(np.int64)
                        e = np.append(s[1:], len(raw))
                        cs, ce = np.searchsorted(char_at, s), np.searchsorted(char_at, e)
                        names = [None] * len(s)
                    else:
                        own = [v for v in x.column(2)[a + k].as_py() or [] if v is not None]
                        top = len(char_at) - 1
                        cs = np.array([min(max(v["start"] or 0, 0), top) for v in own], np.int64)
                        ce = np.maximum(np.array([min(top if v["end"] is None else v["end"], top) for v in own], np.int64), cs)
                        s, e = char_at[cs], char_at[ce]
                        names = [v["name"] for v in own]
                    row += [a + k] * len(s)
                    number.append(np.arange(len(s)))
                    name += names
                    lo.append(cs)
                    hi.append(ce)
                    got.append(count_within(starts, ends, s, e, rule))
                    whole.append(np.full(len(s), len(ends)))
                flat = lambda v, t: np.concatenate(v).astype(t) if v else np.empty(0, t)
                yield pa.RecordBatch.from_arrays(
                    [x.column(0).take(pa.array(row, pa.int64())), pa.array(flat(number, np.int32)), pa.array(name, pa.string()), *(pa.array(flat(v, np.int64)) for v in (lo, hi)), pa.array(flat(got, np.float64)), pa.array(flat(whole, np.int64))],
                    [ident, "section", "name", "char_start", "char_end", "n_tokens", "doc_tokens"],
                )

    kind = dict(docs.dtypes)[ident]
    return docs.select(ident, F.col(text), *([sections] if sections else [])).mapInArrow(count, f"`{ident}` {kind}, section int, name string, char_start long, char_end long, n_tokens double, doc_tokens long")
