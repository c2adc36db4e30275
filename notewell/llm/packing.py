"""Packing along a space-filling curve.

Each document becomes a hashed bag-of-words vector, which a fixed random projection takes to a few dimensions. Its place on the Hilbert curve
through that space is its sort key; documents are range-partitioned by key, and each range is laid out as one run of tokens that is cut every
``capacity`` tokens. Neighbours on the curve share sequences, and only the last sequence of a range is not full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import blocks
from .runtime import cut, prepare, text_bytes, weighted_splitters
from .tokens import default_vocabulary, parts, vocabulary

BINS, DIMS, BITS = 256, 3, 10
#: Text bytes meant for one range, and the most ranges (the driver holds one splitter for each).
RANGE_BYTES, MOST_RANGES = 1 << 20, 65536
END_ID = 0

_PROJECTION = np.random.default_rng(1891).normal(size=(BINS, DIMS)) * 1.0


def hilbert_index(x: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with integer coordinates of ``bits`` bits (rows of x), by J. Skilling's published transform."""
    x = x.astype(np.int64).copy()
    dims = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            flip = (x[:, i] & q) != 0
            swap = np.where(flip, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(flip, low, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[:, -1] & q, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def curve_keys(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Curve places of the documents of a block, from the hashes of their words."""
    n = len(rows) - 1
    owner = np.repeat(np.arange(n), np.diff(rows))
    tf = np.bincount(owner * BINS + (hashes >> np.uint64(56)).astype(np.int64), minlength=n * BINS).reshape(n, BINS)
    v = np.log1p(tf)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    spread = (v - 1 / np.sqrt(BINS)) @ _PROJECTION
    unit = 1 / (1 + np.exp(-4 * spread))
    return hilbert_index(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def pack(docs: DataFrame, capacity: int = 1024, ident: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per piece: ident, start, length, ids (binary: little-endian unsigned 32-bit ids), doc_tokens, sequence_id, offset.

    Each document is its text's ids and END_ID; a null text counts as an empty one, so it has one piece of one id. Pieces of a document lie in
    consecutive sequences; every id lies in exactly one piece. Copies have one curve place and are told apart by ident; repeated rows are packed
    each. Other columns are ignored; an empty table gives no rows. Ids must be below 65536.
    """
    spark = prepare(docs.sparkSession)
    path = path or default_vocabulary()
    kind = dict(docs.dtypes)[ident]
    read = docs.select(F.col(ident).alias("_id"), F.col(text).alias("_text"), F.pmod(F.xxhash64(F.col(ident)), F.lit(1 << 31)).alias("_deal"), text_bytes(F.col(text)).alias("_size"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            place = np.zeros(x.num_rows, np.int64)
            for a, b, data, offsets in blocks(x.column(1)):
                _, _, hashes, rows = parts(data, offsets) if len(data) else (0, 0, np.empty(0, np.uint64), np.zeros(b - a + 1, np.int64))
                place[a:b] = curve_keys(hashes, rows)
            yield pa.RecordBatch.from_arrays([x.column(2), pa.array(place << 31 | x.column(2).to_numpy()), pa.array(x.column(3).to_numpy() + 1)], ["_deal", "_key", "_size"])

    slim = cut(read.mapInArrow(keys, "_deal long, _key long, _size long"))
    total = slim.agg(F.sum("_size")).first()[0] or 0
    splitters = weighted_splitters(slim, "_key", "_size", "_deal", int(min(MOST_RANGES, 1 + total // RANGE_BYTES)), float(total))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for x in batches:
            deal = x.column(2).to_numpy()
            for a, b, ids, places, hashes, rows in vocab.encode_parts(x.column(1)):
                key = curve_keys(hashes, rows) << 31 | deal[a:b]
                raw = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((places * 2).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))])
                yield pa.RecordBatch.from_arrays([x.column(0).slice(a, b - a), pa.array(np.searchsorted(splitters, key, "right").astype(np.int64)), pa.array(key), raw.cast(pa.binary())], ["_id", "_range", "_key", "_ids"])

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, here = 0, None
        for x in batches:
            ranges = x.column(1).to_numpy()
            out: list[list] = [[] for _ in range(7)]
            for k, raw in enumerate(x.column(3)):
                if ranges[k] != here:
                    here, at = ranges[k], 0
                ids = np.append(np.frombuffer(raw.as_buffer(), np.uint16), END_ID).astype("<u4")
                n, start = len(ids), 0
                while start < n:
                    offset = at % capacity
                    length = min(n - start, capacity - offset)
                    for column, v in zip(out, (k, start, length, ids[start : start + length].tobytes(), n, int(here) << 36 | at // capacity, offset)):
                        column.append(v)
                    start, at = start + length, at + length
            yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(out[0], pa.int64())), *(pa.array(c, t) for c, t in zip(out[1:], (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())))], [ident, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    dealt = read.mapInArrow(encode, f"_id {kind}, _range long, _key long, _ids binary").repartition("_range").sortWithinPartitions("_range", "_key", "_id")
    return dealt.mapInArrow(lay, f"`{ident}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
