"""Every place of many terms in texts, on the bytes of Arrow columns: a term is found by its prefix and suffix windows, whose widths are powers of two.

A window of up to eight bytes is its own key, a wider one is hashed from its halves and its finds are compared with the term byte by byte. Work grows
with the bytes of the texts and with what is found, not with the number of terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text searched at a time (a row stays whole, its places are searched in such ranges), and rows given out at a time.
RANGE_BYTES, ROWS_OUT = 1 << 20, 1 << 17
_MIX, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8))[at[0] : at[-1]], at - at[0]


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), "<u8", padded, strides=(1,))


def _windows(data: np.ndarray, widths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """The key of the window of each width from each place; those that reach beyond the end are of no use."""
    words = _words(data)
    key = words
    for p in (1 << k for k in range(widths[-1].bit_length())):
        if p > 8:
            high = np.concatenate([key[p // 2 :], np.zeros(min(p // 2, len(key)), np.uint64)])
            key = (key * _MIX + high) * _TURN
            key ^= key >> np.uint64(32)
        if p in widths:
            yield p, key if p >= 8 else words & np.uint64((1 << 8 * p) - 1)


def _look(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each key and whether it is there."""
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _each(first: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of groups that run from first[g] to first[g + 1]: the row and the member, for all members."""
    n = first[group + 1] - first[group]
    row = np.repeat(np.arange(len(group)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[group][row]


class _Width:
    """Terms of at least ``p`` and less than ``2 p`` bytes: by prefix, then length, then suffix."""

    def __init__(self, members: np.ndarray, lengths: np.ndarray, prefix: np.ndarray, suffix: np.ndarray):
        self.prefixes, of = np.unique(prefix, return_inverse=True)
        self.bits = min(24, max(12, int(16 * len(self.prefixes)).bit_length()))
        self.some = np.zeros(1 << self.bits, bool)
        self.some[self._slot(self.prefixes)] = True
        most = int(lengths.max()) + 1
        pairs, of = np.unique(of * most + lengths, return_inverse=True)
        self.lengths, self.first_length = pairs % most, np.searchsorted(pairs // most, np.arange(len(self.prefixes) + 1))
        self.suffixes, end = np.unique(suffix, return_inverse=True)
        key = of * len(self.suffixes) + end
        order = np.argsort(key, kind="stable")
        self.keys, first = np.unique(key[order], return_index=True)
        self.first_term, self.terms = np.append(first, len(order)), members[order]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _MIX >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, p: int, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, term) for places below n; wider windows than eight bytes may err."""
        at = np.flatnonzero(self.some[self._slot(key[:n])])
        prefix, right = _look(self.prefixes, key[at])
        row, pair = _each(self.first_length, prefix[right])
        at, end = at[right][row], at[right][row] + self.lengths[pair] - p
        inside = end < len(key)
        at, pair, end = at[inside], pair[inside], end[inside]
        suffix, right = _look(self.suffixes, key[end])
        at, found = at[right], pair[right] * len(self.suffixes) + suffix[right]
        found, right = _look(self.keys, found)
        row, member = _each(self.first_term, found[right])
        return at[right][row], self.terms[member]


class Index:
    """Distinct pairs of a term (not empty) and a label."""

    def __init__(self, terms: pa.Array, labels: pa.Array):
        coded = terms.dictionary_encode()
        term, distinct = coded.indices.to_numpy(), coded.dictionary
        order = np.argsort(term, kind="stable")
        self.labels = labels.take(pa.array(order))
        self.first_label = np.searchsorted(term[order], np.arange(len(distinct) + 1))
        data, self.starts = _raw(distinct)
        self.data = data.copy()
        self.lengths = np.diff(self.starts)
        self.chars = pc.utf8_length(distinct).to_numpy().astype(np.int64)
        self.widths: dict[int, _Width] = {}
        wide = np.frexp(self.lengths)[1] - 1
        for p, key in _windows(data, sorted(1 << int(k) for k in np.unique(wide))):
            members = np.flatnonzero(wide == p.bit_length() - 1)
            start, length = self.starts[members], self.lengths[members]
            self.widths[p] = _Width(members, length, key[start], key[start + length - p])

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, term): of each term its matches from the left that don't overlap, in each row of bytes."""
        reach, found = int(self.lengths.max()), []
        for low in range(0, len(data), RANGE_BYTES):
            part, n = data[low : low + RANGE_BYTES + reach], min(RANGE_BYTES, len(data) - low)
            for p, key in _windows(part, sorted(self.widths)):
                at, term = self.widths[p].find(p, key, n)
                at = at + low
                row = np.searchsorted(offsets, at, "right") - 1
                inside = at + self.lengths[term] <= offsets[row + 1]
                found.append((row[inside], at[inside], term[inside]))
                if p > 8 and len(found[-1][0]):
                    same = self._same(data, found[-1][1], found[-1][2])
                    found[-1] = tuple(x[same] for x in found[-1])
        if not found:
            return (np.empty(0, np.int64),) * 3
        row, at, term = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((at, term))
        row, at, term = row[order], at[order], term[order]
        keep = self._apart(at, term)
        return row[keep], at[keep], term[keep]

    def _same(self, data: np.ndarray, at: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Whether the bytes at a place are the term's (of eight bytes at least)."""
        here, there, alive = _words(data), _words(self.data), np.arange(len(at))
        last, k = self.lengths[term] - 8, 0
        done = [alive[:0]]
        while len(alive):
            step = np.minimum(k, last[alive])
            alive = alive[here[at[alive] + step] == there[self.starts[term[alive]] + step]]
            ended = last[alive] <= k
            done.append(alive[ended])
            alive, k = alive[~ended], k + 8
        return np.sort(np.concatenate(done))

    def _apart(self, at: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Which matches, by term and place, start at or after the end of the last one kept of their term."""
        keep = np.ones(len(at), bool)
        if len(at) < 2:
            return keep
        close = np.append(False, (term[1:] == term[:-1]) & (at[1:] - at[:-1] < self.lengths[term[1:]]))
        end, before = 0, -1
        for i in np.flatnonzero(close).tolist():
            if before != i - 1:
                end = at[i - 1] + self.lengths[term[i]]
            if at[i] >= end:
                end = at[i] + self.lengths[term[i]]
            else:
                keep[i] = False
            before = i
        return keep


def _first_bytes(data: np.ndarray) -> np.ndarray:
    return (data & 0xC0) != 0x80


def search(index: Index, ident: pa.Array, texts: pa.Array, lows: pa.Array, names: list[str]) -> Iterator[pa.RecordBatch]:
    """(ident, text, label, start, end) of all matches in ``lows``; the text is cut from ``texts`` at the same characters."""
    if not len(ident):
        return
    size, low = _raw(lows)[1], 0
    while low < len(ident):
        high = max(low + 1, int(np.searchsorted(size, size[low] + RANGE_BYTES, "right")) - 1)
        data, offsets = _raw(lows[low:high])
        row, at, term = index.find(data, offsets)
        before = np.append(0, np.cumsum(_first_bytes(data)))
        start = before[at] - before[offsets[row]]
        end = start + index.chars[term]
        shown, bounds = _raw(texts[low:high])
        places = np.append(np.flatnonzero(_first_bytes(shown)), len(shown))
        first = np.searchsorted(places, bounds)
        cut = [places[np.minimum(first[row] + x, first[row + 1])] for x in (start, end)]
        pick, label = _each(index.first_label, term)
        for i in range(0, len(pick), ROWS_OUT):
            some = pick[i : i + ROWS_OUT]
            begin, n = cut[0][some], cut[1][some] - cut[0][some]
            ends = np.append(0, np.cumsum(n))
            letters = shown[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], n)]
            text = pa.Array.from_buffers(pa.string(), len(some), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(letters)])
            columns = [ident.take(pa.array(row[some] + low)), text, index.labels.take(pa.array(label[i : i + ROWS_OUT])), pa.array(start[some].astype(np.int32)), pa.array(end[some].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names)
        low = high
