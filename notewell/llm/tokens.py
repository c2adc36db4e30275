"""Token ids of the public byte-level BPE vocabulary for whole text columns.

Ids are those that the ``tokenizers`` library gives by ``encode(text, add_special_tokens=False)`` at its defaults, so the vocabulary's added token
``<|endoftext|>`` is one id wherever a text spells it out.

Text is cut before every space that a visible character follows: the vocabulary's pattern always starts a new piece there, and the added token
holds no space, so ids of the parts, joined, are the ids of the whole. Equal parts are encoded once for each worker, which makes the repeated
words of a corpus cheap.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .bytewords import Hashes, blocks

#: Parts kept by a worker; beyond it the store is emptied. It decides speed only, never ids.
MOST_KEPT = 1_500_000

#: The vocabulary's added token and its id.
ADDED = {"<|endoftext|>": 50256}

#: Bytes that may follow a cut: not ASCII white space, and not the first byte of a longer white-space character.
_GOES_ON = np.ones(256, bool)
_GOES_ON[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0xC2, 0xE1, 0xE2, 0xE3]] = False


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the parts of a block, and for each row (and the end) the number of parts before it."""
    cut = np.zeros(len(data), bool)
    cut[:-1] = (data[:-1] == 0x20) & _GOES_ON[data[1:]]
    edge = offsets[:-1][offsets[1:] > offsets[:-1]]
    cut[edge] = True
    inner = offsets[1:-1]
    last = inner[(inner > 0) & (inner < len(data))] - 1  # a space that ends a text is followed by another text's first byte
    cut[last[~np.isin(last, edge)]] = False
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(data))
    return starts, ends, Hashes(data).of(starts, ends), np.searchsorted(starts, offsets)


class Vocabulary:
    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)
        self.n_bytes = np.zeros(max(*ranks.values(), *ADDED.values()) + 1, np.int64)
        for piece, i in ranks.items():
            self.n_bytes[i] = len(piece)
        for piece, i in ADDED.items():
            self.n_bytes[i] = len(piece.encode())
        self.forget()

    def forget(self) -> None:
        self.known = np.empty(0, np.uint64)  # hashes, ascending, with the place of each one's ids
        self.start = np.empty(0, np.int64)
        self.length = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint16)

    def _learn(self, fresh: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Parts that begin with a space are joined and encoded in one call: the cuts between them stay cuts. Token lengths give them back."""
        spaced = data[starts] == 0x20
        raw = data.tobytes()
        length, flat = np.zeros(len(fresh), np.int64), []
        order = np.concatenate([np.flatnonzero(spaced), np.flatnonzero(~spaced)])
        n_spaced = int(spaced.sum())
        if n_spaced:
            own = order[:n_spaced]
            joined = b"".join([raw[s:e] for s, e in zip(starts[own].tolist(), ends[own].tolist())])
            ids = self.encoding.encode_to_numpy(joined.decode("utf-8", "replace"), allowed_special="all")
            reach = np.concatenate([[0], np.cumsum(self.n_bytes[ids])])
            at = np.searchsorted(reach, np.concatenate([[0], np.cumsum(ends[own] - starts[own])]))
            length[own] = np.diff(at)
            flat.append(ids.astype(np.uint16))
        for k in order[n_spaced:].tolist():
            ids = self.encoding.encode(raw[starts[k] : ends[k]].decode("utf-8", "replace"), allowed_special="all")
            length[k] = len(ids)
            flat.append(np.asarray(ids, np.uint16))
        place = np.empty(len(fresh), np.int64)
        place[order] = len(self.ids) + np.cumsum(length[order]) - length[order]
        merged = np.argsort(np.concatenate([self.known, fresh]), kind="stable")
        self.known = np.concatenate([self.known, fresh])[merged]
        self.start = np.concatenate([self.start, place])[merged]
        self.length = np.concatenate([self.length, length])[merged]
        self.ids = np.concatenate([self.ids, *flat])

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row + 1, ids of these rows one after the other, offsets of the rows within them)."""
        for a, b, ids, places, _, _ in self.encode_parts(column):
            yield a, b, ids, places

    def encode_parts(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """As encode(), with the hashes of the parts and the offsets of the rows within those."""
        for a, b, data, offsets in blocks(column):
            if not len(data):
                yield a, b, np.empty(0, np.uint16), np.zeros(b - a + 1, np.int64), np.empty(0, np.uint64), np.zeros(b - a + 1, np.int64)
                continue
            starts, ends, hashes, rows = parts(data, offsets)
            unique, first, which = np.unique(hashes, return_index=True, return_inverse=True)
            if len(self.known) + len(unique) > MOST_KEPT:
                self.forget()
            at = np.searchsorted(self.known, unique)
            missing = np.ones(len(unique), bool)
            inside = at < len(self.known)
            missing[inside] = self.known[at[inside]] != unique[inside]
            if missing.any():
                lost = first[missing]
                self._learn(unique[missing], data, starts[lost], ends[lost])
                at = np.searchsorted(self.known, unique)
            at = at[which]
            length = self.length[at]
            reach = np.cumsum(length)
            ids = self.ids[np.repeat(self.start[at] - (reach - length), length) + np.arange(int(reach[-1]))]
            before = np.concatenate([[0], reach])
            yield a, b, ids, before[rows], hashes, rows


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
