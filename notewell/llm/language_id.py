"""Language identification by segmentation-marginalised unigrams.

For each language every piece of a fixed public vocabulary has a probability. A word's likelihood is the sum, over all ways to cut it into
pieces, of the product of their probabilities, which a forward pass over its bytes computes; a text's is the product over its words.
Piece probabilities are learned by expectation maximisation over the same lattice (forward and backward passes).

Words are runs of bytes other than ASCII white space, with A-Z lower-cased and a leading space as in the vocabulary. All pieces of the vocabulary
count, and words of any length are summed over all their cuts: those of LONGEST bytes and more one at a time, in logarithms and by blocks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import BASE, INVERSE, _VALUE_LOWER, Hashes, _powers, blocks, spans
from .runtime import fresh, prepare, text_bytes, unit_hash
from .tokens import default_vocabulary

#: From so many bytes a word is taken by itself (it decides speed only); bytes of such a word in one block.
LONGEST, BLOCK = 64, 1 << 16
#: The classifier is fitted on labelled rows of about so many text bytes for each language (all rows where there are fewer).
FIT_BYTES = 1_500_000
ROUNDS = 3
#: Share of each language's probability that is spread evenly over the vocabulary.
EVEN_SHARE = 1e-3
#: Forward values are kept in range by this factor for each byte, which is taken off again in the logarithm.
LIFT = 256.0
MOST_KEPT = 800_000

_POW = np.array([pow(BASE, i, 1 << 64) for i in range(LONGEST + 1)], np.uint64)
_INV = np.array([pow(INVERSE, i, 1 << 64) for i in range(LONGEST + 1)], np.uint64)


class Pieces:
    """The vocabulary's pieces as hashes in small open tables: ``find`` gives their numbers, or ``n`` where there is none."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = {base64.b64decode(x.split()[0]).lower() for x in f}
        pieces = sorted(raw)
        self.n = len(pieces)
        self.lengths = np.array([len(p) for p in pieces])
        self.sizes = np.unique(self.lengths)
        self.lift = np.power(LIFT, np.where(self.lengths <= LONGEST, self.lengths, 0))  # longer pieces are in no word of a lattice
        h = np.array([int(sum((int(_VALUE_LOWER[b]) * pow(BASE, i, 1 << 64)) for i, b in enumerate(p)) % (1 << 64)) for p in pieces], np.uint64)
        self.levels, left = [], np.arange(self.n)
        while len(left):
            shift = np.uint64(64 - 18)
            salt = np.uint64(0x9E3779B97F4A7C15 + 2 * len(self.levels))
            slot = (h[left] * salt) >> shift
            _, chosen = np.unique(slot, return_index=True)
            key, number = np.zeros(1 << 18, np.uint64), np.full(1 << 18, self.n, np.int32)
            key[slot[chosen]], number[slot[chosen]] = h[left[chosen]], left[chosen]
            self.levels.append((salt, shift, key, number))
            left = np.delete(left, chosen)

    def find(self, h: np.ndarray) -> np.ndarray:
        out = None
        for salt, shift, key, number in self.levels:
            slot = (h * salt) >> shift
            got = np.where(key[slot] == h, number[slot], self.n)
            out = got if out is None else np.minimum(out, got)
        return out


class Lattice:
    """All cuts into pieces of some words, longest first: ``forward`` and ``expect`` run over them for all languages at once."""

    def __init__(self, pieces: Pieces, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.n_pieces = pieces.n
        self.order = np.argsort(-lengths, kind="stable")
        starts, self.lengths = starts[self.order], lengths[self.order] + 1
        self.top = int(self.lengths[0]) if len(lengths) else 0
        self.alive = np.searchsorted(-self.lengths, -np.arange(self.top + 1), "right")  # words of at least so many bytes
        prefix = np.zeros((self.top + 1, len(starts)), np.uint64)
        prefix[1] = _VALUE_LOWER[32] if self.top else 0
        for j in range(2, self.top + 1):
            k = self.alive[j]
            prefix[j, :k] = prefix[j - 1, :k] + _VALUE_LOWER[data[starts[:k] + j - 2]] * _POW[j - 1]
        self.arcs = []
        for j in range(1, self.top + 1):
            k = self.alive[j]
            for n in pieces.sizes[pieces.sizes <= j].tolist():
                found = pieces.find((prefix[j, :k] - prefix[j - n, :k]) * _INV[j - n])
                hit = np.flatnonzero(found < pieces.n)
                if len(hit):
                    self.arcs.append((j, j - n, hit, found[hit]))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Values by byte, word and language. p: probabilities, lifted by LIFT for each byte of the piece."""
        a = np.zeros((self.top + 1, len(self.lengths), p.shape[1]))
        a[0] = 1
        for j, i, word, piece in self.arcs:
            a[j, word] += a[i, word] * p[piece]
        return a

    def scores(self, p: np.ndarray) -> np.ndarray:
        """Log-likelihoods by word and language, in the order in which the words were given."""
        a = self.forward(p)
        out = np.empty((len(self.lengths), p.shape[1]))
        with np.errstate(divide="ignore"):
            out[self.order] = np.log(np.maximum(a[self.lengths, np.arange(len(self.lengths))], 1e-300)) - (self.lengths * np.log(LIFT))[:, None]
        return out

    def expect(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece by language, for words seen ``counts`` times (words by languages)."""
        a, at = self.forward(p), np.arange(len(self.lengths))
        b = np.zeros_like(a)
        b[self.lengths, at] = counts[self.order] / np.maximum(a[self.lengths, at], 1e-300)
        out = np.zeros((self.n_pieces, p.shape[1]))
        for j, i, word, piece in reversed(self.arcs):
            flow = b[j, word] * p[piece]
            b[i, word] += flow
            flow *= a[i, word]
            for k in range(p.shape[1]):
                out[:, k] += np.bincount(piece, flow[:, k], self.n_pieces)
        return out


def _arcs(pieces: Pieces, word: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, piece) of the arcs of one word that end in (a, b], ascending by end."""
    lo = max(0, a - int(pieces.sizes[-1]))
    power, inverse = _powers(BLOCK + int(pieces.sizes[-1]))
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(_VALUE_LOWER[word[lo:b]] * power[: b - lo], dtype=np.uint64)])
    starts, ends, numbers = [], [], []
    for n in pieces.sizes[pieces.sizes <= b - lo].tolist():
        first = max(a + 1 - n, 0) - lo  # of the arcs that end after a
        at = np.arange(max(first, 0), b - lo - n + 1)
        found = pieces.find((prefix[at + n] - prefix[at]) * inverse[at])
        hit = found < pieces.n
        starts.append(at[hit] + lo)
        ends.append(at[hit] + lo + n)
        numbers.append(found[hit])
    start, end, number = map(np.concatenate, (starts, ends, numbers))
    order = np.argsort(end, kind="stable")
    return start[order], end[order], number[order]


def _sums(at: np.ndarray, to: np.ndarray, flow: np.ndarray, values: np.ndarray, base: int) -> None:
    """values[to - base] = log of the sum of exp(values[at - base] + flow), for arcs in the order in which their values become known."""
    edge = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])).tolist() + [len(to)]
    for a, b in zip(edge, edge[1:]):
        values[to[a] - base] = np.logaddexp.reduce(values[at[a:b] - base] + flow[a:b], axis=0)


def long_score(pieces: Pieces, word: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """Log-likelihoods, by language, of one word of any length (its bytes with the leading space); only one block of it is held at a time."""
    tail, reach = np.zeros((1, log_p.shape[1])), int(pieces.sizes[-1])
    for a in range(0, len(word), BLOCK):
        b = min(a + BLOCK, len(word))
        start, end, number = _arcs(pieces, word, a, b)
        values = np.full((len(tail) + b - a, log_p.shape[1]), -np.inf)
        values[: len(tail)] = tail
        _sums(start, end, log_p[number], values, a + 1 - len(tail))
        tail = values[-reach:]
    return tail[-1]


def long_expect(pieces: Pieces, word: np.ndarray, log_p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece by language, for one word seen ``counts`` times (by languages)."""
    arcs = [_arcs(pieces, word, a, min(a + BLOCK, len(word))) for a in range(0, len(word), BLOCK)]
    start, end, number = map(np.concatenate, zip(*arcs))
    flow = log_p[number]
    forward = np.full((len(word) + 1, log_p.shape[1]), -np.inf)
    backward = forward.copy()
    forward[0] = backward[-1] = 0
    _sums(start, end, flow, forward, 0)
    back = np.argsort(-start, kind="stable")
    _sums(end[back], start[back], flow[back], backward, 0)
    used = np.exp(forward[start] + flow + backward[end] - forward[-1]) * counts
    return np.stack([np.bincount(number, used[:, k], pieces.n) for k in range(used.shape[1])], axis=1)


def _with_space(data: np.ndarray, start: int, end: int) -> np.ndarray:
    return np.concatenate([np.array([32], np.uint8), data[start:end]])


@dataclass
class Model:
    """Languages, the logarithms of their shares of the labelled rows, and lifted piece probabilities (pieces by languages)."""

    languages: list[str]
    log_share: np.ndarray
    p: np.ndarray
    path: str

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Scores blocks of texts; words are scored once and kept, for speed only."""

    def __init__(self, model: Model):
        self.model, self.pieces = model, Pieces(model.path)
        self.log_p = np.log(model.p / self.pieces.lift[:, None])
        self.forget()

    def forget(self) -> None:
        self.known, self.kept = np.empty(0, np.uint64), np.empty((0, len(self.model.languages)), np.float32)

    def texts(self, column: pa.Array) -> np.ndarray:
        """Log-likelihoods by text and language."""
        out = np.zeros((len(column), len(self.model.languages)))
        for a, b, data, offsets in blocks(column):
            if not len(data):
                continue
            starts, ends, rows = spans(data, offsets)
            if not len(starts):
                continue
            unique, first, which = np.unique(Hashes(data, lower=True).of(starts, ends), return_index=True, return_inverse=True)
            at = np.searchsorted(self.known, unique)
            new = np.ones(len(unique), bool)
            inside = at < len(self.known)
            new[inside] = self.known[at[inside]] != unique[inside]
            if new.any():
                if len(self.known) + int(new.sum()) > MOST_KEPT:
                    self.forget()
                    at, new = np.zeros(len(unique), np.int64), np.ones(len(unique), bool)
                own = first[new]
                got = np.empty((len(own), out.shape[1]), np.float32)
                lengths = ends[own] - starts[own]
                for few in (np.flatnonzero(lengths < 24), np.flatnonzero((lengths >= 24) & (lengths < LONGEST))):
                    if len(few):
                        got[few] = Lattice(self.pieces, data, starts[own[few]], lengths[few]).scores(self.model.p)
                for k in np.flatnonzero(lengths >= LONGEST).tolist():
                    got[k] = long_score(self.pieces, _with_space(data, starts[own[k]], ends[own[k]]), self.log_p)
                self.known = np.insert(self.known, at[new], unique[new])
                self.kept = np.insert(self.kept, at[new], got, axis=0)
                at = np.searchsorted(self.known, unique)
            reach = np.concatenate([np.zeros((1, out.shape[1])), np.cumsum(self.kept[at[which]], axis=0, dtype=np.float64)])
            out[a:b] = reach[rows[1:]] - reach[rows[:-1]]
        return out


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", ident: str = "doc_id", path: str | None = None) -> Model:
    """Learn a model from rows whose text and language are not null, on a repeatable sample of about FIT_BYTES for each language."""
    prepare(labelled.sparkSession)
    path = path or default_vocabulary()
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(ident).alias("_id"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    known = rows.groupBy("_lang").agg(F.count("*").alias("n"), F.sum(text_bytes(F.col("_text"))).alias("b")).orderBy("_lang").toPandas()
    languages = known["_lang"].tolist()
    if not languages:
        return Model([], np.empty(0), np.empty((0, 0)), path)
    rate = F.create_map(*[F.lit(v) for k, b in zip(languages, known["b"]) for v in (k, float(FIT_BYTES) / max(float(b), 1.0))])
    sample = rows.where(unit_hash(F.col("_id"), F.lit(3)) < rate[F.col("_lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for a, b, data, offsets in blocks(x.column(0)):
                if not len(data):
                    continue
                starts, ends, places = spans(data, offsets)
                number = np.unique(np.asarray(x.column(1).slice(a, b - a).to_pylist(), object).astype(str), return_inverse=True)
                owner = np.repeat(number[1], np.diff(places))
                key = Hashes(data, lower=True).of(starts, ends)
                order = np.lexsort((key, owner))
                edge = np.flatnonzero(np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (owner[order][1:] != owner[order][:-1])])) if len(order) else order
                n = np.diff(np.append(edge, len(order)))
                own = order[edge]
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(number[0][owner[own]].tolist(), pa.string()), pa.array([raw[s:e].lower() for s, e in zip(starts[own].tolist(), ends[own].tolist())], pa.binary()), pa.array(n.astype(np.int64))], ["_lang", "word", "n"])

    words = sample.select("_text", "_lang").mapInArrow(count, "_lang string, word binary, n long").groupBy("_lang", "word").agg(F.sum("n").alias("n")).toPandas()
    return _learn(words, languages, known["n"].to_numpy(float), path)


def _learn(words, languages: list[str], n_rows: np.ndarray, path: str) -> Model:
    pieces = Pieces(path)
    table = words.pivot_table(index="word", columns="_lang", values="n", aggfunc="sum", fill_value=0).reindex(columns=languages, fill_value=0).sort_index()
    counts = table.to_numpy(float)
    texts = [bytes(w) for w in table.index]
    lengths = np.array([len(w) for w in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum(lengths) - lengths
    lift = pieces.lift[:, None]
    p = np.full((pieces.n, len(languages)), 1 / pieces.n)
    for _ in range(ROUNDS):
        used = np.zeros_like(p)
        by_length = np.argsort(lengths, kind="stable")
        short = int((lengths < LONGEST).sum())
        log_p = np.log(p)
        for k in by_length[short:].tolist():
            used += long_expect(pieces, _with_space(data, starts[k], starts[k] + lengths[k]), log_p, counts[k])
        for a in range(0, short, 20_000):
            own = by_length[a : min(a + 20_000, short)]
            used += Lattice(pieces, data, starts[own], lengths[own]).expect(p * lift, counts[own])
        p = (1 - EVEN_SHARE) * used / np.maximum(used.sum(0), 1e-300) + EVEN_SHARE / pieces.n
    return Model(languages, np.log(n_rows / n_rows.sum()), p * lift, path)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, which replace columns of these names.

    A text that is null or has no letter is ``und`` with score 0, as is every text if the model knows no language. Otherwise score is the
    probability of the predicted language given the text; ties go to the language that sorts first. Texts and words of any length are read whole;
    repeated rows are judged each, alike; other columns are kept, whatever their names. An empty table stays empty.
    """
    prepare(docs.sparkSession)
    kept = docs.drop("lang_pred", "score")
    names = kept.columns
    read = kept.select("*", has_letter(F.col(text)).alias(fresh("letter", kept)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer() if model.languages else None
        at = names.index(text)
        for x in batches:
            letter = x.column(len(names)).to_numpy(zero_copy_only=False)
            if scorer is None or not len(letter):
                best, sure = ["und"] * len(letter), np.zeros(len(letter))
            else:
                s = scorer.texts(x.column(at)) + model.log_share
                s = np.exp(s - s.max(axis=1, keepdims=True))
                s /= s.sum(axis=1, keepdims=True)
                best = [model.languages[i] if ok else "und" for i, ok in zip(s.argmax(axis=1), letter)]
                sure = np.where(letter, s.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([*x.columns[: len(names)], pa.array(best, pa.string()), pa.array(sure, pa.float64())], [*names, "lang_pred", "score"])

    schema = kept.schema.add("lang_pred", "string").add("score", "double")
    return read.mapInArrow(judge, schema)
