"""Line de-duplication by a log-template tree.

A line is parsed to a fixed depth: its token count, then its first LEADING tokens, then the rest of its tokens. Tokens that hold a digit or an
``@`` are variable and become wildcards at every depth. Below the leading tokens a long line has one more branch for each of FIELDS parts of
its rest, in which that part is a wildcard: lines that differ in one part only meet there. The path from the root is a line's template, kept as
a 64-bit hash. Lines without enough constant tokens, such as rows of numbers, have no template but the exact one.

Where it is asked for, a line of any length, short ones too, also has an exact template, its tokens as they are, which may recur from fewer texts.

A template recurs if enough different texts hold it. Copies of a text count once, so copies alone make nothing recur. Lines of a recurring
template are dropped from all texts but the first (that of the smallest ident), so no content leaves the corpus altogether.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import Hashes, blocks, mix, spans
from .runtime import cut, prepare, skew_lookup

LEADING, FIELDS = 3, 4
#: Lines of fewer tokens have no branch with a wildcard part; of two tokens and fewer, none but the exact one.
LONG_LINE, SHORT_LINE = 8, 2
#: Least constant tokens of a template with wildcards, and the most tokens for each constant one: below that it says too little as well.
CONSTANT, TOKENS_EACH = 2, 3

_RNG = np.random.default_rng(77)
_WILD, _LINE = _RNG.integers(1, 1 << 62, 2, dtype=np.uint64)
_VARIABLE = np.zeros(256, np.int32)
_VARIABLE[[*range(48, 58), 64]] = 1


def line_templates(data: np.ndarray, offsets: np.ndarray, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, line number, template) of a block's lines; a long line has FIELDS + 1 of them. Exact templates are odd, others even."""
    feed = np.flatnonzero(data == 10)
    rows_of_feed = np.searchsorted(offsets, feed, "right") - 1
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    line_start = np.sort(np.concatenate([offsets[:-1][filled], feed + 1]))  # a feed at a text's end opens an empty line there
    line_row = np.sort(np.concatenate([filled, rows_of_feed]))
    first = np.searchsorted(line_row, line_row)
    number = np.arange(len(line_row)) - first
    starts, ends, _ = spans(data, offsets)
    if not len(starts):
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.int64),)
    # a line that starts where the next text does is the empty last one of its text: rows are compared first
    word_row = np.searchsorted(offsets, starts, "right") - 1
    place = np.searchsorted(line_start, starts, "right") - 1
    off = line_row[place] != word_row
    if off.any():
        place[off] = np.array([np.flatnonzero((line_start <= s) & (line_row == r))[-1] for s, r in zip(starts[off], word_row[off])])
    seen = np.concatenate([[0], np.cumsum(_VARIABLE[data])])
    variable = seen[ends] > seen[starts]
    plain = Hashes(data).of(starts, ends)
    token = np.where(variable, _WILD, plain)
    edge = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    count = np.diff(np.append(edge, len(place)))
    position = np.arange(len(place)) - np.repeat(edge, count)
    n = np.repeat(count, count)
    spread = mix(token * (_LINE + np.uint64(2) * position.astype(np.uint64)))
    wild = mix(_WILD * (_LINE + np.uint64(2) * position.astype(np.uint64)))
    whole = np.add.reduceat(spread, edge)
    root = mix(count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    varied = np.add.reduceat(variable.astype(np.int64), edge)
    fit = lambda constant: (constant >= CONSTANT) & (constant * TOKENS_EACH >= count)
    own = (count > SHORT_LINE) & fit(count - varied)
    odd = np.uint64(1)
    out = []
    if exact:  # a line without variable tokens meets only its equals by its whole template, so the exact one takes its place
        same = np.add.reduceat(mix(plain * (_LINE + np.uint64(2) * position.astype(np.uint64))), edge)
        own &= varied > 0
        out.append((place[edge], mix(root + same) | odd))
    out.append((place[edge][own], mix(root + whole)[own] & ~odd))
    long = count >= LONG_LINE
    if long.any():
        part = np.where(position < LEADING, -1, (position - LEADING) * FIELDS // np.maximum(n - LEADING, 1))
        for j in range(FIELDS):
            change = np.add.reduceat(np.where(part == j, wild - spread, np.uint64(0)), edge)
            keep = long & fit(count - np.add.reduceat((variable | (part == j)).astype(np.int64), edge))
            out.append((place[edge][keep], mix(root + whole + change + np.uint64(j + 1))[keep] & ~odd))
    line = np.concatenate([x for x, _ in out])
    return line_row[line], number[line], np.concatenate([x for _, x in out]).astype(np.int64)


def recurring_lines(docs: DataFrame, least: int = 3, ident: str = "doc_id", text: str = "text", exact: int | None = None) -> DataFrame:
    """(ident, _hash, dropped): for each document that loses lines, their numbers from 0 in ascending order. ``_hash`` is that of the text."""
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[ident]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for a, _, data, offsets in blocks(x.column(2)):
                if not len(data):
                    continue
                row, number, template = line_templates(data, offsets, exact is not None)
                at = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([x.column(0).take(at), x.column(1).take(at), pa.array(number.astype(np.int32)), pa.array(template)], ["_id", "_hash", "line", "template"])

    lines = docs.select(F.col(ident), F.xxhash64(text), text).mapInArrow(parse, f"_id {kind}, _hash long, line int, template long")
    of_text = lines.groupBy("template", "_hash").agg(F.min("_id").alias("i"), F.count("*").alias("n"))
    found = of_text.groupBy("template").agg(F.count("*").alias("texts"), F.sum("n").alias("_n"), F.min(F.struct("i", "_hash")).alias("first"))
    enough = least if exact is None else F.when(F.col("template").bitwiseAND(F.lit(1)) == 1, exact).otherwise(least)
    found = cut(found.where(F.col("texts") >= enough).select("template", F.col("first._hash").alias("first"), "_n"))
    hits = skew_lookup(lines, found.drop("_n"), ["template"], found.select("template", "_n")).where("_hash <> first")
    return hits.groupBy("_id", "_hash").agg(F.array_sort(F.collect_set("line")).alias("dropped")).withColumnRenamed("_id", ident)


def drop_recurring(docs: DataFrame, least: int = 3, ident: str = "doc_id", text: str = "text", exact: int | None = None) -> DataFrame:
    """``docs`` with the recurring lines taken out of their texts, and the columns n_lines and dropped (the numbers of the lines, from 0).

    All rows stay, those whose lines are all dropped with an empty text. A null text stays null, with no lines; an empty text has one empty line.
    Lines end at line feeds only. Repeated rows are treated alike; columns of ``docs`` that clash with the two are replaced, all others kept; an empty table stays
    empty. ``least`` is the number of different texts from which a template recurs; ``exact`` the
    number from which a line of any length recurs token for token (None: lines of SHORT_LINE tokens stay, and equal longer ones need ``least``).
    """
    kept = docs.drop("n_lines", "dropped")
    same = F.struct(F.col(ident).alias("i"), F.xxhash64(text).alias("h"))
    hits = recurring_lines(kept.select(ident, text), least, ident, text, exact).select(F.struct(F.col(ident).alias("i"), F.col("_hash").alias("h")).alias("k"), F.col("dropped").alias("gone"))
    joined = kept.select(F.struct("*").alias("d"), same.alias("k")).join(hits, "k", "left")
    own = F.col("d")[text]
    lines = F.split(own, "\n", -1)
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n")
    new = F.when(F.col("gone").isNull(), own).otherwise(left)
    return joined.select(
        *[(new if c == text else F.col("d")[c]).alias(c) for c in kept.columns],
        F.when(own.isNull(), 0).otherwise(F.size(lines)).alias("n_lines"),
        F.coalesce("gone", F.array().cast("array<int>")).alias("dropped"),
    )
