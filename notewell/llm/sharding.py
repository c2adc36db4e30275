"""Sharding by sampled splitters.

A size-weighted sample of content keys gives quantile boundaries, records are range-partitioned by key, and ranges that one key overfills
or a sampling error overfills are subdivided. Ranges are then laid out over the shards so that shards hold nearly equal bytes (law ``bytes``).

Copies of a text have one key, so they share a shard. A group of copies that is larger than a twentieth of a shard is placed by itself:
whole where it fits, else over several shards. A range of more than OVERFULL times its fair bytes stays in one shard, but its rows are numbered in
several parts, so no task holds more than about that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut, text_bytes, weighted_splitters

#: Ranges that the driver holds sums of: at least and at most, and the bytes meant for one between the two.
FEWEST_RANGES, MOST_RANGES, RANGE_BYTES = 2048, 65536, 256 << 20
#: A group of copies above this share of a shard is placed by itself; there are at most shards / share of them.
HEAVY_SHARE = 1 / 20
OVERFULL = 2


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ident, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 1 (null text: 1, with CRC 0, as an empty one). ``slot`` numbers a shard's rows from 0 without
    gaps. Null idents are kept, sort first and are dealt row by row where a group is divided; repeated rows each get a slot; texts of any length count
    whole; other columns are ignored; an empty input gives no rows.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    slim = cut(docs.select(F.col(ident), (text_bytes(F.col(text)) + 1).alias("size"), F.crc32(content).alias("text_crc32"), F.xxhash64(content).alias("_key"), F.pmod(F.when(F.col(ident).isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64(F.col(ident))), F.lit(1 << 40)).alias("_deal")))
    total = slim.agg(F.sum("size")).first()[0] or 0
    n_ranges = int(min(MOST_RANGES, max(FEWEST_RANGES, total // RANGE_BYTES)))
    fair = total / n_shards
    heavy = slim.groupBy("_key").agg(F.sum("size").alias("b")).where(F.col("b") > HEAVY_SHARE * fair).orderBy("_key").toPandas()
    splitters = weighted_splitters(slim, "_key", "size", ident, n_ranges, float(total))
    keys = heavy["_key"].to_numpy(np.int64)
    pieces = np.ceil(heavy["b"].to_numpy(float) * n_ranges / max(total, 1)).astype(np.int64)
    first = len(splitters) + 1 + np.cumsum(pieces) - pieces

    kind = dict(slim.dtypes)[ident]

    def units(full: np.ndarray, parts: np.ndarray) -> DataFrame:
        """``slim`` with each row's unit (a range, or a piece of a heavy group) and the part of it: units in ``full`` have so many ``parts``."""

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                key, deal = x.column("_key").to_numpy(), x.column("_deal").to_numpy()
                unit = np.searchsorted(splitters, key, "right").astype(np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    unit = np.where(keys[at] == key, first[at] + deal % pieces[at], unit)
                part = np.zeros(len(unit), np.int32)
                if len(full):
                    at = np.minimum(np.searchsorted(full, unit), len(full) - 1)
                    part = np.where(full[at] == unit, (deal >> 20) % parts[at], 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*x.columns, pa.array(unit, pa.int64()), pa.array(part, pa.int32())], [*x.schema.names, "_unit", "_part"])

        return slim.mapInArrow(place, f"`{ident}` {kind}, size long, text_crc32 long, _key long, _deal long, _unit long, _part int")

    none = np.empty(0, np.int64)
    sums = units(none, none).groupBy("_unit").agg(F.sum("size").alias("b"), F.count("*").alias("n")).orderBy("_unit").toPandas()
    target = total / n_ranges
    over = sums[sums["b"] > OVERFULL * target]
    dealt = units(over["_unit"].to_numpy(np.int64), np.ceil(over["b"].to_numpy(float) / target).astype(np.int64))
    if len(over):
        counts = dealt.groupBy("_unit", "_part").agg(F.count("*").alias("n")).orderBy("_unit", "_part").toPandas()
    else:
        counts = sums[["_unit", "n"]].assign(_part=0)
    counts = counts.merge(_lay_out(sums, first, pieces, n_shards, fair), on="_unit", how="left")
    counts["_base"] = counts.groupby("shard")["n"].cumsum() - counts["n"]
    plan = docs.sparkSession.createDataFrame(counts[["_unit", "_part", "shard", "_base"]], "_unit long, _part int, shard int, _base long")
    at = F.row_number().over(Window.partitionBy("_unit", "_part").orderBy("_key", F.col(ident)))
    return (
        dealt.withColumn("_place", at)
        .join(F.broadcast(plan), ["_unit", "_part"])  # one row for each range, part of one and piece of a heavy group: at most four times MOST_RANGES
        .select(F.col(ident), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_base") + F.col("_place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def _lay_out(sums: pd.DataFrame, first: np.ndarray, pieces: np.ndarray, n_shards: int, fair: float) -> pd.DataFrame:
    """Give each unit a shard. Heavy groups come first, largest first; ranges then fill up the shards in key order."""
    unit, size = sums["_unit"].to_numpy(np.int64), sums["b"].to_numpy(float)
    shard, load = np.zeros(len(unit), np.int64), np.zeros(n_shards)
    lowest = first[0] if len(first) else np.iinfo(np.int64).max
    of_group = [np.flatnonzero((unit >= a) & (unit < a + n)) for a, n in zip(first, pieces)]
    for own in sorted(of_group, key=lambda x: (-size[x].sum(), unit[x[0]] if len(x) else 0)):
        s = int(load.argmin())
        if load[s] + size[own].sum() <= fair:
            shard[own] = s
            load[s] += size[own].sum()
        else:
            for k in own:
                shard[k] = s = int(load.argmin())
                load[s] += size[k]
    light = np.flatnonzero(unit < lowest)
    if len(light):
        room = np.maximum(fair - load, 0)
        edges = np.cumsum(room) / max(room.sum(), 1e-9) * size[light].sum()
        middle = np.cumsum(size[light]) - size[light] / 2
        shard[light] = np.minimum(np.searchsorted(edges, middle, "right"), n_shards - 1)
    return pd.DataFrame({"_unit": unit, "shard": shard.astype(np.int32)})
