"""Session plumbing shared by the operators: table paths, shared intermediate tables, batch sizes, weighted splitters, skew-proof lookups, key filters."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch. Texts vary from one word to very many; a batch is cut again by bytes where it is read.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
#: Words of 64 bits in a key filter (8 MB), whatever the number of keys.
FILTER_WORDS = 1 << 20
#: Bytes that a writer of an intermediate table holds.
BLOCK_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Set the session's Arrow batch limits (they hold for later queries of the session too) and make sure that a checkpoint folder is known.

    ``spark.checkpoint.dir`` names the folder that the driver and all executors share. Where it is unset a local run gets a folder of its own;
    on a cluster that is an error, since executors would not see a machine's own folder.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="notewell-checkpoint-"))
    return spark


def scratch(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder; what is written there goes when the driver ends, if it wasn't released before."""
    prepare(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/notewell-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(place)
    fs.deleteOnExit(place)
    return path


def erase(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the shared checkpoint folder and go on from there: later actions don't recompute it, and it outlives executors."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.mode("overwrite").option("parquet.block.size", str(BLOCK_BYTES)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._notewell_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables that cut() wrote, once nothing reads them any more."""
    for df in frames:
        erase(df.sparkSession, df._notewell_path)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def unit_hash(*cols: Column) -> Column:
    """A repeatable number in [0, 1) from the given columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)).cast("double") / float(1 << 40)


def weighted_splitters(slim: DataFrame, key: str, size: str, ident: str, n_ranges: int, total: float, per_range: int = 32) -> np.ndarray:
    """``n_ranges - 1`` ascending splitters of ``key`` such that ranges hold about equal sums of ``size``.

    A row is drawn with probability ``size * m / total`` (at most 1) for m = n_ranges * per_range, so about m keys reach the driver
    however many rows there are; a row that is drawn for sure weighs as often as it would have been drawn.
    """
    if n_ranges < 2 or total <= 0:
        return np.empty(0, np.int64)
    share = F.col(size) * F.lit(n_ranges * per_range / float(total))
    drawn = slim.where(unit_hash(F.col(ident), F.lit(7)) < share).select(F.col(key).alias("k"), F.greatest(share, F.lit(1.0)).alias("w")).toPandas()
    if drawn.empty:
        return np.empty(0, np.int64)
    drawn = drawn.sort_values("k", kind="stable")
    keys, reach = drawn["k"].to_numpy(np.int64), drawn["w"].to_numpy().cumsum()
    at = np.searchsorted(reach, np.arange(1, n_ranges) * reach[-1] / n_ranges)
    return np.unique(keys[np.minimum(at, len(keys) - 1)])


def skew_lookup(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame, spread: int = 4096, how: str = "inner") -> DataFrame:
    """Join ``left`` to ``right``, whose keys are unique, where few keys may have very many rows of ``left``.

    ``counts`` has the keys and ``_n``, the rows of ``left`` with each. Keys with more than ``spread`` rows and more than a thousandth of all
    rows are hot; there are fewer than a thousand of them, and only their list is broadcast. Their rows are dealt over several tasks by a salt
    that hashes all other columns (of whatever type), so a task that runs again deals alike, and their row of ``right`` is repeated for each
    salt. Without hot keys it is a plain join.
    """
    found = counts.agg(F.sum("_n").alias("total"), F.max("_n").alias("top")).first()
    most = max(spread, (found["total"] or 0) // 1000)
    if (found["top"] or 0) <= most:
        return left.join(right, keys, how)
    own = [c for c in left.columns if c not in keys]
    hot = F.broadcast(cut(counts.where(F.col("_n") > most).select(*keys, F.ceil(F.col("_n") / most).cast("int").alias("_salts"))))
    left = left.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.lit(11), *own), F.col("_salts").cast("long")).cast("int"))).drop("_salts")
    right = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def _bits(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The filter's word for each key, and its two bits there."""
    k = key.astype(np.uint64)
    return (k & np.uint64(FILTER_WORDS - 1)).astype(np.int64), np.uint64(1) << (k >> np.uint64(24) & np.uint64(63)) | np.uint64(1) << (k >> np.uint64(34) & np.uint64(63))


def key_filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of the one column of ``keys`` (64-bit hashes): always FILTER_WORDS words, put together on the executors.

    With very many keys it lets everything through, so it may only save work, never decide.
    """
    k = F.col(keys.columns[0])
    one = lambda by: F.expr(f"shiftleft(1L, cast(shiftright(k, {by}) & 63 as int))")
    words = keys.select(k.alias("k")).select(F.col("k").bitwiseAND(F.lit(FILTER_WORDS - 1)).alias("w"), one(24).bitwiseOR(one(34)).alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(FILTER_WORDS, np.uint64)
    out[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64).view(np.uint64)
    return out


def in_filter(key: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which keys may be among those of a filter; all that are, and few others."""
    word, both = _bits(key)
    return bits[word] & both == both


def maybe_in(df: DataFrame, key: str, bits: np.ndarray) -> DataFrame:
    """The rows of ``df`` whose ``key`` (long, not null) may be one of a filter's."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield x.filter(pa.array(in_filter(x.column(key).to_numpy(), bits)))

    return df.mapInArrow(look, df.schema)
