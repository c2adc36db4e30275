"""Streaming forms of the batch operators: metrics by event time, extraction, deduplication, exact rate limits, the knowledge loop."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import cache_key
from ..operators.knowledge import merge


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    """A Parquet folder as a stream, with ``ts`` as event time."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 day", label: str = "event_type") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), label).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), label, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id") -> DataFrame:
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))
    return s.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def distinct_contents(notes: DataFrame, version: str = "v1", keep: str = "1 hour", text: str = "text") -> DataFrame:
    """The first note of each content within the time a cached result would live."""
    return notes.withWatermark("ts", keep).withColumn("_key", cache_key(F.lit(version), F.col(text))).dropDuplicatesWithinWatermark(["_key"])


def rate_limited(requests: DataFrame, limit: int = 60, seconds: int = 60) -> DataFrame:
    """(key, ts, allowed) by the exact machine of ``service.rate_exact``, with the window's seconds as state; late rows count where they arrive."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        allowed = []
        for s in rows["sec"]:
            held = [h for h in held if h > s - seconds]
            ok = len(held) < limit
            if ok and s not in held:
                held.append(int(s))
            allowed.append(ok)
        state.update((held,))
        yield pd.DataFrame({"key": key[0], "ts": rows["ts"], "allowed": allowed})

    by_second = requests.select(F.col("key").cast("string").alias("key"), "ts", F.unix_timestamp("ts").alias("sec"))
    return by_second.groupBy("key").applyInPandasWithState(run, "key string, ts timestamp, allowed boolean", "held array<long>", "append", GroupStateTimeout.NoTimeout)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset a local run takes a temporary one and a cluster fails."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        base = tempfile.mkdtemp()
    return f"{base}/notewell-{uuid.uuid4().hex}"


def run_once(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Drain a stream into a Parquet table under a shared folder and return that; in complete mode the last state of it."""
    folder = folder or shared_folder(stream.sparkSession)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{folder}/rows")
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/rows"))
    writer.start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def knowledge_loop(deltas: DataFrame, path: str, empty: DataFrame) -> Callable:
    """A foreachBatch function that merges each batch of deltas into versions of the knowledge table under ``path``; an old batch run again changes nothing."""

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        try:
            current = spark.read.parquet(f"{path}/version={epoch - 1}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            current = empty
        merge(current, batch).drop("touched", "is_new").write.mode("overwrite").parquet(f"{path}/version={epoch}")

    return apply
