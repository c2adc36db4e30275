"""Analytics of a running service: counters, histograms, caches, rate limits, audit rows, model choice."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of a duration histogram in seconds (the usual defaults of metrics libraries).
BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]


def counters(events: DataFrame, *labels: str) -> DataFrame:
    return events.groupBy(*labels).agg(F.count("*").alias("n"))


def gauges(events: DataFrame, value: Column, order: Column, *labels: str) -> DataFrame:
    """(labels, value): the last value that was set, by ``order``."""
    return events.groupBy(*labels).agg(F.max_by(value, order).alias("value"))


def item_status(items: DataFrame, extractions: DataFrame, longest: int = 50_000) -> DataFrame:
    """(extraction_id, status, error) for each item of a batch or stream: not_found, failed with the reason, or completed. An item fails by itself.

    extractions: id (unique) and raw_text.
    """
    known = extractions.select(F.col("id").alias("extraction_id"), F.col("raw_text"), F.lit(True).alias("_known"))
    out = items.select("extraction_id").join(known, "extraction_id", "left")
    error = F.when(F.col("_known").isNull(), None).when(F.coalesce(F.trim("raw_text"), F.lit("")) == "", "Text cannot be empty").when(F.length("raw_text") > longest, "Text is too long")
    return out.select("extraction_id", F.when(F.col("_known").isNull(), "not_found").when(error.isNotNull(), "failed").otherwise("completed").alias("status"), error.alias("error"))


def histogram(events: DataFrame, value: str, *labels: str) -> DataFrame:
    """(labels, le, n): cumulative counts up to each bound."""
    wide = events.groupBy(*labels).agg(*[F.count_if(F.col(value) <= b).alias(str(b)) for b in BUCKETS], F.count(value).alias("inf"))
    pairs = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"`{b}`").alias("n")) for b in BUCKETS], F.struct(F.lit(float("inf")).alias("le"), F.col("inf").alias("n")))
    return wide.select(*labels, F.inline(pairs))


def hit_rate(events: DataFrame, hit: Column, miss: Column) -> DataFrame:
    s = events.agg(F.count_if(hit).alias("hits"), F.count_if(miss).alias("misses"))
    return s.withColumn("hit_rate", F.col("hits") / F.greatest(F.col("hits") + F.col("misses"), F.lit(1)))


def once_per_content(docs: DataFrame, compute, text: str = "text", version: str = "v1") -> DataFrame:
    """Run ``compute`` (DataFrame with _key and the text to DataFrame with _key) on distinct contents only, and join its columns back.

    The key is the whole SHA-256 of version and content; null texts have a key of their own and are computed once, too.
    """
    keyed = docs.withColumn("_key", F.coalesce(F.sha2(F.concat(F.lit(f"{version}:"), F.col(text)), 256), F.lit("")))
    distinct = keyed.select("_key", text).dropDuplicates(["_key"])
    return keyed.join(compute(distinct).drop(text), "_key", "left")


def rate_window(requests: DataFrame, limit: int = 60, seconds: int = 60) -> DataFrame:
    """(key, sec, used, remaining, allowed) by distinct seconds of the window that ends at each; rejected requests count too (an upper bound)."""
    per = requests.select("key", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("sec")).distinct()
    w = Window.partitionBy("key").orderBy("sec").rangeBetween(-(seconds - 1), 0)
    used = F.count("*").over(w)
    return per.withColumn("used", used).withColumn("remaining", F.greatest(F.lit(limit) - F.col("used"), F.lit(0))).withColumn("allowed", F.col("used") <= limit)


def rate_exact(requests: DataFrame, limit: int = 60, seconds: int = 60) -> DataFrame:
    """(key, ts, allowed) by the exact machine: rejected requests aren't recorded, requests of one second count once.

    A key's requests are gone through in time order, batch by batch as Spark sorts and spills them; the state is the seconds within one window.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for x in batches:
            allowed = []
            for k, s in zip(x["key"], x["sec"]):
                if k != key:
                    key, held = k, []
                while held and held[0] <= s - seconds:
                    held.pop(0)
                ok = len(held) < limit
                if ok and (not held or held[-1] != s):
                    held.append(s)
                allowed.append(ok)
            yield pd.DataFrame({"key": x["key"], "ts": x["ts"], "allowed": allowed})

    by_second = requests.select(F.col("key").cast("string").alias("key"), "ts", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("sec"))
    return by_second.repartition("key").sortWithinPartitions("key", "sec", "ts").mapInPandas(run, f"key string, ts {dict(requests.dtypes)['ts']}, allowed boolean")


def audit_rows(events: DataFrame, user: Column, action: Column, resource: Column, details: Column, success: Column) -> DataFrame:
    return events.select(F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), user.cast("string").alias("user"), action.alias("action"), resource.alias("resource"), details.alias("details"), success.alias("success"))


def assign_model(ident: Column, active: list[str]) -> Column:
    """One of the active models, always the same for an ident."""
    return F.element_at(F.array(*[F.lit(m) for m in active]), (F.pmod(F.xxhash64(ident), F.lit(len(active))) + 1).cast("int"))


def indexed_results(batches: DataFrame, texts: str = "texts", longest: int = 50_000) -> DataFrame:
    """(batch, index, success, error): one row for each text of a batch; blank or overlong texts fail by themselves."""
    out = batches.select("batch", F.posexplode_outer(texts).alias("index", "text"))
    error = F.when(F.col("text").isNull() | (F.trim("text") == ""), "Text cannot be empty").when(F.length("text") > longest, "Text is too long")
    return out.where("index is not null").select("batch", "index", error.isNull().alias("success"), error.alias("error"))
