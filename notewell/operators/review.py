"""Choosing records for human review, and statistics of it. An extraction row has id, status, created_at, text and entities (with a score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def statistics(extractions: DataFrame) -> DataFrame:
    """One row: total, pending, verified, verification_rate (percent, 0 for an empty table)."""
    s = extractions.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "verified").alias("verified"))
    return s.withColumn("verification_rate", F.when(F.col("total") == 0, 0.0).otherwise(F.bround(100.0 * F.col("verified") / F.col("total"), 2)))


def mean_confidence(extractions: DataFrame, score: str = "score") -> DataFrame:
    """(id, n_entities, avg_confidence) of documents that have entities; 0.0 where no entity has a confidence."""
    e = extractions.select("id", "created_at", "status", F.explode("entities").alias("e"))
    return e.groupBy("id", "created_at", "status").agg(F.count("*").alias("n_entities"), F.coalesce(F.avg(f"e.{score}"), F.lit(0.0)).alias("avg_confidence"))


def uncertain(extractions: DataFrame, limit: int = 10, low: float = 0.0, high: float = 0.7, status: str = "pending") -> DataFrame:
    """Of the newest 2 * limit rows of a status, the newest ``limit`` with a mean confidence within bounds, least sure first (ties by id)."""
    newest = extractions.where(F.col("status") == status).orderBy(F.desc("created_at"), "id").limit(2 * limit)
    some = mean_confidence(newest).where(F.col("avg_confidence").between(low, high)).orderBy(F.desc("created_at"), "id").limit(limit)
    return some.orderBy("avg_confidence", "id").select("id", "n_entities", "avg_confidence")


def strata(extractions: DataFrame) -> DataFrame:
    n = F.size("entities")
    return extractions.withColumn("stratum", F.when(n <= 3, "low").when(n <= 7, "medium").otherwise("high"))


def diverse(extractions: DataFrame, limit: int = 9, seed: int = 42, status: str = "pending") -> DataFrame:
    """max(1, limit // 3) rows of each stratum in a seeded order; the same rows for the same seed."""
    order = F.xxhash64(F.lit(seed), "id")
    placed = strata(extractions.where(F.col("status") == status)).withColumn("_n", F.row_number().over(Window.partitionBy("stratum").orderBy(order)))
    return placed.where(F.col("_n") <= max(1, limit // 3)).orderBy(order).limit(limit).select("id", "stratum")


def low_confidence(extractions: DataFrame, limit: int = 20, below: float = 0.7, status: str = "pending") -> DataFrame:
    """The least sure entities with 50 characters around them; ties by document and place."""
    e = extractions.where(F.col("status") == status).select("id", "text", F.explode("entities").alias("e")).where(F.col("e.score") < below)
    start = F.greatest(F.col("e.start") - 50, F.lit(0))
    around = F.substring(F.col("text"), start + 1, F.col("e.end") + 50 - start)
    return e.select("id", F.col("e.text").alias("entity"), F.col("e.label").alias("label"), F.col("e.start").alias("start"), F.col("e.score").alias("score"), around.alias("context")).orderBy("score", "id", "start").limit(limit)


def expired(extractions: DataFrame, now: str, days: int = 30) -> DataFrame:
    cutoff = F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days")
    return extractions.where((F.col("status") == "verified") & (F.col("created_at") < cutoff))


def retained(extractions: DataFrame, now: str, days: int = 30) -> DataFrame:
    """What a daily clean-up keeps; unknown status or time stays."""
    cutoff = F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days")
    return extractions.where(~F.coalesce((F.col("status") == "verified") & (F.col("created_at") < cutoff), F.lit(False)))
