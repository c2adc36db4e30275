"""Writers: Parquet and JSON tables, inserts with ids, status updates, retention, audit lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.review import retained


def write_entities(docs: DataFrame, path: str, entities, name: str = "entities") -> None:
    """The input with its entities, replacing what the path held."""
    docs.withColumn(name, entities).write.mode("overwrite").parquet(path)


def insert(rows: DataFrame, path: str, ident: str = "id") -> None:
    """Append rows as pending, with ids that no row of the table has. Ids ascend, with gaps between partitions."""
    spark = rows.sparkSession
    try:
        top = spark.read.parquet(path).agg(F.max(ident)).first()[0]
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        top = None
    rows.withColumn("status", F.lit("pending")).withColumn(ident, F.monotonically_increasing_id() + F.lit((-1 if top is None else top) + 1)).write.mode("append").parquet(path)


def update_status(table: DataFrame, results: DataFrame, ident: str = "id") -> DataFrame:
    """The table with new statuses from (id, status, error): unknown ids are dropped, rows without a result stay as they are."""
    new = results.select(ident, F.col("status").alias("_s"), F.col("error").alias("_e"))
    kept = [c for c in table.columns if c not in ("status", "error")]
    return table.join(new, ident, "left").select(*kept, F.coalesce("_s", "status").alias("status"), F.coalesce("_e", "error" if "error" in table.columns else F.lit(None).cast("string")).alias("error"))


def apply_retention(spark: SparkSession, source: str, target: str, now: str, days: int = 30) -> None:
    """Write what is kept to a new path; the caller swaps the paths, so a failed run leaves the source whole."""
    retained(spark.read.parquet(source), now, days).write.mode("overwrite").parquet(target)


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)
