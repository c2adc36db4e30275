"""Readers: tables by suffix, files routed by type, terms, batches of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.rules import Vocabulary


def read_any(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header (all strings unless a schema is given), JSON lines, ORC, plain text or, by default, Parquet, by the path's suffix."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    low = path.lower().rstrip("/")
    if low.endswith((".csv", ".csv.gz")):
        return reader.option("header", True).csv(path)
    if low.endswith((".json", ".jsonl", ".ndjson")):
        return reader.json(path)
    if low.endswith(".orc"):
        return reader.orc(path)
    if low.endswith(".txt"):
        return reader.text(path)
    return reader.parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 1) -> DataFrame:
    """A table over JDBC, in parallel ranges of a numeric column if one is named. The driver's jar must be on the class path."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if column:
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, text, content, error): files of a folder, routed by the type that their suffix stands for."""
    raw = spark.read.format("binaryFile").load(path)
    low = F.lower("path")
    kind = F.when(low.endswith(".pdf"), "application/pdf").when(low.rlike(r"\.(png|jpe?g|gif|bmp|tiff?|webp)$"), "image/any").otherwise("text/plain")
    return routed(raw.select("path", "content", kind.alias("content_type"))).select("path", "kind", "text", "content", "error")


def routed(files: DataFrame, content: str = "content", content_type: str = "content_type") -> DataFrame:
    """``files`` with kind, text and error, by MIME type: texts (all but PDF and images; also of no type) decoded as UTF-8, else an error, and no
    longer held as bytes; PDF and image bytes left for a plug-in. Null content of a text has neither text nor error."""
    kind = F.when(F.col(content_type) == "application/pdf", "pdf").when(F.col(content_type).startswith("image/"), "image").otherwise("text")
    text = F.try_validate_utf8(F.col(content).cast("string"))
    out = files.withColumn("kind", kind).withColumn("text", F.when(F.col("kind") == "text", text))
    out = out.withColumn("error", F.when((F.col("kind") == "text") & F.col("text").isNull() & F.col(content).isNotNull(), "not UTF-8"))
    return out.withColumn(content, F.when(F.col("kind") != "text", F.col(content)))


def needs_ocr(page_text) -> "F.Column":
    """Whether a document's extracted text is too short to be more than a scan."""
    return F.length(F.trim(page_text)) < 50


def read_terms(spark: SparkSession, path: str, column: str = "term") -> Vocabulary:
    """A vocabulary from a table of terms. It becomes part of the plan, so it is meant for thousands of terms, not millions."""
    terms = [r[0] for r in read_any(spark, path).select(F.lower(F.trim(column)).alias("t")).where("t <> ''").distinct().orderBy("t").toLocalIterator()]
    return Vocabulary(drugs=terms)


def with_columns(df: DataFrame, wanted: dict[str, tuple[str, object]]) -> DataFrame:
    """Add the columns that a table lacks, with their types and defaults."""
    for name, (kind, default) in wanted.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(default).cast(kind))
    return df


def valid_texts(df: DataFrame, text: str = "text", longest: int = 50_000) -> DataFrame:
    return df.where((F.trim(text) != "") & (F.length(text) <= longest))
