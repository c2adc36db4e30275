"""The corpus pipeline: language identification, line de-duplication, near de-duplication, benchmark decontamination, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewell.llm import decontaminate, language_id, line_dedup, near_dup, packing
from notewell.llm.runtime import cut, erase, key_filter, maybe_in, scratch, table

#: Documents whose language is less sure than this are rejected, as are those without a letter.
LEAST_SURE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the labelled rows; reject texts that are null, have no letter or are not surely in one language. Labels are not read to judge."""
    judged = language_id.predict(docs, language_id.fit(docs))
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SURE)).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take recurring lines out of the texts; n_chars follows the new text. A document that held nothing but lines of earlier documents goes."""
    out = line_dedup.drop_recurring(docs, exact=2).where((F.size("dropped") == 0) | F.col("text").rlike(r"\S"))
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8; the smallest doc_id of each group stays, once. Documents without words all stay, null texts too.

    Which rows go is decided on ids and hashes; the texts are shuffled once, to take those rows out. Rows that repeat both id and text count as
    copies: the one that sorts first by its other columns stays. Extra columns are kept whatever their names; an empty table stays empty.
    """
    ident = F.struct(F.col("doc_id").alias("i"), F.xxhash64("text").alias("h"))
    judged = near_dup.link(docs.select(ident.alias("k"), "text"), k=5, threshold=0.8, ident="k").groupBy("k").agg(F.max("n_shingles").alias("n"), F.max("kept").alias("kept"), F.count("*").alias("rows"))
    odd = cut(judged.where("n > 0 and (not kept or rows > 1)").select(F.xxhash64("k").alias("key"), "k", "kept"))
    rows = docs.select(F.struct("*").alias("d"), ident.alias("k"))
    out = rows.join(odd, "k", "left_anti").select("d")
    repeated = odd.where("kept")
    if not repeated.isEmpty():
        few = maybe_in(rows.withColumn("key", F.xxhash64("k")), "key", key_filter(repeated.select("key"))).drop("key")
        out = out.unionByName(few.join(repeated.select("k"), "k").groupBy("k").agg(F.min("d").alias("d")).select("d"))
    return out.select("d.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, with their ids."""
    return packing.pack(docs, 1024)


STAGES = [
    ("language id", identify_language),
    ("line dedup", drop_repeated_lines),
    ("near dedup", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can't express the stages; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``. What a stage leaves is written to the shared checkpoint folder and goes when the next one is written.

    The last stage's input goes when the session ends; after a failure nothing stays.
    """
    docs, old = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = scratch(spark)
        try:
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        except BaseException:
            erase(spark, path)
            raise
        finally:
            if old:
                erase(spark, old)
        docs, old = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
