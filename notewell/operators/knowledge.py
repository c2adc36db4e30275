"""Learning from verified extractions: differences, the knowledge table, and what extraction takes from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from .entities import category


def verify_diff(ai: DataFrame, human: DataFrame) -> DataFrame:
    """Human entities against the model's at the same place: unchanged, corrected or added. Entities: doc_id, start, end, text, label, seq.

    Of several model entities at a place the last counts; what humans removed is not reported.
    """
    last = Window.partitionBy("doc_id", "start", "end").orderBy(F.desc("seq"))
    build = ai.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("doc_id", "start", "end", F.col("text").alias("ai_text"), F.col("label").alias("ai_label"))
    kind = F.when(F.col("ai_text").isNull(), "added").when((F.col("ai_text") == F.col("text")) & (F.col("ai_label") == F.col("label")), "unchanged").otherwise("corrected")
    return human.join(build, ["doc_id", "start", "end"], "left").select("doc_id", "start", "end", "text", "label", "ai_text", "ai_label", kind.alias("change"))


def deltas(diff: DataFrame) -> DataFrame:
    """(term, corrected, category, extraction_id, seq) of corrected and added entities whose text has two characters or more."""
    term = F.substring(F.trim(F.lower(F.when(F.col("change") == "corrected", F.col("ai_text")).otherwise(F.col("text")))), 1, 200)
    kind = category(F.col("label"))
    value = F.when(kind == "entity", F.concat("text", F.lit("::"), "label")).otherwise(F.col("text"))
    changed = diff.where(F.col("change").isin("corrected", "added") & (F.length(F.trim("text")) >= 2))
    return changed.select(term.alias("term"), value.alias("corrected"), kind.alias("category"), F.col("doc_id").alias("extraction_id"), F.col("start").alias("seq")).where("length(term) >= 2")


def merge(current: DataFrame, delta: DataFrame) -> DataFrame:
    """The knowledge table after a set of deltas: last value by (extraction_id, seq), confidence plus the number of deltas, sources joined as sorted text.

    current: term, corrected, category, confidence, sources. One shuffle by term on each side, then a full outer join.
    """
    at = F.struct("extraction_id", "seq")
    new = delta.groupBy("term").agg(F.max_by(F.struct("corrected", "category"), at).alias("v"), F.count("*").alias("n"), F.collect_set(F.col("extraction_id").cast("string")).alias("ids"))
    old = F.when(F.coalesce(F.col("sources"), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("sources", ","))
    both = current.join(new, "term", "full_outer")
    ids = F.array_sort(F.array_union(F.coalesce(old, F.array().cast("array<string>")), F.coalesce("ids", F.array().cast("array<string>"))))
    return both.select(
        "term",
        F.coalesce("v.corrected", "corrected").alias("corrected"),
        F.coalesce("v.category", "category").alias("category"),
        (F.coalesce("confidence", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("confidence"),
        F.array_join(ids, ",").alias("sources"),
        F.col("v").isNotNull().alias("touched"),
        (F.col("confidence").isNull() & F.col("v").isNotNull()).alias("is_new"),
    )


def interpret(knowledge: DataFrame, least: int = 1) -> DataFrame:
    """(kind, term, value): corrections, drugs and entity labels that extraction uses. Labels don't become text corrections (the strict rule)."""
    k = knowledge.where(F.col("confidence") >= least)
    label = F.upper(F.element_at(F.split("corrected", "::", 2), 2))
    corrections = k.where(~F.col("corrected").contains("::") & (F.lower("corrected") != F.col("term"))).select(F.lit("correction").alias("kind"), "term", F.col("corrected").alias("value"))
    drugs = k.where("category = 'drug'").select(F.lit("drug").alias("kind"), "term", F.lower("corrected").alias("value"))
    labels = k.where("category = 'entity' and corrected like '%::%'").select(F.lit("label").alias("kind"), "term", label.alias("value"))
    return corrections.unionByName(drugs).unionByName(labels)


#: The most learned terms that a vocabulary may hold: it becomes part of the plan.
MOST_LEARNED = 20_000


def known_terms(knowledge: DataFrame, vocabulary: rules.Vocabulary) -> DataFrame:
    """(term, value): the vocabulary's terms (value null) and brands with what the knowledge adds: learned drugs and corrections, which replace brands."""
    spark = knowledge.sparkSession
    learned = interpret(knowledge)
    rows = [(t, None) for t in vocabulary.drugs] + list(vocabulary.brands.items())
    fixed = spark.createDataFrame(rows, "term string, value string")
    corrections = learned.where("kind = 'correction'").groupBy("term").agg(F.min("value").alias("value"))
    drugs = learned.where("kind = 'drug'").select(F.col("value").alias("term"), F.lit(None).cast("string").alias("value"))
    brands = fixed.where("value is not null").join(corrections, "term", "left_anti").unionByName(corrections)
    return fixed.where("value is null").unionByName(drugs).distinct().unionByName(brands)


def extended(knowledge: DataFrame, vocabulary: rules.Vocabulary) -> rules.Vocabulary:
    """The vocabulary with what was learned; an error if that is more than MOST_LEARNED terms."""
    rows = known_terms(knowledge, vocabulary).orderBy("term", "value").limit(MOST_LEARNED + len(vocabulary.drugs) + len(vocabulary.brands) + 1).collect()
    if len(rows) > MOST_LEARNED + len(vocabulary.drugs) + len(vocabulary.brands):
        raise ValueError("too many learned terms for a vocabulary")
    return rules.Vocabulary(drugs=sorted({r["term"] for r in rows if r["value"] is None}), brands={r["term"]: r["value"] for r in rows if r["value"] is not None})
