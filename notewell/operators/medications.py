"""Medication records: a drug owns every entity up to the next drug of its note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from .entities import clean_drug_name, contains_any, known_word, valid_drug


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def parse_line(text: Column) -> Column:
    """struct<strength, frequency, duration, route> from a piece of text; null where there is none."""
    low = F.trim(F.lower(text))
    unit = F.regexp_extract(low, rules.LINE_STRENGTH, 2)
    strength = F.concat(_found(low, rules.LINE_STRENGTH, 1), F.lit(" "), F.when(unit.isin("fre", "q"), "mg").otherwise(unit))
    word = F.regexp_extract(low, rules.LINE_STRENGTH_WORD, 2)
    by_word = F.when(word.isin(*rules.LINE_STRENGTH_UNITS), F.concat(F.regexp_extract(low, rules.LINE_STRENGTH_WORD, 1), F.lit(" "), word))
    lasting = F.regexp_extract(low, rules.LINE_DURATION, 2)
    duration = F.concat(_found(low, rules.LINE_DURATION, 1), F.lit(" "), F.when(lasting == "seg", "days").otherwise(lasting))
    return F.struct(
        F.coalesce(strength, by_word).alias("strength"),
        F.coalesce(*[_found(low, p) for p in rules.LINE_FREQUENCIES]).alias("frequency"),
        F.coalesce(duration, _found(low, rules.LINE_DURATION_UNIT)).alias("duration"),
        _found(low, rules.LINE_ROUTE).alias("route"),
    )


def group_medications(spans: DataFrame, vocabulary: rules.Vocabulary, doc: str = "doc_id", text: str = "doc_text") -> DataFrame:
    """(doc, med_no, drug, strength, dosage, frequency, duration, route, form) from exploded spans (doc, text, label, start, end, score, document text).

    Each attribute is the first of the segment that isn't null. Names that are no drugs, and weak ones in a context that is not medical, are left out.
    """
    w = Window.partitionBy(doc).orderBy("start", F.col("end").desc())
    is_drug = F.col("label") == "DRUG"
    own, p, place = F.trim("text"), parse_line(F.trim("text")), F.struct("start", (-F.col("end")).alias("e"))
    of = lambda label: F.when(F.col("label") == label, own)
    values = {
        "strength": F.coalesce(of("STRENGTH"), p["strength"]),
        "dosage": F.when(~F.regexp_like(own, F.lit("(?i)" + rules.LINE_DURATION_UNIT)), of("DOSAGE")),
        "frequency": F.coalesce(p["frequency"], of("FREQUENCY")),
        "duration": F.coalesce(p["duration"], of("DURATION")),
        "route": F.coalesce(p["route"], of("ROUTE")),
        "form": of("FORM"),
    }
    numbered = spans.withColumn("med_no", F.sum(is_drug.cast("int")).over(w)).where("med_no > 0")
    valued = numbered.select(doc, "med_no", place.alias("_at"), is_drug.alias("_drug"), F.when(is_drug, clean_drug_name(F.col("text"), vocabulary)).alias("name"), "start", "end", "score", F.when(is_drug, F.col(text)).alias("_doc"), *[v.alias(k) for k, v in values.items()])
    head = F.min_by(F.struct("name", "start", "end", "score", "_doc"), F.when(F.col("_drug"), F.col("_at")))
    first = [F.min_by(k, F.when(F.col(k).isNotNull(), F.col("_at"))).alias(k) for k in values]
    meds = valued.groupBy(doc, "med_no").agg(head.alias("h"), *first)
    meds = meds.withColumn("drug", F.col("h.name")).where(valid_drug(F.col("drug"), vocabulary))
    before = F.lower(F.substring(F.col("h._doc"), F.greatest(F.col("h.start") - 10, F.lit(0)) + 1, F.least(F.col("h.start"), F.lit(10))))
    after = F.lower(F.substring(F.col("h._doc"), F.col("h.end") + 1, F.lit(10)))
    both = F.lit(False)
    for k in rules.NON_MEDICAL_CONTEXT:
        both = both | (before.contains(k) & after.contains(k))
    weak = (F.coalesce(F.col("h.score"), F.lit(1.0)) < 0.9) & (F.coalesce(F.col("h.score"), F.lit(1.0)) > 0)
    low = F.lower("drug")
    has = F.coalesce("frequency", "duration", "dosage", "strength", "form").isNotNull()
    meds = meds.where(~(weak & (contains_any(low, rules.NON_MEDICAL_CONTEXT) | both)) & (has | known_word(low, vocabulary) | (F.length("drug") >= 6)))
    return meds.select(doc, F.col("med_no").cast("int").alias("med_no"), "drug", *values)


def standard_line() -> Column:
    """``drug strength dosage (form) - frequency for duration via route`` over the columns of a medication."""
    part = lambda a, c, b="": F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(a), F.col(c), F.lit(b))).otherwise("")
    return F.concat(F.coalesce("drug", F.lit("Unknown Medication")), part(" ", "strength"), part(" ", "dosage"), part(" (", "form", ")"), part(" - ", "frequency"), part(" for ", "duration"), part(" via ", "route"))


def standard_text(meds: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, standardized): the lines of a note's medications in order. A note's medications are few, so the list is bounded by the note."""
    lines = meds.select(doc, F.struct("med_no", standard_line().alias("line")).alias("x"))
    return lines.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("standardized"))


def display() -> Column:
    return F.concat(F.col("drug"), F.lit(" ("), F.coalesce("strength", F.lit("")), F.lit(") - "), F.coalesce("frequency", F.lit("")), F.lit(" for "), F.coalesce("duration", F.lit("")))
