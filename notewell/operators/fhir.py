"""FHIR-shaped resources from medications and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules


def dose_value(dosage: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(dosage, r"(\d+\.?\d*)", 1), F.lit("")).try_cast("double"), F.lit(0.0))


def dose_unit(dosage: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(dosage, r"(\d+\.?\d*)\s*([a-zA-Z]+)", 2), F.lit("")), F.lit("mg"))


def _coded(text: Column, table: list[tuple[str, str]], other: str) -> Column:
    low, out = F.lower(text), F.lit(other)
    for key, code in reversed(table):
        out = F.when(low.contains(key), code).otherwise(out)
    return out


def frequency_code(frequency: Column, mode: str = "strict") -> Column:
    """``strict`` tries the longest phrase first; ``compat`` in the listed order, where *daily* comes first."""
    table = rules.FREQUENCY_CODES if mode == "compat" else sorted(rules.FREQUENCY_CODES, key=lambda x: -len(x[0]))
    return _coded(frequency, table, "PRN")


def route_code(route: Column) -> Column:
    return _coded(route, rules.ROUTE_CODES, "26643006")


def medication_request(m: Column, mode: str = "strict") -> Column:
    """MedicationRequest of a medication struct. ``compat`` has timing and route only with a dosage."""
    lit = F.lit
    dose = F.struct(dose_value(m["dosage"]).alias("value"), dose_unit(m["dosage"]).alias("unit"), lit("http://unitsofmeasure.org").alias("system"), dose_unit(m["dosage"]).alias("code"))
    coding = lambda system, code, shown: F.struct(F.array(F.struct(lit(system).alias("system"), code.alias("code"), shown.alias("display"))).alias("coding"))
    timing = F.when(m["frequency"].isNotNull(), F.struct(coding("http://terminology.hl7.org/CodeSystem/v3-GTSAbbreviation", frequency_code(m["frequency"], mode), m["frequency"]).alias("code")))
    route = F.when(m["route"].isNotNull(), coding("http://snomed.info/sct", route_code(m["route"]), m["route"]))
    one = F.struct(m["dosage"].alias("text"), F.when(m["dosage"].isNotNull(), F.array(F.struct(dose.alias("doseQuantity")))).alias("doseAndRate"), timing.alias("timing"), route.alias("route"))
    present = m["dosage"].isNotNull() if mode == "compat" else F.coalesce(m["dosage"], m["frequency"], m["route"]).isNotNull()
    concept = F.struct(F.array(F.struct(lit("http://www.nlm.nih.gov/research/umls/rxnorm").alias("system"), lit("").alias("code"), m["drug"].alias("display"))).alias("coding"), m["drug"].alias("text"))
    return F.struct(lit("MedicationRequest").alias("resourceType"), lit("active").alias("status"), lit("order").alias("intent"), concept.alias("medicationCodeableConcept"), F.filter(F.array(F.when(present, one)), lambda x: x.isNotNull()).alias("dosageInstruction"))


def _status(value: tuple[str, str, str]) -> Column:
    system, code, shown = map(F.lit, value)
    return F.struct(F.array(F.struct(system.alias("system"), code.alias("code"), shown.alias("display"))).alias("coding"))


def condition(e: Column) -> Column:
    """Condition of a disease entity: active and confirmed."""
    return F.struct(F.lit("Condition").alias("resourceType"), _status(rules.CONDITION_ACTIVE).alias("clinicalStatus"), _status(rules.CONDITION_CONFIRMED).alias("verificationStatus"), F.struct(e["text"].alias("text")).alias("code"))


def observation(e: Column) -> Column:
    """Observation of a lab entity, whose text is both what was observed and its value."""
    return F.struct(F.lit("Observation").alias("resourceType"), F.lit("final").alias("status"), F.struct(e["text"].alias("text")).alias("code"), e["text"].alias("valueString"))


def bundle(notes: DataFrame, doc: str = "doc_id", meds: str = "meds", entities: str = "entities", mode: str = "strict") -> DataFrame:
    """(doc, n_medication, n_condition, n_observation, bundle): JSON of a transaction bundle, medications first, then diseases, then labs."""
    entry = lambda r, url: F.to_json(F.struct(r.alias("resource"), F.struct(F.lit("POST").alias("method"), F.lit(url).alias("url")).alias("request")))
    requests = F.transform(meds, lambda m: entry(medication_request(m, mode), "MedicationRequest"))
    conditions = F.transform(F.filter(entities, lambda e: e["label"] == "DISEASE"), lambda e: entry(condition(e), "Condition"))
    labs = F.transform(F.filter(entities, lambda e: e["label"] == "LAB"), lambda e: entry(observation(e), "Observation"))
    body = F.concat(F.lit('{"resourceType":"Bundle","type":"transaction","entry":['), F.array_join(F.concat(requests, conditions, labs), ","), F.lit("]}"))
    return notes.select(doc, F.size(requests).cast("long").alias("n_medication"), F.size(conditions).cast("long").alias("n_condition"), F.size(labs).cast("long").alias("n_observation"), body.alias("bundle"))


def normalise_drug(names: DataFrame, concepts: DataFrame, name: str = "name") -> DataFrame:
    """(name, rxcui, normalized_name, match): an exact concept name, else its synonym. concepts: rxcui, name, normalized_name, synonym."""
    exact = concepts.groupBy(F.lower("name").alias("_k")).agg(F.min_by(F.struct("rxcui", "normalized_name"), "rxcui").alias("x"))
    near = concepts.where("synonym is not null").groupBy(F.lower("synonym").alias("_s")).agg(F.min_by(F.struct("rxcui", "normalized_name"), "rxcui").alias("y"))
    out = names.withColumn("_k", F.lower(F.trim(name))).join(exact, "_k", "left").join(near, F.col("_k") == F.col("_s"), "left")
    return out.select(name, F.coalesce("x.rxcui", "y.rxcui").alias("rxcui"), F.coalesce("x.normalized_name", "y.normalized_name").alias("normalized_name"), F.when(F.col("x").isNotNull(), "exact").when(F.col("y").isNotNull(), "approximate").otherwise("none").alias("match"))


def interactions(meds: DataFrame, known: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, a, b, severity): known pairs (rxcui_a < rxcui_b, severity) among the concepts of a document (doc, rxcui)."""
    one = meds.where("rxcui is not null").select(doc, F.col("rxcui").alias("a")).distinct()
    first = one.join(known, F.col("a") == F.col("rxcui_a")).select(doc, "a", F.col("rxcui_b").alias("b"), "severity")
    return first.join(one.select(doc, F.col("a").alias("b")), [doc, "b"]).select(doc, "a", "b", "severity")
