"""Protected health information: detection, summaries, reports, redaction, masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from .spans import SPAN, spans


def service_findings(text: Column) -> Column:
    """Array of SPAN of ten case-sensitive patterns by type; overlaps stay. Names score 0.5, except for a few clinical pairs, which are none."""
    parts = []
    for k, (label, pattern) in enumerate(rules.PHI_SERVICE.items()):
        got = spans(text, pattern, label, 0.5 if label == "NAME" else 1.0, k)
        parts.append(F.filter(got, lambda s: ~F.lower(s["text"]).isin(*rules.NOT_NAMES)) if label == "NAME" else got)
    return F.concat(*parts)


def service_summary(notes: DataFrame, ident: str = "note_id", text: str = "text") -> DataFrame:
    """(type, findings, notes) over a table of notes."""
    found = notes.select(F.col(ident).alias("_n"), F.explode(service_findings(F.col(text))).alias("s"))
    return found.groupBy(F.col("s.label").alias("type")).agg(F.count("*").alias("findings"), F.countDistinct("_n").alias("notes"))


def is_free(text: Column) -> Column:
    return F.size(service_findings(text)) == 0


def detector_findings(text: Column) -> Column:
    """Seven patterns in any case, with a confidence that long findings raise; of overlapping ones the first stays unless a later one is surer."""
    parts = [F.transform(spans(text, p, label, c, k), lambda s: s.withField("score", F.least(s["score"] + F.when(F.length(s["text"]) > 20, 0.05).otherwise(0.0), F.lit(1.0)))) for k, (label, p, c) in enumerate(rules.PHI_DETECTOR)]
    ordered = F.array_sort(F.concat(*parts), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["layer"] - b["layer"]))
    empty = F.array().cast(f"array<{SPAN}>")

    def keep(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        surer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(s))
        return F.when((F.size(acc) == 0) | (s["start"] >= last["end"]), F.concat(acc, F.array(s))).when(s["score"] > last["score"], surer).otherwise(acc)

    return F.aggregate(ordered, empty, keep)


def mask(text: Column) -> Column:
    return F.when(F.length(text) > 6, F.concat(F.substring(text, 1, 3), F.lit("..."))).otherwise(text)


def risk(n: Column) -> Column:
    return F.when(n >= 5, "HIGH").when(n >= 2, "MEDIUM").otherwise("LOW")


def report(text: Column) -> Column:
    """struct<phi_detected, total_findings, phi_types, risk_level, findings, recommendation>."""
    found = detector_findings(text)
    kinds = F.array_distinct(F.transform(found, lambda s: s["label"]))
    counts = F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter(found, lambda s: s["label"] == k))))
    shown = F.transform(found, lambda s: F.struct(s["label"].alias("type"), mask(s["text"]).alias("text"), F.bround(s["score"], 2).alias("confidence")))
    n = F.size(found)
    return F.struct((n > 0).alias("phi_detected"), n.alias("total_findings"), counts.alias("phi_types"), risk(n).alias("risk_level"), shown.alias("findings"), F.when(n > 0, "Review and redact before sharing").otherwise("No PHI detected").alias("recommendation"))


def _replaced(text: Column, findings: Column, tag) -> Column:
    """Rebuild the text around findings in order of start; a finding that overlaps the one before is skipped."""
    ordered = F.array_sort(findings, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], b["end"] - a["end"]).otherwise(a["layer"] - b["layer"]))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, f: Column) -> Column:
        new = F.struct(f["end"].alias("at"), F.concat(s["out"], F.substring(text, s["at"] + 1, f["start"] - s["at"]), tag(f["label"])).alias("out"))
        return F.when(f["start"] >= s["at"], new).otherwise(s)

    return F.aggregate(ordered, zero, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def redact_tagged(text: Column) -> Column:
    return _replaced(text, service_findings(text), lambda k: F.concat(F.lit("["), k, F.lit("_REDACTED]")))


def redact_bracketed(text: Column) -> Column:
    return _replaced(text, detector_findings(text), lambda k: F.concat(F.lit("[REDACTED-"), k, F.lit("]")))
