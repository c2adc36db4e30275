"""Text normalisation and repair as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it (higher-order functions don't share common parts)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chain(text: Column, steps: list[tuple[str, str]], ignore_case: bool = False) -> Column:
    """Apply replacements in order; ``{n}`` in a replacement is the n-th group."""
    for pattern, new in steps:
        text = F.regexp_replace(text, ("(?i)" if ignore_case else "") + pattern, re.sub(r"\{(\d)\}", r"$\1", new))
    return text


def squeeze(text: Column, pattern: str = " {2,}") -> Column:
    return F.trim(F.regexp_replace(text, pattern, " "))


def unit_split(text: Column) -> Column:
    """``500mg`` becomes ``500 mg``."""
    return F.regexp_replace(text, r"(?i)(\d+)(mg|ml|g|mcg|iu|units?)\b", "$1 $2")


def preprocess(text: Column, corrections: list[tuple[str, str]] | None = None) -> Column:
    """Learned corrections (literal, any case), shorthand, units, joined camel case, ``##`` and blanks."""
    for wrong, right in corrections or []:
        text = F.regexp_replace(text, "(?i)" + re.escape(wrong), re.sub(r"([\\$])", r"\\\1", right))
    text = unit_split(chain(text, rules.SHORTHAND, True))
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), "##", ""), "[ \t]+", " "))


def expand_shorthand(text: Column) -> Column:
    return chain(text, rules.SHORTHAND, True)


def strip_labels(text: Column) -> Column:
    """Take entity labels out of words, then those that stand alone, label by label; texts without a label's letters skip its patterns."""

    def without(t: Column, label: Column) -> Column:
        joined = F.regexp_replace(t, F.concat(F.lit(r"(\w*)"), label, F.lit(r"(\w*)")), F.lit("$1$2"))
        alone = F.regexp_replace(joined, F.concat(F.lit(r"\s*\b"), label, F.lit(r"\b\s*")), F.lit(" "))
        return F.when(t.contains(label), alone).otherwise(t)

    return squeeze(F.aggregate(F.array(*[F.lit(x) for x in rules.TEXT_LABELS]), F.coalesce(text, F.lit("")), without))


def clean_ocr(text: Column) -> Column:
    return squeeze(chain(strip_labels(text), rules.HANDWRITING, True))


def ocr_cleanup(text: Column, mode: str = "compat") -> Column:
    """OCR repairs before extraction. ``compat`` strips labels and unit slips anywhere; ``strict`` only whole upper-case words, and after a digit."""
    text = F.regexp_replace(text, f"(?i)({rules.OCR_LABELS})" if mode == "compat" else rf"\b({rules.OCR_LABELS})\b", " ")
    for wrong, right in rules.OCR_CORRECTIONS:
        unit = mode == "strict" and wrong in rules.OCR_UNIT_CORRECTIONS
        text = F.regexp_replace(text, ("(?i)(?<=[0-9])" if unit else "(?i)") + re.escape(wrong), right)
    text = chain(text, rules.OCR_PATTERNS)
    for phrase in rules.OCR_PHRASES:
        text = F.replace(text, F.lit(phrase), F.lit(""))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fix_broken_words(text: Column) -> Column:
    return chain(text, rules.BROKEN_WORDS)


def dosage_notation(text: Column) -> Column:
    return chain(text, rules.DOSAGE_NOTATION, True)


def normalise_ocr_tokens(text: Column) -> Column:
    return chain(text, rules.OCR_NORMALISE)


def compose_unicode(text: Column) -> Column:
    """NFKC; ASCII texts skip the Python worker's work."""
    @F.pandas_udf("string")
    def nfkc(values: pd.Series) -> pd.Series:
        return values.str.normalize("NFKC")

    return nfkc(text)


def normalise(text: Column, nfkc: bool = True) -> Column:
    """Single line feeds, composed characters, blanks, abbreviations, odd characters."""
    text = F.regexp_replace(text, r"(?<!\n)\n(?!\n)", " ")
    text = compose_unicode(text) if nfkc else text
    text = F.regexp_replace(F.regexp_replace(text, r"[\t\n\r]+", " "), r"\s+", " ")
    return F.trim(F.regexp_replace(chain(text, rules.ABBREVIATIONS, True), r"[^\w\s.,;:!?()\-%°/]", " "))


def classify(text: Column) -> Column:
    low, out = F.lower(text), F.lit("unknown")
    for name, words in reversed(rules.DOCUMENT_CLASSES):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def title(text: Column) -> Column:
    """Capital after any blank or hyphen, as words of drug names need."""
    return F.replace(F.initcap(F.replace(text, F.lit("-"), F.lit("- "))), F.lit("- "), F.lit("-"))


def text_quality(text: Column) -> Column:
    """0.4 for length up to 200, 0.3 for words up to 50, 0.3 for the share of quality words; 0 for an empty text."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    found = sum((F.lower(text).contains(w).cast("int") for w in rules.QUALITY_WORDS), F.lit(0))
    score = F.least(F.length(text) / 200.0, F.lit(1.0)) * 0.4 + F.least(words / 50.0, F.lit(1.0)) * 0.3 + found / float(len(rules.QUALITY_WORDS)) * 0.3
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0.0).otherwise(F.least(score, F.lit(1.0)))


def cache_key(version: Column, text: Column) -> Column:
    return F.concat(F.lit("ner:"), version, F.lit(":"), F.substring(F.sha2(text, 256), 1, 16))


def encode_result(result: Column) -> Column:
    """A cached result as JSON text; null fields are kept, so that it decodes to itself."""
    return F.to_json(result, {"ignoreNullFields": "false"})


def decode_result(cached: Column, schema: str) -> Column:
    """The result back; null where the cached text is null or no JSON, which counts as a miss."""
    got = F.from_json(cached, schema, {"mode": "PERMISSIVE"})
    return F.when(F.try_parse_json(cached).isNotNull(), got)


def json_block(text: Column) -> Column:
    """What stands from the first ``{`` to the last ``}``; null if there is none."""
    got = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(got != "", got)


def repair_json(text: Column) -> Column:
    """Quote bare keys, turn single quotes into double ones, drop trailing commas."""
    text = F.regexp_replace(text, r"(?<![\"\w])(\b[a-zA-Z_]\w*\b)\s*:", "\"$1\":")
    text = F.regexp_replace(text, r"(?<!\\)'", '"')
    return F.regexp_replace(F.regexp_replace(text, r",\s*\}", "}"), r",\s*\]", "]")
