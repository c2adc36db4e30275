"""Decisions over candidate texts of text recognition. The recognisers themselves are plug-ins (see ``slots``); the inputs here are their texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as texts
from ..functions.rules import COMMON_DRUGS

REPLY = "medications array<struct<raw_text:string,drug_name:string,strength:string,dose:string,frequency:string,duration:string,instructions:string,confidence:double>>, illegible boolean"


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(word_set(a), word_set(b)))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(word_set(a), word_set(b))) / union.cast("double"))


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def select(candidates: DataFrame) -> DataFrame:
    """(image_id, text, method, confidence, passes): the recogniser cascade over the columns of a candidate row.

    The language-vision text with a similar hybrid text wins, then that text alone, then the region text of more than 20 characters or the
    available texts joined by line feeds, then the handwriting model's text of more than 5 characters, else nothing.
    """
    vlm, easy, tess = _filled(F.col("vlm_text")), _filled(F.col("easyocr_text")), _filled(F.col("tesseract_text"))
    hybrid = F.coalesce(easy, tess)
    agreed = vlm.isNotNull() & hybrid.isNotNull() & (jaccard(vlm, hybrid) > 0.5)
    region = F.when(F.length("roi_text") > 20, F.col("roi_text"))
    available = F.array_compact(F.array(_filled(F.col("roi_text")), easy, tess))
    joined = F.when(F.size(available) > 0, F.coalesce(region, F.array_join(available, "\n")))
    hand = F.when(F.length("trocr_text") > 5, F.col("trocr_text"))
    choice = (
        F.when(agreed, F.struct(vlm.alias("text"), F.concat(F.lit("vlm_ensemble_"), F.coalesce("vlm_source", F.lit("unknown"))).alias("method"), F.lit(0.95).alias("confidence"), F.lit(2).alias("passes")))
        .when(vlm.isNotNull(), F.struct(vlm.alias("text"), F.concat(F.lit("vlm_"), F.coalesce("vlm_source", F.lit("unknown"))).alias("method"), F.lit(0.9).alias("confidence"), F.lit(1).alias("passes")))
        .when(joined.isNotNull(), F.struct(joined.alias("text"), F.lit("hybrid").alias("method"), F.lit(0.9).alias("confidence"), F.size(available).alias("passes")))
        .when(hand.isNotNull(), F.struct(hand.alias("text"), F.lit("handwriting").alias("method"), F.lit(0.85).alias("confidence"), F.lit(1).alias("passes")))
        .otherwise(F.struct(F.lit("").alias("text"), F.lit("none").alias("method"), F.lit(0.0).alias("confidence"), F.lit(0).alias("passes")))
    )
    return candidates.select("image_id", choice.alias("c")).select("image_id", "c.*")


def hundredths(share: Column) -> Column:
    """A share (0 to 1) in two digits, halves decided by the exact value of the double: 0.545 is a little more than that, 0.575 a little less."""
    halves = F.array(*[F.lit(round((2 * k + 1) / 200, 2)) for k in range(101)])
    k = F.floor(share * 100).cast("int")
    return F.when(share == (2 * k + 1) / F.lit(200.0), F.get(halves, k)).otherwise(F.bround(share, 2))


def pass_confidence(words: DataFrame) -> DataFrame:
    """(image_id, pass, mean_confidence, word_count) from (image_id, pass, pass_no, word, conf in percent); words without confidence don't count."""
    good = F.when(F.col("conf") > 0, F.col("conf"))
    return words.groupBy("image_id", "pass", "pass_no").agg(F.coalesce(hundredths(F.avg(good) / 100.0), F.lit(0.0)).alias("mean_confidence"), F.count(good).alias("word_count"))


def best_pass(passes: DataFrame) -> DataFrame:
    """The pass with the highest mean confidence of each image, the first of equals."""
    best = F.max_by(F.struct("pass", "mean_confidence", "word_count"), F.struct("mean_confidence", -F.col("pass_no")))
    return passes.groupBy("image_id").agg(best.alias("b")).select("image_id", "b.*")


def fallback(passes: DataFrame, below: float = 0.8) -> DataFrame:
    """(image_id, text, method, confidence, fallback_triggered, fallback_reason): the second recogniser's text where the best pass is unsure.

    passes: image_id, text, mean_confidence, and other_text, what the second recogniser read (null where it is absent or failed). Its text counts
    from more than 10 characters, cleaned and normalised; otherwise the pass itself stays, unmarked.
    """
    used = (F.coalesce("mean_confidence", F.lit(0.0)) < below) & (F.length(F.trim("other_text")) > 10)
    used = F.coalesce(used, F.lit(False))
    reason = F.concat(F.lit("tesseract_confidence_"), F.format_string("%.2f", F.coalesce("mean_confidence", F.lit(0.0))), F.lit(f"_below_{below}"))
    read = F.when(used, texts.normalise(texts.clean_ocr(F.col("other_text")))).otherwise(F.col("text"))
    return passes.select("image_id", read.alias("text"), F.when(used, "glm_ocr_fallback").otherwise("multi_pass").alias("method"), F.when(used, 0.9).otherwise(F.col("mean_confidence")).alias("confidence"), used.alias("fallback_triggered"), F.when(used, reason).alias("fallback_reason"))


def prescription_of(reply: Column) -> Column:
    """(text, medications, error) from a vision model's reply: drug names corrected, frequencies written out, labels taken out of the raw texts, which
    are joined by blanks. A reply without a JSON object gives an error and no medications."""
    block = texts.json_block(reply)

    def read(m: Column) -> Column:
        filled = lambda c, fix: F.when(F.length(c) > 0, fix(c)).otherwise(c)
        return m.withField("frequency", filled(m["frequency"], texts.dosage_notation)).withField("raw_text", filled(m["raw_text"], texts.clean_ocr))

    found = F.coalesce(F.from_json(block, REPLY)["medications"], F.from_json(F.lit('{"medications": []}'), REPLY)["medications"])
    names = closest_common_drugs(F.transform(found, lambda m: m["drug_name"]))
    meds = texts.let(F.struct(found.alias("m"), names.alias("d")), lambda x: F.transform(x["m"], lambda m, i: read(m).withField("drug_name", F.get(x["d"], i))))
    joined = F.array_join(F.transform(meds, lambda m: F.coalesce(m["raw_text"], F.lit(""))), " ")
    bad = F.when(block.isNull(), "No JSON object found in text").when(F.from_json(block, "map<string,string>").isNull(), "Invalid JSON")
    return F.struct(joined.alias("text"), meds.alias("medications"), bad.alias("error"))


def word_confidence(words: DataFrame) -> DataFrame:
    return words.groupBy("image_id", "word").agg(F.max("conf").alias("conf"))


def merge_lines(profile: DataFrame, share: float = 0.1, least: int = 10, gap: int = 15, pad: int = 10) -> DataFrame:
    """(image_id, top, bottom): text lines from row sums (image_id, row_no, value): runs above a share of the image's maximum, merged over small gaps."""
    peak = profile.groupBy("image_id").agg(F.max("value").alias("peak"))
    w = Window.partitionBy("image_id").orderBy("row_no")
    on = profile.join(peak, "image_id").where(F.col("value") > share * F.col("peak"))
    runs = on.withColumn("_g", F.col("row_no") - F.row_number().over(w)).groupBy("image_id", "_g").agg(F.min("row_no").alias("a"), F.max("row_no").alias("b")).where(F.col("b") - F.col("a") + 1 >= least)
    v = Window.partitionBy("image_id").orderBy("a")
    joined = runs.withColumn("_new", F.when(F.col("a") - F.lag("b").over(v) < gap, 0).otherwise(1)).withColumn("_line", F.sum("_new").over(v))
    return joined.groupBy("image_id", "_line").agg(F.greatest(F.min("a") - pad, F.lit(0)).alias("top"), (F.max("b") + pad).alias("bottom")).drop("_line")


def regions(boxes: DataFrame, width: int, height: int, top: int = 12, used: int = 6) -> DataFrame:
    """(image_id, rank, x, y, w, h, processed): the largest boxes of at least 1500 pixels that don't fill the image."""
    area = F.col("w") * F.col("h")
    fit = boxes.where((area >= 1500) & ~((F.col("w") > 0.98 * width) & (F.col("h") > 0.98 * height)))
    ranked = fit.withColumn("rank", F.row_number().over(Window.partitionBy("image_id").orderBy(area.desc(), "y", "x")))
    return ranked.where(F.col("rank") <= top).select("image_id", "rank", "x", "y", "w", "h", (F.col("rank") <= used).alias("processed"))


def source_of(content_type: Column, confidence: Column) -> Column:
    """pdf, image_handwritten (confidence below 0.75; none and 0 count as 1), image_printed or text."""
    sure = F.coalesce(F.nullif(confidence, F.lit(0.0)), F.lit(1.0))
    return F.when(content_type == "application/pdf", "pdf").when(content_type.startswith("image/"), F.when(sure < 0.75, "image_handwritten").otherwise("image_printed")).otherwise("text")


def _closest(word: str) -> str:
    from difflib import get_close_matches

    return (get_close_matches(word, COMMON_DRUGS, n=1, cutoff=0.6) or [word])[0] if len(word) >= 3 else word


def closest_common_drugs(words: Column) -> Column:
    """``closest_common_drug`` for each word of an array; null and empty words stay."""
    @F.pandas_udf("array<string>")
    def closest(lists: pd.Series) -> pd.Series:
        seen: dict = {}
        return lists.map(lambda x: None if x is None else [w if not w else seen.setdefault(w, _closest(w)) for w in x])

    return closest(words)


def closest_common_drug(word: Column) -> Column:
    """The closest of the common drug names by Ratcliff-Obershelp similarity of at least 0.6, else the word itself."""
    @F.pandas_udf("string")
    def closest(words: pd.Series) -> pd.Series:
        return words.map({w: _closest(w) for w in words.dropna().unique()})

    return closest(word)
