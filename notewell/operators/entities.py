"""Entity clean-up on arrays of spans: relabel, split, filter noise, clean names, merge neighbours, drop duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import let, title
from .spans import SPAN, closest_terms


def one_of(value: Column, words: list[str]) -> Column:
    return value.isin(*words)


def contains_any(value: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | value.contains(w)
    return out


def known_word(word: Column, vocabulary: rules.Vocabulary) -> Column:
    return word.isin(*sorted({*vocabulary.drugs, *vocabulary.brands}))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def span(text: Column, label: Column, start: Column, end: Column, like: Column) -> Column:
    return F.struct(text.alias("text"), label.alias("label"), start.alias("start"), end.alias("end"), like["score"].alias("score"), like["layer"].alias("layer")).cast(SPAN)


def relabelled(e: Column, vocabulary: rules.Vocabulary) -> Column:
    """(text, label) after the ordered corrections; a branch that matches ends its chain even if it changes nothing."""
    low, label = F.lower(e["text"]), F.when(F.lower(e["label"]) == "dosage form", "FORM").otherwise(e["label"])
    starts = lambda p: F.regexp_like(low, F.lit("^(?:" + p + ")"))
    strength = starts(r"\d+\s*(mg|ml|g|mcg|µg|iu|mmol|meq|units?)\b") & ~contains_any(low, rules.FREQ_WORDS)
    merged = starts(r"\d+[a-z]+")
    is_freq = F.regexp_like(low, F.lit(r"^[^0-9a-z]*\d+[^0-9a-z]*(freq|frequency)[^0-9a-z]*$"))
    timed = starts(r"\d\s*-\s*\d\s*-\s*\d\s*x\s*\d+")
    first = (
        F.when(strength, F.when(contains_any(low, rules.DOSE_FORMS), label).otherwise("STRENGTH"))
        .when(starts(r"\d+\s*(tablet|tab|capsule|cap|sachet|puff|drop|suppository|patch)s?\b"), "DOSAGE")
        .when(starts(r"\d+\s*(tsp|tbsp|ml|teaspoon|tablespoon)\b"), "DOSAGE")
        .when(merged, F.when(is_freq, "DOSAGE").otherwise(label))
        .when(timed, "FREQUENCY")
        .when(starts(r"\d+\s*(days?|weeks?|months?)"), "DURATION")
        .when(starts(r"\d-\d-\d"), "FREQUENCY")
        .otherwise(label)
    )
    earlier = strength | starts(r"\d+\s*(tablet|tab|capsule|cap|sachet|puff|drop|suppository|patch)s?\b") | starts(r"\d+\s*(tsp|tbsp|ml|teaspoon|tablespoon)\b")
    text = F.when(~earlier & merged & is_freq, F.regexp_extract(low, r"\d+", 0)).when(~earlier & ~merged & timed, F.regexp_replace(F.regexp_extract(low, r"\d\s*-\s*\d\s*-\s*\d", 0), " ", "")).otherwise(e["text"])
    was_route = F.lower(label) == "route"
    second = (
        F.when(was_route & F.exists(words_of(low), lambda w: known_word(w, vocabulary)), "DRUG")
        .when(was_route & (first == "ROUTE") & ~one_of(low, rules.ROUTE_WORDS), "DRUG")
        .when(~was_route & one_of(low, rules.ROUTE_WORDS), "ROUTE")
        .when(~was_route & one_of(low, rules.FORM_WORDS), "FORM")
        .otherwise(first)
    )
    return F.struct(text.alias("text"), second.alias("label"))


def relabel(entities: Column, vocabulary: rules.Vocabulary) -> Column:
    """Correct labels, and split a form word off the known drug that follows it."""

    def fix(e: Column) -> Column:
        return let(relabelled(e, vocabulary), lambda new: parted(e, new))

    def parted(e: Column, new: Column) -> Column:
        out = span(new["text"], new["label"], e["start"], e["end"], e)
        low = F.lower(e["text"])
        lead = F.coalesce(*[F.when(low.startswith(w + " "), w) for w in rules.LEADING_FORMS])
        n = F.length(lead)
        rest = F.trim(F.substring(low, n + 1, F.length(low)))
        form = span(F.substring(e["text"], F.lit(1), n), F.lit("FORM"), e["start"], e["start"] + n, e)
        drug = span(F.trim(F.substring(e["text"], n + 1, F.length(low))), F.lit("DRUG"), e["start"] + n + 1, e["end"], e)
        return F.when((out["label"] == "DRUG") & lead.isNotNull() & known_word(rest, vocabulary), F.array(form, drug)).otherwise(F.array(out))

    return F.flatten(F.transform(entities, fix))


def split_mixed(entities: Column) -> Column:
    """One entity that holds a duration and a frequency becomes two."""

    def cut(e: Column) -> Column:
        low = F.lower(e["text"])
        unit = F.regexp_extract(low, rules.LINE_DURATION, 2)
        duration = F.concat(F.regexp_extract(low, rules.LINE_DURATION, 1), F.lit(" "), F.when(unit == "seg", "days").otherwise(unit))
        often = F.regexp_extract(low, rules.MIXED_FREQUENCY, 0)
        both = F.array(span(duration, F.lit("DURATION"), e["start"], e["start"] + F.length(duration), e), span(often, F.lit("FREQUENCY"), e["start"] + F.length(low) - F.length(often), e["end"], e))
        return F.when((unit != "") & (often != ""), both).otherwise(F.array(e))

    return F.flatten(F.transform(entities, cut))


def valid_drug(name: Column, vocabulary: rules.Vocabulary) -> Column:
    def judge(low: Column, words: Column) -> Column:
        known = F.exists(words, lambda w: known_word(w, vocabulary))
        vague = F.exists(words, lambda w: one_of(w, rules.ROUTE_DESCRIPTORS) | one_of(w, rules.GENERIC_CLASSES))
        return (
            F.when(name.isNull() | (F.length(name) < 3), False)
            .when(known_word(low, vocabulary), True)
            .when(contains_any(low, rules.DRUG_BANNED), False)
            .when(one_of(low, rules.DRUG_NOISE), False)
            .when(vague & ~known, False)
            .when(one_of(low, rules.ROUTE_DESCRIPTORS + rules.GENERIC_CLASSES), False)
            .when(known, True)
            .otherwise(F.length(name) >= 4)
        )

    return let(F.trim(F.lower(name)), lambda low: let(words_of(low), lambda words: judge(low, words)))


def is_noise(e: Column, vocabulary: rules.Vocabulary) -> Column:
    text = F.trim(e["text"])
    low, score = F.lower(text), F.coalesce(e["score"], F.lit(1.0))
    words = words_of(text)
    broad = e["label"].isin("CANCER", "DISEASE", "ANATOMY")
    known = low.isin(*vocabulary.drugs)
    return (
        text.contains("##")
        | ((F.length(text) < 3) & ~one_of(low, rules.KEEP_SHORT))
        | F.regexp_like(text, F.lit(r"^\d+$"))
        | one_of(low, rules.NON_MEDICAL)
        | one_of(low, rules.NOISE_FRAGMENTS)
        | (broad & (contains_any(low, rules.NON_CLINICAL) | ((F.size(words) >= 4) & ~F.exists(words, lambda w: F.lower(w).isin(*vocabulary.drugs)))))
        | (F.regexp_like(low, F.lit("^[bcdfghjklmnpqrstvwxyz]{2,}$")) & ~known & ~one_of(low, rules.KEEP_SHORT))
        | ((e["label"] == "DRUG") & (score < 0.9) & ~valid_drug(text, vocabulary))
        | F.regexp_like(low, F.lit("^[a-z]$"))
        | ((score < 0.6) & (score > 0))
    )


def drop_noise(entities: Column, vocabulary: rules.Vocabulary) -> Column:
    return F.filter(entities, lambda e: ~is_noise(e, vocabulary))


def _leading(words: Column, test) -> Column:
    """How many words from the first on pass a test."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
    return F.aggregate(words, zero, lambda s, w: F.struct((s["n"] + (s["on"] & test(w)).cast("int")).alias("n"), (s["on"] & test(w)).alias("on")), lambda s: s["n"])


def clean_drug_name(name: Column, vocabulary: rules.Vocabulary) -> Column:
    """Letters only; no form words in front nor fragments behind; the longest known word alone if there is one; brands by their generic name."""
    brand = F.create_map(*[F.lit(x) for kv in vocabulary.brands.items() for x in kv])

    def named(words: Column) -> Column:
        rest = F.array_join(F.slice(words, F.lit(2), F.size(words) + 1), " ")
        first = F.when(F.size(words) > 1, F.concat(F.try_element_at(brand, F.lower(F.get(words, F.lit(0)))), F.lit(" "), rest))
        clean = let(F.array_join(words, " "), lambda whole: F.coalesce(F.try_element_at(brand, F.lower(whole)), first, whole))
        return let(clean, lambda c: F.when(c == "", title(name)).otherwise(title(c)))

    def once(words: Column) -> Column:
        return F.filter(words, lambda w, i: (i == 0) | (F.lower(w) != F.lower(F.get(words, i - 1))))

    def best(words: Column) -> Column:
        longest = F.aggregate(F.filter(words, lambda w: known_word(F.lower(w), vocabulary)), F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
        return let(longest, lambda x: F.when(x != "", F.array(x)).otherwise(words))

    front = lambda words: F.slice(words, _leading(words, lambda w: one_of(F.lower(w), rules.NAME_PREFIXES)) + 1, F.size(words) + 1)
    back = lambda words: F.slice(words, F.lit(1), F.size(words) - _leading(F.reverse(words), lambda w: (F.length(w) <= 2) & ~one_of(F.lower(w), rules.NAME_SUFFIXES)))
    done = let(words_of(F.regexp_replace(name, r"[^a-zA-Z\s\-]", "")), lambda a: let(front(a), lambda b: let(back(b), lambda c: let(best(c), lambda d: let(once(d), named)))))
    return F.when(F.coalesce(F.length(name), F.lit(0)) == 0, "").otherwise(done)


def by_place(entities: Column) -> Column:
    """By start, longer first, then by layer and label, so that ties don't depend on the order of the input."""

    def order(a: Column, b: Column) -> Column:
        return F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], b["end"] - a["end"]).when(a["layer"] != b["layer"], a["layer"] - b["layer"]).when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0)

    return F.array_sort(entities, order)


def drop_duplicates(entities: Column) -> Column:
    """Keep spans by place unless they overlap a kept one or repeat a kept one's text and label; what repeats doesn't bar later ones."""
    empty = F.array().cast(f"array<{SPAN}>")

    def keep(acc: Column, e: Column) -> Column:
        bars = F.exists(acc, lambda k: ~((e["end"] <= k["start"]) | (e["start"] >= k["end"])) | ((F.trim(F.lower(k["text"])) == F.trim(F.lower(e["text"]))) & (k["label"] == e["label"])))
        return F.when(bars, acc).otherwise(F.concat(acc, F.array(e)))

    return F.aggregate(by_place(entities), empty, keep)


def merge_adjacent(spans: DataFrame, doc: str = "doc_id", text: str = "doc_text") -> DataFrame:
    """Runs of DRUG spans with only blanks or hyphens between them become one (the strict rule); exploded spans in, exploded spans out.

    Input columns: doc, text, label, start, end, score and the document's own text.
    """
    w = Window.partitionBy(doc).orderBy("start", "end")
    drugs = spans.where("label = 'DRUG'").withColumn("_before", F.lag("end").over(w))
    gap = F.substring(F.col(text), F.col("_before") + 1, F.col("start") - F.col("_before"))
    drugs = drugs.withColumn("_new", F.when(F.col("_before").isNull() | (F.col("start") < F.col("_before")) | ~F.regexp_like(gap, F.lit(r"^[\s\-]*$")), 1).otherwise(0))
    drugs = drugs.withColumn("_run", F.sum("_new").over(w))
    runs = drugs.groupBy(doc, "_run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), " ").alias("text"), F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score"))
    rest = spans.where("label <> 'DRUG'").select(doc, "text", "label", "start", "end", "score")
    return runs.select(doc, "text", F.lit("DRUG").alias("label"), "start", "end", "score").unionByName(rest)


def batch_merge(primary: DataFrame, secondary: DataFrame, doc: str = "doc_id") -> DataFrame:
    """All primary spans, and the secondary ones whose start no primary span has."""
    return primary.unionByName(secondary.join(primary.select(doc, "start").distinct(), [doc, "start"], "left_anti").select(*primary.columns))


def mapped(value: Column, table: dict[str, str], other: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value), other)


def label_of_model(label: Column) -> Column:
    return mapped(label, rules.LABEL_MAP, label)


def colour(label: Column) -> Column:
    return mapped(label, rules.COLOURS, F.lit(rules.OTHER_COLOUR))


def category(label: Column) -> Column:
    return mapped(label, rules.CATEGORIES, F.lit("entity"))


def confidence_band(score: Column) -> Column:
    return F.when(F.coalesce(score, F.lit(0.0)) == 0, "N/A").when(score >= 0.9, "High").when(score >= 0.7, "Medium").otherwise("Low")


def needs_review(score: Column, verified: Column) -> Column:
    """(below 0.8, below 0.9) of an unverified medication that has a confidence; zero counts as none."""
    open_ = ~F.coalesce(verified, F.lit(False)) & (F.coalesce(score, F.lit(0.0)) != 0)
    return F.struct((open_ & (score < 0.8)).alias("warn"), (open_ & (score < 0.9)).alias("ask"))


def display_label(label: Column) -> Column:
    return mapped(label, rules.DISPLAY_LABELS, label)


def of_bio_model(entities: Column) -> Column:
    """The anatomy and chemistry model's entities, without labels that other layers find better."""
    return F.filter(entities, lambda e: one_of(e["label"], rules.BIO_MODEL_LABELS))


def normalise_drug_names(names: DataFrame, vocabulary: rules.Vocabulary, name: str = "name") -> DataFrame:
    """(name, clean, fuzzy_matched) for each distinct name: cleaned, and where that is no known term, the most similar term of at least 75 instead.

    Works on distinct cleaned names, so the comparison with the vocabulary grows with the number of different unknown names.
    """
    clean = names.select(name).distinct().withColumn("clean", clean_drug_name(F.col(name), vocabulary)).withColumn("low", F.lower("clean"))
    best = closest_terms(clean.where(~F.coalesce(F.col("low").isin(*vocabulary.drugs), F.lit(True))), vocabulary, "low")
    out = clean.join(best, "low", "left")
    return out.select(name, F.coalesce(title(F.col("term")), F.col("clean")).alias("clean"), F.col("term").isNotNull().alias("fuzzy_matched"))


def normalise_entities(entities: Column, vocabulary: rules.Vocabulary) -> Column:
    """Cleaned names for DRUG spans."""
    return F.transform(entities, lambda e: F.when(e["label"] == "DRUG", span(clean_drug_name(e["text"], vocabulary), e["label"], e["start"], e["end"], e)).otherwise(e))


def pipeline(entities: Column, vocabulary: rules.Vocabulary) -> Column:
    return drop_duplicates(normalise_entities(drop_noise(split_mixed(relabel(by_place(entities), vocabulary)), vocabulary), vocabulary))


def highlight(notes: DataFrame, doc: str = "note_id", text: str = "text", spans: str = "spans") -> DataFrame:
    """Text in segments: what lies before each span, each span, and the tail. (doc, segment, start, piece, label)."""
    ends = F.concat(F.array(F.lit(0)), F.transform(F.col(spans), lambda s: s["end"]))
    gaps = F.transform(F.col(spans), lambda s, i: F.struct(F.get(ends, i).alias("start"), s["start"].alias("end"), F.lit(None).cast("string").alias("label")))
    own = F.transform(F.col(spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")))
    tail = F.array(F.struct(F.element_at(ends, -1).alias("start"), F.length(text).alias("end"), F.lit(None).cast("string").alias("label")))
    parts = F.filter(F.array_sort(F.concat(gaps, own, tail), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["end"] - b["end"])), lambda p: p["end"] > p["start"])
    return notes.select(doc, F.col(text), F.posexplode(parts).alias("segment", "p")).select(doc, "segment", F.col("p.start"), F.substring(F.col(text), F.col("p.start") + 1, F.col("p.end") - F.col("p.start")).alias("piece"), F.col("p.label"))
