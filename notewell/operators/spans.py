"""Span extraction: every match of a pattern with its half-open character offsets, in one projection.

``regexp_extract_all`` gives the matches and ``split`` the text between them; running lengths of both give the offsets. Nothing is shuffled:
spans stay in an array of the note's row until a relational step explodes them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import rules
from ..functions.text import let
from .terms import Index, search

SPAN = "struct<text:string,label:string,start:int,end:int,score:double,layer:int>"


def spans(text: Column, pattern: str | Column, label: str | Column, score: float | Column, layer: int = 0, shown: Column | None = None) -> Column:
    """Array of SPAN for all matches; a pattern may not match an empty string. ``shown`` is the text to cut the spans from (same length), if another."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    name = F.lit(label) if isinstance(label, str) else label
    empty = F.array().cast(f"array<{SPAN}>")

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        part = F.substring(shown, start + 1, F.length(x["m"])) if shown is not None else x["m"]
        span = F.struct(part.alias("text"), name.alias("label"), start.alias("start"), end.alias("end"), (score if isinstance(score, Column) else F.lit(float(score))).alias("score"), F.lit(layer).alias("layer"))
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(span.cast(SPAN))).alias("out"))

    def placed(found: Column) -> Column:
        pairs = F.zip_with(found, F.slice(F.split(text, p, -1), F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
        return F.when(F.size(found) == 0, empty).otherwise(F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda s: s["out"]))

    return let(F.regexp_extract_all(text, p, F.lit(0)), placed)


def dosage_spans(text: Column) -> Column:
    return spans(F.lower(text), rules.DOSAGE, "DOSAGE", 1.0, 4, text)


def frequency_spans(text: Column, mode: str = "compat") -> Column:
    """``strict`` wants word boundaries, so that *od* in *food* is no frequency."""
    return spans(F.lower(text), rules.FREQUENCY if mode == "compat" else rf"\b{rules.FREQUENCY}\b", "FREQUENCY", 1.0, 4, text)


def first_cover(candidates: Column) -> Column:
    """Of spans in order of rank keep those whose start lies in none kept before."""
    empty = F.array().cast(f"array<{SPAN}>")
    keep = lambda acc, s: F.when(F.exists(acc, lambda k: (k["start"] <= s["start"]) & (s["start"] < k["end"])), acc).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(candidates, empty, keep)


def condition_spans(text: Column, upto: str = "DURATION") -> Column:
    """Diseases, symptoms and durations, in this order up to one of them: an earlier pattern's span bars later ones that start inside it.

    A pattern is run only on texts that contain one of its words, which a plain substring search tells.
    """
    groups = [(rf"\b({p})\b", p.split("|"), "DISEASE", 0.85) for p in rules.DISEASES]
    if upto != "DISEASE":
        groups += [(rf"\b({p})\b", p.split("|"), "SYMPTOM", 0.85) for p in rules.SYMPTOMS]
    if upto == "DURATION":
        groups += [(p, ["day", "week", "month", "year", "ago"], "DURATION", 0.8) for p in rules.DURATIONS]
    # one literal table of patterns and one body over it: a copy of the body for each pattern would make the plan eighty times as large
    listed = F.from_json(F.lit(json.dumps([{"p": p, "w": w, "l": k, "s": c} for p, w, k, c in groups])), "array<struct<p:string,w:array<string>,l:string,s:double>>")

    def of(low: Column) -> Column:
        some = F.filter(listed, lambda g: F.exists(g["w"], lambda w: low.contains(w)))
        return F.flatten(F.transform(some, lambda g: spans(low, g["p"], g["l"], g["s"], 5, text)))

    return first_cover(let(F.lower(text), of))


def labelled_spans(text: Column, label: str) -> Column:
    return F.filter(condition_spans(text, label), lambda s: s["label"] == label)


def drug_spans(text: Column, vocabulary: rules.Vocabulary) -> Column:
    """Every match of every term that the text contains: at word boundaries, or anywhere if the term has no such match in the text."""
    low = F.lower(text)
    terms = F.filter(F.array(*[F.lit(t) for t in vocabulary.drugs]), lambda t: low.contains(t))
    quoted = lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E"))

    def of(t: Column) -> Column:
        bound = F.concat(F.lit(r"\b"), quoted(t), F.lit(r"\b"))
        return spans(low, F.when(F.regexp_like(low, bound), bound).otherwise(quoted(t)), "DRUG", 0.9, 3, text)

    return F.array_sort(F.array_distinct(F.flatten(F.transform(terms, of))), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))


def missed_drugs(text: Column, start: Column, end: Column, vocabulary: rules.Vocabulary) -> Column:
    """Every match at word boundaries of every known term, then of every brand, within text[start:end): terms the longest first, then in text order.

    This is the strict form; matches that overlap are all given, in the order of their terms.
    """
    inner = F.substring(text, start + 1, end - start)
    listed = [*sorted(vocabulary.drugs, key=lambda t: (-len(t), t)), *vocabulary.brands]
    quoted = lambda t: F.concat(F.lit(r"\b\Q"), t, F.lit(r"\E\b"))

    def of(low: Column) -> Column:
        some = F.filter(F.array(*[F.lit(t.lower()) for t in listed]), lambda t: low.contains(t))
        return F.flatten(F.transform(some, lambda t: spans(low, quoted(t), "DRUG", 0.85, 3, inner)))

    def moved(s: Column) -> Column:
        return F.struct(s["text"].alias("text"), s["label"].alias("label"), (s["start"] + start).cast("int").alias("start"), (s["end"] + start).cast("int").alias("end"), s["score"].alias("score"), s["layer"].alias("layer")).cast(SPAN)

    return F.transform(let(F.lower(inner), of), moved)


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two strings, row by row of the usual table."""
    n = F.length(b)
    letters = F.split(b, "")

    def row(prev: Column, x: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            best = F.greatest(F.element_at(prev, j + 1), F.element_at(acc, j))
            return F.concat(acc, F.array(F.when(x == F.element_at(letters, j), F.element_at(prev, j) + 1).otherwise(best)))

        return F.aggregate(F.sequence(F.lit(1), n), F.array(F.lit(0)), cell)

    return F.aggregate(F.split(a, ""), F.array_repeat(F.lit(0), n + 1), row, lambda r: F.element_at(r, -1))


def similarity(a: Column, b: Column) -> Column:
    """100 * 2 * LCS / (both lengths)."""
    return F.lit(200.0) * common_subsequence(a, b) / (F.length(a) + F.length(b))


def closest_terms(words: DataFrame, vocabulary: rules.Vocabulary, word: str = "word", least: float = 75.0) -> DataFrame:
    """(word, term, ratio): for each distinct word its most similar term (the first in text order of equals) of at least ``least``.

    Terms whose length alone rules them out are skipped before the table is filled in.
    """
    terms = F.filter(F.array(*[F.lit(t) for t in sorted(vocabulary.drugs)]), lambda t: F.least(F.length(t), F.length(word)) * (200.0 - least) >= F.greatest(F.length(t), F.length(word)) * least)
    pairs = words.select(word).distinct().select(word, F.explode(terms).alias("term")).withColumn("ratio", similarity(F.col(word), F.col("term")))
    best = pairs.where(F.col("ratio") >= least).groupBy(word).agg(F.min_by(F.struct("term", "ratio"), F.struct(-F.col("ratio"), F.col("term"))).alias("b"))
    return best.select(word, "b.term", "b.ratio")


def fuzzy_spans(notes: DataFrame, vocabulary: rules.Vocabulary, ident: str = "note_id", text: str = "text") -> DataFrame:
    """(ident, text, start, end, term, score): words that no known term covers but that resemble one, at the word's first place in the text."""
    low = F.lower(F.col(text))
    words = notes.select(F.col(ident), F.col(text).alias("_t"), F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(r"\b[a-zA-Z]{3,}\b"), F.lit(0)))).alias("word"))
    at = F.instr(F.lower("_t"), F.col("word")) - 1
    known = drug_spans(F.col("_t"), vocabulary)
    words = words.withColumn("start", at).withColumn("end", at + F.length("word"))
    words = words.where(~F.exists(known, lambda s: (s["start"] <= F.col("start")) & (s["end"] >= F.col("end"))))
    hits = words.join(closest_terms(words, vocabulary), "word")
    return hits.select(ident, F.substring(F.col("_t"), F.col("start") + 1, F.length("word")).alias("text"), "start", "end", "term", F.lit(0.8).alias("score"))


#: Learned terms up to this many become part of the plan; of more, workers hold this many bytes at a time.
MOST_IN_PLAN, TERM_BYTES = 32, 32 << 20


def learned_spans(notes: DataFrame, knowledge: DataFrame, ident: str = "note_id", text: str = "text") -> DataFrame:
    """(ident, text, label, start, end): matches of learned terms (knowledge: term, label), any case; empty and null terms match nothing.

    A knowledge table of at most MOST_IN_PLAN terms is looked for within each note's row. A larger one is handed to the workers as an index, TERM_BYTES
    of terms at a time (dealt by a hash), and each block is one scan of the notes. Only notes that share an ident can give a span twice, so spans are
    shuffled only if there are such.
    """
    low = F.lower(F.col(text))
    known = knowledge.select(F.lower("term").alias("t"), "label").where("t <> ''").distinct()
    few = known.limit(MOST_IN_PLAN + 1).collect()
    if len(few) <= MOST_IN_PLAN:
        listed = F.from_json(F.lit(json.dumps([{"t": r["t"], "l": r["label"]} for r in few])), "array<struct<t:string,l:string>>")

        def of(x: Column) -> Column:
            return F.flatten(F.transform(F.filter(listed, lambda k: x.contains(k["t"])), lambda k: spans(x, _quoted(k["t"]), k["l"], 1.0, 7, F.col(text))))

        found = notes.select(F.col(ident), F.explode(let(low, of)).alias("s"))
        return found.select(ident, "s.text", "s.label", "s.start", "s.end").distinct()
    held = F.octet_length("t") + F.coalesce(F.octet_length("label"), F.lit(0)) + 100  # an index takes about 100 bytes a term beside its letters
    n_blocks = -(-known.agg(F.sum(held.cast("long")).alias("n")).first()["n"] // TERM_BYTES)
    rows = notes.select(F.col(ident).alias("_ident"), F.col(text).alias("_text"), low.alias("_low"))
    schema = StructType([rows.schema["_ident"], *StructType.fromDDL("text string, label string, start int, end int")])
    found = union_layers(*(rows.mapInArrow(_searcher(known, i, n_blocks), schema) for i in range(n_blocks))).withColumnRenamed("_ident", ident)
    if notes.isStreaming or not notes.groupBy(ident).count().where("count > 1").isEmpty():
        return found.distinct()
    return found


def _searcher(known: DataFrame, block: int, n_blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    own = known.where(F.pmod(F.xxhash64("t", "label"), F.lit(n_blocks)) == block).select("t", F.col("label").cast("string").alias("label")).toArrow().combine_chunks()
    if not own.num_rows:
        return lambda batches: iter(())
    index = Index(*(c.chunk(0) for c in own.columns))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield from search(index, *x.columns, ["_ident", "text", "label", "start", "end"])

    return look


def _quoted(term: Column) -> Column:
    return F.concat(F.lit(r"\Q"), term, F.lit(r"\E"))


def extract(text: Column, vocabulary: rules.Vocabulary, mode: str = "strict") -> Column:
    """All rule layers in one array, by layer."""
    return F.concat(drug_spans(text, vocabulary), dosage_spans(text), frequency_spans(text, mode), condition_spans(text))


def union_layers(*layers: DataFrame) -> DataFrame:
    """Layers of exploded spans as one relation; columns that a layer lacks are null."""
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer, allowMissingColumns=True)
    return out


def prescription_details(text: Column) -> Column:
    low = F.lower(text)
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in rules.RX_ABBREVIATIONS.items()])
    found = F.transform(F.filter(pairs, lambda p: F.regexp_like(low, F.concat(F.lit(r"\b"), p["k"], F.lit(r"\b")))), lambda p: F.struct(F.upper(p["k"]).alias("abbreviation"), p["v"].alias("meaning")))
    get = lambda p: F.regexp_extract_all(low, F.lit(p), F.lit(1))
    return F.struct(found.alias("abbreviations"), get(rules.RX_DOSAGES).alias("dosages"), get(rules.RX_FREQUENCIES).alias("frequencies"), get(rules.RX_DURATIONS).alias("durations"))


def dosage_units(text: Column) -> Column:
    """The units of dosages, as the pattern's one group gives them."""
    return F.regexp_extract_all(text, F.lit(r"(?i)\b\d+\s*(mg|ml|g|mcg|µg|units?|tab|cap|tablet|capsule)\b"), F.lit(1))


def frequency_strings(text: Column) -> Column:
    verbal = r"(?i)\b(once|twice|thrice|three times|four times)\s*(daily|weekly|monthly)\b"
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(verbal), F.lit(1)), F.regexp_extract_all(text, F.lit(verbal), F.lit(2)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(F.regexp_extract_all(text, F.lit(r"\b\d-\d-\d\b"), F.lit(0)), pairs)

