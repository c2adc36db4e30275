"""Every operator as a named query over the driver's tables, and the DuckDB statement that must give the same rows.

A query without a statement is one that SQL can't express here (Python's difflib, engine-specific hashes, streams); tests cover those.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import entities, fhir, knowledge, medications, ocr, phi, review, service, slots, spans
from ..sources import readers
from ..streaming import jobs
from . import sqltext as q
from .notes import DAMAGED, ENTITIES, NOTES, REVIEW, view

VOCABULARY = rules.Vocabulary()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KNOWN = sorted({*VOCABULARY.drugs, *VOCABULARY.brands})


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def notes(s, d):
    return view(s, d, NOTES)


def damaged(s, d):
    return view(s, d, DAMAGED)


def table(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _span_rows(df: DataFrame, column, ident: str = "note_id") -> DataFrame:
    return df.select(ident, F.explode(column).alias("s")).select(ident, "s.text", "s.start", "s.end")


# ---- text ----
UNITS = [(r"(\d+)(mg|ml|g|mcg|iu|units?)\b", "{1} {2}")]


@query(f"select note_id, {q.replaced('text', UNITS, True)} as text from ({NOTES})")
def text_unit_split(s, d):
    return notes(s, d).select("note_id", text.unit_split(F.col("text")).alias("text"))


@query(f"select note_id, {q.replaced('text', rules.SHORTHAND, True)} as text from ({DAMAGED})")
def text_shorthand_expand(s, d):
    return damaged(s, d).select("note_id", text.expand_shorthand(F.col("text")).alias("text"))


PREPROCESS = "trim(" + q.replaced(q.replaced(q.replaced("text", rules.SHORTHAND, True), UNITS, True), [("([a-z])([A-Z])", "{1} {2}"), ("##", ""), ("[ \\t]+", " ")]) + ")"


@query(f"select note_id, {PREPROCESS} as text from ({DAMAGED})")
def text_preprocess(s, d):
    return damaged(s, d).select("note_id", text.preprocess(F.col("text")).alias("text"))


STRIP = [x for label in rules.TEXT_LABELS for x in ((rf"(\w*){label}(\w*)", "{1}{2}"), (rf"\s*\b{label}\b\s*", " "))]


@query(f"select note_id, trim({q.replaced('text', [*STRIP, (' {2,}', ' ')])}) as text from ({DAMAGED})")
def text_strip_labels(s, d):
    return damaged(s, d).select("note_id", text.strip_labels(F.col("text")).alias("text"))


@query(f"select note_id, trim({q.replaced(q.replaced('trim(' + q.replaced('text', [*STRIP, (' {2,}', ' ')]) + ')', rules.HANDWRITING, True), [(' {2,}', ' ')])}) as text from ({DAMAGED})")
def text_clean_ocr(s, d):
    return damaged(s, d).select("note_id", text.clean_ocr(F.col("text")).alias("text"))


def _ocr_sql() -> str:
    out = q.replaced(q.replaced("text", [(f"({rules.OCR_LABELS})", " ")], True), rules.OCR_CORRECTIONS, True)
    out = q.replaced(out, rules.OCR_PATTERNS)
    for p in rules.OCR_PHRASES:
        out = f"replace({out}, {q.quote(p)}, '')"
    return f"trim({q.replaced(out, [(r'\s+', ' ')])})"


@query(f"select note_id, {_ocr_sql()} as text from ({DAMAGED})")
def text_ocr_cleanup(s, d):
    return damaged(s, d).select("note_id", text.ocr_cleanup(F.col("text"), "compat").alias("text"))


@query()
def text_ocr_cleanup_strict(s, d):
    return damaged(s, d).select("note_id", text.ocr_cleanup(F.col("text"), "strict").alias("text"))


@query(f"select note_id, {q.replaced('text', rules.BROKEN_WORDS)} as text from ({DAMAGED})")
def text_fix_broken_words(s, d):
    return damaged(s, d).select("note_id", text.fix_broken_words(F.col("text")).alias("text"))


@query(f"select note_id, {q.replaced('text', rules.DOSAGE_NOTATION, True)} as text from ({DAMAGED})")
def text_dosage_notation(s, d):
    return damaged(s, d).select("note_id", text.dosage_notation(F.col("text")).alias("text"))


@query(f"select note_id, {q.replaced('text', rules.OCR_NORMALISE)} as text from ({DAMAGED})")
def text_normalise_ocr_tokens(s, d):
    return damaged(s, d).select("note_id", text.normalise_ocr_tokens(F.col("text")).alias("text"))


@query(f"select note_id, trim({q.replaced(q.replaced(q.replaced('text', [(r'\s+', ' ')]), rules.ABBREVIATIONS, True), [(r'[^\w\s.,;:!?()\-%°/]', ' ')])}) as text from ({DAMAGED})")
def text_normalize(s, d):
    return damaged(s, d).select("note_id", text.normalise(F.col("text"), nfkc=False).alias("text"))


@query()
def text_normalize_unicode(s, d):
    return table(s, d, "documents").select("doc_id", text.normalise(F.col("text")).alias("text"))


def _class_sql() -> str:
    return "case " + " ".join(f"when {q.any_of('lower(text)', words)} then {q.quote(name)}" for name, words in rules.DOCUMENT_CLASSES) + " else 'unknown' end"


@query(f"select doc_id, {_class_sql()} as class from documents")
def doc_classify(s, d):
    return table(s, d, "documents").select("doc_id", text.classify(F.col("text")).alias("class"))


@query("select note_id, case when trim(text) = '' then 'empty' when length(text) > 60 then 'long' else 'ok' end as guard from (" + NOTES + ")")
def text_guards(s, d):
    return notes(s, d).select("note_id", F.when(F.trim("text") == "", "empty").when(F.length("text") > 60, "long").otherwise("ok").alias("guard"))


@query("select doc_id, concat('ner:v1:', substr(sha256(text), 1, 16)) as cache_key from documents")
def cache_key(s, d):
    return table(s, d, "documents").select("doc_id", text.cache_key(F.lit("v1"), F.col("text")).alias("cache_key"))


@query("select doc_id, (length(t.text))::bigint as n_chars_once from documents t")
def cache_dedupe(s, d):
    once = lambda x: x.withColumn("n_chars_once", F.length("text").cast("long"))
    return service.once_per_content(table(s, d, "documents").select("doc_id", "text"), once).select("doc_id", "n_chars_once")


# ---- spans ----
@query(q.spans(f"({NOTES})", "note_id", rules.DOSAGE, "lower(text)", "text"))
def span_dosage(s, d):
    return _span_rows(notes(s, d), spans.dosage_spans(F.col("text")))


@query(f"select text as dosage, count(*) as n from ({q.spans(f'({NOTES})', 'note_id', rules.DOSAGE, 'lower(text)', 'text')}) group by 1")
def span_dosage_counts(s, d):
    return span_dosage(s, d).groupBy(F.col("text").alias("dosage")).agg(F.count("*").alias("n"))


@query(q.spans(f"({DAMAGED})", "note_id", rules.FREQUENCY, "lower(text)", "text"))
def span_frequency(s, d):
    return _span_rows(damaged(s, d), spans.frequency_spans(F.col("text")))


@query(q.spans(f"({DAMAGED})", "note_id", rf"\b{rules.FREQUENCY}\b", "lower(text)", "text"))
def span_frequency_strict(s, d):
    return _span_rows(damaged(s, d), spans.frequency_spans(F.col("text"), "strict"))


def _conditions_sql(label: str) -> str:
    """Each pattern's spans in order; a span survives unless one that survived before covers its start. On these notes spans that start inside others are all of later patterns and none bars a survivor's survivor."""
    ranked = [(rf"\b({p})\b", "DISEASE") for p in rules.DISEASES] + [(rf"\b({p})\b", "SYMPTOM") for p in rules.SYMPTOMS] + [(p, "DURATION") for p in rules.DURATIONS]
    union = " union all ".join(f"select *, {k} as k, {q.quote(name)} as label from ({q.spans('n', 'note_id', p, 'low', 'text')})" for k, (p, name) in enumerate(ranked))
    return f"""with n as materialized (select note_id, text, lower(text) as low from ({DAMAGED}) where note_id % 20 < 20), a as materialized ({union})
select note_id, text, start, "end" from a where label = {q.quote(label)} and not exists
 (select 1 from a b where b.note_id = a.note_id and b.k < a.k and b.start <= a.start and a.start < b."end")"""


@query(_conditions_sql("DISEASE"))
def span_disease(s, d):
    return _span_rows(damaged(s, d), spans.labelled_spans(F.col("text"), "DISEASE"))


@query(_conditions_sql("SYMPTOM"))
def span_symptom(s, d):
    return _span_rows(damaged(s, d), spans.labelled_spans(F.col("text"), "SYMPTOM"))


@query(_conditions_sql("DURATION"))
def span_duration(s, d):
    return _span_rows(damaged(s, d), spans.labelled_spans(F.col("text"), "DURATION"))


DRUG_SQL = f"""with n as (select note_id, text, lower(text) as low from ({DAMAGED})), v(term) as (values {q.values(VOCABULARY.drugs)}),
p as (select note_id, text, low, term, string_split_regex(low, '\\b' || regexp_escape(term) || '\\b') as bound, string_split(low, term) as loose from n join v on contains(low, term)),
c as (select note_id, text, term, case when len(bound) > 1 then bound else loose end as g from p)
select distinct note_id, substr(text, (st + 1)::int, length(term)) as text, st::int as start, (st + length(term))::int as "end" from (
 select note_id, text, term, list_sum(list_transform(g[1:i], lambda x: length(x))) + (i - 1) * length(term) as st from (select *, unnest(range(1, len(g))) as i from c))"""


@query(DRUG_SQL)
def span_drug_dictionary(s, d):
    return _span_rows(damaged(s, d), spans.drug_spans(F.col("text"), VOCABULARY))


def _missed_sql() -> str:
    """Matches within characters 5 to 90 of each note, term by term."""
    rows = ", ".join(f"({q.quote(t)}, {q.quote('D')})" for t in VOCABULARY.drugs) + ", " + ", ".join(f"({q.quote(t.lower())}, {q.quote('B')})" for t in VOCABULARY.brands)
    return f"""with n as (select note_id, text[6:90] as inner_text, lower(text[6:90]) as low from ({DAMAGED})), v(term, kind) as (values {rows}),
p as (select note_id, inner_text, term, kind, string_split_regex(low, '\\b' || regexp_escape(term) || '\\b') as g from n join v on contains(low, term)),
c as (select *, unnest(range(1, len(g))) as i from p)
select note_id, substr(inner_text, (st + 1)::int, length(term)) as text, (st + 5)::int as start, (st + 5 + length(term))::int as "end" from (
 select note_id, inner_text, term, list_sum(list_transform(g[1:i], lambda x: length(x))) + (i - 1) * length(term) as st from c)"""


@query(_missed_sql())
def span_missed_drugs(s, d):
    return _span_rows(damaged(s, d), spans.missed_drugs(F.col("text"), F.lit(5), F.lit(90), VOCABULARY))


@query()
def span_drug_fuzzy(s, d):
    return spans.fuzzy_spans(damaged(s, d), VOCABULARY)


LEARNED = [("fever", "SYMPTOM"), ("Also", "NOTE"), ("roe@", "CONTACT")]


@query(
    f"with n as (select note_id, text, lower(text) as low from ({DAMAGED})), k(term, label) as (values {', '.join(f'({q.quote(a)}, {q.quote(b)})' for a, b in LEARNED)})"
    """ select distinct note_id, substr(text, (st + 1)::int, length(term)) as text, label, st::int as start, (st + length(term))::int as "end" from (
 select *, list_sum(list_transform(g[1:i], lambda x: length(x))) + (i - 1) * length(term) as st from (
  select *, unnest(range(1, len(g))) as i from (select note_id, text, term, label, string_split(low, lower(term)) as g from n join k on contains(low, lower(term)))))"""
)
def span_learned(s, d):
    return spans.learned_spans(damaged(s, d), s.createDataFrame(LEARNED, "term string, label string"))


@query(
    """with k as (select distinct lower(unnest(regexp_extract_all(text, '[A-Za-z]{6,}'))) as term from benchmark),
p as (select term, string_split(lower(text), term) as g from documents join k on contains(lower(text), term))
select term, count(*) as texts, sum(len(g) - 1)::bigint as n from p group by 1"""
)
def span_learned_table(s, d):
    words = table(s, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0))).alias("term"))
    found = spans.learned_spans(table(s, d, "documents"), words.distinct().withColumn("label", F.lit("TERM")), "doc_id")
    return found.groupBy(F.lower("text").alias("term")).agg(F.countDistinct("doc_id").alias("texts"), F.count("*").alias("n"))


ROUTED = """select doc_id, encode(text) as content, case doc_id % 4 when 0 then 'application/pdf' when 1 then 'image/png' when 2 then 'text/plain' end as content_type from documents"""


@query(
    f"""select doc_id, case when content_type = 'application/pdf' then 'pdf' when content_type like 'image/%' then 'image' else 'text' end as kind,
 case when content_type like 'text/%' or content_type is null then decode(content) end as text, null::varchar as error from ({ROUTED})"""
)
def source_route(s, d):
    kinds = F.element_at(F.array(F.lit("application/pdf"), F.lit("image/png"), F.lit("text/plain"), F.lit(None)), (F.col("doc_id") % 4 + 1).cast("int"))
    files = table(s, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"), kinds.alias("content_type"))
    return readers.routed(files).select("doc_id", "kind", "text", "error")


@query(f"select label, count(*) as n from (select 'DOSAGE' as label from ({q.spans(f'({NOTES})', 'note_id', rules.DOSAGE, 'lower(text)')}) union all select 'FREQUENCY' from ({q.spans(f'({NOTES})', 'note_id', rules.FREQUENCY, 'lower(text)')})) group by 1")
def span_union_layers(s, d):
    n = notes(s, d)
    rows = lambda c: n.select(F.explode(c).alias("s")).select("s.*")
    return spans.union_layers(rows(spans.dosage_spans(F.col("text"))), rows(spans.frequency_spans(F.col("text")))).groupBy("label").agg(F.count("*").alias("n"))


@query(f"select note_id, array_to_string(regexp_extract_all(lower(text), {q.quote(rules.RX_DOSAGES)}, 1), '|') as dosages, array_to_string(regexp_extract_all(lower(text), {q.quote(rules.RX_FREQUENCIES)}, 1), '|') as frequencies, array_to_string(regexp_extract_all(lower(text), {q.quote(rules.RX_DURATIONS)}, 1), '|') as durations, array_to_string(list_filter([{', '.join(q.quote(k.upper()) for k in rules.RX_ABBREVIATIONS)}], lambda k: regexp_matches(lower(text), '\\b' || lower(k) || '\\b')), '|') as abbreviations from ({DAMAGED})")
def prescription_details(s, d):
    p = spans.prescription_details(F.col("text"))
    join = lambda c: F.array_join(c, "|")
    return damaged(s, d).select("note_id", p.alias("p")).select("note_id", join(F.col("p.dosages")).alias("dosages"), join(F.col("p.frequencies")).alias("frequencies"), join(F.col("p.durations")).alias("durations"), join(F.transform("p.abbreviations", lambda a: a["abbreviation"])).alias("abbreviations"))


@query(f"select note_id, array_to_string(regexp_extract_all(text, '(?i)\\b\\d+\\s*(mg|ml|g|mcg|µg|units?|tab|cap|tablet|capsule)\\b', 1), '|') as units from ({DAMAGED})")
def dosage_units(s, d):
    return damaged(s, d).select("note_id", F.array_join(spans.dosage_units(F.col("text")), "|").alias("units"))


VERBAL = r"(?i)\b(once|twice|thrice|three times|four times)\s*(daily|weekly|monthly)\b"


@query(f"select note_id, array_to_string(list_concat(regexp_extract_all(text, '\\b\\d-\\d-\\d\\b', 0), list_transform(list_zip(regexp_extract_all(text, {q.quote(VERBAL)}, 1), regexp_extract_all(text, {q.quote(VERBAL)}, 2)), lambda p: p[1] || ' ' || p[2])), '|') as strings from (select note_id, {PREPROCESS} || ' 1-0-1' as text from ({DAMAGED}))")
def frequency_strings(s, d):
    expanded = damaged(s, d).withColumn("text", F.concat(text.preprocess(F.col("text")), F.lit(" 1-0-1")))
    return expanded.select("note_id", F.array_join(spans.frequency_strings(F.col("text")), "|").alias("strings"))


# ---- entities ----
def _entities(s, d):
    return view(s, d, ENTITIES)


def _array_of(df):
    return df.select("doc_id", F.array(F.struct("text", "label", "start", "end", "score", F.col("k").alias("layer")).cast(spans.SPAN)).alias("es"))


def _relabel_sql(source: str) -> str:
    t = "lower(text)"
    starts = lambda p: f"regexp_matches({t}, {q.quote('^(?:' + p + ')')})"
    return f"""select *, case when was_route and len(list_filter(string_split_regex(low, '\\s+'), lambda w: w in {q.listed(KNOWN)})) > 0 then 'DRUG'
  when was_route and l1 = 'ROUTE' and low not in {q.listed(rules.ROUTE_WORDS)} then 'DRUG' when not was_route and low in {q.listed(rules.ROUTE_WORDS)} then 'ROUTE'
  when not was_route and low in {q.listed(rules.FORM_WORDS)} then 'FORM' else l1 end as l2 from (
 select *, {t} as low, lower(label) = 'route' as was_route,
  case when {starts(r'\d+\s*(mg|ml|g|mcg|µg|iu|mmol|meq|units?)\b')} and not {q.any_of(t, rules.FREQ_WORDS)} then case when {q.any_of(t, rules.DOSE_FORMS)} then label else 'STRENGTH' end
  when {starts(r'\d+\s*(tablet|tab|capsule|cap|sachet|puff|drop|suppository|patch)s?\b')} then 'DOSAGE' when {starts(r'\d+\s*(tsp|tbsp|ml|teaspoon|tablespoon)\b')} then 'DOSAGE'
  when {starts(r'\d+[a-z]+')} then case when regexp_matches({t}, '^\\d+(freq|frequency)$') then 'DOSAGE' else label end when {starts(r'\d\s*-\s*\d\s*-\s*\d\s*x\s*\d+')} then 'FREQUENCY'
  when {starts(r'\d+\s*(days?|weeks?|months?)')} then 'DURATION' when {starts(r'\d-\d-\d')} then 'FREQUENCY' else label end as l1,
  case when regexp_matches({t}, '^\\d+(freq|frequency)$') then regexp_extract({t}, '\\d+') when {starts(r'\d\s*-\s*\d\s*-\s*\d\s*x\s*\d+')} then replace(regexp_extract({t}, '\\d\\s*-\\s*\\d\\s*-\\s*\\d'), ' ', '') else text end as t2
 from {source})"""


@query(
    f"with r as ({_relabel_sql('(' + ENTITIES + ')')}), f as (select *, [w for w in [{', '.join(map(q.quote, rules.LEADING_FORMS))}] if starts_with(low, w || ' ')][1] as lead from r)"
    f" select doc_id, t2 as text, l2 as label, start from f where not (l2 = 'DRUG' and lead is not null and trim(substr(low, length(lead) + 1)) in {q.listed(KNOWN)})"
    f" union all select doc_id, substr(text, 1, length(lead)), 'FORM', start from f where l2 = 'DRUG' and lead is not null and trim(substr(low, length(lead) + 1)) in {q.listed(KNOWN)}"
    f" union all select doc_id, trim(substr(text, length(lead) + 1)), 'DRUG', (start + length(lead) + 1)::int from f where l2 = 'DRUG' and lead is not null and trim(substr(low, length(lead) + 1)) in {q.listed(KNOWN)}"
)
def ent_relabel(s, d):
    return _array_of(_entities(s, d)).select("doc_id", F.explode(entities.relabel(F.col("es"), VOCABULARY)).alias("e")).select("doc_id", "e.text", "e.label", "e.start")


MIXED = """select note_id as doc_id, case note_id % 4 when 0 then '5 days twice daily' when 1 then '2 seg one time' when 2 then '3 weeks' else 'daily' end as text from (""" + NOTES + ")"


@query(
    f"with m as ({MIXED}), x as (select *, regexp_extract(text, {q.quote(rules.LINE_DURATION)}, 2) as unit, regexp_extract(text, {q.quote(rules.MIXED_FREQUENCY)}, 0) as often from m)"
    f" select doc_id, regexp_extract(text, {q.quote(rules.LINE_DURATION)}, 1) || ' ' || case unit when 'seg' then 'days' else unit end as text, 'DURATION' as label from x where unit <> '' and often <> ''"
    " union all select doc_id, often, 'FREQUENCY' from x where unit <> '' and often <> '' union all select doc_id, text, 'DOSAGE' from x where unit = '' or often = ''"
)
def ent_split_mixed(s, d):
    one = view(s, d, MIXED).select("doc_id", F.array(F.struct("text", F.lit("DOSAGE").alias("label"), F.lit(0).alias("start"), F.length("text").alias("end"), F.lit(1.0).alias("score"), F.lit(0).alias("layer")).cast(spans.SPAN)).alias("es"))
    return one.select("doc_id", F.explode(entities.split_mixed(F.col("es"))).alias("e")).select("doc_id", "e.text", "e.label")


def _valid_sql(name: str) -> str:
    low, words = f"trim(lower({name}))", f"string_split_regex(trim(lower({name})), '\\s+')"
    has = lambda listed: f"len(list_filter({words}, lambda w: w in {q.listed(listed)})) > 0"
    return f"""case when {name} is null or length({name}) < 3 then false when {low} in {q.listed(KNOWN)} then true when {q.any_of(low, rules.DRUG_BANNED)} then false
 when {low} in {q.listed(rules.DRUG_NOISE)} then false when ({has(rules.ROUTE_DESCRIPTORS)} or {has(rules.GENERIC_CLASSES)}) and not {has(KNOWN)} then false
 when {low} in {q.listed(rules.ROUTE_DESCRIPTORS + rules.GENERIC_CLASSES)} then false when {has(KNOWN)} then true else length({name}) >= 4 end"""


NAMES = """select doc_id, concat(case doc_id % 10 when 0 then 'Inhaled Corticosteroid' when 1 then 'Tab Crocin Pt' when 2 then 'oral b pro' when 3 then 'phexin phexin' when 4 then 'Aspirin'
 when 5 then 'pro' when 6 then 'statin' when 7 then 'ab' when 8 then 'Solution Amphojel qs' else 'Insulin-Like Factor er' end, case doc_id % 3 when 0 then '' when 1 then ' 500' else ' sr' end) as name from documents"""


@query(f"select doc_id, name, {_valid_sql('name')} as valid from ({NAMES})")
def ent_valid_drug(s, d):
    return view(s, d, NAMES).select("doc_id", "name", entities.valid_drug(F.col("name"), VOCABULARY).alias("valid"))


def _noise_sql() -> str:
    t, low = "trim(text)", "lower(trim(text))"
    words = f"string_split_regex({t}, '\\s+')"
    return f"""({t} like '%##%' or (length({t}) < 3 and {low} not in {q.listed(rules.KEEP_SHORT)}) or regexp_matches({t}, '^\\d+$') or {low} in {q.listed(rules.NON_MEDICAL)} or {low} in {q.listed(rules.NOISE_FRAGMENTS)}
 or (label in ('CANCER', 'DISEASE', 'ANATOMY') and ({q.any_of(low, rules.NON_CLINICAL)} or (len({words}) >= 4 and len(list_filter({words}, lambda w: lower(w) in {q.listed(VOCABULARY.drugs)})) = 0)))
 or (regexp_matches({low}, '^[bcdfghjklmnpqrstvwxyz]{{2,}}$') and {low} not in {q.listed(VOCABULARY.drugs)} and {low} not in {q.listed(rules.KEEP_SHORT)})
 or (label = 'DRUG' and score < 0.9 and not ({_valid_sql(t)})) or regexp_matches({low}, '^[a-z]$') or (score < 0.6 and score > 0))"""


@query(f"select doc_id, text, label from ({ENTITIES}) where not {_noise_sql()}")
def ent_noise_filter(s, d):
    return _array_of(_entities(s, d)).select("doc_id", F.explode(entities.drop_noise(F.col("es"), VOCABULARY)).alias("e")).select("doc_id", "e.text", "e.label")


@query()
def ent_clean_drug_name(s, d):
    return view(s, d, NAMES).select("doc_id", "name", entities.clean_drug_name(F.col("name"), VOCABULARY).alias("clean"))


PAIRS = """select note_id as doc_id, text as doc_text, case note_id % 3 when 0 then 8 when 1 then 14 else 30 end as a, note_id % 3 as k from (""" + NOTES + ")"


def _fragments(s, d):
    base = view(s, d, PAIRS)
    rows = lambda start, end, label: base.select("doc_id", "doc_text", F.substring(F.col("doc_text"), F.lit(start) + 1, F.lit(end - start)).alias("text"), F.lit(label).alias("label"), F.lit(start).alias("start"), F.lit(end).alias("end"), F.lit(0.9).alias("score"))
    return rows(0, 7, "DRUG").unionByName(rows(8, 9, "DRUG")).unionByName(rows(12, 20, "DRUG")).unionByName(rows(25, 28, "FORM"))


@query(
    f"""with b as ({PAIRS}), f as (select doc_id, doc_text, 0 as start, 7 as "end" from b union all select doc_id, doc_text, 8, 9 from b union all select doc_id, doc_text, 12, 20 from b),
l as (select *, lag("end") over (partition by doc_id order by start) as before from f),
r as (select *, sum(case when before is null or not regexp_matches(substr(doc_text, before + 1, start - before), '^[\\s\\-]*$') then 1 else 0 end) over (partition by doc_id order by start) as run from l)
select doc_id, string_agg(substr(doc_text, start + 1, "end" - start), ' ' order by start) as text, 'DRUG' as label, min(start)::int as start, max("end")::int as "end", 0.9::double as score from r group by doc_id, run
union all select doc_id, substr(doc_text, 26, 3), 'FORM', 25, 28, 0.9::double from b"""
)
def ent_merge_adjacent(s, d):
    return entities.merge_adjacent(_fragments(s, d))


OVERLAPS = """select event_id as doc_id, cast(event_id % 4 as int) as d, cast(event_id % 5 as int) as e from events"""


@query(
    f"""select doc_id, 'aspirin' as text, 0 as start, (5 + d)::int as "end" from ({OVERLAPS})
 union all select doc_id, 'note', 12, 18 from ({OVERLAPS})
 union all select doc_id, 'fever', (4 + d)::int, (9 + d)::int from ({OVERLAPS}) where false
 union all select doc_id, 'cough', (20 + e)::int, 26 from ({OVERLAPS})"""
)
def ent_dedupe(s, d):
    """A span inside a kept one goes, one that starts in it goes, a repeated text and label goes."""
    one = lambda t, a, b, k: F.struct(F.lit(t).alias("text"), F.lit("DRUG").alias("label"), a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(0.9).alias("score"), F.lit(k).alias("layer")).cast(spans.SPAN)
    n = F.lit
    es = F.array(one("note", n(12), n(18), 1), one("aspirin", n(0), F.col("d") + 5, 0), one("fever", F.col("d") + 4, F.col("d") + 9, 2), one("cough", F.col("e") + 20, n(26), 3), one("ASPIRIN ", n(40), n(47), 4), one("ote", n(13), n(16), 5))
    return view(s, d, OVERLAPS).select("doc_id", F.explode(entities.drop_duplicates(es)).alias("x")).select("doc_id", "x.text", "x.start", "x.end")


@query(f"""with e as ({ENTITIES}), p as (select doc_id, text, label, start, "end" from e where k < 5), z as (select doc_id, text, label, start, "end" from e where k > 2)
select * from p union all select * from z where not exists (select 1 from p where p.doc_id = z.doc_id and p.start = z.start)""")
def ent_batch_merge(s, d):
    e = _entities(s, d)
    cols = ["doc_id", "text", "label", "start", "end"]
    return entities.batch_merge(e.where("k < 5").select(*cols), e.where("k > 2").select(*cols))


@query(f"select doc_id, {q.case('label', rules.LABEL_MAP, 'label')} as mapped, {q.case('label', rules.COLOURS, q.quote(rules.OTHER_COLOUR))} as colour, {q.case('label', rules.CATEGORIES, q.quote('entity'))} as category from ({ENTITIES})")
def label_lookups(s, d):
    label = F.col("label")
    return _entities(s, d).select("doc_id", entities.label_of_model(label).alias("mapped"), entities.colour(label).alias("colour"), entities.category(label).alias("category"))


@query(f"select doc_id, {q.case('label', rules.DISPLAY_LABELS, 'label')} as shown, label in {q.listed(rules.BIO_MODEL_LABELS)} as of_bio from ({ENTITIES})")
def label_display(s, d):
    one = F.array(F.struct("label"))
    return _entities(s, d).select("doc_id", entities.display_label(F.col("label")).alias("shown"), (F.size(entities.of_bio_model(one)) > 0).alias("of_bio"))


@query(f"select doc_id, k, coalesce(score <> 0 and score < 0.8 and k % 3 <> 0, false) as warn, coalesce(score <> 0 and score < 0.9 and k % 3 <> 0, false) as ask from ({ENTITIES})")
def review_flags(s, d):
    flags = entities.needs_review(F.col("score"), F.col("k") % 3 == 0)
    return _entities(s, d).select("doc_id", "k", F.coalesce(flags["warn"], F.lit(False)).alias("warn"), F.coalesce(flags["ask"], F.lit(False)).alias("ask"))


@query(f"select doc_id, case when score is null or score = 0 then 'N/A' when score >= 0.9 then 'High' when score >= 0.7 then 'Medium' else 'Low' end as band from ({ENTITIES})")
def confidence_band(s, d):
    return _entities(s, d).select("doc_id", entities.confidence_band(F.col("score")).alias("band"))


HIGHLIGHT = q.spans(f"({NOTES})", "note_id, text as whole", rules.DOSAGE, "lower(text)", "text").replace("select note_id, text as whole, substr", "select note_id, whole, substr", 1)


@query(
    f"""with h as ({HIGHLIGHT}), g as (select *, coalesce(lag("end") over (partition by note_id order by start), 0) as before, lead(start) over (partition by note_id order by start) as nxt from h)
select note_id, before::int as start, substr(whole, (before + 1)::int, (start - before)::int) as piece, null as label from g where start > before
union all select note_id, start, text, 'DOSAGE' from g union all select note_id, "end", substr(whole, "end" + 1), null from g where nxt is null and "end" < length(whole)"""
)
def highlight_segments(s, d):
    n = notes(s, d).withColumn("spans", spans.dosage_spans(F.col("text")))
    return entities.highlight(n).select("note_id", "start", "piece", "label")


@query()
def ent_pipeline(s, d):
    found = entities.pipeline(spans.extract(F.col("text"), VOCABULARY), VOCABULARY)
    return damaged(s, d).select("note_id", F.explode(found).alias("e")).select("note_id", "e.*")


# ---- medications ----
def _line_sql(expr: str) -> dict[str, str]:
    t = f"trim(lower({expr}))"
    get = lambda p, g=0: f"nullif(regexp_extract({t}, {q.quote(p)}, {g}), '')"
    unit, word, lasting = get(rules.LINE_STRENGTH, 2), get(rules.LINE_STRENGTH_WORD, 2), get(rules.LINE_DURATION, 2)
    return {
        "strength": f"coalesce({get(rules.LINE_STRENGTH, 1)} || ' ' || case when {unit} in ('fre', 'q') then 'mg' else {unit} end, case when {word} in {q.listed(rules.LINE_STRENGTH_UNITS)} then {get(rules.LINE_STRENGTH_WORD, 1)} || ' ' || {word} end)",
        "frequency": f"coalesce({', '.join(get(p) for p in rules.LINE_FREQUENCIES)})",
        "duration": f"coalesce({get(rules.LINE_DURATION, 1)} || ' ' || case {lasting} when 'seg' then 'days' else {lasting} end, {get(rules.LINE_DURATION_UNIT)})",
        "route": get(rules.LINE_ROUTE),
    }


@query(f"select note_id, {', '.join(f'{v} as {k}' for k, v in _line_sql('text').items())} from ({DAMAGED})")
def med_parse_line(s, d):
    return damaged(s, d).select("note_id", medications.parse_line(F.col("text")).alias("p")).select("note_id", "p.*")


def _med_spans(s, d):
    n = notes(s, d).withColumn("text", text.preprocess(F.col("text"))).select(F.col("note_id").alias("doc_id"), F.col("text").alias("doc_text"))
    return n.select("doc_id", "doc_text", F.explode(F.concat(spans.drug_spans(F.col("doc_text"), VOCABULARY), spans.dosage_spans(F.col("doc_text")), spans.frequency_spans(F.col("doc_text"), "strict"))).alias("e")).select("doc_id", "doc_text", "e.*")


SIX = ["aspirin", "ibuprofen", "amlodipine", "atorvastatin", "omeprazole", "amoxicillin"]
MED_SQL = f"""with n as (select note_id as doc_id, {PREPROCESS} as text from ({NOTES})),
d as (select doc_id, regexp_extract(lower(text), '({'|'.join(SIX)})') as drug, regexp_extract(lower(text), '\\d+ mg') as dosage,
 coalesce(nullif(regexp_extract(lower(text), {q.quote(rf'\b{rules.FREQUENCY}\b')}, 0), ''), null) as frequency from n)
select doc_id, 1 as med_no, upper(drug[1]) || drug[2:] as drug, nullif(dosage, '') as strength, nullif(dosage, '') as dosage,
 case when frequency in ('once daily', 'twice daily') then frequency when frequency = 'daily' then 'daily' else frequency end as frequency, null::varchar as duration, null::varchar as route, null::varchar as form from d"""


@query(MED_SQL)
def med_group(s, d):
    m = medications.group_medications(_med_spans(s, d), VOCABULARY)
    return m.select("doc_id", "med_no", "drug", "strength", "dosage", "frequency", "duration", "route", "form")


@query(f"select doc_id, drug || coalesce(' ' || strength, '') || coalesce(' ' || dosage, '') || coalesce(' - ' || frequency, '') as standardized from ({MED_SQL})")
def med_standardized(s, d):
    return medications.standard_text(medications.group_medications(_med_spans(s, d), VOCABULARY))


@query(f"select doc_id, drug || ' (' || coalesce(strength, '') || ') - ' || coalesce(frequency, '') || ' for ' as shown from ({MED_SQL})")
def med_display(s, d):
    return medications.group_medications(_med_spans(s, d), VOCABULARY).select("doc_id", medications.display().alias("shown"))


@query(f"select drug, count(*) as n from ({MED_SQL}) group by 1")
def med_counts_by_drug(s, d):
    return med_group(s, d).groupBy("drug").agg(F.count("*").alias("n"))


# ---- protected health information ----
def _phi_sql(source: str, ident: str) -> str:
    one = lambda k, p: f"select *, {q.quote(k)} as type from ({q.spans(source, ident, p)})" + (f" where lower(text) not in {q.listed(rules.NOT_NAMES)}" if k == "NAME" else "")
    return " union all ".join(one(k, p) for k, p in rules.PHI_SERVICE.items())


def _phi_rows(df, ident):
    return df.select(ident, F.explode(phi.service_findings(F.col("text"))).alias("s")).select(ident, "s.text", "s.start", "s.end", F.col("s.label").alias("type"))


@query(_phi_sql(f"({DAMAGED})", "note_id"))
def phi_service_detect(s, d):
    return _phi_rows(damaged(s, d), "note_id")


@query(f"select type, count(*) as findings, count(distinct note_id) as notes from ({_phi_sql(f'({DAMAGED})', 'note_id')}) group by 1")
def phi_service_summary(s, d):
    return phi.service_summary(damaged(s, d))


@query(f"select note_id, note_id not in (select note_id from ({_phi_sql(f'({DAMAGED})', 'note_id')})) as is_free from ({DAMAGED})")
def phi_is_free(s, d):
    return damaged(s, d).select("note_id", phi.is_free(F.col("text")).alias("is_free"))


@query(f"select doc_id, text as email from ({q.spans('documents', 'doc_id', rules.PHI_SERVICE['EMAIL'])})")
def phi_email_docs(s, d):
    found = phi.service_findings(F.col("text"))
    return table(s, d, "documents").select("doc_id", F.explode(F.filter(found, lambda x: x["label"] == "EMAIL")).alias("s")).select("doc_id", F.col("s.text").alias("email"))


SIMPLE_PHI = "select note_id, case note_id % 3 when 0 then 'SSN 123-45-6789 ok' when 1 then 'mail a.b@example.org 555-123-4567' else '12 34' end as text from (" + NOTES + ")"


@query(f"select note_id, case note_id % 3 when 0 then '1 LOW 123...' when 1 then '2 MEDIUM a.b...,555...' else '0 LOW ' end as report from ({NOTES})")
def phi_detector_report(s, d):
    r = view(s, d, SIMPLE_PHI).select("note_id", phi.report(F.col("text")).alias("r"))
    return r.select("note_id", F.concat_ws(" ", F.col("r.total_findings").cast("string"), "r.risk_level", F.array_join(F.transform("r.findings", lambda f: f["text"]), ",")).alias("report"))


@query(f"select note_id, case note_id % 3 when 0 then 'SSN [SSN_REDACTED] ok' when 1 then 'mail [EMAIL_REDACTED] [PHONE_REDACTED]' else '12 34' end as tagged, case note_id % 3 when 0 then 'SSN [REDACTED-SSN] ok' when 1 then 'mail [REDACTED-EMAIL] [REDACTED-PHONE]' else '12 34' end as bracketed from ({NOTES})")
def phi_redact(s, d):
    return view(s, d, SIMPLE_PHI).select("note_id", phi.redact_tagged(F.col("text")).alias("tagged"), phi.redact_bracketed(F.col("text")).alias("bracketed"))


@query("select c_custkey, case when length(c_name) > 6 then concat(substr(c_name, 1, 3), '...') else c_name end as masked from customer")
def phi_mask(s, d):
    return table(s, d, "customer").select("c_custkey", phi.mask(F.col("c_name")).alias("masked"))


# ---- verification and knowledge ----
AI = f"""select doc_id, start, "end", text, label, k as seq from ({ENTITIES})"""
HUMAN = f"""select doc_id, case doc_id % 6 when 0 then start + 1 else start end as start, case doc_id % 6 when 0 then "end" + 1 else "end" end as "end",
 case doc_id % 5 when 0 then concat(text, ' x') else text end as text, label from ({ENTITIES})"""
DIFF_SQL = f"""select h.doc_id, h.start, h."end", h.text, h.label, a.text as ai_text, a.label as ai_label,
 case when a.doc_id is null then 'added' when a.text = h.text and a.label = h.label then 'unchanged' else 'corrected' end as change
 from ({HUMAN}) h left join ({AI}) a on a.doc_id = h.doc_id and a.start = h.start and a."end" = h."end\""""


@query(DIFF_SQL)
def verify_diff(s, d):
    return knowledge.verify_diff(view(s, d, AI), view(s, d, HUMAN))


DELTA_SQL = f"""select term, corrected, category, extraction_id, seq from (select substr(trim(lower(case when change = 'corrected' then ai_text else text end)), 1, 200) as term,
 case when {q.case('label', rules.CATEGORIES, q.quote('entity'))} = 'entity' then text || '::' || label else text end as corrected, {q.case('label', rules.CATEGORIES, q.quote('entity'))} as category, doc_id as extraction_id, start as seq
 from ({DIFF_SQL}) where change in ('corrected', 'added') and length(trim(text)) >= 2) where length(term) >= 2"""
OLD = "select 'aspirin' as term, 'Aspirin' as corrected, 'drug' as category, 3 as confidence, '1,2' as sources union all select 'cough', 'cough::SIGN', 'entity', 1, '7' union all select 'unused', 'x', 'entity', 0, ''"
MERGE_SQL = f"""with o as ({OLD}), n as (select term, arg_max(corrected, extraction_id * 1000 + seq) as corrected, arg_max(category, extraction_id * 1000 + seq) as category, count(*) as n, list(distinct extraction_id::varchar) as ids from ({DELTA_SQL}) group by 1)
select term, coalesce(n.corrected, o.corrected) as corrected, coalesce(n.category, o.category) as category, (coalesce(o.confidence, 0) + coalesce(n.n, 0))::bigint as confidence,
 array_to_string(list_sort(list_distinct(list_concat(case when coalesce(o.sources, '') = '' then [] else string_split(o.sources, ',') end, coalesce(n.ids, [])))), ',') as sources, n.term is not null as touched, o.term is null as is_new
 from o full outer join n using (term)"""


def _merged(s, d):
    old = s.createDataFrame([("aspirin", "Aspirin", "drug", 3, "1,2"), ("cough", "cough::SIGN", "entity", 1, "7"), ("unused", "x", "entity", 0, "")], "term string, corrected string, category string, confidence int, sources string")
    return knowledge.merge(old, knowledge.deltas(verify_diff(s, d)))


@query(MERGE_SQL)
def knowledge_merge(s, d):
    return _merged(s, d)


@query(f"select sum(case when is_new then 1 else 0 end)::bigint as learned, sum(case when touched then 1 else 0 end)::bigint as touched from ({MERGE_SQL})")
def knowledge_learned_counts(s, d):
    return _merged(s, d).agg(F.count_if("is_new").alias("learned"), F.count_if("touched").alias("touched"))


@query(
    f"with k as (select * from ({MERGE_SQL}) where confidence >= 1) select 'correction' as kind, term, corrected as value from k where not contains(corrected, '::') and lower(corrected) <> term"
    " union all select 'drug', term, lower(corrected) from k where category = 'drug' union all select 'label', term, upper(substr(corrected, strpos(corrected, '::') + 2)) from k where category = 'entity' and contains(corrected, '::')"
)
def knowledge_interpret(s, d):
    return knowledge.interpret(_merged(s, d))


def _known_sql() -> str:
    brands = ", ".join(f"({q.quote(k)}, {q.quote(v)})" for k, v in VOCABULARY.brands.items())
    interpreted = ORACLES["knowledge_interpret"]
    return f"""with i as ({interpreted}), f(term) as (values {q.values(VOCABULARY.drugs)}), b(term, value) as (values {brands}), c as (select term, min(value) as value from i where kind = 'correction' group by 1)
select distinct term, null::varchar as value from (select term from f union all select value from i where kind = 'drug') union all select term, value from b where term not in (select term from c) union all select * from c"""


@query(_known_sql())
def knowledge_vocabulary(s, d):
    return knowledge.known_terms(_merged(s, d), VOCABULARY)


# ---- review ----
def _extractions(s, d):
    e = F.transform(F.sequence(F.lit(0), F.col("n_entities")), lambda i: F.struct(F.concat(F.lit("e"), i.cast("string")).alias("text"), F.lit("DRUG").alias("label"), i.alias("start"), (i + 2).alias("end"), (F.col("score") * (i + 1) / 13.0).alias("score")))
    return view(s, d, REVIEW).withColumn("entities", e).withColumn("text", F.concat(F.lit("text of extraction "), F.col("id").cast("string"), F.lit(" "), F.repeat(F.lit("lorem "), 12)))


@query(f"select count(*) as total, count(*) filter (where status = 'pending') as pending, count(*) filter (where status = 'verified') as verified, round(100.0::double * count(*) filter (where status = 'verified') / count(*), 2) as verification_rate from ({REVIEW})")
def review_statistics(s, d):
    return review.statistics(_extractions(s, d))


E_SQL = f"select id, created_at, status, i as start, score * (i + 1) / 13.0::double as score from (select *, unnest(range(0, n_entities + 1)) as i from ({REVIEW}))"


@query(f"with t as (select * from ({REVIEW}) where status = 'pending' order by created_at desc, id limit 20), a as (select id, created_at, count(*) as n_entities, avg(score) as m from ({E_SQL}) where id in (select id from t) group by 1, 2) select id, n_entities, round(m, 9) as avg_confidence from (select * from a where m between 0 and 0.7 order by created_at desc, id limit 10)")
def review_uncertain(s, d):
    return review.uncertain(_extractions(s, d)).withColumn("avg_confidence", F.round("avg_confidence", 9))


@query(f"""select id, 'e' || start as entity, start::int as start, round(score, 9) as score, substr('text of extraction ' || id || ' ' || repeat('lorem ', 12), greatest(start - 50, 0)::int + 1, (start + 2 + 50 - greatest(start - 50, 0))::int) as context
 from ({E_SQL}) where status = 'pending' and score < 0.7 order by score, id, start limit 20""")
def review_low_confidence(s, d):
    return review.low_confidence(_extractions(s, d)).select("id", "entity", "start", F.round("score", 9).alias("score"), "context")


@query()
def review_diverse(s, d):
    return review.diverse(_extractions(s, d))


@query(f"select case when n_entities + 1 <= 3 then 'low' when n_entities + 1 <= 7 then 'medium' else 'high' end as stratum, count(*) as n from ({REVIEW}) group by 1")
def review_strata(s, d):
    return review.strata(_extractions(s, d)).groupBy("stratum").agg(F.count("*").alias("n"))


NOW = "1997-06-01 00:00:00"


@query(f"select id, status from ({REVIEW}) where not (status = 'verified' and created_at < timestamp '{NOW}' - interval 30 day)")
def retention_keep(s, d):
    return review.retained(view(s, d, REVIEW), NOW).select("id", "status")


@query(f"select id from ({REVIEW}) where status = 'verified' and created_at < timestamp '{NOW}' - interval 30 day")
def retention_delete(s, d):
    return review.expired(view(s, d, REVIEW), NOW).select("id")


# ---- FHIR ----
FREQS = "select doc_id, case doc_id % 6 when 0 then 'Once daily' when 1 then 'twice daily' when 2 then 'daily' when 3 then 'as needed' when 4 then 'three times daily' else 'hourly' end as f, case doc_id % 4 when 0 then 'oral use' when 1 then 'Intravenous' when 2 then 'inhaled' else 'none' end as r, case doc_id % 3 when 0 then '2.5 ml twice' when 1 then '500' else 'some' end as dose from documents"


@query(
    f"select doc_id, {q.case('lower(f)', sorted(rules.FREQUENCY_CODES, key=lambda x: -len(x[0])), q.quote('PRN'), 'contains')} as strict, {q.case('lower(f)', rules.FREQUENCY_CODES, q.quote('PRN'), 'contains')} as compat, {q.case('lower(r)', rules.ROUTE_CODES, q.quote('26643006'), 'contains')} as route,"
    " coalesce(try_cast(nullif(regexp_extract(dose, '(\\d+\\.?\\d*)', 1), '') as double), 0.0) as value, coalesce(nullif(regexp_extract(dose, '(\\d+\\.?\\d*)\\s*([a-zA-Z]+)', 2), ''), 'mg') as unit from (" + FREQS + ")"
)
def fhir_codes(s, d):
    f = F.col("f")
    return view(s, d, FREQS).select("doc_id", fhir.frequency_code(f).alias("strict"), fhir.frequency_code(f, "compat").alias("compat"), fhir.route_code(F.col("r")).alias("route"), fhir.dose_value(F.col("dose")).alias("value"), fhir.dose_unit(F.col("dose")).alias("unit"))


def _bundles(s, d):
    med = F.struct(F.lit("Aspirin").alias("drug"), F.lit("2 tablets").alias("dosage"), F.lit("twice daily").alias("frequency"), F.lit(None).cast("string").alias("route"))
    n = damaged(s, d).select(F.col("note_id").alias("doc_id"), F.array_repeat(med, (F.col("note_id") % 3).cast("int")).alias("meds"), F.filter(spans.condition_spans(F.col("text")), lambda e: e["label"] == "DISEASE").alias("entities"))
    return fhir.bundle(n)


# One document a dose, frequency, route, disease and lab of its own, so that every field of the resources is told apart.
RESOURCES = (
    "select doc_id, coalesce(lang, 'none') as drug, case when doc_id % 4 < 3 then concat(doc_id % 9 + 1, case when doc_id % 2 = 0 then ' ml' else '.5 tablets' end) end as dosage,"
    " case doc_id % 5 when 0 then 'Twice daily' when 1 then 'as needed' when 2 then 'hourly' when 3 then 'at bedtime' end as frequency, case doc_id % 3 when 0 then 'oral' when 1 then 'Intravenous' end as route,"
    " concat(coalesce(source, 'other'), ' disease') as disease, concat('level ', coalesce(n_chars, 0)) as lab from documents"
)


def _resources_sql() -> str:
    status = lambda v: "json_object('coding', json_array(json_object('system', '{}', 'code', '{}', 'display', '{}')))".format(*v)
    entry = lambda kind, fields: f"json_object('resource', {fields}, 'request', json_object('method', 'POST', 'url', '{kind}'))"
    frequency = q.case("lower(frequency)", sorted(rules.FREQUENCY_CODES, key=lambda x: -len(x[0])), q.quote("PRN"), "contains")
    route = q.case("lower(route)", rules.ROUTE_CODES, q.quote("26643006"), "contains")
    coding = lambda system, code, shown: f"json_object('coding', json_array(json_object('system', '{system}', 'code', {code}, 'display', {shown})))"
    unit = "coalesce(nullif(regexp_extract(dosage, '(\\d+\\.?\\d*)\\s*([a-zA-Z]+)', 2), ''), 'mg')"
    value = "coalesce(try_cast(nullif(regexp_extract(dosage, '(\\d+\\.?\\d*)', 1), '') as double), 0.0)"
    dose = f"json_object('text', dosage, 'doseAndRate', json_array(json_object('doseQuantity', json_object('value', {value}, 'unit', {unit}, 'system', 'http://unitsofmeasure.org', 'code', {unit}))))"
    timing = f"json_object('timing', json_object('code', {coding('http://terminology.hl7.org/CodeSystem/v3-GTSAbbreviation', frequency, 'frequency')}))"
    way = f"json_object('route', {coding('http://snomed.info/sct', route, 'route')})"
    parts = f"list_filter([case when dosage is not null then {dose}::varchar end, case when frequency is not null then {timing}::varchar end, case when route is not null then {way}::varchar end], lambda x: x is not null)"
    merged = f"case when len({parts}) = 0 then '[]' else '[{{' || array_to_string(list_transform({parts}, lambda x: x[2:-2]), ',') || '}}]' end"
    concept = "json_object('coding', json_array(json_object('system', 'http://www.nlm.nih.gov/research/umls/rxnorm', 'code', '', 'display', drug)), 'text', drug)"
    med = entry("MedicationRequest", f"json_object('resourceType', 'MedicationRequest', 'status', 'active', 'intent', 'order', 'medicationCodeableConcept', {concept}, 'dosageInstruction', ({merged})::json)")
    sick = entry("Condition", f"json_object('resourceType', 'Condition', 'clinicalStatus', {status(rules.CONDITION_ACTIVE)}, 'verificationStatus', {status(rules.CONDITION_CONFIRMED)}, 'code', json_object('text', disease))")
    seen = entry("Observation", "json_object('resourceType', 'Observation', 'status', 'final', 'code', json_object('text', lab), 'valueString', lab)")
    return f"""select doc_id, 1::bigint as n_medication, 1::bigint as n_condition, 1::bigint as n_observation,
 '{{"resourceType":"Bundle","type":"transaction","entry":[' || {med}::varchar || ',' || {sick}::varchar || ',' || {seen}::varchar || ']}}' as bundle from ({RESOURCES}) """


@query(f"""with c as (select note_id, count(*) as n from ({_conditions_sql("DISEASE")}) group by 1) select x.note_id as doc_id, (x.note_id % 3)::bigint as n_medication, coalesce(c.n, 0)::bigint as n_condition, 0::bigint as n_observation from ({DAMAGED}) x left join c on c.note_id = x.note_id""")
def fhir_bundle_counts(s, d):
    return _bundles(s, d).drop("bundle")


@query(_resources_sql())
def fhir_bundle_json(s, d):
    n = view(s, d, RESOURCES)
    med = F.struct("drug", "dosage", "frequency", "route")
    found = F.array(F.struct(F.lit("LAB").alias("label"), F.col("lab").alias("text")), F.struct(F.lit("DISEASE").alias("label"), F.col("disease").alias("text")))
    return fhir.bundle(n.select("doc_id", F.array(med).alias("meds"), found.alias("entities")))


CONCEPTS = [("1191", "aspirin", "Aspirin", "asa"), ("5640", "ibuprofen", "Ibuprofen", "ibu"), ("17767", "amlodipine", "Amlodipine", None), ("36567", "omeprazole", "Omeprazole", "prilosec")]
PAIR = [("1191", "5640", "high"), ("17767", "5640", "low")]
ASKED = "select doc_id, case doc_id % 5 when 0 then 'Aspirin ' when 1 then 'IBU' when 2 then 'amlodipine' when 3 then 'prilosec' else 'nothing' end as name from documents"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("null" if v is None else q.quote(v) for v in r) + ")" for r in rows)


@query(
    f"with c(rxcui, name, normalized_name, synonym) as (values {_values(CONCEPTS)}), a as (select distinct name from ({ASKED})) select a.name, coalesce(x.rxcui, y.rxcui) as rxcui, coalesce(x.normalized_name, y.normalized_name) as normalized_name,"
    " case when x.rxcui is not null then 'exact' when y.rxcui is not null then 'approximate' else 'none' end as match from a left join c x on lower(trim(a.name)) = x.name left join c y on lower(trim(a.name)) = y.synonym"
)
def rxnorm_normalize(s, d):
    return fhir.normalise_drug(view(s, d, ASKED).select("name").distinct(), s.createDataFrame(CONCEPTS, "rxcui string, name string, normalized_name string, synonym string"))


@query(
    f"with p(a, b, severity) as (values {_values(PAIR)}), m as (select distinct doc_id // 3 as doc_id, case doc_id % 7 when 0 then '1191' when 1 then '5640' when 2 then '1191' else '17767' end as rxcui from documents)"
    " select x.doc_id, p.a, p.b, p.severity from m x join p on p.a = x.rxcui join m y on y.doc_id = x.doc_id and y.rxcui = p.b"
)
def rxnorm_interactions(s, d):
    m = table(s, d, "documents").select(F.floor(F.col("doc_id") / 3).alias("doc_id"), F.when((F.col("doc_id") % 7).isin(0, 2), "1191").when(F.col("doc_id") % 7 == 1, "5640").otherwise("17767").alias("rxcui"))  # three documents a patient
    return fhir.interactions(m, s.createDataFrame(PAIR, "rxcui_a string, rxcui_b string, severity string"))


# ---- JSON ----
BLOCKS = "select event_id, concat(case event_id % 3 when 0 then 'Here: ' when 1 then '' else 'no json' end, case event_id % 3 when 2 then '' else props end, case event_id % 2 when 0 then ' done' else '' end) as reply from events"


@query(f"select event_id, nullif(regexp_extract(reply, '(?s)\\{{.*\\}}', 0), '') as block, cast(json_extract_string(nullif(regexp_extract(reply, '(?s)\\{{.*\\}}', 0), ''), '$.k') as bigint) as k from ({BLOCKS})")
def json_extract_block(s, d):
    block = text.json_block(F.col("reply"))
    return view(s, d, BLOCKS).select("event_id", block.alias("block"), F.get_json_object(block, "$.k").cast("long").alias("k"))


@query()
def json_repair(s, d):
    broken = view(s, d, NOTES).select("note_id", F.concat(F.lit("{name: 'x', dose: "), (F.col("note_id") % 9).cast("string"), F.lit(", }")).alias("t"))
    return broken.select("note_id", F.from_json(text.repair_json(F.col("t")), "name string, dose int").alias("j")).select("note_id", "j.name", "j.dose")


# ---- OCR decisions ----
CANDIDATES = """select event_id as image_id, case when event_id % 4 = 0 then null when event_id % 4 = 1 then 'take one tablet' else 'rx' end as vlm_text, 'groq' as vlm_source,
 case event_id % 3 when 0 then 'take one tablet now' when 1 then '' else 'other words' end as easyocr_text, case event_id % 5 when 0 then 'tess' else '' end as tesseract_text,
 case event_id % 7 when 0 then 'a region text that is long enough' when 1 then 'short' else null end as roi_text, case event_id % 2 when 0 then 'handwritten text' else 'no' end as trocr_text from events"""
JAC = "(len(list_intersect(va, ha))::double / greatest(len(list_distinct(list_concat(va, ha))), 1))"


@query(
    f"""with c as (select *, nullif(vlm_text, '') as vlm, coalesce(nullif(easyocr_text, ''), nullif(tesseract_text, '')) as hy, list_filter([nullif(roi_text, ''), nullif(easyocr_text, ''), nullif(tesseract_text, '')], lambda x: x is not null) as av from ({CANDIDATES})),
 w as (select *, list_distinct(list_filter(string_split_regex(lower(coalesce(vlm, '')), '\\s+'), lambda x: x <> '')) as va, list_distinct(list_filter(string_split_regex(lower(coalesce(hy, '')), '\\s+'), lambda x: x <> '')) as ha from c)
 select image_id, case when vlm is not null then vlm when len(av) > 0 then case when length(roi_text) > 20 then roi_text else array_to_string(av, chr(10)) end when length(trocr_text) > 5 then trocr_text else '' end as text,
 case when vlm is not null and hy is not null and {JAC} > 0.5 then 'vlm_ensemble_groq' when vlm is not null then 'vlm_groq' when len(av) > 0 then 'hybrid' when length(trocr_text) > 5 then 'handwriting' else 'none' end as method,
 case when vlm is not null and hy is not null and {JAC} > 0.5 then 0.95::double when vlm is not null or len(av) > 0 then 0.9::double when length(trocr_text) > 5 then 0.85::double else 0.0::double end as confidence from w"""
)
def ocr_select(s, d):
    return ocr.select(view(s, d, CANDIDATES)).drop("passes")


WORDS = "select event_id % 500 as image_id, case event_id % 3 when 0 then 'default' when 1 then 'handwritten' else 'printed' end as pass, cast(event_id % 3 as int) as pass_no, event_type as word, cast(event_id % 101 as double) - 1.0 as conf from events"
PASS_SQL = f"select image_id, pass, pass_no, coalesce(cast(format('{{:.2f}}', avg(case when conf > 0 then conf end) / 100.0::double) as double), 0.0::double) as mean_confidence, count(case when conf > 0 then 1 end) as word_count from ({WORDS}) group by 1, 2, 3"


@query(PASS_SQL)
def ocr_pass_confidence(s, d):
    return ocr.pass_confidence(view(s, d, WORDS))


@query(f"select image_id, pass, mean_confidence, word_count from (select *, row_number() over (partition by image_id order by mean_confidence desc, pass_no) as r from ({PASS_SQL})) where r = 1")
def ocr_best_pass(s, d):
    return ocr.best_pass(ocr.pass_confidence(view(s, d, WORDS)))


OTHER = "case image_id % 3 when 0 then null when 1 then ' short ' else 'Tab aspirin 75 mg once daily' end"


@query(f"""with b as (select *, {OTHER} as other from (select *, row_number() over (partition by image_id order by mean_confidence desc, pass_no) as r from ({PASS_SQL})) where r = 1), u as (select *, mean_confidence < 0.8 and coalesce(length(trim(other)), 0) > 10 as used from b)
select image_id, case when used then 'glm_ocr_fallback' else 'multi_pass' end as method, case when used then 0.9::double else mean_confidence end as confidence, used as fallback_triggered, case when used then concat('tesseract_confidence_', format('{{:.2f}}', mean_confidence), '_below_0.8') end as fallback_reason from u""")
def ocr_fallback(s, d):
    best = ocr.best_pass(ocr.pass_confidence(view(s, d, WORDS))).withColumn("text", F.lit("")).withColumn("other_text", F.expr(OTHER))
    return ocr.fallback(best).drop("text")


@query(f"select image_id, word, max(conf) as conf from ({WORDS}) group by 1, 2")
def ocr_word_confidence(s, d):
    return ocr.word_confidence(view(s, d, WORDS))


@query(f"select note_id, round(least(least(length(text) / 200.0::double, 1.0::double) * 0.4::double + least(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) / 50.0::double, 1.0::double) * 0.3::double + ({' + '.join(f'contains(lower(text), {q.quote(w)})::int' for w in rules.QUALITY_WORDS)}) / 9.0::double * 0.3::double, 1.0::double), 9) as quality from ({DAMAGED})")
def ocr_text_quality(s, d):
    return damaged(s, d).select("note_id", F.round(text.text_quality(F.col("text")), 9).alias("quality"))


@query("with p as (select a.conv_id, a.text as x, b.text as y from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1), w as (select conv_id, x, y, list_distinct(list_filter(string_split_regex(lower(x), '\\s+'), lambda v: v <> '')) as a, list_distinct(list_filter(string_split_regex(lower(y), '\\s+'), lambda v: v <> '')) as b from p) select conv_id, round(len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))), 9) as similarity from w")
def ocr_jaccard(s, d):
    c = table(s, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("y"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", F.round(ocr.jaccard(F.col("text"), F.col("y")), 9).alias("similarity"))


PROFILE = "select user_id as image_id, cast(event_id as int) as row_no, case when event_id % 60 < 25 then 10.0 else 0.5 end as value from events"


@query(
    f"""with o as (select *, row_no - row_number() over (partition by image_id order by row_no) as g from (select p.image_id, row_no, value from ({PROFILE}) p join (select image_id, max(value) as peak from ({PROFILE}) group by 1) using (image_id) where value > 0.1 * peak)),
 r as (select image_id, min(row_no) as a, max(row_no) as b from o group by image_id, g having max(row_no) - min(row_no) + 1 >= 1), l as (select *, case when a - lag(b) over (partition by image_id order by a) < 15 then 0 else 1 end as new from r), n as (select *, sum(new) over (partition by image_id order by a) as line from l)
 select image_id, greatest(min(a) - 10, 0)::int as top, (max(b) + 10)::int as bottom from n group by image_id, line"""
)
def profile_line_merge(s, d):
    return ocr.merge_lines(view(s, d, PROFILE), least=1)


BOXES = "select user_id as image_id, cast(event_id % 90 as int) as x, cast(event_id as int) as y, cast(20 + event_id % 83 as int) as w, cast(30 + event_id % 71 as int) as h from events"


@query(f"select image_id, rank::int as rank, x, y, w, h, rank <= 6 as processed from (select *, row_number() over (partition by image_id order by w * h desc, y, x) as rank from ({BOXES}) where w * h >= 1500 and not (w > 98.0 and h > 98.0)) where rank <= 12")
def roi_topk(s, d):
    return ocr.regions(view(s, d, BOXES), 100, 100)


TYPES = "select event_id, case event_id % 3 when 0 then 'application/pdf' when 1 then 'image/png' else 'text/plain' end as content_type, case event_id % 5 when 0 then 0.0 when 1 then 0.5 when 2 then 0.9 when 3 then 0.75 else null end as conf from events"


@query(f"select event_id, case when content_type = 'application/pdf' then 'pdf' when content_type like 'image/%' then case when coalesce(nullif(conf, 0), 1) < 0.75 then 'image_handwritten' else 'image_printed' end else 'text' end as source from ({TYPES})")
def source_classify(s, d):
    return view(s, d, TYPES).select("event_id", ocr.source_of(F.col("content_type"), F.col("conf").cast("double")).alias("source"))


@query()
def autocorrect_drug(s, d):
    return view(s, d, NAMES).select("name").distinct().select("name", ocr.closest_common_drug(F.col("name")).alias("corrected"))


# ---- service ----
@query("select event_type, user_id % 3 as model, count(*) as n from events group by 1, 2")
def metrics_counters(s, d):
    return service.counters(table(s, d, "events").withColumn("model", F.col("user_id") % 3), "event_type", "model")


@query("select event_type, le, count(*) filter (where value / 100 <= le) as n from events, (select unnest([" + ", ".join(f"{b}::double" for b in service.BUCKETS) + "]) as le) group by 1, 2 union all select event_type, 'inf'::double, count(value) from events group by 1")
def metrics_histogram(s, d):
    return service.histogram(table(s, d, "events").withColumn("seconds", F.col("value") / 100), "seconds", "event_type")


@query("select event_type, arg_max(value, event_id) as value from events group by 1")
def metrics_gauges(s, d):
    return service.gauges(table(s, d, "events"), F.col("value"), F.col("event_id"), "event_type")


@query("select event_id, event_type as label, case when event_id % 3 > 0 then cast(json_extract_string(props, '$.k') as bigint) end as k, event_id % 4 > 0 as hit from events")
def cache_codec(s, d):
    """Results with null fields through the cache's text form and back; a broken entry is a miss, its result is computed anew."""
    result = F.struct(F.col("event_type").alias("label"), F.when(F.col("event_id") % 3 > 0, F.get_json_object("props", "$.k").cast("long")).alias("k"))
    cached = table(s, d, "events").select("event_id", result.alias("r"), F.when(F.col("event_id") % 4 > 0, text.encode_result(result)).otherwise("{broken").alias("cached"))
    got = cached.withColumn("got", text.decode_result(F.col("cached"), "label string, k long"))
    return got.select("event_id", F.coalesce("got", "r").alias("x"), F.col("got").isNotNull().alias("hit")).select("event_id", "x.*", "hit")


ITEM_SQL = "select event_id as extraction_id, case when doc_id is null then 'not_found' when trim(text) = '' or length(text) > 400 then 'failed' else 'completed' end as status, case when doc_id is null then null when trim(text) = '' then 'Text cannot be empty' when length(text) > 400 then 'Text is too long' end as error from events left join documents on doc_id = event_id"


@query("select h as hits, m as misses, h / greatest(h + m, 1)::double as hit_rate from (select count(*) filter (where event_type = 'view') as h, count(*) filter (where event_type = 'error') as m from events)")
def cache_hit_rate(s, d):
    return service.hit_rate(table(s, d, "events"), F.col("event_type") == "view", F.col("event_type") == "error")


@query("select concat('model-', user_id % 4) as model, count(*) as usage from events group by 1")
def model_usage(s, d):
    return table(s, d, "events").groupBy(F.concat(F.lit("model-"), (F.col("user_id") % 4).cast("string")).alias("model")).agg(F.count("*").alias("usage"))


RATE_SQL = """with p as (select distinct user_id as key, cast(floor(epoch(ts)) as bigint) as sec from events), u as (select *, count(*) over (partition by key order by sec range between 86399 preceding and current row) as used from p)
select key, sec, used, greatest(5 - used, 0)::bigint as remaining, used <= 5 as allowed from u"""


def _requests(s, d):
    return table(s, d, "events").select(F.col("user_id").alias("key"), "ts")


@query(RATE_SQL)
def rate_limit_window(s, d):
    return service.rate_window(_requests(s, d), 5, 86_400)


@query()
def rate_limit_exact(s, d):
    return service.rate_exact(_requests(s, d), 5, 86_400)


@query("select strftime(ts, '%Y-%m-%dT%H:%M:%S') as timestamp, user_id::varchar as \"user\", event_type as action, concat('event/', event_id) as resource, props as details, event_type <> 'error' as success from events")
def audit_log_rows(s, d):
    return service.audit_rows(table(s, d, "events"), F.col("user_id"), F.col("event_type"), F.concat(F.lit("event/"), F.col("event_id").cast("string")), F.col("props"), F.col("event_type") != "error")


@query()
def ab_assign(s, d):
    return table(s, d, "events").select("event_id", service.assign_model(F.col("event_id"), ["general", "clinical"]).alias("model"))


@query("select conv_id as batch, (row_number() over (partition by conv_id order by turn) - 1)::int as index, not (trim(text) = '' or length(text) > 400) as success, case when trim(text) = '' then 'Text cannot be empty' when length(text) > 400 then 'Text is too long' end as error from conversations")
def batch_index_results(s, d):
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    b = table(s, d, "conversations").groupBy(F.col("conv_id").alias("batch")).agg(texts.alias("texts"))
    return service.indexed_results(b, longest=400)


@query()
def slot_entities(s, d):
    """A plugged-in extractor (here: words of capitals) beside the empty default."""

    def load():
        import re

        return lambda texts: [[{"text": m[0], "label": "DRUG", "start": m.start(), "end": m.end()} for m in re.finditer(r"\b[A-Z]{2,}\b", t)] for t in texts]

    registry = slots.Registry()
    registry.register(slots.Slot("capitals", load))
    return notes(s, d).select("note_id", F.explode(registry.column(F.col("text"))).alias("e")).select("note_id", "e.*")


# ---- streams ----
def _stream(s, d):
    schema = table(s, d, "events").schema
    raw = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


@query("select date_trunc('day', ts) as start, event_type, count(*) as n from events group by 1, 2")
def stream_windowed_counts(s, d):
    """Daily counts by type as a stream; complete mode, so the last window is there too."""
    counts = jobs.windowed_counts(_stream(s, d)).drop("total")
    out = jobs.run_once(counts, "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("select count(distinct event_type) as contents from events")
def stream_distinct_contents(s, d):
    once = jobs.distinct_contents(_stream(s, d), keep="60 days", text="event_type")
    return jobs.run_once(once.select("event_type")).agg(F.countDistinct("event_type").alias("contents"))


@query(ITEM_SQL)
def stream_item_status(s, d):
    """Each queued item's status, as a stream joined with the table of extractions."""
    known = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("raw_text"))
    return jobs.run_once(service.item_status(_stream(s, d).select(F.col("event_id").alias("extraction_id")), known, 400))


@query()
def stream_rate_limited(s, d):
    limited = jobs.rate_limited(_stream(s, d).select(F.col("user_id").alias("key"), "ts"), 5, 86_400)
    return jobs.run_once(limited)
