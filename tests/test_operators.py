"""Operators on literal rows; expected values follow from the rules by hand."""

import json
import random

import pytest
from pyspark.sql import functions as F

from notewell.functions import rules, text
from notewell.operators import entities, fhir, knowledge, medications, ocr, phi, review, service, slots, spans
from notewell.sources import readers, writers
from notewell.streaming import jobs

V = rules.Vocabulary()


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


def test_text_repairs(spark):
    t = F.col("t")
    assert one(spark, text.strip_labels(t), t="coughDISEASE and StrengthDrug  DRUGDRUG x") == "cough and x"
    assert one(spark, text.preprocess(t, [("asprin", "aspirin")]), t="Asprin 500mg BD ##fooBar  1-0-1") == "aspirin 500 mg twice daily foo Bar twice daily"
    assert one(spark, text.ocr_cleanup(t, "strict"), t="metoprolol 5 me and zee dol DRUG time") == "metoprolol 5 mg and zeedol time"
    assert one(spark, text.normalise(t), t="ﬁne\ntext q8h po") == "fine text every 8 hours by mouth"
    assert one(spark, text.title(t), t="co-amoxiclav forte") == "Co-Amoxiclav Forte"
    assert one(spark, text.json_block(t), t='```json\n{"a": {"b": 1}}\n```') == '{"a": {"b": 1}}' and one(spark, text.json_block(t), t="none") is None
    assert json.loads(one(spark, text.repair_json(t), t="{name: 'x', list: [1, 2,], }")) == {"name": "x", "list": [1, 2]}


def test_spans_index_their_text(spark):
    rng = random.Random(0)
    parts = ["500 mg ", "aspirin", " for 3 weeks ", "Chest Pain", "é ", "copd ", "pancreatitis ", "twice daily ", "\n", "x"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, t string").select("id", "t", F.explode(spans.extract(F.col("t"), V)).alias("s"))
    found = df.collect()
    assert found and all(r.t[r.s.start : r.s.end] == r.s.text for r in found)


def test_similarity_and_closest(spark):
    assert one(spark, spans.similarity(F.col("a"), F.col("b")), a="aspirn", b="aspirin") == pytest.approx(200 * 6 / 13)
    words = spark.createDataFrame([("asprin",), ("ibuprofn",), ("zzzz",)], "word string")
    assert {r.word: r.term for r in spans.closest_terms(words, V).collect()} == {"asprin": "aspirin", "ibuprofn": "ibuprofen"}
    notes = spark.createDataFrame([(1, "Took Asprin and aspirin")], "note_id long, text string")
    assert [(r.text, r.start, r.term) for r in spans.fuzzy_spans(notes, V).collect()] == [("Asprin", 5, "aspirin")]


def test_first_pattern_bars_later_ones(spark):
    got = one(spark, spans.condition_spans(F.col("t")), t="low back pain and angina for 3 weeks, seen 2 weeks ago")
    assert [(s.text, s.label) for s in got] == [("angina", "DISEASE"), ("low back pain", "DISEASE"), ("for 3 weeks", "DURATION"), ("2 weeks ago", "DURATION")]


def test_entity_rules(spark):
    v = lambda n: one(spark, entities.valid_drug(F.col("n"), V), n=n)
    assert [v(n) for n in ("ab", "Aspirin", "Inhaled Corticosteroid", "Inhaled Aspirin", "colgate x", "pro", "abcd", "xyz")] == [False, True, False, True, False, False, True, False]
    c = lambda n: one(spark, entities.clean_drug_name(F.col("n"), V), n=n)
    assert [c(n) for n in ("Zeedol Pt", "phexin phexin", "Tab Crocin 500", "vitamin b12", "Insulin glargine er", "12")] == ["Aceclofenac", "Cephalexin", "Paracetamol", "Vitamin", "Insulin", "12"]


def _spans(rows):
    return F.array(*[F.struct(F.lit(t).alias("text"), F.lit(k).alias("label"), F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(0.9).alias("score"), F.lit(i).alias("layer")).cast(spans.SPAN) for i, (t, k, a, b) in enumerate(rows)])


def test_duplicates_leave_disjoint_spans(spark):
    rng = random.Random(2)
    for _ in range(5):
        rows = [(rng.choice("abcd"), rng.choice(["DRUG", "FORM"]), a, a + rng.randint(1, 9)) for a in [rng.randint(0, 30) for _ in range(12)]]
        kept, seen = [], set()
        for t, k, a, b in sorted(rows, key=lambda r: (r[2], -r[3], rows.index(r))):
            if any(not (b <= x or a >= y) for x, y in kept) or (t, k) in seen:
                continue
            kept.append((a, b))
            seen.add((t, k))
        got = one(spark, entities.drop_duplicates(_spans(rows)), t="")
        assert [(s.start, s.end) for s in got] == kept


def test_medications(spark):
    note = "Aspirin 500 mg twice daily for 5 days. Then Crocin tablet. Next Plax now"
    rows = [("Aspirin", "DRUG", 0, 7), ("500 mg", "STRENGTH", 8, 14), ("twice daily", "FREQUENCY", 15, 26), ("5 days", "DURATION", 31, 37), ("Crocin", "DRUG", 44, 50), ("tablet", "FORM", 51, 57), ("Plax", "DRUG", 64, 68)]
    df = spark.createDataFrame([(1, note, *r, 0.95) for r in rows], "doc_id long, doc_text string, text string, label string, start int, end int, score double")
    got = medications.group_medications(df, V).orderBy("med_no").collect()
    assert [(m.drug, m.strength, m.frequency, m.duration, m.form) for m in got] == [("Aspirin", "500 mg", "twice daily", "5 days", None), ("Paracetamol", None, None, None, "tablet")]
    assert medications.standard_text(medications.group_medications(df, V)).first().standardized == "Aspirin 500 mg - twice daily for 5 days\nParacetamol (tablet)"


def test_phi_redaction(spark):
    t = "DOB: 01/02/1980 mail a.b@c.org SSN 123-45-6789"
    tagged = one(spark, phi.redact_tagged(F.col("t")), t=t)
    assert tagged == "[DOB_REDACTED] mail [EMAIL_REDACTED] SSN [SSN_REDACTED]"
    assert one(spark, phi.is_free(F.col("t")), t=tagged) is True
    r = one(spark, phi.report(F.col("t")), t=t)
    assert r.phi_detected and r.risk_level in ("MEDIUM", "HIGH") and all(len(f.text) <= 6 for f in r.findings)
    assert one(spark, phi.mask(F.col("t")), t="abcdefg") == "abc..." and one(spark, phi.mask(F.col("t")), t="abcdef") == "abcdef"


def test_knowledge_last_writer_and_sources(spark):
    old = spark.createDataFrame([("a", "A", "drug", 2, "10")], "term string, corrected string, category string, confidence int, sources string")
    delta = spark.createDataFrame([("a", "first", "drug", 2, 0), ("a", "last", "disease", 3, 0), ("b", "B::X", "entity", 3, 1)], "term string, corrected string, category string, extraction_id long, seq int")
    got = {r.term: r for r in knowledge.merge(old, delta).collect()}
    assert (got["a"].corrected, got["a"].category, got["a"].confidence, got["a"].sources, got["a"].is_new) == ("last", "disease", 4, "10,2,3", False)
    assert {(r.kind, r.term, r.value) for r in knowledge.interpret(knowledge.merge(old, delta)).collect()} == {("correction", "a", "last"), ("label", "b", "X")}


def test_review_sampling_is_stable(spark):
    rows = [(i, "pending", [(f"e{j}", 0.1 * j) for j in range(i % 11)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, status string, entities array<struct<text:string,score:double>>")
    a, b = (sorted(r.id for r in review.diverse(df.repartition(n), 9).collect()) for n in (1, 7))
    assert a == b and len(a) == 9


def test_fhir(spark):
    assert one(spark, fhir.frequency_code(F.col("f")), f="Once daily") == "QD" and one(spark, fhir.frequency_code(F.col("f"), "compat"), f="Once daily") == "BID"
    med = F.struct(F.lit("Aspirin").alias("drug"), F.lit(None).cast("string").alias("dosage"), F.lit("twice daily").alias("frequency"), F.lit("oral").alias("route"))
    strict, compat = (one(spark, F.to_json(fhir.medication_request(med, m)), t="") for m in ("strict", "compat"))
    assert json.loads(strict)["dosageInstruction"][0]["route"]["coding"][0]["code"] == "26643006" and json.loads(compat)["dosageInstruction"] == []


def test_ocr_choice(spark):
    rows = [(1, "a b c", "g", "a b c d", "", None, None), (2, "a", "g", "x y", "", None, None), (3, None, None, "", "tess", "short", None), (4, None, None, "", "", "", "hand written"), (5, "", None, "", "", None, "no")]
    df = spark.createDataFrame(rows, "image_id int, vlm_text string, vlm_source string, easyocr_text string, tesseract_text string, roi_text string, trocr_text string")
    assert [(r.method, r.confidence) for r in ocr.select(df).orderBy("image_id").collect()] == [("vlm_ensemble_g", 0.95), ("vlm_g", 0.9), ("hybrid", 0.9), ("handwriting", 0.85), ("none", 0.0)]


def test_rate_limit_machine(spark):
    from datetime import datetime, timedelta

    t0, rng = datetime(2024, 1, 1), random.Random(3)
    rows = [(k, t0 + timedelta(seconds=rng.randint(0, 300))) for k in ("a", "b") for _ in range(120)]
    got = {}
    for r in service.rate_exact(spark.createDataFrame(rows, "key string, ts timestamp"), 5, 60).collect():
        got.setdefault((r.key, int((r.ts - t0).total_seconds())), []).append(r.allowed)
    for k in ("a", "b"):
        held = []
        for s in sorted(int((t - t0).total_seconds()) for q, t in rows if q == k):
            held = [h for h in held if h > s - 60]
            ok = len(held) < 5
            if ok and s not in held:
                held.append(s)
            assert got[k, s].pop(0) == ok


def test_slots_and_sources(spark, tmp_path):
    registry = slots.Registry()
    assert one(spark, registry.column(F.col("t")), t="x") == []
    (tmp_path / "a.txt").write_text("hello é")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    got = {r.path.rsplit("/", 1)[-1]: r for r in readers.read_files(spark, str(tmp_path)).collect()}
    assert got["a.txt"].text == "hello é" and got["b.txt"].error == "not UTF-8" and got["c.pdf"].kind == "pdf" and bytes(got["c.pdf"].content) == b"%PDF"
    spark.createDataFrame([("1", "x")], "a string, note string").write.option("header", True).csv(f"{tmp_path}/t.csv")
    assert readers.read_any(spark, f"{tmp_path}/t.csv").collect()[0].note == "x"
    rows = spark.createDataFrame([("x",), ("y",)], "text string")
    for _ in range(2):
        writers.insert(rows, f"{tmp_path}/table")
    table = spark.read.parquet(f"{tmp_path}/table")
    assert table.select("id").distinct().count() == 4 and {r.status for r in table.collect()} == {"pending"}
    done = writers.update_status(table, spark.createDataFrame([(table.first().id, "completed", None), (-1, "failed", "x")], "id long, status string, error string"))
    assert sorted(r.status for r in done.collect()) == ["completed", "pending", "pending", "pending"]


def test_knowledge_stream(spark, tmp_path):
    kind = "term string, corrected string, category string, extraction_id long, seq int"
    empty = spark.createDataFrame([], "term string, corrected string, category string, confidence long, sources string")
    apply = jobs.knowledge_loop(None, str(tmp_path), empty)
    for epoch, n in ((0, 1), (1, 2), (1, 2)):
        apply(spark.createDataFrame([("a", f"v{n}", "drug", n, 0)], kind), epoch)
    got = spark.read.parquet(f"{tmp_path}/version=1").collect()
    assert [(r.term, r.corrected, r.confidence, r.sources) for r in got] == [("a", "v2", 2, "1,2")]


def test_unknown_names_become_the_nearest_term(spark):
    vocabulary = rules.Vocabulary(drugs=["amoxicillin", "aspirin", "ibuprofen"])
    names = spark.createDataFrame([("amoxicilin",), ("Aspirin",), ("zzzz",), ("ibuprofan",), ("ibuprofan",)], "name string")
    out = {r.name: (r.clean, r.fuzzy_matched) for r in entities.normalise_drug_names(names, vocabulary).collect()}
    assert out == {"amoxicilin": ("Amoxicillin", True), "Aspirin": ("Aspirin", False), "zzzz": ("Zzzz", False), "ibuprofan": ("Ibuprofen", True)}


def test_missed_drugs_longest_first_within_the_segment(spark):
    vocabulary = rules.Vocabulary(drugs=["insulin", "insulin glargine"], brands={"panadol": "paracetamol"})
    got = one(spark, spans.missed_drugs(F.col("t"), F.lit(4), F.lit(40), vocabulary), t="xyz Insulin glargine, PANADOL, insulins insulin")
    assert [(s.text, s.start, s.end) for s in got] == [("Insulin glargine", 4, 20), ("Insulin", 4, 11), ("PANADOL", 22, 29)]


def test_learned_vocabulary_and_its_bound(spark, monkeypatch):
    kind = "term string, corrected string, category string, confidence double"
    k = spark.createDataFrame([("asprin", "Aspirin", "drug", 2.0), ("newdrug", "newdrug", "drug", 1.0), ("low", "Lowe", "drug", 0.5), ("rash", "rash::symptom", "entity", 3.0)], kind)
    v = knowledge.extended(k, rules.Vocabulary(drugs=["ibuprofen"], brands={"panadol": "paracetamol"}))
    assert v.drugs == ["aspirin", "ibuprofen", "newdrug"] and v.brands == {"panadol": "paracetamol", "asprin": "Aspirin"}
    monkeypatch.setattr(knowledge, "MOST_LEARNED", 1)
    with pytest.raises(ValueError):
        knowledge.extended(k, rules.Vocabulary(drugs=["ibuprofen"], brands={}))


def test_hundredths_follow_the_exact_double(spark):
    values = [k / 200 for k in range(201)] + [k / 1000 for k in range(1001)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert all(r.h == round(r.v, 2) for r in df.select("v", ocr.hundredths(F.col("v")).alias("h")).collect())


def test_second_recogniser_only_where_the_first_is_unsure(spark):
    rows = [(1, "a", 0.5, "DRUG aspirin   75 mg daily"), (2, "b", 0.8, "aspirin 75 mg daily"), (3, "c", 0.1, "  short   "), (4, "d", None, None)]
    out = {r.image_id: r for r in ocr.fallback(spark.createDataFrame(rows, "image_id long, text string, mean_confidence double, other_text string")).collect()}
    assert (out[1].text, out[1].confidence, out[1].fallback_reason) == ("aspirin 75 mg daily", 0.9, "tesseract_confidence_0.50_below_0.8")
    assert [(out[i].text, out[i].fallback_triggered, out[i].fallback_reason) for i in (2, 3, 4)] == [("b", False, None), ("c", False, None), ("d", False, None)]


def test_replies_of_vision_models(spark):
    reply = 'Sure: ```json {"medications": [{"raw_text": "asprin DRUG 75 mg", "drug_name": "asprin", "frequency": "1-0-1"}, {"drug_name": null}], "illegible": false} ```'
    got = one(spark, ocr.prescription_of(F.col("t")), t=reply)
    assert got.error is None and [m.drug_name for m in got.medications] == ["Aspirin", None] and got.text == "asprin 75 mg "
    assert got.medications[0].frequency != "1-0-1"
    none = one(spark, ocr.prescription_of(F.col("t")), t="nothing here")
    assert none.error == "No JSON object found in text" and none.medications == [] and none.text == ""


def test_slots_for_bytes_and_failing_items(spark):
    def load():
        def model(items):
            if any(bytes(x) == b"bad" for x in items):
                raise ValueError("bad")
            return [bytes(x).decode().upper() for x in items]

        return model

    def back():
        return lambda items: [bytes(x)[::-1] for x in items]

    registry = slots.Registry()
    registry.register(slots.Slot("ocr", load))
    registry.register(slots.Slot("flip", back))
    df = spark.createDataFrame([(1, b"ab"), (2, b"bad"), (3, None), (4, b"cd")], "i int, c binary").coalesce(1)
    out = df.select("i", registry.read(F.col("c"), "ocr").alias("t"), registry.read(F.col("c"), "absent").alias("n"), registry.prepared(F.col("c"), "flip").alias("f"), registry.prepared(F.col("c")).alias("same")).orderBy("i").collect()
    assert [r.t for r in out] == ["AB", None, None, "CD"] and {r.n for r in out} == {None}
    assert [r.f and bytes(r.f) for r in out] == [b"ba", b"dab", None, b"dc"] and [r.same and bytes(r.same) for r in out] == [b"ab", b"bad", None, b"cd"]
    tokens = F.from_json(F.lit('[{"word": "rash", "entity_group": "SIGN", "score": 0.5, "start": 3, "end": 7}]'), slots.TOKENS)
    assert [tuple(e) for e in one(spark, slots.of_tokens(tokens), t="x")] == [("rash", "SIGN", 3, 7, 0.5)] and one(spark, slots.of_tokens(F.lit(None).cast(slots.TOKENS)), t="x") == []


def test_learned_terms_in_the_plan_and_as_a_table(spark, monkeypatch):
    texts = ["Fever and FEVER, x", "feverish a.b a+b", "", None, "ab", "Fever and FEVER, x", "x" * 3000 + "qz", "Ärger über ärger"]
    terms = [("fever", "S"), ("FEVER", "T"), ("a.b", "U"), ("qz", "V"), ("x", "W"), ("ärger", "X"), ("", "Y"), (None, "Z")]
    notes = spark.createDataFrame(list(enumerate(texts)), "note_id int, text string")
    known = spark.createDataFrame(terms, "term string, label string")
    expected = set()
    for i, t in enumerate(texts):
        for term, label in terms:
            at = (t or "").lower().find(term.lower()) if term else -1
            while at >= 0:
                expected.add((i, t[at : at + len(term)], label, at, at + len(term)))
                at = t.lower().find(term.lower(), at + len(term))
    for most in (500, 0):
        monkeypatch.setattr(spans, "MOST_IN_PLAN", most)
        got = [tuple(r) for r in spans.learned_spans(notes, known).collect()]
        assert len(got) == len(expected) and set(got) == expected


def matches(notes, terms):
    """All (note, text, label, start, end) of terms, of each from the left without overlaps."""
    out = set()
    for i, t in notes:
        for term, label in terms:
            at = (t or "").lower().find(term.lower()) if term else -1
            while at >= 0:
                out.add((i, t[at : at + len(term)], label, at, at + len(term)))
                at = t.lower().find(term.lower(), at + len(term))
    return out


@pytest.mark.parametrize("held", [32 << 20, 20_000])
def test_many_learned_terms_need_no_join_and_no_shuffle(spark, monkeypatch, held):
    monkeypatch.setattr(spans, "TERM_BYTES", held)
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abÄ€ ") for _ in range(n))
    notes = [(i, word(r.choice([0, 40, 900]))) for i in range(60)] + [(60, None), (61, "aa" * 40 + "B")]
    terms = sorted({(word(r.randint(1, 7)), r.choice("LM")) for _ in range(900)} | {(notes[i][1][9:39], "LONG") for i in range(20)}) + [("a" * 20, None), ("", "L"), (None, "L"), ("ab" * 500, "L")]
    known = spark.createDataFrame(terms, "term string, label string")
    assert len({(t.lower(), k) for t, k in terms if t}) > spans.MOST_IN_PLAN
    found = spans.learned_spans(spark.createDataFrame(notes, "note_id int, text string"), known)
    got = [tuple(x) for x in found.collect()]
    assert len(got) == len(set(got)) and set(got) == matches(notes, terms)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    some = spans.learned_spans(spark.createDataFrame(notes, "note_id int, text string"), spark.createDataFrame(terms[:100], "term string, label string"))
    assert "MapInArrow" in some._jdf.queryExecution().executedPlan().toString() and {tuple(x) for x in some.collect()} == matches(notes, terms[:100])
    shared = [(i // 2, t) for i, t in notes[:20] * 2]
    again = [tuple(x) for x in spans.learned_spans(spark.createDataFrame(shared, "note_id int, text string"), known).collect()]
    assert len(again) == len(set(again)) and set(again) == matches(shared, terms)


def test_files_are_routed_by_type(spark):
    rows = [(1, b"%PDF", "application/pdf"), (2, b"x", "image/webp"), (3, "é".encode(), "text/html"), (4, b"\xff", "text/plain"), (5, b"", None), (6, None, "text/plain")]
    got = {r.id: r for r in readers.routed(spark.createDataFrame(rows, "id int, content binary, content_type string")).collect()}
    assert [got[i].kind for i in range(1, 7)] == ["pdf", "image", "text", "text", "text", "text"]
    assert [got[i].text for i in range(1, 7)] == [None, None, "é", None, "", None] and [got[i].error for i in (3, 4, 5, 6)] == [None, "not UTF-8", None, None]
    assert bytes(got[1].content) == b"%PDF" and got[3].content is None
