"""Literal cases of single operators."""

import hashlib
import hmac
import json
import random
import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.operators import archive, audit, dates, evaluate, identity, labs, narrative, quality, relations, rollup, search, series, text_quality
from quirelake.sources import io
from quirelake.streaming import streams

from .conftest import rows

PAGE = "document_uuid string, page_number int, source string, text string"
SPAN = "document_uuid string, page_number int, sequence int, text string, confidence double, x_min double, y_min double, x_max double, y_max double"
TODAY = date(2026, 7, 1)


def detect(spark, *texts, **more):
    df = spark.createDataFrame([(f"{i:02d}", 1, "OCR", t) for i, t in enumerate(texts)], PAGE)
    return dates.detect_dates(df, F.lit(TODAY), **more)


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column(F.col("t"))).first()[0]


def test_labelled_dates_in_every_form(spark):
    forms = ["14/03/2026", "14-03-2026", "14.03.2026", "2026-03-14", "14/3/2026", "14 Mar 2026", "14 March 2026", "March 14 2026", "March 14, 2026"]
    found = detect(spark, *[f"Report Date: {f}" for f in forms]).collect()
    assert len(found) == len(forms)
    assert {(r.detected_date, r.candidate_type) for r in found} == {(date(2026, 3, 14), "REPORT_DATE")}


def test_only_calendar_dates_count(spark):
    assert rows(detect(spark, "29/02/2024", "29/02/2025", "31/02/2026", "32/01/2026", "00/12/2026", "2026-13-01"), "detected_date") == [(date(2024, 2, 29),)]


def test_ambiguous_and_unlabelled(spark):
    r = detect(spark, "03/04/2026").first()
    assert (r.detected_date, r.alternative_date, r.ambiguous, r.candidate_type) == (date(2026, 4, 3), date(2026, 3, 4), True, "UNKNOWN")
    assert dates.choose_suggested(detect(spark, "03/04/2026")).count() == 0


def test_arabic_lines_and_raw_slices(spark):
    found = detect(spark, "تاريخ التقرير: ١٤/٠٣/٢٠٢٦\nتاريخ الميلاد: ٠١/٠١/١٩٩٠\nتاريخ الفحص: ١٣/٠٣/٢٠٢٦", keep_raw=True).orderBy("occurrence_index").collect()
    assert [r.candidate_type for r in found] == ["REPORT_DATE", "DATE_OF_BIRTH", "EXAMINATION_DATE"]
    assert found[0].raw_value == "١٤/٠٣/٢٠٢٦"


def test_suggestion_and_tie(spark):
    several = detect(spark, "DOB: 01/01/1990\nCollection Date: 10/03/2026\nReport Date: 14/03/2026\nPrinted: 15/03/2026", "Report Date: 14/03/2026\nReport Date: 15/03/2026")
    assert several.count() == 6
    assert rows(dates.choose_suggested(several), "document_uuid", "detected_date") == [("00", date(2026, 3, 14))]


def test_future_penalty_previous_line_and_compact(spark):
    r = {x.document_uuid: x for x in detect(spark, "Report Date: 14/03/2030", "Report Date\n\n14/03/2026", "التاريخ٢٠٢١٠١٠٢", "Barcode number 20210102", "20210102").collect()}
    assert r["00"].score == pytest.approx(0.43) and r["01"].score == pytest.approx(0.93) and r["02"].parsing_rule == "COMPACT_YMD"
    assert set(r) == {"00", "01", "02"}


def test_long_context_is_cut(spark):
    r = detect(spark, "x" * 200 + " Report Date: 14/03/2026 " + "y" * 200).first()
    assert len(r.context) == 160 and "14/03/2026" in r.context


def test_normalisation(spark):
    assert one(spark, T.normalize_text, "a \t b\r\n\r\nc⁄١\u200f–２") == "a b\nc/1-2"


def grid(doc, table, page=1):
    out, q = [], 0
    for i, line in enumerate(table):
        for x, t in line:
            out.append((doc, page, q, t, 0.9, x, 0.05 + i * 0.04, x + 0.1, 0.07 + i * 0.04))
            q += 1
    return out


def cells(*texts, at=(0.05, 0.3, 0.5, 0.7)):
    return list(zip(at, texts))


def parse(spark, spans):
    return labs.parse_pages(spark.createDataFrame(spans, SPAN)).orderBy("document_uuid", "page_number", "row_index").collect()


HEAD = cells("Item", "Result", "Unit", "Reference Range")


def test_lab_grid_with_section_and_wrapped_range(spark):
    found = parse(spark, grid("a", [HEAD, cells("Chemistry"), cells("Glucose", "95", "mg/dL", "70-99"), cells("HbA1c", "5.4", "%", "Normal 4 - 5.6"), [(0.7, "Pre diabetic 5.7 - 6.4")], cells("Creatinine", "0.9", "mg/dL", "0.6-1.2")]))
    assert [r.test_name_raw for r in found] == ["Glucose", "HbA1c", "Creatinine"]
    assert (float(found[0].reference_low), float(found[0].reference_high)) == (70, 99)
    assert found[1].reference_range_raw.endswith("Pre diabetic 5.7 - 6.4") and found[1].reference_low is None


def test_lab_flags_misread_header_and_repeated_header(spark):
    at = (0.02, 0.2, 0.3, 0.4, 0.6, 0.7)
    head, again = cells("Test", "ResuIt", "Flags", "Unlts", "Low", "High", at=at), cells("Test", "Result", "Flags", "Units", "Low", "High", at=at)
    found = parse(spark, grid("a", [head, cells("WBC", "6.71", "R", "x10^3/µL", "3.60", "10.20", at=at), again, cells("RBC", "4.5", "H", "x10^6/µL", "4", "6", at=at)]))
    assert [(r.test_name_raw, r.flag_raw, r.unit_raw, float(r.reference_low)) for r in found] == [("WBC", "R", "x10^3/µL", 3.6), ("RBC", "H", "x10^6/µL", 4.0)]


def test_lab_two_panels_side_by_side(spark):
    at = (0.05, 0.2, 0.5, 0.7)
    found = parse(spark, grid("a", [cells("Test", "Result", "Test", "Result", at=at), cells("WBC", "6", "RBC", "5", at=at)]))
    assert [(r.test_name_raw, r.result_raw) for r in found] == [("WBC", "6"), ("RBC", "5")]


def test_lab_metadata_narrative_and_watermark(spark):
    assert [r.test_name_raw for r in parse(spark, grid("a", [cells("Patient ID 123", "x"), cells("Glucose", "95", "mg/dL", "70-99")]))] == ["Glucose"]
    assert parse(spark, grid("b", [[(0.05, "The liver is of normal size and shape.")], [(0.05, "No focal lesion is seen.")]])) == []
    spans = grid("c", [HEAD, cells("Glucose", "95", "mg/dL", "70-99")]) + [("c", 1, 99, "مختبر", 0.9, 0.5, 0.05, 0.6, 0.15)]
    assert [(r.test_name_raw, r.unit_raw) for r in parse(spark, spans)] == [("Glucose", "mg/dL")]


def test_lab_row_survives_small_offsets(spark):
    spans = [list(s) for s in grid("a", [HEAD, cells("Glucose", "95", "mg/dL", "70-99")])]
    spans[5][6] += 0.004
    spans[5][8] += 0.004
    assert len(parse(spark, [tuple(s) for s in spans])) == 1


def lines(doc, *texts, gaps=()):
    y, out = 0.1, []
    for i, t in enumerate(texts):
        y += 0.2 if i in gaps else 0.0
        out.append((doc, 1, i, t, 0.9, 0.1, y, 0.9, y + 0.01))
        y += 0.012
    return out


def test_narrative_sections_and_fringe(spark):
    body = "The liver is of normal size, shape and echo texture without a lesion."
    spans = lines("a", "Some Head Line", "Findings", body, body, "Impression", body, "1234567", gaps=(1,)) + lines("b")
    found = narrative.sections(spark.createDataFrame(spans, SPAN)).orderBy("sequence").collect()
    assert [(r.heading, r.body) for r in found] == [("Findings", f"{body}\n{body}"), ("Impression", body)]


def test_text_functions(spark):
    assert one(spark, lambda c: T.fingerprint(c, b"k"), " Ａb\n C ") == hmac.new(b"k", b"ab c", hashlib.sha256).hexdigest()
    assert one(spark, lambda c: T.fingerprint(c, b"k"), " ") == ""
    assert one(spark, T.normalize_test, " S. Glucose* ") == "GLUCOSE" and one(spark, T.normalize_unit, "X10^3 / µL") == "x10^3/µL"
    assert one(spark, T.sanitize_name, "C:\\a\\..re\x00port.pdf. ") == "report.pdf" and one(spark, T.sanitize_name, "...") == "medical-document"
    assert one(spark, T.plain_decimal, "12.500000") == "12.5" and one(spark, T.repair_digits, "1O0I5") == "10015" and one(spark, T.repair_digits, "AO") == "AO"
    assert one(spark, T.normalize_name, " Straße\tＡ ") == "strasse a" and one(spark, T.fold_ar, "أَلإ") == "الا"
    assert [one(spark, T.confidence_bucket, x, "double") for x in (0.95, 0.7, 0.1)] == ["high", "medium", "low"]
    assert [one(spark, T.report_subtype, t) for t in ("serum CBC panel", "Biochemistry", "x\nTest one\ny", "A" * 40 + "\n", "")] == ["LAB_CBC", "UNKNOWN", "LAB_CHEMISTRY", "UNKNOWN", "UNKNOWN"]


@pytest.mark.parametrize("json, expected", [
    ('{"token":{"a":{"b":{"c":{"d":"secret"}}}}}', '{"token":"[REDACTED]"}'), ('{"x":[[[{"raw":[[1,["}"]],{"a":"]"}],"y":"token"}]]]}', '{"x":[[[{"raw":"[REDACTED]","y":"token"}]]]}'),
    ('{"a":"say \\"token\\": {","secret":"\\"x"}', '{"a":"say \\"token\\": {","secret":"[REDACTED]"}'), ('{"\\u0074oken":{"a":1}}', '{"\\u0074oken":"[REDACTED]"}'), ('{"token":{"a":"never closed', '{"token":"[REDACTED]"'),
    ('{"token" : null, "text":-1.5e3,"tokens":{"a":1}}', '{"token":"[REDACTED]", "text":"[REDACTED]","tokens":{"a":1}}'), (None, None),
])
def test_redaction_at_any_depth(spark, json, expected):
    assert one(spark, T.redact, json) == expected


def test_redaction_at_depth(spark):
    json = '{"a": 1, "password": "x\\"y", "in": {"token": {"deep": [1, 2]}, "b": [{"text": null}]}, "texts": "kept"}'
    assert one(spark, T.redact, json) == '{"a": 1, "password":"[REDACTED]", "in": {"token":"[REDACTED]", "b": [{"text":"[REDACTED]"}]}, "texts": "kept"}'


def test_usability_thresholds(spark):
    pages = spark.createDataFrame([("a", 1, "x" * 15), ("a", 2, ""), ("b", 1, "x" * 25), ("b", 2, "")], "document_uuid string, page_number int, text string")
    found = {r.document_uuid: (r.usable, r.pages_requiring_ocr) for r in text_quality.usability(pages, 20, 10, 0.5).collect()}
    assert found == {"a": (False, 1), "b": (True, 1)}


def test_status_rules(spark):
    sets = {"ready": ["READY"], "partial": ["READY", "FAILED"], "failed": ["FAILED"], "waits": ["AWAITING_CONFIRMATION", "FAILED"], "busy": ["EXTRACTING", "READY"]}
    df = spark.createDataFrame([(k, s) for k, v in sets.items() for s in v], "document_uuid string, processing_status string")
    assert dict(rows(rollup.document_status(df))) == {"ready": "DATE_CONFIRMED", "partial": "PARTIAL", "failed": "FAILED", "waits": "AWAITING_CONFIRMATION", "busy": "PROCESSING"}


def test_filter_contract():
    for bad in ({"x": 1}, {"month": 3}, {"year": 1800}, {"report_from": date(2021, 1, 2), "report_to": date(2021, 1, 1)}, {"date_status": "UNCONFIRMED", "year": 2020}, {"q": "x" * 201}):
        with pytest.raises(ValueError):
            search.validate_filters(bad)
    assert search.validate_filters({"q": "a", "year": 2020, "month": 2})


def archive_rows(spark):
    data = [(str(i), "p", f"T{i % 3}", date(2020, 1 + i % 12, 1), i % 2 == 0, "ACTIVE" if i != 5 else "DELETED", datetime(2021, 1, 1 + i), i % 4) for i in range(12)]
    return spark.createDataFrame(data, "document_uuid string, patient_uuid string, document_type string, document_date date, date_verified boolean, archive_status string, created_at timestamp, healthcare_facility int")


def test_archive_pages_and_empty_summary(spark):
    df = archive_rows(spark)
    page, total = archive.page(archive.chronology(archive.active(df, "p")), 1, 3)
    assert total == 11 and [r.document_uuid for r in page.collect()] == ["11", "9", "7"]
    assert archive.by_month(df, 2020, 12).count() == 1 and archive.summary_cells(df.where("false")).count() == 0
    assert archive.active(df, df.select("patient_uuid").distinct()).count() == 11
    tree = archive.year_tree(df).collect()
    assert tree[0].year == 2020 and [m.month for m in tree[0].months] == [11, 9, 7, 5, 3, 1]
    pages = df.select("document_uuid", F.lit("AWAITING_CONFIRMATION").alias("processing_status"), F.lit(False).alias("date_verified"))
    assert archive.summary(df, pages).first().unconfirmed_count == 11


def test_ages(spark):
    df = spark.createDataFrame([(date(2008, 7, 2), TODAY), (date(2008, 7, 1), TODAY)], "b date, d date")
    assert [tuple(r) for r in df.select(archive.age_on(F.col("b"), F.col("d")), archive.is_minor(F.col("b"), F.col("d"))).collect()] == [(17, True), (18, False)]


def test_change_events(spark):
    old = spark.createDataFrame([("a", "X", "t", "d", "p")], "document_uuid string, document_type string, title string, description string, physician_name string")
    new = spark.createDataFrame([("a", "Y", "t2", "d2", "p")], old.schema)
    found = {r.event_type: r.fields for r in rollup.metadata_changes(old, new).collect()}
    assert found == {"DOCUMENT_TYPE_CHANGED": ["document_type"], "METADATA_UPDATED": ["description", "title"]}


def test_series(spark):
    df = spark.createDataFrame([("s", "m", "10.7", "1", 0), ("s", "m", "10.2", "2", 1), ("s", "m", "x", "3", 2), ("s", "m", "12", "1.5", 3)], "service string, metric string, ts string, value string, arrival int")
    clean = series.dedupe_series(df)
    assert rows(clean, "ts", "value") == [(10, 2.0), (12, 1.5)] and rows(series.to_rate(clean), "value") == [(0.0,)]
    assert rows(series.current_peak(clean), "current", "peak") == [(1.5, 2.0)]
    assert rows(series.stale(clean, F.lit(100)), "stale") == [(True,)]


def test_check_digit_tables(spark):
    assert one(spark, identity.check_digit, "AB2") == (0 * 7 + 1 * 3 + 28) % 10
    assert one(spark, lambda c: identity.check_digit(c, icao=True), "L898902C<") == 3


def test_records(spark):
    t3 = ["ID" + "IRQ" + "123456789" + "0" + "<" * 15, "JOHN" + "<" * 17 + "300101" + "0" + "IQ", "900101" + "0" + "M" + "<" * 22]
    t3 = [x.ljust(30, "<")[:30] for x in t3]
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(t3)] + [("b", 0, "short")], "record string, line_no int, text string")
    found = {r.record: r for r in identity.parse_records(df).collect()}
    assert found["a"].document_number == "123456789" and found["a"].date_of_birth == date(1990, 1, 1) and found["a"].sex == "M"
    assert found["b"].warnings == ["MRZ_NOT_DETECTED"]
    card = spark.createDataFrame([("c", 0, "IDIRQA123456785<<<<<"), ("c", 1, "9001017M3001012IRQ")], "record string, line_no int, text string")
    r = identity.national_card(card).first()
    assert (r.document_number, r.nationality, r.partial) == ("A12345678", "IRQ", True)
    fields = identity.field_confidences(identity.national_card(card), ("document_number", "sex"))
    assert {f.field for f in fields.collect()} == {"document_number", "sex"}


def test_card_numbers_names_and_dates(spark):
    df = spark.createDataFrame([("a", 1, "No 1234567890O1 A12345678"), ("a", 2, "Blood 0 +"), ("a", 3, "الاسم علي"), ("a", 4, "الاب"), ("a", 5, "حسن")], "record string, line_no int, text string")
    r = identity.number_fields(df).first()
    assert (r.card_number, r.body_number, r.blood_group) == ("123456789001", "A12345678", "O+")
    n = identity.name_chain(df).first()
    assert (n.name, n.father_name) == ("علي", "حسن")
    cards = {
        "glued": ["الاسم اناو اسماعيل", "باوكاسماعيل", "ابابيراسماعيل"], "waits": ["ناو", "الجنس ذكر", "اللقب: الحسني", "علي حسن", "باوكريم"],
        "mother": ["اسم علي", "ادايك زينب", "الاب حسن"], "nothing": ["علي", "حسن"], "closed": ["الاسم", "", "علي", "الاسم: ثان"],
    }
    lines = spark.createDataFrame([(c, i, t, 1.5 if c == "glued" else -1.0) for c, ts in cards.items() for i, t in enumerate(ts)], "record string, line_no int, text string, confidence double")
    got = {r.record: (r.name, r.father_name, r.grandfather_name, r.name_confidence) for r in identity.name_chain(lines).collect()}
    assert got == {"glued": ("اسماعيل", "اسماعيل", "اسماعيل", 1.0), "waits": ("علي حسن", "ريم", None, 0.7), "mother": ("علي", None, None, 0.7), "closed": ("ثان", None, None, 0.7)}
    days = spark.createDataFrame([("a", date(1990, 1, 1)), ("a", date(2020, 1, 1)), ("a", date(2030, 1, 1))], "record string, day date")
    p = identity.printed_dates(days, F.lit(TODAY)).first()
    assert (p.birth_date, p.issue_date, p.expiry_date) == (date(1990, 1, 1), date(2020, 1, 1), date(2030, 1, 1))


PATIENT = "uuid string, user_uuid string, full_name string, date_of_birth date, identity_status string"
IDENTITY = "uuid string, patient_uuid string, document_type string, document_number string, family_number string, verification_status string, status string, created_at timestamp"


def people(spark):
    patients = spark.createDataFrame([("g", "ug", "Guard", date(1980, 1, 1), "VERIFIED"), ("m", None, "Minor", date(2015, 1, 1), "UNVERIFIED"), ("f", None, "Free", date(1990, 1, 1), "VERIFIED")], PATIENT)
    docs = spark.createDataFrame([("1", "g", relations.CARD, "N1", "F9", "VERIFIED", "CURRENT", datetime(2020, 1, 1)), ("2", "m", relations.BIRTH, "N2", "", "PENDING", "CURRENT", datetime(2020, 1, 1)), ("3", "f", relations.CARD, "N3", "F1", "VERIFIED", "CURRENT", datetime(2020, 1, 1))], IDENTITY)
    links = spark.createDataFrame([("l1", "ug", "m", "FATHER", "VERIFIED", True, datetime(2021, 1, 1)), ("l2", "ug", "f", "FATHER", "VERIFIED", True, datetime(2021, 1, 1))], "uuid string, guardian_user string, minor_patient string, relationship string, verification_status string, active boolean, started_at timestamp")
    return patients, docs, links


def test_guardians_and_claims(spark):
    patients, docs, links = people(spark)
    day = F.lit(TODAY)
    assert rows(relations.guardian_access(links, patients, docs, day), "uuid") == [("l1",)]
    assert rows(relations.minors_of(links, patients, day), "uuid") == [("l1",)]
    assert rows(relations.expire_links(links, patients, day), "uuid", "reason") == [("l2", "ADULT")]
    assert dict(rows(relations.identity_status(patients, docs, day))) == {"g": "VERIFIED", "m": "PENDING_VERIFICATION", "f": "VERIFIED"}
    users = spark.createDataFrame([("A@x.org",)], "email string")
    claims = spark.createDataFrame([], "patient_uuid string, status string")
    requests = spark.createDataFrame([("f", "new@x.org"), ("f", "a@X.org"), ("g", "b@x.org"), ("m", "c@x.org")], "patient_uuid string, email string")
    assert rows(relations.eligible_claims(patients, docs, claims, users, requests, day), "email") == [("new@x.org",)]
    request = spark.createDataFrame([("g", "FATHER", relations.CARD, "F9"), ("g", "FATHER", relations.CARD, "F8"), ("g", "UNCLE", relations.CARD, "F9")], "guardian string, relationship string, document_type string, family_number string")
    assert rows(relations.family_match(request, docs), "family_number_result") == [("MATCH",), ("MISMATCH",), ("UNAVAILABLE",)]
    evidence = spark.createDataFrame([], "link string, created_at timestamp, kind string, file string")
    pending = links.withColumn("verification_status", F.lit("PENDING"))
    assert dict(rows(relations.approvable(pending, patients, docs, evidence, day), "uuid", "reason")) == {"l1": "NO_VERIFIED_DOCUMENT", "l2": "NOT_A_MINOR"}
    assert relations.guardian_review(links, patients, docs, evidence).count() == 2 and relations.type_conflicts(docs).count() == 0
    assert relations.pending_identity(docs).count() == 1


def test_files(spark):
    good = b"%PDF-1.7 x\n%%EOF\n"
    data = [("a", "x.pdf", "application/pdf", len(good), good), ("b", "x.png", "application/pdf", 4, b"%PDF"), ("c", "x.pdf", "application/pdf", 0, b""), ("d", "x.pdf", "application/pdf", 5, b"hello")]
    df = spark.createDataFrame(data, "uuid string, name string, mime string, length long, content binary")
    assert rows(quality.file_problems(df), "uuid", "rule") == [("b", "extension"), ("c", "empty"), ("d", "first_bytes")]


def test_rules(spark):
    df = spark.createDataFrame([("de", None, "x"), ("de", None, "x"), ("fr", "c", "x")], "country string, city string, normalized_name string")
    assert quality.violations(df, "facility_once").count() == 1
    spans = spark.createDataFrame([("a", 1, 0, "t", 0.5, 0.5, 0.1, 0.2, 0.3)], SPAN)
    assert quality.violations(spans, "span_box").count() == 1
    assert quality.foreign_evidence(spans.select("document_uuid", F.lit(2).alias("page_number"), "sequence"), spans).count() == 1


def test_scorecard_nulls(spark):
    schema = "expected_date date, expected_type string, candidates array<struct<day:date,kind:string>>, suggested_date date, suggested_type string, language string, pair string"
    d = date(2020, 1, 1)
    items = spark.createDataFrame([(d, "A", [(d, "A")], d, "A", "en", "p"), (d, "A", [(d, "B")], None, None, "en", "p"), (None, None, None, None, None, "ar", "q")], schema)
    done = evaluate.evaluate(items)
    r = evaluate.scorecard(done).first()
    assert (r.n, r.detection_recall, r.suggestion_accuracy, r.suggestion_precision, r.type_accuracy) == (2, 1.0, 0.5, 1.0, 0.5)
    assert evaluate.scorecard(done.where("false")).first().detection_recall is None
    assert evaluate.pair_consistency(done, "pair").first()[0] == 0.0


def test_sinks_and_payload(spark, tmp_path):
    payload = '[{"measurement":"x","values":[{"ts":1,"value":2.0},{"ts":2}]},{"measurement":"y","values":[]},{"values":[{"ts":9,"value":9}]}]'
    df = spark.createDataFrame([("s", payload)], "service string, payload string")
    assert rows(io.read_metric_payload(df, ["CPU", "MEM"])) == [("s", "CPU", 1.0, 2.0)]
    path = str(tmp_path / "sets")
    docs = spark.createDataFrame([("a", 1), ("b", 2)], "document_uuid string, x int")
    io.replace_current(docs, path, F.lit(datetime(2020, 1, 1)))
    io.replace_current(docs.where("document_uuid = 'a'").withColumn("x", F.lit(9)), path, F.lit(datetime(2020, 1, 2)))
    assert rows(io.read_current(spark, path, ["document_uuid"]), "document_uuid", "x") == [("a", 9), ("b", 2)]
    results = str(tmp_path / "results")
    for _ in range(2):
        io.replace_results(docs, results, "v1")
    assert spark.read.parquet(results).count() == 2
    assert io.purge({"t": docs}, docs.where("x = 1"))["t"].count() == 1
    for kind in ("json", "csv", "text"):
        io.write_report(docs, str(tmp_path / kind), kind)
    (tmp_path / "blobs").mkdir()
    (tmp_path / "blobs" / "f.bin").write_bytes(b"abc")
    assert io.read_blobs(spark, str(tmp_path / "blobs")).first().content_sha256 == hashlib.sha256(b"abc").hexdigest()
    logs = spark.createDataFrame([("p", datetime(2020, 1, 1))], "patient string, created_at timestamp")
    io.append_events(logs, str(tmp_path / "log"))
    io.append_events(logs, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    for ts, value in ((10, 1.0), (10, 2.0), (500, 3.0), (9000, 4.0), (8000, 5.0), (8500, 6.0)):
        if ts == 9000:
            kept = spark.read.parquet(str(tmp_path / "out"))
            assert rows(kept, "ts", "value") == [(10, 2.0), (500, 3.0)]
            assert rows(streams.live_current_peak(kept, 100, F.lit(500)), "peak") == [(3.0,)] and streams.live_rates(kept, 1000, F.lit(500)).count() == 1
        spark.createDataFrame([("s", "m", ts, value)], streams.POINT).coalesce(1).write.mode("append").parquet(source)
        streams.dedupe_stream(streams.read_points(spark, source), 600, str(tmp_path / "out"), str(tmp_path / "state"))
    # 8000 came too late for a retention of 600 seconds, the slot of 10 and 500 is gone
    assert rows(spark.read.parquet(str(tmp_path / "out")), "ts", "value") == [(8500, 6.0), (9000, 4.0)]
    pages = str(tmp_path / "pages")
    for k in range(2):
        spark.createDataFrame([("a", 1, "OCR", f"Report Date: 1{k}/03/2026")], PAGE).write.mode("append").parquet(pages)
        stream = spark.readStream.schema(PAGE).parquet(pages)
        streams.incremental(stream, lambda df: dates.detect_dates(df, F.lit(TODAY)), ["document_uuid", "page_number"], str(tmp_path / "found"), str(tmp_path / "state2"), buckets=4)
    assert rows(spark.read.parquet(str(tmp_path / "found")), "detected_date") == [(date(2026, 3, 11),)]


def test_rates_keep_state_across_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = streams.POINT + ", arrival long"
    for batch in ([("s", "m", 10, 1.0, 0), ("s", "m", 10, 2.0, 1)], [("s", "m", 20, 12.0, 2), ("t", "m", 5, 1.0, 3)], [("s", "m", 15, 99.0, 4), ("s", "m", 30, 2.0, 5)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        points = streams.read_points(spark, source, schema)
        streams.run(streams.stream_rates(points), str(tmp_path / "state"), lambda df, n: df.write.mode("overwrite").parquet(f"{out}/{n}"))
    # the last arrival at 10 counts; 15 comes after 20 and is too late; a counter that falls gives 0
    assert rows(spark.read.schema(streams.POINT).parquet(f"{out}/*"), "service", "ts", "value") == [("s", 20, 1024.0), ("s", 30, 0.0)]


def test_results_of_other_documents_stay(spark, tmp_path):
    path, schema = str(tmp_path / "r"), "document_uuid string, x int"
    io.replace_results(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], schema), path, "v1", buckets=1)
    io.replace_results(spark.createDataFrame([("a", 9)], schema), path, "v1", buckets=1)
    io.replace_results(spark.createDataFrame([("a", 7)], schema), path, "v2", buckets=1)
    assert rows(spark.read.parquet(path), "document_uuid", "x", "pipeline_version") == [("a", 7, "v2"), ("a", 9, "v1"), ("b", 3, "v1")]
    gone = spark.createDataFrame([("a",), ("b",)], "document_uuid string")
    io.replace_results(spark.createDataFrame([], schema), path, "v1", gone, buckets=1)
    assert rows(spark.read.parquet(path), "document_uuid", "x", "pipeline_version") == [("a", 7, "v2")]


def test_queues(spark):
    df = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("r", "c", 1)], "queue string, document_uuid string, created_at int")
    assert rows(archive.next_pending(df), "document_uuid", "next_uuid") == [("a", "b"), ("b", "a"), ("c", None)]
    assert audit.audit_counts(df, "queue").count() == 2


def test_quality_limits_and_adult_owner(spark):
    candidates = spark.range(1503).selectExpr("if(id < 501, 'a', if(id < 1001, 'b', 'c')) AS document_uuid", "id < 1100 AS is_current")
    assert rows(quality.violations(candidates, "candidates_per_document")) == [("candidates_per_document", "a", 501)]
    pages = spark.range(501).selectExpr("if(id < 251, 'a', 'b') AS document_uuid", "id AS page_number")
    assert rows(quality.violations(pages, "pages_per_document")) == [("pages_per_document", "a", 251)]
    people = spark.range(1).selectExpr("explode(array('u', null)) AS user_uuid").selectExpr("user_uuid", "explode(array(add_months(current_date(), -216), add_months(current_date(), -216) + 1, null)) AS date_of_birth")
    assert [(r.user_uuid, r.rule) for r in quality.violations(people, "owner_adult").collect()] == [("u", "owner_adult")]


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"?|[{}\[\]:,]|\s+|[^\s{}\[\]:,"]+', re.S)


def brute_redact(text, keys):
    """The values of the keys replaced by a walk in plain Python."""

    def key(token):
        try:
            return json.loads(token, strict=False)
        except ValueError:
            return token

    tokens, out, i = _TOKEN.findall(text), [], 0
    while i < len(tokens):
        token = tokens[i]
        out.append(token)
        i += 1
        if not token.startswith('"') or key(token) not in keys:
            continue
        colon = next((j for j in range(i, len(tokens)) if not tokens[j].isspace()), len(tokens))
        if colon == len(tokens) or tokens[colon] != ":":
            continue
        out.append(f':"{T.REDACTED}"')
        i, depth, begun = colon + 1, 0, False
        while i < len(tokens) and not (begun and depth == 0):
            depth += (tokens[i] in "{[") - (tokens[i] in "}]")
            begun |= not tokens[i].isspace()
            i += 1
    return "".join(out)


def test_redaction_equals_a_walk_over_random_json(spark):
    rng = random.Random(11)
    names = ["token", "password", "path", "a", "to\\u006ben", "x", "token "]

    def value(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.45:
            return rng.choice(['"s"', '"t\\"oken\\": 1"', "12", "-1.5e3", "true", "null", '"}]"', '"\\\\"', '""'])
        space = rng.choice(["", " ", "\n\t"])
        if kind < 0.75:
            return "{" + ",".join(f'{space}"{rng.choice(names)}"{space}:{space}{value(depth - 1)}' for _ in range(rng.randint(0, 3))) + space + "}"
        return "[" + ",".join(space + value(depth - 1) for _ in range(rng.randint(0, 3))) + "]"

    texts = [value(rng.randint(1, 14)) for _ in range(1500)]
    texts += ['{"token":' + "[" * k + "1" + "]" * k + ',"x":1}' for k in range(1, 30)]
    plan = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.redact(F.col("t")).alias("t"))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
    got = {r.i: r.t for r in plan.collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_redact(t, set(T.SENSITIVE_KEYS)), t


def test_normal_form_and_its_places_agree_with_the_expression(spark):
    rng = random.Random(2)
    letters = list("ab1 \t\n\r\f\v\x1c\x1f\x07\x85  ‏﻿­⁄٣۴–é") + ["é", "ﬁ", "½", "ẛ̣", "Å", "한", "한", "㎏", "𝟙", "　"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 25))) for _ in range(800)] + ["", "plain ascii  text\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r for r in df.select("i", T.normalize_text(F.col("t")).alias("text"), T.normal_form("t").alias("form")).collect()}
    for i, t in enumerate(texts):
        assert got[i].text == got[i].form.text, repr(t)
        assert len(got[i].form.places) == len(got[i].text) and all(0 <= p < len(t) for p in got[i].form.places) and got[i].form.places == sorted(got[i].form.places)
    assert spark.createDataFrame([(None,)], "t string").select(T.normal_form("t").alias("f")).first().f.text is None


@pytest.mark.parametrize("before", ["café", "cafe", "ﬁ½", "\x1c\x07‏", "한", ""])
def test_raw_value_behind_odd_letters(spark, before):
    df = spark.createDataFrame([("a", 1, "OCR", f"{before} Issued: ٢٠٢٠-01-02 end")], PAGE)
    found = dates.detect_dates(df, F.lit(TODAY), keep_raw=True).collect()
    assert [(r.raw_value, r.normalized_value, r.candidate_type) for r in found] == [("٢٠٢٠-01-02", "2020-01-02", "ISSUE_DATE")]
    assert [r.occurrence_index for r in found] == [r.occurrence_index for r in dates.detect_dates(df, F.lit(TODAY)).collect()]


def test_identity_records_by_type(spark):
    from quirelake.operators import identity_records

    papers = spark.createDataFrame([("card", "UNIFIED_NATIONAL_CARD"), ("bare", "UNIFIED_NATIONAL_CARD"), ("pass", "PASSPORT"), ("birth", "BIRTH_DOCUMENT"), ("none", "PASSPORT"), ("odd", None)], "record string, document_type string")
    lines = [
        ("card", "FRONT", 1, "الاسم: علي", 0.95), ("card", "FRONT", 2, "الجنس: انثى", None), ("card", "FRONT", 3, "12345678901S", 0.4), ("card", "FRONT", 4, "999999999999", 0.9),
        ("card", "ROI_DOB", 5, "1991.02.30 1991/2/3", 0.9), ("card", "ROI_DOB", 6, "1990-13-01", 0.9), ("card", "ROI_DATES", 7, "2031-01-02", 0.9), ("card", "BACK", 8, "9001017M3001012IRQ", 0.9), ("card", "ROI_MRZ", 9, "IDIRQA123456785<<<<<", 0.9),
        ("bare", "FRONT", 1, None, None), ("pass", "FRONT", 1, "Date of issue unknown", 0.9), ("pass", "FRONT", 2, "2020/31/12", 0.9), ("birth", "FRONT", 1, "text", 0.9), ("odd", "FRONT", 1, "text", 0.9), ("stray", "FRONT", 1, "text", 0.9),
    ]
    lines = spark.createDataFrame(lines, "record string, side string, line_no int, text string, confidence double")
    found = {r.record: r for r in identity_records.identity_records(papers, lines, F.lit(date(2024, 1, 1))).collect()}
    assert set(found) == {"card", "bare", "pass", "birth", "none", "odd"}
    card = {k: tuple(v) for k, v in found["card"].fields.items()}
    assert card["name"] == ("علي", 0.95, "FRONT_PRINTED", None)
    # the printed value stays for sex and birth, the machine's for the end of validity; the repaired number stops at its least confidence
    assert card["sex"] == ("FEMALE", 0.45, "FRONT_PRINTED", "MRZ_MISMATCH") and card["national_card_number"] == card["document_number"] == ("123456789015", 0.3, "FRONT_PRINTED", None)
    assert card["date_of_birth"] == ("1991-02-30", 0.45, "BACK_PRINTED", "MRZ_MISMATCH") and card["expiry_date"] == ("2030-01-01", 0.65, "MRZ", "MRZ_MISMATCH")
    assert card["unique_card_body_number"] == ("A12345678", 0.85, "MRZ", None) and card["issuing_country"] == ("IQ", 1.0, "DOCUMENT_TYPE", None)
    assert found["card"].warnings.count("SOURCE_MISMATCH") == 3 and "OCR_CHARACTER_NORMALIZED" in found["card"].warnings and found["card"].warnings[0] == "MRZ_PARTIAL"
    missing = ["FIELD_MISSING"] * 4 + ["BLOOD_GROUP_NOT_FOUND"] + ["FIELD_MISSING"] * 3 + ["FAMILY_NUMBER_NOT_FOUND"]
    assert found["bare"].warnings == ["MRZ_NOT_DETECTED", *missing] and list(found["bare"].fields) == ["issuing_country"]
    # a passport's date isn't checked against the calendar
    assert tuple(found["pass"].fields["issue_date"]) == ("2020-31-12", 0.6, "OCR", None) and found["pass"].warnings == ["MRZ_NOT_DETECTED"]
    assert found["birth"].warnings == found["odd"].warnings == ["UNSUPPORTED_LAYOUT"] and found["none"].warnings == ["NO_TEXT_DETECTED"] and found["none"].fields == {}
    assert identity_records.identity_records(papers.limit(0), lines, F.current_date()).count() == 0


def test_casefold_is_unicodes(spark):
    import sys

    from quirelake.functions.text import casefold

    letters = [c for c in map(chr, range(32, sys.maxunicode + 1)) if c.casefold() != c]
    texts = ["".join(letters), *letters[::7], "ΑΣ ΑΣΑ", "plain ASCII", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", casefold(F.col("t")).alias("f"))
    assert [(r.t, r.f) for r in df.collect() if r.f != (r.t.casefold() if r.t is not None else None)] == []
