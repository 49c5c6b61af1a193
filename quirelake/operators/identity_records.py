"""Whole identity records by document type: fields gathered from a card's sides and its machine-readable lines, reconciled by a table of rules."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ARABIC_DIGITS, ASCII_DIGITS, fold_ar
from ..sources import io
from . import identity

CARD, PASSPORT = "UNIFIED_NATIONAL_CARD", "PASSPORT"


class Rule(NamedTuple):
    """How a field's printed value and its machine-readable one make one value; a confidence of None is the source's own."""

    field: str
    source: str
    alone: float | None = None
    agree: float | None = None
    mismatch: float | None = None
    machine: float | None = None
    machine_low: float | None = None
    machine_wins: bool = False
    missing: str | None = None


#: Confidences, sources and warnings of the card's fields, in the order of its warnings.
CARD_RULES = (
    Rule("name", "FRONT_PRINTED", missing="FIELD_MISSING"),
    Rule("father_name", "FRONT_PRINTED", missing="FIELD_MISSING"),
    Rule("grandfather_name", "FRONT_PRINTED", missing="FIELD_MISSING"),
    Rule("sex", "FRONT_PRINTED", agree=0.96, mismatch=0.45, machine=0.9, missing="FIELD_MISSING"),
    Rule("blood_group", "ROI", alone=0.82, missing="BLOOD_GROUP_NOT_FOUND"),
    Rule("national_card_number", "FRONT_PRINTED", missing="FIELD_MISSING"),
    Rule("document_number", "FRONT_PRINTED"),
    Rule("unique_card_body_number", "FRONT_PRINTED", alone=0.9, agree=0.95, mismatch=0.7, machine=0.85, missing="FIELD_MISSING"),
    Rule("date_of_birth", "BACK_PRINTED", alone=0.85, agree=0.94, mismatch=0.45, machine=0.8, machine_low=0.55, missing="FIELD_MISSING"),
    Rule("issue_date", "BACK_PRINTED", alone=0.7),
    Rule("expiry_date", "BACK_PRINTED", alone=0.7, agree=0.94, mismatch=0.65, machine=0.85, machine_wins=True),
    Rule("family_number", "BACK_PRINTED", alone=0.85, missing="FAMILY_NUMBER_NOT_FOUND"),
    Rule("issuing_country", "DOCUMENT_TYPE"),
)
#: The same for passports, whose fields come from the machine-readable lines, but for the issue date.
PASSPORT_RULES = (
    Rule("document_number", "MRZ", machine=0.99, machine_low=0.6),
    Rule("issuing_country", "MRZ", machine=0.98),
    Rule("expiry_date", "MRZ", machine=0.99, machine_low=0.6),
    Rule("date_of_birth", "MRZ", machine=0.98, machine_low=0.6),
    Rule("sex", "MRZ", machine=0.98),
    Rule("full_name", "MRZ", machine=0.9, machine_low=0.6),
    Rule("issue_date", "OCR", missing="FIELD_NOT_FOUND"),
)
#: What a repaired number loses, and where it stops.
REPAIRED, REPAIRED_LEAST = 0.15, 0.3
FAMILY_LABELS = ("الرقم العائلي", "الرقم العائلى", "العائلي", "العائلى", "خيرائى", "خاني")
ISSUE_LABELS = ("issue date", "date of issue", "issued on", "date issued")
PRINTED_DATE = r"(?U)\b(?:19|20)\d{2}[-/.]\d{1,2}[-/.]\d{1,2}\b"
PRINTED, MACHINE = "struct<value: string, confidence: double>", "struct<value: string, low: boolean>"


def reconcile(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Columns `fields`, a map of field to value, confidence, source and cross_check, and `field_warnings`, in the rules' order, for
    each row's columns `<field>` (value, confidence) and `<field>_machine` (value, low), as far as they are there.

    Two equal values agree; of two others the printed one stays unless the rule prefers the machine's, and the row warns. One source
    alone gives its own value. No source gives no entry, and the rule's warning.
    """
    cells, warnings = [], []
    none = F.lit(None)
    for rule in rules:
        here = lambda name, kind: F.col(name).cast(kind) if name in df.columns else none.cast(kind)
        printed, machine = here(rule.field, PRINTED), here(f"{rule.field}_machine", MACHINE)
        both = printed["value"].isNotNull() & machine["value"].isNotNull()
        agree = printed["value"] == machine["value"]
        by_machine = printed["value"].isNull() | F.lit(rule.machine_wins)
        value = F.when(by_machine, F.coalesce(machine["value"], printed["value"])).otherwise(printed["value"])
        alone = printed["confidence"] if rule.alone is None else F.lit(rule.alone)
        low = F.lit(rule.machine if rule.machine_low is None else rule.machine_low)
        single = F.when(printed["value"].isNotNull(), alone).otherwise(F.when(machine["low"], low).otherwise(F.lit(rule.machine)))
        confidence = F.when(both, F.when(agree, F.lit(rule.agree)).otherwise(F.lit(rule.mismatch))).otherwise(single).cast("double")
        source = F.when(value.isNotNull() & by_machine & machine["value"].isNotNull(), "MRZ").otherwise(rule.source)
        check = F.when(both, F.when(agree, "MRZ_AGREE").otherwise("MRZ_MISMATCH"))
        cells.append(F.struct(F.lit(rule.field).alias("key"), F.struct(value.alias("value"), F.round(confidence, 3).alias("confidence"), source.alias("source"), check.alias("cross_check")).alias("cell")))
        warnings.append(F.when(both & ~agree, "SOURCE_MISMATCH").when(value.isNull(), F.lit(rule.missing).cast("string")))
        if f"{rule.field}_warning" in df.columns:
            warnings.append(F.col(f"{rule.field}_warning"))
    fields = F.map_from_entries(F.filter(F.array(*cells), lambda x: x["cell"]["value"].isNotNull()))
    return df.withColumn("fields", fields).withColumn("field_warnings", F.array_compact(F.array(*warnings)))


def _printed_day(text: Column) -> Column:
    """The first date of a line as year-month-day text, null without one or with an impossible month or day."""
    found = F.split(F.translate(F.regexp_extract(text, PRINTED_DATE, 0), ARABIC_DIGITS, ASCII_DIGITS), "[-/.]")
    part = lambda i: F.get(found, F.lit(i)).try_cast("int")
    return F.when(part(1).between(1, 12) & part(2).between(1, 31), F.format_string("%04d-%02d-%02d", part(0), part(1), part(2)))


def _held(confidence: Column, default: float = identity.NAME_CONFIDENCE) -> Column:
    return F.when(F.coalesce(confidence, F.lit(0.0)) <= 0, default).otherwise(F.round(F.least(confidence, F.lit(1.0)), 3))


def card_candidates(lines: DataFrame, today: Column) -> DataFrame:
    """record, side, line_no, text, confidence of cards to one row a record with what each side and the machine-readable lines say.

    Sides are FRONT, BACK and cut-outs (ROI_MRZ, ROI_DOB, ROI_DATES, ROI_FAMILY, ROI_BLOOD); the first line that holds a field gives
    it. Machine-readable lines are looked for in their cut-out first and then on the back. A number's last letter that is a misread
    digit is repaired at a cost; a family number is the longest run in its cut-out, or else behind its label on the back.
    """
    lines = lines.withColumn("text", F.coalesce("text", F.lit("")))
    text, upper, side = F.col("text"), F.upper("text"), F.col("side")
    front, on = side == "FRONT", lambda name: side == name
    number = F.get(F.filter(F.regexp_extract_all(upper, F.lit(r"(?U)\b([0-9]{10,13}[A-Z0-9]?)\b"), F.lit(1)), lambda v: F.translate(v, "OISB", "0158").rlike("^[0-9]+$")), F.lit(0))
    fixed = F.translate(number, "OISB", "0158")
    body = F.nullif(F.regexp_extract(upper, r"(?U)\b[A-Z]\d{8}\b", 0), F.lit(""))
    words = identity._name_words(text)
    sexed = F.when(fold_ar(text).rlike("|".join(identity.SEX_LABELS)), identity._name_value(words, identity.SEX_LABELS, ()))
    sex = F.when(sexed.contains("ذكر"), "MALE").when(sexed.rlike("انثى|انثئ"), "FEMALE")
    blood_text = F.regexp_extract(F.replace(text, F.lit("0"), F.lit("O")), r"(?U)\b[ABO]{1,2}\s*[+-]", 0)
    blood = F.regexp_replace(blood_text, r"(?U)\s", "")
    runs = F.array_max(F.transform(F.regexp_extract_all(upper, F.lit("([A-Z0-9]{10,})"), F.lit(1)), lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))))
    day = _printed_day(text)
    rows = lines.select(
        "record", "line_no", _held(F.col("confidence")).alias("held"), _held(F.col("confidence"), 0.9).alias("held_sex"),
        F.when(front, number).alias("raw_number"), F.when(front, fixed).alias("number"), F.when(front, body).alias("body"),
        F.when(front & (sexed != ""), F.coalesce(sex, F.lit(""))).alias("sex"), F.when(on("ROI_BLOOD") & blood.isin(*identity.BLOOD_GROUPS), blood).alias("blood"),
        F.when(on("ROI_FAMILY"), runs).alias("family"), F.when(on("BACK") & fold_ar(text).rlike("|".join(FAMILY_LABELS)), runs).alias("family_back"),
        F.when(on("ROI_DOB"), day).alias("born"), F.when(on("ROI_DATES"), day).alias("day"),
    )
    now = F.date_format(today, "yyyy-MM-dd")
    first = lambda c, *more: F.min_by(F.struct(F.col(c).alias("v"), *more), F.when(F.col(c).isNotNull(), F.col("line_no")))
    printed = rows.groupBy("record").agg(
        first("number", F.col("raw_number").alias("raw"), F.col("held").alias("c")).alias("n"), first("body")["v"].alias("b"), first("sex", F.col("held_sex").alias("c")).alias("s"), first("blood")["v"].alias("g"),
        F.coalesce(F.max("family"), F.max("family_back"))["v"].alias("f"), F.min(F.when(F.col("born") <= now, F.col("born"))).alias("o"),
        F.max(F.when(F.col("day") <= now, F.col("day"))).alias("i"), F.min(F.when(F.col("day") > now, F.col("day"))).alias("e"),
    )
    repaired = F.col("n.v") != F.col("n.raw")
    number_confidence = F.when(repaired, F.greatest(F.col("n.c") - REPAIRED, F.lit(REPAIRED_LEAST))).otherwise(F.col("n.c"))
    none = F.lit(None).cast("double")
    one = lambda value, confidence=none: F.when(value.isNotNull(), F.struct(value, confidence).cast(PRINTED))
    printed = printed.select(
        "record", one(F.nullif(F.col("s.v"), F.lit("")), F.col("s.c")).alias("sex"), one(F.col("g")).alias("blood_group"), one(F.col("n.v"), number_confidence).alias("national_card_number"),
        one(F.col("n.v"), number_confidence).alias("document_number"), F.when(repaired, "OCR_CHARACTER_NORMALIZED").alias("national_card_number_warning"), one(F.col("b")).alias("unique_card_body_number"),
        one(F.col("o")).alias("date_of_birth"), one(F.col("i")).alias("issue_date"), one(F.col("e")).alias("expiry_date"), one(F.col("f")).alias("family_number"),
        F.struct(F.lit("IQ"), F.lit(1.0)).cast(PRINTED).alias("issuing_country"),
    )
    names = identity.name_chain(lines.where(front & (text != "")).select("record", "line_no", "text", "confidence"))
    names = names.select("record", *[one(F.col(c), F.col(f"{c}_confidence")).alias(c) for c in ("name", "father_name", "grandfather_name")])
    coded = lines.where(side.isin("ROI_MRZ", "BACK")).select("record", F.struct((side != "ROI_MRZ").alias("later"), "line_no").alias("line_no"), "text")
    low = lambda f: F.array_contains("low_confidence_fields", f)
    machine = lambda value, name: F.when(value.isNotNull(), F.struct(value.cast("string"), low(name)).cast(MACHINE))
    number = F.when(F.col("document_number").rlike(r"^[A-Z][0-9]{8}$"), F.col("document_number"))
    coded = identity.national_card(coded).select(
        "record", F.lit(True).alias("detected"), "checks_passed", (F.col("checks_passed") & F.col("document_number").isNotNull() & F.col("sex").isNotNull()).alias("valid"), "partial",
        machine(F.when(F.col("sex") == "M", "MALE").when(F.col("sex") == "F", "FEMALE"), "sex").alias("sex_machine"), machine(number, "document_number").alias("unique_card_body_number_machine"),
        machine(F.col("date_of_birth"), "date_of_birth").alias("date_of_birth_machine"), machine(F.col("expiry_date"), "expiry_date").alias("expiry_date_machine"),
    )
    whole = printed.join(names.hint("merge"), "record", "left").join(coded.hint("merge"), "record", "left")
    state = F.when(F.col("detected").isNull(), "MRZ_NOT_DETECTED").when(~F.col("checks_passed") | F.col("partial"), "MRZ_PARTIAL")
    return whole.withColumn("first_warning", state)


def passport_candidates(lines: DataFrame) -> DataFrame:
    """record, line_no, text of passports to one row a record: the fields of its machine-readable lines, and the issue date by its label, else any date."""
    lines = lines.withColumn("text", F.coalesce("text", F.lit("")))
    found = F.split(F.translate(F.regexp_extract("text", PRINTED_DATE, 0), ARABIC_DIGITS, ASCII_DIGITS), "[-/.]")
    part = lambda i: F.get(found, F.lit(i)).cast("int")
    day = F.when(F.size(found) == 3, F.format_string("%04d-%02d-%02d", *map(part, range(3))))
    labelled = F.lower("text").rlike("|".join(ISSUE_LABELS))
    rows = lines.select("record", "line_no", day.alias("day"), labelled.alias("labelled"))
    choice = F.min(F.when(F.col("day").isNotNull(), F.struct(~F.col("labelled"), "line_no", "day")))
    printed = rows.groupBy("record").agg(choice.alias("x")).select("record", F.when(F.col("x").isNotNull(), F.struct(F.col("x.day"), F.when(F.col("x.col1"), 0.6).otherwise(0.85)).cast(PRINTED)).alias("issue_date"))
    coded = identity.parse_records(lines.where(F.col("text").rlike("^[A-Z0-9<]{30,44}$")).select("record", "line_no", "text"))
    fields = {"document_number": "document_number", "issuing_country": "issuing_country", "expiry_date": "expiry_date", "date_of_birth": "date_of_birth", "sex": "sex", "full_name": "name"}
    low = lambda f: ~F.col("checks_passed") if f == "full_name" else F.array_contains("low_confidence_fields", f)
    machine = [F.when(F.col(c).isNotNull(), F.struct(F.col(c).cast("string"), low(f)).cast(MACHINE)).alias(f"{f}_machine") for f, c in fields.items()]
    coded = coded.where("low_confidence_fields IS NOT NULL").select("record", F.lit(True).alias("detected"), "checks_passed", F.col("checks_passed").alias("valid"), (F.size("low_confidence_fields") > 0).alias("any_low"), *machine)
    state = F.when(F.col("detected").isNull(), "MRZ_NOT_DETECTED").when(F.col("any_low"), "MRZ_CHECK_FAILED")
    return printed.join(coded.hint("merge"), "record", "left").withColumn("first_warning", state)


def identity_records(papers: DataFrame, lines: DataFrame, today: Column) -> DataFrame:
    """record, document_type and their lines (record, side, line_no, text, confidence) to one row a record: document_type, fields,
    warnings in the order of the rules, and whether machine-readable lines were detected, valid and passed their checks.

    `fields` maps a field to its value, confidence, source and cross_check. A record without lines warns of that, whatever its type;
    other document types have no layout and warn of that. Papers that repeat a record count once, of the smallest document type; lines of
    records without papers don't count. A record's lines are one group, as a card's or a page's. The typed lines are written to the shared folder first.
    """
    papers = papers.groupBy("record").agg(F.min("document_type").alias("document_type"))
    typed = io.written(lines.join(papers.hint("merge"), "record"), "identity-lines")  # read once for each part below
    some = typed.groupBy("record").agg(F.lit(True).alias("has_lines"))
    parts = ((CARD, card_candidates(typed.where(F.col("document_type") == CARD), today), CARD_RULES), (PASSPORT, passport_candidates(typed.where(F.col("document_type") == PASSPORT)), PASSPORT_RULES))
    done = None
    for kind, candidates, rules in parts:
        ready = reconcile(candidates, rules).select("record", "fields", F.concat(F.array_compact(F.array("first_warning")), F.col("field_warnings")).alias("warnings"), "detected", "valid", "checks_passed")
        done = ready if done is None else done.unionByName(ready)
    empty = F.array().cast("array<string>")
    fallback = F.when(F.col("has_lines").isNull(), F.array(F.lit("NO_TEXT_DETECTED"))).when(~F.coalesce(F.col("document_type").isin(CARD, PASSPORT), F.lit(False)), F.array(F.lit("UNSUPPORTED_LAYOUT"))).otherwise(empty)
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("detected", "valid", "checks_passed")]
    whole = papers.join(some.hint("merge"), "record", "left").join(done.hint("merge"), "record", "left")
    no_fields = F.map_from_arrays(empty, F.array().cast("array<struct<value:string,confidence:double,source:string,cross_check:string>>"))
    return whole.select("record", "document_type", F.coalesce("fields", no_fields).alias("fields"), F.coalesce("warnings", fallback).alias("warnings"), *flags)
