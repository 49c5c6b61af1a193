"""Identity records from text lines: check digits, fixed-width records, dates, numbers, reconciliation of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ARABIC_DIGITS, ASCII_DIGITS, fold_ar, repair_digits
from ..sources.io import by_keys

#: The alphabet whose places are the characters' values here, and the published one (digits first).
ALPHABET, ICAO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789<", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WEIGHTS = (7, 3, 1)
BLOOD_GROUPS = ("A+", "A-", "B+", "B-", "AB+", "AB-", "O+", "O-")
#: Labels of the front's name lines, folded, in order of priority: whole words, and those that may be glued to a value.
NAME_LABELS = {
    "mother": (("الام", "ادايك", "ردايك", "داتك", "مادر"), ("ردايك", "ادايك", "داتك", "مادر")),
    "surname": (("اللقب", "لقب", "انازناو", "نازناو"), ("انازناو", "نازناو")),
    "grandfather": (("ابابير", "ابير", "الحد", "الجد", "باپير", "اباير"), ("ابابير", "ابير", "الحد", "الجد", "باپير", "اباير")),
    "father": (("الاب", "اباوك", "باوك", "بابك", "بابه", "ابت", "باو"), ("اباوك", "باوك", "بابك", "بابه", "ابت", "باو")),
    "name": (("الاسم", "اسم", "اناو", "ناو"), ("الاسم", "اناو")),
}
SEX_LABELS = ("الجنس", "اركمز", "اركز", "ارهگهز")
CONNECTORS = ("انازناو", "اركمز", "اناو", "اركز", "اتو", "ناو")
#: The confidence of a name that comes without one.
NAME_CONFIDENCE = 0.7

def check_digit(text: Column, icao: bool = False) -> Column:
    """The weighted sum of the characters' values modulo 10; characters outside the alphabet count nothing."""
    alphabet = ICAO if icao else ALPHABET
    chars = F.filter(F.split(text, "", -1), lambda c: c != "")
    weight = lambda i: F.get(F.array(*map(F.lit, WEIGHTS)), i % 3)
    values = F.transform(chars, lambda c, i: F.greatest(F.instr(F.lit(alphabet), c) - 1, F.lit(0)) * weight(i))
    return F.aggregate(values, F.lit(0), lambda acc, v: acc + v) % 10


def _at(line: str, start: int, end: int) -> Column:
    return F.substring(F.col(line), start + 1, end - start)


def _field(line: str, start: int, end: int) -> Column:
    text = F.replace(_at(line, start, end), F.lit("<"), F.lit(""))
    return F.when(text != "", text)


def short_date(text: Column) -> Column:
    """A date of six digits, the year before 70 in this century; null if it is none."""
    year = F.substring(text, 1, 2)
    full = F.concat(F.when(year.try_cast("int") < 70, "20").otherwise("19"), text)
    return F.when(text.rlike("^[0-9]{6}$"), F.try_to_date(full, "yyyyMMdd"))


def _check(line: str, start: int, end: int, present: Column, icao: bool) -> Column:
    """Null if there is nothing to check, else whether the digit after the field is right."""
    return F.when(present & (_at(line, end, end + 1) != "<"), check_digit(_at(line, start, end), icao).cast("string") == _at(line, end, end + 1))


def _record(df: DataFrame, fields: dict[str, Column], checks: dict[str, Column], need_checks: bool) -> DataFrame:
    df = df.select("record", *[c.alias(k) for k, c in fields.items()], *[c.alias(f"_{k}") for k, c in checks.items()])
    failed = F.filter(F.array(*[F.when(~F.col(f"_{k}"), F.lit(k)) for k in checks]), lambda x: x.isNotNull())
    done = F.array_compact(F.array(*[F.col(f"_{k}") for k in checks]))
    passed = (F.size(failed) == 0) & ((F.size(done) > 0) if need_checks else F.lit(True))
    warnings = F.concat(F.transform(failed, lambda x: F.lit("MRZ_CHECK_FAILED")), F.when(F.col("document_number").isNull(), F.array(F.lit("FIELD_NOT_FOUND"))).otherwise(F.array().cast("array<string>")))
    return df.select("record", *fields, passed.alias("checks_passed"), failed.alias("low_confidence_fields"), warnings.alias("warnings"))


def two_line_record(df: DataFrame, icao: bool = False) -> DataFrame:
    """record, line1, line2 of 44 characters to fields, checks and warnings."""
    born, expiry = short_date(_at("line1", 19, 25)), short_date(_at("line1", 29, 35))
    name = F.concat_ws(" ", _field("line2", 0, 39), _field("line2", 39, 44))
    sex = _at("line1", 26, 27)
    fields = {
        "document_type": _field("line1", 0, 2), "issuing_country": _field("line1", 2, 5), "document_number": _field("line1", 5, 14), "nationality": _field("line1", 15, 18),
        "date_of_birth": born, "sex": F.when(sex.isin("M", "F"), sex), "expiry_date": expiry, "name": F.when(name != "", name),
    }
    checks = {
        "document_number": _check("line1", 5, 14, _field("line1", 5, 14).isNotNull(), icao), "date_of_birth": _check("line1", 19, 25, born.isNotNull(), icao),
        "expiry_date": _check("line1", 29, 35, expiry.isNotNull(), icao),
    }
    return _record(df.where((F.length("line1") == 44) & (F.length("line2") == 44)), fields, checks, True)


def three_line_record(df: DataFrame, icao: bool = False) -> DataFrame:
    """record, line1, line2, line3 of 30 characters to fields, checks and warnings."""
    born, expiry, sex = short_date(_at("line3", 0, 6)), short_date(_at("line2", 21, 27)), _at("line3", 7, 8)
    fields = {
        "document_type": _field("line1", 0, 2), "issuing_country": _field("line1", 2, 5), "document_number": _field("line1", 5, 14), "nationality": _field("line2", 28, 30),
        "date_of_birth": born, "sex": F.when(sex.isin("M", "F"), sex), "expiry_date": expiry, "name": _field("line2", 0, 30),
    }
    checks = {
        "document_number": _check("line1", 5, 14, _field("line1", 5, 14).isNotNull(), icao), "date_of_birth": _check("line3", 0, 6, born.isNotNull(), icao),
        "expiry_date": _check("line2", 21, 27, expiry.isNotNull(), icao),
    }
    return _record(df.where((F.length("line1") == 30) & (F.length("line2") == 30) & (F.length("line3") == 30)), fields, checks, False)


def layout(lines: DataFrame) -> DataFrame:
    """record, line_no, text to one row a record with line1 to line3 and its layout: TD3, TD1 or NOT_DETECTED."""
    per = lines.where(F.coalesce("text", F.lit("")) != "").groupBy("record").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]).alias("lines"))
    every = lambda n: F.forall("lines", lambda t: F.length(t) == n)
    kind = F.when((F.size("lines") == 2) & every(44), "TD3").when((F.size("lines") == 3) & every(30), "TD1").otherwise("NOT_DETECTED")
    return per.select("record", kind.alias("layout"), *[F.get("lines", F.lit(i)).alias(f"line{i + 1}") for i in range(3)])


def parse_records(lines: DataFrame, icao: bool = False) -> DataFrame:
    """Records of either layout; others come with a warning and nothing else."""
    laid = layout(lines)
    both = two_line_record(laid.where("layout = 'TD3'"), icao).unionByName(three_line_record(laid.where("layout = 'TD1'"), icao))
    rest = laid.where("layout = 'NOT_DETECTED'").select("record", F.lit(False).alias("checks_passed"), F.array(F.lit("MRZ_NOT_DETECTED")).alias("warnings"))
    return both.unionByName(rest, allowMissingColumns=True)


def national_card(lines: DataFrame) -> DataFrame:
    """record, line_no, text to card records: lines are known by their content, the name line may be missing."""
    clean = lines.select("record", "line_no", F.regexp_replace(F.translate("text", ARABIC_DIGITS, ASCII_DIGITS), "[^A-Z0-9<]", "").alias("t")).where("t <> ''")
    kind = F.when((F.length("t") >= 14) & F.col("t").startswith("ID"), "1").when((F.length("t") >= 18) & F.col("t").rlike("^[0-9]{7}[MF]"), "2").otherwise("3")
    # a second line of a kind, like any other line, may serve as the name line
    nth = F.row_number().over(Window.partitionBy("record", "k").orderBy("line_no"))
    ranked = clean.withColumn("k", kind).withColumn("n", nth).withColumn("role", F.when((F.col("n") > 1) & (F.col("k") != "3"), "3").otherwise(F.col("k")))
    first = lambda r: F.min_by(F.when(F.col("role") == r, F.substring("t", 1, 30) if r != "3" else F.col("t")), F.when(F.col("role") == r, F.col("line_no")))
    per = ranked.groupBy("record").agg(*[first(r).alias(f"line{r}") for r in "123"]).where("line1 IS NOT NULL OR line2 IS NOT NULL")
    born, expiry, sex = short_date(_at("line2", 0, 6)), short_date(_at("line2", 8, 14)), _at("line2", 7, 8)
    fields = {
        "issuing_country": _field("line1", 2, 5), "document_number": _field("line1", 5, 14), "date_of_birth": born, "sex": F.when(sex.isin("M", "F"), sex),
        "expiry_date": expiry, "nationality": _field("line2", 15, 18), "name": F.when(F.replace("line3", F.lit("<"), F.lit("")) != "", F.replace("line3", F.lit("<"), F.lit(""))),
        "partial": F.col("line3").isNull(),
    }
    more = lambda line, n: F.length(line) > n
    checks = {
        "document_number": F.when(more("line1", 14), _check("line1", 5, 14, _field("line1", 5, 14).isNotNull(), False)), "date_of_birth": F.when(more("line2", 6), _check("line2", 0, 6, born.isNotNull(), False)),
        "expiry_date": F.when(more("line2", 14), _check("line2", 8, 14, expiry.isNotNull(), False)),
    }
    return _record(per, fields, checks, True)


def field_confidences(records: DataFrame, fields: tuple[str, ...] = ("document_number", "date_of_birth", "expiry_date", "sex", "nationality", "name")) -> DataFrame:
    """A row for each found field: record, field, value, confidence (0.99 numbers and expiry, 0.98 other fields, 0.9 names; 0.6 if the field's check failed)."""
    usual = {"document_number": 0.99, "expiry_date": 0.99, "name": 0.9}
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), F.lit(usual.get(f, 0.98)).alias("usual")) for f in fields])
    rows = records.select("record", "low_confidence_fields", F.explode(cells).alias("x")).where("x.value IS NOT NULL")
    return rows.select("record", "x.field", "x.value", F.when(F.array_contains("low_confidence_fields", F.col("x.field")), 0.6).otherwise(F.col("x.usual")).alias("confidence"))


def printed_dates(dates: DataFrame, today: Column) -> DataFrame:
    """record, day to birth (the oldest past one), issue (the newest past one, if another) and expiry (the nearest to come)."""
    past = F.when(F.col("day") <= today, F.col("day"))
    per = dates.groupBy("record").agg(F.min(past).alias("birth_date"), F.max(past).alias("issue_date"), F.min(F.when(F.col("day") > today, F.col("day"))).alias("expiry_date"))
    return per.withColumn("issue_date", F.when(F.col("issue_date") != F.col("birth_date"), F.col("issue_date")))


def issue_dates(dates: DataFrame) -> DataFrame:
    """record, line_no, day, labelled to the issue date: a labelled one (0.85), else any (0.6)."""
    nth = F.row_number().over(Window.partitionBy("record").orderBy(F.desc("labelled"), "line_no"))
    return dates.withColumn("_nth", nth).where("_nth = 1").select("record", F.col("day").alias("issue_date"), F.when(F.col("labelled"), 0.85).otherwise(0.6).alias("confidence"))


def _name_words(text: Column) -> Column:
    """A line folded, its separators and white space as single spaces, with one space at each end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.regexp_replace(fold_ar(text), "[:|/؛;—]", " "), r"\s+", " ")), F.lit(" "))


def _name_label(words: Column) -> Column:
    """The first label in order of priority that is a word of the line, or that a longer word begins with."""
    kind = F
    for label, (whole, glued) in NAME_LABELS.items():
        kind = kind.when(words.rlike(f" (?:{'|'.join(whole)}) | (?:{'|'.join(glued)})[^ ]"), label)
    return kind.otherwise(F.lit(None))


def _name_value(words: Column, whole: tuple[str, ...], glued: tuple[str, ...]) -> Column:
    """The line without its leading labels and connectors, and without a label or connector glued to the first word that is left."""
    rest = F.regexp_replace(words, f"^ (?:(?:{'|'.join((*whole, *CONNECTORS))}) )*", "")
    return F.trim(F.regexp_replace(rest, f"^(?:{'|'.join((*glued, *CONNECTORS))})(?=[^ ])", ""))


def name_chain(lines: DataFrame) -> DataFrame:
    """record, line_no, text and, if there is one, confidence of a card's front lines to name, father_name and grandfather_name,
    each with a confidence.

    A label stands as a word or is glued to its value; a value is on the label's line or on the next one that is neither a
    surname's nor the sex's. The first value of each kind counts. From the first line on that holds a mother's label anywhere,
    nothing belongs to the father's side. Lines without text don't count; a confidence that is null or not above 0 is 0.7,
    others are held to 0 to 1; a record without any name gets no row.
    """
    order = Window.partitionBy("record").orderBy("line_no")
    confidence = F.col("confidence") if "confidence" in lines.columns else F.lit(None).cast("double")
    df = lines.where("text IS NOT NULL").select("record", "line_no", _name_words(F.col("text")).alias("words"), confidence.alias("confidence"), fold_ar(F.col("text")).alias("folded"))
    mother = F.col("folded").rlike("|".join(NAME_LABELS["mother"][0])).cast("int")
    df = df.withColumn("mothers", F.max(mother).over(order)).withColumn("label", _name_label(F.col("words")))
    by_label = F
    for label in ("name", "father", "grandfather"):
        by_label = by_label.when(F.col("label") == label, _name_value(F.col("words"), *NAME_LABELS[label]))
    # lines that open or close a section; those of surnames and of the sex let a label wait on
    kept = F.col("label").isin("name", "father", "grandfather") | (F.col("label").isNull() & ~F.col("folded").rlike("|".join(SEX_LABELS)))
    events = df.where((F.col("mothers") == 0) & kept).withColumn("value", by_label.otherwise(_name_value(F.col("words"), (), ())))
    waiting = F.when(F.lag("value").over(order) == "", F.lag("label").over(order))
    found = events.withColumn("section", F.coalesce("label", waiting)).where("section IS NOT NULL AND value <> ''")
    held = F.when(F.coalesce("confidence", F.lit(0.0)) <= 0, NAME_CONFIDENCE).otherwise(F.round(F.least("confidence", F.lit(1.0)), 3))
    pick = lambda s, c: F.min_by(F.when(F.col("section") == s, c), F.when(F.col("section") == s, F.col("line_no")))
    names = {"name": "name", "father": "father_name", "grandfather": "grandfather_name"}
    return found.groupBy("record").agg(*[pick(s, F.col("value")).alias(c) for s, c in names.items()], *[pick(s, held).alias(f"{c}_confidence") for s, c in names.items()])


def number_fields(lines: DataFrame) -> DataFrame:
    """record, line_no, text to card number (digits, misread letters repaired), body number, family number (the longest), blood group and sex."""
    # a record's lines meet before anything is sorted for it, in tasks of a bounded size
    lines = by_keys(lines, ["record"])
    upper = F.upper("text")
    cards = F.filter(F.transform(F.regexp_extract_all(upper, F.lit(r"\b([0-9OISB]{10,13}[A-Z0-9]?)\b"), F.lit(1)), repair_digits), lambda v: v.rlike("^[0-9]+$"))
    family = F.array_max(F.transform(F.regexp_extract_all(upper, F.lit(r"([A-Z0-9]{10,})"), F.lit(1)), lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))))
    blood = F.regexp_extract(F.replace(upper, F.lit("0"), F.lit("O")), r"\b([ABO]{1,2})\s*([+-])", 0)
    blood = F.regexp_replace(blood, r"\s", "")
    rows = lines.select(
        "record", "line_no", F.get(cards, F.lit(0)).alias("card"), F.nullif(F.regexp_extract(upper, r"\b[A-Z]\d{8}\b", 0), F.lit("")).alias("body"), family.alias("family"),
        F.when(blood.isin(*BLOOD_GROUPS), blood).alias("blood"), F.when(upper.rlike(r"\bFEMALE\b|انثى|أنثى"), "F").when(upper.rlike(r"\bMALE\b|ذكر"), "M").alias("sex"),
    )
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    return rows.groupBy("record").agg(first("card").alias("card_number"), first("body").alias("body_number"), F.max("family")["v"].alias("family_number"), first("blood").alias("blood_group"), first("sex").alias("sex"))
