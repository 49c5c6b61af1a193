"""Date extraction from page texts: scan, validate, classify by labels, score, suggest.

One row per page in, one row per date occurrence out. Scanning and classifying are column
expressions on the page's text; pages without digits drop out before anything else is computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal_form, normalize_text

#: Month names and their numbers.
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5, "june": 6,
    "jun": 6, "july": 7, "jul": 7, "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9, "october": 10, "oct": 10,
    "november": 11, "nov": 11, "december": 12, "dec": 12,
}
#: Labels by type of date.
LABELS = {
    "REPORT_DATE": ("date of report", "report date", "تاريخ التقرير", "date", "التاريخ", "تاريخ"),
    "RESULT_DATE": ("result date", "تاريخ النتيجة"),
    "ISSUE_DATE": ("issued date", "issue date", "issued", "تاريخ الإصدار", "تاريخ الاصدار"),
    "COLLECTION_DATE": ("collection date", "collected", "تاريخ الجمع"),
    "SAMPLE_DATE": ("sample date", "تاريخ العينة"),
    "EXAMINATION_DATE": ("examination date", "exam date", "تاريخ الفحص"),
    "ADMISSION_DATE": ("admission date", "تاريخ الدخول"),
    "DISCHARGE_DATE": ("discharge date", "تاريخ الخروج"),
    "APPLICATION_DATE": ("date of application", "application date", "تاريخ التقديم"),
    "PRINT_DATE": ("print date", "printed", "تاريخ الطباعة"),
    "DATE_OF_BIRTH": ("date of birth", "birth date", "birthday", "dob", "تاريخ الميلاد"),
}
GENERIC = ("date", "تاريخ", "التاريخ")
#: Scores by type, bonuses and penalties, distances.
BASE_SCORES = {
    "REPORT_DATE": 0.90, "RESULT_DATE": 0.87, "ISSUE_DATE": 0.84, "EXAMINATION_DATE": 0.82, "COLLECTION_DATE": 0.70, "SAMPLE_DATE": 0.68,
    "DISCHARGE_DATE": 0.65, "ADMISSION_DATE": 0.60, "APPLICATION_DATE": 0.50, "PRINT_DATE": 0.30, "DATE_OF_BIRTH": 0.05, "UNKNOWN": 0.20,
}
PROXIMITY, CLOSE = 64, 16
SAME_LINE, CLOSE_LABEL, ADJACENT_LINE = 0.04, 0.04, 0.03
GENERIC_PENALTY, AMBIGUOUS_PENALTY, FUTURE_PENALTY, COMPACT_PENALTY = 0.15, 0.15, 0.55, 0.10
MIN_SCORE, TIE_TOLERANCE, FUTURE_DAYS, CONTEXT = 0.75, 0.01, 14, 160
#: Words that mark a line's digits as an identifier.
IDENTIFIER_HINTS = ("number", "barcode", "serial", "رقم", "patient number", "national", "code", "identifier")

_MONTH = "|".join(sorted(MONTHS, key=len, reverse=True))
_SEP = r"[\t ]*[-/.][\t ]*"
#: rule, pattern, and the groups of year, month and day.
RULES = (
    ("YMD_NUMERIC", rf"(?U)(?<!\d)(\d{{4}}){_SEP}(\d{{1,2}}){_SEP}(\d{{1,2}})(?!\d)", (1, 2, 3)),
    ("DMY_NUMERIC", rf"(?U)(?<!\d)(\d{{1,2}}){_SEP}(\d{{1,2}}){_SEP}(\d{{4}})(?!\d)", (3, 2, 1)),
    ("DMY_NAMED_MONTH", rf"(?iU)(?<!\w)(\d{{1,2}})\s+({_MONTH})\.?\s+(\d{{4}})(?!\d)", (3, 2, 1)),
    ("MDY_NAMED_MONTH", rf"(?iU)(?<!\w)({_MONTH})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})(?!\d)", (3, 1, 2)),
)
COMPACT = r"(?U)(?<!\d)\d{8}(?!\d)"


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


#: A character that no normal form has marks the ends of matches.
_MARK, _OTHER = "\x01", "\x02"


def _marked(text: Column, pattern: str, group: int, f) -> Column:
    """f of the text's pieces: what is between the matches and the given group of each match in turn. The pattern is compiled once and looked for once in
    a text: split compiles patterns of more than a character for every text, and a lambda function computes for every element what it names."""
    marked = F.regexp_replace(F.translate(text, _MARK, _OTHER), pattern, f"{_MARK}${group}{_MARK}")
    return F.get(F.transform(F.array(F.split(marked, _MARK, -1)), f), F.lit(0))


def _size(pieces: Column) -> Column:
    return F.aggregate(pieces, F.lit(0), lambda acc, x: acc + F.length(x))


def found_at(text: Column, pattern: str) -> Column:
    """The pattern's matches as array<struct<start, m>>, start from 0: gaps and matches in turn make up the text."""
    matches = lambda x: F.filter(x, lambda _, i: i % 2 == 1)
    return _marked(text, pattern, 0, lambda x: F.transform(matches(x), lambda m, i: F.struct(_size(F.slice(x, F.lit(1), 2 * i + 1)).alias("start"), m.alias("m"))))


def valid_date(year: Column, month: Column, day: Column) -> Column:
    """The date, or null if there is none like it."""
    text = F.concat(F.lpad(year, 4, "0"), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))
    return F.when(year.cast("int") > 0, text.try_cast("date"))


def _once(f, **columns: Column) -> Column:
    """f of columns that are computed once: a lambda function over an array of one, as an expression is computed anew wherever it is named."""
    return F.get(F.transform(F.array(F.struct(*[c.alias(k) for k, c in columns.items()])), f), F.lit(0))


def _parsed(match: Column, rule: str, pattern: str, groups: tuple[int, int, int]) -> Column:
    """start, end, rule, value, day, other (the date with day and month exchanged, if that is possible and another)."""
    year, month, day = (F.regexp_extract(match["m"], pattern, g) for g in groups)
    if "NAMED" in rule:
        month = F.element_at(_map({k: str(v) for k, v in MONTHS.items()}), F.lower(month))

    def dated(x: Column) -> Column:
        other = F.lit(None).cast("date")
        if rule == "DMY_NUMERIC":
            d, m = x["day"].cast("int"), x["month"].cast("int")
            other = F.when((d <= 12) & (m <= 12) & (d != m), valid_date(x["year"], x["day"], x["month"]))
        return F.struct(
            match["start"].alias("start"), (match["start"] + F.length(match["m"])).alias("end"), F.lit(rule).alias("rule"), match["m"].alias("value"),
            valid_date(x["year"], x["month"], x["day"]).alias("day"), other.alias("other"),
        )

    return _once(dated, year=year, month=month, day=day)


def _overlaps(x: Column, taken: Column) -> Column:
    return F.exists(taken, lambda t: (x["start"] < t["end"]) & (x["end"] > t["start"]))


def _fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once: one row of a generator, which no later filter or projection is merged with."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def scan_dates(pages: DataFrame) -> DataFrame:
    """A row for each calendar date in the column `text`: start, end, rule, value, day, other; spans taken by an earlier rule don't count again."""
    found = "array<struct<start:int,end:int,rule:string,value:string,day:date,other:date>>"
    none = F.array().cast(found)
    gated = lambda pattern, matches: F.when(F.col("text").rlike(pattern), matches).otherwise(none).cast(found)
    by_rule = F.array(*[gated(pattern, _matches(rule, pattern, groups)) for rule, pattern, groups in RULES], gated(COMPACT, _compact_matches()))
    taken = F.aggregate(by_rule, none, lambda acc, new: F.concat(acc, F.filter(new, lambda x: x["day"].isNotNull() & ~_overlaps(x, acc))))
    return pages.where(F.col("text").rlike(r"(?U)\d{4}")).withColumn("_x", F.explode(taken)).select(*pages.columns, "_x.*")


def _matches(rule: str, pattern: str, groups: tuple[int, int, int]) -> Column:
    return F.transform(found_at(F.col("text"), pattern), lambda m: _parsed(m, rule, pattern, groups))


def _compact_matches() -> Column:
    """Runs of eight digits that are a date in 1900 to 2100, read as year-month-day, or day-month-year, or both."""
    in_era = lambda d: F.when(F.year(d).between(1900, 2100), d)
    part = lambda m, at, n: F.substring(m, at, n)

    def parsed(x: Column) -> Column:
        m = x["m"]
        ymd = in_era(valid_date(part(m, 1, 4), part(m, 5, 2), part(m, 7, 2)))
        dmy = in_era(valid_date(part(m, 5, 4), part(m, 3, 2), part(m, 1, 2)))
        two = ymd.isNotNull() & dmy.isNotNull() & (ymd != dmy)
        rule = F.when(two, "COMPACT_AMBIGUOUS").when(ymd.isNotNull(), "COMPACT_YMD").otherwise("COMPACT_DMY")
        return F.struct(
            x["start"].alias("start"), (x["start"] + F.length(m)).alias("end"), rule.alias("rule"), m.alias("value"),
            F.coalesce(ymd, dmy).alias("day"), F.when(two, dmy).alias("other"),
        )

    return F.transform(found_at(F.col("text"), COMPACT), parsed)


_ALL_LABELS = {label: kind for kind, labels in LABELS.items() for label in labels}
_FIRST = sorted({x[0] for x in _ALL_LABELS})
#: by first letter, the longest first: a place where no label begins is left after one look
_LABEL_RUN = "|".join(f"{c}(?:" + "|".join(rf"\Q{x[1:]}\E" for x in sorted(_ALL_LABELS, key=len, reverse=True) if x[0] == c) + ")" for c in _FIRST)
_LABEL = rf"(?=[{''.join(_FIRST)}])(?<![\p{{L}}\p{{M}}\p{{N}}_])(?=((?:{_LABEL_RUN}))(?![A-Za-z؀-ۿ]))"


def label_matches(line: Column) -> Column:
    """Labels on a line as array<struct<at, label>>: at each place where one begins, the longest.

    A shorter label at the same place is never nearer to a date, nor preferred in a tie.
    """
    # labels may overlap, so they are marked beside the line's text, which the pieces between them make up
    gaps, labels = (lambda x, odd=odd: F.filter(x, lambda _, i: i % 2 == odd) for odd in (0, 1))
    at = lambda x, i: _size(F.slice(gaps(x), F.lit(1), i + 1))
    return _marked(F.lower(line), _LABEL, 1, lambda x: F.transform(labels(x), lambda label, i: F.struct(at(x, i).alias("at"), label.alias("label"))))


def classify(dates: DataFrame) -> DataFrame:
    """dates (text, start, end) with kind, distance (null: no label on the line), generic, relation and line columns."""
    before = F.substring_index(F.expr("substring(text, 1, start)"), "\n", -1)
    after = F.substring_index(F.expr("substring(text, end + 1, length(text))"), "\n", 1)
    df = _fixed(dates, _before=before, _after=after)
    at = F.length("_before")
    df = _fixed(df, _line=F.concat("_before", F.expr("substring(text, start + 1, end - start)"), "_after"), _at=at, _to=at + F.col("end") - F.col("start"))
    kind = lambda label: F.element_at(_map(_ALL_LABELS), label)

    def near(x: Column) -> Column:
        stop = x["at"] + F.length(x["label"])
        distance = F.when(stop <= F.col("_at"), F.col("_at") - stop).when(x["at"] >= F.col("_to"), x["at"] - F.col("_to")).otherwise(F.lit(0))
        return F.struct(distance.alias("distance"), (-F.length(x["label"])).alias("_length"), x["label"].alias("_same"))

    # the nearest label's parts as columns; nulls if there is none
    df = df.select("*", F.inline(F.array(F.array_min(F.filter(F.transform(label_matches(F.col("_line")), near), lambda x: x["distance"] <= PROXIMITY))))).drop("_length")
    earlier = F.expr("split(substring(text, 1, start - length(_before) - 1), '\n', -1)")
    df = _fixed(df, _earlier=F.when(F.col("_same").isNull() & (F.col("start") > F.length("_before")), F.slice(F.concat(F.array(F.lit("")), earlier), -2, 2)))
    last, previous = F.get("_earlier", F.lit(1)), F.get("_earlier", F.lit(0))
    blank = lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")) == ""
    df = _fixed(df, _prev=F.when(~blank(last), last).when(~blank(previous), previous))
    longest = F.array_min(F.transform(label_matches(F.col("_prev")), lambda x: F.struct((-F.length(x["label"])).alias("length"), x["at"].alias("at"), x["label"].alias("label"))))
    df = _fixed(df, _adjacent=F.when(F.col("_prev").isNotNull(), longest["label"]))
    label = F.coalesce("_same", "_adjacent")
    return _fixed(
        df, kind=F.coalesce(kind(label), F.lit("UNKNOWN")), generic=F.coalesce(label.isin(*GENERIC), F.lit(False)),
        relation=F.when(F.col("_adjacent").isNotNull(), "adjacent").otherwise("same"),
    )


def score(today: Column, future_days: int = FUTURE_DAYS) -> Column:
    """The score of a classified date (kind, distance, generic, relation, day, other), 0 to 1."""
    base = F.element_at(_map(BASE_SCORES), F.col("kind"))
    near = F.when(F.col("distance").isNotNull(), SAME_LINE + F.when(F.col("distance") <= CLOSE, CLOSE_LABEL).otherwise(0.0)).otherwise(0.0)
    bonus = F.when(F.col("relation") == "adjacent", ADJACENT_LINE).otherwise(near)
    minus = F.when(F.col("generic"), GENERIC_PENALTY).otherwise(0.0) + F.when(F.col("other").isNotNull(), AMBIGUOUS_PENALTY).otherwise(0.0)
    minus = minus + F.when(F.col("day") > F.date_add(today, future_days), FUTURE_PENALTY).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), base + bonus - minus)), 4)


def context(maximum: int = CONTEXT) -> Column:
    """The date's line, or the part of it around the date that has at most so many characters."""
    line, size = F.trim(F.col("_line")), F.col("end") - F.col("start")
    left = F.greatest(F.lit(0), F.col("_at") - F.floor((maximum - size) / 2).cast("int"))
    right = F.least(F.length(line), left + maximum)
    return F.when(F.length(line) <= maximum, line).otherwise(F.substring(line, F.greatest(F.lit(0), right - maximum) + 1, F.lit(maximum)))


def raw_slice(start: str = "start", end: str = "end") -> Column:
    """The part of the raw text that a span of its normal form comes from, by the places of the form's letters."""
    first, last = F.get("places", F.col(start)), F.get("places", F.col(end) - 1)
    return F.substring(F.col("raw"), first + 1, last - first + 1)


def detect_dates(pages: DataFrame, today: Column, future_days: int = FUTURE_DAYS, normalized: bool = False, keep_raw: bool = False) -> DataFrame:
    """Date candidates of pages (document_uuid, page_number, source, text): one row each, with type, score and context.

    normalized: the text is in normal form already. keep_raw: with raw_value; one Python function gives the normal form and its letters' places then.
    """
    # NFKC makes digits of other numbers, so they may not be digits yet
    rows = pages.where(F.col("text").rlike(r"\p{N}")).select("document_uuid", "page_number", "source", F.col("text").alias("raw"))
    if keep_raw:
        form = _fixed(rows, form=normal_form("raw"))
        rows = form.select("document_uuid", "page_number", "source", "raw", F.col("form.places").alias("places"), (F.col("raw") if normalized else F.col("form.text")).alias("text"))
    else:
        rows = _fixed(rows, text=F.col("raw") if normalized else normalize_text(F.col("raw")))
    df = _fixed(classify(scan_dates(rows if keep_raw else rows.drop("raw"))), score=score(today, future_days))
    compact = F.col("rule").startswith("COMPACT")
    hinted = F.lower(F.col("_line")).rlike("|".join(rf"\Q{h}\E" for h in IDENTIFIER_HINTS))
    df = df.where(~compact | (~F.col("kind").isin("UNKNOWN", "DATE_OF_BIRTH") & ~hinted & (F.col("day") <= F.date_add(today, future_days))))
    return df.select(
        "document_uuid", "page_number", "source", F.col("start").alias("occurrence_index"), F.col("rule").alias("parsing_rule"), F.col("value").alias("normalized_value"),
        *([raw_slice().alias("raw_value")] if keep_raw else []),
        F.col("day").alias("detected_date"), F.col("other").alias("alternative_date"), F.col("other").isNotNull().alias("ambiguous"), F.col("kind").alias("candidate_type"),
        F.when(compact, F.round(F.greatest(F.lit(0.0), F.col("score") - COMPACT_PENALTY), 4)).otherwise(F.col("score")).alias("score"), context().alias("context"),
    )


def rank_candidates(candidates: DataFrame) -> DataFrame:
    return candidates.orderBy(F.desc("score"), "page_number", "occurrence_index", "document_uuid")


def choose_suggested(candidates: DataFrame, minimum: float = MIN_SCORE, tolerance: float = TIE_TOLERANCE, key: str = "document_uuid") -> DataFrame:
    """The suggested candidate of each document that has one: the best, if it is good enough and the next best, if as good, has the same date."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), "page_number", "occurrence_index")
    ranked = candidates.withColumn("_nth", F.row_number().over(order)).withColumn("_score", F.lead("score").over(order)).withColumn("_date", F.lead("detected_date").over(order))
    best = ranked.where("_nth = 1").where(F.col("score") >= minimum)
    tie = F.coalesce((F.round(F.col("score") - F.col("_score"), 9) <= tolerance) & (F.col("detected_date") != F.col("_date")), F.lit(False))
    return best.where(~tie).drop("_nth", "_score", "_date")
