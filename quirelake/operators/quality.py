"""Data-quality rules as report queries: the offending rows, with the rule's name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .archive import is_minor

#: Limits of texts, candidates, pages and files; file kinds with their first bytes, last bytes and extensions.
MAX_PAGE_TEXT, MAX_DOCUMENT_TEXT, MAX_CANDIDATES, MAX_PAGES, MAX_FILE = 100_000, 2_000_000, 500, 250, 25 * 1024 * 1024
FILE_KINDS = {
    "application/pdf": ("255044462D", "2525454F46", ("pdf",)),
    "image/jpeg": ("FFD8FF", "FFD9", ("jpg", "jpeg")),
    "image/png": ("89504E470D0A1A0A", "0000000049454E44AE426082", ("png",)),
}


def unique(df: DataFrame, keys: list[str], rule: str, where: Column | None = None) -> DataFrame:
    """Keys (nulls are equal) that several rows have: rule, the keys, rows."""
    rows = df if where is None else df.where(where)
    return rows.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1").select(F.lit(rule).alias("rule"), *keys, "rows")


def too_many(df: DataFrame, keys: list[str], rule: str, limit: int, where: Column | None = None) -> DataFrame:
    """Keys that more than limit rows have: rule, the keys, rows."""
    rows = df if where is None else df.where(where)
    return rows.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > limit).select(F.lit(rule).alias("rule"), *keys, "rows")


def bad_rows(df: DataFrame, rule: str, good: Column) -> DataFrame:
    """Rows for which a condition doesn't hold; unknown counts as holding."""
    return df.where(~F.coalesce(good, F.lit(True))).withColumn("rule", F.lit(rule))


def in_unit(column: str) -> Column:
    return F.col(column).between(0, 1)


def box_ok() -> Column:
    """A span's box lies in the page and isn't turned over."""
    return in_unit("x_min") & in_unit("x_max") & in_unit("y_min") & in_unit("y_max") & (F.col("x_min") <= F.col("x_max")) & (F.col("y_min") <= F.col("y_max"))


def hierarchy(facilities: DataFrame, regions: DataFrame, cities: DataFrame) -> DataFrame:
    """Facilities whose region is of another country or whose city is of another region."""
    r = regions.select(F.col("uuid").alias("region"), F.col("country").alias("_country"))
    c = cities.select(F.col("uuid").alias("city"), F.col("region").alias("_region"))
    joined = facilities.join(r, "region", "left").join(c, "city", "left")
    wrong = F.when(F.col("region").isNotNull() & ~F.col("_country").eqNullSafe(F.col("country")), "region_in_country").when(F.col("city").isNotNull() & ~F.col("_region").eqNullSafe(F.col("region")), "city_in_region")
    return joined.withColumn("rule", wrong).where("rule IS NOT NULL").select("rule", "uuid")


def file_problems(blobs: DataFrame) -> DataFrame:
    """Files (uuid, name, mime, length, content) that are empty, too large, or not what their type and name say."""
    head, tail = F.hex(F.substring("content", 1, 8)), lambda content: F.hex(F.substring(content, -12, 12))
    trimmed = F.btrim(F.col("content"), F.lit(b" \t\n\r\x0b\x0c"))  # blanks may follow the end of a PDF, but not of an image
    suffix = F.lower(F.substring_index("name", ".", -1))
    kind_ok, name_ok, end_ok = F.lit(False), F.lit(False), F.lit(False)
    for mime, (first, last, names) in FILE_KINDS.items():
        own = F.col("mime") == mime
        kind_ok, name_ok = kind_ok | (own & head.startswith(first)), name_ok | (own & suffix.isin(*names))
        end_ok = end_ok | (own & tail(trimmed if mime == "application/pdf" else F.col("content")).endswith(last))
    rule = (
        F.when(F.col("length") == 0, "empty").when(F.col("length") > MAX_FILE, "too_large").when(~F.col("mime").isin(*FILE_KINDS), "unknown_type")
        .when(~name_ok, "extension").when(~kind_ok, "first_bytes").when(~end_ok, "end_marker")
    )
    return blobs.withColumn("rule", rule).where("rule IS NOT NULL").select("rule", "uuid")


def text_shape(pages: DataFrame, headers: DataFrame) -> DataFrame:
    """Documents whose pages don't add up to their header: number, numbering from 1 without gaps, characters."""
    per = pages.groupBy("document_uuid").agg(F.count("*").alias("_n"), F.min("page_number").alias("_first"), F.max("page_number").alias("_last"), F.count_distinct("page_number").alias("_distinct"), F.sum("meaningful_character_count").alias("_chars"))
    joined = headers.join(per, "document_uuid", "left")
    rule = (
        F.when(F.coalesce("_n", F.lit(0)) != F.col("page_count"), "page_count").when((F.col("_first") != 1) | (F.col("_last") != F.col("_n")) | (F.col("_distinct") != F.col("_n")), "page_numbers")
        .when(F.col("_chars") != F.col("meaningful_character_count"), "character_total")
    )
    return joined.withColumn("rule", rule).where("rule IS NOT NULL").select("rule", "document_uuid")


def ocr_shape(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """OCR pages whose text isn't their lines joined, whose confidences leave 0 to 1, or that have statistics without lines or the reverse."""
    line = F.struct("sequence", "text")
    per = spans.groupBy("document_uuid", "page_number").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["text"]), "\n").alias("_text"), F.min("confidence").alias("_low"), F.max("confidence").alias("_high"))
    joined = pages.join(per, ["document_uuid", "page_number"], "left")
    rule = (
        F.when((F.col("_low") < 0) | (F.col("_high") > 1), "confidence").when(F.coalesce("_text", F.lit("")) != F.coalesce("text", F.lit("")), "joined_lines")
        .when(F.col("_low").isNull() != F.col("mean_confidence").isNull(), "statistics")
    )
    return joined.withColumn("rule", rule).where("rule IS NOT NULL").select("rule", "document_uuid", "page_number")


def foreign_evidence(evidence: DataFrame, spans: DataFrame) -> DataFrame:
    """Evidence (document_uuid, page_number, sequence) that no span of that document and page stands for."""
    return evidence.join(spans, ["document_uuid", "page_number", "sequence"], "left_anti").withColumn("rule", F.lit("evidence_page"))



RULES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "document_bytes_once": lambda d: unique(d, ["patient_uuid", "sha256"], "document_bytes_once", F.col("archive_status") == "ACTIVE"),
    "page_once": lambda d: unique(d, ["document_uuid", "page_number"], "page_once"),
    "page_from_one": lambda d: bad_rows(d, "page_from_one", F.col("page_number") >= 1),
    "span_once": lambda d: unique(d, ["document_uuid", "page_number", "sequence"], "span_once"),
    "span_box": lambda d: bad_rows(d, "span_box", box_ok() & (F.col("sequence") >= 0)),
    "candidate_once": lambda d: unique(d, ["document_uuid", "page_number", "occurrence_index", "pipeline_version"], "candidate_once", F.col("is_current")),
    "suggestion_per_document": lambda d: unique(d, ["document_uuid"], "suggestion_per_document", F.col("is_current") & F.col("is_suggested")),
    "suggestion_per_page": lambda d: unique(d, ["document_uuid", "page_number"], "suggestion_per_page", F.col("is_current") & F.col("is_suggested")),
    "candidate_score": lambda d: bad_rows(d, "candidate_score", in_unit("score")),
    "extraction_once": lambda d: unique(d, ["document_uuid", "page_number", "pipeline_version"], "extraction_once"),
    "extraction_confidence": lambda d: bad_rows(d, "extraction_confidence", in_unit("confidence")),
    "lab_row": lambda d: bad_rows(d, "lab_row", (F.col("page_number") >= 1) & (F.col("row_index") >= 0) & in_unit("extraction_confidence")),
    "facility_region": lambda d: bad_rows(d, "facility_region", F.col("city").isNull() | F.col("region").isNotNull()),
    "facility_once": lambda d: unique(d, ["country", "city", "normalized_name"], "facility_once"),
    "region_once": lambda d: unique(d, ["country", "normalized_name"], "region_once"),
    "city_once": lambda d: unique(d, ["region", "normalized_name"], "city_once"),
    "alias_once": lambda d: unique(d, ["facility", "normalized_name"], "alias_once"),
    "identity_once": lambda d: unique(d, ["patient_uuid", "document_type"], "identity_once", (F.col("status") == "CURRENT") & (F.col("verification_status") == "VERIFIED")),
    "identity_dates": lambda d: bad_rows(d, "identity_dates", F.col("expiry_date") > F.col("issue_date")),
    "guardian_once": lambda d: unique(d, ["guardian_user", "minor_patient", "relationship"], "guardian_once", F.col("active")),
    "guardian_verified": lambda d: bad_rows(d, "guardian_verified", ~F.col("active") | (F.col("verification_status") == "VERIFIED")),
    "claim_per_patient": lambda d: unique(d, ["patient_uuid"], "claim_per_patient", F.col("status") == "PENDING"),
    "claim_per_email": lambda d: unique(d.withColumn("email", F.lower("requested_email")), ["email"], "claim_per_email", F.col("status") == "PENDING"),
    "email_once": lambda d: unique(d.withColumn("email", F.lower("email")), ["email"], "email_once"),
    "country_code": lambda d: bad_rows(d, "country_code", F.col("nationality").rlike("^[A-Z]{2}$")),
    "born_before_today": lambda d: bad_rows(d, "born_before_today", F.col("date_of_birth") <= F.current_date()),
    "owner_adult": lambda d: bad_rows(d, "owner_adult", F.col("user_uuid").isNull() | ~is_minor(F.col("date_of_birth"), F.current_date())),
    "candidates_per_document": lambda d: too_many(d, ["document_uuid"], "candidates_per_document", MAX_CANDIDATES, F.col("is_current")),
    "pages_per_document": lambda d: too_many(d, ["document_uuid"], "pages_per_document", MAX_PAGES),
    "page_text_size": lambda d: bad_rows(d, "page_text_size", F.length("text") <= MAX_PAGE_TEXT),
    "document_text_size": lambda d: bad_rows(d, "document_text_size", F.length("text") <= MAX_DOCUMENT_TEXT),
}


def violations(df: DataFrame, rule: str) -> DataFrame:
    """The rows or keys of df that break a rule of RULES."""
    return RULES[rule](df)
