"""Structured filters and weighted keyword search over documents.

Rank: each field's share of words that are query words, weighted by the field's class and damped by
the length of the field; membership: every query word occurs in some field. This is this engine's
own formula.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields that a keyword searches, with the weight of each.
FIELDS = {
    "title": 1.0,
    "description": 0.4,
    "facility_name": 0.4,
    "location_text": 0.2,
    "department": 0.2,
    "physician_name": 0.2,
    "text": 0.1,
}
#: Filters that a search takes, and its limits.
FILTERS = ("q", "document_type", "facility", "date_status", "report_from", "report_to", "upload_from", "upload_to", "year", "month", "department", "physician")
MIN_YEAR, MAX_YEAR, MAX_QUERY = 1900, 2100, 200


def validate_filters(filters: dict) -> dict:
    """The filters if they agree with each other; a ValueError names what doesn't."""
    unknown = sorted(set(filters) - set(FILTERS))
    if unknown:
        raise ValueError(f"unknown filters: {', '.join(unknown)}")
    if filters.get("month") is not None and filters.get("year") is None:
        raise ValueError("month needs year")
    if filters.get("month") is not None and not 1 <= filters["month"] <= 12:
        raise ValueError("month must be 1 to 12")
    if filters.get("year") is not None and not MIN_YEAR <= filters["year"] <= MAX_YEAR:
        raise ValueError(f"year must be {MIN_YEAR} to {MAX_YEAR}")
    for kind in ("report", "upload"):
        begin, end = filters.get(f"{kind}_from"), filters.get(f"{kind}_to")
        if begin and end and begin > end:
            raise ValueError(f"{kind}_from is after {kind}_to")
    if filters.get("date_status") not in (None, "VERIFIED", "UNCONFIRMED"):
        raise ValueError("date_status must be VERIFIED or UNCONFIRMED")
    if filters.get("date_status") == "UNCONFIRMED" and any(filters.get(k) is not None for k in ("year", "month", "report_from", "report_to")):
        raise ValueError("UNCONFIRMED excludes filters on the report date")
    if len(filters.get("q") or "") > MAX_QUERY:
        raise ValueError(f"q has over {MAX_QUERY} characters")
    return filters


def by_date(df: DataFrame, begin: date | None = None, end: date | None = None) -> DataFrame:
    """Report date between two days, both included."""
    if begin is not None:
        df = df.where(F.col("document_date") >= F.lit(begin))
    return df if end is None else df.where(F.col("document_date") <= F.lit(end))


def by_upload(df: DataFrame, begin: date | None = None, end: date | None = None, column: str = "created_at") -> DataFrame:
    """Uploaded between two UTC days, the last one included."""
    if begin is not None:
        df = df.where(F.col(column) >= F.lit(begin).cast("timestamp"))
    return df if end is None else df.where(F.col(column) < F.lit(end + timedelta(days=1)).cast("timestamp"))


def by_date_status(df: DataFrame, status: str | None) -> DataFrame:
    """VERIFIED: confirmed and dated; UNCONFIRMED: not confirmed or not dated."""
    if status is None:
        return df
    confirmed = F.coalesce(F.col("date_verified"), F.lit(False)) & F.col("document_date").isNotNull()
    return df.where(confirmed if status == "VERIFIED" else ~confirmed)


def icontains(column: str, part: str) -> Column:
    """The column holds the text, in whatever case; no wildcards."""
    return F.contains(F.lower(F.col(column)), F.lower(F.lit(part)))


def with_text(df: DataFrame, texts: DataFrame) -> DataFrame:
    """Documents with their canonical text, null if there is none."""
    return df.join(texts.select("document_uuid", "text"), "document_uuid", "left")


def facilities(df: DataFrame, active: bool | None = True, country: str | None = None, region: str | None = None, city: str | None = None, kind: str | None = None) -> DataFrame:
    """The facility directory by country, normalised region and city names, and type."""
    for column, wanted in (("active", active), ("country", country), ("region_normalized", region), ("city_normalized", city), ("facility_type", kind)):
        if wanted is not None:
            df = df.where(F.col(column) == F.lit(wanted))
    return df


def with_aliases(facilities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Facilities with their active aliases nested in order of name."""
    own = aliases.where("active").groupBy(F.col("facility").alias("_f")).agg(F.sort_array(F.collect_list(F.struct("name", "language"))).alias("aliases"))
    return facilities.join(own, F.col("uuid") == F.col("_f"), "left").drop("_f")


def tokens(column: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(column, F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")


def spaced(column: Column) -> Column:
    """The words of `tokens` as one text, with one blank between two and perhaps one at an end."""
    return F.regexp_replace(F.lower(F.coalesce(column, F.lit(""))), r"[^\p{L}\p{N}]+", " ")


def query_tokens(query: str) -> list[str]:
    import re

    return sorted(set(re.findall(r"[^\W_]+", query.lower())))


def keyword(df: DataFrame, query: str, fields: dict[str, float] = FIELDS) -> DataFrame:
    """Documents in which every query word occurs in some field, with `rank`. Fields that the table lacks count as empty."""
    wanted = query_tokens(query)
    used = {f: w for f, w in fields.items() if f in df.columns}
    if not wanted or not used:
        return df.withColumn("rank", F.lit(0.0)).where(F.lit(False))
    # words of the query that a field holds; a document's words never leave its row
    held = df.withColumn("_hits", F.struct(*[F.filter(tokens(F.col(f)), lambda t: t.isin(wanted)).alias(f) for f in used]))
    every = F.array_distinct(F.concat(*[F.col(f"_hits.{f}") for f in used]))
    rank = sum((F.lit(w) * F.size(F.col(f"_hits.{f}")) / (F.lit(1.0) + F.length(F.coalesce(F.col(f), F.lit(""))) / 100.0) for f, w in used.items()), F.lit(0.0))
    return held.where(F.size(every) == len(wanted)).withColumn("rank", rank).drop("_hits")


def search_order(df: DataFrame, ranked: bool) -> DataFrame:
    """Best rank first if there is a keyword, then newest first."""
    keys = [F.desc("document_date"), F.desc("created_at"), F.desc("document_uuid")]
    return df.orderBy(*([F.desc("rank")] if ranked else []), *keys)


def search(df: DataFrame, filters: dict, index: str | None = None) -> DataFrame:
    """Active documents by all given filters, in search order; a keyword is looked for after the other filters, in the index
    under that path if there is one, else in the texts."""
    from . import archive, search_index

    f = validate_filters(filters)
    df = archive.by_facility(archive.by_type(archive.active(df), f.get("document_type")), f.get("facility"))
    df = by_upload(by_date(by_date_status(df, f.get("date_status")), f.get("report_from"), f.get("report_to")), f.get("upload_from"), f.get("upload_to"))
    if f.get("year") is not None:
        df = archive.by_month(df, f["year"], f["month"]) if f.get("month") else archive.by_year(df, f["year"])
    for key, column in (("department", "department"), ("physician", "physician_name")):
        if f.get(key):
            df = df.where(icontains(column, f[key]))
    if not f.get("q"):
        return search_order(df, False)
    return search_order(search_index.keyword(df, index, f["q"]) if index else keyword(df, f["q"]), True)
