"""Extraction scorecards: flags of each item, and rates over all or by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluate(items: DataFrame) -> DataFrame:
    """items (expected_date, expected_type, candidates array<struct<day, kind>>, suggested_date, suggested_type) with their flags."""
    known, suggested = F.col("expected_date").isNotNull(), F.col("suggested_date").isNotNull()
    matching = F.filter("candidates", lambda c: c["day"] == F.col("expected_date"))
    found = known & (F.coalesce(F.size(matching), F.lit(0)) > 0)
    return items.select(
        "*", F.coalesce(found, F.lit(False)).alias("detected"), F.coalesce(F.col("suggested_date") == F.col("expected_date"), F.lit(False)).alias("correct"),
        F.coalesce(suggested & (F.col("suggested_date") != F.col("expected_date")), F.lit(False)).alias("wrong"), (~suggested).alias("no_suggestion"),
        F.coalesce(F.col("suggested_type") == "DATE_OF_BIRTH", F.lit(False)).alias("birth_date_selected"),
        F.when(found, F.get(matching, F.lit(0))["kind"] == F.col("expected_type")).alias("type_ok"),
    )


def _rates() -> list[Column]:
    n = F.count("*")
    suggested = n - F.count_if("no_suggestion")
    rate = lambda x, of: F.when(of > 0, x / of)
    return [
        n.alias("n"), rate(F.count_if("detected"), n).alias("detection_recall"), rate(F.count_if("correct"), n).alias("suggestion_accuracy"),
        rate(F.count_if("correct"), suggested).alias("suggestion_precision"), rate(F.count_if("wrong"), n).alias("wrong_rate"),
        rate(F.count_if("no_suggestion"), n).alias("no_suggestion_rate"), rate(F.count_if("birth_date_selected"), n).alias("birth_date_rate"),
        rate(F.count_if("type_ok"), F.count("type_ok")).alias("type_accuracy"),
    ]


def scorecard(evaluated: DataFrame) -> DataFrame:
    """One row of rates over the items that have an expected date; null where there is nothing to divide by."""
    return evaluated.where(F.col("expected_date").isNotNull()).agg(*_rates())


def scorecard_by(evaluated: DataFrame, category: str) -> DataFrame:
    """Recall and accuracy of each category, rounded to 4 places."""
    per = evaluated.where(F.col("expected_date").isNotNull()).groupBy(category).agg(*_rates())
    return per.select(category, "n", F.round("detection_recall", 4).alias("detection_recall"), F.round("suggestion_accuracy", 4).alias("suggestion_accuracy"))


def paired_scorecard(evaluated: DataFrame, source: str) -> DataFrame:
    """Recall and accuracy of each source of paired items."""
    return scorecard_by(evaluated, source)


def pair_consistency(evaluated: DataFrame, pair: str) -> DataFrame:
    """The share of pairs whose items all got the same suggestion; null without pairs."""
    per = evaluated.groupBy(pair).agg(F.count("*").alias("n"), F.count_distinct(F.coalesce(F.col("suggested_date").cast("string"), F.lit(""))).alias("different")).where("n > 1")
    return per.agg(F.when(F.count("*") > 0, F.count_if(F.col("different") == 1) / F.count("*")).alias("pair_consistency"))
