"""Headed sections from positioned text lines, as window functions over each document's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import io

MIN_CONFIDENCE, FRINGE, GAP_HEIGHTS, MIN_GAP, HEADING = 0.5, 3, 3.0, 0.005, 48
#: Lines that are no body text, and headings that are none. Long lists of words say first what their words begin with, so that most places are left after one look.
NOISE = (
    r"(?U)^\s*[.\-–—•·_|/\\]{1,8}\s*$",
    r"(?U)^\s*\d{1,4}\s*$",
    r"(?U)^\s*\+?\d{6,}(?:[\s./\-:]\d+)*\s*$",
    r"(?iU)\b(ISO|IS0)\s*15189\b",
    r"(?iU)^\s*(ref\.?\s*by|requested|reported|patient(?: id)?|name|age/sex|specimen(?: id)?|date of birth|collection|run date/time|printed|doctor|dr\.?|reviewed by|referred by|address|phone|tel\.?)\b",
    r"(?U)\b\d+[٠-٩]?\s*(سنة|سنوات|عام|شهر|يوم|سنه)\b",
    r"(?=[اهدبتمق])(اسم المريض|اسم الطبيب|التاريخ|العمر|المرسل|العنوان|الرقم|الجوال|هاتف|دكتوراه|الدكتور|الطبيب|بورد|تخصص|الإقامة|هشاشة|الأشعة|الرنين|السونار|الأسنان|الثدي|محمع|مطعم|الطابق|الأرضي|المركز|العيادة|الطابق الارضي|قرب)",
    r"(?iU)(?=[DFRMP])\b(DMRD|FIBMS|RANZCR|FRCR|FRCP|MRCP|MBChB|MBBCh|MSc|M\.?Sc|PhD|MD|M\.D|MRCS|FCPS|DNB)\b",
    r"(?iU)(?=[CLHRM])\b(CENTER|CENTRE|LABORATORY|LABORATORIES|LAB|CLINIC|HOSPITAL|RADIOLOGY CENTER|MEDICAL CENTRE|MEDICAL CENTER)\b",
)
#: Lines that a task looks at, about so many.
TASK_LINES = 250_000
HEADING_END = r"[.!?。；;]$"
HEADING_NOISE = r"(?U)\b(هشاشة|الأشعة|السونار|الرنين|الأسنان|الثدي)\b"


def is_noise(text: Column) -> Column:
    out = F.trim(text) == ""
    for pattern in NOISE:
        out = out | F.trim(text).rlike(pattern)
    return out


def body_lines(spans: DataFrame) -> DataFrame:
    """Lines that are read well enough and aren't noise."""
    # noise as a row of a generator: a plain filter would be moved before the shuffle that deals the lines to tasks
    noise = F.inline(F.array(F.struct(is_noise(F.coalesce("text", F.lit(""))).alias("_noise"))))
    read = spans.where(F.coalesce("confidence", F.lit(0.0)) >= MIN_CONFIDENCE)
    return read.select("*", noise).where(~F.col("_noise")).drop("_noise").withColumn("text", F.trim("text"))


def without_fringe(lines: DataFrame, keys: tuple[str, ...] = ("document_uuid",)) -> DataFrame:
    """Lines without a head or foot of at most 3 lines that a wide gap sets apart; by document, or by page if keys say so."""
    whole = Window.partitionBy(*keys)
    order = whole.orderBy("y_min", "y_max", "page_number", "sequence")
    df = lines.withColumn("_n", F.count("*").over(whole)).withColumn("_at", F.row_number().over(order) - 1)
    df = df.withColumn("_h", F.median(F.col("y_max") - F.col("y_min")).over(whole))
    gap = (F.col("y_min") - F.lag("y_max").over(order)) > F.greatest(F.col("_h") * GAP_HEIGHTS, F.lit(MIN_GAP))
    df = df.withColumn("_cut", F.when(gap, F.col("_at")))
    df = df.withColumn("_head", F.min("_cut").over(whole))
    head = F.when(F.col("_head") <= FRINGE, F.col("_head")).otherwise(0)
    df = df.withColumn("_head", F.coalesce(head, F.lit(0)))
    # the last gap among the lines that are left; a gap at their first line is none
    df = df.withColumn("_tail", F.max(F.when(F.col("_cut") > F.col("_head"), F.col("_cut"))).over(whole))
    tail = F.when(F.col("_n") - F.col("_tail") <= FRINGE, F.col("_tail")).otherwise(F.col("_n"))
    keep = (F.col("_n") < 3) | ((F.col("_at") >= F.col("_head")) & (F.col("_at") < F.coalesce(tail, F.col("_n"))))
    return df.where(keep).drop("_n", "_at", "_h", "_cut", "_head", "_tail")


def sections(spans: DataFrame, fringe_keys: tuple[str, ...] = ("document_uuid",)) -> DataFrame:
    """document_uuid, heading, body, page_number, sequence: a section for each heading with text under it."""
    # documents are dealt to tasks before their lines are looked at, as that is most of the work and spans may come from few tasks; nothing is shuffled later
    lines = without_fringe(body_lines(io.by_keys(spans, ["document_uuid"], TASK_LINES)), fringe_keys)
    order = Window.partitionBy("document_uuid").orderBy("page_number", "sequence")
    after = F.lead("text").over(order)
    short = (F.length("text") <= HEADING) & ~F.col("text").rlike(HEADING_END) & ~F.col("text").rlike(HEADING_NOISE)
    heading = short & (after.isNull() | ((F.length("text") <= F.length(after) * 0.6) & (F.length("text") >= 2)))
    marked = lines.withColumn("is_heading", heading)
    marked = marked.withColumn("section", F.sum(F.col("is_heading").cast("int")).over(order))
    place = F.struct("page_number", "sequence")
    per = marked.groupBy("document_uuid", "section").agg(
        F.coalesce(F.max(F.when(F.col("is_heading"), F.col("text"))), F.lit("")).alias("heading"), F.min(place).alias("first"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("is_heading"), F.struct("page_number", "sequence", "text")))), lambda x: x["text"]), "\n").alias("body"),
    )
    return per.where("body <> ''").select("document_uuid", "heading", "body", "first.page_number", "first.sequence")
