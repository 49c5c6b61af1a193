"""Document texts from pages: usability, totals, duplicates by bytes and by content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import io


def usability(pages: DataFrame, min_chars: int = T.MIN_CHARS, min_page_chars: int = T.MIN_PAGE_CHARS, min_ratio: float = T.MIN_TEXT_PAGE_RATIO) -> DataFrame:
    """Per document (document_uuid) of pages with text: page_count, meaningful_characters, pages_requiring_ocr, usable, reason."""
    counted = pages.withColumn("_n", T.meaningful(F.col("text")))
    per = counted.groupBy("document_uuid").agg(
        F.count("*").alias("page_count"), F.sum("_n").cast("long").alias("meaningful_characters"),
        F.count_if(F.col("_n") < min_page_chars).alias("pages_requiring_ocr"),
    )
    ratio = (F.col("page_count") - F.col("pages_requiring_ocr")) / F.col("page_count")
    usable = (F.col("meaningful_characters") >= min_chars) & (ratio >= min_ratio)
    return per.withColumn("usable", usable).withColumn("reason", F.when(F.col("usable"), "usable_pdf_text").otherwise("insufficient_meaningful_text"))


def pages_requiring_ocr(pages: DataFrame, min_page_chars: int = T.MIN_PAGE_CHARS) -> DataFrame:
    return pages.where(T.meaningful(F.col("text")) < min_page_chars).orderBy("document_uuid", "page_number")


def document_text(pages: DataFrame) -> DataFrame:
    """A document's pages joined in order by a form feed line, with the totals of its pages."""
    ordered = F.array_sort(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("text"))))
    source = F.collect_set("effective_source")
    out = pages.groupBy("document_uuid").agg(
        F.array_join(F.transform(ordered, lambda p: p["text"]), "\n\f\n").alias("text"), F.sum(T.meaningful(F.col("text"))).cast("long").alias("meaningful_characters"),
        F.bool_or("requires_ocr").alias("has_pages_requiring_ocr"), source.alias("_sources"),
    )
    method = F.when(F.size("_sources") > 1, "HYBRID").otherwise(F.when(F.array_contains("_sources", "OCR"), "OCR").otherwise("PDF_TEXT"))
    return out.withColumn("character_count", F.length("text")).withColumn("extraction_method", method).drop("_sources")


def page_confidence(spans: DataFrame) -> DataFrame:
    """Mean and least confidence of each page's lines."""
    return spans.groupBy("document_uuid", "page_number").agg(F.avg("confidence").alias("mean_confidence"), F.min("confidence").alias("min_confidence"))


def exact_duplicates(df: DataFrame, digest: str = "sha256", scope: str = "patient_uuid") -> DataFrame:
    """Active documents of one scope that have the same bytes: scope, digest, copies, first (the smallest id)."""
    kept = df.where("archive_status = 'ACTIVE'")
    return kept.groupBy(scope, digest).agg(F.count("*").alias("copies"), F.min("document_uuid").alias("first")).where("copies > 1")


def content_duplicates(df: DataFrame, key: bytes, text: str = "text", scope: str = "patient_uuid") -> DataFrame:
    """Active documents whose canonical text another one of the scope has: document_uuid, fingerprint, duplicate_of (the
    earliest other one). Texts are shuffled as fingerprints only."""
    from .archive import earliest_other

    marked = df.where("archive_status = 'ACTIVE'").select("document_uuid", scope, "created_at", T.fingerprint(F.col(text), key).alias("fingerprint"))
    # three passes read it: written once, so that each text is normalised once
    path = io.scratch(df.sparkSession, "fingerprints")
    marked.where("fingerprint <> ''").write.parquet(path)
    marked = df.sparkSession.read.schema(marked.schema).parquet(path)
    marked = marked.withColumn("_order", F.struct("created_at", "document_uuid"))
    found = earliest_other(marked, [scope, "fingerprint"], "_order", "document_uuid")
    return found.select("document_uuid", scope, "fingerprint", F.col("earliest_other").alias("duplicate_of"))


def integrity(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """Stored files against the bytes found (uuid, length, content_sha256): VALID, CORRUPTED or MISSING."""
    found = blobs.select(F.col("uuid").alias("_u"), F.col("length").alias("_len"), F.col("content_sha256").alias("_sha"))
    same = (F.col("size_bytes") == F.col("_len")) & (F.col("sha256") == F.col("_sha"))
    status = F.when(F.col("_u").isNull(), "MISSING").when(same, "VALID").otherwise("CORRUPTED")
    return files.join(found, F.col("uuid") == F.col("_u"), "left").withColumn("integrity_status", status).drop("_u", "_len", "_sha")


def integrity_counts(checked: DataFrame) -> DataFrame:
    return checked.groupBy("integrity_status").agg(F.count("*").alias("n"))
