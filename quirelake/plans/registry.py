"""Every registered query of the archive engine, with its DuckDB SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import archive, audit, dates, evaluate, identity, labs, narrative, quality, relations, rollup, search, series, text_quality
from ..sources import io
from ..streaming import streams
from . import driver_tables as D
from .register import ORACLE_SQL, QUERIES, query  # noqa: F401

KEY = b"archive-demo-key"
TODAY = date(2001, 8, 2)
NOW = 1_706_659_200
DAY = 86_400
#: Pages that a task finds dates on, about so many.
TASK_PAGES = 100_000
def stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


# archive


@query(f"WITH {D.DOCS} SELECT document_uuid, document_type, document_date FROM docs WHERE archive_status = 'ACTIVE' ORDER BY CASE WHEN date_verified THEN CAST(document_date AS TIMESTAMP) ELSE created_at END DESC, created_at DESC, document_uuid DESC LIMIT 20 OFFSET 20", days=('document_date',))
def archive_chronology_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of twenty of all active documents, newest first."""
    rows, _ = archive.page(archive.chronology(archive.active(D.documents(spark, sf_dir))), 2)
    return rows.select("document_uuid", "document_type", "document_date")


@query(f"WITH {D.DOCS} SELECT document_uuid, document_date, document_type FROM docs WHERE archive_status = 'ACTIVE' AND year(document_date) = 1997", days=('document_date',))
def archive_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.by_year(archive.active(D.documents(spark, sf_dir)), 1997).select("document_uuid", "document_date", "document_type")


@query(f"WITH {D.DOCS} SELECT document_uuid, document_date FROM docs WHERE archive_status = 'ACTIVE' AND year(document_date) = 1998 AND month(document_date) = 12", days=('document_date',))
def archive_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.by_month(archive.active(D.documents(spark, sf_dir)), 1998, 12).select("document_uuid", "document_date")


@query(f"WITH {D.DOCS} SELECT document_uuid, facility_display, region_name FROM docs WHERE archive_status = 'ACTIVE' AND document_type = '1-URGENT' AND healthcare_facility = 7")
def archive_type_facility(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = archive.by_facility(archive.by_type(archive.active(D.documents(spark, sf_dir)), "1-URGENT"), 7)
    return archive.with_facility(kept, D.facilities(spark, sf_dir)).select("document_uuid", "facility_display", "region_name")


@query(f"WITH {D.DOCS} SELECT year(document_date) AS year, count(*) AS n FROM docs WHERE archive_status = 'ACTIVE' AND date_verified GROUP BY 1")
def archive_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.count_by_year(D.documents(spark, sf_dir))


@query(f"WITH {D.DOCS} SELECT year(document_date) AS year, month(document_date) AS month, count(*) AS n FROM docs WHERE archive_status = 'ACTIVE' AND date_verified GROUP BY 1, 2")
def archive_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.count_by_month(D.documents(spark, sf_dir))


@query(f"WITH {D.DOCS}, m AS (SELECT year(document_date) AS year, month(document_date) AS month, count(*) AS n FROM docs WHERE archive_status = 'ACTIVE' AND date_verified GROUP BY 1, 2) SELECT year, CAST(sum(n) AS BIGINT) AS n, string_agg(month || ':' || n, ' ' ORDER BY month DESC) AS months FROM m GROUP BY year")
def archive_year_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = archive.year_tree(D.documents(spark, sf_dir))
    return tree.select("year", "n", F.array_join(F.transform("months", lambda m: F.concat_ws(":", m["month"].cast("string"), m["n"].cast("string"))), " ").alias("months"))


@query(f"WITH {D.DOCS} SELECT document_type, count(*) AS n FROM docs WHERE archive_status = 'ACTIVE' GROUP BY 1")
def archive_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.count_by_type(D.documents(spark, sf_dir))


@query(f"WITH {D.DOCS} SELECT healthcare_facility, facility_display, count(*) AS n FROM docs WHERE archive_status = 'ACTIVE' AND healthcare_facility IS NOT NULL GROUP BY 1, 2")
def archive_by_facility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.count_by_facility(archive.with_facility(D.documents(spark, sf_dir), D.facilities(spark, sf_dir)))


@query(f"""WITH {D.DOCS}, a AS (SELECT * FROM docs WHERE archive_status = 'ACTIVE')
SELECT patient_uuid, 'year' AS dimension, year(document_date) AS year, NULL AS month, NULL AS value, count(*) AS n FROM a WHERE date_verified GROUP BY ALL
UNION ALL SELECT patient_uuid, 'month', year(document_date), month(document_date), NULL, count(*) FROM a WHERE date_verified GROUP BY ALL
UNION ALL SELECT patient_uuid, 'type', NULL, NULL, document_type, count(*) FROM a GROUP BY ALL
UNION ALL SELECT patient_uuid, 'facility', NULL, NULL, CAST(healthcare_facility AS VARCHAR), count(*) FROM a WHERE healthcare_facility IS NOT NULL GROUP BY ALL""")
def archive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every patient's counts by year, month, type and facility, in one scan."""
    return archive.summary_cells(D.documents(spark, sf_dir))


@query(f"WITH {D.DOCS}, {D.PAGES} SELECT patient_uuid, count(*) AS n FROM pages_ p JOIN docs d USING (document_uuid) WHERE processing_status = 'AWAITING_CONFIRMATION' AND NOT p.date_verified AND archive_status = 'ACTIVE' GROUP BY 1")
def unconfirmed_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.unconfirmed_count(D.documents(spark, sf_dir), D.pages(spark, sf_dir))


@query(f"WITH {D.DOCS}, {D.PAGES} SELECT document_uuid, patient_uuid FROM docs WHERE archive_status = 'ACTIVE' AND document_uuid IN (SELECT document_uuid FROM pages_ WHERE processing_status = 'AWAITING_CONFIRMATION' AND NOT date_verified)")
def unconfirmed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.unconfirmed(D.documents(spark, sf_dir), D.pages(spark, sf_dir)).select("document_uuid", "patient_uuid")


@query(f"WITH {D.DOCS}, a AS (SELECT *, row_number() OVER (PARTITION BY patient_uuid ORDER BY created_at DESC, document_uuid DESC) AS nth FROM docs WHERE archive_status = 'ACTIVE') SELECT patient_uuid, document_uuid FROM a WHERE nth = 1")
def latest_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.latest_per(archive.active(D.documents(spark, sf_dir)), ["patient_uuid"], [F.desc("created_at"), F.desc("document_uuid")]).select("patient_uuid", "document_uuid")


@query(f"""WITH {D.DOCS}, q AS (SELECT document_uuid, patient_uuid AS queue, lead(document_uuid) OVER w AS follower, first(document_uuid) OVER w AS head FROM docs WHERE archive_status = 'ACTIVE' AND NOT date_verified WINDOW w AS (PARTITION BY patient_uuid ORDER BY created_at, document_uuid))
SELECT queue, document_uuid, coalesce(follower, CASE WHEN head <> document_uuid THEN head END) AS next_uuid FROM q""")
def next_in_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = archive.active(D.documents(spark, sf_dir)).where("NOT date_verified").withColumn("queue", F.col("patient_uuid"))
    return archive.next_pending(waiting).select("queue", "document_uuid", "next_uuid")


# search


@query(f"WITH {D.DOCS} SELECT document_uuid, document_date FROM docs WHERE archive_status = 'ACTIVE' AND document_date BETWEEN DATE '1997-03-01' AND DATE '1997-04-15'", days=('document_date',))
def search_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(D.documents(spark, sf_dir), {"report_from": date(1997, 3, 1), "report_to": date(1997, 4, 15)}).select("document_uuid", "document_date")


@query(f"WITH {D.DOCS} SELECT document_uuid FROM docs WHERE archive_status = 'ACTIVE' AND NOT (date_verified AND document_date IS NOT NULL)")
def search_status_unconfirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(D.documents(spark, sf_dir), {"date_status": "UNCONFIRMED"}).select("document_uuid")


@query(f"WITH {D.DOCS} SELECT document_uuid, department FROM docs WHERE archive_status = 'ACTIVE' AND contains(lower(department), 'build')")
def search_icontains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(D.documents(spark, sf_dir), {"department": "BUILD"}).select("document_uuid", "department")


@query("SELECT event_id AS uuid, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08'")
def upload_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.by_upload(D.events(spark, sf_dir), date(2024, 1, 5), date(2024, 1, 7)).select("uuid", "event_type")


def _searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = D.table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("document_uuid"), "text", F.col("source").alias("title"), F.col("lang").alias("department"), F.lit(None).cast("date").alias("document_date"), F.lit(None).cast("timestamp").alias("created_at"))


_FIELD = "regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+')"
_COUNTED = f"""SELECT doc_id AS document_uuid, source, lang, text, len([x FOR x IN {_FIELD.format('source')} IF x IN ('and', 'the')]) AS a,
  len([x FOR x IN {_FIELD.format('lang')} IF x IN ('and', 'the')]) AS b, [x FOR x IN {_FIELD.format('text')} IF x IN ('and', 'the')] AS c FROM documents"""


@query(f"WITH k AS ({_COUNTED}) SELECT document_uuid FROM k WHERE list_contains(c, 'and') AND list_contains(c, 'the')")
def keyword_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.keyword(_searchable(spark, sf_dir), "The and").select("document_uuid")


@query(f"WITH k AS ({_COUNTED}) SELECT document_uuid, round(1.0 * a / (1 + length(source) / 100.0) + 0.2 * b / (1 + length(lang) / 100.0) + 0.1 * len(c) / (1 + length(text) / 100.0), 6) AS rank FROM k WHERE list_contains(c, 'and') AND list_contains(c, 'the')")
def keyword_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_order(search.keyword(_searchable(spark, sf_dir), "The and"), True).select("document_uuid", F.round("rank", 6).alias("rank"))


# text quality


def _text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = D.table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("document_uuid"), F.posexplode(F.split("text", "\n", -1)).alias("page_number", "text"))


_PAGES = "p AS (SELECT doc_id AS document_uuid, length(regexp_replace(unnest(string_split(text, chr(10))), '[^\\p{L}\\p{N}]', '', 'g')) AS n FROM documents)"


@query("SELECT doc_id AS document_uuid, CAST(length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS INTEGER) AS meaningful_characters FROM documents")
def meaningful_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_uuid"), T.meaningful(F.col("text")).alias("meaningful_characters"))


@query(f"""WITH {_PAGES}, d AS (SELECT document_uuid, count(*) AS page_count, CAST(sum(n) AS BIGINT) AS meaningful_characters, count(*) FILTER (n < 40) AS pages_requiring_ocr FROM p GROUP BY 1)
SELECT *, meaningful_characters >= 80 AND (page_count - pages_requiring_ocr) / page_count >= 0.5 AS usable,
  CASE WHEN meaningful_characters >= 80 AND (page_count - pages_requiring_ocr) / page_count >= 0.5 THEN 'usable_pdf_text' ELSE 'insufficient_meaningful_text' END AS reason FROM d""")
def text_usability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their lines as pages."""
    return text_quality.usability(_text_pages(spark, sf_dir))


_CANON = "trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id AS document_uuid, sha256({_CANON}) AS canonical_sha256 FROM documents")
def canonical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_uuid"), F.sha2(T.canonical(F.col("text")), 256).alias("canonical_sha256"))


@query(f"WITH c AS (SELECT lang, {_CANON} AS t FROM documents) SELECT lang, count(*) AS copies FROM c WHERE t <> '' GROUP BY lang, t HAVING count(*) > 1")
def fingerprint_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = D.table(spark, sf_dir, "documents").select("lang", T.fingerprint(F.col("text"), KEY).alias("f")).where("f <> ''")
    return marked.groupBy("lang", "f").agg(F.count("*").alias("copies")).where("copies > 1").select("lang", "copies")


def _owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = D.table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("document_uuid"), F.col("lang").alias("patient_uuid"), "text", F.lit("ACTIVE").alias("archive_status"), F.col("doc_id").alias("created_at"), F.sha2("text", 256).alias("sha256"))


@query(f"""WITH c AS (SELECT doc_id, lang, {_CANON} AS t FROM documents), g AS (SELECT lang, t, list(doc_id ORDER BY doc_id) AS ids FROM c WHERE t <> '' GROUP BY ALL HAVING count(*) > 1)
SELECT doc_id AS document_uuid, c.lang AS patient_uuid, CASE WHEN doc_id = ids[1] THEN ids[2] ELSE ids[1] END AS duplicate_of FROM c JOIN g ON c.lang = g.lang AND c.t = g.t""")
def content_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality.content_duplicates(_owned(spark, sf_dir), KEY).select("document_uuid", "patient_uuid", "duplicate_of")


@query("SELECT lang AS patient_uuid, sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY lang, text HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality.exact_duplicates(_owned(spark, sf_dir))


@query("SELECT CASE WHEN lang = 'es' THEN 'MISSING' WHEN doc_id % 5 = 0 THEN 'CORRUPTED' ELSE 'VALID' END AS integrity_status, count(*) AS n FROM documents GROUP BY 1")
def integrity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files, with some contents lost or changed on the other side."""
    docs = D.table(spark, sf_dir, "documents")
    files = docs.select(F.col("doc_id").alias("uuid"), F.length(F.col("text").cast("binary")).alias("size_bytes"), F.sha2("text", 256).alias("sha256"))
    content = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    blobs = docs.where("lang <> 'es'").select(F.col("doc_id").alias("uuid"), F.length(content.cast("binary")).alias("length"), F.sha2(content, 256).alias("content_sha256"))
    return text_quality.integrity_counts(text_quality.integrity(files, blobs))


_CUES = " ".join(f"WHEN regexp_matches(t, '(^|[^a-z])({'|'.join(cues)})([^a-z]|$)') THEN '{kind}'" for kind, cues in T.SUBTYPE_CUES)


@query(f"""WITH d AS (SELECT doc_id AS document_uuid, lower(text) AS t, [trim(x) FOR x IN string_split(text, chr(10)) IF trim(x) <> ''] AS l FROM documents)
SELECT document_uuid, CASE {_CUES} WHEN regexp_matches(t, '(^|\\n)[^|\\n]*(result|value|reference|test)[^|\\n]*\\n') THEN 'LAB_CHEMISTRY'
  WHEN len(l) >= 6 AND len([x FOR x IN l IF length(x) <= 30]) = 0 THEN 'NARRATIVE' ELSE 'UNKNOWN' END AS report_subtype FROM d""")
def report_subtype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_uuid"), T.report_subtype(F.col("text")).alias("report_subtype"))


# dates: orders as texts that say their date


def _dated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    # dealt by key before the texts are made: finding dates is nearly all of the work, and the table may be read by few tasks
    orders = io.by_keys(D.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority"), ["o_orderkey"], TASK_PAGES)
    line = F.concat(F.lit("Report Date: "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("\nDate of Birth: "), F.date_format(F.add_months("o_orderdate", -360), "yyyy-MM-dd"))
    return orders.select(F.col("o_orderkey").alias("document_uuid"), F.lit(1).alias("page_number"), F.lit("PDF_TEXT").alias("source"), line.alias("text"), F.col("o_orderdate").cast("date").alias("expected"), F.col("o_orderpriority").alias("layout"))


_AMB = "day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate)"


@query(f"""SELECT o_orderkey AS document_uuid, CAST(o_orderdate AS DATE) AS detected_date, 'REPORT_DATE' AS candidate_type, {_AMB} AS ambiguous, CASE WHEN {_AMB} THEN 0.83 ELSE 0.98 END AS score FROM orders
UNION ALL SELECT o_orderkey, CAST(o_orderdate - INTERVAL 360 MONTH AS DATE), 'DATE_OF_BIRTH', false, 0.13 FROM orders""", days=('detected_date',))
def date_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dates.detect_dates(_dated_pages(spark, sf_dir), F.lit(TODAY))
    return found.select("document_uuid", "detected_date", "candidate_type", "ambiguous", "score")


@query("SELECT o_orderkey AS document_uuid, CAST(o_orderdate AS DATE) AS detected_date FROM orders", days=('detected_date',))
def date_suggested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dates.choose_suggested(dates.detect_dates(_dated_pages(spark, sf_dir), F.lit(TODAY))).select("document_uuid", "detected_date")


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _dated_pages(spark, sf_dir)
    # read twice, so written: finding the dates is nearly all of the work
    found = io.written(dates.detect_dates(pages, F.lit(TODAY)).select("document_uuid", "page_number", "occurrence_index", "score", "detected_date", "candidate_type"), "dates")
    best = dates.choose_suggested(found).select("document_uuid", F.col("detected_date").alias("suggested_date"), F.col("candidate_type").alias("suggested_type"))
    nested = found.groupBy("document_uuid").agg(F.collect_list(F.struct(F.col("detected_date").alias("day"), F.col("candidate_type").alias("kind"))).alias("candidates"))
    truth = pages.select("document_uuid", F.col("expected").alias("expected_date"), F.lit("REPORT_DATE").alias("expected_type"), "layout")
    return evaluate.evaluate(truth.join(nested, "document_uuid", "left").join(best, "document_uuid", "left"))


@query("SELECT count(*) AS n, 1.0 AS detection_recall, 1.0 AS suggestion_accuracy, 1.0 AS suggestion_precision, 0.0 AS wrong_rate, 0.0 AS no_suggestion_rate, 0.0 AS birth_date_rate, 1.0 AS type_accuracy FROM orders")
def date_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.scorecard(_evaluated(spark, sf_dir)).select("n", *[F.col(c).cast("double").alias(c) for c in ("detection_recall", "suggestion_accuracy", "suggestion_precision", "wrong_rate", "no_suggestion_rate", "birth_date_rate", "type_accuracy")])


@query("SELECT o_orderpriority AS layout, count(*) AS n, 1.0 AS detection_recall, 1.0 AS suggestion_accuracy FROM orders GROUP BY 1")
def date_scorecard_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.scorecard_by(_evaluated(spark, sf_dir), "layout")


# labs: lineitem rows laid out as a grid, read back


PAGE_LINES = 250_000  # of a task that draws and parses pages


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as a table: a header row, then a row a line with name, result, unit and range."""
    lines = D.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_uuid"), F.col("l_quantity").cast("int").alias("q"), F.col("l_partkey").alias("p"), "l_linenumber")
    # pages cost far more than lines weigh, so lines are dealt by their number
    lines = io.by_keys(lines, ["document_uuid"], PAGE_LINES).withColumn("r", F.row_number().over(Window.partitionBy("document_uuid").orderBy("l_linenumber", "p", "q")))
    row = lambda r, *texts: [F.struct(r.alias("r"), F.lit(x).alias("x"), t.alias("text")) for x, t in zip((0.05, 0.35, 0.55, 0.75), texts)]
    q = F.col("q").cast("string")
    body = row(F.col("r"), F.concat(F.lit("Part"), F.translate(F.col("p").cast("string"), "0123456789", "abcdefghij")), q, F.lit("mg/dL"), F.concat(q, F.lit("-"), (F.col("q") + 9).cast("string")))
    head = row(F.lit(0), *map(F.lit, ("Test", "Result", "Unit", "Reference Range")))
    # the first line brings the header along, so spans are where their lines are
    cells = F.when(F.col("r") == 1, F.array(*head, *body)).otherwise(F.array(*body))
    spans = lines.select("document_uuid", F.explode(cells).alias("c")).select("document_uuid", "c.*")
    y = F.col("r") * 0.02 + 0.05
    return spans.select("document_uuid", F.lit(1).alias("page_number"), (F.col("r") * 4 + F.floor(F.col("x") * 4).cast("int")).alias("sequence"), "text", F.lit(0.9).alias("confidence"), F.col("x").alias("x_min"), y.alias("y_min"), (F.col("x") + 0.1).alias("x_max"), (y + 0.01).alias("y_max"))


_GRID_SQL = "g AS (SELECT l_orderkey AS document_uuid, CAST(l_quantity AS INTEGER) AS q, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CAST(l_quantity AS INTEGER)) AS r FROM lineitem)"


@query(f"WITH {_GRID_SQL} SELECT document_uuid, CAST(r - 1 AS INTEGER) AS row_index, 'Part' || translate(CAST(p AS VARCHAR), '0123456789', 'abcdefghij') AS test_name_raw, CAST(q AS DOUBLE) AS result, 'mg/dL' AS unit_normalized, CAST(q AS DOUBLE) AS low, CAST(q + 9 AS DOUBLE) AS high FROM g")
def lab_rows_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem drawn as result tables and parsed again."""
    rows = labs.parse_pages(_spans(spark, sf_dir))
    return rows.select("document_uuid", "row_index", "test_name_raw", F.col("result_numeric").cast("double").alias("result"), T.normalize_unit(F.col("unit_raw")).alias("unit_normalized"), F.col("reference_low").cast("double").alias("low"), F.col("reference_high").cast("double").alias("high"))


@query("SELECT l_orderkey AS document_uuid, count(*) AS result_count, 0.9 AS confidence, 'COMPLETED' AS status FROM lineitem GROUP BY 1")
def lab_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir)
    pages = spans.groupBy("document_uuid", "page_number").agg(F.bool_or(F.col("y_min").isNull()).alias("broken"))
    return labs.page_status(pages, labs.parse_pages(spans)).select("document_uuid", "result_count", F.round("confidence", 6).alias("confidence"), "status")


@query()
def narrative_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents' lines as positioned text."""
    lines = _text_pages(spark, sf_dir).select("document_uuid", F.lit(1).alias("page_number"), F.col("page_number").alias("sequence"), F.col("text"), F.lit(0.9).alias("confidence"), (F.col("page_number") * 0.01).alias("y_min"), (F.col("page_number") * 0.01 + 0.008).alias("y_max"))
    return narrative.sections(lines)


# roll-ups and queues


@query(f"""WITH {D.PAGES}, f AS (SELECT document_uuid, bool_and(processing_status = 'READY') AS r, bool_or(processing_status = 'AWAITING_CONFIRMATION') AS w, bool_and(processing_status = 'FAILED') AS x FROM pages_ GROUP BY 1)
SELECT document_uuid, CASE WHEN r THEN 'DATE_CONFIRMED' WHEN w THEN 'AWAITING_CONFIRMATION' WHEN x THEN 'FAILED' ELSE 'PARTIAL' END AS document_status FROM f""")
def page_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.document_status(D.pages(spark, sf_dir))


@query(f"""WITH {D.PAGES}, f AS (SELECT document_uuid, count(DISTINCT document_date) FILTER (date_verified) AS k, min(document_date) FILTER (date_verified) AS d FROM pages_ GROUP BY 1)
SELECT document_uuid, CASE k WHEN 0 THEN 'KEPT' WHEN 1 THEN 'SET' ELSE 'CLEARED' END AS date_action, CASE WHEN k = 1 THEN d END AS parent_date FROM f""", days=('parent_date',))
def parent_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.document_date(D.pages(spark, sf_dir))


@query(f"WITH {D.DOCS}, {D.PAGES} SELECT p.document_uuid, page_number, patient_uuid FROM pages_ p JOIN docs d USING (document_uuid) WHERE processing_status = 'AWAITING_CONFIRMATION' AND NOT p.date_verified AND archive_status = 'ACTIVE'")
def pending_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.pending_pages(D.documents(spark, sf_dir), D.pages(spark, sf_dir)).select("document_uuid", "page_number", "patient_uuid")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "lineitem").where("l_returnflag <> 'A' AND l_tax < 0.05")
    return rows.select(F.col("l_orderkey").alias("document_uuid"), F.col("l_linenumber").alias("page_number"), F.col("l_partkey").alias("uuid"), F.col("l_shipdate").cast("date").alias("detected_date"), F.lit("REPORT_DATE").alias("candidate_type"), F.col("l_discount").alias("score"), F.lit(True).alias("is_current"))


@query("""WITH p AS (SELECT DISTINCT l_orderkey AS document_uuid, l_linenumber AS page_number FROM lineitem), l AS (SELECT l_orderkey AS document_uuid, l_linenumber AS page_number, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
c AS (SELECT l_orderkey AS document_uuid, l_linenumber AS page_number, count(*) AS n FROM lineitem WHERE l_returnflag <> 'A' AND l_tax < 0.05 GROUP BY ALL)
SELECT p.document_uuid, p.page_number, coalesce(l.n, 0) AS lab_rows, coalesce(c.n, 0) AS date_candidates FROM p LEFT JOIN l USING (document_uuid, page_number) LEFT JOIN c USING (document_uuid, page_number)""")
def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = D.pages(spark, sf_dir)
    return rollup.page_counts(pages.select("document_uuid", "page_number").distinct(), pages.where("processing_status = 'READY'"), _candidates(spark, sf_dir))


@query("""WITH c AS (SELECT l_orderkey AS document_uuid, l_linenumber AS page_number, string_agg(l_partkey, ' ' ORDER BY l_discount DESC, l_partkey, l_shipdate) AS ids FROM lineitem WHERE l_returnflag <> 'A' AND l_tax < 0.05 GROUP BY ALL)
SELECT l_orderkey AS document_uuid, l_linenumber AS page_number, coalesce(ids, '') AS candidates, ids IS NULL AS requires_manual_date FROM lineitem LEFT JOIN c ON l_orderkey = document_uuid AND l_linenumber = page_number WHERE l_returnflag = 'N'""")
def pending_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = D.pages(spark, sf_dir).withColumn("created_at", F.col("document_date"))
    items = rollup.pending_items(pages, _candidates(spark, sf_dir))
    return items.select("document_uuid", "page_number", F.coalesce(F.array_join(F.transform("candidates", lambda c: c["uuid"].cast("string")), " "), F.lit("")).alias("candidates"), "requires_manual_date")


# Neighbouring orders of a customer as versions of one document.
@query(f"""WITH v AS (SELECT o_custkey AS document_uuid, o_orderpriority AS new_value, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS old_value, o_orderkey AS version FROM orders)
SELECT version, 'DOCUMENT_TYPE_CHANGED' AS event_type, old_value, new_value FROM v WHERE old_value <> new_value""")
def metadata_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = D.documents(spark, sf_dir).withColumn("before", F.lag("document_type").over(Window.partitionBy("patient_uuid").orderBy("created_at", "document_uuid"))).where("before IS NOT NULL")
    old = versions.select(F.col("document_uuid").alias("version"), F.col("before").alias("document_type"))
    return rollup.metadata_changes(old, versions.select(F.col("document_uuid").alias("version"), "document_type"), "version").select("version", "event_type", "old_value", "new_value")


@query("""WITH d AS (SELECT *, lag(CAST(o_orderdate AS DATE)) OVER w AS b, lag(o_orderpriority) OVER w AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_orderkey AS decision, CASE WHEN b IS NULL THEN 'CONFIRMED' WHEN b = CAST(o_orderdate AS DATE) AND s = o_orderpriority THEN NULL WHEN b = CAST(o_orderdate AS DATE) THEN 'RECONFIRMED' ELSE 'CORRECTED' END AS action FROM d""")
def decision_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.documents(spark, sf_dir).select("patient_uuid", F.col("document_uuid").alias("decision"), F.col("document_date").alias("decided_date"), F.col("document_type").alias("date_source"))
    return rows.select("decision", rollup.decision_action(["patient_uuid"], ["decision"]).alias("action"))


# audit and events


@query("SELECT user_id AS document_uuid, arg_max(event_type, (ts, event_id)) AS event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS created_at FROM events GROUP BY 1")
def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.latest_event(D.events(spark, sf_dir)).select("document_uuid", "event_type", stamp("created_at"))


@query("SELECT event_id AS uuid, event_type AS action, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at FROM events WHERE user_id = 7")
def audit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_history(D.events(spark, sf_dir), patient=7).select("uuid", "action", stamp("created_at"))


@query("SELECT event_type AS action, user_id AS patient, count(*) AS n FROM events GROUP BY ALL")
def audit_by_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_counts(D.events(spark, sf_dir), "action", "patient")


@query("""SELECT event_id AS uuid, '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',"token":"[REDACTED]","inner":{"password":"[REDACTED]","who":"' || event_type || '"},"list":[{"path":"[REDACTED]"}]}' AS metadata FROM events""")
def redacted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events' JSON with secrets put in, which have to come out again."""
    k, kind = F.get_json_object("metadata", "$.k"), F.col("event_type")
    full = F.concat(F.lit('{"k":'), k, F.lit(',"token":"'), F.col("value").cast("string"), F.lit('","inner":{"password":['), k, F.lit('],"who":"'), kind, F.lit('"},"list":[{"path":{"a":"b\\"c"}}]}'))
    return audit.redacted(D.events(spark, sf_dir).withColumn("metadata", full), "metadata").select("uuid", "metadata")


# series


@query(f"WITH {D.SERIES} SELECT service, metric, ts, value FROM series")
def series_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.dedupe_series(D.points(spark, sf_dir))


@query(f"""WITH {D.SERIES}, c AS (SELECT service, metric, ts, sum(value) OVER (PARTITION BY service, metric ORDER BY ts) AS value FROM series), r AS (SELECT *, ts - lag(ts) OVER w AS dt, value - lag(value) OVER w AS dv FROM c WINDOW w AS (PARTITION BY service, metric ORDER BY ts))
SELECT service, metric, ts, round(greatest(0.0, dv / dt * 1024), 6) AS value FROM r WHERE dt > 0""")
def series_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.sum("value").over(Window.partitionBy("service", "metric").orderBy("ts"))
    return series.to_rate(series.dedupe_series(D.points(spark, sf_dir)).withColumn("value", total)).withColumn("value", F.round("value", 6))


@query(f"WITH {D.SERIES}, w AS (SELECT * FROM series WHERE ts >= {NOW - 7 * DAY}) SELECT service, metric, arg_max(value, ts) AS current, max(value) AS peak FROM w GROUP BY ALL")
def series_current_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.current_peak(series.within(series.dedupe_series(D.points(spark, sf_dir)), F.lit(NOW), 7 * DAY))


@query(f"WITH {D.POINTS} SELECT service, max(ts) AS last_ts, {NOW} - max(ts) > 30 AS stale FROM points GROUP BY 1")
def series_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.stale(D.points(spark, sf_dir), F.lit(NOW))


@query(f"WITH {D.SERIES}, n AS (SELECT *, row_number() OVER (PARTITION BY service, metric ORDER BY ts) AS k FROM series) SELECT service, metric, ts, value FROM n WHERE k <= 100")
def series_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred points of each series: reading is capped."""
    return series.read_series(series.dedupe_series(D.points(spark, sf_dir)), 100)


def _streamed(spark: SparkSession, sf_dir: str, aggregate) -> DataFrame:
    """The events table as a stream, through an aggregate in complete mode, to a table in the shared folder."""
    out = io.scratch(spark, "stream")
    path = f"{sf_dir}/events.parquet"
    static = spark.read.parquet(path)
    stream = spark.readStream.schema(static.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*.parquet")
    streams.run(aggregate(stream), f"{out}/state", lambda df, n: df.write.mode("overwrite").parquet(f"{out}/table"), "complete")
    return spark.read.parquet(f"{out}/table")


@query(f"WITH {D.POINTS} SELECT service, metric, arg_max(value, (ts, arrival)) AS current, max(value) AS peak FROM points GROUP BY ALL")
def stream_current_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    def points(df: DataFrame) -> DataFrame:
        order = F.struct(F.unix_seconds(F.col("ts").cast("timestamp")), "event_id").alias("ts")
        return df.select(F.col("event_type").alias("service"), F.concat(F.lit("m"), F.pmod("user_id", F.lit(10)).cast("string")).alias("metric"), order, "value")

    return _streamed(spark, sf_dir, lambda df: streams.stream_current_peak(points(df)))


@query("SELECT user_id AS document_uuid, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def stream_latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lambda df: df.select(F.col("user_id").alias("document_uuid"), "event_type", F.col("ts").cast("timestamp").alias("created_at"), F.col("event_id").alias("uuid"))
    return _streamed(spark, sf_dir, lambda df: streams.stream_latest_event(rows(df))).select("document_uuid", "event_type")


# identity and relations


@query("""WITH d AS (SELECT c_custkey AS record, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS t FROM customer), s AS (SELECT record, t, unnest(range(1, 10)) AS i FROM d)
SELECT record, CAST(sum((26 + CAST(t[i] AS INTEGER)) * [7, 3, 1][(i - 1) % 3 + 1]) % 10 AS INTEGER) AS digit FROM s GROUP BY record, t""")
def check_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = D.table(spark, sf_dir, "customer")
    return keys.select(F.col("c_custkey").alias("record"), identity.check_digit(F.lpad(F.col("c_custkey").cast("string"), 9, "0")).cast("int").alias("digit"))


@query("SELECT c_custkey AS record, ltrim(lpad(CAST(c_custkey AS VARCHAR), 9, '<'), '<') AS document_number, 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS nationality, CAST('1980-01-01' AS DATE) + CAST(c_custkey % 3000 AS INTEGER) AS date_of_birth, true AS checks_passed FROM customer", days=('date_of_birth',))
def record_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer keys written as two-line records, and read again."""
    number = F.lpad(F.col("c_custkey").cast("string"), 9, "<")
    born = F.date_format(F.date_add(F.lit(date(1980, 1, 1)), F.pmod("c_custkey", F.lit(3000)).cast("int")), "yyMMdd")
    digit = lambda c: identity.check_digit(c).cast("string")
    line1 = F.concat(F.lit("P<XXX"), number, digit(number), F.lit("N"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit("<"), born, digit(born), F.lit("M<<"), born, digit(born), F.lit("<<<<<<<<"))
    df = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record"), F.explode(F.array(F.struct(F.lit(1).alias("line_no"), line1.alias("text")), F.struct(F.lit(2).alias("line_no"), F.rpad(F.lit("DOE<<JANE"), 44, "<").alias("text")))).alias("l")).select("record", "l.*")
    return identity.parse_records(df).select("record", "document_number", "nationality", "date_of_birth", "checks_passed")


@query("SELECT c_custkey AS record, CASE WHEN c_custkey % 3 = 0 THEN 'UNAVAILABLE' WHEN c_custkey % 3 = 1 THEN 'MATCH' ELSE 'MISMATCH' END AS result FROM customer")
def field_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    other = F.when(k == 0, "").when(k == 1, F.concat(F.lit(" "), F.upper("c_name"))).otherwise(F.concat("c_name", F.lit("x")))
    return D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record"), relations.compare(F.col("c_name"), other).alias("result"))


@query("""WITH n AS (SELECT o_orderkey AS record, CAST(o_custkey AS VARCHAR) AS card, CAST(o_orderkey % 500 AS VARCHAR) AS body FROM orders), d AS (SELECT c_custkey AS uuid, CAST(c_custkey AS VARCHAR) AS doc, CAST(c_custkey + 100 AS VARCHAR) AS nat, CAST(c_custkey AS VARCHAR) AS body FROM customer)
SELECT record, uuid FROM n JOIN d ON card = doc UNION SELECT record, uuid FROM n JOIN d ON card = nat UNION SELECT record, uuid FROM n JOIN d ON n.body = d.body""")
def identifier_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record"), F.col("o_custkey").cast("string").alias("card_number"), (F.col("o_orderkey") % 500).cast("string").alias("body_number"))
    key = F.col("c_custkey")
    known = D.table(spark, sf_dir, "customer").select(key.alias("uuid"), key.cast("string").alias("document_number"), (key + 100).cast("string").alias("national_number"), key.cast("string").alias("unique_card_body_number"))
    return relations.identifier_conflicts(new, known)


@query("""WITH e AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), h AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1),
g AS (SELECT o_custkey AS k, count(*) AS n, min(CAST(o_orderdate AS DATE)) AS first FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT c_custkey AS uuid, coalesce(e.n, 0) AS evidence, coalesce(h.n, 0) AS history, coalesce(g.n, 0) AS guardians, CAST(g.first AS VARCHAR) AS first_link FROM customer LEFT JOIN e ON c_custkey = e.k LEFT JOIN h ON c_custkey = h.k LEFT JOIN g ON c_custkey = g.k""")
def claim_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers as claims, verified orders as evidence, the others as identity history, urgent ones as guardian links."""
    claims = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uuid"), F.col("c_custkey").alias("patient_uuid"))
    docs = D.documents(spark, sf_dir)
    evidence = docs.where("date_verified").select(F.col("patient_uuid").alias("claim"), "created_at", F.col("document_type").alias("kind"), F.col("document_uuid").alias("file"))
    history = docs.where("NOT date_verified").select("patient_uuid", "created_at", "document_type", F.lit("PENDING").alias("verification_status"))
    links = docs.where("document_type = '1-URGENT'").select(F.col("patient_uuid").alias("minor_patient"), F.col("created_at").alias("started_at"), F.col("document_uuid").alias("guardian_user"), F.lit("FATHER").alias("relationship"), F.lit("PENDING").alias("verification_status"))
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    first = F.get("guardian_history", F.lit(0))["started_at"].cast("date").cast("string")
    return relations.claim_review(claims, evidence, history, links).select("uuid", size("evidence").alias("evidence"), size("identity_history").alias("history"), size("guardian_history").alias("guardians"), first.alias("first_link"))


# data quality


@query("SELECT 'page_once' AS rule, l_orderkey AS document_uuid, l_linenumber AS page_number, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dq_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.violations(D.pages(spark, sf_dir), "page_once")


@query("SELECT l_orderkey AS document_uuid, l_linenumber AS page_number FROM lineitem WHERE l_discount * 20 - 0.05 > 1 OR l_discount * 20 - 0.05 < 0")
def dq_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_uuid"), F.col("l_linenumber").alias("page_number"), (F.col("l_discount") * 20 - 0.05).alias("score"))
    return quality.violations(rows, "candidate_score").select("document_uuid", "page_number")


@query("""SELECT CASE WHEN n_regionkey <> c.c_custkey % 5 THEN 'region_in_country' ELSE 'city_in_region' END AS rule, c.c_custkey AS uuid
FROM customer c JOIN nation ON c.c_nationkey = n_nationkey LEFT JOIN customer d ON d.c_custkey = c.c_custkey + 1 WHERE n_regionkey <> c.c_custkey % 5 OR d.c_nationkey IS DISTINCT FROM c.c_nationkey""")
def dq_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers as facilities that name a nation as region, a region that may not be the nation's, and the next customer as city."""
    customers = D.table(spark, sf_dir, "customer")
    placed = customers.select(F.col("c_custkey").alias("uuid"), F.col("c_nationkey").alias("region"), (F.col("c_custkey") % 5).cast("int").alias("country"), (F.col("c_custkey") + 1).alias("city"))
    regions = D.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("uuid"), F.col("n_regionkey").cast("int").alias("country"))
    return quality.hierarchy(placed, regions, customers.select(F.col("c_custkey").alias("uuid"), F.col("c_nationkey").alias("region")))


# the other families register themselves
from . import checks, lab_layouts, people, sinks, states, stores  # noqa: E402, F401
