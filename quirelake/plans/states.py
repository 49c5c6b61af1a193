"""Queries over page and document states, texts, planted dates and narratives, with their DuckDB SQL.

orders play documents, lineitem their pages and runs; documents are texts whose lines are pages.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import archive, audit, dates, evaluate, narrative, rollup, search, text_quality
from . import driver_tables as D
from .register import query

TODAY = date(2001, 8, 2)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_orderkey": "document_uuid", "l_linenumber": "page_number"})


# states


_LAB = "CASE l_returnflag WHEN 'R' THEN 'COMPLETED' WHEN 'A' THEN 'FAILED' END"
_RUN_TIME = "(l_shipdate, l_extendedprice)"


def _runs(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    """lineitem rows of one flag as lab runs."""
    rows = _lines(spark, sf_dir).where(F.col("l_returnflag") == flag)
    return rows.select("document_uuid", "page_number", F.col("l_shipdate").cast("timestamp").alias("created_at"), F.col("l_extendedprice").alias("uuid"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("status"), F.col("l_linestatus").alias("error_code"))


@query(f"""SELECT l_orderkey AS document_uuid, l_linenumber AS page_number, CASE WHEN l_returnflag = 'A' THEN 'FAILED' WHEN l_returnflag = 'N' AND l_discount > 0.05 THEN 'EXTRACTING' WHEN l_tax > 0.03 THEN 'READY' ELSE 'AWAITING_CONFIRMATION' END AS next_state FROM lineitem""")
def page_next_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    pages = _lines(spark, sf_dir).select("document_uuid", "page_number", F.when(flag == "R", "COMPLETED").when(flag == "A", "FAILED").alias("lab_status"), (F.col("l_tax") > 0.03).alias("date_verified"), (F.col("l_discount") > 0.05).alias("applicable"))
    return pages.select("document_uuid", "page_number", rollup.finalize_page(F.col("applicable")).alias("next_state"))


_STATE = "CASE o_orderpriority WHEN '1-URGENT' THEN 'DATE_CONFIRMED' WHEN '2-HIGH' THEN 'PARTIAL' WHEN '3-MEDIUM' THEN 'FAILED' WHEN '5-LOW' THEN 'AWAITING_CONFIRMATION' ELSE 'OCR_PROCESSING' END"


def _states():
    p = F.col("o_orderpriority")
    return F.when(p == "1-URGENT", "DATE_CONFIRMED").when(p == "2-HIGH", "PARTIAL").when(p == "3-MEDIUM", "FAILED").when(p == "5-LOW", "AWAITING_CONFIRMATION").otherwise("OCR_PROCESSING")


@query(f"""WITH s AS (SELECT l_orderkey AS document_uuid, any_value(l_linenumber) AS page_number FROM lineitem GROUP BY 1 HAVING count(*) = 1), d AS (SELECT o_orderkey, {_STATE} AS st FROM orders)
SELECT document_uuid, page_number, CASE st WHEN 'DATE_CONFIRMED' THEN 'READY' WHEN 'PARTIAL' THEN 'AWAITING_CONFIRMATION' WHEN 'OCR_PROCESSING' THEN 'QUEUED' ELSE st END AS processing_status FROM s JOIN d ON document_uuid = o_orderkey""")
def single_page_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_uuid"), _states().alias("processing_status"))
    return rollup.mirror_single_page(documents, D.pages(spark, sf_dir)).select("document_uuid", "page_number", "processing_status")


@query(f"""WITH r AS (SELECT l_orderkey AS k, arg_max('S' || l_suppkey, {_RUN_TIME}) AS st FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey AS document_uuid, coalesce(st, CASE WHEN o_orderpriority = '1-URGENT' THEN 'PENDING' ELSE 'NOT_APPLICABLE' END) AS lab_status FROM orders LEFT JOIN r ON o_orderkey = k""")
def document_lab_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_uuid"), F.when(F.col("o_orderpriority") == "1-URGENT", "LABORATORY").otherwise("RADIOLOGY").alias("document_type"))
    return rollup.lab_status(documents, _runs(spark, sf_dir, "R")).select("document_uuid", "lab_status")


@query(f"""WITH p AS (SELECT DISTINCT l_orderkey AS document_uuid, l_linenumber AS page_number FROM lineitem), n AS (SELECT document_uuid, count(*) AS n FROM p GROUP BY 1),
r AS (SELECT l_orderkey AS document_uuid, l_linenumber AS page_number, arg_max('S' || l_suppkey, {_RUN_TIME}) AS st, arg_max(l_linestatus, {_RUN_TIME}) AS er FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
w AS (SELECT l_orderkey AS document_uuid, arg_max('S' || l_suppkey, {_RUN_TIME}) AS whole FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT document_uuid, page_number, coalesce(st, CASE WHEN n = 1 THEN whole END, 'NOT_APPLICABLE') AS lab_status, er AS lab_error FROM p JOIN n USING (document_uuid) LEFT JOIN r USING (document_uuid, page_number) LEFT JOIN w USING (document_uuid)""")
def page_lab_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = D.pages(spark, sf_dir).select("document_uuid", "page_number").distinct()
    found = rollup.page_lab_status(pages, _runs(spark, sf_dir, "R"), _runs(spark, sf_dir, "A"))
    return found.select("document_uuid", "page_number", "lab_status", "lab_error")


@query("SELECT l_orderkey AS document_uuid, l_linenumber AS page_number, CASE WHEN l_quantity > 25 THEN 'LAB' WHEN l_discount > 0 THEN 'NARRATIVE' ELSE 'NONE' END AS kind FROM lineitem")
def content_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("document_uuid", "page_number", rollup.content_kind(F.greatest(F.col("l_quantity") - 25, F.lit(0)), F.col("l_discount")).alias("kind"))


@query("SELECT c_custkey AS record, regexp_replace(CAST(CAST(c_acctbal AS DECIMAL(38, 6)) AS VARCHAR), '\\.?0+$', '') AS plain FROM customer")
def plain_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record"), T.plain_decimal(F.col("c_acctbal")).alias("plain"))


@query("SELECT l_orderkey AS document_uuid, l_linenumber AS page_number, CASE WHEN l_quantity / 50 >= 0.9 THEN 'high' WHEN l_quantity / 50 >= 0.7 THEN 'medium' ELSE 'low' END AS bucket FROM lineitem")
def confidence_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("document_uuid", "page_number", T.confidence_bucket(F.col("l_quantity") / 50).alias("bucket"))


@query(f"WITH {D.DOCS} SELECT document_uuid, document_type AS title, document_date, healthcare_facility AS facility_uuid, CASE WHEN healthcare_facility IS NOT NULL THEN facility_display END AS facility_name FROM docs WHERE archive_status = 'ACTIVE'", days=("document_date",))
def archive_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = archive.with_facility(archive.active(D.documents(spark, sf_dir)), D.facilities(spark, sf_dir)).withColumn("title", F.col("document_type"))
    return archive.archive_card(docs).select("document_uuid", "title", "document_date", F.col("healthcare_facility.uuid").alias("facility_uuid"), F.col("healthcare_facility.name").alias("facility_name"))


@query(f"""WITH {D.DOCS}, {D.PAGES}, a AS (SELECT * FROM docs WHERE archive_status = 'ACTIVE'),
y AS (SELECT patient_uuid, string_agg(y || ':' || n, ' ' ORDER BY y DESC) AS years FROM (SELECT patient_uuid, year(document_date) AS y, count(*) AS n FROM a WHERE date_verified GROUP BY ALL) GROUP BY 1),
t AS (SELECT patient_uuid, string_agg(document_type || ':' || n, ' ' ORDER BY n DESC, document_type) AS types FROM (SELECT patient_uuid, document_type, count(*) AS n FROM a GROUP BY ALL) GROUP BY 1),
u AS (SELECT patient_uuid, count(*) AS n FROM pages_ p JOIN a USING (document_uuid) WHERE processing_status = 'AWAITING_CONFIRMATION' AND NOT p.date_verified GROUP BY 1)
SELECT t.patient_uuid, coalesce(years, '') AS years, types, coalesce(u.n, 0) AS unconfirmed_count FROM t LEFT JOIN y USING (patient_uuid) LEFT JOIN u USING (patient_uuid)""")
def archive_summary_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each patient."""
    whole = archive.summary(D.documents(spark, sf_dir), D.pages(spark, sf_dir))
    joined = lambda c, f: F.array_join(F.transform(c, f), " ")
    years = joined("years", lambda y: F.concat_ws(":", y["year"].cast("string"), y["n"].cast("string")))
    types = joined("types", lambda t: F.concat_ws(":", t["document_type"], F.negative(t["minus_n"]).cast("string")))
    return whole.select("patient_uuid", years.alias("years"), types.alias("types"), "unconfirmed_count")


@query(f"WITH {D.DOCS}, a AS (SELECT * FROM docs WHERE archive_status = 'ACTIVE' AND NOT date_verified) SELECT document_uuid, (SELECT count(*) FROM a) AS total FROM a ORDER BY created_at DESC, document_uuid DESC LIMIT 20 OFFSET 40")
def unconfirmed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of twenty of what waits, newest first, with the number of all."""
    rows, total = archive.page(archive.unconfirmed_order(archive.active(D.documents(spark, sf_dir)).where("NOT date_verified")), 3)
    return rows.select("document_uuid", F.lit(total).cast("long").alias("total"))


@query("SELECT l_partkey AS document_uuid, l_linenumber AS page_number, l_extendedprice AS occurrence_index FROM lineitem ORDER BY l_discount DESC, l_linenumber, l_extendedprice, l_partkey LIMIT 50")
def ranked_candidates_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("document_uuid"), F.col("l_linenumber").alias("page_number"), F.col("l_extendedprice").alias("occurrence_index"), F.col("l_discount").alias("score"))
    return dates.rank_candidates(rows).limit(50).select("document_uuid", "page_number", "occurrence_index")


_VALID = "CASE WHEN o_totalprice > 400000 THEN 'CORRUPTED' WHEN o_totalprice > 300000 THEN 'MISSING' WHEN o_totalprice > 290000 THEN 'QUARANTINED' ELSE 'VALID' END"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    status = F.when(price > 400000, "CORRUPTED").when(price > 300000, "MISSING").when(price > 290000, "QUARANTINED").otherwise("VALID")
    scan = F.when(F.col("o_orderpriority") == "1-URGENT", "INFECTED").when(F.col("o_orderpriority") == "2-HIGH", "ERROR").otherwise("CLEAN")
    return D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_uuid"), status.alias("integrity_status"), scan.alias("scan_status"))


@query(f"SELECT o_orderkey AS document_uuid FROM orders WHERE o_orderstatus <> 'P' AND ({_VALID}) = 'VALID' AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def extractable_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.extractable(D.documents(spark, sf_dir), _files(spark, sf_dir)).select("document_uuid")


@query(f"SELECT o_orderkey AS document_uuid, {_VALID} AS integrity_status, o_orderpriority AS document_type FROM orders WHERE ({_VALID}) NOT IN ('CORRUPTED', 'QUARANTINED', 'MISSING')")
def downloadable_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their file, where it can be had."""
    return rollup.with_file(D.documents(spark, sf_dir), rollup.available_files(_files(spark, sf_dir))).select("document_uuid", "integrity_status", "document_type")


@query("""SELECT o_orderkey AS document_uuid FROM orders WHERE CASE o_orderpriority WHEN '1-URGENT' THEN o_orderstatus = 'P' OR o_orderdate <= TIMESTAMP '2001-08-02' - INTERVAL 30 DAY
WHEN '2-HIGH' THEN o_orderstatus = 'P' OR o_orderdate <= TIMESTAMP '2001-08-02' - INTERVAL 400 DAY ELSE false END""")
def stuck_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as work; partial ones began at no known time."""
    work = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_uuid"), F.col("o_orderpriority").alias("processing_status"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("timestamp")).alias("started_at"))
    return rollup.stale_work(work, F.lit(TODAY), {"1-URGENT": 30 * 86_400, "2-HIGH": 400 * 86_400}).select("document_uuid")


@query("""SELECT o_orderkey AS session FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND (o_orderdate < TIMESTAMP '2001-08-02' - INTERVAL 700 DAY OR (o_orderstatus = 'F' AND o_orderdate + INTERVAL 365 DAY <= TIMESTAMP '2001-08-02'))""")
def expired_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, priority = F.col("o_orderdate").cast("timestamp"), F.col("o_orderpriority")
    status = F.when(priority == "1-URGENT", "PENDING").when(priority == "2-HIGH", "PROCESSING").otherwise("DONE")
    jobs = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session"), status.alias("status"), at.alias("updated_at"), F.when(F.col("o_orderstatus") == "F", at + F.expr("INTERVAL 365 DAYS")).alias("expires_at"))
    return rollup.expired_jobs(jobs, F.lit(TODAY), 700 * 86_400).select("session")


@query("SELECT o_orderkey AS document_uuid FROM orders WHERE o_orderstatus = 'O'")
def queue_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.by_status(D.table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "document_uuid"), "O", "o_orderstatus").select("document_uuid")


@query("SELECT o_orderkey AS document_uuid FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority = '5-LOW' AND o_orderstatus <> 'F'")
def pending_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("document_type") == "5-LOW", "AWAITING_CONFIRMATION").otherwise("READY")
    return rollup.pending_documents(D.documents(spark, sf_dir).withColumn("processing_status", state)).select("document_uuid")


# texts


@query(f"WITH {D.DOCS} SELECT document_uuid, sha256(text) AS text_sha256 FROM docs LEFT JOIN documents ON document_uuid = doc_id WHERE archive_status = 'ACTIVE'")
def documents_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with the text of the same number, if there is one."""
    texts = D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_uuid"), "text")
    return search.with_text(archive.active(D.documents(spark, sf_dir)), texts).select("document_uuid", F.sha2("text", 256).alias("text_sha256"))


def _text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = D.table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("document_uuid"), F.posexplode(F.split("text", "\n", -1)).alias("page_number", "text"))


_N = "length(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g'))"
_TEXT_PAGES = f"p AS (SELECT document_uuid, page_number, t, {_N} AS n FROM (SELECT doc_id AS document_uuid, unnest(range(len(string_split(text, chr(10))))) AS page_number, unnest(string_split(text, chr(10))) AS t FROM documents))"


@query(f"WITH {_TEXT_PAGES} SELECT document_uuid, CAST(page_number AS INTEGER) AS page_number FROM p WHERE n < 40")
def ocr_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality.pages_requiring_ocr(_text_pages(spark, sf_dir)).select("document_uuid", "page_number")


@query(f"""WITH {_TEXT_PAGES} SELECT document_uuid, sha256(string_agg(t, chr(10) || chr(12) || chr(10) ORDER BY page_number)) AS text_sha256, CAST(sum(n) AS BIGINT) AS meaningful_characters, bool_or(n < 40) AS has_pages_requiring_ocr,
  CAST(sum(length(t)) + 3 * (count(*) - 1) AS INTEGER) AS character_count, CASE WHEN bool_or(n < 40) AND bool_or(n >= 40) THEN 'HYBRID' WHEN bool_or(n < 40) THEN 'OCR' ELSE 'PDF_TEXT' END AS extraction_method FROM p GROUP BY 1""")
def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents put together from their lines; short lines are read by OCR."""
    pages = _text_pages(spark, sf_dir).withColumn("requires_ocr", T.meaningful(F.col("text")) < 40)
    whole = text_quality.document_text(pages.withColumn("effective_source", F.when(F.col("requires_ocr"), "OCR").otherwise("PDF_TEXT")))
    return whole.withColumn("text_sha256", F.sha2("text", 256)).drop("text")


@query("SELECT l_orderkey AS document_uuid, l_linenumber AS page_number, round(avg(l_discount), 9) AS mean_confidence, min(l_discount) AS min_confidence FROM lineitem GROUP BY ALL")
def page_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("confidence", F.col("l_discount"))
    return text_quality.page_confidence(rows).withColumn("mean_confidence", F.round("mean_confidence", 9))


@query("""WITH u AS (SELECT doc_id, length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS n, lang FROM documents)
SELECT doc_id AS document_uuid, CASE WHEN n >= 200 THEN 'TEXT_EXTRACTED' ELSE 'OCR_REQUIRED' END AS text_outcome, CASE WHEN n = 0 THEN 'UPLOADED' WHEN lang = 'en' AND n < 200 THEN 'OCR_REQUIRED' ELSE 'TEXT_EXTRACTED' END AS ocr_outcome FROM u""")
def text_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.meaningful(F.col("text"))
    return D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_uuid"), T.text_outcome(n >= 200).alias("text_outcome"), T.ocr_outcome(n > 0, F.col("lang") == "en", n >= 200).alias("ocr_outcome"))


def _listed(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_TESTS, _UNITS = list(T.TEST_ALIASES.items()), list(T.UNIT_ALIASES.items())


@query(f"SELECT p_partkey AS record, CASE WHEN p_size > 45 THEN '' ELSE {_listed(v for _, v in _TESTS)}[p_partkey % {len(_TESTS)} + 1] END AS test, {_listed(v for _, v in _UNITS)}[p_partkey % {len(_UNITS)} + 1] AS unit FROM part")
def lab_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test names and units as they are printed: capitals, marks, blanks; some tests aren't known."""
    key, pick = F.col("p_partkey"), lambda rows: F.get(F.array(*[F.lit(k) for k, _ in rows]), (F.col("p_partkey") % len(rows)).cast("int"))
    test = F.concat(F.lit(" S. "), F.upper(F.replace(pick(_TESTS), F.lit(" "), F.lit(" - "))), F.when(F.col("p_size") > 45, " X").otherwise("**"))
    unit = F.concat(F.lit(" "), F.upper(pick(_UNITS)))
    rows = D.table(spark, sf_dir, "part").select(key.alias("record"), test.alias("test"), F.when(F.lower(unit) == F.concat(F.lit(" "), pick(_UNITS)), unit).otherwise(pick(_UNITS)).alias("unit"))
    return rows.select("record", T.normalize_test(F.col("test")).alias("test"), T.normalize_unit(F.col("unit")).alias("unit"))


#: Names in several scripts, and their full case foldings behind compatibility normalisation.
_SCRIPT_NAMES = ("\u0130STANBUL Il\u0131ca", "ΟΔΟΣ Σοφίας", "Straße STRA\u1e9eE", "Եր\u0587ան", "\u1fbc \u0390 \u01f0", "\u017ftadt \u212a \u212b", "\uab70 \u13a0", "ПЕТР Ё")
_SCRIPT_FOLDED = ("i\u0307stanbul il\u0131ca", "οδοσ σοφίασ", "strasse strasse", "երեւան", "αι \u03b9\u0308\u0301 j\u030c", "stadt k \u00e5", "\u13a0 \u13a0", "петр ё")


@query(f"SELECT doc_id AS record, {list(_SCRIPT_FOLDED)}[doc_id % 8 + 1] || ' ' || lang AS name, md5(replace(lower(text), 'ß', 'ss')) AS folded FROM documents")
def folded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turkish, Greek, German, Armenian, Cherokee and other names of documents, and their whole texts, case folded."""
    name = F.get(F.array(*map(F.lit, _SCRIPT_NAMES)), F.pmod("doc_id", F.lit(8)).cast("int"))
    full = F.concat(F.lit("\u3000"), name, F.lit("\t \u00a0"), F.upper("lang"))
    return D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record"), T.normalize_name(full).alias("name"), F.md5(T.casefold(F.col("text")).cast("binary")).alias("folded"))


@query("""SELECT c_custkey AS record, 'strasse ' || lower(c_name) AS name, 'scan ' || c_custkey || '.pdf' AS file, 'اسم ' || c_custkey AS label, CASE WHEN c_acctbal < 0 THEN '01158' || c_custkey ELSE 'OIlSBx' || c_custkey END AS digits,
  sha256('{"a":' || c_custkey || ',"b":"' || c_mktsegment || '"}') AS request FROM customer""")
def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, file names, Arabic labels, misread digits and request hashes."""
    key = F.col("c_custkey").cast("string")
    return D.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("record"), T.normalize_name(F.concat(F.lit(" Stra\u00dfe\u00a0\uff23"), F.substring("c_name", 2, 100), F.lit(" "))).alias("name"),
        T.sanitize_name(F.concat(F.lit("C:\\dir/. scan "), key, F.lit("\u0007.pdf. "))).alias("file"), T.fold_ar(F.concat(F.lit("أس\u0640م\u200f "), key)).alias("label"),
        T.repair_digits(F.concat(F.when(F.col("c_acctbal") < 0, "OIlSB").otherwise("OIlSBx"), key)).alias("digits"), T.request_hash(F.col("c_custkey").alias("a"), F.col("c_mktsegment").alias("b")).alias("request"),
    )


@query("""SELECT event_id AS uuid, '{"a":{"b":[{"c":[[{"token":"[REDACTED]","k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}]]}]},"to\\u006ben":"[REDACTED]","kept":"\\"token\\": ' || event_type || '","secret":"[REDACTED]"}' AS metadata FROM events""")
def redacted_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events' JSON with secrets at depth five and more, behind escaped keys, in arrays of arrays."""
    k, value = F.get_json_object("metadata", "$.k"), F.col("value").cast("string")
    full = F.concat(
        F.lit('{"a":{"b":[{"c":[[{"token":{"a":{"b":{"c":["'), value, F.lit('",{"d":"}"}]}}},"k":'), k, F.lit('}]]}]},"to\\u006ben":"'), value,
        F.lit('","kept":"\\"token\\": '), F.col("event_type"), F.lit('","secret":["\\\\",{"x":['), value, F.lit("]}]}"),
    )
    return audit.redacted(D.events(spark, sf_dir).withColumn("metadata", full), "metadata").select("uuid", "metadata")


# dates in planted forms


_FORMS = (
    # label and form, type, rule, score, needs a day over 12 to be without doubt
    ("Result Date: {d}.{m}.{y}", "RESULT_DATE", "DMY_NUMERIC", 0.95, True),
    ("Issued: {y}-{m}-{d}", "ISSUE_DATE", "YMD_NUMERIC", 0.92, False),
    ("Collected {d} {month} {y}", "COLLECTION_DATE", "DMY_NAMED_MONTH", 0.78, False),
    ("Sample date {month} {d}, {y}", "SAMPLE_DATE", "MDY_NAMED_MONTH", 0.76, False),
    ("تاريخ الفحص: {ay}/{am}/{ad}", "EXAMINATION_DATE", "YMD_NUMERIC", 0.90, False),
    ("Admission date\n\n{y}/{m}/{d}", "ADMISSION_DATE", "YMD_NUMERIC", 0.63, False),
    ("{y}-{m}-{d} seen", "UNKNOWN", "YMD_NUMERIC", 0.20, False),
    ("Date: {y}-{m}-{d}", "REPORT_DATE", "YMD_NUMERIC", 0.83, False),
    ("Print date: {d}/{m}/{y}", "PRINT_DATE", "DMY_NUMERIC", 0.38, True),
)


def _form(text: str):
    """A form with the order's date in it."""
    day = lambda f: F.date_format("o_orderdate", f)
    arabic = lambda f: F.translate(day(f), "0123456789", "٠١٢٣٤٥٦٧٨٩")
    parts = {"d": day("dd"), "m": day("MM"), "y": day("yyyy"), "month": day("MMMM"), "ad": arabic("dd"), "am": arabic("MM"), "ay": arabic("yyyy")}
    pieces, rest = [], text
    while "{" in rest:
        before, _, after = rest.partition("{")
        name, _, rest = after.partition("}")
        pieces += [F.lit(before), parts[name]]
    return F.concat(*pieces, F.lit(rest))


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.array(*[_form(f[0]) for f in _FORMS])
    return D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_uuid"), (F.col("o_orderkey") % len(_FORMS)).cast("int").alias("page_number"), F.lit("OCR").alias("source"), F.get(texts, (F.col("o_orderkey") % len(_FORMS)).cast("int")).alias("text"))


_DOUBT = "day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate)"


@query(f"""SELECT o_orderkey AS document_uuid, CAST(o_orderdate AS DATE) AS detected_date, {_listed(f[1] for f in _FORMS)}[o_orderkey % {len(_FORMS)} + 1] AS candidate_type, {_listed(f[2] for f in _FORMS)}[o_orderkey % {len(_FORMS)} + 1] AS parsing_rule,
  round({[f[3] for f in _FORMS]}[o_orderkey % {len(_FORMS)} + 1] - CASE WHEN {[f[4] for f in _FORMS]}[o_orderkey % {len(_FORMS)} + 1] AND {_DOUBT} THEN 0.15 ELSE 0 END, 4) AS score FROM orders""", days=("detected_date",))
def date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named months, Arabic labels and digits, labels on a line before, without a label, and generic ones."""
    return dates.detect_dates(_planted(spark, sf_dir), F.lit(TODAY)).select("document_uuid", "detected_date", "candidate_type", "parsing_rule", "score")


@query("""SELECT o_orderkey AS document_uuid, strftime(o_orderdate, '%Y%m%d') AS normalized_value, CAST(o_orderdate AS DATE) AS detected_date, 0.88 AS score FROM orders WHERE o_orderpriority = '1-URGENT'""", days=("detected_date",))
def date_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight digits are a date after a label of its own, not after a birth label, an identifier or none."""
    label = F.create_map(*map(F.lit, ("1-URGENT", "Report date: ", "2-HIGH", "Date of birth: ", "3-MEDIUM", "Report date, serial number ", "4-NOT SPECIFIED", "", "5-LOW", "Barcode ")))
    text = F.concat(F.element_at(label, F.col("o_orderpriority")), F.date_format("o_orderdate", "yyyyMMdd"))
    pages = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_uuid"), F.lit(1).alias("page_number"), F.lit("OCR").alias("source"), text.alias("text"))
    return dates.detect_dates(pages, F.lit(TODAY)).select("document_uuid", "normalized_value", "detected_date", "score")


@query("""SELECT o_orderkey AS document_uuid, translate(strftime(o_orderdate, '%Y/%m/%d'), '0123456789', '٠١٢٣٤٥٦٧٨٩') AS raw_value, strftime(o_orderdate, '%Y/%m/%d') AS normalized_value,
  'ref ' || o_custkey || ' Issued: ' || strftime(o_orderdate, '%Y/%m/%d') || ' end' AS context FROM orders""")
def date_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw slice that a date comes from, and its line, behind decomposed letters, ligatures, fractions and control characters."""
    arabic = F.translate(F.date_format("o_orderdate", "yyyy/MM/dd"), "0123456789", "٠١٢٣٤٥٦٧٨٩")
    text = F.concat(F.lit("ﬁrst cafe\u0301 \u1e9b\u0323 ½ \x1f\x07 line\u200f\x1c\nref  "), F.col("o_custkey").cast("string"), F.lit("\tIssued: "), arabic, F.lit("  end\nlast"))
    pages = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_uuid"), F.lit(1).alias("page_number"), F.lit("OCR").alias("source"), text.alias("text"))
    return dates.detect_dates(pages, F.lit(TODAY), keep_raw=True).select("document_uuid", "raw_value", "normalized_value", "context")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as items with planted errors: candidates by priority, suggestions missing, wrong or of a birth date by status and price."""
    day, p = F.col("o_orderdate").cast("date"), F.col("o_orderpriority")
    born, wrong = F.date_sub(day, 9000), F.date_add(day, 1)
    one = lambda d, k: F.struct(d.alias("day"), F.lit(k).alias("kind"))
    candidates = F.when(p == "1-URGENT", F.array(one(day, "REPORT_DATE"), one(born, "DATE_OF_BIRTH"))).when(p == "2-HIGH", F.array(one(day, "PRINT_DATE"))).when(p == "3-MEDIUM", F.array(one(wrong, "REPORT_DATE")))
    suggested = F.when(p == "1-URGENT", F.when(F.col("o_totalprice") > 400000, born).otherwise(day)).when(p == "2-HIGH", day).when(p == "3-MEDIUM", wrong)
    kind = F.when((p == "1-URGENT") & (F.col("o_totalprice") > 400000), "DATE_OF_BIRTH").when(suggested.isNotNull(), "REPORT_DATE")
    return evaluate.evaluate(D.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pair"), F.col("o_orderstatus").alias("source"), F.when(F.col("o_orderstatus") != "P", day).alias("expected_date"), F.lit("REPORT_DATE").alias("expected_type"), candidates.alias("candidates"), suggested.alias("suggested_date"), kind.alias("suggested_type")))


_JUDGED = """j AS (SELECT o_custkey AS pair, o_orderstatus AS source, o_orderpriority IN ('1-URGENT', '2-HIGH') AS det, o_orderpriority = '2-HIGH' OR (o_orderpriority = '1-URGENT' AND o_totalprice <= 400000) AS cor,
  o_orderpriority = '3-MEDIUM' OR (o_orderpriority = '1-URGENT' AND o_totalprice > 400000) AS wro, o_orderpriority > '4' AS nos, o_orderpriority = '1-URGENT' AND o_totalprice > 400000 AS bir, o_orderpriority AS p,
  CASE WHEN o_orderpriority > '4' THEN NULL WHEN o_orderpriority = '3-MEDIUM' THEN CAST(o_orderdate AS DATE) + 1 WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 400000 THEN CAST(o_orderdate AS DATE) - 9000 ELSE CAST(o_orderdate AS DATE) END AS s FROM orders)"""


@query(f"""WITH {_JUDGED}, k AS (SELECT * FROM j WHERE source <> 'P') SELECT count(*) AS n, round(avg(det::INT), 9) AS detection_recall, round(avg(cor::INT), 9) AS suggestion_accuracy, round(sum(cor::INT) / sum((NOT nos)::INT), 9) AS suggestion_precision,
  round(avg(wro::INT), 9) AS wrong_rate, round(avg(nos::INT), 9) AS no_suggestion_rate, round(avg(bir::INT), 9) AS birth_date_rate, round(sum((p = '1-URGENT')::INT) / sum(det::INT), 9) AS type_accuracy FROM k""")
def scorecard_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = evaluate.scorecard(_judged(spark, sf_dir))
    return card.select("n", *[F.round(c, 9).alias(c) for c in card.columns if c != "n"])


@query(f"WITH {_JUDGED} SELECT source, count(*) AS n, round(avg(det::INT), 4) AS detection_recall, round(avg(cor::INT), 4) AS suggestion_accuracy FROM j WHERE source <> 'P' GROUP BY 1")
def scorecard_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.paired_scorecard(_judged(spark, sf_dir), "source")


@query(f"WITH {_JUDGED}, g AS (SELECT pair, count(DISTINCT coalesce(CAST(s AS VARCHAR), '')) AS d FROM j GROUP BY 1 HAVING count(*) > 1) SELECT round(avg((d = 1)::INT), 9) AS pair_consistency FROM g")
def scorecard_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.pair_consistency(_judged(spark, sf_dir), "pair").select(F.round("pair_consistency", 9).alias("pair_consistency"))


# narratives


@query("""SELECT c_custkey AS document_uuid, heading, body, CAST(n AS INTEGER) AS sequence FROM (
  SELECT c_custkey, 'Findings' AS heading, 'The liver of record ' || c_custkey || ' has a normal size and shape today' || chr(10) || 'no focal lesion is seen in any of the lobes here.' AS body, 2 AS n FROM customer
  UNION ALL SELECT c_custkey, 'Impression', 'Nothing remarkable, of segment ' || c_mktsegment || ', was found in this study.', 5 FROM customer WHERE c_acctbal >= 0)""")
def narrative_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings with text under them, among noise, badly read lines, a head set apart, and headings without text."""
    line = lambda n, text, y, confidence=0.9: F.struct(F.lit(n).alias("sequence"), (F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit(y).alias("y_min"), F.lit(y + 0.01).alias("y_max"), F.lit(confidence).alias("confidence"))
    key = F.col("c_custkey").cast("string")
    last = F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("Nothing remarkable, of segment "), F.col("c_mktsegment"), F.lit(", was found in this study.")))
    lines = F.array(
        line(0, "A head that stands far above all of the rest of it.", 0.01), line(1, "12", 0.2), line(2, "Findings", 0.21), line(3, F.concat(F.lit("The liver of record "), key, F.lit(" has a normal size and shape today")), 0.22),
        line(4, "no focal lesion is seen in any of the lobes here.", 0.235), line(5, "Impression", 0.25), line(6, last, 0.265), line(7, "Lines that can hardly be read don't count at all.", 0.28, 0.3), line(8, "Tel. 12345", 0.29), line(9, "Signed", 0.295),
    )
    spans = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_uuid"), F.lit(1).alias("page_number"), F.explode(lines).alias("l")).select("document_uuid", "page_number", "l.*").where("text IS NOT NULL")
    return narrative.sections(spans).select("document_uuid", "heading", "body", "sequence")
