"""Data-quality rules as queries, with their DuckDB SQL: every rule over one of the driver's tables in the shape that it checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality
from . import driver_tables as D
from .people import links, papers
from .register import query


def _counts(tables: dict[str, DataFrame]) -> DataFrame:
    """How many rows or keys break each rule."""
    each = [quality.violations(df, rule).agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n") for rule, df in tables.items()]
    return reduce(DataFrame.unionByName, each)


def _broken(rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{rule}' AS rule, count(*) AS n FROM ({sql})" for rule, sql in rules.items())


def _twice(table: str, keys: str, where: str = "true", limit: int = 1) -> str:
    return f"SELECT {keys} FROM {table} WHERE {where} GROUP BY ALL HAVING count(*) > {limit}"


@query(_broken({
    "document_bytes_once": _twice("orders", "o_custkey, CAST(floor(o_totalprice / 50000) AS BIGINT)", "o_orderstatus <> 'P'"), "page_once": _twice("lineitem", "l_orderkey, l_linenumber"), "page_from_one": "SELECT 1 FROM lineitem WHERE l_linenumber - 2 < 1",
    "span_once": _twice("lineitem", "l_orderkey, l_linenumber, l_quantity"), "span_box": "SELECT 1 FROM lineitem WHERE l_discount * 10 > l_quantity / 50 OR l_tax * 15 > 1 OR l_suppkey < 3",
    "candidate_once": _twice("lineitem", "l_orderkey, l_linenumber, l_quantity, l_linestatus", "l_returnflag = 'N'"), "suggestion_per_document": _twice("lineitem", "l_orderkey", "l_returnflag = 'N' AND l_discount > 0.05"),
    "suggestion_per_page": _twice("lineitem", "l_orderkey, l_linenumber", "l_returnflag = 'N' AND l_discount > 0.05"), "candidate_score": "SELECT 1 FROM lineitem WHERE l_discount * 12 > 1",
    "extraction_once": _twice("lineitem", "l_orderkey, l_linenumber, l_linestatus"), "extraction_confidence": "SELECT 1 FROM lineitem WHERE l_discount * 12 > 1", "lab_row": "SELECT 1 FROM lineitem WHERE l_linenumber - 2 < 1 OR l_suppkey < 3 OR l_discount * 12 > 1",
    "candidates_per_document": _twice("lineitem", "l_suppkey", "l_returnflag = 'N'", 500), "pages_per_document": _twice("lineitem", "l_suppkey", "true", 250),
    "page_text_size": "SELECT 1 FROM documents WHERE length(text) * 20 > 100000", "document_text_size": "SELECT 1 FROM documents WHERE length(text) * 20 > 2000000",
}))
def dq_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on documents, pages, spans, candidates, extractions and sizes."""
    orders = D.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("patient_uuid"), F.floor(F.col("o_totalprice") / 50000).alias("sha256"), F.when(F.col("o_orderstatus") == "P", "DELETED").otherwise("ACTIVE").alias("archive_status"))
    flag = F.col("l_returnflag") == "N"
    lines = D.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document_uuid"), F.col("l_linenumber").alias("page_number"), F.col("l_quantity").alias("sequence"), F.col("l_quantity").alias("occurrence_index"), F.col("l_linestatus").alias("pipeline_version"), flag.alias("is_current"),
        (F.col("l_discount") > 0.05).alias("is_suggested"), (F.col("l_discount") * 12).alias("score"), (F.col("l_discount") * 12).alias("extraction_confidence"), (F.col("l_discount") * 12).alias("confidence"), F.col("l_suppkey"),
        (F.col("l_discount") * 10).alias("x_min"), (F.col("l_quantity") / 50).alias("x_max"), (F.col("l_tax") * 0).alias("y_min"), (F.col("l_tax") * 15).alias("y_max"), (F.col("l_suppkey") - 3).alias("row_index"),
    )
    shifted = lines.withColumn("page_number", F.col("page_number") - 2)
    long = D.table(spark, sf_dir, "documents").select(F.repeat("text", 20).alias("text"))
    by_supplier = lines.withColumn("document_uuid", F.col("l_suppkey"))
    return _counts({
        "document_bytes_once": orders, "page_once": lines, "page_from_one": shifted, "span_once": lines, "span_box": lines.withColumn("sequence", F.col("row_index")), "candidate_once": lines, "suggestion_per_document": lines, "suggestion_per_page": lines,
        "candidate_score": lines, "extraction_once": lines, "extraction_confidence": lines, "lab_row": shifted, "candidates_per_document": by_supplier, "pages_per_document": by_supplier, "page_text_size": long, "document_text_size": long,
    })


_PLACE = "CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END"


@query(_broken({
    "facility_region": "SELECT 1 FROM customer WHERE c_acctbal > 9000", "facility_once": _twice(f"(SELECT c_nationkey, {_PLACE} AS city, CAST(floor(c_acctbal / 100) AS BIGINT) AS n FROM customer)", "c_nationkey, city, n"),
    "region_once": _twice("nation", "n_regionkey, n_regionkey"), "city_once": _twice("customer", "c_nationkey, c_mktsegment"), "alias_once": _twice("supplier", "s_nationkey, CAST(floor(s_acctbal / 1000) AS BIGINT)"),
}))
def dq_facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on facilities and the reference tables of places."""
    balance = F.col("c_acctbal")
    places = D.table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("country"), F.when(balance >= 0, F.col("c_mktsegment")).alias("city"), F.floor(balance / 100).alias("normalized_name"), F.when(balance <= 9000, F.col("c_nationkey")).alias("region"),
    )
    regions = D.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("country"), F.col("n_regionkey").alias("normalized_name"))
    cities = D.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("region"), F.col("c_mktsegment").alias("normalized_name"))
    aliases = D.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("facility"), F.floor(F.col("s_acctbal") / 1000).alias("normalized_name"))
    return _counts({"facility_region": places, "facility_once": places, "region_once": regions, "city_once": cities, "alias_once": aliases})


_EMAIL = "lower(CASE WHEN c_acctbal > 5000 THEN upper(c_mktsegment) ELSE c_mktsegment END || CAST(floor(c_acctbal) AS BIGINT))"


@query(_broken({
    "identity_once": _twice("(SELECT o_custkey, CASE WHEN o_orderpriority < '3' THEN 1 WHEN o_orderpriority < '4' THEN 2 ELSE 3 END AS k, o_orderstatus FROM orders)", "o_custkey, k", "o_orderstatus = 'F'"),
    "identity_dates": "SELECT 1 FROM orders WHERE CAST(floor(o_totalprice) AS BIGINT) % 400 - 100 <= 0", "guardian_once": _twice("(SELECT o_custkey, CAST(floor(o_totalprice) AS BIGINT) % 2000 AS m, CASE WHEN o_orderpriority > '4' THEN 'O' ELSE o_orderpriority END AS r, o_orderstatus, o_orderpriority FROM orders)", "o_custkey, m, r", "o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'"),
    "guardian_verified": "SELECT 1 FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F'", "claim_per_patient": _twice("orders", "o_custkey", "o_orderstatus = 'O'"),
    "claim_per_email": _twice("orders", "CAST(floor(o_totalprice / 10) AS BIGINT)", "o_orderstatus = 'O'"), "email_once": _twice(f"(SELECT {_EMAIL} AS e FROM customer)", "e"),
    "country_code": "SELECT 1 FROM customer WHERE c_nationkey < 10", "born_before_today": "SELECT 1 FROM customer WHERE c_acctbal > 9000", "owner_adult": "SELECT 1 FROM customer WHERE c_acctbal > 5000 AND c_mktsegment <> 'MACHINERY'",
}))
def dq_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on identity documents, guardians, claims, accounts and patients."""
    orders, balance = D.table(spark, sf_dir, "orders"), F.col("c_acctbal")
    docs = papers(spark, sf_dir)
    dated = orders.select(F.col("o_orderdate").cast("date").alias("issue_date"), F.date_add(F.col("o_orderdate").cast("date"), (F.floor("o_totalprice") % 400 - 100).cast("int")).alias("expiry_date"))
    claimed = orders.select(F.col("o_custkey").alias("patient_uuid"), F.concat(F.when(F.col("o_custkey") % 2 == 0, "A").otherwise("a"), F.floor(F.col("o_totalprice") / 10).cast("string")).alias("requested_email"), F.when(F.col("o_orderstatus") == "O", "PENDING").otherwise("REJECTED").alias("status"))
    email = F.concat(F.when(balance > 5000, F.upper("c_mktsegment")).otherwise(F.col("c_mktsegment")), F.floor("c_acctbal").cast("string"))
    # born tomorrow, ten years ago, or 1980
    born = F.when(balance > 9000, F.date_add(F.current_date(), 1)).when(balance > 5000, F.add_months(F.current_date(), -120)).otherwise(F.lit("1980-01-01").cast("date"))
    people = D.table(spark, sf_dir, "customer").select(email.alias("email"), F.when(F.col("c_nationkey") < 10, "X1").otherwise("IQ").alias("nationality"), born.alias("date_of_birth"), F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_custkey")).alias("user_uuid"))
    own = links(spark, sf_dir)
    forced = orders.select((F.col("o_orderpriority") == "1-URGENT").alias("active"), F.when(F.col("o_orderstatus") == "F", "VERIFIED").otherwise("PENDING").alias("verification_status"))
    return _counts({
        "identity_once": docs.withColumn("document_type", F.col("document_type")), "identity_dates": dated, "guardian_once": own, "guardian_verified": forced, "claim_per_patient": claimed, "claim_per_email": claimed, "email_once": people,
        "country_code": people, "born_before_today": people, "owner_adult": people,
    })


@query("""SELECT c_custkey AS uuid, CASE WHEN c_acctbal < 0 THEN 'empty' WHEN c_acctbal > 9900 THEN 'too_large' WHEN c_mktsegment = 'BUILDING' THEN 'unknown_type' WHEN c_mktsegment = 'MACHINERY' THEN 'extension' WHEN c_mktsegment = 'FURNITURE' THEN 'first_bytes'
  WHEN c_nationkey < 5 THEN 'end_marker' END AS rule FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9900 OR c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') OR c_nationkey < 5""")
def dq_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers as files of three kinds: empty, too large, misnamed, of other bytes than their type says, or cut off."""
    segment, balance = F.col("c_mktsegment"), F.col("c_acctbal")
    kinds = list(quality.FILE_KINDS.items())
    pick = lambda values: F.get(F.array(*values), (F.col("c_custkey") % 3).cast("int"))
    head, tail = pick([F.lit(h) for _, (h, _, _) in kinds]), pick([F.lit(t) for _, (_, t, _) in kinds])
    content = F.unhex(F.concat(F.when(segment == "FURNITURE", "0000000000000000").otherwise(head), F.hex(F.encode("c_name", "utf-8")), F.when(F.col("c_nationkey") < 5, "000000000000000000").otherwise(tail), F.when(F.col("c_custkey") % 3 == 0, "0D0A20").otherwise("")))
    blobs = D.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("uuid"), F.concat(F.lit("a.b."), F.when(segment == "MACHINERY", "exe").otherwise(F.upper(pick([F.lit(n[-1]) for _, (_, _, n) in kinds])))).alias("name"),
        F.when(segment == "BUILDING", "text/html").otherwise(pick([F.lit(m) for m, _ in kinds])).alias("mime"), F.when(balance < 0, 0).when(balance > 9900, quality.MAX_FILE + 1).otherwise(F.length(content)).alias("length"), content.alias("content"),
    )
    return quality.file_problems(blobs)


@query("""WITH p AS (SELECT l_orderkey AS k, count(*) AS n, min(l_linenumber) AS f, max(l_linenumber) AS l, count(DISTINCT l_linenumber) AS d, sum(l_quantity) AS q FROM lineitem GROUP BY 1), h AS (SELECT o_orderkey AS k, CASE WHEN o_orderpriority = '5-LOW' THEN 4 ELSE coalesce(n, 0) END AS c, q, f, l, d, coalesce(n, 0) AS n, o_orderpriority FROM orders LEFT JOIN p ON o_orderkey = k)
SELECT k AS document_uuid, CASE WHEN n <> c THEN 'page_count' WHEN f <> 1 OR l <> n OR d <> n THEN 'page_numbers' ELSE 'character_total' END AS rule FROM h WHERE n <> c OR f <> 1 OR l <> n OR d <> n OR (o_orderpriority = '1-URGENT' AND n > 0)""")
def dq_text_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as headers of lineitem's pages: one priority's headers miscount the pages, another's the characters."""
    pages = D.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_uuid"), F.col("l_linenumber").alias("page_number"), F.col("l_quantity").alias("meaningful_character_count"))
    true = pages.groupBy("document_uuid").agg(F.count("*").alias("n"), F.sum("meaningful_character_count").alias("q"))
    orders = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_uuid"), "o_orderpriority").join(true, "document_uuid", "left")
    priority = F.col("o_orderpriority")
    headers = orders.select("document_uuid", F.when(priority == "5-LOW", 4).otherwise(F.coalesce("n", F.lit(0))).alias("page_count"), F.when(priority == "1-URGENT", F.col("q") + 1).otherwise(F.col("q")).alias("meaningful_character_count"))
    return quality.text_shape(pages, headers)


@query("""SELECT doc_id AS document_uuid, 1 AS page_number, CASE WHEN lang = 'de' THEN 'confidence' WHEN lang = 'fr' THEN 'joined_lines' ELSE 'statistics' END AS rule FROM documents WHERE lang IN ('de', 'fr', 'es')""")
def dq_ocr_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as pages and their lines as spans: one language has a confidence over 1, one another text, one no statistics."""
    docs = D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_uuid"), F.lit(1).alias("page_number"), "text", "lang")
    top = F.when(F.col("lang") == "de", 1.5).otherwise(0.9)
    spans = docs.select("document_uuid", "page_number", top.alias("confidence"), F.posexplode(F.split("text", "\n", -1)).alias("sequence", "text"))
    pages = docs.select("document_uuid", "page_number", F.when(F.col("lang") == "fr", F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("text"), F.when(F.col("lang") != "es", 0.9).alias("mean_confidence"))
    return quality.ocr_shape(pages, spans)


@query("""SELECT l_orderkey AS document_uuid, l_linenumber AS page_number, CAST(l_quantity AS INTEGER) AS sequence, 'evidence_page' AS rule FROM lineitem a WHERE l_returnflag = 'A' AND NOT EXISTS (FROM lineitem b WHERE b.l_returnflag <> 'A' AND a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND CAST(a.l_quantity AS INTEGER) % 3 = CAST(b.l_quantity AS INTEGER) % 3)""")
def dq_foreign_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_uuid"), F.col("l_linenumber").alias("page_number"), (F.col("l_quantity").cast("int") % 3).alias("sequence"), F.col("l_quantity").cast("int").alias("q"), "l_returnflag")
    found = quality.foreign_evidence(rows.where("l_returnflag = 'A'"), rows.where("l_returnflag <> 'A'").select("document_uuid", "page_number", "sequence").distinct())
    return found.select("document_uuid", "page_number", F.col("q").alias("sequence"), "rule")


@query("SELECT 'city_in_region' AS rule, s_suppkey AS uuid FROM supplier JOIN customer ON s_suppkey = c_custkey WHERE c_nationkey <> s_nationkey UNION ALL SELECT 'city_in_region', s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)")
def dq_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suppliers as facilities whose city is the customer of the same number, which lies in its nation."""
    regions = D.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("uuid"), F.col("n_regionkey").alias("country"))
    nation = regions.select(F.col("uuid").alias("s_nationkey"), "country")
    facilities = D.table(spark, sf_dir, "supplier").join(F.broadcast(nation), "s_nationkey")  # 25 rows at any size
    facilities = facilities.select(F.col("s_suppkey").alias("uuid"), F.col("s_nationkey").alias("region"), "country", F.col("s_suppkey").alias("city"))
    cities = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uuid"), F.col("c_nationkey").alias("region"))
    return quality.hierarchy(facilities, regions, cities)
