"""Queries over identity documents, guardians, claims and identity records, with their DuckDB SQL.

customer plays the patients (born some days from 1980 on by the account's balance; one market segment
has no account, two aren't verified), orders play identity documents, guardian links and requests,
lineitem plays evidence.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import archive, identity, identity_records, relations, rollup, search
from . import driver_tables as D
from .register import query

TODAY = date(2001, 8, 2)
VERIFIED_SEGMENTS = ("BUILDING", "HOUSEHOLD", "MACHINERY")

_BORN = "CAST('1980-01-01' AS DATE) + CAST(floor(c_acctbal) AS INTEGER)"
_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'VERIFIED' WHEN 'O' THEN 'PENDING' ELSE 'REJECTED' END"
_KIND = "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'UNIFIED_NATIONAL_CARD' WHEN o_orderpriority = '3-MEDIUM' THEN 'BIRTH_DOCUMENT' ELSE 'PASSPORT' END"
_RELATION = "CASE o_orderpriority WHEN '1-URGENT' THEN 'FATHER' WHEN '2-HIGH' THEN 'MOTHER' WHEN '3-MEDIUM' THEN 'LEGAL_GUARDIAN' ELSE 'OTHER' END"
PEOPLE = f"""people AS (
  SELECT c_custkey AS uuid, c_name AS full_name, {_BORN} AS born, CASE WHEN c_mktsegment IN {VERIFIED_SEGMENTS} THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS identity_status,
         CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_custkey END AS user_uuid, floor((20010802 - CAST(strftime({_BORN}, '%Y%m%d') AS INTEGER)) / 10000.0) AS age FROM customer)"""
PAPERS = f"""papers AS (
  SELECT o_orderkey AS uuid, o_custkey AS patient_uuid, {_KIND} AS document_type, CASE WHEN o_orderstatus = 'P' THEN 'REPLACED' ELSE 'CURRENT' END AS status,
         {_STATUS} AS verification_status, o_orderdate AS created_at FROM orders),
cards AS (SELECT DISTINCT patient_uuid FROM papers WHERE document_type = 'UNIFIED_NATIONAL_CARD' AND status = 'CURRENT' AND verification_status = 'VERIFIED')"""
LINKS = f"""links AS (
  SELECT o_orderkey AS uuid, o_custkey AS guardian_user, CAST(floor(o_totalprice) AS BIGINT) % 2000 AS minor_patient, {_RELATION} AS relationship, {_STATUS} AS verification_status,
         o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' AS active, o_orderdate AS started_at FROM orders)"""


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    return D.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("uuid"), F.col("c_name").alias("full_name"), F.date_add(F.lit(date(1980, 1, 1)), F.floor("c_acctbal").cast("int")).alias("date_of_birth"),
        F.when(segment.isin(*VERIFIED_SEGMENTS), "VERIFIED").otherwise("UNVERIFIED").alias("identity_status"), F.when(segment != "MACHINERY", F.col("c_custkey")).alias("user_uuid"),
    )


def _verification():
    status = F.col("o_orderstatus")
    return F.when(status == "F", "VERIFIED").when(status == "O", "PENDING").otherwise("REJECTED")


def _relation():
    return F.coalesce(F.element_at(F.create_map(*map(F.lit, ("1-URGENT", "FATHER", "2-HIGH", "MOTHER", "3-MEDIUM", "LEGAL_GUARDIAN"))), F.col("o_orderpriority")), F.lit("OTHER"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.col("o_orderpriority")
    kind = F.when(priority.isin("1-URGENT", "2-HIGH"), relations.CARD).when(priority == "3-MEDIUM", relations.BIRTH).otherwise("PASSPORT")
    return D.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("uuid"), F.col("o_custkey").alias("patient_uuid"), kind.alias("document_type"), F.when(F.col("o_orderstatus") == "P", "REPLACED").otherwise("CURRENT").alias("status"),
        _verification().alias("verification_status"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_orderkey").cast("string").alias("document_number"),
        (F.col("o_custkey") % 7).cast("string").alias("family_number"), (F.col("o_orderkey") - F.col("o_custkey")).alias("replaces"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("uuid"), F.col("o_custkey").alias("guardian_user"), (F.floor("o_totalprice") % 2000).cast("long").alias("minor_patient"), _relation().alias("relationship"),
        _verification().alias("verification_status"), ((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") != "5-LOW")).alias("active"), F.col("o_orderdate").cast("timestamp").alias("started_at"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as files of evidence."""
    return D.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("link"), F.col("l_shipdate").cast("timestamp").alias("created_at"), F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("file"))


@query(f"WITH {PEOPLE} SELECT uuid, CAST(age AS INTEGER) AS age, age < 18 AS minor FROM people")
def patient_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, born = F.lit(TODAY), F.col("date_of_birth")
    return patients(spark, sf_dir).select("uuid", archive.age_on(born, day).alias("age"), archive.is_minor(born, day).alias("minor"))


@query(f"WITH {PEOPLE}, {PAPERS} SELECT uuid FROM people WHERE age >= 18 AND identity_status = 'VERIFIED' AND uuid IN (SELECT patient_uuid FROM cards)")
def guardians_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.eligible_guardians(patients(spark, sf_dir), papers(spark, sf_dir), F.lit(TODAY)).select("uuid")


@query(f"""WITH {PEOPLE}, {PAPERS}, {LINKS} SELECT l.uuid, guardian_user, minor_patient FROM links l JOIN people m ON minor_patient = m.uuid JOIN people g ON guardian_user = g.user_uuid
WHERE verification_status = 'VERIFIED' AND active AND m.age < 18 AND g.age >= 18 AND g.identity_status = 'VERIFIED' AND g.uuid IN (SELECT patient_uuid FROM cards)""")
def guardian_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relations.guardian_access(links(spark, sf_dir), patients(spark, sf_dir), papers(spark, sf_dir), F.lit(TODAY))
    return found.select("uuid", "guardian_user", "minor_patient")


@query(f"""WITH {PEOPLE}, {LINKS} SELECT guardian_user, minor_patient, arg_max(l.uuid, (started_at, l.uuid)) AS uuid FROM links l JOIN people p ON minor_patient = p.uuid
WHERE age < 18 AND (verification_status = 'PENDING' OR (verification_status = 'VERIFIED' AND active)) GROUP BY ALL""")
def guardian_minors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.minors_of(links(spark, sf_dir), patients(spark, sf_dir), F.lit(TODAY)).select("guardian_user", "minor_patient", "uuid")


@query(f"""WITH {PAPERS}, live AS (SELECT * FROM papers WHERE status = 'CURRENT' AND verification_status IN ('PENDING', 'VERIFIED'))
SELECT a.uuid FROM live a WHERE EXISTS (FROM live b WHERE a.patient_uuid = b.patient_uuid AND a.document_type = b.document_type AND a.uuid <> b.uuid)""")
def identity_type_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.type_conflicts(papers(spark, sf_dir)).select("uuid")


@query(f"""WITH {PAPERS}, r AS (SELECT o_orderkey AS record, o_custkey, {_RELATION} AS relationship, CASE WHEN o_totalprice > 100000 THEN 'UNIFIED_NATIONAL_CARD' ELSE 'PASSPORT' END AS kind,
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE CAST(o_orderkey % 7 AS VARCHAR) END AS family FROM orders)
SELECT record, CASE WHEN relationship NOT IN ('FATHER', 'MOTHER') OR kind <> 'UNIFIED_NATIONAL_CARD' OR family = '' OR o_custkey NOT IN (SELECT patient_uuid FROM cards) THEN 'UNAVAILABLE'
  WHEN family = CAST(o_custkey % 7 AS VARCHAR) THEN 'MATCH' ELSE 'MISMATCH' END AS family_number_result FROM r""")
def guardian_family_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as requests; the guardian's card names the family."""
    family = F.when(F.col("o_orderkey") % 7 == 0, "").otherwise((F.col("o_orderkey") % 7).cast("string"))
    kind = F.when(F.col("o_totalprice") > 100000, relations.CARD).otherwise("PASSPORT")
    requests = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record"), F.col("o_custkey").alias("guardian"), _relation().alias("relationship"), kind.alias("document_type"), family.alias("family_number"))
    return relations.family_match(requests, papers(spark, sf_dir)).select("record", "family_number_result")


@query(f"""WITH {PEOPLE}, {PAPERS}
SELECT uuid AS patient_uuid FROM people WHERE user_uuid IS NULL AND age >= 18 AND identity_status = 'VERIFIED' AND uuid IN (SELECT patient_uuid FROM cards)
AND uuid NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) AND 'c' || uuid || '@x' NOT IN (SELECT 'c' || s_suppkey * 3 || '@x' FROM supplier)""")
def claims_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers who ask for an account; dear orders are open claims, suppliers' addresses are taken."""
    requests = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("patient_uuid"), F.concat(F.lit("C"), F.col("c_custkey").cast("string"), F.lit("@X")).alias("email"))
    claims = D.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("patient_uuid"), F.when(F.col("o_totalprice") > 450000, "PENDING").otherwise("REJECTED").alias("status"))
    users = D.table(spark, sf_dir, "supplier").select(F.concat(F.lit("c"), (F.col("s_suppkey") * 3).cast("string"), F.lit("@x")).alias("email"))
    return relations.eligible_claims(patients(spark, sf_dir), papers(spark, sf_dir), claims, users, requests, F.lit(TODAY)).select("patient_uuid")


@query(f"""WITH {PEOPLE}, {PAPERS}, {LINKS}, e AS (SELECT l_orderkey AS link, count(*) AS n FROM lineitem GROUP BY 1), d AS (SELECT patient_uuid, count(*) AS n FROM papers GROUP BY 1)
SELECT l.uuid, g.full_name AS guardian, m.full_name AS minor, m.identity_status AS minor_status, coalesce(d.n, 0) AS documents, coalesce(e.n, 0) AS evidence
FROM links l LEFT JOIN people g ON guardian_user = g.user_uuid LEFT JOIN people m ON minor_patient = m.uuid LEFT JOIN d ON minor_patient = d.patient_uuid LEFT JOIN e ON l.uuid = e.link""")
def guardian_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relations.guardian_review(links(spark, sf_dir), patients(spark, sf_dir), papers(spark, sf_dir), evidence(spark, sf_dir))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    sized = lambda c: F.greatest(size(c), F.lit(0))
    return found.select("uuid", F.col("guardian.full_name").alias("guardian"), F.col("minor.full_name").alias("minor"), F.col("minor.identity_status").alias("minor_status"), sized("documents").alias("documents"), sized("evidence").alias("evidence"))


@query(f"WITH {PAPERS} SELECT a.uuid, CAST(b.uuid AS VARCHAR) AS replaced_number, b.status AS replaced_status FROM papers a LEFT JOIN papers b ON a.uuid - a.patient_uuid = b.uuid")
def identity_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.lineage(papers(spark, sf_dir)).select("uuid", "replaced_number", "replaced_status")


@query(f"""WITH {PEOPLE}, {PAPERS}, {LINKS} SELECT uuid, CASE WHEN verification_status <> 'PENDING' THEN 'NOT_PENDING' WHEN minor_patient NOT IN (SELECT uuid FROM people WHERE age < 18) THEN 'NOT_A_MINOR'
  WHEN minor_patient NOT IN (SELECT patient_uuid FROM papers WHERE status = 'CURRENT' AND verification_status = 'VERIFIED') THEN 'NO_VERIFIED_DOCUMENT'
  WHEN relationship = 'LEGAL_GUARDIAN' AND uuid NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') THEN 'NO_EVIDENCE' END AS reason FROM links""")
def guardian_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.approvable(links(spark, sf_dir), patients(spark, sf_dir), papers(spark, sf_dir), evidence(spark, sf_dir).where("kind = 'A'"), F.lit(TODAY)).select("uuid", "reason")


@query(f"""WITH {PEOPLE}, {LINKS} SELECT l.uuid, CASE WHEN user_uuid IS NOT NULL THEN 'CLAIMED' ELSE 'ADULT' END AS reason, '2001-08-02 00:00:00' AS ended_at FROM links l JOIN people p ON minor_patient = p.uuid
WHERE active AND (age >= 18 OR user_uuid IS NOT NULL)""")
def guardian_links_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    ended = relations.expire_links(links(spark, sf_dir), patients(spark, sf_dir), F.lit(TODAY))
    return ended.where("NOT active").select("uuid", "reason", F.date_format("ended_at", "yyyy-MM-dd HH:mm:ss").alias("ended_at"))


@query(f"""WITH {PEOPLE}, {PAPERS}, c AS (SELECT p.uuid, bool_or(status = 'CURRENT' AND verification_status = 'VERIFIED') AS v, bool_or(status = 'CURRENT' AND verification_status = 'PENDING') AS w, bool_or(verification_status = 'REJECTED') AS r
  FROM people p JOIN papers d ON p.uuid = d.patient_uuid WHERE document_type = 'UNIFIED_NATIONAL_CARD' OR (age < 18 AND document_type = 'BIRTH_DOCUMENT') GROUP BY 1)
SELECT uuid AS patient_uuid, CASE WHEN v THEN 'VERIFIED' WHEN w THEN 'PENDING_VERIFICATION' WHEN r THEN 'REJECTED' ELSE 'UNVERIFIED' END AS identity_status FROM people LEFT JOIN c USING (uuid)""")
def identity_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.identity_status(patients(spark, sf_dir), papers(spark, sf_dir), F.lit(TODAY))


@query(f"WITH {PAPERS} SELECT uuid, patient_uuid FROM papers WHERE verification_status = 'PENDING' AND status = 'CURRENT'")
def identity_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.pending_identity(papers(spark, sf_dir)).select("uuid", "patient_uuid")


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
def identity_pending_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.pending_identity_count(papers(spark, sf_dir))


@query("""WITH d AS (SELECT user_id, arg_max('d' || CAST(json_extract(props, '$.k') AS VARCHAR), (ts, event_id)) AS k FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT c_custkey AS document_uuid, k AS duplicate_of FROM customer LEFT JOIN d ON c_custkey = user_id""")
def duplicate_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """errors as events that name the document which another one repeats."""
    events = D.events(spark, sf_dir).withColumn("event_type", F.when(F.col("event_type") == "error", "DUPLICATE").otherwise(F.col("event_type")))
    named = F.concat(F.lit('{"duplicate_of": "d'), F.get_json_object("metadata", "$.k"), F.lit('"}'))
    documents = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_uuid"))
    return rollup.duplicate_of(documents, events.withColumn("metadata", named)).select("document_uuid", "duplicate_of")


@query("SELECT o_orderkey AS uuid, CASE WHEN c_mktsegment <> 'MACHINERY' AND c_custkey = CAST(floor(o_totalprice) AS BIGINT) % 5 THEN 'PATIENT' ELSE 'GUARDIAN' END AS source FROM orders JOIN customer ON o_custkey = c_custkey")
def classification_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who uploads an order: the patient's own account, or another one."""
    owners = patients(spark, sf_dir).select(F.col("uuid").alias("o_custkey"), F.col("user_uuid").alias("patient_user"))
    orders = D.table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("uuid"), (F.floor("o_totalprice") % 5).cast("long").alias("actor"))
    return orders.join(owners, "o_custkey").select("uuid", rollup.classification_source().alias("source"))


@query("""WITH a AS (SELECT c_nationkey AS uuid, string_agg(c_name || '/' || c_mktsegment, ' ' ORDER BY c_name, c_mktsegment) AS aliases FROM customer WHERE c_acctbal > 0 GROUP BY 1)
SELECT n_nationkey AS uuid, coalesce(aliases, '') AS aliases FROM nation LEFT JOIN a ON n_nationkey = uuid""")
def facility_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nations as facilities, customers as their aliases; those in debt aren't active."""
    aliases = D.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("facility"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("language"), (F.col("c_acctbal") > 0).alias("active"))
    found = search.with_aliases(D.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("uuid")), aliases)
    return found.select("uuid", F.coalesce(F.array_join(F.transform("aliases", lambda a: F.concat_ws("/", a["name"], a["language"])), " "), F.lit("")).alias("aliases"))


@query("SELECT c_custkey AS uuid FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 AND n_regionkey = 2 AND lower(n_name) = 'nation_7' AND c_mktsegment = 'BUILDING'")
def facility_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers as facilities, their nation as the region of a country."""
    nation = D.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.lower("n_name").alias("region_normalized"), F.col("n_regionkey").alias("country"))
    places = D.table(spark, sf_dir, "customer").join(F.broadcast(nation), "c_nationkey")  # 25 rows at any size
    places = places.select(F.col("c_custkey").alias("uuid"), (F.col("c_acctbal") > 0).alias("active"), "region_normalized", "country", F.col("c_mktsegment").alias("facility_type"))
    return search.facilities(places, active=True, country=2, region="nation_7", kind="BUILDING").select("uuid")


# identity records


def _digit(c):
    return identity.check_digit(c).cast("string")


@query("""SELECT c_custkey AS record, 'I' AS document_type, 'XYZ' AS issuing_country, ltrim(lpad(CAST(c_custkey AS VARCHAR), 9, '<'), '<') AS document_number, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS nationality,
  CAST('1980-01-01' AS DATE) + CAST(c_custkey % 3000 AS INTEGER) AS date_of_birth, CASE WHEN c_acctbal < 0 THEN 'F' ELSE 'M' END AS sex, c_acctbal <= 9000 AS checks_passed,
  CASE WHEN c_acctbal > 9000 THEN 'document_number' ELSE '' END AS low, CASE WHEN c_acctbal > 9000 THEN 'MRZ_CHECK_FAILED' ELSE '' END AS warnings FROM customer""", days=("date_of_birth",))
def record_fields_three_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer keys written as three-line records and read again; the digit after the number is wrong for large balances."""
    number = F.lpad(F.col("c_custkey").cast("string"), 9, "<")
    born = F.date_format(F.date_add(F.lit(date(1980, 1, 1)), F.pmod("c_custkey", F.lit(3000)).cast("int")), "yyMMdd")
    right = identity.check_digit(number)
    line1 = F.rpad(F.concat(F.lit("I<XYZ"), number, F.when(F.col("c_acctbal") > 9000, (right + 1) % 10).otherwise(right).cast("string")), 30, "<")
    line2 = F.concat(F.rpad(F.lit("ANY<NAME"), 21, "<"), born, _digit(born), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"))
    line3 = F.rpad(F.concat(born, _digit(born), F.when(F.col("c_acctbal") < 0, "F").otherwise("M")), 30, "<")
    rows = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record"), F.posexplode(F.array(line1, line2, line3)).alias("line_no", "text"))
    found = identity.parse_records(rows)
    return found.select("record", "document_type", "issuing_country", "document_number", "nationality", "date_of_birth", "sex", "checks_passed", F.array_join("low_confidence_fields", " ").alias("low"), F.array_join("warnings", " ").alias("warnings"))


@query("""SELECT c_custkey AS record, 'IRQ' AS issuing_country, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS document_number, CAST('1980-01-01' AS DATE) + CAST(c_custkey % 3000 AS INTEGER) AS date_of_birth,
  CASE WHEN c_acctbal < 0 THEN 'F' ELSE 'M' END AS sex, CAST('2030-01-01' AS DATE) + CAST(c_custkey % 3000 AS INTEGER) AS expiry_date, c_mktsegment = 'MACHINERY' AS partial, true AS checks_passed FROM customer""", days=("date_of_birth", "expiry_date"))
def national_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer keys as card lines in any order, with Arabic digits; one segment lacks the name line."""
    number = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    day = lambda start: F.date_format(F.date_add(F.lit(start), F.pmod("c_custkey", F.lit(3000)).cast("int")), "yyMMdd")
    born, expiry = day(date(1980, 1, 1)), day(date(2030, 1, 1))
    line1 = F.rpad(F.concat(F.lit("IDIRQ"), number, _digit(number)), 30, "<")
    line2 = F.rpad(F.concat(born, _digit(born), F.when(F.col("c_acctbal") < 0, "F").otherwise("M"), expiry, _digit(expiry), F.lit("IRQ")), 30, "<")
    name = F.when(F.col("c_mktsegment") != "MACHINERY", "SOME<<NAME")
    arabic = F.translate(line1, "0123456789", "٠١٢٣٤٥٦٧٨٩")
    rows = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record"), F.posexplode(F.array_compact(F.array(name, line2, arabic))).alias("line_no", "text"))
    return identity.national_card(rows).select("record", "issuing_country", "document_number", "date_of_birth", "sex", "expiry_date", "partial", "checks_passed")


@query("""SELECT c_custkey AS record, field, CASE WHEN field = 'document_number' AND c_acctbal > 9000 THEN 0.6 WHEN field = 'name' THEN 0.9 WHEN field = 'document_number' THEN 0.99 ELSE 0.98 END AS confidence
FROM customer, (VALUES ('document_number'), ('date_of_birth'), ('name'), ('nationality')) f(field) WHERE field <> 'name' OR c_acctbal >= 0""")
def record_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confidence of each field that a record has."""
    low = F.when(F.col("c_acctbal") > 9000, F.array(F.lit("document_number"))).otherwise(F.array().cast("array<string>"))
    records = D.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("record"), F.col("c_custkey").alias("document_number"), F.lit("1990-01-01").alias("date_of_birth"), F.lit(None).cast("date").alias("expiry_date"), F.lit(None).cast("string").alias("sex"),
        F.col("c_nationkey").alias("nationality"), F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("name"), low.alias("low_confidence_fields"),
    )
    return identity.field_confidences(records).select("record", "field", "confidence")


@query("""WITH d AS (SELECT o_custkey AS record, CAST(o_orderdate AS DATE) AS day FROM orders), p AS (SELECT record, min(day) FILTER (day <= DATE '2001-01-01') AS b, max(day) FILTER (day <= DATE '2001-01-01') AS i, min(day) FILTER (day > DATE '2001-01-01') AS e FROM d GROUP BY 1)
SELECT record, b AS birth_date, CASE WHEN i <> b THEN i END AS issue_date, e AS expiry_date FROM p""", days=("birth_date", "issue_date", "expiry_date"))
def printed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("record"), F.col("o_orderdate").cast("date").alias("day"))
    return identity.printed_dates(rows, F.lit(date(2001, 1, 1)))


@query("""WITH d AS (SELECT o_custkey AS record, CAST(o_orderdate AS DATE) AS day, o_orderpriority = '1-URGENT' AS l, o_orderkey AS n FROM orders)
SELECT record, CASE WHEN bool_or(l) THEN arg_min(day, n) FILTER (l) ELSE arg_min(day, n) END AS issue_date, CASE WHEN bool_or(l) THEN 0.85 ELSE 0.6 END AS confidence FROM d GROUP BY 1""", days=("issue_date",))
def issue_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("record"), F.col("o_orderkey").alias("line_no"), F.col("o_orderdate").cast("date").alias("day"), (F.col("o_orderpriority") == "1-URGENT").alias("labelled"))
    return identity.issue_dates(rows)


_LETTERS = "translate(CAST(c_custkey AS VARCHAR), '0123456789', 'ابتثجحخدذر')"


@query(f"SELECT c_custkey AS record, {_LETTERS} AS name, 'سعيد' || {_LETTERS} AS father_name, CASE WHEN c_acctbal >= 0 THEN 'كريم' END AS grandfather_name FROM customer")
def card_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with the value on their line, on the next one, or after the mother's label, where it isn't the father's side."""
    own = F.translate(F.col("c_custkey").cast("string"), "0123456789", "ابتثجحخدذر")
    grandfather = F.lit("الجد: كريم")
    lines = F.array(F.concat(F.lit("الاسم: "), own), F.lit("الأب"), F.concat(F.lit("سعيد"), own), F.when(F.col("c_acctbal") >= 0, grandfather).otherwise("الام: زينب"), F.when(F.col("c_acctbal") < 0, grandfather).otherwise("الام: زينب"))
    rows = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record"), F.posexplode(lines).alias("line_no", "text"))
    return identity.name_chain(rows).select("record", "name", "father_name", "grandfather_name")


@query(f"""SELECT c_custkey AS record, 'سعيد' || {_LETTERS} AS name, 'مجيد' || {_LETTERS} AS father_name, 'حسن' AS grandfather_name,
  CASE WHEN c_acctbal < 0 THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS father_confidence FROM customer""")
def card_name_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label of the name lines in turn: apart, with the value on the next line behind surname and sex, with a connector, and
    glued where it may be; a second father and the mother's side come after."""
    own = F.translate(F.col("c_custkey").cast("string"), "0123456789", "ابتثجحخدذر")
    turn = lambda labels: F.get(F.array(*map(F.lit, labels)), (F.floor(F.col("c_custkey") / 4) % len(labels)).cast("int"))
    form = F.col("c_custkey") % 4

    def section(label: str, value) -> list:
        whole, glued = identity.NAME_LABELS[label]
        same = F.when(form == 0, F.concat(turn(whole), F.lit(" / "), value)).when(form == 1, turn(whole))
        same = same.when(form == 2, F.concat(turn(whole), F.lit(": اتو "), value)).otherwise(F.concat(turn(glued), value))
        behind = lambda text: F.when(form == 1, text)
        return [same, behind(F.lit("الجنس ذكر")), behind(F.lit("اللقب الحسني")), behind(value)]

    lines = [*section("name", F.concat(F.lit("سعيد"), own)), *section("father", F.concat(F.lit("مجيد"), own)), F.lit("الاب: ثان"), *section("grandfather", F.lit("حسن")), F.lit("الام: زينب"), F.lit("الجد: جعفر")]
    rows = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record"), F.when(F.col("c_acctbal") < 0, 0.0).otherwise(0.9).alias("confidence"), F.posexplode(F.array(*lines)).alias("line_no", "text"))
    return identity.name_chain(rows).select("record", "name", "father_name", "grandfather_name", F.col("father_name_confidence").alias("father_confidence"))


@query("""SELECT c_custkey AS record, lpad(CAST(c_custkey AS VARCHAR), 12, '1') AS card_number, 'K' || lpad(CAST(c_custkey AS VARCHAR), 8, '2') AS body_number, lpad(CAST(c_custkey AS VARCHAR), 18, 'Q') AS family_number,
  ['A+', 'A-', 'B+', 'B-', 'AB+', 'AB-', 'O+', 'O-'][c_custkey % 8 + 1] AS blood_group, CASE WHEN c_acctbal < 0 THEN 'F' ELSE 'M' END AS sex FROM customer""")
def card_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with misread letters, a body number, a family number, blood group and sex on lines of their own."""
    key = F.col("c_custkey").cast("string")
    blood = F.get(F.array(*map(F.lit, identity.BLOOD_GROUPS)), (F.col("c_custkey") % 8).cast("int"))
    lines = F.array(
        F.concat(F.lit("No "), F.translate(F.lpad(key, 12, "1"), "0158", "OISB")), F.concat(F.lit("Body "), F.lit("K"), F.lpad(key, 8, "2")), F.lpad(key, 18, "Q"),
        F.concat(F.lit("Blood "), F.replace(blood, F.lit("O"), F.lit("0"))), F.when(F.col("c_acctbal") < 0, "female").otherwise("male"),
    )
    return identity.number_fields(D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record"), F.posexplode(lines).alias("line_no", "text")))


#: Cards, passports and papers of another type, some without lines: what stands on which side, by the customer's nation and balance.
_PAPER_KIND = "CASE c_mktsegment WHEN 'MACHINERY' THEN 'PASSPORT' WHEN 'FURNITURE' THEN 'BIRTH_DOCUMENT' ELSE 'UNIFIED_NATIONAL_CARD' END"
_WHOLE = f"""c AS (SELECT c_custkey AS record, CAST(c_custkey AS VARCHAR) AS k, c_nationkey AS nk, c_acctbal AS bal, {_PAPER_KIND} AS kind, c_nationkey % 4 <> 3 AS m, CASE WHEN c_nationkey = 6 THEN 0.7 ELSE 0.8 END AS own,
  CAST('1980-01-01' AS DATE) + CAST(c_custkey % 3000 AS INTEGER) AS born, {_LETTERS} AS letters FROM customer),
card AS (SELECT *, 'K' || lpad(k, 8, '0') AS body, CASE WHEN m THEN CASE WHEN bal > 9000 THEN 'G' ELSE 'K' END || lpad(k, 8, '0') END AS mbody, CASE WHEN nk % 5 <> 0 THEN 'MALE' END AS sex, CASE WHEN m THEN CASE WHEN bal < 0 THEN 'FEMALE' ELSE 'MALE' END END AS msex,
  CASE WHEN nk % 2 = 0 THEN CAST(born AS VARCHAR) END AS day, CASE WHEN m THEN CAST(CAST(born + CASE WHEN bal > 8000 THEN 1 ELSE 0 END AS DATE) AS VARCHAR) END AS mday, CASE WHEN nk % 7 <> 0 THEN '2040-06-30' END AS til,
  CASE WHEN m THEN CASE WHEN nk % 11 = 0 THEN '2041-06-30' ELSE '2040-06-30' END END AS mtil,
  CASE WHEN nk % 2 = 1 THEN lpad(k, 12, 'Q') WHEN nk % 4 = 0 THEN lpad(k, 14, 'R') END AS family, CASE WHEN nk <> 10 THEN CASE WHEN nk = 5 THEN lpad(k, 12, '1') || '5' ELSE lpad(k, 12, '1') END END AS number,
  CASE WHEN nk = 5 THEN 0.65 ELSE own END AS nconf FROM c WHERE kind = 'UNIFIED_NATIONAL_CARD' AND nk <> 12)"""
_BOTH = "CASE WHEN {a} = {b} THEN 'MRZ_AGREE' WHEN {a} <> {b} THEN 'MRZ_MISMATCH' END"


@query(f"""WITH {_WHOLE}, f AS (
  SELECT record, 'name' AS field, letters AS value, own AS confidence, 'FRONT_PRINTED' AS source, NULL AS cross_check FROM card
  UNION ALL SELECT record, 'father_name', 'سعيد', own, 'FRONT_PRINTED', NULL FROM card UNION ALL SELECT record, 'grandfather_name', 'كريم', own, 'FRONT_PRINTED', NULL FROM card WHERE bal >= 0
  UNION ALL SELECT record, 'sex', coalesce(sex, msex), CASE WHEN sex = msex THEN 0.96 WHEN sex <> msex THEN 0.45 WHEN sex IS NULL OR nk = 6 THEN 0.9 ELSE 0.8 END, CASE WHEN sex IS NULL THEN 'MRZ' ELSE 'FRONT_PRINTED' END, {_BOTH.format(a='sex', b='msex')} FROM card
  UNION ALL SELECT record, 'blood_group', CASE WHEN bal >= 1000 THEN 'AB+' END, 0.82, 'ROI', NULL FROM card
  UNION ALL SELECT record, 'national_card_number', number, nconf, 'FRONT_PRINTED', NULL FROM card UNION ALL SELECT record, 'document_number', number, nconf, 'FRONT_PRINTED', NULL FROM card
  UNION ALL SELECT record, 'unique_card_body_number', CASE WHEN nk % 3 <> 0 THEN body ELSE mbody END, CASE WHEN nk % 3 = 0 THEN 0.85 WHEN mbody IS NULL THEN 0.9 WHEN body = mbody THEN 0.95 ELSE 0.7 END,
    CASE WHEN nk % 3 = 0 THEN 'MRZ' ELSE 'FRONT_PRINTED' END, CASE WHEN nk % 3 <> 0 THEN {_BOTH.format(a='body', b='mbody')} END FROM card
  UNION ALL SELECT record, 'date_of_birth', coalesce(day, mday), CASE WHEN day = mday THEN 0.94 WHEN day <> mday THEN 0.45 WHEN mday IS NULL THEN 0.85 WHEN bal > 7000 THEN 0.55 ELSE 0.8 END, CASE WHEN day IS NULL THEN 'MRZ' ELSE 'BACK_PRINTED' END, {_BOTH.format(a='day', b='mday')} FROM card
  UNION ALL SELECT record, 'issue_date', CASE WHEN nk % 6 <> 0 THEN '2015-03-04' END, 0.7, 'BACK_PRINTED', NULL FROM card
  UNION ALL SELECT record, 'expiry_date', coalesce(mtil, til), CASE WHEN til = mtil THEN 0.94 WHEN til <> mtil THEN 0.65 WHEN til IS NULL THEN 0.85 ELSE 0.7 END, CASE WHEN mtil IS NULL THEN 'BACK_PRINTED' ELSE 'MRZ' END, {_BOTH.format(a='til', b='mtil')} FROM card
  UNION ALL SELECT record, 'family_number', family, 0.85, 'BACK_PRINTED', NULL FROM card UNION ALL SELECT record, 'issuing_country', 'IQ', 1.0, 'DOCUMENT_TYPE', NULL FROM card
) SELECT record, field, value, CAST(confidence AS DOUBLE) AS confidence, source, cross_check FROM f WHERE value IS NOT NULL""")
def reconciled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards' fields from their sides and machine-readable lines: agreeing, disagreeing, of one source alone, with checks that fail."""
    whole = identity_records.identity_records(*_papers_and_lines(spark, sf_dir), F.lit(date(2024, 1, 1))).where(F.col("document_type") == identity_records.CARD)
    return whole.select("record", F.explode("fields").alias("field", "x")).select("record", "field", "x.*")


def _papers_and_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nk, bal, segment = F.col("c_nationkey"), F.col("c_acctbal"), F.col("c_mktsegment")
    customers = D.table(spark, sf_dir, "customer").withColumn("key", F.col("c_custkey").cast("string"))
    customers = customers.withColumn("kind", F.when(segment == "MACHINERY", "PASSPORT").when(segment == "FURNITURE", "BIRTH_DOCUMENT").otherwise("UNIFIED_NATIONAL_CARD"))
    key, card, passport = F.col("key"), F.col("kind") != "PASSPORT", F.col("kind") == "PASSPORT"
    born = F.date_add(F.lit(date(1980, 1, 1)), F.pmod("c_custkey", F.lit(3000)).cast("int"))
    coded_day = F.date_format(F.date_add(born, F.when(bal > 8000, 1).otherwise(0)), "yyMMdd")
    until = F.when(nk % 11 == 0, "410630").otherwise("400630")
    wrong = lambda text, bad: F.when(bad, ((identity.check_digit(text) + 1) % 10).cast("string")).otherwise(_digit(text))
    number = F.concat(F.when(bal > 9000, "G").otherwise("K"), F.lpad(key, 8, "0"))
    line = lambda side, text, given: F.when(given, F.struct(F.lit(side).alias("side"), text.alias("text")))
    coded = nk % 4 != 3
    digits = F.lpad(key, 9, "0")
    page = F.concat(F.lit("P<XYZ"), digits, wrong(digits, bal > 9000), F.lit("XYZ<"), F.date_format(born, "yyMMdd"), _digit(F.date_format(born, "yyMMdd")), F.when(bal < 0, "F").otherwise("M"), F.lit("<<"), until, _digit(until))
    lines = F.array(
        line("FRONT", F.concat(F.lit("الاسم "), F.translate(key, "0123456789", "ابتثجحخدذر")), card), line("FRONT", F.lit("الاب: سعيد"), card), line("FRONT", F.lit("الجد"), card & (bal >= 0)), line("FRONT", F.lit("كريم"), card & (bal >= 0)),
        line("FRONT", F.lit("الجنس: ذكر"), card & (nk % 5 != 0)), line("FRONT", F.concat(F.lit("No "), F.lpad(key, 12, "1"), F.when(nk == 5, "S").otherwise("")), card & (nk != 10)),
        line("FRONT", F.concat(F.lit("body K"), F.lpad(key, 8, "0")), card & (nk % 3 != 0)), line("BACK", F.concat(F.lit("الرقم العائلي "), F.lpad(key, 14, "R")), card & (nk % 4 == 0)),
        line("ROI_FAMILY", F.concat(F.lit("SHORT1 "), F.lpad(key, 12, "Q")), card & (nk % 2 == 1)), line("ROI_BLOOD", F.lit("AB +"), card & (bal >= 1000)), line("ROI_DOB", F.date_format(born, "yyyy/M/d"), card & (nk % 2 == 0)),
        line("ROI_DATES", F.lit("2015.03.04"), card & (nk % 6 != 0)), line("ROI_DATES", F.lit("2040-06-30"), card & (nk % 7 != 0)),
        line("ROI_MRZ", F.rpad(F.concat(F.lit("IDIRQ"), number, _digit(number)), 30, "<"), card & coded), line("ROI_MRZ", F.lit("SOME<<NAME"), card & coded & (nk != 13)),
        line("ROI_MRZ", F.rpad(F.concat(coded_day, wrong(coded_day, bal > 7000), F.when(bal < 0, "F").otherwise("M"), until, _digit(until), F.lit("IRQ")), 30, "<"), card & coded),
        line("FRONT", F.rpad(page, 44, "<"), passport & coded), line("FRONT", F.rpad(F.lit("NAME"), 44, "<"), passport & coded),
        line("FRONT", F.lit("seen on 2011-1-2"), passport & (nk % 3 != 2)), line("FRONT", F.lit("Date of issue 2012/5/6"), passport & (nk % 3 == 0)), line("FRONT", F.lit(""), F.lit(True)),
    )
    rows = customers.where(nk != 12).select(F.col("c_custkey").alias("record"), F.when(nk == 6, 0.0).otherwise(0.8).alias("confidence"), F.posexplode(F.array_compact(lines)).alias("line_no", "x"))
    return customers.select(F.col("c_custkey").alias("record"), F.col("kind").alias("document_type")), rows.select("record", "x.side", "line_no", "x.text", "confidence")


@query(f"""WITH {_WHOLE}, w AS (SELECT record, concat_ws(' ',
    CASE WHEN NOT m THEN 'MRZ_NOT_DETECTED' WHEN bal > 7000 OR nk = 13 THEN 'MRZ_PARTIAL' END, CASE WHEN bal < 0 THEN 'FIELD_MISSING' END, CASE WHEN sex <> msex THEN 'SOURCE_MISMATCH' WHEN sex IS NULL AND NOT m THEN 'FIELD_MISSING' END,
    CASE WHEN bal < 1000 THEN 'BLOOD_GROUP_NOT_FOUND' END, CASE nk WHEN 10 THEN 'FIELD_MISSING' WHEN 5 THEN 'OCR_CHARACTER_NORMALIZED' END,
    CASE WHEN nk % 3 <> 0 AND body <> mbody THEN 'SOURCE_MISMATCH' WHEN nk % 3 = 0 AND NOT m THEN 'FIELD_MISSING' END, CASE WHEN day <> mday THEN 'SOURCE_MISMATCH' WHEN day IS NULL AND NOT m THEN 'FIELD_MISSING' END,
    CASE WHEN til <> mtil THEN 'SOURCE_MISMATCH' END, CASE WHEN family IS NULL THEN 'FAMILY_NUMBER_NOT_FOUND' END) AS warnings FROM card)
SELECT c.record, kind AS document_type, CASE WHEN nk = 12 THEN 'NO_TEXT_DETECTED' WHEN kind = 'BIRTH_DOCUMENT' THEN 'UNSUPPORTED_LAYOUT' WHEN kind = 'PASSPORT' THEN
    concat_ws(' ', CASE WHEN NOT m THEN 'MRZ_NOT_DETECTED' WHEN bal > 9000 THEN 'MRZ_CHECK_FAILED' END, CASE WHEN nk % 3 = 2 THEN 'FIELD_NOT_FOUND' END) ELSE warnings END AS warnings,
  nk <> 12 AND kind <> 'BIRTH_DOCUMENT' AND m AS detected, nk <> 12 AND m AND CASE kind WHEN 'PASSPORT' THEN bal <= 9000 WHEN 'BIRTH_DOCUMENT' THEN false ELSE bal <= 7000 END AS valid,
  CASE WHEN kind = 'PASSPORT' AND nk <> 12 THEN concat_ws(' ', CASE WHEN nk % 3 = 0 THEN '2012-05-06 0.85' WHEN nk % 3 = 1 THEN '2011-01-02 0.6' END,
    CASE WHEN m THEN lpad(k, 9, '0') || CASE WHEN bal > 9000 THEN ' 0.6' ELSE ' 0.99' END || ' NAME' || CASE WHEN bal > 9000 THEN ' 0.6' ELSE ' 0.9' END || ' XYZ ' || CAST(born AS VARCHAR) || ' ' || CASE WHEN bal < 0 THEN 'F' ELSE 'M' END || CASE WHEN nk % 11 = 0 THEN ' 2041-06-30' ELSE ' 2040-06-30' END END) ELSE '' END AS passport
FROM c LEFT JOIN w ON c.record = w.record""")
def assembled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All papers by their type: warnings in order, the state of the machine-readable lines, and a passport's fields."""
    whole = identity_records.identity_records(*_papers_and_lines(spark, sf_dir), F.lit(date(2024, 1, 1)))
    cell = lambda f, rated=True: [F.col("fields")[f]["value"], *([F.col("fields")[f]["confidence"].cast("string")] if rated else [])]
    shown = F.concat_ws(" ", *cell("issue_date"), *cell("document_number"), *cell("full_name"), *cell("issuing_country", False), *cell("date_of_birth", False), *cell("sex", False), *cell("expiry_date", False))
    passport = F.when(F.col("document_type") == identity_records.PASSPORT, shown).otherwise("")
    return whole.select("record", "document_type", F.array_join("warnings", " ").alias("warnings"), "detected", "valid", passport.alias("passport"))
