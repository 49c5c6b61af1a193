"""Identity documents, guardians and claims: eligibility, conflicts, comparisons, review records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import casefold
from .archive import age_on

CARD, BIRTH = "UNIFIED_NATIONAL_CARD", "BIRTH_DOCUMENT"


def current_verified(documents: DataFrame, kind: str = CARD) -> DataFrame:
    return documents.where((F.col("document_type") == kind) & (F.col("status") == "CURRENT") & (F.col("verification_status") == "VERIFIED"))


def eligible_guardians(patients: DataFrame, documents: DataFrame, day: Column) -> DataFrame:
    """Verified adults who have a current verified card."""
    adults = patients.where((age_on(F.col("date_of_birth"), day) >= 18) & (F.col("identity_status") == "VERIFIED"))
    return adults.join(current_verified(documents).select(F.col("patient_uuid").alias("uuid")), "uuid", "left_semi")


def guardian_access(links: DataFrame, patients: DataFrame, documents: DataFrame, day: Column) -> DataFrame:
    """Links that open a minor's archive to their guardian: verified, active, the ward still a minor, the guardian eligible."""
    good = links.where((F.col("verification_status") == "VERIFIED") & F.col("active"))
    minors = patients.where(age_on(F.col("date_of_birth"), day) < 18).select(F.col("uuid").alias("minor_patient"))
    guardians = eligible_guardians(patients, documents, day).select(F.col("user_uuid").alias("guardian_user"))
    return good.join(minors, "minor_patient", "left_semi").join(guardians, "guardian_user", "left_semi")


def minors_of(links: DataFrame, patients: DataFrame, day: Column) -> DataFrame:
    """Each guardian's minors, once each: pending links, or verified and active ones; the newest link counts."""
    own = links.where((F.col("verification_status") == "PENDING") | ((F.col("verification_status") == "VERIFIED") & F.col("active")))
    minors = patients.where(age_on(F.col("date_of_birth"), day) < 18).select(F.col("uuid").alias("minor_patient"), "full_name", "date_of_birth")
    nth = F.row_number().over(Window.partitionBy("guardian_user", "minor_patient").orderBy(F.desc("started_at"), F.desc("uuid")))
    return own.join(minors, "minor_patient").withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def identifier_conflicts(new: DataFrame, documents: DataFrame) -> DataFrame:
    """New records that share an identifier with a document: card number with its document or national number, body number with
    its body number. Identifiers become rows (kind, value), so one equi join does it."""

    def rows(df: DataFrame, key: str, pairs: list[tuple[str, str]]) -> DataFrame:
        return df.select(key, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in pairs])).alias("x")).select(key, "x.*").where("value <> ''")

    left = rows(new, "record", [("card", "card_number"), ("body", "body_number")])
    right = rows(documents, "uuid", [("card", "document_number"), ("card", "national_number"), ("body", "unique_card_body_number")])
    return left.join(right.hint("merge"), ["kind", "value"]).select("record", "uuid").distinct()


def type_conflicts(documents: DataFrame) -> DataFrame:
    """Current documents whose patient has another current one of the type, pending or verified."""
    live = documents.where((F.col("status") == "CURRENT") & F.col("verification_status").isin("PENDING", "VERIFIED"))
    return live.withColumn("_n", F.count("*").over(Window.partitionBy("patient_uuid", "document_type"))).where("_n > 1").drop("_n")


def family_match(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """requests (guardian, relationship, document_type, family_number) with MATCH, MISMATCH or UNAVAILABLE against the guardian's card."""
    card = current_verified(documents).groupBy(F.col("patient_uuid").alias("guardian")).agg(F.min_by("family_number", "created_at").alias("_family"))
    known = F.col("relationship").isin("FATHER", "MOTHER") & (F.col("document_type") == CARD) & (F.coalesce("family_number", F.lit("")) != "") & (F.coalesce("_family", F.lit("")) != "")
    result = F.when(~known, "UNAVAILABLE").when(F.col("family_number") == F.col("_family"), "MATCH").otherwise("MISMATCH")
    return requests.join(card, "guardian", "left").withColumn("family_number_result", result).drop("_family")


def eligible_claims(patients: DataFrame, documents: DataFrame, claims: DataFrame, users: DataFrame, requests: DataFrame, day: Column) -> DataFrame:
    """requests (patient_uuid, email) that may become claims: an adult verified patient without an account, with a current card,
    no open claim, and an e-mail address that no account has."""
    free = patients.where(F.col("user_uuid").isNull() & (age_on(F.col("date_of_birth"), day) >= 18) & (F.col("identity_status") == "VERIFIED")).select(F.col("uuid").alias("patient_uuid"))
    ok = requests.join(free, "patient_uuid", "left_semi").join(current_verified(documents).select("patient_uuid"), "patient_uuid", "left_semi")
    ok = ok.join(claims.where(F.col("status").isin("PENDING", "APPROVED")).select("patient_uuid"), "patient_uuid", "left_anti")
    taken = users.select(F.lower("email").alias("_email")).distinct()
    return ok.join(taken, F.lower("email") == F.col("_email"), "left_anti")


def compare(left: Column, right: Column) -> Column:
    """MATCH, MISMATCH, or UNAVAILABLE if a side is null or empty; case and outer blanks don't matter."""
    clean = lambda c: casefold(F.trim(c.cast("string")))
    missing = F.coalesce(clean(left), F.lit("")) == ""
    return F.when(missing | (F.coalesce(clean(right), F.lit("")) == ""), "UNAVAILABLE").when(clean(left) == clean(right), "MATCH").otherwise("MISMATCH")


def compare_claims(claims: DataFrame, patients: DataFrame, documents: DataFrame) -> DataFrame:
    """Claims with the comparison of name, birth date and document number with what is on record."""
    card = current_verified(documents).groupBy(F.col("patient_uuid").alias("_p")).agg(F.min_by("document_number", "created_at").alias("_number"))
    own = patients.select(F.col("uuid").alias("_u"), F.col("full_name").alias("_name"), F.col("date_of_birth").alias("_born"))
    joined = claims.join(own, F.col("patient_uuid") == F.col("_u"), "left").join(card, F.col("patient_uuid") == F.col("_p"), "left")
    return joined.select(
        *claims.columns, compare(F.col("submitted_name"), F.col("_name")).alias("name_result"), compare(F.col("submitted_date_of_birth"), F.col("_born")).alias("birth_date_result"),
        compare(F.col("submitted_document_number"), F.col("_number")).alias("document_result"),
    )


def nested(df: DataFrame, key: str, name: str, columns: list[str]) -> DataFrame:
    """A row for each key with its rows nested in order of the columns."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))


def claim_review(claims: DataFrame, evidence: DataFrame, documents: DataFrame, links: DataFrame) -> DataFrame:
    """Claims with their evidence, and the patient's identity and guardian histories, each nested before it is joined."""
    out = claims.join(nested(evidence, "claim", "evidence", ["created_at", "kind", "file"]), F.col("uuid") == F.col("claim"), "left").drop("claim")
    out = out.join(nested(documents, "patient_uuid", "identity_history", ["created_at", "document_type", "verification_status"]), "patient_uuid", "left")
    guardians = nested(links, "minor_patient", "guardian_history", ["started_at", "guardian_user", "relationship", "verification_status"])
    return out.join(guardians, F.col("patient_uuid") == F.col("minor_patient"), "left").drop("minor_patient")


def guardian_review(links: DataFrame, patients: DataFrame, documents: DataFrame, evidence: DataFrame) -> DataFrame:
    """Links with both patients, the minor's documents and the evidence."""
    person = lambda x, key: patients.select(F.col(key).alias(f"_{x}"), F.struct("uuid", "full_name", "date_of_birth", "identity_status").alias(x))
    out = links.join(person("guardian", "user_uuid"), F.col("guardian_user") == F.col("_guardian"), "left").join(person("minor", "uuid"), F.col("minor_patient") == F.col("_minor"), "left")
    out = out.join(nested(documents, "patient_uuid", "documents", ["created_at", "document_type", "verification_status"]), F.col("minor_patient") == F.col("patient_uuid"), "left").drop("patient_uuid")
    return out.join(nested(evidence, "link", "evidence", ["created_at", "kind", "file"]), F.col("uuid") == F.col("link"), "left").drop("link", "_guardian", "_minor")


def lineage(documents: DataFrame) -> DataFrame:
    """Identity documents with the one that each replaces."""
    before = documents.select(F.col("uuid").alias("_old"), F.col("document_number").alias("replaced_number"), F.col("status").alias("replaced_status"))
    return documents.join(before, F.col("replaces") == F.col("_old"), "left").drop("_old")


def approvable(links: DataFrame, patients: DataFrame, documents: DataFrame, evidence: DataFrame, day: Column) -> DataFrame:
    """Links with the first reason why each can't be approved, or null."""
    minors = patients.where(age_on(F.col("date_of_birth"), day) < 18).select(F.col("uuid").alias("minor_patient"), F.lit(True).alias("_minor"))
    proven = documents.where("status = 'CURRENT' AND verification_status = 'VERIFIED'").select(F.col("patient_uuid").alias("minor_patient"), F.lit(True).alias("_document")).distinct()
    proof = evidence.select(F.col("link").alias("uuid"), F.lit(True).alias("_evidence")).distinct()
    joined = links.join(minors, "minor_patient", "left").join(proven, "minor_patient", "left").join(proof, "uuid", "left")
    reason = (
        F.when(F.col("verification_status") != "PENDING", "NOT_PENDING").when(F.col("_minor").isNull(), "NOT_A_MINOR").when(F.col("_document").isNull(), "NO_VERIFIED_DOCUMENT")
        .when((F.col("relationship") == "LEGAL_GUARDIAN") & F.col("_evidence").isNull(), "NO_EVIDENCE")
    )
    return joined.withColumn("reason", reason).drop("_minor", "_document", "_evidence")


def expire_links(links: DataFrame, patients: DataFrame, day: Column) -> DataFrame:
    """Active links whose minor has come of age or has an account, as they are when ended, with the reason."""
    grown = patients.select(F.col("uuid").alias("minor_patient"), (age_on(F.col("date_of_birth"), day) >= 18).alias("_adult"), F.col("user_uuid").isNotNull().alias("_claimed"))
    ended = links.where("active").join(grown.where("_adult OR _claimed"), "minor_patient")
    reason = F.when(F.col("_claimed"), "CLAIMED").otherwise("ADULT")
    return ended.withColumn("active", F.lit(False)).withColumn("ended_at", day.cast("timestamp")).withColumn("reason", reason).drop("_adult", "_claimed")


def identity_status(patients: DataFrame, documents: DataFrame, day: Column) -> DataFrame:
    """Each patient's status by their documents: verified, else pending, else rejected, else unverified. A minor's birth document counts too."""
    people = patients.select(F.col("uuid").alias("patient_uuid"), (age_on(F.col("date_of_birth"), day) < 18).alias("_minor"))
    current = F.col("status") == "CURRENT"
    counts = (F.col("document_type") == CARD) | (F.col("_minor") & (F.col("document_type") == BIRTH))
    code = F.when(~counts, 0).when(current & (F.col("verification_status") == "VERIFIED"), 3).when(current & (F.col("verification_status") == "PENDING"), 2).when(F.col("verification_status") == "REJECTED", 1).otherwise(0)
    best = people.join(documents, "patient_uuid", "left").groupBy("patient_uuid").agg(F.max(F.coalesce(code, F.lit(0))).alias("code"))
    names = F.array(*map(F.lit, ("UNVERIFIED", "REJECTED", "PENDING_VERIFICATION", "VERIFIED")))
    return best.select("patient_uuid", F.get(names, F.col("code")).alias("identity_status"))


def pending_identity(documents: DataFrame) -> DataFrame:
    """Identity checks that wait, oldest first."""
    return documents.where("verification_status = 'PENDING' AND status = 'CURRENT'").orderBy("created_at", "uuid")


def pending_identity_count(documents: DataFrame) -> DataFrame:
    return documents.where("verification_status = 'PENDING' AND status = 'CURRENT'").agg(F.count("*").alias("n"))
