"""Page and document states: roll-ups, gates, review queues, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .archive import latest_per

NOT_DONE = ("QUEUED", "OCR_PROCESSING", "EXTRACTING")
LAB_DONE = ("COMPLETED", "NOT_APPLICABLE", "FAILED")
#: Metadata fields that can be edited, and the event that a change of each makes.
CHANGE_EVENTS = (
    ("DOCUMENT_TYPE_CHANGED", ("document_type",)),
    ("DOCUMENT_FACILITY_CHANGED", ("healthcare_facility",)),
    ("DOCUMENT_LOCATION_UPDATED", ("facility_name", "location_text")),
    ("DOCUMENT_DEPARTMENT_UPDATED", ("department",)),
    ("DOCUMENT_PHYSICIAN_METADATA_UPDATED", ("physician_name",)),
    ("METADATA_UPDATED", ("description", "title")),
)


def finalize_page(applicable: Column) -> Column:
    """A page's next state from its latest lab status, whether labs apply to it, and whether its date is confirmed."""
    lab = F.col("lab_status")
    done = F.coalesce(lab.isin(*LAB_DONE), ~applicable)
    return F.when(lab == "FAILED", "FAILED").when(~done, "EXTRACTING").when(F.col("date_verified"), "READY").otherwise("AWAITING_CONFIRMATION")


def document_status(pages: DataFrame) -> DataFrame:
    """Each document's state by its pages' states; the first rule that holds decides."""
    status = F.col("processing_status")
    flags = pages.groupBy("document_uuid").agg(
        F.bool_or(status.isin(*NOT_DONE)).alias("busy"), F.bool_and(status == "READY").alias("ready"), F.bool_or(status == "AWAITING_CONFIRMATION").alias("waits"),
        F.bool_and(status == "FAILED").alias("failed"), F.bool_or(status == "FAILED").alias("some_failed"),
    )
    rules = (
        F.when(F.col("busy"), "PROCESSING").when(F.col("ready"), "DATE_CONFIRMED").when(F.col("waits"), "AWAITING_CONFIRMATION")
        .when(F.col("failed"), "FAILED").when(F.col("some_failed"), "PARTIAL").otherwise("AWAITING_CONFIRMATION")
    )
    return flags.select("document_uuid", rules.alias("document_status"))


def document_date(pages: DataFrame) -> DataFrame:
    """What confirmed pages say of the document's date: SET (one date), CLEARED (several) or KEPT (none)."""
    dated = F.when((F.col("processing_status") == "READY") & F.col("date_verified"), F.col("document_date"))
    per = pages.groupBy("document_uuid").agg(F.min(dated).alias("least"), F.max(dated).alias("most"))
    action = F.when(F.col("least").isNull(), "KEPT").when(F.col("least") == F.col("most"), "SET").otherwise("CLEARED")
    return per.select("document_uuid", action.alias("date_action"), F.when(action == "SET", F.col("least")).alias("parent_date"))


def mirror_single_page(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents of one page with their own state carried over to that page."""
    single = pages.withColumn("_pages", F.count("*").over(Window.partitionBy("document_uuid"))).where("_pages = 1").drop("_pages", "processing_status")
    status = F.col("document_processing_status")
    mapped = F.when(status == "DATE_CONFIRMED", "READY").when(status.isin("AWAITING_CONFIRMATION", "FAILED"), status).when(status == "PARTIAL", "AWAITING_CONFIRMATION").otherwise("QUEUED")
    source = documents.select("document_uuid", F.col("processing_status").alias("document_processing_status"))
    return single.join(source, "document_uuid").withColumn("processing_status", mapped).drop("document_processing_status")


def latest_extraction(pages: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """pages with lab_status and lab_error of their latest run."""
    last = latest_per(runs, keys, [F.desc("created_at"), F.desc("uuid")])
    return pages.join(last.select(*keys, F.col("status").alias("lab_status"), F.col("error_code").alias("lab_error")), keys, "left")


def lab_status(documents: DataFrame, runs: DataFrame) -> DataFrame:
    """Each document's lab status: its latest run's, else PENDING for laboratory documents and NOT_APPLICABLE for others."""
    with_run = latest_extraction(documents, runs, ["document_uuid"])
    return with_run.withColumn("lab_status", F.coalesce("lab_status", F.when(F.col("document_type") == "LABORATORY", "PENDING").otherwise("NOT_APPLICABLE")))


def page_lab_status(pages: DataFrame, page_runs: DataFrame, document_runs: DataFrame) -> DataFrame:
    """Each page's lab status: its own latest run's; of a one-page document else the document's."""
    own = latest_extraction(pages, page_runs, ["document_uuid", "page_number"]).withColumn("_pages", F.count("*").over(Window.partitionBy("document_uuid")))
    whole = latest_per(document_runs, ["document_uuid"], [F.desc("created_at"), F.desc("uuid")]).select("document_uuid", F.col("status").alias("_document_status"))
    joined = own.join(whole, "document_uuid", "left")
    return joined.withColumn("lab_status", F.coalesce("lab_status", F.when(F.col("_pages") == 1, F.col("_document_status")), F.lit("NOT_APPLICABLE"))).drop("_pages", "_document_status")


def content_kind(lab_rows: Column, sections: Column) -> Column:
    return F.when(lab_rows > 0, "LAB").when(sections > 0, "NARRATIVE").otherwise("NONE")


def classification_source() -> Column:
    """Who classified a document: the patient themself, or a guardian."""
    return F.when(F.col("patient_user") == F.col("actor"), "PATIENT").otherwise("GUARDIAN")


def current_candidates(candidates: DataFrame) -> DataFrame:
    return candidates.where("is_current")


def page_candidates(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pages with their current candidates nested, best first."""
    nested = current_candidates(candidates).groupBy("document_uuid", "page_number").agg(
        F.transform(F.sort_array(F.collect_list(F.struct(F.negative("score").alias("minus"), "uuid", "detected_date", "candidate_type", "score"))), lambda c: c.dropFields("minus")).alias("candidates")
    )
    return pages.join(nested, ["document_uuid", "page_number"], "left")


def pending_items(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pages that wait, in order, with their candidates, and whether a date must be typed in."""
    waiting = pages.where((F.col("processing_status") == "AWAITING_CONFIRMATION") & ~F.col("date_verified"))
    items = page_candidates(waiting, candidates)
    return items.withColumn("requires_manual_date", F.coalesce(F.size("candidates"), F.lit(0)) <= 0).orderBy("created_at", "document_uuid", "page_number")


def page_counts(pages: DataFrame, results: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pages with the number of their lab rows and current candidates; both are counted before they are joined."""
    keys = ["document_uuid", "page_number"]
    labs = results.groupBy(*keys).agg(F.count("*").alias("lab_rows"))
    dates = current_candidates(candidates).groupBy(*keys).agg(F.count("*").alias("date_candidates"))
    return pages.join(labs, keys, "left").join(dates, keys, "left").fillna(0, ["lab_rows", "date_candidates"])


def pending_pages(documents: DataFrame, pages: DataFrame, patient=None) -> DataFrame:
    """Pages of active documents that wait for confirmation, in order of the document's time and the page."""
    from .archive import active

    owned = active(documents, patient).select("document_uuid", "patient_uuid", "created_at")
    waiting = pages.where((F.col("processing_status") == "AWAITING_CONFIRMATION") & ~F.col("date_verified"))
    return waiting.join(owned, "document_uuid").orderBy("created_at", "document_uuid", "page_number")


def pending_documents(documents: DataFrame, patient=None) -> DataFrame:
    from .archive import active

    return active(documents, patient).where((F.col("processing_status") == "AWAITING_CONFIRMATION") & ~F.col("date_verified")).orderBy("created_at", "document_uuid")


def extractable(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Active documents whose file is whole and not found to be infected."""
    good = files.where((F.col("integrity_status") == "VALID") & ~F.col("scan_status").isin("INFECTED", "ERROR"))
    return documents.where("archive_status = 'ACTIVE'").join(good.select("document_uuid"), "document_uuid", "left_semi")


def with_file(documents: DataFrame, files: DataFrame) -> DataFrame:
    return documents.join(files, "document_uuid")


def available_files(files: DataFrame) -> DataFrame:
    return files.where(~F.col("integrity_status").isin("CORRUPTED", "QUARANTINED", "MISSING"))


def stale_work(df: DataFrame, now: Column, limits: dict[str, int]) -> DataFrame:
    """Work in progress that began longer ago than its state's limit in seconds, or at no known time."""
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("processing_status"))
    return df.where(limit.isNotNull() & (F.col("started_at").isNull() | (F.col("started_at").cast("long") <= now.cast("timestamp").cast("long") - limit)))


def expired_jobs(df: DataFrame, now: Column, ttl_seconds: int, open_statuses: tuple[str, ...] = ("PENDING", "PROCESSING")) -> DataFrame:
    """Open sessions that were last touched too long ago or whose time is over."""
    at = now.cast("timestamp")
    old = F.col("updated_at").cast("long") < at.cast("long") - ttl_seconds
    return df.where(F.col("status").isin(*open_statuses) & (old | F.coalesce(F.col("expires_at") <= at, F.lit(False))))


def by_status(df: DataFrame, status: str | None, column: str = "status") -> DataFrame:
    return df if status is None else df.where(F.col(column) == status)


def metadata_changes(old: DataFrame, new: DataFrame, key: str = "document_uuid") -> DataFrame:
    """Change events between two versions of documents: key, event_type, fields (sorted), old_value and new_value of single fields."""
    fields = [f for _, fs in CHANGE_EVENTS for f in fs if f in new.columns and f in old.columns]
    before = old.select(F.col(key).alias("_key"), *[F.col(f).alias(f"_{f}") for f in fields])
    both = new.join(before, F.col(key) == F.col("_key"))
    changed = lambda f: ~F.col(f).eqNullSafe(F.col(f"_{f}"))
    events = []
    for kind, fs in CHANGE_EVENTS:
        own = [f for f in fs if f in fields]
        if own:
            names = F.filter(F.array(*[F.when(changed(f), F.lit(f)) for f in sorted(own)]), lambda x: x.isNotNull())
            single = len(fs) == 1 and kind in ("DOCUMENT_TYPE_CHANGED", "DOCUMENT_FACILITY_CHANGED")
            value = lambda c: (F.col(c).cast("string") if single else F.lit(None).cast("string"))  # noqa: E731, B023
            events.append(F.struct(F.lit(kind).alias("event_type"), names.alias("fields"), value(f"_{own[0]}").alias("old_value"), value(own[0]).alias("new_value")))
    found = both.select(key, F.explode(F.filter(F.array(*events), lambda e: F.size(e["fields"]) > 0)).alias("e"))
    return found.select(key, "e.*")


def decision_action(key: list[str], order: list[str]) -> Column:
    """What a date decision is after the one before it: CONFIRMED (the first), RECONFIRMED (same date, other source), CORRECTED, or null (no change)."""
    window = Window.partitionBy(*key).orderBy(*order)
    before, source = F.lag("decided_date").over(window), F.lag("date_source").over(window)
    same = before == F.col("decided_date")
    return F.when(before.isNull(), "CONFIRMED").when(same & source.eqNullSafe(F.col("date_source")), F.lit(None)).when(same, "RECONFIRMED").otherwise("CORRECTED")


def duplicate_of(documents: DataFrame, events: DataFrame) -> DataFrame:
    """Documents with the id that their latest DUPLICATE event names."""
    last = latest_per(events.where("event_type = 'DUPLICATE'"), ["document_uuid"], [F.desc("created_at"), F.desc("uuid")])
    return documents.join(last.select("document_uuid", F.get_json_object("metadata", "$.duplicate_of").alias("duplicate_of")), "document_uuid", "left")
