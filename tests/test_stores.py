"""The inverted index, versioned tables and keyset pages: literal cases, failures, and how much a read touches."""

import datetime as dt
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quirelake.operators import paging, search, search_index
from quirelake.sources import io, versioned


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def searchable(spark):
    words = "alpha beta gamma delta é ß 東京 x1".split()
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice([*words, None]), rng.choice(["Alpha Beta", "", None]), None) for i in range(300)]
    rows += [(1000, "rare " + "alpha " * 500, "alpha", None, None), (1001, None, None, None, None), (1002, "Rare!rare?RARE", "", "beta", None)]
    return spark.createDataFrame(rows, "document_uuid long, text string, title string, department string, created_at timestamp")


@pytest.mark.parametrize("most", [200_000, -1])
def test_index_gives_what_the_scan_gives(spark, most):
    docs, path = searchable(spark), io.scratch(spark, "index")
    search_index.write_index(docs, path, buckets=7)
    for q in ("alpha", "Alpha, beta", "rare alpha", "rare", "é ß", "東京 x1 gamma delta", "nowhere", "alpha nowhere", "", "?!"):
        want = {r.document_uuid: r["rank"] for r in search.keyword(docs, q).collect()}
        got = {r.document_uuid: r["rank"] for r in search_index.keyword(docs, path, q, buckets=7, max_broadcast=most).collect()}
        assert got == pytest.approx(want)
    weights = {"text": 2.0, "title": 0.5}
    want = {r.document_uuid: r["rank"] for r in search.keyword(docs.drop("department"), "beta", weights).collect()}
    got = {r.document_uuid: r["rank"] for r in search_index.lookup(spark, path, "beta", weights, 7).where("rank > 0").collect()}
    assert got == pytest.approx(want)


def test_index_reads_the_words_folders_only(spark):
    docs, path = searchable(spark), io.scratch(spark, "index")
    search_index.write_index(docs, path, buckets=64)
    assert search_index.frequencies(spark, path, ["rare", "nowhere"]) == {"rare": 2}
    shown = plan(search_index.lookup(spark, path, "rare alpha"))
    for token in ("rare", "alpha"):
        assert f"PushedFilters: [IsNotNull(token), EqualTo(token,{token})" in shown and re.search(rf"bucket#\d+ = {search_index.bucket_of(token)}\)", shown)
    assert shown.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in shown and "Generate" not in shown
    # the rarest word's list is what is sent to the other one's
    assert shown.index("EqualTo(token,alpha)") < shown.index("EqualTo(token,rare)")


def test_index_of_an_empty_table_and_of_none(spark):
    docs, path = searchable(spark), io.scratch(spark, "index")
    search_index.write_index(docs.limit(0), path)
    assert search_index.keyword(docs, path, "alpha").count() == 0
    with pytest.raises(ValueError):
        search_index.write_index(docs.select("document_uuid"), path)


def test_search_takes_the_index(spark):
    docs = searchable(spark).withColumns({"archive_status": F.lit("ACTIVE"), "document_type": F.col("title"), "document_date": F.lit(None).cast("date"), "date_verified": F.lit(False), "healthcare_facility": F.lit(None)})
    path = io.scratch(spark, "index")
    search_index.write_index(docs, path)
    with_index, without = (search.search(docs, {"q": "alpha beta", "document_type": "alpha"}, i).select("document_uuid").collect() for i in (path, None))
    assert sorted(with_index) == sorted(without) and with_index  # equal ranks may differ in their last bits, and so in order


def store(spark):
    root = io.scratch(spark, "store")
    docs = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "document_uuid long, kind string")
    pages = spark.createDataFrame([(i % 40, i, None if i % 3 else "x") for i in range(200)], "document_uuid long, page int, note string")
    assert versioned.create(spark, root, {"docs": (docs, ["document_uuid"]), "pages": (pages, ["document_uuid"])}, 8) == 1
    return root, docs, pages


def ids(df):
    return sorted(r.document_uuid for r in df.collect())


def test_purge_is_one_version_of_all_tables(spark):
    root, docs, pages = store(spark)
    begun = versioned.read(spark, root, "pages")
    assert versioned.purge(spark, root, versioned.read(spark, root, "docs").where("kind = 'a'")) == 2
    assert ids(versioned.read(spark, root, "docs")) == list(range(1, 40, 2)) and ids(versioned.read(spark, root, "pages")) == sorted(i % 40 for i in range(200) if i % 2)
    # who began with the old version goes on with it
    assert ids(begun) == ids(pages) and ids(versioned.read(spark, root, "docs", 1)) == ids(docs)
    assert versioned.versions(spark, root) == [1, 2]
    assert versioned.purge(spark, root, docs) == 3 and versioned.read(spark, root, "pages").count() == 0 and versioned.read(spark, root, "pages").columns == pages.columns
    assert versioned.append(spark, root, {"pages": pages.limit(3)}) == 4 and versioned.read(spark, root, "pages").count() == 3


def test_a_write_that_fails_changes_nothing(spark):
    root, docs, pages = store(spark)
    broken = pages.withColumn("note", F.when(F.col("page") == 150, F.raise_error(F.lit("broken")).cast("string")).otherwise("new"))
    with pytest.raises(Exception, match="broken"):
        versioned.replace(spark, root, {"docs": (docs.withColumn("kind", F.lit("new")), None), "pages": (broken, None)})
    assert versioned.versions(spark, root) == [1]
    assert sorted(map(tuple, versioned.read(spark, root, "docs").collect())) == sorted(map(tuple, docs.collect()))
    assert ids(versioned.read(spark, root, "pages")) == ids(pages)
    assert versioned.vacuum(spark, root) > 0  # what the writer left of docs
    assert ids(versioned.read(spark, root, "docs")) == ids(docs) and ids(versioned.read(spark, root, "pages")) == ids(pages)


def test_writers_of_the_same_version_conflict(spark):
    root, docs, _ = store(spark)
    base = versioned.manifest(spark, root)
    new = spark.createDataFrame([(1, "first")], docs.schema)
    assert versioned.replace(spark, root, {"docs": (new, None)}, base) == 2
    with pytest.raises(versioned.Conflict):
        versioned.replace(spark, root, {"docs": (new.withColumn("kind", F.lit("second")), None)}, base)
    assert {r.kind for r in versioned.read(spark, root, "docs").where("document_uuid = 1").collect()} == {"first"}
    assert versioned.replace(spark, root, {"docs": (new.withColumn("kind", F.lit("second")), None)}) == 3  # from the new version


def test_replace_touches_its_buckets_only_and_twice_is_once(spark):
    root, _, pages = store(spark)
    before = versioned.manifest(spark, root)["tables"]["pages"]["parts"]
    new = spark.createDataFrame([(7, 900, "n"), (7, 901, None)], pages.schema)
    for _ in range(2):
        versioned.replace(spark, root, {"pages": (new, None)})
        rows = versioned.read(spark, root, "pages")
        assert sorted(r.page for r in rows.where("document_uuid = 7").collect()) == [900, 901]
        assert rows.count() == 200 - 5 + 2
    after = versioned.manifest(spark, root)["tables"]["pages"]["parts"]
    assert sum(before[b] != after[b] for b in before) == 1
    # by more columns than the buckets go by, rows with nulls too
    gone = spark.createDataFrame([(7, 900)], "document_uuid long, page int")
    versioned.replace(spark, root, {"pages": (None, gone)})
    assert [r.page for r in versioned.read(spark, root, "pages").where("document_uuid = 7").collect()] == [901]
    with pytest.raises(ValueError):
        versioned.replace(spark, root, {"pages": (None, gone.select("page"))})
    with pytest.raises(ValueError):
        versioned.read(spark, root, "none")


def test_vacuum_keeps_what_versions_read(spark):
    root, docs, _ = store(spark)
    for k in range(3):
        versioned.replace(spark, root, {"docs": (spark.createDataFrame([(k, "new")], docs.schema), None)})
    versioned.vacuum(spark, root, keep=2)
    assert versioned.versions(spark, root) == [3, 4] and versioned.read(spark, root, "docs", 3).count() == 40
    assert {r.kind for r in versioned.read(spark, root, "docs").where("document_uuid < 3").collect()} == {"new"}
    with pytest.raises(ValueError):
        versioned.read(spark, root, "docs", 1)


def paged(spark, order, part_rows=37):
    rng = random.Random(1)
    rows = [(i, None if rng.random() < 0.1 else dt.date(2020, 1, 1 + rng.randint(0, 9)), rng.choice(["a", "b", None])) for i in range(1000)]
    df, path = spark.createDataFrame(rows, "document_uuid long, day date, kind string"), io.scratch(spark, "paged")
    paging.write_pages(df, path, order, part_rows)
    want = [tuple(r) for r in df.orderBy(*[F.desc(c) if d else F.asc(c) for c, d in order]).collect()]
    return path, want


@pytest.mark.parametrize("order", [[("day", True), ("kind", True), ("document_uuid", True)], [("kind", False), ("day", True), ("document_uuid", False)]])
def test_pages_follow_each_other_through_the_whole_table(spark, order):
    path, want = paged(spark, order, 200)
    got, key, n = [], None, 0
    while rows := paging.page_after(spark, path, order, key, 150).collect():
        got += [tuple(r) for r in rows]
        key, n = paging.key_of(rows[-1], order), n + 1
    assert got == want and n == 7
    assert [tuple(r) for r in paging.page_number(spark, path, 4, 150).collect()] == want[450:600] and paging.page_number(spark, path, 8, 150).count() == 0
    assert paging.total(spark, path).first()["total"] == 1000


def test_a_late_page_reads_no_more_than_the_first(spark):
    order = [("day", True), ("document_uuid", True)]
    path, want = paged(spark, order)
    parts = paging.layout(spark, path).count()
    assert parts > 15

    def read(df):
        """Parts whose rows the scan gives out, by its filter on the partition column."""
        shown = plan(df)
        assert "PartitionFilters: [part" in shown
        folders = {r.f.split("/part=")[1].split("/")[0] for r in spark.read.parquet(f"{path}/rows").select(F.input_file_name().alias("f"), "part").distinct().collect()}
        inside = shown.split("PartitionFilters: [")[1].split("]")[0]
        return sum(f"= {p})" in inside or f"({p}," in inside or f",{p}," in inside or f",{p})" in inside for p in folders)

    first = paging.page_after(spark, path, order, None, 10)
    late = paging.page_after(spark, path, order, {"day": want[889][1], "document_uuid": want[889][0]}, 10)
    number = paging.page_number(spark, path, 90, 10)
    assert [tuple(r) for r in late.collect()] == want[890:900] == [tuple(r) for r in number.collect()]
    assert max(map(read, (first, late, number))) <= 2


def test_pages_of_an_empty_table(spark):
    path = io.scratch(spark, "paged")
    paging.write_pages(spark.createDataFrame([], "document_uuid long, day date"), path, [("document_uuid", True)])
    assert paging.total(spark, path).first()["total"] == 0


def rows_read(df):
    """How many rows the scan of a query without shuffles gives, once it has run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numOutputRows").get().value()


def test_history_reads_a_few_row_groups(spark):
    path = io.scratch(spark, "log")
    rows = spark.range(200_000).select(
        F.col("id").alias("uuid"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.pmod(F.xxhash64("id"), F.lit(2000))).alias("patient"), F.md5(F.col("id").cast("string")).alias("resource"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 5000).alias("created_at"),
    )
    io.append_events(rows, path, row_group_bytes=1 << 16)
    logs = spark.read.parquet(path)
    assert logs.count() == 200_000
    few = logs.where("patient = 1234").select("uuid")
    assert {r.uuid for r in few.collect()} == {r.uuid for r in rows.where("patient = 1234").collect()} and rows_read(few) < 20_000
    # a patient with a third of all rows lies in several files
    assert logs.where("patient = 7").select(F.input_file_name()).distinct().count() > 1
    digest = hashlib.md5(b"4711").hexdigest()
    one = logs.where(F.col("resource") == digest).select("uuid")
    assert [r.uuid for r in one.collect()] == [4711] and rows_read(one) < 20_000
    # a log without any of the keys, and one without rows
    bare = io.scratch(spark, "bare")
    io.append_events(rows.select("created_at"), bare)
    io.append_events(rows.select("created_at").limit(0), bare)
    assert spark.read.parquet(bare).count() == 200_000
