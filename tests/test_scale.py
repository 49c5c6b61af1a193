"""What a query costs as its tables grow: shuffles, files, tasks and rows a task, seen in plans and on small tables."""

import hashlib

from pyspark.sql import functions as F

from quirelake.operators import dates, identity, labs, narrative, search_index
from quirelake.plans import lab_layouts, registry
from quirelake.sources import io
from quirelake.streaming import streams

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_result_tables_are_parsed_behind_one_shuffle(spark, monkeypatch):
    monkeypatch.setattr(labs.io, "written", lambda *a: (_ for _ in ()).throw(AssertionError("nothing is written on the way")))
    spans = lab_layouts._spans(lab_layouts._lines(spark, SF)).drop("priority", "r")
    assert plan(labs.parse_pages(spans)).count("Exchange hashpartitioning") - plan(spans).count("Exchange hashpartitioning") <= 1


def test_result_tables_are_parsed_by_compiled_code(spark):
    spans = lab_layouts._spans(lab_layouts._lines(spark, SF)).drop("priority", "r")
    parsed = labs.parse_pages(spans)
    # a generator with a lambda function in it is interpreted as a whole
    assert not [x for x in plan(parsed).splitlines() if "Generate inline(" in x and "lambdafunction" in x.split("],")[0]]
    # header lines come along with the first line of their page, so lines are shuffled once and spans never
    assert plan(labs.parse_pages(registry._spans(spark, SF))).count("Exchange hashpartitioning") == 1
    # the JVM doesn't compile methods of over 8,000 bytes
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        told = spark._jvm.PythonSQLUtils.explainString(labs.parse_pages(lab_layouts._spans(lab_layouts._lines(spark, SF)).drop("priority", "r"))._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(x.split("maxMethodCodeSize:")[1].split(";")[0]) for x in told.splitlines() if "maxMethodCodeSize:" in x]
    assert sizes and max(sizes) < 8000


def test_rows_that_creep_down_a_page_are_parted_by_their_mean(spark):
    at = [0.1 + 0.0006 * i for i in range(12)] + [0.3, 0.3, 0.3004]
    rows, mean = [], []
    for n, y in enumerate(at):  # by the rule: near the mean of the last row, or a new one
        if rows and abs(y - sum(mean) / len(mean)) <= 0.001 * labs.TOLERANCE:
            rows[-1].append(n), mean.append(y)
        else:
            rows.append([n])
            mean = [y]
    spans = spark.createDataFrame([("x", 1, n, str(n), 0.9, 0.01 * n, y - 0.0005, 0.01 * n + 0.1, y + 0.0005) for n, y in enumerate(at)], "document_uuid string, page_number int, sequence int, text string, confidence double, x_min double, y_min double, x_max double, y_max double")
    found = labs.group_rows(labs.shaped(spans)).select(F.transform("rows", lambda r: F.transform(r, lambda c: c["sequence"])).alias("rows")).first()["rows"]
    assert found == rows and len(rows) > 2


def test_rows_keep_their_order_and_lines_without_a_place_stand_alone(spark):
    at = [(0, "b", 0.5, 0.1), (1, "a", 0.1, 0.102), (2, "c", 0.1, 0.2), (3, "lost", 0.1, None), (4, "d", 0.3, 0.203)]
    spans = spark.createDataFrame([("x", 1, n, f" {t} ", 0.9, x, y, x + 0.1, None if y is None else y + 0.01) for n, t, x, y in at], "document_uuid string, page_number int, sequence int, text string, confidence double, x_min double, y_min double, x_max double, y_max double")
    rows = labs.group_rows(labs.shaped(spans)).select(F.transform("rows", lambda r: F.transform(r, lambda c: c["text"])).alias("rows")).first()["rows"]
    assert rows == [["lost"], ["a", "b"], ["c", "d"]]


def test_blobs_are_written_and_scanned_by_tasks(spark, tmp_path):
    docs = spark.createDataFrame([(i, None if i == 7 else "é" * i) for i in range(50)], "doc_id long, text string")
    io.write_blobs(docs, str(tmp_path), "doc_id", "text", folders=4)
    assert len({p.parent for p in tmp_path.glob("*/doc_id=*")}) <= 4 and len(list(tmp_path.glob("*/doc_id=*"))) == 50
    found = {r["key"]: (r["length"], r["content_sha256"]) for r in io.scan_blobs(spark, str(tmp_path)).collect()}
    assert found == {str(i): (len(b), hashlib.sha256(b).hexdigest()) for i in range(50) for b in [("" if i == 7 else "é" * i).encode() + b"\n"]}


def test_a_large_part_is_written_by_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20000")
    try:
        io.replace_results(spark.range(60_000, numPartitions=8).selectExpr("id AS document_uuid", "uuid() AS result"), str(tmp_path / "t"), "v1", buckets=1)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list(tmp_path.glob("t/*/bucket=0/*.parquet"))) > 1
    assert spark.read.parquet(str(tmp_path / "t")).select("document_uuid").distinct().count() == 60_000


def test_tasks_grow_in_number_with_the_rows(spark, tmp_path):
    assert io.spread(spark.range(1000), 10) == 100 and io.by_keys(spark.range(1000), ["id"], 10).rdd.getNumPartitions() == 100
    io.replace_current(spark.range(10).withColumn("x", F.lit(1)), str(tmp_path / "s"))
    assert "REPARTITION_BY_NUM" in plan(io.read_current(spark, str(tmp_path / "s"), ["id"]))
    assert "REPARTITION_BY_NUM" in plan(io.latest_sets(spark.read.parquet(str(tmp_path / "s")), ["id"]))


def test_lines_meet_their_record_before_they_are_sorted(spark):
    got = plan(identity.number_fields(spark.createDataFrame([(1, 0, "male")], "record long, line_no int, text string")))
    assert got.count("Exchange") == 1 and "REPARTITION_BY_NUM" in got


def test_dates_are_found_once_for_a_scorecard(spark, monkeypatch):
    calls, whole = [], io.written
    monkeypatch.setattr(registry.io, "written", lambda df, name: calls.append(name) or whole(df, name))
    registry.QUERIES["date_scorecard"](spark, SF)
    assert calls == ["dates"]


def test_pages_are_dealt_to_tasks_before_dates_are_looked_for(spark, monkeypatch):
    monkeypatch.setattr(registry, "TASK_PAGES", 100)
    pages = registry._dated_pages(spark, SF)
    assert pages.rdd.getNumPartitions() == -(-pages.count() // 100) > 4
    below = plan(registry.QUERIES["date_suggested"](spark, SF)).split("Exchange")[-1]
    assert "orders.parquet" in below and "regexp_replace" not in below


def test_a_date_is_taken_apart_once(spark):
    parsed = dates._parsed(F.col("m"), *dates.RULES[1])
    df = spark.createDataFrame([((3, "05/04/1997"),), ((0, "31/12/1997"),), ((0, "31/02/1997"),)], "m struct<start:int,m:string>").select(parsed.alias("x"))
    assert plan(df).count("regexp_extract(") == 3
    got = [(x["start"], x["end"], x["value"], str(x["day"]), str(x["other"])) for x, in df.collect()]
    assert got == [(3, 13, "05/04/1997", "1997-04-05", "1997-05-04"), (0, 10, "31/12/1997", "1997-12-31", "None"), (0, 10, "31/02/1997", "None", "None")]


def test_waiting_points_are_blocks(spark):
    import pandas as pd

    class Handle:
        timers, lists = [], []
        getValueState = lambda self, *a: None
        getListState = lambda self, *a: self
        appendList = lambda self, rows: self.lists.extend(rows)
        registerTimer = lambda self, at: self.timers.append(at)

    rates, handle = streams.CounterRates(10), Handle()
    rates.init(handle)
    list(rates.handleInputRows(("a", "b"), iter([pd.DataFrame({"ts": range(5, 1005), "arrival": range(1000), "value": 1.0})]), None))
    assert len(handle.lists) == 1 and handle.timers == [5000]


def test_words_are_counted_in_their_row_without_a_shuffle(spark):
    texts = [(i, "src", None if i % 7 == 0 else f"a b a, w{i} É-é") for i in range(1203)]
    docs = spark.createDataFrame(texts, "document_uuid long, title string, text string")
    found = search_index.postings(docs)
    assert "Exchange" not in plan(found)
    got = sorted(tuple(r) for r in found.where("document_uuid IN (0, 1202)").collect())
    share = 1 / (1 + len(texts[1202][2]) / 100)
    assert got == [("a", 1202, None, 2 * share), ("b", 1202, None, share), ("src", 0, 1 / 1.03, None), ("src", 1202, 1 / 1.03, None), ("w1202", 1202, None, share), ("é", 1202, None, 2 * share)]


def test_a_folder_of_the_index_is_several_tasks_where_there_are_many_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "TASK_DOCUMENTS", 10)
    docs = spark.range(40).selectExpr("id AS document_uuid", "'all' AS text")
    search_index.write_index(docs, str(tmp_path / "i"), buckets=2)
    assert len(list(tmp_path.glob("i/postings/bucket=*/*.parquet"))) == 4
    # rows with one id are one document
    search_index.write_index(docs.union(docs), str(tmp_path / "j"), buckets=2)
    assert search_index.frequencies(spark, str(tmp_path / "j"), ["all"], 2) == {"all": 40}
    assert {round(r["rank"], 9) for r in search_index.lookup(spark, str(tmp_path / "j"), "all", buckets=2).collect()} == {round(0.2 / 1.03, 9)}


def test_an_index_shuffles_a_row_for_a_word_of_many_documents(spark, tmp_path):
    docs = spark.range(2000, numPartitions=2).selectExpr("id AS document_uuid", "'  ' AS title", "concat('-the cat', id % 4, ' the ') AS text")
    listed = search_index._listed(docs, ["title", "text"], 1)
    assert {r["token"]: (r["n"], r["documents"]) for r in listed.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.size("postings")).alias("documents")).collect()} == {
        "the": (2, 2000), "cat0": (2, 500), "cat1": (2, 500), "cat2": (2, 500), "cat3": (2, 500)}
    search_index.write_index(docs, str(tmp_path / "i"), buckets=2)
    for file in (tmp_path / "i" / "postings").glob("*/*.parquet"):
        words = spark.read.parquet(str(file)).coalesce(1).select("token", "document_uuid").collect()
        assert words == sorted(words)
    found = {r["document_uuid"]: round(r["rank"], 9) for r in search_index.lookup(spark, str(tmp_path / "i"), "the cat3", buckets=2).collect()}
    assert found == {i: round(0.3 / 1.14, 9) for i in range(3, 2000, 4)}


def test_a_pattern_is_looked_for_once_in_a_text(spark):
    df = spark.createDataFrame([("12345678 \x01a 87654321",), ("12345678",), ("",), (None,)], "text string")
    places = df.select(dates.found_at(F.col("text"), dates.COMPACT).alias("x"))
    assert plan(places).count(dates.COMPACT) == 1
    assert [r["x"] and [tuple(m) for m in r["x"]] for r in places.collect()] == [[(0, "12345678"), (12, "87654321")], [(0, "12345678")], [], None]
    lines = spark.createDataFrame([("date of birth date \x01 Issued: x",), ("printed",), ("undated",), (None,)], "line string")
    labels = lines.select(dates.label_matches(F.col("line")).alias("x"))
    assert plan(labels).count(dates._LABEL) == 1
    assert [r["x"] and [tuple(m) for m in r["x"]] for r in labels.collect()] == [[(0, "date of birth"), (8, "birth date"), (14, "date"), (21, "issued")], [(0, "printed")], [], None]


def test_days_that_are_none(spark):
    days = [("1997", "2", "29"), ("1996", "2", "29"), ("1997", None, "5"), ("1997", "13", "1"), ("0000", "1", "1"), ("1997", "0", "1"), ("1997", "1", "\u0967")]
    got = spark.createDataFrame(days, "y string, m string, d string").select(dates.valid_date(F.col("y"), F.col("m"), F.col("d")).cast("string").alias("x"))
    assert [r["x"] for r in got.collect()] == [None, "1996-02-29", None, None, None, None, None]


def test_documents_are_dealt_to_tasks_before_their_lines_are_looked_at(spark, monkeypatch):
    monkeypatch.setattr(narrative, "TASK_LINES", 10)
    lines = spark.range(200, numPartitions=1).selectExpr("id div 4 AS document_uuid", "1 AS page_number", "int(id % 4) AS sequence", "if(id % 4 = 0, 'Findings', concat('a line of text, number ', id)) AS text", "0.9 AS confidence", "id % 4 / 10 AS y_min", "id % 4 / 10 + 0.09 AS y_max")
    got = narrative.sections(lines)
    assert "REPARTITION_BY_NUM" in plan(got) and plan(got).count("Exchange") == 1 and "RLIKE" not in plan(got).split("Exchange")[1]
    assert narrative.body_lines(narrative.io.by_keys(lines, ["document_uuid"], narrative.TASK_LINES)).rdd.getNumPartitions() == 20
    assert got.count() == 50


def test_every_word_of_the_noise_is_noise_whatever_its_case(spark):
    listed = [p[p.rindex("(", 0, p.rindex("|")) + 1 : p.rindex(")")].replace(r"\.?", ".").replace(r"\.", ".").split("|") for p in narrative.NOISE[6:]]
    assert [len(x) for x in listed] == [29, 16, 10]
    words = [form for x in listed for w in x for form in (w, w.lower(), w.title())]
    lines = spark.createDataFrame([(f"a x {w} y b", True) for w in words] + [(f"aa x{w}x bb", False) for x in listed[1:] for w in x] + [("ordinary text of a report", False)], "text string, noise boolean")
    assert lines.where(narrative.is_noise(F.col("text")) != F.col("noise")).collect() == []
