"""Laboratory pages in several layouts, drawn from lineitem as positioned spans and parsed again; with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import labs
from ..sources import io
from . import driver_tables as D
from .register import query

PLACES = (0.05, 0.35, 0.55, 0.75)
#: Rows lie so far apart, and a cell is so high.
STEP, HEIGHT = 0.006, 0.003
PAGE_LINES = 250_000
CELLS = "array<struct<y:int,text:string,x_min:double,high:double>>"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines, numbered, with its status and priority and its number of lines."""
    orders = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_uuid"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    lines = D.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_uuid"), F.col("l_quantity").cast("int").alias("q"), F.col("l_partkey").alias("p"), "l_linenumber")
    lines = io.by_keys(lines, ["document_uuid"], PAGE_LINES)  # pages cost far more than lines weigh
    whole = Window.partitionBy("document_uuid")  # an order's lines
    lines = lines.withColumns({"r": F.row_number().over(whole.orderBy("l_linenumber", "p", "q")), "n": F.count("*").over(whole)})
    name = F.concat(F.lit("Part"), F.translate(F.col("p").cast("string"), "0123456789", "abcdefghij"))
    return lines.join(orders, "document_uuid").withColumns({"name": name, "result": F.col("q").cast("string"), "range": F.concat_ws("-", F.col("q").cast("string"), (F.col("q") + 9).cast("string"))})


def _cell(x: float, text: Column | str, row: Column, high: float = HEIGHT) -> Column:
    return F.struct(row.alias("y"), (F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit(x).alias("x_min"), F.lit(high).alias("high"))


def _spans(lines: DataFrame) -> DataFrame:
    """F: rows without a header. P: two panels side by side. O: a header, a section title, each line with a wrapped reference below it, a
    watermark across the first line, a repeated header and a line about the patient at the end."""
    r, n, first = F.col("r"), F.col("n"), F.col("r") == 1
    row = lambda at, *texts: [_cell(x, t, at) for x, t in zip(PLACES, texts)]
    head = lambda at: row(at, "Test", "Result", "Unit", "Reference Range")
    none = F.array().cast(CELLS)
    main = lambda at: row(at, F.col("name"), F.col("result"), "mg/dL", F.col("range"))
    more = F.concat(F.lit("Pre diabetic "), (F.col("q") + 10).cast("string"), F.lit(" - "), (F.col("q") + 19).cast("string"))
    once = F.when(first, F.array(*head(F.lit(0)), _cell(PLACES[0], "Chemistry", F.lit(1)), _cell(0.45, "مختبر", F.lit(2), 3 * HEIGHT), *head(2 * n + 3), _cell(PLACES[0], "Patient ID 123", 2 * n + 4))).otherwise(none)
    full = F.concat(F.array(*main(2 * r), _cell(PLACES[3], more, 2 * r + 1)), once)
    side, at = F.pmod(r - 1, F.lit(2)), F.floor((r + 1) / 2).cast("int")
    panel = F.when(side == 0, F.array(*row(at, F.col("name"), F.col("result")))).otherwise(F.array(_cell(PLACES[2], F.col("name"), at), _cell(PLACES[3], F.col("result"), at)))
    panel = F.concat(panel, F.when(first, F.array(*row(F.lit(0), "Test", "Result", "Test", "Result"))).otherwise(none))
    cells = F.when(F.col("status") == "F", F.array(*main(r))).when(F.col("status") == "P", panel).otherwise(full)
    rows = lines.select("document_uuid", "priority", "r", F.explode(cells.cast(CELLS)).alias("c")).select("document_uuid", "priority", "r", "c.*")
    # the sequence on the page, top down and from left to right
    number = F.row_number().over(Window.partitionBy("document_uuid").orderBy("y", "x_min", "text")) - 1
    # boxes come last: code that makes them for each cell is too long a method for the JVM to compile
    at, half = F.col("y") * STEP + 0.02, F.col("high") / 2
    return rows.select("document_uuid", F.lit(1).alias("page_number"), number.alias("sequence"), "text", F.lit(0.9).alias("confidence"), "x_min", (at - half).alias("y_min"), (F.col("x_min") + 0.1).alias("x_max"), (at + half).alias("y_max"), "priority", "r")


_GRID = """g AS (SELECT l_orderkey AS document_uuid, CAST(l_quantity AS INTEGER) AS q, 'Part' || translate(CAST(l_partkey AS VARCHAR), '0123456789', 'abcdefghij') AS name, o_orderstatus AS status, o_orderpriority AS priority,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CAST(l_quantity AS INTEGER)) AS INTEGER) AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
v AS (SELECT *, r - 1 AS row_index, CASE WHEN status = 'P' THEN '' ELSE 'mg/dL' END AS unit_raw,
  CASE status WHEN 'P' THEN '' WHEN 'F' THEN q || '-' || (q + 9) ELSE q || '-' || (q + 9) || ' Pre diabetic ' || (q + 10) || ' - ' || (q + 19) END AS reference_range_raw, CASE status WHEN 'F' THEN 0.765 ELSE 0.9 END AS confidence FROM g)"""


@query(f"WITH {_GRID} SELECT document_uuid, row_index, name AS test_name_raw, CAST(q AS VARCHAR) AS result_raw, unit_raw, reference_range_raw, confidence FROM v")
def lab_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without a header, with two panels, and with sections, watermarks, wrapped references and repeated headers."""
    found = labs.parse_pages(_spans(_lines(spark, sf_dir)).drop("priority", "r"))
    return found.select("document_uuid", "row_index", "test_name_raw", "result_raw", "unit_raw", "reference_range_raw", F.round("extraction_confidence", 6).alias("confidence"))


def _extracted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents of one priority are no laboratory's, those of status P are deleted; urgent ones have a box that is no number, high ones a confidence over 1."""
    lines = _lines(spark, sf_dir)
    docs = lines.where("r = 1").select("document_uuid", F.when(F.col("priority") == "5-LOW", "IMAGING").otherwise("LABORATORY").alias("document_type"), F.when(F.col("status") == "P", "DELETED").otherwise("ACTIVE").alias("archive_status"))
    spans = _spans(lines).withColumns({"y_min": F.when((F.col("priority") == "1-URGENT") & (F.col("sequence") == 1), "broken").otherwise(F.col("y_min").cast("string")), "confidence": F.when((F.col("priority") == "2-HIGH") & (F.col("sequence") == 0), 1.5).otherwise(F.col("confidence"))})
    spans = spans.drop("priority", "r")
    return *labs.extract(docs, spans), spans


@query(f"""WITH {_GRID} SELECT document_uuid, CASE WHEN priority IN ('1-URGENT', '2-HIGH') THEN 'FAILED' ELSE 'COMPLETED' END AS status, CASE WHEN priority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE count(*) END AS result_count,
  CASE WHEN priority IN ('1-URGENT', '2-HIGH') THEN NULL ELSE any_value(confidence) END AS confidence FROM v WHERE status <> 'P' AND priority <> '5-LOW' GROUP BY document_uuid, priority""")
def lab_page_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken pages fail alone; only active laboratory documents are looked at."""
    _, states, _ = _extracted(spark, sf_dir)
    return states.select("document_uuid", "status", "result_count", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {_GRID}, e AS (SELECT * FROM v WHERE status <> 'P' AND priority NOT IN ('1-URGENT', '2-HIGH', '5-LOW'))
SELECT document_uuid, row_index, unnest([name, CAST(q AS VARCHAR), 'mg/dL', q || '-' || (q + 9)]) AS text FROM e""")
def lab_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans that each result of these documents comes from."""
    results, _, spans = _extracted(spark, sf_dir)
    return labs.evidence(results, spans).select("document_uuid", "row_index", "text")
