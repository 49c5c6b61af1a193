"""Queries over written layouts: the inverted index, versioned tables, keyset pages; with their DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import archive, paging, search_index
from ..sources import io, versioned
from ..streaming import streams
from . import driver_tables as D
from .register import query


def _searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = D.table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("document_uuid"), "text", F.col("source").alias("title"), F.col("lang").alias("department"), F.lit(None).cast("date").alias("document_date"), F.lit(None).cast("timestamp").alias("created_at"))


def _words(column: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({column}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


#: (query, words): one frequent pair, one with a word of a short field, a single word, one that no document has
_SEARCHES = (("The and", "and the"), ("en, of THE", "en of the"), ("src1", "src1"), ("the nosuchwordanywhere", "nosuchwordanywhere the"))
_FIELDS = (("source", 1.0), ("lang", 0.2), ("text", 0.1))


def _search_sql(words: str, name: str) -> str:
    listed = ", ".join(f"'{w}'" for w in words.split())
    hits = ", ".join(f"list_filter({_words(c)}, lambda t: t IN ({listed})) AS h{i}, coalesce(length({c}), 0) AS n{i}" for i, (c, _) in enumerate(_FIELDS))
    rank = " + ".join(f"{w} * len(h{i}) / (1 + n{i} / 100.0)" for i, (_, w) in enumerate(_FIELDS))
    return f"SELECT '{name}' AS q, doc_id AS document_uuid, round({rank}, 6) AS rank FROM (SELECT doc_id, {hits} FROM documents) WHERE len(list_distinct(flatten([h0, h1, h2]))) = {len(words.split())}"


@query(" UNION ALL ".join(_search_sql(words, q) for q, words in _SEARCHES))
def keyword_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of all documents, and several searches that read their words' posting lists."""
    path, docs = io.scratch(spark, "index"), _searchable(spark, sf_dir)
    search_index.write_index(docs, path)
    found = [search_index.keyword(docs.select("document_uuid"), path, q).select(F.lit(q).alias("q"), "document_uuid", F.round("rank", 6).alias("rank")) for q, _ in _SEARCHES]
    return reduce(DataFrame.unionAll, found)


@query(f"SELECT token, count(*) AS documents FROM (SELECT DISTINCT doc_id, unnest(list_concat({_words('source')}, {_words('lang')}, {_words('text')})) AS token FROM documents) GROUP BY token")
def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each word of the index stands."""
    path = io.scratch(spark, "index")
    search_index.write_index(_searchable(spark, sf_dir), path)
    return spark.read.schema("token string, documents long, bucket int").parquet(f"{path}/terms").select("token", "documents")


ORDERS = "orders_ AS (SELECT o_orderkey AS document_uuid, o_orderstatus AS status, o_totalprice AS price FROM orders), pages_ AS (SELECT l_orderkey AS document_uuid, l_linenumber AS page_number, l_quantity AS amount FROM lineitem)"


def _store(spark: SparkSession, sf_dir: str) -> str:
    """Documents, pages and their parts as one store at version 1."""
    root = io.scratch(spark, "store")
    docs = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_uuid"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    lines = D.table(spark, sf_dir, "lineitem")
    pages = lines.select(F.col("l_orderkey").alias("document_uuid"), F.col("l_linenumber").alias("page_number"), F.col("l_quantity").alias("amount"))
    results = lines.select(F.col("l_orderkey").alias("document_uuid"), F.lit("v1").alias("pipeline_version"), F.col("l_extendedprice").alias("result"))
    versioned.create(spark, root, {"documents": (docs, ["document_uuid"]), "pages": (pages, ["document_uuid"]), "results": (results, ["document_uuid"])}, buckets=16)
    return root


def _counted(tables: dict) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n"), F.count_distinct("document_uuid").alias("documents")).select(F.lit(k).alias("name"), "n", "documents") for k, df in tables.items()]
    return reduce(DataFrame.unionAll, parts)


@query(f"""WITH {ORDERS}, gone AS (SELECT document_uuid FROM orders_ WHERE status = 'P')
SELECT 'documents before' AS name, count(*) AS n, count(DISTINCT document_uuid) AS documents FROM orders_ UNION ALL SELECT 'documents', count(*), count(DISTINCT document_uuid) FROM orders_ WHERE status <> 'P'
UNION ALL SELECT 'pages before', count(*), count(DISTINCT document_uuid) FROM pages_ UNION ALL SELECT 'pages', count(*), count(DISTINCT document_uuid) FROM pages_ WHERE document_uuid NOT IN (FROM gone)
UNION ALL SELECT 'results before', count(*), count(DISTINCT document_uuid) FROM pages_ UNION ALL SELECT 'results', count(*), count(DISTINCT document_uuid) FROM pages_ WHERE document_uuid NOT IN (FROM gone)""")
def purge_versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One status' documents purged from three tables as one version, and all three as they were before."""
    root = _store(spark, sf_dir)
    docs = versioned.read(spark, root, "documents")
    version = versioned.purge(spark, root, docs.where("status = 'P'"))
    names = ("documents", "pages", "results")
    return _counted({f"{t} before": versioned.read(spark, root, t, 1) for t in names} | {t: versioned.read(spark, root, t, version) for t in names})


@query(f"""WITH {ORDERS}, r AS (SELECT l_orderkey AS document_uuid, l_extendedprice AS result, o_orderstatus AS status, l_quantity AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT document_uuid, 'v1' AS pipeline_version, result FROM r WHERE status <> 'F' UNION ALL SELECT document_uuid, 'v1', -result FROM r WHERE status = 'F' AND amount > 25 UNION ALL SELECT document_uuid, 'v2', 2 * result FROM r WHERE status = 'P'""")
def results_versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of one status' documents replaced by fewer, twice over; another pipeline version's rows come beside them."""
    root = _store(spark, sf_dir)
    lines = D.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_uuid"), F.col("l_extendedprice").alias("result"), F.col("l_quantity").alias("amount"))
    rows = lines.join(versioned.read(spark, root, "documents").select("document_uuid", "status"), "document_uuid")
    done = rows.where("status = 'F' AND amount > 25").select("document_uuid", F.lit("v1").alias("pipeline_version"), F.negative("result").alias("result"))
    gone = versioned.read(spark, root, "documents").where("status = 'F'").select("document_uuid", F.lit("v1").alias("pipeline_version"))
    for _ in range(2):
        versioned.replace(spark, root, {"results": (done, gone)})
    versioned.append(spark, root, {"results": rows.where("status = 'P'").select("document_uuid", F.lit("v2").alias("pipeline_version"), (2 * F.col("result")).alias("result"))})
    return versioned.read(spark, root, "results")


_PAGED = f"""WITH {D.DOCS}, o AS (SELECT document_uuid, row_number() OVER (ORDER BY coalesce(CASE WHEN date_verified THEN document_date END, CAST(created_at AS DATE)) DESC, created_at DESC, document_uuid DESC) AS rn, count(*) OVER () AS total
  FROM docs WHERE archive_status = 'ACTIVE')
SELECT (rn - 1) // 20 + 1 AS page, document_uuid, total FROM o WHERE (rn - 1) // 20 < 4 OR (rn - 1) // 20 + 1 IN (total // 40, total // 40 + 1)"""


@query(_PAGED)
def keyset_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four pages, each found by the last key of the one before, a page in the middle by its number, and the one behind that."""
    path = io.scratch(spark, "pages")
    docs = archive.active(D.documents(spark, sf_dir)).withColumn("sort_date", archive.effective_sort_date())
    paging.write_pages(docs.select("document_uuid", "sort_date", "created_at"), path, paging.CHRONOLOGY, part_rows=5000)
    n = paging.total(spark, path).first()["total"]
    out, key = [], None
    for number in (1, 2, 3, 4):
        page = paging.page_after(spark, path, paging.CHRONOLOGY, key)
        out.append(page.withColumn("page", F.lit(number)))
        key = paging.key_of(page.collect()[-1], paging.CHRONOLOGY)  # a page's rows
    middle = paging.page_number(spark, path, n // 40)
    key = paging.key_of(middle.collect()[-1], paging.CHRONOLOGY)
    out += [middle.withColumn("page", F.lit(n // 40)), paging.page_after(spark, path, paging.CHRONOLOGY, key).withColumn("page", F.lit(n // 40 + 1))]
    return reduce(DataFrame.unionAll, out).select("page", "document_uuid", F.lit(n).alias("total"))


DAY = 86_400


@query(f"""WITH {D.SERIES}, s AS (SELECT service, metric, ts, value FROM series WHERE ts <= (SELECT max(ts) FROM points) - {10 * DAY}),
r AS (SELECT *, ts - lag(ts) OVER w AS dt, value - lag(value) OVER w AS dv FROM s WINDOW w AS (PARTITION BY service, metric ORDER BY ts))
SELECT service, metric, ts, round(greatest(0.0, dv / dt * 1024), 6) AS value FROM r WHERE dt > 0""")
def stream_settled_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events in four turns of a quarter of the time each, some rows a turn late and some far too late; the stream is stopped after
    every turn and begun again from its checkpoint. What the watermark has passed equals the rates of all points in order."""
    path, points = io.scratch(spark, "settled"), D.points(spark, sf_dir)
    begin, end = points.agg(F.min("ts"), F.max("ts")).first()
    quarter = F.least(F.lit(3), F.floor((F.col("ts") - begin) * 4 / F.lit(end - begin + 1))).cast("int")
    # a service's points come a turn late, but never more than ten days
    late = (F.col("service") == "error").cast("int")
    dealt = points.withColumns({"ts": F.col("ts").cast("long"), "value": F.col("value").cast("double"), "arrival": F.col("arrival").cast("long")}).withColumn("file", F.least(F.lit(3), quarter + late))
    too_late = dealt.where("file = 0").withColumns({"value": F.lit(-1.0), "arrival": F.col("arrival") + 1_000_000_000, "file": F.lit(3)})
    dealt = dealt.unionByName(too_late)
    columns = ["service", "metric", "ts", "value", "arrival"]
    schema = "service string, metric string, ts long, value double, arrival long"
    for file in range(4):
        dealt.where(F.col("file") == file).select(*columns).write.mode("append").parquet(f"{path}/points")
        rates = streams.settled_rates(streams.read_points(spark, f"{path}/points", schema), f"{10 * DAY} seconds", 400 * DAY)
        streams.run(rates, f"{path}/state", lambda df, n: df.write.mode("overwrite").parquet(f"{path}/rates/{n}"))
    return spark.read.schema(streams.POINT).parquet(f"{path}/rates/*").withColumn("value", F.round("value", 6))
