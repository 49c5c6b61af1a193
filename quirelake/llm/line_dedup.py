"""Line dedup by a log-template tree, in DataFrame operations.

A line's leaf in the fixed-depth tree is its number of tokens and its first DEPTH tokens; tokens
with a digit are variable fields from the start. Lines that are equal then and stand in `min_docs`
documents recur. Among the other lines of a leaf, a token is part of a template if `min_docs`
documents of the leaf have it in that place, and is a variable field otherwise; lines with the same
template, at least MIN_CONSTANT of it constant, recur if `min_docs` documents have them. Every
occurrence of a recurring line is dropped. Counts are summed before each shuffle, so a line that
fills the corpus is a few rows; the text moves once, to meet the list of its dropped lines. With
`pair_tokens`, lines of that many tokens recur from two documents on, and so do their leaves, tokens
and templates.

Rows: a null or empty text has no lines and stays as it is (null becomes empty); lines of fewer than
MIN_TOKENS tokens and blank lines stay; doc_id may be null or repeat: a document is known by doc_id
and text, so repeated rows are one document; a very long text is lines like any other, and a very long
line is one template; counts that are exactly at a limit recur; an empty table gives an empty result. Further columns
stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, id_text, materialize, read_table, text_of

DEPTH, MIN_TOKENS, MIN_DOCS, MIN_CONSTANT = 4, 3, 3, 0.5
MAX_BROADCAST = 1_000_000
#: From so many tokens on, op1_line_dedup_pairs lets a line recur in two documents.
PAIR_TOKENS = 20
FIELD = "<*>"


def document_key(text: str = "text") -> Column:
    return F.xxhash64(id_text(), text_of(text))


def tokens_of(line: Column) -> Column:
    """The line's tokens, those with a digit as variable fields; a blank line has one empty token."""
    # from a token's start only and without going back, so the work is linear in a token's length
    fields = F.regexp_replace(line, r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+", FIELD)
    return F.split(F.btrim(F.when(line.rlike("[0-9]"), fields).otherwise(line), F.lit(" \t\n\x0b\x0c\r")), SPACES, -1)


def lines_of(docs: DataFrame) -> DataFrame:
    """doc, n (the line's number), leaf, same (hash of the tokens) and tokens of every line that could be dropped."""
    lines = docs.select(document_key().alias("doc"), F.posexplode(F.split(text_of("text"), "\n", -1)).alias("n", "line"))
    tokens = lines.select("doc", "n", tokens_of(F.col("line")).alias("tokens")).where(F.size("tokens") >= MIN_TOKENS)
    leaf = F.xxhash64(F.size("tokens"), *[F.get("tokens", F.lit(i)) for i in range(DEPTH)])
    return tokens.select("doc", "n", leaf.alias("leaf"), F.xxhash64("tokens").alias("same"), "tokens")


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS, max_broadcast: int = MAX_BROADCAST, pair_tokens: int | None = None) -> DataFrame:
    """doc, n of each line whose template recurs."""
    # a leaf has one number of tokens: its last bit says in how many documents its lines have to be
    marked = F.col("leaf") if pair_tokens is None else F.shiftleft("leaf", 1).bitwiseOR((F.size("tokens") >= pair_tokens).cast("long"))
    need = F.lit(min_docs) if pair_tokens is None else F.when(F.col("leaf").bitwiseAND(F.lit(1)) == 1, F.least(F.lit(2), F.lit(min_docs))).otherwise(min_docs)
    slim = materialize(lines_of(docs).select("doc", "n", marked.alias("leaf"), "same"), "ld-lines")
    often = lambda df, *keys: df.groupBy(*keys).agg(F.count_distinct("doc").alias("docs")).where(F.col("docs") >= need).select(*keys)
    equal = materialize(often(slim, "leaf", "same"), "ld-equal")
    found = slim.join(equal.hint("merge"), ["leaf", "same"]).select("doc", "n")
    rest = materialize(slim.join(equal.hint("merge"), ["leaf", "same"], "left_anti").select("doc", "n", "leaf"), "ld-rest")
    open_lines = materialize(rest.join(often(rest, "leaf").hint("merge"), "leaf").select("doc", "n", "leaf"), "ld-open")

    # the tokens of these lines: only texts that have some are read into lines again
    wanted = materialize(open_lines.select("doc").distinct(), "ld-wanted")
    mark = F.broadcast if wanted.count() <= max_broadcast else (lambda df: df.hint("shuffle_hash"))
    texts = docs.select("doc_id", "text").join(mark(wanted), document_key() == F.col("doc"), "left_semi")
    lines = lines_of(texts).select("doc", "n", "tokens").join(open_lines.hint("merge"), ["doc", "n"])
    placed = materialize(lines.select("doc", "n", "leaf", F.posexplode("tokens").alias("at", "token")), "ld-tokens")
    fixed = often(placed.where(F.col("token") != FIELD), "leaf", "at", "token").withColumn("fixed", F.lit(1))
    known = placed.join(fixed.hint("merge"), ["leaf", "at", "token"], "left")
    code = F.xxhash64("at", F.when(F.col("fixed") == 1, F.col("token")).otherwise(FIELD))
    templates = known.distinct().groupBy("doc", "n", "leaf").agg(F.bit_xor(code).alias("template"), F.count("fixed").alias("fixed"), F.count("*").alias("tokens"))
    templates = materialize(templates.where(F.col("fixed") >= MIN_CONSTANT * F.col("tokens")).select("doc", "n", "leaf", "template"), "ld-templates")
    return found.union(templates.join(often(templates, "leaf", "template").hint("merge"), ["leaf", "template"]).select("doc", "n"))


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, max_broadcast: int = MAX_BROADCAST, pair_tokens: int | None = None) -> DataFrame:
    """A struct column `_row` with the columns of docs, and `_text`, `_n_lines`, `_n_dropped`."""
    dropped = recurring(docs, min_docs, max_broadcast, pair_tokens).groupBy(F.col("doc").alias("_doc")).agg(F.collect_set("n").alias("_drop"))
    dropped = materialize(dropped, "ld-dropped")
    rows = docs.select(F.struct("*").alias("_row"))
    key = F.xxhash64(F.coalesce(F.col("_row.doc_id").cast("string"), F.lit("")), text_of("_row.text"))
    met = rows.join(dropped.hint("shuffle_hash"), key == F.col("_doc"), "left")
    lines = F.split(text_of("_row.text"), "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.coalesce("_drop", F.array().cast("array<int>"))), lambda i: F.get("_lines", i))
    # no dropped line: the text as it is
    return met.withColumn("_lines", lines).select(
        "_row", F.when(F.col("_drop").isNull(), text_of("_row.text")).otherwise(F.array_join(kept, "\n")).alias("_text"),
        F.size("_lines").cast("long").alias("_n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("_n_dropped"),
    )


def clean(docs: DataFrame, min_docs: int = MIN_DOCS, pair_tokens: int | None = None) -> DataFrame:
    """docs with the recurring lines gone from text; its other columns as they are."""
    out = drop_recurring_lines(docs, min_docs, pair_tokens=pair_tokens)
    return out.select(*[F.col("_text").alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, how many of them recur and go, and the text that is left."""
    return _measured(drop_recurring_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op1_line_dedup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, but lines of PAIR_TOKENS tokens and more go from two documents on."""
    return _measured(drop_recurring_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"), pair_tokens=PAIR_TOKENS))


def _measured(out: DataFrame) -> DataFrame:
    return out.select("_row.doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.length("_text").cast("long").alias("kept_chars"), F.sha2("_text", 256).alias("kept_sha256"))


#: The same in DuckDB.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(CAST(doc_id AS VARCHAR), '') || chr(1) || coalesce(text, '') AS doc, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT DISTINCT doc, unnest(range(len(lines))) AS n, unnest(lines) AS line FROM d),
t AS (
  SELECT * FROM (SELECT doc, n, regexp_extract_all(regexp_replace(line, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[^\x20\x09-\x0D]+') AS w FROM l)
  WHERE len(w) >= 3),
leafed AS (SELECT doc, n, w, array_to_string(w, ' ') AS same, CAST(len(w) AS VARCHAR) || ' ' || array_to_string(w[1:4], ' ') AS leaf FROM t),
equal AS (SELECT same FROM leafed GROUP BY same HAVING count(DISTINCT doc) >= 3),
rest AS (SELECT * FROM leafed WHERE same NOT IN (SELECT same FROM equal)),
opened AS (SELECT * FROM rest WHERE leaf IN (SELECT leaf FROM rest GROUP BY leaf HAVING count(DISTINCT doc) >= 3)),
placed AS (SELECT doc, n, leaf, unnest(range(len(w))) AS spot, unnest(w) AS token FROM opened),
fixed AS (SELECT leaf, spot, token FROM placed WHERE token <> '<*>' GROUP BY ALL HAVING count(DISTINCT doc) >= 3),
templates AS (
  SELECT p.doc, p.n, p.leaf, string_agg(CASE WHEN f.token IS NULL THEN '<*>' ELSE p.token END, ' ' ORDER BY p.spot) AS template, count(f.token) AS fixed, count(*) AS tokens
  FROM placed p LEFT JOIN fixed f ON p.leaf = f.leaf AND p.spot = f.spot AND p.token = f.token GROUP BY ALL),
good AS (SELECT * FROM templates WHERE 2 * fixed >= tokens),
often AS (SELECT leaf, template FROM good GROUP BY ALL HAVING count(DISTINCT doc) >= 3),
gone AS (
  SELECT doc, n FROM leafed WHERE same IN (SELECT same FROM equal)
  UNION SELECT g.doc, g.n FROM good g JOIN often o ON g.leaf = o.leaf AND g.template = o.template),
per AS (SELECT doc, list(n) AS drops FROM gone GROUP BY doc),
kept AS (
  SELECT d.doc_id, CAST(len(d.lines) AS BIGINT) AS n_lines, CAST(coalesce(len(p.drops), 0) AS BIGINT) AS n_dropped,
         CASE WHEN p.drops IS NULL THEN array_to_string(d.lines, chr(10))
              ELSE array_to_string([d.lines[i + 1] FOR i IN range(len(d.lines)) IF NOT list_contains(p.drops, i)], chr(10)) END AS text
  FROM d LEFT JOIN per p ON d.doc = p.doc)
SELECT doc_id, n_lines, n_dropped, CAST(length(text) AS BIGINT) AS kept_chars, sha256(text) AS kept_sha256 FROM kept
"""

#: op1_line_dedup_pairs: a count of documents has its limit by the number of tokens, with which a leaf begins.
PAIRS_SQL = ORACLE_SQL.replace("GROUP BY same HAVING count(DISTINCT doc) >= 3", "GROUP BY same HAVING count(DISTINCT doc) >= CASE WHEN any_value(len(w)) >= 20 THEN 2 ELSE 3 END").replace(
    "HAVING count(DISTINCT doc) >= 3)", "HAVING count(DISTINCT doc) >= CASE WHEN CAST(split_part(leaf, ' ', 1) AS INTEGER) >= 20 THEN 2 ELSE 3 END)"
)
