"""Quality rules as weak supervision, on DataFrame functions alone.

Rules vote good (1) or bad (-1) or abstain (0) on each document. Documents are counted by their
vote pattern (at most 3 ** rules patterns, however many documents), and expectation-maximisation
over the pattern counts, in one SQL aggregate expression, estimates the share of good documents and
what each rule votes on good and on bad ones. A document's posterior probability of being good, by
those rates, decides: kept if it is at least `min_posterior`. The base rule (too few words, or too
much repetition) rejects on its own.

Rows: a null or empty text has no words and fails the base rule; doc_id may be null or repeat
(each row is judged by itself); a posterior of exactly `min_posterior` keeps; a very long text is one
row, counted whole; an empty table gives an empty result. Columns of the input that
bear the name of a result don't matter: the result's columns are the feature columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Row
from pyspark.sql import functions as F

from .common import WORD, fresh, materialize, read_table, text_of, words_of

MIN_POSTERIOR = 0.5
ROUNDS = 40
#: Fixed values: (name, measure, votes bad if at least, votes good if below or never); otherwise the rule abstains. A text
#: that isn't bad in one way isn't thereby good: only the shapes of its words speak for it.
RULES = (
    ("word_length", "mean_word", 12.0, 9.0),
    ("odd_words", "odd_share", 0.30, 0.10),
    ("symbols", "symbol_share", 0.10, None),
    ("repeats", "repeat_share", 0.30, None),
    ("same_lines", "dup_line_share", 0.30, None),
    ("shouting", "shout_share", 0.15, None),
    ("bars", "bar_share", 0.15, None),
    ("stutter", "stutter_share", 0.15, None),
)
#: A word of letters (or a run of them, where words aren't set apart), with quotes and brackets around it and stops after it.
PLAIN_WORD = r"(?<![^\x20\x09-\x0D])[\"'(\[«„“]*+[\p{L}\p{M}'’、。，！？-]++[.,;:!?\"')\]»”…]*+(?![^\x20\x09-\x0D])"

#: Two capitals and later two exclamation marks before a word's first small letter. Neither run goes back, so a word is read once.
SHOUT = r"(?<![^\x20\x09-\x0D])(?:(?![A-Z]{2})[^\x20\x09-\x0Da-z])*+[A-Z]{2}(?:(?!!!)[^\x20\x09-\x0Da-z])*+!!"


def _once(value: Column, use) -> Column:
    """use(value), the value being computed once for a row although use names it many times."""
    return F.element_at(F.transform(F.array(value), use), 1)


def n_repeat_words(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more: windows sorted by hash lie beside their equals."""
    windows = F.when(F.size(words) >= 4, F.transform(
        F.sequence(F.lit(1), F.size(words) - 2),
        lambda i: F.struct(F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)).alias("h"), i.alias("i")),
    )).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))

    def found_again(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))

    return _once(F.array_sort(F.transform(_once(F.sort_array(windows), found_again), lambda x: x["i"])), lambda at: F.aggregate(
        F.transform(at, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3)))), F.lit(0).cast("long"), lambda acc, n: acc + n
    ))


def with_features(docs: DataFrame, into: str, text: str = "text") -> DataFrame:
    """docs with the struct column `into`: the base counts and the measures that the rules read."""
    body, name = text_of(text), fresh(docs, "_words")
    df = docs.withColumn(name, words_of(body))
    words, n = F.col(name), F.size(name)
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.rlike(x, F.lit(WORD)))
    counts = F.struct(
        n.cast("long").alias("n_words"),
        (F.length(body) - F.regexp_count(body, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _once(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        n_repeat_words(words).alias("n_repeat_words"),
        _once(lines, lambda x: F.size(x)).cast("long").alias("n_lines"),
        F.when(body.contains("!!"), F.regexp_count(body, F.lit(SHOUT))).otherwise(0).cast("long").alias("n_shouts"),
        F.regexp_count(body, F.lit(PLAIN_WORD)).cast("long").alias("n_plain_words"),
        F.regexp_count(body, F.lit(r"(?<![^\x20\x09-\x0D])\|(?![^\x20\x09-\x0D])")).cast("long").alias("n_bars"),
        F.regexp_count(body, F.lit(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]++\1(?![^\x20\x09-\x0D])")).cast("long").alias("n_stutters"),
    )
    return df.withColumn(into, counts).drop(name)


def measures(f: str) -> dict[str, Column]:
    c = lambda k: F.col(f"{f}.{k}")
    share = lambda x, of: F.when(of > 0, x / of)
    return {
        "mean_word": share(c("word_chars"), c("n_words")),
        "odd_share": share(c("n_words") - c("n_plain_words"), c("n_words")),
        "symbol_share": share(c("n_symbols"), c("word_chars")),
        "repeat_share": share(c("n_repeat_words"), c("n_words")),
        "dup_line_share": F.when(c("n_lines") > 1, c("n_dup_lines") / c("n_lines")),
        "shout_share": share(c("n_shouts"), c("n_words")),
        "bar_share": share(c("n_bars"), c("n_words")),
        "stutter_share": share(2 * c("n_stutters"), c("n_words")),
    }


def votes(f: str, rules=RULES) -> Column:
    """An array of a vote for each rule; a measure that is null abstains."""
    m = measures(f)
    return F.array(*[F.when(m[k] >= bad, -1).when(m[k] < good if good is not None else F.lit(False), 1).otherwise(0).cast("int") for _, k, bad, good in rules])


def fit(voted: DataFrame, column: str, n_rules: int = len(RULES), rounds: int = ROUNDS) -> Row | None:
    """prior (share of good) and rate[class][rule][vote + 1], by expectation-maximisation over counts of vote patterns.

    One row comes back to the driver. Rates are smoothed by one vote each; the start takes the majority of votes.
    None for an empty table.
    """
    patterns = voted.groupBy(F.col(column).alias("v")).agg(F.count("*").cast("double").alias("n"))
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("p"))  # at most 3 ** n_rules entries

    def posterior(v: Column, m: Column) -> Column:
        log = lambda k: F.aggregate(F.sequence(F.lit(0), F.lit(n_rules - 1)), F.lit(0.0), lambda acc, r: acc + F.ln(F.get(F.get(F.get(m["rate"], F.lit(k)), r), F.get(v, r) + 1)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.least(F.lit(700.0), log(0) + F.ln(1 - m["prior"]) - log(1) - F.ln(m["prior"]))))

    def model(weighted: Column) -> Column:
        """From patterns with q, the probability of good: prior and rates."""
        total = lambda of: F.aggregate(weighted, F.lit(0.0), lambda acc, x: acc + of(x))
        good, bad = lambda x: x["n"] * x["q"], lambda x: x["n"] * (1 - x["q"])

        def rates(share) -> Column:
            voted_so = lambda r, vote: total(lambda x: F.when(F.get(x["v"], r) == vote, share(x)).otherwise(0.0))
            of_rule = lambda r: F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda vote: (1.0 + voted_so(r, vote)) / (3.0 + total(share)))
            return F.transform(F.sequence(F.lit(0), F.lit(n_rules - 1)), of_rule)

        rate = F.array(rates(bad), rates(good))
        return F.struct(((1.0 + total(good)) / (2.0 + total(lambda x: x["n"]))).alias("prior"), rate.alias("rate"))

    def weigh(p: Column, q) -> Column:
        return F.transform(p, lambda x: F.struct(x["v"].alias("v"), x["n"].alias("n"), q(x).alias("q")))

    majority = lambda x: F.when(F.aggregate(x["v"], F.lit(0), lambda a, v: a + F.when(v < 0, 2 * v).otherwise(v)) > 0, 0.9).otherwise(0.1)
    start = one.where(F.size("p") > 0).select("p", model(weigh(F.col("p"), majority)).alias("m"))
    step = lambda m, _: _once(weigh(F.col("p"), lambda x: posterior(x["v"], m)), model)
    fitted = start.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.col("m"), step).alias("m")).select("m.*")
    return fitted.first()


def posterior_good(column: str, model: Row | None) -> Column:
    """Probability that a document with these votes is good."""
    if model is None:
        return F.lit(1.0)
    odds = F.lit(0.0)
    from math import log

    for r in range(len(model["rate"][0])):
        vote = F.get(F.col(column), F.lit(r))
        of = {v: log(model["rate"][1][r][v + 1]) - log(model["rate"][0][r][v + 1]) for v in (-1, 0, 1)}
        odds = odds + F.when(vote < 0, of[-1]).when(vote > 0, of[1]).otherwise(of[0])
    return 1.0 / (1.0 + F.exp(-(odds + log(model["prior"]) - log(1 - model["prior"]))))


def judge(docs: DataFrame, min_posterior: float = MIN_POSTERIOR, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with a struct column `_quality`: base counts, votes, base_failed, posterior, kept."""
    f = fresh(docs, "_quality")
    df = with_features(docs, f, text)
    if not keep_text:
        df = df.drop(text)
    rest = [c for c in df.columns if c != f]
    df = materialize(df.withColumn(f, F.col(f).withField("votes", votes(f))), "quality")
    failed = (F.col(f"{f}.n_words") < 50) | (100 * F.col(f"{f}.n_repeat_words") > 50 * F.col(f"{f}.n_words"))
    model = fit(df.where(~failed).select(F.col(f"{f}.votes").alias("votes")), "votes")
    p = posterior_good(f"{f}.votes", model)
    return df.select(*rest, F.col(f).withField("base_failed", failed).withField("posterior", p).withField("kept", ~failed & (p >= min_posterior)).alias("_quality" if f == "_quality" else f))


def keep_good(docs: DataFrame, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """The rows of docs that the rules keep."""
    judged = judge(docs, min_posterior)
    return judged.where(F.col(f"{judged.columns[-1]}.kept")).select(*docs.columns)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the base counts, the posterior probability of good and the verdict."""
    judged = judge(read_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    q = lambda k: F.col(f"_quality.{k}").alias(k)
    return judged.select("doc_id", *map(q, ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")))
