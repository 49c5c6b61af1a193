"""Result tables from positioned text spans, as one job over all pages.

Spans (document_uuid, page_number, sequence, text, confidence, x_min, y_min, x_max, y_max) are looked
at one by one first: what depends on a text alone becomes bits of its cell. They become
rows by a fold over each page's spans in order of height; from there on a row is an array of cells
and everything is a column expression. A page is a group of some hundred spans at most, and pages
are the unit of parallelism; nothing else is ever grouped. Lambda functions are interpreted, so they
see numbers where they can, and what they are for only in a rare row stands behind a test that is compiled.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_test, normalize_unit
from ..sources import io
from .quality import box_ok

PAGE = ("document_uuid", "page_number")
TOLERANCE, NOISE_HEIGHT, NO_HEADER = 0.6, 1.6, 0.85
#: Header cells, the column that each stands for, section titles, units and special results.
HEADER_CUES = {
    **dict.fromkeys(("item", "test", "tests", "parameter", "analysis", "component"), "TEST"),
    **dict.fromkeys(("result", "results", "value", "values"), "RESULT"),
    **dict.fromkeys(("unit", "units"), "UNIT"),
    **dict.fromkeys(("flags", "flag"), "FLAG"),
    **dict.fromkeys(("low", "low/high"), "REF_LOW"),
    "high": "REF_HIGH",
    **dict.fromkeys(
        ("reference", "reference range", "reference range (adult)", "reference range (adult male)", "ref range", "ref. range",
         "referencerange", "ref", "range", "normal range", "normal", "normal value"), "REFERENCE"),
    "investigation": "OTHER",
}
SECTION_CUES = (
    "chemistry", "diabetes profile", "lipid profile", "liver profile", "liver function", "renal function", "kidney profile", "kidney function",
    "renal profile", "vitamins", "hormones", "pituitary hormones", "thyroid hormones", "thyroid profile", "tumor markers", "tumour markers",
    "haematology", "hematology", "cbc", "full blood count", "fbc", "coagulation", "serology", "immunology", "electrolytes", "bone profile",
    "iron studies", "protein", "cardiac markers", "urinalysis",
)
KNOWN_UNITS = (
    "mg/dl", "mg/ml", "ng/ml", "ng/dl", "g/dl", "g/l", "ug/dl", "ug/ml", "pg/ml", "pg/dl", "u/l", "iu/l", "muiu/ml", "uiu/ml", "uiu/l",
    "miu/l", "miu/ml", "u/ml", "iu/ml", "%", "µl", "ul", "fl", "mmol/l", "umol/l", "nmol/l", "pmol/l", "mmol/ml", "meq/l", "mcg/dl", "mm/h",
    "mg", "ng", "pg", "g", "ug", "u", "iu", "x10^3/µl", "x10^3/ul", "x103/µl", "x103/ul", "x106/µl", "10^3/µl", "10^3/ul", "cells/µl",
    "cells/ul", "u/dl", "u/", "g/100ml",
)
SPECIAL_RESULTS = ("negative", "positive", "detected", "not detected", "indeterminate", "trace", "none", "nil", "pending", "see comment")
#: Patterns of rows that are no results, of cells, and of lines that carry on a reference range.
METADATA = (
    r"(?iU)^\s*(patient id|patient|name|ref\.?\s*by|requested|reported|age/sex|age|sex|specimen id|specimen|test:|sequence|location|physician|comments|gender|date of birth|collection|run date/time|printed|doctor|dr\.?|reviewed by|phone|tel\.?|mobile|身份证)\b",
    r"(?iU)\b(ISO|IS0)\s*15189\b",
    r"(?U)^\s*\d{1,2}/\d{1,2}/\d{2,4}\s*$",
    r"(?U)^\s*\d{1,2}-\d{1,2}-\d{2,4}\s*$",
    r"(?U)^\s*\+?\d{7,}\s*$",
    r"(?iU)^\s*(id|no\.?|no)\s*[:#]?\s*\d+(\s|$)",
    r"(?iU)^\s*(ref\.?\s*by|dr\.?|d\.?r\.?)\s",
    r"(?U)^\s*[أ-ي]{2,}\s*$",
)
CONTINUATION = r"(?iU)^\s*(normal|reference|ref|n\.?v|pre|post|borderline|optimal|deficiency|insufficiency|sufficiency|toxicity|diabetic|adult|child|age|\d+\s*(?:year|years|y|yr|mo|m|d)|<|>|≤|≥|up to|less than|greater than|high|low|normal range)"
FLAG = r"(?i)^[hlr*]{1,2}$"
UNIT_SHAPE = r"(?iU)^(?:x10\^?\d*/?[a-zµμ%]*|10\^?\d*/?[a-zµμ%]*|[a-zµμ%]+/[a-zµμ%]+|[a-zµμ%]{1,3}|%)$"
UNIT_LENIENT = r"^[a-zA-Zµμ×x0-9/^%·.\-]{1,10}$"
DECIMAL = r"(?U)^[+-]?\d{1,6}(?:[.,]\d{1,4})?$"
PHONE = r"(?U)^\+?\d{7,}(?:[\s-]\d+)*$"
RANGE = r"(?U)^(<?\s*(\d+(?:[.,]\d+)?))\s*-\s*(>?\s*(\d+(?:[.,]\d+)?))$"
RANGE_ANYWHERE = r"(?U)\d+(?:[.,]\d+)?\s*[-–]\s*<?\s*\d+(?:[.,]\d+)?"
THRESHOLD = r"(?U)^(<|<=|>|>=|≤|≥)\s*(\d+(?:[.,]\d+)?)$"


def _norm(low: Column) -> Column:
    """Of a trimmed text in lower case."""
    full = F.trim(F.regexp_replace(F.regexp_replace(low, "[^a-z0-9أ-ي ]+", " "), r"\s+", " "))
    return F.when(low.rlike("[^a-z0-9أ-ي ]|  "), full).otherwise(low)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once (instead of those of the same name): they pass a generator of one row, which no later filter or projection is merged with.

    They are computed before it, as a generator with a lambda function in it is interpreted as a whole.
    """
    kept = [c for c in df.columns if c not in columns]
    made = df.select(*kept, *[c.alias(f"_once_{k}") for k, c in columns.items()])
    return made.select(*kept, F.inline(F.array(F.struct(*[F.col(f"_once_{k}").alias(k) for k in columns]))))


def is_flag(text: Column) -> Column:
    return (F.length(text) <= 4) & text.rlike(FLAG)


def is_unit(text: Column) -> Column:
    key = F.replace(F.lower(F.trim(text)), F.lit(" "), F.lit(""))
    return key.isin(*KNOWN_UNITS) | ((F.length(key) <= 4) & key.rlike(UNIT_SHAPE))


def is_like_unit(text: Column) -> Column:
    """A cell that may be a unit, if it has a digit or one of these signs."""
    return (F.length(text) <= 12) & text.rlike(UNIT_LENIENT)


def header_meaning(normed: Column) -> Column:
    """What a header cell's column holds, by its text in _norm's form; null if the cell is none. Short cells may be one edit away from a cue."""
    exact = F.lit(None).cast("string")
    for meaning in dict.fromkeys(HEADER_CUES.values()):
        exact = F.when(normed.isin(*[c for c, m in HEADER_CUES.items() if m == meaning]), meaning).otherwise(exact)
    near = F.lit(None).cast("string")
    for cue, meaning in reversed([x for x in HEADER_CUES.items() if len(x[0]) <= 9]):  # the first in order counts; one edit changes a length by one at most
        # an edit of the first letter leaves the others, any other edit leaves the first
        alike = F.length(normed).between(len(cue) - 1, len(cue) + 1) & (normed.startswith(cue[0]) | normed.endswith(cue[1:])) & (F.levenshtein(F.lit(cue), normed, 1) >= 0)
        near = F.when(alike, meaning).otherwise(near)
    # a cue has three letters or more, so what is one edit away has two
    short = F.length(normed).between(2, 8) & normed.rlike("[a-z].*[a-z]")
    return F.coalesce(exact, F.when(short, near))


def _sorted(xs: str) -> Column:
    """An array column in ascending order, nulls last."""
    ordered = F.sort_array(xs)
    return F.when(F.get(ordered, F.lit(0)).isNull(), F.array_sort(xs)).otherwise(ordered)


def _median(ordered: Column) -> Column:
    """Of a sorted array."""
    n = F.size(ordered)
    mid = F.floor(n / 2).cast("int")
    return F.when(n % 2 == 1, F.get(ordered, mid)).otherwise((F.get(ordered, mid - 1) + F.get(ordered, mid)) / 2)


_BITS = {name: 1 << i for i, name in enumerate(("unit", "unit_cell", "flag", "cell_like", "decimal", "threshold", "range", "phone", "special", "sign", "found", "digit", "section"))}


def _shapes() -> dict[str, Column]:
    """What a cell's text looks like, by its columns _text, _low, _normed, _digit, _unit, _unit_cell, _flag and _numeric; the names are the bits of a cell's `is`."""
    low, digit = F.col("_low"), F.col("_digit")
    starts = lambda *words: functools.reduce(lambda a, b: a | b, [low.startswith(w) for w in words])
    anywhere = digit & (F.contains("_text", F.lit("-")) | F.contains("_text", F.lit("–"))) & F.col("_text").rlike(RANGE_ANYWHERE)
    return {
        "unit": F.col("_unit"), "unit_cell": F.col("_unit_cell"), "flag": F.col("_flag"), "cell_like": F.col("_unit_cell") | F.col("_flag") | F.col("_decimal") | F.col("_threshold") | F.col("_range") | anywhere,
        "decimal": F.col("_decimal"), "threshold": F.col("_threshold"), "range": F.col("_range"), "phone": digit & (F.length("_text") >= 7) & F.col("_text").rlike(PHONE),
        "special": low.isin(*SPECIAL_RESULTS), "sign": starts("negative", "positive"), "found": starts("negative", "positive", "not detected", "detected"),
        "digit": digit, "section": F.col("_normed").isin(*SECTION_CUES),
    }


def _is(cell: Column, *names: str) -> Column:
    """A cell has one of these shapes."""
    return cell["is"].bitwiseAND(sum(_BITS[n] for n in names)) != 0


#: What a cell may be in its row. LOOSE is the row's name if it comes first, else a part of the reference; VALUE_REF is a part of the reference in the result's column.
DROP, TEST, FLAGGED, RESULT, RESULT_TEXT, UNIT, REF_LOW, REF_HIGH, RANGED, REF, LOOSE, VALUE_REF = range(12)
#: The place of a column meaning's byte in `roles`; all other meanings share the last one.
_BYTE = {m: 8 * i for i, m in enumerate(("TEST", "RESULT", "UNIT", "REF_LOW", "REF_HIGH", "REFERENCE", "OTHER"))}


def _roles() -> Column:
    """What a cell is under each column meaning, by the columns of _shapes: a byte for each, its low half before the row's first value or unit and its high half after it."""
    unit_cell, decimal, limit, told = F.col("_unit_cell"), F.col("_decimal"), F.col("_range") | F.col("_threshold"), F.col("special") | F.col("sign")
    both = lambda role: role * 17
    after = lambda role: F.when(unit_cell, UNIT + 16 * role).otherwise(both(role))
    in_result = F.when(decimal, both(RESULT)).when(F.col("_threshold") | F.col("special") | F.col("found"), both(RESULT_TEXT)).when(F.col("phone") | F.contains("_text", F.lit(" ")), both(VALUE_REF)).otherwise(both(RESULT_TEXT))
    before = F.when(unit_cell, UNIT).when(limit, RANGED).when(decimal, RESULT).when(told, RESULT_TEXT).otherwise(LOOSE)
    other = before + 16 * F.when(limit, RANGED).when(decimal, REF).when(told, RESULT_TEXT).otherwise(REF)
    bytes_ = {"TEST": F.lit(both(TEST)), "RESULT": in_result, "UNIT": F.when(unit_cell, both(UNIT)).otherwise(DROP), "REF_LOW": after(REF_LOW), "REF_HIGH": after(REF_HIGH), "REFERENCE": after(RANGED), "OTHER": other}
    packed = functools.reduce(lambda a, b: a + b, [F.shiftleft(c.cast("long"), _BYTE[m]) for m, c in bytes_.items()])
    flagged = both(TEST) + sum(both(FLAGGED) << at for m, at in _BYTE.items() if m != "TEST")
    return F.when(F.col("_text") == "", F.lit(0).cast("long")).when(F.col("_flag"), F.lit(flagged).cast("long")).otherwise(packed)


def shaped(spans: DataFrame) -> DataFrame:
    """Spans with their text trimmed, its shapes (`is`), its `roles` and its meaning as a header: every pattern is tried once for each span at most, before any grouping."""
    own = spans.columns
    df = once(spans, _text=F.trim(F.coalesce("text", F.lit(""))))
    df = once(df, _low=F.lower("_text"), _digit=F.col("_text").rlike(r"(?U)\d"))
    # what a header or a section is named has two letters
    df = once(df, _normed=F.when(F.col("_low").rlike("(?s)[a-z].*[a-z]"), _norm(F.col("_low"))).otherwise(""), _unit=is_unit(F.col("_text")), _flag=is_flag(F.col("_text")))
    text, digit, short = F.col("_text"), F.col("_digit"), F.length("_text")
    limit = F.substring("_text", 1, 1).isin("<", ">", "≤", "≥")
    df = once(
        df, _unit_cell=F.col("_unit") | ((digit | functools.reduce(lambda a, b: a | b, [F.contains("_text", F.lit(c)) for c in "μµ/"])) & is_like_unit(text)), _decimal=digit & (short <= 14) & text.rlike(DECIMAL), _threshold=digit & limit & text.rlike(THRESHOLD),
        _range=digit & F.contains("_text", F.lit("-")) & text.rlike(RANGE),
    )
    shapes = _shapes()
    df = once(df, **{n: shapes[n] for n in ("special", "sign", "found", "phone")})
    bits = sum((F.when(F.col(n) if n in df.columns else shapes[n], bit).otherwise(0) for n, bit in _BITS.items()), F.lit(0))
    # one at a time, as the JVM leaves methods of over 8,000 bytes uncompiled
    df = once(once(df, meaning=header_meaning(F.col("_normed")), **{"is": bits}), roles=_roles())
    return df.select(*[c for c in own if c != "text"], "is", "roles", "meaning", F.col("_text").alias("text"))


def group_rows(spans: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """document_uuid, page_number, rows (in reading order, each an array of spans by x); spans as from shaped.

    Spans come by height, so one that the last row is too far above for is too far from all rows before it, too.
    """
    height, middle = F.col("y_max") - F.col("y_min"), (F.col("x_min") + F.col("x_max")) / 2
    cell = F.struct("x_min", "sequence", "x_max", "y_min", "y_max", "confidence", "text", "is", "roles", "meaning", height.alias("height"), middle.alias("middle"))
    each = F.struct(((F.col("y_min") + F.col("y_max")) / 2).alias("cy"), "sequence", height.alias("height"), cell.alias("cell"))
    pages = spans.groupBy(*PAGE).agg(F.sort_array(F.collect_list(each)).alias("s"))
    pages = once(pages, heights=F.col("s")["height"])
    pages = once(pages, heights=_sorted("heights"))
    pages = once(pages, tolerance=F.greatest(_median(F.col("heights")) * tolerance, F.lit(1e-4)))

    def step(acc: Column, x: Column, i: Column) -> Column:
        near = F.coalesce(F.abs(x["cy"] - acc["s"] / acc["n"]) <= F.col("tolerance"), F.lit(False))
        return F.struct(
            F.when(near, acc["s"] + x["cy"]).otherwise(x["cy"]).cast("double").alias("s"), F.when(near, acc["n"] + 1).otherwise(1).alias("n"),
            F.when(near, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(i))).alias("starts"),
        )

    numbered = F.transform("s", lambda x, i: F.struct(x["cy"].alias("cy"), i.alias("i")))
    start = F.struct(F.lit(None).cast("double").alias("s"), F.lit(1).alias("n"), F.array().cast("array<int>").alias("starts"))  # no row is near
    folded = F.aggregate(numbered, start, lambda acc, x: step(acc, x, x["i"]), lambda acc: acc["starts"])
    # where rows are clearly apart, and the first and the last of each clearly near, the means needn't be known: a mean lies between them
    pages = pages.withColumns({"_cy": F.col("s")["cy"], "_far": F.col("tolerance") * (1 + 1e-6) + 1e-9, "_near": F.col("tolerance") * (1 - 1e-6) - 1e-9})
    pages = once(pages, _gaps=F.filter(F.transform("_cy", lambda y, i: F.when((i > 0) & (y - F.get("_cy", i - 1) <= F.col("_near")), -1).otherwise(i)), lambda i: i >= 0))
    last = lambda i: F.coalesce(F.get("_gaps", i + 1), F.size("_cy")) - 1
    apart = lambda b: (b == 0) | (F.get("_cy", b) - F.get("_cy", b - 1) > F.col("_far"))
    clear = F.get("_cy", F.lit(0)).isNotNull() & F.forall(F.transform("_gaps", lambda b, i: apart(b) & (F.get("_cy", last(i)) - F.get("_cy", b) <= F.col("_near"))), lambda x: x)
    pages = once(pages, starts=F.when(F.coalesce(clear, F.lit(False)), F.col("_gaps")).otherwise(folded)).drop("_cy", "_far", "_near", "_gaps")
    end = lambda i: F.coalesce(F.get("starts", i + 1), F.size("s"))
    row = lambda b, i: F.sort_array(F.slice("s", b + 1, end(i) - b)["cell"])
    return pages.select(*PAGE, F.transform("starts", row).alias("rows"))


def with_header(pages: DataFrame) -> DataFrame:
    """A row for each of a page's rows: row (from 0), cells, header_cells, header_row (null: the page has no header), its columns' middles, bytes (in a cell's `roles`)
    and panels (one for each TEST column, from 0), and the number of panels."""
    pages = once(pages, _counts=F.transform("rows", lambda r: F.size(F.filter(r["meaning"], lambda m: m.isNotNull()))))
    best = F.array_max(F.filter(F.transform("_counts", lambda n, i: F.struct(n.alias("n"), (-i).alias("minus_row"))), lambda x: x["n"] >= 2))
    pages = once(pages, header_row=-best["minus_row"])
    pages = once(pages, _header=F.get("rows", F.col("header_row")))
    pages = once(pages, _centers=F.col("_header")["middle"], _meanings=F.col("_header")["meaning"])
    middles = F.transform(F.slice("_centers", F.lit(2), F.greatest(F.size("_centers") - 1, F.lit(0))), lambda c, i: (F.get("_centers", i) + c) / 2)
    is_test = F.transform("_meanings", lambda m: F.coalesce((m == "TEST").cast("int"), F.lit(0)))
    byte = lambda m: functools.reduce(lambda found, k: found.when(m == k, _BYTE[k]), list(_BYTE), F.when(F.lit(False), 0)).otherwise(_BYTE["OTHER"])
    pages = once(pages, middles=middles, bytes=F.transform("_meanings", byte), _is_test=is_test)
    tests = F.size(F.filter("_is_test", lambda t: t == 1))
    several = F.transform("_is_test", lambda t, i: F.greatest(F.size(F.filter(F.slice("_is_test", F.lit(1), i + 1), lambda x: x == 1)) - 1, F.lit(0)))
    pages = once(pages, panels=F.when(F.col("header_row").isNotNull(), F.greatest(tests, F.lit(1))).otherwise(1))
    pages = once(pages, panels_at=F.when(F.col("panels") > 1, several))
    rows = pages.select(*PAGE, "header_row", "middles", "bytes", "panels_at", "panels", "_counts", F.posexplode("rows").alias("row", "cells"))
    return rows.withColumn("header_cells", F.get("_counts", F.col("row"))).drop("_counts")


def without_noise(rows: DataFrame) -> DataFrame:
    """rows without cells that have strokes far taller than the row's text and can't be table content; short rows stay."""
    rows = rows.withColumn("_heights", F.when(F.size("cells") >= 3, F.col("cells")["height"]))
    rows = rows.withColumn("_heights", _sorted("_heights"))
    rows = rows.withColumn("_median", _median(F.col("_heights")))
    kept = F.filter("cells", lambda c: ~((c["height"] > F.col("_median") * NOISE_HEIGHT) & ~_is(c, "cell_like")))
    # a cell without a height isn't known to be low, so it goes unless it is content
    tall = (F.array_max("_heights") > F.col("_median") * NOISE_HEIGHT) | F.get("_heights", F.size("_heights") - 1).isNull()
    return once(rows, cells=F.when((F.col("_median") > 0) & tall, kept).otherwise(F.col("cells"))).drop("_heights", "_median")


def _codes() -> Column:
    """The byte of each of a row's `cells`, by the column it stands in, or by its place in the row if the page has no header."""

    def byte(c: Column, at: Column) -> Column:
        return F.call_function("shiftright", c["roles"], at).bitwiseAND(255).cast("int")

    def by_header(c: Column) -> Column:
        return byte(c, F.get("bytes", F.size(F.filter("middles", lambda m: m <= c["middle"]))))

    n = F.size("cells")
    unit_at = lambda i: _is(F.get("cells", F.lit(i)), "unit_cell")

    def by_position(c: Column, i: Column) -> Column:
        second = F.when((n == 2) & unit_at(1), _BYTE["UNIT"]).otherwise(_BYTE["RESULT"])
        third = F.when((n == 3) & ~unit_at(2), _BYTE["REFERENCE"]).otherwise(_BYTE["UNIT"])
        return byte(c, F.when(i == 0, _BYTE["TEST"]).when(i == 1, second).when(i == 2, third).otherwise(_BYTE["REFERENCE"]))

    return F.when(F.col("header_row").isNotNull(), F.transform("cells", by_header)).otherwise(F.transform("cells", by_position))


def _place(roles: str, *wanted: int) -> Column:
    """The place (from 1) of the first of these roles in an array column; null: there is none."""
    places = [F.nullif(F.array_position(roles, F.lit(r)), F.lit(0).cast("long")) for r in wanted]
    return (F.least(*places) if len(places) > 1 else places[0]).cast("int")


def with_roles(rows: DataFrame) -> DataFrame:
    """rows with the `roles` of their cells by their `codes`, which depend on whether a value or a name has come before them in the row.

    A cell is a value, a unit or neither whatever stands before it, so the first value parts a row's cells; the first name before it is the only one among LOOSE cells.
    """
    df = rows.withColumns(dict(_before=F.transform("codes", lambda c: c.bitwiseAND(15)), _after=F.transform("codes", lambda c: F.shiftright(c, 4))))
    df = df.withColumns(dict(_value=F.coalesce(_place("_before", RESULT, RESULT_TEXT, UNIT, VALUE_REF), F.size("_before")), _name=_place("_before", TEST, LOOSE)))
    roles = F.concat(F.slice("_before", F.lit(1), F.col("_value")), F.slice("_after", F.col("_value") + 1, F.size("_after")))
    df = df.withColumns(dict(roles=roles))
    plain = F.transform("roles", lambda r, i: F.when(r == LOOSE, F.when(i + 1 == F.col("_name"), TEST).otherwise(REF)).when(r == VALUE_REF, REF).otherwise(r))
    return df.withColumns(dict(roles=F.when(F.array_contains("roles", LOOSE) | F.array_contains("roles", VALUE_REF), plain).otherwise(F.col("roles")))).drop("_before", "_after", "_value", "_name")


def _number(text: Column) -> Column:
    return F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("decimal(20,6)")


def assemble(rows: DataFrame) -> DataFrame:
    """Rows with the `cells` of one panel (null: none) and their `codes`, with `result`: the panel's result columns, null without a name or a value."""
    df = with_roles(rows)
    df = df.withColumns(dict(_texts=F.col("cells")["text"], **{f"_n{r}": F.size("roles") - F.size(F.array_remove("roles", r)) for r in range(TEST, REF + 1)}))
    of = lambda *roles: F.filter("_texts", lambda t, i: F.get("roles", i).isin(*roles))
    number_of = lambda *roles: functools.reduce(lambda a, b: a + b, [F.col(f"_n{r}") for r in roles])
    one = lambda *roles: F.get("_texts", _place("roles", *roles) - 1)
    joined = lambda *roles: F.when(number_of(*roles) == 0, "").when(number_of(*roles) == 1, one(*roles)).otherwise(F.trim(F.array_join(of(*roles), " ")))
    bound = lambda t, group: _number(F.regexp_extract(t, RANGE, group))
    range_ = F.when(F.col(f"_n{RANGED}") == 1, one(RANGED))
    df = df.withColumns(dict(_test=joined(TEST), _result=joined(RESULT, RESULT_TEXT), _low=bound(range_, 2), _high=bound(range_, 4)))
    ordered = F.filter(
        F.transform(of(RANGED), lambda t: F.struct(bound(t, 2).alias("low"), bound(t, 4).alias("high"))),
        lambda r: r["low"].isNotNull() & r["high"].isNotNull() & (r["low"] <= r["high"]),
    )
    numbers = lambda role, side: F.concat(F.filter(F.transform(of(role), _number), lambda x: x.isNotNull()), F.transform(ordered, lambda r: r[side]))
    only = lambda xs: F.when(F.size(xs) == 1, F.get(xs, F.lit(0)))
    # one range and no other bound is how nearly all rows are
    limit = lambda role, side, own: F.when((F.col(f"_n{role}") == 0) & (F.col(f"_n{RANGED}") <= 1), F.when(F.col("_low") <= F.col("_high"), F.col(own))).otherwise(only(numbers(role, side)))
    confidence = F.aggregate(F.col("cells")["confidence"], F.lit(0.0), lambda a, x: a + x) / F.size("cells")
    confidence = confidence * F.when(F.col("header_row").isNotNull(), 1.0).otherwise(NO_HEADER)
    df = df.withColumns(dict(_first=F.substring_index("_result", " ", 1), _there=(F.col("_test") != "") & (F.col("_result") != "") & ~F.lower("_test").isin(*KNOWN_UNITS)))
    result = F.struct(
        F.col("_test").alias("test_name_raw"), F.col("_result").alias("result_raw"), F.when(F.col("_first").rlike(DECIMAL), _number(F.col("_first"))).alias("result_numeric"),
        joined(RESULT_TEXT).alias("result_text"), joined(UNIT).alias("unit_raw"), joined(REF, REF_LOW, REF_HIGH, RANGED).alias("reference_range_raw"),
        limit(REF_LOW, "low", "_low").alias("reference_low"), limit(REF_HIGH, "high", "_high").alias("reference_high"), joined(FLAGGED).alias("flag_raw"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence)).alias("extraction_confidence"), F.col("cells")["sequence"].alias("evidence"),
    )
    return df.withColumns(dict(result=F.when(F.col("_there"), result))).drop("roles", "_texts", "_test", "_result", "_low", "_high", "_first", "_there", *[f"_n{r}" for r in range(TEST, REF + 1)])


def _merges(entries: Column) -> Column:
    """Which rows carry on the reference of an earlier row (row, into, panel, extra): a fold over a page's panels in order.

    The last panel of a row that is no such line decides whether lines below it may carry on.
    """

    def step(acc: Column, x: Column) -> Column:
        merged = F.when(x["row"] == acc["at"], acc["merged"]).otherwise(acc["pending"] & x["carries"] & ~x["metadata"])
        return F.get(F.transform(F.array(merged), lambda m: after(acc, x, m)), F.lit(0))

    def after(acc: Column, x: Column, merged: Column) -> Column:
        has = x["seeds"].isNotNull() & ~merged
        moved = F.struct(x["row"].alias("row"), acc["row"].alias("into"), acc["panel"].alias("panel"), x["extra"].alias("extra"))
        return F.struct(
            F.when(x["metadata"], False).when(merged, True).when(has, x["seeds"]).otherwise(acc["pending"]).alias("pending"), x["row"].alias("at"), merged.alias("merged"),
            F.when(has, x["row"]).otherwise(acc["row"]).alias("row"), F.when(has, x["panel"]).otherwise(acc["panel"]).alias("panel"),
            F.when(merged & (x["row"] != acc["at"]), F.concat(acc["out"], F.array(moved))).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(
        F.lit(False).alias("pending"), F.lit(-1).alias("at"), F.lit(False).alias("merged"), F.lit(-1).alias("row"), F.lit(-1).alias("panel"),
        F.array().cast("array<struct<row:int,into:int,panel:int,extra:string>>").alias("out"),
    )
    return F.aggregate(entries, start, step, lambda acc: acc["out"])


def parse_pages(spans: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Result rows of all pages, numbered on each page, with wrapped reference lines merged into the row they belong to.

    Spans are shuffled once, by their page; all that follows stays in the tasks that hold the pages.
    """
    rows = with_header(group_rows(shaped(spans), tolerance))
    rows = rows.where(F.col("header_row").isNull() | (F.col("row") > F.col("header_row"))).where("header_cells < 2")
    rows = rows.withColumn("line", F.trim(F.array_join(F.col("cells")["text"], " ")))
    metadata = F.col("line") == ""
    for pattern in METADATA:
        metadata = metadata | ((F.contains("line", F.lit("15189")) & F.col("line").rlike(pattern)) if "15189" in pattern else F.col("line").rlike(pattern))
    full = lambda: F.when(F.array_contains(F.col("cells")["text"], ""), F.filter("cells", lambda c: c["text"] != "")).otherwise(F.col("cells"))
    rows = rows.withColumns({"metadata": metadata, "_full": full()})
    section = (F.size("_full") <= 2) & ~F.exists("_full", lambda c: _is(c, "digit")) & F.exists("_full", lambda c: _is(c, "section"))
    rows = once(rows.drop("line"), metadata=F.col("metadata"), _section=section).where("metadata OR NOT _section").drop("_section", "_full")
    rows = without_noise(rows).where(F.size("cells") > 0)
    rows = rows.withColumns(dict(_full=F.when(~F.col("metadata"), full()), _place=F.when(F.col("panels") > 1, F.transform("cells", lambda c: F.get("panels_at", F.size(F.filter("middles", lambda m: m <= c["middle"])))))))
    rows = rows.withColumns(dict(codes=F.when(~F.col("metadata"), _codes()), extra=F.trim(F.array_join(F.col("_full")["text"], " ")), _panels=F.when(~F.col("metadata"), F.when(F.col("panels") == 1, F.array(F.lit(0))).otherwise(F.array_sort(F.array_distinct("_place"))))))
    carries = ~(_is(F.get("_full", F.lit(0)), "decimal") & (F.size("_full") >= 2)) & ~F.exists("_full", lambda c: _is(c, "unit")) & (F.col("extra").rlike(CONTINUATION) | F.col("extra").rlike(RANGE))
    rows = rows.drop("middles", "bytes", "panels_at").withColumns(dict(carries=F.when(~F.col("metadata") & (F.size("_full") > 0), carries).otherwise(False)))
    rows = rows.select(*PAGE, "row", "metadata", "carries", "extra", "cells", "codes", "_place", "header_row", "panels", F.explode_outer("_panels").alias("panel"))
    own = lambda xs: F.when(F.col("panel").isNotNull(), F.when(F.col("panels") == 1, F.col(xs)).otherwise(F.filter(xs, lambda x, i: F.get("_place", i) == F.col("panel"))))
    rows = assemble(rows.withColumns({"cells": own("cells"), "codes": own("codes")}).drop("_place"))
    seeds = (F.col("result.reference_range_raw") != "") & (F.col("panels") == 1) & F.col("result.reference_range_raw").rlike(RANGE_ANYWHERE)
    rows = rows.select(*PAGE, F.struct("row", "panel", "metadata", "carries", "extra", F.when(F.col("result").isNotNull(), seeds).alias("seeds"), "result").alias("entry"))

    # by row and panel, which are an entry's first fields; a row without a panel has one entry
    pages = rows.groupBy(*PAGE).agg(F.sort_array(F.collect_list("entry")).alias("e"))
    none = F.array().cast("array<struct<row:int,into:int,panel:int,extra:string>>")
    pages = once(pages, _merges=F.when(F.array_contains(F.col("e")["carries"], True), _merges(F.col("e"))).otherwise(none))
    kept = F.filter("e", lambda x: x["result"].isNotNull())
    kept = F.when(F.size("_merges") == 0, kept).otherwise(F.filter(kept, lambda x: ~F.exists("_merges", lambda m: m["row"] == x["row"])))
    found = pages.select(*PAGE, "_merges", F.posexplode(kept).alias("row_index", "x"))
    extra = F.transform(F.filter("_merges", lambda m: (m["into"] == F.col("x.row")) & (m["panel"] == F.col("x.panel"))), lambda m: m["extra"])
    found = found.withColumn("_extra", F.when(F.size("_merges") > 0, F.when(F.size(extra) > 0, F.array_join(extra, " "))))
    found = found.select(*PAGE, "_extra", "x.result.*", "row_index")
    return found.withColumn("reference_range_raw", F.trim(F.concat_ws(" ", "reference_range_raw", "_extra"))).drop("_extra")


def lab_results(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """Results of active laboratory documents, with normalised names and units."""
    wanted = documents.where("archive_status = 'ACTIVE' AND document_type = 'LABORATORY'").select("document_uuid")
    parsed = parse_pages(spans.join(wanted, "document_uuid", "left_semi"))
    return parsed.withColumn("test_name_normalized", normalize_test(F.col("test_name_raw"))).withColumn("unit_normalized", normalize_unit(F.col("unit_raw")))


def page_status(pages: DataFrame, results: DataFrame) -> DataFrame:
    """Each page's extraction: COMPLETED with its number of results and mean confidence, NOT_APPLICABLE without any, FAILED if
    its spans have no box. Pages stand apart, so a bad one concerns itself alone."""
    per = results.groupBy(*PAGE).agg(F.count("*").alias("result_count"), F.avg("extraction_confidence").alias("confidence"))
    status = F.when(F.col("broken"), "FAILED").when(F.coalesce("result_count", F.lit(0)) > 0, "COMPLETED").otherwise("NOT_APPLICABLE")
    return pages.join(per, list(PAGE), "left").withColumn("status", status).withColumn("result_count", F.coalesce("result_count", F.lit(0)))


BOX = ("x_min", "y_min", "x_max", "y_max")


def extract(documents: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results and page states of the active laboratory documents; the boxes and confidences of spans may be texts or null.

    A page with a span that has no place on it, or a confidence that is no number from 0 to 1, is FAILED and has no results; the other pages go on.
    """
    wanted = documents.where("archive_status = 'ACTIVE' AND document_type = 'LABORATORY'").select("document_uuid")
    numbers = {c: F.col(c).cast("string").try_cast("double") for c in (*BOX, "confidence")}
    own = io.written(spans.join(wanted, "document_uuid", "left_semi").withColumns(numbers), "lab-spans")
    sound = F.coalesce(box_ok() & F.col("confidence").between(0, 1), F.lit(False))
    pages = io.written(own.groupBy(*PAGE).agg((~F.bool_and(sound)).alias("broken")), "lab-pages")
    good = own.join(pages.where("broken").hint("merge"), list(PAGE), "left_anti")
    results = io.written(lab_results(documents, good), "lab-normalized")
    return results, page_status(pages, results)


def evidence(results: DataFrame, spans: DataFrame) -> DataFrame:
    """The spans that each result row comes from."""
    rows = results.select(*PAGE, "row_index", F.explode("evidence").alias("sequence"))
    return rows.join(spans.hint("merge"), [*PAGE, "sequence"])
