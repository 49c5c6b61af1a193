"""Column functions for text: normalisation, fingerprints, subtypes, names, redaction.

All of it runs in the JVM but NFKC, which Spark lacks: one Arrow UDF, skipped where a text is ASCII.
Regular expressions carry (?U) where letters and digits of any script are meant.
"""

from __future__ import annotations

import functools
import hashlib
import re
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Digits and separators that dates are written with.
ARABIC_DIGITS, ASCII_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"
SEPARATORS_FROM, SEPARATORS_TO = "⁄∕‐‑‒–—", "//-----"
#: Thresholds of a usable text.
MIN_CHARS, MIN_PAGE_CHARS, MIN_TEXT_PAGE_RATIO = 80, 40, 0.5
MIN_CONFIDENCE_HIGH, MIN_CONFIDENCE_MEDIUM = 0.90, 0.70

#: Keys whose values no audit payload may hold.
SENSITIVE_KEYS = (
    "password", "password_hash", "token", "access_token", "refresh_token", "activation_token", "activation_token_hash",
    "token_hash", "secret", "email_verification_token", "authorization", "national_number", "family_number",
    "document_number", "sha256", "storage_key", "file_path", "path", "file", "front_image", "back_image",
    "identity_image", "text", "ocr_text", "native_text", "candidate_context", "context", "raw",
)
REDACTED = "[REDACTED]"

#: Report subtypes and their cues, first match wins.
SUBTYPE_CUES = (
    ("LAB_CHEMISTRY", ("biochem", "chemistry", "chemical", "lipid profile", "lipid")),
    ("LAB_HORMONES", ("hormone", "vitamin d", "vitamin b", "vitamin", "thyroid", "t3", "t4", "tsh", "prolactin", "estradiol", "testosterone", "cortisol")),
    ("LAB_CBC", ("cbc", "complete blood", "hematolog", "haematolog", "blood count", "wbc", "rbc", "hemoglobin", "platelet", "packed cell")),
    ("RADIOLOGY", ("radiology", "x-ray", "xray", "x ray", "ct scan", "mri", "ultrasound", "sonograph", "echocardiograph", "mammograph")),
)

#: Test names and units with their canonical forms; callers may pass corrected tables.
TEST_ALIASES = {
    "creatinine": "CREATININE", "serum creatinine": "CREATININE", "urea": "UREA", "blood urea": "UREA",
    "sodium": "SODIUM", "potassium": "POTASSIUM", "chloride": "CHLORIDE", "calcium": "CALCIUM",
    "total cholesterol": "TOTAL_CHOLESTEROL", "cholesterol": "TOTAL_CHOLESTEROL",
    "hdl cholesterol": "HDL_CHOLESTEROL", "hdl": "HDL_CHOLESTEROL", "ldl cholesterol": "LDL_CHOLESTEROL", "ldl": "LDL_CHOLESTEROL",
    "triglycerides": "TRIGLYCERIDES", "glucose": "GLUCOSE", "fasting blood sugar": "GLUCOSE",
    "hba1c": "HBA1C", "hemoglobin a1c": "HBA1C", "wbc": "WBC", "white blood cells": "WBC",
    "rbc": "RBC", "red blood cells": "RBC", "hemoglobin": "HEMOGLOBIN", "hematocrit": "HEMATOCRIT",
    "platelets": "PLATELETS", "tsh": "TSH", "t3": "T3", "t4": "T4", "vitamin d3": "VITAMIN_D3", "vitamin d": "VITAMIN_D3",
    "psa": "PSA", "uric acid": "URIC_ACID", "total bilirubin": "TOTAL_BILIRUBIN", "bilirubin": "TOTAL_BILIRUBIN",
    "alanine aminotransferase": "ALT", "aspartate aminotransferase": "AST", "alkaline phosphatase": "ALKALINE_PHOSPHATASE",
}
UNIT_ALIASES = {
    "mg/dl": "mg/dL", "mg/ml": "mg/mL", "ng/ml": "ng/mL", "ng/dl": "ng/dL", "g/dl": "g/dL", "g/l": "g/L",
    "ug/dl": "µg/dL", "ug/ml": "µg/mL", "pg/ml": "pg/mL", "u/l": "U/L", "iu/l": "IU/L", "muiu/ml": "mIU/mL",
    "uiu/ml": "mIU/mL", "uiu/l": "mIU/L", "miu/l": "mIU/L", "%": "%", "µl": "µL", "ul": "µL", "fl": "fL",
    "mmol/l": "mmol/L", "umol/l": "µmol/L", "x10^3/µl": "x10^3/µL", "x103/µl": "x10^3/µL", "x10^3/ul": "x10^3/µL",
}


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


class _Letters(dict):
    """Code point to its form NFKC, each looked up once."""

    def __missing__(self, code: int) -> str:
        self[code] = form = unicodedata.normalize("NFKC", chr(code))
        return form


_LETTERS = _Letters()


@F.pandas_udf(StringType())
def _nfkc_letters(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t.translate(_LETTERS), na_action="ignore")


def nfkc_letters(column: Column) -> Column:
    """Form NFKC letter by letter: letters that compose with the one before stay apart, so each place has one letter that it comes from."""
    plain = column.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, column).otherwise(_nfkc_letters(F.when(~plain, column)))


def nfkc(column: Column) -> Column:
    """Unicode form NFKC; ASCII texts are passed through without leaving the JVM's result."""
    plain = column.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, column).otherwise(_nfkc(F.when(~plain, column)))


#: White space to Python, but no white space to a pattern.
_SEPARATING = "\x1c\x1d\x1e\x1f"


def normalize_text(column: Column, form: bool = True) -> Column:
    """Text as dates are looked for in it: NFKC letter by letter, ASCII digits, plain separators, no control or format characters, runs of
    white space as one blank, or one newline if there is one in the run. form=False leaves out NFKC."""
    text = F.translate(nfkc_letters(column) if form else column, ARABIC_DIGITS + SEPARATORS_FROM + _SEPARATING, ASCII_DIGITS + SEPARATORS_TO + " " * len(_SEPARATING))
    text = F.regexp_replace(text, r"(?U)[\p{Cc}\p{Cf}&&[^\s]]", "")
    text = F.regexp_replace(text, r"(?U)\s*[\r\n]\s*", "\n")
    return F.regexp_replace(text, r"(?U)[\s&&[^\n]]+", " ")


_DATE_LETTERS = str.maketrans(ARABIC_DIGITS + SEPARATORS_FROM, ASCII_DIGITS + SEPARATORS_TO)


def letter_places(raw: str) -> tuple[str, list[int]]:
    """A text's normal form, as normalize_text gives it, and for each of its letters the place in the text that it comes from."""
    letters: list[str] = []
    places: list[int] = []
    for at, c in enumerate(raw):
        for form in _LETTERS[ord(c)].translate(_DATE_LETTERS):
            blank = form.isspace()
            if blank and letters and letters[-1] in (" ", "\n"):
                if form in "\r\n":
                    letters[-1] = "\n"
            elif blank or unicodedata.category(form) not in ("Cc", "Cf"):
                letters.append(("\n" if form in "\r\n" else " ") if blank else form)
                places.append(at)
    return "".join(letters), places


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("places", ArrayType(IntegerType()))]))
def normal_form(raw: pd.Series) -> pd.DataFrame:
    """letter_places of each text, in one pass; a null text has neither."""
    return pd.DataFrame([(None, None) if t is None else letter_places(t) for t in raw], columns=["text", "places"])


def meaningful(column: Column) -> Column:
    """How many letters and digits, of any script, the text has."""
    return F.length(F.regexp_replace(F.coalesce(column, F.lit("")), r"[^\p{L}\p{N}]", ""))


def canonical(column: Column) -> Column:
    """NFKC, lower case, runs of white space as one blank, trimmed; null as the empty text."""
    low = F.lower(nfkc(F.coalesce(column, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(low, r"(?U)\s+", " "), "^ | $", "")


def fingerprint(column: Column, key: bytes, canonical_already: bool = False) -> Column:
    """HMAC-SHA256 of the canonical text under a key, as hex; empty for an empty text. Two nested sha2 over the key's pads."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    block = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    digest = lambda text: F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, text.cast("binary")), 256))), 256)
    # an array of one, so that the canonical text is computed once though it is named twice
    text = F.array(column if canonical_already else canonical(column))
    return F.get(F.transform(text, lambda t: F.when(t == "", "").otherwise(digest(t))), F.lit(0))


def report_subtype(column: Column) -> Column:
    """The layout class of a page: the first cue list that matches, then a table header, then a narrative shape."""
    text = F.lower(F.coalesce(column, F.lit("")))
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]", -1), lambda x: F.trim(x)), lambda x: x != "")
    out = F
    for subtype, cues in SUBTYPE_CUES:
        pattern = "(^|[^a-z])(" + "|".join(r"\Q" + c + r"\E" for c in cues) + ")([^a-z]|$)"
        out = out.when(text.rlike(pattern), subtype)
    out = out.when(text.rlike(r"(^|\n)[^|\n]*(result|value|reference|test)[^|\n]*\n"), "LAB_CHEMISTRY")
    out = out.when((F.size(lines) >= 6) & F.forall(lines, lambda x: F.length(x) > 30), "NARRATIVE")
    return out.otherwise("UNKNOWN")


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(""))


def normalize_test(column: Column, aliases: dict[str, str] = TEST_ALIASES) -> Column:
    """A test's canonical name, or the empty text."""
    key = F.regexp_replace(F.trim(F.lower(column)), r"\*+$", "")
    key = F.trim(F.regexp_replace(F.regexp_replace(key, "[^a-z0-9 ]+", " "), r"\s+", " "))
    return _lookup(F.trim(F.regexp_replace(key, "^s ", "")), aliases)


def normalize_unit(column: Column, aliases: dict[str, str] = UNIT_ALIASES) -> Column:
    return _lookup(F.replace(F.lower(F.trim(column)), F.lit(" "), F.lit("")), aliases)


@functools.cache
def _foldings() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Unicode's full case folding by rule: letters that fold to one letter, what they fold to, and those that fold to several."""
    folded = [(c, c.casefold()) for c in map(chr, range(sys.maxunicode + 1)) if c != c.casefold()]
    single = [(c, f) for c, f in folded if len(f) == 1]
    return "".join(c for c, _ in single), "".join(f for _, f in single), tuple((c, f) for c, f in folded if len(f) > 1)


def casefold(column: Column) -> Column:
    """Full case folding, letter by letter and without regard to place or language: a final sigma is a sigma, a sharp s is ss, a
    dotted capital i is an i with a dot. Texts of ASCII letters are only put in lower case."""
    source, target, several = _foldings()
    single = F.translate(column, source, target)
    table = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(f).alias("f")) for c, f in several])
    whole = F.aggregate(table, single, lambda text, x: F.replace(text, x["c"], x["f"]))
    folded = F.when(single.rlike("[" + "".join(c for c, _ in several) + "]"), whole).otherwise(single)
    return F.when(column.rlike(r"^[\x00-\x7F]*$"), F.lower(column)).otherwise(folded)


def normalize_name(column: Column) -> Column:
    """A reference name for comparison: NFKC, white space collapsed, case folded."""
    return casefold(F.trim(F.regexp_replace(nfkc(column), r"(?U)\s+", " ")))


def sanitize_name(column: Column, default: str = "medical-document") -> Column:
    """A file's base name without control characters, blanks and dots trimmed, 255 characters at most."""
    base = F.element_at(F.split(F.regexp_replace(F.replace(column, F.lit("\\"), F.lit("/")), "/+$", ""), "/", -1), -1)
    clean = F.regexp_replace(F.regexp_replace(base, r"\p{C}", ""), "^[ .]+|[ .]+$", "")
    return F.substring(F.when(F.length(F.coalesce(clean, F.lit(""))) > 0, clean).otherwise(default), 1, 255)


def fold_ar(column: Column) -> Column:
    """Arabic labels with one form of alif, without marks and hidden characters."""
    return F.translate(column, "أإآٱ" + "ـًٌٍَُِّْ" + "‌‍‏‎", "اااا")


def repair_digits(column: Column) -> Column:
    """Letters that are misread digits as digits, where that makes the whole value digits."""
    fixed = F.translate(column, "OIlSB", "01158")
    return F.when(fixed.rlike("^[0-9]+$"), fixed).otherwise(column)


def plain_decimal(column: Column) -> Column:
    """A decimal as text without trailing zeros or exponent."""
    text = column.cast("decimal(38,6)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def confidence_bucket(column: Column) -> Column:
    return F.when(column >= MIN_CONFIDENCE_HIGH, "high").when(column >= MIN_CONFIDENCE_MEDIUM, "medium").otherwise("low")


def request_hash(*columns: Column) -> Column:
    """sha256 of the columns as JSON with sorted keys; pass them aliased, in order of name."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


#: A JSON text's strings, and its tokens; what isn't well formed is a token as it stands.
_JSON_STRING = r'"(?:[^"\\]|\\.)*+"'
_JSON_TOKEN = r'(?s)"(?:[^"\\]|\\.)*+"?|[{}\[\]:,]|\s++|[^\s{}\[\]:,"]++'
#: Values that are nested so deep are matched by one pattern; deeper ones token by token.
NESTING = 8


def _json_value(depth: int) -> str:
    """A pattern of JSON values up to some depth of nesting, which never goes back."""
    nested = r"[{\[][^{}\[\]\"]*+[}\]]"
    for _ in range(depth):
        nested = rf'[{{\[](?:[^{{}}\[\]"]++|{_JSON_STRING}|{nested})*+[}}\]]'
    return rf"{_JSON_STRING}|-?[0-9][0-9.eE+-]*+|true|false|null|{nested}"


def _redact_tokens(column: Column, keys: tuple[str, ...]) -> Column:
    """The values of the keys replaced by a walk over the tokens: at any depth, behind escaped keys, and up to the end if a value never ends.

    The walk is in a text (0), behind a key (1), before a value's first token (2) or in it (3); `held` is white space behind a key.
    """

    def sensitive(token: Column) -> Column:
        plain = F.substring(token, 2, F.length(token) - 2)
        key = F.when(token.contains("\\"), F.get_json_object(F.concat(F.lit('{"k":'), token, F.lit("}")), "$.k")).otherwise(plain)
        return F.startswith(token, F.lit('"')) & F.coalesce(key.isin(*keys), F.lit(False))

    def state(out: Column, held: Column, depth: Column, mode: Column) -> Column:
        return F.struct(out.alias("out"), held.alias("held"), depth.cast("int").alias("depth"), mode.cast("int").alias("mode"))

    def step(s: Column, t: Column) -> Column:
        blank, nothing, none = F.trim(F.regexp_replace(t, r"\s", " ")) == "", F.lit(""), F.lit(0)
        depth = s["depth"] + F.when(t.isin("{", "["), 1).when(t.isin("}", "]"), -1).otherwise(0)
        begun = (s["mode"] == 3) | ~blank
        skipped = state(s["out"], nothing, depth, F.when(begun & (depth == 0), 0).when(begun, 3).otherwise(2))
        spoken = state(F.concat(s["out"], s["held"], t), nothing, none, F.when(sensitive(t), 1).otherwise(0))
        replaced = state(F.concat(s["out"], F.lit(f':"{REDACTED}"')), nothing, none, F.lit(2))
        waiting = state(s["out"], F.concat(s["held"], t), none, F.lit(1))
        return F.when(s["mode"] >= 2, skipped).when((s["mode"] == 1) & blank, waiting).when((s["mode"] == 1) & (t == ":"), replaced).otherwise(spoken)

    start = state(F.lit(""), F.lit(""), F.lit(0), F.lit(0))
    return F.aggregate(F.regexp_extract_all(column, F.lit(_JSON_TOKEN), F.lit(0)), start, step, lambda s: F.concat(s["out"], s["held"]))


def redact(column: Column, keys: tuple[str, ...] = SENSITIVE_KEYS) -> Column:
    """A JSON text with the values of sensitive keys replaced at any depth, in objects and arrays, whatever the value is.

    One pattern replaces values up to NESTING levels deep. Rows in which a key still has a value of its own then (a deeper one, or one that
    never ends), or in which a key may be written with escapes, are walked token by token. All of it runs in the JVM.
    """
    names = "|".join(keys)
    flat = F.regexp_replace(column, rf'(?s)"({names})"\s*+:\s*+(?:{_json_value(NESTING)})', '"$1":"' + REDACTED.replace("[", r"\[") + '"')
    left = flat.rlike(rf'"({names})"\s*+:(?!"{re.escape(REDACTED)}")') | column.contains("\\u")
    return F.when(left, _redact_tokens(column, keys)).otherwise(flat)


def text_outcome(usable: Column) -> Column:
    return F.when(usable, "TEXT_EXTRACTED").otherwise("OCR_REQUIRED")


def ocr_outcome(has_text: Column, needs_ocr: Column, usable: Column) -> Column:
    return F.when(~has_text, "UPLOADED").when(needs_ocr & ~usable, "OCR_REQUIRED").otherwise("TEXT_EXTRACTED")
