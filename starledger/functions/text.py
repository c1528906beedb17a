"""Text, identifiers and URLs as column expressions; NFKC and case folding, which Spark lacks, run in Arrow batches."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def nfkc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def fold(c: Column) -> Column:
    """NFKC, white space squeezed."""
    return squeeze(nfkc(c))


def title_key(c: Column) -> Column:
    """Case-folded NFKC without punctuation and symbols."""
    return squeeze(F.regexp_replace(nfkc_casefold(c), r"[\p{P}\p{S}]", " "))


def author_key(c: Column) -> Column:
    """Case-folded NFKC without punctuation."""
    return squeeze(F.regexp_replace(nfkc_casefold(c), r"\p{P}", " "))


def surname(key: Column) -> Column:
    """Last token of a normalized author; null for none."""
    return F.nullif(F.element_at(F.split(key, " "), -1), F.lit(""))


def name_key(c: Column) -> Column:
    """Case-folded, squeezed; null if blank."""
    return F.nullif(squeeze(nfkc_casefold(c)), F.lit(""))


def unquoted(c: Column) -> Column:
    """Percent escapes decoded; a plus sign stays, a bad escape leaves the text as it is."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(c, r"\+", "%2B")), c)


def doi(c: Column) -> Column:
    """The bare lower-case DOI; null for none."""
    found = F.regexp_extract(unquoted(F.trim(c)), r"(?i)10\.\d{4,9}/\S+", 0)
    return F.nullif(F.lower(F.regexp_replace(found, r"[.,;:)\]}\"]+$", "")), F.lit(""))


def arxiv(c: Column) -> Column:
    """New (2101.00001) and old (math.GT/0309136) identifiers without version; null for none."""
    text = F.lower(F.trim(c))
    new = F.regexp_extract(text, r"(?<![\d.])(\d{4}\.\d{4,5})(?:v\d+)?(?:\.pdf)?(?![\d])", 1)
    old = F.regexp_extract(text, r"([a-z-]+(?:\.[a-z]{2})?/\d{7})(?:v\d+)?(?:\.pdf)?(?!\d)", 1)
    return F.nullif(F.coalesce(F.nullif(new, F.lit("")), old), F.lit(""))


#: Query parameters that don't tell pages apart.
TRACKING = r"^(utm_[^=]*|gclid)(=|$)"


def url(c: Column) -> Column:
    """http(s) only and without user; lower-case scheme and host, tracking parameters dropped, the rest sorted, no fragment and no closing slash."""
    text = F.trim(c)
    head = r"^([A-Za-z]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    scheme, host, path, query = (F.regexp_extract(text, head, i) for i in range(1, 5))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    built = F.concat(F.lower(scheme), F.lit("://"), F.lower(host), F.regexp_replace(path, "/+$", ""), tail)
    return F.when(F.lower(scheme).isin("http", "https") & (host != "") & ~host.contains("@"), built)


def catalog_id(c: Column, prefix: str, label: str) -> Column:
    """An optional prefix and up to 19 digits, not zero, without leading zeros, prefixed anew; null otherwise."""
    digits = F.regexp_extract(F.trim(c), rf"(?i)^(?:{prefix}\s*-?\s*)?(\d{{1,19}})$", 1)
    short = F.regexp_replace(digits, "^0+", "")
    return F.when(short != "", F.concat(F.lit(f"{label} "), short))


def toi(c: Column) -> Column:
    """TOI-700.1 becomes 700.01; decimals are filled to two with leading zeros."""
    whole = F.regexp_extract(F.trim(c), r"(?i)^(?:toi\s*-?\s*)?0*(\d+)\.(\d+)$", 1)
    part = F.regexp_extract(F.trim(c), r"(?i)^(?:toi\s*-?\s*)?0*(\d+)\.(\d+)$", 2)
    return F.when(whole != "", F.concat(whole, F.lit("."), F.when(F.length(part) < 2, F.lpad(part, 2, "0")).otherwise(part)))


def math_label(c: Column) -> Column:
    """Dollar signs around a label dropped, plus-minus spelled as one sign."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"^\$(.*)\$$", "$1"), r"\\pm|\+/-", "±")


def unit_token(c: Column) -> Column:
    """X11: no dollar signs, no white space, the Earth sign as one character."""
    return F.regexp_replace(F.regexp_replace(nfkc(c), r"[\s$]", ""), r"\\oplus", "⊕")


def header_unit(c: Column) -> Column:
    """struct(label, unit) of ``label [unit]`` or ``label (unit)``; unit is null without brackets."""
    pattern = r"^(.*?)\s*[\[(]([^\[\]()]+)[\])]\s*$"
    label = F.regexp_extract(F.trim(c), pattern, 1)
    return F.struct(F.when(label != "", label).otherwise(F.trim(c)).alias("label"), F.nullif(F.trim(F.regexp_extract(F.trim(c), pattern, 2)), F.lit("")).alias("unit"))


#: Cell texts that stand for no value.
NULL_TOKENS = ["", "-", "--", "n/a", "na", "nan", "null", "none", "...", "…"]
_NUMBER = r"[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
_ASYMMETRIC = rf"^({_NUMBER})\s*\+\s*(\d+(?:\.\d+)?)\s*/?\s*-\s*(\d+(?:\.\d+)?)\s*(\S.*)?$"
_SYMMETRIC = rf"^(<=|>=|<|>|≤|≥)?\s*({_NUMBER})\s*(?:(?:±)\s*(\d+(?:\.\d+)?))?\s*(\S.*)?$"


def measured(c: Column) -> Column:
    """struct(value, plus, minus, limit, unit, null_reason) of a cell such as ``1.2 ± 0.1 km``, ``3 +2/-1`` or ``<5 K``; null_reason is not_measured for a null token and unparsed for other text."""
    t = squeeze(math_label(F.regexp_replace(c, r"\\pm", "±")))
    null_token = t.isNull() | F.lower(t).isin(NULL_TOKENS)
    asym, sym = t.rlike(_ASYMMETRIC), t.rlike(_SYMMETRIC)
    a = lambda i: F.nullif(F.regexp_extract(t, _ASYMMETRIC, i), F.lit(""))
    s = lambda i: F.nullif(F.regexp_extract(t, _SYMMETRIC, i), F.lit(""))
    sign = s(1)
    return F.struct(
        F.when(~null_token & asym, a(1)).when(~null_token & sym, s(2)).alias("value"),
        F.when(~null_token & asym, a(2)).when(~null_token & sym, s(3)).alias("plus"),
        F.when(~null_token & asym, a(3)).when(~null_token & sym, s(3)).alias("minus"),
        F.when(~null_token & ~asym & sym, F.when(sign.isin("<", "<=", "≤"), "upper").when(sign.isin(">", ">=", "≥"), "lower").otherwise("measured")).when(~null_token & asym, "measured").alias("limit"),
        F.when(~null_token & asym, F.trim(a(4))).when(~null_token & sym, F.trim(s(4))).alias("unit"),
        F.when(null_token, "not_measured").when(~asym & ~sym, "unparsed").alias("null_reason"),
    )


_SENTENCE = rf"([A-Za-z][A-Za-z _]*?) = ({_NUMBER}) ?([A-Za-z/%]*) for ([A-Za-z0-9+. -]*[A-Za-z0-9])"


def observations(c: Column) -> Column:
    """Array of struct(field, value, unit, entity) for each ``field = value unit for entity`` in a text."""
    whole = F.regexp_extract_all(c, F.lit(_SENTENCE), F.lit(0))
    part = lambda m, i: F.nullif(F.trim(F.regexp_extract(m, _SENTENCE, i)), F.lit(""))
    return F.transform(whole, lambda m: F.struct(part(m, 1).alias("field"), part(m, 2).alias("value"), part(m, 3).alias("unit"), part(m, 4).alias("entity")))


def tokens(c: Column) -> Column:
    """Distinct lower-case words of letters, digits and underscores, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def relevance(title: Column, body: Column, keywords: list[str], has_id: Column, in_range: Column) -> Column:
    """0.55 for the share of keywords found as phrases, 0.25 for the share of their words, 0.1 each for an id and a year in range."""
    text = F.lower(F.concat_ws(" ", title, body))
    words = sorted({w for k in keywords for w in k.lower().split()})
    phrase = reduce(lambda a, b: a + b, [text.contains(k.lower()).cast("double") for k in keywords]) / len(keywords)
    hit = F.size(F.array_intersect(tokens(text), F.array(*[F.lit(w) for w in words]))) / F.lit(float(len(words)))
    return F.round(F.least(F.lit(1.0), 0.55 * phrase + 0.25 * hit + 0.1 * has_id.cast("double") + 0.1 * in_range.cast("double")), 6)


#: Units and words that make a claim's value unsafe or turn its sense.
_UNSURE_UNIT = r"(?i)\b(either|or|unknown)\b|[?≈~→]"
_NEGATION = r"(?i)\b(no|not|never|without|neither|nor|cannot)\b"


def unsafe_unit(unit: Column) -> Column:
    """The unit is a guess or a choice."""
    return F.coalesce(unit.rlike(_UNSURE_UNIT), F.lit(False))


def negation_lost(text: Column, normalized: Column) -> Column:
    """The text denies something and its normalized form doesn't."""
    return F.coalesce(text.rlike(_NEGATION) & ~normalized.rlike(_NEGATION), F.lit(False))


#: What authored text must not give away, and markup that paper content must not hold.
UNSAFE = r"(?i)(system prompt|hidden prompt|api[_ -]?key|password|secret key|chain[- ]of[- ]thought|private reasoning)"
UNSAFE_HTML = r"(?i)<\s*(script|iframe|object|embed|style)\b|javascript:|\bon\w+\s*="


def redacted(c: Column, pattern: str = UNSAFE) -> Column:
    """struct(unsafe, text) with matches blanked out."""
    return F.struct(F.coalesce(c.rlike(pattern), F.lit(False)).alias("unsafe"), F.regexp_replace(c, pattern, "[redacted]").alias("text"))


def csv_safe(c: Column, numeric: bool = False) -> Column:
    """Text that a spreadsheet would take for a formula gets a quote in front."""
    s = c.cast("string")
    return s if numeric else F.when(F.ltrim(s).rlike(r"^[=+@-]"), F.concat(F.lit("'"), s)).otherwise(s)


def label(field: str) -> str:
    """a field's name as a heading."""
    return " ".join(w[:1].upper() + w[1:] for w in field.split("_"))
