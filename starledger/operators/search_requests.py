"""Search requests brought to one form, so that equal searches have equal ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import stable_id
from ..functions.text import nfkc_casefold, squeeze

#: Years that stand for open ends, and the most candidates and rows a page.
FIRST_YEAR, LAST_YEAR, MOST = 1900, 2100, 100

_APART = "\u001f"


def _trimmed(c: Column) -> Column:
    """Texts without outer white space, blanks and nulls left out, each once in order of appearance; a unit separator is white space."""
    texts = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda k: F.regexp_replace(F.regexp_replace(k, _APART, " "), r"(?U)^\s+|\s+$", ""))
    return F.array_distinct(F.filter(texts, lambda k: k.isNotNull() & (k != "")))


def _folded(texts: Column) -> Column:
    """Each text folded; one call of the text function for the whole list."""
    return F.transform(F.split(nfkc_casefold(F.array_join(texts, _APART)), _APART), squeeze)


def normalized(requests: DataFrame, supported: tuple[str, ...], first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    """Requests (keywords, query, year_from, year_to, sources, candidate_limit, page_size) with reason, normal_keywords, normal_query, from_year, to_year, normal_sources, max_pages, query_id.

    Keywords are case-folded NFKC with single spaces, once each and sorted; a blank query is the keywords as they came. reason says why a request is refused (its other new columns are
    null): page_size, candidate_limit, keywords_missing, sources_missing, source_unsupported, years_reversed, years_out_of_range, in this order; null sizes
    are refused. Other columns stay; ValueError if one has a new column's name. Nothing is shuffled.
    """
    new = ("reason", "normal_keywords", "normal_query", "from_year", "to_year", "normal_sources", "max_pages", "query_id")
    clash = {c.lower() for c in requests.columns} & set(new)
    if clash:
        raise ValueError(f"requests already have columns {sorted(clash)}")
    size, limit = F.col("page_size"), F.col("candidate_limit")
    d = requests.withColumns({
        "__words": _trimmed(F.col("keywords")), "from_year": F.coalesce("year_from", F.lit(first)).cast("int"), "to_year": F.coalesce("year_to", F.lit(last)).cast("int"),
        "normal_sources": F.array_sort(F.array_distinct(F.coalesce("sources", F.array().cast("array<string>")))),
    })
    unknown = F.exists("normal_sources", lambda s: F.coalesce(~s.isin(*supported), F.lit(True))) if supported else F.lit(True)
    reason = (
        F.when(~F.coalesce(size.between(1, MOST), F.lit(False)), "page_size").when(~F.coalesce(limit.between(1, MOST), F.lit(False)), "candidate_limit")
        .when(F.size("__words") == 0, "keywords_missing").when(F.size("normal_sources") == 0, "sources_missing").when(unknown, "source_unsupported")
        .when(F.col("from_year") > F.col("to_year"), "years_reversed").when((F.col("from_year") < first) | (F.col("to_year") > last), "years_out_of_range")
    )
    asked = F.coalesce(F.nullif(F.regexp_replace("query", r"(?U)^\s+|\s+$", ""), F.lit("")), F.array_join("__words", " "))
    d = d.withColumns({
        "reason": reason, "normal_keywords": F.array_sort(F.array_distinct(_folded(F.col("__words")))), "normal_query": squeeze(nfkc_casefold(asked)), "max_pages": F.ceil(limit / size).cast("int"),
    })
    said = [F.array_join("normal_keywords", _APART), F.col("normal_query"), F.col("from_year"), F.col("to_year"), F.array_join("normal_sources", _APART), limit, size]
    d = d.withColumn("query_id", stable_id("query", *said))
    return d.select(*[F.col(f"`{c}`") for c in requests.columns], "reason", *[F.when(F.col("reason").isNull(), F.col(c)).alias(c) for c in new[1:]])
