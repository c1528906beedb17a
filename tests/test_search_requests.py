"""Search requests: one form, refusals in order, nulls and blanks."""

import pytest
from pyspark.sql import functions as F

from starledger.operators.search_requests import normalized

SCHEMA = "i int, keywords array<string>, query string, year_from int, year_to int, sources array<string>, candidate_limit int, page_size int"


def test_one_form_and_refusals(spark):
    rows = [
        (1, [" Ｓtar  disk", "star disk", None, "", "Ωmega"], None, None, None, ["crossref", "crossref"], 25, 10), (2, ["ωMEGA", "STAR disk"], "star disk  ωmega", 1900, 2100, ["crossref"], 25, 10),
        (3, None, "q", None, None, None, 25, None), (4, ["a"], "q", None, None, ["crossref"], 101, 1), (5, [" "], "q", None, None, ["crossref"], 1, 1), (6, ["a"], "q", None, None, None, 1, 1),
        (7, ["a"], "q", None, None, ["crossref", None], 1, 1), (8, ["a"], "q", 2001, 2000, ["crossref"], 1, 1), (9, ["a"], "q", 1899, None, ["crossref"], 1, 1), (10, ["b\u001fa"], " ", 2000, 2000, ["crossref"], 100, 3),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["i"]: r for r in normalized(df, ("crossref",)).collect()}
    assert [got[i].reason for i in range(1, 11)] == [None, None, "page_size", "candidate_limit", "keywords_missing", "sources_missing", "source_unsupported", "years_reversed", "years_out_of_range", None]
    assert got[1].normal_keywords == got[2].normal_keywords == ["star disk", "ωmega"] and got[1].normal_query == "star disk star disk ωmega" and got[2].normal_query == "star disk ωmega"
    assert (got[1].from_year, got[1].to_year, got[1].max_pages, got[1].normal_sources) == (1900, 2100, 3, ["crossref"]) and got[1].query_id != got[2].query_id
    assert got[10].normal_keywords == ["b a"] and got[10].normal_query == "b a" and got[10].max_pages == 34
    assert got[8].query_id is None and got[8].normal_keywords is None
    same = normalized(df.where("i = 2").withColumn("keywords", F.reverse("keywords")), ("crossref",)).first()
    assert same.query_id == got[2].query_id
    assert normalized(df.limit(0), ("crossref",)).count() == 0
    with pytest.raises(ValueError):
        normalized(df.withColumn("Reason", F.lit(1)), ("crossref",))
