"""Pairs of duplicates come once without being grouped."""

from starledger.operators import papers


def test_duplicates_come_once(spark, capsys):
    rows = [(i, f"d{i % 3}" if i % 2 else None, f"a{i % 4}" if i % 3 else None, f"t{i % 2}", 2000 + i % 2, [f"n{i % 5}"], f"n{i % 5}") for i in range(24)]
    df = spark.createDataFrame(rows, "id long, doi_key string, arxiv_key string, title_key string, year int, author_keys array<string>, surname string")
    found = papers.duplicate_pairs(df)
    found.explain()
    assert "Aggregate" not in capsys.readouterr().out
    want = {}
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1:] != b[1:]:
                basis = "doi_exact" if a[1] and a[1] == b[1] else "arxiv_exact" if a[2] and a[2] == b[2] else None if a[3:5] != b[3:5] else "title_year_author" if a[6] == b[6] else "title_year_only"
                if basis:
                    want[a[0], b[0]] = basis
    classes = {}
    for a in rows:
        classes.setdefault(repr(a[1:]), a[0])
    first = set(classes.values())
    assert sorted((x["left_id"], x["right_id"], x["basis"]) for x in found.collect()) == sorted((a, b, v) for (a, b), v in want.items() if a in first and b in first)
