"""Profiles, statistics, correlations and tests over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hypothesis, profile
from ..scratch import table
from .catalog import query

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TEXTS = ["l_returnflag", "l_linestatus"]


def _rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    return df.select(*[F.round(c, other.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_CELLS = " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS value FROM lineitem" for f in NUMBERS)


@query(f"""
    WITH cells AS ({_CELLS}), texts AS ({" UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS value FROM lineitem" for f in TEXTS)})
    SELECT field, 'number' AS value_kind, count(*) AS present, CAST(0 AS BIGINT) AS absent, count(value) AS non_null, count(*) - count(value) AS null_count,
        count(DISTINCT value) AS distinct_count, count(value) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(median(value), 6) AS median
    FROM cells GROUP BY field
    UNION ALL
    SELECT field, 'string', count(*), CAST(0 AS BIGINT), count(value), count(*) - count(value), count(DISTINCT value), NULL, NULL, NULL, NULL, NULL FROM texts GROUP BY field
""")
def data_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S04 F01 A01 A02 A04"""
    out = profile.data_profile(table(spark, sf_dir, "lineitem").select(*NUMBERS, *TEXTS))
    return _rounded(out)


@query("""
    WITH cells AS (
        SELECT 'l_returnflag' AS field, l_returnflag AS value FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem
        UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR) FROM lineitem UNION ALL SELECT 'l_partkey', CAST(l_partkey AS VARCHAR) FROM lineitem
    ), freq AS (SELECT field, value, count(*) AS n FROM cells WHERE value IS NOT NULL GROUP BY ALL),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank, sum(n) OVER (PARTITION BY field) AS total, count(*) OVER (PARTITION BY field) AS distinct_count FROM freq
    ) SELECT field, CAST(rank AS INTEGER) AS rank, value, n, round(n / total, 4) AS share, distinct_count FROM ranked WHERE rank <= 5 AND distinct_count BETWEEN 2 AND 50
""")
def categorical_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A03"""
    return profile.categorical_summary(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber", "l_partkey"])


@query("""
    WITH cells AS (SELECT 'o_totalprice' AS field, o_totalprice AS value FROM orders UNION ALL SELECT 'o_custkey', o_custkey FROM orders),
    placed AS (SELECT field, value, row_number() OVER (PARTITION BY field ORDER BY value) AS i, count(*) OVER (PARTITION BY field) AS n FROM cells WHERE value IS NOT NULL),
    q AS (SELECT field, max(n) AS count, median(value) FILTER (i <= n // 2 OR n = 1) AS q1, median(value) FILTER (i > (n + 1) // 2 OR n = 1) AS q3 FROM placed GROUP BY field),
    f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q)
    SELECT field, count, round(q1, 4) AS q1, round(q3, 4) AS q3, round(iqr, 4) AS iqr, round(low, 4) AS low, round(high, 4) AS high,
        (SELECT count(*) FROM cells c WHERE c.field = f.field AND (c.value < f.low OR c.value > f.high)) AS outliers
    FROM f
""")
def outlier_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A05"""
    return _rounded(profile.outlier_fences(table(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"]), 4)


@query("""
    WITH cells AS (SELECT 'p_retailprice' AS field, p_retailprice AS value FROM part UNION ALL SELECT 'p_size', p_size FROM part)
    SELECT field, count(value) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stddev, round(median(value), 6) AS median FROM cells GROUP BY field
""")
def descriptive_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A06"""
    return _rounded(profile.descriptive(table(spark, sf_dir, "part"), ["p_retailprice", "p_size"]))


@query("""
    WITH t AS (SELECT l_quantity AS a, l_extendedprice AS b, l_discount AS c, CAST(1 AS DOUBLE) AS d FROM lineitem)
    SELECT * FROM (
        SELECT 'l_quantity' AS left_field, 'l_extendedprice' AS right_field, count(*) AS n, round(corr(a, b), 6) AS coefficient FROM t
        UNION ALL SELECT 'l_quantity', 'l_discount', count(*), round(corr(a, c), 6) FROM t
        UNION ALL SELECT 'l_extendedprice', 'l_discount', count(*), round(corr(b, c), 6) FROM t
        UNION ALL SELECT 'l_quantity', 'constant', count(*), 0.0 FROM t UNION ALL SELECT 'l_extendedprice', 'constant', count(*), 0.0 FROM t UNION ALL SELECT 'l_discount', 'constant', count(*), 0.0 FROM t
    )
""")
def pearson_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A07"""
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", F.lit(1.0).alias("constant"))
    return _rounded(profile.pearson(rows, rows.columns))


@query("""
    WITH r AS (
        SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a,
            rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b,
            rank() OVER (ORDER BY l_tax) + (count(*) OVER (PARTITION BY l_tax) - 1) / 2.0 AS c FROM lineitem
    )
    SELECT 'l_quantity' AS left_field, 'l_extendedprice' AS right_field, count(*) AS n, round(corr(a, b), 6) AS coefficient FROM r
    UNION ALL SELECT 'l_quantity', 'l_tax', count(*), round(corr(a, c), 6) FROM r UNION ALL SELECT 'l_extendedprice', 'l_tax', count(*), round(corr(b, c), 6) FROM r
""")
def spearman_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A08 W02"""
    return _rounded(profile.spearman(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]))


def _test(df: DataFrame) -> DataFrame:
    """Without p, which SQL lacks; tests hold p against tabulated values."""
    return _rounded(df.drop("p_value"))


@query("""
    SELECT 'one_sample_t' AS test, count(*) AS n, round((avg(c_acctbal) - 4500) / (stddev_samp(c_acctbal) / sqrt(count(*))), 6) AS statistic, 'cohens_d' AS effect_name,
        round((avg(c_acctbal) - 4500) / stddev_samp(c_acctbal), 6) AS effect FROM customer
""")
def t_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A09"""
    return _test(hypothesis.t_one(table(spark, sf_dir, "customer"), "c_acctbal", 4500.0))


_SIDES = "SELECT CASE WHEN l_returnflag = 'A' THEN l_extendedprice END AS a, CASE WHEN l_returnflag = 'N' THEN l_extendedprice END AS n, CASE WHEN l_returnflag = 'R' THEN l_extendedprice END AS r FROM lineitem"


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(*[F.when(F.col("l_returnflag") == f, F.col("l_extendedprice")).alias(f.lower()) for f in ("A", "N", "R")])


@query(f"""
    WITH s AS (SELECT count(a) AS n1, avg(a) AS m1, var_samp(a) AS v1, count(n) AS n2, avg(n) AS m2, var_samp(n) AS v2 FROM ({_SIDES}))
    SELECT 'welch_t' AS test, n1 + n2 AS n, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS statistic, 'cohens_d' AS effect_name,
        round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) AS effect FROM s
""")
def t_welch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10"""
    return _test(hypothesis.t_welch(_sides(spark, sf_dir), "a", "n"))


@query("""
    WITH d AS (SELECT l_discount - l_tax AS x FROM lineitem)
    SELECT 'paired_t' AS test, count(*) AS n, round(avg(x) / (stddev_samp(x) / sqrt(count(*))), 4) AS statistic, 'cohens_d' AS effect_name, round(avg(x) / stddev_samp(x), 4) AS effect FROM d
""")
def t_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11"""
    return _rounded(hypothesis.t_paired(table(spark, sf_dir, "lineitem"), "l_discount", "l_tax").drop("p_value"), 4)


@query(f"""
    WITH c AS (SELECT 1 AS g, a AS v FROM ({_SIDES}) UNION ALL SELECT 2, n FROM ({_SIDES}) UNION ALL SELECT 3, r FROM ({_SIDES})),
    g AS (SELECT g, count(v) AS n, avg(v) AS m, var_pop(v) * count(v) AS w FROM c WHERE v IS NOT NULL GROUP BY g),
    s AS (SELECT count(*) AS k, sum(n) AS n, sum(w) AS w, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS b FROM g)
    SELECT 'one_way_anova' AS test, CAST(n AS BIGINT) AS n, round((b / (k - 1)) / (w / (n - k)), 4) AS statistic, 'eta_squared' AS effect_name, round(b / (b + w), 6) AS effect FROM s
""")
def anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13"""
    return _rounded(hypothesis.anova(_sides(spark, sf_dir), ["a", "n", "r"]).drop("p_value"), 6, statistic=4)


@query("""
    WITH o AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem GROUP BY ALL),
    full_grid AS (
        SELECT r.a, c.b, coalesce(o.o, 0) AS o, r.n * c.n / (SELECT count(*) FROM lineitem) AS e FROM (SELECT l_returnflag AS a, count(*) AS n FROM lineitem GROUP BY 1) r
        CROSS JOIN (SELECT l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1) c LEFT JOIN o ON o.a = r.a AND o.b = c.b
    ), s AS (SELECT sum((o - e) * (o - e) / e) AS x, CAST(sum(o) AS BIGINT) AS n, count(DISTINCT a) AS r, count(DISTINCT b) AS c, bool_or(e < 5) AS low FROM full_grid)
    SELECT 'chi_square' AS test, n, round(x, 6) AS statistic, 'cramers_v' AS effect_name, round(sqrt(x / (n * (least(r, c) - 1))), 6) AS effect, (r - 1) * (c - 1) AS dof, low AS low_expected_cells FROM s
""")
def chi2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14"""
    return _test(hypothesis.chi_square(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus"))


@query("""
    WITH x AS (SELECT o_orderstatus = 'F' AS f, o_totalprice AS v FROM orders WHERE o_orderstatus IN ('F', 'O')),
    r AS (SELECT f, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM x),
    s AS (SELECT sum(r) FILTER (f) AS r1, count(*) FILTER (f) AS n1, count(*) AS n FROM r)
    SELECT 'mann_whitney_u' AS test, n, round(r1 - n1 * (n1 + 1) / 2, 3) AS statistic, 'rank_biserial' AS effect_name, round(1 - 2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * (n - n1)), 6) AS effect FROM s
""")
def mann_whitney_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12"""
    rows = table(spark, sf_dir, "orders").select(*[F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")).alias(s) for s in ("F", "O")])
    return _rounded(hypothesis.mann_whitney(rows, "F", "O").drop("p_value"), 6, statistic=3)


@query()
def hypothesis_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered tests with p and decision; tests hold p against tables."""
    customer, sides = table(spark, sf_dir, "customer"), _sides(spark, sf_dir)
    few = table(spark, sf_dir, "nation").join(customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.avg("c_acctbal").alias("balance")), "n_nationkey")
    return hypothesis.decided([
        hypothesis.t_one(customer, "c_acctbal", 4500.0), hypothesis.t_welch(sides, "a", "n"), hypothesis.anova(sides, ["a", "n", "r"]),
        hypothesis.mann_whitney(sides, "a", "n"), hypothesis.shapiro_wilk(few, "balance"),
    ])


@query("SELECT o_orderpriority AS x, o_totalprice AS y FROM orders WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL")
def chart_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F06"""
    return profile.chart(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice").toDF("x", "y")
