"""Clusters, anomalies and models over parts, orders, embeddings and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import learning, portable
from ..scratch import new_path, table
from .catalog import query

_Z = """
    z AS (SELECT p_partkey, (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () AS a, (p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER () AS b FROM part),
    m AS (SELECT median(a) AS ma, median(b) AS mb FROM z), d AS (SELECT median(abs(a - ma)) AS da, median(abs(b - mb)) AS db FROM z, m),
    s AS (SELECT p_partkey, greatest(abs(0.6744897501960817::DOUBLE * (a - ma) / CASE WHEN da <= 1e-12 THEN 1 ELSE da END), abs(0.6744897501960817::DOUBLE * (b - mb) / CASE WHEN db <= 1e-12 THEN 1 ELSE db END)) AS score FROM z, m, d)"""


@query(f"WITH {_Z} SELECT p_partkey, round(score, 6) AS score FROM s WHERE score > 1.3")
def robust_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T10 L09"""
    return learning.robust_anomalies(table(spark, sf_dir, "part"), "p_partkey", ["p_size", "p_retailprice"], 1.3).withColumn("score", F.round("score", 6))


@query("""
    WITH RECURSIVE p AS (SELECT o_custkey AS k, (o_custkey * 13 % 1009)::DOUBLE / 10 AS x, (o_custkey * 29 % 1013)::DOUBLE / 10 AS y FROM (SELECT DISTINCT o_custkey FROM orders)),
    n AS (SELECT a.k AS p, b.k AS q, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4.0), c AS (SELECT p FROM n GROUP BY p HAVING count(*) >= 4),
    e AS (SELECT p, q FROM n WHERE p IN (FROM c) AND q IN (FROM c)), r(p, s) AS (SELECT p, p FROM c UNION SELECT e.q, r.s FROM r JOIN e ON e.p = r.p), l AS (SELECT p, min(s) AS label FROM r GROUP BY p),
    b AS (SELECT n.p, arg_min(l.label, (n.d2, n.q)) AS label FROM n JOIN l ON l.p = n.q WHERE n.p NOT IN (FROM c) GROUP BY n.p) SELECT k, coalesce(l.label, b.label) AS label FROM p LEFT JOIN l ON l.p = k LEFT JOIN b ON b.p = k
""")
def dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T07"""
    k = F.col("k")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct().select("k", (k * 13 % 1009 / F.lit(10.0)).alias("x"), (k * 29 % 1013 / F.lit(10.0)).alias("y"))
    return learning.dbscan(rows, "k", ["x", "y"], 2.0, 4)


_LABELLED = "j AS (SELECT quality AS actual, CASE WHEN n_chars > 300 THEN 1 ELSE 0 END AS predicted, least(0.99::DOUBLE, greatest(0.01::DOUBLE, n_chars / 5000.0::DOUBLE)) AS p FROM labels JOIN documents USING (doc_id))"


def _rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    p = F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("n_chars") / 5000.0))
    return table(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("quality").alias("actual"), F.when(F.col("n_chars") > 300, 1).otherwise(0).alias("predicted"), p.alias("p"))


@query(f"WITH {_LABELLED} SELECT actual, predicted, count(*) AS n FROM j GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T14"""
    return learning.confusion(_rule(spark, sf_dir), "actual", "predicted")


@query(f"""
    WITH {_LABELLED}, c AS (SELECT unnest([0, 1]) AS c), f AS (SELECT c, 2.0 * count_if(actual = c AND predicted = c) / nullif(count_if(actual = c) + count_if(predicted = c), 0) AS f1 FROM c, j GROUP BY c)
    SELECT count(*) AS n, round(avg((actual = predicted)::INT), 6) AS accuracy, (SELECT round(avg(coalesce(f1, 0)), 6) FROM f) AS macro_f1, round(avg(-(actual * ln(p) + (1 - actual) * ln(1 - p))), 6) AS log_loss, round(avg((p - actual) ** 2), 6) AS brier FROM j
""")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T14 A33"""
    out = learning.classification_metrics(_rule(spark, sf_dir), "actual", "predicted", "p")
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "log_loss", "brier")])


@query("SELECT label FROM embeddings GROUP BY label ORDER BY count(*) DESC, label LIMIT 1")
def majority_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T16"""
    return learning.majority(table(spark, sf_dir, "embeddings"), "label")


@query("SELECT label, count(*) AS n, round(count(*) * 0.2) AS test FROM embeddings GROUP BY label")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T12"""
    s = learning.split(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", 0.2, ["label"])
    return s.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("part") == "test").cast("double").alias("test"))


@query("WITH p AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT label, fold, CASE WHEN fold < n % 5 THEN n // 5 + 1 ELSE n // 5 END AS n FROM p, (SELECT unnest([0, 1, 2, 3, 4]) AS fold)")
def fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T13"""
    f = learning.folds(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", 5, ["label"])
    return f.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


def _vectors(spark: SparkSession, sf_dir: str, n: int = 64) -> tuple[DataFrame, list[str]]:
    return learning.as_columns(table(spark, sf_dir, "embeddings"), "embedding", n), [f"f{i}" for i in range(n)]


@query()
def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T06 A17"""
    rows, names = _vectors(spark, sf_dir)
    return learning.cluster_summary(learning.kmeans(rows, "vec_id", names, 10))


@query()
def pca_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T08"""
    rows, names = _vectors(spark, sf_dir)
    return learning.pca(rows, "vec_id", names)


@query()
def isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T09 L09"""
    return learning.isolation_forest(table(spark, sf_dir, "orders"), "o_orderkey", ["o_totalprice", "o_custkey"])


@query()
def tabular_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest over vectors, on a stratified holdout"""
    rows, names = _vectors(spark, sf_dir)
    parts = learning.split(rows, "vec_id", 0.2, ["label"])
    model = learning.fit(parts.where("part = 'train'"), names, "label", "classification", "forest")
    return learning.classification_metrics(model.transform(parts.where("part = 'test'")).withColumn("predicted", F.col("prediction").cast("int")), "label", "predicted")


@query()
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T17 T18"""
    rows, names = _vectors(spark, sf_dir)
    model = learning.fit(rows, names, "label", "classification", "forest")
    return spark.createDataFrame(learning.importance(model, names), "feature string, importance double")


@query()
def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T13"""
    rows, names = _vectors(spark, sf_dir)
    return learning.cross_validate(rows, "vec_id", names, "label", 3)


@query()
def linear_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T21 F05"""
    o = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"), F.avg("l_extendedprice").alias("price"))
    return learning.infer(learning.fit(o, ["q", "d"], "price", "regression", "linear"), o, "l_partkey", ["q", "d"])


@query()
def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T19"""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return learning.forecast(e, "user_id", "event_id", "value")


@query("""
    WITH o AS (SELECT l_partkey, avg(l_quantity) AS x, avg(l_discount) AS d, avg(l_extendedprice) AS y FROM lineitem GROUP BY l_partkey),
    c AS (SELECT avg(x) AS mx, avg(d) AS md, avg(y) AS my, covar_pop(x, x) AS xx, covar_pop(x, d) AS xd, covar_pop(d, d) AS dd, covar_pop(x, y) AS xy, covar_pop(d, y) AS dy FROM o),
    w AS (SELECT *, (xy * dd - dy * xd) / (xx * dd - xd * xd) AS a, (dy * xx - xy * xd) / (xx * dd - xd * xd) AS b FROM c)
    SELECT l_partkey, round(my + a * (x - mx) + b * (d - md), 3) AS prediction FROM o, w
""")
def portable_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear model written as a table, loaded under its hash and applied"""
    o = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"), F.avg("l_extendedprice").alias("price"))
    path = new_path(spark, "portable")
    card = portable.export(learning.fit(o, ["q", "d"], "price", "regression", "linear"), spark, ["q", "d"], "regression", path)
    got = portable.infer(portable.load(spark, path, card.content_hash), o, "l_partkey", ["q", "d"])
    return got.withColumn("prediction", F.round("prediction", 3))
