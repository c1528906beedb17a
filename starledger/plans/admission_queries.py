"""Predicates, guards and readers, each over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..functions.hashing import has_duplicates, sorted_set
from ..operators import admission, contract_gate, documents, fusion, match
from ..operators.admission import Field
from ..scratch import new_path, table
from ..sources import catalogs
from .catalog import query

_HOLES = ["CASE p_partkey % 5 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE p_name END AS name", "CASE WHEN p_partkey % 3 = 0 THEN CAST('NaN' AS DOUBLE) ELSE p_retailprice END AS price", "CASE WHEN p_partkey % 7 > 0 THEN p_size END AS target"]


@query(f"WITH h AS (SELECT p_partkey, {', '.join(_HOLES)} FROM part) SELECT p_partkey, trim(coalesce(name, '')) = '' AS missing, NOT isnan(price) AS complete, NOT isnan(price) AND target IS NOT NULL AS usable FROM h")
def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F02 F03 F04"""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", *_HOLES)
    return rows.select("p_partkey", numbers.missing(F.col("name")).alias("missing"), numbers.complete(["price"]).alias("complete"), numbers.complete(["price", "target"]).alias("usable"))


@query(r"""
    WITH t AS (SELECT c_custkey, c_name || CASE c_custkey % 4 WHEN 0 THEN ' My API_Key is here' WHEN 1 THEN ' chain of thought, PASSWORD' ELSE ' nothing' END AS t FROM customer)
    SELECT c_custkey, c_custkey % 4 < 2 AS unsafe, CASE c_custkey % 4 WHEN 0 THEN replace(t, 'API_Key', '[redacted]') WHEN 1 THEN replace(replace(t, 'chain of thought', '[redacted]'), 'PASSWORD', '[redacted]') ELSE t END AS text FROM t
""")
def unsafe_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X19"""
    tail = F.expr("CASE c_custkey % 4 WHEN 0 THEN ' My API_Key is here' WHEN 1 THEN ' chain of thought, PASSWORD' ELSE ' nothing' END")
    return table(spark, sf_dir, "customer").select("c_custkey", text.redacted(F.concat("c_name", tail)).alias("r")).select("c_custkey", "r.*")


@query("WITH l AS (SELECT p_partkey, [p_type, lower(p_type), p_brand, p_type, CAST(p_size AS VARCHAR)] AS l FROM part) SELECT p_partkey, array_to_string(list_transform(list_sort(list_transform(list_distinct(l), lambda x: {'k': lower(x), 'v': x})), lambda s: s.v), '|') AS items, len(list_distinct(list_transform(l, lambda x: lower(x)))) < 5 AS repeats FROM l")
def sorted_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K05"""
    items = F.array("p_type", F.lower("p_type"), "p_brand", "p_type", F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(sorted_set(items), "|").alias("items"), has_duplicates(items).alias("repeats"))


@query("SELECT o_orderkey, md5(o_orderstatus) AS digest, o_totalprice FROM orders WHERE o_orderkey % 3 = 0")
def resolved_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10"""
    raw = table(spark, sf_dir, "orders").select("o_orderkey", F.md5(F.col("o_orderstatus").cast("binary")).alias("digest"), "o_totalprice")
    return fusion.resolve(raw.where("o_orderkey % 3 = 0").select("o_orderkey", "digest"), raw, ["o_orderkey"], "digest")


@query("""
    SELECT p_partkey, CASE WHEN p_retailprice / 50 > 0 AND p_size <= p_retailprice / 50 THEN round(degrees(asin(p_size / (p_retailprice / 50))), 6) END AS radius,
        round(p_size * 612 / 850.0, 6) AS x0, round(792 - (p_size + 20) * 792 / 1100.0, 6) AS y0, round((p_size + 10) * 612 / 850.0, 6) AS x1, round(792 - p_size * 792 / 1100.0, 6) AS y1 FROM part
""")
def radii_and_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M12 M14"""
    s = F.col("p_size").cast("double")
    box = numbers.page_box(F.struct(s.alias("x0"), s.alias("y0"), (s + 10).alias("x1"), (s + 20).alias("y1")), F.lit(850.0), F.lit(1100.0), F.lit(612.0), F.lit(792.0))
    out = table(spark, sf_dir, "part").select("p_partkey", F.round(numbers.apparent_radius(s, F.col("p_retailprice") / 50), 6).alias("radius"), box.alias("b"))
    return out.select("p_partkey", "radius", *[F.round(f"b.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("""
    WITH o AS (SELECT c_custkey, (c_custkey % 50) * 300 - 7000.0 AS y, (c_custkey % 37) * 400 - 7200.0 AS z, 6378.137 AS a, 6378.137 * (1 - 1 / 298.257223563) AS b FROM customer),
    h AS (SELECT *, 1 - (y / a) ** 2 - (z / b) ** 2 AS d FROM o), p AS (SELECT *, CASE WHEN d >= 0 THEN a * sqrt(d) END AS x FROM h)
    SELECT c_custkey, round(degrees(atan2(z, sqrt(x * x + y * y) * (b / a) ** 2)), 6) AS latitude, round(degrees(atan2(y, x)), 6) AS longitude,
        round(asin((696000.0 - 1737.4) / 149000000.0), 9) AS umbra, round(asin((696000.0 + 1737.4) / 149000000.0), 9) AS penumbra FROM p
""")
def shadow_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where lines along the x axis meet the Earth, and the half angles of a shadow"""
    k = F.col("c_custkey")
    point = lambda x, y, z: F.struct(F.lit(x).cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))
    zero = F.lit(0.0)
    cone = numbers.shadow(point(149_384_400, zero, zero), point(384_400, zero, zero), 696_000.0, 1737.4)
    lines = table(spark, sf_dir, "customer").select(k, point(20_000, k % 50 * 300 - 7000, k % 37 * 400 - 7200).alias("origin"), point(-1, zero, zero).alias("axis"))
    at = numbers.on_ellipsoid(F.col("origin"), F.col("axis"))
    return lines.select(k, F.round(at["latitude"], 6).alias("latitude"), F.round(at["longitude"], 6).alias("longitude"), F.round(cone["umbra"], 9).alias("umbra"), F.round(cone["penumbra"], 9).alias("penumbra"))


@query("SELECT s_suppkey AS page_id, 0 AS table_no, r AS row_no, c AS col_no, CASE WHEN r = 0 THEN ['Name', 'Key', 'Key'][c + 1] ELSE [s_name, CAST(s_suppkey AS VARCHAR), CAST(s_nationkey AS VARCHAR)][c + 1] END AS value FROM supplier, (VALUES (0), (1)) a(r), (VALUES (0), (1), (2)) b(c)")
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each supplier, with a heading over two columns"""
    page = F.format_string("<p>x</p><table><tr><th>Name</th><th colspan='2'>Key</th></tr><tr><td><b>%s</b></td><td> %d</td><td>%d </td></tr></table>", "s_name", "s_suppkey", "s_nationkey")
    pages = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page_id"), page.alias("html"))
    return documents.html_cells(pages, "page_id", "html")


@query("SELECT CAST(c_custkey AS VARCHAR) AS source_id, CASE WHEN c_custkey % 6 > 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 4 > 0 THEN c_acctbal END AS balance FROM customer")
def typed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of text to identifiers, text and numbers, blank ones null"""
    raw = table(spark, sf_dir, "customer").selectExpr("concat(' ', c_custkey) AS a", "CASE WHEN c_custkey % 6 > 0 THEN c_mktsegment ELSE ' ' END AS b", "CASE WHEN c_custkey % 4 > 0 THEN cast(c_acctbal AS string) END AS c")
    kinds = {"a": ("identifier", "source_id"), "b": ("text", "segment"), "c": ("number", "balance")}
    return raw.select(*[catalogs.typed_cell(F.col(c), kind, name) for c, (kind, name) in kinds.items()])


_TAP = {"source_id": "identifier", "name": "text", "balance": "number"}
_TAP_SQL = "SELECT CAST(s_suppkey AS VARCHAR) AS source_id, s_name AS name, CASE WHEN s_suppkey % 4 > 0 THEN s_acctbal END AS balance FROM supplier"


@query(_TAP_SQL)
def tap_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as a service would, read back"""
    path = new_path(spark, "tap-csv")
    table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS source_id", "s_name AS name", "CASE WHEN s_suppkey % 4 > 0 THEN s_acctbal END AS balance").write.csv(path, header=True)
    return catalogs.read_tap_csv(spark, path, _TAP)


@query(_TAP_SQL)
def tap_votable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as a service would, read back"""
    path = new_path(spark, "tap-votable")
    cells = table(spark, sf_dir, "supplier").selectExpr("array(cast(s_suppkey AS string), s_name, CASE WHEN s_suppkey % 4 > 0 THEN cast(s_acctbal AS string) ELSE '' END) AS TD")
    cells.write.format("xml").option("rootTag", "TABLEDATA").option("rowTag", "TR").save(path)
    return catalogs.read_votable(spark, path, _TAP)


#: Columns whose types are told apart; their services' type names are those of the tables.
_TYPED = {"part": ["p_partkey", "p_name", "p_size", "p_retailprice"], "events": ["event_id", "ts", "value", "props"], "embeddings": ["vec_id", "embedding", "label"]}
_CATEGORY = "CASE WHEN t IN ('VARCHAR', 'TIMESTAMP', 'DATE') THEN 'string' WHEN t IN ('BIGINT', 'INTEGER', 'SMALLINT') THEN 'integer' WHEN t IN ('DOUBLE', 'FLOAT') OR t LIKE 'DECIMAL%' THEN 'number' END"


@query("SELECT field, " + _CATEGORY + " AS category, n FROM (" + " UNION ALL ".join(
    f"SELECT '{name}.{c}' AS field, max(CASE WHEN typeof({c}) LIKE 'TIMESTAMP%' THEN 'TIMESTAMP' ELSE typeof({c}) END) AS t, count({c}) AS n FROM {name}" for name, columns in _TYPED.items() for c in columns
) + ")")
def type_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of three tables by the category of their type, with their values counted; a list has none"""
    out = None
    for name, columns in _TYPED.items():
        t = table(spark, sf_dir, name)
        kinds = {f.name: catalogs.type_category(f.dataType.simpleString().replace("timestamp_ntz", "timestamp")) for f in t.schema}
        counts = t.agg(*[F.count(c).alias(c) for c in columns])
        rows = counts.select(F.explode(F.array(*[F.struct(F.lit(f"{name}.{c}").alias("field"), F.lit(kinds[c]).cast("string").alias("category"), F.col(c).alias("n")) for c in columns])).alias("r")).select("r.*")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT unnest(['missing n_code', 'n_nationkey is integer, not string', 'unexpected n_regionkey']) AS finding")
def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations against a contract that they don't keep"""
    found = catalogs.drift(table(spark, sf_dir, "nation"), {"n_nationkey": "string", "n_name": "string", "n_code": "string"})
    return spark.createDataFrame([(x,) for x in found], "finding string")


@query("SELECT n_nationkey, n_name FROM nation WHERE lower(replace(n_name, ' ', '')) = (SELECT lower(replace(min(n_name), ' ', '')) FROM nation)")
def object_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nation by its name, written with other case and spaces"""
    nations = table(spark, sf_dir, "nation")
    name = nations.agg(F.min("n_name")).first()[0]
    return catalogs.find_object(nations, "n_name", " ".join(name.swapcase())).select("n_nationkey", "n_name")


@query("""SELECT 'Order <' || o_orderkey || '>' AS title, 'Author ' || o_custkey AS author, year(o_orderdate)::INT AS year, '10.1/' || o_orderkey AS doi FROM orders""")
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of search results for each order"""
    item = F.struct(
        F.array(F.format_string("<i>Order</i> &lt;%d&gt;", "o_orderkey")).alias("title"), F.array(F.struct(F.lit("Author").alias("given"), F.col("o_custkey").cast("string").alias("family"))).alias("author"),
        F.struct(F.array(F.array(F.year("o_orderdate"))).alias("date-parts")).alias("issued"), F.format_string("10.1/%d", "o_orderkey").alias("DOI"),
    )
    pages = table(spark, sf_dir, "orders").select(F.to_json(F.struct(F.struct(F.array(item).alias("items")).alias("message"))).alias("body"))
    found = catalogs.search_items(pages, "body")
    unescaped = F.replace(F.replace("title", F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))
    return found.select(unescaped.alias("title"), F.get("authors", F.lit(0)).alias("author"), "year", "doi")


@query("SELECT c_nationkey AS page_no, c_custkey, c_name FROM customer")
def recorded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each nation's customers, recorded and replayed"""
    path = new_path(spark, "recorded")
    row = F.struct(F.col("c_custkey").cast("string").alias("c_custkey"), "c_name")
    # of the generated customers a nation has a small share; a page holds one service answer
    pages = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("page_no")).agg(F.to_json(F.collect_list(row)).alias("rows"))
    pages.withColumn("sha256", F.sha2("rows", 256)).write.json(path)
    return catalogs.recorded(spark, path).select("page_no", F.col("row.c_custkey").cast("long").alias("c_custkey"), F.col("row.c_name").alias("c_name"))


_CUSTOMERS = [Field("ident", "identity", nullable=False), Field("c_name", "name", nullable=False), Field("c_acctbal", "balance", unit="usd", canonical_unit="cent", factor="100"), Field("ra", "right_ascension", unit="deg", canonical_unit="deg"), Field("dec", "declination", unit="deg", canonical_unit="deg")]
_FAULTY = [
    "CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 50 = 1 THEN '  ' WHEN c_custkey % 2 = 0 THEN concat(' Host ', CAST(c_custkey % 90 AS VARCHAR(9))) ELSE concat('host  ', CAST(c_custkey % 90 AS VARCHAR(9)), ' ') END AS ident",
    "CASE WHEN c_custkey % 40 > 0 THEN c_name END AS c_name", "c_acctbal", "CASE WHEN c_custkey % 30 > 0 THEN CAST(c_acctbal AS DOUBLE) / 20 END AS ra", "CASE WHEN c_custkey % 31 = 0 THEN CAST('NaN' AS DOUBLE) ELSE c_custkey % 100 - 8.0 END AS dec",
]


@query(rf"""
    WITH t AS (SELECT {", ".join(_FAULTY)} FROM customer), k AS (SELECT *, lower(trim(regexp_replace(ident, '\s+', ' ', 'g'))) AS i FROM t),
    r AS (
        SELECT 'null_key' AS reason, count(*) AS rows FROM k WHERE coalesce(i, '') = '' UNION ALL SELECT 'null_value', count(*) FROM k WHERE c_name IS NULL
        UNION ALL SELECT 'half_coordinate', count(*) FROM k WHERE (ra IS NULL) <> (dec IS NULL) UNION ALL SELECT 'coordinate_out_of_range', count(*) FROM k WHERE ra < 0 OR ra >= 360 OR isnan(dec) OR dec < -90 OR dec > 90
        UNION ALL SELECT 'duplicate_identity', count(*) FROM (SELECT count(*) OVER (PARTITION BY i) AS n FROM k WHERE i <> '') WHERE n > 1 UNION ALL SELECT 'status_disagrees', 1
    ) SELECT * FROM r WHERE rows > 0
""")
def table_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reason against a table with faults, of which the source says that it is empty"""
    fields = admission.projection(["ident", "c_name", "c_acctbal", "ra", "dec"], _CUSTOMERS)
    return admission.rejections(table(spark, sf_dir, "customer").selectExpr(*_FAULTY), fields, "empty")


@query("""
    WITH c AS (SELECT lower(c_name) AS row_id, unnest(['identity', 'balance', 'segment']) AS field_id, unnest([c_name, CAST(CAST(c_acctbal AS DECIMAL(20,6)) * CAST(100 AS DECIMAL(12,6)) AS DECIMAL(32,6))::VARCHAR, c_mktsegment]) AS value, unnest([NULL, 'cent', NULL]) AS unit, unnest(['c_name', 'c_acctbal', 'c_mktsegment']) AS f FROM customer)
    SELECT row_id, field_id, value, unit, 'customers/' || row_id || '/' || f AS locator FROM c
""")
def admitted_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of a table in canonical units, with locators"""
    return _admitted(spark, sf_dir)


def _admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = [Field("c_name", "identity", nullable=False), Field("c_acctbal", "balance", unit="usd", canonical_unit="cent", factor="100"), Field("c_mktsegment", "segment")]
    return admission.admitted(table(spark, sf_dir, "customer"), "customers", admission.projection(["c_name", "c_acctbal", "c_mktsegment"], manifest))


@query("""
    WITH m(metric_id, n) AS (SELECT 'source_scope_completeness', 1 UNION ALL SELECT 'dataset_unit_consistency', count(c_acctbal) FROM customer UNION ALL SELECT 'dataset_evidence_coverage', 3 * count(*) FROM customer)
    SELECT answer, metric_id, CASE answer WHEN 'complete' THEN 'determinate' ELSE 'insufficient_source' END AS status, (CASE WHEN answer = 'complete' OR metric_id <> 'source_scope_completeness' THEN n ELSE 0 END)::BIGINT AS numerator,
        n::BIGINT AS denominator, CASE answer WHEN 'complete' THEN 'pass' ELSE 'insufficient' END AS result FROM m, (VALUES ('complete'), ('truncated')) a(answer)
""")
def admitted_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the admitted table and their checks, for a complete answer and for a truncated one"""
    limits = [contract_gate.Check(m, m, "gte", "1") for m in ("source_scope_completeness", "dataset_unit_consistency", "dataset_evidence_coverage")]
    out = None
    for answer in ("complete", "truncated"):
        metrics = admission.table_metrics(_admitted(spark, sf_dir), answer)
        checks = contract_gate.checked(metrics, contract_gate.no_conditions(spark), limits).select("metric_id", "result")
        one = metrics.join(checks, "metric_id").select(F.lit(answer).alias("answer"), "metric_id", "status", "numerator", "denominator", "result")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT case_id, CASE WHEN n > most THEN 'CROSSMATCH_CAPACITY_EXCEEDED' ELSE 'accepted' END AS outcome, CASE WHEN n <= most THEN n END AS pairs FROM (SELECT count(*) AS n FROM supplier), (VALUES ('tight', 1), ('wide', 1000000000)) l(case_id, most)")
def guarded_crossmatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A match that its capacity rejects before any pair is formed, and one that it lets through; each supplier meets itself by identifier"""
    s = table(spark, sf_dir, "supplier")
    none = F.lit(None)
    c = s.select(
        F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("host_star").alias("level"), F.lit("a").alias("source"), F.lit(True).alias("complete"), F.col("s_suppkey").cast("string").alias("tic_id"),
        none.cast("string").alias("gaia_id"), F.col("s_name").alias("name"), none.cast("double").alias("ra"), none.cast("double").alias("dec"),
    )
    out = None
    for name, most in (("tight", 1), ("wide", 10**9)):
        try:
            found = match.catalog_crossmatch(c, c.withColumn("source", F.lit("b")), limits=(most, 10**18))["metrics"].select(F.lit("accepted").alias("outcome"), F.col("edges").alias("pairs"))
        except match.CapacityExceeded as e:
            found = spark.createDataFrame([(e.code, None)], "outcome string, pairs long")
        one = found.select(F.lit(name).alias("case_id"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("""
    WITH a AS (SELECT count(*) AS n, count_if(c_custkey % 3 = 0) AS h, count_if(c_custkey % 3 = 1) AS p FROM customer), b AS (SELECT count(*) AS n, count_if(s_suppkey % 3 = 0) AS h, count_if(s_suppkey % 3 = 2) AS q FROM supplier), l(case_id, most_rows, most_pairs) AS (VALUES ('small', 500, 250000), ('tight', 1000000000, 1), ('wide', 1000000000, 1000000000000))
    SELECT case_id, a.n AS left_rows, b.n AS right_rows, CAST(a.h * b.h + a.p * b.q AS BIGINT) AS eligible_pairs, CASE WHEN greatest(a.n, b.n) > most_rows OR a.h * b.h + a.p * b.q > most_pairs THEN 'capacity_exceeded' ELSE 'accepted' END AS verdict FROM a, b, l
""")
def match_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts meet hosts and candidates meet assertions, under three pairs of limits"""
    kinds = F.array(*[F.lit(x) for x in ("host", "candidate", "assertion")])
    left = table(spark, sf_dir, "customer").select(F.get(kinds, (F.col("c_custkey") % 3).cast("int")).alias("kind"))
    right = table(spark, sf_dir, "supplier").select(F.get(kinds, (F.col("s_suppkey") % 3).cast("int")).alias("kind"))
    out = None
    for name, rows, pairs in (("small", 500, 250_000), ("tight", 10**9, 1), ("wide", 10**9, 10**12)):
        one = admission.capacity(left, right, "kind", [("host", "host"), ("candidate", "assertion")], rows, pairs).select(F.lit(name).alias("case_id"), "*")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("eligible_pairs", F.col("eligible_pairs").cast("long"))
