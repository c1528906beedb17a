"""Graphs, versions, audits and documents over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import documents, graph
from ..scratch import Scratch, table
from .catalog import query


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "orders")}
    nodes = graph.nodes({"region": (t["region"], "r_regionkey", "r_name"), "nation": (t["nation"], "n_nationkey", "n_name"), "customer": (t["customer"], "c_custkey", "c_name")})
    edges = graph.edges([
        (t["nation"].withColumn("evidence", F.col("n_name")), "region", "n_regionkey", "has_nation", "nation", "n_nationkey"),
        (t["customer"].withColumn("evidence", F.when(F.col("c_acctbal") > 0, F.col("c_name"))), "nation", "c_nationkey", "has_customer", "customer", "c_custkey"),
        (t["orders"].withColumn("evidence", F.col("o_orderpriority")), "customer", "o_custkey", "placed", "order", "o_orderkey"),
    ])
    s = Scratch(spark, "graph")
    return s.keep(nodes, "nodes"), s.keep(edges, "edges")


@query("""
    SELECT 'region' AS kind, count(*) AS n, count(DISTINCT r_regionkey) AS ids FROM region UNION ALL SELECT 'nation', count(*), count(DISTINCT n_nationkey) FROM nation UNION ALL SELECT 'customer', count(*), count(DISTINCT c_custkey) FROM customer
    UNION ALL SELECT 'has_nation', count(*), count(DISTINCT n_nationkey) FROM nation UNION ALL SELECT 'has_customer', count(*), count(DISTINCT c_custkey) FROM customer UNION ALL SELECT 'placed', count(*), count(DISTINCT o_orderkey) FROM orders
""")
def graph_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G08 G09 K02"""
    nodes, edges = _graph(spark, sf_dir)
    both = nodes.select(F.col("node_type").alias("kind"), F.col("node_id").alias("id")).union(edges.select("edge_type", "edge_id"))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


@query("""
    SELECT 'missing_endpoint' AS reason, count(*) AS n FROM orders UNION ALL SELECT 'missing_evidence', count(*) FROM customer WHERE c_acctbal <= 0
    UNION ALL SELECT 'wrong_direction', count(*) FROM customer JOIN nation ON n_nationkey = c_nationkey
""")
def graph_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """has_customer isn't among the allowed edges"""
    nodes, edges = _graph(spark, sf_dir)
    allowed = spark.createDataFrame([("region", "has_nation", "nation"), ("customer", "placed", "order")], "source_type string, edge_type string, target_type string")
    return graph.violations(nodes, edges, allowed).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT edge_type, count(*) AS n FROM (SELECT 'has_nation' AS edge_type FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'has_customer' FROM customer WHERE c_nationkey = 3) GROUP BY 1")
def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G12 F07"""
    from ..functions.hashing import stable_id

    _, edges = _graph(spark, sf_dir)
    return graph.neighbourhood(edges, stable_id("node", F.lit("nation"), F.lit(3))).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT field_id, CASE field_id WHEN 'p_comment' THEN 'no_dictionary_entry' WHEN 'p_empty' THEN 'no_mapped_cell' WHEN 'p_type' THEN 'no_evidence' ELSE 'node' END AS outcome FROM (SELECT unnest(['p_name', 'p_type', 'p_empty', 'p_comment']) AS field_id)")
def field_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G10"""
    f = lambda *n: spark.createDataFrame([(x,) for x in n], "field_id string")
    p = table(spark, sf_dir, "part")
    cells = p.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field_id"), v.alias("value")) for c, v in (("p_name", F.col("p_name")), ("p_type", F.col("p_type")), ("p_empty", F.lit(None).cast("string")))])).alias("c")).select("c.*")
    return graph.field_closure(f("p_name", "p_type", "p_empty", "p_comment"), f("p_name", "p_type", "p_empty"), cells, f("p_name", "p_empty"))


@query("SELECT count(*) FILTER (l_orderkey % 7 <> 0) AS resolved, count(*) AS locators, round(count(*) FILTER (l_orderkey % 7 <> 0) / count(*), 6) AS closure FROM (SELECT l_orderkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))")
def closure_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J19 G27"""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    known = li.where("l_orderkey % 7 != 0").select(F.col("l_orderkey").alias("k"))
    return graph.closure_audit(li.withColumn("loc", F.array("l_orderkey")), "l_partkey", "loc", known, "k").withColumn("closure", F.round("closure", 6))


@query("SELECT coalesce(r.k, s.k) AS k, CASE WHEN s.k IS NULL THEN 'missing' ELSE 'orphaned' END AS state FROM (SELECT DISTINCT l_partkey * 2 AS k FROM lineitem) r FULL JOIN (SELECT p_partkey * 3 AS k FROM part) s ON r.k = s.k WHERE r.k IS NULL OR s.k IS NULL")
def content_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G20"""
    return graph.lifecycle(table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 2).alias("k")), table(spark, sf_dir, "part").select((F.col("p_partkey") * 3).alias("k")), "k")


@query("WITH e AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), o AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') SELECT (SELECT count(*) FROM e JOIN o USING (k)) AS tp, (SELECT count(*) FROM o WHERE k NOT IN (FROM e)) AS fp, (SELECT count(*) FROM e WHERE k NOT IN (FROM o)) AS fn, round((SELECT count(*) FROM e JOIN o USING (k)) / (SELECT count(*) FROM o), 6) AS precision, round((SELECT count(*) FROM e JOIN o USING (k)) / (SELECT count(*) FROM e), 6) AS recall")
def expected_vs_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J20 G18"""
    o = table(spark, sf_dir, "orders")
    out = graph.compare_sets(o.where("o_orderpriority = '1-URGENT'"), o.where("o_orderstatus = 'F'"), ["o_custkey"])
    return out.select("tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("SELECT coalesce(l.doc_id, c.doc_id) AS doc_id, CASE WHEN c.doc_id IS NULL THEN 'no_case' WHEN l.doc_id IS NULL THEN 'no_label' ELSE 'several_cases' END AS problem FROM (SELECT DISTINCT doc_id FROM labels) l FULL JOIN (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars > 500) GROUP BY doc_id) c ON l.doc_id = c.doc_id WHERE c.n IS NULL OR l.doc_id IS NULL OR c.n > 1")
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A47"""
    d = table(spark, sf_dir, "documents").where("lang = 'en'")
    return graph.label_coverage(table(spark, sf_dir, "labels"), d.select("doc_id").union(d.where("n_chars > 500").select("doc_id")), "doc_id")


@query("""
    WITH j AS (SELECT lang, quality, toxic, n_chars FROM documents LEFT JOIN labels USING (doc_id)), m AS (
        SELECT lang, 'good' AS metric, count_if(quality = 1)::BIGINT AS numerator, count(quality) AS denominator FROM j GROUP BY lang UNION ALL SELECT lang, 'toxic', count_if(toxic = 1)::BIGINT, count(toxic) FROM j GROUP BY lang
        UNION ALL SELECT lang, 'long', count_if(n_chars > 1000)::BIGINT, count(n_chars) FROM j GROUP BY lang
    ) SELECT *, round(numerator / nullif(denominator, 0), 6) AS rate FROM m
""")
def benchmark_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A33 A37 A38 A39"""
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    out = graph.rates(j, ["lang"], {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1, "long": F.col("n_chars") > 1000})
    return out.withColumn("rate", F.round("rate", 6))


@query("SELECT bin, low::DOUBLE AS low, high::DOUBLE AS high, (SELECT count(*) FROM lineitem WHERE l_discount * 8 >= low AND (l_discount * 8 < high OR (high = 1.0 AND l_discount * 8 <= 1.0))) AS n FROM (VALUES (0, 0.0, 0.5), (1, 0.5, 0.9), (2, 0.9, 0.95), (3, 0.95, 1.0)) b(bin, low, high)")
def confidence_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A35"""
    return graph.bins(table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 8).alias("s")), "s", [0.0, 0.5, 0.9, 0.95, 1.0])


@query("WITH a AS (SELECT * FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 4 <> 0) SELECT 'part' AS category, CAST(coalesce(a.p_partkey, b.p_partkey) AS VARCHAR) AS key, CASE WHEN b.p_partkey IS NULL THEN 'removed' WHEN a.p_partkey IS NULL THEN 'added' WHEN a.p_size = b.p_size THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.p_partkey = b.p_partkey")
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions made from parts"""
    p = table(spark, sf_dir, "part")
    flat = lambda d, v: d.select(F.lit("part").alias("category"), F.col("p_partkey").cast("string").alias("key"), v.cast("string").alias("value"), F.lit(None).cast("string").alias("semantic"), F.lit(None).cast("string").alias("match_group"))
    return graph.difference(flat(p.where("p_partkey % 3 != 0"), F.col("p_size")), flat(p.where("p_partkey % 4 != 0"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS last_sequence, count(DISTINCT event_id) AS updates FROM events GROUP BY user_id")
def event_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U06 R02"""
    return graph.fold_events(table(spark, sf_dir, "events"), "user_id", "event_id", ["event_type", "value"])


@query("WITH b AS (SELECT ts, 1 AS source_rank, event_id AS id, event_type || ' ' || user_id AS text FROM events UNION ALL SELECT o_orderdate, 2, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'CLICK  ' || (o_orderkey % 50) ELSE 'order ' || o_orderkey END FROM orders), n AS (SELECT *, min(source_rank) OVER (PARTITION BY lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS best FROM b) SELECT ts, source_rank, id, text FROM n WHERE source_rank = best")
def chronological_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U07"""
    e = table(spark, sf_dir, "events").select("ts", F.col("event_id").alias("id"), F.concat_ws(" ", "event_type", "user_id").alias("text"))
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts"), k.alias("id"), F.when(k % 2 == 0, F.concat(F.lit("CLICK  "), (k % 50).cast("string"))).otherwise(F.concat(F.lit("order "), k.cast("string"))).alias("text"))
    return graph.merged([(1, e), (2, o)], "text", ["id"])


# --- documents ------------------------------------------------------------------------------------------


@query("SELECT CASE WHEN n_chars < 80 OR (doc_id % 3 = 0 AND n_chars < 256) THEN 'visual' ELSE 'native' END AS route, count(*) AS n FROM documents GROUP BY 1")
def page_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G14"""
    return table(spark, sf_dir, "documents").groupBy(documents.route(F.col("n_chars"), F.col("doc_id") % 3 == 0).alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH p AS (SELECT conv_id, len(text) AS c, lag(len(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) SELECT count_if(c < b)::BIGINT AS inversions, count(b) AS pairs, round(count_if(c < b) / count(b), 6) AS rate FROM p WHERE b IS NOT NULL")
def order_inversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A36"""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("c"))
    return documents.inversions(c, ["conv_id"], "turn", "c").withColumn("rate", F.round("rate", 6))


@query("SELECT event_id AS locator_id, CASE WHEN event_id % 1200 >= (SELECT count(*) FROM documents) THEN 'unknown_block' WHEN value > 90 THEN 'box_outside_page' WHEN event_id % 50 >= n_chars THEN 'range_out_of_bounds' END AS reason FROM events LEFT JOIN documents ON doc_id = event_id % 1200")
def locator_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G24"""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("block_id"), "text", F.lit(100.0).alias("width"), F.lit(100.0).alias("height"))
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("locator_id"), (F.col("event_id") % 1200).alias("block_id"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("value") + 10).alias("x1"), F.lit(5.0).alias("y1"), (F.col("event_id") % 50).alias("start"), (F.col("event_id") % 50 + 1).alias("end"))
    return documents.check_locators(e, d)


@query("SELECT page_id, 0 AS table_no, 0 AS row_no, 0 AS col_no, html AS value FROM pages WHERE contains(lower(html), '<table')")
def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' own tables (the generated pages have none)"""
    return documents.html_cells(table(spark, sf_dir, "pages"), "page_id", "html")


@query(r"""
    WITH u AS (SELECT page_id, regexp_extract(url, '^([A-Za-z]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$', ['s', 'h', 'p', 'q']) AS m FROM pages),
    k AS (SELECT page_id, m, list_sort(list_filter(string_split(m.q, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|gclid)(=|$)'))) AS q FROM u)
    SELECT page_id, lower(m.s) || '://' || lower(m.h) || regexp_replace(m.p, '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url FROM k
""")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X06"""
    return table(spark, sf_dir, "pages").select("page_id", text.url(F.col("url")).alias("url"))


@query("SELECT p_partkey, CASE WHEN p_partkey > 0 THEN 'TIC ' || p_partkey END AS tic, p_partkey || '.0' || (p_size % 10) AS toi FROM part")
def catalog_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X08 X09"""
    k = F.col("p_partkey").cast("string")
    padded = F.concat(F.lit("tic-"), F.lpad(k, 9, "0"))
    return table(spark, sf_dir, "part").select("p_partkey", text.catalog_id(padded, "tic", "TIC").alias("tic"), text.toi(F.concat(F.lit("TOI-"), k, F.lit("."), (F.col("p_size") % 10).cast("string"))).alias("toi"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS VARCHAR) END AS value, CASE p_partkey % 5 WHEN 1 THEN '0.5' WHEN 2 THEN '2' END AS plus, CASE p_partkey % 5 WHEN 1 THEN '0.5' WHEN 2 THEN '1' END AS minus, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 3 THEN 'upper' WHEN 4 THEN 'lower' ELSE 'measured' END AS \"limit\", CASE WHEN p_partkey % 5 <> 0 THEN 'km' END AS unit, CASE WHEN p_partkey % 5 = 0 THEN 'not_measured' END AS null_reason FROM part")
def measured_value_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X13 X21"""
    s, k = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    cell = F.when(k == 0, "n/a").when(k == 1, F.concat(s, F.lit(r" \pm 0.5 km"))).when(k == 2, F.concat(s, F.lit(" +2/-1 km"))).when(k == 3, F.concat(F.lit("<"), s, F.lit(" km"))).otherwise(F.concat(F.lit(">= "), s, F.lit(" km")))
    return table(spark, sf_dir, "part").select("p_partkey", text.measured(cell).alias("m")).select("p_partkey", "m.*")


@query("SELECT p_partkey, 'radius' AS field, CAST(p_size AS VARCHAR) AS value, 'km' AS unit, 'Part ' || p_partkey AS entity FROM part UNION ALL SELECT p_partkey, 'mass', CAST(p_size AS VARCHAR) || '.5', NULL, 'P' || p_partkey FROM part")
def sentence_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X14"""
    k, s = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    t = F.concat(F.lit("radius = "), s, F.lit(" km for Part "), k, F.lit("; mass = "), s, F.lit(".5 for P"), k, F.lit("!"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(text.observations(t)).alias("o")).select("p_partkey", "o.*")


@query("SELECT n_nationkey AS table_no, f AS field_id, h AS how, u AS unit FROM nation, (VALUES ('radius', 'without_unit', 'km'), ('mass', 'exact', NULL)) v(f, h, u)")
def labelled_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J21 X10 X11 X12"""
    n = table(spark, sf_dir, "nation")
    heads = F.array(*[F.struct(F.lit(i).alias("col_no"), F.lit(v).alias("value")) for i, v in enumerate(("Radius [km]", " MASS", "Other"))])
    cells = n.select(F.lit(0).alias("k"), F.col("n_nationkey").alias("table_no"), F.lit(0).alias("row_no"), F.explode(heads).alias("c")).select("k", "table_no", "row_no", "c.*")
    aliases = spark.createDataFrame([("radius", "radius"), ("Mass", "mass")], "label string, field_id string")
    return documents.labelled_columns(cells, aliases, "k").select("table_no", "field_id", "how", "unit")


@query("SELECT p_name, CASE WHEN count(*) = 1 THEN 'matched' ELSE 'ambiguous' END AS status, CASE WHEN count(*) = 1 THEN min(p_partkey) END AS key FROM part GROUP BY p_name")
def entity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13"""
    p = table(spark, sf_dir, "part")
    return documents.lookup(p, p.select(F.col("p_name").alias("form"), F.col("p_partkey").alias("key")), "p_name")


@query("SELECT event_id AS id, CASE WHEN user_id % 9 = 0 THEN 'not_authorized' WHEN event_type = 'error' THEN 'field_unresolved' WHEN event_type = 'click' THEN 'field_ambiguous' WHEN user_id % 7 = 0 THEN 'entity_unresolved' WHEN event_id % 11 = 0 THEN 'bad_value' WHEN event_id % 13 = 0 THEN 'unknown_unit' END AS code FROM events")
def observation_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G15"""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    o = e.select(i.alias("id"), F.col("user_id").alias("document"), F.col("event_type").alias("field"), F.col("user_id").cast("string").alias("entity"), F.when(i % 11 == 0, "x").otherwise(F.col("value").cast("string")).alias("value"), F.when(i % 13 == 0, "parsec").otherwise("km").alias("unit"))
    kinds = e.select("event_type").distinct().where("event_type != 'error'")
    fields = kinds.select(F.col("event_type").alias("field"), F.concat(F.lit("f."), "event_type").alias("field_id"), F.array(F.lit("km")).alias("units"))
    fields = fields.unionByName(fields.where("field = 'click'").withColumn("field_id", F.lit("f.other")))
    users = e.select("user_id").distinct()
    return documents.admit_observations(o, fields, users.where("user_id % 7 != 0").select(F.col("user_id").cast("string").alias("form"), F.col("user_id").alias("key")), users.where("user_id % 9 != 0").select(F.col("user_id").alias("document")))


@query("SELECT event_type, min(CAST(json_extract(props, '$.k') AS BIGINT)) AS low, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS high, count(*) AS n FROM events GROUP BY 1")
def json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K04"""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.min(k).alias("low"), F.max(k).alias("high"), F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey, 'sha256:' || sha256('{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}') AS content_hash FROM nation")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K01 S18"""
    from ..functions.hashing import content_hash

    return table(spark, sf_dir, "nation").select("n_nationkey", content_hash({"name": F.col("n_name"), "key": F.col("n_nationkey")}).alias("content_hash"))


@query()
def bundle_seals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests show that order doesn't matter"""
    from ..functions.hashing import seal

    return seal(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])
