"""Relational reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import paging
from ..scratch import table
from .catalog import query


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


@query("SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W01"""
    return paging.latest(_orders(spark, sf_dir).select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("""
    WITH r AS (SELECT o_orderdate, o_orderkey FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1998-01-01', 500) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 51)
    SELECT *, (SELECT count(*) FROM r) > 50 AS has_more FROM r ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50
""")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L01 L14"""
    rows = _orders(spark, sf_dir).select("o_orderdate", "o_orderkey")
    return paging.keyset_page(rows, [("o_orderdate", True), ("o_orderkey", True)], 50, [F.to_timestamp(F.lit("1998-01-01")), 500])


@query("""
    WITH g AS (SELECT o_custkey, max(o_orderdate) AS latest, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT * FROM g WHERE (latest, o_custkey) < (TIMESTAMP '1998-06-01', 100) ORDER BY latest DESC, o_custkey DESC LIMIT 26)
    SELECT *, (SELECT count(*) FROM r) > 25 AS has_more FROM r ORDER BY latest DESC, o_custkey DESC LIMIT 25
""")
def keyset_having_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L02 A30"""
    return paging.keyset_groups(_orders(spark, sf_dir), "o_custkey", "o_orderdate", 25, (F.to_timestamp(F.lit("1998-06-01")), 100))


@query("SELECT event_id, user_id, event_type, true AS has_more FROM events WHERE event_id > 400 ORDER BY event_id LIMIT 100")
def event_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L03 L04 R01"""
    return paging.page_behind(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_id", 400, 100)


@query("SELECT conv_id, turn FROM conversations u WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations a WHERE a.role = 'assistant' AND a.conv_id = u.conv_id AND a.turn = u.turn + 1)")
def unanswered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J14"""
    c = table(spark, sf_dir, "conversations")
    answers = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"))
    return paging.without_answer(c.where("role = 'user'").select("conv_id", "turn"), answers, ["conv_id", "turn"])


@query("SELECT conv_id, turn, EXISTS (SELECT 1 FROM conversations a WHERE a.role = 'assistant' AND a.conv_id = u.conv_id AND a.turn = u.turn + 1) AS answered FROM conversations u WHERE role = 'user'")
def answered_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15"""
    c = table(spark, sf_dir, "conversations")
    answers = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"))
    return paging.flagged(c.where("role = 'user'").select("conv_id", "turn"), answers, ["conv_id", "turn"], "answered")


@query("SELECT c_custkey, count(*) AS lines, round(sum(l_extendedprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY c_custkey")
def versions_of_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J16"""
    o = _orders(spark, sf_dir).where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return li.join(o, "o_orderkey").join(c, "c_custkey").groupBy("c_custkey").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("""
    SELECT c_custkey AS tid, min(o_totalprice) AS distance FROM customer JOIN orders ON c_name = 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') WHERE o_totalprice <= 5000 GROUP BY c_custkey ORDER BY distance, tid LIMIT 20
""")
def discovery_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S21"""
    o = _orders(spark, sf_dir).where("o_totalprice <= 5000").select(F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("c_name"), "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_name", F.col("c_custkey").alias("tid"))
    return c.join(o, "c_name").groupBy("tid").agg(F.min("o_totalprice").alias("distance")).orderBy("distance", "tid").limit(20)


@query("SELECT l_orderkey, l_linenumber FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IS NOT NULL) WHERE (l_orderkey, l_linenumber) > (100, 3) ORDER BY 1, 2 LIMIT 40")
def source_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyset scan of a source"""
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_orderkey is not null").select("l_orderkey", "l_linenumber").distinct()
    return paging.keyset_page(rows, [("l_orderkey", False), ("l_linenumber", False)], 40, [100, 3]).drop("has_more")


@query("WITH p AS (SELECT o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS i FROM orders), c AS (SELECT o_orderstatus, i // 100 AS page, count(*) AS n FROM p GROUP BY ALL), g AS (SELECT o_orderstatus, sum(n)::BIGINT AS records, arg_max(n, page) AS last_page_rows, count(*) AS pages FROM c GROUP BY 1) SELECT *, CASE WHEN records >= 5000 THEN 'truncated' WHEN last_page_rows < 100 THEN 'complete' ELSE 'unknown' END AS completion FROM g")
def page_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S17 S19"""
    from ..operators.ordering import positions

    placed = positions(_orders(spark, sf_dir).select("o_orderstatus", "o_orderkey"), ["o_orderstatus"], ["o_orderkey"])
    return paging.completion(paging.pages(placed, [], 100, placed), "o_orderstatus", 100, 5000)


@query("WITH p AS (SELECT event_id, event_id // 100 AS page, user_id FROM events), w AS (SELECT *, lag(user_id) OVER (PARTITION BY page ORDER BY event_id) AS before FROM p), e AS (SELECT page, arg_min(user_id, event_id) AS first, arg_max(user_id, event_id) AS last, min(event_id) AS event_id FROM p GROUP BY page), x AS (SELECT *, lag(last) OVER (ORDER BY page) AS before FROM e) SELECT page, event_id, 'within_page' AS \"where\" FROM w WHERE user_id <= before UNION ALL SELECT page, event_id, 'between_pages' FROM x WHERE first <= before")
def unstable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as if they were page keys"""
    e = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 100).cast("long").alias("page"), "user_id")
    return paging.unstable_pages(e, "page", "event_id", ["user_id"])


@query("SELECT r_regionkey, min(r_name) AS tag FROM region GROUP BY 1")
def source_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S20"""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("tag")), "n_regionkey")
    return paging.one_version(n, "n_regionkey", "tag").withColumnRenamed("n_regionkey", "r_regionkey")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 4")
def oldest_queued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L12"""
    return paging.oldest(_orders(spark, sf_dir).where("o_orderstatus = 'P'").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")


@query("SELECT o_custkey, coalesce(max(o_orderkey), 0) + 1 AS next_number FROM orders GROUP BY 1")
def next_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A30 L15"""
    return paging.next_numbers(_orders(spark, sf_dir), ["o_custkey"], "o_orderkey")


@query("""
    WITH f AS (SELECT o_custkey, o_orderdate, CASE WHEN o_orderstatus <> 'F' THEN 0 WHEN o_totalprice < 200000 THEN 1 WHEN o_orderpriority <> '1-URGENT' THEN 2 END AS failed FROM orders),
    g AS (SELECT o_custkey, max(o_orderdate) FILTER (failed IS NULL) AS o_orderdate, max(failed) AS worst FROM f GROUP BY 1)
    SELECT o_custkey, o_orderdate, CASE WHEN o_orderdate IS NULL THEN ['not_final', 'too_small', 'not_urgent'][worst + 1] END AS reason FROM g
""")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L13"""
    checks = [("not_final", F.col("o_orderstatus") == "F"), ("too_small", F.col("o_totalprice") >= 200000), ("not_urgent", F.col("o_orderpriority") == "1-URGENT")]
    return paging.best_candidate(_orders(spark, sf_dir), ["o_custkey"], "o_orderdate", checks)


@query("SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01' AND o_orderdate + INTERVAL 30 DAY > TIMESTAMP '1998-01-01'")
def unexpired_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12 S32 D02"""
    rows = _orders(spark, sf_dir).select("o_orderkey", F.col("o_orderdate").alias("valid_from"), F.expr("o_orderdate + interval 30 days").alias("expires_at"))
    return paging.unexpired(rows, F.to_timestamp(F.lit("1998-01-01")), since="valid_from").select("o_orderkey")


@query("""
    WITH cache AS (SELECT o_custkey AS k, max(o_orderdate) AS expires_at FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), fresh AS (SELECT o_custkey AS k, max(o_orderdate) + INTERVAL 900 SECOND AS expires_at FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1),
    entering AS (SELECT * FROM fresh WHERE k NOT IN (SELECT k FROM cache WHERE expires_at > TIMESTAMP '1998-01-01')) SELECT * FROM cache WHERE k NOT IN (SELECT k FROM entering) UNION ALL SELECT * FROM entering
""")
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S32"""
    o = _orders(spark, sf_dir)
    cache = o.where("o_orderkey % 2 = 0").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderdate").alias("expires_at"))
    fresh = o.where("o_orderkey % 2 = 1").groupBy(F.col("o_custkey").alias("k")).agg((F.max("o_orderdate") + F.expr("interval 900 seconds")).alias("expires_at"))
    return paging.cache_upsert(cache, fresh, ["k"], F.to_timestamp(F.lit("1998-01-01")))


@query("SELECT count(*) AS declared, count(*) AS found FROM orders")
def integrity_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A40"""
    o = _orders(spark, sf_dir)
    return paging.row_count_is(o, o.count())


@query("SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U05"""
    return paging.first_seen(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query("SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A41"""
    return _orders(spark, sf_dir).select("o_custkey", "o_orderstatus").distinct()


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def id_list_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F07 F08"""
    urgent = _orders(spark, sf_dir).where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).join(urgent, "c_custkey", "left_semi").select("c_custkey")
