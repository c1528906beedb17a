"""Documents as literature records, lineitem keys as claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import papers, search_requests
from ..scratch import Scratch, table
from .catalog import query

KEYWORDS = ["the of", "tion", "que"]


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title is the first line, year comes from the length, identifiers from the id."""
    i = F.col("doc_id")
    raw = table(spark, sf_dir, "documents").select(
        i.alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"), F.array("source").alias("authors"), (2000 + F.col("n_chars") % 5).cast("int").alias("year"),
        F.when(i % 7 == 0, F.concat(F.lit("https://doi.org/10.1234/W"), (i % 140).cast("string"), F.lit("."))).alias("doi"), F.when(i % 11 == 0, F.concat(F.lit("arXiv:2101."), F.lpad((i % 220).cast("string"), 5, "0"), F.lit("v2"))).alias("arxiv"), "source",
    )
    return Scratch(spark, "papers").keep(papers.normalized(raw), "normalized")


_KEYED = r"""
    p AS (
        SELECT doc_id AS id, trim(regexp_replace(regexp_replace(replace(lower(split_part(text, chr(10), 1)), 'ß', 'ss'), '[\p{P}\p{S}]', ' ', 'g'), '\s+', ' ', 'g')) AS title_key, source AS author, CAST(2000 + n_chars % 5 AS INTEGER) AS year,
            CASE WHEN doc_id % 7 = 0 THEN '10.1234/w' || (doc_id % 140) END AS doi_key, CASE WHEN doc_id % 11 = 0 THEN '2101.' || lpad(CAST(doc_id % 220 AS VARCHAR), 5, '0') END AS arxiv_key FROM documents
    )"""


@query(f"WITH {_KEYED} SELECT id, title_key, doi_key, arxiv_key, author AS surname FROM p")
def id_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X01-X05"""
    return _papers(spark, sf_dir).select("id", "title_key", "doi_key", "arxiv_key", "surname")


@query(f"WITH {_KEYED} SELECT CASE WHEN doi_key IS NOT NULL THEN 'doi' WHEN arxiv_key IS NOT NULL THEN 'arxiv' WHEN title_key <> '' THEN 'title' ELSE 'source' END AS basis, count(*) AS n, count(DISTINCT coalesce(doi_key, arxiv_key, CASE WHEN title_key <> '' THEN title_key || '|' || year || '|' || author ELSE author || '|' || id END)) AS identities FROM p GROUP BY 1")
def identity_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X07 K02"""
    return papers.identity(_papers(spark, sf_dir)).groupBy("basis").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("paper_id").alias("identities"))


_CLASSES = "c AS (SELECT min(id) AS class, title_key, author, year, doi_key, arxiv_key FROM p GROUP BY ALL)"
_DUPLICATES = """
    d AS (
        SELECT a.class AS left_id, b.class AS right_id, CASE WHEN coalesce(a.doi_key = b.doi_key, false) THEN 'doi_exact' WHEN coalesce(a.arxiv_key = b.arxiv_key, false) THEN 'arxiv_exact' WHEN a.author = b.author THEN 'title_year_author' ELSE 'title_year_only' END AS basis
        FROM c a JOIN c b ON a.class < b.class AND (a.doi_key = b.doi_key OR a.arxiv_key = b.arxiv_key OR (a.title_key = b.title_key AND a.year = b.year))
    )"""


@query(f"WITH {_KEYED}, {_CLASSES}, {_DUPLICATES} SELECT * FROM d")
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J08"""
    return papers.duplicate_pairs(_papers(spark, sf_dir))


_GROUPS = f"""{_KEYED}, links AS (
        SELECT a.id AS a, b.id AS b FROM p a JOIN (SELECT min(id) AS id, doi_key FROM p GROUP BY doi_key) b ON a.doi_key = b.doi_key UNION SELECT a.id, b.id FROM p a JOIN (SELECT min(id) AS id, arxiv_key FROM p GROUP BY arxiv_key) b ON a.arxiv_key = b.arxiv_key
        UNION SELECT a.id, b.id FROM p a JOIN (SELECT min(id) AS id, title_key, year, author FROM p GROUP BY ALL) b ON a.title_key = b.title_key AND a.year = b.year AND a.author = b.author
    ), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach(node, seen) AS (SELECT id, id FROM p UNION SELECT b.a, r.seen FROM reach r JOIN both_ways b ON b.b = r.node),
    g AS (SELECT node AS id, min(seen) AS group_id FROM reach GROUP BY node)"""


@query(f"WITH RECURSIVE {_GROUPS} SELECT * FROM g")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21 A19"""
    return papers.duplicate_groups(_papers(spark, sf_dir))


@query(f"WITH RECURSIVE {_GROUPS}, b AS (SELECT g.*, CASE WHEN doi_key IS NOT NULL THEN 1 WHEN arxiv_key IS NOT NULL THEN 2 WHEN title_key <> '' THEN 3 ELSE 4 END AS r FROM g JOIN p USING (id)) SELECT group_id, count(*) AS members, arg_min(id, r * 1000000000::BIGINT + id) AS representative FROM b GROUP BY group_id")
def group_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22"""
    p = _papers(spark, sf_dir)
    return papers.representatives(p, papers.duplicate_groups(p))


@query(f"""
    WITH RECURSIVE {_GROUPS}, v AS (
        SELECT group_id, 'doi' AS field, doi_key AS value FROM g JOIN p USING (id) UNION SELECT group_id, 'arxiv', arxiv_key FROM g JOIN p USING (id) UNION SELECT group_id, 'title', title_key FROM g JOIN p USING (id)
        UNION SELECT group_id, 'year', CAST(year AS VARCHAR) FROM g JOIN p USING (id) UNION SELECT group_id, 'authors', author FROM g JOIN p USING (id)
    ) SELECT group_id, field, count(*) AS variants FROM v WHERE value IS NOT NULL AND trim(value) <> '' GROUP BY ALL HAVING count(*) > 1
""")
def group_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23"""
    p = _papers(spark, sf_dir)
    return papers.group_conflicts(p, papers.duplicate_groups(p))


_SCORE = r"""
    s AS (
        SELECT doc_id AS id, lower(split_part(text, chr(10), 1) || ' ' || text) AS t, split_part(text, chr(10), 1) AS title, CAST(2000 + n_chars % 5 AS INTEGER) AS year, doc_id % 7 = 0 OR doc_id % 11 = 0 AS has_id FROM documents
    ), w AS (SELECT *, list_distinct(regexp_extract_all(t, '[\p{L}\p{N}_]+')) AS words FROM s),
    r AS (
        SELECT id, title, year, round(least(1.0::DOUBLE, 0.55::DOUBLE * ((contains(t, 'the of')::INT + contains(t, 'tion')::INT + contains(t, 'que')::INT)::DOUBLE / 3)
            + 0.25::DOUBLE * (len(list_intersect(words, ['of', 'que', 'the', 'tion']))::DOUBLE / 4) + 0.1::DOUBLE * has_id::INT::DOUBLE + 0.1::DOUBLE * (year BETWEEN 2001 AND 2003)::INT::DOUBLE), 6) AS score FROM w
    )"""


@query(f"WITH {_SCORE} SELECT id, score, printf('%.6f', 1 - score) || '|' || title || '|' || year || '|' || lpad(CAST(id AS VARCHAR), 12, '0') AS rank_key FROM r")
def relevance_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X16 X17 L06 U03"""
    return papers.ranked(_papers(spark, sf_dir), KEYWORDS, (2001, 2003))


@query(f"""
    WITH RECURSIVE {_GROUPS}, {_SCORE}, k AS (SELECT r.id, group_id, printf('%.6f', 1 - score) || '|' || title || '|' || year || '|' || lpad(CAST(r.id AS VARCHAR), 12, '0') AS k FROM r JOIN g USING (id)),
    b AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY k, id) AS i FROM k), t AS (SELECT id, row_number() OVER (ORDER BY k, id) AS j FROM b WHERE i = 1)
    SELECT b.id, coalesce(j <= 25, false) AS selected, CASE WHEN i > 1 THEN 'duplicate' WHEN j > 25 THEN 'beyond_limit' ELSE 'selected' END AS reason FROM b LEFT JOIN t USING (id)
""")
def paper_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L07"""
    p = _papers(spark, sf_dir)
    return papers.selection(papers.ranked(p, KEYWORDS, (2001, 2003)), papers.duplicate_groups(p), 25)


@query(f"""
    WITH {_KEYED}, x AS (SELECT * FROM p WHERE id % 2 = 0), f AS (SELECT * FROM p WHERE id % 2 = 1),
    m AS (SELECT id, CASE WHEN doi_key IN (SELECT doi_key FROM f WHERE doi_key IS NOT NULL) THEN 'doi' WHEN arxiv_key IN (SELECT arxiv_key FROM f WHERE arxiv_key IS NOT NULL) THEN 'arxiv' WHEN EXISTS (SELECT 1 FROM f WHERE f.title_key = x.title_key AND f.year = x.year) THEN 'title' END AS b FROM x)
    SELECT count(*) AS expected, count(b) AS matched, count_if(b = 'doi')::BIGINT AS by_doi, count_if(b = 'arxiv')::BIGINT AS by_arxiv, count_if(b = 'title')::BIGINT AS by_title, round(count(b) / count(*), 6) AS recall FROM m
""")
def paper_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even ids sought among odd ones"""
    p = _papers(spark, sf_dir)
    return papers.recall(p.where("id % 2 = 0"), p.where("id % 2 = 1")).withColumn("recall", F.round("recall", 6))


# --- claims ---------------------------------------------------------------------------------------------


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("id"), (k % 4).alias("owner"), F.when(k % 50 == 0, "").otherwise(F.col("p_name")).alias("text"), F.concat("p_name", F.lit(" "), (k % 997).cast("string")).alias("normalized"),
        F.when(k % 13 == 0, F.array().cast("array<bigint>")).otherwise(F.array(k % 500, (k * 3) % 520)).alias("evidence"), F.when(k % 17 == 0, "rejected").otherwise("accepted").alias("status"),
        F.array(F.concat(F.lit("o"), (k % 301).cast("string")), F.concat(F.lit("o"), (k % 211).cast("string"))).alias("objects"), F.col("p_brand").alias("metric"), F.when(k % 3 != 0, (k % 5).cast("string")).alias("unit"), F.col("p_type").alias("type"),
    )


def _evidence(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    e = F.col("id")
    evidence = spark.range(510).select(e.alias("evidence_id"), (e % 60).alias("snapshot_id"), (e % 4).alias("owner"), F.when(e % 5 == 0, "weak").otherwise("strong").alias("strength"))
    return evidence, spark.range(58).select(e.alias("snapshot_id"))


_CLAIMS = """
    c AS (
        SELECT p_partkey AS id, p_partkey % 4 AS owner, CASE WHEN p_partkey % 50 = 0 THEN '' ELSE p_name END AS text, p_name || ' ' || (p_partkey % 997) AS normalized,
            CASE WHEN p_partkey % 13 = 0 THEN [] ELSE [p_partkey % 500, (p_partkey * 3) % 520] END AS evidence, CASE WHEN p_partkey % 17 = 0 THEN 'rejected' ELSE 'accepted' END AS status,
            ['o' || (p_partkey % 301), 'o' || (p_partkey % 211)] AS objects, p_brand AS metric, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_partkey % 5 AS VARCHAR) END AS unit, p_type AS type FROM part
    )"""
_ADMITTED = f"""{_CLAIMS}, l AS (SELECT id, owner, unnest(evidence) AS e FROM c),
    j AS (
        SELECT id, bool_and(e < 510) AS known, bool_and(e < 510 AND e % 60 < 58) AS pinned, bool_and(e < 510 AND e % 4 = owner) AS owned, bool_and(e < 510 AND e % 5 = 0) AS weak FROM l GROUP BY id
    ), f AS (SELECT *, min(id) OVER (PARTITION BY owner, normalized) AS first FROM c),
    a AS (
        SELECT f.id, CASE WHEN text = '' THEN 'empty_text' WHEN j.id IS NULL THEN 'no_evidence' WHEN NOT known THEN 'unknown_evidence' WHEN NOT pinned THEN 'missing_snapshot' WHEN NOT owned THEN 'foreign_evidence' WHEN first <> f.id THEN 'duplicate' END AS reason, weak
        FROM f LEFT JOIN j USING (id)
    )"""


def _admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers.admit_claims(_claims(spark, sf_dir), *_evidence(spark))


@query(f"WITH {_ADMITTED} SELECT id, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN weak THEN 'candidate' ELSE 'accepted' END AS status, reason FROM a")
def claim_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G01 X18"""
    return _admitted(spark, sf_dir)


@query(f"WITH {_ADMITTED} SELECT reason, count(*) AS n, list_sort(list(id))[:5] AS sample FROM a WHERE reason IS NOT NULL GROUP BY reason")
def rejection_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A32"""
    return papers.rejections(_admitted(spark, sf_dir))


@query(f"""
    WITH {_ADMITTED}, s AS (SELECT id % 4 AS owner, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN weak THEN 'candidate' ELSE 'accepted' END AS st FROM a)
    SELECT owner, count_if(st = 'accepted')::BIGINT AS accepted, count_if(st = 'candidate')::BIGINT AS candidate, count_if(st = 'rejected')::BIGINT AS rejected, CASE WHEN bool_or(st = 'accepted') THEN 'accepted' WHEN bool_or(st = 'candidate') THEN 'candidate' ELSE 'rejected' END AS status FROM s GROUP BY owner
""")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A31"""
    return papers.rollup(_admitted(spark, sf_dir).withColumn("owner", F.col("id") % 4), ["owner"])


@query(f"WITH {_CLAIMS} SELECT count(*) AS eligible, count(*) * (count(*) - 1) AS pairs FROM c WHERE status <> 'rejected' AND len(evidence) > 0")
def pair_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J09"""
    return papers.pair_universe(_claims(spark, sf_dir))


@query(f"""
    WITH {_CLAIMS}, e AS (SELECT * FROM c WHERE status <> 'rejected' AND len(evidence) > 0),
    x AS (
        SELECT s.id AS source_id, t.id AS target_id, CAST(len(list_intersect(s.objects, t.objects)) AS INTEGER) AS shared, coalesce(s.metric = t.metric, false)::INTEGER AS metric_match, coalesce(s.unit = t.unit, false)::INTEGER AS unit_match, coalesce(s.type = t.type, false)::INTEGER AS same_type
        FROM e s JOIN e t ON s.id <> t.id
    ) SELECT * FROM x ORDER BY shared DESC, metric_match DESC, unit_match DESC, same_type DESC, source_id, target_id LIMIT 1024
""")
def pair_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L08"""
    return papers.top_pairs(_claims(spark, sf_dir), 1024)


_RELATIONS = f"""{_CLAIMS}, r AS (
        SELECT l_linenumber AS n, l_orderkey AS id, l_orderkey % 2000 AS source_id, (l_orderkey * 7) % 2100 AS target_id, ['agrees', 'contradicts', 'extends'][1 + l_orderkey % 3] AS type, CASE WHEN l_orderkey % 19 = 0 THEN 0 ELSE 1 END AS t, CASE WHEN l_orderkey % 23 = 0 THEN 0 ELSE 1 END AS e,
            CASE WHEN l_orderkey % 29 = 0 THEN 1.5 ELSE 0.5 END AS confidence FROM (SELECT DISTINCT l_orderkey, 1 AS l_linenumber FROM lineitem)
    ), k AS (SELECT *, min(id) OVER (PARTITION BY type, CASE WHEN type <> 'extends' THEN least(source_id, target_id) ELSE source_id END, CASE WHEN type <> 'extends' THEN greatest(source_id, target_id) ELSE target_id END) AS first FROM r),
    v AS (
        SELECT k.id, k.type, CASE WHEN coalesce(s.status, 'rejected') = 'rejected' OR coalesce(g.status, 'rejected') = 'rejected' THEN 'missing_endpoint' WHEN source_id = target_id THEN 'self_relation' WHEN k.type <> 'extends' AND s.metric <> g.metric THEN 'incomparable'
            WHEN t = 0 THEN 'no_trace' WHEN e = 0 THEN 'no_evidence' WHEN confidence > 1 THEN 'bad_confidence' WHEN first <> k.id THEN 'duplicate' END AS reason FROM k LEFT JOIN c s ON s.id = source_id LEFT JOIN c g ON g.id = target_id
    )"""


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    one = lambda m: F.when(k % m == 0, F.array().cast("array<bigint>")).otherwise(F.array(k))
    return table(spark, sf_dir, "lineitem").select("l_orderkey").distinct().select(
        k.alias("id"), (k % 2000).alias("source_id"), ((k * 7) % 2100).alias("target_id"), F.get(F.array(F.lit("agrees"), F.lit("contradicts"), F.lit("extends")), (k % 3).cast("int")).alias("type"),
        one(19).alias("trace"), one(23).alias("evidence"), F.when(k % 29 == 0, 1.5).otherwise(0.5).alias("confidence"),
    )


@query(f"WITH {_RELATIONS} SELECT id, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason FROM v")
def relation_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G02 G03"""
    return papers.admit_relations(_relations(spark, sf_dir), _claims(spark, sf_dir))


@query(f"WITH {_RELATIONS} SELECT id, CASE WHEN id % 10 = 0 THEN 'accepted' WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, CASE WHEN id % 10 = 0 THEN 2 ELSE 1 END AS version FROM v")
def relation_adjudication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth relation is accepted by a reviewer"""
    base = papers.admit_relations(_relations(spark, sf_dir), _claims(spark, sf_dir))
    decisions = base.where("id % 10 = 0").select("id", F.lit("accepted").alias("decision"), F.lit("r1").alias("reviewer"))
    return papers.adjudicate(base, decisions).select("id", "status", "version")


@query("SELECT n1.n_nationkey AS source_id, n2.n_nationkey AS target_id, t AS relation_type, 'not_evaluable' AS status FROM nation n1 JOIN nation n2 ON n1.n_regionkey = n2.n_regionkey AND n1.n_nationkey <> n2.n_nationkey CROSS JOIN (SELECT unnest(['agrees', 'contradicts', 'extends']) AS t)")
def confidence_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G04"""
    n = table(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_nationkey").alias("source_id"), "n_regionkey"), n.select(F.col("n_nationkey").alias("target_id"), "n_regionkey")
    return papers.confidence_records(a.join(b, "n_regionkey").where("source_id != target_id"), ["agrees", "contradicts", "extends"])


# --- summaries ------------------------------------------------------------------------------------------


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("turn")
    names = F.array(*[F.lit(s) for s in (*papers.SECTIONS, "other")])
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + k).alias("id"), F.col("conv_id").alias("paper_id"), (F.col("conv_id") * 1000 + F.floor(k / 2).cast("long")).alias("chunk_id"), k.alias("position"), F.get(names, (k % 8).cast("int")).alias("section"),
        F.col("role").alias("text"), F.array(F.col("conv_id") * 1000 + k, F.col("conv_id") * 1000 + k - k % 3).alias("evidence"),
    )


def _spans(statements: DataFrame) -> DataFrame:
    """Every turn is evidence of its own chunk."""
    return statements.select(F.col("id").alias("evidence_id"), "chunk_id")


_STATEMENTS = """
    s AS (SELECT conv_id * 1000 + turn AS id, conv_id AS paper_id, conv_id * 1000 + turn // 2 AS chunk_id, turn AS position, ['background', 'objective', 'data', 'methods', 'results', 'limitations', 'conclusions', 'other'][1 + turn % 8] AS section, role AS text,
        [conv_id * 1000 + turn, conv_id * 1000 + turn - turn % 3] AS evidence FROM conversations),
    l AS (SELECT id, chunk_id, unnest(evidence) AS e FROM s), o AS (SELECT l.id, bool_and(coalesce(x.chunk_id = l.chunk_id, false)) AS own FROM l LEFT JOIN s x ON x.id = l.e GROUP BY l.id),
    a AS (SELECT s.*, CASE WHEN section = 'other' THEN 'unknown_section' WHEN NOT own THEN 'evidence_outside_chunk' END AS reason FROM s JOIN o USING (id))"""


@query(f"WITH {_STATEMENTS} SELECT id, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason FROM a")
def statement_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G06"""
    s = _statements(spark, sf_dir)
    return papers.admit_statements(s, _spans(s))


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _statements(spark, sf_dir)
    ok = papers.admit_statements(s, _spans(s)).where("status = 'accepted'").select("id")
    return papers.reduce_sections(s.join(ok, "id"))


@query(f"WITH {_STATEMENTS} SELECT paper_id, section, list(text ORDER BY chunk_id, position) AS texts, len(list_distinct(flatten(list(evidence)))) AS n_evidence FROM a WHERE reason IS NULL GROUP BY ALL")
def section_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K07 U05"""
    return _sections(spark, sf_dir).select("paper_id", "section", "texts", F.size("evidence").cast("long").alias("n_evidence"))


@query(f"""WITH {_STATEMENTS} SELECT paper_id, string_agg('## ' || upper(section[1]) || section[2:] || chr(10) || chr(10) || t, chr(10) || chr(10) ORDER BY list_position(['background', 'objective', 'data', 'methods', 'results', 'limitations', 'conclusions'], section)) AS markdown
    FROM (SELECT paper_id, section, string_agg('- ' || text, chr(10) ORDER BY chunk_id, position) AS t FROM a WHERE reason IS NULL GROUP BY ALL) GROUP BY paper_id""")
def markdown_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S31"""
    return papers.markdown(_sections(spark, sf_dir))


@query("SELECT conv_id AS chunk_id, list_sort(list(DISTINCT turn)) AS missing FROM conversations WHERE role <> 'user' GROUP BY conv_id")
def chunk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that only a user's statement could cover"""
    c = table(spark, sf_dir, "conversations")
    chunks = c.groupBy(F.col("conv_id").alias("chunk_id")).agg(F.collect_list("turn").alias("evidence"))
    return papers.uncovered(chunks, c.where("role = 'user'").select(F.col("conv_id").alias("chunk_id"), F.array("turn").alias("evidence")))


@query("""
    WITH r AS (
        SELECT p_partkey, list_sort(list_distinct(list_filter([lower(trim(x)) FOR x IN string_split(p_name, ' ') || [upper(p_type), ' ']], lambda x: x <> ''))) AS k, CASE WHEN p_partkey % 3 = 0 THEN array_to_string(string_split(p_name, ' ') || [upper(p_type)], ' ') ELSE '  ' || p_brand || '  No ' END AS q,
            CASE WHEN p_partkey % 4 > 0 THEN 1970 + p_size ELSE 1900 END AS a, CASE WHEN p_partkey % 5 > 0 THEN 2010 ELSE 2100 END AS b, CASE p_partkey % 7 WHEN 0 THEN [] WHEN 1 THEN ['crossref', 'other'] ELSE ['crossref'] END AS s, p_size AS size FROM part
    ), v AS (
        SELECT *, lower(trim(regexp_replace(q, '\\s+', ' ', 'g'))) AS n, CASE WHEN size > 40 THEN 'page_size' WHEN len(s) = 0 THEN 'sources_missing' WHEN len(s) = 2 THEN 'source_unsupported' WHEN a > b THEN 'years_reversed' END AS reason FROM r
    ) SELECT p_partkey, reason, CASE WHEN reason IS NULL THEN array_to_string(k, '|') END AS keywords, CASE WHEN reason IS NULL THEN n END AS normal_query, CASE WHEN reason IS NULL THEN ceil(50 / size)::INT END AS max_pages,
        CASE WHEN reason IS NULL THEN 'query.' || sha256(array_to_string(k, chr(31)) || chr(31) || n || chr(31) || a || chr(31) || b || chr(31) || 'crossref' || chr(31) || 50 || chr(31) || size)[1:24] END AS query_id FROM v
""".replace("\\\\", "\\"))
def search_requests_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as search requests, some of them refused"""
    k = F.col("p_partkey")
    words = F.split("p_name", " ")
    requests = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(words, F.array(F.upper("p_type"), F.lit(" "), F.lit(None).cast("string"))).alias("keywords"), F.when(k % 3 > 0, F.concat(F.lit("  "), "p_brand", F.lit("  No "))).alias("query"),
        F.when(k % 4 > 0, F.col("p_size") + 1970).alias("year_from"), F.when(k % 5 > 0, F.lit(2010)).alias("year_to"),
        F.when(k % 7 == 1, F.array(F.lit("other"), F.lit("crossref"), F.lit("other"))).when(k % 7 > 1, F.array(F.lit("crossref"))).alias("sources"), F.lit(50).alias("candidate_limit"),
        F.when(F.col("p_size") > 40, F.col("p_size") + 100).otherwise(F.col("p_size")).alias("page_size"),
    )
    return search_requests.normalized(requests, ("crossref",)).select("p_partkey", "reason", F.array_join("normal_keywords", "|").alias("keywords"), "normal_query", "max_pages", "query_id")
