"""The dealt operators applied to whole tables: one thin query for each."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anisotropic, chat, decontamination, lexical, packing, periodic_runs, quality, sentencepieces, sharding, threshold_topk, toxicity, warc
from .folds import remainder
from .ngram_jaccard import counted_duplicates
from .scoring import score
from .shared import Scratch, new_path, table

#: Label 1 is predicted from this score on.
CUT = 0.3
#: Shards that documents are dealt to.
SHARDS = 256


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of shingles, its component and its number of links; rows without words or doc_id link with nothing."""
    return counted_duplicates(table(spark, sf_dir, "documents"), percent=75, k=5)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's slot and shard; a null doc_id is a key like any other."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, "doc_id", sharding.names(SHARDS))


def op3_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products for each row whose vec_id is divisible by 20; unusable vectors take no part."""
    return threshold_topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20, scale=64)


def op4_anisotropic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for each row whose vec_id is divisible by 20; null, zero and non-finite vectors take no part."""
    return anisotropic.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of conversation -7, read back from their formatted text; null texts and roles are empty."""
    rows = table(spark, sf_dir, "conversations")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    turns = chat.table_turns(rows.select("conv_id", "turn", "role", "text").unionByName(extra), "conv_id")
    return chat.read_back(chat.format_turns(turns)).withColumnRenamed("id", "conv_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from its archive; null html is an empty payload, equal payloads of 100 bytes or more are revisits of the smallest page_id."""
    folder = new_path(spark, "warc")
    index = Scratch(spark, "warc").keep(warc.write(warc.plan(table(spark, sf_dir, "pages")), folder), "index")
    return warc.read(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them; a null text is empty."""
    return sentencepieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def _predicted(df: DataFrame) -> DataFrame:
    return df.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; a null text is scored as an empty one, held_out is null for a null doc_id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder(5) == 0
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return _predicted(score(docs, model).select("doc_id", held_out.alias("held_out"), "score"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents; a null text is scored as an empty one, held_out is null for a null doc_id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder(4) == 2
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return _predicted(score(docs, model).select("doc_id", held_out.alias("held_out"), "score"))


def packed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    cut = Scratch(spark, "packing").keep(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0), "pieces")
    return packing.pack(cut, capacity=2048)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all pieces of all documents in sequences of 2048 tokens; a null text has the end id only."""
    return packed(spark, table(spark, sf_dir, "documents"))


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest-scoring documents for each benchmark item; null texts have no terms, a null doc_id comes last among equal scores."""
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in about a tenth of the documents, chosen by h = crc32(doc_id), the words from word a on repeat with period p.

    A null doc_id has no h, so its text stays.
    """
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g = F.expr("h div 10")
    n = F.expr("cast(size(words) AS long)")
    a = F.expr("g % n")
    p = F.expr("1 + (n - a) div (3 + g % 8)")
    at = F.sequence(F.lit(0).cast("long"), F.expr("n - 1"))
    repeated = F.array_join(F.transform(at, lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))), " ")
    chosen = F.col("h") % 10 == 0
    out = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    out = out.withColumn("g", g).withColumn("words", F.when(chosen, words)).withColumn("n", n)
    out = out.withColumn("a", F.when(chosen & (F.col("n") > 0), a)).withColumn("p", F.when(chosen & (F.col("n") > 0), p))
    return out.select("doc_id", F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def op12_periodic_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, some of which get periods planted; a null text has no words, rows that repeat a doc_id each have their own runs."""
    found = periodic_runs.find_runs(with_periods(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document lie inside windows of benchmark items, and of which items; a null text has no words."""
    found = decontamination.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), k=10)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_sharding, op3_threshold_topk, op4_anisotropic_ann, op5_chat_formatting, op6_warc, op7_sentencepiece, op8_quality_classifier, op9_toxicity, op10_best_fit_packing,
    op11_ranked_lexical_search, op12_periodic_run_detection, op13_benchmark_decontamination,
)}

#: DuckDB SQL where SQL can express the result.
ORACLE_SQL = {
    "op3_threshold_topk": """
        WITH fine AS (
            SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.own, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM fine q JOIN fine c ON q.vec_id % 20 = 0 AND q.own <> c.own AND len(q.v) = len(c.v)
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
        ) SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op6_warc": """
        WITH own AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        ranked AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM own)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
        FROM ranked
    """,
    "op11_ranked_lexical_search": r"""
        WITH terms AS (
            SELECT own, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT row_number() OVER () AS own, doc_id, text FROM documents)
        ), tf AS (SELECT own, doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
        lengths AS (SELECT own, sum(tf)::BIGINT AS n FROM tf GROUP BY own),
        totals AS (SELECT count(*) AS held, sum(n)::BIGINT AS total FROM lengths),
        weights AS (
            SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(held) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, totals GROUP BY term
        ), asked AS (
            SELECT item_id, term, count(*) AS times FROM (
                SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                FROM (SELECT DISTINCT item_id, text FROM benchmark)
            ) GROUP BY ALL
        ), scored AS (
            SELECT item_id, own, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * held) // total)))) AS BIGINT) AS score
            FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN lengths USING (own), totals GROUP BY ALL
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM scored WHERE score > 0
        ) SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
    """,
    "op13_benchmark_decontamination": r"""
        WITH texts AS (
            SELECT own, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
            FROM (SELECT row_number() OVER () AS own, doc_id, text FROM documents)
        ), items AS (
            SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
        ), windows AS (
            SELECT DISTINCT item_id, m, array_to_string(words[i : i + m - 1], ' ') AS win
            FROM (SELECT item_id, words, least(10, len(words)) AS m, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i FROM items WHERE len(words) > 0)
        ), places AS (
            SELECT own, m, i, array_to_string(words[i : i + m - 1], ' ') AS win
            FROM (SELECT own, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM texts, (SELECT DISTINCT m FROM windows) WHERE len(words) >= m)
        ), found AS (SELECT own, m, i, item_id FROM places JOIN windows USING (m, win)),
        hit AS (SELECT own, count(DISTINCT word) AS n_hit FROM (SELECT own, unnest(range(i, i + m)) AS word FROM (SELECT DISTINCT own, m, i FROM found)) GROUP BY own),
        named AS (SELECT own, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM found GROUP BY own)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM texts LEFT JOIN hit USING (own) LEFT JOIN named USING (own)
    """,
}
