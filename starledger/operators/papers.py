"""Literature records: identity, duplicates, ranking and recall.

A paper is a row (id, title, authors array, year, doi, arxiv, url, source).
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.hashing import stable_id
from ..functions.numbers import ratio
from ..scratch import Scratch
from .components import components

#: Order of identity bases.
PRIORITY = {"doi": 1, "arxiv": 2, "title": 3, "source": 4}


def normalized(papers: DataFrame) -> DataFrame:
    """Keys beside each paper: doi_key, arxiv_key, title_key, author_keys, surname."""
    out = papers.withColumn("doi_key", text.doi(F.col("doi"))).withColumn("arxiv_key", text.arxiv(F.col("arxiv"))).withColumn("title_key", text.title_key(F.col("title")))
    joined = text.author_key(F.array_join(F.coalesce("authors", F.array().cast("array<string>")), " \u0001 "))  # one batch call for all authors
    keys = F.filter(F.transform(F.split(F.regexp_replace(joined, "\u0001", "\n"), "\n"), lambda a: F.trim(a)), lambda a: a != "")
    return out.withColumn("author_keys", keys).withColumn("surname", F.when(F.size("author_keys") > 0, text.surname(F.element_at("author_keys", 1))))


def identity(papers: DataFrame) -> DataFrame:
    """(id, basis, paper_id): the first of doi, arXiv id, title with year and surname, source record that a normalized paper has."""
    has_title = (F.col("title_key") != "") & F.col("year").isNotNull() & F.col("surname").isNotNull()
    basis = F.when(F.col("doi_key").isNotNull(), "doi").when(F.col("arxiv_key").isNotNull(), "arxiv").when(has_title, "title").otherwise("source")
    key = F.when(basis == "doi", F.col("doi_key")).when(basis == "arxiv", F.col("arxiv_key")).when(basis == "title", F.concat_ws("|", "title_key", "year", "surname")).otherwise(F.concat_ws("|", "source", "id"))
    return papers.select("id", basis.alias("basis"), stable_id("paper", basis, key).alias("paper_id"))


def _classes(papers: DataFrame) -> DataFrame:
    """Papers alike in all keys, as one: (class, n) and the keys."""
    keys = ["doi_key", "arxiv_key", "title_key", "year", "author_keys", "surname"]
    return papers.groupBy(*keys).agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("n"))


def duplicate_pairs(papers: DataFrame) -> DataFrame:
    """(left_id, right_id, basis) of different papers that are the same work; papers alike in all keys stand for one another.

    One basis a pair: doi_exact, else arxiv_exact, else title_year_author. Equal title and year without a common author or first
    surname is title_year_only, a potential duplicate. ``membership`` tells which papers stand together.
    """
    c = Scratch(papers.sparkSession, "classes").keep(_classes(papers), "classes")
    found, earlier = None, []
    for rank, (basis, key) in enumerate((("doi_exact", ["doi_key"]), ("arxiv_exact", ["arxiv_key"]), ("title_year", ["title_key", "year"])), 1):
        usable = c
        for k in key:
            usable = usable.where(F.col(k).isNotNull())
        # a pair comes once, from the first basis that it has, so pairs needn't be grouped
        named = lambda side: usable.select(F.col("class").alias(f"{side}_id"), *[F.col(x).alias(f"{side}_{x}") for x in ("doi_key", "arxiv_key", "title_key", "year", "author_keys", "surname")])  # noqa: E731, B023
        met = named("left").hint("merge").join(named("right"), [F.col(f"left_{x}") == F.col(f"right_{x}") for x in key]).where("left_id < right_id")
        for x in earlier:
            met = met.where(~F.coalesce(F.col(f"left_{x}") == F.col(f"right_{x}"), F.lit(False)))
        support = F.arrays_overlap("left_author_keys", "right_author_keys") | F.coalesce(F.col("left_surname") == F.col("right_surname"), F.lit(False))
        kind = F.when(F.lit(basis) != "title_year", F.lit(basis)).when(support, "title_year_author").otherwise("title_year_only")
        one = met.select("left_id", "right_id", F.lit(rank).alias("rank"), kind.alias("basis"))
        found = one if found is None else found.unionByName(one)
        earlier += key
    if c.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return found.drop("rank")
    return found.groupBy("left_id", "right_id").agg(F.min_by("basis", "rank").alias("basis"))


def membership(papers: DataFrame) -> DataFrame:
    """(id, class): the smallest id of the papers alike in all keys."""
    keys = ["doi_key", "arxiv_key", "title_key", "year", "author_keys", "surname"]
    c = _classes(papers)
    same = [papers[k].eqNullSafe(c[k]) for k in keys]
    return papers.join(c, same).select("id", "class")


def duplicate_links(papers: DataFrame) -> DataFrame:
    """(a, b): each paper with the smallest that shares a key with it: as many links as papers, whose components are those of all duplicate pairs."""
    long = papers.select("id", F.explode(F.array_compact(F.array(
        F.when(F.col("doi_key").isNotNull(), F.array(F.concat(F.lit("d|"), "doi_key"))), F.when(F.col("arxiv_key").isNotNull(), F.array(F.concat(F.lit("a|"), "arxiv_key"))),
        F.when(F.col("year").isNotNull(), F.transform(F.array_distinct("author_keys"), lambda a: F.concat_ws("|", F.lit("t"), "title_key", F.col("year").cast("string"), a))),
        F.when(F.col("year").isNotNull() & F.col("surname").isNotNull(), F.array(F.concat_ws("|", F.lit("s"), "title_key", F.col("year").cast("string"), F.col("surname")))),
    ))).alias("keys")).select("id", F.explode("keys").alias("key"))
    first = long.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "a")
    return long.join(first, "key").where("id != a").select("a", F.col("id").alias("b")).distinct()


def duplicate_groups(papers: DataFrame) -> DataFrame:
    """(id, group_id): the smallest id that duplicate pairs connect a paper to; itself if alone."""
    comp = components(duplicate_links(papers), Scratch(papers.sparkSession, "duplicates"), "groups")
    return papers.select("id").join(comp.toDF("id", "comp"), "id", "left").select("id", F.coalesce("comp", "id").alias("group_id"))


def representatives(papers: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, members, representative): the member with the best identity basis, then the smallest id."""
    basis = identity(papers)
    rank = F.coalesce(*[F.when(F.col("basis") == b, p) for b, p in PRIORITY.items()])
    return groups.join(basis, "id").groupBy("group_id").agg(F.count(F.lit(1)).alias("members"), F.min_by("id", F.struct(rank, "id")).alias("representative"))


def group_conflicts(papers: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, field, variants) where members of a group disagree: distinct values are counted, no pairs are formed."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), c.alias("value")) for f, c in (
        ("doi", F.col("doi_key")), ("arxiv", F.col("arxiv_key")), ("title", F.col("title_key")), ("year", F.col("year").cast("string")), ("authors", F.array_join("author_keys", "|")))])
    long = papers.join(groups, "id").select("group_id", F.explode(cells).alias("c")).select("group_id", "c.*").where("value is not null and trim(value) != ''")
    return long.distinct().groupBy("group_id", "field").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1")


def ranked(papers: DataFrame, keywords: list[str], years: tuple[int, int]) -> DataFrame:
    """(id, score, rank_key); keys sort as text, best first."""
    score = text.relevance(F.col("title"), F.col("body"), keywords, F.col("doi").isNotNull() | F.col("arxiv").isNotNull(), F.coalesce(F.col("year").between(*years), F.lit(False)))
    key = F.concat_ws("|", F.format_string("%.6f", 1 - F.col("score")), F.col("title"), F.coalesce(F.col("year"), F.lit(9999)).cast("string"), F.lpad(F.col("id").cast("string"), 12, "0"))
    return papers.withColumn("score", score).select("id", "score", key.alias("rank_key"))


def selection(ranks: DataFrame, groups: DataFrame, limit: int) -> DataFrame:
    """(id, selected, reason): the best of each duplicate group, then the ``limit`` best of those; duplicate and beyond_limit explain the rest."""
    placed = ranks.join(groups, "id")
    best = placed.groupBy("group_id").agg(F.min(F.struct("rank_key", "id")).alias("b")).select(F.col("b.id").alias("id"), "b.rank_key")
    top = best.orderBy("rank_key", "id").limit(limit).select("id", F.lit(True).alias("top"))
    out = placed.join(best.select("id", F.lit(True).alias("best")), "id", "left").join(F.broadcast(top), "id", "left")  # ``limit`` rows
    return out.select("id", F.coalesce("top", F.lit(False)).alias("selected"), F.when(F.col("best").isNull(), "duplicate").when(F.col("top").isNull(), "beyond_limit").otherwise("selected").alias("reason"))


def recall(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Expected papers that were found by doi, else arXiv id, else title and year: one row."""
    hit = None
    for basis, key in (("doi", ["doi_key"]), ("arxiv", ["arxiv_key"]), ("title", ["title_key", "year"])):
        one = expected.join(found.select(*key).distinct(), key, "left_semi").select("id", F.lit(basis).alias("basis"))
        hit = one if hit is None else hit.union(one)
    order = F.coalesce(*[F.when(F.col("basis") == b, p) for b, p in PRIORITY.items()])
    each = expected.select("id").join(hit.groupBy("id").agg(F.min_by("basis", order).alias("basis")), "id", "left")
    return each.agg(
        F.count(F.lit(1)).alias("expected"), F.count("basis").alias("matched"), *[F.count_if(F.col("basis") == b).alias(f"by_{b}") for b in ("doi", "arxiv", "title")], ratio(F.count("basis"), F.count(F.lit(1))).alias("recall"),
    )


# --- claims and relations -------------------------------------------------------------------------------


def comparability(a: Column, b: Column, structural: Column | None = None) -> Column:
    """Both null, or a structural relation: not_applicable; equal without case: comparable; else incomparable."""
    base = F.when(a.isNull() & b.isNull(), "not_applicable").when(F.coalesce(F.lower(a) == F.lower(b), F.lit(False)), "comparable").otherwise("incomparable")
    return base if structural is None else F.when(structural, "not_applicable").otherwise(base)


def eligible(claims: DataFrame) -> DataFrame:
    """Claims with evidence that weren't rejected."""
    return claims.where((F.col("status") != "rejected") & (F.size("evidence") > 0))


def pair_universe(claims: DataFrame) -> DataFrame:
    """How many directed pairs there are, counted and not formed."""
    n = F.count(F.lit(1))
    return eligible(claims).agg(n.alias("eligible"), (n * (n - 1)).alias("pairs"))


#: Pairs of claims with a common object that are formed at once.
FEW_PAIRS = 20_000_000
#: Objects of a claim up to which subsets of them are joined.
_OBJECTS = 6
_FLAGS = ("metric", "unit", "type")


def _by_tiers(c: DataFrame, k: int, most: int, scratch: Scratch) -> DataFrame:
    """(s_id, t_id): of the k best pairs all that share an object, metric, unit or type. Tiers of equal score are gone through from the best on.

    A tier's pairs meet under as many objects as they share and the flags that they match in, and only its first pairs by ids are asked for: those of
    the smallest sources, of which more are taken up until there are enough pairs or no more sources.
    """
    found, held = None, 0
    place = F.col("objects")
    for shared in range(most, -1, -1):
        keyed = c
        if shared:
            subsets = [F.when(F.size(place) > max(at), F.array(*[place[i] for i in at])) for at in itertools.combinations(range(most), shared)]
            keyed = c.withColumn("key", F.explode(F.array_compact(F.array(*subsets))))
        for match in itertools.product((True, False), repeat=len(_FLAGS)):
            same = [x for x, m in zip(_FLAGS, match, strict=True) if m]
            other = [x for x in _FLAGS if x not in same]
            key = ["key"] * bool(shared) + same
            if not key:
                continue
            rows = keyed.dropna(subset=same) if same else keyed
            varied = [(F.min(x) != F.max(x)) | (F.count(x) < F.count(F.lit(1))) for x in other]
            whole = rows.groupBy(*key).agg((F.count(F.lit(1)) > 1).alias("two"), *[F.coalesce(v, F.lit(True)).alias(f"v_{i}") for i, v in enumerate(varied)])
            whole = whole.where(" and ".join(["two", *(f"v_{i}" for i in range(len(varied)))])).select(*key)
            tier = "-".join(map(str, [shared, *same]))
            rows = scratch.keep(rows.join(whole, key, "left_semi"), f"rows-{tier}")
            sources = rows.select("id").distinct()
            take, all_ = 2 * k, sources.count()
            target = rows.select(*[F.col(x).alias(f"t_{x}") for x in rows.columns])
            while all_:
                first = scratch.keep(sources.orderBy("id").limit(take), f"sources-{tier}-{take}")
                met = rows.join(first, "id", "left_semi").hint("merge").join(target, [F.col(x) == F.col(f"t_{x}") for x in key])
                met = met.where((F.col("id") != F.col("t_id")) & (F.size(F.array_intersect("objects", "t_objects")) == shared))
                for x in other:
                    met = met.where(~F.coalesce(F.col(x) == F.col(f"t_{x}"), F.lit(False)))
                got = scratch.keep(met.select(F.col("id").alias("s_id"), "t_id").distinct().orderBy("s_id", "t_id").limit(k - held), f"pairs-{tier}-{take}")
                n = got.count()
                if n == k - held or take >= all_:
                    found, held = got if found is None else found.union(got), held + n
                    break
                take *= 16
            if held >= k:
                return found
    return found if found is not None else c.limit(0).select(F.col("id").alias("s_id"), F.col("id").alias("t_id"))


def top_pairs(claims: DataFrame, k: int = 1024) -> DataFrame:
    """The k first directed pairs (source_id, target_id, shared, metric_match, unit_match, same_type): most shared objects, then
    equal metric, unit and type, then ids.

    Where few pairs have a common object, these are formed; only when they are fewer than k are claims of equal metric, unit or type taken up as well. Else
    pairs come from tiers of equal score, the best first. Any claims are taken up at last, as a product of two tables of bounded size.
    """
    spark = claims.sparkSession
    scratch = Scratch(spark, "pairs")
    objects = F.array_sort(F.array_compact(F.array_distinct(F.coalesce("objects", F.array().cast(claims.schema["objects"].dataType)))))
    c = scratch.keep(eligible(claims).select("id", objects.alias("objects"), "metric", "unit", "type"), "claims")
    sides = [c.select(*[F.col(x).alias(f"{s}_{x}") for x in c.columns]) for s in ("s", "t")]
    one = scratch.keep(c.select("id", F.explode("objects").alias("o")), "objects")
    size = c.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("objects")), F.lit(0)).alias("most")).first()
    n = F.col("n").cast("double")
    alike = one.groupBy("o").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(n * (n - 1)), F.lit(0.0))).first()[0]
    few = alike <= FEW_PAIRS and (alike >= k * size["most"] > 0 or size["n"] ** 2 <= FEW_PAIRS)
    if few or size["most"] > _OBJECTS:
        shared = one.toDF("s_id", "o").join(one.toDF("t_id", "o"), "o").where("s_id != t_id").select("s_id", "t_id").distinct()
        found = scratch.keep(shared, "found")
        for key in _FLAGS:
            if found.limit(k).count() >= k:
                break
            more = sides[0].join(sides[1], F.col(f"s_{key}") == F.col(f"t_{key}")).where("s_id != t_id").select("s_id", "t_id")
            found = scratch.keep(found.union(more).distinct(), f"found-{key}")
    else:
        found = _by_tiers(c, k, size["most"], scratch)
    held = found.limit(k).count()
    if held < k:
        n = max(2, c.count())
        few = c.orderBy("id").limit(2 * k // (n - 1) + 2).select(F.col("id").alias("s_id"))
        many = c.orderBy("id").limit(2 * k + 2).select(F.col("id").alias("t_id"))
        found = found.union(few.crossJoin(many).where("s_id != t_id")).distinct()  # both limited
    scored = found.join(sides[0], "s_id").join(sides[1], "t_id")
    same = lambda x: F.coalesce(F.col(f"s_{x}") == F.col(f"t_{x}"), F.lit(False)).cast("int")
    out = scored.select(F.col("s_id").alias("source_id"), F.col("t_id").alias("target_id"), F.size(F.array_intersect("s_objects", "t_objects")).alias("shared"), same("metric").alias("metric_match"), same("unit").alias("unit_match"), same("type").alias("same_type"))
    return out.orderBy(*[F.desc(x) for x in ("shared", "metric_match", "unit_match", "same_type")], "source_id", "target_id").limit(k)


def confidence_records(pairs: DataFrame, types: list[str]) -> DataFrame:
    """One not-evaluable record for each pair and allowed relation type."""
    return pairs.select("source_id", "target_id", F.explode(F.array(*[F.lit(t) for t in types])).alias("relation_type"), F.lit("not_evaluable").alias("status"))


def first_failure(*checks: tuple[str, Column]) -> Column:
    """Name of the first check that fails; null if none does."""
    out = F.when(F.lit(False), "")
    for name, failed in checks:
        out = out.when(F.coalesce(failed, F.lit(True)), name)
    return out


def admit_claims(claims: DataFrame, evidence: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(id, status, reason): the first gate a claim fails, in order: text, evidence given, evidence exists, its snapshot exists, same owner,
    text is safe, not a repetition; what passes is accepted, or a candidate if its evidence is weak.

    ``claims`` (id, owner, text, normalized, evidence array), ``evidence`` (evidence_id, snapshot_id, owner, strength), ``snapshots`` (snapshot_id).
    """
    known = evidence.join(snapshots.withColumn("has_snapshot", F.lit(True)), "snapshot_id", "left").select("evidence_id", F.col("owner").alias("e_owner"), "strength", F.coalesce("has_snapshot", F.lit(False)).alias("has_snapshot"), F.lit(True).alias("known"))
    long = claims.select("id", "owner", F.explode_outer("evidence").alias("evidence_id")).join(known, "evidence_id", "left")
    each = long.groupBy("id").agg(
        F.count("evidence_id").alias("given"), F.bool_and(F.coalesce("known", F.lit(False))).alias("exists"), F.bool_and(F.coalesce("has_snapshot", F.lit(False))).alias("pinned"), F.bool_and(F.coalesce(F.col("owner") == F.col("e_owner"), F.lit(False))).alias("owned"),
        F.bool_and(F.coalesce(F.col("strength") == "weak", F.lit(True))).alias("weak"),
    )
    first = claims.groupBy("owner", "normalized").agg(F.min("id").alias("first"))
    out = claims.join(each, "id").join(first, ["owner", "normalized"], "left")
    reason = first_failure(
        ("empty_text", F.trim(F.coalesce("text", F.lit(""))) == ""), ("no_evidence", F.col("given") == 0), ("unknown_evidence", ~F.col("exists")), ("missing_snapshot", ~F.col("pinned")), ("foreign_evidence", ~F.col("owned")),
        ("unsafe_text", text.negation_lost(F.col("text"), F.col("normalized")) | F.coalesce(F.col("text").rlike(text.UNSAFE), F.lit(False))), ("duplicate", F.col("id") != F.coalesce("first", "id")),
    )
    return out.select("id", F.when(reason.isNotNull(), "rejected").when(F.col("weak"), "candidate").otherwise("accepted").alias("status"), reason.alias("reason"))


def admit_relations(relations: DataFrame, claims: DataFrame, symmetric: tuple[str, ...] = ("agrees", "contradicts")) -> DataFrame:
    """(id, status, reason): gates in order: both claims exist and are not rejected, they differ, they can be compared, the trace is there, evidence is there, confidence is from 0 to 1, not a repetition (a symmetric type counts in either direction)."""
    c = claims.select("id", F.col("status").alias("st"), "metric")
    out = relations.join(c.toDF("source_id", "s_status", "s_metric"), "source_id", "left").join(c.toDF("target_id", "t_status", "t_metric"), "target_id", "left")
    sym = F.col("type").isin(*symmetric)
    key = F.struct("type", F.when(sym, F.least("source_id", "target_id")).otherwise(F.col("source_id")).alias("a"), F.when(sym, F.greatest("source_id", "target_id")).otherwise(F.col("target_id")).alias("b"))
    first = relations.withColumn("k", key).groupBy("k").agg(F.min("id").alias("first"))
    out = out.withColumn("k", key).join(first, "k", "left")
    gone = lambda s: F.coalesce(F.col(s), F.lit("rejected")) == "rejected"
    reason = first_failure(
        ("missing_endpoint", gone("s_status") | gone("t_status")), ("self_relation", F.col("source_id") == F.col("target_id")), ("incomparable", sym & (comparability(F.col("s_metric"), F.col("t_metric")) == "incomparable")),
        ("no_trace", F.coalesce(F.size("trace"), F.lit(0)) < 1), ("no_evidence", F.coalesce(F.size("evidence"), F.lit(0)) < 1), ("bad_confidence", ~F.col("confidence").between(0, 1)), ("duplicate", F.col("id") != F.coalesce("first", "id")),
    )
    return out.select("id", F.when(reason.isNotNull(), "rejected").otherwise("accepted").alias("status"), reason.alias("reason"))


def adjudicate(base: DataFrame, decisions: DataFrame) -> DataFrame:
    """A new version in which decisions (id, decision, reviewer) replace statuses; the base stays as it is."""
    out = base.join(decisions.select("id", "decision", "reviewer"), "id", "left")
    return out.withColumn("status", F.coalesce("decision", "status")).withColumn("version", F.when(F.col("decision").isNotNull(), 2).otherwise(1)).drop("decision")


def rollup(rows: DataFrame, group: list[str]) -> DataFrame:
    """Counts by status and the group's status: accepted if any is, else candidate if any is, else rejected."""
    s = F.col("status")
    return rows.groupBy(*group).agg(
        F.count_if(s == "accepted").alias("accepted"), F.count_if(s == "candidate").alias("candidate"), F.count_if(s == "rejected").alias("rejected"),
        F.when(F.bool_or(s == "accepted"), "accepted").when(F.bool_or(s == "candidate"), "candidate").otherwise("rejected").alias("status"),
    )


def rejections(rows: DataFrame, samples: int = 5) -> DataFrame:
    """(reason, n, sample): the smallest ids of each reason."""
    w = Window.partitionBy("reason").orderBy("id")
    r = rows.where("status = 'rejected'")
    counts = r.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    # Spark cuts each partition to the first ranks before the shuffle
    few = r.withColumn("i", F.row_number().over(w)).where(F.col("i") <= samples).groupBy("reason").agg(F.array_sort(F.collect_list("id")).alias("sample"))
    return counts.join(few, "reason")


# --- summaries ------------------------------------------------------------------------------------------

#: Sections of a summary in order.
SECTIONS = ("background", "objective", "data", "methods", "results", "limitations", "conclusions")


def admit_statements(statements: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, status, reason): a statement needs a known section, text and evidence of its own chunk."""
    own = evidence.select("evidence_id", F.col("chunk_id").alias("e_chunk"))
    long = statements.select("id", "chunk_id", F.explode_outer("evidence").alias("evidence_id")).join(own, "evidence_id", "left")
    each = long.groupBy("id").agg(F.count("evidence_id").alias("given"), F.bool_and(F.coalesce(F.col("chunk_id") == F.col("e_chunk"), F.lit(False))).alias("own"))
    reason = first_failure(("unknown_section", ~F.col("section").isin(*SECTIONS)), ("empty_text", F.trim(F.coalesce("text", F.lit(""))) == ""), ("no_evidence", F.col("given") == 0), ("evidence_outside_chunk", ~F.col("own")))
    return statements.join(each, "id").select("id", F.when(reason.isNotNull(), "rejected").otherwise("accepted").alias("status"), reason.alias("reason"))


def reduce_sections(statements: DataFrame) -> DataFrame:
    """(paper_id, section, texts, evidence) of accepted statements in the order of chunks; evidence once, by first use."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_id", "position", "text", "evidence")))
    g = statements.groupBy("paper_id", "section").agg(ordered.alias("o"))
    return g.select("paper_id", "section", F.transform("o", lambda s: s["text"]).alias("texts"), F.array_distinct(F.flatten(F.transform("o", lambda s: s["evidence"]))).alias("evidence"))


def uncovered(chunks: DataFrame, statements: DataFrame) -> DataFrame:
    """(chunk_id, missing): evidence of a chunk that no statement uses."""
    used = statements.select("chunk_id", F.explode("evidence").alias("e")).distinct().withColumn("used", F.lit(True))
    long = chunks.select("chunk_id", F.explode("evidence").alias("e")).join(used, ["chunk_id", "e"], "left_anti")
    return long.groupBy("chunk_id").agg(F.array_sort(F.collect_set("e")).alias("missing"))


def markdown(sections: DataFrame) -> DataFrame:
    """One text a paper: headings in order, statements as items, control characters escaped."""
    place = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section"))
    items = F.array_join(F.transform("texts", lambda t: F.concat(F.lit("- "), F.regexp_replace(t, r"([\\`*_\[\]<>#|])", r"\\$1"))), "\n")
    part = F.concat(F.lit("## "), F.initcap("section"), F.lit("\n\n"), items)
    parts = F.array_sort(F.collect_list(F.struct(place.alias("p"), part.alias("t"))))
    return sections.groupBy("paper_id").agg(F.array_join(F.transform(parts, lambda s: s["t"]), "\n\n").alias("markdown"))
