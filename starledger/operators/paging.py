"""Reads: latest rows, keyset pages, acquisition pages, anti joins, caches."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import neighbours


def latest(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The last row of each group. A maximum, so partial results meet and not a group's rows."""
    best = F.max_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*group).agg(best.alias("r")).select("r.*")


def after(keys: list[tuple[str, bool]], anchor: list) -> Column:
    """Rows behind the anchor in an order of (column, descending)."""
    out, same = F.lit(False), F.lit(True)
    for (c, desc), value in zip(keys, anchor, strict=True):
        v = value if isinstance(value, Column) else F.lit(value)
        out = out | (same & (F.col(c) < v if desc else F.col(c) > v))
        same = same & (F.col(c) == v)
    return out


def keyset_page(df: DataFrame, keys: list[tuple[str, bool]], size: int, anchor: list | None = None) -> DataFrame:
    """The next ``size`` rows behind the anchor; has_more tells whether others follow. Last key must be unique."""
    rows = df if anchor is None else df.where(after(keys, anchor))
    order = [F.desc(c) if d else F.asc(c) for c, d in keys]
    page = rows.orderBy(*order).limit(size + 1)  # a page and one row
    w = Window.orderBy(*order)
    return page.withColumn("__i", F.row_number().over(w)).withColumn("has_more", F.max("__i").over(Window.partitionBy()) > size).where(F.col("__i") <= size).drop("__i")


def keyset_groups(df: DataFrame, group: str, stamp: str, size: int, anchor: tuple | None = None) -> DataFrame:
    """Groups by the latest stamp, behind an anchor on that aggregate."""
    g = df.groupBy(group).agg(F.max(stamp).alias("latest"), F.count(F.lit(1)).alias("n"))
    return keyset_page(g, [("latest", True), (group, True)], size, list(anchor) if anchor else None)


def page_behind(df: DataFrame, key: str, cursor, size: int) -> DataFrame:
    """As L03, but a cursor that is no row's key is an error."""
    if cursor is not None and df.where(F.col(key) == F.lit(cursor)).limit(1).isEmpty():
        raise ValueError(f"no row has the cursor {cursor!r}")
    return keyset_page(df, [(key, False)], size, None if cursor is None else [cursor])


def sign_cursor(secret: bytes, fields: dict) -> str:
    """A cursor that is bound to its fields (version, order, filters, anchor)."""
    body = json.dumps(fields, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()
    return base64.urlsafe_b64encode(hmac.digest(secret, body, "sha256") + body).decode()


def open_cursor(secret: bytes, cursor: str, bound: dict) -> dict:
    """The fields of a cursor; ValueError if it was changed or made for another read."""
    try:
        raw = base64.urlsafe_b64decode(cursor.encode())
        fields = json.loads(raw[32:])
    except ValueError as e:
        raise ValueError("not a cursor") from e
    if not hmac.compare_digest(raw[:32], hmac.digest(secret, raw[32:], hashlib.sha256)) or any(fields.get(k) != v for k, v in bound.items()):
        raise ValueError("the cursor belongs to another read")
    return fields


def oldest(df: DataFrame, stamp: str, key: str, k: int = 4) -> DataFrame:
    """First in, first out."""
    return df.orderBy(stamp, key).limit(k)


def next_numbers(df: DataFrame, group: list[str], number: str) -> DataFrame:
    """One more than the largest number of each group; 1 for groups without any."""
    return df.groupBy(*group).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_number"))


def best_candidate(df: DataFrame, group: list[str], stamp: str, checks: list[tuple[str, Column]]) -> DataFrame:
    """Of each group the newest row that passes all checks, or else the most important reason for which none did (later checks are more important).

    Gives the group, stamp (null if none passed) and reason (null if one did). Both are aggregates.
    """
    place = reduce(lambda w, ic: w.when(~F.coalesce(ic[1][1], F.lit(False)), ic[0]), enumerate(checks), F.when(F.lit(False), 0))
    names = F.array(*[F.lit(n) for n, _ in checks])
    g = df.withColumn("__failed", place).groupBy(*group).agg(F.max(F.when(F.col("__failed").isNull(), F.col(stamp))).alias(stamp), F.max("__failed").alias("__worst"))
    return g.select(*group, stamp, F.when(F.col(stamp).isNull(), F.get(names, F.col("__worst"))).alias("reason"))


def without_answer(questions: DataFrame, answers: DataFrame, key: list[str]) -> DataFrame:
    """Questions that no answer names."""
    return questions.join(answers.select(*key).distinct(), key, "left_anti")


def flagged(rows: DataFrame, other: DataFrame, key: list[str], flag: str) -> DataFrame:
    """Every row, and whether the other table has its key."""
    return rows.join(other.select(*key).distinct().withColumn(flag, F.lit(True)), key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def unexpired(df: DataFrame, now: Column, expires: str = "expires_at", since: str | None = None) -> DataFrame:
    """not expired at ``now``, and valid already."""
    ok = F.col(expires) > now
    return df.where(ok & (F.col(since) <= now) if since else ok)


def expired_shares(df: DataFrame, cutoff: Column) -> DataFrame:
    """expired, or revoked, by the cutoff."""
    return df.where((F.col("expires_at") <= cutoff) | F.coalesce(F.col("revoked_at") <= cutoff, F.lit(False)))


def cache_upsert(cache: DataFrame, fresh: DataFrame, key: list[str], now: Column) -> DataFrame:
    """Fresh entries enter where the key is new or its entry has expired; the others stay."""
    live = cache.where(F.col("expires_at") > now)
    entering = fresh.join(live.select(*key), key, "left_anti")
    return cache.join(entering.select(*key), key, "left_anti").unionByName(entering)


def pages(df: DataFrame, keys: list[str], size: int, placed: DataFrame | None = None) -> DataFrame:
    """Acquisition pages as a column: (keys..., page_no) in key order. Give rows with positions for tables of any size."""
    from .ordering import positions

    out = placed if placed is not None else positions(df.withColumn("__all", F.lit(0)), ["__all"], keys).drop("__all")
    return out.withColumn("page_no", F.floor(F.col("position") / size).cast("long")).drop("position", "group_size")


def completion(paged: DataFrame, source: str, size: int, limit: int) -> DataFrame:
    """Of each source: complete if the last page is short, truncated at the limit, else unknown; with the last key as a cursor when more may follow."""
    counts = paged.groupBy(source, "page_no").agg(F.count(F.lit(1)).alias("n"))
    g = counts.groupBy(source).agg(F.sum("n").alias("records"), F.max_by("n", "page_no").alias("last_page_rows"), F.count(F.lit(1)).alias("pages"))
    return g.withColumn("completion", F.when(F.col("records") >= limit, "truncated").when(F.col("last_page_rows") < size, "complete").otherwise("unknown"))


def unstable_pages(df: DataFrame, page: str, index: str, keys: list[str]) -> DataFrame:
    """Rows whose key does not come after that of the row before on their page, or whose page starts before the last page's end.

    Windows hold one page; page ends are one row a page, and neighbouring ends meet in blocks of pages.
    """
    key = F.struct(*keys)
    w = Window.partitionBy(page).orderBy(index)
    inside = df.withColumn("__last", F.lag(key).over(w)).where(F.col("__last").isNotNull() & (key <= F.col("__last"))).select(page, index, F.lit("within_page").alias("where"))
    ends = df.groupBy(page).agg(F.min_by(key, index).alias("first"), F.max_by(key, index).alias("last"), F.min(index).alias("at"))
    across = neighbours(ends, [], [page], {"__last": lambda w: F.lag("last").over(w)}, before=1).where("first <= __last").select(page, F.col("at").alias(index), F.lit("between_pages").alias("where"))
    return inside.unionByName(across)


def one_version(pages_: DataFrame, source: str, tag: str) -> DataFrame:
    """The tag that all pages of a source agree on, null for none; pages that differ stop the query. Keeps the two extremes and no set."""
    g = pages_.groupBy(source).agg(F.min(tag).alias("lo"), F.max(tag).alias("hi"))
    return g.select(source, F.when(F.col("lo") != F.col("hi"), F.raise_error(F.concat(F.lit("pages of two versions: "), F.col(source).cast("string"))).cast("string")).otherwise(F.col("lo")).alias(tag))


def row_count_is(df: DataFrame, declared: int) -> DataFrame:
    """(declared, found); a difference stops the query."""
    return df.agg(F.count(F.lit(1)).alias("found")).select(F.lit(declared).cast("long").alias("declared"), F.when(F.col("found") == declared, F.col("found")).otherwise(F.raise_error(F.concat(F.lit(f"{declared} rows were declared, found "), F.col("found").cast("string"))).cast("long")).alias("found"))


def first_seen(df: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """Distinct values of each group in the order of their first appearance."""
    return df.groupBy(*group, value).agg(F.min(order).alias("first"))
