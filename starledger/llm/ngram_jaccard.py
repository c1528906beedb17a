"""N-gram Jaccard join: an exact join in the metric space of shingle sets under the Jaccard distance.

The distance is 1 - |r & s| / |r | s|; two documents link when it is at most ``1 - threshold``. Four steps,
each a Spark job over all documents:

1. ``sketch``. A document can only have a partner if enough of its first shingles (in hash order) are shared
   with some other document. Shingles meet by hash bucket, one packed array for each batch of documents and
   bucket; a shingle that repeats inside a batch is settled there, so a passage of a third of all documents
   sends one entry for each batch. What has no possible partner stops here.
2. ``regions``. Every shingle is a pivot whose Voronoi region holds the sets for which it is the nearest
   singleton set, rare pivots first. A set within the threshold of another misses at most ``|s| - ceil(t |s|)``
   of its shingles there, so the triangle inequality bounds how far a set reaches beyond its home region: it
   is copied to the regions of its first ``|s| - ceil(t |s|) + 1`` shingles, and any two linked sets meet. The
   smaller of two needs fewer, its homes: a partner that is no smaller shares at least ``2 t / (1 + t)`` of it.
   Shingles of common passages come last in that order and rarely make a region.
3. ``split``. Inside a region document pivots take over, again and again: every member is measured against
   them, members in a pivot's ball link to it, and of a ball only the boundary that the triangle inequality
   can't part from an outsider goes on. Regions whose members are connected are done, so a group of
   thousands of near copies costs one comparison each, not one for each pair.
4. What is left after ``rounds`` splits gathers in cells of document pivots, cut into blocks of bounded size. Two
   blocks meet in one task, which counts common shingles of all their sets at once and returns only as many links as
   connect the components. This part grows with the square of what no pivot settles, but sends no pairs around.

Steps 3 and 4 give components, not every link. Where the number of links counts (``every``), ``count_links`` takes
their place: all regions gather in cells, and every pair of distinct sets that meets is compared, once.

Exact copies of a set are one member throughout, so copies never meet each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .shared import Scratch
from .shingles import Shingler

_SPREAD = np.uint64(0xD6E8FEB86659FD93)
#: Documents of a batch: their place in it is sent in 16 bits, with one value to spare.
_BATCH = 8_000
_SETTLED = 65_535
#: Pivots of a region in the splits after the first.
_PIVOTS = 8
#: What a document is in a sketch: its id and whether it has one, its text's hash, set size, set hash, shared shingles so far.
_DOC = np.dtype([("id", "<i8"), ("ok", "?"), ("hash", "<i8"), ("n", "<i4"), ("key", "S16"), ("shared", "<i4")])
#: Bytes of text for each bucket in which shingles meet, and members of a region that one task takes, about.
_BUCKET_BYTES, _HOT = 1 << 26, 1000


def _need(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Fewest shingles that a set of n shares with any partner."""
    return (percent * n + 99) // 100


def _need_of_equal(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Fewest shingles that a set of n shares with a partner that is no smaller."""
    return -(-2 * percent * n // (100 + percent))


def _bucketed(tokens: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket, and 32 more bits that tell tokens of a bucket apart. Two tokens that fall together only weaken a filter."""
    t = tokens * _SPREAD
    t ^= t >> np.uint64(32)
    t *= _SPREAD
    return ((t >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32), t.astype(np.uint32)


def _set_key(s: np.ndarray) -> bytes:
    """128 bits of a set."""
    return xxhash.xxh3_128_digest(s.tobytes())


def _batches(it: Iterator[pa.RecordBatch], most: int, chars: int) -> Iterator[pa.RecordBatch]:
    """Cut into batches of at most ``most`` rows and about ``chars`` bytes of the column text."""
    for b in it:
        start, size = 0, 0
        column = b.column("text")
        lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(lengths):
            size += int(n)
            if i + 1 - start >= most or size >= chars:
                yield b.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < len(lengths):
            yield b.slice(start)


def _batch_number(i: int) -> int:
    """By partition and order: the rows of a partition have to come in an order that a task which runs again repeats."""
    return (TaskContext.get().partitionId() << 32) + i


def _packs(batch: int, order: np.ndarray, bucket: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[dict]:
    """Rows of one batch: what goes to each bucket."""
    b = bucket[order]
    cuts = np.flatnonzero(np.diff(b)) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield {"bucket": int(bucket[part[0]]), "batch": batch} | {k: v[part].tobytes() for k, v in columns.items()}


# --- step 1: which documents can have a partner ---------------------------------------------------------

_SKETCH = "bucket int, batch long, tok binary, loc binary, info binary"
_SKETCH_ARROW = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("tok", pa.binary()), ("loc", pa.binary()), ("info", pa.binary())])


def _prefix_lengths(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles looked at, and how many of them a partner shares at least."""
    need = _need(n, percent)
    extra = np.minimum(np.maximum(1, -(-n // 16)), np.maximum(need, 1))
    return np.minimum(n, n - need + extra), extra


def _sketcher(percent: int, k: int, buckets: int):
    def sketch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for i, b in enumerate(_batches(it, _BATCH, 8_000_000)):
            batch = _batch_number(i)
            ids = b.column("doc_id")
            texts = b.column("text")
            docs = np.zeros(len(ids), _DOC)
            docs["ok"] = ids.is_valid().to_numpy(zero_copy_only=False)
            docs["id"] = ids.fill_null(0).to_numpy(zero_copy_only=False)
            docs["hash"] = b.column("hash").to_numpy()
            kept, owner = [], []
            for start in range(0, len(ids), 500):  # whole sets of few texts are in memory at once
                for j, s in enumerate(shingler.sets(texts.slice(start, 500).to_pylist()), start):
                    docs["n"][j] = len(s)
                    docs["key"][j] = _set_key(s)
                    if docs["ok"][j] and len(s):
                        most, _ = _prefix_lengths(len(s), percent)
                        kept.append(s[: int(most)])
                        owner.append(j)
            tok = np.concatenate(kept) if kept else np.empty(0, np.uint64)
            loc = np.repeat(np.array(owner, np.uint16), [len(x) for x in kept])
            order = np.argsort(tok, kind="stable")
            st = tok[order]
            first = np.ones(len(st), bool)
            first[1:] = st[1:] != st[:-1]
            lone = first.copy()
            lone[:-1] &= first[1:]
            docs["shared"] += np.bincount(loc[order][~lone], minlength=len(docs)).astype(np.int32)
            to = np.where(lone, loc[order], _SETTLED).astype(np.uint16)[first]
            bucket, rest = _bucketed(st[first], buckets)
            rows = list(_packs(batch, np.argsort(bucket, kind="stable"), bucket, {"tok": rest, "loc": to}))
            rows.append({"bucket": int(batch % buckets), "batch": batch, "info": docs.tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema=_SKETCH_ARROW)

    return sketch


def _meet(t: pa.Table) -> pa.Table:
    """Of one bucket: the places in each batch whose shingle another batch has too. Batches' own rows pass."""
    rows = []
    packs = []
    for r in t.to_pylist():
        if r["info"] is not None:
            rows.append({"batch": r["batch"], "loc": None, "info": r["info"]})
        else:
            packs.append((r["batch"], np.frombuffer(r["tok"], np.uint32), np.frombuffer(r["loc"], np.uint16)))
    if packs:
        tok = np.concatenate([p[1] for p in packs])
        loc = np.concatenate([p[2] for p in packs])
        own = np.repeat(np.arange(len(packs)), [len(p[1]) for p in packs])
        order = np.argsort(tok, kind="stable")
        st = tok[order]
        same = np.zeros(len(st), bool)
        same[1:] = st[1:] == st[:-1]
        same[:-1] |= same[1:]
        hit = order[same]
        hit = hit[loc[hit] != _SETTLED]
        by = np.argsort(own[hit], kind="stable")
        hit = hit[by]
        for part in np.split(hit, np.flatnonzero(np.diff(own[hit])) + 1) if len(hit) else []:
            rows.append({"batch": packs[own[part[0]]][0], "loc": loc[part].tobytes(), "info": None})
    return pa.Table.from_pylist(rows, schema=pa.schema([("batch", pa.int64()), ("loc", pa.binary()), ("info", pa.binary())]))


def _settler(percent: int):
    def settle(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        docs = np.concatenate([np.frombuffer(r["info"], _DOC) for r in rows if r["info"] is not None]).copy()
        for r in rows:
            if r["loc"] is not None:
                docs["shared"] += np.bincount(np.frombuffer(r["loc"], np.uint16), minlength=len(docs)).astype(np.int32)
        _, extra = _prefix_lengths(docs["n"].astype(np.int64), percent)
        keys = docs["key"].copy().view(np.uint8).reshape(-1, 16)
        return pa.table({
            "doc_id": pa.array(docs["id"], pa.int64(), mask=~docs["ok"]), "n_shingles": pa.array(docs["n"].astype(np.int64)),
            "text_hash": pa.array(docs["hash"]), "key": pa.array([x.tobytes() for x in keys], pa.binary()), "maybe": pa.array(docs["ok"] & (docs["n"] > 0) & (docs["shared"] >= extra)),
        })

    return settle


def buckets_for(docs: DataFrame) -> int:
    """Buckets in which shingles meet: as many as there is text for, since each of them has to fit a task."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // _BUCKET_BYTES))


def sketch(docs: DataFrame, percent: int, k: int, buckets: int) -> DataFrame:
    """(doc_id, n_shingles, text_hash, key, maybe) for each row of documents."""
    packs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("hash")).mapInArrow(_sketcher(percent, k, buckets), _SKETCH)
    met = packs.groupBy("bucket").applyInArrow(_meet, "batch long, loc binary, info binary")
    return met.groupBy("batch").applyInArrow(_settler(percent), "doc_id long, n_shingles long, text_hash long, key binary, maybe boolean")


# --- step 2: regions of shingle pivots ------------------------------------------------------------------

_SETS = "bucket int, batch long, tok binary, cnt binary, sizes binary, keys binary, sets binary"
_SETS_ARROW = pa.schema([("bucket", pa.int32()), ("batch", pa.int64())] + [(c, pa.binary()) for c in ("tok", "cnt", "sizes", "keys", "sets")])


def _set_maker(k: int, buckets: int):
    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for i, b in enumerate(_batches(it, 1000, 4_000_000)):
            batch = _batch_number(i)
            sets = [s for s in shingler.sets(b.column("text").to_pylist()) if len(s)]
            if not sets:
                continue
            every = np.concatenate(sets)
            tok, cnt = np.unique(every, return_counts=True)
            bucket, rest = _bucketed(tok, buckets)
            rows = list(_packs(batch, np.argsort(bucket, kind="stable"), bucket, {"tok": rest, "cnt": cnt.astype(np.uint32)}))
            rows.append({
                "bucket": int(batch % buckets), "batch": batch, "sizes": np.array([len(s) for s in sets], np.uint32).tobytes(),
                "keys": b"".join(map(_set_key, sets)), "sets": every.tobytes(),
            })
            yield pa.RecordBatch.from_pylist(rows, schema=_SETS_ARROW)

    return make


_COUNTED = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("df", pa.binary()), ("sizes", pa.binary()), ("keys", pa.binary()), ("sets", pa.binary())])


def _count(t: pa.Table) -> pa.Table:
    """Of one bucket: for each batch the number of sets that hold its shingles, in the order sent."""
    rows, packs = [], []
    for r in t.to_pylist():
        if r["sets"] is not None:
            rows.append({k: r[k] for k in ("batch", "sizes", "keys", "sets")})
        else:
            packs.append((r["batch"], r["bucket"], np.frombuffer(r["tok"], np.uint32), np.frombuffer(r["cnt"], np.uint32)))
    if packs:
        tok = np.concatenate([p[2] for p in packs])
        order = np.argsort(tok, kind="stable")
        tok = tok[order]
        first = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
        sums = np.add.reduceat(np.concatenate([p[3] for p in packs])[order], first)
        total = np.empty(len(tok), np.uint32)
        total[order] = np.repeat(sums, np.diff(np.append(first, len(tok)))).astype(np.uint32)
        del tok, order, first, sums
        start = 0
        for batch, bucket, tok, _ in packs:
            rows.append({"batch": batch, "bucket": bucket, "df": total[start : start + len(tok)].tobytes()})
            start += len(tok)
    return pa.Table.from_pylist(rows, schema=_COUNTED)


def _router(percent: int, buckets: int):
    def route(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        whole = next(r for r in rows if r["sets"] is not None)
        sizes = np.frombuffer(whole["sizes"], np.uint32).astype(np.int64)
        every = np.frombuffer(whole["sets"], np.uint64)
        tok, place = np.unique(every, return_inverse=True)
        bucket, _ = _bucketed(tok, buckets)
        order = np.argsort(bucket, kind="stable")
        df = np.empty(len(tok), np.uint32)
        parts = {r["bucket"]: r["df"] for r in rows if r["df"] is not None}
        df[order] = np.concatenate([np.frombuffer(parts[b], np.uint32) for b in sorted(parts)])
        keys, out, start = whole["keys"], [], 0
        for i, n in enumerate(sizes):
            s, d = every[start : start + n], df[place[start : start + n]]
            start += n
            lone = int((d == 1).sum())
            first = np.lexsort((s, d))[lone : n - int(_need(n, percent)) + 1]
            homes = max(0, int(n - _need_of_equal(n, percent)) + 1 - lone)
            out.append({"key": keys[16 * i : 16 * i + 16], "n": int(n), "c": int(n) - lone, "toks": s.tobytes(), "regions": s[first].view(np.int64).tolist(), "splits": (-(-d[first].astype(np.int64) // _HOT)).tolist(), "homes": min(homes, len(first))})
        return pa.Table.from_pylist(out, schema=pa.schema([("key", pa.binary()), ("n", pa.int32()), ("c", pa.int32()), ("toks", pa.binary()), ("regions", pa.list_(pa.int64())), ("splits", pa.list_(pa.int32())), ("homes", pa.int32())]))

    return route


def regions(texts: DataFrame, percent: int, k: int, buckets: int) -> DataFrame:
    """(key, n, c, toks, regions, splits, homes) for each text.

    c: shingles that other sets have too; regions: the shingle pivots whose regions the set reaches, nearest first, the
    first ``homes`` of them being those where it also meets larger sets; splits: over how many tasks each region is spread.
    """
    packs = texts.select("text").mapInArrow(_set_maker(k, buckets), _SETS)
    met = packs.groupBy("bucket").applyInArrow(_count, "batch long, bucket int, df binary, sizes binary, keys binary, sets binary")
    return met.groupBy("batch").applyInArrow(_router(percent, buckets), "key binary, n int, c int, toks binary, regions array<long>, splits array<int>, homes int")


def _for_each_split(of_regions: DataFrame) -> DataFrame:
    """Rows of regions, one for each task over which the region's members are spread."""
    return of_regions.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("splits") - 1))).drop("splits")


# --- step 3: document pivots inside regions -------------------------------------------------------------


def _overlaps(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        out = []
        for x, y in zip(b.column("ta").to_pylist(), b.column("tb").to_pylist(), strict=True):
            out.append(len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), b.column("na"), b.column("nb"), pa.array(out, pa.int32())], ["a", "b", "na", "nb", "common"])


def _measure(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, d, linked) for pairs (a, b) of set keys."""
    left = sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("toks").alias("ta"))
    right = sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("toks").alias("tb"))
    common = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ta", "tb").mapInArrow(
        _overlaps, "a binary, b binary, na int, nb int, common int"
    )
    union = F.col("na") + F.col("nb") - F.col("common")
    return common.select("a", "b", (1 - F.col("common") / union).alias("d"), (100 * F.col("common") >= percent * union).alias("linked"))


def _may_link(percent: int) -> str:
    """Two members of a region (n, c, home, at; m, e, far, to) can link and this region has to find it.

    The smaller must be at home here. Of shingles before the pivot and behind it both can share at most the fewer, and
    in all no more than either has in common with any set.
    """
    home = "case when n < m then home when m < n then far else home or far end"
    shared = "least(1 + least(at, to) + least(n - at, m - to) - 1, c, e)"
    return f"100 * least(n, m) >= {percent} * greatest(n, m) and {home} and {100 + percent} * {shared} >= {percent} * (n + m)"


def _in_fixed_order(texts: DataFrame) -> DataFrame:
    """Distinct (doc_id, text), in each partition in the same order however they arrive."""
    return texts.dropDuplicates(["doc_id", "text"]).sortWithinPartitions("doc_id", "text")


def jaccard_join(docs: DataFrame, percent: int = 75, k: int = 5, rounds: int = 2, scratch: Scratch | None = None, every: bool = False, unnamed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Join documents (doc_id, text) with themselves on Jaccard similarity of at least ``percent`` / 100.

    Returns (members, links). members has a row for each row of documents: doc_id, n_shingles, text_hash (Spark's xxhash64), key (the set's
    128-bit hash, null for an empty set), component (smallest key reachable). links has (a, b, d): pairs of set
    keys proven within the distance, enough of them that their components are those of all links. A null or
    wordless text is an empty set and links with nothing; a row without doc_id is reported and links with
    nothing; repeated rows are copies of each other. Columns other than doc_id and text are ignored.

    With ``every``, all pairs of distinct sets that can link are compared, and members also has n_links: the other rows
    with a doc_id that the row links with, copies included. ``rounds`` doesn't matter then. With ``unnamed``, a row without doc_id has
    the component of rows with the same set.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = buckets_for(docs)
    members = scratch.keep(sketch(docs, percent, k, buckets), "members")
    named = members.where("maybe").groupBy("key").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    texts = _in_fixed_order(docs.join(named.hint("shuffle_hash"), "doc_id", "left_semi"))
    sets = scratch.keep(regions(texts, percent, k, buckets).dropDuplicates(["key"]), "sets")

    entries = sets.select("key", "n", "c", "homes", F.posexplode(F.arrays_zip("regions", "splits")).alias("i", "r"))
    entries = entries.select(
        F.col("r.regions").alias("region"), F.pmod(F.xxhash64("key", F.lit("salt")), F.col("r.splits")).cast("int").alias("salt"), F.col("r.splits").alias("splits"),
        "key", "n", "c", (F.col("i") < F.col("homes")).alias("home"), (F.col("n") - F.col("c") + F.col("i")).alias("at"),
    )
    linking = "case when n_shingles > 0 and doc_id is not null then key end"
    if every:
        copies = scratch.keep(members.groupBy(F.expr(linking).alias("key")).agg(F.count(F.lit(1)).alias("copies")).where("key is not null"), "copies")
        found = scratch.keep(count_links(entries, sets.select("key", "toks").join(copies, "key"), percent), "every")
        links = found.where("b is not null").select("a", "b", "d")
        comp = scratch.keep(components(links, scratch, "every"), "comp-every")
        counts = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n_links").alias("others"))
        about = copies.join(comp.toDF("key", "component"), "key", "left").join(counts, "key", "left")
        scratch.drop("sets")
        out = members.withColumn("key", F.expr(linking)).join(about, "key", "left")
        return out.select("doc_id", "n_shingles", "text_hash", "key", F.coalesce("component", "key").alias("component"), F.expr("coalesce(copies - 1, 0L) + coalesce(others, 0L)").alias("n_links")), links
    member = ["key", "n", "c", "home", "at"]
    links = None
    for i in range(rounds):
        salted = [F.min(F.struct(F.xxhash64("key", F.lit(j)).alias("h"), *member)).alias(f"p{j}") for j in range(_PIVOTS if i else 1)]
        pivots = entries.groupBy("region").agg(F.count(F.lit(1)).alias("members"), F.bool_or("home").alias("used"), F.max("splits").alias("splits"), *salted).where("members > 1 and used")
        each = F.array_distinct(F.array(*[F.struct(F.col(f"p{j}.key").alias("pivot"), F.col(f"p{j}.n").alias("m"), F.col(f"p{j}.c").alias("e"), F.col(f"p{j}.home").alias("far"), F.col(f"p{j}.at").alias("to")) for j in range(len(salted))]))
        pivots = scratch.keep(pivots.select("region", "splits", F.explode(each).alias("p")).select("region", "splits", "p.*"), f"pivots{i}")
        met = entries.drop("splits").join(_for_each_split(pivots), ["region", "salt"]).where(f"key != pivot and {_may_link(percent)}")
        pairs = met.select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b")).distinct()
        found = scratch.keep(_measure(pairs, sets, percent), f"found{i}")
        new = found.where("linked").select("a", "b", "d")
        links = new if links is None else links.union(new)
        comp = scratch.keep(components(links, scratch, f"split{i}"), f"comp{i}")
        entries = scratch.keep(_unsettled(entries.select("region", "salt", "splits", *member), pivots, found, comp, percent), f"entries{i}")
        if entries.isEmpty():
            break
        # only these meet again
        sets = scratch.keep(sets.join(entries.select("key").distinct(), "key", "left_semi"), f"sets{i}")
    else:
        new = scratch.keep(_settle(entries, sets, percent), "rest")
        links = links.union(new)
        comp = scratch.keep(components(links, scratch, "rest"), "comp-rest")
    scratch.drop(*[x for x in scratch.paths if x.startswith(("entries", "pivots", "sets", "split"))])
    members = members.withColumn("key", F.expr("case when n_shingles > 0 then key end" if unnamed else linking))
    out = members.join(comp.toDF("key", "component"), "key", "left")
    return out.select("doc_id", "n_shingles", "text_hash", "key", F.coalesce("component", "key").alias("component")), links


def _unsettled(entries: DataFrame, pivots: DataFrame, found: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Members of regions that may still hold a link between components.

    A member of a pivot's component goes on only if an outsider is so near the pivot that the triangle inequality leaves
    the two within reach of each other; an outsider that wasn't measured may be at any distance. A region in
    which nothing is at home any more has nothing to find.
    """
    reach = 1 - percent / 100 + 1e-9
    at_split = ["region", "salt"]
    labelled = entries.join(comp.toDF("key", "comp"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    open_ = labelled.groupBy("region").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("splits").alias("splits")).where("lo != hi").select("region", "splits")
    labelled = labelled.join(_for_each_split(open_), at_split, "left_semi").join(pivots.select("region", F.col("pivot").alias("key"), F.lit(True).alias("is_pivot")), ["region", "key"], "left").where("is_pivot is null")
    one = pivots.groupBy("region").agg(F.min("pivot").alias("pivot"), F.max("splits").alias("splits")).join(comp.toDF("pivot", "pcomp"), "pivot", "left").withColumn("pcomp", F.coalesce("pcomp", "pivot"))
    at = labelled.join(_for_each_split(one), at_split).withColumn("a", F.least("key", "pivot")).withColumn("b", F.greatest("key", "pivot"))
    at = at.join(found.select("a", "b", "d"), ["a", "b"], "left")
    outer = at.where("comp != pcomp").groupBy("region").agg(F.min(F.coalesce("d", F.lit(0.0))).alias("nearest"), F.max("splits").alias("splits"))
    left = at.join(_for_each_split(outer), at_split).where(f"comp != pcomp or d is null or d >= nearest - {reach}")
    left = left.select("region", "salt", "splits", "key", "n", "c", "home", "at", "comp")
    useful = left.groupBy("region").agg(F.bool_or("home").alias("used"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("splits").alias("splits")).where("used and lo != hi").select("region", "splits")
    return left.join(_for_each_split(useful), at_split, "left_semi")


# --- step 4: cells of document pivots, in blocks ----------------------------------------------------------

_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("d", pa.float64())])
#: Sets of a block, and shingles in them, at most (on average); columns of a dense product.
_BLOCK, _BLOCK_SHINGLES, _COLUMNS = 512, 1_000_000, 4096
#: Pairs of entries counted at once: each takes about 60 bytes for a moment.
_PAIRS = 500_000


def _common(own: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """n x n counts of common shingles, from each shingle's set and number."""
    counts = np.bincount(place)
    keep = counts[place] > 1
    own, place = own[keep], np.unique(place[keep], return_inverse=True)[1]
    order = np.argsort(place, kind="stable")
    own, place = own[order], place[order]
    width = int(place[-1]) + 1 if len(place) else 0
    out = np.zeros((n, n), np.float32)
    size = np.bincount(place, minlength=width)
    if (size.astype(np.int64) ** 2).sum() * 100 < n * n * width:  # few sets share a shingle: count pairs of entries
        start = np.cumsum(size) - size
        step = max(1, len(own) * _PAIRS // max(1, int((size.astype(np.int64) ** 2).sum())))
        flat = out.reshape(-1)
        for at in range(0, len(own), step):
            part = place[at : at + step]
            times = size[part]
            first = np.repeat(start[part] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
            flat += np.bincount(np.repeat(own[at : at + step].astype(np.int64), times) * n + own[first], minlength=n * n).astype(np.float32)
        return out
    cuts = np.searchsorted(place, np.arange(0, width + _COLUMNS, _COLUMNS))
    for at, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        x = np.zeros((n, _COLUMNS), np.float32)
        x[own[i:j], place[i:j] - at * _COLUMNS] = 1
        out += x @ x.T
    return out


def _compare(percent: int):
    """Links between components among the sets of two blocks; as many as connect what they link."""

    def compare(t: pa.Table) -> pa.Table:
        keys, comps, sides = t.column("key").to_pylist(), t.column("comp").to_pylist(), np.array(t.column("block").to_pylist())
        sets = [np.frombuffer(x, np.uint64) for x in t.column("toks").to_pylist()]
        n = np.array([len(s) for s in sets])
        common = _common(np.repeat(np.arange(len(sets)), n), np.unique(np.concatenate(sets), return_inverse=True)[1], len(sets))
        number = {c: i for i, c in enumerate(dict.fromkeys(comps))}
        own = np.array([number[c] for c in comps])
        union = n[:, None] + n[None, :] - common
        hit = (100 * common >= percent * union) & (own[:, None] < own[None, :])
        if sides.min() != sides.max():
            hit &= sides[:, None] != sides[None, :]
        parent = list(range(len(number)))
        rows = []
        for x, y in np.argwhere(hit).tolist():
            a, b = own[x], own[y]
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            if a != b:
                parent[max(a, b)] = min(a, b)
                rows.append({"a": min(keys[x], keys[y]), "b": max(keys[x], keys[y]), "d": float(1 - common[x, y] / union[x, y])})
        return pa.Table.from_pylist(rows, schema=_LINKS)

    return compare


def _settle(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, d): the links between components that are left.

    Regions of much the same members (a group of near copies has one for each common shingle) share their member of
    smallest hash, mostly; those that do are one cell of that document pivot. A cell is cut into blocks, and each pair of blocks is compared in one task.
    """
    pivot = entries.groupBy("region").agg(F.min(F.struct(F.xxhash64("key"), "key")).alias("p"), F.max("splits").alias("splits")).select("region", "splits", F.col("p.key").alias("cell"))
    inside = entries.join(_for_each_split(pivot), ["region", "salt"]).groupBy("cell", "key").agg(F.first("n").alias("n"), F.first("comp").alias("comp"))
    size = inside.groupBy("cell").agg(F.greatest(F.ceil(F.count(F.lit(1)) / _BLOCK), F.ceil(F.sum("n") / _BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = inside.join(size, "cell").withColumn("block", F.pmod(F.xxhash64("key", F.lit("block")), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y")))
    sent = placed.join(sets.select("key", "toks"), "key").withColumn("to", F.explode(others))
    dealt = sent.select("cell", "to.x", "to.y", "key", "comp", "block", "toks")
    return dealt.groupBy("cell", "x", "y").applyInArrow(_compare(percent), "a binary, b binary, d double").dropDuplicates(["a", "b"])


_EVERY = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("d", pa.float64()), ("n_links", pa.int64())])


def _forest(hit: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that connect what the symmetric matrix connects."""
    seen, out = np.zeros(len(hit), bool), []
    for start in np.flatnonzero(hit.any(axis=1)).tolist():
        stack = [] if seen[start] else [start]
        seen[start] = True
        while stack:
            x = stack.pop()
            new = np.flatnonzero(hit[x] & ~seen).tolist()
            seen[new] = True
            out += [(x, y) for y in new]
            stack += new
    return out


def _compare_all(percent: int):
    """Of the sets of two blocks: each one's number of linked rows, and links (a, b, d) that connect what is linked."""

    def compare(t: pa.Table) -> pa.Table:
        keys, sides, copies = t.column("key").to_pylist(), t.column("block").to_numpy(), t.column("copies").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("toks").to_pylist()]
        n = np.array([len(s) for s in sets])
        each = np.arange(len(sets))
        common = _common(np.repeat(each, n), np.unique(np.concatenate(sets), return_inverse=True)[1], len(sets)).astype(np.int64)
        union = n[:, None] + n[None, :] - common
        hit = 100 * common >= percent * union
        np.fill_diagonal(hit, False)
        if sides.min() != sides.max():
            hit &= sides[:, None] != sides[None, :]
        rows = []
        if hit.any():
            before = t.column("earlier").combine_chunks()
            lengths, cells = pc.list_value_length(before).to_numpy(), before.flatten().to_numpy()
            if len(cells):  # what meets in an earlier cell is counted there
                hit &= _common(np.repeat(each, lengths), np.unique(cells, return_inverse=True)[1], len(sets)) == 0
            counts = (hit @ copies.astype(np.float64)).astype(np.int64)
            rows += [{"a": keys[x], "n_links": int(counts[x])} for x in np.flatnonzero(counts).tolist()]
            rows += [{"a": min(keys[x], keys[y]), "b": max(keys[x], keys[y]), "d": float(1 - common[x, y] / union[x, y])} for x, y in _forest(hit)]
        return pa.Table.from_pylist(rows, schema=_EVERY)

    return compare


def count_links(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Every pair of sets (key, toks, copies) that meets in a region, compared once: rows (a, n_links), parts of a set's number
    of linked rows, and (a, b, d), links that connect what is linked.

    Regions whose member of smallest hash is the same are one cell, cut into blocks as in ``_settle``. A set brings the
    cells before this one along: a pair that also meets in one of them is counted there.
    """
    region = entries.groupBy("region").agg(F.min(F.xxhash64("key")).alias("cell"), F.count(F.lit(1)).alias("members"), F.bool_or("home").alias("used"), F.max("splits").alias("splits"))
    inside = entries.join(_for_each_split(region.where("members > 1 and used").select("region", "splits", "cell")), ["region", "salt"]).groupBy("cell", "key").agg(F.first("n").alias("n"))
    size = inside.groupBy("cell").agg(F.greatest(F.ceil(F.count(F.lit(1)) / _BLOCK), F.ceil(F.sum("n") / _BLOCK_SHINGLES)).cast("int").alias("blocks"))
    # a set has at most as many cells as it has regions, which its own length bounds
    cells = inside.select("cell", "key").join(size, "cell").groupBy("key").agg(F.collect_list(F.struct("cell", "blocks")).alias("cells"))
    placed = sets.join(cells, "key").select("key", "toks", "copies", F.col("cells.cell").alias("all"), F.explode("cells").alias("c")).select("key", "toks", "copies", "all", "c.*")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("key", F.lit("block")), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y")))
    sent = placed.withColumn("to", F.explode(others)).withColumn("earlier", F.filter("all", lambda c: c < F.col("cell")))
    dealt = sent.select("cell", "to.x", "to.y", "key", "copies", "block", "earlier", "toks")
    return dealt.groupBy("cell", "x", "y").applyInArrow(_compare_all(percent), "a binary, b binary, d double, n_links long")


def _named(members: DataFrame, scratch: Scratch, *more: str) -> DataFrame:
    """Components by their smallest doc_id, without the scratch tables."""
    members = scratch.keep(members, "labelled")
    scratch.drop(*[x for x in scratch.paths if x != "labelled"])
    lowest = members.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return members.join(lowest, "component", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *more)


def near_duplicates(docs: DataFrame, percent: int = 75, k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row; component_id is the smallest doc_id reachable by links.

    A null or wordless text is an empty set and links with nothing; a row without doc_id is reported without component and links with
    nothing; repeated rows are copies of each other; a text of any length is read whole; ties can't arise, as components are sets.
    Columns other than doc_id and text are ignored, and an empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    members, _ = jaccard_join(docs, percent, k, scratch=scratch)
    return _named(members, scratch)


def counted_duplicates(docs: DataFrame, percent: int = 75, k: int = 5) -> DataFrame:
    """As ``near_duplicates``, with n_links: the other rows that a row links with itself, 0 for a row without doc_id or words."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    members, _ = jaccard_join(docs, percent, k, scratch=scratch, every=True)
    return _named(members, scratch, "n_links")


def one_of_each(docs: DataFrame, percent: int = 75, k: int = 5) -> DataFrame:
    """One row of each component, with its columns: that of the smallest doc_id, rows without one last, ties by a hash of the text.

    Rows without words stay. A row without doc_id goes with the rows of the same set; it isn't linked with others. Of rows that
    repeat a doc_id each is judged by its own text; of equal ones one stays.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    members, _ = jaccard_join(docs, percent, k, scratch=scratch, unnamed=True)
    members = scratch.keep(members.where("component is not null").select("component", F.col("doc_id").alias("id"), "text_hash"), "labelled")
    scratch.drop(*[x for x in scratch.paths if x != "labelled"])
    first = members.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "text_hash")).alias("f"))
    row = F.struct("id", "text_hash").alias("row")
    stays = scratch.keep(first.select(F.col("f.id").alias("id"), F.col("f.text_hash").alias("text_hash")), "stays")
    each = members.groupBy("id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    chosen = each.join(stays.select(row, F.lit(True).alias("stays")), F.struct("id", "text_hash") == F.col("row"), "left").select("id", "text_hash", "n", F.coalesce("stays", F.lit(False)).alias("stays"))
    judged = scratch.keep(chosen.where("not stays or n > 1"), "judged")
    scratch.drop("labelled", "stays")
    spare = "component"
    while any(spare in c for c in docs.columns):
        spare += "_"
    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(*names, F.col("doc_id").cast("long").alias(f"{spare}_id"), F.xxhash64("text").alias(f"{spare}_hash"))

    def same(t: DataFrame):
        # an id may be null on both sides; ids spread null rows and equal texts
        return F.col(f"{spare}_id").eqNullSafe(t["id"]) & (F.col(f"{spare}_hash") == t["text_hash"])

    gone = judged.where("not stays")
    kept = keyed.join(gone, same(gone), "left_anti")
    twice = judged.where("stays").select("id", "text_hash")
    if not twice.isEmpty():
        once = kept.join(twice, same(twice), "left_semi").dropDuplicates([f"{spare}_id", f"{spare}_hash"])
        kept = kept.join(twice, same(twice), "left_anti").unionByName(once)
    return kept.select(*names)
