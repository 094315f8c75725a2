"""Near-duplicate detection: MinHash with banding, exact confirmation, large-star / small-star components.

Steps, all distributed:

1. ``signatures``: one pass over the texts; per row the number of distinct 5-word shingles, a
   128-bit digest of the shingle set, ``hashes`` universal-hash minima and one key per band.
2. Rows with the same digest have the same set.  They form a class; only the class's smallest id
   goes on, so a thousand copies cost one row (the grouping combines on the map side).
3. Banding: representatives that share a band key meet in a bucket.  A bucket of m members gives
   2 (m - 1) pairs, each member with the smallest and the largest id, never all pairs.
4. Pairs are checked against the signatures (a loose bound, about five standard errors), then
   confirmed on the full shingle sets.  A hub's signature or set goes to each of its groups of
   partners once and not to each partner, and a hub's partners are dealt to many groups.
5. Components of the confirmed links by alternating large-star and small-star, until they settle.
6. Buckets whose members still lie in several components: those with the same members are compared
   once, whatever the number of bands that made them.  The members of a bucket's largest component
   need no comparison with each other; all others meet them, and each other, in bounded groups
   of blocks, which compare full sets by matrix products and return links between components only.
   So no link that the banding found is lost, and no row is made per pair of members.

Keys that many rows share (band keys, hubs of links, classes of copies) are joined apart: there are
few of them by counting, so their facts are broadcast and their rows stay where they are
(``common.join_by_key``).

With 24 bands of 4 minima a pair of similarity 0.85 meets with probability 1 - 2e-8, one of 0.8
with 1 - 3e-6.

Defined cases: a text without words, or null, has an empty set and is linked with nothing, not
even with other empty texts; fewer than five words are one shingle; very long texts count whole; a
tie in size goes to the smaller id; rows that repeat an id are one vertex; rows without an id are
grouped by equal sets only and take their class's id (null if no member has one).  ``kept`` compares
null-safely, so a null id without a named copy stays.  An empty table gives no rows.  Only doc_id
and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import discard, materialise
from .common import buffers, hash_words, join_by_key, measured, mix, ngram_hashes, table

SHINGLE = 5
BANDS, ROWS = 24, 4
THRESHOLD = 85
#: Members and shingles of one block of a bucket, about.
BLOCK_DOCS, BLOCK_SHINGLES = 384, 1_000_000
#: Ids that may be broadcast to pick candidate texts (8 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 2_000_000
#: Partners of a hub that one group has, about.
GROUP_DOCS = 64

_rng = np.random.Generator(np.random.PCG64(421))
_A = _rng.integers(0, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, 1024, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text in a UTF-8 buffer."""
    words, first = hash_words(data, offsets)
    grams = ngram_hashes(words, width)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        else:
            out.append(ngram_hashes(words[a:b], int(b - a)) if b > a else words[:0])
    return out


def minima(shingles: np.ndarray, hashes: int) -> np.ndarray:
    """The smallest value of each hash function a x + b (mod 2^64) over the set."""
    best = np.full(hashes, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(best, (shingles[at : at + 512, None] * _A[:hashes] + _B[:hashes]).min(axis=0), out=best)
    return best


def signatures(docs: DataFrame, width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, digest (d1, d2), sig (16 bits of each minimum) and the band keys of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = mix(np.arange(1, rows + 1, dtype=np.uint64))
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(20))
        for batch in batches:
            for first, data, offsets in buffers(batch.column(1)):
                count, d1, d2, sig, keys = [], [], [], [], []
                for s in shingle_sets(data, offsets, width):
                    count.append(len(s))
                    d1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                    d2.append(int(mix(s ^ np.uint64(0x5555)).sum(dtype=np.uint64).view(np.int64)))
                    if len(s):
                        m = minima(s, bands * rows)
                        sig.append((m >> np.uint64(30)).astype(np.uint16).tobytes())
                        keys.append(mix((m.reshape(bands, rows) * scale).sum(axis=1, dtype=np.uint64) + salt).view(np.int64))
                    else:
                        sig.append(None)
                        keys.append(None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(count)).cast(pa.int64()), pa.array(count, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "d1", "d2", "sig", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, sig binary, bands array<long>")


_PAIR = "hub long, doc long"


def _fitting(group: tuple | None, hubs: list[tuple], docs: list[tuple], fits: Callable[[tuple, list[tuple]], list[bool]]) -> list[tuple[int, int]]:
    """(hub, doc) of the docs that fit any row of the hub."""
    by_hub = [fits(h, docs) for h in hubs] if docs else []
    return [(group[0], d[0]) for d, ok in zip(docs, map(any, zip(*by_hub, strict=True)), strict=True) if ok] if by_hub else []


def _meet(pairs: DataFrame, n: int, facts: DataFrame, fits: Callable[[tuple, list[tuple]], list[bool]]) -> DataFrame:
    """The pairs (hub, doc), n of them, that fit, by what ``facts`` (doc_id, n, body) knows of both.

    A hub's partners are dealt to groups by hash, to as many as their number asks for.  Rows of a group are sorted, the hub's first, and
    streamed, so a group may have any number of partners.
    """
    partners = pairs.groupBy("hub").agg(F.count("*").alias("m"))
    salt = F.pmod(F.xxhash64("doc"), F.ceil(F.col("m") / GROUP_DOCS)).cast("int")
    salted = join_by_key(pairs, partners, ["hub"], n).select("hub", "doc", salt.alias("salt"))
    hubs = salted.select("hub", "salt").distinct().withColumn("doc", F.lit(None).cast("long"))
    both = hubs.join(facts.withColumnRenamed("doc_id", "hub"), "hub").select("hub", "salt", "doc", "n", "body")
    both = both.unionByName(salted.join(facts.withColumnRenamed("doc_id", "doc"), "doc").select("hub", "salt", "doc", "n", "body"))
    dealt = both.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "hub", "salt").sortWithinPartitions("hub", "salt", F.col("doc").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, hubs = None, []  # the group at hand, and what is known of its hub: one row, more if rows repeat its id
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                found: list[tuple[int, int]] = []
                held: list[tuple] = []
                for hub, salt, doc, n, body in zip(*(batch.column(i).slice(k, 256).to_pylist() for i in range(5)), strict=True):
                    if (hub, salt) != group:
                        found += _fitting(group, hubs, held, fits)
                        group, hubs, held = (hub, salt), [], []
                    if doc is None:
                        hubs.append((n, body))
                    else:
                        held.append((doc, n, body))
                found += _fitting(group, hubs, held, fits)
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["hub", "doc"])

    return dealt.mapInArrow(run, _PAIR)


def _likely(pairs: DataFrame, n: int, reps: DataFrame, threshold: int, hashes: int) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose signatures agree about enough."""
    share = threshold / 100
    least = share - 5 * (share * (1 - share) / hashes) ** 0.5

    def fits(hub: tuple, docs: list[tuple]) -> list[bool]:
        own = np.frombuffer(hub[1], np.uint16)
        same = (np.frombuffer(b"".join(d[2] for d in docs), np.uint16).reshape(-1, hashes) == own).mean(axis=1)
        return [100 * min(hub[0], d[1]) >= threshold * max(hub[0], d[1]) and a >= least for d, a in zip(docs, same.tolist(), strict=True)]

    return _meet(pairs, n, reps.select("doc_id", F.col("n_shingles").alias("n"), F.col("sig").alias("body")), fits)


def _confirm(pairs: DataFrame, n: int, docs: DataFrame, threshold: int, width: int, scratch: list[DataFrame]) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold."""
    ids = pairs.select(F.col("hub").alias("doc_id")).union(pairs.select("doc")).distinct()
    sets = materialise(_sets(docs, ids, width, scratch), "near-sets")
    scratch.append(sets)

    def fits(hub: tuple, found: list[tuple]) -> list[bool]:
        own, out = np.frombuffer(hub[1], np.uint64), []
        for _, n, body in found:
            both = len(np.intersect1d(own, np.frombuffer(body, np.uint64), assume_unique=True))
            out.append(100 * both >= threshold * (hub[0] + n - both))
        return out

    return _meet(pairs, n, sets, fits)


def _sets(docs: DataFrame, ids: DataFrame, width: int, scratch: list[DataFrame]) -> DataFrame:
    """(doc_id, n, body) of the texts of some ids: the size of the set, and its sorted 64-bit shingle hashes."""
    wanted, size = measured(ids, "near-ids")
    side = F.broadcast(wanted) if size.n <= BROADCAST_IDS else wanted
    scratch.append(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in buffers(batch.column(1)):
                sets = shingle_sets(data, offsets, width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "n", "body"])

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(side, "doc_id", "left_semi").mapInArrow(run, "doc_id long, n long, body binary")
    return made.dropDuplicates()  # rows that repeat an id


def linked(sets: list[np.ndarray], owner: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links between different owners (components) among some sets, as a spanning forest of the owners."""
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    who = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(every, kind="stable")
    every, who = every[order], who[order]
    same = every[1:] == every[:-1]
    shared = np.r_[False, same] | np.r_[same, False]
    column = np.cumsum(np.r_[True, ~same])[shared]
    who = who[shared]
    both = np.zeros((len(sets), len(sets)), np.float32)
    if len(column):
        column = np.unique(column, return_inverse=True)[1]
        edges = np.searchsorted(column, np.arange(0, column[-1] + 4097, 4096))
        for a, b in zip(edges[:-1], edges[1:], strict=True):  # products of 0-1 matrices, 4096 shingles at a time
            has = np.zeros((len(sets), 4096), np.float32)
            has[who[a:b], column[a:b] % 4096] = 1
            both += has @ has.T
    hit = 100 * both >= threshold * (sizes[:, None] + sizes[None, :] - both)
    x, y = np.nonzero(np.triu(hit & (owner[:, None] != owner[None, :]), 1))
    root: dict[int, int] = {}

    def top(v: int) -> int:
        while (up := root.get(v, v)) != v:
            v = up
        return v

    out = []
    for a, b in set(zip(owner[x].tolist(), owner[y].tolist(), strict=True)):
        r, q = sorted((top(a), top(b)))
        if r != q:
            root[q] = r
            out.append((a, b))
    return out


def _across(left: DataFrame, docs: DataFrame, threshold: int, width: int, scratch: list[DataFrame]) -> DataFrame:
    """Links between components that share buckets, from full sets; (x, y) are component ids.

    left: (key, doc_id, c, main, mains, others): ``main`` marks members of the bucket's largest
    component, which are dealt to ``mains`` blocks by hash, and the others to ``others``.  Every
    block of others meets each block of the main ones, and each of its own kind, in a bounded group
    (at most about twice BLOCK_DOCS members); no pair of members becomes a row.
    """
    sets = _sets(docs, left.select("doc_id").distinct(), width, scratch).select("doc_id", F.col("body").alias("set"))
    n = F.col("others")
    block = F.pmod(F.xxhash64("doc_id"), F.when(F.col("main"), F.col("mains")).otherwise(n)).cast("int")
    spread = lambda x, m: F.transform(F.sequence(F.lit(0), m - 1), x)
    group = lambda i, j, kind: F.struct(i.alias("i"), j.alias("j"), F.lit(kind).alias("kind"))
    own = F.col("block")
    with_others = spread(lambda j: group(own, j, 0), n)
    with_main = spread(lambda i: group(i, own, 0), F.col("mains"))
    with_own_kind = F.when(n > 1, spread(lambda j: group(F.least(own, j), F.greatest(own, j), 1), n))  # one block has met itself beside the main ones
    to = F.when(F.col("main"), with_others).otherwise(F.flatten(F.array_compact(F.array(with_main, with_own_kind))))
    dealt = left.withColumn("block", block).select("key", "doc_id", "c", F.explode(to).alias("g")).select("key", "doc_id", "c", "g.*")

    def run(group: pa.Table) -> pa.Table:
        some = [np.frombuffer(b, np.uint64) for b in group.column("set").to_pylist()]
        found = linked(some, group.column("c").to_numpy(), threshold)
        return pa.table({"x": pa.array([f[0] for f in found], pa.int64()), "y": pa.array([f[1] for f in found], pa.int64())})

    return dealt.join(sets, "doc_id").select("key", "i", "j", "kind", "c", "set").groupBy("key", "i", "j", "kind").applyInArrow(run, "x long, y long").distinct()


def _open_buckets(buckets: DataFrame, found: DataFrame, rows: int) -> DataFrame:
    """(key, doc_id, c, main, mains, others) of the buckets whose members lie in several components, one of each list of members."""
    named = buckets.where("m > 3").select("key", "doc_id", "n_shingles", "m").join(found, "doc_id", "left")  # three members have met already
    named = named.withColumn("c", F.coalesce("component_id", "doc_id")).drop("component_id")
    blocks = lambda d, n: F.greatest(F.ceil(F.col(d) / BLOCK_DOCS), F.ceil(F.col(n) / BLOCK_SHINGLES)).cast("int")
    of_component = named.groupBy("key", "c").agg(F.count("*").alias("d"), F.sum("n_shingles").alias("s"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("h"))
    of_key = of_component.groupBy("key").agg(
        F.max(F.struct("d", F.negative("c").alias("low"), "s")).alias("top"), F.sum("d").alias("d"), F.sum("s").alias("s"), F.count("*").alias("cs"), F.sum("h").alias("h"),
    )
    mixed = of_key.where("cs > 1").groupBy("h", "d", "s").agg(F.min(F.struct("key", "top")).alias("k"))
    mixed = mixed.select("k.key", F.negative("k.top.low").alias("big"), F.col("k.top.d").alias("td"), F.col("k.top.s").alias("ts"), F.col("d").alias("m"), (F.col("d") - F.col("k.top.d")).alias("od"), (F.col("s") - F.col("k.top.s")).alias("os"))
    mixed = mixed.select("key", "big", "m", blocks("td", "ts").alias("mains"), blocks("od", "os").alias("others"))
    return join_by_key(named.drop("m"), mixed, ["key"], rows).select("key", "doc_id", "c", (F.col("c") == F.col("big")).alias("main"), "mains", "others")


def components(links: DataFrame) -> DataFrame:
    """(doc_id, component_id) of every end of a link, by alternating large-star and small-star.

    links: (x, y), any direction, repeats and loops allowed.  Each round groups neighbours by
    vertex only to take their minimum and number, which combines on the map side; rounds go on
    until nothing changes (a component of diameter d takes about log d of them).
    """
    check = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v")
    edges, now = measured(links.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "cc", *check)
    before = None
    while now != before:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w"), F.count("*").alias("m")).select("u", F.least("u", "w").alias("w"), "m")
        large = join_by_key(both.where("v > u"), least, ["u"], 2 * now.n).select(F.col("v").alias("u"), F.col("w").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("w"), F.count("*").alias("m"))
        small = join_by_key(large, low, ["u"], now.n).select(F.col("v").alias("u"), F.col("w").alias("v")).union(low.select("u", F.col("w").alias("v"))).where("u <> v").distinct()
        before, old = now, edges
        edges, now = measured(small, "cc", *check)
        discard(old)
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component_id"))


_SET = ["d1", "d2", "n_shingles"]


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    return _judged(docs, threshold, width, bands, rows)[0]


def _judged(docs: DataFrame, threshold: int, width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of ``near_duplicates``, and the scratch tables that they are read from."""
    seen, all_rows = measured(signatures(docs, width, bands, rows), "near-sigs")
    # members of a class have one set, so any member's signature is the class's
    classes = seen.where("n_shingles > 0").groupBy(*_SET).agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.count("*").alias("m"))
    classes, size = measured(classes, "near-classes")
    known = classes.where("rep is not null")
    reps = known.select(F.col("rep").alias("doc_id"), "n_shingles", "sig")
    keyed = known.select(F.col("rep").alias("doc_id"), "n_shingles", F.explode("bands").alias("key"))
    ends = keyed.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("m")).where("low <> high")
    ends = materialise(ends, "near-ends")
    buckets, met = measured(join_by_key(keyed, ends, ["key"], bands * size.n).select("key", "doc_id", "n_shingles", "low", "high", "m"), "near-buckets")
    # a pair in both directions, as every bucket of two members gives it, is tried once
    tried = buckets.select(F.explode(F.array("low", "high")).alias("hub"), F.col("doc_id").alias("doc")).where("hub <> doc")
    tried = tried.groupBy(F.least("hub", "doc").alias("a"), F.greatest("hub", "doc").alias("b")).agg(F.min("hub").alias("hub")).select("hub", F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("doc"))
    tried, pairs = measured(tried, "near-tried")
    likely, fit = measured(_likely(tried, pairs.n, reps, threshold, bands * rows), "near-likely")
    scratch = [ends, buckets, tried, likely]
    links = materialise(_confirm(likely, fit.n, docs, threshold, width, scratch), "near-links")
    found = materialise(components(links.toDF("x", "y")), "near-found")
    left, some = measured(_open_buckets(buckets, found, met.n), "near-open")
    scratch += [links, found, left]
    if some.n:
        more, some = measured(_across(left, docs, threshold, width, scratch), "near-more")
        scratch.append(more)
        if some.n:
            merged = components(more).toDF("c", "root")
            found = known.select(F.col("rep").alias("doc_id")).distinct().join(found, "doc_id", "left").withColumn("c", F.coalesce("component_id", "doc_id"))
            found = materialise(found.join(merged, "c", "left").select("doc_id", F.coalesce("root", "c").alias("component_id")), "near-merged")
    for old in scratch:
        if old is not found:
            discard(old)
    named = classes.join(found.withColumnRenamed("doc_id", "rep"), "rep", "left").select(*_SET, F.coalesce("component_id", "rep").alias("component_id"), "m")
    out = seen.select("doc_id", *_SET)
    out = join_by_key(out.where("n_shingles > 0"), named, _SET, all_rows.n).select("doc_id", "n_shingles", "component_id")
    out = out.union(seen.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), [seen, classes, found]


def deduplicate(docs: DataFrame, threshold: int = THRESHOLD, apart: bool = True) -> DataFrame:
    """One row of each group of near-duplicates stays, with all its columns: the row of the smallest id.

    Rows are judged one by one, by a key of their own: rows that repeat an id are linked by their
    texts only, and rows without an id are linked like all others.  A row without an id comes last
    in its group; with ``apart`` the rows without an id of a group keep one row beside the named
    one, otherwise a group keeps one row in all.  Rows without words stay.
    """
    # written, so that a row has the same key in every later step
    keyed = materialise(docs.select("*", F.monotonically_increasing_id().alias("_key"), F.xxhash64("text").alias("_hash")), "near-keyed")
    judged, scratch = _judged(keyed.select(F.col("_key").alias("doc_id"), "text"), threshold)
    found = judged.select(F.col("doc_id").alias("_key"), "component_id")
    unnamed = F.col("doc_id").isNull()
    groups = found.join(keyed.select("_key", "_hash", "doc_id"), "_key").groupBy("component_id", unnamed if apart else F.lit(True))
    kept = groups.agg(F.min(F.struct(unnamed.alias("unnamed"), "doc_id", "_hash", "_key")).alias("m")).select("m._key")
    gone, some = measured(found.select("_key").join(kept, "_key", "left_anti"), "near-gone")
    for old in scratch:
        discard(old)
    return keyed.join(F.broadcast(gone) if some.n <= BROADCAST_IDS else gone, "_key", "left_anti").select(docs.columns)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by 5-word shingles at similarity 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op6_minhash": op6_minhash}
ORACLES: dict[str, str] = {}
