"""N-gram Jaccard join with Bayesian candidate pruning.

A document is the set of its 5-word shingles. Documents with equal sets are one class from the start, represented by
one of them. Bands of MinHash values propose pairs of representatives; a proposed pair's values are compared a few at a
time, and the pair is dropped as soon as the posterior probability that its similarity reaches the threshold falls
below the tolerance; the sets of the rest are compared exactly. Verified links make classes by connected components.

A bucket of a band with up to SMALL members proposes all its pairs. A larger one is split by set size (similar sets are
of similar size), loses the members whose unshared shingles rule out every link, and proposes pairs with its most
central member; members that it is not linked to stay for the next round, with eight times the pivots, until none is left or
few enough for all pairs: no more than SMALL in a bucket, or as many, up to BLOCK, as keep all such pairs together at
PAIRS a row of the large buckets at most. What that leaves out are links between a set x that a pivot p took and a set y that it did
not. Such a y is within twice the distance of p, and x and y share a shingle of what each does not share with p
(otherwise they differ by as much as y and p do, or more); where y is not in p's class anyhow, an index on those
differences proposes the pairs. So a bucket that holds a third of all rows costs a few pairs a row, no group is ever
collected, and nothing is capped. A link at the threshold is missed
by all bands with probability (1 - 0.8 ** 4) ** 32 = 5e-8, and by the pruning with the tolerance, 1e-6.

Defined results: words are separated by ASCII blanks; a text with fewer than five words is one shingle; a null or empty
text has none and is a class of its own; repeated rows are copies; class_id is the smallest doc_id of the class (null
if it has none), n_links the number of other documents with the same set or a similar one. Similar documents are in one
class, so n_links comes from comparing all sets of a class with each other, in pairs of blocks of about BLOCK sets; that
work alone grows with the square of a class's distinct sets, and leaving copies out does without it."""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch, map_rows, masked, pieces
from .shingles import shingle_set

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
HASHES, ROWS, STEP = 128, 4, 16
SMALL = 16
#: Pairs a row of the large buckets that a round may take from all pairs of the smallest of them.
PAIRS = 2
#: Bytes of texts and signatures that every executor gets whole, so that pairs meet their sets with no shuffle.
POOL_BYTES = 24 << 20
#: Rows of a few numbers that count as one of Scratch.keep's.
NARROW = 10
#: Pairs that a task compares, where it has all sets at hand.
TASK_PAIRS = 2000
#: Links whose components one task finds; more are connected by stars.
FEW_LINKS = 50_000
BITS = 1 << 22
#: Sets of a class that are compared as one block, and shingles that are compared at a time.
BLOCK, WIDE = 512, 4096
_rng = np.random.default_rng(20)
MULTIPLY = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of a set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        part = x[at : at + 1024]
        np.minimum(out, (part[None, :] * MULTIPLY[:, None] + ADD[:, None]).min(axis=1), out=out)
    return out


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After each number of compared values, the fewest matches with which the posterior of reaching the threshold, from
    a uniform prior, is not below the tolerance: P(J >= t | m of k) = P(Bin(k + 1, t) <= m)."""
    out = {}
    for k in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
        out[k] = m
    return out


def sketched(docs: DataFrame) -> DataFrame:
    """docs with _row, and of the text's set: _key (null without shingles), _n and _sig."""
    base = docs.withColumn("_row", F.monotonically_increasing_id())
    schema = T.StructType([*base.schema.fields, T.StructField("_key", T.BinaryType()), T.StructField("_n", T.IntegerType()), T.StructField("_sig", T.BinaryType())])
    at = base.columns.index("text")

    def run(batches):
        for b in pieces(batches):
            keys, ns, sigs = [], [], []
            for text in b.column(at).to_pylist():
                x = shingle_set(text, WORDS)
                ns.append(len(x))
                keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
                sigs.append(signature(x).tobytes() if len(x) else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary()), pa.array(ns, pa.int32()), pa.array(sigs, pa.binary())], names=schema.names)

    return base.mapInArrow(run, schema)


def bands(reps: DataFrame) -> DataFrame:
    """k, c, n: a row for each band of a representative's signature."""
    seeds = (np.arange(HASHES // ROWS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(b.num_rows, -1, ROWS).astype(np.uint64)
            h = np.broadcast_to(seeds, sig.shape[:2]).copy()
            for j in range(ROWS):
                h = (h ^ sig[:, :, j]) * np.uint64(0xFF51AFD7ED558CCD)
                h ^= h >> np.uint64(32)
            many = h.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.ravel().view(np.int64)), pa.array(np.repeat(b.column("c").to_numpy(), many)), pa.array(np.repeat(b.column("n").to_numpy(), many))], ["k", "c", "n"]
            )

    return reps.select("c", "n", "sig").mapInArrow(run, "k bigint, c bigint, n int")


def fits(x, y):
    """Sets of such sizes can reach the threshold."""
    return (F.least(x, y) >= THRESHOLD * F.greatest(x, y)) & (x > 0)


def all_pairs(members: DataFrame, most: int) -> DataFrame:
    """a, b of buckets that have at most `most` members."""
    cs = F.sort_array("cs")
    mates = members.groupBy("k").agg(F.collect_list(F.struct("c", "n")).alias("cs")).where((F.size("cs") > 1) & (F.size("cs") <= most)).select(cs.alias("cs"))
    made = F.flatten(F.transform("cs", lambda x, i: F.transform(F.filter(F.slice(F.col("cs"), i + 2, most), lambda y: fits(x["n"], y["n"])), lambda y: F.struct(x["c"].alias("a"), y["c"].alias("b")))))
    return mates.select(F.explode(made).alias("p")).select("p.a", "p.b")


def all_paired(members: DataFrame, most: int) -> tuple[int, int]:
    """Up to how many members a bucket proposes all its pairs, and how many these are: SMALL, and as many more, up to
    BLOCK, as make at most `most` pairs. members: left, the members of the row's bucket."""
    few, made, pairs = SMALL, 0, 0
    sizes = members.where(F.col("left") <= max(SMALL, BLOCK)).groupBy("left").agg(F.count(F.lit(1)).alias("n"))
    for left, n in sorted(map(tuple, sizes.collect())):
        made += n * (left - 1) // 2
        if left <= SMALL or made <= most:
            few, pairs = max(few, left), made
    return few, pairs


def large_members(cand: DataFrame, pool: DataFrame) -> DataFrame:
    """k, c, n, w, top of buckets over SMALL, split by set size: similar sets are in the same or in neighbouring
    classes. w is in how many large buckets a set is. top is the largest size
    of a set that can reach the threshold with this one: of its shingles, those that no other member has cannot be
    shared, and |x & y| / |x | y| >= 4 / 5 needs 9 |x & y| >= 4 (|x| + |y|)."""
    of = cand.where(F.col("m") > SMALL).select("k", "c", "n")
    central = of.groupBy("c").agg(F.count(F.lit(1)).alias("w"))

    def rows(batches):
        for b in batches:
            for c, t in zip(b["c"], b["text"], strict=True):
                for h in shingle_set(t, WORDS).view(np.int64).tolist():
                    yield h, c

    every = map_rows(pool.join(central, "c").select("c", "text"), "h bigint, c bigint", rows, 20_000)
    alone = every.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("c")).where("m = 1").groupBy("c").agg(F.count(F.lit(1)).alias("u"))
    known = central.join(alone, "c", "left").select("c", "w", F.coalesce("u", F.lit(0)).alias("u"))
    size = F.floor(F.log("n") / math.log(1 / THRESHOLD))
    top = F.floor((9 * (F.col("n") - F.col("u")) - 4 * F.col("n")) / 4)
    of = of.join(known, "c").select("k", "c", "n", "w", top.alias("top"), size.alias("own")).withColumn("size", F.explode(F.array("own", F.col("own") + 1)))
    return of.select(F.xxhash64("k", "size").alias("k"), "c", "n", "w", "top", (F.col("own") == F.col("size")).alias("own"))


def pivots(members: DataFrame, round_: int) -> DataFrame:
    """k, p, pn, ptop, pown: of each bucket the most central members, those in the most large buckets and then with the
    smallest part of unshared shingles, so that buckets of one group share their pivots; one in the first round and
    then eight times as many each time."""
    share = F.pmod(F.xxhash64("c", F.lit(round_)), F.lit(8**round_))
    best = members.withColumn("s", share).groupBy("k", "s").agg(F.max(F.struct("w", (F.col("top") / F.col("n")).alias("r"), F.xxhash64("c"), "c", "n", "top", "own")).alias("p"))
    return best.select("k", F.col("p.c").alias("p"), F.col("p.n").alias("pn"), F.col("p.top").alias("ptop"), F.col("p.own").alias("pown"))


def reachable(members: DataFrame) -> DataFrame:
    """Members for which the bucket has sizes and tops that allow a link; the sizes of a bucket are within a factor.
    A member of the class below is there to meet the bucket's own ones: with another such it meets in its own bucket."""
    tops = members.groupBy("k", "n", "own").agg(F.max("top").alias("t")).groupBy("k").agg(F.collect_list(F.struct("n", "t", "own")).alias("ts"))
    met = F.exists("ts", lambda y: (y["n"] <= F.col("top")) & (y["t"] >= F.col("n")) & (y["own"] | F.col("own")))
    return members.join(tops, "k").where(met).drop("ts")


def plausible(pairs: DataFrame, pool: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs a, b that Bayesian pruning leaves."""
    least = least_matches(threshold)
    sig = pool.select("c", "sig")
    both = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")

    def run(batches):
        for batch in batches:
            for b in (batch.slice(at, 4096) for at in range(0, batch.num_rows, 4096)):
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(b.num_rows, HASHES) for c in ("sa", "sb"))
                alive, matches = np.arange(b.num_rows), np.zeros(b.num_rows, int)
                for k, m in least.items():
                    matches[alive] += (x[alive, k - STEP : k] == y[alive, k - STEP : k]).sum(axis=1)
                    alive = alive[matches[alive] >= m]
                yield pa.RecordBatch.from_arrays([c.take(pa.array(alive)) for c in b.columns[:2]], ["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, pool: DataFrame) -> DataFrame:
    """The pairs whose sets reach the threshold; adaptive execution splits a pivot's many pairs over tasks."""
    text = pool.select("c", "text")
    both = pairs.join(text.toDF("b", "y"), "b").join(text.toDF("a", "x"), "a")

    def rows(batches):
        of, x = None, np.empty(0, np.uint64)
        for batch in batches:
            for a, b, s, t in zip(batch["a"], batch["b"], batch["x"], batch["y"], strict=True):
                if a != of:  # rows of a pivot follow each other
                    of, x = a, shingle_set(s, WORDS)
                y = shingle_set(t, WORDS)
                at = np.searchsorted(x, y)
                common = int((x[np.minimum(at, len(x) - 1)] == y).sum()) if len(x) else 0
                if common and 5 * common >= 4 * (len(x) + len(y) - common):
                    yield a, b

    return map_rows(both.select("a", "b", "x", "y"), "a bigint, b bigint", rows)


def spread(pairs: DataFrame) -> DataFrame:
    """The pairs, TASK_PAIRS to a task, in order, so that those of a pivot follow each other."""
    return pairs.repartition(max(1, -(-pairs.count() // TASK_PAIRS))).sortWithinPartitions(pairs.columns[0])


def bitmap(hashes: DataFrame) -> np.ndarray:
    """BITS flags; that of h modulo BITS is set for every h. At most BITS / 8 bytes come to the driver."""
    at = F.pmod("h", F.lit(BITS)) + 1
    parts = hashes.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(BITS, bool)
    for k, bits in parts:
        flags = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)
        out[(k - 1) * len(flags) : k * len(flags)] = flags
    return np.packbits(out)


def differences(pairs: DataFrame, pool: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """p, c, n, d, e, h: for pairs p, c, shingles h that only one of both sets has; n is the size of c, d how many there
    are and e how many come out. Pairs at more than twice the distance of the threshold have none. With a bitmap, those
    whose flag is set; else n // 4 + 1 of them, those that c alone has first, since fewer other sets have them."""
    text = pool.select("c", "text")
    both = pairs.select("p", "c").join(text, "c").join(text.toDF("p", "x"), "p").select("p", "c", "x", "text")

    def rows(batches):
        of, x = None, np.empty(0, np.uint64)
        for batch in batches:
            for p, c, s, t in zip(batch["p"], batch["c"], batch["x"], batch["text"], strict=True):
                if p != of:
                    of, x = p, shingle_set(s, WORDS)
                y = shingle_set(t, WORDS)
                own = np.setdiff1d(y, x, assume_unique=True)
                only = np.concatenate([own, np.setdiff1d(x, y, assume_unique=True)])
                d = len(only)
                every = (len(x) + len(y) + d) // 2
                if d > 2 * (1 - THRESHOLD) * every + 1e-6:
                    continue
                if wanted is None:
                    only = only[: len(y) // 4 + 1]
                else:
                    at = only % np.uint64(BITS)
                    only = only[(wanted[at >> np.uint64(3)] >> (np.uint64(7) - at % np.uint64(8)).astype(np.uint8)) & 1 == 1]
                for h in only.view(np.int64).tolist():
                    yield p, c, len(y), d, len(only), h

    return map_rows(both, "p bigint, c bigint, n bigint, d bigint, e bigint, h bigint", rows, 20_000)


def bridges(scratch: Scratch, met: list[tuple[DataFrame, DataFrame, int]], found: DataFrame, roots: DataFrame, pool: DataFrame, at_hand: bool) -> DataFrame | None:
    """Verified links between classes that pivots left apart, if any may be. met: each round's members, pivots and most pairs;
found: the links so far, and roots their components; at_hand: the pool is broadcast.

    y in a bucket with a pivot p, but not in p's class, can be similar to an x that p took only if 1 - J(p, y) is at
    most twice 1 - THRESHOLD. Of y's differences from p, those that x lacks are differences of x and y, of which there
    are at most n / 4; so of any n // 4 + 1 x has one, and, of those, one among the first that fewest x have."""
    ends = found.toDF("p", "c").unionByName(found.select(F.col("b").alias("p"), F.col("a").alias("c")))
    least = 2 * THRESHOLD - 1
    apart = []
    for members, of, _ in met:
        taking = of.select("k", "p", "pn").join(ends.select("p"), "p", "left_semi").join(roots.toDF("p", "proot"), "p", "left").withColumn("proot", F.coalesce("proot", "p"))
        other = members.select("k", "c", "n").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
        near = F.least("n", "pn") >= least * F.greatest("n", "pn")
        apart.append(other.join(taking, "k").where((F.col("root") != F.col("proot")) & near).select(F.col("p").alias("a"), F.col("c").alias("b")))
    ys = scratch.keep(plausible(reduce(DataFrame.unionByName, apart).distinct(), pool, least), "apart", sum(most for _, _, most in met)).toDF("p", "c")
    if ys.isEmpty():
        return None
    if at_hand:
        ys = spread(ys)
    of_y = scratch.keep(differences(ys, pool), "differences_y")
    xs = ends.join(ys.select("p").distinct(), "p", "left_semi").distinct()
    of_x = differences(spread(scratch.keep(xs, "ends", 2 * found.count())) if at_hand else xs, pool, bitmap(of_y)).select("p", "h", F.col("c").alias("x"), F.col("n").alias("xn"), F.col("d").alias("xd"))
    of_x = scratch.keep(of_x, "differences_x")
    common = of_x.groupBy("p", "h").agg(F.count(F.lit(1)).alias("m"))
    of_y = of_y.join(common, ["p", "h"])
    one = Window.partitionBy("p", "c")
    of_y = of_y.withColumn("at", F.row_number().over(one.orderBy("m", "h"))).withColumn("had", F.count(F.lit(1)).over(one))
    of_y = of_y.where(F.col("at") <= F.floor(F.col("n") / 4) + 1 - (F.col("e") - F.col("had")))
    pairs = of_y.join(of_x, ["p", "h"]).where(fits(F.col("n"), F.col("xn")) & (F.col("c") != F.col("x")))
    # |x ^ y| = xd + d - 2 * common <= (xn + n) / 9, so x lacks at most half of d - xd + (xn + n) / 9 of y's, and has no fewer than none
    lacks = F.floor((9 * (F.col("d") - F.col("xd")) + F.col("n") + F.col("xn")) / 18)
    pairs = pairs.where((9 * (F.col("d") - F.col("xd")) <= F.col("n") + F.col("xn")) & (F.col("at") <= lacks + 1 - (F.col("e") - F.col("had"))))
    pairs = scratch.keep(pairs.select(F.least("c", "x").alias("a"), F.greatest("c", "x").alias("b")).distinct(), "bridges")
    return scratch.keep(verified(plausible(spread(pairs) if at_hand else pairs, pool), pool), "bridged")


def links(scratch: Scratch, reps: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified pairs a, b of representatives, and c, root: their components. reps: c, n, sig; texts: c, text."""
    every = bands(reps)
    shared = every.groupBy("k").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    cand = scratch.keep(every.join(shared, "k"), "candidates", -(-reps.count() * (HASHES // ROWS) // NARROW))
    many = cand.count()
    pool = scratch.keep(reps.join(cand.select("c").distinct(), "c", "left_semi").join(texts, "c"), "pool")
    size = pool.agg(F.sum(F.length("sig") + F.octet_length("text"))).first()[0] or 0
    at_hand = size <= POOL_BYTES
    whole = F.broadcast(pool) if at_hand else pool
    found, judged, met = [], None, []

    def judge(pairs: DataFrame, name: str, most: int) -> DataFrame:
        nonlocal judged
        fresh = pairs.distinct()
        fresh = scratch.keep(fresh if judged is None else fresh.join(judged, ["a", "b"], "left_anti"), f"pairs{name}", -(-most // NARROW) if name == "0" else most)
        judged = fresh if judged is None else judged.unionByName(fresh)
        found.append(scratch.keep(verified(plausible(spread(fresh) if at_hand else fresh, whole), whole), f"links{name}"))
        return reduce(DataFrame.unionByName, found)

    def connected(linked: DataFrame) -> tuple[DataFrame, DataFrame]:
        roots = scratch.keep(components(scratch, linked), "roots")
        bridged = bridges(scratch, met, linked, roots, whole, at_hand)
        if bridged is None or bridged.isEmpty():
            return linked, roots
        return linked.unionByName(bridged).distinct(), merged(scratch, roots, bridged)

    pairs = all_pairs(cand.where(F.col("m") <= SMALL), SMALL)
    large, round_ = scratch.keep(large_members(cand, pool), "large", -(-2 * many // NARROW)), 0
    most = rows = large.count()
    while True:
        # members that no set of their bucket can be similar to are done
        now = scratch.keep(reachable(large), f"reachable{round_}", most)
        sizes = now.groupBy("k").agg(F.count(F.lit(1)).alias("left")).where("left > 1")
        now = scratch.keep(now.join(sizes, "k"), f"now{round_}", most)
        few, every_pair = all_paired(now, PAIRS * rows)
        pairs = pairs.unionByName(all_pairs(now.where(F.col("left") <= few).select("k", "c", "n"), few))
        now = now.where(F.col("left") > few).drop("left")
        of = scratch.keep(pivots(now, round_), f"pivots{round_}", most)
        # a member is in one of all pairs or is paired with its bucket's pivots; the first pairs are of all buckets, and narrow
        proposed = every_pair + most * min(8**round_, most) if round_ else every_pair + most + many * SMALL
        if round_ and of.isEmpty():
            return connected(judge(pairs, str(round_), proposed))
        met.append((now, of, most * min(8**round_, most)))
        able = (F.col("p") != F.col("c")) & (F.col("n") <= F.col("ptop")) & (F.col("pn") <= F.col("top")) & (F.col("own") | F.col("pown"))
        tried = scratch.keep(now.join(of, "k").where(able).select("k", "c", F.least("p", "c").alias("a"), F.greatest("p", "c").alias("b")), f"tried{round_}")
        linked = judge(pairs.unionByName(tried.select("a", "b")), str(round_), proposed)
        done = tried.join(linked, ["a", "b"], "left_semi").select("k", "c").unionByName(of.select("k", F.col("p").alias("c"))).distinct()
        large = scratch.keep(now.join(done, ["k", "c"], "left_anti"), f"large{round_ + 1}", most)
        most = large.count()
        if not most:
            return connected(linked)
        pairs, round_ = linked.limit(0), round_ + 1


def joined_ends(edges: DataFrame) -> DataFrame:
    """c, root: the smallest node that each other node of the edges u, v is connected to, found in one task."""

    def run(batches):
        over: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := over.get(x, x)) != x:
                over[x] = over.get(y, y)
                x = y
            return x

        for b in batches:
            for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
                x, y = sorted((root(u), root(v)))
                if x != y:
                    over[y] = x
        found = [(c, root(c)) for c in list(over)]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["c", "root"])

    return edges.coalesce(1).mapInArrow(run, "c bigint, root bigint")


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """c, root: the smallest node that each node of the edges a, b is connected to. FEW_LINKS are joined in one task;
    more by large and small stars by turns, until every node hangs on its root."""
    scratch = Scratch(scratch.spark, "components")
    edges = scratch.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v"), "edges0")
    if edges.count() <= FEW_LINKS:
        return joined_ends(edges)
    state, step = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = scratch.keep(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"star{step}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        edges = scratch.keep(small, f"edges{step + 1}")
        scratch.drop(f"edges{step}", f"star{step}")
        now = tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if now == state:
            return edges.select(F.col("u").alias("c"), F.col("v").alias("root"))
        state, step = now, step + 1


def merged(scratch: Scratch, roots: DataFrame, edges: DataFrame) -> DataFrame:
    """c, root of components that further edges join; only their roots are connected anew."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    known = ends.join(roots, "c", "left").select("c", F.coalesce("root", "c").alias("root"))
    short = edges.join(known.toDF("a", "ra"), "a").join(known.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    joins = components(scratch, short).toDF("root", "least")
    every = roots.unionByName(known).distinct()
    return scratch.keep(every.join(joins, "root", "left").select("c", F.coalesce("least", "root").alias("root")), "merged")


def similar(scratch: Scratch, roots: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """c, others: for each set of a class of three or more, the rows of the other sets that are similar to it, counted
    over all pairs of the class. reps: c, m; in a smaller class the link that made it is the only one."""
    members = roots.unionByName(roots.select(F.col("root").alias("c"), "root")).distinct()
    blocks = members.groupBy("root").agg(F.count(F.lit(1)).alias("k")).where("k > 2").select("root", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks"))
    members = members.join(blocks, "root").join(reps.select("c", "m"), "c").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))

    def sets(batches):
        for b in batches:
            data = [shingle_set(t, WORDS).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(data, pa.binary())], ["c", "root", "m", "blocks", "block", "set"])

    wide = members.join(texts, "c").select("c", "root", "m", "blocks", "block", "text")
    wide = scratch.keep(wide.mapInArrow(sets, "c bigint, root bigint, m bigint, blocks int, block int, set binary"), "members")
    other = wide.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    other = other.select("c", "root", "m", "block", "set", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))

    def count(t: pa.Table) -> pa.Table:
        block, m = t["block"].to_numpy(), t["m"].to_numpy()
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        data = [np.frombuffer(x, np.uint64) for x in t["set"].to_pylist()]
        n = np.array([len(x) for x in data])
        who = np.repeat(np.arange(len(data)), n)
        _, at, times = np.unique(np.concatenate(data), return_inverse=True, return_counts=True)
        column = np.cumsum(times > 1) - 1  # a shingle of one set is not shared
        keep = times[at] > 1
        at, who = column[at[keep]], who[keep]
        order = np.argsort(at, kind="stable")
        at, who = at[order], who[order]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        common = np.zeros((len(left), len(right)))
        for start in range(0, int(at[-1]) + 1 if len(at) else 0, WIDE):
            lo, hi = np.searchsorted(at, [start, start + WIDE])
            part = np.zeros((len(data), WIDE), np.float32)
            part[who[lo:hi], at[lo:hi] - start] = 1
            common += part[left] @ part[right].T
        alike = 9 * common >= 4 * (n[left][:, None] + n[right][None, :])
        others = np.zeros(len(data), np.int64)
        if i == j:
            np.fill_diagonal(alike, False)
            others[left] = alike @ m[right]
        else:
            others[left], others[right] = alike @ m[right], alike.T @ m[left]
        return pa.table({"c": t["c"], "others": pa.array(others)})

    counts = other.groupBy("root", "i", "j").applyInArrow(count, "c bigint, others bigint")
    return scratch.keep(counts.groupBy("c").agg(F.sum("others").alias("similar")), "similar", wide.count())


def grouped(spark: SparkSession, docs: DataFrame, counted: bool = True) -> tuple[DataFrame, DataFrame]:
    """The sketched documents, and _row, doc_id, class (the smallest row of the document's class) and n_links of each row; if
    not counted, n_links has only the links that made the classes."""
    scratch = Scratch(spark, "near")
    base = scratch.keep(sketched(docs), "documents")
    sets = base.where(F.col("_key").isNotNull())
    reps = scratch.keep(sets.groupBy("_key").agg(F.min("_row").alias("c"), F.first("_n").alias("n"), F.first("_sig").alias("sig"), F.count(F.lit(1)).alias("m")), "sets", base.count())
    texts = base.select(F.col("_row").alias("c"), "text")
    found, roots = links(scratch, reps.select("c", "n", "sig"), texts)
    ends = found.select(F.col("a").alias("c"), F.col("b").alias("d")).unionByName(found.select(F.col("b").alias("c"), F.col("a").alias("d")))
    degree = ends.join(reps.select(F.col("c").alias("d"), "m"), "d").groupBy("c").agg(F.sum("m").alias("others"))
    if counted:
        degree = degree.join(similar(scratch, roots, reps, texts), "c", "left").select("c", F.coalesce("similar", "others").alias("others"))
    classes = reps.select("_key", "c", "m").join(roots, "c", "left").join(degree, "c", "left")
    classes = classes.select("_key", F.coalesce("root", "c").alias("class"), (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    rows = base.select("_row", "doc_id", "_key").join(classes, "_key", "left")
    return base, rows.select("_row", "doc_id", F.coalesce("class", "_row").alias("class"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def joined(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links: a row per document."""
    _, rows = grouped(spark, docs.select("doc_id", "text"))
    ids = rows.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    return rows.join(ids, "class").select("doc_id", "class_id", "n_links")


def without_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest doc_id; columns unchanged."""
    plain = masked(docs)
    base, rows = grouped(spark, plain, counted=False)
    first = rows.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("x")).select(F.col("x._row").alias("_row"))
    return base.join(first, "_row", "left_semi").select(*plain.columns).toDF(*docs.columns)
