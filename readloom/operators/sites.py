"""Sites of reads: exploding, frequencies, contexts, substitutions and pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spread import spread


def explode_string(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos (from 0), base: a row per character."""
    return df.select(key, F.posexplode(F.split(F.col(text), "")).alias("pos", "base")).where("base <> ''")


def frequency(sites: DataFrame, by: list[str], bit: str = "bit", clamp: float = 1e-6) -> DataFrame:
    """n and the share of edited sites, kept inside (0, 1)."""
    f = F.avg(F.col(bit).cast("double"))
    return sites.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.greatest(F.lit(clamp), F.least(F.lit(1 - clamp), f)).alias("freq"))


def smoothed_frequency(sites: DataFrame, by: list[str], bit: str = "bit", alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    return sites.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), ((F.sum(bit) + alpha) / (F.count(F.lit(1)) + alpha + beta)).alias("freq"))


def two_stage(sites: DataFrame, unit: str, by: list[str], value: str) -> DataFrame:
    """Mean per unit first, then units weigh the same: mean, standard error of the mean and the number of units."""
    one = sites.groupBy(unit, *by).agg(F.avg(F.col(value).cast("double")).alias("m"))
    return one.groupBy(*by).agg(F.avg("m").alias("mean"), (F.stddev_samp("m") / F.sqrt(F.count("m"))).alias("sem"), F.count("m").alias("units"))


def log2_ratio(a: Column, b: Column, pseudo: float = 1e-3) -> Column:
    return F.log2((a + pseudo) / (b + pseudo))


def compared(sites: DataFrame, library: str, one: str, other: str, by: list[str], value: str, pseudo: float = 1e-3) -> DataFrame:
    """One library against another at the keys both have: two means and the log2 of their ratio, in one aggregation."""
    mean = lambda x: F.avg(F.when(F.col(library) == x, F.col(value).cast("double")))
    out = sites.groupBy(*by).agg(mean(one).alias("a"), mean(other).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return out.withColumn("log2fc", log2_ratio(F.col("a"), F.col("b"), pseudo))


def contexts(sites: DataFrame, read: str, pos: str, base: str, centre: str, alphabet: str = "ACGT") -> DataFrame:
    """context, n: how often each 3-mer around `centre` occurs, zero-filled over the alphabet."""
    w = Window.partitionBy(read).orderBy(pos)
    near = sites.select(base, F.lag(base).over(w).alias("l"), F.lead(base).over(w).alias("r")).where((F.col(base) == centre) & F.col("l").isNotNull() & F.col("r").isNotNull())
    seen = near.groupBy(F.concat("l", base, "r").alias("context")).agg(F.count(F.lit(1)).alias("n"))
    every = sites.sparkSession.createDataFrame([(x + centre + y,) for x in alphabet for y in alphabet], "context string")
    return every.join(seen, "context", "left").select("context", F.coalesce("n", F.lit(0)).alias("n"))


def substitutions(sites: DataFrame, ref: str, alt: str, alphabet: str = "ACGT") -> DataFrame:
    """ref, alt, n for the twelve classes, zero-filled."""
    seen = sites.where((F.col(ref) != F.col(alt)) & F.col(ref).isin(*alphabet) & F.col(alt).isin(*alphabet)).groupBy(F.col(ref).alias("ref"), F.col(alt).alias("alt")).agg(F.count(F.lit(1)).alias("n"))
    every = sites.sparkSession.createDataFrame([(x, y) for x in alphabet for y in alphabet if x != y], "ref string, alt string")
    return every.join(seen, ["ref", "alt"], "left").select("ref", "alt", F.coalesce("n", F.lit(0)).alias("n"))


def pair_tally(sites: DataFrame, read: str, pos: str, bit: str, reach: int) -> DataFrame:
    """i, j, n00, n01, n10, n11 of positions up to `reach` apart in the same read. The self-join is on the read and a
    bin of positions, so its output is bounded by the reach, not by the read's length."""
    a = sites.select(read, F.col(pos).alias("i"), F.col(bit).alias("x"), F.floor(F.col(pos) / reach).alias("bin"))
    b = sites.select(read, F.col(pos).alias("j"), F.col(bit).alias("y"), F.floor(F.col(pos) / reach).alias("own")).withColumn("bin", F.explode(F.array("own", F.col("own") - 1)))
    both = a.join(b, [read, "bin"]).where("j > i").where(F.col("j") - F.col("i") <= reach)
    n = lambda x, y: F.count(F.when((F.col("x") == x) & (F.col("y") == y), 1))
    return both.groupBy("i", "j").agg(n(0, 0).alias("n00"), n(0, 1).alias("n01"), n(1, 0).alias("n10"), n(1, 1).alias("n11"))


#: Positions whose pairs a task tallies together, and pairs that it holds before it counts them.
BLOCK, PAIRS = 512, 2_000_000


def pair_tally_whole(sites: DataFrame, read: str, pos: str, bit: str, block: int = BLOCK, most: int = PAIRS) -> DataFrame:
    """pair_tally of every pair of positions of a read; a read of n sites makes n * (n - 1) / 2 pairs. Pairs are never
    shuffled: a read goes, from there on, to each block of positions that it has sites in, and all pairs whose i lies in
    the block are made and counted in its task, `most` at a time."""
    kind = sites.schema[pos].dataType
    whole = sites.where(F.col(read).isNotNull() & F.col(pos).isNotNull())
    one = F.struct(F.col(pos).cast("bigint").alias("p"), F.coalesce(F.when(F.col(bit).isin(0, 1), F.col(bit)).cast("int"), F.lit(2)).alias("b"))
    rows = spread(whole, read).groupBy(read).agg(F.array_sort(F.collect_list(one)).alias("s")).select(F.col("s.p").alias("p"), F.col("s.b").alias("b"))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """block, n, p, b: the sites of a read from the block on; the first n lie in it."""
        for batch in batches:
            p, b = batch.column(0), batch.column(1)
            at = p.offsets.to_numpy()
            of, bits = p.values.to_numpy(), b.values.to_numpy().astype(np.int8)
            out, held = [], 0
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = of[lo:hi] // block
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [hi - lo]])
                for k, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    if hi - lo - k > 1:
                        out.append((int(own[k]), end - k, of[lo + k : hi].tobytes(), bits[lo + k : hi].tobytes()))
                        held += 9 * (hi - lo - k)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "n", "p", "b"])
                            out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "n", "p", "b"])

    def summed(i, j, counts):
        """Equal pairs as one."""
        order = np.lexsort((j, i))
        i, j, counts = i[order], j[order], counts[:, order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 0) | (np.diff(j) != 0)]))
        return i[first], j[first], np.add.reduceat(counts, first, axis=1)

    def counted(held):
        """i, j and the four counts of the pairs of some parts of reads."""
        at = np.concatenate([[0], np.cumsum([len(p) for _, p, _ in held])])
        names, place = np.unique(np.concatenate([p for _, p, _ in held]), return_inverse=True)
        keys = []
        for (n, _, b), lo, hi in zip(held, at[:-1].tolist(), at[1:].tolist(), strict=True):
            r = place[lo:hi]
            x, y = np.nonzero(r[None, :] > r[:n, None])
            code = np.where((b[x] > 1) | (b[y] > 1), 4, 2 * b[x].astype(np.int64) + b[y])
            keys.append((r[x] * len(names) + r[y]) * 8 + code)
        keys = np.sort(np.concatenate(keys))
        if not len(keys):
            return None
        pair = keys >> 3
        first = np.flatnonzero(np.concatenate([[True], np.diff(pair) != 0]))
        counts = np.stack([np.add.reduceat((keys & 7 == c).astype(np.int64), first) for c in range(4)])
        return names[pair[first] // len(names)], names[pair[first] % len(names)], counts

    def tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, pairs, found = None, [], 0, []

        def count():
            nonlocal held, pairs, found
            got = counted(held) if held else None
            held, pairs = [], 0
            if got is not None:
                found.append(got)
            if len(found) > 1 and (len(found[-1][0]) >= len(found[0][0]) or sum(len(f[0]) for f in found[1:]) >= len(found[0][0])):
                found = [summed(*[np.concatenate(c, axis=-1) for c in zip(*found, strict=True)])]

        def done():
            nonlocal found
            count()
            if len(found) > 1:
                found = [summed(*[np.concatenate(c, axis=-1) for c in zip(*found, strict=True)])]
            for i, j, counts in found:
                for lo in range(0, len(i), 100_000):
                    cut = slice(lo, lo + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(i[cut], pa.int64()), pa.array(j[cut], pa.int64()), *[pa.array(c[cut]) for c in counts]], names=["i", "j", "n00", "n01", "n10", "n11"])
            found = []

        for batch in batches:
            for k, n, p, b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if k != now:
                    yield from done()
                    now = k
                p, b = np.frombuffer(p, np.int64), np.frombuffer(b, np.int8)
                step = max(1, most // len(p))
                for lo in range(0, n, step):  # of a long read, some sites of the block at a time
                    m = min(step, n - lo)
                    held.append((m, p[lo:], b[lo:]))
                    pairs += m * (len(p) - lo)
                    if pairs >= most:
                        count()
        yield from done()

    there = spread(rows.mapInArrow(parts, "block bigint, n int, p binary, b binary"), "block").sortWithinPartitions("block")
    out = there.mapInArrow(tallies, "i bigint, j bigint, n00 bigint, n01 bigint, n10 bigint, n11 bigint")
    return out.select(F.col("i").cast(kind).alias("i"), F.col("j").cast(kind).alias("j"), "n00", "n01", "n10", "n11")


def odds_ratio() -> Column:
    """Of a tally, with Haldane's correction."""
    c = {k: F.col(k) + F.lit(0.5) for k in ("n00", "n01", "n10", "n11")}
    return c["n00"] * c["n11"] / (c["n01"] * c["n10"])


def mutual_information() -> Column:
    """Of a tally, in bits."""
    n = F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")
    total = F.lit(0.0)
    for x in (0, 1):
        for y in (0, 1):
            both = F.col(f"n{x}{y}")
            px, py = F.col(f"n{x}0") + F.col(f"n{x}1"), F.col(f"n0{y}") + F.col(f"n1{y}")
            total = total + F.when(both > 0, both / n * F.log2(both * n / (px * py))).otherwise(0.0)
    return total


def distances(sites: DataFrame, read: str, pos: str, keep: Column) -> DataFrame:
    """distance, n between neighbouring sites of a read that fulfil `keep`."""
    w = Window.partitionBy(read).orderBy(pos)
    return sites.where(keep).select((F.col(pos) - F.lag(pos).over(w)).alias("distance")).where("distance IS NOT NULL").groupBy("distance").agg(F.count(F.lit(1)).alias("n"))
