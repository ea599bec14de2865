"""Suffix-array dedup over merged Burrows-Wheeler transforms.

A repeated string of LENGTH bytes has the same minimal SEED-gram (by hash, leftmost) wherever it occurs, so the windows of
a text are dealt by that seed: consecutive windows with one seed make a segment, and equal strings lie in segments of
one seed. Only seeds that occur more than once, with equal bytes on one side at least, are looked at. Equal segments
are one form with a weight.

The forms of a batch of seeds are sharded; the Burrows-Wheeler transforms of the shards are merged by refining their
interleave: each step sorts stably by the symbol before, which orders all suffixes by one more byte without sorting
them again, and a boundary appears where two neighbours first differ. The groups left after LENGTH steps are the
repeated intervals, those suffixes whose common prefix is LENGTH or more. Suffixes that differ from all others leave the
interleave as soon as they do. No transform is merged for a seed with one form, which its weight settles, nor for one
with over LARGE forms, which would not fit a task: there all windows are listed, and those whose SHA-256 values occur
more than once are repeated, with the same result.

Defined results: null and empty texts have no bytes; texts under LENGTH bytes lose nothing; repeated rows are other
documents, so that whole copies of LENGTH bytes or more lose everything; no rows, no rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_rows, utf8
from .shingles import prefixes, spans

LENGTH, SEED = 200, 64
SIDE = (LENGTH - SEED) // 2
#: Text bytes in a batch, and in one of its shards; forms of a seed beyond which its windows are dealt out.
BATCH, SHARD, LARGE = 1 << 17, 1 << 15, 10_000
#: Windows of a text that are hashed at a time.
SLICE = 1 << 22


def segments(data: bytes) -> tuple[np.ndarray, ...]:
    """seed hash, hash of the segment, first and last window start, for the segments of a text; then hashes of the seed
    with the SIDE bytes before and after it. Every window holds one of these two strings, or both; a segment none of
    whose windows does gets a value of its own form instead."""
    n = len(data) - LENGTH + 1
    if n < 1:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
    sums = prefixes(data)
    at = np.arange(len(data) - SEED + 1)
    h = spans(sums, at, at + SEED)
    reach = LENGTH - SEED + 1  # seeds in a window
    seed = np.empty(n, np.int64)
    for lo in range(0, n, SLICE):
        hi = min(n, lo + SLICE)
        part = h[lo : hi + reach - 1]
        low = (part >> np.uint64(24) << np.uint64(24)) | np.arange(len(part), dtype=np.uint64)
        width = 1
        while 2 * width <= reach:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: hi - lo], low[reach - width : reach - width + hi - lo])
        seed[lo:hi] = (low & np.uint64((1 << 24) - 1)).astype(np.int64) + lo
    first = np.concatenate([[0], np.flatnonzero(np.diff(seed)) + 1])
    last = np.concatenate([first[1:] - 1, [n - 1]])
    form, at = spans(sums, first, last + LENGTH), seed[first]
    before, after = at - SIDE >= first, at + SEED + SIDE <= last + LENGTH
    left = np.where(before, spans(sums, np.maximum(at - SIDE, 0), at + SEED), form * np.uint64(3))
    right = np.where(after, spans(sums, at, np.minimum(at + SEED + SIDE, len(data))), form * np.uint64(5))
    return h[at], form, first, last, left, right


def located(docs: DataFrame) -> DataFrame:
    """seed, form, row, lo, hi: a row per segment."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                cols = [[], [], [], [], [], [], []]
                part = b.slice(at, 64)
                for row, text in zip(part.column("row").to_pylist(), part.column("text").to_pylist(), strict=True):
                    seed, form, lo, hi, left, right = segments(utf8(text))
                    for c, x in zip(cols, (seed.view(np.int64), form.view(np.int64), np.full(len(lo), row), lo.astype(np.int32), hi.astype(np.int32), left.view(np.int64), right.view(np.int64)), strict=True):
                        c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["seed", "form", "row", "lo", "hi", "left", "right"])

    return docs.select("row", "text").mapInArrow(run, "seed bigint, form bigint, row bigint, lo int, hi int, left bigint, right bigint")


def bwt_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform of a shard: the symbol before each suffix, suffixes in order; then each suffix's
    text and offset. Symbols are bytes + 1; a text's end, 0, sorts before all of them, ends among themselves by text."""
    lens = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(lens) - 1
    inside = np.ones(lens.sum(), bool)
    inside[ends] = False
    flat = np.zeros(len(inside), np.int64)
    flat[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    text = np.repeat(np.arange(len(texts)), lens)
    offset = np.arange(len(flat)) - np.repeat(ends - lens + 1, lens)
    rank, step = np.where(inside, flat + len(texts), text), 1
    while True:  # ranks by the first `step` symbols, doubled until all differ
        ahead = np.minimum(np.arange(len(flat)) + step, ends[text])
        key = rank * np.int64(len(flat) + len(texts) + 258) + rank[ahead]
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(flat), np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
        step *= 2
        if rank[order[-1]] == len(flat) - 1:
            break
    before = np.concatenate([[0], flat[:-1]])
    before[offset == 0] = 0
    return before[order].astype(np.int16), text[order], offset[order]


def symbols_before(symbols: np.ndarray, before: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the rank of the `size` symbols before it among those that occur more than once, from 1 on, and the
    place of the suffix that begins with them. 0 is for what no other suffix has, or what is cut by an end."""
    bits = max(1, int(symbols.max(initial=0)).bit_length())
    code, at, inside = np.zeros(len(symbols), np.int64), np.arange(len(symbols), dtype=np.int32), np.ones(len(symbols), bool)
    for i in range(size):
        now = symbols[at]
        inside &= now > 0
        code |= now.astype(np.int64) << (i * bits)
        at = before[at]
    code[~inside] = 0
    order = np.argsort(code)
    ordered = code[order]
    edge = np.append(True, ordered[1:] != ordered[:-1]) if len(code) else np.ones(0, bool)
    several = ~(edge & np.append(edge[1:], True)) & (ordered > 0)
    rank = np.cumsum(edge & several)
    keys = np.zeros(len(symbols), np.uint16 if len(rank) and rank[-1] < 1 << 16 else np.int32)  # numpy sorts 16 bits by radix
    keys[order[several]] = rank[several]
    return keys, at


def merged_groups(bwts: list[np.ndarray], depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Merges shards' transforms as far as common prefixes of `depth` symbols are concerned: the places, in the shards laid
    end to end, of the suffixes whose first `depth` symbols another suffix has too, in merged order, and a group number
    that equal ones share. An end equals nothing.

    A step sorts the interleave stably by the symbols before, as many as fit a number, which orders the suffixes that
    begin there by so many more symbols; what is left of `depth` then goes by single ones. A suffix that differs from
    all others differs after any step too, so only the groups of several go on."""
    symbols = np.concatenate(bwts)
    # where the suffix that begins one symbol earlier is in its own shard's order
    before, at = np.empty(len(symbols), np.int32), 0
    for b in bwts:
        before[at + np.argsort(b, kind="stable")] = np.arange(at, at + len(b), dtype=np.int32)
        at += len(b)
    place, group = np.arange(len(symbols), dtype=np.int32), np.zeros(len(symbols), np.int32)
    size = min(depth, 63 // max(1, int(symbols.max(initial=0)).bit_length()))
    steps = [symbols_before(symbols, before, size)] * (depth // size) if depth else []
    for keys, before_ in [*steps, *[(symbols, before)] * (depth - size * len(steps))]:
        now = keys[place]
        inside = np.flatnonzero(now)
        order = inside[np.argsort(now[inside], kind="stable")]
        now, was, place = now[order], group[order], before_[place[order]]
        new = np.ones(len(order), bool)
        new[1:] = (now[1:] != now[:-1]) | (was[1:] != was[:-1])
        several = ~(new & np.append(new[1:], True))
        place, group = place[several], np.cumsum(new[several], dtype=np.int32)
        if not len(place):
            break
    return place, group


def repeated(forms: list[tuple[bytes, int, int]]) -> list[np.ndarray]:
    """For forms (bytes, number of window starts, weight): which of each one's starts are of a repeated window."""
    shards, size = [[]], 0
    for i, (data, _, _) in enumerate(forms):
        if shards[-1] and size + len(data) > SHARD:
            shards.append([])
            size = 0
        shards[-1].append(i)
        size += len(data)
    made = [bwt_of([forms[i][0] for i in s]) for s in shards]
    form = np.concatenate([np.array(s, np.int32)[text] for s, (_, text, _) in zip(shards, made, strict=True)])
    offset = np.concatenate([o.astype(np.int32) for _, _, o in made])
    place, _ = merged_groups([b for b, _, _ in made])
    # every window of a form that occurs again is repeated, and so are those that share a group
    starts = np.array([n for _, n, _ in forms])
    flags, first = np.repeat([w >= 2 for _, _, w in forms], starts), np.cumsum(starts) - starts
    flags[first[form[place]] + offset[place]] = True
    return np.split(flags, first[1:])


def ranges(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"a": int(a), "b": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def flagged(pieces: DataFrame) -> DataFrame:
    """seed, form, starts (ranges of repeated window starts) from seed, form, n, data; rows of a seed follow each other."""

    def rows(batches):
        held: list[tuple] = []
        size = 0

        def done():
            for (seed, form, _, _), flags in zip(held, repeated([(d, len(d) - LENGTH + 1, n) for _, _, n, d in held]), strict=True):
                if flags.any():
                    yield seed, form, ranges(flags)

        for b in batches:
            for seed, form, n, data in zip(b["seed"], b["form"], b["n"], b["data"], strict=True):
                if size > BATCH and seed != held[-1][0]:
                    yield from done()
                    held, size = [], 0
                held.append((seed, form, min(n, 2), bytes(data)))
                size += len(data)
        if held:
            yield from done()

    return map_rows(pieces.select("seed", "form", "n", "data"), "seed bigint, form bigint, starts array<struct<a int, b int>>", rows, 1000)


def removed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """row, cuts: per document the byte ranges that repeated windows cover. docs: row, text; read twice, so it must be a
    written table."""
    scratch = Scratch(spark, "repeats")
    every = scratch.keep(located(docs), "segments")
    shared = every.groupBy("seed").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("seed")
    some = scratch.keep(every.join(shared, "seed", "left_semi"), "shared")
    scratch.drop("segments")
    forms = some.groupBy("seed", "form").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "lo", "hi", "left", "right")).alias("at"))
    forms = scratch.keep(forms.join(forms.groupBy("seed").agg(F.count(F.lit(1)).alias("d")), "seed"), "forms")
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("at.hi") - F.col("at.lo") + 1).alias("b")))
    # a seed's only form is one interval of its own transform, of its weight
    single = forms.where("d = 1").select("seed", "form", whole.alias("starts"))
    # a form whose seed has no twin with the same bytes on either side has no repeated window
    forms = forms.where("d > 1").select("*", "at.left", "at.right")
    twins = {c: forms.groupBy(c).agg(F.sum("n").alias("m")).where("m > 1").select(c) for c in ("left", "right")}
    forms = forms.join(twins["left"], "left", "left_semi").unionByName(forms.join(twins["right"], "right", "left_semi").join(twins["left"], "left", "left_anti"))
    pieces = forms.select("seed", "form", "n", "d", "at.row", "at.lo", "at.hi").join(docs.select("row", F.col("text").cast("binary").alias("bytes")), "row")
    pieces = scratch.keep(pieces.select("seed", "form", "n", "d", F.expr(f"substring(bytes, lo + 1, hi - lo + {LENGTH})").alias("data")), "pieces")
    few = flagged(pieces.where(F.col("d") <= LARGE).repartition("seed").sortWithinPartitions("seed", "form"))
    windows = pieces.where(F.col("d") > LARGE).select("seed", "form", "n", "data", F.explode(F.sequence(F.lit(0), F.octet_length("data") - LENGTH)).alias("off"))
    windows = windows.select("seed", "form", "n", "off", F.sha2(F.expr(f"substring(data, off + 1, {LENGTH})"), 256).alias("w"))
    again = windows.groupBy("w").agg(F.sum("n").alias("m")).where("m > 1").select("w")
    many = windows.join(again, "w", "left_semi").groupBy("seed", "form").agg(F.sort_array(F.collect_list(F.struct(F.col("off").alias("a"), (F.col("off") + 1).alias("b")))).alias("starts"))
    found = scratch.keep(single.unionByName(few).unionByName(many), "found")
    cuts = some.join(found, ["seed", "form"]).select("row", "lo", F.explode("starts").alias("s"))
    return cuts.select("row", F.struct((F.col("lo") + F.col("s.a")).alias("a"), (F.col("lo") + F.col("s.b") - 1 + LENGTH).alias("b")).alias("cut")).groupBy("row").agg(F.collect_list("cut").alias("cuts"))


def deduplicated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    # written once, so that every reading has the same rows
    docs = Scratch(spark, "texts").keep(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "rows")
    whole = docs.join(removed(spark, docs.select("row", "text")), "row", "left")

    def rows(batches):
        for b in batches:
            for doc, text, cuts in zip(b["doc_id"], b["text"], b["cuts"], strict=True):
                data, kept, gone, spans_, at = utf8(text), hashlib.sha256(), 0, 0, 0
                for a, e in sorted((c["a"], c["b"]) for c in cuts or ()):
                    if a > at or not spans_:
                        kept.update(data[at:a])
                        spans_ += 1
                        at = a
                    gone += max(0, e - at)
                    at = max(at, e)
                kept.update(data[at:])
                yield doc, len(data), gone, spans_, kept.hexdigest()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(whole.select("doc_id", "text", "cuts"), f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", rows)
