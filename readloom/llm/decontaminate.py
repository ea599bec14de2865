"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the 13-word windows of each benchmark item (an item of fewer words, but not none, is one window).
Patterns of one length share a table: a block of words that no pattern holds lets the search skip ahead, the
block that ends a pattern leads to a bucket of test strings, and a direct comparison confirms an occurrence.

Defined results: a null or empty text has no words and is clean; an item without words is never found; a null
item_id counts as the empty id; items with equal ids count once; repeated documents are each answered; an empty
benchmark finds nothing; extra columns are ignored or, in clean(), kept."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, map_rows, pieces, utf8

WINDOW = 13
#: Bytes of benchmark text whose tables a worker holds at once; a larger benchmark goes over the documents in several passes.
PASS_BYTES = 16 << 20
#: Lower-cases A-Z and turns all but digits, letters and bytes from 0x80 into blanks.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return utf8(text).translate(FOLD).split()


class Searcher:
    """Wu-Manber tables for windows of one length."""

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], set[str]]):
        self.length = length
        self.block = block = min(3, length)
        self.skip = length - block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list[tuple[list[bytes], frozenset[str]]]] = defaultdict(list)
        for window, items in windows.items():
            for end in range(block, length + 1):
                key = window[end - block : end]
                self.shift[key] = min(self.shift.get(key, self.skip), length - end)
            self.buckets[window[length - block :]].append((list(window), frozenset(items)))

    def find(self, text: list[bytes]) -> Iterator[tuple[int, frozenset[str]]]:
        """Start and items of each occurrence, by start."""
        length, block, shift, skip = self.length, self.block, self.shift, self.skip
        end, n = length, len(text)
        while end <= n:
            key = tuple(text[end - block : end])
            if step := shift.get(key, skip):
                end += step
                continue
            here = text[end - length : end]
            for window, items in self.buckets[key]:
                if window == here:
                    yield end - length, items
            end += 1


def searchers(items: Iterable[tuple[str, str]]) -> list[Searcher]:
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        w = words(text)
        n = min(WINDOW, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            by_length[n][tuple(w[i : i + n])].add(item)
    return [Searcher(n, windows) for n, windows in sorted(by_length.items())]


def search(tables: list[Searcher], text: list[bytes]) -> tuple[list[list[int]], set[str]]:
    """Disjoint spans of hit words in order, and the items found."""
    found, items = [], set()
    for t in tables:
        for start, of in t.find(text):
            found.append((start, start + t.length))
            items |= of
    return merge(found), items


def merge(spans: Iterable[Iterable[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(map(tuple, spans)):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def passes(spark: SparkSession, benchmark: DataFrame, pass_bytes: int = PASS_BYTES) -> list:
    """Broadcast pattern tables, each from at most pass_bytes of item text (or one item)."""
    out, part, size = [], [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    for item, text in rows.toLocalIterator():
        if part and size + len(text) > pass_bytes:
            out.append(spark.sparkContext.broadcast(part))
            part, size = [], 0
        part.append((item, text))
        size += len(text)
    return [*out, spark.sparkContext.broadcast(part)] if part else out


def matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """doc_id, n_words, spans (of hit words, merged), items (sorted): a row per document, without a shuffle.
    A benchmark over pass_bytes adds narrow passes, not memory."""
    kept = docs.select("doc_id", "text", F.lit(None).cast("array<array<int>>").alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, n_words bigint, spans array<array<int>>, items array<string>"
    parts = passes(spark, benchmark, pass_bytes)

    def scan(part, last: bool):
        def rows(batches):
            tables = searchers(part.value if part else [])
            for b in batches:
                for doc, text, spans, items in zip(b["doc_id"], b["text"], b["spans"], b["items"], strict=True):
                    w = words(text)
                    new, of = search(tables, w)
                    yield doc, None if last else text, len(w), merge([*(spans or []), *new]), sorted({*(items or []), *of})

        return rows

    for i, part in enumerate(parts or [None]):
        kept = map_rows(kept, schema, scan(part, i >= len(parts) - 1))
    return kept.select("doc_id", "n_words", "spans", "items")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from matches()."""
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0]), F.lit(0).cast("bigint"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """docs without leaks; columns unchanged. A row goes if a whole window of WINDOW words occurs in it, however long it
    is, or if hits of shorter items, which clean texts may hold by chance, reach a twentieth of its words. Narrow passes,
    one per benchmark part, each with the tables of its part alone; hits of shorter items add up over them."""
    parts = passes(spark, benchmark, pass_bytes)
    if not parts:
        return docs
    spans = free_name(docs, "_spans")
    out = docs.withColumn(spans, F.lit(None).cast("array<array<int>>"))
    whole, wide = docs.schema, out.schema

    def scan(part, last: bool):
        def run(batches):
            tables = searchers(part.value)
            for b in pieces(batches):
                keep, found = [], []
                for text, before in zip(b.column("text").to_pylist(), b.column(spans).to_pylist(), strict=True):
                    w = words(text)
                    new = search(tables, w)[0]
                    found.append(merge([*(before or []), *new]))
                    n = sum(e - s for s, e in found[-1])
                    keep.append(not (any(e - s >= WINDOW for s, e in new) or (n and 20 * n >= len(w))))
                b = b.drop_columns([spans]) if last else b.set_column(b.num_columns - 1, spans, pa.array(found, pa.list_(pa.list_(pa.int32()))))
                yield b.filter(pa.array(keep, pa.bool_()))

        return run

    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        out = out.mapInArrow(scan(part, last), whole if last else wide)
    return out
