"""Toxicity by compression distance: windows of a text are compressed with two zstandard dictionaries, one trained on
ordinary and one on toxic text, and the saved bytes are turned into a probability by a calibrated model.

Whole texts of either kind share nearly all of their words, and dictionaries trained on them tell little (AUC 0.72 on
held-out rows of sf0.1). So the toxic dictionary is trained on the parts of toxic texts in which byte strings lie that
toxic documents hold in significant excess; the ordinary dictionary's content follows it, so ordinary windows come out
equally long and the difference is what toxic text explains. How telling each number of saved bytes is, and the weights
of the calibration, are learned crosswise: each fold of the sampled training documents is measured with a dictionary
trained without it, and the final dictionary comes from all of them.

Defined results: a null or empty text has no window and gets the score of a text in which nothing was found; without
ordinary training rows every score is 0.5 if there are toxic ones, and without toxic ones 0, so nothing is rejected;
labels repeated for a document count as toxic if any is; null labels are skipped; repeated documents are each scored;
extra columns are ignored, or kept by without_toxic; ids may be of any type."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable
from functools import cache

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, keep_rows, map_rows
from .shingles import mixed, prefixes, shingle_set, spans

THRESHOLD = 0.7
#: Bounds of the training sample: documents and bytes of each kind. Scores cover all rows.
SAMPLE_DOCS, SAMPLE_BYTES = 3000, 10 << 20
WINDOW, DICTIONARY, TOXIC_DICTIONARY, LEVEL, LEAST_MATCH = 48, 16384, 4096, 12, 5
#: Lengths of the byte strings that are counted, buckets of their counts, and the longest part of a word that is looked at.
GRAMS, BUCKETS, WORD_BYTES = (5, 6, 7, 8, 9), 1 << 21, 64
#: A string is in excess if the root of its log-likelihood ratio against equal shares of documents is over this, and
#: if its share of toxic documents is this many times that of ordinary ones.
LEAST_ROOT, LEAST_LIFT = 5.0, 5.0
#: Of a word, the strings count whose root reaches this part of the word's largest.
NEAR = 0.9
FOLDS, MOST_SAVED, SKETCH = 4, 8, 8
#: Buckets, and words, that are looked at together.
SLICE = 1 << 14
#: A flag for each hash of a word between its neighbours that the sample has shown.
SEEN = 1 << 25
#: Share of toxic texts that scores assume; the sample's own share would let through what it makes rare.
PRIOR = 0.5


def lowered(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").split()


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """Whole words, lower-cased, up to `size` bytes or one word more, each window once; a longer word is cut."""
    out, cur, n = [], [], 0
    for w in lowered(text):
        for at in range(0, len(w), 4 * size):
            cur.append(w[at : at + 4 * size])
            n += len(cur[-1]) + 1
            if n >= size:
                out.append(b" " + b" ".join(cur) + b" ")
                cur, n = [], 0
    if cur:
        out.append(b" " + b" ".join(cur) + b" ")
    return list(dict.fromkeys(out))


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=64, dict_size=len(content), min_match=LEAST_MATCH, write_content_size=0, write_checksum=0, write_dict_id=0
    )
    made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=made, compression_params=params)


def trained(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their text itself
        return b"".join(dict.fromkeys(samples))[-size:] or b" " * 8


class Excess:
    """Counts of the documents that hold a byte string, by kind and fold; strings share BUCKETS by their hash. A word
    between the same neighbours as in an earlier document does not count: shared passages tell once."""

    def __init__(self, docs: int):
        """docs: as many texts as can be added, or more."""
        self.seen = np.zeros(SEEN // 8, np.uint8)  # a bit for each hash
        self.ids: dict[bytes, int] = {}
        self.strings, self.ends = array("i"), array("q")  # the buckets of all words' strings, and where each word's end
        self.held = np.zeros((2, FOLDS, BUCKETS), np.uint16 if docs < 1 << 16 else np.int32)
        self.docs: list[tuple[int, int, np.ndarray]] = []

    def fresh(self, words: list[bytes]) -> list[bytes]:
        """The words that no earlier text had between the same two words."""
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[:-1]])
        first, last = np.concatenate([starts[:1], starts[:-1]]), np.concatenate([ends[1:], ends[-1:]])
        h = spans(prefixes(b" ".join(words) + b" "), first, last) % np.uint64(SEEN)
        byte, bit = (h >> np.uint64(3)).astype(np.int64), np.uint8(1) << (h & np.uint64(7)).astype(np.uint8)
        new = np.flatnonzero(self.seen[byte] & bit == 0)
        np.bitwise_or.at(self.seen, byte, bit)
        return [words[i] for i in new.tolist()]

    def known(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers; the buckets of their strings, by length and then by place, are kept under them."""
        new = [w for w in dict.fromkeys(words) if w not in self.ids]
        if new:
            datas = [b" " + w[:WORD_BYTES] + b" " for w in new]
            lens = [len(x) for x in datas]
            places = [places_of(n) for n in lens]
            at = np.repeat(np.cumsum([0, *lens[:-1]]), [len(x) for x, _ in places])
            start, end = (np.concatenate([x[i] for x in places]) + at for i in (0, 1))
            last = len(self.strings)
            self.strings.frombytes((spans(prefixes(b"".join(datas)), start, end) % np.uint64(BUCKETS)).astype(np.int32).tobytes())
            self.ends.extend((last + np.cumsum([len(x) for x, _ in places])).tolist())
            for w in new:
                self.ids[w] = len(self.ids)
        return np.array([self.ids[w] for w in words], np.int32)

    def buckets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of the words' strings, one word's after the other's, and how many each word has."""
        ends, strings = np.frombuffer(self.ends, np.int64), np.frombuffer(self.strings, np.int32)
        start = np.where(ids > 0, ends[ids - 1], 0)
        n = ends[ids] - start
        return strings[np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())], n

    def add(self, text: str | None, kind: int, fold: int) -> None:
        words = lowered(text)
        ids = self.known(self.fresh(words)) if words else np.empty(0, np.int32)
        self.docs.append((kind, fold, ids))
        if len(ids):
            self.held[kind, fold, np.unique(self.buckets(np.unique(ids))[0])] += 1

    def parts(self, without: int | None) -> list[bytes]:
        """For each toxic document with any, the parts of its fresh words that are in excess, in order; a fold may be left out.
        A word's part lies under its strings in excess. Parts are then counted themselves, over all words, so that a
        string that is in excess only by being inside of a stronger one has none."""
        docs = [(kind, ids) for kind, fold, ids in self.docs if fold != without]
        nt = sum(kind for kind, _ in docs)
        no = len(docs) - nt
        inside = [f for f in range(FOLDS) if f != without]
        roots = np.empty(BUCKETS, np.float32)
        for at in range(0, BUCKETS, SLICE):
            held = self.held[:, inside, at : at + SLICE].sum(axis=1, dtype=np.int64)
            roots[at : at + SLICE] = excess(held[1], held[0], nt, no)
        names: dict[bytes, int] = {}
        words = list(self.ids)
        of = np.full(len(words), -1, np.int64)
        for at in range(0, len(words), SLICE):
            buckets, n = self.buckets(np.arange(at, min(at + SLICE, len(words))))
            found = roots[buckets]
            some, ends = np.flatnonzero(n), np.cumsum(n)
            most = np.maximum.reduceat(found, ends[some] - n[some]) if len(some) else np.empty(0, np.float32)
            for i, m in zip(some[most > LEAST_ROOT].tolist(), most[most > LEAST_ROOT], strict=True):
                of[at + i] = names.setdefault(under(words[at + i], found[ends[i] - n[i] : ends[i]] >= NEAR * m), len(names))
        counts = np.zeros((2, len(names)))
        for kind, ids in docs:
            x = np.unique(of[ids])
            counts[kind, x[x >= 0]] += 1
        strong = excess(counts[1], counts[0], nt, no) > LEAST_ROOT
        every = list(names)
        found = [[every[x] for x in of[ids].tolist() if x >= 0 and strong[x]] for kind, ids in docs if kind]
        return [b"".join(x) for x in found if x]


@cache
def places_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the strings of n bytes, by length and then by place."""
    start = [np.arange(n - g + 1) for g in GRAMS if g <= n]
    return (np.concatenate(start), np.concatenate([x + g for x, g in zip(start, GRAMS, strict=False)])) if start else (np.empty(0, np.int64),) * 2


def excess(ct: np.ndarray, co: np.ndarray, nt: int, no: int) -> np.ndarray:
    """The root of the log-likelihood ratio of ct of nt toxic and co of no ordinary documents, 0 where not in excess."""
    out = np.zeros(len(ct), np.float32)
    at = np.flatnonzero(ct * no > LEAST_LIFT * (co + 0.5) * nt)
    ct, co = ct[at].astype(float), co[at].astype(float)
    share = (co + ct) / max(1, no + nt)
    total = np.zeros(len(at))
    for found, expected in ((ct, nt * share), (nt - ct, nt * (1 - share)), (co, no * share), (no - co, no * (1 - share))):
        total += np.where(found > 0, found * np.log(np.maximum(found, 1e-9) / np.maximum(expected, 1e-9)), 0)
    out[at] = np.sqrt(np.maximum(0, 2 * total))
    return out


def under(word: bytes, flags: np.ndarray) -> bytes:
    """The longest run of a word's bytes under the flagged ones of its strings."""
    data, at = b" " + word[:WORD_BYTES] + b" ", 0
    marks = np.zeros(len(data) + 2, np.int8)
    for n in GRAMS:
        for i in range(len(data) - n + 1):
            if flags[at]:
                marks[i + 1 : i + 1 + n] = 1
            at += 1
    edges = np.flatnonzero(np.diff(marks))
    return max((data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), key=len)


def first_copies(rows: list[tuple[object, str | None, int]]) -> list[tuple[object, str | None, int]]:
    """The rows without near copies of earlier ones of their kind, whose strings would seem to be in excess: those that
    share half of SKETCH MinHash values of 5-word shingles, or more, with what went before."""
    seeds = (np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    seen: set[tuple[int, int, int]] = set()
    out = []
    for r in rows:
        x = shingle_set(r[1])
        least = {(r[2], i, int(v)) for i, v in enumerate(mixed(x[None, :] ^ seeds).min(axis=1))} if len(x) else {(r[2], 0, 0)}
        if 2 * len(least & seen) < len(least):
            out.append(r)
        seen |= least
    return out


class Model:
    """Two dictionaries, what each number of saved bytes says, and the weights of the calibration."""

    def __init__(self, ordinary: bytes, toxic: bytes, telling: list[float] | None = None, weights: list[float] | None = None, constant: float | None = None):
        self.ordinary, self.toxic, self.telling, self.weights, self.constant = ordinary, toxic, telling, weights, constant
        self.made = None

    def state(self) -> tuple:
        """What makes the model again; workers get this."""
        return self.ordinary, self.toxic, self.telling, self.weights, self.constant

    def saved(self, texts: list[str | None]) -> np.ndarray:
        """Per text, how many of its windows the toxic dictionary shortens by 0, 1, ... MOST_SAVED or more bytes."""
        self.made = self.made or (compressor(self.ordinary), compressor(self.toxic + self.ordinary))
        own: list[int] = []
        ws: list[bytes] = []
        for i, t in enumerate(texts):
            x = windows(t)
            own += [i] * len(x)
            ws += x
        if not ws:
            return np.zeros((len(texts), MOST_SAVED + 1))
        lens = [np.fromiter((len(s) for s in c.multi_compress_to_buffer(ws, threads=0)), np.int64, len(ws)) for c in self.made]
        at = np.array(own) * (MOST_SAVED + 1) + np.clip(lens[0] - lens[1], 0, MOST_SAVED)
        return np.bincount(at, minlength=len(texts) * (MOST_SAVED + 1)).reshape(len(texts), -1).astype(float)

    def scores(self, texts: list[str | None]) -> list[float]:
        if self.constant is not None or not texts:
            return [self.constant or 0.0] * len(texts)
        return (1 / (1 + np.exp(-np.clip(features(self.saved(texts), self.telling) @ np.array(self.weights), -30, 30)))).tolist()


def features(saved: np.ndarray, telling: list[float]) -> np.ndarray:
    """Per text: 1, what its windows say in sum, the number of clear ones, the sum against its chance deviation, the
    logarithm of the number of windows, and that times the sum."""
    n, total = saved.sum(axis=1), saved @ np.array(telling)
    some, many = np.clip(total, -5, 15), np.log1p(n)
    return np.stack([np.ones(len(n)), some, np.minimum(saved[:, 3:].sum(axis=1), 20), total / np.sqrt(np.maximum(n, 1)), many, many * some / 10], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 50) -> list[float]:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if abs(step).max() < 1e-9:
            break
    return w.tolist()


def fit(rows: list[tuple[object, str | None, int]]) -> Model:
    """rows: doc_id, text, toxic."""
    kinds = {r[2] for r in rows}
    if kinds != {0, 1}:
        return Model(b"", b"", constant=0.5 if kinds == {1} else 0.0)
    rows = first_copies(rows)
    # trained before the counts are there, so that the driver never holds both
    ordinary = trained([w for _, t, kind in rows if not kind for w in windows(t)], DICTIONARY)
    counts, folds = Excess(len(rows)), [[] for _ in range(FOLDS)]
    for row in sorted(rows, key=lambda r: r[2]):  # ordinary texts first: what they share with toxic ones is theirs
        fold = zlib.crc32(f"{row[0]}/fold".encode()) % FOLDS
        folds[fold].append(row)
        counts.add(row[1], row[2], fold)

    def toxic(without: int | None) -> bytes:
        """Trained on the parts in excess or, if there is none, on the windows of the toxic texts."""
        whole = (w for f, part in enumerate(folds) if f != without for r in part if r[2] for w in windows(r[1]))
        return trained(counts.parts(without) or list(whole), TOXIC_DICTIONARY)

    final = toxic(None)
    saved, y = [], []
    for f, inside in enumerate(folds):
        if inside and any(r[2] for g in range(FOLDS) if g != f for r in folds[g]):
            saved.append(Model(ordinary, toxic(f)).saved([r[1] for r in inside]))
            y += [r[2] for r in inside]
    if len(set(y)) < 2:  # all toxic rows in one fold: no measure of the other folds' dictionaries
        saved, y = [Model(ordinary, final).saved([r[1] for r in rows])], [r[2] for r in rows]
    table, kind = np.concatenate(saved), np.array(y, float)
    share = [(c / np.maximum(c.sum(axis=1, keepdims=True), 1)).mean(axis=0) + 1e-4 for c in (table[kind == 0], table[kind == 1])]
    telling = np.log(share[1] / share[1].sum() * share[0].sum() / share[0])
    weights = logistic(features(table, telling), kind)
    weights[0] += np.log(PRIOR / (1 - PRIOR)) - np.log(kind.mean() / (1 - kind.mean()))
    return Model(ordinary, final, telling.tolist(), weights)


def sampled(docs: DataFrame, labels: DataFrame, most_docs: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """_id, _kind, _text: labelled rows to learn from, of each kind the first by a hash of the id, within the bounds; never
    held-out ones. A text that no longer fits is passed over; if none of a kind fits, the start of its first one stands
    for it. The driver sees ids and lengths only."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # ids and lengths alone choose the sample; texts are then picked out by a broadcast of at most 2 * most_docs ids
    sizes = docs.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("n"))
    known = known.where(crc_mod(F.col("doc_id"), 3) != 1).join(sizes, "doc_id")
    there = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen: dict[object, tuple[int, int]] = {}
    for kind in (0, 1):  # by a threshold on the hash: no task sends more than it adds to the sample
        part = known.where((F.col("toxic") == kind) & (share < most_docs / max(1, there.get(kind, 0)))).collect()
        part = sorted(part, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))[:most_docs]
        left, first = most_bytes, None
        for r in part:
            first = first or r["doc_id"]
            if (r["n"] or 0) <= left:
                left -= r["n"] or 0
                chosen[r["doc_id"]] = kind, r["n"] or 0
        if left == most_bytes and first is not None:
            chosen.setdefault(first, (kind, most_bytes))
    schema = T.StructType([T.StructField("_id", docs.schema["doc_id"].dataType), T.StructField("_kind", T.IntegerType())])
    ids = labels.sparkSession.createDataFrame([(i, kind) for i, (kind, _) in chosen.items()], schema)
    texts = docs.select(F.col("doc_id").alias("_id"), F.substring("text", 1, most_bytes).alias("_text")).join(F.broadcast(ids), "_id")
    return texts.groupBy("_id", "_kind").agg(F.max("_text").alias("_text"))  # one text of repeated ids


def ordered(rows: Iterable[tuple[object, str | None, int]]) -> list[tuple[object, str | None, int]]:
    return sorted(rows, key=lambda r: (r[2], r[0]))


def sample(docs: DataFrame, labels: DataFrame, most_docs: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES) -> list[tuple[object, str | None, int]]:
    """The rows of sampled: id, text and kind."""
    return ordered((r["_id"], r["_text"], r["_kind"]) for r in sampled(docs, labels, most_docs, most_bytes).toLocalIterator())


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """fit(sample(docs, labels)) in one task: its texts and counts take an executor's memory and none of the driver's."""

    def rows(batches):
        yield fit(ordered(r for b in batches for r in zip(b["_id"], b["_text"], b["_kind"], strict=True))).state()

    schema = "ordinary binary, toxic binary, telling array<double>, weights array<double>, constant double"
    found = map_rows(sampled(docs, labels).repartition(1), schema, rows).collect()
    if not found:  # no task ran
        return fit([])
    ordinary, toxic, *rest = found[0]
    return Model(bytes(ordinary), bytes(toxic), *rest)


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns, for every row of docs."""
    state = spark.sparkContext.broadcast(train(docs, labels).state())

    def rows(batches):
        model = Model(*state.value)
        for b in batches:
            for at in range(0, len(b["text"]), 256):
                for doc, held, s in zip(b["doc_id"][at : at + 256], b["held_out"][at : at + 256], model.scores(b["text"][at : at + 256]), strict=True):
                    yield doc, held, s, int(s >= THRESHOLD)

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    return map_rows(texts, f"doc_id {kind}, held_out boolean, score double, predicted int", rows)


def without_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose score reaches the threshold; columns unchanged."""
    state = spark.sparkContext.broadcast(train(docs, labels).state())
    made: list[Model] = []

    def mask(b: dict) -> list[bool]:
        if not made:
            made.append(Model(*state.value))
        return [s < THRESHOLD for at in range(0, len(b["text"]), 256) for s in made[0].scores(b["text"][at : at + 256])]

    return keep_rows(docs, ["text"], mask)
