"""Hidden Markov language model: Baum-Welch counts summed over partitions train the states, and a scaled forward
recursion over the whole text gives its likelihood exactly.

A state emits a symbol. The most frequent words are symbols of their own, every other word belongs to a symbol by a hash
of its ending, and a word's probability within its symbol comes from the corpus counts, so that every word of the corpus
counts and an unknown word has a probability as well. Training starts from a bounded sample and then passes over all
training texts; in training, a text is cut into pieces of PIECE tokens that start from a learned distribution.

Word counts grow with the corpus and stay distributed: the HOT most frequent words are broadcast, and the rest, none of
which is frequent, is joined.

Defined results: a null text is an empty one, which has its end token only; repeated rows are scored alike and each
count in training; without training rows all words are unknown and states are as they start; no rows give no rows."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Scratch, crc_mod, map_rows, utf8

#: Broadcast words (none longer than LONGEST bytes), of which SINGLES are symbols; symbols for the endings of others.
HOT, LONGEST, SINGLES, ENDINGS = 1 << 16, 64, 2048, 1024
STATES, PASSES = 8, 4
#: The sample training starts from, and its passes. All training texts follow.
SAMPLE_DOCS, SAMPLE_TOKENS, SAMPLE_PASSES = 400, 400_000, 25
PIECE = 256
#: Pieces that training holds side by side: a batch of texts has many more, and each token takes two numbers a state.
ABREAST = 1 << 10
END = "\n"
SMOOTH = 0.05
#: Words that a task counts before it hands them on, and tokens that it scores together.
FLUSH, TOGETHER = 400_000, 1 << 20
UNITS = 1 << 12


def tokens(text: str | None) -> list[bytes]:
    return utf8(text).translate(LOWER).split()


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def counted(docs: DataFrame) -> DataFrame:
    """w, c: how often each token, the end included, occurs. Tasks count before the shuffle."""

    def rows(batches):
        c: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                c.update(tokens(t))
                c[END.encode()] += 1
                if len(c) > FLUSH:
                    yield from ((w.decode("utf-8", "replace"), n) for w, n in c.items())
                    c.clear()
        yield from ((w.decode("utf-8", "replace"), n) for w, n in c.items())

    return map_rows(docs.select("text"), "w string, n bigint", rows, 20_000).groupBy("w").agg(F.sum("n").alias("c"))


class Vocabulary:
    """What is broadcast of the counts: hot words, symbol sums, and the corpus totals."""

    def __init__(self, hot: list[tuple[str, int]], end: int, sums: dict[int, tuple[int, int]], n: int, v: int):
        self.hot, self.end, self.sums, self.n, self.v = hot, end, sums, n, v
        words = [w.encode() for w, _ in hot]
        self.index = {w: i for i, w in enumerate(words)}
        self.symbols = SINGLES + ENDINGS + 1
        symbol = [i if i < SINGLES else SINGLES + ending(w) for i, w in enumerate(words)]
        self.symbol = np.array([*symbol, 0], np.int16)
        self.base = np.array([*(self.log_base(c) for _, c in hot), 0.0])
        self.within = np.array([*(self.log_within(s, c) for s, (_, c) in zip(symbol, hot, strict=True)), 0.0])

    def state(self) -> tuple:
        return self.hot, self.end, self.sums, self.n, self.v

    def log_base(self, c: int) -> float:
        return math.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))

    def log_within(self, symbol: int, c: int) -> float:
        if symbol < SINGLES:
            return 0.0
        s, v = self.sums.get(symbol, (0, 0))
        return math.log10((c + 0.5) / (s + 0.5 * (v + 1)))


def vocabulary(counts: DataFrame) -> Vocabulary:
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    end = counts.where(F.col("w") == END).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    # the most frequent words by classes of frequency, as many whole classes as HOT holds: no task sends more than that
    level = F.floor(F.log2("c") * 64)
    able = counts.where((F.octet_length("w") <= LONGEST) & (F.col("w") != END))
    least, held = 1 << 30, 0
    for r in sorted(able.groupBy(level.alias("k")).count().collect(), key=lambda r: -r["k"]):
        if held + r["count"] > HOT:
            break
        least, held = r["k"], held + r["count"]
    hot = sorted(((r["w"], r["c"]) for r in able.where(level >= least).collect()), key=lambda x: (-x[1], x[0]))
    single = {w for w, _ in hot[:SINGLES]}

    def rows(batches):
        for b in batches:
            for w, c in zip(b["w"], b["c"], strict=True):
                if w != END and w not in single:
                    yield SINGLES + ending(w.encode()), c

    of = map_rows(counts, "symbol int, c bigint", rows, 20_000).groupBy("symbol").agg(F.sum("c").alias("s"), F.count(F.lit(1)).alias("v"))
    return Vocabulary(hot, end, {r["symbol"]: (r["s"], r["v"]) for r in of.collect()}, n, v)


def encoded(docs: DataFrame, state) -> DataFrame:
    """Per row: its symbols, the parts of the scores that hot words settle, and its other words with their counts."""

    def rows(batches):
        voc = Vocabulary(*state.value)
        none = len(voc.hot)
        stop = np.array([SINGLES + ENDINGS], np.int16)
        for b in batches:
            for row, doc, held, t in zip(b["row"], b["doc_id"], b["held_out"], b["text"], strict=True):
                ws = tokens(t)
                at = np.fromiter(map(voc.index.get, ws, repeat(none)), np.int64, len(ws))
                symbols = voc.symbol[at]
                rare = np.flatnonzero(at == none)
                c = Counter()
                for i in rare.tolist():
                    w = ws[i]
                    symbols[i] = SINGLES + ending(w)
                    c[w] += 1
                base = float(voc.base[at].sum()) + voc.log_base(voc.end)
                known = len(ws) - len(rare) + (voc.end > 0)
                yield row, doc, held, len(ws) + 1, known, base, float(voc.within[at].sum()), np.concatenate([symbols, stop]).tobytes(), [{"w": w.decode("utf-8", "replace"), "n": n, "symbol": SINGLES + ending(w)} for w, n in c.items()]

    schema = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, within double, symbols binary, rare array<struct<w string, n int, symbol int>>"
    return map_rows(docs.select("row", "doc_id", "held_out", "text"), schema, rows, 500)


class Hmm:
    """start: of texts; again: of later pieces; move: state to state; emit: state to symbol."""

    def __init__(self, start: np.ndarray, again: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.again, self.move, self.emit = start, again, move, emit

    @staticmethod
    def random(symbols: int, states: int = STATES, seed: int = 5) -> Hmm:
        r = np.random.default_rng(seed)
        part = lambda *shape: (x := r.random(shape) + 0.5) / x.sum(-1, keepdims=True)
        return Hmm(part(states), part(states), 0.7 * np.eye(states) + 0.3 * part(states, states), part(states, symbols))

    def state(self) -> tuple:
        return self.start, self.again, self.move, self.emit

    def log10(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 of each text's likelihood by the scaled forward recursion; texts go side by side, the longest first."""
        out = np.zeros(len(texts))
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        lens = np.array([len(texts[i]) for i in order])
        if not len(lens):
            return out
        flat = np.concatenate([texts[i] for i in order]).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
        emit = np.ascontiguousarray(self.emit.T)
        active = np.searchsorted(-lens, -np.arange(1, lens[0] + 1), side="right")  # how many texts have a t-th token
        ll, alpha = np.zeros(len(lens)), None
        for t, d in enumerate(active):
            alpha = self.start * emit[flat[starts[:d]]] if t == 0 else (alpha[:d] @ self.move) * emit[flat[starts[:d] + t]]
            scale = alpha @ np.ones(len(self.start))
            alpha /= scale[:, None]
            ll[:d] += np.log10(scale)
        out[order] = ll
        return out

    def counts(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, piece starts, moves and emissions (Baum-Welch's E step)."""
        k, n = len(self.start), self.emit.shape[1]
        start, again, move, emitted = totals = np.zeros(k), np.zeros(k), np.zeros((k, k)), np.zeros((n, k))
        pieces = [(x[at : at + PIECE], at == 0) for x in texts for at in range(0, len(x), PIECE)]
        pieces.sort(key=lambda p: -len(p[0]))
        for at in range(0, len(pieces), ABREAST):
            for total, x in zip(totals, self.counts_abreast(pieces[at : at + ABREAST]), strict=True):
                total += x
        return start, again, move * self.move, emitted.T

    def counts_abreast(self, pieces: list[tuple[np.ndarray, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The counts of pieces that go side by side, the longest first; moves lack their factor, emissions lie by symbol.
        Two numbers for each token and state are all that is held."""
        k, n = len(self.start), self.emit.shape[1]
        move, emitted = np.zeros((k, k)), np.zeros((n, k))
        lens = np.array([len(p) for p, _ in pieces])
        first = np.array([f for _, f in pieces])
        flat = np.concatenate([p for p, _ in pieces]).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
        active = np.searchsorted(-lens, -np.arange(1, lens[0] + 1), side="right")
        steps = [slice(end - d, end) for end, d in zip(np.cumsum(active).tolist(), active.tolist(), strict=True)]
        emit, one = np.ascontiguousarray(self.emit.T), np.ones(k)
        # by step: symbols; states given the tokens so far, later given all; emissions over the scale
        symbols, alphas, scaled = np.empty(len(flat), np.int64), np.empty((len(flat), k)), np.empty((len(flat), k))
        for t, (d, s) in enumerate(zip(active, steps, strict=True)):
            symbols[s] = flat[starts[:d] + t]
            b, alpha = scaled[s], alphas[s]
            b[:] = emit[symbols[s]]
            alpha[:] = np.where(first[:, None], self.start, self.again) if t == 0 else alphas[steps[t - 1]][:d] @ self.move
            alpha *= b
            scale = (alpha @ one)[:, None]
            alpha /= scale
            b /= scale
        beta = np.ones((0, k))
        for t in range(len(steps) - 1, -1, -1):
            d, gamma, back = active[t], alphas[steps[t]], scaled[steps[t]]
            beta = np.concatenate([beta, np.ones((d - len(beta), k))])
            gamma *= beta
            back *= beta
            if t:
                move += alphas[steps[t - 1]][:d].T @ back
                beta = back @ self.move.T
        gamma = alphas[steps[0]]
        for i in range(k):
            emitted[:, i] = np.bincount(symbols, alphas[:, i], n)
        return gamma[first].sum(0), gamma[~first].sum(0), move, emitted

    def improved(self, start: np.ndarray, again: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Hmm:
        """The M step; smoothed, so that nothing is impossible."""
        part = lambda x, s: (x + s) / (x + s).sum(-1, keepdims=True)
        return Hmm(part(start, 1.0), part(again, 1.0), part(move, 1.0), part(emit, SMOOTH))


def arrays(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int16) for x in column]


def parts(texts: list[np.ndarray]):
    """Slices of texts with about TOGETHER tokens."""
    at, n = 0, 0
    for i, x in enumerate(texts):
        n += len(x)
        if n >= TOGETHER:
            yield slice(at, i + 1)
            at, n = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def one_pass(spark: SparkSession, train: DataFrame, model: Hmm) -> Hmm:
    """Baum-Welch over all training rows. Counts are summed as whole units, so their order doesn't matter."""
    state, shape = spark.sparkContext.broadcast(model.state()), model.emit.shape

    def rows(batches):
        hmm, total = Hmm(*state.value), None
        for b in batches:
            texts = arrays(b["symbols"])
            for s in parts(texts):
                got = np.concatenate([np.rint(x * UNITS).astype(np.int64).ravel() for x in hmm.counts(texts[s])])
                total = got if total is None else total + got
        if total is not None:
            yield from ((i, int(total[i])) for i in np.flatnonzero(total).tolist())

    sums = map_rows(train.select("symbols"), "i int, v bigint", rows, 20_000).groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(2 * shape[0] + shape[0] ** 2 + shape[0] * shape[1])
    for r in sums:
        flat[r["i"]] = r["v"] / UNITS
    state.destroy()
    k = shape[0]
    return model.improved(flat[:k], flat[k : 2 * k], flat[2 * k : 2 * k + k * k].reshape(k, k), flat[2 * k + k * k :].reshape(shape))


def bounded(rows: DataFrame) -> list[np.ndarray]:
    """Texts of SAMPLE_TOKENS tokens in all. A text that does not fit is passed over; if none fits, the start of one."""
    sample, spare, n = [], [], 0
    for r in rows.select(F.substring("symbols", 1, 2 * SAMPLE_TOKENS + 2).alias("symbols")).toLocalIterator():
        x = arrays([r[0]])[0]
        if n + len(x) <= SAMPLE_TOKENS:
            n += len(x)
            sample.append(x)
        elif not spare:
            spare.append(x[:SAMPLE_TOKENS])
    return sample or spare


def trained(spark: SparkSession, train: DataFrame, symbols: int) -> Hmm:
    model, there = Hmm.random(symbols), train.count()
    if not there:
        return model
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    # few ids may all have a hash beyond the threshold
    sample = bounded(train.where(share < SAMPLE_DOCS / there)) or bounded(train.limit(SAMPLE_DOCS))
    for _ in range(SAMPLE_PASSES):
        model = model.improved(*model.counts(sample))
    for _ in range(PASSES):
        model = one_pass(spark, train, model)
    return model


def scored(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's columns, for every row of docs."""
    scratch = Scratch(spark, "hmm")
    docs = docs.select("doc_id", "text").withColumn("held_out", crc_mod(F.col("doc_id"), 5) == 1).withColumn("row", F.monotonically_increasing_id())
    counts = scratch.keep(counted(docs.where(~F.col("held_out"))), "counts")
    voc = vocabulary(counts)
    texts = scratch.keep(encoded(docs, spark.sparkContext.broadcast(voc.state())), "texts")
    model = trained(spark, texts.where(~F.col("held_out")), voc.symbols)
    state = spark.sparkContext.broadcast(model.state())

    def forward(batches):
        hmm = Hmm(*state.value)
        for b in batches:
            symbols = arrays(b["symbols"])
            for s in parts(symbols):
                lls = hmm.log10(symbols[s]).tolist()
                for *row, ll in zip(b["row"][s], b["doc_id"][s], b["held_out"][s], b["n_tokens"][s], b["known"][s], b["base"][s], b["within"][s], lls, strict=True):
                    yield *row, ll

    whole = map_rows(texts.drop("rare"), "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, within double, ll double", forward)
    # the other words: their counts are joined, an unknown one has none
    zero = math.log10(0.5)
    floor = math.log10(voc.n + 0.5 * (voc.v + 1)) if voc.n + voc.v else zero
    of = spark.createDataFrame([(k, math.log10(n + 0.5 * (v + 1))) for k, (n, v) in voc.sums.items()], "symbol int, of double")
    rare = texts.select("row", F.inline("rare")).join(counts, "w", "left").join(F.broadcast(of), "symbol", "left")
    log = F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))
    other = rare.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("k2"), F.sum(F.col("n") * (log - floor)).alias("b2"), F.sum(F.col("n") * (log - F.coalesce("of", F.lit(zero)))).alias("w2")
    )
    out = whole.join(other, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("k2", F.lit(0))).alias("n_known"), F.lit(voc.n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("b2", F.lit(0.0))).alias("base_score"), (F.col("ll") + F.col("within") + F.coalesce("w2", F.lit(0.0))).alias("score"),
    )
