"""Quality rules by weak supervision, in DataFrame functions alone.

Each rule votes good, votes bad or abstains on a text's statistics. Votes are counted by pattern over all documents;
expectation-maximisation over those counts, of which there are at most 3 to the number of rules, estimates how often
each rule votes what for good and for bad texts; a text is kept if its posterior probability of being good reaches
the threshold and the base rules do not fail it.

Defined results: a null or empty text has no words, all counts are 0 and it fails the base rules; repeated rows are
judged alike; an empty table gives no rows; extra columns are ignored or, in kept_rows(), kept."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, masked

#: Blanks of the contract's words, and its symbols. Fixed values.
BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
THRESHOLD = 0.5
#: Steps of the expectation-maximisation; the prior, which counts as this share of the texts in either class, and from
#: which it starts: rules err seldom on good texts, and a bad text fails few of them. Share of good texts at the start.
STEPS, PRIOR, START = 60, 0.1, 0.85
BAD, GOOD = {-1: 0.2, 0: 0.1, 1: 0.7}, {-1: 0.005, 0: 0.1, 1: 0.895}


#: Rules: what a rule looks at, the values for which it votes bad (over, or under), and for which it votes good.
RULES = {
    "symbols": ("sym", {"over": 0.1}, {"under": 0.02}),
    "repeats": ("rep", {"over": 0.3}, {"under": 0.1}),
    "line_copies": ("dup", {"over": 0.4}, {"under": 0.2}),
    "long_words": ("len", {"over": 6.4}, {"under": 5.8}),
    "short_words": ("len", {"under": 3.5}, {"over": 4.0}),
    "capitals": ("cap", {"over": 0.3}, {"under": 0.1}),
    "letterless": ("bare", {"over": 0.1}, {"under": 0.02}),
    "marks": ("mark", {"over": 0.5}, {"under": 0.1}),
    "size": ("words", {"under": 50}, {"over": 99}),
}


def measured(docs: DataFrame) -> DataFrame:
    """docs with the contract's counts and what the rules look at, in the struct `q`; one narrow pass."""
    kept = docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    names = {n: f"_{n}_of_quality" for n in ("w", "h", "l", "g", "p")}
    w, h, lines, g, p = (F.col(n) for n in names.values())
    out = docs.withColumn(names["w"], F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), ""))
    gram = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    out = out.withColumn(names["h"], F.when(F.size(w) >= 4, F.transform(F.sequence(F.lit(0), F.size(w) - 3), gram)))
    out = out.withColumn(names["l"], F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    # windows that repeat: sorted by hash and place, equal ones are neighbours; texts without any are not sorted
    placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    out = out.withColumn(names["g"], F.when(F.size(F.array_distinct(h)) < F.size(h), placed))
    same = F.filter(g, lambda x, j: (F.get(g, j - 1)["h"] == x["h"]) | (F.get(g, j + 1)["h"] == x["h"]))
    out = out.withColumn(names["p"], F.sort_array(F.transform(same, lambda x: x["i"])))
    # the first place covers 3 words, each next one what lies beyond the one before
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(p, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])
    q = F.struct(
        F.size(w).cast("bigint").alias("n_words"),
        F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.size(lines).cast("bigint").alias("n_lines"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("bigint").alias("n_capitals"),
        F.size(F.filter(w, lambda x: ~x.rlike(r"[\p{L}\p{N}]"))).cast("bigint").alias("n_letterless"),
        F.regexp_count(text, F.lit("[!?]")).cast("bigint").alias("n_marks"),
    )
    return out.select(*kept, q.alias("q"))


def base_failed() -> Column:
    return (F.col("q.n_words") < LEAST_WORDS) | (100 * F.col("q.n_repeat_words") > MOST_REPEATED * F.col("q.n_words"))


def votes() -> Column:
    """An array with each rule's vote: 1 good, -1 bad, 0 abstains."""
    n = lambda c: F.greatest(F.lit(1), F.col(f"q.{c}")).cast("double")
    looked = {
        "sym": F.col("q.n_symbols") / n("n_words"), "rep": F.col("q.n_repeat_words") / n("n_words"), "dup": F.col("q.n_dup_lines") / n("n_lines"), "len": F.col("q.word_chars") / n("n_words"),
        "cap": F.col("q.n_capitals") / n("word_chars"), "bare": F.col("q.n_letterless") / n("n_words"), "mark": F.col("q.n_marks") / n("n_words"), "words": F.col("q.n_words").cast("double"),
    }
    test = lambda x, when: x > when["over"] if "over" in when else x < when["under"]
    return F.array(*[F.when(test(looked[c], bad), -1).when(test(looked[c], good), 1).otherwise(0) for c, bad, good in RULES.values()])


def learned(patterns: list[tuple[list[int], int]], steps: int = STEPS) -> dict[tuple[int, ...], float]:
    """The posterior probability of good for each pattern of votes, from patterns and their counts."""
    rules = range(len(RULES))
    good = START
    # how often a rule votes -1, 0, 1 for bad and for good texts
    table = [[BAD for _ in rules], [GOOD for _ in rules]]

    def posterior(v: tuple[int, ...]) -> float:
        odds = math.log(good / (1 - good)) + sum(math.log(table[1][r][v[r]] / table[0][r][v[r]]) for r in rules)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))

    total = sum(c for _, c in patterns)
    for _ in range(steps if total else 0):
        share = [(tuple(v), c, posterior(tuple(v))) for v, c in patterns]
        mass = sum(c * p for _, c, p in share)
        for k, of, whole, prior in ((0, lambda p: 1 - p, total - mass, BAD), (1, lambda p: p, mass, GOOD)):
            for r in rules:
                seen = {x: sum(c * of(p) for v, c, p in share if v[r] == x) for x in (-1, 0, 1)}
                table[k][r] = {x: (seen[x] + PRIOR * total * prior[x]) / (whole + PRIOR * total) for x in seen}
        good = (mass + PRIOR * total * START) / (total + PRIOR * total)
    return {tuple(v): posterior(tuple(v)) for v, _ in patterns}


def judged(spark: SparkSession, docs: DataFrame, whole: bool = True) -> DataFrame:
    """docs with `q`, and `p_good`, the posterior of each text's votes. Texts are measured once, into a scratch table."""
    rows = measured(docs).withColumn("_votes_of_quality", votes())
    rows = Scratch(spark, "quality").keep(rows if whole else rows.drop("text"), "measured")
    counts = [(tuple(r[0]), r[1]) for r in rows.groupBy("_votes_of_quality").count().collect()]
    known = spark.createDataFrame([(list(v), p) for v, p in sorted(learned(counts).items())], "_v_of_quality array<int>, p_good double")
    return rows.join(F.broadcast(known), F.col("_votes_of_quality") == F.col("_v_of_quality")).drop("_votes_of_quality", "_v_of_quality")


def kept() -> Column:
    return ~base_failed() & (F.col("p_good") >= THRESHOLD)


def verdicts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    out = judged(spark, docs.select("doc_id", "text"), whole=False)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("doc_id", *[F.col(f"q.{n}").alias(n) for n in names], base_failed().alias("base_failed"), kept().alias("kept"), F.col("p_good"))


def kept_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without the rows that are not kept; columns unchanged."""
    plain = masked(docs)
    return judged(spark, plain).where(kept()).select(*plain.columns).toDF(*docs.columns)
