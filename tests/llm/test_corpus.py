"""Corpus operators against brute force and round trips, on small tables with every odd case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from readloom.llm import chat, decontaminate, hmm, mixing, near, pii, quality, repeats, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n, seed):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


BASE = words(120, 1)


def prose(n, seed):
    import random

    return " ".join(random.Random(seed).choice(BASE.split()) for _ in range(n))


DOCS = [
    (1, BASE, "a"), (2, BASE, "a"), (3, BASE.replace(" ", "\n", 3) + " tail", None), (4, None, "b"), (5, "", "b"), (6, "one two", "b"),
    (7, words(3000, 2), "c"), (8, words(40, 3) + " " + BASE[:400] + " " + words(40, 4), "a"), (9, "x " * 300, "c"), (1, BASE, "a"), (None, words(30, 5), "a"), (-4, "é" * 500, "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*d, 1, 2) for d in DOCS], "doc_id bigint, text string, source string, size int, k int").repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_repeats(spark, docs, none):
    data = [(d[0], (d[1] or "").encode()) for d in DOCS]
    seen = Counter(b[i : i + 200] for _, b in data for i in range(len(b) - 199))
    want = []
    for doc, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        runs = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        want.append((doc, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    assert by_id(repeats.deduplicated(spark, docs)) == sorted(want, key=str)
    assert repeats.deduplicated(spark, none).count() == 0


def test_merged_transform_groups_shared_prefixes():
    """At every depth: exactly the suffixes that share their first symbols with another, in order, one group a prefix."""
    texts = [b"banana", b"ananas", b"bananas", b"nab", b"banana"]
    made = [repeats.bwt_of(texts[:2]), repeats.bwt_of(texts[2:])]
    for part, (_, ts, os) in zip((texts[:2], texts[2:]), made, strict=True):
        assert [part[t][o:] for t, o in zip(ts, os, strict=True)] == sorted(t[i:] for t in part for i in range(len(t) + 1))
    at = [(t, o) for part, (_, ts, os) in zip((0, 2), made, strict=True) for t, o in zip((ts + part).tolist(), os.tolist(), strict=True)]
    for depth in range(1, 8):
        place, group = repeats.merged_groups([m[0] for m in made], depth)
        starts = [texts[t][o : o + depth] for t, o in (at[p] for p in place.tolist())]
        seen = Counter(t[i : i + depth] for t in texts for i in range(len(t) - depth + 1))
        assert starts == sorted(starts) and Counter(starts) == {k: n for k, n in seen.items() if n > 1}
        assert len(set(zip(starts, group.tolist(), strict=True))) == len(set(starts)) == len(set(group.tolist()))


def test_merge_takes_several_symbols_a_step(monkeypatch):
    """Few sorts to a depth of 200, and the same groups whatever the symbols' size and what is left of the depth."""
    r = random.Random(5)
    for letters in (b"ab", b"ab\xff"):
        core = bytes(r.choice(letters) for _ in range(300))
        texts = [core[:250], core[20:], b"a" * 90 + core[40:130], b"", b"a" * 70, core[100:]]
        made = [repeats.bwt_of(texts[:3]), repeats.bwt_of(texts[3:])]
        at = [(t + part, o) for part, (_, ts, os) in zip((0, 3), made, strict=True) for t, o in zip(ts.tolist(), os.tolist(), strict=True)]
        for depth in (9, 20, 25, 61, 200):
            calls, sort = [], np.argsort
            monkeypatch.setattr(repeats.np, "argsort", lambda *a, **k: calls.append(1) or sort(*a, **k))  # noqa: B023
            place, group = repeats.merged_groups([m[0] for m in made], depth)
            monkeypatch.undo()
            starts = [texts[t][o : o + depth] for t, o in (at[p] for p in place.tolist())]
            seen = Counter(t[i : i + depth] for t in texts for i in range(len(t) - depth + 1))
            assert starts == sorted(starts) and Counter(starts) == {k: n for k, n in seen.items() if n > 1}
            assert len(set(zip(starts, group.tolist(), strict=True))) == len(set(starts)) == len(set(group.tolist()))
            assert len(calls) <= 3 + depth // 7 + 9


def test_near(spark, docs, none):
    got = {(r["doc_id"], r["class_id"]) for r in near.joined(spark, docs).collect()}
    assert {(1, 1), (2, 1), (3, 1), (8, 8), (4, 4), (5, 5), (6, 6), (None, None)} <= got
    assert near.joined(spark, none).count() == 0
    kept = near.without_copies(spark, docs)
    assert kept.columns == docs.columns and kept.count() == len(DOCS) - 3


def test_near_chains(spark):
    """Copies of copies of one text, many just beyond the reach of a bucket's pivot: classes equal brute force."""
    import random

    from readloom.llm.shingles import shingle_set

    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 240):
        w = list(rows[r.randrange(max(0, i - 60), i)][1].split() if r.random() < 0.7 else base)
        for _ in range(r.choice([1, 2, 3, 3, 4, 5])):
            w[r.randrange(len(w))] = f"v{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    root, sets = list(range(len(rows))), [set(shingle_set(t).tolist()) for _, t in rows]
    for a, x in enumerate(sets):
        for b in range(a):
            common = len(x & sets[b])
            if 5 * common >= 4 * (len(x) + len(sets[b]) - common) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if c == high else c for c in root]
    got = near.joined(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {g["doc_id"]: g["class_id"] for g in got} == dict(enumerate(root))


def test_near_links_past_pivots(spark):
    """Each of 40 longer copies x of a text has a neighbour y that is similar to that x alone (168 of 210 shingles) and
    not to the text (167 of 210), so no pivot but x itself leads to it."""
    base = [f"w{i}" for i in range(192)]
    rows = [(0, " ".join(base))]
    for i in range(40):
        x = [*base, f"t{i}"]
        y = [f"y{i}x{j}" if 3 * i <= j - 30 < 3 * i + 17 else w for j, w in enumerate(x)]
        rows += [(1 + i, " ".join(x)), (101 + i, " ".join(y))]
    got = near.joined(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {g["class_id"] for g in got} == {0}


def test_decontaminate(spark, docs, none):
    bench = spark.createDataFrame([("p", " ".join(BASE.split()[:13])), ("q", "one two"), ("r", None), ("s", "...")], "item_id string, text string")
    found = {r["doc_id"]: r for r in decontaminate.digest(decontaminate.matches(spark, docs, bench)).collect()}
    assert found[2]["n_hit"] == 13 and found[2]["contaminated"] and found[6]["n_hit"] == 2 and found[4]["n_words"] == 0 and not found[7]["n_hit"]
    many = decontaminate.digest(decontaminate.matches(spark, docs, bench, pass_bytes=1))
    assert by_id(many) == by_id(decontaminate.digest(decontaminate.matches(spark, docs, bench)))
    assert decontaminate.matches(spark, none, bench).count() == 0
    assert decontaminate.clean(spark, docs, bench.limit(0)).count() == len(DOCS)


def test_mixing(spark, docs, none):
    rows = mixing.mixed(spark, docs).collect()
    assert len(rows) == len(DOCS)
    assert all(r["taken"] <= 3 * r["size"] and r["size"] <= r["source_size"] for r in rows)
    assert sum({(r["source_size"], r["target"]) for r in rows}, ()) and math.isclose(sum(t for _, t in {(r["source_size"], r["target"]) for r in rows}), sum(r["size"] for r in rows))
    assert by_id(mixing.mixed(spark, docs)) == by_id(mixing.mixed(spark, docs))
    assert mixing.mixed(spark, none).count() == 0
    assert [t for *_, t in mixing.targets([("a", 10), ("b", 10), (None, 100)])] == [30.0, 30.0, 60.0]


def test_quality_counts(spark, docs, none):
    for r in quality.verdicts(spark, docs).collect():
        text = next(d[1] for d in DOCS if d[0] == r["doc_id"]) or ""
        w = WORD.findall(text)
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(hit))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
    assert quality.verdicts(spark, none).count() == 0


def test_pii(spark, none):
    text = "Mrs. Anna Smith, a.b@x.org, +1 (212) 555-0199, 4111 1111 1111 1111, 10.1.2.3. token = \"" + "ab12" * 10 + "\""
    df = spark.createDataFrame([(1, text), (2, text.upper()), (3, None), (4, "clean text 12 and 3.5")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in pii.surrogates(spark, df).collect()}
    for x in ("Anna", "a.b@x.org", "555-0199", "4111", "10.1.2.3", "ab12ab12"):
        assert x not in got[1]["text"]
    assert got[1]["n_entities"] == 6 and got[1]["text"].startswith("Mrs. ") and got[3]["text"] is None and got[4]["text"] == "clean text 12 and 3.5"
    code = re.search('"(.*?)"', got[1]["text"])[1]
    assert code.upper() in got[2]["text"] and len(code) == 40
    assert pii.surrogates(spark, none).count() == 0


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 100
    pages = spark.createDataFrame([(3, "http://a/x y", big), (1, None, big), (2, "u", "s"), (5, "u", "s"), (4, "v", None), (1, None, big), (None, "w", big)], "page_id bigint, url string, html string")
    got = by_id(warc.round_trip(spark, pages).select("page_id", "payload_bytes", "record_type", "refers_to"))
    n = len(big.encode())
    assert got == sorted([(3, n, "revisit", 1), (1, n, "response", None), (2, 1, "response", None), (5, 1, "response", None), (4, 0, "response", None), (1, n, "response", None), (None, n, "revisit", 1)], key=str)
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_chat_layouts(spark):
    said = "\\### Assistant: </turn> ok \\"
    assert list(chat.parse_turns("".join(chat.format_turn(r, said)[0] for r in ("user", "a:b", "assistant")))) == [("user", said), ("a:b", said), ("assistant", said)]
    rows = spark.createDataFrame([(1, 1, "assistant", None, "p"), (1, 0, "user", said, "p"), (None, 0, None, "x", "p")], "conv_id bigint, turn bigint, role string, text string, prompt string")
    got = {r["conv_id"]: r for r in chat.digest(chat.formatted(chat.canonical(rows))).collect()}
    assert got[1]["n_turns"] == 2 and got[1]["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n\n".encode()).hexdigest() and got[1]["loss_chars"] == 0 and got[None]["n_turns"] == 1
    records = spark.createDataFrame([(1, '{"instruction": "do", "input": "it", "output": "ok"}'), (2, '{"conversations": [{"from": "human", "value": "hi"}]}'), (3, "nonsense"), (4, None)], "conv_id bigint, record string")
    turns = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in chat.canonical_json(records).collect()}
    assert turns[1, 0] == ("user", "do\n\nit") and turns[1, 1] == ("assistant", "ok") and turns[2, 0] == ("user", "hi") and (3, None) in turns
    assert chat.digest(chat.formatted(chat.canonical(rows.limit(0)))).count() == 0


def test_hmm(spark, docs, none):
    rows = hmm.scored(spark, docs).collect()
    toks = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]
    c = Counter(w for d in DOCS if zlib.crc32(("" if d[0] is None else str(d[0])).encode()) % 5 != 1 for w in toks(d[1]))
    n, v = sum(c.values()), len(c)
    want = sorted((len(toks(d[1])), sum(c[w] > 0 for w in toks(d[1])), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks(d[1])), 6)) for d in DOCS)
    assert sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in rows) == want
    assert all(r["score"] < 0 for r in rows)
    assert hmm.scored(spark, none).count() == 0


def test_hmm_likelihood_is_exact():
    import itertools

    import numpy as np

    m = hmm.Hmm.random(4, 3)
    x = np.array([0, 3, 1, 1, 2], np.int16)
    total = sum(math.prod([m.start[s[0]] * m.emit[s[0], x[0]], *(m.move[a, b] * m.emit[b, x[i + 1]] for i, (a, b) in enumerate(zip(s, s[1:], strict=False)))]) for s in itertools.product(range(3), repeat=5))
    assert math.isclose(m.log10([x])[0], math.log10(total), rel_tol=1e-9)


def test_toxicity(spark, docs, none):
    marks = [(100 + i, prose(60, i) + ("".join(" idiotic " + prose(20, 1000 * j + i) for j in range(1, 4)) if i % 2 else "")) for i in range(120)]
    df = spark.createDataFrame(marks, "doc_id bigint, text string")
    labels = spark.createDataFrame([(d, d % 2) for d, _ in marks] + [(7, None), (101, 1)], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r for r in toxicity.scored(spark, df.unionByName(docs.select("doc_id", "text")), labels).collect()}
    assert sum(got[d]["predicted"] == d % 2 for d, _ in marks) >= 115
    assert all(0 <= r["score"] <= 1 for r in got.values()) and toxicity.scored(spark, none, labels).count() == 0
    assert {r["score"] for r in toxicity.scored(spark, docs, labels.limit(0)).collect()} == {0.0}


def test_toxicity_of_a_skewed_lexicon(spark):
    """One insult is in every toxic text, nine others in few of them, some in one language only, and half of all rows
    are copies: held-out texts with any of the ten are caught, ordinary ones stay."""
    import random

    r = random.Random(3)
    insults = [f"insult{c}{c}" for c in "abcdefghij"]
    rows = []
    for i in range(900):
        w = prose(80, 7000 + i).split()
        if i % 3 == 0:
            for _ in range(3):
                w.insert(r.randrange(len(w)), insults[0] if r.random() < 0.4 else insults[r.randrange(1, 10)])
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, rows[3][1]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(str(i), int(i % 3 == 0)) for i in range(900)] + [(str(1000 + i), 1) for i in range(400)], "doc_id string, toxic int")
    got = [g for g in toxicity.scored(spark, df, labels).collect() if g["held_out"] and int(g["doc_id"]) < 900]
    bad = [g["predicted"] for g in got if int(g["doc_id"]) % 3 == 0]
    good = [g["predicted"] for g in got if int(g["doc_id"]) % 3]
    assert sum(bad) >= 0.9 * len(bad) and sum(good) <= 0.1 * len(good)
    # toxic rows only: nothing can be told apart, so nothing is rejected
    only = labels.where("toxic = 1")
    assert toxicity.without_toxic(spark, df, only).count() == df.count()


def test_toxicity_on_held_out_rows(spark):
    """Labelled rows that no model saw: most toxic ones are caught, nearly all ordinary ones stay."""
    from readloom.llm.common import table

    docs, labels = (table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    got = toxicity.scored(spark, docs, labels).where("held_out").join(labels.where("toxic is not null"), "doc_id")
    share = {r["toxic"]: r["s"] for r in got.groupBy("toxic").agg({"predicted": "avg"}).toDF("toxic", "s").collect()}
    assert share[1] >= 0.8 and share[0] <= 0.06


def test_pii_of_one_kind_alone(spark):
    """Each text's only mention has no three digits in a row, or is a code of over 128 or over 256 digits."""
    said = ["ab12" * 8, "AB12" * 10, "DE12AB1CDE2FGH3J", "41 11 11 11 11 11 11 11", "41-11-11-11-11-11-1", "ab12" * 40, "cd34" * 100]
    df = spark.createDataFrame([(i, f"see {x} there") for i, x in enumerate(said)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in pii.surrogates(spark, df).collect()}
    for i, x in enumerate(said):
        new = got[i]["text"][4:-6]
        assert got[i]["n_entities"] == 1 and x not in got[i]["text"] and len(new) == len(x), x
        assert got[i]["text"] == f"see {new} there"


def test_hmm_trains_past_a_huge_text(spark, monkeypatch):
    """A text beyond the sample's bound comes first, or alone, or no id is in the sample: the model is trained anyhow."""
    import numpy as np

    monkeypatch.setattr(hmm, "SAMPLE_TOKENS", 1000)
    huge, small = np.arange(3000, dtype=np.int16) % 7, np.arange(40, dtype=np.int16) % 5
    start = hmm.Hmm.random(8).emit
    for rows in ([(1, huge), (2, small)], [(1, huge)], [(3, small)] * 900, [(4, small)] * 900, [(5, small)] * 900):
        train = spark.createDataFrame([(d, bytearray(x.tobytes())) for d, x in rows], "doc_id bigint, symbols binary").coalesce(1)
        taken = hmm.bounded(train)
        assert 0 < sum(map(len, taken)) <= 1000
        if len(rows) == 2:
            assert [len(x) for x in taken] == [40]
        assert np.abs(hmm.trained(spark, train, 8).emit - start).max() > 0.01


def test_toxicity_sample_past_a_huge_text(spark):
    """A text beyond the bound shuts out no other row, and stands in part for its kind where it is the only one."""
    keep = [d for d in range(60) if zlib.crc32(str(d).encode()) % 3 != 1][:6]
    size = lambda d: 5000 if d in (keep[0], keep[1]) else 40
    df = spark.createDataFrame([(d, "x" * size(d)) for d in keep], "doc_id bigint, text string").coalesce(1)
    labels = spark.createDataFrame([(d, i % 2) for i, d in enumerate(keep)], "doc_id bigint, toxic int")
    got = toxicity.sample(df, labels, most_bytes=1000)
    assert sorted((d, len(t), y) for d, t, y in got) == sorted((d, 40, i % 2) for i, d in enumerate(keep) if i > 1)
    got = toxicity.sample(df, labels.where(f"toxic = 1 or doc_id = {keep[0]}"), most_bytes=1000)
    assert [(d, len(t)) for d, t, y in got if not y] == [(keep[0], 1000)]


def test_near_counts_all_links(spark, monkeypatch):
    """n_links of a large group of near copies, some of them repeated, equals brute force, in one block or in many."""
    import random

    from readloom.llm.shingles import shingle_set

    r = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = [" ".join(base)]
    for i in range(199):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 5])):
            w[r.randrange(len(w))] = f"v{r.randrange(10**6)}"
        rows.append(" ".join(w))
    sets = [set(shingle_set(t).tolist()) for t in rows]
    like = lambda x, y: 9 * len(x & y) >= 4 * (len(x) + len(y))
    of = near.joined(spark, spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).collect()
    want = {a: sum(a != b and like(x, y) for b, y in enumerate(sets)) for a, x in enumerate(sets)}
    assert max(want.values()) > 100
    assert {g["doc_id"]: g["n_links"] for g in of} == want
    monkeypatch.setattr(near, "BLOCK", 16)
    few = near.joined(spark, spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).collect()
    assert {g["doc_id"]: g["n_links"] for g in few} == want


def test_components_in_one_task_or_by_stars(spark, monkeypatch):
    """Links in any order and direction, repeated, in chains, rings and stars, or none at all."""
    from readloom.llm.common import Scratch

    r = random.Random(4)
    chain = [(i, i + 1) for i in range(100, 160)]
    edges = chain + [(y, x) for x, y in chain[::7]] + [(300, i) for i in range(301, 320)] + [(i, 299) for i in range(290, 299)] + [(299, 290), (5, 5), (160, 9), (1 << 40, 300)]
    edges += [(r.randrange(400, 600), r.randrange(400, 600)) for _ in range(80)]
    r.shuffle(edges)
    for some in (edges, []):
        least = {x: x for e in some for x in e}
        for _ in least:
            for x, y in some:
                least[x] = least[y] = min(least[x], least[y])
        df = spark.createDataFrame(some, "a bigint, b bigint").repartition(3)
        for most in (near.FEW_LINKS, 0):
            monkeypatch.setattr(near, "FEW_LINKS", most)
            got = near.components(Scratch(spark, "test"), df).collect()
            assert sorted(map(tuple, got)) == sorted((c, root) for c, root in least.items() if c != root), most


def test_near_keeps_few_rows_in_few_files(spark, monkeypatch):
    """However many shuffle partitions there are: what the rounds over large buckets keep of a small table is a file each,
    and its components take no steps."""
    from readloom.llm.common import Scratch

    r, kept, plain = random.Random(9), {}, Scratch.keep

    def keep(self, df, name, *more):
        out = plain(self, df, name, *more)
        kept.setdefault(name, len(out.inputFiles()))
        return out

    monkeypatch.setattr(Scratch, "keep", keep)
    monkeypatch.setattr(near, "SMALL", 2)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for _ in range(200):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 5])):
            w[r.randrange(len(w))] = f"v{r.randrange(10**6)}"
        rows.append(" ".join(w))
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "24"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = near.without_copies(spark, spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    sets, least = [set(zip(*(t.split()[i:] for i in range(5)))) for t in rows], list(range(200))  # noqa: B905
    for _ in range(20):
        for a, x in enumerate(sets):
            least[a] = min(least[b] for b, y in enumerate(sets) if 9 * len(x & y) >= 4 * (len(x) + len(y)))
    assert sorted(g["doc_id"] for g in got) == sorted(set(least)) and 1 < len(set(least)) < 100
    assert {"now0", "pivots0", "large1", "now1", "pivots1", "pairs1"} <= set(kept) and not any(name.startswith("star") for name in kept)
    assert [name for name, n in kept.items() if name.startswith(("reachable", "now", "pivots", "large", "pairs")) and name not in ("large", "pairs0") and n > 1] == []


def test_near_ends_its_rounds_early(spark, monkeypatch):
    """Most of a group is linked to its buckets' first pivots. Of the rest, neither alike nor few enough for SMALL, all
    pairs are fewer than the group's rows, so no further pivots are tried; classes and links equal brute force."""
    from readloom.llm.common import Scratch

    r, kept, plain = random.Random(4), set(), Scratch.keep

    def keep(self, df, name, *more):
        kept.add(name)
        return plain(self, df, name, *more)

    monkeypatch.setattr(Scratch, "keep", keep)
    base, rows = [f"w{i}" for i in range(150)], []
    for i in range(340):
        w = list(base)
        for at in r.sample(range(5, 75, 5), 1) if i < 300 else r.sample(range(75, 145, 5), 3):
            w[at] = f"v{i}x{at}"
        rows.append(" ".join(w))
    sets, least = [set(zip(*(t.split()[i:] for i in range(5)))) for t in rows], list(range(340))  # noqa: B905
    like = [[b for b, y in enumerate(sets) if 9 * len(x & y) >= 4 * (len(x) + len(y))] for x in sets]
    for _ in range(10):
        least = [min(least[b] for b in bs) for bs in like]
    want = sorted((i, least[i], len(like[i]) - 1) for i in range(340))
    assert len({x for _, x, _ in want}) > 15
    got = near.joined(spark, spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got)) == want
    assert "now1" in kept and "now2" not in kept


def test_clashing_names(spark):
    """Columns named as an operator's own are kept as they are, and string ids too."""
    names = ["q", "p_good", "_key", "_row", "_n", "_sig", "_m_of_pii", "n_mentions_of_pii", "_spans", "_c0", "Text"]
    rows = [(str(i), t, *[f"{n}{i}" for n in names]) for i, t in enumerate([BASE, BASE, prose(90, 5) + " call +1 212 555 0199", None, "x " * 300])]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in ["doc_id", "text", *names]))
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        bench = spark.createDataFrame([("a", prose(90, 5)), ("b", "x x")], "item_id string, text string")
        labels = spark.createDataFrame([("0", 0), ("2", 1)], "doc_id string, toxic int")
        for out, n in (
            (quality.kept_rows(spark, df), None), (near.without_copies(spark, df), 4), (pii.without_pii(spark, df), 5),
            (decontaminate.clean(spark, df, bench), 3), (toxicity.without_toxic(spark, df, labels), None),
        ):
            assert out.columns == df.columns
            got = out.collect()
            assert n is None or len(got) == n
            assert all(r[c] == f"{c}{r['doc_id']}" for r in got for c in names)
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_clean_drops_diluted_leaks(spark):
    """A whole window goes however long the text is; a short item's hits only if they are a twentieth of the words."""
    item, short = words(30, 11), "two words"
    texts = [words(2000, 12) + " " + " ".join(item.split()[4:17]) + " " + words(2000, 13), words(400, 14) + " two words", "two words " + words(20, 15), words(50, 16) + " " + " ".join(item.split()[4:16])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, item), (2, short)], "item_id bigint, text string")
    for most in (16 << 20, 8):
        assert sorted(r[0] for r in decontaminate.clean(spark, df, bench, most).collect()) == [1, 3]


def test_pii_coreference(spark):
    """One person or number has one surrogate in every form, with or without title; nothing of the old one is left."""
    said = [
        "Mr. Smith met Mr Smith and MR. SMITH.", "Mrs. Anna Smith, then Anna Smith, then Mrs. Smith and Smith's dog",
        "+1 212 555 0199, +1.212.555.0199, +1-212-555-0199", "4111 1111 1111 1111, 4111-1111-1111-1111", "Mr. John Smith and Mr. Peter Smith", "no one here",
    ]
    df = spark.createDataFrame(list(enumerate(said)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in pii.surrogates(spark, df).collect()}
    family = got[0].split()[1]
    assert got[0] == f"Mr. {family} met Mr {family} and MR. {family.upper()}."
    given = got[1].split()[1]
    assert got[1] == f"Mrs. {given} {family}, then {given} {family}, then Mrs. {family} and {family}'s dog"
    assert not re.search("smith|anna|john|peter|212|1111", " ".join(got.values()).lower().replace(given.lower(), ""))
    assert len({re.sub("[^0-9]", "", x) for x in got[2].split(", ")}) == 1 and [re.sub("[0-9]", "", x) for x in got[2].split(", ")] == ["+   ", "+...", "+---"]
    cards = {re.sub("[^0-9]", "", x) for x in got[3].split(", ")}
    digits = [int(x) for x in next(iter(cards))][::-1]
    assert len(cards) == 1 and sum(sum(divmod(d * (1 + i % 2), 10)) for i, d in enumerate(digits)) % 10 == 0
    first, second = re.match(rf"Mr\. (\S+) {family} and Mr\. (\S+) {family}$", got[4]).groups()
    assert first != second and got[5] == "no one here"
    other = {r["doc_id"]: r["text"] for r in pii.replaced(spark, df, "another key").collect()}
    assert all(other[i] != got[i] for i in range(5)) and other[5] == got[5]
    many = [(i, f"Mr. {chr(65 + i % 26)}{chr(97 + i // 26)}on Kept") for i in range(300)]
    out = [r["text"] for r in pii.surrogates(spark, spark.createDataFrame(many, "doc_id bigint, text string")).collect()]
    assert len(set(out)) == 300


def test_arc_files_of_other_origin():
    """Version 1 and 2, gzipped, with line-feed heads, other contents, equal records, bad lines and a short end."""
    import gzip
    import io

    about = b"1 0 Other\nURL IP-address Archive-date Content-type Archive-length\n"
    answer, dns = b"HTTP/1.0 200 OK\nServer: x\n\nbody", b"20010203040506\na. IN A 1.2.3.4\n"
    record = lambda url, kind, content, n=None: f"{url} 1.2.3.4 20010203040506 {kind} {n or len(content)}\n".encode() + content + b"\n"
    one = record("filedesc://x.arc", "text/plain", about) + record("http://a/b c", "text/html", answer) * 2 + b"no header here\nnor here\n" + record("dns:a.", "text/dns", dns) + record("http://z/", "text/html", answer, 999)
    got = list(warc.converted(gzip.compress(one), "x.arc"))
    assert [e is None for _, e in got] == [True, True, False, True, False] and "byte" in got[2][1] and "999" in got[4][1]
    fields = [f for f, _ in warc.warc_records(io.BytesIO(b"".join(r for r, _ in got if r)))]
    assert [f["WARC-Type"] for f in fields] == ["response", "response", "resource"] and len({f["WARC-Record-ID"] for f in fields}) == 3
    assert fields[0]["WARC-Target-URI"] == "http://a/b c" and fields[0]["WARC-Date"] == "2001-02-03T04:05:06Z" and fields[2]["Content-Type"] == "text/dns"
    assert fields[0]["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(b"body").hexdigest()
    two = warc.arc_archive(2, [("http://b/", "20020101000000", "text/html", b"HTTP/1.1 404 No\r\n\r\n")])
    ((r, e),) = warc.converted(two, "y.arc")
    assert e is None and b"WARC-Type: response" in r and not list(warc.converted(b"", "empty"))


def test_pii_plans_stay_small(spark, monkeypatch):
    """The driver holds plans as trees and as text: no surrogate is worked out beneath a join, and no plan is long."""
    plans = []
    keep = pii.Scratch.keep

    def kept(self, df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return keep(self, df, name)

    monkeypatch.setattr(pii.Scratch, "keep", kept)
    df = spark.createDataFrame([(1, "Mr. John Smith, +1 212 555 0199, 4111 1111 1111 1111, a.b@x.org")], "doc_id bigint, text string")
    out = pii.surrogates(spark, df)
    plans.append(out._jdf.queryExecution().optimizedPlan().toString())
    assert [r["n_entities"] for r in out.collect()] == [4]
    assert any("sha2" in p for p in plans) and not any("Join" in p and "sha2" in p for p in plans)
    assert max(map(len, plans)) < 30_000, [len(p) for p in plans]


def test_excess_counts_are_small_and_equal_a_plain_count():
    """Words between the same neighbours count once, and what the counts take does not come on top of themselves."""
    import tracemalloc

    rows = [("red horrid sea blue lake", 1, 0), ("red horrid sea", 1, 1), ("calm blue lake", 0, 2), ("old horrid sea tide", 1, 3), (None, 0, 0)]
    counts = toxicity.Excess(len(rows))
    for r in rows:
        counts.add(*r)
    words = [[w.decode() for i in ids for w, at in counts.ids.items() if at == i] for _, _, ids in counts.docs]
    assert words == [["red", "horrid", "sea", "blue", "lake"], ["sea"], ["calm", "blue"], ["old", "horrid", "sea", "tide"], []]
    assert counts.held.nbytes + counts.seen.nbytes <= 40 << 20
    tracemalloc.start()
    counts.parts(0)
    assert tracemalloc.get_traced_memory()[1] < 110 << 20
    tracemalloc.stop()


def test_hmm_training_holds_few_tokens_at_once():
    """A slice of a million tokens takes two numbers for each state and token of ABREAST pieces, and counts every piece."""
    import tracemalloc

    import numpy as np

    r = np.random.default_rng(1)
    m = hmm.Hmm.random(3073)
    texts = [r.integers(0, 3073, n).astype(np.int16) for n in [*r.integers(1, 1500, 1000), 300_000]]
    tracemalloc.start()
    got = m.counts(texts)
    assert tracemalloc.get_traced_memory()[1] < 80 << 20
    tracemalloc.stop()
    alone = [m.counts([x]) for x in texts]
    assert all(np.allclose(x, sum(parts), rtol=1e-9) for x, parts in zip(got, zip(*alone, strict=True), strict=True))
    assert math.isclose(got[0].sum(), len(texts)) and math.isclose(got[3].sum(), sum(map(len, texts)))


def test_toxicity_is_not_trained_in_the_driver(spark, monkeypatch):
    """A task trains, with the model that the sample gives; no row to learn from is a model too."""
    import os

    marks = [(i, prose(40, i) + (" idiotic " + prose(9, 500 + i)) * (i % 2)) for i in range(80)]
    df = spark.createDataFrame(marks, "doc_id bigint, text string")
    labels = spark.createDataFrame([(d, d % 2) for d, _ in marks], "doc_id bigint, toxic int")
    assert toxicity.train(df, labels).state() == toxicity.fit(toxicity.sample(df, labels)).state()
    for none in (labels.limit(0), labels.where("doc_id < 0")):
        assert toxicity.train(df, none).state() == toxicity.fit([]).state()
    monkeypatch.setattr(toxicity, "fit", lambda rows: toxicity.Model(str(os.getpid()).encode(), b"", constant=0.5))
    assert toxicity.train(df, labels).ordinary not in (b"", str(os.getpid()).encode())


def test_excess_holds_strings_once():
    """The counts take little besides themselves: no array for each word, and no copy of all counts."""
    import tracemalloc

    import numpy as np

    rows = [(prose(400, i) + f" w{i}xyz{i * i}" * 3, i % 2, i % 4) for i in range(60)]
    counts = toxicity.Excess(len(rows))
    for r in rows:
        counts.add(*r)
    ids = list(counts.ids.values())
    assert ids == list(range(len(ids)))
    for word, i in counts.ids.items():  # as each word alone has them
        alone = toxicity.Excess(1)
        alone.known([word])
        assert counts.buckets(np.array([i]))[0].tolist() == list(alone.strings)
        if i > 20:
            break
    tracemalloc.start()
    counts.parts(0)
    assert tracemalloc.get_traced_memory()[1] < 24 << 20
    tracemalloc.stop()
