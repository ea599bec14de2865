"""The whole pipeline against brute force on small tables. What the classifier rejects is taken from its own query, which
is tested by itself; everything after it is worked out anew here."""

import random
import re
import zlib

from readloom.llm import toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def text(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def fixture():
    items = [(i, text(30, 9000 + i)) for i in range(3)] + [(3, "two words")]
    docs = []
    for i in range(150):
        t = text(90, i)
        if i % 3 == 0:
            w = t.split()
            for at in (10, 40, 70):
                w.insert(at, "horrid" + "xyz"[i % 3 + (i // 3) % 2])
            t = " ".join(w)
        docs.append((i, t, f"s{i % 4}" if i % 10 else None))
    for i in (1, 2, 4):  # exact, near and farther copies
        docs += [(200 + i, docs[i][1], "s1"), (300 + i, docs[i][1] + " tail", "s2"), (400 + i, docs[i][1] + " " + text(60, 500 + i), "s0")]
    docs.append((500, text(700, 600) + " " + " ".join(items[0][1].split()[5:20]) + " " + text(700, 601), "s0"))  # a diluted leak
    docs.append((501, "two words " + text(100, 602), "s1"))  # a short item within a clean text
    docs.append((502, "two words " + text(12, 603), "s1"))  # and in one where it is much
    docs.append((503, text(60, 604) + " write to Mrs. Anna Smith at anna@x.org or +1 212 555 0199", None))
    docs += [(504, None, "s3"), (505, "", "s3")]
    return docs, items, [(d, int(d % 3 == 0)) for d in range(150)]


def expected(docs, items, rejected):
    left = [d for d in docs if d[0] not in rejected]
    sets = {}
    for i, t, _ in left:
        w = WORD.findall(t or "")
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    left = [d for d in left if find(d[0]) == d[0]]
    kept = []
    for i, t, source in left:
        w = FOLDED.findall((t or "").lower())
        hit, whole = set(), False
        for _, item in items:
            x = FOLDED.findall(item)
            n = min(13, len(x))
            for at in range(len(w) - n + 1):
                if any(w[at : at + n] == x[k : k + n] for k in range(len(x) - n + 1)):
                    hit |= set(range(at, at + n))
                    whole |= n == 13
        if not whole and not (hit and 20 * len(hit) >= len(w)):
            kept.append((i, t, source))
    return kept


def test_run_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    docs, items, labels = fixture()
    tables = {
        "documents": spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        "benchmark": spark.createDataFrame(items, "item_id bigint, text string"),
        "labels": spark.createDataFrame([(d, 1, y) for d, y in labels], "doc_id bigint, quality int, toxic int"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    rejected = {r["doc_id"] for r in toxicity.scored(spark, tables["documents"], tables["labels"]).collect() if r["predicted"]}
    truth = {d for d, y in labels if y and zlib.crc32(str(d).encode()) % 3 != 1}
    assert len(truth & rejected) >= 0.9 * len(truth) and not {500, 501, 502, 503, 504, 505} & rejected
    kept = expected(docs, items, rejected)
    assert {500, 502}.isdisjoint(i for i, *_ in kept) and {501, 503, 504, 505} <= {i for i, *_ in kept}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, *_ in kept}
    size = {i: len(WORD.findall(t or "")) for i, t, _ in kept}
    assert all(got[i]["size"] == size[i] for i in size)  # surrogates keep words apart
    of = {}
    for i, _, s in kept:
        of.setdefault(s, []).append(i)
    total, order = sum(size.values()), sorted(of, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    sizes = {s: sum(size[i] for i in of[s]) for s in order}
    target, open_, rest = {}, set(order), float(total)
    while open_:  # shares by weight; what is above three times its source is settled, the rest shared again
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        for s in over or list(open_):
            target[s] = 3.0 * sizes[s] if over else share[s]
            open_.remove(s)
            rest -= target[s]
    for s in order:
        assert all(abs(got[i]["target"] - target[s]) < 1e-6 * total and got[i]["source_size"] == sizes[s] and got[i]["taken"] <= 3 * size[i] for i in of[s])
        assert abs(sum(got[i]["taken"] for i in of[s]) - target[s]) <= max(0.1 * target[s], max(size[i] for i in of[s]))
