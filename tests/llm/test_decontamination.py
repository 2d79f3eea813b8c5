"""Winnowed occurrences against looking at every window."""

import hashlib
import random
import re

from riskloom.llm import decontamination as D
from tests.llm import odd

LOW = str.maketrans(D.UPPER, D.LOWER)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        m = min(len(w), 13)
        for s in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + m]), set()).add(item)
    sizes = {len(x) for x in windows}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for m in sizes:
            for s in range(len(w) - m + 1):
                if (t := tuple(w[s : s + m])) in windows:
                    hit |= set(range(s, s + m))
                    found |= windows[t]
        names = sorted(str(i) for i in found if i is not None)
        digest = hashlib.sha256(",".join(names).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def judged(spark, docs, items):
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = D.judged(df, spark.createDataFrame(items, "item_id bigint, text string")).drop("digest")
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_few_words_and_many_overlaps(spark):
    rng = random.Random(5)
    text = lambda n, k: " ".join(rng.choice("abcdefgh"[:k]) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 7, 12, 13, 14, 20, 40]), 3 + i % 4)) for i in range(25)] + [(None, text(15, 3)), (3, text(16, 3))]
    docs = [(i, text(rng.randint(0, 120), rng.randint(2, 6))) for i in range(60)]
    docs += [(100 + i, text(50, 8) + " " + t + ", " + text(60, 8)) for i, (_, t) in enumerate(items)]
    assert judged(spark, docs, items) == brute(docs, items)


def test_long_passages(spark):
    rng = random.Random(6)
    fresh = lambda n: " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(n))
    items = [(i, fresh(rng.randint(13, 60))) for i in range(20)]
    docs = []
    for i in range(60):
        w = items[i % 20][1].split()
        cut = w[rng.randint(0, 3) : len(w) - rng.randint(0, 3)]
        docs.append((i, fresh(rng.randint(0, 600)) + " " + " ".join(cut).upper() + "! " + fresh(rng.randint(0, 50))))
    got = judged(spark, docs, items)
    assert got == brute(docs, items) and any(r[5] for r in got) and not all(r[5] for r in got)


def test_odd_rows(spark):
    items = [(1, odd.PROSE), (1, odd.PROSE), (None, "no id here"), (2, None), (3, ""), (4, "日本語"), (5, "word1 tail1")]
    docs = odd.documents(spark)
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((tuple(r) for r in D.judged(docs, table).drop("digest").collect()), key=repr)
    assert got == brute(odd.TEXTS, items)
    kept = D.drop_contaminated(docs, table)
    assert kept.columns == docs.columns
    bad = [r[0] for r in got if r[5]]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r[0] for r in got if not r[5]), key=repr) and bad


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert not any(r.contaminated for r in D.judged(odd.documents(spark), none).collect())
    assert D.judged(odd.documents(spark, []), spark.createDataFrame([(1, "x")], "item_id bigint, text string")).count() == 0
