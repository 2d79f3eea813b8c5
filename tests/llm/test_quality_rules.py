"""Counts against plain Python, and the joint verdict against EM over single documents."""

import math
import random
import re

from pyspark.sql import functions as F

from riskloom.llm import quality_rules as Q
from riskloom.llm.statistics import with_counts
from tests.llm import odd

JUNK = [
    (20, "THIS IS!! ALL SHOUTED!! TEXT!! " * 12), (21, "a | b | c | d | e | f | g | h | i | " * 6),
    (22, "word### other$$$ thing%%% some&&& " * 8), (23, "copy of a line that comes again and again\n" * 9),
]


def counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    again = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
    number = lambda chars: sum(c in chars for c in t)
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": number("#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(again), "n_lines": len(lines),
        "n_distinct": len(set(w)), "n_upper": sum("A" <= c <= "Z" for c in t), "n_digits": sum("0" <= c <= "9" for c in t),
        "n_marks": number(".!?"), "n_chars_all": len(t), "longest": max(map(len, w), default=0),
        "n_bars": w.count("|"), "n_odd": sum(x[-1] in "#*$%&|<>" for x in w),
    }


def test_counts(spark):
    rows = odd.TEXTS + JUNK
    got = with_counts(odd.documents(spark, rows)).collect()
    want = [{"doc_id": k, **counts(t)} for k, t in rows]
    assert sorted((r.asDict() for r in got), key=str) == sorted(want, key=str)


def brute(votes, rounds=Q.ROUNDS):
    """Expectation-maximisation, one document after the other: posteriors and accuracies of the rules."""
    share, tables = Q.START_SHARE, [[{1: 0.05, 0: 0.45, None: 0.5}, {1: 0.45, 0: 0.05, None: 0.5}] for _ in votes[0]]
    for at in range(rounds + 1):
        q = []
        for v in votes:
            odds = share / (1 - share) * math.prod(t[1][x] / t[0][x] for x, t in zip(v, tables, strict=True))
            q.append(odds / (1 + odds))
        if at == rounds:
            break
        share = (sum(q) + Q.START_SHARE) / (len(q) + 1)
        for j, t in enumerate(tables):
            for y in (0, 1):
                p = [x if y else 1 - x for x in q]
                for o, prior in ((1, 0.9 if y else 0.1), (0, 0.1 if y else 0.9), (None, 1.0)):
                    t[y][o] = (sum(w for w, v in zip(p, votes, strict=True) if v[j] is o) + prior) / (sum(p) + 2)
    right = [share * t[1][1] + (1 - share) * t[0][0] for t in tables]
    wrong = [share * t[1][0] + (1 - share) * t[0][1] for t in tables]
    return q, [r / (r + w) for r, w in zip(right, wrong, strict=True)]


def test_planted_accuracies_are_recovered_and_decide(spark):
    rng = random.Random(5)
    names, planted = list("abcdef"), [0.6, 0.6, 0.75, 0.75, 0.95, 0.95]
    rows = []
    for i in range(12_000):
        good = int(rng.random() < 0.6)
        cast = [None if rng.random() < 0.2 else good if rng.random() < a else 1 - good for a in planted]
        rows.append((i, good, *cast))
    voted = spark.createDataFrame(rows, "doc_id bigint, good int, " + ", ".join(f"v_{n} int" for n in names))
    e = Q.estimate(voted, names, 200)
    for n, a in zip(names, planted, strict=True):
        assert abs(Q.accuracies(names, e)[n] - a) < 0.03
    got = voted.withColumn("p", Q.posterior(names, e)).collect()
    count = lambda r: sum(1 if r[f"v_{n}"] else -1 for n in names if r[f"v_{n}"] is not None)
    # One good rule outvotes poor ones: the verdict differs from the count of votes, and is right more often.
    differ = [r for r in got if (r.p >= 0.5) != (count(r) >= 0)]
    assert len(differ) > 300 and sum((r.p >= 0.5) == bool(r.good) for r in differ) > 0.8 * len(differ)


def test_joint_verdict(spark):
    rows = odd.TEXTS + JUNK + [(100 + i, " ".join(f"A w{i}x{j} day was v{i}y{j}." for j in range(12))) for i in range(40)]
    found, e = Q.judged(odd.documents(spark, rows))
    got = found.collect()
    q, right = brute([[r[f"v_{n}"] for n in Q.RULES] for r in got])
    assert max(abs(r.posterior - p) for r, p in zip(got, q, strict=True)) < 1e-4
    found = Q.accuracies(list(Q.RULES), e)
    assert all(abs(found[n] - r) < 1e-3 for n, r in zip(Q.RULES, right, strict=True))
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)
    kept = {r.doc_id for r in got if r.kept}
    assert {100 + i for i in range(40)} <= kept and not kept & {k for k, _ in JUNK} and 3 not in kept


def test_empty_table(spark):
    found, estimate = Q.judged(odd.documents(spark, []))
    assert found.count() == 0 and estimate["share"] == Q.START_SHARE


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    got = Q.op1_quality_rules(spark, sf).join(labels, "doc_id").where(~F.col("base_failed"))
    seen = {(r.quality, r.kept): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert seen.get((1, False), 0) <= 0.02 * seen[1, True] and seen.get((0, True), 0) <= 0.1 * seen[0, False] + 2
