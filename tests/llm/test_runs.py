"""Runs against a scan of every period, extensions against a word-by-word count, and the planted query."""

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.llm import runs as R
from tests.llm import odd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, length=R.LENGTH, exponent=R.EXPONENT):
    """(start, length, period) of every run, by a scan for each period; the smallest period of a stretch counts."""
    found = {}
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i + p < len(w):
            start = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i > start and i + p - start >= max(length, exponent * p):
                found.setdefault((start, i + p - start), p)
            i += i == start
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def periodic(rng, n, kinds):
    w = [rng.randrange(kinds) for _ in range(n)]
    if n > 30:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(3, 9)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if rng.random() < 0.4:
            w[rng.randrange(n)] = 99
    return w


def check(texts, length=R.LENGTH, exponent=R.EXPONENT):
    starts = np.cumsum([0] + [len(t) for t in texts])
    got = R.runs_of(np.array([x for t in texts for x in t], dtype=np.int64), starts, length, exponent).tolist()
    for i, t in enumerate(texts):
        assert [tuple(r[1:]) for r in got if r[0] == i] == brute(t, length, exponent)


def test_runs_equal_a_scan_of_every_period(monkeypatch):
    rng = random.Random(1)
    for trial in range(150):
        monkeypatch.setattr(R, "PAIRS", 50 if trial % 3 == 0 else 1 << 20)
        check([periodic(rng, rng.choice([0, 1, 23, 24, 25, 60, 150, 400]), rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(1, 9))])


@settings(deadline=None, max_examples=60)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=4), st.integers(1, 9), st.integers(2, 4))
def test_other_lengths_and_exponents(texts, length, exponent):
    check(texts, length, exponent)


def test_equal_texts_make_no_run_across_texts():
    w = list(range(12))
    check([w, w, w, w * 3, w])


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(0, 1), min_size=2, max_size=120), st.randoms(use_true_random=False))
def test_extensions_count_equal_words(words, rng):
    w = np.array([*words, 9])
    lce = R.Extensions(w)
    pairs = [(a, b) for a in range(len(w)) for b in range(len(w)) if a != b]
    a, b = (np.array(x) for x in zip(*rng.sample(pairs, min(len(pairs), 300)), strict=True))
    for x, y, n in zip(a, b, lce.common(a, b), strict=True):
        assert n == next(i for i in range(len(w)) if w[x + i] != w[y + i])


def test_the_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in R.op11_periodic_runs(spark, "/root/testdata/sf0.01").collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert set(got) == set(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    planted = 0
    for key, text in texts.items():
        w = WORD.findall(text or "")
        h, n = zlib.crc32(str(key).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute(w)
        planted += bool(runs)
        dropped = {i for s, m, p in runs for i in range(s + p, s + m)}
        r = got[key]
        assert r.n_runs == len(runs) and r.runs_sha256 == sha("".join(f"{s},{m},{p}\n" for s, m, p in runs))
        assert r.collapsed_sha256 == sha(" ".join(x for i, x in enumerate(w) if i not in dropped))
        best = None
        for s, m, p in runs:
            if best is None or m * best[2] > best[1] * p:
                best = (s, m, p)
        assert (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
    assert planted > 50


def test_odd_rows(spark):
    rows = odd.TEXTS + [(20, "x " * 25_000 + "end"), (21, "\x1c".join("ab" * 30)), (22, " a\x0bb\x0c" * 30)]
    got = R.with_runs(odd.documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by_text = {}
    for key, text in rows:
        by_text.setdefault(key, []).append(WORD.findall(text or ""))
    for r in got:
        assert r.n_words in {len(w) for w in by_text[r.doc_id]}
    one = {r.doc_id: r for r in got}
    assert [tuple(x) for x in one[20].runs] == [(0, 25_000, 1)] and one[20].collapsed == "x end"
    assert [tuple(x) for x in one[22].runs] == [(0, 60, 2)] and one[22].collapsed == "a b"
    assert [tuple(x) for x in one[11].runs] == [(0, 160, 1)] and one[11].collapsed == "same"
    assert one[3].runs == [] and one[3].collapsed == "" and one[2].n_words == 0
    assert R.planted(odd.documents(spark)).count() == len(odd.TEXTS)
    assert R.with_runs(odd.documents(spark, [])).count() == 0
