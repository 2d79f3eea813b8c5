"""SimHash links and components against all pairs."""

import random
import re

import numpy as np
import xxhash

from riskloom.llm import simhash as S
from riskloom.llm.graph import components
from tests.llm import odd

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])


def fingerprint(text, size):
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles(text, size)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(nodes, linked):
    """Smallest member of each node's component."""
    parent = list(range(len(nodes)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(nodes)):
        for j in range(i):
            if linked(nodes[i], nodes[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(nodes))]


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_every_distance_up_to_three_links(spark):
    rng = random.Random(1)
    pairs, values = [], set()
    for d in (1, 2, 3, 4):
        for _ in range(150):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), d):
                y ^= 1 << b
            pairs.append((x, y, d))
            values |= {x, y}
    df = spark.createDataFrame([(signed(v),) for v in values], "fp bigint")
    both = df.select(S.F.lit(0).alias("t"), "fp").unionByName(df.where("fp % 2 = 0").select(S.F.lit(1).alias("t"), "fp"))
    got = S.links(both).collect()
    found = {frozenset((r.a, r.b)) for r in got if r.t == 0}
    assert {frozenset((r.a, r.b)) for r in got if r.t == 1} == {f for f in found if all(v % 2 == 0 for v in f)}
    assert {frozenset((signed(x), signed(y))) for x, y, d in pairs if d <= 3} == found


def test_crowded_ball_keeps_components(spark, monkeypatch):
    """Thousands of fingerprints around one centre, and a bound that forces several passes in one key."""
    rng = random.Random(2)
    values = {0, (1 << 64) - 1}
    for _ in range(600):
        v = 0
        for b in rng.sample(range(24), rng.randint(0, 6)):
            v |= 1 << b
        values.add(v)
    values = sorted(values)
    nodes = np.array(values, dtype=np.uint64)
    want = groups(values, lambda a, b: (a ^ b).bit_count() <= 3)
    df = spark.createDataFrame([(signed(v),) for v in values], "fp bigint")
    got = {r.fp: r.root for r in S.classes(df).collect()}
    monkeypatch.setattr(S, "VARIANTS", 2000)
    spots = df.select("fp", S._spots(S.F.col("fp")).alias("spot")).toPandas().sort_values("spot")
    a, b, _ = S._meet(spots["spot"].to_numpy(np.int64), spots["fp"].to_numpy(np.int64).view(np.uint64))
    split = set(zip(a.tolist(), b.tolist(), strict=True))
    assert all((x ^ y).bit_count() <= 3 for x, y in split)
    assert groups(values, lambda x, y: (min(x, y), max(x, y)) in split) == want
    by = {}
    for v, w in zip(values, want, strict=True):
        by.setdefault(w, set()).add(signed(v))
    for members in by.values():
        assert {got.get(m, m) for m in members} == {min(members)}
    assert len(nodes) == len(values)


def test_near_duplicates_equal_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    fps = [fingerprint(t, 3) for _, t in rows]
    root = groups(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (k, _), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, k), k)
    want = sorted((k, format(f, "016x"), least[r]) for (k, _), f, r in zip(rows, fps, root, strict=True))
    assert sorted(tuple(r) for r in S.op8_simhash(spark, sf).collect()) == want


def test_odd_rows(spark):
    docs = odd.documents(spark)
    found = S.near_duplicates(docs, 3).collect()
    assert len(found) == len(odd.TEXTS)
    fps = [fingerprint(t, 3) for _, t in odd.TEXTS]
    root = groups(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    ids = {}
    for (k, _), r in zip(odd.TEXTS, root, strict=True):
        ids.setdefault(r, []).append(k)
    want = [(k, signed(f), min((i for i in ids[r] if i is not None), default=None)) for (k, _), f, r in zip(odd.TEXTS, fps, root, strict=True)]
    assert sorted(((r.doc_id, r.fp, r.component_id) for r in found), key=repr) == sorted(want, key=repr)


def kept_by_brute_force(rows):
    """Ids of the first row of each component of all pairs of fingerprints, NULL last."""
    fps = [fingerprint(t, 3) for _, t in rows]
    first = {}
    for (k, _), r in zip(rows, groups(fps, lambda a, b: (a ^ b).bit_count() <= 3), strict=True):
        first.setdefault(r, []).append(k)
    return sorted((min(ks, key=lambda k: (k is None, k or 0)) for ks in first.values()), key=repr)


def test_one_row_of_each_group_stays(spark):
    docs = odd.documents(spark)
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) <= set(odd.TEXTS)
    assert sorted((k for k, _ in got), key=repr) == kept_by_brute_force(odd.TEXTS)
    assert S.drop_near_duplicates(odd.documents(spark, [])).count() == 0


def test_groups_of_near_copies_keep_their_first(spark):
    """Copies with a few words changed, whole groups of equal texts, and texts that only a shared line joins."""
    rng = random.Random(3)
    rows = []
    for g in range(30):
        base = [f"w{rng.randint(0, 400)}" for _ in range((40, 300, 2000)[g % 3])]
        for c in range(6):
            w = list(base)
            for at in rng.sample(range(len(base)), c // 2):
                w[at] = f"new{rng.randint(0, 10**6)}"
            rows.append((10 * g + c, " ".join(w)))
    line = [f"line{i}" for i in range(5)] * 28
    rows += [(1000 + c, " ".join(line + [f"own{c}x{i}" for i in range(20)])) for c in range(5)]
    rows += [(2000 + c, rows[0][1]) for c in range(300)]
    rng.shuffle(rows)
    got = S.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)).collect()
    assert sorted((r.doc_id for r in got), key=repr) == kept_by_brute_force(rows)
    assert all((r.doc_id, r.text) in set(rows) for r in got) and len(got) < len(rows) / 4


def test_the_same_row_twice_stays_once(spark):
    rows = [(1, "one text of some words"), (1, "one text of some words"), (2, "another text"), (2, "yet quite another")]
    got = [tuple(r) for r in S.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(got) == sorted(set(rows))


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(5000, 5000)]
    edges += [(rng.randint(2000, 2200), rng.randint(2000, 2200)) for _ in range(100)]
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    near = {frozenset(e) for e in edges}
    at = groups(nodes, lambda a, b: frozenset((a, b)) in near)
    want = {n: nodes[r] for n, r in zip(nodes, at, strict=True)}
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
