"""The pipeline's stages on whole tables against what each should keep."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from riskloom.llm import mixing, toxicity
from riskloom.llm.common import fold_of, table
from riskloom.session import materialise
from tests.llm import odd
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_simhash import fingerprint, groups
from tests.llm.test_token_store import expected

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before the first and after each stage."""
    docs = [table(spark, SF, "documents")]
    for name, stage in P.STAGES:
        docs.append(materialise(stage(spark, docs[-1], SF), name.replace(" ", "-")))
    return docs


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_names_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["toxicity", "near copies", "decontamination", "mixing", "tokens"]
    assert all(d.columns == stages[0].columns for d in stages[:-1])


def test_toxicity(spark, stages):
    model = toxicity.fit(stages[0], table(spark, SF, "labels"), train=fold_of(F.col("doc_id"), 5) != 0)
    before = rows(stages[0])
    keep = [r for r, s in zip(before, model.scores([r[1] for r in before]), strict=True) if s < 0.5]
    assert Counter(rows(stages[1])) == Counter(keep) and len(keep) < len(before)


def test_near_copies(stages):
    before = sorted(rows(stages[1]))
    fps = [fingerprint(r[1], 3) for r in before]
    at = groups(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    # Exactly the first document of each group stays.
    assert {r[0] for r in rows(stages[2])} == {before[a][0] for a in at} and len(set(at)) < len(before)


def test_decontamination(spark, stages):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    judged = contaminated([(r[0], r[1]) for r in rows(stages[2])], items)
    assert {r[0] for r in rows(stages[3])} == {j[0] for j in judged if not j[5]}
    assert any(j[5] for j in judged)


def test_mixing(stages):
    before, after = Counter(rows(stages[3])), Counter(rows(stages[4]))
    assert set(after) == set(before) and all(after[r] >= before[r] for r in before)
    tokens = Counter()
    for r, n in after.items():
        tokens[r[2]] += n * len(r[1].split())
    share = {k: v / sum(tokens.values()) for k, v in tokens.items()}
    first = Counter()
    for r in before:
        first[r[2]] += len(r[1].split())
    off = lambda s: sum(abs(s.get(k, 0) - w) for k, w in mixing.TARGETS.items())
    assert off(share) < max(0.12, off({k: v / sum(first.values()) for k, v in first.items()}))


def test_tokens(stages):
    before = sorted((r[0], r[1]) for r in rows(stages[4]))
    assert sorted(rows(stages[5])) == sorted(expected(before))
    assert zlib.crc32(np.array([1], "<u4").tobytes()) not in {r[3] for r in rows(stages[5])}


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(rows(P.run(spark, SF))) == sorted(rows(stages[5]))


def test_odd_and_empty_documents(spark, tmp_path):
    for name in ("labels", "benchmark"):
        table(spark, SF, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    for texts in (odd.TEXTS, []):
        docs = odd.documents(spark, texts)
        for _, stage in P.STAGES[:-1]:
            out = materialise(stage(spark, docs, str(tmp_path)), "stage")
            assert out.columns == docs.columns
            docs = out
        out = P.STAGES[-1][1](spark, docs, str(tmp_path))
        assert out.count() == docs.count() and (docs.count() > 5 or not texts)
