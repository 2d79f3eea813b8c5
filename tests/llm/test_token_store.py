"""The token store against plain encoding, and exact round trips."""

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from riskloom.llm import token_store as S

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "\n\n", "A b\tc\r\nD", "it's DON'T x'S", "<|endoftext|> and <|STARTOFTEXT|>", "é É ́x",
    "Σίσυφος ΣΑΣ", "a b c", "co-op... 12,345.67!!! \"q\" 'r'", "İstanbul ǅ ß", "日本語 テキスト。", "😀😀 ok😀.", "a" * 3000, "!a! ?b",
    "word̸ ≠", "x\x1cy\x85z", "((a)) [b]. c;d",
]


def expected(rows):
    """(doc_id, start, n, crc) by the library alone, rows in order."""
    library, at, out = Tokenizer.from_file(PATH), 0, []
    for key, text in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [S.END_ID], "<u4")
        out.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.fixture(scope="module")
def encoder():
    return S.Encoder(PATH)


def test_words_encode_like_whole_texts(encoder):
    assert encoder.by_words
    library = Tokenizer.from_file(PATH)
    ids, sizes = encoder.encode(pa.array([*ODD, None])[:-1])
    for text, got in zip(ODD, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids + [S.END_ID], text


def test_a_small_memory_keeps_the_words_met_most(monkeypatch):
    monkeypatch.setattr(S, "REMEMBERED", 40)
    encoder, library = S.Encoder(PATH), Tokenizer.from_file(PATH)
    for round_ in range(6):
        texts = [f"the cat, the dog! word{round_}x{i}; caf\u00e9 " * (i % 3) for i in range(20)]
        ids, sizes = encoder.encode(pa.array(texts))
        for text, got in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
            assert got.tolist() == library.encode(text, add_special_tokens=False).ids + [S.END_ID]
    encoder.trim()
    assert len(encoder.at) <= 21 and {"the", "cat,"} <= set(encoder.at)


def test_words_are_no_arrow_scalars(monkeypatch):
    """Making a scalar of every distinct word took a sixth of all encoding."""
    column = pa.array([f"word{i} caf\u00e9{i}! \x1c{i}" for i in range(50)])
    texts = [t.as_py() for t in column]
    got = []

    class Column:
        def __init__(self, array):
            self.array = array

        def to_numpy(self, zero_copy_only):
            got.append(len(self.array))
            return self.array.to_numpy(zero_copy_only=zero_copy_only)

    plain = S._strings
    monkeypatch.setattr(S, "_strings", lambda c: plain(Column(c)))
    ids, sizes = S.Encoder(PATH).encode(column)
    library = Tokenizer.from_file(PATH)
    want = [library.encode(t, add_special_tokens=False).ids + [S.END_ID] for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want] and sum(got) >= 100


@given(st.lists(st.text(max_size=60), max_size=5))
@settings(max_examples=150, deadline=None)
def test_any_text_encodes_like_the_library(texts):
    library = Tokenizer.from_file(PATH) if not hasattr(test_any_text_encodes_like_the_library, "lib") else test_any_text_encodes_like_the_library.lib
    test_any_text_encodes_like_the_library.lib = library
    ids, sizes = S._encoders.setdefault(PATH, S.Encoder(PATH) if PATH not in S._encoders else S._encoders[PATH]).encode(pa.array(texts, pa.string()))
    want = [library.encode(t, add_special_tokens=False).ids + [S.END_ID] for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@given(st.lists(st.lists(st.integers(0, 6), max_size=80), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_payload_round_trip(docs):
    docs = [np.array([*d, S.END_ID], np.uint32) for d in docs]
    payload = S.pack(np.concatenate(docs), np.array([len(d) for d in docs]), 7)
    for i, d in enumerate(docs):
        assert S.document(payload, i).tolist() == d.tolist()


def test_frequent_pairs_shrink():
    ids = np.array([5, 6, 7, 8, 5, 6, 7, 9] * 2000 + [S.END_ID], np.uint32)
    symbols, rules = S.repair(ids, 100)
    assert len(symbols) < len(ids) / 4 and S.expand(symbols, rules, 100).tolist() == ids.tolist()
    lengths = S.expansion_lengths(rules, 100)
    for i, n in enumerate(lengths):
        assert len(S.expand(np.array([100 + i]), rules, 100)) == n


@pytest.mark.parametrize("ids", [[5] * 1001, [5, 5, 6] * 500, [5] * 40 + [S.END_ID] + [5] * 41, [S.END_ID] * 90, list(range(5, 90)) * 40, []])
def test_no_frequent_pair_is_left(ids):
    """Runs of one id, long repeats and documents of the end id alone: all pairs are replaced that occur often."""
    ids = np.array([*ids, S.END_ID], np.uint32)
    symbols, rules = S.repair(ids, 100)
    assert S.expand(symbols, rules, 100).tolist() == ids.tolist()
    left, places = {}, {}
    for i, pair in enumerate(zip(symbols.tolist(), symbols.tolist()[1:])):
        # Places of a pair that do not overlap.
        if S.END_ID not in pair and places.get(pair, -2) + 1 < i + (pair[0] != pair[1]):
            left[pair], places[pair] = left.get(pair, 0) + 1, i
    assert max(left.values(), default=0) < S.LEAST


def test_store(spark, tmp_path):
    rows = [(7, "b"), (3, None), (5, ""), (None, "none"), (5, "again"), (5, "again")]
    rows += [(100 + i, t) for i, t in enumerate(ODD)] + [(1000 + i, f"the cat {i} sat on the mat " * (i % 40)) for i in range(300)]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id bigint, text string, start int").repartition(5)
    S.write_tokens(df, str(tmp_path / "s"), PATH, shard_ids=500)
    got = sorted(S.read_tokens(spark, str(tmp_path / "s")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([k for k, _ in rows], key=lambda k: (k is not None, k))
    by_key = {}
    for k, t in rows:
        by_key.setdefault(k, []).append(expected([(k, t)])[0][2:])
    at = 0
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in by_key[r.doc_id]
        by_key[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens


def test_empty_store(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    S.write_tokens(df, str(tmp_path / "s"), PATH)
    assert S.read_tokens(spark, str(tmp_path / "s")).collect() == []


def test_query_equals_plain_encoding(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(tuple(r) for r in S.op4_token_store(spark, sf).collect()) == sorted(expected(rows))
