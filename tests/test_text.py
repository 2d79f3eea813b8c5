import pytest
from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.operators import encode
from riskloom.operators.encode import encode_both, encode_pairs, encode_words, length_stats
from riskloom.operators.encode import fold_ids
from riskloom.operators.vocab import (
    SPLITS, doc_frequency, fold_counts, fold_term_counts, fold_vocab, merge_counts, stack_texts, term_frequency, trains, vocab_chars, vocab_words,
)


def one(spark, text, col):
    return spark.createDataFrame([(text,)], "t string").select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("a+=b++&&c", ["a", "+=", "b", "++", "&", "&", "c"]),
        ("x_1", ["x", "1"]),
        ("Été1", ["t", "1"]),
        ("a<=b||c!=d?e:f", ["a", "<=", "b", "||", "c", "!=", "d", "?", "e", ":", "f"]),
        ("i-- -= 5 % $y /= 2 * z; (ok)", ["i", "--", "-=", "5", "%", "$", "y", "/=", "2", "*", "z", "ok"]),
        ("", []),
    ],
)
def test_code_tokens(spark, text, want):
    assert one(spark, text, tx.code_tokens("t")) == want


def test_clean_changes_takes_one_line_break(spark):
    text = "a##<END>##\n\nb##<END>##\rc##<END>##"
    assert one(spark, text, tx.clean_changes("t")) == "a\nbc##<END>##"


def test_words_split_on_unicode_space(spark):
    text = "a b c\x1cd　e​f"
    assert one(spark, text, tx.words("t")) == text.split()


def brute_char_grams(text, lo, hi, word_bound, whole):
    out = []
    if word_bound:
        for w in text.split():
            if whole:
                out.append(f"<{w}>")
            if len(w) < lo:
                out.append(w)
            out += [w[i : i + n] for n in range(lo, min(hi, len(w)) + 1) for i in range(len(w) - n + 1)]
        return out
    if lo == 1:
        out += list(text)
    if whole:
        out += [f"<{w}>" for w in text.split()]
    for n in range(max(lo, 2), hi + 1):
        out += [text[i : i + n] for i in range(len(text) - n + 1)]
    return out


TEXTS = ["ab abc abcdefgh", "a\nb  longerword é", "x😀yz 😀😀 w", "", "one"]


@pytest.mark.parametrize("word_bound", [True, False])
@pytest.mark.parametrize("whole", [True, False])
def test_char_grams(spark, word_bound, whole):
    sizes = [(1, 1), (1, 3), (3, 6), (2, 2)]
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    cols = [tx.char_grams("t", lo, hi, word_bound, whole).alias(f"g{i}") for i, (lo, hi) in enumerate(sizes)]
    for r in df.select("t", *cols).collect():
        for i, (lo, hi) in enumerate(sizes):
            assert r[f"g{i}"] == brute_char_grams(r["t"], lo, hi, word_bound, whole)


def test_word_grams_and_padding(spark):
    toks = F.split(F.col("t"), " ")
    assert one(spark, "a b c", tx.word_grams(toks, 1, 3)) == ["a", "b", "c", "a b", "b c", "a b c"]
    assert one(spark, "a", tx.word_grams(toks, 1, 3)) == ["a"]
    ids = F.array(*[F.lit(i) for i in (5, 6, 7)])
    assert one(spark, "", tx.pad_ids(ids, 5)) == [0, 0, 5, 6, 7]
    assert one(spark, "", tx.pad_ids(ids, 5, "post")) == [5, 6, 7, 0, 0]
    assert one(spark, "", tx.pad_ids(ids, 2)) == [5, 6]
    with pytest.raises(ValueError):
        tx.pad_ids(ids, 2, "middle")


def test_lookup_finds_every_token_and_nothing_else(spark):
    ids = {f"tok{i}": i for i in range(3000)} | {"quote\"s\\ \n": -1, "é😀": -2}
    find = tx.token_lookup(ids)
    df = spark.createDataFrame([(k, v) for k, v in ids.items()] + [("none", None)], "t string, want int")
    bad = df.filter(~find(F.col("t")).eqNullSafe(F.col("want")))
    assert bad.count() == 0
    with pytest.raises(ValueError):
        tx.token_lookup({str(i): i for i in range(tx.LOOKUP_LIMIT + 1)})


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "a b a c"), (2, "b c"), (3, "c"), (4, None), (5, "d d d d")]
    return spark.createDataFrame(rows, "id int, text string")


def vocab_of(df):
    return [(r["token"], r["id"], r["doc_freq"]) for r in df.orderBy("id").collect()]


def test_vocab_by_document_frequency(docs):
    assert vocab_of(vocab_words(docs, max_vocab=10)) == [("c", 1, 3), ("b", 2, 2), ("a", 3, 1), ("d", 4, 1)]
    assert vocab_of(vocab_words(docs, max_vocab=2, min_df=5)) == [("c", 1, 3), ("b", 2, 2)]


def test_vocab_bounds(docs):
    assert vocab_of(vocab_words(docs, min_df=2, max_df=2)) == [("b", 1, 2)]
    assert vocab_of(vocab_words(docs, min_df=0.4, max_df=1.0)) == [("c", 1, 3), ("b", 2, 2)]
    # By distinct tokens (4) instead of documents (5).
    assert vocab_of(vocab_words(docs, min_df=0.4, max_df=0.6, ratio_base="vocab")) == [("b", 1, 2)]
    with pytest.raises(ValueError):
        vocab_words(docs, min_df=None, max_df=None)


def test_vocab_oov_has_last_id(docs):
    assert vocab_of(vocab_words(docs, max_vocab=2, oov="<?>")) == [("c", 1, 3), ("b", 2, 2), ("<?>", 3, None)]


def test_vocab_chars_counts_documents_once(spark):
    d = spark.createDataFrame([("aab aab",), ("ab",)], "text string")
    got = vocab_of(vocab_chars(d, min_n=1, max_n=2, word_bound=True, max_vocab=9))
    assert got == [("a", 1, 2), ("ab", 2, 2), ("b", 3, 2), ("aa", 4, 1)]


def test_merge_continues_a_vocabulary(docs):
    t = docs.selectExpr("split(coalesce(text, ''), ' ') as t")
    one_way = merge_counts(doc_frequency(t, F.col("t")), doc_frequency(t, F.col("t")))
    assert {r["token"]: r["doc_freq"] for r in one_way.collect()}["c"] == 6


@pytest.mark.parametrize("oov", [None, "<?>"])
def test_encode_words_and_join_path_agree(docs, monkeypatch, oov):
    vocab = vocab_words(docs, max_vocab=2, oov=oov)
    args = dict(tokenizer=tx.words, maxlen=3, oov=oov)
    small = encode_words(docs, vocab, ["text"], ["id"], **args)
    monkeypatch.setattr(encode, "LOOKUP_LIMIT", 1)
    large = encode_words(docs, vocab, ["text"], ["id"], **args)
    rows = {r["id"]: (r["text_ids"], r["text_len"]) for r in small.collect()}
    assert rows == {r["id"]: (r["text_ids"], r["text_len"]) for r in large.collect()}
    if oov is None:
        assert rows[1] == ([0, 2, 1], 2) and rows[4] == ([0, 0, 0], 0)
    else:
        assert rows[1] == ([3, 2, 3], 4) and rows[5] == ([3, 3, 3], 4)


def test_encode_pairs_binds_by_name_and_fills_null(spark):
    df = spark.createDataFrame(
        [("c1", "x y", None, "z", "y")], "commit string, cur_data string, prev_data string, prev_context string, cur_context string"
    )
    vocab = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "token string, id int")
    r = encode_pairs(df, vocab).first()
    assert r["cur_features"][-2:] == [1, 2] and len(r["cur_features"]) == 512
    assert r["prev_features"] == [0] * 512
    assert r["prev_context"][-1] == 3
    chars = encode_pairs(df, spark.createDataFrame([("x", 1)], "token string, id int"), token="char").first()
    assert len(chars["cur_features"]) == 1024 and chars["cur_features"][-1] == 1


def test_encode_both_joins_words_and_chars(docs):
    w = vocab_words(docs, max_vocab=9)
    c = vocab_chars(docs, min_n=1, max_n=1, word_bound=True, max_vocab=9)
    r = encode_both(docs, w, c, "text", ["id"], {"maxlen": 4, "tokenizer": tx.words}, {"maxlen": 2, "min_n": 1, "max_n": 1, "word_bound": True})
    got = {x["id"]: x["text_ids"] for x in r.collect()}
    assert got[2] == [0, 0, 2, 1, 2, 1]


def test_length_stats_leave_out_empty(docs):
    d = docs.selectExpr("size(filter(split(coalesce(text, ''), ' '), t -> t <> '')) as n")
    r = length_stats(d, "n").first()
    assert (r["n"], r["shortest"], r["longest"]) == (4, 1, 4)


def test_fold_counts_equal_direct_counts(spark):
    rows = [(p, f"t{p} all t{p // 2}") for p in range(12) for _ in range(p + 1)]
    d = spark.createDataFrame(rows, "time_partition int, text string").selectExpr("time_partition", "split(text, ' ') as t")
    got = {(r["fold"], r["token"]): r["doc_freq"] for r in fold_counts(d, F.col("t")).collect()}
    for fold in range(10):
        direct = doc_frequency(d.filter(F.col("time_partition") <= fold), F.col("t")).collect()
        assert {r["token"]: r["doc_freq"] for r in direct} == {t: n for (f, t), n in got.items() if f == fold}
    top = fold_vocab(d, F.col("t"), max_vocab=2).filter("fold = 9").orderBy("id").collect()
    assert [r["id"] for r in top] == [1, 2] and top[0]["token"] == "all"


def test_fold_counts_of_every_split(spark):
    rows = [(p, p % 5 if p else None, "train" if p < 8 else "test", f"t{p} all t{p // 2} all") for p in range(12) for _ in range(p + 1)]
    d = spark.createDataFrame(rows, "time_partition int, partition int, set string, text string").withColumn("t", F.split("text", " "))
    for split, folds in (("time", (0, 3, 9)), ("random", (0, 4)), ("holdout", (0,))):
        for counted, name in ((fold_counts, "doc_freq"), (fold_term_counts, "term_freq")):
            got = {(r["fold"], r["token"]): r[name] for r in counted(d, F.col("t"), folds=folds, split=split).collect()}
            for fold in folds:
                rows_in = d.filter(trains(split, F.col(SPLITS[split]), fold))
                direct = (doc_frequency if name == "doc_freq" else term_frequency)(rows_in, F.col("t")).collect()
                assert {r["token"]: r[name] for r in direct} == {t: n for (f, t), n in got.items() if f == fold}, (split, fold)
    assert trains("random", F.lit(1), 2) is not None
    with pytest.raises(ValueError, match="unknown split"):
        trains("other", F.lit(1), 2)


def test_fold_ids_are_those_of_each_folds_vocabulary(spark):
    vocab = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (3, "b", 1), (3, "c", 2)], "fold int, token string, id int")
    rows = [("x", "a b c a", "c"), ("x", None, "q"), (None, "b", None)]
    df = spark.createDataFrame(rows, "k string, p string, q string")
    cut = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), " "), lambda t: t != "")
    got = sorted(map(repr, ((r.fold, r.k, r.p, r.q) for r in fold_ids(df, {"p": cut("p"), "q": cut("q")}, vocab, [0, 3], ["k"]).collect())))
    ids = {0: {"a": 1, "b": 2}, 3: {"b": 1, "c": 2}}
    of = lambda f, t: [ids[f][w] for w in (t or "").split() if w in ids[f]]
    assert got == sorted(repr((f, k, of(f, p), of(f, q))) for f in (0, 3) for k, p, q in rows)


def test_keyword_counts(spark):
    df = spark.createDataFrame([(1, ["if", "for", "if", "x"])], "id int, t array<string>")
    r = tx.keyword_counts(df, F.col("t"), ["id"]).first()
    assert (r["kw_if"], r["kw_for"], r["kw_while"]) == (2, 1, 0) and len(r) == 58


def test_stack_texts(spark):
    d = spark.createDataFrame([("c", "a", None)], "commit string, p string, q string")
    assert sorted(r["text"] for r in stack_texts(d, ["p", "q"]).collect()) == ["", "a"]


def test_joined_vocabulary_equals_the_literal_one(spark, monkeypatch):
    """Repeated and NULL keys keep their own ids whichever way the vocabulary is looked up."""
    from riskloom.operators import embeddings, encode

    df = spark.createDataFrame([("a", "x y"), ("a", "z"), (None, "x"), (None, None), ("b", "y q y")], "k string, text string")
    vocab = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "token string, id int")
    grams = {"ids": F.split(F.coalesce("text", F.lit("")), " ")}
    for oov in (None, "z"):
        literal = sorted(map(repr, encode.add_ids(df, grams, vocab, ["k"], oov).collect()))
        with monkeypatch.context() as m:
            m.setattr(encode, "LOOKUP_LIMIT", 1)
            assert sorted(map(repr, encode.add_ids(df, grams, vocab, ["k"], oov).collect())) == literal
    tokens = df.select("k", grams["ids"].alias("t"))
    literal = sorted(map(repr, embeddings._known(tokens, ["t"], vocab).collect()))
    monkeypatch.setattr(encode, "LOOKUP_LIMIT", 1)
    assert sorted(map(repr, embeddings._known(tokens, ["t"], vocab).collect())) == literal


def test_fast_patterns_find_what_the_plain_ones_do(spark):
    import random
    import re

    rng = random.Random(7)
    alphabet = list("abzA09<>=!&|+-*/%$:?.,_  \t\n") + ["\x1c", "\x85", "\xa0", "　", "​", "é", "😀", "K"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(2000)] + ["9" * 3000 + "a", "😀a😀 1a é9b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    term = re.compile(r"\S*[A-Za-z]\S+")
    for r in df.select("t", tx.code_tokens("t").alias("c"), tx.words("t").alias("w"), tx.terms("t").alias("m"), F.lower("t").alias("l")).collect():
        assert r["c"] == re.findall(tx.code_pattern(), r["t"])
        assert r["w"] == r["t"].split()
        assert r["m"] == [w for w in r["l"].split() if term.fullmatch(w)]


def test_batched_lookups_equal_the_interpreted_ones(spark):
    ids = {"a": 1, "é😀": 2, "": 3}
    df = spark.createDataFrame([(["a", "x", "é😀", None],), ([],), (["x"],), (["", "a"],)], "t array<string>").coalesce(1)
    for unknown in (None, 9):
        got = df.select(tx.token_ids(ids, unknown)(F.col("t")).alias("a"), tx.map_tokens(F.col("t"), tx.token_lookup(ids), unknown).alias("b")).collect()
        assert [r["a"] for r in got] == [r["b"] for r in got]
    kept = df.select(tx.known_tokens(["a", "é😀"])(F.col("t")).alias("k")).collect()
    assert [r["k"] for r in kept] == [["a", "é😀"], [], [], ["a"]]


def test_grams_of_words_are_counted_as_they_are_cut(spark, monkeypatch):
    from riskloom.operators import vocab as module

    monkeypatch.setattr(module, "GRAMS", 20)  # many spans a batch
    d = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 5 + [None, "abcdefghijk " * 9])], "id int, text string").coalesce(1)
    for lo, hi, whole in ((3, 6, True), (1, 1, False), (1, 3, True), (2, 2, False)):
        want = {}
        for r in d.collect():
            for g in set(brute_char_grams(r["text"] or "", lo, hi, True, whole)):
                want[g] = want.get(g, 0) + 1
        got = vocab_chars(d, min_n=lo, max_n=hi, word_bound=True, whole_word=whole, max_vocab=10_000)
        assert {r["token"]: r["doc_freq"] for r in got.collect()} == want


def test_letters_are_counted_as_translate_removes_them(spark):
    """Letters of one to four bytes, texts of none, and a batch that does not begin with its buffer."""
    import numpy as np

    from riskloom.functions.text import letter_counts

    groups = ["e", "äöüß", "0123456789", "\n", "€x", "😀", "#*$%&|<>"]
    rng = np.random.default_rng(5)
    letters = list("eaäöüßéè019\n€x😀#|日")
    texts = ["".join(rng.choice(letters, n)) for n in rng.integers(0, 60, 300)] + ["", None, "ä", "😀" * 400]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    left = [F.length("text") - F.length(F.translate("text", g, "")) for g in groups]
    got = rows.select("text", letter_counts(F.col("text"), groups).alias("n"), F.array(*left).alias("expected")).collect()
    for r in got:
        assert r.n == (list(r.expected) if r.text is not None else [0] * len(groups))


def test_measures_of_seven_tasks_read_a_text_once(spark):
    from riskloom.plans.learning import seven_tasks

    plan = seven_tasks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "translate(" not in plan and plan.count("ArrowEvalPython") == 1  # before: twenty translations of every text


BLANKS = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())


def test_words_are_found_in_bytes_as_in_text(spark):
    import pyarrow as pa

    from riskloom.operators.vocab import _words_of

    texts = ["", "a", " a", "a ", *[f"é{b}日b{b}{b}" for b in BLANKS], "​ x᠎y 😀", "à　 ", " ", "c"]
    many, found = _words_of(pa.array(["x y", *texts], pa.large_string()).slice(1))
    assert many.tolist() == [len(t.split()) for t in texts]
    assert found.to_pylist() == [w for t in texts for w in t.split()]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.words(F.col("t")).alias("w")).collect()
    assert [r["w"] for r in rows] == [t.split() for t in texts]


@pytest.mark.parametrize("lo, hi, whole", [(3, 6, True), (1, 1, False), (1, 3, True), (6, 7, True), (5, 5, True), (20, 20, False)])
def test_grams_cut_by_batch_equal_grams_cut_word_by_word(spark, monkeypatch, lo, hi, whole):
    """Marked words that are spelt like grams or short words, several alphabets, long runs, slices of a batch."""
    import random

    from riskloom.operators import vocab as module

    monkeypatch.setattr(module, "GRAMS", 50)
    monkeypatch.setattr(module, "CUT_BYTES", 100)
    rng = random.Random(hi)
    texts = ["".join(rng.choice("ab<>é日😀x \t\xa0 ") for _ in range(rng.choice([0, 3, 20, 60]))) for _ in range(40)]
    texts += ["<ab> x<ab> ab <<ab>>", "<abcd> abcd", "abcd", None, "aaaaaaaaaa aaa", "".join(map(chr, range(0x4E00, 0x4F00)))]
    d = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    want = {}
    for t in texts:
        for g in set(brute_char_grams(t or "", lo, hi, True, whole)):
            want[g] = want.get(g, 0) + 1
    got = vocab_chars(d, min_n=lo, max_n=hi, word_bound=True, whole_word=whole, max_vocab=10_000)
    assert {r["token"]: r["doc_freq"] for r in got.collect()} == want


def test_words_for_grams_are_not_cut_in_the_plan(spark):
    """Before, each word became a string in Spark and each gram a Python object; texts that are no valid UTF-8 are still read."""
    d = spark.sql("SELECT CAST(unhex('6162FF2063') AS STRING) AS text UNION ALL SELECT 'c'")
    got = vocab_chars(d, min_n=1, max_n=2, word_bound=True, max_vocab=9)
    assert "regexp_extract_all" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["token"], r["doc_freq"]) for r in got.collect()} == {("c", 2), ("a", 1), ("b", 1), ("�", 1), ("ab", 1), ("b�", 1)}
