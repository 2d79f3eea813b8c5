"""Pieces, forms and the way back, against plain Python slices."""

import hashlib

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.llm import fill_in_middle as M
from tests.llm import odd


def brute(key, text, unit):
    text = text or ""
    units = list(text) if unit == "characters" else text.splitlines(keepends=True) if text.isascii() else None
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not n or any(m in text for m in (M.PREFIX, M.SUFFIX, M.MIDDLE)) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


ROWS = odd.TEXTS + [(20 + i, t) for i, t in enumerate(["a < b", "<P", "<S><M>", "x<P>y", ">", "<<M>>", "<", "日本<S", "😀" * 5, "\n\n", "a\nb", "a\nb\n"])]


def test_every_row_against_slices(spark):
    rows = ROWS + [(100 + i, "<S <P <M " * (i % 4) + f"text {i} <<P" * (i % 3)) for i in range(200)]
    docs = odd.documents(spark, rows)
    for unit in M.UNITS:
        kept = [(k, t) for k, t in rows if unit == "characters" or (t or "").isascii()]
        got = M.transformed(docs if unit == "characters" else odd.documents(spark, kept), unit)
        got = got.withColumn("again", M.restored(F.col("output"), F.col("form"))).collect()
        seen = [(r.doc_id, r.n, r.form, r.prefix_units, r.middle_units, r.output) for r in got]
        if unit == "lines":  # only line feeds end a line
            kept = [(k, t.replace("\r", "").replace("\x0b", "") if t else t) for k, t in kept]
        assert sorted(seen, key=repr) == sorted([(k, *brute(k, t, unit)) for k, t in kept], key=repr)
        assert sorted((r.again for r in got)) == sorted(t or "" for _, t in kept)
        forms = {r.form for r in got}
        assert forms == {"plain", "psm", "spm"}
        for r in got:
            assert (r.prefix_chars is None) == (r.form == "plain")


@settings(deadline=None, max_examples=80)
@given(st.lists(st.text(max_size=12), max_size=6), st.data())
def test_pieces_join_to_the_text(texts, data):
    column = pa.array(texts, pa.string())
    for unit, cut in (("characters", M.characters), ("lines", M.lines)):
        units = cut(column).to_pylist()
        if unit == "characters":
            assert units == [list(t) for t in texts]
        assert ["".join(u) for u in units] == texts
        first = [data.draw(st.integers(0, len(u))) for u in units]
        second = [data.draw(st.integers(a, len(u))) for a, u in zip(first, units, strict=True)]
        pieces = M._pieces(column, pa.array(first, pa.int64()), pa.array(second, pa.int64()), unit)
        for u, a, b, p, m, s in zip(units, first, second, *[c.to_pylist() for c in pieces], strict=True):
            assert (p, m, s) == ("".join(u[:a]), "".join(u[a:b]), "".join(u[b:]))


def test_slices_of_a_batch_and_offsets():
    texts = ["aé", "", "日本語", "x" * 50, "y"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    assert M.characters(batch.slice(2, 2).column("text")).to_pylist() == [list("日本語"), ["x"] * 50]
    whole, M.SLICE = M.SLICE, 10
    try:
        assert [p.column("text").to_pylist() for p in M._slices(batch)] == [["aé", ""], ["日本語"], ["x" * 50], ["y"]]
    finally:
        M.SLICE = whole


def test_empty_table(spark):
    assert M.transformed(odd.documents(spark, [])).count() == 0
