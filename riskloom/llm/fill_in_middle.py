"""Fill-in-middle: documents cut in three, their pieces put into another order for training.

A document is cut into units (characters, or lines with their line break). Two cuts divide the units into
prefix, middle and suffix, which are written as ``<P>`` prefix ``<S>`` suffix ``<M>`` middle (psm) or as
``<S>`` suffix ``<P>`` prefix ``<M>`` middle (spm). Cuts and form are draws from the sha256 of the document's
id, so they are the same on any partitioning. A text that is empty or holds a marker stays plain, and so do
ten in a hundred of the rest; since a text that is cut holds no marker, ``restored`` gets it back from output
and form alone.

The draws are column expressions. The cutting is a pyarrow.compute pipeline over record batches: texts become
list arrays of units, these are flattened with the row each unit came from, a unit's ordinal in its text gives
its role, the units of a role are filtered and put back into lists, and the pieces of a row are joined. A
batch is worked through in slices of ``SLICE`` bytes of text, or one text, so memory is bounded by that and by
the longest text. There is no shuffle.

NULL and empty texts are empty and plain. A NULL id draws as the empty text. Rows that repeat an id repeat its
draws; every row gives a row. Further columns are ignored by ``transformed``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import table

# The markers of the pieces, and the shares of plain and of spm documents in a hundred.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CUT_SHARE, SPM_SHARE = 90, 20
SALT = "1"
UNITS = ("characters", "lines")
#: Bytes of text cut at a time.
SLICE = 8 << 20

OUT = "doc_id bigint, n bigint, form string, prefix_units bigint, middle_units bigint, prefix_chars bigint, middle_chars bigint, output string"


def _draw(digest: Column, i: int) -> Column:
    """The i-th group of 8 hex digits as a number."""
    return F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint")


def drawn(docs: DataFrame, unit: str = "characters", salt: str = SALT) -> DataFrame:
    """(doc_id, text, n, form, first, second) of ``docs``: number of units, form and the two cuts."""
    text = F.coalesce("text", F.lit(""))
    # A line ends after its line break; what follows the last break is a line if there is any.
    breaks = F.length(text) - F.length(F.translate(text, "\n", ""))
    lines = breaks + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)
    n = (F.length(text) if unit == "characters" else lines).cast("bigint")
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), n.alias("n"), digest.alias("_d"))
    a, b = (_draw(F.col("_d"), i) % (F.col("n") + 1) for i in (0, 1))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("n") == 0) | marked | (_draw(F.col("_d"), 2) % 100 >= CUT_SHARE)
    form = F.when(plain, "plain").when(_draw(F.col("_d"), 3) % 100 < SPM_SHARE, "spm").otherwise("psm")
    return rows.select("doc_id", "text", "n", form.alias("form"), F.least(a, b).alias("first"), F.greatest(a, b).alias("second"))


def characters(texts: pa.Array) -> pa.ListArray:
    """Each text as the list of its code points."""
    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2] or pa.py_buffer(b"")
    # A code point begins at every byte but the continuation bytes.
    held = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    begins = np.flatnonzero((held & 0xC0) != 0x80)
    units = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins + bounds[0], bounds[-1])), data)
    return pa.LargeListArray.from_arrays(pa.array(np.searchsorted(begins, bounds - bounds[0])), units)


def lines(texts: pa.Array) -> pa.ListArray:
    """Each text as the list of its lines, each with its line break."""
    parts = pc.split_pattern(texts.cast(pa.large_string()), "\n")
    rows, at = pc.list_parent_indices(parts), pc.list_flatten(parts)
    ends = _last_of_run(rows.to_numpy())
    broken = pc.binary_join_element_wise(at, pa.array(np.where(ends, "", "\n"), pa.large_string()), pa.scalar("", pa.large_string()))
    kept = pc.not_equal(broken, "")
    return _lists(pc.filter(broken, kept), pc.filter(rows, kept), len(texts))


def _last_of_run(rows: np.ndarray) -> np.ndarray:
    return np.append(rows[1:] != rows[:-1], True)[: len(rows)]


def _lists(units: pa.Array, rows: pa.Array, n: int) -> pa.ListArray:
    """``n`` lists of the units whose (ascending) row numbers are given."""
    return pa.LargeListArray.from_arrays(pa.array(np.searchsorted(rows.to_numpy(), np.arange(n + 1))), units)


def _pieces(texts: pa.Array, first: pa.Array, second: pa.Array, unit: str) -> list[pa.Array]:
    """Prefix, middle and suffix of each text."""
    cut = {"characters": characters, "lines": lines}[unit](texts)
    units, rows = pc.list_flatten(cut), pc.list_parent_indices(cut)
    begins = cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()
    ordinal = pc.subtract(pa.array(np.arange(len(units))), pc.take(pa.array(begins), rows))
    after_first = pc.greater_equal(ordinal, pc.take(first, rows))
    after_second = pc.greater_equal(ordinal, pc.take(second, rows))
    roles = [pc.invert(after_first), pc.and_not(after_first, after_second), after_second]
    empty = pa.scalar("", pa.large_string())
    return [pc.binary_join(_lists(pc.filter(units, r), pc.filter(rows, r), len(texts)), empty) for r in roles]


def _written(batch: pa.RecordBatch, unit: str) -> pa.RecordBatch:
    texts, form, n = (batch.column(c) for c in ("text", "form", "n"))
    plain = pc.equal(form, "plain")
    # A plain document is all prefix, so that its pieces join to its text.
    first = pc.if_else(plain, n, batch.column("first"))
    second = pc.if_else(plain, n, batch.column("second"))
    prefix, middle, suffix = _pieces(texts, first, second, unit)
    big = lambda s: pa.scalar(s, pa.large_string())
    join = lambda *parts: pc.binary_join_element_wise(*parts, big(""))
    psm = join(big(PREFIX), prefix, big(SUFFIX), suffix, big(MIDDLE), middle)
    spm = join(big(SUFFIX), suffix, big(PREFIX), prefix, big(MIDDLE), middle)
    out = pc.if_else(plain, prefix, pc.if_else(pc.equal(form, "psm"), psm, spm))
    none = pa.scalar(None, pa.int64())
    counts = [first, pc.subtract(second, first), pc.utf8_length(prefix), pc.utf8_length(middle)]
    counts = [pc.if_else(plain, none, c.cast(pa.int64())) for c in counts]
    names = [part.split()[0] for part in OUT.split(", ")]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), n, form, *counts, out.cast(pa.string())], names=names)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most ``SLICE`` bytes of text, or one row."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(batch):
        below = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, below + SLICE, "right")))
        yield batch.slice(at, to - at)
        at = to


def transformed(docs: DataFrame, unit: str = "characters", salt: str = SALT) -> DataFrame:
    """The columns ``OUT``: each row's number of units, form, pieces' sizes and output.

    The sizes of prefix and middle, in units and in characters, are NULL for a plain document.
    """
    if unit not in UNITS:
        raise ValueError(f"unknown unit: {unit}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                yield _written(part, unit)

    return drawn(docs, unit, salt).mapInArrow(run, OUT)


def restored(output: Column, form: Column) -> Column:
    """The text from which an output was made."""
    head = F.substring_index(output, MIDDLE, 1)  # the first two pieces
    middle = F.substring_index(output, MIDDLE, -1)
    one = lambda second: F.substr(F.substring_index(head, second, 1), F.lit(len(PREFIX) + 1))
    two = lambda second: F.substring_index(head, second, -1)
    psm, spm = F.concat(one(SUFFIX), middle, two(SUFFIX)), F.concat(two(PREFIX), middle, one(PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form, sizes of prefix and middle, and checksums of the output and of the text it gives back."""
    out = transformed(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


OP12_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('{SALT}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
hashes AS (SELECT doc_id, t, n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(d, i, 8) AS BIGINT)) AS h FROM docs),
cuts AS (
  SELECT doc_id, t, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h[3] % 100 >= {CUT_SHARE} THEN 'plain'
              WHEN h[4] % 100 < {SPM_SHARE} THEN 'spm' ELSE 'psm' END AS form
  FROM hashes),
pieces AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
                        WHEN 'spm' THEN '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM pieces
"""
