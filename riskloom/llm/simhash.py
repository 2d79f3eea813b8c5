"""Near-duplicates by SimHash fingerprints and meet-in-the-middle ball hashing.

Fingerprints: word shingles are hashed with XXH64, and a bit is set where more than half of a text's
shingle hashes have it. Texts link when their fingerprints differ in at most ``RADIUS`` = 3 bits.

Search: if x and y differ in three bits, one of them reaches a common variant by flipping one bit and the
other by flipping two; so each fingerprint stands for the ball of variants around it. Two savings lose no
pair. (1) A pair at distance 3 has an odd and an even number of set bits, so only odd fingerprints need the
two-flip variants. (2) Of any three bits two lie in the same half of the word, so two-flip variants need
only pairs of bits inside one half. A variant's unflipped half is the shuffle key, and the flips in the
other half are enumerated in the task that gets the key: a fingerprint is shuffled 34 or 66 times, and not
2,081 times. In a task variants are sorted, and a variant that several fingerprints reach links them to
one of those that reach it with at most one flip. That is a number of links linear in the number of variants,
and it keeps the components: fingerprints with at most one flip to a variant are within 2 bits of each
other, those with two flips within 3 of the first. Links are verified by their bit count.

Copies cost nothing: equal fingerprints are merged before the search, so a variant is shared by at most
2,081 of them, whatever a group of copies holds.

``drop_near_duplicates`` keeps one row of each component. Two texts that a repeated line fills for the greater
part have that line's fingerprint and so count as copies, whatever else they say.

NULL and empty texts have no words and the fingerprint zero, linked like any other. The documents of a
component whose ids are all NULL have a NULL component id. Further columns are carried by the dropping
operator and ignored by the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.binding import bind
from riskloom.llm.common import ascii_lower, broadcast_below, split_words, table
from riskloom.llm.graph import components
from riskloom.session import materialise

RADIUS = 3
#: Variants that a task holds at a time (8 bytes each, a few arrays of them).
VARIANTS = 2_000_000
#: Hashes whose bits are counted at a time (64 bytes each).
HASHES = 200_000

_HALF = 32
_LOW = np.uint64(0xFFFFFFFF)
_SINGLE = np.uint64(1) << np.arange(_HALF, dtype=np.uint64)
_DOUBLE = np.array([a | b for i, a in enumerate(_SINGLE) for b in _SINGLE[i + 1 :]], dtype=np.uint64)


def shingle_hashes(text: Column, size: int) -> Column:
    """XXH64 (seed 42, Spark's own) of the text's ``size``-word shingles, repeats included."""

    def hashes(words: Column) -> Column:
        n = F.size(words)
        at = F.when(n >= size, F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)))).when(
            n > 0, F.array(F.lit(1))
        )
        return F.transform(
            F.coalesce(at, F.array().cast("array<int>")),
            lambda i: F.xxhash64(F.array_join(F.slice(words, i, size), " ")),
        )

    return bind(split_words(ascii_lower(text)), hashes)


def majority_bits(lists: pa.Array) -> np.ndarray:
    """For each list of 64-bit hashes the bits set in over half of them, as int64."""
    ends = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
    out = np.zeros(len(lists), dtype=np.uint64)
    counts = np.zeros((len(lists), 64), dtype=np.int64)
    for start in range(int(ends[0]), int(ends[-1]), HASHES):
        stop = min(start + HASHES, int(ends[-1]))
        first = int(np.searchsorted(ends, start, "right")) - 1
        last = int(np.searchsorted(ends, stop, "left"))
        cuts = np.clip(ends[first : last + 1], start, stop) - start
        bits = np.unpackbits(values[start:stop].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = np.flatnonzero(cuts[1:] > cuts[:-1])
        counts[first + full] += np.add.reduceat(bits, cuts[full], axis=0, dtype=np.int32)
    set_bits = 2 * counts > np.diff(ends)[:, None]
    for b in range(64):
        out |= set_bits[:, b].astype(np.uint64) << np.uint64(b)
    return out.view(np.int64)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = {n: batch.column(n) for n in ("doc_id", "whole")}
        cols["fp"] = pa.array(majority_bits(batch.column("hashes")), pa.int64())
        yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def _spots(fp: Column) -> Column:
    """Where a fingerprint goes in the shuffle: (half << 32 | key) << 1 | near, one BIGINT each. ``links`` puts
    the number of the fingerprint's table above that.

    near is 0 if the key is the fingerprint's own half, 1 if one bit of it is flipped. Half 0 (the key is
    the high half) gets every fingerprint, half 1 only what pairs at distance 3 need.
    """
    high, low = F.shiftrightunsigned(fp, _HALF), F.lit(1 << _HALF) + fp.bitwiseAND(F.lit(int(_LOW)))

    def flipped(key: Column) -> Column:
        return F.array(*[key.bitwiseXOR(F.lit(1 << b).cast("bigint")) * 2 + 1 for b in range(_HALF)])

    odd = F.bit_count(fp) % 2 == 1
    second = F.when(odd, F.array(low * 2)).otherwise(F.concat(F.array(low * 2), flipped(low)))
    return F.explode(F.concat(F.array(high * 2), flipped(high), second))


def _meet(spot: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Links (rows: fingerprint, fingerprint, table) between fingerprints of a table that share a variant; the
    input is sorted by ``spot``."""
    none = np.zeros(0, np.uint64)
    key = spot >> 1
    group = np.cumsum(np.r_[False, key[1:] != key[:-1]])
    crowd = np.bincount(group)[group] > 1  # a key of one row links nothing
    if not crowd.any():
        return np.stack([none] * 3)
    table_of = (key[np.flatnonzero(np.r_[True, key[1:] != key[:-1]])] >> (_HALF + 1)).astype(np.uint64)
    key, near, fp, group = key[crowd], (spot[crowd] & 1) == 1, fp[crowd], group[crowd]
    high = (key >> _HALF) & 1 == 0  # the key is the high half
    free = np.where(high, fp & _LOW, fp >> np.uint64(_HALF))  # the half that is not the key
    odd = np.bitwise_count(fp) % 2 == 1
    one, two = ~near & (high | ~odd), ~near & odd
    # Keys are dealt to lots of bounded size; variants of different keys never meet.
    cost = 1 + _HALF * one + len(_DOUBLE) * two
    lot = (np.cumsum(np.bincount(group, cost)) // VARIANTS)[group]
    found = [(none, none, none)]
    for b in np.unique(lot):
        at = np.flatnonzero(lot == b)
        first_group = group[at[0]]
        passes = max(1, int(np.ceil(cost[at].sum() / VARIANTS)))  # a key above the bound: by variant residue
        for p in range(passes):
            codes, who = [], []

            def add(rows: np.ndarray, masks: np.ndarray, flips: int) -> None:
                block = max(1, VARIANTS // max(len(masks), 1))
                for i in range(0, len(rows), block):
                    part = rows[i : i + block]
                    var = free[part][:, None] ^ masks[None, :]
                    code = ((group[part] - first_group).astype(np.uint64)[:, None] << np.uint64(34)) | (var << np.uint64(2)) | np.uint64(flips)
                    keep = var % np.uint64(passes) == p if passes > 1 else np.ones(var.shape, bool)
                    codes.append(code[keep])
                    who.append(np.broadcast_to(fp[part][:, None], var.shape)[keep])

            itself = np.zeros(1, np.uint64)
            add(at[~near[at]], itself, 0)
            add(at[near[at]], itself, 1)  # one flip, in the key
            add(at[one[at]], _SINGLE, 1)  # one flip, in the free half
            add(at[two[at]], _DOUBLE, 2)  # two flips, in the free half
            code, owner = np.concatenate(codes), np.concatenate(who)
            order = np.argsort(code)
            code, owner = code[order], owner[order]
            variant = code >> np.uint64(2)
            first = np.r_[True, variant[1:] != variant[:-1]]
            head = np.flatnonzero(first)[np.cumsum(first) - 1]  # the one with the fewest flips
            link = ~first & ((code[head] & np.uint64(3)) <= 1) & (owner[head] != owner)
            place = (code[link] >> np.uint64(34)).astype(np.int64) + first_group
            found.append((owner[head][link], owner[link], table_of[place]))
    a, b, t = (np.concatenate([x[i] for x in found]) for i in range(3))
    ok = np.bitwise_count(a ^ b) <= RADIUS  # follows from the flips; verified nevertheless
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), t])[:, ok], axis=1)


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by spot -> links. A key's rows are kept together across batches."""
    spot, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def out(found: np.ndarray) -> pd.DataFrame:
        a, b, t = found.view(np.int64)
        return pd.DataFrame({"a": a, "b": b, "t": t})

    for pdf in batches:
        spot = np.concatenate([spot, pdf["spot"].to_numpy(np.int64)])
        fp = np.concatenate([fp, pdf["fp"].to_numpy(np.int64).view(np.uint64)])
        if len(spot):
            last = np.searchsorted(spot >> 1, spot[-1] >> 1)
            if last:
                yield out(_meet(spot[:last], fp[:last]))
                spot, fp = spot[last:], fp[last:]
    if len(spot):
        yield out(_meet(spot, fp))


def links(fingerprints: DataFrame) -> DataFrame:
    """Links (a, b, t) between the distinct fingerprints (t: number of their table, fp: BIGINT) of each table
    that keep all its components."""
    spots = fingerprints.select("t", "fp", _spots(F.col("fp")).alias("spot"))
    spots = spots.select("fp", (F.shiftleft(F.col("t").cast("bigint"), _HALF + 2) + F.col("spot")).alias("spot"))
    dealt = spots.repartition(F.shiftright("spot", 1)).sortWithinPartitions("spot")
    return dealt.select("spot", "fp").mapInPandas(_search, "a bigint, b bigint, t bigint").distinct()


def classes(fingerprints: DataFrame) -> DataFrame:
    """(fp, root): for distinct fingerprints that link to others the smallest one reachable."""
    distinct = materialise(fingerprints.select("fp").distinct(), "fingerprints")
    return components(links(distinct.select(F.lit(0).alias("t"), "fp"))).select(F.col("node").alias("fp"), F.col("component").alias("root"))


def whole_row(docs: DataFrame) -> Column:
    """Hash of all columns of a row."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, _ in docs.dtypes])


def with_fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """Pinned table (doc_id, whole, fp): whole is a hash of the row, fp the fingerprint of its shingles."""
    found = docs.select("doc_id", whole_row(docs).alias("whole"), shingle_hashes(F.col("text"), shingle).alias("hashes"))
    spec = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, whole bigint, fp bigint"
    return materialise(found.mapInArrow(_fingerprint_batches, spec), "simhash")


def _rooted(rows: DataFrame, *least: Column) -> DataFrame:
    """(fp, root, least ...) of each fingerprint of ``rows``. Aggregates of a fingerprint's rows come first:
    whatever a group of copies holds, it is one row from here."""
    heads = rows.groupBy("fp").agg(*least)
    return heads.join(classes(rows), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, whole, fp, component_id) for each row of ``docs``; component_id is the smallest id reachable."""
    rows = with_fingerprints(docs, shingle)
    rooted = _rooted(rows, F.min("doc_id").alias("head"))
    least = rooted.groupBy("root").agg(F.min("head").alias("component_id"))
    by_fp = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "whole", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row of each component of ``docs``, unchanged: that with the smallest id.

    Components are those of ``near_duplicates``: texts whose fingerprints of ``shingle``-word shingles differ
    in at most ``RADIUS`` bits link. Ids come first in order, NULL last; rows with the same id go by a hash of
    the whole row, and of entirely equal rows one stays.
    """
    rows = with_fingerprints(docs, shingle)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "whole")
    kept = _rooted(rows, F.min(order).alias("o")).groupBy("root").agg(F.min("o").alias("o"))
    kept = kept.select("o.doc_id", "o.whole", F.lit(True).alias("kept"))
    times = rows.groupBy("doc_id", "whole").agg(F.count("*").alias("times"))
    on = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["whole"] == b["whole"])
    lost = times.join(kept, on(times, kept), "left").where(F.col("kept").isNull() | (F.col("times") > 1))
    lost = materialise(lost.select(times["doc_id"], times["whole"], F.col("kept").isNotNull().alias("kept")), "lost")
    lost = broadcast_below(lost, F.lit(48))
    keyed = docs.select(F.struct("*").alias("row"), "doc_id", whole_row(docs).alias("whole"))
    single = keyed.join(lost, on(keyed, lost), "left_anti").select("row.*")
    again = lost.where("kept")
    some = keyed.join(again, on(keyed, again), "left_semi").dropDuplicates(["doc_id", "whole"]).select("row.*")
    return single.unionByName(some)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, on 3-word shingles."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
