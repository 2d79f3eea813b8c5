"""Token ids in a compressed binary store, with random access to single documents.

Documents are sorted by id over range partitions and encoded in place; each partition cuts its documents
into shards of about ``SHARD_IDS`` ids and compresses each by Re-Pair: the most frequent pairs of ids that
stand side by side are replaced by new ids (nonterminals), and again, until no pair occurs ``LEAST`` times. A
round replaces many pairs at once, chosen by frequency so that no id is a left end of one and a right end of
another; their occurrences then cannot overlap. Of a run of one id every two are a pair. Pairs never contain
the end id, so documents end where symbols end.

Store: Parquet with one row a shard: ``part`` and ``shard`` (its place in the order of documents), ``docs``
(the ids of its documents), ``n_ids``, and ``payload``, little-endian:

    4 bytes   "RPS1"
    6 uint32  first nonterminal, rules, symbols, documents, bytes of a symbol (2 or 4), 0
    uint32    rules x 2: the pair behind each nonterminal, in the order of creation
    uint32    rules: ids that each nonterminal expands to
    uint64    (documents + 1) x 2: where each document starts, in symbols and in ids
    symbols   of 2 or 4 bytes

``expand`` decodes any run of symbols, so ``document`` reads one document without the rest of its shard.

Order: by id, NULL first; equal ids by a hash of the text, then the text. NULL and empty texts are the end
id alone. A text of any length lies in one shard. An empty table is an empty store.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_type

from riskloom.llm.common import table
from riskloom.session import scratch_path

END_ID = 1
SHARD_IDS = 1 << 19
#: A pair is frequent if it occurs at least so often in its shard.
LEAST = 16
#: Bytes of text that are encoded at a time, and words whose ids a worker remembers.
BATCH_CHARS, REMEMBERED = 1 << 21, 800_000

_MAGIC, _HEAD = b"RPS1", struct.Struct("<4s6I")
# A-Z to a-z and line feeds to spaces; the bytes of other characters stay.
_FOLD = bytes(0x20 if b == 0x0A else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())


class Encoder:
    """Ids of whole texts by a tokenizer that lower-cases and drops white space, word by word.

    Such a tokenizer cuts texts at white space before anything else, so the ids of a text are those of its
    space-separated words one after the other, and a word needs encoding once. Arrow cuts the words and numbers
    the distinct ones of a batch; only those are looked up one by one. ``same_by_words`` tells
    whether the file's rules allow that; with others, and for texts that spell out a special token, whole
    texts are encoded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = sorted({t.content for t in self.library.get_added_tokens_decoder().values()})
        self.by_words = same_by_words(self.library)
        self.closing = np.zeros(max(self.library.get_vocab().values(), default=0) + 1, bool)
        self.closing[[i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        """Empty the memory: words by number, how often each was met, and where each number's ids lie in the pool."""
        self.at = {"": 0}
        self.start, self.length, self.met = (np.zeros(1 << 16, np.int64) for _ in range(3))
        self.pool, self.used = np.zeros(1 << 18, np.uint32), 0

    def trim(self) -> None:
        """Forget the words met least, at least half of them."""
        n, bar = len(self.at), 2
        while (keep := self.met[:n] >= bar).sum() > REMEMBERED // 2:
            bar *= 2
        keep[0] = True
        words, kept = list(compress(self.at, keep.tolist())), np.flatnonzero(keep)
        start, length, met = self.start[kept], self.length[kept], self.met[kept] // 2
        ids = self.pool[ragged(start, length)]
        self.forget()
        self.at = dict(zip(words, range(len(words)), strict=True))
        self._put(np.arange(len(words)), ids, length)
        self.met[: len(words)] = met

    def _put(self, numbers: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        while len(self.at) > len(self.start):
            self.start, self.length, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.met))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.start[numbers] = self.used + np.cumsum(length) - length
        self.length[numbers] = length
        self.used += len(ids)

    def _numbers(self, words: list[str]) -> tuple[np.ndarray, list[str]]:
        """Numbers of distinct words, and those words that had none before."""
        out = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        gone = np.flatnonzero(out < 0)
        out[gone] = len(self.at) + np.arange(len(gone))
        new = [words[i] for i in gone.tolist()]
        self.at.update(zip(new, out[gone].tolist(), strict=True))
        return out, new

    def _pieces(self, pieces: pa.StringArray, letters: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces and how many each has; ``letters`` if they have nothing else."""
        if letters:
            # Words of letters in one text: each ends with an id that closes a word.
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces), " ")[0].as_py()
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) == len(pieces):
                return ids, np.diff(ends, prepend=0)
        got = [e.ids for e in self.library.encode_batch_fast(_strings(pieces), add_special_tokens=False)]
        length = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(length.sum())), length

    def _learn(self, words: list[str]) -> None:
        """Encode the words that got the last numbers. A word's closing punctuation is a piece of its own: letters
        and other signs never share one."""
        first = len(self.at) - len(words)
        column = pa.array(words, pa.string())
        stems = pc.utf8_rtrim(column, characters=_MARKS)
        cut = pc.and_(pc.not_equal(stems, column), pc.utf8_is_alpha(pc.utf8_slice_codeunits(stems, -1)))
        divided, alone = (np.flatnonzero(c.to_numpy(zero_copy_only=False)) for c in (cut, pc.invert(cut)))
        stems, tails = stems.filter(cut), column.filter(cut)
        tails = _after(tails, pc.binary_length(stems).to_numpy())
        ends, fresh = [], []
        for part in (stems, tails):
            coded = part.dictionary_encode()
            number, new = self._numbers(_strings(coded.dictionary))
            ends.append(number[coded.indices.to_numpy()])
            fresh += new
        alone = np.concatenate([first + alone, len(self.at) - len(fresh) + np.arange(len(fresh))])
        column = pa.concat_arrays([column.filter(pc.invert(cut)), pa.array(fresh, pa.string())])
        letters = pc.utf8_is_alpha(column)
        for kind, chosen in ((True, letters), (False, pc.invert(letters))):
            some, numbers = column.filter(chosen), alone[chosen.to_numpy(zero_copy_only=False)]
            for i in range(0, len(some), 4096):
                self._put(numbers[i : i + 4096], *self._pieces(some[i : i + 4096], kind))
        if len(divided):
            ends = np.stack(ends, axis=1)
            self.met[ends] += 1
            ids = self.pool[ragged(self.start[ends].ravel(), self.length[ends].ravel())]
            self._put(first + divided, ids, self.length[ends].sum(axis=1))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (NULL: none), each closed by the end id, and the number of each text's ids."""
        if len(self.at) > REMEMBERED:
            self.trim()
        folded = _folded(texts)
        odd = pa.array(np.full(len(folded), not self.by_words))
        for mark in self.special:
            odd = pc.or_(odd, pc.match_substring(folded, mark))
        words = pc.split_pattern(pc.if_else(odd, "", folded), " ")
        coded = words.flatten().dictionary_encode()
        number, new = self._numbers(_strings(coded.dictionary))
        if new:
            self._learn(new)
        index = number[coded.indices.to_numpy()]
        self.met[number] += np.bincount(coded.indices.to_numpy(), minlength=len(number))
        length, start = self.length[index], self.start[index]
        ids = self.pool[ragged(start, length)]
        ends = np.concatenate([[0], np.cumsum(length)])[np.cumsum(pc.list_value_length(words).to_numpy())]
        sizes = np.diff(ends, prepend=0)
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(whole):
            got = self.library.encode_batch_fast([t or "" for t in texts.take(pa.array(whole)).to_pylist()], add_special_tokens=False)
            pieces = np.split(ids, ends[:-1])
            for i, g in zip(whole.tolist(), got, strict=True):
                pieces[i] = np.array(g.ids, np.uint32)
                sizes[i] = len(pieces[i])
            ids, ends = np.concatenate(pieces), np.cumsum(sizes)
        # Every id moves on by the end ids before it.
        out = np.full(len(ids) + len(sizes), END_ID, np.uint32)
        inner = np.ones(len(out), bool)
        inner[ends + np.arange(len(sizes))] = False
        out[inner] = ids
        return out, sizes + 1


def _strings(column: pa.Array) -> list[str]:
    """The strings of a column without NULLs; by way of numpy, which makes no Arrow scalar of each."""
    return column.to_numpy(zero_copy_only=False).tolist()


def _bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and where each text begins, with the end."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8), at - at[0]


def _texts(raw: bytes, starts: np.ndarray) -> pa.StringArray:
    return pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(raw))


def _folded(texts: pa.Array) -> pa.StringArray:
    """A-Z to a-z, line feeds to spaces, NULL to the empty text."""
    raw, at = _bytes(pc.fill_null(texts, "").cast(pa.string()))
    return _texts(raw.tobytes().translate(_FOLD), at)


def _after(texts: pa.StringArray, skip: np.ndarray) -> pa.StringArray:
    """Each text without its first ``skip`` bytes."""
    raw, at = _bytes(texts)
    length = np.diff(at) - skip
    return _texts(raw[ragged(at[:-1] + skip, length)].tobytes(), np.concatenate([[0], np.cumsum(length)]))


def same_by_words(library) -> bool:
    """Whether the tokenizer lower-cases, and drops white space before it cuts pieces."""
    rules = json.loads(library.to_str())
    steps = (rules.get("normalizer") or {}).get("normalizers") or []
    cuts = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or []
    split = cuts[0] if cuts else {}
    return (
        [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
        and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
        and split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True
        and split["pattern"].get("Regex", "").endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        and all(c["type"] == "ByteLevel" and not c["add_prefix_space"] for c in cuts[1:])
        and rules.get("post_processor") is None
    )


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for length[0] numbers, then the same for the next."""
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


def repair(symbols: np.ndarray, first: int, least: int = LEAST):
    """(symbols, rules): nonterminals from ``first`` on, until no pair occurs ``least`` times.

    A pair that is rare stays rare, so a round counts only places whose pair was frequent before or has a new id.
    """
    rules = [np.zeros((0, 2), np.uint32)]
    base = first
    active = np.ones(max(len(symbols) - 1, 0), bool)
    active &= (symbols[:-1] != END_ID) & (symbols[1:] != END_ID)
    while True:
        place = np.flatnonzero(active)
        left, right = symbols[place], symbols[place + 1]
        # In a run of one id only every second place can be replaced.
        same = np.flatnonzero(left == right)
        starts = np.diff(place[same], prepend=-2) != 1
        offset = np.arange(len(same)) - np.flatnonzero(starts)[np.cumsum(starts) - 1] if len(same) else same
        free = np.ones(len(place), bool)
        free[same[offset % 2 == 1]] = False
        # Two ids side by side as one number; of 32 bits as long as ids have 16.
        bits, kind = (16, np.uint32) if base <= 1 << 16 else (32, np.uint64)
        pair = (left.astype(kind) << kind(bits)) | right
        # A count per hash bucket bounds the count of each pair in it, which spares sorting most pairs.
        bucket = ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        often = np.bincount(bucket[free], minlength=1 << 20)[bucket] >= least
        active[place[~often]] = False
        place, pair = place[often & free], pair[often & free]
        values, counts = np.unique(pair, return_counts=True)
        values, counts = values[counts >= least], counts[counts >= least]
        lefts, rights = values >> kind(bits), values & kind((1 << bits) - 1)
        # 0: left end, 1: right end, 2: both, of equal pairs.
        side: dict[int, int] = {}
        chosen = []
        order = np.lexsort((values, -counts))
        for i, x, y in zip(order.tolist(), lefts[order].tolist(), rights[order].tolist(), strict=True):
            if x == y:
                if x not in side:
                    side[x] = 2
                    chosen.append(i)
            elif side.get(x, 0) == 0 and side.get(y, 1) == 1:
                side[x], side[y] = 0, 1
                chosen.append(i)
        if not chosen:
            break
        chosen = np.sort(np.array(chosen))
        keys = values[chosen]
        begins, closes = np.zeros(base, bool), np.zeros(base, bool)
        begins[lefts[chosen]], closes[rights[chosen]] = True, True
        may = np.flatnonzero(begins[pair >> kind(bits)] & closes[pair & kind((1 << bits) - 1)])
        at = np.minimum(np.searchsorted(keys, pair[may]), len(keys) - 1)
        known = keys[at] == pair[may]
        hit = place[may][known]
        symbols = symbols.copy()
        symbols[hit] = base + at[known]
        # The pairs on both sides of a new id are new, unless a document ends there.
        active = np.append(active, False)
        active[hit[hit > 0] - 1] = True
        active[hit] = True
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        symbols, active = symbols[keep], active[keep][:-1]
        active &= (symbols[:-1] != END_ID) & (symbols[1:] != END_ID)
        base += len(keys)
        rules.append(np.stack([lefts[chosen], rights[chosen]], axis=1).astype(np.uint32))
    return symbols, np.concatenate(rules)


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids behind each nonterminal; a rule's sides are ids or earlier nonterminals."""
    out = np.zeros(len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        out[i] = (out[a - first] if a >= first else 1) + (out[b - first] if b >= first else 1)
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The ids behind ``symbols``: every rule is expanded once, then the runs are strung together."""
    if not len(rules):
        return symbols.astype(np.uint32)
    lengths = expansion_lengths(rules, first)
    ends = first + np.cumsum(lengths)
    pool = np.concatenate([np.arange(first, dtype=np.uint32), np.zeros(int(lengths.sum()), np.uint32)])
    start = np.concatenate([np.arange(first), ends - lengths])
    length = np.concatenate([np.ones(first, np.int64), lengths])
    for i, (a, b) in enumerate(rules.tolist()):
        to, mid = first + i, start[first + i] + length[a]
        pool[start[to] : mid] = pool[start[a] : start[a] + length[a]]
        pool[mid : mid + length[b]] = pool[start[b] : start[b] + length[b]]
    return pool[ragged(start[symbols], length[symbols])]


def pack(ids: np.ndarray, sizes: np.ndarray, first: int) -> bytes:
    """One shard's payload: ``sizes`` ids of each document, nonterminals from ``first`` on."""
    symbols, rules = repair(ids.astype(np.uint32), first)
    lengths = expansion_lengths(rules, first)
    width = np.ones(len(symbols), np.int64)
    deep = symbols >= first
    width[deep] = lengths[symbols[deep] - first] if len(rules) else 1
    id_start = np.concatenate([[0], np.cumsum(sizes)])
    symbol_start = np.searchsorted(np.concatenate([[0], np.cumsum(width)]), id_start)
    wide = 2 if first + len(rules) <= 1 << 16 else 4
    head = _HEAD.pack(_MAGIC, first, len(rules), len(symbols), len(sizes), wide, 0)
    starts = np.stack([symbol_start, id_start], axis=1).astype("<u8")
    return b"".join(
        [head, rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), starts.tobytes(), symbols.astype(f"<u{wide}").tobytes()]
    )


def unpack(payload: bytes) -> dict:
    """The parts of a payload as arrays over its bytes."""
    magic, first, n_rules, n_symbols, n_docs, wide, _ = _HEAD.unpack_from(payload)
    if magic != _MAGIC:
        raise ValueError("not a token shard")
    at = _HEAD.size
    rules = np.frombuffer(payload, "<u4", 2 * n_rules, at).reshape(-1, 2)
    lengths = np.frombuffer(payload, "<u4", n_rules, at := at + 8 * n_rules)
    starts = np.frombuffer(payload, "<u8", 2 * (n_docs + 1), at := at + 4 * n_rules).reshape(-1, 2)
    symbols = np.frombuffer(payload, f"<u{wide}", n_symbols, at + 16 * (n_docs + 1))
    return {"first": first, "rules": rules, "lengths": lengths, "starts": starts.astype(np.int64), "symbols": symbols}


def document(payload: bytes, i: int) -> np.ndarray:
    """Ids of the shard's document ``i``, the end id included."""
    s = unpack(payload)
    return expand(s["symbols"][s["starts"][i, 0] : s["starts"][i + 1, 0]], s["rules"], s["first"])


_encoders: dict[str, Encoder] = {}


def _encode_partition(path: str, shard_ids: int, schema: pa.Schema):
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        first = encoder.library.get_vocab_size(with_added_tokens=True)
        part, number = TaskContext.get().partitionId(), 0
        docs, ids, sizes, held = [], [], [], 0

        def shard() -> pa.RecordBatch:
            all_ids, all_sizes = np.concatenate(ids), np.concatenate(sizes)
            row = [[part], [number], [docs], [len(all_ids)], [pack(all_ids, all_sizes, first)]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            texts, keys = batch.column("text"), batch.column("doc_id")
            chars = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                to = int(np.searchsorted(chars, (chars[at - 1] if at else 0) + BATCH_CHARS)) + 1
                got, n = encoder.encode(texts[at:to])
                ids.append(got)
                sizes.append(n)
                docs.extend(keys[at:to].to_pylist())
                held, at = held + len(got), at + len(n)
                if held >= shard_ids:
                    yield shard()
                    number, docs, ids, sizes, held = number + 1, [], [], [], 0
        if docs:
            yield shard()

    return shards


def write_tokens(docs: DataFrame, path: str, tokenizer: str, shard_ids: int = SHARD_IDS) -> None:
    """Write the ids of ``docs`` (doc_id, text) to the store at ``path``."""
    id_type = docs.schema["doc_id"].dataType
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"))
    ordered = ordered.repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest", "text")
    spec = f"part int, shard int, docs array<{id_type.simpleString()}>, n_ids bigint, payload binary"
    fields = [("part", pa.int32()), ("shard", pa.int32()), ("docs", pa.list_(to_arrow_type(id_type))), ("n_ids", pa.int64()), ("payload", pa.binary())]
    run = _encode_partition(tokenizer, shard_ids, pa.schema(fields))
    rows = ordered.select("doc_id", "text").mapInArrow(run, spec)
    rows.write.option("parquet.block.size", 16 << 20).option("compression", "zstd").parquet(path)


def _decode(schema: pa.Schema):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, shard, docs, payload = (batch.column(n)[i] for n in ("part", "shard", "docs", "payload"))
                s = unpack(payload.as_buffer().to_pybytes())
                ids = expand(s["symbols"], s["rules"], s["first"]).astype("<u4")
                cuts, raw = s["starts"][:, 1], memoryview(ids.tobytes())
                n = len(cuts) - 1
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                values = [[part.as_py()] * n, [shard.as_py()] * n, docs.values, cuts[:-1], np.diff(cuts), crc]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) if not isinstance(v, pa.Array) else v for v, f in zip(values, schema, strict=True)], schema=schema)

    return rows


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents in the store at ``path``.

    ``start`` counts the ids of all documents before. Totals are summed per shard and per partition; the
    partition totals, as many as the store was written with, are the only thing that meets in one place.
    """
    store = spark.read.parquet(path)
    totals = dict(store.groupBy("part").agg(F.sum("n_ids")).collect())
    base, before = {}, 0
    for part in sorted(totals):
        base[part], before = before, before + totals[part]
    bases = spark.createDataFrame(sorted(base.items()), "part int, base bigint")
    sizes = store.select("part", "shard", "n_ids")
    ahead = F.sum("n_ids").over(W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("part", "shard", F.coalesce(ahead, F.lit(0)).alias("ahead")).join(F.broadcast(bases), "part")
    offsets = offsets.select("part", "shard", (F.col("base") + F.col("ahead")).alias("first"))
    id_type = store.schema["docs"].dataType.elementType
    kind = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("doc_id", to_arrow_type(id_type)), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    spec = f"part int, shard int, doc_id {id_type.simpleString()}, at bigint, n_tokens bigint, ids_crc32 bigint"
    rows = store.select("part", "shard", "docs", "payload").mapInArrow(_decode(kind), spec)
    return rows.join(offsets, ["part", "shard"]).select(
        "doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def stored(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` to a new store in the shared folder and read it back."""
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer or public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, path)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum in the token store."""
    return stored(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
