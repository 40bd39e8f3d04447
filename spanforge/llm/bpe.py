"""Operator 13: byte-level BPE of whole texts with reuse of content-defined chunks.

A rolling hash of the last 32 bytes cuts a text where its top bits are zero, so that equal passages in
different documents give equal chunks whatever stands before them. A first scan counts chunks by digest.
Those whose reuse saves most, up to a fixed number of bytes, are encoded once for the whole table, each by
one task that has it, and this dictionary of bounded size is broadcast; every other chunk is encoded where
it stands, once for a worker as long as it is remembered. No text is shuffled, and what is chosen changes
only the work, never the ids.

Encoded chunks don't simply concatenate: units of the tokenizer (a word with the space before it, a run of
marks or spaces, a special token) may lie across the cut. At each join a window that begins at a unit
of the left side, far enough from the cut, is encoded anew and grows to the right until one of its units
begins where one of the right chunk begins. From there on both agree, since what a unit is depends on
nothing before it and on one character after it; special tokens, which are cut out first, are kept away
from both ends of a window by their length. If nothing agrees in the right chunk, all of it is replaced.

Edge cases: a null or empty text has no ids; bytes that are not UTF-8 are replaced by U+FFFD first; the
string of a special token becomes its id, as in the library; repeated rows and ids, null ids and an empty
table are nothing special; very long texts are cut and joined like others, and one without any cut point is
cut at fixed lengths. encode keeps all columns but those it makes; a column `ids` of the input is replaced.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.llm import common

BYTE_BPE = "byte_bpe_50k.json"
#: Bits of the hash that are zero at a cut, least and largest bytes of a chunk, and bytes that are hashed at once.
BITS, LEAST, MOST, BLOCK = 10, 256, 8192, 1 << 20
#: Bytes of the dictionary's texts, with those that an entry counts for itself; text bytes that a worker remembers, and takes at once.
DICTIONARY, ENTRY, KEEP, TAKE = 16 << 20, 64, 8 << 20, 1 << 20
#: Distinct units that a worker keeps, and words that are encoded in one string.
UNITS, LINES = 250_000, 128
#: Bytes to the right of a cut that a window has at first.
REACH = 48
#: Texts of these characters alone are cut into units here: letters of European alphabets, and no separators on which libraries differ.
_PLAIN = re.compile("[\t\n\r -~¡-±´-¸º»¿-\u036f\u0400-\u052f]*")
#: The public tokenizers' pattern in the terms of `re`: among those characters, letters are what is a word but neither a digit nor _.
_UNIT = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_GEAR = np.random.default_rng(13).integers(0, 1 << 32, 256, dtype=np.uint32)


def default_path() -> str:
    return public_tokenizers.path(BYTE_BPE)


# chunks


def _candidates(data: np.ndarray) -> np.ndarray:
    """Places after which bytes may be cut: by the hash of the 32 bytes before, and only between characters."""
    found = []
    for at in range(0, len(data), BLOCK):
        lead = min(at, 31)
        h = _GEAR[data[at - lead : at + BLOCK]]
        for s in (1, 2, 4, 8, 16):
            more = h.copy()
            more[s:] += h[:-s] << np.uint32(s)
            h = more
        found.append(np.flatnonzero(h[lead:] >> np.uint32(32 - BITS) == 0) + at + 1)
    places = np.concatenate(found) if found else np.empty(0, np.int64)
    inside = places < len(data)
    keep = np.ones(len(places), bool)
    keep[inside] = data[places[inside]] & 0xC0 != 0x80
    return places[keep]


def _ends(data: np.ndarray, places: list[int], start: int, stop: int) -> list[int]:
    """Ends of the chunks of data[start:stop], of LEAST to MOST bytes but for the last one; places: candidates inside."""
    out = []

    def forced(until: int, start: int) -> int:
        while until - start > MOST:
            start += MOST
            while data[start] & 0xC0 == 0x80:
                start -= 1
            out.append(start)
        return start

    for p in places:
        start = forced(p, start)
        if p - start >= LEAST and p < stop:
            out.append(p)
            start = p
    if stop > forced(stop, start):
        out.append(stop)
    return out


def chunked(column: pa.Array) -> Iterator[tuple[bytes, list[int]]]:
    """(text, ends of its chunks) of a string column; a null is an empty text."""
    data = column.cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int64)
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)[: offsets[-1]]
    places = _candidates(raw[offsets[0] :]) + offsets[0]
    within = np.searchsorted(places, offsets, "right")
    whole = raw.data
    for k in range(len(data)):
        a, b = int(offsets[k]), int(offsets[k + 1])
        ends = _ends(raw, places[within[k] : within[k + 1]].tolist(), a, b)
        yield bytes(whole[a:b]), [e - a for e in ends]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def chunks_of(text: bytes, ends: list[int]) -> list[bytes]:
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


# encoding


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


class _Index(dict):
    """Numbers keys as they come; new: those since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key):
        value = self[key] = len(self)
        self.new.append(key)
        return value


def _grown(x: np.ndarray, n: int) -> np.ndarray:
    """The array with room for n elements, twice as many at least where it grows."""
    return x if n <= len(x) else np.concatenate((x, np.empty(max(n, 2 * len(x)) - len(x), x.dtype)))


class Units:
    """Ids of distinct units, each encoded once by the library as long as they are kept.

    Words are encoded in groups, a line each, by a copy of the tokenizer that only cuts at line ends; other units one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.each, self.lines = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.lines.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        for t in (self.each, self.lines):
            t.no_truncation()
            t.no_padding()
            if hasattr(t.model, "_resize_cache"):
                t.model._resize_cache(0)  # the index takes its place
        end = self.each.encode("\n", add_special_tokens=False).ids
        self.end = end[0] if len(end) == 1 else None
        self._clear()

    def _clear(self) -> None:
        self.index, self.used = _Index(), 0
        self.flat, self.size, self.start = np.empty(1 << 16, np.uint32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _encoded(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = [e.ids for e in self.each.encode_batch_fast(units, add_special_tokens=False)]
        size = np.array([len(x) for x in made], np.int64)
        return np.fromiter(chain.from_iterable(made), np.uint32, int(size.sum())), size

    def _words(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = self.lines.encode_batch_fast(["".join([u + "\n" for u in units[k : k + LINES]]) for k in range(0, len(units), LINES)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in made])
        size = np.diff(np.flatnonzero(ids == self.end), prepend=-1) - 1
        return ids[ids != self.end], size

    def _learn(self, known: int) -> None:
        new, self.index.new = self.index.new, []
        word = np.fromiter((self.end is not None and u.strip(" ").isalpha() for u in new), bool, len(new))
        size, flat = np.zeros(len(new), np.int64), []
        start, at = np.zeros(len(new), np.int64), self.used
        for which, encode in ((word, self._words), (~word, self._encoded)):
            order = np.flatnonzero(which)
            if len(order):
                ids, n = encode([new[k] for k in order])
                flat.append(ids)
                size[order], start[order] = n, at + np.cumsum(n) - n
                at += len(ids)
        self.flat, self.size, self.start = (_grown(x, n) for x, n in ((self.flat, at), (self.size, len(self.index)), (self.start, len(self.index))))
        self.size[known : len(self.index)], self.start[known : len(self.index)] = size, start
        self.flat[self.used : at] = np.concatenate(flat)
        self.used = at

    def ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many each unit has)."""
        if len(self.index) > UNITS:
            self._clear()
        known = len(self.index)
        code = np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))
        if self.index.new:
            self._learn(known)
        size = self.size[code]
        at = np.repeat(self.start[code] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.flat[at], size


class ChunkEncoder:
    """A byte-level BPE tokenizer file, with the bytes of each id and encoded chunks that it remembers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        t = self.tokenizer = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        if t.normalizer is not None or not isinstance(t.pre_tokenizer, pre_tokenizers.ByteLevel) or t.pre_tokenizer.add_prefix_space:
            raise ValueError(f"{path} changes texts or adds spaces before it cuts them, so its ids can't be put together from chunks")
        byte_of, special = _byte_of(), {i: x.content for i, x in t.get_added_tokens_decoder().items()}
        vocabulary = t.get_vocab()
        self.pieces = [b""] * (1 + max([*vocabulary.values(), *special], default=0))
        for token, i in vocabulary.items():
            self.pieces[i] = bytes(byte_of[c] for c in token) if i not in special else special[i].encode()
        self.sizes = np.array([len(p) for p in self.pieces], np.int64)
        self.back = max([len(s.encode()) for s in special.values()], default=0) + 3
        self.special = list(special.values())
        self.units = Units(path)
        self.known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        self.held = 0

    def encode(self, chunks: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, which of them begin a unit) of each chunk by itself: its units are looked up, or the library encodes it as a whole."""
        texts = [c.decode() for c in chunks]
        plain = [self.tokenizer.pre_tokenizer.use_regex and _PLAIN.fullmatch(x) is not None and not any(s in x for s in self.special) for x in texts]
        out: list = [None] * len(texts)
        cut = [_UNIT.findall(x) for x, p in zip(texts, plain, strict=True) if p]
        ids, size = self.units.ids(list(chain.from_iterable(cut)))
        heads = np.zeros(len(ids), bool)
        heads[np.cumsum(size) - size] = True
        n = np.concatenate(([0], np.cumsum(size)))[np.cumsum([0, *map(len, cut)])].tolist()
        for k, a, b in zip((k for k, p in enumerate(plain) if p), n, n[1:], strict=False):
            out[k] = (ids[a:b], heads[a:b])
        others = [k for k, p in enumerate(plain) if not p]
        for k, e in zip(others, self.tokenizer.encode_batch([texts[k] for k in others], add_special_tokens=False), strict=True):
            unit = np.array(e.word_ids, np.int64)
            first = np.ones(len(unit), bool)
            first[1:] = unit[1:] != unit[:-1]
            out[k] = (np.array(e.ids, np.uint32), first)
        return out

    def lookup(self, chunks: list[bytes], dictionary: dict) -> list[tuple[np.ndarray, np.ndarray]]:
        """As encode, with what the dictionary or this worker has already."""
        keys = [digest(c) for c in chunks]
        new: dict[bytes, bytes] = {}
        for k, c in zip(keys, chunks, strict=True):
            if k not in self.known and k not in dictionary:
                new.setdefault(k, c)
        if self.held > KEEP:
            fresh = {k: self.known[k] for k in keys if k in self.known}
            self.known, self.held = fresh, 0
        self.known.update((k, (i.copy(), h.copy())) for k, (i, h) in zip(new, self.encode(list(new.values())), strict=True))
        self.held += sum(map(len, new.values()))
        return [self.known[k] if k in self.known else unpacked(dictionary[k]) for k in keys]

    def texts(self, held: list[tuple[bytes, list[int]]], dictionary: dict) -> list[np.ndarray]:
        """The ids of texts with the ends of their chunks. The windows that the joins most likely need are encoded together."""
        each = iter(self.lookup([c for text, ends in held for c in chunks_of(text, ends)], dictionary))
        parts = [[next(each) for _ in ends] for _, ends in held]
        places = [self._likely(*h, p) for h, p in zip(held, parts, strict=True)]
        made = iter(self.encode([text[a:b] for (text, _), spans in zip(held, places, strict=True) for a, b in spans]))
        return [self.joined(text, ends, p, {x: next(made) for x in spans}) for (text, ends), p, spans in zip(held, parts, places, strict=True)]

    def _likely(self, text: bytes, ends: list[int], parts: list) -> list[tuple[int, int]]:
        """Windows at the joins as they are if the last unit far enough before a join lies in the chunk before it."""
        out, start = [], 0
        for join, end, (ids, heads) in zip(ends, ends[1:], parts, strict=False):
            at = self._starts(start, ids)
            fit = np.flatnonzero(heads[: np.searchsorted(at, join - self.back, "right")])
            if len(fit):
                out.append((int(at[fit[-1]]), self._stop(text, join + REACH, end)))
            start = join
        return list(dict.fromkeys(out))

    @staticmethod
    def _stop(text: bytes, stop: int, end: int) -> int:
        stop = min(stop, end)
        while stop < end and text[stop] & 0xC0 == 0x80:
            stop += 1
        return stop

    def joined(self, text: bytes, ends: list[int], parts: list[tuple[np.ndarray, np.ndarray]], made: dict | None = None) -> np.ndarray:
        """The ids of a text out of those of its chunks; made: windows (first byte, end) that are encoded already."""
        if len(parts) < 2:
            return parts[0][0] if parts else np.empty(0, np.uint32)
        done = [(0, *parts[0])]  # (first byte, ids, heads) of what is right, but for units near its end
        for join, end, right in zip(ends, ends[1:], parts[1:], strict=False):
            left, keep = self._anchor(done, join)
            reach = REACH
            while True:
                stop = self._stop(text, join + reach, end)
                ids, heads = (made or {}).get((left, stop)) or self.encode([text[left:stop]])[0]
                mine, theirs = self._starts(left, ids), self._starts(join, right[0])
                w = np.flatnonzero(heads & (mine >= join) & (mine <= (stop if stop == len(text) else stop - self.back)))
                r = np.minimum(np.searchsorted(theirs, mine[w]), len(theirs) - 1)
                same = np.flatnonzero((theirs[r] == mine[w]) & right[1][r])
                if len(same):
                    w, r = int(w[same[0]]), int(r[same[0]])
                    self._close(done, keep, left, ids[:w], heads[:w])
                    done.append((int(theirs[r]), right[0][r:], right[1][r:]))
                    break
                if stop == end:
                    self._close(done, keep, left, ids, heads)
                    break
                reach *= 4
        return np.concatenate([ids for _, ids, _ in done])

    def _starts(self, first: int, ids: np.ndarray) -> np.ndarray:
        size = self.sizes[ids]
        return first + np.cumsum(size) - size

    def _anchor(self, done: list, join: int) -> tuple[int, int]:
        """(byte, index in the last piece) of the last unit that begins far enough before a join; pieces are merged until there is one."""
        while True:
            first, ids, heads = done[-1]
            starts = self._starts(first, ids)
            fit = np.flatnonzero(heads[: np.searchsorted(starts, join - self.back, "right")])
            if len(fit):
                return int(starts[fit[-1]]), int(fit[-1])
            if len(done) == 1:
                return first, 0
            b, a = done.pop(), done.pop()
            done.append((a[0], np.concatenate((a[1], b[1])), np.concatenate((a[2], b[2]))))

    def _close(self, done: list, keep: int, left: int, ids: np.ndarray, heads: np.ndarray) -> None:
        """Puts a window in the place of the end of the last piece."""
        first, old, old_heads = done.pop()
        done.append((first, np.concatenate((old[:keep], ids)), np.concatenate((old_heads[:keep], heads))))


def packed(ids: np.ndarray, heads: np.ndarray) -> bytes:
    """An id in the upper 31 bits, and whether it begins a unit in the lowest."""
    return (ids.astype("<u4") << 1 | heads).astype("<u4").tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(data, "<u4")
    return x >> 1, (x & 1).astype(bool)


@lru_cache(1)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


# over the table


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.make_valid_utf8(F.col("text").cast("string")).alias("text"))


def chunk_counts(docs: DataFrame) -> DataFrame:
    """(digest, n, size, carrier) of chunks that occur more than once; carrier: one of the scan's partitions that has it."""

    def counted(batches):
        me, held = TaskContext.get().partitionId(), {}

        def rows():
            n, sizes = zip(*held.values(), strict=True) if held else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(n, pa.int64()), pa.array(sizes, pa.int32()), pa.array([me] * len(held), pa.int32())], ["digest", "n", "size", "carrier"])

        for batch in batches:
            for text, ends in chunked(batch.column(0)):
                for chunk in chunks_of(text, ends):
                    k = digest(chunk)
                    held[k] = (held[k][0] + 1 if k in held else 1, len(chunk))
            if len(held) > 200_000:
                yield rows()
                held = {}
        yield rows()

    parts = common.map_arrow(_texts(docs), counted, "digest binary, n long, size int, carrier int")
    return parts.groupBy("digest").agg(F.sum("n").alias("n"), F.max("size").alias("size"), F.min("carrier").alias("carrier")).where("n > 1")


def chosen(counts: DataFrame, most: int = DICTIONARY) -> dict[bytes, int]:
    """{digest: carrier} of the chunks whose reuse saves most, with `most` bytes together at most, an entry's own included."""
    bucket = F.floor(4 * F.log2((F.col("n") - 1) * F.col("size"))).cast("int")
    counts = common.saved(counts.withColumn("saves", bucket), "chunks")
    sizes = counts.groupBy("saves").agg(F.sum(F.col("size") + ENTRY).alias("bytes")).orderBy(F.desc("saves")).collect()  # 256 rows at most
    total, least = 0, None
    for r in sizes:
        total += r.bytes
        if total > most:
            break
        least = r.saves
    if least is None:
        return {}
    return {bytes(r.digest): r.carrier for r in counts.where(F.col("saves") >= least).select("digest", "carrier").collect()}  # bounded by `most`


def dictionary(docs: DataFrame, path: str, most: int = DICTIONARY) -> dict[bytes, bytes]:
    """{digest: packed ids} of the chosen chunks, each encoded by one task. A partition that isn't as it was in the first scan leaves its chunks out, which costs time only."""
    wanted = chosen(chunk_counts(docs), most)
    if not wanted:
        return {}
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def encoded(batches):
        me, done = TaskContext.get().partitionId(), set()
        for batch in batches:
            found = {}
            for text, ends in chunked(batch.column(0)):
                for chunk in chunks_of(text, ends):
                    k = digest(chunk)
                    if shared.value.get(k) == me and k not in done:
                        done.add(k)
                        found[k] = chunk
            values = [packed(*x) for x in encoder(path).encode(list(found.values()))]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(values, pa.binary())], ["digest", "ids"])

    rows = common.map_arrow(_texts(docs), encoded, "digest binary, ids binary").collect()  # bounded by `most`
    shared.unpersist()
    return {bytes(r.digest): bytes(r.ids) for r in rows}


def encode(docs: DataFrame, tokenizer: str | None = None, most: int = DICTIONARY) -> DataFrame:
    """The rows without their text, with ids array<int>: those of the tokenizers library without special tokens added."""
    path = tokenizer or default_path()
    others = [c for c in docs.columns if c not in ("text", "ids")]
    shared = docs.sparkSession.sparkContext.broadcast(dictionary(docs, path, most))
    schema = T.StructType([*(docs.schema[c] for c in others), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        enc = encoder(path)

        def rows(batch, first, held):
            ids = enc.texts(held, shared.value)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            values = pa.array(np.concatenate(ids).astype(np.int32) if ids else [], pa.int32())
            return pa.RecordBatch.from_arrays([*(c.slice(first, len(held)) for c in batch.columns[:-1]), pa.ListArray.from_arrays(offsets, values)], schema.names)

        for batch in batches:
            first, held, size = 0, [], 0
            for text, ends in chunked(batch.column(batch.num_columns - 1)):
                held.append((text, ends))
                size += len(text)
                if size >= TAKE:
                    yield rows(batch, first, held)
                    first, held, size = first + len(held), [], 0
            if held:
                yield rows(batch, first, held)

    return common.map_arrow(docs.select(*others, F.make_valid_utf8(F.col("text").cast("string")).alias("text")), run, schema)


def decode(rows: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The rows with the text of their ids in the place of ids; special tokens are kept, unknown ids and null give nothing."""
    path = tokenizer or default_path()
    others = [c for c in rows.columns if c not in ("text", "ids")]
    schema = T.StructType([*(rows.schema[c] for c in others), T.StructField("text", T.StringType())])

    def run(batches):
        pieces = encoder(path).pieces
        n = len(pieces)
        for batch in batches:
            rows = (batch.column(batch.num_columns - 1)[k].as_py() or [] for k in range(batch.num_rows))
            texts = [b"".join([pieces[i] for i in x if i is not None and 0 <= i < n]).decode("utf-8", "replace") for x in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], schema.names)

    return common.map_arrow(rows.select(*others, "ids"), run, schema)
