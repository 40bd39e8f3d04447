"""Operator 7: token ids in files coded by a static range asymmetric numeral system (rANS).

File layout (all integers little-endian; each record is followed by RECORD_END):

* header: b"SFRH", u32 length of the rest, u32 part and u32 number of the file in it (files in this
  order hold the documents in theirs), u8 scale bits, u16 lanes, u32 steps of a segment, u32 number of symbols, then the zlib-packed u32 frequency table; u32 crc32 of what precedes it.
* block: b"SFRB", u64 length of the rest, u32 documents, u64 ids, u32 segments, u32 words,
  u32 length of the zlib-packed index (i64 doc ids, u8 null marks, u64 lengths), the index; for each
  segment u32 first word, u32 crc32 of its ids and one u64 state per lane; the u32 words;
  u32 crc32 of all that precedes it.

A file ends after about FILE_BYTES, so that readers can hold one. All blocks share the frequency table. A block's ids go round robin to its lanes, which write to one
word stream. Each segment's checkpoint has the lanes' states and the place in the stream, so any
segment of any block can be decoded by itself, and its checksum proves it.

Edge cases: a null or empty text has the end id alone; rows with a null doc_id come first; rows that share
a doc_id follow one another in the order of a hash of their ids, so that runs agree and a hot doc_id is dealt over many
parts, and rows that are equal in both have equal entries; very long texts are blocks of their own; an empty table gives
no documents; only doc_id and text are read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.llm import common, tokens

RECORD_END = b"\r\nSFR."
SCALE, LANES, STEPS, BLOCK = 20, 4096, 64, 1 << 19
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<IIBHII")
_BLOCK = struct.Struct("<IQIII")


def frequencies(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Counts brought to a sum of 2**scale; what occurs keeps at least 1. No counts at all: zeros."""
    counts = np.asarray(counts, np.float64)
    seen = counts > 0
    if not seen.any():
        return np.zeros(len(counts), np.uint32)
    whole = 1 << scale
    if seen.sum() > whole // 2:
        raise ValueError("too many symbols for the scale")
    f = np.where(seen, np.maximum(1, np.floor(counts * (whole / counts.sum()))), 0).astype(np.int64)
    over = int(f.sum()) - whole
    for k in np.argsort(-f, kind="stable"):
        if over == 0:
            break
        take = min(over, int(f[k]) - 1) if over > 0 else over
        f[k] -= take
        over -= take
    return f.astype(np.uint32)


class Coder:
    def __init__(self, freq: np.ndarray, scale: int = SCALE, lanes: int = LANES, steps: int = STEPS):
        self.scale, self.lanes, self.steps = scale, lanes, steps
        self.freq = freq.astype(np.uint32)
        self.f = freq.astype(np.uint64)
        self.cum = np.concatenate(([0], np.cumsum(self.f)))[:-1].astype(np.uint64)
        self.limit = self.f << np.uint64(63 - scale)  # ((2**31 >> scale) << 32) * f
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.f), dtype=np.uint32), self.f.astype(np.int64))
        return self._slots

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
        """(words, checkpoints: first word, crc32 of the segment's ids, states of the lanes)."""
        n, lanes = len(ids), self.lanes
        total = -(-n // lanes)
        state = np.full(lanes, _LOW, np.uint64)
        f, cum, limit = self.f[ids], self.cum[ids], self.limit[ids]
        out: list[np.ndarray] = [None] * total  # type: ignore[list-item]
        states: dict[int, np.ndarray] = {}
        shift, low = np.uint64(32), np.uint64(0xFFFFFFFF)
        for t in range(total - 1, -1, -1):
            a, b = t * lanes, min(n, (t + 1) * lanes)
            x = state[: b - a]
            full = np.flatnonzero(x >= limit[a:b])
            moved = x[full]
            out[t] = (moved & low).astype(np.uint32)
            x[full] = moved >> shift
            q, r = np.divmod(x, f[a:b])
            state[: b - a] = (q << np.uint64(self.scale)) + r + cum[a:b]
            if t % self.steps == 0:
                states[t] = state.copy()
        sizes = np.array([len(w) for w in out], np.int64)
        first = np.concatenate(([0], np.cumsum(sizes)))
        span = self.steps * lanes
        points = [(int(first[t]), tokens.crc32(ids[t * lanes : t * lanes + span]), states[t]) for t in range(0, total, self.steps)]
        return np.concatenate(out) if out else np.empty(0, np.uint32), points

    def decode_segment(self, words: np.ndarray, point: tuple[int, int, np.ndarray], n: int) -> np.ndarray:
        """The n ids of one segment, from its checkpoint alone; ValueError if its checksum differs."""
        at, check, state = point[0], point[1], point[2].astype(np.uint64)
        ids = np.empty(n, np.uint32)
        mask, scale, shift = np.uint64((1 << self.scale) - 1), np.uint64(self.scale), np.uint64(32)
        for a in range(0, n, self.lanes):
            b = min(n, a + self.lanes)
            x = state[: b - a]
            slot = x & mask
            s = self.slots[slot]
            ids[a:b] = s
            x = self.f[s] * (x >> scale) + slot - self.cum[s]
            low = np.flatnonzero(x < _LOW)
            x[low] = (x[low] << shift) | words[at : at + len(low)]
            at += len(low)
            state[: b - a] = x
        if tokens.crc32(ids) != check:
            raise ValueError("a segment's checksum differs")
        return ids

    def header(self, part: int = 0, number: int = 0) -> bytes:
        body = _HEAD.pack(part, number, self.scale, self.lanes, self.steps, len(self.f)) + zlib.compress(self.freq.astype("<u4").tobytes(), 6)
        head = b"SFRH" + struct.pack("<I", len(body) + 4) + body
        return head + struct.pack("<I", zlib.crc32(head))

    def block(self, doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> bytes:
        words, points = self.encode(ids)
        nulls = np.array([x is None for x in doc_ids], np.uint8)
        index = zlib.compress(np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes() + nulls.tobytes() + np.asarray(sizes, "<u8").tobytes(), 1)
        body = [_BLOCK.pack(len(doc_ids), len(ids), len(points), len(words), len(index)), index]
        body += [struct.pack("<II", w, c) + s.astype("<u8").tobytes() for w, c, s in points]
        body.append(words.astype("<u4").tobytes())
        length = sum(map(len, body)) + 4
        head = b"SFRB" + struct.pack("<Q", length) + b"".join(body)
        return head + struct.pack("<I", zlib.crc32(head))


def read_file(content: bytes):
    """Each block of a file: ((part, number of the file), doc ids, lengths, ids)."""
    view, at, coder = memoryview(content), 0, None
    while at < len(view):
        kind = bytes(view[at : at + 4])
        if kind == b"SFRH":
            (length,) = struct.unpack_from("<I", view, at + 4)
            start, end = at + 8, at + 8 + length
            _checked(view, at, end)
            part, number, scale, lanes, steps, n = _HEAD.unpack_from(view, start)
            freq = np.frombuffer(zlib.decompress(view[start + _HEAD.size : end - 4]), "<u4")
            if len(freq) != n:
                raise ValueError("the frequency table is cut short")
            coder = Coder(freq, scale, lanes, steps)
        elif kind == b"SFRB" and coder:
            (length,) = struct.unpack_from("<Q", view, at + 4)
            start, end = at + 12, at + 12 + length
            _checked(view, at, end)
            n_docs, n_ids, n_points, n_words, n_index = _BLOCK.unpack_from(view, start)
            start += _BLOCK.size
            index = zlib.decompress(view[start : start + n_index])
            start += n_index
            doc_ids = np.frombuffer(index, "<i8", n_docs)
            nulls = np.frombuffer(index, "u1", n_docs, 8 * n_docs)
            sizes = np.frombuffer(index, "<u8", n_docs, 9 * n_docs).astype(np.int64)
            size = 8 + 8 * coder.lanes
            points = [(*struct.unpack_from("<II", view, p), np.frombuffer(view, "<u8", coder.lanes, p + 8)) for p in range(start, start + n_points * size, size)]
            words = np.frombuffer(view, "<u4", n_words, start + n_points * size)
            span = coder.steps * coder.lanes
            parts = [coder.decode_segment(words, p, min(span, n_ids - k * span)) for k, p in enumerate(points)]
            yield (part, number), [None if z else int(d) for d, z in zip(doc_ids, nulls, strict=True)], sizes, np.concatenate(parts) if parts else np.empty(0, np.uint32)
        else:
            raise ValueError("not a record of this format")
        at = end
        if bytes(view[at : at + len(RECORD_END)]) != RECORD_END:
            raise ValueError("a record has no end")
        at += len(RECORD_END)


def _checked(view: memoryview, at: int, end: int) -> None:
    if end > len(view) or struct.unpack_from("<I", view, end - 4)[0] != zlib.crc32(view[at : end - 4]):
        raise ValueError("a record's checksum differs")


def token_table(docs: DataFrame, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, ids, counts): the ids of each whole text and the end id, as zstandard-packed integers.

    counts is null but in one more row per task, without ids, that has the task's id counts; so the
    frequency table needs no second pass over the ids.
    """
    path = tokenizer or tokens.default_path()

    def made(batches):
        pack = zstandard.ZstdCompressor(level=1, write_content_size=True)
        total, docs_seen = np.zeros(end_id + 1, np.int64), 0
        for batch in batches:
            ids_of = batch.column(0)
            for first, flat, sizes in tokens.encoded(batch.column(1), path):
                more = np.bincount(flat, minlength=len(total))
                more[: len(total)] += total
                total, docs_seen = more, docs_seen + len(sizes)
                flat = flat.astype("<u4") if len(more) > 1 << 16 else flat.astype("<u2")
                end, at, out = np.array([end_id], flat.dtype), 0, []
                mark = bytes([flat.dtype.itemsize])
                for n in sizes.tolist():
                    out.append(mark + pack.compress(np.concatenate((flat[at : at + n], end)).tobytes()))
                    at += n
                yield pa.RecordBatch.from_arrays([ids_of.slice(first, len(sizes)), pa.array(out, pa.binary()), pa.nulls(len(sizes), pa.binary())], ["doc_id", "ids", "counts"])
        if docs_seen:
            total[end_id] += docs_seen
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([zlib.compress(total.astype("<i8").tobytes(), 1)], pa.binary())], ["doc_id", "ids", "counts"])

    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.map_arrow(table, made, "doc_id long, ids binary, counts binary")


def token_counts(table: DataFrame) -> np.ndarray:
    """How often each id occurs, from a token_table's count rows; at most the vocabulary's size reaches the driver."""

    def spread(batches):
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                total = np.frombuffer(zlib.decompress(packed), "<i8")
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["id", "n"])

    rows = common.map_arrow(table.where("counts is not null").select("counts"), spread, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, np.int64)
    counts[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


def _unpacked(values, unpack: zstandard.ZstdDecompressor) -> list[np.ndarray]:
    return [np.frombuffer(unpack.decompress(v[1:]), "<u2" if v[0] == 2 else "<u4") for v in values.to_pylist()]


#: Bytes of packed ids that one task of the writer sorts and codes, at most on average.
PART_BYTES = 256 << 20


def write(docs: DataFrame, path: str, end_id: int = 2, tokenizer: str | None = None, block: int = BLOCK, size: int = common.FILE_BYTES) -> None:
    """Writes the documents' ids to files of this format, in ascending doc_id order over all files (null first)."""
    spark = docs.sparkSession
    held_at = common.new_path(spark, "ids")
    token_table(docs, end_id, tokenizer).write.parquet(held_at)
    table = spark.read.schema("doc_id long, ids binary, counts binary").parquet(held_at)
    freq = frequencies(token_counts(table))

    def coded(batches):
        from pyspark import TaskContext

        tokens.release()
        part, coder, unpack = TaskContext.get().partitionId(), Coder(freq), zstandard.ZstdDecompressor()

        def blocks():
            names, sizes, held, n = [], [], [], 0
            for batch in batches:
                for name, ids in zip(batch.column(0).to_pylist(), _unpacked(batch.column(1), unpack), strict=True):
                    names.append(name)
                    sizes.append(len(ids))
                    held.append(ids)
                    n += len(ids)
                    if n >= block:
                        yield coder.block(names, np.array(sizes), np.concatenate(held).astype(np.uint32))
                        names, sizes, held, n = [], [], [], 0
            if names:
                yield coder.block(names, np.array(sizes), np.concatenate(held).astype(np.uint32))

        yield from common.files_of(blocks(), lambda k: coder.header(part, k), RECORD_END, size)

    parts = -(-common.size_of(spark, held_at) // PART_BYTES)
    rows = table.where("ids is not null").select("doc_id", "ids", F.xxhash64("ids").alias("h"))
    order = ["doc_id", "h"]
    ranged = rows.repartitionByRange(parts, *order) if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else rows.repartitionByRange(*order)
    common.write_blobs(common.map_arrow(ranged.sortWithinPartitions(*order), coded, "data binary"), "data", path, RECORD_END)
    common.remove(spark, held_at)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the decoded ids of all files."""

    def read(batches):
        tokens.release()
        for batch in batches:
            for content in batch.column(1):
                at, k = 0, 0
                for file, doc_ids, sizes, ids in read_file(content.as_buffer()):
                    ends = np.cumsum(sizes)
                    begins = ends - sizes
                    checks = [tokens.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                    n = len(doc_ids)
                    columns = [np.full(n, file[0]), np.full(n, file[1]), np.arange(k, k + n), doc_ids, at + begins, sizes, checks]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "number", "k", "doc_id", "at", "n_tokens", "ids_crc32"])
                    at, k = at + int(sizes.sum()), k + n

    rows = common.saved(common.map_arrow(common.read_blobs(spark, path), read, "part long, number long, k long, doc_id long, at long, n_tokens long, ids_crc32 long"), "index")
    files = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    # one row per file of FILE_BYTES, so the running sum over files is small
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("part", "number", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(base, ["part", "number"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
