"""Operator 4: SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint has 64 bits; two link at MOST or fewer differing bits. It is cut into three segments
of 22, 21 and 21 bits, padded to 23 for the perfect Golay code (23, 12, 7). Every 23-bit word lies
within three bits of one codeword; the codewords within four bits of a word (one to six of them)
are its fuzzy keys, and words that differ in one bit have each other's codeword among theirs.
Pigeonhole: with four errors over three segments, either a segment has none, or two segments have
one error each. So a bucket per whole segment, and buckets per pair of segments with one side's
codeword and the other's fuzzy keys, hold every linked pair: 36 keys a fingerprint at most.
Candidates of a bucket are verified by their differing bits, and only edges of a spanning forest
leave a bucket. Buckets beyond a bound are split into blocks, and every pair of blocks is a task.

Edge cases: a null or empty text, or one of white space only, has fingerprint zero and links like
any other; fewer than four words make one shingle; equal texts share a fingerprint; a null doc_id
counts for links but never names a group unless all its rows lack one; an empty table gives no rows.
Only doc_id and text are read.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm import common

MOST, WORDS, SEED = 4, 4, 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: The generator polynomial of the binary Golay code, a fixed value.
GENERATOR = 0xC75
#: Fingerprints of a bucket that one task compares, and those under which pairs are listed at once.
BUCKET, SMALL = 4096, 16


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit SimHash of a whole text: a bit is set if more than half of the shingles' hashes have it."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = list(accumulate(map(len, parts), lambda a, n: a + 1 + n))
        starts = [0, *[e + 1 for e in ends]]
        digest = xxhash.xxh64_intdigest
        n = len(parts) - words + 1
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :], strict=False)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 * 256):
        part = hashes[at : at + 255 * 256]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        rows = -(-len(bits) // 255) * 255
        if rows > len(bits):
            bits = np.concatenate((bits, np.zeros((rows - len(bits), 64), np.uint8)))
        # sums of up to 255 bytes stay bytes, so eight columns add up at once
        eights = bits.view(np.uint64).reshape(-1, 255, 8).sum(1, dtype=np.uint64)
        counts += eights.view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(((2 * counts > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


@lru_cache(1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """(syndromes of the three bytes of a word, error pattern of each of the 2048 syndromes)."""

    def rest(w: int) -> int:
        for k in range(22, 10, -1):
            if w >> k & 1:
                w ^= GENERATOR << (k - 11)
        return w

    unit = [rest(1 << k) for k in range(23)]
    errors = np.zeros(2048, np.uint32)
    spots = [(), *[(i,) for i in range(23)], *[(i, j) for i in range(23) for j in range(i)], *[(i, j, k) for i in range(23) for j in range(i) for k in range(j)]]
    for spot in spots:
        s = 0
        for i in spot:
            s ^= unit[i]
        errors[s] = sum(1 << i for i in spot)
    table = np.zeros((3, 256), np.uint32)
    for byte in range(3):
        for v in range(256):
            for i in range(8):
                if v >> i & 1 and 8 * byte + i < 23:
                    table[byte, v] ^= unit[8 * byte + i]
    return table, errors


def codeword(w: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    table, errors = _golay()
    syndrome = table[0][w & 255] ^ table[1][w >> 8 & 255] ^ table[2][w >> 16]
    return (w ^ errors[syndrome]) >> 11


def fuzzy_keys(w: np.ndarray) -> np.ndarray:
    """(n, 24) codeword indices within four bits of each word, sorted in the row, with repeats."""
    flips = np.concatenate(([0], 1 << np.arange(23))).astype(w.dtype)
    return np.sort(codeword(w[:, None] ^ flips[None, :]), axis=1)


def bucket_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, position of the fingerprint) of every bucket that each of the uint64 fingerprints is in."""
    parts = [((fingerprints >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    own = np.arange(len(fingerprints))
    keys, rows = [(s << 48) | p for s, p in enumerate(parts)], [own] * 3
    nearest, near = [codeword(p) for p in parts], [fuzzy_keys(p) for p in parts]
    new = [np.concatenate((np.ones((len(own), 1), bool), x[:, 1:] != x[:, :-1]), axis=1) for x in near]
    for t, (i, j) in enumerate(PAIRS):
        for mine, fuzzy, left in ((i, j, True), (j, i, False)):
            r, c = np.nonzero(new[fuzzy] if left else new[fuzzy] & (near[fuzzy] != nearest[fuzzy][:, None]))
            other, this = near[fuzzy][r, c], nearest[mine][r]
            a, b = (this, other) if left else (other, this)
            keys.append(((3 + t) << 48) | (a << 12) | b)
            rows.append(r)
    return np.concatenate(keys), np.concatenate(rows)


def forest(group: np.ndarray, prints: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join, inside each run of equal groups, what links of `most` or fewer bits join."""
    a, b = [], []
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(group)))
    run = np.repeat(sizes, sizes)
    small = np.flatnonzero(run <= SMALL)
    end = np.repeat(starts + sizes, sizes)
    for d in range(1, SMALL):
        small = small[small + d < end[small]]
        if not len(small):
            break
        near = small[np.bitwise_count(prints[small] ^ prints[small + d]) <= most]
        a.append(prints[near])
        b.append(prints[near + d])
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        left = np.unique(prints[s : s + n])
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                x = queue.pop()
                near = np.bitwise_count(left ^ x) <= most
                if near.any():
                    found = left[near]
                    left = left[~near]
                    a.append(np.full(len(found), x))
                    b.append(found)
                    queue.extend(found)
    none = np.empty(0, np.uint64)
    return np.concatenate(a) if a else none, np.concatenate(b) if b else none


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp, th): the fingerprint and the XXH64 of the whole text (null: null) as signed longs."""

    def made(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            prints = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64()), batch.column(2)], ["doc_id", "fp", "th"])

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash(F.col("text"))), made, "doc_id long, fp long, th long")


def text_hash(text: Column) -> Column:
    return F.when(text.isNotNull(), F.xxhash64(text.cast("string"))).alias("th")


def linked(prints: DataFrame, most: int = MOST, bucket: int = BUCKET) -> DataFrame:
    """(a, b) edges between distinct fingerprints (fp long) that connect what the links connect."""
    if most > 4:
        raise ValueError("the keys cover up to four differing bits")

    def keyed(batches):
        for batch in batches:
            p = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            keys, rows = bucket_keys(p)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(p[rows].view(np.int64))], ["key", "fp"])

    spark = prints.sparkSession
    keyed_rows = common.map_arrow(prints.select("fp"), keyed, "key long, fp long")
    heavy = keyed_rows.groupBy("key").count().where(F.col("count") > bucket).select("key", F.ceil(F.col("count") / bucket).cast("int").alias("n"))
    heavy = common.saved(heavy, "heavy")
    rows = keyed_rows.join(heavy, "key", "left") if not heavy.isEmpty() else keyed_rows.withColumn("n", F.lit(None).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    blocks = F.when(F.col("n").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.xxhash64(F.least(mine, j), F.greatest(mine, j))))
    tasks = rows.select(F.explode(blocks).alias("x"), "key", "fp").select(F.when(F.col("x") == 0, F.col("key")).otherwise(F.xxhash64("key", "x")).alias("g"), "fp")

    def compared(batches):
        g, f = np.empty(0, np.int64), np.empty(0, np.uint64)

        def edges(g, f):
            a, b = forest(g, f, most)
            low, high = np.minimum(a, b), np.maximum(a, b)
            pairs = np.unique(np.stack((low, high)), axis=1) if len(a) else np.empty((2, 0), np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0].view(np.int64)), pa.array(pairs[1].view(np.int64))], ["a", "b"])

        for batch in batches:
            g = np.concatenate((g, batch.column(0).to_numpy(zero_copy_only=False)))
            f = np.concatenate((f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            whole = int(np.searchsorted(g, g[-1])) if len(g) else 0  # the last run may go on
            yield edges(g[:whole], f[:whole])
            g, f = g[whole:], f[whole:]
        yield edges(g, f)

    common.ready(spark)
    return tasks.repartition(F.col("g")).sortWithinPartitions("g").mapInArrow(compared, "a long, b long")


def _components(rows: DataFrame, most: int) -> DataFrame:
    """(fp, c, component_id) of each distinct fingerprint of rows (doc_id, fp): c names its group, component_id is its smallest doc_id."""
    prints = common.saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    value = F.struct(F.col("least").isNull().alias("none"), "least", "fp")
    names = common.component_names(linked(prints, most), prints.select(F.col("fp").alias("node"), value.alias("value")))
    own = prints.join(names, prints["fp"] == names["node"], "left")
    return own.select("fp", F.coalesce("name.fp", "fp").alias("c"), F.when(F.col("node").isNotNull(), F.col("name.least")).otherwise(F.col("least")).alias("component_id"))


def near_duplicates(docs: DataFrame, most: int = MOST, words: int = WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id, fp): component_id is the smallest doc_id reachable by links."""
    rows = common.saved(fingerprints(docs, words), "fingerprints")  # each text is hashed once
    return rows.join(_components(rows, most), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "fp")


def deduplicated(docs: DataFrame, most: int = MOST, words: int = WORDS) -> DataFrame:
    """One document of each group with all its columns: that with the smallest doc_id, null last, then the smallest hash of its text.

    What goes is told by doc_id, so texts meet a table of the ids that go, and are shuffled only if that is large.
    Rows whose doc_id is null or repeated are told by doc_id and text; of rows equal in both, one stays.
    """
    rows = common.saved(fingerprints(docs, words), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "fp")
    grouped = common.saved(rows.join(_components(rows, most).select("fp", "c"), "fp"), "grouped")
    first = common.saved(grouped.groupBy("c").agg(F.min(place).alias("first")), "first")  # of known size, so a small one is broadcast past hot groups
    shared = common.saved(rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("s_id")), "shared")
    gone = grouped.where("doc_id is not null").join(shared, grouped["doc_id"] == shared["s_id"], "left_anti").join(first, "c").where(place != F.col("first"))
    gone = common.saved(gone.select(F.col("doc_id").alias("g_id")), "gone")
    odd = not shared.isEmpty()
    out = docs.where(docs["doc_id"].isNotNull()) if odd else docs
    out = out.join(gone, out["doc_id"].cast("long") == gone["g_id"], "left_anti")
    if not odd:
        return out
    out = out.join(shared, out["doc_id"].cast("long") == shared["s_id"], "left_anti")
    win = first.select(F.col("first.doc_id").alias("w_id"), F.col("first.th").alias("w_th"))
    wins = win.join(shared, win["w_id"].eqNullSafe(shared["s_id"]), "left_semi").distinct()
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    mine = docs.select(row, docs["doc_id"].cast("long").alias("w_id"), text_hash(docs["text"]).alias("w_th")).alias("m")
    mine = mine.join(wins.alias("w"), F.col("m.w_id").eqNullSafe(F.col("w.w_id")) & F.col("m.w_th").eqNullSafe(F.col("w.w_th")), "left_semi")
    return out.unionByName(mine.dropDuplicates(["w_id", "w_th"]).select("row.*"))
