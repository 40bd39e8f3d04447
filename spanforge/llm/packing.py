"""Operator 10: packs documents into sequences of a fixed length by the sum-of-squares rule.

Each document is encoded once, an end id is added, and only a document longer than a sequence is
cut, into full pieces and a last shorter one. The pieces (not their ids) are dealt by a hash of their
rows into groups of bounded size, equal pieces apart from each other; each group packs by the
sum-of-squares rule: a piece goes where the sum over gaps of (number of open bins with that gap)
squared grows least. The longer quarter goes in random order, as the rule wants, the shorter pieces
then fall in size, and open a bin only where none has room.

Edge cases: a null text is an empty document of the end id alone; repeated rows are packed each;
an empty table gives no rows; a very long text becomes many pieces, which are dealt apart. A null
doc_id stays null. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm import common, tokens

#: Pieces that one group holds on average; a group's open bins at its end are the only loss.
GROUP = 65_536
#: Share of the pieces, the shorter ones, that come last and in the order of their length.
SHORT = 0.75
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


def pieces(docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32; with_ids adds the ids (uint32, little-endian)."""
    path = tokenizer or tokens.default_path()

    def cut(batches):
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for first, flat, sizes in tokens.encoded(batch.column(1), path):
                rows, at = [], 0
                for k, n in enumerate(sizes.tolist()):
                    whole = np.append(flat[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    for p, s in enumerate(range(0, n + 1, capacity)):
                        part = whole[s : s + capacity]
                        rows.append((ids_of[first + k], p, s, len(part), tokens.crc32(part), part.tobytes() if with_ids else None))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 6
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                keep = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:keep], kinds, strict=False)], names[:keep])

    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.map_arrow(table, cut, PIECES + (", ids binary" if with_ids else ""))


def sum_of_squares(lengths: np.ndarray, capacity: int, fill_from: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, taken in the given order; lengths are 1 to capacity.

    N[g] is the number of open bins with gap g. Moving a bin from gap g to g - s changes the sum
    of squares by 2 (N[g - s] - N[g] + 1), without the first part if it fills up; a new bin has
    the change 2 N[capacity - s] + 1. Ties go to the smallest gap, a new bin last. From the piece
    `fill_from` on, a bin is opened only where no open one has room.
    """
    lengths = np.asarray(lengths, np.int64)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    count = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    opened = 0
    full_up = len(lengths) if fill_from is None else fill_from
    never = np.iinfo(np.int64).max
    for k, s in enumerate(lengths.tolist()):
        if s == capacity:
            bins[k], offsets[k] = opened, 0
            opened += 1
            continue
        here, there = count[s:capacity], count[: capacity - s]
        change = 2 * (there - here + 1)
        change[0] = 1 - 2 * here[0]  # a full bin is open no more
        change[here == 0] = never
        j = int(change.argmin()) if len(change) else 0
        if len(change) and here[j] and (k >= full_up or change[j] <= 2 * count[capacity - s] + 1):
            g = s + j
            b = stacks[g].pop()
            count[g] -= 1
        else:
            g, b = capacity, opened
            opened += 1
        bins[k], offsets[k] = b, capacity - g
        if g > s:
            count[g - s] += 1
            stacks[g - s].append(b)
    return bins, offsets


def place(table: DataFrame, capacity: int = 4096, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces; every task holds a bounded group."""
    # the pieces cost an encoding of all texts, so they are written once
    table = common.saved(table, "pieces")
    groups = max(1, -(-table.count() // group))
    # the number of the row keeps equal pieces apart; the written table gives it again if a task is run again
    dealt = table.withColumn("h", F.xxhash64("doc_id", "piece", "ids_crc32", "length", F.monotonically_increasing_id())).withColumn("g", F.pmod("h", F.lit(groups)))

    def packed(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        lengths = t.column("length").to_numpy()
        order = np.lexsort((lengths, t.column("h").to_numpy()))
        short = np.zeros(len(order), bool)
        short[np.argsort(lengths[order], kind="stable")[: int(len(order) * SHORT)]] = True
        late = order[short]
        t = t.take(np.concatenate((order[~short], late[np.argsort(-lengths[late], kind="stable")])))
        bins, offsets = sum_of_squares(t.column("length").to_numpy(), capacity, int((~short).sum()))
        first = key[0].as_py() << 32
        return t.drop_columns(["h", "g"]).append_column("sequence_id", pa.array(first + bins)).append_column("offset", pa.array(offsets))

    common.ready(table.sparkSession)
    return dealt.groupBy("g").applyInArrow(packed, PLACED)


def pack(docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """Places every piece of every document: PLACED columns."""
    return place(pieces(docs, capacity, end_id, tokenizer), capacity)


def sequences(docs: DataFrame, placed: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """The packed sequences themselves: (sequence_id, n_tokens, ids binary), ids in the order of their offsets.

    Pieces meet their places by document, piece and checksum; of equal rows, one is as good as another.
    """
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    made = pieces(docs, capacity, end_id, tokenizer, with_ids=True).groupBy(*keys).agg(F.first("ids").alias("ids"))
    match = [placed[k].eqNullSafe(made[k]) for k in keys]
    rows = placed.join(made, match).select("sequence_id", placed["offset"], placed["length"], "ids")
    return rows.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("x")).select("sequence_id", "n_tokens", F.expr("aggregate(x, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"))
