"""Operator 12: what each of several filters removes in every order in which they can run.

A document is one set of failed filters, a number below 2 ** 5. One pass over the texts finds it, but for
the filter that looks for copies, which compares digests of the texts across the table. A table with a
row per set and a column per order, computed once, holds the step at which such a document goes; counts by
part, order, step and label are then one look-up and one np.bincount per batch. A task emits its
arrays, one row per part and order, and these are summed. Everything else follows from the sums: what
an order's first step removes is all that fails its filter, and what its last step removes fails that
filter alone.

Edge cases: a null text is empty, and equal to an empty one; a null lang is the part ''; a null doc_id is
larger than all others, so such a row fails filter E where its text also has an id, and null ids don't
fail one another, nor do rows that share the smallest id; labels of one id are joined by "any"; null
labels are neither good nor toxic; an empty table gives no rows. Parts with no document have none. Only
doc_id, text and lang are read, and doc_id, quality and toxic of the labels.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.llm import common

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = range(1, len(FILTERS) + 1)
#: FIRST[set of failed filters, order]: the step, from 0, at which such a document goes; after the last one if it stays.
FIRST = np.array([[next((s for s, f in enumerate(o) if bits >> FILTERS.index(f) & 1), len(FILTERS)) for o in ORDERS] for bits in range(1 << len(FILTERS))])
#: Least words; least percentage of distinct words; largest percentage of capitals; marks that fail.
WORDS, DISTINCT, CAPITALS, MARKS = 200, 50, 3, b"#$%&*|"
#: Rows that are looked up at once, and parts whose counts a task holds before it emits them.
ROWS, PARTS = 1024, 512
_CAPITAL, _INNER = bytes(range(65, 91)), bytes(range(128, 192))


def failures(text: bytes) -> int:
    """The set of the filters A to D that a UTF-8 text fails, A in the lowest bit; bytes.split cuts at ASCII white space."""
    words = text.split()
    points = len(text) - (0 if text.isascii() else len(text) - len(text.translate(None, _INNER)))
    capitals = len(text) - len(text.translate(None, _CAPITAL))
    marked = any(m in text for m in MARKS)
    return (len(words) < WORDS) | (100 * len(set(words)) < DISTINCT * len(words)) << 1 | (100 * capitals > CAPITALS * points) << 2 | marked << 3


def examined(docs: DataFrame) -> DataFrame:
    """(doc_id, part, failed int, digest binary): the texts stay behind."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            failed, digests = [], []
            for k in range(len(texts)):
                text = texts[k].as_py() or b""
                failed.append(failures(text))
                digests.append(hashlib.sha256(text).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(failed, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "failed", "digest"])

    table = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return common.map_arrow(table, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part string, failed int, digest binary")


def with_copies(rows: DataFrame) -> DataFrame:
    """Adds filter E: the text has a smaller id elsewhere. Digests that occur once join nothing; hot ones are dealt out."""
    rows = common.saved(rows, "examined")
    groups = common.saved(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1"), "copies")
    out = common.join_unique(rows, groups, "digest", rows.count(), "left")
    later = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    return out.select("doc_id", "part", F.col("failed").bitwiseOR(F.when(later, F.lit(1 << 4)).otherwise(F.lit(0))).alias("failed"))


def removals(rows: DataFrame) -> DataFrame:
    """(part, filter_order, left, r0 .. r4, g0 .. g4, t0 .. t4) of (part, failed, label): documents left, and removed ones, good and toxic ones by step.

    label: 1 if good, plus 2 if toxic.
    """
    steps, orders = len(FILTERS) + 1, len(ORDERS)
    names = [f"{x}{s}" for x in "rgt" for s in range(len(FILTERS))]
    at = np.arange(orders) * steps + FIRST  # place of (order, step) for each set

    def emitted(held):
        part = [p for p in held for _ in ORDERS]
        by_label = np.stack(list(held.values())).reshape(len(held), 4, orders, steps) if held else np.zeros((0, 4, orders, steps), np.int64)
        sums = {"r": by_label.sum(1), "g": by_label[:, [1, 3]].sum(1), "t": by_label[:, [2, 3]].sum(1)}
        columns = [pa.array(sums["r"][:, :, -1].ravel(), pa.int64())] + [pa.array(sums[n[0]][:, :, int(n[1])].ravel(), pa.int64()) for n in names]
        return pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(ORDERS * len(held), pa.string()), *columns], ["part", "filter_order", "left", *names])

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                b = batch.slice(k, ROWS)
                found = b.column(0).dictionary_encode()
                code = found.indices.to_numpy().astype(np.int64) * 4 + b.column(2).to_numpy()
                index = code[:, None] * (orders * steps) + at[b.column(1).to_numpy()]
                counts = np.bincount(index.ravel(), minlength=len(found.dictionary) * 4 * orders * steps).reshape(len(found.dictionary), -1)
                for part, n in zip(found.dictionary.to_pylist(), counts, strict=True):
                    held[part] = held[part] + n if part in held else n
                if len(held) > PARTS:
                    yield emitted(held)
                    held = {}
        yield emitted(held)

    partial = common.map_arrow(rows.select("part", "failed", "label"), run, "part string, filter_order string, left long, " + ", ".join(f"{n} long" for n in names))
    return partial.groupBy("part", "filter_order").agg(*[F.sum(n).alias(n) for n in ("left", *names)])


def report(removed: DataFrame) -> DataFrame:
    """One row per part, order and step, out of the summed arrays."""
    step = lambda s: F.struct(F.lit(s).alias("step"), F.substring("filter_order", s, 1).alias("filter"), (F.col("left") + sum((F.col(f"r{k}") for k in range(s, len(FILTERS))), F.lit(0))).alias("kept"), *[F.col(f"{x}{s - 1}").alias(n) for x, n in (("r", "removed"), ("g", "good_lost"), ("t", "toxic_lost"))])
    rows = removed.select("part", "filter_order", F.inline(F.array(*map(step, STEPS))))
    of = Window.partitionBy("part", "filter")  # 600 rows
    failing = F.max(F.when(F.col("step") == 1, F.col("removed"))).over(of)
    alone = F.max(F.when(F.col("step") == len(FILTERS), F.col("removed"))).over(of)
    return rows.select("part", "filter_order", "step", "kept", "removed", (failing - F.col("removed")).alias("redundant"), alone.alias("unique_fails"), "good_lost", "toxic_lost", F.sum("removed").over(of).alias("shapley"), "filter")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The report of all documents; labels: (doc_id, quality, toxic)."""
    flag = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg((flag("quality") + 2 * flag("toxic")).alias("label"))
    rows = with_copies(examined(docs)).join(known, "doc_id", "left")
    return report(removals(rows.select("part", "failed", F.coalesce("label", F.lit(0)).alias("label"))))
