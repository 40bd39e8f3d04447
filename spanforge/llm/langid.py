"""Operator 5: language identification by multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of each labelled text in hashed buckets, per language, inside the
Python workers; what is shuffled and collected is bounded by languages times buckets. The matrix
of log-probabilities is broadcast. Texts are scored in batches: the buckets of many texts in one array,
a language's row gathered at them, and the parts of each text summed by np.add.reduceat.

Edge cases: a null text or one without a letter is `und` with score 0; without any labelled row
every text is `und` with score 0; a text too short for an n-gram is scored by the priors; of languages
with equal scores the first in code-point order is taken; repeated
rows count and are scored each; texts are read whole, in slices that overlap; a null doc_id has
no remainder and is held out. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm import common

ORDERS, BUCKETS, SMOOTHING, SLICE = (1, 2, 3), 1 << 15, 0.5, 1 << 20
#: Languages that a model may have; the matrix stays under 256 MB.
MOST_LANGUAGES = 1000


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's digits leaves 2 modulo 4; true for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def buckets(text: str, orders: tuple[int, ...] = ORDERS, n: int = BUCKETS):
    """Arrays of the n-gram buckets of a lower-cased text, slice by slice."""
    mask, longest = np.uint32(n - 1), max(orders)
    for at in range(0, max(len(text), 1), SLICE):
        part = text[max(0, at - longest + 1) : at + SLICE].lower() if at else text[:SLICE].lower()
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        for k in orders:
            m = len(c) - k + 1
            begin = longest - k if at else 0  # what the slice before has counted
            if m - begin <= 0:
                continue
            h = np.full(m - begin, np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF))
            for j in range(k):
                h = (h ^ c[begin + j : m + j]) * np.uint32(0x85EBCA6B)
            yield ((h ^ (h >> np.uint32(15))) & mask).astype(np.intp)


def train(labelled: DataFrame, orders: tuple[int, ...] = ORDERS, n: int = BUCKETS, smoothing: float = SMOOTHING) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages in code-point order, log-priors, log-probability matrix buckets x languages) from (text, lang)."""

    def counted(batches):
        total: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in total:
                    total[lang] = np.zeros(n, np.int64)
                docs[lang] = docs.get(lang, 0) + 1
                for b in buckets(text, orders, n):
                    total[lang] += np.bincount(b, minlength=n) if len(b) > n // 8 else 0
                    if len(b) <= n // 8:
                        np.add.at(total[lang], b, 1)
        for lang, row in total.items():
            at = np.flatnonzero(row)
            columns = [pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(row[at], docs[lang]), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "n"])

    known = labelled.where("lang is not null and text is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sums = common.map_arrow(known, counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = sums.toPandas()
    langs = sorted(rows["lang"].unique().tolist())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"{len(langs)} languages; a model holds {MOST_LANGUAGES} at most")
    where = {x: k for k, x in enumerate(langs)}
    counts, docs = np.zeros((n, len(langs))), np.zeros(len(langs))
    for lang, part in rows.groupby("lang"):
        b, v = part["bucket"].to_numpy(), part["n"].to_numpy()
        docs[where[lang]] = v[b < 0].sum()
        counts[b[b >= 0], where[lang]] = v[b >= 0]
    matrix = np.log(counts + smoothing) - np.log(counts.sum(0) + smoothing * n) if langs else counts
    prior = np.log(docs / docs.sum()) if langs else docs
    return langs, prior, matrix.astype(np.float32)


def _add(total: np.ndarray, rows: np.ndarray, held: list[np.ndarray], owner: list[int]) -> None:
    """Adds to total[owner] the log-probabilities of the buckets held, for all languages; texts may own several parts."""
    if not held:
        return
    flat = np.concatenate(held)
    starts = np.concatenate(([0], np.cumsum([len(b) for b in held])[:-1]))
    for lang, row in enumerate(rows):
        np.add.at(total[:, lang], owner, np.add.reduceat(row.take(flat), starts, dtype=np.float64))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """(doc_id, lang_pred, score): the likeliest language and its posterior probability."""
    langs, prior, matrix = model
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(matrix.T))  # languages x buckets; bounded, see train

    def scored(batches):
        rows = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            known = [k for k, t in enumerate(texts) if langs and t is not None and any(map(str.isalpha, t))]
            total = np.tile(prior, (len(texts), 1)) if langs else np.zeros((len(texts), 1))
            held, owner, n = [], [], 0
            for k in known:
                for b in buckets(texts[k], orders, rows.shape[1]):
                    held.append(b)
                    owner.append(k)
                    n += len(b)
                    if n >= SLICE:
                        _add(total, rows, held, owner)
                        held, owner, n = [], [], 0
            _add(total, rows, held, owner)
            top = total.argmax(1)
            share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            best, score = ["und"] * len(texts), np.zeros(len(texts))
            for k in known:
                best[k], score[k] = langs[top[k]], share[k]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.map_arrow(table, scored, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the rows that are not held out and predicts all: (doc_id, held_out, lang_pred, score)."""
    model = train(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
