"""Span search over window logits, token windows and labels, and word alignment; all inside the row.

A window is one row with its logit arrays and the offsets of its tokens, which are null but for context
tokens. Valid pairs are start <= end, at most max_answer_len tokens, both context tokens; they are
listed inside the row, so nothing is shuffled.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.functions import metrics as M
from spanforge.functions import text as X
from spanforge.runtime import ready


_BLANK = re.compile(r"\s*")


def candidates(starts: Column, ends: Column, offsets: Column, longest: int) -> Column:
    """array<struct<score, s, e>> of valid pairs; s and e are negative so that the largest struct is the earliest best.

    offsets: array<struct<s, e>>, null for tokens of the question, separators and padding.
    """
    n = F.least(F.size(starts), F.size(ends), F.size(offsets))
    context = lambda x: F.filter(x, lambda i: F.get(offsets, i).isNotNull())
    row = lambda i: F.transform(context(F.sequence(i, F.least(i + longest - 1, n - 1))), lambda j: F.struct((F.get(starts, i) + F.get(ends, j)).alias("score"), (-i).alias("s"), (-j).alias("e")))
    return F.when(n > 0, F.flatten(F.transform(context(F.sequence(F.lit(0), n - 1)), row))).otherwise(F.array().cast("array<struct<score: double, s: int, e: int>>"))


def scored(windows: DataFrame, longest: int = 12, top: int = 3, cls_index: int = 0) -> DataFrame:
    """Adds null_score (the CLS pair), best, delta (null - best), top spans and probabilities.

    Windows have starts, ends and offsets. spans holds top + 1 spans of distinct characters, out of the
    4 * top + 4 best pairs. The probability is a softmax over all valid pairs and null, with the maximum
    taken out first. Without a CLS token there is no null score and no delta; without context tokens
    there is no span, score nor delta, and spans is empty.
    """
    null = F.get("starts", F.lit(cls_index)) + F.get("ends", F.lit(cls_index))
    place = lambda x: F.struct(F.get("offsets", -x["s"])["s"].alias("a"), F.get("offsets", -x["e"])["e"].alias("b"))

    def chosen(c: Column) -> Column:
        def with_best(best: Column) -> Column:
            high = F.greatest(best["score"], null)
            heap = F.slice(F.sort_array(c, asc=False), 1, 4 * top + 4)
            kept = X.bound(heap, lambda h: F.filter(h, lambda x, k: ~F.exists(F.slice(h, F.lit(1), k), lambda y: place(x) == place(y))))
            mass = F.struct(high.alias("high"), F.aggregate(c, F.coalesce(F.exp(null - high), F.lit(0.0)), lambda a, x: a + F.exp(x["score"] - high)).alias("total"))
            spans = X.bound(mass, lambda m: F.transform(F.slice(kept, 1, top + 1), lambda x: F.struct((-x["s"]).alias("s"), (-x["e"]).alias("e"), place(x)["a"].alias("start_char"), place(x)["b"].alias("end_char"), x["score"].alias("score"), (F.exp(x["score"] - m["high"]) / m["total"]).alias("prob"))))
            return F.struct(null.alias("null_score"), (null - best["score"]).alias("delta"), (-best["s"]).alias("s"), (-best["e"]).alias("e"), best["score"].alias("score"), spans.alias("spans"))

        return X.bound(F.array_max(c), with_best)

    return windows.withColumn("x", X.bound(candidates(F.col("starts"), F.col("ends"), F.col("offsets"), longest), chosen)).select("*", "x.*").drop("x")


def endpoint_softmax(windows: DataFrame) -> DataFrame:
    """Softmax over context tokens of the start and end logits, at the chosen span of each window."""

    def at(x: str, k: str) -> Column:
        part = F.filter(F.col(x), lambda v, i: F.get("offsets", i).isNotNull())
        return X.bound(part, lambda p: X.bound(F.array_max(p), lambda m: F.exp(F.get(F.col(x), F.col(k)) - m) / F.aggregate(p, F.lit(0.0), lambda a, v: a + F.exp(v - m))))

    return windows.withColumns({"start_prob": at("starts", "s"), "end_prob": at("ends", "e")})


def abstains(delta: Column, tau: Column | float) -> Column:
    """A window abstains if null + tau is at least the best score; without a null score it never does."""
    return F.coalesce(delta + tau >= 0, F.lit(False))


def decided(windows: DataFrame, tau: Column | float = 0.0, by: list[str] = ["qid"]) -> DataFrame:  # noqa: B006
    """(by..., window_ix, score, answered, evidence_ix): the answering window with the best score, the first on
    ties, else none; evidence is the window with the least delta, the first on ties."""
    known = F.col("score").isNotNull()  # a window without context neither answers nor is evidence
    answers = known & ~abstains(F.col("delta"), tau)
    best = F.max(F.when(answers, F.struct(F.col("score"), (-F.col("window_ix")).alias("w"))))
    least = F.min(F.when(known, F.struct(F.coalesce("delta", F.lit(float("-inf"))).alias("d"), F.col("window_ix").alias("w"))))
    out = windows.groupBy(*by).agg(best.alias("b"), least.alias("l"))
    return out.select(*by, (-F.col("b.w")).alias("window_ix"), F.col("b.score").alias("score"), F.col("b").isNotNull().alias("answered"), F.col("l.w").alias("evidence_ix"))


def legacy_spans(windows: DataFrame, top: int = 20, longest: int = 12, first: int = 8, threshold: float = 0.0) -> DataFrame:
    """The older search: the best pair out of the `top` starts and `top` ends, null the least over a question's windows."""
    def tops(x: str) -> Column:
        ranked = F.sort_array(F.transform(F.slice(x, first + 1, F.size(x)), lambda v, k: F.struct(v.alias("v"), (-(k + first)).alias("k"))), asc=False)
        return F.slice(ranked, 1, top)

    pairs = F.flatten(F.transform("ts", lambda a: F.transform(F.filter("te", lambda b: (b["k"] <= a["k"]) & (a["k"] - b["k"] < longest)), lambda b: F.struct((a["v"] + b["v"]).alias("score"), a["k"].alias("s"), b["k"].alias("e")))))
    w = windows.withColumns({"ts": tops("starts"), "te": tops("ends")}).withColumn("best", F.array_max(pairs))
    w = w.withColumn("null_score", F.get("starts", F.lit(0)) + F.get("ends", F.lit(0)))
    q = w.groupBy("qid").agg(F.max(F.struct(F.col("best.score"), (-F.col("window_ix")).alias("w"), F.col("best.s"), F.col("best.e"))).alias("b"), F.min("null_score").alias("null_score"))
    return q.select("qid", (-F.col("b.w")).alias("window_ix"), (-F.col("b.s")).alias("s"), (-F.col("b.e")).alias("e"), F.col("b.score").alias("score"), "null_score", (F.col("null_score") - F.col("b.score") > threshold).alias("abstains"))


def words_of(context: Column) -> Column:
    """array<struct<tok, s, e>>: white-space separated pieces with their places."""
    pieces = F.regexp_extract_all(context, F.lit(r"(?U)(\S+|\s+)"))
    placed = X.bound(pieces, lambda p: X.bound(X.offsets(F.transform(p, F.length)), lambda at: F.transform(p, lambda w, k: F.struct(w.alias("tok"), F.get(at, k).alias("s")))))
    return F.transform(F.filter(placed, lambda w: ~w["tok"].rlike(r"(?U)^\s")), lambda w: F.struct(w["tok"].alias("tok"), w["s"].alias("s"), (w["s"] + F.length(w["tok"])).alias("e")))


def joined_words(words: Column) -> Column:
    """Words joined in pairs by _, a stand-in for a segmenter's compounds."""
    def pairs(x: Column) -> Column:
        even = F.filter(F.transform(x, lambda w, k: F.struct(k.alias("k"), w.alias("w"), F.get(x, k + 1).alias("n"))), lambda y: y["k"] % 2 == 0)
        return F.transform(even, lambda y: F.struct(F.concat_ws("_", y["w"]["tok"], y["n"]["tok"]).alias("tok"), y["w"]["s"].alias("s"), F.coalesce(y["n"]["e"], y["w"]["e"]).alias("e")))

    return X.bound(words, pairs)


def windows_over(n: Column, budget: int, stride: int) -> Column:
    """array<int> of window starts over n tokens: steps of budget - stride, until a window reaches the end; none for n = 0."""
    if budget < 1:
        raise ValueError("no room for context tokens")
    step = max(1, budget - stride)
    count = 1 + F.greatest(F.lit(0), F.ceil((n - budget) / step))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda k: k * step)).otherwise(F.array().cast("array<int>"))


def token_windows(rows: DataFrame, budget: int, stride: int) -> DataFrame:
    """One row per window of rows with words: window_ix, first token, number of tokens, characters s to e."""
    w = rows.select("*", F.posexplode(windows_over(F.size("words"), budget, stride)).alias("window_ix", "first"))
    w = w.withColumn("n_tokens", F.least(F.lit(budget), F.size("words") - F.col("first")))
    return w.withColumns({"s": F.get("words", F.col("first"))["s"], "e": F.get("words", F.col("first") + F.col("n_tokens") - 1)["e"]})


def labelled(windows: DataFrame, start: Column, end: Column) -> DataFrame:
    """Adds first and last token of the answer in each window; 0, 0 (CLS) where it isn't fully inside."""
    inside = (start >= F.col("s")) & (end <= F.col("e")) & (end > start)
    hit = F.filter(F.transform(F.slice("words", F.col("first") + 1, F.col("n_tokens")), lambda w, k: F.struct(k.alias("k"), w["s"].alias("s"), w["e"].alias("e"))), lambda w: (w["s"] < end) & (w["e"] > start))
    w = windows.withColumn("hit", F.when(inside, hit))
    return w.withColumns({"label_start": F.coalesce(F.get("hit", F.lit(0))["k"] + 1, F.lit(0)), "label_end": F.coalesce(F.try_element_at("hit", F.lit(-1))["k"] + 1, F.lit(0))}).drop("hit")


def feature_scan(features: DataFrame, budget: int) -> DataFrame:
    """Counts of broken features: lengths, label order, labels out of range, text that a label doesn't hold, and CLS labels."""
    cls = (F.col("label_start") == 0) & (F.col("label_end") == 0)
    text = F.substring("context", F.get("words", F.col("first") + F.col("label_start") - 1)["s"] + 1, F.get("words", F.col("first") + F.col("label_end") - 1)["e"] - F.get("words", F.col("first") + F.col("label_start") - 1)["s"])
    return features.agg(
        F.count(F.lit(1)).alias("n_features"), F.count_if(F.col("n_tokens") > budget).alias("n_too_long"), F.count_if(F.col("n_tokens") < 1).alias("n_empty"),
        F.count_if(F.col("label_end") < F.col("label_start")).alias("n_inverted"), F.count_if((F.col("label_start") > F.col("n_tokens")) | (F.col("label_end") > F.col("n_tokens"))).alias("n_outside"),
        F.count_if(~cls & (F.instr(text, F.col("answer")) == 0)).alias("n_mismatch"), F.count_if(cls).alias("n_cls"), F.round(F.avg(cls.cast("double")), 6).alias("cls_share"))


def boundary_alignment(rows: DataFrame) -> DataFrame:
    """Per row with context, words and answers (array<struct<text, s>>, located): aligned, cuts, oracle span and EM.

    aligned: some answer starts and ends at word boundaries. The oracle is the smallest span of whole
    words around an answer, and the best over answers. Without located answers all is null.
    """
    cuts = lambda at: F.exists("words", lambda w: (w["s"] < at) & (at < w["e"]))
    end = lambda a: a["s"] + F.length(a["text"])
    over = lambda a: F.filter("words", lambda w: (w["s"] < end(a)) & (w["e"] > a["s"]))
    span = lambda a: F.struct(F.array_min(F.transform(over(a), lambda w: w["s"])).alias("s"), F.array_max(F.transform(over(a), lambda w: w["e"])).alias("e"))
    whole = lambda a: X.bound(span(a), lambda p: F.struct(M.exact_match(F.coalesce(F.substring("context", p["s"] + 1, p["e"] - p["s"]), F.lit("")), a["text"]).alias("em"), p["s"].alias("s"), p["e"].alias("e")))
    some = F.size("answers") > 0
    first = F.get("answers", F.lit(0))
    out = rows.withColumns({
        "aligned": F.when(some, F.exists("answers", lambda a: ~cuts(a["s"]) & ~cuts(end(a)))),
        "start_cut": F.when(some, cuts(first["s"])), "end_cut": F.when(some, cuts(end(first))),
        "oracle": F.when(some, F.array_max(F.transform("answers", lambda a, k: X.bound(whole(a), lambda w: F.struct(w["em"].alias("em"), (-k).alias("k"), w["s"].alias("s"), w["e"].alias("e")))))),
    })
    return out.withColumns({"oracle_em": F.col("oracle.em"), "oracle_s": F.col("oracle.s"), "oracle_e": F.col("oracle.e")}).drop("oracle")


def alignment_summary(aligned: DataFrame) -> DataFrame:
    known = F.col("aligned").isNotNull()
    mis = known & ~F.col("aligned")
    return aligned.agg(
        F.count_if(known).alias("n_located"), F.count_if(F.col("aligned")).alias("n_aligned"), F.round(F.try_divide(100.0 * F.count_if(mis), F.count_if(known)), 2).alias("misaligned_pct"),
        F.count_if(F.col("start_cut")).alias("n_start_cut"), F.count_if(F.col("end_cut")).alias("n_end_cut"),
        F.round(100 * F.avg("oracle_em"), 4).alias("oracle_em"), F.round(100 * F.avg(F.when(mis, F.col("oracle_em"))), 4).alias("oracle_em_misaligned"))


def char_coverage(context: Column, words: Column) -> Column:
    """Share of the characters that aren't white space which lie in words; 1 for a blank context.

    The context is cut into characters once: a substring for each word would scan the text up to that word.
    """
    solid = lambda x: F.length(F.regexp_replace(x, r"(?U)\s+", ""))
    text = lambda chars, w: F.array_join(F.slice(chars, F.greatest(w["s"], F.lit(0)) + 1, F.greatest(w["e"] - w["s"], F.lit(0))), "")
    inside = X.bound(F.split(context, ""), lambda chars: F.aggregate(words, F.lit(0), lambda a, w: a + solid(text(chars, w))))
    return F.when(solid(context) == 0, F.lit(1.0)).otherwise(inside / solid(context))


#: Characters after the cursor in which a piece is looked for.
AHEAD = 50


def place_pieces(context: str, pieces: list[str]) -> list[tuple[str, int, int]]:
    """(piece, start, end) of a segmenter's pieces in the text they were made from, in order.

    A piece with _ may stand for a compound of several parts or for the text itself; parts that are
    not found near the cursor are passed over, and so is a piece without any part.
    """
    out, cursor = [], 0
    solid = lambda at: _BLANK.match(context, at).end()
    for piece in pieces:
        parts = [piece] if context.startswith(piece, solid(cursor)) else piece.split("_")
        ends = []
        for part in filter(None, parts):
            at = solid(cursor)
            hit = context.find(part, at, at + AHEAD + len(part))
            if hit >= 0:
                cursor = hit + len(part)
                ends += [hit, cursor]
        if ends:
            out.append((piece, ends[0], ends[-1]))
    return out


def segment_offsets(rows: DataFrame, pieces: str = "pieces") -> DataFrame:
    """Adds words: the places of a segmenter's pieces in the context. The cursor is state, so Arrow batches go through Python."""
    names = rows.columns
    c, p = names.index("context"), names.index(pieces)

    def placed(batches):
        for batch in batches:
            words = [[{"tok": t, "s": a, "e": e} for t, a, e in place_pieces(x or "", y or [])] for x, y in zip(batch.column(c).to_pylist(), batch.column(p).to_pylist(), strict=True)]
            kind = pa.list_(pa.struct([("tok", pa.string()), ("s", pa.int32()), ("e", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, kind)], [*names, "words"])

    word = T.StructType([T.StructField("tok", T.StringType()), T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())])
    ready(rows.sparkSession)
    return rows.mapInArrow(placed, T.StructType([*rows.schema.fields, T.StructField("words", T.ArrayType(word))]))


def encode_pairs(rows: DataFrame, ids_of, max_length: int = 256, pad: int = 1, begin: int = 0, end: int = 2) -> DataFrame:
    """(qid, input_ids, attention_mask, offsets) of question and words: <s> A </s> </s> B </s>, B cut to what fits, padded.

    ids_of(token) gives a word's ids; all of a word's ids share its place. Offsets are null but for
    context tokens. A worker keeps the ids of the words it has seen.
    """
    from functools import lru_cache

    def encoded(batches):
        ids = lru_cache(200_000)(lambda t: tuple(ids_of(t)))
        for batch in batches:
            out = []
            for qid, question, words in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                a = [i for t in (question or "").split() for i in ids(t)]
                b = [(i, (w["s"], w["e"])) for w in words or [] for i in ids(w["tok"])][: max(0, max_length - len(a) - 4)]
                x = [begin, *a, end, end, *[i for i, _ in b], end]
                places = [None] * (len(a) + 3) + [{"s": s, "e": e} for _, (s, e) in b] + [None]
                fill = max_length - len(x)
                out.append((qid, x + [pad] * fill, [1] * len(x) + [0] * fill, places + [None] * fill))
            span = pa.struct([("s", pa.int32()), ("e", pa.int32())])
            kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int8()), pa.list_(span)]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)], ["qid", "input_ids", "attention_mask", "offsets"])

    table = rows.select(F.col("qid").cast("string").alias("qid"), "question", "words")
    ready(rows.sparkSession)
    return table.mapInArrow(encoded, "qid string, input_ids array<int>, attention_mask array<tinyint>, offsets array<struct<s: int, e: int>>")


def timed_predictions(rows: DataFrame, predict) -> DataFrame:
    """(qid, prediction, seconds): a Python predictor (question, context) -> answer, timed per question."""
    from time import perf_counter

    def run(batches):
        for batch in batches:
            out = []
            for qid, question, context in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                began = perf_counter()
                out.append((qid, predict(question, context), perf_counter() - began))
            columns = list(zip(*out, strict=True)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, [pa.string(), pa.string(), pa.float64()], strict=True)], ["qid", "prediction", "seconds"])

    return rows.select(F.col("qid").cast("string"), "question", "context").mapInArrow(run, "qid string, prediction string, seconds double")


def windows_per_question(windows: DataFrame) -> DataFrame:
    """Histogram of windows per question, capped at 4+."""
    per = windows.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(F.least("n", F.lit(4)).alias("windows")).agg(F.count(F.lit(1)).alias("questions"))
