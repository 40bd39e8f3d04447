"""Model inputs for pairs of question and context: overflowing windows as rows, their labels, and a scan of them.

A context is cut into windows of as many tokens as a question leaves free; neighbours share `stride`
tokens. A window is one row: <cls> question <sep>.. context part <sep>, padded, with a mask, absolute
character offsets of context tokens (null elsewhere) and sequence ids (0 question, 1 context, null
elsewhere). All of it is array expressions inside the row. A tokenizer comes in as `tokenized`'s callable, or
as id and offset columns that exist already.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.functions import text as X
from spanforge.runtime import ready

TOKEN = "array<struct<id: int, s: int, e: int>>"
_TOKENS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("id", "s", "e")]))
_ARROW = pa.list_(pa.struct([(n, pa.int32()) for n in ("id", "s", "e")]))


@dataclass(frozen=True)
class Layout:
    """How a pair is laid out: its length, the overlap of windows, special ids, and separators between the two parts."""

    max_length: int = 384
    stride: int = 128
    cls: int = 0
    sep: int = 2
    pad: int = 1
    between: int = 1

    @property
    def special(self) -> int:
        return 2 + self.between


def _encoded(rows: DataFrame, texts: dict[str, str], encode) -> DataFrame:
    """Adds a token column for each text column: {name: text}. encode(text) gives ids and (s, e) offsets; null is an empty text."""
    names, at = rows.columns, {n: rows.columns.index(c) for n, c in texts.items()}

    def run(batches):
        for batch in batches:
            made = [pa.array([[{"id": i, "s": s, "e": e} for i, (s, e) in zip(*encode(x or ""), strict=True)] for x in batch.column(k).to_pylist()], _ARROW) for k in at.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*names, *at])

    ready(rows.sparkSession)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *(T.StructField(n, _TOKENS) for n in texts)]))


def tokenized(rows: DataFrame, encode) -> DataFrame:
    """Adds question_ids and tokens (id, s, e) of the columns question and context, by a Python tokenizer in Arrow batches."""
    out = _encoded(rows, {"question_tokens": "question", "tokens": "context"}, encode)
    return out.withColumn("question_ids", F.transform("question_tokens", lambda t: t["id"])).drop("question_tokens")


def _starts(n: Column, budget: Column, stride: int) -> Column:
    """First tokens of the windows over n tokens: steps of budget - stride, at least 1, until a window reaches the end."""
    step = F.greatest(F.lit(1), budget - stride)
    last = F.greatest(F.lit(0), F.ceil((n - budget) / step)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda k: (k * step).cast("int"))).otherwise(F.array().cast("array<int>"))


def windows(rows: DataFrame, layout: Layout = Layout(), encode=None) -> DataFrame:  # noqa: B008
    """One row per window of rows with question_ids, tokens and context; other columns but tokens stay.

    Adds window_ix, first (token), char_start, char_end, input_ids, attention_mask, offsets, sequence_ids and
    cls_index. With `encode` a window's characters are tokenized anew, as a tokenizer does that is
    given the text of the part alone, and cut to what fits. A blank context has no windows; a question that leaves
    no room for one context token is an error.
    """
    budget = F.lit(layout.max_length - layout.special) - F.size(F.coalesce("question_ids", F.array().cast("array<int>")))
    n = F.when(F.trim(F.regexp_replace(F.coalesce("context", F.lit("")), X.SPACE, " ")) == "", F.lit(0)).otherwise(F.size(F.coalesce("tokens", F.array().cast(TOKEN))))
    room = F.when((n > 0) & (budget < 1), F.raise_error(F.lit("a question leaves no room for context tokens"))).otherwise(budget).cast("int")
    w = rows.withColumn("__room", room).select("*", F.posexplode(_starts(n, F.col("__room"), layout.stride)).alias("window_ix", "first"))
    w = w.withColumn("__part", F.slice("tokens", F.col("first") + 1, F.col("__room"))).drop("tokens")
    w = w.withColumns({"char_start": F.get("__part", F.lit(0))["s"], "char_end": F.element_at("__part", -1)["e"]})
    if encode is not None:
        w = _encoded(w.withColumn("__chunk", F.substring("context", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))), {"__new": "__chunk"}, encode)
        w = w.withColumn("__part", F.transform(F.slice("__new", F.lit(1), F.col("__room")), lambda t: F.struct(t["id"].alias("id"), (t["s"] + F.col("char_start")).alias("s"), (t["e"] + F.col("char_start")).alias("e")))).drop("__new", "__chunk")
    return _laid_out(w, layout).drop("__room", "__part")


def _laid_out(w: DataFrame, layout: Layout) -> DataFrame:
    q = F.coalesce("question_ids", F.array().cast("array<int>"))
    part, special = F.col("__part"), lambda x, k: F.array(*[F.lit(x)] * k)
    ids = F.concat(special(layout.cls, 1), q, special(layout.sep, layout.between), F.transform(part, lambda t: t["id"]), special(layout.sep, 1))
    none = lambda kind: F.lit(None).cast(kind)
    span = "struct<s: int, e: int>"
    blank = lambda kind, k: F.array_repeat(none(kind), k)
    before = F.size(q) + 1 + layout.between
    n = F.size(part)
    after = F.lit(layout.max_length) - before - n
    w = w.withColumns({
        "input_ids": padded(ids, layout.max_length, F.lit(layout.pad)),
        "attention_mask": padded(F.array_repeat(F.lit(1), before + n + 1), layout.max_length, F.lit(0)),
        "offsets": F.concat(blank(span, before), F.transform(part, lambda t: F.struct(t["s"].alias("s"), t["e"].alias("e"))), blank(span, after)),
        "sequence_ids": F.concat(blank("int", F.lit(1)), F.array_repeat(F.lit(0), F.size(q)), blank("int", F.lit(layout.between)), F.array_repeat(F.lit(1), n), blank("int", after)),
    })
    return w.withColumn("cls_index", cls_index(layout.cls))


def cls_index(cls: int) -> Column:
    """Place of the first CLS id, -1 without one."""
    return (F.array_position("input_ids", cls) - 1).cast("int")


def padded(x: Column, length: int, pad: Column) -> Column:
    return F.concat(x, F.array_repeat(pad, F.greatest(F.lit(length) - F.size(x), F.lit(0))))


def labelled(features: DataFrame) -> DataFrame:
    """Adds start_position and end_position of the first answer (columns answers, answer_start).

    The tokens are the first that ends after the answer's begin and the last that begins before its end. Both
    are the CLS index without an answer, and where a window doesn't hold all of it.
    """
    answer, begin = F.get("answers", F.lit(0)), F.col("answer_start")
    end = begin + F.length(answer)
    context = F.filter(F.transform("offsets", lambda o, i: F.struct(o["s"].alias("s"), o["e"].alias("e"), i.alias("i"))), lambda t: t["s"].isNotNull())

    def place(c: Column) -> Column:
        covered = (F.get(c, F.lit(0))["s"] <= begin) & (F.try_element_at(c, F.lit(-1))["e"] >= end)
        first, last = F.get(F.filter(c, lambda t: t["e"] > begin), F.lit(0))["i"], F.try_element_at(F.filter(c, lambda t: t["s"] < end), F.lit(-1))["i"]
        return F.when(covered & (begin >= 0) & (first <= last), F.struct(first.alias("s"), last.alias("e")))

    found = features.withColumn("__label", X.bound(context, place))
    return found.withColumns({"start_position": F.coalesce("__label.s", "cls_index"), "end_position": F.coalesce("__label.e", "cls_index")}).drop("__label")


def _checks(layout: Layout, vocabulary: int, max_positions: int, position_offset: int) -> dict[str, Column]:
    """One flag per fault; the faults of spans exclude one another in this order."""
    real = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    ids = F.slice("input_ids", F.lit(1), real)
    cls, s, e = cls_index(layout.cls), F.col("start_position"), F.col("end_position")
    impossible = F.coalesce(F.col("is_impossible"), F.lit(False))
    at_cls = (s == cls) & (e == cls)
    span = ~impossible & ~at_cls
    valid = (s > 0) & (s <= e) & (e < real)
    a, b = F.get("offsets", s), F.get("offsets", e)
    inside = a.isNotNull() & b.isNotNull()
    text = F.substring("context", a["s"] + 1, b["e"] - a["s"])
    same = X.normalize_answer(F.coalesce(text, F.lit(""))) == X.normalize_answer(F.coalesce(F.get("answers", F.lit(0)), F.lit("")))
    return {
        "id_out_of_vocab": (F.array_max(ids) >= vocabulary) | (F.array_min(ids) < 0), "too_long": real > layout.max_length,
        "position_out_of_range": F.lit(position_offset) + real - 1 >= max_positions,
        "mask_mismatch": F.exists(F.slice("input_ids", real + 1, F.greatest(F.size("input_ids") - real, F.lit(0))), lambda t: t != layout.pad),
        "cls_not_at_0": cls != 0, "impossible_not_cls": impossible & ~at_cls, "n_impossible": impossible,
        "answer_outside_window": ~impossible & at_cls, "n_span": span, "span_index_invalid": span & ~valid,
        "span_on_non_context_token": span & valid & ~inside, "span_text_mismatch": span & valid & inside & ~same,
    }


def scan(features: DataFrame, layout: Layout, vocabulary: int, max_positions: int, position_offset: int = 0, unknown: int | None = None) -> DataFrame:
    """One row: n_features, a count for each check, the percentages of unknown ids and of mismatched spans, and the share of CLS labels.

    position_offset is what a model adds to a token's index before it looks up its position.
    """
    checks = _checks(layout, vocabulary, max_positions, position_offset)
    real = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    lost = F.size(F.filter(F.slice("input_ids", F.lit(1), real), lambda t: t == unknown)) if unknown is not None else F.lit(0)
    flags = features.select(*[F.coalesce(c, F.lit(False)).alias(k) for k, c in checks.items()], lost.alias("__lost"), real.alias("__real"))
    sums = flags.agg(F.count(F.lit(1)).alias("n_features"), *[F.count_if(k).alias(k) for k in checks], F.coalesce(F.sum("__lost"), F.lit(0)).alias("__lost"), F.coalesce(F.sum("__real"), F.lit(0)).alias("__real"))
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return sums.select(
        "n_features", *checks, F.round(100 * share("__lost", "__real"), 4).alias("unk_rate_pct"),
        F.round((F.col("n_impossible") + F.col("answer_outside_window")) / F.greatest("n_features", F.lit(1)), 4).alias("cls_label_fraction"),
        F.round(100 * share("span_text_mismatch", "n_span"), 4).alias("span_text_mismatch_pct"))


def mismatches(features: DataFrame, layout: Layout, most: int = 25) -> DataFrame:
    """(qid, gold, labelled) of the first spans whose text isn't the answer, by ord and window."""
    wrong = _checks(layout, 1, 1, 0)["span_text_mismatch"]
    a, b = F.get("offsets", F.col("start_position"))["s"], F.get("offsets", F.col("end_position"))["e"]
    return features.where(wrong).orderBy("ord", "window_ix").limit(most).select("qid", F.get("answers", F.lit(0)).alias("gold"), F.substring("context", a + 1, b - a).alias("labelled"))


