"""Schemas of nested corpora, flat examples, predictions and window scores."""

from __future__ import annotations

from pyspark.sql import types as T

_ANSWERS = T.StructType([T.StructField("text", T.ArrayType(T.StringType())), T.StructField("answer_start", T.ArrayType(T.IntegerType()))])
_NOTES = T.StructType([T.StructField(n, T.StringType()) for n in ("category", "subset", "role", "source_qid", "pair_id", "note")])
#: ord and first_ord are written by `corpora.write_nested`, so that order outlives pieces; other files lack them.
_QA = T.StructType([T.StructField("ord", T.LongType()), T.StructField("id", T.StringType()), T.StructField("question", T.StringType()), T.StructField("is_impossible", T.BooleanType()), T.StructField("answers", _ANSWERS), T.StructField("plausible_answers", _ANSWERS), T.StructField("stress", _NOTES)])
_PARAGRAPH = T.StructType([T.StructField("context", T.StringType()), T.StructField("qas", T.ArrayType(_QA))])
ARTICLE = T.StructType([T.StructField("first_ord", T.LongType()), T.StructField("title", T.StringType()), T.StructField("paragraphs", T.ArrayType(_PARAGRAPH))])
NESTED = T.StructType([T.StructField("version", T.StringType()), T.StructField("data", T.ArrayType(ARTICLE))])

#: Flat examples; ord carries the input's order, which decides ties.
EXAMPLES = "ord bigint, qid string, question string, context string, title string, answers array<string>, answer_start int, is_impossible boolean"
PREDICTIONS = "system string, qid string, prediction string"
WINDOW_SCORES = "system string, split string, qid string, window_ix int, delta double, score double, answer string"
STRESS = "qid string, question string, context string, title string, answers array<string>, answer_starts array<int>, category string, subset string, role string, source_qid string, pair_id string, note string"
REVIEW = "qid string, subset string, cau_hoi string, dap_an_goc string, thay_doi string, context_moi string, tieu_chi string, nguoi_1 string, nguoi_2 string, ghi_chu string"
CURVES = "run string, epoch int, train_loss double, val_em double, val_f1 double, seconds double"
STEPS = "run string, step bigint, epoch int, loss double, cls_loss double, span_loss double, grad_norm double, lr double"
LEGACY_PREDICTIONS = "id string, prediction_text string, confidence double"
LEGACY_REFERENCES = "id string, question string, context string, is_impossible boolean, answers struct<text: array<string>, answer_start: array<int>>"
