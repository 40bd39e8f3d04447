import hashlib
import itertools
import json
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.functions import text as X
from spanforge.operators import dataset, diagnosis, eda, report, resampling, scoring, spans, stress, threshold, training
from spanforge.sources import corpora
from spanforge.streaming import stability as stream


def examples(spark, rows):
    return spark.createDataFrame(rows, "ord bigint, qid string, question string, context string, title string, answers array<string>, answer_start int, is_impossible boolean")


@pytest.fixture
def small(spark):
    return examples(spark, [
        (0, "q1", "Thủ đô?", "Hà Nội là thủ đô. Huế đẹp. Sông dài.", "VN", ["Hà Nội"], 0, False),
        (1, "q2", "Ai?", "Hà Nội là thủ đô. Huế đẹp. Sông dài.", "VN", [], -1, True),
        (2, "q3", "Gì?", "Paris lớn.", "FR", ["Paris"], 0, False),
    ])


def test_nested_round_trip(spark, small, tmp_path):
    corpora.write_nested(small, str(tmp_path / "pieces"), {"version": "1.0", "note": 'a "b"'})
    document = json.loads("\n".join(p.read_text() for p in sorted((tmp_path / "pieces").glob("part-*"))))
    assert (document["version"], document["note"], [a["title"] for a in document["data"]]) == ("1.0", 'a "b"', ["VN", "FR"])
    (tmp_path / "x.json").write_text(json.dumps(document, indent=1))
    pieces, header = corpora.read_pieces(spark, str(tmp_path / "pieces"))
    assert header == {"version": "1.0", "note": 'a "b"'} and corpora.flatten(pieces).exceptAll(corpora.flatten(corpora.read_nested(spark, str(tmp_path / "x.json")))).isEmpty()
    flat = corpora.flatten(corpora.read_nested(spark, str(tmp_path / "x.json"))).orderBy("ord")
    assert [(r.qid, r.answers, r.answer_start, r.is_impossible) for r in flat.collect()] == [("q1", ["Hà Nội"], 0, False), ("q2", [], -1, True), ("q3", ["Paris"], 0, False)]


def test_plausible_answers_are_never_gold(spark, tmp_path):
    doc = {"version": "2", "data": [{"paragraphs": [{"context": "c", "qas": [{"id": "a", "question": "?", "is_impossible": True, "plausible_answers": {"text": ["c"], "answer_start": [0]}, "answers": {"text": [], "answer_start": []}}, {"id": "b", "question": "?", "answers": {"text": ["", "c"], "answer_start": [5, 0]}}]}]}]}
    (tmp_path / "x.json").write_text(json.dumps(doc))
    a, b = corpora.flatten(corpora.read_nested(spark, str(tmp_path / "x.json"))).orderBy("ord").collect()
    assert a.answers == [] and a.is_impossible and a.plausible == ["c"] and a.title == ""
    assert b.answers == ["c"] and b.answer_start == 5 and not b.is_impossible


def test_blind_split_is_refused(spark):
    blind = examples(spark, [(0, "q1", "?", "c", "t", [], -1, False)])
    with pytest.raises(ValueError, match="1 questions can't be graded: q1"):
        dataset.assert_gradeable(blind)


def test_duplicated_context_keeps_both_questions(spark):
    rows = examples(spark, [(0, "a", "Q1", "c", "t1", [], -1, True), (1, "b", " q1 ", "c", "t2", [], -1, True), (2, "d", "Q2", "c", "t2", [], -1, True)])
    assert [r.qid for r in corpora.keep_first(rows).orderBy("ord").collect()] == ["a", "d"]


def test_split_keeps_groups_and_counts(spark):
    rows = spark.range(300).select(F.col("id").alias("doc"), (F.col("id") % 50).cast("string").alias("context"))
    out = dataset.split_by_key(rows, "context", 0.23)
    per = out.groupBy("context").agg(F.countDistinct("split").alias("n"), F.first("split").alias("s")).collect()
    assert all(r.n == 1 for r in per) and sum(r.s == "validation" for r in per) == 11
    again = dataset.split_by_key(rows.repartition(7), "context", 0.23)
    assert again.exceptAll(out).isEmpty()
    with pytest.raises(ValueError):
        dataset.split_by_key(rows, "context", 1.5)


def test_leakage_gate(spark):
    rows = spark.createDataFrame([("a", "train"), ("a", "validation"), ("b", "train")], "context string, split string")
    with pytest.raises(ValueError, match="1 contexts"):
        dataset.assert_no_leakage(rows)
    assert dataset.without_contexts_of(rows.where("split='train'"), rows.where("split='validation'")).collect()[0].context == "b"


def test_missing_prediction_is_an_error_only_when_strict(spark, small):
    preds = spark.createDataFrame([("s", "q1", "Hà Nội"), ("s", "zz", "x")], "system string, qid string, prediction string")
    with pytest.raises(ValueError, match="2 references"):
        scoring.per_item(preds, dataset.references(small))
    items = scoring.per_item(preds, dataset.references(small), strict=False)
    got = scoring.corpus_scores(items).first()
    assert (got.n, got.n_impossible) == (3, 1) and got.em == pytest.approx(200 / 3, abs=1e-5) and got.em_impossible == 100


def test_evaluate_and_abstention(spark, small):
    out = scoring.evaluate(small, scoring.always_abstain(small))
    assert out["overall"].first().em == pytest.approx(100 / 3, abs=1e-5)
    assert all(r.unreliable for r in out["by_length"].collect())
    items = scoring.per_item(scoring.always_abstain(small), dataset.references(small))
    a = diagnosis.abstention(items).first()
    assert (a.tp, a.fp, a.fn, a.tn) == (1, 2, 0, 0) and a.precision == pytest.approx(33.33)


def test_mcnemar(spark):
    """Against exact fractions, and for a million pairs against logarithms of integers."""
    cases = [(0, 0), (1, 8), (628, 406), (5, 9), (9, 5), (0, 1), (0, 40), (7, 7), (8, 7), (15, 1), (16, 15), (300, 100), (1000, 1000), (1500, 1300), (2000, 1500), (50_200, 49_700), (10, 500)]
    got = {(r.b, r.c): r.p for r in spark.createDataFrame(cases, "b int, c int").select("b", "c", resampling.mcnemar_exact(F.col("b"), F.col("c")).alias("p")).collect()}
    for b, c in cases:
        n, k = b + c, min(b, c)
        total, term = 0, 1
        for i in range(k + 1):
            total, term = total + term, term * (n - i) // (i + 1)
        assert got[b, c] == pytest.approx(float(min(Fraction(1), Fraction(2 * total, 2**n))), rel=1e-12, abs=0), (b, c)
    far = spark.createDataFrame([(500_000, 499_000), (700_000, 300_000)], "b int, c int").select(resampling.log_mcnemar(F.col("b"), F.col("c")).alias("l"), resampling.mcnemar_exact(F.col("b"), F.col("c")).alias("p")).collect()
    for (b, c), r in zip([(500_000, 499_000), (700_000, 300_000)], far, strict=True):
        n, k = b + c, min(b, c)
        tail = term = 1.0
        for i in range(1, 30_000):
            term *= (k - i + 1) / (n - k + i)
            tail += term
        log_last = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)
        assert r.l == pytest.approx(math.log(2) + log_last + math.log(tail), abs=1e-6) and r.p == pytest.approx(math.exp(r.l), rel=1e-12, abs=0)


def test_cluster_interval_is_wider(spark):
    rows = [(f"{c}-{i}", 1.0 if c < 4 else 0.0, 0.0, f"c{c}") for c in range(20) for i in range(10)]
    p = spark.createDataFrame(rows, "qid string, em_a double, em_b double, cluster string")
    item = resampling.bootstrap_ci(p.select((F.col("em_a") - F.col("em_b")).alias("s"), F.lit(1).alias("c"))).first()
    group = resampling.bootstrap_ci(diagnosis.cluster_cells(p)).first()
    assert item.mean == group.mean == pytest.approx(0.2)
    assert group.high - group.low > 1.5 * (item.high - item.low)
    assert item.low < 0.2 < item.high


def test_resamples_draw_exactly_n_and_follow_the_multinomial(spark, monkeypatch):
    rows = [(float(k % 5), 1.0) for k in range(400)] + [(7.5, 2.0)] * 40
    cells = spark.createDataFrame(rows, "s double, c double")
    plain = resampling.resampled(cells, 3000, seed=3).orderBy("b").collect()
    assert {r.n for r in plain} == {440} and len(plain) == 3000
    monkeypatch.setattr(resampling, "BUCKET", 1)  # eight buckets: a tree of three levels
    deep = resampling.resampled(cells.repartition(7), 3000, seed=3).orderBy("b").collect()
    assert {r.n for r in deep} == {440} and deep == resampling.resampled(cells, 3000, seed=3).orderBy("b").collect()
    s, c = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for got in (plain, deep):
        x, y = np.array([r.s for r in got]), np.array([r.c for r in got])
        assert abs(x.mean() - s.sum()) < 4 * (440 * s.var() / 3000) ** 0.5 and abs(x.var() / (440 * s.var()) - 1) < 0.12
        assert abs(np.cov(x, y)[0, 1] / (440 * np.cov(s, c, bias=True)[0, 1]) - 1) < 0.25
    ci = resampling.bootstrap_ci(cells, 3000).first()
    rng = np.random.default_rng(1)
    ratio = np.sort([s[i].sum() / c[i].sum() for i in (rng.choice(440, 440) for _ in range(2000))])
    assert ci.low == pytest.approx(ratio[50], abs=0.05) and ci.high == pytest.approx(ratio[1949], abs=0.05)
    none = resampling.bootstrap_ci(cells.limit(0)).first()
    assert none.mean is None and none.low is None and none.high is None
    one = resampling.bootstrap_ci(spark.createDataFrame([(1.0, 2.0)], "s double, c double")).first()
    assert (one.mean, one.low, one.high) == (0.5, 0.5, 0.5)


def test_marks_dont_overlap_and_are_escaped_last(spark):
    def shown(text, *marks):
        row = spark.createDataFrame([(text,)], "x string").select(X.highlight(F.col("x"), [(F.lit(p), c) for p, c in marks]).alias("y"))
        return row.first().y

    assert shown("a & amp b", ("amp", "g")) == "a &amp; <mark class='g'>amp</mark> b"
    assert shown("x<b>&", ("<b>", "g")) == "x<mark class='g'>&lt;b&gt;</mark>&amp;"
    assert shown("Hà Nội đẹp, Hà Nội", ("Hà Nội", "g"), ("Nội", "p")) == "<mark class='g'>Hà Nội</mark> đẹp, <mark class='g'>Hà Nội</mark>"
    assert shown("abcabc", ("bc", "g"), ("ab", "p"), ("a", "q")) == "<mark class='q'>a</mark><mark class='g'>bc</mark><mark class='q'>a</mark><mark class='g'>bc</mark>"
    assert shown("aaa", ("aa", "g")) == "<mark class='g'>aa</mark>a"
    assert shown("mark class", ("mark", "g"), ("class", "p")) == "<mark class='g'>mark</mark> <mark class='p'>class</mark>"
    assert shown("1.5 \\E $1", (".", "g"), ("\\E", "p"), ("$1", "q")) == "1<mark class='g'>.</mark>5 <mark class='p'>\\E</mark> <mark class='q'>$1</mark>"
    assert shown("x", ("", "g"), ("y", "p")) == "x" and shown("", ("x", "g")) == "??" and shown(None, ("x", "g")) == "??"
    assert shown("x", (None, "g"), ("x", "p")) == "<mark class='p'>x</mark>"


def test_older_scores(spark):
    rows = spark.createDataFrame([
        ("s", "10$", ["10"]), ("s", "", []), ("s", "x", []), ("s", "the cat", ["cat", "the cat!"]), ("s", "?", ["!"]), ("s", " Hà_Nội ", ["hà nội"]), ("s", "x", None), ("t", "x", None),
    ], "system string, prediction string, golds array<string>")
    s = {r.system: r for r in scoring.legacy_scores(rows).collect()}["s"]
    assert (s.n, s.em, s.f1) == (7, pytest.approx(100 * 3 / 7, abs=1e-5), pytest.approx(100 * 2 / 7, abs=1e-5))
    got = {r.system: (r.exact_match, r.f1, r.total) for r in scoring.legacy_span_metrics(rows).collect()}
    assert got == {"s": (66.6667, 50.0, 6), "t": (0.0, 0.0, 0)}
    got = {r.system: (r.exact_match, r.f1) for r in scoring.legacy_span_metrics(rows, word_level=True).collect()}
    assert got["s"] == (83.3333, 66.6667)
    n = {r.system: (r.pred_avg_length, r.gt_avg_length) for r in scoring.legacy_lengths(rows).collect()}
    assert n == {"s": (1.0, 1.0), "t": (0.0, 0.0)}


def test_articles_are_placed_by_their_first_question(spark):
    """As rank() over first_ord: from 1, ties share a place and leave the next ones out."""
    a = spark.createDataFrame([(f"t{k}", o) for k, o in enumerate([30, 10, 20, 20, 5, 40])], "title string, first_ord bigint")
    assert {r.title: r.place for r in corpora.placed(a).collect()} == {"t4": 1, "t1": 2, "t2": 3, "t3": 3, "t0": 5, "t5": 6}


def test_renest_corpus_has_the_place_of_a_title(spark, sf):
    import __spark_entry__ as entry

    got = sorted(entry.queries()["renest_corpus"](spark, sf).select("place").collect())
    assert [r.place for r in got] == list(range(1, len(got) + 1))


def test_stress_set_survives_its_nested_file(spark, tmp_path):
    items = [("s2-E5-0000", "q", "c d c", "t", "E5", "E5", ["c", "c"], [0, 4], "perturbed", "x", "s2-E5-0000", 'n "1"'), ("s2-E5-0000-orig", "Q", "c d c", "t", "E5", "E5", ["c"], [0], "original", "x", "s2-E5-0000", ""), ("s2-E3a-0000", "r", "e", "u", "E3", "E3a", [], [], "slice", "y", None, "")]
    rows = spark.createDataFrame(items, "qid string, question string, context string, title string, category string, subset string, answers array<string>, answer_starts array<int>, role string, source_qid string, pair_id string, note string")
    header = {"version": "stress-v2", "categories": {"E3": "đ"}}
    corpora.write_nested(stress.ordered(rows), str(tmp_path / "p"), header)
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "p").glob("part-*")))
    (tmp_path / "x.json").write_text(text)
    document = json.loads(text)
    assert {k: document[k] for k in header} == header and [a["title"] for a in document["data"]] == ["u", "t"]
    assert [q["stress"]["role"] for q in document["data"][1]["paragraphs"][0]["qas"]] == ["perturbed", "original"]
    pieces, read = corpora.read_pieces(spark, str(tmp_path / "p"))
    assert read == header
    for articles in (pieces, corpora.read_nested(spark, str(tmp_path / "x.json"))):
        examples_, meta = corpora.stress_examples(articles)
        back = {r.qid: r for r in examples_.join(meta, "qid").collect()}
        for qid, question, context, title, category, subset, answers, starts, role, source, pair, note in items:
            r = back[qid]
            assert (r.question, r.context, r.title, r.category, r.subset, r.answers, r.answer_starts, r.role, r.source_qid, r.pair_id, r.note) == (question, context, title, category, subset, answers, starts, role, source, pair, note)
            assert r.answer_start == (starts[0] if starts else -1) and r.is_impossible == (not answers)


def windows(spark, rows):
    return spark.createDataFrame(rows, "qid string, window_ix int, delta double, score double, answer string, em double, f1 double")


def test_threshold_rules(spark):
    w = windows(spark, [("a", 0, 0.0, 5.0, "x", 1.0, 1.0), ("b", 0, None, 1.0, "y", 0.0, 0.5), ("c", 0, -1.0, 3.0, "p", 0.0, 0.0), ("c", 1, -4.0, 2.0, "q", 1.0, 1.0)])
    at = lambda t: {r.qid: r.answer for r in threshold.predictions_at(w, t).collect()}
    assert at(0.0) == {"a": "", "b": "y", "c": "p"}
    assert at(2.0) == {"a": "", "b": "y", "c": "q"}
    assert at(9.0) == {"a": "", "b": "y", "c": ""}
    assert at(-1.0)["a"] == "x"


def test_sweep_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = [(f"q{q}", k, None if rng.random() < 0.1 else round(rng.uniform(-3, 3), 2), round(rng.uniform(0, 5), 1), "a", float(rng.random() < 0.5), round(rng.random(), 2)) for q in range(40) for k in range(rng.randint(1, 4))]
    w = windows(spark, rows)
    ab = spark.createDataFrame([(f"q{q}", float(q % 3 == 0), float(q % 3 == 0)) for q in range(40)], "qid string, em0 double, f1_0 double")
    got = {round(r.tau, 7): (r.em, r.f1) for r in threshold.sweep(w, ab).collect()}
    assert len(got) > 50
    for tau, (em, f1) in got.items():
        want = [0.0, 0.0]
        for q in range(40):
            live = [r for r in rows if r[0] == f"q{q}" and (r[2] is None or r[2] + tau < 0)]
            best = max(live, key=lambda r: (r[3], -r[1])) if live else None
            want[0] += best[5] if best else float(q % 3 == 0)
            want[1] += best[6] if best else float(q % 3 == 0)
        assert (em, f1) == (pytest.approx(want[0]), pytest.approx(want[1]))


#: A question, a separator, four context tokens and a closing separator: null but for context.
OFFSETS = [None, None, None, (0, 2), (3, 6), (7, 9), (10, 16), None]


def searched(spark, pairs=(), offsets=OFFSETS, size=8, **options):
    starts, ends = [0.0] * size, [0.0] * size
    for k, a, b in pairs:
        starts[k], ends[k] = a, b
    w = spark.createDataFrame([("a", 1, starts, ends, offsets)], "qid string, window_ix int, starts array<double>, ends array<double>, offsets array<struct<s: int, e: int>>")
    return spans.endpoint_softmax(spans.scored(w, **options)).first()


def test_span_search_survives_large_logits(spark):
    r = searched(spark, [(3, 800.0, 0.0), (4, 0.0, 800.0)])
    assert (r.s, r.e) == (3, 4) and 0 < r.spans[0].prob <= 1 and r.spans[0].start_char == 0 and r.spans[0].end_char == 6


def test_span_search_keeps_to_context_tokens(spark):
    """High logits of the question, the closing separator and padding are no candidates and in no softmax."""
    r = searched(spark, [(1, 50.0, 50.0), (7, 60.0, 60.0), (3, 8.0, 0.0), (4, 0.0, 8.0)])
    assert (r.s, r.e) == (3, 4) and r.start_prob > 0.9 and r.end_prob > 0.9 and all(x.end_char <= 16 for x in r.spans)
    padded = searched(spark, [(3, 8.0, 0.0), (4, 0.0, 8.0), (10, 90.0, 90.0)], OFFSETS + [None] * 4, 12)
    assert (padded.s, padded.e, padded.score) == (r.s, r.e, r.score)


def test_span_search_null_scores(spark):
    assert searched(spark, [(0, 3.0, 2.0), (3, 5.0, 0.0), (4, 0.0, 4.0)]).null_score == 5.0
    assert searched(spark, [(0, 9.0, 9.0), (3, 1.0, 0.0), (4, 0.0, 1.0)]).delta > 0 > searched(spark, [(3, 5.0, 0.0), (4, 0.0, 4.0)]).delta
    r = searched(spark, [(3, 5.0, 0.0), (4, 0.0, 4.0)], cls_index=99)
    assert r.null_score is None and r.delta is None and r.score == 9.0 and 0 < r.spans[0].prob <= 1
    for offsets, size in (([None] * 3, 3), (OFFSETS, 0), ([], 8)):
        r = searched(spark, offsets=offsets, size=size)
        assert r.score is None and r.delta is None and r.spans in (None, [])


def test_spans_are_distinct_by_characters(spark):
    """Two tokens of one word share its place; the list names it once, with the better score."""
    offsets = [None, (0, 4), (0, 4), (5, 9), None]
    r = searched(spark, [(1, 3.0, 1.0), (2, 2.9, 2.0), (3, 1.0, 1.5)], offsets, 5, longest=1)
    assert [(x.start_char, x.end_char) for x in r.spans] == [(0, 4), (5, 9)] and r.spans[0].score == 4.9
    assert searched(spark, [(3, 5.0, 0.0), (6, 0.0, 5.0)], longest=1).spans[0].end_char <= 16


def test_windows_without_context_decide_nothing(spark):
    rows = [("q", 1, None, None), ("q", 2, -1.0, 3.0), ("r", 1, None, None)]
    w = spark.createDataFrame(rows, "qid string, window_ix int, delta double, score double")
    got = {r.qid: r for r in spans.decided(w).collect()}
    assert (got["q"].window_ix, got["q"].answered, got["q"].evidence_ix) == (2, True, 2)
    assert (got["r"].window_ix, got["r"].answered, got["r"].evidence_ix) == (None, False, None)


def test_rotating_split_deals_in_turn(spark):
    rows = spark.createDataFrame([(k, c) for k, c in enumerate("abacdbea")], "place bigint, context string")
    got = {r.context: r.split for r in dataset.rotating_split(rows, "context", F.col("place")).collect()}
    assert got == {"a": "train", "b": "validation", "c": "train", "d": "validation", "e": "train"}
    assert dataset.rotating_split(rows.withColumn("context", F.lit(None).cast("string")), "context", F.col("place")).count() == 8


def test_long_numbers_and_marked_texts(spark):
    long = "1" + "2" * 1500
    r = spark.createDataFrame([(long, "He said. \u0001Yes. Then\u0001 he left" + ")" * 60 + ". Go. Then.")], "n string, x string")
    new = r.select(stress.shifted_numbers(F.col("n"), F.lit("s"))).first()[0]
    assert len(new) == len(long) and new.isdigit() and new != long
    x = r.first().x
    got = r.select(X.sentence_spans(F.col("x")).alias("s")).first().s
    assert x[got[0].s : got[0].e] == "He said. \u0001Yes." and [x[s.s : s.e] for s in got[-2:]] == ["Go.", "Then."]
    closed = spark.createDataFrame([("End." + ")" * 60 + " Next one.",)], "x string").select(X.sentence_spans(F.col("x")).alias("s")).first().s
    assert len(closed) == 2


def test_stress_files_logs_and_legacy_rows(spark, tmp_path):
    row = {"qid": "s2-E5-0001", "question": "q", "context": "c d", "title": "t", "category": "E5", "subset": "E5", "answers": ["d"], "answer_starts": [2], "role": "perturbed", "source_qid": "x", "pair_id": "s2-E5-0001", "note": "n"}
    none = row | {"qid": "s2-E3a-0001", "answers": [], "answer_starts": []}
    corpora.write_json(spark.createDataFrame([json.dumps(row), json.dumps(none)], "string").selectExpr("from_json(value, 'qid string, question string, context string, title string, category string, subset string, answers array<string>, answer_starts array<int>, role string, source_qid string, pair_id string, note string') as x").select("x.*"), str(tmp_path / "stress"))
    examples_, meta = corpora.read_stress(spark, str(tmp_path / "stress"))
    got = {r.qid: (r.answers, r.answer_start, r.is_impossible) for r in examples_.collect()}
    assert got == {"s2-E5-0001": (["d"], 2, False), "s2-E3a-0001": ([], -1, True)} and meta.where("note = 'n'").count() == 2
    steps = spark.createDataFrame([("r", 1, 0.5)], "run string, step bigint, loss double")
    for _ in range(2):
        corpora.append_steps(steps, str(tmp_path / "log"))
    log = corpora.read_steps(spark, str(tmp_path / "log"))
    assert log.count() == 2 and log.select("run", "step", "loss").first() == ("r", 1, 0.5)
    legacy = spark.createDataFrame([("1", "q", "c")], "id string, question string, context string")
    assert corpora.load_legacy(legacy).select("title", "is_impossible").first() == ("", False)
    with pytest.raises(ValueError, match="context"):
        corpora.load_legacy(legacy.drop("context"))
    both = corpora.union_categories({"b": legacy, "a": legacy.withColumn("extra", F.lit(1))})
    assert sorted((r.category, r.extra) for r in both.collect()) == [("a", 1), ("b", None)]
    with pytest.raises(ValueError):
        corpora.union_categories({})
    nested = spark.createDataFrame([({"a": {"b": 1}},), ({"a": None},), (None,)], "x struct<a: struct<b: int>>")
    assert [r[0] for r in nested.select(X.dig(F.col("x"), "a", "b")).collect()] == [1, None, None]
    assert dataset.assert_consistent(examples(spark, [(0, "q", "?", "c", "t", ["c"], 0, False)])).count() == 1
    with pytest.raises(Exception, match="impossible question has answers"):
        dataset.assert_consistent(examples(spark, [(0, "q", "?", "c", "t", ["c"], 0, True)])).collect()


@pytest.mark.parametrize("n, budget, stride", [(0, 5, 2), (5, 5, 2), (6, 5, 2), (100, 7, 6), (13, 4, 9)])
def test_windows_cover_everything(spark, n, budget, stride):
    got = spark.range(1).select(spans.windows_over(F.lit(n), budget, stride).alias("x")).first()["x"]
    step, want, k = max(1, budget - stride), [], 0
    while n:
        want.append(k)
        if k + budget >= n:
            break
        k += step
    assert got == want


def test_boundary_alignment_of_compounds(spark):
    r = spark.createDataFrame([("Ở Hà Nội có", [("Ở", 0, 1), ("Hà_Nội", 2, 8), ("có", 9, 11)], [("Nội", 5)]), ("Ở Hà Nội có", [("Ở", 0, 1), ("Hà_Nội", 2, 8), ("có", 9, 11)], [("Hà Nội", 2)]), ("x", [("x", 0, 1)], [])], "context string, words array<struct<tok:string,s:int,e:int>>, answers array<struct<text:string,s:int>>")
    a, b, c = spans.boundary_alignment(r).collect()
    assert (a.aligned, a.oracle_em, a.oracle_s, a.oracle_e, a.start_cut) == (False, 0.0, 2, 8, True)
    assert (b.aligned, b.oracle_em) == (True, 1.0) and c.aligned is None


def test_segment_offsets(spark):
    r = spark.createDataFrame([("Ở  Hà Nội có a_b", ["Ở", "Hà_Nội", "zzz", "có", "a_b"])], "context string, pieces array<string>")
    got = spans.segment_offsets(r).first().words
    assert [(w["tok"], w["s"], w["e"]) for w in got] == [("Ở", 0, 1), ("Hà_Nội", 3, 9), ("có", 10, 12), ("a_b", 13, 16)]


def test_removed_sentence_is_safe(spark, small):
    r = stress.removed_sentence(small).collect()
    assert [(x.qid, x.removed, x.new_context) for x in r] == [("q1", "Hà Nội là thủ đô.", "Huế đẹp. Sông dài.")]


def test_profile_of_answers(spark):
    c = "Ab cd. Ef gh. Ij kl."
    rows = [(0, "a", "Ab là gì?", c, "t", ["Ab", "Ab", "cd"], 0, False), (1, "b", "Ở đâu?", c, "t", ["gh"], 10, False), (2, "c", "Ai?", c, "u", ["kl"], 17, False), (3, "d", "Ab là ai?", c, "t", [], -1, True)]
    ex = examples(spark, rows)
    r = eda.split_profile(ex).first()
    assert (r.answer_q1, r.answer_median, r.answer_q3) == (0.0, 0.5, 0.85) and r.answer_mostly_in_question_pct == 33.33
    assert r.answer_deciles == [1, 0, 0, 0, 0, 1, 0, 0, 1, 0] and r.answer_sentence_index == [1, 1, 1, 0, 0, 0, 0]
    assert {(x.n_golds, x.n) for x in eda.gold_variants(ex).collect()} == {(2, 1), (1, 2)}
    assert {(x.title, x.n, x.impossible_pct) for x in eda.impossible_share(ex, F.col("title"), "title").collect()} == {("t", 3, 33.3), ("u", 1, 0.0)}
    pairs = spark.createDataFrame([(f"q{k}", 0.9 if k else 0.5, "x y z", "x y w") for k in range(5)], "qid string, jaccard double, question string, sibling string")
    order = spark.createDataFrame([(f"q{k}", k) for k in range(5)], "qid string, ord bigint")
    assert [x.qid for x in eda.edit_examples(pairs, order).orderBy("k").collect()] == ["q1", "q2", "q3"]
    noise = eda.label_noise(examples(spark, [(0, "a", "?", "xyz", "t", ["y"], 1, False), (1, "b", "?", "x y", "t", ["x"], 0, False)])).first()
    assert (noise.cut_start, noise.cut_end, noise.cut_any_pct) == (1, 1, 100.0)


def test_plausible_answers_that_are_siblings_golds(spark):
    ex = examples(spark, [(0, "a", "?", "c", "t", ["Hà Nội.", "!"], 0, False), (1, "b", "?", "c", "t", [], -1, True), (2, "c", "?", "other", "t", [], -1, True), (3, "d", "?", "c", "t", [], -1, True)])
    p = spark.createDataFrame([("b", ["hà nội", "x"]), ("c", ["Hà Nội"]), ("d", ["!"])], "qid string, plausible array<string>").withColumn("plausible_start", F.array().cast("array<int>"))
    assert {(r.qid, r.is_gold, r.offset_ok) for r in eda.plausible_golds(ex.join(p, "qid", "left")).collect()} == {("b", True, False), ("c", False, False), ("d", False, False)}
    q = examples(spark, [(4, "e", "?", "ab cd", "t", [], -1, True), (5, "f", "?", "ab cd", "t", [], -1, True), (6, "g", "?", "ab cd", "t", [], -1, True)]).join(spark.createDataFrame([("e", ["cd"], [3]), ("f", ["cd"], [2]), ("g", ["cd"], [])], "qid string, plausible array<string>, plausible_start array<int>"), "qid")
    assert {(r.qid, r.offset_ok) for r in eda.plausible_golds(q).collect()} == {("e", True), ("f", False), ("g", False)}


def test_build_takes_misaligned_answers_and_compound_edges(spark):
    rows = [
        (0, "cut", "?", "Nội. Ở Hà Nội có", "t", ["Nội"], 10, False), (1, "edge", "?", "Ở Hà Nội có mưa", "t", ["Hà Nội có"], 2, False),
        (2, "low", "?", "Một con mèo", "t", ["con mèo"], 4, False), (3, "some", "?", "Ở Hà Nội, Huế", "t", ["Nội", "Huế"], 5, False),
        (4, "none", "?", "Ở Hà Nội có", "t", [], -1, True),
    ] + [(5 + k, f"c{k}", "?", "Ra Hà Nội", "t", ["Nội"], 6, False) for k in range(3)]
    words = {"Nội. Ở Hà Nội có": [("Nội.", 0, 4), ("Ở", 5, 6), ("Hà_Nội", 7, 13), ("có", 14, 16)], "Ở Hà Nội có mưa": [("Ở", 0, 1), ("Hà_Nội", 2, 8), ("có", 9, 11), ("mưa", 12, 15)], "Một con mèo": [("Một", 0, 3), ("con_mèo", 4, 11)], "Ở Hà Nội, Huế": [("Ở", 0, 1), ("Hà_Nội", 2, 8), (",", 8, 9), ("Huế", 10, 13)], "Ra Hà Nội": [("Ra", 0, 2), ("Hà_Nội", 3, 9)]}
    w = spark.createDataFrame(list(words.items()), "context string, words array<struct<tok:string,s:int,e:int>>")
    ex = examples(spark, rows).join(w, "context", "left")
    built = stress.build(ex)
    got = [r for r in built.collect() if r.category == "E1"]
    e1a = [r for r in got if r.subset == "E1a"]
    assert sorted(r.qid for r in e1a) == ["s2-E1a-0000", "s2-E1a-0001", "s2-E1a-0002"] and {r.source_qid for r in e1a} > {"cut"}
    assert sum(r.source_qid.startswith("c") and r.source_qid != "cut" for r in e1a) == stress.PER_CONTEXT
    assert [(r.source_qid, r.answers, r.answer_starts) for r in e1a if r.source_qid == "cut"] == [("cut", ["Nội"], [10])]
    assert {r.source_qid: r.answer_starts for r in got if r.subset == "E1b"} == {"edge": [2], "some": [5, 10]} and all(r.role == "slice" for r in got)
    assert stress.audit(built).where("qid like 's2-E1%'").count() == 0
    assert stress.build(ex, {"E1b": 1}).where("subset = 'E1b'").count() == 1


def test_distractor_keeps_the_answer(spark):
    ex = examples(spark, [(0, "q", "Paris năm nào?", "Paris có hội chợ năm 1889. Ngày 5 tháng 3 vui.", "Paris", ["1889"], 21, False)])
    r = stress.distractors(ex).first()
    assert "1889" not in r.fake and "Paris" not in r.fake and r.new_context[r.new_start:r.new_start + 4] == "1889"


@pytest.mark.parametrize("text", ["ngày 28 tháng 12 năm 2020", "thế kỷ 21", "3,5 km và 10", "0 và 7"])
def test_shifted_numbers_stay_valid(spark, text):
    import re

    rows = spark.range(40).select(stress.shifted_numbers(F.lit(text), F.col("id")).alias("x")).collect()
    for r in rows:
        assert re.sub(r"\d", "", r.x) == re.sub(r"\d", "", text)
        assert r.x != text
        for unit, hi in stress.UNITS.items():
            assert all(1 <= int(m) <= hi for m in re.findall(rf"{unit} (\d+)", r.x))
        assert all(int(y) <= 2024 for y in re.findall(r"năm (\d{4})", r.x))


def test_audit_finds_planted_faults(spark):
    rows = [("s2-E5-0000", "đã", "c", "t", ["c"], [0], "E5", "E5", "perturbed", "q", "s2-E5-0000", ""), ("s2-E3b-0000", "?", "x c y", "t", [], [], "E3", "E3b", "perturbed", "q", "s2-E3b-0000", "câu đã xoá: c"), ("s2-E3b-0000-orig", "?", "c", "t", ["c"], [0], "E3", "E3b", "original", "q", "s2-E3b-0000", ""), ("s2-E2a-0000", "?", "abc", "t", ["c"], [0], "E2", "E2a", "slice", "q", None, "")]
    from spanforge import schemas

    found = {(r.qid, r.reason) for r in stress.audit(spark.createDataFrame(rows, schemas.STRESS)).collect()}
    assert found == {("s2-E5-0000", "question keeps diacritics"), ("s2-E3b-0000", "an answer remains"), ("s2-E2a-0000", "wrong offset")}


def curves(spark, rows):
    rows = [(r, e, *map(float, x)) for r, e, *x in rows]
    return spark.createDataFrame(rows, "run string, epoch int, train_loss double, val_em double, val_f1 double")


def test_curve_verdicts(spark):
    c = curves(spark, [("over", 1, 3.0, 50.0, 60.0), ("over", 2, 2.0, 55, 70), ("over", 3, 1.0, 50, 65), ("unst", 1, 1.0, 50, 60), ("unst", 2, 2.0, 40, 50), ("up", 1, 2.0, 1, 10), ("up", 2, 1.0, 2, 20), ("one", 1, 1.0, 30.1, 30.2), ("tie", 1, 2.0, 1, 9), ("tie", 2, 1.0, 1, 9)])
    got = {r.run: (r.verdict, r.best_epoch, r.degenerate) for r in training.curve_diagnosis(c).collect()}
    assert got == {"over": ("overfitting", 2, False), "unst": ("unstable", 1, False), "up": ("still improving", 2, False), "one": ("too short", 1, True), "tie": ("no clear trend", 1, False)}


def test_stability_batch_and_stream_agree(spark):
    rows = [("down", k, 5 - k / 10) for k in range(30)] + [("jump", k, 1.0 if k < 15 else 2.0) for k in range(30)] + [("short", 0, 1.0)]
    s = spark.createDataFrame(rows, "run string, step bigint, loss double")
    batch = {r.run: (r.stable, r.max_rise, r.first_violation) for r in training.stability(s, 5, 0.3).collect()}
    assert batch == {"down": (True, 0.0, None), "jump": (False, 1.0, 16), "short": (True, 0.0, None)}
    live = {r.run: (r.first_violation < 0, r.max_rise, None if r.first_violation < 0 else r.first_violation) for r in stream.run_to_end(s, 5, 0.3).collect()}
    assert live == batch


def test_stream_takes_steps_in_their_order_over_triggers(spark):
    """Steps of every run are scattered over seven triggers; a missing one is given up once too many wait."""
    rng = random.Random(3)
    rows = [(f"r{r}", k, rng.random() + (1 if rng.random() < 0.1 else 0)) for r in range(4) for k in range(120)]
    s = spark.createDataFrame(rows, "run string, step bigint, loss double").repartition(7, F.xxhash64("run", "step"))
    batch = {r.run: (r.max_rise, r.first_violation) for r in training.stability(s, 6, 0.3).collect()}
    live = stream.run_to_end(s, 6, 0.3, files_per_trigger=1).collect()
    assert {r.run: (r.max_rise, None if r.first_violation < 0 else r.first_violation) for r in live} == batch
    assert all((r.n_steps, r.n_waiting, r.n_late) == (120, 0, 0) for r in live)
    gap = spark.createDataFrame([("g", k, 1.0) for k in range(50) if k not in (10, 30)] + [("g", 3, 9.0)], "run string, step bigint, loss double").coalesce(1)
    few, many = stream.run_to_end(gap, 5, 0.3, patience=15).first(), stream.run_to_end(gap, 5, 0.3).first()
    assert (few.n_steps + few.n_waiting, few.n_late, few.max_rise) == (48, 1, 0.0) and few.n_steps >= 29
    assert (many.n_steps, many.n_waiting, many.n_late) == (10, 38, 1)


def test_replay_keeps_what_waits_below_the_patience(spark):
    """Runs of far more steps than the patience; scattered over all triggers most of their steps would wait and some be given up."""
    rng = random.Random(4)
    rows = [(f"r{r}", k, rng.random() + (1 if rng.random() < 0.01 else 0)) for r in range(2) for k in range(1, 3001)]
    s = spark.createDataFrame(rows, "run string, step bigint, loss double").repartition(3)
    batch = {r.run: (r.max_rise, r.first_violation) for r in training.stability(s, 6, 0.3).collect()}
    late = stream.delayed(s, late=200)
    assert late.where("trigger > 0").count() and late.agg(F.max("trigger")).first()[0] == 7
    live = stream.run_to_end(late, 6, 0.3, first_step=1, patience=300, files_per_trigger=1).collect()
    assert {r.run: (r.max_rise, r.first_violation) for r in live} == batch and all((r.n_steps, r.n_waiting, r.n_late) == (3000, 0, 0) for r in live)


@pytest.mark.parametrize("block", [5, 7, 64, 1 << 16])
def test_stability_by_blocks_equals_the_loop(spark, block):
    """Runs with gaps between their steps, shorter than the window, longer than many blocks, and rises that only earlier blocks explain."""
    rng = random.Random(block)
    runs = {f"r{k}": [rng.random() + (2 if rng.random() < 0.05 else 0) + j * d for j in range(n)] for k, (n, d) in enumerate([(1, 0), (4, 0), (5, 0), (40, 0.0), (333, 0.002), (200, -0.01)])}
    rows = [(r, 3 * j - 50 if r == "r3" else j, x) for r, v in runs.items() for j, x in enumerate(v)]
    got = {r.run: r for r in training.stability(spark.createDataFrame(rows, "run string, step bigint, loss double").repartition(3), 5, 0.4, block).collect()}
    for run, v in runs.items():
        least, rise, first = float("inf"), 0.0, None
        for j in range(4, len(v)):
            mean = sum(v[j - 4 : j + 1]) / 5
            least = min(least, mean)
            rise = max(rise, mean - least)
            if mean - least > 0.4 and first is None:
                first = j
        assert (got[run].stable, got[run].first_violation) == (first is None, first) and got[run].max_rise == pytest.approx(rise, abs=1e-6)


def test_run_selection_rule(spark):
    cols = "run string, dev_f1 double, curve_f1 double, stable boolean, is_candidate boolean, has_predictions boolean"
    pick = lambda rows: training.select_run(spark.createDataFrame(rows, cols)).first().run
    base = [("a", 60.0, None, None, False, True), ("b", None, 61.0, None, False, True)]
    assert pick(base) == "b"
    assert pick([*base, ("c", 61.0, None, True, True, True)]) == "b"
    assert pick([*base, ("c", 61.5, None, False, True, True)]) == "b"
    assert pick([*base, ("c", 61.5, None, True, True, True)]) == "c"


def test_schedule(spark):
    x = spark.range(1).select(training.schedule(F.lit(100), 8, 2, 3, 0.1).alias("x")).first().x
    assert tuple(x) == (6, 18, 1)
    with pytest.raises(ValueError):
        training.schedule(F.lit(1), 0, 1, 1, 0.1)


def test_kappa_edges(spark):
    sheet = lambda rows: spark.createDataFrame(rows, "qid string, nguoi_1 string, nguoi_2 string")
    assert diagnosis.kappa(sheet([("a", "", "")])).first().kappa is None
    assert diagnosis.kappa(sheet([("a", "ok", "ok")])).first().kappa == 1.0


def test_order_stats_follow_the_index_rule(spark):
    xs = list(range(1, 42))
    r = eda.order_stats(spark.createDataFrame([(x,) for x in xs], "v int"), "v").first()
    assert (r.n, r["mean"], r["median"], r.p05, r.p95, r["max"]) == (41, 21.0, 21.0, xs[2], xs[38], 41)
    assert eda.order_stats(spark.createDataFrame([], "v int"), "v").first().n is None


def test_pivot_marks_small_groups(spark):
    s = spark.createDataFrame([("s1", "<100", 50, 12.5), ("s2", "<100", 3, 1.0)], "system string, b string, n int, f1 double")
    r = report.pivot(s, "b", ["<100", "300+"], ["s1", "s2", "s3"]).collect()
    assert [(x.place, x.s1, x.s2, x.s3) for x in r] == [(1, "12.50", "1.00†", "")]


def test_removed_sentences_cut_a_context_once(spark):
    """The plan holds the sentences' expression once; filters above it used to repeat it."""
    ex = spark.createDataFrame([("q", "One 1. Two 2. Three 3.", ["Two"], 7, False)], "qid string, context string, answers array<string>, answer_start int, is_impossible boolean").repartition(1)
    r = stress.removed_sentence(ex)
    assert r._jdf.queryExecution().optimizedPlan().toString().count("À-Ỹ") == 1
    assert [(x.removed, x.new_context) for x in r.collect()] == [("Two 2.", "One 1. Three 3.")]


def test_near_duplicates_find_every_pair_at_the_threshold(spark):
    """Copies that begin with other words: each hash needs a salt of its own, not the shingle's place."""
    rng = random.Random(3)
    texts = []
    for k in range(80):
        w = [f"{k}-{rng.randrange(10_000)}" for _ in range(100)]
        texts += [w, [f"x{k}", *w[rng.randrange(1, 8):]], [*w[:50], f"y{k}", *w[50 + rng.randrange(1, 4):]]]
    rows = [(" ".join(w), ("train", "validation")[n % 2]) for n, w in enumerate(texts)]
    sets = [(hashlib.md5(c.encode()).hexdigest(), s, {tuple(w[i:i + 5]) for i in range(len(w) - 4)}) for (c, s), w in zip(rows, texts)]
    want = {}
    for x, y in itertools.combinations(sorted(sets, key=lambda r: r[0]), 2):
        j = round(len(x[2] & y[2]) / len(x[2] | y[2]), 6)
        if x[1] != y[1] and j >= 0.8:
            want[x[0], y[0]] = j
    got = {(r.context_a, r.context_b): r.jaccard for r in dataset.near_duplicate_contexts(spark.createDataFrame(rows, "context string, split string")).collect()}
    assert len(want) > 100 and got == want


def test_distractors_cut_a_context_once(spark):
    """The plan holds the sentences' and the answers' expressions once; filters used to repeat both."""
    rows = [("q", "Ở Paris?", "Paris 1889 xây tháp. Sau đó nghỉ.", "Paris", ["1889"], 6, False), ("r", "Ở đâu?", "Paris 1889 xây tháp.", "Paris", ["1889"], 6, False), ("s", "Ở Paris?", "Paris 1889 xây tháp.", "Paris", [], -1, True), ("t", "Ở Paris?", "Năm 1889 xây tháp. Paris 2 lần.", "Paris", ["1889"], 4, False), ("u", "Ở Paris?", "Paris 1889.", None, ["1889"], 6, False)]
    ex = spark.createDataFrame(rows, "qid string, question string, context string, title string, answers array<string>, answer_start int, is_impossible boolean").repartition(1)
    r = stress.distractors(ex.withColumn("answers", F.transform("answers", lambda a: F.regexp_replace(a, "only-here", ""))))
    plan = r._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("À-Ỹ") == 1 and plan.count("only-here") == 1
    (x,) = r.collect()
    assert x.qid == "q" and "1889" not in x.fake and "Paris" not in x.fake and x.fake.endswith(" xây tháp.") and x.new_context[x.new_start:x.new_start + 4] == "1889"


def test_candidates_share_as_many_bands_as_the_threshold_allows():
    """By the exact binomial tail; few bands ask for one, as before."""
    tail = lambda p, n, k: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k))
    assert dataset._shared_bands(0.64, 25) == 3 and tail(0.64, 25, 3) <= 1e-8 < tail(0.64, 25, 4)
    assert dataset._shared_bands(0.64, 1) == dataset._shared_bands(0.64, 5) == 1
