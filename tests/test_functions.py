import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanforge.functions import metrics as M
from spanforge.functions import text as X


def one(spark, expr, **columns):
    df = spark.range(1)
    for k, v in columns.items():
        df = df.withColumn(k, F.lit(v) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]) if v else F.array().cast("array<string>"))
    return df.select(expr.alias("x")).first()["x"]


C = F.col


@pytest.mark.parametrize("text, want", [(None, ""), ("", ""), ("  Hà   Nội. ", "hà nội"), ("Con $5+!", "con $5+"), ("a-b", "ab"), ("x y\u001cz", "x y z")])
def test_normalize(spark, text, want):
    assert one(spark, X.normalize_answer(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("p, g, want", [("thủ đô Hà Nội", "Hà Nội", 2 / 3), ("a a b", "a b", 0.8), ("", "", 1.0), ("a", "", 0.0), ("a", "b", 0.0)])
def test_token_f1(spark, p, g, want):
    assert one(spark, M.token_f1(C("p"), C("g")), p=p, g=g) == pytest.approx(want)


@pytest.mark.parametrize("text, want", [("Dài 8.5 km. Hết.", ["Dài 8.5 km.", "Hết."]), ("  ", []), ("một", ["một"]), ("A! B? C", ["A!", "B?", "C"]), ("Năm 5. Sau", ["Năm 5. Sau"])])
def test_sentences(spark, text, want):
    assert one(spark, X.sentences(F.lit(text))) == want


def test_sentence_spans_cover_their_text(spark):
    text = "Một câu. \"Hai câu.\" Ba 2.5 câu… Bốn 😀 câu. cuối"
    spans = one(spark, X.sentence_spans(F.lit(text)))
    assert [text[s["s"]:s["e"]] for s in spans] == ["Một câu.", "\"Hai câu.\"", "Ba 2.5 câu…", "Bốn 😀 câu. cuối"]


@pytest.mark.parametrize("n, want", [(0, "<100"), (99, "<100"), (100, "100-200"), (200, "100-200"), (201, "200-300"), (300, "200-300"), (301, "300+")])
def test_length_bucket(spark, n, want):
    assert one(spark, X.length_bucket(F.lit(n))) == want


def test_negative_length_is_an_error(spark):
    with pytest.raises(Exception, match="negative length"):
        one(spark, X.length_bucket(F.lit(-1)))


@pytest.mark.parametrize("p, golds, want", [
    ("Hà Nội", ["Hà Nội"], None), ("", [], None), ("gì đó", [], "false_answer"), ("", ["Hà Nội"], "false_abstain"), ("Huế", ["Hà Nội"], "wrong_span"),
    ("thủ đô Hà Nội", ["Hà Nội"], "boundary_superset"), ("Hà", ["Hà Nội"], "boundary_subset"), ("đô Hà", ["Hà Nội"], "boundary_overlap"), ("hà nội!", ["Hà Nội"], None),
])
def test_error_classes(spark, p, golds, want):
    assert one(spark, M.error_class(C("p"), C("g")), p=p, g=golds) == want


def test_strip_diacritics_and_locale(spark):
    assert one(spark, X.strip_diacritics(F.lit("Đường Nguyễn"))) == "Duong Nguyen"
    assert one(spark, X.locale_number(F.lit(3814), 0)) == "3.814"
    assert one(spark, X.locale_number(F.lit(30.44), 2)) == "30,44"
    assert one(spark, X.locale_number(F.lit(None).cast("double"), 2)) == "??"


def test_slice_text_refuses_bad_spans(spark):
    assert one(spark, X.slice_text(F.lit("abcdef"), F.lit(1), F.lit(3))) == "bc"
    for s, e in ((-1, 2), (3, 2), (0, 7)):
        with pytest.raises(Exception, match="out of bounds"):
            one(spark, X.slice_text(F.lit("abcdef"), F.lit(s), F.lit(e)))


def test_locate(spark):
    assert one(spark, X.locate(F.lit("a b a"), F.lit("a"), F.lit(4))) == 4
    assert one(spark, X.locate(F.lit("a b a"), F.lit("a"), F.lit(3))) == 0
    assert one(spark, X.locate(F.lit("a b a"), F.lit("z"), F.lit(0))) == -1


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=300))
def test_offsets_are_prefix_sums(spark, lengths):
    got = one(spark, X.offsets(F.from_json(F.lit(str(lengths)), "array<int>")))
    assert got == [sum(lengths[:k]) for k in range(len(lengths))]


@settings(max_examples=25, deadline=None)
@given(st.text("ab c", max_size=12), st.text("ab c", max_size=12))
def test_em_is_at_most_f1(spark, p, g):
    em, f1 = one(spark, F.struct(M.exact_match(C("p"), C("g")), M.token_f1(C("p"), C("g"))), p=p, g=g)
    assert em <= f1 <= 1


def test_char_coverage_of_a_long_text_is_linear(spark):
    """300,000 words: a substring for each, which scans the text up to it, takes minutes. Places may be anywhere."""
    import time

    from spanforge.operators import spans

    df = spark.range(1).select(F.repeat(F.lit("ệbcde "), 300_000).alias("c"), F.transform(F.sequence(F.lit(0), F.lit(299_999)), lambda k: F.struct((k * 6).cast("int").alias("s"), (k * 6 + 3).cast("int").alias("e"))).alias("w"))
    began = time.time()
    assert df.select(spans.char_coverage(F.col("c"), F.col("w")).alias("x")).first().x == 0.6 and time.time() - began < 45
    odd = spark.sql("select ' a\U0001f600 b ' c, array(named_struct('s', 1, 'e', 4), named_struct('s', 4, 'e', 99), named_struct('s', 3, 'e', 3)) w")
    assert odd.select(spans.char_coverage(F.col("c"), F.col("w")).alias("x")).first().x == 1.0


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 4096, 70_001])
def test_offsets_by_blocks_of_blocks(spark, n):
    lengths = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: (k % 7).cast("int")) if n else F.array().cast("array<int>")
    want, total = [], 0
    for k in range(1, n + 1):
        want.append(total)
        total += k % 7
    assert spark.range(1).select(X.offsets(lengths).alias("x")).first().x == want
