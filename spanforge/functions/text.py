"""Text operators as Column -> Column expressions: no UDF, everything stays in the JVM.

Offsets are code points, as Spark's substring, instr and length count them. Null texts read as ''
where a function says so; otherwise null stays null.
"""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode, with the separators U+001C to U+001F that Java's class leaves out.
SPACE = r"(?U)[\s\x1c-\x1f]+"

# Word classes of questions in the order of their priority.
QUESTION_WORDS = [
    ("bao nhiêu", "Số lượng"), ("mấy", "Số lượng"),
    ("khi nào", "Thời gian"), ("năm nào", "Thời gian"), ("năm bao", "Thời gian"),
    ("lúc nào", "Thời gian"), ("thời gian nào", "Thời gian"), ("bao giờ", "Thời gian"),
    ("ở đâu", "Địa điểm"), ("nơi nào", "Địa điểm"), ("đâu", "Địa điểm"),
    ("tại sao", "Lý do"), ("vì sao", "Lý do"), ("lý do", "Lý do"), ("nguyên nhân", "Lý do"),
    ("như thế nào", "Cách thức"), ("ra sao", "Cách thức"), ("bằng cách nào", "Cách thức"),
    (" ai", "Người"), ("ai ", "Người"),
    ("là gì", "Định nghĩa/Sự vật"), ("gì", "Định nghĩa/Sự vật"),
    ("nào", "Lựa chọn (…nào)"),
]
OTHER_QUESTION = "Khác"
# Labels of answer surface types.
ANSWER_TYPES = ["Số / ngày tháng", "Tên riêng", "Cụm ngắn (≤4 từ)", "Cụm vừa (5–12 từ)", "Mệnh đề dài (>12 từ)"]
# Patterns of the keyword detectors.
NEGATIONS = ["không", "chưa", "chẳng", "đừng", "chưa từng", "không phải", "không bao giờ", "không bao hỗ", "không phải là", "sai thời gian", "không nên", "không nên hỏi"]
MULTI_HOP = ["và cũng", "cũng như", "đồng thời", "bên cạnh", "ngoài ra", "sau khi", "trước khi", "do đó", "vì vậy", "kết quả là", "dựa trên", "so với với", "so với", "liệu có", "tại sao cùng", "khi nào và"]
# Antonym pairs and negation words of the edit types.
ANTONYMS = [("trước", "sau"), ("nhiều", "ít"), ("lớn", "nhỏ"), ("cao", "thấp"), ("đầu", "cuối"), ("tăng", "giảm"), ("mạnh", "yếu"), ("thắng", "thua"), ("bắc", "nam"), ("đông", "tây"), ("trong", "ngoài"), ("dài", "ngắn"), ("mới", "cũ"), ("nhất", "kém")]
EDIT_NEGATIONS = ["không", "chưa", "chẳng", "đừng", "chả"]
EDIT_TYPES = ["Đảo vị trí thực thể", "Giống hệt", "Thêm/bớt phủ định", "Đổi số / thời gian", "Đổi sang từ trái nghĩa", "Thay thực thể (tên riêng)", "Thay từ/cụm thường"]
# Bucket labels and their edges.
ANSWER_BUCKETS = [(2, "1-2"), (5, "3-5"), (10, "6-10")]
CONTEXT_BUCKETS = [(100, "<100"), (200, "100-200"), (300, "200-300")]


def bound(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def remove_punctuation(x: Column) -> Column:
    """Drops Unicode punctuation; symbols such as $ and + stay."""
    return F.regexp_replace(x, r"\p{P}", "")


def tokens(x: Column) -> Column:
    """Lower-cased words without punctuation, repeats kept; null and '' give an empty array."""
    return F.filter(F.split(remove_punctuation(F.lower(F.coalesce(x, F.lit("")))), SPACE), lambda t: t != "")


def normalize_answer(x: Column) -> Column:
    return F.concat_ws(" ", tokens(x))


@lru_cache(1)
def _accents() -> tuple[str, str]:
    """Characters of the BMP that decompose to one base letter and marks, and those letters, by Unicode's rule."""
    from_, to = [], []
    for code in range(0xA0, min(sys.maxunicode, 0xFFFF) + 1):
        c = chr(code)
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        base = "".join(d for d in unicodedata.normalize("NFD", c) if unicodedata.category(d) != "Mn")
        base = unicodedata.normalize("NFC", base)
        if len(base) == 1 and base != c:
            from_.append(c)
            to.append(base)
    return "".join(from_), "".join(to)


def strip_diacritics(x: Column) -> Column:
    """Base letters without marks, case kept; d with a stroke becomes d."""
    from_, to = _accents()
    return F.regexp_replace(F.translate(x, from_ + "đĐ", to + "dD"), r"\p{Mn}", "")


def sentences(x: Column) -> Column:
    """Pieces after runs of . ! ? that no digit precedes, trimmed, blanks dropped."""
    parts = F.split(F.coalesce(x, F.lit("")), r"(?U)(?<=(?<!\d)[.!?])\s+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def legacy_sentences(x: Column) -> Column:
    """Pieces between runs of . ! ? or line ends, longer than five characters."""
    return F.filter(F.transform(F.split(x, r"[.!?]+|\n"), strip), lambda s: F.length(s) > 5)


#: Elements in a block of the prefix sums of array lengths, and levels of blocks.
_BLOCK, _LEVELS = 16, 3


def offsets(lengths: Column, levels: int = _LEVELS) -> Column:
    """Sum of the lengths before each element; by blocks of blocks, so that an element costs a few additions however long the array is."""
    add = lambda a, y: a + y
    total = lambda x: F.aggregate(x, F.lit(0), add)

    def placed(n: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / _BLOCK).cast("int")), lambda b: total(F.slice(n, b * _BLOCK + 1, F.lit(_BLOCK))))
        before = offsets(blocks, levels - 1) if levels > 1 else bound(blocks, lambda s: F.transform(s, lambda y, b: total(F.slice(s, F.lit(1), b))))
        block = lambda k: F.floor(k / _BLOCK).cast("int")
        return bound(before, lambda s: F.transform(n, lambda y, k: F.get(s, block(k)) + total(F.slice(n, block(k) * _BLOCK + 1, k % _BLOCK))))

    return bound(lengths, lambda n: F.when(F.size(n) > 0, placed(n)).otherwise(F.array().cast("array<int>")))


def sentence_spans(x: Column, quotes: bool = True) -> Column:
    """array<struct<s, e>>: a boundary is white space after . ! ? or an ellipsis (and closing quotes), before
    an opening quote or a capital, digit or letter of the class. quotes=False is the plainer variant."""
    # What ends a sentence, what may close it, what may begin the next.
    if quotes:
        cut = r"(?U)([.!?…][\"”’)\]]*)(\s+)(?=[\"“‘(\[]?[A-ZÀ-Ỹ0-9Đ])"
    else:
        cut = r"(?U)([.!?…])(\s+)(?=[\"“(]?[A-ZÀ-Ỹ0-9])"
    # only places are taken from the marked text, so a mark that the text has itself may be another character there
    mark = "\u0001"
    pieces = F.split(F.regexp_replace(F.translate(x, mark, "\u0002"), cut, "$1" + mark + "$2"), mark)

    def spans(p: Column) -> Column:
        def placed(before: Column) -> Column:
            one = lambda y, k: F.struct(
                (F.get(before, k) + F.when(k > 0, F.length(y) - F.length(F.regexp_replace(y, r"(?U)^[\s\x1c-\x1f]+", ""))).otherwise(0)).alias("s"),
                (F.get(before, k) + F.length(F.regexp_replace(y, r"(?U)[\s\x1c-\x1f]+$", ""))).alias("e"),
            )
            return F.filter(F.transform(p, one), lambda s: s["e"] > s["s"])

        return bound(offsets(F.transform(p, F.length)), placed)

    return bound(pieces, spans)


def sentence_index(spans: Column, at: Column) -> Column:
    """Index of the span that holds a character; null if none does."""
    return F.get(F.filter(F.transform(spans, lambda s, k: F.when((s["s"] <= at) & (at < s["e"]), k)), lambda k: k.isNotNull()), F.lit(0))


def slice_text(x: Column, s: Column, e: Column) -> Column:
    """Characters s to e; a span that is negative, inverted or beyond the text is an error."""
    bad = (s < 0) | (e < s) | (e > F.length(x))
    return F.when(bad, F.raise_error(F.concat(F.lit("span out of bounds: "), s.cast("string"), F.lit(", "), e.cast("string")))).otherwise(F.substring(x, s + 1, e - s))


def numbers(x: Column) -> Column:
    # Fixed value: digits, with groups behind points or commas.
    return F.regexp_extract_all(x, F.lit(r"(\d+(?:[.,]\d+)*)"))


def locate(context: Column, answer: Column, at: Column) -> Column:
    """The given offset if the answer is there, else its first place in the context, else -1."""
    return F.when((at >= 0) & (F.substring(context, at + 1, F.length(answer)) == answer), at).otherwise(F.instr(context, answer) - 1)


def locate_all(context: Column, answers: Column, at: Column) -> Column:
    """Offsets of all answers, -1 where one is not found; only the first one has a given offset."""
    return F.transform(answers, lambda a, k: F.when(k == 0, locate(context, a, at)).otherwise(F.instr(context, a) - 1))


def located(context: Column, answers: Column, at: Column) -> Column:
    """array<struct<text, s>> of the answers that are found."""
    return F.filter(F.transform(answers, lambda a, k: F.struct(a.alias("text"), F.when(k == 0, locate(context, a, at)).otherwise(F.instr(context, a) - 1).alias("s"))), lambda r: r["s"] >= 0)


def answer_length_bucket(n: Column) -> Column:
    out = F.lit("11+")
    for top, label in reversed(ANSWER_BUCKETS):
        out = F.when(n <= top, label).otherwise(out)
    return out


def length_bucket(n: Column) -> Column:
    """Upper bounds are closed but for the first; a negative length is an error."""
    out = F.lit("300+")
    for k, (top, label) in reversed(list(enumerate(CONTEXT_BUCKETS))):
        out = F.when(n < top if k == 0 else n <= top, label).otherwise(out)
    return F.when(n < 0, F.raise_error(F.lit("negative length"))).otherwise(out)


def question_type(question: Column, context: Column, coverage: float = 0.6) -> Column:
    """single_sentence if some sentence covers enough of the question's distinct words, else multi_sentence."""

    def typed(q: Column) -> Column:
        best = lambda ss: F.array_max(F.transform(ss, lambda s: F.size(F.array_intersect(q, tokens(s))) / F.size(q)))
        of = lambda ss: F.when((F.size(q) == 0) | (F.size(ss) <= 1) | (best(ss) >= coverage), "single_sentence").otherwise("multi_sentence")
        return bound(sentences(context), of)

    return bound(F.array_distinct(tokens(question)), typed)


def question_word_class(q: Column) -> Column:
    text = F.concat(F.lit(" "), F.regexp_replace(F.lower(q), r"^[ ?]+|[ ?]+$", ""), F.lit(" "))
    out = F.lit(OTHER_QUESTION)
    for word, label in reversed(QUESTION_WORDS):
        out = F.when(F.instr(text, word) > 0, label).otherwise(out)
    return out


def answer_type(a: Column) -> Column:
    words = F.filter(F.split(a, SPACE), lambda t: t != "")
    capital = lambda w: F.forall(w, lambda t: ~t.rlike(r"^\p{L}") | t.rlike(r"^\p{Lu}"))
    return bound(words, lambda w: F.when(a.rlike(r"\d"), ANSWER_TYPES[0]).when((F.size(w) > 0) & (F.size(w) <= 6) & capital(w), ANSWER_TYPES[1]).when(F.size(w) <= 4, ANSWER_TYPES[2]).when(F.size(w) <= 12, ANSWER_TYPES[3]).otherwise(ANSWER_TYPES[4]))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    return F.when(F.size(F.array_union(a, b)) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def multiset_minus(a: Column, b: Column) -> Column:
    """Distinct elements that a holds more often than b."""
    count = lambda x, v: F.size(F.filter(x, lambda y: y == v))
    return F.filter(F.array_distinct(a), lambda v: count(a, v) > count(b, v))


def edit_type(impossible: Column, sibling: Column) -> Column:
    """How an answerable question was turned into an impossible one, by ordered rules."""
    a, b = tokens(sibling), tokens(impossible)
    has = lambda words, w: F.array_contains(words, w)
    name = lambda w: F.regexp_replace(F.lower(w), r"^[?,.]+|[?,.]+$", "")
    caps = F.transform(F.filter(F.split(F.concat_ws(" ", impossible, sibling), SPACE), lambda w: w.rlike(r"^\p{Lu}")), name)

    def rules(x: Column) -> Column:
        add, rem = x["add"], x["rem"]
        both = F.concat(add, rem)
        swapped = F.lit(False)
        for u, v in ANTONYMS:
            swapped = swapped | (has(add, u) & has(rem, v)) | (has(add, v) & has(rem, u))
        return (
            F.when((F.size(both) == 0) & (x["a"] != x["b"]), EDIT_TYPES[0]).when(F.size(both) == 0, EDIT_TYPES[1])
            .when(F.arrays_overlap(both, F.array(*[F.lit(w) for w in EDIT_NEGATIONS])), EDIT_TYPES[2])
            .when(F.exists(both, lambda t: t.rlike(r"\d")), EDIT_TYPES[3])
            .when(swapped, EDIT_TYPES[4])
            .when(F.arrays_overlap(both, x["caps"]), EDIT_TYPES[5])
            .otherwise(EDIT_TYPES[6])
        )

    pair = F.struct(a.alias("a"), b.alias("b"))
    full = bound(pair, lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), multiset_minus(p["b"], p["a"]).alias("add"), multiset_minus(p["a"], p["b"]).alias("rem"), caps.alias("caps")))
    return bound(full, rules)


def is_letter_at(x: Column, at: Column) -> Column:
    """Whether the character at an offset is a letter; false outside the text."""
    return (at >= 0) & F.coalesce(F.substring(x, at + 1, F.lit(1)).rlike(r"^\p{L}$"), F.lit(False))


def desegment(x: Column) -> Column:
    return F.replace(x, F.lit("_"), F.lit(" "))


def legacy_normalize(x: Column) -> Column:
    """Lower case, ASCII punctuation dropped, white space collapsed."""
    ascii_marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    return F.concat_ws(" ", F.filter(F.split(F.translate(F.lower(x), ascii_marks, ""), SPACE), lambda t: t != ""))


def spaced_normalize(x: Column) -> Column:
    """Lower case, each non-word character becomes a space, white space collapsed."""
    return F.regexp_replace(F.regexp_replace(strip(F.lower(x)), r"(?U)[^\w\s]", " "), r"(?U)\s+", " ")


def contains_any(x: Column, patterns: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in patterns]), lambda p: F.instr(F.lower(x), p) > 0)


def is_negative_question(x: Column) -> Column:
    return contains_any(x, NEGATIONS)


def is_multi_hop_question(x: Column) -> Column:
    return contains_any(x, MULTI_HOP)


def html_escape(x: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


def highlight(x: Column, marks: list[tuple[Column, str]], missing: str = "??") -> Column:
    """Escaped text in which phrases are wrapped in <mark class='...'>; marks: (phrase, class), earlier ones first.

    Phrases are looked for in the text as it is, from the left, and only where no earlier phrase is
    marked, so marks never overlap nor nest, and pieces are escaped last. Null or empty phrases mark
    nothing; a null or empty text is `missing`.
    """
    part = lambda text, kind: F.struct(text.alias("text"), F.lit(kind).cast("string").alias("kind"))

    def cut(phrase: Column, kind: str):
        literal = F.concat(F.lit("\\Q"), F.replace(phrase, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
        between = lambda p: F.transform(F.split(p["text"], literal), lambda t, i: F.when(i == 0, F.array(part(t, None))).otherwise(F.array(part(phrase, kind), part(t, None))))
        return lambda p: F.when(p["kind"].isNotNull(), F.array(p)).otherwise(F.flatten(between(p)))

    parts = F.array(part(x, None))
    for phrase, kind in marks:
        parts = F.when(F.coalesce(phrase, F.lit("")) == "", parts).otherwise(F.flatten(F.transform(parts, cut(phrase, kind))))
    shown = F.transform(parts, lambda p: F.when(p["kind"].isNull(), html_escape(p["text"])).otherwise(F.concat(F.lit("<mark class='"), p["kind"], F.lit("'>"), html_escape(p["text"]), F.lit("</mark>"))))
    return F.when(F.coalesce(x, F.lit("")) == "", F.lit(missing)).otherwise(F.array_join(shown, ""))


def locale_number(x: Column, digits: int = 2, missing: str = "??") -> Column:
    """1234.5 as 1.234,50; a missing value stays visible."""
    return F.coalesce(F.translate(F.format_number(x, digits), ",.", ".,"), F.lit(missing))


def p_value(p: Column, missing: str = "??") -> Column:
    return F.when(p.isNull(), missing).when(p < 0.001, "<0,001").otherwise(F.translate(F.format_number(p, 3), ".", ","))


def interval_text(low: Column, high: Column, digits: int = 2, missing: str = "??") -> Column:
    return F.when(low.isNull() | high.isNull(), missing).otherwise(F.concat(F.lit("["), locale_number(low, digits), F.lit("; "), locale_number(high, digits), F.lit("]")))


def heat(v: Column) -> Column:
    """Class 4 to 0 of a percentage; null has none."""
    return F.when(v >= 85, 4).when(v >= 60, 3).when(v >= 40, 2).when(v >= 20, 1).when(v.isNotNull(), 0)


def nfkc_md5(x: Column) -> Column:
    """md5 of the text in compatibility form, lower case, stripped; no built-in function normalises, so texts go by Arrow."""
    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hashlib.md5(unicodedata.normalize("NFKC", t).lower().strip().encode()).hexdigest(), na_action="ignore")

    return digest(x)


def ascii_fold(x: Column) -> Column:
    """Base letters only: marks go, and so does what has no ASCII form; unlike the older rule d with a stroke becomes d."""
    return F.regexp_replace(strip_diacritics(x), r"[^\x00-\x7F]", "")


def dig(row: Column, *path: str) -> Column:
    """A nested field; null where any part is."""
    for name in path:
        row = row[name]
    return row
