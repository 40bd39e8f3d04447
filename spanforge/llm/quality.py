"""Operator 6: rule statistics of texts and robust multivariate outliers, in built-in expressions only.

Every statistic of a text is computed inside its row (array functions, no shuffle of texts). A
minimum-covariance-determinant estimate then describes the bulk of each source of a language, each
language and the whole table, in the six statistics of `transformed`, and a document goes if its
Mahalanobis distance from its source's bulk is beyond CUTOFF.

The estimate, per group: three deterministic starts (medians with equal spread, with the covariance of
squashed coordinates, with that of spatial signs) take two concentration steps each, the one with the
least determinant goes on until its determinant stays as it is, at most STEPS times. A step keeps the
SHARE of documents with the least distance and takes their mean and covariance anew; it is one
aggregation with partial sums over (group, start, distance bin), so a hot source costs no more than its
share of a scan. Equal vectors of a group (exact copies) count once, so that copies can't be the bulk.
A source's estimate is drawn towards its language's with the weight of PRIOR documents, and that towards
the whole table's; its covariance with fewer, none at all from small groups, which an outlier of
their own would stretch: there the language's covariance stands around the source's drawn mean. RIDGE adds a share of the group's own mean
variance; there is no absolute floor.

Edge cases: a null or empty text has no words and fails the base rules; null languages and sources are
groups of their own; without any usable document nothing is kept, since the base rules fail all; repeated
rows get equal verdicts; ties in distance fall in one bin and are taken together; a statistic without
any spread in the whole table is measured in its own unit; other columns pass through `screen`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.llm import common

SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Share of a group that its estimate rests on, steps at most, change of the determinant's logarithm, less in small groups, under
#: which they end, documents that a parent group's estimate weighs,
#: the ridge as a share of the mean variance, bins per unit of log(1 + distance).
SHARE, STEPS, SETTLED, PRIOR, RIDGE, BINS = 0.75, 10, 0.05, 60, 1e-2, 16
#: Chi-square tail beyond which a document is an outlier. Shares of short texts have heavier tails than the
#: normal law, so it is far out: 99.9 % of clean documents lie within a distance that the law gives 1e-10.
TAIL = 1e-12
#: Characters of words that are neither letters, marks of letters nor digits; capital letters.
MARK, CAPITAL = r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D]", r"\p{Lu}"
#: Characters of a short word; words of a run.
SHORT, RUN = 3, 50
P = 6
STARTS = 3
_Y, _M = [f"y{i}" for i in range(P)], [f"m{i}" for i in range(P)]
_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
_L, _C = [f"l{i}{j}" for i, j in _PAIRS], [f"c{i}{j}" for i, j in _PAIRS]


def base_statistics(text: Column) -> Column:
    """Struct of the BASE statistics, n_lines, n_short, variety, n_marks, n_capitals and base_failed, all for the whole text.

    Words are [^\\x20\\x09-\\x0D]+. Three-word windows are compared by 64-bit hashes within a text.
    """
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({common.WORD})"))

    def repeated(h: Column) -> Column:
        s = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def positions(s: Column) -> Column:
            twice = F.filter(s, lambda e, k: ((k > 0) & (F.get(s, k - 1)["x"] == e["x"])) | (F.coalesce(F.get(s, k + 1)["x"] == e["x"], F.lit(False))))
            start = F.struct(F.lit(0).alias("t"), F.lit(-1).alias("e"))
            step = lambda a, p: F.struct((a["t"] + p + 2 - F.greatest(p - 1, a["e"])).alias("t"), (p + 2).alias("e"))
            return F.aggregate(F.sort_array(F.transform(twice, lambda e: e["i"])), start, step, lambda a: a["t"])

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_bound(s, positions))

    def varied(h: Column) -> Column:
        """Mean share of distinct words in runs of RUN words; the last run ends with the text. A word's hash and its run are one number, so whole runs are counted at once."""
        n = F.size(h)
        whole = F.floor(n / RUN).cast("int")
        marked = F.transform(F.slice(h, F.lit(1), whole * RUN), lambda x, i: x.bitwiseXOR(F.shiftleft(F.floor(i / RUN).cast("long"), 20)))
        last = F.when(n == whole * RUN, F.lit(0)).otherwise(F.size(F.array_distinct(F.slice(h, F.greatest(n - (RUN - 1), F.lit(1)), F.lit(RUN)))))
        return (F.size(F.array_distinct(marked)) + last) / (RUN * F.greatest(F.ceil(n / RUN), F.lit(1)))

    def of_words(w: Column) -> Column:
        def hashed(h: Column) -> Column:
            grams = F.when(F.size(h) >= 3, F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - 3, F.lit(0))), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))).otherwise(F.array().cast("array<bigint>"))
            return F.struct(varied(h).alias("variety"), _bound(grams, repeated).cast("long").alias("n_repeat_words"))

        return _bound(F.transform(w, lambda x: F.xxhash64(x)), lambda h: _bound(hashed(h), lambda x: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), F.size(F.filter(w, lambda x: F.length(x) <= SHORT)).cast("long").alias("n_short"), x["variety"].alias("variety"), x["n_repeat_words"].alias("n_repeat_words"))))

    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(f"[^{common.WORD_SPACE}]"))
    of_lines = _bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")

    count = lambda pattern: F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")

    def all_of(w: Column) -> Column:
        failed = (w["n_words"] < 50) | (100 * w["n_repeat_words"] > 50 * w["n_words"])
        return _bound(of_lines, lambda x: F.struct(w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"), F.coalesce(symbols, F.lit(0)).cast("long").alias("n_symbols"), x["n_dup_lines"].alias("n_dup_lines"), w["n_repeat_words"].alias("n_repeat_words"), x["n_lines"].alias("n_lines"), w["n_short"].alias("n_short"), w["variety"].alias("variety"), count(MARK).alias("n_marks"), count(CAPITAL).alias("n_capitals"), failed.alias("base_failed")))

    return _bound(_bound(words, of_words), all_of)


def _bound(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def transformed(q: Column) -> list[Column]:
    """The vector: logs of mean word length and words a line, log odds of short words, of distinct ones in a run, and of marks and capitals among the words' characters.

    None of them grows with the text, so a long document is none of the outliers for its length.
    """
    one = F.lit(1)
    n, chars = F.greatest(q["n_words"], one), F.greatest(q["word_chars"], one)
    odds = lambda x, of: F.log((F.least(x, of) + 0.5) / (of - F.least(x, of) + 0.5))
    return [F.log(chars / n), F.log(n / F.greatest(q["n_lines"], one)), odds(q["n_short"], n), odds(q["variety"] * RUN, F.lit(RUN)), odds(q["n_marks"], chars), odds(q["n_capitals"], chars)]


def _chi2_tail(x: float, dof: int) -> float:
    """What lies beyond x, for an even number of degrees of freedom."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def chi2_beyond(tail: float, dof: int = P) -> float:
    """The distance that a share `tail` exceeds."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_tail(mid, dof) > tail else (low, mid)
    return high


CUTOFF = chi2_beyond(TAIL)
#: The variance of the SHARE nearest to the centre, under the normal law, times this is the variance of all.
CONSISTENT = SHARE / (1 - _chi2_tail(chi2_beyond(1 - SHARE), P + 2))


def _with_distance(rows: DataFrame, given: list[str]) -> DataFrame:
    """given columns and distance, the squared Mahalanobis distance of y0.. from m0.. by forward substitution in the factor l00..

    A column may name the ones before it in the same select, so this is one projection.
    """
    z = []
    for i in range(P):
        less = "".join(f" - l{i}{j} * z{j}" for j in range(i))
        z.append(f"(y{i} - m{i}{less}) / l{i}{i} as z{i}")
    out = rows.selectExpr(*given, *z, " + ".join(f"z{i} * z{i}" for i in range(P)) + " as distance")
    return out.select(*given, "distance")


def _factored(est: DataFrame, keys: list[str], ridge: float = RIDGE) -> DataFrame:
    """keys, means, covariances c00.., the Cholesky factor l00.. of these with their ridge, and logdet."""
    trace = " + ".join(f"c{i}{i}" for i in range(P))
    steps = [f"greatest(({trace}) / {P}, 1e-9D) * {ridge}D as ridge"]
    for i, j in _PAIRS:
        v = f"c{i}{j}" + (" + ridge" if i == j else "") + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        # the ridge is the least that a pivot can be, but for rounding
        steps.append(f"sqrt(greatest({v}, ridge / 2)) as l{i}{j}" if i == j else f"({v}) / l{j}{j} as l{i}{j}")
    logdet = " + ".join(f"ln(l{i}{i})" for i in range(P))
    return est.selectExpr(*keys, "n", *_M, *_C, *steps, f"2 * ({logdet}) as logdet").drop("ridge")


def group_keys(lang: Column, source: Column) -> list[Column]:
    """Keys of a row's groups: its source in its language, its language, the whole table."""
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return [F.concat(F.lit("s"), part(lang), part(source)), F.concat(F.lit("l"), part(lang)), F.lit("a")]


#: Bytes of estimates that are broadcast to the documents; more are joined by group, and adaptive execution splits large groups.
SMALL = 8 << 20


def _by_group(rows: DataFrame, table: DataFrame, on: str = "g", how: str = "inner") -> DataFrame:
    """Joins documents with a written table by group, whose size is checked; a source may have any share of the documents."""
    small = table.count() * 8 * len(table.columns) <= SMALL
    return rows.join(F.broadcast(table) if small else table, on, how)


_SUMS = [f"s{i}" for i in range(P)] + [f"q{i}{j}" for i, j in _PAIRS]
#: Sums over y0.., and means and covariances out of them.
_ADD = [f"sum(y{i}) as s{i}" for i in range(P)] + [f"sum(y{i} * y{j}) as q{i}{j}" for i, j in _PAIRS]
_MEANS = [f"s{i} / n as m{i}" for i in range(P)]


def _sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.expr("count(1) as n"), *[F.expr(x) for x in _ADD])


def _covariances(factor: float) -> list[str]:
    return [f"(q{i}{j} / n - s{i} * s{j} / (n * n)) * {factor}D as c{i}{j}" for i, j in _PAIRS]


def _concentrated(rows: DataFrame, est: DataFrame) -> DataFrame:
    """One concentration step of every (g, start) of est."""
    keys = ["g", "start"]
    near = _with_distance(_by_group(rows, est.select(*keys, *_M, *_L)), [*keys, *_Y])
    bins = _sums(near.selectExpr(*keys, *_Y, f"floor({BINS} * log1p(distance)) as bin"), [*keys, "bin"])
    group = "over (partition by g, start"
    used = bins.selectExpr("*", f"coalesce(sum(n) {group} order by bin rows between unbounded preceding and 1 preceding), 0) < {SHARE} * sum(n) {group}) as used").where("used")
    total = used.groupBy(*keys).agg(F.expr("sum(n) as n"), *[F.expr(f"sum({c}) as {c}") for c in _SUMS])
    return common.saved(_factored(total.selectExpr(*keys, "n", *_MEANS, *_covariances(CONSISTENT)), keys), "estimate")


def _starts(rows: DataFrame) -> DataFrame:
    """(g, start, means, factor): coordinate medians, with three first guesses of the scatter."""
    medians = common.saved(rows.groupBy("g").agg(*[F.expr(f"percentile_approx(y{i}, 0.5, 1000) as m{i}") for i in range(P)]), "medians")
    off = _by_group(rows, medians).selectExpr("g", *[f"y{i} - m{i} as d{i}" for i in range(P)])
    length = " + ".join(f"d{i} * d{i}" for i in range(P))
    squashed = ", ".join(f"tanh(d{i}) as y{i}" for i in range(P))
    signs = ", ".join(f"if(r > 0, d{i} / r, 0D) as y{i}" for i in range(P))
    both = off.selectExpr("*", f"sqrt({length}) as r").selectExpr("g", f"inline(array(struct(1 as start, {squashed}), struct(2 as start, {signs})))")
    scatter = _sums(both, ["g", "start"]).selectExpr("g", "start", "n", *_covariances(1.0))
    plain = medians.selectExpr("g", "0 as start", "0L as n", *[f"{float(i == j)}D as c{i}{j}" for i, j in _PAIRS])
    return common.saved(_factored(scatter.unionByName(plain).join(medians, "g"), ["g", "start"], 0.01), "estimate")


def fit(stats: DataFrame) -> tuple[list[tuple[float, float]], DataFrame]:
    """((centre, scale) of each coordinate, estimates by source) from rows of (lang, source, q) that pass the base rules."""
    passed = stats.where(~F.col("q.base_failed")).select("lang", "source", *[y.alias(f"y{i}") for i, y in enumerate(transformed(F.col("q")))])
    vectors = common.saved(passed.distinct(), "vectors")
    # two numbers a coordinate reach the driver
    middle = vectors.agg(*[F.percentile_approx(c, 0.5, 10000).alias(c) for c in _Y]).first()
    centre = [middle[c] or 0.0 for c in _Y]
    spread = vectors.agg(*[F.percentile_approx(F.abs(F.col(c) - m), 0.5, 10000).alias(c) for c, m in zip(_Y, centre, strict=True)]).first()
    unit = [(m, 1.4826 * spread[c] if spread[c] else 1.0) for m, c in zip(centre, _Y, strict=True)]
    rows = vectors.select(F.explode(F.array(*group_keys(F.col("lang"), F.col("source")))).alias("g"), *_standard(unit, [F.col(c) for c in _Y]))

    est = _starts(rows)
    for _ in range(2):
        est = _concentrated(rows, est)
    least = est.groupBy("g").agg(F.min(F.struct("logdet", "start")).alias("b")).select("g", F.col("b.start").alias("start"))
    est = common.saved(est.join(least, ["g", "start"]), "estimate")
    for _ in range(STEPS - 2):
        new = _concentrated(rows, est)
        moved = new.join(est.select("g", F.col("logdet").alias("old")), "g").agg(F.expr(f"max(abs(logdet - old) * n / (n + {PRIOR})) as x")).first()["x"]
        est = new
        if not moved or moved < SETTLED:
            break
    return unit, common.saved(_shrunk(est, vectors), "estimate")


def _standard(unit: list[tuple[float, float]], y: list[Column]) -> list[Column]:
    return [((v - m) / s).alias(c) for v, (m, s), c in zip(y, unit, _Y, strict=True)]


def _shrunk(est: DataFrame, vectors: DataFrame) -> DataFrame:
    """(g, means, factor) of each source, drawn towards its language and that towards the whole table.

    Of a group's covariance only the documents beyond 2 * (P + 1) count, among those that its estimate rests on: a
    few documents can't tell their scatter from an outlier among them.
    """
    sizes = vectors.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("k"))
    keys = group_keys(F.col("lang"), F.col("source"))
    sizes = sizes.select(*[x.alias(f"g{i}") for i, x in enumerate(keys)], "k", F.sum("k").over(Window.partitionBy(keys[1])).alias("k1"))

    def level(i: int) -> DataFrame:
        return est.select(F.col("g").alias(f"g{i}"), *[F.col(c).alias(f"{c}_{i}") for c in (*_M, *_C)])

    x = sizes.join(level(0), "g0").join(level(1), "g1").join(level(2), "g2")
    drawn = lambda own, k, parent: f"({own} * {k} + {parent} * {PRIOR}) / ({k} + {PRIOR})"
    spare = lambda k: f"greatest({SHARE} * {k} - {2 * (P + 1)}, 0)"
    centre = [drawn(f"{c}_0", "k", drawn(f"{c}_1", "k1", f"{c}_2")) + f" as {c}" for c in _M]
    scatter = [drawn(f"{c}_0", spare("k"), drawn(f"{c}_1", spare("k1"), f"{c}_2")) + f" as {c}" for c in _C]
    return _factored(x.selectExpr("g0 as g", "k as n", *centre, *scatter), ["g"])


def verdicts(stats: DataFrame, model: tuple[list[tuple[float, float]], DataFrame]) -> DataFrame:
    """stats with distance (squared) and kept: the base rules pass and the distance is within the cut-off."""
    unit, est = model
    given = stats.columns
    own = est.select(F.col("g").alias("e_key"), *_M, *_L)
    rows = stats.select(F.struct(*given).alias("given"), F.col("q.base_failed").alias("failed"), group_keys(F.col("lang"), F.col("source"))[0].alias("e_key"), *_standard(unit, transformed(F.col("q"))))
    rows = _with_distance(_by_group(rows, own, "e_key", "left"), ["given", "failed"]).selectExpr("given.*", "if(failed, null, distance) as distance")
    kept = ~F.col("q.base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(False))
    return rows.select(*given, "distance", kept.alias("kept"))


def rate(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance); distance is null where the base rules fail."""
    stats = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), base_statistics(F.col("text").cast("string")).alias("q"))
    stats = common.saved(stats, "quality")
    rated = verdicts(stats, fit(stats))
    return rated.select("doc_id", *[F.col(f"q.{c}").alias(c) for c in BASE], F.col("q.base_failed").alias("base_failed"), "kept", "distance")


def screen(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns. What passes the base rules is written once, with its statistics."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    stats = docs.select(row, F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), base_statistics(F.col("text").cast("string")).alias("q"))
    stats = common.saved(stats.where("not q.base_failed"), "quality")
    return verdicts(stats, fit(stats.drop("row"))).where("kept").select("row.*")
