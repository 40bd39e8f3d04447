"""Scores of predicted answers as Column -> Column expressions over token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.functions import text as X

ERROR_CLASSES = ["false_answer", "false_abstain", "wrong_span", "boundary_superset", "boundary_subset", "boundary_overlap"]


def exact_match(p: Column, g: Column) -> Column:
    return (X.normalize_answer(p) == X.normalize_answer(g)).cast("double")


def common_tokens(p: Column, g: Column) -> Column:
    """Size of the multiset intersection of two token arrays."""
    count = lambda x, t: F.size(F.filter(x, lambda y: y == t))
    return F.aggregate(F.array_intersect(p, g), F.lit(0), lambda a, t: a + F.least(count(p, t), count(g, t)))


def f1_of_tokens(p: Column, g: Column) -> Column:
    """F1 of two token arrays as multisets; with an empty side 1 if both are empty, else 0."""

    def score(same: Column) -> Column:
        precision, recall = same / F.size(p), same / F.size(g)
        return F.when(same == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))

    return F.when((F.size(p) == 0) | (F.size(g) == 0), (F.size(p) == F.size(g)).cast("double")).otherwise(X.bound(common_tokens(p, g), score))


def token_f1(p: Column, g: Column) -> Column:
    return X.bound(F.struct(X.tokens(p).alias("p"), X.tokens(g).alias("g")), lambda x: f1_of_tokens(x["p"], x["g"]))


def golds_or_empty(golds: Column) -> Column:
    """The gold answers; an empty or null list stands for the empty answer."""
    return F.when(F.coalesce(F.size(golds), F.lit(0)) <= 0, F.array(F.lit(""))).otherwise(golds)


def best_over_golds(metric, p: Column, golds: Column) -> Column:
    return F.array_max(F.transform(golds_or_empty(golds), lambda g: metric(p, g)))


def best_gold(p: Column, golds: Column) -> Column:
    """struct<f1, ix, gold>: the gold answer with the best token F1, the first on ties."""
    scored = F.transform(golds_or_empty(golds), lambda g, k: F.struct(token_f1(p, g).alias("f1"), (-k).alias("ix"), g.alias("gold")))
    return F.array_max(scored)


def error_class(p: Column, golds: Column) -> Column:
    """Null for a right answer, else one of ERROR_CLASSES; supersets are by characters, as specified.

    No gold answers mean that the question has none; the gold with the best F1 decides, the first on ties.
    """

    def classed(x: Column) -> Column:
        pt, gt = x["p"], x["g"]
        ps, gs = F.concat_ws(" ", pt), F.concat_ws(" ", gt)
        return (
            F.when(ps == gs, F.lit(None).cast("string"))
            .when(F.coalesce(F.size(golds), F.lit(0)) <= 0, "false_answer")
            .when(F.size(pt) == 0, "false_abstain")
            .when(F.size(F.array_intersect(pt, gt)) == 0, "wrong_span")
            .when(F.instr(ps, gs) > 0, "boundary_superset")
            .when(F.instr(gs, ps) > 0, "boundary_subset")
            .otherwise("boundary_overlap")
        )

    right = best_over_golds(exact_match, p, golds) == 1.0
    pair = F.struct(X.tokens(p).alias("p"), X.tokens(best_gold(p, golds)["gold"]).alias("g"))
    return F.when(right, F.lit(None).cast("string")).otherwise(X.bound(pair, classed))


def abstained(p: Column, rule: str = "tokens") -> Column:
    """Whether a prediction is no answer: no tokens (default), only white space ('strip'), or '' ('raw')."""
    if rule == "tokens":
        return F.size(X.tokens(p)) == 0
    return (X.strip(F.coalesce(p, F.lit(""))) if rule == "strip" else F.coalesce(p, F.lit(""))) == ""


def legacy_error_class(question: Column, context: Column, gold: Column, p: Column, impossible: Column) -> Column:
    """struct<category, subtype> of the five-class analysis; rules apply in order."""
    g, q = X.strip(X.spaced_normalize(gold)), X.strip(X.spaced_normalize(p))
    words = lambda x: F.filter(F.split(x, " "), lambda t: t != "")
    n_context = F.size(F.filter(F.split(context, X.SPACE), lambda t: t != ""))

    def rules(x: Column) -> Column:
        g, q, gw, qw = x["g"], x["q"], x["gw"], x["qw"]
        share = F.size(F.array_intersect(gw, qw))
        ambiguous = (gold != p) & (F.size(gw) > 0) & (share / F.size(F.array_distinct(gw)) > 0.8)
        ends = (F.size(gw) > 1) & (F.size(qw) > 1) & ((F.get(gw, F.lit(0)) == F.get(qw, F.lit(0))) != (F.element_at(gw, F.lit(-1)) == F.element_at(qw, F.lit(-1))))
        boundary = (g != "") & (q != "") & (((g != q) & ((F.instr(q, g) > 0) | (F.instr(g, q) > 0))) | ends)
        prefix = (F.size(gw) > 0) & ~F.startswith(q, F.get(gw, F.lit(0)))
        suffix = (F.size(gw) > 0) & ~F.endswith(q, F.try_element_at(gw, F.lit(-1)))
        overlap = (F.size(gw) > 0) & (F.size(qw) > 0) & (share / F.greatest(F.size(F.array_distinct(gw)), F.size(F.array_distinct(qw))) > 0.3)
        out = lambda c, s: F.struct(F.lit(c).alias("category"), F.lit(s).alias("subtype"))
        return (
            F.when(ambiguous, out("E5", "ambiguous_ground_truth"))
            .when(~impossible & X.is_negative_question(question), out("E3", "negative_trap_failure"))
            .when(impossible, out("E3", "unanswerable_misclassified"))
            .when(boundary & prefix, out("E1", "boundary_prefix_missing"))
            .when(boundary & suffix, out("E1", "boundary_suffix_missing"))
            .when(boundary, out("E1", "boundary_partial"))
            .when(n_context > 256, out("E2", "context_overhead"))
            .when(X.is_multi_hop_question(question), out("E4", "multi_hop_reasoning_failure"))
            .when(overlap, out("E2", "partial_span_extraction"))
            .when(n_context > 200, out("E2", "long_context_error"))
            .otherwise(out("E4", "unknown_reasoning_error"))
        )

    return X.bound(F.struct(g.alias("g"), q.alias("q"), words(g).alias("gw"), words(q).alias("qw")), rules)
