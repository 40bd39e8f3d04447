"""Stress sets: slices, perturbations, assembly, audit and paired scores.

Examples here have context, question, title, answers, answer_start, is_impossible, qid and ord.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.functions import text as X
from spanforge.operators import dataset, spans

# Subset sizes (None takes all), the cap per context, and the offset of late answers.
SIZES: dict[str, int | None] = {"E1a": None, "E1b": 100, "E2a": 80, "E2b": 80, "E2c": 100, "E3a": 100, "E3b": 100, "E4": 120, "E5": 150}
PER_CONTEXT, LATE = 2, 180
# Entities of one kind that may stand for one another.
ENTITIES = {
    "place": ["Paris", "Nouvelle-Calédonie", "Canada", "Puerto Rico", "Nam Ossetia", "Mông Cổ", "Montréal", "Uganda", "Texas", "Brasil", "Ai Cập", "Na Uy", "Chile", "Ontario", "Kenya", "Bavaria"],
    "person": ["François Mitterrand", "Mahatma Gandhi", "Franklin D. Roosevelt", "Winston Churchill", "Charles de Gaulle", "Jawaharlal Nehru"],
}
# Units before a number and the largest number that stays valid.
UNITS = {"ngày": 28, "tháng": 12, "thế kỷ": 21, "thế kỉ": 21}
LATEST_YEAR = 2024


def is_answerable() -> Column:
    """Whether the first answer stands at its offset."""
    a = F.get("answers", F.lit(0))
    return ~F.col("is_impossible") & (F.size("answers") > 0) & (F.col("answer_start") >= 0) & (F.substring("context", F.col("answer_start") + 1, F.length(a)) == a)


def answerable(examples: DataFrame) -> DataFrame:
    return examples.where(is_answerable())


def _remains(text: Column, answers: Column) -> Column:
    """Whether an answer still stands in a text, as it is or normalised as whole words."""
    norm = F.concat(F.lit(" "), X.normalize_answer(text), F.lit(" "))
    return X.bound(norm, lambda n: F.exists(answers, lambda a: (F.instr(text, a) > 0) | ((X.normalize_answer(a) != "") & (F.instr(n, F.concat(F.lit(" "), X.normalize_answer(a), F.lit(" "))) > 0))))


def removed_sentence(examples: DataFrame) -> DataFrame:
    """Adds new_context and removed: the answer's sentence taken out; rows where that isn't safe are left out.

    Safe: three sentences or more, the first answer inside one, and no answer in what is left.
    """
    c, start = F.col("context"), F.col("answer_start")
    last = start + F.length(F.get("answers", F.lit(0))) - 1

    def cut(sp: Column) -> Column:
        rest = lambda x: F.regexp_replace(F.substring(c, x["e"] + 1, F.length(c)), r"(?U)^[\s\x1c-\x1f]+", "")
        one = lambda x: F.struct(X.strip(F.concat(F.substring(c, F.lit(1), x["s"]), rest(x))).alias("new_context"), F.substring(c, x["s"] + 1, x["e"] - x["s"]).alias("removed"))
        around = F.filter(sp, lambda x: (x["s"] <= start) & (start < x["e"]) & (x["s"] <= last) & (last < x["e"]))
        return F.transform(F.when(F.size(sp) >= 3, F.slice(around, 1, 1)), one)

    # a generator is computed once a row; filters would repeat the sentences' long expression
    return answerable(examples).select("*", F.inline(F.filter(X.bound(X.sentence_spans(c), cut), lambda x: ~_remains(x["new_context"], F.col("answers")))))


def lexical_gap(examples: DataFrame) -> DataFrame:
    """Adds gap: the answer's sentence is none of those that share most words with the question."""
    q = F.array_distinct(X.tokens(F.col("question")))
    shared = lambda sp: X.bound(q, lambda qq: F.transform(sp, lambda s: F.size(F.array_intersect(qq, X.tokens(F.substring(F.col("context"), s["s"] + 1, s["e"] - s["s"]))))))
    r = examples.withColumn("spans", X.sentence_spans(F.col("context")))
    r = r.withColumns({"i": X.sentence_index(F.col("spans"), F.col("answer_start")), "n": shared(F.col("spans"))})
    gap = ~F.col("is_impossible") & (F.col("answer_start") >= 0) & (F.size("spans") >= 2) & F.col("i").isNotNull() & (F.array_max("n") > F.get("n", F.col("i")))
    return r.withColumn("gap", F.coalesce(gap, F.lit(False))).drop("spans", "i", "n")


def words_before_answer() -> Column:
    return F.size(F.filter(F.split(F.substring("context", F.lit(1), F.col("answer_start")), X.SPACE), lambda t: t != ""))


def late_answers(examples: DataFrame, after: int = LATE) -> DataFrame:
    return answerable(examples).where(words_before_answer() > after)


def number_rich(examples: DataFrame, others: int = 3) -> DataFrame:
    """The first answer has a number, and the context has enough others."""
    mine = X.numbers(F.array_join("answers", " "))
    rest = F.array_except(F.array_distinct(X.numbers(F.col("context"))), mine)
    return answerable(examples).where(F.get("answers", F.lit(0)).rlike(r"\d") & (F.size(rest) >= others))


def misaligned(aligned: DataFrame) -> DataFrame:
    return aligned.where("aligned = false")


def compound_edges(aligned: DataFrame) -> DataFrame:
    """Aligned answers that begin or end with a capitalised compound."""
    end = F.col("answer_start") + F.length(F.get("answers", F.lit(0))["text"])
    inside = F.filter("words", lambda w: (w["s"] < end) & (w["e"] > F.col("answer_start")))
    named = lambda w: w["tok"].contains("_") & w["tok"].rlike(r"^\p{Lu}")
    return aligned.where(F.col("aligned") & X.bound(inside, lambda x: (F.size(x) > 0) & (named(F.get(x, F.lit(0))) | named(F.try_element_at(x, F.lit(-1))))))


def unaccented(examples: DataFrame) -> DataFrame:
    """Adds plain_question; questions without diacritics are left out."""
    return examples.withColumn("plain_question", X.strip_diacritics(F.col("question"))).where("plain_question <> question")


def _number(key: Column, n: int) -> Column:
    """A draw from 0 .. n - 1 by hash."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def shifted_numbers(text: Column, seed: Column) -> Column:
    """Every number changed but still valid in its place: days, months and centuries stay in range, years move
    by 3 to 40 and not beyond the latest, other numbers change digit by digit and keep their shape."""
    unit = "|".join(UNITS)
    parts = F.regexp_extract_all(text, F.lit(rf"((?i)(?:\b(?:{unit})\s+)?\d+(?:[.,]\d+)*|(?s).)"))

    def changed(p: Column, i: Column) -> Column:
        num = F.regexp_extract(p, r"(\d+(?:[.,]\d+)*)$", 1)
        name = F.lower(F.trim(F.regexp_replace(p, r"\d+(?:[.,]\d+)*$", "")))
        key = F.concat_ws(":", seed.cast("string"), i.cast("string"), num)
        limit = F.lit(None).cast("int")
        for u, hi in UNITS.items():
            limit = F.when(name == u, hi).otherwise(limit)
        plain = num.rlike(r"^\d{1,9}$")
        v = F.when(plain, F.try_to_number(num, F.lit("999999999"))).cast("int")
        small = F.when(v.between(1, limit), F.lit(1) + F.pmod(v - 1 + 1 + F.pmod(F.xxhash64(key), limit - 1), limit)).otherwise(F.lit(1) + F.pmod(F.xxhash64(key), limit)).cast("int").cast("string")
        delta = 3 + _number(F.concat(key, F.lit(":d")), 38)
        year = F.when((v + delta > LATEST_YEAR) | (_number(F.concat(key, F.lit(":s")), 2) == 0), v - delta).otherwise(v + delta).cast("string")
        digit = lambda c, k: F.when(c.rlike(r"\d"), F.pmod(c.cast("int") + 1 + F.pmod(F.xxhash64(key, k), F.lit(8)), F.lit(10)).cast("string")).otherwise(c)
        chars = F.when(num != "", F.split(num, "")).otherwise(F.array().cast("array<string>"))
        turned = F.array_join(F.transform(chars, digit), "")
        turned = F.when(turned.startswith("0") & (F.length(F.regexp_replace(turned, r"\D", "")) > 1), F.concat((1 + _number(key, 9)).cast("string"), F.substring(turned, F.lit(2), F.length(turned)))).otherwise(turned)
        new = F.when(limit.isNotNull() & plain, small).when(num.rlike(r"^\d{4}$") & v.between(1000, 2100), year).otherwise(turned)
        return F.when(num == "", p).otherwise(F.concat(F.regexp_replace(p, r"\d+(?:[.,]\d+)*$", ""), new))

    return F.array_join(F.transform(parts, changed), "")


def distractors(examples: DataFrame, entities: dict[str, list[str]] | None = None, seed: int = 42) -> DataFrame:
    """Adds fake, new_context and new_start: the answer's sentence with another entity and other numbers, before or after the context.

    Only for titles that are a known entity and stand in the question and in the answer's sentence,
    and answers with a digit; a fake that holds an answer is left out.
    """
    entities = entities or ENTITIES
    kinds = F.create_map(*[F.lit(x) for k, names in entities.items() for n in names for x in (n, k)])
    peers = F.create_map(*[x for k, names in entities.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in names]))])
    a, c, title, start = F.get("answers", F.lit(0)), F.col("context"), F.col("title"), F.col("answer_start")
    able = is_answerable() & kinds[title].isNotNull() & a.rlike(r"\d") & (F.instr(a, title) == 0) & (F.instr("question", title) > 0)
    free = F.filter(peers[kinds[title]], lambda t: (t != title) & (F.instr(c, t) == 0) & (F.instr(t, title) == 0) & (F.instr(title, t) == 0))
    pick = X.bound(free, lambda f: F.when(F.size(f) > 0, F.get(f, F.pmod(F.xxhash64("qid", F.lit(seed)), F.size(f)).cast("int"))))

    def sentence(sp: Column) -> Column:
        around = F.slice(F.filter(sp, lambda x: (x["s"] <= start) & (start < x["e"])), 1, 1)
        return F.filter(F.transform(around, lambda x: F.substring(c, x["s"] + 1, x["e"] - x["s"])), lambda t: F.instr(t, title) > 0)

    def fakes(name: Column) -> Column:
        fake = lambda t: F.struct(t.alias("sentence"), shifted_numbers(F.replace(t, title, name), F.concat(F.lit(f"{seed}:"), "qid")).alias("fake"))
        made = F.transform(X.bound(X.sentence_spans(c), sentence), fake)
        good = F.filter(made, lambda x: (x["fake"] != x["sentence"]) & ~F.exists("answers", lambda y: F.instr(x["fake"], y) > 0))
        return F.when(able & name.isNotNull(), F.transform(good, lambda x: F.struct(x["fake"].alias("fake"), a.alias("_a"), start.alias("_at"))))

    # a generator is computed once a row; filters would repeat the sentences' and the answers' long expressions
    r = examples.select("*", F.inline(X.bound(pick, fakes)))
    after = F.pmod(F.xxhash64("qid", F.lit(seed), F.lit("side")), F.lit(2)) == 0
    tail = F.regexp_replace("context", r"(?U)[\s\x1c-\x1f]+$", "")
    r = r.withColumns({"new_context": F.when(after, F.concat_ws(" ", tail, "fake")).otherwise(F.concat_ws(" ", "fake", "context")), "new_start": F.when(after, F.col("_at")).otherwise(F.col("_at") + F.length("fake") + 1)})
    return r.where(F.substring("new_context", F.col("new_start") + 1, F.length("_a")) == F.col("_a")).drop("_a", "_at")


def capped_sample(pool: DataFrame, n: int | None, subset: str, seed: int = 42, per_context: int = PER_CONTEXT) -> DataFrame:
    """At most per_context rows of a context and n in all, the first in the subset's own seeded order; adds k from 0."""
    order = dataset.draw(F.col("qid"), f"{seed}-{subset}")
    r = pool.withColumn("draw", order)
    r = r.withColumn("c", F.row_number().over(Window.partitionBy(F.xxhash64("context"), "context").orderBy("draw", "qid"))).where(F.col("c") <= per_context).drop("c")
    if n is None:
        return dataset.first_by_draw(r, F.col("n"), "k").withColumn("k", F.col("k") - 1).drop("draw")
    r = dataset.first_by_draw(r, F.lit(n))  # then n rows are left to number
    return r.withColumn("k", F.row_number().over(Window.orderBy("draw", "qid")) - 1).drop("draw")


def items(pool: DataFrame, subset: str, role: str = "slice", twins: bool = False) -> DataFrame:
    """Stress items s2-<subset>-<k> of a capped pool, with their originals (-orig) if twins.

    Perturbed pools bring new_question, new_context, new_answers or note as columns; what is missing is taken as it is.
    new_starts are the answers' places, where they aren't the first ones in the context.
    """
    have = set(pool.columns)
    col = lambda new, old: F.col(new) if new in have else F.col(old)
    qid = F.format_string(f"s2-{subset}-%04d", "k")
    shared = [F.col("title"), F.lit(subset[:2]).alias("category"), F.lit(subset).alias("subset")]
    starts = lambda c, a: F.transform(a, lambda x: F.instr(c, x) - 1)
    main = pool.select(qid.alias("qid"), col("new_question", "question").alias("question"), col("new_context", "context").alias("context"), *shared, col("new_answers", "answers").alias("answers"), (F.col("new_starts") if "new_starts" in have else starts(col("new_context", "context"), col("new_answers", "answers"))).alias("answer_starts"), F.lit(role).alias("role"), F.col("qid").alias("source_qid"), (qid if twins else F.lit(None).cast("string")).alias("pair_id"), (F.col("note") if "note" in have else F.lit("")).alias("note"))
    if not twins:
        return main
    twin = pool.select(F.concat(qid, F.lit("-orig")).alias("qid"), "question", "context", *shared, "answers", starts(F.col("context"), F.col("answers")).alias("answer_starts"), F.lit("original").alias("role"), F.col("qid").alias("source_qid"), qid.alias("pair_id"), F.lit("").alias("note"))
    return main.unionByName(twin)


def build(examples: DataFrame, sizes: dict[str, int | None] | None = None, seed: int = 42) -> DataFrame:
    """All subsets: E1a, E1b, E2a, E2b, E2c, E3a, E3b, E4 and E5. Examples bring the words of their contexts too, for E1."""
    size = SIZES | (sizes or {})
    at = {"texts": F.col("answers"), "new_starts": X.locate_all(F.col("context"), F.col("answers"), F.col("answer_start")), "answers": X.located(F.col("context"), F.col("answers"), F.col("answer_start"))}
    aligned = spans.boundary_alignment(answerable(examples).withColumns(at))
    words_off = lambda pool: pool.select("qid", "question", "context", "title", F.col("texts").alias("answers"), "new_starts")
    examples = examples.drop("words")
    good = answerable(examples)
    none = F.array().cast("array<string>")
    cap = lambda pool, s: capped_sample(pool, size[s], s, seed)
    slices = {"E1a": words_off(misaligned(aligned)), "E1b": words_off(compound_edges(aligned)), "E2a": late_answers(examples), "E2b": number_rich(examples), "E3a": examples.where("is_impossible"), "E4": lexical_gap(good).where("gap")}
    # The words that begin a note, part of the set's format; `audit` reads them.
    e3b = removed_sentence(examples).withColumns({"new_answers": none, "note": F.concat(F.lit("câu đã xoá: "), "removed")})
    e2c = distractors(examples, seed=seed).withColumn("note", F.concat(F.lit("câu nhiễu: "), "fake"))
    usable = good.select("qid").unionByName(examples.where("is_impossible").select("qid"))
    e5 = unaccented(examples).join(usable, "qid", "left_semi").withColumns({"new_question": F.col("plain_question"), "note": F.concat(F.lit("câu hỏi gốc: "), "question")})
    parts = [items(cap(pool, s), s) for s, pool in slices.items()]
    parts += [items(cap(pool, s), s, "perturbed", True) for s, pool in (("E2c", e2c), ("E3b", e3b), ("E5", e5))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def audit(stress: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """(qid, reason) of every violated rule; none for a valid set."""
    bad = F.exists(F.arrays_zip("answers", "answer_starts"), lambda x: (x["answer_starts"] < 0) | (F.substring(F.col("context"), x["answer_starts"] + 1, F.length(x["answers"])) != x["answers"]))
    perturbed = F.col("role") == "perturbed"
    rules = {
        "offsets don't match answers": F.size("answers") != F.size("answer_starts"),
        "wrong offset": (F.size("answers") > 0) & bad,
        "no note of the removed sentence": (F.col("subset") == "E3b") & perturbed & ~F.col("note").startswith("câu đã xoá: "),
        "question keeps diacritics": (F.col("subset") == "E5") & perturbed & (X.strip_diacritics(F.col("question")) != F.col("question")),
        "distractor holds an answer": (F.col("subset") == "E2c") & perturbed & F.exists("answers", lambda a: F.instr(F.regexp_replace(F.col("note"), "^câu nhiễu: ", ""), a) > 0),
    }
    each = F.array_compact(F.array(*[F.when(cond, F.lit(why)) for why, cond in rules.items()]))
    found = stress.select("qid", F.explode(each).alias("reason"))
    e3b = stress.where((F.col("subset") == "E3b") & perturbed).select("qid", "context")
    twins = stress.where("role = 'original'").select(F.regexp_replace("qid", "-orig$", "").alias("twin_of"), F.col("answers").alias("gold"))
    pair = e3b.join(twins, e3b["qid"] == twins["twin_of"], "left")
    found = found.unionByName(pair.where("gold is null").select("qid", F.lit("no original").alias("reason")))
    found = found.unionByName(pair.where(F.col("gold").isNotNull() & _remains(F.col("context"), F.col("gold"))).select("qid", F.lit("an answer remains").alias("reason")))
    if train is not None:
        t = train.select(F.col("context").alias("tc")).distinct()
        found = found.unionByName(stress.join(t, stress["context"] == t["tc"], "left_semi").select("qid", F.lit("context is in train").alias("reason")))
    return found


def subset_stats(stress: DataFrame, by: str = "subset") -> DataFrame:
    """Counts per subset: items without originals, their answers, and distinct contexts, titles and questions; max_per_context is the largest number on one context."""
    main, none = F.col("role") != "original", F.size("answers") <= 0
    per = stress.where(main).groupBy(by, F.md5("context").alias("context")).agg(F.count(F.lit(1)).alias("c")).groupBy(by).agg(F.max("c").alias("max_per_context"), F.count(F.lit(1)).alias("n_contexts"))
    s = stress.groupBy(by).agg(F.count_if(main).alias("n_items"), F.count_if(~main).alias("n_twins"), F.count_if(main & ~none).alias("n_answerable"), F.count_if(main & none).alias("n_impossible"), F.countDistinct(F.when(main, F.col("title"))).alias("n_titles"), F.countDistinct(F.when(main, F.col("question"))).alias("n_questions"))
    return s.join(per, by, "left")


def category_stats(stress: DataFrame) -> DataFrame:
    """Per category, without originals: items, answers, and the score of a system that always abstains, null without items."""
    main, none = F.col("role") != "original", F.size("answers") <= 0
    c = stress.groupBy("category").agg(F.count_if(main).alias("n_items"), F.count_if(~main).alias("n_twins"), F.count_if(main & ~none).alias("n_answerable"), F.count_if(main & none).alias("n_impossible"))
    return c.withColumn("always_abstain_em", F.round(F.try_divide(100.0 * F.col("n_impossible"), F.col("n_items")), 2))


def audit_totals(stress: DataFrame, violations: DataFrame, most: int = 50) -> DataFrame:
    """One row: items (originals included), answers, distinct contexts and source questions, violations and the first of them by question and reason."""
    none = F.size("answers") <= 0
    t = stress.agg(F.count(F.lit(1)).alias("n_items"), F.count_if(~none).alias("n_answerable"), F.count_if(none).alias("n_impossible"), F.countDistinct(F.md5("context")).alias("n_contexts"), F.countDistinct("source_qid").alias("n_source_questions"))
    line = F.concat_ws(": ", "qid", "reason")
    first = violations.orderBy("qid", "reason").limit(most).agg(F.array_sort(F.collect_list(line)).alias("violations"))  # a report of the first ones
    return t.crossJoin(violations.agg(F.count(F.lit(1)).alias("n_violations"))).crossJoin(first)  # one row each


def ordered(stress: DataFrame) -> DataFrame:
    """Adds ord: by subset, number and original, as their ids say."""
    place = F.array_position(F.array(*map(F.lit, SIZES)), F.col("subset"))
    number = F.regexp_extract("qid", r"^s2-\w+-(\d+)", 1).cast("bigint")
    return stress.withColumn("ord", (place * 10**12 + number * 2 + (F.col("role") == "original").cast("bigint")).cast("bigint"))


def pair_report(scored: DataFrame) -> DataFrame:
    """Per system and subset, from rows with em, f1, role and pair_id: scores without originals, and pairs that
    stay right, break or mend; broken_pct is of the originals that were right, null if none was."""
    main = scored.where("role <> 'original'")
    s = main.groupBy("system", "subset").agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg("em"), 2).alias("em"), F.round(100 * F.avg("f1"), 2).alias("f1"))
    o = scored.where("role = 'original'").select("system", "subset", "pair_id", F.col("em").alias("o"))
    p = main.where("pair_id is not null").join(o, ["system", "subset", "pair_id"])
    right, was = F.col("em") == 1, F.col("o") == 1
    p = p.groupBy("system", "subset").agg(F.count_if(was & right).alias("both_correct"), F.count_if(was & ~right).alias("broken"), F.count_if(~was & right).alias("fixed"))
    return s.join(p, ["system", "subset"], "left").withColumn("broken_pct", F.round(F.try_divide(100.0 * F.col("broken"), F.col("both_correct") + F.col("broken")), 2))


def with_words(rows: DataFrame) -> DataFrame:
    """Adds words: white-space words of the context joined in pairs."""
    return rows.withColumn("w", spans.words_of(F.col("context"))).withColumn("words", spans.joined_words(F.col("w"))).drop("w")
