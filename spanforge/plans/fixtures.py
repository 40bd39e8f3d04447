"""Views over the driver's tables that stand in for a question-answering corpus and its results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.functions import text as X


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def examples(spark: SparkSession, d: str) -> DataFrame:
    """User turns as questions and the replies as contexts; each third conversation has no answers."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("nrole"), F.lead("text").over(w).alias("context"))
    t = t.where("role = 'user' and nrole = 'assistant'")
    impossible = F.col("conv_id") % 3 == 0
    first = F.slice(X.sentences(F.col("context")), 1, 1)
    t = t.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"),
        F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("qid"), F.col("text").alias("question"), "context",
        F.concat(F.lit("c"), "conv_id").alias("title"),
        F.when(impossible, F.array().cast("array<string>")).otherwise(first).alias("answers"), impossible.alias("is_impossible"), "turn",
    )
    start = F.when(F.size("answers") > 0, F.instr("context", F.get("answers", F.lit(0))) - 1).otherwise(-1)
    return t.withColumn("answer_start", start)


SYSTEMS = ("abstain", "first_sentence", "first3", "two_sentences", "last_sentence", "gated")


def predictions(ex: DataFrame) -> DataFrame:
    """(system, qid, prediction) of deterministic systems that make every class of error; one scan for all."""
    s = X.sentences(F.col("context"))
    first = F.coalesce(F.get(s, F.lit(0)), F.lit(""))
    answer = {
        "abstain": F.lit(""), "first_sentence": first,
        "first3": F.concat_ws(" ", F.slice(X.tokens(first), 1, 3)),
        "two_sentences": F.concat_ws(" ", F.slice(s, 1, 2)),
        "last_sentence": F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit("")),
        "gated": F.when(F.col("turn") % 4 == 0, first).otherwise(""),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("system"), answer[k].alias("prediction")) for k in SYSTEMS])
    return ex.select("qid", F.explode(rows).alias("x")).select("x.system", "qid", "x.prediction")


#: Inner words of a passage that anchor it in documents, and anchors that are looked for inside the row.
ANCHOR, IN_ROW = 5, 4096


def located(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, item_id, context, answer, answer_start) of each benchmark passage in each document.

    A passage's first and last word may be glued to something in a document; the words between them
    can't. The first few of these, hashed, are compared with the documents' windows of as many words, inside the row
    if the anchors are few, else by an equi-join; places that match are then verified. Passages without an inner
    word have no anchor: these are looked for as they are.
    """
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("answer")).where("length(answer) > 0")
    words = lambda x: F.filter(F.split(x, r"[ \n\r\t]+"), lambda t: t != "")
    doc = table(spark, d, "documents").select("doc_id", F.col("text").alias("context")).where("context is not null")
    joined = lambda w: F.xxhash64(F.concat_ws(" ", w))
    b = b.withColumn("inner", words(F.col("answer"))).withColumn("n", F.least(F.lit(ANCHOR), F.greatest(F.size("inner") - 2, F.lit(0))))
    anchors = b.where("n > 0").select("item_id", "answer", "n", joined(F.slice("inner", F.lit(2), F.col("n"))).alias("h"))
    sizes = [r.n for r in anchors.select("n").distinct().collect()]  # ANCHOR numbers at most
    found = []
    if sizes:
        window = lambda w, n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + (k - 1)) for k in range(n)])))
        grams = X.bound(words(F.col("context")), lambda w: F.array_distinct(F.concat(*[window(w, n) for n in sizes])))
        if anchors.count() <= IN_ROW:
            wanted = anchors.agg(F.collect_set("h").alias("wanted"))  # one row of at most IN_ROW numbers
            hits = doc.crossJoin(F.broadcast(wanted)).select("doc_id", "context", F.array_intersect(grams, "wanted").alias("h")).where("size(h) > 0")
        else:
            hits = doc.select("doc_id", "context", grams.alias("h"))
        pairs = hits.select("doc_id", F.explode("h").alias("h")).join(anchors, "h").select("doc_id", "item_id", "answer").distinct()
        found.append(pairs.join(doc, "doc_id"))
    short = b.where("n = 0").select("item_id", "answer")
    if not short.isEmpty():
        found.append(doc.join(short, F.col("context").contains(F.col("answer"))))
    if not found:
        return doc.select("doc_id", F.lit(None).cast("bigint").alias("item_id"), "context", F.lit("").alias("answer"), F.lit(0).alias("answer_start")).where("false")
    out = found[0].select("doc_id", "item_id", "context", "answer")
    for more in found[1:]:
        out = out.unionByName(more.select("doc_id", "item_id", "context", "answer"))
    return out.withColumn("answer_start", F.instr("context", F.col("answer")) - 1).where("answer_start >= 0")


def paired(spark: SparkSession, d: str) -> DataFrame:
    """(qid, em_a, em_b, cluster): two systems' hits per labelled document."""
    doc = table(spark, d, "documents").select("doc_id", F.col("source").alias("cluster"))
    return table(spark, d, "labels").join(doc, "doc_id").select(F.col("doc_id").alias("qid"), (F.col("quality") == 1).cast("double").alias("em_a"), (F.col("toxic") == 0).cast("double").alias("em_b"), "cluster")


def logits(spark: SparkSession, d: str) -> DataFrame:
    """(qid, window_ix, starts, ends, offsets): logits of each window; eight tokens of a question, context, four of a
    separator and padding. Two tokens share a word's place, as the pieces of a word do."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    w = Window.partitionBy("label").orderBy("vec_id")
    place = lambda v, k: F.when((k >= 8) & (k < 60), F.struct((F.floor(k / 2) * 5).cast("int").alias("s"), (F.floor(k / 2) * 5 + 4).cast("int").alias("e")))
    return table(spark, d, "embeddings").where("embedding is not null").select(F.col("label").alias("qid"), F.row_number().over(w).alias("window_ix"), e.alias("starts"), F.reverse(e).alias("ends"), F.transform("embedding", place).alias("offsets"))


def steps(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("event_type").alias("run"), F.row_number().over(w).cast("bigint").alias("step"), F.col("value").alias("loss"), (F.col("event_id") % 3 == 0).alias("is_cls"))


def curves(spark: SparkSession, d: str) -> DataFrame:
    """(run, epoch, train_loss, val_em, val_f1) by day of the month."""
    v, e = F.col("value"), table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("run"), F.dayofmonth("ts").alias("epoch")).agg(
        F.round(F.avg(v), 6).alias("train_loss"), F.round(F.avg((v % 7) * 10), 6).alias("val_em"), F.round(F.avg((v % 11) * 10), 6).alias("val_f1"))


def splits(spark: SparkSession, d: str, fraction: float = 0.2) -> DataFrame:
    """documents with their split: a fifth of the contexts, and the contexts of copies twice, as a planted leak."""
    doc = table(spark, d, "documents").select("doc_id", F.col("text").alias("context"), "source", "lang")
    from spanforge.operators import dataset

    split = dataset.split_by_key(doc, "context", fraction)
    copies = doc.groupBy("context").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("doc_id")).where("n > 1").select("doc_id")
    leak = split.join(copies, "doc_id", "left_semi").withColumn("split", F.when(F.col("split") == "train", "validation").otherwise("train"))
    return split.unionByName(leak)


def reviews(spark: SparkSession, d: str) -> DataFrame:
    verdict = lambda c: F.when(c, "ok").otherwise("loai")
    return table(spark, d, "labels").select(F.col("doc_id").alias("qid"), verdict(F.col("quality") == 1).alias("nguoi_1"), verdict(F.col("toxic") == 0).alias("nguoi_2"))
