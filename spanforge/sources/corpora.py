"""Readers and writers of nested corpora, stress sets, review sheets, step logs and result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge import schemas
from spanforge.operators import threshold


def read_nested(spark: SparkSession, path: str) -> DataFrame:
    """A nested question-answering file or folder, by its explicit schema."""
    return spark.read.schema(schemas.NESTED).option("multiLine", True).json(path)


def articles_of(nested: DataFrame) -> DataFrame:
    """(a_ix, article) of documents that were read as a whole."""
    return nested.select(F.posexplode("data").alias("a_ix", "article"))


def _questions(articles: DataFrame) -> DataFrame:
    """One row (ord, title, context, q) per question; its own ord, or else its place."""
    p = articles.select("a_ix", F.coalesce("article.title", F.lit("")).alias("title"), F.posexplode("article.paragraphs").alias("p_ix", "p"))
    q = p.select("a_ix", "p_ix", "title", F.coalesce("p.context", F.lit("")).alias("context"), F.posexplode("p.qas").alias("q_ix", "q"))
    order = F.when(F.col("q.ord").isNull(), (F.col("a_ix").cast("bigint") * 1_000_000 + F.col("p_ix")) * 1_000_000 + F.col("q_ix")).otherwise(F.col("q.ord"))
    return q.select(order.alias("ord"), "title", "context", "q")


def flatten(articles: DataFrame) -> DataFrame:
    """One row per question, in input order as ord, of articles or of whole documents; missing parts are empty.

    Empty gold texts are dropped; the offset is the first given one, even if its text was dropped, as
    specified; impossible questions have no answers. plausible is never gold.
    """
    q = _questions(articles if "article" in articles.columns else articles_of(articles))
    impossible = F.coalesce("q.is_impossible", F.lit(False))
    none = F.array().cast("array<string>")
    given = F.coalesce(F.filter("q.answers.text", lambda t: t != ""), none)
    gold = F.when(impossible, none).otherwise(given)
    start = F.when(~impossible & (F.size(gold) > 0), F.coalesce(F.get("q.answers.answer_start", F.lit(0)), F.lit(-1))).otherwise(-1)
    return q.select("ord", F.col("q.id").alias("qid"), F.col("q.question").alias("question"), "context", "title", gold.alias("answers"), start.alias("answer_start"), impossible.alias("is_impossible"),
                    F.coalesce("q.plausible_answers.text", none).alias("plausible"), F.coalesce("q.plausible_answers.answer_start", F.array().cast("array<int>")).alias("plausible_start"))


def nested_articles(examples: DataFrame) -> DataFrame:
    """(first_ord, article) with one row per article: paragraphs and questions in the order of their first question.

    Examples bring answer_start, or answer_starts with one offset per answer; stress items also bring their
    category, subset, role, source_qid, pair_id and note, which become each question's `stress`. Only answers,
    plausible answers and notes that are there are written.
    """
    have = set(examples.columns)
    n = F.size("answers")
    one = F.when(n > 0, F.array_repeat(F.col("answer_start").cast("int"), n)).otherwise(F.array().cast("array<int>")) if "answer_start" in have else None
    starts = F.transform("answer_starts", lambda x: x.cast("int")) if "answer_starts" in have else one
    impossible = F.col("is_impossible") if "is_impossible" in have else n <= 0
    parts = [F.col("ord").cast("bigint").alias("ord"), F.col("qid").alias("id"), "question", impossible.alias("is_impossible"), F.struct(F.col("answers").alias("text"), starts.alias("answer_start")).alias("answers")]
    if "plausible" in have:
        at = F.col("plausible_start") if "plausible_start" in have else F.array().cast("array<int>")
        parts.append(F.when(F.size("plausible") > 0, F.struct(F.col("plausible").alias("text"), at.alias("answer_start"))).alias("plausible_answers"))
    notes = [c for c in ("category", "subset", "role", "source_qid", "pair_id", "note") if c in have]
    if "role" in have:
        parts.append(F.struct(*notes).alias("stress"))
    inner = lambda x, f: F.transform(F.array_sort(x), lambda e: e[f])
    paragraphs = examples.groupBy("title", "context").agg(F.min("ord").alias("ord"), inner(F.collect_list(F.struct("ord", "qid", F.struct(*parts).alias("qa"))), "qa").alias("qas"))
    articles = paragraphs.groupBy("title").agg(F.min("ord").cast("bigint").alias("first_ord"), inner(F.collect_list(F.struct("ord", "context", F.struct("context", "qas").alias("p"))), "p").alias("paragraphs"))
    return articles.select("first_ord", F.struct("first_ord", "title", "paragraphs").alias("article"))


def placed(articles: DataFrame) -> DataFrame:
    """Adds place: the rank of an article by its first_ord, 1 for the first; counted over quantile buckets, then inside them."""
    at = articles.groupBy("first_ord").agg(F.count(F.lit(1)).alias("n"))
    at = threshold.running_sums(at.withColumn("place", F.col("n")), "first_ord", ["place"])
    return articles.join(at.select("first_ord", (F.col("place") - F.col("n") + 1).alias("place")), "first_ord")


def write_nested(examples: DataFrame, path: str, header: dict | None = None) -> None:
    """Writes one JSON document as the pieces of a folder: a line with the header, one line per article, a closing line.

    Articles are ranged by their first question, so the files in the order of their names, put together,
    are the document; no row holds more than one article. Sets of any size are written in parallel.
    """
    import json

    spark = examples.sparkSession
    first = examples.agg(F.min("ord")).first()[0]
    lines = nested_articles(examples).select(F.lit(1).alias("part"), "first_ord", F.concat(F.when(F.col("first_ord") == F.lit(first), "").otherwise(","), F.to_json("article")).alias("value"))
    begin = json.dumps(header or {"version": "1.0"}, ensure_ascii=False)[:-1]
    edge = lambda k, text: spark.range(1).select(F.lit(k).alias("part"), F.lit(0).cast("bigint").alias("first_ord"), F.lit(text).alias("value"))
    ends = edge(0, begin + (", " if len(begin) > 1 else "") + '"data": [').unionByName(edge(2, "]}"))
    lines.unionByName(ends).orderBy("part", "first_ord").select("value").write.text(path)


def read_pieces(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """((a_ix, article), header) of a folder that write_nested made, an article at a time; a_ix is null, the questions have their order."""
    import json

    lines = spark.read.text(path)
    heads = lines.where(F.col("value").startswith("{") & F.col("value").endswith('"data": [')).first()
    articles = lines.where(F.col("value").rlike(r'^,?\{"first_ord"')).select(F.lit(None).cast("int").alias("a_ix"), F.from_json(F.regexp_replace("value", "^,", ""), schemas.ARTICLE).alias("article"))
    header = json.loads(heads[0] + "]}") if heads else {}
    header.pop("data", None)
    return articles, header


def stress_examples(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(examples, meta) of a nested stress set: answers as they are given, and each question's `stress`."""
    q = _questions(articles if "article" in articles.columns else articles_of(articles))
    answers = F.coalesce("q.answers.text", F.array().cast("array<string>"))
    starts = F.coalesce("q.answers.answer_start", F.array().cast("array<int>"))
    examples = q.select("ord", F.col("q.id").alias("qid"), F.col("q.question").alias("question"), "context", "title", answers.alias("answers"), F.when(F.size(answers) > 0, F.get(starts, F.lit(0))).otherwise(-1).alias("answer_start"), F.coalesce("q.is_impossible", F.lit(False)).alias("is_impossible"), starts.alias("answer_starts"))
    return examples, q.select(F.col("q.id").alias("qid"), "q.stress.*")


def read_stress(spark: SparkSession, path: str, schema=None) -> tuple[DataFrame, DataFrame]:
    """(examples, meta) of a flat stress set in JSON lines; meta has one row per question."""
    rows = spark.read.schema(schema or schemas.STRESS).json(path)
    examples = rows.select("qid", "question", "context", "title", "answers", F.coalesce(F.get("answer_starts", F.lit(0)), F.lit(-1)).alias("answer_start"), (F.size("answers") <= 0).alias("is_impossible"))
    return examples, rows.select("qid", "category", "subset", "role", "source_qid", "pair_id", "note")


def read_reviews(spark: SparkSession, path: str | None) -> DataFrame:
    """Review sheet by question; no sheet is an empty one."""
    if path is None:
        return spark.createDataFrame([], schemas.REVIEW)
    return spark.read.schema(schemas.REVIEW).option("header", True).option("multiLine", True).csv(path)


def with_verdicts(items: DataFrame, earlier: DataFrame) -> DataFrame:
    """A new review sheet that keeps the verdicts of an earlier one; answers joined by ' | '."""
    old = earlier.select("qid", "nguoi_1", "nguoi_2", "ghi_chu")
    new = items.select("qid", "subset", F.col("question").alias("cau_hoi"), F.concat_ws(" | ", "answers").alias("dap_an_goc"), F.col("note").alias("thay_doi"), F.col("context").alias("context_moi"))
    blank = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("nguoi_1", "nguoi_2", "ghi_chu")]
    return new.join(old, "qid", "left").select("qid", "subset", "cau_hoi", "dap_an_goc", "thay_doi", "context_moi", *blank)


def load_legacy(rows: DataFrame, defaults: dict[str, object] | None = None) -> DataFrame:
    """Checks that required columns are there and fills optional ones."""
    missing = {"id", "question", "context"} - set(rows.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    for name, value in (defaults or {"title": "", "is_impossible": False}).items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(value))
    return rows


def union_categories(sets: dict[str, DataFrame]) -> DataFrame:
    """All category sets under one another, with their name as `category`."""
    out = None
    for name, rows in sorted(sets.items()):
        rows = rows.withColumn("category", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sets")
    return out


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_steps(rows: DataFrame, path: str) -> None:
    """Appends to a step log of JSON lines."""
    rows.write.mode("append").json(path)


def read_steps(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).schema(schemas.STEPS).json(path)


def keep_first(examples: DataFrame) -> DataFrame:
    """First row of each (context, stripped lower-case question), by ord."""
    key = Window.partitionBy(F.xxhash64("context"), "context", F.lower(F.trim("question"))).orderBy("ord")
    return examples.withColumn("k", F.row_number().over(key)).where("k = 1").drop("k")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_result(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """A JSON result table by its path, None where there is none; `text.dig` reads its nested fields."""
    if not _exists(spark, path):
        return None
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_legacy_predictions(spark: SparkSession, predictions: str, references: str, contexts: DataFrame | None = None) -> DataFrame:
    """(qid, prediction, confidence, golds, is_impossible, question, context) of the older JSON lists of predictions and
    references, for questions that both have; contexts (qid, context) go before those of the references. What is missing is empty, false or 0."""
    p = spark.read.schema(schemas.LEGACY_PREDICTIONS).option("multiLine", True).json(predictions)
    r = spark.read.schema(schemas.LEGACY_REFERENCES).option("multiLine", True).json(references)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    p = p.select(F.col("id").alias("qid"), text("prediction_text").alias("prediction"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    r = r.select(F.col("id").alias("qid"), F.coalesce("answers.text", F.array().cast("array<string>")).alias("golds"), F.coalesce("is_impossible", F.lit(False)).alias("is_impossible"), text("question").alias("question"), text("context").alias("context"))
    out = p.join(r, "qid")
    if contexts is None:
        return out
    given = contexts.select("qid", F.col("context").alias("given"))
    return out.join(given, "qid", "left").withColumn("context", F.coalesce("given", "context")).drop("given")


def read_config(spark: SparkSession, path: str) -> dict:
    """A small JSON document beside a model; {} where there is none."""
    if not _exists(spark, path):
        return {}
    import json

    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def write_config(spark: SparkSession, config: dict, path: str) -> None:
    import json

    spark.createDataFrame([(json.dumps(config, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)
