"""The registered queries over the driver's tables, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import metrics as M
from spanforge.functions import text as X
from spanforge.operators import dataset, diagnosis, eda, features, report, resampling, retrieval, scoring, siblings, spans, stress, threshold, training
from spanforge.plans import fixtures as fx
from spanforge.plans import sql as S
from spanforge.runtime import new_path, saved
from spanforge.sources import corpora

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _docs(s, d):
    return fx.table(s, d, "documents")


def _items(s, d):
    ex = fx.examples(s, d)
    return scoring.score_items(fx.predictions(ex).join(ex.select("qid", "question", "context", "title", "turn", F.col("answers").alias("golds")), "qid"))


# text


@query(f"SELECT doc_id, md5({S.norm('text')}) AS digest FROM documents")
def normalize_text(s, d):
    return _docs(s, d).select("doc_id", F.md5(X.normalize_answer(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, len({S.tok('text')})::BIGINT AS n_tokens, len(list_distinct({S.tok('text')}))::BIGINT AS n_distinct FROM documents")
def tokenize_counts(s, d):
    n = X.bound(X.tokens(F.col("text")), lambda t: F.struct(F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct")))
    return _docs(s, d).select("doc_id", n.alias("x")).select("doc_id", "x.*")


@query("SELECT doc_id, md5(translate(strip_accents(text),'đĐ','dD')) AS digest FROM documents")
def strip_diacritics(s, d):
    return _docs(s, d).select("doc_id", F.md5(X.strip_diacritics(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, len({S.sent('text')})::BIGINT AS n, md5(array_to_string({S.sent('text')},'|')) AS digest FROM documents")
def split_sentences(s, d):
    return _docs(s, d).select("doc_id", X.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.concat_ws("|", "s")).alias("digest"))


@query(rf"""WITH x AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text,'[.!?]+|\n'), lambda z: {S.trim('z')}), lambda z: length(z)>5) AS s FROM documents)
SELECT doc_id, len(s)::BIGINT AS n, md5(array_to_string(s,'|')) AS digest FROM x""")
def legacy_sentences(s, d):
    return _docs(s, d).select("doc_id", X.legacy_sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.concat_ws("|", "s")).alias("digest"))


@query(r"SELECT doc_id, len(x)::BIGINT AS n, array_to_string(x,' ') AS numbers FROM (SELECT doc_id, regexp_extract_all(text,'\d+(?:[.,]\d+)*') AS x FROM documents)")
def numbers_extract(s, d):
    return _docs(s, d).select("doc_id", X.numbers(F.col("text")).alias("x")).select("doc_id", F.size("x").cast("long").alias("n"), F.concat_ws(" ", "x").alias("numbers"))


@query(f"SELECT doc_id, md5({S.legacy_norm('text')}) AS digest FROM documents")
def legacy_normalize(s, d):
    return _docs(s, d).select("doc_id", F.md5(X.legacy_normalize(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, {S.any_of('text', X.NEGATIONS)} AS negative, {S.any_of('text', X.MULTI_HOP)} AS multi_hop FROM documents")
def keyword_flags(s, d):
    return _docs(s, d).select("doc_id", X.is_negative_question(F.col("text")).alias("negative"), X.is_multi_hop_question(F.col("text")).alias("multi_hop"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html,'&','&amp;'),'<','&lt;'),'>','&gt;'),'\"','&quot;'),'''','&#x27;')) AS digest FROM pages")
def html_escape(s, d):
    return fx.table(s, d, "pages").select("page_id", F.md5(X.html_escape(F.col("html"))).alias("digest"))


@query(f"""{S.WITH_EX} SELECT CASE WHEN n<100 THEN '<100' WHEN n<=200 THEN '100-200' WHEN n<=300 THEN '200-300' ELSE '300+' END AS length_bucket, count(*) AS n
FROM (SELECT len({S.words('context')}) AS n FROM ex) GROUP BY 1""")
def length_bucket_counts(s, d):
    return scoring.tags(fx.examples(s, d)).groupBy("length_bucket").agg(F.count(F.lit(1)).alias("n"))


_QTYPE = f"""{S.EX}, qt0 AS (SELECT qid, list_distinct({S.tok('question')}) AS q, {S.sent('context')} AS s FROM ex),
qt AS (SELECT qid, CASE WHEN len(q)=0 OR len(s)<=1 OR list_max(list_transform(s, lambda z: len(list_intersect(q,list_distinct({S.tok('z')})))::DOUBLE/len(q)))>=0.6 THEN 'single_sentence' ELSE 'multi_sentence' END AS question_type FROM qt0)"""


@query(f"WITH {_QTYPE} SELECT qid, question_type FROM qt")
def question_type(s, d):
    return fx.examples(s, d).select("qid", X.question_type(F.col("question"), F.col("context")).alias("question_type"))


@query(f"{S.WITH_EX} SELECT qid, {S.question_class('question')} AS question_class FROM ex")
def question_word_class(s, d):
    return fx.examples(s, d).select("qid", X.question_word_class(F.col("question")).alias("question_class"))


@query(f"WITH {S.LOCATED} SELECT doc_id, item_id, answer_start::BIGINT AS answer_start FROM loc")
def locate_answers(s, d):
    r = fx.located(s, d)
    return r.select("doc_id", "item_id", X.locate(F.col("context"), F.col("answer"), F.lit(-1)).cast("long").alias("answer_start"))


@query(f"WITH {S.LOCATED} SELECT doc_id, item_id, md5(answer) AS digest, length(answer)::BIGINT AS n FROM loc")
def slice_spans(s, d):
    cut = X.slice_text(F.col("context"), F.col("answer_start"), F.col("answer_start") + F.length("answer"))
    return fx.located(s, d).select("doc_id", "item_id", F.md5(cut).alias("digest"), F.length(cut).cast("long").alias("n"))


@query(rf"""WITH {S.LOCATED} SELECT doc_id, item_id, (len(string_split({S.boundary_marks('substr(context,1,(answer_start+1)::BIGINT)')},chr(1)))-1)::BIGINT AS sentence FROM loc""")
def answer_sentence_index(s, d):
    r = fx.located(s, d).withColumn("spans", X.sentence_spans(F.col("context")))
    return r.select("doc_id", "item_id", X.sentence_index(F.col("spans"), F.col("answer_start")).cast("long").alias("sentence"))


# corpora


@query(f"{S.WITH_EX} SELECT qid, title, md5(context) AS context_md5, len(answers)::BIGINT AS n_answers, CASE WHEN len(answers)>0 THEN answer_start ELSE -1 END::BIGINT AS answer_start, is_impossible FROM ex")
def flatten_nested(s, d):
    """Through the pieces of a written document."""
    path = new_path(s, "nested")
    corpora.write_nested(fx.examples(s, d), path)
    flat = corpora.flatten(corpora.read_pieces(s, path)[0])
    return flat.select("qid", "title", F.md5("context").alias("context_md5"), F.size("answers").cast("long").alias("n_answers"), F.col("answer_start").cast("long").alias("answer_start"), "is_impossible")


@query(f"{S.WITH_EX} SELECT title, count(DISTINCT context) AS n_paragraphs, count(*) AS n_questions, rank() OVER (ORDER BY min(ord)) AS place FROM ex GROUP BY title")
def renest_corpus(s, d):
    a = corpora.nested_articles(fx.examples(s, d))
    a = a.select("article.title", F.size("article.paragraphs").cast("long").alias("n_paragraphs"), F.aggregate("article.paragraphs", F.lit(0).cast("long"), lambda x, p: x + F.size(p["qas"])).alias("n_questions"), "first_ord")
    return corpora.placed(saved(a, "articles")).drop("first_ord")


@query(f"""{S.WITH_EX} SELECT qid, md5(question) AS question_md5, md5(context) AS context_md5, title, 2*len(answers)::BIGINT AS n_answers, CASE WHEN len(answers)>0 THEN answer_start||','||answer_start ELSE '' END AS starts, is_impossible, 'E'||(ord%5) AS category,
CASE WHEN ord%3=0 THEN 'original' ELSE 'slice' END AS role, CASE WHEN ord%2=0 THEN qid END AS pair_id, 'note "'||turn||'"' AS note FROM ex""")
def nested_stress_set(s, d):
    """A stress set with two answers a question, written as the pieces of a nested document and read back with its notes."""
    ex, path = fx.examples(s, d), new_path(s, "nested")
    at = F.transform("answers", lambda a: F.col("answer_start"))
    items = ex.select("ord", "qid", "question", "context", "title", F.concat("answers", "answers").alias("answers"), F.concat(at, at).alias("answer_starts"), F.format_string("E%d", F.col("ord") % 5).alias("category"), F.lit("E").alias("subset"), F.when(F.col("ord") % 3 == 0, "original").otherwise("slice").alias("role"), F.col("qid").alias("source_qid"), F.when(F.col("ord") % 2 == 0, F.col("qid")).alias("pair_id"), F.format_string('note "%d"', "turn").alias("note"))
    corpora.write_nested(items, path, {"version": "stress", "categories": {"E1": "one"}})
    read, meta = corpora.stress_examples(corpora.read_pieces(s, path)[0])
    return read.join(meta, "qid").select("qid", F.md5("question").alias("question_md5"), F.md5("context").alias("context_md5"), "title", F.size("answers").cast("long").alias("n_answers"), F.concat_ws(",", F.col("answer_starts").cast("array<string>")).alias("starts"), "is_impossible", "category", "role", "pair_id", "note")


@query(f"{S.WITH_EX} SELECT count(*) AS n, count(*) FILTER (len(answers)>0 OR is_impossible) AS n_gradeable, count(*) FILTER (is_impossible AND len(answers)>0) AS n_inconsistent FROM ex")
def gradeable_gate(s, d):
    return fx.examples(s, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(dataset.is_gradeable()).alias("n_gradeable"), F.count_if(F.col("is_impossible") & (F.size("answers") > 0)).alias("n_inconsistent"))


@query(f"{S.WITH_EX} SELECT qid, coalesce(array_to_string(answers,'|'),'') AS golds FROM ex")
def references(s, d):
    return dataset.references(fx.examples(s, d)).select("qid", F.concat_ws("|", "golds").alias("golds"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text, lower(trim(source)) ORDER BY doc_id) AS k FROM documents) WHERE k=1")
def dedup_keep_first(s, d):
    r = _docs(s, d).select("doc_id", F.col("text").alias("context"), F.col("source").alias("question"), F.col("doc_id").alias("ord"))
    return corpora.keep_first(r).select("doc_id")


@query(f"WITH {S.SPLITS} SELECT doc_id, split FROM sp0")
def context_split(s, d):
    return dataset.split_by_key(_docs(s, d).select("doc_id", F.col("text").alias("context")), "context").select("doc_id", "split")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:'||doc_id)) AS k FROM documents) WHERE k<=100")
def seeded_sample(s, d):
    return dataset.seeded_sample(_docs(s, d).select("doc_id"), "doc_id", 100)


@query(f"WITH {S.SPLITS} SELECT md5(context) AS context_md5, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM spl GROUP BY md5(context) HAVING count(DISTINCT split)>1")
def leakage_shared_contexts(s, d):
    return dataset.shared_contexts(fx.splits(s, d))


@query(f"WITH {S.SPLITS} SELECT doc_id FROM spl WHERE split='train' AND context NOT IN (SELECT context FROM spl WHERE split='validation')")
def anti_leak_filter(s, d):
    r = fx.splits(s, d)
    return dataset.without_contexts_of(r.where("split = 'train'"), r.where("split = 'validation'")).select("doc_id")


_OVERLAP = f"{S.SPLITS}, ov AS (SELECT kind, key, count(*) AS n_rows, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM (SELECT split, 'context' AS kind, md5(context) AS key FROM spl UNION ALL SELECT split, 'id', doc_id::VARCHAR FROM spl) GROUP BY 1,2 HAVING count(DISTINCT split)>1)"


def _overlap(s, d):
    return dataset.cross_split_overlap(fx.splits(s, d), [("context", F.md5("context")), ("id", F.col("doc_id"))])


@query(f"WITH {_OVERLAP} SELECT * FROM ov")
def cross_split_overlap(s, d):
    return _overlap(s, d)


@query(f"WITH {_OVERLAP} SELECT n AS n_overlaps, CASE WHEN n=0 THEN 'clean' WHEN n<5 THEN 'low' WHEN n<50 THEN 'medium' ELSE 'high' END AS severity FROM (SELECT count(*) AS n FROM ov)")
def leakage_severity(s, d):
    return dataset.leakage_severity(_overlap(s, d))


@query(f"WITH {S.SPLITS} SELECT split, count(*) AS n, count(*) FILTER (lang='en') AS n_flagged, round(avg((lang='en')::INT::DOUBLE),6) AS ratio FROM spl GROUP BY 1")
def distribution_shift(s, d):
    return dataset.distribution_shift(fx.splits(s, d), F.col("lang") == "en")


@query(f"""{S.WITH_EX} SELECT count(*) AS n_questions, count(DISTINCT context) AS n_contexts, count(DISTINCT title) AS n_titles, count(*) FILTER (is_impossible) AS n_impossible, count(*) FILTER (len(answers)>0) AS n_with_gold,
count(*) FILTER (len(answers)>0 OR is_impossible) AS n_gradeable, round(100.0*count(*) FILTER (is_impossible)/count(*),2)::DOUBLE AS impossible_pct FROM ex""")
def split_stats(s, d):
    return dataset.split_stats(fx.examples(s, d))


@query(rf"""WITH {S.SPLITS}, c AS (SELECT context, md5(context) AS id, list_sort(list(DISTINCT split)) AS sp, {S.words("lower(trim(context))")} AS w FROM spl GROUP BY context),
g AS (SELECT id, sp, list_distinct(list_transform(range(1,greatest(len(w)-4,1)+1), lambda i: array_to_string(w[i:i+4],' '))) AS sh FROM c), u AS (SELECT id, sp, len(sh) AS n, unnest(sh) AS s FROM g),
j AS (SELECT a.id AS context_a, b.id AS context_b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM u a JOIN u b ON a.s=b.s AND a.id<b.id WHERE len(list_distinct(list_concat(a.sp,b.sp)))>1 GROUP BY 1,2)
SELECT context_a, context_b, round(k::DOUBLE/(na+nb-k),6) AS jaccard FROM j WHERE round(k::DOUBLE/(na+nb-k),6)>=0.8""")
def near_duplicates_minhash(s, d):
    return dataset.near_duplicate_contexts(fx.splits(s, d))


# scores


@query(f"{S.SCORED} SELECT system, qid, em FROM items")
def exact_match(s, d):
    return _items(s, d).select("system", "qid", "em")


@query(f"{S.SCORED} SELECT system, qid, round(f1,9) AS f1 FROM items")
def token_f1(s, d):
    return _items(s, d).select("system", "qid", F.round("f1", 9).alias("f1"))


_TWO_GOLDS = f"""{S.EX}, {S.PRED}, tg AS (SELECT system, qid, {S.tok('prediction')} AS p, {S.tok('question')} AS g1, {S.tok('context')} AS g2 FROM pred JOIN ex USING (qid))"""


@query(f"WITH {_TWO_GOLDS} SELECT system, qid, round(greatest({S.f1('p', 'g1')},{S.f1('p', 'g2')}),9) AS f1 FROM tg")
def max_over_golds(s, d):
    ex = fx.examples(s, d).select("qid", F.array("question", "context").alias("golds"))
    return scoring.score_items(fx.predictions(fx.examples(s, d)).join(ex, "qid")).select("system", "qid", F.round("f1", 9).alias("f1"))


_AGG = "count(*) AS n, round(100*avg(em),6) AS em, round(100*avg(f1),6) AS f1"


@query(f"""{S.SCORED} SELECT system, {_AGG}, count(*) FILTER (NOT is_impossible) AS n_answerable, round(coalesce(100*avg(em) FILTER (NOT is_impossible),0),6) AS em_answerable, round(coalesce(100*avg(f1) FILTER (NOT is_impossible),0),6) AS f1_answerable,
count(*) FILTER (is_impossible) AS n_impossible, round(coalesce(100*avg(em) FILTER (is_impossible),0),6) AS em_impossible, round(coalesce(100*avg(f1) FILTER (is_impossible),0),6) AS f1_impossible FROM items GROUP BY 1""")
def corpus_scores(s, d):
    return scoring.corpus_scores(_items(s, d))


_BUCKET = f"CASE WHEN n_w<100 THEN '<100' WHEN n_w<=200 THEN '100-200' WHEN n_w<=300 THEN '200-300' ELSE '300+' END"


@query(f"{S.SCORED} SELECT system, {_BUCKET} AS length_bucket, count(*) AS n, round(100*avg(em),4) AS em, round(100*avg(f1),4) AS f1, count(*)<30 AS unreliable FROM (SELECT *, len({S.words('context')}) AS n_w FROM items) GROUP BY 1,2")
def scores_by_length(s, d):
    return scoring.breakdown(_items(s, d), scoring.tags(fx.examples(s, d)), "length_bucket")


@query(f"WITH {_QTYPE}, {S.PRED}, {S.ITEMS} SELECT system, question_type, count(*) AS n, round(100*avg(em),4) AS em, round(100*avg(f1),4) AS f1, count(*)<30 AS unreliable FROM items JOIN qt USING (qid) WHERE NOT is_impossible GROUP BY 1,2")
def scores_by_question_type(s, d):
    return scoring.breakdown(_items(s, d), scoring.tags(fx.examples(s, d)), "question_type")


_DIM = " UNION ALL ".join(f"SELECT system, '{k}' AS dimension, {v} AS value, em, f1 FROM items" for k, v in (("question_class", S.question_class("question")), ("impossible", "is_impossible::VARCHAR"), ("turn", "turn::VARCHAR"), ("all", "'all'")))


@query(f"{S.SCORED} SELECT system, dimension, value, count(*) AS n, round(100*avg(em),4) AS em, round(100*avg(f1),4) AS f1 FROM ({_DIM}) GROUP BY 1,2,3")
def scores_by_dimension(s, d):
    return scoring.by_dimension(_items(s, d), {"question_class": X.question_word_class(F.col("question")), "impossible": F.col("is_impossible"), "turn": F.col("turn")})


_ERRORS = " UNION ALL ".join(f"SELECT '{e}' AS error" for e in M.ERROR_CLASSES)


@query(f"{S.SCORED} SELECT s.system, e.error, count(c.qid) AS n, round(coalesce(100.0*count(c.qid)/nullif(t.k,0),0),2)::DOUBLE AS pct FROM (SELECT DISTINCT system FROM items) s CROSS JOIN ({_ERRORS}) e LEFT JOIN cls c ON c.system=s.system AND c.error=e.error JOIN (SELECT system, count(error) AS k FROM cls GROUP BY 1) t ON t.system=s.system GROUP BY 1,2,t.k")
def error_taxonomy(s, d):
    return diagnosis.error_taxonomy(_items(s, d))


@query(f"{S.SCORED} SELECT system, count(error) AS n_errors, round(100.0*count(error)/count(*),4)::DOUBLE AS pct_wrong, count(*) FILTER (error LIKE 'boundary%') AS n_boundary FROM cls GROUP BY 1")
def error_pct(s, d):
    c = diagnosis.classified(_items(s, d))
    return c.groupBy("system").agg(F.count("error").alias("n_errors"), F.round(100.0 * F.count("error") / F.count(F.lit(1)), 4).alias("pct_wrong"), F.count_if(F.col("error").startswith("boundary")).alias("n_boundary"))


@query(f"""{S.SCORED}, ab AS (SELECT system, count(*) FILTER (len(p)=0 AND len(golds)=0) AS tp, count(*) FILTER (len(p)=0 AND len(golds)>0) AS fp, count(*) FILTER (len(p)>0 AND len(golds)=0) AS fn, count(*) FILTER (len(p)>0 AND len(golds)>0) AS tn FROM items GROUP BY 1),
r AS (SELECT *, coalesce(tp::DOUBLE/nullif(tp+fp,0),0) AS pp, coalesce(tp::DOUBLE/nullif(tp+fn,0),0) AS rr FROM ab)
SELECT system, tp, fp, fn, tn, round(100.0*(tp+fp)/(tp+fp+fn+tn),2)::DOUBLE AS abstain_rate, round(100*pp,2) AS precision, round(100*rr,2) AS recall, round(100*coalesce(2*pp*rr/nullif(pp+rr,0),0),2) AS f1 FROM r""")
def abstention_confusion(s, d):
    return diagnosis.abstention(_items(s, d))


@query(f"""{S.SCORED} SELECT system, slice, count(*) FILTER (hit) AS n, round(100*avg(em) FILTER (hit),6) AS em, round(100*avg(f1) FILTER (hit),6) AS f1 FROM (
SELECT system, em, f1, unnest(['answerable','impossible','long_answer','none']) AS slice, unnest([NOT is_impossible, is_impossible, len(g)>10, false]) AS hit FROM items) GROUP BY 1,2""")
def slice_scores(s, d):
    long = F.size(X.tokens(F.coalesce(F.get("golds", F.lit(0)), F.lit("")))) > 10
    return scoring.slice_scores(_items(s, d), {"answerable": ~F.col("is_impossible"), "impossible": F.col("is_impossible"), "long_answer": long, "none": F.lit(False)})


_PT = "count(*) AS n, count(*) FILTER (em_a>=.5 AND em_b>=.5) AS n_both, count(*) FILTER (em_a>=.5 AND em_b<.5) AS n_only_a, count(*) FILTER (em_a<.5 AND em_b>=.5) AS n_only_b, count(*) FILTER (em_a<.5 AND em_b<.5) AS n_neither"


@query(f"WITH {S.PAIRED} SELECT cluster, {_PT}, round(100*(avg(em_a)-avg(em_b)),6) AS diff FROM pr GROUP BY 1")
def paired_table(s, d):
    return diagnosis.paired_table(fx.paired(s, d), ["cluster"])


@query(f"""{S.SCORED}, a AS (SELECT * FROM cls WHERE system='first3'), b AS (SELECT * FROM cls WHERE system='two_sentences')
SELECT a.qid, CASE WHEN a.em>b.em THEN 'first3' ELSE 'two_sentences' END AS winner, CASE WHEN coalesce(a.error,b.error) LIKE 'boundary%' THEN 'boundary' ELSE coalesce(a.error,b.error) END AS kind, a.prediction AS prediction_a, b.prediction AS prediction_b FROM a JOIN b USING (qid) WHERE a.em<>b.em""")
def disagreements(s, d):
    return diagnosis.disagreements(_items(s, d), "first3", "two_sentences")


@query(f"""{S.SCORED}, r AS (SELECT system, qid, em FROM items WHERE NOT is_impossible AND prediction<>'')
SELECT a.system AS system_a, b.system AS system_b, count(*) AS n, round(100*avg(a.em),6) AS em_a, round(100*avg(b.em),6) AS em_b FROM r a JOIN r b ON a.qid=b.qid AND a.system<b.system GROUP BY 1,2""")
def both_answered(s, d):
    return diagnosis.both_answered(_items(s, d))


@query(f"WITH {S.PAIRED} SELECT {_PT}, round(100*(avg(em_a)-avg(em_b)),6) AS diff FROM pr")
def mcnemar_inputs(s, d):
    return diagnosis.paired_table(fx.paired(s, d))


_MCNEMAR = "CASE WHEN n_only_a+n_only_b=0 THEN 1.0 ELSE least(1.0, 2*list_sum(list_transform(range(0,least(n_only_a,n_only_b)+1), lambda i: exp(lgamma(n_only_a+n_only_b+1)-lgamma(i+1)-lgamma(n_only_a+n_only_b-i+1)-(n_only_a+n_only_b)*ln(2.0::DOUBLE))))) END"


@query(f"WITH {S.PAIRED}, t AS (SELECT {_PT} FROM pr) SELECT n_only_a, n_only_b, round({_MCNEMAR},9)::DOUBLE AS p_value FROM t")
def mcnemar_p_value(s, d):
    return resampling.paired_tests(diagnosis.paired_table(fx.paired(s, d))).select("n_only_a", "n_only_b", F.round("p_value", 9).alias("p_value"))


@query(f"WITH {S.PAIRED}, t AS (SELECT cluster, {_PT} FROM pr GROUP BY 1) SELECT cluster, n_only_a, n_only_b, round({_MCNEMAR},9)::DOUBLE AS p_value FROM t")
def mcnemar_by_slice(s, d):
    return resampling.paired_tests(diagnosis.paired_table(fx.paired(s, d), ["cluster"])).select("cluster", "n_only_a", "n_only_b", F.round("p_value", 9).alias("p_value"))


def _paired_cells(s, d):
    return fx.paired(s, d).select((F.col("em_a") - F.col("em_b")).alias("s"), F.lit(1).alias("c"))


@query()
def bootstrap_ci(s, d):
    return resampling.bootstrap_ci(_paired_cells(s, d))


@query()
def cluster_bootstrap_ci(s, d):
    return resampling.bootstrap_ci(diagnosis.cluster_cells(fx.paired(s, d)))


@query(f"WITH {S.PAIRED} SELECT b::INT AS b, (SELECT count(*) FROM pr) AS n_items, (SELECT count(DISTINCT cluster) FROM pr) AS n_clusters FROM range(0,2000) r(b)")
def bootstrap_draws(s, d):
    """How many items and clusters each resample draws: as many as there are."""
    items = resampling.resampled(_paired_cells(s, d)).select("b", F.col("n").alias("n_items"))
    return items.join(resampling.resampled(diagnosis.cluster_cells(fx.paired(s, d))).select("b", F.col("n").alias("n_clusters")), "b")


@query(f"WITH {S.PAIRED} SELECT cluster AS cell, sum(em_a-em_b) AS s, count(*) AS c FROM pr GROUP BY 1")
def cluster_cells(s, d):
    return diagnosis.cluster_cells(fx.paired(s, d))


_GOLD = "coalesce(golds[1],'')"


_LR = lambda x: rf"regexp_replace(regexp_replace({S.trim(f'lower({x})')},'[^\pL\pM\pN_\s]',' ','g'),'\s+',' ','g')"
_LW = lambda x: f"list_filter(string_split({x},' '), lambda t: t<>'')"
_LE = f"""{S.SCORED}, e0 AS (SELECT system, qid, ord, question, context, is_impossible, coalesce(golds[1],'') AS gold, prediction AS p, {_LR("coalesce(golds[1],'')")} AS gr, {_LR('prediction')} AS qr, trim(gr) AS g, trim(qr) AS q, len({S.words('context')}) AS nc FROM items),
e1 AS (SELECT *, {_LW('g')} AS gw, {_LW('q')} AS qw FROM e0 WHERE NOT (gr=qr OR (is_impossible AND p=''))),
e2 AS (SELECT *, len(list_intersect(gw,qw)) AS sh, len(list_distinct(gw)) AS dg, len(list_distinct(qw)) AS dq, g<>'' AND q<>'' AND ((g<>q AND (strpos(q,g)>0 OR strpos(g,q)>0)) OR (len(gw)>1 AND len(qw)>1 AND (gw[1]=qw[1])<>(gw[-1]=qw[-1]))) AS bd FROM e1),
ec AS (SELECT *, CASE WHEN gold<>p AND len(gw)>0 AND sh::DOUBLE/dg>0.8 THEN 'E5|ambiguous_ground_truth' WHEN NOT is_impossible AND {S.any_of('question', X.NEGATIONS)} THEN 'E3|negative_trap_failure' WHEN is_impossible THEN 'E3|unanswerable_misclassified' WHEN bd AND len(gw)>0 AND NOT starts_with(q,gw[1]) THEN 'E1|boundary_prefix_missing'
WHEN bd AND len(gw)>0 AND NOT ends_with(q,gw[-1]) THEN 'E1|boundary_suffix_missing' WHEN bd THEN 'E1|boundary_partial' WHEN nc>256 THEN 'E2|context_overhead' WHEN {S.any_of('question', X.MULTI_HOP)} THEN 'E4|multi_hop_reasoning_failure' WHEN len(gw)>0 AND len(qw)>0 AND sh::DOUBLE/greatest(dg,dq)>0.3 THEN 'E2|partial_span_extraction' WHEN nc>200 THEN 'E2|long_context_error' ELSE 'E4|unknown_reasoning_error' END AS x FROM e2),
lc AS (SELECT *, split_part(x,'|',1) AS category, split_part(x,'|',2) AS subtype, count(*) OVER (PARTITION BY system) AS t, (ord*7919)%101/101.0::DOUBLE AS confidence FROM ec)"""


@query(f"{_LE} SELECT system, category, subtype, count(*) AS n, round(count(*)/any_value(t)::DOUBLE,6) AS ratio FROM lc GROUP BY 1,2,3")
def legacy_error_classes(s, d):
    return diagnosis.legacy_errors(_items(s, d))


@query(f"{_LE}, ck AS (SELECT *, count(*) OVER (PARTITION BY system, category) AS n, row_number() OVER (PARTITION BY system, category ORDER BY confidence DESC, qid) AS k FROM lc) SELECT system, category, k::INT AS k, qid, subtype, confidence, round(n/t::DOUBLE,4) AS ratio FROM ck WHERE k<=2")
def legacy_case_studies(s, d):
    items = _items(s, d).join(fx.examples(s, d).select("qid", "ord"), "qid")
    return diagnosis.legacy_case_studies(items.withColumn("confidence", F.col("ord") * 7919 % 101 / 101))


@query(f"{S.SCORED}, dd AS (SELECT a.qid, CASE WHEN a.em>b.em THEN 'first3' ELSE 'two_sentences' END AS winner, CASE WHEN coalesce(a.error,b.error) LIKE 'boundary%' THEN 'boundary' ELSE coalesce(a.error,b.error) END AS kind, a.prediction AS prediction_a, b.prediction AS prediction_b FROM cls a JOIN cls b USING (qid) WHERE a.system='first3' AND b.system='two_sentences' AND a.em<>b.em) SELECT *, (SELECT count(*) FROM dd WHERE kind='boundary') AS total FROM dd WHERE kind='boundary' ORDER BY qid LIMIT 24")
def disagreement_page(s, d):
    return diagnosis.disagreement_page(_items(s, d), "first3", "two_sentences", "boundary")


# spans and thresholds


@query(f"WITH {S.LOGITS} SELECT qid, window_ix, s::BIGINT AS s, e::BIGINT AS e, round(score,9) AS score, round(delta,9) AS delta FROM win")
def best_span_per_window(s, d):
    w = spans.scored(fx.logits(s, d))
    return w.select("qid", F.col("window_ix").cast("long"), F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"), F.round("score", 9).alias("score"), F.round("delta", 9).alias("delta"))


@query(f"WITH {S.LOGITS} SELECT qid, window_ix, rank::BIGINT AS rank, s::BIGINT AS s, e::BIGINT AS e, round(score,9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid, window_ix ORDER BY h) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, window_ix, s//2, e//2 ORDER BY h) AS c FROM (SELECT *, row_number() OVER (PARTITION BY qid, window_ix ORDER BY score DESC, s, e) AS h FROM prs) WHERE h<=16) WHERE c=1) WHERE rank<=4")
def topk_spans(s, d):
    w = spans.scored(fx.logits(s, d)).select("qid", F.col("window_ix").cast("long"), F.posexplode("spans").alias("k", "x"))
    return w.select("qid", "window_ix", (F.col("k") + 1).cast("long").alias("rank"), F.col("x.s").cast("long").alias("s"), F.col("x.e").cast("long").alias("e"), F.round("x.score", 9).alias("score"))


@query(f"""WITH {S.LOGITS}, m AS (SELECT qid, window_ix, greatest(max(score),any_value(null_score)) AS h FROM prs GROUP BY 1,2),
z AS (SELECT qid, window_ix, any_value(h) AS h, sum(exp(score-h))+exp(any_value(null_score)-any_value(h)) AS total FROM prs JOIN m USING (qid,window_ix) GROUP BY 1,2)
SELECT qid, window_ix, round(exp(score-h)/total,9) AS prob FROM win JOIN z USING (qid,window_ix)""")
def span_softmax(s, d):
    return spans.scored(fx.logits(s, d)).select("qid", F.col("window_ix").cast("long"), F.round(F.get("spans", F.lit(0))["prob"], 9).alias("prob"))


@query(f"""WITH {S.LOGITS}, x AS (SELECT qid, window_ix, st[s+1] AS vs, st[64-e] AS ve, st[9:60] AS a, st[5:56] AS b FROM win JOIN lg USING (qid,window_ix))
SELECT qid, window_ix, round(exp(vs-list_max(a))/list_sum(list_transform(a, lambda v: exp(v-list_max(a)))),9) AS start_prob, round(exp(ve-list_max(b))/list_sum(list_transform(b, lambda v: exp(v-list_max(b)))),9) AS end_prob FROM x""")
def endpoint_softmax(s, d):
    w = spans.endpoint_softmax(spans.scored(fx.logits(s, d)))
    return w.select("qid", F.col("window_ix").cast("long"), F.round("start_prob", 9).alias("start_prob"), F.round("end_prob", 9).alias("end_prob"))


@query(f"WITH {S.LOGITS}, med AS (SELECT quantile_disc(-delta,0.5) AS tau FROM win) SELECT qid, CASE WHEN max(score) FILTER (NOT (delta+tau>=0)) IS NULL THEN NULL ELSE first(window_ix ORDER BY (delta+tau>=0)::INT, score DESC, window_ix) END::BIGINT AS window_ix, first(window_ix ORDER BY delta, window_ix)::BIGINT AS evidence_ix, count(*) FILTER (NOT (delta+tau>=0))>0 AS answered FROM win, med GROUP BY qid")
def window_decision(s, d):
    w = spans.scored(fx.logits(s, d)).withColumn("cut", -F.col("delta"))
    tau = eda_median(w, "cut")
    return spans.decided(w.crossJoin(F.broadcast(tau)), F.col("tau")).select("qid", F.col("window_ix").cast("long").alias("window_ix"), F.col("evidence_ix").cast("long").alias("evidence_ix"), "answered")


def eda_median(w: DataFrame, value: str) -> DataFrame:
    """One row (tau): the lower median, from running counts of distinct values."""
    c = w.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    n = c.agg(F.sum("c").alias("n"))
    return threshold.running_sums(c, "v", ["c"]).crossJoin(F.broadcast(n)).where("c >= ceil(n / 2)").agg(F.min("v").alias("tau"))


def _tau_windows(s, d):
    """(windows, abstain): window scores against the first window's span; questions with an odd label have no answer."""
    w = spans.scored(fx.logits(s, d)).select("qid", "window_ix", "s", "e", "score", "delta").withColumn("answer", F.concat_ws("-", "s", "e"))
    gold = w.where("window_ix = 1").select("qid", F.col("s").alias("gs"), F.col("e").alias("ge"))
    w = w.join(gold, "qid")
    over = F.least("e", "ge") - F.greatest("s", "gs") + 1
    none = F.col("qid") % 2 == 1
    w = w.withColumn("em", F.when(none, 0.0).otherwise(((F.col("s") == F.col("gs")) & (F.col("e") == F.col("ge"))).cast("double")))
    w = w.withColumn("f1", F.when(none | (over <= 0), 0.0).otherwise(2.0 * over / ((F.col("e") - F.col("s") + 1) + (F.col("ge") - F.col("gs") + 1))))
    w = saved(w, "windows")  # each window is searched once, whatever is asked of its scores
    a = w.select("qid").distinct().select("qid", none.cast("double").alias("em0"), none.cast("double").alias("f1_0"))
    return w, a


def _systems(s, d):
    """(windows, refs): a second system has the opposite deltas, a third has no threshold; a question's gold is its first window's answer."""
    w, _ = _tau_windows(s, d)
    text = w.select(F.col("qid").cast("string").alias("qid"), "window_ix", "score", "delta", F.concat_ws(" ", "s", "e").alias("answer"))
    one = lambda name, delta: text.select(F.lit(name).alias("system"), "qid", "window_ix", "score", delta.alias("delta"), "answer")
    windows = one("a", F.col("delta")).unionByName(one("b", -F.col("delta"))).unionByName(one("c", F.col("delta")))
    gold = text.where("window_ix = 1").select("qid", F.when(F.col("qid").cast("int") % 2 == 1, F.array().cast("array<string>")).otherwise(F.array("answer")).alias("golds"))
    return windows, gold


_SYS = f"""WITH {S.TAU}, sy AS (SELECT * FROM (VALUES ('a',1.5::DOUBLE),('b',-0.25::DOUBLE)) t(system,tau)), sw AS (SELECT system, tau, qid, window_ix, score, CASE WHEN system='b' THEN -delta ELSE delta END AS delta, s||' '||e AS answer FROM win, {{systems}}),
dc AS (SELECT system, qid, coalesce(first(answer ORDER BY score DESC, window_ix) FILTER (NOT (delta+tau>=0)),'') AS prediction FROM sw GROUP BY 1,2),
gd AS (SELECT qid, CASE WHEN qid%2=1 THEN [] ELSE [s||' '||e] END AS golds FROM win WHERE window_ix=1), sc0 AS (SELECT *, {S.tok('prediction')} AS p, {S.tok("coalesce(golds[1],'')")} AS g, len(golds)=0 AS none FROM dc JOIN gd USING (qid)),
sc AS (SELECT *, (array_to_string(p,' ')=array_to_string(g,' '))::DOUBLE AS em, {S.f1('p', 'g')} AS f1 FROM sc0)"""


@query(_SYS.format(systems="sy") + """ SELECT system, count(*) AS n, round(100*avg(em),4) AS em, round(100*avg(f1),4) AS f1, count(*) FILTER (NOT none) AS n_answerable, round(100*avg(em) FILTER (NOT none),4) AS em_answerable, round(100*avg(f1) FILTER (NOT none),4) AS f1_answerable,
count(*) FILTER (none) AS n_impossible, round(100*avg(em) FILTER (none),4) AS em_impossible, round(100*avg((prediction='')::INT),4) AS abstain_rate FROM sc GROUP BY 1""")
def stored_threshold_scores(s, d):
    windows, refs = _systems(s, d)
    taus = s.sql("select * from values ('a', 1.5D), ('b', -0.25D), ('c', null), ('d', 0D) as t(system, tau)")
    return threshold.stored_scores(windows, taus, refs)


@query(_SYS.format(systems="(SELECT system, 0.0::DOUBLE AS tau FROM (VALUES ('a'),('b'),('c')) t(system))") + ", ov AS (SELECT system, round(100*avg(em),4) AS em, round(100*avg(f1),4) AS f1 FROM sc GROUP BY 1) SELECT system, em, f1, CASE WHEN system='b' THEN em+1 ELSE em END AS em_direct, f1 AS f1_direct, system<>'b' AS agrees FROM ov")
def threshold_self_check(s, d):
    """Direct scores are those of the decisions at 0; those of one system are falsified."""
    windows, refs = _systems(s, d)
    zero = threshold.stored_scores(windows, windows.select("system").distinct().withColumn("tau", F.lit(0.0)), refs)
    direct = zero.select("system", F.when(F.col("system") == "b", F.col("em") + 1).otherwise(F.col("em")).alias("em"), "f1")
    return threshold.self_check(windows, refs, direct)


@query(f"WITH {S.TAU}, med AS (SELECT quantile_disc(-delta,0.5) AS tau FROM win) SELECT qid, CASE WHEN count(*) FILTER (NOT (delta+tau>=0))=0 THEN '' ELSE first(s||'-'||e ORDER BY (delta+tau>=0)::INT, score DESC, window_ix) END AS answer FROM win, med GROUP BY qid")
def predictions_at_tau(s, d):
    w, _ = _tau_windows(s, d)
    w = w.withColumn("cut", -F.col("delta"))
    return threshold.predictions_at(w.crossJoin(F.broadcast(eda_median(w, "cut"))), F.col("tau"))


@query(f"WITH {S.TAU} SELECT round(tau,9) AS tau FROM taus")
def tau_candidates(s, d):
    return threshold.candidate_taus(_tau_windows(s, d)[0]).select(F.round("tau", 9).alias("tau"))


@query(f"""WITH {S.TAU}, dec AS (SELECT tau, qid, first(em ORDER BY score DESC, window_ix) FILTER (NOT (delta+tau>=0)) AS em, first(f1 ORDER BY score DESC, window_ix) FILTER (NOT (delta+tau>=0)) AS f1 FROM taus, tw GROUP BY 1,2),
tot AS (SELECT tau, round(100*sum(coalesce(em,em0))/count(*),6) AS em, round(100*sum(coalesce(f1,f10))/count(*),6) AS f1 FROM dec JOIN ab USING (qid) GROUP BY 1)
SELECT round(tau,6) AS tau, em, f1 FROM tot ORDER BY f1 DESC, abs(tau), tau LIMIT 1""")
def best_threshold(s, d):
    return threshold.best_threshold(*_tau_windows(s, d))


@query(f"""WITH {S.TAU}, o AS (SELECT -delta AS v, row_number() OVER (ORDER BY -delta)-1 AS i, count(*) OVER () AS n FROM win),
b AS (SELECT max(v) FILTER (i=floor(0.02*n)) AS lo, max(v) FILTER (i=floor(0.98*n)-1) AS hi FROM o), g AS (SELECT k::INT AS k, lo+(hi-lo)*k/40 AS tau FROM b, range(0,41) r(k)),
c AS (SELECT qid, max(-delta) AS cut, bool_or(is_impossible) AS imp FROM tw GROUP BY 1),
x AS (SELECT k, tau, count(*) FILTER (cut<=tau AND imp) AS tp, count(*) FILTER (cut<=tau AND NOT imp) AS fp, count(*) FILTER (cut>tau AND imp) AS fn FROM g, c GROUP BY 1,2)
SELECT k, round(tau,9) AS tau, tp, fp, fn, round(coalesce(100.0*tp/nullif(tp+fp,0),0),6)::DOUBLE AS precision, round(coalesce(100.0*tp/nullif(tp+fn,0),0),6)::DOUBLE AS recall FROM x""")
def noanswer_pr_curve(s, d):
    w, _ = _tau_windows(s, d)
    imp = w.select("qid").distinct().withColumn("is_impossible", F.col("qid") % 2 == 1)
    return threshold.no_answer_curve(w, imp).withColumn("tau", F.round("tau", 9))


@query(f"""WITH {S.LOGITS}, ts AS (SELECT qid, window_ix, i, v FROM (SELECT qid, window_ix, i, st[i+1] AS v, row_number() OVER (PARTITION BY qid,window_ix ORDER BY st[i+1] DESC, i) AS k FROM lg, range(8,64) r(i)) WHERE k<=20),
te AS (SELECT qid, window_ix, i, v FROM (SELECT qid, window_ix, i, st[64-i] AS v, row_number() OVER (PARTITION BY qid,window_ix ORDER BY st[64-i] DESC, i) AS k FROM lg, range(8,64) r(i)) WHERE k<=20),
p AS (SELECT a.qid, a.window_ix, a.i AS s, b.i AS e, a.v+b.v AS score FROM ts a JOIN te b ON a.qid=b.qid AND a.window_ix=b.window_ix AND b.i>=a.i AND b.i-a.i<12),
n AS (SELECT qid, min(st[1]+st[64]) AS null_score FROM lg GROUP BY 1), t AS (SELECT qid, first(window_ix ORDER BY score DESC, window_ix, s, e) AS window_ix, first(s ORDER BY score DESC, window_ix, s, e) AS s, first(e ORDER BY score DESC, window_ix, s, e) AS e, max(score) AS score FROM p GROUP BY 1)
SELECT qid, window_ix::BIGINT AS window_ix, s::BIGINT AS s, e::BIGINT AS e, round(score,9) AS score, round(null_score,9) AS null_score, null_score-score>0 AS abstains FROM t JOIN n USING (qid)""")
def legacy_topn_span(s, d):
    r = spans.legacy_spans(fx.logits(s, d))
    return r.select("qid", *[F.col(c).cast("long").alias(c) for c in ("window_ix", "s", "e")], F.round("score", 9).alias("score"), F.round("null_score", 9).alias("null_score"), "abstains")


# retrieval


_TERMS = r"regexp_extract_all(regexp_replace(lower({x}),'[^\pL\pN_]+',' ','g'),'[\pL\pN_][\pL\pN_]+')"


@query(f"""{S.WITH_EX}, s0 AS (SELECT qid, question, {S.sent('context')} AS ss FROM ex), u AS (SELECT qid, len(ss) AS n, unnest(range(0,len(ss)+1)) AS ix, unnest(list_append(ss,question)) AS text FROM s0),
w AS (SELECT qid, n, ix, {_TERMS.format(x='text')} AS t FROM u), tm AS (SELECT qid, n, ix, unnest(list_concat(t, list_transform(range(1,greatest(len(t),1)), lambda i: t[i]||' '||t[i+1]))) AS term FROM w),
tf AS (SELECT qid, n, ix, term, count(*) AS tf FROM tm GROUP BY 1,2,3,4), v0 AS (SELECT *, tf*(ln((2.0+n)::DOUBLE/(1+count(*) OVER (PARTITION BY qid,term)))+1) AS v FROM tf), v AS (SELECT *, v/sqrt(sum(v*v) OVER (PARTITION BY qid,ix)) AS nv FROM v0),
sim AS (SELECT a.qid, a.ix, round(sum(a.nv*b.nv),9) AS sim FROM v a JOIN v b ON a.qid=b.qid AND a.term=b.term AND b.ix=b.n WHERE a.ix<a.n GROUP BY 1,2), bs AS (SELECT qid, first(ix ORDER BY sim DESC, ix) AS ix FROM sim GROUP BY 1)
SELECT qid, coalesce(ix,0)::BIGINT AS sent_ix, coalesce(ss[coalesce(ix,0)+1],'') AS prediction FROM s0 LEFT JOIN bs USING (qid)""")
def tfidf_best_sentence(s, d):
    return retrieval.best_sentence(fx.examples(s, d)).withColumn("sent_ix", F.col("sent_ix").cast("long"))


_IR = f"""{S.WITH_EX}, dt AS (SELECT qid AS doc, unnest({S.words(S.legacy_norm('context'))}) AS term FROM ex), tf AS (SELECT doc, term, count(*) AS tf FROM dt GROUP BY 1,2), ln AS (SELECT qid AS doc, len({S.words(S.legacy_norm('context'))}) AS len FROM ex),
tt AS (SELECT count(*) AS n, avg(len) AS avgdl FROM ln), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), qt AS (SELECT query, term, count(*) AS qtf FROM (SELECT qid AS query, unnest({S.words(S.legacy_norm('question'))}) AS term FROM ex) GROUP BY 1,2)"""


@query(f"""{_IR}, sc AS (SELECT query, doc, round(sum((ln(n-df+0.5)-ln(df+0.5))*(tf*2.5)/(tf+1.5*(1-0.75+0.75*len/avgdl))*qtf),6) AS score FROM tf JOIN df USING (term) JOIN ln USING (doc) JOIN qt USING (term), tt GROUP BY 1,2)
SELECT query, doc, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sc) WHERE rank<=5""")
def bm25_rank(s, d):
    ex = fx.examples(s, d)
    return retrieval.bm25(ex.select(F.col("qid").alias("doc"), F.col("context").alias("text")), ex.select(F.col("qid").alias("query"), F.col("question").alias("text")))


@query(f"""{_IR}, v AS (SELECT doc, term, ln((n+1)::DOUBLE/(df+1))+1 AS idf, tf::DOUBLE/len*(ln((n+1)::DOUBLE/(df+1))+1) AS v FROM tf JOIN df USING (term) JOIN ln USING (doc), tt), nm AS (SELECT doc, sqrt(sum(v*v)) AS norm FROM v GROUP BY 1),
qw AS (SELECT query, term, qtf::DOUBLE/sum(qtf) OVER (PARTITION BY query) AS qw FROM qt), h AS (SELECT query, doc, sum(qw*idf*v) AS dot, sqrt(sum(qw*idf*qw*idf)) AS qn FROM v JOIN qw USING (term) GROUP BY 1,2), sc AS (SELECT query, doc, round(dot/(qn*norm),6) AS score FROM h JOIN nm USING (doc))
SELECT query, doc, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sc) WHERE rank<=5""")
def legacy_tfidf_rank(s, d):
    ex = fx.examples(s, d)
    return retrieval.tfidf(ex.select(F.col("qid").alias("doc"), F.col("context").alias("text")), ex.select(F.col("qid").alias("query"), F.col("question").alias("text")))


_BA = rf"""{S.WITH_EX}, sn AS (SELECT qid, question, list_filter(list_transform(string_split_regex(context,'[.!?]+|\n'), lambda z: {S.trim('z')}), lambda z: length(z)>5) AS ss FROM ex),
u AS (SELECT qid, unnest(range(0,len(ss))) AS ix, unnest(ss) AS text, len(ss) AS n FROM sn), tm AS (SELECT qid, ix, n, unnest({S.words(S.legacy_norm('text'))}) AS term FROM u), tf AS (SELECT qid, ix, n, term, count(*) AS tf FROM tm GROUP BY 1,2,3,4),
v AS (SELECT *, count(*) OVER (PARTITION BY qid,term) AS df, sum(tf) OVER (PARTITION BY qid,ix) AS len, sum(tf) OVER (PARTITION BY qid)/n::DOUBLE AS avgdl FROM tf), qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({S.words(S.legacy_norm('question'))}) AS term FROM ex) GROUP BY 1,2),
sc AS (SELECT qid, ix, sum((ln(n-df+0.5)-ln(df+0.5))*tf*2.5/(tf+1.5*(0.25+0.75*len/avgdl))*qtf) AS bm, sum(tf::DOUBLE/len*(ln((n+1)::DOUBLE/(df+1))+1)*qtf) AS ti FROM v JOIN qt USING (qid,term) GROUP BY 1,2),
bs AS (SELECT qid, max(bm) AS bm, first(ix ORDER BY bm DESC, ix) AS b, first(ix ORDER BY ti DESC, ix) AS t FROM sc GROUP BY 1),
pk AS (SELECT qid, question, list_filter(string_split(ss[coalesce(CASE WHEN bm>=0.01 THEN b ELSE t END,0)+1],' '), lambda t: t<>'') AS w FROM sn LEFT JOIN bs USING (qid)), ky AS (SELECT *, string_split({S.legacy_norm('question')},' ') AS keys FROM pk),
wa AS (SELECT qid, w, list_filter(range(1,len(w)+1), lambda i: list_contains(keys, {S.legacy_norm('w[i]')})) AS hit FROM ky)"""


@query(f"{_BA} SELECT qid, coalesce(array_to_string(CASE WHEN len(hit)=0 THEN w[1:10] ELSE w[greatest(list_min(hit)-3,1):list_max(hit)+5] END,' '),'') AS prediction FROM wa")
def bm25_answers(s, d):
    return retrieval.bm25_answers(fx.examples(s, d))


# words, windows and alignment

_WORDS = f"""{S.LOCATED}, cp AS (SELECT *, regexp_extract_all(context,'\\S+|\\s+') AS pc FROM loc),
wd AS (SELECT doc_id, item_id, context, answer, answer_start, list_filter(list_transform(pc, lambda w, k: {{'tok':w,'s':coalesce(list_sum(list_transform(pc[1:k-1], lambda y: length(y))),0)::INT}}), lambda z: NOT regexp_matches(z.tok,'^\\s')) AS ws FROM cp)"""
_TW = f"""{_WORDS}, tw AS (SELECT *, unnest(range(0,(1+greatest(0,ceil((len(ws)-128)/96.0)))::BIGINT))::INT AS window_ix FROM wd WHERE len(ws)>0),
tx AS (SELECT *, window_ix*96 AS first_tok, least(128,len(ws)-window_ix*96) AS n_tokens FROM tw), ty AS (SELECT *, ws[first_tok+1].s AS s, ws[first_tok+n_tokens].s+length(ws[first_tok+n_tokens].tok) AS e, answer_start+length(answer) AS ae FROM tx),
tl AS (SELECT *, list_filter(range(1,n_tokens+1), lambda k: ws[first_tok+k].s<ae AND ws[first_tok+k].s+length(ws[first_tok+k].tok)>answer_start) AS hit, answer_start>=s AND ae<=e AS inside FROM ty)"""


def _windows(s, d):
    r = fx.located(s, d).withColumn("words", spans.words_of(F.col("context")))
    return spans.token_windows(r, 128, 32)


def _labelled(s, d):
    return spans.labelled(_windows(s, d), F.col("answer_start"), F.col("answer_start") + F.length("answer"))


@query(f"WITH {_TW} SELECT doc_id, item_id, window_ix::BIGINT AS window_ix, first_tok::BIGINT AS first, n_tokens::BIGINT AS n_tokens, s::BIGINT AS s, e::BIGINT AS e FROM ty")
def token_windows(s, d):
    return _windows(s, d).select("doc_id", "item_id", *[F.col(c).cast("long").alias(c) for c in ("window_ix", "first", "n_tokens", "s", "e")])


@query(f"WITH {_TW} SELECT doc_id, item_id, window_ix::BIGINT AS window_ix, CASE WHEN inside THEN coalesce(hit[1],0) ELSE 0 END::BIGINT AS label_start, CASE WHEN inside THEN coalesce(hit[len(hit)],0) ELSE 0 END::BIGINT AS label_end FROM tl")
def answer_token_labels(s, d):
    return _labelled(s, d).select("doc_id", "item_id", *[F.col(c).cast("long").alias(c) for c in ("window_ix", "label_start", "label_end")])


@query(f"""WITH {_TW}, f AS (SELECT *, CASE WHEN inside THEN coalesce(hit[1],0) ELSE 0 END AS ls, CASE WHEN inside THEN coalesce(hit[len(hit)],0) ELSE 0 END AS le FROM tl)
SELECT count(*) AS n_features, count(*) FILTER (n_tokens>128) AS n_too_long, count(*) FILTER (n_tokens<1) AS n_empty, count(*) FILTER (le<ls) AS n_inverted, count(*) FILTER (ls>n_tokens OR le>n_tokens) AS n_outside,
count(*) FILTER (NOT (ls=0 AND le=0) AND strpos(substr(context,ws[first_tok+ls].s+1,ws[first_tok+le].s-ws[first_tok+ls].s+length(ws[first_tok+le].tok)),answer)=0) AS n_mismatch, count(*) FILTER (ls=0 AND le=0) AS n_cls, round(avg((ls=0 AND le=0)::INT::DOUBLE),6) AS cls_share FROM f""")
def feature_scan(s, d):
    f = _labelled(s, d)
    return spans.feature_scan(f, 128)


#: Pairs of 128 ids that share 24 context tokens, with two separators between question and context.
_LAYOUT = features.Layout(max_length=128, stride=24, between=2)


def _word_id(w):
    """A vocabulary of 1,000 words, as a hash; 3 is unknown."""
    h = F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("int")
    return F.when(h % 61 == 0, F.lit(3)).otherwise(5 + h % 995)


def _pair_features(s, d):
    """Windows of user turns and their replies over white-space words; questions that fill a window have none."""
    tokens = F.transform(spans.words_of(F.col("context")), lambda w: F.struct(_word_id(w["tok"]).alias("id"), w["s"].cast("int").alias("s"), w["e"].cast("int").alias("e")))
    ids = F.transform(F.filter(F.split("question", X.SPACE), lambda t: t != ""), _word_id)
    rows = fx.examples(s, d).withColumns({"tokens": tokens, "question_ids": ids}).where(F.size("question_ids") < 124)
    return features.labelled(features.windows(rows, _LAYOUT))


_ID = "(CASE WHEN ('0x'||substr(md5({w}),1,6))::INT%61=0 THEN 3 ELSE 5+('0x'||substr(md5({w}),1,6))::INT%995 END)"
_PF = f"""{S.WITH_EX}, f0 AS (SELECT ord, qid, context, answers, answer_start, is_impossible, list_transform({S.words('question')}, lambda w: {_ID.format(w='w')}) AS qi, regexp_extract_all(context,'\\S+|\\s+') AS pc FROM ex),
f1 AS (SELECT * EXCLUDE (pc), list_filter(list_transform(pc, lambda w, k: {{'id':{_ID.format(w='w')},'s':coalesce(list_sum(list_transform(pc[1:k-1], lambda y: length(y))),0)::INT,'e':coalesce(list_sum(list_transform(pc[1:k], lambda y: length(y))),0)::INT,'w':regexp_matches(w,'^\\S')}}), lambda z: z.w) AS tk FROM f0),
f2 AS (SELECT *, 124-len(qi) AS room, greatest(1,100-len(qi)) AS step FROM f1 WHERE len(tk)>0 AND len(qi)<124),
f3 AS (SELECT *, unnest(range(0,(1+greatest(0,ceil((len(tk)-room)/step::DOUBLE)))::BIGINT))::INT AS window_ix FROM f2),
f4 AS (SELECT *, tk[window_ix*step+1:window_ix*step+room] AS part, len(qi)+3 AS lead FROM f3),
f5 AS (SELECT *, list_concat([0],qi,[2,2],list_transform(part, lambda t: t.id),[2]) AS ids, part[1].s AS char_start, part[len(part)].e AS char_end, answer_start+length(answers[1]) AS ae FROM f4),
f6 AS (SELECT *, len(ids) AS n_real, list_concat(ids, list_transform(range(len(ids),128), lambda i: 1)) AS input_ids, len(answers)>0 AND answer_start>=0 AND char_start<=answer_start AND char_end>=ae AS hit FROM f5),
f7 AS (SELECT *, CASE WHEN hit THEN lead+list_filter(range(1,len(part)+1), lambda i: part[i].e>answer_start)[1]-1 ELSE 0 END AS sp, CASE WHEN hit THEN lead+list_filter(range(1,len(part)+1), lambda i: part[i].s<ae)[-1]-1 ELSE 0 END AS ep FROM f6)"""


@query(f"""{_PF} SELECT qid, window_ix::BIGINT AS window_ix, n_real::BIGINT AS n_real, char_start::BIGINT AS char_start, char_end::BIGINT AS char_end, sp::BIGINT AS start_position, ep::BIGINT AS end_position, md5(array_to_string(input_ids,',')) AS ids,
md5(array_to_string(list_concat(list_transform(range(0,lead), lambda i: '-'),list_transform(part, lambda t: t.s||':'||t.e),list_transform(range(lead+len(part),128), lambda i: '-')),',')) AS offsets,
md5(array_to_string(list_concat(['-'],list_transform(qi, lambda i: '0'),['-','-'],list_transform(part, lambda i: '1'),list_transform(range(lead+len(part),128), lambda i: '-')),',')) AS sequence_ids FROM f7""")
def pair_features(s, d):
    f = _pair_features(s, d)
    joined = lambda c, text: F.md5(F.concat_ws(",", F.transform(c, lambda x: F.coalesce(text(x), F.lit("-"))))).alias(c)
    long = [F.col(c).cast("long").alias(c) for c in ("window_ix", "char_start", "char_end", "start_position", "end_position")]
    real = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("long")
    return f.select("qid", real.alias("n_real"), *long, F.md5(F.concat_ws(",", F.col("input_ids").cast("array<string>"))).alias("ids"), joined("offsets", lambda o: F.concat(o["s"], F.lit(":"), o["e"])), joined("sequence_ids", lambda x: x.cast("string")))


def _faulty_features(s, d):
    """Features with a fault in seven of eleven windows: a foreign id, padding, CLS or labels that don't fit."""
    f = _pair_features(s, d).withColumn("k", (F.col("ord") + 5 * F.col("window_ix")) % 11)
    real = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    at = lambda i, x: F.concat(F.slice("input_ids", 1, i), F.array(F.lit(x)), F.slice("input_ids", i + 2, 128))
    ids = F.when(F.col("k") == 1, at(4, 5000)).when(F.col("k") == 2, at(127, 7)).when(F.col("k") == 6, at(0, 9)).otherwise(F.col("input_ids"))
    lead = F.size("question_ids") + 3
    label = lambda c: F.when(F.col("k") == 3, real).when(F.col("k").isin(4, 7), F.lit(1)).when(F.col("k") == 5, lead).otherwise(F.col(c))
    return f.withColumns({"start_position": label("start_position"), "end_position": label("end_position"), "input_ids": ids})


@query(f"""{_PF}, g AS (SELECT *, (ord+5*window_ix)%11 AS k FROM f7),
h AS (SELECT *, CASE k WHEN 1 THEN list_concat(input_ids[1:4],[5000],input_ids[6:]) WHEN 2 THEN list_concat(input_ids[1:127],[7]) WHEN 6 THEN list_concat([9],input_ids[2:]) ELSE input_ids END AS x, CASE WHEN k=3 THEN n_real WHEN k IN (4,7) THEN 1 WHEN k=5 THEN lead ELSE sp END AS s, CASE WHEN k=3 THEN n_real WHEN k IN (4,7) THEN 1 WHEN k=5 THEN lead ELSE ep END AS e FROM g),
c AS (SELECT *, coalesce(list_position(x,0),0)-1 AS cls FROM h), sp AS (SELECT *, s=cls AND e=cls AS at_cls, s>0 AND s<=e AND e<n_real AS valid, s>=lead AND s<lead+len(part) AND e>=lead AND e<lead+len(part) AS inside FROM c),
m AS (SELECT *, {S.norm('substr(context,part[s-lead+1].s+1,part[e-lead+1].e-part[s-lead+1].s)')}={S.norm('answers[1]')} AS same FROM sp)
SELECT count(*) AS n_features, count(*) FILTER (list_max(x[1:n_real])>=1000) AS id_out_of_vocab, count(*) FILTER (n_real>110) AS too_long, count(*) FILTER (n_real+1>=120) AS position_out_of_range, count(*) FILTER (n_real<128 AND list_bool_or(list_transform(x[n_real+1:], lambda t: t<>1))) AS mask_mismatch, count(*) FILTER (cls<>0) AS cls_not_at_0,
count(*) FILTER (is_impossible AND NOT at_cls) AS impossible_not_cls, count(*) FILTER (is_impossible) AS n_impossible, count(*) FILTER (NOT is_impossible AND at_cls) AS answer_outside_window, count(*) FILTER (NOT is_impossible AND NOT at_cls) AS n_span, count(*) FILTER (NOT is_impossible AND NOT at_cls AND NOT valid) AS span_index_invalid,
count(*) FILTER (NOT is_impossible AND NOT at_cls AND valid AND NOT inside) AS span_on_non_context_token, count(*) FILTER (NOT is_impossible AND NOT at_cls AND valid AND inside AND NOT same) AS span_text_mismatch,
round(100*(sum(len(list_filter(x[1:n_real], lambda t: t=3)))/greatest(sum(n_real),1)),4)::DOUBLE AS unk_rate_pct, round((count(*) FILTER (is_impossible)+count(*) FILTER (NOT is_impossible AND at_cls))/greatest(count(*),1),4)::DOUBLE AS cls_label_fraction,
round(100*(count(*) FILTER (NOT is_impossible AND NOT at_cls AND valid AND inside AND NOT same)/greatest(count(*) FILTER (NOT is_impossible AND NOT at_cls),1)),4)::DOUBLE AS span_text_mismatch_pct FROM m""")
def encoded_feature_scan(s, d):
    from dataclasses import replace

    return features.scan(_faulty_features(s, d), replace(_LAYOUT, max_length=110), 1000, 120, 2, unknown=3)


_AL = f"""{_WORDS}, jw AS (SELECT *, list_transform(list_filter(range(1,len(ws)+1), lambda k: k%2=1), lambda k: {{'s':ws[k].s,'e':coalesce(ws[k+1].s+length(ws[k+1].tok),ws[k].s+length(ws[k].tok))}}) AS w, answer_start AS a, answer_start+length(answer) AS b FROM wd),
al AS (SELECT doc_id, item_id, context, answer, a, w, len(list_filter(w, lambda z: z.s<a AND a<z.e))>0 AS start_cut, len(list_filter(w, lambda z: z.s<b AND b<z.e))>0 AS end_cut, list_min(list_transform(list_filter(w, lambda z: z.s<b AND z.e>a), lambda z: z.s)) AS os, list_max(list_transform(list_filter(w, lambda z: z.s<b AND z.e>a), lambda z: z.e)) AS oe FROM jw),
am AS (SELECT *, ({S.norm('substr(context,os+1,oe-os)')}={S.norm('answer')})::DOUBLE AS oem FROM al)"""


def _aligned(s, d):
    r = stress.with_words(fx.located(s, d))
    return spans.boundary_alignment(r.withColumn("answers", X.located(F.col("context"), F.array("answer"), F.col("answer_start"))))


@query(f"WITH {_AL} SELECT doc_id, item_id, NOT start_cut AND NOT end_cut AS aligned, start_cut, end_cut, oem AS oracle_em, os::BIGINT AS oracle_s, oe::BIGINT AS oracle_e FROM am")
def boundary_alignment(s, d):
    return _aligned(s, d).select("doc_id", "item_id", "aligned", "start_cut", "end_cut", "oracle_em", F.col("oracle_s").cast("long").alias("oracle_s"), F.col("oracle_e").cast("long").alias("oracle_e"))


@query(f"""WITH {_AL} SELECT count(*) AS n_located, count(*) FILTER (NOT start_cut AND NOT end_cut) AS n_aligned, round(100.0*count(*) FILTER (start_cut OR end_cut)/count(*),2)::DOUBLE AS misaligned_pct, count(*) FILTER (start_cut) AS n_start_cut, count(*) FILTER (end_cut) AS n_end_cut,
round(100*avg(oem),4) AS oracle_em, round(100*avg(oem) FILTER (start_cut OR end_cut),4) AS oracle_em_misaligned FROM am""")
def alignment_summary(s, d):
    return spans.alignment_summary(_aligned(s, d))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(text,'[^\s\x1c-\x1f\x85\x{a0}]+') AS ws FROM documents) SELECT doc_id, round(CASE WHEN len(ws)=0 THEN 1.0 ELSE list_sum(list_transform(list_filter(range(1,len(ws)+1), lambda k: k%3<>0), lambda k: length(ws[k])))::DOUBLE/list_sum(list_transform(ws, lambda t: length(t))) END,9) AS coverage FROM w""")
def char_coverage(s, d):
    """Every third word is taken out, as a segmenter might lose it."""
    words = F.filter(spans.words_of(F.col("context")), lambda w, k: (k + 1) % 3 != 0)
    r = _docs(s, d).select("doc_id", F.col("text").alias("context")).withColumn("words", words)
    return r.select("doc_id", F.round(spans.char_coverage(F.col("context"), F.col("words")), 9).alias("coverage"))


@query(f"WITH {_AL} SELECT doc_id, item_id, len(w)::BIGINT AS n_pieces, md5(array_to_string(list_transform(w, lambda z: z.s||':'||z.e),',')) AS places FROM jw")
def segment_offsets(s, d):
    """Words joined in pairs are found where they were."""
    r = fx.located(s, d).withColumn("pieces", F.transform(spans.joined_words(spans.words_of(F.col("context"))), lambda w: w["tok"]))
    places = F.concat_ws(",", F.transform("words", lambda w: F.concat(w["s"], F.lit(":"), w["e"])))
    return spans.segment_offsets(r).select("doc_id", "item_id", F.size("pieces").cast("long").alias("n_pieces"), F.md5(places).alias("places"))


# stress


_SENT = f"string_split({S.boundary_marks('context')},chr(1))"
_GAP = f"""{S.WITH_EX}, g0 AS (SELECT qid, {_SENT} AS ss, list_distinct({S.tok('question')}) AS q, len(string_split({S.boundary_marks('substr(context,1,(answer_start+1)::BIGINT)')},chr(1))) AS i FROM ex WHERE len(answers)>0 AND answer_start>=0),
g1 AS (SELECT *, list_transform(ss, lambda z: len(list_intersect(q,list_distinct({S.tok('z')})))) AS n FROM g0)"""


@query(f"{_GAP} SELECT qid, len(ss)>=2 AND list_max(n)>n[i] AS gap FROM g1")
def lexical_gap(s, d):
    return stress.lexical_gap(stress.answerable(fx.examples(s, d))).select("qid", "gap")


def _located_examples(s, d):
    return fx.located(s, d).select(F.concat_ws("-", "doc_id", "item_id").alias("qid"), "answer", F.array("answer").alias("answers"), "answer_start", "context", F.lit(False).alias("is_impossible"), F.col("answer").alias("question"), F.lit("").alias("title"), F.col("doc_id").alias("ord"))


@query(f"WITH {S.LOCATED} SELECT doc_id||'-'||item_id AS qid, n::BIGINT AS words_before FROM (SELECT *, len({S.words('substr(context,1,answer_start)')}) AS n FROM loc) WHERE n>180")
def e2a_late_answers(s, d):
    return stress.late_answers(_located_examples(s, d)).select("qid", stress.words_before_answer().cast("long").alias("words_before"))


_NUM = r"'\d+(?:[.,]\d+)*'"


@query(rf"{S.WITH_EX}, nx AS (SELECT qid, '1889' AS a, 'In 1889 '||(ord%5)||' of '||(ord%7)||' and 12,5 '||context AS c FROM ex WHERE len(answers)>0) SELECT qid FROM nx WHERE len(list_filter(list_distinct(regexp_extract_all(c,{_NUM})), lambda z: NOT list_contains(regexp_extract_all(a,{_NUM}),z)))>=3")
def e2b_number_rich(s, d):
    """Contexts begin with a few numbers, some of them equal."""
    text = F.concat(F.lit("In 1889 "), (F.col("ord") % 5).cast("string"), F.lit(" of "), (F.col("ord") % 7).cast("string"), F.lit(" and 12,5 "), F.col("context"))
    some = F.size("answers") > 0
    ex = fx.examples(s, d).withColumns({"context": text, "answers": F.when(some, F.array(F.lit("1889"))).otherwise(F.col("answers")), "answer_start": F.when(some, 3).otherwise(-1)})
    return stress.number_rich(ex).select("qid")


_CUT = rf"""{S.WITH_EX}, c0 AS (SELECT qid, answers[1] AS a, {_SENT} AS ss, len(string_split({S.boundary_marks('substr(context,1,(answer_start+1)::BIGINT)')},chr(1))) AS i, len(string_split({S.boundary_marks('substr(context,1,(answer_start+length(answers[1]))::BIGINT)')},chr(1))) AS j FROM ex WHERE len(answers)>0 AND answer_start>=0),
c1 AS (SELECT qid, a, regexp_replace(ss[i],'^\s+','') AS removed, {S.trim(r"array_to_string(ss[1:i-1],'')||regexp_replace(array_to_string(ss[i+1:],''),'^\s+','')")} AS new_context FROM c0 WHERE len(ss)>=3 AND i=j)"""


@query(f"{_CUT} SELECT qid, removed, md5(new_context) AS digest FROM c1 WHERE strpos(new_context,a)=0 AND ({S.norm('a')}='' OR strpos(' '||{S.norm('new_context')}||' ',' '||{S.norm('a')}||' ')=0)")
def e3b_removed(s, d):
    return stress.removed_sentence(fx.examples(s, d)).select("qid", "removed", F.md5("new_context").alias("digest"))


@query(f"{S.WITH_EX} SELECT qid, translate(strip_accents(question),'đĐ','dD') AS plain_question FROM ex WHERE translate(strip_accents(question),'đĐ','dD')<>question")
def e5_unaccented(s, d):
    return stress.unaccented(fx.examples(s, d)).select("qid", "plain_question")


@query()
def e2c_distractors(s, d):
    """Every title becomes an entity that its question names, so that the rule has something to work on."""
    ex = fx.examples(s, d)
    named = ex.withColumns({"title": F.lit("Paris"), "question": F.concat_ws(" ", F.lit("Paris"), "question"), "context": F.concat(F.lit("Paris 1889 "), "context"), "answers": F.when(F.size("answers") > 0, F.array(F.lit("1889"))).otherwise(F.col("answers")), "answer_start": F.when(F.size("answers") > 0, 6).otherwise(-1)})
    return stress.distractors(named).select("qid", "fake", "new_start")


@query("""WITH c AS (SELECT doc_id, md5('42-E3a:'||doc_id) AS d, row_number() OVER (PARTITION BY text ORDER BY md5('42-E3a:'||doc_id), doc_id::VARCHAR) AS r FROM documents)
SELECT doc_id::VARCHAR AS qid, k::BIGINT AS k FROM (SELECT doc_id, row_number() OVER (ORDER BY d)-1 AS k FROM c WHERE r<=2) WHERE k<100""")
def capped_sample(s, d):
    pool = _docs(s, d).select(F.col("doc_id").cast("string").alias("qid"), F.col("text").alias("context"))
    return stress.capped_sample(pool, 100, "E3a").select("qid", F.col("k").cast("long").alias("k"))


def _stress_set(s, d):
    return stress.build(saved(stress.with_words(fx.examples(s, d)), "words"))  # words are long expressions that each subset would repeat


@query()
def stress_items(s, d):
    return _stress_set(s, d).select("qid", "category", "subset", "role", "source_qid", "pair_id", F.size("answers").cast("long").alias("n_answers"))


_AUDIT = f"""{S.WITH_EX}, st AS (SELECT qid, ord, context, question, answers, CASE WHEN ord%7=0 THEN [0,0]::BIGINT[] WHEN len(answers)=0 THEN []::BIGINT[] WHEN ord%5=0 THEN [answer_start+1] ELSE [answer_start] END AS starts, ord%3 AS kind FROM ex),
au AS (SELECT qid, 'offsets don''t match answers' AS reason FROM st WHERE len(starts)<>len(answers) UNION ALL SELECT qid, 'wrong offset' FROM st WHERE len(answers)>0 AND substr(context,starts[1]+1,length(answers[1]))<>answers[1]
UNION ALL SELECT qid, 'no note of the removed sentence' FROM st WHERE kind=0 AND ord%2=0 UNION ALL SELECT qid, 'question keeps diacritics' FROM st WHERE kind=1 AND translate(strip_accents(question),'đĐ','dD')<>question
UNION ALL SELECT qid, 'no original' FROM st WHERE kind=0 UNION ALL SELECT qid, 'context is in train' FROM st WHERE context IN (SELECT context FROM ex WHERE ord%11=0))"""


@query(f"{_AUDIT} SELECT qid, reason FROM au")
def stress_audit(s, d):
    """Faults are planted: shifted and surplus offsets, missing notes and originals, kept diacritics, contexts of the training set."""
    ex = fx.examples(s, d)
    long = lambda *x: F.array(*x).cast("array<bigint>")
    starts = F.when(F.col("ord") % 7 == 0, long(F.lit(0), F.lit(0))).when(F.size("answers") == 0, long()).when(F.col("ord") % 5 == 0, long(F.col("answer_start") + 1)).otherwise(long(F.col("answer_start")))
    kind = F.col("ord") % 3
    subset = F.when(kind == 0, "E3b").when(kind == 1, "E5").otherwise("E2a")
    note = F.when(F.col("ord") % 2 == 1, "câu đã xoá: x").otherwise("")
    rows = ex.select("qid", "context", "question", "answers", starts.alias("answer_starts"), subset.alias("subset"), F.lit("perturbed").alias("role"), note.alias("note"))
    return stress.audit(rows, ex.where("ord % 11 = 0"))


@query()
def stress_set_audit(s, d):
    """The set that `build` makes has no fault."""
    return stress.audit(saved(_stress_set(s, d), "stress"))


@query()
def stress_subsets(s, d):
    return stress.subset_stats(saved(_stress_set(s, d), "stress"))


def _stress_like(s, d):
    """Examples with the fields of stress items; every third one is an original."""
    kind = F.col("ord") % 3
    return fx.examples(s, d).select("qid", "context", "question", "title", "answers", F.when(kind == 2, "E2").otherwise("E3").alias("category"), F.get(F.array(F.lit("E3a"), F.lit("E3b"), F.lit("E2a")), kind.cast("int")).alias("subset"), F.when(F.col("turn") % 3 == 1, "original").otherwise("slice").alias("role"), F.col("title").alias("source_qid"))


_LIKE = f"{S.WITH_EX}, sl AS (SELECT *, CASE WHEN ord%3=2 THEN 'E2' ELSE 'E3' END AS category, ['E3a','E3b','E2a'][ord%3+1] AS subset, turn%3<>1 AS main, len(answers)=0 AS none FROM ex)"


@query(f"""{_LIKE}, p AS (SELECT subset, max(c) AS max_per_context, count(*) AS n_contexts FROM (SELECT subset, context, count(*) AS c FROM sl WHERE main GROUP BY 1,2) GROUP BY 1)
SELECT subset, count(*) FILTER (main) AS n_items, count(*) FILTER (NOT main) AS n_twins, count(*) FILTER (main AND NOT none) AS n_answerable, count(*) FILTER (main AND none) AS n_impossible, count(DISTINCT title) FILTER (main) AS n_titles,
count(DISTINCT question) FILTER (main) AS n_questions, max(max_per_context) AS max_per_context, max(n_contexts) AS n_contexts FROM sl LEFT JOIN p USING (subset) GROUP BY 1""")
def stress_subset_stats(s, d):
    return stress.subset_stats(_stress_like(s, d))


@query(f"{_LIKE} SELECT category, count(*) FILTER (main) AS n_items, count(*) FILTER (NOT main) AS n_twins, count(*) FILTER (main AND NOT none) AS n_answerable, count(*) FILTER (main AND none) AS n_impossible, round(100.0*count(*) FILTER (main AND none)/nullif(count(*) FILTER (main),0),2)::DOUBLE AS always_abstain_em FROM sl GROUP BY 1")
def stress_category_stats(s, d):
    return stress.category_stats(_stress_like(s, d))


@query(f"""{_LIKE}, v AS (SELECT qid||': '||reason AS line, qid, reason FROM (SELECT qid, unnest(['a','b']) AS reason FROM sl WHERE ord%4=0))
SELECT count(*) AS n_items, count(*) FILTER (NOT none) AS n_answerable, count(*) FILTER (none) AS n_impossible, count(DISTINCT context) AS n_contexts, count(DISTINCT title) AS n_source_questions, (SELECT count(*) FROM v) AS n_violations,
(SELECT array_to_string(list_sort(list(line)),'|') FROM (SELECT line FROM v ORDER BY qid, reason LIMIT 50)) AS violations FROM sl""")
def stress_audit_totals(s, d):
    violations = fx.examples(s, d).where("ord % 4 = 0").select("qid", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("reason"))
    return stress.audit_totals(_stress_like(s, d), violations).withColumn("violations", F.concat_ws("|", "violations"))


@query(f"""{S.SCORED}, t AS (SELECT system, qid, em, f1, 'pair'||(ord//1000) AS pair_id, turn, row_number() OVER (PARTITION BY system, ord//1000 ORDER BY turn) AS k FROM items),
m AS (SELECT * FROM t WHERE k=2), o AS (SELECT * FROM t WHERE k=1), p AS (SELECT m.system, count(*) FILTER (o.em=1 AND m.em=1) AS both_correct, count(*) FILTER (o.em=1 AND m.em=0) AS broken, count(*) FILTER (o.em=0 AND m.em=1) AS fixed FROM m JOIN o USING (system,pair_id) GROUP BY 1)
SELECT system, 'E5' AS subset, n, em, f1, both_correct, broken, fixed, round(100.0*broken/nullif(both_correct+broken,0),2)::DOUBLE AS broken_pct FROM (SELECT system, count(*) AS n, round(100*avg(em),2) AS em, round(100*avg(f1),2) AS f1 FROM m GROUP BY 1) LEFT JOIN p USING (system)""")
def pair_report(s, d):
    from pyspark.sql.window import Window

    pair = F.concat(F.lit("pair"), F.regexp_extract("title", r"c(\d+)", 1))
    t = _items(s, d).withColumns({"pair_id": pair}).withColumn("k", F.row_number().over(Window.partitionBy("system", "pair_id").orderBy("turn")))
    t = t.where("k <= 2").withColumns({"role": F.when(F.col("k") == 1, "original").otherwise("perturbed"), "subset": F.lit("E5")})
    return stress.pair_report(t)


@query(f"""WITH {S.REVIEWS}, x AS (SELECT count(*) AS n, avg((nguoi_1=nguoi_2)::INT) AS po, avg((nguoi_1='ok')::INT) AS pa, avg((nguoi_2='ok')::INT) AS pb FROM rv), y AS (SELECT *, pa*pb+(1-pa)*(1-pb) AS pe FROM x)
SELECT n, round(100*po,2) AS agreement_pct, round(CASE WHEN pe>=1 THEN 1.0 ELSE (po-pe)/(1-pe) END,3) AS kappa FROM y""")
def cohen_kappa(s, d):
    return diagnosis.kappa(fx.reviews(s, d))


@query(f"WITH {S.REVIEWS} SELECT doc_id AS qid FROM documents WHERE doc_id NOT IN (SELECT qid FROM rv WHERE nguoi_1='loai' OR nguoi_2='loai')")
def reviewer_reject(s, d):
    return diagnosis.rejected(_docs(s, d).select(F.col("doc_id").alias("qid")), fx.reviews(s, d))


# training


@query(f"WITH {S.CURVES} SELECT run, first(epoch ORDER BY val_f1 DESC, epoch) AS best_epoch, max(val_f1) AS best_f1 FROM cv GROUP BY 1")
def best_epoch(s, d):
    return training.best_epoch(fx.curves(s, d))


@query(f"""WITH {S.CURVES}, a AS (SELECT run, count(*) AS n, first(epoch ORDER BY val_f1 DESC, epoch) AS be, max(val_f1) AS bf, max(epoch) AS le, last(val_f1 ORDER BY epoch) AS lf, last(train_loss ORDER BY epoch) AS ll, min(train_loss) AS ml, list(val_f1 ORDER BY epoch DESC)[2] AS pf, bool_and(abs(val_em-val_f1)<=0.5) AS degenerate FROM cv GROUP BY 1),
b AS (SELECT *, n>=2 AND be<le AND lf<bf AS dec, n>=2 AND ll>ml AS rise, coalesce(n>=2 AND le=be AND lf>=pf,false) AS imp FROM a)
SELECT run, be AS best_epoch, dec AND NOT rise AS overfitting, rise AS train_loss_rising, imp AS still_improving, degenerate, CASE WHEN n<2 THEN 'too short' WHEN dec AND rise THEN 'unstable' WHEN dec THEN 'overfitting' WHEN imp THEN 'still improving' ELSE 'no clear trend' END AS verdict FROM b""")
def curve_diagnosis(s, d):
    return training.curve_diagnosis(fx.curves(s, d))


@query(f"WITH {S.CURVES}, f AS (SELECT run, max(val_f1) AS f FROM cv GROUP BY 1), n AS (SELECT f, run FROM f WHERE run<>'view' ORDER BY f DESC, run DESC LIMIT 1), c AS (SELECT f, run FROM f WHERE run='view') SELECT CASE WHEN coalesce(c.f>n.f,false) THEN c.run ELSE n.run END AS run, CASE WHEN coalesce(c.f>n.f,false) THEN c.f ELSE n.f END AS f1, coalesce(c.f>n.f,false) AS is_stable_candidate FROM n LEFT JOIN c ON true")
def run_selection(s, d):
    b = training.best_epoch(fx.curves(s, d))
    runs = b.select("run", F.when(F.col("run") == "view", F.col("best_f1")).alias("dev_f1"), F.col("best_f1").alias("curve_f1"), F.lit(True).alias("stable"), (F.col("run") == "view").alias("is_candidate"), F.lit(True).alias("has_predictions"))
    return training.select_run(runs)


_STABLE = f"""WITH {S.STEPS}, a AS (SELECT run, step-1 AS i, avg(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS sm FROM sp), b AS (SELECT run, i, round(sm-min(sm) OVER (PARTITION BY run ORDER BY i ROWS UNBOUNDED PRECEDING),9) AS rise FROM a WHERE i>=49)
SELECT run, min(i) FILTER (rise>5) IS NULL AS stable, round(max(rise),6) AS max_rise, (min(i) FILTER (rise>5))::BIGINT AS first_violation FROM b GROUP BY 1"""


@query(_STABLE)
def stability_report(s, d):
    return training.stability(fx.steps(s, d), 50, 5.0)


@query(f"WITH {S.STEPS} SELECT run, round(avg(loss) FILTER (is_cls),6) AS cls_loss, round(avg(loss) FILTER (NOT is_cls),6) AS span_loss, round(avg(is_cls::INT::DOUBLE),6) AS cls_share FROM sp GROUP BY 1")
def loss_by_label(s, d):
    return training.loss_by_label(fx.steps(s, d))


@query(f"WITH {S.STEPS}, a AS (SELECT run, count(*) AS n FROM sp GROUP BY 1), b AS (SELECT run, greatest(1,floor(ceil(n/8.0)/2))::BIGINT AS p FROM a) SELECT run, p AS steps_per_epoch, p*3 AS total_steps, floor(p*3*0.1::DOUBLE)::BIGINT AS warmup_steps FROM b")
def schedule(s, d):
    n = fx.steps(s, d).groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    return n.select("run", training.schedule(F.col("n"), 8, 2, 3, 0.1).alias("x")).select("run", "x.*")


@query(_STABLE)
def stability_stream(s, d):
    """The streaming form of stability_report over the same steps, out of order in eight files or more, one a trigger; a step
    comes up to st.LATE steps late, so what waits in the state doesn't grow with the run."""
    from spanforge.streaming import stability as st

    out = st.run_to_end(st.delayed(fx.steps(s, d)), 50, 5.0, first_step=1, patience=1_000_000, files_per_trigger=1)
    return out.select("run", (F.col("first_violation") < 0).alias("stable"), "max_rise", F.when(F.col("first_violation") >= 0, F.col("first_violation")).alias("first_violation"))


# exploration and reports


@query("""WITH x AS (SELECT length(text) AS n FROM documents), e AS (SELECT unnest(['0-499','500-999','1000-1999','2000-4999','5000+']) AS bin, unnest([0,500,1000,2000,5000]) AS lo, unnest([500,1000,2000,5000,1000000000]) AS hi)
SELECT bin, count(n) AS n FROM e LEFT JOIN x ON n>=lo AND n<hi GROUP BY 1""")
def histograms(s, d):
    return eda.histogram(_docs(s, d).select(F.length("text").alias("n")), "n", [0, 500, 1000, 2000, 5000, 10**9])


@query("""WITH o AS (SELECT length(text)::DOUBLE AS v, row_number() OVER (ORDER BY length(text))-1 AS i, count(*) OVER () AS n FROM documents WHERE text IS NOT NULL)
SELECT any_value(n) AS n, round(avg(v),2) AS mean, median(v) AS median, max(v) FILTER (i=least(n-1,floor(n*0.05::DOUBLE))) AS p05, max(v) FILTER (i=least(n-1,floor(n*0.95::DOUBLE))) AS p95, max(v) AS max FROM o""")
def order_stat_summary(s, d):
    return eda.order_stats(_docs(s, d).select(F.length("text").alias("n")), "n")


@query(f"SELECT token, n FROM (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) AS k FROM (SELECT unnest({S.tok('text')}) AS token, count(*) AS n FROM documents GROUP BY 1)) WHERE k<=25")
def top_tokens(s, d):
    t = _docs(s, d).select(F.explode(X.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return t.orderBy(F.desc("n"), "token").limit(25)  # a top-25 report


#: Edits that make an impossible question out of an answerable one: a negation, a number, an antonym, a name, none, and another order of words.
_EDITS = (f" {X.EDIT_NEGATIONS[0]}", " 1889", f" {X.ANTONYMS[0][1]}", " Paris")


def _edited_questions(s, d, large=False):
    """Each user turn as an answerable question and as an impossible one made of it; paragraphs are parts of conversations, or three large ones."""
    ex = fx.examples(s, d)
    kind = F.floor(F.col("ord") / 2) % 6
    edited = F.when(kind == 5, F.regexp_replace("question", r"(?s)^(\S+)\s+(.*)$", "$2 $1")).when(kind == 4, F.col("question"))
    for k, x in enumerate(_EDITS):
        edited = F.when(kind == k, F.concat("question", F.lit(x))).otherwise(edited)
    plain = F.when(kind == 2, F.concat("question", F.lit(f" {X.ANTONYMS[0][0]}"))).otherwise(F.col("question"))
    place = {"title": F.lit("t"), "context": (F.floor(F.col("ord") / 1000) % 3).cast("string")} if large else {"context": F.floor(F.col("turn") / 4).cast("string")}
    both = F.array(F.struct(F.lit("a").alias("k"), plain.alias("question"), F.lit(False).alias("imp")), F.struct(F.lit("i").alias("k"), edited.alias("question"), F.lit(True).alias("imp")))
    rows = ex.withColumns(place).select("title", "context", "qid", "ord", F.posexplode(both).alias("n", "x"))
    return rows.select("title", "context", F.concat("qid", "x.k").alias("qid"), (2 * F.col("ord") + F.col("n")).alias("ord"), "x.question", F.col("x.imp").alias("is_impossible"))


def _sib(group: str) -> str:
    """All pairs of the questions above."""
    edits = " ".join(f"WHEN {k} THEN question||'{x}'" for k, x in enumerate(_EDITS))
    return rf"""{S.WITH_EX}, qs AS (SELECT {group} AS g, qid||'i' AS qid, ord*2+1 AS ord, true AS imp, CASE (ord//2)%6 {edits} WHEN 4 THEN question ELSE regexp_replace(question,'(?s)^(\S+)\s+(.*)$','\2 \1') END AS question FROM ex
UNION ALL SELECT {group}, qid||'a', ord*2, false, question||CASE WHEN (ord//2)%6=2 THEN ' {X.ANTONYMS[0][0]}' ELSE '' END FROM ex),
ts AS (SELECT *, list_distinct({S.tok('question')}) AS t FROM qs), i AS (SELECT * FROM ts WHERE imp), a AS (SELECT g, qid AS sq, question AS sibling, ord, t AS u FROM ts WHERE NOT imp),
p AS (SELECT i.qid, sq, a.ord, i.question, sibling, round(len(list_intersect(t,u))::DOUBLE/len(list_distinct(list_concat(t,u))),9) AS j FROM i JOIN a USING (g) WHERE list_has_any(t,u)),
sb AS (SELECT qid, first(sq ORDER BY j DESC, ord) AS sibling_qid, max(j) AS jaccard, first(question ORDER BY j DESC, ord) AS question, first(sibling ORDER BY j DESC, ord) AS sibling FROM p GROUP BY 1)"""


_SIB = _sib("title||'-'||(turn//4)")


@query(f"{_SIB} SELECT qid, sibling_qid, jaccard FROM sb")
def sibling_similarity(s, d):
    return siblings.best_siblings(_edited_questions(s, d)).select("qid", "sibling_qid", "jaccard")


@query(f"{_sib('(ord//1000)%3')} SELECT qid, sibling_qid, jaccard FROM sb")
def sibling_search(s, d):
    """Three paragraphs with all questions, which are searched by prefixes."""
    return siblings.best_siblings(_edited_questions(s, d, large=True)).select("qid", "sibling_qid", "jaccard")


_MINUS = "list_filter(list_distinct({a}), lambda v: len(list_filter({a}, lambda y: y=v))>len(list_filter({b}, lambda y: y=v)))"
_ED = f"""{_SIB}, e0 AS (SELECT qid, jaccard, {S.tok('sibling')} AS a, {S.tok('question')} AS b, list_transform(list_filter({S.words("question||' '||sibling")}, lambda w: regexp_matches(w,'^\\p{{Lu}}')), lambda w: regexp_replace(lower(w),'^[?,.]+|[?,.]+$','','g')) AS caps FROM sb),
e1 AS (SELECT *, {_MINUS.format(a='b', b='a')} AS ad, {_MINUS.format(a='a', b='b')} AS re FROM e0), e2 AS (SELECT *, list_concat(ad,re) AS bo FROM e1)"""
_SWAP = " OR ".join(f"(list_contains(ad,{S.q(u)}) AND list_contains(re,{S.q(v)})) OR (list_contains(ad,{S.q(v)}) AND list_contains(re,{S.q(u)}))" for u, v in X.ANTONYMS)
_EDIT = S.case([("len(bo)=0 AND a<>b", S.q(X.EDIT_TYPES[0])), ("len(bo)=0", S.q(X.EDIT_TYPES[1])), (f"list_has_any(bo,[{','.join(map(S.q, X.EDIT_NEGATIONS))}])", S.q(X.EDIT_TYPES[2])), ("len(list_filter(bo, lambda t: regexp_matches(t,'\\d')))>0", S.q(X.EDIT_TYPES[3])), (f"({_SWAP})", S.q(X.EDIT_TYPES[4])), ("list_has_any(bo,caps)", S.q(X.EDIT_TYPES[5]))], S.q(X.EDIT_TYPES[6]))


@query(f"{_ED} SELECT {_EDIT} AS edit, count(*) AS n FROM e2 GROUP BY 1")
def edit_types(s, d):
    return eda.edit_types(siblings.best_siblings(_edited_questions(s, d)))


@query(f"{_ED}, l AS (SELECT 'added' AS kind, unnest(ad) AS token FROM e2 WHERE jaccard>=0.5 UNION ALL SELECT 'removed', unnest(re) FROM e2 WHERE jaccard>=0.5), c AS (SELECT kind, token, count(*) AS n FROM l GROUP BY 1,2) SELECT kind, token, n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, token) AS k FROM c) WHERE k<=25")
def token_changes(s, d):
    return eda.token_changes(siblings.best_siblings(_edited_questions(s, d)))


_QT, _CT, _AT = S.tok("question"), S.tok("context"), S.tok("answers[1]")


@query(f"""{S.WITH_EX}, m AS (SELECT *, {_QT} AS q, list_distinct({_CT}) AS c, {_AT} AS a, len({S.words('question')}) AS nq, len({S.words('context')}) AS nc, NOT is_impossible AND len(answers)>0 AS has, answer_start/greatest(length(context),1)::DOUBLE AS rel,
len(string_split({S.boundary_marks('context')},chr(1))) AS ns, len(string_split({S.boundary_marks('substr(context,1,(answer_start+1)::BIGINT)')},chr(1)))-1 AS si FROM ex),
o AS (SELECT *, len(list_filter(q, lambda t: list_contains(c,t)))/greatest(len(q),1)::DOUBLE AS ov, len(a)>0 AND 2*len(list_filter(a, lambda t: list_contains(q,t)))>=len(a) AS mostly FROM m),
r AS (SELECT rel, row_number() OVER (ORDER BY rel)-1 AS i, count(*) OVER () AS n FROM o WHERE has)
SELECT count(*) AS n_questions, count(DISTINCT context) AS n_contexts, count(DISTINCT title) AS n_titles, count(*) FILTER (is_impossible) AS n_impossible, round(avg(nq),4) AS mean_question_words, round(avg(nc),4) AS mean_context_words, round(100*avg(ov) FILTER (NOT is_impossible),4) AS overlap_answerable, round(100*avg(ov) FILTER (is_impossible),4) AS overlap_impossible,
round(100.0*count(*) FILTER (has AND mostly)/nullif(count(*) FILTER (has),0),2)::DOUBLE AS answer_mostly_in_question_pct, array_to_string([count(*) FILTER (has AND least(9,floor(10*rel))=0),{','.join(f'count(*) FILTER (has AND least(9,floor(10*rel))={k})' for k in range(1, 10))}],',') AS answer_deciles,
array_to_string([{','.join(f'count(*) FILTER (has AND ns>1 AND least(6,si)={k})' for k in range(7))}],',') AS answer_sentence_index, (SELECT round(max(rel) FILTER (i=least(n-1,floor(n*0.25::DOUBLE))),2) FROM r) AS answer_q1, (SELECT round(max(rel) FILTER (i=least(n-1,floor(n*0.5::DOUBLE))),2) FROM r) AS answer_median, (SELECT round(max(rel) FILTER (i=least(n-1,floor(n*0.75::DOUBLE))),2) FROM r) AS answer_q3 FROM o""")
def split_profile(s, d):
    p = eda.split_profile(fx.examples(s, d))
    return p.withColumns({c: F.concat_ws(",", F.col(c).cast("array<string>")) for c in ("answer_deciles", "answer_sentence_index")})


@query(rf"""{S.WITH_EX}, l0 AS (SELECT context, answers[1] AS a, answer_start AS s, (ord//2)%5 AS k FROM ex WHERE len(answers)>0), l1 AS (SELECT context, CASE k WHEN 1 THEN substr(a,2) WHEN 2 THEN substr(a,1,length(a)-2) ELSE a END AS a, CASE WHEN k IN (1,3) THEN s+1 ELSE s END AS s FROM l0),
l2 AS (SELECT *, substr(context,(s+1)::BIGINT,length(a))=a AS fits, regexp_matches(substr(context,s::BIGINT,1),'^\pL$') AND s>0 AND regexp_matches(substr(a,1,1),'^\pL$') AS cs, regexp_matches(substr(context,(s+length(a)+1)::BIGINT,1),'^\pL$') AND regexp_matches(substr(a,length(a),1),'^\pL$') AS ce FROM l1)
SELECT count(*) AS n, count(*) FILTER (NOT fits) AS offset_mismatch, count(*) FILTER (fits AND cs) AS cut_start, count(*) FILTER (fits AND ce) AS cut_end, round(100.0*(count(*) FILTER (fits AND cs)+count(*) FILTER (fits AND ce))/nullif(count(*),0),2)::DOUBLE AS cut_any_pct FROM l2""")
def label_noise(s, d):
    """Some answers lose their first character or their last two, and some offsets are off by one."""
    k, a = F.floor(F.col("ord") / 2) % 5, F.get("answers", F.lit(0))
    cut = F.when(k == 1, F.substring(a, F.lit(2), F.length(a))).when(k == 2, F.substring(a, F.lit(1), F.length(a) - 2)).otherwise(a)
    some = F.size("answers") > 0
    noisy = {"answers": F.when(some, F.array(cut)).otherwise(F.col("answers")), "answer_start": F.when(some & k.isin(1, 3), F.col("answer_start") + 1).otherwise(F.col("answer_start"))}
    return eda.label_noise(fx.examples(s, d).withColumns(noisy))


_ORDER = ["<100", "100-200", "200-300", "300+"]
_PIV = ", ".join(f"coalesce(max(v) FILTER (system='{x}'),'') AS {x}" for x in fx.SYSTEMS)


@query(f"{S.SCORED}, g AS (SELECT system, {_BUCKET} AS length_bucket, format('{{:,.2f}}',round(100*avg(f1),4))||CASE WHEN count(*)<30 THEN '†' ELSE '' END AS v FROM (SELECT *, len({S.words('context')}) AS n_w FROM items) GROUP BY 1,2) SELECT list_position(['<100','100-200','200-300','300+'],length_bucket)::INT AS place, length_bucket, {_PIV} FROM g GROUP BY 1,2")
def pivot_report(s, d):
    b = scoring.breakdown(_items(s, d), scoring.tags(fx.examples(s, d)), "length_bucket")
    return report.pivot(b, "length_bucket", _ORDER, list(fx.SYSTEMS))


@query(f"{S.SCORED}, c AS (SELECT system, round(100*avg(em),6) AS em, round(100*avg(f1),6) AS f1 FROM items GROUP BY 1) SELECT c.system, c.em, c.f1, round(c.em-b.em,6) AS d_em, round(c.f1-b.f1,6) AS d_f1 FROM c, c b WHERE b.system='abstain'")
def kpi_delta(s, d):
    return report.delta_to(scoring.corpus_scores(_items(s, d)), "abstain", ["em", "f1"])


@query(f"{S.SCORED}, c AS (SELECT system, count(*)*1000 AS n, round(100*avg(f1),6) AS f1 FROM items GROUP BY 1) SELECT system, {S.locale('n::DOUBLE', 0)} AS n, {S.locale('f1', 2)} AS f1, CASE WHEN f1>=85 THEN 4 WHEN f1>=60 THEN 3 WHEN f1>=40 THEN 2 WHEN f1>=20 THEN 1 ELSE 0 END AS heat_f1 FROM c")
def locale_format(s, d):
    c = scoring.corpus_scores(_items(s, d)).select("system", (F.col("n") * 1000).alias("n"), "f1")
    return report.formatted(c, ["n"], ["f1"])


# what else the operators offer, each over whole tables


@query(f"""WITH {S.SPLITS}, r1 AS (SELECT text, row_number() OVER (ORDER BY md5('42:'||text)) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT text FROM documents)), rest AS (SELECT text FROM r1 WHERE k<=floor({1 - 0.8!r}::DOUBLE*n)),
r2 AS (SELECT text, row_number() OVER (ORDER BY md5('42-2:'||text)) AS k, count(*) OVER () AS n FROM rest) SELECT doc_id, CASE WHEN k IS NULL THEN 'train' WHEN k<=floor({1 - 0.1 / (1 - 0.8)!r}::DOUBLE*n) THEN 'test' ELSE 'validation' END AS split FROM documents LEFT JOIN r2 USING (text)""")
def three_way_split(s, d):
    return dataset.three_way_split(_docs(s, d).select("doc_id", F.col("text").alias("context")), "context").select("doc_id", "split")


@query("SELECT doc_id, ['train','validation','test'][(min(doc_id) OVER (PARTITION BY text)%3+1)::INT] AS split FROM documents")
def rotating_split(s, d):
    return dataset.rotating_split(_docs(s, d).select("doc_id", F.col("text").alias("context")), "context", F.col("doc_id")).select("doc_id", "split")


_ABST = "(prediction='')::INT"


@query(f"{S.SCORED} SELECT system, round(100*avg(em),6) AS em, round(100*avg(f1),6) AS f1, round(coalesce(100*avg(em) FILTER (NOT is_impossible),0),6) AS em_answerable, round(coalesce(100*avg({_ABST}) FILTER (is_impossible),0),6) AS em_impossible, round(100*avg({_ABST}),6) AS abstain_pct FROM items GROUP BY 1")
def threshold_scores(s, d):
    return scoring.threshold_scores(_items(s, d))


@query(f"WITH {S.LOGITS} SELECT least(n,4)::INT AS windows, count(*) AS questions FROM (SELECT qid, count(*) AS n FROM lg GROUP BY 1) GROUP BY 1")
def windows_per_question(s, d):
    return spans.windows_per_question(fx.logits(s, d)).withColumn("windows", F.col("windows").cast("int"))


@query(f"""WITH {S.TAU}, dv AS (SELECT * FROM tw WHERE qid%4<2), dt AS (SELECT DISTINCT tau FROM (SELECT unnest([-delta-1e-6,-delta+1e-6]) AS tau FROM dv UNION ALL SELECT 0.0)),
dec AS (SELECT tau, qid, first(em ORDER BY score DESC, window_ix) FILTER (NOT (delta+tau>=0)) AS em, first(f1 ORDER BY score DESC, window_ix) FILTER (NOT (delta+tau>=0)) AS f1 FROM dt, dv GROUP BY 1,2),
tot AS (SELECT tau, round(100*sum(coalesce(f1,f10))/count(*),6) AS f1 FROM dec JOIN ab USING (qid) GROUP BY 1), bt AS (SELECT round(tau,6) AS t FROM tot ORDER BY f1 DESC, abs(tau), tau LIMIT 1)
SELECT qid, any_value(t) AS tau, CASE WHEN count(*) FILTER (NOT (delta+t>=0))=0 THEN '' ELSE first(s||'-'||e ORDER BY (delta+t>=0)::INT, score DESC, window_ix) END AS answer FROM tw, bt WHERE qid%4>=2 GROUP BY qid""")
def calibrated_predictions(s, d):
    """Half of the questions choose the threshold, the others are decided at it, once."""
    w, a = _tau_windows(s, d)
    dev = F.col("qid") % 4 < 2
    tau, out = threshold.calibrate(w.where(dev), a.where(dev), w.where(~dev))
    return out.select("qid", F.lit(tau).alias("tau"), "answer")


@query(f"{S.SCORED}, pl AS (SELECT qid, ({S.sent('context')})[1] AS pt FROM ex WHERE is_impossible) SELECT system, count(*) AS n_answered, count(*) FILTER ({S.norm('prediction')}={S.norm('pt')}) AS n_trapped FROM items JOIN pl USING (qid) WHERE len(golds)=0 AND {S.trim('prediction')}<>'' GROUP BY 1")
def plausible_trap(s, d):
    """An impossible question's plausible answer is its context's first sentence."""
    plausible = fx.examples(s, d).where("is_impossible").select("qid", F.slice(X.sentences(F.col("context")), 1, 1).alias("plausible"))
    return diagnosis.plausible_trap(_items(s, d).drop("plausible"), plausible)


@query(f"{S.WITH_EX} SELECT bucket, count(*) AS n FROM (SELECT {S.case([(f'n<={t}', S.q(v)) for t, v in X.ANSWER_BUCKETS], S.q('11+'))} AS bucket FROM (SELECT len({S.tok('question')}) AS n FROM ex)) GROUP BY 1")
def answer_length_buckets(s, d):
    return fx.examples(s, d).groupBy(X.answer_length_bucket(F.size(X.tokens(F.col("question")))).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


_ATW = S.words("question")


@query(rf"{S.WITH_EX} SELECT kind, count(*) AS n FROM (SELECT {S.case([(r"regexp_matches(question,'\d')", S.q(X.ANSWER_TYPES[0])), (r"len(w)>0 AND len(w)<=6 AND len(list_filter(w, lambda t: regexp_matches(t,'^\pL') AND NOT regexp_matches(t,'^\p{Lu}')))=0", S.q(X.ANSWER_TYPES[1])), ('len(w)<=4', S.q(X.ANSWER_TYPES[2])), ('len(w)<=12', S.q(X.ANSWER_TYPES[3]))], S.q(X.ANSWER_TYPES[4]))} AS kind FROM (SELECT question, {_ATW} AS w FROM ex)) GROUP BY 1")
def answer_types(s, d):
    return fx.examples(s, d).groupBy(X.answer_type(F.col("question")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{S.WITH_EX}, a AS (SELECT qid, context, ({S.sent('context')})[1:3] AS a FROM ex) SELECT qid, array_to_string(list_transform(a, lambda z: strpos(context,z)-1),',') AS starts FROM a")
def locate_all_answers(s, d):
    at = X.locate_all(F.col("context"), F.slice(X.sentences(F.col("context")), 1, 3), F.lit(-1))
    return fx.examples(s, d).select("qid", F.concat_ws(",", F.transform(at, lambda n: n.cast("string"))).alias("starts"))


@query("SELECT doc_id, md5(replace(text,'e','_')) AS joined, md5(replace(replace(text,'e','_'),'_',' ')) AS digest FROM documents")
def desegmented(s, d):
    t = F.replace("text", F.lit("e"), F.lit("_"))
    return _docs(s, d).select("doc_id", F.md5(t).alias("joined"), F.md5(X.desegment(t)).alias("digest"))


@query("SELECT doc_id, md5(regexp_replace(translate(strip_accents(text),'đĐ','dD'),'[^\\x00-\\x7F]','','g')) AS digest FROM documents")
def ascii_folded(s, d):
    return _docs(s, d).select("doc_id", F.md5(X.ascii_fold(F.col("text"))).alias("digest"))


@query()
def nfkc_digest(s, d):
    return _docs(s, d).select("doc_id", X.nfkc_md5(F.col("text")).alias("digest"))


@query(f"""{S.SCORED}, u AS (SELECT qid FROM (SELECT qid, row_number() OVER (ORDER BY md5('42:'||qid)) AS k FROM ex) WHERE k<=50) SELECT system, count(*) AS n, round(100*avg(em),6) AS em, round(100*avg(f1),6) AS f1, count(*) FILTER (NOT is_impossible) AS n_answerable, round(coalesce(100*avg(em) FILTER (NOT is_impossible),0),6) AS em_answerable, round(coalesce(100*avg(f1) FILTER (NOT is_impossible),0),6) AS f1_answerable,
count(*) FILTER (is_impossible) AS n_impossible, round(coalesce(100*avg(em) FILTER (is_impossible),0),6) AS em_impossible, round(coalesce(100*avg(f1) FILTER (is_impossible),0),6) AS f1_impossible FROM items SEMI JOIN u USING (qid) GROUP BY 1""")
def checkpoint_scores(s, d):
    ex = fx.examples(s, d)
    return scoring.checkpoint_scores(ex, fx.predictions(ex), 50)[0]


@query(f"{S.SCORED} SELECT system, qid, error FROM (SELECT system, qid, error, row_number() OVER (PARTITION BY system ORDER BY md5('42:'||system||':'||qid)) AS k FROM cls WHERE error IS NOT NULL) WHERE k<=10")
def error_sample(s, d):
    return diagnosis.error_sample(_items(s, d), 10).select("system", "qid", "error")


@query(f"WITH {S.CURVES}, f AS (SELECT run, first(train_loss ORDER BY epoch) AS l, min(epoch) AS e FROM cv GROUP BY 1) SELECT run, bool_or(epoch>e AND train_loss>1.02*l) AS collapsed FROM cv JOIN f USING (run) GROUP BY 1")
def collapsed_runs(s, d):
    return training.collapsed(fx.curves(s, d).select("run", "epoch", F.col("train_loss").alias("loss")), 1.02)


@query(f"{S.SCORED}, c AS (SELECT system, round(100*avg(f1),6) AS f1, count(*) AS n FROM items GROUP BY 1) SELECT system, floor(10*f1)/10 AS floored, {S.case([('f1<0.1', S.q('<0,001'))], 'replace(format(' + S.q('{:.3f}') + ",f1/100),'.',',')")} AS p, '['||{S.locale('f1', 2)}||'; '||{S.locale('f1+1', 2)}||']' AS interval, CASE WHEN system='abstain' THEN n ELSE f1 END::DOUBLE AS either FROM c")
def report_values(s, d):
    c = scoring.corpus_scores(_items(s, d)).select("system", "f1", F.col("n").cast("double").alias("n"))
    tuned = c.where("system <> 'abstain'").select("system", F.col("f1").alias("v"))
    c = c.join(report.coalesced(tuned, c.select("system", F.col("n").alias("v")), ["system"], ["v"]), "system")
    return c.select("system", report.floored(F.col("f1")).cast("double").alias("floored"), X.p_value(F.col("f1") / 100).alias("p"), X.interval_text(F.col("f1"), F.col("f1") + 1).alias("interval"), F.col("v").alias("either"))


@query(f"{S.SCORED} SELECT '| '||system||' | '||qid||' | '||kind||' |' AS line FROM (SELECT system, qid, kind, row_number() OVER (PARTITION BY kind ORDER BY system||qid) AS k FROM (SELECT system, qid, CASE WHEN error='wrong_span' THEN 'wrong' WHEN error LIKE 'boundary%' THEN 'edge' WHEN em=1 THEN 'right' END AS kind FROM cls)) WHERE kind IS NOT NULL AND k<=5")
def sample_lines(s, d):
    c = diagnosis.classified(_items(s, d)).withColumn("key", F.concat("system", "qid"))
    kinds = [("wrong", F.col("error") == "wrong_span"), ("edge", F.col("error").startswith("boundary")), ("right", F.col("em") == 1)]
    return report.markdown(report.first_per_kind(c, kinds, "key", 5), ["system", "qid", "kind"])


_ESC = "replace(replace(replace(replace(replace({x},'&','&amp;'),'<','&lt;'),'>','&gt;'),'\"','&quot;'),'''','&#x27;')"


@query(f"""SELECT page_id, CASE WHEN coalesce(html,'')='' THEN '??' ELSE md5(array_to_string(list_transform(string_split(html,'<p'), lambda p: array_to_string(list_transform(string_split(p,'p>'), lambda r: array_to_string(list_transform(string_split(r,'a'), lambda z: {_ESC.format(x='z')}),'<mark class=''c''>a</mark>')),'<mark class=''pred''>p&gt;</mark>')),'<mark class=''gold''>&lt;p</mark>')) END AS digest FROM pages""")
def highlighted(s, d):
    """Phrases that overlap, need escaping, or stand in one another: what an earlier one marks is not marked again."""
    marked = X.highlight(F.col("html"), [(F.lit("<p"), "gold"), (F.lit(""), "none"), (F.lit("p>"), "pred"), (F.lit("a"), "c")])
    return fx.table(s, d, "pages").select("page_id", F.when(marked == "??", marked).otherwise(F.md5(marked)).alias("digest"))


# the older evaluation


def _legacy_sql(prediction: str) -> str:
    words = lambda x: f"list_filter(string_split({S.legacy_norm(x)},' '), lambda w: w<>'')"
    return f"""{S.WITH_EX}, {S.PRED}, raw AS (SELECT system, qid, CASE WHEN ex.turn%3=0 THEN prediction||'$ ' ELSE replace(prediction,' ','_') END AS prediction, answers, ex.turn FROM pred JOIN ex USING (qid)),
sides AS (SELECT *, {words(prediction)} AS p, {words("coalesce(answers[1],'')")} AS g FROM raw), ls AS (SELECT *, (p=g)::DOUBLE AS em, CASE WHEN {S.common('p', 'g')}=0 THEN 0.0::DOUBLE ELSE {S.f1('p', 'g')} END AS f1, ({S.trim('prediction')}='')::INT AS blank FROM sides)"""


def _legacy_rows(s, d):
    """Predictions with a mark of currency, or with words joined by _, as segmented models have them."""
    ex = fx.examples(s, d)
    rows = fx.predictions(ex).join(ex.select("qid", "turn", F.col("answers").alias("golds")), "qid")
    return rows.withColumn("prediction", F.when(F.col("turn") % 3 == 0, F.concat("prediction", F.lit("$ "))).otherwise(F.replace("prediction", F.lit(" "), F.lit("_"))))


@query(_legacy_sql("prediction") + " SELECT system, count(*) AS n, round(100*avg(CASE WHEN len(answers)>0 THEN em ELSE 0 END),6) AS em, round(100*avg(CASE WHEN len(answers)>0 THEN f1 ELSE 0 END),6) AS f1 FROM ls GROUP BY 1")
def legacy_scores(s, d):
    return scoring.legacy_scores(_legacy_rows(s, d))


@query(_legacy_sql("replace(prediction,'_',' ')") + " SELECT system, round(100*avg(CASE WHEN len(answers)>0 THEN em ELSE blank END),4) AS exact_match, round(100*avg(CASE WHEN len(answers)>0 THEN f1 ELSE blank END),4) AS f1, count(*) AS total FROM ls WHERE turn%4=0 GROUP BY 1")
def legacy_span_metrics(s, d):
    """Predictions of some turns have no reference."""
    return scoring.legacy_span_metrics(_legacy_rows(s, d).withColumn("golds", F.when(F.col("turn") % 4 == 0, F.col("golds"))), word_level=True)


@query(_legacy_sql("prediction") + " SELECT system, coalesce(avg(len(p)) FILTER (len(answers)>0),0) AS pred_avg_length, coalesce(avg(len(g)) FILTER (len(answers)>0),0) AS gt_avg_length FROM ls GROUP BY 1")
def legacy_lengths(s, d):
    return scoring.legacy_lengths(_legacy_rows(s, d))
