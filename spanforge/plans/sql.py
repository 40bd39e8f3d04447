"""Pieces of DuckDB SQL that say what the operators compute; the oracle queries are made of them."""

from __future__ import annotations

from spanforge.functions import text as X


def tok(x: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace(lower(coalesce({x},'')),'\pP','','g'),'[\s\x1c-\x1f]+'), lambda t: t<>'')"


def norm(x: str) -> str:
    return f"array_to_string({tok(x)},' ')"


def trim(x: str) -> str:
    return rf"regexp_replace({x},'^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$','','g')"


def sent(x: str) -> str:
    once = lambda y: rf"regexp_replace({y},'((?:^|[^0-9])[.!?])\s+','\1'||chr(1),'g')"
    marked = once(once(f"coalesce({x},'')"))
    return f"list_filter(list_transform(string_split({marked},chr(1)), lambda z: {trim('z')}), lambda z: z<>'')"


def words(x: str) -> str:
    return rf"list_filter(string_split_regex({x},'[\s\x1c-\x1f]+'), lambda t: t<>'')"


def common(p: str, g: str) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct({p}), lambda t: least(len(list_filter({p}, lambda y: y=t)), len(list_filter({g}, lambda y: y=t))))),0)"


def f1(p: str, g: str) -> str:
    """Of two token-list columns."""
    c = common(p, g)
    return f"CASE WHEN len({p})=0 OR len({g})=0 THEN (len({p})=len({g}))::DOUBLE WHEN {c}=0 THEN 0.0::DOUBLE ELSE 2*({c}::DOUBLE/len({p}))*({c}::DOUBLE/len({g}))/(({c}::DOUBLE/len({p}))+({c}::DOUBLE/len({g}))) END"


def case(rules: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rules) + f" ELSE {other} END"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


EX = f"""ex AS (SELECT *, CASE WHEN len(answers)>0 THEN strpos(context,answers[1])-1 ELSE -1 END AS answer_start FROM (
  SELECT conv_id*1000+turn AS ord, 'c'||conv_id||'-'||turn AS qid, text AS question, nxt AS context, 'c'||conv_id AS title, conv_id%3=0 AS is_impossible, turn,
    CASE WHEN conv_id%3=0 THEN CAST([] AS VARCHAR[]) ELSE ({sent('nxt')})[1:1] END AS answers
  FROM (SELECT *, lead(role) OVER w AS nrole, lead(text) OVER w AS nxt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) t0
  WHERE role='user' AND nrole='assistant') t1)"""

PRED = f"""ss AS (SELECT qid, turn, {sent('context')} AS s FROM ex),
pred AS (SELECT 'abstain' AS system, qid, '' AS prediction FROM ss
  UNION ALL SELECT 'first_sentence', qid, coalesce(s[1],'') FROM ss
  UNION ALL SELECT 'first3', qid, array_to_string(({tok("coalesce(s[1],'')")})[1:3],' ') FROM ss
  UNION ALL SELECT 'two_sentences', qid, array_to_string(s[1:2],' ') FROM ss
  UNION ALL SELECT 'last_sentence', qid, coalesce(s[len(s)],'') FROM ss
  UNION ALL SELECT 'gated', qid, CASE WHEN turn%4=0 THEN coalesce(s[1],'') ELSE '' END FROM ss)"""

ITEMS = f"""it0 AS (SELECT system, qid, prediction, answers AS golds, is_impossible, title, context, question, turn, ord, {tok('prediction')} AS p, {tok("CASE WHEN len(answers)=0 THEN '' ELSE answers[1] END")} AS g FROM pred JOIN ex USING (qid)),
items AS (SELECT *, (array_to_string(p,' ')=array_to_string(g,' '))::DOUBLE AS em, {f1('p', 'g')} AS f1 FROM it0),
cls AS (SELECT *, CASE WHEN em=1 THEN NULL WHEN len(golds)=0 THEN 'false_answer' WHEN len(p)=0 THEN 'false_abstain' WHEN len(list_intersect(p,g))=0 THEN 'wrong_span'
  WHEN strpos(array_to_string(p,' '),array_to_string(g,' '))>0 THEN 'boundary_superset' WHEN strpos(array_to_string(g,' '),array_to_string(p,' '))>0 THEN 'boundary_subset' ELSE 'boundary_overlap' END AS error FROM items)"""

SCORED = f"WITH {EX}, {PRED}, {ITEMS}"
WITH_EX = f"WITH {EX}"

LOCATED = "loc AS (SELECT d.doc_id, b.item_id, d.text AS context, b.text AS answer, position(b.text IN d.text)-1 AS answer_start FROM documents d JOIN benchmark b ON position(b.text IN d.text)>0 AND length(b.text)>0)"

PAIRED = "pr AS (SELECT doc_id AS qid, (quality=1)::DOUBLE AS em_a, (toxic=0)::DOUBLE AS em_b, source AS cluster FROM labels JOIN documents USING (doc_id))"

#: Valid pairs of each window, with the null score; context tokens 8 to 59, 12 tokens at most.
LOGITS = """lg AS (SELECT label AS qid, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS window_ix, list_transform(embedding, lambda v: v::DOUBLE) AS st FROM embeddings WHERE embedding IS NOT NULL),
prs AS (SELECT qid, window_ix, st[1]+st[64] AS null_score, i AS s, i+k AS e, st[i+1]+st[64-(i+k)] AS score FROM lg, range(8,60) r(i), range(0,12) o(k) WHERE i+k<60),
best AS (SELECT qid, window_ix, any_value(null_score) AS null_score, first(s ORDER BY score DESC, s, e) AS s, first(e ORDER BY score DESC, s, e) AS e, max(score) AS score FROM prs GROUP BY 1,2),
win AS (SELECT *, null_score-score AS delta FROM best)"""

#: Scores of each window's answer: gold is the first window's span, questions with an odd label have none.
TAU = LOGITS + """, gold AS (SELECT qid, s AS gs, e AS ge FROM win WHERE window_ix=1),
tw AS (SELECT w.*, qid%2=1 AS is_impossible, CASE WHEN qid%2=1 THEN 0.0 ELSE (s=gs AND e=ge)::DOUBLE END AS em,
  CASE WHEN qid%2=1 OR least(e,ge)-greatest(s,gs)+1<=0 THEN 0.0 ELSE 2.0*(least(e,ge)-greatest(s,gs)+1)/((e-s+1)+(ge-gs+1)) END AS f1 FROM win w JOIN gold USING (qid)),
ab AS (SELECT DISTINCT qid, (qid%2=1)::DOUBLE AS em0, (qid%2=1)::DOUBLE AS f10 FROM win),
taus AS (SELECT DISTINCT tau FROM (SELECT unnest([-delta-1e-6,-delta+1e-6]) AS tau FROM win UNION ALL SELECT 0.0))"""

STEPS = "sp AS (SELECT event_type AS run, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step, value AS loss, event_id%3=0 AS is_cls FROM events)"

CURVES = "cv AS (SELECT event_type AS run, day(ts)::INT AS epoch, round(avg(value),6) AS train_loss, round(avg((value%7)*10),6) AS val_em, round(avg((value%11)*10),6) AS val_f1 FROM events GROUP BY 1,2)"

SPLITS = """dk AS (SELECT md5('42:'||text) AS d, row_number() OVER (ORDER BY md5('42:'||text)) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT text FROM documents)),
sp0 AS (SELECT doc_id, text AS context, source, lang, CASE WHEN rk<=floor(0.2::DOUBLE*n) THEN 'validation' ELSE 'train' END AS split FROM documents JOIN dk ON d=md5('42:'||text)),
lk AS (SELECT max(doc_id) AS doc_id FROM documents GROUP BY text HAVING count(*)>1),
spl AS (SELECT doc_id, context, source, lang, split FROM sp0 UNION ALL SELECT doc_id, context, source, lang, CASE WHEN split='train' THEN 'validation' ELSE 'train' END FROM sp0 JOIN lk USING (doc_id))"""

REVIEWS = "rv AS (SELECT doc_id AS qid, CASE WHEN quality=1 THEN 'ok' ELSE 'loai' END AS nguoi_1, CASE WHEN toxic=0 THEN 'ok' ELSE 'loai' END AS nguoi_2 FROM labels)"


def legacy_norm(x: str) -> str:
    marks = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
    return f"array_to_string({words(f'''translate(lower({x}),'{marks}','')''')},' ')"


def question_class(x: str) -> str:
    w = rf"(' '||regexp_replace(lower({x}),'^[ ?]+|[ ?]+$','','g')||' ')"
    return case([(f"strpos({w},{q(k)})>0", q(v)) for k, v in X.QUESTION_WORDS], q(X.OTHER_QUESTION))


def any_of(x: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"strpos(lower({x}),{q(p)})>0" for p in patterns) + ")"


def locale(x: str, digits: int) -> str:
    return f"coalesce(translate(format('{{:,.{digits}f}}',{x}),',.','.,'),'??')"


#: Sentence spans as (s, e) by characters, for texts without white space at their ends.
def boundary_marks(x: str) -> str:
    cut = r"([.!?…][\"”’)\]]*)(\s+)([\"“‘(\[]?[A-ZÀ-Ỹ0-9Đ])"
    once = lambda y: f"regexp_replace({y},{q(cut)},'\\1'||chr(1)||'\\2\\3','g')"
    return once(f"({x})")
