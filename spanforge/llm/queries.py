"""The registered queries of the corpus operators; each reads its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import bpe, centroids, common, embeddings, filter_audit, langid, mixing, packing, pii, quality, rans, simhash, token_counts, warc


#: The key of the registered query op9_pii, so that its results can be compared; not for use on real data.
TEST_KEY = b"a key for tests"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return common.ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.length_histogram(_table(spark, sf_dir, "documents")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    arc, out = common.new_path(spark, "arc"), common.new_path(spark, "warc")
    warc.write_arc(pages, arc)
    warc.convert(spark, arc, out)
    common.remove(spark, arc)
    return warc.read_warc(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(_table(spark, sf_dir, "documents"))


def op7_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "rans")
    rans.write(_table(spark, sf_dir, "documents"), path)
    return rans.read_index(spark, path)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, TEST_KEY, counted=True).withColumn("n_found", sum((F.col(f"n_{k}") for k in pii.KINDS[1:]), F.col(f"n_{pii.KINDS[0]}")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), "ids")
    return bpe.decode(ids).select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_warc, op3_embedding_dedup, op4_simhash, op5_langid, op6_quality, op7_rans, op8_mixing, op9_pii, op10_packing, op11_centroids, op12_filter_audit, op13_bpe)}



def _lloyd_sql(k: int, rounds: int, dims: int, scale: int, seed: int) -> str:
    """Lloyd's rounds, one after the other, on all vectors."""
    near = lambda c: f"""SELECT vec_id, row, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT v.vec_id, v.row, c.k, list_sum(list_transform(range(1,{dims + 1}), lambda i: (v.q[i]-c.q[i])*(v.q[i]-c.q[i])))::BIGINT AS d FROM v, {c} c) GROUP BY 1,2"""
    sql = [f"""WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor({scale}*x::DOUBLE)::BIGINT) AS q FROM embeddings
WHERE embedding IS NOT NULL AND len(embedding)={dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)))=0)""",
           f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, row)-1 AS k, q FROM (SELECT sha256('{seed}:'||vec_id) AS h, row, q FROM v WHERE vec_id IS NOT NULL ORDER BY h, row LIMIT {k}))"]
    for r in range(rounds):
        sql += [f"a{r} AS MATERIALIZED ({near(f'c{r}')})",
                f"m{r} AS MATERIALIZED (SELECT k, list(m ORDER BY i) AS q FROM (SELECT a.k, i, (sum(v.q[i])-((sum(v.q[i])%count(*)+count(*))%count(*)))//count(*) AS m FROM v JOIN a{r} a USING (row), range(1,{dims + 1}) t(i) GROUP BY 1,2) GROUP BY 1)",
                f"c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.q::BIGINT[], c.q) AS q FROM c{r} c LEFT JOIN m{r} m USING (k))"]
    return ",\n".join([*sql, f"a AS MATERIALIZED ({near(f'c{rounds}')})"]) + f"""
SELECT vec_id, a.k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q,',')) AS centroid_sha256,
count(*) OVER (PARTITION BY v.q) AS copies FROM a JOIN v USING (vec_id, row) JOIN c{rounds} c ON c.k=a.k"""


#: The queries that DuckDB can say in SQL over whole tables; the others encode, compress, permute under
#: keys, train or iterate, and tests/llm compares them with brute force or a round trip.
ORACLE: dict[str, str] = {
    "op2_warc": """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html,''))) AS payload_bytes, sha1(coalesce(html,'')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS best FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN payload_bytes>=1000 AND page_id<>best THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes>=1000 AND page_id<>best THEN best END AS refers_to FROM m""",
    "op3_embedding_dedup": """WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
g AS (SELECT vec_id, x, sqrt(list_dot_product(x,x)) AS n FROM e WHERE x IS NOT NULL AND len(x)>0 AND len(list_filter(x, lambda v: v IS NULL OR NOT isfinite(v)))=0 AND list_dot_product(x,x)>0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id<>b.vec_id AND len(a.x)=len(b.x) AND list_dot_product(a.x,b.x)/(a.n*b.n)>=0.95),
r(node, root) AS (SELECT vec_id, vec_id FROM e UNION SELECT l.b, r.root FROM r JOIN l ON l.a=r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a=vec_id) AS n_links, component_id, vec_id=component_id AS kept FROM e JOIN c ON node=vec_id""",
    "op11_centroids": _lloyd_sql(centroids.K, centroids.ROUNDS, centroids.DIMS, centroids.SCALE, centroids.SEED),
    "op12_filter_audit": r"""WITH w AS (SELECT doc_id, coalesce(lang,'') AS part, coalesce(text,'') AS t, regexp_extract_all(coalesce(text,''),'[^\x20\x09-\x0D]+') AS w FROM documents),
lab AS (SELECT doc_id, bool_or(quality=1) AS good, bool_or(toxic=1) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good,false) AS good, coalesce(toxic,false) AS toxic, [len(w)<200, 100*len(list_distinct(w))<50*len(w), 100*(length(t)-length(regexp_replace(t,'[A-Z]','','g')))>3*length(t), regexp_matches(t,'[#$%&*|]'), doc_id>min(doc_id) OVER (PARTITION BY t)] AS fails FROM w LEFT JOIN lab USING (doc_id)),
l AS (SELECT unnest(['A','B','C','D','E']) AS x),
o AS (SELECT a.x||b.x||c.x||d.x||e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE a.x NOT IN (b.x,c.x,d.x,e.x) AND b.x NOT IN (c.x,d.x,e.x) AND c.x NOT IN (d.x,e.x) AND d.x<>e.x),
s AS (SELECT part, good, toxic, filter_order, step, fails[ascii(filter_order[step])-64] AS fail, len(list_filter(range(1,step), lambda i: fails[ascii(filter_order[i])-64]))>0 AS gone, len(list_filter(fails, lambda y: y)) AS n FROM f, o, range(1,6) r(step)),
g AS (SELECT part, filter_order, step::INT AS step, filter_order[step] AS filter, count(*) FILTER (NOT gone AND NOT fail) AS kept, count(*) FILTER (fail AND NOT gone) AS removed, count(*) FILTER (fail AND gone) AS redundant,
count(*) FILTER (fail AND n=1) AS unique_fails, count(*) FILTER (fail AND NOT gone AND good) AS good_lost, count(*) FILTER (fail AND NOT gone AND toxic) AS toxic_lost FROM s GROUP BY 1,2,3,4)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM g""",
}
