"""The corpus pipeline: quality rules, near-duplicates, pseudonyms, source mixing, packing.

Edge cases, by stage: quality rules drop null, empty and short texts; near duplicates keep one of equal
or near texts also where their ids are null or repeated; pseudonyms keep every row; the mix may take a
document up to three times or not at all, so rows with one doc_id follow; packing gives a piece its
document's id, null where it has none. An empty table stays empty. Columns of any name pass through all
stages but the last, which returns its own. Null languages and sources are groups of their own.
"""

from __future__ import annotations

import secrets
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import common, mixing, packing, pii, quality, simhash

#: The setting that holds the key of the pseudonyms; Spark keeps settings with "secret" in their names out of its logs.
KEY = "spark.spanforge.secret"


@lru_cache
def _random_key(application: str) -> bytes:
    """A key of this application alone, where none is set: its runs agree, and nobody can undo the pseudonyms later."""
    return secrets.token_bytes(32)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the robust outlier test keep."""
    return quality.screen(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of linked fingerprints."""
    return simhash.deduplicated(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal numbers, dates and addresses under pseudonyms; n_chars follows the text."""
    key = spark.conf.get(KEY, None)
    out = pii.pseudonymise(docs, key.encode() if key else _random_key(spark.sparkContext.applicationId))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("pseudonyms", pseudonyms), ("source mix", source_mix), ("packing", pack)]

#: Encoding, fingerprints and the flight of the cube method have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`; each one's result is written as Parquet and read again."""
    common.ready(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        since = common.mark()
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = common.new_path(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            common.release(spark, since, keep=(path,))
            if before:
                common.remove(spark, before)  # what this stage has read
            before = path
    return docs
