"""Operator 1: exact length histogram of a corpus in tokens.

Documents are aggregated by their encoded length, inside each Python worker first, so that the
shuffle holds at most one row per task and length. Suffix sums over the histogram then answer
totals, quantiles and truncated totals for every context limit without another scan.

Edge cases: a null or empty text has length 0; repeated rows count each; an empty table gives an
empty histogram; other columns are not read. Only the text column matters, so null or clashing
columns change nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.llm import common, tokens

#: Lengths in a block of the two-level suffix sums.
BLOCK = 1024


def length_histogram(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(length long, n_docs long): documents of each encoded length, no special tokens added."""
    path = tokenizer or tokens.default_path()

    def counted(batches):
        total: dict[int, int] = {}
        for batch in batches:
            for _, _, sizes in tokens.encoded(batch.column(0), path):
                for length, n in zip(*np.unique(sizes, return_counts=True), strict=True):
                    total[int(length)] = total.get(int(length), 0) + int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["length", "n"])

    rows = common.map_arrow(docs.select(F.col("text").cast("string").alias("text")), counted, "length long, n long")
    return rows.groupBy("length").agg(F.sum("n").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length: documents and tokens of that length or more, and totals under it as a limit.

    docs_at_least, tokens_at_least: over documents of this length or longer. docs_longer: those
    that a limit of this length would cut. tokens_kept: tokens of the corpus when every document
    is truncated to this length. The sums run over blocks of lengths first and then inside each
    block, so no task holds the whole histogram.
    """
    # the histogram is small, but it comes from a whole scan: it is made once
    h = common.cut(histogram.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.expr(f"length div {BLOCK}").alias("block")))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_after"), F.sum("t").over(everything).alias("t_all"), F.sum("d").over(everything).alias("d_all"))
    inside = Window.partitionBy("block").orderBy(F.desc("length"))
    out = h.join(blocks, "block").select(
        "length", "n_docs", "n_tokens", "d_all", "t_all",
        (F.col("d_after") + F.sum("n_docs").over(inside)).alias("docs_at_least"),
        (F.col("t_after") + F.sum("n_tokens").over(inside)).alias("tokens_at_least"),
    )
    return out.select(
        "length", "n_docs", "n_tokens", "docs_at_least", "tokens_at_least",
        (F.col("docs_at_least") - F.col("n_docs")).alias("docs_longer"),
        (F.col("t_all") - F.col("tokens_at_least") + F.col("n_tokens") + F.col("length") * (F.col("docs_at_least") - F.col("n_docs"))).alias("tokens_kept"),
        ((F.col("d_all") - F.col("docs_at_least") + F.col("n_docs")) / F.col("d_all")).alias("share_not_longer"),
    )


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Tokens of the corpus when each document is cut to `limit` tokens, from the suffix sums of one row."""
    above = sums.where(F.col("length") > limit).agg(F.min_by(F.struct("docs_at_least", "tokens_at_least"), "length").alias("x"), F.lit(0).alias("k"))
    total = sums.agg(F.max("tokens_at_least").alias("t"))
    row = above.crossJoin(total).first()
    if row["t"] is None:
        return 0
    return row["t"] if row["x"] is None else row["t"] - row["x"]["tokens_at_least"] + limit * row["x"]["docs_at_least"]


def length_quantile(sums: DataFrame, q: float) -> int | None:
    """The least length that a share q of all documents do not exceed; None for an empty corpus."""
    return sums.where(F.col("share_not_longer") >= F.lit(float(q))).agg(F.min("length")).first()[0]
