"""What the corpus operators share: shared-folder tables, binary file output and connected components."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.runtime import cut, mark, new_path, ready, release, remove, saved, shared_dir, size_of

#: ASCII white space as the contracts define it; everything else belongs to a word.
WORD_SPACE = " \\t\\n\\x0B\\f\\r"
WORD = f"[^{WORD_SPACE}]+"


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow; Spark bounds its batches in rows and in bytes."""
    ready(df.sparkSession)
    return df.mapInArrow(fn, schema)


#: Bytes after which a writer of binary files begins a new one; a file is one record longer at most.
FILE_BYTES = 64 << 20


def files_of(records, head, separator: bytes, size: int):
    """(one binary value of a batch) for each file of a task: head(k) and the records, joined by the separator, up to about `size` bytes."""
    held, n, k = [], 0, 0
    for r in records:
        if not held:
            held.append(head(k))
            n = len(held[0])
        r = r(n) if callable(r) else r
        held.append(r)
        n += len(r) + len(separator)
        if n >= size:
            yield pa.RecordBatch.from_arrays([pa.array([separator.join(held)], pa.large_binary()).cast(pa.binary())], ["data"])
            held, k = [], k + 1
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([separator.join(held)], pa.binary())], ["data"])


def write_blobs(df: DataFrame, column: str, path: str, separator: bytes) -> None:
    """Writes binary values as raw files, one each with `separator` after it, through Spark's own committer.

    Any Hadoop file system will do, and a task that runs twice leaves one file. The text sink
    puts a string's bytes out as they are, so a binary value cast to a string is not changed.
    """
    out = df.select(F.col(column).cast("string").alias("value"))
    out.write.option("encoding", "ISO-8859-1").option("lineSep", separator.decode("latin-1")).option("maxRecordsPerFile", 1).text(path)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of each file; the writers bound a file's size, whatever that of the table."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of an edge table (a, b: long), by local contraction.

    In each round a node joins the neighbour with the least hash (itself included), the joined
    nodes become one, and edges inside it go. Hashes change by the round, so that chains shrink
    by a constant share. Every step is a join or an aggregate with partial sums; nothing is
    gathered in one task. Tables between steps are files of known size: small ones are broadcast,
    and of large ones adaptive execution splits what meets a hot hub.
    Nodes that are null or only linked to themselves are not returned.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    e = saved(e.where("a is not null and b is not null and a <> b").distinct(), "edges")
    names = None
    rounds = 0
    while not e.isEmpty():
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(rounds)).alias("h"), F.col(c).alias("n"))
        least = both.groupBy("u").agg(F.min(rank("v")).alias("m"))
        step = saved(least.select("u", F.least(F.col("m"), rank("u"))["n"].alias("to")), "step")
        a = step.select(F.col("u").alias("a"), F.col("to").alias("ta"))
        b = step.select(F.col("u").alias("b"), F.col("to").alias("tb"))
        e = saved(e.join(a, "a").join(b, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        if names is None:
            names = step.select(F.col("u").alias("node"), F.col("to").alias("root"))
        else:
            names = saved(names.join(step.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "names")
        rounds += 1
    if names is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return names


def component_names(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, name) of every linked node: the least value (null last) in its component; nodes: (node, value), one row each."""
    roots = connected_components(edges)
    valued = saved(roots.join(nodes, "node").select("node", "root", "value"), "rooted")
    least = saved(valued.groupBy("root").agg(F.min("value").alias("name")), "names")
    return valued.join(least, "root").select("node", "name")


#: A key with more than one in so many of the rows is hot; there are fewer hot keys than that.
HOT_SHARE = 256


def join_unique(rows: DataFrame, unique: DataFrame, on: str, total: int, how: str = "inner") -> DataFrame:
    """Joins rows with a table that has each value of `on` once and, as n, how often rows have it; n is dropped.

    A key with more than total / 256 of the rows is dealt over as many shares as it needs, and its row
    of the unique table goes to each of them. The hot keys are fewer than 256 whatever the tables' sizes, so
    they are broadcast; every other key has too few rows to burden a task.
    """
    shares = F.greatest(F.lit(1), F.ceil(F.col("n") * HOT_SHARE / F.lit(max(1, total)))).cast("int")
    hot = unique.where(F.col("n") * HOT_SHARE > total).select(on, shares.alias("__shares"))
    dealt = rows.withColumn("__row", F.monotonically_increasing_id()).join(F.broadcast(hot), on, "left")
    dealt = dealt.withColumn("__share", F.when(F.col("__shares").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("__row"), F.col("__shares")).cast("int"))).drop("__row", "__shares")
    spread = unique.withColumn("__share", F.explode(F.when(F.col("n") * HOT_SHARE > total, F.sequence(F.lit(0), shares - 1)).otherwise(F.array(F.lit(0))))).drop("n")
    return dealt.join(spread, [on, "__share"], how).drop("__share")
