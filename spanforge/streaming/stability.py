"""The loss-stability check as a Structured Streaming query with per-run state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanforge.runtime import new_path, ready, saved

OUT = "run string, n_steps bigint, max_rise double, first_violation bigint, n_waiting bigint, n_late bigint"
STATE = "recent array<double>, total double, least double, n bigint, max_rise double, first bigint, next bigint, steps array<bigint>, losses array<double>, late bigint"
#: Steps of a run that wait for a missing one before it is given up.
PATIENCE = 10_000
#: Steps that a replayed one comes late at most, triggers of a replay at least and steps of a run in a trigger at most.
LATE, TRIGGERS, STEPS = 10_000, 8, 1_000_000


def stability_stream(steps: DataFrame, window: int = 200, tolerance: float = 0.2, first_step: int = 0, patience: int = PATIENCE) -> DataFrame:
    """Updates of (run, n_steps, max_rise, first_violation, n_waiting, n_late) for a stream of (run, step, loss).

    Steps count in their order, from first_step on, whatever the order in which they arrive: one that comes early waits in
    the state for those before it. Once more than `patience` wait, the missing steps are given up; should they
    still come, or a step come twice, they are late and only counted as such. The state is the last `window` losses, the
    waiting steps and a few numbers, whatever the run's length.
    """

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, total, least, n, rise, first, coming, held, losses, late = state.get if state.exists else ([], 0.0, float("inf"), 0, 0.0, -1, first_step, [], [], 0)
        recent, waiting = list(recent), dict(zip(held, losses, strict=True))
        new = pd.concat(list(frames))
        for step, loss in zip(new["step"].tolist(), new["loss"].tolist(), strict=True):
            if step < coming or step in waiting:
                late += 1
            else:
                waiting[step] = loss
        while waiting and (coming in waiting or len(waiting) > patience):
            if coming not in waiting:
                coming = min(waiting)
            loss = float(waiting.pop(coming))
            coming += 1
            recent.append(loss)
            total += loss
            if len(recent) > window:
                total -= recent.pop(0)
            if len(recent) == window:
                least = min(least, total / window)
                now = round(total / window - least, 9)
                rise = max(rise, now)
                if now > tolerance and first < 0:
                    first = n
            n += 1
        state.update((recent, total, least, n, rise, first, coming, list(waiting), list(waiting.values()), late))
        yield pd.DataFrame({"run": [key[0]], "n_steps": [n], "max_rise": [round(rise, 6)], "first_violation": [first], "n_waiting": [len(waiting)], "n_late": [late]})

    return steps.select("run", "step", "loss").groupBy("run").applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def delayed(steps: DataFrame, late: int = LATE, triggers: int = TRIGGERS) -> DataFrame:
    """Adds trigger: when a step of a finished table arrives in a replay, by a hash up to `late` steps after its turn."""
    steps = saved(steps, "steps")
    low, high = steps.agg(F.min("step"), F.max("step")).first()
    if low is None:
        return steps.withColumn("trigger", F.lit(0))
    span = high - low + late
    n = max(triggers, -(-span // STEPS))
    arrival = F.col("step") - low + F.pmod(F.xxhash64("run", "step"), F.lit(late))
    return steps.withColumn("trigger", F.floor(arrival * n / F.lit(span)).cast("int"))


def run_to_end(steps: DataFrame, window: int = 200, tolerance: float = 0.2, first_step: int = 0, patience: int = PATIENCE, files_per_trigger: int | None = None) -> DataFrame:
    """Runs the stream over a finished step table and returns each run's last update.

    The table goes through a shared folder as a file stream, a partition a file; every update is written there too, and
    the last one of a run is that of the last trigger that had its steps. Steps with a trigger (see `delayed`) are
    written in its order, a file each.
    """
    spark = ready(steps.sparkSession)
    path = new_path(spark, "stability")
    one = steps.select("run", "step", "loss")
    if "trigger" in steps.columns:
        one.limit(0).write.parquet(f"{path}/in")
        for k in sorted(r[0] for r in steps.select("trigger").distinct().collect()):  # files are read in the order in which they were written
            steps.where(F.col("trigger") == k).select("run", "step", "loss").coalesce(1).write.mode("append").parquet(f"{path}/in")
    else:
        one.write.parquet(f"{path}/in")
    source = spark.readStream.schema(one.schema)
    source = source.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else source
    out = stability_stream(source.parquet(f"{path}/in"), window, tolerance, first_step, patience)
    q = out.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{path}/out/batch={k}")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(OUT + ", batch bigint").option("basePath", f"{path}/out").parquet(f"{path}/out")
    return rows.groupBy("run").agg(F.max_by(F.struct("n_steps", "max_rise", "first_violation", "n_waiting", "n_late"), "batch").alias("x")).select("run", "x.*")
