"""Experiences: runs cut from an event log by its pauses, their steps, and the look-up of past ones for a task type.

The log looked up is a table with ``seq`` (insertion order), ``task_type`` and the string arrays
``successful_steps`` and ``failures``; append to it with ``save_table(mode="append")``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import col
from ..functions.scratch import materialize

MAX_HEURISTICS = 5
#: Columns of the steps that the functions below need.
STEP = ("owner", "at", "step_id", "task_type", "step", "success", "message", "insight")


def dataset_signature(df: DataFrame) -> str:
    """The first 12 hex digits of the md5 of the sorted column names joined by ``_``, as in ``schema_fingerprint``."""
    return hashlib.md5("_".join(sorted(df.columns)).encode()).hexdigest()[:12]


def _parts(steps: DataFrame, gap: int) -> DataFrame:
    """Steps with their part: what a day holds of a run. A day of an owner is the most that one task sorts."""
    timed = steps.select(*[col(c) for c in STEP]).where("owner is not null and at is not null")
    timed = timed.withColumn("at", F.col("at").cast("timestamp")).withColumn("_day", F.date_trunc("day", "at"))
    order = Window.partitionBy("owner", "_day").orderBy("at", "step_id")
    paused = F.unix_micros("at") - F.unix_micros(F.lag("at").over(order)) >= gap
    begun = timed.withColumn("_new", F.when(F.coalesce(paused, F.lit(True)), F.col("at")))
    parted = begun.withColumn("_part", F.last("_new", ignorenulls=True).over(order))
    inside = Window.partitionBy("owner", "_day", "_part").orderBy("at", "step_id")
    return materialize(parted.select(
        *STEP, "_day", "_part", F.row_number().over(inside).alias("_place"), F.lag("success").over(inside).alias("_before")))


def _sums() -> list[Column]:
    key = F.struct("at", "step_id")
    failed, recovered = ~F.col("success"), F.col("success") & ~F.coalesce("_before", F.lit(True))
    return [
        F.max("at").alias("_last"), F.count("*").alias("_n"), F.count_if(failed).alias("_failures"), F.count_if(recovered).alias("_recoveries"),
        F.count("insight").alias("_insights"), F.min_by("task_type", key).alias("_task"), F.min_by("success", key).alias("_first_ok"), F.max_by("success", key).alias("_last_ok"),
    ]


def _runs(parts: DataFrame, gap: int) -> DataFrame:
    """Every part with the run it is of (owner, run_start), the steps of the run before it, and how they ended.

    Only a part that comes near an edge of its day can go on in another; these are merged by ``session_window``, with a gap as long
    as the part and the pause together. That leaves two rows a day and owner at most for one task, however busy the owner.
    """
    day = F.unix_micros("_day")
    length = F.unix_micros("_last") - F.unix_micros("_part")
    next_day = F.unix_micros(F.col("_day") + F.expr("interval 1 day"))
    near = (F.unix_micros("_part") - day < gap) | (next_day - F.unix_micros("_last") <= gap)
    found = parts.groupBy("owner", "_day", "_part").agg(*_sums()).withColumn("_near", near)
    found = materialize(found)
    # Windows that touch are merged too, so one microsecond less: a pause as long as the gap ends a run.
    until = F.concat((length + gap - 1).cast("string"), F.lit(" microseconds"))
    merged = found.where("_near").groupBy("owner", F.session_window("_part", until)).agg(
        F.min("_part").alias("run_start"), F.collect_list(F.struct("_day", "_part")).alias("_all"))
    known = merged.select("owner", "run_start", F.inline("_all"))
    named = found.where("_near").join(known, ["owner", "_day", "_part"]).unionByName(found.where("not _near").withColumn("run_start", F.col("_part")))
    order = Window.partitionBy("owner", "run_start").orderBy("_part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return materialize(named.withColumns({
        "_offset": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_came": F.lag("_last_ok").over(order)}))


def _micros(gap_minutes: float) -> int:
    gap = round(gap_minutes * 60_000_000)
    if gap < 2:
        raise ValueError("a pause that ends a run takes some microseconds at least")
    return gap


def experiences(steps: DataFrame, signature: str, gap_minutes: float = 30) -> DataFrame:
    """One row per run: what an owner does until a pause of ``gap_minutes`` or more.

    ``steps`` has the columns of ``STEP``; steps without owner or time are left out, equal times are ordered by step_id. owner, run_start, run_end,
    task_type (of the first step), dataset_signature, steps, failures, recoveries (successful steps right behind a failure) and insights are
    numbers of rows of ``experience_steps``. No list of steps is built, and no window or task ever holds more of an owner than a day.
    """
    gap = _micros(gap_minutes)
    parts = _runs(_parts(steps, gap), gap)
    joined = F.col("_first_ok") & ~F.coalesce("_came", F.lit(True))  # a recovery across the end of a day
    return parts.groupBy("owner", "run_start").agg(
        F.max("_last").alias("run_end"), F.min_by("_task", "_part").alias("task_type"), F.lit(signature).alias("dataset_signature"),
        F.sum("_n").alias("steps"), F.sum("_failures").alias("failures"), (F.sum("_recoveries") + F.count_if(joined)).alias("recoveries"),
        F.sum("_insights").alias("insights"))


def experience_steps(steps: DataFrame, gap_minutes: float = 30) -> DataFrame:
    """One row per step: owner, run_start, position (from 1), step_id, at, step, outcome, note.

    outcome is failed, recovered (it went well right behind a failure of the same run) or done; the note is the message of a failure and the
    insight of a success. Runs as in ``experiences``.
    """
    gap = _micros(gap_minutes)
    parts = _parts(steps, gap)
    runs = _runs(parts, gap).select("owner", "_day", "_part", "run_start", "_offset", "_came")
    found = parts.join(runs, ["owner", "_day", "_part"])
    before = F.when(F.col("_place") == 1, F.col("_came")).otherwise(F.col("_before"))
    outcome = F.when(~F.col("success"), "failed").when(~F.coalesce(before, F.lit(True)), "recovered").otherwise("done")
    return found.select(
        "owner", "run_start", (F.col("_offset") + F.col("_place")).alias("position"), "step_id", "at", "step", outcome.alias("outcome"),
        F.when(F.col("success"), F.col("insight")).otherwise(F.col("message")).alias("note"))


def experience_topk(tasks: DataFrame, log: DataFrame, k: int = 2) -> DataFrame:
    """(task_type, experiences, heuristics) for each task type asked for.

    The first k experiences of the type in insertion order, or the first k of the whole
    log if it has none. The rank filter keeps k rows per type and task before the shuffle,
    so no type is ever sorted whole.
    """
    order = Window.partitionBy("task_type").orderBy("seq")
    entry = F.struct("seq", "successful_steps", "failures")
    own = (
        log.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
        .groupBy("task_type").agg(F.array_sort(F.collect_list(entry)).alias("_own"))
    )
    anyone = log.orderBy("seq").limit(k).agg(F.array_sort(F.collect_list(entry))).scalar()
    matched = tasks.select("task_type").distinct().join(own, "task_type", "left").select(
        "task_type", F.coalesce("_own", anyone).alias("_found")
    )
    lines = F.flatten(F.transform("_found", lambda e: F.concat(
        F.coalesce(e["successful_steps"], F.array().cast("array<string>")),
        F.transform(
            F.coalesce(e["failures"], F.array().cast("array<string>")), lambda f: F.concat(F.lit("Caution: "), f)
        ),
    )))
    return matched.select(
        "task_type", F.transform("_found", lambda e: e["seq"]).alias("experiences"),
        F.slice(lines, 1, MAX_HEURISTICS).alias("heuristics"),
    )
