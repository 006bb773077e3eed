"""Ordered attempts of a task: carry-forward, stop at first success, best so far, ranking, hold-out.

Inputs have task_id, iteration and what each function names; every order is total and explicit. Values that run over all of a task's attempts
come from :mod:`scan`, so that a task of any size is spread; windows by task are used only where few attempts of each task are left."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lodestrata.operators import scan


def _task() -> WindowSpec:
    return Window.partitionBy("task_id").orderBy("iteration")


def _before() -> WindowSpec:
    return _task().rowsBetween(Window.unboundedPreceding, -1)


def carry_failure(attempts: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Adds previous_failure_stderr: that of the latest failed attempt before; a failure without one resets it.

    Attempts are in order of iteration; if another total ``order`` is given, iteration (from 0) is added in the same scan."""
    failed = F.when(~F.coalesce("post_tests_passed", F.lit(False)), F.coalesce("stderr", F.lit("")))
    values = {"previous_failure_stderr": scan.latest_before(failed, order or ["iteration"])} | ({"iteration": scan.place()} if order else {})
    found = scan.running(attempts, "task_id", order or ["iteration"], values)
    found = found.withColumn("iteration", F.col("iteration") - 1) if order else found
    return found.withColumn("previous_failure_stderr", F.coalesce("previous_failure_stderr", F.lit("")))


def until_success(attempts: DataFrame, most: int) -> DataFrame:
    """Attempts up to the first success, ``most`` at most; what lies beyond ``most`` is dropped before the shuffle."""
    early = attempts.withColumn("_place", F.row_number().over(_task())).filter(F.col("_place") <= most).drop("_place")
    done = F.coalesce(F.max("post_tests_passed").over(_before()), F.lit(False))
    return early.withColumn("_done", done).filter(~F.col("_done")).drop("_done")


def up_to_success(attempts: DataFrame, order: list[str], salts: int = 16) -> DataFrame:
    """Attempts up to the first success in a total order, without a window: no task's attempts are sorted.

    A task's first success is an aggregate; it is joined back by task and salt, so that a hot task is spread."""
    place = F.struct(*order)
    first = attempts.filter("post_tests_passed").groupBy(F.col("task_id").alias("_task")).agg(F.min(place).alias("_first"))
    first = first.withColumn("_spread", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    salt = F.pmod(F.xxhash64(*order), F.lit(salts))
    tried = attempts.withColumn("_salt", salt).join(first, F.col("task_id").eqNullSafe(F.col("_task")) & (F.col("_salt") == F.col("_spread")), "left")
    return tried.filter(F.col("_first").isNull() | (place <= F.col("_first"))).drop("_task", "_first", "_spread", "_salt")


def best_so_far(attempts: DataFrame) -> DataFrame:
    """Adds best_reward and best_patch_id: the earliest of equal rewards wins."""
    best = F.struct("reward", (-F.col("iteration")).alias("order"), "patch_id")
    found = scan.running(attempts, "task_id", ["iteration"], {"_best": scan.largest(best)})
    return found.withColumns({"best_reward": F.col("_best.reward"), "best_patch_id": F.col("_best.patch_id")}).drop("_best")


def loop_state(attempts: DataFrame, most: int, threshold: float = 0.9) -> DataFrame:
    """Adds is_contiguous, solved (a reward above the threshold so far) and should_continue."""
    found = scan.running(attempts, "task_id", ["iteration"], {"_place": scan.place(), "solved": scan.largest(F.col("reward") > threshold)})
    place = F.col("_place")
    return found.withColumns({"is_contiguous": F.col("iteration") == place - 1, "should_continue": ~F.col("solved") & (place < most)}).drop("_place")


def summarize(attempts: DataFrame, order: list[str] | None = None) -> DataFrame:
    """A row for each task: attempts by label and the best of them, the earliest in ``order`` of equal ones."""
    best = F.min_by(F.struct("reward", "patch_id"), F.struct(F.col("reward").isNull().alias("none"), (-F.col("reward")).alias("low"), *(order or ["iteration"])))
    return (
        attempts.groupBy("task_id")
        .agg(F.count("*").alias("total_attempts"), F.count_if("post_tests_passed").alias("positive_attempts"), best.alias("best"))
        .select(
            "task_id", "total_attempts", "positive_attempts", (F.col("total_attempts") - F.col("positive_attempts")).alias("negative_attempts"),
            (F.col("positive_attempts") > 0).alias("solved"), F.col("best.patch_id").alias("best_patch_id"), F.col("best.reward").alias("best_reward"),
        )
    )


def repair_result(attempts: DataFrame, most: int) -> DataFrame:
    """A row for each task of what a repair loop over its attempts would report."""
    tried = until_success(attempts, most)
    best = F.max(F.struct("reward", (-F.col("iteration")).alias("order"), "patch_id"))
    return (
        tried.groupBy("task_id").agg(F.max("post_tests_passed").alias("solved"), F.count("*").alias("iterations_used"), best.alias("best"))
        .select("task_id", "solved", "iterations_used", F.lit(most).alias("max_iterations"), F.col("best.reward").alias("best_reward"), F.col("best.patch_id").alias("best_patch_id"))
    )


def ranked(candidates: DataFrame, ties: list[str]) -> DataFrame:
    """Adds place: by reward, tests passed, applied, least time; then ``ties``."""
    order = [F.desc("reward"), F.desc("post_tests_passed"), F.desc("patch_applied"), "elapsed_seconds", *ties]
    return scan.running(candidates, "task_id", order, {"place": scan.place()})


def selected(candidates: DataFrame, ties: list[str]) -> DataFrame:
    """The first of each task, by aggregation: no task's candidates are sorted."""
    key = F.struct(-F.col("reward"), ~F.col("post_tests_passed"), ~F.col("patch_applied"), "elapsed_seconds", *ties)
    row = F.struct(*[F.col(c) for c in candidates.columns])
    return candidates.groupBy("task_id").agg(F.min_by(row, key).alias("row"), F.count("*").alias("candidate_count"), F.max("patch_applied").alias("any_applied")).select("row.*", "candidate_count", "any_applied")


def hold_out(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Adds split: the last n rows by key are ``eval``. Only those n are ordered; keys must be unique."""
    if n <= 0:
        return rows.withColumn("split", F.lit("train"))
    last = rows.select(key).orderBy(F.col(key).desc()).limit(n).withColumn("split", F.lit("eval"))
    return rows.join(last, key, "left").withColumn("split", F.coalesce("split", F.lit("train")))
