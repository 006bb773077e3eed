"""Running values over parts of groups against plain windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.operators import scan, trajectory


@pytest.fixture
def hot(spark):
    """A third of all attempts are one task's; a null task, empty reasons and ties of reward are there."""
    rng = random.Random(4)
    rows = [(rng.choice([7, 7, 7, None, *range(20, 26)]), i, f"p{i}", rng.random() < 0.1, rng.choice([None, "", f"e{i}"]), rng.choice([0.5, -1.5, 1.25, None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "task_id long, at int, patch_id string, post_tests_passed boolean, stderr string, reward double")
    return df.withColumn("iteration", F.row_number().over(Window.partitionBy("task_id").orderBy("at")) - 1)


@pytest.fixture
def many_parts(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_no_part_holds_the_hot_task(hot, many_parts):
    parts = scan.parted(hot, "task_id", ["iteration"])
    sizes = {(r.task_id, r[scan.PART]): r["count"] for r in parts.groupBy("task_id", scan.PART).count().collect()}
    whole = sum(n for (t, _), n in sizes.items() if t == 7)
    assert whole > 800 and max(n for (t, _), n in sizes.items() if t == 7) < whole / 3 and max(sizes.values()) < 500


def test_running_values_equal_windows(hot, many_parts):
    w = Window.partitionBy("task_id").orderBy("iteration")
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    failed = F.when(~F.col("post_tests_passed"), F.coalesce("stderr", F.lit("")))
    best = F.struct("reward", (-F.col("iteration")).alias("order"), "patch_id")
    want = hot.withColumns({
        "previous_failure_stderr": F.coalesce(F.last(failed, ignorenulls=True).over(before), F.lit("")), "best_patch_id": F.max(best).over(upto)["patch_id"], "best_reward": F.max(best).over(upto)["reward"],
        "solved": F.max(F.col("reward") > 0.9).over(upto), "is_contiguous": F.col("iteration") == F.row_number().over(w) - 1, "place": F.row_number().over(w),
    })
    assert rows(trajectory.carry_failure(hot), "task_id", "iteration", "previous_failure_stderr") == rows(want, "task_id", "iteration", "previous_failure_stderr")
    assert rows(trajectory.best_so_far(hot), "task_id", "iteration", "best_patch_id", "best_reward") == rows(want, "task_id", "iteration", "best_patch_id", "best_reward")
    assert rows(trajectory.loop_state(hot, 5), "task_id", "iteration", "solved", "is_contiguous") == rows(want, "task_id", "iteration", "solved", "is_contiguous")
    dealt = scan.parted(hot, "task_id", ["iteration"])
    again = scan.running(dealt, "task_id", ["iteration"], {"place": scan.place()})
    assert rows(again, "task_id", "iteration", "place") == rows(want, "task_id", "iteration", "place") and scan.PART in again.columns


def test_ranking_equals_a_window(hot, many_parts):
    df = hot.withColumns({"patch_applied": F.col("at") % 2 == 0, "elapsed_seconds": F.col("at") % 5})
    order = Window.partitionBy("task_id").orderBy(F.desc("reward"), F.desc("post_tests_passed"), F.desc("patch_applied"), "elapsed_seconds", "at")
    assert rows(trajectory.ranked(df, ["at"]), "task_id", "at", "place") == rows(df.withColumn("place", F.row_number().over(order)), "task_id", "at", "place")


def test_no_rows(hot, many_parts):
    assert trajectory.best_so_far(hot.limit(0)).count() == 0


def test_iteration_and_failure_come_from_one_scan(hot, many_parts):
    want = trajectory.carry_failure(hot)
    got = trajectory.carry_failure(hot.drop("iteration"), ["at"])
    columns = ["task_id", "at", "iteration", "previous_failure_stderr"]
    assert rows(got, *columns) == rows(want, *columns) and scan.PART not in got.columns
