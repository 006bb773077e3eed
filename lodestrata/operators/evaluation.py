"""Figures of repeated attempts: pass@k, repair@k, attempts and time for each solved task, intervals; pairs for preference training."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import scan, trajectory


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """Chance that one of k attempts drawn from n passes, of which c pass: ``1 - (n-c choose k) / (n choose k)`` as a product; null for n < k."""
    missed = F.aggregate(F.sequence(F.lit(0), k - 1), F.lit(1.0), lambda p, i: p * F.greatest(n - c - i, F.lit(0)) / (n - i))
    return F.when(n >= k, 1 - missed)


def tasks(attempts: DataFrame) -> DataFrame:
    """Attempts and passed attempts of each task."""
    return attempts.groupBy("task_id").agg(F.count("*").alias("n"), F.count_if("post_tests_passed").alias("c"))


def estimates(attempts: DataFrame, ks: list[int]) -> DataFrame:
    """For each k: how many tasks have as many attempts, and their mean pass@k. Attempts are counted before the shuffle; a task is a row then."""
    each = tasks(attempts).select("n", "c", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    found = each.withColumn("x", pass_at_k(F.col("n"), F.col("c"), F.col("k")))
    return found.groupBy("k").agg(F.count("x").alias("tasks"), F.round(F.avg("x"), 6).alias("pass_at_k"))


def repaired_within(attempts: DataFrame, ks: list[int]) -> DataFrame:
    """For each k the share of tasks that an attempt before the (k + 1)th solves (repair@k): the first success's iteration is an aggregate."""
    first = attempts.groupBy("task_id").agg(F.min(F.when(F.col("post_tests_passed"), F.col("iteration"))).alias("first"))
    return first.select("first", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).groupBy("k").agg(F.count("*").alias("tasks"), F.round(F.count_if(F.col("first") < F.col("k")) / F.count("*"), 6).alias("repair_at_k"))


def cost(attempts: DataFrame, order: list[str]) -> DataFrame:
    """One row: attempts and time up to each task's first success, over the tasks that were solved (null if none was). Time is summed exactly."""
    tried = trajectory.up_to_success(attempts, order)
    spent = F.sum(F.col("elapsed_seconds").cast("decimal(18,6)"))
    solved = F.count_if("post_tests_passed")
    each = tried.agg(F.count("*").alias("attempts"), solved.alias("solved_tasks"), spent.alias("spent"))
    by = lambda c: F.when(F.col("solved_tasks") > 0, F.round(F.col(c).cast("double") / F.col("solved_tasks"), 6))
    return each.select("attempts", "solved_tasks", by("attempts").alias("attempts_per_solved_task"), by("spent").alias("seconds_per_solved_task"))


def _poisson(u: Column, most: int = 8) -> Column:
    """A Poisson(1) number from a uniform one: how many of its distribution's steps lie below."""
    steps, total = [], 0.0
    for i in range(most):
        total += math.exp(-1) / math.factorial(i)
        steps.append(total)
    return sum(((u >= s).cast("int") for s in steps), F.lit(0))


def intervals(attempts: DataFrame, k: int, replicates: int = 200, level: float = 0.95) -> DataFrame:
    """estimate, low and high of mean pass@k by a Poisson bootstrap over tasks: every replicate weighs each task by a Poisson number
    drawn from a hash of both, so all replicates are sums of one pass and the result is the same at every run."""
    each = tasks(attempts).select("task_id", pass_at_k(F.col("n"), F.col("c"), F.lit(k)).alias("x")).filter("x is not null")
    drawn = each.select("x", F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("r"), "task_id")
    u = F.pmod(F.xxhash64("task_id", "r"), F.lit(1 << 40)) / float(1 << 40)
    weighed = drawn.withColumn("w", F.when(F.col("r") == 0, 1).otherwise(_poisson(u)))  # replicate 0 is the sample itself
    means = weighed.groupBy("r").agg((F.sum(F.col("w") * F.col("x")) / F.nullif(F.sum("w"), F.lit(0))).alias("mean"))
    tail = (1 - level) / 2
    others = F.when(F.col("r") > 0, F.col("mean"))
    return means.agg(F.max(F.when(F.col("r") == 0, F.col("mean"))).alias("estimate"), F.percentile(others, tail).alias("low"), F.percentile(others, 1 - tail).alias("high"))


def preference_pairs(candidates: DataFrame, ties: list[str], margin: float) -> DataFrame:
    """Each passed candidate (chosen) with the best failed one of its task whose reward is at least ``margin`` lower (rejected, a struct of
    reward and ``ties``); chosen ones without such a one are left out. Of equal rewards the last by ``ties`` is taken.

    A task's candidates are one sequence in which a passed one stands where its reward less the margin belongs; the last failed one before
    it is its pair. So there are as many pairs as passed candidates at most, and a hot task is scanned in parts."""
    ok = F.coalesce("post_tests_passed", F.lit(False))
    rows = candidates.withColumns({"_passed": ok, "_at": F.when(ok, F.col("reward") - margin).otherwise(F.col("reward"))}).filter("_at is not null")
    failed = F.when(~F.col("_passed"), F.struct("reward", *ties))
    order = ["_at", "_passed", *ties]
    found = scan.running(rows, "task_id", order, {"rejected": scan.latest_before(failed, order)})
    return found.filter("_passed and rejected is not null").drop("_passed", "_at")
