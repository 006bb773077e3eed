"""Summaries of runs and datasets; averages of nothing are 0, all of nothing is true."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import scoring, text

zero = lambda c: F.coalesce(c, F.lit(0))


def batch(results: DataFrame) -> DataFrame:
    n, ok = F.count("*"), F.count_if("post_tests_passed")
    return results.agg(
        n.alias("total_tasks"), ok.alias("solved_tasks"), (n - ok).alias("failed_tasks"), scoring.ratio(ok, n).alias("pass_rate"), F.round(F.coalesce(F.avg("reward"), F.lit(0.0)), 6).alias("average_reward")
    )


def experiment(tasks: DataFrame) -> DataFrame:
    """From rows of solved, selected_reward, candidate_count, parsed_count, any_applied."""
    n, ok = F.count("*"), F.count_if("solved")
    return tasks.agg(
        n.alias("total_tasks"), ok.alias("solved_tasks"), scoring.ratio(ok, n).alias("solve_rate"), F.round(F.coalesce(F.avg("selected_reward"), F.lit(0.0)), 6).alias("average_selected_reward"),
        zero(F.sum("candidate_count")).alias("total_candidates"), zero(F.sum("parse_failure_count")).alias("total_parse_failures"), F.count_if("any_applied").alias("tasks_with_applied_patch"),
    )


def compared(now: DataFrame, before: DataFrame, names: dict[str, str]) -> DataFrame:
    """Two one-row summaries side by side: previous, current and delta of each figure (name: column)."""
    one = lambda df, kind: df.select(F.lit(1).alias("_one"), *[F.col(c).alias(f"{kind}_{n}") for n, c in names.items()])
    both = one(now, "current").join(one(before, "previous"), "_one")
    return both.select(*[c for n in names for c in (f"previous_{n}", f"current_{n}", (F.col(f"current_{n}") - F.col(f"previous_{n}")).alias(f"{n}_delta"))])


def hygiene(reports: DataFrame) -> DataFrame:
    return reports.agg(
        F.count("*").alias("total_reports"), F.count_if("has_diff_header").alias("diff_header_count"), F.count_if("contains_markdown_fence").alias("markdown_fence_count"),
        F.count_if("contains_prose_after_diff").alias("prose_after_diff_count"), F.count_if("has_change_lines").alias("has_change_lines_count"),
        F.count_if(F.col("status") == "non_actionable_no_change_lines").alias("non_actionable_no_change_lines_count"),
        F.count_if(F.col("status").isin("actionable_diff_like", "sanitized_actionable_with_contamination")).alias("actionable_diff_like_count"),
        F.array_join(F.array_sort(F.collect_set("status")), ",").alias("statuses"),
    )


def token_stats(examples: DataFrame, tokens: str = "tokens") -> DataFrame:
    return examples.agg(F.count("*").alias("row_count"), zero(F.min(tokens)).alias("min_tokens"), zero(F.max(tokens)).alias("max_tokens"), F.round(F.coalesce(F.avg(tokens), F.lit(0.0)), 6).alias("mean_tokens"))


def token_report(rows: DataFrame, keys: list[str], tokens: str, most: int) -> DataFrame:
    """Statistics for all rows, each key and all keys together, in one pass over counted values. ``all`` stands for any."""
    counted = rows.groupBy(*keys, tokens).agg(F.count("*").alias("n"))
    levels = [F.struct(*[(F.col(k) if m >> i & 1 else F.lit("all")).alias(k) for i, k in enumerate(keys)]) for m in range(1 << len(keys))]
    each = counted.select(F.explode(F.array(*levels)).alias("g"), F.col(tokens).alias("tokens"), "n").select("g.*", "tokens", "n").groupBy(*keys, "tokens").agg(F.sum("n").alias("n"))
    sums = each.groupBy(*keys).agg(
        F.sum("n").alias("row_count"), F.min("tokens").alias("min_tokens"), F.max("tokens").alias("max_tokens"),
        F.round(F.sum(F.col("tokens") * F.col("n")) / F.sum("n"), 3).alias("mean_tokens"), F.coalesce(F.sum(F.when(F.col("tokens") > most, F.col("n"))), F.lit(0)).alias("would_truncate_count"),
    )
    from pyspark.sql import Window

    own = Window.partitionBy(*keys)
    placed = each.withColumns({"total": F.sum("n").over(own), "upto": F.sum("n").over(own.orderBy("tokens").rowsBetween(Window.unboundedPreceding, 0))})
    at = lambda q: F.min(F.when(F.col("upto") > F.bround((F.col("total") - 1) * q, 0), F.col("tokens")))
    return sums.join(placed.groupBy(*keys).agg(at(0.5).alias("median_tokens"), at(0.95).alias("p95_tokens")), keys)


def sft_dataset(rows: DataFrame) -> DataFrame:
    """From rows of reward, messages' last role, target."""
    return rows.agg(
        F.count("*").alias("row_count"), F.count_if(F.col("reward") > 0).alias("positive_rows"), F.count_if("solved").alias("solved_rows"), F.round(F.coalesce(F.avg("reward"), F.lit(0.0)), 6).alias("average_reward"),
        F.coalesce(F.bool_and(text.strip(F.col("target")) != ""), F.lit(True)).alias("all_targets_present"), F.coalesce(F.bool_and(F.col("reward") >= -1), F.lit(True)).alias("all_rewards_in_range"),
    )


def parameters(modules: DataFrame) -> DataFrame:
    """From rows of size and trainable."""
    total, some = zero(F.sum("size")), zero(F.sum(F.when(F.col("trainable"), F.col("size"))))
    return modules.agg(total.alias("total_parameters"), some.alias("trainable_parameters"), F.round(F.coalesce(F.try_divide(some.cast("double"), total.cast("double")), F.lit(0.0)) * 100, 6).alias("trainable_percent"))


def length_report(rows: DataFrame, key: str, tokens: str, chars: str, most: int) -> DataFrame:
    """:func:`token_report` for all rows and each key, with the lengths in characters."""
    level = F.explode(F.array(F.col(key), F.lit("all")))
    lengths = rows.select(level.alias(key), F.col(chars).alias("chars")).groupBy(key).agg(
        F.min("chars").alias("min_chars"), F.max("chars").alias("max_chars"), F.round(F.avg("chars"), 3).alias("mean_chars"),
    )
    return token_report(rows, [key], tokens, most).join(lengths, key)
