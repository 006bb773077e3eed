"""Figures of repeated attempts against exact counts, resampling and all pairs; summaries of a stream against those of a table."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import evaluation, trajectory
from lodestrata.plans import views
from lodestrata.streaming import attempts as streams

SF = "/root/testdata/sf0.001"


def test_pass_at_k_is_the_share_of_draws_with_a_success(spark):
    cases = [(n, c, k) for n in range(1, 7) for c in range(n + 1) for k in range(1, 8)]
    df = spark.createDataFrame(cases, "n int, c int, k int")
    for (n, c, k), r in zip(cases, df.select(evaluation.pass_at_k(F.col("n"), F.col("c"), F.col("k")).alias("x")).collect(), strict=True):
        if n < k:
            assert r.x is None
            continue
        draws = list(itertools.combinations([i < c for i in range(n)], k))
        assert r.x == pytest.approx(sum(map(any, draws)) / len(draws))


def test_intervals_cover_what_resampling_gives(spark):
    rng = random.Random(2)
    rows = [(t, rng.random() < p) for t in range(300) for p in [rng.random() ** 2] for _ in range(10)]
    df = spark.createDataFrame(rows, "task_id long, post_tests_passed boolean")
    got = evaluation.intervals(df, 3).first()
    each = [1 - math.comb(10 - c, 3) / math.comb(10, 3) for t in range(300) for c in [sum(ok for u, ok in rows if u == t)]]
    means = sorted(sum(rng.choices(each, k=300)) / 300 for _ in range(2000))
    assert got.estimate == pytest.approx(sum(each) / 300) and abs(got.low - means[50]) < 0.015 and abs(got.high - means[-51]) < 0.015
    assert got == evaluation.intervals(df.repartition(7), 3).first() or abs(got.low - evaluation.intervals(df.repartition(7), 3).first().low) < 1e-9
    none = evaluation.intervals(df.limit(0), 3).first()
    assert none.estimate is None and none.low is None


def test_preference_pairs_equal_all_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), i, rng.choice([True, False, None]), rng.choice([-1.5, -0.25, 0.0, 1.25, None])) for i in range(600)]
    df = spark.createDataFrame(rows, "task_id long, id int, post_tests_passed boolean, reward double")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.task_id, r.id): (r.rejected.reward, r.rejected.id) for r in evaluation.preference_pairs(df, ["id"], 0.5).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = {}
    for t, i, ok, x in rows:
        if ok and x is not None:
            lower = [(y, j) for u, j, no, y in rows if u == t and not no and y is not None and y <= x - 0.5]
            if lower:
                want[t, i] = max(lower)
    assert got == want and len(got) > 50


def test_a_stream_in_any_order_ends_with_the_summary_of_all(spark, tmp_path):
    rows = views.events(spark, SF)
    folder, out = tmp_path / "in", str(tmp_path / "out")
    rows.withColumn("batch", F.pmod(F.xxhash64("patch_id"), F.lit(5))).repartition(5, "batch").sortWithinPartitions(F.xxhash64("task_id", "patch_id")).drop("batch").write.parquet(str(folder))
    for again in range(2):
        stream = streams.arriving(spark, str(folder), rows.schema)
        query = streams.keep_summaries(stream, views.ATTEMPT_ORDER, out, str(tmp_path / "state"))
        query.awaitTermination()
        assert query.exception() is None and (again or query.lastProgress["batchId"] >= 2)
    want = trajectory.summarize(rows, views.ATTEMPT_ORDER)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, want.collect()))
