import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import negatives, oracle, queries

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows):
    """The contract, pair by pair."""
    part = []
    for i, (v, e, l) in enumerate(rows):
        if l is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            part.append((i, v, (l + 1) % 10 if v is not None and v % 7 == 0 else l, [math.floor(256 * float(np.float32(x))) for x in e]))
    order = lambda t: (-t[0], t[1] is None, t[1] or 0, t[2])
    out = []
    for i, v, l, q in part:
        if v is None or v % 100:
            continue
        scored = [(sum(x * y for x, y in zip(q, q2, strict=False)), v2, j, l2) for j, v2, l2, q2 in part if j != i]
        for s, p, _, _ in sorted((t for t in scored if t[3] == l), key=order)[:5]:
            kept = sorted((t for t in scored if t[3] != l and 30 * s <= 100 * t[0] <= 90 * s), key=order)[:10]
            out += [(v, p, k + 1, t[1], s, t[0]) for k, t in enumerate(kept)]
    return sorted(out, key=repr)


def got(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


def write(spark, rows, path):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("a.b", F.lit(1)).withColumn("row", F.lit(0)).withColumn("q", F.lit("x")).write.parquet(f"{path}/embeddings.parquet")


def clustered(seed, n, dims=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.5) for _ in range(dims)] for _ in range(9)]
    return [(rng.choice([5, 10, 25, 50]) * i, [x + rng.gauss(0, 0.1) for x in rng.choice(centres)], rng.randrange(10)) for i in range(n)]


@pytest.mark.parametrize("seed", range(1))
def test_equals_brute_force(spark, tmp_path, monkeypatch, seed):
    for name, value in (("BLOCK", 40), ("BLOCK_ANCHORS", 8), ("LEAF", 5), ("SHARES", 4), ("STRIP", 3), ("SAMPLE", 50)):
        monkeypatch.setattr(negatives, name, value)
    rows = clustered(seed, 500)
    write(spark, rows, tmp_path)
    want = brute(rows)
    assert len(want) > 100 and got(queries.op11_hard_negatives(spark, str(tmp_path))) == want


def test_awkward_vectors(spark, tmp_path):
    same = [0.5, 0.25]
    rows = [(100 * i, same, i % 2) for i in range(12)] + [(3 + 10 * i, same, i % 3) for i in range(40)] + [(7, [0.4, 0.1], 9), (100, same, 1), (100, same, 1), (None, [0.45, 0.2], 0), (None, [0.4, 0.2], 1)]
    rows += [(900, None, 1), (901, [None, 1.0], 1), (902, [math.nan, 1.0], 1), (903, [math.inf, 0.0], 1), (904, same, None), (905, [], 1), (906, [0.3], 0), (907, [0.3, 0.2, 0.1], 1), (-700, [0.0, 0.0], 1), (-300, [-0.5, -0.3], 2), (-301, [-0.1, 0.0], 3), (-302, [0.1, 0.1], 2)]
    write(spark, rows, tmp_path)
    want = brute(rows)
    assert want and got(queries.op11_hard_negatives(spark, str(tmp_path))) == want


def test_no_rows_and_no_anchors(spark, tmp_path):
    write(spark, [], tmp_path / "a")
    write(spark, [(1, [1.0], 1), (2, [1.0], 1)], tmp_path / "b")
    for x in "ab":
        assert got(queries.op11_hard_negatives(spark, str(tmp_path / x))) == []


def test_large_components_are_exact():
    a = np.array([[1 << 40, 3, -5]], np.int64)
    b = np.array([[1 << 20, 7, 11], [-(1 << 21), 0, 1]], np.int64)
    assert negatives.products(a, b).tolist() == [[(1 << 60) + 21 - 55, -(1 << 61) - 5]]


def test_intervals_hold_and_prune():
    rng = np.random.default_rng(2)
    q = rng.integers(-50, 50, (300, 8)) + np.repeat(rng.integers(-900, 900, (10, 8)), 30, axis=0)
    starts = np.arange(0, 300, 30)
    low, high = negatives.intervals(negatives.spheres(q, starts), negatives.spheres(q, starts))
    exact = negatives.products(q, q).reshape(10, 30, 10, 30)
    assert (low <= exact.min((1, 3))).all() and (high >= exact.max((1, 3))).all()
    block = negatives.Anchors([(i, 1, q[i].astype("<i8").tobytes(), [(int(low.max()), 1 << 62)]) for i in range(30)], False, 3)
    block.meet(q, np.arange(300), np.arange(300), np.full(300, 2), starts)
    assert block.pruned > 0 and block.scored < 30 * 300


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = con.execute(oracle.SQL["op11_hard_negatives"])
    at = [[d[0] for d in want.description].index(c) for c in COLUMNS]
    rows = got(queries.op11_hard_negatives(spark, sf))
    assert rows and rows == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
