"""Embedding near-duplicates against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import embedding


def clusters(seed, size, n):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        base = rng.standard_normal(size)
        for _ in range(rng.integers(1, 7)):
            noise = rng.standard_normal(size)
            out.append((base + rng.uniform(0, 0.3) * noise) * rng.uniform(0.1, 9))
    return [list(map(float, np.float32(v))) for v in out]


def brute(rows, cosine=0.95):
    n = len(rows)
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v in rows]
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and good[i] and good[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                link[i, j] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine
    label = list(range(n))
    for _ in range(n):
        new = [min([label[i], *(label[j] for j in np.flatnonzero(link[i]))]) for i in range(n)]
        if new == label:
            break
        label = new
    ids = [r[0] for r in rows]
    return link, sorted((ids[i], int(link[i].sum()), min(ids[j] for j in range(n) if label[j] == label[i])) for i in range(n))


@pytest.mark.parametrize("block", [2, 3, 4, 512])
def test_links_degrees_and_components(spark, block):
    vectors = clusters(3, 64, 40) + clusters(4, 5, 12)
    vectors += [vectors[0]] * 9 + [[-0.0] * 8, [0.0] * 8, [], None, [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1e-30, 0.0], [1e30, 0.0], [2.0, 0.0]]
    rows = list(enumerate(vectors))
    link, want = brute(rows)
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, vector array<float>, filter string, node int").repartition(3)
    got = embedding.near(df.withColumnRenamed("vector", "embedding"), key=F.col("vec_id"), vector=F.col("embedding"), block=block).collect()
    found = {r.key: (r.n_links, r.component) for r in got}
    assert len(got) == len(rows)
    assert all(found[i][0] <= n for i, n, _ in want)
    assert sum(v[0] for v in found.values()) >= 0.98 * link.sum()
    assert sum(found[i] == (n, c) for i, n, c in want) >= 0.97 * len(want)
    assert embedding.near(df.limit(0), key=F.col("vec_id"), vector=F.col("vector")).count() == 0


def test_recall_on_pairs_at_the_threshold():
    rng, made = np.random.default_rng(9), embedding.code(64, embedding.CODEWORDS, embedding.TURNS)
    alpha = made.calibrate(0.95, embedding.RECALL)
    x, y = rng.standard_normal((2, 400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    a, b = made.filters(x, alpha), made.filters(y, alpha)
    assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b)]) > 0.97
    assert np.mean([len(p) for p in a]) < 80
    for i in range(5):
        want = []
        for t in range(embedding.TURNS):
            turned = x[i] @ made.turns[t]
            p, q = np.nonzero((turned[:32] @ made.half[t, 0].T)[:, None] + (turned[32:] @ made.half[t, 1].T)[None, :] >= alpha)
            want += ((t * made.codewords + p) * made.codewords + q + (64 << 40)).tolist()
        assert a[i].tolist() == sorted(want)


def groups(seed, size, sizes, spread):
    rng, out = np.random.default_rng(seed), []
    for n in sizes:
        base = rng.standard_normal(size)
        base /= np.linalg.norm(base)
        for _ in range(n):
            noise = rng.standard_normal(size)
            out.append(base + rng.uniform(0, spread) * noise / np.linalg.norm(noise))
    return [list(map(float, v)) for v in out]


@pytest.mark.parametrize("block", [3, 512])
def test_degrees_of_large_groups(spark, monkeypatch, block):
    """Thousands of links: tight groups are balls, wide ones link in part; every degree is that of all pairs."""
    monkeypatch.setattr(embedding, "MANY", 2)
    vectors = groups(5, 24, [70, 1, 40], 0.1) + groups(6, 24, [60, 50], 0.33)
    rows = [(i, v) for i, v in enumerate(vectors + vectors[:3])] + [(None, vectors[0])]
    link, want = brute([(-1 if i is None else i, v) for i, v in rows])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = embedding.near(df, key=F.col("vec_id"), vector=F.col("embedding"), block=block, codewords=4, turns=2, recall=1.0).collect()
    assert link.sum() > 10_000 and len(got) == len(rows)
    degrees = {i: n for i, n, _ in want}
    assert sorted((-1 if r.key is None else r.key, r.n_links) for r in got) == sorted(degrees.items())
    first = {}
    for r, c in sorted(((-1 if r.key is None else r.key), r.component) for r in got):
        assert first.setdefault(c, r) in (c, -1)


def test_balls_hold_only_what_links():
    rng = np.random.default_rng(2)
    units = np.array(groups(8, 16, [200, 3, 1], 0.3))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    half = float(np.arccos(0.95)) / 2
    found = embedding.balls(units, rng.integers(0, 3, len(units)), half)
    assert sorted(i for m, _, _ in found for i in m.tolist()) == list(range(len(units)))
    for mine, centre, radius in found:
        assert (units[mine] @ units[mine].T >= 0.95 - 1e-9).all() and radius <= half + 1e-9
        assert (np.arccos(np.clip(units[mine] @ centre, -1, 1)) <= radius + 1e-7).all()
    whole, part = embedding.met(np.array([c for _, c, _ in found]), np.array([r for _, _, r in found]), 0.95)
    for i, (a, _, _) in enumerate(found):
        for j, (b, _, _) in enumerate(found):
            if i != j:
                links = units[a] @ units[b].T >= 0.95
                assert links.all() if whole[i, j] else part[i, j] or not links.any()


def test_sql_of_a_table_with_links(spark, tmp_path):
    import duckdb

    from lodestrata.llm.queries import oracle_sql, queries

    rows = list(enumerate(groups(7, 32, [9, 1, 14, 6], 0.12) + [None, [0.0] * 32]))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(oracle_sql()["op4_embedding_dedup"])
    order = [d[0] for d in want.description]
    got = [tuple(r[c] for c in order) for r in queries()["op4_embedding_dedup"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want.fetchall()) and sum(r[1] for r in got) > 200


@pytest.mark.parametrize("sizes", [[], [1], [1, 4, 2, 1, 7], [40, 3, 33, 1, 200]])
def test_balls_meet_once_within_their_groups(sizes):
    """Against all pairs of each group, for groups on both sides of ``SMALL`` and centres of two lengths."""
    rng, rows, want = np.random.default_rng(len(sizes)), [], set()
    for group, size in enumerate(sizes):
        length = 3 if group % 2 else 4
        for ball in rng.choice(300, size, replace=False).tolist():
            centre = np.random.default_rng([ball, length]).standard_normal(length)
            rows.append((group, 0, 0, ball + 1000 * length, 0.1 * (ball % 3), (centre / np.linalg.norm(centre)).tolist()))
    for x in rows:
        for y in rows:
            if x[0] == y[0] and x[3] < y[3]:
                near, reach, limit = float(np.dot(x[5], y[5])), x[4] + y[4], np.arccos(0.95)
                angle = np.arccos(np.clip(near, -1, 1))
                if near >= 0.95 if reach == 0 else angle + reach <= limit - embedding.MARGIN:
                    want.add((x[3], y[3], 0))
                elif reach and angle - reach <= limit + embedding.MARGIN:
                    want.add((x[3], y[3], 1))
    types = [embedding.pa.int64()] * 4 + [embedding.pa.float64(), embedding.pa.list_(embedding.pa.float64())]
    arrays = [embedding.pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
    whole = embedding.pa.RecordBatch.from_arrays(arrays, ["filter", "part", "own", "ball", "radius", "centre"])
    cuts = [whole.slice(at, 5) for at in range(0, len(rows), 5)]
    got = [tuple(r.values()) for b in embedding._meeter(0.95)(iter(cuts)) for r in b.to_pylist()]
    assert set(got) == want and all(a < b for a, b, _ in got)
    assert not sizes or sizes[-1] < 7 or want


def test_directions_grow_with_the_vectors(spark):
    """No fewer directions than vectors, and filter numbers stay apart from those of other lengths; links are whole with any number."""
    assert [embedding.codewords_for(n, 1024, 8) for n in (0, 1, 8 << 20, (8 << 20) + 1, 10**9)] == [1024, 1024, 1024, 2048, 16384]
    for n in (10**6, 10**9, 5 * 10**11):
        words = embedding.codewords_for(n, 1024, 8)
        assert n <= 8 * words * words <= 1 << 40
    assert 8 * embedding.codewords_for(10**15, 1024, 8) ** 2 <= 1 << 40
    vectors = clusters(5, 16, 30)
    want = brute(list(enumerate(vectors)))[1]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    got = embedding.near(df, key=F.col("vec_id"), vector=F.col("embedding"), codewords=1, turns=2, recall=1.0).collect()
    assert {(r.key, r.n_links) for r in got} == {(i, n) for i, n, _ in want}


@pytest.mark.parametrize("hot", [1_000_000, 50])
def test_hot_and_null_vectors_keep_their_rows(spark, monkeypatch, hot):
    """A third of all rows have one vector, a third none: labels are the same, whether they are broadcast or joined."""
    from lodestrata.llm import common, embedding

    monkeypatch.setattr(common.labelled_by, "__defaults__", (hot,))
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(300)] + [(1000 + i, None) for i in range(300)] + [(2000 + i, [0.0, 1.0, i / 1000.0]) for i in range(10)] + [(3000, [0.0, 0.0, -1.0]), (None, [0.0, 0.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = embedding.near(df, key=F.col("vec_id"), vector=F.col("embedding")).collect()
    by = {r.key: (r.n_links, r.component) for r in got}
    assert len(got) == len(rows) and all(by[i] == (299, 0) for i in range(300)) and all(by[1000 + i] == (0, 1000 + i) for i in range(300))
    assert all(by[2000 + i] == (9, 2000) for i in range(10)) and by[3000] == (1, 3000)
