"""SimHash near-duplicates and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestrata.llm import graph, simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, linked):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def texts():
    rng = random.Random(5)
    words = ["alpha", "Beta", "GAMMA", "çé", "delta,", "x", "eins"]
    base = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(12)]
    out = [None, "", " \t\n\x0b\x0c\r ", "one", "one two", "one two three", "ONE\ttwo\nthree", "a\x1cb c\xa0d 　 e", "é" * 3000, "w " * 70_000]
    for t in base:
        parts = t.split()
        out += [t, t.upper() if t.isascii() else t]
        for _ in range(6):
            p = list(parts)
            p[rng.randrange(200)] = rng.choice(words)
            out.append(" ".join(p))
    return out


def test_fingerprint():
    for t in texts():
        got = simhash.fingerprint(t) % (1 << 64)
        assert got == brute_fingerprint(t), (t or "")[:50]


def test_near_equals_brute_force(spark):
    rows = [(i // 2 if i in (20, 21) else i, t, "a", "b") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, `key` string").repartition(3)
    got = simhash.near(docs, key=F.col("doc_id"), text=F.col("text")).collect()
    rows.sort(key=lambda r: r[0])
    prints = [brute_fingerprint(r[1]) for r in rows]
    roots = brute_components(prints, lambda a, b: bin(a ^ b).count("1") <= 3)
    want = sorted((r[0], p, min(q[0] for q, c in zip(rows, roots) if c == root)) for r, p, root in zip(rows, prints, roots))
    assert want == sorted((r.key, r.fp % (1 << 64), r.component) for r in got)
    assert simhash.near(docs.limit(0), key=F.col("doc_id"), text=F.col("text")).count() == 0
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({w[2] for w in want})


@pytest.mark.parametrize("block", [8, 64, 4096])
def test_long_lists_are_split_without_losing_links(spark, block):
    rng = np.random.default_rng(1)
    base = rng.integers(-(1 << 62), 1 << 62, 3)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(150):
            x = int(b) & ((1 << 64) - 1)
            for bit in rng.integers(0, 64, rng.integers(1, 6)):
                x ^= 1 << int(bit)
            fps.add(x - (1 << 64) if x >> 63 else x)
    fps = sorted(fps)
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), block)
    roots = brute_components(fps, lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 3)
    got = {r.node: r.root for r in graph.components(edges).collect()}
    groups = lambda label: sorted(sorted(i for i in range(len(fps)) if label(i) == v) for v in {label(i) for i in range(len(fps))})
    assert groups(lambda i: roots[i]) == groups(lambda i: got.get(fps[i], fps[i]))


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(200)] + [(5000, 5000)] + [(7, 6)] * 3
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(301)}) == 1 and len({got[1000 + i] for i in range(201)}) == 1 and got[0] != got[1000] and 5000 not in got
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "x y z"), (None, "x y z"), (4, "q r s"), (None, "q r s")], "doc_id long, text string")
    assert sorted((r.key or 0, r.component or 0) for r in simhash.near(docs, key=F.col("doc_id"), text=F.col("text")).collect()) == [(0, 0), (0, 0), (0, 4), (4, 4)]
    assert sorted(r.text for r in simhash.first_of_each(docs).collect()) == ["q r s", "x y z"]


@pytest.mark.parametrize("hot", [0, 2, 10**6])
def test_frequent_fingerprints_are_labelled_like_others(spark, hot):
    """The same rows whichever fingerprints count as frequent; empty tables too."""
    texts = ["one text that a third of all rows hold"] * 20 + [f"text {i % 7} of its own {i % 7 * 31}" for i in range(25)] + ["", None] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in simhash.near(docs, key=F.col("doc_id"), text=F.col("text"), hot=hot).collect())
    want = sorted(tuple(r) for r in simhash.near(docs, key=F.col("doc_id"), text=F.col("text")).collect())
    assert got == want and len(got) == len(texts)
    assert simhash.near(docs.limit(0), key=F.col("doc_id"), text=F.col("text"), hot=hot).count() == 0
