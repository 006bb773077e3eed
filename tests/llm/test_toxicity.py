import itertools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def brute_segments(scores):
    """Ruzzo and Tompa's definition, by recursion: the best segment (the shortest, then the first), then those to its left and right."""
    if not any(s > 0 for s in scores):
        return []
    sums = [0, *itertools.accumulate(scores)]
    best = max(((sums[j] - sums[i], -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    i, j = -best[2], -best[2] - best[1]
    return brute_segments(scores[:i]) + [(i, j, best[0])] + [(a + j, b + j, s) for a, b, s in brute_segments(scores[j:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-5, 5).filter(lambda x: x), max_size=30))
def test_segments_are_all_maximal_ones(scores):
    got = toxicity.segments(np.array(scores, np.float64))
    want = brute_segments(scores)
    assert sum(s for _, _, s in got) == sum(s for _, _, s in want)
    assert max((s for _, _, s in got), default=0) == max((s for _, _, s in want), default=0)
    assert all(sum(scores[a:b]) == s and s > 0 for a, b, s in got) and all(x[1] <= y[0] for x, y in itertools.pairwise(got))


def test_segments_of_a_long_text_take_one_scan():
    scores = np.tile([1.0, -0.5], 200_000)
    assert toxicity.segments(scores) == [(0, 399_999, 100_000.5)]
    assert len(toxicity.segments(np.tile([1.0, -2.0], 200_000))) == 200_000


def test_priors_keep_chance_finds_at_zero():
    words, stems = toxicity.lexicon({"seldom": (1, 0), "often": (40, 1), "even": (10, 100), "kind": (0, 400)}, {"seldo": (1, 0), "often": (40, 1), "even": (10, 100), "kind": (0, 400)}, 0.1)
    assert words["seldom"] == words["even"] == 0 and words["often"] > 2 and words["kind"] < -1 and stems["often"] > 1


def test_extremes_are_found_again():
    rng = np.random.default_rng(3)
    lengths = rng.integers(50, 500, 4000).astype(float)
    largest = (np.log(0.1 * lengths) - np.log(-np.log(rng.random(4000)))) / 0.8
    rate, size = toxicity.extremes(lengths, largest)
    assert abs(rate - 0.8) < 0.05 and 0.07 < size < 0.14


def test_held_out_accuracy_and_whole_table(spark):
    rows = {r.doc_id: r for r in queries.op12_toxicity(spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").distinct().count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in rows.items())
    held = [(rows[d].predicted, t) for d, t in labels.items() if rows[d].held_out]
    caught, toxic = sum(p for p, t in held if t), sum(t for _, t in held)
    assert caught >= 0.8 * toxic and sum(p for p, t in held if not t) <= 0.015 * (len(held) - toxic)


@pytest.fixture
def awkward(spark):
    draw = random.Random(5)
    filler = lambda: [draw.choice(["bread", "river", "stone", "lamp", "window", "garden", "paper", "winter", "road", "field"]) for _ in range(12)]
    rows = [(i, " ".join(["calm", *filler()]), "a") for i in range(40)] + [(100 + i, " ".join([*filler(), "horrid", "vile", "beast", *filler()]), "a") for i in range(40)]
    rows += [(None, "you horrid vile beast", "a"), (200, None, None), (201, "", "a"), (202, " \n ", "a"), (203, "vile " * 200_000, "a"), (204, "calm words", "a"), (204, "calm words", "a"), (205, "x" * 1_000_000, "a"), (206, "12 34 !!", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", F.lit(1).alias("a.b"), F.lit("?").alias("score"), F.lit(0).alias("rank"), F.lit(0).alias("k"))
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, *_ in rows if i is not None and i < 200] + [(None, 1), (0, 0), (0, 1), (1, None), (2, 7)], "doc_id long, toxic int")
    return docs, labels


def test_awkward_rows(awkward):
    docs, labels = awkward
    made = toxicity.train(docs, labels)
    found = toxicity.score(docs, made, key=F.col("doc_id"), text=F.col("text")).collect()
    assert len(found) == docs.count()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    assert by[200][0].score == by[201][0].score == by[202][0].score == by[206][0].score and by[204][0] == by[204][1]
    assert min(by[i][0].score for i in range(100, 140)) > max(by[i][0].score for i in range(40)) and by[None][0].score > by[204][0].score
    assert by[100][0].passages and by[100][0].passages[0].start < by[100][0].passages[0].end <= 1000 and not by[200][0].passages


def test_one_label_or_no_rows(spark, awkward):
    docs, labels = awkward
    for kept, want in ((labels.filter("toxic = 1"), 1.0), (labels.filter("toxic = 0"), 0.0), (labels.limit(0), 0.0)):
        assert {r.score for r in toxicity.score(docs, toxicity.train(docs, kept), key=F.col("doc_id"), text=F.col("text")).collect()} == {want}
    none = docs.limit(0)
    assert toxicity.score(none, toxicity.train(none, labels), key=F.col("doc_id"), text=F.col("text")).count() == 0


def test_the_sample_is_bounded(awkward):
    docs, labels = awkward
    few = toxicity.train(docs, labels, max_rows=20)
    assert len({w for w in few.words if w.isalpha()}) <= len(toxicity.train(docs, labels).words)
    assert toxicity.train(docs, labels, max_bytes=10).constant == 0.0
