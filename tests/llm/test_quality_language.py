"""Quality and language: held-out accuracy, exact sums, awkward rows."""

import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import language, quality
from lodestrata.llm.common import table

SF = "/root/testdata/sf0.01"


def test_linear_time_interactions_equal_all_pairs():
    rng = np.random.default_rng(2)
    m = quality.Machine(0.3, rng.standard_normal(quality.SIZE).astype(np.float32), rng.standard_normal((quality.SIZE, quality.RANK)).astype(np.float32))
    rows = [quality.features(t) for t in ("a b c a", None, "x", "Some MORE text!!\n\nwith | pipes")]
    starts = np.cumsum([0] + [len(i) for i, _ in rows])[:-1]
    z, _ = m.logits(np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), starts)
    for got, (i, x) in zip(z, rows):
        want = m.w0 + m.w[i] @ x + sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert got == pytest.approx(want, rel=1e-3, abs=1e-3)


def test_quality_on_held_out_rows(spark):
    from lodestrata.llm.queries import op8_quality_classifier

    got = {r.doc_id: r for r in op8_quality_classifier(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    docs = {r.doc_id for r in table(spark, SF, "documents").select("doc_id").collect()}
    assert set(got) == docs and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    held = [(got[d].predicted, q) for d, q in labels.items() if got[d].held_out]
    assert np.mean([p == q for p, q in held]) > 0.95


def test_quality_of_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "good words here"), (3, "good words here"), (None, "x"), (5, "!!! $$$ " * 4000), (6, "fine")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(3, 1), (3, 1), (5, 0), (6, 1), (None, 1), (77, 0), (2, None)], "doc_id long, quality int")
    machine = quality.train(docs, labels, folds=1, held=1)
    got = [(r.doc_id, r.score) for r in quality.score(docs, machine, key=F.col("doc_id"), text=F.col("text")).collect()]
    assert len(got) == 7 and all(0 <= s <= 1 for _, s in got) and len({s for d, s in got if d == 3}) == 1
    kept = quality.keep(docs, machine)
    assert kept.columns == docs.columns and kept.count() == sum(s >= 0.3 for _, s in got)
    nothing = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, nothing, key=F.col("doc_id"), text=F.col("text")).collect()} == {1.0}
    assert quality.score(docs.limit(0), machine, key=F.col("doc_id"), text=F.col("text")).count() == 0


def trees():
    rows = []
    for lang, text in (("aa", b"abab abba baab abab" * 20), ("zz", b"xyzzy zyxxy yzzx \xc3\xa9" * 20)):
        g, n = language.grams(text)
        rows.append(pd.DataFrame({"lang": lang, "gram": g.astype(np.int64), "n": n}))
    return language.grow(pd.concat(rows))


def test_code_lengths_are_exact_and_probabilities_sum_to_one():
    t = trees()
    a = int(t.lut.max()) + 1
    assert np.allclose(np.exp2(-t.table.reshape(-1, a, 2) + np.where(np.arange(a) == 0, np.log2(256 - a + 1), 0)[None, :, None]).sum(1), 1, atol=1e-5)
    texts = [b"abba xyz \xff\x00 abab", b"", b"q", b"abab " * 300_000]
    got = t.lengths(texts)
    for text, bits in zip(texts[:3], got):
        want, padded = np.zeros(2), b"\0\0\0" + text
        for i in range(3, len(padded)):
            c = tuple(int(s) for s in t.lut[list(padded[i - 3 : i])])
            row = next(t.contexts.index(c[j:]) for j in range(4) if c[j:] in t.contexts)
            want += t.table[row * a + int(t.lut[padded[i]])]
        assert np.allclose(bits, want, rtol=1e-5)
    once = t.lengths([b"abab " * 1000])[0]
    assert np.allclose((got[3] - once) / (300_000 - 1000), (once - t.lengths([b"abab " * 500])[0]) / 500, rtol=1e-3)


def test_prediction_of_awkward_texts():
    names, scores = trees().predict([None, "", "123 !?", "abba", "zyx", "é"])
    assert names == ["und", "und", "und", "aa", "zz", "zz"] and (scores[:3] == 0).all() and (scores[3:] > 0.5).all()


def test_language_on_held_out_rows(spark):
    from lodestrata.llm.queries import op9_language_id

    got = {r.doc_id: r for r in op9_language_id(spark, SF).collect()}
    truth = {r.doc_id: r.lang for r in table(spark, SF, "documents").collect()}
    assert set(got) == set(truth) and all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    assert np.mean([got[d].lang_pred == l for d, l in truth.items() if got[d].held_out]) > 0.97
    empty = table(spark, SF, "documents").limit(0)
    assert language.predict(empty, language.train(empty), key=F.col("doc_id"), text=F.col("text")).count() == 0


SCRIPTS = ["abcdefghij", "klmnopqrst", "абвгдежзий", "клмнопрсту", "αβγδεζηθικ", "אבגדהוזחטי", "一二三四五六七八九十", "人大小中国上下天地", "あいうえおかきくけこ", "กขคงจฉชซฌญ", "abcdeghiéè", "ابتثجحخدذر"]


def language_texts(seed, n=1):
    """Words of each of twelve languages in eight scripts."""
    rng = np.random.default_rng(seed)
    return {f"l{i:02}": [" ".join("".join(rng.choice(list(s), rng.integers(1, 6))) for _ in range(60)) for _ in range(n)] for i, s in enumerate(SCRIPTS)}


def brute_bits(texts, text):
    """One language's PPM with counts, escapes and exclusions over all 256 bytes, computed anew for each byte."""
    counts = [{} for _ in range(4)]
    for t in texts:
        padded = b"\0\0\0" + t.encode()
        for i in range(3, len(padded)):
            for k in range(4):
                own = counts[k].setdefault(padded[i - k : i], {})
                own[padded[i]] = own.get(padded[i], 0) + 1

    def p(context):
        """Probabilities of all bytes after a context."""
        below = p(context[1:]) if context else [1 / 256] * 256
        own = counts[len(context)].get(context)
        if not own:
            return below
        total, rest = sum(own.values()), sum(b for x, b in enumerate(below) if x not in own)
        return [own[x] / (total + len(own)) if x in own else len(own) / (total + len(own)) * below[x] / rest for x in range(256)]

    padded = b"\0\0\0" + text.encode()
    return sum(-np.log2(p(padded[i - 3 : i])[padded[i]]) for i in range(3, len(padded)))


def test_trees_equal_brute_force_in_many_scripts(spark):
    known, new = language_texts(1), language_texts(2)
    rows = [(i, t, l) for i, (l, t) in enumerate((l, t) for l, ts in known.items() for t in ts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    made = language.train(docs, folds=1, held=1)
    assert made.languages == sorted(known)
    texts = [t for ts in new.values() for t in ts][::3] + ["abc κλ", "人 大q"]
    got = made.lengths([t.encode() for t in texts])
    for text, bits in list(zip(texts, got))[:3] + list(zip(texts, got))[-2:]:
        assert np.allclose(bits, [brute_bits(known[l], text) for l in made.languages], rtol=1e-4)
    many = language.train(spark.createDataFrame([(i, t, l) for i, (l, t) in enumerate((l, t) for l, ts in language_texts(3, 20).items() for t in ts)], "doc_id long, text string, lang string"), folds=1, held=1)
    names, _ = many.predict([t for ts in new.values() for t in ts])
    assert names == sorted(known)


def test_awkward_rows_of_languages(spark):
    rows = [(1, "abc abc", "aa", 1), (1, "abc abc", "aa", 1), (2, "xyz", "zz", 1), (3, None, "aa", 1), (4, "", "zz", 1), (5, "abc", None, 1), (None, "xyz " * 50_000, "zz", 1), (7, "1 2", "aa", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    made = language.train(docs, folds=1, held=1)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.lang_pred) for r in language.predict(docs, made, key=F.col("doc_id"), text=F.col("text")).collect())
    assert got == [(False, 1, "aa"), (False, 1, "aa"), (False, 2, "zz"), (False, 3, "und"), (False, 4, "und"), (False, 5, "aa"), (False, 7, "und"), (True, 0, "zz")]
    short = language.train(docs, folds=1, held=1, max_text=3)
    assert short.languages == ["aa", "zz"] and language.train(docs.limit(0)).languages == []


def test_index_finds_every_code():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 1 << 36, 5000))
    index = language.Index(codes)
    assert (index.find(codes) == np.arange(len(codes))).all()
    assert (index.find(np.setdiff1d(rng.integers(0, 1 << 36, 5000), codes)) == -1).all() and (language.Index(codes[:0]).find(codes) == -1).all()


def test_gradients_equal_differences():
    rng = np.random.default_rng(4)
    m = quality.Machine(0.1, (rng.standard_normal(quality.SIZE) * 0.3).astype(np.float64), (rng.standard_normal((quality.SIZE, 3)) * 0.3).astype(np.float64))
    rows = [quality.features(t, d) for t, d in (("a b c a", ("x=1",)), (None, ()), ("some MORE a", ("x=2", "y=1")))]
    index, value = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]).astype(np.float64)
    starts, labels = np.cumsum([0] + [len(i) for i, _ in rows])[:-1], np.array([1.0, 0.0, 1.0])

    def loss():
        z, _ = m.logits(index, value, starts)
        return float(np.mean(np.log1p(np.exp(-z)) * labels + np.log1p(np.exp(z)) * (1 - labels)))

    g0, used, gw, gv = m.gradients(index, value, starts, labels)

    def by(change):
        change(1e-5)
        up = loss()
        change(-2e-5)
        down = loss()
        change(1e-5)
        return (up - down) / 2e-5

    assert g0 == pytest.approx(by(lambda d: setattr(m, "w0", m.w0 + d)), abs=1e-4)
    for j in rng.choice(len(used), 12, replace=False).tolist():
        assert gw[j] == pytest.approx(by(lambda d: m.w.__setitem__(used[j], m.w[used[j]] + d)), abs=1e-4)
        for f in range(3):
            assert gv[j, f] == pytest.approx(by(lambda d: m.v.__setitem__((used[j], f), m.v[used[j], f] + d)), abs=1e-4)


def test_learning_sample_is_bounded_and_metadata_counts(spark):
    rows = [(i, "word " * 50, "good" if i % 2 else "bad") for i in range(60)] + [(0, "word " * 50, "bad")] * 30 + [(99, "long " * 10_000, "bad")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `site` string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    sizes = []
    fit = quality.fit
    quality.fit = lambda pairs, marks, **how: sizes.append(len(pairs)) or fit(pairs, marks, **how)
    try:
        quality.train(docs, labels, folds=1, held=1, max_rows=40)
        quality.train(docs, labels, folds=1, held=1, max_bytes=2600)
        machine = quality.train(docs, labels, folds=1, held=1, metadata=("site",))
    finally:
        quality.fit = fit
    assert sizes[0] <= 40 and sizes[1] == 10 and sizes[2] == 61
    scored = quality.score(docs, machine, key=F.col("doc_id"), text=F.col("text"), metadata=("site",)).collect()
    assert all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in scored if r.doc_id < 60)


def test_keep_takes_any_column_names(spark):
    docs = spark.createDataFrame([(1, "A plain text.", 5), (2, None, None)], "doc_id long, text string, `a.b` int").withColumn("row", F.lit(0)).withColumn("c`d", F.lit(1))
    made = quality.keep(docs, quality.Machine(0.0, None, None, 1.0))
    assert made.columns == docs.columns and sorted(made.collect(), key=str) == sorted(docs.collect(), key=str)
    assert quality.keep(docs.limit(0), quality.Machine(0.0, None, None, 1.0)).count() == 0
