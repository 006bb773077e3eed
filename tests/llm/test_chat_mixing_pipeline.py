"""Chat, mixing and the pipeline against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestrata.llm import chat, mixing, packing, quality, secrets, simhash

NASTY = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\nhi", "\\", "\\\\<|", "<", "<<SYS>>x<</SYS>>", "a\\n", None, "", "é😀" * 50, "[[INST]", "<</s>", "$1 \\1 $0", "x" * 100_000, "\n\n"]


def test_round_trip_of_control_strings(spark):
    rows = [(c, t, role, NASTY[(c + t) % len(NASTY)], "e") for c in range(8) for t, role in enumerate(["system", "user", "assistant", "assistant", None, "as%0Asis\ntant<|"])]
    rows += [(8, None, "assistant", "first", "e"), (8, 1, "assistant", "b", "e"), (8, 1, "assistant", "b", "e"), (8, 1, "user", "a", "e"), (None, 0, "assistant", "n", "e")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, events string")
    rendered = chat.render(chat.fold(df.withColumns({"seq": F.col("turn"), "kind": F.lit("message")})))
    want = defaultdict(list)
    for c, t, role, text, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    got = chat.parse(rendered).collect()
    assert len(got) == len(want)
    for r in got:
        assert [(m.role, m.text) for m in r.messages] == want[r.conversation]
        assert r.masked == [t for role, t in want[r.conversation] if role == "assistant"]
        body = re.sub(r"<\|im_start\|>.*?\n|<\|im_end\|>\n", "", r.formatted)
        assert not re.search(r"<\||</?s>|\[/?INST\]|<</?SYS>>", body)
    for r in chat.digest(chat.parse(rendered)).collect():
        turns = want[r.conv_id]
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.n_turns == len(turns) and r.loss_chars == sum(len(b) for a, b in turns if a == "assistant")
    assert chat.digest(chat.parse(chat.render(chat.fold(df.limit(0).withColumns({"seq": F.col("turn"), "kind": F.lit("message")}))))).count() == 0


def test_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, 0, "message", "user", "Hel"), (1, 1, 0, "delta", "user", "lo"), (1, 2, 1, "delta", "assistant", "no "), (1, 3, 1, "delta", "assistant", "start"), (1, 4, 1, "regenerate", "assistant", "Yes"),
        (1, 5, 1, "delta", "assistant", "!"), (1, 6, 0, "edit", "user", "Hello?"), (1, 7, 0, "delta", "user", "?"), (1, 8, 2, "message", "user", "a"), (1, 9, 2, "message", "user", "b"), (1, 10, 2, "delta", "user", "c"),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string").orderBy(F.desc("seq"))
    (r,) = chat.fold(df).collect()
    assert [(m.role, m.text) for m in r.messages] == [("user", "Hello??"), ("assistant", "Yes!"), ("user", "a"), ("user", "bc")]


@pytest.mark.parametrize("name", ["op1_secret_scans", "op2_chat_formatting", "op5_suffix_dedup"])
def test_sql_of_whole_tables(spark, name):
    import duckdb

    from lodestrata.llm.queries import oracle_sql, queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(oracle_sql()[name])
    order = [d[0] for d in want.description]
    df = queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(order)
    assert sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def totals_of(spark, rows):
    return spark.createDataFrame(rows, "source string, tokens long, documents long")


@pytest.mark.parametrize("how", [{}, {"entropy": 0.99, "passes": 50.0}, {"passes": 1.2}, {"budget": 500_000.0, "passes": 3.0}, {"budget": 1e9}])
def test_exponent_equals_bisection(spark, how):
    totals = {"a": 300_000, "b": 50_000, "c": 20_000, "d": 900}
    got = mixing.exponent(totals_of(spark, [(s, n, 10) for s, n in totals.items()]), **(how | ({"budget": min(how["budget"], how.get("passes", 2.0) * sum(totals.values()))} if "budget" in how else {})))
    whole = sum(totals.values())

    def state(tau):
        w = {s: (n / whole) ** tau for s, n in totals.items()}
        z = sum(w.values())
        w = {s: x / z for s, x in w.items()}
        budget = min(how["budget"], how.get("passes", 2.0) * whole) if "budget" in how else max(totals[s] / w[s] for s in w)
        return -sum(x * math.log(x) for x in w.values()), max(budget * w[s] / totals[s] for s in w)

    def bisect(ok, low, high):
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if ok(mid) else (low, mid)
        return low

    most = how.get("entropy", mixing.ENTROPY) * math.log(len(totals))
    want = max(bisect(lambda t: state(t)[0] >= most, 0, 1), bisect(lambda t: state(t)[1] > how.get("passes", 2.0), 0, 1))
    assert got == pytest.approx(want, abs=1e-5)


def test_mixture_reaches_its_weights(spark):
    rows = [(i, "a" if i < 2000 else "b" if i < 2600 else None, "w " * (1 + i * 7 % 50), "x") for i in range(2700)] + [(9000, "b", None, "x"), (9000, "b", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, `row` string").repartition(4)
    out = mixing.mixed(docs, block=64)
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.source) for r in out.select("doc_id", "source").collect())
    assert set(got) == {(r[0], r[1]) for r in rows}
    tokens, passed = Counter(), Counter()
    for i, s, t, _ in rows:
        tokens[s] += max(1, len((t or "").split()))
    size = {r[0]: max(1, len((r[2] or "").split())) for r in rows}
    for (i, s), n in got.items():
        passed[s] += n * size[i]
    plan = {r.source: r for r in mixing.plan(totals_of(spark, [(s or "", n, 1) for s, n in tokens.items()]), block=64).collect()}
    for s in tokens:
        assert passed[s] / tokens[s] == pytest.approx(plan[s or ""].passes, rel=0.03)
        assert passed[s] / sum(passed.values()) == pytest.approx(plan[s or ""].weight, rel=0.04)
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.written(stage(spark, before, sf), "test")
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        if name == "quality_classifier":
            machine = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            score = dict(zip([r.doc_id for r in docs.collect()], machine.scores([r.text for r in docs.collect()])))
            assert sorted(r.doc_id for r in after.collect()) == sorted(d for d, s in score.items() if s >= quality.THRESHOLD)
        if name == "simhash_near_dedup":
            near = simhash.near(before, key=F.col("doc_id"), text=F.col("text")).collect()
            assert sorted(r.doc_id for r in after.collect()) == sorted({r.component for r in near})
        if name == "secret_scans":
            assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in before.collect())
            again = secrets.digest(secrets.scan(after, key=F.col("doc_id"), text=F.col("text"), owner=F.col("source"), repo=F.col("lang")))
            assert again.agg(F.sum("n_live")).first()[0] == 0
        if name == "source_mixing":
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
        before = after
    ids = packing.Ids(packing.public_tokenizer())
    want = sum(len(ids.of(r.text or "")) // 4 + 1 for r in before.collect())
    assert sum(r.length for r in corpus_pipeline.run(spark, sf).collect()) == want


def test_log_of_whole_messages_folds_back(spark):
    rows = [(1, t, role, NASTY[t % len(NASTY)]) for t, role in enumerate(["user", "assistant", None] * 20)] + [(2, 0, "user", "b")] * 2 + [(2, 0, "user", "a"), (2, None, "assistant", "long text"), (None, 1, "user", None)]
    rows += [(3, i, "assistant", f"text number {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.log(df)
    assert {"message", "delta", "edit", "regenerate"} == {r.kind for r in log.select("kind").distinct().collect()}
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    assert {r.conversation: [(m.role, m.text) for m in r.messages] for r in chat.fold(log).collect()} == want
    assert chat.fold(chat.log(df.limit(0))).count() == 0


@pytest.mark.parametrize("name", ["op6_source_mixing"])
def test_sql_of_mixing_on_whole_and_awkward_tables(spark, tmp_path, name):
    import duckdb

    from lodestrata.llm.queries import oracle_sql, queries

    rows = [(i % 50, None if i % 11 == 0 else "w " * (i % 90), [None, "a", "b", "b", "b", "c"][i % 6] if i > 5 else "c", "x") for i in range(700)] + [(None, "q", "b", "y"), (3, "w " * 200_000, "a", "y")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, `name` string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(rows[:0], "doc_id long, text string, source string, `name` string").write.parquet(f"{tmp_path}/none/documents.parquet")
    for sf in ("/root/testdata/sf0.001", str(tmp_path)):
        con = duckdb.connect()
        con.execute(f"create view documents as select * from '{sf}/documents.parquet{'' if sf.startswith('/root') else '/*.parquet'}'")
        want = con.execute(oracle_sql()[name])
        order = [d[0] for d in want.description]
        df = queries()[name](spark, sf)
        assert sorted(df.columns) == sorted(order)
        got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
        assert got == sorted(want.fetchall(), key=repr) and len(got) > con.execute("select count(*) from documents").fetchone()[0]
    assert queries()[name](spark, f"{tmp_path}/none").count() == 0


def test_pipeline_of_awkward_rows(spark, tmp_path):
    """Null ids and texts, empty and very long texts, repeated rows, clashing columns, an empty table."""
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa. "
    rows = [(i, text * (1 + i % 7) + f"number {i} of the rows", "en", "abc"[i % 3], 10, "k", 1.0) for i in range(60)]
    rows += [(None, text + "no id", "en", "a", 3, "k", 1.0), (100, None, None, None, None, None, None), (101, "", "en", "b", 0, "k", 1.0), (102, text * 20_000, "en", "b", 9, "k", 1.0), (5, rows[5][1], "en", "c", 10, "k", 1.0)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, `key` string, fp double"
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(60)], "doc_id long, quality int")
    for name, held in (("some", rows), ("none", [])):
        spark.createDataFrame(held, kinds).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.written(stage(spark, docs, f"{tmp_path}/{name}"), "test")
            assert docs.columns == [c.split()[0].strip("`") for c in kinds.split(", ")]
        packed = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert bool(packed) == bool(held)
        assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}


def test_rows_that_look_alike_are_spread_over_blocks(spark, tmp_path):
    """A third of all rows have no id and one text: no block holds them all, and SQL deals them alike."""
    import duckdb

    from lodestrata.llm import oracle, queries

    rows = [(None, "same", "a")] * 3000 + [(i, "w " * (i % 9), "ab"[i % 2]) for i in range(5000)] + [(7, "twice", None)] * 40
    spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("alike", F.lit("x")).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op6_source_mixing(spark, str(tmp_path))
    assert max(r["count"] for r in got.filter("doc_id is null").groupBy("source", "block", "pass_no").count().collect()) < 1200
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(oracle.SQL["op6_source_mixing"])
    at = [[d[0] for d in want.description].index(c) for c in got.columns]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
