"""Truth tables, ties, empty inputs and the published outcome figures."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import rules, scoring, text
from lodestrata.operators import curricula, datasets, prompts, summaries, trajectory
from lodestrata.plans import views


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("applied, passed, before, want", [(True, True, False, 1.25), (True, True, True, 1.0), (True, False, False, -0.25), (True, False, True, -0.5), (False, False, False, -1.5), (False, False, True, -1.75)])
def test_reward_table(spark, applied, passed, before, want):
    assert one(spark, scoring.patch_reward(F.lit(applied), F.lit(passed), F.lit(before))) == want


def attempts(spark, rows):
    df = spark.createDataFrame(rows, "task_id long, iteration int, patch_id string, patch_applied boolean, post_tests_passed boolean, stderr string")
    return df.withColumn("reward", scoring.patch_reward(F.col("patch_applied"), F.col("post_tests_passed"), F.lit(False)))


@pytest.mark.parametrize("salts", [1, 3, 16])
def test_up_to_success_equals_the_ordered_form(spark, salts):
    rows = [(t, i, f"{t}-{i}", None if i % 7 == 0 else t is not None and i == t * 3, [None, 1.0, -0.5][i % 3]) for t in (None, 0, 1, 2, 3) for i in range(40)]
    rows += [(None, 40, "late", True, 9.0), (None, 41, "later", True, 9.0), (9, 0, "none", None, None)]
    df = spark.createDataFrame(rows, "task_id long, iteration long, patch_id string, post_tests_passed boolean, reward double").repartition(5)
    short = trajectory.up_to_success(df, ["iteration"], salts)
    assert short.columns == df.columns
    assert sorted(map(str, short.collect())) == sorted(map(str, trajectory.until_success(df, 99).collect()))
    assert sorted(map(str, trajectory.summarize(short).collect())) == sorted(map(str, trajectory.summarize(trajectory.until_success(df, 99)).collect()))
    best = {r.task_id: (r.best_reward, r.best_patch_id) for r in trajectory.summarize(short).collect()}
    assert best[None] == (9.0, "late") and best[3] == (1.0, "3-1") and best[9] == (None, "none")
    assert trajectory.up_to_success(df.limit(0), ["iteration"]).count() == 0


def test_repair_of_two_attempts(spark):
    """Fails, then passes: 2 iterations, best the second; 2 rows, 1 of each label."""
    df = attempts(spark, [(1, 0, "a", True, False, "boom"), (1, 1, "b", True, True, ""), (1, 2, "c", True, True, "")])
    r = trajectory.repair_result(df, 3).first()
    assert (r.solved, r.iterations_used, r.best_reward, r.best_patch_id) == (True, 2, 1.25, "b")
    s = trajectory.summarize(trajectory.until_success(df, 9)).first()
    assert (s.total_attempts, s.positive_attempts, s.negative_attempts, s.best_patch_id) == (2, 1, 1, "b")
    assert [x.previous_failure_stderr for x in trajectory.carry_failure(df).orderBy("iteration").collect()] == ["", "boom", "boom"]


def test_missing_stderr_resets_what_is_carried(spark):
    df = attempts(spark, [(1, 0, "a", True, False, "boom"), (1, 1, "b", True, False, None), (1, 2, "c", True, False, "x")])
    assert [x.previous_failure_stderr for x in trajectory.carry_failure(df).orderBy("iteration").collect()] == ["", "boom", ""]


def test_ties_and_the_third_of_three_candidates(spark):
    rows = [(1, "a", False, False, -1.5, 1.0, 0), (1, "b", True, False, -0.25, 1.0, 1), (1, "c", True, True, 1.25, 9.0, 2), (2, "d", True, True, 1.25, 1.0, 0), (2, "e", True, True, 1.25, 1.0, 1)]
    df = spark.createDataFrame(rows, "task_id long, patch_id string, patch_applied boolean, post_tests_passed boolean, reward double, elapsed_seconds double, pos int")
    assert {(r.task_id, r.patch_id) for r in trajectory.selected(df, ["pos"]).collect()} == {(1, "c"), (2, "d")}
    assert {(r.task_id, r.patch_id) for r in trajectory.ranked(df, ["pos"]).filter("place = 1").collect()} == {(1, "c"), (2, "d")}


def test_empty_inputs(spark):
    none = attempts(spark, [])
    assert tuple(summaries.batch(none).first()) == (0, 0, 0, 0.0, 0.0)
    r = summaries.sft_dataset(spark.createDataFrame([], "reward double, solved boolean, target string")).first()
    assert (r.row_count, r.average_reward, r.all_targets_present) == (0, 0.0, True)
    assert tuple(summaries.token_stats(spark.createDataFrame([], "tokens long")).first()) == (0, 0, 0, 0.0)


@pytest.mark.parametrize("n, want", [(-1, 0), (0, 0), (2, 2), (9, 5)])
def test_hold_out(spark, n, want):
    df = spark.createDataFrame([(k,) for k in "abcde"], "task_id string")
    got = {r.task_id for r in trajectory.hold_out(df, "task_id", n).filter("split = 'eval'").collect()}
    assert got == set("abcde"[5 - want :])


def test_nearest_index_percentiles(spark):
    rng = random.Random(1)
    for values in ([1, 2, 3, 5], [7], [rng.randrange(20) for _ in range(101)]):
        df = spark.createDataFrame([("g", v) for v in values], "g string, v long")
        r = scoring.nearest_index_percentiles(df, ["g"], "v", {"m": 0.5, "p": 0.95}).first()
        assert (r.m, r.p) == tuple(sorted(values)[round((len(values) - 1) * q)] for q in (0.5, 0.95))


def test_string_functions(spark):
    lit = F.lit
    assert one(spark, text.occurrences(lit("aaaa"), lit("aa"))) == 2 and one(spark, text.occurrences(lit(""), lit(""))) == 1 and one(spark, text.occurrences(lit("ab"), lit(""))) == 3
    assert one(spark, text.replace_first(lit("a.b.b"), lit(".b"), lit("$1"))) == "a$1.b"
    assert one(spark, text.between(lit("x<t>y</t>"), "<t>", "</t>")) == "y" and one(spark, text.between(lit("</t><t>"), "<t>", "</t>")) == ""
    assert one(spark, text.tokens(lit("  a b\n\tc "))) == 3
    assert one(spark, text.unified_diff(lit("x\n```diff\ndiff --git a b\r\n--- a\n```"))) == "diff --git a b\n--- a\n"
    # the end of a fence that doesn't open pairs with the next one
    assert one(spark, text.unified_diff(lit("```python\nx\n```\n```diff\ndiff --git a b\n```"))) == "diff --git a b\n```\n"
    assert one(spark, text.unified_diff(lit("nothing"))) is None
    assert one(spark, text.cut_at_stop(lit("ab;cd.e"), [".", ";", "", "zz"])) == "ab"
    assert one(spark, text.json_object(lit('```json\n{"a": {"b": 1}}\n```'))) == '{"a": {"b": 1}}'
    assert [one(spark, text.escapes_root(lit(p))) for p in ("a/../../b", "/a", "a/../b", "..", "./a")] == [True, True, False, True, False]
    assert one(spark, text.normal_path(lit("x/app/utils.py"), "app/utils.py")) == "app/utils.py"
    assert one(spark, text.truncated(lit("abc"), 2, "!")) == "ab!" and one(spark, text.truncated(lit(None).cast("string"), 2, "!")) == ""


def test_rules_in_order(spark):
    e = lambda *a: one(spark, rules.intent_error(*[F.lit(x) for x in a]))
    assert e(True, False, True, 0, "") == "file_path_escapes_repo" and e(False, False, True, 0, "") == "file_missing" and e(False, True, True, 0, "") == "test_file_edit_forbidden"
    assert e(False, True, False, 0, "") == "find_text_not_found" and e(False, True, False, 2, "") == "find_text_not_unique" and e(False, True, False, 1, "") == "empty_replace_text" and e(False, True, False, 1, "x") is None


def model_block(t):
    import re

    found, notes, on = [], [], False
    for line in t.split("\n"):
        on = on or line.startswith("diff --git ")
        if not on:
            continue
        s = line.strip()
        if s.startswith("```"):
            notes.append("stopped_at_markdown_fence")
            break
        if not s:
            notes.append("dropped_blank_line")
        elif re.match(r"diff --git |index |@@| |\+|-|\\ No newline at end of file", line):
            found.append(line)
        else:
            notes.append("stopped_at_non_diff_line:" + s[:80])
            break
    if t.endswith("\n") and notes and notes[-1] == "dropped_blank_line" and on:
        notes.pop()
    joined = "\n".join(found).rstrip()
    return (joined + "\n" if joined else "", notes) if on else ("", ["missing_diff_header"])


def test_diff_blocks_equal_a_line_model(spark):
    rng = random.Random(3)
    lines = ["diff --git a b", "--- a", "+++ b", "@@ -1 +1 @@", "-x", "+y", " z", "", "  ", "```", "prose here", "index 1", "\\ No newline at end of file", "+", "--"]
    rows = [("\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9))) + rng.choice(["", "\n"]),) for _ in range(300)]
    for r in text.diff_blocks(spark.createDataFrame(rows, "t string"), "t").collect():
        assert (r.block, list(r.notes)) == model_block(r.t), r.t


def test_difflib_functions(spark):
    df = spark.createDataFrame([("a\nb\nc\n", "a\nB\nc\n"), ("", "x"), (None, "x")], "a string, b string")
    got = [r.x for r in df.select(text.similarity(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [round(difflib.SequenceMatcher(None, "a\nb\nc\n", "a\nB\nc\n").ratio(), 6), 0.0, None]
    diff = df.limit(1).select(text.line_diff(F.lit("f.py"), F.col("a"), F.col("b")).alias("x")).first().x
    assert diff == "diff --git a/f.py b/f.py\n--- a/f.py\n+++ b/f.py\n@@ -1,3 +1,3 @@\n a\n-b\n+B\n c\n"


def applied(old, patch):
    """A patch of one hunk, applied to lines by its line numbers."""
    lines = patch.split("\n")[:-1]
    if len(lines) == 1:
        return old
    assert lines[1].startswith("--- a/") and lines[2].startswith("+++ b/")
    first, n = [int(x) for x in (lines[3].split(" ")[1][1:] + ",1").split(",")[:2]]
    at = first if n == 0 else first - 1
    body = lines[4:]
    taken = [x[1:] for x in body if x[0] in " -"]
    assert old[at : at + n] == taken and sum(x[0] == "-" for x in body) + sum(x[0] == " " for x in body) == n
    return old[:at] + [x[1:] for x in body if x[0] in " +"] + old[at + n :]


def test_patches_of_one_edit_equal_difflib(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        old = [f"line {j} {rng.random()}" for j in range(rng.choice([0, 1, 2, 5, 9, 30]))]
        low = rng.randrange(len(old) + 1)
        high = min(len(old), low + rng.choice([0, 0, 1, 2, 4]))
        new = old[:low] + [f"new {i} {j}" for j in range(rng.choice([0, 1, 1, 3]))] + old[high:]
        end = rng.choice(["\n", "\r\n", "\u2028", "\x0b"]) if i % 4 == 0 else "\n"
        rows.append((f"p{i}.py", end.join(old) + end * rng.randrange(2), end.join(new) + end * rng.randrange(2)))
    rows += [("e.py", "", ""), ("e.py", "", "x"), ("e.py", "x", ""), ("e.py", "x\n", "x"), ("e.py", "\n", "\n\n"), (None, "a", "b"), ("n.py", None, "b")]
    df = spark.createDataFrame(rows, "p string, a string, b string")
    for (p, a, b), r in zip(rows, df.select(text.line_diff(F.col("p"), F.col("a"), F.col("b")).alias("x")).collect(), strict=True):
        if None in (p, a, b):
            assert r.x is None
            continue
        body = "\n".join(difflib.unified_diff(a.splitlines(), b.splitlines(), f"a/{p}", f"b/{p}", lineterm=""))
        assert r.x == f"diff --git a/{p} b/{p}\n" + (body + "\n" if body else "")
        assert applied(a.splitlines(), r.x) == b.splitlines()


def test_patches_among_repeated_lines_apply(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(300):
        old = [rng.choice("ab") for _ in range(rng.randrange(12))]
        low, high = sorted((rng.randrange(len(old) + 1), rng.randrange(len(old) + 1)))
        rows.append(("\n".join(old), "\n".join(old[:low] + [rng.choice("abc") for _ in range(rng.randrange(4))] + old[high:])))
    found = spark.createDataFrame(rows, "a string, b string").select(text.line_diff(F.lit("p"), F.col("a"), F.col("b")).alias("x")).collect()
    for (a, b), r in zip(rows, found, strict=True):
        assert applied(a.splitlines(), r.x) == b.splitlines()


def test_curricula(spark):
    rows = datasets.curriculum(spark).collect()
    assert len(rows) == 192 and len({r.task_id for r in rows}) == 192 and sum(r.split == "eval" for r in rows) == 32
    assert {c: sum(r.category == c for r in rows) for c in {r.category for r in rows}} == {c: 16 for c, _ in datasets.CATEGORIES}
    first = datasets.first_curriculum(spark).collect()
    assert len(first) == 48 and sum(r.split == "eval" for r in first) == 8 and len({r.category for r in first}) == 8
    assert datasets.curriculum_targets(datasets.curriculum(spark)).filter("try_parse_json(target_text) is null").count() == 0


def _cases_of_one_task(spark, n=40):
    texts = {c: F.concat(F.lit(c), "case_pos") for c in ("name", "module", "bug", "expected", "edge", "test_symbol")}
    return spark.range(0, n, 1, 1).select(F.col("id").alias("case_pos")).withColumns(texts)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cases_that_one_task_reads_are_dealt_before_they_become_rows(spark):
    cases = _cases_of_one_task(spark)
    for made in (datasets.curriculum, datasets.first_curriculum):
        sizes = made(spark, cases).groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in sizes) % 40 == 0 and len(sizes) == 4


def test_counts_of_a_curriculum_make_its_rows_twice_at_most(spark):
    from lodestrata.plans.queries import curriculum_counts

    assert _plan(curriculum_counts(spark, "/root/testdata/sf0.001")).count("Generate explode") == 2


def test_ids_of_a_curriculum_are_counted_apart_from_its_other_counts(spark):
    rows = datasets.curriculum(spark, _cases_of_one_task(spark))
    rows = rows.unionByName(rows.filter("index < 3").withColumn("split", F.lit("unset"))).withColumn("category", F.when(F.col("index") > 1, F.col("category")).otherwise("other"))
    found = prompts.violations(rows, 480, 80, 12)
    assert found.first().asDict() == {
        "rows_off": 3, "eval_rows_off": 0, "repeated_ids": 3, "unknown_splits": 3, "unknown_categories": 4, "without_operations": 0, "uneven_categories": 2, "categories_off": 1,
    }
    assert prompts.violations(rows.limit(0), 480, 80, 12).first().asDict() == {
        "rows_off": -480, "eval_rows_off": -80, "repeated_ids": 0, "unknown_splits": 0, "unknown_categories": 0, "without_operations": 0, "uneven_categories": 0, "categories_off": -12,
    }
    grouped = [line for line in _plan(found).splitlines() if "keys=[task_id#" in line]
    assert grouped and not any("count(1)" in line for line in grouped)


@pytest.mark.parametrize("made", [curricula.second_rows, curricula.first_rows])
def test_whole_rows_keep_their_case_without_a_join(spark, made):
    plan = _plan(made(spark, _cases_of_one_task(spark)))
    assert plan.count("Exchange hashpartitioning(") == 1 and "SortMergeJoin" not in plan


def test_second_rows_leave_out_cases_without_a_number(spark):
    cases = _cases_of_one_task(spark).withColumn("case_pos", F.when(F.col("case_pos") != 3, F.col("case_pos")))
    assert curricula.second_rows(spark, cases).count() == 39 * 12


def test_rules_of_targets_that_are_cut_or_of_other_types(spark):
    rows = curricula.second_rows(spark, _cases_of_one_task(spark))
    target, i = F.col("target_text"), F.col("index")
    odd = rows.withColumn("target_text", F.when(i == 0, F.substr(target, F.lit(1), F.length(target) - 1)).when(i == 1, F.regexp_replace(target, '"operations":.*?],', '"operations":"x",'))
        .when(i == 2, F.regexp_replace(target, '"operations":.*?],', '"operations":[null],')).when(i == 3, "\t\n ").when(i == 4, "[]").when(i == 5, None)
        .when(i == 6, F.concat(F.lit("["), target, F.lit("]"))).otherwise(target))
    found = curricula.broken_rules(odd, 1).first().asDict()
    cut = ["target_schema_version", "target_task_id", "target_category", *[f"target_{a}" for a in curricula.ARRAYS[1]]]
    want = dict.fromkeys(found, 0) | dict.fromkeys(cut, 5) | {"row_count": 480, "target_text": 2, "target_operations": 7}
    assert found == want
    by = curricula.broken_rules(odd.withColumn("part", i % 2), 1, "part").collect()
    assert sorted((r.part, r.row_count, r.target_text, r.target_operations) for r in by) == [(0, 240, 0, 4), (1, 240, 2, 3)]
    assert set(curricula.broken_rules(odd.limit(0), 1).first()) == {0}


def test_registry_orders_paths_by_parts_and_keeps_the_last(spark):
    rows = datasets.registry(views.manifests(spark), views.PROJECT).collect()
    assert [(r.stage, r.display_step, r.sort_key) for r in rows] == [("step2-7", "2.7", 27), ("step10_batch", "10", 100), ("", "29.1", 291), ("step29_10_x", "29.10", 300), ("step30", "30", 300), ("governance", "unknown", 999999)]
    assert next(r for r in rows if r.stage == "step10_batch").path == "a-b/c/x_manifest.json"


def test_generation_rules(spark):
    good = {"max_new_tokens": F.lit(1), "temperature": F.lit(0.0), "top_p": F.lit(1.0), "top_k": F.lit(None).cast("int"), "num_return_sequences": F.lit(1), "repetition_penalty": F.lit(None).cast("double")}
    assert one(spark, F.size(rules.generation_issues(good))) == 0
    assert one(spark, F.size(rules.generation_issues(good | {"top_p": F.lit(0.0), "top_k": F.lit(-1)}))) == 2


def test_unknown_paths_and_texts_of_intents(spark):
    from lodestrata.operators import datasets

    rows = [(1, "app/utils.py", "abc", None, "x"), (2, None, "abc", "a", "x"), (3, "app/utils.py", None, "a", "x"), (4, "app/utils.py", "abc", "a", None), (5, "app/utils.py", "abc", "a", "y")]
    df = spark.createDataFrame(rows, "task_id long, file_path string, file_text string, find_text string, replace_text string")
    got = {r.task_id: (r.error, r.valid) for r in datasets.validated(df, ["app/utils.py"]).collect()}
    assert got == {1: ("find_text_not_found", False), 2: ("file_missing", False), 3: ("find_text_not_found", False), 4: ("empty_replace_text", False), 5: (None, True)}


def test_empty_json_values_count_as_missing(spark):
    for value, missing in (("0", True), ("false", True), ("[]", True), ("{}", True), ('""', True), ("null", True), ('"0"', False), ("1", False), ("[1]", False), ('"x"', False)):
        target = '{"intent_id":%s,"task_id":"t","file_path":"app/utils.py","find_text":"a","replace_text":"b"}' % value
        messages = F.array(F.struct(F.lit("assistant").alias("role"), F.lit(target).alias("content")))
        found = one(spark, F.transform(rules.sft_issues(F.lit("v"), messages, F.lit(target), "v", "app/utils.py"), lambda i: i["field"]))
        assert (found == ["target.intent_id"]) == missing and (found == []) != missing, value


def test_fences_around_json(spark):
    for raw, want in (("```json\n{\"a\": 1}\n```", '{"a": 1}'), ('{"a": 1}\n``` }', '{"a": 1}\n``` }'), ("```\n{}\n", "{}"), ("none", None), ("```", None)):
        assert one(spark, text.json_object(F.lit(raw))) == want


def test_markdown_of_a_registry(spark):
    from lodestrata.operators import runs

    out = runs.registry_markdown(runs.entries(spark, "b", "c"), "demo", "v0", "c", "b")
    assert out.startswith("# demo Run Registry\n\n- Project: `demo`") and "| 9 | `agentic_eval_harness` | `evaluation_core` | `ok` | no | toy_patch_eval=ok, reward=1.25 |" in out and out.count("\n| ") == 13


def test_similar_is_difflib_where_it_can_be_near(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(200):
        a = "".join(rng.choice("abcdef \n") for _ in range(rng.choice([0, 1, 8, 60, 400])))
        b = list(a)
        for _ in range(rng.choice([0, 1, 3, 40])):
            b.insert(rng.randrange(len(b) + 1), rng.choice("abcxyz")) if rng.random() < 0.5 or not b else b.pop(rng.randrange(len(b)))
        rows.append((a, "".join(b)))
    rows += [("", ""), ("abc", "cba"), (None, "a"), ("ab" * 50, "ba" * 50)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(text.similar(F.col("a"), F.col("b"), 0.9).alias("x"), text.shared_characters(F.col("a"), F.col("b")).alias("n")).collect()
    for (a, b), r in zip(rows, got, strict=True):
        if None in (a, b):
            assert r.x is None
            continue
        matcher = difflib.SequenceMatcher(None, a, b)
        assert r.n == sum(min(a.count(c), b.count(c)) for c in set(b))
        assert r.x == (round(matcher.ratio(), 6) if matcher.quick_ratio() >= 0.9 else None)


def test_every_reachable_category_occurs(spark):
    from lodestrata.plans.queries import FOUND

    found = {r.category for r in FOUND["failure_histogram"](spark, "/root/testdata/sf0.01").collect()}
    assert found == {
        "missing_intent", "empty_find_text", "near_miss_exact_text", "markdown_contaminated_find_text", "non_code_find_text", "wrong_or_hallucinated_find_text", "wrong_file_path", "ambiguous_find_text",
        "empty_replace_text", "attempted_test_edit", "file_path_escapes_repo", "valid",
    }
