"""Stand-in views: the driver's tables hold no patches, so each operator runs on a mapping of them.

Every view has its SQL beside it, for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import scoring
from lodestrata.operators import datasets, scan
from lodestrata.sources.files import table

ATTEMPTS_SQL = """attempts as (
  select *, (case when patch_applied then cast(0.25 as double) else -1.0 end) + (case when post_tests_passed then cast(1.0 as double) else -0.5 end) + (case when pre_tests_passed then cast(-0.25 as double) else 0.0 end) as reward from (
    select user_id as task_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as integer) as iteration, event_id as patch_id,
      event_type <> 'error' as patch_applied, event_type = 'purchase' as post_tests_passed, event_type = 'signup' as pre_tests_passed, value as elapsed_seconds, props as stderr,
      'run ' || user_id as pre_test_command, case when event_type <> 'signup' then event_type || ' failed: ' || props end as pre_test_stderr, 'work/' || user_id as work_dir, case when event_id % 5 > 0 then 'patches/' || event_id || '.patch' end as patch_path,
      case when event_id % 5 > 0 then '+' || props || chr(10) end as patch_text from events))"""


#: The order of a task's attempts, from which their iteration follows.
ATTEMPT_ORDER = ["ts", "patch_id"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts with the time that orders them instead of an iteration. task: user; applied, passed: by type; every fifth has no patch file."""
    kind, has = F.col("event_type"), F.col("event_id") % 5 > 0
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("task_id"), "ts", F.col("event_id").alias("patch_id"), (kind != "error").alias("patch_applied"),
        (kind == "purchase").alias("post_tests_passed"), (kind == "signup").alias("pre_tests_passed"), F.col("value").alias("elapsed_seconds"), F.col("props").alias("stderr"),
        F.concat(F.lit("run "), F.col("user_id")).alias("pre_test_command"), F.when(kind != "signup", F.concat(kind, F.lit(" failed: "), F.col("props"))).alias("pre_test_stderr"), F.concat(F.lit("work/"), F.col("user_id")).alias("work_dir"),
        F.when(has, F.concat(F.lit("patches/"), F.col("event_id"), F.lit(".patch"))).alias("patch_path"), F.when(has, F.concat(F.lit("+"), F.col("props"), F.lit("\n"))).alias("patch_text"),
    )
    return rows.withColumn("reward", scoring.patch_reward(F.col("patch_applied"), F.col("post_tests_passed"), F.col("pre_tests_passed")))


def attempts(spark: SparkSession, sf_dir: str, most: int | None = None) -> DataFrame:
    """Attempts by iteration, the place of an event among its user's. ``most``: only so many of each task."""
    place = F.row_number().over(Window.partitionBy("task_id").orderBy(*ATTEMPT_ORDER))
    rows = events(spark, sf_dir).withColumn("place", place)
    rows = rows.filter(F.col("place") <= most) if most else rows
    return rows.withColumn("iteration", F.col("place") - 1).drop("place", "ts")


def attempt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts as of :func:`attempts`, dealt in parts of tasks by their order, so that no task's attempts meet in one place."""
    dealt = scan.parted(events(spark, sf_dir), "task_id", ATTEMPT_ORDER)
    placed = scan.running(dealt, "task_id", ATTEMPT_ORDER, {"iteration": scan.place()})
    return placed.withColumn("iteration", F.col("iteration") - 1).drop("ts")


CANDIDATES_SQL = """candidates as (
  select *, (case when patch_applied then cast(0.25 as double) else -1.0 end) + (case when post_tests_passed then cast(1.0 as double) else -0.5 end) as reward from (
    select l_orderkey as task_id, l_linestatus = 'F' as patch_applied, l_returnflag = 'N' and l_linestatus = 'F' as post_tests_passed, l_extendedprice as elapsed_seconds, l_partkey as part, l_suppkey as supp, l_linenumber as line from lineitem))"""
TIES = ["part", "supp", "line"]


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task: order; a candidate for each line."""
    f = F.col("l_linestatus") == "F"
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("task_id"), f.alias("patch_applied"), ((F.col("l_returnflag") == "N") & f).alias("post_tests_passed"), F.col("l_extendedprice").alias("elapsed_seconds"),
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_linenumber").alias("line"),
    )
    return rows.withColumn("reward", scoring.patch_reward(F.col("patch_applied"), F.col("post_tests_passed"), F.lit(False)))


RESPONSES_SQL = """responses as (
  select doc_id as task_id, case doc_id % 5
    when 0 then text when 1 then 'Here is the patch:' || chr(10) || '```diff' || chr(10) || diff || '```' || chr(10) || 'This change fixes it.'
    when 2 then diff when 3 then 'diff --git a/x.py b/x.py' || chr(10) || text else 'Patch: ' || text || chr(10) || chr(10) || diff || chr(10) || text end as raw
  from (select doc_id, text, 'diff --git a/app/f.py b/app/f.py' || chr(10) || '--- a/app/f.py' || chr(10) || '+++ b/app/f.py' || chr(10) || '@@ -1 +1 @@' || chr(10) || '-' || replace(text, chr(10), chr(10) || '-') || chr(10) || '+' || source || chr(10) as diff from documents))"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model texts built from whole documents: prose, fenced diff, bare diff, header with prose, diff between prose."""
    t = F.col("text")
    diff = F.concat(F.lit("diff --git a/app/f.py b/app/f.py\n--- a/app/f.py\n+++ b/app/f.py\n@@ -1 +1 @@\n-"), F.replace(t, F.lit("\n"), F.lit("\n-")), F.lit("\n+"), F.col("source"), F.lit("\n"))
    kind = F.col("doc_id") % 5
    raw = (
        F.when(kind == 0, t).when(kind == 1, F.concat(F.lit("Here is the patch:\n```diff\n"), diff, F.lit("```\nThis change fixes it."))).when(kind == 2, diff)
        .when(kind == 3, F.concat(F.lit("diff --git a/x.py b/x.py\n"), t)).otherwise(F.concat(F.lit("Patch: "), t, F.lit("\n\n"), diff, F.lit("\n"), t))
    )
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("task_id"), raw.alias("raw"))


FILES = ["app/utils.py", "tests/t.py"]
DEFAULT_FILE = "app/utils.py"
INTENTS_SQL = """intents as (
  select doc_id as task_id, text as file_text,
    case doc_id % 9 when 0 then '../escape.py' when 1 then '/abs.py' when 2 then 'tests/t.py' when 3 then 'missing.py' when 4 then 'utils.py' when 5 then '' when 6 then './utils.py' else 'app/utils.py' end as file_path,
    doc_id % 13 <> 0 as has_intent, case when doc_id % 7 = 6 then case doc_id % 4 when 0 then text || '#' when 1 then '```python' || chr(10) || 'nope' when 2 then chr(9) || chr(9) else 'def nope():' end else case doc_id % 5 when 0 then substr(text, 1, 20) when 1 then 'the ' when 2 then '@@nope@@' when 3 then '' else substr(text, 5, 40) end end as find_text,
    case when doc_id % 11 = 0 then '' when doc_id % 3 = 0 then 'def f():' || chr(10) || '    return 1' else 'x = 1' end as replace_text,
    case doc_id % 4 when 0 then 'returns x + 1' when 1 then 'a number multiplied by itself' when 2 then 'the larger integer' else 'none' end as expected_behavior
  from documents)"""


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit intents over documents that reach every outcome: near misses, fenced and made-up find texts, none at all for some tasks."""
    d, t = F.col("doc_id"), F.col("text")

    def pick(n: int, values: list, other) -> F.Column:
        out = F.when(d % n == 0, values[0])
        for i, v in enumerate(values[1:], 1):
            out = out.when(d % n == i, v)
        return out.otherwise(other)

    return table(spark, sf_dir, "documents").select(
        d.alias("task_id"), t.alias("file_text"), pick(9, ["../escape.py", "/abs.py", "tests/t.py", "missing.py", "utils.py", "", "./utils.py"], "app/utils.py").alias("file_path"),
        (d % 13 != 0).alias("has_intent"),
        F.when(d % 7 == 6, pick(4, [F.concat(t, F.lit("#")), "```python\nnope", "\t\t"], "def nope():")).otherwise(pick(5, [F.substr(t, F.lit(1), F.lit(20)), "the ", "@@nope@@", ""], F.substr(t, F.lit(5), F.lit(40)))).alias("find_text"),
        F.when(d % 11 == 0, "").when(d % 3 == 0, "def f():\n    return 1").otherwise("x = 1").alias("replace_text"),
        pick(4, ["returns x + 1", "a number multiplied by itself", "the larger integer"], "none").alias("expected_behavior"),
    )


CHATS_SQL = """chats as (
  select conv_id as task_id, list({'role': role, 'content': text} order by turn, role, text) as messages from (select conv_id, turn, case when conv_id % 17 = 0 then 'bot' else role end as role, text from conversations) group by conv_id)"""


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts; those of every 17th conversation have a role that no rule knows."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("conv_id") % 17 == 0, "bot").otherwise(F.col("role")).alias("role"), "text")
    return datasets.chats(rows)


VERSION = f"{datasets.NAMESPACE}.structured_intent_sft_row.v0"
_JSON = '{"intent_id":"i","task_id":"t","file_path":"%s","find_text":"a","replace_text":"b"}'
GOOD, ODD = _JSON % DEFAULT_FILE, '{"intent_id":"i","task_id":"","file_path":"other.py","find_text":"a"}'
SFT_SQL = f"""sft as (
  select task_id, '{VERSION}' || case when task_id % 13 = 0 then 'x' else '' end as schema_version,
    case when task_id % 8 = 7 then list_concat(messages[:len(messages) - 1], [{{'role': messages[len(messages)].role, 'content': '{GOOD}'}}]) else messages end as messages,
    case task_id % 4 when 0 then messages[len(messages)].content when 1 then '' when 2 then '{ODD}' else '{GOOD}' end as target from chats)"""


def sft_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supervised rows over transcripts with targets of every outcome."""
    t, m = F.col("task_id"), F.col("messages")
    last = F.element_at(m, -1)
    said = F.concat(F.slice(m, F.lit(1), F.size(m) - 1), F.array(F.struct(last["role"].alias("role"), F.lit(GOOD).alias("content"))))
    return chats(spark, sf_dir).select(
        t, F.concat(F.lit(VERSION), F.when(t % 13 == 0, "x").otherwise("")).alias("schema_version"), F.when(t % 8 == 7, said).otherwise(m).alias("messages"),
        F.when(t % 4 == 0, last["content"]).when(t % 4 == 1, "").when(t % 4 == 2, ODD).otherwise(GOOD).alias("target"),
    )


PROJECT = "demo"
#: path, project, stage, result. Literals that reach every case of the registry.
MANIFESTS = [
    ("a/b/x_manifest.json", "demo", "step10_batch", "OLD"), ("a-b/c/x_manifest.json", "demo", "step10_batch", "OK"), ("m/step29_1_manifest.json", "demo", "", None), ("m/s1_manifest.json", "demo", "step29_10_x", "OK"),
    ("m/s2_manifest.json", "demo", "step30", "OK"), ("m/s3_manifest.json", "demo", "governance", "OK"), ("m/s4_manifest.json", "other", "step1", "OK"), ("m/s5_manifest.json", "demo", None, "OK"), ("m/s6_manifest.json", "demo", "step2-7", "FAIL"),
]


def manifests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MANIFESTS, "path string, project string, stage string, result string")


DOCUMENT_MANIFESTS_SQL = f"""manifests as (
  select 'm/' || coalesce(source, '') || '/step' || doc_id % 40 || '/' || doc_id || '_manifest.json' as path, case when doc_id % 4 = 3 then 'other' else '{PROJECT}' end as project,
    case doc_id % 9 when 0 then null when 1 then '' when 2 then 'governance' when 3 then 'step' || doc_id % 40 when 4 then 'step' || doc_id % 40 || '_' || doc_id % 7 when 5 then 'step' || doc_id % 40 || '-' || doc_id % 7 || '_x' else 'step' || doc_id % 1000 || '_batch' end as stage,
    lang as result from documents)"""


def document_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest for each document: stages of every form, other projects, none at all."""
    d = F.col("doc_id")
    step = F.concat(F.lit("step"), d % 40)
    kinds = {1: F.lit(""), 2: F.lit("governance"), 3: step, 4: F.concat(step, F.lit("_"), d % 7), 5: F.concat(step, F.lit("-"), d % 7, F.lit("_x"))}
    stage = F.when(d % 9 > 5, F.concat(F.lit("step"), d % 1000, F.lit("_batch")))
    for k, v in kinds.items():
        stage = stage.when(d % 9 == k, v)
    path = F.concat(F.lit("m/"), F.coalesce("source", F.lit("")), F.lit("/"), step, F.lit("/"), d, F.lit("_manifest.json"))
    return table(spark, sf_dir, "documents").select(path.alias("path"), F.when(d % 4 == 3, "other").otherwise(PROJECT).alias("project"), stage.alias("stage"), F.col("lang").alias("result"))


CASES_SQL = """cases as (select p_partkey as case_pos, 'f' || p_partkey as name, lower(replace(p_brand, '#', '_')) as module, 'returns "' || p_name || '"' as bug, 'return ' || p_type as expected, p_name || ' as input' as edge, 'test_f' || p_partkey as test_symbol from part)"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curriculum's case for each part, numbered by the part."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("case_pos"), F.concat(F.lit("f"), key).alias("name"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("module"), F.concat(F.lit('returns "'), F.col("p_name"), F.lit('"')).alias("bug"),
        F.concat(F.lit("return "), F.col("p_type")).alias("expected"), F.concat(F.col("p_name"), F.lit(" as input")).alias("edge"), F.concat(F.lit("test_f"), key).alias("test_symbol"),
    )


ENTRIES_SQL = """entries as (select s_suppkey as pos, s_suppkey % 40 as step, 'run_' || s_name as name, case when s_nationkey % 2 = 0 then 'evaluation' else 'training' end as category, 'step' || s_suppkey as manifest, 'step' || s_suppkey || '_bundle' as artifact,
  ['results/' || s_suppkey || '/a.json', 'results/' || s_suppkey || '/b.json'] as results, 'nation=' || s_nationkey || ', even=' || case when s_nationkey % 2 = 0 then 'True' else 'False' end as metrics from supplier)"""


def run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each supplier."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    result = lambda x: F.concat(F.lit("results/"), key, F.lit(f"/{x}.json"))
    metric = lambda k, v: F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))
    step = F.concat(F.lit("step"), key)
    return table(spark, sf_dir, "supplier").select(
        key.alias("pos"), (key % 40).alias("step"), F.concat(F.lit("run_"), F.col("s_name")).alias("name"), F.when(nation % 2 == 0, "evaluation").otherwise("training").alias("category"), step.alias("manifest"),
        F.concat(step, F.lit("_bundle")).alias("artifact"), F.array(result("a"), result("b")).alias("results"), F.array(metric("nation", nation), metric("even", F.when(nation % 2 == 0, "True").otherwise("False"))).alias("metrics"),
    )
