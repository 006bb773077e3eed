"""Registered queries on registries, whole curriculum rows, intent runs, prompt contexts and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import text
from lodestrata.operators import curricula, datasets, prompts, runs, summaries
from lodestrata.plans import views
from lodestrata.plans.queries import LIMIT, query
from lodestrata.sources.files import table

BUCKET, COMMIT = "artifacts", "0000000"


@query
def run_entries(spark, sf_dir):
    rows = runs.entries(spark, BUCKET, COMMIT, views.run_rows(spark, sf_dir))
    return rows.withColumns({"primary_results": F.array_join("primary_results", ","), "metrics": runs.key_values(F.col("metrics"))})


@query
def run_entry_lines(spark, sf_dir):
    return runs.registry_lines(runs.entries(spark, BUCKET, COMMIT, views.run_rows(spark, sf_dir)))


@query
def run_entry_overview(spark, sf_dir):
    """Steps of all runs, each once: their number doesn't grow with the runs."""
    steps = runs.entries(spark, BUCKET, COMMIT, views.run_rows(spark, sf_dir)).groupBy("step").agg(F.min("pos").alias("pos"))
    found = runs.overview(steps, "pos", "step")
    return found.withColumn("complete", F.col("entry_count") == runs.ENTRY_COUNT)


@query
def registry_overview(spark, sf_dir):
    rows = datasets.registry(views.document_manifests(spark, sf_dir), views.PROJECT).withColumn("o", F.struct("sort_key", "stage"))
    return runs.overview(rows, "o", "display_step")


def _flat(rows):
    """Messages as two columns."""
    said = lambda i: F.element_at("messages", i)["content"]
    return rows.withColumns({"system": said(1), "user": said(2)}).drop("messages")


@query
def curriculum_rows(spark, sf_dir):
    return _flat(curricula.second_rows(spark, views.cases(spark, sf_dir)))


@query
def first_curriculum_rows(spark, sf_dir):
    return _flat(curricula.first_rows(spark, views.cases(spark, sf_dir)))


def _with_damaged(rows):
    """Each row as it is and damaged, so that some of the damaged ones break each rule; made once for both."""
    rows = rows.withColumn("rows", F.explode(F.array(F.lit("whole"), F.lit("damaged"))))
    i = F.when(F.col("rows") == "damaged", F.col("index") % 10)
    target = F.col("target_text")
    return rows.withColumns({
        "schema_version": F.when(i == 1, "x").otherwise(F.col("schema_version")),
        "task_id": F.when(i == 7, "same").otherwise(F.col("task_id")),
        "split": F.when(i == 4, "unset").otherwise(F.col("split")),
        "category": F.when(i == 6, "other").otherwise(F.col("category")),
        "messages": F.when(i == 8, F.slice("messages", 1, 1)).otherwise(F.col("messages")),
        "target_text": F.when(i == 2, F.replace(target, F.lit('"task_id":"sft'), F.lit('"task_id":"oft')))
        .when(i == 3, " ").when(i == 5, F.replace(target, F.lit('"verification":'), F.lit('"checks":')))
        .when(i == 9, F.replace(target, F.lit(".structured_intent."), F.lit(".other."))).otherwise(target),
    })


@query
def curriculum_rules(spark, sf_dir):
    """Rows as they are break no rule, damaged ones each of them."""
    return curricula.broken_rules(_with_damaged(curricula.second_rows(spark, views.cases(spark, sf_dir))), 1, "rows")


@query
def first_curriculum_rules(spark, sf_dir):
    return curricula.broken_rules(_with_damaged(curricula.first_rows(spark, views.cases(spark, sf_dir))), 0, "rows")


@query
def split_buckets(spark, sf_dir):
    rows = curricula.second_rows(spark, views.cases(spark, sf_dir))
    return curricula.bucket_counts(rows, "split", ["train", "eval", "unset"])


@query
def curriculum_list_counts(spark, sf_dir):
    return curricula.list_counts(curricula.second_rows(spark, views.cases(spark, sf_dir)))


def _outcomes(rows, valid):
    """What the driver's tables can't tell: valid intents of even tasks apply, those of every fourth solve their task."""
    applied = valid & (F.col("task_id") % 2 == 0)
    return rows.withColumns({"applied": applied, "solved": applied & (F.col("task_id") % 4 == 0), "parsed": F.col("find_text") != "", "responses": F.lit(1)})


def _validated(spark, sf_dir):
    rows = datasets.validated(views.intents(spark, sf_dir), views.FILES)
    return _outcomes(rows, F.col("valid")).withColumn("created", F.col("valid"))


@query
def intent_run_summary(spark, sf_dir):
    return runs.intent_run(_validated(spark, sf_dir))


@query
def toy_intent_summary(spark, sf_dir):
    return runs.toy_run(_validated(spark, sf_dir))


@query
def repair_run_summary(spark, sf_dir):
    rows = datasets.repaired(views.intents(spark, sf_dir), views.FILES, views.DEFAULT_FILE)
    return runs.repair_run(_outcomes(rows.drop("find_text").withColumnRenamed("original_find_text", "find_text"), F.col("repaired")))


@query
def validation_error_counts(spark, sf_dir):
    counts = runs.counter(_validated(spark, sf_dir), "error")
    return counts.select(F.explode("counts").alias("error", "n"))


def _prompts(spark, sf_dir):
    """Two messages for each document, one without a mark for every third."""
    first = F.concat(F.lit("Task\n\nCurrent file app/utils.py:\n```python\n"), F.col("text"), F.lit("```\n\nTests:\n```python\n"), F.col("source"))
    marks = F.when(F.col("doc_id") % 3 == 0, "```\n\nBehavior:\n").otherwise("```\n\nExpected behavior:\n")
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    messages = F.array(say("system", F.lit("Edit.")), say("user", F.concat(first, marks, F.lit(" "), F.col("lang"), F.lit("\n"))))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("task_id"), messages.alias("messages"))


@query
def replay_rows(spark, sf_dir):
    results = datasets.validated(views.intents(spark, sf_dir), views.FILES).select("task_id", "valid")
    return runs.replay(results, _prompts(spark, sf_dir))


def _raw_intents(spark, sf_dir):
    """JSON intents of documents: bare, fenced, without a field, no JSON at all; some without a rationale."""
    d = F.col("doc_id")
    whole = F.struct(
        d.cast("string").alias("intent_id"), F.lit("t").alias("task_id"), F.lit("app/utils.py").alias("file_path"), F.col("text").alias("find_text"),
        F.when(d % 7 != 0, F.col("source")).alias("replace_text"), F.when(d % 2 == 0, F.col("lang")).alias("rationale"),
    )
    body = F.to_json(whole)
    raw = F.when(d % 5 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(d % 5 == 2, F.concat(F.lit("Sure: "), body)).when(d % 5 == 3, "[1]").otherwise(body)
    return table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))


@query
def typed_intents(spark, sf_dir):
    return _raw_intents(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in runs.typed_intent(F.col("raw")).items()])


@query
def response_rows(spark, sf_dir):
    fields = runs.response_fields(F.struct(
        F.col("conv_id").cast("string").alias("response_id"), F.when(F.col("turn") % 2 == 0, F.col("text")).alias("text"),
        F.when(F.col("turn") % 3 == 0, F.create_map(F.lit("role"), F.col("role"))).alias("metadata"), F.lit(None).cast("long").alias("token_count"),
    ))
    rows = table(spark, sf_dir, "conversations").select("turn", *[c.alias(n) for n, c in fields.items()])
    return rows.withColumn("metadata", runs.key_values(F.transform(F.map_entries("metadata"), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))))


@query
def command_tails(spark, sf_dir):
    """Commands that ran, were skipped or have no record: 1,600 characters of stderr, 800 of stdout."""
    d = F.col("doc_id")
    record = prompts.compact_command(F.when(d % 9 == 0, F.lit(None)).when(d % 9 == 1, prompts.skipped("patch_apply_failed")).otherwise(F.struct(
        F.lit("run").alias("command"), (F.col("doc_id") % 2).cast("int").alias("exit_code"), F.col("text").alias("stderr"), F.concat("text", "source").alias("stdout"),
    )))
    return table(spark, sf_dir, "documents").select("doc_id", record.alias("r")).select("doc_id", "r.*")


@query
def module_targets(spark, sf_dir):
    """Which of the wanted suffixes each module's name ends in, and whether it is a target at all."""
    wanted = ["lace", "green", "blue", "khaki", "navy", "snow", "sky", "rose"]
    name = F.lower("p_name")
    hit = F.filter(F.array(*[F.lit(w) for w in wanted]), lambda w: F.endswith(name, w))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(hit, ",").alias("suffixes"), (F.size(hit) > 0).alias("targeted"))


@query
def target_modules(spark, sf_dir):
    """The suffixes that any module's name ends in, sorted, and how many names they are of."""
    rows = module_targets(spark, sf_dir).filter("targeted").select(F.explode(F.split("suffixes", ",")).alias("suffix"), "p_partkey")
    return rows.agg(F.array_join(F.array_sort(F.collect_set("suffix")), ",").alias("suffixes"), F.countDistinct("p_partkey").alias("targets"))


@query
def length_report(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", F.length("text").cast("long").alias("chars"), text.tokens(F.col("text")).alias("tokens"))
    return summaries.length_report(rows, "lang", "tokens", "chars", LIMIT)


def _tasks(spark, sf_dir):
    file = lambda path, body: F.struct(F.lit(path).alias("path"), body.alias("text"))
    files = F.when(F.col("doc_id") % 10 == 0, F.array().cast("array<struct<path:string,text:string>>")).otherwise(F.array(file("app/a.py", F.col("text"))))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("task_id"), F.concat(F.lit("Fix "), F.col("source")).alias("title"), F.lit("bugfix").alias("task_type"),
        F.col("lang").alias("description"), F.lit("run tests").alias("test_command"), files.alias("files"), F.col("text").alias("stderr"), F.col("source").alias("previous"),
    )


@query
def patch_messages(spark, sf_dir):
    return _flat(_tasks(spark, sf_dir).select("task_id", prompts.patch_messages(F.col("files"), F.col("stderr"), F.col("previous")).alias("messages")))


@query
def strict_messages(spark, sf_dir):
    rows = _tasks(spark, sf_dir).select("task_id", prompts.strict_messages(F.col("files"), F.col("stderr")).alias("messages"), prompts.contract().alias("contract"))
    return _flat(rows).select("task_id", "system", "user", "contract.*")
