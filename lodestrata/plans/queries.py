"""Registered queries: one for each operator family, over the stand-in views of whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import rules, scoring, text
from lodestrata.operators import datasets, evaluation, prompts, summaries, trajectory
from lodestrata.plans import views
from lodestrata.sources import files, responses
from lodestrata.sources.files import table

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
MOST = 5
STOPS = ["\n", ". ", " de "]
HELD_OUT = 10
LIMIT = 512
# The risks that every launch plan names.
RISKS = ["insufficient_gpu_quota", "dataset_too_small_for_real_improvement", "training_completes_but_agentic_quality_does_not_improve", "cloudshell_runtime_limit"]
# The gates before training.
GATES = [
    "dataset_lineage_gate", "license_and_terms_gate", "pii_secret_malware_filter_gate", "deduplication_gate", "benchmark_contamination_gate", "tokenization_gate", "quality_scoring_gate", "eval_holdout_gate",
    "training_mixture_manifest_gate", "explicit_cost_approval_gate",
]


def query(f: Query) -> Query:
    FOUND[f.__name__] = f
    return f


def _long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


# --- attempts ---
@query
def patch_reward(spark, sf_dir):
    return views.attempts(spark, sf_dir).select("task_id", "patch_id", "reward")


@query
def batch_summary(spark, sf_dir):
    return summaries.batch(views.attempts(spark, sf_dir))


@query
def batch_failed_tasks(spark, sf_dir):
    return views.attempts(spark, sf_dir).filter("not post_tests_passed").select("task_id", "patch_id")


def _attempt_rows(spark, sf_dir):
    return datasets.attempt_rows(trajectory.carry_failure(views.events(spark, sf_dir), views.ATTEMPT_ORDER))


@query
def patch_attempts(spark, sf_dir):
    """Structs as columns of their own."""
    rows = _attempt_rows(spark, sf_dir)
    whole = [c for c in rows.columns if c not in ("input", "output", "metadata")]
    return rows.select(*whole, "input.*", "output.patch", "metadata.*")


@query
def sft_positive(spark, sf_dir):
    rows = datasets.positive_rows(_attempt_rows(spark, sf_dir))
    said = lambda i, name: F.element_at("messages", i)["content"].alias(f"{name}_content")
    return rows.select("schema_version", "example_id", "task_id", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), said(1, "system"), said(2, "user"), said(3, "assistant"), "reward", "metadata.*")


@query
def trajectory_summary(spark, sf_dir):
    return trajectory.summarize(trajectory.up_to_success(views.events(spark, sf_dir), views.ATTEMPT_ORDER), views.ATTEMPT_ORDER)


@query
def self_repair_loop(spark, sf_dir):
    return trajectory.repair_result(views.attempts(spark, sf_dir, MOST), MOST)


@query
def best_so_far(spark, sf_dir):
    return trajectory.best_so_far(views.attempt_parts(spark, sf_dir)).select("task_id", "iteration", "reward", "best_reward", "best_patch_id")


@query
def loop_state_check(spark, sf_dir):
    return trajectory.loop_state(views.attempt_parts(spark, sf_dir), MOST).select("task_id", "iteration", "is_contiguous", "solved", "should_continue")


# --- candidates ---
def _selected(spark, sf_dir):
    return trajectory.selected(views.candidates(spark, sf_dir), views.TIES)


@query
def verifier_ranking(spark, sf_dir):
    return trajectory.ranked(views.candidates(spark, sf_dir), views.TIES).select("task_id", "part", "supp", "line", "reward", "place")


@query
def verifier_selected(spark, sf_dir):
    return _selected(spark, sf_dir).select("task_id", "part", "supp", "line", "reward", F.col("post_tests_passed").alias("solved"), "candidate_count")


def _task_results(spark, sf_dir, only: str = "true"):
    """``only``: a condition on the candidates of the run."""
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), "o_orderpriority")
    joined = tasks.join(trajectory.selected(views.candidates(spark, sf_dir).filter(only), views.TIES), "task_id", "left")
    return joined.select(
        "task_id", "o_orderpriority", F.coalesce("post_tests_passed", F.lit(False)).alias("solved"), F.coalesce("reward", F.lit(0.0)).alias("selected_reward"), F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"),
        F.when(F.col("candidate_count").isNull(), 1).otherwise(0).cast("long").alias("parse_failure_count"), F.coalesce("any_applied", F.lit(False)).alias("any_applied"),
    )


@query
def experiment_task_results(spark, sf_dir):
    return _task_results(spark, sf_dir)


@query
def experiment_summary(spark, sf_dir):
    return summaries.experiment(_task_results(spark, sf_dir))


@query
def run_delta(spark, sf_dir):
    now = summaries.experiment(_task_results(spark, sf_dir))
    return now.select(*[(F.col(c) - F.lit(0)).alias(f"{c}_delta") for c in ("solved_tasks", "solve_rate", "tasks_with_applied_patch")])


@query
def run_comparison(spark, sf_dir):
    """The run of all candidates against an earlier one that had the first candidate of each task alone."""
    now, before = summaries.experiment(_task_results(spark, sf_dir)), summaries.experiment(_task_results(spark, sf_dir, "line = 1"))
    return summaries.compared(now, before, {"patch_apply_success": "tasks_with_applied_patch", "solved_tasks": "solved_tasks"})


@query
def task_failure_modes(spark, sf_dir):
    reason = F.when(~F.col("patch_applied"), F.array(F.lit("patch_apply_failed"), F.lit("post_tests_failed"))).when(~F.col("post_tests_passed"), F.array(F.lit("post_tests_failed")))
    rows = views.candidates(spark, sf_dir).withColumn("reasons", reason)
    grouped = rows.groupBy("task_id").agg(F.max("post_tests_passed").alias("solved"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))), ",").alias("reasons"), F.max("reward").alias("selected_reward"))
    return grouped.filter("not solved").select("task_id", "reasons", "selected_reward")


KS = [1, 5, 20]
MARGIN = 0.5


@query
def pass_rates(spark, sf_dir):
    """pass@k and repair@k of all users' attempts."""
    rows = evaluation.estimates(views.events(spark, sf_dir), KS).join(evaluation.repaired_within(views.attempts(spark, sf_dir, max(KS)), KS).withColumnRenamed("tasks", "all_tasks"), "k")
    return rows.select("k", "tasks", "pass_at_k", "all_tasks", "repair_at_k")


@query
def solving_cost(spark, sf_dir):
    return evaluation.cost(views.events(spark, sf_dir), views.ATTEMPT_ORDER)


@query
def preference_pairs(spark, sf_dir):
    rows = evaluation.preference_pairs(views.candidates(spark, sf_dir), views.TIES, MARGIN)
    return rows.select("task_id", *views.TIES, "reward", *[F.col(f"rejected.{c}").alias(f"rejected_{c}") for c in (*views.TIES, "reward")])


# --- responses ---
@query
def diff_extract(spark, sf_dir):
    rows = views.responses(spark, sf_dir).withColumn("diff", text.unified_diff(F.col("raw")))
    return rows.select("task_id", "diff", text.diff_error(F.col("diff")).alias("error"))


@query
def parse_failures(spark, sf_dir):
    rows = views.responses(spark, sf_dir).withColumn("error", text.diff_error(text.unified_diff(F.col("raw"))))
    return rows.filter("error is not null").select("task_id", "error", F.left("raw", F.lit(500)).alias("raw_text_preview"))


def _hygiene(spark, sf_dir):
    rows = text.hygiene(views.responses(spark, sf_dir), "raw")
    return rows.drop("raw").withColumnRenamed("block", "sanitized_diff").withColumn("notes", F.array_join("notes", "|"))


@query
def patch_hygiene_rows(spark, sf_dir):
    return _hygiene(spark, sf_dir)


@query
def patch_hygiene_summary(spark, sf_dir):
    return summaries.hygiene(_hygiene(spark, sf_dir))


@query
def stop_sequences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.cut_at_stop(F.col("text"), STOPS).alias("cut"))


@query
def marker_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.between(F.col("html"), "<title>", "</title>").alias("title"), F.length(text.after(F.col("html"), "</title>")).cast("long").alias("rest_chars"))


@query
def json_object_extract(spark, sf_dir):
    e = F.col("event_id")
    raw = F.when(e % 3 == 0, F.col("props")).when(e % 3 == 1, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).otherwise("no object here")
    rows = table(spark, sf_dir, "events").select("event_id", text.json_object(raw).alias("object"))
    return rows.select("event_id", "object", F.get_json_object("object", "$.k").alias("k"))


@query
def truncated_previews(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncated(F.col("text"), 1500, "\n...[truncated]...").alias("preview"))


@query
def safe_names(spark, sf_dir):
    uri = F.concat(F.lit("s3://"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit("/"), F.col("p_name"))
    bucket, key = text.s3_parts(uri)
    return table(spark, sf_dir, "part").select("p_partkey", text.safe_name(uri).alias("name"), bucket.alias("bucket"), key.alias("key"))


# --- intents ---
@query
def intent_validation(spark, sf_dir):
    return datasets.validated(views.intents(spark, sf_dir), views.FILES).select("task_id", "file_exists", "edits_tests", "occurrences", "error", "valid")


@query
def intent_repair(spark, sf_dir):
    rows = datasets.repaired(views.intents(spark, sf_dir), views.FILES, views.DEFAULT_FILE)
    return rows.select("task_id", "original_error", "file_path", "replace_text", F.array_join("repair_actions", ",").alias("repair_actions"), "repaired", "repair_error")


@query
def canonical_patch(spark, sf_dir):
    return datasets.canonical_patches(datasets.validated(views.intents(spark, sf_dir), views.FILES))


def _classified(spark, sf_dir):
    return datasets.forensics(datasets.validated(views.intents(spark, sf_dir), views.FILES))


@query
def failure_classification(spark, sf_dir):
    return _classified(spark, sf_dir).select("task_id", "category", F.coalesce("details", F.lit("None")).alias("error"))


@query
def failure_histogram(spark, sf_dir):
    return _classified(spark, sf_dir).groupBy("category", F.coalesce("details", F.lit("None")).alias("error")).agg(F.count("*").alias("n"))


@query
def intent_forensics(spark, sf_dir):
    """Similarities, which SQL can't tell, only as being near."""
    rows = _classified(spark, sf_dir)
    return rows.select("task_id", "category", "details", (F.col("find_text_similarity") >= datasets.NEAR).alias("near"), "replace_text_present", "file_path", "expected_preview", "find_preview", "diff_expected_vs_find")


# --- chats ---
@query
def chat_validation(spark, sf_dir):
    rows = views.chats(spark, sf_dir).withColumn("issues", rules.chat_issues(F.col("messages")))
    return rows.select("task_id", F.size("messages").cast("long").alias("n_messages"), F.size("issues").cast("long").alias("n_issues"))


def _sft(spark, sf_dir):
    rows = views.sft_rows(spark, sf_dir)
    return rows.withColumn("issues", rules.sft_issues(F.col("schema_version"), F.col("messages"), F.col("target"), views.VERSION, views.DEFAULT_FILE))


@query
def sft_row_validation(spark, sf_dir):
    return _sft(spark, sf_dir).select("task_id", F.size("issues").cast("long").alias("n_issues"), (F.size("issues") == 0).alias("valid"))


@query
def sft_validation_issues(spark, sf_dir):
    return _sft(spark, sf_dir).select("task_id", F.explode("issues").alias("i")).select("task_id", "i.field", "i.message")


@query
def message_checks(spark, sf_dir):
    """Of each transcript whether any message is empty and whether all roles are known."""
    rows = views.chats(spark, sf_dir)
    return rows.select("task_id", F.exists("messages", lambda m: F.coalesce(m["content"], F.lit("")) == "").alias("any_empty"), F.forall("messages", lambda m: m["role"].isin(*rules.CHAT_ROLES)).alias("all_roles_known"), F.exists("messages", lambda m: m["role"] == "assistant").alias("any_assistant"))


@query
def training_examples(spark, sf_dir):
    rows = datasets.training_examples(views.chats(spark, sf_dir))
    return rows.select("task_id", F.size("prompt_messages").cast("long").alias("n_prompt"), F.array_join(F.transform("prompt_messages", lambda m: F.concat_ws(":", m["role"], m["content"])), "\n").alias("prompt"), "assistant_target")


@query
def train_eval_holdout(spark, sf_dir):
    keys = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("task_id")).distinct()
    return trajectory.hold_out(keys, "task_id", HELD_OUT)


@query
def modulo_split(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id").distinct().select("conv_id", datasets.modulo_split(F.col("conv_id")).alias("split"))


@query
def chat_render_a(spark, sf_dir):
    return views.chats(spark, sf_dir).select("task_id", text.render_plain(F.col("messages")).alias("rendered"))


@query
def chat_render_b(spark, sf_dir):
    m = F.col("messages")
    return views.chats(spark, sf_dir).select("task_id", text.render_training(F.slice(m, F.lit(1), F.size(m) - 1), F.element_at(m, -1)["content"]).alias("rendered"))


@query
def chat_render_c(spark, sf_dir):
    return views.chats(spark, sf_dir).select("task_id", text.render_prompt(F.col("messages")).alias("rendered"))


@query
def token_rows(spark, sf_dir):
    rows = datasets.training_examples(views.chats(spark, sf_dir))
    full = text.render_plain(F.col("full_messages"))
    return rows.select("task_id", text.tokens(full).alias("full_tokens"), text.tokens(F.col("assistant_target")).alias("target_tokens"), F.length(full).cast("long").alias("full_chars"))


@query
def token_stats(spark, sf_dir):
    return summaries.token_stats(token_rows(spark, sf_dir).withColumnRenamed("full_tokens", "tokens"))


def _document_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", datasets.modulo_split(F.col("doc_id")).alias("split"), text.tokens(F.col("text")).alias("tokens"))


@query
def token_report(spark, sf_dir):
    return summaries.token_report(_document_tokens(spark, sf_dir), ["lang", "split"], "tokens", LIMIT)


@query
def tokenization_gate(spark, sf_dir):
    clipped = F.least(F.col("tokens"), F.lit(LIMIT))
    return _document_tokens(spark, sf_dir).agg(
        F.count("*").alias("row_count"), F.count_if(F.col("tokens") > LIMIT).alias("over_limit"), F.count_if(clipped >= LIMIT).alias("clipped_rows"), F.coalesce(F.bool_or(clipped >= LIMIT), F.lit(False)).alias("any_truncated"),
        (F.count_if(F.col("tokens") > LIMIT) == 0).alias("passed"), F.greatest(F.lit(128), F.max(clipped) + 64).cast("long").alias("recommended_length"),
    )


@query
def first_response(spark, sf_dir):
    return datasets.first_response(table(spark, sf_dir, "conversations"))


# --- curricula and registries ---
@query
def curriculum_v1(spark, sf_dir):
    return datasets.curriculum(spark, views.cases(spark, sf_dir))


@query
def curriculum_v0(spark, sf_dir):
    return datasets.first_curriculum(spark, views.cases(spark, sf_dir))


@query
def curriculum_counts(spark, sf_dir):
    rows = datasets.curriculum(spark, views.cases(spark, sf_dir))
    kinds = ["category", "split", "difficulty"]
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in kinds]))
    counts = rows.groupBy(*kinds).agg(F.count("*").alias("rows")).select(each, "rows").groupBy("kind", "value").agg(F.sum("rows").alias("n"))
    ids = rows.agg(F.lit("unique_task_ids").alias("kind"), F.lit("all").alias("value"), F.countDistinct("task_id").alias("n"))
    return counts.unionByName(ids)


@query
def run_registry(spark, sf_dir):
    return datasets.registry(views.document_manifests(spark, sf_dir), views.PROJECT).select("stage", "path", "result", "display_step", "sort_key")


@query
def registry_report(spark, sf_dir):
    """The registry's report, a line for each entry."""
    rows = run_registry(spark, sf_dir)
    return rows.select("sort_key", "stage", files.markdown_line(["display_step", "stage", "path", "result"]).alias("line"))


@query
def json_documents(spark, sf_dir):
    """Documents' facts as indented JSON."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return rows.select("doc_id", files.document(rows.columns).alias("document"))


# --- labelled documents ---
def _records(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    applied, solved = F.col("quality") == 1, (F.col("quality") == 1) & (F.col("toxic") == 0)
    return docs.join(labels, "doc_id").select("doc_id", solved.alias("solved"), scoring.tiered_reward(solved, applied).alias("reward"), F.col("text").alias("target"))


@query
def trajectory_records(spark, sf_dir):
    return _records(spark, sf_dir).select("doc_id", "solved", "reward", F.when(F.col("reward") > 0, "positive").otherwise("negative").alias("label"), F.left("target", F.lit(500)).alias("preview"))


@query
def trajectory_sft_rows(spark, sf_dir):
    """Records with the first text of their conversation (none: empty) as supervised rows, flat."""
    texts = datasets.first_response(table(spark, sf_dir, "conversations")).withColumnRenamed("conv_id", "doc_id")
    rows = datasets.trajectory_sft(_records(spark, sf_dir).join(texts, "doc_id", "left"))
    said = lambda i: F.element_at("messages", i)["content"]
    return rows.select("doc_id", "schema_version", said(1).alias("user"), said(2).alias("assistant"), "metadata.*")


@query
def optional_reads(spark, sf_dir):
    """Texts of labelled documents, of which some aren't there, as the four optional reads give them."""
    asked = table(spark, sf_dir, "labels").select("doc_id").distinct()
    found = asked.join(table(spark, sf_dir, "documents").filter("doc_id % 10 <> 0").groupBy("doc_id").agg(F.min("text").alias("text")), "doc_id", "left")
    reads = {n: text.optional(F.col("text"), most) for n, most in text.READS.items()}
    return found.select("doc_id", F.length(reads["patch"]).cast("long").alias("patch_chars"), *[reads[n].alias(n) for n in text.READS if n != "patch"])


@query
def enriched_records(spark, sf_dir):
    """Defaults of a task under what its document says: keys in order, the document's values win where it has them."""
    of = lambda **named: F.create_map(*[x for k, v in named.items() for x in (F.lit(k), v)])
    default = of(task_id=F.col("doc_id").cast("string"), source=F.lit("unknown"), lang=F.lit("und"), kind=F.lit("document"))
    own = F.map_filter(of(source=F.col("source"), lang=F.col("lang"), n_chars=F.col("n_chars").cast("string")), lambda k, v: v.isNotNull())
    entries = F.array_sort(F.map_entries(datasets.merged(default, F.when(F.col("doc_id") % 3 > 0, own))))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("record"))


@query
def sft_dataset_summary(spark, sf_dir):
    return summaries.sft_dataset(_records(spark, sf_dir))


@query
def set_ops(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    split = docs.withColumn("split", datasets.modulo_split(F.col("doc_id")))
    both = split.filter("split = 'train'").unionByName(split.filter("split = 'eval'"))
    again = table(spark, sf_dir, "documents").groupBy("text").count().filter("count > 1")
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count(both, "train_and_eval").unionByName(count(docs.join(labels, "doc_id", "left_anti"), "without_label")).unionByName(count(again, "repeated_texts")).unionByName(count(table(spark, sf_dir, "documents").select("lang", "source").distinct(), "lang_source"))


@query
def parameter_counts(spark, sf_dir):
    return summaries.parameters(table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("size"), (F.col("p_size") > 25).alias("trainable")))


def _configs():
    return {"max_new_tokens": F.col("l_linenumber") - 2, "temperature": F.col("l_discount") - 0.05, "top_p": F.col("l_quantity") / 25, "top_k": F.when(F.col("l_returnflag") == "N", F.lit(-1)), "num_return_sequences": F.col("l_linenumber") - 1, "repetition_penalty": F.when(F.col("l_returnflag") == "R", F.col("l_tax"))}


@query
def generation_config_export(spark, sf_dir):
    """The configurations without an issue, as they are stored."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rules.exported_config(_configs(), F.array(F.lit("\n"), F.lit("###"))).alias("c"))
    return rows.filter("c is not null").select("l_orderkey", "l_linenumber", "c.*").withColumn("stop_sequences", F.array_join("stop_sequences", "|"))


@query
def generation_config_validation(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("issues", rules.generation_issues(_configs()))
    return rows.groupBy(F.array_join(F.transform("issues", lambda i: i["field"]), ",").alias("fields")).agg(F.count("*").alias("n"))


@query
def task_validation(spark, sf_dir):
    k = F.col("c_custkey")
    c = {"schema_version": F.when(k % 5 != 0, F.when(k % 7 == 0, "v9").otherwise("v0")), "task_id": k, "title": F.col("c_name"), "repo_dir": F.when(k % 3 != 0, F.col("c_mktsegment")), "test_command": F.lit("run"), "timeout_seconds": F.floor("c_acctbal")}
    rows = table(spark, sf_dir, "customer").select("c_custkey", rules.task_issues(c, "v0").alias("issues"))
    return rows.select("c_custkey", F.array_join(F.transform("issues", lambda i: F.concat_ws(":", i["field"], i["message"])), ",").alias("issues"))


@query
def launch_plan(spark, sf_dir):
    """One-row documents joined side by side."""
    one = lambda df: df.withColumn("one", F.lit(1))
    joined = one(token_stats(spark, sf_dir)).join(one(parameter_counts(spark, sf_dir)), "one").join(one(sft_dataset_summary(spark, sf_dir).select(F.col("row_count").alias("dataset_rows"))), "one")
    joined = joined.join(one(tokenization_gate(spark, sf_dir).select("passed", "over_limit")), "one")
    return joined.select("row_count", "max_tokens", "trainable_percent", "dataset_rows", F.col("passed").alias("tokenization_passed"), "over_limit", F.lit(",".join(RISKS)).alias("risks"), F.greatest(F.lit(128), F.col("max_tokens") + 64).cast("long").alias("sequence_length"))


@query
def governance_plan(spark, sf_dir):
    """The gates before training beside the rows of each source that they stand before."""
    sources = table(spark, sf_dir, "documents").groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("current_rows"))
    gates = F.posexplode(F.array(*[F.lit(g) for g in GATES])).alias("place", "gate")
    return sources.select("source", "current_rows", gates).select("source", "current_rows", "place", "gate", F.lit(False).alias("training_grade"), F.lit(True).alias("requires_explicit_approval"))


# --- prompts, identifiers, records ---
@query
def response_ids(spark, sf_dir):
    return prompts.response_ids(views.chats(spark, sf_dir), "scripted")


@query
def scripted_outputs(spark, sf_dir):
    """Of the outputs that each transcript holds, the first two."""
    rows = views.chats(spark, sf_dir)
    said = F.transform(F.filter("messages", lambda m: m["role"] == "assistant"), lambda m: m["content"])
    return prompts.first_outputs(rows, said, 2)


def _echo():
    """A scripted adapter: the first and the last message, again."""
    return lambda prompt, messages: [messages[0]["content"] or "", messages[-1]["content"] or ""] if messages else []


@query
def adapter_responses(spark, sf_dir):
    return responses.responses(views.chats(spark, sf_dir), _echo)


@query
def typed_tasks(spark, sf_dir):
    """Task documents of customers: absolute and relative folders, numbers as texts, missing fields, no JSON at all."""
    k = F.col("c_custkey")
    seconds = F.when(k % 4 == 0, '"30"').when(k % 4 == 1, (k % 100).cast("string")).when(k % 4 == 2, "2.75").otherwise('"x"')
    more = F.when(k % 3 == 0, ',"task_type":"refactor"').otherwise("")
    title = F.when(k % 7 == 0, "").otherwise(F.concat(F.lit('"title":"'), F.col("c_name"), F.lit('",')))
    raw = F.concat(F.lit('{"schema_version":"v0","task_id":'), k, F.lit(","), title, F.lit('"repo_dir":"'), F.when(k % 2 == 0, "/abs/").otherwise("rel/"), F.col("c_mktsegment"), F.lit('","test_command":"run","timeout_seconds":'), seconds, more, F.when(k % 11 == 0, "").otherwise("}"))
    rows = prompts.typed_tasks(table(spark, sf_dir, "customer").select("c_custkey", raw.alias("document")), "document", "base")
    return rows.drop("document")


@query
def resolved_specs(spark, sf_dir):
    k = F.col("p_partkey")
    path = F.when(k % 3 == 0, F.concat(F.lit("/abs/"), F.col("p_brand"))).otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", prompts.resolved(path, "specs/").alias("path"))


@query
def patch_prompts(spark, sf_dir):
    file = lambda path, body: F.struct(F.lit(path).alias("path"), body.alias("text"))
    files = F.when(F.col("doc_id") % 10 == 0, F.array().cast("array<struct<path:string,text:string>>")).otherwise(F.array(file("app/a.py", F.col("text")), file("README.md", F.col("source"))))
    return table(spark, sf_dir, "documents").select("doc_id", prompts.patch_prompt(F.col("doc_id").cast("string"), files, F.col("text"), F.col("lang")).alias("prompt"))


@query
def command_records(spark, sf_dir):
    record = prompts.command_record(F.array(F.lit("run"), F.col("s_name"), F.col("s_nationkey").cast("string")), F.when(F.col("s_nationkey") % 4 != 0, F.col("s_nationkey") % 3))
    return table(spark, sf_dir, "supplier").select("s_suppkey", *[c.alias(n) for n, c in record.items()])


@query
def curriculum_violations(spark, sf_dir):
    """Against the figures of the literal curriculum: of another table's the counts are off."""
    return prompts.violations(datasets.curriculum(spark, views.cases(spark, sf_dir)), 192, 32, 12)


@query
def check_parts(spark, sf_dir):
    whole = F.split("first_check", "::")
    return datasets.first_curriculum(spark, views.cases(spark, sf_dir)).select("task_id", F.element_at(whole, 1).alias("file_part"), F.element_at(whole, -1).alias("test_part"))


from lodestrata.plans import run_queries as _run_queries  # noqa: E402, F401  (registers its queries)
