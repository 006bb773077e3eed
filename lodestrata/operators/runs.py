"""Run registries, summaries of intent runs and repairs, prompt contexts and typed intents of model outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import scoring, text
from lodestrata.operators.datasets import NAMESPACE

# Fixed values of the static registry: step, name, category, stem of its manifest and archive, results, metrics.
ENTRIES = [
    (9, "agentic_eval_harness", "evaluation_core", "step9_agentic_eval_harness", "step9_eval_harness",
     ["results/09_agentic_eval_harness/toy_patch_eval_result.json"], [("toy_patch_eval", "ok"), ("reward", "1.25")]),
    (10, "batch_benchmark_harness", "evaluation_core", "step10_batch_benchmark_harness", "step10_batch_benchmark",
     ["results/10_batch_benchmark_harness/toy_benchmark_v0/results.jsonl", "results/10_batch_benchmark_harness/toy_benchmark_v0/summary.json"],
     [("total_tasks", "3"), ("solved_tasks", "3"), ("pass_rate", "1.0"), ("average_reward", "1.25")]),
    (11, "self_repair_loop", "agent_loop", "step11_self_repair_loop", "step11_self_repair",
     ["results/11_self_repair_loop/toy_self_repair_v0/trajectory.json"], [("solved", "True"), ("iterations_used", "2"), ("best_reward", "1.25")]),
    (12, "trajectory_dataset_exporter", "data_generation", "step12_trajectory_dataset", "step12_trajectory_dataset",
     [f"results/12_trajectory_dataset/toy_self_repair_v0/{f}" for f in ("patch_attempts.jsonl", "sft_positive.jsonl", "summary.json")],
     [("total_attempts", "2"), ("positive_attempts", "1"), ("negative_attempts", "1")]),
    (13, "executable_verifier_reranker", "verifier", "step13_executable_verifier", "step13_executable_verifier",
     ["results/13_executable_verifier/toy_executable_verifier_v0/verification.json"],
     [("candidate_count", "3"), ("selected_patch_id", "good_patch_modulo"), ("solved", "True"), ("selected_reward", "1.25")]),
    (14, "model_io_layer", "model_interface", "step14_model_io", "step14_model_io",
     [f"results/14_model_io_layer/toy_model_io_v0/{f}" for f in ("prompt_messages.json", "raw_model_response.txt", "parsed.patch", "eval_result.json")],
     [("patch_applied", "True"), ("post_tests_passed", "True"), ("reward", "1.25")]),
    (15, "candidate_generation_pipeline", "agent_pipeline", "step15_candidate_generation_pipeline", "step15_candidate_pipeline",
     [f"results/15_candidate_generation_pipeline/toy_candidate_pipeline_v0/{f}" for f in ("generation_pipeline_result.json", "prompt_messages.json")],
     [("raw_response_count", "3"), ("parsed_candidate_count", "2"), ("parse_failure_count", "1"), ("selected_patch_id", "raw_good_2_candidate_2"), ("solved", "True")]),
    (16, "agentic_experiment_runner", "experiment_runner", "step16_agentic_experiment_runner", "step16_experiment_runner",
     [f"results/16_agentic_experiment_runner/toy_agentic_experiment_v0/{f}" for f in ("task_results.jsonl", "summary.json")],
     [("total_tasks", "2"), ("solved_tasks", "2"), ("solve_rate", "1.0"), ("average_selected_reward", "1.25"), ("total_parse_failures", "2")]),
    (17, "run_registry_index", "experiment_control", "step17_run_registry", "step17_run_registry",
     ["reports/run_registry.json", "reports/run_registry.md"],
     [("registry_version", "v0"), ("entry_count_at_creation", "8"), ("covered_steps_at_creation", "9-16")]),
    (176, "engineering_decision_records", "engineering_documentation", "step17_6_engineering_records", "step17_6_engineering_records",
     ["reports/step17_6_engineering_records_manifest.json"], [("adr_min_count", "12"), ("bug_min_count", "5"), ("commit", "6611e43")]),
    (18, "real_model_adapter_contract", "model_runtime_boundary", "step18_model_adapter", "step18_model_adapter",
     [f"results/18_model_adapter/toy_model_adapter_v0/{f}" for f in ("prompt_messages.json", "generated_responses.jsonl", "candidate_pipeline_result.json", "model_adapter_result.json")],
     [("generated_response_count", "3"), ("parse_failure_count", "1"), ("selected_patch_id", "mock_good_max2_candidate_2"), ("solved", "True"), ("reward", "1.25"), ("real_model_downloaded", "False")]),
    (19, "tiny_real_model_smoke", "real_model_runtime", "step19_tiny_real_model_smoke", "step19_tiny_real_model_smoke",
     [f"results/19_tiny_real_model_smoke/sshleifer_tiny-gpt2/{f}" for f in ("prompt_messages.json", "generated_responses.jsonl", "parse_failures.json", "tiny_real_model_smoke_result.json")],
     [("model_id", "sshleifer/tiny-gpt2"), ("runtime", "local_transformers"), ("device", "cpu"), ("model_load_ok", "True"), ("real_generation_ok", "True"),
      ("generated_response_count", "1"), ("parsed_candidate_count", "0"), ("parse_failure_count", "1"), ("solve_required", "False")]),
]
ENTRY_COUNT = 12
ENTRY = "pos long, step long, name string, category string, manifest string, artifact string, results array<string>, metrics array<struct<k:string,v:string>>"


def entries(spark: SparkSession, bucket: str, commit: str, rows: DataFrame | None = None) -> DataFrame:
    """One row for each run (columns of ENTRY; without ``rows`` the literal ones), with its places below the bucket."""
    rows = spark.createDataFrame([(i, *e) for i, e in enumerate(ENTRIES)], ENTRY) if rows is None else rows
    at = lambda key: F.concat(F.lit(f"s3://{bucket}/"), key)
    return rows.select(
        "pos", "step", "name", F.lit("ok").alias("status"), "category", F.lit(commit).alias("git_commit"),
        at(F.concat(F.lit("reports/"), F.col("manifest"), F.lit("_manifest.json"))).alias("manifest_uri"),
        at(F.concat(F.lit(f"configs/project_scaffold/{NAMESPACE}_"), F.col("artifact"), F.lit("_v0.tar.gz"))).alias("artifact_uri"),
        F.transform("results", at).alias("primary_results"), "metrics",
        F.lit(False).alias("gpu_required"), F.lit(False).alias("purchase_required"),
    )


def key_values(pairs: Column) -> Column:
    """``k=v`` of array<struct<k, v>>, comma-joined in order."""
    return F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", p["k"], p["v"])), ", ")


def overview(registry: DataFrame, order: str, step: str) -> DataFrame:
    """Number of entries and the list of their steps in order; an empty registry has none."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(step).cast("string").alias("s")))), lambda x: x["s"])
    return registry.agg(F.count("*").alias("entry_count"), F.array_join(steps, ",").alias("steps"))


def registry_lines(registry: DataFrame) -> DataFrame:
    """The Markdown table's line of each entry."""
    cells = [F.col("step").cast("string"), *[F.concat(F.lit("`"), F.col(c), F.lit("`")) for c in ("name", "category", "status")]]
    gpu = F.when(F.col("gpu_required"), "yes").otherwise("no")
    return registry.select("pos", F.concat(F.lit("| "), F.concat_ws(" | ", *cells, gpu, key_values(F.col("metrics"))), F.lit(" |")).alias("line"))


def registry_markdown(registry: DataFrame, project: str, version: str, commit: str, bucket: str) -> str:
    """The whole report: its head, a table of the few literal runs, its notes."""
    facts = [("Project", project), ("Registry version", version), ("Git commit", commit), ("S3 bucket", bucket)]
    head = [f"# {project} Run Registry", "", *[f"- {k}: `{v}`" for k, v in facts], "", "## Runs", ""]
    table = ["| Step | Name | Category | Status | GPU | Key metrics |", "|---:|---|---|---|---|---|"]
    notes = ["", "## Notes", "", f"- Entries: {registry.count()}.", "- No GPU was required.", ""]
    return "\n".join([*head, *table, *[r.line for r in registry_lines(registry).orderBy("pos").collect()], *notes])


def intent_run(rows: DataFrame) -> DataFrame:
    """From rows of responses, parsed, valid, created, applied, solved: counts of a run of structured intents."""
    n, ok = F.count("*"), F.count_if("solved")
    responses = F.coalesce(F.sum("responses"), F.lit(0))
    return rows.agg(
        n.alias("total_tasks"), responses.alias("generated_response_count"), (responses > 0).alias("real_generation_ok"),
        F.count_if("parsed").alias("json_parse_success_count"), F.count_if("valid").alias("valid_intent_count"),
        F.count_if("created").alias("canonical_patch_count"), F.count_if("applied").alias("patch_apply_success_count"),
        ok.alias("solved_tasks"), (n - ok).alias("failed_tasks"), scoring.ratio(ok, n).alias("solve_rate"),
    )


def repair_run(rows: DataFrame) -> DataFrame:
    """Counts before and after repair, from rows of parsed, original_error, repaired, applied, solved."""
    n, ok = F.count("*"), F.count_if("solved")
    return rows.agg(
        n.alias("total_tasks"), F.count_if("parsed").alias("source_json_parse_success_count"),
        F.count_if(F.col("original_error").isNull()).alias("original_valid_intent_count"),
        F.count_if("repaired").alias("repaired_valid_intent_count"), F.count_if("repaired").alias("canonical_patch_count"),
        F.count_if("applied").alias("patch_apply_success_count"), ok.alias("solved_tasks"), scoring.ratio(ok, n).alias("solve_rate"),
    )


def toy_run(rows: DataFrame) -> DataFrame:
    """From rows of valid, applied, solved: the summary of hand-written intents, each of which has a patch."""
    n, ok = F.count("*"), F.count_if("solved")
    return rows.agg(
        n.alias("total_tasks"), F.count_if("valid").alias("valid_intents"), n.alias("canonical_patch_count"),
        F.count_if("applied").alias("patch_apply_success_count"), ok.alias("solved_tasks"), scoring.ratio(ok, n).alias("solve_rate"),
    )


def counter(rows: DataFrame, value: str) -> DataFrame:
    """A map of each value and how often it occurs, ordered by value; counted before it is collected."""
    counts = rows.groupBy(F.coalesce(F.col(value), F.lit("None")).alias("value")).agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("counts"))


# What stands before and after each block of a prompt.
BLOCKS = [
    ("current_file", "Current file app/utils.py:\n```python\n", "```\n\nTests:"),
    ("tests", "Tests:\n```python\n", "```\n\nExpected behavior:"),
]
BEHAVIOUR = "Expected behavior:\n"


def prompt_context(messages: Column) -> dict[str, Column]:
    """The current file, tests and expected behaviour in a prompt's messages; empty where a mark is missing."""
    whole = F.array_join(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), "\n\n")
    return {name: text.between(whole, a, b) for name, a, b in BLOCKS} | {"expected_behavior": text.after(whole, BEHAVIOUR)}


def replay(results: DataFrame, prompts: DataFrame) -> DataFrame:
    """Result rows with their prompts' contexts, by task."""
    return results.join(prompts.select("task_id", *[c.alias(n) for n, c in prompt_context(F.col("messages")).items()]), "task_id")


INTENT_FIELDS = ["intent_id", "task_id", "file_path", "find_text", "replace_text"]


def typed_intent(raw: Column) -> dict[str, Column]:
    """Fields of a model's JSON intent, fence lines dropped; error if it is no object or lacks a field."""
    body = text.unfenced(raw)
    known = F.try_parse_json(body)
    is_object = F.coalesce(F.schema_of_variant(known), F.lit("")).startswith("OBJECT")
    value = lambda name: F.try_variant_get(known, f"$.{name}", "string")
    lacks = F.lit(False)
    for name in INTENT_FIELDS:
        lacks = lacks | value(name).isNull()
    error = F.when(~is_object, "invalid_json").when(lacks, "missing_field")
    fields = {name: F.when(error.isNull(), value(name)) for name in INTENT_FIELDS}
    return fields | {"rationale": F.when(error.isNull(), F.coalesce(value("rationale"), F.lit(""))), "error": error}


def response_fields(row: Column) -> dict[str, Column]:
    """A response's id, text, model and token count, with the defaults of those that are missing."""
    return {
        "response_id": row["response_id"], "text": F.coalesce(row["text"].cast("string"), F.lit("")),
        "metadata": F.coalesce(row["metadata"], F.expr("map()").cast("map<string,string>")), "token_count": row["token_count"],
    }
