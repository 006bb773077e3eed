"""Prompts, identifiers and small records: what is built from text and literals alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text
from lodestrata.operators import datasets


def response_ids(messages: DataFrame, adapter: str) -> DataFrame:
    """Responses of chats by position: response id, candidate id and source ``adapter:model``."""
    each = messages.select("task_id", F.posexplode(F.filter("messages", lambda m: m["role"] == "assistant")).alias("pos", "m"))
    response = F.concat_ws("_", F.col("task_id"), F.lit("resp"), F.col("pos"))
    return each.select("task_id", "pos", response.alias("response_id"), F.concat(response, F.lit("_candidate_"), F.col("pos")).alias("candidate_id"), F.concat_ws(":", F.lit(adapter), F.lit("model")).alias("source"))


def first_outputs(rows: DataFrame, outputs: Column, n: int) -> DataFrame:
    """The first n outputs of each row by position, as responses."""
    return rows.select("task_id", F.posexplode(F.slice(outputs, 1, n)).alias("pos", "text")).withColumn("response_id", F.concat_ws("_", "task_id", F.lit("resp"), "pos"))


def typed_tasks(rows: DataFrame, document: str, base: str) -> DataFrame:
    """Task documents (JSON text) with their fields' types and defaults; error: what a strict reader would raise.

    Numbers are read as texts and texts as whole numbers where the type asks for it; a fraction is cut. Relative folders stand below ``base``."""
    parsed = F.try_parse_json(F.col(document))
    said = lambda name: F.try_variant_get(parsed, f"$.{name}", "string")
    required = ["schema_version", "task_id", "title", "repo_dir", "test_command", "timeout_seconds"]
    missing = F.array_compact(F.array(*[F.when(said(n).isNull(), n) for n in required]))
    seconds = F.coalesce(F.try_variant_get(parsed, "$.timeout_seconds", "double").cast("long"), said("timeout_seconds").try_cast("long"))
    whole = F.when(F.schema_of_variant(F.try_variant_get(parsed, "$.timeout_seconds", "variant")) == "STRING", F.trim(said("timeout_seconds")).try_cast("long")).otherwise(seconds)
    error = F.when(parsed.isNull(), "no_json").when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(missing, ","))).when(whole.isNull(), "timeout_not_whole")
    fields = {n: said(n) for n in required[:-1]} | {"repo_dir": resolved(said("repo_dir"), base), "timeout_seconds": whole, "task_type": F.coalesce(said("task_type"), F.lit("unit_bugfix")), "description": F.coalesce(said("description"), F.lit(""))}
    return rows.withColumn("error", error).withColumns({n: F.when(F.col("error").isNull(), c) for n, c in fields.items()})


def resolved(path: Column, base: str) -> Column:
    """Relative paths stand below their specification's folder."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))


def fenced(language: str, body: Column) -> Column:
    return F.concat(F.lit(f"```{language}\n"), body, F.lit("\n```"))


def tree(files: Column) -> Column:
    """One line for each file of array<struct<path, text>>."""
    return F.when(F.size(files) == 0, "(no files included)").otherwise(F.array_join(F.transform(files, lambda f: F.concat(F.lit("- "), f["path"])), "\n"))


def file_context(files: Column, chars: int = 4000, marker: str = "\n...[TRUNCATED]...") -> Column:
    return F.array_join(F.transform(files, lambda f: F.concat(F.lit("### File: "), f["path"], F.lit("\n"), fenced("text", text.truncated(f["text"], chars, marker)))), "\n\n")


def patch_prompt(task: Column, files: Column, failure: Column, previous: Column) -> Column:
    """Task, repository, failures and the output's contract."""
    return F.concat(
        F.lit("Task ID: "), task, F.lit("\n\nRepository tree:\n"), tree(files), F.lit("\n\nRelevant file context:\n"), file_context(files), F.lit("\n\nCurrent test failure:\n"), fenced("text", text.tail(failure, 3000)),
        F.lit("\n\nPrevious failed attempt feedback:\n"), fenced("text", text.tail(previous, 3000)), F.lit("\n\nOutput contract:\nReturn only a unified diff patch beginning with diff --git.\n"),
    )


def command_record(argv: Column, exit_code: Column) -> dict[str, Column]:
    return {"command": F.array_join(argv, " "), "passed": F.coalesce(exit_code == 0, F.lit(False))}


def violations(rows: DataFrame, n_rows: int, n_eval: int, n_categories: int) -> DataFrame:
    """Broken rules of a curriculum and how often; all counts are 0 if it is as it should be. Ids, nearly all different, are
    grouped without the other counts."""
    by = rows.groupBy("category").agg(
        F.count("*").alias("n"), F.count_if(F.col("split") == "eval").alias("evals"), F.count_if(~F.col("split").isin("train", "eval")).alias("unknown"), F.count_if(F.col("operations") == "").alias("without"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    whole = by.agg(
        total("n").alias("n"), (total("n") - n_rows).alias("rows_off"), (total("evals") - n_eval).alias("eval_rows_off"), total("unknown").alias("unknown_splits"),
        total(F.when(~F.col("category").isin([c for c, _ in datasets.CATEGORIES]), F.col("n"))).alias("unknown_categories"), total("without").alias("without_operations"),
        F.count_if(F.col("n") != n_rows // n_categories).alias("uneven_categories"), (F.count("*") - n_categories).alias("categories_off"),
    )
    ids = rows.agg(F.countDistinct("task_id").alias("ids"))
    return whole.crossJoin(ids).select(
        "rows_off", "eval_rows_off", (F.col("n") - F.col("ids")).alias("repeated_ids"), "unknown_splits", "unknown_categories", "without_operations", "uneven_categories", "categories_off",
    )


# The system messages of the two patch prompts, the strict one's reminders and its description.
PATCH_SYSTEM = (
    "You are an expert fullstack software engineering agent. You edit repositories by producing minimal unified diff patches. "
    "Return only a valid unified diff patch. Do not include prose."
)
STRICT_SYSTEM = """You are a repository patching engine.

You must output exactly one unified diff patch.

Hard output rules:
- Output only a unified diff.
- Do not use Markdown fences.
- Do not include prose.
- Do not explain.
- Do not invent files.
- Do not edit files outside the allowed file list.
- Use existing repository paths exactly.
- Each hunk must target existing lines from the provided file content.
- Prefer the smallest possible patch.
- A valid patch must be applicable with `git apply`.

Unified diff shape:
diff --git a/<path> b/<path>
--- a/<path>
+++ b/<path>
@@
-<old existing line>
+<new replacement line>
"""
STRICT_END = """
Return one minimal unified diff patch that fixes the failing tests.
Remember:
- Edit only the allowed file paths.
- Do not edit app/__init__.py unless it appears in the allowed file list.
- Do not create new classes, example apps, or unrelated code.
- Do not add imports unless required.
- The patch must change the buggy implementation, not the tests.
"""
CONTRACT = [
    ("name", "strict_unified_diff_patch_contract_v1"), ("output", "unified_diff_only"), ("markdown_allowed", False), ("prose_allowed", False),
    ("wrong_file_edits_allowed", False), ("new_files_allowed_by_default", False), ("primary_metric", "patch_apply_success_count"),
]


def _titled(parts: list[tuple[str, Column]]) -> Column:
    """Titles, each with what stands below it."""
    return F.concat(*[x for title, body in parts for x in (F.lit(title), body)])


def _messages(system: str, user: Column) -> Column:
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", F.lit(system)), ("user", user))])


def patch_messages(files: Column, failure: Column, previous: Column) -> Column:
    """Messages that ask for a patch, from rows of task_id, title, task_type, description, test_command."""
    block = lambda c: F.concat(F.lit("```text\n"), c, F.lit("\n```"))
    return _messages(PATCH_SYSTEM, _titled([
        ("Task ID: ", F.col("task_id")), ("\nTitle: ", F.col("title")), ("\nTask type: ", F.col("task_type")), ("\n\nDescription:\n", F.col("description")),
        ("\n\nTest command:\n", F.col("test_command")), ("\n\nRepository tree:\n", tree(files)), ("\n\nRelevant file context:\n", file_context(files)),
        ("\n\nCurrent test failure:\n", block(failure)), ("\n\nPrevious failed attempt feedback:\n", block(previous)),
        ("\n\nOutput contract:\nReturn only a unified diff patch beginning with diff --git.\n", F.lit("")),
    ]))


def strict_messages(files: Column, failure: Column, chars: int = 4000) -> Column:
    """Messages under the strict contract: only the files given may be edited, 3,000 characters of failure."""
    paths = F.when(F.size(files) == 0, "- <none>").otherwise(tree(files))
    each = F.transform(files, lambda f: F.concat(F.lit("### FILE: "), f["path"], F.lit("\n```python\n"), F.left(f["text"], F.lit(chars)), F.lit("\n```")))
    return _messages(STRICT_SYSTEM, _titled([
        ("Task id: ", F.col("task_id")), ("\nTitle: ", F.col("title")), ("\nDescription: ", F.col("description")), ("\n\nTest command:\n", F.col("test_command")),
        ("\n\nFailing test stderr:\n", text.tail(failure, 3000)), ("\n\nAllowed files to edit:\n", paths),
        ("\n\nRepository files:\n", F.array_join(each, "\n")), ("\n" + STRICT_END, F.lit("")),
    ]))


def contract() -> Column:
    """What the strict contract asks, as one struct for each row."""
    return F.struct(*[F.lit(v).alias(k) for k, v in CONTRACT])


def compact_command(run: Column, stderr: int = 1600, stdout: int = 800) -> Column:
    """A command's record with the ends of its outputs; a command that was not run has a null record."""
    ends = [text.tail(run["stderr"], stderr).alias("stderr_tail"), text.tail(run["stdout"], stdout).alias("stdout_tail")]
    passed = F.coalesce(run["exit_code"] == 0, F.lit(False)).alias("passed")
    return F.when(run.isNotNull(), F.struct(run["command"].alias("command"), run["exit_code"].alias("exit_code"), passed, *ends))


def skipped(reason: str) -> Column:
    """The result of a command whose precondition failed: no exit code, the reason in stderr."""
    none = F.lit(None).cast("string")
    return F.struct(none.alias("command"), F.lit(None).cast("int").alias("exit_code"), F.lit(reason).alias("stderr"), F.lit("").alias("stdout"))
