"""Whole rows of the two curricula: messages, structured targets as JSON with sorted keys, metadata, and their rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import text
from lodestrata.operators import datasets

# What both curricula's prompts and targets say.
SYSTEM = {
    1: "You are a structured code-edit planning model. Return only valid JSON. Do not include markdown, prose, or code fences. "
    "The JSON must describe the intended code edit, target files, tests, constraints, risk flags, verification strategy, and acceptance criteria.",
    0: "You are a structured code-edit planning model. Given a repository task, return only valid JSON. Do not include markdown, prose, or code fences. "
    "The JSON must describe the intended edit, target files, tests, constraints, and verification strategy.",
}
CONSTRAINTS = {
    1: [
        "return only valid JSON", "prefer the smallest correct edit", "do not include markdown or prose", "do not delete or weaken tests",
        "do not hardcode only the visible test values", "preserve public API unless the task explicitly requires an API migration",
    ],
    0: [
        "return only valid structured intent JSON", "prefer the smallest correct edit", "do not delete or weaken tests",
        "do not hardcode test values without implementing general behavior",
    ],
}
PROHIBITION = "do not modify prohibited files"
CRITERIA = {
    1: [
        "patch applies cleanly", "the relevant failing behavior is corrected", "no unrelated files are modified",
        "tests are not removed or weakened", "implementation is general rather than hardcoded to one assertion",
    ],
    0: ["patch applies cleanly", "pre-existing failing test passes after edit", "no unrelated files are modified", "no tests are deleted or weakened"],
}
SOURCE = {1: ("synthetic_structured_intent_curriculum_v1", "curriculum_expansion_v1"), 0: ("synthetic_verified_intent_seed", "dataset_expansion_v0")}
# Fixed values of the second curriculum: category, file of its extra operation, whether it names a symbol, its intent.
OPERATIONS = [
    ("missing_test_addition", "test_file", True, "cover {expected} and edge case: {edge}"),
    ("small_multifile_edit", "app/__init__.py", False, "update export only if required by existing package contract"),
    ("safe_refactor", "file", True, "keep the externally visible behavior aligned with tests"),
    ("import_typing_fix", "file", False, "add only imports or annotations needed for the fix"),
    ("invalid_patch_repair", "file", False, "retarget stale or nonexistent file path to real implementation file"),
    ("semantic_patch_repair", "file", True, "ensure behavior changes toward expected contract, not merely toward passing visible syntax checks"),
    ("boundary_condition_fix", "test_file", True, "{edge}"),
    ("data_validation_fix", "file", True, "reject or safely handle invalid input according to existing contract"),
    ("config_behavior_fix", "file", True, "respect explicit configuration while preserving default fallback behavior"),
    ("dependency_api_migration", "file", True, "support the new upstream field or call shape with minimal compatibility handling"),
]
# Fixed values of the first curriculum: category, addition to its prompt.
FIRST_ADDITIONS = [
    ("wrong_file_guard", "Important constraint: previous model attempts edited app/__init__.py, but the fix belongs in the primary implementation file."),
    ("missing_test_addition", "Additional request: add or update a focused unit test that would fail before the fix."),
    ("small_multifile_edit", "Additional request: update the implementation and the package export only if required."),
    ("safe_refactor", "Additional request: perform the smallest safe refactor needed to make behavior clearer."),
    ("import_typing_fix", "Additional request: preserve type hints and add only necessary imports."),
    ("invalid_patch_repair", "Previous patch failed to apply because it targeted a nonexistent file. Plan a repair that targets the real file."),
    ("semantic_patch_repair", "Previous patch applied but failed tests because it changed behavior in the wrong direction. Plan the semantic repair."),
]
# Fixed values of the first curriculum: category, type, file, whether it names a symbol, intent of its extra operation.
FIRST_OPERATIONS = [
    ("missing_test_addition", "add_or_update_test", "test_file", True, "cover the corrected behavior and at least one edge case"),
    ("small_multifile_edit", "maybe_update_export", "app/__init__.py", False, "only update export if the public API requires it"),
]
NO_TEXTS = "array<string>"


def _texts(values: list[str]) -> list[Column]:
    return [F.lit(v) for v in values]


def _array(*values: Column) -> Column:
    return F.array_compact(F.array(*values)).cast(NO_TEXTS)


def _operation(kind: Column, file: Column, intent: Column, symbol: Column, reason: Column) -> Column:
    return F.struct(file.alias("file"), intent.alias("intent"), reason.alias("reason"), symbol.alias("symbol"), kind.alias("type"))


def _extra(where: Column, named: Column, template: Column) -> tuple[Column, Column, Column]:
    """File, symbol and intent of a category's extra operation."""
    file = F.when(where == "file", F.col("file")).when(where == "test_file", F.col("test_file")).otherwise(where)
    symbol = F.when(named, F.when(where == "test_file", F.col("test_symbol")).otherwise(F.col("name")))
    intent = F.replace(F.replace(template, F.lit("{expected}"), F.col("expected")), F.lit("{edge}"), F.col("edge"))
    return file, symbol, intent


def _rows(made: DataFrame, v: int, prompt: Column, extra: Column, prohibited: Column, risks: Column, checks: Column, difficulty: Column) -> DataFrame:
    """Rows of either curriculum: ``made`` has index, task_id, split, category and its case's columns."""
    base = _operation(F.lit("modify_function"), F.col("file"), F.col("expected"), F.col("name"), F.col("bug") if v else F.lit(None).cast("string"))
    barred = F.col("category") == "wrong_file_guard" if v else F.size(prohibited) > 0
    notes = [F.col("expected").alias("expected_behavior"), F.col("name").alias("primary_symbol")]
    target = F.to_json(F.struct(
        F.array(*_texts(CRITERIA[v])).alias("acceptance_criteria"), "category",
        _array(*_texts(CONSTRAINTS[v]), F.when(barred, PROHIBITION)).alias("constraints"),
        F.struct(*([F.col("edge").alias("edge_case")] if v else []), *notes).alias("notes"),
        F.array_compact(F.array(base, extra)).alias("operations"), prohibited.alias("prohibited_files"), risks.alias("risk_flags"),
        F.lit(f"{datasets.NAMESPACE}.structured_intent.v{v}").alias("schema_version"), F.array("file").alias("target_files"), "task_id",
        F.array("test_file").alias("test_files"), checks.alias("verification"),
    ))
    source, by = SOURCE[v]
    tests = [F.col("test_file").alias("known_test_file"), F.col("test_symbol").alias("known_test_symbol")]
    first = [F.concat_ws("::", "test_file", "test_symbol").alias("known_test")]
    metadata = F.to_json(F.struct(
        F.col("name").alias("case_name"), F.lit(by).alias("generated_by"), *(tests if v else first), F.col("file").alias("primary_file"),
        *([F.col("name").alias("primary_symbol")] if v else []), F.lit(False).alias("requires_gpu"), F.lit(source).alias("source"),
    ))
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return made.select(
        "index", F.lit(f"{datasets.NAMESPACE}.sft_row.v{v}").alias("schema_version"), "task_id", "split", "category", difficulty.alias("difficulty"),
        F.array(say("system", F.lit(SYSTEM[v])), say("user", prompt)).alias("messages"), target.alias("target_text"), metadata.alias("metadata"),
    )


def second_rows(spark: SparkSession, cases: DataFrame | None = None) -> DataFrame:
    """12 categories by the cases; without ``cases`` by those of the literal table."""
    operations = spark.createDataFrame(OPERATIONS, "category string, place string, named boolean, template string")
    made = datasets.with_cases(spark, cases).filter("index is not null").join(F.broadcast(operations), "category", "left")  # a literal table
    file, symbol, intent = _extra(F.col("place"), F.col("named"), F.col("template"))
    extra = F.when(F.col("extra").isNotNull(), _operation(F.col("extra"), file, intent, symbol, F.lit(None).cast("string")))
    barred = F.when(F.col("category") == "wrong_file_guard", "app/__init__.py").when(F.col("category") == "invalid_patch_repair", "nonexistent.py")
    checks = F.array(
        F.concat(F.lit("run "), F.concat_ws("::", "test_file", "test_symbol")), F.concat(F.lit("run all tests in "), F.col("test_file")),
        *_texts(["inspect diff for unrelated file changes", "confirm no tests were deleted or weakened"]),
    )
    return _rows(made, 1, F.col("prompt"), extra, _array(barred), _array(F.col("risk")), checks, datasets.difficulty(F.col("category")))


def first_rows(spark: SparkSession, cases: DataFrame | None = None) -> DataFrame:
    """8 categories by the cases; without ``cases`` by those of the literal table."""
    additions = spark.createDataFrame(FIRST_ADDITIONS, "category string, addition string")
    operations = spark.createDataFrame(FIRST_OPERATIONS, "category string, extra string, place string, named boolean, template string")
    rows = datasets.with_first_cases(spark, cases).drop("addition").withColumn("edge", F.lit(""))
    made = rows.join(F.broadcast(additions), "category", "left").join(F.broadcast(operations), "category", "left").withColumns({
        "file": F.concat(F.lit("app/"), F.col("module"), F.lit(".py")), "test_file": F.concat(F.lit("tests/test_"), F.col("module"), F.lit(".py")),
    })
    file, symbol, intent = _extra(F.col("place"), F.col("named"), F.col("template"))
    extra = F.when(F.col("extra").isNotNull(), _operation(F.col("extra"), file, intent, symbol, F.lit(None).cast("string")))
    test = F.concat_ws("::", "test_file", "test_symbol")
    prompt = F.concat(
        F.lit("Repository task category: "), F.col("category"), F.lit("\nBug summary: "), F.col("bug"), F.lit("\nPrimary file: "), F.col("file"),
        F.lit("\nKnown failing test: "), test, F.lit("\nReturn a structured JSON edit intent. Do not return a patch yet."),
        F.coalesce(F.concat(F.lit("\n"), F.col("addition")), F.lit("")),
    )
    barred = _array(F.when(F.col("category").isin("wrong_file_guard", "invalid_patch_repair"), "app/__init__.py"))
    checks = F.array(F.concat(F.lit("run "), test), *_texts(["run the relevant unit test file", "inspect diff for unrelated changes"]))
    risks = _array(F.when(F.col("risk_flags") != "", F.col("risk_flags")))
    level = F.when(F.col("category").isin("small_multifile_edit", "semantic_patch_repair"), "medium").otherwise("easy")
    return _rows(made, 0, prompt, extra, barred, risks, checks, level)


#: Arrays that a target must have, by curriculum.
ARRAYS = {1: ["target_files", "test_files", "operations", "constraints", "verification", "acceptance_criteria"], 0: ["target_files", "operations", "verification"]}


def broken_rules(rows: DataFrame, v: int, *by: str) -> DataFrame:
    """How many rows (of each group) break each rule; every rule has a count, 0 if none does. What can't be told counts as broken.
    A target is parsed once, of repeated keys the last counts; ids, nearly all different, are grouped without the other counts."""
    role = lambda i: F.try_element_at("messages", F.lit(i))["role"]
    known = [c for c, _ in (datasets.CATEGORIES if v else datasets.CATEGORIES[: datasets.FIRST_CATEGORIES])]
    fields = ", ".join(["schema_version string", "task_id string", "category string", *[f"{name} {NO_TEXTS}" for name in ARRAYS[v]]])
    field = lambda name: F.col(f"_target.{name}")
    rules = {
        "schema_version": F.col("schema_version") == f"{datasets.NAMESPACE}.sft_row.v{v}", "split": F.col("split").isin("train", "eval"), "category": F.col("category").isin(known),
        "messages": (F.size("messages") == 2) & (role(1) == "system") & (role(2) == "user"), "target_text": F.col("target_text").rlike(r"\S"),
        "target_schema_version": field("schema_version") == f"{datasets.NAMESPACE}.structured_intent.v{v}",
        "target_task_id": field("task_id") == F.col("task_id"), "target_category": field("category") == F.col("category"),
    } | {f"target_{name}": F.try_element_at(field(name), F.lit(1)).isNotNull() for name in ARRAYS[v]}
    each = [F.count_if(~F.coalesce(holds, F.lit(False))).alias(name) for name, holds in rules.items()]
    target = F.when(F.col("target_text").rlike(r"^\s*\{"), F.from_json("target_text", fields))  # an array of objects is none
    counts = rows.withColumn("_target", target).groupBy(*by).agg(F.count("*").alias("row_count"), *each)
    ids = rows.groupBy(*by).agg(F.countDistinct("task_id").alias("_ids"))
    both = counts.join(ids, list(by)) if by else counts.crossJoin(ids)
    return both.select("row_count", (F.col("row_count") - F.col("_ids")).alias("repeated_task_ids"), *rules, *by)


def bucket_counts(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Rows of each value of a domain; values without rows have 0."""
    values = rows.sparkSession.createDataFrame([(d,) for d in domain], "value string")
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return values.join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def list_counts(rows: DataFrame) -> DataFrame:
    """Sizes of a target's lists and its lengths, for token reports."""
    size = lambda name: F.size(F.from_json(F.get_json_object("target_text", f"$.{name}"), "array<string>")).cast("long")
    return rows.select(
        "task_id", "split", "category", size("target_files").alias("target_file_count"), size("operations").alias("operation_count"),
        size("verification").alias("verification_count"), F.length("target_text").cast("long").alias("char_count"), text.tokens(F.col("target_text")).alias("token_count"),
    )
