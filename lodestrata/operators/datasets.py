"""Chats to training examples, attempts to supervised rows, intents and their repair, registries, curricula."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import rules, text

NAMESPACE = "lodestrata"
# What attempt and supervised rows say.
ATTEMPT_INSTRUCTION = "Generate a unified diff patch that fixes the repository task and makes tests pass."
INSTRUCTION = "You are an expert software engineering agent that edits repositories using unified diff patches."
POSITIVE_HEAD = "You are a fullstack software engineering agent.\nFix the repository by producing a unified diff patch.\n\nTask ID: "
POSITIVE_PARTS = ("\n\nPre-test failure:\n", "\n\nPrevious failed attempt feedback:\n", "\n\nReturn only the patch.")
SOURCES = ("self_repair_trajectory", "self_repair_positive_attempt")


def chats(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One row for each conversation: messages in order of turns."""
    each = F.struct(F.col(turn).alias("turn"), F.col("role"), F.col("text").alias("content"))
    folded = rows.groupBy(F.col(conversation).alias("task_id")).agg(F.array_sort(F.collect_list(each)).alias("m"))
    return folded.select("task_id", F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def training_examples(chat_rows: DataFrame) -> DataFrame:
    """prompt_messages (all but the last), assistant_target, full_messages."""
    m = F.col("messages")
    return chat_rows.select("task_id", F.slice(m, F.lit(1), F.size(m) - 1).alias("prompt_messages"), F.element_at(m, -1)["content"].alias("assistant_target"), m.alias("full_messages"))


def merged(*maps: Column) -> Column:
    """Maps as one: of a key that several have, the last one's value counts; null maps have none."""
    none = F.create_map().cast("map<string,string>")

    def over(early: Column, late: Column) -> Column:
        return F.map_concat(F.map_filter(early, lambda k, _: ~F.map_contains_key(late, k)), late)

    out = F.coalesce(maps[0], none)
    for m in maps[1:]:
        out = over(out, F.coalesce(m, none))
    return out


def first_response(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "assistant") -> DataFrame:
    """The first text of a role, by aggregation."""
    return rows.filter(F.col("role") == role).groupBy(conversation).agg(F.min(F.struct(turn, "text"))["text"].alias("first_text"))


def attempt_rows(attempts: DataFrame) -> DataFrame:
    """Attempts with carried failures as dataset rows: what the model was given (input), what it gave (output) and where that lies (metadata).

    What an attempt lacks is empty; a patch that has not been recorded is an empty patch."""
    ok = F.coalesce("post_tests_passed", F.lit(False))
    said = lambda c, name=None: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name or c)
    given = F.struct(F.lit(ATTEMPT_INSTRUCTION).alias("instruction"), said("pre_test_command"), said("pre_test_stderr"), said("previous_failure_stderr"))
    meta = F.struct(F.lit(SOURCES[0]).alias("source"), said("work_dir"), said("patch_path"))
    return attempts.select(
        F.lit(f"{NAMESPACE}.patch_attempt.v0").alias("schema_version"), F.format_string("%s::iter_%s::%s", "task_id", "iteration", "patch_id").alias("example_id"),
        "task_id", "iteration", "patch_id", F.coalesce("patch_applied", F.lit(False)).alias("patch_applied"), ok.alias("post_tests_passed"), F.coalesce("reward", F.lit(0.0)).alias("reward"),
        F.when(ok, "positive").otherwise("negative").alias("label"), given.alias("input"), F.struct(said("patch_text", "patch")).alias("output"), meta.alias("metadata"),
    )


def positive_rows(rows: DataFrame) -> DataFrame:
    """Positive attempt rows as chats of system, user, assistant."""
    before, feedback, end = map(F.lit, POSITIVE_PARTS)
    user = F.concat(F.lit(POSITIVE_HEAD), F.col("task_id").cast("string"), before, F.col("input.pre_test_stderr"), feedback, F.col("input.previous_failure_stderr"), end)
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    messages = F.array(say("system", F.lit(INSTRUCTION)), say("user", user), say("assistant", F.col("output.patch")))
    meta = F.struct(F.lit(SOURCES[1]).alias("source"), F.col("patch_id").cast("string").alias("patch_id"))
    return rows.filter("label = 'positive'").select(F.lit(f"{NAMESPACE}.sft_positive.v0").alias("schema_version"), "example_id", "task_id", messages.alias("messages"), "reward", meta.alias("metadata"))


# Fixed values: (needles in the file, needles in the lower-cased task and behaviour, replacement), in order.
SYNTHESIS = [
    (["add_one"], ["add-one", "x + 1"], "def add_one(x: int) -> int:\n    return x + 1\n"),
    (["square"], ["square", "multiplied by itself"], "def square(x: int) -> int:\n    return x * x\n"),
    (["max2"], ["larger integer"], "def max2(a: int, b: int) -> int:\n    return a if a >= b else b\n"),
]


def synthesized(task: Column, current: Column, behaviour: Column) -> Column:
    """Replacement text by the first rule that fits; null if none does."""
    lower = F.lower(F.concat(task, F.lit("\n"), behaviour))
    out = F.lit(None).cast("string")
    for in_file, in_task, new in reversed(SYNTHESIS):
        hit = F.lit(False)
        for n in in_file:
            hit = hit | current.contains(n)
        for n in in_task:
            hit = hit | lower.contains(n)
        out = F.when(hit, new).otherwise(out)
    return out


def validated(intents: DataFrame, files: list[str]) -> DataFrame:
    """Adds escapes, file_exists, edits_tests, occurrences, error, valid for rows of file_path, file_text, find_text, replace_text.

    ``files``: paths that exist; each row brings its file's text."""
    path = F.col("file_path")
    return (
        intents.withColumns({"escapes": text.escapes_root(path), "edits_tests": path.startswith("tests/") | path.contains("/tests/")})
        .withColumn("file_exists", path.isin(files) & ~F.col("escapes"))
        .withColumn("occurrences", F.when(F.col("file_exists"), text.occurrences(F.col("file_text"), F.col("find_text"))).otherwise(F.lit(0).cast("long")))
        .withColumn("error", rules.intent_error(F.col("escapes"), F.col("file_exists"), F.col("edits_tests"), F.col("occurrences"), F.col("replace_text")))
        .withColumn("valid", F.col("error").isNull())
    )


def repaired(intents: DataFrame, files: list[str], default: str) -> DataFrame:
    """Normalised paths, grounded find texts and synthesized replacements; validated before and after."""
    before = validated(intents, files).withColumnRenamed("error", "original_error").withColumnRenamed("valid", "original_valid")
    path, current = text.normal_path(F.col("file_path"), default), text.ensure_newline(F.col("file_text"))
    lost = F.coalesce(F.col("original_error").isin("find_text_not_found", "find_text_not_unique"), F.lit(False))
    made = synthesized(F.col("task_id").cast("string"), current, F.col("expected_behavior"))
    make = ~text.looks_like_code(F.col("replace_text")) & made.isNotNull()
    actions = F.array_compact(F.array(
        F.when(path != F.col("file_path"), "normalized_file_path"), F.when(lost, "replaced_find_text_with_exact_current_file_text"), F.when(make, "synthesized_replace_text_from_task_context"),
    ))
    after = before.select(
        "task_id", "file_text", F.col("find_text").alias("original_find_text"), "original_error", actions.alias("repair_actions"), path.alias("file_path"), F.when(lost, current).otherwise(F.col("find_text")).alias("find_text"),
        text.ensure_newline(F.when(make, made).otherwise(F.col("replace_text"))).alias("replace_text"),
    )
    return validated(after, files).select("task_id", "original_error", "original_find_text", "file_path", "find_text", "replace_text", "repair_actions", F.col("valid").alias("repaired"), F.col("error").alias("repair_error"))


#: From this similarity on a find text that isn't there is a near miss.
NEAR = 0.90
PREVIEW = 3000


def forensics(checked: DataFrame) -> DataFrame:
    """Why each validated intent failed: category, details (its error), how similar the text that was looked for is to the file (only where it
    matters and can be near), what was asked and the difference. Where has_intent is false nothing was parsed."""
    expected, find = (F.coalesce(c, F.lit("")) for c in ("file_text", "find_text"))
    lost = F.coalesce(F.col("error") == "find_text_not_found", F.lit(False)) & F.col("has_intent") & (text.strip(find) != "")
    rows = checked.withColumn("find_text_similarity", text.similar(F.when(lost, expected), F.when(lost, find), NEAR))
    category = rules.intent_failure(F.col("error"), F.col("valid"), F.col("find_text"), F.col("find_text_similarity"), F.col("has_intent"))
    diff = F.when(lost, text.line_diff(F.lit("file"), expected, find))
    return rows.select(
        "task_id", category.alias("category"), F.col("error").alias("details"), "find_text_similarity", (text.strip(F.coalesce("replace_text", F.lit(""))) != "").alias("replace_text_present"), "file_path",
        F.left(expected, F.lit(PREVIEW)).alias("expected_preview"), F.left(find, F.lit(PREVIEW)).alias("find_preview"), F.coalesce(diff, F.lit("")).alias("diff_expected_vs_find"),
    )


def trajectory_sft(records: DataFrame) -> DataFrame:
    """Records of doc_id, solved, reward, target and first_text (null: empty) as supervised rows: the model's own text is asked about, the target is the answer."""
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    raw = F.coalesce("first_text", F.lit(""))
    meta = F.struct("solved", "reward", F.when(F.col("reward") > 0, "positive").otherwise("negative").alias("label"), F.left(raw, F.lit(500)).alias("raw_model_output"))
    return records.select("doc_id", F.lit(f"{NAMESPACE}.trajectory_record.v0").alias("schema_version"), F.array(say("user", raw), say("assistant", F.coalesce("target", F.lit("")))).alias("messages"), meta.alias("metadata"))


def canonical_patches(intents: DataFrame) -> DataFrame:
    """Valid intents with the unified diff of replacing the first occurrence."""
    ok = intents.filter("valid").withColumn("new_text", text.replace_first(F.col("file_text"), F.col("find_text"), F.col("replace_text")))
    return ok.select("task_id", "file_path", text.line_diff(F.col("file_path"), F.col("file_text"), F.col("new_text")).alias("patch_text"))


def registry(manifests: DataFrame, project: str) -> DataFrame:
    """Entries of path, project, stage, …: the last path of a stage wins; ordered by step, then stage.

    A step's key is ten times its major number plus its minor one, as given; numbers of up to 17 digits."""
    parts = F.split("path", "/")
    name = F.when(F.coalesce("stage", F.lit("")) == "", F.element_at(parts, -1)).otherwise(F.col("stage"))
    kept = manifests.filter((F.col("project") == project) & F.col("stage").isNotNull()).withColumns({"parts": parts, "_named": name})
    row = F.struct(*[F.col(c) for c in kept.columns if c not in ("stage", "parts")])
    last = kept.groupBy("stage").agg(F.max_by(row, "parts").alias("r")).select("stage", "r.*")
    major, minor = F.regexp_extract("_named", r"step(\d+)(?:[_-](\d+))?", 1), F.regexp_extract("_named", r"step(\d+)(?:[_-](\d+))?", 2)
    number = lambda c: F.coalesce(F.regexp_replace(c, "^0+(?=[0-9])", "").try_cast("long"), F.lit(0))
    step = F.when(major == "", "unknown").when(minor == "", number(major).cast("string")).otherwise(F.concat_ws(".", number(major), number(minor)))
    return last.withColumns({"display_step": step, "sort_key": F.when(major == "", 999999).otherwise(number(major) * 10 + number(minor)).cast("long")}).drop("_named").orderBy("sort_key", "stage")


# Fixed values of the second curriculum: category, addition to its prompt.
CATEGORIES = [
    ("localized_bugfix", "Focus on the smallest implementation change that fixes the failing behavior."),
    ("wrong_file_guard", "A previous attempt edited app/__init__.py incorrectly. Guard against touching the wrong file."),
    ("missing_test_addition", "Include a focused test addition or update that would fail before the implementation fix."),
    ("small_multifile_edit", "Modify more than one file only if an export, test, or integration point truly requires it."),
    ("safe_refactor", "Preserve behavior while making the implementation clearer and safer."),
    ("import_typing_fix", "Preserve type hints and add only the minimal necessary imports."),
    ("invalid_patch_repair", "A previous patch failed to apply because it targeted a nonexistent or stale file. Plan the repair."),
    ("semantic_patch_repair", "A previous patch applied but failed tests because it changed behavior in the wrong direction."),
    ("boundary_condition_fix", "Pay special attention to boundary values and edge-case behavior."),
    ("data_validation_fix", "Strengthen input validation without accepting invalid data silently."),
    ("config_behavior_fix", "Respect explicit config values while preserving defaults for missing keys."),
    ("dependency_api_migration", "Adapt to the new API shape while avoiding broad rewrites."),
]
# Function, module, bug, expected behaviour, edge case. Test files and names follow from them.
CASES = [
    ("add_one", "math_utils", "returns x instead of x + 1", "return x + 1", "negative input should increment toward zero only by arithmetic addition"),
    ("square", "math_utils", "returns x + x instead of x * x", "return x * x", "negative input should produce positive square"),
    ("max2", "math_utils", "always returns the first argument", "return a if a >= b else b", "equal values should return either value without changing type"),
    ("safe_divide", "math_utils", "raises ZeroDivisionError instead of returning None when denominator is zero", "return None for zero denominator; otherwise return numerator / denominator", "zero denominator must not raise"),
    ("clamp", "math_utils", "does not enforce the upper bound", "return min(max(value, lower), upper)", "value above upper should return upper"),
    ("normalize_email", "user_utils", "strips whitespace but forgets to lowercase", "return email.strip().lower()", "mixed case domain and local part should lowercase"),
    ("redact_email", "user_utils", "leaks the full local part before @", "preserve first character and domain while masking the rest of the local part", "short local parts should not crash"),
    ("slugify", "text_utils", "replaces spaces but leaves uppercase letters", "lowercase text before replacing spaces with hyphens", "multiple spaces should not create unstable output"),
    ("is_palindrome", "text_utils", "compares raw string and fails on casing and spaces", "normalize case and ignore spaces before comparison", "phrase with spaces and mixed case should pass"),
    ("parse_bool", "config_utils", "treats any non-empty string as True", "accept true/false yes/no 1/0 explicitly and reject unknown values", "unknown strings should raise ValueError"),
    ("load_timeout", "config_utils", "ignores configured timeout and always returns default", "read timeout_seconds from config when present", "missing key should preserve default"),
    ("validate_payload", "api_utils", "accepts payload without required id field", "return False or raise validation error when id is missing", "empty dict should be invalid"),
    ("extract_user_id", "api_utils", "looks for userId but upstream now sends user_id", "support user_id while preserving compatibility if required", "missing id should not silently return wrong value"),
    ("unique_sorted", "list_utils", "sorts but does not remove duplicates", "return sorted unique values", "already sorted duplicates should collapse"),
    ("merge_dicts", "dict_utils", "mutates the left input dictionary", "return a new merged dictionary without mutating inputs", "nested values should be preserved by reference unless explicitly copied"),
    ("get_nested", "dict_utils", "raises KeyError for missing nested keys instead of returning default", "return default when any path segment is missing", "empty path should return original object or default according to existing contract"),
]
# Test names with more than the function's name.
TEST_SUFFIX = {"validate_payload": "_requires_id", "merge_dicts": "_no_mutation", "get_nested": "_default"}
# Category, type of its extra operation, its risk flag.
EXTRAS = [
    ("wrong_file_guard", None, "wrong_file_target_risk"), ("missing_test_addition", "add_or_update_test", "test_quality_risk"), ("small_multifile_edit", "maybe_update_related_file", "multifile_scope_risk"),
    ("safe_refactor", "preserve_behavior_refactor", "refactor_regression_risk"), ("import_typing_fix", "minimal_import_or_typing_update", "unnecessary_import_risk"), ("invalid_patch_repair", "repair_patch_targeting", "patch_apply_failure_risk"),
    ("semantic_patch_repair", "repair_semantic_direction", "semantic_regression_risk"), ("boundary_condition_fix", "cover_boundary_condition", "boundary_condition_risk"), ("data_validation_fix", "validate_inputs", "validation_contract_risk"),
    ("config_behavior_fix", "preserve_config_default", "configuration_precedence_risk"), ("dependency_api_migration", "api_shape_migration", "dependency_api_drift_risk"),
]
# Fixed values of the first curriculum: function, module, bug, expected behaviour, test's name.
FIRST_CASES = [
    ("add_one", "math_utils", "def add_one(x: int) -> int returns x instead of x + 1", "return x + 1", "test_add_one"),
    ("square", "math_utils", "def square(x: int) -> int returns x + x instead of x * x", "return x * x", "test_square"),
    ("max2", "math_utils", "def max2(a: int, b: int) -> int always returns a", "return a if a >= b else b", "test_max2"),
    ("normalize_email", "user_utils", "normalize_email strips whitespace but forgets to lowercase the address", "return email.strip().lower()", "test_normalize_email"),
    ("slugify", "text_utils", "slugify replaces spaces with hyphens but leaves uppercase letters", "lowercase before replacing spaces", "test_slugify"),
    ("safe_divide", "math_utils", "safe_divide raises ZeroDivisionError instead of returning None for denominator zero", "return None when denominator is zero", "test_safe_divide_zero"),
]
FIRST_CATEGORIES = 8


def difficulty(category: Column) -> Column:
    return (
        F.when(category.isin("small_multifile_edit", "semantic_patch_repair", "dependency_api_migration"), "medium")
        .when(category.isin("invalid_patch_repair", "wrong_file_guard", "config_behavior_fix"), "easy_medium").otherwise("easy")
    )


def modulo_split(index: Column, n: int = 6) -> Column:
    return F.when(index % n == n - 1, "eval").otherwise("train")


CASE = "case_pos long, name string, module string, bug string, expected string, edge string, test_symbol string"


def literal_cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *c, f"test_{c[0]}{TEST_SUFFIX.get(c[0], '')}") for i, c in enumerate(CASES)], CASE)


def literal_first_cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *c[:4], "", c[4]) for i, c in enumerate(FIRST_CASES)], CASE)


def with_count(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """Adds n_cases: one more than the largest number of a case, to every row."""
    held = cases.agg(F.lit(1).alias("_one"), (F.coalesce(F.max("case_pos"), F.lit(-1)) + 1).alias("n_cases"))  # one row
    return rows.withColumn("_one", F.lit(1)).join(F.broadcast(held), "_one").drop("_one")


def numbered(categories: list[tuple[str, str]], cases: DataFrame) -> DataFrame:
    """Each of a few literal categories with each case of a table of any size; index: place in category-major order. Cases are
    numbered from 0 by case_pos, so no rows are sorted; numbers may be missing. The cases are dealt first: a small file is read
    by one task, and what it becomes is much larger. The count is named, since small partitions would be put together again."""
    each = F.array(*[F.struct(F.lit(i).cast("long").alias("cat_pos"), F.lit(c).alias("category"), F.lit(a).alias("addition")) for i, (c, a) in enumerate(categories)])
    dealt = cases.repartition(int(cases.sparkSession.conf.get("spark.sql.shuffle.partitions")), "case_pos")
    rows = dealt.select("*", F.explode(each).alias("c")).select(*cases.columns, "c.*")
    return with_count(rows, cases).withColumn("index", F.col("cat_pos") * F.col("n_cases") + F.col("case_pos"))


def with_cases(spark: SparkSession, cases: DataFrame | None = None) -> DataFrame:
    """Each category with each case; without ``cases`` (columns of CASE) those of the literal table. The case's columns are kept."""
    extras = spark.createDataFrame(EXTRAS, "category string, extra string, risk string")
    file, test_file = F.concat(F.lit("app/"), F.col("module"), F.lit(".py")), F.concat(F.lit("tests/test_"), F.col("module"), F.lit(".py"))
    rows = numbered(CATEGORIES, literal_cases(spark) if cases is None else cases).join(F.broadcast(extras), "category", "left")  # a literal table
    rows = rows.withColumns({"file": file, "test_file": test_file, "split": modulo_split(F.col("index"))})
    digest = F.substr(F.sha1(F.concat_ws(":", "category", "name", "index").cast("binary")), F.lit(1), F.lit(10))
    prompt = F.concat(
        F.lit("Repository task category: "), F.col("category"), F.lit("\nPrimary file: "), F.col("file"), F.lit("\nPrimary symbol: "), F.col("name"), F.lit("\nBug: "), F.col("bug"), F.lit("\nExpected behavior: "), F.col("expected"),
        F.lit("\nKnown test file: "), F.col("test_file"), F.lit("\nKnown test symbol: "), F.col("test_symbol"), F.lit("\nImportant edge case: "), F.col("edge"),
        F.lit("\nReturn structured JSON edit intent only. Do not return a patch.\n"), F.col("addition"),
    )
    return rows.withColumns({"task_id": F.concat_ws("-", F.lit("sft-v1"), "category", "name", digest), "prompt": prompt})


def curriculum(spark: SparkSession, cases: DataFrame | None = None) -> DataFrame:
    """Rows of :func:`with_cases` with what their category asks for."""
    operations = F.array_compact(F.array(F.lit("modify_function"), F.col("extra")))
    prohibited = F.array_compact(F.array(F.when(F.col("category") == "wrong_file_guard", "app/__init__.py"), F.when(F.col("category") == "invalid_patch_repair", "nonexistent.py")))
    return with_cases(spark, cases).select(
        "index", "task_id", "split", "category", difficulty(F.col("category")).alias("difficulty"),
        "prompt", F.array_join(operations, ",").alias("operations"), F.array_join(prohibited, ",").alias("prohibited_files"), F.array_join(F.array_compact(F.array("risk")), ",").alias("risk_flags"),
        F.concat(F.lit("run "), F.col("test_file"), F.lit("::"), F.col("test_symbol")).alias("first_check"),
    )


def curriculum_targets(rows: DataFrame) -> DataFrame:
    """The structured target of each row as JSON text with sorted keys."""
    split = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    return rows.select("task_id", F.to_json(F.struct("category", split(F.col("operations")).alias("operations"), split(F.col("prohibited_files")).alias("prohibited_files"), split(F.col("risk_flags")).alias("risk_flags"), "task_id", F.array("first_check").alias("verification"))).alias("target_text"))


def with_first_cases(spark: SparkSession, cases: DataFrame | None = None) -> DataFrame:
    """Each of 8 categories with each case; without ``cases`` those of the literal table. The case's columns are kept."""
    rows = numbered(CATEGORIES[:FIRST_CATEGORIES], literal_first_cases(spark) if cases is None else cases)
    two_digits = F.when(F.col("index") < 10, F.concat(F.lit("0"), F.col("index"))).otherwise(F.col("index").cast("string"))
    digest = F.substr(F.sha1(F.concat_ws(":", "category", "index", "name").cast("binary")), F.lit(1), F.lit(8))
    risk = F.when(F.col("category").isin("invalid_patch_repair", "semantic_patch_repair"), "previous_failed_attempt_available").when(F.col("category") == "wrong_file_guard", "wrong_file_target_risk").when(F.col("category") == "missing_test_addition", "test_quality_risk")
    return rows.withColumns({
        "task_id": F.concat_ws("-", F.lit("sft"), "category", two_digits, digest), "split": modulo_split(F.col("index")), "risk_flags": F.coalesce(risk, F.lit("")),
    })


def first_curriculum(spark: SparkSession, cases: DataFrame | None = None) -> DataFrame:
    """Rows of :func:`with_first_cases` with what their category asks for."""
    extra = F.when(F.col("category") == "missing_test_addition", "add_or_update_test").when(F.col("category") == "small_multifile_edit", "maybe_update_export")
    return with_first_cases(spark, cases).select(
        "index", "task_id", "split", "category", F.array_join(F.array_compact(F.array(F.lit("modify_function"), extra)), ",").alias("operations"), "risk_flags",
        F.concat(F.lit("run tests/test_"), F.col("module"), F.lit(".py::"), F.col("test_symbol")).alias("first_check"),
    )
