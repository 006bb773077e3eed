"""Rules: each gives an issue (field, message) where its condition holds; a row's issues are an array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions import text as T

CHAT_ROLES = ["system", "user", "assistant", "tool"]
SFT_ROLES = ["system", "user", "assistant"]
TARGET_FIELDS = ["intent_id", "task_id", "file_path", "find_text", "replace_text"]


def issue(broken: Column, field: Column | str, message: str) -> Column:
    field = F.lit(field) if isinstance(field, str) else field
    return F.when(F.coalesce(broken, F.lit(True)), F.struct(field.alias("field"), F.lit(message).alias("message")))


def issues(*found: Column) -> Column:
    return F.array_compact(F.array(*found))


def chat_issues(messages: Column) -> Column:
    """Of a chat: it has messages, their roles are known and their contents are there."""
    each = F.flatten(F.transform(messages, lambda m, i: issues(
        issue(~m["role"].isin(CHAT_ROLES), F.concat(F.lit("messages["), i, F.lit("].role")), "unsupported_role"),
        issue(m["content"].isNull(), F.concat(F.lit("messages["), i, F.lit("].content")), "content_must_be_string"),
    )))
    return F.concat(issues(issue(F.size(messages) == 0, "messages", "messages_must_not_be_empty")), F.coalesce(each, F.array().cast("array<struct<field:string,message:string>>")))


def _absent(parsed: Column, name: str) -> Column:
    """A field that isn't there, or is null, empty, zero or false."""
    value = F.try_variant_get(parsed, f"$.{name}", "variant")
    said = F.coalesce(F.try_variant_get(parsed, f"$.{name}", "string"), F.to_json(value), F.lit(""))
    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    return (kind == "VOID") | (said == "") | ((kind != "STRING") & said.rlike(r"^(-?0(\.0+)?|false|\[\]|\{\})$"))


def sft_issues(version: Column, messages: Column, target: Column, expected_version: str, expected_path: str) -> Column:
    """Of a supervised row, in order; a target that is empty or no JSON object ends the list."""
    empty = F.coalesce(F.size(messages), F.lit(0)) <= 0
    each = F.flatten(F.transform(messages, lambda m, i: issues(
        issue(~m["role"].isin(SFT_ROLES), F.concat(F.lit("messages["), i, F.lit("].role")), "invalid_role"),
        issue(F.length(m["content"]) == 0, F.concat(F.lit("messages["), i, F.lit("].content")), "content_must_be_non_empty_string"),
    )))
    last = F.try_element_at(messages, F.lit(-1))
    none = F.array().cast("array<struct<field:string,message:string>>")
    head = F.concat(
        issues(issue(version != expected_version, "schema_version", "unexpected_schema_version"), issue(empty, "messages", "messages_must_be_non_empty_list")),
        F.when(empty, none).otherwise(F.coalesce(each, none)),
        F.when(empty, none).otherwise(issues(issue(last["role"] != "assistant", "messages[-1].role", "last_message_must_be_assistant_target"))),
    )
    blank = F.coalesce(T.strip(target), F.lit("")) == ""
    parsed = F.try_parse_json(target)
    field = lambda name: F.get_json_object(target, f"$.{name}")
    rest = F.concat(
        issues(*[issue(_absent(parsed, n), f"target.{n}", "required_target_field_missing_or_empty") for n in TARGET_FIELDS]),
        issues(issue(~field("file_path").eqNullSafe(expected_path), "target.file_path", "unexpected_file_path")),
        F.when(empty, none).otherwise(issues(issue(last["content"] != target, "messages[-1].content", "assistant_message_must_equal_target"))),
    )
    return F.concat(
        head,
        F.when(blank, issues(issue(F.lit(True), "target", "target_must_be_non_empty_string")))
        .when(parsed.isNull() | ~F.coalesce(F.schema_of_variant(parsed), F.lit("")).startswith("OBJECT"), issues(issue(F.lit(True), "target", "target_must_parse_as_json_object")))
        .otherwise(rest),
    )


def generation_issues(c: dict[str, Column]) -> Column:
    """Of a generation configuration: max_new_tokens, temperature, top_p, top_k, num_return_sequences, repetition_penalty."""
    return issues(
        issue(c["max_new_tokens"] <= 0, "max_new_tokens", "must_be_positive"),
        issue(c["temperature"] < 0, "temperature", "must_not_be_negative"),
        issue(~((c["top_p"] > 0) & (c["top_p"] <= 1)), "top_p", "must_be_in_range"),
        issue(F.coalesce(c["top_k"] < 0, F.lit(False)), "top_k", "must_not_be_negative"),
        issue(c["num_return_sequences"] <= 0, "num_return_sequences", "must_be_positive"),
        issue(F.coalesce(c["repetition_penalty"] <= 0, F.lit(False)), "repetition_penalty", "must_be_positive"),
    )


def exported_config(c: dict[str, Column], stops: Column) -> Column:
    """A valid configuration as a struct of its fields and the list of stop sequences; null if it has an issue."""
    return F.when(F.size(generation_issues(c)) == 0, F.struct(*[v.alias(n) for n, v in c.items()], stops.alias("stop_sequences")))


def task_issues(c: dict[str, Column], expected_version: str) -> Column:
    """Of a task: required fields, its version, its time limit."""
    required = ["schema_version", "task_id", "title", "repo_dir", "test_command", "timeout_seconds"]
    return issues(
        *[issue(c[n].isNull(), n, "missing") for n in required],
        issue(F.coalesce(c["schema_version"] != expected_version, F.lit(False)), "schema_version", "unsupported"),
        issue(F.coalesce(c["timeout_seconds"] <= 0, F.lit(False)), "timeout_seconds", "must_be_positive"),
    )


def intent_error(escapes: Column, exists: Column, edits_tests: Column, count: Column, replacement: Column) -> Column:
    """First rule of an edit intent that fails; null if it is valid. What is unknown (null path or text) isn't there."""
    escapes, exists, edits_tests = (F.coalesce(c, F.lit(False)) for c in (escapes, exists, edits_tests))
    count = F.coalesce(count, F.lit(0))
    return (
        F.when(escapes, "file_path_escapes_repo").when(~exists, "file_missing").when(edits_tests, "test_file_edit_forbidden")
        .when(count == 0, "find_text_not_found").when(count > 1, "find_text_not_unique").when(F.coalesce(replacement, F.lit("")) == "", "empty_replace_text")
    )


def intent_failure(error: Column, valid: Column, find: Column, ratio: Column, has_intent: Column) -> Column:
    """Category of an intent's failure; ``ratio`` matters only for text that was not found."""
    return (
        F.when(~has_intent, "missing_intent")
        .when((error == "find_text_not_found") & (T.strip(find) == ""), "empty_find_text")
        .when((error == "find_text_not_found") & F.coalesce(ratio >= 0.90, F.lit(False)), "near_miss_exact_text")
        .when((error == "find_text_not_found") & find.contains("```"), "markdown_contaminated_find_text")
        .when((error == "find_text_not_found") & ~find.contains("def "), "non_code_find_text")
        .when(error == "find_text_not_found", "wrong_or_hallucinated_find_text")
        .when(error == "file_missing", "wrong_file_path").when(error == "find_text_not_unique", "ambiguous_find_text")
        .when(error == "empty_replace_text", "empty_replace_text").when(error == "test_file_edit_forbidden", "attempted_test_edit")
        .when(error.isNotNull(), error).when(valid, "valid").otherwise("unknown_invalid")
    )
