"""The registered queries as SQL for DuckDB."""

from __future__ import annotations

from lodestrata.operators import datasets, prompts
from lodestrata.plans import views
from lodestrata.plans.queries import GATES, HELD_OUT, KS, LIMIT, MARGIN, MOST, RISKS

A, C, R, I, H = views.ATTEMPTS_SQL, views.CANDIDATES_SQL, views.RESPONSES_SQL, views.INTENTS_SQL, views.CHATS_SQL
NL = "chr(10)"
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')".format
Q = lambda s: "null" if s is None else "'" + s.replace("'", "''") + "'"
B = lambda *names: ", ".join(f"cast({n} as bigint) as {n}" for n in names)

BEFORE = "over (partition by task_id order by iteration rows between unbounded preceding and 1 preceding)"
CARRIED = f"""carried as (select *, coalesce(last_value(case when not post_tests_passed then coalesce(stderr, '') end ignore nulls) {BEFORE}, '') as previous_failure_stderr from attempts)"""
TRIED = f"""tried as (select * from (select *, coalesce(bool_or(post_tests_passed) {BEFORE}, false) as done, row_number() over (partition by task_id order by iteration) as place from attempts) where not done)"""
FIRST = "first(patch_id order by reward desc, iteration)"
EXAMPLE = "cast(task_id as varchar) || '::iter_' || iteration || '::' || patch_id"
ORDER = "partition by task_id order by reward desc, post_tests_passed desc, patch_applied desc, elapsed_seconds, part, supp, line"
SELECTED = f"""selected as (select * from (select *, row_number() over ({ORDER}) as place, count(*) over (partition by task_id) as candidate_count, bool_or(patch_applied) over (partition by task_id) as any_applied from candidates) where place = 1)"""
RESULTS = """results as (select o_orderkey as task_id, o_orderpriority, coalesce(post_tests_passed, false) as solved, coalesce(reward, 0.0) as selected_reward, coalesce(candidate_count, 0) as candidate_count,
  cast(case when candidate_count is null then 1 else 0 end as bigint) as parse_failure_count, coalesce(any_applied, false) as any_applied from orders left join selected on o_orderkey = task_id)"""
EXPERIMENT = """experiment as (select count(*) as total_tasks, count(*) filter (solved) as solved_tasks, round(count(*) filter (solved) / count(*), 6) as solve_rate, round(coalesce(avg(selected_reward), 0.0), 6) as average_selected_reward,
  cast(sum(candidate_count) as bigint) as total_candidates, cast(sum(parse_failure_count) as bigint) as total_parse_failures, count(*) filter (any_applied) as tasks_with_applied_patch from results)"""
DIFF = rf"""diffs as (select task_id, raw, {STRIP("replace(replace(found, chr(13) || chr(10), chr(10)), chr(13), chr(10))")} || {NL} as diff from (
  select *, coalesce(list_filter(list_transform(regexp_extract_all(raw, '(?is)```(?:diff|patch)?\s*\n(.*?)```', 1), lambda x: {STRIP("x")}), lambda b: contains(b, 'diff --git '))[1],
    case when instr(raw, 'diff --git ') > 0 then substr(raw, instr(raw, 'diff --git ')) end) as found from responses)),
errors as (select *, case when diff is null then 'No unified diff found in model response' when not starts_with(diff, 'diff --git ') then 'Patch must start with ''diff --git ''' when not contains(diff, {NL} || '--- ') then 'Patch missing old-file marker ''--- '''
  when not contains(diff, {NL} || '+++ ') then 'Patch missing new-file marker ''+++ ''' when not contains(diff, {NL} || '@@') then 'Patch missing hunk marker ''@@''' end as error from diffs)"""
HYGIENE = rf"""lines as (select task_id, raw, regexp_split_to_array(raw, '\r\n|[\n\x0b\f\r]') as ls from responses),
begun as (select *, list_position(list_transform(ls, lambda l: starts_with(l, 'diff --git ')), true) as b from lines),
cut as (select *, case when b is null then [] else ls[b:] end as tl0 from begun),
cut2 as (select *, case when tl0[len(tl0)] = '' then tl0[:len(tl0) - 1] else tl0 end as tl from cut),
kinds as (select *, list_transform(tl, lambda l: case when starts_with({STRIP("l")}, '```') then 'F' when {STRIP("l")} = '' then 'B' when regexp_matches(l, '^(diff --git |index |@@| |\+|-|\\ No newline at end of file)') then 'D' else 'S' end) as k from cut2),
stops as (select *, coalesce(list_min(list_filter(list_transform(range(1, len(k) + 1), lambda j: case when k[j] in ('F', 'S') then j end), lambda j: j is not null)), len(k) + 1) as stop from kinds),
blocks as (select *, regexp_replace(coalesce(array_to_string(list_transform(list_filter(range(1, len(k) + 1), lambda j: j < stop and k[j] = 'D'), lambda j: tl[j]), {NL}), ''), '\s+$', '') as joined,
  list_filter(list_transform(range(1, len(k) + 1), lambda j: case when j > stop then null when k[j] = 'F' then 'stopped_at_markdown_fence' when k[j] = 'B' then 'dropped_blank_line' when k[j] = 'S' then 'stopped_at_non_diff_line:' || left({STRIP("tl[j]")}, 80) end), lambda n: n is not null) as notes from stops),
flags as (select task_id, case when joined = '' then '' else joined || {NL} end as sanitized_diff, contains(raw, 'diff --git ') as has_diff_header, contains(raw, '```') as contains_markdown_fence,
  contains(raw, 'This patch') or contains(raw, 'This change') or contains(raw, 'ensuring that') or contains(raw, 'correct behavior') or contains(raw, 'as per the task') as contains_prose_after_diff,
  case when b is null then ['missing_diff_header'] else notes end as notes, list_filter(string_split(joined, {NL}), lambda l: l <> '') as dl from blocks),
counts as (select *, len(dl) as n, len(list_filter(dl, lambda l: starts_with(l, '+') and not starts_with(l, '+++'))) as added, len(list_filter(dl, lambda l: starts_with(l, '-') and not starts_with(l, '---'))) as removed from flags),
hygiene as (select task_id, sanitized_diff, has_diff_header, contains_markdown_fence, contains_prose_after_diff, cast(n as bigint) as sanitized_line_count, added > 0 or removed > 0 as has_change_lines, cast(added as bigint) as added_line_count, cast(removed as bigint) as removed_line_count,
  case when not has_diff_header then 'missing_diff' when sanitized_diff = '' then 'empty_after_sanitization' when added = 0 and removed = 0 then 'non_actionable_no_change_lines' when contains_markdown_fence or contains_prose_after_diff then 'sanitized_actionable_with_contamination' else 'actionable_diff_like' end as status,
  coalesce(array_to_string(notes, '|'), '') as notes from counts)"""


def _validated(source: str, name: str) -> str:
    files = ", ".join(Q(f) for f in views.FILES)
    return f"""{name}0 as (select *, starts_with(file_path, '/') or starts_with(file_path, '../') as escapes, starts_with(file_path, 'tests/') or contains(file_path, '/tests/') as edits_tests from {source}),
{name}1 as (select *, file_path in ({files}) and not escapes as file_exists from {name}0),
{name}2 as (select *, cast(case when not file_exists then 0 when find_text = '' then length(file_text) + 1 else (length(file_text) - length(replace(file_text, find_text, ''))) // greatest(length(find_text), 1) end as bigint) as occurrences from {name}1),
{name} as (select *, error is null as valid from (select *, case when escapes then 'file_path_escapes_repo' when not file_exists then 'file_missing' when edits_tests then 'test_file_edit_forbidden' when occurrences = 0 then 'find_text_not_found' when occurrences > 1 then 'find_text_not_unique' when coalesce(replace_text, '') = '' then 'empty_replace_text' end as error from {name}2))"""


_LINE_END = r"'\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'"
_SHARED = "coalesce(nullif(list_position(list_transform(range(1, greatest(len({0}), len({1})) + 1), lambda i: {0}[i] is distinct from {1}[i]), true), 0) - 1, len({0}))".format
_RANGE = "case when {1} = 1 then cast({0} + 1 as varchar) else cast(case when {1} = 0 then {0} else {0} + 1 end as varchar) || ',' || ({1}) end".format
_MARKED = "list_transform(list_slice({1}, {2} + 1, {2} + {3}), lambda x: '{0}' || x)".format


# The patch of the one edit: what both texts share at their start and end is left out, but for three lines.
def _diffs(source: str) -> str:
    """Diffs of rows of task_id, file_path, old and new."""
    return f"""split0 as (select task_id, file_path, regexp_split_to_array(old, {_LINE_END}) as was, regexp_split_to_array(new, {_LINE_END}) as now from ({source})),
split1 as (select task_id, file_path, case when was[len(was)] = '' then list_slice(was, 1, len(was) - 1) else was end as was, case when now[len(now)] = '' then list_slice(now, 1, len(now) - 1) else now end as now from split0),
split2 as (select *, {_SHARED("was", "now")} as head from split1),
split3 as (select *, list_reverse(list_slice(was, head + 1, len(was))) as r_was, list_reverse(list_slice(now, head + 1, len(now))) as r_now from split2),
split4 as (select *, least({_SHARED("r_was", "r_now")}, len(r_was), len(r_now)) as tail from split3),
split5 as (select *, greatest(head - 3, 0) as low, least(tail, 3) as after, len(r_was) - tail as n_old, len(r_now) - tail as n_new from split4),
patches as (select task_id, file_path, 'diff --git a/' || file_path || ' b/' || file_path || {NL} || case when was = now then '' else array_to_string(flatten([
    ['--- a/' || file_path, '+++ b/' || file_path, '@@ -' || {_RANGE("low", "head - low + n_old + after")} || ' +' || {_RANGE("low", "head - low + n_new + after")} || ' @@'],
    {_MARKED(" ", "was", "low", "head - low")}, {_MARKED("-", "was", "head", "n_old")}, {_MARKED("+", "now", "head", "n_new")}, {_MARKED(" ", "was", "head + n_old", "after")}]), {NL}) || {NL} end as patch_text from split5)"""


PATCHES = _diffs("select task_id, file_path, file_text as old, left(file_text, cast(pos - 1 as bigint)) || replace_text || substr(file_text, pos + length(find_text)) as new from (select *, greatest(strpos(file_text, find_text), 1) as pos from checked where valid)")
#: A find text made from the whole file and one character more is a near miss from five characters on; no other one of the view is similar enough.
FORENSICS = f"""lost0 as (select *, has_intent and coalesce(error = 'find_text_not_found', false) and {STRIP("find_text")} <> '' as lost from checked),
lost1 as (select *, lost and find_text = file_text || '#' and length(file_text) >= 5 as near from lost0),
forensics as (select *, case when not has_intent then 'missing_intent' when error = 'find_text_not_found' and {STRIP("find_text")} = '' then 'empty_find_text' when near then 'near_miss_exact_text' when error = 'find_text_not_found' and contains(find_text, '```') then 'markdown_contaminated_find_text'
  when error = 'find_text_not_found' and not contains(find_text, 'def ') then 'non_code_find_text' when error = 'find_text_not_found' then 'wrong_or_hallucinated_find_text' when error = 'file_missing' then 'wrong_file_path' when error = 'find_text_not_unique' then 'ambiguous_find_text'
  when error = 'test_file_edit_forbidden' then 'attempted_test_edit' when error is not null then error else 'valid' end as category from lost1)"""


def _ended(x: str) -> str:
    return f"case when ends_with({x}, {NL}) then {x} else {x} || {NL} end"


def _synthesis() -> str:
    out = "case "
    for in_file, in_task, new in datasets.SYNTHESIS:
        tests = [f"contains({_ended('file_text')}, {Q(n)})" for n in in_file] + [f"contains(lower(cast(task_id as varchar) || {NL} || expected_behavior), {Q(n)})" for n in in_task]
        out += f"when {' or '.join(tests)} then {Q(new)} "
    return out + "end"


_CODE = rf"(starts_with({STRIP('replace_text')}, 'def ') and contains({STRIP('replace_text')}, {NL}) and contains({STRIP('replace_text')}, 'return ') and not contains({STRIP('replace_text')}, '```'))"
_PATH = rf"case when coalesce(file_path, '') = '' then 'app/utils.py' when {STRIP('file_path')} in ('utils.py', './utils.py') or ends_with({STRIP('file_path')}, '/app/utils.py') then 'app/utils.py' else {STRIP('file_path')} end"
REPAIR = f"""{_validated("intents", "before")},
made as (select *, {_synthesis()} as synth, coalesce(error in ('find_text_not_found', 'find_text_not_unique'), false) as lost, {_PATH} as new_path from before),
after0 as (select task_id, file_text, error as original_error, new_path as file_path, case when lost then {_ended('file_text')} else find_text end as find_text,
  case when not {_CODE} and synth is not null then {_ended('synth')} else {_ended('replace_text')} end as replace_text,
  coalesce(array_to_string(list_filter([case when new_path <> file_path then 'normalized_file_path' end, case when lost then 'replaced_find_text_with_exact_current_file_text' end, case when not {_CODE} and synth is not null then 'synthesized_replace_text_from_task_context' end], lambda x: x is not null), ','), '') as repair_actions from made),
{_validated("after0", "after1")}"""
ISSUE = lambda cond, field, message: f"case when {cond} then {{'field': {field}, 'message': '{message}'}} end"
_LAST = "messages[len(messages)]"
_FIELDS = ", ".join(ISSUE(f"coalesce(target ->> '$.{n}', '') = ''", f"'target.{n}'", "required_target_field_missing_or_empty") for n in ("intent_id", "task_id", "file_path", "find_text", "replace_text"))
ISSUES = rf"""issues as (select task_id, list_filter(list_concat(
  [{ISSUE(f"schema_version <> '{views.VERSION}'", "'schema_version'", "unexpected_schema_version")}],
  flatten(list_transform(range(1, len(messages) + 1), lambda j: [{ISSUE("messages[j].role not in ('system', 'user', 'assistant')", "'messages[' || (j - 1) || '].role'", "invalid_role")}, {ISSUE("length(messages[j].content) = 0", "'messages[' || (j - 1) || '].content'", "content_must_be_non_empty_string")}])),
  [{ISSUE(f"{_LAST}.role <> 'assistant'", "'messages[-1].role'", "last_message_must_be_assistant_target")}],
  case when {STRIP("target")} = '' then [{{'field': 'target', 'message': 'target_must_be_non_empty_string'}}] when not json_valid(target) then [{{'field': 'target', 'message': 'target_must_parse_as_json_object'}}]
  else [{_FIELDS}, {ISSUE("coalesce(target ->> '$.file_path', '') <> 'app/utils.py'", "'target.file_path'", "unexpected_file_path")}, {ISSUE(f"{_LAST}.content <> target", "'messages[-1].content'", "assistant_message_must_equal_target")}] end
  ), lambda x: x is not null) as issues from sft)"""
RENDER_A = rf"""{STRIP("array_to_string(list_transform(messages, lambda m: '<|' || " + STRIP('m.role') + " || '|>' || chr(10) || " + STRIP('m.content') + "), chr(10) || chr(10))")} || {NL}"""
TOKENS = r"len(regexp_extract_all({}, '\S+'))".format
TOKEN_ROWS = f"""token_rows as (select task_id, cast({TOKENS("full_text")} as bigint) as full_tokens, cast({TOKENS("target")} as bigint) as target_tokens, cast(length(full_text) as bigint) as full_chars from (select task_id, {RENDER_A} as full_text, {_LAST}.content as target from chats))"""
STATS = "stats as (select count(*) as row_count, min(full_tokens) as min_tokens, max(full_tokens) as max_tokens, round(avg(full_tokens), 6) as mean_tokens from token_rows)"
DOC_TOKENS = f"doc_tokens as (select doc_id, lang, case when doc_id % 6 = 5 then 'eval' else 'train' end as split, cast({TOKENS('text')} as bigint) as tokens from documents)"
RECORDS = """records as (select d.doc_id, quality = 1 and toxic = 0 as solved, cast(case when quality = 1 and toxic = 0 then 1.0 when quality = 1 then -0.25 else -1.0 end as double) as reward, text as target from documents d join labels l on d.doc_id = l.doc_id)"""
SFT_SUMMARY = rf"""sft_summary as (select count(*) as row_count, count(*) filter (reward > 0) as positive_rows, count(*) filter (solved) as solved_rows, round(coalesce(avg(reward), 0.0), 6) as average_reward, coalesce(bool_and({STRIP("target")} <> ''), true) as all_targets_present, coalesce(bool_and(reward >= -1), true) as all_rewards_in_range from records)"""
PARAMETERS = "parameters as (select cast(sum(p_size) as bigint) as total_parameters, cast(sum(p_size) filter (p_size > 25) as bigint) as trainable_parameters, round(sum(p_size) filter (p_size > 25) / sum(p_size) * 100, 6) as trainable_percent from part)"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else Q(v) for v in r) + ")" for r in rows)


CURRICULUM = f"""categories(cat_pos, category, addition) as (values {_values([(i, *c) for i, c in enumerate(datasets.CATEGORIES)])}),
{views.CASES_SQL},
extras(category, extra, risk) as (values {_values(datasets.EXTRAS)}),
both_ as (select c.*, k.*, e.extra, e.risk, cast(cat_pos * (select max(case_pos) + 1 from cases) + case_pos as bigint) as idx, 'app/' || module || '.py' as file, 'tests/test_' || module || '.py' as test_file from categories c cross join cases k left join extras e on c.category = e.category),
curriculum as (select idx as "index", 'sft-v1-' || category || '-' || name || '-' || left(sha1(category || ':' || name || ':' || idx), 10) as task_id, case when idx % 6 = 5 then 'eval' else 'train' end as split, category,
  case when category in ('small_multifile_edit', 'semantic_patch_repair', 'dependency_api_migration') then 'medium' when category in ('invalid_patch_repair', 'wrong_file_guard', 'config_behavior_fix') then 'easy_medium' else 'easy' end as difficulty,
  'Repository task category: ' || category || {NL} || 'Primary file: ' || file || {NL} || 'Primary symbol: ' || name || {NL} || 'Bug: ' || bug || {NL} || 'Expected behavior: ' || expected || {NL} || 'Known test file: ' || test_file || {NL} || 'Known test symbol: ' || test_symbol || {NL} || 'Important edge case: ' || edge || {NL} || 'Return structured JSON edit intent only. Do not return a patch.' || {NL} || addition as prompt,
  'modify_function' || coalesce(',' || extra, '') as operations, case category when 'wrong_file_guard' then 'app/__init__.py' when 'invalid_patch_repair' then 'nonexistent.py' else '' end as prohibited_files, coalesce(risk, '') as risk_flags, 'run ' || test_file || '::' || test_symbol as first_check from both_)"""

SQL: dict[str, str] = {
    "patch_reward": f"with {A} select task_id, patch_id, reward from attempts",
    "batch_summary": f"with {A} select count(*) as total_tasks, count(*) filter (post_tests_passed) as solved_tasks, count(*) filter (not post_tests_passed) as failed_tasks, round(count(*) filter (post_tests_passed) / count(*), 6) as pass_rate, round(avg(reward), 6) as average_reward from attempts",
    "batch_failed_tasks": f"with {A} select task_id, patch_id from attempts where not post_tests_passed",
    "patch_attempts": f"with {A}, {CARRIED} select '{datasets.NAMESPACE}.patch_attempt.v0' as schema_version, {EXAMPLE} as example_id, task_id, iteration, patch_id, patch_applied, post_tests_passed, reward, case when post_tests_passed then 'positive' else 'negative' end as label, {Q(datasets.ATTEMPT_INSTRUCTION)} as instruction, pre_test_command, coalesce(pre_test_stderr, '') as pre_test_stderr, previous_failure_stderr, coalesce(patch_text, '') as patch, '{datasets.SOURCES[0]}' as source, work_dir, coalesce(patch_path, '') as patch_path from carried",
    "sft_positive": f"with {A}, {CARRIED} select '{datasets.NAMESPACE}.sft_positive.v0' as schema_version, {EXAMPLE} as example_id, task_id, 'system,user,assistant' as roles, {Q(datasets.INSTRUCTION)} as system_content, {Q(datasets.POSITIVE_HEAD)} || task_id || {Q(datasets.POSITIVE_PARTS[0])} || coalesce(pre_test_stderr, '') || {Q(datasets.POSITIVE_PARTS[1])} || previous_failure_stderr || {Q(datasets.POSITIVE_PARTS[2])} as user_content, coalesce(patch_text, '') as assistant_content, '{datasets.SOURCES[1]}' as source, cast(patch_id as varchar) as patch_id, reward from carried where post_tests_passed",
    "trajectory_summary": f"with {A}, {TRIED} select task_id, count(*) as total_attempts, count(*) filter (post_tests_passed) as positive_attempts, count(*) filter (not post_tests_passed) as negative_attempts, bool_or(post_tests_passed) as solved, {FIRST} as best_patch_id, max(reward) as best_reward from tried group by task_id",
    "self_repair_loop": f"with {A}, {TRIED} select task_id, bool_or(post_tests_passed) as solved, count(*) as iterations_used, cast({MOST} as integer) as max_iterations, max(reward) as best_reward, {FIRST} as best_patch_id from tried where place <= {MOST} group by task_id",
    "best_so_far": f"with {A} select task_id, iteration, reward, max(reward) over w as best_reward, first_value(patch_id order by reward desc, iteration) over w as best_patch_id from attempts window w as (partition by task_id order by iteration rows between unbounded preceding and current row)",
    "loop_state_check": f"with {A} select task_id, iteration, iteration = row_number() over w - 1 as is_contiguous, bool_or(reward > 0.9) over w as solved, not bool_or(reward > 0.9) over w and row_number() over w < {MOST} as should_continue from attempts window w as (partition by task_id order by iteration)",
    "verifier_ranking": f"with {C} select task_id, part, supp, line, reward, cast(row_number() over ({ORDER}) as integer) as place from candidates",
    "verifier_selected": f"with {C}, {SELECTED} select task_id, part, supp, line, reward, post_tests_passed as solved, candidate_count from selected",
    "experiment_task_results": f"with {C}, {SELECTED}, {RESULTS} select * from results",
    "experiment_summary": f"with {C}, {SELECTED}, {RESULTS}, {EXPERIMENT} select * from experiment",
    "run_delta": f"with {C}, {SELECTED}, {RESULTS}, {EXPERIMENT} select solved_tasks - 0 as solved_tasks_delta, solve_rate - 0 as solve_rate_delta, tasks_with_applied_patch - 0 as tasks_with_applied_patch_delta from experiment",
    "task_failure_modes": f"with {C} select task_id, array_to_string(list_sort(list_distinct(list_concat(case when bool_or(not patch_applied) then ['patch_apply_failed'] else [] end, ['post_tests_failed']))), ',') as reasons, max(reward) as selected_reward from candidates group by task_id having not bool_or(post_tests_passed)",
    "pass_rates": f"""with {A}, k(k) as (values {', '.join(f'({k})' for k in KS)}),
      each as (select count(*) as n, count(*) filter (post_tests_passed) as c, min(iteration) filter (post_tests_passed) as first from attempts group by task_id),
      x as (select k, first, case when n >= k then 1 - list_product(list_transform(range(0, k), lambda i: greatest(n - c - i, 0) / (n - i))) end as x from each cross join k)
      select k, count(x) as tasks, round(avg(x), 6) as pass_at_k, count(*) as all_tasks, round(count(*) filter (first < k) / count(*), 6) as repair_at_k from x group by k""",
    "solving_cost": f"""with {A}, {TRIED}, t as (select count(*) as attempts, count(*) filter (post_tests_passed) as solved_tasks, sum(cast(elapsed_seconds as decimal(18, 6))) as spent from tried)
      select attempts, solved_tasks, round(attempts / nullif(solved_tasks, 0), 6) as attempts_per_solved_task, round(cast(spent as double) / nullif(solved_tasks, 0), 6) as seconds_per_solved_task from t""",
    "preference_pairs": f"""with {C}, placed as (select *, case when post_tests_passed then reward - {MARGIN} else reward end as spot from candidates),
      paired as (select *, last_value(case when not post_tests_passed then {{'reward': reward, 'part': part, 'supp': supp, 'line': line}} end ignore nulls) over (partition by task_id order by spot, post_tests_passed, part, supp, line rows between unbounded preceding and 1 preceding) as r from placed)
      select task_id, part, supp, line, reward, r.part as rejected_part, r.supp as rejected_supp, r.line as rejected_line, r.reward as rejected_reward from paired where post_tests_passed and r is not null""",
    "diff_extract": f"with {R}, {DIFF} select task_id, diff, error from errors",
    "parse_failures": f"with {R}, {DIFF} select task_id, error, left(raw, 500) as raw_text_preview from errors where error is not null",
    "patch_hygiene_rows": f"with {R}, {HYGIENE} select * from hygiene",
    "patch_hygiene_summary": f"with {R}, {HYGIENE} select count(*) as total_reports, count(*) filter (has_diff_header) as diff_header_count, count(*) filter (contains_markdown_fence) as markdown_fence_count, count(*) filter (contains_prose_after_diff) as prose_after_diff_count, count(*) filter (has_change_lines) as has_change_lines_count, count(*) filter (status = 'non_actionable_no_change_lines') as non_actionable_no_change_lines_count, count(*) filter (status in ('actionable_diff_like', 'sanitized_actionable_with_contamination')) as actionable_diff_like_count, string_agg(distinct status, ',' order by status) as statuses from hygiene",
    "stop_sequences": f"select doc_id, case when p is null then text else left(text, p - 1) end as cut from (select doc_id, text, list_min(list_filter([instr(text, {NL}), instr(text, '. '), instr(text, ' de ')], lambda x: x > 0)) as p from documents)",
    "marker_extract": f"select page_id, case when instr(html, '<title>') > 0 and instr(substr(html, instr(html, '<title>') + 7), '</title>') > 0 then left(substr(html, instr(html, '<title>') + 7), instr(substr(html, instr(html, '<title>') + 7), '</title>') - 1) else '' end as title, cast(case when instr(html, '</title>') > 0 then length({STRIP('''substr(html, instr(html, '</title>') + 8)''')}) else 0 end as bigint) as rest_chars from pages",
    "json_object_extract": r"select event_id, object, object ->> '$.k' as k from (select event_id, nullif(regexp_extract(case event_id % 3 when 2 then 'no object here' else props end, '(?s)(\{.*\})', 1), '') as object from events)",
    "truncated_previews": f"select doc_id, case when length(text) > 1500 then left(text, 1500) || {NL} || '...[truncated]...' else text end as preview from documents",
    "safe_names": r"select p_partkey, translate(uri, '/:', '__') as name, regexp_extract(uri, '^s3://([^/]+)/?(.*)$', 1) as bucket, regexp_extract(uri, '^s3://([^/]+)/?(.*)$', 2) as key from (select p_partkey, 's3://' || lower(replace(p_brand, '#', '-')) || '/' || p_name as uri from part)",
    "intent_validation": f"with {I}, {_validated('intents', 'checked')} select task_id, file_exists, edits_tests, occurrences, error, valid from checked",
    "intent_repair": f"with {I}, {REPAIR} select task_id, original_error, file_path, replace_text, repair_actions, valid as repaired, error as repair_error from after1",
    "canonical_patch": f"with {I}, {_validated('intents', 'checked')}, {PATCHES} select task_id, file_path, patch_text from patches",
    "failure_histogram": f"with {I}, {_validated('intents', 'checked')}, {FORENSICS} select category, coalesce(error, 'None') as error, count(*) as n from forensics group by all",
    "failure_classification": f"with {I}, {_validated('intents', 'checked')}, {FORENSICS} select task_id, category, coalesce(error, 'None') as error from forensics",
    "intent_forensics": f"with {I}, {_validated('intents', 'checked')}, {FORENSICS}, {_diffs("select task_id, 'file' as file_path, file_text as old, find_text as new from forensics where lost")} select f.task_id, category, error as details, case when near then true end as near, {STRIP("coalesce(replace_text, '')")} <> '' as replace_text_present, f.file_path, left(file_text, {datasets.PREVIEW}) as expected_preview, left(find_text, {datasets.PREVIEW}) as find_preview, coalesce(patch_text, '') as diff_expected_vs_find from forensics f left join patches p on f.task_id = p.task_id",
    "run_comparison": f"with {C}, {SELECTED}, {RESULTS}, {EXPERIMENT}, {SELECTED.replace('selected as', 'selected1 as').replace('from candidates)', 'from candidates where line = 1)')}, {RESULTS.replace('results as', 'results1 as').replace('selected ', 'selected1 ').replace('selected.', 'selected1.')}, {EXPERIMENT.replace('experiment as', 'experiment1 as').replace('results', 'results1')} select p.tasks_with_applied_patch as previous_patch_apply_success, e.tasks_with_applied_patch as current_patch_apply_success, e.tasks_with_applied_patch - p.tasks_with_applied_patch as patch_apply_success_delta, p.solved_tasks as previous_solved_tasks, e.solved_tasks as current_solved_tasks, e.solved_tasks - p.solved_tasks as solved_tasks_delta from experiment e cross join experiment1 p",
    "message_checks": f"with {H} select task_id, len(list_filter(messages, lambda m: coalesce(m.content, '') = '')) > 0 as any_empty, len(list_filter(messages, lambda m: m.role not in ('system', 'user', 'assistant', 'tool'))) = 0 as all_roles_known, len(list_filter(messages, lambda m: m.role = 'assistant')) > 0 as any_assistant from chats",
    "trajectory_sft_rows": f"with {RECORDS}, firsts as (select conv_id, first(text order by turn, text) as first_text from conversations where role = 'assistant' group by conv_id) select doc_id, '{datasets.NAMESPACE}.trajectory_record.v0' as schema_version, coalesce(first_text, '') as user, target as assistant, solved, reward, case when reward > 0 then 'positive' else 'negative' end as label, left(coalesce(first_text, ''), 500) as raw_model_output from records r left join firsts f on r.doc_id = f.conv_id",
    "optional_reads": "with found as (select l.doc_id, coalesce(d.text, '') as text from (select distinct doc_id from labels) l left join (select doc_id, min(text) as text from documents where doc_id % 10 <> 0 group by doc_id) d on l.doc_id = d.doc_id) select doc_id, length(text) as patch_chars, " + ", ".join(f"case when length(text) > {n} then left(text, {n}) || {NL} || '...[truncated]...' else text end as {name}" for name, n in (("prompt", 1500), ("file", 4000), ("safe", 6000))) + " from found",
    "chat_validation": f"with {H} select task_id, cast(len(messages) as bigint) as n_messages, cast(len(list_filter(messages, lambda m: m.role not in ('system', 'user', 'assistant', 'tool'))) as bigint) as n_issues from chats",
    "sft_row_validation": f"with {H}, {views.SFT_SQL}, {ISSUES} select task_id, cast(len(issues) as bigint) as n_issues, len(issues) = 0 as valid from issues",
    "sft_validation_issues": f"with {H}, {views.SFT_SQL}, {ISSUES} select task_id, i.field as field, i.message as message from (select task_id, unnest(issues) as i from issues)",
    "training_examples": f"with {H} select task_id, cast(len(messages) - 1 as bigint) as n_prompt, coalesce(array_to_string(list_transform(messages[:len(messages) - 1], lambda m: m.role || ':' || m.content), {NL}), '') as prompt, {_LAST}.content as assistant_target from chats",
    "train_eval_holdout": f"select task_id, case when row_number() over (order by task_id desc) <= {HELD_OUT} then 'eval' else 'train' end as split from (select distinct cast(conv_id as varchar) as task_id from conversations)",
    "modulo_split": "select distinct conv_id, case when conv_id % 6 = 5 then 'eval' else 'train' end as split from conversations",
    "chat_render_a": f"with {H} select task_id, {RENDER_A} as rendered from chats",
    "chat_render_b": f"with {H} select task_id, array_to_string(list_transform(list_concat(messages[:len(messages) - 1], [{{'role': 'assistant', 'content': {_LAST}.content}}]), lambda m: '<|' || m.role || '|>' || {NL} || m.content || {NL}), {NL}) as rendered from chats",
    "chat_render_c": f"with {H} select task_id, array_to_string(list_transform(messages, lambda m: upper(m.role) || ':' || {NL} || m.content), {NL} || {NL}) || {NL} || {NL} || 'ASSISTANT:' || {NL} as rendered from chats",
    "token_rows": f"with {H}, {TOKEN_ROWS} select * from token_rows",
    "token_stats": f"with {H}, {TOKEN_ROWS}, {STATS} select * from stats",
    "token_report": f"with {DOC_TOKENS}, g as (select coalesce(lang, 'all') as lang, coalesce(split, 'all') as split, list_sort(list(tokens)) as l, count(*) as row_count, min(tokens) as min_tokens, max(tokens) as max_tokens, round(avg(tokens), 3) as mean_tokens, count(*) filter (tokens > {LIMIT}) as would_truncate_count from doc_tokens group by grouping sets ((), (lang), (split), (lang, split))) select lang, split, row_count, min_tokens, max_tokens, mean_tokens, would_truncate_count, l[cast(round_even((row_count - 1) * 0.5, 0) as bigint) + 1] as median_tokens, l[cast(round_even((row_count - 1) * 0.95, 0) as bigint) + 1] as p95_tokens from g",
    "tokenization_gate": f"with {DOC_TOKENS} select count(*) as row_count, count(*) filter (tokens > {LIMIT}) as over_limit, count(*) filter (tokens >= {LIMIT}) as clipped_rows, bool_or(tokens >= {LIMIT}) as any_truncated, count(*) filter (tokens > {LIMIT}) = 0 as passed, cast(greatest(128, max(least(tokens, {LIMIT})) + 64) as bigint) as recommended_length from doc_tokens",
    "first_response": "select conv_id, first(text order by turn, text) as first_text from conversations where role = 'assistant' group by conv_id",
    "curriculum_v1": f"with {CURRICULUM} select * from curriculum",
    "curriculum_v0": f"""with categories(cat_pos, category) as (values {_values([(i, c) for i, (c, _) in enumerate(datasets.CATEGORIES[: datasets.FIRST_CATEGORIES])])}), {views.CASES_SQL},
      both_ as (select *, cast(cat_pos * (select max(case_pos) + 1 from cases) + case_pos as bigint) as idx from categories cross join cases)
      select idx as "index", 'sft-' || category || '-' || case when idx < 10 then '0' else '' end || idx || '-' || left(sha1(category || ':' || idx || ':' || name), 8) as task_id, case when idx % 6 = 5 then 'eval' else 'train' end as split, category, case category when 'missing_test_addition' then 'modify_function,add_or_update_test' when 'small_multifile_edit' then 'modify_function,maybe_update_export' else 'modify_function' end as operations,
      case when category in ('invalid_patch_repair', 'semantic_patch_repair') then 'previous_failed_attempt_available' when category = 'wrong_file_guard' then 'wrong_file_target_risk' when category = 'missing_test_addition' then 'test_quality_risk' else '' end as risk_flags, 'run tests/test_' || module || '.py::' || test_symbol as first_check from both_""",
    "curriculum_counts": f"with {CURRICULUM} select 'category' as kind, category as value, count(*) as n from curriculum group by category union all select 'split', split, count(*) from curriculum group by split union all select 'difficulty', difficulty, count(*) from curriculum group by difficulty union all select 'unique_task_ids', 'all', count(distinct task_id) from curriculum",
    "run_registry": f"""with {views.DOCUMENT_MANIFESTS_SQL}, kept as (select * from (select *, row_number() over (partition by stage order by string_split(path, '/') desc) as rn, case when stage = '' then string_split(path, '/')[-1] else stage end as named from manifests where project = '{views.PROJECT}' and stage is not null) where rn = 1),
      parsed as (select *, regexp_extract(named, 'step(\\d+)(?:[_-](\\d+))?', 1) as major, regexp_extract(named, 'step(\\d+)(?:[_-](\\d+))?', 2) as minor from kept)
      select stage, path, result, case when major = '' then 'unknown' when minor = '' then cast(cast(major as bigint) as varchar) else cast(major as bigint) || '.' || cast(minor as bigint) end as display_step, cast(case when major = '' then 999999 else cast(major as bigint) * 10 + coalesce(try_cast(nullif(minor, '') as bigint), 0) end as bigint) as sort_key from parsed""",
    "json_documents": "select doc_id, '{' || chr(10) || '  \"doc_id\" : ' || doc_id || ',' || chr(10) || '  \"lang\" : ' || coalesce(cast(to_json(lang) as varchar), 'null') || ',' || chr(10) || '  \"source\" : ' || coalesce(cast(to_json(source) as varchar), 'null') || ',' || chr(10) || '  \"n_chars\" : ' || coalesce(cast(n_chars as varchar), 'null') || chr(10) || '}' as document from documents",
    "generation_config_export": """select l_orderkey, l_linenumber, l_linenumber - 2 as max_new_tokens, l_discount - cast(0.05 as double) as temperature, l_quantity / 25 as top_p, cast(null as integer) as top_k, l_linenumber - 1 as num_return_sequences, case when l_returnflag = 'R' then l_tax end as repetition_penalty, chr(10) || '|###' as stop_sequences
      from lineitem where l_linenumber - 2 > 0 and l_discount - cast(0.05 as double) >= 0 and l_quantity / 25 > 0 and l_quantity / 25 <= 1 and l_returnflag <> 'N' and l_linenumber - 1 > 0 and not (l_returnflag = 'R' and l_tax <= 0)""",
    "enriched_records": "select doc_id, 'kind=document,lang=' || case when doc_id % 3 > 0 then coalesce(lang, 'und') else 'und' end || case when doc_id % 3 > 0 and n_chars is not null then ',n_chars=' || n_chars else '' end || ',source=' || case when doc_id % 3 > 0 then coalesce(source, 'unknown') else 'unknown' end || ',task_id=' || doc_id as record from documents",
    "trajectory_records": f"with {RECORDS} select doc_id, solved, reward, case when reward > 0 then 'positive' else 'negative' end as label, left(target, 500) as preview from records",
    "sft_dataset_summary": f"with {RECORDS}, {SFT_SUMMARY} select * from sft_summary",
    "set_ops": "select 'train_and_eval' as kind, count(*) as n from documents union all select 'without_label', count(*) from documents where doc_id not in (select doc_id from labels) union all select 'repeated_texts', count(*) from (select text from documents group by text having count(*) > 1) union all select 'lang_source', count(*) from (select distinct lang, source from documents)",
    "parameter_counts": f"with {PARAMETERS} select * from parameters",
    "generation_config_validation": "select coalesce(array_to_string(list_filter([case when l_linenumber - 2 <= 0 then 'max_new_tokens' end, case when l_discount - cast(0.05 as double) < 0 then 'temperature' end, case when not (l_quantity / 25 > 0 and l_quantity / 25 <= 1) then 'top_p' end, case when l_returnflag = 'N' then 'top_k' end, case when l_linenumber - 1 <= 0 then 'num_return_sequences' end, case when l_returnflag = 'R' and l_tax <= 0 then 'repetition_penalty' end], lambda x: x is not null), ','), '') as fields, count(*) as n from lineitem group by 1",
    "task_validation": "select c_custkey, coalesce(array_to_string(list_filter([case when c_custkey % 5 = 0 then 'schema_version:missing' end, case when c_custkey % 3 = 0 then 'repo_dir:missing' end, case when c_custkey % 5 <> 0 and c_custkey % 7 = 0 then 'schema_version:unsupported' end, case when floor(c_acctbal) <= 0 then 'timeout_seconds:must_be_positive' end], lambda x: x is not null), ','), '') as issues from customer",
    "scripted_outputs": f"with {H}, e as (select task_id, unnest(m) as m, unnest(range(0, len(m))) as pos from (select task_id, list_slice(list_filter(messages, lambda m: m.role = 'assistant'), 1, 2) as m from chats)) select task_id, cast(pos as integer) as pos, m.content as text, task_id || '_resp_' || pos as response_id from e",
    "adapter_responses": f"with {H}, said as (select task_id, {RENDER_A} as prompt, unnest([messages[1].content, {_LAST}.content]) as text, unnest([0, 1]) as position from chats) select task_id, task_id || '_resp_' || position as response_id, cast(position as integer) as position, text, cast({TOKENS('prompt')} as bigint) as prompt_tokens, cast({TOKENS('text')} as bigint) as token_count from said",
    "typed_tasks": """with t as (select c_custkey, c_custkey as k, c_custkey % 11 = 0 as broken, c_custkey % 7 = 0 as untitled, case c_custkey % 4 when 0 then 30 when 1 then c_custkey % 100 when 2 then 2 end as seconds, c_name, c_mktsegment from customer),
      e as (select *, case when broken then 'no_json' when untitled then 'missing:title' when seconds is null then 'timeout_not_whole' end as error from t)
      select c_custkey, error, case when error is null then 'v0' end as schema_version, case when error is null then cast(k as varchar) end as task_id, case when error is null then c_name end as title, case when error is null then case when k % 2 = 0 then '/abs/' else 'base/rel/' end || c_mktsegment end as repo_dir,
        case when error is null then 'run' end as test_command, case when error is null then cast(seconds as bigint) end as timeout_seconds, case when error is null then case when k % 3 = 0 then 'refactor' else 'unit_bugfix' end end as task_type, case when error is null then '' end as description from e""",
    "governance_plan": f"select source, current_rows, cast(place as integer) as place, gate, false as training_grade, true as requires_explicit_approval from (select source, current_rows, unnest([{', '.join(map(Q, GATES))}]) as gate, unnest(range(0, {len(GATES)})) as place from (select coalesce(source, '') as source, count(*) as current_rows from documents group by 1))",
    "launch_plan": f"with {H}, {TOKEN_ROWS}, {STATS}, {PARAMETERS}, {RECORDS}, {SFT_SUMMARY}, {DOC_TOKENS}, gate as (select count(*) filter (tokens > {LIMIT}) as over_limit from doc_tokens) select over_limit = 0 as tokenization_passed, over_limit, '{','.join(RISKS)}' as risks, stats.row_count, max_tokens, trainable_percent, sft_summary.row_count as dataset_rows, cast(greatest(128, max_tokens + 64) as bigint) as sequence_length from stats, parameters, sft_summary, gate",
}


_FENCE = lambda body: f"'```text' || {NL} || {body} || {NL} || '```'"
_CUT = f"case when length(text) > 4000 then left(text, 4000) || {NL} || '...[TRUNCATED]...' else text end"
SQL |= {
    "response_ids": f"with {H}, e as (select task_id, unnest(m) as m, unnest(range(0, len(m))) as pos from (select task_id, list_filter(messages, lambda m: m.role = 'assistant') as m from chats)) select task_id, cast(pos as integer) as pos, task_id || '_resp_' || pos as response_id, task_id || '_resp_' || pos || '_candidate_' || pos as candidate_id, 'scripted:model' as source from e",
    "resolved_specs": "select p_partkey, case when p_partkey % 3 = 0 then '/abs/' || p_brand else 'specs/' || p_brand end as path from part",
    "patch_prompts": f"""select doc_id, 'Task ID: ' || doc_id || {NL} || {NL} || 'Repository tree:' || {NL} || case when doc_id % 10 = 0 then '(no files included)' else '- app/a.py' || {NL} || '- README.md' end || {NL} || {NL} || 'Relevant file context:' || {NL}
      || case when doc_id % 10 = 0 then '' else '### File: app/a.py' || {NL} || {_FENCE(_CUT)} || {NL} || {NL} || '### File: README.md' || {NL} || {_FENCE('source')} end || {NL} || {NL} || 'Current test failure:' || {NL} || {_FENCE('right(text, 3000)')} || {NL} || {NL}
      || 'Previous failed attempt feedback:' || {NL} || {_FENCE('lang')} || {NL} || {NL} || 'Output contract:' || {NL} || 'Return only a unified diff patch beginning with diff --git.' || {NL} as prompt from documents""",
    "command_records": "select s_suppkey, 'run ' || s_name || ' ' || s_nationkey as command, s_nationkey % 4 <> 0 and s_nationkey % 3 = 0 as passed from supplier",
    "curriculum_violations": f"with {CURRICULUM} select count(*) - 192 as rows_off, count(*) filter (split = 'eval') - 32 as eval_rows_off, count(*) - count(distinct task_id) as repeated_ids, cast(0 as bigint) as unknown_splits, cast(0 as bigint) as unknown_categories, count(*) filter (operations = '') as without_operations, (select count(*) from (select category from curriculum group by category having count(*) <> 16)) as uneven_categories, count(distinct category) - 12 as categories_off from curriculum",
}
SQL["check_parts"] = f"select task_id, string_split(first_check, '::')[1] as file_part, string_split(first_check, '::')[-1] as test_part from ({SQL['curriculum_v0']})"

from lodestrata.plans import run_oracle as _run_oracle  # noqa: E402

SQL |= _run_oracle.SQL
SQL["registry_report"] = f"select sort_key, stage, '| ' || display_step || ' | ' || stage || ' | ' || path || ' | ' || coalesce(result, '') || ' |' as line from ({SQL['run_registry']})"
SQL["registry_overview"] = f"select count(*) as entry_count, string_agg(display_step, ',' order by sort_key, stage) as steps from ({SQL['run_registry']})"
