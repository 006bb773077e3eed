"""SQL for DuckDB of the queries in :mod:`lodestrata.plans.run_queries`."""

from __future__ import annotations

from lodestrata.operators import curricula, datasets, prompts, runs
from lodestrata.plans.oracle import CURRICULUM, NL, REPAIR, STRIP, TOKENS, I, Q, _validated, _values
from lodestrata.plans.queries import LIMIT
from lodestrata.plans import views
from lodestrata.plans.run_queries import BUCKET, COMMIT


def _list(values: list[str]) -> str:
    return "[" + ", ".join(Q(v) for v in values) + "]"


ENTRIES = f"""{views.ENTRIES_SQL.replace("entries as", "given as")},
entries as (select *, 's3://{BUCKET}/reports/' || manifest || '_manifest.json' as manifest_uri, 's3://{BUCKET}/configs/project_scaffold/{datasets.NAMESPACE}_' || artifact || '_v0.tar.gz' as artifact_uri,
  array_to_string(list_transform(results, lambda r: 's3://{BUCKET}/' || r), ',') as primary_results from given)"""


def _json_array(*parts: str) -> str:
    """A JSON array of texts of which some may be null."""
    return f"to_json(list_filter([{', '.join(parts)}], lambda x: x is not null))"


def _operation(kind: str, file: str, intent: str, symbol: str, reason: str) -> str:
    some = lambda name, value: f"""coalesce(',"{name}":' || to_json({value}), '')"""
    return f"""'{{"file":' || to_json({file}) || ',"intent":' || to_json({intent}) || {some("reason", reason)} || {some("symbol", symbol)} || ',"type":' || to_json({kind}) || '}}'"""


def _rows(v: int, made: str, prompt: str, extra: str, prohibited: str, risks: str, checks: str, difficulty: str) -> str:
    barred = "category = 'wrong_file_guard'" if v else f"{prohibited} <> '[]'"
    constraints = [*map(Q, curricula.CONSTRAINTS[v]), f"case when {barred} then {Q(curricula.PROHIBITION)} end"]
    base = _operation("'modify_function'", "file", "expected", "name", "bug" if v else "null")
    edge = """"edge_case":' || to_json(edge) || ',""" if v else ""
    source, by = curricula.SOURCE[v]
    tests = """"known_test_file":' || to_json(test_file) || ',"known_test_symbol":' || to_json(test_symbol) || '""" if v else """"known_test":' || to_json(test_file || '::' || test_symbol) || '"""
    symbol = ""","primary_symbol":' || to_json(name) || '""" if v else ""
    return f"""select cast(idx as bigint) as "index", '{datasets.NAMESPACE}.sft_row.v{v}' as schema_version, task_id, split, category, {difficulty} as difficulty, {Q(curricula.SYSTEM[v])} as system, {prompt} as user,
  '{{"acceptance_criteria":' || to_json({_list(curricula.CRITERIA[v])}) || ',"category":' || to_json(category) || ',"constraints":' || {_json_array(*constraints)} || ',"notes":{{{edge}"expected_behavior":' || to_json(expected) || ',"primary_symbol":' || to_json(name)
  || '}},"operations":[' || {base} || coalesce(',' || {extra}, '') || '],"prohibited_files":' || {prohibited} || ',"risk_flags":' || {risks} || ',"schema_version":"{datasets.NAMESPACE}.structured_intent.v{v}","target_files":' || to_json([file]) || ',"task_id":' || to_json(task_id)
  || ',"test_files":' || to_json([test_file]) || ',"verification":' || {checks} || '}}' as target_text,
  '{{"case_name":' || to_json(name) || ',"generated_by":"{by}",{tests},"primary_file":' || to_json(file) || '{symbol},"requires_gpu":false,"source":"{source}"}}' as metadata from {made}"""


def _placed(column: str) -> str:
    return f"case {column} when 'file' then file when 'test_file' then test_file else {column} end"


_SYMBOL = "case when named then case when place = 'test_file' then test_symbol else name end end"
_INTENT = "replace(replace(template, '{expected}', expected), '{edge}', edge)"
_SECOND_OPERATIONS = ", ".join(f"({Q(c)}, {Q(p)}, {str(n).lower()}, {Q(t)})" for c, p, n, t in curricula.OPERATIONS)
_FIRST_OPERATIONS = ", ".join(f"({Q(c)}, {Q(k)}, {Q(p)}, {str(n).lower()}, {Q(t)})" for c, k, p, n, t in curricula.FIRST_OPERATIONS)
SECOND = f"""{CURRICULUM},
operations(category, place, named, template) as (values {_SECOND_OPERATIONS}),
second_made as (select b.*, c.task_id, c.split, c.difficulty, c.prompt, o.place, o.named, o.template from both_ b join curriculum c on b.idx = c."index" left join operations o on b.category = o.category),
second_rows as ({_rows(
    1, "second_made", "prompt", f"case when extra is not null then {_operation('extra', _placed('place'), _INTENT, _SYMBOL, 'null')} end",
    _json_array("case category when 'wrong_file_guard' then 'app/__init__.py' when 'invalid_patch_repair' then 'nonexistent.py' end"), _json_array("risk"),
    "to_json(['run ' || test_file || '::' || test_symbol, 'run all tests in ' || test_file, 'inspect diff for unrelated file changes', 'confirm no tests were deleted or weakened'])", "difficulty",
)})"""
_FIRST_CATEGORIES = _values([(i, c) for i, (c, _) in enumerate(datasets.CATEGORIES[: datasets.FIRST_CATEGORIES])])
FIRST = f"""categories(cat_pos, category) as (values {_FIRST_CATEGORIES}),
{views.CASES_SQL.replace("p_name || ' as input' as edge", "'' as edge")},
additions(category, addition) as (values {_values(curricula.FIRST_ADDITIONS)}),
operations(category, extra, place, named, template) as (values {_FIRST_OPERATIONS}),
both_ as (select c.*, k.*, cast(cat_pos * (select max(case_pos) + 1 from cases) + case_pos as bigint) as idx, 'app/' || module || '.py' as file, 'tests/test_' || module || '.py' as test_file from categories c cross join cases k),
first_made as (select b.*, addition, extra, place, named, template, case when idx % 6 = 5 then 'eval' else 'train' end as split,
  'sft-' || b.category || '-' || case when idx < 10 then '0' else '' end || idx || '-' || left(sha1(b.category || ':' || idx || ':' || name), 8) as task_id
  from both_ b left join additions a on b.category = a.category left join operations o on b.category = o.category),
first_rows as ({_rows(
    0, "first_made",
    f"'Repository task category: ' || category || {NL} || 'Bug summary: ' || bug || {NL} || 'Primary file: ' || file || {NL} || 'Known failing test: ' || test_file || '::' || test_symbol || {NL} || 'Return a structured JSON edit intent. Do not return a patch yet.' || coalesce({NL} || addition, '')",
    f"case when extra is not null then {_operation('extra', _placed('place'), _INTENT, _SYMBOL, 'null')} end",
    _json_array("case when category in ('wrong_file_guard', 'invalid_patch_repair') then 'app/__init__.py' end"),
    _json_array("case when category in ('invalid_patch_repair', 'semantic_patch_repair') then 'previous_failed_attempt_available' when category = 'wrong_file_guard' then 'wrong_file_target_risk' when category = 'missing_test_addition' then 'test_quality_risk' end"),
    "to_json(['run ' || test_file || '::' || test_symbol, 'run the relevant unit test file', 'inspect diff for unrelated changes'])",
    "case when category in ('small_multifile_edit', 'semantic_patch_repair') then 'medium' else 'easy' end",
)})"""


def _rules(v: int, name: str) -> str:
    """Broken rules of whole and damaged rows."""
    known = [c for c, _ in (datasets.CATEGORIES if v else datasets.CATEGORIES[: datasets.FIRST_CATEGORIES])]
    field = lambda path: f"case when json_valid(target_text) then target_text ->> '$.{path}' end"
    rules = {
        "schema_version": f"schema_version = '{datasets.NAMESPACE}.sft_row.v{v}'", "split": "split in ('train', 'eval')", "category": f"category in ({', '.join(map(Q, known))})",
        "messages": "n_messages = 2", "target_text": f"{STRIP('target_text')} <> ''", "target_schema_version": f"{field('schema_version')} = '{datasets.NAMESPACE}.structured_intent.v{v}'",
        "target_task_id": f"{field('task_id')} = task_id", "target_category": f"{field('category')} = category",
    } | {f"target_{a}": f"{field(f'{a}[0]')} is not null" for a in curricula.ARRAYS[v]}
    counts = ", ".join(f"count(*) filter (not coalesce({holds}, false)) as {k}" for k, holds in rules.items())
    damaged = f"""select "index", case when i = 1 then 'x' else schema_version end as schema_version, case when i = 7 then 'same' else task_id end as task_id, case when i = 4 then 'unset' else split end as split,
  case when i = 6 then 'other' else category end as category, case when i = 8 then 1 else 2 end as n_messages, case i when 2 then replace(target_text, '"task_id":"sft', '"task_id":"oft') when 3 then ' ' when 5 then replace(target_text, '"verification":', '"checks":')
  when 9 then replace(target_text, '.structured_intent.', '.other.') else target_text end as target_text, 'damaged' as rows_ from (select *, "index" % 10 as i from {name})"""
    both = f"""select "index", schema_version, task_id, split, category, 2 as n_messages, target_text, 'whole' as rows_ from {name} union all {damaged}"""
    return f"""select rows_ as "rows", count(*) as row_count, count(*) - count(distinct task_id) as repeated_task_ids, {counts} from ({both}) group by rows_"""


_CHECKED = f"""{I}, {_validated("intents", "checked")},
outcomes as (select *, valid and task_id % 2 = 0 as applied, valid and task_id % 4 = 0 as solved, coalesce(find_text <> '', false) as parsed from checked)"""
_RATE = "round(case when count(*) = 0 then 0.0 else count(*) filter (solved) / count(*) end, 6) as solve_rate"


def _between(a: str, b: str, x: str = "whole") -> str:
    start = f"instr({x}, {a})"
    rest = f"substr({x}, {start} + length({a}))"
    return f"case when {start} > 0 and instr({rest}, {b}) > 0 then left({rest}, instr({rest}, {b}) - 1) else '' end"


def _text(value: str) -> str:
    """A literal with line ends."""
    return "(" + f" || {NL} || ".join(Q(x) for x in value.split("\n")) + ")"


_BEHAVIOUR = _text(runs.BEHAVIOUR)
PROMPTS = f"""prompts as (select doc_id as task_id, 'Edit.' || {NL} || {NL} || 'Task' || {NL} || {NL} || {_text(runs.BLOCKS[0][1])} || text || '```' || {NL} || {NL} || 'Tests:' || {NL} || '```python' || {NL} || source
  || '```' || {NL} || {NL} || case when doc_id % 3 = 0 then 'Behavior:' else 'Expected behavior:' end || {NL} || ' ' || lang || {NL} as whole from documents)"""
_FIELD = lambda n: f"case when error is null then body ->> '$.{n}' end as {n}"
TYPED = f"""raw as (select doc_id, to_json({{'intent_id': cast(doc_id as varchar), 'task_id': 't', 'file_path': 'app/utils.py', 'find_text': text, 'replace_text': case when doc_id % 7 <> 0 then source end, 'rationale': case when doc_id % 2 = 0 then lang end}}) as body from documents),
judged as (select *, case when doc_id % 5 in (2, 3) then 'invalid_json' when doc_id % 7 = 0 or body ->> '$.find_text' is null or body ->> '$.replace_text' is null then 'missing_field' end as error from raw)"""
_TREE = "case when doc_id % 10 = 0 then '(no files included)' else '- app/a.py' end"
_TRUNCATED = f"case when length(text) > 4000 then left(text, 4000) || {NL} || '...[TRUNCATED]...' else text end"
_FENCE = lambda c: f"'```text' || {NL} || {c} || {NL} || '```'"

SQL = {
    "run_entries": f"with {ENTRIES} select cast(pos as bigint) as pos, cast(step as bigint) as step, name, 'ok' as status, category, '{COMMIT}' as git_commit, manifest_uri, artifact_uri, primary_results, metrics, false as gpu_required, false as purchase_required from entries",
    "run_entry_lines": f"with {ENTRIES} select cast(pos as bigint) as pos, '| ' || step || ' | `' || name || '` | `' || category || '` | `ok` | no | ' || metrics || ' |' as line from entries",
    "run_entry_overview": f"with {ENTRIES} select count(*) as entry_count, string_agg(cast(step as varchar), ',' order by pos) as steps, count(*) = {runs.ENTRY_COUNT} as complete from (select step, min(pos) as pos from entries group by step)",
    "curriculum_rows": f"with {SECOND} select * from second_rows",
    "first_curriculum_rows": f"with {FIRST} select * from first_rows",
    "curriculum_rules": f"with {SECOND} {_rules(1, 'second_rows')}",
    "first_curriculum_rules": f"with {FIRST} {_rules(0, 'first_rows')}",
    "split_buckets": f"with {SECOND} select v as value, count(split) as n from (values ('train'), ('eval'), ('unset')) t(v) left join second_rows on split = v group by v",
    "curriculum_list_counts": f"with {SECOND} select task_id, split, category, cast(json_array_length(target_text, '$.target_files') as bigint) as target_file_count, cast(json_array_length(target_text, '$.operations') as bigint) as operation_count, cast(json_array_length(target_text, '$.verification') as bigint) as verification_count, length(target_text) as char_count, cast({TOKENS('target_text')} as bigint) as token_count from second_rows",
    "intent_run_summary": f"with {_CHECKED} select count(*) as total_tasks, count(*) as generated_response_count, count(*) > 0 as real_generation_ok, count(*) filter (parsed) as json_parse_success_count, count(*) filter (valid) as valid_intent_count, count(*) filter (valid) as canonical_patch_count, count(*) filter (applied) as patch_apply_success_count, count(*) filter (solved) as solved_tasks, count(*) filter (not solved) as failed_tasks, {_RATE} from outcomes",
    "toy_intent_summary": f"with {_CHECKED} select count(*) as total_tasks, count(*) filter (valid) as valid_intents, count(*) as canonical_patch_count, count(*) filter (applied) as patch_apply_success_count, count(*) filter (solved) as solved_tasks, {_RATE} from outcomes",
    "repair_run_summary": f"with {I}, {REPAIR}, outcomes as (select a.*, a.valid and a.task_id % 2 = 0 as applied, a.valid and a.task_id % 4 = 0 as solved, coalesce(b.find_text <> '', false) as parsed from after1 a join intents b on a.task_id = b.task_id) select count(*) as total_tasks, count(*) filter (parsed) as source_json_parse_success_count, count(*) filter (original_error is null) as original_valid_intent_count, count(*) filter (valid) as repaired_valid_intent_count, count(*) filter (valid) as canonical_patch_count, count(*) filter (applied) as patch_apply_success_count, count(*) filter (solved) as solved_tasks, {_RATE} from outcomes",
    "validation_error_counts": f"with {_CHECKED} select coalesce(error, 'None') as error, count(*) as n from outcomes group by 1",
    "replay_rows": f"with {_CHECKED}, {PROMPTS} select p.task_id, valid, {', '.join(f'{_between(_text(a), _text(b))} as {n}' for n, a, b in runs.BLOCKS)}, case when instr(whole, {_BEHAVIOUR}) > 0 then {STRIP(f'substr(whole, instr(whole, {_BEHAVIOUR}) + length({_BEHAVIOUR}))')} else '' end as expected_behavior from checked c join prompts p on c.task_id = p.task_id",
    "typed_intents": f"with {TYPED} select doc_id, {', '.join(_FIELD(n) for n in runs.INTENT_FIELDS)}, case when error is null then coalesce(body ->> '$.rationale', '') end as rationale, error from judged",
    "response_rows": "select turn, cast(conv_id as varchar) as response_id, case when turn % 2 = 0 then coalesce(text, '') else '' end as text, case when turn % 3 = 0 then 'role=' || role else '' end as metadata, cast(null as bigint) as token_count from conversations",
    "command_tails": "select doc_id, case when doc_id % 9 > 1 then 'run' end as command, case when doc_id % 9 > 1 then cast(doc_id % 2 as integer) end as exit_code, case doc_id % 9 when 0 then null when 1 then false else doc_id % 2 = 0 end as passed, case doc_id % 9 when 0 then null when 1 then 'patch_apply_failed' else right(text, 1600) end as stderr_tail, case doc_id % 9 when 0 then null when 1 then '' else right(text || source, 800) end as stdout_tail from documents",
    "module_targets": "select p_partkey, coalesce(array_to_string(s, ','), '') as suffixes, len(s) > 0 as targeted from (select p_partkey, list_filter(['lace', 'green', 'blue', 'khaki', 'navy', 'snow', 'sky', 'rose'], lambda w: ends_with(lower(p_name), w)) as s from part)",
    "target_modules": "select coalesce(string_agg(distinct w, ',' order by w), '') as suffixes, count(distinct p_partkey) as targets from (select p_partkey, w from part, unnest(['lace', 'green', 'blue', 'khaki', 'navy', 'snow', 'sky', 'rose']) t(w) where ends_with(lower(p_name), w))",
    "length_report": f"with t as (select lang, cast({TOKENS('text')} as bigint) as tokens, length(text) as chars from documents), g as (select coalesce(lang, 'all') as lang, count(*) as row_count, min(tokens) as min_tokens, max(tokens) as max_tokens, round(avg(tokens), 3) as mean_tokens, list_sort(list(tokens)) as l, count(*) filter (tokens > {LIMIT}) as would_truncate_count, min(chars) as min_chars, max(chars) as max_chars, round(avg(chars), 3) as mean_chars from t group by grouping sets ((), (lang))) select * exclude (l), l[cast(round_even((row_count - 1) * 0.5, 0) as bigint) + 1] as median_tokens, l[cast(round_even((row_count - 1) * 0.95, 0) as bigint) + 1] as p95_tokens from g",
    "patch_messages": f"select cast(doc_id as varchar) as task_id, {Q(prompts.PATCH_SYSTEM)} as system, 'Task ID: ' || doc_id || {NL} || 'Title: Fix ' || source || {NL} || 'Task type: bugfix' || {NL} || {NL} || 'Description:' || {NL} || lang || {NL} || {NL} || 'Test command:' || {NL} || 'run tests' || {NL} || {NL} || 'Repository tree:' || {NL} || {_TREE} || {NL} || {NL} || 'Relevant file context:' || {NL} || case when doc_id % 10 = 0 then '' else '### File: app/a.py' || {NL} || {_FENCE(_TRUNCATED)} end || {NL} || {NL} || 'Current test failure:' || {NL} || {_FENCE('text')} || {NL} || {NL} || 'Previous failed attempt feedback:' || {NL} || {_FENCE('source')} || {NL} || {NL} || 'Output contract:' || {NL} || 'Return only a unified diff patch beginning with diff --git.' || {NL} as user from documents",
    "strict_messages": f"select cast(doc_id as varchar) as task_id, {_text(prompts.STRICT_SYSTEM)} as system, 'Task id: ' || doc_id || {NL} || 'Title: Fix ' || source || {NL} || 'Description: ' || lang || {NL} || {NL} || 'Test command:' || {NL} || 'run tests' || {NL} || {NL} || 'Failing test stderr:' || {NL} || right(text, 3000) || {NL} || {NL} || 'Allowed files to edit:' || {NL} || case when doc_id % 10 = 0 then '- <none>' else '- app/a.py' end || {NL} || {NL} || 'Repository files:' || {NL} || case when doc_id % 10 = 0 then '' else '### FILE: app/a.py' || {NL} || '```python' || {NL} || left(text, 4000) || {NL} || '```' end || {NL} || {_text(prompts.STRICT_END)} as user, {', '.join(f'{Q(v) if isinstance(v, str) else str(v).lower()} as {k}' for k, v in prompts.CONTRACT)} from documents",
}
