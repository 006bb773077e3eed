"""Responses of scripted adapters, by partition, template and tokenizer."""

from pyspark.sql import functions as F

from lodestrata.operators import prompts
from lodestrata.sources import responses


def chats(spark, rows):
    return spark.createDataFrame(rows, "task_id long, messages array<struct<role:string,content:string>>")


def test_one_to_many_with_template_and_tokenizer(spark):
    rows = [(1, [("user", "one two")]), (2, [("system", "be"), ("user", "x")]), (3, []), (4, None)]
    adapter = lambda: lambda prompt, messages: [f"{prompt}!", "b c", "d"][: len(messages) + 1] if messages else []
    got = responses.responses(chats(spark, rows).repartition(3), adapter, most=2, template=lambda m: "|".join(x["content"] for x in m), tokenize=list)
    assert sorted(map(tuple, got.collect())) == [(1, "1_resp_0", 0, "one two!", 7, 8), (1, "1_resp_1", 1, "b c", 7, 3), (2, "2_resp_0", 0, "be|x!", 4, 5), (2, "2_resp_1", 1, "b c", 4, 3)]


def test_the_adapter_is_built_once_a_partition(spark):
    def build():
        calls = []
        return lambda prompt, messages: calls.append(1) or [str(len(calls))]

    rows = chats(spark, [(i, [("user", "x")]) for i in range(1000)]).coalesce(1)
    got = responses.responses(rows, build).collect()
    assert sorted(int(r.text) for r in got) == list(range(1, 1001)) and {r.token_count for r in got} == {1}


def test_no_rows(spark):
    assert responses.responses(chats(spark, []), lambda: None).count() == 0


def test_typed_tasks_coerce_and_name_what_is_missing(spark):
    good = '{"schema_version":1,"task_id":7,"title":"t","repo_dir":"r","test_command":"c","timeout_seconds":%s}'
    rows = [(good % '" 12 "',), (good % "3.9",), (good % '"3.9"',), (good % "null",), ("[1]",), ("nonsense",), (None,), (good % "5" + " ",)]
    got = prompts.typed_tasks(spark.createDataFrame(rows, "d string").coalesce(1).withColumn("i", F.monotonically_increasing_id()), "d", "/base/").orderBy("i").collect()
    assert [r.timeout_seconds for r in got] == [12, 3, None, None, None, None, None, 5]
    assert [r.error for r in got] == [None, None, "timeout_not_whole", "missing:timeout_seconds", "missing:schema_version,task_id,title,repo_dir,test_command,timeout_seconds", "no_json", "no_json", None]
    assert (got[0].schema_version, got[0].task_id, got[0].repo_dir, got[0].task_type, got[0].description) == ("1", "7", "/base/r", "unit_bugfix", "")


def test_generated_responses_are_written_with_their_schema(spark, tmp_path):
    made = responses.responses(chats(spark, [(1, [("user", "one two")])]), lambda: lambda prompt, messages: ["a b"])
    responses.write_generated(made, str(tmp_path / "out"), "scripted:model")
    [row] = spark.read.schema(responses.GENERATED).json(str(tmp_path / "out")).collect()
    assert (row.response_id, row.text, row.source, row.token_count, row.latency_seconds, row.metadata) == ("1_resp_0", "a b", "scripted:model", 2, None, None)
