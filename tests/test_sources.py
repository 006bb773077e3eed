"""Files written and read again."""

import json
import re

import pytest

from lodestrata.sources import files


def test_jsonl_round_trip_and_missing_file(spark, tmp_path):
    df = spark.createDataFrame([(1, "é x", None), (2, "b", 3.5)], "id long, s string, v double")
    where = str(tmp_path / "rows")
    files.write_jsonl(df, where)
    back = files.read_jsonl(spark, where, df.schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert files.read_jsonl(spark, str(tmp_path / "none"), df.schema, missing_ok=True).count() == 0
    (tmp_path / "blank.jsonl").write_text('{"id": 1}\n\n\n{"id": 2}\n')
    assert files.read_jsonl(spark, str(tmp_path / "blank.jsonl"), "id long").count() == 2
    assert files.write_new(spark.createDataFrame([(2, "b", 1.0), (9, "n", 1.0)], df.schema), where, "id") == 1
    files.write_by(df, str(tmp_path / "by"), "id")
    assert (tmp_path / "by" / "id=1").is_dir()


def test_manifests(spark, tmp_path):
    for name, data in {"a/x_manifest.json": {"project": "p", "stage": "step1"}, "b/y_manifest.json": {"project": "q", "stage": "s"}, "c/manifest.json": {"project": "p"}, "d/other.json": {"project": "p", "stage": "z"}}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(data))
    (tmp_path / "e_manifest.json").write_text("{broken")
    rows = files.read_manifests(spark, str(tmp_path), "project string, stage string", "p").collect()
    assert [(r.stage, r.path.rsplit("/", 2)[-2]) for r in rows] == [("step1", "a")]


def test_text_tree(spark, tmp_path):
    for name, body in {"a/b.py": "x" * 50, "a-b/c.py": "y", ".hidden.py": "h", "node_modules/z.py": "n", "tests/test_a.py": "t", "r.bin": "b", "s.md": "doc"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    tree = files.read_text_tree(spark, str(tmp_path), chars=10, marker="!")
    got = {r.path: r.text for r in tree.collect()}
    assert set(got) == {"a/b.py", "a-b/c.py", "tests/test_a.py", "s.md"} and got["a/b.py"] == "x" * 10 + "!"
    assert [r.path for r in files.editable_files(tree).collect()] == ["a/b.py", "a-b/c.py"]
    marked = spark.createDataFrame([("pkg/__init__.py", ""), ("tests/test_b.py", "")], "path string, text string")
    assert [r.path for r in files.editable_files(marked).collect()] == ["pkg/__init__.py"]
    assert [r.path for r in files.editable_files(tree.select("path", "text").unionByName(marked)).collect()] == ["a/b.py", "a-b/c.py"]
    assert files.read_text_tree(spark, str(tmp_path), most=1).count() == 1


def test_markdown(spark):
    out = files.markdown(spark.createDataFrame([(2, None), (1, "a")], "k long, v string"), "T", ["k"])
    assert out == "# T\n\n| k | v |\n| --- | --- |\n| 1 | a |\n| 2 |  |\n"


def test_patches_specs_and_writers(spark, tmp_path):
    good = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n"
    rows = spark.createDataFrame([("t1", good), ("t2", "no diff"), ("t3", None)], "task_id string, patch string")
    bad = files.write_patches(rows, str(tmp_path / "patches"))
    assert sorted(r.task_id for r in bad.collect()) == ["t2", "t3"]
    for name, body in {"tasks/b/2.patch": good, "tasks/a/1.patch": "x\n\ny", "tasks/a/n.txt": "n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    assert [(r.task_id, r.patch_id, r.text) for r in files.read_patches(spark, str(tmp_path / "tasks")).collect()] == [("a", "1.patch", "x\n\ny"), ("b", "2.patch", good)]
    spec = {"benchmark_name": "b", "tasks": [{"task_json": "t.json", "patch_file": "/abs/p.patch"}, {"task_json": "u/t.json", "patch_file": "p.patch"}]}
    (tmp_path / "spec.json").write_text(json.dumps(spec, indent=1))
    got = [(r.pos, r.task_json, r.patch_file) for r in files.read_task_specs(spark, str(tmp_path / "spec.json")).orderBy("pos").collect()]
    assert got == [(0, f"{tmp_path}/t.json", "/abs/p.patch"), (1, f"{tmp_path}/u/t.json", f"{tmp_path}/p.patch")]
    files.write_text(spark, str(tmp_path / "deep" / "er" / "n.txt"), "é\n")
    assert (tmp_path / "deep" / "er" / "n.txt").read_text() == "é\n"
    one = spark.createDataFrame([(1, None, ["a"])], "z long, y string, x array<string>")
    files.write_document(one, str(tmp_path / "doc.json"))
    assert json.loads((tmp_path / "doc.json").read_text()) == {"z": 1, "y": None, "x": ["a"]} and "\n" in (tmp_path / "doc.json").read_text().strip()
    with pytest.raises(ValueError):
        files.write_document(one.limit(0), str(tmp_path / "none.json"))
    files.write_jsonl(one, str(tmp_path / "sorted"), sort_keys=True)
    line = "".join(p.read_text() for p in (tmp_path / "sorted").glob("*.json"))
    assert list(json.loads(line)) == ["x", "y", "z"]
    chat = spark.createDataFrame([("t", [("user", "a\nb")])], "task_id string, messages array<struct<role:string,content:string>>")
    files.write_messages(chat, str(tmp_path / "chats"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "chats" / "task_id=t").glob("*.txt"))) == [{"role": "user", "content": "a\nb"}]


def test_manifest_yaml_and_timer(spark, tmp_path):
    (r,) = files.manifest(spark, project="p", stage="s", extra={"engine": "own", "more": "x"}).collect()
    assert (r.project, r.stage, r.engine, r.more, r.revision) == ("p", "s", "own", "x", None)
    assert re.fullmatch(r"s-[0-9a-f]{8}", r.run_id) and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}\+00:00", r.created_at_utc) and r.created_ms > 1.6e12
    (tmp_path / "c.yaml").write_text("a:\n  - 1\n")
    try:
        import yaml  # noqa: F401

        assert files.read_yaml(spark, str(tmp_path / "c.yaml")) == {"a": [1]}
    except ImportError:
        with pytest.raises(RuntimeError):
            files.read_yaml(spark, str(tmp_path / "c.yaml"))
    out, seconds = files.timed(sum, [1, 2])
    assert out == 3 and 0 <= seconds < 5


def test_tree_of_a_folder_without_texts(spark, tmp_path):
    (tmp_path / "a.bin").write_text("x")
    (tmp_path / "e.py").write_text("")
    assert files.read_text_tree(spark, str(tmp_path)).count() == 0


def test_reports_and_documents_of_any_size(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else f"v{i}") for i in range(50)], "k long, v string").repartition(7)
    files.write_markdown(df, str(tmp_path / "report"), "T", ["k"])
    parts = sorted((tmp_path / "report").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == files.markdown(df, "T", ["k"])
    files.write_documents(df.limit(3), str(tmp_path / "docs"), "k")
    found = sorted((tmp_path / "docs").glob("k=*/part-*"))
    assert len(found) == 3 and all(json.loads(p.read_text()).keys() == {"k", "v"} for p in found)
