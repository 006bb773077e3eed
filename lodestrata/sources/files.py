"""Readers and writers for Parquet, JSON, JSONL, text trees, manifests and Markdown reports.

Schemas are given, never inferred. Paths may be of any store that Spark reads."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestrata.functions import text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One document for each file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, *, missing_ok: bool = False) -> DataFrame:
    """One object a line, blank lines skipped; a missing file fails unless ``missing_ok``."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_manifests(spark: SparkSession, path: str, schema: StructType | str, project: str) -> DataFrame:
    """All ``*manifest.json`` below a path that parse, are of the project and have a stage; adds path."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option("pathGlobFilter", "*manifest.json").json(path)
    return rows.withColumn("path", F.col("_metadata.file_path")).filter((F.col("project") == project) & F.col("stage").isNotNull())


#: Directory names that are never read, and suffixes that are. Fixed values.
EXCLUDED = [".git", "__pycache__", ".pytest_cache", ".mypy_cache", ".venv", "venv", "node_modules", "dist", "build"]
SUFFIXES = [".py", ".md", ".toml", ".yaml", ".yml", ".json", ".txt", ".sh"]


def included(path: Column) -> Column:
    """Not hidden, in no excluded directory, with a known suffix."""
    parts = F.split(path, "/")
    suffix = F.lit(False)
    for s in SUFFIXES:
        suffix = suffix | path.endswith(s)
    return ~F.arrays_overlap(parts, F.array(*[F.lit(d) for d in EXCLUDED])) & ~F.element_at(parts, -1).startswith(".") & suffix


def listing(spark: SparkSession, path: str) -> list[str]:
    """Text files below a path that aren't empty, by listing alone: excluded directories are not entered."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    system, left, out = root.getFileSystem(spark._jsc.hadoopConfiguration()), [root], []
    while left:
        for entry in system.listStatus(left.pop()):
            name = entry.getPath().getName()
            if entry.isDirectory():
                if name not in EXCLUDED:
                    left.append(entry.getPath())
            elif name.endswith(tuple(SUFFIXES)) and not name.startswith((".", "_")) and entry.getLen():
                out.append(entry.getPath().toString())
    return sorted(out, key=lambda f: f.split("/"))


def read_text_tree(spark: SparkSession, path: str, *, most: int = 20, chars: int = 4000, marker: str = "\n...[TRUNCATED]...") -> DataFrame:
    """First ``most`` text files in order of path parts: path below the root, text cut to ``chars``.

    Only their bytes are read. Spark has no row for an empty file or a name that starts with ``_``."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().rstrip("/")
    chosen = listing(spark, path)[:most]
    if not chosen:
        return spark.createDataFrame([], "path string, text string")
    files = spark.read.format("binaryFile").load(chosen).select(F.regexp_replace("path", rf"^.*?\Q{root}\E/", "").alias("path"), F.decode("content", "UTF-8").alias("text"))
    return files.filter(included(F.col("path"))).orderBy(F.split("path", "/")).select("path", text.truncated(F.col("text"), chars, marker).alias("text"))


def editable_files(files: DataFrame, most: int = 8) -> DataFrame:
    """Python files that are no tests; package markers only if there is nothing else."""
    name = F.element_at(F.split("path", "/"), -1)
    fine = F.col("path").endswith(".py") & ~F.col("path").startswith("tests/") & ~F.col("path").contains("/tests/") & ~name.startswith("test_")
    tier = files.filter(fine).withColumn("tier", (name == "__init__.py").cast("int"))
    return tier.join(tier.agg(F.min("tier").alias("tier")), "tier").drop("tier").orderBy(F.split("path", "/")).limit(most)


def sorted_keys(df: DataFrame) -> DataFrame:
    """Columns by name, so that written objects have their keys in order."""
    return df.select(*[F.col(f"`{c}`") for c in sorted(df.columns)])


def write_jsonl(df: DataFrame, path: str, *, append: bool = False, keep_nulls: bool = True, sort_keys: bool = False) -> None:
    df = sorted_keys(df) if sort_keys else df
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", not keep_nulls).json(path)


def write_new(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key is not there yet; their number."""
    if exists(df.sparkSession, path):
        df = df.join(df.sparkSession.read.schema(df.schema).json(path).select(key), key, "left_anti")
    df = df.select("*").persist()
    n = df.count()
    if n:
        write_jsonl(df, path, append=True)
    df.unpersist()
    return n


def write_by(df: DataFrame, path: str, key: str) -> None:
    """A folder for each key."""
    df.write.mode("overwrite").partitionBy(key).json(path)


def markdown_line(columns: list[str]) -> Column:
    """A row as a line of a Markdown table; nulls are empty cells."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))


def _markdown_head(title: str, columns: list[str]) -> list[str]:
    return [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]


def markdown(df: DataFrame, title: str, order: list[str]) -> str:
    """A small result as a Markdown table; of a large one :func:`write_markdown` writes the lines."""
    rows = df.orderBy(*order).select(markdown_line(df.columns).alias("line")).collect()
    return "\n".join([*_markdown_head(title, df.columns), *[r.line for r in rows]]) + "\n"


def write_markdown(df: DataFrame, path: str, title: str, order: list[str]) -> None:
    """A result of any size as text files whose names are in the report's order; no row passes through the driver."""
    head = df.sparkSession.createDataFrame([(0, i, x) for i, x in enumerate(_markdown_head(title, df.columns))], "body int, place int, value string")
    keys = [F.col(c).alias(f"_key{i}") for i, c in enumerate(order)]
    lines = df.select(F.lit(1).alias("body"), F.lit(0).alias("place"), markdown_line(df.columns).alias("value"), *keys)
    head = head.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in lines.schema.fields[3:]])
    head.unionByName(lines).orderBy("body", "place", *[f"_key{i}" for i in range(len(order))]).select("value").write.mode("overwrite").text(path)


def document(columns: list[str]) -> Column:
    """A row as an indented JSON document; nulls stay."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"pretty": "true", "ignoreNullFields": "false"})


def write_documents(df: DataFrame, path: str, key: str) -> None:
    """Each row as an indented JSON document in a folder of its key."""
    df.select(F.col(key), document(df.columns).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    """``*.patch`` files below a folder for each task: task_id (the folder's name), patch_id, text, sorted by path."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.patch").text(path, wholetext=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    named = rows.select(parts.alias("parts"), F.element_at(parts, -2).alias("task_id"), F.element_at(parts, -1).alias("patch_id"), F.col("value").alias("text"))
    return named.orderBy("parts").drop("parts")


SPEC = "benchmark_name string, tasks array<struct<task_json:string,patch_file:string>>"


def read_task_specs(spark: SparkSession, path: str) -> DataFrame:
    """A benchmark's tasks in order; relative paths stand below the specification's folder."""
    base = path.rsplit("/", 1)[0]
    at = lambda c: F.when(c.startswith("/") | c.contains("://"), c).otherwise(F.concat(F.lit(f"{base}/"), c))
    rows = read_json(spark, path, SPEC).select("benchmark_name", F.posexplode("tasks").alias("pos", "t"))
    return rows.select("benchmark_name", F.col("pos").cast("long").alias("pos"), at(F.col("t.task_json")).alias("task_json"), at(F.col("t.patch_file")).alias("patch_file"))


def read_yaml(spark: SparkSession, path: str) -> dict:
    """A small configuration, read on the driver; needs a YAML library."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the package yaml") from e
    body = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    return yaml.safe_load(body) or {}


def write_text(spark: SparkSession, path: str, body: str) -> None:
    """One text file of any store; parent folders are made."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(body.encode()))
    finally:
        out.close()


def write_document(df: DataFrame, path: str) -> None:
    """A one-row result as an indented JSON document."""
    rows = df.select(document(df.columns).alias("j")).take(2)
    if len(rows) != 1:
        raise ValueError("a document is one row")
    write_text(df.sparkSession, path, rows[0].j + "\n")


def write_messages(df: DataFrame, path: str, messages: str = "messages") -> None:
    """A row's messages as a JSON array a line, by task."""
    df.select("task_id", F.to_json(messages).alias("value")).write.mode("overwrite").partitionBy("task_id").text(path)


def write_patches(df: DataFrame, path: str, *, patch: str = "patch") -> DataFrame:
    """Write the valid patches, a folder for each task; gives the rows that aren't valid, with their errors."""
    checked = df.withColumn("error", text.diff_error(F.col(patch)))
    checked.filter("error is null").select("task_id", F.regexp_replace(patch, r"\n\z", "").alias("value")).write.mode("overwrite").partitionBy("task_id").text(path)
    return checked.filter("error is not null")


def manifest(spark: SparkSession, *, project: str, stage: str, revision: str | None = None, extra: dict[str, str] | None = None) -> DataFrame:
    """One row that describes a run; later keys of ``extra`` win. The revision is a parameter: workers have no repository."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    fields = {"project": F.lit(project), "stage": F.lit(stage), "created_at_utc": now, "created_ms": F.unix_millis(F.current_timestamp()), "engine": F.version()}
    fields |= {"revision": F.lit(revision).cast("string"), "run_id": F.concat(F.lit(f"{stage}-"), F.left(F.uuid(), F.lit(8)))}
    return spark.range(1).select(*[c.alias(n) for n, c in (fields | {k: F.lit(v) for k, v in (extra or {}).items()}).items()])


def timed(action, *args, **how) -> tuple[object, float]:
    """What a driver's action gives, and its seconds to six places."""
    start = time.perf_counter()
    out = action(*args, **how)
    return out, round(time.perf_counter() - start, 6)
