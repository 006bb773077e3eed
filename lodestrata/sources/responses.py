"""Responses of a model to message rows: 1 to N for each row, with the adapter built once for each partition.

The adapter and the optional template and tokenizer are plain Python; Spark deals the rows, so their work is spread and a lost partition is
asked again. An adapter that isn't deterministic may answer otherwise then: write the result before several steps read it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text

#: From a prompt and its messages to texts, in order.
Adapter = Callable[[str, list[dict]], list[str]]
SCHEMA = "response_id string, position int, text string, prompt_tokens long, token_count long"
BATCH = 256


#: A generated response as it is stored, with its adapter's name and what the runtime has measured.
GENERATED = "response_id string, text string, source string, prompt_tokens long, token_count long, latency_seconds double, metadata map<string,string>"


def write_generated(rows: DataFrame, path: str, source: str) -> None:
    """Write responses as JSON lines of GENERATED: fields that ``rows`` lacks are null, others are left out."""
    given = rows.withColumn("source", F.lit(source))
    fields = [f.split(" ") for f in GENERATED.split(", ")]
    kept = [(F.col(n) if n in given.columns else F.lit(None)).cast(t).alias(n) for n, t in fields]
    given.select(*kept).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def responses(rows: DataFrame, build: Callable[[], Adapter], *, most: int | None = None, template: Callable[[list[dict]], str] | None = None, tokenize: Callable[[str], list] | None = None) -> DataFrame:
    """For rows of task_id and messages: the task_id and columns of SCHEMA for each text, the first ``most`` of a row if given.

    The prompt is made by ``template``, or else by the plain rendering, in the JVM. Tokens are counted by ``tokenize``, or else are runs of
    other characters than white space. A row without texts gives none; null messages are none."""
    none = F.array().cast("array<struct<role:string,content:string>>")
    asked = rows.select("task_id", F.coalesce("messages", none).alias("messages"), text.render_plain(F.coalesce("messages", none)).alias("prompt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adapter = build()
        count = lambda t: len(tokenize(t) if tokenize else t.split())
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part, out, whose = batch.slice(at, BATCH), [], []
                for i, (task, messages, plain) in enumerate(zip(*(c.to_pylist() for c in part.columns), strict=True)):
                    prompt = template(messages) if template else plain or ""
                    for n, t in enumerate(adapter(prompt, messages)[:most]):
                        out.append((f"{task}_resp_{n}", n, t, count(prompt), count(t)))
                        whose.append(i)
                columns = list(zip(*out, strict=True)) or [()] * 5
                kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(whose, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["task_id", *[f.split(" ")[0] for f in SCHEMA.split(", ")]])

    return asked.mapInArrow(run, f"task_id {rows.schema['task_id'].dataType.simpleString()}, {SCHEMA}")
