"""Text functions over columns: diffs, fences, markers, JSON, paths, chat rendering, token counts.

Everything runs in the JVM but the exact similarity, which needs Python's difflib. White space is ASCII white space."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
FENCED_DIFF = r"(?is)```(?:diff|patch)?\s*\n(.*?)```"
DIFF_START = "diff --git "
DIFF_LINE = r"^(diff --git |index |@@| |\+|-|\\ No newline at end of file)"
CONTAMINATION = ["This patch", "This change", "ensuring that", "correct behavior", "as per the task"]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+$", "")


def ensure_newline(text: Column) -> Column:
    return F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))


def tail(text: Column, n: int) -> Column:
    return F.right(F.coalesce(text, F.lit("")), F.lit(n))


def truncated(text: Column, n: int, marker: str) -> Column:
    """The first n characters and the marker, if there are more."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(marker))).otherwise(text)


MARKER = "\n...[truncated]..."
#: The optional reads and how many characters they keep: a patch whole, others with a marker where there is more.
READS = {"patch": None, "prompt": 1500, "file": 4000, "safe": 6000}


def optional(text: Column, most: int | None) -> Column:
    """A text that may not be there: empty then; at most so many characters and the marker."""
    return F.coalesce(text, F.lit("")) if most is None else truncated(text, most, MARKER)


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences; an empty part occurs between all characters."""
    dropped = F.length(text) - F.length(F.replace(text, part, F.lit("")))
    return F.when(F.length(part) == 0, F.length(text) + 1).otherwise((dropped / F.greatest(F.length(part), F.lit(1))).cast("long")).cast("long")


def replace_first(text: Column, part: Column, new: Column) -> Column:
    at = F.instr(text, part)
    return F.when(at > 0, F.concat(F.left(text, at - 1), new, F.substr(text, at + F.length(part)))).otherwise(text)


def between(text: Column, start: str, end: str) -> Column:
    """Text between two markers, empty if either is missing."""
    a = F.instr(text, F.lit(start))
    rest = F.substr(text, a + len(start))
    b = F.instr(rest, F.lit(end))
    return F.when((a > 0) & (b > 0), F.left(rest, b - 1)).otherwise("")


def after(text: Column, marker: str) -> Column:
    a = F.instr(text, F.lit(marker))
    return F.when(a > 0, strip(F.substr(text, a + len(marker)))).otherwise("")


def cut_at_stop(text: Column, stops: list[str]) -> Column:
    """Text before the earliest stop sequence."""
    at = F.array_min(F.filter(F.array(*[F.instr(text, F.lit(s)) for s in stops if s]), lambda p: p > 0))
    return F.when(at.isNull(), text).otherwise(F.left(text, at - 1))


def unified_diff(raw: Column) -> Column:
    """First fenced block with a diff header, else all from the first header; null if there is none."""
    fenced = F.try_element_at(F.filter(F.transform(F.regexp_extract_all(raw, F.lit(FENCED_DIFF), F.lit(1)), strip), lambda b: b.contains(DIFF_START)), F.lit(1))
    at = F.instr(raw, F.lit(DIFF_START))
    found = F.coalesce(fenced, F.when(at > 0, F.substr(raw, at)))
    return F.concat(strip(F.replace(F.replace(found, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))), F.lit("\n"))


def diff_error(diff: Column) -> Column:
    """First rule of a diff's shape that fails; null if it is well-formed."""
    return (
        F.when(diff.isNull(), "No unified diff found in model response")
        .when(~diff.startswith(DIFF_START), "Patch must start with 'diff --git '")
        .when(~diff.contains("\n--- "), "Patch missing old-file marker '--- '")
        .when(~diff.contains("\n+++ "), "Patch missing new-file marker '+++ '")
        .when(~diff.contains("\n@@"), "Patch missing hunk marker '@@'")
    )


def diff_blocks(rows: DataFrame, column: str) -> DataFrame:
    """Adds block (the first diff block's lines up to a fence or other line, without blank ones) and notes.

    Each step is a column of its own, so that no step is computed again in the ones that use it."""
    lines = F.split(column, r"\R")
    steps = rows.withColumn("_lines", lines).withColumn("_begin", F.array_position(F.transform("_lines", lambda l: l.startswith(DIFF_START)), True).cast("int"))
    tail_ = F.slice("_lines", F.greatest("_begin", F.lit(1)), F.size("_lines"))
    steps = steps.withColumn("_tail", F.when(F.col("_begin") > 0, tail_).otherwise(F.array().cast("array<string>")))
    steps = steps.withColumn("_tail", F.when(F.try_element_at("_tail", F.lit(-1)) == "", F.slice("_tail", F.lit(1), F.size("_tail") - 1)).otherwise(F.col("_tail")))
    kind = lambda l: F.when(strip(l).startswith("```"), "F").when(strip(l) == "", "B").when(l.rlike(DIFF_LINE), "D").otherwise("S")
    steps = steps.withColumn("_kind", F.transform("_tail", kind))
    first = lambda k: F.coalesce(F.nullif(F.array_position("_kind", k), F.lit(0)) - 1, F.size("_kind"))
    steps = steps.withColumn("_stop", F.least(first("F"), first("S")).cast("int"))
    kept = F.filter("_tail", lambda l, j: (j < F.col("_stop")) & (F.get("_kind", j) == "D"))
    steps = steps.withColumn("_joined", rstrip(F.array_join(kept, "\n")))
    note = lambda k, j: (
        F.when(k == "F", "stopped_at_markdown_fence").when(k == "B", "dropped_blank_line").when(k == "S", F.concat(F.lit("stopped_at_non_diff_line:"), F.left(strip(F.get("_tail", j)), F.lit(80))))
    )
    notes = F.array_compact(F.transform(F.slice("_kind", F.lit(1), F.col("_stop") + 1), note))
    found = {"block": F.when(F.col("_joined") == "", "").otherwise(F.concat("_joined", F.lit("\n"))), "notes": F.when(F.col("_begin") > 0, notes).otherwise(F.array(F.lit("missing_diff_header")))}
    return steps.withColumns(found).drop("_lines", "_begin", "_tail", "_kind", "_stop", "_joined")


def hygiene(rows: DataFrame, column: str) -> DataFrame:
    """Adds flags, counts and a status to texts."""
    rows = diff_blocks(rows, column).withColumn("_added", F.filter(F.split("block", "\n"), lambda l: l != ""))
    text = F.col(column)
    count = lambda sign: F.size(F.filter("_added", lambda l: l.startswith(sign) & ~l.startswith(sign * 3))).cast("long")
    prose = F.lit(False)
    for marker in CONTAMINATION:
        prose = prose | text.contains(marker)
    rows = rows.withColumns({
        "has_diff_header": text.contains(DIFF_START), "contains_markdown_fence": text.contains("```"), "contains_prose_after_diff": prose,
        "sanitized_line_count": F.size("_added").cast("long"), "added_line_count": count("+"), "removed_line_count": count("-"),
    })
    rows = rows.withColumn("has_change_lines", (F.col("added_line_count") > 0) | (F.col("removed_line_count") > 0))
    status = (
        F.when(~F.col("has_diff_header"), "missing_diff").when(F.col("block") == "", "empty_after_sanitization").when(~F.col("has_change_lines"), "non_actionable_no_change_lines")
        .when(F.col("contains_markdown_fence") | F.col("contains_prose_after_diff"), "sanitized_actionable_with_contamination").otherwise("actionable_diff_like")
    )
    return rows.withColumn("status", status).drop("_added")


def unfenced(text: Column) -> Column:
    """Stripped text without its opening fence line, and without the closing one if there was an opening one."""
    whole = strip(text)
    inner = F.regexp_replace(F.regexp_replace(whole, r"^```[^\n]*(\n|$)", ""), r"(^|\n)[^\S\n]*```[^\n]*$", "")
    return F.when(whole.startswith("```"), strip(inner)).otherwise(whole)


def json_object(text: Column) -> Column:
    """First ``{`` to last ``}`` after fence lines at both ends are dropped; null if there is none."""
    found = F.regexp_extract(unfenced(text), r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def looks_like_code(text: Column) -> Column:
    t = strip(text)
    return t.startswith("def ") & t.contains("\n") & t.contains("return ") & ~t.contains("```")


def escapes_root(path: Column) -> Column:
    """Absolute, or above its root at any place."""
    parts = F.split(path, "/")
    walk = F.aggregate(
        parts, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low")),
        lambda s, p: F.struct(
            (s["depth"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("depth"),
            F.least(s["low"], s["depth"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("low"),
        ),
    )
    return path.startswith("/") | (walk["low"] < 0)


def normal_path(path: Column, default: str) -> Column:
    """An empty path is the default; so are the default's bare name and longer paths that end in it."""
    name = default.rsplit("/", 1)[-1]
    value = strip(path)
    return F.when(F.coalesce(path, F.lit("")) == "", default).when(value.isin(name, f"./{name}") | value.endswith(f"/{default}"), default).otherwise(value)


def render_plain(messages: Column) -> Column:
    """``<|role|>`` lines and stripped contents, blank lines between."""
    parts = F.transform(messages, lambda m: F.concat(F.lit("<|"), strip(m["role"]), F.lit("|>\n"), strip(m["content"])))
    return F.concat(strip(F.array_join(parts, "\n\n")), F.lit("\n"))


def render_training(messages: Column, target: Column) -> Column:
    """Contents as they are, the target as the last assistant message."""
    answer = F.struct(F.lit("assistant").alias("role"), target.alias("content"))
    return F.array_join(F.transform(F.array_append(messages, answer), lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("\n"))), "\n")


def render_prompt(messages: Column) -> Column:
    """``ROLE:`` lines, ending where the assistant is to go on."""
    parts = F.transform(messages, lambda m: F.concat(F.upper(m["role"]), F.lit(":\n"), m["content"]))
    return F.concat(F.array_join(parts, "\n\n"), F.lit("\n\nASSISTANT:\n"))


def tokens(text: Column) -> Column:
    """White-space separated tokens."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def s3_parts(uri: Column) -> tuple[Column, Column]:
    pattern = r"^s3://([^/]+)/?(.*)$"
    return F.regexp_extract(uri, pattern, 1), F.regexp_extract(uri, pattern, 2)


def safe_name(name: Column) -> Column:
    return F.translate(name, "/:", "__")


def shared_characters(a: Column, b: Column) -> Column:
    """How many characters two texts share, each as often as both have it: no matching can pair more."""
    times = lambda t, c: F.length(t) - F.length(F.replace(t, c, F.lit("")))
    each = F.filter(F.array_distinct(F.split(b, "")), lambda c: c != "")
    return F.aggregate(each, F.lit(0), lambda n, c: n + F.least(times(a, c), times(b, c)))


def similar(a: Column, b: Column, least: float) -> Column:
    """difflib's ratio to 6 places where it can reach ``least``, else null.

    Lengths bound the ratio from above, then the characters that both texts have; only pairs that pass both bounds are matched exactly, in Python.
    Texts without a character have the ratio 1."""
    both = F.length(a) + F.length(b)
    by_length = 2 * F.least(F.length(a), F.length(b)) >= least * both
    near = F.when(by_length, F.when(2 * shared_characters(a, b) >= least * both, True))
    return similarity(F.when(near, a), F.when(near, b))


def similarity(a: Column, b: Column) -> Column:
    """difflib's ratio to 6 places; there is no equal function in the JVM. Null where a text is null, without work; see :func:`similar`."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([None if p is None or q is None else round(SequenceMatcher(None, p, q).ratio(), 6) for p, q in zip(x, y, strict=True)])

    return ratio(a, b)


#: Line ends of a text: carriage return and line feed are one.
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
CONTEXT = 3


def lines(text: Column) -> Column:
    """A text's lines without their ends; a last line end begins no line."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def _differ_at(a: Column, b: Column) -> Column:
    """How many items two arrays share at their start."""
    unlike = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(unlike > 0, unlike - 1).otherwise(F.size(a)).cast("int")


def _range(start: Column, length: Column) -> Column:
    """Where a side of a hunk starts and how many lines it has; an empty side names the line before."""
    return F.when(length == 1, (start + 1).cast("string")).otherwise(F.concat_ws(",", F.when(length == 0, start).otherwise(start + 1), length))


def line_diff(path: Column, old: Column, new: Column) -> Column:
    """Unified diff of one edit with three lines of context and no times.

    The lines before and after the edit are what both texts share at their start and end, so hunk bounds are line numbers and nothing is
    searched; the edit's old lines all come before its new ones. Texts with equal lines have the header alone."""
    was, now = lines(old), lines(new)
    both = F.struct(was.alias("was"), now.alias("now"), _differ_at(was, now).alias("head"))

    def tailed(t: Column) -> Column:
        was, now, head = t["was"], t["now"], t["head"]
        rest = lambda a: F.reverse(F.slice(a, head + 1, F.size(a) - head))
        tail = F.least(_differ_at(rest(was), rest(now)), F.size(was) - head, F.size(now) - head)
        return F.struct(was.alias("was"), now.alias("now"), head.alias("head"), tail.alias("tail"))

    def hunk(t: Column) -> Column:
        was, now, head, tail = t["was"], t["now"], t["head"], t["tail"]
        low, after = F.greatest(head - CONTEXT, F.lit(0)), F.least(tail, F.lit(CONTEXT))
        marked = lambda mark, a, start, n: F.transform(F.slice(a, start + 1, n), lambda x: F.concat(F.lit(mark), x))
        n_old, n_new = F.size(was) - tail - head, F.size(now) - tail - head
        header = F.concat(F.lit("@@ -"), _range(low, head - low + n_old + after), F.lit(" +"), _range(low, head - low + n_new + after), F.lit(" @@"))
        names = [F.concat(F.lit("--- a/"), path), F.concat(F.lit("+++ b/"), path)]
        body = F.concat(F.array(*names, header), marked(" ", was, low, head - low), marked("-", was, head, n_old), marked("+", now, head, n_new), marked(" ", was, head + n_old, after))
        same = (F.size(was) == F.size(now)) & (head == F.size(was))
        return F.when(same, "").otherwise(F.concat(F.array_join(body, "\n"), F.lit("\n")))

    # arrays of one element, so that lines and bounds are made once
    made = F.element_at(F.transform(F.transform(F.array(both), tailed), hunk), 1)
    return F.when(path.isNotNull() & old.isNotNull() & new.isNotNull(), F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n"), made))
