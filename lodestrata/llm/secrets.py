"""Secret scans by corpus-wide ownership frequency, in DataFrame functions only.

Every text is searched for credential-like spans. The SHA-256 of each candidate value is counted over all
documents by distinct owners and repositories: a value that many owners or many repositories share is a widely copied
example; one that stays with few of both and holds no placeholder word is a live-looking credential. Of bare hexadecimal
strings, which don't say what they are, length and variety are asked as well.

Spans are ``(kind, start, stop)`` in code points, end exclusive. Base kinds: ``assign``, ``access``, ``hex``
(whole matches, leftmost and non-overlapping per kind). Added kinds: ``provider`` (keys with a vendor's prefix)
and ``live`` (the value part of a candidate that is judged live).

Defined results: null text is empty; null owner or repository counts as one unnamed one; repeated rows are
kept and each gets its spans; an empty table gives an empty result; other columns are ignored by
:func:`scan` and kept by :func:`redact`. Ties can't change a result: spans are ordered by start, kind, stop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import offsets, packed, text_key, written

#: Kind, pattern, group that holds the value, least length of that value. Fixed values.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
PROVIDER = ("provider", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", 0, 10)
KINDS = (*BASE, PROVIDER)
NAMES = (*[k[0] for k in KINDS], "live")
#: A cheaper test that holds wherever the pattern can give a span of the least length.
PRESENT = {"hex": r"[0-9a-f]{24}", "access": r"AKIA[A-Z0-9]{16}"}
#: Words in values that are written as placeholders. Fixed values.
PLACEHOLDER = r"(?i)example|changeme|dummy|placeholder|your[_-]?|xxxx|0000000|1234567|abcdefg"

SPAN = "array<struct<start:int,kind:int,stop:int,at:int,value:string,looks:boolean>>"


def _looks_live(value: Column, name: str) -> Column:
    """Of the kinds that say what they are, every value without a placeholder word, so that ownership decides; bare hex must
    be long enough, with letters and digits and many distinct characters."""
    if name != "hex":
        return ~value.rlike(PLACEHOLDER)
    return (
        (F.length(value) >= 16) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDER)
        & (F.size(F.array_distinct(F.split(value, ""))) >= 8)
    )


def _spans(text: Column, code: int) -> Column:
    """Spans of one kind: the pieces between matches and the matches add up to positions."""
    name, pattern, group, least = KINDS[code]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)  # one more than there are matches
    starts = offsets(F.zip_with(gaps, whole, lambda g, w: F.length(g) + F.coalesce(F.length(w), F.lit(0))))
    parts = F.filter(F.arrays_zip(starts.alias("at"), gaps.alias("gap"), whole.alias("whole"), value.alias("value")), lambda p: F.length(p["value"]) >= least)

    def span(part: Column) -> Column:
        start = part["at"] + F.length(part["gap"])
        stop = start + F.length(part["whole"])
        return F.struct(
            start.alias("start"), F.lit(code).alias("kind"), stop.alias("stop"), (stop - F.length(part["value"])).alias("at"),
            F.sha2(part["value"], 256).alias("value"), _looks_live(part["value"], name).alias("looks"),
        )

    found = F.transform(parts, span)
    return F.when(text.rlike(PRESENT.get(name, pattern)), found).otherwise(F.expr(f"cast(array() as {SPAN})"))


def candidates(text: Column) -> Column:
    """All candidate spans of a text, by start, kind, stop."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*[_spans(text, i) for i in range(len(KINDS))]))


#: So many distinct owners, or repositories, make a value a widely copied example.
OWNERS, REPOS = 5, 12


def ownership(found: DataFrame, owners: int, repos: int) -> DataFrame:
    """For each candidate hash its distinct owners and repositories, and whether it is live-looking.

    ``found`` has owner, repo, spans. Copies within a repository are summed before any shuffle by hash."""
    each = found.filter(F.size("spans") > 0).select("owner", "repo", F.explode("spans").alias("s"))
    pairs = each.groupBy(F.col("s.value").alias("value"), "owner", "repo").agg(F.count("*").alias("n"), F.max("s.looks").alias("looks"))
    each_owner = pairs.groupBy("value", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"), F.max("looks").alias("looks"))
    whole = each_owner.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_uses"), F.max("looks").alias("looks"))
    wide = (F.col("n_owners") >= owners) | (F.col("n_repos") >= repos)
    return whole.withColumns({"example": wide, "live": F.col("looks") & ~wide})


def scan(docs: DataFrame, *, key: Column, text: Column, owner: Column, repo: Column, owners: int = OWNERS, repos: int = REPOS) -> DataFrame:
    """One row for each row of ``docs``: key, row, spans (candidates), live (spans of live-looking values), n_example.

    ``owners``, ``repos``: so many distinct ones make a value a widely copied example."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    found = written(
        docs.select(key.alias("key"), F.monotonically_increasing_id().alias("row"), name(owner).alias("owner"), name(repo).alias("repo"), candidates(text).alias("spans")),
        "secret-spans",
    )
    verdicts = written(ownership(found, owners, repos), "secret-owners").select("value", "live", "example")
    each = found.filter(F.size("spans") > 0).select("row", F.explode("spans").alias("s"))
    judged = (
        each.join(verdicts, F.col("s.value") == F.col("value"))
        .groupBy("row")
        .agg(
            F.array_sort(F.collect_set(F.when(F.col("live"), F.struct(F.col("s.at").alias("start"), F.lit(len(KINDS)).alias("kind"), F.col("s.stop").alias("stop"))))).alias("live"),
            F.count_if("example").alias("n_example"),
        )
    )
    none = F.expr("cast(array() as array<struct<start:int,kind:int,stop:int>>)")
    return found.join(judged, "row", "left").select("key", "row", "spans", F.coalesce("live", none).alias("live"), F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"))


def joined(spans: Column) -> Column:
    """``kind:start:stop`` of sorted spans, comma-joined."""
    kind = F.array(*[F.lit(n) for n in NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"], s["stop"])), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns from :func:`scan`'s rows."""
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    short = F.transform("spans", lambda s: F.struct(s["start"], s["kind"], s["stop"]))
    count = lambda code: F.size(F.filter("spans", lambda s: s["kind"] == code)).cast("long")
    return scanned.select(
        F.col("key").alias("doc_id"),
        count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat(short, F.col("live")))).alias("spans"),
        F.size("live").cast("long").alias("n_live"), "n_example",
    )


def redact(docs: DataFrame, *, text: str = "text", owner: Column, repo: Column, owners: int = OWNERS, repos: int = REPOS, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each live-looking value replaced by ``mark``; texts without one stay as they are.

    Ownership comes first: an assigned value of any length and alphabet that few owners have is taken for live.

    A document's verdicts depend on its text alone, so they are joined back by the text's digest, and only
    documents with a candidate are shuffled."""
    columns, body = docs.columns, F.col(f"`{text}`")
    any_kind = F.lit(False)
    for k in KINDS:
        any_kind = any_kind | F.coalesce(body, F.lit("")).rlike(PRESENT.get(k[0], k[1]))
    suspects = docs.filter(any_kind)
    live = scan(suspects, key=text_key(body), text=body, owner=owner, repo=repo, owners=owners, repos=repos)
    live = written(live.filter(F.size("live") > 0).groupBy("key").agg(F.first("live").alias("live")), "secret-live")
    held = suspects.select(packed(docs).alias("doc"), text_key(body).alias("key")).join(live, "key", "left")
    whole = F.col("doc").getField(text)

    def cut(state: Column, span: Column) -> Column:
        begin = F.greatest(state["at"], span["start"])
        more = F.array_append(F.array_append(state["parts"], F.substring(whole, state["at"] + 1, begin - state["at"])), F.lit(mark))
        return F.when(span["stop"] > state["at"], F.struct(span["stop"].alias("at"), more.alias("parts"))).otherwise(state)

    walked = F.aggregate("live", F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("parts")), cut)
    clean = F.when(F.col("live").isNull(), whole).otherwise(F.concat(F.array_join(walked["parts"], ""), F.substring(whole, walked["at"] + 1, 2147483647)))
    length = F.when(F.col("live").isNull(), F.col("doc").getField("n_chars")).otherwise(F.length(clean).cast("long")) if "n_chars" in columns else None
    fields = [(clean if c == text else length if c == "n_chars" else F.col("doc").getField(c)).alias(c) for c in columns]
    return docs.filter(~any_kind).unionByName(held.select(*fields))
