"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits share at least 5 of their 8 positional bytes. Any 5 positions
hold 3 of the first four or 3 of the last four, so posting lists are kept by (3 positions, their 3 bytes), 8 lists for
each fingerprint: each pair that can reach 5 shared bytes meets in one of them, and a list is 65,536 times shorter
than one by a single byte. In each list the shared positional bytes of a pair are tallied, pairs that reach 5 are
kept and verified by their differing bits.

Equal fingerprints are one entry. Links are not written as all pairs: each worker reduces what it finds to the links
of a spanning forest, which has the same components. Lists of over ``block`` fingerprints are split into blocks, and
pairs of blocks are compared by different workers.

Defined results: null text is empty; a text without words has fingerprint zero; null ids are the largest when a
component's smallest id is taken, and a component of null ids alone has none; repeated rows are kept by :func:`near`
and share a fingerprint; an empty table gives an empty result; other columns are ignored by :func:`near` and kept
by :func:`first_of_each`."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import HOT, labelled_by, packed, unpacked, written
from lodestrata.llm.graph import Forest, components

WORDS = 3
SEED = 42
BITS = 3
#: Positional bytes that a pair within BITS differing bits shares at least.
SHARED = 8 - BITS
BLOCK = 1024
#: Every 5 of the 8 positions contain one of these.
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
#: Shingles whose bits are counted at a time.
STEP = 1 << 15


def fingerprint(text: str | None) -> int:
    """64-bit SimHash, as a signed number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    edge = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(edge + 1).tolist()], [*edge.tolist(), len(joined)]
    n = max(1, len(words) - WORDS + 1)
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts[:n], ends[min(WORDS, len(words)) - 1 :], strict=True)], np.uint64).view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, STEP):
        counts += np.unpackbits(hashes[i : i + STEP], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, *, key: Column, text: Column) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([fingerprint(t) for t in part.column(1).to_pylist()], pa.int64())], ["key", "fp"])

    return docs.select(key.alias("key"), text.cast("string").alias("text")).mapInArrow(run, f"key {docs.select(key).schema[0].dataType.simpleString()}, fp long")


def linked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Tally shared positional bytes, keep pairs that reach SHARED, verify those by differing bits."""
    differ = np.bitwise_xor(x, y)
    out = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(1, dtype=np.uint8) >= SHARED
    out[out] = np.bitwise_count(differ[out].view(np.uint64)) <= BITS
    return out


def _small(fps: np.ndarray, group: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Links within runs of equal group, all runs at once, by rising distance."""
    for d in range(1, most):
        at = np.flatnonzero(group[d:] == group[:-d])
        if not len(at):
            break
        at = at[linked(fps[at], fps[at + d])]
        yield from zip(fps[at].tolist(), fps[at + d].tolist(), strict=True)


def _large(fps: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of one large group's links, by breadth."""
    left = np.unique(fps)
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = linked(left, np.full(len(left), x))
            if near.any():
                found = left[near]
                yield from ((int(x), y) for y in found.tolist())
                queue.extend(found)
                left = left[~near]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, fp) sorted by key and part; gives a spanning forest of this worker's links."""
    forest, held = Forest(), None

    def take(rows: np.ndarray) -> None:
        edge = np.flatnonzero(np.any(rows[1:, :2] != rows[:-1, :2], axis=1)) + 1
        starts = np.concatenate([[0], edge])
        sizes = np.diff(np.concatenate([starts, [len(rows)]]))
        group = np.repeat(np.arange(len(starts)), sizes)
        some = (sizes[group] > 1) & (sizes[group] <= 48)
        if some.any():
            forest.add(_small(rows[some, 2], group[some], 48))
        for s in np.flatnonzero(sizes > 48):
            forest.add(_large(rows[starts[s] : starts[s] + sizes[s], 2]))

    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
        rows = rows if held is None else np.concatenate([held, rows])
        if not len(rows):
            continue
        last = np.flatnonzero(np.any(rows[:, :2] != rows[-1, :2], axis=1))
        cut = last[-1] + 1 if len(last) else 0  # the last group may go on in the next batch
        if cut:
            take(rows[:cut])
        held = rows[cut:]
    if held is not None and len(held):
        take(held)
    a, b = forest.star()
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) of a graph with the components of all links between the distinct fingerprints ``fp``."""
    byte = lambda i: F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))
    keys = F.array(*[F.lit(k << 24).bitwiseOR(F.shiftleft(byte(a), 16)).bitwiseOR(F.shiftleft(byte(b), 8)).bitwiseOR(byte(c)) for k, (a, b, c) in enumerate(TRIPLES)])
    postings = distinct.select(F.explode(keys).alias("key"), "fp")
    long = written(postings.groupBy("key").count().filter(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("long").alias("blocks")), "long-lists")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = (
        postings.join(long, "key", "left")
        .select("key", "fp", own.alias("own"), other.alias("other"))
        .select("key", F.coalesce(F.shiftleft(F.least("own", "other"), 32) + F.greatest("own", "other"), F.lit(0)).alias("part"), "fp")
    )
    return dealt.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_links, "a long, b long")


def labelled(prints: DataFrame) -> DataFrame:
    """(fp, component, n) for the fingerprints of ``prints`` (key, fp): the smallest key reachable, and how many rows have it."""
    each = written(prints.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("n")), "fingerprints")
    roots = components(links(each))
    rooted = written(each.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component")), "least")
    return written(rooted.join(least, "root").select("fp", "component", "n"), "components")


def near(docs: DataFrame, *, key: Column, text: Column, hot: int = HOT) -> DataFrame:
    """key, fp (signed) and component of every row."""
    prints = written(fingerprints(docs, key=key, text=text), "simhash")
    return labelled_by(prints, labelled(prints), "fp", "n", hot).select("key", "fp", "component")


def first_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the smallest id stays (of rows with equal ids, one)."""
    columns, schema = docs.columns, docs.schema
    row = docs.select(F.col(f"`{key}`").alias("key"), packed(docs).alias("doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                fps = [fingerprint(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fps, pa.int64())], ["key", "doc", "fp"])

    made = row.select("key", "doc", F.col("doc").getField(text).cast("string").alias("text")).mapInArrow(
        run, f"key {schema[key].dataType.simpleString()}, doc {row.schema['doc'].dataType.simpleString()}, fp long"
    )
    held = written(made.withColumn("row", F.monotonically_increasing_id()), "simhash-docs")
    prints = held.select("key", "fp", "row")
    component = labelled(prints)
    order = F.struct(F.col("key").isNull().alias("none"), "key", "row")
    firsts = written(labelled_by(prints, component, "fp", "n").withColumn("group", F.coalesce(F.col("component").cast("string"), F.col("fp").cast("string"))).groupBy("group", F.col("component").isNull()).agg(F.min(order)["row"].alias("row")).select("row"), "firsts")
    # the same join at every size: the rows to keep grow with the documents, so they are never broadcast
    return unpacked(held.join(firsts.hint("merge"), "row", "left_semi"), "doc", columns)
