"""Prefix trie of conversations by Patricia construction.

Every turn becomes 20 bytes: the MD5 of its role and text, then its length in code points. A conversation is the chain of
its turns' bytes; equal chains are counted together before anything is sorted. Spark range-partitions the distinct chains by their bytes and sorts
them, so that chains with a common prefix are neighbours. One pass over a sorted part keeps a stack of the points on the current path and
makes only branch, end and leaf points, with the turns between them as one compressed edge; a point's aggregates are complete when it leaves
the stack, and the unary nodes of its edge follow from it by suffix sums over the edge's lengths.

A prefix can go on from one part to the next: those nodes, the prefixes that a part's first or last chain shares with its neighbour, get a
partial row from each part. All aggregates are sums and minima over parts (a turn's own length and a child count where the node begins), so
partial rows of one prefix are added up; all other nodes are final. A shared prefix of any size costs one row a part.

Defined results: null roles and texts are empty; turns are ordered by number, nulls first, equal numbers by the MD5 of role and text;
repeated rows are turns of their own; rows with a null id take no part; an empty table has no nodes, not even a root. A
conversation's turns, without their texts, and what a part of the sorted chains holds open must fit in a task."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import Scratch

#: Bytes of a turn, of which the last four are its length in code points.
TURN = 20
EMPTY = hashlib.sha256(b"").hexdigest()
#: Ids of a group of equal chains that are joined to one piece.
PIECE = 65_536

NODES = "part int, spine boolean, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key binary, up binary"


def chains(turns: DataFrame, *, conv: Column, turn: Column, role: Column, text: Column) -> DataFrame:
    """conv_id and its turns in order, each as the hexadecimal form of its 20 bytes. Texts stay where they are."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    item = F.concat(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")), F.lpad(F.hex(F.length(text).cast("long")), 8, "0"))
    rows = turns.select(conv.cast("long").alias("conv_id"), F.struct(turn.isNotNull().alias("known"), turn.alias("turn"), item.alias("item")).alias("t")).filter("conv_id is not null")
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["item"]).alias("items"))


def joined(own: DataFrame, base: Column, taken: Column, most: int) -> DataFrame:
    """Each conversation with the first ``taken`` (``most`` at most) turns of conversation ``base``, then its own after as many: conv_id, chain."""
    own = own.withColumn("base", base)
    heads = own.filter(F.col("conv_id") == F.col("base")).select("base", F.slice("items", 1, most).alias("head"))
    first = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), taken)
    rest = F.slice("items", taken + 1, F.greatest(F.size("items") - taken, F.lit(0)))
    return own.join(heads, "base", "left").select("conv_id", F.unhex(F.array_join(F.concat(first, rest), "")).alias("chain"))


def _by_key(batches: Iterator[pa.RecordBatch], start: Callable, add: Callable, end: Callable) -> Iterator[tuple]:
    """Folds sorted rows of equal first columns, across batches; a fold is one state at a time."""
    key, state = None, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != key:
                if key is not None:
                    yield from end(key, state)
                key, state = row[0], start()
            yield from add(key, state, row)
    if key is not None:
        yield from end(key, state)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def ends(members: DataFrame) -> DataFrame:
    """id and the SHA-256 of its ascending decimal conv_ids, comma-joined. Ids of a group of any size are sorted by range partitions
    and joined to pieces there; only the digest itself, which can't be split, reads a group's pieces one after the other."""
    kind = pa.schema([("id", pa.binary()), ("first", pa.int64()), ("piece", pa.string())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(key: bytes, state: list) -> list[tuple]:
            out = [(key, state[0], ",".join(map(str, state)))] if state else []
            state.clear()
            return out

        def add(key: bytes, state: list, row: tuple) -> list[tuple]:
            state.append(row[1])
            return flush(key, state) if len(state) == PIECE else []

        yield from _batched(_by_key(batches, list, add, flush), kind, 64)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def add(key: bytes, state: list, row: tuple) -> tuple:
            if state:
                state[0].update(b"," + row[2].encode())
            else:
                state.append(hashlib.sha256(row[2].encode()))
            return ()

        yield from _batched(_by_key(batches, list, add, lambda key, state: [(key, state[0].hexdigest())]), pa.schema([("id", pa.binary()), ("ends", pa.string())]))

    cut = members.repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id").mapInArrow(pieces, "id binary, first long, piece string")
    return cut.repartition("id").sortWithinPartitions("id", "first").mapInArrow(digests, "id binary, ends string")


def shared(a: bytes, b: bytes) -> int:
    """Turns that two chains have in common at their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // TURN
    return int(np.argmin(np.frombuffer(a, np.uint8, n) == np.frombuffer(b, np.uint8, n))) // TURN


def _lengths(chain: bytes) -> np.ndarray:
    return np.frombuffer(chain, np.uint8).reshape(-1, TURN)[:, TURN - 4 :].copy().view(">u4").ravel().astype(np.int64)


class _Point:
    """A branch, end or leaf of the compressed tree: what is known so far of all below it. ``waiting``: rows of children whose parent's
    smallest member isn't known yet."""

    __slots__ = ("depth", "first", "n", "conv", "children", "leaves", "saved", "ends", "childless", "waiting")

    def __init__(self, depth: int, first: bool) -> None:
        self.depth, self.first = depth, first
        self.n, self.conv, self.children, self.leaves, self.saved, self.ends, self.childless, self.waiting = 0, None, 0, 0, 0, None, True, []


class Part:
    """The compressed tree of one sorted part. ``before``, ``after``: turns shared with the chains next to the part, -1 if there is none."""

    def __init__(self, number: int, before: int, after: int) -> None:
        self.number, self.before, self.after = number, before, after
        self.stack = [_Point(0, True)]
        self.chain, self.lengths, self.done = None, np.zeros(0, np.int64), False

    def add(self, chain: bytes, n: int, conv: int, ends: str) -> Iterator[list]:
        first = self.chain is None
        if not first:
            yield from self._leave(shared(self.chain, chain))
        depth = len(chain) // TURN
        if depth > self.stack[-1].depth:
            self.stack.append(_Point(depth, first))
        top = self.stack[-1]
        top.n, top.conv, top.ends = top.n + n, conv if top.conv is None else min(top.conv, conv), ends
        self.chain, self.lengths = chain, _lengths(chain)

    def finish(self) -> Iterator[list]:
        self.done = True
        yield from self._leave(0)
        yield from self._rows(self.stack.pop(), -1, None)

    def _leave(self, keep: int) -> Iterator[list]:
        """Points deeper than ``keep`` turns are complete; a branch is made there if there is no point."""
        while self.stack[-1].depth > keep:
            point = self.stack.pop()
            if self.stack[-1].depth < keep:
                self.stack.append(_Point(keep, point.first))
            yield from self._rows(point, self.stack[-1].depth, self.stack[-1])

    def _spine(self, depth: int, first: bool) -> bool:
        return first and depth <= self.before or self.done and depth <= self.after or not depth

    def _starts(self, depth: int, first: bool) -> bool:
        return not (first and depth <= self.before)

    def _key(self, depth: int) -> bytes:
        return hashlib.md5(self.chain[: TURN * depth]).digest()

    def _rows(self, point: _Point, above: int, parent: _Point | None) -> Iterator[list]:
        """The nodes of a complete point's edge, all but the uppermost, which waits for its parent, and the point's children that have waited."""
        leaf = point.childless and not (self.done and point.depth <= self.after)
        leaves = point.leaves + leaf
        low = max(above, 0)
        own = self.lengths[low : point.depth] if above >= 0 else np.zeros(1, np.int64)
        depths = range(above + 1, point.depth + 1)
        begun = np.array([self._starts(d, point.first) for d in depths])
        saved = point.saved + np.cumsum((own * (point.n - begun))[::-1])[::-1]
        rows = []
        for d, total in zip(depths, saved.tolist(), strict=True):
            spine, last = self._spine(d, point.first), d == point.depth
            children = point.children if last else int(self._starts(d + 1, point.first))
            rows.append([self.number, spine, d, point.conv, point.conv, point.n, children, leaves, total, point.ends if last else None, self._key(d) if spine else None, None])
        for row, upper in zip(rows[1:], rows, strict=False):
            row[11] = upper[10]
        for row in point.waiting:
            row[4], row[11] = point.conv, rows[-1][10]
            yield row
        yield from rows[1:]
        if parent is None:
            rows[0][4] = None
            yield rows[0]
            return
        parent.waiting.append(rows[0])
        parent.childless = False
        parent.n, parent.conv = parent.n + point.n, point.conv if parent.conv is None else min(parent.conv, point.conv)
        parent.children, parent.leaves, parent.saved = parent.children + int(self._starts(above + 1, point.first)), parent.leaves + leaves, parent.saved + int(saved[0])


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of part, before, after, chain, n, conv_id, ends to nodes."""

    def rows() -> Iterator[tuple]:
        part = None
        for batch in batches:
            for number, before, after, chain, n, conv, ends_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part is None or part.number != number:
                    if part is not None:
                        yield from part.finish()
                    part = Part(number, before, after)
                yield from part.add(chain, n, conv, ends_)
        if part is not None:
            yield from part.finish()

    kinds = {"int": pa.int32(), "boolean": pa.bool_(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[t]) for n, t in (f.split(" ") for f in NODES.split(", "))])
    yield from _batched(map(tuple, rows()), schema)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId()
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([number] * batch.num_rows, pa.int32()), *batch.columns], ["part", *batch.schema.names])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        part, first, last, before, after = (c.to_pylist() for c in batch.columns)
        lead = [-1 if b is None else shared(b, f) for b, f in zip(before, first, strict=True)]
        tail = [-1 if a is None else shared(l, a) for a, l in zip(after, last, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(lead, pa.int64()), pa.array(tail, pa.int64())], ["part", "before", "after"])


def nodes(members: DataFrame) -> DataFrame:
    """Nodes of the trie of ``members`` (conv_id, chain), written to the shared folder."""
    tables = Scratch()
    held = tables.written(members.select("conv_id", "chain", F.unhex(F.md5("chain")).alias("id")), "trie-chains")
    distinct = held.groupBy("chain").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")).withColumn("id", F.unhex(F.md5("chain")))
    distinct = distinct.join(ends(held.select("id", "conv_id")), "id").select("chain", "n", "conv_id", "ends")
    ordered = distinct.repartitionByRange("chain").sortWithinPartitions("chain").mapInArrow(_numbered, "part int, chain binary, n long, conv_id long, ends string")
    ordered = tables.written(ordered, "trie-sorted")

    edges = ordered.groupBy("part").agg(F.min("chain").alias("first"), F.max("chain").alias("last"))
    by_part = Window.orderBy("part")  # a row for each part
    edges = edges.select("part", "first", "last", F.lag("last").over(by_part).alias("b"), F.lead("first").over(by_part).alias("a"))
    edges = tables.written(edges.mapInArrow(_compared, "part int, before long, after long"), "trie-edges")
    count = max(1, edges.count())
    rows = ordered.join(F.broadcast(edges), "part")  # three numbers for each part, of which there are as many as shuffle partitions
    sorted_ = rows.select("part", "before", "after", "chain", "n", "conv_id", "ends").repartition(count, "part").sortWithinPartitions("part", "chain")
    local = tables.written(sorted_.mapInArrow(_built, NODES), "trie-local")

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    split = local.filter("spine").groupBy("key").agg(F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256"), F.max("up").alias("up"))
    split = tables.written(split, "trie-spine")
    above = split.select(F.col("key").alias("up"), F.col("conv_id").alias("above"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")]
    inner = local.filter("not spine and up is null").select(*columns)
    # children of nodes that several parts share: by part, so that no shared node's children meet
    shared_by = local.filter("spine").select("part", F.col("key").alias("up")).join(above, "up")
    below = local.filter("not spine and up is not null").join(shared_by, ["part", "up"]).withColumn("parent_conv_id", F.col("above")).select(*columns)
    whole = split.join(above, "up", "left").withColumn("parent_conv_id", F.col("above")).select(*columns)
    out = Scratch().written(inner.unionByName(below).unionByName(whole), "trie")
    tables.drop()
    return out


def build(turns: DataFrame, *, conv: Column, turn: Column, role: Column, text: Column, base: Callable[[Column], Column], taken: Callable[[Column], Column], most: int) -> DataFrame:
    """Trie of conversations that begin with the first ``taken`` turns of another one."""
    c = F.col("conv_id")
    return nodes(joined(chains(turns, conv=conv, turn=turn, role=role, text=text), base(c), taken(c), most))
