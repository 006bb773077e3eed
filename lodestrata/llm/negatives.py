"""Hard negatives by dual-tree search over anchors and candidates.

Components become whole numbers, so inner products are exact. A tree of splits is fitted on a bounded sample (it changes the work, not
the result); every row falls into one of its cells, a cell's rows are dealt over blocks by their hash, and each block is ordered by label and then
halved along its widest component down to leaves. Anchors have a tree of their own, whose cells are fewer by as much as anchors are.

A task takes one block of anchors and meets a share of the candidates, block by block, in tree order. A leaf is a
centre and a radius, so the inner products of an anchor leaf with a candidate leaf lie within

    <a, c> - |a| rc - |c| ra - ra rc  ..  <a, c> + |a| rc + |c| ra + ra rc

and a pair of leaves whose interval can't reach what the anchors of the leaf still need, or whose labels can't fit, is pruned whole; the rest is
scored exactly. The same interval between whole cells prunes candidates before they are sent to a block of anchors. There are two
searches: the ``n_positives`` best rows of an anchor's own label; then, in each positive's window of scores, the ``n_negatives`` best rows of
other labels. Each task keeps only its best few for each anchor, and those are merged by anchor.

Every candidate meets ``anchors / BLOCK_ANCHORS`` blocks at most: a stated query set against all rows, in blocks. No result is lost at any size.

Defined results: rows with a null label, a null vector or a null, infinite or NaN component take no part; a vector that is shorter than
another has zeros; null ids come after all others and are no anchors; rows of equal ids are rows of their own; equal scores go by the smaller id.
Whole components are held within 63 bits and products are taken modulo 2^64, so scores that don't fit 63 bits are not meaningful."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import Scratch

#: Rows that the tree is fitted on, and the depth of its splits at most.
SAMPLE = 8192
DEPTH = 6
#: Rows of a candidate block and of an anchor block, rows of a leaf, and shares of the candidates that one anchor block meets.
BLOCK = 1024
BLOCK_ANCHORS = 8192
LEAF = 32
SHARES = 24
#: Anchor leaves that are compared with candidate leaves at once.
STRIP = 256
NO_ID = (1 << 63) - 1

ROW = "row long, id long, label long, anchor boolean, q binary"


@dataclass(frozen=True)
class Want:
    """How many positives and negatives, and the window of negative scores in hundredths of the positive's."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors to whole components: floor(256 x). Rows without a usable vector go."""
    for batch in batches:
        column = batch.column(4)
        flat = np.asarray(column.flatten().fill_null(np.nan), np.float64)
        lengths = np.asarray(pc.list_value_length(column).fill_null(0), np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
        good = bad[starts + lengths] == bad[starts]
        whole = np.floor(256 * np.where(np.isfinite(flat), flat, 0)).clip(-(2.0**63), 2.0**63 - 1024).astype("<i8")
        packed = [whole[s : s + n].tobytes() for s, n in zip(starts, lengths, strict=True)]
        kept = pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(packed, pa.binary())], ["row", "id", "label", "anchor", "q"])
        yield kept.filter(pa.array(good))


def _matrix(vectors: list[bytes], width: int = 0) -> np.ndarray:
    """Whole vectors as rows; shorter ones are filled with zeros."""
    lengths = np.array([len(v) // 8 for v in vectors], np.int64)
    width = max(width, int(lengths.max(initial=1)), 1)
    flat = np.frombuffer(b"".join(vectors), "<i8")
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(vectors), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows as whole numbers: in double precision where that is exact."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x for x in (a, b))
    largest = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (a, b)]
    if largest[0] * largest[1] * width < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


class Cells:
    """Splits (component, value) of a binary tree fitted on a sample, by heap number; a node's children are 2 i + 1 and 2 i + 2."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.depth = depth
        self.at = np.zeros((1 << depth) - 1, np.int64)
        self.value = np.zeros((1 << depth) - 1)
        self.width = sample.shape[1]
        held = {0: sample.astype(np.float64)}
        for node in range((1 << depth) - 1):
            rows = held.pop(node)
            if len(rows):
                self.at[node] = int(np.argmax(rows.max(0) - rows.min(0)))
                self.value[node] = float(np.median(rows[:, self.at[node]]))
            right = rows[:, self.at[node]] > self.value[node]
            held[2 * node + 1], held[2 * node + 2] = rows[~right], rows[right]
        self.centres = np.stack([rows.mean(0) if len(rows) else np.zeros(self.width) for _, rows in sorted(held.items())])

    def of(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of each row, in order from left to right; its first bits are its ancestors."""
        node = np.zeros(len(rows), np.int64)
        for _ in range(self.depth):
            at = self.at[node]
            right = rows[np.arange(len(rows)), at] > self.value[node]
            node = 2 * node + 1 + right
        return node - ((1 << self.depth) - 1)


def leaves(q: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of a block's rows in tree order and the leaf of each: by label first, then halves along the widest component."""
    order, number, out = [], [], 0
    by = np.argsort(label, kind="stable")
    stack = np.split(by, np.flatnonzero(np.diff(label[by])) + 1)[::-1]
    while stack:
        part = stack.pop()
        if len(part) > LEAF:
            rows = q[part]
            values = rows[:, int(np.argmax(rows.max(0).astype(np.float64) - rows.min(0)))]
            half = np.argsort(values, kind="stable")
            stack += [part[half[len(half) // 2 :]], part[half[: len(half) // 2]]]
        else:
            order.append(part)
            number.append(np.full(len(part), out))
            out += 1
    return (np.concatenate(order), np.concatenate(number)) if order else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def spheres(q: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, radius and the centre's length of consecutive groups of rows."""
    x = q.astype(np.float64)
    sizes = np.diff(np.append(starts, len(x)))
    centres = np.add.reduceat(x, starts) / sizes[:, None]
    away = np.sqrt(((x - np.repeat(centres, sizes, axis=0)) ** 2).sum(1))
    return centres, np.maximum.reduceat(away, starts), np.sqrt((centres**2).sum(1))


def intervals(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of any row of each sphere of ``a`` with any row of each of ``b``, with room for rounding."""
    width = max(a[0].shape[1], b[0].shape[1])
    one, two = (np.pad(x[0], ((0, 0), (0, width - x[0].shape[1]))) for x in (a, b))
    middle = one @ two.T
    reach = a[2][:, None] * b[1] + a[1][:, None] * b[2] + a[1][:, None] * b[1]
    room = 1 + 1e-9 * (np.abs(middle) + reach)
    return middle - reach - room, middle + reach + room


class Best:
    """The best few candidates of each (anchor, window), as flat arrays: slot, score, id, row."""

    def __init__(self, slots: int, most: int, low: np.ndarray, high: np.ndarray) -> None:
        self.most, self.low, self.high = most, low.copy(), high
        self.slot, self.score, self.id, self.row = (np.zeros(0, np.int64) for _ in range(4))
        self.slots = slots

    def add(self, slot: np.ndarray, score: np.ndarray, id_: np.ndarray, row: np.ndarray) -> None:
        """Merge; where a slot is full, its least score becomes what it still needs."""
        slot, score, id_, row = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, id_), (self.row, row)))
        order = np.lexsort((row, id_, -score, slot))
        slot = slot[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        order = order[place < self.most]
        full = slot[place == self.most - 1]
        self.slot, self.score, self.id, self.row = slot[place < self.most], score[order], id_[order], row[order]
        last = np.searchsorted(self.slot, full, "right") - 1
        self.low[full] = np.maximum(self.low[full], self.score[last])


class Anchors:
    """A block of anchors in leaves, and what each still needs. ``windows``: lowest and highest score of each anchor's windows; positives
    have one window without bounds."""

    def __init__(self, rows: list[tuple], same: bool, most: int) -> None:
        self.same = same
        self.row, self.label = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        self.q = _matrix([r[2] for r in rows])
        order, leaf = leaves(self.q, self.label)
        self.row, self.label, self.q = self.row[order], self.label[order], self.q[order]
        self.starts = np.searchsorted(leaf, np.arange(leaf[-1] + 1))
        self.ends = np.append(self.starts[1:], len(leaf))
        self.sphere = spheres(self.q, self.starts)
        windows = [rows[i][3] for i in order]
        self.per = max(1, max(map(len, windows)))
        low, high = np.full((len(rows), self.per), NO_ID), np.full((len(rows), self.per), -NO_ID)
        for i, each in enumerate(windows):
            for j, (a, b) in enumerate(each):
                low[i, j], high[i, j] = a, b
        self.best = Best(low.size, most, low.ravel(), high.ravel())
        self.scored = self.pruned = 0

    def meet(self, q: np.ndarray, id_: np.ndarray, row: np.ndarray, label: np.ndarray, starts: np.ndarray) -> None:
        """Candidates in tree order, their leaves from ``starts``. Leaf pairs are pruned by interval and label, the rest is scored."""
        theirs = spheres(q, starts)
        sizes = np.diff(np.append(starts, len(q)))
        first, last = label[starts], np.maximum.reduceat(label, starts)
        for i, (a, b) in enumerate(zip(self.starts, self.ends, strict=True)):
            if i % STRIP == 0:
                low, high = intervals(tuple(x[i : i + STRIP] for x in self.sphere), theirs)
            needs = self.best.low.reshape(-1, self.per)[a:b].min(), self.best.high.reshape(-1, self.per)[a:b].max()
            mine = self.label[a]  # a leaf has one label
            fits = (first <= mine) & (mine <= last) if self.same else ~((first == mine) & (last == mine))
            open_ = np.flatnonzero(fits & (high[i % STRIP] >= needs[0]) & (low[i % STRIP] <= needs[1]))
            self.pruned += len(starts) - len(open_)
            if len(open_):
                chosen = np.concatenate([np.arange(starts[j], starts[j] + sizes[j]) for j in open_])
                self._score(a, b, q[chosen], id_[chosen], row[chosen], label[chosen] == mine)

    def _score(self, a: int, b: int, q: np.ndarray, id_: np.ndarray, row: np.ndarray, same: np.ndarray) -> None:
        scores = products(self.q[a:b], q)
        self.scored += scores.size
        fits = (same if self.same else ~same) & (row != self.row[a:b, None])
        lows, highs = (x.reshape(-1, self.per)[a:b] for x in (self.best.low, self.best.high))
        found = []
        for j in range(self.per):
            inside = fits & (scores >= lows[:, j, None]) & (scores <= highs[:, j, None])
            if inside.sum() > 4 * self.best.most * (b - a):  # the best few first, with all that equal the last of them
                held = np.where(inside, scores, -NO_ID)
                least = np.partition(held, held.shape[1] - min(self.best.most, held.shape[1]), axis=1)[:, -min(self.best.most, held.shape[1])]
                inside &= scores >= least[:, None]
            i, c = np.nonzero(inside)
            found.append(((a + i) * self.per + j, scores[i, c], id_[c], row[c]))
        self.best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def result(self) -> pa.RecordBatch:
        b = self.best
        columns = [self.row[b.slot // self.per], b.slot % self.per, b.score, b.id, b.row]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, ("i8", "i4", "i8", "i8", "i8"), strict=True)], ["a", "window", "score", "id", "row"])


def _search(same: bool, most: int) -> Callable:
    """Sorted rows of block, share, kind (0: anchor, 1: candidate), cell, leaf, row, id, label, q, windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, anchors = None, [], None
        for batch in batches:
            block, share, kind, cell, leaf, row, id_, label, q, windows = (c.to_pylist() for c in batch.columns)
            keys = list(zip(block, share, strict=True))
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at] and kind[end] == kind[at]:
                    end += 1
                if keys[at] != key:
                    if anchors:
                        yield anchors.result()
                    key, held, anchors = keys[at], [], None
                if kind[at] == 0:
                    held += [(row[i], label[i], q[i], [(w["low"], w["high"]) for w in windows[i]]) for i in range(at, end)]
                elif held or anchors:
                    anchors = anchors or Anchors(held, same, most)
                    held = []
                    of = np.array(list(zip(cell[at:end], leaf[at:end], strict=True)), np.int64)
                    starts = np.concatenate([[0], np.flatnonzero((np.diff(of, axis=0) != 0).any(1)) + 1])
                    anchors.meet(_matrix(q[at:end]), *(np.array(x[at:end], np.int64) for x in (id_, row, label)), starts)
                at = end
        if anchors:
            yield anchors.result()

    return run


def _reach(cells: Cells, sizes: dict[int, int], away: dict[int, float], above: int) -> tuple[list[int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Spheres of the cells that have rows, or of their ancestors ``above`` levels up."""
    names = sorted(sizes)
    centres, radii = [], []
    for c in names:
        below = [x for x in sorted(away) if x >> above == c]
        centre = cells.centres[below].mean(0)
        centres.append(centre)
        radii.append(max(float(np.sqrt(((cells.centres[x] - centre) ** 2).sum())) + away[x] for x in below))
    centre = np.stack(centres)
    return names, (centre, np.array(radii), np.sqrt((centre**2).sum(1)))


class _Blocks:
    """Rows of cells in blocks of about ``size``, each in tree order. Blocks of a cell have consecutive numbers."""

    def __init__(self, rows: DataFrame, size: int, tables: Scratch, name: str) -> None:
        held = {r.cell: (-(-r.n // size), r.away) for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect()}  # 2^DEPTH cells at most
        self.sizes, self.away = {c: n for c, (n, _) in held.items()}, {c: x for c, (_, x) in held.items()}
        self.first, at = {}, 0
        for c in sorted(self.sizes):
            self.first[c], at = at, at + self.sizes[c]
        of = F.lit(0).cast("long")
        for c, n in self.sizes.items():
            of = F.when(F.col("cell") == c, F.lit(self.first[c]) + F.pmod(F.xxhash64("row"), F.lit(n))).otherwise(of)

        def tree(table: pa.Table) -> pa.Table:
            order, leaf = leaves(_matrix(table["q"].to_pylist()), np.asarray(table["label"], np.int64))
            return table.take(pa.array(order)).append_column("leaf", pa.array(leaf.astype(np.int32)))

        self.rows = tables.written(rows.withColumn("block", of).groupBy("block").applyInArrow(tree, ROW + ", cell int, away double, block long, leaf int"), name)


def mine(vectors: DataFrame, *, key: Column, label: Column, vector: Column, anchor: Column, want: Want = Want()) -> DataFrame:  # noqa: B008
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, written to the shared folder."""
    tables, spark = Scratch(), vectors.sparkSession
    ids = [key.cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), vector.cast("array<double>").alias("v")]
    given = vectors.select(F.monotonically_increasing_id().alias("row"), *ids).filter("label is not null and v is not null")
    rows = tables.written(given.withColumn("id", F.coalesce("id", F.lit(NO_ID))).select("row", "id", "label", "anchor", "v").mapInArrow(_whole, ROW), "negatives-rows")
    counts = rows.agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors")).first()
    depth = min(DEPTH, (counts.n // BLOCK).bit_length())
    above = depth - min(depth, (counts.anchors // BLOCK_ANCHORS).bit_length())
    sample = [bytes(r.q) for r in rows.select("q").orderBy(F.xxhash64("row"), "row").limit(SAMPLE).collect()]  # SAMPLE rows
    cells = Cells(_matrix(sample) if sample else np.zeros((1, 1), np.int64), depth)
    held = spark.sparkContext.broadcast(cells)  # 2^DEPTH splits and centres

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q = _matrix(batch.column(4).to_pylist(), held.value.width)
                cell = held.value.of(q)
                centre = np.pad(held.value.centres, ((0, 0), (0, q.shape[1] - held.value.width)))[cell]
                yield batch.append_column("cell", pa.array(cell.astype(np.int32))).append_column("away", pa.array(np.sqrt(((q - centre) ** 2).sum(1)) * (1 + 1e-9)))

    placed = rows.mapInArrow(celled, ROW + ", cell int, away double")
    candidates = _Blocks(placed, BLOCK, tables, "negatives-candidates")
    coarse = placed.filter("anchor").withColumn("cell", F.shiftright("cell", above))
    anchors = _Blocks(coarse, BLOCK_ANCHORS, tables, "negatives-anchors")
    if not counts.n or not counts.anchors:
        tables.drop()
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    names, spheres_ = _reach(cells, candidates.sizes, candidates.away, 0)
    anchor_names, anchor_spheres = _reach(cells, anchors.sizes, {c: x for c, x in candidates.away.items() if c >> above in anchors.sizes}, above)
    low, high = intervals(anchor_spheres, spheres_)

    def found(asking: DataFrame, same: bool, most: int, name: str) -> DataFrame:
        """a (the anchor's row), window, score, id, row, place of the best of each window, over all shares. ``asking``: anchors with their windows."""
        lowest, highest = F.min(F.array_min(F.transform("windows", lambda w: w["low"]))), F.max(F.array_max(F.transform("windows", lambda w: w["high"])))
        needs = {r.cell: (r.low, r.high) for r in asking.groupBy("cell").agg(lowest.alias("low"), highest.alias("high")).collect()}  # 2^DEPTH cells at most
        meets = []
        for j, c in enumerate(names):
            open_ = [x for i, x in enumerate(anchor_names) if x in needs and high[i, j] >= needs[x][0] and low[i, j] <= needs[x][1]]
            ranges = [F.struct(F.lit(anchors.first[x]).cast("long").alias("first"), F.lit(anchors.first[x] + anchors.sizes[x] - 1).cast("long").alias("last")) for x in open_]
            meets += [F.lit(c), F.array(*ranges) if ranges else F.array().cast("array<struct<first:bigint,last:bigint>>")]
        asked = F.flatten(F.transform(F.create_map(*meets)[F.col("cell")], lambda r: F.sequence(r["first"], r["last"])))
        left = asking.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))).alias("share"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("of"), "leaf", "row", "id", "label", "q", "windows")
        share = F.pmod(F.col("block") * 7 + F.col("leaf"), F.lit(SHARES)).cast("long").alias("share")
        none = F.array().cast("array<struct<low:bigint,high:bigint>>").alias("windows")
        right = candidates.rows.select(F.explode(asked).alias("to"), share, F.lit(1).alias("kind"), F.col("block").alias("of"), "leaf", "row", "id", "label", "q", none).withColumnRenamed("to", "block")
        stream = left.unionByName(right).repartition("block", "share").sortWithinPartitions("block", "share", "kind", "of", "leaf")
        best = stream.mapInArrow(_search(same, most), "a long, window int, score long, id long, row long")
        place = F.row_number().over(Window.partitionBy("a", "window").orderBy(F.desc("score"), "id", "row"))  # SHARES * most rows at most
        return tables.written(best.withColumn("place", place).filter(F.col("place") <= most), name)

    all_ = F.array(F.struct(F.lit(-NO_ID).alias("low"), F.lit(NO_ID).alias("high")))
    positives = found(anchors.rows.withColumn("windows", all_), True, want.positives, "negatives-positives")
    rest = F.pmod("score", F.lit(100))
    hundreds = F.expr("(score - pmod(score, 100)) div 100")
    window = F.struct((hundreds * want.low + F.ceil(rest * want.low / 100)).alias("low"), (hundreds * want.high + F.floor(rest * want.high / 100)).alias("high"))
    windows = positives.groupBy("a").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", window.alias("w")))), lambda x: x["w"]).alias("windows"))  # want.positives of each
    asking = tables.written(anchors.rows.join(windows.withColumnRenamed("a", "row"), "row"), "negatives-windows")
    negatives = found(asking, False, want.negatives, "negatives-found")
    named = positives.select("a", (F.col("place") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = negatives.select("a", "window", F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["a", "window"])
    out = out.join(anchors.rows.select(F.col("row").alias("a"), F.col("id").alias("anchor_id")), "a")
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    out = Scratch().written(out.select("anchor_id", known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score"), "negatives")
    tables.drop()
    return out
