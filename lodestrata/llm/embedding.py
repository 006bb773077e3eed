"""Embedding near-duplicates by spherical-cap filters.

Filter directions form random product codes: in each of several random rotations, a direction joins one codeword for
the first half of the components with one for the second half, so ``K * K`` directions need ``2 * K`` codewords. A unit
vector is list-decoded to all directions whose inner product with it reaches ``alpha``: codewords of one half are
kept if the best of the other half can still lift them to ``alpha``. ``K`` grows with the root of the number of
vectors, so a filter's share of unrelated vectors doesn't. Vectors meet on common filters and pairs are
verified by cosine in double precision, so no link below the threshold is reported. ``alpha`` is calibrated on drawn
pairs at exactly the threshold, the hardest ones, to the wanted recall (0.99; closer pairs are found more surely).

Equal vectors are one entry with a count. Very close ones form balls (a centre, a radius of at most half the
threshold's angle): all members of a ball link, and two balls whose angle and radii are together within the
threshold's angle link whole, so a large group of near copies costs its members, not its pairs. A ball stands in the
filters of all its members. Only where two balls link in part are their members compared, in blocks of ``block``.

Defined results: null or empty vectors, zero vectors and such with null or non-finite components have no links,
are their own component and kept; vectors of different lengths never link; null ids are ignored when a smallest
id is taken; repeated rows count as links of each other; an empty table gives an empty result; other columns are
ignored."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import Scratch, discard, labelled_by
from lodestrata.llm.graph import components

#: Codewords of a half, at least; more are drawn for many vectors, see ``codewords_for``.
CODEWORDS = 1024
TURNS = 8
RECALL = 0.99
BLOCK = 512
SEED = 17
#: Directions by which vectors of a lot are dealt before balls are looked for, and vectors in a lot.
HOMES = 64
LOT = 8192
#: Groups of up to so many balls are compared together, larger ones by a matrix each; the links are the same.
SMALL = 32
#: Members that make a ball worth merging with those of other lots.
MANY = 8
#: Angles (radians) nearer than this to a limit are decided by comparing members.
MARGIN = 1e-6


class Code:
    """The filters of vectors of one length: a product code for each of several rotations."""

    def __init__(self, size: int, codewords: int, turns: int) -> None:
        rng = np.random.default_rng([SEED, size, codewords, turns])
        self.size, self.codewords = size, codewords
        self.width = max(16, size + size % 2)
        self.turns = [np.linalg.qr(rng.standard_normal((self.width, self.width)))[0] for _ in range(turns)]
        half = rng.standard_normal((turns, 2, codewords, self.width // 2))
        self.half = half / np.linalg.norm(half, axis=3, keepdims=True) / np.sqrt(2)

    def _decode(self, turn: int, unit: np.ndarray, alpha: float) -> list[np.ndarray]:
        turned, middle = unit @ self.turns[turn], self.width // 2
        a, b = turned[:, :middle] @ self.half[turn, 0].T, turned[:, middle:] @ self.half[turn, 1].T
        low_a, low_b = alpha - b.max(1), alpha - a.max(1)
        out = []
        for i in range(len(unit)):
            p, q = np.flatnonzero(a[i] >= low_a[i]), np.flatnonzero(b[i] >= low_b[i])
            r, s = np.nonzero(a[i, p][:, None] + b[i, q] >= alpha)
            out.append((turn * self.codewords + p[r]) * self.codewords + q[s])
        return out

    def filters(self, unit: np.ndarray, alpha: float) -> list[np.ndarray]:
        """Sorted filter numbers of each unit vector."""
        wide = np.zeros((len(unit), self.width))
        wide[:, : self.size] = unit
        by_turn = [self._decode(t, wide, alpha) for t in range(len(self.turns))]
        return [np.sort(np.concatenate(own)) + (self.size << 40) for own in zip(*by_turn, strict=True)]

    def calibrate(self, cosine: float, recall: float, pairs: int = 200) -> float:
        """The largest alpha at which so many of the pairs drawn at ``cosine`` meet."""
        rng = np.random.default_rng([SEED, self.size, pairs])
        x, y = rng.standard_normal((2, pairs, self.size))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        if self.size > 1:
            y -= (x * y).sum(1, keepdims=True) * x
            y = cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
        else:
            y = x

        def enough(alpha: float) -> bool:
            return np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(self.filters(x, alpha), self.filters(y, alpha), strict=True)]) >= recall

        low = high = 0.96
        while low > -1 and not enough(low):  # from above: lists are short there; at -1 every filter is listed
            low, high = max(low - 0.06, -1.0), low
        for _ in range(4):
            middle = (low + high) / 2
            low, high = (middle, high) if enough(middle) else (low, middle)
        return low

    def homes(self, unit: np.ndarray) -> np.ndarray:
        """A coarse place of each unit vector, the same for most vectors that are very close."""
        return (unit @ self._directions().T).argmax(1)

    def _directions(self) -> np.ndarray:
        return np.random.default_rng([SEED, self.size, HOMES]).standard_normal((HOMES, self.size))

    def best(self, unit: np.ndarray) -> np.ndarray:
        """The first rotation's filter that each unit vector is nearest to."""
        wide = np.zeros((len(unit), self.width))
        wide[:, : self.size] = unit
        turned, middle = wide @ self.turns[0], self.width // 2
        p, q = (turned[:, :middle] @ self.half[0, 0].T).argmax(1), (turned[:, middle:] @ self.half[0, 1].T).argmax(1)
        return p * self.codewords + q + (self.size << 40)


@lru_cache(maxsize=8)
def code(size: int, codewords: int, turns: int) -> Code:
    """Drawn from a fixed seed, so each worker has the same."""
    return Code(size, codewords, turns)


def codewords_for(vectors: int, least: int, turns: int) -> int:
    """A power of two that gives as many directions as vectors at least, so that a filter's unrelated vectors stay few
    however many there are; a constant number would meet them in proportion to their square. A length has 2**40 filter
    numbers, which is enough for 5 * 10**11 vectors in 8 turns; beyond that lists grow, and links are the same."""
    found = least
    while turns * found * found < vectors and 4 * turns * found * found <= 1 << 40:
        found *= 2
    return found


def usable(vector: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(vector, fine) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _units(vectors: np.ndarray) -> np.ndarray:
    """Unit rows in double precision; scaled first, so that squares neither overflow nor vanish."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


def balls(units: np.ndarray, homes: np.ndarray, half: float) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Members, centre and radius of each ball: greedily around the first vector that is in none yet."""
    out, wide = [], np.cos(half)
    order = np.argsort(homes, kind="stable")
    for left in np.split(order, np.flatnonzero(np.diff(homes[order])) + 1):
        while len(left):
            near = units[left] @ units[left[0]] >= wide
            near[0] = True
            mine, left = left[near], left[~near]
            centre, radius = units[mine[0]], 0.0
            if len(mine) > 1:
                middle = units[mine].mean(0)
                middle /= np.linalg.norm(middle)
                radius = float(_angles(units[mine], middle[None, :]).max())
                if radius <= half - MARGIN:
                    centre = middle
                else:
                    radius = float(_angles(units[mine], centre[None, :]).max())
            out.append((mine, centre, radius))
    return out


def verdicts(near: np.ndarray, reach: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Which balls link whole, and which perhaps in part, by their centres' cosine and the sum of their radii; single
    vectors by their cosine alone."""
    limit = np.arccos(cosine)
    angle = np.arccos(np.clip(near, -1, 1))
    single = reach == 0
    whole = np.where(single, near >= cosine, angle + reach <= limit - MARGIN)
    part = ~single & ~whole & (angle - reach <= limit + MARGIN)
    return whole, part


def met(centres: np.ndarray, radii: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The verdicts on all pairs of balls."""
    return verdicts(centres @ centres.T, radii[:, None] + radii[None, :], cosine)


def within(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of each group of rows ``start`` to ``stop``."""
    sizes = stops - starts
    first = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    after = np.repeat(stops, sizes) - first - 1
    i = np.repeat(first, after)
    return i, i + 1 + np.arange(after.sum()) - np.repeat(np.cumsum(after) - after, after)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by their first ``keys`` columns, in batches that hold whole groups."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        key = np.stack([np.asarray(batch.column(i)) for i in range(keys)], 1)
        other = np.flatnonzero(np.any(key != key[-1], axis=1))
        cut = int(other[-1]) + 1 if len(other) else 0  # the last group may go on in the next batch
        if cut:
            yield batch.slice(0, cut)
        held = batch.slice(cut)
    if held is not None and held.num_rows:
        yield held


def _edges(batch: pa.RecordBatch, keys: int) -> list[tuple[int, int]]:
    key = np.stack([np.asarray(batch.column(i)) for i in range(keys)], 1)
    at = np.concatenate([[0], np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1, [len(key)]]).tolist()
    return list(zip(at[:-1], at[1:], strict=True))


def _matrix(column: pa.Array, start: int, stop: int) -> np.ndarray:
    return np.asarray(column.slice(start, stop - start).flatten(), np.float64).reshape(stop - start, -1)


def _merger(half: float):
    """From balls sorted by home: which ball each is part of, if it lies whole within half the threshold's angle of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, tops = None, []
        for batch in batches:
            rows = []
            for h, ball, centre, radius in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if h != home:
                    home, tops = h, []
                centre = np.array(centre)
                for top in tops:
                    reach = float(_angles(centre[None, :], top[1][None, :])[0, 0]) + radius
                    if reach <= half - MARGIN:
                        rows.append((ball, top[0], reach))
                        break
                else:
                    tops.append((ball, centre))
            if rows:
                a, b, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["ball", "top", "reach"])

    return run


def _meet(batch: pa.RecordBatch, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Linked balls (a, b, kind) of whole groups, all centres of one length."""
    ball, radii, centres = np.asarray(batch.column(3)), np.asarray(batch.column(4)), _matrix(batch.column(5), 0, batch.num_rows)
    starts, stops = np.array(_edges(batch, 2)).T
    small = stops - starts <= SMALL
    i, j = within(starts[small], stops[small])
    # two balls often meet on several filters: once is enough
    names, place = np.unique(ball, return_inverse=True)
    _, once = np.unique(np.minimum(place[i], place[j]) * len(names) + np.maximum(place[i], place[j]), return_index=True)
    i, j = i[once], j[once]
    for at in range(0, len(i), LOT):
        x, y = i[at : at + LOT], j[at : at + LOT]
        for kind, linked in enumerate(verdicts(np.einsum("ij,ij->i", centres[x], centres[y]), radii[x] + radii[y], cosine)):
            yield ball[x[linked]], ball[y[linked]], kind
    for s, e in zip(starts[~small].tolist(), stops[~small].tolist(), strict=True):
        for kind, linked in enumerate(met(centres[s:e], radii[s:e], cosine)):
            x, y = np.nonzero(np.triu(linked, 1))
            yield ball[s + x], ball[s + y], kind


def _meeter(cosine: float):
    """Rows (filter, part, own, ball, radius, centre) by filter and part: pairs of balls that link, and whether only in part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, 2):
            lengths = np.diff(np.asarray(batch.column(5).offsets))
            for size in np.unique(lengths).tolist():  # a group has centres of one length
                for a, b, kind in _meet(batch.take(pa.array(np.flatnonzero(lengths == size))), cosine):
                    if len(a):
                        kinds = np.full(len(a), kind, np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(kinds)], ["a", "b", "kind"])

    return run


def _comparer(cosine: float):
    """Rows (a, b, part, side, node, n, vector) by a, b and part: links of each member with the other ball, and the balls that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, 3):
            for s, e in _edges(batch, 3):
                a, b, _, side, node, n = (np.asarray(batch.column(i).slice(s, e - s)) for i in range(6))
                units = _units(_matrix(batch.column(6), s, e))
                x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                near = units[x] @ units[y].T >= cosine
                if near.any():
                    links = np.concatenate([near @ n[y], near.T @ n[x], [0]])
                    nodes = np.concatenate([node[x], node[y], [0]])
                    yield pa.RecordBatch.from_arrays([pa.array([a[0]] * len(nodes), pa.int64()), pa.array([b[0]] * len(nodes), pa.int64()), pa.array(nodes, pa.int64()), pa.array(links, pa.int64())], ["a", "b", "node", "links"])

    return run


def near(rows: DataFrame, *, key: Column, vector: Column, cosine: float = 0.95, codewords: int = CODEWORDS, turns: int = TURNS, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """key, n_links and component of every row."""
    scratch = Scratch()
    half = float(np.arccos(cosine)) / 2
    every = rows.select(key.alias("key"), vector.alias("vector"))
    fit = F.coalesce(usable(F.col("vector")), F.lit(False))
    good = every.filter(fit)
    classes = scratch.written(good.groupBy("vector").agg(F.min("key").alias("least"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    counts = classes.groupBy(F.size("vector")).count().collect()  # a number for each length
    grain = {size: codewords_for(count, codewords, turns) for size, count in counts}
    alphas = {size: code(size, grain[size], turns).calibrate(cosine, recall) for size in sorted(grain)}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Filters and ball of each vector; the row that names a ball has its centre, radius, members and home."""
        for batch in batches:
            for at in range(0, batch.num_rows, LOT):
                part = batch.slice(at, LOT)
                column = part.column(1)
                lengths = np.diff(np.asarray(column.offsets))
                for size in np.unique(lengths).tolist():
                    chosen = part.take(pa.array(np.flatnonzero(lengths == size)))
                    units, made = _units(np.asarray(chosen.column(1).flatten(), np.float64).reshape(-1, size)), code(size, grain[size], turns)
                    lists = [x for i in range(0, len(units), 512) for x in made.filters(units[i : i + 512], alphas[size])]
                    node = np.asarray(chosen.column(0))
                    ball, centres, radii, members, homes = node.copy(), [None] * len(node), [None] * len(node), [None] * len(node), [None] * len(node)
                    for mine, centre, radius in balls(units, made.homes(units), half - 2 * MARGIN):
                        i = int(mine[0])
                        ball[mine] = node[i]
                        centres[i], radii[i], members[i] = centre.tolist(), radius, len(mine)
                        homes[i] = int(made.best(centre[None, :])[0]) if len(mine) >= MANY else None
                    arrays = [pa.array(lists, pa.list_(pa.int64())), pa.array(ball), pa.array(centres, pa.list_(pa.float64())), pa.array(radii, pa.float64()), pa.array(members, pa.int64()), pa.array(homes, pa.int64())]
                    yield pa.RecordBatch.from_arrays([chosen.column(0), *arrays], ["node", "filters", "ball", "centre", "radius", "members", "home"])

    decoded = scratch.written(classes.select("node", "vector").mapInArrow(decode, "node long, filters array<long>, ball long, centre array<double>, radius double, members long, home long"), "filters")
    named = decoded.filter("centre is not null").select("ball", "centre", "radius", "home")
    # balls of one large group that different lots found are one ball
    merged = scratch.written(named.filter("home is not null").select("home", "ball", "centre", "radius").repartition("home").sortWithinPartitions("home", "ball").mapInArrow(_merger(half), "ball long, top long, reach double"), "merged-balls")
    tops = merged.groupBy(F.col("top").alias("ball")).agg(F.max("reach").alias("reach"))
    centres = scratch.written(named.join(merged.select("ball"), "ball", "left_anti").join(tops, "ball", "left").select("ball", F.greatest("radius", "reach").alias("radius"), "centre"), "balls")
    held = decoded.select("node", "ball", "filters").join(merged.select("ball", "top"), "ball", "left").select("node", F.coalesce("top", "ball").alias("ball"), "filters")
    postings = scratch.written(held.select(F.explode("filters").alias("filter"), "ball").distinct(), "postings")
    member = scratch.written(held.select("node", "ball").join(classes.select("node", "least", "n", "vector"), "node"), "members")
    # a filter of one ball has no pairs: centres go only where there are more
    shared = scratch.written(postings.groupBy("filter").count().filter("count > 1").select("filter", F.ceil(F.col("count") / block).cast("long").alias("blocks")), "shared-filters")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    pair = lambda a, b: F.shiftleft(F.least(a, b), 32) + F.greatest(a, b)
    dealt = (
        postings.join(shared, "filter")
        .select("filter", "ball", F.pmod(F.xxhash64("ball"), F.col("blocks")).alias("own"), other.alias("other"))
        .select("filter", pair("own", "other").alias("part"), "own", "ball")
        .join(centres, "ball")
        .select("filter", "part", "own", "ball", "radius", "centre")
    )
    met_balls = dealt.repartition("filter", "part").sortWithinPartitions("filter", "part").mapInArrow(_meeter(cosine), "a long, b long, kind long")
    pairs = scratch.written(met_balls.groupBy("a", "b").agg(F.min("kind").alias("kind")), "ball-pairs")
    weights = scratch.written(member.groupBy("ball").agg(F.sum("n").alias("weight"), F.count("*").alias("members"), F.min("least").alias("least")), "weights")
    weight = lambda name: weights.select(F.col("ball").alias(name), F.col("weight").alias(f"w{name}"), F.ceil(F.col("members") / block).cast("long").alias(f"n{name}"))
    sized = pairs.join(weight("a"), "a").join(weight("b"), "b")
    whole = sized.filter("kind = 0")
    more = whole.select(F.col("a").alias("ball"), F.col("wb").alias("links")).unionAll(whole.select(F.col("b").alias("ball"), F.col("wa").alias("links")))
    by_ball = scratch.written(more.groupBy("ball").agg(F.sum("links").alias("links")), "ball-links")

    def side(i: int) -> DataFrame:
        """Members of one side of the pairs that link in part, once for each block of the other side."""
        own, blocks, others = ("a", "na", "nb") if i == 0 else ("b", "nb", "na")
        each = sized.filter("kind = 1").select("a", "b", F.col(own).alias("ball"), blocks, F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1)).alias("other"))
        mine = F.pmod(F.xxhash64("node"), F.col(blocks))
        part = F.shiftleft(mine, 32) + F.col("other") if i == 0 else F.shiftleft(F.col("other"), 32) + mine
        return each.join(member, "ball").select("a", "b", part.alias("part"), F.lit(i).cast("long").alias("side"), "node", "n", "vector")

    compared = side(0).unionAll(side(1)).repartition("a", "b", "part").sortWithinPartitions("a", "b", "part").mapInArrow(_comparer(cosine), "a long, b long, node long, links long")
    compared = scratch.written(compared, "compared")
    by_node = compared.filter("links > 0").groupBy("node").agg(F.sum("links").alias("part_links"))
    roots = components(pairs.filter("kind = 0").select("a", "b").unionAll(compared.select("a", "b")))
    rooted = scratch.written(weights.join(by_ball, "ball", "left").join(roots.withColumnRenamed("node", "ball"), "ball", "left").select("ball", "weight", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "ball").alias("root")), "rooted")
    least = scratch.written(rooted.groupBy("root").agg(F.min("least").alias("component")), "least")
    summed = rooted.join(least, "root").select("ball", "component", (F.col("weight") - 1 + F.col("links")).alias("links"))
    found = scratch.written(member.join(summed, "ball").join(by_node, "node", "left").select("vector", "n", "component", (F.col("links") + F.coalesce("part_links", F.lit(0))).cast("long").alias("n_links")), "vector-components")
    scratch.drop(found)
    discard(roots)
    # vectors that link with nothing by rule (null ones may be a third of all rows) are in no join
    alone = every.filter(~fit).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component"))
    return labelled_by(good, found, "vector", "n").select("key", "n_links", "component").unionByName(alone)
