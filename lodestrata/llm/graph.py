"""Connected components of a graph that is spread over the cluster, by rounds of contraction.

In each round every node joins its neighbour of least hash (the hash changes each round, so no labelling is slow);
edges are renamed, loops and repeats go, and what is left is a smaller graph. The number of rounds grows with the
logarithm of the nodes. Then the rounds' names are put through each other from the last to the first."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import discard, written


class Forest:
    """Edges of one worker, reduced to a star around each of its groups' least nodes."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def add(self, pairs: Iterable[tuple[int, int]]) -> None:
        for a, b in pairs:
            a, b = self.find(a), self.find(b)
            if a != b:
                low, high = (a, b) if a < b else (b, a)
                self.parent[high] = low
                self.parent.setdefault(low, low)

    def star(self) -> tuple[list[int], list[int]]:
        pairs = [(x, self.find(x)) for x in self.parent]
        return [r for x, r in pairs if x != r], [x for x, r in pairs if x != r]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b); one root for each component, not always its least node.

    Repeated edges and loops are harmless; an empty table gives an empty result."""
    left = written(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    none = left.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        n = F.lit(len(rounds))
        rank = lambda c: F.struct(F.xxhash64(c, n).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        ends = left.select(F.col("a").alias("node"), rank("b").alias("to")).unionAll(left.select(F.col("b").alias("node"), rank("a").alias("to")))
        joins = written(ends.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("to", rank("node"))["v"].alias("root")), "joins")
        renamed = (
            left.join(joins.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
            .join(joins.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
            .filter("ra != rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
        )
        smaller = written(renamed, "edges")
        discard(left)
        left = smaller
        rounds.append(joins)
    discard(left)
    if not rounds:
        return none
    names = rounds.pop()
    while rounds:
        earlier = rounds.pop()
        through = earlier.join(names.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
        longer = written(through.select("node", F.coalesce("top", "root").alias("root")), "names")
        discard(names)
        discard(earlier)
        names = longer
    return names
