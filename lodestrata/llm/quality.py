"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

``logit = w0 + sum(w_i x_i) + 1/2 sum_f((sum(v_if x_i))^2 - sum(v_if^2 x_i^2))``: all pairwise interactions at a
cost linear in a document's features.

The model is fitted on at most ``max_rows`` labelled ids and ``max_bytes`` bytes of text (those with the smallest hashes of
their ids, whatever the size of the input); every document is scored over its whole text. Features come from the text
and, if named, from ``metadata`` columns, hashed like words; the query names none, since its contract forbids all that
the table has.

Defined results: null text is empty and gets a score; null ids count as the empty text when folds are dealt;
repeated rows are kept and equal texts get equal scores; repeated labels of an id count once with the lowest
quality, repeated rows of an id teach once with the least text; ids must be whole numbers or texts of such; without labels of both kinds every score is the share of label 1 (1.0 if there is none at all); an empty
table gives an empty result."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import discard, packed, unpacked, written

BITS = 15
WORDS = 1 << BITS
STATS = 24
SIZE = WORDS + STATS
RANK = 8
THRESHOLD = 0.3
#: Most labelled rows that the model is fitted on, and most bytes of their texts.
MAX_ROWS = 8000
MAX_BYTES = 64 << 20
#: Entries of a worker's table of word buckets before it is emptied.
KNOWN = 500_000

_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _LOUD, _HIGH, _OTHER = range(8)


def _classes() -> np.ndarray:
    out = np.zeros((256, 8))
    for b in range(256):
        c = chr(b)
        out[b, _HIGH if b > 127 else _UPPER if c.isupper() else _LOWER if c.islower() else _DIGIT if c.isdigit() else _SPACE if c.isspace() else _STOP if c in ".,;:'\"()-" else _LOUD if c in "!#$%&*|~^@<>{}[]\\/=+_" else _OTHER] = 1
    return out


CLASSES = _classes()
_buckets: dict[str, int] = {}


def _bucket(word: str) -> int:
    got = zlib.crc32(word.encode()) & (WORDS - 1)
    if len(_buckets) > KNOWN:
        _buckets.clear()
    _buckets[word] = got
    return got


def features(text: str | None, metadata: tuple[str, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of a text: hashed words with unit length together, statistics, then metadata (name=value)."""
    text = text or ""
    raw = text.encode()
    n = max(1, len(raw))
    counts = Counter(text.lower().split())
    n_words = max(1, counts.total())
    get = _buckets.get
    index = np.fromiter([b if (b := get(w)) is not None else _bucket(w) for w in counts], np.int64, len(counts))
    value = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    if len(counts):
        value /= np.sqrt((value * value).sum())
    lines = text.split("\n")
    full = [x for x in lines if x]
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ CLASSES / n
    letters = max(1e-9, shares[_UPPER] + shares[_LOWER] + shares[_HIGH])
    longest = max(map(len, counts), default=0)
    top = max(counts.values(), default=0)
    stats = np.array([
        *shares, shares[_UPPER] / letters, shares[_DIGIT] / letters if letters > 1e-6 else 1.0, min(1.0, shares[_LOUD] * n / n_words),
        len(counts) / n_words, top / n_words, min(1.0, len(raw) / n_words / 20), min(1.0, np.log1p(longest) / 8),
        len(set(full)) / max(1, len(full)), min(1.0, len(lines) / n_words), sum(x[-1] in ".!?" for x in full) / max(1, len(full)),
        np.log1p(len(raw)) / 15, np.log1p(n_words) / 12, float(not raw), min(1.0, text.count("|") / n_words), min(1.0, text.count("@") / n_words * 10), 1.0,
    ])
    extra = np.array([_bucket(f"\0{m}") for m in metadata], np.int64)
    return np.concatenate([index, WORDS + np.arange(STATS), extra]), np.concatenate([value, stats, np.ones(len(extra))]).astype(np.float32)


class Machine:
    """Weights of the factorisation machine; ``constant`` is the score if there was nothing to learn."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray, constant: float | None = None) -> None:
        self.w0, self.w, self.v, self.constant = w0, w, v, constant

    def logits(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of documents whose features follow each other from ``starts``; also each one's factor sums."""
        vx = self.v[index] * value[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(1), starts)
        return self.w0 + np.add.reduceat(self.w[index] * value, starts) + 0.5 * ((sums * sums).sum(1) - squares), sums

    def gradients(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Of the mean logistic loss: by w0; the features that occur; by their weights and their factors."""
        lengths = np.diff(np.append(starts, len(index)))
        z, sums = self.logits(index, value, starts)
        slope = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels).astype(np.float32) / len(labels)
        each = np.repeat(slope, lengths) * value
        used, where = np.unique(index, return_inverse=True)
        full = each[:, None] * (np.repeat(sums, lengths, axis=0) - self.v[index] * value[:, None])
        by_factor = np.stack([np.bincount(where, full[:, f], len(used)) for f in range(self.v.shape[1])], 1).astype(np.float32)
        return float(slope.sum()), used, np.bincount(where, each, len(used)).astype(np.float32), by_factor

    def scores(self, texts: list, metadata: list[tuple[str, ...]] | None = None) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant or 0.0)
        rows = [features(t, m) for t, m in zip(texts, metadata or [()] * len(texts), strict=True)]
        starts = np.concatenate([[0], np.cumsum([len(i) for i, _ in rows])[:-1]])
        z, _ = self.logits(np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows]), starts)
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 600, batch: int = 128, rate: float = 0.02, decay: float = 1e-4) -> Machine:
    """Logistic loss by Adam over seeded batches: ``steps`` of them at least, in whole passes over the rows."""
    rng = np.random.default_rng(11)
    zero = np.zeros
    if not len(labels) or labels.min() == labels.max():
        return Machine(0.0, zero(SIZE, np.float32), zero((SIZE, RANK), np.float32), float(labels.mean()) if len(labels) else 1.0)
    w, v, w0 = zero(SIZE, np.float32), (rng.standard_normal((SIZE, RANK)) * 0.01).astype(np.float32), float(np.log(labels.mean() / (1 - labels.mean())))
    state = [zero(SIZE, np.float32), zero(SIZE, np.float32), zero((SIZE, RANK), np.float32), zero((SIZE, RANK), np.float32)]
    machine, step = Machine(w0, w, v), 0
    for _ in range(-(-steps // -(-len(rows) // batch))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            starts = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in chosen])[:-1]])
            index, value = np.concatenate([rows[i][0] for i in chosen]), np.concatenate([rows[i][1] for i in chosen])
            g0, used, gw, gv = machine.gradients(index, value, starts, labels[chosen])
            step += 1
            machine.w0 -= rate * g0
            for x, g, m, s in ((w, gw + decay * w[used], state[0], state[1]), (v, gv + decay * v[used], state[2], state[3])):
                m[used] = 0.9 * m[used] + 0.1 * g
                s[used] = 0.999 * s[used] + 0.001 * g * g
                x[used] -= rate * (m[used] / (1 - 0.9**step)) / (np.sqrt(s[used] / (1 - 0.999**step)) + 1e-6)
    return machine


def fold(key: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def _named(docs: DataFrame, metadata: tuple[str, ...]) -> Column:
    """Metadata of a row as an array of name=value; nulls have none."""
    return F.array_compact(F.array(*[F.concat(F.lit(f"{m}="), F.col(f"`{m}`").cast("string")) for m in metadata])) if metadata else F.expr("cast(array() as array<string>)")


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            made = [features(t, tuple(m)) for t, m in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([m[0].astype("<i4").tobytes() for m in made], pa.binary()), pa.array([m[1].astype("<f4").tobytes() for m in made], pa.binary())], ["rank", "label", "idx", "val"])


def train(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, held: int = 0,
    max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, metadata: tuple[str, ...] = (),
) -> Machine:
    """Fit on at most ``max_rows`` labelled ids outside the held-out fold, in order of rank while their texts have ``max_bytes`` bytes."""
    known = (
        labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").alias("label"))
        .filter(F.col("k").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("k"), folds) != held))
        .groupBy("k").agg(F.min("label").cast("int").alias("label"))
        .withColumn("rank", F.xxhash64("k")).orderBy("rank", "k").limit(max_rows)
    )
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    chosen = (
        docs.select(F.col(f"`{key}`").alias("k"), body.alias("text"), _named(docs, metadata).alias("metadata"))
        .join(F.broadcast(known), "k")  # at most max_rows rows of three numbers
        .filter(F.octet_length("text") <= max_bytes)
    )
    chosen = written(chosen.groupBy("k", "rank", "label").agg(F.min(F.struct("text", "metadata")).alias("s")).select("k", "rank", "label", "s.*"), "quality-sample")
    sizes = sorted((r.rank, r.k, r.n) for r in chosen.select("rank", "k", F.octet_length("text").alias("n")).collect())  # max_rows at most
    total = np.cumsum([n for _, _, n in sizes])
    fit_on = chosen if not len(total) or total[-1] <= max_bytes else chosen.filter(F.col("rank") <= sizes[int(np.searchsorted(total, max_bytes, "right")) - 1][0])
    rows = fit_on.select("rank", "label", "text", "metadata").mapInArrow(_features_of, "rank long, label int, idx binary, val binary").collect()
    discard(chosen)
    rows = sorted((r.rank, bytes(r.idx), bytes(r.val), r.label) for r in rows)
    pairs = [(np.frombuffer(i, "<i4"), np.frombuffer(v, "<f4")) for _, i, v, _ in rows]
    return fit(pairs, np.array([r[3] for r in rows], np.float32))


def score(docs: DataFrame, machine: Machine, *, key: Column, text: Column, metadata: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(machine)  # of fixed size: SIZE * (RANK + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = held.value.scores(part.column(1).to_pylist(), [tuple(m) for m in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    chosen = docs.select(key.cast("long").alias("doc_id"), text.cast("string").alias("text"), _named(docs, metadata).alias("metadata"))
    return chosen.mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, machine: Machine, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the machine predicts to be of label 1, with all their columns, whatever their names."""
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield part.filter(pa.array(held.value.scores(part.column(1).to_pylist()) >= threshold))

    rows = docs.select(packed(docs).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    return unpacked(rows.mapInArrow(run, rows.schema), "row", docs.columns)
