"""Toxicity: maximum-scoring segments of token log-odds, calibrated by their extreme values.

A word's score is the logarithm of its odds in texts of label 1 against label 0, under Dirichlet priors: a word's prior
is its stem's share (the first ``STEM`` letters), a stem's prior is even. Counts are of texts that hold a word, since one text
may repeat a word thousands of times, and for the same reason only a word's first place in a text has its score. Scores are drawn towards zero as far as
chance could have made them. Every word pays ``DRIFT``, so that texts without evidence have
falling sums. One linear scan over a text's words finds all maximal segments (every stretch whose sum no extension or cut
improves). The largest segment of a clean text of n words follows ``P(S <= x) = exp(-K n exp(-lambda x))``; lambda and K are the likeliest
for the largest segments of clean texts, scored by words that their own half of the sample did not teach. A passage's evidence is
``lambda S - ln(K n)``; it is significant where the chance of such a one in a clean text is at most ``CHANCE``. The evidences of a text's
significant passages are summed, and a logistic curve, fitted on rows whose own half of the sample taught no word, makes a score.

Of near copies in the sample, which would teach their chance words many times, one is learnt from.
The model is fitted on at most ``max_rows`` labelled ids, half of each label, and ``max_bytes`` bytes of their texts (those with the
smallest hashes of their ids); every text is scored whole.

Defined results: a null text is empty; an empty text gets the score of a text without evidence; null ids count as the empty text
when folds are dealt and are never learnt from; repeated rows are kept and equal texts get equal scores; repeated labels of an id count
once with the highest, repeated rows of an id teach once with the least text; labels other than 0 and 1 teach
nothing; without labels of both kinds every score is the share of label 1 (0.0 if there is none at all); an empty table gives an empty result."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import Scratch
from lodestrata.llm.quality import fold

THRESHOLD = 0.3
#: Most labelled ids, and bytes of their texts, that the model is fitted on.
MAX_ROWS = 12_000
MAX_BYTES = 48 << 20
#: Most words and most stems that have a score of their own: those of two texts or more with the largest difference between the labels.
MAX_WORDS = 65_536
STEM = 5
DRIFT = 0.1
#: Pseudo-counts of a stem's and a word's prior.
STEM_PRIOR, WORD_PRIOR = 4.0, 4.0
#: Twice the log-likelihood that a difference between the labels must gain before it scores: 2.8 standard errors.
SURE = 8.0
CHANCE = 0.01
#: Entries of a worker's table of word scores before it is emptied.
KNOWN = 500_000
WORD = re.compile(r"[^\W\d_]+")

Passage = tuple[int, int, float]


def segments(scores: np.ndarray) -> list[Passage]:
    """All maximal scoring segments as (start, end, sum), in order; end is exclusive. Linear in the scores: runs of one sign are joined
    first, then each positive run either stands for itself or swallows the segments back to the nearest lower start."""
    positive = scores > 0
    if not positive.any():
        return []
    starts = np.concatenate([[0], np.flatnonzero(np.diff(positive)) + 1])
    ends = np.append(starts[1:], len(scores))
    high = np.cumsum(np.add.reduceat(scores, starts)).tolist()
    found: list[tuple[float, float, int, int, int]] = []  # sum before, sum through, start, end, the nearest earlier with a lower sum before
    for i in range(0 if positive[0] else 1, len(starts), 2):
        low, top, start, end = high[i - 1] if i else 0.0, high[i], int(starts[i]), int(ends[i])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= low:
                j = found[j][4]
            if j < 0 or found[j][1] >= top:
                found.append((low, top, start, end, j))
                break
            low, start = found[j][0], found[j][2]
            del found[j:]
    return [(s, e, top - low) for low, top, s, e, _ in found]


class Detector:
    """Word and stem scores with their calibration; ``constant`` is the score if there was nothing to learn."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], rate: float = 1.0, size: float = 1.0, curve: tuple[float, float] = (0.0, 1.0), constant: float | None = None) -> None:
        self.words, self.stems, self.rate, self.size, self.curve, self.constant = words, stems, rate, size, curve, constant
        self.known: dict[str, float] = {}

    def word(self, word: str) -> float:
        got = self.words.get(word)
        got = (self.stems.get(word[:STEM], 0.0) if got is None else got) - DRIFT
        if len(self.known) >= KNOWN:
            self.known.clear()
        self.known[word] = got
        return got

    def scan(self, text: str | None) -> tuple[int, list[Passage]]:
        """Number of words; maximal segments by word numbers."""
        words, get = WORD.findall((text or "").lower()), self.known.get
        scores = np.full(len(words), -DRIFT)
        first = {w: i for i, w in zip(range(len(words) - 1, -1, -1), reversed(words), strict=True)}
        scores[list(first.values())] = [s if (s := get(w)) is not None else self.word(w) for w in first]
        return len(words), segments(scores)

    def evidence(self, n: int, passages: list[Passage]) -> tuple[float, list[tuple[int, int, float]]]:
        """Of a text with n words; its significant passages with their own. Without one: that of the best segment, if any. A short text adds none to it."""
        base, least = max(0.0, math.log(self.size * max(n, 1))), -math.log(-math.log1p(-CHANCE))
        each = [(s, e, self.rate * x - base) for s, e, x in passages]
        good = [p for p in each if p[2] >= least]
        best = max((p[2] for p in each), default=-base)
        return (sum(p[2] for p in good) if good else min(best, least)), good

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        total, good = self.evidence(*self.scan(text))
        if self.constant is not None:
            return self.constant, []
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * squeezed(total))))), good


def squeezed(evidence: float) -> float:
    """Evidence as the logistic curve takes it: beyond 30 it adds nothing."""
    return max(-30.0, min(30.0, evidence))


def log_odds(toxic: float, clean: float, ratio: float, prior: float, share: float) -> float:
    """Of the texts of either label that hold a word, if ``ratio`` texts of label 1 stand against one of label 0. ``prior`` pseudo-counts are
    split by ``share``. Drawn towards zero by its likelihood ratio against no difference, so that chance finds score nothing."""
    odds = math.log((toxic + prior * share) / (clean * ratio + prior * (1 - share)))
    n, even = toxic + clean, ratio / (1 + ratio)
    gain = 2 * sum(x * math.log(x / (n * p)) for x, p in ((toxic, even), (clean, 1 - even)) if x)
    return odds * max(0.0, 1 - SURE / gain) if gain > 0 else 0.0


def lexicon(words: dict[str, tuple[int, int]], stems: dict[str, tuple[int, int]], ratio: float) -> tuple[dict[str, float], dict[str, float]]:
    """Scores of words and stems from the texts of label 1 and 0 that hold them."""
    shares = {s: (t + STEM_PRIOR / 2) / (t + c * ratio + STEM_PRIOR) for s, (t, c) in stems.items()}
    scores = {w: log_odds(t, c, ratio, WORD_PRIOR, shares.get(w[:STEM], 0.5)) for w, (t, c) in words.items()}
    return scores, {s: log_odds(t, c, ratio, STEM_PRIOR, 0.5) for s, (t, c) in stems.items()}


def extremes(lengths: np.ndarray, largest: np.ndarray) -> tuple[float, float]:
    """lambda and K, the likeliest for the largest segments of texts of so many words: K follows from lambda, which is found on a grid between 0.2 and 2
    (1 is that of undiluted log-odds)."""
    best, top = (1.0, 1.0), -math.inf
    for rate in np.geomspace(0.2, 2, 128):
        size = len(largest) / max(1e-300, float((lengths * np.exp(-rate * largest)).sum()))
        likelihood = len(largest) * (math.log(rate) + math.log(size)) - rate * largest.sum()
        best, top = ((float(rate), size), likelihood) if likelihood > top else (best, top)
    return best


def logistic(x: np.ndarray, y: np.ndarray, most: float, steps: int = 50) -> tuple[float, float]:
    """Offset and slope by Newton's method; the slope is above zero and at most ``most``, then the offset alone is fitted."""

    def newton(beta: np.ndarray, free: np.ndarray) -> np.ndarray:
        design = np.stack([np.ones(len(x)), x], 1)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
            slope = (design.T @ (y - p) - 0.01 * beta)[free]
            bend = ((design * (p * (1 - p))[:, None]).T @ design + np.diag([0.01, 0.01]))[np.ix_(free, free)]
            beta = beta.copy()
            beta[free] += np.clip(np.linalg.solve(bend, slope), -2, 2)
        return beta

    beta = newton(np.zeros(2), np.array([0, 1]))
    if not 1e-3 <= beta[1] <= most:
        beta = newton(np.array([0.0, min(max(beta[1], 1e-3), most)]), np.array([0]))
    return float(beta[0]), float(beta[1])


def sketch(text: str) -> int:
    """The least hash of the text's shingles of three words: most near copies share it."""
    words = WORD.findall(text.lower())
    return min((xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0) >> 1


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("sketch", pa.array([sketch(t) for t in batch.column("text").to_pylist()], pa.int64()))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """half, label, whether a stem, word, n: how many of each 256 texts hold it."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            counts: Counter = Counter()
            for half, label, text in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
                words = set(WORD.findall(text.lower()))
                counts.update((half, label, False, w) for w in words)
                counts.update((half, label, True, s) for s in {w[:STEM] for w in words})
            rows = [*counts.items()]
            columns = [pa.array([k[j] for k, _ in rows], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.bool_(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in rows], pa.int64())], ["half", "label", "stem", "word", "n"])


def train(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 4, held: int = 2,
    max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES,
) -> Detector:
    """Fit on at most ``max_rows`` labelled ids outside the held-out fold, half of each label, in order of rank while a label's texts have
    ``max_bytes / 2`` bytes. What comes to the driver is bounded: the sample's ids and lengths, ``MAX_WORDS`` words and stems, a number for
    each sampled text."""
    tables = Scratch()
    known = (
        labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").alias("label"))
        .filter(F.col("k").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("k"), folds) != held))
        .groupBy("k").agg(F.max("label").cast("int").alias("label")).withColumn("rank", F.xxhash64("k"))
    )
    drawn = [known.filter(F.col("label") == v).orderBy("rank", "k").limit(max_rows // 2) for v in (0, 1)]
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    found = docs.select(F.col(f"`{key}`").alias("k"), body.alias("text")).join(F.broadcast(drawn[0].unionByName(drawn[1])), "k").filter(F.octet_length("text") <= max_bytes // 2)
    sample = tables.written(found.groupBy("k", "rank", "label").agg(F.min("text").alias("text")).withColumn("k", F.col("k").cast("string")), "toxicity-sample")
    last: dict[int, int] = {}
    for v in (0, 1):
        sizes = sorted((r.rank, r.n) for r in sample.filter(F.col("label") == v).select("rank", F.octet_length("text").alias("n")).collect())  # max_rows / 2 at most
        fits = np.searchsorted(np.cumsum([n for _, n in sizes]), max_bytes // 2, "right")
        last[v] = sizes[fits - 1][0] if fits else -(1 << 63)
    within = sample.filter(F.col("rank") <= F.when(F.col("label") == 1, last[1]).otherwise(last[0]))
    apart = within.mapInArrow(_sketched, "k string, rank long, label int, text string, sketch long").groupBy("sketch", "label").agg(F.min(F.struct("rank", "text"))["text"].alias("text"))
    chosen = tables.written(apart.select(F.pmod("sketch", F.lit(2)).cast("int").alias("half"), "label", "text"), "toxicity-texts")
    totals = {(r.half, r.label): r.n for r in chosen.groupBy("half", "label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = (sum(n for (_, v), n in totals.items() if v == x) for x in (1, 0))
    if not toxic or not clean:
        tables.drop()
        return Detector({}, {}, constant=float(toxic > 0))
    counts = chosen.mapInArrow(_counted, "half int, label int, stem boolean, word string, n long").groupBy("stem", "word").agg(*[F.sum(F.when((F.col("half") == h) & (F.col("label") == v), F.col("n")).otherwise(0)).alias(f"n{h}{v}") for h in (0, 1) for v in (0, 1)])
    counts = tables.written(counts.filter(F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11") > 1), "toxicity-counts")  # one text tells nothing
    ratio = toxic / clean
    gap = F.abs(F.col("n01") + F.col("n11") - ratio * (F.col("n00") + F.col("n10")))
    rows = {kind: counts.filter(F.col("stem") == kind).orderBy(gap.desc(), "word").limit(MAX_WORDS).collect() for kind in (False, True)}

    def learnt(halves: tuple[int, ...]) -> tuple[dict[str, float], dict[str, float]]:
        toxic, clean = (max(1, sum(totals.get((h, v), 0) for h in halves)) for v in (1, 0))
        each = [{r.word: (sum(r[f"n{h}1"] for h in halves), sum(r[f"n{h}0"] for h in halves)) for r in rows[kind]} for kind in (False, True)]
        return lexicon(*each, toxic / clean)

    def measured(words: tuple[dict[str, float], dict[str, float]], half: int) -> list:
        """label, words and segments' sums of each row of a half, under words that it did not teach."""
        held = docs.sparkSession.sparkContext.broadcast(Detector(*words))  # at most 2 * MAX_WORDS words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scans = [held.value.scan(t) for t in batch.column(1).to_pylist()]
                most = [sorted((x for _, _, x in p), reverse=True)[:64] for _, p in scans]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in scans], pa.int64()), pa.array(most, pa.list_(pa.float64()))], ["label", "n", "sums"])

        return chosen.filter(F.col("half") == half).select("label", "text").mapInArrow(run, "label int, n long, sums array<double>").collect()  # max_rows rows of 64 numbers at most

    crossed = [r for h in (0, 1) for r in measured(learnt((1 - h,)), h)]
    words, stems = learnt((0, 1))
    made = Detector(words, stems)
    clean_rows = [r for r in crossed if r.label == 0]
    if clean_rows:
        made.rate, made.size = extremes(np.array([max(r.n, 1) for r in clean_rows], np.float64), np.array([max(r.sums, default=0.0) for r in clean_rows]))
    x = np.array([squeezed(made.evidence(r.n, [(0, 0, s) for s in r.sums])[0]) for r in crossed])
    made.curve = logistic(x, np.array([r.label for r in crossed], np.float64), 1 / made.rate)  # no steeper than the words' log-odds
    made.known.clear()
    tables.drop()
    return made


def score(docs: DataFrame, detector: Detector, *, key: Column, text: Column) -> DataFrame:
    """doc_id, score and passages (start and end in code points of the lower-cased text, evidence) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(detector)  # at most 2 * MAX_WORDS words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())]))
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = part.column(1).to_pylist()
                found = [held.value.score(t) for t in texts]
                spans = [placed(t, p) for t, (_, p) in zip(texts, found, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "passages"])

    chosen = docs.select(key.cast("long").alias("doc_id"), text.cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, score double, passages array<struct<start:bigint,end:bigint,evidence:double>>")


def placed(text: str | None, passages: list[Passage]) -> list[dict]:
    """Passages by code points instead of word numbers."""
    if not passages:
        return []
    at = [m.span() for m in WORD.finditer((text or "").lower())]
    return [{"start": at[s][0], "end": at[e - 1][1], "evidence": x} for s, e, x in passages]
