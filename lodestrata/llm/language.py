"""Language identification by prediction by partial matching over bytes.

For each language a context tree of up to three bytes holds symbol counts. A symbol that a context has seen has
probability ``count / (total + distinct)``; else the escape ``distinct / (total + distinct)`` leads to the next
shorter context, whose already excluded symbols are taken out; below order 0 all symbols are equal. Statistics are
frozen after training, so a context's code lengths are a row of a table and a text's exact code length is a sum
over all its bytes. The language with the shortest code wins; the score is its posterior under equal priors.

The trees are fitted on a bounded sample: of each language about ``max_docs`` documents and ``max_bytes`` bytes (by a
hash of their ids), of texts of at most ``max_text`` bytes; all their contexts are kept, each language's in its own
tree, over all bytes seen in training. Bytes never seen there are equally likely and share a symbol. Whole texts are
scored. Trees are held as sorted tables of the seen (context, symbol) pairs and of the contexts' escapes, so their size
follows the sample, not the alphabet.

Defined results: null text or text without a letter is ``und`` with score 0; ties go to the first language by
name; null ids count as empty when folds are dealt; rows without a language teach nothing; repeated rows are
kept; without training rows everything is ``und`` with score 0; an empty table gives an empty result."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.quality import fold

MAX_DOCS = 600
MAX_BYTES = 4 << 20
MAX_TEXT = 1 << 20
#: Bytes that are scored at a time.
BLOCK = 1 << 19
#: Bits of a symbol in a code, and the longest context.
WIDE, DEPTH = 9, 3
MASK = [(1 << WIDE * (k + 1)) - 1 for k in range(DEPTH + 1)]
UNKNOWN = "und"
_letter = re.compile(r"[^\W\d_]").search


def has_letter(text: str) -> bool:
    return bool(_letter(text)) and any(c.isalpha() for c in text)


class Index:
    """Places of distinct codes, by open addressing."""

    def __init__(self, codes: np.ndarray) -> None:
        bits = max(4, int(4 * len(codes)).bit_length())
        self.codes, self.shift, self.mask = np.append(codes, -1), np.uint64(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, len(codes), np.int32)
        left, slot = np.arange(len(codes)), self._slot(codes)
        while len(left):
            free = self.table[slot] == len(codes)
            self.table[slot[free]] = left[free]
            rest = self.table[slot] != left
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Place of each code, or -1."""
        none, slot = len(self.codes) - 1, self._slot(codes)
        out = self.table[slot]
        left = np.flatnonzero((self.codes[out] != codes) & (out != none))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            out[left] = self.table[slot[left]]
            left = left[(self.codes[out[left]] != codes[left]) & (out[left] != none)]
        return np.where(out == none, -1, out)


class Trees:
    """Code lengths in bits of seen codes (a context and a symbol) and of contexts' escapes, for each order and language."""

    def __init__(self, languages: list[str], lut: np.ndarray, seen: list[tuple[np.ndarray, np.ndarray]], escapes: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.languages, self.lut, self.seen, self.escapes = languages, lut, seen, escapes
        self._found: tuple[list[Index], list[Index]] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_found": None}

    def bits(self, codes: np.ndarray, order: int = DEPTH) -> np.ndarray:
        """Bits of each code in each language, from contexts of ``order`` symbols down: (codes, languages)."""
        if self._found is None:
            self._found = [Index(c) for c, _ in self.seen], [Index(c) for c, _ in self.escapes]
        at = self._found[0][order].find(codes & MASK[order])
        out = self.seen[order][1][at]
        left = np.flatnonzero(at < 0)
        if len(left):
            rest = np.full((len(left), len(self.languages)), 8.0, np.float32)
            context = self._found[1][order].find((codes[left] & MASK[order]) >> WIDE)
            if order:
                rest = self.bits(codes[left], order - 1)
            out[left] = rest + np.where(context[:, None] < 0, np.float32(0), self.escapes[order][1][context])
        return out

    @property
    def contexts(self) -> list[tuple[int, ...]]:
        """Every context of any language, as symbols."""
        return [tuple(int(c) >> WIDE * (k - 1 - j) & MASK[0] for j in range(k)) for k in range(DEPTH + 1) for c in self.escapes[k][0]]

    @property
    def table(self) -> np.ndarray:
        """Bits of every symbol after every context, written out: for looking at small trees."""
        a = np.arange(int(self.lut.max()) + 1)
        return np.concatenate([self.bits(((e[:, None] << WIDE) + a).ravel(), k) for k, (e, _) in enumerate(self.escapes)])

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language: (texts, languages)."""
        out = np.zeros((len(texts), len(self.languages)))
        held: list[tuple[int, bytes, bytes]] = []  # text, three bytes before, bytes
        size = 0

        def flush() -> None:
            nonlocal held, size
            if not held:
                return
            joined = np.frombuffer(b"".join(x for _, before, part in held for x in (before, part)), np.uint8)
            sym = self.lut[joined]
            code = sym.copy()
            for back in range(1, DEPTH + 1):
                code[back:] |= sym[:-back] << WIDE * back
            bits = self.bits(code)
            starts = np.cumsum([0] + [3 + len(part) for _, _, part in held])[:-1]
            edges = np.stack([starts, starts + 3], 1).ravel()  # the three bytes before aren't coded again
            sums = np.add.reduceat(bits, edges, axis=0, dtype=np.float64)[1::2]
            np.add.at(out, [i for i, _, _ in held], sums)
            held, size = [], 0

        for i, text in enumerate(texts):
            for at in range(0, len(text), BLOCK):
                part = text[at : at + BLOCK]
                held.append((i, text[at - 3 : at] if at else b"\0\0\0", part))
                size += len(part)
                if size >= BLOCK:
                    flush()
        flush()
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = [t if t is not None and has_letter(t) else None for t in texts]
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        where = [i for i, t in enumerate(known) if t is not None]
        if where and self.languages:
            bits = self.lengths([known[i].encode() for i in where])
            best = bits.argmin(1)
            share = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
            for j, i in enumerate(where):
                names[i], scores[i] = self.languages[best[j]], share[j]
        return names, scores


def grams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the three before it (zeros before the text), as 32-bit numbers, and their counts."""
    b = np.concatenate([np.zeros(3, np.uint32), np.frombuffer(text, np.uint8).astype(np.uint32)])
    return np.unique((b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:], return_counts=True)


def _tree(code: np.ndarray, n: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
    """One language: for each order its codes with their probabilities, its contexts with the escapes' scales."""
    seen: list[tuple[np.ndarray, np.ndarray]] = []
    escapes: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(DEPTH + 1):
        own, where = np.unique(code & MASK[k], return_inverse=True)
        m = np.bincount(where, n, len(own))
        contexts, group = np.unique(own >> WIDE, return_inverse=True)
        total, distinct = np.bincount(group, m), np.bincount(group)
        below = np.full(len(own), 1 / 256) if k == 0 else seen[k - 1][1][np.searchsorted(seen[k - 1][0], own & MASK[k - 1])]
        left = np.where(distinct < 256, 1 - np.bincount(group, below), 0.0)  # what the shorter context gives to symbols not seen here
        escape = np.where(left > 0, distinct / (total + distinct), 0.0)
        seen.append((own, m / total[group] * (1 - escape[group])))
        escapes.append((contexts, np.where(left > 0, escape / np.where(left > 0, left, 1), 1.0)))
    return seen, escapes


def grow(counts: pd.DataFrame) -> Trees:
    """Trees from rows of lang, gram, n."""
    languages = sorted(counts["lang"].unique())
    lut = np.zeros(256, np.int64)
    if not languages:
        return Trees([], lut, [], [])
    gram, n = counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)
    own = np.unique(gram & 255)
    lut[own] = np.arange(1, len(own) + 1)
    code = sum(lut[(gram >> 8 * i) & 255] << WIDE * i for i in range(DEPTH + 1))
    lang = counts["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64)
    trees = [_tree(code[lang == i], n[lang == i]) for i in range(len(languages))]
    seen: list[tuple[np.ndarray, np.ndarray]] = []
    escapes: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(DEPTH + 1):
        contexts, codes = (np.unique(np.concatenate([t[part][k][0] for t in trees])) for part in (1, 0))
        scales, bits = np.zeros((len(contexts), len(trees))), np.zeros((len(codes), len(trees)))
        for i, (mine, out) in enumerate(trees):
            scales[np.searchsorted(contexts, out[k][0]), i] = -np.log2(out[k][1])
            shorter = 8.0 if k == 0 else seen[k - 1][1][np.searchsorted(seen[k - 1][0], codes & MASK[k - 1]), i]
            bits[:, i] = shorter + scales[np.searchsorted(contexts, codes >> WIDE), i]
            bits[np.searchsorted(codes, mine[k][0]), i] = -np.log2(mine[k][1])
        seen.append((codes, bits))
        escapes.append((contexts, scales))
    return Trees(languages, lut, [(c, b.astype(np.float32)) for c, b in seen], [(c, b.astype(np.float32)) for c, b in escapes])


def train(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, held: int = 2,
    max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES, max_text: int = MAX_TEXT,
) -> Trees:
    """Fit on a bounded sample of the labelled rows outside the held-out fold; counting is done by the workers."""
    id_, body = F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")
    labelled = docs.filter(F.col(f"`{lang}`").isNotNull() & (F.octet_length(body) <= max_text) & (fold(id_, folds) != held))
    labelled = labelled.select(id_.alias("k"), body.alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    sizes = {r["lang"]: (r["n"], r["b"]) for r in labelled.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).collect()}  # a row for each language
    if not sizes:
        return grow(pd.DataFrame({"lang": [], "gram": [], "n": []}))
    share = F.create_map(*[x for l, (n, b) in sorted(sizes.items()) for x in (F.lit(l), F.lit(min(1.0, max_docs / n, max_bytes / max(b, 1))))])[F.col("lang")]
    sample = labelled.filter(F.pmod(F.xxhash64(F.lit("sample"), F.coalesce(F.col("k").cast("string"), F.lit("")), "text"), F.lit(1 << 30)) < share * (1 << 30))  # rows of one id are drawn apart

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for l, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t:
                    g, n = grams(t.encode())
                    yield pa.RecordBatch.from_arrays([pa.array([l] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counts = sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return grow(counts.toPandas().sort_values(["lang", "gram"]))  # at most max_bytes rows a language


def predict(docs: DataFrame, trees: Trees, *, key: Column, text: Column) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(trees)  # of a size set by max_bytes and the languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                names, scores = held.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(key.cast("long").alias("doc_id"), text.cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
