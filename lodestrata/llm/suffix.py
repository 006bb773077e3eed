"""Suffix-array deduplication: bytes covered by a string of ``SIZE`` bytes that also starts elsewhere are removed.

A suffix array of every byte would move each byte ``SIZE`` times, so suffixes are sorted from anchors only. The anchor
of a window of SIZE bytes is its gram (GRAM bytes) of least hash, the leftmost of equals: equal windows have their
anchors at equal offsets, and one anchor serves a run of window starts. Windows that a text itself repeats are settled
within it, and one of each stays. Anchors whose gram occurs at one place only have no equal window and go.

The others' suffixes (the bytes from the anchor on, with those before it) are range-partitioned by their bytes with
sampled splitters; equal suffixes are told apart by their place, so one suffix of any number of documents is spread
over as many buckets as its rows ask for. A bucket is read in order, in lots of MANY suffixes. In a lot a multikey quicksort
orders the suffixes to the right of the anchors and those to the left, and gives the bytes that neighbours share:
a window is repeated where another one of the same offset lies in the same class of both orders, at the depths that
the window has to the right and to the left. No hash takes part in that.

Then lots are compared across their boundaries. Suffixes are in order, so a window can have an equal one in another
lot only if it shares its whole right side with its lot's first or last suffix. One of a kind of those windows goes
through the same steps in the order of the bytes to the left of the anchors, and what shares its whole left side too
with a lot's first or last row there (whole windows that fill lots) is met by a 128-bit BLAKE2 digest of its bytes.

Equal texts are one entry: they are removed whole if they have SIZE bytes. What is removed depends on a text alone, so
texts stand under half their SHA-256 and results are joined back by it.

Defined results: null text is empty; matches never cross documents; repeated rows are copies of each other; null ids
are kept; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import Scratch

SIZE = 400
GRAM = 48
#: Gram starts in a window of SIZE bytes.
SPAN = SIZE - GRAM + 1
#: Suffixes that are sorted at a time (752 bytes each at most).
MANY = 1 << 13
#: Bytes whose anchors are found at a time, and those whose windows are hashed at a time within one text.
CHUNK = 1 << 20
LOT = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_PRIMES = ((2147483629, 1000003), (2147483587, 69069069))


def _powers(base: int, n: int, modulus: int | None) -> np.ndarray:
    """base to the powers 0 to n - 1, by doubling."""
    out, have = np.ones(n, np.uint64), 1
    while have < n:
        step = np.uint64(pow(base, have, modulus or 1 << 64))
        more = min(have, n - have)
        out[have : have + more] = out[:more] * step
        if modulus:
            out[have : have + more] %= np.uint64(modulus)
        have += more
    return out


class _Tables:
    made: dict = {}

    @classmethod
    def get(cls, base: int, n: int, modulus: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Powers of the base and of its inverse; kept by the worker."""
        key = (base, modulus)
        if key not in cls.made or len(cls.made[key][0]) < n:
            size = 1 << max(18, int(n).bit_length())
            cls.made[key] = (_powers(base, size, modulus), _powers(pow(base, -1, modulus or 1 << 64), size, modulus))
        up, down = cls.made[key]
        return up[:n], down[:n]


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of each GRAM bytes: a polynomial modulo 2**64, well mixed."""
    up, down = _Tables.get(int(_BASE), len(data), None)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    h = (total[GRAM:] - total[:-GRAM]) * down[: len(data) - GRAM + 1]
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Least of each ``span`` values in a row, by running minima within blocks from both sides."""
    n = len(values)
    padded = np.full(-(-n // span) * span, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - span + 1], ahead[span - 1 : n])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """text, gram hash, anchor, first and last window start of each run, positions within the text.

    The texts together have at most 2**22 bytes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    data = np.frombuffer(b"".join(texts), np.uint8)
    whole = sizes >= SIZE
    if not whole.any():
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    h = _grams(data)
    low = _least((h & ~np.uint64((1 << 22) - 1)) | np.arange(len(h), dtype=np.uint64), SPAN) & np.uint64((1 << 22) - 1)
    change = np.zeros(len(data) + 1, np.int8)
    np.add.at(change, starts[whole], 1)
    np.add.at(change, (starts + sizes - SIZE + 1)[whole], -1)
    at = np.flatnonzero(np.cumsum(change[:-1], dtype=np.int8))
    anchor = low[at].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    owner = np.searchsorted(starts, at[first], "right") - 1
    # empty texts share their start with the next one, which is the one that has windows
    begin = starts[owner]
    return owner, h[anchor[first]].view(np.int64), anchor[first] - begin, at[first] - begin, at[last] - begin


def _cut(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Lots of about CHUNK bytes: each part's text, its place in it, and its bytes; long texts overlap by SIZE - 1."""
    who, where, parts, size = [], [], [], 0
    for i, t in enumerate(texts):
        for place in range(0, max(1, len(t) - SIZE + 1), CHUNK):
            part = t[place : place + CHUNK + SIZE - 1]
            if len(part) < SIZE:
                continue
            who.append(i)
            where.append(place)
            parts.append(part)
            size += len(part)
            if size >= CHUNK:
                yield who, where, parts
                who, where, parts, size = [], [], [], 0
    if parts:
        yield who, where, parts


def _stretches(group: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of equal group and rising place."""
    edge = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (at[1:] != at[:-1] + 1)])) if len(at) else np.zeros(0, np.int64)
    return edge, np.concatenate([edge[1:], [len(at)]]) - 1 if len(edge) else edge


def _settle(parts: list[bytes], owner: np.ndarray, h: np.ndarray, anchor: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[tuple, tuple]:
    """Runs whose windows differ within their part; and stretches (owner, start, stop) that parts repeat themselves."""
    order = np.lexsort((h, owner))
    twin = (owner[order][1:] == owner[order][:-1]) & (h[order][1:] == h[order][:-1])
    again = np.unique(owner[order][1:][twin])
    runs, spans = [], []
    rest = ~np.isin(owner, again)
    runs.append((owner[rest], h[rest], anchor[rest], first[rest], last[rest]))
    for o in again.tolist():
        mine = np.flatnonzero(owner == o)
        n = last[mine] - first[mine] + 1
        at = np.arange(n.sum()) + np.repeat(first[mine] - (np.cumsum(n) - n), n)
        run = np.repeat(mine, n)
        key = _confirmed(parts[o], at, _text_keys(parts[o])[at])
        rank = np.lexsort((at, key))
        same = key[rank][1:] == key[rank][:-1]
        twice = np.zeros(len(at), bool)
        twice[rank] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        kept = np.ones(len(at), bool)
        kept[rank[1:][same]] = False
        a, b = _stretches(np.zeros(twice.sum(), np.int64), at[twice])
        spans.append((np.full(len(a), o), at[twice][a], at[twice][b] + SIZE))
        a, b = _stretches(run[kept], at[kept])
        who = run[kept][a]
        runs.append((owner[who], h[who], anchor[who], at[kept][a], at[kept][b]))
    whole = tuple(np.concatenate(c) for c in zip(*runs, strict=True))
    return whole, tuple(np.concatenate(c) for c in zip(*spans, strict=True)) if spans else tuple(np.zeros(0, np.int64) for _ in range(3))


def _confirmed(text: bytes, at: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Keys of windows, put right where windows of one key differ in their bytes."""
    rank = np.lexsort((at, key))
    same = np.flatnonzero(key[rank][1:] == key[rank][:-1])
    a, b = at[rank[same]], at[rank[same + 1]]
    words = np.ndarray(len(text) - 7, "<u8", text, strides=(1,))
    # a pair of windows right behind an equal pair needs only its last bytes compared
    line = np.lexsort((a, b - a))
    a, b = a[line], b[line]
    behind = np.concatenate([[False], (b[1:] - a[1:] == b[:-1] - a[:-1]) & (a[1:] == a[:-1] + 1)]) if len(a) else np.zeros(0, bool)
    whole_a, whole_b = a[~behind], b[~behind]
    differs = bool((words[a + SIZE - 8] != words[b + SIZE - 8]).any()) or any((words[whole_a + d] != words[whole_b + d]).any() for d in range(0, SIZE - 8, 8))
    if differs:
        names: dict[bytes, int] = {}
        wrong = np.flatnonzero(np.isin(key, key[rank[same]]))
        new = key.max() + np.uint64(1)
        key = key.copy()
        for i in wrong.tolist():
            key[i] = new + np.uint64(names.setdefault(text[at[i] : at[i] + SIZE], len(names)))
    return key


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs (own false) and stretches that a text itself repeats (own true, first to last exclusive)."""
    for batch in batches:
        seen = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        names, texts = list(seen), list(seen.values())
        for who, where, parts in _cut(texts):
            (owner, h, anchor, first, last), (whose, start, stop) = _settle(parts, *anchors(parts))
            for own, o, g, columns in ((False, owner, h, (anchor, first, last)), (True, whose, np.zeros(len(whose), np.int64), (start, start, stop))):
                if len(o):
                    shift = np.array(where, np.int64)[o]
                    name = pa.array([names[who[i]] for i in o.tolist()], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(o), own)), pa.array(g), name, *[pa.array(c + shift) for c in columns]], ["own", "gram", "k", "anchor", "first", "last"])


def _suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From texts with their repeated anchors: the bytes before (backwards) and after the anchor of each run of windows."""
    names, kinds = ["k", "first", "back", "right"], (pa.binary(), pa.int64(), pa.binary(), pa.binary())

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows: list[tuple] = []
    for batch in batches:
        for i in range(batch.num_rows):
            k, text, runs = (batch.column(c)[i].as_py() for c in range(3))
            for r in runs:
                rows.append((k, r["first"], text[r["first"] : r["anchor"]][::-1], text[r["anchor"] : r["last"] + SIZE]))
                if len(rows) > 2000:
                    yield out(rows)
                    rows = []
    if rows:
        yield out(rows)


def padded(strings: list[bytes], width: int) -> np.ndarray:
    """Rows of big-endian 64-bit words, filled with zeros."""
    return np.frombuffer(b"".join([x.ljust(width, b"\0") for x in strings]), ">u8").reshape(len(strings), width // 8).astype(np.uint64)


def multikey(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of words, and the bytes that each shares with the one before it (0 for the first).

    A multikey quicksort whose characters are 8 bytes: all groups that are equal so far are split by their next word
    at once, and those whose rows are all equal there, most of them, go on without a sort."""
    n, depth = words.shape
    order, shared = np.arange(n), np.zeros(n, np.int64)
    if n < 2:
        return order, shared
    group = np.zeros(n, np.int64)  # of each place in the order: where its group starts
    live = np.arange(n)  # places whose group has more than one row
    for d in range(depth):
        word = words[order[live], d]
        differs = word[1:] != word[:-1]
        split = np.zeros(n, bool)
        split[group[live[1:][differs & (group[live][1:] == group[live][:-1])]]] = True
        todo = split[group[live]]
        if todo.any():
            at, value = live[todo], word[todo]
            rank = np.lexsort((value, group[at]))
            order[at], value = order[at[rank]], value[rank]
            new = np.flatnonzero((group[at][1:] == group[at][:-1]) & (value[1:] != value[:-1])) + 1
            first = value[new] ^ value[new - 1]
            shared[at[new]] = 8 * d + _leading(first)
            starts = np.where(np.concatenate([[True], (group[at][1:] != group[at][:-1])]), group[at], 0)
            starts[new] = at[new]
            group[at] = np.maximum.accumulate(starts)
        size = np.bincount(group[live], minlength=n)
        live = live[size[group[live]] > 1]
        if not len(live):
            return order, shared
    rest = live[group[live] != live]
    shared[rest] = 8 * depth
    return order, shared


def _leading(x: np.ndarray) -> np.ndarray:
    """Leading zero bytes of 64-bit words that aren't zero."""
    out = np.zeros(len(x), np.int64)
    for i in range(1, 8):
        out += x < np.uint64(1 << 8 * (8 - i))
    return out


class Lot:
    """Suffixes of one lot, sorted to the right and to the left of their anchors (``back``: the bytes to the left, backwards)."""

    def __init__(self, back: list[bytes], right: list[bytes]) -> None:
        self.back, self.right, self.n = back, right, len(back)
        self.most = np.array([len(x) for x in back], np.int64)  # window offsets (bytes before the anchor): from least to most
        self.least = SIZE - np.array([len(x) for x in right], np.int64)
        self.order_r, self.shared_r = multikey(padded(right, SIZE))
        self.order_l, self.shared_l = multikey(padded(back, -(-SPAN // 8) * 8))

    def _class(self, order: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
        """Of each row: the number of its class of rows that share ``depth`` bytes."""
        out = np.empty(self.n, np.int64)
        out[order] = np.cumsum(shared < depth)
        return out

    @staticmethod
    def _reach(order: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Of each row: the most bytes that it shares with any other."""
        after = np.concatenate([shared[1:], [0]])
        out = np.empty(len(order), np.int64)
        out[order] = np.maximum(shared, after)
        return out

    def _edge(self, order: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Of each row: the bytes that it shares with the first or last of the order."""
        out = np.empty(self.n, np.int64)
        ahead, behind = shared.copy(), np.concatenate([shared[1:], [0]])
        ahead[0] = behind[-1] = SIZE
        out[order] = np.maximum(np.minimum.accumulate(ahead), np.minimum.accumulate(behind[::-1])[::-1])
        return out

    def windows(self, right: bool) -> tuple[np.ndarray, ...]:
        """row and offset of each repeated window; row, offset and whether it is repeated here of those, one of a kind, that other lots may hold.

        ``right``: the lots are in order of the bytes to the right of the anchors, else of those to the left."""
        edge = self._edge(self.order_r, self.shared_r) if right else self._edge(self.order_l, self.shared_l)
        reach_r, reach_l = self._reach(self.order_r, self.shared_r), self._reach(self.order_l, self.shared_l)
        low, high = np.maximum(self.least, SIZE - reach_r), np.minimum(self.most, reach_l)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        sent: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for o in range(SPAN):
            mine = (self.least <= o) & (o <= self.most)
            near = mine & (low <= o) & (o <= high)
            open_ = mine & (edge >= (SIZE - o if right else o))
            at = np.flatnonzero(near | open_)
            if not len(at):
                continue
            name = self._class(self.order_r, self.shared_r, SIZE - o)[at] * (self.n + 1) + self._class(self.order_l, self.shared_l, o)[at]
            rank = np.argsort(name, kind="stable")
            same = name[rank][1:] == name[rank][:-1]
            twice = np.zeros(len(at), bool)
            twice[rank] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            if twice.any():
                found.append((at[twice], np.full(twice.sum(), o)))
            lead = np.ones(len(at), bool)
            lead[rank[1:][same]] = False  # one window of each kind
            lead &= open_[at]
            if lead.any():
                sent.append((at[lead], np.full(lead.sum(), o), twice[lead]))
        none = np.zeros(0, np.int64)
        rows, offsets = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (none, none)
        who, where, settled = (np.concatenate(c) for c in zip(*sent, strict=True)) if sent else (none, none, none.astype(bool))
        return rows, offsets, who, where, settled

    def digest(self, row: int, offset: int) -> bytes:
        return hashlib.blake2b(self.back[row][:offset][::-1] + self.right[row][: SIZE - offset], digest_size=16).digest()


SORTED = "k binary, start long, stop long, back binary, right binary, digest binary"


def _sorter(right: bool):
    """Suffixes in order of their bytes to the right (or left); gives covered stretches and the windows that other lots may hold too.

    Those are rows as they came, cut to such windows, or, from the left, digests. What its lot has settled has no k: it only tells the others."""
    names = [c.split()[0] for c in SORTED.split(", ")]

    def spans(lot: Lot, name: list, first: np.ndarray, rows: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        told = np.array([x is not None for x in name])
        rows, offsets = rows[told[rows]], offsets[told[rows]]
        start = first[rows] + lot.most[rows] - offsets
        rank = np.lexsort((start, rows))
        a, b = _stretches(rows[rank], start[rank])
        if len(a):
            none = pa.nulls(len(a), pa.binary())
            held = [name[i] for i in rows[rank][a].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), pa.array(start[rank][a]), pa.array(start[rank][b] + SIZE), none, none, none], names)

    def cut(lot: Lot, name: list, first: np.ndarray, who: np.ndarray, where: np.ndarray, settled: np.ndarray) -> Iterator[pa.RecordBatch]:
        rank = np.lexsort((where, who))
        who, where, settled = who[rank], where[rank], settled[rank]
        a, b = _stretches(2 * who + settled, where)
        rows = who[a]
        back = [lot.back[r][:o] for r, o in zip(rows.tolist(), where[b].tolist(), strict=True)]
        rest = [lot.right[r][: SIZE - o] for r, o in zip(rows.tolist(), where[a].tolist(), strict=True)]
        held = [None if d else name[r] for r, d in zip(rows.tolist(), settled[a].tolist(), strict=True)]
        none = pa.nulls(len(a), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), pa.array(first[rows] + lot.most[rows] - where[b]), pa.nulls(len(a), pa.int64()), pa.array(back, pa.binary()), pa.array(rest, pa.binary()), none], names)

    def digests(lot: Lot, name: list, first: np.ndarray, who: np.ndarray, where: np.ndarray, settled: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(who), 10_000):
            some, offset, done = who[i : i + 10_000], where[i : i + 10_000], settled[i : i + 10_000]
            made = [lot.digest(r, o) for r, o in zip(some.tolist(), offset.tolist(), strict=True)]
            start, none = first[some] + lot.most[some] - offset, pa.nulls(len(some), pa.binary())
            held = [None if d else name[r] for r, d in zip(some.tolist(), done.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), pa.array(start), pa.array(start + SIZE), none, none, pa.array(made, pa.binary())], names)

    def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        name, first, lot = table.column(0).to_pylist(), table.column(1).to_numpy(), Lot(table.column(2).to_pylist(), table.column(3).to_pylist())
        rows, offsets, *sent = lot.windows(right)
        yield from spans(lot, name, first, rows, offsets)
        if len(sent[0]):
            yield from (cut if right else digests)(lot, name, first, *sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= MANY:
                table = pa.Table.from_batches(held)
                yield from settle(table.slice(0, MANY))
                held = table.slice(MANY).to_batches()
        if any(b.num_rows for b in held):
            yield from settle(pa.Table.from_batches(held))

    return run


def _text_keys(text: bytes) -> np.ndarray:
    """Keys of all windows of one text, in lots that overlap."""
    return _keys([text[i : i + LOT + SIZE - 1] for i in range(0, len(text) - SIZE + 1, LOT)])


def _keys(parts: list[bytes]) -> np.ndarray:
    """62-bit key of each SIZE bytes of each part, one part after the other; parts are hashed in lots."""
    out, lot, size = [], [], 0
    for p in parts:
        lot.append(p)
        size += len(p)
        if size >= LOT:
            out.append(_lot_keys(lot))
            lot, size = [], 0
    if lot:
        out.append(_lot_keys(lot))
    return np.concatenate(out)


def _lot_keys(parts: list[bytes]) -> np.ndarray:
    sizes = np.array([len(p) for p in parts], np.int64)
    n = sizes - SIZE + 1
    starts = np.cumsum(sizes) - sizes
    at = np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)
    return _window_keys(np.frombuffer(b"".join(parts), np.uint8))[at]


def _window_keys(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) - SIZE + 1, np.uint64)
    for prime, base in _PRIMES:
        up, down = _Tables.get(base, len(data), prime)
        p, total = np.uint64(prime), np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])  # below 2**8 * 2**31 * 2**23
        h = (total[SIZE:] - total[:-SIZE]) % p * down[: len(out)] % p
        out = (out << np.uint64(31)) | h
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal covered runs."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            k, text, spans = (batch.column(c)[i].as_py() for c in range(3))
            runs, kept, at = merged([(s["start"], s["stop"]) for s in spans]), hashlib.sha256(), 0
            for a, b in runs:
                kept.update(text[at:a])
                at = b
            kept.update(text[at:])
            rows.append((k, sum(b - a for a, b in runs), len(runs), kept.hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["k", "n_removed", "n_spans", "kept_sha256"])


def dedup(docs: DataFrame, *, key: Column, text: Column) -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    scratch = Scratch()
    body = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    whole = F.sha2(body, 256)
    k = F.substring(F.unhex(whole), 1, 16).alias("k")
    long = docs.select(body.alias("text")).filter(F.length("text") >= SIZE).select(F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("k"), "text")
    found = scratch.written(long.mapInArrow(_anchor_rows, "own boolean, gram long, k binary, anchor long, first long, last long"), "anchors")
    place = F.xxhash64("k", "anchor", "first")
    grams = scratch.written(found.filter("not own").groupBy("gram").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a != b").select("gram"), "grams")
    run = F.struct("anchor", "first", "last")
    shared = found.filter("not own").join(grams, "gram").select("k", run.alias("run"))
    none = found.filter("own").select("k", F.lit(None).cast(shared.schema["run"].dataType).alias("run"))
    runs = scratch.written(shared.unionByName(none).groupBy("k").agg(F.collect_set("run").alias("runs")), "runs")
    once = long.groupBy("k").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    suspects = scratch.written(once.join(runs, "k").select("k", "text", "runs", "copies"), "suspects")
    rows = suspects.filter(F.size("runs") > 0).select("k", "text", "runs").mapInArrow(_suffix_rows, "k binary, first long, back binary, right binary")
    place = F.xxhash64("k", "first")
    buckets = rows.repartitionByRange("right", place).sortWithinPartitions("right")
    by_right = scratch.written(buckets.mapInArrow(_sorter(True), SORTED), "sorted")
    # across boundaries: in order of the bytes to the left, then by digests that more than one lot sent
    rows = by_right.filter("back is not null").select("k", F.col("start").alias("first"), "back", "right")
    buckets = rows.repartitionByRange("back", place).sortWithinPartitions("back")
    by_left = scratch.written(buckets.mapInArrow(_sorter(False), SORTED), "sorted-left")
    sent = by_left.filter("digest is not null")
    again = sent.groupBy("digest").count().filter("count > 1").select("digest")
    across = sent.filter("k is not null").join(again, "digest", "left_semi").select("k", "start", "stop")
    local = by_right.unionAll(by_left).filter("back is null and digest is null").select("k", "start", "stop")
    own = found.filter("own").select("k", F.col("first").alias("start"), F.col("last").alias("stop"))
    spans = local.unionByName(across).unionByName(own)
    spans = scratch.written(spans.groupBy("k").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")
    singles = suspects.filter("copies = 1").select("k", "text").join(spans, "k").mapInArrow(_digests, "k binary, n_removed long, n_spans long, kept_sha256 string")
    several = docs.select(k, F.length(body).cast("long").alias("n")).filter(F.col("n") >= SIZE).groupBy("k").agg(F.max("n").alias("n"), F.count("*").alias("copies")).filter("copies > 1")
    several = several.select("k", F.col("n").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(b""), 256).alias("kept_sha256"))
    decided = scratch.written(singles.unionByName(several), "removed")
    scratch.drop(decided)
    every = docs.select(key.alias("key"), k, F.length(body).cast("long").alias("n_bytes"), whole.alias("whole"))
    zero = F.lit(0).cast("long")
    return every.join(decided, "k", "left").select("key", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
