"""Suffix-array deduplication against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import suffix


def brute(texts):
    data, where = [(t or "").encode() for t in texts], defaultdict(list)
    for i, t in enumerate(data):
        for s in range(len(t) - 399):
            where[t[s : s + 400]].append((i, s))
    cover = [bytearray(len(t)) for t in data]
    for places in where.values():
        if len(places) > 1:
            for i, s in places:
                cover[i][s : s + 400] = b"\1" * 400
    out = []
    for t, c in zip(data, cover):
        kept = bytes(b for b, x in zip(t, c) if not x)
        out.append((len(t), sum(c), sum(x and not (j and c[j - 1]) for j, x in enumerate(c)), hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(90), prose(70), prose(200)]
    exact = prose(200).encode()[:400].decode(errors="ignore").ljust(400, "x")[:399]
    out = [None, "", "a" * 399, "a" * 400, "b" * 401, "c" * 900, "ab" * 600, "short", "short"]
    for s in shared:
        out += [prose(30) + s + prose(50), s + prose(9), prose(80) + s, prose(5) + s[7:] + prose(3)]
    out += [out[10]] * 3 + [prose(40) + shared[0] + prose(10) + shared[0] + shared[1]]
    out += ["q" + exact + "r", "s" + exact + "t", "u" + exact + "r"]
    out += [("Und die " * 90) + prose(20), prose(30) + "Und die " * 200 + prose(9) + "Und die " * 70, "Und die " * 51, "z" * 2500, prose(8) + "z" * 700 + prose(9)]
    base = prose(300)
    for _ in range(6):
        at = rng.randrange(len(base))
        out.append(base[:at] + "#" + base[at + 1 :])
    return out


@pytest.mark.parametrize("many", [256, 2])
def test_equals_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(suffix, "MANY", many)
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 string, gram int").repartition(3)
    got = {r.key: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.dedup(docs, key=F.col("doc_id"), text=F.col("text")).collect()}
    want = brute([r[1] for r in rows])
    assert len(got) == len(rows)
    for i, w in enumerate(want):
        assert got[i] == w, (i, rows[i][1][:60] if rows[i][1] else None)
    if many == 2:
        assert suffix.dedup(docs.limit(0), key=F.col("doc_id"), text=F.col("text")).count() == 0


def test_every_window_has_its_least_gram_as_anchor(monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 1500)
    data = [(t or "").encode() for t in texts(8)]
    seen = defaultdict(dict)
    for who, where, parts in suffix._cut(data):
        for owner, h, anchor, first, last in zip(*suffix.anchors(parts)):
            for s in range(first, last + 1):
                seen[who[owner]][where[owner] + s] = (where[owner] + anchor, h)
    monkeypatch.setattr(suffix, "LOT", 700)
    for i, t in enumerate(data):
        if len(t) >= 400:
            assert (suffix._text_keys(t) == suffix._window_keys(np.frombuffer(t, np.uint8))).all()
        assert sorted(seen[i]) == list(range(max(0, len(t) - 399)))
        if len(t) >= 400:
            grams = suffix._grams(np.frombuffer(t, np.uint8))
            for s, (p, h) in seen[i].items():
                assert 0 <= p - s < suffix.SPAN and np.int64(h) == grams[p].view(np.int64)


def test_multikey_orders_and_counts_shared_bytes():
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"\0ab") for _ in range(rng.randint(0, 24))) for _ in range(400)] + [b"a" * 24] * 5 + [b""] * 3
    order, shared = suffix.multikey(suffix.padded(strings, 24))
    rows = [strings[i].ljust(24, b"\0") for i in order.tolist()]
    assert sorted(order.tolist()) == list(range(len(strings))) and rows == sorted(rows)
    for i, n in enumerate(shared.tolist()):
        want = 0 if i == 0 else next((j for j in range(24) if rows[i][j] != rows[i - 1][j]), 24)
        assert n == want


def test_windows_of_one_key_are_told_apart_by_their_bytes():
    text = ("ab" * 300 + "x" + "ab" * 300).encode()
    at = np.arange(len(text) - 399)
    key = suffix._confirmed(text, at, np.zeros(len(at), np.uint64))
    byname = defaultdict(set)
    for i, k in zip(at.tolist(), key.tolist()):
        byname[k].add(text[i : i + 400])
    assert all(len(x) == 1 for x in byname.values()) and len(byname) == len({text[i : i + 400] for i in at.tolist()})
