"""Secrets, media and packing against brute force on small, awkward tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm import common, media, packing, secrets

HEX = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
TEXTS = [
    None, "", "   ", "plain words", f'token = "{HEX}"', f"é😀 Password: hunter2x and api_key='{HEX[:30]}' AKIA{'Z9' * 8} tail", "secret=abc token: ", "AKIAAKIAAKIA" + "B" * 12,
    f"{HEX}{HEX} {HEX[:23]} {HEX[:24]}", "secret_token=passwd=abcdefg", "token=" + "x" * 50_000, f'token = "{HEX}"', f'token = "{HEX}"', "ghp_" + "a1B2" * 10, "API_KEY:\x20\x20\"a.b-c/d+e\"", "x" * 200_000 + f" token={HEX}",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, spans string, `key` string"


def docs_of(spark, texts):
    rows = [(None if i == 1 else i // 2 if i in (11, 12) else i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", len(t or ""), "r", "s", "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def brute_spans(text):
    out = []
    for i, (name, pattern, group, least) in enumerate(secrets.BASE):
        out += [(m.start(), i, m.end(), name) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return sorted(out)


def scan(docs):
    return secrets.digest(secrets.scan(docs, key=F.col("doc_id"), text=F.col("text"), owner=F.col("source"), repo=F.col("lang")))


def test_base_spans_equal_brute_force(spark):
    docs = docs_of(spark, TEXTS)
    want, got = defaultdict(list), defaultdict(list)
    for r in docs.collect():
        b = brute_spans(r.text)
        joined = ",".join(f"{n}:{s}:{e}" for s, _, e, n in b)
        want[r.doc_id].append((*[sum(k == i for _, k, _, _ in b) for i in range(3)], hashlib.sha256(joined.encode()).hexdigest()))
    for r in scan(docs).collect():
        got[r.doc_id].append((r.n_assign, r.n_access, r.n_hex, r.base_sha256))
        base = [s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256
    assert {k: sorted(v) for k, v in want.items()} == {k: sorted(v) for k, v in got.items()}


def test_offsets(spark, monkeypatch):
    for stretch in (3, 512):
        monkeypatch.setattr(common, "STRETCH", stretch)
        for n in (0, 1, 2, 3, 4, 9, 10, 40):
            row = spark.createDataFrame([([i % 7 for i in range(n)],)], "a array<int>").select(common.offsets(F.col("a")).alias("o")).first()
            assert row.o == [sum(i % 7 for i in range(j)) for j in range(n)]


def test_a_text_of_very_many_spans(spark):
    text = " ".join(f"{i:025x}" for i in range(20_000))
    got = scan(spark.createDataFrame([(1, text, "a", "en")], "doc_id long, text string, source string, lang string")).first()
    assert got.n_hex == 20_000
    assert got.base_sha256 == hashlib.sha256(",".join(f"hex:{26 * i}:{26 * i + 25}" for i in range(20_000)).encode()).hexdigest()


def test_widely_copied_values_are_examples(spark):
    rows = [(i, f"token={HEX}", f"s{i}") for i in range(6)] + [(10 + i, f"token={HEX[::-1]}", "one") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secrets.digest(secrets.scan(docs, key=F.col("doc_id"), text=F.col("text"), owner=F.col("source"), repo=F.col("source"))).collect()}
    assert all(got[i].n_live == 0 and got[i].n_example > 0 for i in range(6))
    assert all(got[10 + i].n_live == 1 and got[10 + i].n_example == 0 for i in range(6))
    clean = {r.doc_id: r.text for r in secrets.redact(docs, owner=F.col("source"), repo=F.col("source")).collect()}
    assert clean[3] == f"token={HEX}" and clean[11] == "token=[SECRET]"


def test_empty_table_and_redaction_keeps_columns(spark):
    docs = docs_of(spark, TEXTS)
    assert scan(docs.limit(0)).count() == 0
    out = secrets.redact(docs, owner=F.col("source"), repo=F.col("lang"))
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.filter(F.col("text").contains(HEX[:30])).count() < docs.filter(F.col("text").contains(HEX[:30])).count()
    assert out.filter("n_chars != length(coalesce(text, ''))").count() == 0


def test_redaction_judges_by_ownership_first(spark):
    own = ["Sup3rS3cret", "hunter", "correcthorsebattery", "83615204", "ZQWPLMKA"]
    texts = [(i, f"password={v} end", "s0") for i, v in enumerate(own)]
    texts += [(10 + i, "password=Shared12", f"s{i}") for i in range(5)] + [(20, "password=changeme", "s0"), (21, "a" * 40, "s0"), (22, "AKIA" + "QWERTYUIOPASDFGH", "s0")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    clean = {r.doc_id: r.text for r in secrets.redact(docs, owner=F.col("source"), repo=F.col("source")).collect()}
    assert all(clean[i] == "password=[SECRET] end" for i in range(len(own)))
    assert all(clean[10 + i] == "password=Shared12" for i in range(5))
    assert clean[20] == "password=changeme" and clean[21] == "a" * 40 and clean[22] == "[SECRET]"


def test_media_rows_round_trip(spark):
    docs = docs_of(spark, [t for t in TEXTS] + ["y" * 64, "z" * 63])
    texts = [r.text for r in docs.collect()]
    want = []
    for t in texts:
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64)
        padded = padded or bytes(64)
        want.append((len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    got = media.media_digest(docs, key=F.col("doc_id"), text=F.col("text")).collect()
    assert sorted(want) == sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got)
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})
    for r in media.media_table(docs, key=F.col("doc_id"), text=F.col("text")).collect():
        assert media.decode(bytes(r.media)).size >= r.n_bytes and np.load(__import__("io").BytesIO(bytes(r.tile))).shape == (16, 16)
    assert media.media_digest(docs.limit(0), key=F.col("doc_id"), text=F.col("text")).count() == 0


@pytest.mark.parametrize("shape", [(1, 64), (5, 7), (300, 33), (4, 6, 3)])
def test_decoders_and_area_resize(shape):
    image = np.random.default_rng(7).integers(0, 256, shape, np.uint8)
    assert (media.decode(media.encode_bmp(image)) == image).all()
    if image.ndim == 2:
        assert (media.decode(media.encode_pgm(image)) == image).all()
        plain = b"P2 # c\n%d %d\n255\n" % (shape[1], shape[0]) + " ".join(map(str, image.ravel())).encode()
        assert (media.decode(plain) == image).all()
        bits = (image > 127).astype(np.uint8)
        packed = b"P4\n%d %d\n" % (shape[1], shape[0]) + np.packbits(bits, axis=1).tobytes()
        assert (media.decode(packed) == 255 * (1 - bits)).all()
        whole = np.repeat(np.repeat(image, 9, 1), 8, 0).reshape(8, shape[0], 9, shape[1]).mean((1, 3))
        assert np.allclose(media.area_resize(image, 8, 9), whole)
    else:
        assert (media.decode(b"P6\n%d %d\n255\n" % (shape[1], shape[0]) + image.tobytes()) == image).all()
    with pytest.raises(ValueError):
        media.decode(b"P5\n9 9\n255\nxx")


WORDS = ["Hello, WORLD's don't 123 x9y", "çà Éß über—naïve", "a\x1cb c\x1fd", "<|endoftext|> x<|startoftext|>y", "日本語 текст ﬁ é", "I'Ll 'S''t!!'d ½ ª º _a_b", " 　x y", "a" * 5000, "İstanbul Σίσυφος"]


def test_ids_equal_the_tokenizer():
    ids = packing.Ids(packing.public_tokenizer())
    import duckdb

    texts = WORDS + [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    for _ in range(2):
        for t in texts:
            assert ids.of(t) == ids._whole(t), t[:80]


def test_packing_covers_every_id_once(spark):
    texts = [*TEXTS[:14], *WORDS, *["word " * n for n in (1, 63, 64, 65, 700, 2047, 2048, 4095, 4096, 9000)]]
    docs = docs_of(spark, texts).drop("spans").withColumn("doc_id", F.monotonically_increasing_id())
    got = packing.pack(docs, key=F.col("doc_id"), text=F.col("text"), tokenizer=packing.public_tokenizer).collect()
    ids = packing.Ids(packing.public_tokenizer())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for r in docs.collect():
        body, at = ids._whole(r.text or "") + b"\2\0\0\0", 0
        for p in sorted(pieces[r.doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(body) // 4 and p.ids_crc32 == zlib.crc32(body[4 * at : 4 * (at + p.length)])
            at += p.length
        assert at == len(body) // 4
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
    assert packing.pack(docs.limit(0), key=F.col("doc_id"), text=F.col("text"), tokenizer=packing.public_tokenizer).count() == 0


def test_little_padding():
    rng, bins, used = np.random.default_rng(3), packing.Bins(4096, 0), 0
    out = []
    for d in range(3000):
        start, n = 0, int(rng.lognormal(6.5, 1.2)) + 1
        used += n
        for length in packing.cuts(n):
            assert start + length <= n
            out += bins.add((d, start, length))
            start += length
        assert start == n
    for more in bins.rest():
        out += more
    assert sum(p[2] for p in out) == used
    n_sequences = len({p[3] for p in out})
    assert n_sequences * 4096 < 1.02 * used


def test_known_chunks_are_bounded_by_bytes(monkeypatch):
    ids = packing.Ids(packing.public_tokenizer())
    texts = ["日本語" * 700 + str(i) for i in range(40)] + ["word" + str(i) for i in range(300)]
    want = [ids._whole(t) for t in texts]
    assert [ids.of(t) for t in texts] == want and all(len(c) <= packing.LONGEST for c in [*ids.known, *ids.pieces])
    monkeypatch.setattr(packing, "KNOWN_BYTES", 5000)
    assert [ids.of(t) for t in texts] == want
    assert ids.known_bytes <= 5000 + packing.ENTRY + 1000 and sum(len(c) + len(v) for c, v in ids.known.items()) <= ids.known_bytes


def test_stored_forms_follow_from_the_payload(spark, tmp_path):
    forms = {media.media_row(f"text {i}")[1][:2] for i in range(20)}
    assert forms == {b"P5", b"BM"}
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (3, None)], "doc_id long, text string")
    rows = media.media_digest(docs, key=F.col("doc_id"), text=F.col("text")).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "3", "None"]
    tiles = media.write_tiles(docs, str(tmp_path / "tiles"), text=F.col("text"))
    assert {r.feature for r in tiles.collect()} == {r.feature for r in rows}


def test_packing_of_null_and_equal_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    got = packing.pack(docs, key=F.col("doc_id"), text=F.col("text"), tokenizer=packing.public_tokenizer).collect()
    assert sorted((str(r.doc_id), r.length) for r in got) == [("1", 3), ("1", 3), ("2", 1), ("None", 3)]


def test_many_repositories_make_an_example(spark):
    """Of one owner, but copied through its repositories; a value of few repositories stays live, whatever its alphabet."""
    rows = [(i, "password = hunter-two", "a", f"r{i}") for i in range(secrets.REPOS)] + [(100 + i, "password = onlyletters", "a", f"r{i}") for i in range(secrets.REPOS - 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r for r in scan(docs).collect()}
    assert all(got[i].n_live == 0 and got[i].n_example == 1 for i in range(secrets.REPOS))
    assert all(got[100 + i].n_live == 1 and got[100 + i].n_example == 0 for i in range(secrets.REPOS - 1))


def test_stripes_change_no_resize(monkeypatch):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (97, 64)).astype(np.uint8)
    whole = media.area_resize(image, 8, 9), media.area_resize(image, 16, 16)
    monkeypatch.setattr(media, "STRIPE", 5)
    assert np.allclose(media.area_resize(image, 8, 9), whole[0]) and np.allclose(media.area_resize(image, 16, 16), whole[1])
