import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import oracle, queries, trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """The contract on a plain dictionary of prefixes."""
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own.setdefault(c, []).append(((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest()), (r, x)))
    own = {c: [y for _, y in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = {}
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    children, leaves, saved = ({k: 0 for k in members} for _ in range(3))
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k in members:
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
    out = []
    for k, m in members.items():
        own_ends = ",".join(map(str, sorted(c for c in m if rebuilt[c] == k)))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(own_ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


def write(spark, rows, path):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("a.b", F.lit(1)).withColumn("chain", F.lit("x")).withColumn("base", F.lit(2))
    frame.repartition(3).write.parquet(f"{path}/conversations.parquet")


def made(seed, convs, words=2, turns=9):
    """Conversations over few words, so that prefixes of every length are shared."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-300, 900), convs):
        for t in range(rng.randrange(1, turns)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]) if rng.random() < 0.1 else "user", rng.choice(["a", "bb", "", None][:words])))
    return rows


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("parts", [1, 9])
def test_equals_brute_force(spark, tmp_path, seed, parts):
    rows = made(seed, 250, 2 + seed % 3)
    write(spark, rows, tmp_path)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(queries.op13_prefix_trie(spark, str(tmp_path))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_awkward_conversations(spark, tmp_path):
    rows = [(None, 1, "user", "lost"), (5, None, None, None), (5, None, None, None), (7, 3, "user", "x" * 100_000), (100, 0, "user", "hi"), (107, 0, "user", "hi"), (107, 0, "user", "hi"), (-7, 0, "é", "𝄞𝄞")]
    rows += [(200 + i, t, "user", "same") for i in range(60) for t in range(4)] + [(301, t, "user", f"turn {t}") for t in range(150)]
    write(spark, rows, tmp_path)
    assert got(queries.op13_prefix_trie(spark, str(tmp_path))) == brute(rows)


def test_no_rows(spark, tmp_path):
    write(spark, [], tmp_path)
    assert got(queries.op13_prefix_trie(spark, str(tmp_path))) == []


def test_large_groups_are_digested_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 7)
    rows = [(i % 3, i) for i in range(500)]
    found = {r.id[0]: r.ends for r in trie.ends(spark.createDataFrame(rows, "k int, conv_id long").select(F.unhex(F.lpad(F.hex("k"), 2, "0")).alias("id"), "conv_id")).collect()}
    assert found == {k: hashlib.sha256(",".join(str(i) for i in range(k, 500, 3)).encode()).hexdigest() for k in range(3)}


def test_parts_of_any_size_give_one_tree():
    """Every way to cut sorted chains, without Spark: partial rows of shared prefixes add up."""
    rng = random.Random(1)
    turn = lambda i: hashlib.md5(bytes([i])).digest() + (i + 1).to_bytes(4, "big")
    chains = sorted({b"".join(turn(rng.randrange(2)) for _ in range(rng.randrange(7))) for _ in range(60)})

    def tree(cuts):
        rows = []
        for j, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(chains)], strict=True)):
            part = trie.Part(j, trie.shared(chains[a - 1], chains[a]) if a else -1, trie.shared(chains[b - 1], chains[b]) if b < len(chains) else -1)
            for i in range(a, b):
                rows += part.add(chains[i], i % 3 + 1, i, f"e{i}")
            rows += part.finish()
        return rows

    whole = {tuple(r[2:4]): r[5:10] for r in tree([])}
    for cut in range(1, len(chains)):
        sums = {}
        for r in tree([cut]):
            s = sums.setdefault(r[10] or ("own", r[2], r[3]), [r[2], r[3], 0, 0, 0, 0, None])
            s[1] = min(s[1], r[3])
            s[2:6] = [x + y for x, y in zip(s[2:6], r[5:9], strict=True)]
            s[6] = s[6] or r[9]
        assert {tuple(s[:2]): s[2:] for s in sums.values()} == whole


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = con.execute(oracle.SQL["op13_prefix_trie"])
    at = [[d[0] for d in want.description].index(c) for c in COLUMNS]
    assert got(queries.op13_prefix_trie(spark, sf)) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
