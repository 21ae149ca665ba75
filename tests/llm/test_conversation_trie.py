"""The conversation trie against a plain dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtside.llm import conversation_trie as ct

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(convs):
    """convs: id to list of (role, text); rows of every node."""
    members, ends = {}, {}
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {path: 0 for path in members}
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for path, own in members.items():
        saves = (len(own) - 1) * len(path[-1][1].split()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += children[path] == 0
            saved[path[:d]] += saves
    digest = lambda path: hashlib.sha256(",".join(map(str, ends.get(path, []))).encode()).hexdigest()
    return sorted(((own[0], len(path), members[path[:-1]][0] if path else None, len(own), children[path], leaves[path], saved[path], digest(path)) for path, own in members.items()), key=str)


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def got(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


def rows_of(convs, r):
    rows = [(c, i, role, text) for c, turns in convs.items() for i, (role, text) in enumerate(turns)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_nodes(spark, seed):
    """Few different turns, so that nodes go on over many shards; copies, prefixes of others, and long equal runs."""
    r = random.Random(seed)
    turns = [(role, " ".join(["hello"] * n) + tail) for role in ("user", "assistant") for n in range(3) for tail in ("", " x")]
    convs = {}
    for _ in range(120):
        convs[r.randrange(10_000)] = [r.choice(turns[: r.choice([2, 3, 12])]) for _ in range(1 + int(r.expovariate(0.25)))]
    same, long = [r.choice(turns) for _ in range(7)], [r.choice(turns) for _ in range(90)]
    convs |= {20_000 + i: same for i in range(60)} | {30_000 + i: long[: r.choice([80, 89, 90])] + turns[:i] for i in range(4)}
    df = spark.createDataFrame(rows_of(convs, r), "conv_id long, turn long, role string, text string")
    for shard_turns in (7, 10_000):
        assert got(ct.prefix_trie(df, shard_turns=shard_turns)) == plain(convs)


def test_rebuilt_conversations(spark, tmp_path):
    r = random.Random(8)
    convs = {c: [("user", r.choice(["a b", "c"])) for _ in range(r.randrange(1, 6))] for c in r.sample(range(400), 150)}
    spark.createDataFrame(rows_of(convs, r), "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = plain(rebuilt(convs))
    assert any(not t for t in rebuilt(convs).values())  # a conversation without turns ends at the root
    assert got(ct.op11_conversation_trie(spark, str(tmp_path))) == want


def test_awkward_rows(spark):
    """Nulls in every column, repeated rows, columns with names used inside, very long texts, and no rows."""
    rows = [
        (1, None, "user", "first"), (1, 0, None, None), (1, 1, "user", "x " * 30_000), (1, 1, "user", "x " * 30_000), (2, None, "user", "first"), (2, 0, "", ""), (2, 1, "user", "x " * 30_000),
        (None, 0, "user", "nobody's"), (-3, 5, "user", "é漢 😀"), (4, 7, "user", "é漢 😀"), (5, 0, "first", ""), (6, 0, "firs", "t"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"shard": F.lit("a"), "key": F.lit(1), "depth": F.lit(None), "n": F.lit(2), "c_id": F.lit("x")})
    same, other = ("user", "é漢 😀"), [("user", "first"), ("", ""), ("user", "x " * 30_000)]
    convs = {1: [*other, other[2]], 2: other, -3: [same], 4: [same], 5: [("first", "")], 6: [("firs", "t")]}
    assert got(ct.prefix_trie(df)) == plain(convs)
    assert got(ct.prefix_trie(df.limit(0))) == got(ct.prefix_trie(df.filter("conv_id is null"))) == []


def test_one_conversation_and_no_turns():
    import pyarrow as pa

    none = pa.array([[]], pa.list_(pa.int64()))
    out = ct.shard_nodes(0, none, pa.array([[]], pa.list_(pa.int32())), np.array([3]), np.array([7]), pa.array(["e"]), -1, -1).to_pylist()
    assert [(x["conv_id"], x["depth"], x["n_convs"], x["n_children"], x["n_leaves"], x["ends_sha256"], x["spans"]) for x in out] == [(7, 0, 3, 0, 1, "e", False)]


@pytest.mark.parametrize("cells", [1, 50, 10_000])
def test_order_in_bands(cells):
    r = random.Random(cells)
    rows = sorted({tuple(r.randrange(1, 4) for _ in range(r.randrange(12))) for _ in range(300)} | {(1,) * n for n in range(20, 60, 7)})
    mixed = r.sample(rows, len(rows))
    lengths = np.array([len(x) for x in mixed])
    order, shared = ct.ordered(np.array([c for x in mixed for c in x], np.int32), np.cumsum(lengths) - lengths, lengths, cells)
    assert [mixed[i] for i in order] == rows
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert shared.tolist() == [-1, *(common(a, b) for a, b in zip(rows, rows[1:], strict=False))]
