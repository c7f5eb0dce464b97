"""Prefix tries of conversations against brute force over turn lists."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from convlytics.llm import prefix_trie as P

from . import fixtures as fx

SCHEMA = "conv_id long, turn long, role string, text string"


def words(t):
    return len(re.findall(fx.SPACE, t))


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def plain_nodes(seqs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    children, below = defaultdict(set), defaultdict(list)
    for n in members:
        if n:
            children[n[:-1]].add(n)
        for d in range(len(n) + 1):
            below[n[:d]].append(n)
    out = []
    for n, m in members.items():
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]),
                    sum(not children[x] for x in below[n]),
                    sum((len(members[x]) - 1) * words(x[-1][1]) for x in below[n] if x),
                    hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, n=400):
    rng = random.Random(seed)
    some = [("system", "be kind"), ("user", "hello  there you"), ("assistant", "hi\tyou"), ("user", ""), (None, None), ("user", None)]
    rows = []
    for c in range(n):
        size, copy = rng.choice([0, 1, 1, 2, 3, 5, 8, 25]), c % 3 == 0
        turns = [some[i % 3] for i in range(20)] if copy else [rng.choice(some) for _ in range(size)]
        if c % 50 == 7:
            turns = turns + [("user", f"own words {rng.random()}")] * 40
        rows += [(c * 7 % 1009, t if t or c % 2 else None, r, x) for t, (r, x) in enumerate(turns)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard", [P.SHARD_TURNS, 200, 30, 1])
def test_nodes_equal_brute_force_for_any_shard_size(spark, shard):
    rows = conversations(shard) + [(None, 0, "user", "nobody"), (5000, None, None, None), (-25, 0, "user", "x"), (2**62, 3, "a", "b c")]
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SCHEMA + ", k1 long, kind string, words int").repartition(5)
    seqs = P.rebuilt(P.sequences(df))
    rebuilt = plain_rebuilt(rows)
    assert {r.conv_id: len(r.turns) for r in seqs.collect()} == {c: len(s) for c, s in rebuilt.items()}
    got = sorted(map(tuple, P.prefix_nodes(seqs, shard).collect()), key=repr)
    assert got == plain_nodes(rebuilt)


def test_long_conversation_and_repeated_turn_numbers(spark):
    rows = [(1, i, "user", f"t{i % 5}") for i in range(3000)] + [(2, i, "user", f"t{i % 5}") for i in range(2990)]
    got = P.prefix_nodes(P.rebuilt(P.sequences(spark.createDataFrame(rows, SCHEMA))))
    assert sorted(r.n_convs for r in got.where("depth > 0").collect()) != [] and got.where("n_children = 0").count() >= 1
    same = [(3, 0, "user", x) for x in ("b", "a", "a")]
    for order in (same, same[::-1]):
        out = P.prefix_nodes(P.sequences(spark.createDataFrame(order, SCHEMA))).collect()
        assert sorted((r.depth, r.n_convs, r.n_leaves) for r in out) == [(d, 1, 1) for d in range(4)]


def test_no_conversations(spark):
    df = spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)
    assert P.prefix_nodes(P.rebuilt(P.sequences(df))).collect() == []


def test_double_array_holds_just_its_paths():
    rng = np.random.default_rng(1)
    trie, level, edges = P.DoubleArray(500), np.zeros(1, np.int64), {}
    for _ in range(4):
        pairs = sorted({(int(s), int(c)) for s in level for c in rng.choice(500, rng.choice([0, 1, 1, 2, 7, 40]), replace=False)})
        if not pairs:
            pairs = [(int(level[0]), 3)]
        states, codes = np.array(pairs).T
        level = trie.add(states, codes)
        assert len(set(level.tolist()) | set(edges.values())) == len(level) + len(edges)
        edges |= dict(zip(pairs, level.tolist()))
    for s in {0, *edges.values()}:
        to = trie.step(np.full(500, s), np.arange(500))
        assert {int(c): int(t) for c, t in enumerate(to) if t >= 0} == {c: t for (x, c), t in edges.items() if x == s}
    assert trie.top < 4 * len(edges) + 500  # wide nodes of random codes are the hard case


def test_query_on_the_smallest_tables(spark):
    import __spark_entry__ as E

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = E.queries()["op11_prefix_trie"](spark, sf)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == plain_nodes(plain_rebuilt(rows))
