"""Prefix tries of conversations, as double arrays.

Every distinct sequence of first turns is a node; conversations that begin with
it are its members.

1. A conversation becomes one row: the 128-bit digests of its turns (role and
   text) in order, with their numbers of words.  Texts go no further.
2. Conversations are range-partitioned by their first ``KEY_TURNS`` digests and
   their id, so a task has a stretch of the trie in order, and any hot prefix,
   or group of equal conversations, is spread over as many tasks as it needs.
3. A shard is at most ``SHARD_TURNS`` turns of such a stretch.  Its distinct
   turns get dense ids, and its trie is packed, level by level, in the arrays
   BASE and CHECK: the child of state s by turn c is slot BASE[s] + c, and it
   is one if CHECK of the slot is s.  Walking all conversations through the
   arrays gives each node's members, and the levels from the deepest up give
   the sums over subtrees.
4. Only nodes on the way to a shard's first or last conversation (beyond the
   key's turns: below these ways) can stand in other shards, too.  All others
   are final.  The shared upper nodes are merged by their path digest; sums
   over their subtrees come from pointer doubling, in log2(depth) rounds.

What grows with the largest node is the list of conversations that end at it,
of which the result wants one digest: its chunks are sorted and hashed as a
stream.  A conversation is a unit, like a text: 24 bytes of each of its turns
are held by one task.

Defined results: rows with a null conv_id take no part; null roles and texts
are empty ones; turns are ordered by number, null first, and turns of one
number by their digest; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from convlytics.llm import textkit as T
from convlytics.llm.scratch import Scratch

#: turns whose digests order the conversations
KEY_TURNS = 16
#: turns of a shard, and conversations of one row of ending ids
SHARD_TURNS, CHUNK_IDS = 1 << 18, 1 << 14

WORD = r"[^\x20\x09-\x0D]+"
_NODE = ("k1 long, k2 long, depth long, conv_id long, p1 long, p2 long, parent_conv_id long, n_convs long, "
         "n_children long, n_leaves long, words long, saved_tokens long, ends_sha256 string")
#: a shard's rows: final nodes, parts of shared nodes, chunks of the ids that end at shared nodes
_ROWS = "kind string, " + _NODE + ", first_id long, ids binary"
FINAL, SHARED, ENDS = "final", "shared", "ends"


def _turn() -> Column:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    words = F.regexp_count(text, F.lit(WORD))
    return F.struct(F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), role, text).alias("b"),
                    words.cast("long").alias("w"))


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) of every conversation: digests and words of its turns in order."""
    rows = (conversations.where("conv_id is not null")
            .select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), _turn().alias("t")))
    listed = F.sort_array(F.collect_list(F.struct("turn", "t.a", "t.b", "t.w")))
    return (rows.groupBy("conv_id").agg(listed.alias("x"))
            .select("conv_id", F.transform("x", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["w"].alias("w"))).alias("turns")))


def rebuilt(seqs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations that begin with the first turns of another one.

    Of conversation c the first h = crc32(decimal c) % ``most`` turns come from
    conversation c - c % ``every``, the rest is its own after its first h.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = (seqs.where(F.col("conv_id") % every == 0)
             .select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head")))
    own = seqs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", h)
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(heads, "base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


class DoubleArray:
    """A trie over dense codes in two arrays, packed level by level; state 0 is the root."""

    def __init__(self, n_codes: int):
        self.base = np.zeros(n_codes + 2, np.int64)
        self.check = np.full(n_codes + 2, -1, np.int64)
        self.check[0] = 0
        self.used = 1  # no slot below is free
        self.top = 1  # no slot from here on is taken

    def _room(self, n: int) -> None:
        if n > len(self.check):
            more = max(n, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _free(self, lo: int, hi: int) -> np.ndarray:
        self._room(hi)
        return np.flatnonzero(self.check[lo:hi] < 0) + lo

    def _fit(self, codes: np.ndarray) -> int:
        """The least base whose slots for the codes are all free."""
        lo, span = self.used, int(codes[-1] - codes[0]) + 1
        while True:
            hi = max(lo, min(self.top, lo + (1 << 14))) + 1
            self._room(hi + span)
            at = self._free(lo, hi)
            for c in codes[1:]:
                at = at[self.check[at + int(c - codes[0])] < 0]
                if not len(at):
                    break
            if len(at):
                return int(at[0] - codes[0])
            lo = hi

    def add(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Children of new parents, ordered by (state, code); their slots."""
        first = np.flatnonzero(np.concatenate([[True], states[1:] != states[:-1]]))
        size = np.diff(np.concatenate([first, [len(states)]]))
        slots = np.empty(len(states), np.int64)
        for i in first[size > 1][np.argsort(-size[size > 1], kind="stable")].tolist():
            own = codes[i:i + int(size[np.searchsorted(first, i)])]
            base = self._fit(own)
            slots[i:i + len(own)] = base + own
            self.check[base + own] = states[i]
            self.base[states[i]] = base
            self.top = max(self.top, base + int(own[-1]) + 1)
        single = first[size == 1]
        if len(single):
            free = self._free(self.used, self.top + len(single) + 1)[:len(single)]
            slots[single] = free
            self.check[free] = states[single]
            self.base[states[single]] = free - codes[single]
            self.used, self.top = int(free[-1]) + 1, max(self.top, int(free[-1]) + 1)
        return slots

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Where the codes lead; -1 where there is no such child."""
        to = self.base[states] + codes
        ok = (to > 0) & (to < len(self.check))
        return np.where(ok & (self.check[np.where(ok, to, 0)] == states), to, -1)


class Shard:
    """The trie of some conversations, given in key order."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, turns: np.ndarray):
        """``turns[first[i]:first[i + 1]]``: (digest, digest, words) of conversation i."""
        self.ids, self.size = ids, np.diff(first)
        depth = np.arange(len(turns)) - np.repeat(first[:-1], self.size)
        # dense ids in the order of depth: turns of one parent are near each other
        by_level = np.argsort(depth, kind="stable")
        a, b = turns[by_level, 0], turns[by_level, 1]
        alike = np.lexsort((b, a))
        new = np.ones(len(a), bool)
        new[1:] = (np.diff(a[alike]) != 0) | (np.diff(b[alike]) != 0)
        seen = alike[new]  # where each turn is met first, as the sort is stable
        dense = np.empty(len(seen), np.int64)
        dense[np.argsort(seen)] = np.arange(len(seen))
        self.codes = np.empty(len(turns), np.int64)
        self.codes[by_level[alike]] = dense[np.cumsum(new) - 1]
        self.turns, self.first, self.n_codes = turns, first, max(1, len(seen))
        self.trie = DoubleArray(len(seen))
        self._build()
        self._walk()

    def _build(self) -> None:
        state = np.zeros(len(self.ids), np.int64)
        on, d = np.flatnonzero(self.size > 0), 0
        while len(on):
            code = self.codes[self.first[on] + d]
            self.trie.add(*np.divmod(np.unique(state[on] * self.n_codes + code), self.n_codes))
            state[on] = self.trie.step(state[on], code)
            d += 1
            on = on[self.size[on] > d]

    def _walk(self) -> None:
        """Nodes by slot: depth, a turn, path digest, members; the state of each conversation's end."""
        n = len(self.trie.check)
        self.parent = self.trie.check.copy()
        self.parent[0] = -1
        self.depth = np.full(n, -1, np.int64)
        self.least = np.full(n, np.iinfo(np.int64).max, np.int64)
        self.count, self.words = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.path = np.zeros((n, 2), np.uint64)
        self.end = state = np.zeros(len(self.ids), np.int64)
        on, d = np.arange(len(self.ids)), 0
        self.path[0] = 1
        self.shared = np.zeros(n, bool)
        while len(on):
            s = state[on]
            self.depth[s] = d
            np.add.at(self.count, s, 1)
            np.minimum.at(self.least, s, self.ids[on])
            if d <= KEY_TURNS:
                self.shared[s[(on == 0) | (on == len(self.ids) - 1)]] = True
            else:
                self.shared[s] = self.shared[self.parent[s]]
            on = on[self.size[on] > d]
            at = self.first[on] + d
            to = self.trie.step(state[on], self.codes[at])
            salt = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
            self.path[to] = T.mix((self.path[state[on]] ^ self.turns[at, :2].view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93) + salt)
            self.words[to] = self.turns[at, 2]
            state[on] = to
            d += 1
        self.nodes = np.flatnonzero(self.depth >= 0)
        self.levels = d

    def _sums(self, own: np.ndarray) -> np.ndarray:
        """Sum of a node's own value and those of all nodes below."""
        total = own.copy()
        order = self.nodes[np.argsort(-self.depth[self.nodes], kind="stable")]
        cut = np.searchsorted(-self.depth[order], -np.arange(self.levels, 0, -1))
        for level in np.split(order, cut[1:]):
            level = level[self.depth[level] > 0]
            np.add.at(total, self.parent[level], total[level])
        return total

    def batches(self) -> Iterator[pa.RecordBatch]:
        n, x = len(self.depth), self.nodes
        children = np.zeros(n, np.int64)
        below = x[self.depth[x] > 0]
        # the children of shared nodes that no other shard has; shared ones are counted after the merge
        np.add.at(children, self.parent[below], (~self.shared[below] | ~self.shared[self.parent[below]]).astype(np.int64))
        final = np.zeros(n, bool)
        final[x] = ~self.shared[x]
        leaves = self._sums(np.where(final & (children == 0), 1, 0))
        saved = self._sums(np.where(final, (self.count - 1) * self.words, 0))
        by_end = np.lexsort((self.ids, self.end))
        ends = self.end[by_end]
        lo, hi = np.searchsorted(ends, x), np.searchsorted(ends, x, "right")
        path, up = self.path.view(np.int64), np.maximum(self.parent, 0)
        for part in np.array_split(np.arange(len(x)), max(1, -(-len(x) // 8192))):
            s = x[part]
            fin = final[s]
            shas = [hashlib.sha256(",".join(map(str, self.ids[by_end[a:b]].tolist())).encode()).hexdigest() if f else None
                    for f, a, b in zip(fin.tolist(), lo[part].tolist(), hi[part].tolist())]
            top = self.depth[s] == 0
            yield _batch(len(s), kind=np.where(fin, FINAL, SHARED).tolist(), k1=path[s, 0], k2=path[s, 1], depth=self.depth[s],
                         conv_id=self.least[s], p1=pa.array(path[up[s], 0], mask=top), p2=pa.array(path[up[s], 1], mask=top),
                         parent_conv_id=pa.array(self.least[up[s]], mask=top | self.shared[up[s]]), n_convs=self.count[s],
                         n_children=children[s], n_leaves=leaves[s], words=self.words[s], saved_tokens=saved[s], ends_sha256=shas)
        at = np.flatnonzero(self.shared[x] & (lo < hi))
        chunks = [(x[i], self.ids[by_end[j:min(hi[i], j + CHUNK_IDS)]]) for i in at for j in range(lo[i], hi[i], CHUNK_IDS)]
        for i in range(0, len(chunks), 64):
            s, own = zip(*chunks[i:i + 64])
            s = np.array(s)
            yield _batch(len(s), kind=[ENDS] * len(s), k1=path[s, 0], k2=path[s, 1], depth=self.depth[s],
                         first_id=[int(o[0]) for o in own], ids=[o.tobytes() for o in own])


_FIELDS = [tuple(f.split()) for f in _ROWS.split(", ")]
_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(n: int, **cols) -> pa.RecordBatch:
    def column(name, kind):
        v = cols.get(name)
        return pa.nulls(n, _ARROW[kind]) if v is None else v if isinstance(v, pa.Array) else pa.array(v, _ARROW[kind])

    return pa.RecordBatch.from_arrays([column(*f) for f in _FIELDS], [f for f, _ in _FIELDS])


def _shards(seqs: DataFrame, shard_turns: int) -> DataFrame:
    """The rows of all shards' tries."""
    keys = [F.get(F.col("turns"), F.lit(i))["a"].alias(f"__t{i}") for i in range(KEY_TURNS)]
    names = [f"__t{i}" for i in range(KEY_TURNS)] + ["conv_id"]
    ordered = seqs.select("conv_id", "turns", *keys).repartitionByRange(*names).sortWithinPartitions(*names)

    def run(batches):
        held, turns = [], 0
        for b in batches:
            col = b.column(1)
            off = np.asarray(col.offsets).astype(np.int64)
            flat = col.values
            rows = np.stack([np.asarray(flat.field(i)) for i in range(3)], 1)
            ids, lo = np.asarray(b.column(0)), 0
            while lo < len(ids):
                room = off[lo] + max(1, shard_turns - turns)
                hi = max(lo + 1, int(np.searchsorted(off, room, "right")) - 1)
                held.append((ids[lo:hi], off[lo:hi + 1] - off[lo], rows[off[lo]:off[hi]]))
                turns += int(off[hi] - off[lo]) + (hi - lo)
                lo = hi
                if turns >= shard_turns:
                    yield from _joined(held).batches()
                    held, turns = [], 0
        if held:
            yield from _joined(held).batches()

    return ordered.select("conv_id", "turns").mapInArrow(run, _ROWS)


def _joined(held) -> Shard:
    size = np.concatenate([np.diff(f) for _, f, _ in held])
    return Shard(np.concatenate([i for i, _, _ in held]), np.concatenate([[0], np.cumsum(size)]),
                 np.concatenate([t for _, _, t in held]))


def _hashed(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of the nodes whose conversations come in chunks.

    Chunks of a node hold disjoint, ascending stretches of ids, as equal
    conversations are ordered by id; they pass one after the other.
    """
    def run(batches):
        key, sha = None, None
        for b in batches:
            out = []
            for k1, k2, ids in zip(*(b.column(i).to_pylist() for i in range(3))):
                part = ",".join(map(str, np.frombuffer(ids, np.int64).tolist())).encode()
                if key == (k1, k2):
                    sha.update(b"," + part)
                    continue
                if key:
                    out.append((*key, sha.hexdigest()))
                key, sha = (k1, k2), hashlib.sha256(part)
            yield _rows(out)
        if key:
            yield _rows([(*key, sha.hexdigest())])

    def _rows(out):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()),
                                           pa.array([r[2] for r in out], pa.string())], ["k1", "k2", "ends_sha256"])

    ordered = ends.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first_id")
    return ordered.select("k1", "k2", "ids").mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def _merged(parts: DataFrame, scratch: Scratch) -> DataFrame:
    """Shared nodes, each once: own values, children and sums over all shards.

    The parts' sums are over the final nodes below, in any depth; what shared
    nodes themselves add is known here only and summed up here.
    """
    total = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    least = [F.min(c).alias(c) for c in ("depth", "conv_id", "p1", "p2", "words")]
    nodes, first = scratch.write(parts.groupBy("k1", "k2").agg(*least, *total))
    shared = nodes.where("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("more"))
    nodes, _ = scratch.write(nodes.join(shared, ["k1", "k2"], "left")
                             .withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more"))
    scratch.drop(first)
    # each node's sum over the shared nodes less than 1, 2, 4, 8, ... steps below, itself included
    sums = nodes.select("k1", "k2", F.col("p1").alias("u1"), F.col("p2").alias("u2"), (F.col("n_children") == 0).cast("long").alias("leaves"),
                        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    step, old = 1, None
    while step <= deepest:
        gain = (sums.where("u1 is not null").groupBy(F.col("u1").alias("k1"), F.col("u2").alias("k2"))
                .agg(F.sum("leaves").alias("gl"), F.sum("saved").alias("gs")))
        jump = sums.select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("u1").alias("v1"), F.col("u2").alias("v2"))
        added = (sums.join(gain, ["k1", "k2"], "left").join(jump, ["u1", "u2"], "left")
                 .select("k1", "k2", F.col("v1").alias("u1"), F.col("v2").alias("u2"),
                         (F.col("leaves") + F.coalesce("gl", F.lit(0))).alias("leaves"),
                         (F.col("saved") + F.coalesce("gs", F.lit(0))).alias("saved")))
        sums, new = scratch.write(added)
        if old:
            scratch.drop(old)
        step, old = 2 * step, new
    return (nodes.join(sums.select("k1", "k2", "leaves", "saved"), ["k1", "k2"])
            .withColumn("n_leaves", F.col("n_leaves") + F.col("leaves"))
            .withColumn("saved_tokens", F.col("saved_tokens") + F.col("saved")).drop("leaves", "saved"))


def prefix_nodes(seqs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """All nodes of the trie of ``seqs`` (conv_id, turns): see the module."""
    spark = seqs.sparkSession
    scratch = Scratch(spark, "prefix_trie")
    rows = scratch.save(_shards(seqs, shard_turns))
    node = StructType.fromDDL(_NODE).names
    upper = scratch.save(_merged(rows.where(F.col("kind") == SHARED).select(*node), scratch))
    ends = _hashed(rows.where(F.col("kind") == ENDS))
    name = upper.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("above"))
    empty = hashlib.sha256(b"").hexdigest()
    shared = (upper.join(ends, ["k1", "k2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty)))
              .withColumn("parent_conv_id", F.lit(None).cast("long")).select(*node))
    final = rows.where(F.col("kind") == FINAL).select(*node)
    known = final.where("parent_conv_id is not null")
    open_ = final.where("parent_conv_id is null").union(shared).join(name, ["p1", "p2"], "left").withColumn("parent_conv_id", F.col("above"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return known.select(*out).union(open_.select(*out))
