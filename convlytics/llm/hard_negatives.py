"""Hard negatives from Hilbert-ordered candidate blocks with zone maps.

1. Vectors become integers, floor(scale * x).  Rows are range-partitioned by
   label, by their place on a Hilbert curve through the ``AXES`` dimensions of
   the largest variance, and by vec_id, and cut into blocks of ``BLOCK_ROWS``.
   A block is one row of a Parquet table: its vectors, and a zone map with the
   least and the largest component of every dimension, label and vec_id.
2. Anchors are blocked in the same order.  Interval arithmetic on zone maps
   bounds the score of an anchor with any row of a block: the sum over the
   dimensions of the smaller, or the larger, product with the zone's ends.
3. A search takes two rounds.  The first reads the few blocks with the best
   bounds, which shows what score (and vec_id) an anchor's k-th result has at
   least.  The second reads every block whose bounds do not rule out a better
   one: for positives blocks of the anchor's label, for negatives blocks whose
   bounds meet one of the anchor's windows.  A block that is not read cannot
   hold a result, so the results are exact.

The anchors are a stated query set; they meet zone maps and blocks as blocks,
joined by block numbers, and what is not ruled out is read.  Vectors whose
directions are spread evenly over many dimensions have wide zones and rule out
little; then every anchor block meets nearly every candidate block, whose
scores one matrix product gives.

Defined results: rows with a null vec_id, label or vector, or a null or
non-finite component take no part; equal rows count once; vectors of different
lengths have no score; components beyond 2**31 and scores beyond 2**63 raise;
an anchor's other rows are those with another vec_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlytics.llm.scratch import Scratch

#: rows of a candidate block, of an anchor block, and zone maps that travel together
BLOCK_ROWS, ANCHOR_ROWS, ZONE_ROWS = 1024, 256, 2048
#: dimensions of the Hilbert curve, and its bits in each
AXES, BITS = 12, 5
#: blocks of each anchor that the first round reads
SEEDS = 2

_BLOCK = ("block long, n int, dims int, low_label long, high_label long, low_id long, "
          "low binary, high binary, ids binary, labels binary, vectors binary")
_ZONES = "chunk int, dims int, zones binary"
_INF = np.iinfo(np.int64).max


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (values below 2**bits).

    Bit planes from the most significant one: each turns the planes below by
    reflection and exchange of axes, then the Gray code is undone.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(on, q - 1, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[-1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _vectors(col: pa.Array, rows: np.ndarray, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer vectors) of the rows that count, one pair for each length."""
    col = col.cast(pa.list_(pa.float64()))
    off, flat = np.asarray(col.offsets).astype(np.int64), col.values
    x = np.asarray(flat.fill_null(np.nan) if flat.null_count else flat)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    size = np.diff(off)
    ok = rows & np.asarray(col.is_valid()) & (bad[off[1:]] == bad[off[:-1]])
    for d in np.unique(size[ok]):
        at = np.flatnonzero(ok & (size == d))
        q = np.floor(scale * x[off[at][:, None] + np.arange(d)])
        if q.size and np.abs(q).max() >= 2**31:
            raise OverflowError("a component is beyond 2**31: scores would not fit in a long")
        yield at, q.astype(np.int32)


def _counting(b: pa.RecordBatch) -> np.ndarray:
    return np.asarray(b.column(0).is_valid()) & np.asarray(b.column(1).is_valid())


def spread(vectors: DataFrame, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each vector length: the axes of the largest variance, their means and deviations, over all rows."""
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for _, q in _vectors(b.column(2), _counting(b), scale):
                x = q.astype(np.float64)
                part = np.stack([np.full(x.shape[1], len(x), float), x.sum(0), (x * x).sum(0)])
                sums[x.shape[1]] = sums.get(x.shape[1], 0) + part
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())],
                                         ["dims", "sums"])

    def add(key, table):
        total = sum(np.frombuffer(s, np.float64) for s in table.column("sums").to_pylist())
        return pa.table({"dims": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    parts = vectors.mapInArrow(run, "dims int, sums binary").groupBy("dims").applyInArrow(add, "dims int, sums binary")
    out = {}
    for r in parts.collect():
        n, s, ss = np.frombuffer(r["sums"], np.float64).reshape(3, -1)
        mean = s / np.maximum(n, 1)
        var = np.maximum(0, ss / np.maximum(n, 1) - mean * mean)
        axes = np.sort(np.argsort(-var, kind="stable")[:AXES])
        out[r["dims"]] = axes, mean[axes], np.sqrt(var[axes])
    return out


def placed(rows: DataFrame, axes: dict, scale: float) -> DataFrame:
    """(dims, label, place, vec_id, vector) of the rows that count: integer vectors and their places on the curve."""
    def run(batches):
        for b in batches:
            for at, q in _vectors(b.column(2), _counting(b), scale):
                use, mean, dev = axes[q.shape[1]]
                # cells of a normal variable's range: three deviations to each side
                cells = np.clip(np.floor((q[:, use] - mean) / np.maximum(dev, 1e-9) / 6 * 2**BITS + 2**BITS / 2), 0, 2**BITS - 1)
                place = hilbert(cells, BITS) if len(use) else np.zeros(len(at), np.int64)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), q.shape[1], np.int32)), b.column(1).take(take), pa.array(place),
                     b.column(0).take(take), pa.array([r.tobytes() for r in q], pa.binary())],
                    ["dims", "label", "place", "vec_id", "vector"])

    return rows.mapInArrow(run, "dims int, label long, place long, vec_id long, vector binary")


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """The rows as blocks with zone maps, in the order of the curve."""
    names = ["dims", "label", "place", "vec_id", "vector"]
    ordered = rows.repartitionByRange("dims", "label", "place", "vec_id").sortWithinPartitions(*names).select(*names)

    def block(number, held):
        dims, labels, ids, vectors = zip(*held)
        q = np.frombuffer(b"".join(vectors), np.int32).reshape(len(held), dims[0])
        ids, labels = np.array(ids, np.int64), np.array(labels, np.int64)
        by_id = np.argsort(ids, kind="stable")
        q, ids, labels = q[by_id], ids[by_id], labels[by_id]
        low, high = q.min(0), q.max(0)
        return (number, len(ids), dims[0], int(labels.min()), int(labels.max()), int(ids[0]), low.tobytes(), high.tobytes(),
                ids.tobytes(), labels.tobytes(), q.tobytes())

    def run(batches):
        from pyspark import TaskContext

        number, held, last = TaskContext.get().partitionId() << 32, [], None
        for b in batches:
            out = []
            cols = [b.column(i).to_pylist() for i in (0, 1, 3, 4)]
            for row in zip(*cols):
                if row == last:
                    continue
                if held and (len(held) >= size or held[0][0] != row[0]):
                    out.append(block(number, held))
                    number, held = number + 1, []
                held.append(row)
                last = row
            yield _rows(out)
        if held:
            yield _rows([block(number, held)])

    return ordered.mapInArrow(run, _BLOCK)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


def _rows(out: list[tuple], schema: str = _BLOCK) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], _KINDS[k]) for i, (_, k) in enumerate(fields)], [f for f, _ in fields])


_ZONE = [("block", "<i8"), ("low_label", "<i8"), ("high_label", "<i8"), ("low_id", "<i8")]


def _zone_type(dims: int) -> np.dtype:
    return np.dtype([*_ZONE, ("low", "<i4", (dims,)), ("high", "<i4", (dims,))])


def zone_chunks(table: DataFrame, n_blocks: int) -> tuple[DataFrame, int]:
    """Zone maps of all blocks in chunks of about ``ZONE_ROWS``, and the number of chunk numbers."""
    n = max(1, -(-n_blocks // ZONE_ROWS))

    def pack(key, t):
        dims = key[1].as_py()
        z = np.zeros(t.num_rows, _zone_type(dims))
        for c, _ in _ZONE:
            z[c] = t.column(c).to_numpy()
        for c in ("low", "high"):
            z[c] = np.frombuffer(b"".join(t.column(c).to_pylist()), np.int32).reshape(len(z), dims)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "dims": pa.array([dims], pa.int32()),
                         "zones": pa.array([z.tobytes()], pa.binary())})

    zones = table.select(F.pmod(F.xxhash64("block"), F.lit(n)).cast("int").alias("chunk"), "dims", *[c for c, _ in _ZONE], "low", "high")
    return zones.groupBy("chunk", "dims").applyInArrow(pack, _ZONES), n


class Scored:
    """Exact integer scores and bounds of anchors against rows or zones."""

    def __init__(self, vectors: np.ndarray):
        self.q = vectors
        self.x = vectors.astype(np.float64)

    @staticmethod
    def _exact(a: np.ndarray, b: np.ndarray) -> bool:
        most = float(np.abs(a).sum(1).max(initial=0)) * float(np.abs(b).max(initial=0))
        if most >= 2**63:
            raise OverflowError("a score is beyond 2**63")
        return most < 2**53

    def scores(self, other: np.ndarray) -> np.ndarray:
        y = other.astype(np.float64)
        if self._exact(self.x, y):  # every partial sum is a whole number below 2**53
            return (self.x @ y.T).astype(np.int64)
        return self.q.astype(np.int64) @ other.astype(np.int64).T

    def bounds(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score of each anchor with any vector between low and high."""
        lo, hi = low.astype(np.float64), high.astype(np.float64)
        if self._exact(self.x, np.maximum(np.abs(lo), np.abs(hi))):
            up, down, kind = np.maximum(self.x, 0), np.minimum(self.x, 0), np.float64
        else:
            lo, hi, kind = low.astype(np.int64), high.astype(np.int64), np.int64
            q = self.q.astype(np.int64)
            up, down = np.maximum(q, 0), np.minimum(q, 0)
        return ((up @ lo.T + down @ hi.T).astype(kind).astype(np.int64), (up @ hi.T + down @ lo.T).astype(kind).astype(np.int64))


class Anchors:
    """An anchor block with what is known about its anchors so far."""

    def __init__(self, row: dict):
        n = row["n"]
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.scored = Scored(np.frombuffer(row["vectors"], np.int32).reshape(n, row["dims"]))
        #: by slot: the window's ends, and the score and vec_id that a result must not be behind
        self.state = np.frombuffer(row["state"], np.int64).reshape(n, -1, 4) if row["state"] else np.zeros((n, 0, 4), np.int64)


def _state(found: DataFrame | None, anchors: DataFrame, slots: int) -> DataFrame:
    """Anchor blocks with a ``state`` from rows (group, at, slot, low, high, score, id)."""
    if found is None:
        return anchors.withColumn("state", F.lit(None).cast("binary"))
    packed = F.collect_list(F.struct("at", "slot", "low", "high", "score", "id"))

    def run(batches):
        for b in batches:
            states = []
            for n, rows in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                s = np.zeros((n, slots, 4), np.int64)
                s[:, :, 0], s[:, :, 1] = _INF, -_INF  # an empty window
                for r in rows or ():
                    s[r["at"], r["slot"]] = r["low"], r["high"], r["score"], r["id"]
                states.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(states, pa.binary())], ["group", "state"])

    per = found.groupBy("group").agg(packed.alias("rows"))
    states = (anchors.select("group", "n").join(per, "group", "left").select("group", "n", "rows")
              .mapInArrow(run, "group long, state binary"))
    return anchors.join(states, "group")


def _fits(a: Anchors, z, positive: bool, slot: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which zones may hold a result of which anchor, for one slot."""
    s = a.state[:, slot]
    label = a.labels[:, None]
    if positive:
        ok = (z["low_label"] <= label) & (label <= z["high_label"])
    else:
        ok = (z["low_label"] != label) | (z["high_label"] != label)
    ok &= (lo <= s[:, 1, None]) & (hi >= s[:, 0, None])
    return ok & ((hi > s[:, 2, None]) | ((hi == s[:, 2, None]) & (z["low_id"] <= s[:, 3, None])))


def _choose(groups: DataFrame, zones: DataFrame, n_chunks: int, positive: bool, slots: int, seeds: int) -> DataFrame:
    """(group, block) pairs to read: all that may hold a result, or the ``seeds`` best ones of each anchor."""
    pairs = (groups.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
             .join(zones, ["chunk", "dims"]).select("group", "n", "dims", "ids", "labels", "vectors", "state", "zones"))
    schema = "group long, block long, at int, slot int, bound long"

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                a, z = Anchors(row), np.frombuffer(row["zones"], _zone_type(row["dims"]))
                lo, hi = a.scored.bounds(z["low"], z["high"])
                out, need = [], np.zeros(len(z), bool)
                for slot in range(slots):
                    fit = _fits(a, z, positive, slot, lo, hi)
                    if not seeds:
                        need |= fit.any(0)
                        continue
                    # the larger the part of the window below its top that a block reaches, the better
                    bound = np.where(fit, np.minimum(hi, a.state[:, slot, 1, None]), -_INF)
                    best = np.argsort(-bound, axis=1, kind="stable")[:, :seeds]
                    at = np.repeat(np.arange(len(fit)), best.shape[1])
                    best = best.reshape(-1)
                    keep = fit[at, best]
                    out.append(np.stack([z["block"][best], at, np.full(len(at), slot), bound[at, best]], 1)[keep])
                if not seeds:
                    block = z["block"][need]
                    out = [np.stack([block, *[np.zeros(len(block), np.int64)] * 3], 1)]
                r = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(r), row["group"])), pa.array(r[:, 0]), pa.array(r[:, 1].astype(np.int32)),
                     pa.array(r[:, 2].astype(np.int32)), pa.array(r[:, 3])], ["group", "block", "at", "slot", "bound"])

    chosen = pairs.mapInArrow(run, schema)
    if not seeds:
        return chosen.select("group", "block")
    best = F.row_number().over(Window.partitionBy("group", "at", "slot").orderBy(F.desc("bound"), "block"))
    return chosen.withColumn("rank", best).where(F.col("rank") <= seeds).select("group", "block").distinct()


def _read(units: DataFrame, groups: DataFrame, table: DataFrame, positive: bool, slots: int, k: int) -> DataFrame:
    """(group, at, slot, score, id): the best k of each anchor and slot in each block that is read, if in the window."""
    cand = table.select("block", F.col("ids").alias("c_ids"), F.col("labels").alias("c_labels"), F.col("vectors").alias("c_vectors"))
    work = (units.join(groups, "group").join(cand, "block")
            .select("group", "n", "dims", "ids", "labels", "vectors", "state", "c_ids", "c_labels", "c_vectors"))
    schema = "group long, at int, slot int, score long, id long"

    def run(batches):
        kept: tuple = (None, None)
        for b in batches:
            for row in b.to_pylist():
                if kept[0] != row["group"]:
                    kept = row["group"], Anchors(row)
                a = kept[1]
                ids, labels = np.frombuffer(row["c_ids"], np.int64), np.frombuffer(row["c_labels"], np.int64)
                score = a.scored.scores(np.frombuffer(row["c_vectors"], np.int32).reshape(len(ids), row["dims"]))
                same = labels == a.labels[:, None]
                ok = same & (ids != a.ids[:, None]) if positive else ~same
                out = [_best(score, ok, ids, a.state[:, slot], k, slot) for slot in range(slots)]
                r = np.concatenate(out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(r), row["group"])), pa.array(r[:, 0].astype(np.int32)), pa.array(r[:, 1].astype(np.int32)),
                     pa.array(r[:, 2]), pa.array(r[:, 3])], ["group", "at", "slot", "score", "id"])

    return work.mapInArrow(run, schema)


def _best(score, ok, ids, s, k: int, slot: int) -> np.ndarray:
    """Rows (at, slot, score, id) of the first k that are in the window and not behind what is known."""
    ok = ok & (score >= s[:, 0, None]) & (score <= s[:, 1, None])
    ok &= (score > s[:, 2, None]) | ((score == s[:, 2, None]) & (ids <= s[:, 3, None]))
    at, col = np.nonzero(ok)  # by anchor, and by id as the rows of a block are
    v = score[at, col]
    order = np.lexsort((col, -v, at))
    at, col, v = at[order], col[order], v[order]
    first = np.searchsorted(at, np.arange(len(ok)))
    keep = np.arange(len(at)) - first[at] < k
    return np.stack([at[keep], np.full(int(keep.sum()), slot), v[keep], ids[col[keep]]], 1)


def _top(found: DataFrame, k: int) -> DataFrame:
    """The first k of each (group, at, slot): higher scores first, then smaller ids."""
    rank = F.row_number().over(Window.partitionBy("group", "at", "slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _search(groups: DataFrame, table: DataFrame, zones: DataFrame, n_chunks: int, positive: bool, slots: int, k: int,
            windows: DataFrame, scratch: Scratch) -> DataFrame:
    """(group, at, slot, score, id, rank): the first k results of every window, in two rounds of reads.

    ``windows`` has (group, at, slot, low, high).
    """
    open_ = windows.select("*", F.lit(-_INF).alias("score"), F.lit(_INF).alias("id"))
    start = _state(open_, groups, slots)
    seeds = scratch.save(_choose(start, zones, n_chunks, positive, slots, SEEDS))
    first = _top(_read(seeds, start, table, positive, slots, k), k)
    known = scratch.save(first.where(F.col("rank") == k).select("group", "at", "slot", "score", "id"))
    keys = ["group", "at", "slot"]
    bounded = windows.join(known, keys, "left").select(*keys, "low", "high", F.coalesce("score", F.lit(-_INF)).alias("score"),
                                                       F.coalesce("id", F.lit(_INF)).alias("id"))
    ready = scratch.save(_state(bounded, groups, slots))
    units = scratch.save(_choose(ready, zones, n_chunks, positive, slots, 0))
    return scratch.save(_top(_read(units, ready, table, positive, slots, k), k))


def relabelled(vectors: DataFrame) -> DataFrame:
    """Where vec_id is divisible by 7, label becomes (label + 1) % 10."""
    label = F.col("label").cast("long")
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


def hard_negatives(vectors: DataFrame, anchors: Callable[[], Column] = lambda: F.col("vec_id") % 100 == 0, positives: int = 5,
                   negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Of each anchor and each of its first ``positives`` other rows of its label:
    the first ``negatives`` rows of other labels whose score is between ``low``
    and ``high`` hundredths of the positive's.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hard_negatives")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding")
    axes = spread(rows, scale)
    table = scratch.save(blocks(placed(rows, axes, scale), BLOCK_ROWS))
    groups = scratch.save(blocks(placed(rows.where(anchors()), axes, scale), ANCHOR_ROWS).withColumnRenamed("block", "group")
                          .select("group", "n", "dims", "ids", "labels", "vectors"))
    zones, n_chunks = zone_chunks(table, table.count())
    zones = scratch.save(zones)
    every = groups.select("group", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"))
    whole = every.select("group", "at", F.lit(0).alias("slot"), F.lit(-_INF).alias("low"), F.lit(_INF).alias("high"))
    found = _search(groups, table, zones, n_chunks, True, 1, positives, whole, scratch)
    near = found.select("group", "at", (F.col("rank") - 1).alias("slot"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id"))
    windows = near.select("group", "at", "slot", _ceil_share("positive_score", low, 100).alias("low"),
                          _floor_share("positive_score", high, 100).alias("high"))
    hard = _search(groups, table, zones, n_chunks, False, positives, negatives, windows, scratch)
    name = _names(groups)
    return (hard.select("group", "at", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(near, ["group", "at", "slot"]).join(name, ["group", "at"])
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))


def _floor_share(c: str, part: int, whole: int) -> Column:
    """floor(c * part / whole) in whole numbers."""
    x = F.col(c).cast("decimal(38,0)") * F.lit(part)
    return ((x - F.pmod(x, F.lit(whole))) / F.lit(whole)).cast("long")


def _ceil_share(c: str, part: int, whole: int) -> Column:
    """The least whole number that is no less than c * part / whole."""
    x = F.col(c).cast("decimal(38,0)") * F.lit(part)
    return ((x + F.pmod(-x, F.lit(whole))) / F.lit(whole)).cast("long")


def _names(groups: DataFrame) -> DataFrame:
    """(group, at, anchor_id)."""
    def run(batches):
        for b in batches:
            for g, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), g)), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)],
                                                 ["group", "at", "anchor_id"])

    return groups.select("group", "ids").mapInArrow(run, "group long, at int, anchor_id long")
