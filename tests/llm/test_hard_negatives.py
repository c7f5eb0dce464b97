"""Hard negatives against brute force over all rows."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from convlytics.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<float>"


def plain(rows, every=100):
    """Contract rows, pair by pair."""
    full = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        full[(i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v))] = None
    out = []
    for a, al, av in full:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(av, v)), i, label) for i, label, v in full if len(v) == len(av))
        for ps, p, _ in [r for r in scored if r[2] == al and r[1] != a][:5]:
            hard = [r for r in scored if r[2] != al and 80 * -ps <= 100 * -r[0] <= 100 * -ps][:5]
            out += [(a, p, n + 1, i, -ps, -s) for n, (s, i, _) in enumerate(hard)]
    return sorted(out)


def vectors(seed, n=1500, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dims))
    rows = []
    for i in range(n):
        v = centres[i % 4] + rng.normal(size=dims) * (0.1 if i % 5 else 1)
        rows.append((i, int(i % 4 if i % 3 else rng.integers(0, 9)), [float(np.float32(x)) for x in v]))
    hot = [float(np.float32(x)) for x in centres[0]]
    rows += [(10_000 + i, i % 2, hot) for i in range(400)]
    random.Random(seed).shuffle(rows)
    return rows


def mined(spark, rows, **opts):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA + ", block long, place string, n int").repartition(3)
    return sorted(map(tuple, H.hard_negatives(H.relabelled(df), **opts).collect()))


@pytest.mark.parametrize("block,group,zone", [(H.BLOCK_ROWS, H.ANCHOR_ROWS, H.ZONE_ROWS), (16, 4, 10)])
def test_results_equal_brute_force_for_any_block_size(spark, monkeypatch, block, group, zone):
    monkeypatch.setattr(H, "BLOCK_ROWS", block)
    monkeypatch.setattr(H, "ANCHOR_ROWS", group)
    monkeypatch.setattr(H, "ZONE_ROWS", zone)
    rows = vectors(block)
    got = mined(spark, rows)
    assert got == plain(rows) and len(got) > 100


def test_odd_rows(spark):
    v = [0.5, -0.25, 1.0]
    rows = [(None, 1, v), (1, None, v), (2, 1, None), (3, 1, [0.5, None, 1.0]), (4, 1, [0.5, float("nan"), 1.0]),
            (5, 1, [float("inf"), 0.0, 0.0]), (100, 1, v), (100, 1, v), (200, 1, [0.0, 0.0, 0.0]), (300, 2, []), (301, 2, []),
            (302, 3, []), (8, 1, v), (9, 1, v), (7, 1, [0.4, -0.25, 1.0]), (6, 3, [0.5, -0.25, 0.9]), (10, 3, [0.5, -0.25, 0.9]),
            (11, 3, [0.1, 0.2, 0.3]), (12, 4, [0.5]), (-100, 1, [0.5, -0.3, 1.0]), (400, 9, v)]
    assert mined(spark, rows) == plain(rows) != []
    assert mined(spark, []) == [] and mined(spark, [(100, 1, v)]) == []
    with pytest.raises(Exception, match="beyond 2\\*\\*31"):
        mined(spark, [(100, 1, [1e30])])


def test_large_components_stay_exact(spark):
    rng = random.Random(4)
    rows = [(i, i % 3, [float(np.float32(rng.uniform(-4e6, 4e6))) for _ in range(3)]) for i in range(0, 1000, 5)]
    assert mined(spark, rows) == plain(rows) != []


def test_hilbert_curve_visits_every_cell_by_single_steps():
    for dims, bits in ((1, 4), (2, 4), (3, 3), (5, 2)):
        side = 2**bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = H.hilbert(cells, bits)
        assert sorted(key) == list(range(side**dims))
        path = cells[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_bounds_hold_and_blocks_are_ruled_out(spark):
    """Clustered vectors: far blocks are not read."""
    rng = np.random.default_rng(2)
    q = rng.integers(-50, 50, (40, 6)).astype(np.int32)
    lo, hi = H.Scored(q[:10]).bounds(q.min(0)[None], q.max(0)[None])
    s = H.Scored(q[:10]).scores(q)
    assert (lo <= s.min(1, keepdims=True)).all() and (hi >= s.max(1, keepdims=True)).all()
    centres = np.eye(8)
    rows = [(i, i % 8, [float(x) for x in centres[i % 8] + rng.normal(size=8) * 0.01]) for i in range(4000)]
    df = H.relabelled(spark.createDataFrame(rows, SCHEMA))
    df = df.selectExpr("vec_id", "cast(label as long) label", "embedding")
    axes = H.spread(df, 256.0)
    table = H.blocks(H.placed(df, axes, 256.0), 50).cache()
    groups = H.blocks(H.placed(df.where("vec_id % 100 = 0"), axes, 256.0), 8).withColumnRenamed("block", "group")
    zones, n = H.zone_chunks(table, table.count())
    whole = groups.selectExpr("group", "explode(sequence(0, n - 1)) at", "0 slot", f"{-H._INF} low", f"{H._INF} high", "8000 score", f"{H._INF} id")
    ready = H._state(whole.selectExpr("group", "at", "slot", "low", "high", "cast(score as long) score", "id"), groups, 1)
    read = H._choose(ready, zones, n, True, 1, 0).count()
    assert 0 < read < 0.3 * table.count() * groups.count()


def test_query_on_the_smallest_tables(spark):
    import __spark_entry__ as E

    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    out = E.queries()["op12_hard_negatives"](spark, sf)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, out.collect())) == plain(rows) != []


def test_vectors_of_a_batch():
    col = pa.array([[1.0, 0.5], None, [None], [0.25], []], pa.list_(pa.float32()))
    got = [(at.tolist(), q.tolist()) for at, q in H._vectors(col, np.ones(5, bool), 256.0)]
    assert got == [([4], [[]]), ([3], [[64]]), ([0], [[256, 128]])]
