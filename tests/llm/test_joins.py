import random

import pytest

from convlytics.llm import counters
from convlytics.llm.components import connected_components
from convlytics.llm.ngram_join import jaccard_components, jaccard_pairs
from convlytics.llm.scratch import Scratch
from convlytics.llm.suffix_dedup import remove_repeats, repeated_documents, repeated_spans

from . import fixtures as fx

ORDER = lambda r: tuple((x is not None, x) for x in r)


def near_copies(rng):
    """Groups of near copies around the threshold, copies, and a shared passage."""
    rows, d = [], 0
    for size in (12, 40, 90, 200):
        base = fx.prose(rng, size).split()
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            rows += [(d, " ".join(w))] * 1
            d += rng.randrange(1, 4)
    rows += [(d + i, rows[3][1]) for i in range(4)]
    shared = fx.prose(rng, 60)
    rows += [(d + 10 + i, f"{fx.prose(rng, 30)} {shared} {fx.prose(rng, 25)}") for i in range(5)]
    return rows


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 8, 10)])
def test_components_equal_brute_force(spark, k, num, den):
    rows = near_copies(random.Random(k)) + fx.odd_rows()
    got = jaccard_components(fx.odd_frame(spark, rows), k, num, den).collect()
    want = fx.jaccard_components(rows, k, num, den)
    assert sorted((tuple(r[:3]) for r in got), key=ORDER) == sorted(want, key=ORDER)


def test_pairs_hold_every_link(spark):
    rows = near_copies(random.Random(9))
    pairs, members = jaccard_pairs(spark.createDataFrame(rows, "doc_id long, text string"), 3, 9, 10)
    member = {r.doc_id: r.class_id for r in members.collect()}
    got = {frozenset((r.a, r.b)) for r in pairs.collect()}
    want = set()
    sets = {d: fx.shingles(t, 3) for d, t in rows}
    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if member[a] != member[b] and 10 * n >= 9 * len(sets[a] | sets[b]):
                want.add(frozenset((member[a], member[b])))
    assert got == want and want
    assert pairs.count() == len(got)  # each once


def test_components_of_an_empty_table(spark):
    empty = fx.odd_frame(spark, [])
    assert jaccard_components(empty).count() == 0
    assert repeated_documents(empty).count() == 0
    assert remove_repeats(empty).columns == empty.columns


def test_connected_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)]
    random.Random(1).shuffle(edges)
    got = dict(tuple(r) for r in connected_components(
        spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "cc")).collect())
    assert {got[i] for i in range(41)} == {0} and {got[200 + i] for i in range(50)} == {100}


def test_bitmap_misses_none(spark):
    ids = [(i * 7919,) for i in range(500)] + [(None,)]
    bits = counters.bitmap(spark.createDataFrame(ids, "id long"), 1 << 20)
    import pyarrow as pa

    assert counters.marked(bits, pa.array([i for i, in ids], pa.int64())).all()
    assert counters.marked(bits, pa.array(range(1, 1000), pa.int64())).sum() < 20


def passages(rng):
    """Passages of 45 to 120 words in several documents, some nested, some shifted."""
    texts = [fx.prose(rng, rng.randrange(20, 400)).split() for _ in range(60)]
    for size in (45, 49, 50, 51, 60, 120, 80, 55):
        p = fx.prose(rng, size).split()
        for _ in range(rng.randrange(2, 6)):
            t = rng.choice(texts)
            at = rng.randrange(len(t) + 1)
            part = p if rng.random() < 0.6 else p[rng.randrange(0, 10):]
            t[at:at] = part
    texts += [texts[0], texts[0], texts[5][:-1] + ["other"]]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_words_equal_brute_force(spark, seed):
    rows = passages(random.Random(seed))
    got = {r.doc_id: {x for s in r.repeated for x in range(s.start, s.stop)}
           for r in repeated_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == fx.repeated_words(rows)


@pytest.mark.parametrize("seed", [4, 5])
def test_removal_keeps_one_copy_of_everything(spark, seed):
    rows = passages(random.Random(seed))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {r.doc_id: {x for s in r.removable for x in range(s.start, s.stop)} for r in repeated_documents(docs).collect()}
    holders = {}
    for d, t in rows:
        w = t.split()
        for j in range(len(w) - 49):
            holders.setdefault(tuple(w[j:j + 50]), []).append((d, j))
    for places in holders.values():
        if len({d for d, _ in places}) > 1:  # a repeated run of words stays whole in one document at most
            assert len({d for d, j in places if not gone.get(d, set()) & set(range(j, j + 50))}) <= 1
    out = {r.doc_id: r.text for r in remove_repeats(docs).collect()}
    # nothing but later copies goes: each word is left somewhere, and all other words stay in order
    assert {x for t in out.values() for x in t.split()} == {x for _, t in rows for x in t.split()}
    for d, t in rows:
        w = [x for j, x in enumerate(t.split()) if j not in gone.get(d, set())]
        assert out.get(d, "").split() == w
        if d not in gone:
            assert out[d] == t


def test_repeats_of_odd_rows(spark):
    rows = fx.odd_rows()
    got = {r.doc_id: r for r in repeated_documents(fx.odd_frame(spark)).collect()}
    assert set(got) == {5, 6}  # the two equal long texts
    assert got[5].n_removable_words == 0 and got[6].n_removable_words == 30_000
    out = remove_repeats(fx.odd_frame(spark))
    assert out.columns == fx.odd_frame(spark).columns
    assert out.count() == len(rows) - 1  # the later long text goes


def test_a_hot_passage_is_found_in_all_its_documents(spark):
    rng = random.Random(8)
    shared = fx.prose(rng, 70)
    rows = [(i, f"{fx.prose(rng, 20)} {shared} {fx.prose(rng, 20)}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in repeated_spans(docs).where("later").select("doc_id").distinct().collect()} == set(range(1, 200))
    out = {r.doc_id: r.text for r in remove_repeats(docs).collect()}
    first: dict = {}  # of each run of 50 words the smallest document; neighbours of the passage are shared by chance, too
    words = [t.split() for _, t in rows]
    for i, w in enumerate(words):
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j:j + 50]), i)
    gone = [{x for j in range(len(w) - 49) if first[tuple(w[j:j + 50])] < i for x in range(j, j + 50)} for i, w in enumerate(words)]
    assert all(out[i].split() == [x for j, x in enumerate(w) if j not in gone[i]] for i, w in enumerate(words))
    assert out[0] == rows[0][1] and all(38 <= len(out[i].split()) <= 40 for i in range(1, 200))


def test_continuations_of_a_hot_boilerplate_are_found(spark):
    rng = random.Random(21)
    core = fx.prose(rng, 45)
    after = [fx.prose(rng, 10) for _ in range(30)]
    rows = [(i, f"{fx.prose(rng, 30)} {core} {after[i % 700] if i % 700 < 30 else fx.prose(rng, 10)} {fx.prose(rng, 20)}")
            for i in range(1400)]
    got = {r.doc_id: {x for s in r.repeated for x in range(s.start, s.stop)}
           for r in repeated_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == fx.repeated_words(rows) and len(got) >= 60


def test_a_passage_on_each_side_of_a_shared_core_is_found(spark):
    rng = random.Random(22)
    core, rows = fx.prose(rng, 40), []
    for _ in range(12):  # one shares what precedes with the third, another what follows
        left, right = fx.prose(rng, 15), fx.prose(rng, 15)
        for a, b in ((fx.prose(rng, 15), right), (left, fx.prose(rng, 15)), (left, right)):
            rows.append((len(rows), f"{fx.prose(rng, 20)} {a} {core} {b} {fx.prose(rng, 20)}"))
    rows += [(len(rows) + i, f"{fx.prose(rng, 35)} {core} {fx.prose(rng, 35)}") for i in range(200)]
    got = {r.doc_id: r for r in repeated_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    words = lambda spans: {x for s in spans for x in range(s.start, s.stop)}
    assert {d: words(r.repeated) for d, r in got.items()} == fx.repeated_words(rows)
    assert all(words(got[d].removable) >= set(range(20, 90)) for d in range(2, 36, 3))


def test_no_head_is_scanned_in_one_task(spark, monkeypatch):
    plans, write = [], Scratch.write

    def noted(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df)

    monkeypatch.setattr(Scratch, "write", noted)
    rng = random.Random(23)
    core = fx.prose(rng, 30)
    rows = [(i, f"{fx.prose(rng, 30)} {core} {fx.prose(rng, 30)}") for i in range(40)]
    spans = repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    plans.append(spans._jdf.queryExecution().executedPlan().toString())
    lines = [p.splitlines() for p in plans]
    assert any("MapInArrow" in x for p in lines for x in p)
    assert not any("MapInArrow" in x and "Sort " in y for p in lines for x, y in zip(p, p[1:]))
