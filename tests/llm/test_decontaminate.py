"""Benchmark decontamination against brute force over word lists."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from convlytics.llm import decontaminate as D
from convlytics.llm import textkit as T

from . import fixtures as fx

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BENCH = "item_id long, text string"


def words(t):
    return re.findall(WORD, fx.lower(t or ""))


def windows(items, k):
    out = {}
    for i, t in items:
        w = words(t)
        m = min(k, len(w))
        for j in range(len(w) - m + 1 if m else 0):
            out.setdefault(tuple(w[j:j + m]), set()).add("" if i is None else str(i))
    return out


def plain(rows, items, k):
    """(doc_id, words, hit words, items) of every row."""
    win, out = windows(items, k), []
    for d, t in rows:
        w, hit, who = words(t), set(), set()
        for m in {len(x) for x in win}:
            for j in range(len(w) - m + 1):
                if tuple(w[j:j + m]) in win:
                    hit |= set(range(j, j + m))
                    who |= win[tuple(w[j:j + m])]
        out.append((d, len(w), len(hit), sorted(who)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    items = [(i, fx.prose(rng, rng.choice([0, 1, 3, 9, 10, 11, 25, 60]), 40)) for i in range(30)]
    items += [(7, fx.prose(rng, 20)), (None, fx.prose(rng, 12)), (99, None), (100, ""), (101, items[5][1])]
    rows = []
    for d in range(300):
        t = fx.prose(rng, rng.randrange(60), 40 if d % 3 else 5000)
        if d % 5 == 0:
            w = words(rng.choice(items)[1])
            a = rng.randrange(max(1, len(w)))
            t = " ".join([t, *w[a:a + rng.choice([5, 9, 10, 30])]]).upper()
        rows.append((d, t))
    shared = items[-4][1]
    rows += [(1000 + i, f"{fx.prose(rng, 3)} {shared}") for i in range(40)]
    return rows, items


def key(r):
    return (r[0] is not None, r[0] or 0, *r[1:])


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n, sorted(r["items"])) for r in df.withColumn("n", D.n_hit()).collect()), key=key)


@pytest.mark.parametrize("k", [4, 10])
def test_scan_equals_brute_force_in_one_block_and_in_many(spark, k):
    rows, items = corpus(k)
    rows += fx.odd_rows()
    docs, bench = fx.odd_frame(spark, rows).repartition(3), spark.createDataFrame(items, BENCH)
    want = sorted(plain(rows, items, k), key=key)
    assert found(D.scan(docs, bench, k)) == want
    assert sum(r[2] > 0 for r in want) > 40
    assert found(D.scan(docs, bench, k, block_bytes=1500)) == want


@pytest.mark.parametrize("block", [D.BLOCK_BYTES, 2000])
def test_documents_with_a_window_go_and_all_others_stay_as_they_are(spark, block):
    rows, items = corpus(3)
    rows += fx.odd_rows()
    docs, bench = fx.odd_frame(spark, rows), spark.createDataFrame(items, BENCH)
    clean = {i for i, r in enumerate(plain(rows, items, 10)) if not r[2]}
    out = D.decontaminate(docs, bench, block_bytes=block)
    assert out.columns == docs.columns
    want = sorted((repr((rows[i][0], rows[i][1])) for i in clean))
    assert sorted(repr((r.doc_id, r.text)) for r in out.collect()) == want


def test_longest_matches_equal_brute_force(spark):
    rows, items = corpus(11)
    items = [x for x in items if x[0] is not None and len(words(x[1])) >= 10]
    got = {r.item_id: tuple(r)[1:] for r in
           D.longest_matches(spark.createDataFrame(rows, "doc_id long, text string").repartition(4),
                             spark.createDataFrame(items, BENCH)).collect()}
    want = {}
    for i, t in items:
        w = words(t)
        for d, text in rows:
            x = words(text)
            for a in range(len(w) - 9):
                for b in range(len(x) - 9):
                    n = 0
                    while a + n < len(w) and b + n < len(x) and w[a + n] == x[b + n]:
                        n += 1
                    if n >= 10:
                        best = (-n, d, a, b)
                        if str(i) not in want or best < want[str(i)]:
                            want[str(i)] = best
    assert got == {i: (-n, a, d, b) for i, (n, d, a, b) in want.items()} and len(got) > 5


def test_suffix_array_is_in_order():
    rng = np.random.default_rng(5)
    for n_codes, n in ((1, 40), (2, 300), (5, 300), (300, 500), (70_000, 300)):
        codes = np.append(rng.integers(0, n_codes + 1, n), [0])
        kind = D.Keys(n_codes + 1)
        order = D.suffix_array(kind.pack(codes), kind, 64)

        def suffix(p):
            out = []
            while codes[p] and len(out) < 64:
                out.append(codes[p])
                p += 1
            return out

        got = [suffix(p) for p in order]
        assert sorted(order) == list(np.flatnonzero(codes)) and got == sorted(got)


def test_empty_tables(spark):
    rows, items = corpus(2)
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, BENCH)
    none = bench.where("item_id = -1")
    assert D.scan(docs.where("doc_id < 0"), bench).collect() == []
    assert found(D.scan(docs, none)) == sorted(plain(rows, [], 10), key=key)
    assert D.decontaminate(docs, none).count() == len(rows) and D.longest_matches(docs, none).collect() == []


def test_query_on_the_smallest_tables(spark):
    import __spark_entry__ as E

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    out = E.queries()["op13_decontaminate"](spark, sf)
    assert out.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = [(d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in plain(rows, items, 10)]
    assert sorted(map(tuple, out.collect())) == sorted(want) and any(w[2] for w in want)


def test_words_of_a_chunk():
    h, first = D.words_of(next(T.chunks(pa.array(["A b", None, "b a!"]))))
    assert list(first) == [0, 2, 2, 4] and h[0] == h[3] and h[1] == h[2]
