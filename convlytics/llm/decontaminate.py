"""Benchmark decontamination by suffix arrays over shards of the training texts.

A shard is a stretch of whole documents within a task.  Its words that occur in
the benchmark get dense codes, all others end a suffix, and the suffixes are
sorted by prefix doubling.  Every benchmark suffix is then looked up in the
array by binary search, a few words at a time: the interval that is left after
a window's words holds all places where the window stands, and narrowing on to
the last place gives the longest verbatim match and where it lies.

A window is ``window`` consecutive words of an item; an item with fewer words
is one window.  Document words inside an occurrence of a window are hit, and a
document with a hit word is contaminated.

The benchmark travels to the tasks in blocks of a checked size
(``BLOCK_BYTES`` of text).  One block needs one pass over the documents; a
larger benchmark is dealt to as many blocks as it needs, by hash, and the
passes hand on what they found in written tables, so neither the driver nor a
task ever holds more than one block.

Defined results: null and empty texts and items have no words; an item with a
null id has an empty one; rows of one item_id are one item; repeated documents
are judged one by one.  Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlytics.llm import textkit as T
from convlytics.llm.scratch import Scratch

#: words of a window
WINDOW = 10
#: benchmark text that one pass over the documents carries
BLOCK_BYTES = 8 << 20
#: least text of a shard; shards are no smaller than the benchmark block either
SHARD_BYTES = 1 << 20


class Keys:
    """``per`` word codes packed in one long; code 0 ends what a key holds."""

    def __init__(self, n_codes: int):
        self.bits = max(2, int(n_codes).bit_length())
        self.per = max(1, 62 // self.bits)

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """The key that begins at each position, followed by zeros."""
        out = np.zeros(len(codes), np.int64)
        for j in range(self.per - 1, -1, -1):
            # from the last word to the first: a zero code clears what follows it
            step = np.zeros(len(codes), np.int64)
            step[:len(codes) - j] = codes[j:]
            out = np.where(step > 0, (out >> self.bits) | (step << (self.bits * (self.per - 1))), 0)
        return out

    def open(self, keys: np.ndarray) -> np.ndarray:
        """Which keys are full, so that the words after them count."""
        return keys & ((1 << self.bits) - 1) > 0

    def words(self, keys: np.ndarray) -> np.ndarray:
        """Number of words in each key."""
        n = np.zeros(len(keys), np.int64)
        for j in range(self.per):
            n += (keys >> (self.bits * j)) & ((1 << self.bits) - 1) > 0
        return n

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of words that both keys begin with."""
        n, alike = np.zeros(len(a), np.int64), np.ones(len(a), bool)
        for j in range(self.per - 1, -1, -1):
            x, y = (a >> (self.bits * j)) & ((1 << self.bits) - 1), (b >> (self.bits * j)) & ((1 << self.bits) - 1)
            alike &= (x == y) & (x > 0)
            n += alike
        return n

    def after(self, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The least key above all that begin with the first n words of these."""
        left = self.bits * (self.per - n)
        return ((keys >> left) + 1) << left


def suffix_array(keys: np.ndarray, kind: Keys, depth: int) -> np.ndarray:
    """Positions with a word, ordered by the ``depth`` words that follow.

    The first sort is by whole keys; suffixes that are alike and go on are
    ordered by the rank of what follows, which doubles the words compared.
    """
    at = np.flatnonzero(keys > 0)
    order = at[np.argsort(keys[at], kind="stable")]
    sorted_keys = keys[order]
    head = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(order) else at
    rank = np.zeros(len(keys) + 1, np.int64)  # the last one stands for what lies beyond the shard
    first = np.repeat(head, np.diff(np.concatenate([head, [len(order)]])))
    rank[order] = first + 1
    size = np.diff(np.concatenate([head, [len(order)]]))
    tied = np.flatnonzero(np.repeat(size > 1, size) & kind.open(sorted_keys))
    seen = kind.per
    while len(tied) and seen < depth:
        pos = order[tied]
        follows = rank[np.minimum(pos + seen, len(keys))]
        sub = np.lexsort((follows, rank[pos]))
        pos, follows = pos[sub], follows[sub]
        order[tied] = pos
        group = rank[pos]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (follows[1:] != follows[:-1])])
        start = np.flatnonzero(new)
        size = np.diff(np.concatenate([start, [len(pos)]]))
        rank[pos] = np.repeat(tied[start] + 1, size)
        tied = tied[np.repeat(size > 1, size) & (follows > 0)]
        seen *= 2
    return order


def _within(size: np.ndarray) -> np.ndarray:
    """0, 1, ... size - 1 for each size, one after the other."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def _bound(keys, order, lo, hi, off, value) -> np.ndarray:
    """First place in [lo, hi) of the array whose key at ``off`` words is no less than value."""
    lo, hi = lo.copy(), hi.copy()
    last = len(keys) - 1
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) >> 1
        less = keys[np.minimum(order[mid] + off[live], last)] < value[live]
        lo[live[less]] = mid[less] + 1
        hi[live[~less]] = mid[~less]
        live = live[lo[live] < hi[live]]
    return lo


class Probe:
    """A benchmark block, ready to be looked up: codes of its words, its
    suffixes and the items of its distinct windows."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.ids = sorted({i for i, _ in items})
        number = {x: n for n, x in enumerate(self.ids)}
        self.bytes = sum(len(t.encode()) for _, t in items if t)
        texts, owner = [], []
        for i, t in items:
            if t:
                texts.append(t)
                owner.append(number[i])
        hashes, runs = [], []
        for c in T.chunks(pa.array(texts, pa.string())):
            h, first = words_of(c)
            hashes.append(h)
            runs += list(np.diff(first))
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.vocabulary, code = np.unique(flat, return_inverse=True)
        # items one after the other, a zero behind each
        self.codes = np.zeros(len(flat) + len(runs) + 1, np.int64)
        n_words = np.array(runs, np.int64)
        starts = np.concatenate([[0], np.cumsum(n_words + 1)])[:-1].astype(np.int64) if runs else np.zeros(0, np.int64)
        inside = np.arange(len(flat)) + np.repeat(np.arange(len(runs)), n_words) if len(flat) else np.zeros(0, np.int64)
        self.codes[inside] = code + 1
        self.kind = Keys(len(self.vocabulary) + 1)
        self.keys = self.kind.pack(self.codes)
        width = np.minimum(n_words, window)
        count = np.maximum(0, n_words - width + 1) * (n_words > 0)
        #: places of windows, their words, the words left in the item, the item
        self.at = np.repeat(starts, count) + _within(count)
        self.width = np.repeat(width, count)
        self.left = np.repeat(starts + n_words, count) - self.at
        self.item = np.repeat(np.array(owner, np.int64), count)
        self.start = self.at - np.repeat(starts, count)
        self.longest = int(n_words.max()) if runs else 0
        self._classes(window)

    def _classes(self, window: int) -> None:
        """Equal windows are one class; ``items[first[c]:first[c + 1]]`` have class c."""
        rows = np.zeros((len(self.at), window), np.int64)
        for j in range(window):
            rows[:, j] = np.where(j < self.width, self.codes[np.minimum(self.at + j, len(self.codes) - 1)], 0)
        if len(rows):
            _, self.sample, self.cls = np.unique(rows, axis=0, return_index=True, return_inverse=True)
            self.cls = self.cls.reshape(-1)
        else:
            self.sample = self.cls = np.zeros(0, np.int64)
        pairs = np.unique(np.stack([self.cls, self.item], 1), axis=0) if len(rows) else np.zeros((0, 2), np.int64)
        self.items = pairs[:, 1]
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(self.sample) + 1))

    def code(self, h: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 1, 0)


def words_of(c: T.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a chunk and each document's first word."""
    buf = T.lower(c.buf)
    w = T.words(c, buf, T.ALNUM)
    return T.span_hashes(buf, w.start, w.end), w.first


class Shard:
    """The suffix array of a stretch of documents, for one probe."""

    def __init__(self, h: np.ndarray, first: np.ndarray, probe: Probe):
        self.first, self.probe, self.kind = first, probe, probe.kind
        n = len(h)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        #: words one after the other, a zero behind each document
        self.codes = np.zeros(n + len(first), np.int64)
        self.place = np.arange(n) + doc
        self.codes[self.place] = probe.code(h)
        self.start = first + np.arange(len(first))
        self.keys = self.kind.pack(self.codes)
        self.order = suffix_array(self.keys, self.kind, probe.longest)
        self.sorted = self.keys[self.order]

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, at, "right") - 1

    def _narrow(self, lo, hi, test, off, words):
        """Those of [lo, hi) that go on like the tests' ``words`` words at ``off``."""
        n = np.minimum(words, self.kind.per)
        keys = self.probe.keys[self.probe.at[test] + off]
        least = (keys >> (self.kind.bits * (self.kind.per - n))) << (self.kind.bits * (self.kind.per - n))
        over = self.kind.after(keys, n)
        if not off.any():
            return np.searchsorted(self.sorted, least), np.searchsorted(self.sorted, over)
        return _bound(self.keys, self.order, lo, hi, off, least), _bound(self.keys, self.order, lo, hi, off, over)

    def windows(self, test: np.ndarray):
        """(tests that occur, their intervals of the array)."""
        lo, hi = np.zeros(len(test), np.int64), np.full(len(test), len(self.order), np.int64)
        off = 0
        while True:
            on = self.probe.width[test] > off
            if not on.any():
                return test, lo, hi
            lo[on], hi[on] = self._narrow(lo[on], hi[on], test[on], np.full(int(on.sum()), off), self.probe.width[test[on]] - off)
            keep = lo < hi
            test, lo, hi = test[keep], lo[keep], hi[keep]
            off += self.kind.per

    def occurrences(self):
        """(position, class) of every occurrence of a window."""
        test, lo, hi = self.windows(self.probe.sample)
        size = hi - lo
        at = np.repeat(lo, size) + _within(size)
        return self.order[at], np.repeat(self.probe.cls[test], size)

    def longest(self):
        """Of each test suffix whose window occurs: words of its longest match, a position where it stands."""
        test, lo, hi = self.windows(np.arange(len(self.probe.at)))
        size, where = np.zeros(len(test), np.int64), self.order[lo] if len(test) else lo
        live, off = np.arange(len(test)), 0
        while len(live):
            t, off_ = test[live], np.full(len(live), off)
            left = np.maximum(0, self.probe.left[t] - off)
            l2, h2 = self._narrow(lo[live], hi[live], t, off_, np.minimum(left, self.kind.per))
            whole = (l2 < h2) & (left > self.kind.per)
            # where it ends: the neighbours of the place where the test belongs
            done = np.flatnonzero(~whole)
            for step in (-1, 0):
                i = np.clip(l2[done] + step, lo[live[done]], hi[live[done]] - 1)
                p = self.order[i]
                n = off + self.kind.same(self.keys[np.minimum(p + off, len(self.keys) - 1)],
                                         self.probe.keys[self.probe.at[t[done]] + off])
                better = n > size[live[done]]
                size[live[done[better]]], where[live[done[better]]] = n[better], p[better]
            lo[live], hi[live] = np.where(whole, l2, lo[live]), np.where(whole, h2, hi[live])
            live, off = live[whole], off + self.kind.per
        return test, size, where


def _shards(b: pa.RecordBatch, col: int, probe: Probe) -> Iterator[tuple[T.Chunk, np.ndarray, np.ndarray]]:
    for c in T.chunks(b.column(col), max(SHARD_BYTES, probe.bytes)):
        yield c, *words_of(c)


def _found(shard: Shard, n_docs: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per document: hit words as (start, end) pairs, one after the other; numbers of its items."""
    at, cls = shard.occurrences()
    probe = shard.probe
    cover = np.zeros(len(shard.codes) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + probe.width[probe.sample[cls]], -1)
    hit = np.cumsum(cover[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))  # start, end, start, ...
    run_doc = shard.document(edge[::2])
    doc = shard.document(at)
    n_cls, n_item = max(1, len(probe.sample)), max(1, len(probe.ids))
    pair_doc, pair_cls = np.divmod(np.unique(doc * n_cls + cls), n_cls)
    size = probe.first[pair_cls + 1] - probe.first[pair_cls]
    item = probe.items[np.repeat(probe.first[pair_cls], size) + _within(size)]
    item_doc, item = np.divmod(np.unique(np.repeat(pair_doc, size) * n_item + item), n_item)
    cut, by = np.searchsorted(run_doc, np.arange(n_docs + 1)), np.searchsorted(item_doc, np.arange(n_docs + 1))
    return ([edge[2 * cut[i]:2 * cut[i + 1]] - shard.start[i] for i in range(n_docs)],
            [item[by[i]:by[i + 1]] for i in range(n_docs)])


def probes(bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[Probe]:
    """The benchmark in blocks of about ``block_bytes``, one at a time."""
    rows = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for i in range(n):
        yield Probe([(r["item_id"], r["text"]) for r in dealt.where(F.col("block") == i).collect()], window)


def _union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of two lists of (start, end) pairs."""
    p = np.concatenate([a, b]).reshape(-1, 2)
    p = p[np.argsort(p[:, 0], kind="stable")]
    out: list[int] = []
    for s, e in p.tolist():
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return np.array(out, np.int64)


def _pass(rows: DataFrame, probe: Probe, first: bool, last: bool) -> DataFrame:
    """One probe over all documents; the text goes on only to another pass."""
    schema = "doc_id long, " + ("" if last else "text string, ") + "n_words long, hits array<int>, items array<string>"
    held = rows.sparkSession.sparkContext.broadcast(probe)

    def run(batches):
        probe = held.value
        names = np.array(probe.ids, object)
        for b in batches:
            for c, h, begin in _shards(b, 1, probe):
                n = len(c)
                hits, items = _found(Shard(h, begin, probe), n)
                named = [names[x].tolist() for x in items]
                if not first:
                    old = b.slice(c.lo, n)
                    hits = [_union(np.array(x, np.int64), y) for x, y in zip(old.column(3).to_pylist(), hits)]
                    named = [sorted({*x, *y}) for x, y in zip(old.column(4).to_pylist(), named)]
                cols = [b.column(0).slice(c.lo, n), pa.array(np.diff(begin)), T.list_column(hits, pa.int32()),
                        pa.array(named, pa.list_(pa.string()))]
                fields = ["doc_id", "n_words", "hits", "items"]
                if not last:
                    cols, fields = [cols[0], b.column(1).slice(c.lo, n), *cols[1:]], [fields[0], "text", *fields[1:]]
                yield pa.RecordBatch.from_arrays(cols, fields)

    return rows.mapInArrow(run, schema)


def _passes(rows: DataFrame, blocks: Iterator[Probe], one) -> DataFrame:
    """``one(rows, probe, first, last)`` for every block, with a written table between two of them."""
    scratch, path, first = Scratch(rows.sparkSession, "decontaminate"), None, True
    probe = next(blocks)
    while True:
        ahead = next(blocks, None)
        rows = one(rows, probe, first, ahead is None)
        if ahead is None:
            return rows
        rows, new = scratch.write(rows)
        if path:
            scratch.drop(path)
        probe, path, first = ahead, new, False


def scan(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, hits, items) of every document: its hit words as
    starts and ends in turn, and the ids of the items with windows in it."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return _passes(rows, probes(bench, window, block_bytes), _pass)


def n_hit(hits: str = "hits") -> Column:
    """Words in a list of starts and ends in turn."""
    return F.aggregate(F.transform(hits, lambda x, i: F.when(i % 2 == 1, x.cast("long")).otherwise(-x.cast("long"))),
                       F.lit(0).cast("long"), lambda a, x: a + x)


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without those that a window of the benchmark stands in."""
    at, fields = docs.columns.index("text"), docs.schema

    def one(rows, probe, first, last):
        held = rows.sparkSession.sparkContext.broadcast(probe)

        def run(batches):
            for b in batches:
                for c, h, begin in _shards(b, at, held.value):
                    hits, _ = _found(Shard(h, begin, held.value), len(c))
                    yield b.slice(c.lo, len(c)).filter(pa.array([not len(x) for x in hits]))

        return rows.mapInArrow(run, fields)

    return _passes(docs, probes(bench, window, block_bytes), one)


def longest_matches(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each item's longest verbatim match in the documents, if a window of it occurs:
    (item_id, n_words, item_start, doc_id, doc_start), in words.

    Of equal ones the smallest doc_id and places count.  Tasks keep one match
    for each item, so what is shuffled does not grow with a hot passage.
    """
    schema = "item_id string, n_words long, item_start long, doc_id long, doc_start long"
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = None
    for probe in probes(bench, window, block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(probe)

        def run(batches, held=held):
            probe, best = held.value, {}
            for b in batches:
                ids = np.asarray(b.column(0))
                for c, h, first in _shards(b, 1, probe):
                    shard = Shard(h, first, probe)
                    test, size, where = shard.longest()
                    doc = shard.document(where)
                    for t, n, p, d in zip(test.tolist(), size.tolist(), where.tolist(), doc.tolist()):
                        row = (-n, int(ids[c.lo + d]), int(probe.start[t]), p - int(shard.start[d]))
                        i = int(probe.item[t])
                        if i not in best or row < best[i]:
                            best[i] = row
            out = [(probe.ids[i], -n, s, d, p) for i, (n, d, s, p) in best.items()]
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("item_id", "n_words", "item_start", "doc_id", "doc_start"), r)) for r in out],
                pa.schema([("item_id", pa.string())] + [(x, pa.int64()) for x in ("n_words", "item_start", "doc_id", "doc_start")]))

        part = rows.mapInArrow(run, schema)
        parts = part if parts is None else parts.union(part)
    first = F.min(F.struct((-F.col("n_words")).alias("n"), "doc_id", "item_start", "doc_start"))
    return (parts.groupBy("item_id").agg(first.alias("m"))
            .select("item_id", (-F.col("m.n")).alias("n_words"), "m.item_start", "m.doc_id", "m.doc_start"))
