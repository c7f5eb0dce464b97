"""Repeated passages: suffixes at minimiser positions, compared by aggregates over their runs.

The suffixes kept are those of a sparse suffix array, but they are not sorted
and compared with neighbours: that order misses passages (see README).

A passage is a run of at least ``min_words`` white-space separated words that
stands, word for word, in two documents.

1. Every run of ``min_words`` words is assigned to the minimiser among the
   ``window`` 8-word hashes it begins with, selected by content alone: equal runs
   have equal minimisers, at equal distance from their beginning.  The
   ``min_words - window + 1`` words from a minimiser on, its head, belong to
   all runs of it; heads that only one document has go no further.
2. Suffixes with equal runs (the words before and after the head, as far as a
   run of it reaches) form a class; its smallest and its largest document speak
   for all.  Those two give the class's runs, one row each.
3. The smallest and the largest document of every run come from one aggregate.
   Where they differ, the run is repeated, and all suffixes of the classes that
   have it get the span.

Nothing depends on an order of neighbours or on the size of a group, so every
passage is found.  Sets of heads and classes are passed to tasks as bitmaps of
a bounded size: a hash taken twice lets a needless row through and drops none.
Groups meet in aggregates that combine before they shuffle and in joins of
written tables, whose hot keys are split by Spark's skew handling.

Of two copies the one with the larger doc_id is the later.  Removing what is
later leaves each passage in its first document: every removed word has an
equal one in an equal passage of a smaller doc_id.  Runs are compared by 64-bit
hashes next to the distance of their minimiser.

Defined results: a passage that repeats within one document only is none;
null, empty and short texts have no passage; rows with a null
doc_id are not compared; repeated rows of one doc_id and text are one document.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from convlytics.llm import counters
from convlytics.llm import textkit as T
from convlytics.llm.scratch import Scratch

MIN_WORDS = 50
#: words of the hashes among which minimisers are selected
GRAM = 8
#: consecutive hashes of which one is selected
WINDOW = 26
#: bits of a bitmap for each value in it, and at least and at most in all
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 28


def _digest(h: np.ndarray) -> tuple[int, int]:
    at = np.arange(len(h), dtype=np.uint64)
    pair = np.array([T.mix(h + at * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64),
                     T.mix((h ^ np.uint64(0x2545F4914F6CDD1D)) + at * np.uint64(0xD1342543DE82EF95)).sum(dtype=np.uint64)],
                    np.uint64)
    return tuple(T.signed(pair).tolist())


def _word_hashes(c: T.Chunk) -> tuple[np.ndarray, np.ndarray]:
    w = T.words(c, c.buf)
    return T.span_hashes(c.buf, w.start, w.end), w.first


def _runs(c: T.Chunk, min_words: int, window: int):
    """Runs of a chunk in text order: (word hashes, first word of each document,
    run hashes, distance of each run's minimiser, first run of each suffix,
    word position of each suffix, its class)."""
    h, first = _word_hashes(c)
    none = np.zeros(0, np.int64)
    if len(h) < min_words:
        return h, first, none.view(np.uint64), none, none, none, none.view(np.uint64)
    end = np.repeat(first[1:], np.diff(first))  # each word's document end
    key = T.window_hashes(h, min_words)
    at = np.flatnonzero(np.arange(len(key)) + min_words <= end[:len(key)])
    g = np.lib.stride_tricks.sliding_window_view(T.window_hashes(h, GRAM), window)[:len(key)]
    back = g.argmin(axis=1)[at]
    key, pos = key[at], at + back
    start = np.flatnonzero(np.diff(pos, prepend=-1))
    each = T.mix(key + back.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    group = T.mix(np.add.reduceat(each, start)) if len(start) else none.view(np.uint64)
    return h, first, key, back, start, pos[start], group


def _heads(h: np.ndarray, pos: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on."""
    keys = np.zeros(len(pos), np.uint64)
    for j in range(n):
        keys += h[pos + j] * T._MULT[j]
    return T.signed(T.mix(keys))


def suffixes(docs: DataFrame, min_words: int, window: int) -> DataFrame:
    """Per document: words, text digest, kept suffix positions, their heads and classes."""
    schema = "doc_id long, n_words int, d1 long, pos array<int>, head array<long>, class array<long>"

    def run(batches):
        for b in batches:
            for c in T.chunks(b.column(1)):
                h, first, _, _, _, pos, group = _runs(c, min_words, window)
                keys, group = _heads(h, pos, min_words - window + 1), T.signed(group)
                cut = np.searchsorted(pos, first)
                rows = range(len(c))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(c.lo, len(c)), pa.array(np.diff(first).astype(np.int32)),
                     pa.array([_digest(h[first[i]:first[i + 1]])[0] for i in rows], pa.int64()),
                     T.list_column([pos[cut[i]:cut[i + 1]] - first[i] for i in rows], pa.int32()),
                     T.list_column([keys[cut[i]:cut[i + 1]] for i in rows]),
                     T.list_column([group[cut[i]:cut[i + 1]] for i in rows])],
                    ["doc_id", "n_words", "d1", "pos", "head", "class"])

    return docs.mapInArrow(run, schema)


def _bitmap(ids: DataFrame):
    """Broadcast bitmap of a long column; its size follows the number of rows."""
    n = max(1, BITS_EACH * ids.count())
    bits = counters.bitmap(ids, min(max(1 << (n - 1).bit_length(), LEAST_BITS), MOST_BITS))
    return ids.sparkSession.sparkContext.broadcast(bits)


def _shared(raw: DataFrame, heads) -> DataFrame:
    """The suffixes of ``raw`` whose heads are in the bitmap."""

    def run(batches):
        for b in batches:
            pos, head, group = (b.column(i) for i in (3, 4, 5))
            n = np.diff(pos.offsets.to_numpy())
            own = np.flatnonzero(counters.marked(heads.value, head.flatten()))
            row = pa.array(np.repeat(np.arange(b.num_rows), n)[own])
            yield pa.RecordBatch.from_arrays(
                [b.column(i).take(row) for i in range(3)] + [pos.flatten().take(own), group.flatten().take(own)],
                ["doc_id", "n_words", "d1", "pos", "class"])

    return raw.mapInArrow(run, "doc_id long, n_words int, d1 long, pos int, class long")


def _speaks(group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """One long for a class and a document."""
    mixed = T.mix(doc.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return T.signed(T.mix(group.astype(np.uint64, copy=False) ^ mixed))


def _speakers(classes: DataFrame) -> DataFrame:
    """Numbers of the smallest and the largest document of each class."""

    def run(batches):
        for b in batches:
            group, lo, hi = (np.asarray(b.column(i)) for i in range(3))
            own = lo < hi
            ids = np.concatenate([_speaks(group.view(np.uint64), lo), _speaks(group[own].view(np.uint64), hi[own])])
            yield pa.RecordBatch.from_arrays([pa.array(ids)], ["id"])

    return classes.mapInArrow(run, "id long")


def _class_runs(docs: DataFrame, speakers, min_words: int, window: int) -> DataFrame:
    """The runs of the classes that a document speaks for."""

    def run(batches):
        for b in batches:
            ids = np.asarray(b.column(0))
            for c in T.chunks(b.column(1)):
                _, first, key, back, start, pos, group = _runs(c, min_words, window)
                doc = ids[c.lo + np.searchsorted(first, pos, side="right") - 1]
                said = counters.marked(speakers.value, pa.array(_speaks(group, doc)))
                n = np.diff(np.append(start, len(key)))
                own = np.repeat(said, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(T.signed(key[own])), pa.array(back[own].astype(np.int8)),
                     pa.array(np.repeat(T.signed(group), n)[own]), pa.array(np.repeat(doc, n)[own])],
                    ["key", "back", "class", "doc_id"])

    return docs.mapInArrow(run, "key long, back tinyint, class long, doc_id long")


def _stretches(runs: str):
    """An array of (back, lo, hi) as stretches (near, far, lo, hi) of neighbouring runs."""
    last = lambda done: F.element_at(done, -1)
    joins = lambda done, x: ((last(done)["far"] + 1 == x["back"]) & (last(done)["lo"] == x["lo"])
                             & (last(done)["hi"] == x["hi"]))
    part = lambda near, x: F.array(F.struct(
        near.alias("near"), x["back"].cast("int").alias("far"), x["lo"].alias("lo"), x["hi"].alias("hi")))
    return F.aggregate(
        F.array_sort(F.col(runs)), F.array().cast("array<struct<near:int,far:int,lo:bigint,hi:bigint>>"),
        lambda done, x: F.when((F.size(done) > 0) & joins(done, x),
                               F.concat(F.slice(done, 1, F.size(done) - 1), part(last(done)["near"], x)))
        .otherwise(F.concat(done, part(x["back"].cast("int"), x))))


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, window: int = WINDOW,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Matches (doc_id, d1, n_words, start, stop, later, other): words [start, stop)
    of document doc_id also stand in document ``other``; ``later`` where the
    other copy has the smaller doc_id.  ``other`` is the smallest document that
    has the words, and for that one the largest.  Spans of one document may overlap."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.where("doc_id is not null")
    ends = [F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")]
    raw = scratch.save(suffixes(docs, min_words, window).where(f"n_words >= {min_words}"))
    heads = scratch.save(raw.select("doc_id", F.explode("head").alias("head")).groupBy("head").agg(*ends)
                         .where("lo < hi").select("head"))
    rows = _shared(raw, _bitmap(heads))
    speakers = scratch.save(_speakers(rows.groupBy("class").agg(*ends)))
    runs = scratch.save(_class_runs(docs, _bitmap(speakers), min_words, window))
    # what is joined is written before: only then a hot key of the other side is split
    several = scratch.save(runs.groupBy("key", "back").agg(*ends).where("lo < hi"))
    found = scratch.save(
        runs.select("key", "back", "class").join(several, ["key", "back"])
        .groupBy("class").agg(F.collect_set(F.struct("back", "lo", "hi")).alias("runs"))
        .select("class", _stretches("runs").alias("at")))
    later = F.col("s.lo") < F.col("doc_id")
    return (rows.join(found, "class").select("doc_id", "d1", "n_words", "pos", F.explode("at").alias("s"))
            .select("doc_id", "d1", "n_words", (F.col("pos") - F.col("s.far")).alias("start"),
                    (F.col("pos") - F.col("s.near") + min_words).alias("stop"), later.alias("later"),
                    F.when(later, F.col("s.lo")).otherwise(F.col("s.hi")).alias("other")))


def _merge(spans: str):
    """Union of an array of (start, stop) structs as disjoint, ordered spans."""
    return F.aggregate(
        F.array_sort(F.col(spans)),
        F.array().cast("array<struct<start:int,stop:int>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["stop"] >= x["start"]),
            F.concat(F.slice(done, 1, F.size(done) - 1),
                     F.array(F.struct(F.element_at(done, -1)["start"].alias("start"),
                                      F.greatest(F.element_at(done, -1)["stop"], x["stop"]).alias("stop"))))
        ).otherwise(F.concat(done, F.array(x))))


def repeated_documents(docs: DataFrame, **kw) -> DataFrame:
    """One row per document with a repeated passage: doc_id, n_repeated_words,
    partner_id (smallest of the ``other`` documents), repeated and removable spans
    (word numbers, stop exclusive) and n_removable_words."""
    span = F.struct("start", "stop")
    per = (repeated_spans(docs, **kw).groupBy("doc_id")
           .agg(F.min("other").alias("partner_id"), F.collect_set(span).alias("r"),
                F.collect_set(F.when(F.col("later"), span)).alias("l"))
           .withColumn("repeated", _merge("r")).withColumn("removable", _merge("l")))
    size = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + (x["stop"] - x["start"]))
    return per.select("doc_id", size("repeated").alias("n_repeated_words"),
                      size("removable").alias("n_removable_words"), "partner_id", "repeated", "removable")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` without the later copies of repeated passages.

    All columns stay.  A text that is nothing but later copies goes with its
    row; a row without any later copy is kept as it is.
    """
    cuts = (repeated_spans(docs, id_col=id_col, text_col=text_col, **kw).where("later").groupBy("doc_id")
            .agg(F.collect_set(F.struct("d1", "start", "stop")).alias("cuts"))
            .select(F.col("doc_id").alias("__cut_id"), F.col("cuts").alias("__cuts")))

    names, at = docs.columns, docs.columns.index(text_col)
    schema = StructType([StructField(text_col, StringType()) if c == text_col else docs.schema[c] for c in names])
    cols = [F.col(c).cast("string").alias(c) if c == text_col else F.col(c) for c in names]
    joined = docs.join(cuts, docs[id_col].cast("long") == F.col("__cut_id"), "left").select(*cols, "__cuts")

    def run(batches):
        for b in batches:
            spans = b.column(len(names))
            hit = np.flatnonzero(np.asarray(spans.is_valid()) & np.asarray(b.column(at).is_valid())).tolist()
            if not hit:
                yield pa.RecordBatch.from_arrays(b.columns[:-1], names)
                continue
            text, stay = b.column(at).to_pylist(), np.ones(b.num_rows, bool)
            for i in hit:
                new = _without(text[i], spans[i].as_py())
                stay[i] = new is text[i] or re.search(r"[^\x20\x09-\x0D]", new) is not None
                text[i] = new
            columns = b.columns[:-1]
            columns[at] = pa.array(text, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(stay))

    return joined.mapInArrow(run, schema)


def _without(text: str, spans: list[dict]) -> str:
    """The text without the words of the spans that were found in this very text."""
    c = next(T.chunks(pa.array([text], pa.string())))
    w = T.words(c, c.buf)
    d1 = _digest(T.span_hashes(c.buf, w.start, w.end))[0]
    keep = np.ones(len(c.buf), bool)
    for s in spans:
        if s["d1"] == d1:
            stop = w.start[s["stop"]] if s["stop"] < len(w.start) else len(c.buf)
            keep[w.start[s["start"]]:stop] = False
    return text if keep.all() else c.buf[keep].tobytes().decode("utf-8")
