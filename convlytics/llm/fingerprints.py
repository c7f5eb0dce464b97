"""Document fingerprints by content-defined chunking.

A gear hash rolls over a text's UTF-8 bytes; a chunk ends where its top bits
are zero, with a stricter test before the usual chunk size and a looser one
after it (normalised chunking), between a smallest and a largest size.
Boundaries follow the content, so an insertion changes the chunks around it
and no others.  The fingerprint is the set of chunk digests with the chunks'
lengths; the likeness of two is the share of the first one's bytes that stand
in chunks of the second (containment, 0 to 1).

Edited texts need a document's neighbour in the order of ids.  Documents are
dealt by ranges of ids and sorted, so a neighbour is the next row of the same
task; only the first and last document of each range meet in a small join.

Defined results: a null text counts as empty; empty texts have the empty
fingerprint, which is wholly contained in any empty one and in no other
(likeness 1 and 0).  Null ids come last in the order; equal ids follow one
another in the order of their texts' digests.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convlytics.llm import textkit as T

#: chunk sizes in bytes: smallest, usual, largest
SIZES = (16, 64, 256)
#: zero bits asked for before and after the usual size
STRICT_BITS, LOOSE_BITS = 8, 5
#: bytes of text that a task works on at once
BLOCK = 1 << 20

_GEAR = np.random.default_rng(7_919).integers(0, 2**32, 256, dtype=np.uint32)
_PAIR = np.dtype([("digest", ">u4"), ("length", ">u2")])


def gear(chunk: T.Chunk) -> np.ndarray:
    """Gear hash at each byte: the last 32 bytes of the document, newest lowest."""
    n = len(chunk)
    # 32 empty places before each document: nothing of the one before is left
    shift = np.repeat(np.arange(1, n + 1) * 32, np.diff(chunk.off))
    at = np.arange(len(chunk.buf)) + shift
    h = np.zeros(len(chunk.buf) + 32 * (n + 1), np.uint32)
    h[at] = _GEAR[chunk.buf]
    for step in (1, 2, 4, 8, 16):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h[at]


def chunk_sets(chunk: T.Chunk) -> list[np.ndarray]:
    """Each document's distinct (digest, length) pairs, by digest."""
    if not len(chunk.buf):
        return [np.zeros(0, _PAIR) for _ in range(len(chunk))]
    least, usual, most = SIZES
    h = gear(chunk)
    loose = np.flatnonzero(h >> np.uint32(32 - LOOSE_BITS) == 0)
    strict = loose[h[loose] >> np.uint32(32 - STRICT_BITS) == 0]
    loose, strict = loose.tolist(), strict.tolist()
    ends, counts = [], []
    for a, b in zip(chunk.off[:-1].tolist(), chunk.off[1:].tolist()):
        before = len(ends)
        at = a
        while at < b:
            # a boundary is the last byte of its chunk
            i = bisect_left(strict, at + least - 1)
            if i < len(strict) and strict[i] < at + usual - 1:
                cut = strict[i] + 1
            else:
                i = bisect_left(loose, at + usual - 1)
                cut = loose[i] + 1 if i < len(loose) and loose[i] < at + most - 1 else at + most
            at = min(cut, b)
            ends.append(at)
        counts.append(len(ends) - before)
    end = np.array(ends, np.int64)
    start = np.concatenate([[0], end[:-1]])
    pairs = np.zeros(len(end), _PAIR)
    pairs["digest"] = T.span_hashes(chunk.buf, start, end) >> np.uint64(32)
    pairs["length"] = end - start
    out = []
    for own in np.split(pairs, np.cumsum(counts)[:-1]):
        _, first = np.unique(own["digest"], return_index=True)
        out.append(own[first])
    return out


def as_string(pairs: np.ndarray) -> str:
    """12 hex digits per chunk: digest and length, by digest."""
    return pairs.tobytes().hex()


def from_string(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), _PAIR)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of a's bytes in chunks that b has, too."""
    if not len(a):
        return 0.0 if len(b) else 1.0
    if not len(b):
        return 0.0
    x, y = a["digest"].astype(np.uint32), b["digest"].astype(np.uint32)
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    size = a["length"].astype(np.int64)
    return float(size[y[at] == x].sum() / size.sum())


def fingerprint_texts(texts: list[str]) -> list[np.ndarray]:
    out = []
    for c in T.chunks(pa.array(texts, pa.string())):
        out.extend(chunk_sets(c))
    return out


def edited(text: str, following: str) -> str:
    """``text`` whose last third is replaced by the beginning of ``following``."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


FIELDS = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _compare(own: list[str], following: list[str], own_prints, next_prints) -> list[tuple]:
    changed = [edited(a, b) for a, b in zip(own, following)]
    out = []
    for t, e, f, g, n in zip(own, changed, own_prints, fingerprint_texts(changed), next_prints):
        out.append((len(t), hashlib.sha256(e.encode("utf-8")).hexdigest(), as_string(f), as_string(g),
                    likeness(f, g), likeness(f, n)))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row: the general interface."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = src.select("doc_id").schema.add("fingerprint", "string")

    def run(batches):
        for b in batches:
            for c in T.chunks(b.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(c.lo, len(c)), pa.array([as_string(p) for p in chunk_sets(c)], pa.string())],
                    ["doc_id", "fingerprint"])

    return src.mapInArrow(run, schema)


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row doc_id and FIELDS, the next document being that of the next smaller id."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # rows of one id are in the order of their texts' digests, so no text is among the keys that are sampled
    order = [F.col("doc_id").desc_nulls_last(), F.col("digest")]
    # a stated number of ranges: all readers below see the same ones
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (src.withColumn("digest", F.xxhash64("text")).repartitionByRange(ranges, *order)
            .sortWithinPartitions(*order, "text"))
    schema = f"doc_id long, {FIELDS}"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def batch(ids, done):
        cols = list(zip(*done)) if done else [[] for _ in names[1:]]
        return pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip([ids, *cols], kinds)], names)

    def run(batches):
        """Every row of a range but the last, which has no neighbour here."""
        ids, texts, prints, size = [], [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= BLOCK and len(texts) > 1:
                    prints = prints + fingerprint_texts(texts[len(prints):])
                    yield batch(ids[:-1], _compare(texts[:-1], texts[1:], prints[:-1], prints[1:]))
                    ids, texts, prints, size = ids[-1:], texts[-1:], prints[-1:], len(texts[-1])
        if len(texts) > 1:
            prints = prints + fingerprint_texts(texts[len(prints):])
            yield batch(ids[:-1], _compare(texts[:-1], texts[1:], prints[:-1], prints[1:]))

    def ends(batches):
        """A range's first text and its last row."""
        first = last = None
        for b in batches:
            if b.num_rows:
                first = b.column(1)[0].as_py() if first is None else first
                last = tuple(b.column(i)[b.num_rows - 1].as_py() for i in range(3))
        if last is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([first], pa.string()), pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.string()),
                 pa.array([last[2]], pa.int64())], ["first", "doc_id", "text", "digest"])

    def finish(batches):
        for b in batches:
            ids, own, following = (b.column(i).to_pylist() for i in range(3))
            yield batch(ids, _compare(own, following, fingerprint_texts(own), fingerprint_texts(following)))

    # one row per range, however many documents; after the last range comes the first.  A range is known by the
    # key of its last row, which no other has.  Which follows which is found from the keys alone, then each end
    # meets the beginning that follows
    edge, key = rows.mapInArrow(ends, "first string, doc_id long, text string, digest long"), F.struct("doc_id", "digest")
    by_key = Window.orderBy(*order)
    follows = edge.select(key.alias("me"), F.coalesce(F.lead(key).over(by_key), F.first(key).over(by_key)).alias("follower"))
    begins = edge.select(key.alias("follower"), F.col("first").alias("next"))
    pairs = edge.select(key.alias("me"), "doc_id", "text").join(follows, "me").join(begins, "follower").select("doc_id", "text", "next")
    return rows.mapInArrow(run, schema).union(pairs.mapInArrow(finish, schema))
