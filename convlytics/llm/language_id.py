"""Language identification by nearest centroids.

A text is the L2-normalised TF-IDF vector of its hashed byte n-grams (lengths
2 to 4, over lower-cased letters, everything else being one space).  Each
language has several centroids, found by spherical k-means; a text takes the
language of the centroid with the largest cosine.  A text that is much farther
from all centroids than the learned texts of that language and length are is
rejected.

The inverse document frequencies and the bounds of rejection count every learned
document.  The centroids are fitted on a sample of about ``sample`` documents
per language, chosen by hash.  Prediction reads nothing but the text.

Defined results: null text and text without a letter get ``und`` with score 0
and are rejected.  Documents with a null id or null language are not learned
from.  Without any document to learn from, every prediction is ``und``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlytics.llm import counters
from convlytics.llm import textkit as T

DIMS = 1 << 13
GRAMS = (2, 3, 4)
#: learned documents per language that the centroids are fitted on, about
SAMPLE = 600
CENTROIDS = 3
#: languages that are learned at most, the most frequent ones
LANGUAGES = 500
#: quantile of the cosines of the learned texts of a language and length, and
#: the share of it below which a text is rejected
LOW, SLACK = 0.01, 0.5
#: length classes and steps of the cosine that learned texts are counted in
LENGTHS, STEPS = 32, 128
#: softness of the score over languages
TEMPERATURE = 0.05
#: learned texts of a length and language from which its bound is taken
SEEN = 20
BLOCK_DOCS = 64

_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)


def histograms(col: pa.Array, dims: int):
    """(first row, counts of hashed n-grams) for blocks of documents; the
    counts are rows by dims."""
    col = pc.utf8_lower(T.as_strings(col))
    for at in range(0, len(col), BLOCK_DOCS):
        for c in T.chunks(col.slice(at, BLOCK_DOCS)):
            n = len(c)
            buf = np.insert(_LETTER[c.buf], c.off[:-1], 0x20)
            buf = np.append(buf, np.uint8(0x20))
            off = c.off + np.arange(n + 1)
            keep = np.ones(len(buf), bool)
            keep[1:] = (buf[1:] != 0x20) | (buf[:-1] != 0x20)
            keep[off] = True
            kept = np.concatenate([[0], np.cumsum(keep)])
            buf, off = buf[keep].astype(np.uint32), kept[off]
            doc = np.repeat(np.arange(n), np.diff(off))
            stop = off[1:][doc]  # the next document's leading space may end a gram
            total = np.zeros(n * dims, np.int64)
            for g in GRAMS:
                m = len(buf) - g
                if m <= 0:
                    continue
                code = buf[:m].copy()
                for j in range(1, g):
                    code = code * np.uint32(0x01000193) ^ buf[j:m + j]
                slot = (code * np.uint32(0x9E3779B1) + np.uint32(g)) >> np.uint32(32 - (dims.bit_length() - 1))
                inside = np.arange(m) + g - 1 <= stop[:m]
                total += np.bincount((doc[:m] * dims + slot)[inside], minlength=n * dims)
            yield at + c.lo, total.reshape(n, dims)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts).astype(np.float32) * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.maximum(norm, 1e-12)


def _length(counts: np.ndarray) -> np.ndarray:
    """Length class: the power of two of the number of n-grams."""
    return np.log2(np.maximum(counts.sum(axis=1), 1)).astype(np.int64)


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, seeded by the rows farthest from the centroids so far."""
    c = x.mean(axis=0, keepdims=True)
    c /= max(np.linalg.norm(c), 1e-12)
    for _ in range(min(k, len(x)) - 1):
        c = np.vstack([c, x[(x @ c.T).max(axis=1).argmin()]])
    for _ in range(15):
        near = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (near == j).any():
                m = x[near == j].mean(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c.astype(np.float32)


def _floors(seen: np.ndarray) -> np.ndarray:
    """Low cosine by language and length from counts by language, length and step.

    Lengths with few texts take the nearest length's: that of a shorter one as it
    is, that of a longer one times the square root of the lengths' ratio, as the
    cosine of a text with few n-grams grows with the square root of their number.
    A language without enough texts of any length takes those of all languages.
    """
    def bounds(own):
        total = own.sum(axis=1)
        known = np.flatnonzero(total >= SEEN)
        if not len(known):
            return None
        low = (np.cumsum(own, axis=1) > LOW * total[:, None]).argmax(axis=1) / STEPS
        near = known[np.abs(np.arange(LENGTHS)[:, None] - known).argmin(axis=1)]
        return low[near] * np.sqrt(2.0 ** np.minimum(np.arange(LENGTHS) - near, 0))

    every = bounds(seen.sum(axis=0))
    each = [bounds(own) for own in seen]
    rest = np.zeros(LENGTHS) if every is None else every
    return np.stack([rest if x is None else x for x in each])


class Model:
    """Learned languages, their centroids and the low cosine by language and text length."""

    def __init__(self, idf, langs, centroids, floor):
        self.idf, self.langs, self.centroids, self.floor = idf, langs, centroids, floor

    def predict(self, counts: np.ndarray):
        """(language index, score, rejected) for rows of n-gram counts."""
        names = sorted(set(self.langs))
        cos = vectors(counts, self.idf) @ self.centroids.T
        best = np.stack([cos[:, [i for i, x in enumerate(self.langs) if x == l]].max(axis=1) for l in names], axis=1)
        top = best.argmax(axis=1)
        soft = np.exp((best - best.max(axis=1, keepdims=True)) / TEMPERATURE)
        score = soft[np.arange(len(top)), top] / soft.sum(axis=1)
        floor = self.floor[top, np.minimum(_length(counts), LENGTHS - 1)]
        return [names[i] for i in top], score.astype(float), best.max(axis=1) < SLACK * floor


def fit(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, dims: int = DIMS) -> Model | None:
    """Learn from all rows of ``docs`` (doc_id, text, lang) with text, id and language."""
    docs = docs.where("text is not null and lang is not null and doc_id is not null")

    def df_count(batches):
        total = np.zeros(dims + 1, np.int64)
        for b in batches:
            for _, h in histograms(b.column(0), dims):
                total[:dims] += (h > 0).sum(axis=0)
                total[dims] += len(h)
        yield from counters.slices(total)

    df = counters.total(docs.select("text").mapInArrow(T.task(df_count), counters.SCHEMA), dims + 1)
    if not df[dims]:
        return None
    idf = (np.log((1 + df[dims]) / (1 + df[:dims])) + 1).astype(np.float32)

    per = (docs.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(LANGUAGES)
           .withColumn("share", F.lit(sample) / F.col("count")))
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # at most LANGUAGES rows, broadcast so that no text moves before it is sampled
    picked = (docs.join(F.broadcast(per.select("lang", "share")), "lang").where(rank < F.col("share"))
              .select("lang", "text"))

    def cluster(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.vstack([h for _, h in histograms(pa.array(pdf["text"], pa.string()), dims)])
        return pd.DataFrame([{"lang": key[0], "centroid": r.tobytes()} for r in _kmeans(vectors(h, idf), centroids)])

    rows = picked.groupBy("lang").applyInPandas(cluster, "lang string, centroid binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["centroid"])))
    c = np.vstack([np.frombuffer(r["centroid"], np.float32) for r in rows])
    langs = [r["lang"] for r in rows]
    names = sorted(set(langs))
    shared = docs.sparkSession.sparkContext.broadcast((idf, c, np.array([names.index(l) for l in langs])))

    def cosines(batches):
        idf, c, owner = shared.value
        number = {l: i for i, l in enumerate(names)}
        total = np.zeros(len(names) * LENGTHS * STEPS, np.int64)
        for b in batches:
            lang = np.array([number.get(l, -1) for l in b.column(1).to_pylist()], np.int64)
            for at, h in histograms(b.column(0), dims):
                own = lang[at:at + len(h)]
                cos = np.where(owner == own[:, None], vectors(h, idf) @ c.T, -1.0).max(axis=1)
                ok = (own >= 0) & (h.sum(axis=1) > 0)
                step = np.clip(cos * STEPS, 0, STEPS - 1).astype(np.int64)
                place = (own * LENGTHS + np.minimum(_length(h), LENGTHS - 1)) * STEPS + step
                np.add.at(total, place[ok], 1)
        yield from counters.slices(total)

    size = len(names) * LENGTHS * STEPS
    seen = counters.total(docs.select("text", "lang").mapInArrow(cosines, counters.SCHEMA), size)
    return Model(idf, langs, c, _floors(seen.reshape(len(names), LENGTHS, STEPS)))


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    letter = F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False))
    src = docs.select(F.col(id_col).alias("doc_id"),
                      F.when(letter, F.col(text_col).cast("string")).alias("text"))
    schema = src.select("doc_id").schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches):
        m = shared.value
        for b in batches:
            n = b.num_rows
            lang, score, out = ["und"] * n, np.zeros(n), np.ones(n, bool)
            has = np.asarray(b.column(1).is_valid())
            if m is not None:
                for at, h in histograms(b.column(1), DIMS if m is None else len(m.idf)):
                    l, s, r = m.predict(h)
                    for i in np.flatnonzero(has[at:at + len(h)]).tolist():
                        lang[at + i], score[at + i], out[at + i] = l[i], min(max(s[i], 0.0), 1.0), r[i]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(out, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return src.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id's text modulo 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is not rejected, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    letter = F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False))

    def run(batches):
        m = shared.value
        for b in batches:
            stay = np.zeros(b.num_rows, bool)
            if m is not None:
                for lo, h in histograms(b.column(at), len(m.idf)):
                    stay[lo:lo + len(h)] = ~m.predict(h)[2]
            yield b.filter(pa.array(stay))

    return docs.where(letter).mapInArrow(run, docs.schema)
