"""Quality rules by weak supervision.

Each rule votes good or bad for a text, or abstains.  Expectation-maximisation
estimates from the votes of all documents how often each rule is right about
good and about bad texts; the posterior probability that a text is good, given
all its votes, replaces "every rule must pass".  Votes are counted by pattern
(at most 3 ** rules of them), so the estimation sees every document and needs
no more than the counts.

Two base conditions stay outside the vote: too few words, or too many words
repeated within the text, fail a document.

Defined results: null and empty texts have no words and fail; repeated rows
vote once each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlytics.llm import textkit as T
from convlytics.llm.scratch import Scratch

MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: posterior probability of a good text from which it is kept
KEEP = 0.5
ROUNDS = 100

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;\"')")] = True

FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "n_lines long, n_letters long, n_upper long, n_letter_words long, n_bangs long, n_stops long")


def _later_equal(group: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether an earlier element of the same group has the same hash."""
    order = np.lexsort((np.arange(len(h)), h, group))
    same = np.zeros(len(h), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (group[order][1:] == group[order][:-1])
    out = np.zeros(len(h), bool)
    out[order] = same
    return out


def measure(c: T.Chunk) -> list[np.ndarray]:
    """The columns of FIELDS for a chunk."""
    n, buf = len(c), c.buf
    w = T.words(c, buf)
    doc = w.doc
    count = lambda d: np.bincount(d, minlength=n)
    byte_doc = np.repeat(np.arange(n), np.diff(c.off))
    inside = T.NOT_SPACE[buf] if len(buf) else np.zeros(0, bool)
    chars = inside & ((buf & 0xC0) != 0x80)
    h = T.span_hashes(buf, w.start, w.end)

    repeated = np.zeros(len(h), bool)
    win = T.window_hashes(h, 3)
    if len(win):
        at = np.flatnonzero(doc[:len(win)] == doc[2:])
        group, key = doc[at], win[at]
        order = np.lexsort((key, group))
        same = (key[order][1:] == key[order][:-1]) & (group[order][1:] == group[order][:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for j in range(3):
            repeated[at[twice] + j] = True

    # lines: spans between line feeds; equal text means equal hash, empty ones have no word
    feed = np.flatnonzero(buf == 0x0A) if len(buf) else np.zeros(0, np.int64)
    bounds = np.unique(np.concatenate([c.off, feed, feed + 1]))
    a, b = bounds[:-1], bounds[1:]
    has = np.zeros(len(a), bool)
    if len(w.start):
        has[np.unique(np.searchsorted(a, w.start, "right") - 1)] = True
    a, b = a[has], b[has]
    line_doc = byte_doc[a] if len(a) else np.zeros(0, np.int64)
    dup = _later_equal(line_doc, T.span_hashes(buf, a, b)) if len(a) else np.zeros(0, bool)
    last = np.array([], np.int64)
    if len(a):  # the last word's last byte of each line
        i = np.searchsorted(w.start, b) - 1
        last = w.end[i] - 1
    letters = _LETTER[buf] if len(buf) else inside
    has_letter = np.zeros(len(h), bool)
    if len(h):
        total = np.concatenate([[0], np.cumsum(letters)])
        has_letter = total[w.end] > total[w.start]
    return [count(doc), count(byte_doc[chars]), count(byte_doc[_SYMBOL[buf]]), count(line_doc[dup]),
            count(doc[repeated]), count(line_doc), count(byte_doc[letters]), count(byte_doc[_UPPER[buf]]),
            count(doc[has_letter]), count(byte_doc[buf == 0x21]),
            count(line_doc[_STOP[buf[last]]]) if len(a) else count(line_doc)]


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = src.select("doc_id").schema
    for f in FIELDS.split(", "):
        schema = schema.add(*f.split())
    names = schema.names

    def run(batches):
        for b in batches:
            for c in T.chunks(b.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(c.lo, len(c))] + [pa.array(x, pa.int64()) for x in measure(c)], names)

    return src.mapInArrow(run, schema)


def _vote(bad, good=None):
    """0 bad, 2 good, else 1: the rule abstains."""
    fired = F.when(bad, 0)
    return (fired if good is None else fired.when(good, 2)).otherwise(1)


def rules() -> dict:
    """Votes by name.  The absence of a defect is no sign of quality: rules that
    look for one vote bad or abstain."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    letters = F.greatest(F.col("n_letters"), F.lit(1)).cast("double")
    size = F.col("word_chars") / words
    return {
        "length": _vote(F.col("n_words") < MIN_WORDS // 2, F.col("n_words") >= 80),
        "word_size": _vote(~size.between(2.0, 14.0)),
        "symbols": _vote(F.col("n_symbols") > 0.1 * words),
        "dense_symbols": _vote(F.col("n_symbols") > 0.4 * words),
        "dup_lines": _vote((F.col("n_dup_lines") >= 3) & (F.col("n_dup_lines") > 0.3 * lines)),
        "repeats": _vote(F.col("n_repeat_words") > 0.4 * words),
        "letters": _vote(F.col("n_letter_words") < 0.7 * words, F.col("n_letter_words") >= 0.95 * words),
        "capitals": _vote(F.col("n_upper") > 0.4 * letters),
        "shouting": _vote(F.col("n_bangs") > 0.1 * words),
        "line_ends": _vote(F.col("n_stops") < 0.1 * lines, F.col("n_stops") >= 0.5 * lines),
    }


#: chances to start from, of a bad vote, of none and of a good one
START_GOOD, START_BAD = (0.02, 0.38, 0.6), (0.25, 0.3, 0.45)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Posterior of a good text for each vote pattern (rows by rules, 0 to 2).

    Counts are smoothed by one vote, so that a rule never seen to err keeps a
    chance to.
    """
    if not len(patterns):
        return np.zeros(0)
    voted = np.stack([patterns == v for v in range(3)], axis=2).astype(float)  # pattern, rule, vote
    says_good = voted[:, :, 2].any(axis=0)
    good, bad = (np.where(says_good[:, None], s, (s[0], s[1] + s[2], 1e-6)) for s in (START_GOOD, START_BAD))
    prior = 0.8
    post = np.zeros(len(patterns))
    for _ in range(rounds):
        odds = np.log(1 - prior) - np.log(prior) + (voted * (np.log(bad) - np.log(good))).sum(axis=(1, 2))
        new = 1 / (1 + np.exp(np.clip(odds, -500, 500)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
        tables = []
        for weight in (counts * post, counts * (1 - post)):
            votes = (voted * weight[:, None, None]).sum(axis=0) + 1
            tables.append(votes / votes.sum(axis=1, keepdims=True))
        good, bad = tables
        prior = float(np.clip((counts * post).sum() / counts.sum(), 0.02, 0.98))
    return post


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures, base_failed, posterior and kept of every row."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "quality")
    votes = rules()
    code = sum((v * 3 ** i for i, v in enumerate(votes.values())), F.lit(0)).cast("int")
    rows = scratch.save(measures(docs, id_col, text_col).withColumn("pattern", code))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    # at most 3 ** rules rows, whatever the table's size
    seen = rows.where("n_words > 0").groupBy("pattern").count().collect()
    codes = np.array([r["pattern"] for r in seen], np.int64)
    patterns = (codes[:, None] // 3 ** np.arange(len(votes))) % 3 if len(codes) else np.zeros((0, len(votes)), np.int64)
    post = estimate(patterns, np.array([r["count"] for r in seen], float))
    table = spark.createDataFrame([(int(c), float(p)) for c, p in zip(codes, post)], "pattern int, posterior double")
    return (rows.join(F.broadcast(table), "pattern", "left")
            .withColumn("posterior", F.coalesce("posterior", F.lit(0.0)))
            .withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP))
            .drop("pattern"))
