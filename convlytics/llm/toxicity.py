"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, target, negation, report, or other.
Five weighted transducers read a clause's symbols, each the output of the one
before: the insult and the threat transducer write a match for their symbol,
the target transducer raises a match's weight where a person stands in reach on
either side, the report transducer turns a match after a verb of reported
speech into a reported one, the negation transducer one that closely follows a
negation into a negated one.  A transducer's state is what it has read to the
left and, for the target, to the right (a bimachine).  Their composition is one
table of kinds and weights by joint state and symbol; weights multiply along
it.  A clause is scored as a whole and no word alone.

The lexicon of insults and threats is learned: all words, and stems of words,
that stand mostly in texts labelled toxic, with confidence, weighted by their
log odds; small lists of function words are given.  What each kind of match
says about a text is fitted by logistic regression.  Both use a bounded, hashed
sample of the labelled rows, which bounds the lexicon too.

Defined results: null and empty texts get the score of a text without any
match; without labels of both classes every score is the same prior.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlytics.llm import textkit as T

#: labelled rows learned from, about
SAMPLE = 12_000
#: toxic texts that hold a learned word at least, and the share of toxic ones among
#: all that hold it, as the lower bound of a confidence interval of Z deviations
SUPPORT, SHARE, Z = 3, 0.5, 2.33
#: bytes of the stems that are learned next to whole words, longest first
STEMS = (6, 5, 4)
_STEM = np.uint64(0xA0761D6478BD642F)
#: words that a negation reaches, and that a target reaches to either side
NEGATION_REACH, TARGET_REACH = 3, 5
#: weight of a match with a target in reach
AIMED = 1.5

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

# fixed values: function words of the grammar by symbol
GRAMMAR = {
    THREAT: "kill hurt destroy beat punish shoot stab burn töten schlagen vernichten tuer frapper matar golpear",
    TARGET: "you your yours he his him she her they them their u du dich dir dein ihr euch sie tu te toi ton vous "
            "votre il elle ils tú ti usted ustedes vosotros él ella ellos",
    NEGATION: "not never no nobody none without isn aren wasn don doesn didn nicht nie kein keine niemals pas jamais "
              "aucun sans nunca jamás ningún sin",
    REPORT: "said says say told tells wrote writes quoted quote reported reports claimed called sagte sagt schrieb "
            "dit disait écrit dijo dice escribió",
}

_END = np.zeros(256, bool)
_END[list(b".!?;:\n")] = True


#: kinds of match; numbers of the fitted regression: per kind its summed and largest weight, then the text's
KINDS = ("insult", "negated", "reported", "threat")
PLAIN, NEGATED, REPORTED, MENACE = range(len(KINDS))
N_FEATURES = 2 * len(KINDS) + 3


class Transducer:
    """A deterministic weighted transducer over a clause.

    ``step(state, symbol)`` is the state after a symbol, ``back`` the same read
    from the right, both from state 0.  ``write(left, right, symbol, match)``
    gives the match (kind, weight) or None that the transducer writes for a
    symbol, from the match it reads and its states on both sides of the symbol.
    """

    def __init__(self, write, states: int = 1, step=lambda s, x: 0, back_states: int = 1, back=lambda s, x: 0):
        self.write, self.states, self.step, self.back_states, self.back = write, states, step, back_states, back


def _counting(symbol: int, reach: int):
    """Counts down from the last ``symbol``; 0 is out of reach."""
    return lambda s, x: reach if x == symbol else max(0, s - 1)


def accepting(symbol: int, kind: int) -> Transducer:
    return Transducer(lambda left, right, x, match: (kind, 1.0) if x == symbol else match)


def aimed(symbol: int = TARGET, reach: int = TARGET_REACH, weight: float = AIMED) -> Transducer:
    count = _counting(symbol, reach)
    return Transducer(lambda left, right, x, match: match and (match[0], match[1] * (weight if left or right else 1.0)),
                      reach + 1, count, reach + 1, count)


def reported(symbol: int = REPORT) -> Transducer:
    """All that follows the symbol in the clause is reported."""
    return Transducer(lambda left, right, x, match: match and (REPORTED if left else match[0], match[1]),
                      2, lambda s, x: int(s or x == symbol))


def negated(symbol: int = NEGATION, reach: int = NEGATION_REACH) -> Transducer:
    return Transducer(lambda left, right, x, match: match and (NEGATED if left else match[0], match[1]),
                      reach + 1, _counting(symbol, reach))


class Machine:
    """The composition of transducers: one table of moves for each direction, and
    of the kind (-1: no match) and weight written, by both states and symbol."""

    def __init__(self, parts: list[Transducer], symbols: int):
        self.left = self._product([p.states for p in parts], [p.step for p in parts], symbols)
        self.right = self._product([p.back_states for p in parts], [p.back for p in parts], symbols)
        size = (len(self.left), len(self.right), symbols)
        self.kind, self.weight = np.full(size, -1), np.zeros(size)
        for at in np.ndindex(size):
            left = np.unravel_index(at[0], [p.states for p in parts])
            right = np.unravel_index(at[1], [p.back_states for p in parts])
            match = None
            for p, l, r in zip(parts, left, right):
                match = p.write(int(l), int(r), at[2], match)
            if match:
                self.kind[at], self.weight[at] = match

    @staticmethod
    def _product(sizes, steps, symbols: int) -> np.ndarray:
        move = np.zeros((int(np.prod(sizes)), symbols), np.int32)
        for state, x in np.ndindex(move.shape):
            own = np.unravel_index(state, sizes)
            move[state, x] = np.ravel_multi_index([step(int(s), x) for step, s in zip(steps, own)], sizes)
        return move

    def read(self, symbols: list[int], weights: list[float]) -> list[tuple[int, float]]:
        """The clause's matches: kind and weight, which is the word's times the machine's."""
        right, state = [0] * len(symbols), 0
        for i in range(len(symbols) - 1, -1, -1):
            right[i] = state
            state = int(self.right[state, symbols[i]])
        out, state = [], 0
        for x, after, w in zip(symbols, right, weights):
            kind = int(self.kind[state, after, x])
            if kind >= 0:
                out.append((kind, w * float(self.weight[state, after, x])))
            state = int(self.left[state, x])
        return out


GRAMMAR_MACHINE = Machine([accepting(INSULT, PLAIN), accepting(THREAT, MENACE), aimed(), reported(), negated()], 6)


def _stems(word: bytes) -> list[bytes]:
    """Leading bytes of a longer word, marked by a closing zero byte."""
    return [word[:n] + b"\0" for n in STEMS if len(word) > n]


class Lexicon:
    """Symbols and weights by hash of a word or of a stem."""

    def __init__(self, learned: dict[bytes, float]):
        entries = {w.encode("utf-8"): (s, 0.5) for s, line in GRAMMAR.items() for w in line.split()}
        threats = {w.encode("utf-8") for w in GRAMMAR[THREAT].split()}
        for w, weight in learned.items():
            if w not in entries or w in threats:
                entries[w] = (THREAT if w in threats else INSULT, weight)
        names = list(entries)
        stem = np.array([w.endswith(b"\0") for w in names])
        names = [w.rstrip(b"\0") for w in names]
        flat = np.frombuffer(b"".join(names), np.uint8)
        ends = np.cumsum([len(x) for x in names])
        h = T.span_hashes(flat, np.concatenate([[0], ends[:-1]]), ends)
        h[stem] ^= _STEM
        order = np.argsort(h)
        self.h = h[order]
        self.symbol = np.array([s for s, _ in entries.values()], np.int32)[order]
        self.weight = np.array([w for _, w in entries.values()])[order]

    def look_up(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and weight of each word: its own, or else its longest stem's."""
        symbol, weight = np.zeros(len(start), np.int32), np.zeros(len(start))
        for n in (0, *STEMS):
            rest = np.flatnonzero(symbol == OTHER) if not n else np.flatnonzero((symbol == OTHER) & (end - start > n))
            if not len(rest):
                continue
            h = T.span_hashes(buf, start[rest], start[rest] + n if n else end[rest])
            if n:
                h ^= _STEM
            at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
            known = self.h[at] == h
            symbol[rest[known]] = self.symbol[at[known]]
            weight[rest[known]] = self.weight[at[known]]
        return symbol, weight

    def features(self, c: T.Chunk) -> np.ndarray:
        out = np.zeros((len(c), N_FEATURES))
        w = T.words(c, c.buf, T.ALNUM)
        n = np.diff(w.first)
        out[:, -1] = 1.0
        out[:, -2] = np.log1p(n)
        if not len(w.start):
            return out
        symbol, weight = self.look_up(c.buf, w.start, w.end)
        doc = w.doc
        # a clause ends with its document or with a closing sign after a word
        ends = np.concatenate([[0], np.cumsum(_END[c.buf])])
        cut = np.ones(len(symbol), bool)
        cut[1:] = (ends[w.start[1:]] > ends[w.end[:-1]]) | (doc[1:] != doc[:-1])
        clause = np.cumsum(cut) - 1
        first = np.append(np.flatnonzero(cut), len(symbol))
        for k in np.unique(clause[(symbol == INSULT) | (symbol == THREAT)]).tolist():
            a, b = int(first[k]), int(first[k + 1])
            row = out[doc[a]]
            for kind, x in GRAMMAR_MACHINE.read(symbol[a:b].tolist(), weight[a:b].tolist()):
                row[2 * kind] += x
                row[2 * kind + 1] = max(row[2 * kind + 1], x)
                row[-3] += 1
        out[:, -3] = np.log1p(out[:, -3])
        return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty), g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def score(self, c: T.Chunk) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.lexicon.features(c) @ self.weights, -30, 30)))


def _lower(col: pa.Array) -> pa.Array:
    return pc.utf8_lower(T.as_strings(col))


def learnable(doc_id: str = "doc_id"):
    """crc32 of the id's text modulo 5 is not 0; a null id is not learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from the labelled rows (doc_id, toxic) of ``labels`` that are learnable."""
    own = labels.where(learnable() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    n = own.count()
    if n > sample:
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    # about ``sample`` rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").dropDuplicates(["text", "toxic"])

    def word_sets(batches):
        for b in batches:
            texts, y = _lower(b.column(0)), np.asarray(b.column(1).to_numpy(zero_copy_only=False))
            for c in T.chunks(texts):
                w = T.words(c, c.buf, T.ALNUM)
                raw = c.buf.tobytes()
                words, toxic = [], []
                for i in range(len(c)):
                    a, e = int(w.first[i]), int(w.first[i + 1])
                    own = {raw[s:t] for s, t in zip(w.start[a:e].tolist(), w.end[a:e].tolist())}
                    own |= {x for word in own for x in _stems(word)}
                    words.extend(own)
                    toxic.extend([int(y[c.lo + i])] * len(own))
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(toxic, pa.int32())],
                                                 ["word", "toxic"])

    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        weights = np.zeros(N_FEATURES)
        weights[-1] = np.log((n1 + 0.5) / (n0 + 9.5))
        return Model(Lexicon({}), weights)
    counts = (rows.select("text", "toxic").mapInArrow(word_sets, "word binary, toxic int")
              .groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")))
    a, b = F.col("a"), F.col("b")
    odds = F.log((a + 0.5) / (F.lit(n1) - a + 0.5)) - F.log((b + 0.5) / (F.lit(n0) - b + 0.5))
    n, z2 = a + b, Z * Z
    least = (a + z2 / 2 - Z * F.sqrt(a * b / n + z2 / 4)) / (n + z2)
    # words of the sampled toxic texts only, each in SUPPORT of them or more
    top = (counts.where(a >= SUPPORT).select("word", odds.alias("odds"), least.alias("least"))
           .where(F.col("least") >= SHARE).select("word", "odds").collect())
    lexicon = Lexicon({bytes(r["word"]): float(r["odds"]) for r in sorted(top, key=lambda r: bytes(r["word"]))})
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def describe(batches):
        for b in batches:
            y = b.column(1)
            for c in T.chunks(_lower(b.column(0))):
                x = shared.value.features(c)
                yield pa.RecordBatch.from_arrays([T.list_column(list(x), pa.float64()), y.slice(c.lo, len(c))],
                                                 ["x", "toxic"])

    # a dozen numbers for each sampled row
    data = rows.select("text", "toxic").mapInArrow(describe, "x array<double>, toxic int").collect()
    data.sort(key=lambda r: (r["toxic"], r["x"]))
    return Model(lexicon, _logistic(np.array([r["x"] for r in data]), np.array([r["toxic"] for r in data], float)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = src.select("doc_id").schema.add("score", "double").add("predicted", "integer")

    def run(batches):
        for b in batches:
            for c in T.chunks(_lower(b.column(1))):
                s = shared.value.score(c)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(c.lo, len(c)), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))],
                    ["doc_id", "score", "predicted"])

    return src.mapInArrow(run, schema)
