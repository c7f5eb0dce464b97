"""Hierarchical packing of tokenised documents into sequences of several lengths.

A document is its token ids and an end id.  It is cut freely: full windows of
the longest tier leave at once, each a sequence of its own.  The rest of the
document is routed to the shortest tier that holds it.  Tiers are packed from
the longest down: a window holds one rest, and its gap is filled from shorter
tiers, the largest that fits first; the last piece of a gap is cut to size, so
the window is full.  What no shorter rest can fill any more waits for the next
pool, and at the end of a task it is laid end to end and cut to powers of two.
Sequences therefore have lengths that are powers of two, and no padding.

Sequences of one tier are dealt to step groups of the same number of tokens,
so that each training step sees one length and equal work.

Packing happens in the task that tokenises, pool by pool, without a shuffle;
a task holds one pool.  Ids depend on the partition number and the order of
its rows alone, so a task that runs again gives the same sequences.

Defined results: a null or empty text is the end id alone; repeated rows are
packed once each; a null doc_id stays null.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right, insort
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlytics.llm import textkit as T

#: context sizes, all powers of two
TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: tokens of the rests that are packed together
POOL_TOKENS = 1 << 20
#: tokens of a step group
STEP_TOKENS = 1 << 16
#: words that a worker remembers with their ids
CACHED_WORDS = 1_000_000
CHUNK = 1 << 22

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, tier int, step_group long")


#: kinds of bytes: white space, letter, digit, sign, anything else
SPACE, LETTER, DIGIT, SIGN, ELSE = range(5)
_KIND = np.full(256, ELSE, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = SPACE
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
_KIND[0x30:0x3A] = DIGIT
# an apostrophe may start a token of its own, a less-than sign a special one
_KIND[[x for x in range(0x21, 0x7F) if _KIND[x] == ELSE and x not in b"'<"]] = SIGN


def units(c: T.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chunk's bytes with Latin letters in lower case, and its units' spans."""
    buf = c.buf.copy()
    if not len(buf):
        return buf, np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[buf]
    # Latin-1 letters are C3 80 to C3 BF, but for two signs
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    tail = buf[lead + 1]
    lead = lead[(tail >= 0x80) & (tail < 0xC0) & (tail != 0x97) & (tail != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    upper = lead[buf[lead + 1] < 0x9F] + 1
    buf = T.lower(buf)
    buf[upper] += 0x20
    w = T.words(c, c.buf)
    odd = np.concatenate([[0], np.cumsum(kind == ELSE)])
    for a, b in zip(*(x[odd[w.end] > odd[w.start]] for x in (w.start, w.end))):
        kind[a:b] = ELSE
        buf[a:b] = c.buf[a:b]
    opens = np.ones(len(buf), bool)
    opens[1:] = kind[1:] != kind[:-1]
    opens[c.off[:-1][c.off[:-1] < len(buf)]] = True
    start = np.flatnonzero(opens)
    end = np.append(start[1:], len(buf))
    real = kind[start] != SPACE
    return buf, start[real], end[real]


class WordTokenizer:
    """Ids of whole texts from the ids of their words.

    White space ends every token of this vocabulary, case does not count, and
    letters, digits and signs are split from one another.  So a text's ids are
    those of its units one after another: runs of Latin letters in lower case,
    of digits, of ASCII signs, and any word that holds something else as a
    whole.  Units repeat, and each is encoded once as long as it is remembered.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok, self.cached = Tokenizer.from_file(path), cached
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}  # word -> its number
        self.first = np.zeros(1, np.int64)  # by number, one more than words
        self.flat = np.zeros(0, np.uint32)

    def learn(self, new: list[bytes]) -> None:
        flat, sizes = [self.flat], []
        for lo in range(0, len(new), 4096):
            part = [w.decode("utf-8") for w in new[lo:lo + 4096]]
            ids = [e.ids for e in self.tok.encode_batch_fast(part, add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes[-1].sum())))
        known = self.known
        for i, w in enumerate(new, len(known)):
            known[w] = i
        self.flat = np.concatenate(flat)
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate(sizes))])

    def chunk(self, c: T.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk and the n + 1 offsets of its documents."""
        buf, start, end = units(c)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(c) + 1, np.int64)
        _, at, back = np.unique(T.span_hashes(buf, start, end), return_index=True, return_inverse=True)
        raw = buf.tobytes()
        names = [raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())]
        if len(self.known) > self.cached:
            self.forget()
        new = [x for x in names if x not in self.known]
        if new:
            self.learn(new)
        number = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))[back]
        n = self.first[number + 1] - self.first[number]
        ends = np.cumsum(n)
        take = np.arange(int(ends[-1])) + np.repeat(self.first[number] - (ends - n), n)
        return self.flat[take], np.concatenate([[0], ends])[np.searchsorted(start, c.off)]


def worker_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer that this Python process keeps, with the words it has met in earlier tasks."""
    held = T.kept("tokenizer")
    if path not in held:
        held[path] = WordTokenizer(path)
    return held[path]


class Packer:
    """Packs one task's documents; rows of SCHEMA come out of ``rows``."""

    def __init__(self, task: int, tiers=TIERS, pool_tokens: int = POOL_TOKENS, step_tokens: int = STEP_TOKENS):
        self.tiers, self.top, self.pool_tokens, self.step_tokens = tiers, tiers[-1], pool_tokens, step_tokens
        self.base, self.n = task << 40, 0
        self.dealt: dict[int, int] = {}
        self.rows: list[tuple] = []
        self.rests: list[tuple[int, int]] = []  # (length, number), by length
        self.parts: dict[int, tuple] = {}  # number -> doc_id, start, ids, doc_tokens
        self.tokens = self.number = 0

    def sequence(self, pieces: list[tuple]) -> None:
        """One sequence of pieces (doc_id, start, ids, doc_tokens)."""
        size = sum(len(p[2]) for p in pieces)
        per = max(1, self.step_tokens // size)
        dealt = self.dealt.get(size, 0)
        self.dealt[size] = dealt + 1
        step = self.base + (size.bit_length() << 32) + dealt // per
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total,
                              self.base + self.n, at, size, step, ids))
            at += len(ids)
        self.n += 1

    def add(self, doc, ids: np.ndarray) -> None:
        total = len(ids)
        whole = total // self.top * self.top
        for s in range(0, whole, self.top):
            self.sequence([(doc, s, ids[s:s + self.top], total)])
        if total > whole:
            self.keep((doc, whole, ids[whole:], total))
            if self.tokens >= self.pool_tokens:
                self.pack()

    def keep(self, part: tuple) -> None:
        self.number += 1
        self.parts[self.number] = part
        insort(self.rests, (len(part[2]), self.number))
        self.tokens += len(part[2])

    def take(self, i: int) -> tuple:
        size, number = self.rests.pop(i)
        self.tokens -= size
        return self.parts.pop(number)

    def pack(self) -> None:
        wait = []
        for tier, below in zip(self.tiers[::-1], (*self.tiers[-2::-1], 0)):
            while self.rests and self.rests[-1][0] > below:
                lead = self.take(len(self.rests) - 1)
                pieces, gap = [lead], tier - len(lead[2])
                while gap and self.rests:
                    i = bisect_right(self.rests, (gap, self.number)) - 1
                    # only shorter tiers fill, except in the shortest
                    if i < 0:
                        if below and self.rests[0][0] > below:
                            break
                        i = 0
                    doc, start, ids, total = self.take(i)
                    if len(ids) > gap:
                        self.keep((doc, start + gap, ids[gap:], total))
                        ids = ids[:gap]
                    pieces.append((doc, start, ids, total))
                    gap -= len(ids)
                if gap:
                    wait.append(pieces)
                else:
                    self.sequence(pieces)
        for pieces in wait:
            for p in pieces:
                self.keep(p)
        if self.tokens >= self.pool_tokens // 2:
            self.finish()

    def close(self) -> None:
        self.pack()
        self.finish()

    def finish(self) -> None:
        """Lay all rests end to end: full windows, then powers of two."""
        left = self.tokens
        room, pieces = 0, []
        while self.rests:
            if not room:
                room = self.top if left >= self.top else 1 << (left.bit_length() - 1)
            doc, start, ids, total = self.take(len(self.rests) - 1)
            if len(ids) > room:
                self.keep((doc, start + room, ids[room:], total))
                ids = ids[:room]
            pieces.append((doc, start, ids, total))
            room -= len(ids)
            left -= len(ids)
            if not room:
                self.sequence(pieces)
                pieces = []


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
         with_ids: bool = False, tiers=TIERS, pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """One row per piece; ``with_ids`` adds the piece's token ids."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]

    def run(batches):
        tok = worker_tokenizer(vocabulary)
        packer = Packer(TaskContext.get().partitionId(), tiers, pool_tokens)

        def flush():
            cols = list(zip(*packer.rows)) if packer.rows else [[] for _ in range(10)]
            packer.rows.clear()
            arrays = [pa.array(list(v), k) for v, k in zip(cols, kinds)]
            if with_ids:
                arrays.append(T.list_column(list(cols[9]), pa.int32()))
            return pa.RecordBatch.from_arrays(arrays, names)

        for b in batches:
            doc = b.column(0).to_pylist()
            for c in T.chunks(b.column(1), CHUNK):
                ids, off = tok.chunk(c)
                for i in range(len(c)):
                    own = np.append(ids[off[i]:off[i + 1]], np.uint32(END_ID))
                    packer.add(doc[c.lo + i], own)
                    if len(packer.rows) >= 5_000:
                        yield flush()
        packer.close()
        yield flush()

    return src.mapInArrow(T.task(run, keep="tokenizer"), schema)
