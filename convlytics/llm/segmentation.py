"""Sampled SentencePiece segmentations by forward filtering, backward sampling.

A text's words (a space belongs to the word it leads) are lattices: nodes are
character positions, arcs the vocabulary's pieces, and, for characters that
no piece covers, their UTF-8 bytes as byte pieces.  Forward filtering gives at each
node the summed weight of all ways to reach it; backward sampling walks from
the end, drawing each arc in proportion.  Draws come from a hash of the row's
key, the place of the word and the step, so a row's segmentation is the same
in every run and on every machine.

The weight of a piece follows its rank in the vocabulary (Zipf), raised to
``alpha``: 0 makes all ways equally likely, a large value prefers common and
long pieces.

Decoding is lossless: nothing is normalised, spaces are the vocabulary's space
mark, and the mark itself in a text is encoded as its bytes.

Defined results: null text gives null ids, empty text none; a null key is a
key of its own; equal rows are segmented alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from convlytics.llm import textkit as T

MARK = "▁"
ALPHA = 1.0
SEED = 1
#: cost of a byte piece against the rarest piece
BYTE_WEIGHT = 1e-3
#: longest pieces of the vocabulary that are considered, in bytes
LONGEST = 48
CHUNK = 1 << 20
#: pieces that are decoded at once, about
STRETCH = 1 << 18
#: bytes that lead a UTF-8 character
_LEAD = np.zeros(256, bool)
_LEAD[:0x80] = True
_LEAD[0xC0:] = True


class Vocabulary:
    """Pieces of a SentencePiece model: hashes, ids and weights."""

    def __init__(self, path: str, alpha: float = ALPHA, lattices: bool = True):
        """Without ``lattices`` it holds what decoding needs."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * self.size
        self.byte_id = np.full(256, -1, np.int64)
        names, ids = [], []
        for i in range(self.size):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                continue
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(p[3:5], 16)])
                continue
            raw = p.replace(MARK, " ").encode("utf-8")
            self.bytes_of[i] = raw
            # words end before a space, so no arc has one after its first byte
            if 0 < len(raw) <= LONGEST and b" " not in raw[1:] and MARK not in p[1:]:
                names.append(raw)
                ids.append(i)
        if not lattices:
            return
        # common pieces come first in the vocabulary
        rank = np.argsort(np.argsort(np.array(ids))) + 2.0
        self.id = np.array(ids, np.int64)
        self.log = -alpha * np.log(rank)
        self.byte_log = float(self.log.min() + np.log(BYTE_WEIGHT))
        # every beginning of a piece, with the piece that ends there or -1
        number = {x: i for i, x in enumerate(names)}
        heads = sorted({x[:n] for x in names for n in range(1, len(x) + 1)})
        flat = np.frombuffer(b"".join(heads), np.uint8)
        ends = np.cumsum([len(x) for x in heads])
        self.heads = Table(T.span_hashes(flat, np.concatenate([[0], ends[:-1]]), ends),
                           np.array([number.get(x, -1) for x in heads], np.int64))


class Table:
    """A lookup table from 64-bit hashes to numbers, for whole arrays of hashes.

    A slot holds one hash; hashes that find theirs taken go to a second, sorted
    table, and only lookups that meet such a slot search there.
    """

    BITS = 18

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        slot = (keys >> np.uint64(64 - self.BITS)).astype(np.int64)
        _, first = np.unique(slot, return_index=True)
        self.key, self.value = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, -2, np.int64)
        self.key[slot[first]], self.value[slot[first]] = keys[first], values[first]
        rest = np.setdiff1d(np.arange(len(keys)), first)
        self.more = np.zeros(1 << self.BITS, bool)
        self.more[slot[rest]] = True
        order = rest[np.argsort(keys[rest])]
        self.rest_key, self.rest_value = keys[order], values[order]

    def get(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, or -2 where it is unknown."""
        slot = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        out = np.where(self.key[slot] == h, self.value[slot], -2)
        again = np.flatnonzero(self.more[slot] & (out == -2))
        if len(again):
            at = np.minimum(np.searchsorted(self.rest_key, h[again]), len(self.rest_key) - 1)
            out[again] = np.where(self.rest_key[at] == h[again], self.rest_value[at], -2)
        return out


def _uniform(key: np.ndarray, place: np.ndarray, step: int) -> np.ndarray:
    turn = np.uint64((2 * step + 1) * 0xD6E8FEB86659FD93 % 2**64)
    h = T.mix(key + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + turn)
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Lattice:
    """The distinct words of a chunk: their arcs and forward weights."""

    def __init__(self, v: Vocabulary, buf: np.ndarray, start: np.ndarray, size: np.ndarray):
        """``start``, ``size``: byte spans of the words in ``buf``."""
        n = len(start)
        self.first = np.concatenate([[0], np.cumsum(size + 1)])  # nodes of a word: its bytes and its end
        nodes = int(self.first[-1])
        total = int(size.sum())
        word = np.repeat(np.arange(n), size)
        within = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        inside = buf[np.repeat(start, size) + within]
        value = T._BYTE[inside]
        node = self.first[word] + within
        left = np.repeat(size, size) - within  # bytes to the word's end
        lead = _LEAD[inside]
        a_at, a_size, a_id, a_log = [], [], [], []
        # pieces: from each character on, byte by byte, as long as a piece goes on
        at = np.flatnonzero(lead)
        h = np.zeros(len(at), np.uint64)
        power = T.powers(LONGEST + 1)
        covered = np.zeros(total, bool)
        for k in range(1, LONGEST + 1):
            go = left[at] >= k
            at, h = at[go], h[go]
            if not len(at):
                break
            h = h + value[at + k - 1] * power[k - 1]
            found = v.heads.get(T.mix(h + np.uint64(k)))
            hit = np.flatnonzero(found >= 0)
            if len(hit):
                own = at[hit]
                a_at.append(own)
                a_size.append(np.full(len(own), k))
                a_id.append(v.id[found[hit]])
                a_log.append(v.log[found[hit]])
                if k <= 4:
                    covered[own[_char_bytes(inside[own]) == k]] = True
            known = found > -2
            at, h = at[known], h[known]
        # characters without a piece of their own: their bytes, one arc each
        owner = np.maximum.accumulate(np.where(lead, np.arange(total), 0)) if total else np.zeros(0, np.int64)
        bare = np.flatnonzero(~covered[owner]) if total else np.zeros(0, np.int64)
        a_at.append(bare)
        a_size.append(np.ones(len(bare), np.int64))
        a_id.append(v.byte_id[inside[bare]])
        a_log.append(np.full(len(bare), v.byte_log))
        at, reach = np.concatenate(a_at), np.concatenate(a_size)
        dst = node[at] + reach
        order = np.argsort(dst, kind="stable")
        at, reach = at[order], reach[order]
        self.dst, self.src = dst[order], node[at]
        self.ids, log = np.concatenate(a_id)[order], np.concatenate(a_log)[order]
        depth = (within[at] + reach).astype(np.int32)
        # forward filtering, one node of every word at a time
        self.alpha = np.full(nodes, -np.inf)
        self.alpha[self.first[:-1]] = 0.0
        most = int(size.max()) if n else 0
        by_depth = np.argsort(depth.astype(np.int16) if most < 2**15 else depth, kind="stable")
        cuts = np.searchsorted(depth[by_depth], np.arange(1, most + 2))
        for a, b in zip(cuts[:-1], cuts[1:]):
            e = by_depth[a:b]
            if not len(e):
                continue
            d = self.dst[e]
            score = self.alpha[self.src[e]] + log[e]
            head = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            top = np.maximum.reduceat(score, head)
            base = np.where(np.isfinite(top), top, 0.0)
            part = np.add.reduceat(np.exp(score - np.repeat(base, np.diff(np.append(head, len(e))))), head)
            with np.errstate(divide="ignore"):
                self.alpha[d[head]] = base + np.log(part)
        # chances of the arcs into each node
        self.into = np.concatenate([[0], np.cumsum(np.bincount(self.dst, minlength=nodes))])
        chance = np.exp(self.alpha[self.src] + log - self.alpha[self.dst])
        self.chance = np.where(np.isfinite(chance), chance, 0.0)

    def sample(self, word: np.ndarray, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of sampled segmentations, one after another, and each one's number of pieces."""
        at = self.first[word + 1] - 1
        begin = self.first[word]
        left = np.arange(len(word))
        who, piece = [], []
        step = 0
        while len(left):
            lo, hi = self.into[at[left]], self.into[at[left] + 1]
            u = _uniform(key[left], place[left], step)
            # a node's arcs share the chance of 1; step to the one that holds the draw
            arc, passed = lo.copy(), self.chance[lo]
            on = np.flatnonzero((arc < hi - 1) & (passed <= u))
            while len(on):
                arc[on] += 1
                passed[on] += self.chance[arc[on]]
                on = on[(arc[on] < hi[on] - 1) & (passed[on] <= u[on])]
            # an arc that no way from the start reaches has no width; rounding must not choose it
            dead = ~np.isfinite(self.alpha[self.src[arc]])
            if dead.any():
                for j in np.flatnonzero(dead):
                    arc[j] = max(range(lo[j], hi[j]), key=lambda x: self.alpha[self.src[x]])
            who.append(left)
            piece.append(self.ids[arc])
            at[left] = self.src[arc]
            left = left[at[left] > begin[left]]
            step += 1
        n = np.zeros(len(word), np.int64)
        for w in who:
            n[w] += 1
        ends = np.cumsum(n)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        for s, (w, p) in enumerate(zip(who, piece)):
            out[ends[w] - 1 - s] = p
        return out, n


def _char_bytes(lead: np.ndarray) -> np.ndarray:
    """Bytes of the UTF-8 character that a byte leads."""
    return np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))


class Encoder:
    """Encodes chunks; lattices of words that repeat in the first one are kept."""

    def __init__(self, v: Vocabulary):
        self.v, self.kept, self.hashes = v, None, np.zeros(0, np.uint64)

    def _keep(self, buf, start, size, h) -> None:
        """Lattices of the repeated words, in the order of their hashes."""
        u, one, count = np.unique(h, return_index=True, return_counts=True)
        one = one[count > 1]
        self.hashes = u[count > 1]
        self.kept = Lattice(self.v, buf, start[one], size[one]) if len(one) else None

    def chunk(self, c: T.Chunk, keys: np.ndarray) -> list[np.ndarray]:
        """Sampled ids of each document of a chunk."""
        if not len(c.buf):
            return [np.zeros(0, np.int64) for _ in range(len(c))]
        # a word starts at a document's first byte and at each space
        opens = c.buf == 0x20
        opens[c.off[:-1][c.off[:-1] < len(c.buf)]] = True
        start = np.flatnonzero(opens)
        size = np.diff(np.append(start, len(c.buf)))
        h = T.span_hashes(c.buf, start, start + size)
        if not len(self.hashes):
            self._keep(c.buf, start, size, h)
        first = np.searchsorted(start, c.off)
        doc = np.repeat(np.arange(len(c)), np.diff(first))
        place = np.arange(len(start)) - first[doc]
        if self.kept is not None:
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            old = self.hashes[at] == h
        else:
            at, old = None, np.zeros(len(h), bool)
        n = np.zeros(len(h), np.int64)
        drawn = []
        for who in (np.flatnonzero(old), np.flatnonzero(~old)):
            if not len(who):
                continue
            if len(drawn) == 0 and old[who[0]]:
                lattice, word = self.kept, at[who]
            else:
                _, one, word = np.unique(h[who], return_index=True, return_inverse=True)
                lattice = Lattice(self.v, c.buf, start[who[one]], size[who[one]])
            ids, own = lattice.sample(word, keys[doc[who]], place[who])
            n[who] = own
            drawn.append((who, ids, own))
        ends = np.concatenate([[0], np.cumsum(n)])
        out = np.zeros(int(ends[-1]), np.int64)
        for who, ids, own in drawn:
            skip = np.cumsum(own) - own
            out[np.arange(len(ids)) + np.repeat(ends[who] - skip, own)] = ids
        cut = ends[first]
        return [out[a:b] for a, b in zip(cut[:-1], cut[1:])]


def encode_chunk(v: Vocabulary, c: T.Chunk, keys: np.ndarray) -> list[np.ndarray]:
    """Sampled ids of each document of a single chunk."""
    return Encoder(v).chunk(c, keys)


def encode(docs: DataFrame, model: str, alpha: float = ALPHA, seed: int = SEED,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): sampled piece ids of every row."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                      F.xxhash64(F.lit(seed), F.col(id_col).cast("string")).alias("key"))
    out = "`doc_id` " + src.schema["doc_id"].dataType.simpleString() + ", ids array<int>"

    def run(batches):
        encoder = Encoder(Vocabulary(model, alpha))
        for b in batches:
            null = ~np.asarray(b.column(1).is_valid())
            keys = np.asarray(b.column(2)).astype(np.int64).view(np.uint64)
            for c in T.chunks(b.column(1), CHUNK):
                parts = encoder.chunk(c, keys[c.lo:c.lo + len(c)])
                off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                flat = pa.array(np.concatenate(parts).astype(np.int32))
                ids = pa.ListArray.from_arrays(pa.array(off), flat)
                gone = null[c.lo:c.lo + len(c)]
                if gone.any():
                    mask = pa.array(np.append(gone, False))
                    ids = pa.ListArray.from_arrays(
                        pa.array([None if m else int(o) for m, o in zip(mask.to_pylist(), off)], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.lo, len(c)), ids], ["doc_id", "ids"])

    return src.mapInArrow(run, out)


def decode(rows: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """All columns of ``rows`` and ``decoded``, the text of the ids; null ids give null."""
    names = rows.columns
    schema = StructType([*rows.schema.fields, StructField("decoded", StringType())])
    at = names.index(ids_col)

    def run(batches):
        v = Vocabulary(model, lattices=False)
        size = np.array([len(x) for x in v.bytes_of])
        flat = np.frombuffer(b"".join(v.bytes_of), np.uint8)
        begin = np.cumsum(size) - size
        for whole in batches:
            sizes = np.asarray(whole.column(at).value_lengths().fill_null(0))
            part = np.concatenate([[0], np.cumsum(sizes)]) // STRETCH
            cuts = [0, *(np.flatnonzero(np.diff(part[:-1])) + 1).tolist(), whole.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                b = whole.slice(lo, hi - lo)
                col = b.column(at)
                ids = np.asarray(col.flatten()).astype(np.int64)
                take = size[ids]
                ends = np.cumsum(take)
                total = int(ends[-1]) if len(ends) else 0
                src = np.arange(total) + np.repeat(begin[ids] - (ends - take), take)
                raw = flat[src].tobytes()
                cut = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes[lo:hi])])].tolist()
                text = [raw[a:z].decode("utf-8", "replace") if ok else None
                        for a, z, ok in zip(cut[:-1], cut[1:], np.asarray(col.is_valid()).tolist())]
                yield pa.RecordBatch.from_arrays(list(b.columns) + [pa.array(text, pa.string())], [*names, "decoded"])

    return rows.mapInArrow(run, schema)
