"""JSON array files, read by many tasks.

A collection may be one array in one large file, on one line or on many.
Spark's text source cuts it into byte blocks at closing braces, whatever its
lines are, and two passes find the records in them:

1. Each block is summarised for both states in which it may begin, outside or
   inside a string: whether its quotes change that state, how far its brackets
   move the depth, and at which depths it has commas.  Backslashes need no
   state of their own, as a block begins behind a brace.  A file's summaries,
   one small row a block, are composed in order, which gives every block its
   true state, and the block where the record that is open there began.
2. Each block is cut at its commas of depth one.  A record that lies in
   several blocks is put together by the block where it began.

A file may also be one object, which is its only record.

A record must be one object with nothing beside it; that and the brackets of
the file are checked where they are met anyway, so malformed input fails
without a pass of its own.  The text of each record is kept as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlytics.errors import DataValidationError

_OPEN, _CLOSE, _COMMA = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[[0x5B, 0x7B]] = _OPEN
_KIND[[0x5D, 0x7D]] = _CLOSE
_KIND[0x2C] = _COMMA
_STEP = np.array([0, 1, -1, 0], np.int64)
_BLANK = b" \t\n\r"

#: beginning outside, inside a string: depth the block adds, and the depths of its commas
_SUMMARY = ("file string, block long, bytes long, size long, quotes long, first long, add0 long, commas0 array<long>, "
            "add1 long, commas1 array<long>")
_STATE = ("file string, block long, inside boolean, depth long, owner long, started boolean, single boolean, only boolean, "
          "cut boolean, error string")
_ARROW = {"string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "boolean": pa.bool_()}


def _schema(text: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[k]) for n, k in (f.split() for f in text.split(", "))])



def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, size, value): the text up to each closing brace, in order within a block."""
    return (spark.read.option("lineSep", "}").text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value")))


def _stretches(batches) -> Iterator[tuple[str, int, int, np.ndarray]]:
    """(file, block, file size, bytes) of the pieces that follow one another in a block, each with its brace."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        file, block = b.column(0).to_pylist(), np.asarray(b.column(1))
        new = np.flatnonzero([i == 0 or block[i] != block[i - 1] or file[i] != file[i - 1] for i in range(n)])
        col = b.column(3)
        _, ob, db = col.buffers()
        off = np.frombuffer(ob, np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
        data = np.frombuffer(db, np.uint8) if db is not None else np.zeros(0, np.uint8)
        for lo, hi in zip(new.tolist(), [*new[1:].tolist(), n]):
            size = int(off[hi] - off[lo]) + hi - lo
            out = np.empty(size, np.uint8)
            brace = off[lo + 1:hi + 1] - off[lo] + np.arange(hi - lo)
            text = np.ones(size, bool)
            text[brace] = False
            out[brace] = 0x7D
            out[text] = data[off[lo]:off[hi]]
            yield file[lo], int(block[lo]), b.column(2)[lo].as_py(), out


def _marks(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(places of brackets and commas, quotes before each, quotes in all); escaped quotes do not count."""
    quote = buf == 0x22
    back = np.flatnonzero(buf == 0x5C)
    if len(back):
        end = np.flatnonzero(np.append(np.diff(back) != 1, True))
        length = np.diff(np.concatenate([[-1], end]))
        after = back[end[length % 2 == 1]] + 1
        quote[after[after < len(buf)]] = False
    at = np.flatnonzero(quote)
    place = np.flatnonzero(_KIND[buf])
    return place, np.searchsorted(at, place), len(at)


def _summaries(pieces: DataFrame) -> DataFrame:
    def run(batches):
        held: dict | None = None

        def row():
            sides = {f"add{s}": held["depth"][s] for s in (0, 1)} | {f"commas{s}": sorted(held["commas"][s]) for s in (0, 1)}
            return pa.RecordBatch.from_pylist([held | sides], _schema(_SUMMARY))

        for file, block, size, buf in _stretches(batches):
            if held and (held["file"], held["block"]) != (file, block):
                yield row()
                held = None
            if held is None:
                held = {"file": file, "block": block, "bytes": 0, "size": size, "quotes": 0, "first": None, "depth": [0, 0], "commas": [set(), set()]}
            place, before, quotes = _marks(buf)
            kind = _KIND[buf[place]]
            if held["first"] is None and len(place):
                held["first"] = int(buf[place[0]])
            for s in (0, 1):  # the block begins outside, inside a string
                out = kind[(before + held["quotes"] + s) % 2 == 0]
                depth = held["depth"][s] + np.cumsum(_STEP[out])
                if len(depth):
                    held["commas"][s] |= set(depth[out == _COMMA].tolist())
                    held["depth"][s] = int(depth[-1])
            held["quotes"] += quotes
            held["bytes"] += len(buf)
        if held:
            yield row()

    return pieces.mapInArrow(run, _SUMMARY)


def _composed(summaries: DataFrame) -> DataFrame:
    """The state in which each block begins; one group is the small rows of a file."""
    def run(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        inside, depth, owner, started, out, commas = 0, 0, None, False, [], False
        # behind the last piece of a file there is a brace only if its bytes say so
        cut = sum(r["bytes"] for r in rows) != rows[-1]["size"]
        single = rows[0]["first"] == 0x7B  # the file is one object: as if it stood in an array
        for i, r in enumerate(rows):
            out.append({"file": r["file"], "block": r["block"], "inside": bool(inside), "depth": depth, "owner": owner,
                        "started": started, "single": single, "cut": cut and i == len(rows) - 1, "error": None})
            add, top = r[f"add{inside}"], (1 - single - depth) in r[f"commas{inside}"]
            if not started or top:
                owner = r["block"]
            started, commas = True, commas or top
            depth, inside = depth + add, (inside + r["quotes"]) % 2
        depth += int(cut)  # the brace that is not there
        if inside or depth:
            out[-1]["error"] = f"malformed JSON at {key[0].as_py()}: it ends " + ("in a string" if inside else f"at depth {depth}")
        for o in out:
            o["only"] = not commas
        return pa.Table.from_pylist(out, _schema(_STATE))

    return summaries.groupBy("file").applyInArrow(run, _STATE)


class _Cutter:
    """Cuts the bytes of one block, stretch by stretch, into records and ends of records."""

    def __init__(self, file: str, block: int, state: dict):
        self.file, self.block, self.state = file, block, state
        self.inside, self.depth, self.started = int(state["inside"]), state["depth"] + state["single"], state["started"]
        self.owner, self.open, self.closes = state["owner"], [], 0
        self.whole = False  # whether the open record began in this block

    def fail(self, what: str):
        raise ValueError(f"malformed JSON at {self.file}, block at byte {self.block}: {what}")

    def _emit(self, text: bytes, closes: int, ends: bool):
        text, closes = b"".join([*self.open, text]), self.closes + closes
        owner = None if self.whole and ends else self.owner
        self.open, self.closes = [], 0
        if ends:
            self.owner, self.whole = self.block, True
        return owner, self.block, closes, text

    def add(self, buf: np.ndarray) -> Iterator[tuple]:
        place, before, quotes = _marks(buf)
        out = (before + self.inside) % 2 == 0
        place = place[out]
        kind = _KIND[buf[place]]
        depth = self.depth + np.cumsum(_STEP[kind])
        self.inside = (self.inside + quotes) % 2
        raw, lo, first = buf.tobytes(), 0, 0
        if not self.started and self.state["single"]:
            self.started, self.owner = True, self.block
        if not self.started:
            if not len(place):
                if raw.strip(_BLANK):
                    self.fail("no array")
                return
            if raw[place[0]:place[0] + 1] != b"[" or raw[:place[0]].strip(_BLANK):
                self.fail("no array")
            self.started, self.owner, self.whole = True, self.block, True
            lo, first = int(place[0]) + 1, 1
        elif self.depth == 0:
            if raw.strip(_BLANK):
                self.fail("text behind the array")
            return
        ends = np.flatnonzero((kind == _COMMA) & (depth == 1) | (depth == 0))
        closed = np.concatenate([[0], np.cumsum((kind == _CLOSE) & (depth == 1))])
        self.depth = int(depth[-1]) if len(depth) else self.depth
        for i in ends[ends >= first].tolist():
            at = int(place[i])
            if self.state["single"] or depth[i] == 0 and buf[at] != 0x5D:
                self.fail("more than one object" if self.state["single"] else "an array that ends with a brace")
            yield self._emit(raw[lo:at], int(closed[i] - closed[first]), True)
            lo, first = at + 1, i + 1
            if depth[i] == 0:
                if raw[lo:].strip(_BLANK):
                    self.fail("text behind the array")
                self.open, self.owner = [], None
                self.depth = 0
                return
        self.open.append(raw[lo:])
        self.closes += int(closed[-1] - closed[first])

    def last(self, buf: np.ndarray) -> Iterator[tuple]:
        yield from self.add(buf[:-1] if self.state["cut"] else buf)
        if self.open and self.started and self.depth:
            yield self._emit(b"", 0, False)


def _cut(pieces: DataFrame, states: dict) -> DataFrame:
    """(file, owner, block, closes, value): whole records, or with their owner's block their parts."""
    held = pieces.sparkSession.sparkContext.broadcast(states)

    def run(batches):
        cutter: _Cutter | None = None

        def rows(found):
            return pa.RecordBatch.from_arrays(
                [pa.array([cutter.file] * len(found), pa.string()), pa.array([f[0] for f in found], pa.int64()),
                 pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()),
                 pa.array([cutter.state["only"]] * len(found), pa.bool_()),
                 pa.array([f[3] for f in found], pa.binary()).cast(pa.string())],
                ["file", "owner", "block", "closes", "only", "value"])

        ahead = None  # a block's last stretch may have a brace that is not in the file
        for file, block, _, buf in _stretches(batches):
            if cutter and (cutter.file, cutter.block) == (file, block):
                yield rows(list(cutter.add(ahead)))
            else:
                if cutter:
                    yield rows(list(cutter.last(ahead)))
                if (file, block) not in held.value:
                    raise RuntimeError(f"{file} changed, or its splits did, between two passes")
                cutter = _Cutter(file, block, held.value[file, block])
            ahead = buf
        if cutter:
            yield rows(list(cutter.last(ahead)))

    return pieces.mapInArrow(run, "file string, owner long, block long, closes long, only boolean, value string")


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the text of each record of the arrays at ``path``.

    The driver holds the state of each block (a split of
    ``spark.sql.files.maxPartitionBytes``), about 100 bytes, while it starts
    the second pass.  Files without text have no records.
    """
    pieces = _pieces(spark, path)
    states = {}
    for r in _composed(_summaries(pieces)).collect():
        if r["error"]:
            raise DataValidationError(r["error"])
        states[r["file"], r["block"]] = {k: r[k] for k in ("inside", "depth", "owner", "started", "single", "only", "cut")}
    parts = _cut(pieces, states)
    # the check below may run before a filter does, so it leaves alone what the filter drops
    whole = parts.where("owner is null").select("file", "closes", "only", "value", F.col("owner").isNotNull().alias("part"))
    split = (parts.where("owner is not null").groupBy("file", "owner")
             .agg(F.sum("closes").alias("closes"), F.first("only").alias("only"),
                  F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "value"))), lambda x: x["value"]), "").alias("value"))
             .select("file", "closes", "only", "value", F.lit(False).alias("part")))
    record = F.regexp_replace("value", r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    rows = whole.union(split).select("file", "closes", "only", "part", record.alias("value"))
    none = F.col("part") | (F.col("only") & (F.col("value") == ""))
    one = (F.col("closes") == 1) & F.col("value").startswith("{") & F.col("value").endswith("}")
    what = F.concat(F.lit("malformed JSON at "), F.col("file"), F.lit(": a record is not one object: "), F.substring("value", 1, 200))
    return (rows.where(~none)
            .select(F.when(none, F.lit(None).cast("string")).when(one, F.col("value")).otherwise(F.raise_error(what)).alias("value")))
