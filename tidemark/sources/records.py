"""Records that span lines (quoted CSV fields) or share one line (JSON lists), cut in parallel.

A file is read in ordinary splits as pieces between separators (line feeds for CSV, commas for a JSON
list). Whether a separator ends a record depends on what stands before it: an open quote, or the bracket
depth. So the pieces are read twice:

1. every split tells where it would lead from either start (outside or inside quotes), its change of
   depth and the least depth at a separator: one row a split, however large the file. The driver composes them in file order, which gives
   the true state at each split's start;
2. every split puts its pieces together to records. The beginning and end of a split that belong to a
   record across its border are joined by the split in which that record starts.

Nothing reads a file whole: the driver holds a few numbers for each split, a task a batch of at most
``BATCH_BYTES``, the record that is open and as many finished ones as ``HELD_BYTES`` take.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import bounded_batches

HELD_BYTES = 4 << 20


class QuotedLines:
    """Pieces of delimited text: a record ends with a line that leaves no quote open."""

    joint, level = b"\n", 0

    def __init__(self, sep: str, skip_space: bool = False):
        self.sep, self.skip_space = sep.encode(), skip_space

    def step(self, piece: bytes, inside: int) -> tuple[int, int]:
        """(inside quotes at the end, change of depth)."""
        if b'"' not in piece:
            return inside, 0
        at = 0
        while True:
            if inside:
                end = piece.find(b'"', at)
                while end >= 0 and piece[end + 1:end + 2] == b'"':
                    end = piece.find(b'"', end + 2)
                if end < 0:
                    return 1, 0
                at, inside = end + 1, 0
            else:
                start = at
                if self.skip_space:
                    while piece[start:start + 1] == b" ":
                        start += 1
                if piece[start:start + 1] == b'"':
                    at, inside = start + 1, 1
                    continue
            cut = piece.find(self.sep, at)
            if cut < 0:
                return 0, 0
            at = cut + len(self.sep)  # the next field starts


class ListElements:
    """Pieces of a JSON list between commas: an element ends outside strings at depth 1."""

    joint, level = b",", 1
    _text = re.compile(rb'"(?:[^"\\]|\\.)*"', re.S)
    _rest = re.compile(rb'(?:[^"\\]|\\.)*"', re.S)

    def step(self, piece: bytes, inside: int) -> tuple[int, int]:
        if inside:
            end = self._rest.match(piece)
            if end is None:
                return 1, 0
            piece = piece[end.end():]
        bare = self._text.sub(b"", piece)
        open_ = bare.find(b'"')
        if open_ >= 0:
            bare = bare[:open_]
        depth = bare.count(b"[") + bare.count(b"{") - bare.count(b"]") - bare.count(b"}")
        return int(open_ >= 0), depth


@dataclass(frozen=True)
class Start:
    """State at a split's first byte; ``owner`` is the split of the record that is open there, if any."""

    no: int
    inside: int
    depth: int
    owner: int | None


def _runs(batches):
    """(file, offset, pieces) for each run of pieces of one split, batch by batch."""
    for batch in batches:
        files, offsets = batch.column("file").to_pylist(), batch.column("at").to_pylist()
        pieces = batch.column("piece").to_pylist()
        lo = 0
        for i in range(1, len(pieces) + 1):
            if i == len(pieces) or files[i] != files[lo] or offsets[i] != offsets[lo]:
                yield files[lo], offsets[lo], pieces[lo:i]
                lo = i


def _summaries(grammar):
    def run(batches):
        ends: dict[tuple[str, int], list] = {}
        for file, at, pieces in _runs(batches):
            state = ends.setdefault((file, at), [(0, 0, None), (1, 0, None)])
            for p in pieces:
                for s in (0, 1):
                    inside, depth, least = state[s]
                    inside, change = grammar.step(p, inside)
                    depth += change
                    if not inside:
                        least = depth if least is None else min(least, depth)
                    state[s] = (inside, depth, least)
        if ends:
            yield pa.record_batch([
                pa.array([k[0] for k in ends]), pa.array([k[1] for k in ends], pa.int64()),
                *[pa.array([v[s][i] for v in ends.values()], pa.int64()) for s in (0, 1) for i in (0, 1, 2)],
            ], names=["file", "at", "inside0", "depth0", "least0", "inside1", "depth1", "least1"])

    return run


def _assembled(grammar, starts):
    def run(batches):
        now: dict[tuple[str, int], list] = {}
        rows: list[tuple] = []
        held = 0

        def flushed():
            nonlocal held
            out = pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                                   pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.bool_()),
                                   pa.array([r[4] for r in rows], pa.bool_()), pa.array([r[5] for r in rows], pa.binary())],
                                  names=["file", "owner", "no", "head", "tail", "record"])
            rows.clear()
            held = 0
            return out

        for file, at, pieces in _runs(batches):
            key = (file, at)
            start = starts.value[key]
            # inside, depth, owner of the open record, its pieces, whether the first record is still to come
            state = now.setdefault(key, [start.inside, start.depth, start.owner, [], start.no == 0])
            for p in pieces:
                inside, change = grammar.step(p, state[0])
                state[0], state[1] = inside, state[1] + change
                state[3].append(p)
                if inside == 0 and state[1] == grammar.level:
                    record = grammar.joint.join(state[3])
                    if record.strip():
                        # an end of a record that began in an earlier split waits for its beginning
                        rows.append((file, state[2], start.no, state[4] and state[2] is None, False, record))
                        state[4] = False
                    elif state[2] is not None:
                        rows.append((file, state[2], start.no, False, False, record))
                    state[2], state[3] = None, []
                    held += len(record)
                    if rows and (len(rows) >= 4096 or held >= HELD_BYTES):
                        yield flushed()
        for (file, at), (inside, depth, owner, rest, head) in now.items():
            if rest:
                no = starts.value[(file, at)].no
                rows.append((file, no if owner is None else owner, no, head and owner is None, depth < grammar.level, grammar.joint.join(rest)))
        if rows:
            yield flushed()

    return run


def _pieces(spark: SparkSession, path: str, joint: bytes) -> DataFrame:
    lines = spark.read.option("lineSep", joint.decode()).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
                        F.col("value").cast("binary").alias("piece"))


def split_starts(pieces: DataFrame, grammar) -> dict[tuple[str, int], Start]:
    """The state at the start of every split (one row a split reaches the driver)."""
    found = pieces.mapInArrow(_summaries(grammar), "file string, at long, inside0 long, depth0 long, least0 long, "
                                                    "inside1 long, depth1 long, least1 long").collect()
    starts, file, state = {}, None, (0, 0)
    no, owner = 0, None
    for r in sorted(found, key=lambda r: (r.file, r["at"])):
        if r.file != file:
            file, state, no, owner = r.file, (0, 0), 0, None
        starts[(r.file, r["at"])] = Start(no, state[0], state[1], owner)
        inside, change, least = (r.inside1, r.depth1, r.least1) if state[0] else (r.inside0, r.depth0, r.least0)
        # a record ended in this split if some piece came down to the level of records
        ended = least is not None and state[1] + least <= grammar.level
        state = (inside, state[1] + change)
        if state == (0, grammar.level):
            owner = None
        elif ended or owner is None:
            owner = no
        no += 1
    return starts


def records(spark: SparkSession, path: str, grammar, charset: str = "UTF-8") -> DataFrame:
    """One row a record: ``record`` text, ``head`` (first of its file), ``tail`` (the file ends with it).

    Blank records are left out. A record across splits is put together by an aggregate over its few
    parts (one a split it touches), the others stay where they are.
    """
    bounded_batches(spark)
    pieces = _pieces(spark, path, grammar.joint)
    starts = spark.sparkContext.broadcast(split_starts(pieces, grammar))
    rows = pieces.mapInArrow(_assembled(grammar, starts),
                             "file string, owner long, no long, head boolean, tail boolean, record binary")
    text = F.col("record").cast("string") if charset == "UTF-8" else F.decode("record", charset)
    rows = rows.select("file", "owner", "no", "head", "tail", text.alias("record"))
    whole = rows.filter("owner is null").select("record", "head", "tail")
    parts = rows.filter("owner is not null").groupBy("file", "owner").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "record"))), lambda p: p["record"]), grammar.joint.decode()).alias("record"),
        F.bool_or("head").alias("head"), F.bool_or("tail").alias("tail")).select("record", "head", "tail")
    return whole.unionByName(parts).filter(F.length(F.trim("record")) > 0)


def list_elements(spark: SparkSession, path: str) -> DataFrame:
    """The elements of a JSON list as text (column ``value``), one row each."""
    rows = records(spark, path, ListElements())
    text = F.when(F.col("head"), F.regexp_replace("record", r"^﻿?\s*\[", "")).otherwise(F.col("record"))
    # the closing bracket is the last character of the file's last element
    text = F.when(F.col("tail"), F.regexp_replace(text, r"\]\s*$", "")).otherwise(text)
    return rows.select(F.regexp_replace(text, r"^\s+|\s+$", "").alias("value")).filter("value <> ''")
