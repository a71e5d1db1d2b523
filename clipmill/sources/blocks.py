"""One large CSV or JSON file split over tasks although its records may hold the separator.

Spark's text source cuts a file into blocks at a separator character and reads them side by side. Whether a separator ends a record depends
on all text before it: is a quoted value open. So a file is read twice:

1. every block gives, for each of the two states it may begin in, the state it ends in (and for JSON the change of depth). These
   functions of two states are constant, the identity or a swap; running sums compose them over the blocks of a file, which
   gives each block its true first state. One row per block.
2. every block is read again from its state: records inside it are whole; what is open at its ends are pieces, at most two per block, and
   pieces of one record are joined by their place.

Both passes are Arrow batches of text in file order; nothing but blocks' facts and pieces is shuffled. A file that cannot be split
(compressed) is one block.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clipmill.session import stored

_FACTS = "path string, block long, to0 int, to1 int, d0 long, d1 long, base int"
_PIECES = "path string, block long, part long, kind string, value string"


def fragments(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(path, block, value): text up to each separator, in file order within a block."""
    raw = spark.read.option("lineSep", separator).text(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")


def _runs(batches: Iterator[pa.RecordBatch]):
    """(path, block, values) of each stretch of a batch within one block."""
    for batch in batches:
        paths, blocks, values = (batch.column(i).to_pylist() for i in range(3))
        at = 0
        while at < len(values):
            end = at + 1
            while end < len(values) and blocks[end] == blocks[at] and paths[end] == paths[at]:
                end += 1
            yield paths[at], blocks[at], [v or "" for v in values[at:end]], batch.slice(at, end - at)
            at = end


def block_states(rows: DataFrame, step: Callable[[int, str], tuple[int, int]], base: Callable[[str], int]) -> DataFrame:
    """(path, block, state, depth, base): the state in which every block begins.

    ``step(state, fragment)`` gives the state after a fragment and the change of depth; ``base`` looks at a file's first fragment.
    """

    def run(batches):
        now, facts = None, None
        out = lambda: pa.RecordBatch.from_pylist([dict(zip(("path", "block", "to0", "to1", "d0", "d1", "base"), (*now, *facts)))], schema=schema)
        for path, block, values, _ in _runs(batches):
            if (path, block) != now:
                if now is not None:
                    yield out()
                now, facts = (path, block), [0, 1, 0, 0, base(values[0]) if block == 0 else None]
            for value in values:
                for s in (0, 1):
                    facts[s], d = step(facts[s], value)
                    facts[2 + s] += d
        if now is not None:
            yield out()

    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("to0", pa.int32()), ("to1", pa.int32()), ("d0", pa.int64()), ("d1", pa.int64()), ("base", pa.int32())])
    facts = rows.mapInArrow(run, _FACTS)
    line = W.partitionBy("path").orderBy("block")
    before = line.rowsBetween(W.unboundedPreceding, -1)
    swaps = F.coalesce(F.sum(((F.col("to0") == 1) & (F.col("to1") == 0)).cast("int")).over(before), F.lit(0))
    fixed = F.when(F.col("to0") == F.col("to1"), F.struct(F.col("to0").alias("to"), F.col("swaps").alias("at")))
    last = F.last(fixed, True).over(before)
    state = F.pmod(F.coalesce(last["to"], F.lit(0)) + F.col("swaps") - F.coalesce(last["at"], F.lit(0)), F.lit(2))
    change = F.when(F.col("state") == 0, F.col("d0")).otherwise(F.col("d1"))
    states = facts.withColumn("swaps", swaps).withColumn("state", state.cast("int")).select(
        "path", "block", "state", F.coalesce(F.sum(change).over(before), F.lit(0)).alias("depth"),
        F.coalesce(F.first("base").over(line), F.lit(0)).alias("base"))
    return stored(states, "block-states")


def cut_records(rows: DataFrame, states: DataFrame, cutter: Callable) -> DataFrame:
    """(path, block, part, value) of all records; ``part`` is a record's place within the block in which it begins.

    ``cutter(state, depth, base, first)`` gives an object whose ``feed(fragment)`` returns a finished record or None (or "" when there
    is none to keep), with ``open`` true inside a record and ``rest()`` the text of the open one.
    """

    def run(batches):
        now, cut, part, begun = None, None, 0, True

        def batch(found):
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]] * len(found), pa.string()), pa.array([now[1]] * len(found), pa.int64()), pa.array([x[0] for x in found], pa.int64()),
                 pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.string())], names=["path", "block", "part", "kind", "value"])

        def close():
            return [(part, "head" if begun else "middle", cut.rest())] if cut.open else []

        for path, block, values, rest in _runs(batches):
            if (path, block) != now:
                if now is not None:
                    yield batch(close())
                now = (path, block)
                state, depth, base = (rest.column(i)[0].as_py() for i in range(4, 7))
                cut, part = cutter(state, depth, base, block == 0), 0
                begun = not cut.open
            found = []
            for value in values:
                record = cut.feed(value)
                if record is None:
                    continue
                if record or not begun:
                    found.append((part, "whole" if begun else "tail", record))
                    part += 1
                begun = True
            yield batch(found)
        if now is not None:
            yield batch(close())

    placed = rows.withColumn("id", F.monotonically_increasing_id()).join(states, ["path", "block"]).select("path", "block", "value", "id", "state", "depth", "base")
    made = stored(placed.sortWithinPartitions("path", "block", "id").mapInArrow(run, _PIECES), "block-records")
    line = W.partitionBy("path").orderBy("block", "part").rowsBetween(W.unboundedPreceding, 0)
    pieces = made.filter("kind <> 'whole'")
    owner = F.last(F.when(F.col("kind") == "head", F.struct("block", "part")), True).over(line)
    joined = (
        pieces.withColumn("owner", owner).groupBy("path", "owner")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "value"))), lambda p: p["value"]), "").alias("value"))
    )
    whole = made.filter("kind = 'whole'").select("path", "block", "part", "value")
    return whole.unionByName(joined.select("path", "owner.block", "owner.part", "value"))


# --- CSV

def csv_step(state: int, line: str) -> tuple[int, int]:
    """Is a quoted value open after ``line`` and its line break; a quote opens a value only at the value's beginning."""
    if '"' not in line:
        return state, 0
    at, n = 0, len(line)
    opened = state == 1
    while True:
        if opened:
            while True:  # to the quote that ends the value
                at = line.find('"', at)
                if at < 0:
                    return 1, 0
                if line.startswith('""', at):
                    at += 2
                    continue
                break
            at += 1
        comma = line.find(",", at)
        if not opened and line.startswith('"', at):
            at, opened = at + 1, True
            continue
        if comma < 0:
            return 0, 0
        at, opened = comma + 1, False
        if at >= n:
            return 0, 0


class _CsvCutter:
    def __init__(self, state: int, depth: int, base: int, first: bool):
        self.open, self.lines, self.first = state == 1, [], first

    def feed(self, line: str) -> str | None:
        if self.first:
            line, self.first = line.removeprefix("﻿"), False
        after, _ = csv_step(int(self.open), line)
        self.lines.append(line)
        self.open = after == 1
        if self.open:
            return None
        record = "\n".join(self.lines).removesuffix("\r")
        self.lines = []
        return record if record.strip() else ""

    def rest(self) -> str:
        return "\n".join(self.lines) + "\n"


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, part, value): the records of CSV files with ``"`` doubled inside quoted values, line breaks included; blank ones are left out."""
    rows = fragments(spark, path, "\n")
    return cut_records(rows, block_states(rows, csv_step, lambda line: 0), _CsvCutter)


# --- JSON

_STRING, _STRING_REST, _OPENING, _CLOSING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S), re.compile(r'(?:[^"\\]|\\.)*"', re.S), re.compile(r"[{\[]"), re.compile(r"[}\]]")


def json_step(state: int, fragment: str, ended: bool = True) -> tuple[int, int]:
    """(is a string open, change of depth) after ``fragment`` and the ``}`` that follows it."""
    if state:
        rest = _STRING_REST.match(fragment)
        if rest is None:
            return 1, 0
        fragment = fragment[rest.end():]
    bare = _STRING.sub("", fragment)
    quote = bare.find('"')
    if quote >= 0:
        bare = bare[:quote]
    depth = len(_OPENING.findall(bare)) - len(_CLOSING.findall(bare))
    return (1, depth) if quote >= 0 else (0, depth - ended)


class _JsonCutter:
    """Objects at the depth of the array's elements; a file that is no array holds objects one after the other."""

    def __init__(self, state: int, depth: int, base: int, first: bool):
        self.state, self.depth, self.base, self.first, self.parts = state, depth, base, first, []
        self.open = self.tail = depth > base or state == 1

    def feed(self, fragment: str) -> str | None:
        if self.first:
            fragment, self.first = fragment.removeprefix("﻿"), False
        shown = fragment
        if not self.open:
            shown = fragment.lstrip(" \t\r\n,[") if self.depth == self.base else fragment.lstrip(" \t\r\n[")
        self.state, change = json_step(self.state, fragment)
        self.depth += change
        self.parts.append(shown + "}")
        self.open = self.state == 1 or self.depth > self.base
        if self.open:
            return None
        record, tail = "".join(self.parts), self.tail
        self.parts, self.tail = [], False
        return record if tail or record.strip("]} \t\r\n") else ""  # nothing but the end of the array

    def rest(self) -> str:
        return "".join(self.parts)


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, part, value): the objects of files that hold one JSON array each (or objects one after the other) as JSON text."""
    rows = fragments(spark, path, "}")
    return cut_records(rows, block_states(rows, json_step, lambda text: int(text.removeprefix("﻿").lstrip().startswith("["))), _JsonCutter)
