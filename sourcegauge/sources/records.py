"""Records of CSV files whose quoted cells may hold line breaks, read by many tasks.

Spark reads the lines of a file in blocks. Whether a line break ends a record depends on whether it lies inside quotes, hence on
all lines before it. A first pass takes each block through its lines from both possible states, outside and inside
quotes, and returns in which it ends; a row for each block is composed along the file, which gives the state in which each
block begins. In a second pass each block joins its lines to records. Pieces of records that go over a block's end
are put together by themselves; where no block begins inside quotes there are none.

A cell is quoted if it begins with a quote, doubled quotes inside it are text, and what follows its closing quote runs to the next
separator: quotes inside plain cells count for nothing. Lines end in a line feed, with or without a carriage return.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Functions of this module travel to executors by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Batches = Iterator[pa.RecordBatch]
_BLOCKS = "file string, block long, from_outside boolean, from_inside boolean"
_PIECES = "file string, block long, line long, kind string, record string"
#: Kinds of pieces: whole records, and those that begin, go on or end one that crosses blocks; the header's beginning is told apart.
WHOLE, BEGINS, GOES_ON, HEADER = "whole", "begins", "goes_on", "header"


def line_end(sep: str) -> Callable[[str, bool], bool]:
    """Whether a line ends inside quotes, given whether it begins inside."""
    s = re.escape(sep)
    text = r'(?:[^"]++|"")*+'
    cells = rf'(?:(?:"{text}"[^{s}]*+|[^"{s}][^{s}]*+|){s})*+"{text}\Z'
    from_outside, from_inside = re.compile(cells), re.compile(rf'{text}(?:\Z|"[^{s}]*+{s}{cells})')

    def ends_inside(line: str, inside: bool) -> bool:
        return bool((from_inside if inside else from_outside).match(line))

    return ends_inside


def _by_block(batches: Batches) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Stretches of rows that lie in one block, in the order read."""
    for batch in batches:
        if batch.num_rows:
            ids = pc.run_end_encode(batch.column("block")), pc.run_end_encode(batch.column("file"))
            ends = sorted({e for x in ids for e in x.run_ends.to_pylist()})
            for a, z in zip([0, *ends], ends):
                yield (batch.column("file")[a].as_py(), batch.column("block")[a].as_py()), batch.slice(a, z - a)


def _ends(sep: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        ends_inside = line_end(sep)
        key, states = None, (False, True)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, *states)], [c.split(" ")[0] for c in _BLOCKS.split(", ")])

        for of, rows in _by_block(batches):
            if of != key:
                if key is not None:
                    yield row()
                key, states = of, (False, True)
            lines = rows.column("value")
            for line in lines.filter(pc.match_substring(lines, '"')).to_pylist():
                states = tuple(ends_inside(line, s) for s in states) if states[0] != states[1] else (ends_inside(line, states[0]),) * 2
        if key is not None:
            yield row()

    return run


def _join(sep: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        ends_inside = line_end(sep)
        key, inside, line, kept, kind, since, header = None, False, 0, [], WHOLE, 0, False
        out: list[tuple[int, str, str]] = []

        def flush() -> Batches:
            if out:
                n = len(out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array([x[0] for x in out], pa.int64()),
                     pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.string())], ["file", "block", "line", "kind", "record"])
                out.clear()

        def done(last: bool) -> None:
            """The record that has been read so far is complete, or goes on in the next block."""
            nonlocal header
            text = "\n".join(kept)
            if kind == WHOLE and not last:
                if not text.strip():
                    return
                if header:
                    header = False
                    return
            name = kind if not last or kind == GOES_ON else HEADER if header else BEGINS
            header = header and kind == GOES_ON
            out.append((since, name, text))

        for of, rows in _by_block(batches):
            if of != key:
                if kept:
                    done(True)
                yield from flush()
                key, line, kept, since = of, 0, [], 0
                inside = rows.column("inside")[0].as_py()
                kind, header = GOES_ON if inside else WHOLE, of[1] == 0
            for text in rows.column("value").to_pylist():
                if not kept and not inside:
                    kind, since = WHOLE, line
                if header and line == 0:
                    text = text.removeprefix("﻿")
                kept.append(text)
                line += 1
                if '"' in text:
                    inside = ends_inside(text, inside)
                if not inside:
                    done(False)
                    kept = []
            yield from flush()
        if kept:
            done(True)
        yield from flush()

    return run


def lines_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, value): lines as Spark's blocks hold them; a carriage return at a line's end is kept."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def first_record(lines: DataFrame, separator: Callable[[str], str]) -> tuple[str, str] | None:
    """(separator, record) of the first record with text, or None; ``separator`` tells it from a record's first line. Reads as many lines as needed."""
    n, before = 1, -1
    while True:
        text = [r[0] for r in lines.select("value").limit(n).collect()]
        read = len(text)
        while text and not text[0].removeprefix("\ufeff").strip():
            text = text[1:]
        inside = bool(text)
        if text:
            text[0] = text[0].removeprefix("\ufeff")
            sep = separator(text[0].rstrip("\r"))
            ends_inside, inside = line_end(sep), False
            for k, line in enumerate(text):
                inside = ends_inside(line, inside)
                if not inside:
                    return sep, "\n".join(text[: k + 1]).rstrip("\r")
        if read == before:  # the file has no more lines
            return (sep, "\n".join(text)) if text else None
        n, before = n * 2, read


def records(spark: SparkSession, path: str | list[str], sep: str) -> DataFrame:
    """(file, block, line, record) of all files but their headers: each first record with text. Blank records are left out.

    ``line`` counts the lines of a block; (file, block, line) gives the order. Blocks follow ``spark.sql.files.maxPartitionBytes``.
    """
    lines = lines_of(spark, path)
    blocks = lines.mapInArrow(_ends(sep), _BLOCKS)
    # One row for each block of about 128 MB. States are composed in file order.
    steps = blocks.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("block", "from_outside", "from_inside"))).alias("steps"))
    begin = F.struct(F.lit(False).alias("inside"), F.array().cast("array<struct<block:bigint,inside:boolean>>").alias("known"))
    composed = F.aggregate("steps", begin, lambda a, x: F.struct(
        F.when(a["inside"], x["from_inside"]).otherwise(x["from_outside"]).alias("inside"),
        F.concat(a["known"], F.array(F.struct(x["block"].alias("block"), a["inside"].alias("inside")))).alias("known")))
    known = steps.select("file", composed.alias("c")).select("file", F.col("c.inside").alias("open"), F.explode("c.known").alias("k"))
    known = known.select("file", "open", "k.block", "k.inside").where("inside OR open").collect()
    inside = {(r.file, r.block) for r in known if r.inside}
    marks = spark.createDataFrame([(f, b, True) for f, b in inside], "file string, block long, inside boolean")
    # The marked blocks are few, and a mark stands for 128 MB of input: they are broadcast, so the lines keep their order.
    marked = lines.join(F.broadcast(marks), ["file", "block"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    pieces = marked.select("file", "block", "inside", "value").mapInArrow(_join(sep), _PIECES)
    whole = pieces.where(F.col("kind") == WHOLE).select("file", "block", "line", "record")
    if not known:
        return whole
    parts = pieces.where(F.col("kind") != WHOLE)
    number = F.sum((F.col("kind") != GOES_ON).cast("int")).over(W.partitionBy("file").orderBy("block", "line"))
    place = F.struct("block", "line", "record")
    put = parts.withColumn("number", number).groupBy("file", "number").agg(
        F.sort_array(F.collect_list(place)).alias("p"), F.max(F.col("kind") == HEADER).alias("header")).where("NOT header")
    put = put.select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["line"].alias("line"),
                     F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"))
    return whole.unionByName(put)
