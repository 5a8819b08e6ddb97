"""Quoted delimited files whose fields may hold line breaks, read by many tasks.

Where a block of a file starts, it isn't known whether its first line lies inside a
quoted field. A block therefore first tells how it would end for either start: left
alone, turned over, or set by its own quotes. One running sum of the turns per file,
with the last set block as its origin, then gives every block its start. In the last
pass each block cuts its lines into records; what a block boundary cuts in two, at most
one piece at either end of a block, is put together again by position.

No line is shuffled but these pieces, and no task reads more than its block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

_CLOSED = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')     # up to the quote that ends a field
_PLACE = ["file", "start", "length"]


def ends_inside(line: str, separator: str, inside: bool) -> bool:
    """Whether a quoted field is open behind ``line``, given whether one was before it.
    A quote opens a field at its first place only; elsewhere in it, it is text."""
    opening, at = separator + '"', 0
    if not inside:
        if not line.startswith('"'):
            at = line.find(opening)
            if at < 0:
                return False
            at += len(opening)
        else:
            at = 1
    while closed := _CLOSED.match(line, at):
        at = line.find(opening, closed.end())
        if at < 0:
            return False
        at += len(opening)
    return True


def _blocks(lines: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Array]]:
    """(place, lines) for the runs of lines of one block within a batch."""
    for batch in lines:
        if batch.num_rows == 0:
            continue
        starts, files = batch["start"].to_numpy(), batch["file"].to_numpy()
        cuts = [0, *((starts[1:] != starts[:-1]) | (files[1:] != files[:-1])).nonzero()[0] + 1, batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield tuple(batch[c][int(a)].as_py() for c in _PLACE), batch.slice(int(a), int(b - a))


def _turns(separator: str):
    """Per block: how it ends if it starts outside or inside a quoted field."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ends, done = None, [False, True], []
        for now, lines in _blocks(batches):
            if now != place:
                if place is not None:
                    done.append((*place, *ends))
                place, ends = now, [False, True]
            quoted = lines["value"].filter(pc.match_substring(lines["value"], '"'))
            for line in quoted.to_pylist():
                ends = [ends_inside(line, separator, e) for e in ends]
        if place is not None:
            done.append((*place, *ends))
        if done:
            kinds = [pa.int64()] * 3 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], [*_PLACE, "outside", "inside"])

    return work


def _start_states(turns: DataFrame) -> DataFrame:
    """(file, start, length, open, ends): whether a field is open where a block starts
    and where it ends. A table of one row per block of the input."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    turned = F.sum((F.col("outside") & ~F.col("inside")).cast("long"))
    sums = turns.select("*", F.coalesce(turned.over(before), F.lit(0)).alias("turned"))
    # A block that ends the same way in any case sets the origin of the sum behind it.
    origin = F.when(F.col("outside") == F.col("inside"), F.col("outside").cast("long") + F.col("turned"))
    placed = sums.select("*", F.coalesce(F.last(origin, ignorenulls=True).over(before), F.lit(0)).alias("origin"))
    open_ = ((F.col("origin") + F.col("turned")) % 2 == 1).alias("open")
    return placed.select(*_PLACE, open_, "outside", "inside").select(
        *_PLACE, "open", F.when(F.col("open"), F.col("inside")).otherwise(F.col("outside")).alias("ends"))


# Of a record: all, up to its end or the block's, from its start; the file's header from its start.
WHOLE, TAIL, HEAD, HEADER = 0, 1, 2, 3
_RECORDS = "file bigint, start bigint, piece int, record string"


def _records(separator: str, pieces: bool):
    """Records of the blocks: the whole ones, or the pieces at the blocks' ends. The
    first record of a file, its header, is left out or marked."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, inside, kind, first = None, [], False, WHOLE, False
        out = []

        def close(part: int) -> None:
            nonlocal first
            if (part != WHOLE) == pieces and not (first and part == WHOLE):
                out.append((*place[:2], HEADER if first else part, "\n".join(held)))
            first = False
            held.clear()

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(c, k) for c, k in zip(zip(*out), [pa.int64(), pa.int64(), pa.int32(), pa.string()])]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, ["file", "start", "piece", "record"])

        for now, lines in _blocks(batches):
            if now != place:
                if held:
                    close(TAIL if kind == TAIL else HEAD)
                place, inside = now, lines["open"][0].as_py()
                kind, first = (TAIL if inside else WHOLE), now[1] == 0
            for line, quoted in zip(lines["value"].to_pylist(), pc.match_substring(lines["value"], '"').to_pylist()):
                held.append(line)
                if quoted:
                    inside = ends_inside(line, separator, inside)
                if not inside:
                    close(kind)
                    kind = WHOLE
            if out:
                yield flush()
        if held:
            close(TAIL if kind == TAIL else HEAD)
        if out:
            yield flush()

    return work


def _joined(pieces: DataFrame) -> DataFrame:
    """Records cut by block boundaries: a head and the tails up to the next head; a piece
    that runs from one end of its block to the other is a tail. At most two per block."""
    order = Window.partitionBy("file").orderBy("start", "piece")
    number = F.sum((F.col("piece") >= HEAD).cast("long")).over(order).alias("number")
    parts = F.array_sort(F.collect_list(F.struct("start", "piece", "record")))
    records = pieces.select("*", number).groupBy("file", "number").agg(
        F.array_join(F.transform(parts, lambda p: p["record"]), "\n").alias("record"), F.max("piece").alias("piece"))
    return records.where(F.col("piece") != HEADER).select("record")


def read_quoted(spark: SparkSession, path: str, schema: T.StructType, separator: str = ",") -> DataFrame:
    """Rows of delimited files with a header line. A field that starts with a quote ends
    at the next single one, may hold separators and line breaks, and a doubled quote in
    it stands for one. Records end with a line feed, a carriage return before it is
    dropped. Blank records are skipped.

    The blocks of the input are those of the session's file settings. The scan is made
    three times at most; should its blocks have changed in between, the read fails.
    """
    block = [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
             F.col("_metadata.file_block_length").alias("length")]
    lines = spark.read.text(path, lineSep="\n").select("value", *block)
    turns = lines.mapInArrow(_turns(separator), "file bigint, start bigint, length bigint, outside boolean, inside boolean")
    # One row per block, that is per spark.sql.files.maxPartitionBytes of the input: this
    # bounds what the driver holds and what is broadcast.
    rows = _start_states(turns).collect()
    states = spark.createDataFrame(rows, "file bigint, start bigint, length bigint, open boolean, ends boolean")
    known = F.when(F.col("open").isNull(), F.raise_error(F.lit("the blocks of the input have changed"))).otherwise(F.col("open")).alias("open")
    placed = lines.join(F.broadcast(states), _PLACE, "left").select("value", *_PLACE, known)
    records = placed.mapInArrow(_records(separator, False), _RECORDS).select("record")
    cut = [r for r in rows if r["open"] or r["ends"]]
    if cut:
        ends = F.broadcast(spark.createDataFrame(cut, states.schema))
        pieces = lines.join(ends, _PLACE).select("value", *_PLACE, "open").mapInArrow(_records(separator, True), _RECORDS)
        records = records.unionByName(_joined(pieces))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    options = {"sep": separator, "quote": '"', "escape": '"', "multiLine": "true"}
    parsed = (
        records.select(F.regexp_replace("record", "\r$", "").alias("record")).where(F.trim("record") != "")
        .select(F.from_csv("record", ddl, options).alias("row")))
    return parsed.select([F.col("row")[f.name].alias(f.name) for f in schema.fields])
