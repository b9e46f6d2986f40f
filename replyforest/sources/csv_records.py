"""CSV records with line breaks in quotes, read by many tasks.

A file is read as text lines in splits.  A line ends inside or outside of a quoted value, depending on where it began, so
a split as a whole turns two states into two.  A prefix over the splits, as with sums of quote parity, tells in which
state each begins.  A line that ends outside of quotes ends a record, so every task then puts the lines of its splits
together; only the records that cross the border of a split are completed by a shuffle.  What a record holds is left to
Spark's own reader of records.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Tasks get the functions of this module with the job, so that it need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAME = 2  # the code of a line that ends in the state in which it begins
SPLIT = "path string, file bigint, split bigint, from_outside boolean, from_inside boolean, closes boolean, returns boolean, lone boolean"
RECORD = "file bigint, split bigint, place bigint, owner bigint, crlf boolean, record binary"
ARROW = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _ends_inside(line: Column, inside: bool) -> Column:
    """Whether a line that begins inside or outside of a quoted value ends inside of one.

    A quote opens a value at its beginning; inside, two in a row are text; anywhere else a quote is text too.
    """
    outside, within, closed, begin = range(4)

    def quote(state: Column, before: Column) -> Column:
        opens = before.endswith(",") | ((before == "") & state.isin(closed, begin))
        return F.when(state == within, closed).when(opens, within).otherwise(outside)

    parts = F.split(line, '"', -1)
    before_quotes = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.aggregate(before_quotes, F.lit(within if inside else begin), quote) == within


def _lines(spark: SparkSession, path: str | list[str], line_end: str = "\n") -> DataFrame:
    """All lines with their file and split, in the order of the files.

    ``code`` has a bit for either state a line can begin in: whether it then ends inside of quotes.
    """
    lines = spark.read.option("lineSep", line_end).text(path)
    line = F.col("value")
    code = F.when(~F.contains(line, F.lit('"')), SAME)
    code = code.otherwise(_ends_inside(line, False).cast("int") + 2 * _ends_inside(line, True).cast("int"))
    return lines.select(
        F.col("_metadata.file_path").alias("path"),
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        line.cast("binary").alias("line"),
        code.alias("code"),
    )


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split from its lines ``(path, file, split, code, returns, lone)`` in their order."""
    row = None
    done: list[tuple] = []
    for batch in batches:
        path, code, returns, lone = batch.column(0), np.asarray(batch.column(3)), batch.column(4), batch.column(5)
        place = np.stack([np.asarray(batch.column(1)), np.asarray(batch.column(2))])
        borders = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1
        for begin, end in zip([0, *borders], [*borders, len(code)]):
            if begin == end:
                continue
            file, split = place[:, begin].tolist()
            if row is None or row[1:3] != [file, split]:
                if row:
                    done.append(tuple(row))
                first = int(begin)
                row = [path[first].as_py(), file, split, False, True, False, returns[first].as_py(), lone[first].as_py()]
            for c in code[begin:end][code[begin:end] != SAME].tolist():
                row[3:5] = bool(c >> row[3] & 1), bool(c >> row[4] & 1)
                row[5] |= not row[4]
        if done:
            yield _rows(done, SPLIT)
            done.clear()
    if row:
        yield _rows([tuple(row)], SPLIT)


def _splits(lines: DataFrame) -> DataFrame:
    """``file, split, path, inside, owner, crlf, lone``: whether a split begins inside quotes, the split in which that
    record began, and whether the first line of the file ends in a carriage return, or holds one that ends lines alone.

    One row per split comes together in the windows, a few bytes per 128 MB of input.
    """
    text = F.col("line").cast("string")
    returns, lone = text.endswith("\r").alias("returns"), F.locate("\r", text).between(1, F.length(text) - 1).alias("lone")
    summed = lines.select("path", "file", "split", "code", returns, lone).mapInArrow(_summed, SPLIT)
    # A split either ends in one state whatever it began in, or turns the states, or leaves them.
    fixed = F.col("from_outside") == F.col("from_inside")
    until = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    turned = summed.withColumn("turned", F.sum(F.when(~fixed & F.col("from_outside"), 1).otherwise(0)).over(until))
    last = F.last(F.when(fixed, F.struct(F.col("from_inside").cast("int").alias("state"), "turned")), ignorenulls=True).over(before)
    turned = turned.withColumn("last", last).withColumn("turned_before", F.coalesce(F.max("turned").over(before), F.lit(0)))
    state = F.coalesce(F.col("last.state"), F.lit(0)) + F.col("turned_before") - F.coalesce(F.col("last.turned"), F.lit(0))
    begun = turned.withColumn("inside", state % 2 == 1)
    # It ends in a record of its own, unless it lies in one of an earlier split as a whole.
    ends_inside = F.when(F.col("inside"), F.col("from_inside")).otherwise(F.col("from_outside"))
    begins_one = ends_inside & (~F.col("inside") | F.col("closes"))
    owner = F.max(F.when(begins_one, F.col("split"))).over(before)
    file = Window.partitionBy("file")
    crlf = F.max(F.when(F.col("split") == 0, F.col("returns"))).over(file)
    lone = F.coalesce(F.max(F.when(F.col("split") == 0, F.col("lone"))).over(file), F.lit(False))
    return begun.select("file", "split", "path", "inside", owner.alias("owner"), F.coalesce(crlf, F.lit(False)).alias("crlf"), lone.alias("lone"))


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from lines ``(file, split, line, code, inside, owner, crlf)`` in their order.

    A piece of a record that crosses a border has an owner, the split in which the record begins.
    """
    current, open_lines, inside, piece_owner, place, current_crlf = None, [], False, None, 0, False
    out: list[tuple] = []

    def close(owner):
        nonlocal place
        out.append((*current, place, owner, current_crlf, b"\n".join(open_lines)))
        open_lines.clear()
        place += 1

    for batch in batches:
        for file, split, line, code, begins_inside, owner, crlf in zip(*[column.to_pylist() for column in batch.columns]):
            if current != (file, split):
                if open_lines:
                    close(current[1] if piece_owner is None else piece_owner)
                current, inside, place, current_crlf = (file, split), begins_inside, 0, crlf
                piece_owner = owner if begins_inside else None
            open_lines.append(line)
            inside = bool(code >> inside & 1)
            if not inside:
                close(piece_owner)
                piece_owner = None
        if out:
            yield _rows(out, RECORD)
            out.clear()
    if open_lines:
        close(current[1] if piece_owner is None else piece_owner)
        yield _rows(out, RECORD)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*[field.split() for field in schema.split(", ")])
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[k]) for c, k in zip(zip(*rows), kinds)], names=names)


def csv_records(spark: SparkSession, path: str | list[str], header: bool = True) -> DataFrame:
    """``path, split, place, record`` of every CSV record; the first three tell its place in the order of the files.

    Quoted text may hold line breaks and doubled quotes; a quote inside a value that does not begin with one is text.
    Lines end as the first line of their file does, in a line feed, in a carriage return and a line feed, or in a
    carriage return, and line breaks of that kind inside of quotes come as line feeds.  Empty lines are no records; a
    record that is still open at the end of its file ends there.  With ``header`` the first record of every file is left
    out.  The quotes are counted at once, records are read with the result.
    """
    lines = _lines(spark, path)
    splits = _splits(lines).persist()  # one row per split; what an executor loses of it is counted again
    records = _records(lines, splits.where("not lone"), header)
    old = splits.where("lone")
    if not old.isEmpty():
        lines = _lines(spark, path, "\r").join(F.broadcast(old.select("file")), "file", "left_semi")
        records = records.unionByName(_records(lines, _splits(lines), header))
    return records


def _records(lines: DataFrame, splits: DataFrame, header: bool) -> DataFrame:
    # One row per split, less than 32 bytes for each 128 MB of input; the order of the lines stays.
    known = lines.drop("path").join(F.broadcast(splits.drop("path", "lone")), ["file", "split"])
    pieces = known.select("file", "split", "line", "code", "inside", "owner", "crlf").mapInArrow(_put_together, RECORD)
    whole = pieces.where("owner is null").drop("owner")
    parts = pieces.where("owner is not null").groupBy("file", F.col("owner").alias("split"), "crlf")
    # A group is the one record that crosses these borders.
    piece = F.array_sort(F.collect_list(F.struct("split", "place", "record")))
    crossing = parts.agg(piece.alias("parts")).select(
        "file",
        "split",
        F.col("parts")[0]["place"].alias("place"),
        "crlf",
        F.array_join(F.transform("parts", lambda p: p["record"].cast("string")), "\n").cast("binary").alias("record"),
    )
    text = F.col("record").cast("string")
    plain = F.replace(F.regexp_replace(text, "\r$", ""), F.lit("\r\n"), F.lit("\n"))
    records = whole.unionByName(crossing).withColumn("record", F.when(F.col("crlf"), plain).otherwise(text))
    if header:
        records = records.where((F.col("split") > 0) | (F.col("place") > 0))
    named = records.join(F.broadcast(splits.select("file", "split", "path")), ["file", "split"])
    return named.where(F.col("record") != "").select("path", "split", "place", "record")


def first_records(records: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of ``csv_records``, files in order of their names; they come in this order.

    Records are counted per split, one row each; only those of the splits that hold the first ``n`` are numbered.
    """
    counted = records.groupBy("path", "split").agg(F.count("*").alias("rows"))
    before = Window.partitionBy(F.lit(0)).orderBy("path", "split").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0))).where(F.col("start") < n)
    inside = F.row_number().over(Window.partitionBy("path", "split").orderBy("place"))
    found = records.join(starts, ["path", "split"]).withColumn("number", F.col("start") + inside).where(F.col("number") <= n)
    return found.orderBy("number").select(records.columns)
