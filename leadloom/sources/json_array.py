"""JSON arrays of objects, split by byte ranges.

Spark reads a file in ranges of bytes, here as pieces that end at a closing brace. Whether that brace is
one of the array's elements depends on all that stands before it, but all that matters of it is whether
a string is open and how deep the braces are. So each range is summed up once for either start: whether
its quotation marks leave a string open, how the depth changes, and how far below its start it goes.
The sums of the ranges before it give each range its start; a second pass cuts elements at their true
ends where they are read, and numbers them as the array does. Only an element that the end of a range
cuts is put together from its parts in a shuffle.

A backslash outside of strings is no JSON, and one before a brace is none either, so a pair of escape
and character never spans two pieces. Elements have to be objects.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: An escaped character, or a run of anything but quotation marks, escapes and braces.
_DULL = re.compile(r'\\.|[^"\\{}]+', re.DOTALL)
PARTS = "file string, range bigint, n bigint, closed boolean, text string"


def marks(piece: str) -> str:
    """The quotation marks and opening braces of a piece, escaped ones left out."""
    return _DULL.sub("", piece)


def step(found: str, inside: bool) -> tuple[bool, int]:
    """Whether a string is open after a piece with these marks, and how many braces opened outside of strings."""
    outer = found.split('"')
    return inside ^ (len(outer) % 2 == 0), sum(x.count("{") for x in outer[inside::2])


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, range (where the bytes begin), value: what ends at each closing brace, the brace left out, in order within a range."""
    return spark.read.text(path, lineSep="}").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), "value")


def by_range(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Runs of rows of one range: their file and range, and the rows' columns."""
    for batch in batches:
        files, ranges = batch.column("file").to_pylist(), batch.column("range").to_pylist()
        own = [batch.column(c).to_pylist() for c in columns]
        begin = 0
        for i in range(1, len(files) + 1):
            if i == len(files) or (files[i], ranges[i]) != (files[begin], ranges[begin]):
                yield files[begin], ranges[begin], *(c[begin:i] for c in own)
                begin = i


def summed(read: DataFrame) -> DataFrame:
    """Per range, for a start that is clear of strings and one where one is open: whether one is open after it, the change
    of depth, and how many elements end in it, by depth at its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[list]] = {}
        for file, at, values in by_range(batches, "value"):
            both = held.setdefault((file, at), [[False, 0, {}], [True, 0, {}]])
            for value in values:
                found = marks(value)
                for one in both:
                    one[0], opened = step(found, one[0])
                    one[1] += opened
                    if not one[0]:
                        one[1] -= 1
                        # A brace that comes to this depth ends an element if the range began so deep.
                        one[2][-one[1]] = one[2].get(-one[1], 0) + 1
        of = lambda one: {"after": one[0], "depth": one[1], "ends": sorted(one[2].items())}
        out = [(file, at, of(clear), of(open_)) for (file, at), (clear, open_) in held.items()]
        kind = pa.struct([("after", pa.bool_()), ("depth", pa.int64()), ("ends", pa.map_(pa.int64(), pa.int64()))])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.string(), pa.int64(), kind, kind))], ["file", "range", "clear", "open"])

    # The last piece of a file has no brace: taken for one, it comes below the depth of elements, and ends none.
    own = "struct<after:boolean,depth:bigint,ends:map<bigint,bigint>>"
    return read.mapInArrow(run, f"file string, range bigint, clear {own}, open {own}")


def starts(sums: DataFrame) -> DataFrame:
    """file, range, inside, depth, first: how each range begins, and the number of its first element; from the few
    numbers that sum a range up. A file begins outside of all; numbers go on from file to file of one array."""
    ordered = sums.repartition("array").sortWithinPartitions("array", "file", "range")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = file = None
        inside, depth, first = False, 0, 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["array"] != array:
                    array, file, first = row["array"], None, 0
                if row["file"] != file:
                    file, inside, depth = row["file"], False, 0
                out.append((file, row["range"], inside, depth, first))
                own = row["open" if inside else "clear"]
                inside, depth, first = own["after"], depth + own["depth"], first + dict(own["ends"]).get(depth, 0)
            kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["file", "range", "inside", "depth", "first"])

    return ordered.mapInArrow(run, "file string, range bigint, inside boolean, depth bigint, first bigint")


def cut(read: DataFrame, begun: DataFrame) -> DataFrame:
    """file, range, n, closed, text: the elements, and the parts of those that go on in the next range or come from the one before."""
    rows = read.join(F.broadcast(begun), ["file", "range"])  # a few numbers per range of a file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def rest() -> list[tuple]:
            return [(*now[:2], now[4], False, "}".join(now[5]) + "}")] if now and now[5] else []

        for file, at, values, inside, depth, first in by_range(batches, "value", "inside", "depth", "first"):
            if now is None or now[:2] != [file, at]:
                out += rest()
                now = [file, at, inside[0], depth[0], first[0], [], depth[0] > 0 or inside[0]]
            for value in values:
                now[2], opened = step(marks(value), now[2])
                now[3] += opened
                now[5].append(value)
                if not now[2]:
                    now[3] -= 1
                    if now[3] == 0:
                        out.append((file, at, now[4], not now[6], "}".join(now[5]) + "}"))
                        now[4:] = now[4] + 1, [], False
                if len(out) >= 1000:
                    yield batch_of(out)
                    out = []
        yield batch_of(out + rest())

    return rows.select("file", "range", "value", "inside", "depth", "first").mapInArrow(run, PARTS)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in PARTS.split(", ")])


def elements(spark: SparkSession, path: str, as_one: bool = False) -> DataFrame:
    """file, n, text: the array's objects as JSON text, and their places. as_one: the files of the folder are the parts
    of one array, in order of their names, as sinks.write_json_array leaves them."""
    read = pieces(spark, path)
    sums = summed(read).withColumn("array", F.lit("") if as_one else F.col("file"))
    parts = cut(read, starts(sums)).withColumn("array", F.lit("") if as_one else F.col("file"))
    whole = parts.where("closed").select(F.col("array").alias("file"), "n", "text")
    ordered = F.array_sort(F.collect_list(F.struct("file", "range", "text")))
    seams = parts.where("NOT closed").groupBy("array", "n").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text")).withColumnRenamed("array", "file")
    # Before an element stand the bracket, or a comma, and white space; after the last one there is none.
    return whole.unionByName(seams).withColumn("text", F.regexp_extract("text", r"(?s)^[^{]*(\{.*)$", 1)).where("text LIKE '{%'")


def read(spark: SparkSession, path: str, schema: str, as_one: bool = False) -> DataFrame:
    """ordinal (the place in the array), and the fields of the schema."""
    return elements(spark, path, as_one).select(F.col("n").alias("ordinal"), F.from_json("text", schema).alias("e")).select("ordinal", "e.*")
