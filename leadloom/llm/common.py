"""What several operators share: reading, shared storage, Arrow batches."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper to lower case for A-Z alone, as the contracts have it.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Spark's setting by which the shuffle files of an execution go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bits that tell rows apart before an exact join, 2 MB.
MARKS = 1 << 24


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The column as text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset, a local master gets a
    temporary one, since all is on one machine there; a cluster gets an error, as rows would be lost."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), f"leadloom-{os.getpid()}")
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: a cut of the lineage that survives lost executors.

    Nothing reads the shuffle files of that write again, so they go when it ends.
    """
    conf, path = df.sparkSession.conf, f"{shared_dir(df.sparkSession)}/leadloom/{name}-{uuid.uuid4().hex}"
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame | None) -> None:
    """Deletes the stored tables that these read, and nothing else; no result that is still to be computed may read them."""
    for df in tables:
        if df is None:
            continue
        context = df.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if re.search(r"/leadloom/[a-z]+-[0-9a-f]{32}$", folder):
                path = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(folder))
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df, stored, with a number of its own for each row. As it is stored with the rows, it stays when tasks are run again."""
    return stored(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def without(rows: DataFrame, gone: DataFrame, key: str, marks: int = MARKS) -> DataFrame:
    """The rows whose key, a bigint, is not in the table gone (that column alone).

    Every key of gone sets one of so many bits by its hash; the bits are broadcast, marks / 64 integers at most. Rows
    whose bit is unset stay where they are read, and the others alone go through the join that decides.
    """
    slot = f"pmod(xxhash64(`{key}`), {marks}L)"
    words = gone.selectExpr(f"{slot} DIV 64 AS _leadloom_word", f"shiftleft(1L, CAST({slot} % 64 AS INT)) AS bit").groupBy("_leadloom_word").agg(F.bit_or("bit").alias("_leadloom_bits"))
    marked = rows.join(F.broadcast(words), F.expr(f"{slot} DIV 64 = _leadloom_word"), "left")
    found = F.expr(f"coalesce(shiftright(_leadloom_bits, CAST({slot} % 64 AS INT)) & 1L, 0L) = 1")
    asked = marked.where(found).drop("_leadloom_word", "_leadloom_bits")
    return marked.where(~found).drop("_leadloom_word", "_leadloom_bits").union(asked.join(gone.toDF("_leadloom_gone"), F.expr(f"`{key}` = _leadloom_gone"), "left_anti"))


def joined_by_count(rows: DataFrame, counts: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """The inner join of two stored tables by keys, where counts.n of the total rows have a key.

    Keys with over a thousandth of all rows, so a thousand at most, meet their rows where these are read.
    """
    hot = F.broadcast(counts.where(F.col(n) * 1000 > total))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(counts.where(F.col(n) * 1000 <= total), keys)
    return rows.join(hot, keys).unionByName(rest)


def blocks_for(df: DataFrame, text: str, bytes_each: int) -> int:
    """How many blocks of about bytes_each bytes hold the texts of df; one pass over lengths."""
    total = df.select(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return max(1, -(-total // bytes_each))


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """The rows in tables of about limit bytes of the text column: small batches gathered, large ones cut."""
    held: list[pa.RecordBatch] = []
    room = limit
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at, done = 0, 0
        while at < len(sizes):
            # the rows up to the one that fills the table, one at least
            end = min(len(sizes), int(np.searchsorted(sizes, done + room)) + 1)
            held.append(batch.slice(at, end - at))
            room -= int(sizes[end - 1]) - done
            at, done = end, int(sizes[end - 1])
            if room <= 0:
                yield pa.Table.from_batches(held)
                held, room = [], limit
    if held:
        yield pa.Table.from_batches(held)
