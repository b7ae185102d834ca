"""What operators leave on disk: results alone, no shuffle files and no tables on the way."""

import os
import random

import pytest
from pyspark.sql import functions as F

from leadloom.llm import jaccard, substrings
from leadloom.llm.common import discard, shared_dir, stored, without

random.seed(5)


def prose(n):
    return " ".join(random.choice("abcdefgh") * random.randint(1, 9) for _ in range(n))


def tables(spark):
    folder = f"{shared_dir(spark)}/leadloom"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def shuffled(spark):
    """The shuffle files of this process; rows that a task keeps in memory are in files too."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if os.path.basename(f).startswith("shuffle_")}


def test_stored_leaves_no_shuffle_files(spark):
    before = shuffled(spark)
    found = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert not shuffled(spark) - before
    assert sorted(r["count"] for r in found.collect()) == [142] * 1 + [143] * 6 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_discard_deletes_what_was_stored_alone(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/leadloom/given")
    given, before = spark.read.parquet(f"{tmp_path}/leadloom/given"), tables(spark)
    one, two = stored(given, "one"), stored(given, "two")
    discard(one.union(given), None)
    assert {t.partition("-")[0] for t in tables(spark) - before} == {"two"}
    assert given.count() == two.count() == 3


@pytest.mark.parametrize(("run", "left"), [(jaccard.join_near, {"components"}), (jaccard.keep_one, {"numbered", "kept"}), (substrings.dedup, {"numbered", "spans"}), (substrings.dedup_report, {"numbered", "spans"})])
def test_operators_leave_what_their_result_reads(spark, run, left):
    """Copies, near copies in a chain, large groups and repeats, so that every kind of table is made."""
    first, passage = prose(200).split(), prose(120)
    near = [" ".join([*first[i:], *(f"w{j}" for j in range(i))]) for i in range(30)]
    texts = [*near, *near[:5], *(f"{prose(40)} {passage} {prose(40)}" for _ in range(5)), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    before = tables(spark)
    found = run(docs)
    assert {t.partition("-")[0] for t in tables(spark) - before} == left
    assert found.count() == (len(texts) if run is not jaccard.keep_one else 8)


def test_keep_one_shuffles_texts_of_copies_alone(spark):
    """Also where the table of what stays is too large to be broadcast."""
    texts = [" ".join(f"{random.getrandbits(60):x}" for _ in range(1500)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate([*texts, *texts[:3]])), "doc_id bigint, text string").repartition(3)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found, before = jaccard.keep_one(docs), shuffled(spark)
        ids = sorted(r["doc_id"] for r in found.select("doc_id", "text").collect())
        moved = sum(os.path.getsize(f) for f in shuffled(spark) - before)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert ids == list(range(60))
    assert moved < sum(map(len, texts)) / 4


@pytest.mark.parametrize("marks", [64, 128, 1 << 24])
def test_without_is_exact_however_few_the_bits(spark, marks):
    rows = spark.createDataFrame([(None if i % 4 else f"t{i}", i << 33, i) for i in [*range(-100, 300), 7, 7]], "`te.xt` string, row bigint, bits int")
    gone = spark.createDataFrame([(i << 33,) for i in range(0, 400, 7)], "row bigint")
    left = without(rows, gone, "row", marks)
    assert left.columns == rows.columns
    assert sorted(r["bits"] for r in left.collect()) == [i for i in range(-100, 300) if i < 0 or i % 7]
    assert without(rows, gone.limit(0), "row", marks).count() == 402
