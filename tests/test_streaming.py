import os
import random

from pyspark.sql import functions as F

from leadloom.operators import leads, states
from leadloom.streaming import rescoring

SCHEMA = "ordinal bigint, url string, text string"
PIECES = ["newsletter", "live chat", "we give grief", "support to all", "", " ", "403-555", "0101", "+1 (587) 555-0199", "info@a.example", "funeral", "home", "x" * 40, "contact us"]


def arrived(spark, path, rows, slots=4):
    """Adds a file to the stream's folder and lets the stream take it in."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(f"{path}/in")
    rescoring.start(spark, spark.readStream.schema(SCHEMA).json(f"{path}/in"), f"{path}/site", f"{path}/check", slots).awaitTermination()


def rounded(rows):
    return sorted(repr(tuple(r)) for r in rows)


def test_batches_give_what_a_full_run_gives(spark, tmp_path):
    """In order, with new sites, late pages in between and before, and repeated runs of a batch."""
    own, seen, columns = random.Random(3), [], ["domain", "pages", "first_ordinal", "found", "raw_emails", "raw_phones", "n_community", "is_home", "evidence_chat", "executive_priority_score"]
    for number, ordinals in enumerate([range(0, 30), range(30, 50), [200, 201, 202, 33, 100], [5, -3]]):
        taken = {n for n, *_ in seen}
        rows = [(n if n not in taken else n + 1000, f"http://{own.choice('abcde')}.example/{n}", " ".join(own.choice(PIECES) for _ in range(own.randint(0, 3)))) for n in ordinals]
        seen += rows
        arrived(spark, tmp_path, rows)
        sites = {u.split("/")[2] for _, u, _ in rows}
        full = leads.leads(spark.createDataFrame(seen, SCHEMA)).where(F.col("domain").isin(list(sites)))
        got = spark.read.parquet(f"{tmp_path}/site/leads/batch={number}")
        assert rounded(got.select(columns).collect()) == rounded(full.select(columns).collect())
        assert rescoring.current(spark, f"{tmp_path}/site", number).count() == len({u.split("/")[2] for _, u, _ in seen})
    again = rescoring.updated(spark, spark.createDataFrame(rows, SCHEMA), 3, f"{tmp_path}/site", 4)
    plain = [c for c in columns[:-2] if c != "found"]
    assert rounded(states.finished(again).select(plain).collect()) == rounded(full.select(plain).collect())


def test_a_batch_reads_no_earlier_pages(spark, tmp_path):
    for number in range(4):
        arrived(spark, tmp_path, [(10 * number + i, f"http://{d}.example", "newsletter") for i, d in enumerate("abc")])
        for kind in ("pages", "arrived", "touched"):
            os.rename(f"{tmp_path}/site/{kind}/batch={number}", f"{tmp_path}/{kind}-{number}")
    got = spark.read.parquet(f"{tmp_path}/site/leads/batch=3")
    assert {tuple(r) for r in got.select("domain", "pages").collect()} == {(f"{d}.example", 4) for d in "abc"}
    states_left = {d for d, _, files in os.walk(f"{tmp_path}/site/states") if any(f.endswith(".parquet") for f in files)}
    assert len({d.split("batch=")[1].split("/")[0] for d in states_left}) <= 3  # older ones have gone
