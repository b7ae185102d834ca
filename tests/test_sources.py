"""Arrays read by ranges of bytes, and written in parts, against Python's own JSON."""

import json
import os
import random

import pytest

from leadloom.operators import sinks
from leadloom.sources import json_array
from leadloom.sources import pages as sources

PIECES = ["{", "}", "[", "]", '"', "\\", "\\\\", "{}", '"}', "\n", ",", "é", " ", "plain", " ", "x" * 300, '{"url":1}', "\\u007d"]


def made(seed, n):
    own = random.Random(seed)
    text = lambda: "".join(own.choice(PIECES) for _ in range(own.randint(0, 12)))
    return [{"url": text(), "markdown": text(), "more": {"a": [text(), {"b": text()}], "{": None}} | ({} if own.random() < 0.8 else {"large": "y{" * 4000}) for _ in range(n)]


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("indent", [None, 4])
def test_array_in_ranges(spark, small_ranges, tmp_path, indent):
    rows = made(indent, 120)
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=False))
    path = str(tmp_path / "a.json")
    assert json_array.pieces(spark, path).rdd.getNumPartitions() > 15
    got = [json.loads(r["text"]) for r in json_array.elements(spark, path).orderBy("n").collect()]
    assert got == rows
    pages = [tuple(r) for r in sources.json_array(spark, path).orderBy("ordinal").collect()]
    assert pages == [(i, r["url"], r["markdown"]) for i, r in enumerate(rows)]


def test_no_task_reads_all_of_an_array(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"url": f"http://s.example/{i}", "markdown": "x" * 200} for i in range(20_000)]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(os.path.getsize(tmp_path / "a.json") // 4 + 1))
    try:
        read = json_array.pieces(spark, str(tmp_path / "a.json"))
        counts = read.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(counts) >= 4 and max(counts) < 0.4 * sum(counts)


def test_odd_arrays(spark, tmp_path):
    for n, text in enumerate(["[]", "", " [ ] \n", '[{"url":"u"}]', '[{}]', '[{"markdown":null} , {"url":"}"}]\n']):
        (tmp_path / f"{n}.json").write_text(text)
        want = [(i, r.get("url") or "", r.get("markdown") or "") for i, r in enumerate(json.loads(text or "[]"))]
        assert [tuple(r) for r in sources.json_array(spark, str(tmp_path / f"{n}.json")).orderBy("ordinal").collect()] == want
    both = sources.json_array(spark, str(tmp_path))
    assert both.count() == 4 and both.where("ordinal = 0").count() == 3


def test_array_sink(spark, small_ranges, tmp_path):
    rows = made(9, 80)
    frame = spark.createDataFrame([(i + 1, r["url"], r["markdown"], None) for i, r in enumerate(rows)], "outreach_rank int, url string, markdown string, none int").repartition(7)
    sinks.write_json_array(frame, f"{tmp_path}/out")
    files = sorted(f for f in os.listdir(f"{tmp_path}/out") if f[0] not in "._")
    whole = json.loads("".join(open(f"{tmp_path}/out/{f}", encoding="utf-8").read() for f in files))
    assert whole == [{"outreach_rank": i + 1, "url": r["url"], "markdown": r["markdown"], "none": None} for i, r in enumerate(rows)]
    back = sources.results(spark, f"{tmp_path}/out", "outreach_rank int, url string")
    assert [tuple(r) for r in back.orderBy("ordinal").collect()] == [(i, i + 1, r["url"]) for i, r in enumerate(rows)]
    assert [tuple(r) for r in sources.json_array(spark, f"{tmp_path}/out", True).orderBy("ordinal").collect()] == [(i, r["url"], r["markdown"]) for i, r in enumerate(rows)]
    sinks.write_json_array(frame.limit(0), f"{tmp_path}/none")
    assert sources.results(spark, f"{tmp_path}/none", "url string").count() == 0
