"""The pipeline's stages on a small corpus with known junk, copies, repeats and personal data."""

import random

import corpus_pipeline
from leadloom.llm.common import stored

random.seed(3)
WORDS = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 7))) for _ in range(400)]


def prose(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


def test_stages(spark, tmp_path):
    passage, original = prose(90), prose(300)
    good = [(i, prose(150)) for i in range(60)]
    junk = [(100 + i, " ".join(w + "$$$" for w in prose(150).split())) for i in range(30)]
    near = [(200 + i, " ".join([*original.split()[:-1], f"end{i}"])) for i in range(8)]
    repeats = [(300 + i, f"{prose(80)} {passage} {prose(80)}") for i in range(5)]
    private = [(400, prose(100) + " write to some.one@mail.example.org or 10.1.2.3 " + prose(20))]
    rows = good + junk + near + repeats + private
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in junk[:20]], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), name)
        held[name] = docs.collect()
    ids = {n: {r["doc_id"] for r in held[n]} for n in held}
    assert ids["quality"] == {i for i, _ in good + near + repeats + private}
    assert ids["near"] == ids["quality"] - {i for i, _ in near[1:]}
    cut = {r["doc_id"]: r["text"] for r in held["repeats"]}
    assert all(passage not in cut[i] for i, _ in repeats) and all(cut[i] == t for i, t in good)
    masked = {r["doc_id"]: r["text"] for r in held["private"]}[400]
    assert "[email]" in masked and "[ip]" in masked and "@" not in masked
    assert ids["pack"] == ids["near"] and all(r["length"] > 0 for r in held["pack"])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in whole.select("doc_id").collect()} == ids["pack"]


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, k string, spans string, _text int, sig string, n double"


def odd_rows(texts):
    """Rows with null and repeated ids, and columns whose names clash with the operators' own."""
    return [(i, t, "en", None, None if t is None else len(t), 5, "k", "s", 1, "g", 0.5) for i, t in texts]


def test_stages_on_odd_rows(spark, tmp_path):
    """Null, empty, repeated and long texts, null and repeated ids, through every stage and through all."""
    long_, twice, other = prose(4000), prose(120), prose(130)
    texts = [(1, None), (1, ""), (2, " \n "), (3, "few words"), (None, None), (None, ""), (None, twice), (None, twice), (4, twice), (4, twice), (5, other), (5, prose(90)), (6, long_), (None, prose(70))]
    texts += [(10 + i, prose(100)) for i in range(12)]
    docs = spark.createDataFrame(odd_rows(texts), ODD).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(10 + i, 1, None) for i in range(12)] + [(5, 0, 1), (None, 1, 0), (99, None, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        if name == "pack":
            tokens = got.groupBy("doc_id").sum("length").collect()
            assert {r["doc_id"] for r in tokens} == {i for i, _ in texts}
            continue
        rows = got.collect()
        assert got.columns == docs.columns and got.dtypes == docs.dtypes, name
        assert all((r["row"], r["k"], r["spans"], r["sig"], r["n"]) == (5, "k", "s", "g", 0.5) for r in rows)
        if name == "near":
            assert sum(r["text"] == twice for r in rows) == 1 and sum(r["text"] in (None, "", " \n ") for r in rows) == 5
            assert len(rows) == len(texts) - 3 and {r["text"] for r in rows} == {t for _, t in texts}
        elif name == "quality":
            assert all(r["text"] and len(r["text"].split()) >= 50 for r in rows)
        else:
            assert len(rows) == len(texts) and sum(not (r["text"] or "").strip() for r in rows) >= 5, name
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = stored(stage(spark, held, str(tmp_path)), name)
        assert held.columns == docs.columns
    left = held.collect()
    assert sum((r["text"] or "") == twice for r in left) == 1 and any(r["text"] == long_ for r in left)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in left}
    assert all(r["offset"] + r["length"] <= 1024 for r in pieces)


def test_stages_without_rows(spark, tmp_path):
    docs = spark.createDataFrame([], ODD)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        assert got.count() == 0 and (name == "pack" or got.columns == docs.columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
