"""Filter interaction audit: who is removed by which filter, in every order, and each filter's Shapley share.

A document fails some of five filters; with which ones is a mask of five bits. All that is asked is a
function of how many documents of a part have each mask, so only those 32 counts a part (of all, of good
and of toxic documents) leave the tables. Let x_i be the chance that filter i is applied. A part's
expected removals are a multilinear polynomial in x, the removal polynomial; its coefficients follow
from the mask counts. At the corners of the cube it tells what any set of filters removes, so what
every order keeps at each step; its partial derivative along the diagonal, integrated from 0 to 1, is
the filter's Shapley value, an exact rational whose 120-fold is the sum over all 120 orders.

Filters: A under 50 words; B words less than 65 percent distinct; C more than 5 percent capitals A-Z;
D holds one of # $ % & * |; E the same text as a row with a smaller id has. Words are runs of anything
but white space (space and control characters 9 to 13), case-sensitive.

Defined results: a null text counts as empty, a null source as the empty string. A null id is smaller
and larger than none, so that such rows never fail E nor make others fail it, and have no labels; rows
that repeat id and text fail E only by a smaller id. A document is good (toxic) if any label row of its
id says so. Without rows there is no part. Other columns are ignored. Texts count as the same by SHA-256.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
RESULT = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def failures(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """doc_id, part, mask of the filters A to D, digest of the text."""
    own = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), whole_text(text_col).alias("text"))
    words = own.withColumn("words", F.array_remove(F.split("text", r"[\x09-\x0D\x20]+"), ""))
    n = F.size("words")
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    tests = [n < 50, 100 * F.size(F.array_distinct("words")) < 65 * n, 100 * capitals > 5 * F.length("text"), F.col("text").rlike(r"[#$%&*|]")]
    mask = sum((t.cast("int") * (1 << i) for i, t in enumerate(tests)), F.lit(0))
    return words.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))


def told(column: Column) -> Column:
    return F.coalesce(F.max((column == 1).cast("int")), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """part, mask, n, n_good, n_toxic.

    Rows that repeat id and text are counted where they are read. A text's first id is a sum per
    digest, so copies never meet; rows meet first ids and labels by id, which tells rows apart.
    """
    rows = failures(docs, id_col, text_col, part_col)
    counted = rows.where("doc_id IS NOT NULL").groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = labels.select(labels[id_col].cast("bigint").alias("doc_id"), labels["quality"].alias("q"), labels["toxic"].alias("t")).where("doc_id IS NOT NULL").groupBy("doc_id").agg(told(F.col("q")).alias("good"), told(F.col("t")).alias("toxic"))
    later = F.when(F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    judged = counted.join(first, ["doc_id", "digest"], "left").withColumn("mask", F.col("mask") + later).join(known, "doc_id", "left")
    zero = F.lit(0)
    named = judged.select("part", "mask", "n", F.coalesce("good", zero).alias("good"), F.coalesce("toxic", zero).alias("toxic"))
    nameless = rows.where("doc_id IS NULL").select("part", "mask", F.lit(1).cast("bigint").alias("n"), zero.alias("good"), zero.alias("toxic"))
    return named.unionByName(nameless).groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("n_good"), F.sum(F.col("n") * F.col("toxic")).alias("n_toxic"))


def polynomial(counts: np.ndarray) -> np.ndarray:
    """Coefficients of a removal polynomial, by set of variables, from the counts by mask.

    A document with mask S is removed unless none of its filters is applied: 1 - prod over S of (1 - x_i),
    which has a coefficient of (-1) ** (|T| + 1) at every nonempty subset T of S.
    """
    out = np.zeros(SETS, object)
    for t in range(1, SETS):
        sign = 1 if t.bit_count() % 2 else -1
        out[t] = sign * sum(int(counts[s]) for s in range(SETS) if s & t == t)
    return out


def at_corner(coefficients: np.ndarray, applied: int) -> int:
    """What the set of filters removes: the polynomial where its variables are 1 and the others 0."""
    return sum(coefficients[t] for t in range(1, SETS) if t & ~applied == 0)


def shapley(coefficients: np.ndarray, i: int) -> Fraction:
    """The integral from 0 to 1 of the partial derivative by x_i at (t, ..., t)."""
    by_degree = [sum(coefficients[t] for t in range(SETS) if t >> i & 1 and t.bit_count() == d + 1) for d in range(len(FILTERS))]
    return sum((Fraction(c, d + 1) for d, c in enumerate(by_degree)), Fraction(0))


def audited(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """The rows of a part, in all orders; counts: 3 rows (all, good, toxic) by mask."""
    alls, good, toxic = (polynomial(c) for c in counts)
    total = sum(map(int, counts[0]))
    corner = [[at_corner(p, s) for s in range(SETS)] for p in (alls, good, toxic)]
    shares = [shapley(alls, i) * len(ORDERS) for i in range(len(FILTERS))]
    if any(x.denominator != 1 for x in shares):
        raise ArithmeticError("a sum over all orders is whole")
    for order in ORDERS:
        before = 0
        for step, letter in enumerate(order, 1):
            i = FILTERS.index(letter)
            now = before | 1 << i
            removed, good_lost, toxic_lost = (c[now] - c[before] for c in corner)
            yield part, order, step, total - corner[0][now], removed, corner[0][1 << i] - removed, corner[0][-1] - corner[0][(SETS - 1) & ~(1 << i)], good_lost, toxic_lost, int(shares[i])
            before = now


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step."""
    pick = lambda c: F.array(*[F.sum(F.when(F.col("mask") == s, F.col(c)).otherwise(0)) for s in range(SETS)]).alias(c)
    parts = mask_counts(docs, labels, id_col, text_col, part_col).groupBy("part").agg(pick("n"), pick("n_good"), pick("n_toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, *counts in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "n_good", "n_toxic")), strict=True):
                rows = list(audited(part, np.array(counts, object)))
                kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in RESULT.split(", ")])

    return parts.mapInArrow(run, RESULT)


def audit_sql() -> str:
    """The same by counting: every document through every order."""
    bit = lambda letter: 1 << FILTERS.index(letter)
    bits = "CASE {} " + " ".join(f"WHEN '{x}' THEN {bit(x)}" for x in FILTERS) + " END"
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') AS w FROM documents),
e AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, CASE WHEN len(w) < 50 THEN {bit("A")} ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN {bit("B")} ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(d.t, '[^A-Z]+', '', 'g')) > 5 * length(d.t) THEN {bit("C")} ELSE 0 END + CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN {bit("D")} ELSE 0 END
  + CASE WHEN doc_id > first THEN {bit("E")} ELSE 0 END AS mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM d JOIN e USING (t) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY part, mask),
s AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS s),
o AS (SELECT a.s || b.s || c.s || d.s || e.s AS filter_order FROM s a, s b, s c, s d, s e WHERE len(list_distinct([a.s, b.s, c.s, d.s, e.s])) = 5),
p AS (SELECT filter_order, step, {bits.format("filter_order[step]")} AS own, list_sum(list_transform(range(1, step), lambda i: {bits.format("filter_order[i]")})) AS prior FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, p.step, own, sum(CASE WHEN mask & (own | coalesce(prior, 0)::BIGINT) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN mask & own <> 0 AND mask & coalesce(prior, 0)::BIGINT = 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & own <> 0 AND mask & coalesce(prior, 0)::BIGINT <> 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & own <> 0 AND mask & coalesce(prior, 0)::BIGINT = 0 THEN g ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & own <> 0 AND mask & coalesce(prior, 0)::BIGINT = 0 THEN x ELSE 0 END) AS toxic_lost FROM c, p GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""
