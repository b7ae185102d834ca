"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

Vectors are quantised to integers and seen as sparse rows of (dimension, weight). Candidates are
dealt out in blocks; a block's inverted index holds, per dimension, the postings of its vectors.
Each query goes to every block and scatters weighted postings into a dense score array; the
block's best are picked by partition selection, and the blocks' picks are merged per query. The
queries are a stated set, also dealt in blocks, so a task holds one block of each side.

Defined results: a vector that is null, or that holds a null or non-finite component, takes no
part; an empty vector scores 0 with everything; vectors of unlike lengths meet in the dimensions
they share; rows without an id take no part; rows that repeat an id are queries and candidates of
their own, told apart by a number, so a query meets every row but itself and each such row has its
ranks; equal scores go to the smaller id, and then to any; a score beyond 64 bits is held at the
limit. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered

LIMIT = 2**63 - 1


def usable(vectors: DataFrame, asked: Column, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v, and whether it is a query, of the rows that take part."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        vectors.select(vectors[id_col].cast("bigint").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    )


def postings(table: pa.Table, scale: int) -> tuple[np.ndarray, ...]:
    """Row, dimension and weight of the entries other than zero, by dimension; the ids; and the rows' numbers."""
    column = table.column("v").combine_chunks()
    counts = np.diff(column.offsets.to_numpy())
    weight = np.floor(column.flatten().to_numpy(zero_copy_only=False) * scale)
    row = np.repeat(np.arange(len(counts)), counts)
    dim = np.arange(len(weight)) - np.repeat(np.cumsum(counts) - counts, counts)
    some = np.flatnonzero(weight)
    some = some[np.argsort(dim[some], kind="stable")]
    return row[some], dim[some], weight[some], table.column("vec_id").to_numpy(), table.column("row").to_numpy()


def best_of_block(queries: pa.Table, block: pa.Table, k: int, scale: int) -> pa.Table:
    """The k best of the block for each query."""
    q_row, q_dim, q_weight, q_ids, q_rows = postings(queries, scale)
    row, dim, weight, ids, rows = postings(block, scale)
    exact = max(np.abs(q_weight).max(initial=0.0), 1) * max(np.abs(weight).max(initial=0.0), 1) * max(len(np.unique(dim)), 1) < 2.0**62
    kind = np.int64 if exact else object  # Python's integers where 64 bits may not do
    whole = (lambda x: x.astype(np.int64)) if exact else (lambda x: np.array([int(v) for v in x], object))
    q_weight, weight = whole(q_weight), whole(weight)
    dims, begins = np.unique(dim, return_index=True)
    ends = np.append(begins[1:], len(dim))
    where = {d: (b, e) for d, b, e in zip(dims.tolist(), begins.tolist(), ends.tolist(), strict=True)}
    own = np.argsort(q_row, kind="stable")
    cuts = np.searchsorted(q_row[own], np.arange(len(q_ids) + 1))
    out_r, out_q, out_v, out_s = [], [], [], []
    for q in range(len(q_ids)):
        scores = np.zeros(len(ids), kind)
        for term in own[cuts[q] : cuts[q + 1]]:
            if (span := where.get(int(q_dim[term]))) is not None:
                scores[row[span[0] : span[1]]] += weight[span[0] : span[1]] * q_weight[term]
        others = np.flatnonzero(rows != q_rows[q])
        if not len(others):
            continue
        if not exact:
            scores = np.array([min(max(int(s), -LIMIT - 1), LIMIT) for s in scores], np.int64)
        if len(others) > k:
            least = np.partition(scores[others], len(others) - k)[len(others) - k]
            others = others[scores[others] >= least]
        others = others[np.lexsort((ids[others], ~scores[others]))][:k]
        out_r += [q_rows[q]] * len(others)
        out_q += [q_ids[q]] * len(others)
        out_v += ids[others].tolist()
        out_s += scores[others].tolist()
    return pa.table({"query_row": pa.array(out_r, pa.int64()), "query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.int64())})


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 4096, query_bytes: int = 32 << 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that queries tells, its k best among all others.

    A task holds block_rows candidates and queries of about query_bytes; candidates go to as many groups as queries
    fill, so the larger a group may be, the fewer copies of the candidates are sent out.
    """
    all_rows = numbered(usable(vectors, queries, id_col, vector_col), "row")
    asked = all_rows.where("asked")
    n, size = all_rows.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("asked"), 16 + 8 * F.size("v"))), F.lit(0))).first()
    blocks, groups = max(1, -(-n // block_rows)), max(1, -(-size // query_bytes))
    deal = lambda df, n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    units = lambda n: F.explode(F.array_repeat(F.lit(0), n)) if n == 1 else F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = all_rows.withColumn("block", deal(all_rows, blocks)).withColumn("group", units(groups))
    spread = asked.withColumn("group", deal(asked, groups)).withColumn("block", units(blocks))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_row", "query_id", "vec_id", "score")})
        return best_of_block(left, right, k, scale)

    found = spread.groupBy("block", "group").cogroup(candidates.groupBy("block", "group")).applyInArrow(meet, "query_row bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exhaustive(rows: list[tuple[int, list[float] | None]], asked: list[int], k: int, scale: int = 256) -> Iterator[tuple[int, int, int, int]]:
    """Brute force over a small list, for tests."""
    import math

    fine = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for n, (q, own) in enumerate(fine):
        if q in asked:
            scored = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), i) for m, (i, v) in enumerate(fine) if m != n)
            for rank, (score, i) in enumerate(scored[:k], 1):
                yield q, rank, i, -score
