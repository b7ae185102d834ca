"""Ranked lexical search: WAND over shards of documents, with integer scores.

Documents are indexed in shards: a shard has, for every term that a query asks for, the rows that hold
it with their counts, the number of terms of each row, and the rows' ids. The index is stored; document
frequencies and lengths are summed from it. Then each query goes through each shard with one cursor per
term. A term's bound is its weight times its highest impact in the shard. With the cursors in order of
row, the pivot is the first row where the bounds of all cursors up to it reach the least score that
still counts; rows before it cannot, and are skipped by moving those cursors on. A row where all
cursors up to the pivot stand is scored, and its query's heap, which raises that least score, is
carried from shard to shard within a task. The heaps of tasks are merged.

Queries go in blocks of bounded bytes, so that what a task knows of them is bounded: a large query set
makes more passes, not larger ones.

Defined results: null or empty texts, and texts without terms, are no documents and ask for nothing; a
query without terms has no rows. Rows that repeat an id are documents (queries) of their own; a null
document id comes after all others among equal scores, a null item id stays null. Equal scores go to
the smaller id, and then to any. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from heapq import heappush, heapreplace
from itertools import repeat
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, chunks, numbered, stored, whole_text

#: Terms are runs of ASCII letters and digits and of whatever is not ASCII; the others part them.
TERMS = bytes(LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Above all ids, for rows without one.
NO_ID = 1 << 63
INDEX = "n_docs bigint, n_terms bigint, ids binary, lengths binary, terms binary, begins binary, rows binary, counts binary"


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(TERMS).split()


def indexed(docs: DataFrame, vocabulary: dict[bytes, int], shard_bytes: int) -> DataFrame:
    """One row per shard of doc_id, text: the postings of the vocabulary's terms, by term and row."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of one block of queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for chunk in chunks(batches, "text", shard_bytes):
            lengths, keys, ids = [], [], []
            for doc_id, text in zip(chunk.column("doc_id").to_pylist(), (t for b in chunk.column("text").chunks for t in b.to_pylist()), strict=True):
                own = terms_of(text)
                if not own:
                    continue
                found = np.fromiter(map(known.get, own, repeat(-1)), np.int64, len(own))
                keys.append(found[found >= 0] << 32 | len(lengths))
                lengths.append(len(own))
                ids.append(doc_id)
            key, count = np.unique(np.concatenate([*keys, np.zeros(0, np.int64)]), return_counts=True)
            term, begins = np.unique(key >> 32, return_index=True)
            arrays = [np.array(lengths, np.int64), term.astype(np.int32), np.append(begins, len(key)).astype(np.int64), (key & 0xFFFFFFFF).astype(np.int32), count.astype(np.int32)]
            named = pa.array(ids, pa.int64())
            held = pa.BufferOutputStream()
            with pa.ipc.new_stream(held, pa.schema([("id", pa.int64())])) as out:
                out.write_batch(pa.RecordBatch.from_arrays([named], ["id"]))
            yield pa.RecordBatch.from_arrays([pa.array([len(lengths)], pa.int64()), pa.array([sum(lengths)], pa.int64()), pa.array([held.getvalue().to_pybytes()], pa.binary()), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)], [c.split()[0] for c in INDEX.split(", ")])

    return docs.mapInArrow(run, INDEX)


def frequencies(index: DataFrame) -> dict[int, int]:
    """How many documents hold each term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, begins in zip(batch.column("terms").to_pylist(), batch.column("begins").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, np.int32)), pa.array(np.diff(np.frombuffer(begins, np.int64)))], ["term", "df"])

    return {r["term"]: r["df"] for r in index.select("terms", "begins").mapInArrow(run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect()}


def impacts(counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term's weight is multiplied by, for each posting."""
    wide = 75 * int(lengths.max(initial=0)) * n_docs >= 1 << 63
    m = 25 + (np.array([75 * int(x) * n_docs // n_terms for x in lengths], np.int64) if wide else 75 * lengths * n_docs // n_terms)
    return 1_000_000_000 * counts // (1000 * counts + 8 * m)


def searched(terms: list[tuple[int, int, list[int], list[int]]], ids: list[int], heap: list[tuple[int, int]], k: int) -> int:
    """Brings the heap of (score, ~id) up to date with a shard; how many of its rows were scored.

    terms: of each term that the shard holds its highest impact, weight, rows with the shard's end after them, and impacts.
    """
    ends = len(ids)
    bound = [t[0] * t[1] for t in terms]
    weight, rows, gains = [t[1] for t in terms], [t[2] for t in terms], [t[3] for t in terms]
    at = [0] * len(terms)
    order = sorted((own[0], j) for j, own in enumerate(rows))
    least = heap[0][0] if len(heap) == k else 1
    done = 0
    while True:
        total, pivot = 0, ends
        for p, (row, j) in enumerate(order):
            total += bound[j]
            if total >= least:
                pivot = row
                break
        if pivot == ends:
            return done
        if order[0][0] < pivot:  # no row before the pivot can count
            for q in range(p):
                row, j = order[q]
                if row < pivot:
                    own = rows[j]
                    at[j] = i = bisect_left(own, pivot, at[j] + 1)
                    order[q] = (own[i], j)
            order.sort()
            continue
        score = q = 0
        for row, j in order:
            if row != pivot:
                break
            i = at[j]
            score += weight[j] * gains[j][i]
            at[j] = i = i + 1
            order[q] = (rows[j][i], j)
            q += 1
        order.sort()
        done += 1
        if score >= least:
            new = (score, ~ids[pivot])
            if len(heap) < k:
                heappush(heap, new)
            elif new > heap[0]:
                heapreplace(heap, new)
            if len(heap) == k:
                least = heap[0][0]


def ranked(index: DataFrame, items: list[tuple[int | None, Counter]], vocabulary: dict[bytes, int], k: int) -> DataFrame:
    """query, item_id, doc_id, score: each query's k best of every task."""
    spark = index.sparkSession
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    weights = spark.sparkContext.broadcast({t: floor(1000 * log((2 * n_docs + 2) / (2 * df + 1))) for t, df in frequencies(index).items()})
    asked = spark.sparkContext.broadcast([[(vocabulary[t], n) for t, n in own.items()] for _, own in items])
    names = spark.sparkContext.broadcast([i for i, _ in items])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list[tuple[int, int]]] = [[] for _ in asked.value]
        weight = weights.value
        for batch in batches:
            for shard in batch.to_pylist():
                lengths, terms, begins, rows, counts = (np.frombuffer(shard[c], t) for c, t in (("lengths", np.int64), ("terms", np.int32), ("begins", np.int64), ("rows", np.int32), ("counts", np.int32)))
                if not len(terms):
                    continue
                ids = [NO_ID if i is None else i for i in pa.ipc.open_stream(shard["ids"]).read_all().column("id").to_pylist()]
                gain = impacts(counts.astype(np.int64), lengths[rows], n_docs, n_terms)
                most = np.maximum.reduceat(gain, begins[:-1])
                place = {t: i for i, t in enumerate(terms.tolist())}
                lists: dict[int, tuple[int, list[int], list[int]]] = {}
                for heap, own in zip(heaps, asked.value, strict=True):
                    held = []
                    for t, n in own:
                        if (i := place.get(t)) is not None and weight[t] > 0:
                            if t not in lists:
                                b, e = begins[i], begins[i + 1]
                                lists[t] = int(most[i]), [*rows[b:e].tolist(), len(ids)], gain[b:e].tolist()
                            held.append((lists[t][0], n * weight[t], *lists[t][1:]))
                    if held:
                        searched(held, ids, heap, k)
        out = [(q, names.value[q], None if ~x == NO_ID else ~x, s) for q, heap in enumerate(heaps) for s, x in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], ["query", "item_id", "doc_id", "score"])

    return index.mapInArrow(run, "query bigint, item_id bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_bytes: int = 16 << 20, block_bytes: int = 4 << 20) -> DataFrame:
    """item_id, rank, doc_id, score: for each item its k best documents with a score above 0."""
    own = docs.select(docs[id_col].cast("bigint").alias("doc_id"), whole_text(text_col).alias("text"))
    queries = numbered(items.select(items[item_col].cast("bigint").alias("item_id"), whole_text(item_text_col).alias("text")), "query")
    blocks = max(1, -(-(queries.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) // block_bytes))
    merged = None
    for b in range(blocks):
        block = [(r["item_id"], Counter(terms_of(r["text"]))) for r in queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).collect()]
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, n in block for t in n}))}
        index = stored(indexed(own, vocabulary, shard_bytes), "index")
        heaps = ranked(index, block, vocabulary, k)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        merged = best if merged is None else merged.unionByName(best)
    return merged


def search_sql() -> str:
    """The same by scoring every document with every item."""
    fold = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({fold}, '{pattern}') AS w FROM documents),
t AS MATERIALIZED (SELECT r, doc_id, term, len(w) AS n, count(*) AS tf FROM (SELECT r, doc_id, w, unnest(w) AS term FROM d) GROUP BY r, doc_id, term, len(w)),
g AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(len(w)) AS BIGINT) AS ll FROM d WHERE len(w) > 0),
f AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, g GROUP BY term, nn),
q AS (SELECT q, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS q, item_id, regexp_extract_all({fold}, '{pattern}') AS w FROM benchmark)),
s AS (SELECT q, item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll)))) AS BIGINT) AS score FROM q JOIN t USING (term) JOIN f USING (term), g GROUP BY q, item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) <= 10"""
