"""SimHash near-duplicates by anchor points of a covering code.

A document's fingerprint has a bit where more than half of its shingles' 64-bit hashes have it. Equal
fingerprints are one class, so copies never meet each other. Classes link at THRESHOLD or fewer
differing bits, and are found by anchors: the words of a covering code, which lie so densely that every
fingerprint has one, its home, within the covering radius. A fingerprint within the threshold of
another is no farther from the other's home than radius plus threshold. So each fingerprint is
replicated to every anchor within that distance, and per anchor those at home there are compared
with all that came: no link can be missed.

The code is the direct sum of two binary Golay codes of length 23, which are perfect: every word of 23
bits has just one codeword within 3 bits. It looks at 46 of the 64 bits (the other 18 are free: a
code of one word), has 2 ** 24 anchors and a covering radius, of the bits looked at, of 6, at most 3 in
each half. A replica is kept only where what exceeds 3 in both halves adds up to the threshold at most,
about 302 anchors a fingerprint. Replicas go by range of anchors in packed blocks, 12 bytes each.

Per anchor a spanning forest of the links comes out, not all pairs: in large groups a fingerprint that
is in a component is compared only with those that are not in it. An anchor at which more than HOT
fingerprints are at home is dealt over salts: each has some of those and all that came.

Defined results: a null or empty text, or one without words, has fingerprint zero, which is linked like
any other; a text of fewer words than a shingle is one shingle; a null id counts after all others in a
component (null only where all are); rows that repeat an id or text are rows of their own. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, chunks, joined_by_count, stored, whole_text
from .components import labels

SEED = 42
THRESHOLD = 3
#: Length, covering radius and generator polynomial (x^11 + x^9 + x^7 + x^6 + x^5 + x + 1) of the Golay code.
LENGTH, RADIUS, GENERATOR = 23, 3, 0b101011100011
MASK = (1 << LENGTH) - 1
#: Hashes whose bits are counted at a time.
SLICE = 1 << 15
#: Homes of one anchor that go to one salt.
HOT = 1 << 16
#: Homes times members of an anchor below which all links are put out.
SMALL = 1 << 10
#: Bytes of replicas that a task is meant to get, and fingerprints that one is meant to replicate.
TASK_BYTES, TASK_ROWS = 24 << 20, 1 << 15
REPLICA = np.dtype([("anchor", "<i4"), ("code", "<u8")])


def fingerprint(text: str, words: int = 3) -> int:
    """The bits that more than half of the hashes of the text's shingles have."""
    own = text.encode().translate(LOWER).split()
    if not own:
        return 0
    plain = b" ".join(own)
    if len(own) <= words:
        return xxhash.xxh64_intdigest(plain, SEED)
    ends = np.cumsum([len(w) + 1 for w in own]) - 1
    begins = [0, *(ends[: len(own) - words] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(plain[b:e], SEED) for b, e in zip(begins, ends[words - 1 :].tolist(), strict=True)), np.uint64, len(begins))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLICE):
        ones += np.unpackbits(hashes[at : at + SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int, chunk_bytes: int) -> DataFrame:
    """doc_id, code (the fingerprint as a signed integer) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", chunk_bytes):
            codes = np.array([fingerprint(t, words) for b in chunk.column("text").chunks for t in b.to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id").combine_chunks(), pa.array(codes.view(np.int64))], ["doc_id", "code"])

    return docs.mapInArrow(run, "doc_id bigint, code bigint")


def residue(values: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit polynomials by the generator: equal for words that differ by a codeword."""
    left = values.astype(np.int64)
    for bit in range(LENGTH - 1, 10, -1):
        left = np.where(left >> bit & 1, left ^ GENERATOR << bit - 11, left)
    return left


@cache
def errors() -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The residue of every 23-bit word; and of the words of weight up to radius and of each weight beyond, up to
    the threshold, those of a residue: where they begin, and they themselves."""
    words = np.arange(1 << LENGTH, dtype=np.int32)
    low = np.concatenate([residue(np.arange(1 << 11)), residue(np.arange(1 << 12) << 11)])
    of = (low[: 1 << 11][words & 2047] ^ low[1 << 11 :][words >> 11]).astype(np.int16)
    weight = np.bitwise_count(words)
    begins, patterns = [], []
    for beyond in range(THRESHOLD + 1):
        own = words[weight <= RADIUS] if not beyond else words[weight == RADIUS + beyond]
        own = own[np.argsort(of[own], kind="stable")]
        begins.append(np.searchsorted(of[own], np.arange((1 << 11) + 1)))
        patterns.append(own)
    return of, begins, patterns


def replicas(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Anchors and whose they are (places in codes): first every code's home, then those beyond.

    An anchor is named by the upper 12 bits of both codewords, which tell them apart.
    """
    of, begins, patterns = errors()
    halves = [(codes >> np.uint64(s) & np.uint64(MASK)).astype(np.int32) for s in (0, LENGTH)]
    left, right = (of[h] for h in halves)
    for i in range(THRESHOLD + 1):
        for j in range(THRESHOLD + 1 - i):
            n, m = begins[i][left + 1] - begins[i][left], begins[j][right + 1] - begins[j][right]
            each = n * m
            whose = np.repeat(np.arange(len(codes)), each)
            place = np.arange(len(whose)) - np.repeat(np.cumsum(each) - each, each)
            a = halves[0][whose] ^ patterns[i][begins[i][left][whose] + place // m[whose]]
            b = halves[1][whose] ^ patterns[j][begins[j][right][whose] + place % m[whose]]
            yield (a >> 11) << 12 | b >> 11, whose, i + j == 0


def home(codes: np.ndarray) -> np.ndarray:
    anchor, _, _ = next(replicas(codes))
    return anchor


def hot_anchors(classes: DataFrame, most: int) -> dict[int, int]:
    """How many salts an anchor has at which more than most are at home: of n fingerprints, n / most anchors at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                anchor, n = np.unique(home(batch.column("code").to_numpy().view(np.uint64)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int32()), pa.array(n, pa.int64())], ["anchor", "n"])

    counts = classes.select("code").mapInArrow(run, "anchor int, n bigint").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    return {r["anchor"]: -(-r["n"] // most) for r in counts.collect()}


def dealt(classes: DataFrame, parts: int, hot: dict[int, int], rows: int = 1 << 13) -> DataFrame:
    """part, held: replicas by anchor, packed; the sign of an anchor's name tells those at home from those that come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array(sorted(hot), np.int32)
        for batch in batches:
            all_codes = batch.column("code").to_numpy().view(np.uint64)
            for at in range(0, len(all_codes), rows):
                codes = all_codes[at : at + rows]
                packed, part = [], []
                for anchor, whose, own in replicas(codes):
                    salt = np.zeros(len(anchor), np.int64)
                    if len(known):
                        salts = np.where(np.isin(anchor, known), [hot.get(a, 1) for a in anchor.tolist()], 1)
                        mine = (codes[whose] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % salts
                        again = np.repeat(np.arange(len(anchor)), salts)
                        salt = np.arange(len(again)) - np.repeat(np.cumsum(salts) - salts, salts)
                        anchor, whose = anchor[again], whose[again]
                        come = salt != mine[again] if own else np.ones(len(again), bool)
                    else:
                        come = np.full(len(anchor), not own)
                    one = np.empty(len(anchor), REPLICA)
                    one["anchor"], one["code"] = np.where(come, ~anchor, anchor), codes[whose]
                    packed.append(one)
                    part.append((anchor * np.int64(0x2545F491) + salt * 7919 >> 5) % parts)
                held, to = np.concatenate(packed), np.concatenate(part)
                order = np.argsort(to, kind="stable")
                held, to = held[order], to[order]
                cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]])) if len(to) else np.zeros(1, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(to[cuts[:-1]], pa.int32()), pa.array([held[b:e].tobytes() for b, e in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["part", "held"])

    return classes.select("code").mapInArrow(run, "part int, held binary")


def forest(own: np.ndarray, came: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join what the links of own, among each other and with came, join. A code that is found is compared
    with those not found yet, so that a dense group takes steps in proportion to its size."""
    sides = [own, np.setdiff1d(came, own, assume_unique=True)]
    while len(sides[0]):
        front, sides[0] = [(sides[0][0], True)], sides[0][1:]
        while front:
            x, at_home = front.pop()
            for k in (0, 1) if at_home else (0,):
                near = np.bitwise_count(sides[k] ^ x) <= THRESHOLD
                if near.any():
                    found, sides[k] = sides[k][near], sides[k][~near]
                    yield np.full(len(found), x), found
                    front += [(y, k == 0) for y in found]


def compared(replica: np.ndarray, small: int = SMALL) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The links of a part's anchors, whole where a group is small and a forest of them otherwise."""
    anchor = np.where(replica["anchor"] < 0, ~replica["anchor"], replica["anchor"])
    order = np.lexsort((replica["code"], anchor))
    anchor, code, own = anchor[order], replica["code"][order], replica["anchor"][order] >= 0
    begins = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    size = np.diff(np.append(begins, len(anchor)))
    homes = np.add.reduceat(own.astype(np.int64), begins)
    for g in np.flatnonzero((homes * size > small) & (homes > 0)):
        b, e = begins[g], begins[g] + size[g]
        yield from forest(np.unique(code[b:e][own[b:e]]), np.unique(code[b:e]))
    few = homes * size <= small
    group = np.repeat(np.arange(len(begins)), size)
    mine = np.flatnonzero(own & few[group])
    for at in range(0, len(mine), 1 << 12):
        some = mine[at : at + (1 << 12)]
        n = size[group[some]]
        a = np.repeat(some, n)
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + begins[group[a]]
        near = (np.bitwise_count(code[a] ^ code[b]) <= THRESHOLD) & (code[a] != code[b])
        yield code[a[near]], code[b[near]]


def links(replica: DataFrame, parts: int) -> DataFrame:
    """a, b: links between codes, enough to join what all of them join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("held"), strict=True):
                held.setdefault(part, []).append(np.frombuffer(blob.as_buffer(), REPLICA).copy())
        for part in list(held):
            for a, b in compared(np.concatenate(held.pop(part))):
                a, b = a.view(np.int64), b.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return replica.repartitionById(parts, "part").mapInArrow(run, "a bigint, b bigint").distinct()


def near_simhash(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, task_bytes: int = TASK_BYTES, chunk_bytes: int = 8 << 20) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (the smallest id that links lead to)."""
    own = docs.select(docs[id_col].cast("bigint").alias("doc_id"), whole_text(text_col).alias("text"))
    rows = stored(fingerprints(own, words, chunk_bytes), "fingerprints")
    classes = stored(rows.groupBy("code").agg(F.min("doc_id").alias("lowest"), F.count("*").alias("n")), "codes")
    n, total = classes.agg(F.count("*"), F.sum("n")).first()
    parts = max(1, -(-n * 302 * REPLICA.itemsize // task_bytes))
    spread = classes.select("code").repartition(max(1, -(-n // TASK_ROWS)), "code")
    found = labels(links(dealt(spread, parts, hot_anchors(classes, hot)), parts))
    joined = classes.join(found.select(F.col("node").alias("code"), "label"), "code", "left").withColumn("label", F.coalesce("label", "code"))
    least = joined.groupBy("label").agg(F.min("lowest").alias("component_id"))
    named = stored(joined.join(least, "label").select("code", "n", "component_id"), "components")
    return joined_by_count(rows, named, ["code"], "n", total or 0).select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
