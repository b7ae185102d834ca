"""Removal of repeated byte strings by suffix arrays.

A byte goes if a string of `length` bytes over it also starts anywhere else. Suffixes that can
matter are found first, without loss: every window of `length` bytes names its least hashed
`GRAM`-byte string, its anchor, by content alone, so equal windows have equal anchors, and a window
whose anchor is found once is no repeat. A run of windows that name one anchor is a context. All
contexts of an anchor that is found twice go to a shard by it; of contexts whose digests are alike
two are enough to tell what repeats, and the others take over what is found for those. The shard
compares the bytes of such two: alike, they would lie side by side in the array with all of their
windows shared, so one of them stands there for both. It builds a suffix array: keys of seven bytes, refined as by Larsson and Sadakane (only groups that are
not yet told apart are sorted again, at twice the depth), with common prefixes by Kasai's method, run
over all contexts in step. Anchors with many contexts are dealt over several shards, and these are
merged: each shard names one window of every class, and binary search finds it among the others'.

Defined results: a null or empty text has no bytes; rows are told apart by a number of their own, so
rows that repeat an id and text are two documents, each the other's copy; null ids are ids like
others; texts shorter than `length` stay whole; other columns are ignored by dedup_report() and kept
by dedup(). Hashes of 128 bits (an anchor's and a context's) stand for contexts, and for merged windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, joined_by_count, numbered, stored, whole_text

GRAM = 32
#: Contexts of an anchor in a shard; an anchor with more is dealt over several.
SHARD = 512
#: Windows of a bucket in which shards are merged, about.
BUCKET = 1 << 15
ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
PLACE = np.uint64((1 << 24) - 1)
#: Bytes whose anchors are looked for at a time; places within have 24 bits.
SLICE = 1 << 19


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position, by doubling."""
    h = data.astype(np.uint64) + np.uint64(1)
    width = 1
    for odd in ODD:
        h = h[: len(h) - width] * odd + h[width:]
        h ^= h >> np.uint64(32)
        width *= 2
    return (h ^ h >> np.uint64(29)) * ODD[1]


def least_in(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width entries in a row."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :])


def contexts(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """The runs of windows with one anchor: text, first and last window start, place and hash of the anchor."""
    out: list[tuple[np.ndarray, ...]] = []
    cuts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    for low in range(0, max(1, len(data)), SLICE):
        part = data[low : low + SLICE + length]  # it may read on past its end
        if len(part) < length:
            continue
        h = gram_hashes(part)
        key = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
        at = (least_in(key, length - GRAM + 1) & PLACE).astype(np.int64)[:SLICE]
        start = low + np.arange(len(at))
        text = np.searchsorted(cuts, start, "right") - 1
        good = start + length <= cuts[text + 1]
        start, text, at = start[good], text[good], at[good]
        if not len(start):
            continue
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1)]))
        last = np.append(new[1:], len(start)) - 1
        out.append((text[new], start[new] - cuts[text[new]], start[last] - cuts[text[new]], at[new] + low - start[new], h[at[new]]))
    return tuple(np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.uint64 if i == 4 else np.int64) for i in range(5))


def anchors(docs: DataFrame, length: int, chunk_bytes: int) -> DataFrame:
    """h, c, rid, first, last: every context, with the hash of its anchor and of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", chunk_bytes):
            texts = [t.encode() for b in chunk.column("text").chunks for t in b.to_pylist()]
            rid = chunk.column("rid").to_numpy()
            text, first, last, place, h = contexts(texts, length)
            digest = xxhash.xxh3_64_intdigest
            # The anchor's place in the context is hashed with it.
            c = np.fromiter((digest(texts[t][a : b + length], p) for t, a, b, p in zip(text.tolist(), first.tolist(), last.tolist(), place.tolist(), strict=True)), np.uint64, len(text))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(rid[text]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["h", "c", "rid", "first", "last"])

    return docs.select("rid", "text").mapInArrow(run, "h bigint, c bigint, rid bigint, first int, last int")


def refined(data: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array and each position's group, to a depth of bytes; ends: where each position's context ends."""
    n = len(data)
    symbol = np.concatenate([data.astype(np.int64) + 1, np.zeros(8, np.int64)])
    left = ends - np.arange(n)
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = key << 9 | np.where(left > j, symbol[j : j + n], 0)
    order = np.argsort(key)
    group = np.empty(n, np.int64)
    ranked = key[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    group[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    width = 7
    while width < depth:
        size = np.diff(np.append(np.flatnonzero(fresh), n))
        slot = np.flatnonzero(np.repeat(size > 1, size))  # the groups that are not told apart
        if not len(slot):
            break
        step = min(width, depth - width)
        own = order[slot]
        after = own + step
        second = np.where(after < ends[own], group[np.minimum(after, n - 1)] + 1, 0)
        code = group[own] << 32 | second
        sort = np.argsort(code)
        order[slot] = own[sort]
        code = code[sort]
        apart = np.concatenate([[True], code[1:] != code[:-1]])
        fresh[slot] = apart
        group[own[sort]] = np.maximum.accumulate(np.where(apart, slot, 0))
        width += step
    return order, group


def kasai(data: np.ndarray, order: np.ndarray, starts: np.ndarray, counts: np.ndarray, ends: np.ndarray, cap: int) -> np.ndarray:
    """For the first counts positions of each context, the length shared with the predecessor in the array, up to cap.

    Kasai's scan goes through a text keeping the shared length less one; here all contexts are
    scanned in step, eight bytes a comparison.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data) + 1]
    word = np.ascontiguousarray(word).view("<u8").ravel()
    before = np.empty(len(data), np.int64)
    before[order[0]] = -1
    before[order[1:]] = order[:-1]
    shared = np.zeros(len(data), np.int64)
    by_count = np.argsort(-counts, kind="stable")
    starts, counts = starts[by_count], counts[by_count]
    carried = np.zeros(len(starts), np.int64)
    for j in range(int(counts[0]) if len(counts) else 0):
        live = int(np.searchsorted(-counts, -j, "left"))  # contexts with more than j positions
        at = starts[:live] + j
        other = before[at]
        most = np.where(other >= 0, np.minimum(np.minimum(ends[at] - at, ends[other] - other), cap), 0)
        size = np.minimum(carried[:live], most)
        grow = np.flatnonzero(size < most)
        while len(grow):
            unlike = word[at[grow] + size[grow]] ^ word[other[grow] + size[grow]]
            same = np.where(unlike == 0, 8, np.bitwise_count((unlike & (~unlike + np.uint64(1))) - np.uint64(1)) // 8).astype(np.int64)
            size[grow] = np.minimum(size[grow] + same, most[grow])
            grow = grow[(same == 8) & (size[grow] < most[grow])]
        shared[at] = size
        carried[:live] = np.maximum(size - 1, 0)
    return shared


def repeats_of(segments: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whether each byte of the joined segments starts a repeated window; its window's group, -1 if it starts none; first position and number of windows of each segment."""
    sizes = np.array([len(s) for s in segments], np.int64)
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(segments), np.uint8)
    ends = np.repeat(starts + sizes, sizes)
    counts = np.maximum(sizes - length + 1, 0)
    order, group = refined(data, ends, length)
    window = ends - np.arange(len(data)) >= length
    group = np.where(window, group, -1)
    long_ = kasai(data, order, starts, counts, ends, length) >= length
    before = np.concatenate([order[:1], order[:-1]])
    # Suffixes that are alike to the depth are in no order among themselves, so a carried length
    # may be too long: a group must confirm it.
    pair = long_[order] & (group[order] == group[before]) & (order != before)
    hit = np.zeros(len(data), bool)
    hit[order[pair]] = True
    hit[before[pair]] = True
    return hit, group, starts, counts


#: A merged window: its context, place there, digest, and whether no context of its shard has it too.
WINDOW = np.dtype([("h", "<i8"), ("c", "<i8"), ("place", "<i4"), ("w1", "<i8"), ("w2", "<i8"), ("lone", "?")])


def sharded(pieces: DataFrame, length: int, shard_bytes: int, buckets: int) -> DataFrame:
    """h, c, n, a, b: the runs of windows of a context that repeat in its shard, from its first; and, of dealt anchors,
    one window of each class, packed by bucket of its digest: a row for each shard and bucket."""
    dealt = pieces.repartition(F.col("h"), F.col("salt")).sortWithinPartitions("h", "salt", "c")

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        """Rows of whole groups, about shard_bytes of text at a time."""
        rows, size, key = [], 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if size >= shard_bytes and (row["h"], row["salt"]) != key:
                    yield rows
                    rows, size = [], 0
                key = (row["h"], row["salt"])
                rows.append(row)
                size += len(row["bytes"])
        if rows:
            yield rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches_of(batches):
            # Rows are sorted, so a context's twin is the row after it.
            twin = [i > 0 and r["c"] == rows[i - 1]["c"] and r["h"] == rows[i - 1]["h"] and r["bytes"] == rows[i - 1]["bytes"] for i, r in enumerate(rows)]
            doubled = [b for a, b in zip(twin, [*twin[1:], False], strict=True) if not a]
            rows = [r for r, t in zip(rows, twin, strict=True) if not t]
            hit, group, starts, counts = repeats_of([r["bytes"] for r in rows], length)
            out: list[tuple] = []
            windows: list[tuple] = []
            named: set[tuple] = set()
            for row, two, at, n in zip(rows, doubled, starts.tolist(), counts.tolist(), strict=True):
                own, key = hit[at : at + n] | two, (row["h"], row["c"])
                edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))).tolist()
                out += [(*key, row["n"], a, b - 1, None, None) for a, b in zip(edge[::2], edge[1::2], strict=True)]
                if row["salt"]:
                    for j in range(n):
                        g = (row["h"], row["salt"], int(group[at + j]))
                        if g not in named:
                            named.add(g)
                            digest = xxhash.xxh3_128_intdigest(row["bytes"][j : j + length])
                            windows.append((*key, j, (digest >> 64) - 2**63, (digest & 2**64 - 1) - 2**63, not own[j]))
            if windows:
                packed = np.array(windows, WINDOW)
                bucket = packed["w1"] % buckets
                order = np.lexsort((packed["w1"], bucket))
                for part in np.split(packed[order], np.flatnonzero(np.diff(bucket[order])) + 1):
                    out.append((None, None, None, None, None, int(part["w1"][0] % buckets), part.tobytes()))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["h", "c", "n", "a", "b", "bucket", "windows"])

    return dealt.select("h", "c", "salt", "n", "bytes").mapInArrow(run, "h bigint, c bigint, n bigint, a int, b int, bucket bigint, windows binary")


def merged(shards: DataFrame) -> DataFrame:
    """h, c, n, a, b of the lone windows that another shard has too. shards: bucket, windows (sorted by digest)."""

    def found_in(parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        joined = np.frombuffer(b"".join(parts), WINDOW)
        joined = joined[np.lexsort((joined["w2"], joined["w1"]))]
        lone = joined[joined["lone"]]
        # Each lone window is looked for by its digest's first half, and then among the few by the second.
        low, high = (np.searchsorted(joined["w1"], lone["w1"], side) for side in ("left", "right"))
        found = [i for i, (a, b) in enumerate(zip(low.tolist(), high.tolist(), strict=True)) if b - a > 1 and int((joined["w2"][a:b] == lone["w2"][i]).sum()) > 1]
        if found:
            own = lone[found]
            place = pa.array(own["place"].copy())
            yield pa.RecordBatch.from_arrays([pa.array(own["h"].copy()), pa.array(own["c"].copy()), pa.array(np.ones(len(own), np.int64)), place, place], ["h", "c", "n", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("windows").to_pylist(), strict=True):
                if bucket != now and parts:
                    yield from found_in(parts)
                    parts = []
                now = bucket
                parts.append(packed)
        if parts:
            yield from found_in(parts)

    return shards.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "h bigint, c bigint, n bigint, a int, b int")


def covered(docs: DataFrame, length: int, chunk_bytes: int, shard_bytes: int) -> DataFrame:
    """rid, spans: the runs of repeated window starts of each document that has one. docs has rid, text.

    The result is stored, and what was stored on the way is deleted as soon as nothing reads it.
    """
    found = stored(anchors(docs, length, chunk_bytes), "anchors")
    total = found.count()
    times = stored(found.groupBy("h").agg(F.count("*").alias("times")).where("times > 1"), "times")
    again = stored(joined_by_count(found, times, ["h"], "times", total).drop("times"), "contexts")
    discard(found, times)
    place = F.struct("rid", "first", "last")
    kinds = stored(again.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(place).alias("one"), F.max(place).alias("twin")), "kinds")
    many = stored(kinds.groupBy("h").agg(F.count("*").alias("kinds")), "many")
    # A context has about as many windows as anchors are apart: half a window's grams.
    hot = many.where(F.col("kinds") > SHARD).agg(F.sum("kinds").alias("n")).first()["n"] or 0
    buckets = 1 + hot * (length - GRAM) // 2 // BUCKET
    salt = F.when(F.col("kinds") > SHARD, 1 + F.pmod("c", F.ceil(F.col("kinds") / SHARD))).otherwise(0)
    both = F.explode(F.when(F.col("n") > 1, F.array("one", "twin")).otherwise(F.array("one")))
    asked = joined_by_count(kinds, many, ["h"], "kinds", total).select("h", "c", salt.cast("bigint").alias("salt"), "n", both.alias("at"))
    per_text = asked.groupBy("at.rid").agg(F.collect_list(F.struct("h", "c", "salt", "n", "at.first", "at.last")).alias("asked"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", chunk_bytes):
            rows = []
            for text, asked in zip(*(chunk.column(c).to_pylist() for c in ("text", "asked")), strict=True):
                text = text.encode()
                rows += [(a["h"], a["c"], a["salt"], a["n"], text[a["first"] : a["last"] + length]) for a in asked]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["h", "c", "salt", "n", "bytes"])

    pieces = docs.join(per_text, "rid").select("text", "asked").mapInArrow(cut, "h bigint, c bigint, salt bigint, n bigint, bytes binary")
    results = stored(sharded(pieces, length, shard_bytes, buckets), "suffixes")
    discard(kinds, many)
    runs = results.where("bucket IS NULL").select("h", "c", "n", "a", "b")
    if hot:
        runs = stored(runs.union(merged(results.where("bucket IS NOT NULL").select("bucket", "windows"))), "runs")
    hits = joined_by_count(again, runs, ["h", "c"], "n", total)
    spans = F.collect_set(F.struct((F.col("first") + F.col("a")).alias("first"), (F.col("first") + F.col("b")).alias("last")))
    done = stored(hits.groupBy("rid").agg(spans.alias("spans")), "spans")
    discard(again, results, runs)
    return done


def kept_parts(text: bytes, spans: list[dict] | None, length: int) -> tuple[list[bytes], int]:
    """What is left of the text, and how many maximal runs went."""
    if not spans:
        return [text], 0
    edges = sorted((s["first"], s["last"] + length) for s in spans)
    parts, runs, end = [], 0, -1
    for a, b in edges:
        if a > end:
            parts.append(text[max(end, 0) : a])
            runs += 1
        end = max(end, b)
    return [*parts, text[end:]], runs


def with_spans(docs: DataFrame, text_col: str, length: int, chunk_bytes: int, shard_bytes: int) -> DataFrame:
    """docs with the column spans; each row once."""
    own = numbered(docs, "_rid")
    found = covered(own.select(F.col("_rid").alias("rid"), whole_text(text_col).alias("text")), length, chunk_bytes, shard_bytes)
    return own.join(found.withColumnRenamed("rid", "_rid"), "_rid", "left").drop("_rid")


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def dedup_report(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 4 << 20, shard_bytes: int = 1 << 20) -> DataFrame:
    """Per document: its bytes, the removed ones and their runs, and the digest of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", chunk_bytes):
            n, gone, runs, digests = [], [], [], []
            for text, spans in zip(chunk.column("text").to_pylist(), chunk.column("spans").to_pylist(), strict=True):
                text = text.encode()
                parts, cut = kept_parts(text, spans, length)
                n.append(len(text))
                gone.append(len(text) - sum(map(len, parts)))
                runs.append(cut)
                digests.append(hashlib.sha256(b"".join(parts)).hexdigest())
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id").combine_chunks(), *(pa.array(x, pa.int64()) for x in (n, gone, runs)), pa.array(digests)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    own = docs.select(docs[id_col].cast("bigint").alias("doc_id"), whole_text(text_col).alias("text"))
    return with_spans(own, "text", length, chunk_bytes, shard_bytes).select("doc_id", "text", "spans").mapInArrow(run, RESULT)


def dedup(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 4 << 20, shard_bytes: int = 1 << 20) -> DataFrame:
    """The documents with repeated bytes removed, all columns; characters that a cut leaves in part are dropped.

    A null text stays null, and a text of which nothing is left becomes empty: no row goes.
    """
    place = docs.columns.index(text_col)
    plain = docs.select(*[docs[c].alias(f"_c{i}") for i, c in enumerate(docs.columns)])
    joined = with_spans(plain, f"_c{place}", length, chunk_bytes, shard_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, f"_c{place}", chunk_bytes):
            new = []
            for text, spans in zip(chunk.column(f"_c{place}").to_pylist(), chunk.column("spans").to_pylist(), strict=True):
                new.append(text if text is None or not spans else "".join(p.decode("utf-8", "ignore") for p in kept_parts(text.encode(), spans, length)[0]))
            chunk = chunk.set_column(place, f"_c{place}", pa.array(new, pa.string()))
            yield from chunk.drop_columns(["spans"]).combine_chunks().to_batches()

    return joined.select(*plain.columns, "spans").mapInArrow(run, plain.schema).toDF(*docs.columns)
