"""N-gram Jaccard join by parity sketches.

A document is its set of word shingles, by 64-bit hash. Per size band the hash range is cut into
blocks, and a block's signature is the exclusive or of the hashes in it: an added or removed
shingle changes one signature, so the number of unlike signatures is at most the symmetric
difference, and that is at most a ninth of both sizes at a similarity of 0.8. By the pigeonhole
principle two linked documents share one of each one's first D + 1 signatures in any common order;
the order is rarest first, so that what many documents share is hardly ever joined on. A wider
parity sketch, whose Hamming distance bounds the difference from below too, drops most false
candidates, folded to FOLDED bits within the pigeonhole join and at its full width after it; what
is left is verified on whole sets.

A signature's group is never paired out: in each round its members meet a few pivots, linked ones
join a component, and a pivot that has met its group leaves. Rounds end when every group lies in
one component, so no link between components is lost. Sets that are alike are one class.

Defined results: null or empty texts have no shingles and only themselves as a component; a null
id counts after all others within a component; rows that repeat an id are each other's links if
their texts are; other columns are ignored. Hashes of 64 bits stand for shingles and sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, chunks, discard, numbered, stored, whole_text, without
from .components import labels

GOLD, FMIX1, FMIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))
#: Below this size blocks are so many that each shingle is alone in its own.
SINGLE = 1024
#: Bits of the sketch that members carry into the pigeonhole join, in two integers.
FOLDED = 128
#: Signatures whose order is known by how common they are; the others count as rare.
COMMON = 100_000


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * FMIX1
    x = (x ^ x >> np.uint64(33)) * FMIX2
    return x ^ x >> np.uint64(33)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_sets(texts: Iterable[str], words: int) -> Iterator[np.ndarray]:
    """Each text's shingles: sorted distinct hashes."""
    known = WordHashes()
    for text in texts:
        own = text.encode().translate(LOWER).split()
        h = np.fromiter(map(known.__getitem__, own), np.uint64, len(own))
        n = max(min(1, len(h)), len(h) - words + 1)
        code = np.full(n, min(len(h), words), np.uint64)
        for j in range(min(len(h), words)):
            code = code * GOLD + h[j : j + n]
        yield np.unique(mixed(code))


def widest_difference(n: int) -> int:
    """The most elements in which a set of n differs from a linked one: a ninth of both sizes, the other at most 5/4."""
    return (n + n * 5 // 4) // 9


def prefix_length(n: int, single: bool) -> int:
    """So many first signatures of a set that a linked one has one of them: one more than can be unlike. Where
    shingles are alone in their blocks, only the set's own excess of a fifth at most can be."""
    return (n // 5 if single else widest_difference(n)) + 1


def signatures(own: np.ndarray) -> Iterator[tuple[bool, np.ndarray]]:
    """The set's signatures in its size band, and in the next where a linked set may lie there; and whether shingles are alone."""
    n = len(own)
    bands = sorted({0 if m < SINGLE else int(m).bit_length() + 1 >> 1 for m in (n, n * 5 // 4)})
    for band in bands:
        if not band:
            yield True, mixed(own ^ FMIX1)
            continue
        bits = 2 * band  # 4 ** band blocks, at least as many as the band's largest set has elements
        block = own >> np.uint64(64 - bits)
        begins = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        parity = np.bitwise_xor.reduceat(mixed(own ^ GOLD), begins)
        some = parity != 0
        yield False, mixed(parity[some] ^ (block[begins][some] + np.uint64(band << 56)) * GOLD)


def sketch(own: np.ndarray) -> bytes:
    """Parity bits, about four per element; a power of two, so that a wider one folds to a narrower one."""
    bits = 1 << min(14, max(8, (2 * len(own)).bit_length()))
    return np.packbits(np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8).tobytes()


def folded(parity: bytes) -> np.ndarray:
    """The sketch at FOLDED bits, as 64-bit integers."""
    x = np.frombuffer(parity, np.uint8)
    while len(x) * 8 > FOLDED:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.view(np.int64)


def far_apart(a: bytes, b: bytes, n: int, m: int) -> bool:
    """Whether the sketches' distance alone rules a link out."""
    x, y = (np.frombuffer(s, np.uint8) for s in ((a, b) if len(a) >= len(b) else (b, a)))
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) * 9 > n + m


def class_of(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - 2**63


def surveyed(docs: DataFrame, words: int, chunk_bytes: int) -> DataFrame:
    """Per row its id, class, size and sketch, whole and folded; and per chunk the signatures found twice or more, with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", chunk_bytes):
            sizes, classes, sketches, folds, held, seen = [], [], [], [], [], set()
            for own in shingle_sets((t for b in chunk.column("text").chunks for t in b.to_pylist()), words):
                k = class_of(own)
                sizes.append(len(own))
                classes.append(k if len(own) else None)
                new = len(own) > 0 and k not in seen
                sketches.append(sketch(own) if new else None)
                folds.append(folded(sketches[-1]).tolist() if new else [None, None])
                if new:
                    held += [sig for _, sig in signatures(own)]
                seen.add(k)
            found, n = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
            common = n > 1
            none = pa.nulls(int(common.sum()), pa.int64())
            rows = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.concat_arrays([chunk.column(c).combine_chunks(), none]) for c in ("row", "doc_id")),
                    pa.concat_arrays([pa.array(sizes, pa.int64()), none]),
                    pa.concat_arrays([pa.array(classes, pa.int64()), none]),
                    pa.array([*sketches, *[None] * len(none)], pa.binary()),
                    *(pa.array([*(f[i] for f in folds), *[None] * len(none)], pa.int64()) for i in (0, 1)),
                    pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(found[common].view(np.int64))]),
                    pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(n[common], pa.int64())]),
                ],
                ["row", "doc_id", "n", "k", "sketch", "f0", "f1", "sig", "times"],
            )

    return docs.mapInArrow(run, "row bigint, doc_id bigint, n bigint, k bigint, sketch binary, f0 bigint, f1 bigint, sig bigint, times bigint")


def prefixes(docs: DataFrame, words: int, common: tuple[bytes, bytes], chunk_bytes: int) -> DataFrame:
    """sig, k, n, salt: the rarest D + 1 signatures of every class that a chunk holds; common ones are dealt over salts."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(common)  # at most COMMON entries of 16 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = (np.frombuffer(x, t) for x, t in zip(shared.value, (np.uint64, np.int64), strict=True))
        for chunk in chunks(batches, "text", chunk_bytes):
            seen, sigs, classes, sizes, salts = set(), [], [], [], []
            for own in shingle_sets((t for b in chunk.column("text").chunks for t in b.to_pylist()), words):
                if not len(own) or (k := class_of(own)) in seen:
                    continue
                seen.add(k)
                for single, sig in signatures(own):
                    often = np.zeros(len(sig), np.int64)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, sig), len(known) - 1)
                        often = np.where(known[at] == sig, times[at], 0)
                    first = np.lexsort((sig, often))[: prefix_length(len(own), single)]
                    sigs.append(sig[first].view(np.int64))
                    classes.append(np.full(len(first), k))
                    sizes.append(np.full(len(first), len(own)))
                    salts.append(np.where(often[first] > 0, 1 + k % (1 + often[first] // 64), 0))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (sigs, classes, sizes, salts)], ["sig", "k", "n", "salt"])

    return docs.mapInArrow(run, "sig bigint, k bigint, n bigint, salt bigint")


def shared_only(rows: DataFrame) -> DataFrame:
    """sig, k, n of the signatures that two classes have; those of common signatures pass as they are."""
    # A common signature is dealt over many tasks; the others have few rows each.
    dealt = rows.repartition(F.col("sig"), F.col("salt")).sortWithinPartitions("sig", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, met = np.zeros((0, 4), np.int64), False  # the row before, and whether the one before that has its signature
        for batch in batches:
            if not batch.num_rows:
                continue
            got = np.concatenate([last, np.stack([batch.column(i).to_numpy() for i in range(4)], 1)])
            same = (got[1:, 0] == got[:-1, 0]) & (got[1:, 1] == got[:-1, 1])
            got = got[np.concatenate([[True], ~same])]
            near = got[1:, 0] == got[:-1, 0]
            before = np.concatenate([[met], near])
            out = got[:-1][before[:-1] | near | (got[:-1, 3] > 0)]
            last, met = got[-1:], bool(before[-1])
            yield pa.RecordBatch.from_arrays([pa.array(out[:, i]) for i in range(3)], ["sig", "k", "n"])
        if met or (last[:, 3] > 0).any():
            yield pa.RecordBatch.from_arrays([pa.array(last[:, i]) for i in range(3)], ["sig", "k", "n"])

    return dealt.mapInArrow(run, "sig bigint, k bigint, n bigint")


def with_lone(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds lone, how many of a class's first signatures no other class has among its own, which serves to choose
    pivots, and the class's folded sketch."""
    count = members.groupBy("k").agg(F.count("*").alias("shared")).join(classes.select("k", "f0", "f1"), "k")
    return members.join(count, "k").withColumn("lone", F.col("n") / 5 - F.col("shared")).select("sig", "k", "n", "lone", "f0", "f1")


def set_table(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """k, elements of the wanted classes (k, row: one row of each)."""
    texts = docs.join(wanted, "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [own.tobytes() for own in shingle_sets(batch.column("text").to_pylist(), words)]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(sets, pa.binary())], ["k", "elements"])

    return texts.select("k", "text").mapInArrow(run, "k bigint, elements binary")


def near_by_sketch(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and sketches leave."""
    one = lambda s: classes.select(F.col("k").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"s_{s}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, t, n, m = (batch.column(c).to_pylist() for c in ("s_a", "s_b", "n_a", "n_b"))
            keep = pa.array([not far_apart(*x) for x in zip(s, t, n, m, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return both.mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets are alike enough."""
    both = pairs.join(sets.toDF("a", "s_a"), "a").join(sets.toDF("b", "s_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("s_a"), batch.column("s_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


def candidates(members: DataFrame, pivots: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of members and their group's pivots; and the members that are no pivots, for the next round.

    members has sig, k, n, lone, f0, f1, label. A group's first pivot is the class with the fewest
    signatures of its own, the likeliest to be linked; by a lottery over classes where several have, so
    that groups of much the same classes have the same; groups of up to 2 * pivots meet whole.
    """
    lot = F.xxhash64("k")
    groups = members.groupBy("sig").agg(F.count("*").alias("size"), F.min(F.struct("lone", lot.alias("lot"), "k"))["k"].alias("first"), F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    open_ = members.join(groups.select("sig", "size", "first"), "sig")
    share = F.pmod(lot, F.lit(1_000_000)) * F.col("size") < pivots * 1_000_000
    chosen = (F.col("size") <= 2 * pivots) | (F.col("k") == F.col("first")) | (share & F.lit(pivots > 1))
    open_ = stored(open_.select("sig", "k", "n", "lone", "f0", "f1", "label", chosen.alias("pivot")), "groups")
    pivot = open_.where("pivot").select("sig", F.col("k").alias("p"), F.col("n").alias("p_n"), F.col("f0").alias("p_f0"), F.col("f1").alias("p_f1"), F.col("label").alias("p_label"))
    near = "9 * (bit_count(f0 ^ p_f0) + bit_count(f1 ^ p_f1)) <= n + p_n"
    met = open_.join(pivot, "sig").where(f"label != p_label AND 100 * least(n, p_n) >= 80 * greatest(n, p_n) AND {near}")
    pairs = met.select(F.least("k", "p").alias("a"), F.greatest("k", "p").alias("b")).distinct()
    return pairs, open_.where("NOT pivot").select("sig", "k", "n", "lone", "f0", "f1")


def nearer(known: DataFrame | None, links: DataFrame) -> DataFrame:
    """k, label: each linked class takes the least label of its neighbours and itself; labels are their own at first.

    Alike labels mean one component. That they may lag behind only makes for more pairs to verify.
    """
    both = links.select(F.col("a").alias("k"), F.col("b").alias("other")).union(links.select(F.col("b").alias("k"), F.col("a").alias("other")))
    if known is None:
        return both.groupBy("k").agg(F.least(F.col("k"), F.min("other")).alias("label"))
    seen = both.join(known.select(F.col("k").alias("other"), "label"), "other").select("k", "label").union(known)
    return seen.groupBy("k").agg(F.min("label").alias("label"))


def join_near(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", pivots: int = 1, chunk_bytes: int = 8 << 20) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest id that links lead to)."""
    own = numbered(docs.select(docs[id_col].cast("bigint").alias("doc_id"), whole_text(text_col).alias("text")), "row")
    found = joined(own, words, percent, pivots, chunk_bytes)
    discard(own)
    return found.select("doc_id", "n_shingles", "component_id")


def joined(plain: DataFrame, words: int, percent: int, pivots: int = 1, chunk_bytes: int = 8 << 20) -> DataFrame:
    """row, doc_id, n_shingles, component_id of the rows of plain: row (its number), doc_id, text.

    The result is stored, and what was stored on the way is deleted as soon as nothing reads it.
    """
    if percent < 80:
        raise ValueError("the size bands hold for a similarity of 80 percent or more")
    survey = stored(surveyed(plain.select("row", "doc_id", "text"), words, chunk_bytes), "survey")
    common = survey.where("sig IS NOT NULL").groupBy("sig").agg(F.sum("times").alias("times")).where("times > 7").orderBy(F.desc("times"), "sig").limit(COMMON)
    top = common.toArrow()  # COMMON rows at most, as columns
    sigs, times = top.column("sig").to_numpy().view(np.uint64), top.column("times").to_numpy().astype(np.int64)
    order = np.argsort(sigs)
    ordered = (sigs[order].tobytes(), times[order].tobytes())
    of_docs = survey.where("n IS NOT NULL").select("row", "doc_id", "n", "k", "sketch", "f0", "f1")
    classes = stored(of_docs.where("k IS NOT NULL").groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.min("n").alias("n"), F.max("sketch").alias("sketch"), F.max("f0").alias("f0"), F.max("f1").alias("f1")), "classes")
    shared = stored(shared_only(prefixes(plain, words, ordered, chunk_bytes)), "shared")
    members = stored(with_lone(shared, classes), "members")
    discard(shared)
    links: DataFrame | None = None
    sets: DataFrame | None = None
    known: DataFrame | None = None
    while True:
        marked = members.withColumn("label", F.col("k")) if known is None else members.join(known, "k", "left").withColumn("label", F.coalesce("label", "k"))
        met, rest = candidates(marked, pivots)
        discard(members)
        members = rest
        pairs = stored(near_by_sketch(met, classes), "pairs")
        wanted = pairs.select(F.col("a").alias("k")).union(pairs.select(F.col("b").alias("k"))).distinct()
        if sets is not None:
            wanted = wanted.join(sets.select("k"), "k", "left_anti")
        wanted = stored(wanted.join(classes.select("k", "row"), "k"), "wanted")
        if not wanted.isEmpty():
            more = stored(set_table(plain.select("row", "text"), wanted, words), "sets")
            sets = more if sets is None else sets.union(more)
        discard(wanted)
        if sets is not None and not pairs.isEmpty():
            near = stored(verified(pairs, sets, percent), "links")
            if not near.isEmpty():
                links = near if links is None else links.union(near)
                old, known = known, stored(nearer(nearer(None, links), links), "labels")
                discard(old)
        discard(pairs)
        if members.isEmpty():
            break
        pivots *= 8
    discard(members, sets, known)
    found = None if links is None else labels(links)
    least = classes.select("k", "doc_id") if found is None else classes.join(found.select(F.col("node").alias("k"), "label"), "k", "left").select("k", "doc_id", F.coalesce("label", "k").alias("label"))
    if found is not None:
        lowest = least.groupBy("label").agg(F.min("doc_id").alias("lowest"))
        least = least.join(lowest, "label").select("k", F.col("lowest").alias("doc_id"))
    named = least.select(F.col("k").alias("_k"), F.col("doc_id").alias("component"))
    whole = of_docs.join(named, F.col("k") == F.col("_k"), "left")
    result = stored(whole.select("row", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")), "components")
    discard(survey, classes, links, found)
    return result


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, the first by id (null last) and content; all columns as they were.

    Rows are told apart by a number of their own, stored with them, so rows that repeat an id, or have
    none, are decided one by one. A row without shingles stays. Rows that stay are not
    shuffled, but for some whose number shares a bit with that of a row that goes.
    """
    row = "_leadloom_row"
    own = numbered(docs, row)
    plain = own.select(F.col(row).alias("row"), F.col(row).alias("doc_id"), whole_text(text_col).alias("text"))
    components = joined(plain, words, percent)
    found = components.select(F.col("row").alias("_r"), "component_id")
    id_, text = own[id_col].cast("bigint"), F.xxhash64(whole_text(text_col))
    order = F.struct(id_.isNull().alias("none"), id_.alias("id"), text.alias("h"), F.col(row).alias("r"))
    first = own.select(F.col(row), order.alias("o")).join(found, F.col(row) == F.col("_r")).groupBy("component_id").agg(F.min("o")["r"].alias("_kept"))
    kept = found.select("_r").join(first.select("_kept"), F.col("_r") == F.col("_kept"), "left")
    kept = stored(kept.select(F.col("_r").alias(row), F.col("_kept").isNotNull().alias("stays")), "kept")
    discard(components)
    return without(own, kept.where("NOT stays").select(row), row).drop(row)
