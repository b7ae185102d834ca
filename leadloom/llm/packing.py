"""Packing into sequences by cutting-stock column generation.

Tokens beyond whole sequences leave a document one tail of 1 to `size` - 1 tokens. Only the
histogram of tail lengths, `size` numbers, reaches the driver. There a linear program over
patterns (how many tails of which lengths fill a sequence) is solved by column generation: the
master program's dual prices value the lengths, and an unbounded knapsack by dynamic programming
finds the pattern worth most, until none is worth more than the sequence it takes, the lower bound
proves the program to the whole sequence, or it has all but ceased to gain. The patterns'
numbers are rounded down; what is left goes first-fit-decreasing into further patterns. Patterns
with room to spare take cut tails: those of the emptiest patterns are dissolved and poured, in
order, into the others' room.

The plan is a table of at most a few thousand rows. Tails are ranked within their length (in
buckets, whose sizes are added up first, so that a common length is no group of a task), and rank
and plan give each piece its sequence and offset by arithmetic.

Defined results: a null or empty text is the one end id; rows that repeat an id are packed one by
one, so are null ids; an empty table gives no sequences; other columns are ignored by pack().
"""

from __future__ import annotations

import base64
import json
import math
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import merges
from .common import chunks, numbered, whole_text
from .tokens import Words, vocabulary

END_ID = 0
#: Room below this stays padding: it isn't worth cutting tails for.
SMALL = 8
#: What a pattern has to be worth beyond its sequence to count as a gain.
GAIN = 1e-6
#: The linear program ends when its own bound, rounded up, proves it. It ends as well when so many pricings in a row have taken
#: less than this share off it, whatever its size: proofs of large programs take long in coming.
PATIENCE, TAIL = 128, 1e-4
#: Patterns that a pricing adds at most, and steps after which the inverse is made anew.
COLUMNS, REFRESH = 32, 256
#: The share of the best bound's prices in those that patterns are priced at.
SMOOTH = 0.7


@lru_cache(maxsize=2)
def tokenizer(file: str) -> Callable[[str], np.ndarray]:
    """What encodes texts: the tokenizers library for a .json file, and for a rank file tiktoken, which is faster.

    The public vocabulary comes as both; special strings in a text are their one id to either. A rank
    file has none of its own: they are those of the .json file beside it.
    """
    if file.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        found = Tokenizer.from_file(file)
        return lambda text: np.array(found.encode(text, add_special_tokens=False).ids, "<u4")
    with open(file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    special: dict[str, int] = {}
    if os.path.exists(beside := os.path.splitext(file)[0] + ".json"):
        with open(beside, encoding="utf-8") as whole:
            special = {t["content"]: t["id"] for t in json.load(whole)["added_tokens"]}
    encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        try:
            return encoding.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # its pattern gives up on millions of spaces in a row
            parts = re.split(f"({'|'.join(map(re.escape, special))})", text) if special else [text]
            if len(parts) > 1:
                return np.concatenate([encode(t) for t in parts])
            words = Words()
            own = words.of(text)
            listed, pieces = words.words()
            ids, cuts = merges(file).replay([w.encode() for w in listed])
            return np.concatenate([ids[cuts[k] : cuts[k + 1]] for w in own.tolist() for k in pieces[w]])

    return encode


def tokenised(docs: DataFrame, file: str | None, size: int, chunk_bytes: int) -> DataFrame:
    """doc_id, tokens, full (the checksums of whole sequences), tail (the ids beyond them, four bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary(file, "byte_bpe_50k.tiktoken"))
        end = np.array([END_ID], "<u4").tobytes()
        for chunk in chunks(batches, "text", chunk_bytes):
            tokens, full, tails = [], [], []
            for text in chunk.column("text"):
                data = encode(text.as_py()).astype("<u4").tobytes() + end
                whole = len(data) // (4 * size)
                tokens.append(len(data) // 4)
                full.append([zlib.crc32(data[4 * size * i : 4 * size * (i + 1)]) for i in range(whole)])
                tails.append(data[4 * size * whole :])
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id").combine_chunks(), pa.array(tokens, pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array(tails, pa.binary())], ["doc_id", "tokens", "full", "tail"])

    return docs.mapInArrow(run, "doc_id bigint, tokens bigint, full array<bigint>, tail binary")


def best_patterns(prices: np.ndarray, lengths: np.ndarray, size: int) -> tuple[float, list[np.ndarray]]:
    """Unbounded knapsack by dynamic programming: the greatest price that fits; and patterns worth more than one
    sequence, each the best of those with some length, as a count for each length; the best first."""
    best = np.zeros(size + 1)
    took = np.full(size + 1, -1)
    for room in range(1, size + 1):
        fits = int(np.searchsorted(lengths, room, "right"))
        if fits:
            worth = best[room - lengths[:fits]] + prices[:fits]
            i = int(worth.argmax())
            if worth[i] > best[room - 1]:
                best[room], took[room] = worth[i], i
                continue
        best[room] = best[room - 1]
    with_it = prices + best[size - lengths]
    found, seen = [], set()
    for first in np.argsort(-with_it, kind="stable").tolist():
        if with_it[first] <= 1 + GAIN or len(found) == COLUMNS:
            break
        counts, room = np.zeros(len(lengths), np.int64), size - int(lengths[first])
        counts[first] = 1
        while room > 0:
            if took[room] < 0:
                room -= 1
            else:
                counts[took[room]] += 1
                room -= int(lengths[took[room]])
        if (key := counts.tobytes()) not in seen:
            seen.add(key)
            found.append(counts)
    return float(best[size]), found


def first_patterns(lengths: np.ndarray, demand: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A basis and how often each of its patterns is used: first fit decreasing over what is left, each pattern until
    one of its lengths is used up. Later patterns lack that length, so the basis is triangular."""
    left, over = demand.copy(), demand > 0
    basis, use = np.diag(size // lengths).astype(np.float64), np.zeros(len(lengths))
    while over.any():
        room, pattern = size, np.zeros(len(lengths))
        rest = np.flatnonzero(over)
        while len(rest := rest[lengths[rest] <= room]):
            i = int(rest[-1])
            pattern[i] = room // int(lengths[i])
            room %= int(lengths[i])
            rest = rest[:-1]
        some = np.flatnonzero(pattern)
        ratio = left[some] / pattern[some]
        out = int(some[ratio.argmin()])
        basis[:, out], use[out] = pattern, ratio.min()
        left = np.maximum(left - use[out] * pattern, 0)
        over[out] = False
    return basis, use


def rounded_up(sequences: float) -> int:
    return math.ceil(sequences - 1e-6)


def linear_program(lengths: np.ndarray, demand: np.ndarray, size: int) -> tuple[list[tuple[float, np.ndarray]], float]:
    """How often to use which pattern, fractions allowed, by the revised simplex method with generated columns; and
    the lower bound on sequences: no plan has fewer."""
    basis, use = first_patterns(lengths, demand, size)
    bound = float(demand @ lengths) / size  # no sequence holds more than size tokens
    if rounded_up(use.sum()) > rounded_up(bound):
        # Uses a little above zero keep steps from having no length.
        spread = 1e-6 * use.mean() * (1.5 + np.sin(np.arange(len(use))))
        extra, asked, use = float(spread.sum()), demand + basis @ spread, use + spread
        inverse, change, done = np.linalg.inv(basis), np.empty_like(basis), 0
        center, weight = lengths / size, SMOOTH
        sums = [float(use.sum())]
        while rounded_up(sums[-1] - extra) > rounded_up(bound) and (len(sums) <= PATIENCE or sums[-PATIENCE - 1] - sums[-1] > TAIL * sums[-1]):
            own = np.maximum(inverse.sum(axis=0), 0)  # every pattern costs one sequence
            # Priced between the basis's prices and those of the best bound, which swing less.
            prices = weight * center + (1 - weight) * own
            worth, patterns = best_patterns(prices, lengths, size)
            # Prices over the worth of the best pattern are fair to every pattern, so what they give is a lower bound.
            if (fair := float(prices @ demand) / max(worth, 1.0)) > bound:
                bound, center = fair, prices / max(worth, 1.0)
            moved = False
            for pattern in patterns:
                way = inverse @ pattern
                if way.sum() <= 1 + GAIN:  # after the other steps it gains nothing any more
                    continue
                ratio = np.where(way > 1e-7, use / np.where(way > 1e-7, way, 1), np.inf)
                out = int(ratio.argmin())
                step, moved = ratio[out], True
                use = np.maximum(use - step * way, 0)
                use[out] = step
                basis[:, out] = pattern
                pivot = inverse[out] / way[out]
                inverse -= np.multiply.outer(way, pivot, out=change)
                inverse[out] = pivot
                done += 1
                if done % REFRESH == 0:
                    inverse = np.linalg.inv(basis)
                    use = np.maximum(inverse @ asked, 0)
            if not moved and weight == 0:
                break  # no pattern gains by the basis's own prices
            weight = SMOOTH if moved else 0.0
            sums.append(float(use.sum()))
        use = np.maximum(np.linalg.solve(basis, demand), 0)
    return [(float(u), basis[:, j].round().astype(np.int64)) for j, u in enumerate(use)], bound


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """(number, {length: count}) patterns that hold every tail once."""
    lengths = np.array(sorted(k for k, n in histogram.items() if n), np.int64)
    if not len(lengths):
        return []
    left = np.array([histogram[int(k)] for k in lengths], np.int64)
    found: list[tuple[int, dict[int, int]]] = []
    for use, pattern in sorted(linear_program(lengths, left.astype(np.float64), size)[0], key=lambda p: -p[0]):
        some = pattern > 0
        times = min(int(use + 1e-6), int((left[some] // pattern[some]).min()) if some.any() else 0)
        if times:
            left -= times * pattern
            found.append((times, {int(k): int(n) for k, n in zip(lengths[some], pattern[some], strict=True)}))
    # First fit decreasing for the rest, the same pattern as often as it can be had.
    while left.any():
        room, pattern = size, np.zeros(len(lengths), np.int64)
        for i in range(len(lengths) - 1, -1, -1):
            n = min(int(left[i]), room // int(lengths[i]))
            pattern[i] = n
            room -= n * int(lengths[i])
        some = pattern > 0
        times = int((left[some] // pattern[some]).min())
        left -= times * pattern
        found.append((times, {int(k): int(n) for k, n in zip(lengths[some], pattern[some], strict=True)}))
    return found


class Plan:
    """Where tails go. Whole tails: by length, rank ranges that belong to a pattern. Dissolved ones: by length, rank
    ranges on a line of tokens, which is poured into the line of the patterns' room."""

    def __init__(self, histogram: dict[int, int], size: int):
        patterns = [(n, p, size - sum(k * c for k, c in p.items())) for n, p in plan(histogram, size)]
        # Sequences of a power of two aren't padded.
        spare = lambda room: 0 if size - room & size - room - 1 == 0 else room
        patterns.sort(key=lambda p: (spare(p[2]), p[2]))
        kept, held, dissolved = [], 0, {}
        room = [n * r if spare(r) >= SMALL else 0 for n, _, r in patterns]
        total = sum(room)
        while patterns and spare(patterns[-1][2]) >= SMALL:
            n, pattern, r = patterns[-1]
            filled = size - r
            # Dissolving one more takes its room away and pours its tokens into what is left.
            times = min(n, max(0, (total - held) // (r + filled)))
            if times:
                held += times * filled
                total -= times * r
                for k, c in pattern.items():
                    dissolved[k] = dissolved.get(k, 0) + times * c
            if times < n:
                patterns[-1] = (n - times, pattern, r)
                break
            patterns.pop()
        self.whole: list[tuple] = []  # length, first rank, last rank + 1, first sequence, per sequence, offset
        self.room: list[tuple] = []  # first token on the line, tokens, first sequence, room each, offset
        rank: dict[int, int] = {}
        sequence = line = 0
        for n, pattern, r in patterns:
            offset = 0
            for k, c in sorted(pattern.items(), reverse=True):
                low = rank.get(k, 0)
                self.whole.append((k, low, low + n * c, sequence, c, offset))
                rank[k] = low + n * c
                offset += k * c
            if spare(r) >= SMALL and line < held:
                self.room.append((line, n * r, sequence, r, offset))
                line += n * r
            sequence += n
        self.poured: list[tuple] = []  # length, first rank, last rank + 1, first token on the line
        line = 0
        for k, n in sorted(dissolved.items()):
            low = rank.get(k, 0)
            self.poured.append((k, low, low + n, line))
            line += k * n
        self.sequences = sequence


def pack(docs: DataFrame, size: int = 1024, tokenizer_file: str | None = None, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 16 << 20, bucket_rows: int = 128) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    own = docs.select(docs[id_col].cast("bigint").alias("doc_id"), whole_text(text_col).alias("text"))
    coded = numbered(tokenised(own, tokenizer_file, size, chunk_bytes), "row")
    rest = (F.col("tokens") % size).cast("int")
    tails = coded.withColumn("rest", rest).where("rest > 0")
    counts = {r["rest"]: r["n"] for r in tails.groupBy("rest").agg(F.count("*").alias("n")).collect()}  # size rows at most
    made = Plan(counts, size)
    # Ranks within a length: by buckets of about bucket_rows rows, whose sizes are added up.
    spread = docs.sparkSession.createDataFrame([(k, -(-n // bucket_rows)) for k, n in counts.items()], "rest int, buckets bigint")
    dealt = tails.join(F.broadcast(spread), "rest")  # at most size rows
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("row"), F.col("buckets"))).select("row", "doc_id", "tokens", "tail", "rest", "bucket")
    before = Window.partitionBy("rest").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("rest", "bucket").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("rest", "bucket").orderBy("row")
    ranked = dealt.withColumn("place", F.row_number().over(within) - 1).join(offsets, ["rest", "bucket"]).withColumn("rank", F.col("base") + F.col("place")).select("doc_id", "tokens", "tail", "rest", "rank")
    whole_rows, room_rows, poured_rows = made.whole, made.room, made.poured

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        table = np.array([(*r, -1) for r in whole_rows] + [(k, a, b, 0, 1, 0, line) for k, a, b, line in poured_rows], np.int64).reshape(-1, 7)
        for k in np.unique(table[:, 0]).tolist():
            rows = table[table[:, 0] == k]
            rows = rows[np.argsort(rows[:, 1])]
            by_length[k] = rows[:, 1], rows
        room = np.array(room_rows, np.int64).reshape(-1, 5)
        for batch in batches:
            out: list[tuple] = []
            for doc, tokens, tail, k, rank in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tokens", "tail", "rest", "rank")), strict=True):
                firsts, rows = by_length[k]
                _, low, _, sequence, each, offset, line = rows[int(np.searchsorted(firsts, rank, "right")) - 1].tolist()
                start = tokens - k
                if line < 0:
                    out.append((doc, start, k, zlib.crc32(tail), tokens, sequence + (rank - low) // each, offset + (rank - low) % each * k))
                    continue
                at, done = line + (rank - low) * k, 0
                while done < k:
                    first, _, sequence, size_each, offset = room[int(np.searchsorted(room[:, 0], at, "right")) - 1].tolist()
                    nth, used = divmod(at - first, size_each)
                    n = min(k - done, size_each - used)
                    out.append((doc, start + done, n, zlib.crc32(tail[4 * done : 4 * (done + n)]), tokens, sequence + nth, offset + used))
                    at, done = at + n, done + n
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kinds = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    pieces = ranked.mapInArrow(place, kinds)
    # A whole sequence is a piece alone: any number not yet used will do.
    whole = coded.where(F.size("full") > 0).select("doc_id", "tokens", F.posexplode("full").alias("i", "crc"))
    number = F.lit(made.sequences) + F.monotonically_increasing_id()
    whole = whole.select("doc_id", (F.col("i") * size).cast("bigint").alias("start"), F.lit(size).cast("bigint").alias("length"), F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), number.alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return pieces.union(whole)
