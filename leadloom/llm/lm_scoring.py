"""Language-model scoring by prediction by partial matching, trained on the corpus itself.

The model is a trie of byte contexts of up to ORDER bytes. A byte is predicted at the longest
context that was seen; what the context has not seen is reached by an escape (method D: each
successor gives half of its first occurrence to it), and symbols that a longer context could have given are
excluded from the shorter ones. Texts are scored with A-Z in lower case, and the end of a text is a
symbol too; four pad bytes stand before its start.

The trie is never held whole. Documents are dealt into blocks of bounded size; a block names its
distinct strings of ORDER + 1 bytes and its distinct words, with their counts in its training
documents. Counts are added up over all blocks. A string's probability needs the nodes of its own
contexts only: all of order two and more share their last two bytes, by which the strings are
dealt out, and the nodes of order one and zero are at most 257 * 256. Each block gets back the
probabilities of its strings and the counts of the words that other blocks have too, and scores
its documents.

Defined results: a null or empty text is its end alone; rows are scored one by one, repeated ones
and those with null ids too (a null id is hashed as the empty text); with no training document all
symbols are equally likely; other columns are ignored. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, blocks_for, chunks, stored, whole_text

ORDER = 4
#: No byte of UTF-8: the pads before a text and its end.
END = 0xFF
#: The word that ends a text; no word has white space.
LAST = b"\n"
WORD, STRING = 0, 1


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word) - 2**63
        return h


def strings(text: bytes) -> np.ndarray:
    """The ORDER + 1 bytes up to each byte of the text and up to its end, as numbers."""
    data = np.frombuffer(bytes([END]) * ORDER + text + bytes([END]), np.uint8)
    n = len(data) - ORDER
    code = np.zeros(n, np.int64)
    for j in range(ORDER + 1):
        code = code << 8 | data[j : j + n]
    return code


def merged_counts(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([np.zeros(0, np.int64), *(k for k, _ in held)]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([np.zeros(0, np.int64), *(n for _, n in held)]), len(keys)).astype(np.int64)


def packed(docs: DataFrame, chunk_bytes: int = 16 << 20) -> DataFrame:
    """block, rows: the documents of each chunk and block as one compressed Arrow stream; texts shuffle at a third of their size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", chunk_bytes):
            block = chunk.column("block").to_numpy()
            chunk = chunk.select(["doc_id", "learns", "text"])
            numbers, streams = np.unique(block), []
            for number in numbers.tolist():
                own, sink = chunk.take(pa.array(np.flatnonzero(block == number))), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_table(own.combine_chunks())
                streams.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(numbers.astype(np.int32)), pa.array(streams, pa.binary())], ["block", "rows"])

    return docs.select("block", "doc_id", "learns", "text").mapInArrow(run, "block int, rows binary")


def unpacked(table: pa.Table) -> Iterator[pa.Table]:
    for stream in table.column("rows"):
        yield pa.ipc.open_stream(stream.as_buffer()).read_all()


def block_words(tables: Iterable[pa.Table]) -> Iterator[tuple[int | None, bool, bytes, np.ndarray]]:
    """id, whether it trains, text and word hashes of each of a block's documents."""
    known = Hashes()
    for table in tables:
        for doc, learns, text in zip(*(table.column(c) for c in ("doc_id", "learns", "text")), strict=True):
            text = text.as_py().encode().translate(LOWER)
            words = text.split()
            words.append(LAST)
            yield doc.as_py(), learns.as_py(), text, np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def named(table: pa.Table) -> pa.Table:
    """A block's distinct words and strings, with their counts in its training documents."""
    held: dict[int, list] = {WORD: [], STRING: []}
    waiting: dict[tuple[int, bool], list[np.ndarray]] = {(k, l): [] for k in held for l in (False, True)}
    size = 0

    def fold() -> None:
        for (kind, learns), parts in waiting.items():
            keys, n = np.unique(np.concatenate([np.zeros(0, np.int64), *parts]), return_counts=True)
            held[kind].append((keys, n if learns else np.zeros(len(keys), np.int64)))
            parts.clear()
        for kind in held:
            held[kind] = [merged_counts(held[kind])]

    for _, learns, text, words in block_words(unpacked(table)):
        waiting[WORD, learns].append(words)
        waiting[STRING, learns].append(strings(text))
        size += len(text)
        if size > 3 << 20:
            fold()
            size = 0
    fold()
    block = table.column("block")[0].as_py()
    parts = [(kind, *held[kind][0]) for kind in held]
    n = sum(len(k) for _, k, _ in parts)
    return pa.table({"block": pa.array(np.full(n, block, np.int32)), "kind": pa.array(np.concatenate([np.full(len(k), kind, np.int8) for kind, k, _ in parts])), "key": pa.array(np.concatenate([k for _, k, _ in parts])), "n": pa.array(np.concatenate([c for _, _, c in parts]))})


def word_totals(words: DataFrame) -> DataFrame:
    """block, key, total of the words that several blocks have; and in rows without a block, sums over the rest:
    total (of all training tokens) and key (how many distinct words they are). words: block, key, n."""

    names = ["block", "key", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = v = 0
        last = np.zeros((0, 3), np.int64)  # the rows of the word that may go on in the next batch
        for batch in chain(batches, [None]):
            rows = last if batch is None else np.concatenate([last, np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], 1)])
            if not len(rows):
                continue
            cut = len(rows) if batch is None else int(np.searchsorted(rows[:, 1], rows[-1, 1]))
            rows, last = rows[:cut], rows[cut:]
            if not cut:
                continue
            first = np.flatnonzero(np.concatenate([[True], rows[1:, 1] != rows[:-1, 1]]))
            totals, sizes = np.add.reduceat(rows[:, 2], first), np.diff(np.append(first, cut))
            n, v = n + int(totals.sum()), v + int((totals > 0).sum())
            several = np.repeat(sizes > 1, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(rows[several, 0].astype(np.int32)), pa.array(rows[several, 1]), pa.array(np.repeat(totals, sizes)[several])], names)
        if v or n:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.array([v], pa.int64()), pa.array([n], pa.int64())], names)

    # A word has at most one row for each block; a task holds those of one word at a time.
    return words.select("block", "key", "n").repartition("key").sortWithinPartitions("key").mapInArrow(run, "block int, key bigint, total bigint")


class Level:
    """The nodes of one order: per context the total and number of its symbols; per string its count."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int):
        """codes: strings of at least order + 1 bytes, with counts above zero."""
        self.order = order
        self.codes, self.counts = merged_counts([(codes & ((1 << 8 * (order + 1)) - 1), counts)])
        self.contexts, where = np.unique(self.codes >> 8, return_inverse=True)
        self.total = np.bincount(where, self.counts, len(self.contexts))
        self.symbols = np.bincount(where, minlength=len(self.contexts))
        self.below = np.zeros(len(self.contexts))  # what the next shorter context counts for these symbols
        self.where = where

    def over(self, shorter: Level) -> Level:
        at = np.searchsorted(shorter.codes, self.codes & ((1 << 8 * self.order) - 1)) if self.order else None
        self.below = np.bincount(self.where, shorter.counts[at], len(self.contexts))
        return self

    @staticmethod
    def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Places of the keys in the sorted table, -1 where they are not."""
        if not len(table):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, at, -1)


def log_probabilities(codes: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 of the last byte's probability in each string; levels from the longest to order zero."""
    out = np.zeros(len(codes))
    open_ = np.ones(len(codes), bool)
    shut = np.zeros(len(codes))  # symbols that the longer context excludes, and their total in this one
    less = np.zeros(len(codes))
    for level in levels:
        own = codes & ((1 << 8 * (level.order + 1)) - 1)
        node = level.find(level.contexts, own >> 8)
        seen = open_ & (node >= 0)
        total = np.where(seen, level.total[node] if len(level.total) else 0, 0) - less
        kinds = np.where(seen, level.symbols[node] if len(level.total) else 0, 0) - shut
        place = level.find(level.codes, own)
        usable = seen & (kinds > 0)
        hit = usable & (place >= 0)
        out[hit] += np.log10((2 * level.counts[place[hit]] - 1) / (2 * total[hit]))
        open_ &= ~hit
        missed = usable & ~hit
        out[missed] += np.log10(kinds[missed] / (2 * total[missed]))
        shut = np.where(seen, level.symbols[node] if len(level.total) else 0, 0)
        less = np.where(seen, level.below[node] if len(level.total) else 0, 0)
    out[open_] -= np.log10(256 - shut[open_])
    return out


def modelled(counted: DataFrame) -> DataFrame:
    """key, value: the log10 probability of every string. counted has key, n over the whole corpus."""
    pairs = counted.where("n > 0").groupBy(F.col("key").bitwiseAND(0xFFFF).alias("pair")).agg(F.sum("n").alias("n")).collect()  # 65,536 rows at most
    low = np.array([r["pair"] for r in pairs], np.int64), np.array([r["n"] for r in pairs], np.int64)

    def by_ending(table: pa.Table) -> pa.Table:
        codes, n = table.column("key").to_numpy(), table.column("n").to_numpy()
        some = n > 0
        levels = [Level(*low, 0)]
        levels.append(Level(*low, 1).over(levels[0]))
        for order in range(2, ORDER + 1):
            level = Level(codes[some], n[some], order)
            # Of the strings here, the shorter level holds all with the same last two context bytes.
            levels.append(level.over(levels[-1]))
        return pa.table({"key": pa.array(codes), "value": pa.array(log_probabilities(codes, levels[::-1]))})

    ending = F.shiftright("key", 8).bitwiseAND(0xFFFF)
    return counted.groupBy(ending.alias("ending")).applyInArrow(by_ending, "key bigint, value double")


RESULT = "doc_id bigint, learns boolean, n_tokens bigint, n_known bigint, logs double, score double"


def scored(docs: pa.Table, found: pa.Table) -> pa.Table:
    """The sums of a block's documents. found: kind, key, value of its strings, and of its words that other blocks have too."""
    own = list(block_words(unpacked(docs)))
    # The counts of the block's own words are its own training documents', but for those that were found elsewhere too.
    words = np.unique(np.concatenate([w for *_, w in own]))
    counts = np.zeros(len(words))
    for _, learns, _, w in own:
        if learns:
            np.add.at(counts, np.searchsorted(words, w), 1)
    kind, key, value = (found.column(c).to_numpy() for c in ("kind", "key", "value"))
    counts[np.searchsorted(words, key[kind == WORD])] = value[kind == WORD]
    logs = np.log10(counts + 0.5)
    codes, chances = key[kind == STRING], value[kind == STRING]
    order = np.argsort(codes)
    codes, chances = codes[order], chances[order]
    rows = []
    for doc, learns, text, w in own:
        at = np.searchsorted(words, w)
        # Order doesn't matter in a sum, and sorted strings are found faster.
        place = np.searchsorted(codes, np.sort(strings(text)))
        rows.append((doc, learns, len(w), int((counts[at] > 0).sum()), float(logs[at].sum()), float(chances[place].sum())))
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "learns", "n_tokens", "n_known", "logs", "score"])


def score(docs: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 28 << 20) -> DataFrame:
    """doc_id, learns, n_tokens, n_known, train_tokens, base_score, score of each row; learns tells which rows train."""
    own = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(learns, F.lit(False)).alias("learns"), whole_text(text_col).alias("text"))
    blocks = blocks_for(own, "text", block_bytes)
    dealt = packed(own.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")))
    asked = stored(dealt.groupBy("block").applyInArrow(named, "block int, kind tinyint, key bigint, n bigint"), "asked")
    words = stored(word_totals(asked.where(f"kind = {WORD}")), "words")
    totals = words.where("block IS NULL").agg(F.sum("total").alias("n"), F.sum("key").alias("v")).first()
    n, v = totals["n"] or 0, totals["v"] or 0
    word_rows = words.where("block IS NOT NULL").select("block", F.lit(WORD).cast("tinyint").alias("kind"), "key", F.col("total").cast("double").alias("value"))
    texts = asked.where(f"kind = {STRING}").select("block", "key", "n")
    model = modelled(stored(texts.groupBy("key").agg(F.sum("n").alias("n")), "strings"))
    string_rows = texts.join(model, "key").select("block", F.lit(STRING).cast("tinyint").alias("kind"), "key", "value")
    found = word_rows.union(string_rows)
    sums = dealt.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(scored, RESULT)
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.lit(n + 0.5 * (v + 1)))
    return sums.select("doc_id", "learns", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score")
