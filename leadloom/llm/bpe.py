"""Byte-level BPE by corpus-level merge replay.

The distinct words of a chunk of documents lie in one symbol array. An inverted index leads from
each rank to the positions whose pair merges at that rank; ranks are replayed in order, every
merge is applied to all its positions at once, and only the neighbours of merged positions get
new index entries. Documents are then the concatenation of their words' ids.

Defined results: a null or empty text has no ids; rows are independent, so repeated rows, null
ids and empty tables need no special care; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, whole_text
from .tokens import Words, vocabulary

NEVER = np.int32(2**31 - 1)


class Merges:
    """The pairs of a rank file: which two tokens make which, and the bytes of each."""

    def __init__(self, file: str):
        with open(file, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = {i: t for t, i in self.rank.items()}
        pairs = {}
        for token, i in self.rank.items():
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = i
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.first = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NEVER if it doesn't merge."""
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], NEVER)

    def alone(self, word: bytes) -> list[int]:
        """One word by itself, lowest rank and then leftmost first."""
        ids, n = [int(self.first[b]) for b in word], len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = lambda i: self.pairs.get(ids[i] << 20 | ids[after[i]]) if after[i] < n else None
        queue = [(r, i) for i in range(n) if (r := pair(i)) is not None]
        heapq.heapify(queue)
        while queue:
            made, i = heapq.heappop(queue)
            if ids[i] < 0 or pair(i) != made:
                continue
            gone = after[i]
            ids[i], ids[gone], after[i] = made, -1, after[gone]
            if after[i] < n:
                before[after[i]] = i
            for j in (before[i], i):
                if j >= 0 and (r := pair(j)) is not None:
                    heapq.heappush(queue, (r, j))
        return [x for x in ids if x >= 0]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and where each word's begin (one more entry than words)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate([[0], np.cumsum(lengths)])
        n = int(starts[-1])
        if not n:
            return np.zeros(0, np.int32), starts
        token = self.first[np.frombuffer(b"".join(words), np.uint8)]
        after = np.arange(1, n + 1, dtype=np.int64)
        after[starts[1:][lengths > 0] - 1] = -1
        before = np.arange(-1, n - 1, dtype=np.int64)
        before[starts[:-1][lengths > 0]] = -1
        rank = np.full(n, NEVER, np.int32)
        inner = np.flatnonzero(after >= 0)
        rank[inner] = self.of_pairs(token[inner], token[inner + 1])
        index = inner[rank[inner] != NEVER]
        index = index[np.argsort(rank[index], kind="stable")]
        ranks, begins = np.unique(rank[index], return_index=True)
        ends = np.append(begins[1:], len(index))
        first = dict(zip(ranks.tolist(), zip(begins.tolist(), ends.tolist(), strict=True), strict=True))
        later: dict[int, list[int]] = defaultdict(list)
        queue = ranks.tolist()  # sorted, so already a heap
        odd: list[np.ndarray] = []
        while queue:
            now = heapq.heappop(queue)
            at = index[slice(*first.pop(now, (0, 0)))]
            if now in later:
                at = np.unique(np.concatenate([at, np.array(later.pop(now), np.int64)]))
            at = at[rank[at] == now]
            if not len(at):
                continue
            if len(at) > 1:  # of overlapping pairs, the leftmost goes first
                touch = after[at[:-1]] == at[1:]
                if touch.any():
                    place = np.arange(len(at))
                    run = np.maximum.accumulate(np.where(np.concatenate([[True], ~touch]), place, 0))
                    at = at[(place - run) % 2 == 0]
            gone = after[at]
            right = after[gone]
            token[at] = now
            after[at] = right
            rank[gone] = NEVER
            linked = right >= 0
            before[right[linked]] = at[linked]
            rank[at] = NEVER
            rank[at[linked]] = self.of_pairs(token[at[linked]], token[right[linked]])
            left = before[at]
            left = left[left >= 0]
            rank[left] = self.of_pairs(token[left], token[after[left]])
            fresh = np.concatenate([at[linked], left])
            of_fresh = rank[fresh]
            keep = of_fresh != NEVER
            fresh, of_fresh = fresh[keep], of_fresh[keep]
            if (of_fresh <= now).any():  # a pair that should have gone first: those words are done one by one
                odd.append(fresh[of_fresh <= now])
            for r, p in zip(of_fresh.tolist(), fresh.tolist(), strict=True):
                if r not in later:
                    if r not in first:
                        heapq.heappush(queue, r)
                    later[r].append(p)
                else:
                    later[r].append(p)
            after[gone] = -2
        alive = after != -2
        ids, cuts = token[alive], np.concatenate([[0], np.cumsum(alive)])[starts]
        if odd:
            wrong = np.unique(np.searchsorted(starts, np.concatenate(odd), "right") - 1)
            pieces = np.split(ids, cuts[1:-1])
            for w in wrong.tolist():
                pieces[w] = np.array(self.alone(words[w]), np.int32)
            ids, cuts = np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        return ids, cuts


@lru_cache(maxsize=2)
def merges(file: str) -> Merges:
    return Merges(file)


RESULT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 24 << 20) -> DataFrame:
    """Per document: the number of ids, the digest of the ids and of the bytes decoded from them.

    No shuffle: each task replays the merges over the distinct words of chunk_bytes of text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merges(vocabulary(ranks, "byte_bpe_50k.tiktoken"))
        for chunk in chunks(batches, "text", chunk_bytes):
            words = Words()
            docs_words = [words.of(t) for b in chunk.column("text").chunks for t in b.to_pylist()]
            listed, pieces = words.words()
            ids, cuts = table.replay([w.encode() for w in listed])
            as_text, decoded, sizes = [], [], []
            ends = cuts.tolist()
            flat = ids.tolist()
            for piece in pieces:
                own = [i for k in piece for i in flat[ends[k] : ends[k + 1]]]
                as_text.append("".join(f"{i} " for i in own).encode())
                decoded.append(b"".join(map(table.bytes.__getitem__, own)))
                sizes.append(len(own))
            counts = np.array(sizes, np.int64)
            n, hashed, back = [], [], []
            for own in docs_words:
                n.append(int(counts[own].sum()))
                own = own.tolist()
                hashed.append(hashlib.sha256(b"".join(map(as_text.__getitem__, own))[:-1]).hexdigest())
                back.append(hashlib.sha256(b"".join(map(decoded.__getitem__, own))).hexdigest())
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id").combine_chunks(), pa.array(n, pa.int64()), pa.array(hashed), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, RESULT)


def encode(docs: DataFrame, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 24 << 20) -> DataFrame:
    """The ids themselves: doc_id, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merges(vocabulary(ranks, "byte_bpe_50k.tiktoken"))
        for chunk in chunks(batches, "text", chunk_bytes):
            words = Words()
            docs_words = [words.of(t) for b in chunk.column("text").chunks for t in b.to_pylist()]
            listed, pieces = words.words()
            ids, cuts = table.replay([w.encode() for w in listed])
            coded = [np.concatenate([ids[:0], *(ids[cuts[k] : cuts[k + 1]] for k in piece)]) for piece in pieces]
            out = [np.concatenate([coded[w] for w in own.tolist()]) for own in docs_words]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id").combine_chunks(), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, text of what encode() made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merges(vocabulary(ranks, "byte_bpe_50k.tiktoken"))
        for batch in batches:
            texts = [b"".join(map(table.bytes.__getitem__, ids or [])).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
