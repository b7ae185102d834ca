"""Quality rules: fixed counts with limits, and a calibrated classifier over hashed n-grams.

The classifier is a logistic regression over the relative frequencies of hashed words, word pairs
and character n-grams. It learns from a bounded sample of labelled rows (`train_rows`, by hash order),
is calibrated by Platt's method on a held-out fifth of each kind (on all of them where that is fewer
than ten), and scores every whole text in Arrow batches against a fixed threshold. Only the weights
(`2 ** bits` floats) go through the driver.

Defined results: a null or empty text has no words and fails the base rules; repeated rows and
null ids are scored like any others; labels that are null or of no document are ignored; without
labels of both kinds, or where the margin does not tell them apart, the classifier has no say. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, whole_text

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Odd multipliers that mix hashes (the golden ratio's bits and well-known finalisers).
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))
MIX32, STEP32 = np.uint32(0x85EBCA6B), np.uint32(0x9E3779B1)
LOSS_STEPS = 100
NEWTON_STEPS = 100
#: Labels of a kind set aside, below which calibration takes the rows that the weights come from.
LEAST_HELD = 10
#: Texts that become features, and entries of those that are summed up, at a time.
FEW, SLICE = 32, 1 << 20


class Hashes(dict):
    """Numbers byte words as they are met and keeps a hash of each."""

    def __init__(self) -> None:
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return n


def bucket(values: np.ndarray, bits: int) -> np.ndarray:
    return ((values ^ values >> np.uint64(29)) * MIX[1] >> np.uint64(64 - bits)).astype(np.int64)


def features(texts: list[str], bits: int, chars: int) -> tuple[list[np.ndarray], Hashes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers per text; the words; buckets of words and word pairs, of character n-grams; and where each text's begin."""
    words = Hashes()
    ids = [np.fromiter(map(words.__getitem__, own := t.encode().split()), np.int64, len(own)) for t in texts]
    hashed = np.array(words.hashes, np.uint64)
    parts, word_cuts = [], [0]
    for own in ids:
        h = hashed[own]
        parts += [bucket(h, bits), bucket(h[:-1] * MIX[0] + h[1:], bits)] if len(h) else []
        word_cuts.append(word_cuts[-1] + max(0, 2 * len(h) - 1))
    data = np.frombuffer(("".join(texts) + "\0" * chars).encode("utf-32-le"), np.uint32)
    code = np.zeros(len(data) - chars, np.uint32)
    for j in range(chars):
        code = code * STEP32 + data[j : len(data) - chars + j]
    code = (code ^ code >> np.uint32(15)) * MIX32
    code = (code ^ code >> np.uint32(13)) * MIX32 >> np.uint32(32 - bits)
    cuts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return ids, words, np.concatenate([*parts, np.zeros(0, np.int64)]), np.array(word_cuts), code.astype(np.int32), cuts


def mean_of(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return (total[ends] - total[begins]) / np.maximum(ends - begins, 1)


def margins(weights: np.ndarray, words: np.ndarray, word_cuts: np.ndarray, grams: np.ndarray, cuts: np.ndarray, chars: int) -> np.ndarray:
    """The linear score of each text, the intercept (the last weight) left out."""
    ends = np.maximum(cuts[1:] - chars + 1, cuts[:-1])  # n-grams lie within a text
    return mean_of(weights[words], word_cuts[:-1], word_cuts[1:]) + mean_of(weights[grams], cuts[:-1], ends)


def sparse(text: str, bits: int, chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and relative frequencies of a text, those of words and pairs apart from those of n-grams: at most
    2 ** (bits + 1) entries, however long it is."""
    _, _, words, _, grams, _ = features([text], bits, chars)
    cols, values = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
    for of in (words, grams[: max(0, len(text) - chars + 1)]):
        if len(of):
            c, n = np.unique(of, return_counts=True)
            cols.append(c.astype(np.int32))
            values.append((n / len(of)).astype(np.float32))
    return np.concatenate(cols), np.concatenate(values)


def set_aside(good: np.ndarray, order: np.ndarray) -> np.ndarray:
    """A fifth of each kind, the first by order, for calibration; none where a kind has fewer than LEAST_HELD then."""
    held = np.zeros(len(good), bool)
    for kind in (good, ~good):
        rows = np.flatnonzero(kind)
        held[rows[np.argsort(order[rows], kind="stable")][: len(rows) // 5]] = True
    return held if min((good & held).sum(), (~good & held).sum()) >= LEAST_HELD else np.zeros(len(good), bool)


def calibrated(z: np.ndarray, y: np.ndarray, even: bool = False) -> tuple[float, float]:
    """Platt's slope and offset: Newton's steps, halved until the loss falls, on margins brought to unit spread. A
    slope below zero would turn verdicts round; it is held at zero, where the margin has no say.

    even: both kinds weigh the same, as in the loss that the weights come from; for rows that these come from."""
    middle, spread = float(np.median(z)), max(float(z.std()), 1e-9)
    x = np.stack([np.clip((z - middle) / spread, -30, 30), np.ones(len(z))])
    kinds = np.array([(~y).sum(), y.sum()])
    target = np.where(y, (kinds[1] + 1) / (kinds[1] + 2), 1 / (kinds[0] + 2))  # Platt's smoothed targets
    share = np.ones(len(z))
    if even:
        target, share = np.where(y, 1 - 1 / (kinds.min() + 2), 1 / (kinds.min() + 2)), len(y) / 2 / kinds[y.astype(int)]
    start = np.array([1.0, 0.0])
    loss = lambda w: float((share * (np.logaddexp(0, m := w @ x) - target * m)).sum() + 5e-4 * ((w - start) ** 2).sum())
    now, least = start, loss(start)
    for _ in range(NEWTON_STEPS):
        p = 1 / (1 + np.exp(-np.clip(now @ x, -500, 500)))
        slope = x @ (share * (p - target)) + 1e-3 * (now - start)
        step = np.linalg.solve((x * (share * p * (1 - p))) @ x.T + 1e-3 * np.eye(2), slope)
        size = 1.0
        while size > 1e-6 and loss(now - size * step) > least - 1e-4 * size * float(slope @ step):
            size /= 2
        if size <= 1e-6 or least - loss(now - size * step) < 1e-10:
            break
        now = now - size * step
        least = loss(now)
    if now[0] <= 0:
        return 0.0, 0.0
    return float(now[0] / spread), float(now[1] - now[0] * middle / spread)


def trained(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, order: np.ndarray, bits: int) -> np.ndarray:
    """Weights, intercept, and Platt's slope and offset, from texts by sparse(); order tells which are set aside. Empties rows."""
    n = len(rows)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(c) for c, _ in rows])
    col, value = np.concatenate([c for c, _ in rows]), np.concatenate([v for _, v in rows])
    rows.clear()
    slices = [slice(at, at + SLICE) for at in range(0, len(row), SLICE)]

    def margins_of(weights: np.ndarray) -> np.ndarray:
        return sum((np.bincount(row[s], weights[col[s]] * value[s], n) for s in slices), np.zeros(n))

    def gradient(error: np.ndarray) -> np.ndarray:
        return sum((np.bincount(col[s], error[row[s]] * value[s], 1 << bits) for s in slices), np.zeros(1 << bits))

    held = set_aside(good, order)
    fit = ~held
    share = np.where(good, 0.5 / max(1, (good & fit).sum()), 0.5 / max(1, (~good & fit).sum())) * fit
    weights, intercept = np.zeros(1 << bits, np.float32), 0.0
    seen, seen0 = np.full(1 << bits, 1e-8, np.float32), 1e-8
    for _ in range(LOSS_STEPS):  # Adagrad on the balanced logistic loss
        z = margins_of(weights) + intercept
        error = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - good)
        step = (gradient(error.astype(np.float32)) + 1e-7 * weights).astype(np.float32)
        seen += step * step
        seen0 += error.sum() ** 2
        weights -= 2.0 * step / np.sqrt(seen)
        intercept -= 0.2 * error.sum() / np.sqrt(seen0)
    z = margins_of(weights) + intercept
    use = held if held.any() else fit
    return np.concatenate([weights, [intercept, *calibrated(z[use], good[use], not held.any())]])


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = 2000, bits: int = 17, chars: int = 4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> bytes | None:
    """The model as bytes; None without labels of both kinds. The sample has train_rows labelled rows, the first by hash of id.

    Texts become sparse frequencies where they are; only those, of bounded size a text, meet in the task that learns.
    """
    sample = labels.select(labels[id_col].cast("bigint").alias("doc_id"), labels[label_col].cast("int").alias("good")).where("doc_id IS NOT NULL AND good IN (0, 1)").orderBy(F.xxhash64("doc_id"), "doc_id", "good").limit(train_rows)
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), whole_text(text_col).alias("text")).join(F.broadcast(sample), "doc_id")
    # Rows that repeat an id could make the sample grow again; each label is used with its first text.
    rows = rows.groupBy("doc_id", "good").agg(F.min("text").alias("text"))

    def featurised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, FEW):
                b = whole.slice(at, FEW)
                own = [sparse(t, bits, chars) for t in b.column("text").to_pylist()]
                # First differences of the sorted buckets and few unlike shares: a fraction of their size when compressed.
                packed = [pa.compress(np.diff(c, prepend=np.int32(0)).tobytes() + v.tobytes(), "zstd", asbytes=True) for c, v in own]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("good"), pa.array([len(c) for c, _ in own], pa.int32()), pa.array(packed, pa.binary())], ["doc_id", "good", "n", "packed"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for b in batches:
            for doc, kind, n, packed in zip(b.column("doc_id").to_pylist(), b.column("good").to_pylist(), b.column("n").to_pylist(), b.column("packed"), strict=True):
                raw = pa.decompress(packed.as_buffer(), 8 * n, "zstd") if n else b""
                got.append((doc, kind, np.cumsum(np.frombuffer(raw, np.int32, n), dtype=np.int32), np.frombuffer(raw, np.float32, n, 4 * n).copy()))
        got.sort(key=lambda x: x[:2])
        good = np.array([x[1] == 1 for x in got], bool)
        if len(set(good.tolist())) < 2:
            return
        order = np.array([xxhash.xxh3_64_intdigest(str(x[0])) for x in got], np.uint64)
        rows_ = [x[2:] for x in got]
        got.clear()
        model = trained(rows_, good, order, bits)
        yield pa.RecordBatch.from_arrays([pa.array([model.astype(np.float32).tobytes()], pa.binary())], ["model"])

    own = rows.mapInArrow(featurised, "doc_id bigint, good int, n int, packed binary")
    found = own.repartition(1).mapInArrow(learn, "model binary").collect()
    return bytes(found[0]["model"]) if found else None


def repeats(ids: np.ndarray) -> int:
    """Words in windows of three that are found twice or more."""
    if len(ids) < 4:
        return 0
    n = int(ids.max()) + 1
    if n < 1 << 21:
        code = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:
        _, pair = np.unique(ids[:-2] * n + ids[1:-1], return_inverse=True)
        code = pair.astype(np.int64) * n + ids[2:]
    ranked = np.sort(code)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(code, twice)
    covered = np.zeros(len(ids), bool)
    for j in range(3):
        covered[j : len(ids) - 2 + j] |= hit
    return int(covered.sum())


RESULT = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, probability double, kept boolean"


def judged(model: bytes | None, docs: DataFrame, bits: int, chars: int, threshold: float, id_col: str, text_col: str, carried: list[str], chunk_bytes: int) -> DataFrame:
    """The counts and verdict of every row, with the carried columns unread beside them."""
    plain = docs.select(docs[id_col].cast("bigint").alias("_id"), whole_text(text_col).alias("_text"), *[docs[c].alias(f"_c{i}") for i, c in enumerate(carried)])
    extra = "".join(f", _c{i} {plain.schema[f'_c{i}'].dataType.simpleString()}" for i in range(len(carried)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = np.frombuffer(model, np.float32) if model else None
        for chunk in chunks(batches, "_text", chunk_bytes):
            texts = [t for b in chunk.column("_text").chunks for t in b.to_pylist()]
            data = [t.encode() for t in texts]
            ids, _, words, word_cuts, grams, cuts = features(texts, bits, chars)
            if learned is not None:
                z = margins(learned, words, word_cuts, grams, cuts, chars) + learned[-3]
                chance = 1 / (1 + np.exp(-np.clip(learned[-2] * z + learned[-1], -30, 30)))
            else:
                chance = np.ones(len(texts))
            rows = []
            for text, raw, own in zip(texts, data, ids, strict=True):
                lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
                rows.append((len(own), len(text) - len(raw) + len(raw.translate(None, SPACE)), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeats(own)))
            n = np.array(rows, np.int64).reshape(-1, 5)
            failed = (n[:, 0] < 50) | (100 * n[:, 4] > 50 * n[:, 0])
            columns = [chunk.column("_id").combine_chunks(), *(pa.array(n[:, j]) for j in range(5)), pa.array(failed), pa.array(chance), pa.array(~failed & (chance >= threshold)), *(chunk.column(f"_c{i}").combine_chunks() for i in range(len(carried)))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept", *(f"_c{i}" for i in range(len(carried)))])

    return plain.mapInArrow(run, RESULT + extra)


def assess(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, train_rows: int = 2000, bits: int = 17, chars: int = 4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", chunk_bytes: int = 4 << 20) -> DataFrame:
    """One row per document with its counts, probability and verdict."""
    model = fit(docs, labels, train_rows, bits, chars, id_col, text_col, label_col)
    return judged(model, docs, bits, chars, threshold, id_col, text_col, [], chunk_bytes)


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, train_rows: int = 2000, bits: int = 17, chars: int = 4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", chunk_bytes: int = 4 << 20) -> DataFrame:
    """The documents that pass, all columns as they were."""
    model = fit(docs, labels, train_rows, bits, chars, id_col, text_col, label_col)
    found = judged(model, docs, bits, chars, threshold, id_col, text_col, docs.columns, chunk_bytes)
    return found.where("kept").select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
