"""Personal data: exact patterns, and a skip-chain conditional random field that adds what they miss.

Nodes are the tokens of a document that hold a digit or an at sign. Neighbouring nodes share
chain potentials; tokens with the same digits or the same text share skip potentials with their
first occurrence, however far. The field learns from the patterns' own spans on a
bounded sample (`train_rows`) by pseudo-likelihood; tokens under a match that a check dropped
count as unobserved, so that what glued neighbours hide is left to the field. Loopy message
passing, until it settles, then gives each token's label; neighbouring tokens that are certain of one
label are read together, and a span is added for what they hold, where no base span is. Where a document has no node, there is nothing to infer.

Defined results: a null or empty text has no spans; rows are independent, so repeated rows, null
ids and empty tables need no special care; without spans to learn from, the field adds none.
Other columns are ignored by find() and kept by mask().
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, whole_text

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never starts inside a run of digits, and its runs are whole: the same matches as the
# plain patterns have, without trying a long run from each of its digits.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NODE = re.compile(r"[^\x20\x09-\x0D]+")
DIGIT = re.compile(r"[0-9]")
N_LABELS = len(KINDS) + 1
CERTAIN = 0.9
#: Messages are passed until none moves more than this, or so many times where they swing for ever.
SETTLED, ROUNDS = 1e-3, 200
#: What the field may add, by the field's label alone: looser than the base patterns.
ADDRESS = re.compile(r"[^@\s<>()\[\],;:\"']+@[^@\s<>()\[\],;:\"']*[^\W_]")
QUAD = re.compile(r"(?<![0-9])(?=([0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9]))")
NUMBER = re.compile(r"\+?\(?[0-9](?:[().0-9\s-]*[0-9])?")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern, led by the at signs, so in one pass."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := HOST.match(text, at + 1)):
            end = m.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(kind, start, end) of the base patterns, by kind and start; and the matches that a check dropped."""
    spans, dropped = [], []
    if "@" in text:
        spans += [(0, a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                spans.append((1, *m.span()))
            else:
                dropped.append(m.span())
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append((2, *m.span()))
            elif len(digits) >= 16:
                dropped.append(m.span())
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    spans.append((3, *m.span()))
                else:
                    dropped.append(m.span())
    return spans, dropped


def shape(token: str, before: str) -> list[int]:
    """The features of a token, by number."""
    digits = "".join(c for c in token if c in "0123456789")
    n, parts = len(digits), token.strip(".,;:!?()[]\"'|").split(".")
    core = token.strip(".,;:!?()[]\"'|*#$%&")
    found = [0, 1 + min(n, 20)]
    tests = (
        "@" in token,
        bool(emails(token)),
        len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts),
        core == digits and 16 <= n <= 19,
        core == digits and 16 <= n <= 19 and luhn(digits),
        token.startswith("+"),
        token.startswith("("),
        "-" in token,
        any(c.isalpha() for c in token),
        before.startswith("+"),
        before.startswith("("),
        core == digits,
    )
    return found + [22 + i for i, x in enumerate(tests) if x]


N_FEATURES = 22 + 12


class Field:
    """The nodes and edges of a chunk of texts."""

    def __init__(self, texts: list[str]):
        self.at: list[tuple[int, int, int]] = []  # text, start, end
        self.shapes: list[list[int]] = []
        chain, skip = [], []
        for i, text in enumerate(texts):
            if "@" not in text and not DIGIT.search(text):
                continue
            first: dict[str, int] = {}
            previous, number, before = -9, 0, ""
            for number, m in enumerate(NODE.finditer(text)):
                token = m[0]
                if "@" in token or DIGIT.search(token):
                    node = len(self.at)
                    self.at.append((i, *m.span()))
                    self.shapes.append(shape(token, before))
                    if previous == number - 1:
                        chain.append((node - 1, node))
                    digits = "".join(c for c in token if c in "0123456789")
                    key = digits if len(digits) >= 7 else token.lower()
                    if key in first:
                        skip.append((first[key], node))
                    else:
                        first[key] = node
                    previous = number
                before = token
        self.chain, self.skip = (np.array(x, np.int64).reshape(-1, 2) for x in (chain, skip))
        lengths = [len(s) for s in self.shapes]
        self.rows = np.repeat(np.arange(len(lengths)), lengths)
        self.cols = np.array([f for s in self.shapes for f in s], np.int64)

    def observed(self, spans: list[tuple[list, list]]) -> np.ndarray:
        """Each node's label by the base spans (0 is none), -1 if under a dropped match only."""
        label = np.zeros(len(self.at), np.int64)
        for n, (i, a, b) in enumerate(self.at):
            own, dropped = spans[i]
            hit = next((k for k, s, e in own if s < b and a < e), None)
            label[n] = hit + 1 if hit is not None else -1 if any(s < b and a < e for s, e in dropped) else 0
        return label

    def evidence(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.at), N_LABELS))
        np.add.at(out, self.rows, weights[self.cols])
        return out


def learned(field: Field, label: np.ndarray) -> np.ndarray:
    """Weights by pseudo-likelihood: evidence, chain and skip potentials, one array."""
    seen = label >= 0
    weights, chain, skip = np.zeros((N_FEATURES, N_LABELS)), np.zeros((N_LABELS, N_LABELS)), np.zeros((N_LABELS, N_LABELS))
    sums = [np.full(x.shape, 1e-6) for x in (weights, chain, skip)]
    target = np.eye(N_LABELS)[np.maximum(label, 0)]
    pairs = [e[seen[e].all(axis=1)] if len(e) else e for e in (field.chain, field.skip)]
    for _ in range(300):
        z = field.evidence(weights)
        for e, w in zip(pairs, (chain, skip), strict=True):
            if len(e):
                np.add.at(z, e[:, 1], w[label[e[:, 0]]])
                np.add.at(z, e[:, 0], w[:, label[e[:, 1]]].T)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        error = (p / p.sum(axis=1, keepdims=True) - target) * seen[:, None]
        steps = [np.zeros(x.shape) for x in (weights, chain, skip)]
        np.add.at(steps[0], field.cols, error[field.rows])
        for e, g in zip(pairs, steps[1:], strict=True):
            if len(e):
                np.add.at(g, label[e[:, 0]], error[e[:, 1]])
                np.add.at(g.T, label[e[:, 1]], error[e[:, 0]])
        for x, g, s in zip((weights, chain, skip), steps, sums, strict=True):
            g += 0.01 * x
            s += g * g
            x -= 0.5 * g / np.sqrt(s)
    return np.concatenate([weights.ravel(), chain.ravel(), skip.ravel()])


def marginals(field: Field, model: np.ndarray) -> np.ndarray:
    """Each node's label probabilities after loopy sum-product passing along chain and skip edges."""
    own = field.evidence(model[: N_FEATURES * N_LABELS].reshape(N_FEATURES, N_LABELS))
    chain, skip = model[N_FEATURES * N_LABELS :].reshape(2, N_LABELS, N_LABELS)
    edges = np.concatenate([field.chain, field.skip])
    table = np.exp(np.concatenate([np.broadcast_to(chain, (len(field.chain), N_LABELS, N_LABELS)), np.broadcast_to(skip, (len(field.skip), N_LABELS, N_LABELS))]))
    forth, back = np.zeros((2, len(edges), N_LABELS))  # log messages to the second and the first end

    def belief() -> np.ndarray:
        z = own.copy()
        np.add.at(z, edges[:, 1], forth)
        np.add.at(z, edges[:, 0], back)
        return z

    def logs(x: np.ndarray) -> np.ndarray:
        x = np.log(np.maximum(x, 1e-300))
        return x - x.max(axis=1, keepdims=True)

    for _ in range(ROUNDS if len(edges) else 0):
        z = belief()
        a, b = z[edges[:, 0]] - back, z[edges[:, 1]] - forth
        a, b = (np.exp(x - x.max(axis=1, keepdims=True)) for x in (a, b))
        new = 0.5 * forth + 0.5 * logs(np.einsum("ei,eij->ej", a, table)), 0.5 * back + 0.5 * logs(np.einsum("ej,eij->ei", b, table))
        moved = max(np.abs(new[0] - forth).max(), np.abs(new[1] - back).max())
        forth, back = new
        if moved < SETTLED:
            break
    z = belief()
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def entity(kind: int, text: str) -> tuple[int, int] | None:
    """Where in the text of a run of tokens the kind's characters are; None if it can't hold one."""
    if kind == 0:
        return m.span() if (m := ADDRESS.search(text)) else None
    if kind == 1:
        return next((m.span(1) for m in QUAD.finditer(text) if all(int(p) < 256 for p in m[1].split("."))), None)
    m = NUMBER.search(text)
    digits = "".join(c for c in m[0] if c in "0123456789") if m else ""
    return m.span() if m and (16 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 8 <= len(digits) <= 15) else None


def decoded(text: str, kind: int, run: list[tuple[int, int]], taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans in a run of neighbouring tokens (start, end) of one kind: from each token the longest stretch that is
    one, addresses token by token; none over a span that is taken."""
    found, i = [], 0
    free = [not any(x < b and a < y for _, x, y in taken) for a, b in run]
    while i < len(run):
        end, n = i, 0
        while end < len(run) and (end == i or kind > 1) and n <= 19 and (free[end] or end == i):
            n += sum(c in "0123456789" for c in text[run[end][0] : run[end][1]])
            end += 1
        for j in range(end, i, -1):
            a = run[i][0]
            inside = entity(kind, text[a : run[j - 1][1]])
            # All tokens of the stretch take part, so that a shorter one isn't hidden by others.
            if inside and (j == i + 1 or a + inside[1] > run[j - 1][0]) and a + inside[0] < run[i][1] and not any(x < a + inside[1] and a + inside[0] < y for _, x, y in taken):
                found.append((kind, a + inside[0], a + inside[1]))
                i = j - 1
                break
        i += 1
    return found


def spans_of(texts: list[str], model: np.ndarray | None) -> list[tuple[list, list]]:
    """Per text: base spans, and those the field adds."""
    base = [base_spans(t) for t in texts]
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if model is not None:
        field = Field(texts)
        if field.at:
            p = marginals(field, model)
            best = p[:, 1:].argmax(axis=1)
            linked = {int(b) for _, b in field.chain}  # nodes right after another
            runs: list[list[int]] = []
            for n in np.flatnonzero(p[np.arange(len(p)), best + 1] >= CERTAIN).tolist():
                if runs and n in linked and runs[-1][-1] == n - 1 and best[n] == best[n - 1]:
                    runs[-1].append(n)
                else:
                    runs.append([n])
            for run in runs:
                i = field.at[run[0]][0]
                added[i] += decoded(texts[i], int(best[run[0]]), [field.at[n][1:] for n in run], base[i][0])
    return [(own, more) for (own, _), more in zip(base, added, strict=True)]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def fit(docs: DataFrame, train_rows: int = 3000, id_col: str = "doc_id", text_col: str = "text") -> bytes | None:
    """The field's weights, learned from train_rows texts that have a node, the first by hash; None if there is none."""
    rows = docs.select(docs[id_col].cast("bigint").alias("i"), whole_text(text_col).alias("t")).where(F.col("t").rlike("[0-9@]")).select("t", F.xxhash64("i", "t").alias("h"))
    # Only hashes are ranked; the texts up to the last of them are few, repeated rows count once.
    last = rows.select("h").orderBy("h").limit(train_rows).agg(F.max("h").alias("h")).first()["h"]
    if last is None:
        return None
    picked = rows.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.min("t").alias("t")).select("t")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t for b in batches for t in b.column("t").to_pylist()]
        field = Field(texts)
        label = field.observed([base_spans(t) for t in texts])
        if (label > 0).any():
            yield pa.RecordBatch.from_arrays([pa.array([learned(field, label).tobytes()], pa.binary())], ["model"])

    found = picked.coalesce(1).mapInArrow(learn, "model binary").collect()
    return bytes(found[0]["model"]) if found else None


RESULT = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"


def find(docs: DataFrame, train_rows: int = 3000, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 8 << 20) -> DataFrame:
    """Per document: the base counts and the digest of the base spans; and all spans."""
    model = fit(docs, train_rows, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.frombuffer(model) if model else None
        for chunk in chunks(batches, "text", chunk_bytes):
            found = spans_of([t for b in chunk.column("text").chunks for t in b.to_pylist()], weights)
            counts = [[sum(k == kind for k, _, _ in own) for own, _ in found] for kind in range(len(KINDS))]
            digests = [hashlib.sha256(written(own).encode()).hexdigest() for own, _ in found]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id").combine_chunks(), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array([written(own + more) for own, more in found], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, RESULT)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans, one mark for all."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{KINDS[kind]}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def mask(docs: DataFrame, train_rows: int = 3000, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 8 << 20) -> DataFrame:
    """The documents with every span masked; a null text stays null, other columns stay as they are."""
    model = fit(docs, train_rows, id_col, text_col)
    place = docs.columns.index(text_col)
    plain = docs.select(*[docs[c].alias(f"_c{i}") for i, c in enumerate(docs.columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.frombuffer(model) if model else None
        for chunk in chunks(batches, f"_c{place}", chunk_bytes):
            texts = [t for b in chunk.column(place).chunks for t in b.to_pylist()]
            found = spans_of([t or "" for t in texts], weights)
            new = [t if t is None else masked(t, own + more) for t, (own, more) in zip(texts, found, strict=True)]
            chunk = chunk.set_column(place, f"_c{place}", pa.array(new, pa.string()))
            yield from chunk.combine_chunks().to_batches()

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
