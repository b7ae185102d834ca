"""The numbered operators against brute force, round trips and held-out rows, with the awkward inputs of their contracts."""

import base64
import collections
import hashlib
import html as escapes
import itertools
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leadloom.llm import bpe, html, jaccard, licenses, lm_scoring, packing, pii, quality, substrings, topk
from leadloom.llm.common import LOWER

random.seed(11)
WORDS = ["".join(random.choice("abcdeéß") for _ in range(random.randint(1, 8))) for _ in range(250)]
SCHEMA = "doc_id bigint, text string, spans string, k bigint, n bigint"


def prose(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


def frame(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    passage, near = prose(70), prose(200)
    out = [(i, prose(random.randint(0, 120))) for i in range(150)]
    out += [(200 + i, prose(random.randint(0, 30)) + " " + passage + " " + prose(random.randint(0, 30))) for i in range(60)]
    for i in range(30):
        words = near.split()
        for _ in range(random.randint(0, 4)):
            words[random.randrange(len(words))] = "changed"
        out.append((300 + i, " ".join(words)))
    out += [(400 + i, "same text of few words") for i in range(20)]
    out += [(500, None), (501, ""), (502, " \n\t "), (503, "one"), (503, "one"), (None, prose(90)), (504, "Orre " * 900), (505, prose(20_000))]
    return out


def texts(rows):
    return [(t or "") for _, t in rows]


def test_bpe_round_trip(spark, rows):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = [(900, "It's 12³ Ⅷ \x1c\x85 　 naïve_x  --  日本語 🎉🎉 <|endoftext|>"), (901, "a" * 5000), (902, "\n\n  \n x")]
    want = collections.Counter()
    for i, t in [*rows, *odd]:
        ids = reference.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    df = frame(spark, [*rows, *odd])
    assert collections.Counter(map(tuple, bpe.encode_decode(df, chunk_bytes=20_000).collect())) == want
    back = bpe.decode(bpe.encode(df)).collect()
    assert collections.Counter((r[0], r[1]) for r in back) == collections.Counter((i, t or "") for i, t in [*rows, *odd])
    assert bpe.encode_decode(frame(spark, [])).count() == 0


def test_bpe_odd_orders():
    table = bpe.merges(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    words = [bytes(random.choice(b" aaabthein.\n0\xc3\xa9") for _ in range(random.randint(0, 30))) for _ in range(500)]
    ids, cuts = table.replay(words)
    assert all(ids[cuts[i] : cuts[i + 1]].tolist() == table.alone(w) for i, w in enumerate(words))
    long_ = bytes(random.choice(b"thein ab.\xc3\xa9") for _ in range(200_000))
    assert b"".join(map(table.bytes.__getitem__, table.alone(long_))) == long_


def test_substrings(spark, rows):
    length = 200
    data = [t.encode() for t in texts(rows)]
    seen = collections.Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    want = collections.Counter()
    for (doc, _), t in zip(rows, data, strict=True):
        gone = np.zeros(len(t) + 2, np.int8)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = 1
        kept = bytes(b for b, g in zip(t, gone[1:], strict=False) if not g)
        want[doc, len(t), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    df = frame(spark, rows)
    assert collections.Counter(map(tuple, substrings.dedup_report(df).collect())) == want
    kept = substrings.dedup(df)
    assert kept.columns == df.columns and kept.count() == len(rows)
    assert substrings.dedup_report(frame(spark, [])).count() == 0


def test_substrings_over_many_shards(spark, rows, monkeypatch):
    df = frame(spark, rows)
    whole = collections.Counter(map(tuple, substrings.dedup_report(df).collect()))
    monkeypatch.setattr(substrings, "SHARD", 4)
    monkeypatch.setattr(substrings, "BUCKET", 64)
    assert collections.Counter(map(tuple, substrings.dedup_report(df, shard_bytes=2000).collect())) == whole


def components(rows, words=5):
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(LOWER).split()
        sets.append({tuple(w[j : j + words]) for j in range(max(min(1, len(w)), len(w) - words + 1))})
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 5 >= 4 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                parent[root(a)] = root(b)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    low = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    return collections.Counter((rows[i][0], len(sets[i]), low[root(i)]) for i in range(len(rows)))


def test_jaccard(spark, rows):
    df = frame(spark, rows)
    assert collections.Counter(map(tuple, jaccard.join_near(df, chunk_bytes=30_000).collect())) == components(rows)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns and kept.where("doc_id BETWEEN 400 AND 419").count() == 1 and kept.where("doc_id IN (500, 501)").count() == 2
    assert jaccard.join_near(frame(spark, [])).count() == 0


def test_keep_one_decides_by_row(spark):
    """Doubled rows, rows without an id and an id with two texts: one row of each group stays, and its text outlives the next stage."""
    doubled, nameless, near, unique = (prose(150) for _ in range(4))
    rows = [(7, doubled), (7, doubled), (None, nameless), (None, nameless), (3, near), (8, near + " end"), (8, unique)]
    kept = jaccard.keep_one(frame(spark, rows))
    want = collections.Counter([(7, doubled), (None, nameless), (3, near), (8, unique)])
    assert kept.columns == frame(spark, []).columns and collections.Counter((r["doc_id"], r["text"]) for r in kept.collect()) == want
    assert collections.Counter((r["doc_id"], r["text"]) for r in substrings.dedup(kept).collect()) == want


def test_jaccard_at_the_threshold(spark):
    """Pairs of all small sizes that just link, or just don't."""
    rows = []
    for n in range(1, 90):
        words = [f"w{n}x{i}" for i in range(n + 4)]
        shared = math.ceil(4 * 2 * n / 9) if n > 1 else 1
        for less in (0, 1):
            cut = min(n, max(1, shared + less))
            rows += [(1000 * n + 10 * less + 1, " ".join(words[: n + 4]) + f" {less}"), (1000 * n + 10 * less + 2, " ".join(words[n - cut : n + 4] + [f"z{i}" for i in range(n - cut)]) + f" {less}")]
    assert collections.Counter(map(tuple, jaccard.join_near(frame(spark, rows)).collect())) == components(rows)


def ppm(trained, text):
    pad = bytes([255])
    tries = [collections.defaultdict(collections.Counter) for _ in range(5)]
    for t in trained:
        d = pad * 4 + t + pad
        for p in range(4, len(d)):
            for k in range(5):
                tries[k][d[p - k : p]][d[p]] += 1
    d, total = pad * 4 + text + pad, 0.0
    for p in range(4, len(d)):
        barred = set()
        for k in range(4, -1, -1):
            node = tries[k].get(d[p - k : p], {})
            left = {s: n for s, n in node.items() if s not in barred}
            barred = set(node)
            if not left:
                continue
            mass = 2 * sum(left.values())
            if d[p] in left:
                total += math.log10((2 * left[d[p]] - 1) / mass)
                break
            total += math.log10(len(left) / mass)
        else:
            total -= math.log10(256 - len(barred))
    return total


def test_lm_scoring(spark, rows):
    rows = rows[:60] + rows[-8:-1]
    learns = lambda i: i is not None and i % 3 != 0
    lowered = {(i, t): (t or "").encode().translate(LOWER) for i, t in rows}
    trained = [lowered[r] for r in rows if learns(r[0])]
    counts = collections.Counter(w for t in trained for w in [*t.split(), None])
    n, v = sum(counts.values()), len(counts)
    got = lm_scoring.score(frame(spark, rows), F.col("doc_id") % 3 != 0, block_bytes=4000).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["n_tokens"], r["n_known"]): r for r in got}
    for i, t in rows:
        words = [*lowered[i, t].split(), None]
        r = by[i, len(words), sum(counts[w] > 0 for w in words)]
        assert r["train_tokens"] == n and math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), rel_tol=1e-9)
        if len(t or "") < 600:
            assert math.isclose(r["score"], ppm(trained, lowered[i, t]), rel_tol=1e-9)
    assert lm_scoring.score(frame(spark, []), F.lit(True)).count() == 0
    assert lm_scoring.score(frame(spark, [(1, "ab")]), F.lit(False)).first()["score"] == pytest.approx(-3 * math.log10(256))


def test_lm_probabilities_add_up():
    text = lm_scoring.strings(b"abracadabra abracadabra")
    keys, n = np.unique(text, return_counts=True)
    levels = [lm_scoring.Level(keys, n, 0)]
    for order in range(1, 5):
        levels.append(lm_scoring.Level(keys, n, order).over(levels[-1]))
    for context in (b"abra", b"zzzz", b"dabr", b"xxra"):
        codes = (int.from_bytes(context) << 8) + np.arange(256)
        assert (10 ** lm_scoring.log_probabilities(codes, levels[::-1])).sum() == pytest.approx(1)


def test_packing(spark, rows):
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder.encode_special_tokens = True
    rows = [(i, t) for i, t in rows if i not in (None, 503)] + [(2000 + i, " abc" * 350) for i in range(60)]
    got = packing.pack(frame(spark, rows)).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == {i for i, _ in rows}
    for i, t in rows:
        ids, at = encoder.encode(t or "", add_special_tokens=False).ids + [0], 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        padding += 1024 - at if at & at - 1 else 0
    assert padding <= 0.01 * sum(r["length"] for r in got) + 1024
    assert packing.pack(frame(spark, [])).count() == 0


def test_packing_special_strings(spark):
    """Ids are those of the public tokenizer as it is: a special string is its one id."""
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(1, "a<|endoftext|>b"), (2, "<|endoftext|>"), (3, "x <|endoftext|> <|endoftext|><|endoftext|>\n y"), (4, "<|endoftext|"), (5, "it's <|endoftext|>" * 400)]
    got = collections.defaultdict(list)
    for r in packing.pack(frame(spark, rows)).collect():
        got[r["doc_id"]].append(r)
    for i, t in rows:
        ids = [*encoder.encode(t, add_special_tokens=False).ids, 0]
        assert {r["doc_tokens"] for r in got[i]} == {len(ids)} and sum(r["length"] for r in got[i]) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in got[i])
    huge = "a<|endoftext|>before there" + " " * 1_500_000 + "<|endoftext|>"
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json"):
        ids = packing.tokenizer(public_tokenizers.path(name))(huge).tolist()
        assert ids[:2] == [64, 50256] and ids[-1] == 50256 and ids == encoder.encode(huge, add_special_tokens=False).ids


def test_packing_plans():
    for histogram in ({700: 999}, {600: 10, 424: 3, 100: 7}, {k: k % 5 + 1 for k in range(1, 1024, 7)}, {}):
        plan = packing.plan(histogram, 1024)
        held = collections.Counter()
        for n, pattern in plan:
            assert sum(k * c for k, c in pattern.items()) <= 1024
            for k, c in pattern.items():
                held[k] += n * c
        assert held == collections.Counter(histogram)


def test_packing_reaches_the_bound():
    """Full histograms: the plan is within the rounding of what the linear program proves to be least."""
    random.seed(5)
    ways = [lambda k: 1000, lambda k: random.randint(1, 5000), lambda k: int(3000 * math.exp(-k / 120)) + 1, lambda k: int(3000 * math.exp((k - 1024) / 90)) + 1, lambda k: 700 if k > 512 else 3, lambda k: random.randint(0, 2), lambda k: int(2000 * math.exp(-(((k - 345) / 8) ** 2)))]
    for way in ways:
        histogram = {k: n for k in range(1, 1024) if (n := way(k))}
        lengths, demand = (np.array(x) for x in zip(*histogram.items(), strict=True))
        found, bound = packing.linear_program(lengths, demand.astype(float), 1024)
        assert bound >= demand @ lengths / 1024 - 1e-6 and sum(n for n, _ in found) <= bound * 1.006
        assert sum(n for n, _ in packing.plan(histogram, 1024)) <= bound * 1.006 + 8


def test_top_k(spark):
    rows = [(i, [random.choice([-0.3, 0.1, 0.5, 1e-20, -1e-20]) for _ in range(6)]) for i in range(160)]
    rows += [(200 + i, [0.5] * 6) for i in range(30)] + [(300, None), (301, [0.1, None]), (302, [float("nan")]), (303, [float("inf")]), (304, []), (305, [0.7, 0.2]), (None, [0.1])]
    df = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id bigint, embedding array<double>, score int")
    rows += [(50, rows[3][1]), (50, rows[50][1]), (77, rows[50][1])]
    df = df.union(spark.createDataFrame([(i, v, 9) for i, v in rows[-3:]], df.schema))
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, block_rows=40, query_bytes=300)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(topk.exhaustive(rows, list(range(0, 400, 50)), 5))
    huge = spark.createDataFrame([(0, [1e30]), (1, [1e30]), (2, [-1e30])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(huge, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_quality(spark):
    good = [(i, ". ".join(prose(12) for _ in range(8))) for i in range(120)]
    bad = [(500 + i, " ".join(f"{w}###" for w in prose(90).split())) for i in range(60)]
    labels = spark.createDataFrame([(i, 1, None) for i, _ in good[:80]] + [(i, 0, 0) for i, _ in bad[:40]] + [(None, 1, 1), (1, None, 1)], "doc_id bigint, quality int, toxic int")
    odd = [(900, None), (901, ""), (902, "a b " * 40), (903, "x " * 49), (None, good[0][1])]
    rows = good + bad + odd
    got = {r["doc_id"]: r for r in quality.assess(frame(spark, rows), labels).collect()}
    for i, t in rows:
        if i is None:
            continue
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        marked = {j + d for j in range(len(words) - 2) if windows[tuple(words[j : j + 3])] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(marked))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(marked) > 50 * len(words))
    assert all(got[i]["kept"] for i, _ in good[80:]) and not any(got[i]["kept"] for i, _ in bad[40:])  # held out
    kept = quality.keep(frame(spark, rows), labels)
    assert kept.columns == frame(spark, []).columns and kept.where("doc_id < 500").count() == len(good)
    assert quality.assess(frame(spark, good), labels.limit(0)).where("kept").count() == len(good)
    assert quality.assess(frame(spark, []), labels).count() == 0


PLAIN = {0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 2: r"[0-9]([\x20-]?[0-9])+", 3: r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            fine = {0: True, 1: kind != 1 or all(int(p) <= 255 for p in m[0].split(".")), 2: 16 <= len(digits) <= 19 and pii.luhn(digits), 3: 8 <= len(digits) <= 15}[kind]
            if fine:
                yield kind, *m.span()


def test_pii_base_against_plain_patterns():
    pieces = ["a.b@c.d", "@", "x@y", "@@z.z@q.example.org.", "1.2.3.4.5", "300.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (403) 555-0101", "+12", " ", "-", "a", "7", "é", "\n"]
    for _ in range(3000):
        text = "".join(random.choice(pieces) for _ in range(random.randint(0, 9)))
        assert pii.base_spans(text)[0] == sorted(plain_spans(text)), text


def test_pii_long_texts_end():
    for text in ("a" * 300_000 + " @", "1" * 300_000 + ".", "+1" + " " * 300_000, "1." * 150_000):
        pii.base_spans(text)


def test_pii_field(spark):
    card, other = "4111111111111111", "5500005555555559"
    rows = [(i, f"{prose(5)} {random.choice([card, other])} {prose(4)} mail u{i}@s.example.org {prose(3)} 10.0.0.{i % 200} and {i} of 12345") for i in range(200)]
    rows += [(900, f"{card} {other} then {prose(3)} {card} end"), (901, None), (902, ""), (903, prose(40)), (904, "order 1234567890123456 of 2024")]
    got = {r["doc_id"]: r for r in pii.find(frame(spark, rows)).collect()}
    for i, t in rows:
        spans = sorted(plain_spans(t or ""))
        assert got[i]["base_sha256"] == hashlib.sha256(pii.written(spans).encode()).hexdigest()
        assert set(filter(None, pii.written(spans).split(","))) <= set(got[i]["spans"].split(","))
    assert {"card:0:16", "card:17:33"} <= set(got[900]["spans"].split(",")), got[900]
    assert [got[i]["spans"] for i in (901, 902, 903, 904)] == [""] * 4
    masked = {r["doc_id"]: r for r in pii.mask(frame(spark, rows)).collect()}
    assert card not in masked[900]["text"] and masked[901]["text"] is None and masked[903]["text"] == rows[-2][1] and masked[900]["n"] == 2
    assert pii.find(frame(spark, [])).count() == 0


def test_pii_field_adds_over_tokens():
    """Runs of tokens of one label are read together; a number that fails its check is unobserved."""
    cut = lambda text: [m.span() for m in re.finditer(r"\S+", text)]
    for kind, text, want in ((3, "(017) 555-7713", [(3, 0, 14)]), (2, "4111 1111 1111 1111", [(2, 0, 19)]), (2, "12 4111 1111 1111 1111", [(2, 3, 22)]), (3, "555 1234", []), (1, "300.10.2.3.4", [(1, 4, 12)]), (0, "root@localhost, x", [(0, 0, 14)]), (2, "4111111111111112", [])):
        assert pii.decoded(text, kind, cut(text), []) == want, text
    assert pii.decoded("(017) 555-7713", 3, cut("(017) 555-7713"), [(3, 6, 14)]) == []
    assert pii.base_spans("12 4111 1111 1111 1111") == ([], [(0, 22)])
    rows = [f"call +1 ({i % 90:03}) 555-{1000 + 7 * i} today. {prose(4)} ring ({i % 90:03}) 555-{1000 + 7 * i} or {i} of {prose(3)}" for i in range(200)]
    seen = pii.Field(rows)
    model = pii.learned(seen, np.where(seen.observed([([(3, m.start(), m.end()) for m in re.finditer(r"(?:\+1 )?\([0-9]+\) 555-[0-9]+", t)], []) for t in rows]) > 0, 4, 0))
    text = "ring +1 (017) 555-7713 now or later (017) 555-7713 end"
    own, more = pii.spans_of([text], model)[0]
    assert own == [(3, 5, 22)] and more == [(3, 36, 50)]


def page(i, blocks, cut=False):
    body = "".join(f"<p>{escapes.escape(b)}</p>" for b in blocks[1:])
    whole = f'<html><head><title>t{i}</title><script>var x="</p>";</script></head><body><nav><ul><li><a href="/a">Menu {i}</a></li></ul></nav><div class="cookie-notice">We use cookies</div><header>Site</header><article><h1>{escapes.escape(blocks[0])}</h1>{body}<aside>see also</aside><form>name <input></form></article><div id="comments"><p>first!</p></div><footer>&copy; site</footer></body></html>'
    return whole[: whole.index("<aside>")] if cut else whole


def test_html(spark):
    rows, want = [], {}
    for i in range(80):
        blocks = [prose(3), *[prose(9) + " a < b & c" for _ in range(i % 4 + 1)]]
        rows.append((i, f"http://h{i % 2}.example/{i}", page(i, blocks, i % 9 == 0)))
        want[i] = "\n".join(blocks)
    rows += [(100, None, page(100, ["alone", "x y"])), (101, "http://h0.example/", None), (102, "http://h0.example/z", ""), (103, "nonsense", "<p>plain  &eacute;\n text<br>more</p><p>next")]
    want |= {100: "alone\nx y", 101: "", 102: "", 103: "plain é text more\nnext"}
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, text string")
    got = {r["page_id"]: r for r in html.main_text(df).collect()}
    assert {i: r["text"] for i, r in got.items()} == want and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html.main_text(df.limit(0)).count() == 0
    named = {r["host"]: r["template"] for r in html.templates(df).collect()}
    assert "*/body/article" in named["h0.example"].split("\n")


def test_html_template_leads(spark):
    """What recurs on a host goes and what varies stays, whatever elements are called; copies of a page are no evidence."""
    rows, want = [], {}
    for i in range(40):
        own, more = prose(12), prose(8) + " <b>x</b>, <i>y</i>."
        plain = re.sub("<[^>]*>", "", more)
        rows.append((i, f"http://plain.example/{i}", f"<body><div class=c1><p>Our shop, open daily</div><div class=c2><h2>{own}</h2></div><div class=c3><p>{more}<p>Call us now</div></body>"))
        want[i] = f"{own}\n{plain}"
        rows.append((100 + i, f"http://inner.example/{i}", f"<body><article><h1>{own}</h1><p>{more}<p>Call us now<p>Call us now</article></body>"))
        want[100 + i] = f"{own}\n{plain}\nCall us now\nCall us now"  # what recurs in the article is the article's
        rows.append((200 + i, f"http://social.example/{i}", f"<body><div class='social page'><p>Join us</p><p>{own}</div></body>"))
        want[200 + i] = own
        rows.append((300 + i, f"http://teaser.example/{i}", f"<body><div class=c1><p>{own} {own} {own}</div><article><p>{plain[:9]}</article></body>"))
        want[300 + i] = f"{own} {own} {own}\n{plain[:9].strip()}"
        rows.append((400 + i, "http://copies.example/a", "<body><article><h1>One page</h1><p>many times</article></body>"))
        want[400 + i] = "One page\nmany times"
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, text string").repartition(3)
    assert {r["page_id"]: r["text"] for r in html.main_text(df).collect()} == want


def test_html_classes_must_nest():
    whole = [(1.0, "/body<"), (2.0, "/body/div.a<"), (3.0, "#1/body/div.a"), (4.0, "/body/div.a>"), (5.0, "/body/div.b<"), (9.0, "/body>")]
    assert html.valid(whole) and html.valid([(2.5, "/body/div.b/div.c<"), (3.5, "/body/div.b/div.c>")])
    out_of_order = [(5.0, "/body<"), (1.0, "/body/div.a<"), (2.0, "/body/div.b/div.c<")]
    crossing = [(1.0, "/body/div.a<"), (2.0, "/body/div.b<"), (3.0, "/body/div.a>"), (4.0, "/body/div.b>")]
    stray = [(1.0, "/body/div.a<"), (2.0, "/body/div.a>"), (3.0, "#1/body/div.a")]
    for members in (out_of_order, crossing, stray, [(4.0, "/body/div.a<"), (3.0, "/body/div.a>")]):
        assert not html.valid(members), members
    rows = [(role, 9, 7, 7, place, 10, 9) for place, role in crossing] + [(role, 9, 8, 8, place, 30, 9) for place, role in whole[:1]]
    assert "div" not in html.template(rows) and "/body" in html.template(rows)


def test_html_long_and_broken(spark):
    long_ = "<body><article>" + "".join(f"<p>w{i}" for i in range(20_000))
    deep = "<div>" * 3000 + "deep text" + "</p></section>" * 50
    rows = [(1, None, long_), (2, None, deep), (2, None, deep), (3, None, "<p>open <b>bold <div class='x>never closed"), (4, None, "a < b <> c & d &amp; <!-- x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = [(r["page_id"], r["text"]) for r in html.main_text(df).collect()]
    texts = dict(got)
    assert len(got) == 5 and texts[1] == "\n".join(f"w{i}" for i in range(20_000)) and texts[2] == "deep text" and texts[4].startswith("a < b <> c & d &")


def test_licenses(spark):
    known = dict(licenses.KNOWN)
    text = "Copyright (c) 2020 A. Person\n" + known["0BSD"].replace("software", "SOFTWARE")
    bsd = "BSD 3-Clause License\n\n© 2021 B. Person\nAll rights reserved.\n" + licenses._bsd([licenses._BSD_SOURCE, licenses._BSD_BINARY, licenses._BSD_NAMES], True).replace('"', "”").replace("; ", " — ")
    rows = [(1, text), (2, text.replace("PROFITS", "PROFIT")), (3, None), (4, known["Unlicense"].replace("recognize", "recognise") + "\nMore."), (5, "(c) 2020"), (6, "a " * 5000)]
    rows += [(7, bsd), (8, known["Zlib"].replace("acknowledgment", "acknowledgement")), (9, "See the LICENSE. " + known["MIT"]), (10, known["Unlicense"].replace("recognize", "recognise").replace("https", "http")), (10, None), (None, known["BSL-1.0"])]
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(frame(spark, rows)).collect()}
    assert got == {(1, "0BSD"), (2, None), (3, None), (4, None), (5, None), (6, None), (7, "BSD-3-Clause"), (8, "Zlib"), (9, None), (10, "Unlicense"), (10, None), (None, "BSL-1.0")}
    own = spark.createDataFrame([("own", "Do what you  LIKE, per cent for percent")], "name string, text string")
    assert [r["license"] for r in licenses.scan(frame(spark, [(1, "do what you like: percent for per cent")]), own).collect()] == ["own"]
    assert licenses.scan(frame(spark, [])).count() == 0


def test_licenses_as_published(spark, tmp_path):
    """Whole long licences, where the system has them, by Spark and by the SQL."""
    folder = "/usr/share/common-licenses"
    files = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    have = [(f, n) for f, n in files.items() if os.path.exists(f"{folder}/{f}")]
    if not have:
        pytest.skip("no licence texts here")
    texts = [open(f"{folder}/{f}", encoding="utf-8").read() for f, _ in have]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, "Copyright 2022 C. Person\n" + t.upper().replace("\n", "\r\n")) for i, t in enumerate(texts)] + [(200 + i, t.replace(" not ", " ", 1)) for i, t in enumerate(texts)]
    docs = frame(spark, rows)
    got = {r["doc_id"]: r["license"] for r in licenses.scan(docs).collect()}
    names = [n for _, n in have]
    assert [got[i] for i in range(len(have))] == names == [got[100 + i] for i in range(len(have))]
    assert not any(got[200 + i] for i in range(len(have)))
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    assert {r[0]: r[2] for r in con.execute(licenses.scan_sql()).fetchall()} == got


def test_quality_counts_characters():
    """N-grams are of characters, within a text, whatever bytes these take."""
    texts, chars, bits = ["añbñ añbñ", "ab", "", "日本語の文日本語の"], 4, 17
    _, _, _, _, grams, cuts = quality.features(texts, bits, chars)
    assert cuts.tolist() == [0, 9, 11, 11, 20]
    own = [grams[a : max(a, b - chars + 1)].tolist() for a, b in zip(cuts, cuts[1:], strict=False)]
    for text, got in zip(texts, own, strict=True):
        pieces = [text[i : i + chars] for i in range(len(text) - chars + 1)]
        assert len(got) == len(pieces) and len(set(zip(pieces, got, strict=True))) == len(set(pieces)) == len(set(got))
    assert quality.features(["xx日本語の"], bits, chars)[4][2] == own[3][0]


def test_quality_on_held_out_labels(spark):
    """Of the labelled rows that the sample leaves out, at least nine in ten get their label."""
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    labels = read("labels")
    apart = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    docs = read("documents").join(labels.where(apart).select("doc_id"), "doc_id")
    model = quality.fit(read("documents"), labels.where(~apart))
    found = quality.judged(model, docs, 17, 4, 0.5, "doc_id", "text", [], 4 << 20).withColumn("good", F.expr("probability >= 0.5"))
    right, n = found.join(labels, "doc_id").agg(F.avg((F.col("good") == (F.col("quality") == 1)).cast("int")), F.count("*")).first()
    print(f"{right:.4f} of {n} held-out labels")
    assert n > 300 and right >= 0.9


@pytest.mark.parametrize(("text", "edges", "within"), [("a1 b2 c3 d4", 3, 1e-3), ("a1 x b2 x a1 x c3", 1, 1e-3), ("a1 b2 a1 c3", 4, 0.05)])
def test_pii_marginals_against_enumeration(text, edges, within):
    """Message passing is exact on trees and near it on a small loop."""
    rng, field, n_labels = np.random.default_rng(5), pii.Field([text]), pii.N_LABELS
    assert len(field.chain) + len(field.skip) == edges
    model = rng.normal(0, 0.4, pii.N_FEATURES * n_labels + 2 * n_labels**2)
    own = field.evidence(model[: pii.N_FEATURES * n_labels].reshape(-1, n_labels))
    chain, skip = model[pii.N_FEATURES * n_labels :].reshape(2, n_labels, n_labels)
    want = np.zeros_like(own)
    for labels in itertools.product(range(n_labels), repeat=len(own)):
        energy = sum(own[i, x] for i, x in enumerate(labels)) + sum(w[labels[a], labels[b]] for e, w in ((field.chain, chain), (field.skip, skip)) for a, b in e)
        want[np.arange(len(own)), labels] += np.exp(energy)
    want /= want.sum(axis=1, keepdims=True)
    assert np.abs(pii.marginals(field, model) - want).max() < within
