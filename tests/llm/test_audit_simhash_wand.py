"""Operators 11 to 13 against brute force, with the awkward inputs of their contracts."""

import itertools
import math
import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import xxhash

from leadloom.llm import filter_audit, simhash, wand
from leadloom.llm import queries as registered

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


def prose(own, n, words=None):
    return " ".join(own.choice(words) if words else "".join(own.choice("abcdeéß") for _ in range(own.randint(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    own = random.Random(7)
    words = prose(own, 300).split()
    out = [(i, prose(own, own.randint(0, 90), words)) for i in range(160)]
    near = prose(own, 120, words).split()
    for i in range(40):
        text = list(near)
        for _ in range(own.randint(0, 3)):
            text[own.randrange(len(text))] = own.choice(words)
        out.append((300 + i, " ".join(text)))
    out += [(400 + i, "SAME text Of few words #" + " y" * 60) for i in range(30)]
    out += [(500, None), (501, ""), (502, " \n\t "), (503, "one"), (503, "one"), (503, "two"), (None, "one"), (None, None), (None, prose(own, 70, words)), (504, "Orre " * 900), (505, prose(own, 5000, words)), (-3, "one"), (506, "A_b c\x1fd É e f")]
    own.shuffle(out)
    return out


def frame(spark, rows):
    """Documents with sources, and columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None if n % 7 == 0 else "" if n % 7 == 1 else f"s{n % 3}", 1, "x", 2) for n, (i, t) in enumerate(rows)], "doc_id bigint, text string, source string, n int, mask string, code int").repartition(3)


LABELS = [(i, [0, 1, None][i % 3], [1, None, 0][i % 4 % 3]) for i in range(0, 420)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (503, 1, 1)]


def audited(rows, labels):
    """Every document through every order, one by one."""
    docs, found = [(i, t or "", None if n % 7 == 0 else "" if n % 7 == 1 else f"s{n % 3}") for n, (i, t) in enumerate(rows)], {}
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    for i, text, part in docs:
        words = WORD.findall(text)
        fails = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)), i is not None and any(t == text and j is not None and j < i for j, t, _ in docs)]
        fails = dict(zip("ABCDE", fails, strict=True))
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = False
            for step, letter in enumerate(order, 1):
                row = found.setdefault((part or "", order, step), Counter())
                row["redundant"] += fails[letter] and gone
                row["unique_fails"] += fails[letter] and sum(fails.values()) == 1
                if fails[letter] and not gone:
                    gone = True
                    row["removed"] += 1
                    row["good_lost"] += i in good
                    row["toxic_lost"] += i in toxic
                row["kept"] += not gone
    share = Counter()
    for (part, order, step), row in found.items():
        share[part, order[step - 1]] += row["removed"]
    return {(part, order, step, *(row[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), share[part, order[step - 1]]) for (part, order, step), row in found.items()}


def test_audit_against_every_order(spark, rows):
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")
    got = filter_audit.audit(frame(spark, rows), labels)
    assert got.columns == [c.split()[0] for c in filter_audit.RESULT.split(", ")]
    got = [tuple(r) for r in got.collect()]
    want = audited(rows, LABELS)
    assert len(got) == len(want) == 600 * len({g[0] for g in got}) and set(got) == want
    assert filter_audit.audit(frame(spark, rows).limit(0), labels).count() == 0
    assert filter_audit.audit(frame(spark, rows), labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_audit_polynomial_is_the_mean_over_all_orders():
    rng = np.random.default_rng(2)
    for _ in range(20):
        counts = rng.integers(0, 10**15, filter_audit.SETS)
        p = filter_audit.polynomial(counts)
        removed = lambda s: sum(int(c) for m, c in enumerate(counts) if m & s)
        assert all(filter_audit.at_corner(p, s) == removed(s) for s in range(filter_audit.SETS))
        for i in range(5):
            orders = itertools.permutations(range(5))
            mean = sum(removed(before | 1 << i) - removed(before) for o in orders for before in [sum(1 << x for x in o[: o.index(i)])])
            assert filter_audit.shapley(p, i) == Fraction(mean, 120)


@pytest.mark.parametrize("name", ["op11_audit", "op13_wand"])
def test_registered_query_against_sql(spark, name):
    with duckdb.connect() as db:
        for t in ("documents", "labels", "benchmark"):
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
        found = db.sql(registered.oracle_sql()[name])
        columns, want = found.columns, found.fetchall()
    got = getattr(registered, name)(spark, "/root/testdata/sf0.001")
    assert sorted(got.columns) == sorted(columns) and len(want) > 100
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want)


def plain_fingerprint(text):
    words = WORD.findall(lower(text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, codes):
    """The least id of each row's component."""
    left, out = list(range(len(codes))), [None] * len(codes)
    while left:
        group, front = [], [left.pop()]
        while front:
            x = front.pop()
            group.append(x)
            near = [y for y in left if (codes[x] ^ codes[y]).bit_count() <= 3]
            left = [y for y in left if (codes[x] ^ codes[y]).bit_count() > 3]
            front += near
        least = min((ids[x] for x in group if ids[x] is not None), default=None)
        for x in group:
            out[x] = least
    return out


def test_simhash_against_all_pairs(spark, rows):
    assert simhash.fingerprint("a b c d e f g h i") == plain_fingerprint("a b c d e f g h i")
    got = simhash.near_simhash(frame(spark, rows))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    codes = [plain_fingerprint(t) for _, t in rows]
    want = Counter((i, f"{c:016x}", k) for (i, _), c, k in zip(rows, codes, components([i for i, _ in rows], codes), strict=True))
    assert Counter(map(tuple, got.collect())) == want
    assert Counter(map(tuple, simhash.near_simhash(frame(spark, rows), hot=2, task_bytes=50_000, chunk_bytes=3000).collect())) == want
    assert simhash.near_simhash(frame(spark, rows).limit(0)).count() == 0
    nameless = frame(spark, [(None, "only one"), (None, "only one")])
    assert [tuple(r)[::2] for r in simhash.near_simhash(nameless).collect()] == [(None, None)] * 2


def test_simhash_anchors_cover():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in codes], np.uint64)
    homes, met = simhash.home(codes), [set() for _ in codes]
    for anchor, whose, own in simhash.replicas(codes ^ flips):
        assert not own or (np.arange(len(codes)) == whose).all()
        for a, w in zip(anchor.tolist(), whose.tolist(), strict=True):
            met[w].add(a)
    assert all(h in m for h, m in zip(homes.tolist(), met, strict=True))
    assert 250 < sum(map(len, met)) / len(codes) < 350  # 302 on average
    codewords = np.arange(1 << simhash.LENGTH, dtype=np.int32)[simhash.errors()[0] == 0]
    assert len(codewords) == 4096 and sorted({int(c).bit_count() for c in codewords}) == [0, 7, 8, 11, 12, 15, 16, 23]


@pytest.mark.parametrize("small", [0, 40, 1 << 40])
def test_simhash_links_join_what_all_links_join(small):
    rng = np.random.default_rng(6)
    dense = rng.integers(0, 2**64, 6, dtype=np.uint64)
    codes = np.unique([int(c) ^ sum(1 << int(b) for b in rng.choice(12, rng.integers(0, 9), replace=False)) for c in dense for _ in range(60)]).astype(np.uint64)
    parts = []
    for anchor, whose, own in simhash.replicas(codes):
        one = np.empty(len(anchor), simhash.REPLICA)
        one["anchor"], one["code"] = anchor if own else ~anchor, codes[whose]
        parts.append(one)
    got = {(int(a), int(b)) for x, y in simhash.compared(np.concatenate(parts), small) for a, b in zip(x, y, strict=True)}
    assert all(0 < (a ^ b).bit_count() <= 3 for a, b in got)
    near = {c: {c} for c in map(int, codes)}
    for a, b in got:
        if near[a] is not near[b]:
            near[a] |= near[b]
            for c in near[b]:
                near[c] = near[a]
    of = components(list(map(int, codes)), list(map(int, codes)))
    assert [min(near[int(c)]) for c in codes] == of


def plain_search(rows, items, k=10):
    docs = [(i, Counter(TERM.findall(lower(t or "")))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    total, df = sum(sum(c.values()) for _, c in docs), Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        asked, scored = Counter(TERM.findall(lower(text or ""))), []
        for i, c in docs:
            m = 100 - 75 + (75 * sum(c.values()) * len(docs)) // total
            score = sum(n * math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, n in asked.items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def test_wand_against_all_documents(spark, rows):
    own = random.Random(9)
    picked = own.sample([t for _, t in rows if t and len(t) > 60], 12)
    items = [(i, t[:300]) for i, t in enumerate(picked)] + [(20, None), (21, ""), (22, "zzzz nowhere"), (23, "one ONE One two"), (23, "one"), (None, "same text"), (24, "É_e c f")]
    table = spark.createDataFrame([(*x, 7) for x in items], "item_id bigint, text string, score int")
    want = Counter(plain_search(rows, items))
    got = wand.search(frame(spark, rows), table)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == want
    assert Counter(map(tuple, wand.search(frame(spark, rows), table, shard_bytes=2000, block_bytes=900).collect())) == want
    assert wand.search(frame(spark, rows).limit(0), table).count() == wand.search(frame(spark, rows), table.limit(0)).count() == 0
    assert Counter(map(tuple, wand.search(frame(spark, rows), table, k=3).collect())) == Counter(plain_search(rows, items, 3))


def test_wand_skips_and_finds_the_same():
    own = random.Random(12)
    rows = [(i, " ".join(f"w{int(own.paretovariate(0.5)) % 300}" for _ in range(own.randint(5, 30)))) for i in range(4000)]
    for _ in range(5):
        asked = [f"w{own.randrange(40)}" for _ in range(8)]
        lists, scores = [], Counter()
        for t in set(asked):
            held = [(n, 1000 * x.split().count(t) // (x.split().count(t) + 1)) for n, (_, x) in enumerate(rows) if t in x.split()]
            if held:
                weight = 1 + 4000 // len(held)
                lists.append((max(g for _, g in held), weight, [*(n for n, _ in held), len(rows)], [g for _, g in held]))
                for n, g in held:
                    scores[n] += weight * g
        heap: list = []
        scored = wand.searched(lists, list(range(len(rows))), heap, 10)
        assert sorted(((s, ~x) for s, x in heap), key=lambda x: (-x[0], x[1])) == sorted(((s, n) for n, s in scores.items()), key=lambda x: (-x[0], x[1]))[:10]
        assert scored < 0.8 * len(scores)


def test_wand_lengths_beyond_64_bits():
    counts, lengths = np.array([1, 3]), np.array([10**12, 5])
    got = wand.impacts(counts, lengths, 10**10, 10**13)
    assert got.tolist() == [10**9 // (1000 + 8 * (25 + 75 * 10**12 * 10**10 // 10**13)), 3 * 10**9 // (3000 + 8 * 25)]
