"""States of stretches of pages: merged in any grouping they tell what the joined text tells."""

import random
import re

import pytest
from pyspark.sql import functions as F

from leadloom.functions import exprs, rules
from leadloom.operators import leads, states

SCHEMA = "ordinal bigint, url string, text string"
PIECES = ["403", "-555", " 0101", "x", "", "+1 (", ") ", "555-01", "a 403-555-0102 b", "9" * 12, " ", "\n", "grief", "support", " group", "celebration", "of life", "y" * 35, "Funeral", "HOME", "professional", "development", "info@s.example", "contact  us"]


def sites(own, n):
    return {f"s{i}.example": ["".join(own.choice(PIECES) for _ in range(own.randint(0, 4))) for _ in range(own.randint(1, 12))] for i in range(n)}


def rows_of(corpus, step=3):
    return [(100 * i + step * j, f"http://{d}", t) for i, (d, texts) in enumerate(corpus.items()) for j, t in enumerate(texts)]


@pytest.mark.parametrize("width", [1, 4, 10, 1 << 13])
def test_states_against_the_joined_text(spark, width):
    corpus = sites(random.Random(width), 80)
    got = {r["domain"]: r for r in states.finished(states.site_states(spark.createDataFrame(rows_of(corpus), SCHEMA), width)).collect()}
    assert set(got) == set(corpus)
    for d, texts in corpus.items():
        whole = " ".join(texts)
        low = whole.lower()
        assert got[d]["raw_phones"] == sorted(set(re.findall(rules.PHONE, whole)))
        assert got[d]["raw_emails"] == sorted({m for t in texts for m in re.findall(rules.EMAIL, t)})
        for g in ("seminar", "community", "event", "education", "industry", "association"):
            assert got[d][f"n_{g}"] == sum(w in low for w in rules.KEYWORDS[g]), (d, g)
        for g in ("home", "society"):
            assert got[d][f"is_{g}"] == any(w in f"{low} {d}" for w in rules.KEYWORDS[g])
        assert all(got[d][f"kw_{w}"] == (w in low) for w in rules.KEYWORDS["role"])
        assert got[d]["pages"] == len(texts)


def test_merging_is_associative(spark):
    corpus = {"s.example": sites(random.Random(8), 1)["s0.example"] * 3 + sites(random.Random(9), 1)["s0.example"] * 4}
    pages = states.page_states(spark.createDataFrame(rows_of(corpus, 1), SCHEMA))
    n = len(corpus["s.example"])
    want = None
    for cuts in ([], [1], [3, 4, 9], list(range(n)), [n // 2], [n - 1]):
        part = sum((F.col("first") >= c).cast("int") for c in cuts) if cuts else F.lit(0)
        got = states.finished(states.merged(states.merged(pages, "domain", F.lit(part).alias("part") if not cuts else part.alias("part")).drop("part"), "domain")).drop("evidence_chat").collect()
        want = want or got
        assert got == want


def test_long_stretches_of_short_pages(spark):
    """A number over many empty pages, and edges that stay short however many pages have nothing else."""
    rows = [(0, "http://a.example", "tel 403")] + [(i, "http://a.example", "") for i in range(1, 3000)] + [(3000, "http://a.example", "555 0101 x")]
    rows += [(5000 + i, "http://b.example", "ab") for i in range(3000)] + [(9000, "http://b.example", "grief"), (9001, "http://b.example", "support")]
    found = states.site_states(spark.createDataFrame(rows, SCHEMA), 256)
    got = {r["domain"]: r for r in found.collect()}
    assert max(len(r["seam"][k]) for r in got.values() for k in ("head", "tail")) <= states.SEAM
    done = {r["domain"]: r for r in states.finished(found).collect()}
    assert done["a.example"]["raw_phones"] == ["403" + " " * 3000 + "555 0101"]
    assert done["b.example"]["n_community"] == 1


def test_one_site_is_dealt_out(spark):
    """No group of the first merge has over a fifth of a site's pages."""
    pages = spark.range(50_000).selectExpr("id AS ordinal", "'http://one.example' AS url", "concat('page ', id) AS text")
    largest = states.page_states(pages).groupBy(F.floor(F.col("first") / states.WIDTH)).count().agg(F.max("count")).first()[0]
    assert largest <= 10_000
    assert states.finished(states.site_states(pages)).select("pages").first()[0] == 50_000


def test_literals_are_required():
    """Whatever matches a pattern has the literal of one of its alternatives, and that alternative matches."""
    own = random.Random(2)
    letters = ["contact", "us", "our", "form", "send", "a", "message", "request", "information", "call", "callback", "book", "an", "appointment", "plan", "planning", "planner", "pre", "online", "funeral", "price", "list", "schedule", "fee", "meeting", "live", "chat", "with", "guide", "free", "gravity", "forms", "packages", "-", " ", "  ", " ", ".", ":", "phone", "tool", "widget", "booking", "made", "can", "be", "arrangements", "arrange", "virtual", "start", "your"]
    hits = 0
    for _ in range(20_000):
        text = "".join(own.choice(letters) for _ in range(own.randint(1, 7)))
        for p in exprs.all_patterns():
            alternatives = exprs.required(p)
            found = any(literal in text and (not rest or re.search(rest, text)) for literal, rest in alternatives)
            assert bool(re.search(p, text)) == found, (p, text)
            hits += found
    assert hits > 500


def test_scores_by_literals_are_those_of_all_patterns(spark):
    own = random.Random(5)
    words = ["contact", "us", "our", "form", "<form", "iframe", "request", "a call", "book", "an", "appointment", "online", "planner", "planning", "pre", "-", "price", "list", "transparent", "pricing", "cost", "packages", "live", "chat", "messenger", "tawk", "calendly", "cremation", "burial", " ", "\n", " ", " ", " ", "Consultation", "FEES"]
    texts = ["".join(own.choice(words) for _ in range(own.randint(0, 12))) for _ in range(400)]
    pages = spark.createDataFrame([(i, "http://s.example", t) for i, t in enumerate(texts)], SCHEMA)
    plain = pages.withColumn("normal", exprs.normal_space(F.col("text"))).select("ordinal", *[exprs.feature_score(F.col("normal"), f).alias(f"score_{f}") for f in rules.FEATURES])
    got = leads.page_features(pages).select(plain.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
