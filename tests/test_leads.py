"""The site-lead engine: units by example, and every query against its SQL on the smallest tables."""

import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from leadloom.functions import exprs, rules
from leadloom.operators import crm, leads, sinks, states
from leadloom.plans import queries as plans
from leadloom.sources import pages as sources

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, values, kind, column):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def test_domains(spark):
    urls = ["http://a.example/x", "https://www.b.example", "HTTP://c.example/y", "http://awww.b.example", "/rel", "d.example:80?q", "", None]
    assert one(spark, urls, "string", exprs.clean_domain) == ["a.example", "b.example", "HTTP:", "ab.example", "", "d.example:80?q", "", ""]


def test_exact_round(spark):
    random.seed(1)
    values = [random.randint(0, 4000) * 0.05 / 2 for _ in range(500)] + [0.25, 1234.05, 2.675]
    assert one(spark, values, "double", lambda x: exprs.exact_round(x, 1)) == [round(v, 1) for v in values]


def test_phone_rules(spark):
    phones = ["403-555-0101", "1-403-555-0101", "204-555-0101", "1 905 555 0101", "023-555-0101", "2024-05-05 10:11", "", None, "212.555.0101", "226 555 0101"]
    assert one(spark, phones, "string", exprs.valid_phone) == [True, True, False, False, False, False, False, False, True, True]
    assert one(spark, phones, "string", exprs.region_score) == [100, 100, 70, 70, 20, 0, 0, 0, 20, 70]
    assert one(spark, phones, "string", exprs.phone_score) == [100, 90, 0, 0, 0, 0, 0, 0, 40, 40]


def test_clean_and_best_email(spark):
    df = spark.createDataFrame([(["B@s.example", "a@s.example", "x@google.com", "info@other.example", "bad"], "s.example"), ([], "s.example")], "e array<string>, d string")
    got = df.select(exprs.clean_emails(F.col("e"), F.col("d")).alias("c"), "d").select("c", exprs.best_email(F.col("c"), F.col("d"))).collect()
    assert got[0][0] == ["a@s.example", "b@s.example", "info@other.example"]
    assert tuple(got[0][1]) == (75, "b@s.example") and tuple(got[1][1]) == (0, "")


def page_rows(spark, rows):
    return spark.createDataFrame(rows, "ordinal bigint, url string, text string")


def test_threshold_is_per_page_and_evidence_is_first(spark):
    rows = [(2, "http://s.example/b", "newsletter here"), (1, "http://s.example/a", "Please subscribe"), (3, "http://t.example", "download"), (4, "http://t.example", "download"), (5, None, "newsletter"), (6, "http://u.example", None)]
    sites = {r["domain"]: r for r in leads.sites(page_rows(spark, rows)).collect()}
    assert sites["s.example"]["has_lead_capture"] and sites["s.example"]["evidence_lead_capture"]["url"].endswith("/a")
    assert not sites["t.example"]["has_lead_capture"] and sites["t.example"]["best_lead_capture"] == 2
    assert set(sites) == {"s.example", "t.example", "u.example"}


def test_keyword_over_a_seam(spark):
    rows = [(1, "http://s.example", "we give grief"), (2, "http://s.example", "support to all"), (3, "http://t.example", "grief\nsupport")]
    got = {r["domain"]: r["n_community"] for r in leads.sites(page_rows(spark, rows)).collect()}
    assert got == {"s.example": 1, "t.example": 0}


def test_surroundings_over_buckets(spark):
    """What stands around a page, ranks and signals, with buckets of two and of many ordinals, as on the joined text."""
    random.seed(5)
    pieces = ["", "a", "bc", "contact us", " the price ", "x" * 60, "plan\nahead", "burial"]
    sites = {f"s{i}.example": ["".join(random.choice(pieces) for _ in range(random.randint(0, 3))) for _ in range(random.randint(1, 9))] for i in range(30)}
    rows = [(40 * i + 3 * j, f"http://{d}", t) for i, (d, texts) in enumerate(sites.items()) for j, t in enumerate(texts)]
    pages = page_rows(spark, rows)
    low = states.with_domain(pages).selectExpr("domain", "ordinal", "text AS low")
    asked = low.selectExpr("domain", "ordinal", "int(ordinal % 9) AS need_before", "int(ordinal % 6) AS need_after")
    got = {(r["domain"], r["ordinal"]): (r["before"], r["after"]) for r in leads.beside(low, asked, 8, 5).collect()}
    for i, (d, texts) in enumerate(sites.items()):
        for j in range(len(texts)):
            n = 40 * i + 3 * j
            before, after = "".join(t + "\n" for t in texts[:j]), "".join("\n" + t for t in texts[j + 1 :])
            found = got.get((d, n), ("", ""))
            assert found[0].endswith(before[max(0, len(before) - n % 9) :]) and found[1].startswith(after[: n % 6])
            assert before.endswith(found[0]) and after.startswith(found[1])
    for width in (2, 1000):
        want = set()
        for d, texts in sites.items():
            whole = "\n".join(texts)
            for f, words in rules.SIGNALS.items():
                found = [whole[max(0, whole.find(w) - 80) : whole.find(w) + 150].replace("\n", " ") for w in words if w in whole]
                want |= {(d, f, i + 1, t) for i, t in enumerate(found[:2])}
        want |= {(d, "", 0, "No conversion signals detected") for d in sites if d not in {w[0] for w in want}}
        assert {tuple(r) for r in leads.verified_signals(pages).collect()} == want and any(not w[1] for w in want)
        levels = low.groupBy("domain").agg(F.min("ordinal").alias("first_ordinal")).withColumn("outreach_priority", F.col("first_ordinal") % 3 / 10 + F.col("first_ordinal") % 5 * 13)
        order = [r["domain"] for r in leads.ranked(levels, width).orderBy("outreach_rank").collect()]
        assert order == [r["domain"] for r in levels.orderBy(F.desc("outreach_priority"), "first_ordinal").collect()]


def test_prospect_keyword_over_text_and_domain(spark):
    rows = [(1, "http://homes.example", "the old funeral"), (2, "http://t.example", "funeral"), (3, "http://t.example", "x")]
    got = {r["domain"]: r["is_home"] for r in leads.sites(page_rows(spark, [(0, "http://home.example", "our funeral"), *rows])).collect()}
    assert got == {"home.example": True, "homes.example": True, "t.example": False}


def test_phones_over_seams(spark):
    """As on the joined text: over two pages, over a page of such characters alone, at the very edges."""
    import re

    random.seed(4)
    pieces = ["403", "-555", " 0101", "x", "", "+1 (", ") ", "555-01", "a 403-555-0102 b", "9" * 12, " ", "\n"]
    rows, want = [], set()
    for site in range(60):
        texts = ["".join(random.choice(pieces) for _ in range(random.randint(0, 4))) for _ in range(random.randint(1, 6))]
        rows += [(10 * site + i, f"http://s{site}.example", t) for i, t in enumerate(texts)]
        want |= {(f"s{site}.example", m) for m in re.findall(rules.PHONE, " ".join(texts))}
    assert {(r["domain"], p) for r in leads.sites(page_rows(spark, rows)).collect() for p in r["raw_phones"]} == want and len(want) > 20


def test_empty_pages(spark):
    assert leads.ranked(leads.leads(page_rows(spark, []))).count() == 0


def test_lead_forms_and_sinks(spark, tmp_path):
    found = leads.ranked(leads.leads(plans.corpus(spark, DATA))).cache()
    nested = leads.lead_result(found)
    assert {"evidence", "executive_brief", "outreach_assets", "personalization_profile", "outreach_package"} <= set(nested.columns)
    assert len(leads.canonical(found, F.expr(plans.AS_OF)).columns) == 7
    assert len(leads.contact_rows(found).columns) == 16 and len(leads.campaign_rows(found).columns) == 11
    sinks.write_json_array(nested, f"{tmp_path}/j")
    sinks.write_csv(leads.campaign_rows(found), f"{tmp_path}/c")
    sinks.write_text(leads.report_text(found), f"{tmp_path}/t")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/c")
    assert back.count() == found.count() == sources.results(spark, f"{tmp_path}/j", "domain string").count()
    for r in found.select("conversion", "lead_value", "sales_readiness", "executive_priority_score").collect():
        assert 0 <= r[0] <= 15 and 0 <= r[1] <= 30 and 0 <= r[2] <= 75 and 0 <= r[3] <= 100


def test_json_source(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"url": "http://a.example", "markdown": "x", "other": 1}, {"markdown": null}, {"url": "u"}]')
    assert [tuple(r) for r in sources.json_array(spark, str(tmp_path / "p.json")).orderBy("ordinal").collect()] == [(0, "http://a.example", "x"), (1, "", ""), (2, "u", "")]


def test_queue_script(spark):
    as_of = F.expr(plans.AS_OF)
    requests = spark.createDataFrame([(1, "a", "EMAIL", "B1 - Nurture", ""), (2, "b", "CALL", "A1 - Immediate Outreach", ""), (3, "b", "CALL", "A1 - Immediate Outreach", "")], "seq bigint, domain string, action_type string, priority string, notes string")
    actions = crm.enqueued(requests, as_of)
    rows = crm.widened(spark.createDataFrame([("a", 0), ("b", 0)], "domain string, attempts int"), crm.LEADS)
    told, acted, events, action = crm.started(rows, actions, crm.empty(spark, crm.EVENTS), as_of)
    assert {r["domain"]: (r["pipeline_stage"], r["attempts"], r["follow_up_date"]) for r in told.collect()} == {"a": (None, 0, None), "b": ("CONTACTED", 1, "2024-06-04")}
    assert {r["id"]: r["status"] for r in acted.collect()} == {1: "OPEN", 2: "IN_PROGRESS", 3: "OPEN"}
    assert [tuple(r) for r in action.collect()] == [("b", "CALL", "A1 - Immediate Outreach")]
    assert {r["domain"]: r["next_action"] for r in told.collect()} == {"a": None, "b": "CALL"}
    done, events = crm.completed(acted, events, "b", as_of, "sent")
    assert {r["id"]: r["status"] for r in done.collect()} == {1: "OPEN", 2: "COMPLETED", 3: "OPEN"}
    assert [r["event_type"] for r in crm.history(events, "b").collect()] == ["ACTION_COMPLETED", "ACTION_STARTED"]
    assert [r["notes"] for r in crm.history(events, "b").collect()] == ["sent", "CALL started | A1 - Immediate Outreach"]
    none = crm.started(rows, actions.where("id < 0"), crm.empty(spark, crm.EVENTS), as_of)
    assert none[0].where("attempts > 0").count() == 0 and none[2].count() == 0


def test_patterns_agree_with_python(spark):
    import re

    texts = ["Transparent   pricing", "contact us now", "pre-planning and plan ahead", "iframe", "nothing", "book an appointment. consultation", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[exprs.feature_score(exprs.normal_space(F.col("t")), f).alias(f) for f in rules.FEATURES])
    for r in df.collect():
        normal = re.sub(r"\s+", " ", r["t"].lower())
        for f in rules.FEATURES:
            score = sum(w for p, w in rules.PATTERNS[f].items() if re.search(p, normal))
            if f in rules.FLOORS and re.search(rules.FLOORS[f][0], normal):
                score = max(score, rules.FLOORS[f][1])
            assert r[f] == score, (r["t"], f)


def rounded(row):
    return repr(tuple(round(x, 9) if isinstance(x, float) and math.isfinite(x) else x for x in row))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = plans.queries()[name](spark, DATA)
    result = con.execute(plans.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(rounded, df.select(*columns).collect())) == sorted(map(rounded, result.fetchall()))


def test_entry():
    assert "lead_rank" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
