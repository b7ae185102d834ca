"""The query registry of the site-lead engine, and DuckDB SQL for the same results.

The driver's pages are invented prose without the rules' vocabulary, so the queries run over pages
with a phrase and a contact line added, by the same expressions on either side.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import exprs, rules
from leadloom.operators import crm, leads, sinks, states
from leadloom.operators.store import WIDTH, Store
from leadloom.plans import sheet
from leadloom.sources import files
from leadloom.sources.pages import driver_pages, json_array, results

PHRASES = [
    "contact us or request a call back", "book an appointment for a consultation", "plain words only", "online arrangement and planning tool",
    "transparent pricing and price list", "seminar workshop training speaker", "newsletter and free guide to download", "live chat with our chatbot",
    "cremation and burial at the cemetery", "grief support group and remembrance", "association annual meeting of the society", "ask the owner or the director about preplanning",
    "learn more about resources and upcoming events", "webinar presentation professional development",
]
AREAS = ["403", "416", "226", "212", "204", "587", "905", "123", "780", "604", "742", "312"]
AS_OF = "DATE '2024-06-01'"
#: Works in Spark and DuckDB alike. {p} is the page's number, {d} its domain.
ADDED = "' ' || CASE {p} % 14 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHRASES)) + " END || ' ' || CASE {p} % 5 WHEN 0 THEN 'info' WHEN 1 THEN 'Sales.Team' WHEN 2 THEN 'support' WHEN 3 THEN 'owner' ELSE 'jo' END || CAST({p} % 3 AS STRING) || '@' || CASE {p} % 4 WHEN 0 THEN {d} WHEN 1 THEN 'gmail.com' WHEN 2 THEN 'google.com' ELSE 'example.org' END || ' info@' || {d} || ' tel (' || CASE {p} % 12 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(AREAS)) + " END || ') 555-01' || lpad(CAST({p} % 100 AS STRING), 2, '0') || ' end'"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = driver_pages(spark, sf_dir).withColumn("domain", exprs.clean_domain(F.col("url")))
    return rows.select("ordinal", "url", F.expr("text || " + ADDED.format(p="ordinal", d="domain")).alias("text"))


# DuckDB: corpus, features, sites, keywords, contacts, leads, each on the one before.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
DOMAIN = "replace(split_part(regexp_replace(coalesce(url, ''), '^https?://', ''), '/', 1), 'www.', '')"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _feature(f: str) -> str:
    score = " + ".join(f"CASE WHEN regexp_matches(normal, {_q(p)}) THEN {w} ELSE 0 END" for p, w in rules.PATTERNS[f].items())
    if f in rules.FLOORS:
        pattern, floor = rules.FLOORS[f]
        score = f"greatest({score}, CASE WHEN regexp_matches(normal, {_q(pattern)}) THEN {floor} ELSE 0 END)"
    return score


def _in(x: str, values: list[str]) -> str:
    return f"{x} IN ({', '.join(map(_q, values))})"


_bad = " OR ".join(f"contains(e, {_q(b)})" for b in rules.BAD_ANYWHERE)
_valid = f"regexp_full_match(e, {_q(rules.EMAIL)})"
_dig = "regexp_replace(p, '[^0-9]', '', 'g')"
_bare = f"CASE WHEN length({_dig}) = 11 AND {_dig} LIKE '1%' THEN substr({_dig}, 2) ELSE {_dig} END"
_phone_ok = f"NOT ({_dig} LIKE '19%' OR {_dig} LIKE '20%') AND length({_bare}) = 10 AND NOT ({_bare} LIKE '0%' OR {_bare} LIKE '1%')"
_norm = f"CASE WHEN length({_dig}) = 10 THEN '+1' || {_dig} WHEN length({_dig}) = 11 AND {_dig} LIKE '1%' THEN '+' || {_dig} ELSE '' END"
_region = f"CASE WHEN {_norm} = '' THEN 0 WHEN {_in(f'substr({_norm}, 3, 3)', rules.HOME_AREAS)} THEN 100 WHEN {_in(f'substr({_norm}, 3, 3)', rules.REGION_AREAS)} THEN 70 ELSE 20 END"
_known = _in(f"substr({_bare}, 1, 3)", rules.RANKED_AREAS)
_pscore = f"CASE WHEN NOT ({_phone_ok}) THEN 0 WHEN length({_dig}) = 10 THEN CASE WHEN {_known} THEN 100 ELSE 40 END ELSE CASE WHEN {_known} THEN 90 ELSE 30 END END"
_local, _host = "split_part(e, '@', 1)", "split_part(e, '@', -1)"
_escore = f"CASE WHEN NOT {_valid} OR {_in(_host, rules.BAD_HOSTS)} OR {_in(_local, rules.BAD_LOCALS)} THEN 0 ELSE CASE WHEN {_host} = domain THEN 60 ELSE 0 END + CASE WHEN {_in(_local, rules.ROLE_LOCALS)} THEN 25 ELSE 0 END + CASE WHEN NOT {_in(_host, rules.FREE_HOSTS)} THEN 15 ELSE 0 END END"

_PARTS = {
    "corpus": f"SELECT ordinal, url, domain, text || {ADDED.format(p='ordinal', d='domain')} AS text FROM (SELECT page_id AS ordinal, coalesce(url, '') AS url, coalesce(html, '') AS text, {DOMAIN} AS domain FROM pages) WHERE domain <> ''",
    "features": "SELECT ordinal, url, domain, text, " + ", ".join(f"{_feature(f)} AS score_{f}" for f in rules.FEATURES) + f" FROM (SELECT *, regexp_replace(lower(text), {_q(_SPACE)}, ' ', 'g') AS normal FROM corpus)",
    "sites": "SELECT domain, CAST(count(*) AS INTEGER) AS pages, min(ordinal) AS first_ordinal, " + ", ".join(f"max(score_{f}) >= {rules.SHOWN} AS has_{f}, arg_min(url, ordinal) FILTER (score_{f} >= {rules.SHOWN}) AS url_{f}, arg_min(substr(text, 1, 300), ordinal) FILTER (score_{f} >= {rules.SHOWN}) AS snippet_{f}" for f in rules.FEATURES) + " FROM features GROUP BY domain",
    "joined": "SELECT domain, lower(string_agg(text, ' ' ORDER BY ordinal)) AS low, lower(domain) AS name FROM corpus GROUP BY domain",
    "keywords": "SELECT domain, " + ", ".join(" + ".join(f"CASE WHEN contains(low, {_q(w)}) THEN 1 ELSE 0 END" for w in rules.KEYWORDS[g]) + f" AS n_{g}" for g in ("seminar", "community", "event", "education", "industry", "association")) + ", " + ", ".join(f"contains(low, {_q(w)}) AS kw_{w}" for w in rules.KEYWORDS["role"]) + ", " + ", ".join("(" + " OR ".join(f"contains(low || ' ' || name, {_q(w)})" for w in rules.KEYWORDS[g]) + f") AS is_{g}" for g in ("home", "society")) + " FROM joined",
    "raw_emails": f"SELECT DISTINCT domain, unnest(regexp_extract_all(text, {_q(rules.EMAIL)})) AS email FROM corpus",
    "raw_phones": f"SELECT DISTINCT domain, unnest(regexp_extract_all(string_agg(text, ' ' ORDER BY ordinal), {_q(rules.PHONE)})) AS phone FROM corpus GROUP BY domain",
    "good_emails": f"SELECT DISTINCT domain, e FROM (SELECT domain, lower(email) AS e FROM raw_emails) WHERE {_valid} AND NOT ({_bad})",
    "good_phones": f"SELECT DISTINCT domain, trim(p) AS p FROM (SELECT domain, phone AS p FROM raw_phones) WHERE {_phone_ok}",
    "best_email": f"SELECT domain, max(s).e AS any_email, max(s).score AS email_confidence FROM (SELECT domain, struct_pack(score := {_escore}, e := e) AS s FROM good_emails) WHERE s.score > 0 GROUP BY domain",
    "best_phone": f"SELECT domain, max(s).p AS primary_phone, max(s).score AS phone_confidence FROM (SELECT domain, struct_pack(score := CAST(round((7 * ({_pscore}) + 3 * ({_region})) / 10.0) AS INTEGER), p := p) AS s FROM good_phones) WHERE s.score > 0 GROUP BY domain",
    "signals": f"SELECT *, {_region} AS phone_region_score, {_norm} AS normalized_phone FROM (SELECT sites.*, keywords.* EXCLUDE (domain), coalesce(any_email, '') AS any_email, coalesce(email_confidence, 0) AS email_confidence, coalesce(primary_phone, '') AS primary_phone, coalesce(primary_phone, '') AS p, coalesce(phone_confidence, 0) AS phone_confidence, (SELECT count(*) FROM raw_emails r WHERE r.domain = sites.domain) AS n_emails_raw, (SELECT count(*) FROM raw_phones r WHERE r.domain = sites.domain) AS n_phones_raw, (SELECT count(*) FROM good_emails r WHERE r.domain = sites.domain) AS n_emails, (SELECT count(*) FROM good_phones r WHERE r.domain = sites.domain) AS n_phones FROM sites JOIN keywords USING (domain) LEFT JOIN best_email USING (domain) LEFT JOIN best_phone USING (domain))",
}
_leads = "signals"
for _name, _text in sheet.duckdb_sheet():
    _leads = f"(SELECT *, {_text} AS {_name} FROM {_leads})"
_PARTS["leads"] = f"SELECT * FROM {_leads}"


def oracle(select: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({t})" for n, t in _PARTS.items()) + f" {select}"


SHEET_GROUPS: dict[str, list[str]] = {
    "base_scores": ["conversion", "opportunity", "lead_value", "priority", "outreach_priority", "outreach_level"],
    "lead_types": ["lead_type", "recommended_package", "recommended_services", "classification_reason", "email_angle"],
    "readiness": ["contact_confidence", "recommended_contact_method", "sales_readiness", "sales_stage"],
    "pain_points": ["pain_points"],
    "pitch": ["pitch"],
    "observations": ["website_observations"],
    "fits": ["seminar_fit", "community_fit", "education_fit", "association_fit"],
    "prospect_type": ["prospect_type"],
    "contact_role": ["target_contact_role"],
    "campaign": ["campaign_type", "recommended_subject", "first_email_angle", "follow_up_days", "follow_up_priority", "campaign_priority", "recommended_message", "priority_score", "campaign_sequence", "decision_maker_reason", "opening_hook", "email_personalization", "call_script_angle"],
    "revenue": ["revenue_opportunity_score", "revenue_tier", "revenue_reason"],
    "opportunity_scores": ["digital_opportunity_score", "partnership_opportunity_score", "digital_shown", "partnership_shown", "sales_priority_score"],
    "executive": ["executive_priority_score", "executive_action", "executive_summary"],
    "sales_lane": ["sales_lane", "recommended_pitch"],
    "crm_status": ["crm_status", "contact_quality_score", "primary_email"],
    "temperature": ["outreach_readiness_score", "lead_temperature", "outreach_strategy", "best_contact_channel", "recommended_first_touch"],
    "outreach_bundle": ["outreach_priority_level", "outreach_channel", "first_contact_strategy", "offer_angle", "estimated_sales_motion", "sales_message_angle"],
    "brief": ["why_now", "primary_pain", "recommended_first_message", "expected_objection", "response_strategy"],
    "assets": ["asset_subject", "opening_line", "first_email_body", "phone_opener", "follow_up_day_3", "follow_up_day_7", "email_subject", "custom_opening"],
    "canonical_priority": ["canonical_quality", "canonical_priority", "priority_level", "best_contact_method", "crm_state", "crm_stage", "crm_next_action", "level_state", "level_stage", "level_next_action", "level_follow_up"],
}
Query = Callable[[SparkSession, str], DataFrame]


def _sheet_query(columns: list[str]) -> Query:
    return lambda spark, sf_dir: leads.leads(corpus(spark, sf_dir)).select("domain", *columns)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lead writes from the events table: four sites' worth of fields by arithmetic."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("seq"), F.expr("'site' || CAST(user_id AS STRING) || '.example.com'").alias("domain"), F.expr("CASE event_id % 4 WHEN 0 THEN 'A1 - Immediate Outreach' WHEN 1 THEN 'A2 - Priority Outreach' WHEN 2 THEN 'B1 - Nurture' ELSE 'Research Required' END").alias("priority_level"), F.col("event_type"), F.lit(0).alias("attempts"))


_LOG = "SELECT event_id AS seq, 'site' || CAST(user_id AS STRING) || '.example.com' AS domain, CASE event_id % 4 WHEN 0 THEN 'A1 - Immediate Outreach' WHEN 1 THEN 'A2 - Priority Outreach' WHEN 2 THEN 'B1 - Nurture' ELSE 'Research Required' END AS priority_level, event_type, 0 AS attempts FROM events"
_DUE = f"CAST({AS_OF} + CAST(CASE WHEN priority_level LIKE 'A1%' THEN 0 WHEN priority_level LIKE 'A2%' THEN 2 WHEN priority_level LIKE 'B1%' THEN 7 ELSE 14 END AS INTEGER) AS VARCHAR)"
_ACTIONS = f"SELECT seq AS id, domain, event_type AS action_type, priority_level AS priority, 'OPEN' AS status, {_DUE} AS due_date FROM ({_LOG})"
_FIRST = f"SELECT id, domain, action_type FROM ({_ACTIONS}) ORDER BY CASE WHEN priority LIKE 'A1%' THEN 1 WHEN priority LIKE 'A2%' THEN 2 ELSE 3 END, due_date, id LIMIT 1"


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return crm.enqueued(log.select("seq", "domain", F.col("event_type").alias("action_type"), F.col("priority_level").alias("priority"), F.lit("").alias("notes")), F.expr(AS_OF))


def _crm(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = crm.upserted(_log(spark, sf_dir)).select("domain", "priority_level", "attempts", F.lit("NEW").alias("pipeline_stage"), F.lit("").alias("next_action"), F.lit("").alias("follow_up_date"))
    return rows, _actions(spark, sf_dir), crm.empty(spark, crm.EVENTS)


def _after_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, *_ = crm.started(*_crm(spark, sf_dir), F.expr(AS_OF))
    return rows.select("domain", "pipeline_stage", "attempts", "next_action", "follow_up_date")


def _after_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, actions, events, _ = crm.started(*_crm(spark, sf_dir), F.expr(AS_OF))
    name = crm.next_action(_actions(spark, sf_dir)).first()
    done, _ = crm.completed(actions, events, name["domain"] if name else "", F.expr(AS_OF))
    return done.groupBy("status").agg(F.count("*").alias("n"))


def _events_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of the site whose action was started and completed."""
    name = crm.next_action(_actions(spark, sf_dir)).first()
    domain = name["domain"] if name else ""
    _, actions, events, _ = crm.started(*_crm(spark, sf_dir), F.expr(AS_OF))
    _, events = crm.completed(actions, events, domain, F.expr(AS_OF), "done")
    return crm.history(events, domain)


def _started_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, actions, _, _ = crm.started(*_crm(spark, sf_dir), F.expr(AS_OF))
    return actions.where("status <> 'OPEN'").select("id", "domain", "action_type", "priority", "status", "due_date", "started_at")


def _store(spark: SparkSession, sf_dir: str) -> Store:
    """A store after two sessions: leads of even events, all actions, a start; then leads of odd events, a compaction, a completion."""
    path, as_of = f"{files.shared_dir(spark)}/leadloom/store-{uuid.uuid4().hex}", F.expr(AS_OF)
    rows = _log(spark, sf_dir).select("seq", "domain", "priority_level", F.col("event_type").alias("contact_method"), F.lit("NEW").alias("pipeline_stage"), F.lit("").alias("next_action"), F.lit("").alias("follow_up_date"))
    first = Store(spark, path)
    first.upsert("even", rows.where("seq % 2 = 0"))
    first.enqueue("queue", _log(spark, sf_dir).select("seq", "domain", F.col("event_type").alias("action_type"), F.col("priority_level").alias("priority"), F.lit("").alias("notes")), as_of)
    first.start_next("start", as_of)
    second = Store(spark, path)
    second.upsert("odd", rows.where("seq % 2 = 1"))
    second.upsert("odd", rows.where("seq % 2 = 0"))  # known: no effect
    second.compact()
    acted = second.table("actions").where("status = 'IN_PROGRESS'").first()
    second.complete("complete", acted["domain"] if acted else "", as_of, "done")
    return second


def _stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leads written as one array in order of rank, and read back: ordinal is the place in the array."""
    path = f"{files.shared_dir(spark)}/leadloom/results-{uuid.uuid4().hex}"
    sinks.write_json_array(leads.lead_result(leads.ranked(leads.leads(corpus(spark, sf_dir)))), path)
    back = results(spark, path, "outreach_rank int, domain string, pages int, outreach_priority double, missing array<string>, outreach_package struct<crm:struct<executive_action:string>>")
    return back.select("ordinal", "outreach_rank", "domain", "pages", "outreach_priority", F.array_join("missing", ",").alias("missing"), "outreach_package.crm.executive_action")


def _pages_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages written as one JSON array in order of their ids, and read back by ranges of bytes."""
    path, pages = f"{files.shared_dir(spark)}/leadloom/pages-{uuid.uuid4().hex}", driver_pages(spark, sf_dir)
    first = pages.agg(F.min("ordinal")).first()[0]
    sinks.write_json_array(pages.select("ordinal", "url", F.col("text").alias("markdown")), path, "ordinal", 0 if first is None else first)
    back = json_array(spark, path, as_one=True)
    return back.select("ordinal", "url", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def _migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions of a store from before starts and completions were kept, read by the schema of today, and one started."""
    path = f"{files.shared_dir(spark)}/leadloom/store-{uuid.uuid4().hex}"
    old = _actions(spark, sf_dir).drop("started_at", "completed_at").withColumns({"whole": F.lit(True), "place": F.lit(0).cast("bigint")})
    old.write.parquet(f"{path}/log/actions/{1:0{WIDTH}}-old")
    files.created(spark, f"{path}/commits/{1:0{WIDTH}}-old", '{"actions": 0, "events": 0}')
    store = Store(spark, path)
    store.start_next("start", F.expr(AS_OF))
    return store.table("actions").groupBy("status", "started_at", "completed_at").agg(F.count("*").alias("n"))


def _phones_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(AREAS))
    p = F.expr(f"CASE c_custkey % 3 WHEN 0 THEN '+1 ' WHEN 1 THEN '1-' ELSE '' END || CASE c_custkey % 12 {text} END || '-555-01' || lpad(CAST(c_custkey % 100 AS STRING), 2, '0')")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", p.alias("phone"))
    p = F.col("phone")
    return c.select("c_custkey", exprs.valid_phone(p).alias("valid"), exprs.normal_phone(p).alias("normal"), exprs.region_score(p).alias("region"), exprs.phone_score(p).alias("score"), F.array_join(exprs.region_reasons(p), ", ").alias("reasons"))


_CUSTOMERS = "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '+1 ' WHEN 1 THEN '1-' ELSE '' END || CASE c_custkey % 12 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(AREAS)) + " END || '-555-01' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS p FROM customer"


def _long_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = leads.sites(corpus(spark, sf_dir))
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"evidence_{f}.url").alias("url"), F.col(f"evidence_{f}.snippet").alias("snippet")) for f in rules.FEATURES])
    return sites.select("domain", F.explode(rows).alias("e")).where("e.url IS NOT NULL").select("domain", "e.feature", "e.url", "e.snippet")


def _canonical_whole(pages: DataFrame) -> DataFrame:
    """All fields of the seven groups, side by side; the nested ones by how many there are and by one of their fields."""
    groups = leads.canonical(leads.leads(pages), F.expr(AS_OF)).select("company.*", "website.*", "contacts.*", "scoring.*", "opportunity.*", "outreach.*", "crm.*")
    told = {"n_evidence": F.size(F.map_keys("evidence")), "cta": F.col("outreach_package.email.cta"), "gap": F.col("personalization_profile.business_context.digital_gap_score")}
    return groups.withColumns(told | {c: F.array_join(c, ", ") for c in ("found", "missing", "emails_found", "phones_found", "phone_reason")}).drop("evidence", "outreach_package", "personalization_profile")


def _profile(pages: DataFrame) -> DataFrame:
    """The fields of the personalization profile, the outreach package and the outreach assets, side by side."""
    found = leads.lead_result(leads.leads(pages))
    profile, package = "personalization_profile", "outreach_package"
    own = {"email": ("subject", "opening", "body", "angle", "cta"), "phone": ("opening", "strategy", "message_angle"), "follow_up": ("day_3", "day_7"), "crm": ("executive_action", "sales_motion", "campaign_sequence", "next_action")}
    return found.select("domain", F.array_join(f"{profile}.website_observations", "; ").alias("observations"), f"{profile}.business_context.*", f"{profile}.custom_opening", f"{profile}.recommended_angle", *[F.col(f"{package}.{g}.{c}").alias(f"{g}_{c}" + "_" * (f"{g}_{c}" in ("email_subject", "follow_up_day_3", "follow_up_day_7"))) for g, names in own.items() for c in names], "outreach_assets.*", *[f"executive_brief.{c}" for c in ("why_now", "response_strategy")], "digital_opportunity_score", "partnership_opportunity_score")


def _signals_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT domain, {_q(f)} AS feature, {i} AS place, strpos(low, {_q(w)}) AS pos, low FROM lines" for f, ws in rules.SIGNALS.items() for i, w in enumerate(ws))
    return oracle(f", lines AS (SELECT domain, lower(string_agg(text, chr(10) ORDER BY ordinal)) AS low FROM corpus GROUP BY domain), hits AS ({rows}) SELECT domain, feature, CAST(row_number() OVER (PARTITION BY domain, feature ORDER BY place) AS INTEGER) AS place, replace(substr(low, greatest(pos - 80, 1), pos + 150 - greatest(pos - 80, 1)), chr(10), ' ') AS snippet FROM hits WHERE pos > 0 QUALIFY row_number() OVER (PARTITION BY domain, feature ORDER BY place) <= 2 UNION ALL SELECT domain, '', 0, 'No conversion signals detected' FROM hits GROUP BY domain HAVING max(pos) = 0")


def queries() -> dict[str, Query]:
    on = lambda f: lambda spark, sf_dir: f(corpus(spark, sf_dir))
    found: dict[str, Query] = {
        "domain_pages": lambda spark, sf_dir: states.with_domain(driver_pages(spark, sf_dir)).groupBy("domain").agg(F.count("*").alias("pages"), F.min("ordinal").alias("first_ordinal")),
        "page_feature_scores": on(lambda p: leads.page_features(p).select("ordinal", "domain", *[f"score_{f}" for f in rules.FEATURES])),
        "domain_features": on(lambda p: leads.feature_sets(leads.sites(p)).select("domain", "pages", F.array_join("found", ",").alias("found"), F.array_join("missing", ",").alias("missing"))),
        "feature_evidence": _long_evidence,
        "signal_verify": on(leads.verified_signals),
        "raw_emails": on(lambda p: leads.sites(p).select("domain", F.explode("raw_emails").alias("email"))),
        "raw_phones": on(lambda p: leads.sites(p).select("domain", F.explode("raw_phones").alias("phone"))),
        "phone_rules": _phones_of_customers,
        "clean_emails": on(lambda p: leads.contacts(leads.sites(p)).select("domain", F.explode("emails_found").alias("email"))),
        "clean_phones": on(lambda p: leads.contacts(leads.sites(p)).select("domain", F.explode("phones_found").alias("phone"))),
        "best_email": on(lambda p: leads.contacts(leads.sites(p)).where("email_confidence > 0").select("domain", "any_email", "email_confidence")),
        "best_phone": on(lambda p: leads.contacts(leads.sites(p)).where("phone_confidence > 0").select("domain", "primary_phone", "phone_confidence", "normalized_phone", "phone_region_score")),
        "lead_rank": on(lambda p: leads.ranked(leads.leads(p)).select("outreach_rank", "domain", "outreach_priority", "outreach_level", F.array_join("missing", ",").alias("missing"))),
        "top_lead": on(lambda p: leads.leads(p).orderBy(F.desc("executive_priority_score"), "first_ordinal").limit(1).select("domain", "executive_priority_score")),
        "contact_csv": on(lambda p: leads.contact_rows(leads.leads(p))),
        "campaign_csv": on(lambda p: leads.campaign_rows(leads.leads(p))),
        "report_text": on(lambda p: leads.report_text(leads.leads(p))),
        "lead_report_md": on(lambda p: leads.top_lead_markdown(leads.leads(p))),
        "canonical": on(lambda p: leads.canonical(leads.leads(p), F.expr(AS_OF)).select("company.domain", "outreach.priority_score", "crm.follow_up_date", "crm.level_follow_up_date")),
        "canonical_whole": on(_canonical_whole),
        "lead_profile": on(_profile),
        "action_due": lambda spark, sf_dir: _actions(spark, sf_dir).select("id", "domain", "priority", "due_date"),
        "open_actions": lambda spark, sf_dir: crm.queue_places(_actions(spark, sf_dir)),
        "next_action": lambda spark, sf_dir: crm.next_action(_actions(spark, sf_dir)).select("id", "domain", "action_type"),
        "crm_upsert": lambda spark, sf_dir: crm.upserted(_log(spark, sf_dir)).select("domain", "priority_level", "event_type", "attempts"),
        "crm_after_start": _after_start,
        "crm_after_complete": _after_complete,
        "action_started": lambda spark, sf_dir: crm.started(*_crm(spark, sf_dir), F.expr(AS_OF))[3],
        "actions_after_start": _started_rows,
        "events_after": _events_after,
        "open_queue": lambda spark, sf_dir: crm.open_actions(_actions(spark, sf_dir)).select("id", "domain", "action_type", "priority", "due_date"),
        "crm_records": on(lambda p: crm.records(leads.leads(p), F.expr(AS_OF))),
        "store_leads": lambda spark, sf_dir: _store(spark, sf_dir).table("leads").select("domain", "pipeline_stage", "priority_level", "contact_method", "attempts", "next_action", "follow_up_date"),
        "store_actions": lambda spark, sf_dir: _store(spark, sf_dir).table("actions").select("id", "domain", "action_type", "priority", "status", "due_date", "completed_at"),
        "store_events": lambda spark, sf_dir: _store(spark, sf_dir).table("events"),
        "results_array": _stored_results,
        "pages_array": _pages_array,
        "actions_migrated": _migrated,
        "best_scores": on(lambda p: leads.sites(p).select("domain", *[f"best_{f}" for f in rules.FEATURES])),
        "site_counts": on(lambda p: leads.sites(p).agg(F.count("*").alias("sites"), F.sum("pages").alias("pages"))),
        "event_history": lambda spark, sf_dir: _log(spark, sf_dir).groupBy("domain").agg(F.max("seq").alias("last_id"), F.count("*").alias("n")),
    }
    return found | {n: _sheet_query(c) for n, c in SHEET_GROUPS.items()}


def oracle_sql() -> dict[str, str]:
    have = lambda want: "concat_ws(',', " + ", ".join(f"CASE WHEN {want}has_{f} THEN '{f}' END" for f in sorted(rules.FEATURES)) + ")"
    evidence = " UNION ALL ".join(f"SELECT domain, '{f}' AS feature, url_{f} AS url, snippet_{f} AS snippet FROM sites WHERE url_{f} IS NOT NULL" for f in rules.FEATURES)
    found = {
        "domain_pages": f"SELECT domain, count(*) AS pages, min(page_id) AS first_ordinal FROM (SELECT page_id, {DOMAIN} AS domain FROM pages) WHERE domain <> '' GROUP BY domain",
        "page_feature_scores": oracle("SELECT ordinal, domain, " + ", ".join(f"CAST(score_{f} AS INTEGER) AS score_{f}" for f in rules.FEATURES) + " FROM features"),
        "domain_features": oracle(f"SELECT domain, pages, {have('')} AS found, {have('NOT ')} AS missing FROM sites"),
        "feature_evidence": oracle(evidence),
        "signal_verify": _signals_sql(),
        "raw_emails": oracle("SELECT domain, email FROM raw_emails"),
        "raw_phones": oracle("SELECT domain, phone FROM raw_phones"),
        "phone_rules": f"SELECT c_custkey, {_phone_ok} AS valid, {_norm} AS normal, {_region} AS region, {_pscore} AS score FROM ({_CUSTOMERS})",
        "clean_emails": oracle("SELECT domain, e AS email FROM good_emails"),
        "clean_phones": oracle("SELECT domain, p AS phone FROM good_phones"),
        "best_email": oracle("SELECT domain, any_email, email_confidence FROM best_email"),
        "best_phone": oracle("SELECT domain, primary_phone, phone_confidence, normalized_phone, phone_region_score FROM signals WHERE phone_confidence > 0"),
        "lead_rank": oracle(f"SELECT CAST(row_number() OVER (ORDER BY outreach_priority DESC, first_ordinal) AS INTEGER) AS outreach_rank, domain, outreach_priority, outreach_level, {have('NOT ')} AS missing FROM leads"),
        "top_lead": oracle("SELECT domain, executive_priority_score FROM leads ORDER BY executive_priority_score DESC, first_ordinal LIMIT 1"),
        "canonical": oracle(f"SELECT domain, canonical_priority AS priority_score, CAST({AS_OF} + 14 AS VARCHAR) AS follow_up_date, CAST({AS_OF} + CAST(level_follow_up AS INTEGER) AS VARCHAR) AS level_follow_up_date FROM leads"),
        "action_due": f"SELECT id, domain, priority, due_date FROM ({_ACTIONS})",
        "open_actions": f"SELECT domain, id, CAST(row_number() OVER (PARTITION BY domain ORDER BY due_date, id) AS INTEGER) AS place FROM ({_ACTIONS})",
        "next_action": _FIRST,
        "crm_upsert": f"SELECT domain, arg_max(priority_level, seq) AS priority_level, arg_max(event_type, seq) AS event_type, max(attempts) AS attempts FROM ({_LOG}) GROUP BY domain",
        "crm_after_start": f"WITH f AS ({_FIRST}) SELECT d.domain, CASE WHEN f.domain IS NULL THEN 'NEW' ELSE 'CONTACTED' END AS pipeline_stage, CASE WHEN f.domain IS NULL THEN 0 ELSE 1 END AS attempts, CASE WHEN f.domain IS NULL THEN '' ELSE f.action_type END AS next_action, CASE WHEN f.domain IS NULL THEN '' ELSE CAST({AS_OF} + 3 AS VARCHAR) END AS follow_up_date FROM (SELECT DISTINCT domain FROM ({_LOG})) d LEFT JOIN f USING (domain)",
        "crm_after_complete": f"WITH f AS ({_FIRST}) SELECT CASE WHEN f.id IS NULL THEN 'OPEN' ELSE 'COMPLETED' END AS status, count(*) AS n FROM ({_ACTIONS}) a LEFT JOIN f ON a.id = f.id GROUP BY 1",
        "event_history": f"SELECT domain, max(seq) AS last_id, count(*) AS n FROM ({_LOG}) GROUP BY domain",
    }
    reason = "CASE phone_region_score WHEN 0 THEN 'Invalid phone format' WHEN 100 THEN 'Valid NANP phone number, Alberta area code' WHEN 70 THEN 'Valid NANP phone number, Canadian area code' ELSE 'Valid NANP phone number, Non-local area code' END"
    phones = _phone_ok.replace(" p,", " x,").replace("(p,", "(x,")
    emails = f"regexp_full_match(x, {_q(rules.EMAIL)}) AND NOT (" + " OR ".join(f"contains(x, {_q(b)})" for b in rules.BAD_ANYWHERE) + ")"
    listed = f", es AS (SELECT domain, list_filter(list_transform(list_sort(list(email)), lambda x: lower(x)), lambda x: {emails}) AS l FROM raw_emails GROUP BY domain), el AS (SELECT domain, list_concat(list_reverse(list_filter(l, lambda x: ends_with(x, '@' || domain))), list_filter(l, lambda x: NOT ends_with(x, '@' || domain))) AS l FROM es), e AS (SELECT domain, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ', ') AS emails FROM el), pl AS (SELECT domain, list_transform(list_filter(list_sort(list(phone)), lambda x: {phones}), lambda x: trim(x)) AS l FROM raw_phones GROUP BY domain), f AS (SELECT domain, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ', ') AS phones FROM pl)"
    found |= {
        "contact_csv": oracle(f"SELECT domain, lead_type, sales_stage, sales_readiness, outreach_priority, '' AS outreach_level, any_email AS primary_email, primary_phone, normalized_phone, email_confidence, phone_confidence, phone_region_score, {reason} AS phone_reason, canonical_quality AS contact_quality_score, crm_state AS crm_status, recommended_pitch FROM leads"),
        "campaign_csv": oracle(f"{listed} SELECT leads.domain AS company, 'https://' || leads.domain AS website, coalesce(emails, '') AS emails, coalesce(phones, '') AS phones, campaign_type, '' AS recommended_subject, '' AS first_email_angle, 0 AS seminar_fit, sales_stage, '' AS follow_up_priority, '' AS follow_up_days FROM leads LEFT JOIN e USING (domain) LEFT JOIN f USING (domain)"),
        "canonical_whole": oracle(f"{listed} SELECT leads.domain AS domain, '' AS campaign, CAST(len(string_split({have('')}, ',')) - CASE WHEN {have('')} = '' THEN 1 ELSE 0 END AS INTEGER) AS n_evidence, offer_angle AS cta, opportunity AS gap, lead_type, prospect_type, pages, replace({have('')}, ',', ', ') AS found, replace({have('NOT ')}, ',', ', ') AS missing, coalesce(emails, '') AS emails_found, coalesce(phones, '') AS phones_found, any_email AS primary_email, email_confidence, primary_phone, phone_confidence, normalized_phone, phone_region_score, {reason} AS phone_reason, canonical_quality AS contact_quality_score, conversion, opportunity, lead_value, priority, sales_readiness, sales_stage, executive_priority_score, revenue_opportunity_score, revenue_tier, revenue_reason, digital_shown AS digital_opportunity_score, partnership_shown AS partnership_opportunity_score, campaign_type, outreach_priority, outreach_channel, recommended_pitch, canonical_priority AS priority_score, priority_level, best_contact_method, crm_state AS crm_status, sales_lane, crm_stage AS pipeline_stage, crm_next_action AS next_action, CAST({AS_OF} + 14 AS VARCHAR) AS follow_up_date, 0 AS attempt_count, sales_readiness AS engagement_score, CAST({AS_OF} + CAST(level_follow_up AS INTEGER) AS VARCHAR) AS level_follow_up_date FROM leads LEFT JOIN e USING (domain) LEFT JOIN f USING (domain)"),
        "lead_profile": oracle("SELECT domain, website_observations AS observations, pages AS pages_indexed, opportunity AS digital_gap_score, revenue_tier, executive_priority_score, custom_opening, sales_message_angle AS recommended_angle, asset_subject AS email_subject_, opening_line AS email_opening, first_email_body AS email_body, email_angle, offer_angle AS email_cta, phone_opener AS phone_opening, first_contact_strategy AS phone_strategy, sales_message_angle AS phone_message_angle, follow_up_day_3 AS follow_up_day_3_, follow_up_day_7 AS follow_up_day_7_, executive_action AS crm_executive_action, estimated_sales_motion AS crm_sales_motion, campaign_sequence AS crm_campaign_sequence, recommended_first_touch AS crm_next_action, asset_subject AS email_subject, opening_line, first_email_body, phone_opener, follow_up_day_3, follow_up_day_7, why_now, response_strategy, digital_shown AS digital_opportunity_score, partnership_shown AS partnership_opportunity_score FROM leads"),
        "report_text": oracle(f"SELECT domain, domain || chr(10) || 'Pages: ' || pages || chr(10) || 'Conversion: ' || conversion || chr(10) || 'Opportunity: ' || opportunity || chr(10) || 'Value: ' || lead_value || chr(10) || 'Priority: ' || priority || chr(10) || 'Missing: ' || replace({have('NOT ')}, ',', ', ') || chr(10) || 'Pitch: ' || pitch AS report FROM leads"),
        "lead_report_md": oracle("SELECT domain, array_to_string(list_concat(['# Conversion Opportunity Report', '', '## Business', domain, '', '## Executive Classification', '', '- Action: ' || executive_action, '- Priority: ' || priority, '- Temperature: ' || lead_temperature, '- CRM Status: ' || crm_status, '', '## Scores', '', '- Executive Priority: ' || executive_priority_score, '- Opportunity Score: ' || opportunity, '- Lead Value: ' || lead_value, '- Revenue Opportunity: ' || revenue_opportunity_score, '', '## Website Findings', ''], list_transform(string_split(website_observations, '; '), lambda x: '- ' || x), ['', '## Missing Opportunities', ''], " + f"list_transform(list_filter(string_split({have('NOT ')}, ','), lambda x: x <> ''), lambda x: '- ' || x)" + ", ['', '## Contact Information', '', 'Email: ' || primary_email, 'Phone: ' || primary_phone, 'Recommended Contact: ' || target_contact_role, '', '## Executive Brief', '', " + ", ".join(f"'### {c}', {c}, ''" for c in ("why_now", "primary_pain", "recommended_first_message", "expected_objection", "response_strategy")) + ", '## Outreach Package', '', 'Subject:', asset_subject, '', 'Opening:', opening_line, '', 'Body:', first_email_body, '', '## Phone Script', '', phone_opener]), chr(10)) AS report FROM leads ORDER BY executive_priority_score DESC, first_ordinal LIMIT 1"),
        "crm_records": oracle(f"SELECT domain, level_stage AS pipeline_stage, level_state AS crm_status, canonical_priority AS priority_score, priority_level, best_contact_method AS contact_method, any_email AS primary_email, primary_phone, 0 AS attempts, CASE WHEN canonical_raw >= 180 THEN 'Send ' || best_contact_method || ' outreach' WHEN canonical_raw >= 120 THEN 'Prepare ' || best_contact_method || ' sequence' ELSE 'Research prospect' END AS next_action, CAST({AS_OF} + CASE WHEN canonical_raw >= 180 THEN 2 WHEN canonical_raw >= 120 THEN 5 ELSE 14 END AS VARCHAR) AS follow_up_date, CAST({AS_OF} AS VARCHAR) AS updated_at FROM leads"),
        "action_started": f"WITH f AS ({_FIRST}) SELECT f.domain, f.action_type AS action, a.priority FROM f JOIN ({_ACTIONS}) a USING (id)",
        "actions_after_start": f"WITH f AS ({_FIRST}) SELECT a.id, a.domain, a.action_type, a.priority, 'IN_PROGRESS' AS status, a.due_date, CAST({AS_OF} AS VARCHAR) AS started_at FROM f JOIN ({_ACTIONS}) a ON a.id = f.id",
        "events_after": f"WITH f AS ({_FIRST}) SELECT CAST(1 AS BIGINT) AS id, f.domain, 'ACTION_STARTED' AS event_type, f.action_type || ' started | ' || a.priority AS notes, CAST({AS_OF} AS VARCHAR) AS created_at FROM f JOIN ({_ACTIONS}) a ON a.id = f.id UNION ALL SELECT CAST(2 AS BIGINT), f.domain, 'ACTION_COMPLETED', 'done', CAST({AS_OF} AS VARCHAR) FROM f",
        "open_queue": f"SELECT id, domain, action_type, priority, due_date FROM ({_ACTIONS}) ORDER BY due_date, id",
    }
    late = "seq + CASE WHEN seq % 2 = 1 THEN 1000000000000 ELSE 0 END"
    found |= {
        "store_leads": f"WITH f AS ({_FIRST}), l AS (SELECT domain, arg_max(priority_level, {late}) AS priority_level, arg_max(event_type, {late}) AS contact_method, bool_or(seq % 2 = 0) AS early, bool_or(seq % 2 = 1) AS late FROM ({_LOG}) GROUP BY domain), m AS (SELECT l.*, f.action_type, f.domain IS NOT NULL AND early AS mine FROM l LEFT JOIN f USING (domain)) SELECT domain, CASE WHEN mine AND NOT late THEN 'CONTACTED' ELSE 'NEW' END AS pipeline_stage, priority_level, contact_method, CASE WHEN mine THEN 1 ELSE 0 END AS attempts, CASE WHEN mine AND NOT late THEN action_type ELSE '' END AS next_action, CASE WHEN mine AND NOT late THEN CAST({AS_OF} + 3 AS VARCHAR) ELSE '' END AS follow_up_date FROM m",
        "store_actions": f"WITH f AS ({_FIRST}) SELECT a.id, a.domain, a.action_type, a.priority, CASE WHEN f.id IS NULL THEN 'OPEN' ELSE 'COMPLETED' END AS status, a.due_date, CASE WHEN f.id IS NULL THEN NULL ELSE CAST({AS_OF} AS VARCHAR) END AS completed_at FROM ({_ACTIONS}) a LEFT JOIN f ON a.id = f.id",
        "store_events": found["events_after"],
        "pages_array": "SELECT page_id - min(page_id) OVER () AS ordinal, coalesce(url, '') AS url, CAST(length(coalesce(html, '')) AS INTEGER) AS n_chars, md5(coalesce(html, '')) AS digest FROM pages",
        "actions_migrated": f"WITH f AS ({_FIRST}) SELECT CASE WHEN f.id IS NULL THEN 'OPEN' ELSE 'IN_PROGRESS' END AS status, CASE WHEN f.id IS NULL THEN NULL ELSE CAST({AS_OF} AS VARCHAR) END AS started_at, CAST(NULL AS VARCHAR) AS completed_at, count(*) AS n FROM ({_ACTIONS}) a LEFT JOIN f ON a.id = f.id GROUP BY 1, 2",
        "best_scores": oracle("SELECT domain, " + ", ".join(f"CAST(max(score_{f}) AS INTEGER) AS best_{f}" for f in rules.FEATURES) + " FROM features GROUP BY domain"),
        "site_counts": oracle("SELECT count(*) AS sites, CAST(sum(pages) AS BIGINT) AS pages FROM sites"),
        "results_array": oracle(f"SELECT row_number() OVER (ORDER BY outreach_priority DESC, first_ordinal) - 1 AS ordinal, CAST(row_number() OVER (ORDER BY outreach_priority DESC, first_ordinal) AS INTEGER) AS outreach_rank, domain, pages, outreach_priority, {have('NOT ')} AS missing, executive_action FROM leads"),
    }
    found["phone_rules"] = found["phone_rules"].replace(" AS score FROM", f" AS score, CASE {_region} WHEN 0 THEN 'Invalid phone format' WHEN 100 THEN 'Valid NANP phone number, Alberta area code' WHEN 70 THEN 'Valid NANP phone number, Canadian area code' ELSE 'Valid NANP phone number, Non-local area code' END AS reasons FROM")
    return found | {n: oracle(f"SELECT domain, {', '.join(c)} FROM leads") for n, c in SHEET_GROUPS.items()}
