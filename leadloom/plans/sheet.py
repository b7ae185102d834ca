"""The score sheet: every per-site score and class, in the order in which they build on each other.

Each line names a column and its expression in the SQL that Spark and DuckDB share; {d:x} is a
double literal, {round:n:x} the exact rounding of x to n places, and {say:class} the text of a message. The inputs are the columns of
leadloom.operators.leads.signals(): pages, has_<feature>, fits, kinds, raw and clean contacts.
"""

from __future__ import annotations

import re

from leadloom.functions import rules
from leadloom.plans import messages


def case(*branches: str) -> str:
    """CASE from 'condition => value' lines and a last value."""
    return "CASE " + " ".join("WHEN {} THEN {}".format(*b.split(" => ")) for b in branches[:-1]) + f" ELSE {branches[-1]} END"


def add(*terms: tuple[str, int]) -> str:
    return " + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n in terms)


def worth(features: list[str], missing: bool) -> str:
    return " + ".join(f"CASE WHEN {'NOT ' * missing}has_{f} THEN {rules.WEIGHTS[f]} ELSE 0 END" for f in features)


def listed(*items: tuple[str, str]) -> str:
    """The texts whose conditions hold, in order, with '; ' between."""
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in items) + ")"


#: Columns of leadloom.operators.leads.signals() that a message may name.
INPUTS = ["domain", "pages", "any_email", "email_confidence", "primary_phone", "phone_confidence", "normalized_phone", "phone_region_score", "n_emails", "n_phones"]


def said(*items: tuple[str, str]) -> str:
    """The messages whose conditions hold, by their classes, in order, with '; ' between."""
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN {{say:{kind}}} END" for c, kind in items) + ")"


# Class names and the eight texts of revenue_reason. {say:class} is the text that the table of messages
# has for the line's field and that class.
SHEET: list[tuple[str, str]] = [
    ("conversion", f"least({worth(rules.REVENUE, False)}, 15)"),
    ("opportunity", f"least({worth(rules.FEATURES, True)}, 15)"),
    ("lead_value", "least(opportunity * 2 + conversion, 30)"),
    ("priority", case("opportunity >= 10 => 'Critical'", "opportunity >= 6 => 'High'", "opportunity >= 3 => 'Medium'", "'Low'")),
    ("outreach_priority", "lead_value + pages / {d:10.0}"),
    ("outreach_level", case("outreach_priority >= 35 => 'Immediate Outreach'", "outreach_priority >= 25 => 'High Priority Outreach'", "outreach_priority >= 15 => 'Standard Outreach'", "'Nurture'")),
    ("lead_type", case("lead_value >= 25 AND conversion <= 8 => 'Digital Transformation Candidate'", "lead_value >= 20 => 'Conversion Improvement Candidate'", "'Low Priority / Maintenance'")),
    ("recommended_package", case("lead_type LIKE 'Digital%' => {say:digital}", "lead_type LIKE 'Conv%' => {say:conversion}", "{say:other}")),
    ("recommended_services", case("lead_type LIKE 'Digital%' => {say:digital}", "lead_type LIKE 'Conv%' => {say:conversion}", "{say:other}")),
    ("classification_reason", case("lead_type LIKE 'Digital%' => {say:digital}", "lead_type LIKE 'Conv%' => {say:conversion}", "{say:other}")),
    ("contact_confidence", "least(" + add(("n_emails_raw > 0", 50), ("n_phones_raw > 0", 30), ("has_contact_form", 20)) + ", 100)"),
    ("recommended_contact_method", case("contact_confidence >= 80 => 'Email + Phone'", "contact_confidence >= 50 => 'Email'", "'Research Required'")),
    ("sales_readiness", add(("contact_confidence >= 80", 20), ("has_contact_form", 15), ("lead_value >= 25", 20), ("NOT has_lead_capture", 10), ("NOT has_appointment_booking", 10))),
    ("sales_stage", case("sales_readiness >= 90 => 'Hot Prospect'", "sales_readiness >= 70 => 'Sales Qualified Lead'", "sales_readiness >= 50 => 'Nurture Candidate'", "'Research Required'")),
    ("pain_points", said(("NOT has_appointment_booking", "booking"), ("NOT has_lead_capture", "capture"), ("NOT has_online_planner", "planner"), ("NOT has_chat", "chat"))),
    ("pitch", said(("NOT has_online_planner", "planner"), ("NOT has_chat", "chat"), ("NOT has_pricing", "pricing"), ("NOT has_lead_capture", "capture"), ("NOT has_appointment_booking", "booking"))),
    ("website_observations", "coalesce(nullif(" + said(("NOT has_online_planner", "planner"), ("NOT has_appointment_booking", "booking"), ("NOT has_chat", "chat"), ("NOT has_lead_capture", "capture"), ("NOT has_contact_form", "form")) + ", ''), {say:none})"),
    ("email_angle", case("lead_type LIKE 'Digital%' => {say:digital}", "lead_type LIKE 'Conv%' => {say:conversion}", "{say:other}")),
    ("seminar_fit", "least(20 * n_seminar + CASE WHEN kw_association THEN 20 ELSE 0 END, 100)"),
    ("community_fit", "least(15 * n_community + 10 * n_event, 100)"),
    ("education_fit", "least(10 * n_education, 100)"),
    ("association_fit", "CASE WHEN n_industry > 0 THEN 0 ELSE least(20 * n_association, 100) END"),
    ("recommended_message", case("seminar_fit >= 70 => {say:high}", "seminar_fit >= 40 => {say:middle}", "{say:low}")),
    ("prospect_type", case("is_home => 'Funeral Home Prospect'", "is_society => 'Association / Event Opportunity'", "'Funeral Industry Prospect'")),
    ("campaign_type", case("seminar_fit >= 70 => 'High Priority Grief Seminar Prospect'", "seminar_fit >= 40 => 'Qualified Funeral Industry Prospect'", "'Research Prospect'")),
    ("recommended_subject", case("seminar_fit >= 70 => {say:high}", "seminar_fit >= 40 => {say:middle}", "{say:low}")),
    ("first_email_angle", case("seminar_fit >= 70 => {say:high}", "seminar_fit >= 40 => {say:middle}", "{say:low}")),
    ("follow_up_days", case("seminar_fit >= 70 => 3", "seminar_fit >= 40 => 7", "14")),
    ("follow_up_priority", case("seminar_fit >= 70 => 'High'", "seminar_fit >= 40 => 'Medium'", "'Low'")),
    ("target_contact_role", case("kw_owner => 'Owner / Funeral Director'", "kw_director => 'Funeral Director'", "kw_association => 'Association Contact'", "'Funeral Home Decision Maker'")),
    ("campaign_priority", case("seminar_fit >= 70 => 'Priority Grief Seminar Outreach'", "seminar_fit >= 50 => 'Qualified Seminar Outreach'", "'Industry Relationship Outreach'")),
    ("best_contact_channel", case("n_emails > 0 => 'Email'", "n_phones > 0 => 'Phone'", "'Research Required'")),
    ("priority_score", case("seminar_fit >= 80 => 50", "seminar_fit >= 50 => 30", "15")),
    ("campaign_sequence", case("seminar_fit >= 70 => 'Immediate Outreach'", "seminar_fit >= 40 => '7 Day Nurture'", "'Research Queue'")),
    ("decision_maker_reason", case("seminar_fit >= 70 => {say:high}", "seminar_fit >= 40 => {say:middle}", "{say:low}")),
    ("opening_hook", case("seminar_fit >= 70 => {say:high}", "seminar_fit >= 40 => {say:middle}", "{say:low}")),
    ("email_personalization", "{say:all}"),
    ("call_script_angle", "{say:all}"),
    ("primary_email", "CASE WHEN email_confidence < 50 THEN '' ELSE any_email END"),
    ("contact_quality_score", "email_confidence * {d:0.6} + phone_confidence * {d:0.4}"),
    ("revenue_opportunity_score", "least(" + add(("NOT has_online_planner", 15), ("NOT has_lead_capture", 10), ("NOT has_appointment_booking", 10)) + " + least(opportunity * 2, 20) + " + case("community_fit >= 70 => 15", "community_fit >= 40 => 8", "0") + " + " + case("seminar_fit >= 70 => 15", "seminar_fit >= 40 => 8", "0") + " + " + add(("education_fit >= 20", 5)) + " + " + case("contact_quality_score >= 70 => 10", "contact_quality_score >= 40 => 5", "0") + ", 100)"),
    ("revenue_reason", listed(("NOT has_online_planner", "Missing online planning system"), ("NOT has_lead_capture", "Missing lead capture infrastructure"), ("NOT has_appointment_booking", "Missing consultation booking"), ("opportunity >= 10", "High digital conversion opportunity"), ("community_fit >= 70", "Strong community engagement"), ("seminar_fit >= 70", "Strong seminar partnership fit"), ("education_fit >= 20", "Education partnership potential"), ("contact_quality_score >= 70", "Verified outreach readiness"))),
    ("revenue_tier", case("revenue_opportunity_score >= 75 => 'Tier 1'", "revenue_opportunity_score >= 50 => 'Tier 2'", "'Tier 3'")),
    ("digital_opportunity_score", "least(opportunity / {d:15.0} * {d:60.0} + (15 - conversion) / {d:15.0} * {d:40.0}, {d:100.0})"),
    ("partnership_opportunity_score", "least(community_fit * {d:0.35} + seminar_fit * {d:0.35} + education_fit * {d:0.2} + contact_quality_score * {d:0.1}, {d:100.0})"),
    # As results show them; what builds on them takes them as they are.
    ("digital_shown", "{round:1:digital_opportunity_score}"),
    ("partnership_shown", "{round:1:partnership_opportunity_score}"),
    ("sales_priority_score", "{round:1:digital_opportunity_score * {d:0.55} + partnership_opportunity_score * {d:0.45}}"),
    ("base_lane", case("digital_opportunity_score >= 70 AND partnership_opportunity_score >= 70 => 'Digital + Partnership'", "partnership_opportunity_score >= 70 => 'Partnership'", "digital_opportunity_score >= 70 => 'Digital'", "'Nurture'")),
    ("executive_priority_score", "{round:1:least(sales_priority_score * " + case("revenue_tier = 'Tier 1' => {d:1.25}", "revenue_tier = 'Tier 2' => {d:1.1}", "{d:1.0}") + " * ({d:0.7} + contact_quality_score / {d:100.0} * {d:0.3}), {d:100.0})}"),
    ("executive_action", case("executive_priority_score >= 80 => 'Immediate Executive Outreach'", "executive_priority_score >= 60 => 'Priority Sales Sequence'", "executive_priority_score >= 45 => 'Nurture Campaign'", "'Monitor'")),
    ("executive_summary", case("executive_priority_score >= 80 => {say:act}", "executive_priority_score >= 60 => {say:target}", "executive_priority_score >= 45 => {say:develop}", "{say:none}")),
    ("outreach_priority_level", case("executive_priority_score >= 80 => 'P1'", "executive_priority_score >= 60 => 'P2'", "executive_priority_score >= 45 => 'P3'", "'P4'")),
    ("sales_lane", case("revenue_tier = 'Tier 1' AND sales_priority_score >= 55 => 'Priority Outreach'", "revenue_tier = 'Tier 2' AND sales_priority_score >= 60 => 'Qualified Outreach'", "base_lane")),
    ("recommended_pitch", case("sales_lane = 'Priority Outreach' => {say:priority}", "base_lane = 'Digital + Partnership' => {say:both}", "base_lane = 'Partnership' => {say:partnership}", "base_lane = 'Digital' => {say:digital}", "{say:none}")),
    ("crm_status", case("contact_quality_score >= 70 => 'Ready For Outreach'", "primary_email = '' AND phone_confidence < 50 => 'No Valid Contact Found'", "contact_quality_score >= 30 => 'Needs Verification'", "'Research Required'")),
    ("outreach_readiness_score", case("contact_quality_score >= 70 => 30", "contact_quality_score >= 40 => 20", "0") + " + " + case("seminar_fit >= 70 => 25", "seminar_fit >= 40 => 15", "0") + " + " + add(("community_fit >= 70", 20), ("opportunity >= 10", 15))),
    ("lead_temperature", case("outreach_readiness_score >= 75 => 'HOT'", "outreach_readiness_score >= 45 => 'WARM'", "'COLD'")),
    ("outreach_strategy", case("outreach_readiness_score >= 75 => {say:hot}", "outreach_readiness_score >= 45 => {say:warm}", "{say:cold}")),
    ("recommended_first_touch", "{say:all}"),
    # The canonical lead and its queue.
    ("canonical_quality", "{round:2:email_confidence * {d:0.35} + phone_confidence * {d:0.35} + phone_region_score * {d:0.3}}"),
    ("canonical_raw", "sales_readiness + canonical_quality + CASE WHEN any_email <> '' THEN 20 ELSE 0 END + phone_region_score / {d:10.0}"),
    ("canonical_priority", "{round:2:canonical_raw}"),
    ("priority_level", case("canonical_raw >= 180 => 'A1 - Immediate Outreach'", "canonical_raw >= 120 => 'A2 - Priority Outreach'", "canonical_raw >= 80 => 'B1 - Nurture'", "'Research Required'")),
    ("best_contact_method", case("email_confidence >= 80 => 'email'", "phone_confidence >= 80 => 'phone'", "'research'")),
]

SHEET += [(field, case(*[f"executive_action = '{name}' => {{say:{kind}}}" for kind, name in messages.ACTIONS.items() if kind != "monitor"], "{say:monitor}")) for field in messages.BY_ACTION]
SHEET += [
    ("email_subject", "{say:all}"),
    # The reference's follow-up takes a number for a level, so every lead is in the last branch.
    ("crm_state", "'NURTURE'"),
    ("crm_stage", "'NEW'"),
    ("crm_next_action", "'Research prospect'"),
    ("level_state", case("priority_level LIKE 'A1%' => 'NEW'", "priority_level LIKE 'A2%' => 'NEW'", "'NURTURE'")),
    ("level_stage", case("priority_level LIKE 'A1%' => 'CONTACTED'", "'NEW'")),
    ("level_next_action", case("priority_level LIKE 'A1%' => concat('Send ', best_contact_method, ' outreach')", "priority_level LIKE 'A2%' => concat('Prepare ', best_contact_method, ' sequence')", "'Research prospect'")),
    ("level_follow_up", case("priority_level LIKE 'A1%' => 2", "priority_level LIKE 'A2%' => 5", "14")),
]


def _filled(text: str, rounding: str) -> str:
    text = re.sub(r"\{d:([0-9.]+)\}", r"CAST(\1 AS DOUBLE)", text)
    while m := re.search(r"\{round:(\d):([^{}]*)\}", text):
        text = text[: m.start()] + rounding.replace("N", m[1]).replace("X", f"({m[2]})") + text[m.end() :]
    return text


def _lines(rounding: str, texts: dict[str, dict[str, str]], backslash: str) -> list[tuple[str, str]]:
    found, known = [], set(INPUTS)
    for name, text in SHEET:
        filled = _filled(text, rounding)
        for kind in set(re.findall(r"\{say:(\w+)\}", filled)):
            filled = filled.replace(f"{{say:{kind}}}", messages.sql(texts[name][kind], known, name, backslash))
        found.append((name, filled))
        known.add(name)
    return found


def spark_sheet(texts: dict[str, dict[str, str]] = messages.DEFAULT) -> list[tuple[str, str]]:
    return _lines("CAST(regexp_replace(format_number(X, N), ',', '') AS DOUBLE)", texts, "\\\\")


def duckdb_sheet() -> list[tuple[str, str]]:
    return _lines("CAST(printf('%.Nf', X) AS DOUBLE)", messages.DEFAULT, "\\")


def levels(lines: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """The lines in groups, each of which names columns of the groups before it alone: one step of a plan each."""
    at: dict[str, int] = {}
    found: list[list[tuple[str, str]]] = []
    for name, text in lines:
        at[name] = max((at[w] + 1 for w in re.findall(r"\w+", text) if w in at), default=0)
        if at[name] == len(found):
            found.append([])
        found[at[name]].append((name, text))
    return found
