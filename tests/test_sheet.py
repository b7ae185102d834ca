"""The score sheet against values worked out by hand: both sides of every threshold, line by line, and whole sites."""

import re

import pytest
from pyspark.sql import functions as F

from leadloom.functions import rules
from leadloom.operators import leads
from leadloom.plans import sheet


def has(*found, **more):
    return {f"has_{f}": f in found for f in rules.FEATURES} | more


def steps(column, *pairs, **fixed):
    """Cases of one input: value and result in turn."""
    return [({column: v} | fixed, want) for v, want in zip(pairs[::2], pairs[1::2], strict=True)]


PARTS = has("online_planner", "lead_capture", "appointment_booking", opportunity=0, community_fit=0, seminar_fit=0, education_fit=0, contact_quality_score=0.0)
CASES: dict[str, list] = {
    "conversion": [(has(), 0), (has(*rules.FEATURES), 15), (has("online_planner", "appointment_booking", "lead_capture", "pricing"), 14), (has("online_planner", "appointment_booking", "lead_capture", "pricing", "chat"), 15), (has("contact_form", "appointment_booking", "lead_capture", "chat", "pricing"), 11), (has("preplanning", "cremation", "burial"), 0)],
    "opportunity": [(has(), 15), (has(*rules.FEATURES), 0), (has("chat", "preplanning", "contact_form", "cremation"), 14), (has("chat", "contact_form"), 15), (has("appointment_booking", "lead_capture", "pricing", "chat", "preplanning", "contact_form"), 5)],
    "lead_value": [({"opportunity": 15, "conversion": 0}, 30), ({"opportunity": 15, "conversion": 1}, 30), ({"opportunity": 10, "conversion": 5}, 25), ({"opportunity": 0, "conversion": 15}, 15)],
    "priority": steps("opportunity", 15, "Critical", 10, "Critical", 9, "High", 6, "High", 5, "Medium", 3, "Medium", 2, "Low", 0, "Low"),
    "outreach_priority": [({"lead_value": 30, "pages": 50}, 35.0), ({"lead_value": 24, "pages": 9}, 24.9), ({"lead_value": 0, "pages": 1}, 0.1)],
    "outreach_level": steps("outreach_priority", 35.0, "Immediate Outreach", 34.9, "High Priority Outreach", 25.0, "High Priority Outreach", 24.9, "Standard Outreach", 15.0, "Standard Outreach", 14.9, "Nurture"),
    "lead_type": [({"lead_value": v, "conversion": c}, want) for v, c, want in ((25, 8, "Digital Transformation Candidate"), (25, 9, "Conversion Improvement Candidate"), (24, 8, "Conversion Improvement Candidate"), (20, 0, "Conversion Improvement Candidate"), (19, 0, "Low Priority / Maintenance"))],
    "contact_confidence": [({"n_emails_raw": e, "n_phones_raw": p, "has_contact_form": f}, want) for e, p, f, want in ((1, 1, True, 100), (9, 1, False, 80), (1, 0, True, 70), (0, 3, True, 50), (0, 0, True, 20), (0, 0, False, 0))],
    "recommended_contact_method": steps("contact_confidence", 80, "Email + Phone", 79, "Email", 50, "Email", 49, "Research Required"),
    "sales_readiness": [({"contact_confidence": c, "has_contact_form": f, "lead_value": v, "has_lead_capture": l, "has_appointment_booking": b}, want) for c, f, v, l, b, want in ((80, True, 25, False, False, 75), (79, True, 25, False, False, 55), (80, False, 24, True, True, 20), (0, False, 0, False, False, 20), (0, True, 24, True, False, 25), (0, False, 25, False, True, 30))],
    "sales_stage": steps("sales_readiness", 90, "Hot Prospect", 89, "Sales Qualified Lead", 70, "Sales Qualified Lead", 69, "Nurture Candidate", 50, "Nurture Candidate", 49, "Research Required"),
    "pain_points": [(has(), "no booking; little lead capture; no planning online; no instant contact"), (has("lead_capture", "chat"), "no booking; no planning online"), (has(*rules.FEATURES), "")],
    "pitch": [(has(), "arrangements online; chat assistant; price calculator; better lead capture; booking online"), (has("online_planner", "pricing"), "chat assistant; better lead capture; booking online"), (has(*rules.FEATURES), "")],
    "website_observations": [(has(), "planning is missing; booking is missing; chat is missing; lead capture is missing; contact form is missing"), (has("online_planner", "chat", "pricing"), "booking is missing; lead capture is missing; contact form is missing"), (has("online_planner", "appointment_booking", "chat", "lead_capture", "contact_form"), "nothing is missing")],
    "seminar_fit": [({"n_seminar": n, "kw_association": a}, want) for n, a, want in ((0, False, 0), (0, True, 20), (3, True, 80), (5, False, 100), (8, True, 100))],
    "community_fit": [({"n_community": n, "n_event": e}, want) for n, e, want in ((0, 0, 0), (4, 1, 70), (2, 1, 40), (6, 1, 100), (7, 0, 100))],
    "education_fit": steps("n_education", 0, 0, 2, 20, 7, 70),
    "association_fit": [({"n_industry": i, "n_association": n}, want) for i, n, want in ((0, 3, 60), (1, 3, 0), (0, 9, 100), (0, 0, 0))],
    "prospect_type": [({"is_home": h, "is_society": s}, want) for h, s, want in ((True, True, "Funeral Home Prospect"), (False, True, "Association / Event Opportunity"), (False, False, "Funeral Industry Prospect"))],
    "campaign_type": steps("seminar_fit", 70, "High Priority Grief Seminar Prospect", 69, "Qualified Funeral Industry Prospect", 40, "Qualified Funeral Industry Prospect", 39, "Research Prospect"),
    "recommended_message": steps("seminar_fit", 70, "invite to a seminar", 69, "offer resources", 40, "offer resources", 39, "introduce programmes"),
    "follow_up_days": steps("seminar_fit", 70, 3, 69, 7, 40, 7, 39, 14),
    "follow_up_priority": steps("seminar_fit", 70, "High", 69, "Medium", 40, "Medium", 39, "Low"),
    "target_contact_role": [({"kw_owner": o, "kw_director": d, "kw_association": a}, want) for o, d, a, want in ((True, True, True, "Owner / Funeral Director"), (False, True, True, "Funeral Director"), (False, False, True, "Association Contact"), (False, False, False, "Funeral Home Decision Maker"))],
    "campaign_priority": steps("seminar_fit", 70, "Priority Grief Seminar Outreach", 69, "Qualified Seminar Outreach", 50, "Qualified Seminar Outreach", 49, "Industry Relationship Outreach"),
    "best_contact_channel": [({"n_emails": e, "n_phones": p}, want) for e, p, want in ((1, 1, "Email"), (0, 1, "Phone"), (0, 0, "Research Required"))],
    "priority_score": steps("seminar_fit", 80, 50, 79, 30, 50, 30, 49, 15),
    "campaign_sequence": steps("seminar_fit", 70, "Immediate Outreach", 69, "7 Day Nurture", 40, "7 Day Nurture", 39, "Research Queue"),
    "primary_email": steps("email_confidence", 50, "a@b.example", 49, "", any_email="a@b.example"),
    "contact_quality_score": [({"email_confidence": e, "phone_confidence": p}, want) for e, p, want in ((85, 70, 79.0), (100, 100, 100.0), (0, 0, 0.0), (0, 100, 40.0), (50, 0, 30.0))],
    "revenue_opportunity_score": [
        (PARTS, 0), *[(PARTS | {f"has_{f}": False}, n) for f, n in (("online_planner", 15), ("lead_capture", 10), ("appointment_booking", 10), ("chat", 0))],
        *steps("opportunity", 9, 18, 10, 20, 15, 20, **{k: v for k, v in PARTS.items() if k != "opportunity"}),
        *[(PARTS | {c: v}, want) for c in ("community_fit", "seminar_fit") for v, want in ((70, 15), (69, 8), (40, 8), (39, 0))],
        *[(PARTS | {"education_fit": v}, want) for v, want in ((20, 5), (19, 0))], *[(PARTS | {"contact_quality_score": v}, want) for v, want in ((70.0, 10), (69.9, 5), (40.0, 5), (39.9, 0))],
        (has(opportunity=15, community_fit=70, seminar_fit=70, education_fit=20, contact_quality_score=70.0), 100),
    ],
    "revenue_tier": steps("revenue_opportunity_score", 75, "Tier 1", 74, "Tier 2", 50, "Tier 2", 49, "Tier 3"),
    "revenue_reason": [
        (has(opportunity=10, community_fit=70, seminar_fit=70, education_fit=20, contact_quality_score=70.0), "Missing online planning system; Missing lead capture infrastructure; Missing consultation booking; High digital conversion opportunity; Strong community engagement; Strong seminar partnership fit; Education partnership potential; Verified outreach readiness"),
        (has("lead_capture", opportunity=9, community_fit=69, seminar_fit=69, education_fit=19, contact_quality_score=69.9), "Missing online planning system; Missing consultation booking"),
    ],
    "digital_opportunity_score": [({"opportunity": o, "conversion": c}, want) for o, c, want in ((15, 0, 100.0), (0, 15, 0.0), (6, 3, 56.0), (12, 4, 77.33333333333334))],
    "partnership_opportunity_score": [({"community_fit": c, "seminar_fit": s, "education_fit": e, "contact_quality_score": q}, want) for c, s, e, q, want in ((100, 100, 100, 100.0, 100.0), (40, 40, 20, 50.0, 37.0), (70, 80, 20, 85.0, 65.0), (0, 0, 0, 0.0, 0.0))],
    "sales_priority_score": [({"digital_opportunity_score": d, "partnership_opportunity_score": p}, want) for d, p, want in ((100.0, 0.0, 55.0), (70.0, 70.0, 70.0), (77.33333333333334, 65.0, 71.8), (0.0, 94.0, 42.3))],
    "base_lane": [({"digital_opportunity_score": d, "partnership_opportunity_score": p}, want) for d, p, want in ((70.0, 70.0, "Digital + Partnership"), (69.9, 70.0, "Partnership"), (70.0, 69.9, "Digital"), (69.9, 69.9, "Nurture"))],
    "executive_priority_score": [({"sales_priority_score": s, "revenue_tier": t, "contact_quality_score": q}, want) for s, t, q, want in ((100.0, "Tier 1", 100.0, 100.0), (60.0, "Tier 2", 100.0, 66.0), (50.0, "Tier 3", 0.0, 35.0), (50.0, "Tier 1", 50.0, 53.1), (71.8, "Tier 1", 85.0, 85.7))],
    "executive_action": steps("executive_priority_score", 80.0, "Immediate Executive Outreach", 79.9, "Priority Sales Sequence", 60.0, "Priority Sales Sequence", 59.9, "Nurture Campaign", 45.0, "Nurture Campaign", 44.9, "Monitor"),
    "outreach_priority_level": steps("executive_priority_score", 80.0, "P1", 79.9, "P2", 60.0, "P2", 59.9, "P3", 45.0, "P3", 44.9, "P4"),
    "sales_lane": [({"revenue_tier": t, "sales_priority_score": s, "base_lane": b}, want) for t, s, b, want in (("Tier 1", 55.0, "Nurture", "Priority Outreach"), ("Tier 1", 54.9, "Digital", "Digital"), ("Tier 2", 60.0, "Digital", "Qualified Outreach"), ("Tier 2", 59.9, "Nurture", "Nurture"), ("Tier 3", 99.0, "Partnership", "Partnership"))],
    "recommended_pitch": [({"sales_lane": s, "base_lane": b}, want) for s, b, want in (("Priority Outreach", "Digital", "conversion upgrade with partnership"), ("Qualified Outreach", "Digital", "arrangements, capture, consultation"), ("Nurture", "Nurture", "keep in touch"), ("Partnership", "Partnership", "seminars and partnership"), ("Qualified Outreach", "Digital + Partnership", "engagement upgrade and partnership"))],
    "crm_status": [({"contact_quality_score": q, "primary_email": e, "phone_confidence": p}, want) for q, e, p, want in ((70.0, "", 0, "Ready For Outreach"), (69.9, "", 49, "No Valid Contact Found"), (69.9, "", 50, "Needs Verification"), (30.0, "x", 0, "Needs Verification"), (29.9, "x", 0, "Research Required"))],
    "outreach_readiness_score": [({"contact_quality_score": q, "seminar_fit": s, "community_fit": c, "opportunity": o}, want) for q, s, c, o, want in ((70.0, 70, 70, 10, 90), (69.9, 69, 69, 9, 35), (40.0, 40, 0, 0, 35), (39.9, 39, 70, 10, 35), (0.0, 0, 0, 0, 0))],
    "lead_temperature": steps("outreach_readiness_score", 75, "HOT", 74, "WARM", 45, "WARM", 44, "COLD"),
    "canonical_quality": [({"email_confidence": e, "phone_confidence": p, "phone_region_score": r}, want) for e, p, r, want in ((100, 100, 100, 100.0), (60, 90, 70, 73.5), (75, 100, 100, 91.25), (0, 0, 0, 0.0))],
    "canonical_raw": [({"sales_readiness": s, "canonical_quality": q, "any_email": e, "phone_region_score": r}, want) for s, q, e, r, want in ((75, 73.5, "x", 70, 175.5), (75, 73.5, "", 0, 148.5), (0, 0.0, "", 20, 2.0))],
    "priority_level": steps("canonical_raw", 180.0, "A1 - Immediate Outreach", 179.99, "A2 - Priority Outreach", 120.0, "A2 - Priority Outreach", 119.99, "B1 - Nurture", 80.0, "B1 - Nurture", 79.99, "Research Required"),
    "best_contact_method": [({"email_confidence": e, "phone_confidence": p}, want) for e, p, want in ((80, 100, "email"), (79, 80, "phone"), (79, 79, "research"))],
    "level_state": steps("priority_level", "A1 - Immediate Outreach", "NEW", "A2 - Priority Outreach", "NEW", "B1 - Nurture", "NURTURE", "Research Required", "NURTURE"),
    "level_stage": steps("priority_level", "A1 - Immediate Outreach", "CONTACTED", "A2 - Priority Outreach", "NEW", "B1 - Nurture", "NEW"),
    "level_next_action": steps("priority_level", "A1 - Immediate Outreach", "Send email outreach", "A2 - Priority Outreach", "Prepare email sequence", "B1 - Nurture", "Research prospect", best_contact_method="email"),
    "level_follow_up": steps("priority_level", "A1 - Immediate Outreach", 2, "A2 - Priority Outreach", 5, "B1 - Nurture", 14, "Research Required", 14),
}


def literal(value):
    return str(value).lower() if isinstance(value, bool) else f"'{value}'" if isinstance(value, str) else f"CAST({value!r} AS DOUBLE)" if isinstance(value, float) else str(value)


def test_every_line_at_its_thresholds(spark):
    lines, exprs, wants = dict(sheet.spark_sheet()), [], []
    for name, cases in CASES.items():
        for inputs, want in cases:
            used = set(re.findall(r"\w+", re.sub(r"'[^']*'", "", lines[name])))
            text = re.sub(r"'[^']*'|\b[a-z]\w*\b", lambda m, own=inputs: literal(own[m[0]]) if m[0] in own else m[0], lines[name])
            assert used & set(inputs), (name, inputs)
            exprs.append(text)
            wants.append((name, inputs, want))
    got = []
    for at in range(0, len(exprs), 60):
        got += spark.range(1).select(*[F.expr(e).alias(f"c{i}") for i, e in enumerate(exprs[at : at + 60])]).first()
    for (name, inputs, want), value in zip(wants, got, strict=True):
        assert value == (pytest.approx(want, abs=1e-9) if isinstance(want, float) else want), (name, inputs)
    assert len(wants) > 200


SITE = has(domain="s.example", pages=1, n_emails_raw=0, n_phones_raw=0, n_emails=0, n_phones=0, any_email="", email_confidence=0, primary_phone="", phone_confidence=0, phone_region_score=0, normalized_phone="", n_seminar=0, n_community=0, n_event=0, n_education=0, n_industry=0, n_association=0, kw_owner=False, kw_director=False, kw_association=False, is_home=False, is_society=False)
REACHED = {"n_emails_raw": 2, "n_phones_raw": 1, "n_emails": 1, "n_phones": 1, "any_email": "info@s.example", "primary_phone": "403-555-0101", "phone_confidence": 100, "phone_region_score": 100}
WHOLE = [
    (SITE, dict(conversion=0, opportunity=15, lead_value=30, priority="Critical", outreach_priority=30.1, outreach_level="High Priority Outreach", lead_type="Digital Transformation Candidate", contact_confidence=0, sales_readiness=40, sales_stage="Research Required", revenue_opportunity_score=55, revenue_tier="Tier 2", digital_shown=100.0, partnership_shown=0.0, sales_priority_score=55.0, executive_priority_score=42.4, executive_action="Monitor", sales_lane="Digital", crm_status="No Valid Contact Found", lead_temperature="COLD", canonical_priority=40.0, priority_level="Research Required", best_contact_method="research")),
    (SITE | has(*rules.FEATURES) | REACHED | dict(pages=20, email_confidence=100, n_seminar=5, n_community=7, n_education=7), dict(conversion=15, opportunity=0, lead_value=15, priority="Low", outreach_priority=17.0, outreach_level="Standard Outreach", lead_type="Low Priority / Maintenance", contact_confidence=100, sales_readiness=35, sales_stage="Research Required", revenue_opportunity_score=45, revenue_tier="Tier 3", digital_shown=0.0, partnership_shown=94.0, sales_priority_score=42.3, executive_priority_score=42.3, executive_action="Monitor", sales_lane="Partnership", crm_status="Ready For Outreach", lead_temperature="HOT", canonical_priority=165.0, priority_level="A2 - Priority Outreach", best_contact_method="email")),
    (SITE | has("contact_form", "chat", "pricing", "preplanning") | REACHED | dict(pages=70, email_confidence=75, n_seminar=3, kw_association=True, n_community=4, n_event=1, n_education=2), dict(conversion=4, opportunity=12, lead_value=28, priority="Critical", outreach_priority=35.0, outreach_level="Immediate Outreach", lead_type="Digital Transformation Candidate", contact_confidence=100, sales_readiness=75, sales_stage="Sales Qualified Lead", revenue_opportunity_score=100, revenue_tier="Tier 1", digital_shown=77.3, partnership_shown=65.0, sales_priority_score=71.8, executive_priority_score=85.7, executive_action="Immediate Executive Outreach", sales_lane="Priority Outreach", crm_status="Ready For Outreach", lead_temperature="HOT", canonical_priority=196.25, priority_level="A1 - Immediate Outreach", best_contact_method="phone", level_next_action="Send phone outreach", target_contact_role="Association Contact", campaign_type="High Priority Grief Seminar Prospect")),
]


def test_whole_sites(spark):
    columns = list(SITE)
    kinds = {bool: "boolean", int: "int", str: "string"}
    frame = spark.createDataFrame([tuple(s[c] for c in columns) for s, _ in WHOLE], ", ".join(f"{c} {kinds[type(SITE[c])]}" for c in columns))
    for (_, want), row in zip(WHOLE, leads.scored(frame).collect(), strict=True):
        got = {c: row[c] for c in want}
        assert got == {c: pytest.approx(v) if isinstance(v, float) else v for c, v in want.items()}
