"""What is said of a lead: texts by field and class, as a table that callers may change.

The score sheet tells the class of each field; the table has its text, in which {column} stands for what
the lead has there. DEFAULT is the wording of this library.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "field string, class string, template string"
#: Field, and its texts by class.
DEFAULT: dict[str, dict[str, str]] = {
    "recommended_package": {"digital": "Full funnel build", "conversion": "Conversion package", "other": "Site review"},
    "recommended_services": {"digital": "assistant; online arrangement; lead capture; booking", "conversion": "assistant; conversion work; booking", "other": "audit; automation advice"},
    "classification_reason": {"digital": "large opportunity; revenue tools missing; room to upgrade", "conversion": "sound base; gaps found; room to optimise", "other": "mature site; little to gain now"},
    "pain_points": {"booking": "no booking", "capture": "little lead capture", "planner": "no planning online", "chat": "no instant contact"},
    "pitch": {"planner": "arrangements online", "chat": "chat assistant", "pricing": "price calculator", "capture": "better lead capture", "booking": "booking online"},
    "website_observations": {"planner": "planning is missing", "booking": "booking is missing", "chat": "chat is missing", "capture": "lead capture is missing", "form": "contact form is missing", "none": "nothing is missing"},
    "email_angle": {"digital": "more enquiries", "conversion": "better conversion", "other": "digital review"},
    "recommended_message": {"high": "invite to a seminar", "middle": "offer resources", "low": "introduce programmes"},
    "recommended_subject": {"high": "seminar for families", "middle": "community partnership", "low": "industry education"},
    "first_email_angle": {"high": "offer seminars", "middle": "introduce seminars", "low": "explore options"},
    "decision_maker_reason": {"high": "strong fit", "middle": "possible partner", "low": "research first"},
    "opening_hook": {"high": "well placed for support", "middle": "support beyond the service", "low": "resources for providers"},
    "email_personalization": {"all": "{opening_hook}. Contact: {target_contact_role}. Angle: seminars"},
    "call_script_angle": {"all": "Ask about support programmes. Role: {target_contact_role}"},
    "executive_summary": {"act": "act now", "target": "targeted outreach", "develop": "develop", "none": "little to gain now"},
    "recommended_pitch": {"priority": "conversion upgrade with partnership", "both": "engagement upgrade and partnership", "partnership": "seminars and partnership", "digital": "arrangements, capture, consultation", "none": "keep in touch"},
    "outreach_strategy": {"hot": "direct", "warm": "relationship", "cold": "awareness"},
    "recommended_first_touch": {"all": "{best_contact_channel} | {target_contact_role}"},
    "email_subject": {"all": "Online enquiries for {domain}"},
}
ACTIONS = {"immediate": "Immediate Executive Outreach", "priority": "Priority Sales Sequence", "nurture": "Nurture Campaign", "monitor": "Monitor"}
#: Fields by the executive action, in the order of ACTIONS.
BY_ACTION: dict[str, list[str]] = {
    "outreach_channel": ["email and phone", "personal email", "email series", "none"],
    "first_contact_strategy": ["missed conversions", "show improvements", "give value", "no outreach"],
    "offer_angle": ["modernisation plan", "conversion package", "later partnership", "later review"],
    "estimated_sales_motion": ["executive cycle", "consultative", "long term", "passive"],
    "sales_message_angle": ["modernisation", "conversion", "relationship", "monitoring"],
    "why_now": ["high value now", "clear gaps", "future potential", "no urgency"],
    "primary_pain": ["missed enquiries", "weak workflow", "early stage", "none found"],
    "recommended_first_message": ["offer an assessment", "offer a review", "share insights", "wait"],
    "expected_objection": ["too complex", "unsure of return", "not now", "not relevant"],
    "response_strategy": ["go in phases", "show gains", "stay in touch", "review later"],
    "asset_subject": ["modernisation for {domain}", "conversion for {domain}", "future options for {domain}", "digital options for {domain}"],
    "opening_line": ["enquiries could be made easier", "some pages could convert better", "we study trends in your field", "we would like to connect"],
    "first_email_body": ["a review of your site is ready", "we improve workflows and capture", "we share ideas for growth", "we support digital work"],
    "phone_opener": ["some enquiries may be lost", "families could reach you sooner", "how do you see digital growth", "a short introduction"],
    "follow_up_day_3": ["on the review that was sent", "is this of interest now", "some ideas to keep", "keeping in touch"],
    "follow_up_day_7": ["shall we go through the review", "the findings are at hand", "the offer stays open", "we are there when needed"],
    "custom_opening": ["direct opening", "review opening", "friendly opening", "no opening"],
}
DEFAULT |= {field: dict(zip(ACTIONS, texts, strict=True)) for field, texts in BY_ACTION.items()}


def table(spark: SparkSession) -> DataFrame:
    """The default wording, to be changed and given to leads.scored()."""
    return spark.createDataFrame([(f, c, t) for f, own in DEFAULT.items() for c, t in own.items()], SCHEMA)


def changed(rows: Iterable[tuple[str, str, str]]) -> dict[str, dict[str, str]]:
    """The default wording with the rows' texts; an error for a field or class that there is not, and for a second text."""
    found = {f: dict(own) for f, own in DEFAULT.items()}
    seen: set[tuple[str, str]] = set()
    for field, kind, template in rows:
        if kind not in found.get(field, {}):
            raise ValueError(f"no field {field!r} with a class {kind!r}")
        if (field, kind) in seen or template is None:
            raise ValueError(f"{field!r}, {kind!r} needs one text")
        seen.add((field, kind))
        found[field][kind] = template
    return found


def own_texts(table_: DataFrame) -> dict[str, dict[str, str]]:
    """A table's wording; it has a row for each field and class at most, so no more than the default has."""
    most = sum(map(len, DEFAULT.values()))
    rows = table_.select("field", "class", "template").limit(most + 1).collect()
    return changed(map(tuple, rows))


def sql(template: str, known: set[str], field: str, backslash: str) -> str:
    """A template as SQL, where backslash stands for one in a literal. Placeholders have to be inputs of the sheet or
    columns before the field."""
    parts = re.split(r"\{(\w+)\}", template)
    if unknown := set(parts[1::2]) - known:
        raise ValueError(f"{field!r} cannot name {', '.join(sorted(unknown))}")
    own = [f"CAST({p} AS STRING)" if i % 2 else "'" + p.replace("'", "''").replace("\\", backslash) + "'" for i, p in enumerate(parts) if p or i % 2]
    return own[0] if len(own) == 1 else f"concat({', '.join(own)})" if own else "''"
