"""The rule pack: fixed values as data. Operators compile them into column expressions."""

from __future__ import annotations

# Features and their weighted patterns. A text scores the weights of the patterns it has at least once.
PATTERNS: dict[str, dict[str, int]] = {
    "contact_form": {r"contact\s+us": 3, r"contact\s+our": 3, r"contact\s+form": 4, r"send\s+(a\s+)?message": 3, r"request\s+(information|a\s+call|callback)": 4, r"email\s+us": 2, r"phone\s*[:\-]": 2, r"call\s+us": 2},
    "appointment_booking": {r"book\s+(an?\s+)?appointment": 5, r"schedule\s+(a\s+)?(meeting|consultation)": 5, r"arrange\s+(a\s+)?meeting": 4, r"meet\s+with\s+(a\s+)?director": 5, r"talk\s+with\s+(a\s+)?funeral\s+director": 5, r"consultation": 2, r"arrangements?\s+(can\s+be\s+made|appointment)": 4},
    "online_planner": {r"online\s+(funeral|memorial)\s+planner": 5, r"plan\s+(a\s+)?funeral\s+online": 5, r"start\s+(your\s+)?arrangements\s+online": 5, r"online\s+arrangement": 4, r"virtual\s+arrangement": 4},
    "pricing": {r"pricing": 5, r"price\s+list": 5, r"cost": 3, r"fees": 3, r"fee\s+schedule": 5, r"packages?": 3, r"service\s+options": 4, r"price\s+information": 5, r"transparent\s+pricing": 5},
    "preplanning": {r"pre[\s-]?planning": 5, r"pre[\s-]?arrangement": 5, r"plan\s+ahead": 4, r"advance\s+planning": 5, r"future\s+planning": 3},
    "lead_capture": {r"newsletter": 3, r"subscribe": 3, r"download": 2, r"request\s+information": 5, r"free\s+guide": 4, r"leave\s+your\s+(name|email)": 5},
    "chat": {r"live\s+chat": 5, r"chat\s+with\s+us": 5, r"messenger": 4, r"virtual\s+assistant": 5, r"ai\s+assistant": 5, r"chatbot": 5},
    "cremation": {r"cremation": 3, r"cremated": 2},
    "burial": {r"burial": 3, r"interment": 3, r"cemetery": 2},
}
# Markup that lifts a feature's score to a floor.
FLOORS: dict[str, tuple[str, int]] = {
    "contact_form": (r"<form|wpforms|gravity.?forms|contact.?form", 3),
    "appointment_booking": (r"calendly|acuity|booking.?widget|appointment.?widget", 4),
    "chat": (r"intercom|tidio|drift|livechat|tawk", 4),
    "online_planner": (r"iframe|embedded|online.?planner|planning.?tool", 4),
}
FEATURES = list(PATTERNS)
#: The score from which one page shows a feature.
SHOWN = 3
# What a feature is worth, present or missing.
WEIGHTS = {"online_planner": 5, "appointment_booking": 4, "lead_capture": 3, "pricing": 2, "chat": 1, "preplanning": 1, "contact_form": 1, "cremation": 0, "burial": 0}
# The features that count for conversion.
REVENUE = ["contact_form", "appointment_booking", "online_planner", "lead_capture", "chat", "pricing"]
# The second detector's keywords.
SIGNALS: dict[str, list[str]] = {
    "contact_form": ["contact", "contact us", "get in touch", "send message"],
    "appointment_booking": ["appointment", "book", "schedule", "consultation"],
    "online_planner": ["online planner", "plan online", "online arrangement", "arrange online"],
    "pricing": ["pricing", "price", "cost", "fees", "quote"],
    "preplanning": ["pre-plan", "preplan", "plan ahead", "advance planning"],
    "cremation": ["cremation"],
    "burial": ["burial", "cemetery"],
    "lead_capture": ["newsletter", "subscribe", "mailing list", "email"],
    "chat": ["chat", "live chat", "intercom", "drift", "tawk"],
}
# Keywords of the fits and of prospect types.
KEYWORDS: dict[str, list[str]] = {
    "seminar": ["seminar", "workshop", "training", "speaker", "presentation", "webinar", "continuing education", "professional development"],
    "community": ["grief support", "grief group", "support group", "community event", "community outreach", "remembrance", "memorial event", "celebration of life", "family resources", "aftercare", "bereavement"],
    "event": ["upcoming events", "event calendar", "community events"],
    "education": ["resources", "planning guide", "preplanning guide", "educational resources", "learn more", "information center", "family education"],
    "industry": ["funeral", "mortuary", "cremation", "cemetery", "memorial", "chapel", "preplanning", "obituary"],
    "association": ["association", "society", "chapter", "membership", "board member", "annual meeting", "conference", "expo", "summit"],
    "home": ["funeral home", "funeral service", "funeral services", "funeral director", "mortuary", "chapel", "cremation", "cemetery", "memorial service"],
    "society": ["association", "society", "membership", "chapter", "annual meeting", "conference", "expo", "summit"],
    "role": ["owner", "director", "association"],
}
# Contact patterns.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+?\d[\d\s().-]{8,}\d)"
# Hosts and local parts of addresses.
BAD_ANYWHERE = ["tukios.com", "facebook.com", "google.com", "wordpress.com"]
BAD_HOSTS = ["tukios.com", "frontrunner360.com", "tributetech.com", "wordpress.com", "google.com", "facebook.com"]
BAD_LOCALS = ["privacy", "support", "help", "admin", "webmaster", "noreply", "no-reply"]
FREE_HOSTS = ["gmail.com", "hotmail.com", "outlook.com", "yahoo.com"]
ROLE_LOCALS = ["info", "contact", "office", "director", "owner", "manager"]
# Telephone area codes. The regional list has four that the ranking list lacks.
HOME_AREAS = ["403", "587", "780", "825"]
RANKED_AREAS = ["204", "236", "249", "250", "289", "306", "343", "365", "403", "416", "418", "431", "437", "438", "450", "506", "514", "519", "548", "579", "581", "587", "604", "613", "639", "647", "705", "709", "778", "780", "782", "807", "819", "825", "867", "873", "879", "902", "905"]
REGION_AREAS = ["204", "226", "236", "249", "250", "289", "306", "343", "365", "367", "387", "403", "416", "418", "431", "437", "438", "450", "506", "514", "519", "548", "579", "581", "587", "604", "613", "639", "647", "705", "709", "742", "778", "780", "782", "807", "819", "825", "867", "873", "879", "902", "905"]
