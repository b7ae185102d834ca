"""Column helpers: text clean-up, exact rounding, contact rules. All built-in functions, no Python UDF."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def clean_domain(url: Column) -> Column:
    """The host of a url: scheme and path cut, every 'www.' deleted, case and port kept."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), "^https?://", "")
    return F.replace(F.split(bare, "/")[0], F.lit("www."), F.lit(""))


def normal_space(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"(?U)\s+", " ")


def exact_round(x: Column, places: int) -> Column:
    """Rounds the exact binary value, ties to even digits, as C's printf does."""
    return F.regexp_replace(F.format_number(x, places), ",", "").cast("double")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def any_of(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def feature_score(text: Column, feature: str) -> Column:
    """The weighted patterns of a normalised text, lifted to the floor of its markup."""
    score = F.lit(0)
    for pattern, weight in rules.PATTERNS[feature].items():
        score = score + F.when(text.rlike(pattern), weight).otherwise(0)
    if feature in rules.FLOORS:
        pattern, floor = rules.FLOORS[feature]
        score = F.greatest(score, F.when(text.rlike(pattern), floor).otherwise(0))
    return score.cast("int")


def all_patterns() -> list[str]:
    return [p for own in rules.PATTERNS.values() for p in own] + [p for p, _ in rules.FLOORS.values()]


#: A group, a class, an escape, any character, or a plain one, each with what says how often.
_ATOM = re.compile(r"(?:\((?:[^()]|\([^()]*\))*\)|\[[^\]]*\]|\\.|.)[?*+]?")


def required(pattern: str) -> list[tuple[str, str]]:
    """For each alternative of the pattern its longest run of plain characters, which a match must have, and the
    alternative, or '' where it is that run and nothing else."""
    found, atoms = [], [*_ATOM.findall(pattern), "|"]
    while atoms:
        own, atoms = atoms[: atoms.index("|")], atoms[atoms.index("|") + 1 :]
        runs = [""]
        for atom in own:
            if len(atom) == 1 and atom != ".":
                runs[-1] += atom
            else:
                runs.append("")
        literal = max(runs, key=len)
        found.append((literal, "" if literal == "".join(own) else "".join(own)))
    return found


def valid_email(email: Column) -> Column:
    return F.coalesce(email.rlike(f"^{rules.EMAIL}$"), F.lit(False))


def digits_of(phone: Column) -> Column:
    return F.regexp_replace(phone, r"[^0-9]", "")


def valid_phone(phone: Column) -> Column:
    """Ten digits, or eleven with a leading one; not like a year or time stamp; area not from 0 or 1."""
    d = digits_of(F.coalesce(phone, F.lit("")))
    bare = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    return ~d.startswith("19") & ~d.startswith("20") & (F.length(bare) == 10) & ~bare.startswith("0") & ~bare.startswith("1")


def normal_phone(phone: Column) -> Column:
    d = digits_of(F.coalesce(phone, F.lit("")))
    return F.when(F.length(d) == 10, F.concat(F.lit("+1"), d)).when((F.length(d) == 11) & d.startswith("1"), F.concat(F.lit("+"), d)).otherwise("")


def region_score(phone: Column) -> Column:
    n = normal_phone(phone)
    area = F.substring(n, 3, 3)
    return F.when(n == "", 0).when(area.isin(rules.HOME_AREAS), 100).when(area.isin(rules.REGION_AREAS), 70).otherwise(20)


def region_reasons(phone: Column) -> Column:
    score = region_score(phone)
    place = F.when(score == 100, "Alberta area code").when(score == 70, "Canadian area code").otherwise("Non-local area code")
    return F.when(score == 0, F.array(F.lit("Invalid phone format"))).otherwise(F.array(F.lit("Valid NANP phone number"), place))


def email_score(email: Column, domain: Column) -> Column:
    e = F.lower(email)
    local, host = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    own = F.when(host == domain, 60).otherwise(0) + F.when(local.isin(rules.ROLE_LOCALS), 25).otherwise(0) + F.when(~host.isin(rules.FREE_HOSTS), 15).otherwise(0)
    return F.when(~valid_email(email) | host.isin(rules.BAD_HOSTS) | local.isin(rules.BAD_LOCALS), 0).otherwise(own)


def phone_score(phone: Column) -> Column:
    d = digits_of(F.coalesce(phone, F.lit("")))
    area = F.when(F.length(d) == 11, F.substring(d, 2, 3)).otherwise(F.substring(d, 1, 3))
    known = area.isin(rules.RANKED_AREAS)
    return F.when(~valid_phone(phone), 0).when(F.length(d) == 10, F.when(known, 100).otherwise(40)).otherwise(F.when(known, 90).otherwise(30))


def clean_emails(emails: Column, domain: Column) -> Column:
    """Lower-case valid addresses, none of a bad host anywhere; the domain's own in front, the last of them first; no repeats."""
    low = F.transform(emails, lambda e: stripped(F.lower(e)))
    good = F.filter(low, lambda e: valid_email(e) & ~any_of(e, rules.BAD_ANYWHERE))
    own = F.concat(F.lit("@"), domain)
    return F.array_distinct(F.concat(F.reverse(F.filter(good, lambda e: e.endswith(own))), F.filter(good, lambda e: ~e.endswith(own))))


def clean_phones(phones: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(phones, valid_phone), stripped))


def best_email(emails: Column, domain: Column) -> Column:
    """struct(score, email) of the greatest score above 0, ties to the greatest address; (0, '') if none."""
    ranked = F.filter(F.transform(emails, lambda e: F.struct(email_score(e, domain).alias("score"), e.alias("email"))), lambda s: s["score"] > 0)
    return F.coalesce(F.array_max(ranked), F.struct(F.lit(0).alias("score"), F.lit("").alias("email")))


def best_phone(phones: Column) -> Column:
    """struct(score, phone), as best_email; the score weighs 70 to 30 with the region's and is rounded."""
    score = lambda p: F.round((7 * phone_score(p) + 3 * region_score(p)) / 10).cast("int")
    ranked = F.filter(F.transform(phones, lambda p: F.struct(score(p).alias("score"), p.alias("phone"))), lambda s: s["score"] > 0)
    return F.coalesce(F.array_max(ranked), F.struct(F.lit(0).alias("score"), F.lit("").alias("phone")))
