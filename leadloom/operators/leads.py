"""Sites from pages: features, keywords, contacts, scores and ranks.

Nothing gathers a site's text. One pass makes a state of each page (leadloom.operators.states), and a
site is the merge of its pages' states, in buckets first, so that a site with a third of all pages is
no large group. What lies over the seam of pages is found as in the site's joined text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import exprs, rules
from leadloom.operators import states
from leadloom.operators.states import with_domain
from leadloom.plans import messages, sheet

#: First ordinals of sites, of one priority, that are ranked in one window.
WIDTH = 1 << 16
#: Whole priorities whose sites count as one band when ranks are added up.
BAND = 16


def page_features(pages: DataFrame) -> DataFrame:
    """ordinal, url, text, domain and score_<feature> of each page."""
    return states.page_scores(pages).select("ordinal", "url", "text", "domain", *[f"score_{f}" for f in rules.FEATURES])


def sites(pages: DataFrame) -> DataFrame:
    """What each site tells by itself (states.finished)."""
    return states.finished(states.site_states(pages))


def feature_sets(found: DataFrame) -> DataFrame:
    """Adds the sorted arrays found and missing."""
    names = F.array(*[F.lit(f) for f in rules.FEATURES])
    own = F.array_compact(F.array(*[F.when(F.col(f"has_{f}"), F.lit(f)) for f in rules.FEATURES]))
    return found.withColumn("found", F.array_sort(own)).withColumn("missing", F.array_sort(F.array_except(names, "found")))


def contacts(found: DataFrame) -> DataFrame:
    """Adds the clean lists of addresses and numbers, and the chosen ones with their scores."""
    return chosen(found.withColumn("emails_found", exprs.clean_emails(F.col("raw_emails"), F.col("domain"))).withColumn("phones_found", exprs.clean_phones(F.col("raw_phones"))))


def chosen(clean: DataFrame) -> DataFrame:
    picked = clean.withColumn("e", exprs.best_email(F.col("emails_found"), F.col("domain"))).withColumn("p", exprs.best_phone(F.col("phones_found")))
    return picked.withColumns({"any_email": F.col("e.email"), "email_confidence": F.col("e.score"), "primary_phone": F.col("p.phone"), "phone_confidence": F.col("p.score")}).withColumns({"normalized_phone": exprs.normal_phone(F.col("primary_phone")), "phone_region_score": exprs.region_score(F.col("primary_phone")), "phone_reason": exprs.region_reasons(F.col("primary_phone"))}).drop("e", "p")


def signals(found: DataFrame) -> DataFrame:
    """One row per site, as sites() tells it, with everything that the score sheet reads."""
    own = contacts(feature_sets(found))
    return own.withColumns({"n_emails_raw": F.size("raw_emails"), "n_phones_raw": F.size("raw_phones"), "n_emails": F.size("emails_found"), "n_phones": F.size("phones_found")})


def scored(found: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Adds the columns of the score sheet; texts is a table of messages (messages.table) in place of the default."""
    lines = sheet.spark_sheet(messages.own_texts(texts)) if texts is not None else sheet.spark_sheet()
    for level in sheet.levels(lines):
        found = found.withColumns({name: F.expr(text) for name, text in level})
    return found


def leads(pages: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    return scored(signals(sites(pages)), texts)


def ranked(found: DataFrame, width: int = WIDTH) -> DataFrame:
    """Adds outreach_rank: by outreach priority, ties in order of first sight.

    Sites are dealt out by priority and range of first ordinal, width of them at most in a range, and counted. Counts
    add up in three levels, bands of priorities, priorities in a band and ranges of a priority, so that the one window
    that has no key sees the bands alone; a row's rank is what lies above and its place within its range.
    """
    span, band = F.floor(F.col("first_ordinal") / width).alias("span"), F.floor(F.col("outreach_priority") / BAND).alias("band")
    dealt = found.select("domain", band, F.col("outreach_priority").alias("level"), "first_ordinal", span)
    spans = dealt.groupBy("band", "level", "span").agg(F.count("*").alias("n"))
    levels = spans.groupBy("band", "level").agg(F.sum("n").alias("n"))
    bands = levels.groupBy("band").agg(F.sum("n").alias("n"))

    def above(rows: DataFrame, keys: list[str], order: Column, name: str) -> DataFrame:
        before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(name, F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")

    offsets = above(spans, ["band", "level"], F.col("span").asc(), "_spans").join(above(levels, ["band"], F.desc("level"), "_levels"), ["band", "level"]).join(above(bands, [], F.desc("band"), "_bands"), "band")
    within = F.row_number().over(Window.partitionBy("level", "span").orderBy("first_ordinal"))
    places = dealt.join(offsets.select("level", "span", (F.col("_spans") + F.col("_levels") + F.col("_bands")).alias("above")), ["level", "span"]).select(F.col("domain").alias("_d"), (F.col("above") + within).cast("int").alias("outreach_rank"))
    return found.join(places, F.col("domain") == F.col("_d")).drop("_d")


def nested(found: DataFrame) -> dict[str, Column]:
    """The structs of a lead: evidence by feature, brief, assets, profile and package."""
    evidence = F.map_from_entries(F.array_compact(F.array(*[F.when(F.col(f"evidence_{f}").isNotNull(), F.struct(F.lit(f), F.struct(F.col(f"evidence_{f}.url"), F.col(f"evidence_{f}.snippet")))) for f in rules.FEATURES])))
    named = lambda **c: F.struct(*[F.col(x).alias(n) for n, x in c.items()])
    brief = F.struct("why_now", "primary_pain", "recommended_first_message", "expected_objection", "response_strategy")
    assets = named(email_subject="asset_subject", opening_line="opening_line", first_email_body="first_email_body", phone_opener="phone_opener", follow_up_day_3="follow_up_day_3", follow_up_day_7="follow_up_day_7")
    context = named(pages_indexed="pages", digital_gap_score="opportunity", revenue_tier="revenue_tier", executive_priority_score="executive_priority_score")
    profile = F.struct(F.split("website_observations", "; ").alias("website_observations"), context.alias("business_context"), F.col("custom_opening"), F.col("sales_message_angle").alias("recommended_angle"))
    package = F.struct(
        named(subject="asset_subject", opening="opening_line", body="first_email_body", angle="email_angle", cta="offer_angle").alias("email"),
        named(opening="phone_opener", strategy="first_contact_strategy", message_angle="sales_message_angle").alias("phone"),
        named(day_3="follow_up_day_3", day_7="follow_up_day_7").alias("follow_up"),
        named(executive_action="executive_action", sales_motion="estimated_sales_motion", campaign_sequence="campaign_sequence", next_action="recommended_first_touch").alias("crm"),
    )
    return {"evidence": evidence, "executive_brief": brief, "outreach_assets": assets, "personalization_profile": profile, "outreach_package": package}


def lead_result(found: DataFrame) -> DataFrame:
    """The nested form: flat columns with evidence, brief, assets, profile and package as structs, scores as shown."""
    shown = {"digital_opportunity_score": F.col("digital_shown"), "partnership_opportunity_score": F.col("partnership_shown")}
    return found.withColumns(nested(found) | shown).drop("digital_shown", "partnership_shown", *[f"evidence_{f}" for f in rules.FEATURES])


def canonical(found: DataFrame, as_of: Column, campaign: str = "") -> DataFrame:
    """The canonical lead: seven groups, of the campaign of that name. The queue's state as the reference has it, and by level."""
    own = nested(found)
    return found.select(
        F.struct("domain", "lead_type", "prospect_type").alias("company"),
        F.struct(F.col("pages"), F.col("found"), F.col("missing"), own["evidence"].alias("evidence")).alias("website"),
        F.struct("emails_found", "phones_found", F.col("any_email").alias("primary_email"), "email_confidence", "primary_phone", "phone_confidence", "normalized_phone", "phone_region_score", "phone_reason", F.col("canonical_quality").alias("contact_quality_score")).alias("contacts"),
        F.struct("conversion", "opportunity", "lead_value", "priority", "sales_readiness", "sales_stage", "executive_priority_score").alias("scoring"),
        F.struct("revenue_opportunity_score", "revenue_tier", "revenue_reason", F.col("digital_shown").alias("digital_opportunity_score"), F.col("partnership_shown").alias("partnership_opportunity_score")).alias("opportunity"),
        F.struct(F.lit(campaign).alias("campaign"), "campaign_type", "outreach_priority", "outreach_channel", "recommended_pitch", own["outreach_package"].alias("outreach_package"), own["personalization_profile"].alias("personalization_profile"), F.col("canonical_priority").alias("priority_score"), "priority_level", "best_contact_method").alias("outreach"),
        F.struct(F.col("crm_state").alias("crm_status"), "sales_lane", F.col("crm_stage").alias("pipeline_stage"), F.col("crm_next_action").alias("next_action"), F.date_add(as_of, 14).cast("string").alias("follow_up_date"), F.lit(0).alias("attempt_count"), F.col("sales_readiness").alias("engagement_score"), F.date_add(as_of, F.col("level_follow_up")).cast("string").alias("level_follow_up_date")).alias("crm"),
    )


def contact_rows(found: DataFrame) -> DataFrame:
    """The 16 columns of the contact export; the level is empty there."""
    return found.select("domain", "lead_type", "sales_stage", "sales_readiness", "outreach_priority", F.lit("").alias("outreach_level"), F.col("any_email").alias("primary_email"), "primary_phone", "normalized_phone", "email_confidence", "phone_confidence", "phone_region_score", F.array_join("phone_reason", ", ").alias("phone_reason"), F.col("canonical_quality").alias("contact_quality_score"), F.col("crm_state").alias("crm_status"), "recommended_pitch")


def campaign_rows(found: DataFrame) -> DataFrame:
    """The 11 columns of the campaign export; what the canonical form drops is empty there."""
    none = F.lit("")
    return found.select(F.col("domain").alias("company"), F.concat(F.lit("https://"), "domain").alias("website"), F.array_join("emails_found", ", ").alias("emails"), F.array_join("phones_found", ", ").alias("phones"), "campaign_type", none.alias("recommended_subject"), none.alias("first_email_angle"), F.lit(0).alias("seminar_fit"), "sales_stage", none.alias("follow_up_priority"), none.alias("follow_up_days"))


def report_text(found: DataFrame) -> DataFrame:
    """domain, report: the console block of each lead."""
    line = lambda name, col: F.concat(F.lit(f"{name}: "), F.col(col).cast("string"))
    return found.select("domain", F.concat_ws("\n", "domain", line("Pages", "pages"), line("Conversion", "conversion"), line("Opportunity", "opportunity"), line("Value", "lead_value"), line("Priority", "priority"), F.concat(F.lit("Missing: "), F.array_join("missing", ", ")), line("Pitch", "pitch")).alias("report"))


def report_markdown(found: DataFrame) -> DataFrame:
    """domain, report: a lead's report in Markdown, section by section."""
    text = lambda name, col: F.concat(F.lit(name), F.col(col).cast("string"))
    items = lambda names: F.transform(names, lambda x: F.concat(F.lit("- "), x))
    lines = lambda *of: F.array(*[F.lit(x) if isinstance(x, str) else x for x in of])
    brief = [line for c in ("why_now", "primary_pain", "recommended_first_message", "expected_objection", "response_strategy") for line in (f"### {c}", F.col(c), "")]
    parts = F.concat(
        lines("# Conversion Opportunity Report", "", "## Business", F.col("domain"), ""),
        lines("## Executive Classification", "", text("- Action: ", "executive_action"), text("- Priority: ", "priority"), text("- Temperature: ", "lead_temperature"), text("- CRM Status: ", "crm_status"), ""),
        lines("## Scores", "", text("- Executive Priority: ", "executive_priority_score"), text("- Opportunity Score: ", "opportunity"), text("- Lead Value: ", "lead_value"), text("- Revenue Opportunity: ", "revenue_opportunity_score"), ""),
        lines("## Website Findings", ""), items(F.split("website_observations", "; ")),
        lines("", "## Missing Opportunities", ""), items(F.col("missing")),
        lines("", "## Contact Information", "", text("Email: ", "primary_email"), text("Phone: ", "primary_phone"), text("Recommended Contact: ", "target_contact_role"), ""),
        lines("## Executive Brief", "", *brief),
        lines("## Outreach Package", "", "Subject:", F.col("asset_subject"), "", "Opening:", F.col("opening_line"), "", "Body:", F.col("first_email_body"), ""),
        lines("## Phone Script", "", F.col("phone_opener")),
    )
    return found.select("domain", F.array_join(parts, "\n").alias("report"))


def top_lead_markdown(found: DataFrame) -> DataFrame:
    """One row: the report of the lead with the highest executive score, first seen first."""
    return report_markdown(found.orderBy(F.desc("executive_priority_score"), "first_ordinal").limit(1))


def beside(low: DataFrame, asked: DataFrame, before: int, after: int) -> DataFrame:
    """domain, ordinal, before, after: what stands around the asked pages (domain, ordinal, need_before, need_after: in
    characters) in their sites' text, where a line feed follows each page but the last; as much as is asked for. Asked
    pages that have nothing around them may be left out.

    A page meets the asked pages of its site as one list; it can be next only to the first of them on either side, so
    the next page is a maximum (minimum) by asked page, summed up where pages are read. Where that one is short, so
    many pages as there can be need for go through a window, which Spark cuts to that number before it deals them out.
    """
    wanted = asked.groupBy("domain", "ordinal").agg(F.max("need_before").alias("b"), F.max("need_after").alias("a"))
    lists = wanted.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("ordinal", "b", "a"))).alias("asked"))  # some for each signal of a site
    edges = low.select("domain", F.col("ordinal").alias("o"), F.expr(f"right(concat(low, '\n'), {before})").alias("tail"), F.expr(f"left(concat('\n', low), {after})").alias("head"))

    met = edges.join(lists, "domain").select("domain", "o", "tail", "head", F.expr("array_min(filter(asked, x -> x.ordinal > o AND x.b > 0))").alias("x"), F.expr("array_max(filter(asked, x -> x.ordinal < o AND x.a > 0))").alias("y"))
    sides = F.expr("filter(array(struct(true AS back, x.ordinal AS ordinal, x.b AS need, tail AS edge), struct(false AS back, y.ordinal AS ordinal, y.a AS need, head AS edge)), z -> z.ordinal IS NOT NULL)")
    key = ["domain", "ordinal", "back"]
    near = F.when(F.col("back"), -F.col("o")).otherwise(F.col("o"))  # least next to the asked page, on either side
    next_ = met.select("domain", "o", F.explode(sides).alias("s")).select("domain", "o", "s.*").groupBy(*key, "need").agg(F.min(F.struct(near.alias("o"), "edge"))["edge"].alias("text"))
    short = next_.where("length(text) < need").select(*key, "need")
    further = edges.join(short, "domain").where("CASE WHEN back THEN o < ordinal ELSE o > ordinal END").select(*key, "need", "o", F.expr("CASE WHEN back THEN tail ELSE head END").alias("edge"))
    few = further.withColumn("i", F.row_number().over(Window.partitionBy(*key).orderBy(near))).where(F.col("i") <= max(before, after))  # a page has one character at least, its line's end
    ordered = F.array_sort(F.collect_list(F.struct("o", "edge")))
    more = few.groupBy(*key).agg(F.array_join(F.transform(ordered, lambda x: x["edge"]), "").alias("more"))
    both = next_.join(more, key, "left").groupBy("domain", "ordinal").agg(*[F.coalesce(F.max(F.when(F.col("back") == side, F.coalesce("more", "text"))), F.lit("")).alias(name) for side, name in ((True, "_b"), (False, "_a"))])
    return both.select("domain", "ordinal", F.expr(f"right(_b, {before})").alias("before"), F.expr(f"left(_a, {after})").alias("after"))


def verified_signals(pages: DataFrame) -> DataFrame:
    """domain, feature, place, snippet: the second detector's first two keywords per feature, each with its first
    occurrence in the site's lower-case text (pages in order, a line each) and what stands around it. A site without
    any has one row, with an empty feature and place 0."""
    low = with_domain(pages).select("domain", "ordinal", F.lower("text").alias("low"))
    words = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(i).alias("place"), F.lit(w).alias("word")) for f, ws in rules.SIGNALS.items() for i, w in enumerate(ws)])
    none = F.array(F.struct(F.lit("").alias("feature"), F.lit(0).alias("place"), F.lit("").alias("word")))
    found = low.withColumn("found", F.filter(words, lambda w: F.col("low").contains(w["word"])))
    hits = found.select("domain", "ordinal", "low", F.explode(F.when(F.size("found") > 0, F.col("found")).otherwise(none)).alias("w")).withColumn("at", F.expr("locate(w.word, low)"))
    own = F.struct("ordinal", "at", F.expr("substring(low, greatest(at - 80, 1), least(at - 1, 80))").alias("left"), F.expr("substring(low, at, 150)").alias("right"))
    first = hits.groupBy("domain", "w.feature", "w.place").agg(F.min(F.when(F.col("w.feature") != "", own)).alias("hit"))
    site = Window.partitionBy("domain")
    two = F.row_number().over(Window.partitionBy("domain", "feature").orderBy("place"))
    first = first.withColumns({"place": two, "some": F.max("feature").over(site) != ""}).where("place <= 2").select("domain", "feature", "place", "some", "hit.*")
    asked = first.where("feature <> ''").select("domain", "ordinal", F.expr("greatest(81 - at, 0)").alias("need_before"), F.expr("150 - length(right)").alias("need_after"))
    near = beside(low, asked.where("need_before > 0 OR need_after > 0"), 80, 150)
    text = F.expr("concat(right(coalesce(before, ''), greatest(81 - at, 0)), left, left(concat(right, coalesce(after, '')), 150))")
    whole = first.where("feature <> ''").join(near, ["domain", "ordinal"], "left").select("domain", "feature", "place", F.translate(text, "\n", " ").alias("snippet"))
    return whole.union(first.where("NOT some").select("domain", "feature", F.lit(0).alias("place"), F.lit("No conversion signals detected").alias("snippet")))
