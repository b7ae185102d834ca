"""Site states: what a stretch of a site's pages tells, small and mergeable.

A page becomes a state where it is read, in one pass: scores, evidence, words found, addresses,
telephone numbers, and its edges. States of neighbouring stretches merge to the state of both, by
sums, maxima, unions of bits and a fold of edges, so a site is a merge of its buckets of pages, and a
bucket one of its pages; what arrives later is merged on top. Nothing gathers a site's text.

Edges serve what lies over the seam of pages, which are joined with a space between. An edge is whole,
where a stretch has nothing but edge, or it has a head and a tail. Two kinds are kept: seam, the first
and last SEAM characters, for keywords (a shorter stretch is whole); and run, the characters of
telephone numbers at either end (a stretch of such characters alone is whole). Between two stretches
that are not whole a closed text forms, in which words and numbers are found once for all.

Words are keywords and the literals that patterns require. A page's set of them is found first; a
pattern is only tried on pages that have its literal, and is settled by it where it is nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import exprs, rules

#: No keyword is longer than this.
SEAM = 32
#: Ordinals of one site whose edges meet in one list.
WIDTH = 1 << 13
#: Bits of a mask that are used.
BITS = 60
WORDS = list(dict.fromkeys([w for ws in rules.KEYWORDS.values() for w in ws] + [literal for p in exprs.all_patterns() for literal, _ in exprs.required(p)]))
MASKS = [f"words{i}" for i in range(-(-len(WORDS) // BITS))]
RUN = r"^[+\d\s().-]*"
ORDER = ["first", "seam", "run"]


def bits(words: list[str]) -> list[int]:
    """The masks of the words."""
    places = {WORDS.index(w) for w in words}
    return [sum(1 << p % BITS for p in places if p // BITS == i) for i in range(len(MASKS))]


def with_domain(pages: DataFrame) -> DataFrame:
    """ordinal, url, text, domain of the pages whose url names a site; nulls count as empty."""
    kept = pages.select("ordinal", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("text", F.lit("")).alias("text"))
    return kept.withColumn("domain", exprs.clean_domain(F.col("url"))).where("domain != ''")


# The expressions below have hundreds of parts, and are built as SQL text, which is parsed at once.


def words_in(text: str, mask: int) -> Column:
    """The mask of the words that the text, a column in lower case, has."""
    own = WORDS[mask * BITS : (mask + 1) * BITS]
    table = ", ".join(f"named_struct('word', {quoted(w)}, 'bit', {1 << i}L)" for i, w in enumerate(own))
    return F.expr(f"aggregate(filter(array({table}), w -> contains({text}, w.word)), 0L, (m, w) -> m | w.bit)")


def quoted(text: str) -> str:
    return "r'" + text + "'"  # neither words nor patterns have quotation marks


def has(words: list[str]) -> str:
    """Whether the masks have one of the words."""
    return "(" + " OR ".join(f"({name} & {mask}L) != 0" for name, mask in zip(MASKS, bits(words), strict=True) if mask) + ")"


def shows(pattern: str) -> str:
    """Whether the page matches, by its masks, and by its normal text where a literal alone does not tell."""
    return " OR ".join(f"{has([literal])} AND normal RLIKE {quoted(rest)}" if rest else has([literal]) for literal, rest in exprs.required(pattern))


def score(feature: str) -> Column:
    total = " + ".join(f"CASE WHEN {shows(p)} THEN {weight} ELSE 0 END" for p, weight in rules.PATTERNS[feature].items())
    if feature in rules.FLOORS:
        pattern, floor = rules.FLOORS[feature]
        total = f"greatest({total}, CASE WHEN {shows(pattern)} THEN {floor} ELSE 0 END)"
    return F.expr(total).cast("int")


def page_scores(pages: DataFrame) -> DataFrame:
    """with_domain(), low (the text in lower case), the masks, and score_<feature> of each page."""
    low = with_domain(pages).withColumn("low", F.lower("text"))
    found = low.withColumns({name: words_in("low", i) for i, name in enumerate(MASKS)})
    tried = [literal for p in exprs.all_patterns() for literal, rest in exprs.required(p) if rest]
    normal = found.withColumn("normal", F.when(F.expr(has(tried)), F.regexp_replace("low", r"(?U)\s+", " ")))
    return normal.withColumns({f"score_{f}": score(f) for f in rules.FEATURES}).drop("normal")


def page_states(pages: DataFrame) -> DataFrame:
    """The state of each page: domain, first, last, pages, best_<feature>, evidence_<feature>, masks, emails, phones, seam, run."""
    rows = page_scores(pages)
    evidence = {f"evidence_{f}": F.when(F.col(f"score_{f}") >= rules.SHOWN, F.struct("ordinal", "url", F.substring("text", 1, 300).alias("snippet"))) for f in rules.FEATURES}
    rows = rows.withColumns({"_head": F.regexp_extract("text", RUN, 0), "_size": F.length("text")}).withColumn("_tail", F.when(F.length("_head") < F.col("_size"), F.reverse(F.regexp_extract(F.reverse("text"), RUN, 0))).otherwise(""))
    inner = F.expr("substring(text, length(_head) + 1, _size - length(_head) - length(_tail))")
    seam = F.expr(f"CASE WHEN length(low) < {SEAM} THEN struct(true AS whole, low AS head, '' AS tail) ELSE struct(false AS whole, left(low, {SEAM}) AS head, right(low, {SEAM}) AS tail) END")
    matches = lambda text, pattern: F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return rows.select(
        "domain", F.col("ordinal").alias("first"), F.col("ordinal").alias("last"), F.lit(1).cast("bigint").alias("pages"),
        *[F.col(f"score_{f}").alias(f"best_{f}") for f in rules.FEATURES], *[c.alias(n) for n, c in evidence.items()], *MASKS,
        matches(F.col("text"), rules.EMAIL).alias("emails"), matches(inner, rules.PHONE).alias("phones"),
        seam.alias("seam"), F.struct((F.length("_head") == F.col("_size")).alias("whole"), F.col("_head").alias("head"), F.col("_tail").alias("tail")).alias("run"),
    )


def folded(rows: DataFrame, kind: str) -> DataFrame:
    """Replaces the list <kind>, edges in order, by one edge, and adds closed, the texts between."""
    rows = rows.withColumn("_open", F.expr(f"filter(sequence(0, size({kind}) - 1), i -> NOT {kind}[i].whole)"))
    k, heads = "size(_open)", f"transform({{}}, x -> x.head)"  # noqa: F541
    up_to = heads.format(f"slice({kind}, 1, _open[0] + 1)")
    after = lambda i: heads.format(f"slice({kind}, _open[{i}] + 2, {{}})")
    between = after("j - 1").format("_open[j] - _open[j - 1]")
    rest = after(f"{k} - 1").format(f"size({kind}) - _open[{k} - 1] - 1")
    one = f"""CASE WHEN {k} = 0 THEN struct(true AS whole, array_join({heads.format(kind)}, ' ') AS head, '' AS tail)
      ELSE struct(false AS whole, array_join({up_to}, ' ') AS head, array_join(concat(array({kind}[_open[{k} - 1]].tail), {rest}), ' ') AS tail) END"""
    closed = f"CASE WHEN {k} > 1 THEN transform(sequence(1, {k} - 1), j -> array_join(concat(array({kind}[_open[j - 1]].tail), {between}), ' ')) ELSE cast(array() AS array<string>) END"
    return rows.withColumns({"_one": F.expr(one), "closed": F.expr(closed)}).withColumn(kind, F.col("_one")).drop("_one", "_open")


def added_words(rows: DataFrame, text: Column) -> DataFrame:
    """The masks with the words of the text."""
    return rows.withColumn("_text", text).withColumns({name: F.col(name).bitwiseOR(words_in("_text", i)) for i, name in enumerate(MASKS)}).drop("_text")


def added_phones(rows: DataFrame, text: Column) -> DataFrame:
    return rows.withColumn("phones", F.array_distinct(F.concat("phones", F.regexp_extract_all(text, F.lit(rules.PHONE), F.lit(0)))))


def merged(states: DataFrame, *keys: Column | str) -> DataFrame:
    """One state per key, of states that are disjoint stretches; the key columns beside the state's own."""
    together = [f for f in states.columns if f.startswith("evidence_")]
    aggs = [F.min("first").alias("first"), F.max("last").alias("last"), F.sum("pages").alias("pages"), *[F.max(f"best_{f}").alias(f"best_{f}") for f in rules.FEATURES], *[F.min(c).alias(c) for c in together], *[F.bit_or(m).alias(m) for m in MASKS]]
    aggs += [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("emails", "phones")]
    rows = states.groupBy(*keys).agg(*aggs, F.array_sort(F.collect_list(F.struct(*ORDER))).alias("_edges"))
    rows = rows.withColumns({k: F.expr(f"transform(_edges, x -> x.{k})") for k in ("seam", "run")}).drop("_edges")
    rows = folded(rows, "run")
    rows = added_phones(rows, F.array_join("closed", "x")).drop("closed")  # x is in no number
    rows = folded(rows, "seam")
    # What is longer than a seam has been seen, and is cut.
    long = F.expr(f"filter(array(seam.head, seam.tail), x -> length(x) > {SEAM})")
    cut = f"""CASE WHEN seam.whole AND length(seam.head) < {SEAM} THEN seam
      ELSE struct(false AS whole, left(seam.head, {SEAM}) AS head, right(CASE WHEN seam.whole THEN seam.head ELSE seam.tail END, {SEAM}) AS tail) END"""
    return added_words(rows, F.array_join(F.concat("closed", long), "\0")).withColumn("seam", F.expr(cut)).drop("closed")


def site_states(pages: DataFrame, width: int = WIDTH) -> DataFrame:
    """One state per site: pages merge in buckets of a site's ordinals, and these to sites."""
    buckets = merged(page_states(pages), "domain", F.floor(F.col("first") / width).alias("bucket"))
    return merged(buckets.drop("bucket"), "domain")


def count(words: list[str]) -> Column:
    return F.expr(" + ".join(f"bit_count({name} & {mask}L)" for name, mask in zip(MASKS, bits(words), strict=True) if mask))


def finished(states: DataFrame) -> DataFrame:
    """What whole sites tell: pages, first_ordinal, best_, has_ and evidence_<feature>, counts of keywords, prospect
    types, raw_emails, raw_phones. Keywords of prospect types are looked for in the text with the domain after it."""
    rows = added_words(states, F.concat_ws("\0", "seam.head", "seam.tail"))
    rows = added_phones(rows, F.concat_ws("x", "run.head", "run.tail"))
    named = F.lower(F.concat(F.when(F.col("seam.whole"), F.col("seam.head")).otherwise(F.col("seam.tail")), F.lit(" "), F.col("domain")))
    rows = rows.withColumn("_named", named)
    own = {f"n_{g}": count(rules.KEYWORDS[g]) for g in ("seminar", "community", "event", "education", "industry", "association")}
    own |= {f"kw_{w}": F.expr(has([w])) for w in rules.KEYWORDS["role"]}
    own |= {f"is_{g}": F.expr(has(rules.KEYWORDS[g])) | exprs.any_of(F.col("_named"), rules.KEYWORDS[g]) for g in ("home", "society")}
    own |= {f"has_{f}": F.col(f"best_{f}") >= rules.SHOWN for f in rules.FEATURES}
    own |= {"pages": F.col("pages").cast("int"), "raw_emails": F.array_sort("emails"), "raw_phones": F.array_sort("phones")}
    return rows.withColumns(own).withColumnRenamed("first", "first_ordinal").drop("_named", "last", "emails", "phones", "seam", "run", *MASKS)
