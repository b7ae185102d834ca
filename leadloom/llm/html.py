"""Main-text extraction by equivalence-class template deduction.

The tokens of a page are its tags, told apart by the path of containers they stand in, and its
pieces of text (what stands between the tags of blocks). Per host, tokens that share their vector of occurrences over the pages form an
equivalence class; the vectors are compared by two sums of page hashes, which partial aggregation
adds up, so a host with a third of all pages is no group of any task. Classes that occur once in
every page they are in, on at least half of the host's pages, and whose tokens keep their order,
nest into the host's template: containers, which are its slots, and fixed texts. What a slot holds
beyond fixed texts varies from page to page, and that leads to the article: from the page inwards,
always into the slot that holds twice as much of what varies as all beside it, as long as one does.

Names of elements break ties. A slot named as the article's is taken where no other that could be it
varies twice as much (else all are); fixed texts in it stay, but for those of slots within that have nothing else.
Elsewhere they go. Slots named as menus, notices and the like are left out, unless most of what varies
stands there and nothing is named as the article's; readers' comments always are, if anything else
varies.

A text is fixed if it is on two unlike pages at least (by a lower bound), in a class of at least half of
the pages, and if the slot it leads to is not mostly of such texts: pages that are copies of each other
are no evidence. Defined results: a null or empty page has an empty text; a page whose url is null or
has no host, the only page of a host, and one that lacks the template's slot are each their own
template, of slots alone; repeated rows each get their text; markup cut off at the end of a page is
dropped. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, stored, whole_text

# Names of elements, by their part in a page.
CONTAINERS = frozenset("body main article section nav header footer aside div form table ul ol dl menu dialog".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption blockquote pre figure figcaption hr address details summary fieldset html head".split())
RAW = frozenset("script style noscript template textarea title iframe svg select object".split())
SKIPPED = frozenset("nav footer aside form menu dialog button head".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
PAGE_WORDS = frozenset("ad ads advert advertisement advertising sponsor sponsored promo banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent notice notices popup modal newsletter subscribe comment comments disqus replies reply respond social share sharing related widget toolbar".split())
MAIN_WORDS = frozenset("article content main post entry story".split())
PAGE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())

COMMENT_WORDS = frozenset("comment comments disqus replies reply respond".split())
#: On so many unlike pages at least a text has to be to belong to the template.
SUPPORT = 2

TAG = re.compile(r"<!--(?:.*?-->|.*\Z)|<(?=[a-zA-Z/!?])(?:/?([a-zA-Z][^\s/>]*))?((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
CUT_OFF = re.compile(r"<[a-zA-Z/!?][^>]*\Z")


class Token(NamedTuple):
    """A tag or a text node; kind is 'open', 'close' or 'text'."""

    kind: str
    name: str
    words: frozenset
    text: str


@lru_cache(maxsize=4096)
def marks(attributes: str) -> frozenset:
    """The words of class and id, and the role with an equals sign before it."""
    found = set()
    for key, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        if key.lower() in ("role", "itemprop"):
            found.add("=" + value)
        else:
            found |= {w for part in value.split() for w in (part, *re.split(r"[-_]+", part)) if w}
    return frozenset(found)


def tokens(page: str) -> Iterator[Token]:
    """The page's tokens; what scripts and styles hold is left out."""
    at, size = 0, len(page)
    while at < size:
        m = TAG.search(page, at)
        end = m.start() if m else size
        if end > at:
            text = page[at:end]
            if not m and "<" in text:
                text = CUT_OFF.sub("", text)
            yield Token("text", "", frozenset(), text)
        if not m:
            return
        at = m.end()
        name = (m[1] or "").lower()
        if not name:
            continue
        if m[0].startswith("</"):
            yield Token("close", name, frozenset(), "")
            continue
        yield Token("open", name, marks(m[2]) if "=" in m[2] else frozenset(), "")
        if name in RAW and not m[2].endswith("/"):
            closing = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = closing.end() if closing else size
        elif name in VOID or m[2].endswith("/"):
            yield Token("close", name, frozenset(), "")


def label(token: Token) -> str:
    """How a container is called in a path: its tag and marks."""
    return ".".join([token.name, *(re.sub(r"[/#<>*.\s]", "", w) for w in sorted(token.words))])


def aside(token: Token, inside: bool) -> bool:
    """Whether a container is one of menus, notices and the like by itself; inside: within an article."""
    if token.name in SKIPPED or token.name in RAW:
        return True
    if token.name == "header" and not inside:
        return True
    if token.words & {"=" + r for r in PAGE_ROLES}:
        return True
    return token.name in CONTAINERS and bool(token.words & PAGE_WORDS) and not token.words & MAIN_WORDS


class Walk:
    """The open containers while a page is read."""

    def __init__(self, kept: frozenset = frozenset()) -> None:
        self.kept = kept  # paths that are no asides
        self.open: list[tuple[str, str, bool]] = []  # tag, path, whether aside

    def step(self, token: Token) -> None:
        if token.kind == "open" and contains(token.name):
            path = f"{self.open[-1][1] if self.open else ''}/{label(token)}"
            inside = any(tag in ("article", "main") for tag, _, _ in self.open)
            self.open.append((token.name, path, path not in self.kept and ((bool(self.open) and self.open[-1][2]) or aside(token, inside))))
        elif token.kind == "close" and any(tag == token.name for tag, _, _ in self.open):
            while self.open.pop()[0] != token.name:
                pass

    @property
    def path(self) -> str:
        return self.open[-1][1] if self.open else ""

    @property
    def out(self) -> bool:
        return bool(self.open) and self.open[-1][2]


def steps(page: str, walk: Walk, keyed: bool = True) -> Iterator[tuple[Token | None, str, str]]:
    """While walk follows the page: (tag, path before it, ''), and before a block's or container's tag (None, piece
    of text, its role). A role has the text's hash, its number among the same on the page, and the path."""
    held: list[str] = []
    seen: Counter = Counter()

    def piece() -> tuple[None, str, str] | None:
        raw = "".join(held)
        held.clear()
        if not (text := " ".join(raw.split())):
            return None if not raw else (None, raw, "")
        if not keyed:
            return None, raw, "#"
        role = f"#{xxhash.xxh3_64_hexdigest(text)}{walk.path}"
        seen[role] += 1
        return None, raw, role if seen[role] == 1 else f"#{seen[role]}{role}"

    for token in tokens(page):
        if token.kind == "text":
            held.append(token.text)
            continue
        if token.name == "br":
            held.append(" ")
        elif held and (token.name in BLOCKS or token.name in SKIPPED) and (found := piece()):
            yield found
        before = walk.path
        walk.step(token)
        yield token, before, ""
    if held and (found := piece()):
        yield found


def roles(page: str) -> dict[str, tuple[int, int, int]]:
    """Each token's role: occurrences, place of the first, and characters of text: its own, or the container's."""
    count: Counter = Counter()
    first: dict[str, int] = {}
    held: Counter = Counter()
    walk = Walk()
    for n, (token, before, role) in enumerate(steps(page, walk)):
        if token is None:
            if not role:
                continue
            size = len(before.strip())
            held[role] += size
            for _, path, _ in walk.open:
                held[f"{path}<"] += size
        elif token.kind == "open":
            role = f"{walk.path}<" if walk.path != before else f"{walk.path}/{token.name}<"
        else:
            role = f"{before}>" if walk.path != before else f"{walk.path}/{token.name}>"
        count[role] += 1
        first.setdefault(role, n)
    return {r: (c, first[r], held[r]) for r, c in count.items()}


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))


def templates(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chunk_bytes: int = 8 << 20) -> DataFrame:
    """host, template: per host the slots of its template, one a line: 'path', '*path' for the article's ('*' for all),
    '!path' for one that is no aside; and '#role' for each fixed text."""
    plain = pages.select(pages[id_col].cast("string").alias("_id"), host_of(F.col(url_col)).alias("_host"), whole_text(html_col).alias("_html"))
    plain = plain.where("_host != '' AND _html != ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over the pages of a batch, so that a host's common tokens leave a task as few rows."""
        for batch in chunks(batches, "_html", chunk_bytes):
            sums: dict[tuple[str, str], list[int]] = {}
            for key, host, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = xxhash.xxh3_64_intdigest(f"{key}\n{page}")
                kind = 1 << xxhash.xxh3_64_intdigest(page) % 63  # so many bits in all, so many unlike pages at least
                for role, (n, place, held) in [*roles(page).items(), ("", (1, 0, 0))]:
                    row = sums.setdefault((host, role), [0] * 7)
                    for i, x in enumerate((1, n, (digest & 0x3FFFFFFF) * n, (digest >> 34) * n, place, held)):
                        row[i] += x
                    row[6] |= kind
            keys = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in keys], pa.string()), pa.array([r for _, r in keys], pa.string()), *(pa.array([sums[k][i] for k in keys], pa.int64()) for i in range(7))], ["host", "role", "pages", "n", "s1", "s2", "place", "held", "kinds"])

    # Stored, so that pages are read once for both sums below.
    summed = stored(plain.mapInArrow(run, "host string, role string, pages bigint, n bigint, s1 bigint, s2 bigint, place bigint, held bigint, kinds bigint"), "roles")
    total = [F.sum(c).alias(c) for c in ("pages", "n", "s1", "s2", "place", "held")]
    total.append(F.bit_count(F.bit_or("kinds")).alias("kinds"))
    by_role = summed.where("role != ''").groupBy("host", "role").agg(*total).where("pages > 1 AND pages = n")
    by_host = summed.where("role = ''").groupBy("host").agg(F.sum("pages").alias("of_host"))
    # At most twice a page's mean number of roles is on half of a host's pages: a bounded list.
    steady = by_role.join(by_host, "host").where("2 * pages >= of_host")
    listed = steady.groupBy("host").agg(F.collect_list(F.struct("role", "pages", "s1", "s2", (F.col("place") / F.col("pages")).alias("place"), "held", "kinds")).alias("roles"))

    def nest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [template([tuple(r.values()) for r in own]) for own in batch.column("roles").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(found, pa.string())], ["host", "template"])

    return listed.mapInArrow(nest, "host string, template string")


def within(path: str, top: str) -> bool:
    return not top or path == top or path.startswith(top + "/")


def named_aside(path: str) -> bool:
    """Whether the container of that path is one of menus, notices and the like by itself."""
    *above, last = path.split("/")
    name, *words = last.split(".")
    return aside(Token("open", name, frozenset(words), ""), any(part.split(".")[0] in ("article", "main") for part in above))


def contains(name: str) -> bool:
    """Whether an element is a step of paths."""
    return name in CONTAINERS or name in SKIPPED


def valid(members: list[tuple]) -> bool:
    """Whether a class's tokens are in order and nest: (place, role, ...) each. A container opens after those around it
    and before their ends, it ends while it is the innermost that the class has an end of, and a text stands in its own.

    Places are means over the pages of a class, each of which has each token once: what nests on every page nests so.
    """
    own = {m[1] for m in members}
    stack: list[str] = []
    ended: set[str] = set()

    def leave() -> bool:
        path = stack.pop()
        return f"{path}>" not in own or path in ended

    for _, role, *_ in sorted(members):
        path = role[role.index("/") :] if role.startswith("#") and "/" in role else role[:-1]
        above, _, last = path.rpartition("/")
        if role.startswith("#") or not contains(last.split(".")[0]):
            around = path if role.startswith("#") else above
            if f"{around}<" in own and around not in stack:
                return False
        elif role.endswith("<"):
            parts = path.split("/")
            around = ("/".join(parts[:i]) for i in range(2, len(parts)))
            if any(f"{a}<" in own and a not in stack for a in around):
                return False
            while stack and not path.startswith(stack[-1] + "/"):
                if not leave():
                    return False
            stack.append(path)
        else:
            ended.add(path)
            if f"{path}<" in own:
                if path not in stack:
                    return False
                while stack[-1] != path:
                    if not leave():
                        return False
                stack.pop()
    return True


def template(rows: list[tuple]) -> str:
    """The template of a host from its steady roles: (role, pages, s1, s2, place, held, kinds)."""
    classes: dict[tuple, list[tuple]] = {}
    for role, pages, s1, s2, place, held, kinds in rows:
        classes.setdefault((pages, s1, s2), []).append((place, role, held, kinds))
    slots: dict[str, int] = {}
    fixed: dict[str, int] = {}
    for members in classes.values():
        if not valid(members):
            continue
        for _, role, held, kinds in members:
            if role.startswith("#"):
                if kinds >= SUPPORT:
                    fixed[role] = held
                continue
            if not role.endswith("<"):
                continue
            slots[role[:-1]] = held
    slots = {p: held for p, held in slots.items() if "." in p or contains(p.rsplit("/", 1)[-1])}
    place_of = lambda role: role[role.index("/") :] if "/" in role else ""

    def varying(fixed: dict[str, int]) -> dict[str, int]:
        found = dict(slots)
        for role, held in fixed.items():
            for p in slots:
                if within(place_of(role), p):
                    found[p] -= held
        return found

    main, named, kept = article(varying(fixed), slots)
    if fixed and 2 * sum(n for r, n in fixed.items() if within(place_of(r), main)) > slots.get(main, sum(slots[p] for p in outer(slots))):
        fixed = {r: n for r, n in fixed.items() if not within(place_of(r), main)}  # copies of each other
        main, named, kept = article(varying(fixed), slots)
    vary = varying(fixed)
    empty = [p for p in slots if vary[p] <= 0 and p != main and within(p, main)]
    gone = [r for r in fixed if not (named and within(place_of(r), main)) or any(within(place_of(r), p) for p in empty)]
    return "\n".join(["*" + main, *sorted(p for p in slots if p != main), *("!" + p for p in sorted(kept)), *sorted(gone)])


def outer(paths: Iterable[str]) -> list[str]:
    known = set(paths)
    return [p for p in known if not any(p.startswith(q + "/") for q in known)]


def article(vary: dict[str, int], slots: Iterable[str]) -> tuple[str, bool, list[str]]:
    """The article's slot ('' for the page), whether it is named so, and the slots around and in it that are no asides in spite of their names."""
    whole = sum(vary[p] for p in outer(slots))
    asides = {p for p in slots if named_aside(p)}
    told = lambda p, words: bool(words & set(p.rsplit("/", 1)[-1].split(".")[1:]))
    comments = {p for p in asides if told(p, COMMENT_WORDS)}
    around = lambda p, some: [q for q in some if within(p, q)]
    large = {p for p in asides - comments if 2 * vary[p] > whole}
    by_tag = {p for p in asides if p.rsplit("/", 1)[-1].split(".")[0] in SKIPPED or p.rsplit("/", 1)[-1].split(".")[0] == "header"}
    free = [p for p in slots if vary[p] > 0 and not around(p, asides - large)]
    named = [p for p in free if worth(p.rsplit("/", 1)[-1]) > 0 and p not in asides]
    best = max(named, key=lambda p: (worth(p.rsplit("/", 1)[-1]), vary[p], p), default=None)
    if best is not None:
        others = [p for p in slots if vary[p] > 2 * vary[best] and not within(p, best) and not within(best, p) and not around(p, by_tag | comments)]
        return (best, True, around(best, asides)) if not others else ("", False, around(best, asides))
    kept = sorted(large)
    left = [p for p in slots if not around(p, asides - set(kept))]
    main, room = "", sum(vary[p] for p in outer(left))
    while inside := [p for p in left if p != main and within(p, main) and 3 * vary[p] > 2 * room]:
        main = min(inside, key=lambda p: (p.count("/"), -vary[p], p))
        room = vary[main]
    return main, False, kept


class Form(NamedTuple):
    """A host's template as extraction reads it. main: the article's slot, '' for all, None without a template."""

    main: str | None
    kept: frozenset
    fixed: frozenset


@lru_cache(maxsize=1024)
def form_of(text: str) -> Form:
    lines = text.split("\n") if text else []
    return Form(next((x[1:] for x in lines if x.startswith("*")), None), frozenset(x[1:] for x in lines if x.startswith("!")), frozenset(x for x in lines if x.startswith("#")))


def worth(last: str) -> int:
    """How much a container looks like the article's: by its tag, role and marks. 0 and less: not at all."""
    tag, *words = last.split(".")
    if tag in SKIPPED:
        return -1
    return 4 * (tag == "article" or "=articlebody" in words) + 2 * (tag == "main" or "=main" in words) + (tag in CONTAINERS and bool(MAIN_WORDS & set(words)))


def own_form(page: str) -> Form:
    """The template of a page that is taken by itself: its slots."""
    return form_of(template([(role, 1, 0, 0, place, held, 1) for role, (n, place, held) in roles(page).items() if n == 1]))


def extracted(page: str, form: Form) -> str:
    """The blocks that vary in the article's slot; of a page without a template, or without that slot, by the page's own."""
    if form.main is None:
        form = own_form(page)
    walk = Walk(form.kept)
    held: list[tuple[str, str, bool]] = []  # piece, path, whether it is a block's end
    opened = {""}
    for token, raw, role in steps(page, walk, bool(form.fixed)):
        if token is None:
            if not walk.out and role not in form.fixed:
                held.append((raw, walk.path, False))
            continue
        opened.add(walk.path)
        if token.name in BLOCKS:
            held.append(("", walk.path, True))
    if form.main not in opened:
        own = own_form(page)
        return extracted(page, own._replace(fixed=form.fixed if own.main in opened else own.fixed)) if own.main in opened else ""
    blocks, block = [], []
    for raw, path, ends in [*held, ("", "", True)]:
        if not ends:
            if within(path, form.main):
                block.append(raw)
        elif block:
            if text := " ".join(html.unescape("".join(block)).split()):
                blocks.append(text)
            block.clear()
    return "\n".join(blocks)


RESULT = "page_id bigint, url string, text string, n_chars bigint"


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chunk_bytes: int = 8 << 20) -> DataFrame:
    """page_id, url, text, n_chars: the main text of each page."""
    # Stored, the templates have a known size: Spark broadcasts them while they are small. Beyond, it deals out pages by
    # host, and splits a hot host's, as nothing but the join stands in that stage.
    found = stored(templates(pages, id_col, url_col, html_col, chunk_bytes), "templates").select(F.col("host").alias("_host"), F.col("template").alias("_form"))
    plain = pages.select(pages[id_col].cast("bigint").alias("_id"), pages[url_col].cast("string").alias("_url"), host_of(F.col(url_col)).alias("_host"), whole_text(html_col).alias("_html"))
    joined = plain.join(found, "_host", "left").select("_id", "_url", "_html", "_form")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_html", chunk_bytes):
            texts = [extracted(page, form_of(form or "")) for page, form in zip(batch.column("_html").to_pylist(), batch.column("_form").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_id").combine_chunks(), batch.column("_url").combine_chunks(), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, RESULT)
