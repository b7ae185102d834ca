"""Operator 10: what varies leads, names break ties, and nothing depends on how many pages a host has."""

import random
import re

import pyarrow.parquet as pq
import pytest

from leadloom.llm import html

WORDS = [f"w{i}" for i in range(400)]


def prose(own, n):
    return " ".join(own.choice(WORDS) for _ in range(n))


def extracted(spark, pages):
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(2)
    return {r["page_id"]: r["text"] for r in html.main_text(df).collect()}


@pytest.mark.parametrize("pages", [2, 3, 4, 20])
def test_layouts_at_any_number_of_pages(spark, pages):
    own, rows, want = random.Random(pages), [], {}
    for i in range(pages):
        text, more, box = prose(own, 60), prose(own, 40), prose(own, 20)
        menu = "<ul><li>Home page</li><li>All our news</li></ul>"
        rows.append((i, f"http://plain.example/{i}", f"<body>{menu}<div class=x1><p>{text}<p>{more}</div><p>All rights reserved</body>"))
        want[i] = f"{text}\n{more}"
        rows.append((100 + i, f"http://recipes.example/{i}", f"<body>{menu}<div class='menu-recipes'><p>{text}</div><div class=x2><p>{box}</div></body>"))
        want[100 + i] = text
        rows.append((200 + i, f"http://staff.example/{i}", f"<body>{menu}<article><p>{text}<p>Reporting by our staff.</article><footer>site</footer></body>"))
        want[200 + i] = f"{text}\nReporting by our staff."
        rows.append((300 + i, f"http://forms.example/{i}", f"<body><form>{menu}<div class=x3><p>{text}<p>{more}</div></form></body>"))
        want[300 + i] = f"{text}\n{more}"
        rows.append((400 + i, f"http://talk.example/{i}", f"<body><article><p>{box}</article><div id=comments><p>{text}<p>{more}</div></body>"))
        want[400 + i] = box
        rows.append((500 + i, f"http://share{i}.example/", f"<body><section class='share-price'><p>{text}</section></body>"))  # a host of its own each
        want[500 + i] = text
        rows.append((600 + i, f"http://boxes.example/{i}", f"<body><article><p>{text}<div class=x4><p>Read more of us</div><p>{more}</article></body>"))
        want[600 + i] = f"{text}\n{more}"
    got = extracted(spark, rows)
    assert {k: v for k, v in got.items() if v != want[k]} == {}


def test_copies_are_no_evidence(spark):
    own = random.Random(1)
    text = prose(own, 80)
    rows = [(i, f"http://copies.example/{i}", f"<body><div class=x1><p>{text} {'again' * (i > 1)}</p><p>{text[:50]} {i}</p></div></body>") for i in range(6)]
    got = extracted(spark, rows)
    assert all(got[i].startswith(text) and got[i].endswith(str(i)) for i in got)


def test_without_any_names(spark, monkeypatch):
    """With all lists of words and names of menus empty, the driver's pages that share a host keep their texts."""
    table = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["page_id", "url", "html"]).to_pylist()
    hosts: dict[str, list] = {}
    for r in table:
        hosts.setdefault(re.sub(r"^\w+://([^/?#]+).*", r"\1", r["url"] or "").lower(), []).append(r)

    def texts():
        found = {}
        for own in hosts.values():
            sums: dict[str, list] = {}
            for r in own:
                for role, (n, place, held) in html.roles(r["html"] or "").items():
                    s = sums.setdefault(role, [0, 0, 0, 0, 0, set()])
                    key = hash((r["page_id"], role.startswith("never"))) % 10**9
                    for i, x in enumerate((1, n, key * n, place, held)):
                        s[i] += x
                    s[5].add(hash(r["html"]))
            rows = [(role, s[0], s[2], 0, s[3] / s[0], s[4], len(s[5])) for role, s in sums.items() if 1 < s[0] == s[1] and 2 * s[0] >= len(own)]
            form = html.form_of(html.template(rows)) if len(own) > 1 else html.form_of("")
            found |= {r["page_id"]: html.extracted(r["html"] or "", form) for r in own}
        return found

    with_names = texts()
    for name in ("PAGE_WORDS", "MAIN_WORDS", "COMMENT_WORDS", "PAGE_ROLES"):
        monkeypatch.setattr(html, name, frozenset())
    monkeypatch.setattr(html, "worth", lambda last: 0)
    monkeypatch.setattr(html, "aside", lambda token, inside: token.name in html.RAW)
    without = texts()
    many = [r["page_id"] for own in hosts.values() if len(own) > 4 for r in own]
    same = sum(with_names[i] == without[i] for i in many) / len(many)
    print(f"{same:.4f} of {len(many)} texts are the same without names, of all {sum(with_names[k] == without[k] for k in with_names) / len(with_names):.4f}")
    assert len(many) > 100 and same > 0.9
