"""Tree scoring against a plain scorer that states every sum by its definition, and pages that a word list would spoil."""

import random
from xml.etree import ElementTree

import pytest

from tripspark.llm import html_text
from tripspark.llm.html_text import extract

LONG = "Long text, with commas, that goes on and on. " * 8


def plain(page: str) -> str:
    """Main text of well-formed pages of html, body, main, article, div, p, a, h2 without classes."""
    root = ElementTree.fromstring(page)
    parent = {c: p for p in root.iter() for c in p}
    letters = lambda e: sum(len(t.strip()) for t in e.itertext())
    own = lambda e: [e.text or ""] + [c.tail or "" for c in e]

    def points(e):
        if e.tag == "p":
            size = letters(e)
        elif e.tag in ("div", "article", "main", "body") and any(t.strip() for t in own(e)):
            size = sum(len(t.strip()) for t in own(e))
        else:
            return 0
        return 1 + sum(t.count(",") for t in own(e)) + min(size // 100, 3) if size else 0

    def ancestors(e):
        while e in parent:
            e = parent[e]
            yield e

    def steps(e, holder):
        """How far above the first element that gets the points of ``e``, None if it gets none."""
        line = list(ancestors(e)) if e.tag == "p" else [e, *ancestors(e)]
        return line.index(holder) if holder in line[:5] else None

    score = {}
    for holder in root.iter():
        got = [points(e) / (1, 2, 6, 9, 12)[steps(e, holder)] for e in root.iter() if points(e) and steps(e, holder) is not None]
        if got:
            linked = sum(letters(a) for a in holder.iter("a"))
            score[holder] = sum(got) * (2.5 if holder.tag in ("article", "main") else 1) * (1 - linked / letters(holder))

    def read(e):
        inner = (e.text or "") + "".join(read(c) + (c.tail or "") for c in e)
        return inner if e.tag == "a" else f" {inner} "

    if not score:
        return " ".join(read(root).split())
    best = max(root.iter(), key=lambda e: score.get(e, -1))
    kept = [best]
    if best.tag not in ("body", "html"):
        for c in parent[best]:
            reads = c.tag == "p" and letters(c) and sum(letters(a) for a in c.iter("a")) < 0.25 * letters(c)
            if c is not best and (score.get(c, 0) >= max(2, 0.2 * score[best]) or reads or c.tag == "h2"):
                kept.append(c)
        kept = [c for c in parent[best] if c in kept]
    return " ".join("".join(map(read, kept)).split())


def random_page(rng):
    words = lambda n: " ".join(rng.choice(["alpha", "beta,", "gamma", "delta."]) for _ in range(n))

    def block(depth):
        kind = rng.choice(["p", "p", "p", "h2", "div", "div", "article", "main", "text"]) if depth < 5 else "p"
        if kind == "text":
            return words(rng.randrange(1, 30))
        if kind == "h2":
            return f"<h2>{words(3)}</h2>"
        if kind == "p":
            link = f'<a href="x">{words(rng.randrange(1, 20))}</a>' if rng.random() < 0.3 else ""
            return f"<p>{words(rng.randrange(0, 60))}{link}</p>"
        return f"<{kind}>{''.join(block(depth + 1) for _ in range(rng.randrange(1, 4)))}</{kind}>"

    return f"<html><body>{''.join(block(0) for _ in range(rng.randrange(1, 5)))}</body></html>"


@pytest.mark.parametrize("seed", range(300))
def test_equals_plain_scorer(seed):
    page = random_page(random.Random(seed))
    assert extract(page) == plain(page), page


@pytest.mark.parametrize("name", ["legal-studies", "social", "alert-systems", "side-effects"])
def test_subjects_in_class_names_lose_no_article(name):
    page = f'<html><body><div class="{name}">{f"<p>{LONG}</p>" * 6}</div><div>A footer note.</div></body></html>'
    assert extract(page) == " ".join((LONG * 6).split())


def test_small_asides_and_comments_go_whatever_they_hold():
    article = f"<div><p>{LONG}</p><p>{LONG}</p></div>"
    page = f'<body><div class="social"><p>Share, share.</p></div>{article}<div class="comments">{f"<p>{LONG}</p>" * 9}</div></body>'
    assert extract(page) == " ".join((LONG * 2).split())


def test_two_articles_are_both_kept():
    page = f"<body><main><article><p>{LONG}</p><p>{LONG}</p></article><article><p>{LONG}</p></article></main></body>"
    assert extract(page) == " ".join((LONG * 3).split())


def test_link_lists_beside_the_article_go():
    links = "".join(f'<p><a href="{i}">Some other story, and more of it</a></p>' for i in range(20))
    page = f"<body><div><div><p>{LONG}</p><p>{LONG}</p></div><div>{links}</div></div></body>"
    assert extract(page) == " ".join((LONG * 2).split())
    assert html_text.SIBLING < 1
