"""Labelled training pages: seeded random layouts whose blocks say whether they are content."""

from __future__ import annotations

import random

SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi zo".split()


def _sentence(rng: random.Random, low: int, high: int) -> str:
    words = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
    return " ".join(words).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])


def _text(rng: random.Random) -> str:
    if rng.random() < 0.25:
        return _sentence(rng, 1, 3)  # short paragraphs are content too
    said = " ".join(_sentence(rng, 4, 18) for _ in range(rng.randint(1, 6)))
    return said if rng.random() < 0.8 else f'{said} <a href="/x">{_sentence(rng, 1, 3)}</a> <em>{_sentence(rng, 2, 5)}</em>'


def _block(tag: str, label: int, inner: str, hint: str = "") -> str:
    shown = f' class="{hint}"' if hint else ""
    return f'<{tag}{shown} data-label="{label}">{inner}</{tag}>'


def _links(rng: random.Random, n: int, label: int = 0) -> str:
    items = (_block("li", label, f'<a href="/{k}">{_sentence(rng, 1, 2)}</a>') for k in range(n))
    return _block("ul", label, "".join(items))


def _bare_links(rng: random.Random) -> str:
    """Links that no list holds."""
    return rng.choice([" ", " | ", "<br>", " &middot; "]).join(f'<a href="/{k}">{_sentence(rng, 1, 2)}</a>' for k in range(rng.randint(1, 6)))


def _bare_text(rng: random.Random) -> str:
    """Paragraphs that only line breaks part."""
    return rng.choice(["<br><br>", "<br>", "<br/>\n<br/>"]).join(_text(rng) for _ in range(rng.randint(2, 9)))


def _away(rng: random.Random, kind: str) -> str:
    """A block that is not content, of a kind, marked by its tag, its class or both."""
    tag, hints, inner = {
        "menu": ("nav", ["menu", "main-nav", "navbar"], lambda: _links(rng, rng.randint(3, 9))),
        "header": ("header", ["site-header masthead", "banner"], lambda: _block("div", 0, _sentence(rng, 1, 5)) + _links(rng, 4)),
        "footer": ("footer", ["footer", "site-footer"], lambda: rng.choice([lambda: _sentence(rng, 3, 12), lambda: _block("p", 0, _sentence(rng, 3, 20)) + _links(rng, 4)])()),
        "sidebar": ("aside", ["sidebar", "side widget", "related"], lambda: _block("h3", 0, _sentence(rng, 1, 3)) + rng.choice([lambda: _links(rng, 5), lambda: _block("p", 0, _sentence(rng, 4, 25))])()),
        "ad": ("div", ["ad", "ads banner", "advert", "sponsored promo"], lambda: rng.choice([lambda: _sentence(rng, 3, 15), lambda: _block("p", 0, _sentence(rng, 5, 20)), lambda: f'<a href="/ad">{_sentence(rng, 2, 9)}</a>'])()),
        "notice": ("div", ["cookie-notice", "consent banner", "notice alert", "newsletter subscribe"], lambda: _block("p", 0, _sentence(rng, 6, 25)) + _block("button", 0, _sentence(rng, 1, 2))),
        "form": ("form", ["search", "login", "newsletter", ""], lambda: _block("p", 0, _sentence(rng, 2, 10)) + _block("label", 0, _sentence(rng, 1, 2)) + _block("button", 0, _sentence(rng, 1, 1))),
        "comments": ("section", ["comments", "discussion comments", "replies"], lambda: _block("h2", 0, _sentence(rng, 1, 2)) + "".join(_block("div", 0, _block("p", 0, _text(rng)), "comment") for _ in range(rng.randint(1, 5)))),
    }[kind]
    made = inner()
    if tag in ("div", "section"):
        return _block(rng.choice(["div", tag]), 0, made, rng.choice(hints))
    return rng.choice([lambda: _block(tag, 0, made), lambda: _block(tag, 0, made, rng.choice(hints)), lambda: _block("div", 0, made, rng.choice([h for h in hints if h] or ["form"]))])()


def _content(rng: random.Random) -> str:
    parts = [_block("h1", 1, _sentence(rng, 1, 14))]
    if rng.random() < 0.3:
        parts = [_block("header", 1, parts[0])]
    for _ in range(rng.randint(1, 14)):
        parts.append(
            rng.choices(
                [
                    lambda: _block("p", 1, _text(rng)),
                    lambda: _block(rng.choice(["h2", "h3"]), 1, _sentence(rng, 1, 8)),
                    lambda: _block(rng.choice(["ul", "ol"]), 1, "".join(_block("li", 1, _sentence(rng, 1, 15)) for _ in range(rng.randint(1, 6)))),
                    lambda: _block("blockquote", 1, _block("p", 1, _text(rng))),
                    lambda: _block("pre", 1, _sentence(rng, 1, 10)),
                    lambda: _block("figure", 1, _block("figcaption", 1, _sentence(rng, 2, 9))),
                    lambda: _block("table", 1, _block("tr", 1, "".join(_block("td", 1, _sentence(rng, 1, 3)) for _ in range(3)))),
                    lambda: _block("div", 1, _text(rng)),
                    lambda: _block("div", 1, _block("div", 1, _block("p", 1, _text(rng)))),
                    lambda: _away(rng, rng.choice(["ad", "sidebar", "form"])),
                ],
                [14, 2, 1, 1, 0.5, 0.5, 0.5, 1.5, 1, 1],
            )[0]()
        )
    if rng.random() < 0.15:
        parts.append(_away(rng, "comments"))
    return "".join(parts)


def page(rng: random.Random) -> str:
    """One page; its main text stands in an article, a main or a box, alone or within others, or in the body itself."""
    inner = _content(rng)
    cell = lambda label, made: f'<td data-label="{label}">{made}</td>'
    body = rng.choice(
        [
            lambda: _block("article", 1, inner, rng.choice(["", "", "post", "entry"])),
            lambda: _block("main", 1, _block("article", 1, inner)),
            lambda: _block("main", 1, inner),
            lambda: _block("div", 1, inner, rng.choice(["content", "article-body", "post entry", "story text"])),
            lambda: _block("div", 1, _block("div", 1, inner, "content"), "wrapper main"),
            lambda: _block("div", 1, inner),
            lambda: _block("div", 1, _block(rng.choice(["div", "section"]), 1, inner)),
            lambda: _block("section", 1, inner),
            lambda: inner,
            lambda: _block("div", 0, _block("div", 0, _links(rng, 5)) + _block("div", 1, inner)),
            lambda: f'<table data-label="0"><tr data-label="0">{cell(0, _links(rng, 5))}{cell(1, inner)}</tr></table>',
            lambda: f'<table data-label="0"><tr data-label="0">{cell(0, _bare_links(rng))}{cell(1, rng.choice([inner, _bare_text(rng)]))}</tr></table>',
            lambda: _block("div", 1, rng.choice(["", _block("h1", 1, _sentence(rng, 1, 9))]) + _bare_text(rng), rng.choice(["", "", "content", "text"])),
            lambda: _block("div", 1, _bare_text(rng)),
        ]
    )()
    bare = [_block("div", 0, _bare_links(rng)) for _ in range(2) if rng.random() < 0.2]
    before = bare[:1] + [_away(rng, k) for k in ("menu", "header", "notice", "ad", "form") if rng.random() < 0.45]
    after = [_away(rng, k) for k in ("sidebar", "comments", "footer", "ad", "notice", "menu", "form") if rng.random() < 0.4]
    rng.shuffle(before)
    whole = "".join([*before, body, *after, *bare[1:]])
    return f'<html><head><title>{_sentence(rng, 2, 5)}</title></head><body data-label="0">{whole}</body></html>'


def labelled(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return [page(rng) for _ in range(n)]
