"""Pages that earlier rules lost text of, and the scores beside a plain count over an own tree."""

import random

import pytest
from tallyfield.llm import html_text

LONG = "A sentence of the article, with some words in it. " * 8


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p title=it's>Hello there, reader <p>We don't stop, here", "Hello there, reader\nWe don't stop, here"),
        ("<p title='a > b' class=\"c>d\">x, y</p>", "x, y"),
        ("<div id='discussion'><p>The only article, here.</p></div>", "The only article, here."),
        ("<div class='search-results'><h2>Found</h2><p>The only article, here.</p></div><footer>f</footer>", "Found\nThe only article, here."),
        ("<div class='legal-news'><p>The only article, here.</p><div class=comments><p>nice, very, nice</p></div></div>", "The only article, here."),
        ("<form id=aspnet><div class=content><p>" + LONG + "</p></div><div class=search><p>go</p></div></form>", LONG.strip()),
        ("<div class=content><p>" + LONG + "</p></div><form><p>mail, us, now</p></form>", LONG.strip()),
        ("<div class='sidebar'/><p>side, side</p></div><div><p>" + LONG + "</p></div>", LONG.strip()),
        ("<body><a href=/x/>menu</a><div><p>" + LONG + "</p></div></body>", "menu\n" + LONG.strip()),
        ("<div class=comments><p>" + LONG * 3 + "</p></div><p>Short, real text.</p>", "Short, real text."),
        ("<div class='cookie-notice'><p>We use cookies</p></div><nav>n</nav>", ""),
        ("<div class=content><h1>T</h1><section><p>" + LONG * 6 + "</p></section><section><p>" + LONG + "</p></section></div><div class=sidebar><p>" + LONG + "</p></div>", "T\n" + (LONG * 6).strip() + "\n" + LONG.strip()),
        ("<div><div><p>" + LONG + "</p></div><div><p>" + LONG + "</p></div></div><div><div><p>" + LONG * 4 + "</p></div></div>", "\n".join(x.strip() for x in (LONG, LONG, LONG * 4))),
        ("<div><p>" + LONG + "</p></div><div><p>" + LONG + "</p></div>", LONG.strip() + "\n" + LONG.strip()),  # a tie
        ("<div><p>" + LONG + "</p></div><ul><li><a href=a>one link, here</a><li><a href=b>another, link</a></ul>", LONG.strip()),
    ],
)
def test_cases(page, text):
    assert html_text.main_text(page) == text


def test_unended_quotes_take_no_long_time():
    assert html_text.main_text("<p a='x " * 2000 + "<p>end") is not None


def test_scores_equal_a_plain_count():
    """Points of random trees of div and p, counted again by walking up from each paragraph."""
    rng = random.Random(6)
    for _ in range(30):
        paths: list[tuple[int, ...]] = []

        def build(path, depth):
            html = ""
            for k in range(rng.randint(1, 3)):
                if depth < 4 and rng.random() < 0.6:
                    html += "<div>" + build((*path, k), depth + 1) + "</div>"
                else:
                    words = ", ".join(["word"] * rng.randint(1, 60))
                    paths.append((path, words))
                    html += f"<p>{words}</p>"
            return html

        page = build((), 0)
        want: dict[tuple[int, ...], float] = {}
        for path, words in paths:
            for k in range(html_text.DEPTH):
                if len(path) - k >= 0:
                    at = path[: len(path) - k]
                    want[at] = want.get(at, 0) + (1 + words.count(",") + len(words) / 100) / 2**k
        scored = {}
        real = html_text.blocks

        def keep(html):
            nodes, found = real(html)
            scored["nodes"] = nodes
            return nodes, found

        html_text.blocks = keep
        try:
            text = html_text.main_text(page)
        finally:
            html_text.blocks = real
        got = sorted(round(n.score, 6) for n in scored["nodes"] if n.tag in ("#", "div") and n.score)
        assert got == sorted(round(x, 6) for x in want.values() if x)
        assert sorted(text.split("\n")) == sorted(w for _, w in paths)


LINE = "The committee met on Monday, heard the report of the engineers, and put the vote off until the spring, when the figures of the survey are due. "


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<article><h1>Notice</h1><div class='notice'>{LINE * 4}</div></article>", f"Notice\n{(LINE * 4).strip()}"),
        (f"<div class=content><h1>News</h1><p>{LINE * 2}</p></div><div class='cookieConsent'>{LINE}</div>", f"News\n{(LINE * 2).strip()}"),
        (f"<article><p>{LINE}</p><div class='adBox'>{LINE}</div><div id='readerComments'><p>{LINE * 3}</p></div></article>", LINE.strip()),
        (f"<article><p>{LINE}</p><div class='ADBox'>{LINE}</div><div class='userBio'>{LINE}</div></article>", f"{LINE.strip()}\n{LINE.strip()}"),
        (f"<article><h2>Top</h2><div class='notice'>{LINE * 4}</div><p>{LINE}</p></article>", f"Top\n{LINE.strip()}"),
    ],
)
def test_names_in_camel_case_and_pages_of_a_heading_and_a_bad_name(page, text):
    assert html_text.main_text(page) == text
