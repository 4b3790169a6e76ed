"""Main texts of the given pages against an extractor of another kind, and density where no name tells."""

from html.parser import HTMLParser
from pathlib import Path

import pytest

from unblend.llm import density

PAGES = Path("/root/testdata/sf0.01/pages.parquet")


class Article(HTMLParser):
    """Text of <article> by an event parser: blocks end lines, what is never text is skipped. It knows these pages' marks and no density."""

    BLOCKS = {"p", "h1", "h2", "h3", "li", "ul", "ol", "div", "table", "tr", "td", "th", "blockquote", "pre", "section", "article", "br", "hr", "figure", "figcaption"}
    SKIPPED = {"script", "style", "nav", "aside", "form", "footer", "header", "button", "select", "noscript", "iframe"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside = self.skipped = 0
        self.lines = [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.skipped += tag in self.SKIPPED or any(k == "class" and v in ("ad", "comments", "notice", "sidebar") for k, v in attrs)
        if tag == "br":
            self.lines[-1] += " "
        elif tag in self.BLOCKS:
            self.lines.append("")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in self.BLOCKS:
            self.lines.append("")

    def handle_data(self, data):
        if self.inside and not self.skipped:
            self.lines[-1] += data


def other(html):
    """None where the page has anything in its article that this extractor can't follow."""
    page = Article()
    at = html.lower().find("<article")
    if at < 0:
        return None
    page.feed(html[at : html.lower().rfind("</article")])
    page.close()
    if page.skipped:
        return None
    return "\n".join(x for x in (" ".join(line.split()) for line in page.lines) if x)


@pytest.mark.skipif(not PAGES.exists(), reason="the given tables aren't here")
@pytest.mark.parametrize("names", [density.AROUND_NAMES, frozenset()])
def test_given_pages(spark, names):
    pages = density.extract_main_text(spark.read.parquet(str(PAGES)), names=names).collect()
    told = [(p, other(p.html)) for p in pages if p.html]
    told = [(p, t) for p, t in told if t is not None]
    assert len(told) > 0.9 * len(pages)
    wrong = [p.page_id for p, t in told if p.text != t]
    assert not wrong


BODY = "".join(f"<p>A paragraph of the story, number {k}, which goes on for a while and says what there is to say.</p>" for k in range(6))
SHORT = "<h1>A title of some words</h1><p>One sentence that is the whole of it.</p>"
BOX = "<div>Buy this now, a box that nobody named, in one plain sentence of prose.</div>"


@pytest.mark.parametrize("story", [BODY, SHORT, "<h1>Only a title</h1>"])
@pytest.mark.parametrize("tag", ["article", "div", "td"])
def test_unnamed_boxes_go_by_density_and_place(story, tag):
    inner = f"<{tag}>{story}</{tag}>" if tag != "td" else f"<table><tr><td>{story}</td></tr></table>"
    page = f"<html><body><nav><a href=/>Home</a></nav>{BOX}{inner}<footer>Contact</footer></body></html>"
    text = density.main_text(page, frozenset())
    assert text == density.main_text(page.replace(BOX, ""), frozenset())
    assert "Buy" not in text and ("title" in text or "number 5" in text)


def test_a_text_in_several_boxes_stays_whole():
    parts = "".join(f"<div>{BODY}</div>" for _ in range(3))
    text = density.main_text(f"<body><div><h1>Title</h1>{parts}<p>A short end.</p></div></body>", frozenset())
    assert text.count("number 5") == 3 and text.startswith("Title") and text.endswith("A short end.")
