"""Labelled pages for fitting the extraction model: texts of given pages laid out anew, so that the place of each is known.

Pages mark what is content by ``data-fit``: 1 or 0 for all below, until marked otherwise.
"""

from __future__ import annotations

import random
import re
from collections.abc import Sequence
from html import escape

from callquality.llm.html import HINTS, TreeModel, fit_tree_model, parse_pages

#: Texts for a table without labelled pages.
_STOCK = ["The reading room opens at nine and closes late in the evening, and the last train leaves an hour after that.", "Water boils sooner on high ground.", "He wrote three letters. None of them was sent.", "Short line", "More"]


def labelled_by_markup(html: str) -> str:
    """A page whose own article (else main) element says what is content; what menus, asides, footers and forms hold isn't."""
    tag = "article" if re.search(r"<article[\s>]", html, re.I) else "main"
    html = re.sub(rf"<{tag}(?=[\s>])", f'<{tag} data-fit="1"', html, flags=re.I)
    return re.sub(r"<(nav|aside|footer|form)(?=[\s>])", r'<\1 data-fit="0"', html, flags=re.I)


class _Layout:
    """One page: texts in random places of a random layout."""

    def __init__(self, rnd: random.Random, content: Sequence[str], other: Sequence[str]):
        self.rnd, self.content, self.other = rnd, content, other

    def words(self, low: int, high: int) -> str:
        w = self.rnd.choice(self.content).split()
        return escape(" ".join(w[: self.rnd.randint(low, high)]) or "x")

    def name(self, kind: str) -> str:
        """A class or id with a hint, alone or among other words; often none for content, rarely none for the rest."""
        word = self.rnd.choice(HINTS[kind].split())
        form = self.rnd.choice(["{}", "{}", "site-{}", "{}-wrap", "c_{}", "block {}", "{}Box", "post-{}", "main-{}", "page-{}", "article-{}"] if kind != "content" else ["{}", "{}", "{}-wrap", "site-{}", "{}Inner", "l-{}"])
        return f' {self.rnd.choice(["class", "class", "id"])}="{form.format(word)}"'

    def box(self, tags: str, kind: str, inner: str, bare: float = 0.1) -> str:
        tag = self.rnd.choice(tags.split())
        attributes = "" if self.rnd.random() < bare and tag in ("div", "section", "ul") or tag in ("nav", "aside", "footer", "header") and self.rnd.random() < 0.5 else self.name(kind)
        return f'<{tag}{attributes} data-fit="0">{inner}</{tag}>'

    def links(self, low: int, high: int) -> str:
        found = [f'<a href="/{k}">{self.words(1, 4)}</a>' for k in range(self.rnd.randint(low, high))]
        if self.rnd.random() < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in found) + "</ul>"
        return self.rnd.choice([" | ", " ", "<br>"]).join(found)

    def prose(self) -> str:
        """A text of the size of paragraphs or of what stands beside them."""
        return escape(self.rnd.choice(self.other if self.rnd.random() < 0.4 else self.content)[:2000])

    def boilerplate(self, kind: str) -> str:
        rnd = self.rnd
        if kind == "menu":
            return self.box("nav nav div ul", kind, self.links(3, 12), bare=0.4)
        if kind == "header":
            return self.box("header header div", kind, rnd.choice([f"<h1>{self.words(1, 5)}</h1>", f'<a href="/">{self.words(1, 3)}</a>', ""]) + rnd.choice([f"<p>{self.words(2, 12)}</p>", "", self.links(2, 6)]))
        if kind == "footer":
            return self.box("footer footer div", kind, rnd.choice([f"&copy; {self.words(1, 6)}", f"<p>&copy; 2020 {self.words(1, 4)} &middot; {self.prose()}</p>", self.links(2, 8) + f"<p>{self.words(3, 20)}</p>", f"<p>{self.prose()}</p>"]), bare=0.2)
        if kind == "side":
            return self.box("aside aside div", kind, f"<h3>{self.words(1, 4)}</h3>" + rnd.choice([self.links(2, 8), f"<p>{self.prose()}</p>", f'<p>{self.words(5, 30)} <a href="/m">{self.words(1, 3)}</a></p>' * rnd.randint(1, 4)]), bare=0)
        if kind == "form":
            return self.box("form form div", kind, f"<label>{self.words(1, 3)}</label><input name=q><button>{self.words(1, 2)}</button>" + rnd.choice(["", f"<p>{self.words(3, 25)}</p>"]), bare=0)
        if kind == "comments":
            one = "".join(f'<{t} class="comment"><div class="author">{self.words(1, 3)}</div><p>{self.prose()}</p></{t}>' for t in [rnd.choice(["li", "div", "article"])] * rnd.randint(1, 5))
            return self.box("section div div ol", kind, f"<h3>{rnd.randint(1, 90)} {self.words(1, 2)}</h3>{one}", bare=0)
        if kind == "meta":
            return self.box("div p ul", kind, rnd.choice([f"{self.words(1, 3)} &middot; 12.03.2019", f'<a href="/a">{self.words(1, 3)}</a>']), bare=0)
        if kind == "share":
            return self.box("div ul", kind, self.links(2, 5), bare=0)
        if kind == "hidden":
            return f'<div {rnd.choice(["hidden", "style=\"display:none\"", "class=\"hidden\""])} data-fit="0"><p>{self.prose()}</p></div>'
        return self.box("div div section aside p", kind, rnd.choice([self.prose(), f"<p>{self.prose()}</p>", f"{self.words(2, 15)} <a href='/x'>{self.words(1, 3)}</a>"]), bare=0)

    def paragraph(self) -> str:
        rnd, text = self.rnd, escape(self.rnd.choice(self.content)[:3000])
        w = text.split(" ")
        if len(w) > 6 and rnd.random() < 0.4:
            k = rnd.randrange(len(w) - 2)
            tag = rnd.choice(["a href='/in'", "b", "em", "span class=x", "code"])
            w[k : k + 2] = [f"<{tag}>{' '.join(w[k : k + 2])}</{tag.split()[0]}>"]
            text = " ".join(w)
        roll = rnd.random()
        if roll < 0.7:
            return rnd.choice([f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br><p>{text}</p>", f"<div>{text}</div>"] if roll < 0.2 else [f"<p>{text}</p>"])
        if roll < 0.8:
            return f"<h{rnd.randint(2, 4)}>{self.words(1, 9)}</h2>"
        if roll < 0.88:
            return "<ul>" + "".join(f"<li>{self.words(1, 25)}</li>" for _ in range(rnd.randint(1, 6))) + "</ul>"
        if roll < 0.94:
            return rnd.choice([f"<blockquote><p>{text}</p></blockquote>", f"<pre>{text}</pre>", f"<figure><img src=x><figcaption>{self.words(2, 15)}</figcaption></figure>"])
        return "<table>" + "".join(f"<tr><td>{self.words(1, 6)}<td>{self.words(1, 6)}</tr>" for _ in range(rnd.randint(1, 4))) + "</table>"

    def html(self) -> str:
        rnd = self.rnd
        body = [rnd.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", ""]).format(self.words(1, 12))]
        if rnd.random() < 0.3:
            body.append(self.boilerplate("meta"))
        for _ in range(rnd.choice([0, 1, 2, 3, 5, 8, 12, 20])):
            body.append(self.paragraph())
            if rnd.random() < 0.07:
                body.append(self.boilerplate(rnd.choice(["advert", "share", "side", "form", "notice", "meta"])))
        body.append(f"<p>{self.words(1, 400)}</p>")
        if rnd.random() < 0.25:
            body.append(self.boilerplate(rnd.choice(["share", "meta", "comments", "side", "form"])))
        tag = rnd.choice(["article", "article", "main", "div", "div", "section", "td"])
        inner = f'<{tag}{self.name("content") if tag != "article" and rnd.random() < 0.6 else ""} data-fit="1">{"".join(body)}</{tag}>'
        inner = f"<table><tr>{inner}</tr></table>" if tag == "td" else inner
        after = [self.boilerplate("comments")] if rnd.random() < 0.3 else []
        before = [self.boilerplate("menu")] if rnd.random() < 0.2 else []
        for _ in range(rnd.choice([0, 0, 1, 2])):
            inner = f"<{(t := rnd.choice(['div', 'main', 'section']))}{self.name('content') if rnd.random() < 0.5 else ''}>{''.join(before)}{inner}{''.join(after)}</{t}>"
            before, after = [], [self.boilerplate(rnd.choice(["side", "share", "advert"]))] if rnd.random() < 0.3 else []
        top = [self.boilerplate(k) for k in ("hidden", "notice", "header", "menu", "advert", "form", "side") if rnd.random() < 0.4]
        bottom = [self.boilerplate(k) for k in ("side", "comments", "form", "notice", "advert", "menu", "footer") if rnd.random() < 0.35]
        rnd.shuffle(top)
        head = f"<head><title>{self.words(1, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{''.join(top)}{''.join(before)}{inner}{''.join(after)}{''.join(bottom)}" + rnd.choice(["</body></html>", ""])


def relaid_pages(samples: Sequence[str], n: int = 400, seed: int = 7) -> list[str]:
    """``n`` labelled pages in random layouts, from the texts of pages that ``labelled_by_markup`` can label."""
    pages = parse_pages([labelled_by_markup(h) for h in samples])
    texts: dict[int, list[str]] = {0: [], 1: []}
    for text, label in zip(pages.text, pages.label, strict=True):
        if text:
            texts[label].append(text)
    content, other = texts[1] or _STOCK, texts[0] or _STOCK
    rnd = random.Random(seed)
    return [_Layout(rnd, content, other).html() for _ in range(n)]


def fit_on_pages(samples: Sequence[str], relaid: int = 400, seed: int = 7) -> TreeModel:
    """A model fitted on a bounded sample of pages as they are and on ``relaid`` pages made of their texts."""
    return fit_tree_model(parse_pages([labelled_by_markup(h) for h in samples] + relaid_pages(samples, relaid, seed)))
