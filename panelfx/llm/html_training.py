"""Labelled training pages for the extraction field: page layouts written out by a seeded generator, every block with
its label (1: main text)."""

from __future__ import annotations

import random

from .html_text import Field, blocks, featurize, train

_SYLLABLES = "ka lo mi ter an des vo ri sta nel qu per ou in ma tion der est sol be".split()
# Names that page authors give to the parts of a page (fixed values).
ASIDE = "ad ads advert advertisement banner sidebar related widget promo sponsored share social newsletter subscribe cookie consent notice popup modal breadcrumb breadcrumbs pagination menu navbar tags author-box".split()
REMARKS = "comment comments discussion replies reviews respond".split()
MAIN = "content article post entry story main body text article-body post-content entry-content".split()


class _Page:
    def __init__(self, seed: int):
        self.r, self.html, self.labels = random.Random(seed), [], {}

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def text(self, lo: int, hi: int, stop: float = 0.95) -> str:
        words = [self.word() for _ in range(self.r.randint(lo, hi))]
        for i in range(5, len(words) - 1, 7):
            words[i] += self.r.choice([",", ".", ",", ""])
        words[0] = words[0].capitalize() + f"{len(self.labels)}x"  # makes each text unique
        return " ".join(words) + ("." if self.r.random() < stop else "")

    def add(self, label: int, text: str, before: str, after: str) -> None:
        self.labels[text.split(" ")[0].rstrip(".")] = label
        self.html.append(before + text + after)

    def links(self, n: int, tag: str = "li") -> None:
        for _ in range(n):
            self.add(0, self.text(1, 3, 0.1), f'<{tag}><a href="/x">', f"</a></{tag}>")

    def main(self, comments: bool) -> None:
        r = self.r
        if r.random() < 0.85:
            self.add(1, self.text(3, 14, 0.4), "<h1>", "</h1>")
        for _ in range(r.randint(1, 9)):
            x = r.random()
            if x < 0.12:
                self.add(1, self.text(2, 7, 0.1), "<h2>", "</h2>")
            elif x < 0.2:
                self.html.append("<ul>")
                for _ in range(r.randint(2, 4)):
                    self.add(1, self.text(2, 14, 0.5), "<li>", "</li>")
                self.html.append("</ul>")
            elif x < 0.25:
                self.add(1, self.text(6, 30), "<blockquote><p>", "</p></blockquote>")
            elif x < 0.28:
                self.add(1, self.text(4, 20), "<pre>", "</pre>")
            elif x < 0.31:
                self.html.append("<table><tr>")
                for _ in range(2):
                    self.add(1, self.text(1, 6, 0.2), "<td>", "</td>")
                self.html.append("</tr></table>")
            elif x < 0.35:
                self.add(1, self.text(3, 14), "<figure><figcaption>", "</figcaption></figure>")
            else:
                self.add(1, self.text(1, 90), r.choice(["<p>", "<p>", "<p><b>"]), r.choice(["</p>", "</p>", "<br>"]))
        if comments and r.random() < 0.5:
            self.remarks()

    def remarks(self) -> None:
        kind, tag = self.r.choice(REMARKS), self.r.choice(["div", "section", "ol"])
        self.html.append(f'<{tag} class="{kind}">')
        for _ in range(self.r.randint(1, 4)):
            self.add(0, self.text(3, 40), "<p>", "</p>")
        self.html.append(f"</{tag}>")

    def aside(self) -> None:
        r = self.r
        x, kind = r.random(), r.choice(ASIDE)
        if x < 0.5:
            self.add(0, self.text(2, 30), f'<div class="{kind}">' + r.choice(["", "<p>", "<span>"]), "</div>")
        elif x < 0.7:
            self.html.append(f'<aside class="{kind}"><ul>')
            self.links(r.randint(2, 5))
            self.html.append("</ul></aside>")
        elif x < 0.85:
            self.html.append(f'<form id="{kind}">')
            self.add(0, self.text(1, 6, 0.3), "<label>", "</label>")
            self.add(0, self.text(1, 2, 0.1), "<button>", "</button>")
            self.html.append("</form>")
        else:
            self.add(0, self.text(4, 40), "<aside><p>", "</p></aside>")


def labelled_page(seed: int) -> tuple[str, dict[str, int]]:
    """A page, and the label of each block by its first word."""
    p = _Page(seed)
    r = p.r
    p.html.append("<!DOCTYPE html><html><head>")
    p.add(0, p.text(3, 12, 0.4), "<title>", "</title></head><body>")
    if r.random() < 0.8:
        p.html.append(r.choice(["<nav><ul>", '<header><nav class="menu"><ul>', '<div class="nav"><ul>', '<div id="menu"><ul>']))
        p.links(r.randint(2, 7))
        p.html.append("</ul></nav></div></header>" if r.random() < 0.9 else "</ul></nav>")
    if r.random() < 0.3:
        p.add(0, p.text(1, 8, 0.3), "<header><p>", "</p></header>")
    for _ in range(r.randint(0, 2)):
        p.aside()
    opening, closing = r.choice([("<article>", "</article>"), ("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"), (f'<div class="{r.choice(MAIN)}">', "</div>"), (f'<div id="{r.choice(MAIN)}"><section>', "</section></div>"), ("<div>", "</div>")])
    p.html.append(opening)
    p.main(comments=True)
    if r.random() < 0.3:
        p.aside()
        p.add(1, p.text(3, 60), "<p>", "</p>")
    p.html.append(closing)
    if r.random() < 0.3:
        p.remarks()
    for _ in range(r.randint(0, 2)):
        p.aside()
    if r.random() < 0.85:
        p.add(0, r.choice(["", "© "]) + p.text(1, 18, 0.6), r.choice(["<footer>", "<footer><p>", '<div class="footer">', '<div id="footer"><p>']), r.choice(["</footer></div>", ""]))
    return "".join(p.html), p.labels


def bare_page(seed: int) -> tuple[str, dict[str, int]]:
    """A page without furniture: one to three blocks of main text, in a few tags, very many or none."""
    p = _Page(seed)
    r = p.r
    if r.random() < 0.5:
        p.html.append("<html>")
        if r.random() < 0.4:
            p.add(0, p.text(3, 12, 0.4), "<head><title>", "</title></head>")
        p.html.append("<body>")
    inner = r.choice(["", "<p>", "<p>", "<div>", "<div><p>", "<article><p>", "<main><article><p>", "<section><p>", f'<div class="{r.choice(MAIN)}"><p>'])
    p.html.append("<div>" * r.choice([0, 0, 0, 1, 2, 40]))
    blocks_ = r.choice([1, 1, 1, 2, 3, 5])
    for k in range(blocks_):
        text = p.text(1 if k else 4, r.choice([8, 90]))
        if r.random() < 0.4:
            text += r.choice([" |", " | " + p.word(), " |."])
        p.add(1, text, inner, "</p>" if inner.endswith("<p>") else "</div>" if inner else "<hr>" if blocks_ > 1 else "")
    return "".join(p.html), p.labels


def labelled_sequence(seed: int, page=labelled_page) -> tuple[list[list[str]], list[int]]:
    text, labels = page(seed)
    seq = blocks(text)
    own = [next((labels[w] for w in (x.rstrip(".") for x in text.split(" ")[:2]) if w in labels), 0) for text, _, _ in seq]
    return featurize(seq), own


def trained_field(n_pages: int = 300, n_bare: int = 150) -> Field:
    """The field fitted on n_pages generated pages and n_bare without furniture."""
    pages = [labelled_sequence(i) for i in range(n_pages)] + [labelled_sequence(i, bare_page) for i in range(n_bare)]
    return train([s for s in pages if s[1]])
