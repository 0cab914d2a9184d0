"""Labelled pages for training: layouts filled with invented sentences, where the role of every block is known."""

from __future__ import annotations

import html
import random

SYLLABLES = "an be con de el fi gro hi in ka lo me nor ou pra qui re sta ti um ver wa xi yo ze".split()
MAIN_BOXES = [
    "<article>|</article>", "<main>|</main>", '<div class="content">|</div>', '<div id="main-content"><div class="post">|</div></div>',
    '<div class="entry-content">|</div>', '<main><article class="story">|</article></main>', '<section class="article-body">|</section>',
    '<div class="text">|</div>', "<div>|</div>", "<div><div>|</div></div>", "<table><tr><td>|</td></tr></table>", '<div role="main">|</div>',
]
LISTS = ["nav", 'div class="menu"', 'div id="navigation"', 'div class="breadcrumbs"', 'ul class="nav-list"', "header", 'div class="topbar"', 'div class="pagination"']
SIDES = [
    "aside", 'div class="sidebar"', 'div class="widget"', 'section class="related"', 'div class="recommended-posts"', 'div class="share"', 'div class="social-links"',
    'div class="tags"', 'div class="author-box"', 'div class="popular"',
]
NOTICES = [
    'div class="ad"', 'div class="ads"', 'div class="advertisement"', 'div class="banner"', 'div class="promo"', 'div class="sponsored"', 'div class="cookie-notice"',
    'div id="cookies"', 'div class="notice"', 'div class="alert"', 'div class="gdpr"', 'div class="popup"', 'div class="newsletter"', 'div class="subscribe"', 'div id="consent"',
]
FORMS = ["form", 'form class="search"', 'div class="login-form"', 'form id="signup"', "fieldset"]
COMMENTS = [
    ('section class="comments"', 'div class="comment"'), ('div id="comments"', "p"), ('ol class="comment-list"', "li"), ('div class="respond"', "p"),
    ('section id="discussion"', "article"), ('div class="user-comments"', 'div class="comment-body"'), ('ul class="replies"', "li"),
]
FOOTS = ["footer", 'div class="footer"', 'div id="bottom"', 'div class="copyright"', 'div class="legal"']


class LayoutWriter:
    """Writes one random page and remembers the label of each block: 1 for main text."""

    def __init__(self, seed: int) -> None:
        self.random = random.Random(seed)
        self.labels: list[int] = []

    def word(self) -> str:
        return "".join(self.random.choices(SYLLABLES, k=self.random.randint(1, 4)))

    def sentence(self, low: int = 2, high: int = 18) -> str:
        words = [self.word() + ("," if self.random.random() < 0.08 else "") for _ in range(self.random.randint(low, high))]
        return html.escape(" ".join(words).capitalize() + self.random.choice([".", ".", ".", ".", "!", "?", ""]))

    def prose(self) -> str:
        return " ".join(self.sentence() for _ in range(self.random.choice([1, 1, 2, 3, 5, 9])))

    def block(self, tag: str, text: str, label: int) -> str:
        self.labels.append(label)
        return f"<{tag}>{text}</{tag.split()[0]}>"

    def links(self, box: str) -> str:
        items = "".join(self.block("li", f'<a href="/x">{self.word()}</a>', 0) for _ in range(self.random.randint(2, 7)))
        return f"<{box}>{items if box.startswith('ul') else f'<ul>{items}</ul>'}</{box.split()[0]}>"

    def aside(self, boxes: list[str], inner: str = "p") -> str:
        box = self.random.choice(boxes)
        if self.random.random() < 0.4:
            return self.block(box, self.prose(), 0)
        return f"<{box}>" + "".join(self.block(self.random.choice([inner, "h3", "p"]), self.prose(), 0) for _ in range(self.random.randint(1, 3))) + f"</{box.split()[0]}>"

    def form(self) -> str:
        box = self.random.choice(FORMS)
        self.labels.append(0)
        return f'<{box}><label>{self.sentence(1, 4)}</label> <input name="q"> <button>{self.word()}</button></{box.split()[0]}>'

    def comments(self) -> str:
        box, each = self.random.choice(COMMENTS)
        head = self.block("h3", self.sentence(1, 3), 0) if self.random.random() < 0.5 and not box.startswith(("ol", "ul")) else ""
        return f"<{box}>{head}" + "".join(self.block(each, self.prose(), 0) for _ in range(self.random.randint(1, 5))) + f"</{box.split()[0]}>"

    def main(self) -> str:
        parts = [self.block("h1", self.sentence(2, 10), 1)] if self.random.random() < 0.8 else []
        for _ in range(self.random.randint(1, 12)):
            kind = self.random.random()
            if kind < 0.72:
                parts.append(self.block("p", self.prose(), 1))
            elif kind < 0.78:
                parts.append(self.block(self.random.choice(["h2", "h3"]), self.sentence(1, 6), 1))
            elif kind < 0.82:
                parts.append("<ul>" + "".join(self.block("li", self.sentence(), 1) for _ in range(self.random.randint(2, 4))) + "</ul>")
            elif kind < 0.86:
                parts.append(self.block(self.random.choice(["blockquote", "pre"]), self.prose(), 1))
            elif kind < 0.9:
                parts.append(f"<p><b>{self.prose()}<br>")
                self.labels.append(1)
            elif kind < 0.94:
                parts.append(self.block("p", f'{self.sentence()} <a href="/y">{self.word()}</a> {self.sentence()}', 1))
            else:
                parts.append(self.aside(self.random.choice([NOTICES, SIDES, NOTICES])))
        if self.random.random() < 0.15:
            parts.append(self.random.choice([self.comments, self.form])())
        return "".join(parts)

    def page(self) -> str:
        some = lambda share, make, *a: make(*a) if self.random.random() < share else ""
        before, after = self.random.choice(MAIN_BOXES).split("|")
        parts = [some(0.5, lambda: f"<header>{self.block('h1', self.sentence(1, 4), 0)}</header>"), some(0.9, self.links, self.random.choice(LISTS))]
        parts += [some(0.6, self.aside, NOTICES), some(0.3, self.form), some(0.3, self.aside, SIDES), before + self.main() + after]
        parts += [some(0.4, self.aside, SIDES), some(0.5, self.comments), some(0.3, self.aside, NOTICES), some(0.2, self.form)]
        foot = self.random.choice(FOOTS)
        parts += [some(0.9, lambda: self.block(foot, f"{self.random.choice(['&copy; ', ''])}{self.word()}.example &middot; {self.sentence()}", 0))]
        return (f"<!DOCTYPE html><html><head><title>{self.sentence()}</title><script>var a = '<p>';</script></head><body>" + "".join(parts) + "</body></html>")


def labelled_pages(n: int, seed: int = 11) -> list[tuple[str, list[int]]]:
    """``n`` pages with the label of each of their blocks."""
    made = []
    for i in range(n):
        writer = LayoutWriter(seed * 1_000_003 + i)
        page = writer.page()
        made.append((page, writer.labels))
    return made
