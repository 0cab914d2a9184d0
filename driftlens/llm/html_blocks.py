"""Web pages as leaf blocks of their element tree, with the features that tell main text from the rest."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul option select".split())
HIDDEN = {"script", "style", "template", "noscript", "head", "title", "iframe", "svg", "textarea", "object", "canvas"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# A start tag of the key ends an open element of the values, unless one of the fences stands between.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = {"ul", "ol", "dl", "table", "select", "menu"}
# Parts of class names and identifiers that hint at what an element is for.
ASIDE_HINTS = re.compile(
    r"^(nav|menu|foot|head|mast|side|bread|crumb|share|social|relat|recom|popular|trend|promo|spons|advert|ads?$|banner|cook|gdpr|consent|notice|alert|popup|modal"
    r"|newsl|subscr|signup|login|search|form|widget|comment|respond|reply|disqus|discuss|copy|legal|tags?$|meta|byline|author|pag(er|inat)|toolbar|topbar|skip|bottom)")
MAIN_HINTS = re.compile(r"^(article|content|post$|entry|story|text|main|body|prose|markdown|page$)")
TOKEN = re.compile(r"[a-z]+")


@dataclass
class Block:
    """A run of text that no block element interrupts, under its open elements."""

    text: str
    path: list[tuple[str, str]]
    linked: int = 0
    marks: list[str] = field(default_factory=list)


class PageParser(HTMLParser):
    """Collects the blocks of a page; unclosed and misplaced tags are mended as browsers mostly do."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str]] = []
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = self.hidden = self.links = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(text, [e for e in self.open if e[0] in BLOCK or e[1]], min(self.linked, len(text))))
        self.parts, self.linked = [], 0

    def leave(self, at: int) -> None:
        for tag, _ in self.open[at:]:
            self.hidden -= tag in HIDDEN
            self.links -= tag == "a"
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "body":
            self.leave(next((i for i, e in enumerate(self.open) if e[0] == "head"), len(self.open)))
        if tag in BLOCK:
            self.flush()
            ending = ENDS.get(tag, set()) | {"p"}
            for at in range(len(self.open) - 1, -1, -1):
                name = self.open[at][0]
                if name in ending:
                    self.leave(at)
                    if name == "p" or tag != "tr":
                        break
                elif name in FENCES or (name in BLOCK and tag not in ENDS):
                    break
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        names = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "itemprop"))
        self.open.append((tag, names.lower()))
        self.hidden += tag in HIDDEN
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self.leave(at)
                return
            if self.open[at][0] in BLOCK and tag not in BLOCK and tag not in HIDDEN:
                # An inline end tag does not reach out of its block.
                return

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def blocks_of(html: str | None) -> list[Block]:
    """The blocks of a page in order; none for null or empty pages."""
    parser = PageParser()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    for block in parser.blocks:
        block.marks = marks_of(block)
    for at, block in enumerate(parser.blocks):
        if at and parser.blocks[at - 1].path == block.path:
            block.marks.append("same-path")
    return parser.blocks


def marks_of(block: Block) -> list[str]:
    """Features of a block: tags and names of its ancestors, and what its text looks like."""
    tags = [tag for tag, _ in block.path]
    made = {"bias", f"tag:{tags[-1] if tags else ''}"}
    made.update(f"in:{t}" for t in tags)
    if "article" in tags or "main" in tags:
        after = tags[max((i for i, t in enumerate(tags) if t in ("article", "main")), default=0):]
        made.update(f"main>{t}" for t in after if t in ("nav", "aside", "header", "footer", "form", "section", "ul"))
    hints = set()
    for _, names in block.path:
        for token in TOKEN.findall(names):
            made.add(f"name:{token}")
            if ASIDE_HINTS.match(token):
                hints.add("aside")
            if MAIN_HINTS.match(token):
                hints.add("main")
    made.update(f"hint:{h}" for h in hints or {"none"})
    text = block.text
    words = text.count(" ") + 1
    made.add(f"words:{min(7, words.bit_length())}")
    made.add(f"links:{min(3, 4 * block.linked // max(1, len(text)))}")
    made.add(f"end:{text[-1] in '.!?…:;\"”»'}")
    made.add(f"comma:{',' in text}")
    if "©" in text:
        made.add("copyright")
    if any(c in text for c in "|»›·•"):
        made.add("separator")
    return sorted(made)
