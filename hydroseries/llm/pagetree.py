"""A small element tree of one HTML page: what ``html`` needs of it, no more.

Optional end tags are supplied for paragraphs, list items and table parts, an
end tag without a start is ignored, an unclosed element ends with its parent.
"""

from __future__ import annotations

import hashlib
import re
from html.parser import HTMLParser

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
                   "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary "
                   "table tbody td tfoot th thead tr ul").split())
TEXT_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption caption td th".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset(("head title script style noscript template iframe svg math object select button textarea canvas video audio "
                     "nav footer aside form menu dialog datalist").split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
# Class and id words that name boilerplate.
NAMES = frozenset(("ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored promo promoted promotion banner nav "
                   "navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars footer footers masthead topbar cookie "
                   "cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share "
                   "sharing social related recommended comment comments commentlist disqus reply replies respond pagination pager "
                   "toolbar copyright legal disclaimer widget widgets").split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}),
          "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
          "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
SPLIT = re.compile(r"[^a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def named(attrs: dict) -> bool:
    """Whether class, id, role or a hiding attribute names boilerplate."""
    words = SPLIT.split(CAMEL.sub(" ", f"{attrs.get('class') or ''} {attrs.get('id') or ''}").lower())
    return (not NAMES.isdisjoint(words) or (attrs.get("role") or "").lower() in ROLES or "hidden" in attrs
            or (attrs.get("aria-hidden") or "").lower() == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "").lower())


class Tree(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.attrs = [""], [-1], [{}]
        self.events: list[tuple[int, str | None]] = []  # (element, text), or (element, None) for a block boundary
        self.open = [0]
        self.feed(html)
        self.close()

    def _pop_to(self, k: int) -> None:
        for i in self.open[k:]:
            if self.tag[i] in BLOCK:
                self.events.append((self.parent[i], None))
        del self.open[k:]

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.events.append((self.open[-1], " "))
            return
        if tag in BLOCK:
            for k in range(len(self.open) - 1, 0, -1):
                t = self.tag[self.open[k]]
                if t == "p":
                    self._pop_to(k)
                if t in BLOCK:
                    break
        if tag in CLOSES:
            ends, stops = CLOSES[tag]
            for k in range(len(self.open) - 1, 0, -1):
                t = self.tag[self.open[k]]
                if t in ends:
                    self._pop_to(k)
                elif t in stops:
                    break
        if tag in BLOCK:
            self.events.append((self.open[-1], None))
        if tag in VOID:
            return
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        self.attrs.append(dict(attrs))
        self.open.append(len(self.tag) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            t = self.tag[self.open[k]]
            if t == tag:
                if tag in BLOCK or k == len(self.open) - 1:
                    self._pop_to(k)
                else:
                    del self.open[k]  # an inline element closed across blocks
                return
            if tag not in BLOCK and t in BLOCK and tag in ("script", "style"):
                return

    def handle_data(self, data):
        self.events.append((self.open[-1], data))

    def unknown_decl(self, data):
        pass


class Page:
    """The elements of a page, which of them rules drop, and hashes of their subtrees."""

    def __init__(self, html: str):
        t = Tree(html)
        n = len(t.tag)
        self.tag, self.parent, self.events = t.tag, t.parent, t.events
        holds = [False] * n  # an article or main element below
        for i in range(n - 1, 0, -1):
            if holds[i] or (t.tag[i] in ("article", "main")) or (t.attrs[i].get("role") or "") == "main":
                holds[self.parent[i]] = True
        self.inside = [False] * n
        self.dropped = [False] * n
        for i in range(1, n):
            p, tag = self.parent[i], t.tag[i]
            own = tag in ("article", "main") or (t.attrs[i].get("role") or "") == "main"
            self.inside[i] = self.inside[p] or own
            rule = tag in DROPPED or (tag == "header" and not self.inside[p])
            if not rule and t.attrs[i] and tag not in HEADING and tag not in ("html", "body") and not holds[i]:
                rule = named(t.attrs[i]) and (tag in BLOCK or tag in ("span", "section", "a"))
            self.dropped[i] = self.dropped[p] or (rule and not (holds[i] and tag not in DROPPED))
        # inside an article's own header only the headings are text of the article
        header, heading, titled = [0] * n, [False] * n, [False] * n
        for i in range(n - 1, 0, -1):
            titled[i] = titled[i] or t.tag[i] in HEADING
            titled[self.parent[i]] = titled[self.parent[i]] or titled[i]
        for i in range(1, n):
            p = self.parent[i]
            heading[i] = heading[p] or t.tag[i] in HEADING
            header[i] = p if t.tag[p] == "header" and self.inside[p] else header[p]
            if header[i] and not heading[i] and not titled[i] and t.tag[i] in BLOCK:
                self.dropped[i] = True
            self.dropped[i] = self.dropped[i] or self.dropped[p]
        kept = [i for i in range(1, n) if not self.dropped[i]]
        tops = [i for i in kept if t.tag[i] == "article"] or [i for i in kept if t.tag[i] == "main" or t.attrs[i].get("role") == "main"]
        self.framed = bool(tops)
        self.main = [False] * n
        top = set(tops)
        for i in range(n):
            self.main[i] = not self.framed or i in top or (i > 0 and self.main[self.parent[i]])

    def hashes(self) -> list[int]:
        """64-bit hash of each element's subtree: names and white-space-free text in order."""
        seen = [False] * len(self.tag)
        order: list[list] = [[] for _ in self.tag]
        for e, text in self.events:
            if text is not None and (s := "".join(text.split())):
                # place the open elements below their parents in order of appearance
                i = e
                while i > 0 and not seen[i]:
                    seen[i] = True
                    order[self.parent[i]].append(i)
                    i = self.parent[i]
                order[e].append(s)
        out = [0] * len(self.tag)
        for i in range(len(self.tag) - 1, -1, -1):
            h = hashlib.blake2b(self.tag[i].encode(), digest_size=8)
            for x in order[i]:
                h.update(b"\1" + x.encode("utf-8", "replace") if isinstance(x, str) else b"\2" + out[x].to_bytes(8, "big", signed=True))
            out[i] = int.from_bytes(h.digest(), "big", signed=True)
        return out

    def text(self, removed=frozenset(), hashes: list[int] | None = None) -> str:
        """Blocks of the main text, one per line; subtrees whose hash is in ``removed`` are left out."""
        gone = list(self.dropped)
        for i in range(1, len(gone)):
            gone[i] = gone[i] or gone[self.parent[i]] or bool(removed and hashes[i] in removed and self.open_to_count(i))
        if not self.framed:
            self._drop_link_lists(gone)
        blocks, run = [], []
        for e, text in self.events:
            if text is None:
                if run and (s := " ".join("".join(run).split())):
                    blocks.append(s)
                run = []
            elif self.main[e] and not gone[e]:
                run.append(text)
        if run and (s := " ".join("".join(run).split())):
            blocks.append(s)
        return "\n".join(blocks)

    def open_to_count(self, i: int) -> bool:
        """Whether recurrence may remove this element: a container in the main
        region, or any block of a page that marks no article.  Paragraphs and headings
        of a marked article stay, however often other pages repeat them."""
        t = self.tag[i]
        if t not in BLOCK or t in ("html", "body", "article", "main", "head"):
            return False
        if self.framed:
            return self.main[i] and t not in TEXT_BLOCK
        return True

    def _drop_link_lists(self, gone: list[bool]) -> None:
        """Lists whose text is links alone, on a page that marks no article."""
        size, linked = {}, {}
        for e, text in self.events:
            if text and not text.isspace():
                i, link, lists = e, False, []
                while i > 0:
                    link = link or self.tag[i] == "a"
                    if self.tag[i] in ("ul", "ol"):
                        lists.append(i)
                    i = self.parent[i]
                for k in lists:
                    size[k] = size.get(k, 0) + len(text)
                    linked[k] = linked.get(k, 0) + (len(text) if link else 0)
        for k in size:
            if linked[k] >= 0.9 * size[k]:
                gone[k] = True
        for i in range(1, len(gone)):
            gone[i] = gone[i] or gone[self.parent[i]]
