"""One HTML page in plain Python: elements, container scores, generalised paths and text blocks."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

from xxhash import xxh3_128_hexdigest

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"""[>"']""")
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_DIGITS = re.compile(r"\d+")
_WORDS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# Parts of the HTML vocabulary.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noframes xmp svg math select object canvas audio video".split())
#: Elements open at a time, as browsers bound them.
DEPTH = 512
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CONTAINERS = frozenset(("article", "main", "section", "div", "td", "body", "center"))
#: What an opening tag of one kind closes without an end tag, and what such closing never reaches beyond.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ()),
}
#: Never part of an article.
OUTSIDE = frozenset("nav footer aside form button dialog menu head header label input".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of a class or id that mark what is not the article; the last line holds even where most text is inside.
MARKS = frozenset(
    """ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored sponsors promo promos promoted promotion banner banners
    menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars aside footer header masthead topbar toolbar
    cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login signin paywall
    share sharing social related recommended recommendations widget widgets pagination pager skip toast disclaimer copyright""".split()
)
FIRM = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
PRAISE = frozenset("article content post entry main story body text".split())


@dataclass(slots=True)
class Element:
    tag: str
    names: str
    parent: int
    path: str  # a digest of the generalised path, so that deep pages hold no long strings
    out: bool = False  # it or what holds it is not the article's
    own: bool = False  # out by itself: its kind, its role, or the firm words
    marked: bool = False  # out by the words of its class or id, or as a form; taken back if it wraps the article
    link: bool = False
    score: float = 0.0
    chars: int = 0


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    #: In page order: the element, and a text or None where a block starts or ends.
    runs: list[tuple[int, str | None]] = field(default_factory=list)


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(text)} if text else {}


def _tag_end(source: str, at: int) -> int:
    """Place of the ``>`` that ends the tag, those in quoted values passed over; -1 if there is none."""
    while (m := _STOP.search(source, at)) is not None:
        if m[0] == ">":
            return m.start()
        before = m.start() - 1
        while source[before].isspace():
            before -= 1
        at = m.end()
        if source[before] == "=":  # else no value starts here
            close = source.find(m[0], at)
            if close < 0:
                return -1
            at = close + 1
    return -1


class _Builder:
    """The open elements of a page, at most DEPTH: what would stand deeper stands beside the deepest instead."""

    def __init__(self) -> None:
        self.page = Page([Element("html", "", -1, "")])
        self.stack = [0]
        self.open = Counter(["html"])

    def top(self, k: int) -> Element:
        return self.page.elements[self.stack[k]]

    def text(self, text: str | None) -> None:
        if text != "":
            self.page.runs.append((self.stack[-1], text))

    def close(self, upto: int) -> None:
        for k in reversed(self.stack[upto:]):
            e = self.page.elements[k]
            self.open[e.tag] -= 1
            if e.tag in BLOCK:
                self.page.runs.append((k, None))
        del self.stack[upto:]

    def end(self, tag: str) -> None:
        if self.open[tag]:
            self.close(next((k for k in range(len(self.stack) - 1, 0, -1) if self.top(k).tag == tag), len(self.stack)))

    def start(self, tag: str, a: dict[str, str]) -> None:
        if self.open["head"]:  # what may stand in a head never comes here
            self.end("head")
        if tag in BLOCK and self.open["p"]:
            for k in range(len(self.stack) - 1, 0, -1):
                over = self.top(k).tag
                if over == "p":
                    self.close(k)
                    break
                if over in BLOCK or over == "button":
                    break
        ends, bounds = CLOSES.get(tag, ((), ()))
        if any(self.open[e] for e in ends):
            for k in range(len(self.stack) - 1, 0, -1):
                over = self.top(k).tag
                if over in bounds:
                    break
                if over in ends:
                    self.close(k)
                    if over == tag or tag not in ("tr",):
                        break
        if len(self.stack) >= DEPTH:
            self.close(len(self.stack) - 1)
        self.push(tag, a)

    def push(self, tag: str, a: dict[str, str]) -> None:
        page, above = self.page, self.page.elements[self.stack[-1]]
        names = f"{a.get('class', '')} {a.get('id', '')}".lower()
        classes = sorted({_DIGITS.sub("#", c) for c in a.get("class", "").lower().split()})
        step = tag if tag in ("html", "body") else ".".join([tag, *classes])  # a page's own classes stand on its body
        e = Element(tag, names, self.stack[-1], xxh3_128_hexdigest(step if tag in ("html", "body") else f"{above.path}>{step}"))
        words = set(_WORDS.findall(names))
        whole = tag in ("html", "body")
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or bool(_HIDDEN.search(a.get("style", "")))
        e.own = (tag in OUTSIDE and tag != "form") or a.get("role", "").lower() in ROLES or hidden or (not whole and bool(words & FIRM))
        if tag == "header" and self.open["article"] and not hidden:
            e.own = False  # an article's own header: only its headings count, see blocks()
        e.marked = not e.own and (tag == "form" or not whole and tag not in ("article", "main") and bool(words & MARKS))
        e.link = above.link or tag == "a"
        page.elements.append(e)
        self.stack.append(len(page.elements) - 1)
        self.open[tag] += 1
        if tag in BLOCK:
            page.runs.append((self.stack[-1], None))


def parse(source: str | None) -> Page:
    """The page's elements and runs of text, in one pass linear in ``source``, however broken.

    Quoted attribute values may hold ``>``, until a tag turns out not to end
    that way; from there on the next ``>`` ends a tag.
    """
    source, at, held, quotes = source or "", 0, 0, True
    page = _Builder()
    last = source.rfind(">")
    while (lt := source.find("<", at)) >= 0:
        if source.startswith("<!--", lt):
            page.text(source[held:lt])
            close = source.find("-->", lt + 4)
            at = held = close + 3 if close >= 0 else len(source)
            continue
        if lt > last:
            break
        if source.startswith(("<!", "<?"), lt):
            page.text(source[held:lt])
            at = held = source.find(">", lt) + 1
            continue
        m = _TAG.match(source, lt)
        if m is None:
            at = lt + 1
            continue
        gt = _tag_end(source, m.end()) if quotes else -1
        if gt < 0:
            quotes = False
            gt = source.find(">", m.end())
            if gt < 0:
                break
        page.text(source[held:lt])
        at = held = gt + 1
        tag, raw = m[2].lower(), source[m.end() : gt]
        if m[1]:
            page.end(tag)
        elif tag in RAW:
            if not raw.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?![\w-])", re.I).search(source, at)
                close = source.find(">", end.end()) if end else -1
                at = held = close + 1 if close >= 0 else len(source)
            page.text(" ")
        elif tag in VOID:
            page.text(None if tag == "hr" else " " if tag in ("br", "wbr") else "")
        else:
            page.start(tag, _attributes(raw))
    page.text(source[held:])
    page.close(1)
    _settle(page.page)
    _score(page.page)
    return page.page


def _settle(page: Page) -> None:
    """Decide what is out: what is out by itself, and what is marked unless it wraps the article, with all inside.

    A marked element wraps the article if it holds over half of the text that
    is not out by itself, no ``article`` or ``main`` stands beside it, and what
    text is in nothing marked is under a fifth of its own. If all words of its class
    and id are marks, it must also hold an article, a main or a first heading.
    One that is also called content or the like need only hold over half.
    """
    es = page.elements
    own, nearest = [False] * len(es), [-1] * len(es)  # nearest: the marked element at or above each
    for k, e in enumerate(es[1:], 1):
        own[k] = own[e.parent] or e.own
        nearest[k] = k if e.marked and not own[k] else nearest[e.parent]
    if max(nearest) >= 0:
        _unmark(page, own, nearest)
    for k, e in enumerate(es):
        e.out = own[k] or e.marked or (k > 0 and es[e.parent].out)


def _unmark(page: Page, own: list[bool], nearest: list[int]) -> None:
    es = page.elements
    direct, total, mains, heads = Counter(), [0] * len(es), [0] * len(es), [0] * len(es)
    for k, text in page.runs:
        if text and not own[k] and (n := len(text.strip())):
            total[k] += n
            direct[nearest[k]] += n
    for k in range(len(es) - 1, -1, -1):
        e = es[k]
        mains[k] += not own[k] and e.tag in ("article", "main")
        heads[k] += not own[k] and e.tag == "h1"
        if k:
            for sums in (total, mains, heads):
                sums[e.parent] += sums[k]
    free = direct[-1]
    for k in sorted({n for n in nearest if n >= 0}):
        words = set(_WORDS.findall(es[k].names))
        wraps = mains[k] == mains[0] and 5 * free < total[k] and (mains[k] or heads[k] or not words or bool(words - MARKS))
        if 2 * total[k] > total[0] and (wraps or words & PRAISE):
            es[k].marked = False
            free += direct[k]


def _score(page: Page) -> None:
    """Text counts for the element it stands in (a block's for its parent) and half for the one above; links count against."""
    links = [0] * len(page.elements)
    for k, text in page.runs:
        e = page.elements[k]
        if not text or e.out or not (n := len(text.strip())):
            continue
        if e.link:
            links[k] += n
        e.chars += n
        while k and page.elements[k].tag not in CONTAINERS:
            k = page.elements[k].parent
        if not e.link:
            page.elements[k].score += n
            up = page.elements[k].parent
            if up > 0:
                page.elements[up].score += n / 2
    for k in range(len(page.elements) - 1, 0, -1):
        e = page.elements[k]
        page.elements[e.parent].chars += e.chars
        links[e.parent] += links[k]
    for k, e in enumerate(page.elements):
        if e.chars:
            e.score *= 1 - links[k] / e.chars
        if e.tag in ("article", "main"):
            e.score *= 1.5
        elif e.tag != "body" and set(_WORDS.findall(e.names)) & PRAISE:
            e.score *= 1.25


def best(page: Page) -> int:
    """The container with the highest score, the first of equals; the page itself if none has text."""
    found = max((k for k, e in enumerate(page.elements) if e.tag in CONTAINERS and not e.out), key=lambda k: page.elements[k].score, default=0)
    return found if page.elements[found].score > 0 else 0


def at_path(page: Page, path: str) -> list[int]:
    """Containers with this generalised path that hold text, none inside another."""
    found: list[int] = []
    inside: set[int] = set()
    for k, e in enumerate(page.elements):
        if e.parent in inside:
            inside.add(k)
        elif not e.out and e.path == path and e.chars:
            inside.add(k)
            found.append(k)
    return found


def blocks(page: Page, tops: Iterable[int]) -> list[str]:
    """Text blocks below ``tops`` in page order: references decoded, white space single."""
    inside: set[int] = set(tops)
    titled: set[int] = set()
    for k, e in enumerate(page.elements):
        if e.parent in inside:
            inside.add(k)
        if e.tag == "header" or e.parent in titled:
            if e.tag not in HEADINGS:
                titled.add(k)
    out: list[str] = []
    held: list[str] = []

    def end() -> None:
        if held and (text := " ".join(html.unescape("".join(held)).split())):
            out.append(text)
        held.clear()

    for k, text in page.runs:
        if text is None:
            end()
        elif k in inside and not page.elements[k].out and k not in titled:
            held.append(text)
            if page.elements[k].tag in ("td", "th"):
                held.append(" ")
    end()
    return out
