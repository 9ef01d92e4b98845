"""One web page as a row of tokens: starts and ends of block elements, told apart by their path, and the texts between them."""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import xxhash

# Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
WITHIN = frozenset("ul ol dl table select article section div main body".split())
NO_TEXT = frozenset("script style noscript template textarea iframe svg".split())
#: Elements, and words in class, id or role, that say what isn't main text.
ASIDE = frozenset("nav header footer aside form button select menu dialog head title input fieldset object canvas audio video".split())
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form header login masthead menu menubar modal nav "
    "navbar navigation newsletter notice notification pager pagination popup promo promoted related reply replies search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription toolbar widget complementary contentinfo".split()
)
MAIN = frozenset(("article", "main"))
#: Elements that no class makes an aside; those whose id tells what they are about; words of those that may hold articles of their own.
WHOLE = MAIN | {"html", "body"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ANSWERS = frozenset("comment comments disqus reply replies".split())
#: Elements that hold parts of a page, whose texts may be the site's own; others hold lines of the text.
CONTAINERS = frozenset("div section nav aside header footer form ul ol table dl menu fieldset center".split())
#: Why an element is an aside: it isn't, by its marks, by marks that say it holds answers, by its name.
NONE, MARKED, ANSWERED, NAMED = range(4)
#: Kinds of elements: lines of text, parts of a page, headings, the page's own, those without text, articles.
OTHER, CONTAINER, HEADING, OUTER, UNSEEN, PIECE = range(6)
START, END, TEXT = range(3)
#: Elements nested deeper are taken as part of the one around, as browsers do.
DEEPEST = 512

COMMENT_END = re.compile(r"-->|\Z")
TAG_MARKS = re.compile("[>\"']")
TAG_END = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
MARK = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
DIGITS = re.compile(r"[0-9]+")
AFTER_RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in NO_TEXT}


class Event(NamedTuple):
    """A token. Of a start or an end: its number, its parent's and its kind. Of a text: the text and its characters in links."""

    what: int
    token: int
    parent: int = 0
    kind: int = OTHER
    text: str = ""
    links: int = 0
    aside: int = 0
    main: bool = False


def why(words: frozenset[str]) -> int:
    found = words & ASIDE_WORDS
    return NONE if not found else ANSWERED if found & ANSWERS else MARKED


@lru_cache(maxsize=20_000)
def opened(tag: str) -> tuple[str, str, int, int, bool]:
    """Name, name with marks (numbers in them left out), why it is an aside outside and inside an article, whether main, of a start tag. Words in marks count whole."""
    name = NAME.match(tag)[1].lower()
    found = [(k.lower(), m.strip("\"'").lower()) for k, m in MARK.findall(tag)]
    marks = DIGITS.sub("0", " ".join(m for _, m in found))
    words, no_id = (frozenset(w for k, m in found if k != drop for w in m.split()) for drop in ("", "id"))
    outside = NAMED if name in ASIDE else NONE if name in WHOLE else why(no_id if name in HEADINGS else words)
    inside = why(no_id) if name == "section" else outside
    return name, f"{name}.{marks}" if marks else name, outside, inside, name in MAIN or "main" in words


@lru_cache(maxsize=50_000)
def number(parent: int, marked: str) -> int:
    """Of an element by the path to it; positive, so that the negative can stand for its end."""
    return (xxhash.xxh64_intdigest(f"{parent}>{marked}") >> 2) + 1


def kind_of(name: str) -> int:
    if name in MAIN:
        return PIECE
    return OUTER if name in ("html", "body") else UNSEEN if name in ("head", "title") else HEADING if name in HEADINGS else CONTAINER if name in CONTAINERS else OTHER


class Tags:
    """Ends of tags, going forward alone: what is broken is read once, whatever its length."""

    def __init__(self, page: str):
        self.page, self.broken, self.without = page, False, {}

    def close(self, at: int) -> int:
        """The place after the tag that starts at `at`, or the page's end where it has none."""
        if not self.broken:
            m = TAG_END.match(self.page, at)
            if m:
                return m.end()
            self.broken = True  # from here on a quote without an end is looked for once
        page, i, n = self.page, at, len(self.page)
        for m in TAG_MARKS.finditer(page, at):
            if m.start() < i:
                continue
            if m[0] == ">":
                return m.end()
            j = -1 if self.without.get(m[0], n) <= m.start() else page.find(m[0], m.end())
            if j < 0:
                self.without[m[0]] = min(m.start(), self.without.get(m[0], n))
                j = page.find(">", m.end())
                return j + 1 if j >= 0 else n
            i = j + 1
        return n


def tokenised(page: str) -> tuple[list[Event], list[tuple[int, int, bool]]]:
    """Events in page order, and the asides that they number: (the one around, why, whether an article stands before)."""
    out: list[Event] = []
    # name, number, aside, main, whether a block, whether in a link, parent's number, kind
    stack: list[tuple[str, int, int, bool, bool, bool, int, int]] = [("", 0, 0, False, True, False, 0, OUTER)]
    asides: list[tuple[int, int, bool]] = [(0, NONE, False)]
    articles = False
    held: list[str] = []
    links = 0
    is_open, skipped = Counter(), Counter()
    tags, n, at = Tags(page), len(page), 0

    def flush() -> None:
        nonlocal links
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            _, token, aside, main, _, _, _, kind = stack[-1]
            if kind != UNSEEN:
                out.append(Event(TEXT, token, 0, kind, text, min(links, len(text)), aside, main))
        links = 0

    def put(piece: str) -> None:
        nonlocal links
        held.append(piece)
        if stack[-1][5]:
            links += len(piece.strip())

    def drop(k: int) -> None:
        for s in reversed(stack[k:]):
            is_open[s[0]] -= 1
            if s[4]:
                out.append(Event(END, s[1], s[6], s[7]))
        del stack[k:]

    def close(k: int) -> None:
        flush()
        drop(k)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            put(page[at:])
            break
        first = page[lt + 1 : lt + 2]
        if not (first.isascii() and first.isalpha() or first in ("/", "!", "?")) or not first:
            put(page[at : lt + 1])
            at = lt + 1
            continue
        if lt > at:
            put(page[at:lt])
        if first in "!?":
            if page.startswith("<!--", lt):
                at = COMMENT_END.search(page, lt + 4).end()
            else:
                gt = page.find(">", lt)
                at = gt + 1 if gt >= 0 else n
            continue
        at = tags.close(lt + 1)
        tag = page[lt:at]
        found = NAME.match(tag)
        if not found:  # '</' before no name
            continue
        if not tag.endswith(">"):
            break  # the page ends within a tag
        name = found[1].lower()
        if first == "/":
            if skipped[name]:
                skipped[name] -= 1
                continue
            if not is_open[name]:
                if name == "p":
                    flush()
                continue
            if name in INLINE and not any(s[0] == name for s in stack[-4:]):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    if name in INLINE and any(s[4] for s in stack[k + 1 :]):
                        break  # not closed across a block
                    if not stack[k][4]:
                        drop(k)
                    else:
                        close(k)
                    break
            continue
        if name in NO_TEXT:
            if not tag.endswith("/>"):
                m = AFTER_RAW[name].search(page, at)
                at = m.end() if m else n
            continue
        name, marked, aside, aside_within, main = opened(tag)
        if stack[-1][3]:
            aside = aside_within
        if name == "br":
            held.append(" ")
        if name in INLINE and not aside:
            top = stack[-1]
            if not tag.endswith("/>"):
                if len(stack) < DEEPEST:
                    stack.append((name, top[1], top[2], top[3] or main, False, top[5] or name == "a", top[6], top[7]))
                    is_open[name] += 1
                else:
                    skipped[name] += 1
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        flush()
        in_link = stack[-1][5]
        while len(stack) > 1 and not stack[-1][4]:  # a block ends what is open in the line
            drop(len(stack) - 1)
        if name in CLOSES_P and is_open["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in WITHIN:
                    break
        if name in SAME:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in SAME[name]:
                    close(k)
                    break
                if stack[k][0] in WITHIN:
                    break
        _, parent, around, within, _, _, _, above = stack[-1]
        # an article's own header holds its title
        if aside and not (name == "header" and within and "." not in marked):
            asides.append((around, aside, articles))
            around = len(asides) - 1
        if name in MAIN:
            # what holds an article isn't an aside for its marks, unless it holds the answers to one before
            k = around
            while k:
                up, reason, after = asides[k]
                if reason == MARKED or reason == ANSWERED and not after:
                    asides[k] = (up, NONE, after)
                k = up
            articles = True
        token, kind = number(parent, marked), UNSEEN if above == UNSEEN else kind_of(name)
        if tag.endswith("/>"):
            continue
        if len(stack) >= DEEPEST:
            skipped[name] += 1
            continue
        out.append(Event(START, token, parent, kind, aside=around))
        stack.append((name, token, around, within or main, True, in_link, parent, kind))
        is_open[name] += 1
    close(1)
    flush()
    return out, asides
