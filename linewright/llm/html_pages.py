"""HTML in the small: a tolerant reader that turns a page into events, and what element names say.

Events are (OPEN, node), (CLOSE, node) and (TEXT, node, raw text); a node is one
element with its place in the tree. Nothing is dropped here but comments,
declarations and the raw contents of scripts and styles.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict

import xxhash

OPEN, CLOSE, TEXT = 0, 1, 2

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?", re.S)
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>=]|=)*+)>", re.S)
#: For the rest of a page with a quote that never ends.
_LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: What an opening tag closes when it is still open, up to the nearest of the elements after it.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
ENDING = ENDS_PARAGRAPH | {"body", *SIBLINGS}
SCOPE = frozenset("table td th caption button object".split())

#: Elements that never hold main text.
ASIDE = frozenset(
    "head script style noscript template nav footer aside form fieldset button select option textarea input iframe object embed svg canvas audio video dialog menu title noembed noframes".split()
)
#: Words of class, id and role that mark menus, notices, adverts, comments and the like.
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr notice notices alert alerts popup modal overlay"
    " menu menus nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer colophon copyright sidebar sidebars aside complementary contentinfo search toolbar pagination pager"
    " related recommended recommendations share sharing social subscribe subscription newsletter signup login comment comments commentlist respond reply replies disqus disclaimer skip".split()
)
#: Words that turn those around (``no-sidebar``), and words beside ``header`` that make it the head of the text.
TURNING_NAMES = frozenset("no not without with has".split())
TEXT_NAMES = frozenset("article content entry post story section title".split())
#: Elements whose class names say nothing of them, and the names that count for an article.
NEVER_ASIDE = frozenset("html body main".split())
ARTICLE_ASIDE = frozenset("ad ads advert advertisement sponsored promo related recommended comment comments reply replies".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())


class Role:
    """What an element is, apart from its place on a page: its path and what names say of it."""

    __slots__ = ("path", "opened", "closed", "words", "named", "aside")

    def __init__(self, parent: int, name: str, attributes: str) -> None:
        marks: list[set[str]] = []
        shown, hidden = name, False
        if attributes.strip():
            for key, *values in _ATTRIBUTE.findall(attributes):
                key, value = key.lower(), next((v for v in values if v), "")
                if key in ("class", "id", "role"):
                    shown += f" {key}={re.sub(r'[0-9]+', '0', value.lower())}"
                    marks += [{p.lower() for p in _NAME_PART.findall(word)} for word in value.split()]
                elif key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                    hidden = True
        #: All elements, classes (numbers aside) and ids on the way to it.
        self.path = xxhash.xxh3_64_intdigest(f"{hidden} {shown}", parent)
        #: The tokens of its tags, and the seeds of the tokens of its words and longer runs of text.
        self.opened, self.closed = token("<", self.path), token(">", self.path)
        self.words = xxhash.xxh3_64_intdigest("w", self.path), xxhash.xxh3_64_intdigest("t", self.path)
        #: Silenced by its class names alone, or by what it is.
        self.named = name not in NEVER_ASIDE and any(_silences(m, name) for m in marks)
        self.aside = name in ASIDE or hidden


#: Roles met so far, as pages of a host have the same ones over and over.
_roles: dict[tuple[int, str, str], Role] = {}
MOST_ROLES = 100_000


def token(what: str, seed: int) -> int:
    found = xxhash.xxh3_64_intdigest(what, seed)
    return found - (1 << 64) if found >= 1 << 63 else found


class Node:
    __slots__ = ("name", "parent", "role", "opened", "named", "aside")

    def __init__(self, name: str, parent: Node | None, attributes: str) -> None:
        self.name, self.parent = name, parent
        key = parent.role.path if parent else 0, name, attributes
        role = _roles.get(key)
        if role is None:
            if len(_roles) >= MOST_ROLES:
                _roles.clear()
            role = _roles[key] = Role(*key)
        self.role, self.opened, self.named, self.aside = role, role.opened, role.named, role.aside


def _silences(mark: set[str], name: str) -> bool:
    found = mark & (ARTICLE_ASIDE if name == "article" else ASIDE_NAMES)
    return bool(found) and not mark & TURNING_NAMES and not (found == {"header"} and mark & TEXT_NAMES)


def events(html: str) -> list[tuple]:
    """The page's events in order; elements that are still open at the end are closed there.

    A ``<`` that begins no tag is text, and so is a tag that never ends.
    """
    out: list[tuple] = []
    stack: list[Node] = []
    places: dict[str, list[int]] = defaultdict(list)
    paragraphs = places["p"]

    def close(until: int) -> None:
        while len(stack) > until:
            node = stack.pop()
            places[node.name].pop()
            out.append((CLOSE, node))

    def last(names) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    def end_implied(name: str) -> None:
        """Close what the start of ``name`` ends: a paragraph before a block, a list item before the next, head before body."""
        if name in ENDS_PARAGRAPH:
            if paragraphs and paragraphs[-1] > last(SCOPE):
                close(paragraphs[-1])
        elif name in SIBLINGS:
            ended, scope = SIBLINGS[name]
            floor = last(scope)
            first = min((places[n][i] for n in ended if (i := bisect_right(places[n], floor)) < len(places[n])), default=None)
            if first is not None:
                close(first)
        elif name == "body" and places["head"]:
            close(places["head"][0])

    def text(raw: str) -> None:
        if raw:
            out.append((TEXT, stack[-1] if stack else None, raw))

    at, end, pattern = 0, len(html), _TAG
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            text(html[at:])
            break
        if lt > at:
            text(html[at:lt])
        follows = html[lt + 1 : lt + 2]
        if follows in ("!", "?"):
            at = _COMMENT.match(html, lt).end()
            continue
        if follows != "/" and not follows.isalpha():
            text("<")
            at = lt + 1
            continue
        tag = pattern.match(html, lt)
        if tag is None and html.find(">", lt) < 0:
            text(html[lt:])
            break
        if tag is None:
            pattern = _LOOSE_TAG
            tag = pattern.match(html, lt)
        if tag is None:
            text("<")
            at = lt + 1
            continue
        at = tag.end()
        closing, name, attributes = tag.groups()
        name = name.lower()
        if closing and name != "br":
            if places[name]:
                close(places[name][-1])
            continue
        if name in ENDING:
            end_implied(name)
        node = Node(name, stack[-1] if stack else None, attributes)
        out.append((OPEN, node))
        if name in RAW:
            over = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = over.end() if over else end
            out.append((CLOSE, node))
        elif name in VOID:
            out.append((CLOSE, node))
        else:
            places[name].append(len(stack))
            stack.append(node)
    close(0)
    return out
