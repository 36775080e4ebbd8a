"""What a page row needs of an HTML text: its heads, links and texts, by the places that the HTML standard gives to elements.

One pass over the tokens with a stack of open elements. Head and body, and the ends of p, li, option, table parts and others, are implied
as the standard says; content that a table can't hold goes before the table. Positions of open elements are kept by tag, so no step
looks through the stack, and the time is linear in the text however deep its tags are nested.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from html.entities import html5
from typing import NamedTuple

# Fixed values of the HTML standard.
SPACE = "\t\n\f\r "
VOID = frozenset("area base basefont bgsound br col embed frame hr image img input keygen link meta param source track wbr".split())
HEAD_TAGS = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = HEADINGS | frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr li listing main menu nav ol p plaintext pre search section summary ul xmp".split())
SPECIAL = CLOSES_P | HEAD_TAGS | frozenset("applet area body br button caption col colgroup embed frame frameset head html iframe img input keygen marquee noembed object param select source table tbody td template textarea tfoot th thead title tr track wbr".split())
INLINE_SPECIAL = frozenset("applet area br button embed img image input keygen marquee object select wbr".split())
SCOPE = ("applet", "caption", "table", "td", "th", "marquee", "object", "template", "svg", "math")
MARKERS = frozenset("applet caption marquee object td template th".split())
TABLE_CONTEXT = frozenset("table tbody tfoot thead tr".split())
#: Table parts, and what each may stand in.
TABLE_PARTS = {"caption": {"table"}, "colgroup": {"table"}, "col": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "thead": {"table"}, "tr": {"table", "tbody", "tfoot", "thead"}, "td": {"table", "tbody", "tfoot", "thead", "tr"}, "th": {"table", "tbody", "tfoot", "thead", "tr"}}
INTEGRATION = ("foreignobject", "desc", "title", "annotation-xml", "mi", "mn", "mo", "ms", "mtext")
BREAKOUT = HEADINGS | frozenset("b big blockquote body br center code dd div dl dt em embed head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
# What is left out of the visible text, and what ends with a space in it.
HIDDEN = frozenset("script style noscript template svg".split())
SPACED = HEADINGS | frozenset("br p div section article li td th".split())
#: Texts of elements within one another that are gathered at once; the text of any further one inside is taken as empty.
MOST_SINKS = 64

_SKIP, _NAME, _EQUALS, _BARE, _TAG_NAME, _COMMENT_END = (re.compile(p) for p in (r"[\t\n\f\r /]*", r"=?[^\t\n\f\r />=]*", r"[\t\n\f\r ]*=[\t\n\f\r ]*", r"[^\t\n\f\r >]*", r"[^\t\n\f\r />]*", r"--!?>"))
_REFERENCE = re.compile(r"&(#?[A-Za-z0-9]+)(;?)(=?)")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\t\n\f\r />])", re.I) for tag in RAW}


def attribute_text(value: str) -> str:
    """An attribute's value with references decoded; names without a semicolon before a letter, digit or = are no references there."""

    def decoded(m: re.Match) -> str:
        name, end, equals = m.groups()
        known = name.startswith("#") or (name + end in html5 and not (equals and not end))
        return unescape(f"&{name}{end}") + equals if known else m.group()

    return _REFERENCE.sub(decoded, value) if "&" in value else value


def _attributes(html: str, at: int) -> tuple[dict[str, str], bool, int] | None:
    """Attributes from a place inside a tag, whether it closes itself, and where it ends; None for a tag without an end."""
    found: dict[str, str] = {}
    while (at := _SKIP.match(html, at).end()) < len(html):
        if html[at] == ">":
            return found, html[at - 1] == "/", at + 1
        name = _NAME.match(html, at)
        at, value = name.end(), ""
        if equals := _EQUALS.match(html, at):
            at = equals.end()
            quote = html[at : at + 1]
            if quote in ('"', "'") and quote:
                end = html.find(quote, at + 1)
                if end < 0:
                    return None
                value, at = html[at + 1 : end], end + 1
            else:
                bare = _BARE.match(html, at)
                value, at = bare.group(), bare.end()
        found.setdefault(name.group().lower(), attribute_text(value))
    return None


def tokens(html: str) -> Iterator[tuple[str, str, dict[str, str], bool]]:
    """(kind, name or text, attributes, closes itself): kinds are doctype, start, end and text. Comments are passed over."""
    at, size, foreign = 0, len(html), 0
    while at < size:
        low = html.find("<", at)
        if low < 0:
            low = size
        if low > at:
            yield "text", unescape(html[at:low]), {}, False
        at, mark = low, html[low + 1 : low + 3]
        if low == size:
            return
        if mark[:1].isascii() and mark[:1].isalpha() or (mark[:1] == "/" and mark[1:].isascii() and mark[1:].isalpha()):
            closing = mark[0] == "/"
            name = _TAG_NAME.match(html, low + 1 + closing)
            rest = _attributes(html, name.end())
            if rest is None:
                return
            tag, at = name.group().lower(), rest[2]
            yield "end" if closing else "start", tag, rest[0], rest[1]
            foreign = max(0, foreign + (0 if tag not in ("svg", "math") or rest[1] else -1 if closing else 1))
            if tag == "plaintext" and not closing:
                yield "text", html[at:], {}, False
                return
            if tag in RAW and not closing and not (foreign and rest[1]):
                end = _RAW_END[tag].search(html, at)
                stop = end.start() if end else size
                text = html[at:stop]
                yield "text", unescape(text) if tag in ("title", "textarea") else text, {}, False
                at = stop
        elif mark.startswith("!") and html.startswith("--", low + 2):
            end = _COMMENT_END.search(html, low + 2)
            at = end.end() if end else size
        elif mark[:1] in ("!", "?", "/") and mark:
            end = html.find(">", low + 1)
            if html[low + 2 : low + 9].lower() == "doctype":
                yield "doctype", html[low + 9 : end if end >= 0 else size].strip().lower(), {}, False
            at = end + 1 if end >= 0 else size
        else:
            yield "text", "<", {}, False
            at = low + 1


class _State(NamedTuple):
    """Where text inside an element goes: nowhere if hidden, into the page's text, and into that of its main part if not None."""

    hidden: bool
    text: list
    main: list | None


class _Open:
    __slots__ = ("tag", "state", "sink", "alive", "hides", "special", "outer", "before")

    def __init__(self, tag: str, state: _State, sink, hides: bool, special: bool):
        self.tag, self.state, self.sink, self.hides, self.special = tag, state, sink, hides, special
        self.alive, self.outer, self.before = True, None, None


def _flat(parts: list) -> str:
    out, todo = [], [iter(parts)]
    while todo:
        for part in todo[-1]:
            if isinstance(part, list):
                todo.append(iter(part))
                break
            out.append(part)
        else:
            todo.pop()
    return "".join(out)


class PageTree:
    """Gathers a page's parts while its elements open and close. Texts come as they stand, white space and all."""

    def __init__(self, html: str):
        self.metas: list[dict[str, str]] = []
        self.links: list[dict[str, str]] = []
        self.anchors: list[str] = []
        self.headings, self.dates, self.blocks, self.authors, self.titles, self.notices = [], [], [], [], [], []
        self.lang = self.base = None
        self.scripts = 0
        self._stack: list[_Open] = []
        self._at: dict[str, list[int]] = defaultdict(list)
        self._specials: list[int] = []
        self._blocks: list[int] = []  # special ones that a list item doesn't end across
        self._pending: list[str] = []
        self._all, self._seen = [], []  # all texts, and visible ones without the spaces that ends of elements add
        self._sinks = self._hiding = 0
        self._body = self._frames = self._gone = False
        self._quirks, self._main = True, 0
        self._text, self._main_text = [], []
        self._root = _State(False, self._text, None)
        for kind, name, attributes, closed in tokens(html):
            if kind == "text":
                self._add(name)
            elif kind == "start":
                self._start(name, attributes, closed)
            elif kind == "end":
                self._end(name)
            elif not self._body:
                self._quirks = name.split(" ")[0] != "html"
        while self._stack:
            self._pop()
        self.text = "" if self._gone else _flat(self._text)
        self.main = "" if self._gone else _flat(self._main_text)
        self.headings = [] if self._gone else self.headings

    # Places of open elements

    def _place(self, *tags: str) -> int:
        return max((self._at[t][-1] for t in tags if self._at[t]), default=-1)

    def _top(self) -> _Open | None:
        while self._stack and not self._stack[-1].alive:
            self._stack.pop()
        return self._stack[-1] if self._stack else None

    def _foreign(self) -> bool:
        root = self._place("svg", "math")
        return root >= 0 and root > self._place(*INTEGRATION)

    def _own_state(self) -> _State:
        """Of what comes next: that of the open element, or before the table where a table can't hold it."""
        top = self._top()
        return self._root if top is None else self._stack[self._place("table")].before if top.tag in TABLE_CONTEXT and self._at["table"] else top.state

    # Opening and closing

    def _push(self, tag: str, state: _State, sink=None, hides: bool = False) -> None:
        element = _Open(tag, state, sink, hides, tag in SPECIAL and not self._foreign())
        self._at[tag].append(len(self._stack))
        if element.special:
            self._specials.append(len(self._stack))
            if tag not in ("address", "div", "p"):
                self._blocks.append(len(self._stack))
        if tag in MARKERS:
            element.outer, self._pending = self._pending, []
        self._hiding += hides
        self._stack.append(element)

    def _left(self, element: _Open, own: bool) -> None:
        """An element ends here. own: by its own tag; else hidden formatting goes on in what follows."""
        element.alive = False
        self._at[element.tag].pop()
        if element.hides:
            self._hiding -= 1
            if not own and self._pending.count(element.tag) < 3:
                self._pending.append(element.tag)
        if element.sink is not None:
            into, key, low, log = element.sink
            into[key] = "".join(log[low:])
            self._sinks -= 1
        if element.tag in SPACED and not element.state.hidden and not self._hiding:
            self._put(" ", element.state)
        if element.outer is not None:
            self._pending = element.outer

    def _pop(self, own: bool = False) -> None:
        element = self._stack.pop()
        if element.alive:
            if element.special:
                self._specials.pop()
                if self._blocks and self._blocks[-1] == len(self._stack):
                    self._blocks.pop()
            self._left(element, own)

    def _pop_to(self, place: int) -> None:
        """Close all from the top down to the element at the place, that one by its own tag."""
        while len(self._stack) > place:
            self._pop(len(self._stack) == place + 1)

    def _close(self, tag: str, *barriers: str) -> None:
        place = self._place(tag)
        if place >= 0 and place > self._place(*(b for b in barriers if b != tag)):
            self._pop_to(place)

    def _close_formatting(self, tag: str) -> None:
        place = self._place(tag)
        if place < 0 or place < self._place(*SCOPE):
            if tag in self._pending:
                self._pending.remove(tag)
        elif self._specials and self._specials[-1] > place:
            self._left(self._stack[place], True)  # blocks inside it stay open, without it
        else:
            self._pop_to(place)

    def _reopen(self) -> None:
        """Hidden formatting that no own tag has closed hides what follows too."""
        pending, self._pending = self._pending, []
        for tag in pending:
            self._push(tag, self._own_state(), None, True)

    def _open_body(self) -> None:
        if not self._body:
            self._body = True
            while self._stack:
                self._pop()

    # Tokens

    def _add(self, text: str) -> None:
        self._all.append(text)
        top = self._top()
        raw = top is not None and top.tag in RAW
        if not self._body and not self._at["template"] and not raw and not self._foreign():
            text = text.lstrip(SPACE)
            if not text:
                return
            self._open_body()
        if not self._body or self._frames:
            return
        if self._pending and not raw:
            self._reopen()
        state = self._own_state() if text.strip(SPACE) else self._stack[-1].state if self._top() else self._root
        if not state.hidden and not self._hiding:
            self._seen.append(text)
            self._put(text, state)

    def _put(self, text: str, state: _State) -> None:
        if self._body:
            state.text.append(text)
            if state.main is not None:
                state.main.append(text)

    def _start(self, tag: str, a: dict[str, str], closed: bool) -> None:
        hides = "hidden" in a or a.get("aria-hidden") == "true"
        if self._foreign():
            if tag not in BREAKOUT and not (tag == "font" and {"color", "face", "size"} & set(a)):
                self._take(tag, a, self._own_state(), hides, closed)
                return
            while self._foreign():
                self._pop()
        if tag in ("html", "body", "head"):
            if tag == "html" and self.lang is None:
                self.lang = a.get("lang")
            self._gone |= hides and tag != "head"
            if tag == "body":
                self._open_body()
            return
        if tag in ("frameset", "frame"):
            self._frames |= tag == "frameset" and not self._body
            return
        if not self._body and not self._at["template"] and tag not in HEAD_TAGS:
            self._open_body()
        if self._at["select"] and tag not in ("option", "optgroup", "hr", "script", "template"):
            if tag not in ("input", "keygen", "select", "table", "textarea") and tag not in TABLE_PARTS:
                return
            self._close("select")
            if tag == "select":
                return
        if tag in TABLE_PARTS:
            self._table_part(tag, a, hides)
            return
        top = self._top()
        if tag == "table" and top is not None and top.tag in TABLE_CONTEXT:
            self._close("table")
        if self._body:
            self._imply_ends(tag)
        top = self._top()
        inside = top is not None and top.tag in TABLE_CONTEXT and (tag in ("script", "style", "template") or (tag == "input" and a.get("type", "").lower() == "hidden"))
        if self._pending and (tag not in SPECIAL or tag in INLINE_SPECIAL):
            self._reopen()
        self._take(tag, a, top.state if inside else self._own_state(), hides, False)

    def _imply_ends(self, tag: str) -> None:
        if tag in CLOSES_P or (tag == "table" and not self._quirks):
            self._close("p", *SCOPE, "button")
        top = self._top()
        if tag in HEADINGS and top is not None and top.tag in HEADINGS:
            self._pop()
        elif tag in ("li", "dd", "dt"):
            place = self._place(*(("li",) if tag == "li" else ("dd", "dt")))
            if place >= 0 and place == self._blocks[-1]:
                self._pop_to(place)
        elif tag in ("option", "optgroup"):
            for inner in ("option", "optgroup") if tag == "optgroup" else ("option",):
                if (top := self._top()) is not None and top.tag == inner:
                    self._pop()
        elif tag == "button":
            self._close("button", *SCOPE)
        elif tag == "a" and self._place("a") > self._place(*MARKERS):
            self._close_formatting("a")

    def _table_part(self, tag: str, a: dict[str, str], hides: bool) -> None:
        table, template = self._place("table"), self._place("template")
        if template > table:
            if tag not in VOID:
                self._take(tag, a, self._own_state(), hides, False)
        elif table >= 0:
            while (top := self._top()).tag not in TABLE_PARTS[tag]:
                self._pop()
            if tag not in ("col", "colgroup"):
                self._take(tag, a, top.state, hides, False)

    def _take(self, tag: str, a: dict[str, str], state: _State, hides: bool, closed: bool) -> None:
        """Note what the element says and open it, unless it has no content."""
        name = a.get("name", "").lower()
        if tag == "base" and self.base is None and "href" in a:
            self.base = a["href"]
        elif tag == "meta":
            self.metas.append(a | {"name": name, "property": a.get("property", "").lower(), "raw": a.get("name", "")})
        elif tag == "link":
            self.links.append(a)
        elif tag == "a" and "href" in a:
            self.anchors.append(a["href"])
        json_ld = tag == "script" and a.get("type", "").lower() == "application/ld+json"
        self.scripts += tag == "script" and not json_ld
        formatting = tag in FORMATTING
        hidden = state.hidden or tag in HIDDEN or (hides and not formatting)
        into = None
        if tag == "title":
            into = self.titles
        elif json_ld:
            into = self.blocks
        elif tag == "noscript":
            into = self.notices
        elif tag in HEADINGS and not hidden and not self._hiding and not self._foreign():
            into = self.headings
        elif "author" in a.get("rel", "").split():
            into = self.authors
        prop = a.get("itemprop", "")
        entry = None
        if prop in ("datePublished", "dateModified"):
            if value := a.get("content") or a.get("datetime"):
                self.dates.append({"property": prop, "text": value})
            elif into is None:
                into, entry = self.dates, {"property": prop, "text": ""}
        if into is not None:
            entry = entry or {"level": int(tag[1]) if into is self.headings else 0, "text": ""}
            into.append(entry)
        if tag in VOID or closed:
            if tag in SPACED and not hidden and not hides and not self._hiding:
                self._put(" ", state)
            return
        main = state.main
        if not self._main and not hidden and not self._hiding and (tag in ("main", "article") or a.get("role") == "main"):
            self._main, main = 1, self._main_text
        sink = None
        if into is not None and self._sinks < MOST_SINKS:
            self._sinks += 1
            log = self._seen if into is self.headings else self._all
            sink = (entry, "text", len(log), log)
        inner = _State(hidden, state.text, main)
        if tag == "table":
            slot, main_slot = [], [] if state.main is not None else None
            state.text.append(slot)
            if main_slot is not None:
                state.main.append(main_slot)
        self._push(tag, inner, sink, hides and formatting)
        if tag == "table":
            self._stack[-1].before = _State(state.hidden, slot, main_slot)

    def _end(self, tag: str) -> None:
        if tag in ("html", "body", "head"):
            if tag != "head" and not self._at["template"]:
                self._open_body()
        elif tag == "br":
            self._start("br", {}, False)
        elif tag == "p" and not self._place("p") > self._place(*SCOPE, "button"):
            if self._body and not self._foreign():
                self._start("p", {}, False)
                self._close("p")
        elif not self._at[tag] and tag not in FORMATTING and tag not in HEADINGS:
            pass
        elif self._foreign() and self._place(tag) >= self._place("svg", "math"):
            self._pop_to(self._place(tag))
        elif tag in FORMATTING:
            self._close_formatting(tag)
        elif tag in HEADINGS:
            place = self._place(*HEADINGS)
            if place >= 0 and place > self._place(*SCOPE):
                self._pop_to(place)
        elif tag == "li":
            self._close("li", *SCOPE, "ol", "ul")
        elif tag in TABLE_PARTS or tag == "table":
            self._close(tag, "table", "template")
        elif tag in ("select", "template") or tag in RAW:
            self._close(tag)
        elif tag in SPECIAL:
            self._close(tag, *SCOPE, *(("button",) if tag == "p" else ()))
        elif not self._specials or self._place(tag) > self._specials[-1]:
            self._pop_to(self._place(tag))


def plain_text(html: str) -> str:
    """All text of a bit of HTML."""
    return "".join(text for kind, text, _, _ in tokens(html) if kind == "text")
