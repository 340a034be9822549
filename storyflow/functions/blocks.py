"""Block structure of markup: a forgiving parse, balancing, and paragraphs for bare text.

A page becomes a tree in which inline elements never hold blocks: a block closes
the inline elements around it and they open again inside it, as a browser does for
elements that were closed in the wrong order or never. Markup that holds these
rules comes out as it was, apart from how tags are spelled. Comments and the
document type are dropped. Null in gives null out.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column

from storyflow.functions.html import VOID, Markup
from storyflow.functions.text import arrow_text

#: Elements that end a paragraph and the inline elements around them.
BLOCKS = frozenset("html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul".split())
#: Inline elements that open again after a block closed them.
PHRASES = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd mark nobr q s samp small span strike strong sub sup tt u var".split())
#: Elements that an element of the same group ends, up to the elements that begin a new level.
ENDED_BY = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}), "option": ({"option"}, {"select"})}
#: Cells, out of which no inline element leaks.
CELLS = {"td", "th", "caption"}
#: Blocks that keep their content, and those whose content is looked into, for paragraphs.
WHOLE = frozenset("address aside del dl fieldset form ins ol p pre table ul h1 h2 h3 h4 h5 h6".split())
ENTERED = frozenset("blockquote div noscript html body article section main center".split())
MARK = "paragraphs-made"
RULE, SPACER = "<hr />\n", "<p><br /></p>\n"
_MOST_BREAKS, _LONG_LINE = 8, 90


class Element:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: list[tuple[str, str]] = ()):
        self.tag, self.attributes, self.children = tag, list(attributes), []

    def start(self) -> str:
        return f"<{self.tag}{''.join(f' {k}=' + chr(34) + entities.escape(v) + chr(34) for k, v in self.attributes)}{' /' if self.tag in VOID else ''}>"

    def end(self) -> str:
        return "" if self.tag in VOID else f"</{self.tag}>"

    def classes(self) -> list[str]:
        return dict(self.attributes).get("class", "").split()

    def elements(self) -> Iterator[Element]:
        """This element and all below, in document order."""
        waiting = [self]
        while waiting:
            one = waiting.pop()
            yield one
            waiting.extend(c for c in reversed(one.children) if isinstance(c, Element))


def written(nodes: list) -> str:
    """Markup of a list of elements and texts."""
    out, waiting = [], list(reversed(nodes))
    while waiting:
        node = waiting.pop()
        if isinstance(node, Element):
            out.append(node.start())
            waiting.append(node.end())
            waiting.extend(reversed(node.children))
        else:
            out.append(node)
    return "".join(out)


class _Builder(Markup):
    def __init__(self):
        super().__init__()
        self.root = Element("")
        self.open: list[Element] = [self.root]
        #: Inline elements that are meant to be open, from outside in; None marks a cell.
        self.meant: list[Element | None] = []

    def _meant(self) -> list[Element]:
        at = len(self.meant)
        while at and self.meant[at - 1] is not None:
            at -= 1
        return self.meant[at:]

    def _pop(self) -> None:
        """Close the innermost element; an inline one that is meant to go on goes if it is empty."""
        last = self.open.pop()
        if last.tag in CELLS:
            while self.meant and self.meant.pop() is not None:
                pass
        if not last.children and any(m is last for m in self.meant):
            self.open[-1].children.pop()

    def _close_to(self, last: Element) -> None:
        while self.open[-1] is not last:
            self._pop()
        self._pop()

    def _find(self, tags: set[str], stops: Callable[[str], bool]) -> Element | None:
        for element in reversed(self.open[1:]):
            if element.tag in tags:
                return element
            if stops(element.tag):
                return None
        return None

    def _reopen(self) -> None:
        for i, wanted in enumerate(self.meant):
            if wanted is not None and i >= len(self.meant) - len(self._meant()) and not any(e is wanted for e in self.open):
                again = Element(wanted.tag, wanted.attributes)
                self._add(again)
                self.open.append(again)
                self.meant[i] = again

    def _add(self, node) -> None:
        self.open[-1].children.append(node)

    def _leave_phrases(self) -> None:
        while self.open[-1].tag in PHRASES:
            self._pop()

    def handle_starttag(self, tag, attributes):
        attributes = [(k, v or "") for k, v in dict(attributes).items()]
        if tag in BLOCKS:
            barred = lambda t: t not in BLOCKS and t not in PHRASES or t in CELLS or t == "table"
            if tag in ENDED_BY:
                ends, stops = ENDED_BY[tag]
                if found := self._find(ends, lambda t: t in stops):
                    self._close_to(found)
            if found := self._find({"p"}, barred):
                self._close_to(found)
            self._leave_phrases()
            if re.fullmatch("h[1-6]", tag) and re.fullmatch("h[1-6]", self.open[-1].tag):
                self._pop()
        elif tag == "option" and self.open[-1].tag == "option":
            self._pop()
        elif tag not in ("script", "style"):
            if tag == "a" and (last := next((m for m in reversed(self._meant()) if m.tag == "a"), None)):
                self.handle_endtag("a") if last else None
            self._reopen()
        element = Element(tag, attributes)
        self._add(element)
        if tag not in VOID:
            self.open.append(element)
            if tag in PHRASES:
                self.meant.append(element)
            elif tag in CELLS:
                self.meant.append(None)

    def handle_startendtag(self, tag, attributes):
        self.handle_starttag(tag, attributes)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in VOID:
            if tag == "br":
                self.handle_starttag("br", [])
        elif tag in PHRASES:
            found = next((m for m in reversed(self._meant()) if m.tag == tag), None)
            if found:
                at = next(i for i in range(len(self.meant) - 1, -1, -1) if self.meant[i] is found)
                del self.meant[at]
                if any(e is found for e in self.open) and self._reachable(found):
                    self._close_to(found)
        else:
            found = self._find({tag}, lambda t: tag not in ("table", "html", "body") and (t in CELLS and tag not in ("td", "th", "caption", "tr", "tbody", "thead", "tfoot") or t not in BLOCKS and t not in PHRASES))
            if found:
                self._close_to(found)

    def _reachable(self, wanted: Element) -> bool:
        """Whether only inline elements lie inside it."""
        for element in reversed(self.open):
            if element is wanted:
                return True
            if element.tag not in PHRASES:
                return False
        return False

    def handle_data(self, data):
        if self.open[-1].tag in ("script", "style"):
            self._add(data)
            return
        if data.strip():
            self._reopen()
        self._add(data.replace("<", "&lt;"))


def parsed(markup: str) -> Element:
    """The tree of a page or a part of one, below an element without a tag."""
    builder = _Builder()
    builder.feed(markup)
    builder.close()
    while len(builder.open) > 1:
        builder._pop()
    return builder.root


def balance(markup: str) -> str:
    """Every element closed where it was opened; texts are unchanged, end tags of nothing are dropped."""
    return written(parsed(markup).children)


balanced = arrow_text(balance)


# --- paragraphs --------------------------------------------------------------


def _tokens(nodes: list) -> list:
    """Starts, ends, texts, breaks and rules of inline nodes; no space is left around a break or rule."""
    out: list = []

    def walk(children):
        for node in children:
            if not isinstance(node, Element):
                out.append(("text", node))
            elif node.tag in ("br", "hr"):
                out.append((node.tag, None))
            elif node.tag in VOID or node.tag not in PHRASES:
                out.append(("text", written([node])))
            else:
                out.append(("start", node))
                walk(node.children)
                out.append(("end", node))

    walk(nodes)
    cut = lambda i: i < 0 or i >= len(out) or out[i][0] in ("br", "hr")
    trimmed = []
    for i, (kind, value) in enumerate(out):
        if kind == "text":
            value = value.lstrip() if cut(i - 1) else value
            value = value.rstrip() if cut(i + 1) else value
            if not value:
                continue
        trimmed.append((kind, value))
    return trimmed


def _runs(nodes: list, shielded: bool) -> Iterator[tuple[str, object, bool]]:
    """("open", element), ("close", element), ("whole", element) and ("run", tokens, shielded) of a container."""
    run: list = []

    def flushed():
        nonlocal run
        nodes, run = run, []
        while nodes and isinstance(nodes[0], str) and not nodes[0].strip():
            nodes.pop(0)
        while nodes and isinstance(nodes[-1], str) and not nodes[-1].strip():
            nodes.pop()
        if nodes:
            yield "run", _tokens(nodes), shielded

    for node in nodes:
        if isinstance(node, Element) and (node.tag in ENTERED or node.tag in WHOLE):
            yield from flushed()
            if node.tag in ENTERED:
                yield "open", node, shielded
                yield from _runs(node.children, shielded or node.tag == "blockquote")
                yield "close", node, shielded
            else:
                yield "whole", node, shielded
        else:
            run.append(node)
    yield from flushed()


def _broken(tokens: list) -> list:
    """Tokens with consecutive breaks as one, ("br", how many); those at the ends and beside rules go."""
    out: list = []
    for kind, value in tokens:
        if kind == "br" and out and out[-1][0] == "br":
            out[-1] = ("br", out[-1][1] + 1)
        elif kind == "br":
            if not out or out[-1][0] != "hr":
                out.append(("br", 1))
        else:
            if kind == "hr" and out and out[-1][0] == "br":
                out.pop()
            out.append((kind, value))
    while out and out[0][0] == "br":
        out.pop(0)
    while out and out[-1][0] == "br":
        out.pop()
    return out


def _usual(items: list) -> tuple[int, bool]:
    """How many breaks end a paragraph at most, and whether single breaks only wrap lines.

    The most frequent run of two breaks or more counts, the longer on ties; without
    any, single breaks do. Single breaks wrap lines if they are more frequent and
    lines are shorter than 90 characters on average.
    """
    counts, lines = [0] * (_MOST_BREAKS + 1), [""]
    for kind, value, shielded in items:
        if kind == "run" and not shielded:
            lines[-1] += "{p}"
            for token, x in value:
                if token == "br":
                    if x <= _MOST_BREAKS:
                        counts[x] += 1
                    lines.extend([""] * x)
                else:
                    lines[-1] += x.start() if token == "start" else x.end() if token == "end" else RULE if token == "hr" else x
            lines[-1] += "{/p}"
        elif kind == "open":
            lines[-1] += value.start()
        elif kind == "close":
            lines[-1] += value.end()
        else:
            lines[-1] += written([value]) if kind == "whole" else "".join(x if t == "text" else "" for t, x in value)
    usual = max(range(2, _MOST_BREAKS + 1), key=lambda n: (counts[n], n))
    if usual == _MOST_BREAKS and counts[usual] < 2:
        usual = 1
    full = [len(line.strip()) for line in lines if line.strip()] or [0]
    return usual, usual > 1 and counts[1] > counts[usual] and sum(full) / len(full) < _LONG_LINE


def _paragraphs(tokens: list, usual: int, wrap: bool, shielded: bool) -> str:
    """A run as paragraphs; inline elements close before each end and open again after it."""
    out, own, inside, filled = [], [], [], False

    def ended():
        nonlocal own, filled
        if filled:
            out.append(f"<p>{''.join(own).strip()}{''.join(e.end() for e in reversed(inside))}</p>\n")
        own, filled = [e.start() for e in inside], False

    for kind, value in tokens:
        if kind == "start":
            inside.append(value)
            own.append(value.start())
        elif kind == "end":
            inside.pop()
            if own and own[-1] == value.start() and not (value.attributes and {"id", "name"} & dict(value.attributes).keys()):
                own.pop()
            else:
                own.append(value.end())
                filled = filled or bool(value.attributes)
        elif kind == "text":
            own.append(value)
            filled = filled or bool(value.strip())
        elif kind == "hr":
            ended()
            out.append(RULE)
        elif shielded:
            own.append("<br />" * value)
        elif value == 1 and wrap:
            own.append(" \n")
        else:
            ended()
            if value > usual:
                out.append(SPACER if value == usual + 1 and value <= _MOST_BREAKS else RULE)
    ended()
    return "".join(out)


def paragraphs(markup: str) -> str:
    """Bare text in divs, quotes and the like as paragraphs, told apart by runs of breaks.

    Text and inline elements between blocks become paragraphs at every level of
    divs, quotes and noscript; existing paragraphs, lists, tables and preformatted
    text stay, as do breaks in them and in quotes. Runs of the usual number of
    breaks or fewer end a paragraph; one break more leaves an empty paragraph, still
    more a rule. Nothing but breaks between blocks is an empty paragraph. The result
    is marked, and marked markup stays as it is, as does markup without a tag.
    """
    if MARK in markup or "<" not in markup or ">" not in markup:
        return markup
    nodes = parsed(markup.replace("\xa0", " ").strip()).children
    while nodes and isinstance(nodes[0], str) and not nodes[0].strip():
        nodes.pop(0)
    while nodes and isinstance(nodes[-1], str) and not nodes[-1].strip():
        nodes.pop()
    if len(nodes) == 1 and isinstance(nodes[0], Element) and nodes[0].tag == "div":
        nodes = nodes[0].children
    items, bare = [], set()
    for kind, value, shielded in _runs(nodes, False):
        if kind == "run":
            only = all(t == "br" for t, _ in value)
            value = _broken(value)
            if only:
                bare.add(len(items))
        items.append((kind, value, shielded))
    usual, wrap = _usual(items)
    out = []
    for i, (kind, value, shielded) in enumerate(items):
        if i in bare:
            out.append(SPACER)
        elif kind == "run":
            out.append(_paragraphs(value, usual, wrap, shielded))
        elif kind == "open":
            out.append(f"{value.start()}\n")
        elif kind == "close":
            if out[-1] == f"{value.start()}\n" and not value.attributes:
                out.pop()
            else:
                out.append(f"{value.end()}\n")
        elif value.tag == "p" and not written(value.children).strip():
            out.append(SPACER)
        else:
            out.append(f"{written([value]).strip()}\n")
    return f'<!-- {MARK} -->\n<div id="{MARK}">\n{"".join(out)}</div>\n'


paragraphed = arrow_text(paragraphs)


# --- single changes of a tree ------------------------------------------------


def without_class(name: str) -> Callable[[Column], Column]:
    """Column function: elements lose a class, and the attribute if it was the only one."""

    def changed(markup: str) -> str:
        tree = parsed(markup)
        for element in tree.elements():
            if name in (kept := element.classes()):
                kept = [c for c in kept if c != name]
                element.attributes = [(k, " ".join(kept) if k == "class" else v) for k, v in element.attributes if k != "class" or kept]
        return written(tree.children)

    return arrow_text(changed)


def _address(code: str) -> str | None:
    """A hidden address: hex bytes that the first one was combined into by exclusive or."""
    try:
        key, *rest = bytes.fromhex(code)
        return bytes(b ^ key for b in rest).decode()
    except ValueError:
        return None


def emails_in(markup: str) -> str:
    """Protected addresses as spans of class ``decoded_email``; a link around one goes. Codes that can't be read stay."""
    tree = parsed(markup)
    for parent in tree.elements():
        for at, element in enumerate(parent.children):
            if not isinstance(element, Element):
                continue
            inner = [c for c in element.children if isinstance(c, Element)]
            hides = [e for e in (element, *inner) if e.tag in ("a", "span") and "__cf_email__" in e.classes()]
            held = hides[0] if hides else None
            if held is None or held is not element and not dict(element.attributes).get("href", "").startswith("/cdn-cgi/l/email-protection"):
                continue
            shown = _address(dict(held.attributes).get("data-cfemail", ""))
            if shown:
                span = Element("span", [(k, v) for k, v in element.attributes if k not in ("href", "class")] + [("class", "decoded_email")])
                span.children = [entities.escape(shown, quote=False)]
                parent.children[at] = span
    return written(tree.children)


emails_shown = arrow_text(emails_in)
