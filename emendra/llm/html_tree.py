"""A tolerant HTML reader: token streams to trees of block elements and text runs."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

from emendra.llm.html_names import inline_boilerplate, mark

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that don't end a text block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag of the first kind ends an open element of the second.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
#: How far up an implied end tag reaches at most.
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
#: Deeper elements add their text to their ancestor at this depth; those that are boilerplate add none.
DEPTH = 120

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
#: The rest of a tag; quoted values may hold its end mark, but no start of another tag beyond it.
_REST = re.compile(r"""(?:[^>"'=]++|=\s*"[^"<]*"|=\s*'[^'<]*'|["'=])*+>""")
_ATTRIBUTE = re.compile(r"""(?:^|(?<=[\s"'/]))(class|id|role|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)


@dataclass
class Node:
    """An element, or with tag "#" a run of text: `text` decoded with white space as it is, `linked` the characters inside links.

    `mark` says what its names tell, see `html_names.mark`.
    """

    tag: str
    names: str = ""
    children: list[Node] = field(default_factory=list)
    text: str = ""
    linked: int = 0
    mark: str = ""


def _names_of(attributes: str) -> tuple[str, bool]:
    """Class, id and role in lower case, and whether the element is hidden."""
    names, hidden = [], False
    for m in _ATTRIBUTE.finditer(attributes):
        value = next((x for x in m.groups()[1:] if x is not None), "").lower()
        if m[1].lower() in ("hidden", "aria-hidden"):
            hidden = hidden or value not in ("false", "until-found") if m[1].lower() == "hidden" else hidden or value == "true"
        else:
            names.append(value)
    return " ".join(filter(None, names)), hidden


def _holds_article(form: Node) -> bool:
    """Whether a form is the whole page's: it holds a main element or several paragraphs."""
    todo, paragraphs = [form], 0
    while todo:
        for child in todo.pop().children:
            paragraphs += child.tag == "p"
            if child.tag in ("article", "main") or paragraphs > 2:
                return True
            todo.append(child)
    return False


def read(page: str) -> Node:
    """The page as a tree. Comments, declarations and void elements other than br and hr leave nothing.

    Scripts and styles leave nothing either, not even a break of the block they
    stand in. Inline elements are no nodes; what is in those that are hidden or
    named as adverts or notices is left out.
    """
    root = Node("")
    # (tag, node) of the open elements; too deep ones share their ancestor's node
    stack: list[tuple[str, Node]] = [("", root)]
    text: list[str] = []
    forms: list[Node] = []
    links = 0
    linked = 0
    at = 0
    # a left-out element: its tag (None: whatever closes it), the open elements around it, and how often the tag is open in it
    mute: list | None = None

    def flush() -> None:
        nonlocal linked
        if text:
            whole = "".join(text)
            if whole and not whole.isspace():
                stack[-1][1].children.append(Node("#", text=whole, linked=linked))
            text.clear()
            linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if mute:
            return
        said = html.unescape(raw) if "&" in raw else raw
        text.append(said)
        if links:
            linked += len(said)

    def close_to(depth: int) -> None:
        nonlocal mute
        flush()
        del stack[depth:]
        if mute and len(stack) < mute[1]:
            mute = None

    def close(names: set[str], stop: set[str]) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in names:
                close_to(depth)
                return
            if stack[depth][0] in stop:
                return

    while True:
        start = page.find("<", at)
        if start < 0:
            say(page[at:])
            break
        if start > at:
            say(page[at:start])
        following = page[start + 1 : start + 2]
        if following in ("!", "?"):
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = len(page) if end < 0 else end + 3
            else:
                end = page.find(">", start)
                at = len(page) if end < 0 else end + 1
            continue
        ending = following == "/"
        named = _NAME.match(page, start + 1 + ending)
        if not named:
            if ending and (end := page.find(">", start)) >= 0:
                at = end + 1
            else:
                say("<")
                at = start + 1
            continue
        tag = named[0].lower()
        if page.startswith(">", named.end()):
            end = named.end()
        else:
            over = _REST.match(page, named.end())
            end = over.end() - 1 if over else page.find(">", named.end())
        attributes = page[named.end() : end if end >= 0 else len(page)]
        at = len(page) if end < 0 else end + 1
        if ending:
            if tag == "a":
                links = max(0, links - 1)
            elif tag == "br":
                flush()
            if tag in INLINE:
                if mute and mute[0] == tag:
                    mute[2] -= 1
                    if not mute[2]:
                        mute = None
            else:
                close({tag}, set())
            continue
        if tag in RAW:
            over = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|$)", re.IGNORECASE).search(page, at)
            inside = page[at : over.start() if over else len(page)]
            at = len(page) if not over else (page.find(">", over.end()) + 1 or len(page))
            if tag == "title" and inside.strip():
                flush()
                stack[-1][1].children.append(Node(tag, children=[Node("#", text=html.unescape(inside))], mark="!"))
            continue
        names, hidden = _names_of(attributes) if attributes and not attributes.isspace() else ("", False)
        if tag in VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        if tag in INLINE:
            links += tag == "a"
            if mute:
                mute[2] += mute[0] == tag
            elif hidden or names and inline_boilerplate(names):
                mute = [tag, len(stack), 1]
            continue
        if tag in _CLOSES:
            close(_CLOSES[tag], _SCOPES[tag])
        elif any(x == "p" for x, _ in stack[-3:]):
            close({"p"}, {"button", "table"})
        flush()
        own = "!" if hidden else mark(tag, names)
        links = 0 if tag in ("nav", "article", "main", "body") else links
        open_ = not attributes.rstrip().endswith("/")
        if len(stack) <= DEPTH:
            node = Node(tag, names, mark=own)
            stack[-1][1].children.append(node)
            if tag == "form":
                forms.append(node)
        else:
            node = stack[-1][1]
        if open_:
            stack.append((tag, node))
            if len(stack) > DEPTH + 1 and own == "!" and not mute:
                mute = [None, len(stack), 0]
    flush()
    for form in forms:
        if _holds_article(form):
            form.mark = ""
    return root
