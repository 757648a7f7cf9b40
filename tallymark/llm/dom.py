"""A page as a tree of elements and texts, from markup that may be broken."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())
#: Elements that stand in a paragraph without ending it, though breaks surround them.
WITHIN = frozenset("svg math noscript template".split())
#: Elements of another language, where "/>" closes, and those that bring the page's own back.
FOREIGN = frozenset(("svg", "math"))
HOSTS = frozenset(("foreignobject", "annotation-xml"))
#: An element that can't stand in a foreign one closes it.
BREAKS_OUT = frozenset(
    """article aside b big blockquote body br center code dd div dl dt em embed footer h1 h2 h3 h4 h5 h6 head header hr i img li listing main menu meta
    nav nobr ol p pre ruby s section small span strike strong sub sup table tt u ul var""".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: An element that starts ends an open one of these, up to the boundary.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
#: Where the search for an open paragraph stops.
WALLS = frozenset("table td th button body html object caption".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)", re.S)
#: The end of a tag, or a value with its quote or, without one, whole.
_STEP = re.compile(r"""=\s*+(?:(["'])|([^\s>]*+))|>""")
_MARKS = frozenset(("class", "id", "role"))
_GIVEN = "data-y"

TEXT = "#text"


@dataclass
class Page:
    """Nodes in page order: node 0 is the page. ``marks`` are class, id and role; ``flow`` is the texts and the breaks (-1) between blocks."""

    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: ["#page"])
    marks: list[str] = field(default_factory=lambda: [""])
    given: list[str] = field(default_factory=lambda: [""])
    text: dict[int, str] = field(default_factory=dict)
    flow: list[int] = field(default_factory=list)

    def add(self, parent: int, tag: str, marks: str = "", given: str = "") -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.tag.append(tag)
        self.marks.append(marks)
        self.given.append(given)
        return len(self.parent) - 1


def _end_tag(name: str) -> re.Pattern[str]:
    # Patterns are kept by their module. A cache of our own would be pickled by name, which workers without the package can't look up.
    return re.compile(rf"</{name}(?=[\s/>])", re.I | re.A)


def _attributes(source: str, at: int, unclosed: set[str]) -> tuple[int, str, str]:
    """Where a tag ends that has its name before ``at`` (-1 if nowhere), its marks and its ``data-y``.

    A quote that opens a value and never closes ends the tag at the next ">". ``unclosed`` holds the
    quotes that are known not to come again, so that nothing is searched twice.
    """
    marks = given = ""
    while found := _STEP.search(source, at):
        if found[0] == ">":
            return found.end(), marks, given
        name = source[at : found.start()].split()
        name = name[-1].rpartition("/")[2].lower() if name else ""
        quote, value, at = found[1], found[2], found.end()
        if quote:
            end = -1 if quote in unclosed else source.find(quote, at)
            if end < 0:
                unclosed.add(quote)
                return source.find(">", at) + 1 or -1, marks, given
            if name in _MARKS or name == _GIVEN:
                value = source[at:end]
            at = end + 1
        if name == _GIVEN:
            given = value
        elif name in _MARKS:
            marks += " " + value
    return -1, marks, given


def parse(source: str | None) -> Page:
    """The tree of a page; null and empty pages have the page node alone."""
    page = Page()
    if not source:
        return page
    stack = [0]
    open_tags: dict[str, int] = {}

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            node = stack.pop()
            open_tags[page.tag[node]] -= 1
            if page.tag[node] not in INLINE:
                page.flow.append(-1)

    def put(text: str) -> None:
        if text and not text.isspace():
            node = page.add(stack[-1], TEXT)
            page.text[node] = html.unescape(text) if "&" in text else text
            page.flow.append(node)
        elif text:
            page.flow.append(-1)

    def foreign() -> bool:
        return any(open_tags.get(t) for t in FOREIGN) and not any(open_tags.get(t) for t in HOSTS)

    at = 0
    never: set[str] = set()
    unclosed: set[str] = set()
    final = source.rfind(">")
    while True:
        # Without another ">" only a comment can follow, and it would run to the end.
        found = _TAG.search(source, at) if at <= final else None
        if found is None:
            put(source[at:].split("<!--")[0])
            break
        put(source[at : found.start()])
        at = found.end()
        name = found[2]
        if name is None:
            continue
        if found.start() > final:
            put(source[found.start() :].split("<!--")[0])
            break
        at, marks, given = _attributes(source, at, unclosed)
        if at < 0:
            break
        name = name.lower()
        if found[1]:
            if open_tags.get(name):
                depth = len(stack) - 1
                while page.tag[stack[depth]] != name:
                    depth -= 1
                close(depth)
            elif name in ("p", "br"):
                page.flow.append(-1)
            continue
        inside = foreign()
        if inside and name in BREAKS_OUT:
            while foreign():
                close(len(stack) - 1)
            inside = False
        if name not in INLINE:
            page.flow.append(-1)
        if name not in INLINE and name not in WITHIN and not inside:
            if open_tags.get("p"):
                depth = len(stack) - 1
                while page.tag[stack[depth]] not in WALLS and page.tag[stack[depth]] != "p" and depth > 0:
                    depth -= 1
                if page.tag[stack[depth]] == "p" and name not in VOID:
                    close(depth)
            if name in ENDS:
                ended, walls = ENDS[name]
                if any(open_tags.get(t) for t in ended):
                    depth, last = len(stack) - 1, None
                    while depth > 0 and page.tag[stack[depth]] not in walls:
                        if page.tag[stack[depth]] in ended:
                            last = depth
                        depth -= 1
                    if last is not None:
                        close(last)
        if name in VOID:
            continue
        if source[at - 2] == "/" and (inside or name in FOREIGN or name in RAW):
            continue
        if name in RAW:
            # To its end tag, whatever stands between.
            end = None if name in never else _end_tag(name).search(source, at)
            if end is not None:
                end = source.find(">", end.end())
                at = end + 1 if end >= 0 else len(source)
                continue
            never.add(name)
            if not inside:
                break
        node = page.add(stack[-1], name, marks, given)
        stack.append(node)
        open_tags[name] = open_tags.get(name, 0) + 1
    close(1)
    return page
