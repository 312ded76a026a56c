"""A page as a tree, for what patterns cannot say."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

#: Elements without content, by the HTML standard.
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
#: Elements whose bounds separate words.
BLOCK = frozenset({
    "p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "blockquote",
    "pre", "ul", "ol", "section", "article", "br", "table", "thead", "tbody",
    "figure", "figcaption",
})
HIDDEN = frozenset({"script", "style", "template"})


class Element:
    """A tag with its attributes, and its texts and elements in order."""

    __slots__ = ("tag", "attributes", "content")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.content = tag, attributes, []

    def classes(self) -> list[str]:
        return self.attributes.get("class", "").split()

    def walk(self) -> Iterator[tuple[Element, bool]]:
        """(element, whether it ends here) of all below, each twice."""
        stack: list[tuple[Element, bool]] = [(self, True), (self, False)]
        while stack:
            own, ends = stack.pop()
            yield own, ends
            if not ends:
                for part in reversed(own.content):
                    if isinstance(part, Element):
                        stack += [(part, True), (part, False)]

    def matching(self, test: Callable[[Element], bool]) -> list[Element]:
        """Elements that pass the test, in order of their ends."""
        return [own for own, ends in self.walk() if ends and test(own)]

    def text(self) -> str:
        """All visible text; the bounds of blocks are line breaks."""
        out, stack = [], [self]
        while stack:
            part = stack.pop()
            if isinstance(part, str):
                out.append(part)
            elif part.tag not in HIDDEN:
                edge = ["\n"] if part.tag in BLOCK and part is not self else []
                stack += [*edge[: part.tag not in VOID], *reversed(part.content), *edge]
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        own = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].content.append(own)
        if tag not in VOID:
            self.open.append(own)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].content.append(Element(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        """An end closes the nearest open element of its name, and those in it."""
        names = [own.tag for own in self.open]
        if tag in names[1:]:
            del self.open[len(names) - 1 - names[::-1].index(tag) :]

    def handle_data(self, data):
        self.open[-1].content.append(data)


def tree(page: str) -> Element:
    """The root of a page; broken HTML gives what could be read."""
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.root
