"""Messages out of chat pages."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame

from palimpsest.functions.batches import map_lists

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"p", "div", "li", "ul", "ol", "pre", "tr", "table", "section", "article", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"}
#: What an opening tag ends, and how far out it is looked for.
ENDED_BY = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
SCOPES = {"ul", "ol", "dl", "table", "select", "div", "section", "article", "body", "blockquote"}
BLANK = "\t\n\x0b\x0c\r \xa0\ufeff\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
HIDDEN = {"script", "style", "template", "noscript", "head"}


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.parts = tag, attrs, parent, []

    @property
    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    @property
    def children(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]

    def walk(self):
        """All nodes below, in document order."""
        todo = self.children[::-1]
        while todo:
            n = todo.pop()
            yield n
            todo += n.children[::-1]

    def text(self) -> str:
        """Text as read: blocks stand on lines of their own, hidden parts are left out. No recursion, as pages nest without bound."""
        out: list[str] = []

        def line() -> None:
            if out and not out[-1].endswith("\n"):
                out.append("\n")

        todo: list[Node | str | None] = [*reversed(self.parts)]
        while todo:
            p = todo.pop()
            if p is None:  # the end of a block
                line()
            elif isinstance(p, str):
                out.append(p)
            elif p.tag == "br":
                out.append("\n")
            elif p.tag not in HIDDEN:
                if p.tag in BLOCKS:
                    line()
                    todo.append(None)
                todo += reversed(p.parts)
        return "".join(out).strip(BLANK)

    def longer(self, n: int) -> bool:
        """Has the text more than n characters? Looks no further than needed."""
        size, gap, todo = 0, 0, [*reversed(self.parts)]
        while todo:
            p = todo.pop()
            if isinstance(p, str):
                core = p.strip(BLANK)
                if core:
                    size += (gap + len(p) - len(p.lstrip(BLANK)) if size else 0) + len(core)
                    gap = len(p) - len(p.rstrip(BLANK))
                else:
                    gap += len(p)
                if size > n:
                    return True
            elif p.tag not in HIDDEN:
                todo += reversed(p.parts)
        return len(self.text()) > n


class Tree(HTMLParser):
    """A forgiving tree: an end tag closes the nearest open element of its name, or nothing."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ENDED_BY:  # an open element of this kind ends, unless a list or table of its own is open within it
            n = self.at
            while n.parent is not None and n.tag not in SCOPES and n.tag not in ENDED_BY[tag]:
                n = n.parent
            if n.tag in ENDED_BY[tag]:
                self.at = n.parent
        elif tag in BLOCKS and self.at.tag == "p":
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.parts.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.parts.append(data)


def _first(n: Node, *classes: str) -> str:
    """The text of the first node below of one of the classes, even if it is empty; of the node itself if there is none."""
    return next((x for x in n.walk() if any(c in x.classes for c in classes)), n).text()


# Per platform which nodes are messages, whose they are, and where their text is.
RULES = {
    "ChatGPT": (lambda n: "data-message-author-role" in n.attrs, lambda n: n.attrs["data-message-author-role"], lambda n: _first(n, "markdown", "whitespace-pre-wrap")),
    "Gemini": (lambda n: n.tag == "message-content" or "user-request-interior-slot" in n.classes, lambda n: "assistant" if n.tag == "message-content" else "user", Node.text),
    "Claude": (lambda n: "data-is-streaming" in n.attrs or "font-claude-message" in n.classes or "human-turn" in n.classes, lambda n: "user" if "human-turn" in n.classes else "assistant", Node.text),
    "DeepSeek": (lambda n: "message-item" in n.classes, lambda n: "user" if "user-message" in n.classes else "assistant", lambda n: _first(n, "message-content")),
}


def messages(html: str, platform: str) -> list[tuple[str, str]]:
    """(role, text) of the messages of a platform's page, in document order; texts of up to 2 characters don't count."""
    node, role, text = RULES[platform]
    found = [(role(n) or "unknown", text(n)) for n in Tree(html).root.walk() if node(n)]
    return [(r, t) for r, t in found if len(t) > 2]


def container(root: Node, start: str | None = None) -> Node | None:
    """From a node outwards, the first with two children of more than 20 characters of text each.

    start: the id of the node that was chosen; without it the innermost first node.
    """
    n = next((x for x in root.walk() if x.attrs.get("id") == start), None) if start else root
    if n is None:
        return None
    while not start and n.children:
        n = n.children[0]
    while n is not None and n.tag not in ("body", "#root"):
        if sum(c.longer(20) for c in n.children) >= 2:
            return n
        n = n.parent
    return None


def manual_messages(html: str, start: str | None = None) -> list[tuple[str, str]]:
    """Children of the page's container as messages of unknown role."""
    box = container(Tree(html).root, start)
    return [("unknown", t) for c in (box.children if box else []) if len(t := c.text()) > 2]


def read_page(html: str | None, platform: str | None, start: str | None = None) -> list[tuple[str, str]]:
    """(role, text) of a page's messages; a page that can't be read has none."""
    if not html:
        return []
    try:
        return messages(html, platform) if platform in RULES else manual_messages(html, start)
    except (AssertionError, RecursionError, ValueError):  # what the parser raises on broken markup
        return []


def extract_messages(pages: DataFrame, key: str, html: str = "html", platform: str = "platform", start: str | None = None) -> DataFrame:
    """key, turn, role, text; pages of unknown platforms are read by their container, from the node whose id is in the column start."""
    kind = dict(pages.dtypes)[key]

    def make():
        def run(keys, pages_, platforms, *starts):
            out = [(k, i, r, t) for k, h, p, s in zip(keys, pages_, platforms, starts[0] if starts else [None] * len(keys)) for i, (r, t) in enumerate(read_page(h, p, s))]
            return list(zip(*out)) or [()] * 4

        return run

    return map_lists(pages.select(key, html, platform, *([start] if start else [])), make, f"`{key}` {kind}, turn bigint, role string, text string")
