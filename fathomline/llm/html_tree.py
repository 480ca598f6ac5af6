"""A tolerant HTML reader: a tree of elements and the runs of text that belong to them."""

from __future__ import annotations

from html.parser import HTMLParser

# Element names by how they are read.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("head script style noscript template svg math iframe object select textarea button canvas video audio map datalist title".split())
CLOSES_P = BLOCKS - frozenset("html body td th tr tbody thead tfoot caption legend optgroup".split())
# An open element of the first kind ends where one of the second starts, up to an element of the third.
IMPLIED = (
    (frozenset(["li"]), frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    (frozenset(["dd", "dt"]), frozenset(["dd", "dt"]), frozenset(["dl"])),
    (frozenset(["td", "th"]), frozenset(["td", "th", "tr", "tbody", "thead", "tfoot"]), frozenset(["table"])),
    (frozenset(["tr"]), frozenset(["tr", "tbody", "thead", "tfoot"]), frozenset(["table"])),
    (frozenset(["tbody", "thead", "tfoot"]), frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])),
)
SCOPE = frozenset(["table", "td", "th", "caption", "html", "button", "object"])


class Tree(HTMLParser):
    """``parent``, ``tag``, ``attrs`` by node (node 0 is the page), and ``runs`` of (block, node, in a link, text)."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.attrs = [-1], ["#page"], [{}]
        self.runs: list[tuple[int, int, bool, str]] = []
        self.open: list[tuple[str, int]] = [("#page", 0)]  # the element and the node its text belongs to
        self.block, self.skipping, self.links = 0, 0, 0
        self.feed(html)
        self.close()

    def _pop(self, to: int) -> None:
        while len(self.open) > to:
            name, _ = self.open.pop()
            self.links -= name == "a"
            self.skipping -= name in SKIPPED
            self.block += name in BLOCKS

    def _close(self, names: frozenset[str], until: frozenset[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] in names:
                self._pop(i)
                return
            if self.open[i][0] in until:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.skipping and tag != "body":
            if tag in SKIPPED and tag not in VOID and tag not in ("script", "style"):
                self.open.append((tag, self.open[-1][1]))
                self.skipping += 1
            return
        if tag == "body":  # a head that wasn't closed ends here
            self._close(frozenset(["head"]), frozenset())
            if self.skipping:
                return
        if tag in CLOSES_P:
            self._close(frozenset(["p"]), SCOPE)
        for ends, starts, until in IMPLIED:
            if tag in starts:
                self._close(ends, until)
        self.block += tag in BLOCKS
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            return
        node = self.open[-1][1]
        found = {k: (v or "") for k, v in attrs}
        if (tag in BLOCKS or "class" in found or "id" in found or "role" in found) and tag not in SKIPPED:
            self.parent.append(node)
            self.tag.append(tag)
            self.attrs.append(found)
            node = len(self.tag) - 1
        self.open.append((tag, node))
        self.links += tag == "a"
        self.skipping += tag in SKIPPED

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math") or (tag in SKIPPED and self.open[-1][0] == tag and tag not in ("script", "style", "title", "textarea")):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                self._pop(i)
                return
            if self.open[i][0] in ("td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html", "article", "main"):
                return

    def handle_data(self, data: str) -> None:
        if not self.skipping and data:
            self.runs.append((self.block, self.open[-1][1], self.links > 0, data))


def blocks_of(runs: list[tuple[int, int, bool, str]], wanted) -> str:
    """Text of the runs whose node is wanted: white space to one space in a block, a line feed between blocks."""
    out: list[str] = []
    at, held = None, []
    for block, node, _, text in [*runs, (None, 0, False, "")]:
        if block != at:
            joined = " ".join("".join(held).split())
            if joined:
                out.append(joined)
            at, held = block, []
        if block is not None and wanted[node]:
            held.append(text)
    return "\n".join(out)
