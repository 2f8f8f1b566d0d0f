"""HTML extraction by layout-aware rendering.

A small tree builder turns markup into elements, with the end tags that HTML lets authors leave out;
visibility rules drop what a browser doesn't show; a renderer emits all visible text: blocks on lines
of their own, paragraphs set apart by an empty line, list items marked and indented, table cells padded
to columns, preformatted text as it is.

Visibility: `hidden` attributes, closed details and dialogs, and the properties display and visibility of style attributes and of style
elements count; of style sheets, rules whose selectors are names, classes and ids, of one element or of a descendant or child of others, outside of @-blocks, or in @media blocks for all
or screen, by specificity and order. Other selectors and linked sheets are passed over. Text inside an element with visibility hidden
is shown again where a descendant says visible. Fallbacks of audio, video, canvas, iframe, noscript and object are not
shown, as in a browser with scripts; text in svg and math is. Buttons and text fields show their values.

Cells are padded up to CELL characters, so that one long cell doesn't push the others out; wider ones run over.

Defined results: null html gives null text, markup without visible text gives ''; markup is never refused
(stray end tags are ignored, open elements end with the page); elements nested deeper than DEPTH go into their
ancestor at that depth; repeated rows are alike; an empty table gives an empty table; further columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folioflow.llm.common import small_batches, tidy

DEPTH = 256
CELL = 80

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Raw elements whose character references count.
ESCAPABLE = frozenset(["textarea", "title"])
HIDDEN = frozenset("head script style template title noscript iframe noembed noframes datalist object audio video canvas area base link meta param source track rp desc metadata annotation annotation-xml".split())
FIELDS = frozenset(["", "text", "search", "tel", "url", "email", "number", "date", "time", "month", "week", "datetime-local", "submit", "reset", "button"])
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre search section summary table ul caption tr td th thead tbody tfoot listing xmp".split()
)
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl dir menu table blockquote pre figure listing xmp".split())
CLOSES_P = BLOCK - frozenset("body html caption tr td th thead tbody tfoot legend".split())
#: Start tag -> (open elements that it ends, elements that it doesn't look beyond).
_LIST, _TABLE = frozenset("ul ol menu dir".split()), frozenset(["table"])
IMPLIED = (
    {"li": (frozenset(["li"]), _LIST), "option": (frozenset(["option"]), frozenset(["select"])), "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"]))}
    | dict.fromkeys(["dt", "dd"], (frozenset(["dt", "dd"]), frozenset(["dl"])))
    | dict.fromkeys(["td", "th"], (frozenset(["td", "th"]), _TABLE | {"tr"}))
    | {"tr": (frozenset(["tr", "td", "th", "caption"]), _TABLE)}
    | dict.fromkeys(["thead", "tbody", "tfoot"], (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), _TABLE))
)
_ROWS = frozenset("table thead tbody tfoot tr".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
_PROPERTY = re.compile(r"(?:^|[;\s])(display|visibility)\s*:\s*([a-z-]+)\s*(!important)?", re.I)
_SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)\Z")
_SPACES = re.compile(r"[ \t\n\f\r]+")


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []


def parse(html: str) -> Element:
    """The tree of a page; text is str, everything else an Element."""
    root = Element("html", {})
    stack, at = [root], 0

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(unescape(s) if "&" in s else s)

    def end(closed: frozenset, until: frozenset) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in until:
                return
            if stack[k].tag in closed:
                last = k
                while last > 1 and stack[last - 1].tag in closed:
                    last -= 1
                del stack[last:]
                return

    while m := _TOKEN.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag or stack[k].tag == "table" and tag != "table"), 0)
            if k and stack[k].tag == tag:
                del stack[k:]
            continue
        attrs = {a[0].lower(): unescape(a[1] or a[2] or a[3]) for a in _ATTR.findall(m[3])} if m[3] else {}
        if tag in ("html", "body"):
            root.attrs |= attrs
            continue
        if tag in CLOSES_P:
            end(frozenset(["p"]), frozenset(["table", "td", "th", "caption", "button", "object"]))
        if tag in IMPLIED:
            end(*IMPLIED[tag])
        if tag != "head" and stack[-1].tag == "head" and tag not in HIDDEN:
            stack.pop()  # content begins where head can't go on
        node = Element(tag, attrs)
        stack[-1].children.append(node)
        if tag == "form" and stack[-1].tag in _ROWS:
            continue  # a form between rows or cells holds nothing
        if tag in RAW:
            e = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            raw = html[at : e.start() if e else len(html)]
            node.children.append(unescape(raw) if tag in ESCAPABLE else raw)
            at = e.end() if e else len(html)
        elif tag not in VOID and tag != "colgroup" and len(stack) < DEPTH:
            stack.append(node)
    text(html[at:])
    return root


def properties(style: str) -> dict:
    """display and visibility of a block of declarations: {name: (important, value)}."""
    found: dict = {}
    for name, value, mark in _PROPERTY.findall(style):
        if mark or not found.get(name.lower(), (False,))[0]:
            found[name.lower()] = bool(mark), value.lower()
    return found


def sheet_blocks(css: str) -> Iterator[tuple[str, str]]:
    """(what stands before, what stands inside) of each outermost pair of braces."""
    depth = start = inside = 0
    before = ""
    for m in re.finditer(r"[{};]", css):
        if m[0] == "{":
            if not depth:
                before, inside = css[start : m.start()].strip(), m.end()
            depth += 1
        elif m[0] == "}":
            depth = max(0, depth - 1)
            if not depth:
                yield before, css[inside : m.start()]
                before, start, inside = "", m.end(), m.end()
        elif not depth:
            start = m.end()
    if depth:
        yield before, css[inside:]


def selector(text: str) -> tuple[list, tuple] | None:
    """([(combinator before it, name, classes, ids), ...], specificity) of a selector of descendants and children; None for other kinds."""
    found, before = [], ""
    for part in text.replace(">", " > ").split():
        if part == ">":
            if before or not found:
                return None
            before = ">"
            continue
        m = _SELECTOR.match(part)
        if not m:
            return None
        marks = re.findall(r"([.#])([\w-]+)", m[2])
        found.append((before, (m[1] or "*").lower(), {x for k, x in marks if k == "."}, {x for k, x in marks if k == "#"}))
        before = ""
    if before or not found:
        return None
    return found, (sum(len(f[3]) for f in found), sum(len(f[2]) for f in found), sum(f[1] != "*" for f in found))


def fits(part: tuple, place: tuple) -> bool:
    """Whether an element (name, classes, id) is what one part of a selector asks for."""
    _, name, classes, ids = part
    return name in ("*", place[0]) and classes <= place[1] and (not ids or ids == {place[2]})


def selects(parts: list, path: list) -> bool:
    """Whether a selector selects the last element of a path from the root."""
    if not fits(parts[-1], path[-1]):
        return False
    ends = [len(path) - 1]  # where the part to the right may stand
    for k in range(len(parts) - 2, -1, -1):
        if parts[k + 1][0] == ">":
            ends = [i - 1 for i in ends if i and fits(parts[k], path[i - 1])]
        else:
            ends = [i for i in range(max(ends)) if fits(parts[k], path[i])]
        if not ends:
            return False
    return True


def sheet_rules(css: str, rules: list) -> None:
    """Appends (parts of the selector, specificity, properties) of a sheet's rules about visibility."""
    for before, inside in sheet_blocks(re.sub(r"/\*.*?(?:\*/|\Z)", " ", css, flags=re.S)):
        if before.startswith("@"):
            if re.fullmatch(r"@media\s*(?:only\s+)?(?:all|screen)?", before, re.I):
                sheet_rules(inside, rules)
            continue
        found = properties(inside)
        for one in before.split(",") if found else ():
            s = selector(one)
            if s:
                rules.append((*s, found))


def shown(node: Element, rules: list, seen: bool = True, path: list | None = None) -> None:
    """Takes what style rules hide out of the tree: elements that aren't displayed, and strings that aren't visible. path: the node and what it is in, as selectors see them."""
    kept, path = [], path if path is not None else []
    for child in node.children:
        if isinstance(child, str):
            if seen:
                kept.append(child)
            continue
        a, own = child.attrs, {}
        if rules:
            path.append((child.tag, set(a.get("class", "").split()), a.get("id")))
            for parts, weight, found in rules:
                if selects(parts, path):
                    for k, (important, value) in found.items():
                        if (important, weight) >= own.get(k, ((False, (-1,)),))[0]:
                            own[k] = (important, weight), value
        for k, (important, value) in properties(a["style"]).items() if "style" in a else ():
            if important or not own.get(k, ((False,),))[0][0]:
                own[k] = (True,), value
        display = own["display"][1] if "display" in own else "none" if "hidden" in a else ""
        if display != "none":
            visibility = own["visibility"][1] if "visibility" in own else ""
            inside = True if visibility == "visible" else False if visibility in ("hidden", "collapse") else seen
            if child.tag == "html" and rules:
                path.append(("body", *path[-1][1:]))  # the root stands for both
            shown(child, rules, inside, path)
            if child.tag == "html" and rules:
                path.pop()
            if not inside:
                child.attrs = {k: v for k, v in a.items() if k != "value"}
                child.attrs["hidden-mark"] = ""
            kept.append(child)
        if rules:
            path.pop()
    node.children = kept


def visible(node: Element) -> bool:
    return node.tag not in HIDDEN and not (node.tag == "dialog" and "open" not in node.attrs)


class Page:
    """Lines of rendered text. An inline run is gathered until a block edge ends it."""

    def __init__(self):
        self.lines: list[str] = []
        self.run: list[str] = []
        self.indent, self.mark, self.apart = "", "", False

    def put(self, line: str) -> None:
        if self.apart and self.lines:
            self.lines.append("")
        self.apart = False
        self.lines.append((self.indent[: len(self.indent) - len(self.mark)] + self.mark + line).rstrip() if self.mark else (self.indent + line).rstrip())
        self.mark = ""

    def edge(self, apart: bool = False) -> None:
        if self.run:
            for line in "".join(self.run).split("\0"):  # \0 stands for br
                line = _SPACES.sub(" ", line).strip(" ")
                if line:
                    self.put(line)
            self.run = []
        self.apart = self.apart or apart

    def children(self, node: Element) -> None:
        for child in node.children:
            if isinstance(child, str):
                self.run.append(child.replace("\0", ""))
            elif visible(child):
                self.element(child)

    def element(self, node: Element) -> None:
        tag = node.tag
        if tag == "br":
            self.run.append("\0")
        elif tag == "wbr" or tag in VOID and tag != "hr":
            kind = node.attrs.get("type", "").lower()
            if tag == "input" and kind in FIELDS and "hidden-mark" not in node.attrs:
                self.run.append(f" {node.attrs.get('value', {'submit': 'Submit', 'reset': 'Reset'}.get(kind, ''))} ")
        elif tag == "select":
            options = [o for o in _descend(node, "option")]
            for o in [o for o in options if "selected" in o.attrs] or options[:1]:
                self.run.append(" ")
                self.children(o)
            self.run.append(" ")
        elif tag == "table":
            self.edge(True)
            self.table(node)
            self.edge(True)
        elif tag in ("pre", "listing", "xmp", "textarea"):
            self.edge(True)
            for line in _plain(node).strip("\n").split("\n"):
                self.put(line.replace("\r", ""))
            self.edge(True)
        elif tag in BLOCK:
            self.block(node)
        else:
            self.children(node)

    def block(self, node: Element) -> None:
        tag, before = node.tag, self.indent
        nested = tag in _LIST and before
        self.edge(tag in APART and not nested)
        if tag == "details" and "open" not in node.attrs:
            for s in [c for c in node.children if isinstance(c, Element) and c.tag == "summary"][:1]:
                self.children(s)
        elif tag in _LIST:
            number = int(node.attrs["start"]) if re.fullmatch(r"-?\d{1,9}", node.attrs.get("start", "")) else 1
            for child in node.children:
                if isinstance(child, Element) and child.tag == "li":
                    if visible(child):
                        mark = f"{number}. " if tag == "ol" else "- "
                        number += 1
                        self.edge()
                        self.indent, self.mark = before + " " * len(mark), mark
                        self.children(child)
                        self.edge()
                        self.indent, self.mark = before, ""
                elif isinstance(child, str):
                    self.run.append(child)
                elif visible(child):
                    self.element(child)
        else:
            if tag in ("dd", "blockquote"):
                self.indent = before + "  "
            self.children(node)
        self.edge()
        self.indent = before
        self.edge(tag in APART and not nested)

    def table(self, node: Element) -> None:
        rows: list[list[tuple[int, list[str]]]] = []
        spans: dict[int, int] = {}  # column -> rows that a cell above still takes
        widths: dict[int, int] = {}
        for part in _table_rows(node):
            if part.tag != "tr":
                page = Page()
                page.children(part)
                page.edge()
                for line in page.lines:
                    self.put(line)
                continue
            row, col = [], 0
            taken = dict(spans)
            spans = {c: n - 1 for c, n in spans.items() if n > 1}
            for cell in part.children:
                if not isinstance(cell, Element) or cell.tag not in ("td", "th") or not visible(cell):
                    continue
                while col in taken:
                    col += 1
                page = Page()
                page.children(cell)
                page.edge()
                wide, high = _span(cell, "colspan", 1000), _span(cell, "rowspan", 1000)
                if wide == 1:
                    widths[col] = max(widths.get(col, 0), min(CELL, max(map(len, page.lines), default=0)))
                row.append((col, page.lines))
                for c in range(col, col + wide) if high > 1 else ():
                    spans[c] = high - 1
                col += wide
            rows.append(row)
        starts, place = {}, 0  # a column's place: after all columns before it in which cells begin
        for col in sorted({c for row in rows for c, _ in row}):
            starts[col] = place
            place += widths.get(col, 0) + 2
        for row in rows:
            for k in range(max((len(lines) for _, lines in row), default=0)):
                out = ""
                for col, lines in row:
                    out = out.ljust(starts[col]) if len(out) <= starts[col] else out + "  "
                    out += lines[k] if k < len(lines) else ""
                if out.strip():
                    self.put(out)


def _span(cell: Element, name: str, most: int) -> int:
    v = cell.attrs.get(name, "1").strip()
    return min(most, max(1, int(v))) if v.isascii() and v.isdigit() and len(v) < 9 else 1


def _table_rows(table: Element) -> Iterator[Element]:
    """Rows of a table in the order shown (head, bodies, foot); caption and other content first."""
    parts = {"thead": [], "": [], "tfoot": []}
    loose: list[Element] = []

    def stray(children: list) -> None:
        """What stands between rows or cells goes before the table; inline pieces next to each other are one run."""
        kept = [c for c in children if not isinstance(c, str) and visible(c) or isinstance(c, str) and c.strip()]
        if kept:
            loose.append(Element("caption", {}))
            loose[-1].children += kept

    def row(tr: Element) -> Element:
        """The row with its cells only."""
        out = Element("tr", tr.attrs)
        for cell, group in groupby(tr.children, lambda c: isinstance(c, Element) and c.tag in ("td", "th")):
            if cell:
                out.children += group
            else:
                stray([*group])
        return out

    def rows(children: list) -> Iterator[tuple[str, Element]]:
        held: list = []
        for child in children:
            if isinstance(child, Element) and child.tag in ("tr", "td", "th", "thead", "tbody", "tfoot", "col", "colgroup"):
                stray(held)
                held = []
                if not visible(child) or child.tag in ("col", "colgroup"):
                    continue
                if child.tag in ("td", "th"):
                    alone = Element("tr", {})
                    alone.children.append(child)
                    yield "", alone
                elif child.tag == "tr":
                    yield "", row(child)
                else:
                    for _, r in rows(child.children):
                        yield child.tag if child.tag != "tbody" else "", r
            else:
                held.append(child)
        stray(held)

    for part, r in rows(table.children):
        parts[part].append(r)
    yield from loose
    yield from (*parts["thead"], *parts[""], *parts["tfoot"])


def _descend(node: Element, tag: str) -> Iterator[Element]:
    for c in node.children:
        if isinstance(c, Element):
            if c.tag == tag:
                yield c
            else:
                yield from _descend(c, tag)


def _plain(node: Element) -> str:
    return "".join(c if isinstance(c, str) else "\n" if c.tag == "br" else _plain(c) if visible(c) else "" for c in node.children)


def render(html: str | None) -> str | None:
    """All visible text of a page."""
    if html is None:
        return None
    root, page, rules = parse(html), Page(), []
    for style in _descend(root, "style"):
        sheet_rules("".join(c for c in style.children if isinstance(c, str)), rules)
    whole = Element("", {})
    whole.children.append(root)
    shown(whole, rules)
    if whole.children:
        page.children(root)
        page.edge()
    return "\n".join(page.lines)


def extract_text(pages: DataFrame, keep: list[str], html_col: str = "html", text_col: str = "text") -> DataFrame:
    """keep columns of pages with the rendered text."""
    keep = [c for c in keep if c != text_col]
    small_batches(pages.sparkSession)
    source = pages.select(*keep, pages[html_col].alias("_html"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[keep].copy()
            out[text_col] = pd.Series([render(h) if isinstance(h, str) else None for h in batch["_html"]], index=out.index, dtype=object)
            yield out

    return source.mapInPandas(tidy(work), T.StructType([f for f in source.schema.fields if f.name != "_html"] + [T.StructField(text_col, T.StringType())]))
