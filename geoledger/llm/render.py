"""Layout-aware rendering of HTML: all visible text, with block spacing, lists and aligned table cells.

`Tree` builds the element tree from the tags as a browser would: end tags that authors leave out are implied, void
elements hold nothing, stray end tags are ignored. `Layout` walks the tree and writes lines. Hidden parts (head,
scripts, styles, templates, comments, the `hidden` attribute, `display:none`, `visibility:hidden`, closed `details`
beyond their summary, titles and definitions of drawings, notes of formulas) give nothing. Formulas, texts of drawings,
text areas and what a select shows are visible. Blocks start lines, paragraphs and headings stand apart by a blank line, list
items have bullets or numbers and are indented by depth, table columns are padded to equal width, `pre` keeps its
spaces and `br` breaks lines.

Pages are rendered row by row in Arrow batches; nothing is shuffled, and memory is bounded by a batch and a page.

Defined cases. Null and empty pages give an empty text. Pages without tags are text. Every element is opened, however
deep: open elements are found by kind, and the steps of the layout that wait for inner ones are kept on a stack of their
own. Indents are written out, so d nested lists with a text each give d * d spaces. Repeated rows get equal texts. Only
key and page are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Generator, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript title iframe object audio video canvas datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl table pre blockquote figure hr".split())
# In drawings text shows in these only, and not in what only describes or defines; in formulas all but notes shows.
SVG_TEXT = frozenset("text foreignobject".split())
SVG_UNSEEN = frozenset("title desc metadata defs symbol clippath mask pattern marker filter lineargradient radialgradient style script".split())
MATH_UNSEEN = frozenset("annotation annotation-xml mphantom".split())
MATH_PARTED = frozenset("mfrac mroot msub msup msubsup munder mover munderover mtr mlabeledtr mtable".split())
# HTML goes on inside these; elsewhere in a drawing or formula, a start tag of BREAKS ends it.
FOREIGN = frozenset("svg math".split())
HTML_WITHIN = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
BREAKS = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s"
    " small span strong strike sub sup table tt u ul var".split())
# A start tag ends open elements of these kinds, up to the nearest element that bounds it.
P_ENDS = BLOCK - frozenset("body html li dd dt option optgroup summary legend".split())
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
SCOPE = frozenset("html table td th caption button object template".split())
HEAD_ONLY = frozenset("base link meta noscript script style template title head html".split())

_SPACE = re.compile(r"[ \t\n\r\f]+")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.IGNORECASE)


class Element:
    __slots__ = ("children", "given", "hidden", "kind", "start")

    def __init__(self, kind: str, hidden: bool = False, start: int = 1, given: dict | None = None):
        self.kind, self.hidden, self.start, self.given, self.children = kind, hidden, start, given or {}, []


class Tree(HTMLParser):
    """Element tree of a page."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.root = Element("html")
        self.open = [self.root]
        # places in `open` by kind, ascending; the root is in none
        self.places: dict[str, list[int]] = defaultdict(list)
        self.feed(page)
        self.close()

    def _push(self, element: Element) -> None:
        self.places[element.kind].append(len(self.open))
        self.open.append(element)

    def _cut(self, end: int) -> None:
        """End all open elements from this place on."""
        while len(self.open) > end:
            self.places[self.open.pop().kind].pop()

    def _end_open(self, kinds: set[str] | frozenset, bounds: set[str] | frozenset, all_: bool = False) -> None:
        """End the innermost open element of these kinds, or all of them, within the nearest bound."""
        found = [p for k in kinds if (p := self.places.get(k))]
        if not found:
            return
        bound = max((p[-1] for k in bounds if (p := self.places.get(k))), default=1)
        within = [p[bisect_left(p, bound)] if all_ else p[-1] for p in found if p[-1] >= bound]
        if within:
            self._cut(min(within) if all_ else max(within))

    def _last(self, kinds: frozenset) -> int:
        return max((p[-1] for k in kinds if (p := self.places.get(k))), default=0)

    def _foreign(self) -> str:
        """`svg` or `math` where the next element is one of these languages, else empty."""
        if not self.places["svg"] and not self.places["math"]:
            return ""
        at = self._last(FOREIGN)
        return self.open[at].kind if at > self._last(HTML_WITHIN) else ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.places.get("textarea"):
            self.open[-1].children.append(self.get_starttag_text())
            return
        if tag in BREAKS and self._foreign():
            self._end_open(FOREIGN, HTML_WITHIN, all_=True)
        if tag in ("input", "select", "textarea"):
            self._end_open({"select"}, SCOPE)
        if tag == "html" or tag == "body" and self.places["body"]:
            return
        if self.open[-1].kind == "head" and tag not in HEAD_ONLY:
            self._cut(len(self.open) - 1)
        if tag in P_ENDS:
            self._end_open({"p"}, SCOPE)
        if tag in IMPLIED:
            kinds, bounds = IMPLIED[tag]
            self._end_open(kinds, bounds, all_=True)
        given = dict(attrs)
        hidden = (tag in HIDDEN or "hidden" in given and given["hidden"] != "until-found" or bool(_UNSEEN.search(given.get("style") or ""))
                  or tag == "input" or tag == "dialog" and "open" not in given)
        language = self._foreign()
        if language:
            hidden = hidden or tag in (SVG_UNSEEN if language == "svg" else MATH_UNSEEN)
        start = given.get("start") or given.get("value") or ""
        element = Element("closed" if tag == "details" and "open" not in given else tag, hidden,
                          int(start) if start.lstrip("-").isdecimal() and len(start) < 10 else 1,
                          given if tag in ("select", "option", "optgroup") else {"svg": ""} if tag == "text" and language == "svg" else None)
        if tag == "li" and "value" in given and element.start != 1:
            element.start = -abs(element.start) if element.start < 0 else element.start
        self.open[-1].children.append(element)
        if tag not in VOID:
            self._push(element)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        # drawings and formulas alone have elements that this form ends
        ends = (tag in FOREIGN or tag not in BREAKS and self._foreign()) and not self.places.get("textarea")
        self.handle_starttag(tag, attrs)
        if ends and self.open[-1].kind == tag:
            self._cut(len(self.open) - 1)

    def handle_comment(self, data: str) -> None:
        if self.places.get("textarea"):
            self.open[-1].children.append(f"<!--{data}-->")

    def handle_endtag(self, tag: str) -> None:
        if self.places.get("textarea") and tag != "textarea":
            self.open[-1].children.append(f"</{tag}>")
            return
        if tag == "br":
            self.open[-1].children.append(Element("br"))
        elif tag == "p" and not self.places["p"]:
            self.open[-1].children.append(Element("p"))
        elif tag not in VOID and tag not in ("body", "html"):
            self._end_open({tag, "closed"} if tag == "details" else {tag}, set() if tag in BLOCK or tag in SCOPE else SCOPE - {"html"})

    def handle_data(self, data: str) -> None:
        if self.open[-1].kind == "head" and data.strip():
            self._cut(len(self.open) - 1)
        if (drawings := self.places.get("svg")) and self._last(SVG_TEXT) < drawings[-1]:
            return
        self.open[-1].children.append(data)


def shown_text(element: Element) -> str:
    """Text of an element on one line."""
    parts, rest = [], [element]
    while rest:
        now = rest.pop()
        if isinstance(now, str):
            parts.append(now)
        elif not now.hidden or now is element:
            rest.extend(reversed(now.children))
    return _SPACE.sub(" ", "".join(parts)).strip()


def choices(select: Element) -> list[str]:
    """What a select shows: the chosen option of a drop-down, else its first; all options of a list, and their groups."""
    size = select.given.get("size") or ""
    whole = "multiple" in select.given or size.isdecimal() and len(size) < 10 and int(size) > 1
    out, chosen, rest = [], None, [(select, False)]
    while rest:
        now, off = rest.pop()
        if isinstance(now, str) or now.hidden and (now.kind != "option" or whole):
            continue
        if now.kind == "option":
            text = now.given.get("label") or shown_text(now)
            out.append(text)
            rank = 2 if "selected" in now.given else 1 if not (now.hidden or off or "disabled" in now.given) else 0
            # the last that is marked, else the first that can be chosen
            if rank == 2 or rank and chosen is None:
                chosen = text
            continue
        if now.kind == "optgroup":
            out.append((now.given.get("label") or "").strip())
            off = off or "disabled" in now.given
        rest.extend((c, off) for c in reversed(now.children))
    return [t for t in (out if whole else [chosen or ""]) if t]


# A step of the layout yields the steps it waits for, and is sent their results.
Step = Generator["Step", object, object]


def _run(step: Step) -> object:
    """Result of a step; the steps that wait are a list, so depth is bounded by memory only."""
    waiting, result = [step], None
    while waiting:
        try:
            inner = waiting[-1].send(result)
        except StopIteration as end:
            waiting.pop()
            result = end.value
        else:
            waiting.append(inner)
            result = None
    return result


class Layout:
    """Lines of the visible text of a tree."""

    def __init__(self):
        self.lines: list[str] = []
        self.line = ""
        self.gap = False
        self.indent = 0
        # indent and mark of the list item whose first line is to come
        self.marker: tuple[int, str] | None = None

    def text(self, data: str, pre: bool) -> None:
        if pre:
            first, *more = data.split("\n")
            self.line += first
            for part in more:
                self.end_line(keep=True)
                self.line = part
            return
        data = _SPACE.sub(" ", data)
        if not self.line or self.line.endswith(" "):
            data = data.lstrip(" ")
        self.line += data

    def end_line(self, keep: bool = False) -> None:
        line = self.line.rstrip(" ")
        if line or keep:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            indent, mark = self.marker or (self.indent, "")
            self.lines.append(" " * indent + mark + line if line else "")
            self.marker = None
        self.line = ""

    def block(self, apart: bool) -> None:
        self.end_line()
        self.gap = self.gap or apart

    def walk(self, element: Element, pre: bool = False, listed: bool = False) -> Step:
        number = element.start
        for child in element.children:
            if element.kind == "closed" and (isinstance(child, str) or child.kind != "summary"):
                continue
            if isinstance(child, str):
                self.text(child, pre)
                continue
            kind = child.kind
            if child.hidden:
                continue
            if kind == "select":
                shown = choices(child)
                if "multiple" in child.given or len(shown) > 1:
                    for text in shown:
                        self.block(False)
                        self.text(text, False)
                    self.block(False)
                else:
                    self.text("".join(f" {t} " for t in shown), False)
            elif kind == "textarea":
                text = "".join(c for c in child.children if isinstance(c, str)).replace("\r\n", "\n")
                self.block(False)
                self.text(text.removeprefix("\n"), True)
                self.block(False)
            elif kind in MATH_PARTED:
                for part in child.children:
                    inner = Element("math")
                    inner.children.append(part)
                    yield self.walk(inner, pre, listed)
                    self.text(" ", False)
            elif kind == "br":
                self.end_line(keep=True)
            elif kind == "table":
                self.block(True)
                for row in (yield rows_of(child)):
                    if self.gap and self.lines:
                        self.lines.append("")
                    self.gap = False
                    self.lines.append(" " * self.indent + row)
                self.block(True)
            elif kind == "li":
                self.end_line()
                before = self.indent
                mark = f"{number}. " if element.kind == "ol" else "- "
                number += 1
                self.marker, self.indent = (before, mark), before + len(mark)
                yield self.walk(child, pre, True)
                self.end_line()
                self.marker, self.indent = None, before
            elif kind in BLOCK or kind == "closed":
                nested = kind in ("ul", "ol", "menu") and listed
                apart = kind in APART and not nested
                # what opens an item stays on the line of its mark
                self.block(apart and not self.marker)
                before = self.indent
                if kind in ("blockquote", "dd"):
                    self.indent += 2
                yield self.walk(child, pre or kind == "pre", listed)
                self.block(apart)
                self.indent = before
            elif kind in ("td", "th", "tr", "caption", "mtd") or kind == "text" and child.given:
                yield self.walk(child, pre, listed)
                self.text(" ", False)
            else:
                yield self.walk(child, pre, listed)


def rendered(element: Element) -> Step:
    """Lines of an element."""
    layout = Layout()
    yield layout.walk(element)
    layout.end_line()
    while layout.lines and not layout.lines[-1]:
        layout.lines.pop()
    while layout.lines and not layout.lines[0]:
        layout.lines.pop(0)
    return layout.lines


def rows_of(table: Element) -> Step:
    """Lines of a table: cells of a column start at the same place, cells of several lines take several."""
    above: list[str] = []
    rows: list[list[list[str]]] = []

    def gather(element: Element) -> Step:
        for child in element.children:
            if isinstance(child, str):
                above.extend([_SPACE.sub(" ", child).strip()] if child.strip() else [])
            elif child.hidden:
                continue
            elif child.kind == "tr":
                stray = Element("td")
                cells = []
                for c in child.children:
                    if isinstance(c, str) or c.kind not in ("td", "th"):
                        stray.children.append(c)
                    elif not c.hidden:
                        cells.append((yield rendered(c)))
                extra = yield rendered(stray)
                rows.append(cells + ([extra] if extra else []))
            elif child.kind in ("thead", "tbody", "tfoot", "form"):
                yield gather(child)
            elif child.kind in ("td", "th"):
                rows.append([(yield rendered(child))])
            elif child.kind not in ("colgroup", "col"):
                above.extend((yield rendered(child)))

    yield gather(table)
    columns = max(map(len, rows), default=0)
    widths = [max((len(line) for r in rows if i < len(r) for line in r[i]), default=0) for i in range(columns)]
    out = [line for line in above if line]
    for cells in rows:
        for k in range(max(map(len, cells), default=0)):
            parts = [(c[k] if k < len(c) else "").ljust(w) for c, w in zip(cells, widths, strict=False)]
            out.append("  ".join(parts).rstrip())
    return out


def render(page: str | None) -> str:
    return "\n".join(_run(rendered(Tree(page).root))) if page else ""


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [render(p) for p in batch.column("page").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string())], names=["page_id", "text"])


def render_pages(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """(page_id, text) for every page."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(page).alias("page"))
    return rows.mapInArrow(_rendered, "page_id long, text string")
