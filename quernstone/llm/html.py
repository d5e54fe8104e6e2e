"""Layout-aware rendering of HTML to text.

A tokenizer and a tree builder (implied end tags, void and raw-text elements) give a
balanced sequence of start, text and end events; a renderer turns those that are visible
into lines.  Blocks start new lines, paragraphs and headings stand apart, list items keep
their marks and depth, preformatted text keeps its white space, and the cells of a table
are padded to the width of their column.

Not visible: head, script, style, template, noscript and other elements whose content
browsers do not show, anything with the hidden attribute or with display:none in its
style, what has visibility:hidden (or collapse) but for parts with visibility:visible,
and comments.  Of a select, the options marked as selected
are shown, and all of one that is drawn as a list (multiple, or a size over one).  Of svg,
the text elements are shown, of math all but its annotations.

Defined results: null stays null; an empty page is an empty text; unclosed and stray tags
are repaired; tags of any depth are handled without recursion; other columns are kept,
but a column named as the text's takes the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
UNSEEN = frozenset("head script style template noscript title iframe object audio video canvas datalist noembed noframes annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary ul".split()
)
APART = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 menu ol p pre table ul".split())
#: A start tag of the first kind ends an open element of the second, up to a fence.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "thead", "tbody", "tfoot", "caption"}, {"table"}), "tbody": ({"tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tr", "thead", "tbody", "tfoot", "caption"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
ENDS_P = BLOCK - {"html", "body", "li", "dd", "dt", "option", "optgroup", "legend"} | {"table"}
FENCE = frozenset({"table", "td", "th", "caption", "button", "html"})

_TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?|\"[^\"]*\"?|'[^']*'?")
_UNSHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*([a-z]+)", re.I)
_MAYBE = re.compile(r"hidden|style", re.I)
_NUMBER = re.compile(r"\s*([+-]?\d{1,9})")
#: Fixed values of the HTML standard: columns and rows that a cell can span.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
_SPACE = re.compile(r"[ \t\r\n\f]+")


def events(html: str) -> Iterator[tuple[str, str, str]]:
    """Balanced (kind, tag, text or attributes); kind is start, text or end."""
    open_: list[str] = []
    depths: dict[str, list[int]] = {}  # where each tag is open, so that no step walks a deep stack
    at = 0

    def push(tag: str) -> None:
        depths.setdefault(tag, []).append(len(open_))
        open_.append(tag)

    def pop() -> str:
        tag = open_.pop()
        depths[tag].pop()
        return tag

    def nearest(tags) -> int:
        """Depth of the innermost open element of these, -1 without one."""
        return max((depths[t][-1] for t in tags if depths.get(t)), default=-1)

    def close(tags, fence=FENCE) -> Iterator[tuple[str, str, str]]:
        """Ends the nearest open element of these, with all inside it, unless a fence comes first."""
        i = nearest(tags)
        if i >= 0 and i >= nearest(fence):
            while len(open_) > i:
                yield "end", pop(), ""

    while at < len(html):
        m = _TAG.search(html, at)
        if m is None:
            yield "text", "", html[at:]
            break
        if m.start() > at:
            yield "text", "", html[at : m.start()]
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not depths.get("p"):
                yield "start", "p", ""
                yield "end", "p", ""
            elif tag == "br":
                yield "start", "br", ""
                yield "end", "br", ""
            elif depths.get(tag):
                yield from close({tag}, frozenset({"table", "td", "th"}) - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot", "html", "body") else frozenset({"table"}) - {tag})
            continue
        if tag in ENDS_P:
            yield from close({"p"})
        if tag in CLOSES:
            tags, fence = CLOSES[tag]
            while nearest(tags) >= 0:
                held = len(open_)
                yield from close(tags, frozenset(fence))
                if len(open_) == held:
                    break
        if tag in ("td", "th") and nearest(("tr",)) < nearest(("table",)):
            push("tr")
            yield "start", "tr", ""
        yield "start", tag, m[3]
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "path"):
            yield "end", tag, ""
            continue
        push(tag)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(html, at)
            stop = end.start() if end else len(html)
            if stop > at:
                yield "text", tag, html[at:stop]
            at = end.end() if end else len(html)
            pop()
            yield "end", tag, ""
    while open_:
        yield "end", pop(), ""


def attributes(more: str) -> dict[str, str]:
    """Names, in lower case, and values of a start tag's attributes; the first of a name counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(more):
        if m[1]:
            out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def _hidden(named: dict[str, str]) -> bool:
    return "hidden" in named or bool(_UNSHOWN.search(named.get("style", "")))


def _number(named: dict[str, str], name: str) -> int | None:
    found = _NUMBER.match(named.get(name, ""))
    return int(found[1]) if found else None


def _is_list(more: str) -> bool:
    """Whether a select shows all its options."""
    named = attributes(more)
    size = named.get("size", "").strip()
    return "multiple" in named or size.isdecimal() and int(size) > 1


class Writer:
    """Lines of text; breaks are held back until text follows."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []  # of the line that is being written
        self.blank = True
        self.gap = 0
        self.mark = ""
        self.depth = 0

    def put(self, text: str) -> None:
        if text:
            self.parts.append(text)
            self.blank = self.blank and not text.strip()

    def take(self) -> str:
        """The line so far, without white space at its end; the next one begins empty."""
        line = "".join(self.parts).rstrip()
        self.parts, self.blank = [], True
        return line

    def end_line(self) -> None:
        keep = not self.blank or self.mark and self.parts
        line = self.take()
        if keep:
            self.lines.append(line)

    def leave(self, gap: int) -> None:
        """The next text starts a new line (1) or stands apart from this (2)."""
        self.end_line()
        self.gap = max(self.gap, gap)

    def begin(self) -> None:
        if not self.parts:
            if self.gap > 1 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = 0
            self.put(self.mark or "  " * self.depth)
            self.mark = ""

    def text(self, text: str) -> None:
        text = _SPACE.sub(" ", text)
        if self.blank and not self.mark.strip() or self._spaced():
            text = text.lstrip(" ")
        if text and (text != " " or self.parts):
            self.begin()
            self.put(text.lstrip(" ") if self._spaced() else text)

    def _spaced(self) -> bool:
        return bool(self.parts) and self.parts[-1].endswith(" ")

    def verbatim(self, text: str) -> None:
        for i, part in enumerate(text.expandtabs(8).split("\n")):
            if i:
                self.lines.append(self.take())
            if part:
                self.begin()
                self.put(part)

    def rows(self, rows: list[list[tuple[list[str], int, int]]]) -> None:
        """Cells (lines, columns, rows) of a table, each padded to the width of its column; an empty row is left out."""
        self.leave(2)
        placed: list[list[tuple[int, list[str], int]]] = []
        covered: dict[int, int] = {}  # by column, the rows that a cell from above still takes up
        for row in rows:
            cells, at, fresh = [], 0, {}
            for lines, span, deep in row:
                while covered.get(at):
                    at += 1
                cells.append((at, lines, span))
                if deep > 1:
                    fresh |= dict.fromkeys(range(at, at + span), deep - 1)
                at += span
            placed.append(cells)
            covered = {c: n - 1 for c, n in covered.items() if n > 1} | fresh
        width = {at: 0 for cells in placed for at, _, _ in cells}  # of the columns in which a cell begins
        for cells in placed:
            for at, lines, span in cells:
                if span == 1:
                    width[at] = max(width[at], *map(len, lines or [""]))
        columns = sorted(width)
        for cells in placed:
            for at, lines, span in cells:
                own = columns[bisect_left(columns, at) : bisect_left(columns, at + span)]
                lacks = max(map(len, lines or [""])) - sum(width[c] for c in own) - 2 * (len(own) - 1)
                if span > 1 and lacks > 0 and own[-1] != columns[-1]:
                    width[own[-1]] += lacks
        begin, x = {}, 0
        for c in columns:
            begin[c] = x
            x += width[c] + 2
        for cells in placed:
            for k in range(max((len(lines) for _, lines, _ in cells), default=0)):
                out = ""
                for at, lines, _ in cells:
                    out = out.ljust(begin[at]) + (lines[k] if k < len(lines) else "")
                if out.strip():
                    self.take()
                    self.begin()
                    self.put(out)
                    self.lines.append(self.take())
        self.leave(2)

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def render(html: str | None) -> str | None:
    """All visible text of a page."""
    if html is None:
        return None
    out = Writer()
    writers: list[Writer] = []
    tables: list[list[list[tuple[list[str], int, int]]]] = []
    lists: list[list] = []
    spans: list[tuple[int, int]] = []
    hidden = pre = depth = 0
    veils: list[tuple[int, bool]] = []  # open elements that set a visibility: their depth, and whether it hides
    selects: list[bool] = []  # of the open ones, whether all options show
    drawn: list[str] = []  # open svg elements, and those in them that hold text
    for kind, tag, more in events(html):
        if hidden:
            hidden += (kind == "start") - (kind == "end")
            continue
        depth += (kind == "start") - (kind == "end")
        if veils and kind == "end" and veils[-1][0] > depth:
            veils.pop()
        if kind == "text":
            if veils and veils[-1][1]:
                continue
            if drawn and drawn[-1] == "svg":
                continue  # white space and text beside the drawn text
            text = unescape(more) if tag in ("", "textarea") else more
            if pre:
                out.verbatim(text)
            elif not tables or writers and len(writers) == len(tables):
                out.text(text)
            elif text.strip():  # text of a table outside its cells comes before the table
                out.text(text)
            continue
        if kind == "start":
            named = attributes(more) if more and (tag in ("td", "th", "ol", "li", "option") or _MAYBE.search(more)) else {}
            unseen = tag in UNSEEN or drawn and tag in ("desc", "defs", "metadata") or named and _hidden(named)
            if unseen or selects and tag == "option" and not selects[-1] and "selected" not in named:
                hidden, depth = 1, depth - 1
                continue
            if seen := _VISIBILITY.search(named.get("style", "")):
                veils.append((depth, seen[1].lower() in ("hidden", "collapse")))
            if tag == "select":
                selects.append(_is_list(more))
            elif tag == "svg" or drawn and tag in ("text", "foreignobject"):
                drawn.append(tag)
                if tag != "svg":
                    out.leave(1)
            if tag == "br":
                out.begin()
                out.lines.append(out.take())
            elif tag == "hr":
                out.leave(2)
            elif tag == "table":
                out.leave(2)
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                writers.append(out)
                if not tables[-1]:
                    tables[-1].append([])
                deep = _number(named, "rowspan")  # of zero: down to the table's end
                spans.append((min(MOST_COLUMNS, max(1, _number(named, "colspan") or 1)), MOST_ROWS if deep == 0 else min(MOST_ROWS, max(1, deep or 1))))
                out = Writer()
            elif tag in BLOCK or tag in ("tr", "caption"):
                out.leave(2 if tag in APART and not (tag in ("ul", "ol", "menu") and lists) else 1)
                if tag in ("ul", "ol", "menu"):
                    begin = _number(named, "start")
                    lists.append([tag, 1 if begin is None else begin])
                    out.depth += len(lists) > 1
                elif tag == "li":
                    mark = "- "
                    if lists and lists[-1][0] == "ol":
                        own = _number(named, "value")
                        lists[-1][1] = lists[-1][1] if own is None else own
                        mark = f"{lists[-1][1]}. "
                        lists[-1][1] += 1
                    out.mark = "  " * out.depth + mark
                elif tag == "dd":
                    out.mark = "  " * (out.depth + 1)
                elif tag == "pre":
                    pre += 1
            continue
        if tag == "select" and selects:
            selects.pop()
        elif drawn and tag == drawn[-1]:
            drawn.pop()
            if tag != "svg":
                out.leave(1)
        elif tag == "table" and tables:
            out.rows(tables.pop())
        elif tag in ("td", "th") and tables and writers:
            lines = out.done()
            out = writers.pop()
            tables[-1][-1].append((lines, *spans.pop()))
        elif tag == "pre":
            pre = max(0, pre - 1)
            out.leave(2)
        elif tag in BLOCK or tag in ("tr", "caption"):
            if tag in ("ul", "ol", "menu") and lists:
                lists.pop()
                out.depth -= bool(lists) and out.depth > 0
            out.leave(2 if tag in APART and not (tag in ("ul", "ol", "menu") and lists) else 1)
            out.mark = "" if tag in ("li", "dd") else out.mark
    return "\n".join(out.done())


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the visible text of its HTML."""
    return pages.withColumn(text, visible_text(F.col(html)))


def visible_text(html: Column | str) -> Column:
    @F.pandas_udf("string")
    def html_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                yield pd.Series([render(x) for x in batch.iloc[at : at + 256]], dtype=object)

    return html_text(html)
