"""Layout-aware text of HTML pages (operator 6).

A tokenizer feeds a tree builder, which supplies the tags that HTML lets authors leave out (ends of p, li, dt, dd,
option and table parts; rows around lone cells) and emits the tree as events. A renderer lays the visible ones
out: paragraphs, headings, lists, quotes and tables are set apart by an empty line, other blocks by a new
line; list items are marked and indented; ``pre`` keeps its spaces; a table's cells are aligned in columns, with
spans. Hidden are head, script, style, templates, embedded fallbacks, comments, and what ``hidden``, ``display: none`` and
``visibility: hidden`` hide. Style sheets are read before the page is laid out. A selector of one element (tag, classes, id) is resolved
as browsers do: per property by importance, specificity and order, style attributes over sheets, all of them over ``hidden``; a child may
show again by ``visibility: visible``. Where a selector or a condition can't be resolved, its rules never hide, and an element that
they may show stays. Rules for print or speech only count for nothing. Of svg its texts show, of math all but annotations.

Attributes are read by the states of HTML: a quote opens a value only right after ``=``. Where a quoted value
never ends, this and later tags end at their next ``>``, so that the text after them stays; browsers would drop it.

Cases: null or empty pages give an empty text. A tag without any ``>`` after it is dropped with what follows it.
Nesting may have any depth. Columns are as wide as their widest cell; lines of over ``COLUMN`` characters are
wrapped at spaces, and a longer word runs on. ``column`` sets another width, over which whole lines run on. Numbers in attributes that aren't plain, or have over nine digits, count as missing.
Repeated rows give repeated results. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import columns, pieces

_SPAN = 1000
#: Lines of table cells are wrapped from this width on.
COLUMN = 400
_VALUE = r"""(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+))"""
_ATTRIBUTE = re.compile(rf"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+{_VALUE}?+)?+")
_STATES = r"(?:[\s/]++|" + re.sub(r"\((?!\?)", "(?:", _ATTRIBUTE.pattern) + r")*+"
_TOKEN, _PLAIN = (
    re.compile(rf"<!--.*?(?:-->|\Z)|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*+)({inner})>|<[!?/][^>]*>|<[a-zA-Z]([^>]*+)(>?)", re.S)
    for inner in (_STATES, "[^>]*+")
)
_CSS = re.compile(r"""/\*.*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?|[{};]|[^{};"'/]+|/""", re.S)
_SPACES = re.compile(r"[ \t\n\r\f]+")
_HINT = re.compile(r"hidden|style|class|id|span|value|type|start", re.I)
_AT = re.compile(r"@([\w-]+)(.*)", re.S)
_SCREEN = re.compile(r"(?:only\s+)?(?:all|screen)|not\s+(?:print|speech)", re.I)
_ELSEWHERE = re.compile(r"(?:only\s+)?(?:print|speech|aural|braille|embossed|handheld|projection|tty|tv)\b.*|not\s+(?:all|screen)", re.I | re.S)
_COMPOUND = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")
_DOCTYPE = re.compile(r"(?:\s|<!--.*?-->)*<!doctype\b", re.I | re.S)
_PART = re.compile(r"[.#][\w-]+")
_COUNT, _START = re.compile(r"\s*\+?([0-9]{1,9})(?![0-9])"), re.compile(r"\s*([+-]?[0-9]{1,9})(?![0-9])")

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style title template iframe noembed noframes noscript object video audio canvas datalist".split())
#: Parts of svg and math that aren't drawn, the parts that hold HTML again, and the tags that end both.
UNDRAWN = frozenset("desc metadata defs symbol clippath mask marker pattern annotation annotation-xml".split())
INNER = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
OUTER = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
STACKED = frozenset("mfrac msub msup msubsup munder mover munderover mroot mtr".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl pre xmp table blockquote figure fieldset".split())
BLOCK = APART | frozenset("html body div section article aside header footer main nav address li dt dd form figcaption details summary hr legend caption option center hgroup search dialog".split())
ENDS_P = BLOCK - frozenset("html body option caption legend".split())
#: A start tag ends the open elements named, unless one of the fences is nearer.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "caption"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    **{t: (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)) for t in ("thead", "tbody", "tfoot", "caption", "colgroup")},
}
CELLS = frozenset(("td", "th"))
FENCES = frozenset("td th caption table button".split())


def _for_screens(media: str) -> bool | None:
    """Whether a list of media queries holds for every screen (True), for none (False), or for some."""
    queries = [q.strip() for q in media.split(",")]
    if not media.strip() or any(_SCREEN.fullmatch(q) for q in queries):
        return True
    return False if all(_ELSEWHERE.fullmatch(q) for q in queries) else None


def _number(pattern: re.Pattern, text: str | None, default: int) -> int:
    found = pattern.match(text or "")
    return int(found[1]) if found else default


def _wrapped(line: str, most: int) -> list[str]:
    """A line in parts of up to ``most`` characters, broken at spaces; longer words stay whole."""
    out = []
    while len(line) > most:
        cut = line.rfind(" ", 0, most + 1)
        cut = cut if cut > 0 else line.find(" ", most)
        if cut < 0:
            break
        out.append(line[:cut].rstrip(" "))
        line = line[cut + 1 :]
    return [*out, line]


def _declared(body: str) -> dict[str, tuple[bool, bool | None]]:
    """Of a block of declarations, what display and visibility say: important or not, and whether it shows (None: as around it)."""
    parts, said = [], ""
    for token in _CSS.findall(body):
        if token == ";":
            parts.append(said)
            said = ""
        elif not token.startswith("/*"):
            said += token
    out: dict[str, tuple[bool, bool | None]] = {}
    for part in (*parts, said):
        name, colon, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        important = bool(re.search(r"!\s*important$", value))
        value = re.sub(r"\s*!\s*important$", "", value)
        if not colon or name not in ("display", "visibility") or out.get(name, (False,))[0] > important:
            continue
        if name == "display":
            out[name] = (important, value != "none")
        elif value in ("hidden", "collapse", "visible", "initial", "inherit", "unset", "revert"):
            out[name] = (important, None if value in ("inherit", "unset", "revert") else value in ("visible", "initial"))
    return out


class Styles:
    """What style sheets say about showing: rules of simple selectors, and selectors that may show an element.

    ``quirks``: the page has no doctype, and so the case of classes and ids doesn't count.
    """

    def __init__(self, quirks: bool = False) -> None:
        self.quirks = quirks
        self.rules: dict[str, list[tuple[str, frozenset[str], str, tuple, bool | None]]] = {}  # by one part of the selector
        self.may_show: dict[str, dict[str, list[tuple[str, frozenset[str]]]]] = {"display": {}, "visibility": {}}
        self.order = 0

    def sheet(self, text: str, sure: bool = True) -> None:
        """Read a sheet; ``sure`` says that it holds on every screen. Rules within rules are passed over."""
        over: list[tuple[str, str]] = []  # the open blocks: kind and what stands before them
        bodies, said = [""], ""  # the declarations of each open block, and what came since the last of them
        for token in (*_CSS.findall(text), *"}" * text.count("{")):  # blocks that never end end with the sheet
            if token == "{":
                head, kind = said.strip(), "shut"
                around = over[-1][0] if over else ("open" if sure else "maybe")
                if around in ("open", "maybe"):
                    at = _AT.match(head)
                    if not at:
                        kind = "rule" if around == "open" else "perhaps"
                    elif at[1].lower() in ("media", "layer", "supports", "container", "scope"):
                        holds = True if at[1].lower() == "layer" else _for_screens(at[2]) if at[1].lower() == "media" else None
                        kind = "shut" if holds is False else "open" if holds and around == "open" else "maybe"
                over.append((kind, head))
                bodies.append("")
                said = ""
            elif token == "}":
                if over:
                    kind, head = over.pop()
                    body = bodies.pop() + said
                    if kind in ("rule", "perhaps"):
                        self._rule(head, body, kind == "rule")
                said = ""
            elif token == ";":
                bodies[-1] += said + ";"
                said = ""
            elif not token.startswith("/*"):
                said += token

    def _rule(self, selectors: str, body: str, sure: bool) -> None:
        declared = _declared(body)
        if not declared:
            return
        for selector in selectors.split(","):
            selector = selector.strip().lower() if self.quirks else selector.strip()
            self.order += 1
            whole = _COMPOUND.fullmatch(selector)
            if sure and whole and selector:
                tag, parts = (whole[1] or "*").lower(), frozenset(_PART.findall(whole[2]))
                rank = (sum(p[0] == "#" for p in parts), sum(p[0] == "." for p in parts), tag != "*", self.order)
                for name, (important, shows) in declared.items():
                    self.rules.setdefault(min(parts, default=tag), []).append((name, parts, tag, (important, rank), shows))
            elif any(shows is not False for _, shows in declared.values()):
                last = _COMPOUND.match(re.split(r"[\s>+~]+", selector)[-1])
                tag, parts = (last[1] or "*").lower(), frozenset(_PART.findall(last[2]))
                for name, (_, shows) in declared.items():
                    if shows is not False:
                        self.may_show[name].setdefault(min(parts, default=tag), []).append((tag, parts))

    def shows(self, name: str, tag: str, names: set[str], inline: tuple[bool, bool | None] | None, fallback: bool | None) -> bool | None:
        """What holds of a property for an element; ``names`` are its tag, ``*``, classes and id."""
        best = ((False, (-1,)), fallback)
        for key in names:
            for of, parts, wants, rank, shows in self.rules.get(key, ()):
                if of == name and wants in (tag, "*") and parts <= names and rank > best[0]:
                    best = (rank, shows)
        if inline and (inline[0] or not best[0][0]):
            return inline[1]
        if best[1] is False and any(wants in (tag, "*") and parts <= names for key in names for wants, parts in self.may_show[name].get(key, ())):
            return True
        return best[1]


class _Table:
    """Rows of cells, each the lines of its text and its spans."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[list[str], int, int]]] = []
        self.captions: list[str] = []

    def lines(self, most: int | None) -> list[str]:
        placed: list[list[tuple[int, int, list[str]]]] = []
        taken: dict[int, int] = {}  # rows that a column is still taken for
        widths: dict[int, int] = {}
        for row in self.rows:
            at, out, new = 0, [], {}
            for text, across, down in row:
                while taken.get(at):
                    at += 1
                text = text if most else [part for line in text for part in _wrapped(line, COLUMN)]
                out.append((at, across, text))
                if across == 1:
                    widths[at] = max(widths.get(at, 0), min(most or COLUMN, max(map(len, text), default=0)))
                if down > 1:
                    new.update(dict.fromkeys(range(at, at + across), down))
                at += across
            taken = {c: n - 1 for c, n in (taken | new).items() if n > 1}
            placed.append(out)
        used = sorted({c for row in placed for c, _, text in row if text})
        heights = [max((len(text) for _, _, text in row), default=0) for row in placed]
        left, x = {}, 0
        for c in used:
            left[c] = x
            x += widths.get(c, 0) + 2
        lines = list(self.captions)
        for row, height in zip(placed, heights, strict=True):
            for k in range(height):
                line = ""
                for c, _, text in row:
                    if k < len(text) and text[k]:
                        gap = left[c] - len(line)
                        line += " " * (gap if gap > 0 else 2 * bool(line)) + text[k]
                lines.append(line)
        return lines


class _Flow:
    """Text under layout: finished lines, the line that is being filled and the space due before the next."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.spaced = True  # whether a space would be at the start of a line or after another
        self.due = 0
        self.indent: list[str] = []
        self.mark = ""

    def text(self, s: str, kept: bool) -> None:
        if kept:
            head, *rest = s.split("\n")
            self._put(head)
            for part in rest:
                self.end_line(True)
                self._put(part)
            return
        s = _SPACES.sub(" ", s)
        if self.spaced:
            s = s.lstrip(" ")
        if s:
            self._put(s)
            self.spaced = s[-1] == " "

    def _put(self, s: str) -> None:
        if s:
            if self.due and self.lines:
                self.lines.extend([""] * (self.due - 1))
            self.due = 0
            self.parts.append(s)

    def end_line(self, forced: bool = False) -> None:
        line = "".join(self.parts).rstrip(" ")
        if line or (forced and (self.lines or self.parts)):
            if not line and self.due:
                self.due = max(self.due, 2)
            else:
                before = "".join(self.indent)
                if self.mark and line:
                    before, self.mark = before[: -len(self.mark)] + self.mark, ""
                self.lines.append((before + line).rstrip(" ") if line else "")
        self.parts, self.spaced = [], True

    def block(self, apart: bool) -> None:
        self.end_line()
        self.due = max(self.due, 2 if apart else 1)

    def lay(self, lines: list[str]) -> None:
        """Finished lines as a block of their own."""
        self.block(True)
        for line in lines:
            self.text(line, True)
            self.end_line(True)
        self.block(True)

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


class _Page:
    """Builds the tree of one page as a stack of open elements, and lays it out on the way."""

    def __init__(self, column: int | None = None, styles: Styles | None = None) -> None:
        self.column, self.styles = column, styles or Styles()
        self.stack: list[tuple[str, bool, bool]] = []  # tag, whether it shows, whether its spaces are kept
        self.flows, self.tables, self.spans = [_Flow()], [], []
        self.lists: list[list] = []
        self.open: Counter[str] = Counter()  # tags on the stack

    def text(self, s: str, raw: bool = False) -> None:
        shown, kept = (self.stack[-1][1] is True, self.stack[-1][2]) if self.stack else (True, False)
        if self.open["svg"] and not (self.open["text"] or self.open["foreignobject"]):
            return
        if shown and s:
            self.flows[-1].text(unescape(s) if "&" in s and not raw else s, kept)

    def _near(self, tags: tuple[str, ...], fences) -> int | None:
        if not any(self.open[t] for t in tags):
            return None
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in tags:
                return k
            if self.stack[k][0] in fences:
                return None
        return None

    def _close_to(self, k: int) -> None:
        while len(self.stack) > k:
            self._close()

    def start(self, tag: str, source: str) -> bool:
        """Open an element; whether it is open then."""
        if tag in OUTER and (k := self._near(("svg", "math"), INNER)) is not None:
            self._close_to(k)
        if tag in ENDS_P and (k := self._near(("p",), FENCES)) is not None:
            self._close_to(k)
        if tag in IMPLIED:
            ends, fences = IMPLIED[tag]
            if (k := self._near(ends, fences)) is not None:
                self._close_to(k)
            if tag in CELLS and self._near(("table",), CELLS) is not None and self._near(("tr",), ("table",)) is None:
                self._open("tr", {})
        alone = source.endswith("/") and (tag in ("svg", "math") or self._near(("svg", "math"), INNER) is not None)
        found = {a.lower(): unescape(b or c or d) for a, b, c, d in reversed(_ATTRIBUTE.findall(source))} if source and _HINT.search(source) else {}
        self._open(tag, found)
        if tag in VOID or alone:
            self._close()
            return False
        return True

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
            return
        fences = () if tag in FENCES or tag in ("tr", "tbody", "thead", "tfoot") else ("td", "th", "caption")
        if tag in ("tr", "tbody", "thead", "tfoot", "td", "th", "caption"):
            fences = ("table",)
        k = self._near((tag,), fences)
        if k is not None:
            self._close_to(k)
        elif tag == "p":
            self.start("p", "")
            self.end("p")

    def _shows(self, tag: str, found: dict[str, str]) -> bool | None:
        """True: it shows; False: it doesn't, but parts of it may; None: no part of it does."""
        over = self.stack[-1][1] if self.stack else True
        if over is None or tag in UNSEEN:
            return None
        if tag in UNDRAWN and self._near(("svg", "math"), INNER) is not None:
            return None
        hidden = "hidden" in found and found["hidden"].lower() != "until-found"
        inline = _declared(found["style"]) if "style" in found else {}
        if not (inline or hidden or self.styles.rules):
            return over
        classes, own = found.get("class", ""), found.get("id", "")
        if self.styles.quirks:
            classes, own = classes.lower(), own.lower()
        names = {tag, "*", *(f".{c}" for c in classes.split()), f"#{own}"}
        if self.styles.shows("display", tag, names, inline.get("display"), not hidden) is False:
            return None
        shows = self.styles.shows("visibility", tag, names, inline.get("visibility"), None)
        return over if shows is None else shows

    def _open(self, tag: str, found: dict[str, str]) -> None:
        shows = self._shows(tag, found)
        kept = tag in ("pre", "textarea", "xmp") or bool(self.stack and self.stack[-1][2])
        self.stack.append((tag, shows, kept))
        self.open[tag] += 1
        if shows is None:
            return
        flow = self.flows[-1]
        if self.open["math"] and len(self.stack) > 1 and self.stack[-2][0] in STACKED:
            flow.text(" ", False)
        if tag == "br":
            flow.end_line(True)
        elif tag == "text" and self.open["svg"]:
            flow.block(False)
        elif tag == "input":
            if found.get("type", "").lower() in ("submit", "button", "reset"):
                self.text(found.get("value", ""))
        elif tag == "table":
            self.tables.append(_Table())
        elif self.tables and tag in ("tr", "td", "th", "caption"):
            if tag == "tr":
                self.tables[-1].rows.append([])
            else:
                self.spans.append(tuple(min(_SPAN, max(1, _number(_COUNT, found.get(c), 1))) for c in ("colspan", "rowspan")))
                self.flows.append(_Flow())
        elif tag in BLOCK:
            flow.block(tag in APART and not (tag in ("ul", "ol", "menu") and self.lists))
            if tag in ("ul", "ol", "menu"):
                self.lists.append([tag, _number(_START, found.get("start"), 1)])
            elif tag == "li":
                flow.mark = "- "
                if self.lists and self.lists[-1][0] == "ol":
                    self.lists[-1][1] = _number(_START, found.get("value"), self.lists[-1][1])
                    flow.mark = f"{self.lists[-1][1]}. "
                    self.lists[-1][1] += 1
                flow.indent.append(" " * len(flow.mark))
            elif tag in ("blockquote", "dd"):
                flow.indent.append("  ")

    def _close(self) -> None:
        tag, shows, _ = self.stack.pop()
        self.open[tag] -= 1
        if shows is None or tag in VOID and tag != "hr":
            return
        flow = self.flows[-1]
        if tag == "text" and self.open["svg"]:
            flow.block(False)
        elif tag == "table" and self.tables:
            self.flows[-1].lay(self.tables.pop().lines(self.column))
        elif self.tables and tag in ("td", "th", "caption"):
            if tag == "caption":
                self.tables[-1].captions += self.flows.pop().done()
                self.spans.pop()
            else:
                if not self.tables[-1].rows:
                    self.tables[-1].rows.append([])
                self.tables[-1].rows[-1].append((self.flows.pop().done(), *self.spans.pop()))
        elif tag in BLOCK:
            flow.block(tag in APART and not (tag in ("ul", "ol", "menu") and len(self.lists) > 1))
            if tag in ("ul", "ol", "menu") and self.lists:
                self.lists.pop()
            elif tag in ("li", "blockquote", "dd") and flow.indent:
                flow.indent.pop()
                flow.mark = "" if tag == "li" else flow.mark


def _tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, more) of each part of a page: text; start with the source of its attributes; raw, the body of the element just started; end."""
    pos, token = 0, _TOKEN
    while m := token.search(html, pos):
        if m.start() > pos:
            yield "text", "", html[pos : m.start()]
        if m[5] and token is _TOKEN:  # attributes that run to the end of the page
            token, pos = _PLAIN, m.start()
            continue
        pos = m.end()
        if m[1]:
            yield "end", m[1].lower(), ""
        elif m[2]:
            tag = m[2].lower()
            raw = yield "start", tag, m[3]
            if raw and tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|</{tag}\Z", re.I).search(html, pos)
                body = html[pos : end.start() if end else len(html)]
                pos = end.end() if end else len(html)
                yield "raw", tag, body
    yield "text", "", html[pos:]


def _styles(html: str) -> Styles:
    """All style sheets of a page, but for those in templates."""
    out, templates, medium = Styles(not _DOCTYPE.match(html)), 0, ""
    tokens = _tokens(html)
    sent = None
    while True:
        try:
            kind, tag, more = tokens.send(sent)
        except StopIteration:
            return out
        sent = kind == "start"
        if tag == "template":
            templates = max(0, templates + (1 if kind == "start" else -1))
        elif kind == "start" and tag == "style":
            medium = next((unescape(b or c or d) for a, b, c, d in _ATTRIBUTE.findall(more) if a.lower() == "media"), "")
        elif kind == "raw" and tag == "style" and not templates and (holds := _for_screens(medium)) is not False:
            out.sheet(more, holds is True)


def render(html: str | None, column: int | None = None) -> str:
    """All visible text of a page, laid out; ``column`` bounds the width of table columns."""
    html = html or ""
    page = _Page(column, _styles(html) if re.search("<style", html, re.I) else None)
    tokens, sent = _tokens(html), None
    while True:
        try:
            kind, tag, more = tokens.send(sent)
        except StopIteration:
            break
        sent = None
        if kind == "text":
            page.text(more)
        elif kind == "end":
            page.end(tag)
        elif kind == "start":
            sent = page.start(tag, more)
        else:
            if tag in ("textarea", "xmp"):
                page.text(more, raw=tag == "xmp")
            page.end(tag)
    page._close_to(0)
    return "\n".join(page.flows[0].done())


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", column: int | None = None) -> DataFrame:
    """The id column, and the page's text as ``text``."""
    picked = pages.select(pages[id_col], pages[html_col])
    kind = picked.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, html_col):
                ids, html = columns(batch, id_col, html_col)
                yield pa.RecordBatch.from_arrays([ids, pa.array([render(x, column) for x in html.to_pylist()], pa.string())], [id_col, "text"])

    return picked.mapInArrow(run, f"`{id_col}` {kind}, text string")


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    from .shared import table

    return extract_text(table(spark, sf_dir, "pages"))
