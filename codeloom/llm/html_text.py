"""Operator 9: main text of web pages by line-block distribution.

Markup is stripped into lines (one a block element). Lines of menus, headers, footers, sidebars, notices, adverts,
forms and comments weigh nothing, and a border of the article counts as a gap. Text lengths are summed over sliding
windows of lines; a surge is where the sum leaves zero, a dive where it returns to zero, and the text between is kept:
all runs inside the article or main element where the page has one.

A page without them has no border to go by, so its own lines tell: half of its text lies in lines of some length or
more, and a line of a quarter of that length surges, as do headings, sentences and lines of the block that holds most
text, but not lines that are mostly links or state a copyright. The first and the last line that surges bound the text;
between them everything outside boilerplate stays.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_batch

WINDOW = 3
#: On pages without an article, a line of this share of the page's usual length surges by its length alone.
SHARE = 0.25
#: Elements nested deeper lie beside each other, as in browsers; so the work for an element is bounded.
DEEPEST = 512

# Element names of HTML by what becomes of them, and words of class and id that mark boilerplate.
DROPPED = frozenset("annotation annotation-xml script style noscript template svg iframe object canvas audio video select textarea button title head".split())
RAW = frozenset("script style textarea title noscript template svg iframe".split())
BOILER = frozenset("nav footer aside form dialog menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr math mi mo mn ms mtext mrow msup msub msubsup mfrac msqrt mroot mstyle mover munder munderover mspace mpadded mfenced semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARKS = frozenset(
    "ad ads advert advertisement adverts sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs header footer masthead sidebar aside widget related recommended share sharing social newsletter "
    "subscribe subscription signup login form comment comments disqus respond reply replies pagination pager skip".split()
)
TALK = frozenset("comment comments disqus respond reply replies".split())
TELLS = frozenset("has with no without".split())
ARTICLE = frozenset(("article", "main"))
FORMATS = frozenset("a b big code em font i s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol menu dir".split())
TABLE = frozenset("tr td th thead tbody tfoot caption colgroup".split())
CELLS = frozenset("td th caption table".split())
# What HTML closes when an element of the first names begins: the innermost of the second names within the third.
_BLOCKS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup li main "
    "menu nav ol p pre search section summary table ul dd dt".split()
)
IMPLIED = (
    (_BLOCKS, ("p",), CELLS | {"button", "object"} | ARTICLE),
    (("li",), ("li",), _BLOCKS - {"address", "div", "p", "li"} | CELLS),
    (("dd", "dt"), ("dd", "dt"), _BLOCKS - {"address", "div", "p", "dd", "dt"} | CELLS),
    (("td", "th"), ("td", "th"), ("table", *ARTICLE)),
    (("tr",), ("tr",), ("table", *ARTICLE)),
    (("thead", "tbody", "tfoot"), ("thead", "tbody", "tfoot", "caption", "colgroup"), ("table", *ARTICLE)),
    (("option", "optgroup"), ("option",), ("select", "optgroup", *ARTICLE)),
    (("button",), ("button",), ARTICLE),
    (HEADINGS, HEADINGS, _BLOCKS - HEADINGS | CELLS),
    (("body",), ("head",), ()),
)

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_COPYRIGHT = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)
_MARKED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[A-Za-z]+")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(text, "", its source), (start, name, attributes) or (end, name, "") of a page, in one pass from start to end.

    A tag ends at the first > outside quotes, or at the first > where a quote never ends; without one the rest is text.
    Comments, declarations and the contents of scripts and the like are left out; CDATA is text.
    """
    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            yield "text", "", page[at:lt]
        if lt == size:
            return
        mark = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
        elif page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt)
            yield "text", "", html.escape(page[lt + 9 : end if end >= 0 else size])
            at = size if end < 0 else end + 3
        elif mark in ("!", "?"):
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
        elif name := _NAME.match(page, lt + 1 + (mark == "/")):
            first = end = page.find(">", name.end())
            if first < 0:
                yield "text", "", page[lt:]
                return
            place = name.end()
            while m := _STOP.search(page, place):
                end = m.start()
                if m[0] == ">":
                    break
                close = page.find(m[0], end + 1)
                if close < 0:
                    end = first
                    break
                place = close + 1
            else:
                end = first
            at, low = end + 1, name[0].lower()
            if mark == "/":
                yield "end", low, ""
            else:
                yield "start", low, page[name.end() : end]
                if low in RAW and not page.endswith("/", lt, end):
                    m = _END[low].search(page, at)
                    yield "end", low, ""
                    at = m.end() if m else size
        else:
            yield "text", "", "<"
            at = lt + 1


def marked(attributes: str) -> int:
    """0 without a word that marks boilerplate, 2 if only words of discussions do, else 1. A word after has, with or no tells of another element."""
    found = 0
    for m in _MARKED.finditer(attributes):
        for token in (m[1] or m[2] or m[3] or "").split():
            words = [w.lower() for w in _WORDS.findall(token)]
            for before, w in zip(["", *words], words):
                if w in MARKS and before not in TELLS:
                    if w not in TALK:
                        return 1
                    found = 2
    return found


class _Tree:
    """Elements in page order, their parents and last descendants, and the page's texts and block borders between them.

    End tags that HTML lets pages omit are supplied: at the next block, row, cell or item, and at the end of the parent.
    """

    def __init__(self, page: str):
        self.name, self.parent, self.last = [""], [-1], [0]
        self.hard, self.marks, self.inside, self.begins = [False], [0], [False], [False]  # a boilerplate name, marks, in an article, begins an article
        self.events: list[tuple[str, int, str]] = []  # open, close, text or end (a block's border), of which element
        self._stack, self._count = [0], Counter()
        for kind, name, text in tokens(page):
            if kind == "text":
                self._text(text)
            else:
                (self._end if kind == "end" else self._start)(name, text)
        self._close(0)

    def _text(self, text: str) -> None:
        if self.name[self._stack[-1]] == "head" and not text.isspace() and text:
            self._close(len(self._stack) - 1)
        self.events.append(("text", self._stack[-1], text))

    def _close(self, place: int) -> None:
        """Closes the open elements from this place of the stack on."""
        while len(self._stack) > place:
            n = self._stack.pop()
            self._count[self.name[n]] -= 1
            self.last[n] = len(self.name) - 1
            self.events.append(("close", n, ""))

    def _find(self, names, stop) -> int:
        """The place of the innermost open element of these names within the innermost of `stop`, or 0."""
        if any(self._count[n] for n in names):
            for i in range(len(self._stack) - 1, 0, -1):
                name = self.name[self._stack[i]]
                if name in names:
                    return i
                if name in stop:
                    break
        return 0

    def _start(self, name: str, attributes: str) -> None:
        if name in VOID:
            if name in ("br", "hr"):
                self.events.append(("text", self._stack[-1], " "))
            return
        if self.name[self._stack[-1]] == "head" and name not in ("title", "noscript", "script", "style", "template"):
            self._close(len(self._stack) - 1)
        for by, names, stop in IMPLIED:
            if name in by and (i := self._find(names, stop)):
                self._close(i)
        if name == "a":
            self._end_inline(name)
        if len(self._stack) > DEEPEST:
            self._close(len(self._stack) - 1)
        up = self._stack[-1]
        begins = name in ARTICLE and not self.inside[up]
        hard = name in DROPPED or name in BOILER or name == "header" and not self.inside[up]
        marks = 0 if hard or begins or name in ("html", "body", "main") or not attributes else marked(attributes)
        if attributes.endswith("/") and name not in ARTICLE:
            if name not in INLINE and not hard and not marks:
                self.events.append(("end", up, ""))
            return
        n = len(self.name)
        self.name.append(name)
        self.parent.append(up)
        self.last.append(n)
        self.hard.append(hard)
        self.marks.append(marks)
        self.inside.append(begins or self.inside[up])
        self.begins.append(begins)
        self._stack.append(n)
        self._count[name] += 1
        self.events.append(("open", n, ""))

    def _end(self, name: str, _: str) -> None:
        if name in INLINE:
            return self._end_inline(name)
        if name in ARTICLE:
            stop = ()
        elif name in BOILER or name in DROPPED:
            stop = ARTICLE
        else:
            stop = ARTICLE | (LISTS if name == "li" else {"table"} if name in TABLE else frozenset() if name == "table" else CELLS)
        if name not in ("html", "body") and (i := self._find(HEADINGS if name in HEADINGS else (name,), stop)):
            self._close(i)
        else:
            self.events.append(("end", self._stack[-1], ""))

    def _end_inline(self, name: str) -> None:
        if i := self._find((name,), ARTICLE):
            if all(self.name[n] in INLINE for n in self._stack[i + 1 :]):
                self._close(i)
            elif name in FORMATS:  # misnested: what it opened goes on without it
                n = self._stack.pop(i)
                self._count[name] -= 1
                self.last[n] = len(self.name) - 1

    def skipped(self) -> list[bool]:
        """Whether each element is boilerplate: by its name, or by its marks if it holds no more than half of the plain text.

        Plain text is text outside links and outside elements that are boilerplate by name, of the article that holds
        the element or else of the page. Discussions may outgrow what they discuss: they stay only if all of it is theirs.
        """
        n = len(self.name)
        link, hard, plain = [False] * n, [False] * n, [0] * n
        for i in range(1, n):
            up = self.parent[i]
            link[i] = link[up] or self.name[i] == "a"
            hard[i] = self.hard[i] or hard[up] and not self.begins[i]
        for kind, i, text in self.events:
            if kind == "text" and not link[i] and not hard[i]:
                plain[i] += len(text.strip())
        for i in range(n - 1, 0, -1):
            if not self.begins[i]:
                plain[self.parent[i]] += plain[i]
        out, top = [False] * n, [0] * n
        for i in range(1, n):
            up = self.parent[i]
            top[i] = i if self.begins[i] else top[up]
            if self.begins[i]:
                continue  # an article ends whatever was left open before it
            out[i] = out[up] or self.hard[i]
            if self.marks[i] and not out[i]:
                own, all_ = plain[i], plain[top[i]]
                out[i] = not (own and (own == all_ if self.marks[i] == 2 else 2 * own > all_))
        return out


def lines_of(tree: _Tree) -> list[tuple[str, bool, int, bool]]:
    """(text, inside the article, its element, mostly links) of each block line outside boilerplate; boilerplate itself leaves gaps outside the article: empty texts."""
    out: list[tuple[str, bool, int, bool]] = []
    parts: list[str] = []
    skip = tree.skipped()
    link = [False] * len(tree.name)
    for i in range(1, len(link)):
        link[i] = link[tree.parent[i]] or tree.name[i] == "a"
    article, holder, own, linked = False, 0, 0, 0

    def end_line() -> None:
        nonlocal own, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((text, article, holder, linked > own))
        own = linked = 0

    def gap() -> None:
        end_line()
        out.extend([("", article, 0, False)] * WINDOW)

    for kind, n, text in tree.events:
        name, up = tree.name[n], tree.parent[n]
        if kind == "text":
            if not skip[n]:
                size = len(text.strip())
                if not parts or size and not own + linked:
                    holder = n
                own, linked = own + size * (not link[n]), linked + size * link[n]
                parts.append(text)
        elif skip[n]:
            if kind == "open" and not skip[up] and name not in INLINE:
                end_line() if tree.inside[n] else gap()
        elif kind != "end" and name in ARTICLE:
            gap()
            article = tree.inside[n] if kind == "open" else tree.inside[up]
        elif name not in INLINE or kind == "end":
            end_line()
    end_line()
    return out


def main_text(page: str) -> str:
    tree = _Tree(page)
    lines = lines_of(tree)
    weights = [len(t) for t, *_ in lines]
    runs: list[tuple[int, int]] = []  # surge and dive
    total, start = 0, None
    for i in range(len(lines) + WINDOW):
        total += weights[i] if i < len(lines) else 0
        total -= weights[i - WINDOW] if i >= WINDOW else 0
        if total and start is None:
            start = i
        elif not total and start is not None:
            runs.append((start, i))
            start = None
    if start is not None:
        runs.append((start, len(lines)))
    inside = [r for r in runs if any(lines[i][1] and weights[i] for i in range(r[0], min(r[1], len(lines))))]
    if not inside and runs:
        inside = [_content(tree, lines, runs)]
    return " ".join(lines[i][0] for a, b in inside for i in range(a, min(b, len(lines))) if weights[i])


def _content(tree: _Tree, lines: list[tuple[str, bool, int, bool]], runs: list[tuple[int, int]]) -> tuple[int, int]:
    """From the first to the last line that surges on a page without an article; of a page without such lines, its longest run."""

    def block(n: int) -> int:
        while tree.name[n] in INLINE:
            n = tree.parent[n]
        return n

    a, b = max(runs, key=lambda r: sum(len(t) for t, *_ in lines[r[0] : r[1]]))
    # The usual length: half of the text outside links lies in lines as long or longer.
    lengths = sorted((len(t) for t, _, _, links in lines if t and not links), reverse=True)
    usual, seen = 0, 0
    for usual in lengths:
        seen += usual
        if 2 * seen >= sum(lengths):
            break
    # The blocks around the lines of usual length in the longest run, up to the first that holds them all; nothing is told by the body's.
    long = [block(n) for t, _, n, links in lines[a:b] if t and not links and len(t) >= SHARE * usual]
    around = [n if tree.name[n] in ("div", "section", "td", "body", "html", "") else tree.parent[n] for n in long]
    low = high = 0
    if around:
        low, high = min(around), max(around)
        while tree.last[low] < high:
            low = tree.parent[low]
    shared = tree.name[low] not in ("body", "html", "")

    def sentence(t: str) -> bool:
        return " " in t and t.rstrip("\"'”’»)]").endswith((".", "!", "?", "…", ":", ";")) or t.endswith(("。", "！", "？"))

    def surges(i: int) -> bool:
        text, _, n, links = lines[i]
        n = block(n)
        if shared and low <= n <= tree.last[low]:
            return bool(text)
        if not text or links or _COPYRIGHT.match(text):
            return False
        return len(text) >= SHARE * usual or tree.name[n] in HEADINGS or sentence(text)

    kept = [i for i in range(len(lines)) if surges(i)]
    return (kept[0], kept[-1] + 1) if kept else (a, b)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars of every page.

    Null and empty pages and pages without text give the empty text, 0 code points; null ids and urls stay; repeated
    rows come back repeated; an empty table gives no rows; other columns of any name are left out. A page is read whole,
    in time in proportion to its length.
    """
    kinds = dict(pages.dtypes)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(batch.column(2)[i].as_py() or "") for i in range(batch.num_rows)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return by_batch(pages.select(id_col, url_col, html_col), work, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
