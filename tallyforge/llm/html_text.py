"""The main text of web pages by composite text density.

A forgiving parser makes a tree of a page (implied ends of ``p``, ``li``, table parts; unknown ends are passed over).
Parts that are never main text go first: scripts and the like, menus, headers and footers of the page, sidebars,
forms, and what its class, id or role names as an advert, a notice, comments and so on. A form or an element named by
class or id stays if it holds the page's articles or most of its text, and a name such as has-sidebar or comments-open
names nothing. For every other node,

    density = C / T * log(C / LC * T / LT) / log(ln(C / (C - LC) * LC + LCb / Cb * C + e))

with its characters C, tags T, link characters LC and link tags LT (``b``: the body's; a divisor is 1 at least). The node
with the largest sum of its children's densities is the main subtree; the least density on the way from it to the body
is the threshold above which other subtrees are taken too, each by its own largest sum. A subtree inside an ``article``
stands for the whole article.

Character references are decoded; white space in a block becomes one space; blocks are joined by an empty line, in the
order of the page. Null and empty pages give an empty text. A page is taken whole, however long or deep. Of nodes with
equal sums the first on the page counts. Repeated rows give repeated results, an empty table an empty one; other columns
are ignored, whatever their names, but for those of ``keep``, which mustn't be called text or n_chars.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements without content, with raw content, blocks, and what a start tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody tfoot thead tr ul".split())
SPACED = frozenset("br td th wbr".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"), "thead": ("tr",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select", "datalist"), "optgroup": ("select",)}

DROPPED = frozenset("head script style noscript template svg annotation annotation-xml canvas object iframe nav footer aside button select textarea input dialog menu audio video noembed noframes datalist title".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
#: Words in a class or id that name what isn't main text.
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations sidebar side widget menu nav navbar navigation breadcrumb breadcrumbs pagination pager comment comments comentarios kommentare "
    "disqus respond reply replies footer masthead toolbar paywall disclaimer outbrain taboola skip topbar".split()
)

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*>?)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PARTS = re.compile(r"[a-z0-9]+")
#: Names that say something about a layout or a state, as has-sidebar or comments-open.
_MODIFIED = re.compile(r"\b(?:has|no|with|without)[-_][\w-]+|\b[\w-]{1,60}[-_](?:open|closed|enabled|disabled)\b|\bside-by-side\b", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}


def _named(attributes: str) -> int:
    """Do the attributes say that the element isn't main text? 2: by role or because it's hidden; 1: by a name only."""
    said = 0
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            if not DROPPED_NAMES.isdisjoint(_PARTS.findall(_MODIFIED.sub(" ", value))):
                said = 1
        elif name == "role":
            if value in DROPPED_ROLES:
                return 2
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return 2
    return said


class Tree:
    """Nodes in the order of the page, so a subtree is a range of them; and pieces of text (a None parts blocks)."""

    def __init__(self, page: str) -> None:
        self.tag, self.parent, self.end, self.gone = ["#page"], [-1], [0], [False]
        self.pieces: list[tuple[int, str | None]] = []
        self._open = [0]
        self._doubtful: set[int] = set()
        at, size = 0, len(page)
        while at < size:
            m = _TOKEN.search(page, at)
            if not m:
                self._text(page[at:])
                break
            if m.start() > at:
                self._text(page[at : m.start()])
            at = m.end()
            name = m[2]
            if name is None:
                if m[0].startswith("<![CDATA["):
                    self._text(m[0][9:].removesuffix("]]>"))
                continue
            name = name.lower()
            if m[1]:
                self._stop(name)
                continue
            self._start(name, m[3])
            if name in RAW:
                stop = _RAW_END[name].search(page, at)
                at = stop.end() if stop else size
                self._stop(name)
        while len(self._open) > 1:
            self._pop()
        self.end[0] = len(self.tag)
        if self._doubtful:
            self._settle()

    def _settle(self) -> None:
        """Drop what a name or ``form`` marks, but not what holds the page's articles or most of its text."""
        n, tags, doubtful = len(self.tag), self.tag, self._doubtful
        link, within = [False] * n, [False] * n  # within: below an article or main
        for i in range(1, n):
            p = self.parent[i]
            link[i] = tags[i] == "a" or link[p]
            within[i] = within[p] or tags[p] in ("article", "main")
        whole = [0] * n
        for node, s in self.pieces:
            if s and not self.gone[node] and not link[node]:
                whole[node] += len("".join(s.split()))
        plain, kept, articles = list(whole), list(whole), [0] * n
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            if tags[i] in ("article", "main"):
                articles[i] = whole[i]
            whole[p] += whole[i]
            articles[p] += articles[i]
            plain[p] += 0 if i in doubtful else plain[i]
        for i in range(n - 1, 0, -1):
            if i in doubtful:
                outside = articles[0] - (whole[i] if within[i] else articles[i])
                if (articles[i] > 0 and 2 * articles[i] >= articles[0] and articles[i] >= plain[0]) or (2 * kept[i] > whole[0] and 4 * outside < kept[i]):
                    doubtful.discard(i)
                else:
                    continue
            kept[self.parent[i]] += kept[i]
        for i in doubtful:
            self.gone[i : self.end[i]] = [True] * (self.end[i] - i)

    def _text(self, s: str) -> None:
        node = self._open[-1]
        if not self.gone[node]:
            self.pieces.append((node, html.unescape(s) if "&" in s else s))

    def _pop(self) -> None:
        node = self._open.pop()
        self.end[node] = len(self.tag)
        if self.tag[node] in BLOCK:
            self.pieces.append((node, None))
        elif self.tag[node] in SPACED:
            self.pieces.append((node, " "))

    def _stop(self, name: str) -> None:
        tags = self.tag
        for i in range(len(self._open) - 1, 0, -1):
            if tags[self._open[i]] == name:
                while len(self._open) > i:
                    self._pop()
                return

    def _start(self, name: str, attributes: str) -> None:
        tags = self.tag
        if name in ENDS_P:
            for i in range(len(self._open) - 1, 0, -1):
                if (t := tags[self._open[i]]) == "p":
                    while len(self._open) > i:
                        self._pop()
                    break
                if t in ENDS_P or t in ("li", "td", "th", "body"):
                    break
        if name in CLOSES:
            stop, ended = SCOPE.get(name, ("table",)), None
            for i in range(len(self._open) - 1, 0, -1):
                if (t := tags[self._open[i]]) in stop:
                    break
                if t in CLOSES[name]:
                    ended = i
            if ended is not None:
                while len(self._open) > ended:
                    self._pop()
        above, node = self._open[-1], len(tags)
        named = 0 if name in ("html", "body", "article", "main") else _named(attributes)
        gone = self.gone[above] or name in DROPPED or named == 2 or (name == "article" and bool(re.search(r"\bcomment", _MODIFIED.sub(" ", attributes), re.I)))
        if name == "header" and not gone:
            gone = not any(tags[i] in ("article", "main") for i in self._open)
        if not gone and (named or name == "form"):
            self._doubtful.add(node)
        tags.append(name)
        self.parent.append(above)
        self.end.append(node + 1)
        self.gone.append(gone)
        if name in BLOCK:
            self.pieces.append((node, None))
        elif name in SPACED:
            self.pieces.append((node, " "))
        if name not in VOID:
            self._open.append(node)

    def densities(self) -> tuple[list[float], list[float], int]:
        """Each node's density and the sum of its children's; the body."""
        n = len(self.tag)
        link = [False] * n
        for i in range(1, n):
            link[i] = self.tag[i] == "a" or link[self.parent[i]]
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for node, s in self.pieces:
            if s and not self.gone[node]:
                size = len("".join(s.split()))
                chars[node] += size
                if link[node]:
                    link_chars[node] += size
        for i in range(n - 1, 0, -1):
            if not self.gone[i]:
                p = self.parent[i]
                chars[p] += chars[i]
                tags[p] += tags[i] + 1
                link_chars[p] += link_chars[i]
                link_tags[p] += link_tags[i] + (self.tag[i] == "a")
        body = next((i for i in range(n) if self.tag[i] == "body" and chars[i] == chars[0]), 0)
        ratio = link_chars[body] / max(1, chars[body])
        density, total = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            c, lc = chars[i], link_chars[i]
            if c and not self.gone[i]:
                t = max(1, tags[i])
                base = log(c / max(1, c - lc) * lc + ratio * c + e)
                density[i] = c / t * log(max(c / max(1, lc) * t / max(1, link_tags[i]), 1e-9)) / max(log(base), 0.05)
                if i:
                    total[self.parent[i]] += density[i]
        return density, total, body

    def chosen(self) -> list[tuple[int, int]]:
        """Ranges of nodes that hold the main text."""
        density, total, body = self.densities()
        n = len(self.tag)
        best = max(range(body, self.end[body] if body else n), key=lambda i: (total[i], -i), default=body)
        least, i = density[best], best
        while i != body and i > 0:
            i = self.parent[i]
            least = min(least, density[i])
        if total[best] <= 0:
            best = body
        # Each node at or above the threshold gives the subtree of the largest sum below it, or itself without one.
        top = list(range(n))
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            if total[top[i]] > total[top[p]]:
                top[p] = top[i]
        marked = {best}
        for i in range(body, n):
            if not self.gone[i] and density[i] >= least and density[i] > 0:
                marked.add(top[i])
        out: list[tuple[int, int]] = []
        for i in sorted({self._article(i) for i in marked}):
            if not out or i >= out[-1][1]:
                out.append((i, self.end[i]))
        return out

    def _article(self, node: int) -> int:
        i, outer = node, node
        while i > 0:
            if self.tag[i] == "article":
                outer = i
            i = self.parent[i]
        return outer

    def text(self) -> str:
        ranges = self.chosen()
        blocks: list[str] = []
        held: list[str] = []
        starts = [a for a, _ in ranges]

        def flush() -> None:
            s = " ".join("".join(held).split())
            held.clear()
            if s:
                blocks.append(s)

        for node, s in self.pieces:
            if s is None:
                flush()
            elif not self.gone[node] and (k := bisect_right(starts, node)) and node < ranges[k - 1][1]:
                held.append(s)
        flush()
        return "\n\n".join(blocks)


def main_text(page: str | None) -> str:
    return Tree(page).text() if page else ""


def extract(pages: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of ``keep``, text and n_chars for each page."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = pages.select(*keep, F.col(html_col).alias("__html"))
    schema = rows.drop("__html").select("*", F.lit("").alias("text"), F.lit(0).cast("bigint").alias("n_chars")).schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [main_text(p) for p in batch.column(batch.num_columns - 1).to_pylist()]
                columns = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return rows.mapInArrow(run, schema)
