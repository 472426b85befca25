"""Main text of a web page by the maximum-scoring subsequence.

A page is a row of tokens: tags, and words in the element that holds them.
Each kind of token has a weight, positive for words of content and negative
for markup around it; the contiguous run of tokens with the greatest sum is
the content region, found in one linear scan. The weights are log odds
counted on labelled pages: pages that mark their own content with an element
made for it. A page without such a mark is cut by the weights of everything
else that it holds.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_column

#: Labelled pages that the weights are counted on, at most about.
LABELLED = 2_000
#: Kinds of tokens that have a weight, at most: the most common ones.
KINDS = 10_000
#: Greatest weight of a token, of one that was counted in other surroundings,
#: and weights of kinds never met: words, tags.
GREATEST, FAR, NEW_WORD, NEW_TAG = 8.0, 2.0, 0.5, -0.5
#: Weight of a word in an element that never holds content.
BOILER = -4.0
#: Share of a page's words that an element must hold to count as its wrapper.
WRAPS = 0.9

# Names of the HTML standard, and words that sites use in class
# and id attributes for what is not the article.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt
    fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre
    section summary table tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style template textarea title svg math object select".split())
CONTENT = frozenset(["article", "main"])
APART = frozenset("nav aside footer form header menu button dialog label fieldset head".split())
APART_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment
    comments consent cookie cookies disclaimer footer header menu modal nav navbar navigation newsletter notice notices
    popup promo promoted promotion related share sharing sidebar social sponsor sponsored subscribe toolbar
    widget""".split())
# Elements that end an open paragraph or list item when they start.
_CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]),
           "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]),
           "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"])}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def _apart(names: str) -> bool:
    return not APART_WORDS.isdisjoint(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", names).lower()))


class _Element:
    """``hard``: apart by its tag; ``soft``: a form, or named as apart, which
    also holds for elements around a whole page (``has-sidebar``)."""
    __slots__ = ("up", "name", "kind", "content", "hard", "soft", "words", "apart")

    def __init__(self, up: _Element | None, name: str, kind: str, names: str):
        inside = up is not None and up.content
        self.up, self.name, self.kind, self.content, self.words = up, name, kind, inside or name in CONTENT, 0
        self.hard = name in APART and name != "form" and not (name == "header" and inside)
        self.soft = name == "form" or name not in ("html", "body") and _apart(names)
        self.apart = False


def _settle(elements: list[_Element]) -> None:
    """Find what is apart, parents first. Elements around the page's own
    content, a long main or else article, are not apart by name, nor are
    articles that lie in no box or other article. Without such content a form
    or named element is no box if it holds nearly all words."""
    total = 0
    for e in reversed(elements):  # words that are not apart by tag
        if e.hard:
            e.words = 0
        elif e.up is not None:
            e.up.words += e.words
        else:
            total += e.words
    marks = [e for e in elements if e.name == "main"] or [e for e in elements if e.name == "article"]
    most = max((e.words for e in marks), default=0)

    def boxes(e: _Element) -> int:
        n = 0
        while (e := e.up) is not None:
            n += e.soft or e.hard
        return n

    # Of those nearly as long, the one in the fewest boxes: comments may be longer than a short article.
    e = min((e for e in marks if e.words * 4 >= most), key=lambda x: (boxes(x), -x.words), default=None)
    while e is not None:
        e.soft, e = False, e.up
    articles = set()
    for e in elements:
        up = e.up is not None and e.up.apart
        nested = e.up in articles
        if e.name == "article" and not nested or not marks and e.words and e.words >= WRAPS * total:
            e.soft = e.soft and up
        if nested or e.name == "article":
            articles.add(e)
        e.apart = up or e.hard or e.soft


class Token:
    """A tag, or the text between two tags. ``kind`` names its weight: what it
    is, the element and its class, and whether that is in a link."""
    __slots__ = ("kind", "text", "breaks", "content", "apart")

    def __init__(self, kind: str, text: str | None, breaks: bool, content: bool, apart: bool):
        self.kind, self.text, self.breaks, self.content, self.apart = kind, text, breaks, content, apart

    def kinds(self) -> list[str]:
        """From the most to the least exact: the kind in its surroundings, any
        such token there, the plain element anywhere."""
        around = "apart" if self.apart else "content" if self.content else "plain"
        what, _, rest = self.kind.partition(" ")
        link = " a" if rest.endswith(" a") else ""
        return [f"{self.kind} in {around}", f"{what} in {around}", f"{what} {rest.split('.')[0].removesuffix(' a')}{link}"]


def tokens(html: str) -> list[Token]:
    """The tokens of a page. Comments, doctypes and raw elements such as
    scripts are left out. Unclosed elements end with the one around them."""
    out: list[tuple[str, str | None, bool, _Element]] = []
    root = _Element(None, "", "", "")
    elements, stack = [root], [root]
    at, end = 0, len(html)
    link = 0

    def text(piece: str) -> None:
        if piece:
            e = stack[-1]
            e.words += len(piece.split())
            out.append((f"word {e.kind}{' a' if link else ''}", piece, False, e))

    while at < end:
        m = _TOKEN.search(html, at)
        if not m:
            rest = html[at:]
            cut = re.search(r"<[a-zA-Z/!][^<]*\Z", rest)  # a tag cut off by the end of the page
            text(rest[:cut.start()] if cut else rest)
            break
        text(html[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        close, name = m[1], m[2].lower()
        if name in RAW and not close and not m[3].endswith("/"):
            stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = stop.end() if stop else end
            continue
        if name == "a":
            link = 0 if close else 1
        if name not in BLOCKS and name not in CONTENT and name not in APART:
            if name == "br":
                out.append(("tag br", " ", False, stack[-1]))
            continue
        if close:
            if any(s.name == name for s in stack):
                while (s := stack.pop()).name != name:
                    pass
                link = 0
                out.append((f"tag /{s.kind}", None, True, s))
            continue
        shuts = _CLOSES.get(name, _CLOSES["p"] if name in BLOCKS else frozenset())
        while stack[-1].name in shuts:
            stack.pop()
        names = " ".join(next(filter(None, x), "") for x in _NAMED.findall(m[3]))
        kind = f"{name}.{names}" if names else name
        e = _Element(stack[-1], name, kind, names)
        elements.append(e)
        link = 0
        out.append((f"tag {kind}", None, True, e))
        if name not in VOID and not m[3].endswith("/"):
            stack.append(e)
    _settle(elements)
    return [Token(kind, piece, breaks, e.content, e.apart) for kind, piece, breaks, e in out]


def count_kinds(html: str) -> Counter:
    """(kind, inside) counts of a page that marks its content; else nothing."""
    got: Counter = Counter()
    ts = tokens(html)
    if any(t.content for t in ts):
        for t in ts:
            n = len(t.text.split()) if t.text is not None else 1
            for kind in t.kinds():
                got[kind, t.content and not t.apart] += n
    return got


class Weights:
    """Log odds of each kind, and what to take for kinds never met."""

    def __init__(self, counts: dict[tuple[str, bool], int]):
        self.of: dict[str, float] = {}
        for kind in {k for k, _ in counts}:
            odds = (counts.get((kind, True), 0) + 0.5) / (counts.get((kind, False), 0) + 0.5)
            self.of[kind] = max(-GREATEST, min(GREATEST, math.log(odds)))

    def __call__(self, t: Token) -> float:
        if t.content and t.apart:
            return 0.0  # a box inside the content does not end it, and is not shown
        exact, around, plain = t.kinds()
        w = self.of.get(exact)
        if w is None and (t.content or t.apart):
            w = self.of.get(around, BOILER if t.apart else None)
        if w is None and plain in self.of:
            w = max(-FAR, min(FAR, self.of[plain]))  # counted in other surroundings
        if w is None:
            w = NEW_TAG if t.text is None else NEW_WORD
        return w * len(t.text.split()) if t.text is not None else w


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the greatest sum: the first
    such run, the longest from its start; empty if no score is positive."""
    best, lo, hi = 0.0, 0, 0
    now, start = 0.0, 0
    for i, s in enumerate(scores):
        if now <= 0:
            now, start = 0.0, i
        now += s
        if now > best or now == best and start == lo and best > 0:
            best, lo, hi = now, start, i + 1
    return lo, hi


def main_text(html: str, weights: Weights) -> str:
    """The blocks of the content region, one a line. Character references are
    decoded, white space within a block is one space, empty blocks go, and so
    does what stands apart inside the region (forms, notices, comments)."""
    ts = tokens(html)
    lo, hi = best_run([weights(t) for t in ts])
    lines, now = [], []

    def flush() -> None:
        line = " ".join(unescape("".join(now)).split())
        if line:
            lines.append(line)
        now.clear()

    for t in ts[lo:hi]:
        if t.breaks:
            flush()
        elif not t.apart:
            now.append(t.text)
    flush()
    return "\n".join(lines)


def fit(pages: DataFrame, html_col: str = "html", labelled: int = LABELLED, most: int = KINDS) -> Weights:
    """Weights from about ``labelled`` distinct pages, chosen by a hash of the
    page. Copies count once. The ``most`` common kinds have a weight, counted
    inside and outside of content together; the others count as never met."""
    total = pages.agg(F.approx_count_distinct(F.xxhash64(html_col))).first()[0]
    share = min(1.0, labelled / total) if total else 1.0
    picked = pages.filter(F.pmod(F.xxhash64(html_col), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    picked = picked.select(F.col(html_col).alias("html")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: Counter = Counter()
        for b in batches:
            for h in text_column(b, 0):
                got.update(count_kinds(h.as_py()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in got], pa.string()), pa.array([i for _, i in got], pa.bool_()),
             pa.array(list(got.values()), pa.int64())], ["kind", "inside", "n"])

    count = lambda side: F.sum(F.when(side, F.col("n")).otherwise(0))
    rows = (picked.mapInArrow(run, "kind string, inside boolean, n long")
            .groupBy("kind").agg(count(F.col("inside")).alias("inside"), count(~F.col("inside")).alias("outside"))
            .orderBy(F.desc(F.col("inside") + F.col("outside")), "kind").limit(most).collect())
    return Weights({(r["kind"], side): r["inside" if side else "outside"] for r in rows for side in (True, False)})


def extract(pages: DataFrame, weights: Weights | None = None, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text (main text; empty if none).

    Null html counts as empty. Pages cut off in the middle are read as far as
    they go. Null and repeated ids and urls are passed through. Empty table:
    empty result. Columns other than the three named are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    w = weights or fit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                out = [main_text(h.as_py(), w) for h in text_column(part, 2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string())],
                                                 ["page_id", "url", "text"])

    return rows.mapInArrow(run, "page_id long, url string, text string")
