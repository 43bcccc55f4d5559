"""The main text of web pages.

Parser events of the standard library become lines, one per block element, each with its
characters and tags. The text-to-tag ratios of a page's lines are smoothed with a Gaussian and
their logarithms parted in two clusters; the lines of the upper cluster are content. The
region is the article (or main) element that holds most content, else the deepest element with
nearly all of it. Its lines count, short ones too, but for lists of links in the lower cluster
and for parts that their element, role or class marks as no part of an article.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.tokens import slices

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never an article's.
NOT_TEXT = frozenset("script style noscript template nav footer aside head title iframe svg math button select textarea menu dialog object canvas audio video datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id attributes that mark menus, notices, adverts and reader comments.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe signup login share sharing social "
    "related recommended recommendations comment comments commentlist disqus respond reply replies widget toolbar pagination pager copyright skip hidden alert".split()
)
#: Of these, those under which no article is the page's own.
OTHERS = frozenset("related recommended recommendations comment comments commentlist disqus respond reply replies".split())
#: Words that make another word of their class a state or what isn't there: "no-sidebar", "ad-free", "comments-open".
STATES = frozenset("no non not without has have with free less off on open opened close closed enabled disabled inactive layout".split())
#: Characters and share of the content that release an element from a mark of its class, or a form from its own.
RELEASED, HELD = 200, 0.8
#: Their class says nothing of all that they hold.
ROOTS = frozenset(("html", "body", "main", "article"))
#: Elements of a head; any other ends it.
HEAD = frozenset("head title meta link base script style noscript template".split())
#: Elements that hold one paragraph or item, never a whole article.
TEXT_ELEMENTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption caption".split())
#: What a start tag ends, where the end tag was left out, up to the nearest element that holds such.
ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Share of the content that the region holds; share of a line's characters in links that makes it one of a list of links.
SHARE, LINKED = 0.8, 0.8
_WORDS = re.compile(r"[a-z]+")


def class_words(names: str) -> set[str]:
    """Words of class names that tell what an element is. A name with a word of ``STATES`` beside others tells nothing."""
    found: set[str] = set()
    for name in names.split():
        words = set(_WORDS.findall(name))
        if len(words) < 2 or not words & STATES:
            found |= words
    return found


_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Lines(HTMLParser):
    """Collects (text, tags, link characters, element, mark, doubted) per block of a page.

    Elements are numbers, each with its name and the number of the block around it. A mark of 1,
    by a class or a form, is in doubt; ``doubted`` are the blocks that have one, -1 for an inline element.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int, tuple]] = []
        self.kinds: list[str] = []
        self.parents: list[int] = []
        self.open: list[tuple[str, int, bool, int, tuple]] = []  # name, 2 dropped or 1 marked or 0, whether a block, innermost block, marked blocks
        self.count: dict[str, int] = {}  # how many of each name are open
        self.text: list[str] = []
        self.tags = self.linked = 0

    def end_line(self) -> None:
        if self.text:
            said = " ".join("".join(self.text).split())
            if said:
                self.lines.append((said, self.tags + 1, self.linked, self.here(), self.state(), self.open[-1][4] if self.open else ()))
        self.text, self.tags, self.linked = [], 0, 0

    def state(self) -> int:
        return self.open[-1][1] if self.open else 0

    def here(self) -> int:
        return self.open[-1][3] if self.open else -1

    def push(self, tag: str, own: int, around: int, block: bool) -> None:
        number = self.here()
        if block:
            self.kinds.append(tag)
            self.parents.append(number)
            number = len(self.kinds) - 1
        doubted = (self.open[-1][4] if self.open and around else ()) + ((number if block else -1,) if own == 1 else ())
        self.open.append((tag, max(own, around), block, number, doubted))
        self.count[tag] = self.count.get(tag, 0) + 1

    def judged(self, tag: str, attrs: list) -> int:
        has = {k: (v or "").lower() for k, v in attrs}
        if tag in NOT_TEXT or has.get("role") in ROLES or "hidden" in has or has.get("aria-hidden") == "true" or _HIDDEN.search(has.get("style", "")):
            return 2
        if tag == "header":
            return 0 if self.count.get("article") else 2
        found = class_words(f"{has.get('class', '')} {has.get('id', '')}")
        if tag == "article":
            return 2 * any(x.startswith(("comment", "repl")) for x in found)
        if tag in ROOTS:
            return 0
        return 2 if found & OTHERS else int(tag == "form" or bool(found & MARKS))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.count.get("head") and tag not in HEAD:
            self.handle_endtag("head")
        if tag in VOID:
            if tag in ("br", "hr", "img"):
                self.text.append(" ")
            self.tags += 1
            return
        if tag in INLINE:
            own = self.judged(tag, attrs)
            self.tags += 1
            if own > self.state():  # its own words are no part of the line around it
                self.end_line()
            self.push(tag, own, self.state(), False)
            return
        self.end_line()
        self.close_open("p", ("td", "th", "li", "div", "article", "section", "body", "table", "blockquote"))
        if tag in ENDS:
            for name in ENDS[tag][0].split():
                self.close_open(name, ENDS[tag][1])
        # an article is its page's own whatever the class of a wrapper or a form around it says
        around = 0 if tag in ("article", "main") and self.state() == 1 else self.state()
        self.push(tag, self.judged(tag, attrs), around, True)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def close_open(self, name: str, within: tuple) -> None:
        """Closes the innermost ``name`` unless an element of ``within`` stands inside it."""
        if not self.count.get(name):
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == name:
                self.cut(k)
                return
            if self.open[k][0] in within:
                return

    def cut(self, k: int) -> None:
        if any(x[2] for x in self.open[k:]) or self.state() > (self.open[k - 1][1] if k else 0):
            self.end_line()
        for x in self.open[k:]:
            self.count[x[0]] -= 1
        del self.open[k:]

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        if tag in INLINE:
            self.tags += 1
        if not self.count.get(tag):
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.cut(k)
                return
            if tag in INLINE and self.open[k][2]:
                return

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if any(x[0] == "a" for x in self.open[-3:]):
            self.linked += len(data)


def smoothed(ratios: np.ndarray, radius: int = 3) -> np.ndarray:
    """Gaussian smoothing, with the ends repeated."""
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / (radius / 2)) ** 2)
    return np.convolve(np.pad(ratios, radius, mode="edge"), weights / weights.sum(), mode="valid")


def upper_cluster(values: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Which values lie in the upper of two clusters; all, where they hardly differ."""
    low, high = values.min(), values.max()
    if high - low < np.log(2):
        return np.ones(len(values), bool)
    for _ in range(rounds):
        up = values >= (low + high) / 2
        low, high = values[~up].mean(), values[up].mean()
    return values >= (low + high) / 2


def released(lines: list, content: np.ndarray, sizes: np.ndarray) -> set[int]:
    """Marked blocks that hold the content after all: nearly all of what no surer mark drops, and as much as an article has."""
    open_ = np.array([x[4] < 2 for x in lines])
    share = sizes * content * open_
    total, found = float(share.sum()), {}
    for x, n in zip(lines, share.tolist()):
        for k in x[5] if x[4] == 1 else ():
            found[k] = found.get(k, 0.0) + n
    return {k for k, n in found.items() if k >= 0 and n >= max(HELD * total, RELEASED)}


def region(lines: list, kinds: list[str], parents: list[int]) -> list[str]:
    """The texts of the lines that belong to the page's main text, in page order."""
    sizes = np.array([len(x[0]) for x in lines], float)
    if not len(lines):
        return []
    # notices and menus beside the content take part in the clusters, as they tell what low ratios are
    content = upper_cluster(np.log1p(smoothed(sizes / np.array([x[1] for x in lines]))))
    free = released(lines, content, sizes)
    plain = np.array([not x[4] or (x[4] == 1 and free.issuperset(x[5])) for x in lines])
    if not plain.any():
        return []
    content = content & plain if (content & plain).any() else plain
    mass = [0.0] * len(kinds)
    for x, n in zip(lines, sizes * content):
        if x[3] >= 0:
            mass[x[3]] += float(n)
    for i in range(len(kinds) - 1, 0, -1):  # elements are numbered from the outside in
        if parents[i] >= 0:
            mass[parents[i]] += mass[i]
    around = {kind: _outermost(kind, kinds, parents) for kind in ("article", "main")}
    articles = {i for i in set(around["article"]) if i >= 0 and mass[i] > 0}
    mains = {i for i in set(around["main"]) if i >= 0 and mass[i] > 0}
    if articles:
        best = max(articles, key=lambda i: (mass[i], -i))
        chosen = {best} if 2 * mass[best] >= sum(mass[i] for i in articles) else articles
        inside = lambda i: i >= 0 and around["article"][i] in chosen
    elif mains:
        inside = lambda i: i >= 0 and around["main"][i] in mains
    else:
        total = float((sizes * content).sum())
        inner = max((i for i, m in enumerate(mass) if m >= SHARE * total and kinds[i] not in TEXT_ELEMENTS), default=-1)
        held = _under(inner, parents)
        inside = lambda i: inner < 0 or (i >= 0 and held[i])
    listed = lambda k, x: not content[k] and x[2] >= LINKED * len(x[0]) and (x[3] < 0 or kinds[x[3]] not in HEADINGS)
    return [x[0] for k, x in enumerate(lines) if plain[k] and inside(x[3]) and not listed(k, x)]


def _outermost(kind: str, kinds: list[str], parents: list[int]) -> list[int]:
    """Per element the outermost element of a kind that holds it or is it, -1 where none does."""
    out: list[int] = []
    for i, name in enumerate(kinds):
        above = out[parents[i]] if parents[i] >= 0 else -1
        out.append(above if above >= 0 else i if name == kind else -1)
    return out


def _under(top: int, parents: list[int]) -> list[bool]:
    out: list[bool] = []
    for i, parent in enumerate(parents):
        out.append(i == top or (parent >= 0 and out[parent]))
    return out


def main_text(html: str) -> str:
    lines = Lines()
    lines.feed(html)
    lines.close()
    lines.end_line()
    return " ".join(region(lines.lines, lines.kinds, lines.parents))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``.

    A null or empty html gives an empty text, as does a page of menus, notices and adverts
    alone; broken markup is read as far as it goes; repeated
    rows give repeated rows; other columns are ignored.
    """

    def run(batches):
        for batch in slices(batches, 64):
            texts = [main_text(h or "") for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
