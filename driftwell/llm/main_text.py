"""Main text of HTML pages from parser events and text-to-tag ratios.

The standard library's parser streams a page; its events fill lines, one for each
block of the page, with the line's characters and tags and the container that it
stands in.  The text-to-tag ratios of the lines, smoothed with a Gaussian, are
parted into two clusters; a container is content if one of its lines falls into
the upper cluster and isn't made of tags, and so are those that the page itself calls the article.  All
lines of a content container stay, short ones too, and so do the containers between
two content containers of one parent, and, unless that parent is the body, all
containers beside them.  Gone are the lines inside elements that are
never article text: menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments, known by element, role or class.

Defined results: null or empty html gives an empty text.  Unclosed and stray tags
are taken as browsers take them in simple cases, malformed declarations as comments;
pages of any length are read whole.  Pages that repeat are read each by itself, and
an empty table gives an empty result.  Columns of the caller named in ``keep`` are
passed on, but those that bear the names of the results give way to them.  Lines of
equal ratio fall on the same side of the cut.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added

SIGMA = 1.5
#: Characters a tag from which lines count alike in the clusters, so that no long line takes the upper one alone.
#: The cut is never above half of it: where all lines are text, all are content.
ENOUGH = 100.0
#: A line of two tags or more and fewer characters a tag is a list of links or the like; its neighbours don't make it content.
TAGGED = 15.0
#: A page's end inside a tag, comment or declaration.
_UNFINISHED = re.compile(r"<[A-Za-z!/?]")
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("aside button canvas footer form head iframe input menu nav noscript object option script select style svg template textarea title".split())
CONTAINERS = frozenset("article body div main section td".split())
ROLES = frozenset("banner complementary contentinfo dialog form navigation search alert menu menubar toolbar".split())
#: Words of class or id values that name something other than article text.
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert(?:s|isements?|ising)?|sponsor(?:ed|s)?|promo(?:tion)?s?|banners?|nav(?:bar|igation)?|menus?|breadcrumbs?|sidebars?|side|foot(?:er)?|masthead|topbar|site-header|page-header|header|"
    r"cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlay|newsletters?|subscribe|signup|login|search|share|sharing|social|related|recommended|comments?|comment-list|replies|respond|disqus|pagination|pager|toolbar|widgets?|copyright|legal|disclaimer)(?:$|[\s_-])",
    re.I,
)
#: Elements that a start tag of the key closes when they are open within the same container.
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}


class _Lines(HTMLParser):
    """Lines as [parts, tags, container, skipped]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = []
        self.open: list[tuple[str, bool, int]] = []  # tag, skipped from here on, container
        self.articles: set[int] = set()
        self.containers = 0
        self.parents = [0]  # of each container
        self.bodies = {0}
        self.fresh = True

    def _line(self) -> list:
        skipped, container = (self.open[-1][1], self.open[-1][2]) if self.open else (False, 0)
        if self.fresh or not self.lines or self.lines[-1][2:] != [container, skipped]:
            self.lines.append([[], 0, container, skipped])
            self.fresh = False
        return self.lines[-1]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.fresh = True
        if tag == "br":
            self._line()[0].append(" ")
        if tag in VOID:
            self._line()[1] += 1
            return
        while self.open and self.open[-1][0] in _CLOSES.get(tag, ()):
            self.open.pop()
        if tag in BLOCKS and tag not in ("p",):
            while self.open and self.open[-1][0] == "p":
                self.open.pop()
        skipped, container = (self.open[-1][1], self.open[-1][2]) if self.open else (False, 0)
        at = dict(attrs)
        named = f"{at.get('class') or ''} {at.get('id') or ''}"
        inside = container in self.articles
        skipped = skipped or tag in NEVER or (tag == "header" and not inside) or (at.get("role") or "").lower() in ROLES or "hidden" in at or (tag not in ("html", "body", "article", "main") and bool(_NAMED.search(named)))
        if tag in CONTAINERS:
            self.containers += 1
            if tag in ("article", "main") or inside:
                self.articles.add(self.containers)
            if tag == "body":
                self.bodies.add(self.containers)
            self.parents.append(container)
            container = self.containers
        self.open.append((tag, skipped, container))
        if tag not in BLOCKS:
            self._line()[1] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.fresh = True
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![`` opens no section in HTML: what follows up to ``>`` is a comment, as in browsers."""
        return self.parse_bogus_comment(i, 0)

    def parse_comment(self, i: int, report: int = 1) -> int:
        """``<!-->`` and ``<!--->`` are whole comments."""
        for short in ("<!-->", "<!--->"):
            if self.rawdata.startswith(short, i):
                return i + len(short)
        return super().parse_comment(i, report)

    def handle_data(self, data: str) -> None:
        if data and (not self.fresh or not data.isspace()):
            self._line()[0].append(data)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing over the lines, with weights that sum to 1 at the ends too."""
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = lambda x: np.convolve(x, kernel, "full")[reach : reach + len(x)]
    return full(ratios) / full(np.ones(len(ratios)))


def cut_between(values: np.ndarray) -> float:
    """Threshold between the two clusters of one-dimensional two-means."""
    low, high = float(values.min()), float(values.max())
    for _ in range(32):
        cut = (low + high) / 2
        upper = values > cut
        if not upper.any() or upper.all():
            return cut
        new = float(values[~upper].mean()), float(values[upper].mean())
        if new == (low, high):
            return cut
        low, high = new
    return (low + high) / 2


def with_siblings(content: set[int], parents: list[int], bodies: set[int]) -> set[int]:
    """``content`` and the containers beside or between two that hold content; parents come before their children."""
    holding = set(content)
    first: dict[int, int] = {}
    last: dict[int, int] = {}
    for c in range(len(parents) - 1, 0, -1):
        if c in holding:
            holding.add(parents[c])
            first[parents[c]] = c
            last.setdefault(parents[c], c)
    regions = {p for p, c in first.items() if c != last[p]}
    whole: set[int] = set()  # containers that stay with all inside them
    out = content | (regions - bodies)
    for c in range(1, len(parents)):
        p = parents[c]
        if p in whole or (p in regions and (p not in bodies or first[p] < c < last[p])):
            whole.add(c)
    return out | whole


def extract(html: str | None) -> str:
    """The main text; blocks joined by two newlines."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    if _UNFINISHED.match(parser.rawdata):
        parser.rawdata = ""
    parser.close()
    lines = [(" ".join("".join(parts).split()), tags, container, skipped) for parts, tags, container, skipped in parser.lines]
    lines = [x for x in lines if x[0]]
    if not lines:
        return ""
    ratios = np.array([0.0 if skipped else len(t) / max(1, tags + 1) for t, tags, _, skipped in lines])
    soft = smoothed(np.minimum(ratios, ENOUGH))
    cut = min(cut_between(soft), ENOUGH / 2) - 1e-9
    tagged = [tags > 1 and r < TAGGED for (_, tags, _, _), r in zip(lines, ratios, strict=True)]
    content = {c for (_, _, c, skipped), r, links in zip(lines, soft, tagged, strict=True) if not skipped and not links and r >= cut}
    content = with_siblings(content, parser.parents, parser.bodies) | parser.articles
    return "\n\n".join(t for t, _, c, skipped in lines if not skipped and c in content)


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, columns of ``keep``, text, n_chars) for every row of ``pages``."""
    kept = [c for c in keep if c not in ("id", "text", "n_chars")]

    def rows(pages: list[str | None]) -> list[list]:
        texts = [extract(x) for x in pages]
        return [texts, [len(x) for x in texts]]

    return added(pages, [F.col(id_col).alias("id"), *kept], html_col, "text string, n_chars long", rows)
