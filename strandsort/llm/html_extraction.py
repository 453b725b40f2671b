"""Main text of web pages by tag-path ratios.

A page is read once from left to right into blocks of text, each with the path of block elements from the root to it; a
step of a path is an element's name and its first class. Menus, forms, adverts, reader comments and the like that say
what they are, by element, role, id or class, are set aside, unless they hold the article.

For the other blocks, text length and punctuation are summed up by path: characters outside links a block, and marks a
block. Each block gets its path's two ratios; both series are smoothed by a Gaussian along the page, put to a common
scale, and fused by their geometric mean. Paths whose mean reaches a share of the series' standard deviation are content
paths. Their blocks choose the place of the main text: the page's articles, its main element, or else the lowest element
that holds nearly all of what was chosen. All blocks of that place are the text, so that headings, lists and one-word
paragraphs between long ones stay, but blocks that are links for the most part go, as do those that lie before and
after the chosen ones where the place is the whole page.

A page is a row and is worked on by itself: no shuffle, and memory for one slice of pages at a time. The work grows with
the page's length. Edge cases: null or empty html gives an empty text; html is read whole, cut-off tags, unclosed
elements and wrong nesting as browsers do; equal rows give equal rows; an empty table gives an empty one. Only id, url
and html are read, so that other columns may have any name.
"""

from __future__ import annotations

import html as html_entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandsort.llm.common import pick, table
from strandsort.llm.words import pieces

# Element names of HTML.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody "
    "td tfoot th thead tr ul noscript template svg math object iframe canvas audio video".split()
)
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style".split())
SPACING = frozenset("br hr".split())
#: A start tag ends an open element of the first set, if it is nearer than one of the second.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
P_SCOPE = frozenset("button table td th caption object template".split())
# Elements, roles, and words of ids and classes that are not the article's.
NEVER = frozenset("head nav footer noscript template svg math object iframe canvas audio video select button dialog".split())
MOSTLY_NOT = frozenset("header aside form fieldset menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
BOILERPLATE = frozenset(
    "ad ads adsense adslot adbox adbanner adunit advert adverts advertisement advertising sponsor sponsors sponsored sponsorship promo promos "
    "promoted promotion banner sidebar sidebars aside rail nav navbar navigation menu menus navmenu submenu breadcrumb breadcrumbs footer foot "
    "colophon masthead header topbar toolbar cookie cookies consent gdpr ccpa notice notices notification notifications alert popup modal overlay "
    "lightbox newsletter subscribe subscription signup signin login register share sharing social related recommended recommendations "
    "recirculation trending teaser comment comments commentlist commentform disqus respond reply replies discussion responses widget widgets "
    "search pagination pager outbrain taboola skip copyright disclaimer".split()
)
#: Elements that hold a piece of a text, and never all of it with its heading.
TEXT_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption".split())
TITLE_PARTS = frozenset("header".split())
ARTICLE_WORDS = frozenset("article post entry story content body page site".split())
NOT_MEANT = frozenset("no has with without is".split())

TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"(?<![^\s/\"'])(class|id|role|hidden|style|itemprop|aria-hidden)(?![\w-])(?:\s*=\s*(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?", re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
MARKS = ".,;:!?…—。，、；：！？¿"

#: Smoothing along the page in blocks, and the share of the standard deviation that content paths reach.
SIGMA = 1.0
REACH = 2
THRESHOLD = 0.8
#: The part of the chosen text that an element must hold to be taken as the place of all of it.
HELD = 0.8
#: Blocks with a larger part of their characters in links are no text.
LINKED = 0.6


def says_boilerplate(names: str, in_article: bool) -> bool:
    """Whether a class or id attribute has a name for something beside the article."""
    for name in names.split():
        parts = [p.lower() for p in NAME_PARTS.findall(name)]
        if not parts or parts[0] in NOT_MEANT:
            continue
        found = BOILERPLATE.intersection(parts)
        if found and not (found <= TITLE_PARTS and (in_article or ARTICLE_WORDS.intersection(parts) - {"page", "site"})):
            return True
    return False


class Page:
    """Elements (parent, path, name and what they are) and blocks (element, text, characters in links), in page order."""

    def __init__(self, html: str):
        self.parent, self.path, self.name = [-1], [0], ["#root"]
        self.never, self.doubtful, self.place = [False], [False], [""]
        self.blocks: list[tuple[int, str, int]] = []
        self._paths: dict[tuple[int, str], int] = {}
        self._open: list[tuple[str, int, bool]] = [("#root", 0, False)]  # name, block element, in a link
        self._is_block, self._names = [True], Counter()
        self._parts: list[str] = []
        self._linked = 0
        self._read(html)

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            tag = html.find("<", at)
            if tag < 0:
                self._text(html[at:])
                break
            if tag > at:
                self._text(html[at:tag])
            m = TAG.match(html, tag)
            if m is None:  # a lone "<"
                self._text("<")
                at = tag + 1
                continue
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                self._end(name)
                continue
            if name not in UNSEEN:
                self._start(name, m[3] or "")
            if name in RAW:
                close = RAW_END[name].search(html, at)
                at = close.start() if close else size
        self._flush()

    def _text(self, raw: str) -> None:
        text = html_entities.unescape(raw) if "&" in raw else raw
        self._parts.append(text)
        if self._open[-1][2]:
            self._linked += len("".join(text.split()))

    def _flush(self) -> None:
        text = " ".join("".join(self._parts).split()) if self._parts else ""
        if text:
            self.blocks.append((self._open[-1][1], text, self._linked))
        self._parts, self._linked = [], 0

    def _start(self, name: str, attributes: str) -> None:
        here, in_article = self._open[-1][1], self._names["article"] > 0
        given: dict[str, str] = {}
        never, doubtful = name in NEVER or name in RAW, name in MOSTLY_NOT and not (name == "header" and in_article)
        if attributes and not attributes.isspace():
            given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        if given:
            unseen = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(given.get("style", "")))
            never = never or unseen or (given.get("role", "").lower() in ROLES and name != "article")
            doubtful = name not in ("html", "body", "main") and (doubtful or any(says_boilerplate(given.get(a, ""), in_article) for a in ("class", "id")))
        if name in SPACING:
            self._parts.append("\n")
        if name in VOID or (attributes.endswith("/") and self._names["svg"] + self._names["math"] > 0):
            return
        block = name in BLOCK or never or doubtful
        if not block:
            self._push(name, here, self._open[-1][2] or name == "a", False)
            return
        self._flush()
        if name in BLOCK:
            self._end_implied({"p"}, P_SCOPE)
        if name in IMPLIED_END:
            self._end_implied(*IMPLIED_END[name])
        above = self._open[-1][1]
        classes = given.get("class", "").split()
        step = (self.path[above], f"{name}.{classes[0].lower()}" if classes else name)
        self.parent.append(above)
        self.path.append(self._paths.setdefault(step, len(self._paths) + 1))
        self.name.append(name)
        self.never.append(never)
        self.doubtful.append(doubtful)
        place = "article" if name == "article" else "main" if name == "main" or given.get("role", "").lower() == "main" else "body" if given.get("itemprop", "").lower() == "articlebody" else ""
        self.place.append("" if never or doubtful else place)
        self._push(name, len(self.parent) - 1, self._open[-1][2], True)

    def _push(self, name: str, element: int, linked: bool, block: bool) -> None:
        self._open.append((name, element, linked))
        self._is_block.append(block)
        self._names[name] += 1

    def _cut(self, i: int) -> None:
        for name, _, _ in self._open[i:]:
            self._names[name] -= 1
        del self._open[i:], self._is_block[i:]

    def _end_implied(self, names: set[str], scope: frozenset[str] | set[str]) -> None:
        if not any(self._names[x] for x in names):
            return
        for i in range(len(self._open) - 1, 0, -1):
            if self._open[i][0] in names:
                return self._cut(i)
            if self._open[i][0] in scope:
                return None

    def _end(self, name: str) -> None:
        if name in SPACING:
            self._parts.append("\n")
        if not self._names[name]:
            if name in BLOCK:
                self._flush()
            return
        i = next(k for k in range(len(self._open) - 1, 0, -1) if self._open[k][0] == name)
        if self._is_block[i]:
            self._flush()
            self._cut(i)
        elif not any(self._is_block[i + 1 :]):
            self._cut(i)
        else:  # an inline element that ends inside a block which began in it
            rest, kinds = self._open[i + 1 :], self._is_block[i + 1 :]
            self._cut(i)
            for (x, element, _), block in zip(rest, kinds, strict=True):
                self._push(x, element if block else self._open[-1][1], self._open[-1][2] or x == "a", block)


def by_path(path: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each block the mean of its path's values."""
    return (np.bincount(path, values) / np.maximum(np.bincount(path), 1))[path]


def smoothed(series: np.ndarray) -> np.ndarray:
    kernel = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
    around = lambda x: np.convolve(x, kernel)[REACH : REACH + len(x)]
    return around(series) / around(np.ones(len(series)))


def content_paths(path: np.ndarray, chars: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Whether each block's path is one of content. ``chars``: outside links."""
    ratios = [smoothed(by_path(path, x.astype(float))) for x in (chars, marks)]
    scaled = [r / r.max() if r.max() > 0 else np.ones(len(r)) for r in ratios]
    fused = np.sqrt(scaled[0] * scaled[1])
    return (by_path(path, fused) >= THRESHOLD * fused.std() - 1e-12) & (by_path(path, chars.astype(float)) > 0)


def main_text(html: str | None) -> str:
    """The blocks of the article, joined by blanks."""
    page = Page(html or "")
    if not page.blocks:
        return ""
    parent, n = page.parent, len(page.parent)
    size, holds_place = [0] * n, [bool(x) for x in page.place]
    for element, text, _ in page.blocks:
        size[element] += len(text)
    for i in range(n - 1, 0, -1):
        size[parent[i]] += size[i]
        holds_place[parent[i]] |= holds_place[i]
    seen, is_place = [not page.never[0]], [""]
    for i in range(1, n):
        aside = page.never[i] or (page.doubtful[i] and not holds_place[i] and not (page.name[i] == "form" and not holds_place[0] and 2 * size[i] > size[0]))
        seen.append(seen[parent[i]] and not aside)
        is_place.append(page.place[i] if seen[i] else "")
    blocks = [b for b in page.blocks if seen[b[0]]]
    if not blocks:
        return ""
    path = np.array([page.path[e] for e, _, _ in blocks])
    length = np.array([len(t) for _, t, _ in blocks])
    linked = np.minimum([k for _, _, k in blocks], length)
    marks = np.array([sum(map(t.count, MARKS)) for _, t, _ in blocks])
    chosen = content_paths(path, length - linked, marks)
    inside, whole = place_of(page, blocks, chosen, length, is_place)
    prose = linked <= LINKED * length
    if whole:  # nothing tells the text's place: what lies around the chosen blocks is left out, but for headings before them
        at = np.flatnonzero(chosen & prose)
        if not len(at):
            return ""
        first = int(at[0])
        while first and page.name[blocks[first - 1][0]] in ("h1", "h2", "h3") and prose[first - 1]:
            first -= 1
        inside = inside & (np.arange(len(blocks)) >= first) & (np.arange(len(blocks)) <= at[-1])
    lists = np.array([page.name[e] in ("li", "ul", "ol", "dd", "td", "div", "section") for e, _, _ in blocks])
    return " ".join(t for (_, t, _), keep in zip(blocks, inside & (prose | (~lists & (not whole))), strict=True) if keep)


def place_of(page: Page, blocks: list[tuple[int, str, int]], chosen: np.ndarray, length: np.ndarray, is_place: list[str]) -> tuple[np.ndarray, bool]:
    """Which blocks lie where the main text is, and whether that is but the whole page."""
    parent, total = page.parent, int(length[chosen].sum())
    for kind in ("article", "main", "body"):
        if kind in is_place:
            within = [False] * len(parent)
            for i in range(1, len(parent)):
                within[i] = within[parent[i]] or is_place[i] == kind
            inside = np.array([within[e] for e, _, _ in blocks])
            if inside.any() and 2 * int(length[inside & chosen].sum()) >= total * (kind != "article"):
                return inside, False
    weight, text = [0] * len(parent), [0] * len(parent)
    for (e, _, _), c, k in zip(blocks, chosen, length.tolist(), strict=True):
        weight[e] += k * bool(c)
        text[e] += k
    own = list(weight)
    for i in range(len(parent) - 1, 0, -1):
        weight[parent[i]] += weight[i]
        text[parent[i]] += text[i]
    heaviest, alike = [0] * len(parent), Counter((parent[i], page.path[i]) for i in range(1, len(parent)) if text[i])
    for i in range(1, len(parent)):
        if weight[i] > weight[heaviest[parent[i]]] or not heaviest[parent[i]]:
            heaviest[parent[i]] = i
    place = 0
    while (below := heaviest[place]) and total and not own[place] and weight[below] >= HELD * total:
        if page.name[below] in TEXT_LEAVES or alike[place, page.path[below]] > 1:
            break
        place = below
    within = [False] * len(parent)
    within[place] = True
    for i in range(place + 1, len(parent)):
        within[i] = within[parent[i]]
    return np.array([within[e] for e, _, _ in blocks]), page.name[place] in ("#root", "html", "body")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col)

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, htmls in pieces(batch.column("html")):
                texts = [main_text(h) for h in htmls.to_pylist()]
                known = [batch.column(c).slice(at, len(texts)) for c in ("page_id", "url")]
                yield pa.RecordBatch.from_arrays([*known, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(extracted, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
