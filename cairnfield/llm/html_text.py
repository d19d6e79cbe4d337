"""The main text of web pages: parser events, text-to-tag ratios and content regions."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cairnfield.llm._common import distinct, small

# Element names of HTML, grouped by what they mean for a page's text.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
#: Never part of the text.
UNSEEN = frozenset("head title script style noscript template svg math canvas object iframe audio video map button select textarea option label dialog menu".split())
#: Parts of a page around its text.
AROUND = frozenset("nav aside footer".split())
CONTENT = frozenset("article main".split())
#: Blocks that close an open paragraph.
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: An element that ends the open element of the second set, if no element of the third is between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Blocks of running text, kept within a content region also where they are short.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt figcaption td th summary".split())
# Words of class, id and role that name what surrounds a text.
COMMENTS = frozenset("comment comments commentlist commenters disqus replies respond discussion".split())
HEADS = frozenset("header masthead topbar".split())
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification "
    "popup modal overlay sidebar sidebars aside menu menus nav navbar navigation navigational breadcrumb breadcrumbs pagination pager footer "
    "related recommended recommendations share sharing social newsletter subscribe subscription signup login search skip widget widgets toolbar".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tooltip".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements and attributes that tell what a part of a page is.
TELLING = UNSEEN | AROUND | {"form", "header"}
WATCHED = frozenset("class id role style hidden aria-hidden".split())
CUT_OFF = re.compile(r"<[a-zA-Z/!?]")
UNSHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

#: Lines over which ratios are smoothed, as the deviation of a Gaussian.
SIGMA = 2.0
#: A line is content if its smoothed ratio is over this many deviations of the page's ratios.
THRESHOLD = 0.5
#: Share of a page's text, or of its selected text, that an element must hold.
MOST, NEARLY_ALL = 0.5, 0.9

KEPT, SOFT, HARD = 0, 1, 2


class Lines(HTMLParser):
    """Reads parser events into lines, which are the texts between ends of blocks.

    ``text, tags, linked, owner, prose``: of each line the text, the tags since the last line, the
    characters in links, the element it stands in and whether that is a block of running text.
    ``parent, name, mark``: of each element. ``mark`` tells what it is around the text by
    itself: HARD by its kind, SOFT by its class, id or role or as a form.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text, self.tags, self.linked, self.owner, self.prose = [], [], [], [], []
        self.parent, self.name, self.mark = [-1], ["#page"], [KEPT]
        self.stack, self.open = [0], defaultdict(int)
        self.words, self.n_tags, self.n_linked = [], 0, 0

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers aren't needed."""
        return j

    def _break(self) -> None:
        if self.words:
            if text := " ".join("".join(self.words).split()):
                block = next(self.name[e] for e in reversed(self.stack) if self.name[e] not in INLINE)
                self.text.append(text)
                self.tags.append(self.n_tags)
                self.linked.append(self.n_linked)
                self.owner.append(self.stack[-1])
                self.prose.append(block in PROSE)
                self.n_tags = 0
            self.words, self.n_linked = [], 0

    def _close(self, to: int) -> None:
        """Ends the open elements from place ``to`` of the stack on."""
        ended = self.stack[to:]
        if self.words and any(self.name[e] not in INLINE or self.mark[e] for e in ended):
            self._break()
        for e in ended:
            self.open[self.name[e]] -= 1
        del self.stack[to:]

    def _end_open(self, names: set[str], fence: set[str]) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            name = self.name[self.stack[k]]
            if name in names:
                self._close(k)
                return
            if name in fence:
                return

    def _marked(self, tag: str, attrs: dict[str, str | None]) -> int:
        if tag in ("html", "body"):
            return KEPT
        if tag in UNSEEN or "hidden" in attrs or attrs.get("aria-hidden") == "true" or UNSHOWN.search((attrs.get("style") or "").lower()):
            return HARD
        words = {w.lower() for a in ("class", "id") for w in WORD.findall(attrs.get(a) or "")}
        if words & COMMENTS:
            return HARD
        if tag in CONTENT:
            return KEPT
        if tag in AROUND:
            return HARD
        if (tag == "header" or words & HEADS) and not any(self.open[c] for c in CONTENT):
            return SOFT
        return SOFT if tag == "form" or words & NAMED or (attrs.get("role") or "").lower() in ROLES else KEPT

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.n_tags += 1
        if tag in VOID:
            if tag in ("br", "hr"):
                self.words.append("\n")
            return
        if tag in CLOSES_P and self.open["p"]:
            self._end_open({"p"}, {"button", "table", "td", "th", "object"})
        if tag in IMPLIED and any(self.open[n] for n in IMPLIED[tag][0]):
            self._end_open(*IMPLIED[tag])
        mark = KEPT
        if tag in TELLING or any(a in WATCHED for a, _ in attrs):
            mark = self._marked(tag, dict(attrs))
        if self.words and (mark or tag not in INLINE):
            self._break()
        self.stack.append(len(self.name))
        self.parent.append(self.stack[-2])
        self.name.append(tag)
        self.mark.append(mark)
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open["svg"] + self.open["math"]:
            self._close(len(self.stack) - 1)

    def handle_endtag(self, tag: str) -> None:
        self.n_tags += 1
        if not self.open[tag]:
            if tag in CLOSES_P:
                self._break()
            return
        k = len(self.stack) - 1
        inline = tag in INLINE
        while (name := self.name[self.stack[k]]) != tag:
            if inline and name not in INLINE:
                return
            k -= 1
        self._close(k)

    def handle_data(self, data: str) -> None:
        self.words.append(data)
        if self.open["a"]:
            self.n_linked += len(data)

    def close(self) -> None:
        if not self.cdata_elem and CUT_OFF.match(self.rawdata):
            self.rawdata = ""  # the page ends within a tag or a comment
        super().close()
        self._break()


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """The ratios with a Gaussian over their neighbours; beyond the ends they are mirrored."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(ratios, reach, mode="symmetric") if len(ratios) else ratios
    return np.convolve(padded, kernel / kernel.sum(), mode="valid") if len(ratios) else ratios


def clustered(ratios: np.ndarray) -> np.ndarray:
    """True for lines of content: the smoothed ratio is over THRESHOLD deviations of all ratios."""
    return smoothed(ratios) > THRESHOLD * ratios.std() if len(ratios) else np.zeros(0, bool)


def _downward(page: Lines, own: list[int], lift: bool = False) -> np.ndarray:
    """For each element the greatest mark of itself and what it stands in; with ``lift``, an article or a
    main part isn't in what has a soft mark."""
    out = [KEPT] * len(own)
    for e in range(1, len(own)):
        above, mark = out[page.parent[e]], own[e]
        if above and not (lift and above == SOFT and mark == KEPT and page.name[e] in CONTENT):
            mark = max(above, mark)
        out[e] = mark
    return np.array(out)


def _held(page: Lines, owner: np.ndarray, weight: np.ndarray) -> list[float]:
    """The weight of the lines within each element; elements come after what they stand in."""
    total = np.bincount(owner, weight, len(page.name)).tolist()
    for e in range(len(total) - 1, 0, -1):
        if total[e]:
            total[page.parent[e]] += total[e]
    return total


def _within(page: Lines, root: int) -> np.ndarray:
    out = [False] * len(page.name)
    out[root] = True
    for e in range(root + 1, len(out)):
        out[e] = out[page.parent[e]]
    return np.array(out)


def _under(page: Lines, e: int, root: int) -> bool:
    while e > root:
        e = page.parent[e]
    return e == root


def main_text(html: str) -> str:
    """The text of the page's article; see ``extract``."""
    page = Lines()
    page.feed(html)
    page.close()
    if not page.text:
        return ""
    size = np.array([len(t) for t in page.text], float)
    owner = np.array(page.owner)
    for lift in (False, True):
        # lifted where no article is clean: a form is around the page, or an advert isn't closed
        marks = _downward(page, page.mark, lift)
        clean = _held(page, owner, np.where(marks[owner] == KEPT, size, 0))
        has_content = any(n in CONTENT and marks[e] == KEPT and clean[e] for e, n in enumerate(page.name))
        if has_content:
            break
    shown = np.where(marks[owner] == HARD, 0, size)
    if not has_content and shown.sum():
        # a form or a part named like an advert that holds most of the page is the page
        held = _held(page, owner, shown)
        own = [KEPT if m == SOFT and held[e] > MOST * held[0] else m for e, m in enumerate(page.mark)]
        marks = _downward(page, own)
    clean = marks[owner] == KEPT
    ratios = np.where(clean, size, 0) / np.maximum(np.array(page.tags), 1)
    content = clustered(ratios) & clean
    if not content.any():
        content = clean
    selected = _held(page, owner, np.where(content, size, 0))
    shown = _held(page, owner, np.where(clean, size, 0))
    articles = [e for e, n in enumerate(page.name) if n in CONTENT and marks[e] == KEPT and shown[e]]
    root = max(articles, key=lambda e: (selected[e], shown[e], -e), default=None)
    if root is not None:
        # a main part around one article; or the article itself, however short beside other text
        inner = [e for e in articles if _under(page, e, root) and shown[e] >= NEARLY_ALL * shown[root]]
        alone = all(_under(page, e, root) or _under(page, root, e) for e in articles)
        if alone or selected[root] >= MOST * selected[0]:
            keep = clean & _within(page, max(inner))[owner]
            return " ".join(t for t, k in zip(page.text, keep, strict=True) if k)
    root = 0
    for e, n in enumerate(page.name):
        # the deepest part that holds nearly all; a block of text alone isn't a part
        if n not in PROSE and n not in INLINE and selected[e] >= NEARLY_ALL * selected[0] and page.parent[e] in (root, -1):
            root = e
    linked = np.array(page.linked) > MOST * size
    prose = np.array(page.prose) & ~linked
    keep = clean & _within(page, root)[owner] & (content & ~linked | prose)
    return " ".join(t for t, k in zip(page.text, keep, strict=True) if k)


def extract(pages: DataFrame, keep: Iterable[str] = ("page_id", "url")) -> DataFrame:
    """``keep, text, n_chars``: the main text of every page and its code points.

    Takes ``html`` and the kept columns. The parser's events become lines, one for each block, with
    their text-to-tag ratio; ratios are smoothed by a Gaussian along the page, and lines over a threshold are
    clusters of content. Of the page's articles and main parts the one with most of that
    content is the region; all its blocks are kept, short ones too. A page without such an element has as
    region the deepest part that holds nearly all content; there, blocks of running text are kept, other
    lines if they are content and not mostly links. Left out are navigation,
    asides, footers, page headers, forms, hidden elements, scripts and styles, comments of readers, and what a
    class, id or role names as such (COMMENTS, HEADS, NAMED, ROLES).

    A row is read by itself; a task holds one slice of pages (``small``) and one page's lines.

    Defined cases: null html is empty; a page without text gives an empty text and 0; null page_id or url
    stay null; repeated rows stay repeated; pages of any length are read whole; an empty
    table gives no rows; columns that aren't kept are ignored, a kept one named ``text`` or ``n_chars`` is an error;
    white space is what Unicode calls so; a line break is white space; inline markup doesn't part words.
    """
    kept = distinct(keep, "text", "n_chars")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "html"):
            texts = [main_text(h or "") for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"]
            )

    kinds = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in kept)
    return pages.select(*dict.fromkeys([*kept, "html"])).mapInArrow(run, f"{kinds}text string, n_chars long")


#: For pages that hold one plain article with paragraphs, as the given ones do.
SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') AS body FROM pages
), bare AS (
  SELECT page_id, url, regexp_replace(regexp_replace(body, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS body FROM a
), read AS (
  SELECT page_id, url, regexp_replace(replace(replace(replace(replace(body, '&quot;', '"'), '&#x27;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS body FROM bare
)
SELECT page_id, url, trim(regexp_replace(body, '\s+', ' ', 'g')) AS text, CAST(length(trim(regexp_replace(body, '\s+', ' ', 'g'))) AS BIGINT) AS n_chars FROM read
"""
