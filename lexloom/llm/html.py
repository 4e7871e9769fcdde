"""Main-text extraction by text-to-tag ratios.

The standard library's parser streams events; each block-level border ends a line, and a
line knows its text, its share of link text, the tags seen in it and the elements around
it.  A line's ratio of text outside links to tags is smoothed over its neighbours with a
Gaussian; lines above a threshold (a share of the page's deviation) form the content
clusters.  The region is the smallest container that holds nearly all of their text, widened
to the article it is part of, and its lines are returned in page order, short ones too.  On
a page without article and main the other containers with content lines, the paragraphs and
headings between them and the h1 before them belong to it too.

Lines inside menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments never count: they are told by their elements, roles, and the words in
class and id.  Inside an article or main these words are no sign on headings, paragraphs and
inline elements, and a class or id of several words, not all of them such words, is one only where the
element is also mostly links, holds a form, or has little text to its tags.  A form that holds the
first heading, an article or most paragraphs is the page's layout and stays; so does the header of an entry.
Several articles of a page all belong to its text where each has more than one line of prose.
Scripts, pictures and controls inside a paragraph leave it one block; formulas are text.
Elements that a page left open are closed by their containers.

Defined results: a null or empty page gives an empty text, as does one without text; very
long pages are read whole; rows are independent, so repeated rows repeat their result;
columns of the input other than the identifier, url and html are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre section summary table"
    " tbody td textarea tfoot th thead title tr ul template".split()
)
CONTAINER = frozenset("article main section div body td center html".split())
SKIPPED = frozenset(
    "script style head title noscript template nav footer aside form button select textarea iframe svg object audio video canvas menu dialog fieldset option".split()
)
#: Skipped elements that may stand inside a line, which goes on after them.
MUTE = frozenset("script style button select svg object audio video canvas".split())
#: Forms may be the layout of a page.
FORMS = frozenset("form fieldset".split())
#: Words of an element around one entry, whose header is its own.
ENTRY = frozenset("article entry post story hentry".split())
#: Words that say nothing about what an element holds.
NEUTRAL = frozenset("box block container wrapper wrap section area list slot unit bar panel button buttons link links item items inner outer content group row col holder module large small big medium wide top bottom left right inline".split())
WORDS = frozenset(
    "nav navigation navbar menu menus breadcrumb breadcrumbs sidebar sidebars aside footer foot masthead cookie cookies consent gdpr notice notices banner banners alert"
    " ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion comment comments disqus reply replies respond"
    " newsletter subscribe subscription signup login share sharing social related recommended popup modal overlay widget widgets pagination pager toolbar skip".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Elements whose content is text only, marks of tags and comments included.
PLAIN = frozenset("textarea title".split())
#: Never left out for the words in their class or id.
KEPT = frozenset("html body main article".split())
#: Elements of running text, where words in class and id say nothing inside an article.
RUNNING = frozenset("h1 h2 h3 h4 h5 h6 p".split())
#: Words for readers' comments, which are prose too: a sign by themselves.
READERS = frozenset("comments disqus replies respond".split())
CONTROLS = frozenset("form textarea".split())
#: Parts of a class or id of an article's body.
ENTRY_WORDS = frozenset("article entry post story".split())
ENTRY_PARTS = frozenset("body content main text full inner wrap wrapper container page single".split())
#: What the last line of a page begins with that is no part of its text.
_RIGHTS = re.compile(r"(?i)(?:©|\(c\)\s|copyright\b)")
#: Words inside a class or id.
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
SMOOTH, THRESHOLD, SHARE, LITTLE, LAYOUT = 1.0, 0.5, 0.8, 10, 600


def _is_entry(name: str) -> bool:
    """Whether a class or id says that an element is an article's body: by itself, or by its parts."""
    parts = {x.lower() for x in _PART.findall(name)}
    return name.lower() in ENTRY or (not parts.isdisjoint(ENTRY_WORDS) and len(parts) > 1 and parts <= ENTRY_WORDS | ENTRY_PARTS)


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)

    def begin(self) -> None:
        self.reset()
        self.closes: dict[str, bool] = {}
        # open elements: tag, number, whether what it holds is muted, and whether it is in an entry
        self.open: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
        # of every element: the one around it, its tag, and whether it is left out by itself (2: by words only, 3: by words in need of a second sign)
        self.parent: list[int] = [-1]
        self.tag: list[str] = ["html"]
        self.out: list[int] = [0]
        self.text: list[str] = []
        self.links = self.tags = self.in_link = 0
        self.lines: list[tuple[str, int, int, int]] = []  # text, element, letters in links, tags

    def _end_line(self) -> None:
        if self.text:
            words = "".join(self.text).split()
            if words:
                self.lines.append((" ".join(words), self.open[-1][1], self.links, self.tags))
                self.links = self.tags = 0
            self.text = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if self.open[-1][2]:
            if tag not in VOID:
                self._push(tag, attrs)
            return
        if tag not in BLOCK:
            if tag == "br":
                self.text.append(" ")
            elif tag == "a":
                self.in_link += 1
            if tag in MUTE or tag in SKIPPED or (attrs and tag not in VOID and self._hidden(tag, attrs)):
                self._push(tag, attrs)
            return
        self._end_line()
        self.in_link = 0
        if tag in VOID:
            return
        if tag in PLAIN and self._closes(tag):
            self.set_cdata_mode(tag)
        opened = self.open
        # elements whose end may be left out
        if opened[-1][0] == "p":
            opened.pop()
        elif tag == "li" and opened[-1][0] == "li":
            opened.pop()
        elif tag in ("td", "th", "tr") and opened[-1][0] in ("td", "th"):
            opened.pop()
            if tag == "tr" and opened[-1][0] == "tr":
                opened.pop()
        elif tag in ("dt", "dd") and opened[-1][0] in ("dt", "dd"):
            opened.pop()
        self._push(tag, attrs)

    def _closes(self, tag: str) -> bool:
        """Whether every such element of the page has its end, so that none swallows the rest."""
        if tag not in self.closes:
            page = self.rawdata.lower()
            self.closes[tag] = page.count(f"</{tag}") >= page.count(f"<{tag}")
        return self.closes[tag]

    def _push(self, tag: str, attrs: list) -> None:
        out = 0
        _, up, mute, entry = self.open[-1]
        if tag in SKIPPED or (tag == "header" and not entry):
            out = 1
        elif attrs and tag not in KEPT:
            out = self._hidden(tag, attrs)
        mute = mute or tag in MUTE or (out == 2 and tag not in BLOCK and any(x in ("hidden", "aria-hidden", "style") for x, _ in attrs))
        entry = entry or tag in ("article", "main") or (tag in ("div", "section") and any(n in ("class", "id") and v and any(map(_is_entry, v.split())) for n, v in attrs))
        self.parent.append(up)
        self.tag.append(tag)
        self.out.append(out)
        self.open.append((tag, len(self.tag) - 1, mute, entry))

    def _hidden(self, tag: str, attrs: list) -> int:
        """0, 2 or 3, as in ``out``."""
        weak = 0
        for name, value in attrs:
            if name == "hidden":
                return 2
            if not value:
                continue
            if name in ("class", "id"):
                parts = {x.lower() for x in _PART.findall(value)}
                if not WORDS.isdisjoint(parts):
                    if not any(x[0] in ("article", "main") for x in self.open):
                        return 2
                    if tag in RUNNING or tag not in BLOCK:
                        continue
                    names = ({x.lower() for x in _PART.findall(one)} - NEUTRAL for one in value.split())
                    if parts & READERS or any(x and x <= WORDS for x in names):
                        return 2
                    weak = 3
                elif "header" in parts and tag == "div" and not parts & {"article", "entry", "post"}:
                    return 2
            elif name == "role":
                if value.lower() in ROLES:
                    return 2
            elif name == "aria-hidden":
                if value.lower() == "true":
                    return 2
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
                return 2
        return weak

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        self.clear_cdata_mode()
        if tag not in VOID and (tag in BLOCK or self.open[-1][0] == tag):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        opened = self.open
        if opened[-1][2]:
            held = next((k for k in range(len(opened) - 1, 0, -1) if opened[k][0] == tag), 0)
            if not held or opened[held][2]:  # an end inside what is muted
                del opened[held or len(opened) :]
                return
        if tag in BLOCK:
            self._end_line()
        elif tag == "a" and self.in_link:
            self.in_link -= 1
        if opened[-1][0] == tag:
            opened.pop()
            return
        if tag in BLOCK or tag in SKIPPED or any(x[0] == tag for x in opened[-3:]):
            for k in range(len(opened) - 1, 0, -1):
                if opened[k][0] == tag:
                    del opened[k:]
                    return
                # an end tag does not reach beyond the article or region it stands in
                if opened[k][0] in ("article", "main", "body", "table", "aside", "nav", "footer", "form") and tag not in CONTAINER:
                    return

    def handle_data(self, data: str) -> None:
        if self.open[-1][2]:
            return
        self.text.append(data)
        if self.in_link:
            self.links += len(data)


def _smoothed(ratio: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.convolve(ratio, kernel)[reach:-reach]
    return padded / np.convolve(np.ones(len(ratio)), kernel)[reach:-reach]


def _around(page: _Page, lines: list[tuple], content: list[bool], held: list[int], root: int) -> set[int]:
    """Lines outside ``root`` that belong to it: all content lines, with what stands between them in their containers."""
    top = max(k for k in range(len(held)) if held[k] == held[0] and (k == 0 or page.tag[k] in CONTAINER))
    path, at = {top}, root
    while at > top:
        path.add(at)
        at = page.parent[at]
    n = len(page.tag)
    # of every element: the part it is in (the element right below the path), and the smallest element of a part that holds all its content
    part, within = [-1] * n, {}
    for k in range(top, n):
        up = page.parent[k]
        if k not in path and up >= top:
            part[k] = k if up in path else part[up]
            if held[k] and part[k] >= 0 and held[k] == held[part[k]]:
                within[part[k]] = k
    holds = set(within.values())
    near = [False] * n
    for k in range(top, n):
        near[k] = part[k] >= 0 and (k in holds or near[page.parent[k]])
    out = set()
    for number, (line, good) in enumerate(zip(lines, content, strict=True)):
        at = line[1]
        loose = (at in path or (part[at] == at and page.tag[at] not in CONTAINER and not held[at])) and 2 * line[2] < len(line[0]) and not _RIGHTS.match(line[0])
        if good or near[at] or loose:
            out.add(number)
    return out


def _second_sign(page: _Page) -> None:
    """Settles elements told by a word in a longer id: left out where their links, controls or tags say so too."""
    n = len(page.tag)
    letters, links, tags, control = [0] * n, [0] * n, [0] * n, [x in CONTROLS for x in page.tag]
    for text, at, linked, marks in page.lines:
        letters[at] += len(text)
        links[at] += linked
        tags[at] += marks
    for k in range(n - 1, 0, -1):
        up = page.parent[k]
        letters[up] += letters[k]
        links[up] += links[k]
        tags[up] += tags[k]
        control[up] |= control[k]
        if page.out[k] == 3:
            little = letters[k] - links[k] < LITTLE * max(1, tags[k])
            page.out[k] = 2 if control[k] or 2 * links[k] >= letters[k] or little else 0


def _layout_forms(page: _Page, holds: list[bool]) -> set[int]:
    """Forms around the page's heading, an article, or most of its paragraphs."""
    n = len(page.tag)
    prose, article = [0] * n, [x == "article" for x in page.tag]
    for text, at, linked, _ in page.lines:
        if page.tag[at] == "p":
            prose[at] += len(text) - linked
    for k in range(n - 1, 0, -1):
        prose[page.parent[k]] += prose[k]
        article[page.parent[k]] |= article[k]
    return {k for k in range(n) if page.tag[k] in FORMS and (holds[k] or article[k] or 2 * prose[k] > max(prose[0], LAYOUT))}


def _kept(page: _Page) -> list[tuple]:
    """Lines outside all elements that are left out.

    Words in class or id do not count where the element holds the page's main part or its
    first heading: then they describe the layout around it.
    """
    n = len(page.tag)
    holds = [False] * n
    for k in range(n):
        if page.tag[k] == "main" or page.tag[k] == "h1":
            while k >= 0 and not holds[k]:
                holds[k] = True
                k = page.parent[k]
    if 3 in page.out:
        _second_sign(page)
    layout = _layout_forms(page, holds) if not FORMS.isdisjoint(page.tag) else set()
    out, words = [False] * n, [False] * n
    for k in range(1, n):
        up = page.parent[k]
        words[k] = words[up] or page.out[k] == 2
        out[k] = out[up] or (page.out[k] == 1 and k not in layout) or (page.out[k] == 2 and not holds[k])
    kept = [x for x in page.lines if not out[x[1]]]
    # a page that is marked as a notice or the like as a whole
    return kept or [x for x in page.lines if words[x[1]]]


def _lone(page: _Page, lines: list[tuple]) -> int:
    """The only article of a page, or else its only main part, where it holds a heading or more than one line of prose; 0 if there is none.

    It is the region however much stands beside it: a discussion may be longer than what is discussed.
    """
    if "article" not in page.tag and "main" not in page.tag:
        return 0
    around = {name: [0] * len(page.tag) for name in ("article", "main")}  # of every element: the outermost one around it
    for k in range(1, len(page.tag)):
        for name, of in around.items():
            of[k] = of[page.parent[k]] or (k if page.tag[k] == name else 0)
    prose = [(x[1], page.tag[x[1]] in ("h1", "h2")) for x in lines if 2 * x[2] < len(x[0])]
    for name, of in around.items():
        found = {of[at] for at, _ in prose} - {0}
        if len(found) > 1:  # the further articles of a page are told apart later
            return 0
        if not found:
            continue
        one = found.pop()
        mine = [heading for at, heading in prose if of[at] == one]
        # a main part beside the article, with prose of its own, is the page's text
        beside = name == "article" and not around["main"][one] and any(around["main"][at] and of[at] != one for at, _ in prose)
        if not beside and (any(mine) or len(mine) > 1):
            return one
    return 0


def _further_articles(page: _Page, lines: list[tuple], content: list[bool], root: int) -> list[int]:
    """Articles beside the one that is the region: those with more than one line of prose, no mere teasers."""
    if page.tag[root] != "article" or page.tag.count("article") < 2:
        return []
    article = [0] * len(page.tag)  # of every element: the outermost article around it
    for k in range(1, len(article)):
        article[k] = article[page.parent[k]] or (k if page.tag[k] == "article" else 0)
    prose: dict[int, list[int]] = {}
    for (text, at, linked, _), good in zip(lines, content, strict=True):
        if good and article[at] and not linked:
            prose.setdefault(article[at], []).append(len(text))
    least = sum(prose.get(article[root], [0])) / 20
    return [k for k, found in prose.items() if k != article[root] and len(found) > 1 and sum(found) >= least]


def main_text(html: str | None, page: _Page | None = None) -> str:
    """The main text of a page: its blocks, joined by an empty line."""
    if not html:
        return ""
    page = page or _Page()
    page.begin()
    page.feed(html)
    if page.cdata_elem is None and page.rawdata.startswith("<!--"):  # a comment left open runs to the end
        page.rawdata = ""
    page.close()
    page._end_line()
    lines = _kept(page)
    if not lines:
        return ""
    ratio = np.array([max(0, len(x[0]) - x[2]) / max(1, x[3]) for x in lines])
    smooth = _smoothed(ratio, SMOOTH)
    prose = np.array([2 * x[2] < len(x[0]) for x in lines])  # a list of links beside the text does not join its cluster
    content = (smooth >= THRESHOLD * ratio.std()) & (ratio > 0) & prose
    if not content.any():
        content = np.ones(len(lines), bool)
    # the smallest container that holds nearly all text of the clusters
    size = [len(x[0]) if good else 0 for x, good in zip(lines, content.tolist(), strict=True)]
    held = [0] * len(page.tag)
    for x, n in zip(lines, size, strict=True):
        held[x[1]] += n
    for k in range(len(held) - 1, 0, -1):
        held[page.parent[k]] += held[k]
    enough = SHARE * held[0]
    root = 0
    for k in range(1, len(held)):
        if held[k] >= enough and page.tag[k] in CONTAINER:
            root = k
    at, marked = _lone(page, lines) or root, False
    while at > 0:
        if page.tag[at] in ("article", "main"):
            root, marked = at, True
            if page.tag[at] == "article":
                break
        at = page.parent[at]
    inside = [False] * len(page.tag)
    inside[root] = True
    for k in _further_articles(page, lines, content.tolist(), root):
        inside[k] = True
    for k in range(1, len(inside)):
        inside[k] = inside[k] or inside[page.parent[k]]
    chosen = [k for k, x in enumerate(lines) if inside[x[1]]]
    if not marked:
        chosen = sorted({*chosen, *_around(page, lines, content.tolist(), held, root)})
        # links and notes of rights that stand right in the page's body
        bare = lambda x: page.tag[x[1]] in ("body", "html") and (2 * x[2] >= len(x[0]) or _RIGHTS.match(x[0]))
        chosen = [k for k in chosen if not bare(lines[k])] or chosen
        first = [k for k, x in enumerate(lines[: chosen[0]]) if page.tag[x[1]] == "h1"]
        if first and not any(page.tag[lines[k][1]] == "h1" for k in chosen):
            chosen.insert(0, first[-1])
    # the heading right before the region belongs to it
    before = chosen[0] - 1
    if before >= 0 and page.tag[lines[before][1]] in ("h1", "h2") and not any(page.tag[lines[k][1]] == "h1" for k in chosen):
        chosen.insert(0, before)
    return "\n\n".join(lines[k][0] for k in chosen)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = _Page()
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                texts = [main_text(x, page) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    read = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = dict(read.dtypes)
    return read.mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
