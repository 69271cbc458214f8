"""Main text of web pages by tag-path ratios.

A page becomes blocks of text in order, each with its tag path from the root to the leaf. Text length and
punctuation are added up for each path and divided by its number of blocks; the product of the two ratios is
smoothed over neighbouring blocks, fused with the raw one, and held against a threshold. The blocks that pass
show where the text is. Where article and main elements hold half of their weight or more, it is all of these
elements that hold passing blocks, and what lies between them; otherwise the lowest element that holds every
passing block. Headings and passing blocks right before it belong to it, too. Every block in there is kept, but
for menus, headers, footers, sidebars, notices, adverts, forms, teasers, hidden elements and readers' comments, which
their elements' names and classes show where the weights do not speak against them. A single paragraph goes by its
name only if its path does not pass.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodeflow.llm.words import slices

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
#: Elements whose content is no markup, up to their end tag.
_RAW = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in "script style noscript template iframe textarea select svg title".split()}
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_BARE_HIDDEN = re.compile(r"(?<![^\s])hidden(?=[\s=/]|$)", re.I)
_UNSEEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_PARAGRAPH = _BLOCK - frozenset("body caption dd dt head html legend li option tbody td tfoot th thead tr".split())
#: An element that the start of another of these kinds closes, up to the elements named last.
_CLOSED_BY = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
_HIDDEN = frozenset("head select script style noscript template iframe textarea svg title input".split())
_LINKS = frozenset("nav footer button menu".split())
_FURNITURE = frozenset("aside form dialog label".split())
_FURNITURE_NAMES = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs complementary consent contentinfo cookie cookies footer gdpr "
    "masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion recommended related search share "
    "sharing sidebar skyscraper social sponsor sponsored subscribe teaser teasers toolbar trending widget widgets".split()
)
#: Names that say so only as a whole.
_WHOLE_NAMES = frozenset("also-like more-articles more-news more-posts more-stories most-read read-next up-next you-may-like".split())
_READER_NAMES = frozenset("comment commentlist comments disqus replies respond".split())
#: Ids and classes of a page's own header, outside its main elements.
_HEADER_IDS = frozenset("header masthead page-header site-header top-header".split())
_HEADER_CLASSES = _HEADER_IDS - {"header"}
#: Last parts of a name that say nothing themselves, so that the part before them counts; names with one of the others name what is elsewhere.
_CARRIERS = frozenset("area articles bar block body box button buttons container form inner item left links list posts right section signup slot unit wrap wrapper".split())
_ELSEWHERE = frozenset("has hide is no non show with without".split())
#: What an element is by its tag and names; a form and a paragraph with a name of furniture are weighed by rules of their own.
_OPEN, _LINE, _FORM, _NAMED, _READERS, _LINK, _HID, _UNSEEN = range(8)
#: Share of a page's characters that makes a form the page itself.
_WHOLE_PAGE = 0.9
_LANDMARK = frozenset(("article", "main"))
_MAIN_NAMES = frozenset("main main-content maincontent content-main site-main main_content".split())
_PUNCTUATION = re.compile(r"[,.;:!?…。，、！？]")
_SMOOTH = (1, 2, 3, 2, 1)
_THRESHOLD = 0.5
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are no furniture whatever their names.
_OWN_TEXT = _HEADINGS | {"html", "body"}
#: Elements that hold a text and not only one block of it.
_CONTAINERS = frozenset("article body center details dialog div dl fieldset form header hgroup html main ol section table ul".split())


@lru_cache(4096)
def _kind(name: str) -> int:
    """What a whole name, or its last part that says something, makes of an element."""
    parts = [x for x in re.split(r"[\s_-]+", name) if x]
    if "-".join(parts) in _WHOLE_NAMES:
        return _NAMED
    if not _ELSEWHERE.isdisjoint(parts):
        return _OPEN
    while len(parts) > 1 and (parts[-1] in _CARRIERS or parts[-1].isdigit()):
        parts.pop()
    last = parts[-1] if parts else ""
    return _READERS if last in _READER_NAMES else _NAMED if last in _FURNITURE_NAMES else _OPEN


class _Page:
    """A page's elements in document order, each after its parent, and its blocks: element and text, white space as single spaces.

    kind: what an element's own tag and names make of it; landmark: the outermost main element that holds it, itself
    included (-1: none); path: a number for its tag path with names; last: the last element within it.
    """

    def __init__(self, page: str) -> None:
        self.tags, self.parents, self.kinds, self.landmarks, self.paths = [""], [-1], [_OPEN], [-1], [0]
        self.apart = [False]
        self.known: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, str]] = []
        self._read(page)
        self.last = list(range(len(self.tags)))
        for e in range(len(self.tags) - 1, 0, -1):
            self.last[self.parents[e]] = max(self.last[self.parents[e]], self.last[e])

    def _add(self, tag: str, attributes: str, parent: int) -> int:
        names: list[str] = []
        of_id: list[str] = []
        unseen = "hidden" in attributes.lower() and bool(_BARE_HIDDEN.search(_QUOTED.sub("", attributes)))
        for key, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
            key, value = key.lower(), "".join(values).lower()
            if key in ("class", "id", "role"):
                names += value.split()
                of_id += value.split() if key == "id" else ()
            elif key == "style":
                unseen = unseen or bool(_UNSEEN_STYLE.search(value))
            elif key == "aria-label":
                names.append(value)
        above, kind = self.landmarks[parent], _OPEN
        if tag in _HIDDEN:
            kind = _HID
        elif tag in _LINKS:
            kind = _LINK
        elif unseen and tag not in ("html", "body"):
            kind = _UNSEEN
        elif tag == "form":
            kind = _FORM
        elif tag in _FURNITURE or (above < 0 and (tag == "header" or (tag == "div" and not (_HEADER_IDS.isdisjoint(of_id) and _HEADER_CLASSES.isdisjoint(names))))):
            kind = _NAMED
        elif tag == "p":
            kind = _LINE if any(_kind(n) == _NAMED for n in names if n not in of_id) else _OPEN
        elif names and tag not in _OWN_TEXT and (tag not in _LANDMARK or (tag == "article" and above >= 0)):
            kind = max(map(_kind, names))
        number = len(self.tags)
        own = tag in _LANDMARK or (kind == _OPEN and not _MAIN_NAMES.isdisjoint(names))
        step = (self.paths[parent], ".".join([tag, *names]))
        self.tags.append(tag)
        self.parents.append(parent)
        self.kinds.append(kind)
        self.landmarks.append(above if above >= 0 else number if own else -1)
        self.paths.append(self.known.setdefault(step, len(self.known) + 1))
        self.apart.append(kind > _LINE or self.apart[parent])
        return number

    def _read(self, page: str) -> None:
        stack, parts, owner = [0], [], []
        opened = defaultdict(list)  # by tag: the places in the stack
        tags, apart = self.tags, self.apart

        def flush() -> None:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                self.blocks.append((owner[0], text))
            parts.clear()
            owner.clear()

        def close(k: int) -> None:
            for e in stack[k:]:
                opened[tags[e]].pop()
            del stack[k:]

        def place(kinds: tuple[str, ...]) -> int:
            return max((opened[x][-1] for x in kinds if opened[x]), default=0)

        def close_to(kinds: tuple[str, ...], fence: tuple[str, ...]) -> None:
            k = place(kinds)
            if k > place(fence):
                flush()
                close(k)

        def write(text: str) -> None:
            if text:
                if not owner and not text.isspace():
                    owner.append(stack[-1])
                parts.append(text)

        at, end = 0, page.rfind(">") + 1  # behind it there is no tag
        unclosed: set[str] = set()
        while token := _TOKEN.search(page, at, end):
            write(page[at : token.start()])
            at = token.end()
            tag = (token[2] or token[5] or "").lower()
            if not tag:
                continue
            if token[1] or token[4]:
                if tag in _BLOCK:
                    flush()
                if k := place((tag,)):
                    if apart[stack[k]] != apart[self.parents[stack[k]]]:
                        flush()
                    close(k)
                continue
            if tag in _RAW and tag not in unclosed:
                if raw := _RAW[tag].search(page, at, end):
                    at = raw.end()
                    continue
                unclosed.add(tag)
            if tag in _ENDS_PARAGRAPH:
                close_to(("p",), ("table", "td", "th", "button", "caption"))
            if tag in _CLOSED_BY:
                close_to(*_CLOSED_BY[tag])
            if tag in _BLOCK:
                flush()
            if tag == "br":
                parts.append(" ")
            elif tag not in _VOID:
                element = self._add(tag, token[3] or token[6] or "", stack[-1])
                if apart[element] != apart[stack[-1]]:
                    flush()
                opened[tag].append(len(stack))
                stack.append(element)
        write(page[at:])
        flush()

    def inherited(self, marked: list[bool]) -> list[bool]:
        """Whether an element or one above it is marked."""
        found = list(marked)
        for e in range(1, len(found)):
            found[e] = found[e] or found[self.parents[e]]
        return found

    def held(self, weights: dict[int, float]) -> list[float]:
        """By element: the sum of the weights of all elements within it."""
        found = [0.0] * len(self.tags)
        for e, w in weights.items():
            found[e] += w
        for e in range(len(found) - 1, 0, -1):
            found[self.parents[e]] += found[e]
        return found

    def common(self, elements: set[int]) -> int:
        """The lowest element that holds all the given ones."""
        low, high = min(elements), max(elements)
        root = low
        while self.last[root] < high:
            root = self.parents[root]
        return root


def _least(scores: list[float]) -> float:
    """The score that a block must reach to pass."""
    return min(_THRESHOLD * sum(scores) / len(scores), max(scores))


def fused_scores(paths: list[int], texts: list[str]) -> list[float]:
    """For each block: its path's text length and punctuation ratios multiplied, fused with their smoothed course."""
    size, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for path, text in zip(paths, texts, strict=True):
        size[path] += len(text)
        marks[path] += len(_PUNCTUATION.findall(text))
        count[path] += 1
    ratio = [size[p] / count[p] * (1 + marks[p] / count[p]) for p in paths]
    half = len(_SMOOTH) // 2
    fused = []
    for i, own in enumerate(ratio):
        near = [(w, ratio[i + k - half]) for k, w in enumerate(_SMOOTH) if 0 <= i + k - half < len(ratio)]
        fused.append((own * sum(w * r for w, r in near) / sum(w for w, _ in near)) ** 0.5)
    return fused


def _sums(pairs: Iterable[tuple[int, float]]) -> dict[int, float]:
    found: dict[int, float] = defaultdict(float)
    for key, value in pairs:
        found[key] += value
    return found


def _skipped(page: _Page, fused: list[float]) -> list[bool]:
    """Whether each block is in furniture. An element is none, whatever its tag and names, if it holds a main
    element, most of the landmarks' weight or, but for lists of links and readers' comments, most of the passing
    weight there; a form must hold a heading of the first level or nearly all of the page instead. If that leaves no block, names do not
    count at all. Beside other nested articles, one without a passing block is a teaser.
    """
    blocks, kinds, landmark = page.blocks, page.kinds, page.landmarks
    nested = [page.tags[e] == "article" and landmark[e] not in (e, -1) for e in range(len(kinds))]
    if not any(page.apart[e] for e, _ in blocks) and not any(nested):
        return [False] * len(blocks)
    hidden = page.inherited([k in (_HID, _UNSEEN) for k in kinds])
    shown = [i for i, (e, _) in enumerate(blocks) if not hidden[e]]
    weight = [f * len(t) for f, (_, t) in zip(fused, blocks, strict=True)]
    rescued = [False] * len(kinds)

    def out(of: tuple[int, ...]) -> list[bool]:
        return page.inherited([k in of and not r for k, r in zip(kinds, rescued, strict=True)])

    def rescue(at: list[tuple[int, float]], of: tuple[int, ...], share: float = 0.5) -> None:
        most = share * sum(w for _, w in at)
        for e, w in enumerate(page.held(_sums(at))):
            if kinds[e] in of and w > most:
                rescued[e] = True

    marked = [(landmark[blocks[i][0]], i) for i in shown if landmark[blocks[i][0]] >= 0]
    for e, w in enumerate(page.held({m: 1.0 for m, _ in marked if page.tags[m] == "main"})):
        rescued[e] = w > 0
    rescue([(m, weight[i]) for m, i in marked], (_FORM, _NAMED, _READERS, _LINK))
    rescue([(blocks[i][0], len(blocks[i][1])) for i in shown], (_FORM,), _WHOLE_PAGE)
    for e, w in enumerate(page.held({e: 1.0 for e, tag in enumerate(page.tags) if tag == "h1"})):
        rescued[e] = rescued[e] or (kinds[e] == _FORM and w > 0)
    lost = out((_FORM, _NAMED, _READERS, _LINK))
    inside = [i for m, i in marked if not lost[m]]
    lost = out((_FORM, _READERS, _LINK))
    some = [i for i in inside or shown if not lost[blocks[i][0]]]
    least = _least([fused[i] for i in some]) if some else 0.0
    passing = [i for i in some if fused[i] >= least]
    rescue([(blocks[i][0], weight[i]) for i in passing], (_NAMED,))
    lost = out((_FORM, _NAMED, _READERS, _LINK, _HID, _UNSEEN))
    if all(lost[e] for e, _ in blocks):
        lost = out((_LINK, _HID))
    elif any(nested):
        held = page.held(_sums((blocks[i][0], 1.0) for i in passing if not lost[blocks[i][0]]))
        if any(n and h for n, h in zip(nested, held, strict=True)):
            teaser = page.inherited([n and not h for n, h in zip(nested, held, strict=True)])
            lost = [a or b for a, b in zip(lost, teaser, strict=True)]
    return [lost[e] for e, _ in blocks]


def main_text(html_page: str | None) -> str:
    """The main text of a page, its blocks in order on a line each; empty for a null or empty page or one without any."""
    page = _Page(html_page or "")
    blocks, landmark = page.blocks, page.landmarks
    fused = fused_scores([page.paths[e] for e, _ in blocks], [t for _, t in blocks])
    skip = _skipped(page, fused)
    kept = [f for f, s in zip(fused, skip, strict=True) if not s]
    if not kept:
        return ""
    least = _least(kept)
    line = page.inherited([k == _LINE for k in page.kinds])
    if any(f >= least and not s and not line[e] for f, s, (e, _) in zip(fused, skip, blocks, strict=True)):
        skip = [s or (line[e] and f < least) for s, f, (e, _) in zip(skip, fused, blocks, strict=True)]
    passing = [not s and f >= least for f, s in zip(fused, skip, strict=True)]
    weights = _sums((landmark[e], f * len(t)) for (e, t), f, good in zip(blocks, fused, passing, strict=True) if good)
    marked = {e for e in weights if e >= 0}
    if 2 * sum(weights[e] for e in marked) >= sum(weights.values()):
        root = page.common(marked)
        within = [landmark[e] in marked for e, _ in blocks]
        first, last = within.index(True), len(within) - within[::-1].index(True)
        chosen = [w or (first < i < last and root <= e <= page.last[root]) for i, (w, (e, _)) in enumerate(zip(within, blocks, strict=True))]
    else:
        root = page.common({e for (e, _), good in zip(blocks, passing, strict=True) if good})
        while root and page.tags[root] not in _CONTAINERS:
            root = page.parents[root]
        chosen = [root <= e <= page.last[root] for e, _ in blocks]
    chosen = [c and not s for c, s in zip(chosen, skip, strict=True)]
    heading = page.inherited([t in _HEADINGS for t in page.tags])
    before = [i for i in range(chosen.index(True)) if not skip[i] and not line[blocks[i][0]]]
    while before and (passing[before[-1]] or heading[blocks[before[-1]][0]]):
        chosen[before.pop()] = True
    return "\n".join(text for (_, text), c in zip(blocks, chosen, strict=True) if c)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html).

    A null, empty or textless page gives an empty text. Repeated rows and null ids stay; other columns are not
    read; an empty table gives an empty one. A very long page is read whole, in time and memory that follow its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = [main_text(x.as_py()) for x in part.column("html")]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id").cast(pa.int64()), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
