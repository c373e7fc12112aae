"""HTML main text by site style trees.

All pages of a host are merged into one tree of element paths (tag with class words). For every path the tree counts
the pages that hold it, the pages per sequence of child tags, and the pages per piece of own text. Pages of a host with equal html
count as one page. With m pages:

* presentation importance: entropy of the child sequences over the pages, base m;
* content importance: 1 minus the mean, over distinct pieces of text, of log(pages with the piece) / log m, the entropy
  of a piece spread evenly over the pages that hold it;
* importance: (1 - DECAY) * presentation + DECAY * content.

A branch is taken out of a page when all its text stands on paths that at least `MIN_PAGES` pages of the host share and
whose importance is below `LEAST`; text inside an element that the page marks as article or main is never taken out so. Elements that
are never main text (menus, forms, scripts and so on, by tag, role or class) are taken out on any host, and where a page marks an
article, only that is read. An element around the page's articles stays when none is found outside such elements, or (as long as
it is only a form, or has a listed word as a mere part of a class name) when it holds most of the page's text.

Counts are combined per batch and before the shuffle, by hashes; no text is shuffled. The unimportant paths are
written out, one row per host, so that Spark broadcasts them only when their files are small and otherwise joins by host with
skewed hosts split.

Defined results: null or empty html gives an empty text; a null or odd url belongs to the host ""; broken markup is
read as far as it goes; repeated rows count as one page; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.storage import stored

DECAY = 0.9
LEAST = 0.6
MIN_PAGES = 5

# HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea xmp noembed noframes title svg math object".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER = frozenset("head nav footer aside form button select option datalist dialog menu input fieldset canvas audio video map".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
NEVER_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "comment comments disqus respond reply replies responses discussion feedback widget pagination pager toolbar search copyright masthead skip".split())
HEADER_WORDS = frozenset("header topbar".split())
#: First words of class names that only tell what a wrapper holds or lacks, and words of wrappers, which may hold the text itself.
FLAGS = frozenset("has no with without hide show is".split())
WRAPPERS = frozenset("wrap wrapper layout container page site body main content grid".split())
#: Elements of running text: a listed word speaks against them only as a whole class name or as its last word.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th blockquote pre span em strong b i a cite q mark small".split())
#: Words that speak against an article: reader comments and teasers of other pages.
ARTICLE_WORDS = frozenset("comment comments reply related promo ad card teaser".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")),
          "th": ("td th", ("tr", "table")), "option": ("option", ("select", "datalist")), "tbody": ("tbody thead tfoot tr td th", ("table",)), "tfoot": ("tbody thead tr td th", ("table",))}
P_CLOSERS = BLOCK - frozenset("body html td th tr tbody thead tfoot caption option legend".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/><]*)((?:"[^"]*"|'[^']*'|[^"'>])*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/><]*)([^>]*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(\bhidden\b)""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(slots=True)
class Element:
    tag: str
    words: frozenset[str] = frozenset()
    noise: bool = False
    #: Class and id words that speak against the element.
    against: frozenset[str] = frozenset()
    #: Whether one of them stands in a name that is no wrapper's.
    listed: bool = False
    path: int = 0
    children: list = field(default_factory=list)
    #: Characters of text below, those of them in links, and links.
    whole: int = 0
    linked: int = 0
    links: int = 0
    #: Whether it stays although its tag or its attributes are those of no main text.
    spared: bool = False
    #: Whether it is an article beside a longer text.
    teaser: bool = False

    @property
    def menu(self) -> bool:
        """Whether nearly all text below stands in two or more links."""
        return self.links > 1 and self.linked > 0.8 * self.whole


def _attributes(raw: str, tag: str) -> tuple[frozenset[str], bool, frozenset[str], bool]:
    """Class and id words; whether other attributes mark the element as no main text; listed words, and whether a name that is no wrapper's has one."""
    words, noise, against, listed = set(), False, set(), False
    for name, a, b, c, hidden in _ATTRIBUTE.findall(raw):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            for token in value.split():
                parts = [w.lower() for w in _WORD.findall(token)]
                words.update(parts)
                if not parts or len(parts) > 1 and parts[0] in FLAGS:
                    continue
                found = NEVER_WORDS.intersection(parts[-1:] if tag in TEXTUAL else parts)
                against |= found
                listed |= bool(found) and WRAPPERS.isdisjoint(parts)
        elif name == "role":
            noise |= value.strip().lower() in NEVER_ROLES
        elif name == "style":
            noise |= "display:none" in value.replace(" ", "").lower()
        elif hidden or (name == "aria-hidden" and value.lower() == "true"):
            noise = True
    return frozenset(words), noise, frozenset(against), listed


def parse(page: str) -> Element:
    """Tree of a page; children are elements and decoded texts."""
    root = Element("#root")
    open_, at, size = [root], 0, len(page)

    def text(raw: str) -> None:
        if raw and not raw.isspace():
            open_[-1].children.append(html.unescape(raw))
        elif raw:
            open_[-1].children.append(" ")

    def close(tags: tuple[str, ...], fences: tuple[str, ...]) -> None:
        for k in range(len(open_) - 1, 0, -1):
            if open_[k].tag in tags:
                del open_[k:]
                return close(tags, fences) if len(tags) > 1 else None
            if open_[k].tag in fences:
                return None

    while at < size:
        found = _TAG.search(page, at)
        if not found:
            text(page[at:])
            break
        text(page[at:found.start()])
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        if found[1] or found[4]:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == tag:
                    del open_[k:]
                    break
            continue
        raw = found[3] or found[6] or ""
        if tag in RAW and not raw.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in P_CLOSERS:
            close(("p",), ("td", "th", "button", "table", "div", "article", "section"))
        if tag in CLOSES:
            close(tuple(CLOSES[tag][0].split()), CLOSES[tag][1])
        words, noise, against, listed = _attributes(raw, tag) if raw else (frozenset(), False, frozenset(), False)
        if tag == "label":  # of a form field, unless it stands in running text
            noise |= open_[-1].tag not in TEXTUAL
        element = Element(tag, words, noise, against, listed)
        open_[-1].children.append(element)
        if tag not in VOID and not raw.endswith("/"):
            open_.append(element)
    return root


def _digest(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "replace")) - (1 << 63)


def lay_paths(root: Element) -> Iterator[Element]:
    """Give every element its path in the style tree; elements come in page order."""
    todo = [(root, 0)]
    while todo:
        element, above = todo.pop()
        element.path = _digest(above, element.tag, *sorted(element.words))
        yield element
        todo += [(c, element.path) for c in reversed(element.children) if isinstance(c, Element)]


def tidy(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def own_text(element: Element) -> str:
    """Text of the element and of its inline children."""
    parts, todo = [], list(reversed(element.children))
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            parts.append(part)
        elif part.tag == "br":
            parts.append(" ")
        elif part.tag not in BLOCK:
            todo += reversed(part.children)
    return tidy(parts)


def observe(page: str, host: str, counts: Counter, weight: float = 1.0) -> None:
    """Add a page to the counts (host, path, kind, value): kind 0 the page, 1 its child sequences, 2 its pieces of text."""
    seen = set()
    for element in lay_paths(parse(page)):
        if element.tag not in BLOCK:
            continue
        tags = [c.tag for c in element.children if isinstance(c, Element)]
        style = [t for k, t in enumerate(tags) if not k or t != tags[k - 1]]
        seen.update(((element.path, 0, 0), (element.path, 1, _digest("style", *style))))
        if text := own_text(element):
            seen.add((element.path, 2, _digest("text", text)))
    for s in seen:
        counts[(host, *s)] += weight


def _never(element: Element) -> bool:
    if element.spared or element.tag in ("html", "body", "main", "#root"):
        return False
    if element.tag == "article":
        return element.teaser or bool(element.words & ARTICLE_WORDS)
    return element.noise or element.tag in NEVER or bool(element.against)


def _doubtful(element: Element) -> bool:
    """Whether only a form tag, or a listed word within a wrapper's class name, speaks against the element."""
    return not (element.noise or element.listed or element.tag in NEVER - {"form", "fieldset"})


def spare(elements: list[Element]) -> None:
    """Mark what stays around the page's articles or most of its text; elements are weighed and come in page order."""
    parent = {id(c): e for e in elements for c in e.children if isinstance(c, Element)}
    #: The nearest of the element and those above it that is taken out, how many are, and whether the element stands in an article.
    near: dict[int, Element | None] = {}
    depth: dict[int, int] = {}
    inside: dict[int, bool] = {}
    for e in elements:
        up, out = id(parent.get(id(e))), _never(e)
        near[id(e)] = e if out else near.get(up)
        depth[id(e)] = depth.get(up, 0) + out
        inside[id(e)] = inside.get(up, False) or (e.tag == "article" and not out)
    for tag in ("article", "main"):
        marked = [e for e in elements if e.tag == tag and not _never(e)]
        least = min((depth[id(e)] for e in marked), default=0)
        for e in marked if least else ():
            x = near[id(e)] if depth[id(e)] == least else None
            while x is not None and not x.spared:
                x.spared = True
                x = near.get(id(parent.get(id(x))))
    # Text outside of what is taken out for certain, and paragraphs outside of all that is taken out.
    size: dict[int, int] = {}
    paragraphs: dict[int, int] = {}
    for e in reversed(elements):
        out = _never(e)
        below = [c for c in e.children if isinstance(c, Element)]
        size[id(e)] = 0 if out and not _doubtful(e) else sum(len(c.strip()) for c in e.children if isinstance(c, str)) + sum(size[id(c)] for c in below)
        paragraphs[id(e)] = 0 if out or _header(e) else e.whole if e.tag == "p" and not e.menu else sum(paragraphs[id(c)] for c in below)
    if paragraphs[id(elements[0])]:
        return  # the page has text beside the doubtful elements
    for e in elements:
        if _never(e) and e.tag != "article" and not inside[id(e)] and _doubtful(e) and 2 * size[id(e)] > size[id(elements[0])]:
            e.spared = True


def marked_text(elements: list[Element]) -> bool:
    """Whether articles and main elements hold most of the text that is not taken out; else they are branches like any other.

    Of several articles beside a longer text each is a teaser, and is taken out.
    """
    size: dict[int, int] = {}
    held: dict[int, int] = {}
    for e in reversed(elements):
        below = [c for c in e.children if isinstance(c, Element)]
        out = _never(e) or _header(e) or e.menu and e.tag in ("ul", "ol", "div", "td")
        size[id(e)] = 0 if out else sum(len(c.strip()) for c in e.children if isinstance(c, str)) + sum(size[id(c)] for c in below)
        held[id(e)] = size[id(e)] if e.tag in ("article", "main") else 0 if out else sum(held[id(c)] for c in below)
    top = id(elements[0])
    if 2 * held[top] >= size[top]:
        return held[top] > 0
    articles = [e for e in elements if e.tag == "article" and not _never(e)]
    for e in articles if len(articles) > 1 else ():
        e.teaser = True
    return False


def _header(element: Element) -> bool:
    return element.tag == "header" or bool(element.words & HEADER_WORDS) and element.tag not in ("html", "body", "main", "article")


def blocks(root: Element, low: frozenset[int]) -> list[str]:
    """Main blocks in page order; `low` are the host's unimportant paths."""
    elements = list(lay_paths(root))
    weigh(elements)
    spare(elements)
    marked = marked_text(elements)
    out: list[str] = []
    buffer: list[str] = []

    def flush() -> None:
        if (line := tidy(buffer)):
            out.append(line)
        buffer.clear()

    # (element or text or None for the end of a block, inside an article, only headings wanted, on an unimportant path)
    todo: list[tuple[object, bool, bool, bool]] = [(root, False, False, False)]
    while todo:
        part, inside, headings, dull = todo.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            if (inside or not marked) and not headings and not dull:
                buffer.append(part)
        elif part.tag == "br":
            buffer.append(" ")
        elif not _never(part):
            inside = inside or part.tag in ("article", "main")
            if _header(part):
                if not inside:
                    continue
                headings = True
            if part.tag in HEADINGS:
                headings = False
            if part.tag in BLOCK:
                flush()
                todo.append((None, inside, headings, dull))
                dull = part.path in low and not inside
            if not inside and part.menu and (part.tag in ("ul", "ol", "div", "td") or part.tag == "p" and part.links > 3):
                continue
            todo += [(c, inside, headings, dull) for c in reversed(part.children)]
    flush()
    return out


def weigh(elements: list[Element]) -> None:
    """Fill in the counts of text and links, from the leaves up; elements come in page order."""
    for element in reversed(elements):
        for c in element.children:
            if isinstance(c, str):
                n = len(c.strip())
                element.whole, element.linked = element.whole + n, element.linked + n * (element.tag == "a")
            else:
                element.whole, element.links = element.whole + c.whole, element.links + c.links + (c.tag == "a")
                element.linked += c.whole if element.tag == "a" else c.linked


def _pages(pages: DataFrame) -> DataFrame:
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1), F.lit("")))
    return pages.select("page_id", "url", "html", host.alias("host"))


def _weighed(pages: DataFrame) -> DataFrame:
    """`host`, `html` and `weight`, one over the pages of the host with equal html; only pages that stand twice are joined back."""
    rows = _pages(pages).select("host", "html", F.xxhash64("host", F.md5(F.coalesce("html", F.lit("")))).alias("digest"))
    twice = stored(rows.groupBy(F.col("digest").alias("of")).count().where("count > 1"), "twice")
    return rows.join(twice, F.col("digest") == F.col("of"), "left").select("host", "html", (F.lit(1.0) / F.coalesce("count", F.lit(1))).alias("weight"))


def unimportant(pages: DataFrame, least: float = LEAST, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per host with unimportant paths: `host`, `low`."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows() -> pa.RecordBatch:
            columns = list(zip(*counts.keys())) or [[], [], [], []]
            made = pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()),
                                               pa.array(columns[3], pa.int64()), pa.array(list(counts.values()), pa.float64())], ["host", "path", "kind", "value", "n"])
            counts.clear()
            return made

        for batch in batches:
            for host, page, weight in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "weight"))):
                observe(page or "", host, counts, weight)
                if len(counts) > 200_000:
                    yield rows()
        yield rows()

    seen = _weighed(pages).mapInArrow(per_batch, "host string, path long, kind int, value long, n double")
    pieces = seen.groupBy("host", "path", "kind", "value").agg(F.round(F.sum("n")).alias("n"))

    def over(kind: int, value: object) -> object:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0.0))

    m = F.col("m")
    trees = pieces.groupBy("host", "path").agg(
        over(0, F.col("n")).alias("m"), over(1, F.col("n") * F.log("n")).alias("styles"), over(2, F.log("n")).alias("texts"), F.count_if(F.col("kind") == 2).alias("l"))
    presentation = (F.log(m) - F.col("styles") / m) / F.log(m)
    content = 1 - F.col("texts") / (F.col("l") * F.log(m))
    return (trees.where((m >= min_pages) & (F.col("l") > 0)).where((1 - DECAY) * presentation + DECAY * content < least)
            .groupBy("host").agg(F.collect_list("path").alias("low")))


def extract(pages: DataFrame, least: float = LEAST, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    low = stored(unimportant(pages, least, min_pages), "paths").withColumnRenamed("host", "of")
    joined = _pages(pages).join(low, F.col("host") == F.col("of"), "left").select("page_id", "url", "html", "low")
    types = dict(joined.dtypes)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n\n".join(blocks(parse(page), frozenset(paths or ()))) if page else "" for page, paths in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(per_batch, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
