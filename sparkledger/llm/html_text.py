"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import set_aside, table

#: A quote that never closes is a character like any other.
ATTRIBUTES = r"""(?:"[^"]*"|'[^']*'|[^>])*+"""
#: Start tags before which a drawing that never closes ends, as in browsers.
BREAKOUT = r"(?:address|article|aside|b|big|blockquote|body|br|center|code|dd|div|dl|dt|em|figure|footer|form|h[1-6]|head|header|hr|i|img|li|main|menu|nav|ol|p|pre|section|small|span|strong|sub|sup|table|u|ul)"
#: Comments, elements whose content is no markup (to their end tag or the page's end), drawings, declarations, tags.
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|title|iframe)\b{ATTRIBUTES}>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<svg>svg)\b{ATTRIBUTES}(?:(?<=/)>|>(?:(?!<{BREAKOUT}\b).)*?(?:</svg\s*>|(?=<{BREAKOUT}\b)|\Z))|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attributes>{ATTRIBUTES})>",
    re.I | re.S,
)
CLASS = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img object".split()) | frozenset(
    # formulas stand in the line
    "math maction merror mfenced menclose mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics annotation annotation-xml".split()
)
#: These end a paragraph that is open; the others end an open element of their own group.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
GROUPS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
CHOICES = ("select", "option", "optgroup")
#: Where an end tag or a group stops looking upwards.
WALLS = frozenset("html body table ul ol dl article section main aside nav".split())
#: Elements that are never main text; those that aren't unless they hold most of the page, as named ones are.
NEVER = frozenset("head nav footer aside button menu dialog audio video canvas select".split())
SELDOM = frozenset("form fieldset".split())
#: Words in a class, id or role that say so, each a whole token or joined to others of them and to words for a part of a page.
SAYS = r"ads?|advert\w*|adsense|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|aside|widgets?|footer\w*|foot|header\w*|masthead|topbar|toolbar|comments?|commentlist|disqus|replies|reply|respond|reviews?|share\w*|sharing|social|follow|related|recommend\w*|newsletter|subscri\w*|signup|sign-up|login|search\w*|pagination|pager|tags|tagcloud|copyright|legal|disclaimer|skip\w*|complementary|navigation|contentinfo|hidden"
PARTS = r"site|page|main|top|bottom|left|right|first|last|primary|secondary|global|post|posts|article|articles|entry|story|stories|bar|box|block|list|items?|links?|buttons?|icons?|form|wrap|wrapper|container|inner|outer|area|section|sections|panel|row|col|slot|unit|text|content|media|\d+"
SAYS_NOT = re.compile(rf"(?:^|\s)(?:(?:{PARTS})[_-]+)*(?:{SAYS})(?:[_-]+(?:{SAYS}|{PARTS}))*(?:$|\s)", re.I)
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TITLE = re.compile(r"[._-](?:title|headline|heading)$")
#: Marks that end something, not those inside of names and numbers.
PUNCTUATION = re.compile(r"[.,;:!?…](?=\s|$)|[。、，！？；：]")
#: Weights of a block's neighbours, share of the spread of the fused ratio that a path must reach, and most share of link text.
KERNEL, SHARE, MOST_LINKS = np.array([0.25, 0.5, 0.25]), 0.5, 0.5
#: Share of the content that a container must hold to be entered, and of the article's mean ratio that other text must reach.
TIGHT, NEAR = 0.7, 0.75
#: Share of the content that article and main elements must hold to be believed.
MARKED = 0.2
#: Elements made for text, and those that are entered as a whole or not at all.
TEXTS = HEADINGS | frozenset("p li dt dd td th caption figcaption blockquote pre summary address".split())
WHOLES = TEXTS | frozenset("ul ol dl table thead tbody tfoot tr figure details".split()) - frozenset(("td",))


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    path: str
    never: bool
    main: int
    #: The nearest element around it, itself included, that is left out unless it holds most of the content; -1: none.
    doubt: int


@dataclass(slots=True)
class Block:
    """Text between block tags. element: the number of the element that holds it."""

    element: int
    text: str
    links: int


@dataclass
class Page:
    elements: list[Element] = field(default_factory=lambda: [Element("", -1, "", False, -1, -1)])
    blocks: list[Block] = field(default_factory=list)


def parse(source: str) -> Page:
    """Blocks and the elements around them; tags that aren't closed, or not in order, are mended as browsers do."""
    page = Page()
    stack, parts, links, in_links = [0], [], 0, 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                page.blocks.append(Block(stack[-1], text, min(links, len(text))))
            parts.clear()
        links = 0

    def add(data: str) -> None:
        nonlocal links
        if data:
            parts.append(data)
            if in_links:
                links += len(data)

    def close(tags: tuple[str, ...]) -> None:
        """Ends open elements up to the outermost of these, but not beyond a wall."""
        for k in range(len(stack) - 1, 0, -1):
            tag = page.elements[stack[k]].tag
            if tag in tags:
                flush()
                del stack[k:]
                return
            if tag in WALLS:
                return

    at = 0
    while m := TOKEN.search(source, at):
        add(source[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"]:
                flush()
            continue
        tag = tag.lower()
        # a list of choices that never closes ends before anything else
        if not m["end"] and tag not in CHOICES and page.elements[stack[-1]].tag in CHOICES:
            close(CHOICES[:1])
        if tag in INLINE:
            if tag == "a":
                in_links = 0 if m["end"] else 1
            continue
        flush()
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if page.elements[stack[k]].tag == tag:
                    del stack[k:]
                    break
                if page.elements[stack[k]].tag in WALLS and tag not in WALLS:
                    break
            in_links = 0
            continue
        if tag in VOID:
            continue
        if tag in ENDS_P:
            close(("p",))
        if tag in GROUPS:
            close(GROUPS[tag])
        if tag != "p":
            in_links = 0
        up = page.elements[stack[-1]]
        named = " ".join(x.strip("\"'") for x in CLASS.findall(m["attributes"])) if m["attributes"] else ""
        is_main = tag in MAIN
        never = up.never or tag in NEVER
        doubtful = not never and (tag in SELDOM or (tag == "header" and up.main < 0) or (tag not in ("html", "body") and bool(named and SAYS_NOT.search(named))))
        number = len(page.elements)
        page.elements.append(Element(tag, stack[-1], f"{up.path}/{tag}.{named.split(' ')[0].lower()}" if named else f"{up.path}/{tag}", never, number if is_main and not never else up.main, number if doubtful else up.doubt))
        stack.append(number)
        if m["attributes"].endswith("/") and tag not in ENDS_P:
            stack.pop()
    # an unfinished tag at the end is markup
    rest = source[at:]
    add(rest[: cut.start()] if (cut := re.search(r"<[a-zA-Z/!][^>]*\Z", rest)) else rest)
    flush()
    return page


def path_ratios(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """The fused ratio of each block: text length and punctuation per node of its path, each scaled; smoothed over the page first, and as it is."""
    paths = [page.elements[b.element].path for b in page.blocks]
    sizes: dict[str, list[float]] = {}
    for p, b in zip(paths, page.blocks):
        s = sizes.setdefault(p, [0.0, 0.0, 0.0])
        s[0] += 1
        s[1] += len(b.text) - b.links
        s[2] += len(PUNCTUATION.findall(b.text)) if 2 * b.links < len(b.text) else 0
    ratios = np.array([[sizes[p][1] / sizes[p][0], sizes[p][2] / sizes[p][0]] for p in paths]).reshape(-1, 2)

    def fused(columns: list[np.ndarray]) -> np.ndarray:
        out = np.ones(len(paths))
        for r in columns:
            out *= np.sqrt(r / r.max()) if len(r) and r.max() > 0 else 1.0
        return out

    smoothed = [np.convolve(np.pad(ratios[:, k], 1, "edge"), KERNEL, "valid") if len(paths) else ratios[:, k] for k in (0, 1)]
    return fused(smoothed), fused([ratios[:, 0], ratios[:, 1]])


def link_shares(page: Page) -> list[float]:
    """Of each block the share of link text in all blocks of its path."""
    sums: dict[str, list[int]] = {}
    for b in page.blocks:
        s = sums.setdefault(page.elements[b.element].path, [0, 0])
        s[0] += b.links
        s[1] += len(b.text)
    return [s[0] / s[1] for b in page.blocks for s in (sums[page.elements[b.element].path],)]


def innermost(page: Page, weight: dict[int, int]) -> set[int]:
    """Main elements that together hold all of weight: of nested ones with the same text the innermost."""
    outer = lambda e: page.elements[page.elements[e].parent].main
    nested: dict[int, list[int]] = {}
    for e in weight:
        nested.setdefault(outer(e), []).append(e)
    out = set()
    for top in (e for e in weight if outer(e) < 0):
        while one := [e for e in nested.get(top, ()) if weight[e] == weight[top]]:
            top = one[0]
        out.add(top)
    return out


def left_out(page: Page, seeds: list[int]) -> list[bool]:
    """Whether each element lies in a doubtful one: those that hold most of the content aren't.

    Where nothing else holds content, none is left out.
    """
    doubts = lambda e: page.elements[page.elements[e].parent].doubt
    held: dict[int, int] = {}
    for k in seeds:
        at = page.elements[page.blocks[k].element].doubt
        while at > 0:
            held[at] = held.get(at, 0) + len(page.blocks[k].text)
            at = doubts(at)
    whole = sum(len(page.blocks[k].text) for k in seeds)
    out = [False] * len(page.elements)
    for n, e in enumerate(page.elements):
        out[n] = e.parent >= 0 and out[e.parent] or (e.doubt == n and 2 * held.get(n, 0) <= whole)
    return out if not all(out[page.blocks[k].element] for k in seeds) else [False] * len(page.elements)


def region(page: Page, seeds: list[int], may: list[int]) -> int:
    """The smallest container that holds nearly all content, reached from the root: lists, tables and quotes, and what holds only its own text, aren't entered."""
    mass, inner = [0] * len(page.elements), [False] * len(page.elements)
    for k in seeds:
        mass[page.blocks[k].element] += len(page.blocks[k].text)
    for k in may:
        if (up := page.elements[page.blocks[k].element].parent) >= 0:
            inner[up] = True
    for n in range(len(page.elements) - 1, 0, -1):
        mass[page.elements[n].parent] += mass[n]
        if inner[n]:
            inner[page.elements[n].parent] = True
    at, whole = 0, mass[0]
    for n, e in enumerate(page.elements):
        # elements are in page order, so what is inside of an element comes after it
        if e.parent == at and n and mass[n] >= TIGHT * whole and inner[n] and e.tag not in WHOLES:
            at = n
    return at


def headed(page: Page, k: int) -> bool:
    """Whether a block is a heading by its tag or by the name of what holds it."""
    e = page.elements[page.blocks[k].element]
    return e.tag in HEADINGS or bool(TITLE.search(e.path.rsplit("/", 1)[-1]))


def chosen(page: Page) -> list[Block]:
    """The blocks of the main text, in page order.

    Paths whose mean fused ratio reaches a share of its spread are content. Named elements that hold the lesser part of the content are left out. The
    rest of the content lies in article or main elements, if these hold most of it, or else in the smallest container with nearly all
    of it, found by the content's mass alone. Inside, text in elements made for text (paragraphs, items, cells, headings) stays; what stands in any
    other element stays if its path is content, or if it is the short line before what stays. Outside, blocks stay whose path has the
    ratio of the article's own text. Lists of links stay only inside article or main elements.
    """
    may = [k for k, b in enumerate(page.blocks) if not page.elements[b.element].never]
    if not may:
        return []
    path = lambda k: page.elements[page.blocks[k].element].path
    fused, raw = path_ratios(page)
    by_path: dict[str, list[float]] = {}
    for k in may:
        by_path.setdefault(path(k), []).append(float(fused[k]))
    mean = {p: sum(v) / len(v) for p, v in by_path.items()}
    least = SHARE * float(np.std(fused)) if len(fused) > 2 else 0.0
    links = link_shares(page)
    seeds = [k for k in may if mean[path(k)] >= least and links[k] <= MOST_LINKS] or may
    out = left_out(page, seeds)
    may = [k for k in may if not out[page.blocks[k].element]]
    seeds = [k for k in seeds if not out[page.blocks[k].element]] or may
    weight: dict[int, int] = {}
    for k in seeds:
        at = page.elements[page.blocks[k].element].main
        # nested main elements count for every one around them
        while at > 0:
            weight[at] = weight.get(at, 0) + len(page.blocks[k].text)
            at = page.elements[page.elements[at].parent].main
    outer = sum(v for e, v in weight.items() if page.elements[page.elements[e].parent].main < 0)
    marked = outer > 0 and outer >= MARKED * sum(len(page.blocks[k].text) for k in seeds)
    inside = innermost(page, weight) if marked else {region(page, seeds, may)}
    holds = [False] * len(page.elements)
    for n, e in enumerate(page.elements):
        holds[n] = n in inside or (e.parent >= 0 and holds[e.parent])
    own = [k for k in seeds if holds[page.blocks[k].element]]
    level = NEAR * sum(raw[k] * len(page.blocks[k].text) for k in own) / max(1, sum(len(page.blocks[k].text) for k in own))
    content, taken = set(seeds), set()
    for k in may:
        tag = page.elements[page.blocks[k].element].tag
        if not holds[page.blocks[k].element]:
            stays = k in content and raw[k] >= level and not marked
        elif tag in TEXTS or (k in content and raw[k] >= least):
            stays = marked or links[k] <= MOST_LINKS
        else:
            stays = False
        if stays:
            taken.add(k)
    for here, after in zip(may[-2::-1], may[:0:-1]):
        b = page.blocks[here]
        if after not in taken or here in taken:
            continue
        # a heading before the article, or a line before a paragraph inside it
        if headed(page, here) if not holds[b.element] else (links[here] <= MOST_LINKS and not PUNCTUATION.search(b.text) and page.elements[b.element].parent == page.elements[page.blocks[after].element].parent):
            taken.add(here)
    return [page.blocks[k] for k in may if k in taken]


def main_text(source: str | None) -> str:
    """The article of a page: references decoded, white space of a block made one space, blocks joined by one space. Null: empty."""
    return " ".join(b.text for b in chosen(parse(source))) if source else ""


def extract(pages: DataFrame, source: str = "html") -> DataFrame:
    """pages with text and n_chars (code points) in place of the source column; the other columns stay.

    Null, empty and textless pages have an empty text; pages without any tag are text. Every row, repeated ones as well,
    gives a row; an empty table gives none. Each page is parsed in one pass, whatever its length. Input columns of these names get
    an underscore at their end.
    """
    pages, _ = set_aside(pages, "text", "n_chars", keep=(source,))
    where = pages.columns.index(source)
    rest = [c for c in pages.columns if c != source]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(where)]
            columns = [c for k, c in enumerate(batch.columns) if k != where]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*rest, "text", "n_chars"])

    schema = StructType([*(f for f in pages.schema.fields if f.name != source), StructField("text", StringType()), StructField("n_chars", LongType())])
    return pages.mapInArrow(each, schema)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select(F.col("page_id"), F.col("url"), F.col("html"))).select("page_id", "url", "text", "n_chars")
