"""Main text of web pages by consensus of a host's pages on where the text stands.

Every page is parsed into a small tree. A container's score is the text in it that
belongs to no menu, header, footer, advert and the like, lessened by how much else it
holds. Each page votes for the generalised path (tags and classes, digits as #) of its
best container; Spark counts the votes by host. Then every page is parsed again, and the
text is taken from the containers on the path that most pages of its host voted for,
among the paths that the page has. A page with none of them uses its own best container.

Votes and winning paths are small rows. Pages are read twice and never shuffled, unless
there are more hosts than can be sent to every task.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwright.llm.urls import host_of
from foldwright.operators.joins import attach_by_group
from foldwright.session import scratch_space, stored

# Paths a host can win with; a page that has none of them uses its own best container.
WINNERS = 8

# Elements of HTML by how they are read.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that never hold an article, and names that say so of other elements.
CHROME = frozenset(
    "nav footer aside form head menu dialog search button select option optgroup fieldset object canvas audio video svg math".split()
)
CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus "
    "footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo "
    "promoted promotion recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription toc toolbar topbar widget widgets".split()
)
CHROME_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
MAIN_NAMES = frozenset("article articlebody content entry main post story text".split())

# What a start tag of each kind ends, and the elements it doesn't look beyond.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup")}
_ENDS |= {"tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_ENDS |= {name: ("tr", "td", "th", "thead", "tbody", "tfoot") for name in ("thead", "tbody", "tfoot")}
_SCOPE = frozenset("ul ol dl menu select table html body div section article main td th".split())
_NO_P = BLOCKS - frozenset("body caption dd dt head html legend li optgroup option tbody td tfoot th thead tr".split())

_TAG = re.compile(
    r"""<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|[^\s"'>/=][^\s>/=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+))?+|["'=])*+)>"""
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+))?+""")
_NAMES = re.compile(r"[^a-z0-9]+")
_DIGITS = re.compile(r"[0-9]+")


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    kind: str  # tag and generalised classes
    key: int  # digest of the kinds from the outermost block to here; inline elements have their block's
    chrome: bool = False
    named_chrome: bool = False
    hint: bool = False
    header: bool = False
    text: int = 0  # characters of text: all, those in no chrome, those in no link either
    own: int = 0
    plain: int = 0
    holds_main: bool = False


@dataclass(slots=True)
class Chunk:
    """Text as it stands in one element; `opens` where a new block begins before it."""

    element: int
    text: str
    opens: bool


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    chunks: list[Chunk] = field(default_factory=list)


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(source):
        if value[:1] in "\"'":
            value = value[1:-1]
        found.setdefault(name.lower(), entities.unescape(value))
    return found


def _key(parent: int, kind: str) -> int:
    """A signed 64-bit digest of a path from that of its parent."""
    return xxhash.xxh3_64_intdigest(f"{parent}>{kind}") - (1 << 63)


def parse(source: str) -> Page:
    """A page's elements and text. Open elements end where HTML says or their parent ends; anything is a page."""
    page = Page([Element("", -1, "", 0)])
    elements, chunks, stack = page.elements, page.chunks, [0]
    at, size, opens = 0, len(source), True
    count: dict[str, int] = {}  # open elements by tag

    def close(tags: tuple[str, ...], scope: frozenset[str]) -> bool:
        """End the innermost open element of `tags`, and what is open in it; not beyond `scope`."""
        if not any(count.get(t) for t in tags):
            return False
        for depth in range(len(stack) - 1, 0, -1):
            tag = elements[stack[depth]].tag
            if tag in tags:
                for i in stack[depth:]:
                    count[elements[i].tag] -= 1
                del stack[depth:]
                return True
            if tag in scope:
                return False
        return False

    while at < size:
        start = source.find("<", at)
        if start < 0:
            start = size
        if start > at:
            chunks.append(Chunk(stack[-1], source[at:start], opens))
            opens = False
        if start == size:
            break
        tag = _TAG.match(source, start)
        if tag is None:
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                at = size if end < 0 else end + 3
            elif source.startswith(("<!", "<?", "</"), start):
                end = source.find(">", start)
                at = size if end < 0 else end + 1
            elif source[start + 1 : start + 2].isalpha() and source.find(">", start) < 0:
                at = size  # the page ends inside a tag
            else:
                chunks.append(Chunk(stack[-1], "<", opens))
                opens, at = False, start + 1
            continue
        at = tag.end()
        name = tag[2].lower()
        block = name in BLOCKS
        opens = opens or block
        if tag[1]:
            close((name,), frozenset() if block else BLOCKS)
            continue
        if name == "br":
            chunks.append(Chunk(stack[-1], " ", opens))
            opens = False
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(f"</{name}[\\s/>]", re.I).search(source, at)
            at = size if end is None else end.start()
            if end is not None:
                at = size if (close_at := source.find(">", at)) < 0 else close_at + 1
            continue
        if name in ("html", "body") and count.get(name):
            continue
        if name in _NO_P or name == "body":
            close(("p", "head") if name == "body" else ("p",), frozenset(["button", "table", "td", "th"]))
        if name in _ENDS:
            close(_ENDS[name], _SCOPE - frozenset(_ENDS[name]))
        if block and elements[stack[-1]].tag == "head":
            count["head"] -= 1
            stack.pop()
        parent = stack[-1]
        count[name] = count.get(name, 0) + 1
        if not tag[3]:
            element = Element(name, parent, name, _key(elements[parent].key, name) if block else elements[parent].key)
            element.chrome, element.header = name in CHROME, name == "header"
            elements.append(element)
            stack.append(len(elements) - 1)
            continue
        given = _attributes(tag[3])
        kinds = sorted(set(given.get("class", "").split()))
        own = ".".join([name, *(_DIGITS.sub("#", k) for k in kinds)])
        element = Element(name, parent, own, _key(elements[parent].key, own) if block else elements[parent].key)
        names = set(_NAMES.split(f"{given.get('class', '')} {given.get('id', '')}".lower()))
        element.chrome = name in CHROME or "hidden" in given
        element.named_chrome = bool(names & CHROME_NAMES) or given.get("role", "").lower() in CHROME_ROLES
        element.header = name == "header" or bool(names & {"header", "head"}) and block
        element.hint = bool(names & MAIN_NAMES) or given.get("itemprop", "").lower() == "articlebody"
        elements.append(element)
        stack.append(len(elements) - 1)
        if tag[3].endswith("/") and name in ("svg", "math", "path"):
            count[name] -= 1
            stack.pop()
    _weigh(page)
    return page


def _weigh(page: Page) -> None:
    """Mark chrome and count every element's text."""
    elements = page.elements
    for i in range(len(elements) - 1, 0, -1):  # children come after their parents
        element, parent = elements[i], elements[elements[i].parent]
        element.holds_main = element.holds_main or element.tag in ("article", "main")
        parent.holds_main = parent.holds_main or element.holds_main
    in_main, linked, in_head, heading = [False], [False], [False], [False]
    for element in elements[1:]:
        parent = element.parent
        in_main.append(in_main[parent] or element.tag in ("article", "main"))
        linked.append(linked[parent] or element.tag == "a")
        # A header in the article keeps its headings; any other is chrome.
        in_head.append(in_head[parent] or (element.header and in_main[parent]))
        heading.append(heading[parent] or element.tag in HEADINGS)
        named = element.named_chrome or (element.header and not in_main[parent])
        element.chrome |= elements[parent].chrome or (named and not element.holds_main and element.tag not in ("html", "body"))
    for chunk in page.chunks:
        i, count = chunk.element, len(chunk.text.strip())
        element = elements[i]
        element.text += count
        if element.chrome or (in_head[i] and not heading[i]):
            chunk.element = -1
        else:
            element.own += count
            element.plain += count * (not linked[i])
    for i in range(len(elements) - 1, 0, -1):
        element, parent = elements[i], elements[elements[i].parent]
        parent.text += element.text
        parent.own += element.own
        parent.plain += element.plain


def _score(element: Element) -> float:
    """Own text outside links, times the share it has of all text in the container."""
    weight = 1.5 if element.tag in ("article", "main") else 1.25 if element.hint else 0.8 if element.tag in ("", "html", "body") else 1.0
    return weight * element.plain * element.plain / element.text if element.text else 0.0


def best_container(page: Page) -> Element | None:
    """The container with the highest score; None for a page without text.

    Of equal ones the first, but where one holds the other the inner one.
    """

    def inside(element: Element, outer: Element) -> bool:
        while element.parent >= 0 and element is not outer:
            element = page.elements[element.parent]
        return element is outer

    best, most = None, 0.0
    for element in page.elements:
        if element.chrome or element.tag not in _CONTAINERS:
            continue
        score = _score(element)
        if score > most or (best and score == most and inside(element, best)):
            best, most = element, score
    return best


def path_of(page: Page, element: Element) -> str:
    """Kinds of the blocks from the outermost one to `element`."""
    kinds = []
    while element.parent >= 0:
        if element.tag in BLOCKS:
            kinds.append(element.kind)
        element = page.elements[element.parent]
    return ">".join(reversed(kinds))


_CONTAINERS = frozenset("article blockquote body center div html main section table tbody td".split()) | {""}


def text_at(page: Page, key: int) -> str | None:
    """Blocks of text in all containers on a path, in page order; None where there are none."""
    elements = page.elements
    inside = [e.tag in _CONTAINERS and e.key == key and not e.chrome for e in elements]
    if not any(inside):
        return None
    for i, element in enumerate(elements[1:], 1):
        inside[i] = inside[i] or inside[element.parent]
    blocks: list[list[str]] = []
    begun = True
    for chunk in page.chunks:
        begun = begun or chunk.opens
        if chunk.element < 0 or not inside[chunk.element]:
            continue
        if begun:
            blocks.append([])
            begun = False
        blocks[-1].append(chunk.text)
    lines = [" ".join(entities.unescape("".join(b)).split()) for b in blocks]
    return "\n".join(line for line in lines if line)


def page_votes(pages: DataFrame) -> DataFrame:
    """(host, key, path, pages): how many pages of each host have their best container on each path.

    Pages without text vote for no path, NULL.
    """

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, paths = [], []
            for source in batch.column(1).to_pylist():
                page = parse(source or "")
                best = best_container(page)
                keys.append(best and best.key)
                paths.append(best and path_of(page, best))
            columns = [batch.column(0), pa.array(keys, pa.int64()), pa.array(paths, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["host", "key", "path"])

    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(vote, "host string, key bigint, path string")
    return votes.groupBy("host", "key").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("pages"))


def winning_paths(votes: DataFrame, winners: int = WINNERS) -> DataFrame:
    """(host, pages, keys): a host's pages, and its paths by falling votes."""
    order = Window.partitionBy("host").orderBy(F.col("pages").desc(), "path")
    ranked = votes.where(F.col("key").isNotNull()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= winners)
    keys = F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda r: r["key"])
    best = ranked.groupBy("host").agg(keys.alias("keys"))
    return votes.groupBy("host").agg(F.sum("pages").alias("pages")).join(best, "host", "left")


def extract_text(pages: DataFrame, winners: int = WINNERS) -> DataFrame:
    """`pages` (url, html and others) without html, with the main text as `text` and its path as `text_path`.

    The article without menus, headers, footers, sidebars, notices, adverts, forms, scripts,
    styles, markup and comments; headings inside the article stay. References are decoded,
    white space inside a block becomes one space, blocks are joined by a line feed; a line
    break inside a block is white space.

    Defined cases: NULL or empty html, and pages without text, give an empty text and no path; NULL
    urls and urls without host are one host of their own; bytes that are no tags are text; a page
    cut anywhere ends there; repeated rows are extracted each; columns `text` and `text_path` of
    `pages` are replaced; an empty table gives no rows.
    """
    kept = [c for c in pages.columns if c not in ("html", "text", "text_path")]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = [], []
            for source, keys in zip(batch.column("html").to_pylist(), batch.column("keys").to_pylist()):
                page = parse(source or "")
                there = {e.key: e for e in reversed(page.elements) if e.tag in _CONTAINERS and not e.chrome}
                at = next((there[k] for k in keys or [] if k in there), None) or best_container(page)
                text = text_at(page, at.key) if at else None
                texts.append(text or "")
                found.append(path_of(page, at) if text else None)
            columns = [batch.column("row"), pa.array(texts, pa.string()), pa.array(found, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "text", "text_path"])

    with scratch_space(pages.sparkSession):
        votes = stored(page_votes(pages), "votes")
        hosts = stored(winning_paths(votes, winners), "hosts", keep=True)
    # In a struct, the other columns may have any names.
    named = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), "html", host_of(F.col("url")).alias("host"))
    rows = attach_by_group(named, hosts, ["host"], "pages", "left").select("row", "html", "keys")
    kind = named.select("row").dtypes[0][1]
    found = rows.mapInArrow(extract, f"row {kind}, text string, text_path string")
    return found.select(*[F.col("row")[c].alias(c) for c in kept], "text", "text_path")
