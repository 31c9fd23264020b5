"""The main text of web pages, by two passes over their blocks.

A page is read once, from left to right, into blocks: what stands between the borders of block elements, white space
folded, with its link characters, its words and its place among the elements. Pass 1 decides the blocks that can be told
by themselves: those in menus, footers, sidebars, forms, notices, adverts and comments (by element, role, class or id) and
those of many link characters are boilerplate, long ones with stop words enough are text. Pass 2 gives the others (short
ones, and those of the article with few stop words) the label of their nearest decided neighbours, within the innermost
element that has blocks decided by their words: adverts and the like inside it don't count, unless one side has nothing else
and the parent of the other doesn't hold the block. Where the sides differ, the nearer one counts, and at equal distance short blocks
are boilerplate and others text. In ``article`` and ``main`` elements without such blocks they are text.

Stop words are those of the language that a page holds most of. A page with next to none (another language) is decided by
lengths and links alone. A page of which the class and id words leave nothing is decided again without them.

Scale: a page is a row of its own, so nothing is shuffled but to deal out an input of few partitions. Time and memory are
in proportion to the page, however long or broken it is.

Defined cases. Null or empty html, or none of it main text: empty text, 0 characters. Null page_id or url: kept. Repeated
rows: a row each. Other columns are kept, those named as the added ones are replaced. An empty table gives no rows. A tag
without an end is text where no ``>`` follows; an unclosed comment, script or style holds the rest of the page, as in browsers.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from factloom.llm.base import spread, table

#: Blocks from SHORT characters are decided by their words, from LONG they may be text at once; shares of stop words and of link characters.
SHORT, LONG, FEW_STOPS, MANY_STOPS, MOST_LINKS = 70, 200, 0.05, 0.12, 0.2

#: The commonest words of the languages that are told apart.
STOP_WORDS = {
    "en": "the of and to a in that is it for was on are as with be at by this have from or had not but an they which he you his she were".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son elle nous vous".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin".split(),
    "ru": "и в не на что с я он как а по это она к но из у за то от так же все для о его было бы мы".split(),
}
#: Elements that end a block; that hold raw text; whose content is never text; that have no content.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
NEVER = frozenset("template svg math canvas select datalist button object audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and roles of boilerplate, and the words of classes and ids that name it.
BOILERPLATE = frozenset("nav footer aside form dialog menu header".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
HINTS = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices
    popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus respond replies sidebar nav navbar
    navigation menu breadcrumb breadcrumbs footer masthead topbar toolbar share sharing social related recommended pagination pager skip""".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
MAIN = frozenset(["article", "main"])
NAMED = BOILERPLATE | MAIN | NEVER

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]++))?""")
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Attributes that say what an element is for.
TELLING = re.compile(r"class|id|role|style|itemprop", re.IGNORECASE)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


@dataclass(slots=True)
class Region:
    """An open element: what it says of its blocks, and which blocks it holds."""

    name: str
    above: int
    bad: bool = False
    #: bad because of a form or a class, which an article inside it overrules
    soft: bool = False
    never: bool = False
    main: bool = False
    first: int = 0
    end: int = 0


@dataclass(slots=True)
class Block:
    text: str
    link_chars: int
    region: int
    words: list[str] = field(default_factory=list)


def pieces(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", name, attributes) and ("close", name, "") in order; comments and raw text left out."""
    at, size, quotes = 0, len(html), True
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            yield "text", html[at:], ""
            return
        if lt > at:
            yield "text", html[at:lt], ""
        after = html[lt + 1 : lt + 2]
        if html.startswith("<!--", lt):
            end = lt + 4 if html.startswith((">", "->"), lt + 4) else html.find("-->", lt + 4)
            if end < 0:
                return
            at = html.index(">", end) + 1
        elif after in ("!", "?") or (after == "/" and not html[lt + 2 : lt + 3].isalpha()):
            end = html.find(">", lt)
            at = size if end < 0 else end + 1
        elif not (after.isascii() and after.isalpha()) and after != "/":
            yield "text", "<", ""
            at = lt + 1
        else:
            end = html.find(">", lt)
            if end < 0:
                yield "text", html[lt:], ""
                return
            inside = html[lt + 1 : end]
            if quotes and ('"' in inside or "'" in inside):
                found = TAG.match(html, lt)
                quotes = found is not None  # a quote without its other half: from here on tags end at the next >
                inside, end = (html[lt + 1 : found.end() - 1], found.end() - 1) if found else (inside, end)
            closing, at = after == "/", end + 1
            name, *rest = inside[closing:].split(None, 1) if " " in inside or "/" in inside or not inside.isalnum() else (inside,)
            name, slash, more = name.partition("/")
            name, attributes = name.lower(), " ".join([more, *rest])
            yield ("close" if closing else "open"), name, "" if closing else attributes
            if name in RAW and not closing:
                end = RAW_END[name].search(html, at)
                if not end:
                    return
                at = end.start()


def attributes_of(text: str) -> dict[str, str]:
    return {name.lower(): unescape(value.strip("\"'")) for name, value in reversed(ATTRIBUTE.findall(text))} if text.strip() else {}


def region_of(name: str, attributes: dict[str, str], above: Region, at: int, hints: bool) -> Region:
    """The element that opens, by its name and attributes and what it stands in."""
    named = {w.lower() for key in ("class", "id") for w in NAME_WORDS.findall(attributes.get(key, ""))} if hints and name not in ("html", "body") else set()
    role = attributes.get("role", "").lower()
    style = attributes.get("style", "").replace(" ", "").lower()
    hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
    hinted = bool(named & HINTS) and not named & {"has", "with", "no"}
    element = (name in BOILERPLATE and not (name == "header" and above.main)) or role in ROLES
    main = not hinted and (name in MAIN or role == "main" or attributes.get("itemprop") == "articleBody")
    bad = above.bad and not (main and above.soft)
    own = hidden or element or hinted
    soft = bad and above.soft and not hidden and not (named & COMMENTS) if not own else (not above.bad or above.soft) and not hidden and not named & COMMENTS and (name == "form" or not element)
    return Region(name, at, bad or own, soft, above.never or name in NEVER, (main or above.main) and not own)


def read_blocks(html: str, hints: bool = True) -> tuple[list[Block], list[Region]]:
    """The blocks of a page and its elements, of which the first is the page itself."""
    regions, blocks = [Region("", -1)], []
    stack, opened = [0], Counter()
    parts: list[str] = []
    link, link_chars, breaks = 0, 0, 0  # link: how deep the stack was where a link opened

    def end_block() -> None:
        nonlocal link_chars
        text = " ".join("".join(parts).split())
        if text:
            blocks.append(Block(text, link_chars, stack[-1]))
        parts.clear()
        link_chars = 0

    def pop() -> None:
        nonlocal link
        region = regions[stack.pop()]
        region.end = len(blocks)
        opened[region.name] -= 1
        link = 0 if len(stack) < link else link

    def close(name: str) -> None:
        while regions[stack[-1]].name != name:
            pop()
        pop()

    for kind, value, attributes in pieces(html):
        if kind == "text":
            text = unescape(value) if "&" in value else value
            if not regions[stack[-1]].never:
                parts.append(text)
                link_chars += len(" ".join(text.split())) if link else 0
                breaks = breaks and (breaks if text.isspace() else 0)
            continue
        if value == "br":
            breaks += 1
            parts.append(" ")
            if breaks > 1:
                end_block()
            continue
        block = value in BLOCKS
        if block:
            breaks = 0
            if parts:
                end_block()
        if kind == "open":
            if value == "a":
                link = len(stack) if "href" in attributes.lower() else link
            if value in VOID or value in RAW:
                continue
            if value == "p" and regions[stack[-1]].name == "p" or value in ("li", "dt", "dd", "tr", "td", "th") and regions[stack[-1]].name == value:
                pop()  # its end tag may be left out
            above = regions[stack[-1]]
            region = region_of(value, attributes_of(attributes), above, stack[-1], hints) if (attributes and TELLING.search(attributes)) or value in NAMED else Region(value, stack[-1], above.bad, above.soft, above.never, above.main)
            changed = (region.bad, region.never, region.main) != (above.bad, above.never, above.main)
            if block or changed or opened[value]:
                if changed and not block:
                    end_block()
                region.first = len(blocks)
                regions.append(region)
                stack.append(len(regions) - 1)
                opened[value] += 1
        elif value == "a" and link:
            link = 0
        elif opened[value]:
            if block:
                close(value)
            else:
                above = next(i for i in reversed(stack) if i == 0 or regions[i].name == value or regions[i].name in BLOCKS)
                if regions[above].name == value:  # what closes inside a block element leaves that open
                    if regions[stack[-1]].bad != regions[regions[above].above].bad or regions[stack[-1]].never:
                        end_block()
                    close(value)
    end_block()
    while stack:
        pop()
    return blocks, regions


def label_blocks(blocks: list[Block], regions: list[Region]) -> list[bool]:
    """Whether each block is main text."""
    seen: Counter = Counter()
    for b in blocks:
        if not regions[b.region].bad and len(b.text) >= SHORT:
            b.words = b.text.lower().split()
            seen.update(b.words)
    held = {k: sum(seen[w] for w in words) for k, words in STOP_WORDS.items()}
    language = max(held, key=lambda k: held[k])
    stops, told = frozenset(STOP_WORDS[language]), held[language] >= FEW_STOPS * seen.total()

    good, bad, lean, short = "good", "bad", "lean", "short"
    labels = []
    for b in blocks:
        region, size = regions[b.region], len(b.text)
        if region.bad or b.link_chars > MOST_LINKS * size or b.text[0] == "©" or (size < SHORT and "©" in b.text):
            labels.append(bad)
        elif size < SHORT:
            labels.append(bad if b.link_chars and not region.main else short)
        else:
            share = sum(map(stops.__contains__, b.words)) / max(1, len(b.words)) if told else 1.0
            if share >= MANY_STOPS and size >= LONG:
                labels.append(good)
            elif share >= FEW_STOPS or region.main:
                labels.append(lean)
            else:
                labels.append(bad)

    decided = [i for i, k in enumerate(labels) if k in (good, bad)]
    by_words = [i for i in decided if not regions[blocks[i].region].bad]

    def around(places: list[int], i: int, scope: Region) -> tuple[int | None, int | None]:
        """The nearest places before and after i inside an element."""
        at = bisect.bisect_left(places, i)
        return places[at - 1] if at and places[at - 1] >= scope.first else None, places[at] if at < len(places) and places[at] < scope.end else None

    scopes: list[int] = []  # for each element, the innermost one around it that has blocks decided by their words, or is an article
    for i, r in enumerate(regions):
        at = bisect.bisect_left(by_words, r.first)
        own = not i or (at < len(by_words) and by_words[at] < r.end) or (r.main and not regions[r.above].main)
        scopes.append(i if own else scopes[r.above])
    out = []
    for i, (b, k) in enumerate(zip(blocks, labels, strict=True)):
        if k in (lean, short):
            scope = regions[scopes[b.region]]
            before, after = around(by_words, i, scope)
            beside = [regions[max(0, regions[blocks[j].region].above)] for j in (before, after) if j is not None]
            if len(beside) < 2 and not scope.main and not any(r.first <= i < r.end for r in beside):
                before, after = around(decided, i, scope)
            if before is None and after is None:
                k = good if scope.main or k == lean else bad
            elif before is None or after is None:
                k = labels[after if before is None else before]
            elif labels[before] == labels[after]:
                k = labels[before]
            elif i - before != after - i:
                k = labels[before if i - before < after - i else after]
            else:
                k = bad if k == short else good
        out.append(k == good)
    return out


def main_blocks(html: str | None) -> list[str]:
    """The blocks of the main text of one page."""
    for hints in (True, False):
        blocks, regions = read_blocks(html or "", hints)
        kept = [b.text for b, main in zip(blocks, label_blocks(blocks, regions), strict=True) if main]
        if kept:
            break
    return kept


ADDED = ("text", "n_chars", "n_blocks")


def extract_main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without html, with text (blocks joined by an empty line), n_chars (long) and n_blocks (long)."""
    pages = pages.select(*[c for c in pages.columns if c != html and c not in ADDED], html)
    schema = T.StructType([*pages.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_blocks", T.LongType())])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                found = [main_blocks(h.as_py()) for h in batch.column(batch.num_columns - 1)]
                texts = ["\n\n".join(b) for b in found]
                added = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(b) for b in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=names)

    return pages.mapInArrow(run, schema)


def op12_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return extract_main_text(pages).select("page_id", "url", "text", "n_chars")
