"""Main text of web pages by equivalence-class template deduction.

1. Each page is cut into tokens: opening tags of blocks with their path, and text blocks outside
   articles. For every host and token, the vector of its counts over the host's pages is kept as two
   sums of page hashes, so equal vectors are found without bringing a host's pages together.
2. Tokens of a host with equal vectors are an equivalence class. Classes with at least MIN_CLASS
   tokens that stand in most pages of the host are valid. Their tokens in order of their mean first
   place are the template; a class of fewer pages stands nested between the tokens of a wider one.
3. In a page the template's tokens that follow its order bound the slots; a slot is named by the two
   tokens around it. Over all pages of the host, a slot is boilerplate if in SLOT_SHARE of the pages
   where it has text most of it is a menu, header, footer, sidebar, notice, advert, form or comment
   by its marks, or is links outside ``article`` and ``main``. Articles have no part in this.
4. The main text is what the slots hold: text that is itself template and boilerplate slots are left
   out, and what bears a mark of the kinds above. Nothing else is left out: text outside an article
   stays, and so do links in a slot that usually holds text.

An article's own blocks are never dropped for being common or for their slot. Templates and slots are
joined to the pages by host; Spark broadcasts them if their measured size allows, else it splits hosts
that hold a large part of the pages.

Defined cases: null or empty html gives an empty text; pages without host share the empty host; a
host with fewer than MIN_PAGES pages has no template, only marks count, links do not; broken or unclosed markup is
read as browsers do in the common cases, in time in proportion to its length however deep it nests;
repeated rows give repeated rows; ids may be null; very long pages are read whole; an empty table gives an
empty result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import materialise

MIN_PAGES, MIN_CLASS, MIN_SHARE, SLOT_SHARE = 4, 3, 0.6, 0.9
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+>|[^>]*(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>|\Z", re.I) for t in "script style textarea title xmp iframe noembed noframes".split()}
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td "
    "tfoot th thead tr ul".split()
)
CHROME = set("nav footer aside form script style noscript template head title iframe button select textarea input dialog menu audio video noframes noembed".split())
CHROME_WORDS = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "notification popup modal overlay newsletter subscribe subscription signup sidebar widget widgets nav navbar navigation navigator menu menubar "
    "breadcrumb breadcrumbs header masthead topbar footer colophon comment comments commentlist reply replies disqus respond share sharing social "
    "related recommended recommendations login signin search toolbar pagination pager copyright skip".split()
)
#: Words that mark a part of an article as none of its text; the others above also name parts of articles.
ARTICLE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr notice notices newsletter subscribe sidebar "
    "nav navbar navigation menu breadcrumb breadcrumbs footer comment comments commentlist disqus pager pagination".split()
)
#: Words that say what a page has rather than what an element is, at the start of a name; and words beside a mark in names of its parts.
LAYOUT_WORDS = set("no not has have with without hide show".split())
PART_WORDS = set(
    "area bar block body bottom box button close collapse column container content element expand fixed form group holder icon inner item items large left lg "
    "link links list lg main mask md message middle mini mobile outer panel primary right row secondary section site slot sm small space sticky text title toggle "
    "top unit wrap wrapper xl".split()
)
CHROME_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Elements that an opening tag of the key closes if one is open nearer than the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
WALL = set("article section div table td th body html main aside nav header footer form ul ol dl blockquote figure".split())


@dataclass
class Element:
    name: str
    chrome: bool
    article: bool
    main: bool
    path: int


@dataclass
class Block:
    text: str
    chrome: bool
    article: bool
    main: bool
    linked: int
    path: int


@dataclass
class Open:
    """Open elements, with the places of each name and of the walls, so that the nearest is found at once."""

    stack: list[Element] = field(default_factory=list)
    places: dict[str, list[int]] = field(default_factory=dict)
    walls: list[int] = field(default_factory=list)

    def push(self, e: Element) -> None:
        self.places.setdefault(e.name, []).append(len(self.stack))
        if e.name in WALL:
            self.walls.append(len(self.stack))
        self.stack.append(e)

    def nearest(self, names: set[str] | tuple[str, ...]) -> int:
        """Place of the nearest open element of ``names``, -1 if none."""
        return max((at[-1] for n in names if (at := self.places.get(n))), default=-1)

    def cut(self, at: int) -> list[Element]:
        """Takes out all elements from ``at`` on."""
        gone = self.stack[at:]
        del self.stack[at:]
        for e in gone:
            self.places[e.name].pop()
        while self.walls and self.walls[-1] >= at:
            self.walls.pop()
        return gone


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    #: Paths of the opening tags of blocks, and the blocks, in page order.
    order: list[int | Block] = field(default_factory=list)


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(raw)}


def _is_chrome(name: str, a: dict[str, str], in_article: bool) -> bool:
    if name in CHROME or name == "header" and not in_article:
        return True
    if name in ("html", "body", "main"):
        return False
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True
    if a.get("role", "").lower() in CHROME_ROLES:
        return True
    words = ARTICLE_WORDS if in_article else CHROME_WORDS
    return any(_is_mark(x, words, name == "article") for x in f"{a.get('class', '')} {a.get('id', '')}".split())


@lru_cache(maxsize=1 << 14)
def _named_parts(token: str) -> tuple[str, ...]:
    return tuple(w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", token))


def _is_mark(token: str, words: set[str], article: bool) -> bool:
    """Whether a class or id names a part that is no main text: its last word does (site-nav), or its first and the rest only say
    which part of that (comment-body). Names that begin like no-sidebar or has-comments say something else, and
    an ``article`` is marked by a name's first word only.
    """
    parts = _named_parts(token)
    if not parts or parts[0] in LAYOUT_WORDS:
        return False
    if parts[0] in words and all(w in words or w in PART_WORDS for w in parts[1:]):
        return True
    return not article and parts[-1] in words


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def parse(source: str | None) -> Page:
    """Blocks and tag tokens of a page in order."""
    page, opened, buffer = Page(), Open(), []
    stack, linked = opened.stack, 0
    if not source:
        return page

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(buffer).split())
        if text:
            top = stack[-1] if stack else Element("", False, False, False, 0)
            page.blocks.append(Block(text, top.chrome, top.article, top.main, min(linked, len(text)), top.path))
            page.order.append(page.blocks[-1])
        buffer.clear()
        linked = 0

    def pop_to(at: int) -> None:
        gone = stack[at:]
        if any(e.name in BLOCK for e in gone) or any(e.chrome for e in gone) and not (at and stack[at - 1].chrome):
            flush()
        opened.cut(at)

    at, n = 0, len(source)
    while at < n:
        m = TOKEN.search(source, at)
        end = m.start() if m else n
        if end > at:
            piece = entities.unescape(source[at:end])
            if opened.places.get("a"):
                linked += len(piece)
            buffer.append(piece)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                buffer.append(m[0][9:].removesuffix("]]>"))
            continue
        name = m[2].lower()
        if m[1]:
            k = opened.nearest((name,))
            if k >= 0 and (name in WALL or not opened.walls or k > opened.walls[-1]):
                pop_to(k)
            elif k < 0 and name in BLOCK and (name in WALL or not opened.walls):
                flush()
            continue
        if name == "br":
            buffer.append(" ")
            continue
        if name in BLOCK:
            k = opened.nearest(("p",))
            if k >= 0 and (not opened.walls or k > opened.walls[-1]):
                pop_to(k)
            flush()
        if name in IMPLIED:
            closes, until = IMPLIED[name]
            k = opened.nearest(closes)
            if k > opened.nearest(until):
                pop_to(k)
        a = _attributes(m[3][:-1]) if len(m[3]) > 1 else {}
        top = stack[-1] if stack else Element("", False, False, False, 0)
        chrome = _is_chrome(name, a, top.article)
        is_main = name == "main" or a.get("role", "").lower() == "main"
        inherited = top.chrome and not is_main  # a mark on what is around the main part is not about it
        if chrome and not top.chrome or is_main:
            flush()  # an inline notice is no part of the block around it
        is_article = name == "article" or a.get("itemprop", "").lower() == "articlebody"
        path = _hash(f"{top.path}/{name}.{a.get('class', '')}#{a.get('id', '')}")
        if name in BLOCK or name in RAW:
            page.order.append(path)
        if name in RAW:
            close = RAW[name].search(source, at)
            at = close.end()
            continue
        if name not in VOID:
            opened.push(Element(name, inherited or chrome, top.article or is_article, top.main or is_main, path))
    flush()
    return page


def tokens_of(page: Page) -> list[int | None]:
    """The token of each item of the page's order; blocks of articles have none."""
    return [x if isinstance(x, int) else None if x.article else _hash(f"{x.path}:{x.text}") for x in page.order]


def _in_order(ranks: list[int]) -> set[int]:
    """A longest increasing run of distinct ranks."""
    ends: list[int] = []
    last: list[int] = []
    before = [-1] * len(ranks)
    for i, r in enumerate(ranks):
        k = bisect_left(ends, r)
        if k:
            before[i] = last[k - 1]
        ends[k : k + 1], last[k : k + 1] = [r], [i]
    out, i = set(), last[-1] if last else -1
    while i >= 0:
        out.add(ranks[i])
        i = before[i]
    return out


def slots(page: Page, template: list[int]) -> list[tuple[int, Block]]:
    """(slot, block) of the blocks between the template's tokens, in page order."""
    rank = {t: k for k, t in enumerate(template)}
    found = [rank.get(t) if t is not None else None for t in tokens_of(page)]
    bounds = _in_order(list(dict.fromkeys(r for r in found if r is not None)))
    out: list[tuple[int, Block]] = []
    waiting: list[Block] = []
    before = -1
    for x, r in zip([*page.order, None], [*found, -1], strict=True):
        if r == -1 or r in bounds:
            if waiting:
                name = _hash(f"{template[before] if before >= 0 else ''}/{template[r] if r >= 0 else ''}")
                out += [(name, b) for b in waiting]
                waiting = []
            before = r
        elif isinstance(x, Block):
            waiting.append(x)
    return out


def main_text(page: Page, template: list[int], boilerplate: set[int]) -> str:
    """What the page's slots hold of main text, joined by newlines."""
    if not template:
        return "\n".join(b.text for b in page.blocks if not b.chrome)
    return "\n".join(b.text for slot, b in slots(page, template) if not b.chrome and (b.article or slot not in boilerplate))


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def token_vectors(pages: DataFrame) -> DataFrame:
    """host, token, pages, s1, s2, place: over all pages, how many hold the token, the sums that stand for its count
    vector, and the sum of its first places in millionths of a page."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple[str, int], list[int]] = {}
            for host, key, source in zip(b.column("host").to_pylist(), b.column("key").to_pylist(), b.column("html").to_pylist(), strict=True):
                page = parse(source)
                counts: dict[int, int] = {}
                place: dict[int, int] = {}
                for i, t in enumerate(tokens_of(page)):
                    if t is not None:
                        counts[t] = counts.get(t, 0) + 1
                        place.setdefault(t, i * 1_000_000 // len(page.order))
                for t, n in counts.items():
                    mark = xxhash.xxh3_64_intdigest(f"{key}:{n}")
                    s = sums.setdefault((host, t), [0, 0, 0, 0])
                    s[0] += 1
                    s[1] += mark >> 33
                    s[2] += mark & 0x7FFFFFFF
                    s[3] += place[t]
            hosts, found = [k[0] for k in sums], [k[1] for k in sums]
            yield pa.RecordBatch.from_pydict(
                {"host": pa.array(hosts, pa.string()), "token": pa.array(found, pa.int64())}
                | {c: pa.array([s[i] for s in sums.values()], pa.int64()) for i, c in enumerate(("pages", "s1", "s2", "place"))}
            )

    rows = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("page_id", "url", "html").alias("key"), "html")
    each = rows.mapInArrow(tokens, "host string, token long, pages long, s1 long, s2 long, place long")
    return each.groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in ("pages", "s1", "s2", "place")))


def templates(pages: DataFrame) -> DataFrame:
    """host, template: the tokens of each host's valid equivalence classes in page order."""
    vectors = materialise(token_vectors(pages), "vectors")
    of_host = vectors.groupBy("host").agg(F.max("pages").alias("host_pages"))
    frequent = vectors.join(of_host, "host").where((F.col("host_pages") >= MIN_PAGES) & (F.col("pages") >= MIN_SHARE * F.col("host_pages")))
    by_class = frequent.groupBy("host", "pages", "s1", "s2").agg(F.collect_list(F.struct((F.col("place") / F.col("pages")).alias("at"), "token")).alias("tokens"))
    valid = by_class.where(F.size("tokens") >= MIN_CLASS)
    return valid.groupBy("host").agg(F.sort_array(F.flatten(F.collect_list("tokens")))["token"].alias("template"))


def boilerplate_slots(pages: DataFrame, found: DataFrame) -> DataFrame:
    """host, boilerplate: the slots of each host's template that mostly hold no main text."""

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple[str, int], list[int]] = {}
            for host, source, template in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), b.column("template").to_pylist(), strict=True):
                chars: dict[int, list[int]] = {}
                for slot, x in slots(parse(source), template):
                    if not x.article:
                        c = chars.setdefault(slot, [0, 0])
                        c[0] += len(x.text)
                        c[1] += len(x.text) if x.chrome else 0 if x.main else x.linked
                for slot, (n, off) in chars.items():
                    s = sums.setdefault((host, slot), [0, 0])
                    s[0] += 1
                    s[1] += 2 * off > n
            yield pa.RecordBatch.from_pydict(
                {"host": pa.array([k[0] for k in sums], pa.string()), "slot": pa.array([k[1] for k in sums], pa.int64())}
                | {c: pa.array([s[i] for s in sums.values()], pa.int64()) for i, c in enumerate(("pages", "off"))}
            )

    rows = pages.select(host_of(F.col("url")).alias("host"), "html").join(found, "host")
    each = rows.mapInArrow(weighed, "host string, slot long, pages long, off long").groupBy("host", "slot").agg(F.sum("pages").alias("pages"), F.sum("off").alias("off"))
    off = each.where((F.col("pages") >= MIN_PAGES) & (F.col("off") >= SLOT_SHARE * F.col("pages")))
    return off.groupBy("host").agg(F.collect_list("slot").alias("boilerplate"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    found = materialise(templates(pages), "templates")
    # Written before the pages are joined, so its measured size lets Spark broadcast it.
    found = materialise(found.join(boilerplate_slots(pages, found), "host", "left"), "slots")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(parse(h), t or [], set(x or ())) for h, t, x in zip(*(b.column(c).to_pylist() for c in ("html", "template", "boilerplate")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(found, "host", "left").drop("host")
    kinds = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string"
    return rows.mapInArrow(extracted, kinds).withColumn("n_chars", F.char_length("text").cast("long"))
