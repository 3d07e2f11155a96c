"""Main-text extraction from HTML with equivalence-class template deduction.

A page is a sequence of tokens in page order: its elements (by their path of tags, classes and
ids, numbers of three digits and more alike) and its text blocks (by path and text). Over the distinct pages of a host, tokens
with equal occurrence vectors (how often each page holds them) form an equivalence class. A
class counts if SUPPORT different pages hold it and it has an element told apart by class, id or
kind. A class whose text is most of the text of its pages is a set of copies, no template. On a
page a class is valid if its tokens come in the class's order, round after round, and if it is
nested: each of its rounds lies between two neighbouring tokens of every class with wider rounds.

Text blocks of valid classes are the host's template. What is left lies in slots, and slots in
the template's containers, which nest: elements that every page of theirs holds once or, if all hold them
equally often, the first, the second and so on in roles of their own (so plain divisions are told apart
too). From the top down, the slots of a container's parts are compared over all pages of the host: parts
mostly of links go; if less than SIDE of a container's slot text lies outside its parts, the
parts kept are those from the one with the heading (or the first large one) to the last large
one, a large one holding SIDE of the container's slot text. So the article is the innermost part
of the template that leaves out no large slot. Tags, roles and names only label parts: menus,
headers, footers, sidebars, notices, adverts, forms and comments go.
A host with fewer than SUPPORT different pages has no template; then the slots of the element that says it
is the article (article or main, not of comments) are taken, or, without one, lists of links around the text
go and the rest stays.

Occurrence vectors are never gathered: a vector is told by two sums over pages of hashes of
(page, count), which partial aggregation adds up, so a host with a third of all pages is no
hot group. What is known of recurring tokens meets the pages as a broadcast sorted table if its
measured size is small, otherwise token by token in a shuffled join.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, stored, table
from .wordhash import pieces

SUPPORT = 4
#: Share of a container's slot text that makes a part of it a large one.
SIDE = 0.2
#: What is known of recurring tokens is broadcast up to so many bytes, at so many a token; beyond that it is joined by shuffle.
BROADCAST_BYTES, TOKEN_BYTES = 32 << 20, 40

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas textarea title noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that a start tag closes if open inside the nearest container.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
GROUPS = frozenset("ul ol dl table nav".split())
CONTAINERS = frozenset("body div section main article td center".split())
HEADINGS = ("h1", "h2")

OUT_TAGS = frozenset("nav aside footer form button select dialog menu head fieldset".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
OUT_NAMES = frozenset("ad ads adv adsense dfp nav aside share sharing login search reply replies respond notice notices gdpr hidden toolbar topbar pager pagination widget widgets toc tags signup alert".split())
OUT_STARTS = ("adsby", "adslot", "adunit", "adbox", "advert", "announce", "disclaimer", "paywall", "breadcrumb", "comment", "consent", "cookie", "discuss", "disqus", "footer", "masthead", "menu", "modal", "navbar", "navig", "newsletter", "popup", "promo", "recommend", "related", "sidebar", "social", "sponsor", "subscri", "banner", "overlay", "sitenav", "mainnav")
#: Names of page headers; an article's own header (post-header, entry-header) stays.
HEADER_STARTS = ("header", "siteheader", "pageheader", "mainheader", "topheader", "globalheader", "navheader")
AD_NAMES = frozenset("ad ads adv adsense advert advertisement adsbygoogle sponsored".split())
#: Names that suffice inside an article: as one of a name's words, and as the whole name.
SURE_WORDS = AD_NAMES | frozenset("comments commentlist disqus respond newsletter sidebar paywall".split())
SURE_NAMES = frozenset("comment cookienotice cookiebanner cookiebar cookieconsent".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|([^<]+|<)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_COMMENTS = re.compile(r"[.#](?:comment|disqus|respond|replies)", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_DIGITS = re.compile(r"\d{3,}")


def _key(parent: bytes, name: str) -> bytes:
    return blake2b(parent + name.encode(), digest_size=8).digest()


class Element:
    """at: place in page order; named: left out by its own tag, role or names; doubted: if most of it is links; out: left out for itself or what it lies in."""

    __slots__ = ("tag", "names", "parent", "key", "at", "named", "doubted", "out", "size", "linked", "holds_article", "holds_title")

    def __init__(self, tag: str, names: str, parent: Element | None, named: bool, doubted: bool = False, at: int = -1, key: bytes = b""):
        self.tag, self.names, self.parent, self.named, self.doubted, self.at = tag, names, parent, named, doubted, at
        self.key = _key(parent.key, f">{tag}{_DIGITS.sub('0', names) if names else ''}") if parent else key
        self.size = self.linked = 0
        self.out = self.holds_article = self.holds_title = False

    def up(self) -> Iterator[Element]:
        e: Element | None = self
        while e is not None:
            yield e
            e = e.parent

    @property
    def token(self) -> int:
        return int.from_bytes(self.key, "big", signed=True)

    def role(self, nth: int) -> int:
        """The token of the nth of the elements with this one's path."""
        return int.from_bytes(_key(self.key, f"[{nth}]"), "big", signed=True)

    @property
    def apart(self) -> bool:
        return bool(self.names) or self.tag in OUT_TAGS


class Block:
    """A run of text without block boundaries, and the element it lies in."""

    __slots__ = ("element", "text", "linked", "at")

    def __init__(self, element: Element, text: str, linked: int, at: int):
        self.element, self.text, self.linked, self.at = element, text, linked, at

    @property
    def token(self) -> int:
        return int.from_bytes(_key(self.element.key, "\0" + self.text), "big", signed=True)


def _hidden(attrs: dict[str, str]) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I))


def _is_out(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Whether an element is left out for itself. Of inline elements, which mostly are words of a sentence, only hidden ones and adverts."""
    if tag in OUT_TAGS or attrs and (_hidden(attrs) or attrs.get("role", "").lower() in OUT_ROLES):
        return True
    if not attrs:
        return tag == "header" and not in_article
    if tag in INLINE:
        return not AD_NAMES.isdisjoint(attrs.get("class", "").lower().split())
    if tag == "header" and not in_article:
        return True
    return not in_article and _by_name(attrs, False) or in_article and _by_name(attrs, True, sure=True)


def _by_name(attrs: dict[str, str], in_article: bool, sure: bool = False) -> bool:
    """Whether a class or the id is that of something left out; sure: beyond doubt."""
    for value in (attrs.get("class", ""), attrs.get("id", "")):
        for name in value.split():
            words = [w.lower() for w in _NAME.findall(name)]
            joined = "".join(words)
            if sure:
                if joined in SURE_NAMES or not SURE_WORDS.isdisjoint(words):
                    return True
                continue
            if any(w in OUT_NAMES or w.startswith(OUT_STARTS) for w in words) or joined in OUT_NAMES or joined.startswith(OUT_STARTS) or not in_article and joined.startswith(HEADER_STARTS):
                return True
    return False


def parse(source: str, host: str = "") -> tuple[list[Element], list[Block]]:
    """The elements of a page in order of their start tags, and its text blocks in page order. Paths begin with the host."""
    root = Element("", "", None, False, key=_key(b"", host))
    stack, elements, blocks = [root], [], []
    text: list[str] = []
    linked = at = place = links = 0

    def flush() -> None:
        nonlocal linked, place
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                inner = stack[-1]
                while inner.tag in INLINE:
                    inner = inner.parent
                blocks.append(Block(inner, joined, min(linked, len(joined)), place))
                place += 1
            text.clear()
        linked = 0

    def close_to(i: int) -> None:
        nonlocal links
        if any(e.tag not in INLINE for e in stack[i:]):
            flush()
        links -= sum(e.tag == "a" for e in stack[i:])
        del stack[i:]

    while m := _TOKEN.match(source, at):
        at = m.end()
        if m[7] is not None:
            e = stack[-1]
            while e.tag in INLINE and not e.named:
                e = e.parent
            if e.tag in INLINE:
                continue
            text.append(m[7])
            if links:
                linked += len(m[7])
            continue
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close_to(i)
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break  # an inline end tag closes nothing outside its block
            continue
        rest = m[3] if m[2] else m[6]
        if tag in RAW and not rest.endswith("/"):
            if tag not in INLINE:
                flush()
            end = re.compile(f"</{re.escape(tag)}\\b[^>]*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if tag in ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close_to(i)
                    break
                if stack[i].tag not in INLINE:
                    break
        for i in range(len(stack) - 1, 0, -1) if tag in CLOSES else ():
            if stack[i].tag in SCOPE[tag]:
                break
            if stack[i].tag in CLOSES[tag]:
                close_to(i)
                break
        if tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        attrs = {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTR.findall(rest)} if rest else {}
        names = "" if not attrs else "".join("." + x for x in sorted(attrs.get("class", "").split())) + ("#" + attrs["id"] if attrs.get("id") else "")
        parent = stack[-1]
        in_article = any(e.tag in ("article", "main") for e in stack)
        e = Element(tag, names, parent, tag not in ("html", "body") and _is_out(tag, attrs, in_article), in_article and bool(attrs) and tag not in INLINE and _by_name(attrs, True), place)
        place += 1
        if tag in ("article", "main") and not e.named:
            for x in parent.up():
                x.holds_article = True
        elif tag == "h1":
            for x in parent.up():
                x.holds_title = True
        if rest.endswith("/") and tag not in INLINE and tag not in CONTAINERS:
            continue
        elements.append(e)
        stack.append(e)
        links += tag == "a"
    flush()
    return elements, blocks


def _measure(elements: list[Element], blocks: list[Block]) -> None:
    """Sizes of elements, and which are out: one that is out only by its names stays if it holds the article, or the title and half of the text. Comments don't stay for articles of their own."""
    for b in blocks:
        for e in b.element.up():
            e.size += len(b.text)
            e.linked += b.linked
    total = sum(len(b.text) for b in blocks)
    comments = {id(e) for e in elements if e.named and _COMMENTS.search(e.names)}
    other = any(e.tag in ("article", "main") and not any(id(x) in comments for x in e.up()) for e in elements)
    for e in elements:  # parents come first
        stays = e.tag not in OUT_TAGS and (e.holds_article and not (other and id(e) in comments) or e.holds_title and 2 * e.size >= total)
        e.out = e.parent.out or (e.named or e.doubted and 2 * e.linked > e.size) and not stays
    for e in elements:
        e.size = e.linked = 0
    for b in blocks:
        for e in b.element.up() if not b.element.out else ():
            e.size += len(b.text)
            e.linked += b.linked


class Known:
    """What is known of recurring tokens: their class, place in it, how often every page of theirs holds them (0: not all as often), whether their class may be a template's text, and whether a container's slots are kept (-1: undecided). Containers told apart by their place have rows of their own for that."""

    FIELDS = ("token", "cls", "place", "once", "template", "size", "kept")

    def __init__(self, columns: dict[str, np.ndarray], in_order: bool = False):
        order = slice(None) if in_order else np.argsort(columns["token"], kind="stable")
        self.of = {k: columns[k][order] for k in self.FIELDS}

    @classmethod
    def read(cls, t: pa.Table | pa.StructArray) -> Known:
        get = (lambda k: t.field(k)) if isinstance(t, pa.StructArray) else (lambda k: t.column(k).combine_chunks())
        return cls({k: get(k).to_numpy(zero_copy_only=False) for k in cls.FIELDS})

    def __len__(self) -> int:
        return len(self.of["token"])

    def find(self, tokens: list[int]) -> tuple[list[int], dict[str, list]]:
        """Indices of the tokens that are known, and their fields."""
        have = self.of["token"]
        if not len(have) or not tokens:
            return [], {k: [] for k in self.FIELDS}
        wanted = np.array(tokens, np.int64)
        at = np.minimum(np.searchsorted(have, wanted), len(have) - 1)
        hit = np.flatnonzero(have[at] == wanted)
        return hit.tolist(), {k: v[at[hit]].tolist() for k, v in self.of.items()}


class Template:
    """A page's part in its host's template: positions of blocks that are template text, and its once-only elements that are kept or not."""

    def __init__(self, elements: list[Element], blocks: list[Block], known: Known | None):
        self.text: set[int] = set()
        self.once: dict[int, tuple[int, int]] = {}  # id of an element -> (the token of its role, kept: 1, 0 or -1)
        if known is None or not len(known):
            return
        n = len(elements)
        hit, of = known.find([x.token for x in (*elements, *blocks)])
        seen: dict[int, list] = defaultdict(list)  # class -> (place on the page, place in the class, block or -1)
        template: dict[int, int] = {}  # class that may be a template's text -> its tokens
        nth: dict[int, int] = defaultdict(int)
        roles: list[tuple[Element, int]] = []
        for k, i in enumerate(hit):
            x = elements[i] if i < n else blocks[i - n]
            seen[of["cls"][k]].append((x.at, of["place"][k], i - n if i >= n else -1))
            if i < n and of["once"][k] == 1:
                self.once[id(x)] = x.token, of["kept"][k]
            elif i < n and of["once"][k] and x.tag in CONTAINERS:
                # Every page has as many of them: the first, the second and so on play roles of their own.
                roles.append((x, x.role(nth[x.token])))
                nth[x.token] += 1
            elif i >= n and of["template"][k]:
                template[of["cls"][k]] = of["size"][k]
        self.once |= {id(x): (role, -1) for x, role in roles}
        decided, of_roles = known.find([role for _, role in roles])
        for k, i in enumerate(decided):
            self.once[id(roles[i][0])] = roles[i][1], of_roles["kept"][k]
        rounds = {c: r for c in seen if (r := _rounds(sorted(seen[c]))) is not None} if template else {}
        widest = lambda c: max(r[-1][0] - r[0][0] for r in rounds[c])
        wider: list[list[int]] = []
        for c in sorted(rounds, key=lambda c: (-widest(c), c)):
            if not _nested(rounds[c], wider):
                continue
            wider.append([x[0] for r in rounds[c] for x in r])
            if len(rounds[c][0]) == template.get(c):
                self.text |= {x[2] for r in rounds[c] for x in r if x[2] >= 0}


def _rounds(tokens: list[tuple[int, float, int]]) -> list[list[tuple[int, float, int]]] | None:
    """The rounds in which a class's tokens come on a page, each in the class's order; None if they don't."""
    width = len({x[1] for x in tokens})
    rounds = [tokens[i : i + width] for i in range(0, len(tokens), width)]
    order = sorted({x[1] for x in tokens})
    return rounds if all([x[1] for x in r] == order for r in rounds) else None


def _nested(rounds: list[list[tuple[int, float, int]]], wider: list[list[int]]) -> bool:
    """Whether each round lies between two neighbouring tokens of each wider class."""
    return all(bisect_right(c, r[0][0]) == bisect_right(c, r[-1][0]) for c in wider for r in rounds)


def _without_link_lists(blocks: list[Block], good: list[int]) -> list[int]:
    """good without the link blocks of groups that are mostly links and come before all running text, or after it and not beside a part of it."""
    links = {i for i in good if 2 * blocks[i].linked > len(blocks[i].text) and blocks[i].element.tag not in HEADINGS}
    running = [i for i in good if i not in links]
    if not running:
        return running
    holds = {id(e) for i in running for e in (blocks[i].element, blocks[i].element.parent)}

    def goes(i: int) -> bool:
        group = next((e for e in blocks[i].element.up() if e.tag in GROUPS or e.tag in CONTAINERS), blocks[i].element)
        return 2 * group.linked > group.size and (i < running[0] or i > running[-1] and id(group.parent) not in holds)

    return [i for i in good if i not in links or not goes(i)]


def labelled(elements: list[Element]) -> list[Element]:
    """The elements that say they are the article: the largest article element and those beside it, else the main element. _measure comes first."""
    within = lambda e, tops: any(x is o for x in e.up() for o in tops)
    tops = [e for e in elements if e.tag == "article" and not e.out and e.size]
    tops = [e for e in tops if not within(e.parent, tops)] or [e for e in elements if e.tag == "main" and not e.out and e.size]
    top = max(tops, key=lambda e: e.size, default=None)
    return [e for e in tops if e.parent is top.parent]


def slots(elements: list[Element], blocks: list[Block], template: Template | None = None) -> list[tuple[int, bool]]:
    """(block, main) of the blocks that lie in slots: those that aren't the template's; main: it is of the article.

    The article is what the host's template leaves; only a page without a template is asked for an element that says it is the article.
    """
    _measure(elements, blocks)
    held = template.text if template else ()
    data = [i for i in range(len(blocks)) if i not in held]
    good = [i for i in data if not blocks[i].element.out]
    if template and template.once:
        gone = {e for e, (_, kept) in template.once.items() if kept == 0}
        main = set(_without_link_lists(blocks, [i for i in good if not any(id(e) in gone for e in blocks[i].element.up())]))
    elif tops := {id(e) for e in labelled(elements)}:
        main = {i for i in good if any(id(e) in tops for e in blocks[i].element.up())}
    else:
        main = set(_without_link_lists(blocks, good))
    return [(i, i in main) for i in data]


def article(elements: list[Element], blocks: list[Block], template: Template | None = None) -> str:
    """The main text of a page."""
    return " ".join(blocks[i].text for i, main in slots(elements, blocks, template) if main)


def parts(elements: list[Element], blocks: list[Block], template: Template) -> Iterator[tuple[int, int, int, int, int, int, int, int]]:
    """(part, its path's token, container, slot text of the part, of the container, of it linked, whether it holds the heading, place) of the template's containers on a page."""
    _measure(elements, blocks)
    size, linked, top = defaultdict(int), defaultdict(int), set()
    good = [b for i, b in enumerate(blocks) if i not in template.text and not b.element.out]
    heading = next((b for h in HEADINGS for b in good if b.element.tag == h), None)
    for b in good:
        for e in b.element.up():
            size[id(e)] += len(b.text)
            linked[id(e)] += b.linked
    if heading is not None:
        top = {id(e) for e in heading.element.up()}
    for e in elements:
        if id(e) in template.once and size[id(e)] and e.tag in CONTAINERS and not e.out:
            for c in e.parent.up():
                if id(c) in template.once and c.tag in CONTAINERS:
                    yield template.once[id(e)][0], e.token, template.once[id(c)][0], size[id(e)], size[id(c)], linked[id(e)], int(id(e) in top), e.at
                    break


def _columns(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True) if rows else [()] * len(fields), fields, strict=True)], names=[n for n, _ in fields])


_FOUND = [("page", pa.int64()), ("token", pa.int64()), ("n", pa.int32()), ("place", pa.int32()), ("is_text", pa.bool_()), ("apart", pa.bool_()), ("size", pa.int64()), ("whole", pa.int64())]


def templates(pages: DataFrame, support: int = SUPPORT) -> DataFrame:
    """What is known of the tokens that `support` different pages hold: token, cls, place, once, template, size (of the class). pages: page, host, html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 2):
            rows = []
            for page, host, source in zip(*(c.to_pylist() for c in b.columns), strict=True):
                elements, blocks = parse(source, host)
                _measure(elements, blocks)
                whole = sum(len(x.text) for x in blocks if not x.element.out)
                count: dict[int, list] = {}
                for x in (*elements, *blocks):
                    c = count.setdefault(x.token, [0, x.at, isinstance(x, Block), isinstance(x, Element) and x.apart, 0])
                    c[0] += 1
                    c[4] += len(x.text) if c[2] and not x.element.out else 0
                rows += [(page, t, *c, whole) for t, c in count.items()]
            yield _columns(rows, _FOUND)

    found = pages.mapInArrow(run, "page long, token long, n int, place int, is_text boolean, apart boolean, size long, whole long")
    # Pages that come twice count once; then tokens are added up over pages. Both combine before they shuffle.
    once = found.groupBy("token", "page").agg(*(F.max(c).alias(c) for c in ("n", "place", "is_text", "apart", "size", "whole")))
    mark = F.xxhash64("page", "n")
    each = once.groupBy("token").agg(F.sum(F.shiftright(mark, 32)).alias("s1"), F.sum(mark.bitwiseAND(F.lit(0xFFFFFFFF))).alias("s2"), F.count(F.lit(1)).alias("pages"), F.max("n").alias("n"), F.min("n").alias("least"), F.avg("place").alias("place"), *(F.max(c).alias(c) for c in ("is_text", "apart")), *(F.sum(c).alias(c) for c in ("size", "whole")))
    each = stored(each.filter(F.col("pages") >= support), "tokens")
    classes = each.groupBy("s1", "s2").agg(F.count(F.lit(1)).cast("int").alias("members"), F.max("apart").alias("counts"), F.sum(F.when(F.col("is_text"), F.col("size")).otherwise(0)).alias("texts"))
    both = each.join(classes, ["s1", "s2"])
    template = F.col("is_text") & F.col("counts") & (2 * F.col("texts") <= F.col("whole"))
    return both.select("token", F.xxhash64("s1", "s2").alias("cls"), "place", F.when(F.col("n") == F.col("least"), F.col("n")).otherwise(0).cast("int").alias("once"), template.alias("template"), F.col("members").alias("size"))


def decisions(found: DataFrame) -> DataFrame:
    """(token, via, kept): whether a part's slots are kept, from parts() of all pages; via: the token of its path."""
    each = found.groupBy("token", "container").agg(F.max("via").alias("via"), F.sum("v").alias("v"), F.sum("vc").alias("vc"), F.sum("linked").alias("linked"), F.avg("heading").alias("heading"), F.avg("place").alias("place"))
    w = Window.partitionBy("container")
    d = each.withColumns({"share": F.col("v") / F.col("vc"), "links": 2 * F.col("linked") > F.col("v")})
    d = d.withColumns({"outside": 1 - F.sum("share").over(w), "most": F.max(F.when(~F.col("links"), F.struct("v", -F.col("place")))).over(w)})
    main = ~F.col("links") & (F.struct("v", -F.col("place")) == F.col("most"))
    large = main | ~F.col("links") & (F.col("share") >= SIDE)
    d = d.withColumns({"large": large, "end": F.max(F.when(large, F.col("place"))).over(w), "main_place": F.max(F.when(main, F.col("place"))).over(w)})
    first = F.col("large") | ~F.col("links") & (2 * F.col("heading") >= 1) & (F.col("place") <= F.col("main_place"))
    d = d.withColumn("start", F.min(F.when(first, F.col("place"))).over(w))
    inside = (F.col("outside") >= SIDE) | F.col("most").isNull() | F.col("place").between(F.col("start"), F.col("end"))
    return d.select("token", "via", F.when(F.col("most").isNotNull() & F.col("links"), 0).otherwise(inside.cast("int")).alias("kept"))


def _meet(rows: DataFrame, known: DataFrame):
    """Rows with what is known of their tokens, and a function that reads it from a batch (whose last column may be made for it): one broadcast table if it is small, else a list for each page."""
    if known.count() * TOKEN_BYTES <= BROADCAST_BYTES:
        given = rows.sparkSession.sparkContext.broadcast(Known.read(known.drop("via").toArrow()).of)

        def every(b: pa.RecordBatch) -> Iterator[Known]:
            one = Known(given.value, True)
            yield from (one for _ in range(b.num_rows))

        return rows.withColumn("known", F.lit(None).cast("int")), every

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 2):
            held = [(page, t) for page, host, source in zip(*(c.to_pylist() for c in b.columns), strict=True) for t in {x.token for part in parse(source, host) for x in part}]
            yield _columns(held, [("page", pa.int64()), ("via", pa.int64())])

    def each(b: pa.RecordBatch) -> Iterator[Known | None]:
        lists = b.column(b.num_columns - 1)
        yield from (Known.read(x.values) if x.is_valid else None for x in lists)

    mine = rows.select("page", "host", "html").mapInArrow(tokens_of, "page long, via long").distinct()
    lists = mine.join(known, "via").groupBy("page").agg(F.collect_list(F.struct(*Known.FIELDS)).alias("known"))
    return rows.join(lists, "page", "left"), each


def _lookup(known: DataFrame, kept: DataFrame | None) -> DataFrame:
    """What is known of tokens, and of roles of containers; via: the token under which a page finds the row."""
    if kept is None:
        return known.select(F.col("token").alias("via"), *Known.FIELDS[:-1], F.lit(-1).alias("kept"))
    both = known.join(kept.withColumnRenamed("via", "path"), "token", "full")
    rest = {"cls": F.lit(0), "place": F.lit(0.0), "once": F.lit(0), "template": F.lit(False), "size": F.lit(0), "kept": F.lit(-1)}
    return both.select(F.coalesce("path", "token").alias("via"), "token", *(F.coalesce(k, v).alias(k) for k, v in rest.items()))


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", source: str = "html", support: int = SUPPORT) -> DataFrame:
    """One row for each row of pages: id_col, url, text string, n_chars long (code points), slots array<struct<text, main>>.

    slots are the text blocks that aren't the host's template, in page order; text joins those
    of the article by one space. Character references are decoded, white space inside a block is
    one space. Null and empty html give an empty text. Pages with a null url or one without a
    host count as one host. Repeated pages of a host get equal texts and count once for the
    template (in the sizes of slots as often as they come). Of article elements apart from each other that
    are equally large the first counts, with those beside it. An empty table gives an empty
    result. Other columns are ignored.
    """
    spark = pages.sparkSession
    small_batches(spark)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(id_col).alias("__id"), F.col(url).alias("__url"), host.alias("host"), F.coalesce(source, F.lit("")).alias("html")).withColumn("page", F.xxhash64("host", "html"))
    known = stored(templates(rows.select("page", "host", "html"), support), "templates")
    weighed, told = _meet(rows, _lookup(known, None))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 2):
            found = []
            for host, page, k in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), told(b), strict=True):
                elements, blocks = parse(page, host)
                found += parts(elements, blocks, Template(elements, blocks, k))
            yield _columns(found, [(n, pa.int64()) for n in ("token", "via", "container", "v", "vc", "linked", "heading", "place")])

    sizes = weighed.select("page", "host", "html", "known").mapInArrow(weigh, "token long, via long, container long, v long, vc long, linked long, heading long, place long")
    met, known_of = _meet(rows, _lookup(known, stored(decisions(sizes), "slots")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 3):
            texts, kept = [], []
            for host, page, k in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), known_of(b), strict=True):
                elements, blocks = parse(page, host)
                mine = slots(elements, blocks, Template(elements, blocks, k))
                texts.append(" ".join(blocks[i].text for i, main in mine if main))
                kept.append([{"text": blocks[i].text, "main": main} for i, main in mine])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(kept, pa.list_(pa.struct([("text", pa.string()), ("main", pa.bool_())])))], names=["__id", "__url", "text", "n_chars", "slots"])

    from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

    slot = StructType([StructField("text", StringType()), StructField("main", BooleanType())])
    schema = StructType([StructField("__id", pages.schema[id_col].dataType), StructField("__url", StringType()), StructField("text", StringType()), StructField("n_chars", LongType()), StructField("slots", ArrayType(slot))])
    out = met.select("__id", "__url", "host", "html", "known").mapInArrow(run, schema)
    return out.select(F.col("__id").alias(id_col), F.col("__url").alias(url), "text", "n_chars", "slots")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
