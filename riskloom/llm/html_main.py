"""Main text of web pages by site template removal.

Each page is parsed into blocks of text and the element subtrees that span
them. Every subtree is hashed twice: over its tags and text, and as a shape, over tags,
class words and the shapes of its children without any text. Spark counts, per host and
per section of it (the first segment of the path), how many different pages hold
each hash, and subtrees that recur on many pages of their host, by share or by
number, or on a large share of a section are template and deleted, inside an article as anywhere else.
A shape says less than a text, so the page's core has none: what lies in an article or holds
one or, on a page without, lies in or holds the smallest element with ``CORE_SHARE`` of the text.
What a tag or its class already names as boilerplate (menus, forms, adverts,
comments, ...) is never a block at all; class names count as a whole, and never
those of the page, its article or what the article lies in. The article mark serves as a guard only:
a short paragraph, item or cell in an article is deleted if most pages hold it,
since fewer may repeat it by chance.

Pages are parsed twice, for the hashes and for the text, because parsing is
cheaper than storing the text of all pages in between.
"""

from __future__ import annotations

import hashlib
import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.shared import map_arrow, materialize

MIN_PAGES = 5
MIN_SHARE = 0.4
SHORT = 100              # characters under which the guards hold
GUARD_SHARE = 0.8
CORE_SHARE = 0.75        # of a page's characters, in the element taken for its article if none is marked
MANY_PAGES = 100         # template whatever the share, but for paragraphs, items and cells under SHORT
SALTS = 16

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attr>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
# The void, raw-text, inline and paragraph-like elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp annotation annotation-xml desc "
                "metadata".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var wbr "
                    # of formulas and drawings, whose text reads on
                    "math semantics mrow mi mn mo ms mtext mspace mstyle mfrac msqrt mroot msub msup msubsup mover munder "
                    "munderover mpadded mphantom menclose mtable mtr mtd svg g text tspan textpath path rect circle ellipse line "
                    "polyline polygon use defs symbol".split())
TEXT_LEVEL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption td th tr caption".split())
PLAIN = frozenset("div section center".split())  # say nothing without a class or a child
# Elements and class words that name what is not the article.
DROP = frozenset("head nav footer aside form button select dialog object canvas audio video menu".split())
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disclaimer disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices paywall popup promo "
    "promoted promotion recommended related respond share sharing sidebar signup social sponsor sponsored subscribe toolbar "
    "widget".split())
# What a class name may hold beside such words: "share-box" names a part of a page, "no-sidebar" its layout.
PART_WORDS = frozenset("area block box container inner items links list outer panel section wrap wrapper".split())
NEVER_BY_WORD = frozenset("html body main article".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
          "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
                   "main nav ol p pre section table ul".split())


def _boilerplate(tag: str, attr: str, in_article: bool) -> bool:
    if tag in DROP or (tag == "header" and not in_article):
        return True
    if not attr:
        return False
    for name, value in _ATTR.findall(attr):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and value in DROP_ROLES:
            return True
    return False


def _named(tag: str, attr: str) -> bool:
    """Whether a whole class name or id says boilerplate."""
    if not attr or tag in NEVER_BY_WORD:
        return False
    for name, value in _ATTR.findall(attr):
        if name.lower() in ("class", "id"):
            for whole in value.strip("\"'").lower().split():
                rest = set(re.split(r"[-_]+", whole)) - PART_WORDS
                if rest and rest <= DROP_WORDS:
                    return True
    return False


def _digest(said: str) -> int:
    return int.from_bytes(hashlib.blake2b(said.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


# Blocks are hashed into a running polynomial, so that of any run of them is known at once.
PRIME, BASE = (1 << 61) - 1, 0x1F3D5B79


class _Open:
    __slots__ = ("tag", "dropped", "article", "first", "named", "kind", "shape", "last", "articles")

    def __init__(self, tag, dropped, article, first, named=False, kind="", articles=0):
        self.tag, self.dropped, self.article, self.first, self.named = tag, dropped, article, first, named
        self.kind = kind                  # class words
        self.shape, self.last = 0, None   # polynomial of the children's shapes, the last of them
        self.articles = articles          # of the page before this element

    def add(self, shape):
        """A child; a run of like children counts as one, so that lists of any length are alike."""
        if shape != self.last:
            self.shape, self.last = (self.shape * BASE + shape) % PRIME, shape


def _class_words(attr: str) -> str:
    """The class words of an element without those that hold a number."""
    if not attr:
        return ""
    words = {w for name, value in _ATTR.findall(attr) if name.lower() == "class"
             for w in value.strip("\"'").lower().split() if not any(c.isdigit() for c in w)}
    return " ".join(sorted(words))


def parse(html: str) -> tuple[list[str], list[bool], list[tuple[int, int, int]]]:
    """(blocks, block lies in an article, (hash, first block, end block) of every
    subtree below body that has text), of a whole page. The two low bits of the
    hash are 3 for a guarded subtree, 1 for any other short paragraph, item or
    cell, else 0."""
    return read(html)[:3]


def read(html: str, lists: bool = True) -> tuple[list[str], list[bool], list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """What ``parse`` gives, and (hash, first block, end block) of the shape of every
    subtree outside the page's core that is no paragraph, item or cell and no plain
    division without class word and child. ``lists=False`` drops nothing for its tag, role or class."""
    blocks: list[str] = []
    in_article: list[bool] = []
    subtrees: list[tuple[int, int, int]] = []
    shapes: list[tuple[int, int, int]] = []
    held: list[tuple[int, int]] = []       # blocks of the elements that can be a core
    articles = 0
    text: list[str] = []
    stack: list[_Open] = []
    depth: dict[str, int] = {}             # open elements by tag
    run, size, power = [0], [0], [1]       # of the blocks so far: polynomial and length; powers of its base
    marked: set[str] = set()

    def dropped():
        return bool(stack) and stack[-1].dropped

    def flush():
        if text:
            words = " ".join(unescape("".join(text)).split())
            text.clear()
            if words:
                blocks.append(words)
                in_article.append(bool(stack) and stack[-1].article)
                run.append((run[-1] * BASE + _digest(words)) % PRIME)
                size.append(size[-1] + len(words))
                if len(power) < len(run):
                    power.append(power[-1] * BASE % PRIME)

    def push(node):
        stack.append(node)
        depth[node.tag] = depth.get(node.tag, 0) + 1

    def pop():
        node = stack.pop()
        depth[node.tag] -= 1
        if node.dropped or node.first == len(blocks):
            return
        if node.named:  # and no article came up in it
            del blocks[node.first:], in_article[node.first:], run[node.first + 1:], size[node.first + 1:]
            for found in (subtrees, shapes, held):
                while found and found[-1][-1] > node.first:
                    found.pop()
            return
        if node.tag in ("html", "body"):
            return
        shape = _digest(f"{node.tag}\x00{node.kind}\x00{node.shape}")
        if stack:
            stack[-1].add(shape)
        if node.tag not in TEXT_LEVEL and node.tag not in INLINE:
            held.append((node.first, len(blocks)))
            if (node.kind or node.last is not None or node.tag not in PLAIN) and not node.article and node.articles == articles:
                shapes.append((shape & ~3, node.first, len(blocks)))
        n = len(blocks) - node.first
        digest = _digest(f"{node.tag}\x00{n}\x00{(run[-1] - run[node.first] * power[n]) % PRIME}")
        short = node.tag in TEXT_LEVEL and size[-1] - size[node.first] < SHORT
        subtrees.append((digest & ~3 | ((3 if node.article else 1) if short else 0), node.first, len(blocks)))

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            if not dropped():
                text.append(html[at:])
            break
        if m.start() > at and not dropped():
            text.append(html[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["close"]:
            if tag in INLINE:
                if stack and stack[-1].tag == tag:
                    flush()
                    pop()
                continue
            flush()
            if depth.get(tag):
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if tag in VOID:
            if tag in ("br", "hr") and not dropped():
                text.append("\n")
            continue
        article = (bool(stack) and stack[-1].article) or tag in ("article", "main")
        drop = dropped() or lists and _boilerplate(tag, m["attr"], article)
        named = lists and not drop and _named(tag, m["attr"])
        if tag in INLINE:
            if tag == "a" and stack:
                stack[-1].add(1)
            if (named or drop) and not dropped() and not m["attr"].endswith("/"):
                flush()
                push(_Open(tag, drop, article, len(blocks), named))
            continue
        flush()
        if tag in ENDS_P and any(o.tag == "p" for o in stack[-4:]):
            while stack[-1].tag in ("p", *INLINE):
                pop()
                if not stack:
                    break
        closing = CLOSES.get(tag, ())
        while stack and stack[-1].tag in closing:
            pop()
        if tag in ("article", "main") and not drop and tag not in marked:
            marked.add(tag)  # the article itself, not a comment or teaser after it: what it lies in is no boilerplate
            for o in stack:
                o.named = False
        push(_Open(tag, drop, article, len(blocks), named, _class_words(m["attr"]), articles))
        if tag in ("article", "main") and not drop:
            articles += 1
    flush()
    while stack:
        pop()
    if not articles:
        core = min((h for h in held if size[h[1]] - size[h[0]] >= CORE_SHARE * size[-1]),
                   key=lambda h: h[1] - h[0], default=(0, len(blocks)))
        shapes = [t for t in shapes if t[2] <= core[0] or t[1] >= core[1]]
    return blocks, in_article, subtrees, shapes


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE,
            many_pages: int = MANY_PAGES, lists: bool = True) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages(page_id, url, html)``.

    A subtree is template if at least ``min_pages`` different pages of the host,
    and ``min_share`` of them, hold it (``GUARD_SHARE`` of them if it is guarded),
    if the same is true of the pages of a section, or if ``many_pages`` of the host
    hold it and it is no short paragraph, item or cell; so is a subtree whose shape
    recurs like that. Pages with the same text count once. ``lists=False`` leaves
    everything to the counts. A null or empty html has the empty text.
    Very long pages are read whole, in time that grows with their length however deep
    they nest. A null url is a host of its own. Repeated rows give repeated results; an empty
    table gives no rows.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    section = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/+([^/?#]+)/", 1), F.lit(""))
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                          host.alias("host"), section.alias("section"), F.xxhash64("html").alias("page"), "html")

    def hasher():
        def step(cols):
            out = {"host": cols["host"], "section": cols["section"], "page": cols["page"], "said": [], "hashes": []}
            for html in cols["html"]:
                blocks, _, trees, shapes = read(html or "", lists)
                out["said"].append(_digest("\x00".join(blocks)))
                out["hashes"].append(sorted({t[0] for t in trees + shapes}))
            return out
        return step

    hashed = materialize(map_arrow(source.select("host", "section", "page", "html"), hasher,
                                   "host string, section string, page long, said long, hashes array<long>").distinct(),
                         "subtrees")
    seen = hashed.select("host", "section", "page", F.explode("hashes").alias("hash"))
    share = F.when(F.col("hash").bitwiseAND(2) == 2, max(min_share, GUARD_SHARE)).otherwise(min_share)
    often = F.col("n") >= F.col("pages") * share

    def recurring(place, enough):
        totals = hashed.select(*place, "said").distinct().groupBy(*place).agg(F.count(F.lit(1)).alias("pages"))
        texts = hashed.select(*place, "said", F.explode("hashes").alias("hash")).distinct()
        counts = texts.groupBy(*place, "hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
        found = counts.join(totals, place).filter(enough)
        return found.select(*place, "hash", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))

    # the page side of a common subtree is spread over the salts
    salted = seen.withColumn("salt", F.pmod("page", F.lit(SALTS)).cast("int"))
    many = (F.col("n") >= many_pages) & (F.col("hash").bitwiseAND(1) == 0)
    of_host = salted.join(recurring(["host"], often | many), ["host", "hash", "salt"])
    of_section = salted.join(recurring(["host", "section"], often), ["host", "section", "hash", "salt"])
    key = ["host", "section", "page"]
    hit = of_host.select(*key, "hash").union(of_section.select(*key, "hash")).groupBy(*key).agg(
        F.collect_set("hash").alias("template"))
    hit = materialize(hit.select(*[F.col(c).alias("t_" + c) for c in key], "template"), "template")
    joined = source.join(hit, [F.col(c) == F.col("t_" + c) for c in key], "left")

    def assembler():
        def step(cols):
            texts = []
            for html, template in zip(cols["html"], cols["template"]):
                blocks, _, trees, shapes = read(html or "", lists)
                keep = [True] * len(blocks)
                lost = set(template or ())
                for h, s, e in trees + shapes:
                    if h in lost:
                        keep[s:e] = [False] * (e - s)
                texts.append(" ".join(b for b, k in zip(blocks, keep) if k))
            return {"page_id": cols["page_id"], "url": cols["url"], "text": texts, "n_chars": [len(t) for t in texts]}
        return step

    return map_arrow(joined.select("page_id", "url", "html", "template"), assembler,
                     "page_id long, url string, text string, n_chars long")
