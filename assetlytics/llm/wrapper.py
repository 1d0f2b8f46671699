"""Main-text extraction by wrapper inference.

Pages of one host are aligned one after the other into a union-free regular
expression over their tokens: equal tags align, runs of alike siblings fold
into repeated groups, tags that some pages lack become optional, and strings
that differ become text slots. The host's wrapper then says of each part of a
page whether it is text of the page or template. Inside an article only a block
at a place of its own is template: headings, and blocks among alike siblings
whose text differs, are the article's however often they repeat.
"""

from __future__ import annotations

import html as html_lib
import json
import re
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, write_table

#: A string that at least so many aligned pages of distinct text show is template, where a page marks no article.
TEMPLATE_PAGES = 5
#: Wrappers that one task aligns in a round.
FAN_IN = 64
#: Most bytes of wrappers that are broadcast to the pages; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20

#: Elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead "
                  "tr ul caption option optgroup".split())
DROPPED = frozenset("head title script style noscript template iframe object embed applet canvas svg math audio video map "
                    "nav aside footer header form button select textarea input label fieldset dialog menu datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id that mark what is not the article, unless a word of STATES follows or the part is an article by name.
MARKS = frozenset("nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget widgets ad ads adv "
                  "advert adverts advertisement advertising adsense banner sponsor sponsored promo promos promotion cookie cookies consent gdpr "
                  "notice notices notification alert popup modal overlay subscribe subscription newsletter signup login social share sharing "
                  "related recommended recommendations comment comments commentlist respond reply replies disqus discussion search toolbar "
                  "pagination pager skip hidden".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
STATES = frozenset("open opened closed off on enabled disabled".split())
MAIN_WORDS = frozenset("article content post entry story main".split())
BOXES = frozenset("div section article main td th aside header footer figure center details fieldset form".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
          "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)/?>", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """An element: its key (tag, and what tells alike tags apart), children
    (nodes and strings), and whether it is no article / an article."""

    __slots__ = ("tag", "key", "kids", "drop", "main")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.kids, self.drop, self.main, self.key = tag, [], tag in DROPPED, tag in ("article", "main"), tag
        if "=" in attrs or "hidden" in attrs:
            found = {}
            for name, a, b, c, bare in _ATTR.findall(attrs):
                found[(bare or name).lower()] = a or b or c
            mark = f"{found.get('class', '')} {found.get('id', '')}"
            words = _WORDS.findall(mark)
            low = {w.lower() for i, w in enumerate(words) if not (i and words[i - 1].lower() in ("has", "with", "no", "without"))}
            role = found.get("role", "").lower()
            self.key = f"{tag}.{'.'.join(sorted(low))}" if low else tag
            if tag not in ("html", "body"):
                marks = {w.lower() for w, after in zip(words, [*words[1:], ""]) if after.lower() not in STATES} & low & MARKS
                self.drop |= bool(marks) and not (self.main and low & MAIN_WORDS) or role in ROLES or "hidden" in found or found.get("aria-hidden") == "true" or bool(
                    re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")))
                self.main |= role in ("main", "article") or "articlebody" in found.get("itemprop", "").lower()


def parse(html: str) -> Node:
    """A tree from any markup: end tags close what is open inside, paragraphs
    end at blocks, items at items; strings keep their references."""
    root = Node("#page")
    stack, at, low = [root], 0, None
    for m in _TOKEN.finditer(html):
        if m.start() < at:
            continue
        if m.start() > at:
            stack[-1].kids.append(html[at:m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].kids.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in BLOCK:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in CLOSES:
            same, bounds = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in bounds:
                    break
                if stack[i].tag in same.split():
                    del stack[i:]
                    break
        node = Node(tag, m[3] or "")
        stack[-1].kids.append(node)
        if tag in RAW:
            low = low or html.lower()
            end = low.find(f"</{tag}", at)
            at = len(html) if end < 0 else end
        elif tag not in VOID and not m[0].endswith("/>"):
            stack.append(node)
    if at < len(html):
        stack[-1].kids.append(html[at:])
    return root


# A wrapper item is [key, least, most, kids]: it stands least (0 or 1) to most (1 or 2, 2: any number of) times; a
# string is ["#", 0 or 1, 1 or 2, checksum of the only text seen, or 0 for a slot, digests of the pages that showed it];
# of the digests the TEMPLATE_PAGES smallest are kept, so any order of merging gives the same, and copies count once.


def _key(node: Node) -> str:
    """A node's key; boxes that hold text of their own are told from others."""
    own = node.tag in BOXES and any(isinstance(k, str) and k.strip() for k in node.kids)
    return f"{node.key}#" if own else node.key


def _checksum(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) or 1


def _text_item(s: str, digest: int) -> list | None:
    s = s.strip()
    return ["#", 1, 1, _checksum(s), [digest]] if s else None


def _strings(node: Node):
    for k in node.kids:
        if isinstance(k, str):
            yield k.strip()
        elif k.tag not in RAW:
            yield from _strings(k)


def page_digest(page: Node) -> int:
    """Checksum of a page's strings: copies that differ in attributes or scripts have one."""
    return _checksum("\n".join(x for x in _strings(page) if x))


def form(node: Node, digest: int | None = None) -> list:
    """The page's own expression: strings as they are, alike siblings folded."""
    if digest is None:
        digest = page_digest(node)
    items: list = []
    for k in node.kids:
        x = _text_item(k, digest) if isinstance(k, str) else [_key(k), 1, 1, form(k, digest)]
        if x is None:
            continue
        if items and items[-1][0] == x[0]:
            items[-1] = _join(items[-1], x)
            items[-1][2] = 2
        else:
            items.append(x)
    return _fold_pairs(items)


def _fold_pairs(items: list) -> list:
    """(a b)(a b).. becomes one repeated group, keyed by its members."""
    for width in (2, 3):
        i, out = 0, []
        while i < len(items):
            keys = [x[0] for x in items[i:i + width]]
            j = i + width
            while len(keys) == width and [x[0] for x in items[j:j + width]] == keys:
                j += width
            if j > i + width:
                group = items[i:i + width]
                for k in range(i + width, j, width):
                    group = [_join(a, b) for a, b in zip(group, items[k:k + width])]
                out.append(["(" + " ".join(keys) + ")", 1, 2, group])
                i = j
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def _join(a: list, b: list) -> list:
    """Two items of one key: strings that differ become a slot."""
    least, most = min(a[1], b[1]), max(a[2], b[2])
    if a[0] == "#":
        if a[3] != b[3] or not a[3]:
            return ["#", least, most, 0, []]
        return ["#", least, most, a[3], a[4] if a[4] == b[4] else sorted({*a[4], *b[4]})[:TEMPLATE_PAGES]]
    return [a[0], least, most, align(a[3], b[3])]


def align(a: list, b: list) -> list:
    """Align two expressions: items on a longest common run of keys join, an
    item that one side lacks becomes optional, and neighbours that got the
    same key fold into a repetition."""
    if a == b:
        return a
    pairs = _matches([x[0] for x in a], [x[0] for x in b])
    out, i, j = [], 0, 0
    for p, q in [*pairs, (len(a), len(b))]:
        out += [[x[0], 0, *x[2:]] for x in a[i:p]] + [[x[0], 0, *x[2:]] for x in b[j:q]]
        if p < len(a):
            out.append(_join(a[p], b[q]))
        i, j = p + 1, q + 1
    merged: list = []
    for x in out:
        if merged and merged[-1][0] == x[0]:
            y = _join(merged[-1], x)
            y[1], y[2] = max(merged[-1][1], x[1]), 2
            merged[-1] = y
        else:
            merged.append(x)
    return merged


def _matches(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence (common ends first)."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    ea, eb = len(a), len(b)
    while ea > lo and eb > lo and a[ea - 1] == b[eb - 1]:
        ea, eb = ea - 1, eb - 1
    x, y = a[lo:ea], b[lo:eb]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    mid, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            mid.append((lo + i, lo + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return [(k, k) for k in range(lo)] + mid + [(ea + k, eb + k) for k in range(len(a) - ea)]


def expression(items: list) -> str:
    """A wrapper as text, for people: tags, #text slots, ? and +."""
    def one(x):
        body = ("#PCDATA" if not x[3] else f"#{x[3]:08x}") if x[0] == "#" else f"<{x[0]}>{expression(x[3])}</>"
        return (f"({body})" if x[1] == 0 or x[2] == 2 else body) + ("*" if x[1] == 0 and x[2] == 2 else "?" if x[1] == 0 else "+" if x[2] == 2 else "")
    return " ".join(one(x) for x in items)


def _place(node: Node, items: list) -> list:
    """(child, its wrapper item or None) along the alignment of a page's node;
    white space between tags aligns with nothing."""
    flat = []
    for x in items:
        flat += [([y[0], min(x[1], y[1]), *y[2:]], True) for y in x[3]] if x[0][0] == "(" else [(x, x[2] == 2)]
    by: dict = {}
    for n, (x, _) in enumerate(flat):
        by.setdefault(x[0], []).append(n)
    out, at = [], 0
    for k in node.kids:  # the first item from here on, a repeated one before it, or any of that key
        key = _key(k) if not isinstance(k, str) else "#" if k.strip() else None
        places = by.get(key, [])
        p = next((n for n in places if n >= at), places[-1] if places else None)
        out.append((k, None if p is None else flat[p][0]))
        if p is not None:
            at = p if flat[p][1] else p + 1
            if not any(n >= at for n in places) and len(places) > 1:
                at = min(at, p)
    return out


def _has_main(node: Node) -> bool:
    return any(not isinstance(k, str) and not k.drop and (k.main or _has_main(k)) for k in node.kids)


def _main_words(node: Node) -> bool:
    return bool(set(node.key.split(".")[1:]) & MAIN_WORDS)


def _has_words(node: Node) -> bool:
    return any(not isinstance(k, str) and not k.drop and (_main_words(k) or _has_words(k)) for k in node.kids)


def _constant(s: str, x: list | None) -> bool:
    """Whether a string is its item's one text, which enough pages of distinct text show."""
    return x is not None and x[3] != 0 and len(x[4]) >= TEMPLATE_PAGES and _checksum(s.strip()) == x[3]


def _line(strings: list) -> str:
    return " ".join(html_lib.unescape("".join(strings)).split())


def _has_slot(items: list) -> bool:
    return any(x[3] == 0 if x[0] == "#" else _has_slot(x[3]) for x in items)


def _slot_keys(items: list) -> set:
    """Keys of a node's children that hold text which differs."""
    flat = [y for x in items for y in (x[3] if x[0][0] == "(" else [x])]
    return {x[0] for x in flat if x[0] != "#" and _has_slot(x[3])}


def main_text(page: Node, wrapper: list | None) -> str:
    """The article's blocks. A page that marks one (article, main, roles, or
    the class words of ``MAIN_WORDS``) gives what is inside; otherwise all of
    its body, less the strings that the wrapper holds as template. Inside an
    article a whole block goes if the wrapper holds each of its strings as
    template that stands on every page; a block with a slot stays whole, and so
    do headings and blocks with alike siblings (of one tag and class) whose text
    differs: repeated headings and short answers are the article's. Parts that
    are no article by tag, role or class words (menus, adverts, comments, ..)
    go from either."""
    marked = _has_main(page)
    is_main = (lambda n: n.main) if marked else _main_words if _has_words(page) else None
    blocks: list[list[str]] = [[]]
    fixed = [True]  # of each block: the wrapper holds all of it as template

    def walk(node: Node, items: list, inside: bool, sure: bool):
        placed = _place(node, items) if wrapper is not None else [(k, None) for k in node.kids]
        slots = _slot_keys(items) if inside else ()
        for k, x in placed:
            here = sure and x is not None and x[1] == 1
            if isinstance(k, str):
                if inside or is_main is None and not _constant(k, x):
                    blocks[-1].append(k)
                    fixed[-1] = fixed[-1] and (not k.strip() or inside and here and _constant(k, x))
            elif not k.drop:
                if k.tag in BLOCK:
                    blocks.append([])
                    fixed.append(True)
                elif k.tag == "br":
                    blocks[-1].append(" ")
                walk(k, x[3] if x is not None else [], inside or (is_main is not None and is_main(k)),
                     here and k.tag not in HEADINGS and _key(k) not in slots)
                if k.tag in BLOCK:
                    blocks.append([])
                    fixed.append(True)
    walk(page, wrapper or [], False, True)
    lines = [_line(b) for b, f in zip(blocks, fixed) if not f]
    return "\n".join(x for x in lines if x)


def host_of(url) -> F.Column:
    """Lower-case host of a URL without user and port; null or none: ''."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(host, F.lit(""))


_STATE = "host string, pages long, wrapper string"


def _merge_all(states: list[tuple[int, list]]) -> tuple[int, list]:
    pages, out = 0, None
    for n, w in states:
        pages, out = pages + n, w if out is None else align(out, w)
    return pages, out or []


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per host: host, pages, wrapper (JSON of its expression).

    Tasks align the pages that they read, host by host, before anything is
    shuffled. The hosts' partial wrappers then meet in rounds, at most about
    ``FAN_IN`` in a group, so a host that holds a third of all pages is never
    gathered into one task. Null and empty pages align with nothing; no pages
    give no rows."""
    small_batches(pages.sparkSession)

    def start(batches):
        held: dict = {}

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array([n for n, _ in held.values()], pa.int64()),
                 pa.array([json.dumps(w, separators=(",", ":")) for _, w in held.values()], pa.string())], names=["host", "pages", "wrapper"])
        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w, old = form(parse(page)), held.get(host)
                held[host] = (1, w) if old is None else (old[0] + 1, align(old[1], w))
            if len(held) > 5000:
                yield out()
                held.clear()
        if held:
            yield out()
    rows = pages.select(host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").alias("html")).where("html <> ''")
    state = write_table(rows.mapInArrow(start, _STATE), "wrappers")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["wrapper", "pages"])
        n, w = _merge_all([(int(p), json.loads(x)) for p, x in zip(pdf["pages"], pdf["wrapper"])])
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "pages": [n], "wrapper": [json.dumps(w, separators=(",", ":"))]})
    while True:
        most = state.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return state
        # hosts of up to FAN_IN rows fall into one group; others into groups of about FAN_IN
        sizes = state.groupBy("host").agg(F.ceil(F.count("*") / FAN_IN).alias("groups"))
        dealt = state.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("wrapper", "pages"), F.col("groups")))
        state = write_table(dealt.select("host", "part", "pages", "wrapper").groupBy("host", "part").applyInPandas(merge, _STATE), "wrappers")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", wrappers: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    References are decoded, white space inside a block becomes one space, and
    blocks are joined by a line feed; nothing else is dropped or cut. A null or
    empty page, and one without main text, gives '' and 0. Rows are judged one
    by one (a null or repeated id is allowed); a null or odd URL belongs to the
    host ''."""
    small_batches(pages.sparkSession)
    wrappers = write_table(wrappers if wrappers is not None else infer_wrappers(pages, url_col, html_col), "host-wrappers")
    found = wrappers.select(F.col("host").alias("w_host"), "wrapper")
    if (wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0) <= BROADCAST_BYTES:
        found = F.broadcast(found)
    rows = (pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"),
                         host_of(F.col(f"`{url_col}`")).alias("host"))
            .join(found, F.col("host") == F.col("w_host"), "left").select("page_id", "url", "html", "wrapper"))

    def run(batches):
        known: dict = {}
        for b in batches:
            texts = []
            for page, w in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if w is not None and w not in known:
                    if len(known) > 2000:
                        known.clear()
                    known[w] = json.loads(w)
                texts.append(main_text(parse(page), known.get(w)) if page else "")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
