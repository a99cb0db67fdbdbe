"""Main text of web pages through union-free wrappers inferred per host.

Pages of a host are aligned one after the other. Where their streams of tags
agree the wrapper stays; a run of like elements, or of like sequences, becomes
a repeated group; elements that only some pages have become optional; text that
differs becomes a slot. The main text is where most of what differs between the
host's pages lies: slots alike on all of them are template, wherever they are.
Names of elements then tell what of the rest is a menu, a notice or a reader's
comment, widen or narrow the main element to a named one that holds as much,
and decide alone only where a host has too few pages to compare.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafline.llm.runtime import cut, plus

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<alone>svg)\b(?:[^\"'>]|\"[^\"]*\"|'[^']*')*(?<=/)>"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|title|select|object|canvas)\b(?:[^\"'>]|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>[^\"'>]*(?:(?:\"[^\"]*\"|'[^']*')[^\"'>]*)*)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden|itemprop)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Names of elements, and of classes and ids, that hold no main text.
DROPPED_TAGS = frozenset("nav footer aside form button menu dialog head".split())
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar trending widget widgets".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
MAIN_NAMES = frozenset("article articlebody post postbody entry story maincontent".split())
DEEPEST = 150
#: Pages from which on a text alike on all of them is template.
ENOUGH = 3
NAME = re.compile(r"[a-z]+")


class Element:
    """An element of a page: ``items`` are texts and elements in page order."""

    __slots__ = ("key", "tag", "items", "link", "place")

    def __init__(self, key: str, tag: str, place: tuple[int, bool] | None = None):
        self.key, self.tag, self.items, self.link, self.place = key, tag, [], 0, place


def key_of(tag: str, attrs: str) -> str:
    """Tag with its names, one string: tokens with digits are left out, they differ by page."""
    names = []
    for name, value in ATTRIBUTE.findall(attrs) if attrs else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            names.append("hidden")
        elif name == "role":
            names.append(f"role={value}")
        elif name in ("class", "id", "itemprop"):
            names += [x for x in value.split() if not any(c.isdigit() for c in x)]
    return ".".join([tag, *sorted(set(names))])


def dropped(key: str, in_article: bool) -> bool:
    """Whether an element of this key is outside the main text."""
    tag, *names = key.split(".")
    if tag in DROPPED_TAGS or tag == "header" and not in_article:
        return True
    for name in names:
        if name.startswith("role="):
            if name[5:] in DROPPED_ROLES and not (in_article and name == "role=banner"):
                return True
            continue
        words = NAME.findall(name)
        if DROPPED_NAMES.intersection(words) or "header" in words and not in_article and not MAIN_NAMES.intersection(words):
            return True
    return False


def is_main(key: str) -> int:
    """2 for an article, 1 for a looser sign of main text, else 0."""
    tag, *names = key.split(".")
    words = {w for name in names for w in NAME.findall(name)}
    if tag == "article" or "articlebody" in words:
        return 2
    return int(tag == "main" or "role=main" in names or bool(MAIN_NAMES & words) or "content" in words)


def below(place: tuple[int, bool], key: str) -> tuple[int, bool]:
    """The surest sign of main text so far, and whether an element is outside it, from that of the one around an element of this key."""
    sure = max(place[0], is_main(key))
    return sure, place[1] or dropped(key, sure > 0)


def place_of(stack: list[Element]) -> tuple[int, bool]:
    """``below`` along the open elements, kept with each."""
    at = len(stack)
    while at and stack[at - 1].place is None:
        at -= 1
    place = stack[at - 1].place if at else (0, False)
    for e in stack[at:]:
        place = e.place = below(place, e.key)
    return place


def parse(page: str) -> Element:
    """The page's elements; whatever the markup, each text lands in one of them.

    Open elements beyond ``DEEPEST`` are kept for their closing tags, but their
    text lands in the element around them, except where they change what is main
    text: those are elements at any depth.
    """
    root = Element("", "")
    # where text lands, and the tag, of each open element; how many are open by tag
    stack, tags, opened, depths = [root], [""], Counter(), {}
    text: list[str] = []
    link = 0

    def flush() -> None:
        nonlocal link
        if text:
            block = " ".join(html.unescape("".join(text)).split())
            if block:
                stack[-1].items.append(block)
                stack[-1].link += min(link, len(block))
            text.clear()
        link = 0

    def push(tag: str, element: Element) -> None:
        stack.append(element)
        tags.append(tag)
        opened[tag] += 1

    def pop() -> str:
        stack.pop()
        opened[gone := tags.pop()] -= 1
        return gone

    in_link = False
    for found in TOKEN.finditer(page):
        kind = found.lastgroup
        if kind == "text":
            piece = found["text"]
            text.append(piece)
            if in_link:
                link += len(piece)
            continue
        tag = (found["tag"] or found["tag2"] or "").lower()
        if not tag:
            if found["raw"] or found["alone"]:
                flush()
            continue
        end, attrs = found["end"] or found["end2"], found["attrs"] or found["attrs2"] or ""
        if tag == "br":
            text.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = not end
            if end:
                if depths.get(tag):
                    depths[tag] -= 1
                    if not depths[tag] and opened[tag]:
                        flush()
                        while pop() != tag:
                            pass
            elif depths.get(tag):
                depths[tag] += 1
            elif attrs.strip() and dropped(key := key_of(tag, attrs), True):
                flush()
                child = Element(key, tag)
                stack[-1].items.append(child)
                push(tag, child)
                depths[tag] = 1
            continue
        flush()
        in_link = False
        if end:
            if opened[tag]:
                while (gone := pop()) != tag:
                    depths.pop(gone, None)
                depths.pop(tag, None)
            continue
        closes = CLOSES.get(tag)
        if closes and tags[-1] in closes:
            pop()
            if tag == "tr" and tags[-1] == "tr":
                pop()
        elif tags[-1] == "p":
            pop()
        if tag in VOID:
            continue
        child = Element(key_of(tag, attrs), tag)
        if len(stack) > DEEPEST:
            around = place_of(stack)
            child.place = below(around, child.key)
            if around[1] or child.place == around:
                child = stack[-1]
        if child is not stack[-1]:
            stack[-1].items.append(child)
        if not attrs.endswith("/"):
            push(tag, child)
    flush()
    return root


# A wrapper node is [key, flag, slot, children]. Flag: 0 once, 1 optional, 2
# repeated, 3 both. Slot: [pages, characters, characters in links, checksum of
# the text, or -1 if it differs], or None without own text.


def repeat(node: list) -> None:
    """Mark a node as a repeated group: its text, and that below it, is a slot even if alike so far."""
    node[1] |= 2

    def free(x: list) -> None:
        if x[2]:
            x[2][3] = -1
        for y in x[3]:
            free(y)

    free(node)


def fold(children: list) -> list:
    """``children`` with runs of like elements, and of like sequences, as repeated groups."""
    out: list = []
    for node in children:
        if out and out[-1][0] == node[0]:
            merge(out[-1], node)
            repeat(out[-1])
        else:
            out.append(node)
    last: dict[str, int] = {}
    gaps = set()
    for i, node in enumerate(out):  # a sequence comes again as far on as its first element
        gaps.add(i - last.get(node[0], i))
        last[node[0]] = i
    for period in sorted(x for x in gaps if x > 1):
        i = 0
        while i + 2 * period <= len(out):
            if all(out[i + j][0] == out[i + period + j][0] for j in range(period)):
                for j in range(period):
                    merge(out[i + j], out[i + period + j])
                    repeat(out[i + j])
                del out[i + period : i + 2 * period]
            else:
                i += 1
    return out


def merge(a: list, b: list) -> None:
    """Align node ``b`` with ``a`` of the same key, and generalise ``a`` to both."""
    a[1] |= b[1]
    if b[2]:
        if a[2]:
            a[2] = [a[2][0] + b[2][0], a[2][1] + b[2][1], a[2][2] + b[2][2], a[2][3] if a[2][3] == b[2][3] else -1]
        else:
            a[2] = list(b[2])
    left, right = a[3], b[3]
    if [x[0] for x in left] == [x[0] for x in right]:
        for x, y in zip(left, right, strict=True):
            merge(x, y)
        return
    out, i, j = [], 0, 0
    for x, y in [*aligned([x[0] for x in left], [x[0] for x in right]), (len(left), len(right))]:
        for node in (*left[i:x], *right[j:y]):
            node[1] |= 1
            out.append(node)
        if x < len(left):
            merge(left[x], right[y])
            out.append(left[x])
        i, j = x + 1, y + 1
    out = fold(out)
    # optional elements of one key, in whatever order pages have them, are one group
    first: dict[str, list] = {}
    kept = []
    for node in out:
        if node[1] & 1 and node[0] in first:
            merge(first[node[0]], node)
            repeat(first[node[0]])
        else:
            kept.append(node)
            if node[1] & 1:
                first[node[0]] = node
    a[3] = kept


def aligned(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Places of ``left`` and ``right`` that belong together, in order on both sides, in time about their length.

    Keys that either has once anchor the alignment along its longest rising run;
    between anchors, equal heads and tails and then the next equal key are taken.
    """
    out: list[tuple[int, int]] = []
    work = [(0, len(left), 0, len(right))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and left[a] == right[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and left[b - 1] == right[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        ours, theirs = Counter(left[a:b]), Counter(right[c:d])
        at = {key: y for y, key in enumerate(right[c:d], c) if theirs[key] == 1}
        anchors = _rising([(x, at[left[x]]) for x in range(a, b) if ours[left[x]] == 1 and left[x] in at])
        if anchors:
            low, under = a, c
            for x, y in [*anchors, (b, d)]:
                work.append((low, x, under, y))
                low, under = x + 1, y + 1
            out += anchors
            continue
        places: dict[str, list[int]] = {}
        for y in range(d - 1, c - 1, -1):
            places.setdefault(right[y], []).append(y)
        y = c - 1
        for x in range(a, b):
            rest = places.get(left[x], [])
            while rest and rest[-1] <= y:
                rest.pop()
            # the next equal key, unless it would skip more than it leaves to the rest of this side
            if rest and rest[-1] - y <= b - x:
                y = rest.pop()
                out.append((x, y))
    return sorted(out)


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of ``pairs`` whose second numbers rise, too."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, (_, y) in enumerate(pairs):
        at = bisect_left(tails, y)
        before.append(ends[at - 1] if at else -1)
        tails[at : at + 1], ends[at : at + 1] = [y], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def wrapper_of(element: Element) -> list:
    """The wrapper of one page's element."""
    texts = [x for x in element.items if isinstance(x, str)]
    slot = [1, sum(map(len, texts)), element.link, zlib.crc32(" ".join(texts).encode("utf-8", "replace"))] if texts else None
    return [element.key, 0, slot, fold([wrapper_of(x) for x in element.items if not isinstance(x, str)])]


def mass(node: list, fixed: bool, in_article: bool = False) -> int:
    """Characters of text outside links below a node and not dropped; ``fixed`` counts text alike on all pages too."""
    in_article = in_article or is_main(node[0]) > 0
    if dropped(node[0], in_article):
        return 0
    slot = node[2]
    own = slot[1] - slot[2] if slot and (fixed or not template(slot)) else 0
    return own + sum(mass(x, fixed, in_article) for x in node[3])


def template(slot: list) -> bool:
    """Whether a slot's text is alike on all of enough pages."""
    return slot[0] >= ENOUGH and slot[3] != -1


def centre_of(root: list, fixed: bool) -> list:
    """The deepest element that holds most of the text that differs."""
    at = root
    while at[3]:
        best = max(at[3], key=lambda x: mass(x, fixed))
        held = mass(best, fixed)
        if not held or held * 10 < mass(at, fixed) * 7 or best[0].split(".")[0] in ("p", "li", "h1", "h2", "h3", "td"):
            break
        at = best
    return at


def decide(root: list) -> list:
    """The wrapper as rules [key, kept, children]: whether an element's own text is main text."""
    fixed = not mass(root, False)  # one page or copies of one: nothing tells its template from its text
    whole, every = mass(root, fixed), mass(root, True)
    centre = centre_of(root, fixed)
    named: dict[int, int] = {1: 0, 2: 0}
    filled: dict[int, int] = {1: 0, 2: 0}  # text alike on all pages too

    def find(node: list, within: bool) -> None:
        if dropped(node[0], within):
            return
        if sure := is_main(node[0]):
            named[sure] += mass(node, fixed, within)
            filled[sure] += mass(node, True, within)
        for x in node[3]:
            if not sure or is_main(x[0]) != sure:
                find(x, within or sure > 0)

    find(root, False)
    # a named element stands for the main text if it holds the greater part of what differs, or of all text; names decide alone where nothing differs
    if 2 * named[2] >= max(whole, 1) or 2 * filled[2] >= max(every, 1) or fixed and named[2] and 2 * named[2] >= named[1]:
        want = 2
    elif 2 * named[1] >= max(whole, 1) or 2 * filled[1] >= max(every, 1) or fixed and 4 * named[1] >= max(whole, 1):
        want = 1
    else:
        want = 2 if fixed and named[2] else 0

    def rules(node: list, kept: bool, within: bool, out: bool) -> list:
        sure = is_main(node[0])
        out = out or dropped(node[0], within or sure > 0)
        within = within or sure > 0
        kept = kept or bool(want and sure >= want and (sure == want or want == 1)) or (not want and node is centre)
        slot = node[2]
        own = kept and not out
        # in a named main element text is template only if it is of links: articles may be alike
        if own and slot and not fixed and template(slot) and (not want or 5 * slot[2] > 4 * slot[1]):
            own = False
        if own and slot and not want and slot[0] >= ENOUGH and 5 * slot[2] > 4 * slot[1]:
            own = False
        return [node[0], int(own), [rules(x, kept, within, out) for x in node[3]]]

    return rules(root, False, False, False)


def extract(element: Element, rule: list, blocks: list[str]) -> None:
    """Append the main text's blocks of an element in page order."""
    at = 0
    for x in element.items:
        if isinstance(x, str):
            if rule[1]:
                blocks.append(x)
            continue
        here = next((k for k in (*range(at, len(rule[2])), *range(at)) if rule[2][k][0] == x.key), None)
        if here is not None:
            at = here
            extract(x, rule[2][here], blocks)


def local(own: list, host: list) -> list:
    """A page's wrapper ``own`` with what the host's pages tell of its slots: how many have them, and whether their text differs."""
    if own[2] and host[2]:
        own[2][0] = host[2][0]
        own[2][3] = own[2][3] if own[2][3] == host[2][3] else -1
    at = 0
    for x in own[3]:
        here = next((k for k in (*range(at, len(host[3])), *range(at)) if host[3][k][0] == x[0]), None)
        if here is not None:
            at = here
            local(x, host[3][here])
    return own


def plain_text(element: Element, within: bool = False) -> int:
    """Characters of a page outside links and what is dropped."""
    within = within or is_main(element.key) > 0
    if dropped(element.key, within):
        return 0
    return sum(len(x) if isinstance(x, str) else plain_text(x, within) for x in element.items) - element.link


def main_blocks(page: Element, rule: list, host: Callable[[], list]) -> list[str]:
    """The main text's blocks of a page by its host's rules, or by rules for the page's own template.

    The page's own are asked where the host's find less than half of its text,
    and taken where they find twice as much.
    """
    blocks: list[str] = []
    extract(page, rule, blocks)
    found = sum(map(len, blocks))
    if 2 * found < plain_text(page) or not blocks and page.items:
        own: list[str] = []
        extract(page, decide(local(wrapper_of(page), host())), own)
        if sum(map(len, own)) > 2 * found:
            return own
    return blocks


def host_of(url: str | None) -> str:
    """The host of a URL in lower case, empty if it has none."""
    found = re.match(r"\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "", re.I)
    return found[1].lower() if found else ""


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(x) for x in held.values()], pa.string())], ["host", "wrapper"])

    for batch in batches:
        for url, page in zip(batch.column(0), batch.column(1), strict=True):
            host, found = host_of(url.as_py()), wrapper_of(parse(page.as_py() or ""))
            if host in held:
                merge(held[host], found)
            else:
                held[host] = found
        if len(held) > 1000:
            yield out()
            held = {}
    yield out()


def _merged(given: pd.DataFrame) -> pd.DataFrame:
    whole = None
    for x in sorted(given.wrapper):
        if whole is None:
            whole = json.loads(x)
        else:
            merge(whole, json.loads(x))
    return pd.DataFrame({"host": given.host.iloc[:1], "wrapper": [json.dumps(whole)]})


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html", salts: tuple[int, ...] = (256, 16, 1)) -> DataFrame:
    """One wrapper a host, from all its pages: ``host, wrapper`` (JSON).

    Pages are merged where they are read, so what is shuffled is a wrapper for
    each host and task; several rounds of merging, each with fewer groups a
    host, keep a host that is everywhere from meeting in one task.
    """
    partial = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(_partial, "host string, wrapper string")
    for n in salts:
        salted = partial.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(n)))
        partial = salted.groupBy("host", "salt").applyInPandas(_merged, "host string, wrapper string")
    return partial


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = 16 << 20) -> DataFrame:
    """The main text of every page.

    Returns ``page_id, url, text, n_chars``. A null or empty page has an empty
    text. Pages without a host share one wrapper. The kind of main element is
    chosen for the host; a page on which that finds the smaller part of the text
    is of another template, and it is chosen for that page alone. Elements nested
    more than 150 deep count as their parent's text. Repeated rows each get their
    result; extra columns are ignored; an empty table gives an empty result.
    Wrappers go to all tasks if together they hold at most ``broadcast_bytes``,
    and are joined by host beyond that.
    """
    given = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    found = cut(infer(given, "url", "html"))
    size = found.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    schema = plus(given.select("page_id", "url").schema, text=T.StringType(), n_chars=T.LongType())

    def texts(batch: pa.RecordBatch, rule_of) -> pa.RecordBatch:
        out = []
        for i, page in enumerate(batch.column(2)):
            rule, host = rule_of(batch, i)
            out.append(" ".join(main_blocks(parse(page.as_py() or ""), rule, host)) if rule else "")
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], schema.names)

    if size <= broadcast_bytes:
        held = pages.sparkSession.sparkContext.broadcast(dict(map(tuple, found.collect())))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rules: dict[str, list] = {}
            load = lru_cache(64)(json.loads)

            def rule_of(batch: pa.RecordBatch, i: int) -> tuple[list | None, Callable[[], list]]:
                host = host_of(batch.column(1)[i].as_py())
                if host not in rules:
                    rules[host] = decide(json.loads(held.value[host]))
                return rules[host], lambda: load(held.value[host])

            for batch in batches:
                yield texts(batch, rule_of)

        return given.mapInArrow(run, schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list = [None, None]
        load = lru_cache(1)(json.loads)

        def rule_of(batch: pa.RecordBatch, i: int) -> tuple[list | None, Callable[[], list]]:
            text = batch.column(3)[i].as_py()
            if text != last[0]:
                last[:] = [text, decide(json.loads(text)) if text else None]
            return last[1], lambda: load(text)

        for batch in batches:
            yield texts(batch, rule_of)

    host = F.coalesce(F.lower(F.regexp_extract("url", r"(?i)^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    met = given.withColumn("host", host).join(found.hint("merge"), "host", "left").select("page_id", "url", "html", "wrapper")
    return met.mapInArrow(joined, schema)
