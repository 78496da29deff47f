"""HTML extraction by union-free wrappers (operator 8).

Pages become streams of tag and text tokens.  Per host, the streams' skeletons
(texts blanked, tandem repeats of an element folded into a repeated group) are
aligned one after another into a wrapper, a regular expression without unions:
tokens that all pages share stay plain, a run that only one side has becomes an
optional group, a repeat of the element before it becomes a repeated group, and
texts become slots.  Every skeleton is then matched with its host's wrapper,
which gives each text its slot.

Slots are judged once per host, and a page's text is what stands in its main
slots.  Two things count: the place of a slot in the wrapper (inside which
elements, by tag, role and class) and how its texts vary over the host's pages.
A slot inside a menu, header, footer, sidebar, notice, advert, form or comment
list is not main.  Inside an article some class words are doubtful (a heading
may stand in an ``entry-header``): there a slot is dropped only if its texts
hardly vary.  Of the main slots a page keeps those in <article>, else <main>,
else <body>.  A text that stands in one place on most pages of a host is
template text and goes; inside an article its whole slot must be constant too,
since articles may share a sentence, and headings stay.

Hosts may be skewed: skeletons and slot texts are counted with partial
aggregates.  All skeletons shape their host's wrapper, whatever their number and
length: they are aligned in groups, then the groups' wrappers, level by level.
Every skeleton is matched with it, in parts; a text that matches no item of the
wrapper has its path as slot, so no page is left out.  Slots are met in a join that Spark broadcasts if the table is small.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable
from difflib import SequenceMatcher
from functools import lru_cache, reduce
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.runtime import cut, packed, ship

# Fixed values of HTML: elements without content, with raw text, inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
# A start tag on the left ends an open element on the right.
ENDS = {
    **{t: frozenset(["p"]) for t in
       "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()},
    "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]),
}
# Elements that hold no article text, by tag, by role, by words in class or id.
ASIDE_TAGS = frozenset("nav header footer aside form button dialog menu head".split()) | RAW
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
_WORD = r"(?:^|[-_\s.])(?:%s)(?:$|[-_\s.\d#!])"
ASIDE_WORDS = re.compile(_WORD % (
    r"nav|navbar|navigation|menu|breadcrumbs?|footer|sidebar|aside|widget|related|recommended|ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|alert|"
    r"popup|modal|overlay|newsletter|subscribe|signup|login|comments?|respond|disqus|share|sharing|social|pagination|pager"), re.I)
DOUBTFUL_WORDS = re.compile(_WORD % r"header|masthead|topbar|banner|search|skip|copyright|hidden", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)|([^<]++|<)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")


@lru_cache(maxsize=20_000)
def describe(tag: str, attributes: str) -> str:
    """Name of an element in streams: tag, classes and id; ``!`` at the end if
    its attributes say that it holds no article text."""
    got = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
    words = re.sub(r"\d+", "#", " ".join(x for x in (got.get("class"), got.get("id")) if x)).replace("/", "-")
    name = f"{tag}.{'.'.join(words.split())}" if words.strip() else tag
    out = got.get("role", "").lower() in ASIDE_ROLES or "hidden" in attributes.split() or got.get("aria-hidden") == "true"
    return name + "!" * out


REGIONS = ("article", "main", "body")


@lru_cache(maxsize=20_000)
def place_of(path: str) -> tuple[str, int]:
    """The region of a path of element names (article, main or body), and
    whether its texts can be main: 0 no, 1 doubtful, 2 yes."""
    region, can = "body", 2
    for name in path.split("/"):
        tag, _, words = name.rstrip("!").partition(".")
        if tag in ASIDE_TAGS or name.endswith("!"):
            return region, 0
        if tag == "article" or (tag == "main" or name.startswith("main")) and region == "body":
            region = "article" if tag == "article" else "main"
        if words and tag not in ("html", "body", "main", "article"):
            if ASIDE_WORDS.search(words):
                return region, 0
            if DOUBTFUL_WORDS.search(words):
                if region == "body":
                    return region, 0
                can = 1
        elif tag == "article" and re.search("comment", words, re.I):
            return region, 0
    return region, can


class Block:
    """A text block: its path of element names and its text."""

    __slots__ = ("path", "text")

    def __init__(self, path: str, text: str):
        self.path, self.text = path, text


class TagEnds:
    """Ends of start tags in one page, in time that grows with the page.

    Behind its name a tag goes on to the first ``>`` outside quotes.  A search
    that fails (there is none) marks what it passed outside quotes: any other
    search that comes there fails too, so that no place is passed twice."""

    _SPECIAL = re.compile("[>\"']")

    def __init__(self, html: str):
        self.html, self.starts, self.ends = html, [], []
        self.last = {c: html.rfind(c) for c in ">\"'"}

    def after(self, pos: int) -> int:
        """Place behind the ``>`` that ends a tag, or -1."""
        passed = []
        while pos <= self.last[">"]:
            k = bisect_right(self.starts, pos) - 1
            if k >= 0 and pos <= self.ends[k]:
                break
            m = self._SPECIAL.search(self.html, pos)
            passed.append((pos, m.start()))
            if m[0] == ">":
                return m.end()
            if m.start() == self.last[m[0]]:
                break
            pos = self.html.index(m[0], m.end()) + 1
        for start, end in passed:
            k = bisect_right(self.starts, start)
            self.starts.insert(k, start)
            self.ends.insert(k, end)
        return -1


DEEP = 64


def below(path: str, depth: int, tag: str, name: str) -> str:
    """Path of what stands in an element.  Inline elements only show if they hold
    no article text; below ``DEEP`` levels a path grows by those names alone that
    change whether its texts can be main, so that its length is bounded."""
    if tag in INLINE and name[-1] != "!":
        return path
    longer = f"{path}/{name}" if path else name
    return longer if depth < DEEP or place_of(longer) != place_of(path) else path


def parse(html: str | None) -> tuple[list[str], list[Block]]:
    """Token stream (``<name``, ``>name``, ``#path`` for a text) and blocks."""
    stream: list[str] = []
    blocks: list[Block] = []
    stack: list[tuple[str, str, str]] = []  # tag, name, path of what stands inside
    opened: Counter = Counter()  # tags on the stack
    text: list[str] = []
    where: str | None = None

    def flush():
        nonlocal where
        if text and where is not None:
            s = " ".join(unescape("".join(text)).split())
            if s:
                stream.append("#" + where)
                blocks.append(Block(where, s))
        text.clear()
        where = None

    def close(n: int):
        while len(stack) > n:
            flush() if stack[-1][0] not in INLINE else None
            tag, name, _ = stack.pop()
            opened[tag] -= 1
            stream.append(">" + name)

    pos, end = 0, len(html or "")
    ends = TagEnds(html or "")
    while pos < end:
        m = TOKEN.match(html, pos) if html[pos] != "<" or pos <= ends.last[">"] or html.startswith(("<!--", "<![CDATA["), pos) else None
        at = pos
        pos = m.end() if m else pos + 1
        if m and m[2] is not None:
            pos = ends.after(m.end(2))
            if pos < 0:  # no tag: its < is a text, as is what follows
                m, pos = None, at + 1
        if m is None or m[3] is not None:
            if m is None and pos <= end and ends.last[">"] < at:  # no tag can follow
                stop = html.find("<!--", pos)
                cdata = html.find("<![CDATA[", pos)
                pos = min(x for x in (stop, cdata, end) if x >= 0)
            part = html[at:pos]
            if where is None and not part.isspace():
                where = stack[-1][2] if stack else ""
            text.append(part)
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened[tag]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        close(k)
                        break
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        name = describe(tag, html[m.end(2) : pos - 1])
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, pos)
            pos = stop.end() if stop else end  # without an end it takes the rest of the page
            if tag not in INLINE:
                flush()
            stream += ["<" + name, ">" + name]
            continue
        if tag not in INLINE:
            flush()
            for ended in ENDS.get(tag, ()):
                if not opened[ended]:
                    continue
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == ended:
                        close(k)
                        break
                    if stack[k][0] not in INLINE and stack[k][0] != ended:
                        break
        stack.append((tag, name, below(stack[-1][2] if stack else "", len(stack), tag, name)))
        opened[tag] += 1
        stream.append("<" + name)  # inline elements do not show in streams
    flush()
    close(0)
    return [t for t in stream if t[0] == "#" or t[1:].split(".")[0] not in INLINE], blocks


# ------------------------------------------------------------------ wrappers

def fold(stream: list[str]) -> list[str]:
    """Fold tandem repeats of equal elements into one group, marked ``+``."""
    return folded(stream)[0]


def folded(stream: list[str]) -> tuple[list[str], list[int]]:
    """``fold``, and for every text of the stream its place in the result."""
    out: list[str] = []
    held: list[list[int]] = []  # texts that stand at a place
    opened: list[int] = []
    texts = 0
    for t in stream:
        out.append(t)
        held.append([])
        if t[0] == "<":
            opened.append(len(out) - 1)
            continue
        if t[0] == "#":
            held[-1].append(texts)
            texts += 1
        if t[0] == ">" and opened:
            start = opened.pop()
            body = out[start:]
            size = len(body)
            before = out[start - size : start] if start >= size else []
            if before and before[-1][0] == ">" and [x.rstrip("+") for x in before] == [x.rstrip("+") for x in body]:
                for k in range(start, len(out)):
                    held[k - size] += held[k]
                del out[start:], held[start:]
                out[-1] = out[-1].rstrip("+") + "+"
        elif t[0] == "#" and len(out) > 1 and out[-2] == t:
            out.pop()
            held[-2] += held.pop()
    at = [0] * texts
    for place, ks in enumerate(held):
        for k in ks:
            at[k] = place
    return out, at


def plain(skeleton: list[str]) -> list[list]:
    """The wrapper of one skeleton."""
    return [[t.rstrip("+"), False, t.endswith("+")] for t in skeleton]


class Bits:
    """Some tokens, and per token the places where it stands as bits of a number."""

    def __init__(self, tokens: list[str]):
        self.tokens, self.size = tokens, len(tokens) // 8 + 1
        self.at: dict[str, list[int]] = {}
        for j, t in enumerate(tokens):
            self.at.setdefault(t, []).append(j)
        self.often = {}
        for t, js in self.at.items():
            if len(js) > 8:
                row = np.zeros(self.size * 8, bool)
                row[js] = True
                self.often[t] = int.from_bytes(np.packbits(row, bitorder="little").tobytes(), "little")

    def grown(self, steps: list[str], keep: bool) -> list[int]:
        """Longest common subsequences: bit j of row i is 1 where the length for
        ``steps[: i + 1]`` grows with token j.  All rows, or the last."""
        v = full = (1 << len(self.tokens)) - 1
        rows = []
        for t in steps:
            u = v & (self.often[t] if t in self.often else sum(1 << j for j in self.at.get(t, ())))
            v = ((v + u) | (v - u)) & full
            if keep:
                rows.append(v ^ full)
        return rows if keep else [v ^ full]

    def pairs(self, steps: list[str]) -> list[tuple[int, int]]:
        """(place in ``steps``, in the tokens) of a longest common subsequence."""
        rows, got = self.grown(steps, True), []
        i, j = len(steps), len(self.tokens)
        while i and (j := (rows[i - 1] & ((1 << j) - 1)).bit_length()):
            i -= 1
            if not i or not rows[i - 1] >> (j - 1) & 1:
                j -= 1
                got.append((i, j))
        return got[::-1]

    def lengths(self, steps: list[str]) -> np.ndarray:
        """Length of it for the first 0, 1, ... tokens."""
        last = self.grown(steps, False)[0].to_bytes(self.size, "little")
        return np.concatenate([[0], np.cumsum(np.unpackbits(np.frombuffer(last, np.uint8), bitorder="little")[: len(self.tokens)], dtype=np.int64)])


ROOM = 1 << 25  # bytes that the kept rows may take


def common_pairs(a: list[str], b: list[str], room: int = ROOM) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, in order.  The rows of bits are
    kept if they take at most ``room`` bytes, else ``a`` is halved and ``b`` is
    split where both halves together are best."""
    if len(a) > len(b):
        return [(x, y) for y, x in common_pairs(b, a, room)]
    head = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    tail = next((k for k, (x, y) in enumerate(zip(a[head:][::-1], b[head:][::-1], strict=False)) if x != y), len(a) - head)
    out = [(k, k) for k in range(head)]
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(x) > 1 and len(x) * len(y) > 8 * room:
        half = len(x) // 2
        split = int(np.argmax(Bits(y).lengths(x[:half]) + Bits(y[::-1]).lengths(x[half:][::-1])[::-1]))
        out += [(head + i, head + j) for i, j in common_pairs(x[:half], y[:split], room)]
        out += [(head + half + i, head + split + j) for i, j in common_pairs(x[half:], y[split:], room)]
    elif x and y:
        out += [(head + i, head + j) for i, j in Bits(y).pairs(x)]
    return out + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


LONG = 2000  # items


def blocks_of(a: list[str] | Bits, b: list[str], long: int = LONG) -> list[tuple[int, int, int]]:
    """Equal runs (place in ``a``, in ``b``, length) of an alignment, with an
    empty one at the ends: longest runs first, beyond ``long`` items a longest
    common subsequence, whose time stays bounded.  ``a`` may come prepared."""
    bits = a if isinstance(a, Bits) else None
    a = bits.tokens if bits else a
    if max(len(a), len(b)) <= long:
        return SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
    ready = bits is not None and bits.size * len(b) <= ROOM
    out: list[list[int]] = []
    for x, y in ((x, y) for y, x in bits.pairs(b)) if ready else common_pairs(a, b):
        if out and out[-1][0] + out[-1][2] == x and out[-1][1] + out[-1][2] == y:
            out[-1][2] += 1
        else:
            out.append([x, y, 1])
    return [*map(tuple, out), (len(a), len(b), 0)]


def align(wrapper: list[list], other: list[list]) -> list[list]:
    """Merge two wrappers of [token, optional, repeated].

    What only one side has becomes optional, unless it repeats the group
    before it."""
    out: list[list] = []
    i = j = 0
    for x, y, size in blocks_of([w[0] for w in wrapper], [w[0] for w in other]):
        out += [[w[0], True, w[2]] for w in [*wrapper[i:x], *other[j:y]]]
        out += [[w[0], w[1] or o[1], w[2] or o[2]] for w, o in zip(wrapper[x : x + size], other[y : y + size], strict=True)]
        i, j = x + size, y + size
    return squeeze(out)


def squeeze(wrapper: list[list]) -> list[list]:
    """An optional element equal to the element before it is a repeat of it."""
    out: list[list] = []
    opened: list[int] = []
    for w in wrapper:
        out.append(w)
        if w[0][0] == "<":
            opened.append(len(out) - 1)
        elif w[0][0] == ">" and opened:
            start = opened.pop()
            body = out[start:]
            before = out[start - len(body) : start] if start >= len(body) else []
            if before and any(x[1] for x in body) and [x[0] for x in before] == [x[0] for x in body]:
                del out[start:]
                out[-1][2] = True
    return out


def merge(wrappers: Iterable[list[list]]) -> list[list]:
    """One wrapper of some, commonest first."""
    return reduce(lambda w, other: align(w, other) if w else other, wrappers, [])


def infer(skeletons: list[list[str]]) -> list[list]:
    """Wrapper of some skeletons, commonest first."""
    return merge(map(plain, skeletons))


def match(items: list[str] | Bits, skeleton: list[str]) -> dict[int, str]:
    """Slot per place of a text in a skeleton: the item of the wrapper (its
    tokens) that it matches, or its path where the wrapper has none."""
    slots = {k: t[1:] for k, t in enumerate(skeleton) if t[0] == "#"}
    for x, y, size in blocks_of(items, [t.rstrip("+") for t in skeleton]):
        slots |= {y + k: str(x + k) for k in range(size) if y + k in slots}
    return slots


def must_be_constant(path: str) -> bool | None:
    """Whether a text is template only in a slot that is constant as a whole:
    inside an article.  None: headings of articles are never template."""
    if place_of(path)[0] == "body":
        return False
    return None if re.fullmatch("h[1-6]", path.rsplit("/", 1)[-1].split(".")[0]) else True


def text_key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def extract(html: str | None, slots: dict[str, int], template: set[tuple[str, int]]) -> str:
    """Main text of a page, given the main slots of its host (path -> number of
    its region) and the (path, text key) pairs that are template text there.
    A region without any other text is kept whole, but for the body."""
    main = [(slots[b.path], b) for b in parse(html)[1] if b.path in slots]
    region = min((r for r, _ in main), default=0)
    kept = [b for r, b in main if r == region]
    own = [b for b in kept if (b.path, text_key(b.text)) not in template] if template else kept
    return "\n".join(b.text for b in (own if own or REGIONS[region] == "body" else kept))


# --------------------------------------------------------------- Spark stages

def host_of(url: Column) -> Column:
    """Lower-case host of a URL, or an empty text."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1)))
    return F.coalesce(host, F.lit(""))


def infer_wrappers(pages: DataFrame, fan_in: int = 40, min_pages: int = 5, share: float = 0.5, vary: float = 0.1) -> DataFrame:
    """(host, wrapper JSON, slots JSON, template JSON): one row per host of
    ``pages`` (host, html).

    All skeletons of a host shape its wrapper: about ``fan_in`` in a task, then as
    many of the wrappers that came out, until one is left.

    slots holds [path, number of its region] of the main slots.  A doubtful slot
    inside an article is main if its texts vary (more than ``vary`` texts per
    page) or if the host has fewer than ``min_pages`` distinct pages.

    template holds [path, text key] of texts that stand there on at least
    ``share`` of the host's distinct pages (hosts with fewer than ``min_pages``
    of them have none); pages with the same stream and texts are copies of one.  Inside an article their slots of the wrapper must be constant
    too: at most ``vary`` other texts per text of the slot."""
    ship(pages.sparkSession)

    def run(batches):
        for b in batches:
            rows = []
            for i, html in enumerate(b.column(1).to_pylist()):
                stream, blocks = parse(html)
                skeleton, at = folded(stream)
                body = json.dumps(skeleton, ensure_ascii=False)
                key = text_key(body)
                spots, before = {}, set()
                for x, place in zip(blocks, at, strict=True):
                    if place_of(x.path)[1]:
                        text = text_key(x.text)
                        # a text counts once per path and page: its later places are given as ~place
                        if (place, text) not in spots:
                            spots[place, text] = ~place if (x.path, text) in before else place
                        before.add((x.path, text))
                rows.append((i, 0, key, 0, None, None, body))
                rows.append((i, 1, key, text_key("\n".join(x.text for x in blocks)), list(spots.values()), [k for _, k in spots], None))
            at, *columns = zip(*rows, strict=True) if rows else [()] * 7
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["host", "kind", "skeleton", "page", "at", "keys", "body"])

    seen = pages.select("host", "html").mapInArrow(run, "host string, kind int, skeleton long, page long, at array<int>, keys array<long>, body string")
    counted = cut(seen.groupBy("host", "kind", "skeleton", "page").agg(F.max("body").alias("body"), F.first("at").alias("at"), F.first("keys").alias("keys")))
    each = counted.where("kind = 1").select("host", "skeleton", F.lit(1).alias("n"), "at", "keys")  # copies count once
    skeletons = counted.where("kind = 0").select("host", "skeleton", "body").join(each.groupBy("host", "skeleton").agg(F.sum("n").alias("n")), ["host", "skeleton"])
    skeletons = cut(skeletons)
    totals = skeletons.groupBy("host").agg(F.sum("n").alias("total"), F.ceil(F.count("*") / 1000).cast("int").alias("parts"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf.sort_values(["n", "part"], ascending=[False, True])
        read = (json.loads(x) for x in order.body)
        wrapper = merge(map(plain, read) if order["raw"].iloc[0] else read)
        return pd.DataFrame({"host": [pdf.host.iloc[0]], "group": [pdf.group.iloc[0]], "n": [pdf.n.sum()], "wrapper": [json.dumps(wrapper, ensure_ascii=False)]})

    def locate(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        items = Bits([w[0] for w in json.loads(right.wrapper.iloc[0])])
        out = []
        for host, key, body in zip(left.host, left.skeleton, left.body, strict=True):
            skeleton = json.loads(body)
            for place, slot in match(items, skeleton).items():
                path = skeleton[place][1:]
                region, can = place_of(path)
                if can:
                    out.append((host, key, place, path, slot, must_be_constant(path), REGIONS.index(region), can == 1))
        return pd.DataFrame(out, columns=["host", "skeleton", "place", "path", "slot", "strict", "region", "doubtful"])

    groups = skeletons.groupBy("host").agg(F.ceil(F.count("*") / fan_in).alias("groups"))
    left = cut(groups)
    most = left.agg(F.max("groups")).first()[0] or 0
    level = skeletons.select("host", F.col("skeleton").alias("part"), "n", "body", F.lit(True).alias("raw"))
    while True:
        level = level.join(left, "host").withColumn("group", F.pmod("part", "groups"))
        level = cut(level.select("host", "group", "part", "n", "body", "raw").groupBy("host", "group").applyInPandas(build, "host string, group long, n long, wrapper string"))
        if most <= 1:
            break
        level = level.select("host", F.col("group").alias("part"), "n", F.col("wrapper").alias("body"), F.lit(False).alias("raw"))
        left, most = left.select("host", F.ceil(F.col("groups") / fan_in).alias("groups")), math.ceil(most / fan_in)
    wrappers = level.select("host", "wrapper")
    # every skeleton, in the wrapper or not, is matched with it: in parts of about 1000
    large = totals.where(F.col("total") >= min_pages)
    left = skeletons.join(totals, "host").withColumn("part", F.pmod("skeleton", F.col("parts")).cast("int"))
    right = wrappers.join(totals, "host").select("host", "wrapper", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    places = left.select("host", "part", "skeleton", "body").groupBy("host", "part").cogroup(right.groupBy("host", "part")).applyInPandas(
        locate, "host string, skeleton long, place int, path string, slot string, strict boolean, region int, doubtful boolean")
    spots = each.select("host", "skeleton", "n", F.explode(F.arrays_zip("at", "keys")).alias("x")).select("host", "skeleton", "n", F.col("x.at").alias("at"), F.col("x.keys").alias("key"))
    spots = spots.withColumn("place", F.when(F.col("at") < 0, F.bitwise_not("at")).otherwise(F.col("at")))
    spots = spots.groupBy("host", "skeleton", "place", "key").agg(F.sum(F.when(F.col("at") >= 0, F.col("n")).otherwise(0)).alias("n"), F.sum("n").alias("all"))
    located = spots.join(places, ["host", "skeleton", "place"]).groupBy("host", "path", "slot", "strict", "region", "doubtful", "key").agg(F.sum("n").alias("n"), F.sum("all").alias("all"))
    located = cut(located)
    slots = located.where("strict").groupBy("host", "slot").agg((F.count("*") - 1 > vary * F.sum("all")).alias("varied"))
    enough = F.col("n") >= share * F.col("total")
    common = located.where("strict is not null").groupBy("host", "path", "key").agg(F.sum("n").alias("n")).join(large, "host").where(enough).select("host", "path", "key")
    pairs = located.join(common, ["host", "path", "key"]).join(slots, ["host", "slot"], "left")  # few rows meet the slots
    pairs = pairs.groupBy("host", "path", "key").agg(F.sum(F.when(~F.col("strict") | ~F.col("varied"), F.col("n"))).alias("n"))
    constant = pairs.join(large, "host").where(enough)
    constant = constant.groupBy("host").agg(F.to_json(F.collect_list(F.array("path", F.col("key").cast("string")))).alias("template"))
    seen = located.groupBy("host", "path", "region", "doubtful").agg(F.count("*").alias("texts"), F.sum("all").alias("all")).join(totals, "host")
    main = seen.where(~F.col("doubtful") | (F.col("total") < min_pages) | (F.col("texts") - 1 > vary * F.col("all")))
    main = main.groupBy("host").agg(F.to_json(F.collect_list(F.array("path", F.col("region").cast("string")))).alias("slots"))
    none = F.lit("[]")
    return wrappers.join(main, "host", "left").join(constant, "host", "left").select("host", "wrapper", F.coalesce("slots", none).alias("slots"), F.coalesce("template", none).alias("template"))


@lru_cache(maxsize=512)
def load_pairs(text: str | None) -> list[tuple[str, int]]:
    """[path, number] pairs of a row of ``infer_wrappers``."""
    return [(a, int(b)) for a, b in json.loads(text or "[]")]


@lru_cache(maxsize=512)
def load_host(slots: str | None, template: str | None) -> tuple[dict[str, int], set[tuple[str, int]]]:
    """Main slots and template texts of a host."""
    return dict(load_pairs(slots)), set(load_pairs(template))


def extract_pages(pages: DataFrame, wrappers: DataFrame, salt: int = 32) -> DataFrame:
    """``pages`` (url, html and others) plus ``text``, the main text; a column of
    that name is replaced.  The hosts' slots meet the pages in a salted join,
    which Spark turns into a broadcast if they are small."""
    ship(pages.sparkSession)
    names = [c for c in pages.columns if c != "text"]
    left = packed(pages.drop("text"), host=host_of(F.col("url")), salt=F.pmod(F.xxhash64("html"), F.lit(salt)).cast("int"))
    right = wrappers.select("host", "slots", "template", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("salt"))
    both = left.join(right, ["host", "salt"], "left").select("row", "slots", "template")
    schema = type(pages.schema)([pages.schema[c] for c in names]).add("text", "string")

    def run(batches):
        for b in batches:
            rows = b.column(0).flatten()
            htmls, slots, template = rows[names.index("html")].to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            out = [extract(h, *load_host(s, t)) for h, s, t in zip(htmls, slots, template, strict=True)]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(out, pa.string())], names=[*names, "text"])

    return both.mapInArrow(run, schema)


def main_text(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html and others) plus ``text``.

    Null html and pages without an article give an empty text.  Pages whose
    url is null or has no host share the host ''.  Repeated rows stay repeated;
    a column ``text`` is replaced, all others pass through.
    """
    return extract_pages(pages, cut(infer_wrappers(pages.select(host_of(F.col("url")).alias("host"), "html"))))


def op8_html_extraction(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return main_text(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
