"""Main text of web pages by consensus host paths.

A page's containers (div, article, section and the like) are scored by the prose they hold. Every page votes for
the generalised tag-class path of its best container; votes are counted per host in Spark, and each
page's text is taken from the containers on its host's winning path. Pages without such a container
fall back to their own best one. A page is parsed once, into its blocks of prose and the tree of their containers, which are kept
as a table; the texts are then cut from that table by DataFrame functions.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import blocks
from .tables import written

#: Hosts, and bytes of their names and the numbers of their winning paths, that may travel with every task; with more, pages and paths are joined by shuffle.
HOSTS, HOST_BYTES = 300_000, 16 << 20
#: The share of the best score that a deeper container needs to be preferred.
NEARLY = 0.8
#: Characters that a block directly in the body, a cell or a form has if it is prose of the article rather than a line of the site.
LONG = 80

_names = lambda s: frozenset(s.split())
#: Element names of HTML by kind.
VOID = _names("area base br col embed hr img input link meta param source track wbr")
RAW = _names("script style textarea title noscript iframe xmp noembed noframes template svg math object canvas audio video select")
CONTAINERS = _names("html body div article section main td center blockquote form fieldset details nav aside header footer dialog menu table tbody tr ul ol dl")
#: Containers that are parts of an article rather than hold one; these don't get votes but for section.
PARTS = _names("section blockquote table tbody tr ul ol dl")
BLOCKS = CONTAINERS | _names("p h1 h2 h3 h4 h5 h6 li dt dd pre address figure figcaption hr th thead tfoot caption summary legend option optgroup hgroup search")
BOILERPLATE = _names("nav aside footer form button dialog menu label input fieldset head search")
CLOSES_P = BLOCKS
#: What an open element is closed by: a start tag of the second kind ends one of the first.
ENDED_BY = {"li": _names("li"), "dt": _names("dt dd"), "dd": _names("dt dd"), "td": _names("td th tr"), "th": _names("td th tr"), "tr": _names("tr tbody tfoot"), "option": _names("option")}
#: Words of class, id or role that mark what is not the article.
MARKS = _names(
    "ad ads adv advert adverts advertisement advertising adsense banner billboard promo promotion promoted sponsor sponsored nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar side aside rail widget widgets footer foot colophon masthead topbar toolbar cookie cookies gdpr consent notice notices alert popup modal overlay dialog newsletter subscribe "
    "subscription signup login search share sharing social related recommended recommendations comment comments commentlist reply replies respond disqus discussion pagination pager "
    "skip hidden print tags taglist toc copyright legal disclaimer contentinfo complementary"
)
COMMENTS = _names("comment comments commentlist reply replies respond disqus")
#: An element named after both, as content-sidebar-wrap, holds the article too.
PROSE, WRAPPERS = _names("article content main post entry story body text page"), _names("wrap wrapper container layout grid has with no row")
#: Classes of what holds an article, and of its parts.
HOLDERS, LEADS = _names("article post entry story"), _names("title headline lead lede intro standfirst summary abstract")

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
#: What swallows the rest of a page without a ">".
OPEN_ENDED = re.compile(r"<!--.*|<!\[CDATA\[.*", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?+""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
BLANK = re.compile(r"\s+")


#: For each name, the open elements that its start tag may end.
ENDS = {name: [tag for tag, by in ENDED_BY.items() if name in by] for name in frozenset().union(*ENDED_BY.values())}
OPENERS = _names("nav header aside footer head")


def _tag(name: str) -> str:
    return name.partition(".")[0]


def _words(name: str) -> set[str]:
    """The words of the classes of a container's name."""
    return {w.lower() for w in WORD.findall(name.partition(".")[2])}


@lru_cache(1 << 16)
def _below(above: int, name: str) -> int:
    """The number of a path, from that of the path above it and the last name."""
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "replace"), digest_size=8, key=above.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)


@dataclass(slots=True)
class Element:
    tag: str
    node: int
    skip: bool
    link: bool


@dataclass(slots=True)
class Page:
    """The blocks of prose of a page in order (container, text, characters within links), and the tree of the containers' paths.

    Node 0 is the page; a node has a name (tag and classes), what is above it and the children by name. Elements of equal paths are one node.
    """

    blocks: list[tuple[int, str, int]] = field(default_factory=list)
    names: list[str] = field(default_factory=lambda: [""])
    above: list[int] = field(default_factory=lambda: [0])
    below: list[dict[str, int]] = field(default_factory=lambda: [{}])

    def node(self, above: int, name: str) -> int:
        found = self.below[above].get(name)
        if found is None:
            found = self.below[above][name] = len(self.names)
            self.names.append(name)
            self.above.append(above)
            self.below.append({})
        return found

    def path(self, node: int) -> str:
        out = []
        while node:
            out.append(self.names[node])
            node = self.above[node]
        return "".join(">" + x for x in reversed(out))

    @staticmethod
    def of(source: str) -> Page:
        page, stack = Page(), [Element("", 0, False, False)]
        held: list[str] = []
        linked = at = 0
        opened: Counter[str] = Counter()
        final = source.rfind(">")  # there are no tags beyond

        def flush():
            nonlocal linked
            if held:
                text = BLANK.sub(" ", html.unescape("".join(held))).strip()
                if text:
                    page.blocks.append((stack[-1].node, text, min(linked, len(text))))
                held.clear()
                linked = 0

        def say(text: str):
            nonlocal linked
            if text and not stack[-1].skip:
                held.append(text)
                if stack[-1].link:
                    linked += len(text)

        def close(depth: int):
            if any(e.tag in BLOCKS for e in stack[depth:]):
                flush()
            opened.subtract(e.tag for e in stack[depth:])
            del stack[depth:]

        while True:
            start = source.find("<", at)
            while 0 <= start <= final and not (m := TAG.match(source, start)):
                start = source.find("<", start + 1)
            if not 0 <= start <= final:
                m = OPEN_ENDED.search(source, at) if at <= len(source) else None
                if m is None:
                    break
            say(source[at : m.start()])
            at = m.end()
            if m.re is OPEN_ENDED or not (m[2] or m[5]):
                if m[0].startswith("<![CDATA["):
                    say(html.escape(m[0][9:].removesuffix("]]>")))
                continue
            ending, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            name = name.lower()
            if ending:
                if not opened[name]:
                    if name in BLOCKS:
                        flush()
                    continue
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == name:
                        close(depth)
                        break
                    if name not in BLOCKS and stack[depth].tag in BLOCKS:
                        break  # an inline end tag doesn't close a block
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                else:
                    say(" ")
                continue
            if name in RAW:
                if not attributes.rstrip().endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}\s*[^>]*>", re.I).search(source, at)
                    at = end.end() if end else len(source)
                say(" ")
                continue
            block = name in BLOCKS
            if block:
                if name in ("article", "main", "body") and any(opened[x] for x in OPENERS):  # what was left open before the article does not hold it
                    for depth in range(1, len(stack)):
                        if stack[depth].tag in OPENERS:
                            close(depth)
                            break
                for depth in range(len(stack) - 1, 0, -1) if opened["p"] or any(opened[x] for x in ENDS.get(name, ())) else ():
                    tag = stack[depth].tag
                    if tag == "p" or name in ENDED_BY.get(tag, ()):
                        close(depth)
                        break
                    if tag in CONTAINERS and tag not in ENDED_BY:
                        break
                flush()
            top = stack[-1]
            if not block and name != "a" and not attributes:
                continue
            marks = []
            hidden = False
            if attributes:
                for key, value in ATTRIBUTE.findall(attributes):
                    key = key.lower()
                    if key in ("class", "id", "role"):
                        marks.append((key, value.strip("\"'")))
                    elif key == "hidden" or (key == "aria-hidden" and "true" in value) or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                        hidden = True
            words = {w.lower() for _, v in marks for w in WORD.findall(v)}
            marked = words & (COMMENTS if name in ("article", "main") else MARKS)
            wrapper = words & PROSE and words & WRAPPERS  # it holds the article beside what the mark is about
            skip = top.skip or hidden or name in BOILERPLATE or (name not in ("html", "body") and bool(marked) and not wrapper)
            if name == "header" and not opened["article"] and not opened["main"]:
                skip = True
            if not block and name != "a" and not skip:
                continue
            node = top.node
            if name in CONTAINERS and not skip:
                classes = sorted({re.sub(r"\d+", "#", w).replace(">", "_") for k, v in marks if k == "class" for w in v.split()})
                node = page.node(node, f"{name}{''.join('.' + c for c in classes)}")
            opened[name] += 1
            stack.append(Element(name, node, skip, top.link or name == "a"))
        say(source[at:])
        flush()
        return page

    def chosen(self) -> tuple[int, int]:
        """The node with the most prose outside links, the deepest of those that are nearly as good, or what holds it and the rest of its article; and its prose."""
        prose, direct, long, held = ([0] * len(self.names) for _ in range(4))
        for node, text, linked in self.blocks:
            n = len(text) - linked
            held[node] = 1
            prose[node] += n
            direct[node] += n
            if n >= LONG:
                long[node] += n
        depth = [0] * len(self.names)
        for node in range(1, len(self.names)):  # those above come first
            depth[node] = depth[self.above[node]] + 1
        for node in range(len(self.names) - 1, 0, -1):
            prose[self.above[node]] += prose[node]
            held[self.above[node]] |= held[node]
        nodes = [k for k in range(1, len(self.names)) if held[k]]
        if not nodes:
            return 0, 0
        voting = [k for k in nodes if _tag(self.names[k]) not in PARTS or _tag(self.names[k]) == "section"] or nodes
        top = max(prose[k] for k in voting)
        node = max((k for k in voting if prose[k] >= NEARLY * top), key=lambda k: (depth[k], prose[k], -k))
        node = self._whole(node, prose, direct, long)
        return node, prose[node]

    def _whole(self, node: int, prose: list[int], direct: list[int], long: list[int]) -> int:
        """The nearest article, else main, that the node is in; else the outermost container of which what it holds besides is mostly the article's."""
        chain = [node]
        while self.above[chain[-1]]:
            chain.append(self.above[chain[-1]])
        for tag in ("article", "main"):
            for k in chain:
                if _tag(self.names[k]) == tag:
                    return k
        for inner, k in zip(chain, chain[1:], strict=False):
            extra = prose[k] - prose[node]
            if not extra:
                continue
            own = (long if _tag(self.names[k]) in ("html", "body", "td", "center", "form") else direct)[k]
            own += sum(prose[q] for name, q in self.below[k].items() if q != inner and (_tag(name) in PARTS or _words(name) & (PROSE | LEADS)))
            if 2 * own >= extra or (_words(self.names[k]) & HOLDERS and not _words(self.names[k]) & WRAPPERS):
                node = k
        return node

    def best(self) -> tuple[str, int]:
        """The path and the prose of the chosen node."""
        node, prose = self.chosen()
        return self.path(node), prose

    def ordered(self) -> tuple[list[int], list[int], list[int]]:
        """(place of each node, last place within the node at each place, number of the path at each place), places in tree order."""
        place, last, number = [0] * len(self.names), [0] * len(self.names), [0] * len(self.names)
        count, stack = 0, [(0, 0)]
        while stack:
            node, path = stack.pop()
            if node < 0:
                last[place[~node]] = count - 1
                continue
            place[node], number[count] = count, path
            count += 1
            stack.append((~node, 0))
            stack += [(k, _below(path, name)) for name, k in self.below[node].items()]
        return place, last, number

    def text(self, path: str) -> str:
        """The blocks within containers on the path, one line each; within the page's own best where there is none."""
        node = 0
        for name in path.split(">")[1:]:
            node = self.below[node].get(name, 0)
            if not node:
                break
        place, last, _ = self.ordered()
        within = lambda k: [t for n, t, _ in self.blocks if place[k] <= place[n] <= last[place[k]]]
        return "\n".join((within(node) if node else []) or within(self.chosen()[0]))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, url, host, html -> page_id, url, host, and the page as of main_texts."""

    def lists(rows: list[list], kind: pa.DataType) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, rows))], pa.int32()), pa.array([x for r in rows for x in r], kind))

    for whole in batches:
        for b in blocks(whole, 3, 4 << 20):
            paths, prose, own, last, number, where, said = [], [], [], [], [], [], []
            for source in b.column(3).to_pylist():
                page = Page.of(source)
                node, n = page.chosen()
                place, ends, numbers = page.ordered()
                paths.append(page.path(node))
                prose.append(n)
                own.append(place[node])
                last.append(ends)
                number.append(numbers)
                where.append([place[k] for k, _, _ in page.blocks])
                said.append([t for _, t, _ in page.blocks])
            borders = pa.array([0, *accumulate(map(len, where))], pa.int32())
            flat = pa.StructArray.from_arrays([pa.array([x for r in where for x in r], pa.int32()), pa.array([x for r in said for x in r], pa.string())], ["place", "text"])
            columns = [pa.array(paths, pa.string()), pa.array([n[k] for n, k in zip(number, own, strict=True)], pa.int64()), pa.array(prose, pa.int64()), pa.array(own, pa.int32())]
            columns += [lists(number, pa.int64()), lists(last, pa.int32()), pa.ListArray.from_arrays(borders, flat)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *columns], ["page_id", "url", "host", "path", "number", "prose", "own", "numbers", "lasts", "blocks"])


def host_paths(parsed: DataFrame) -> DataFrame:
    """Pages' own host, path, number, prose -> host, path, winner: the number of the path with most votes; ties go to the one with more prose, then to the first by name."""
    counted = parsed.filter("path <> ''").groupBy("host", "path", "number").agg(F.count("*").alias("votes"), F.sum("prose").alias("prose"))
    order = F.struct(-F.col("votes"), -F.col("prose"), F.col("path"), F.col("number"))
    return counted.groupBy("host").agg(F.min(order).alias("first")).select("host", "first.path", F.col("first.number").alias("winner"))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", hosts: int = HOSTS) -> DataFrame:
    """page_id, url, text, n_chars (code points): one row per input row.

    Null html counts as empty and has the empty text. Null or malformed urls share one nameless host. Repeated rows vote and return
    as often as they occur. Time and memory grow with the length of a page, however deep its elements are nested. Other columns are not read.

    What is kept of a page: the number of each container path, in tree order, and the last place within it; the blocks of prose with
    their places. Where winning paths are too many to travel, these rows, not the pages, are joined with them by host.
    """
    kinds = dict(pages.dtypes)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)).alias("host")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host, F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    schema = f"page_id {kinds[id_col]}, url {kinds[url_col]}, host string, path string, number long, prose long, own int, numbers array<long>, lasts array<int>, blocks array<struct<place: int, text: string>>"
    parsed = written(rows.mapInArrow(_parsed, schema))
    paths = written(host_paths(parsed)).select("host", "winner")
    count, size = paths.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("host") + 8), F.lit(0))).first()
    small = count <= hosts and size <= HOST_BYTES
    joined = parsed.join(F.broadcast(paths) if small else paths, "host", "left")
    at = F.coalesce(F.array_position("numbers", F.col("winner")).cast("int"), F.lit(0))
    first = F.when(at > 0, at - 1).otherwise(F.col("own"))
    within = joined.select("page_id", "url", "blocks", first.alias("first"), F.get("lasts", first).alias("last"))
    found = F.filter("blocks", lambda b: (b["place"] >= F.col("first")) & (b["place"] <= F.col("last")))
    text = F.array_join(F.transform(found, lambda b: b["text"]), "\n").alias("text")
    return within.select("page_id", "url", text).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
