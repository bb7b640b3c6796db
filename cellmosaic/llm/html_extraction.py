"""Main text of web pages by consensus host paths.

1. Every page scores its own containers: block elements gain the length of the running text
   directly in their paragraphs, headings and lists, and lose what sits in links.  From the best
   one the page climbs to the next container out that adds notably more running text than links.
2. The generalised tag-class path of the best container (numbers replaced, positions left
   out) is the page's vote; votes are counted per host in Spark, and a host is represented
   by its winning path.  Hosts with few pages fall back to the paths of all hosts together.
3. Every page is extracted again from the elements on its host's winning path; a page that
   has none uses its own best container, and else its body.

Vote tables have a row per (host, path), are aggregated before the shuffle and stay tables;
only the few winning paths per host travel back to the pages.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, slices

#: Up to so many hosts (of 253 characters, with paths of some 2,000) the winning paths go to every executor, beyond it the join shuffles.
BROADCAST_HOSTS = 10_000
#: From this length on a path goes on from its digest.
LONG_PATH = 2_000
#: A container out is taken for the best one if it has so many times the running text, outside links.
NOTABLY = 1.1
#: A host's own consensus counts from this many voting pages on.
MIN_VOTES = 3

# Fixed values of HTML: elements without an end tag, elements whose content is not markup,
# elements that never hold main text, and elements that start a new block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object select canvas".split())
BOILERPLATE = frozenset("nav header footer aside form button dialog menu head".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
# Elements that stand in a head; any other one, and text, ends it.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
CONTAINERS = frozenset("article main section div body td blockquote".split())
# Words in class and id names that mark menus, notices, adverts and reader comments.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|byline|comments?|cookies?|consent|disqus|footer|header|masthead|menu|modal|"
    r"nav|navbar|navigation|newsletter|notice|pagination|pager|popup|promo\w*|related|replies|reply|respond|share|sharing|"
    r"sidebar|social|sponsor\w*|subscribe|tags|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
# A paragraph or heading stands in the text: only a whole class name marks it, and these are common names of titles.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6".split())
TITLES = frozenset("header banner masthead".split())
# What an open element of the key ends when the next tag is one of the values (optional end tags).
ENDS = {
    "p": BLOCKS - {"br", "option", "td", "th", "tr", "body", "html"} | {"td", "th", "tr"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
    "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"},
}
_TOKEN = re.compile(
    # A quote opens a value only after an equals sign; anywhere else it is a character of the tag, as in browsers.
    r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>", re.S
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_END_RAW = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
_DIGITS = re.compile(r"\d+")


class Page:
    """Text pieces of a page in order, each with the open element it stands in."""

    __slots__ = ("pieces", "tag", "path", "parent", "skip", "near", "sign", "html", "body")

    def __init__(self, source: str):
        self.tag, self.path, self.parent, self.skip = ["#"], [""], [-1], [False]
        # The innermost container around an element, itself included, and -1 where an odd number of links lies between.
        self.near, self.sign = [0], [1]
        self.pieces: list[tuple[int, str, bool]] = []
        self.html = self.body = 0
        self._read(source)

    def _open(self, parent: int, tag: str, attributes: str) -> int:
        name = mark = ""
        hidden = False
        if attributes and attributes != "/":
            found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
            name = html.unescape(found.get("class", ""))
            mark = f"{name} {found.get('id', '')} {found.get('role', '')}"
            hidden = "hidden" in found or found.get("aria-hidden") == "true"
        step = tag
        if name:
            step += "".join(f".{c}" for c in sorted(set(_DIGITS.sub("#", name.lower()).split())))
        self.tag.append(tag)
        above = self.path[parent]
        if len(above) > LONG_PATH:
            # Its digest stands for a long path, so deep elements keep paths of their own.
            above = "#" + hashlib.sha256(above.encode("utf-8", "surrogatepass")).hexdigest()
        self.path.append(f"{above}/{step}")
        self.parent.append(parent)
        inside = tag in CONTAINERS
        self.near.append(len(self.tag) - 1 if inside else self.near[parent])
        self.sign.append(1 if inside else -self.sign[parent] if tag == "a" else self.sign[parent])
        skip = self.skip[parent] or tag in BOILERPLATE or hidden
        if not skip and mark and tag not in ("html", "body", "article", "main"):
            if tag in PROSE:
                skip = any(c not in TITLES and MARKED.fullmatch(c) for c in name.lower().split())
            else:
                skip = bool(MARKED.search(mark))
        self.skip.append(skip)
        return len(self.tag) - 1

    def _read(self, source: str) -> None:
        at, stack, fresh = 0, [0], True
        while at < len(source):
            token = _TOKEN.search(source, at)
            end = token.start() if token else len(source)
            if end > at:
                if source[at:end].strip("\ufeff \t\n\r\f"):
                    self._begin_body(stack)
                self.pieces.append((stack[-1], html.unescape(source[at:end]), fresh))
                fresh = False
            if not token:
                break
            at = token.end()
            closing, tag = token.group(1), (token.group(2) or "").lower()
            if not tag:
                continue
            fresh = fresh or tag in BLOCKS
            if closing:
                self._close(stack, tag)
                continue
            while len(stack) > 1 and tag in ENDS.get(self.tag[stack[-1]], ()):
                stack.pop()
            if tag in ("html", "head", "body", "frameset"):
                self._frame(stack, tag, token.group(3))
                continue
            if tag not in HEAD:
                self._begin_body(stack)
            if tag in BLOCKS and tag != "br":
                self._end_paragraph(stack)
            if tag in RAW:
                stop = _END_RAW[tag].search(source, at)
                at = stop.end() if stop else len(source)
            elif tag not in VOID:
                # The element of a self-closed tag is opened too, as browsers do.
                stack.append(self._open(stack[-1], tag, token.group(3)))

    def _frame(self, stack: list[int], tag: str, attributes: str) -> None:
        """Open html, head or body; each but the head is there once, as in browsers, and nothing but it goes into a head."""
        if tag == "html":
            if not self.html:
                self.html = self._open(stack[-1], tag, attributes)
                stack.append(self.html)
        elif not self.body:
            if self.tag[stack[-1]] == "head":
                stack.pop()
            if not self.html:
                self._frame(stack, "html", "")
            node = self._open(self.html, tag, attributes)
            stack.append(node)
            if tag != "head":
                self.body = node

    def _begin_body(self, stack: list[int]) -> None:
        """What cannot stand in a head ends an open one and stands in the body, whose tags are optional."""
        if self.tag[stack[-1]] in ("#", "html", "head"):
            self._frame(stack, "body", "")
            if stack[-1] != self.body:
                stack.append(self.body)

    def _end_paragraph(self, stack: list[int]) -> None:
        """A block ends an open paragraph, also through inline elements left open in it."""
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag == "p":
                del stack[k:]
                return
            if tag in BLOCKS:
                return

    def _close(self, stack: list[int], tag: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] == tag:
                del stack[k:]
                return
            if self.tag[stack[k]] in CONTAINERS and tag not in BLOCKS:
                return

    def scores(self) -> dict[int, float]:
        """Score of every container: its running text, less its links; half of it reaches the next one out."""
        out: dict[int, float] = {}
        for node, text, _ in self.pieces:
            if self.skip[node]:
                continue
            weight, up, share = self.sign[node] * len(text.strip()), self.near[node], 1.0
            while weight and up > 0 and share > 0.1:
                bonus = 2.5 if self.tag[up] in ("article", "main") else 1.0
                out[up] = out.get(up, 0.0) + share * bonus * weight
                share, up = share / 2, self.near[self.parent[up]]
        return out

    def _amounts(self) -> dict[int, list[int]]:
        """Characters of all unskipped text under every container, outside links and in them."""
        sums = [[0, 0] for _ in self.tag]
        for node, text, _ in self.pieces:
            if not self.skip[node]:
                sums[node][0] += len(text.strip())
        # An element comes after the one around it, so one pass from the last carries every sum up.
        for node in range(len(sums) - 1, 0, -1):
            plain, linked = sums[node]
            if self.tag[node] == "a":
                plain, linked = 0, plain + linked
            around = sums[self.parent[node]]
            around[0] += plain
            around[1] += linked
        return {n: sums[n] for n in range(1, len(sums)) if self.tag[n] in CONTAINERS and any(sums[n])}

    def best(self) -> int:
        """The container with the best score, or the ones around it that hold more of the text; an article or main is whole."""
        found = self.scores()
        if not found:
            return 0
        best = max(found, key=lambda n: (found[n], -n))
        amounts, up = self._amounts(), best
        while up > 0 and self.tag[best] not in ("article", "main"):
            up = self.parent[up]
            if up in amounts:
                plain, linked = (a - b for a, b in zip(amounts[up], amounts[best]))
                if plain > linked and amounts[up][0] >= NOTABLY * amounts[best][0]:
                    best = up
        return best

    def text(self, roots: frozenset[int]) -> str:
        """Text under ``roots``: white space inside a block made one space, blocks joined by one space."""
        inside = {0: 0 in roots}
        blocks, current = [], []
        for node, text, fresh in self.pieces:
            chain, up = [], node
            while up not in inside:
                chain.append(up)
                up = self.parent[up]
            for n in reversed(chain):
                inside[n] = n in roots or inside[self.parent[n]]
            if fresh and current:
                blocks.append("".join(current))
                current = []
            if inside[node] and not self.skip[node]:
                current.append(text)
        blocks.append("".join(current))
        return " ".join(filter(None, (" ".join(b.split()) for b in blocks)))


def vote(source: str | None) -> str | None:
    """Generalised path of the page's best container; None without text."""
    page = Page(source or "")
    node = page.best()
    return page.path[node] if node else None


def extract(source: str | None, paths: list[str]) -> str:
    """Text under the elements on the first of ``paths`` that the page has, else under its best container."""
    page = Page(source or "")
    for path in paths:
        roots = frozenset(n for n, p in enumerate(page.path) if p == path and n and not page.skip[n])
        if roots:
            return page.text(roots)
    return page.text(frozenset([page.best()]))


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without port and user; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def votes(pages: DataFrame) -> DataFrame:
    """``host, path, n``: how many pages of the host voted for the path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                paths = [vote(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(paths, pa.string())], ["host", "path"])

    rows = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string"))
    cast = rows.mapInArrow(run, "host string, path string").where("path is not null")
    return cast.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))


def consensus(counted: DataFrame, min_votes: int = MIN_VOTES) -> DataFrame:
    """``host, path``: the path with the most votes, ties to the shorter and then first in order.

    Hosts with fewer than ``min_votes`` voting pages are absent.  The host '*' has the winner of all hosts together.
    """
    best = F.min_by("path", F.struct(-F.col("n"), F.length("path"), F.col("path")))
    per_host = counted.groupBy("host").agg(best.alias("path"), F.sum("n").alias("total")).where(F.col("total") >= min_votes)
    overall = counted.groupBy("path").agg(F.sum("n").alias("n")).groupBy().agg(best.alias("path")).where("path is not null")
    return per_host.select("host", "path").unionByName(overall.select(F.lit("*").alias("host"), "path"))


def main_text(pages: DataFrame, min_votes: int = MIN_VOTES) -> DataFrame:
    """``page_id, url, text, n_chars, path`` of every page.

    NULL or empty html has the empty text; repeated rows repeat; pages without a URL share
    the host ''.  ``path`` is the consensus path that was tried first.
    """
    winners = cut(consensus(votes(pages), min_votes))
    general = [r.path for r in winners.where("host = '*'").collect()]
    own = winners.where("host <> '*'")
    if own.count() <= BROADCAST_HOSTS:
        own = F.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = [
                    extract(source, ([path] if path else []) + general)
                    for source, path in zip(part.column(2).to_pylist(), part.column(3).to_pylist())
                ]
                lengths = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), lengths, part.column(3)],
                    ["page_id", "url", "text", "n_chars", "path"],
                )

    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host_of(F.col("url")).alias("host")
    )
    routed = rows.join(own, "host", "left").select("page_id", "url", "html", "path")
    return routed.mapInArrow(run, "page_id long, url string, text string, n_chars long, path string")
