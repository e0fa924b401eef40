"""Main text of pages by consensus of container paths per host.

Each page is parsed into elements and blocks of text. A block credits its container, and half as
much the container above; links credit nothing, and elements that by tag, class, id or role hold
menus, notices, adverts, forms, comments and the like are left out. A page votes for the
generalised tag-class path of its best container, or of the nearest article or main around that, as
a title and a lead stand beside the body there, with that container's share of the page. Votes
are summed by host in Spark, and pages are extracted again from the containers with the host's
winning path (the next winning one if a page lacks the first, and its own best container if it
lacks all).

Winning paths, at most PATHS a host, are broadcast only if their table is under BROADCAST_BYTES;
otherwise pages and paths are joined by host, where Spark splits hosts that hold many pages.

Defined results: null or empty html, and pages without main text, give the empty string; a null
url or one without a host is extracted by its own best container; text without any tag is one
container; rows that repeat are extracted alike; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Cut, table
from .url_filter import host_of

PATHS, BROADCAST_BYTES = 3, 32 << 20
_MARK = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"[^\s/>]+")
_QUOTE_OR_END = re.compile(r"""["'>]""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAMED = re.compile(r"class|id\b|role|hidden|style|aria-hidden", re.I)
_RAW = frozenset("script style title textarea noscript iframe template xmp noembed noframes svg math canvas object select button audio video".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks that credit the element above them; other blocks credit themselves.
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote dd dt dl ul ol td th tr tbody thead table figcaption figure caption center address summary".split())
#: An opening tag ends these, up to the elements that hold them.
_ENDS = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table tbody thead tfoot"), "td": ("td th", "tr table"), "th": ("td th", "tr table")}
_ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _ENDS.items()}
_DULL_TAGS = frozenset("nav aside form footer head dialog menu fieldset".split())
_DULL_WORDS = frozenset("ad ads nav toc meta tags byline tools skip pager legal copyright login search".split())
_DULL_STARTS = ("comment", "advert", "sponsor", "disqus", "respond", "sidebar", "footer", "navbar", "navigation", "breadcrumb", "menu", "masthead", "cookie", "consent", "gdpr", "popup", "modal", "newsletter", "subscri", "signup", "social", "share", "sharing", "promo", "widget", "related", "recommend", "pagination", "toolbar", "banner", "notice", "alert", "header", "topbar")
_ALWAYS = ("comment", "advert", "sponsor", "disqus", "cookie", "consent", "newsletter")
_MAIN_WORDS = frozenset("content main article post entry story body page wrapper wrap container layout site text".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())


def _words(value: str) -> list[str]:
    return [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()) if w]


def _is_dull(tag: str, attributes: dict[str, str], inside_article: bool) -> bool:
    if tag in _DULL_TAGS or (tag == "header" and not inside_article):
        return True
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    if attributes.get("role", "").lower() in _ROLES:
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    for name in (attributes.get("id", ""), *attributes.get("class", "").split()):
        words = _words(name)
        main = any(w in _MAIN_WORDS for w in words)
        for w in words:
            if w in ("ad", "ads") or w.startswith(_ALWAYS) or not main and (w in _DULL_WORDS or w.startswith(_DULL_STARTS)):
                return True
    return False


def _tag_end(html: str, at: int, dead: set[int]) -> int:
    """Where a tag's > is that stands in no quotes; the first > at all if there is none, as after an unclosed quote.

    ``dead``: quotes from which none is found; they end later searches of the same page at once.
    """
    seen, position = [], at
    while (mark := _QUOTE_OR_END.search(html, position)) is not None:
        i = mark.start()
        if html[i] == ">":
            return i
        if i in dead:
            break
        seen.append(i)
        position = html.find(html[i], i + 1) + 1
        if not position:
            break
    dead.update(seen)
    return html.find(">", at)


class _Paths:
    """The paths of a page's elements, made when they are asked for: a path is a number, its parent's and its last step."""

    def __init__(self):
        self.steps, self.above, self.known, self.of = [""], [-1], {}, [0]

    def add(self, parent: int, step: str | None) -> None:
        """The next element, with one step more than ``parent`` or none."""
        at = self.of[parent]
        if step is not None:
            key = at, step.replace("%", "%25").replace("/", "%2F")
            at = self.known.get(key, -1)
            if at < 0:
                at = self.known[key] = len(self.steps)
                self.steps.append(key[1])
                self.above.append(key[0])
        self.of.append(at)

    def __getitem__(self, e: int) -> str:
        steps, at = [], self.of[e]
        while at > 0:
            steps.append(self.steps[at])
            at = self.above[at]
        return "".join("/" + s for s in reversed(steps))

    def number(self, path: str) -> int:
        """The number of a path; -1 if the page lacks it."""
        at = 0
        for step in path.split("/")[1:]:
            at = self.known.get((at, step), -1)
            if at < 0:
                break
        return at


class Page:
    """Elements (parent, path, whether left out) and blocks (element, text, characters in links).

    The time is in proportion to the length of the html, whatever it holds: open elements are found
    by tag, and what one search has found to be missing is not searched for again.
    """

    def __init__(self, html: str):
        self.parents, self.tags, self.dull, self.containers, self.paths = [-1], [""], [False], [0], _Paths()
        self.blocks: list[tuple[int, str, int]] = []
        self._text, self._linked = [], 0
        # open elements; the positions on that stack of elements that hold text, of blocks, and of each tag
        self._stack, self._holders, self._open_blocks = [0], [0], [0]
        self._open: dict[str, list[int]] = {}
        at, n, unended, dead = 0, len(html), set(), set()
        last = html.rfind(">")
        while at < n:
            mark = _MARK.search(html, at)
            if mark is None:
                self._add(html[at:])
                break
            start, kind = mark.start(), mark[0]
            if kind == "<!--":
                end = html.find("-->", start + 4)
                self._add(html[at:start])
                at = n if end < 0 else end + 3
                continue
            if kind == "<![CDATA[":
                end = html.find("]]>", start + 9)
                self._add(html[at:start])
                self._add(html[start + 9 : n if end < 0 else end].replace("&", "&amp;"))
                at = n if end < 0 else end + 3
                continue
            if start > last:  # no tag ends any more
                after = html.find("<!--", start), html.find("<![CDATA[", start)
                stop = min((a for a in after if a >= 0), default=n)
                self._add(html[at:stop])
                at = stop
                continue
            self._add(html[at:start])
            if kind in ("<!", "<?"):
                at = html.find(">", start) + 1
                continue
            name = _NAME.match(html, start + len(kind) - 1)
            end = _tag_end(html, name.end(), dead)
            tag, attributes, at = name[0].lower(), html[name.end() : end], end + 1
            if kind[1] == "/":
                self._end(tag)
            elif tag in _RAW and not attributes.endswith("/"):
                found = None if tag in unended else re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                if found:
                    at = found.end()
                else:
                    unended.add(tag)
                    if tag in ("script", "style", "title", "textarea"):
                        at = n
            elif tag in _VOID:
                self._flush() if tag == "hr" else self._text.append(" ")
            else:
                self._begin(tag, attributes)
                if attributes.endswith("/") and tag not in _BLOCK:
                    self._end(tag)
        self._flush()

    def _add(self, raw: str) -> None:
        if not raw:
            return
        text = unescape(raw) if "&" in raw else raw
        self._text.append(text)
        if self._open.get("a"):
            self._linked += len(text.strip())

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            self.blocks.append((self._stack[self._holders[-1]], text, self._linked))
        self._text, self._linked = [], 0

    def _pop(self, to: int) -> None:
        """Close the elements of the stack from position ``to`` on."""
        if self._open_blocks[-1] >= to:
            self._flush()
        for positions in (self._holders, self._open_blocks):
            while positions[-1] >= to:
                positions.pop()
        while len(self._stack) > to:
            self._open[self.tags[self._stack.pop()]].pop()

    def _nearest(self, tags: Iterable[str]) -> int:
        """The position of the innermost open element with one of the tags; 0 without one."""
        return max((p[-1] for p in map(self._open.get, tags) if p), default=0)

    def _begin(self, tag: str, raw: str) -> None:
        if tag in _BLOCK:
            self._flush()
            nearest = self._open_blocks[-1]
            if self.tags[self._stack[nearest]] == "p":
                self._pop(nearest)
        if tag in _ENDS:
            ends, holds = _ENDS[tag]
            nearest = self._nearest(ends)
            if nearest > self._nearest(holds):
                self._pop(nearest)
        elif tag in ("html", "body") and tag in self._open:
            return
        attributes = {a.lower(): b or c or d for a, b, c, d in _ATTRIBUTE.findall(raw)} if _NAMED.search(raw) else {}
        if tag == "body":  # an open head ends
            self._end("head")
        parent, block, e = self._stack[-1], tag in _BLOCK, len(self.tags)
        self.parents.append(parent)
        self.tags.append(tag)
        step = None
        if block and tag not in ("html", "body"):  # whose classes differ by page, and which pages leave out
            classes = ".".join(sorted(set(re.sub(r"\d+", "#", attributes.get("class", "")).split())))
            step = f"{tag}.{classes}" if classes else tag
        self.paths.add(parent, step)
        self.containers.append(e if block and tag not in _LEAF else self.containers[parent])
        self.dull.append(self.dull[parent] or _is_dull(tag, attributes, bool(self._open.get("article") or self._open.get("main"))))
        changes = self.dull[e] != self.dull[parent]
        if changes and not block:  # what is left out inside a line must not join it
            self._flush()
        at = len(self._stack)
        self._stack.append(e)
        self._open.setdefault(tag, []).append(at)
        if block:
            self._open_blocks.append(at)
        if block or changes:
            self._holders.append(at)

    def _end(self, tag: str) -> None:
        at = self._nearest((tag,))
        if not at or tag not in _BLOCK and self._open_blocks[-1] > at:
            return
        if tag not in _BLOCK and self._holders[-1] == at:
            self._flush()
        self._pop(at)

    def credits(self) -> Counter[int]:
        """Each container's credit."""
        found: Counter[int] = Counter()
        for e, text, linked in self.blocks:
            if self.dull[e]:
                continue
            worth, e = max(0, len(text) - linked), self.containers[e]
            found[e] += worth
            if self.parents[e] > 0:
                found[self.parents[e]] += worth / 2
        return found

    def best(self) -> tuple[int, float]:
        """The container with most credit (ties: the first), or the article or main around it, and its share."""
        found = self.credits()
        if not found:
            return 0, 0.0
        e = min(found, key=lambda e: (-found[e], e))
        return self._whole(e), found[e] / (sum(len(t) for _, t, _ in self.blocks) or 1)

    def _whole(self, e: int) -> int:
        """The nearest article or main that a container is or lies in, else the container."""
        at = e
        while at > 0 and self.tags[at] not in ("article", "main"):
            at = self.parents[at]
        return at if at > 0 else e

    def text(self, paths: list[str]) -> str:
        own = self._under({self.best()[0]})
        for path in paths:
            number = self.paths.number(path)
            if number >= 0 and (chosen := self._under({e for e, p in enumerate(self.paths.of) if p == number and self.tags[e] in _BLOCK})):
                return chosen
        return own

    def _under(self, roots: set[int]) -> str:
        inside = [False] * len(self.tags)
        for e in range(len(self.tags)):
            inside[e] = e in roots or (e > 0 and inside[self.parents[e]])
        return "\n\n".join(t for e, t, _ in self.blocks if inside[e] and not self.dull[e])


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes), added up by partition before they are shuffled."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[tuple[str, str]] = Counter()
        for frame in frames:
            for host, html in zip(frame["host"], frame["html"]):
                page = Page(html or "")
                e, share = page.best()
                if share:
                    seen[host, page.paths[e]] += share
            if len(seen) > 100_000:
                yield out(seen)
                seen = Counter()
        yield out(seen)

    def out(seen) -> pd.DataFrame:
        return pd.DataFrame({"host": pd.Series([h for h, _ in seen], dtype=object), "path": pd.Series([p for _, p in seen], dtype=object), "votes": pd.Series(list(seen.values()), dtype="float64")})

    hosted = pages.select(host_of(pages["url"]).alias("host"), pages["html"].alias("html")).where("host <> ''")
    found = hosted.mapInPandas(counted, "host string, path string, votes double")
    return found.groupBy("host", "path").agg(F.round(F.sum("votes"), 6).alias("votes"))


def winners(pages: DataFrame) -> DataFrame:
    """(host, paths): the most voted paths of each host, the first first."""
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))
    best = votes(pages).withColumn("rank", rank).where(F.col("rank") <= PATHS)
    return best.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda s: s["path"]).alias("paths"))


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    found = Cut(winners(pages).select(F.col("host").alias("__host"), F.col("paths").alias("__paths")), "paths").df
    size = found.agg(F.coalesce(F.sum(F.length("__host") + F.length(F.array_join("__paths", " ")) + 100), F.lit(0))).first()[0]
    joined = pages.select("page_id", "url", "html").join(F.broadcast(found) if size <= BROADCAST_BYTES else found, host_of(F.col("url")) == F.col("__host"), "left")

    @F.pandas_udf("string")
    def main_text(html: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([Page(h or "").text([] if p is None else list(p)) for h, p in zip(html, paths)], dtype=object)

    return joined.select("page_id", "url", main_text("html", "__paths").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op3_html(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
