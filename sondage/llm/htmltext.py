"""Main text of web pages by consensus paths of their hosts.

Every page's containers are scored by the text they hold and that isn't links.  Spark sums the scores of each host's
generalised paths (the last tags with their classes, digits left out); the path with the most votes is where that host
keeps its content, and each of its pages is then read again at that path.
"""

from __future__ import annotations

import hashlib
import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import cut, small, table
from .wordgrams import slices

#: A generalised path is the last so many containers, each by its tag and all its classes without digits.
PATH_STEPS = 6
#: Classes of more characters together are told by their hash.
STEP_CHARS = 160
#: A page's votes add up to this, or a little less, as each path's are rounded down.
VOTES = 10**9

CONTAINERS = frozenset("html body main article section div td th li ul ol dl dd table tr tbody nav header footer aside form blockquote figure center".split())
BREAKS = CONTAINERS | frozenset("p br h1 h2 h3 h4 h5 h6 pre hr dt caption option title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg iframe textarea select head".split())
RAW = frozenset("script style textarea title noscript iframe".split())
#: Tags that an opening tag of the same kind closes.
CLOSED_BY_SELF = frozenset("p li tr td th dt dd option".split())
_BOILERPLATE = re.compile(r"(?:^|[.>_-])(?:nav|menu|footer|header|aside|sidebar|form|ads?|advert|banner|promo|cookie|comments?|share|social|related)(?:[.>_-]|$)")
_ATTRIBUTE = re.compile(r"""class\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")


@dataclass(eq=False)
class Node:
    """An open tag; ``up`` is the nearest container around it, ``home`` that or, of a container, itself."""

    step: str
    up: "Node | None"
    container: bool
    hidden: bool
    link: bool
    score: int = 0
    parts: list = field(default_factory=list)

    def __post_init__(self) -> None:
        self.home = self if self.container else self.up
        self.boilerplate = self.container and _BOILERPLATE.search(self.step) is not None

    def path(self) -> str:
        steps, node = [], self
        while node is not None and len(steps) < PATH_STEPS:
            steps.append(node.step)
            node = node.up
        return ">".join(reversed(steps))


def _step(tag: str, rest: str) -> str:
    found = _ATTRIBUTE.search(rest)
    if not found:
        return tag
    names = sorted({x for x in (re.sub(r"[\d]+", "", w).strip("-_") for w in found[1].strip("\"'").lower().split()) if x})
    step = ".".join([tag, *names])
    # Paths hold the steps around them, so that a long one must not be spelled out in each.
    return step if len(step) <= STEP_CHARS else f"{tag}.{names[0][:16]}~{hashlib.blake2b(step.encode(), digest_size=8).hexdigest()}"


def parse(page: str) -> list[Node]:
    """Containers of a page in order of their opening tags, the first being the whole page.

    ``parts`` holds text, ``None`` for a line break and, in place, the containers inside.  Tags may stay open; a closing tag
    without its opening tag is ignored; an unclosed comment, tag or script runs to the end.  Takes linear time.
    """
    root = Node("page", None, True, False, False)
    nodes, stack, names = [root], [("", root)], {}
    at, n = 0, len(page)

    def text(raw: str) -> None:
        node = stack[-1][1]
        if node.hidden or not raw:
            return
        raw = html.unescape(raw)
        node.home.parts.append(raw)
        size = len(raw.strip())
        if not size:
            return
        if node.link:
            size = -size
        share = node.home
        for part in (1, 2, 4):
            share.score += size // part
            # What boilerplate holds says nothing for what is around it.
            if share.up is None or share.boilerplate:
                break
            share = share.up

    def close(tag: str) -> None:
        if not names.get(tag):
            return
        while True:
            name, node = stack.pop()
            names[name] -= 1
            if name == tag:
                break
        if tag in BREAKS:
            stack[-1][1].home.parts.append(None)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        if lt > at:
            text(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        following = page[lt + 1 : lt + 2]
        if following in "!?":
            end = page.find(">", lt)
            at = n if end < 0 or not following else end + 1
            continue
        closing = following == "/"
        name = _NAME.match(page, lt + 1 + closing)
        if not name:
            text("<")
            at = lt + 1
            continue
        end = page.find(">", name.end())
        if end < 0:
            break
        tag, rest, at = name[0].lower(), page[name.end() : end], end + 1
        if closing:
            close(tag)
            continue
        if tag in CLOSED_BY_SELF and names.get(tag) and stack[-1][0] == tag:
            close(tag)
        top = stack[-1][1]
        if tag in BREAKS and not top.hidden:
            top.home.parts.append(None)
        if tag in VOID or rest.endswith("/") and tag not in CONTAINERS:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}", re.IGNORECASE).search(page, at)
            if stop is None:
                break
            gt = page.find(">", stop.end())
            at = n if gt < 0 else gt + 1
            continue
        inner = Node(_step(tag, rest) if tag in CONTAINERS else tag, top.home, tag in CONTAINERS, top.hidden or tag in HIDDEN, top.link or tag == "a")
        if inner.container and not inner.hidden:
            top.home.parts.append(inner)
            nodes.append(inner)
        stack.append((tag, inner))
        names[tag] = names.get(tag, 0) + 1
    return nodes


def votes(page: str | list[Node]) -> dict[str, int]:
    """Votes of a page's generalised paths, in proportion to the positive scores of their containers."""
    score: dict[str, int] = {}
    for node in parse(page) if isinstance(page, str) else page:
        if node.score > 0:
            path = node.path()
            score[path] = score.get(path, 0) + (node.score // 5 if node.boilerplate else node.score)
    whole = sum(score.values())
    return {p: VOTES * s // whole for p, s in score.items() if s}


def _text(nodes: list[Node]) -> str:
    lines, line = [], []
    todo = list(reversed(nodes))
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            line.append(part)
        else:
            lines.append("".join(line))
            line = []
            if part is not None:
                todo.append(None)
                todo.extend(reversed(part.parts))
    lines.append("".join(line))
    return "\n".join(x for x in (" ".join(s.split()) for s in lines) if x)


def extract(page: str, path: str | None) -> tuple[str, str]:
    """Text of the outermost containers at ``path``, and the path used: the page's own best where it has none there."""
    nodes = parse(page)
    there = [x for x in nodes if path is not None and x.path() == path]
    if not there:
        own = votes(nodes)
        path = min(own, key=lambda p: (-own[p], p)) if own else "page"
        there = [x for x in nodes if x.path() == path] or nodes[:1]
    # Containers come after those around them, so that one look upwards tells whether one is inside another that is there.
    at, inside, chosen = set(there), set(), []
    for node in nodes:
        if node.up in inside or node.up in at:
            inside.add(node)
        elif node in at:
            chosen.append(node)
    return _text(chosen), path


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), "html")


def host_paths(pages: DataFrame) -> DataFrame:
    """Columns ``host, path, votes``: the path with the most votes of each host; ties go to the path that sorts first."""

    def emit(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                found = [(h, p, v) for h, x in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True) if x for p, v in votes(x).items()]
                host, path, n = zip(*found, strict=True) if found else ([],) * 3
                yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(n, pa.int64())], names=["host", "path", "n"])

    counted = with_host(pages).select("host", "html").mapInArrow(emit, "host string, path string, n bigint").groupBy("host", "path").agg(F.sum("n").alias("votes"))
    best = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    return counted.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


def main_texts(pages: DataFrame) -> DataFrame:
    """Columns ``page_id, host, path, text`` for every row of ``pages`` (``page_id, url, html``); other columns are ignored.

    Pages without the host's path fall back on their own best container.  A null ``html`` gives null ``path`` and ``text``; an
    empty one an empty text.  A url that is null or has no host belongs to host "".  Repeated rows each vote and each get a row.
    Ties between paths go to the one that sorts first.  Very long pages are read whole, in time linear in their length.
    """
    winners = cut(host_paths(pages).select("host", "path"))

    def emit(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                done = [(None, None) if x is None else extract(x, p) for x, p in zip(part.column("html").to_pylist(), part.column("path").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("host"), pa.array([p for _, p in done], pa.string()), pa.array([t for t, _ in done], pa.string())],
                    names=["page_id", "host", "path", "text"],
                )

    return with_host(pages).join(small(winners), "host", "left").select("page_id", "host", "html", "path").mapInArrow(emit, "page_id bigint, host string, path string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
