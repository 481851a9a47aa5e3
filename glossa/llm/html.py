"""Main-text extraction by consensus host paths.

Each page's containers are scored by the text of their blocks; the pages of a host vote on generalised
tag-class paths; pages are then extracted again from the containers on the winning paths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table, slices
from .urls import split_url

#: A page votes for containers with at least this part of the points of its best one, against its others.
VOTE_PART = 1 / 8
#: Pages that must vote for a path; what fewer pages agree on is no consensus.
LEAST_VOTES = 2
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"[ \t\n\r\f\v \u0085    -   　]+")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select"
    " summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS = frozenset(("td", "th"))
#: Blocks that text is scored for, not containers themselves.
LEAVES = HEADINGS | frozenset("p li dd dt pre blockquote figcaption caption td th tr tbody thead tfoot table ul ol dl summary hgroup".split())
DROP = frozenset(
    "nav footer aside form script style noscript template iframe object svg button select textarea input dialog head title"
    " canvas menu audio video math option datalist fieldset".split()
) - {"math"}
#: Words of a class, id or role that mark what isn't the article.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial adsense sponsor sponsored sponsors promo promos"
    " promotion promoted banner sidebar sidebars nav navbar navigation menu menus submenu breadcrumb breadcrumbs footer"
    " masthead topbar comment comments commentlist disqus respond replies reply notice notices notification cookie cookies"
    " consent gdpr alert alerts popup modal overlay newsletter subscribe subscription signup login share sharing sharebar"
    " social related recommended recommendations trending widget widgets toolbar pagination pager skip complementary"
    " contentinfo search searchbox disclaimer paywall feedback".split()
)
#: Words that say only that an element is one.
GENERIC = frozenset(
    "area bar block box boxes button buttons col column container content el element form group head header inner item items"
    " left link links list main module nav outer panel post posts right row section slot small large title top bottom unit"
    " view wrap wrapper article page the my js a b".split()
)
HEADER = frozenset(("header", "masthead", "topbar"))
_KEEP = frozenset(("with", "has", "no", "without"))


def squeeze(text: str) -> str:
    """White space as one space, trimmed."""
    return _SPACE.sub(" ", text).strip(" ")


class Page:
    """A tolerant reading of a page: elements with generalised paths, and text runs by block."""

    def __init__(self, html: str):
        self.tag: list[str] = ["#root"]
        self.path: list[str] = [""]
        self.parent: list[int] = [-1]
        self.drop: list[bool] = [False]
        #: (element, block, in a link, text)
        self.runs: list[tuple[int, int, bool, str]] = []
        self._read(html)

    def _read(self, html: str) -> None:
        stack, block, links, pos, n = [0], 0, 0, 0, len(html)
        tag, runs = self.tag, self.runs
        while pos < n:
            m = _TAG.search(html, pos)
            start = m.start() if m else n
            if start > pos:
                runs.append((stack[-1], block, links > 0, html[pos:start]))
            if m is None:
                break
            pos, name = m.end(), m[2]
            if name is None:
                if m[0].startswith("<![CDATA["):
                    runs.append((stack[-1], block, links > 0, m[0][9:].removesuffix("]]>").replace("&", "&amp;")))
                continue
            name = name.lower()
            if m[1]:
                if name in BLOCK and name not in CELLS:
                    block += 1
                elif name in CELLS:
                    runs.append((stack[-1], block, False, " "))
                if name == "br":
                    runs.append((stack[-1], block, False, " "))
                    continue
                for i in range(len(stack) - 1, 0, -1):
                    t = tag[stack[i]]
                    if t == name:
                        links -= sum(tag[k] == "a" for k in stack[i:])
                        del stack[i:]
                        break
                    if name not in BLOCK and t in BLOCK:
                        break
                    if name in LEAVES and t not in LEAVES and t in BLOCK:
                        break
                continue
            if name in BLOCK:
                self._imply(name, stack)
                links = sum(tag[k] == "a" for k in stack)
                if name not in CELLS:
                    block += 1
                else:
                    runs.append((stack[-1], block, False, " "))
            if name in VOID:
                if name in ("br", "hr"):
                    runs.append((stack[-1], block, False, " "))
                continue
            self._open(name, m[3], stack)
            if name in RAW:
                end = re.compile(f"</{name}[\\s/>]", re.I).search(html, pos)
                pos = n if end is None else end.start()
                if end is not None:
                    close = html.find(">", end.start())
                    pos = n if close < 0 else close + 1
                stack.pop()
            elif m[3].endswith("/") and name in ("svg", "path"):
                stack.pop()
            elif name == "a":
                links += 1

    def _imply(self, name: str, stack: list[int]) -> None:
        """End the elements that a start tag of this name ends by itself."""
        ends = {
            "li": ("li", ("ul", "ol", "menu", "dir")),
            "dt": ("dt dd", ("dl",)),
            "dd": ("dt dd", ("dl",)),
            "td": ("td th", ("tr", "table")),
            "th": ("td th", ("tr", "table")),
            "tr": ("tr", ("table", "tbody", "thead", "tfoot")),
            "tbody": ("tbody thead tfoot", ("table",)),
            "option": ("option", ("select", "datalist")),
            "body": ("head", ("html",)),
        }
        names, stops = ends.get(name, ("p", ()))
        wanted = set(names.split()) | {"p"}
        for i in range(len(stack) - 1, 0, -1):
            t = self.tag[stack[i]]
            if t in wanted:
                del stack[i:]
                if t != "p":
                    return
            elif t in stops or t in BLOCK and t not in ("p",) and t not in wanted and not (stops and t in LEAVES):
                return

    def _open(self, name: str, attrs: str, stack: list[int]) -> None:
        up = stack[-1]
        kind, words = name, []
        if attrs and "=" in attrs:
            got = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
            cls = got.get("class", "")
            kind += "".join("." + c for c in sorted(set(_DIGITS.sub("#", cls).split())))
            words = [cls, got.get("id", ""), got.get("role", "")]
        me = len(self.tag)
        self.tag.append(name)
        path = self.path[up] + ">" + kind
        # A hash stands for what is above in very deep elements, so paths stay short and distinct.
        self.path.append(path if len(path) < 2000 else "#" + xxhash.xxh3_128_hexdigest(path))
        self.parent.append(up)
        self.drop.append(self.drop[up] or self._noise(name, words, stack))
        stack.append(me)

    def _noise(self, name: str, words: list[str], stack: list[int]) -> bool:
        if name in ("html", "body"):
            return False
        if name in DROP:
            return True
        inside = any(self.tag[k] in ("article", "main") for k in stack)
        if name == "header" and not inside:
            return True
        for text in words:
            for one in text.split():
                tokens = {t.lower() for t in _TOKEN.findall(one)}
                if tokens & _KEEP:
                    continue
                hit = tokens & NOISE or (not inside and tokens & HEADER)
                # Inside the article a name must say nothing else: related-work or notice-of-findings are its text.
                if inside and not tokens <= NOISE | GENERIC:
                    continue
                if hit and (name not in ("article", "main") or tokens & {"comment", "comments", "ad", "ads", "advert", "related", "sponsored", "promo"}):
                    return True
        return False

    def containers(self) -> list[tuple[int, float]]:
        """(element, points), most first: each block's unlinked text counts for its container."""
        text: dict[tuple[int, int], list[int]] = {}
        for at, block, link, run in self.runs:
            if not self.drop[at]:
                n = len(squeeze(run))
                if n:
                    home = at
                    while self.tag[home] not in BLOCK or self.tag[home] in LEAVES:
                        if home == 0:
                            break
                        home = self.parent[home]
                    c = text.setdefault((home, block), [0, 0])
                    c[0] += n
                    c[1] += n * link
        points: dict[int, float] = {}
        for (home, _), (n, linked) in text.items():
            if n > 2 * linked:
                # An article or main element around a container stands for it.
                top = home
                while top > 0 and self.tag[top] not in ("article", "main"):
                    top = self.parent[top]
                top = top or home
                points[top] = points.get(top, 0.0) + n - 2.0 * linked
        return sorted(points.items(), key=lambda c: (-c[1], c[0]))

    def extract(self, paths: set[str]) -> str:
        """The kept text on elements of these paths: blocks in page order, joined by an empty line."""
        inside = [False] * len(self.tag)
        for i in range(1, len(self.tag)):
            inside[i] = inside[self.parent[i]] or self.path[i] in paths
        if "" in paths:
            inside = [True] * len(self.tag)
        blocks: dict[int, list[str]] = {}
        for at, block, _, run in self.runs:
            if inside[at] and not self.drop[at] and self._shown(at):
                blocks.setdefault(block, []).append(run)
        texts = (squeeze(unescape("".join(b))) for b in blocks.values())
        return "\n\n".join(t for t in texts if t)

    def _shown(self, at: int) -> bool:
        """Of a header inside the article only its headings are text."""
        heading = False
        while at > 0:
            t = self.tag[at]
            heading = heading or t in HEADINGS
            if t == "header":
                return heading
            at = self.parent[at]
        return True


def voted_for(page: Page) -> dict[str, bool]:
    """Of the paths of a page's containers, which it votes for."""
    found = page.containers()
    out: dict[str, bool] = {}
    for at, p in found:
        out[page.path[at]] = out.get(page.path[at], False) or p >= VOTE_PART * found[0][1]
    return out


def host_paths(pages: DataFrame) -> DataFrame:
    """host, paths: the paths that most of the host's pages with such a container vote for (in order of paths).

    Votes are added up in each task before the shuffle, so a hot host costs no more than others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes: dict[tuple[str, str], list[int]] = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array([h for h, _ in votes], pa.string()),
                    pa.array([p for _, p in votes], pa.string()),
                    pa.array([y for y, _ in votes.values()], pa.int64()),
                    pa.array([n for _, n in votes.values()], pa.int64()),
                ],
                names=["host", "path", "yes", "pages"],
            )
            votes.clear()
            return batch

        for batch in slices(batches):
            for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                host = split_url(url)[0]
                for path, yes in voted_for(Page(html or "")).items():
                    v = votes.setdefault((host, path), [0, 0])
                    v[0] += yes
                    v[1] += 1
            if len(votes) > 50_000:
                yield out()
        yield out()

    return (
        pages.mapInArrow(run, "host string, path string, yes long, pages long")
        .groupBy("host", "path")
        .agg(F.sum("yes").alias("yes"), F.sum("pages").alias("pages"))
        .filter((2 * F.col("yes") > F.col("pages")) & (F.col("yes") >= LEAST_VOTES))
        .groupBy("host")
        .agg(F.sort_array(F.collect_list("path")).alias("paths"))
    )


def main_text(html: str | None, paths: list[str]) -> str:
    """A page's text on all winning paths of its host, in page order; if it has none there, that of the
    containers it votes for itself, else of the whole body."""
    page = Page(html or "")
    if paths and (text := page.extract(set(paths))):
        return text
    return page.extract({p for p, yes in voted_for(page).items() if yes}) or page.extract({""})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_paths for every row of ``pages`` (page_id, url, html).

    Null or empty html has an empty text; a null url belongs to the empty host. Broken markup is read as
    browsers do, more or less: missing end tags are implied, stray ones ignored. n_paths counts the
    host's winning paths. Repeated rows come out alike; an empty table gives no rows.
    """
    lean = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    paths = materialise(host_paths(lean.select("url", "html")), "paths")

    def hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h = pa.array([split_url(u)[0] for u in batch.column("url").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, h], names=[*batch.schema.names, "host"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [p or [] for p in batch.column("paths").to_pylist()]
            texts = [main_text(h, p) for h, p in zip(batch.column("html").to_pylist(), own)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([len(p) for p in own], pa.int32()),
                ],
                names=["page_id", "url", "text", "n_chars", "n_paths"],
            )

    return (
        lean.mapInArrow(hosts, "page_id long, url string, html string, host string")
        .join(paths, "host", "left")
        .select("page_id", "url", "html", "paths")
        .mapInArrow(run, "page_id long, url string, text string, n_chars long, n_paths int")
    )


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
