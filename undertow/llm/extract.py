"""Main text of web pages by a site style tree: the pages of a host are laid over each other, and branches that say little go."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pin
from .common import portions
from .urls import host

#: Branches and blocks below this importance go; the share that each level below adds to a branch's importance.
THRESHOLD, DECAY = 0.2, 0.9
#: Levels of a page that are told apart. What lies deeper counts as the last of them; its text is kept all the same.
DEEPEST = 24

# Elements of HTML that begin a block of text, that have no content, and whose content is no text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
# What marks a branch as no part of an article, by element and by words in class and id.
NOISE = frozenset("aside button canvas dialog footer head menu nav noscript object select svg template audio video search".split())
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs consent cookie cookies copyright footer gdpr header "
    "masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related share "
    "sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
_HEADERS = frozenset(("header", "masthead", "banner"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: What a start tag closes if it comes before what holds these: (closed, holders).
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
_IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"  # a comment, to the end if it is never closed
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def signed(data: str) -> int:
    value = xxhash.xxh3_64_intdigest(data.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >= 1 << 63 else value


class Element:
    """A block of a page, or an element inside one that marks its content as no part of the text."""

    __slots__ = ("tag", "up", "path", "depth", "names", "strong", "weak", "article", "holds", "inside", "noise", "children", "held")

    def __init__(self, tag: str, attributes: dict[str, str], up: Element | None) -> None:
        found = f"{attributes.get('class', '')} {attributes.get('id', '')}"
        self.names = {w.lower() for w in _NAME.findall(found)} if found != " " and tag not in ("html", "body") else set()
        step = ".".join([tag, *sorted(self.names)])
        self.tag, self.up, self.depth = tag, up, (up.depth + 1 if up else 0)
        self.path = step if up is None else f"{up.path}/{step}" if self.depth < DEEPEST else up.path
        role = attributes.get("role", "").lower()
        self.strong = tag in NOISE or bool(self.names & COMMENTS) or role in ("navigation", "complementary", "contentinfo", "search")
        self.weak = tag in ("form", "header") or role == "banner" or bool(self.names & WORDS)
        named = role == "main" or tag == "main" or attributes.get("itemprop", "").lower() == "articlebody"
        self.article = 2 if tag == "article" or role == "article" else 1 if named else 0
        self.holds = self.inside = self.noise = False
        self.children: list[str] = []
        self.held: list[str] | None = None  # text around an element inside a block, kept until it ends
        if up is not None:
            up.children.append(step)


class Page:
    """Blocks of text of a page in page order, and its elements. Tags that are left open are closed as browsers do."""

    def __init__(self, source: str) -> None:
        self.elements: list[Element] = []
        self.blocks: list[tuple[Element, str]] = []
        self.stack: list[Element] = []
        self.opened: Counter[str] = Counter()
        self.text: list[str] = []
        self._push(Element("html", {}, None))
        at = 0
        while match := _TOKEN.search(source, at):
            if match.start() > at:
                self.text.append(source[at : match.start()])
            at = match.end()
            closing, tag, rest = match.groups()
            if tag is None:
                continue
            tag = tag.lower()
            if closing:
                self._end(tag)
            elif tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = end.end() if end else len(source)
            else:
                self._start(tag, rest)
        self.text.append(source[at:])
        while self.stack:
            self._pop()
        self._judge()

    def _flush(self) -> None:
        found = "".join(self.text)
        self.text = []
        found = " ".join((html.unescape(found) if "&" in found else found).split())
        if found and self.stack:
            self.blocks.append((self.stack[-1], found))

    def _push(self, element: Element) -> None:
        self.stack.append(element)
        self.elements.append(element)
        self.opened[element.tag] += 1

    def _pop(self) -> None:
        self._flush()
        element = self.stack.pop()
        self.opened[element.tag] -= 1
        if element.held is not None:
            self.text = element.held

    def _pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            self._pop()

    def _start(self, tag: str, rest: str) -> None:
        if tag in VOID:
            if tag == "hr":
                self._flush()
            elif tag == "br":
                self.text.append(" ")
            return
        if tag in ("html", "body") and self.opened[tag]:
            return
        if self.opened["head"] and tag not in _IN_HEAD:
            self._pop_to(next(i for i, e in enumerate(self.stack) if e.tag == "head"))
        attributes = {}
        if "=" in rest:
            for m in _ATTRIBUTE.finditer(rest):
                attributes.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        if tag in BLOCKS:
            self._close_for(tag)
            self._flush()
            self._push(Element(tag, attributes, self.stack[-1] if self.stack else None))
            return
        inline = Element(tag, attributes, None)
        if inline.strong or inline.weak:
            inline = Element(tag, attributes, self.stack[-1])
            inline.held, self.text = self.text, []
            self._push(inline)

    def _close_for(self, tag: str) -> None:
        nearest = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i].held is None), None)
        if nearest is None:
            return
        here = self.stack[nearest].tag
        if here == "p" or here in _HEADINGS and tag in _HEADINGS:
            self._pop_to(nearest)
        closed, holders = _CLOSES.get(tag, ((), ()))
        if not any(self.opened[c] for c in closed):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag in closed:
                return self._pop_to(i)
            if self.stack[i].tag in holders:
                return None

    def _end(self, tag: str) -> None:
        if not self.opened[tag] or tag in ("html", "body"):
            if tag == "br":
                self.text.append(" ")
            return
        self._pop_to(next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i].tag == tag))

    def _judge(self) -> None:
        """What the page's own marks say of each element; parents come before their children."""
        for e in self.elements:
            e.noise = e.strong or (e.up is not None and e.up.noise)
        found = [e for e in self.elements if e.article and not e.noise and not e.names & WORDS]
        best = max((e.article for e in found), default=0)
        roots = [e for e in found if e.article == best]
        self.marked = bool(roots)
        for e in roots:
            e.inside = True
            above = e.up
            while above is not None and not above.holds:
                above.holds, above = True, above.up
        for e in self.elements:
            above = e.up
            if above is not None:
                e.inside |= above.inside
                e.noise |= above.noise
            if e.weak and not e.holds:
                own_header = e.inside and (e.tag == "header" or e.names & _HEADERS) and not e.names & (WORDS - _HEADERS)
                e.noise |= not own_header and e.tag not in ("html", "body")

    def bound(self, element: Element) -> int | None:
        """1 for a part of what the page marks as its article, 0 for what it marks as none, None if it does not say."""
        return 0 if element.noise else 1 if element.inside else 0 if self.marked else None


_STYLE = (
    "array<struct<node: bigint, up: bigint, depth: int, bound: int, style: bigint, upper: bigint, n: bigint, blocks: bigint, first: int>>"
)
_BLOCK = "array<struct<node: bigint, mark: bigint, text: string>>"
_FIELDS = f"styles {_STYLE}, marks array<struct<node: bigint, mark: bigint, bound: int, n: bigint>>, blocks {_BLOCK}"


def page_rows(source: bytes | None) -> tuple[list[dict], list[dict], list[dict]]:
    """A page's (styles, marks, blocks): its elements by node of the style tree, sequence of children (their style) and style of the
    element they stand in (``upper``), with the number of blocks in them; the contents of its blocks with their number; and the
    blocks. Text that the page marks as no article is left out."""
    page = Page((source or b"").decode("utf-8", "replace"))
    node: dict[int, int] = {}
    up: dict[int, tuple[int | None, int, int | None]] = {}
    style: dict[int, int] = {}
    styles: Counter[tuple[int, int, int | None]] = Counter()
    held: Counter[tuple[int, int, int | None]] = Counter()

    def kind(e: Element) -> tuple[int, int, int | None]:
        number = node[id(e)]
        return number, style[id(e)], None if e.up is None or e.depth >= DEEPEST else style[id(e.up)]

    for e in page.elements:
        bound = page.bound(e)
        node[id(e)] = number = signed(f"{e.path}|{bound}")
        above = None if e.up is None else node[id(e.up)]
        if e.depth < DEEPEST:
            up.setdefault(number, (above, e.depth, bound))
        else:
            up.setdefault(number, (None, DEEPEST, bound))
        style[id(e)] = signed(" ".join(e.children))
        styles[kind(e)] += 1
    for e, _ in page.blocks:
        held[kind(e)] += 1
    seen, rows = set(), []
    for (number, own, upper), n in styles.items():
        above, depth, bound = up[number]
        row = dict(node=number, up=above, depth=depth, bound=bound, style=own, upper=upper, n=n)
        rows.append(row | dict(blocks=held[number, own, upper], first=int(number not in seen)))
        seen.add(number)
    marks: Counter[tuple[int, int, int | None]] = Counter()
    blocks = []
    for e, text in page.blocks:
        number, mark, bound = node[id(e)], signed(text), page.bound(e)
        marks[number, mark, bound] += 1
        blocks.append(dict(node=number, mark=mark, text=None if bound == 0 else text))
    return rows, [dict(node=a, mark=b, bound=c, n=n) for (a, b, c), n in marks.items()], blocks


def doms(pages: DataFrame) -> DataFrame:
    """(id, row, host, styles, marks, blocks) of every page: parsed once, where it is. ``row`` has key, url."""
    schema = pages.select("id", "row", "host").schema
    for field in pages.sparkSession.createDataFrame([], _FIELDS).schema.fields:
        schema = schema.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for batch in batches:
            for keys, sources in portions(batch):
                columns = [keys.field(name) for name in ("id", "row", "host")]
                found = list(zip(*map(page_rows, sources)))
                columns += [pa.array(list(c), kinds.field(i + 3).type) for i, c in enumerate(found)]
                yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    return pages.select(F.struct("id", "row", "host").alias("key"), "html").mapInArrow(run, schema)


def _entropy(total: Column, weighted: Column, most: Column) -> Column:
    """Entropy of shares, as a part of the greatest one: ``weighted`` is the sum of n ln n over the parts of ``total``."""
    return F.when(most > 1, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.ln(total) - weighted / total) / F.ln(most)))).otherwise(0.0)


def style_tree(dom: DataFrame, by_style: bool = False) -> tuple[DataFrame, DataFrame]:
    """The style trees of all hosts: nodes (host, node, importance, best) and contents (host, node, mark, importance).

    Presentation: a node that has the same children wherever it occurs says nothing, one whose pages all
    differ says most. Content: a block found on one page of its host only says most, one that is spread evenly over
    all pages with its node says nothing. A branch's importance is both, the lower levels by ``DECAY``
    to the number of its styles. What the pages mark as article or as none is bound to 1 or 0: entropy cannot tell an advert
    that changes from page to page from an article that does. ``best`` is the greatest importance in a branch.

    ``by_style`` takes the lower levels as the site style tree does: a style's importance is the mean over what stands in it, a
    branch's the mean of its styles by how often each occurs, so a style with many parts counts for no more than one with
    few. The last level is one leaf with all that lies deeper. Without it all that stands in a branch is one mean, whichever
    style it stands in.

    Pages are summed up before they move, and all sums are taken by Spark per host, node and style or block, so
    a host with a third of all pages is a third of the additions and never one group in a task.
    """
    counts = [F.sum("n").alias("n"), F.sum("blocks").alias("blocks"), F.sum("first").alias("pages")]
    styles = dom.select("host", F.inline("styles"))
    if by_style:
        uses = pin(styles.groupBy("host", "node", "up", "depth", "bound", "style", "upper").agg(*counts), "uses")
        styles = uses.withColumnRenamed("pages", "first")
        # Only a branch that is bound to nothing has its importance from its styles.
        parted = pin(uses.where("bound is null").groupBy("host", "node", "depth", "style").agg(F.sum("n").alias("n"), F.sum("blocks").alias("blocks")), "parted")
        placed = pin(uses.groupBy("host", "node", "up", "depth", "upper").agg(F.sum("n").alias("n")), "placed")
    styles = styles.groupBy("host", "node", "up", "depth", "bound", "style").agg(*counts)
    log = F.col("n") * F.ln("n")
    nodes = styles.groupBy("host", "node", "up", "depth", "bound").agg(
        F.sum("n").alias("n"), F.sum("pages").alias("pages"), F.count("*").alias("styles"), F.sum(log).alias("logs")
    )
    alone = F.col("n") == 1
    nodes = pin(nodes.withColumn("shown", F.when(alone, 1.0).otherwise(_entropy(F.col("n"), F.col("logs"), F.col("n")))), "nodes")
    contents = dom.select("host", F.inline("marks")).groupBy("host", "node", "bound", "mark")
    contents = contents.agg(F.sum("n").alias("total"), F.sum(log).alias("logs"))
    contents = contents.join(nodes.select("host", "node", "pages"), ["host", "node"])
    said = F.coalesce(F.col("bound"), 1 - _entropy(F.col("total"), F.col("logs"), F.col("pages")))
    contents = pin(contents.select("host", "node", "bound", "mark", "total", said.alias("importance")), "contents")
    own = contents.groupBy("host", "node").agg(F.avg("importance").alias("said"), F.sum("total").alias("blocks"))
    nodes = pin(nodes.join(own, ["host", "node"], "left"), "nodes")
    below, inside, done = None, None, []
    for depth in range(nodes.agg(F.max("depth")).first()[0] or 0, -1, -1):
        level = nodes.where(F.col("depth") == depth)
        if below is None:
            level = level.withColumns({"under": F.lit(0.0), "parts": F.lit(0), "most": F.lit(0.0)})
        else:
            level = level.join(below, ["host", "node"], "left")
        parts = F.coalesce("parts", F.lit(0)) + F.coalesce("blocks", F.lit(0))
        lower = F.coalesce("under", F.lit(0.0)) + F.coalesce(F.col("said") * F.col("blocks"), F.lit(0.0))
        mean = F.when(parts > 0, lower / parts).otherwise(0.0)
        if by_style and depth < DEEPEST - 1:
            part = parted.where(F.col("depth") == depth).join(own.select("host", "node", "said"), ["host", "node"], "left")
            if inside is None:
                part = part.withColumns({"under": F.lit(0.0), "parts": F.lit(0)})
            else:
                part = part.join(inside, ["host", "node", "style"], "left")
            means = part.groupBy("host", "node").agg((F.sum(F.col("n") * mean) / F.sum("n")).alias("mean"))
            level, mean = level.join(means, ["host", "node"], "left"), F.coalesce("mean", F.lit(0.0))
        weight = F.pow(F.lit(DECAY), F.col("styles"))
        mixed = (1 - weight) * F.col("shown") + weight * mean
        level = level.withColumn("importance", F.coalesce(F.col("bound").cast("double"), mixed))
        best = F.when(F.col("bound") == 0, 0.0).otherwise(F.greatest("importance", "most"))
        level = pin(level.select("host", "node", "up", "n", "importance", best.alias("best")), "level")
        done.append(level.select("host", "node", "importance", "best"))
        below = level.where("up is not null").groupBy("host", F.col("up").alias("node")).agg(
            F.sum(F.col("n") * F.col("importance")).alias("under"), F.sum("n").alias("parts"), F.max("best").alias("most")
        )
        if by_style:
            inside = placed.where((F.col("depth") == depth) & F.col("up").isNotNull())
            inside = inside.join(level.select("host", "node", "up", "importance"), ["host", "node", "up"])
            inside = inside.groupBy("host", F.col("up").alias("node"), F.col("upper").alias("style")).agg(
                F.sum(F.col("n") * F.col("importance")).alias("under"), F.sum("n").alias("parts")
            )
    tree = done[0]
    for level in done[1:]:
        tree = tree.union(level)
    return tree, contents


def extract(pages: DataFrame, key: str = "page_id", threshold: float = THRESHOLD) -> DataFrame:
    """(``key``, url, text, n_chars) of every page: the blocks that its host's style tree finds important, a line each.

    A block is what stands between the borders of block elements; character references are decoded, white space
    in it becomes one space, and blocks without any other character are none. Blocks of branches with no importance of at
    least ``threshold``, and blocks of less importance themselves, go; nothing else is cut.

    A null html is empty, a null url belongs to the host of no name; pages without a block left have an empty
    text. Repeated rows are pages of their own, a null key is kept. Pages of any length are
    parsed whole. Other columns of ``pages`` are not looked at.

    Each page is parsed once, and written; only blocks and counts move, never the html.
    """
    picked = pages.select(
        F.monotonically_increasing_id().alias("id"),
        F.struct(F.col(key).alias("key"), F.col("url").alias("url")).alias("row"),
        host(F.col("url")).alias("host"),
        F.col("html").cast("string").alias("html"),
    )
    dom = pin(doms(picked), "doms", compression="zstd")
    tree, contents = style_tree(dom, by_style=True)
    # A branch that its pages bind to 0 has left its text behind already, and one bound to 1 stays: pages that
    # say so of all their blocks are done, and only the others meet the tree again.
    open_ = F.exists("marks", lambda m: m["bound"].isNull())
    marks = dom.where(open_).select("id", "host", F.inline("marks")).where("bound is null").select("id", "host", "node", "mark")
    low = marks.join(tree.where(F.col("best") < threshold), ["host", "node"], "left_semi")
    same = marks.join(contents.where(F.col("importance") < threshold), ["host", "node", "mark"], "left_semi")
    gone = low.unionByName(same).groupBy("id").agg(F.collect_set(F.struct("node", "mark")).alias("gone"))
    none = F.lit(None).cast(gone.schema["gone"].dataType).alias("gone")
    joined = dom.where(open_).select("id", "row", "blocks").join(gone, "id", "left").select("row", "blocks", "gone")
    joined = joined.union(dom.where(~open_).select("row", "blocks", none))
    kept = F.filter(
        "blocks",
        lambda b: b["text"].isNotNull()
        & ~F.coalesce(F.array_contains("gone", F.struct(b["node"].alias("node"), b["mark"].alias("mark"))), F.lit(False)),
    )
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    found = joined.select(F.col("row.key").alias(key), F.col("row.url").alias("url"), text.alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
