"""HTML pages as arrays of nodes.

Turning markup into nodes is the one step that runs in Python on executors, in
Arrow batches.  Each page stays one row with an array of its nodes in document
order, so later steps need no shuffle and no self-join: ancestors are positions
in the same array, and a subtree is a slice of it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeboard import fixed_values as V

PAGES_AT_ONCE, PAGES_OUT = 4, 64      # pages parsed at once, pages handed to Spark at once

# parent, last: positions (from 0) of the parent and of the last node of the subtree
# path: positions of the ancestors, root first; texts have the tag '#text'
# n_texts, text_chars, link_chars, n_links: totals of the subtree outside page chrome
NODE_TYPE = (
    "struct<parent:int,last:int,tag:string,html_id:string,classes:array<string>,attrs:map<string,string>,"
    "text:string,path:array<int>,chrome:boolean,n_texts:int,text_chars:int,link_chars:int,n_links:int>")

_TOKEN = re.compile(
    r"<!--.*?-->|<![^>]*>|<\?[^>]*>|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*>"
    r"|<(?P<open>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {"script", "style", "textarea", "title"}
_BLOCK = set("address article aside blockquote center dd details dir div dl dt fieldset figcaption figure footer form "
             "h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
# an opening tag ends these open tags, looking up no further than the given limits
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "a": ({"a"}, {"td", "th", "table"}),
}


class _Page:
    """Node lists of one page."""

    def __init__(self, chrome_tags: frozenset[str]):
        self.chrome_tags = chrome_tags
        self.parent, self.last, self.tag, self.attrs, self.text, self.path, self.chrome = [], [], [], [], [], [], []
        self.totals: list[list[int]] = []
        self.open: list[int] = []

    def add(self, tag: str, attrs: dict[str, str] | None, text: str | None) -> int:
        here = len(self.tag)
        up = self.open[-1] if self.open else -1
        self.parent.append(up)
        self.last.append(here)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.text.append(text)
        self.path.append(tuple(self.open))
        self.chrome.append(tag in self.chrome_tags or (up >= 0 and self.chrome[up]))
        self.totals.append([0, 0, 0, 0])
        return here

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in _BLOCK:
            self.end("p", {"button", "table", "td", "th"})
        if tag in _ENDS:
            ended, limits = _ENDS[tag]
            for i in range(len(self.open) - 1, -1, -1):
                name = self.tag[self.open[i]]
                if name in limits:
                    break
                if name in ended:
                    self.close_to(i)
        here = self.add(tag, attrs, None)
        if tag == "a" and "href" in attrs and not self.chrome[here]:
            for i in self.open:
                self.totals[i][3] += 1
        if tag not in _VOID:
            self.open.append(here)

    def words(self, raw: str) -> None:
        text = html.unescape(raw).strip()
        if not text:
            return
        here = self.add("#text", None, text)
        if self.chrome[here]:
            return
        n, link_at = len(text), -1
        for i in self.open:
            if self.tag[i] == "a":
                link_at = i
        for i in self.open:
            sums = self.totals[i]
            sums[0] += 1
            sums[1] += n
            if link_at > i:
                sums[2] += n

    def end(self, tag: str, limits: frozenset[str] | set[str] = frozenset()) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            name = self.tag[self.open[i]]
            if name == tag:
                self.close_to(i)
                return
            if name in limits:
                return

    def close_to(self, depth: int) -> None:
        end = len(self.tag) - 1
        for i in self.open[depth:]:
            self.last[i] = end
        del self.open[depth:]


def parse(page: str, chrome_tags: frozenset[str]) -> _Page:
    """Nodes of one page; unclosed and misnested tags are closed as browsers do for common cases."""
    out, at = _Page(chrome_tags), 0
    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue  # inside raw text that was skipped
        if m.start() > at:
            out.words(page[at:m.start()])
        at = m.end()
        name = m["open"]
        if name:
            tag = name.lower()
            attrs = {}
            for k, a, b, c in _ATTR.findall(m["attrs"]):
                attrs.setdefault(k.lower(), html.unescape(a or b or c))
            out.start(tag, attrs)
            if tag in _RAW:
                stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                body_end = stop.start() if stop else len(page)
                if tag in ("title", "textarea"):
                    out.words(page[at:body_end])
                out.end(tag)
                at = stop.end() if stop else len(page)
        elif m["close"]:
            out.end(m["close"].lower())
    if at < len(page):
        out.words(page[at:])
    out.close_to(0)
    return out


def _node_array(pages: pa.Array, chrome_tags: frozenset[str]) -> pa.Array:
    offsets, rows = [0], _Page(chrome_tags)
    for value in pages:
        if value.is_valid:
            p = parse(value.as_py(), chrome_tags)
            for name in ("parent", "last", "tag", "attrs", "text", "path", "chrome", "totals"):
                getattr(rows, name).extend(getattr(p, name))
        offsets.append(len(rows.tag))
    ids = [a.get("id") if a else None for a in rows.attrs]
    classes = [a["class"].split() if a and "class" in a else [] for a in rows.attrs]
    totals = list(zip(*rows.totals)) or [(), (), (), ()]
    attrs = [list(a.items()) if a else [] for a in rows.attrs]
    columns = {
        "parent": pa.array(rows.parent, pa.int32()), "last": pa.array(rows.last, pa.int32()),
        "tag": pa.array(rows.tag, pa.string()), "html_id": pa.array(ids, pa.string()),
        "classes": pa.array(classes, pa.list_(pa.string())),
        "attrs": pa.array(attrs, pa.map_(pa.string(), pa.string())), "text": pa.array(rows.text, pa.string()),
        "path": pa.array(rows.path, pa.list_(pa.int32())), "chrome": pa.array(rows.chrome, pa.bool_()),
        **{n: pa.array(totals[i], pa.int32()) for i, n in enumerate(("n_texts", "text_chars", "link_chars", "n_links"))},
    }
    struct = pa.StructArray.from_arrays(list(columns.values()), names=list(columns))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)


def node_arrays(batches: Iterator[pa.Array], chrome_tags: frozenset[str]) -> Iterator[pa.Array]:
    """The nodes of the pages of each batch, a few pages in each array.

    Neither as Python objects nor as Arrow data are the nodes of a whole batch held at once.
    """
    for pages in batches:
        for at in range(0, len(pages), PAGES_OUT):
            some = pages.slice(at, PAGES_OUT)
            yield pa.concat_arrays([_node_array(some.slice(i, PAGES_AT_ONCE), chrome_tags) for i in range(0, len(some), PAGES_AT_ONCE)])


def nodes_of(page: Column, chrome_tags: Sequence[str] = tuple(V.CHROME_TAGS)) -> Column:
    """Array of the nodes of a page, NULL page as an empty array."""
    tags = frozenset(chrome_tags)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return node_arrays(batches, tags)

    # not deterministic, for the optimizer: it must not repeat the parse for a filter on its result
    return F.arrow_udf(run, f"array<{NODE_TYPE}>").asNondeterministic()(page)


def nodes_table(pages: DataFrame, html_column: str = "html", key: str = "page_id",
                chrome_tags: Sequence[str] = tuple(V.CHROME_TAGS)) -> DataFrame:
    """One row per node outside page chrome."""
    arrays = pages.select(key, nodes_of(F.col(html_column), chrome_tags).alias("nodes"))
    return arrays.select(key, F.posexplode_outer("nodes").alias("node_id", "n")).filter(
        F.col("n").isNotNull() & ~F.col("n.chrome")).select(
        key, "node_id", F.col("n.parent").alias("parent_id"), F.size("n.path").alias("depth"), F.col("n.tag").alias("tag"),
        F.col("n.html_id").alias("id"), F.col("n.classes").alias("classes"), F.col("n.attrs").alias("attrs"),
        F.col("n.text").alias("own_text"), F.col("n.path").alias("path"))


_TABLE_TYPE = ("node_id int, parent_id int, depth int, tag string, id string, classes array<string>, attrs map<string,string>, "
               "own_text string, path array<int>")


def register_nodes_function(spark: SparkSession, name: str = "html_nodes", chrome_tags: Sequence[str] = tuple(V.CHROME_TAGS)) -> None:
    """Make the nodes of a page a table function of SQL: ``FROM pages, LATERAL html_nodes(html)``.

    Columns are those of ``nodes_table`` behind the key; a NULL page has no rows.
    Lateral joins take no Arrow-optimized table functions, so jobs over many pages
    use ``nodes_table``.
    """
    tags = frozenset(chrome_tags)

    class Nodes:
        def eval(self, page: str) -> Iterator[tuple]:
            found = parse(page or "", tags)
            for i, chrome in enumerate(found.chrome):
                if page is not None and not chrome:
                    attrs = found.attrs[i] or {}
                    yield (i, found.parent[i], len(found.path[i]), found.tag[i], attrs.get("id"), attrs.get("class", "").split(),
                           attrs, found.text[i], found.path[i])

    spark.udtf.register(name, F.udtf(Nodes, returnType=_TABLE_TYPE, useArrow=False))
