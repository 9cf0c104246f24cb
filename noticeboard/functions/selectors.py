"""CSS selectors as data, and matching them against the nodes of a page.

Supported: comma lists of descendant chains of ``tag#id.class`` parts.  Anything
else is refused as a whole and matches nothing.  A rule's selector is a column,
so one plan serves any number of rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeboard.functions.text import bind, strip


_PART = r"(?:[A-Za-z][A-Za-z0-9]*(?:[#.][\w-]+)*|(?:[#.][\w-]+)+)"
SUPPORTED = rf"^\s*(?:{_PART}(?:\s+{_PART})*\s*(?:,\s*|$))*$"


def is_supported(selector: Column) -> Column:
    """Is it empty, or a comma list of descendant chains of ``tag#id.class`` parts?"""
    return F.coalesce(selector, F.lit("")).rlike(SUPPORTED)


def compile_selector(selector: Column) -> Column:
    """array of alternatives, each an array of (tag, html_id, classes) from outermost to innermost.

    A selector that is not supported gives an alternative that no node fits.
    """
    def part(p: Column) -> Column:
        return F.struct(
            F.lower(F.regexp_extract(p, r"^([A-Za-z0-9]*)", 1)).alias("tag"),
            F.regexp_extract(p, r"#([\w-]+)", 1).alias("html_id"),
            F.regexp_extract_all(p, F.lit(r"\.([\w-]+)"), F.lit(1)).alias("classes"))

    alternatives = F.filter(F.transform(F.split(selector, ","), strip), lambda a: a != "")
    compiled = F.transform(alternatives, lambda a: F.transform(F.split(a, r"\s+"), part))
    nothing = F.array(F.array(F.struct(F.lit("\0").alias("tag"), F.lit("").alias("html_id"),
                                       F.array().cast("array<string>").alias("classes"))))
    return F.when(is_supported(selector), compiled).otherwise(nothing)


def _fits(node: Column, part: Column) -> Column:
    return (((part["tag"] == "") | (node["tag"] == part["tag"]))
            & ((part["html_id"] == "") | F.coalesce(node["html_id"] == part["html_id"], F.lit(False)))
            & (F.size(F.array_except(part["classes"], F.coalesce(node["classes"], F.array().cast("array<string>")))) == 0)
            & (node["tag"] != "#text"))


def matches(nodes: Column, node: Column, selector: Column) -> Column:
    """Does the node match one of the alternatives of a compiled selector?

    Outer parts are taken greedily from the root downwards, which is enough for
    descendant chains.
    """
    def one(alternative: Column) -> Column:
        outer = F.size(alternative) - 1
        matched = F.aggregate(
            node["path"], F.lit(0),
            lambda k, p: F.when((k < outer) & _fits(F.get(nodes, p), F.get(alternative, k)), k + 1).otherwise(k))
        return _fits(node, F.element_at(alternative, -1)) & ((outer == 0) | (matched == outer))

    return F.exists(selector, one)


def select_all(nodes: Column, selector: Column) -> Column:
    """Positions of the matching nodes in document order."""
    marked = F.transform(nodes, lambda n, i: F.when(matches(nodes, n, selector), i))
    return F.array_compact(marked)


def marks(nodes: Column, test) -> Column:
    """Of every node of a page its position if it passes the test, else NULL.

    Looked at once for the whole page: what lies below a node is a slice of it.
    """
    return F.transform(nodes, lambda n, i: F.when(test(n), i))


def texts_of(nodes: Column, with_chrome: bool = True) -> Column:
    """Of every node of a page its text if it is one, else NULL."""
    return F.transform(nodes, lambda n: F.when((n["tag"] == "#text") if with_chrome
                                               else ((n["tag"] == "#text") & ~n["chrome"]), n["text"]))


def below(values: Column, nodes: Column, at: Column) -> Column:
    """Of an array with an element per node the part below ``at``; empty for a NULL position."""
    many = F.get(nodes, at)["last"] - at
    return F.slice(values, F.coalesce(at, F.lit(0)) + 2, F.greatest(F.coalesce(many, F.lit(0)), F.lit(0)))


def first_below(marked: Column, nodes: Column, at: Column) -> Column:
    """The first marked position below ``at``, else NULL."""
    return F.array_min(below(marked, nodes, at))


def text_below(texts: Column, nodes: Column, at: Column, sep: str) -> Column:
    """Text of a subtree, pieces trimmed and joined; ``texts`` come from ``texts_of``."""
    return F.array_join(below(texts, nodes, at), sep)


def attr(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def is_link(node: Column) -> Column:
    return (node["tag"] == "a") & attr(node, "href").isNotNull()
