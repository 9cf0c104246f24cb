"""Notice lists and main texts from parsed pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeboard import fixed_values as V
from noticeboard.functions import selectors as S
from noticeboard.functions.admission import admitted_by_heuristic, admitted_by_rule
from noticeboard.functions.dates import heuristic_date, parse_date_text
from noticeboard.functions.facts import clean_text
from noticeboard.functions.text import bind, squeeze, strip
from noticeboard.functions.urls import resolve_from, split_base
from noticeboard.sources.html_nodes import nodes_of

ITEM_TYPE = "struct<title:string,url:string,publish_date:string,position:int>"
NO_ITEMS = f"array<{ITEM_TYPE}>"


def with_selectors(rules: DataFrame) -> DataFrame:
    """Compile the selector strings of rules; missing title and link selectors mean 'a'."""
    def compiled(name: str, default: str) -> Column:
        text = F.coalesce(F.col(f"selectors.{name}"), F.lit(default))
        return S.compile_selector(text).alias(name)

    return rules.withColumn("selectors", F.struct(
        compiled("list_item", ""), compiled("title", "a"), compiled("link", "a"), compiled("date", "")))


def rule_items(nodes: Column, selectors: Column, base_url: Column) -> Column:
    """Notices a rule's selectors find on a page, in page order.

    Selectors are matched and texts are read once for the page, not once for each row.
    """
    def marked(name: str) -> Column:
        return S.marks(nodes, lambda n: S.matches(nodes, n, selectors[name])).alias(name)

    def item(row: Column, page: Column, m: Column) -> Column:
        def chosen(name: str) -> Column:
            return F.when(F.size(selectors[name]) == 0, row).otherwise(S.first_below(m[name], nodes, row))

        def build(p: Column) -> Column:
            # the row's text counts only where the place of the date tells none
            texts = F.array(F.when(p["date_at"].isNotNull(), S.text_below(m["texts"], nodes, p["date_at"], "")),
                            S.text_below(m["texts"], nodes, row, " "))
            date = F.aggregate(texts, F.lit(None).cast("string"), lambda found, t: F.coalesce(found, parse_date_text(t)))
            attr_title = bind(F.get(nodes, p["link_at"]), lambda n: strip(F.coalesce(S.attr(n, "title"), F.lit(""))))
            title = bind(attr_title, lambda t: F.when(F.length(t) >= V.TITLE_ATTR_MIN_CHARS, t).otherwise(
                S.text_below(m["texts"], nodes, p["title_at"], "")))
            href = strip(F.coalesce(S.attr(F.get(nodes, p["link_at"]), "href"), F.lit("")))
            return F.when(p["title_at"].isNotNull() & p["link_at"].isNotNull(), bind(
                F.struct(title.alias("t"), href.alias("h")),
                lambda x: F.when(admitted_by_rule(x["t"], x["h"]), F.struct(
                    squeeze(x["t"]).alias("title"), resolve_from(page, x["h"]).alias("url"),
                    date.alias("publish_date"), row.alias("position")))))

        anchor = S.first_below(m["links"], nodes, row)
        return bind(F.struct(F.coalesce(chosen("title"), anchor).alias("title_at"), F.coalesce(chosen("link"), anchor).alias("link_at"),
                             F.when(F.size(selectors["date"]) > 0, S.first_below(m["date"], nodes, row)).alias("date_at")), build)

    def found(rows: Column) -> Column:
        once = F.struct(marked("title"), marked("link"), marked("date"), S.marks(nodes, S.is_link).alias("links"),
                        S.texts_of(nodes).alias("texts"), split_base(base_url).alias("page"))
        return F.when(F.size(rows) > 0, bind(once, lambda m: F.transform(rows, lambda row: item(row, m["page"], m)))).otherwise(
            F.array().cast(NO_ITEMS))

    return F.filter(F.array_compact(bind(S.select_all(nodes, selectors["list_item"]), found)), lambda x: x["title"] != "")


def list_score(items: Column) -> Column:
    """How much a group of links looks like a notice list."""
    n = F.size(items).cast("double")
    lengths = F.transform(items, lambda x: F.length(x["title"]).cast("double"))
    total = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x)
    dated = F.size(F.filter(items, lambda x: x["publish_date"].isNotNull())).cast("double")
    return bind(F.struct(n.alias("n"), (total / n).alias("avg"), dated.alias("dated"), lengths.alias("lengths")),
                lambda s: list_score_of(s["n"], s["dated"], s["avg"], F.aggregate(
                    s["lengths"], F.lit(0.0), lambda a, x: a + (x - s["avg"]) * (x - s["avg"])) / s["n"]))


def list_score_of(n: Column, dated: Column, avg_chars: Column, variance: Column) -> Column:
    return (F.least(n / 10.0, F.lit(2.0)) + dated / n * 3.0
            + F.when(avg_chars.between(12, 70), 2.0).when(avg_chars < 8, -1.5).otherwise(0.0)
            + F.when(variance < 400, 1.0).otherwise(0.0))


def first_by_url(items: Column) -> Column:
    """The items whose address did not occur before; nothing but the first item stays behind an unknown address."""
    def firsts(urls: Column) -> Column:
        unknown = F.array_position(F.transform(urls, lambda u: u.isNull()), F.lit(True))
        return bind(unknown, lambda n: F.filter(items, lambda x, i: (i == 0) | (
            ((n == 0) | (i + 1 < n)) & (F.array_position(urls, x["url"]) == i + 1))))

    return bind(F.transform(items, lambda x: x["url"]), firsts)


def heuristic_items(nodes: Column, base_url: Column, min_title_chars: int = V.HEURISTIC_MIN_TITLE_CHARS,
                    max_rows: int | None = None, max_links: int | None = None) -> Column:
    """Notices of the block of links that looks most like a list.

    Containers with 3 links or more compete; an earlier kind of tag, then an
    earlier place on the page, wins a tie.  ``max_rows`` cuts the rows of a
    block and ``max_links`` leaves larger containers out.
    """
    def rows_of(c: Column, m: Column) -> Column:
        def positions(found: Column) -> Column:
            return F.transform(found, lambda x: x["at"])

        def direct(found: Column) -> Column:
            return F.filter(found, lambda x: x["parent"] == c)

        return bind(F.array_compact(S.below(m["rows"], nodes, c)), lambda b: bind(positions(direct(b)), lambda a: F.when(
            F.size(a) >= 2, a).otherwise(F.when(F.size(b) >= 2, positions(b)).otherwise(
                positions(direct(F.array_compact(S.below(m["blocks"], nodes, c))))))))

    def row_marks(tags: Sequence[str]) -> Column:
        return F.transform(nodes, lambda n, i: F.when(
            n["tag"].isin(list(tags)) & ~n["chrome"], F.struct(i.alias("at"), n["parent"].alias("parent"))))

    def item(row: Column, m: Column) -> Column:
        anchor = S.first_below(m["links"], nodes, row)

        def build(a: Column) -> Column:
            attr_title = bind(F.get(nodes, a), lambda n: strip(F.coalesce(S.attr(n, "title"), F.lit(""))))
            title = bind(attr_title, lambda t: F.when(F.length(t) >= V.TITLE_ATTR_MIN_CHARS, t).otherwise(
                S.text_below(m["texts"], nodes, a, "")))
            return bind(F.struct(title.alias("t"), strip(S.attr(F.get(nodes, a), "href")).alias("h")), lambda x: F.when(
                admitted_by_heuristic(x["t"], x["h"], min_title_chars), F.struct(
                    squeeze(x["t"]).alias("title"), resolve_from(m["page"], x["h"]).alias("url"),
                    heuristic_date(S.text_below(m["texts"], nodes, row, " ")).alias("publish_date"),
                    row.alias("position"))))

        return bind(anchor, lambda a: F.when(a.isNotNull(), build(a)))

    def candidate(c: Column, made: Column) -> Column:
        items = bind(F.array_compact(F.transform(c["rows"], lambda row: F.get(made, row))), first_by_url)
        return bind(items if max_rows is None else F.slice(items, 1, max_rows), lambda x: F.when(
            F.size(x) >= 2, F.struct(list_score(x).alias("score"), (-c["kind"]).alias("kind"), (-c["at"]).alias("at"),
                                     x.alias("items"))))

    tags = F.array(*[F.lit(t) for t in V.LIST_CONTAINER_TAGS])

    def competes(n: Column) -> Column:
        return (n["tag"].isin(V.LIST_CONTAINER_TAGS) & ~n["chrome"] & (n["n_links"] >= V.HEURISTIC_LINKS_MIN)
                & (F.lit(True) if max_links is None else n["n_links"] <= max_links))

    def made(m: Column) -> Column:
        """Of every node the notice it makes as a row, once for all containers that have this row."""
        return F.transform(nodes, lambda n, i: F.when(
            (n["n_links"] > 0) & ~n["chrome"] & (n["tag"].isin("li", "tr") | (
                n["tag"].isin("div", "p") & competes(F.get(nodes, n["parent"])))), item(i, m)))

    def best(competing: Column, m: Column) -> Column:
        places = F.transform(competing, lambda c: F.struct(
            c["at"].alias("at"), c["kind"].alias("kind"), rows_of(c["at"], m).alias("rows")))
        return bind(made(m), lambda x: F.array_max(F.array_compact(F.transform(places, lambda c: candidate(c, x)))))

    def found(competing: Column) -> Column:
        once = F.struct(
            row_marks(["li", "tr"]).alias("rows"), row_marks(["div", "p"]).alias("blocks"),
            S.marks(nodes, lambda n: S.is_link(n) & ~n["chrome"]).alias("links"),
            S.texts_of(nodes, with_chrome=False).alias("texts"), split_base(base_url).alias("page"))
        return F.when(F.size(competing) > 0, bind(once, lambda m: best(competing, m)["items"]))

    places = F.array_compact(F.transform(nodes, lambda n, i: F.when(
        competes(n), F.struct(i.alias("at"), F.array_position(tags, n["tag"]).cast("int").alias("kind")))))
    return F.coalesce(bind(places, found), F.array().cast(NO_ITEMS))


def listing_items(pages: DataFrame, rules: DataFrame, html_column: str = "html") -> DataFrame:
    """Notices of every page by its rule's selectors, by the heuristic where they find none.

    ``pages(rule_id, url, page, html)`` joined with ``rules`` on rule_id; one row
    per notice with the rule's city, district, source and category.
    """
    kept = ["rule_id", "city", "district", "source_name", "category"]
    compiled = with_selectors(rules).select(*kept, "selectors")
    # rules are broadcast whatever their table tells of its size: else a few rules would gather all pages in a few tasks
    parsed = pages.join(F.broadcast(compiled), "rule_id").withColumn("nodes", nodes_of(F.col(html_column)))
    by_rule = bind(rule_items(F.col("nodes"), F.col("selectors"), F.col("url")), lambda x: F.struct(
        (F.size(x) == 0).alias("from_fallback"),
        F.when(F.size(x) > 0, x).otherwise(heuristic_items(F.col("nodes"), F.col("url"))).alias("items")))
    found = parsed.select(*kept, "page", by_rule.alias("found"))
    return found.select(*kept, "page", "found.from_fallback", F.inline_outer("found.items")).filter(
        F.col("title").isNotNull())


def main_text(nodes: Column, selectors: Sequence[str] = tuple(V.CONTENT_SELECTORS)) -> Column:
    """Text of the main part of a page.

    First known content block with enough text, in selector order; else the
    div, td or section with most text and few links; else the whole page.
    """
    table = F.array(*[F.struct(
        F.lit(s.split("#")[0].split(".")[0]).alias("tag"),
        F.lit(s.split("#")[1] if "#" in s else "").alias("html_id"),
        F.lit(s.split(".")[1] if "." in s else "").alias("css")) for s in selectors])
    tags = sorted({s.split("#")[0].split(".")[0] for s in selectors})

    blocks = F.array_compact(F.transform(nodes, lambda n, i: F.when(
        n["tag"].isin(tags) & ~n["chrome"], F.struct(i.alias("at"), n["tag"].alias("tag"), n["html_id"].alias("html_id"),
                                                    n["classes"].alias("classes"), _chars(n).alias("chars")))))

    def first_block(b: Column) -> Column:
        hits = F.transform(table, lambda s: F.get(F.filter(b, lambda x: (x["tag"] == s["tag"])
                           & ((s["html_id"] == "") | F.coalesce(x["html_id"] == s["html_id"], F.lit(False)))
                           & ((s["css"] == "") | F.array_contains(x["classes"], s["css"]))), F.lit(0)))
        return F.get(F.filter(hits, lambda h: h["chars"] >= V.MIN_MAIN_TEXT_CHARS), F.lit(0))["at"]

    heavy = F.array_max(F.array_compact(F.transform(nodes, lambda n, i: F.when(
        n["tag"].isin("div", "td", "section") & ~n["chrome"] & (_chars(n) > 0)
        & (n["link_chars"] / _chars(n) < V.MAX_LINK_TEXT_SHARE),
        F.struct(_chars(n).alias("chars"), (-i).alias("before"))))))
    heaviest = F.when(heavy["chars"] >= V.MIN_MAIN_TEXT_CHARS, -heavy["before"])
    at = F.coalesce(bind(blocks, first_block), heaviest)
    texts = S.texts_of(nodes, with_chrome=False)
    return clean_text(bind(F.struct(at.alias("at"), texts.alias("texts")), lambda m: F.array_join(F.when(
        m["at"].isNotNull(), S.below(m["texts"], nodes, m["at"])).otherwise(m["texts"]), "\n")))


def _chars(n: Column) -> Column:
    """Length of a node's text with its pieces joined by line ends."""
    return F.when(n["n_texts"] > 0, n["text_chars"] + n["n_texts"] - 1).otherwise(0)
