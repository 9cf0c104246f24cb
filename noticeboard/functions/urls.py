"""URL canonical form and relative-reference resolution."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeboard import fixed_values as V
from noticeboard.functions.text import array_of, bind, strip

_SCHEME = "^([A-Za-z][A-Za-z0-9+.-]*):"
# references in plain characters that are resolved without taking them apart
_ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*://[!-~]*\z"
_OTHER_HOST = r"^//[!-~]*\z"
_ROOTED = r"^/(?!/)[!-~]*\z"


def split_url(url: Column) -> Column:
    """struct(scheme, host, path, query, has_host); absent parts are ''."""
    def cut(u: Column) -> Column:
        # the fragment ends the query, the query ends the rest
        return bind(F.substring_index(u, "#", 1), lambda w: bind(F.substring_index(w, "?", 1), lambda head: F.struct(
            head.alias("head"), F.regexp_extract(head, _SCHEME, 1).alias("scheme"),
            F.substring(w, F.length(head) + 2, F.length(w)).alias("query"))))

    def rest(x: Column) -> Column:
        tail = F.when(x["scheme"] == "", x["head"]).otherwise(
            F.substring(x["head"], F.length(x["scheme"]) + 2, F.length(x["head"])))
        return bind(tail, lambda t: F.struct(
            F.lower(x["scheme"]).alias("scheme"), x["query"].alias("query"), t.alias("tail"),
            F.when(t.startswith("//"), F.substring_index(F.substring(t, F.lit(3), F.length(t)), "/", 1)).alias("host")))

    def parts(x: Column) -> Column:
        return F.struct(
            x["scheme"].alias("scheme"), F.coalesce(x["host"], F.lit("")).alias("host"),
            F.when(x["host"].isNull(), x["tail"]).otherwise(
                F.substring(x["tail"], F.length(x["host"]) + 3, F.length(x["tail"]))).alias("path"),
            x["query"].alias("query"), x["host"].isNotNull().alias("has_host"))

    return bind(bind(bind(F.translate(strip(url), "\t\r\n", ""), cut), rest), parts)


def _decode(c: Column) -> Column:
    plain = F.replace(c, F.lit("+"), F.lit(" "))
    return F.coalesce(F.try_url_decode(c), plain)


def _encode(c: Column) -> Column:
    # the form encoder keeps '*' and escapes '~'; the canonical form does the opposite
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_query(query: Column, volatile_keys: Sequence[str] = V.VOLATILE_QUERY_KEYS) -> Column:
    """Drop volatile and blank parameters, sort the rest by (key, value)."""
    pairs = F.transform(F.split(query, "&"), lambda p: F.struct(
        _decode(F.substring_index(p, "=", 1)).alias("k"),
        F.when(F.contains(p, F.lit("=")),
               _decode(F.substring(p, F.instr(p, "=") + 1, F.length(p)))).alias("v")))
    kept = F.filter(pairs, lambda p: (F.coalesce(p["v"], F.lit("")) != "")
                    & ~F.array_contains(array_of(list(volatile_keys)), F.lower(p["k"])))
    encoded = F.transform(F.array_sort(kept), lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"])))
    return F.when(query == "", F.lit("")).otherwise(F.array_join(encoded, "&"))


def _canonical_but_scheme(volatile_keys: Sequence[str], index_files: Sequence[str]) -> str:
    """Pattern of addresses that ``normalize_url`` leaves as they are, http aside: one parameter at most, nothing to drop or decode."""
    def unless(words: Sequence[str], end: str) -> str:
        return f"(?!(?i:{'|'.join(map(re.escape, words))}){end})" if words else ""

    segment, plain = "[A-Za-z0-9_.~!$&'()*+,;=:@%-]", "[A-Za-z0-9_.~-]"
    last, first = unless(index_files, r"(?:\?|\z)"), unless(volatile_keys, "=")
    return rf"^https?://[a-z0-9.-]+/(?:{segment}++/)*+{last}{segment}*+(?:\?{first}{plain}++={plain}++)?\z"


def normalize_url(url: Column, volatile_keys: Sequence[str] = V.VOLATILE_QUERY_KEYS,
                  index_files: Sequence[str] = V.INDEX_FILENAMES) -> Column:
    """One spelling for all spellings of a page address.

    http and https count as the same; the fragment, the default port, a default
    index file, repeated slashes and volatile parameters are dropped.  A value
    that mixes valid and invalid percent escapes is kept undecoded.

    ``url`` is evaluated once.  Most addresses are canonical already, which one
    pattern tells; only the others are taken apart.
    """
    pattern = _canonical_but_scheme(volatile_keys, index_files)
    return bind(url, lambda u: F.when(u.isNull() | (u == ""), F.lit("")).when(u.rlike(pattern), F.when(
        u.startswith("https"), u).otherwise(F.concat(F.lit("https"), F.substring(u, F.lit(5), F.length(u))))).otherwise(
            _rebuilt_url(u, volatile_keys, index_files)))


def _rebuilt_url(url: Column, volatile_keys: Sequence[str], index_files: Sequence[str]) -> Column:
    """``normalize_url`` of an address that is neither NULL nor empty, from its parts."""
    def slashes(path: Column) -> Column:
        return F.when(F.contains(path, F.lit("//")), F.regexp_replace(path, "/{2,}", "/")).otherwise(path)

    def page(path: Column) -> Column:
        def cut(last: Column) -> Column:
            return F.when(F.lower(last).isin(list(index_files)),
                          F.substring(path, F.lit(1), F.length(path) - F.length(last))).otherwise(path)

        return bind(bind(F.substring_index(path, "/", -1), cut), lambda x: F.when(x == "", "/").otherwise(x))

    def port(host: Column) -> Column:
        return (F.when(host.endswith(":80"), F.substring(host, F.lit(1), F.length(host) - 3))
                .when(host.endswith(":443"), F.substring(host, F.lit(1), F.length(host) - 4)).otherwise(host))

    def build(p: Column) -> Column:
        return F.struct(
            F.when(p["scheme"].isin("", "http", "https"), "https").otherwise(p["scheme"]).alias("scheme"),
            bind(F.lower(p["host"]), port).alias("host"), bind(slashes(p["path"]), page).alias("path"),
            bind(p["query"], lambda q: canonical_query(q, volatile_keys)).alias("query"),
            (F.contains(p["host"], F.lit("[")) != F.contains(p["host"], F.lit("]"))).alias("broken"))

    def join(p: Column) -> Column:
        rooted = F.when(p["path"].startswith("/"), p["path"]).otherwise(F.concat(F.lit("/"), p["path"]))
        front = (F.when(p["host"] != "", F.concat(F.lit("//"), p["host"], rooted))
                 .when(p["path"].startswith("/") & (p["scheme"] == "https"), F.concat(F.lit("//"), p["path"]))
                 .otherwise(p["path"]))
        return F.when(p["broken"], strip(url)).otherwise(F.concat(
            p["scheme"], F.lit(":"), front, F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise("")))

    return bind(bind(split_url(url), build), join)


def remove_dot_segments(path: Column) -> Column:
    """Resolve '.' and '..' segments of an absolute path."""
    segments = F.split(F.substring(path, F.lit(2), F.length(path)), "/")
    last = F.element_at(segments, -1)
    kept = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
                        .when(s == ".", acc)
                        .otherwise(F.concat(acc, F.array(s))))
    out = F.concat(F.lit("/"), F.array_join(kept, "/"))
    # a trailing dot segment names a directory
    return F.when(last.isin(".", "..") & ~out.endswith("/"), F.concat(out, F.lit("/"))).otherwise(out)


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute address of ``href`` seen from the page ``base``; the page is not looked at for an absolute one."""
    return bind(href, lambda h: F.when(h.rlike(_ABSOLUTE), h).otherwise(bind(split_base(base), lambda b: resolve_from(b, h))))


def split_base(base: Column) -> Column:
    """A page address taken apart once for all its links."""
    return F.struct(split_url(base).alias("b"), strip(base).alias("base"))


def resolve_from(page: Column, href: Column) -> Column:
    """As ``resolve_url`` for a page address given by ``split_base``.

    ``href`` is evaluated once, and taken apart only if it is relative to the
    page's folder, has dot segments, or consists of more than plain characters.
    """
    def short(h: Column) -> Column:
        dotted = F.contains(h, F.lit("/.")) | F.contains(h, F.lit("./"))
        return (F.when(h.rlike(_ABSOLUTE), h)
                .when(h.rlike(_OTHER_HOST), F.concat(page["b"]["scheme"], F.lit(":"), h))
                .when(h.rlike(_ROOTED) & ~dotted, F.concat(page["b"]["scheme"], F.lit("://"), page["b"]["host"], h))
                .otherwise(_merged_url(page, h)))

    return bind(href, short)


def _merged_url(page: Column, href: Column) -> Column:
    """``resolve_from`` from the parts of both addresses."""
    def merge(x: Column) -> Column:
        b, h = page["b"], x["h"]
        name = F.substring_index(b["path"], "/", -1)
        folder = F.when(b["path"] == "", "/").otherwise(
            F.substring(b["path"], F.lit(1), F.length(b["path"]) - F.length(name)))
        path = F.when(h["path"].startswith("/"), h["path"]).otherwise(F.concat(folder, h["path"]))
        # what follows the path: query and fragment as written
        written = F.length(F.substring_index(F.substring_index(x["raw"], "#", 1), "?", 1))
        return F.struct(
            x["raw"].alias("raw"), h.alias("h"), path.alias("path"),
            F.concat(b["scheme"], F.lit("://"), b["host"]).alias("root"),
            F.substring(x["raw"], written + 1, F.length(x["raw"])).alias("tail"))

    def build(x: Column) -> Column:
        b, h, raw, path = page["b"], x["h"], x["raw"], x["path"]
        dotted = F.contains(path, F.lit("./")) | path.endswith("/.") | path.endswith("/..")
        clean = F.when(dotted, remove_dot_segments(path)).otherwise(path)
        base_query = F.when((h["query"] == "") & (b["query"] != ""), F.concat(F.lit("?"), b["query"])).otherwise("")
        return (F.when(raw == "", page["base"])
                .when((h["scheme"] != "") & (h["has_host"] | (h["scheme"] != b["scheme"])), raw)
                .when(h["has_host"], F.concat(b["scheme"], F.lit(":"), raw))
                .when(h["path"] == "", F.concat(x["root"], b["path"], base_query, x["tail"]))
                .otherwise(F.concat(x["root"], clean, x["tail"])))

    return bind(bind(F.struct(split_url(href).alias("h"), strip(href).alias("raw")), merge), build)
