"""Fetched pages: page addresses, decoding, outcomes, JSON bodies."""

from __future__ import annotations

import codecs

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeboard import fixed_values as V
from noticeboard.functions.dates import parse_date_text
from noticeboard.functions.text import bind, strip, squeeze
from noticeboard.functions.urls import resolve_from, resolve_url, split_base
from noticeboard.sources.rules import rule_problems


# --------------------------------------------------------------------------
# page addresses of a source, and how far they were read
# --------------------------------------------------------------------------
def page_frontier(rules: DataFrame) -> DataFrame:
    """One row per page to read: the rule's url, then its page pattern for 2..max_pages."""
    more = (F.coalesce("max_pages", F.lit(1)) > 1) & (F.coalesce("page_pattern", F.lit("")) != "")
    pages = F.when(more, F.sequence(F.lit(1), F.col("max_pages"))).otherwise(F.array(F.lit(1)))
    rows = rules.select("*", F.explode(pages).alias("page"))
    address = F.replace(F.col("page_pattern"), F.lit("{page}"), F.col("page").cast("string"))
    return rows.withColumn("page_url", F.when(F.col("page") == 1, F.col("url")).otherwise(
        resolve_url(F.col("url"), address)))


def first_failures(fetches: DataFrame, key: str = "rule_id", page: str = "page", failed: str = "failed") -> DataFrame:
    """First failed page of the sources that have one.

    An aggregate with a partial step, so a source with very many rows is not
    sorted in one task.
    """
    return fetches.filter(F.col(failed)).groupBy(key).agg(F.min(page).alias("first_failed"))


def before_failure(rows: DataFrame, failures: DataFrame, key: str = "rule_id", page: str = "page") -> DataFrame:
    """Rows of pages before the first failed page of their source.

    A plain join: the failures are small and broadcast where Spark's size limit
    allows, and adaptive execution splits a source with very many rows otherwise.
    """
    return rows.join(failures, key, "left").filter(
        F.col("first_failed").isNull() | (F.col(page) < F.col("first_failed"))).drop("first_failed")


def contiguous_prefix(fetches: DataFrame, key: str = "rule_id", page: str = "page", failed: str = "failed") -> DataFrame:
    """Pages before the first failed page of their source."""
    return before_failure(fetches, first_failures(fetches, key, page, failed), key, page)


# --------------------------------------------------------------------------
# bytes to text
# --------------------------------------------------------------------------
def _widened(charset: Column) -> Column:
    return F.when(charset.isin("gb2312", "gb_2312-80", "gbk"), "gb18030").otherwise(charset)


def declared_charset(content: Column, forced: Column, header: Column, head_bytes: int | None = None) -> Column:
    """Forced charset, else the first one of a meta tag, else the header's, else UTF-8.

    The whole content is searched unless ``head_bytes`` limits it.
    """
    head = F.decode(content if head_bytes is None else F.substring(content, 1, head_bytes), "ISO-8859-1")
    meta = F.nullif(F.lower(F.regexp_extract(head, V.META_CHARSET, 1)), F.lit(""))
    sent = F.lower(F.nullif(header, F.lit("")))
    sent = F.when(~sent.isin("iso-8859-1", "ascii"), sent)
    return F.coalesce(F.lower(F.nullif(forced, F.lit(""))), _widened(meta), _widened(sent), F.lit("utf-8"))


def _decode_others(content: pa.Array, charset: pa.Array) -> pa.Array:
    out = []
    for raw, name in zip(content.to_pylist(), charset.to_pylist()):
        if raw is None:
            out.append(None)
            continue
        try:
            codecs.lookup(name)
        except LookupError:
            name = "utf-8"
        out.append(raw.decode(name, errors="replace"))
    return pa.array(out, pa.string())


def decode_pages(pages: DataFrame, content: str = "content") -> DataFrame:
    """Add charset and html to rows of bytes; undecodable bytes become replacement marks.

    UTF-8, by far the most common, is decoded by Spark itself; only the rows of
    other charsets are handed to Python, in Arrow batches.
    """
    named = pages.withColumn("charset", declared_charset(
        F.col(content), F.col("forced_charset"), F.col("header_charset")))
    plain = F.col("charset").isin("utf-8", "utf8")
    other = F.arrow_udf(_decode_others, "string")(F.when(~plain, F.col(content)), F.col("charset"))
    return named.withColumn("html", F.coalesce(
        F.when(plain, F.make_valid_utf8(F.col(content).cast("string"))), other))


def page_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Pages stored one per file below ``path``: ``path, content, header_charset, forced_charset``.

    A byte order mark forces the charset it tells; otherwise ``decode_pages`` looks
    for a meta tag.  An empty file gives no row, since Spark's scan leaves it out.  Files are packed into tasks by size, whatever their folder.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    mark = F.hex(F.substring("content", 1, 3))
    told = (F.when(mark == "EFBBBF", "utf-8-sig").when(F.substring(mark, 1, 4).isin("FFFE", "FEFF"), "utf-16"))
    return files.select("path", "content", F.lit(None).cast("string").alias("header_charset"), told.alias("forced_charset"))


# --------------------------------------------------------------------------
# outcomes
# --------------------------------------------------------------------------
def fetch_outcome(kind: Column, status: Column, error: Column) -> Column:
    """NULL for success, else NOT_FOUND, BLOCKED or ERROR.

    A JSON endpoint reports every refused status as BLOCKED and does not
    recognise blocks that show only after retries.
    """
    is_json = kind.isin("json", "json_html")
    good = F.coalesce(status.between(200, 299), F.lit(False)) & (F.coalesce(error, F.lit("")) == "")
    return (F.when(good, F.lit(None).cast("string"))
            .when(is_json & status.isin(V.STATUS_REFUSED), "BLOCKED")
            .when(is_json, "ERROR")
            .when(status.isin(V.STATUS_NOT_FOUND), "NOT_FOUND")
            .when(status.isin(V.STATUS_REFUSED + V.STATUS_BLOCKED_AFTER_RETRY), "BLOCKED")
            .otherwise("ERROR"))


def source_results(rules: DataFrame, fetch_log: DataFrame, items: DataFrame) -> DataFrame:
    """One row per rule, whatever happened to it: status, items, error and its kind.

    ``fetch_log`` decides by the first page of a rule; ``items(rule_id, title,
    pos)`` are counted before the join, so a large source is one row in it.
    """
    # of several attempts the last one counts
    tried = ["kind", "http_status", "error"]
    when = F.struct("fetched_at") if "fetched_at" in fetch_log.columns else F.struct(F.lit(0))
    last = fetch_log.filter(F.col("page") == 1).groupBy("rule_id").agg(
        F.max_by(F.struct(*tried), F.struct(when, F.struct(*tried))).alias("_a")).select("rule_id", "_a.*")
    first = last.select(
        F.col("rule_id").alias("id"), F.lit(True).alias("_fetched"),
        fetch_outcome(F.col("kind"), F.col("http_status"), F.col("error")).alias("_outcome"),
        F.coalesce("error", F.concat(F.lit("HTTP "), F.col("http_status").cast("string"))).alias("_message"))
    counts = items.groupBy(F.col("rule_id").alias("id")).agg(
        F.count("*").alias("_n"), F.min_by("title", "pos").alias("_sample"))
    problems = rule_problems(F.col("url"), F.col("city"), F.col("source_name"), F.col("parser_type"))
    joined = rules.join(first, "id", "left").join(counts, "id", "left").withColumn("_problems", problems)
    kind = (F.when(F.size("_problems") > 0, "BAD_RULE")
            .when(F.col("_fetched").isNull(), "ERROR").otherwise(F.col("_outcome")))
    message = (F.when(F.size("_problems") > 0, F.array_join("_problems", "; "))
               .when(F.col("_fetched").isNull(), "not fetched").when(F.col("_outcome").isNotNull(), F.col("_message")))
    return joined.select(
        "id", "city", "source_name", F.when(kind.isNull(), "SUCCESS").otherwise("FAILED").alias("status"),
        F.when(kind.isNull(), F.coalesce("_n", F.lit(0))).otherwise(0).alias("items_found"),
        message.alias("error"), F.coalesce(kind, F.lit("")).alias("error_type"),
        F.when(kind.isNull(), F.col("_sample")).alias("sample_title"))


# --------------------------------------------------------------------------
# JSON bodies
# --------------------------------------------------------------------------
def _json_path(parts: Column) -> Column:
    return F.concat(F.lit("$"), F.array_join(F.transform(
        parts, lambda p: F.concat(F.lit("['"), p, F.lit("']"))), ""))


def _at(body: Column, path: Column) -> Column:
    return F.call_function("get_json_object", body, path)


def json_array_at(body: Column, dotted: Column) -> Column:
    """Elements, as JSON texts, of the first array met on a dotted path; empty when there is none."""
    parts = F.split(dotted, r"\.")

    # the text met so far gets shorter with every step, and the walk stops at an array
    def step(at: Column, part: Column) -> Column:
        return F.when(F.json_array_length(at).isNotNull(), at).otherwise(_at(at, _json_path(F.array(part))))

    met = F.aggregate(parts, body, step)
    return F.coalesce(F.from_json(F.when(F.json_array_length(met).isNotNull(), met), "array<string>"), F.array().cast("array<string>"))


def json_text_at(body: Column, dotted: Column) -> Column:
    """Text at a dotted path, NULL when there is none or it is blank."""
    return bind(_at(body, _json_path(F.split(dotted, r"\."))), lambda t: F.when(strip(t) != "", t))


def json_items(responses: DataFrame) -> DataFrame:
    """Notices of JSON listings ``(rule_id, url, body, json_path)``.

    Objects without a link or with a short title are left out; there is no link
    filter and no dedup on this kind of source.
    """
    key = {n: F.coalesce(F.col(f"json_path.{n}"), F.lit(d))
           for n, d in (("list", "data"), ("title", "title"), ("link", "url"), ("date", "date"))}
    # the page's address is taken apart once for all its rows
    rows = responses.withColumn("_page", split_base(F.col("url"))).select(
        "*", *[key[n].alias(f"_{n}") for n in ("title", "link", "date")],
        F.posexplode_outer(json_array_at(F.col("body"), key["list"])).alias("position", "_raw"))
    rows = rows.filter(F.col("_raw").startswith("{")).withColumn("_map", F.from_json("_raw", "map<string,string>"))

    def field(name: str) -> Column:
        return strip(F.coalesce(F.try_element_at("_map", F.col(name)), F.lit("")))

    found = rows.withColumns({"_t": field("_title"), "_h": field("_link"), "_d": field("_date")})
    page = ["page"] if "page" in responses.columns else []
    return found.filter((F.length("_t") >= V.RULE_MIN_TITLE_CHARS) & (F.col("_h") != "")).select(
        "rule_id", *page, "position", squeeze(F.col("_t")).alias("title"), resolve_from(F.col("_page"), F.col("_h")).alias("url"),
        parse_date_text(F.col("_d")).alias("publish_date"))


def json_html_pages(responses: DataFrame) -> DataFrame:
    """JSON responses that carry a listing as HTML text, as pages of their rule."""
    path = F.coalesce(F.col("json_path.html"), F.lit("data.html"))
    page = F.col("page") if "page" in responses.columns else F.lit(1)
    return responses.select("rule_id", "url", page.alias("page"), json_text_at(F.col("body"), path).alias("html")).filter(
        F.col("html").isNotNull())
