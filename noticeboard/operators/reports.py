"""Small reports over the ledger, rules and trial runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeboard import fixed_values as V


def count_by_state(ledger: DataFrame) -> DataFrame:
    """One row with a count for each of the four states, zero included."""
    return ledger.agg(*[F.count_if(F.col("state") == s).alias(n) for s, n in V.STATE_NAMES.items()])


def ledger_stats(ledger: DataFrame, today: Column) -> DataFrame:
    """Totals and counts by state; distinct cities are counted after a partial distinct."""
    cities = ledger.select("city").distinct().agg(F.count("city").alias("active_cities"))
    counts = ledger.agg(
        F.count("*").alias("total_policies"),
        F.count_if(F.to_date("first_seen_at") == today).alias("today_count"),
        *[F.count_if(F.col("state") == s).alias(n) for s, n in V.STATE_NAMES.items()])
    return counts.withColumn("active_cities", cities.scalar())


def dashboard(ledger: DataFrame, rules: DataFrame, health: DataFrame, today: Column) -> DataFrame:
    """Ledger stats, number of rules and broken sources, overall status."""
    rule_count = rules.agg(F.count("*").alias("total_rules"))
    broken = health.agg(F.count_if("is_broken").alias("broken_sources"))
    counted = ledger_stats(ledger, today).withColumns(
        {"total_rules": rule_count.scalar(), "broken_sources": broken.scalar()})
    return counted.withColumn(
        "status", F.when(F.col("broken_sources") == 0, "Healthy").otherwise("Degraded"))


def rule_trial(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Per rule: items found, items relevant, whether the heuristic was used, and a hint.

    ``items(rule_id, reason, from_fallback)`` has one row per found item.
    """
    counts = items.groupBy("rule_id").agg(
        F.count("*").alias("total_raw"), F.count_if(F.col("reason") == "kept").alias("total_matched"),
        F.bool_or("from_fallback").alias("used_fallback"))
    raw, hit = F.coalesce("total_raw", F.lit(0)), F.coalesce("total_matched", F.lit(0))
    hint = (F.when(raw == 0, V.HINT_NO_ROWS)
            .when(hit == 0, F.format_string(V.HINT_NO_MATCH, raw))
            .otherwise(F.format_string(V.HINT_OK, raw, hit)))
    return rules.select("rule_id").join(counts, "rule_id", "left").select(
        "rule_id", raw.alias("total_raw"), hit.alias("total_matched"),
        F.coalesce("used_fallback", F.lit(False)).alias("used_fallback"), hint.alias("hint"))


def city_list(rules: DataFrame, position: str) -> DataFrame:
    """Cities in order of first appearance, after the entry for all cities."""
    first = rules.filter(F.coalesce("city", F.lit("")) != "").groupBy("city").agg(F.min(position).alias("pos"))
    everything = rules.sparkSession.range(1).select(F.lit(V.ALL_CITIES).alias("city"), F.lit(-1).cast("long").alias("pos"))
    return everything.unionByName(first.select("city", F.col("pos").cast("long").alias("pos"))).orderBy("pos")


def _known(c: str, unknown: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")).isin("", unknown) == F.lit(False)


def _some(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def _digest_lines(style: str) -> Column:
    place = F.concat(F.col("city"), F.lit("·"), F.col("district"))

    def opt(condition: Column, *parts: Column | str) -> Column:
        return F.when(condition, F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))

    always = F.lit(True)
    if style == "markdown":
        lines = [
            opt(always, "### 📍 [", place, "] ", F.col("title")),
            opt(always, "- **发布单位**: ", F.col("source_name")),
            opt(_some("publish_date"), "- **发布时间**: ", F.col("publish_date")),
            opt(_known("deadline", V.DEADLINE_UNKNOWN), "- **⏰ 申报期限**: ", F.col("deadline")),
            opt(always, "- **适合人群**: ", F.col("target_audience")),
            opt(_some("amount_or_quota"), "- **额度/房源**: ", F.col("amount_or_quota")),
            opt(_some("age_limit"), "- **年龄要求**: ", F.col("age_limit")),
            opt(always, "- **原文链接**: [点击查看官方公告](", F.col("url"), ")"),
            F.lit(""), F.lit("---"), F.lit(""),
        ]
    elif style == "plain":
        lines = [
            opt(always, "[", F.col("pos").cast("string"), "] ", place, " ", F.col("title")),
            opt(always, "    发布单位: ", F.col("source_name")),
            opt(_some("publish_date"), "    发布时间: ", F.col("publish_date")),
            opt(_known("deadline", V.DEADLINE_UNKNOWN), "    申报期限: ", F.col("deadline")),
            opt(always, "    适合人群: ", F.col("target_audience")),
            opt(_some("amount_or_quota"), "    额度/房源: ", F.col("amount_or_quota")),
            opt(_some("age_limit"), "    年龄要求: ", F.col("age_limit")),
            opt(always, "    原文链接: ", F.col("url")),
            F.lit(""),
        ]
    elif style == "wecom":
        lines = [
            opt(always, "**[", place, "]** [", F.col("title"), "](", F.col("url"), ")"),
            opt(_known("deadline", V.DEADLINE_UNKNOWN), '> ⏰ 期限: <font color="warning">', F.col("deadline"), "</font>"),
            opt(always, "> 👥 ", F.col("target_audience")),
            opt(_some("amount_or_quota"), "> 🎯 ", F.col("amount_or_quota")),
            F.lit(""),
        ]
    else:
        raise ValueError(f"unknown digest style: {style}")
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def cut_to_bytes(text: Column, max_bytes: int) -> Column:
    """Longest run of whole characters within the byte limit, with a note when cut."""
    cut = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, max_bytes).cast("string"))
    # a character split at the limit shows as one replacement mark at the end
    cut = F.regexp_replace(cut, "\\x{FFFD}+$", "")
    return F.when(F.octet_length(text) > max_bytes, F.concat(cut, F.lit("\n\n…（内容过长已截断）"))).otherwise(text)


def _cut(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.substring(text, 1, chars)


def digest(batches: DataFrame, style: str = "markdown", header: str = "新政策", headline_chars: int | None = None,
           max_cities: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Message text and subject parts per batch; ``pos`` orders the notices of a batch.

    ``header`` heads the short variant.  Nothing is cut unless the last three
    parameters ask for it: characters of the headline, cities of the subject and
    bytes of the short variant.  A batch is one message, as large as its queue's limit made it.
    """
    rows = batches.withColumn("_text", _digest_lines(style))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "_text", "city", "title")))
    out = rows.groupBy("batch_id").agg(ordered.alias("_rows")).select(
        "batch_id", F.size("_rows").alias("n"),
        F.array_join(F.transform("_rows", lambda x: x["_text"]), "\n").alias("body"),
        F.array_distinct(F.filter(F.transform("_rows", lambda x: x["city"]), lambda c: c != "")).alias("_cities"),
        _cut(F.get("_rows", F.lit(0))["title"], headline_chars).alias("headline"))
    if style == "wecom":
        header = F.concat(F.lit(f"### 🏠 {header} · "), F.col("n").cast("string"), F.lit(" 条新动态\n\n"))
        out = out.withColumn("body", F.concat(header, "body"))
        if max_bytes is not None:
            out = out.withColumn("body", cut_to_bytes(F.col("body"), max_bytes))
    label = F.array_join("_cities", "/") if max_cities is None else F.concat(
        F.array_join(F.slice("_cities", 1, max_cities), "/"), F.when(F.size("_cities") > max_cities, "等").otherwise(""))
    return out.select("batch_id", F.col("n").cast("int").alias("n"), "body", F.concat(
        F.lit("【政策速递】"), label, F.lit(" "), F.col("n").cast("string"), F.lit(" 条新政策 · "), "headline", F.lit("" if headline_chars is None else "…")
    ).alias("subject"))
