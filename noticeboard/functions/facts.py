"""Facts in the text of a notice: deadline, amount, audience, age, channel, summary.

Each fact is a chain of patterns; the first that gives a value wins.  The
patterns read the ``dense`` text, in which long stretches of other scripts are
cut, and every pattern needs one of a few literal words, so a plain substring
test spares most rows the regular expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeboard import fixed_values as V
from noticeboard.functions.dates import checked_iso
from noticeboard.functions.text import bind, contains_any, dense, first_by, group, strip, to_int
from noticeboard.functions.titles import joined_labels


def clean_text(text: Column) -> Column:
    blanks = F.regexp_replace(text, "[ \\t\\x{3000}]+", " ")
    return strip(F.regexp_replace(blanks, "\n{2,}", "\n"))


def _hit(text: Column, pattern: str, words: list[str]) -> Column:
    """First match of the pattern, looked for only where one of the words occurs."""
    return F.when(contains_any(text, words), group(text, pattern, 0))


def _hits(text: Column, pattern: str, words: list[str]) -> Column:
    return F.when(contains_any(text, words), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(
        F.array().cast("array<string>"))


def _where_word(text: Column, words: list[str]) -> Column:
    """The text itself where a word occurs: the pattern looks ahead past its match."""
    return F.when(contains_any(text, words), text)


def chinese_to_int(text: Column) -> Column:
    """0 to 99 in Chinese numerals; NULL when it is not one."""
    table = F.create_map(*[x for k, v in V.CHINESE_DIGITS.items() for x in (F.lit(k), F.lit(v))])
    tens, ones = F.split_part(text, F.lit("十"), F.lit(1)), F.split_part(text, F.lit("十"), F.lit(2))
    tens_value = F.when(tens == "", 1).otherwise(F.coalesce(F.element_at(table, tens), F.lit(1)))
    ones_value = F.when(ones == "", 0).otherwise(F.coalesce(F.element_at(table, ones), F.lit(0)))
    return F.coalesce(F.element_at(table, text),
                      F.when(F.contains(text, F.lit("十")), tens_value * 10 + ones_value))


def _spoken_number(text: Column) -> Column:
    """Digits as they are, Chinese numerals as digits; zero and non-numerals unchanged."""
    value = chinese_to_int(text)
    return F.when(text.rlike("^[0-9]+$"), text).otherwise(
        F.coalesce(F.when(value != 0, value.cast("string")), text))


def _iso_of(hit: Column, pattern: str, first: int) -> Column:
    return checked_iso(*[to_int(group(hit, pattern, first + i)) for i in range(3)], first_year=0)


def deadline(text: Column) -> Column:
    """Explicit end date, date range, month-day range with a year, or relative period."""
    return bind(dense(text), _deadline)


def _deadline(text: Column) -> Column:
    def explicit(pattern: str, words: list[str]) -> Column:
        return bind(_hit(text, pattern, words),
                    lambda h: F.concat(_iso_of(h, pattern, 1), F.lit(" 截止")))

    def full_range(h: Column) -> Column:
        return F.concat(_iso_of(h, V.DEADLINE_RANGE, 1), F.lit(" 至 "), _iso_of(h, V.DEADLINE_RANGE, 4))

    def short_range(x: Column) -> Column:
        year = to_int(group(x["year"], V.YEAR_IN_TEXT, 1))
        part = [to_int(group(x["hit"], V.DEADLINE_MD_RANGE, i)) for i in (1, 2, 3, 4)]
        return F.concat(checked_iso(year, part[0], part[1]), F.lit(" 至 "), checked_iso(year, part[2], part[3]))

    def relative(h: Column) -> Column:
        return F.concat(F.lit("公告发布起 "), _spoken_number(group(h, V.DEADLINE_RELATIVE, 1)), F.lit(" "),
                        group(h, V.DEADLINE_RELATIVE, 2), F.lit("内"))

    first, second, third = V.DEADLINE_EXPLICIT
    joints = ["至", "到", "—", "-", "~"]
    short_hit = _hit(text, V.DEADLINE_MD_RANGE, joints)
    return F.coalesce(
        explicit(first, ["截止", "结束"]),
        explicit(second, ["截止", "不得晚于", "不迟于"]),
        explicit(third, ["前"]),
        bind(_hit(text, V.DEADLINE_RANGE, joints), full_range),
        bind(F.struct(short_hit.alias("hit"), _hit(text, V.YEAR_IN_TEXT, ["年"]).alias("year")), short_range),
        bind(_hit(text, V.DEADLINE_RELATIVE, ["起"]), relative))


def _unit(hit_unit: Column) -> Column:
    return F.when(hit_unit.isin("万元", "万"), "万元").otherwise("元")


def tiered_amount(text: Column, max_parts: int | None = None) -> Column:
    """'degree number unit' parts when at least two are listed; ``max_parts`` cuts them for display."""
    return bind(dense(text), lambda t: _tiered_amount(t, max_parts))


def _tiered_amount(text: Column, max_parts: int | None = None) -> Column:
    def parts(hits: Column) -> Column:
        rows = F.transform(_first(hits, max_parts), lambda h: F.struct(
            F.concat_ws(" ", group(h, V.TIERED_AMOUNT, 1), group(h, V.TIERED_AMOUNT, 2)).alias("key"),
            F.concat(group(h, V.TIERED_AMOUNT, 1), group(h, V.TIERED_AMOUNT, 2),
                     _unit(group(h, V.TIERED_AMOUNT, 3))).alias("label")))
        return F.array_join(F.transform(first_by(rows, "key"), lambda x: x["label"]), " / ")

    return bind(_hits(text, V.TIERED_AMOUNT, ["元", "万"]), lambda h: F.when(F.size(h) >= 2, parts(h)))


def _single_amount(text: Column, pattern: str, words: list[str], prefix: str, plain_unit: bool = False) -> Column:
    def build(h: Column) -> Column:
        unit = group(h, pattern, 2)
        return F.concat(F.lit(prefix), group(h, pattern, 1), F.lit(" "), unit if plain_unit else _unit(unit))

    return bind(_hit(text, pattern, words), build)


def quotas(text: Column) -> Column:
    """Array of 'number of homes' parts, one per unit in order of first appearance."""
    return bind(dense(text), _quotas)


def _quotas(text: Column) -> Column:
    def build(hits: Column) -> Column:
        rows = F.transform(hits, lambda h: F.struct(
            group(h, V.QUOTA, 2).alias("unit"), group(h, V.QUOTA, 1).cast("long").alias("n")))
        return bind(rows, lambda r: F.transform(
            F.array_distinct(F.transform(r, lambda x: x["unit"])),
            lambda u: F.concat(F.lit("房源 "), F.aggregate(
                F.filter(r, lambda x: x["unit"] == u), F.lit(0).cast("long"), lambda acc, x: acc + x["n"]).cast("string"),
                F.lit(" "), u)))

    return bind(_hits(text, V.QUOTA, ["套", "间", "户"]), build)


def _first(items: Column, n: int | None) -> Column:
    return items if n is None else F.slice(items, 1, n)


def amount(text: Column, max_parts: int | None = None) -> Column:
    """The first kind of amount found, then home quotas; ``max_parts`` cuts them for display."""
    return bind(dense(text), lambda t: _amount(t, max_parts))


def _amount(text: Column, max_parts: int | None = None) -> Column:
    money = F.coalesce(
        _tiered_amount(text),
        _single_amount(text, V.MONTHLY_AMOUNT, ["月"], "每月 ", plain_unit=True),
        _single_amount(text, V.ONE_OFF_AMOUNT, ["一次性", "共计", "合计", "总额"], "一次性 "),
        _single_amount(text, V.GENERIC_AMOUNT, ["补贴", "补助", "资助", "奖励"], ""))
    parts = F.concat(F.array_compact(F.array(money)), _quotas(text))
    return bind(parts, lambda p: F.when(F.size(p) > 0, F.array_join(_first(p, max_parts), " ｜ ")))


def audience(text: Column, title: Column, head_chars: int | None = None, max_labels: int | None = None) -> Column:
    """Degree and identity labels over title and text.

    The whole text counts unless ``head_chars`` limits it; ``max_labels`` cuts the labels for display.
    """
    body = text if head_chars is None else F.substring(text, 1, head_chars)
    return _audience(dense(body), title, max_labels)


def _audience(body: Column, title: Column, max_labels: int | None = None) -> Column:
    combined = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), body)

    def build(c: Column) -> Column:
        within = bind(_hit(c, V.GRADUATED_WITHIN, ["毕业"]), lambda h: F.concat(
            F.lit("毕业"), _spoken_number(group(h, V.GRADUATED_WITHIN, 1)), F.lit("年内")))
        labels = F.array_distinct(F.concat(joined_labels(c, V.AUDIENCE_PATTERNS), F.array_compact(F.array(within))))
        return bind(labels, lambda x: F.when(
            F.size(x) > 0, F.array_join(_first(x, max_labels), " / ")))

    return bind(combined, build)


def age_limit(text: Column) -> Column:
    return bind(dense(text), _age_limit)


def _age_limit(text: Column) -> Column:
    def below(pattern: str, words: list[str]) -> Column:
        return F.concat(group(_where_word(text, words), pattern, 1), F.lit("周岁以下"))

    between = bind(_hit(text, V.AGE_BETWEEN, ["年龄"]), lambda h: F.concat(
        group(h, V.AGE_BETWEEN, 1), F.lit("-"), group(h, V.AGE_BETWEEN, 2), F.lit("周岁")))
    return F.coalesce(below(V.AGE_BELOW, ["年龄"]), below(V.AGE_NOT_OVER, ["不超过", "未满", "不满"]), between)


def apply_channel(text: Column) -> Column:
    """First address unless it names an asset file, else a named platform."""
    return bind(F.struct(text.alias("whole"), dense(text).alias("dense")), lambda x: _apply_channel(x["whole"], x["dense"]))


def _apply_channel(whole: Column, text: Column) -> Column:
    url = bind(_hit(whole, V.CHANNEL_URL, ["http"]), lambda h: F.regexp_replace(h, "[.,;]+$", ""))
    named = strip(group(_where_word(text, ["登录", "登陆", "通过", "进入", "访问"]), V.CHANNEL_NAME, 1))
    return F.coalesce(bind(url, lambda u: F.when(~u.rlike(V.CHANNEL_ASSET), u)), named)


def summary(text: Column, max_chars: int | None = None) -> Column:
    """First line with substance; ``max_chars`` cuts it for display."""
    lines = F.transform(F.split(text, "\n"), strip)
    good = F.filter(lines, lambda x: (F.length(x) >= V.SUMMARY_MIN_CHARS)
                    & ~x.rlike(V.SUMMARY_DOC_NUMBER) & ~x.rlike(V.SUMMARY_BOILERPLATE))
    first = F.get(good, F.lit(0))
    return first if max_chars is None else bind(first, lambda x: F.when(
        F.length(x) > max_chars, F.concat(F.substring(x, 1, max_chars), F.lit("…"))).otherwise(x))


def facts(text: Column, title: Column, thin: Column | None = None, head: Column | None = None) -> dict[str, Column]:
    """The value of every fact.  ``thin`` is the dense text, ``head`` the part of it the audience is read from."""
    thin = dense(text) if thin is None else thin
    return {
        "deadline": _deadline(thin),
        "amount_or_quota": _amount(thin),
        "target_audience": _audience(thin if head is None else head, title),
        "age_limit": _age_limit(thin),
        "apply_channel": _apply_channel(text, thin),
        "raw_content": summary(text),
    }


def apply_facts(notices: DataFrame, text: str = "main_text", head_chars: int | None = None) -> DataFrame:
    """Overwrite fields with facts found in the text; short texts change nothing."""
    usable = F.coalesce(F.length(text) >= V.MIN_DETAIL_CHARS, F.lit(False))
    known = notices.withColumn("_body", F.when(usable, F.col(text))).withColumn("_dense", dense(F.col("_body")))
    head = None if head_chars is None else dense(F.substring("_body", 1, head_chars))
    found = facts(F.col("_body"), F.col("title"), F.col("_dense"), head)
    return known.withColumns({
        **{name: F.coalesce(value, F.col(name)) for name, value in found.items()},
        "detail_fetched": F.col("_body").isNotNull() | F.col("detail_fetched"),
    }).drop("_body", "_dense")
