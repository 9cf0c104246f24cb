"""Catalogue of official sources by city."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeboard import fixed_values as V
from noticeboard.functions.text import strip, substrings

SOURCE_COLUMNS = ["type", "tag", "title", "source_name", "url", "desc", "list_item", "verified"]


def contains_pairs(texts: DataFrame, text: str, parts: DataFrame, part: str) -> DataFrame:
    """Distinct pairs where the text contains the part.

    The substrings of the short texts are joined on equality; comparing every
    text with every part would not scale in either side.
    """
    t = texts.select(text).distinct().filter(F.col(text) != "")
    p = parts.select(part).distinct().filter(F.col(part) != "")
    pieces = _no_longer(t, p, part).select(text, F.explode(substrings(F.col(text), F.col("_longest"))).alias("_piece"))
    return pieces.join(p, F.col("_piece") == F.col(part)).select(text, part)


def _no_longer(texts: DataFrame, parts: DataFrame, part: str) -> DataFrame:
    """The texts with ``_longest``, the length of the longest part; longer substrings match nothing."""
    return texts.withColumn("_longest", parts.agg(F.max(F.length(part))).scalar()).filter(F.col("_longest") > 0)


def clean_region(region: Column) -> Column:
    out = strip(region)
    for s in V.REGION_SUFFIXES:
        out = F.replace(out, F.lit(s), F.lit(""))
    return out


def resolve_sources(regions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Candidate sources per distinct region name.

    The first catalogue city that contains the cleaned name or is contained in
    it decides; a region without one gets three rows without url to fill in.
    """
    names = regions.select(F.coalesce("region", F.lit("")).alias("region")).distinct().withColumn(
        "clean", clean_region(F.col("region")))
    cities = catalog.groupBy("city").agg(F.min("pos").alias("city_pos"))
    inside = contains_pairs(names, "clean", cities, "city")
    around = contains_pairs(cities, "city", names, "clean")
    hits = inside.unionByName(around.select("clean", "city")).join(cities, "city")
    best = hits.groupBy("clean").agg(F.min_by("city", "city_pos").alias("city"))
    # a name of suffixes only is part of every city: the first one
    first_city = cities.agg(F.min_by("city", "city_pos").alias("first_city"))
    matched = names.filter(strip(F.col("region")) != "").join(best, "clean", "left").select(
        "region", F.when(F.col("clean") == "", first_city.scalar()).otherwise(F.col("city")).alias("city"))
    found = matched.filter(F.col("city").isNotNull()).join(catalog, "city").select(
        "region", F.lit(True).alias("listed"), F.col("pos").cast("int").alias("ord"), *SOURCE_COLUMNS)
    unlisted = names.join(matched.filter(F.col("city").isNotNull()), "region", "left_anti")
    label = F.when(strip(F.col("region")) == "", "未指定区域").otherwise(strip(F.col("region")))
    rows = F.array(*[F.struct(
        F.lit(i).alias("ord"), F.lit(kind).alias("type"), F.lit(V.PLACEHOLDER_TAG).alias("tag"),
        F.format_string(title, label).alias("title"), F.format_string(source, label).alias("source_name"),
        F.lit("").alias("url"), F.format_string(desc, label).alias("desc"),
        F.lit(V.DEFAULT_LIST_ITEM).alias("list_item"), F.lit(False).alias("verified"))
        for i, (kind, title, source, desc) in enumerate(V.PLACEHOLDERS)])
    empty = unlisted.select("region", F.lit(False).alias("listed"), F.inline(rows))
    return found.unionByName(empty)


def preset_source(candidates: DataFrame) -> DataFrame:
    """First candidate of every region."""
    rest = [c for c in candidates.columns if c != "region"]
    return candidates.groupBy("region").agg(F.min_by(F.struct(*rest), "ord").alias("_c")).select("region", "_c.*")


def synthesize_rules(candidates: DataFrame) -> DataFrame:
    """Rules for the regions of candidate sources; candidates without url give none."""
    return candidates.filter(F.coalesce("url", F.lit("")) != "").select(
        F.concat(F.lit("dyn_"), "region", F.lit("_"), "type").alias("id"), F.col("region").alias("city"),
        F.lit(V.WHOLE_CITY).alias("district"), "source_name", F.col("type").alias("category"), "url",
        F.lit("html").alias("parser_type"), F.struct(
            F.coalesce("list_item", F.lit("ul li")).alias("list_item"), F.lit("a").alias("title"),
            F.lit("a").alias("link"), F.lit("span").alias("date")).alias("selectors"))


def subscriptions_without_rule(subscriptions: DataFrame, rules: DataFrame) -> DataFrame:
    """Subscribed cities that no rule's city contains."""
    cities = _no_longer(rules.select("city").distinct(), subscriptions, "city")
    covered = cities.select(F.explode(substrings(F.col("city"), F.col("_longest"))).alias("city")).distinct()
    return subscriptions.select("city").distinct().join(covered, "city", "left_anti")


def audit(catalog: DataFrame, hints: DataFrame) -> DataFrame:
    """Catalogue rows whose url has none of the domain hints of its city, or names no right department.

    ``hints(city, type, hint)``: a hint without type is a domain, one with a type
    names a department for sources of that type; a hint without city is for all
    cities.  Sources of a type that no hint names have no department to name.
    """
    rows = catalog.filter(F.coalesce("url", F.lit("")) != "").select("city", "type", "source_name", "url")
    given = hints.select(F.col("city").alias("_city"), F.col("type").alias("_type"), "hint")
    # hints for all cities are a short list: one array
    anywhere = given.filter(F.col("_city").isNull()).agg(F.collect_set(F.struct("_type", "hint"))).scalar()

    def unmet(left: DataFrame, by_type: bool) -> DataFrame:
        kind = F.col("_type").isNotNull() if by_type else F.col("_type").isNull()
        at_city = [F.col("city") == F.col("_city"), F.contains("url", F.col("hint"))] + [
            F.col("type") == F.col("_type")] * by_type
        here = left.join(given.filter(kind & F.col("_city").isNotNull()), at_city, "left_anti")
        return here.withColumn("_all", anywhere).filter(~F.exists("_all", lambda h: F.coalesce(
            (h["_type"] == F.col("type")) if by_type else h["_type"].isNull(), F.lit(False)) & F.contains("url", h["hint"]))).drop("_all")

    typed = rows.join(given.filter(F.col("_type").isNotNull()).select(F.col("_type").alias("type")).distinct(), "type", "left_semi")
    return unmet(rows, False).withColumn("problem", F.lit("domain")).unionByName(
        unmet(typed, True).withColumn("problem", F.lit("department")))
