"""Rules: loading, checking, storing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeboard import fixed_values as V
from noticeboard.functions.selectors import is_supported
from noticeboard.schemas import RULE


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from a YAML file (one mapping with the list ``rules``), from JSON lines (``.jsonl``) or from JSON documents.

    A rule file is configuration written by hand, so YAML is read where the job starts.
    """
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:  # optional dependency
            raise RuntimeError("reading YAML rules needs PyYAML; JSON rules need nothing") from e
        with open(path, encoding="utf-8") as f:
            data = yaml.safe_load(f) or {}
        rows = [_plain(r) for r in data.get("rules", []) if isinstance(r, dict)]
        return spark.createDataFrame(rows, RULE)
    return spark.read.schema(RULE).json(path, multiLine=not path.rstrip("/").endswith(".jsonl"))


def _plain(rule: dict) -> dict:
    text = {k: None if v is None else str(v) for k, v in rule.items() if not isinstance(v, (dict, bool, int))}
    out = {**rule, **text}
    for name in ("params", "json_path", "selectors"):
        if isinstance(rule.get(name), dict):
            out[name] = {k: None if v is None else str(v) for k, v in rule[name].items()}
    return out


def rule_problems(url: Column, city: Column, source_name: Column, parser_type: Column) -> Column:
    """Array of problems of a rule, empty when it is valid."""
    def missing(c: Column) -> Column:
        return F.coalesce(c, F.lit("")) == ""

    kind = F.lower(F.coalesce(parser_type, F.lit("html")))
    return F.array_compact(F.array(
        F.when(missing(url), V.PROBLEM_NO_URL)
         .when(~url.startswith("http://") & ~url.startswith("https://"), F.concat(F.lit(V.PROBLEM_URL_SCHEME), url)),
        F.when(missing(city), V.PROBLEM_NO_CITY),
        F.when(missing(source_name), V.PROBLEM_NO_SOURCE),
        F.when(~kind.isin(V.PARSER_TYPES), F.concat(F.lit(V.PROBLEM_PARSER), kind))))


def selector_problems(selectors: Column) -> Column:
    """Array of problems of a rule's selectors: those that cannot be read, which match nothing.

    Such a rule is not refused: its pages are read by the list finder.
    """
    names = ["list_item", "title", "link", "date"]
    return F.array_compact(F.array(*[F.when(~is_supported(selectors[n]), F.concat(
        F.lit(f"{n}: "), selectors[n])) for n in names]))


def check_rules(rules: DataFrame) -> DataFrame:
    """Add ``problems``, which refuse a rule, and ``selector_problems``, which do not, if the rules have selectors."""
    checked = rules.withColumn("problems", rule_problems(
        F.col("url"), F.col("city"), F.col("source_name"), F.col("parser_type")))
    return checked.withColumn("selector_problems", selector_problems(F.col("selectors"))) if "selectors" in rules.columns else checked


def upsert_rules(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply changed rules by url: the first rule of a url is updated and keeps its id, others are added.

    ``rules`` and ``changes`` have the columns ``pos`` and ``id`` besides the
    fields; the last change of a url wins.  An added rule is named after its
    position behind the stored rules, so no global numbering is needed.
    """
    fields = [c for c in rules.columns if c not in ("pos", "id", "url")]
    last = changes.groupBy("url").agg(
        F.min("pos").alias("new_pos"), F.max_by(F.struct(*fields), "pos").alias("new"))
    target = rules.groupBy("url").agg(F.min("pos").alias("pos"))
    todo = last.join(target, "url", "left")
    size = rules.agg(F.count("*").alias("n"))

    def name(number: Column, city: Column) -> Column:
        return F.concat(F.lit("rule_"), number.cast("string"), F.lit("_"), city)

    updates = todo.filter(F.col("pos").isNotNull()).select("pos", "new")
    updated = rules.join(updates, "pos", "left").withColumn("n", size.scalar()).select(
        "pos", F.coalesce("id", F.when(F.col("new").isNotNull(), name(F.col("n"), F.col("new.city")))).alias("id"), "url",
        *[F.when(F.col("new").isNull(), F.col(f)).otherwise(F.coalesce(f"new.{f}", f)).alias(f) for f in fields])
    added = todo.filter(F.col("pos").isNull()).withColumn("n", size.scalar()).select(
        (F.col("n") + F.col("new_pos")).cast("long").alias("pos"),
        name(F.col("n") + F.col("new_pos"), F.col("new.city")).alias("id"), "url", *[F.col(f"new.{f}").alias(f) for f in fields])
    return updated.unionByName(added)


def delete_rule(rules: DataFrame, rule_id: str) -> DataFrame:
    """Rules without the given one; an unknown id is an error."""
    if rules.filter(F.col("id") == rule_id).isEmpty():
        raise KeyError(f"no such rule: {rule_id}")
    return rules.filter(~F.col("id").eqNullSafe(rule_id))


def delete_rules(rules: DataFrame, ids: DataFrame) -> DataFrame:
    return rules.join(ids.select("id").distinct(), "id", "left_anti").select(*rules.columns)


def unknown_ids(rules: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("id").distinct().join(rules.select("id"), "id", "left_anti")
