"""Mixing sources to target weights by hierarchical budgets.

A budget of tokens is passed down a tree of domain, language and source.  A
node that cannot fill its share gives the shortage to its siblings, and only
what no sibling can take is missing above.  Each leaf then takes a prefix of
tokens from seeded epochs: shuffles of its documents, one after the other.
DataFrame functions only.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeboard.llm.common import written

LEVELS = ("domain", "language", "origin")
NONE = "none"        # name of a null language or source


@dataclass(frozen=True)
class Plan:
    """Target weights are whole numbers; names that are not listed weigh ``other``."""
    budget_share: float = 0.6            # of all tokens
    max_epochs: int = 2
    seed: int = 17
    domains: Mapping[str, int] = field(default_factory=lambda: {"crawl": 40, "reference": 35, "forum": 25})
    languages: Mapping[str, int] = field(default_factory=lambda: {"en": 50, "de": 20, "fr": 20, "es": 10})
    sources: Mapping[str, int] = field(default_factory=dict)
    other: int = 10


def domain_of(source: Column) -> Column:
    """The default tree: source 0 is the crawl, odd numbers are reference works, the rest forums."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(number == "", NONE).when(number == "0", "crawl").when(
        number.cast("int") % 2 == 1, "reference").otherwise("forum")


def tokens_of(text: Column) -> Column:
    """Runs of characters other than blank, tab and line ends."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\r\n]+")), F.lit(0)).cast("long")


def _placed(docs: DataFrame) -> list[Column]:
    origin = F.coalesce("source", F.lit(NONE))
    return [domain_of(origin).alias("domain"), F.coalesce("lang", F.lit(NONE)).alias("language"), origin.alias("origin")]


def _weight(name: Column, weights: Mapping[str, int], other: int) -> Column:
    out = F.lit(other)
    for key, value in weights.items():
        out = F.when(name == key, value).otherwise(out)
    return out.cast("long")


def _filled(children: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Budgets of siblings: children(parent.., name, capacity, weight, total) -> (.., budget).

    Siblings in order of capacity per weight: while the next one's capacity does
    not reach its share of what is left, it is given all of it; the others share
    the rest by weight, rounded down.
    """
    group = Window.partitionBy(*parent)
    order = group.orderBy(F.col("capacity") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    taken = F.coalesce(F.sum("capacity").over(before), F.lit(0))
    ranked = children.filter(F.col("weight") > 0).withColumn("_full", F.col("capacity") * F.sum("weight").over(after)
                                                             <= F.col("weight") * (F.col("total") - taken))
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("capacity"))).over(group), F.lit(0))
    open_weight = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(group)
    whole = F.expr("(_rest * weight) div _open")
    return ranked.withColumns({"_rest": rest, "_open": open_weight}).withColumn(
        "budget", F.when(F.col("_full"), F.col("capacity")).otherwise(whole)).drop("_full", "_rest", "_open")


def leaf_budgets(leaves: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """(domain, language, origin, supply, budget) from (domain, language, origin, supply)."""
    leaves = leaves.withColumn("capacity", F.col("supply") * plan.max_epochs)
    supply = leaves.agg(F.sum("supply")).first()[0] or 0
    total = F.lit(int(math.floor(supply * plan.budget_share))).cast("long")
    tables = [plan.domains, plan.languages, plan.sources]
    budgets = None
    for depth, name in enumerate(LEVELS):
        parent, path = LEVELS[:depth], LEVELS[:depth + 1]
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity"))
        if budgets is None:
            nodes = nodes.withColumn("total", total)
        else:
            nodes = nodes.join(budgets.select(*parent, F.col("budget").alias("total")), list(parent))
        nodes = nodes.withColumn("weight", _weight(F.col(name), tables[depth], plan.other))
        budgets = _filled(nodes, parent or [F.lit(0)], name).select(*path, "budget")
    return leaves.select(*LEVELS, "supply").join(budgets, list(LEVELS), "left").withColumn("budget", F.coalesce("budget", F.lit(0)))


def _order(seed: int) -> Column:
    """Place in a leaf's shuffle: the epoch in which the prefix ends is part of the seed."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.col("doc_id").cast("string")))


def leaf_cuts(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """What every leaf takes: (domain, language, origin, full, cut), written to the shared folder.

    ``full`` whole epochs, then the documents whose place is not beyond ``cut``.
    The place of the cut is found in two steps, since one leaf may hold a large
    share of all documents: sums for 4096 ranges of places, then single places in
    the one range where the budget ends.
    """
    counted = written(docs.select("doc_id", *_placed(docs), tokens_of(F.col("text")).alias("tokens")), "tokens")
    leaves = counted.groupBy(*LEVELS).agg(F.sum("tokens").alias("supply"))
    budgets = written(leaf_budgets(leaves, plan).select(
        *LEVELS, F.when(F.col("supply") > 0, F.expr("budget div supply")).otherwise(0).alias("full"),
        F.when(F.col("supply") > 0, F.col("budget") % F.col("supply")).otherwise(0).alias("rest")), "budgets")
    placed = counted.join(budgets.filter("rest > 0"), list(LEVELS)).select(
        *LEVELS, "rest", "tokens", _order(plan.seed).alias("place"), F.col("full")).withColumn("range", F.substring("place", 1, 3))
    by_range = placed.groupBy(*LEVELS, "rest", "range").agg(F.sum("tokens").alias("tokens"))
    running = Window.partitionBy(*LEVELS).orderBy("range")
    sums = by_range.withColumn("upto", F.sum("tokens").over(running))
    edge = sums.filter("upto > rest").groupBy(*LEVELS).agg(
        F.min("range").alias("range"), F.min_by(F.col("upto") - F.col("tokens"), "range").alias("before"))
    edge = written(edge, "edges")
    inside = placed.join(edge, [*LEVELS, "range"]).groupBy(*LEVELS, "range", "rest", "before", "place").agg(
        F.sum("tokens").alias("tokens"))
    within = inside.withColumn("upto", F.col("before") + F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("place")))
    last = within.filter("upto <= rest").groupBy(*LEVELS).agg(F.max("place").alias("last"))
    cuts = budgets.select(*LEVELS, "full").join(edge.select(*LEVELS, "range"), list(LEVELS), "left").join(
        last, list(LEVELS), "left").select(*LEVELS, "full", F.coalesce("last", "range", F.lit("")).alias("cut"))
    return written(cuts, "cuts")


def mixed_copies(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The documents with their place in the tree and ``copies``, the number of epochs that take them; only those taken.

    A null text has no token; a null language or source is the leaf ``none``.
    Documents without tokens cost nothing, so they go with their neighbours in the
    shuffle; a leaf without tokens gives none.  Rows that repeat an id are taken
    or left together, also those with a null id within a leaf.  An empty table
    gives no row.  Columns of ``docs`` named like the added ones are replaced by them.
    """
    cuts = leaf_cuts(docs, plan)
    added = (*LEVELS, "copies")
    own = [c for c in docs.columns if c.lower() not in added]
    # the row goes as one column, so none of its names can meet those of the cuts
    rows = docs.select(F.struct(*own).alias("_row"), "doc_id", *_placed(docs))
    # the table of cuts has one row per leaf; Spark knows its written size and broadcasts it only if small
    copies = (F.col("full") + F.when(_order(plan.seed) <= F.col("cut"), 1).otherwise(0)).cast("int")
    return rows.join(cuts, list(LEVELS)).withColumn("copies", copies).filter("copies > 0").select("_row.*", *added)


def mixed_documents(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The mixture itself: every chosen document as often as it is taken, with the columns of ``docs``."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "lang", "source", "text")
    return mixed_copies(rows, plan).select("_row", F.explode(F.sequence(F.lit(1), "copies")).alias("_n")).select("_row.*")


def mix_sql(documents: str = "documents", plan: Plan = Plan()) -> str:
    """The same mixture in SQL: (doc_id, domain, language, origin, copies)."""
    def case(name: str, weights: Mapping[str, int]) -> str:
        whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items())
        return f"CAST(CASE {name} {whens} ELSE {plan.other} END AS BIGINT)" if weights else f"CAST({plan.other} AS BIGINT)"

    levels, parts = [], []
    for depth, (name, weights) in enumerate(zip(LEVELS, [plan.domains, plan.languages, plan.sources])):
        path, parent = ", ".join(LEVELS[:depth + 1]), ", ".join(LEVELS[:depth])
        total = f"(SELECT CAST(floor(coalesce(sum(supply), 0) * {plan.budget_share}::DOUBLE) AS BIGINT) FROM leaves)"
        source = f"SELECT {path}, sum(capacity)::BIGINT AS capacity, {case(name, weights)} AS weight"
        nodes = f"{source}, {total} AS total FROM leaves GROUP BY {path}" if not depth else (
            f"SELECT n.*, b.budget AS total FROM ({source} FROM leaves GROUP BY {path}) n JOIN b{depth - 1} b USING ({parent})")
        group = f"PARTITION BY {parent}" if depth else ""
        order = f"{group} ORDER BY capacity / weight, {name}"
        levels.append(f"""
n{depth} AS ({nodes}),
f{depth} AS (SELECT *, capacity * sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= weight * (total - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS full_
  FROM n{depth} WHERE weight > 0),
b{depth} AS (SELECT {path}, CAST(CASE WHEN full_ THEN capacity
    ELSE ((total - coalesce(sum(CASE WHEN full_ THEN capacity END) OVER ({group}), 0)) * weight)
      // sum(CASE WHEN NOT full_ THEN weight END) OVER ({group}) END AS BIGINT) AS budget FROM f{depth})""")
    leaf = ", ".join(LEVELS)
    return f"""
WITH counted AS (
  SELECT doc_id, coalesce(lang, '{NONE}') AS language, coalesce(source, '{NONE}') AS origin,
    regexp_extract(coalesce(source, '{NONE}'), '([0-9]{{1,9}})$', 1) AS number,
    CASE WHEN number = '' THEN '{NONE}' WHEN number = '0' THEN 'crawl'
         WHEN CAST(number AS INTEGER) % 2 = 1 THEN 'reference' ELSE 'forum' END AS domain,
    CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')), 0) AS BIGINT) AS tokens
  FROM {documents}),
leaves AS (SELECT {leaf}, sum(tokens)::BIGINT AS supply, (sum(tokens) * {plan.max_epochs})::BIGINT AS capacity
  FROM counted GROUP BY {leaf}),{",".join(levels)},
budgets AS (
  SELECT {leaf}, CASE WHEN supply > 0 THEN coalesce(budget, 0) // supply ELSE 0 END AS full_epochs,
    CASE WHEN supply > 0 THEN coalesce(budget, 0) % supply ELSE 0 END AS rest
  FROM leaves LEFT JOIN b2 USING ({leaf})),
placed AS (
  SELECT *, md5('{plan.seed}:' || full_epochs || ':' || doc_id) AS place FROM counted JOIN budgets USING ({leaf})),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY {leaf} ORDER BY place) AS upto FROM placed)
SELECT doc_id, domain, language, origin,
  CAST(full_epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM summed WHERE full_epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END > 0"""
