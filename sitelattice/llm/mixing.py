"""Mixing sources to target weights by hierarchical budgeting.

Documents are leaves' rows of a tree domain - language - source.  A token budget
flows down the tree in proportion to the children's weights.  A node can use no
more than its subtree supplies (tokens times ``max_epochs``); what it cannot use
goes to its siblings in proportion to their weights, and only what no sibling
can use stays with the ancestors, whose other children then receive it.

Sharing one node's budget is a water level: with children ordered by supply over
weight, a child is full when its ratio is below (budget - supply of those before)
/ (weight of those from it on).  That is two running sums in a window over the
node's children, so the whole tree is three windows over the table of leaves.

Each leaf then takes whole epochs and, of the next one, the prefix in a seeded
order (MD5 of seed, epoch and identifier) that fits its remaining budget.  The
prefix is found in steps so that no task ever orders a whole leaf: tokens are
summed for each of 256 ranges of the order, the range in which the budget ends is
cut into 256 again, ``STEPS`` times, and only what is left is ordered by itself,
rows of one identifier summed first.

All of it is DataFrame functions.  Sums of tokens are exact integers; budgets
are rounded down to whole tokens.

Cases: null language or source form leaves of their own; a null or empty text
has no tokens and is taken whenever its leaf has any budget left over at its
place in the order.  Rows with one identifier are taken together or not at all.  An empty table gives an empty result.  Extra columns pass through
where rows are returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelattice.llm.runtime import Scratch, own_names, renamed, table

#: Steps of 256 ranges each: 16.8 million ranges of a leaf.
STEPS = 3
FEW_LEAVES = 100_000
DOMAINS = 4
LEVELS = ("domain", "lang", "source")


def word_count(text: Column) -> Column:
    """Words of any length: runs of other characters than blank and \\x09-\\x0D."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def default_domain() -> Column:
    """A source's domain: its MD5 in ``DOMAINS`` classes; sources without a name have their own."""
    return F.when(F.col("source").isNull(), "domain-none").otherwise(F.concat(F.lit("domain-"), (F.conv(F.substring(F.md5(F.col("source").cast("binary")), 1, 2), 16, 10).cast("int") % DOMAINS).cast("string")))


def _share(children: DataFrame, parent: list[str], own: str, budget: str, supply: str, weight: str, out: str) -> DataFrame:
    """``children`` with column ``out``: their part of the parent's ``budget``, none above ``supply``."""
    order = Window.partitionBy(*parent).orderBy((F.col(supply) / F.col(weight)).asc(), F.col(own).asc_nulls_first())
    before = F.coalesce(F.sum(supply).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(weight).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.col(budget) - before) / rest
    full = F.col(supply) <= level * F.col(weight)
    # the level at the first child that is not full holds for all from it on
    children = children.withColumn("_full", full).withColumn("_level", level)
    common = F.min(F.when(~F.col("_full"), F.struct(F.col(supply) / F.col(weight), F.col("_level")))).over(Window.partitionBy(*parent))["_level"]
    return children.withColumn(out, F.when(F.col("_full"), F.col(supply).cast("double")).otherwise(F.least(F.col(supply).cast("double"), common * F.col(weight)))).drop("_full", "_level")


def budgets(leaves: DataFrame, total: Column, weights: dict[str, Column], max_epochs: int) -> DataFrame:
    """Leaves (domain, lang, source, tokens, rows) with their weight and budget.

    ``weights`` gives each level's unnormalised weight as a column of the node's
    tokens ``tokens`` and names; ``total`` is a column of the supply ``tokens``.
    """
    leaves = leaves.withColumn("supply", F.col("tokens") * max_epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("tokens").alias("tokens"), F.sum("supply").alias("supply"))
    domains = langs.groupBy("domain").agg(F.sum("tokens").alias("tokens"), F.sum("supply").alias("supply"))
    whole = domains.agg(F.sum("tokens").alias("tokens")).select(total.cast("double").alias("budget"))  # one row
    domains = _share(domains.crossJoin(F.broadcast(whole)).withColumn("w", weights["domain"]).withColumn("root", F.lit(0)), ["root"], "domain", "budget", "supply", "w", "d_budget")
    langs = langs.withColumn("w", weights["lang"]).join(domains.select("domain", "d_budget"), "domain")
    langs = _share(langs, ["domain"], "lang", "d_budget", "supply", "w", "l_budget").select(F.col("domain").alias("_d"), F.col("lang").alias("_l"), "l_budget")
    leaves = leaves.withColumn("w", weights["source"]).join(langs, (F.col("domain") == F.col("_d")) & F.col("lang").eqNullSafe(F.col("_l"))).drop("_d", "_l")
    leaves = _share(leaves, ["domain", "lang"], "source", "l_budget", "supply", "w", "s_budget")
    return leaves.select("domain", "lang", "source", "tokens", "rows", F.floor(F.col("s_budget") + 1e-6).cast("long").alias("budget"))


def default_weights() -> dict[str, Column]:
    """Equal domains; languages and sources by the square root of their tokens, which lifts small ones."""
    return {"domain": F.lit(1.0), "lang": F.sqrt(F.col("tokens") + 1), "source": F.sqrt(F.col("tokens") + 1)}


def _mark(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def _on_leaf(rows: DataFrame, side: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of a side that has one row for each leaf."""
    side = side.select(*(F.col(c).alias(f"_{c}") for c in LEVELS), *(c for c in side.columns if c not in LEVELS))
    same = (F.col("domain") == F.col("_domain")) & F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    return rows.join(F.broadcast(side) if few else side, same, how).drop(*(f"_{c}" for c in LEVELS))


def plan(rows: DataFrame, scratch: Scratch, part: float, max_epochs: int, seed: int, weights: dict[str, Column] | None) -> tuple[DataFrame, bool]:
    """For each leaf: budget, whole epochs, and the mark at which the prefix of the next epoch ends (null: none).

    ``rows`` has doc_id, n_tokens and the levels.  Also whether the leaves are few enough to broadcast.
    """
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    leaves = budgets(leaves, F.col("tokens") * part, weights or default_weights(), max_epochs)
    some = F.col("tokens") > 0
    leaves = scratch.keep(leaves.select(*LEVELS, "budget", F.when(some, F.expr("budget div tokens")).otherwise(1).cast("int").alias("epochs"), F.when(some, F.expr("budget % tokens")).otherwise(0).alias("left")), "leaves")
    few = leaves.count() <= FEW_LEAVES
    edge = _on_leaf(rows, leaves, few).select(*LEVELS, "n_tokens", "left", _mark(seed).alias("mark"), F.lit(0).cast("long").alias("ahead"))
    for step in range(STEPS):
        # the range of the order, by the mark's next two digits, in which the leaf's budget ends
        edge = edge.withColumn("range", F.conv(F.substring("mark", 2 * step + 1, 2), 16, 10).cast("int"))
        ranges = edge.groupBy(*LEVELS, "range").agg(F.sum("n_tokens").alias("n"), F.first("left").alias("left"), F.first("ahead").alias("ahead"))
        ranges = ranges.withColumn("before", F.col("ahead") + F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("range")) - F.col("n"))
        last = ranges.where("before <= left").groupBy(*LEVELS).agg(F.max(F.struct("range", "before")).alias("end"))
        edge = _on_leaf(edge, scratch.keep(last, "ranges"), few).where("range = end.range").select(*LEVELS, "n_tokens", "left", "mark", F.col("end.before").alias("ahead"))
    marks = edge.groupBy(*LEVELS, "mark").agg(F.sum("n_tokens").alias("n"), F.first("left").alias("left"), F.first("ahead").alias("ahead"))  # rows with one mark count together
    upto = F.col("ahead") + F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("mark"))
    cuts = marks.withColumn("upto", upto).where("upto > left").groupBy(*LEVELS).agg(F.min("mark").alias("cut"))
    return scratch.keep(_on_leaf(leaves, cuts, few, "left").select(*LEVELS, "budget", "epochs", "cut"), "plan"), few


def _levels(domain: Column | None) -> dict[str, Column]:
    return {"domain": default_domain() if domain is None else domain, "lang": F.col("lang"), "source": F.col("source")}


def counted(docs: DataFrame, scratch: Scratch, domain: Column | None = None) -> DataFrame:
    """doc_id, the levels and n_tokens of each row of ``docs``, stored."""
    return scratch.keep(docs.select("doc_id", *(c.alias(n) for n, c in _levels(domain).items()), word_count(F.col("text")).alias("n_tokens")), "tokens")


def _copies(seed: int) -> Column:
    return F.col("epochs") + F.when(F.col("cut").isNull() | (_mark(seed) < F.col("cut")), 1).otherwise(0)


def allocate(docs: DataFrame, part: float = 0.7, max_epochs: int = 2, seed: int = 17, weights: dict[str, Column] | None = None, domain: Column | None = None) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, the leaf's budget, and copies, for each row of ``docs``; words are counted once."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = counted(docs, scratch, domain)
    leaf_plan, few = plan(rows, scratch, part, max_epochs, seed, weights)
    return _on_leaf(rows, leaf_plan, few).select("doc_id", *LEVELS, "n_tokens", "budget", _copies(seed).alias("copies"))


def mix(docs: DataFrame, keep: list[str], part: float = 0.7, max_epochs: int = 2, seed: int = 17, weights: dict[str, Column] | None = None, domain: Column | None = None) -> DataFrame:
    """Columns ``keep`` of every row of ``docs`` with _leaf struct<domain, lang, source>, _budget of the leaf and _copies.

    The budget is ``part`` of all tokens.  ``_copies`` says how often the row is
    taken: once for each whole epoch and once more if it is in the prefix.  The
    rows themselves are not shuffled: each is compared with its leaf's mark.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = counted(docs, scratch, domain)
    leaf_plan, few = plan(rows, scratch, part, max_epochs, seed, weights)
    scratch.drop(rows)
    rows = docs.select(F.struct(*(F.col(c) for c in keep)).alias("_row"), "doc_id", *(c.alias(n) for n, c in _levels(domain).items()))
    return _on_leaf(rows, leaf_plan, few).select("_row.*", F.struct(*LEVELS).alias("_leaf"), F.col("budget").alias("_budget"), _copies(seed).alias("_copies"))


def op5(spark, sf_dir: str) -> DataFrame:
    return allocate(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents, each at most once, with their own columns."""
    inner = own_names(docs.columns)
    rows = mix(docs.select(*renamed(docs, docs.columns, inner), *(F.col(c) for c in ("doc_id", "text", "lang", "source"))), inner, max_epochs=1)
    return rows.where("_copies > 0").select(*inner).toDF(*docs.columns)


def _shared_sql(name: str, rows: str, parent: str, own: str, budget: str) -> str:
    """CTEs that share ``budget`` of each parent among the children in ``rows``."""
    by = f"PARTITION BY {parent}" if parent else ""
    order = f"ORDER BY supply / w, {own} NULLS FIRST"
    return f"""
{name}_a AS (SELECT *, ({budget} - coalesce(sum(supply) OVER ({by} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
    sum(w) OVER ({by} {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM {rows}),
{name}_b AS (SELECT *, supply <= level * w AS filled FROM {name}_a),
{name} AS (SELECT *, CASE WHEN filled THEN supply::DOUBLE ELSE least(supply::DOUBLE, w *
    min(CASE WHEN NOT filled THEN {{'r': supply / w, 'l': level}} END) OVER ({by}) ['l']) END AS {name}_budget FROM {name}_b)"""


OP5_SQL = rf"""
WITH d AS (
  SELECT doc_id, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS n_tokens,
         CASE WHEN source IS NULL THEN 'domain-none' ELSE 'domain-' || (('0x' || substr(md5(source), 1, 2))::INT % {DOMAINS}) END AS domain
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, 2 * sum(n_tokens)::BIGINT AS supply, sqrt(sum(n_tokens) + 1) AS w FROM d GROUP BY ALL),
langs AS (SELECT domain, lang, sum(tokens)::BIGINT AS tokens, sum(supply)::BIGINT AS supply, sqrt(sum(tokens) + 1) AS w FROM leaves GROUP BY ALL),
domains AS (SELECT domain, sum(supply)::BIGINT AS supply, 1.0::DOUBLE AS w, sum(sum(tokens)) OVER () * 0.7::DOUBLE AS whole FROM langs GROUP BY ALL),
{_shared_sql("dom", "domains", "", "domain", "whole")},
langs_in AS (SELECT langs.*, dom_budget FROM langs JOIN dom USING (domain)),
{_shared_sql("lng", "langs_in", "domain", "lang", "dom_budget")},
leaves_in AS (SELECT leaves.*, lng_budget FROM leaves JOIN lng ON leaves.domain = lng.domain AND leaves.lang IS NOT DISTINCT FROM lng.lang),
{_shared_sql("src", "leaves_in", "domain, lang", "source", "lng_budget")},
p AS (SELECT domain, lang, source, floor(src_budget + 1e-6)::BIGINT AS budget, tokens FROM src),
q AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS epochs, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM p),
m AS (SELECT d.*, budget, epochs, rest, md5('17:' || epochs || ':' || coalesce(doc_id::VARCHAR, '')) AS mark
      FROM d JOIN q ON d.domain = q.domain AND d.lang IS NOT DISTINCT FROM q.lang AND d.source IS NOT DISTINCT FROM q.source),
s AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY mark) AS upto FROM m)
SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, budget, (epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::INT AS copies FROM s
"""
