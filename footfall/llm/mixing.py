"""Mixing sources to target weights by hierarchical budgets, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

LEVELS = ("domain", "lang", "source")
#: Largest leaf table that is sent to every executor (some 100 bytes a row).
BROADCAST_LEAVES = 20_000
#: Rows that one window of the prefix sums holds on average.
PREFIX_ROWS = 2048
#: The column that tells rows apart where ids may repeat or be null.
ROW = "_footfall_row"
_TIMES = "_footfall_times"
_BITS = 60
_NTH = "_footfall_nth"


@dataclass(frozen=True)
class Mix:
    """Whole-number weights by node name at each level (others: 1), and how much to take.

    ``share`` of all tokens is the budget, as (numerator, denominator); a leaf gives at most
    ``max_epochs`` times its tokens; ``seed`` orders each epoch.
    """

    domain: dict[str, int] = field(default_factory=dict)
    lang: dict[str, int] = field(default_factory=dict)
    source: dict[str, int] = field(default_factory=dict)
    share: tuple[int, int] = (1, 2)
    max_epochs: int = 2
    seed: int = 17


#: Domains of the synthetic sources src0, src1, ...: the source's number modulo 4.
DOMAIN_SQL = "concat('domain', coalesce(try_cast(substr(source, 4) AS BIGINT) % 4, -1))"
DEFAULT = Mix(domain={"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}, lang={"en": 5, "de": 2, "fr": 2, "es": 3})


def _weight(level: str, named: dict[str, int]) -> Column:
    out = F.lit(1).cast("long")
    for name, weight in named.items():
        out = F.when(F.col(level) == name, F.lit(weight).cast("long")).otherwise(out)
    return out


def water_fill(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Split each parent's ``budget`` over its children by ``weight``, none above its ``capacity``.

    What a full child cannot take goes to its siblings by their weights, so a budget leaves the parent only
    if all of its children are full. All in whole numbers; the shares of a parent add up exactly. A weight of 0
    takes nothing, and leaves what its siblings cannot take unspent; negative weights count as 0.
    """
    children = children.withColumns({"capacity": F.when(F.col("weight") > 0, F.col("capacity")).otherwise(F.lit(0)), "weight": F.greatest("weight", F.lit(0))})
    group = [F.col(p) for p in parent] or [F.lit(0)]
    order = Window.partitionBy(*group).orderBy(F.try_divide("capacity", "weight"), child)
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = children.withColumns({"used": F.coalesce(F.sum("capacity").over(before), F.lit(0)), "open_weight": F.sum("weight").over(rest)})
    full = F.col("capacity") * F.col("open_weight") <= F.col("weight") * (F.col("budget") - F.col("used"))
    filled = filled.withColumn("full", full)
    # the first child that is not full fixes what the open ones share
    first = F.first(F.when(~F.col("full"), F.struct(F.col("budget") - F.col("used"), F.col("open_weight"))), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    filled = filled.withColumns({"first": first, "open": F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(upto), F.lit(0))})
    filled = filled.withColumns({"left": F.col("first")["col1"], "shared": F.col("first")["open_weight"]})
    got = F.expr("(left * open) div shared - (left * (open - weight)) div shared")
    return filled.withColumn("given", F.when(F.col("full"), F.col("capacity")).otherwise(got)).drop("used", "open_weight", "full", "first", "open", "left", "shared")


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """``leaves(domain, lang, source, tokens, docs)`` plus ``leaf_budget``, from the root down."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * mix.max_epochs)
    over, under = mix.share
    wanted = leaves.agg(F.sum("tokens").alias("t"), F.sum("capacity").alias("c")).select(F.least(F.expr(f"(t * {over}) div {under}"), "c").alias("budget"))
    given: DataFrame | None = None
    for depth, level in enumerate(LEVELS):
        parent, path = list(LEVELS[:depth]), list(LEVELS[: depth + 1])
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(level, getattr(mix, level)))
        nodes = nodes.withColumn("budget", wanted.scalar()) if given is None else nodes.join(given, parent)
        given = water_fill(nodes, parent, level).select(*path, F.col("given").alias("budget"))
    return leaves.drop("capacity").join(given.withColumnRenamed("budget", "leaf_budget"), list(LEVELS))


def word_tokens(text: Column) -> Column:
    """Words plus one end mark; null and empty texts count 1."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long") + 1


def mix_sources(docs: DataFrame, mix: Mix = DEFAULT, domain_sql: str = DOMAIN_SQL, prefix_rows: int = PREFIX_ROWS) -> DataFrame:
    """One row per document: (doc_id, domain, lang, source, n_tokens, leaf_budget, epochs, partial_tokens, tokens_taken).

    A leaf's budget covers ``epochs`` whole passes over its documents and then a token-prefix of one more
    pass, each pass in an order seeded by its number; ``partial_tokens`` is what that prefix takes of the
    document (the document at its end may be cut). tokens_taken adds up to leaf_budget in each leaf.
    Null lang or source form leaves of their own named ``(none)``; null and empty texts count one token;
    repeated rows count each; an empty table gives no rows; other columns are ignored.

    The order is that of the ids' seeded hash, then id, tokens and a number of the row. Rows of one id, or without any, share
    a hash; where they overfill a window of it they are dealt to parts by their numbers, which then come first in its order.
    """
    return _planned(docs, mix, domain_sql, prefix_rows)


def _planned(docs: DataFrame, mix: Mix, domain_sql: str, prefix_rows: int, *row: str) -> DataFrame:
    """The rows of ``mix_sources``, with the unique column ``row`` of ``docs`` if one is named."""
    scratch = Scratch(docs.sparkSession)
    keyed = docs.select(
        (F.col(row[0]) if row else F.monotonically_increasing_id()).alias(_NTH),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.expr(domain_sql), F.lit("(none)")).alias("domain"),
        F.coalesce("lang", F.lit("(none)")).alias("lang"),
        F.coalesce("source", F.lit("(none)")).alias("source"),
        word_tokens(F.col("text")).alias("n_tokens"),
    )
    keyed = scratch.keep(keyed)
    leaves = scratch.keep(keyed.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")))
    plan = leaf_budgets(leaves, mix).select(
        *LEVELS,
        "leaf_budget",
        F.expr("leaf_budget div tokens").alias("epochs"),
        F.expr("leaf_budget % tokens").alias("rest"),
        # as many windows as the leaf's rows ask for, a power of two each
        F.least(F.lit(40), F.greatest(F.lit(0), F.ceil(F.log2(F.col("docs") / prefix_rows)))).cast("int").alias("bits"),
    )
    plan = scratch.keep(plan)
    few = plan.count() <= BROADCAST_LEAVES
    joined = keyed.join(F.broadcast(plan) if few else plan, list(LEVELS))
    spot = F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(mix.seed)), F.col("epochs").cast("string")).cast("binary")), 1, _BITS // 4), 16, 10).cast("long")
    placed = joined.withColumn("spot", spot).withColumns({"window": F.expr(f"shiftright(spot, {_BITS} - bits)"), "deal": F.lit(0).cast("long")})
    keys = [*LEVELS, "window", "deal"]
    sums = scratch.keep(placed.groupBy(*keys).agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("rows")))
    full = sums.filter(F.col("rows") > 4 * prefix_rows).select(*keys[:-1], F.ceil(F.col("rows") / prefix_rows).alias("deals"))
    if not full.isEmpty():
        placed = placed.join(full, keys[:-1], "left").withColumn("deal", F.coalesce(F.pmod(F.xxhash64(_NTH), F.col("deals")), F.lit(0))).drop("deals")
        sums = placed.groupBy(*keys).agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy(*LEVELS).orderBy("window", "deal").rowsBetween(Window.unboundedPreceding, -1)
    sums = scratch.keep(sums.select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    within = Window.partitionBy(*keys).orderBy("spot", "doc_id", "n_tokens", _NTH).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("offset") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    partial = F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("rest") - ahead))
    out = placed.join(sums, keys).withColumn("partial_tokens", partial)
    return out.select(*(F.col(_NTH).alias(r) for r in row), "doc_id", *LEVELS, "n_tokens", "leaf_budget", "epochs", "partial_tokens", (F.col("epochs") * F.col("n_tokens") + F.col("partial_tokens")).alias("tokens_taken"))


def apply_mix(docs: DataFrame, mix: Mix = DEFAULT, domain_sql: str = DOMAIN_SQL) -> DataFrame:
    """The documents themselves, with their columns, once for each epoch that takes them whole.

    The document that a leaf's budget would cut is left out, so a leaf gives up to one document less than its
    budget. Each row is taken for itself, whether its id is null or stands in other rows too, and
    extra columns may have any name but ``ROW`` and ``_TIMES``; see ``mix_sources`` for nulls. An empty table gives no rows.
    """
    rows = Scratch(docs.sparkSession).numbered(docs, ROW)
    times = (F.col("epochs") + (F.col("partial_tokens") == F.col("n_tokens")).cast("long")).alias(_TIMES)
    taken = _planned(rows, mix, domain_sql, PREFIX_ROWS, ROW).select(ROW, times).filter(F.col(_TIMES) > 0)
    kept = rows.join(taken.hint("shuffle_hash"), ROW)
    if mix.max_epochs > 1:
        kept = kept.withColumn(_TIMES, F.explode(F.sequence(F.lit(1).cast("long"), F.col(_TIMES))))
    return kept.select(*[f"`{c}`" for c in docs.columns])


def _weight_sql(level: str, named: dict[str, int]) -> str:
    return "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in named.items()) + " ELSE 1 END" if named else "1"


def oracle(mix: Mix = DEFAULT) -> str:
    """The same result as one DuckDB statement over ``documents``."""
    over, under = mix.share
    steps, parent_budget = [], f"least(total.t * {over} // {under}, total.t * {mix.max_epochs})"
    for depth, level in enumerate(LEVELS):
        path, parent = ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth])
        by = f"PARTITION BY {parent} " if parent else ""
        source = f"JOIN g{depth - 1} USING ({parent})" if parent else "CROSS JOIN total"
        steps.append(f"""
n{depth} AS (SELECT n.*, {"g%d.given" % (depth - 1) if parent else parent_budget} AS budget FROM
  (SELECT {path}, sum(tokens)::BIGINT * {mix.max_epochs} AS capacity, {_weight_sql(level, getattr(mix, level))}::BIGINT AS weight FROM leaves GROUP BY {path}) n {source}),
f{depth} AS (SELECT *, coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used,
  (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS open_weight
  FROM n{depth} WINDOW w AS ({by}ORDER BY capacity::DOUBLE / weight::DOUBLE, {level})),
h{depth} AS (SELECT *, capacity * open_weight <= weight * (budget - used) AS is_full FROM f{depth}),
i{depth} AS (SELECT *, min_by(budget - used, used) FILTER (NOT is_full) OVER ({by}) AS left_over, max(open_weight) FILTER (NOT is_full) OVER ({by}) AS shared,
  coalesce(sum(weight) FILTER (NOT is_full) OVER ({by}ORDER BY capacity::DOUBLE / weight::DOUBLE, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)::BIGINT AS opened FROM h{depth}),
g{depth} AS (SELECT {path}, CASE WHEN is_full THEN capacity ELSE left_over * opened // shared - left_over * (opened - weight) // shared END AS given FROM i{depth})""")
    return f"""
WITH keyed AS (SELECT doc_id, concat('domain', coalesce(try_cast(substr(source, 4) AS BIGINT) % 4, -1)) AS domain, coalesce(lang, '(none)') AS lang,
  coalesce(source, '(none)') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT + 1 AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM keyed GROUP BY ALL),
total AS (SELECT sum(tokens)::BIGINT AS t FROM leaves),{",".join(steps)},
plan AS (SELECT l.*, given::BIGINT AS leaf_budget, (given // tokens)::BIGINT AS epochs, (given % tokens)::BIGINT AS rest FROM leaves l JOIN g2 USING (domain, lang, source)),
placed AS (SELECT k.*, leaf_budget, epochs, rest, md5(doc_id || ':{mix.seed}:' || epochs)[1:15] AS spot FROM keyed k JOIN plan USING (domain, lang, source)),
summed AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY spot, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead FROM placed),
cut AS (SELECT *, greatest(0, least(n_tokens, rest - ahead))::BIGINT AS partial_tokens FROM summed)
SELECT doc_id, domain, lang, source, n_tokens, leaf_budget, epochs, partial_tokens, epochs * n_tokens + partial_tokens AS tokens_taken FROM cut
"""
