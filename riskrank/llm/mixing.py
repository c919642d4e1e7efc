"""Mixing sources to target weights by hierarchical budgeting.

The tree has the levels domain, language and source. A token budget at the root is passed
down: each node shares its budget among its children in proportion to their weights, and a
child never gets more than its capacity (its tokens times ``max_epochs``, summed up the
tree). What a child cannot use goes to its siblings first; only what all children together
cannot use counts against the parent's own capacity and so goes to the parent's siblings.

A leaf with budget ``b`` and ``T`` tokens takes ``b // T`` whole epochs and a prefix of
the next one. An epoch's order is a seeded hash of the row, so the prefix of a leaf is
found without sorting the leaf: token sums of 4,096 hash ranges give the range that the
cut falls in, and only that range is ordered. A document is taken when the tokens before
it in its epoch are fewer than the rest of the budget, so a leaf passes its budget by less
than one document.

SQL functions only. The leaf table has one row a (domain, language, source).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

LEVELS = ("domain", "lang", "source")
MAX_EPOCHS = 3
SEED = 10
#: Hash ranges of a leaf: three hexadecimal digits.
RANGE_DIGITS = 3
#: Leaf tables up to so many rows are broadcast (about 100 bytes a row).
BROADCAST_LEAVES = 50_000


def token_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Budget of each child: ``min(capacity, weight * level)`` with the level that uses up the
    parent's budget. Children in order of capacity / weight fill up first; the level is the
    one of the first child that does not (later ones would have a lower one)."""
    key = [F.col(c) for c in parent]
    ratio = F.col("capacity") / F.col("weight")
    by_fill = Window.partitionBy(*key).orderBy(ratio, *[F.col(c) for c in LEVELS if c in nodes.columns])
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    on = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rest = F.col("parent_budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))
    level = rest / F.sum("weight").over(on)
    return (nodes.withColumn("level", level)
                 .withColumn("level", F.max(F.when(ratio > F.col("level"), F.col("level"))).over(Window.partitionBy(*key)))
                 .withColumn("budget", F.when(F.col("level").isNull(), F.col("capacity").cast("double"))
                                        .otherwise(F.least(F.col("capacity").cast("double"), F.col("weight") * F.col("level"))))
                 .drop("level", "parent_budget"))


def weight_of(weights: dict, column: Column) -> Column:
    """Weight by name, 1 where none is given."""
    out = F.lit(1.0)
    for name, w in sorted(weights.items()):
        if not w > 0:
            raise ValueError("weights must be positive")
        out = F.when(column == F.lit(name), F.lit(float(w))).otherwise(out)
    return out


def leaf_budgets(leaves: DataFrame, fraction: float, weights: dict[str, dict], max_epochs: int) -> DataFrame:
    """``leaves``: ``domain, lang, source, tokens``. Adds ``budget``, ``epochs`` (whole ones) and
    ``rest`` (tokens of the next). The root's budget is ``fraction`` of all tokens, which
    ``max_epochs`` of all leaves bound."""
    one = leaves.where("tokens > 0").withColumn("capacity", F.col("tokens") * max_epochs)
    total = one.agg((F.floor(F.sum("tokens") * F.lit(fraction))).cast("double").alias("parent_budget"))
    done = None
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[:depth + 1])
        nodes = one.groupBy(*path).agg(F.sum("capacity").alias("capacity")) \
                   .withColumn("weight", weight_of(weights.get(level, {}), F.col(level)))
        if done is None:
            nodes = nodes.join(F.broadcast(total))  # one row
            done = _share(nodes.withColumn("__root", F.lit(0)), ["__root"]).drop("__root")
        else:
            up = done.select(*path[:-1], F.col("budget").alias("parent_budget"))
            done = _share(nodes.join(up, path[:-1]), path[:-1])
    out = one.join(done.select(*LEVELS, "budget"), list(LEVELS))
    budget = F.floor(F.col("budget") + F.lit(1e-6)).cast("long")
    whole = F.least(F.floor(budget / F.col("tokens")).cast("long"), F.lit(max_epochs).cast("long"))
    return out.select(*LEVELS, "tokens", budget.alias("budget"), whole.alias("epochs"),
                      (budget - whole * F.col("tokens")).alias("rest"))


def select_mix(docs: DataFrame, domain: Column, fraction: float, weights: dict[str, dict] | None = None,
               max_epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id",
               text_col: str = "text", keep: bool = True) -> DataFrame:
    """The mix: every row of ``docs`` (packed in a struct ``row`` when ``keep``) with ``domain, lang, source,
    n_tokens, epochs, in_prefix, copies`` (how often the row is taken: whole epochs, and one
    more when it lies in the prefix of the next).

    Null domains, languages and sources form leaves of their own (shown as empty strings).
    Rows without words have no tokens and are never taken. Rows equal in id share their
    place in an epoch: a prefix takes both or neither. An empty table gives an empty one."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if keep else F.struct(F.col(id_col))
    rows = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("id"),
                       blank(domain).alias("domain"), blank(F.col("lang")).alias("lang"),
                       blank(F.col("source")).alias("source"), token_count(F.col(text_col)).alias("n_tokens"))
    slim = written(rows.drop("row"), "mix-tokens")
    leaves = slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    leaves = written(leaf_budgets(written(leaves, "mix-leaves"), fraction, weights or {}, max_epochs), "mix-budgets")
    place = F.md5(F.concat_ws(":", F.lit(seed), F.col("epochs"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))

    def with_leaf(df, table):
        return df.join(F.broadcast(table) if table.count() <= BROADCAST_LEAVES else table, list(LEVELS))
    placed = with_leaf(slim, leaves.where("rest > 0").select(*LEVELS, "epochs", "rest")).withColumn("place", place)
    placed = placed.withColumn("part", F.substring("place", 1, RANGE_DIGITS))
    # the hash range in which each leaf's cut falls, and the tokens before that range
    parts = written(placed.groupBy(*LEVELS, "rest", "part").agg(F.sum("n_tokens").alias("t")), "mix-ranges")
    before = Window.partitionBy(*LEVELS).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cut = parts.withColumn("before", F.coalesce(F.sum("t").over(before), F.lit(0))) \
               .where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("t") >= F.col("rest"))) \
               .select(*LEVELS, F.col("part").alias("cut_part"), "before")
    cut = written(cut, "mix-cuts")
    inside = with_leaf(placed, cut).where(F.col("part") == F.col("cut_part"))
    per_place = inside.groupBy(*LEVELS, "part", "place", "rest", "before").agg(F.sum("n_tokens").alias("t"))
    ahead = Window.partitionBy(*LEVELS, "part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    last = per_place.withColumn("ahead", F.col("before") + F.coalesce(F.sum("t").over(ahead), F.lit(0))) \
                    .where(F.col("ahead") < F.col("rest")) \
                    .groupBy(*LEVELS).agg(F.max("place").alias("last"))
    table = written(leaves.join(last, list(LEVELS), "left"), "mix-leaf-cuts")
    taken = F.broadcast(table) if table.count() <= BROADCAST_LEAVES else table
    out = rows.join(taken, list(LEVELS), "left")
    out = out.withColumn("epochs", F.when(F.col("n_tokens") > 0, F.coalesce("epochs", F.lit(0))).otherwise(0).cast("long"))
    prefix = F.coalesce((F.col("n_tokens") > 0) & (place <= F.col("last")), F.lit(False))
    out = out.withColumn("in_prefix", prefix)
    return out.select("row", *LEVELS, "n_tokens", "epochs", "in_prefix",
                      (F.col("epochs") + F.col("in_prefix").cast("long")).alias("copies"))
