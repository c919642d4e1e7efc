"""Distributed running totals and exact quantiles.

A window ordered over a whole table (no PARTITION BY) runs in one task. Ranking
metrics, exact quantiles and the quota split all need such cumulative sums, so
they go through ``running_totals`` instead:

1. approximate quantiles of the ordering key (per group) cut the rows into
   ``buckets`` balanced ranges; the boundaries are a scalar subquery (no groups) or
   a per-group row joined on the group keys. With too many groups for a broadcast, one
   range exchange on (group, ordering key) cuts all of them instead: a small group lies in
   one or two ranges, a large one in as many as its share of the rows;
2. a window partitioned by (group, bucket) gives the running sum inside each range;
3. per-bucket totals (at most ``buckets`` rows per group) give each range's offset
   and the group total; that small table is joined back.

The bounds are broadcast (their size is checked), so the first exchange of the rows is on
(group, bucket): every task holds about 1/``buckets`` of a group, however large, and the
result is exact either way: only sums of integers are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import SMALL_SIDE_ROWS, cut_lineage, stored

_UNB = Window.unboundedPreceding


def _default_buckets(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _left_join(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """``left`` with the other columns of ``right``; a NULL key equals NULL."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"_l.`{k}`").eqNullSafe(F.col(f"_r.`{k}`"))
    more = [F.col(f"_r.`{c}`") for c in right.columns if c not in keys]
    return left.alias("_l").join(right.alias("_r"), same, "left").select("_l.*", *more)


def bucket_by_range(df: DataFrame, order_col: str, group_cols=(), buckets: int | None = None,
                    descending: bool = False, out: str = "_bucket", tiebreak=()) -> DataFrame:
    """Add a range-bucket id that is monotone in ``order_col`` (0 = first in order) within a
    group. NULL group keys form a group. Beyond ``SMALL_SIDE_ROWS`` groups the ids come from one
    range exchange of all groups and are monotone in (``order_col``, ``tiebreak``)."""
    n = buckets or _default_buckets(df)
    key = (-F.col(order_col) if descending else F.col(order_col)).cast("double")
    if n <= 1:
        return df.withColumn(out, F.lit(0))
    probs = [i / n for i in range(1, n)]
    group_cols = list(group_cols)
    if group_cols:
        bounds = df.groupBy(*group_cols).agg(
            F.percentile_approx(key, probs, 10000).alias("_bounds"))
        # one row per group, written once: without the broadcast all rows of a group would
        # be exchanged to one task before they get their bucket
        bounds = cut_lineage(bounds)
        if bounds.limit(SMALL_SIDE_ROWS + 1).count() > SMALL_SIDE_ROWS:
            return _range_exchange(df, order_col, group_cols, n, descending, tiebreak, out)
        keyed = _left_join(df, F.broadcast(bounds), group_cols)
    else:
        keyed = df.withColumn("_bounds", df.select(
            F.percentile_approx(key, probs, 10000)).scalar())
    return (keyed.withColumn(out, F.size(F.filter("_bounds", lambda b: b < key)))
                 .drop("_bounds"))


def _range_exchange(df: DataFrame, order_col: str, group_cols: list, n: int, descending: bool, tiebreak, out: str) -> DataFrame:
    """Range partitions on (group, order, tiebreak), numbered. The range bounds are sampled,
    so the numbered rows are written once: every later read sees the same ids."""
    order = F.desc(order_col) if descending else F.asc(order_col)
    ranged = df.repartitionByRange(n, *[F.asc(c) for c in group_cols], order, *[F.asc(t) for t in tiebreak])
    return stored(ranged.withColumn(out, F.spark_partition_id()), "ranges")


def running_totals(df: DataFrame, order_col: str, sum_cols, group_cols=(), descending=False,
                   tiebreak=(), buckets: int | None = None) -> DataFrame:
    """Add ``cum_<c>`` (inclusive running sum in order) and ``tot_<c>`` (group total)
    for each ``c`` in ``sum_cols``. Rows should be unique per (group, order, tiebreak)."""
    group_cols = list(group_cols)
    sum_cols = list(sum_cols)
    keyed = bucket_by_range(df, order_col, group_cols, buckets, descending, tiebreak=tiebreak)
    columns = keyed.columns
    # the group as one struct: NULLs compare equal, and window and join share one exchange
    group = ["_group"] if group_cols else []
    if group_cols:
        keyed = keyed.withColumn("_group", F.struct(*group_cols)).drop(*group_cols)
    part = group + ["_bucket"]
    first = F.desc(order_col) if descending else F.asc(order_col)
    w = (Window.partitionBy(*part).orderBy(first, *[F.asc(t) for t in tiebreak])
               .rowsBetween(_UNB, Window.currentRow))
    local = keyed.withColumns({f"_loc_{c}": F.sum(c).over(w) for c in sum_cols})
    totals = keyed.groupBy(*part).agg(*[F.sum(c).alias(f"_bt_{c}") for c in sum_cols])
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_bucket").rowsBetween(_UNB, -1)
    offsets = totals.select(*part, *[
        e for c in sum_cols for e in (
            F.coalesce(F.sum(f"_bt_{c}").over(before), F.lit(0)).alias(f"_off_{c}"),
            F.sum(f"_bt_{c}").over(whole).alias(f"tot_{c}"))])
    if not group_cols:
        offsets = F.broadcast(offsets)  # at most `buckets` rows
    return local.join(offsets, part, "left").select(
        *[F.col(f"_group.`{c}`").alias(c) if c in group_cols else F.col(c) for c in columns],
        *[f"tot_{c}" for c in sum_cols],
        *[(F.col(f"_loc_{c}") + F.col(f"_off_{c}")).alias(f"cum_{c}") for c in sum_cols])


def exact_quantiles(df: DataFrame, value_col: str, probs, group_cols=(),
                    buckets: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles (numpy/pandas default, DuckDB ``quantile_cont``).

    Values are first counted per (group, value) (map-side combined), so memory is
    bounded by distinct values per task, never by group size. Output: group cols,
    ``p``, ``value``."""
    group_cols = list(group_cols)
    v = F.col(value_col)
    counts = (df.where(v.isNotNull())
                .groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("_n")))
    # read three times (range bounds, per-range sums, offsets): materialise once
    counts = cut_lineage(counts)
    rt = running_totals(counts, value_col, ["_n"], group_cols, buckets=buckets)
    # rank range of each distinct value: [cum - n, cum - 1]
    probs_arr = F.array(*[F.lit(float(p)) for p in probs])
    lo_hi = rt.select(*group_cols, F.col(value_col).cast("double").alias("_v"),
                      (F.col("cum__n") - F.col("_n")).alias("_first"),
                      (F.col("cum__n") - 1).alias("_last"),
                      F.col("tot__n").alias("_total"),
                      F.explode(probs_arr).alias("p"))
    pos = F.col("p") * (F.col("_total") - 1)
    lo = F.floor(pos)
    hi = F.ceil(pos)
    hits = lo_hi.where(((F.col("_first") <= lo) & (lo <= F.col("_last")))
                       | ((F.col("_first") <= hi) & (hi <= F.col("_last"))))
    frac = pos - lo
    agg = hits.groupBy(*group_cols, "p").agg(
        F.max(F.when((F.col("_first") <= lo) & (lo <= F.col("_last")), F.col("_v"))).alias("_vlo"),
        F.max(F.when((F.col("_first") <= hi) & (hi <= F.col("_last")), F.col("_v"))).alias("_vhi"),
        F.first(frac).alias("_frac"))
    return agg.select(*group_cols, "p",
                      (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac")).alias("value"))


def quantile_columns(df: DataFrame, value_col: str, probs, names, group_cols=()) -> DataFrame:
    """``exact_quantiles`` pivoted to one column per probability."""
    q = exact_quantiles(df, value_col, probs, group_cols)
    aggs = [F.max(F.when(F.col("p") == float(p), F.col("value"))).alias(name)
            for p, name in zip(probs, names)]
    if group_cols:
        return q.groupBy(*group_cols).agg(*aggs)
    return q.agg(*aggs)
