"""Parameter search (I9), its best-so-far trace and a per-parameter effect table.

Trials are drawn on the driver from a seeded rule (they are parameters, not data);
every trial is then scored in one grouped pass: each row carries its per-trial
scores as an array, ``posexplode`` turns them into (trial, score) rows and the
curve table is grouped by trial. No cross join, no per-trial job.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from . import curves

# The search space of the linear risk rule: (name, feature, low, high, log-uniform)
SPACE = [
    ("w_no_logo", "has_company_logo", -3.0, 0.0, False),
    ("w_no_profile", "company_profile_is_missing", 0.0, 3.0, False),
    ("w_caps", "caps_ratio", 0.01, 10.0, True),
    ("w_digit", "digit_ratio", 0.01, 10.0, True),
    ("w_money", "has_money", 0.0, 2.0, False),
]


def draw(trial: int, j: int, seed: int = 42) -> float:
    """A reproducible uniform draw in [0, 1) for (trial, parameter)."""
    return int(hashlib.md5(f"{seed}:{trial}:{j}".encode()).hexdigest()[:13], 16) / 16 ** 13


#: The booster's space: (name, low, high, log-uniform, whole number).
BOOSTER_SPACE = [
    ("num_leaves", 15, 255, False, True),
    ("learning_rate", 0.01, 0.2, True, False),
    ("min_child_samples", 5, 100, False, True),
    ("subsample", 0.6, 1.0, False, False),
    ("colsample", 0.6, 1.0, False, False),
    ("reg_lambda", 1e-3, 10.0, True, False),
    ("reg_alpha", 1e-3, 10.0, True, False),
]


def scaled(u: float, low: float, high: float, log: bool, whole: bool):
    """The draw ``u`` in [0, 1) on a parameter's range; whole numbers include both ends."""
    if whole:
        return int(low + math.floor(u * (high - low + 1)))
    return low * math.pow(high / low, u) if log else low + (high - low) * u


def unscaled(value, low: float, high: float, log: bool, whole: bool) -> float:
    """The place in [0, 1] of a value on its range (of a whole number: the middle of its share)."""
    if whole:
        return (value - low + 0.5) / (high - low + 1)
    return math.log(value / low) / math.log(high / low) if log else (value - low) / (high - low)


def booster_params(trial: int, seed: int = 42) -> dict:
    return {name: scaled(draw(trial, j, seed), *rng) for j, (name, *rng) in enumerate(BOOSTER_SPACE)}


class Parzen:
    """A density on [0, 1]: the uniform one and a normal kernel, cut off at the ends, at each point. A
    kernel is as wide as the larger gap to its neighbours, within bounds that shrink with the number of points."""

    def __init__(self, points):
        self.points = sorted(points)
        low = 1.0 / min(100.0, len(self.points) + 2.0)
        edges = [0.0, *self.points, 1.0]
        self.widths = [min(1.0, max(low, p - edges[i], edges[i + 2] - p)) for i, p in enumerate(self.points)]

    @staticmethod
    def _below(x, at, width):
        return 0.5 * (1.0 + math.erf((x - at) / (width * math.sqrt(2.0))))

    def density(self, x: float) -> float:
        total = 1.0
        for p, w in zip(self.points, self.widths):
            inside = self._below(1.0, p, w) - self._below(0.0, p, w)
            total += math.exp(-0.5 * ((x - p) / w) ** 2) / (w * math.sqrt(2.0 * math.pi) * inside)
        return total / (len(self.points) + 1)

    def sample(self, u: float, v: float) -> float:
        """A draw from the density, given two uniform ones: which kernel, and where in it."""
        k = int(u * (len(self.points) + 1))
        if k == len(self.points):
            return v
        p, w = self.points[k], self.widths[k]
        a, b = self._below(0.0, p, w), self._below(1.0, p, w)
        low, high, target = 0.0, 1.0, a + v * (b - a)
        for _ in range(50):
            mid = (low + high) / 2.0
            low, high = (mid, high) if self._below(mid, p, w) < target else (low, mid)
        return low


def tpe_params(done: list[tuple[dict, float]], trial: int, seed: int = 42, startup: int = 10, candidates: int = 24) -> dict:
    """Parameters of the next trial by tree-structured Parzen estimation over finished
    trials ``(parameters, score)``: each parameter takes the candidate, of ``candidates`` drawn from the
    density of the best tenth of the trials, with the largest ratio to the density of the others.
    The first ``startup`` trials are drawn at random."""
    if len(done) < startup:
        return booster_params(trial, seed)
    order = sorted(range(len(done)), key=lambda i: (-done[i][1], i))
    n_good = min(math.ceil(0.1 * len(done)), 25)
    out = {}
    for j, (name, *rng) in enumerate(BOOSTER_SPACE):
        places = [unscaled(done[i][0][name], *rng) for i in order]
        good, rest = Parzen(places[:n_good]), Parzen(places[n_good:])
        draws = [good.sample(draw(trial, 100 + 1000 * j + 2 * c, seed), draw(trial, 101 + 1000 * j + 2 * c, seed))
                 for c in range(candidates)]
        best = max(draws, key=lambda x: good.density(x) / rest.density(x))
        out[name] = scaled(min(best, 1.0 - 1e-9), *rng)
    return out


def trial_params(n_trials: int, seed: int = 42):
    out = []
    for t in range(n_trials):
        row = {"trial": t}
        for j, (name, _, lo, hi, log) in enumerate(SPACE):
            u = draw(t, j, seed)
            row[name] = lo * math.pow(hi / lo, u) if log else lo + (hi - lo) * u
        out.append(row)
    return out


def _score_expr(params, col=lambda c: F.col(c).cast("double")):
    expr = None
    for name, feat, *_ in SPACE:
        term = F.lit(params[name]) * col(feat)
        expr = term if expr is None else expr + term
    return expr


def linear_rule_search(df: DataFrame, n_trials: int, seed: int = 42, split_col: str = "split",
                       label: str = S.TARGET) -> DataFrame:
    """(trial, parameters..., val_ap): every trial scored on the validation rows."""
    trials = trial_params(n_trials, seed)
    val = df.where(F.col(split_col) == "val")
    scores = F.array(*[_score_expr(p) for p in trials])
    long = val.select(F.col(label).alias("y_true"), F.posexplode(scores).alias("trial", "y_proba"))
    ap = curves.ranking_summary(curves.curve_table(long, ["trial"]), ["trial"]) \
               .select("trial", F.col("average_precision").alias("val_ap"))
    spark = df.sparkSession
    names = [s[0] for s in SPACE]
    ptab = spark.createDataFrame([tuple([p["trial"]] + [p[n] for n in names]) for p in trials],
                                 "trial int, " + ", ".join(f"{n} double" for n in names))
    return F.broadcast(ptab).join(ap, "trial")  # n_trials rows


def best_so_far(trials: DataFrame) -> DataFrame:
    order = Window.orderBy("trial").rowsBetween(Window.unboundedPreceding, 0)  # n_trials rows
    return trials.select("trial", "val_ap", F.max("val_ap").over(order).alias("best_so_far"))


def param_effect(trials: DataFrame, bins: int = 4, names: list | None = None) -> DataFrame:
    """Share of the AP variance explained by the quantile bin of each parameter (``names``; those
    of ``SPACE``, when not given)."""
    names = names or [s[0] for s in SPACE]
    trials = trials.withColumns({n: F.col(n).cast("double") for n in names})
    long = trials.select("trial", "val_ap", *names).unpivot(["trial", "val_ap"], names, "param", "value")
    b = long.withColumn("bin", F.ntile(bins).over(Window.partitionBy("param").orderBy("value", "trial")))
    per_param = Window.partitionBy("param")
    b = b.withColumn("_mean", F.avg("val_ap").over(per_param))
    per_bin = b.groupBy("param", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("val_ap").alias("m"),
                                            F.first("_mean").alias("_mean"))
    between = per_bin.groupBy("param").agg(
        (F.sum(F.col("n") * (F.col("m") - F.col("_mean")) ** 2) / F.sum("n")).alias("between"))
    total = long.groupBy("param").agg(F.var_pop("val_ap").alias("total"))
    return between.join(total, "param").select(
        "param", F.when(F.col("total") > 0, F.col("between") / F.col("total")).otherwise(F.lit(0.0)).alias("effect"))


def _sql_score(p):
    return " + ".join(f"CAST({p[name]!r} AS DOUBLE) * CAST({feat} AS DOUBLE)" for name, feat, *_ in SPACE)


def _trials_ctes(n_trials, seed=42):
    from ..plans import oracle as O
    trials = trial_params(n_trials, seed)
    names = [s[0] for s in SPACE]
    lst = "[" + ", ".join(_sql_score(p) for p in trials) + "]"
    params = " UNION ALL ".join(
        "SELECT " + f"{p['trial']} AS trial, " + ", ".join(f"CAST({p[n]!r} AS DOUBLE) AS {n}" for n in names)
        for p in trials)
    return O.split_ctes("featured") + f""",
val AS (SELECT f.* FROM featured f JOIN assigned a USING (job_id) WHERE a.split = 'val'),
ts AS (SELECT fraudulent AS y_true, unnest(range({n_trials})) AS trial, unnest({lst}) AS y_proba FROM val),
{O.curve_ctes("ts", ["trial"])},
ap AS (SELECT trial, {O.AP} AS val_ap FROM curve GROUP BY trial),
params AS ({params}),
trials AS (SELECT params.*, ap.val_ap FROM params JOIN ap USING (trial))"""


def trials_sql(n_trials, seed=42):
    from ..plans import oracle as O
    names = [s[0] for s in SPACE]
    return O.with_postings("SELECT trial, " + ", ".join(f"round({n}, 6) AS {n}" for n in names)
                           + ", round(val_ap, 6) AS val_ap FROM trials", _trials_ctes(n_trials, seed))


def best_so_far_sql(n_trials, seed=42):
    from ..plans import oracle as O
    return O.with_postings("""SELECT trial, round(val_ap, 6) AS val_ap,
  round(max(val_ap) OVER (ORDER BY trial ROWS UNBOUNDED PRECEDING), 6) AS best_so_far FROM trials""",
                           _trials_ctes(n_trials, seed))


def param_effect_sql(n_trials, seed=42, bins=4):
    from ..plans import oracle as O
    names = [s[0] for s in SPACE]
    unp = " UNION ALL ".join(f"SELECT trial, val_ap, '{n}' AS param, {n} AS value FROM trials" for n in names)
    return O.with_postings(f"""SELECT param, round(CASE WHEN total > 0 THEN between_ / total ELSE 0 END, 6) AS effect
FROM (SELECT param, sum(n * (m - mu) * (m - mu)) / sum(n) AS between_ FROM (
        SELECT param, bin, count(*) AS n, avg(val_ap) AS m, max(mu) AS mu FROM (
          SELECT *, ntile({bins}) OVER (PARTITION BY param ORDER BY value, trial) AS bin,
                 avg(val_ap) OVER (PARTITION BY param) AS mu FROM lng) GROUP BY param, bin) GROUP BY param)
JOIN (SELECT param, var_pop(val_ap) AS total FROM lng GROUP BY param) USING (param)""",
                           _trials_ctes(n_trials, seed) + f",\nlng AS ({unp})")


def best_trial(trials: DataFrame):
    """Parameters of the highest val-AP trial (ties -> lowest trial number)."""
    row = trials.orderBy(F.desc("val_ap"), F.asc("trial")).first()
    return {s[0]: row[s[0]] for s in SPACE} | {"trial": row["trial"]}


def rule_scores(df: DataFrame, params: dict, label: str = S.TARGET, id_col: str = S.ID) -> DataFrame:
    """Score rows with one linear rule (model, split, job_id, y_true, y_proba)."""
    return df.select(F.lit("best_rule").alias("model"), "split", id_col,
                     F.col(label).cast("int").alias("y_true"), _score_expr(params).alias("y_proba"))


def contribution_summary(df: DataFrame, params: dict) -> DataFrame:
    """Mean absolute contribution per feature of a linear rule: w * (x - mean(x))."""
    means = df.agg(*[F.avg(F.col(feat).cast("double")).alias(feat) for _, feat, *_ in SPACE]).first()
    cols = [F.abs(F.lit(params[name]) * (F.col(feat).cast("double") - F.lit(means[feat]))).alias(feat)
            for name, feat, *_ in SPACE]
    wide = df.select(*cols).agg(*[F.avg(feat).alias(feat) for _, feat, *_ in SPACE])
    feats = [feat for _, feat, *_ in SPACE]
    return wide.unpivot([], feats, "feature", "mean_abs_contribution")
