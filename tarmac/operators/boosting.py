"""Second-order boosting on histograms (M3-M5).

Regularised boosted trees whose every parameter of the search space has an
effect: gains and leaf weights from gradient and hessian sums with an L2 term
(``reg_lambda``), an L1 term (``reg_alpha``), a least gain (``gamma``) and a
least hessian sum per child (``min_child_weight``).

Rows are binned once: a numeric column by its own quantiles, a categorical one
by value (splits are value against rest). A tree grows level by level; a
level is one aggregation of gradients and hessians by (node, slot), partial in
every task, so what is shuffled and reaches the driver is nodes x slots and
doesn't depend on the rows. Of two siblings only the smaller is aggregated;
the other is the parent less it. The driver picks each node's best split from those sums.
A row's node is a ``CASE`` over its slots, so no row is rewritten while a
tree grows; margins are written to the shared scratch folder every ``CUT_TREES``
trees, which bounds both expression and recomputation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.operators.ensembles import Node, margin_column, number, text
from tarmac.operators.ranks import exact_quantiles
from tarmac.session import scratch_path

SEED = 42
BINS = 32
CUT_TREES = 5
MAX_CATEGORIES = 4096       # values of a categorical column that get a slot, most frequent first; any other value is like null
DIGITS = 9                  # gains are compared to so many decimals; ties go to the first slot


@dataclass
class Bins:
    """Slots of the training columns. A numeric column with cuts c_0 < c_1 <
    ... has one slot for x <= c_0 (nulls too), one up to each further cut and
    one above; a categorical column one per value."""
    cuts: dict[str, list[float]]
    values: dict[str, list[str]]
    slot: list[tuple[str, int]] = field(default_factory=list)       # (column, place)
    first: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        for c, places in [(c, len(x) + 1) for c, x in self.cuts.items()] + [(c, len(x)) for c, x in self.values.items()]:
            self.first[c] = len(self.slot)
            self.slot += [(c, i) for i in range(places)]

    def column(self) -> Column:
        """Array with one slot per numeric column, then per categorical one
        (null where the value has no slot)."""
        out = []
        for c, cuts in self.cuts.items():
            x = F.col(c).cast("double")
            above = [F.when(x > F.lit(v), 1).otherwise(0) for v in cuts]
            out.append(sum(above, F.lit(self.first[c])))
        for c, values in self.values.items():
            place = F.array_position(F.array(*[F.lit(v) for v in values]).cast("array<string>"), F.col(c).cast("string"))
            out.append(F.when(place > 0, (place - 1 + self.first[c]).cast("int")))
        return F.array(*out)

    def splits(self) -> list[int]:
        """Slots that a split may name: every cut, every value."""
        return [s for s, (c, i) in enumerate(self.slot) if c in self.values or i < len(self.cuts[c])]

    def by_slot(self, s: int) -> str:
        c, _ = self.slot[s]
        at = f"slots[{list(self.first).index(c)}]"
        return f"{at} <= {s}" if c in self.cuts else f"{at} = {s}"

    def by_column(self, s: int) -> str:
        c, i = self.slot[s]
        if c in self.cuts:
            return f"coalesce(CAST({c} AS DOUBLE) <= {number(self.cuts[c][i])}, true)"
        return f"CAST({c} AS STRING) = {text(self.values[c][i])}"


def fit_bins(train: DataFrame, numeric: list[str], categorical: list[str], n_bins: int = BINS) -> Bins:
    """Exact quantile cuts (without the column's largest value, which splits
    nothing) and category lists, sorted."""
    probs = [i / n_bins for i in range(1, n_bins)]
    long = train.select(*[F.col(c).cast("double").alias(c) for c in numeric]).unpivot([], numeric, "column_name", "v")
    found: dict[str, set[float]] = {c: set() for c in numeric}
    for r in exact_quantiles(long.where(~F.isnan("v")), ["column_name"], "v", probs).collect() if numeric else []:
        found[r.column_name].add(r.quantile)
    top = train.agg(*[F.max(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(f"m{i}") for i, c in enumerate(numeric)]).first() if numeric else []
    cuts = {c: sorted(v for v in found[c] if v < top[i]) for i, c in enumerate(numeric)}
    values = {}
    for c in categorical:
        rows = (train.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
                .orderBy(F.desc("n"), "v").limit(MAX_CATEGORIES).collect())
        values[c] = sorted(r.v for r in rows)
    return Bins(cuts, values)


@dataclass(frozen=True)
class Params:
    n_estimators: int = 20
    max_depth: int = 5
    learning_rate: float = 0.1
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    min_child_weight: float = 1.0
    gamma: float = 0.0
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0


def soft(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def best_split(hist: np.ndarray, total: np.ndarray, bins: Bins, allowed: np.ndarray, p: Params) -> int | None:
    """Slot of the best split of a node. ``hist``: gradient and hessian sums by
    slot; ``total``: those of the node."""
    left = hist.copy()
    for c in bins.cuts:
        a = bins.first[c]
        b = a + len(bins.cuts[c]) + 1
        left[a:b] = np.cumsum(hist[a:b], axis=0)
    right = total - left
    least = max(p.min_child_weight, 1e-12)
    ok = allowed & (left[:, 1] >= least) & (right[:, 1] >= least)

    def part(x):
        return soft(x[..., 0], p.reg_alpha) ** 2 / np.maximum(x[..., 1] + p.reg_lambda, 1e-300)

    gain = np.round(0.5 * (part(left) + part(right) - part(total)) - p.gamma, DIGITS)
    gain[~ok] = -np.inf
    best = int(np.argmax(gain)) if len(gain) else 0
    return best if len(gain) and gain[best] > 0 else None


def leaf_weight(total: np.ndarray, p: Params) -> float:
    return float(-soft(total[0], p.reg_alpha) / (total[1] + p.reg_lambda) * p.learning_rate)


@dataclass
class _Growing:
    """A node of a tree under construction."""
    total: np.ndarray
    hist: np.ndarray | None = None
    rows: int = 0
    split: int | None = None
    left: int = -1
    right: int = -1


def _node_sql(nodes: list[_Growing], bins: Bins, i: int = 0) -> str:
    n = nodes[i]
    if n.split is None:
        return str(i)
    return f"CASE WHEN {bins.by_slot(n.split)} THEN {_node_sql(nodes, bins, n.left)} ELSE {_node_sql(nodes, bins, n.right)} END"


def _histograms(rows: DataFrame, node: str, wanted: list[int], n_slots: int) -> dict[int, tuple[np.ndarray, np.ndarray, int]]:
    """node -> (sums by slot, node's own sums, rows). Slot -1 stands for the
    whole node, so a value without a slot still counts there."""
    placed = rows.select(F.expr(node).alias("node"), "g", "h", F.explode(F.concat(F.array(F.lit(-1)), F.array_compact("slots"))).alias("slot"))
    sums = (placed.where(F.col("node").isin(wanted)).groupBy("node", "slot")
            .agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n")).toArrow().to_pydict())
    out = {i: (np.zeros((n_slots, 2)), np.zeros(2), [0]) for i in wanted}
    for i, s, g, h, n in zip(*(sums[k] for k in ("node", "slot", "g", "h", "n"))):
        if s < 0:
            out[i][1][:] = g, h
            out[i][2][0] = n
        else:
            out[i][0][s] = g, h
    return {i: (a, t, n[0]) for i, (a, t, n) in out.items()}


def grow(rows: DataFrame, bins: Bins, p: Params, allowed: np.ndarray) -> list[_Growing]:
    """One tree over rows (slots, g, h); a job per level."""
    hist, total, n = _histograms(rows, "0", [0], len(bins.slot))[0]
    nodes = [_Growing(total, hist, n)]
    level = [0]
    for depth in range(p.max_depth):
        split = []
        for i in level:
            nodes[i].split = best_split(nodes[i].hist, nodes[i].total, bins, allowed, p) if nodes[i].rows else None
            if nodes[i].split is not None:
                nodes[i].left, nodes[i].right = len(nodes), len(nodes) + 1
                nodes += [_Growing(np.zeros(2)), _Growing(np.zeros(2))]
                split.append(i)
        if not split:
            break
        # the smaller child by the row count of its side is not known before
        # aggregating, so the side with the smaller hessian sum stands for it
        built = {}
        for i in split:
            s, me = nodes[i].split, nodes[i]
            c, _ = bins.slot[s]
            left = me.hist[bins.first[c]:s + 1].sum(axis=0) if c in bins.cuts else me.hist[s]
            built[i] = me.left if left[1] * 2 <= me.total[1] else me.right
        got = _histograms(rows, _node_sql(nodes, bins), sorted(built.values()), len(bins.slot))
        for i in split:
            me, small = nodes[i], built[i]
            other = me.left + me.right - small
            nodes[small].hist, nodes[small].total, nodes[small].rows = got[small]
            nodes[other].hist, nodes[other].total = me.hist - got[small][0], me.total - got[small][1]
            nodes[other].rows = me.rows - got[small][2]
            me.hist = None
        level = [x for i in split for x in (nodes[i].left, nodes[i].right)]
    return nodes


def _as_node(nodes: list[_Growing], bins: Bins, p: Params, condition, i: int = 0) -> Node:
    n = nodes[i]
    if n.split is None:
        return Node(value=leaf_weight(n.total, p))
    return Node(condition=condition(n.split), left=_as_node(nodes, bins, p, condition, n.left), right=_as_node(nodes, bins, p, condition, n.right))


@dataclass
class Boosted:
    kind: str
    base: float
    trees: list[Node]           # over the raw columns

    def score(self, df: DataFrame, col: str) -> DataFrame:
        """``df`` with the probability (classifier) or predicted value."""
        m = margin_column(self.trees, self.base)
        return df.withColumn(col, 1.0 / (1.0 + F.exp(-m)) if self.kind == "classifier" else m)


def fit(train: DataFrame, numeric: list[str], categorical: list[str], label: str, kind: str, params: Params,
        n_bins: int = BINS, seed: int = SEED) -> Boosted:
    """Fit on the rows with a label. Squared error for a regressor, logistic
    loss for a classifier (label 0/1); the start is the label's mean, as log-odds.
    Nulls go with the smallest values of a numeric column and to "rest" in a
    categorical split; NaN is above every cut. One class, constant columns or
    no split worth ``gamma`` give trees of one leaf. Without rows it raises."""
    rows = train.where(F.col(label).isNotNull())
    total, mean = rows.agg(F.count(F.lit(1)), F.avg(F.col(label).cast("double"))).first()
    if not total:
        raise ValueError("no row with a label")
    if kind == "classifier":
        q = min(max(mean, 1e-6), 1 - 1e-6)
        base = math.log(q / (1 - q))
    else:
        base = mean
    bins = fit_bins(rows, numeric, categorical, n_bins)
    spark = train.sparkSession
    key = F.xxhash64(*[F.col(c).cast("string") for c in [*numeric, *categorical]], F.lit(seed))

    def written(df: DataFrame) -> DataFrame:
        path = scratch_path(spark, "boost")
        df.write.parquet(path)
        return spark.read.parquet(path)

    binned = written(rows.select(F.col(label).cast("double").alias("y"), bins.column().alias("slots"), F.lit(base).alias("f"), key.alias("key")))
    rng = np.random.default_rng(seed)
    columns = [*numeric, *categorical]
    out: list[Node] = []
    pending: list[Node] = []
    for t in range(params.n_estimators):
        keep = set(rng.choice(columns, max(1, round(params.colsample_bytree * len(columns))), replace=False)) if params.colsample_bytree < 1 else set(columns)
        allowed = np.zeros(len(bins.slot), bool)
        allowed[[s for s in bins.splits() if bins.slot[s][0] in keep]] = True
        if len(pending) == CUT_TREES:
            binned = written(binned.withColumn("f", F.col("f") + margin_column(pending)))
            pending = []
        f = F.col("f") + margin_column(pending)
        prob = 1.0 / (1.0 + F.exp(-f))
        g, h = (prob - F.col("y"), prob * (1.0 - prob)) if kind == "classifier" else (f - F.col("y"), F.lit(1.0))
        sampled = binned if params.subsample >= 1 else binned.where(F.pmod(F.xxhash64("key", F.lit(t)), F.lit(1 << 20)) < int(params.subsample * (1 << 20)))
        nodes = grow(sampled.select("slots", g.alias("g"), h.alias("h")), bins, params, allowed)
        pending.append(_as_node(nodes, bins, params, bins.by_slot))
        out.append(_as_node(nodes, bins, params, bins.by_column))
    return Boosted(kind, base, out)


def from_search(params: dict) -> Params:
    """A draw of ``models.sample_params``; all nine parameters count."""
    return Params(**{k: params[k] for k in Params.__dataclass_fields__ if k in params})
