"""Exploratory statistics.

Every statistic is one aggregate pass with partial (map-side) aggregation; the
only driver-side values are per-*column* numbers (bounded by the schema width,
never by the data): variances used to choose columns and the column lists.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.operators.contract import numeric_columns
from tarmac.operators.ranks import exact_quantiles


def _q(c: str):
    return F.col(f"`{c}`")


def mean_by(df: DataFrame, key: str, value: str = "delay_rate", alias: str = "mean_delay_rate",
            descending: bool = False) -> DataFrame:
    """Mean of ``value`` per ``key`` (A2 by month, A3 by carrier sorted desc)."""
    out = df.groupBy(key).agg(F.avg(value).alias(alias))
    return out.orderBy(F.col(alias).desc(), F.col(key)) if descending else out.orderBy(key)


def target_distribution(df: DataFrame, target: str = "high_delay_risk") -> DataFrame:
    """Counts and ratios of the target; the total is a scalar subquery."""
    total = df.select(F.count(F.lit(1))).scalar()
    return (df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
              .withColumn("ratio", F.col("n") / total))


def missing_rates(df: DataFrame) -> DataFrame:
    """Share of missing (null or NaN) values per column, one pass, sorted desc."""
    cols = df.columns
    types = dict(df.dtypes)

    def miss(c):
        m = _q(c).isNull()
        if types[c] in ("double", "float"):
            m = m | F.isnan(_q(c))
        return F.avg(m.cast("double")).alias(c)

    wide = df.agg(*[miss(c) for c in cols])
    return (wide.unpivot([], cols, "column_name", "missing_rate")
                .orderBy(F.col("missing_rate").desc(), F.col("column_name")))


def long_form(df: DataFrame, cols: list[str], name: str = "column_name", value: str = "value") -> DataFrame:
    """Numeric columns to ``(column, value)`` rows (cast to double)."""
    return df.select(*[_q(c).cast("double").alias(c) for c in cols]).unpivot([], cols, name, value)


def quantiles(lf: DataFrame, keys: list[str], value: str, probs: list[float], exact: bool = True,
              accuracy: int = 100_000) -> DataFrame:
    """``(keys..., prob, quantile)``: exact (distributed ranks) or, for very
    large inputs, ``percentile_approx`` (a mergeable sketch per key, partial
    aggregation, memory bounded by ``accuracy``)."""
    if exact:
        return exact_quantiles(lf, keys, value, probs)
    arr = F.percentile_approx(value, probs, accuracy)
    return (lf.groupBy(*keys).agg(arr.alias("_q"))
              .select(*keys, F.posexplode("_q").alias("_i", "quantile"))
              .withColumn("prob", F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("_i") + 1))
              .select(*keys, "prob", "quantile"))


def describe_numeric(df: DataFrame, cols: list[str] | None = None, exact: bool = True) -> DataFrame:
    """count, mean, sample std, min, 25/50/75 % (linear; exact by default),
    max per column."""
    cols = cols or numeric_columns(df)
    lf = long_form(df, cols).where(F.col("value").isNotNull() & ~F.isnan("value"))
    base = lf.groupBy("column_name").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    q = quantiles(lf, ["column_name"], "value", [0.25, 0.5, 0.75], exact)
    qw = q.groupBy("column_name").agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("quantile"))).alias("p25"),
        F.max(F.when(F.col("prob") == 0.5, F.col("quantile"))).alias("p50"),
        F.max(F.when(F.col("prob") == 0.75, F.col("quantile"))).alias("p75"))
    return base.join(qw, "column_name", "left").select(
        "column_name", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def column_info(df: DataFrame) -> DataFrame:
    """column, dtype, non-null count (one pass)."""
    cols = df.columns
    counts = df.agg(*[F.count(_q(c)).alias(c) for c in cols]).unpivot([], cols, "column_name", "non_null")
    spark = df.sparkSession
    types = spark.createDataFrame([(c, t) for c, t in df.dtypes], "column_name string, dtype string")
    return types.join(counts, "column_name")


def histogram(df: DataFrame, cols: list[str], bins: int = 50) -> DataFrame:
    """Equal-width histogram per column, last bin closed, empty bins kept.

    ``(column, bin, lo, hi, count)``. Per-column min/max are one aggregate
    (rows = columns) joined back; the bin grid is ``columns x bins`` rows.
    """
    lf = long_form(df, cols).where(F.col("value").isNotNull() & ~F.isnan("value"))
    rng = (lf.groupBy("column_name").agg(F.min("value").alias("vmin"), F.max("value").alias("vmax"))
             .withColumn("lo", F.when(F.col("vmin") == F.col("vmax"), F.col("vmin") - 0.5)
                         .otherwise(F.col("vmin")))
             .withColumn("hi", F.when(F.col("vmin") == F.col("vmax"), F.col("vmax") + 0.5)
                         .otherwise(F.col("vmax")))
             .withColumn("width", (F.col("hi") - F.col("lo")) / bins)
             .select("column_name", "lo", "hi", "width"))
    binned = (lf.join(F.broadcast(rng), "column_name")
                .withColumn("bin", F.least(F.floor((F.col("value") - F.col("lo")) / F.col("width")),
                                           F.lit(bins - 1)).cast("int"))
                .groupBy("column_name", "bin").agg(F.count(F.lit(1)).alias("count")))
    grid = (rng.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
               .select("column_name", "bin",
                       (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_lo"),
                       F.when(F.col("bin") == bins - 1, F.col("hi"))
                        .otherwise(F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_hi")))
    return (grid.join(binned, ["column_name", "bin"], "left")
                .select("column_name", "bin", "bin_lo", "bin_hi",
                        F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def density_curve(df: DataFrame, cols: list[str], gridsize: int = 200, exact: bool = True,
                  bins: int = 8192) -> DataFrame:
    """Gaussian KDE per column on ``gridsize`` points spanning [min, max]
    (Scott bandwidth ``std_samp * n^(-1/5)``).

    Data are first collapsed to distinct values with counts; each distinct
    value meets the bounded grid of its column (broadcast), and the sums are
    partial-aggregated per grid point. Work is distinct values x grid; with
    ``exact=False`` values are first collapsed to ``bins`` equal-width bin
    centres per column (binned KDE), so the work no longer grows with the
    data (error bounded by the bin width, far below the bandwidth).
    """
    lf = long_form(df, cols).where(F.col("value").isNotNull() & ~F.isnan("value"))
    stats = (lf.groupBy("column_name").agg(F.count("value").alias("n"), F.stddev_samp("value").alias("sd"),
                                      F.min("value").alias("vmin"), F.max("value").alias("vmax"))
               .withColumn("bw", F.col("sd") * F.pow(F.col("n"), F.lit(-0.2))))
    grid = (stats.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(gridsize - 1))))
                 .withColumn("x", F.col("vmin") + (F.col("vmax") - F.col("vmin")) * F.col("i") / (gridsize - 1))
                 .select("column_name", "i", "x", "bw", "n"))
    if not exact:
        rng = stats.select("column_name", "vmin", ((F.col("vmax") - F.col("vmin")) / bins).alias("bw_bin"))
        b = F.least(F.floor((F.col("value") - F.col("vmin")) / F.col("bw_bin")), F.lit(bins - 1))
        centre = F.when(F.col("bw_bin") > 0, F.col("vmin") + (b + 0.5) * F.col("bw_bin")).otherwise(F.col("vmin"))
        lf = lf.join(F.broadcast(rng), "column_name").select("column_name", centre.alias("value"))
    distinct = lf.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("w"))
    z = (F.col("x") - F.col("value")) / F.col("bw")
    dens = (distinct.join(F.broadcast(grid), "column_name")
                    .groupBy("column_name", "i", "x", "bw", "n")
                    .agg(F.sum(F.col("w") * F.exp(-0.5 * z * z)).alias("k")))
    return dens.select("column_name", "i", "x",
                       (F.col("k") / (F.col("n") * F.col("bw") * F.lit(math.sqrt(2 * math.pi)))).alias("density"))


def boxplot_stats(df: DataFrame, cols: list[str], whis: float = 1.5, exact: bool = True) -> DataFrame:
    """Q1, median, Q3, whiskers (furthest points within whis*IQR) and outlier
    count per column."""
    lf = long_form(df, cols).where(F.col("value").isNotNull() & ~F.isnan("value"))
    q = quantiles(lf, ["column_name"], "value", [0.25, 0.5, 0.75], exact)
    qw = (q.groupBy("column_name").agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("quantile"))).alias("q1"),
        F.max(F.when(F.col("prob") == 0.5, F.col("quantile"))).alias("median"),
        F.max(F.when(F.col("prob") == 0.75, F.col("quantile"))).alias("q3"))
        .withColumn("lo_fence", F.col("q1") - whis * (F.col("q3") - F.col("q1")))
        .withColumn("hi_fence", F.col("q3") + whis * (F.col("q3") - F.col("q1"))))
    v = F.col("value")
    inside = (v >= F.col("lo_fence")) & (v <= F.col("hi_fence"))
    return (lf.join(F.broadcast(qw), "column_name")
              .groupBy("column_name", "q1", "median", "q3")
              .agg(F.min(F.when(inside, v)).alias("whisker_lo"),
                   F.max(F.when(inside, v)).alias("whisker_hi"),
                   F.count(F.when(~inside, v)).alias("n_outliers")))


def column_variances(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols or numeric_columns(df)
    wide = df.agg(*[F.var_samp(_q(c).cast("double")).alias(c) for c in cols])
    return wide.unpivot([], cols, "column_name", "variance")


def nonconstant_columns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Numeric columns with sample variance > 0 (``column, keep``)."""
    return (column_variances(df, cols)
            .select("column_name", F.coalesce(F.col("variance") > 0, F.lit(False)).cast("int").alias("keep")))


def nonconstant_names(df: DataFrame, cols: list[str] | None = None) -> list[str]:
    """Names of the non-constant columns, in schema order (bounded: one value
    per column reaches the driver)."""
    cols = cols or numeric_columns(df)
    keep = {r["column_name"] for r in nonconstant_columns(df, cols).where("keep = 1").collect()}
    return [c for c in cols if c in keep]


def comoments(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise-complete co-moment sums for every column pair (i > j).

    One pass: each task folds its rows into small numpy matrices (``n``,
    sums, sums of squares and cross products over rows where both values are
    present, data centred by the global means for numerical stability) and
    emits one row per pair; Spark sums those rows per pair. Output per task
    is bounded by the number of pairs, never by the rows.
    """
    import numpy as np
    import pandas as pd

    means = df.agg(*[F.avg(_q(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    shift = np.array([means[f"m{i}"] if means[f"m{i}"] is not None else 0.0 for i in range(len(cols))])
    k = len(cols)
    ii, jj = np.tril_indices(k, -1)

    def fold(it):
        n = np.zeros((k, k)); sx = np.zeros((k, k)); sxx = np.zeros((k, k)); sxy = np.zeros((k, k))
        seen = False
        for pdf in it:
            if pdf.empty:
                continue
            seen = True
            X = pdf.to_numpy(dtype="float64") - shift
            M = (~np.isnan(X)).astype("float64")
            X0 = np.where(M > 0, X, 0.0)
            n += M.T @ M                 # rows where both present
            sx += X0.T @ M               # sum of x_i where j present
            sxx += (X0 * X0).T @ M       # sum of x_i^2 where j present
            sxy += X0.T @ X0             # cross products (zero when either missing)
        if seen:
            yield pd.DataFrame({"i": ii.astype("int32"), "j": jj.astype("int32"), "n": n[ii, jj],
                                "sx": sx[ii, jj], "sy": sx[jj, ii], "sxx": sxx[ii, jj],
                                "syy": sxx[jj, ii], "sxy": sxy[ii, jj]})

    src = df.select(*[_q(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    parts = src.mapInPandas(fold, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ["n", "sx", "sy", "sxx", "syy", "sxy"]])


def _corr_expr():
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    vy = F.col("syy") - F.col("sy") * F.col("sy") / n
    return F.when((n >= 2) & (vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))


def corr_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation, pairwise complete, lower triangle: ``(a, b, corr)``
    for every pair with b before a in ``cols``."""
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "idx int, name string")
    cm = comoments(df, cols)
    return (cm.join(F.broadcast(names.select(F.col("idx").alias("i"), F.col("name").alias("a"))), "i")
              .join(F.broadcast(names.select(F.col("idx").alias("j"), F.col("name").alias("b"))), "j")
              .select("a", "b", _corr_expr().alias("corr")))


def corr_target(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """|corr(col, target)| for each column (the target itself gives 1),
    sorted descending."""
    others = [c for c in cols if c != target]
    pairs = corr_pairs(df, [target] + others).where(F.col("b") == target)
    out = pairs.select(F.col("a").alias("column_name"), F.abs("corr").alias("abs_corr"))
    if target in cols:
        out = out.unionByName(df.sparkSession.createDataFrame([(target, 1.0)], "column_name string, abs_corr double"))
    return out.orderBy(F.col("abs_corr").desc_nulls_last(), "column_name")


def split_sizes(df: DataFrame, split_col: str = "split") -> DataFrame:
    """Rows and columns per split."""
    ncols = len([c for c in df.columns if c != split_col])
    return (df.groupBy(split_col).agg(F.count(F.lit(1)).alias("rows"))
              .withColumn("columns", F.lit(ncols).cast("long")))
