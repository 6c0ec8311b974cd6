"""Distributed running sums and exact quantiles.

Running sums. Exact order statistics usually end in one ``Window.orderBy``
over all rows, which runs in a single task. ``prefix_sum`` splits the work the
way a sort is split:

1. rows are cut into ordered ranges of (key, value), the slices,
2. each slice's total per key is computed (rows: slices x keys, bounded),
3. slice offsets are a running sum over that small table, joined back
   (AQE broadcasts it when its measured size is small),
4. the running sum inside a slice is a window partitioned by the slice.

No task ever holds more than one slice, whatever the skew of the key: a hot
key is spread over many slices by its own boundaries. The rows are
range-partitioned by (key, value) and written once to the shared folder
together with their partition number, which is the slice id. Every branch of
the plan and every recomputation after a lost executor reads the same table,
so they agree.

Quantiles. ``exact_quantiles`` moves no values at all. It selects by radix:
doubles become whole numbers of the same order, a histogram of the leading
16 bits says in which cell a wanted rank lies, and only rows of such cells are
counted again by the next 16 bits, at most four times. Counts are partial
aggregates, so what is shuffled is bounded by tasks x cells, whatever the
number of rows; the price is one read of the value column per round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.session import scratch_path

_BITS = 16                  # of the sort key, per round
_HIDDEN = 1 << 52           # mantissa steps of a double per power of two
_TOP = 2047 << 52           # sort key of infinity


def _sliced(df: DataFrame, keys: list[str], order_col: str, n: int | None) -> DataFrame:
    """Add ``_slice``: the rows in contiguous ranges of (keys, value), ordered
    by slice id inside a key. A hot key spreads over many slices. ``n`` fixes
    the number of slices, else AQE sizes them."""
    cols = [*keys, order_col]
    ranged = df.repartitionByRange(n, *cols) if n else df.repartitionByRange(*cols)
    path = scratch_path(df.sparkSession, "slices")
    ranged.withColumn("_slice", F.spark_partition_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def prefix_sum(df: DataFrame, keys: list[str], order_col: str, weight_col: str,
               out_col: str = "cum_before", n_slices: int | None = None) -> DataFrame:
    """Add ``out_col`` = sum of ``weight_col`` over rows of the same ``keys``
    with a smaller ``order_col`` (exclusive running sum). ``(keys, order_col)``
    must be unique (pre-aggregate first) and keys non-null."""
    sliced = _sliced(df, keys, order_col, n_slices)
    totals = sliced.groupBy("_slice", *keys).agg(F.sum(weight_col).alias("_slice_total"))
    w_off = (Window.partitionBy(*keys).orderBy("_slice")
             .rowsBetween(Window.unboundedPreceding, -1)) if keys else \
        Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # offsets has (slices x distinct keys) rows. It is small for few keys but
    # grows with the caller's key cardinality, so no broadcast hint: AQE
    # broadcasts it at runtime from the measured size, else a shuffle join.
    offsets = totals.select(
        "_slice", *keys,
        F.coalesce(F.sum("_slice_total").over(w_off), F.lit(0)).alias("_offset"))
    w_local = (Window.partitionBy("_slice", *keys).orderBy(order_col)
               .rowsBetween(Window.unboundedPreceding, -1))
    local = sliced.withColumn("_local", F.coalesce(F.sum(weight_col).over(w_local), F.lit(0)))
    return (local.join(offsets, ["_slice", *keys])
                 .withColumn(out_col, F.col("_offset") + F.col("_local"))
                 .drop("_slice", "_offset", "_local"))


def sort_key(value: Column) -> Column:
    """A whole number per double, in the same order: sign and magnitude of
    (exponent, mantissa). Zeros of either sign are equal, NaN is above
    infinity and every NaN equal. All steps are exact: powers of two and
    divisions by them lose nothing."""
    v = value.cast("double")
    a = F.abs(v)
    guess = F.floor(F.log2(a)).cast("int")      # may be off by one beside a power of two
    guess = F.greatest(F.least(guess, F.lit(1023)), F.lit(-1022))
    exact = guess + F.when(F.pow(F.lit(2.0), guess) > a, -1).when(F.pow(F.lit(2.0), guess + 1) <= a, 1).otherwise(0)
    exponent = F.greatest(exact, F.lit(-1022))
    scaled = a / F.pow(F.lit(2.0), exponent)    # in [1, 2), below 1 for subnormal numbers
    magnitude = (exponent + 1022).cast("long") * _HIDDEN + (scaled * float(_HIDDEN)).cast("long")
    magnitude = (F.when(F.isnan(v), F.lit(_TOP + 1)).when(a == F.lit(float("inf")), F.lit(_TOP))
                 .when(a == 0, F.lit(0).cast("long")).otherwise(magnitude))
    return F.when(v < 0, -magnitude).otherwise(magnitude)


def from_sort_key(key: Column) -> Column:
    """The double of a sort key (zero without a sign)."""
    a = F.abs(key)
    exponent = F.shiftright(a, 52).cast("int")
    mantissa = a.bitwiseAND(F.lit(_HIDDEN - 1)).cast("double")
    v = (F.when(a > _TOP, F.lit(float("nan"))).when(a == _TOP, F.lit(float("inf")))
         .when(exponent == 0, mantissa / float(_HIDDEN) * F.lit(2.0 ** -1022))
         .otherwise((mantissa / float(_HIDDEN) + 1) * F.pow(F.lit(2.0), exponent - 1023)))
    return F.when(key < 0, -v).otherwise(v)


def exact_quantiles(df: DataFrame, keys: list[str], value_col: str, probs: list[float], n_slices: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (numpy/pandas default,
    DuckDB ``quantile_cont``, Spark ``percentile``) per key.

    Returns ``(keys..., prob, quantile)``. Null values and rows with a null
    key are ignored (callers' keys are column names or class labels); an empty
    table gives no row. Each round counts the cells of ``_BITS`` further bits
    inside the cells that hold a wanted rank (at most 2^16 cells per key and
    wanted cell, each with its smallest and largest value). A rank is found
    when its cell has one value, or when it is the cell's first or last. The
    wanted cells, keys x probs x 2 rows, are a written table, so Spark
    broadcasts it by its file size and shuffles both sides beyond that.
    ``n_slices`` is taken as ``prefix_sum`` takes it; no slices are cut here,
    so any number gives the same rows.
    """
    spark = df.sparkSession
    cond = F.col(value_col).isNotNull()
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    rows = df.where(cond).select(*keys, sort_key(F.col(value_col)).alias("_k"))
    at = [*keys, "_prefix"]
    rank, first = F.col("_rank"), F.col("_upto") - F.col("_n")
    h = F.col("prob") * (F.col("_all") - 1)
    found, wanted = [], None
    for shift in range(64 - _BITS, -1, -_BITS):
        prefix = F.lit(0).cast("long") if wanted is None else F.shiftright("_k", shift + _BITS)
        here = rows.withColumn("_prefix", prefix)
        if wanted is not None:
            here = here.join(wanted.select(*at).distinct(), at, "left_semi")
        inside = Window.partitionBy(*at)
        cells = (here.groupBy(*at, F.shiftright("_k", shift).alias("_cell"))
                 .agg(F.count(F.lit(1)).alias("_n"), F.min("_k").alias("_low"), F.max("_k").alias("_high"))
                 .withColumn("_upto", F.sum("_n").over(inside.orderBy("_cell"))))
        if wanted is None:
            ranks = (cells.withColumn("_all", F.sum("_n").over(inside))
                     .withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
                     .withColumn("_side", F.explode(F.array(F.lit("lo"), F.lit("hi"))))
                     .withColumn("_frac", h - F.floor(h))
                     .withColumn("_rank", F.when(F.col("_side") == "lo", F.floor(h)).otherwise(F.ceil(h)).cast("long")))
        else:
            ranks = cells.join(wanted, at)
        value = F.when((F.col("_low") == F.col("_high")) | (rank == first), F.col("_low")).when(rank == F.col("_upto") - 1, F.col("_high"))
        path = scratch_path(spark, "ranks")
        (ranks.where((rank >= first) & (rank < F.col("_upto")))
         .select(*keys, F.col("_cell").alias("_prefix"), "prob", "_side", "_frac", (rank - first).alias("_rank"), value.alias("_value"))
         .write.parquet(path))
        done = spark.read.parquet(path)
        found.append(done.where("_value IS NOT NULL"))
        wanted = done.where("_value IS NULL").drop("_value")
        if wanted.isEmpty():
            break
    hits = reduce(DataFrame.unionByName, found)
    v = from_sort_key(F.col("_value"))
    return (hits.groupBy(*keys, "prob", "_frac")
                .agg(F.max(F.when(F.col("_side") == "lo", v)).alias("_lo"), F.max(F.when(F.col("_side") == "hi", v)).alias("_hi"))
                .select(*keys, "prob", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo"))
                        .otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")).alias("quantile")))
