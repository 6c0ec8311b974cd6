"""Airport dimension."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac import schema as S


def airports_dim(raw: DataFrame, country: str = "US", order_col: str = "ordinal") -> DataFrame:
    """Country filter, 8 columns, ``faa_code = coalesce(iata, local)``, rows
    without code or coordinates dropped, first row per code in file order.

    Keep-first is ``min_by(struct, ordinal)`` per code: a partial aggregate
    (one row per code per task before the shuffle), no sort, no window.
    Without an ordinal column, file order is used: file path, block start,
    then the position inside the block (Spark numbers splits by size, not by
    name). A table that isn't read from files keeps its partition order.
    """
    if order_col not in raw.columns:
        raw = raw.withColumn(order_col, file_order(raw))
    keep = [order_col] + S.AIRPORT_KEEP_COLUMNS
    df = (raw.where(F.col("iso_country") == country)
             .select(*keep)
             .withColumn("faa_code", F.coalesce("iata_code", "local_code"))
             .dropna(subset=["faa_code", "latitude_deg", "longitude_deg"]))
    cols = keep
    first = (df.groupBy("faa_code")
               .agg(F.min_by(F.struct(*cols), F.col(order_col)).alias("r")))
    return first.select(*[F.col(f"r.{c}").alias(c) for c in cols], "faa_code")


def file_order(raw: DataFrame):
    """Struct that orders rows as their files do."""
    row = F.monotonically_increasing_id()
    try:
        raw.select("_metadata.file_path")
    except AnalysisException:
        return row
    return F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), row.alias("row"))


def airport_coords(dim: DataFrame) -> DataFrame:
    """``(faa_code, lat, lon)`` projection of the dimension."""
    return dim.select("faa_code", F.col("latitude_deg").alias("lat"), F.col("longitude_deg").alias("lon"))


def airport_lookup(codes: DataFrame, dim: DataFrame, code_col: str = "airport") -> DataFrame:
    """Coordinates for many codes at once; unknown codes get nulls."""
    coords = airport_coords(dim)
    return codes.join(coords, codes[code_col] == coords["faa_code"], "left").drop("faa_code")


def flights_with_coords(flights: DataFrame, dim: DataFrame) -> DataFrame:
    """Left join flights x airports on ``airport = faa_code``."""
    return airport_lookup(flights, dim, "airport")


def airport_points(dim: DataFrame) -> DataFrame:
    """Map points: latitude/longitude, rows with a missing coordinate dropped."""
    return (dim.select(F.col("latitude_deg").alias("latitude"), F.col("longitude_deg").alias("longitude"))
               .dropna())


def airport_labels(dim: DataFrame, order_col: str = "ordinal",
                   code_cols: tuple[str, ...] = ("iata_code", "faa_code", "ident")) -> DataFrame:
    """``code -> "{city}: {name} ({region})"``; the last write wins in
    (row order, code column order); blank names and codes are skipped; codes
    are trimmed and upper-cased."""
    present = [c for c in code_cols if c in dim.columns]
    name_ok = F.col("name").isNotNull() & (F.trim("name") != "")
    label = F.col("name")
    label = F.when(F.col("municipality").isNotNull(), F.concat(F.col("municipality"), F.lit(": "), label)).otherwise(label)
    label = F.when(F.col("iso_region").isNotNull(), F.concat(label, F.lit(" ("), F.col("iso_region"), F.lit(")"))).otherwise(label)
    base = dim.where(name_ok).select(order_col, label.alias("label"), *present)
    codes = F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.col(c).cast("string").alias("code"))
                                for i, c in enumerate(present)])).alias("c")
    long = (base.select(order_col, "label", codes)
                .select(order_col, "label", F.col("c.rank").alias("code_rank"),
                        F.upper(F.trim(F.col("c.code"))).alias("code"))
                .where(F.col("code").isNotNull() & (F.col("code") != "")))
    return (long.groupBy("code")
                .agg(F.max_by("label", F.struct(F.col(order_col), F.col("code_rank"))).alias("label")))


# Preset code -> display name pairs of the scoring form.
CARRIER_PRESETS = [
    ("AA", "American Airlines Inc."),
    ("DL", "Delta Air Lines Inc."),
    ("UA", "United Air Lines Inc."),
    ("9E", "Endeavor Air Inc."),
]
AIRPORT_PRESETS = [
    ("JFK", "New York, NY: John F. Kennedy International"),
    ("ATL", "Atlanta, GA: Hartsfield-Jackson Atlanta International"),
    ("DHN", "Dothan, AL: Dothan Regional"),
]


def preset_names(records: DataFrame, carriers: DataFrame, airports: DataFrame) -> DataFrame:
    """Attach display names to carrier and airport codes; unknown codes ->
    null. AQE broadcasts the name dimensions from their measured sizes."""
    c = carriers.select(F.col("code").alias("carrier"), F.col("name").alias("carrier_display"))
    a = airports.select(F.col("code").alias("airport"), F.col("name").alias("airport_display"))
    return records.join(c, "carrier", "left").join(a, "airport", "left")
