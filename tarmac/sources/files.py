"""Sources and sinks on files (S1-S14, S18). Explicit schemas everywhere."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac import schema as S
from tarmac.session import delete_file, list_files, list_folders, path_exists, publish_text_file, read_text_file

# Texts read as missing, like the pandas CSV reader's default NA tokens.
HISTORY_TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"   # ISO, microseconds kept
NA_TOKENS = ["", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "<NA>", "n/a", "#N/A"]


def _null_tokens(df: DataFrame, string_cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c).isin(NA_TOKENS), F.lit(None)).otherwise(F.col(c))
                           for c in string_cols})


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names from the header line only (no data scan, no inference)."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType,
                   required: list[str] | None = None) -> DataFrame:
    """Read a headered CSV whose columns must include ``required``: the header
    is checked first, then the file is read with the declared types (unknown
    extra columns as strings) and projected to the schema's columns."""
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    header = csv_header(spark, path)
    required = required or schema.fieldNames()
    miss = [c for c in required if c not in header]
    if miss:
        raise ValueError(f"missing columns in {path}: {miss}")
    known = {f.name: f.dataType for f in schema.fields}
    read_schema = T.StructType([T.StructField(c, known.get(c, T.StringType())) for c in header])
    # enforceSchema off: every file's own header must agree with the first
    # one's, so a file with its columns in another order is an error
    df = (spark.read.schema(read_schema).option("header", True).option("mode", "PERMISSIVE")
               .option("enforceSchema", False).option("nanValue", "NaN").csv(path))
    df = _null_tokens(df, [f.name for f in read_schema.fields if isinstance(f.dataType, T.StringType)])
    return df.select(*[f.name for f in schema.fields if f.name in header])


def read_flights_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw monthly table; fails on a missing file or column; keeps exactly
    the 21 required columns."""
    df = read_typed_csv(spark, path, S.FLIGHTS_RAW, S.REQUIRED_COLUMNS)
    return df.select(*S.REQUIRED_COLUMNS)


def read_airports_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Airport dimension file (empty text and NA tokens -> null)."""
    schema = schema or S.AIRPORTS_RAW
    return read_typed_csv(spark, path, schema)


def read_coordinates_csv(spark: SparkSession, path: str) -> DataFrame:
    """S3: static coordinates ``airport, lat, lon``."""
    return read_typed_csv(spark, path, S.COORDINATES)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Headered CSV; blank texts are kept as written (no whitespace trimming)."""
    (df.write.mode(mode).option("header", True)
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .csv(path))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "overwrite", dynamic: bool = False) -> None:
    """Parquet sink; with ``dynamic`` only the partitions present in ``df``
    are replaced."""
    w = df.write.mode(mode)
    if dynamic:
        w = w.option("partitionOverwriteMode", "dynamic")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def read_weather_archive(spark: SparkSession, path: str) -> DataFrame:
    """S4 source: landed archive documents (JSON lines, explicit schema)."""
    return spark.read.schema(S.WEATHER_ARCHIVE).json(path)


def read_weather_cache_lines(spark: SparkSession, path: str) -> DataFrame:
    """S5 source: cache text lines; an absent cache is an empty table."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "value string")
    return spark.read.text(path)


def write_splits(df: DataFrame, path: str, split_col: str = "split") -> None:
    """One table partitioned by split."""
    write_table(df, path, [split_col])


def load_splits(spark: SparkSession, path: str, splits: tuple[str, ...] = ("train", "val", "test"),
                split_col: str = "split") -> dict[str, DataFrame]:
    """Each split is a partition-pruned filter of one table; a missing
    split is an error."""
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    df = spark.read.parquet(path)
    for s in splits:
        if not path_exists(spark, f"{path}/{split_col}={s}"):
            raise FileNotFoundError(f"{path}/{split_col}={s}")
    return {s: df.where(F.col(split_col) == s).drop(split_col) for s in splits}


def read_with_fallback(spark: SparkSession, paths: list[str], schema: T.StructType | None = None,
                       fmt: str = "parquet") -> DataFrame | None:
    """The first path that exists, else None; an existing but unreadable
    source also gives None (the next candidate is not tried)."""
    for p in paths:
        if path_exists(spark, p):
            r = spark.read.format(fmt)
            if schema is not None:
                r = r.schema(schema)
            if fmt == "csv":
                r = r.option("header", True)
            try:
                return r.load(p)
            except Exception:  # noqa: BLE001 - unreadable source behaves as absent
                return None
    return None


# --------------------------------------------------------------- history
# Appends put files into the table's folder. A compaction puts larger copies of
# small ones into a hidden folder and then publishes a manifest, a numbered
# file that names the compacted files and those that they replace. What is live:
# the folder's own files without the replaced ones, and the compacted ones of
# the latest manifest.
COMPACT_BYTES = 128 << 20   # aimed size of a compacted file
_BINS_AT_ONCE = 64          # scans in one compaction job


def history_append(df: DataFrame, path: str) -> None:
    """Append scored entries (never rewrites earlier ones)."""
    df.select(*S.HISTORY_COLUMNS).write.mode("append").parquet(path)


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the latest manifest; (0, nothing) without one."""
    found = [x for x in list_files(spark, f"{path}/_manifest") if not x[0].startswith(".")]
    if not found:
        return 0, {"compacted": [], "replaced": []}
    last = max(name for name, _ in found)
    return int(last.split(".")[0]), json.loads(read_text_file(spark, f"{path}/_manifest/{last}"))


def history_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the live files. The manifest is read before the
    folder, so a compaction in between leaves the older set, which is whole."""
    _, m = _manifest(spark, path)
    gone = set(m["replaced"])
    own = [(f"{path}/{name}", size) for name, size in list_files(spark, path)
           if not name.startswith(("_", ".")) and name not in gone]
    return own + [(f"{path}/{name}", size) for name, size in m["compacted"]]


def history_load(spark: SparkSession, path: str) -> DataFrame:
    """Absent or corrupt history -> empty table with the schema (corrupt
    files are skipped when read); any other failure of the store is an error."""
    files = [f for f, _ in history_files(spark, path)] if path_exists(spark, path) else []
    if not files:
        return spark.createDataFrame([], S.HISTORY)
    return spark.read.schema(S.HISTORY).option("ignoreCorruptFiles", True).parquet(*files)


def pack(sizes: list[tuple[str, int]], limit: int) -> list[list[str]]:
    """Names in bins of at most ``limit`` bytes, largest first into the first
    bin with room; a bin of one name is left out, as nothing is won by it."""
    bins: list[list] = []
    open_from = 0
    for name, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        for b in bins[open_from:]:
            if b[0] + size <= limit:
                b[0] += size
                b[1].append(name)
                break
        else:
            bins.append([size, [name]])
        while open_from < len(bins) and bins[open_from][0] * 10 > limit * 9:
            open_from += 1
    return [names for _, names in bins if len(names) > 1]


def history_compact(spark: SparkSession, path: str, target_bytes: int = COMPACT_BYTES) -> int:
    """Rewrite live files below half of ``target_bytes`` into files of about
    that size; returns how many files were replaced. Rows don't change.

    Every bin is one scan folded into one task, so nothing is shuffled. The
    replaced files stay until ``history_vacuum``, so readers that listed them
    go on. The manifest's number is taken by an exclusive rename: of two
    compactions at once the second fails and leaves the first one's result. A
    corrupt file is an error here, not a loss.
    """
    number, m = _manifest(spark, path)
    live = [(f.removeprefix(f"{path}/"), size) for f, size in history_files(spark, path)]
    bins = pack([x for x in live if x[1] * 2 < target_bytes], target_bytes)
    if not bins:
        return 0
    folder = f"_compacted/{uuid.uuid4().hex[:12]}"
    for at in range(0, len(bins), _BINS_AT_ONCE):
        scans = [spark.read.schema(S.HISTORY).option("ignoreCorruptFiles", False).parquet(*[f"{path}/{n}" for n in names]).coalesce(1)
                 for names in bins[at:at + _BINS_AT_ONCE]]
        reduce(DataFrame.unionAll, scans).write.mode("append").parquet(f"{path}/{folder}")
    used = {n for names in bins for n in names}
    new = [[f"{folder}/{n}", size] for n, size in list_files(spark, f"{path}/{folder}") if n.endswith(".parquet")]
    publish_text_file(spark, f"{path}/_manifest/{number + 1:012d}.json", json.dumps({
        "compacted": [x for x in m["compacted"] if x[0] not in used] + new,
        "replaced": sorted(set(m["replaced"]) | {n for n in used if not n.startswith("_")})}))
    return len(used)


def history_vacuum(spark: SparkSession, path: str) -> int:
    """Delete the files that compactions have replaced, of manifests and of
    compacted folders all but what the latest manifest needs; returns how many.
    To be called when no reader holds a listing from before the compaction."""
    number, m = _manifest(spark, path)
    kept = {name for name, _ in m["compacted"]}
    stale = [n for n, _ in list_files(spark, path) if n in set(m["replaced"])]
    if number:
        stale += [f"_manifest/{n}" for n, _ in list_files(spark, f"{path}/_manifest")
                  if not n.startswith(".") and int(n.split(".")[0]) < number]
        for folder in list_folders(spark, f"{path}/_compacted"):
            stale += [f"_compacted/{folder}/{n}" for n, _ in list_files(spark, f"{path}/_compacted/{folder}")
                      if not n.startswith("_") and f"_compacted/{folder}/{n}" not in kept]
    for name in stale:
        delete_file(spark, f"{path}/{name}")
    return len(stale)


def history_export(spark: SparkSession, path: str, out: str) -> None:
    """Newest first as CSV. The global sort is range-partitioned, so
    part files in name order are newest first; no single task holds all rows."""
    (history_load(spark, path).orderBy(F.col("timestamp").desc())
        .write.mode("overwrite").option("header", True)
        .option("timestampFormat", HISTORY_TS_FORMAT).csv(out))


def history_read_export(spark: SparkSession, out: str) -> DataFrame:
    return (spark.read.schema(S.HISTORY).option("header", True)
                 .option("timestampFormat", HISTORY_TS_FORMAT).csv(out))


def history_clear(spark: SparkSession, path: str) -> None:
    """Overwrite with an empty table."""
    spark.createDataFrame([], S.HISTORY).write.mode("overwrite").parquet(path)
