"""Session construction and shared-storage helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter for every job in the library. On a cluster the
# deployment sets sizes (executors, shuffle partitions); these are defaults
# that keep the plan adaptive and the semantics fixed (UTC, ANSI on).
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "tarmac") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names it; only when it is unset (local tests) a folder is
    created here. Lineage cuts and scratch tables live below it, never in a
    machine-local temporary folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="tarmac-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tarmac-scratch/{name}-{uuid.uuid4().hex[:12]}"


def glob_exists(spark: SparkSession, pattern: str) -> bool:
    """Whether a glob matches anything, on any Hadoop file system."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(pattern)
    found = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hpath)
    return found is not None and len(found) > 0


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop FileSystem API (works for any scheme)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def _file_system(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath, hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _children(spark: SparkSession, path: str) -> list:
    hpath, fs = _file_system(spark, path)
    return list(fs.listStatus(hpath)) if fs.exists(hpath) else []


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, bytes) of the files in a folder, on any Hadoop file system;
    nothing for an absent one."""
    return [(s.getPath().getName(), s.getLen()) for s in _children(spark, path) if s.isFile()]


def list_folders(spark: SparkSession, path: str) -> list[str]:
    return [s.getPath().getName() for s in _children(spark, path) if s.isDirectory()]


def read_text_file(spark: SparkSession, path: str) -> str:
    """The content of one small file."""
    hpath, fs = _file_system(spark, path)
    stream = fs.open(hpath)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish_text_file(spark: SparkSession, path: str, text: str) -> None:
    """Write one small file so that readers see it whole or not at all; an
    error if the path is taken."""
    jvm = spark.sparkContext._jvm
    hpath, fs = _file_system(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(hpath.getParent(), f".{hpath.getName()}.{uuid.uuid4().hex[:12]}")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(hpath), no_options)
    except Exception:
        fs.delete(draft, False)
        raise


def delete_file(spark: SparkSession, path: str) -> None:
    hpath, fs = _file_system(spark, path)
    fs.delete(hpath, False)
