"""Exact dedup by skew-safe combining.

Texts are equal when identical after deleting ASCII white space. Three
combining stages, each grouping by the full normalised content beside its
digest:

1. locally: the partial aggregate of every task,
2. salted: ``(digest, salt, content)``, the salt a hash of the row's id, so
   that the copies of a hot text meet in ``salts`` tasks and not in one,
3. globally: ``(digest, content)`` over the salt winners, at most ``salts``
   rows a text.

The groups come back to the rows by digest. Where one digest turns out to
stand for several contents, those rows (and only those) are matched by
content. A text held by a third of all rows costs ``salts`` rows in stage 3;
the join back is one that AQE splits, for its skewed side is the row side.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import WHITE, cut, text_or_empty

SALTS = 32
_TOP = Decimal(2 ** 63)
_SPAN = Decimal(2 ** 65)  # room for every 64-bit id, and below them all for a null id


def sha256_of(content: Column) -> Column:
    return F.sha2(content, 256)


def _order(points: Column, key: Column) -> Column:
    """One number that is larger for a better row: more code points, then the
    smaller id, then (last) no id. A decimal keeps the aggregate hash-based."""
    low = F.coalesce(F.lit(_TOP).cast("decimal(20,0)") - key.cast("decimal(20,0)"), F.lit(0).cast("decimal(21,0)"))
    return (points.cast("decimal(11,0)") * F.lit(_SPAN).cast("decimal(20,0)") + low).cast("decimal(38,0)")


def _id_of(order: Column) -> Column:
    low = order % F.lit(_SPAN).cast("decimal(38,0)")
    return F.when(low > 0, (F.lit(_TOP).cast("decimal(38,0)") - low).cast("long"))


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                salts: int = SALTS, digest=sha256_of) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept,
    text_sha256``.

    Of equal texts the row with the most code points in the original text,
    then the smallest id, stays. Null text counts as empty, empty texts are
    equal to each other. A null id loses every tie; if only null ids are
    best, ``keep_id`` is null and those rows are kept. Rows repeated with
    their id share one decision. An empty table gives an empty result; other
    columns, whatever their names, are not read.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.length(text).alias("points"),
                       F.regexp_replace(text, WHITE + "+", "").alias("content"))
    rows = rows.select("id", _order(F.col("points"), F.col("id")).alias("rank"),
                       digest(F.col("content")).alias("digest"), "content")
    salted = (rows.groupBy("digest", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"), "content")
              .agg(F.max("rank").alias("best"), F.count(F.lit(1)).alias("size")))
    texts = salted.groupBy("digest", "content").agg(F.max("best").alias("best"), F.sum("size").alias("size"))
    groups = cut(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("contents"), F.max("best").alias("best"),
                                             F.max("size").alias("size")))
    found = rows.join(groups.where("contents = 1"), "digest").select("id", "rank", "digest", "content", "best", "size")
    if not groups.where("contents > 1").isEmpty():
        shared = groups.where("contents > 1").select("digest")
        found = found.unionByName(
            rows.join(shared, "digest", "left_semi")
            .join(texts.join(shared, "digest", "left_semi"), ["digest", "content"])
            .select("id", "rank", "digest", "content", "best", "size"))
    sha = F.col("digest") if digest is sha256_of else sha256_of(F.col("content"))
    return found.select(F.col("id").alias(id_col), _id_of(F.col("best")).alias("keep_id"),
                        F.col("size").alias("group_size"), (F.col("rank") == F.col("best")).alias("kept"),
                        sha.alias("text_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
  FROM documents),
w AS (
  SELECT content, count(*) AS group_size,
         first(doc_id ORDER BY points DESC, doc_id) AS keep_id
  FROM d GROUP BY content)
SELECT d.doc_id, w.keep_id, w.group_size, d.doc_id = w.keep_id AS kept, sha256(d.content) AS text_sha256
FROM d JOIN w USING (content)
"""
