"""Quality rules with adaptive thresholds.

Fixed cutoffs are replaced by fences learnt per language and source from
mergeable quantile sketches. The sketch is a log-linear histogram of an
integer metric: values below 64 have a bucket each, larger ones keep their six
leading bits (relative error below 1/32). Sketches merge by adding counts, in
any order, so the result depends on the rows alone: the sketch of a language
is the sum of its sources' sketches, the corpus sketch the sum of all. Groups
with fewer than ``MIN_DOCS`` documents use their language's fences, and those
of a small language the corpus'.

Per metric: upper fence = q75 + reach * max(spread, least), for the mean word
length also the mirrored lower fence. The spread is q75 - q25 where junk
stands out from clean texts (up to a quarter of a group may be junk), and
q99 - q75 for repeated lines and words, which clean texts have too, most of
them none. ``least`` keeps the fence from closing where the spread is zero: it
is what a few counts make in a text of the group's lower-quartile length, so
groups of short texts have wider fences. Both sides are learnt from the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import cut
from tarmac.llm.textstats import base_stats

MIN_DOCS = 200
# metric: (expression in whole numbers, ends of the spread, reach, least spread:
# counts in a text of lower-quartile length, or as it stands without a length)
METRICS = {
    "word_length": ("100 * word_chars div n_words", ("q25", "q75"), 5, 25, None),
    "symbols": ("1000 * n_symbols div n_words", ("q25", "q75"), 5, 4, "n_words"),
    "dup_lines": ("1000 * n_dup_lines div n_lines", ("q75", "q99"), 2, 1, "n_lines"),
    "repeat_words": ("1000 * n_repeat_words div n_words", ("q75", "q99"), 4, 8, "n_words"),
}
LENGTHS = ["n_words", "n_lines"]        # sketched behind the metrics
QUANTILES = {"q25": 25, "q75": 75, "q99": 99}
SKETCHED = [x for x, *_ in METRICS.values()] + LENGTHS
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
STATS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               carry: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``id, carry..., n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words`` of every whole text (null: zeros)."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *carry)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            stats = zip(*(base_stats(t.as_py()) for t in b.column(1))) if b.num_rows else [[]] * len(STATS)
            cols = [b.column(i) for i in range(b.num_columns) if i != 1] + [pa.array(x, pa.int64()) for x in stats]
            yield pa.RecordBatch.from_arrays(cols, names=["id", *carry, *STATS])

    kinds = dict(plain.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("id", *carry))
    return plain.mapInArrow(batches, schema + "".join(f", {s} long" for s in STATS))


def bucket(value: Column) -> Column:
    """Lower end of the histogram bucket of a non-negative whole number."""
    drop = F.greatest(F.length(F.bin(value)) - F.lit(6), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., n, q25, q75, q99`` of sketches given as (keys..., bucket, n).
    A group has at most 64 + 32 * 58 buckets, so its window is bounded."""
    by = Window.partitionBy(*keys)
    running = by.orderBy("bucket")
    ranked = sketch.select(*keys, "bucket", F.sum("n").over(by).alias("total"), F.sum("n").over(running).alias("upto"))
    return ranked.groupBy(*keys).agg(
        F.first("total").alias("n"),
        *[F.min(F.when(F.col("upto") * 100 >= F.col("total") * percent, F.col("bucket"))).alias(k) for k, percent in QUANTILES.items()])


def fences(stats: DataFrame) -> DataFrame:
    """Fences of every (lang, source), one row each with an array of
    (low, high) in the order of METRICS. Nulls are a group of their own."""
    metric = F.explode(F.array(*[F.struct(F.lit(i).alias("metric"), F.expr(x).cast("long").alias("value"))
                                 for i, x in enumerate(SKETCHED)])).alias("m")
    finest = (stats.where(~base_failed()).select("lang", "source", metric)
              .groupBy("lang", "source", "m.metric", bucket(F.col("m.value")).alias("bucket"))
              .agg(F.count(F.lit(1)).alias("n")))
    merged = finest.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n"))
    whole = merged.groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
    here = quantiles(finest, ["lang", "source", "metric"])
    lang = quantiles(merged, ["lang", "metric"]).select(
        F.col("lang").alias("l"), F.col("metric").alias("lm"), F.struct("n", *QUANTILES).alias("of_lang"))
    corpus = quantiles(whole, ["metric"]).select(F.col("metric").alias("cm"), F.struct(*QUANTILES).alias("of_all"))
    q = (here.join(lang, here.lang.eqNullSafe(lang.l) & (here.metric == lang.lm)).join(corpus, F.col("metric") == F.col("cm")))
    chosen = [F.when(F.col("n") >= MIN_DOCS, F.col(k)).when(F.col("of_lang.n") >= MIN_DOCS, F.col(f"of_lang.{k}"))
              .otherwise(F.col(f"of_all.{k}")).alias(k) for k in QUANTILES]
    of_group = (q.groupBy("lang", "source")
                .agg(F.array_sort(F.collect_list(F.struct("metric", *chosen))).alias("q")))     # a row per sketch

    def fence(i: int, ends: tuple[str, str], reach: int, units: int, length: str | None):
        own = F.col("q")[i]
        least = F.lit(units) if length is None else F.floor(F.lit(1000 * units) / F.col("q")[len(METRICS) + LENGTHS.index(length)]["q25"])
        out = reach * F.greatest(own[ends[1]] - own[ends[0]], least)
        return F.struct((own["q25"] - out if i == 0 else F.lit(0)).cast("long").alias("low"), (own["q75"] + out).alias("high"))

    return of_group.select("lang", "source", F.array(*[fence(i, *rest) for i, (_, *rest) in enumerate(METRICS.values())]).alias("fences"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept``.

    A text fails the base rules with fewer than 50 words or more than half
    of its words in repeated 3-word windows; of the others those outside a
    fence of their (lang, source) are not kept. Null and empty texts have
    zeros and fail. Null languages and sources are groups of their own.
    Repeated rows count as often as they occur. The fences join back by
    (lang, source); a hot source is split by AQE, its other side has one row.
    """
    stats = cut(text_stats(docs, id_col, text_col))
    f = fences(stats).select(F.col("lang").alias("fl"), F.col("source").alias("fs"), "fences")
    joined = stats.join(f, stats.lang.eqNullSafe(f.fl) & stats.source.eqNullSafe(f.fs), "left")
    inside = F.lit(True)
    for i, (x, *_) in enumerate(METRICS.values()):
        value, fence = F.expr(x), F.col("fences")[i]
        inside = inside & (value >= fence["low"]) & (value <= fence["high"])
    failed = base_failed()
    return joined.select(F.col("id").alias(id_col), *[s for s in STATS if s != "n_lines"], failed.alias("base_failed"),
                         F.when(failed, F.lit(False)).otherwise(inside).alias("kept"))


def _oracle() -> str:
    def clean(x: str) -> str:
        return x.replace(" div ", " // ")
    listed = ", ".join(f"({i}, CASE WHEN n_words < 50 THEN 0 ELSE {clean(x)} END)" for i, x in enumerate(SKETCHED))
    rules = ", ".join(f"({i}, '{ends[0]}', {reach}, {units}, {-1 if length is None else len(METRICS) + LENGTHS.index(length)})"
                      for i, (_, ends, reach, units, length) in enumerate(METRICS.values()))
    found = ", ".join(f"min(bucket) FILTER (upto * 100 >= total * {p}) AS {k}" for k, p in QUANTILES.items())
    chosen = ", ".join(f"CASE WHEN gq.n >= {MIN_DOCS} THEN gq.{k} WHEN kq.n >= {MIN_DOCS} THEN kq.{k} ELSE aq.{k} END AS {k}" for k in QUANTILES)
    level = """
{0} AS (SELECT {1} metric, bucket, sum(n) AS n FROM h GROUP BY {1} metric, bucket),
{0}r AS (SELECT {1} metric, bucket, sum(n) OVER (PARTITION BY {1} metric) AS total,
         sum(n) OVER (PARTITION BY {1} metric ORDER BY bucket) AS upto FROM {0}),
{0}q AS (SELECT {1} metric, any_value(total) AS n, FOUND FROM {0}r GROUP BY {1} metric)""".replace("FOUND", found)
    return rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
p AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words
        FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
s AS (SELECT t.doc_id, lang, source, len(words) AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM t JOIN w USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
m AS (SELECT doc_id, lang, source, base_failed, v.metric, v.value
      FROM b, LATERAL (VALUES {listed}) AS v(metric, value)),
e AS (SELECT *, greatest(length(bin(value)) - 6, 0) AS shift FROM m),
h AS (SELECT lang, source, metric, (value >> shift) << shift AS bucket, count(*) AS n
      FROM e WHERE NOT base_failed GROUP BY ALL),
{level.format("g", "lang, source,")},
{level.format("k", "lang,")},
{level.format("a", "")},
f AS (SELECT gq.lang, gq.source, gq.metric, {chosen}
      FROM gq JOIN kq ON gq.lang IS NOT DISTINCT FROM kq.lang AND gq.metric = kq.metric JOIN aq ON gq.metric = aq.metric),
o AS (SELECT f.lang, f.source, f.metric, f.q25, f.q75,
             reach * greatest(CASE low_end WHEN 'q25' THEN f.q75 - f.q25 ELSE f.q99 - f.q75 END,
                              CASE WHEN length_of < 0 THEN units ELSE 1000 * units // size.q25 END) AS out
      FROM f JOIN (VALUES {rules}) AS rule(metric, low_end, reach, units, length_of) ON rule.metric = f.metric
      LEFT JOIN f AS size ON size.metric = length_of AND size.lang IS NOT DISTINCT FROM f.lang AND size.source IS NOT DISTINCT FROM f.source),
bad AS (SELECT DISTINCT m.doc_id FROM m JOIN o ON m.lang IS NOT DISTINCT FROM o.lang
        AND m.source IS NOT DISTINCT FROM o.source AND m.metric = o.metric
        WHERE m.value > q75 + out OR m.metric = 0 AND m.value < q25 - out)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept
FROM b
"""


ORACLE = _oracle()
