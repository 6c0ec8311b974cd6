"""Filter interaction audit by sorted posting lists.

What filters remove depends on their order: a row that fails two of them goes
with the first. Every filter has a sorted list of the rows that fail it, per
part of the table. For a set S of filters already applied, the rows gone are
the union of S's lists, and the rows that filter f then removes are f's list
without that union; all orders of five filters need 32 unions and 80 such
differences. Unions are galloping k-way merges: the list with the smallest
head gallops to the next list's head, and the stretch it passed is copied
whole. Differences and intersections gallop through the larger list.

The lists are cut into id ranges: rows are range-partitioned and sorted by
(part, id), and every Arrow batch of a partition is one range. A range's lists
are merged on their own, and only sizes leave the task, so memory is bounded
by the batch however many rows a part, an id or a group of copies has; sizes of
ranges add up. Postings are places in the range, so rows that share an id, or
have none, count one each.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations, permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import WORD, cut, text_or_empty

FILTERS = "ABCDE"
LABELS = ("good", "toxic")


def gallop(postings: list[int], value: int, begin: int) -> int:
    """First place from ``begin`` on whose posting is not below ``value``: steps
    double until one passes it, then the last step is halved."""
    step, end = 1, len(postings)
    while begin + step < end and postings[begin + step] < value:
        step *= 2
    return bisect_left(postings, value, begin + step // 2, min(begin + step + 1, end))


def union(lists: list[list[int]]) -> list[int]:
    """Galloping k-way merge of sorted lists without repeats."""
    heads = [[x, 0] for x in lists if x]
    out: list[int] = []
    while len(heads) > 1:
        heads.sort(key=lambda h: h[0][h[1]])
        (low, at), (other, there) = heads[0], heads[1]
        to = gallop(low, other[there], at)
        out += low[at:to]
        if to < len(low) and low[to] == other[there]:
            to += 1                                     # the other list brings it
        if to == len(low):
            heads.pop(0)
        else:
            heads[0][1] = to
    for rest, at in heads:
        out += rest[at:]
    return out


def difference(postings: list[int], gone: list[int]) -> list[int]:
    """``postings`` without ``gone``, both sorted; whichever list is behind
    gallops to the other's head."""
    out: list[int] = []
    i = j = 0
    while i < len(postings) and j < len(gone):
        if postings[i] < gone[j]:
            to = gallop(postings, gone[j], i)
            out += postings[i:to]
            i = to
        else:
            i += postings[i] == gone[j]
            j = gallop(gone, postings[i], j) if i < len(postings) else j
    return out + postings[i:]


def shared(a: list[int], b: list[int]) -> int:
    """How many postings two sorted lists share."""
    return len(a) - len(difference(a, b))


def audit_range(fails: list[list[int]], labels: list[list[int]]) -> list[tuple[int, int, int, int, int, int]]:
    """``(applied, filter, gone, removed, labels lost...)`` of one range for every set
    ``applied`` of filters (a bit each) and every filter outside it: ``gone``
    counts the union after the filter."""
    k = len(fails)
    unions = {}
    for size in range(k + 1):
        for chosen in combinations(range(k), size):
            unions[sum(1 << f for f in chosen)] = union([fails[f] for f in chosen])
    out = []
    for applied, before in unions.items():
        for f in range(k):
            if not applied >> f & 1:
                removed = difference(fails[f], before)
                out.append((applied, f, len(unions[applied | 1 << f]), len(removed), *(shared(removed, x) for x in labels)))
    return out


def pair_sizes(rows: DataFrame, n_filters: int) -> DataFrame:
    """``part, applied, filter, total, failing, gone, removed, good, toxic`` summed over all
    ranges of each part. ``rows``: part string, id, fails int (a bit per
    filter), labels int (a bit per label)."""
    ranged = rows.select("part", "id", "fails", "labels").repartitionByRange("part", "id").sortWithinPartitions("part", "id")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            parts: dict[str, list[int]] = {}
            for i, p in enumerate(b.column(0).to_pylist()):
                parts.setdefault(p, []).append(i)
            fails, labels = b.column(2).to_pylist(), b.column(3).to_pylist()
            out = []
            for p, places in parts.items():
                lists = [[i for i in places if fails[i] >> f & 1] for f in range(n_filters)]
                marked = [[i for i in places if labels[i] >> x & 1] for x in range(len(LABELS))]
                out += [(p, a, f, len(places), len(lists[f]), *rest) for a, f, *rest in audit_range(lists, marked)]
            cols = list(zip(*out)) if out else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string()] + [pa.int32()] * 2 + [pa.int64()] * 6)], names=names)

    names = ["part", "applied", "filter", "total", "failing", "gone", "removed", *LABELS]
    sizes = ranged.mapInArrow(batches, "part string, applied int, filter int" + "".join(f", {n} long" for n in names[3:]))
    return sizes.groupBy("part", "applied", "filter").agg(*[F.sum(n).alias(n) for n in names[3:]])


def audit(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley`` for every part, order of the filters and
    step. ``rows`` as in ``pair_sizes``; bit i of ``fails`` is ``filters[i]``.

    The orders (120 for five filters) are a small table joined to the sizes by
    (set applied, filter), 80 rows a part; both are bounded by the number of
    filters and parts. No row: no part, an empty result.
    """
    spark = rows.sparkSession
    steps = [("".join(filters[f] for f in order), i + 1, sum(1 << f for f in order[:i]), f)
             for order in permutations(range(len(filters))) for i, f in enumerate(order)]
    orders = spark.createDataFrame(steps, "filter_order string, step int, applied int, filter int")
    sizes = pair_sizes(rows, len(filters))
    walked = sizes.join(F.broadcast(orders), ["applied", "filter"])
    others = (1 << len(filters)) - 1
    unique = F.max(F.when(F.col("applied") == F.lit(others) - F.call_function("shiftleft", F.lit(1), F.col("filter")), F.col("removed")))
    by_filter = walked.groupBy("part", "filter").agg(unique.alias("unique_fails"), F.sum("removed").alias("shapley"))
    return (walked.join(by_filter, ["part", "filter"])
            .select("part", "filter_order", "step", (F.col("total") - F.col("gone")).alias("kept"), "removed",
                    (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails",
                    F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley"))


def _bit(condition: Column, i: int) -> Column:
    return F.when(condition, F.lit(1 << i)).otherwise(F.lit(0))


def failing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, id, fails, labels`` of every document. Filters A to D are
    conditions on the whole text (null: empty); E fails rows whose text a
    smaller doc_id has, removed or not. Null languages are part ''.

    The smallest id of a text is an aggregate by its SHA-256, combined before
    the shuffle, and joined back by (digest, id), a key no group of copies
    makes hot. Rows with the smallest id itself pass E, repeated ones too; rows without
    an id neither fail E nor make others fail. A label that repeats for an id counts once; a row without an id has none.
    """
    text = text_or_empty("text")
    words = F.regexp_extract_all(F.col("t"), F.lit(WORD), F.lit(0))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    fails = (_bit(n < 200, 0) + _bit(100 * distinct < 50 * n, 1)
             + _bit(100 * F.regexp_count("t", F.lit("[A-Z]")) > 3 * F.length("t"), 2)
             + _bit(F.col("t").rlike(r"[#$%&*|]"), 3))
    flagged = (docs.select(F.coalesce("lang", F.lit("")).alias("part"), F.col("doc_id").alias("id"), text.alias("t"))
               .select("part", "id", "t", words.alias("words"))
               .select("part", "id", fails.alias("fails"), F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest")))
    flagged = cut(flagged)
    first = (flagged.where(F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("id"))
             .select("digest", "id", F.lit(True).alias("first")))
    known = (labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id"))
             .agg(F.max(_bit(F.col("quality") == 1, 0)).alias("good"), F.max(_bit(F.col("toxic") == 1, 1)).alias("toxic")))
    copy = F.col("first").isNull() & F.col("id").isNotNull()
    return (flagged.join(first, ["digest", "id"], "left").join(known, "id", "left")
            .select("part", "id", (F.col("fails") + _bit(copy, 4)).alias("fails"),
                    (F.coalesce("good", F.lit(0)) + F.coalesce("toxic", F.lit(0))).alias("labels")))


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five document filters, one part per language."""
    return audit(failing(docs, labels))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             min(doc_id) OVER (PARTITION BY text) AS first_id FROM t),
f AS (SELECT doc_id, part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
             100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
             regexp_matches(text, '[#$%&*|]'), coalesce(first_id < doc_id, false)] AS fails FROM w),
k AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
      FROM f LEFT JOIN k USING (doc_id) GROUP BY part, fails),
o AS (SELECT a || b || c || d || e AS filter_order
      FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v1(a), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v2(b),
           (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v3(c), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v4(d),
           (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v5(e)
      WHERE len(list_distinct([a, b, c, d, e])) = 5),
s AS (SELECT filter_order, step, ascii(filter_order[step]) - 64 AS nth,
             list_transform(string_split(filter_order[1:step - 1], ''), lambda c: ascii(c) - 64) AS before
      FROM o, (SELECT unnest(range(1, 6)) AS step)),
x AS (SELECT part, filter_order, step, nth, n, good, toxic, fails[nth] AS fails_it,
             step > 1 AND len(list_filter(before, lambda b: fails[b])) > 0 AS gone,
             len(list_filter(fails, lambda z: z)) = 1 AS once
      FROM g, s),
y AS (SELECT part, filter_order, step, nth,
             sum(CASE WHEN NOT gone AND NOT fails_it THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN NOT gone AND fails_it THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN gone AND fails_it THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN once AND fails_it THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN NOT gone AND fails_it THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN NOT gone AND fails_it THEN toxic ELSE 0 END) AS toxic_lost
      FROM x GROUP BY part, filter_order, step, nth)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, nth) AS BIGINT) AS shapley
FROM y
"""
