"""Periodic runs of words by a sparse diagonal DP.

A cell (i, lag) of the DP holds how many words up to word i equal those ``lag``
words before; it exists only where word i occurred at i - lag, is one more
than its upper left neighbour, and a diagonal that ends with a sufficient
length gives a run. On its own that is quadratic where a word is frequent, so
the cells are kept by lag class: a run of smallest period q in (k/2, k],
k = 1, 2, 4, ..., is followed on the diagonal of k-word grams. Inside such a run
a k-gram recurs at multiples of q only, so of a gram's earlier occurrences the
latest alone can be the run's lag, and every word has at most one active
diagonal in each class. A gram is numbered by the pair of its halves, and words
whose half occurs once in the document leave before the next class: ordinary
prose is down to a few words after the second. The work is
O(n log n) for any text, one word repeated a million times included.

A stretch of c consecutive grams on lag q covers c - 1 + k + q words. It is
maximal: the neighbouring words break the lag. Its smallest period is q: a
smaller one would divide q and give the grams a later occurrence.

The words of several documents are numbered together (about ``GROUP_BYTES`` of
text, or one longer document), so memory is bounded by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import WORD, text_or_empty

MIN_LENGTH, MIN_PERIODS = 6, 4
GROUP_BYTES = 1 << 20
RUN = "struct<start:long,length:long,period:long>"


def _numbered(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each value, how often each number occurs, latest earlier
    place of each place's value or -1)."""
    order = np.argsort(pairs, kind="stable")
    same = pairs[order[1:]] == pairs[order[:-1]]
    number = np.empty(len(pairs), np.int64)
    number[order] = np.concatenate(([0], np.cumsum(~same)))
    before = np.full(len(pairs), -1, np.int64)
    before[order[1:][same]] = order[:-1][same]
    return number, np.bincount(number), before


def find_runs(words: np.ndarray, sizes: np.ndarray, min_length: int = MIN_LENGTH,
              min_periods: int = MIN_PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of several documents. ``words`` are
    word numbers, ``sizes`` the words of each document; starts count from the
    beginning of ``words``. Runs shorter than ``min_periods`` (two or more)
    periods aren't looked for."""
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    room = np.repeat(sizes // min_periods, sizes)       # the longest period of each word's document
    place = np.arange(len(words))
    gram, k, found = words.astype(np.int64), 1, []
    offset = place - np.repeat(ends - sizes, sizes)
    while len(place):
        gram, often, before = _numbered(doc * (gram.max() + 1) + gram)
        lag = np.where(before >= 0, place - place[before], 0)
        lag[lag > k] = 0
        lag[lag <= k // 2] = 0
        # stretches of neighbouring places on one diagonal
        new = np.ones(len(place), bool)
        new[1:] = (lag[1:] != lag[:-1]) | (place[1:] != place[:-1] + 1)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(place)))
        period = lag[first]
        length = count - 1 + k + period
        good = (period > 0) & (length >= np.maximum(min_length, min_periods * period))
        found.append((place[first][good] - k + 1 - period[good], length[good], period[good]))
        # the next class: both halves occur again, and its periods fit the document
        at = np.full(len(words), -1, np.int64)
        at[place[often[gram] > 1]] = gram[often[gram] > 1]
        stay = (often[gram] > 1) & (offset >= 2 * k - 1) & (room > k)
        half = at[place[stay] - k]
        base = len(often)
        stay[stay] = half >= 0
        gram = half[half >= 0] * base + gram[stay]
        place, offset, doc, room = place[stay], offset[stay], doc[stay], room[stay]
        # gram pairs are distinct across documents already
        doc = np.zeros_like(doc)
        k *= 2
    if not found:
        return place, place, place
    start, length, period = map(np.concatenate, zip(*found))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _groups(texts: pa.Array) -> Iterator[pa.Array]:
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, begin = 0, 0
    for i, s in enumerate(sizes):
        if total and total + s > GROUP_BYTES:
            yield texts.slice(begin, i - begin)
            total, begin = 0, i
        total += int(s)
    if begin < len(texts):
        yield texts.slice(begin)


def _of_group(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(runs, collapsed text) of every text."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat = split.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    owner = pc.list_parent_indices(split).to_numpy()[real.to_numpy(zero_copy_only=False)]
    sizes = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    flat = flat.filter(real)
    numbers = flat.dictionary_encode().indices.to_numpy() if len(flat) else np.zeros(0, np.int64)
    start, length, period = find_runs(numbers, sizes)
    ends = np.cumsum(sizes)
    of = np.searchsorted(ends, start, side="right")
    drop = np.zeros(len(flat) + 1, np.int64)
    np.add.at(drop, start + period, 1)
    np.add.at(drop, start + length, -1)
    keep = np.cumsum(drop)[:-1] == 0
    kept = np.bincount(owner[keep], minlength=len(texts))
    collapsed = pc.binary_join(pa.LargeListArray.from_arrays(np.concatenate(([0], np.cumsum(kept))), flat.filter(pa.array(keep))),
                               pa.scalar(" ", pa.large_string()))
    runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - (ends - sizes)[of], length, period)], ["start", "length", "period"])
    per_doc = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(texts))))).astype(np.int32)
    return pa.ListArray.from_arrays(per_doc, runs), collapsed.cast(pa.string())


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, runs, collapsed`` of every row: ``runs`` are (start,
    length, period) by start, then period; ``collapsed`` is the text without the
    words that any run contains after its first period, joined by one space.

    Null, empty and white texts have no words, no runs and an empty collapsed
    text; a text of any length is one whole. Repeated rows and rows without an
    id each get their own row. Other columns are left out, whatever their names.
    No row: an empty result.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at = 0
            for texts in _groups(b.column(1)):
                runs, collapsed = _of_group(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), runs, collapsed], names=["id", "runs", "collapsed"])
                at += len(texts)

    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(batches, f"id {kind}, runs array<{RUN}>, collapsed string").withColumnRenamed("id", id_col)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, text_col``: of every tenth row by the checksum h of its id, the
    words from number a = g % n on (g = h div 10, n words) repeat with period
    1 + (n - a) div (3 + g % 8). Rows without an id or a word stay as they are."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(text_or_empty(text_col), F.lit(WORD), F.lit(0))
    at = F.struct(g.alias("g"), F.size(words).cast("long").alias("n"), words.alias("w"))
    parts = F.struct((F.col("_at.g") % F.col("_at.n")).cast("int").alias("a"), F.col("_at.n").cast("int").alias("n"), F.col("_at.w").alias("w"),
                     (3 + F.col("_at.g") % 8).cast("int").alias("d"))
    changed = F.expr("""concat_ws(' ', slice(_p.w, 1, _p.a),
        transform(sequence(_p.a, _p.n - 1), i -> _p.w[_p.a + (i - _p.a) % (1 + (_p.n - _p.a) div _p.d)]))""")
    chosen = h.isNotNull() & (h % 10 == 0) & text_or_empty(text_col).rlike(WORD)
    return (docs.select(F.col(id_col), F.col(text_col), F.when(chosen, at).alias("_at"))
            .select(id_col, text_col, F.when(F.col("_at").isNotNull(), parts).alias("_p"))
            .select(id_col, F.when(F.col("_p").isNotNull(), changed).otherwise(F.col(text_col)).alias(text_col)))


def _digest_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_runs, start, length, period, exponent_milli, runs_sha256,
    collapsed_sha256`` of every document with its planted runs: the longest
    run (ties: smallest start, then period), digests of all runs and of the
    collapsed text."""
    found = periodic_runs(with_planted_runs(docs))
    runs = F.col("runs")
    longest = F.expr("""aggregate(runs, cast(null as struct<start:long,length:long,period:long>),
        (best, r) -> CASE WHEN best IS NULL OR r.length > best.length THEN r ELSE best END)""")
    lines = F.transform(runs, lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size(runs) > 0, F.lit("\n")).otherwise(F.lit("")))
    best = F.col("_best")
    return (found.withColumn("_best", longest)
            .select("doc_id", F.size(runs).cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
                    best["period"].alias("period"), F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
                    _digest_of(listed).alias("runs_sha256"), _digest_of(F.col("collapsed")).alias("collapsed_sha256")))


# Plain form: all pairs of equal words within a quarter of the text, islands on
# each diagonal, of equal stretches the one with the smallest period.
ORACLE = rf"""
WITH t AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
             lambda v, b: list_reduce(list_prepend(xor(v, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                                   lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS h
  FROM documents),
p AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g FROM t),
c AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM p WHERE n > 0),
u AS MATERIALIZED (
  SELECT doc_id, n, i, w[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM c)),
m AS (SELECT x.doc_id, x.i - y.i AS lag, x.i FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i > y.i AND 4 * (x.i - y.i) <= x.n),
s AS (SELECT doc_id, lag, min(i) - lag AS start, count(*) + lag AS length
      FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS island FROM m) GROUP BY doc_id, lag, island),
r AS MATERIALIZED (
  SELECT doc_id, start, length, min(lag) AS period FROM s WHERE length >= greatest(6, 4 * lag) GROUP BY doc_id, start, length),
d AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
             first(struct_pack(s := start, l := length, p := period) ORDER BY length DESC, start, period) AS best
      FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.i) AS collapsed FROM u ANTI JOIN gone ON u.doc_id = gone.doc_id AND u.i = gone.i GROUP BY u.doc_id)
SELECT t.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length,
       CAST(best.p AS BIGINT) AS period, CAST(1000 * best.l // best.p AS BIGINT) AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM t LEFT JOIN d USING (doc_id) LEFT JOIN k USING (doc_id)
"""
