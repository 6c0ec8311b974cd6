"""Line dedup by winnowing over line hashes.

A unit is the shortest run of lines from a line on that has ``UNIT_LINES``
lines with a word, or ``UNIT_WORDS`` words. A window is the shortest such run
of ``RUN_LINES`` lines or ``RUN_WORDS`` words. Of the units inside each window
the one with the least hash (the rightmost, if several) becomes a fingerprint,
so two documents that share a run as long as a window share a fingerprint in
it, whatever stands around.

Two searches go together. Each fingerprint is joined with its first holder
(smallest id, then position), and the match is extended line by line both ways
as far as the two documents agree: this finds runs from a unit on. And every
window (from each line on, and back from each line) is compared by its hash
with the places where it stood before, in the document and in those before it:
of a repeated run as long as a window, whoever else holds parts of it, every
line goes. A run that is deleted has at least a unit; the first place of a run
keeps its lines. A run begins and ends with a line that has a word; lines
without one beside it go if the first holder has them too.

Extension ships slices of ``reach`` line hashes around a match; matches that
fill their slice go on with longer ones, so what is sent follows the length of
the repeated runs. Hot fingerprints, hot windows and hot first holders
are skewed join keys, which AQE splits; the other side has one row a key.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tarmac.llm.common import cut, small_batches, text_or_empty

UNIT_LINES, UNIT_WORDS = 2, 25
RUN_LINES, RUN_WORDS = 4, 50
REACH = 64
LAST_ID = 2 ** 63 - 1     # stands for a null id


def _ends(words: np.ndarray, lines: int, least: int) -> list[int]:
    """For each line, the end (exclusive) of the shortest run from it on with
    so many lines that have a word, or so many words; 0 if there is none."""
    n, out, end, have, filled = len(words), [], 0, 0, 0
    for start in range(n):
        while end < n and (end <= start or (filled < lines and have < least)):
            have += words[end]
            filled += words[end] > 0
            end += 1
        out.append(end if filled >= lines or have >= least else 0)
        have -= words[start]
        filled -= words[start] > 0
    return out


def units(hashes: np.ndarray, words: np.ndarray) -> dict[int, int]:
    """Hash of the unit at each position that begins one, by position."""
    return {i: xxhash.xxh3_64_intdigest(hashes[i:end].tobytes()) - 2 ** 63
            for i, end in enumerate(_ends(words, UNIT_LINES, UNIT_WORDS)) if end and words[i]}


def fingerprints(hashes: np.ndarray, words: np.ndarray, unit: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """(position, hash) of the selected units, by position."""
    unit_end = _ends(words, UNIT_LINES, UNIT_WORDS)
    window_end = _ends(words, RUN_LINES, RUN_WORDS)
    unit = units(hashes, words) if unit is None else unit
    starts, chosen, at = list(unit), set(), 0
    least: deque[int] = deque()
    for start, stop in enumerate(window_end):
        if not stop:
            break
        while at < len(starts) and unit_end[starts[at]] <= stop:
            while least and unit[least[-1]] >= unit[starts[at]]:
                least.pop()
            least.append(starts[at])
            at += 1
        while least and least[0] < start:
            least.popleft()
        if least:
            chosen.add(least[0])
    return [(i, unit[i]) for i in sorted(chosen)]


def agree(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common start."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def own_repeats(hashes: np.ndarray, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs (from, to) of a document that repeat an earlier place in it."""
    first: dict[int, int] = {}
    runs: list[tuple[int, int]] = []
    for at, h in found:
        source = first.setdefault(h, at)
        if source == at or runs and at < runs[-1][1]:
            continue
        after = agree(hashes[at:], hashes[source:])
        before = agree(hashes[:at][::-1], hashes[:source][::-1])
        runs.append((at - before, at + after))
    return runs


def windows(hashes: np.ndarray, words: np.ndarray) -> list[tuple[int, int, int]]:
    """(from, to, hash) of runs that together cover every run as long as a
    window: the shortest windows from each line with a word on, those back
    from each, and, where a line is a window by itself and lines without a
    word follow, the run up to the next line with one."""
    n = len(words)
    filled = np.flatnonzero(words)
    spans = {(i, end) for i, end in enumerate(_ends(words, RUN_LINES, RUN_WORDS)) if end and words[i]}
    spans |= {(n - end, n - i) for i, end in enumerate(_ends(words[::-1], RUN_LINES, RUN_WORDS)) if end and words[n - 1 - i]}
    spans |= {(i, j + 1) for i, j in zip(filled[:-1].tolist(), filled[1:].tolist()) if j > i + 1 and (i, i + 1) in spans}
    return [(lo, hi, xxhash.xxh3_64_intdigest(hashes[lo:hi].tobytes()) - 2 ** 63) for lo, hi in sorted(spans)]


def sent(unit: dict[int, int], found: list[tuple[int, int]], runs: list[tuple[int, int]]) -> dict[int, int]:
    """Position of each fingerprint that goes to the join: the first selected
    one outside ``runs``. If all of them lie in deleted runs, it is the first
    place at all where the unit stands, which may not be a selected one (a
    line repeated directly after itself: the rightmost is selected)."""
    gone = {i for lo, hi in runs for i in range(lo, hi)}
    stays = {x: i for i, x in reversed(found) if i not in gone}
    first = {x: i for i, x in reversed(unit.items())}
    return {x: stays.get(x, first[x]) for _, x in found}


def line_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number of words of every line."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    words = [x.split() for x in lines]
    return (np.array([xxhash.xxh3_64_intdigest(x) if w else 0 for x, w in zip(lines, words)], np.uint64).view(np.int64),
            np.array([len(w) for w in words], np.int64))


_SPAN = ArrayType(StructType([StructField("lo", LongType()), StructField("hi", LongType())]))
_PRINTED = StructType([StructField("id", LongType()), StructField("tie", LongType()), StructField("hashes", ArrayType(LongType())),
                       StructField("own", _SPAN), StructField("at", ArrayType(LongType())), StructField("print", ArrayType(LongType())),
                       StructField("lo", ArrayType(LongType())), StructField("hi", ArrayType(LongType())), StructField("window", ArrayType(LongType()))])


def _printed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
    longs = pa.list_(pa.int64())
    for b in it:
        hashed, own, at, prints, spans = [], [], [], [], ([], [], [])
        for t in b.column(2):
            h, w = line_hashes(t.as_py())
            unit = units(h, w)
            found = fingerprints(h, w, unit)
            runs = own_repeats(h, found)
            new = sent(unit, found, runs)
            stood: dict[int, tuple[int, int]] = {}
            for lo, hi, x in windows(h, w):
                if stood.setdefault(x, (lo, hi)) != (lo, hi):
                    runs.append((lo, hi))
            hashed.append(h)
            own.append([{"lo": lo, "hi": hi} for lo, hi in runs])
            for part, values in zip(spans, ([lo for lo, _ in stood.values()], [hi for _, hi in stood.values()], list(stood))):
                part.append(values)
            at.append(list(new.values()))
            prints.append(list(new))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hashed, longs), pa.array(own, span),
                                          pa.array(at, longs), pa.array(prints, longs), *[pa.array(x, longs) for x in spans]], names=_PRINTED.names)


def _common(a: Column, b: Column) -> Column:
    """Length of the common start of two arrays of equal length."""
    other = F.array_position(F.zip_with(a, b, lambda x, y: x != y), True)
    return F.when(other == 0, F.size(a).cast("long")).otherwise(other - 1)


def repeated_runs(docs: DataFrame) -> DataFrame:
    """``id, tie, runs`` of the documents (``id, tie, text``) that lose lines:
    runs of line numbers, from ``lo`` up to before ``hi``."""
    printed = docs.mapInArrow(_printed, _PRINTED)
    printed = cut(printed.groupBy("id", "tie").agg(*[F.first(c).alias(c) for c in _PRINTED.names[2:]]))
    lines = printed.select("id", "tie", "hashes", F.size("hashes").cast("long").alias("n"))
    places = printed.select("id", "tie", F.explode(F.arrays_zip("at", "print")).alias("p")).select("id", "tie", "p.at", "p.print")
    first = (places.groupBy("print").agg(F.min(F.struct("id", "tie", "at")).alias("f"), F.count(F.lit(1)).alias("holders"))
             .where("holders > 1").select("print", F.col("f.id").alias("sid"), F.col("f.tie").alias("stie"), F.col("f.at").alias("sat")))
    # a match per diagonal: neighbouring fingerprints of one run share it
    matches = (places.join(first, "print").where("id != sid or tie != stie")
               .groupBy("id", "tie", "sid", "stie", (F.col("at") - F.col("sat")).alias("shift"))
               .agg(F.sort_array(F.collect_set("at")).alias("ats")))
    going = cut(matches.select("id", "tie", "sid", "stie", "shift", F.explode("ats").alias("at"))
                .withColumn("lo", F.col("at")).withColumn("hi", F.col("at")))
    done, reach = [], REACH
    src = lines.select(F.col("id").alias("sid"), F.col("tie").alias("stie"), F.col("hashes").alias("shashes"), F.col("n").alias("sn"))
    while True:
        r = F.lit(reach).cast("long")
        s_lo, s_hi = F.col("lo") - F.col("shift"), F.col("hi") - F.col("shift")
        before = F.least(r, s_lo, F.col("lo"))
        around = going.join(src, ["sid", "stie"]).select(
            "id", "tie", "sid", "stie", "shift", "at", "lo", "hi", "sn", before.alias("before"),
            _slice("shashes", s_lo - before, before).alias("s_before"),
            _slice("shashes", s_hi, F.least(r, F.col("sn") - s_hi)).alias("s_after"))
        both = around.join(lines, ["id", "tie"])
        after = F.least(F.size("s_after").cast("long"), F.col("n") - F.col("hi"))
        both = (both.withColumn("after", after)
                .withColumn("left", _common(F.reverse("s_before"), F.reverse(_slice("hashes", F.col("lo") - F.col("before"), F.col("before")))))
                .withColumn("right", _common(_slice("s_after", F.lit(0), F.col("after")), _slice("hashes", F.col("hi"), F.col("after")))))
        more = (F.col("left") == r) | (F.col("right") == r)
        step = cut(both.select("id", "tie", "sid", "stie", "shift", "at", (F.col("lo") - F.col("left")).alias("lo"),
                               (F.col("hi") + F.col("right")).alias("hi"), more.alias("more")))
        done.append(step.where("not more").select("id", "tie", "lo", "hi"))
        going = step.where("more").drop("more")
        if going.isEmpty():
            break
        reach *= 4
    spans = printed.select("id", "tie", F.explode("own").alias("r")).select("id", "tie", "r.lo", "r.hi")
    for d in [*done, _repeated_windows(printed)]:
        spans = spans.unionByName(d)
    return spans.groupBy("id", "tie").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("runs"))


def _repeated_windows(printed: DataFrame) -> DataFrame:
    """``id, tie, lo, hi`` of the windows that stand in an earlier document."""
    places = printed.select("id", "tie", F.explode(F.arrays_zip("lo", "hi", "window")).alias("p")).select("id", "tie", "p.lo", "p.hi", "p.window")
    first = (places.groupBy("window").agg(F.min(F.struct("id", "tie")).alias("f"), F.count(F.lit(1)).alias("holders"))
             .where("holders > 1").select("window", F.col("f.id").alias("sid"), F.col("f.tie").alias("stie")))
    return places.join(first, "window").where("id != sid or tie != stie").select("id", "tie", "lo", "hi")


def _slice(col: str, start: Column, length: Column) -> Column:
    """Elements from ``start`` (0-based) on; none for a length of 0."""
    return F.when(length > 0, F.slice(F.col(col), (start + 1).cast("int"), length.cast("int"))).otherwise(F.array().cast("array<long>"))


def _delete(it: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    for b in it:
        texts, counts = [], []
        for t, runs in zip(b.column(text), b.columns[-1]):
            t, runs = t.as_py(), runs.as_py()
            if runs:
                lines = t.split("\n")
                gone = np.zeros(len(lines), bool)
                for r in runs:
                    gone[r["lo"]:r["hi"]] = True
                t = "\n".join(x for x, g in zip(lines, gone) if not g)
            texts.append(t)
            counts.append(int(gone.sum()) if runs else 0)
        cols = [*b.columns[:-1], pa.array(counts, pa.int64())]
        cols[text] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:-1], "deleted_lines"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without later repeated runs of lines, and ``deleted_lines``
    (a column of that name is replaced).

    One row per input row. Documents are ordered by id, then by a hash of the
    text; a null id comes last. Null and empty texts stay as they are. Rows
    with the same id and text are one document and share its result. Lines
    without a word don't count towards a run, but go with it. Other columns
    pass through.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != "deleted_lines"]
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)), F.xxhash64(text_or_empty(text_col))]
    named = docs.select(*kept)
    runs = repeated_runs(docs.select(key[0].alias("id"), key[1].alias("tie"), text_or_empty(text_col).alias("text"))
                         .where("text != ''")).select(F.col("id").alias("run id"), F.col("tie").alias("run tie"), F.col("runs").alias("run list"))
    # a row per document on the hashed side, so the texts needn't be sorted
    joined = named.join(runs.hint("shuffle_hash"), (key[0] == runs["run id"]) & (key[1] == runs["run tie"]), "left").select(*[named[c] for c in kept], "run list")
    at = kept.index(text_col)
    return joined.mapInArrow(lambda it: _delete(it, at), StructType([*named.schema.fields, StructField("deleted_lines", LongType())]))
