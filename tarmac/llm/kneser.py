"""Quality classifier: an interpolated modified Kneser-Ney model.

The model counts character n-grams of order ``ORDER`` in trusted text
(documents labelled good, a fifth of them held out). A symbol has 12 bits, so
an n-gram is one long and its context and suffix are shifts and masks of it.

Documents are dealt to blocks by a hash of their id, compressed, and shuffled
once. A block yields its distinct n-grams with their counts in trusted text:
the counts of all blocks add up to the model (lower orders are continuation
counts: distinct n-grams with that suffix), and the distinct n-grams are the
probabilities the block asks for. These are computed by joins on the n-gram,
its context and its suffix, order by order, sharded by n-gram, and go back to
the block that asked, which sums them per document. Nothing of the model is
ever in one place, and what is shuffled grows with the text.

A document is kept if its bits, less ``ALLOWANCE``, are per symbol not above
its language's quantile ``QUANTILE`` over held-out trusted documents plus
``MARGIN`` of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import cut
from tarmac.session import scratch_path

ORDER, WIDTH = 5, 12           # n-gram length; bits of a symbol
SYMBOLS = 1 << WIDTH
START, END = 1, 2              # stand before and behind a text
QUANTILE, MARGIN = 0.99, 0.05
ALLOWANCE = 40                 # bits that any document may have on top: a few odd words of a short text
PIECE = 1 << 20                # symbols of one text handled at a time
_WHITE = re.compile(r"\s+")


def normal(text: str | None) -> str:
    return _WHITE.sub(" ", (text or "").lower()).strip()


def symbols(text: str) -> np.ndarray:
    """Symbols of a normalised text, with ORDER - 1 starts and one end. Code
    points above the symbol range share symbols by their remainder."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.where(points < SYMBOLS, np.maximum(points, 3), points % (SYMBOLS - 3) + 3)
    return np.concatenate([np.full(ORDER - 1, START), points, [END]])


def grams(text: str) -> Iterator[np.ndarray]:
    """n-grams of a normalised text, one per symbol and one for its end, a
    bounded piece at a time; none for an empty text."""
    if not text:
        return
    x = symbols(text)
    for at in range(0, len(x) - ORDER + 1, PIECE):
        part = x[at:at + PIECE + ORDER - 1]
        key = np.zeros(len(part) - ORDER + 1, np.int64)
        for i in range(ORDER):
            key = (key << WIDTH) | part[i:len(part) - ORDER + 1 + i]
        yield key


def _pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=6)
    for b in it:
        packed = pa.array([press.compress(normal(t.as_py()).encode("utf-8", "surrogatepass")) for t in b.columns[-1]], pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], packed], names=[*b.schema.names[:-1], "packed"])


def _unpack(packed) -> Iterator[str]:
    press = zstandard.ZstdDecompressor()
    for x in packed:
        yield press.decompress(x).decode("utf-8", "surrogatepass")


def _ask(docs: pd.DataFrame, trusted: pd.DataFrame) -> pd.DataFrame:
    """Distinct n-grams of a block and their counts in its trusted documents."""
    if not len(docs):
        return pd.DataFrame({"block": [], "gram": [], "n": []}, dtype="int64")
    good = set(trusted["id"])
    everything, counted, held = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def fold():
        nonlocal everything, keys, counts
        everything = np.unique(np.concatenate([everything, *[k for k, _ in held]]))
        train = [k for k, g in held if g]
        if train:
            k, n = np.unique(np.concatenate(train), return_counts=True)
            joined, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
            total = np.zeros(len(joined), np.int64)
            np.add.at(total, at, np.concatenate([counts, n]))
            keys, counts = joined, total
        held.clear()

    size = 0
    for doc, text in zip(docs["id"], _unpack(docs["packed"])):
        for k in grams(text):
            held.append((k, doc in good))
            size += len(k)
            if size > 4 * PIECE:
                fold()
                size = 0
    if held:
        fold()
    counted = np.zeros(len(everything), np.int64)
    counted[np.searchsorted(everything, keys)] = counts
    return pd.DataFrame({"block": np.full(len(everything), docs["block"].iloc[0]), "gram": everything, "n": counted})


def _sum(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """Bits of each document of a block, from the answers to its n-grams."""
    gram = answers["gram"].to_numpy()
    order = np.argsort(gram)
    gram, bits = gram[order], answers["bits"].to_numpy(np.float64)[order]
    n, total = [], []
    for text in _unpack(docs["packed"]):
        count, s = 0, 0.0
        for k in grams(text):
            at = np.searchsorted(gram, k)
            if not np.array_equal(gram[np.minimum(at, len(gram) - 1)], k):
                raise RuntimeError("a block was dealt differently when read again")
            s += float(bits[at].sum())
            count += len(k)
        n.append(count)
        total.append(s)
    return pd.DataFrame({"id": docs["id"].astype("Int64"), "lang": docs["lang"], "n": n, "bits": total})


def _mask(order: int) -> int:
    return (1 << (WIDTH * order)) - 1


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """D1, D2, D3+ from the counts of counts; a half where a count lacks."""
    n = counts.agg(*[F.count(F.when(F.col("c") == i, 1)) for i in (1, 2, 3, 4)]).first()
    if not n[0] or not n[1]:
        return 0.5, 0.5, 0.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.0), float(i)) if n[i - 1] else 0.5 for i in (1, 2, 3))


def probabilities(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """``gram, p`` of the distinct n-grams ``asked`` (gram) under the model
    with counts (gram, c) of the highest order."""
    levels, table = [], cut(counts)
    for order in range(ORDER, 0, -1):
        levels.append((order, table))
        if order > 1:
            table = cut(table.select(F.col("gram").bitwiseAND(F.lit(_mask(order - 1))).alias("gram"))
                        .groupBy("gram").agg(F.count(F.lit(1)).alias("c")))
    below = None
    for order, table in reversed(levels):
        d1, d2, d3 = discounts(table)
        c = F.col("c")
        less = F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)
        many = [F.count(F.when(x, 1)) for x in (c == 1, c == 2, c > 2)]
        context = table.groupBy(F.shiftright("gram", WIDTH).alias("context")).agg(
            F.sum("c").alias("total"), (many[0] * d1 + many[1] * d2 + many[2] * d3).alias("left"))
        need = asked.select(F.col("gram").bitwiseAND(F.lit(_mask(order))).alias("gram")).distinct() if order < ORDER else asked
        need = (need.withColumn("context", F.shiftright("gram", WIDTH)).withColumn("suffix", F.col("gram").bitwiseAND(F.lit(_mask(order - 1))))
                .join(table, "gram", "left").join(context, "context", "left"))
        need = need.withColumn("low", F.lit(1.0 / SYMBOLS)) if below is None else need.join(
            below.select(F.col("gram").alias("suffix"), F.col("p").alias("low")), "suffix")
        seen = (F.greatest(F.coalesce(c - less, F.lit(0.0)), F.lit(0.0)) + F.col("left") * F.col("low")) / F.col("total")
        below = need.select("gram", F.when(F.col("total") > 0, seen).otherwise(F.col("low")).alias("p"))
    return below


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def score(docs: DataFrame, trusted: DataFrame, blocks: int) -> DataFrame:
    """``id, lang, n, bits`` of documents (id, lang, text) under the model of
    those whose id is in ``trusted`` (id)."""
    dealt = F.coalesce(block_of(F.col("id"), blocks), F.lit(0))
    dealt = F.when(F.col("id").isNull(), block_of(F.col("text"), blocks)).otherwise(dealt)
    kinds = dict(docs.dtypes)
    packed = (docs.select(dealt.alias("block"), "id", F.col("lang").cast("string").alias("lang"), "text")
              .mapInArrow(_pack, f"block long, id {kinds['id']}, lang string, packed binary").repartition("block"))
    good = trusted.select(block_of(F.col("id"), blocks).alias("block"), "id").distinct()
    path = scratch_path(docs.sparkSession, "grams")
    (packed.groupBy("block").cogroup(good.groupBy("block")).applyInPandas(_ask, "block long, gram long, n long")
     .write.parquet(path))
    asked = docs.sparkSession.read.parquet(path)
    model = asked.where("n > 0").groupBy("gram").agg(F.sum("n").alias("c"))
    p = probabilities(model, asked.select("gram").distinct())
    answers = asked.select("block", "gram").join(p, "gram").select("block", "gram", (-F.log2("p")).cast("float").alias("bits"))
    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_sum, "id long, lang string, n long, bits double")


def thresholds(held: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """``of_lang, whole, threshold`` (in thousandths of a bit) from ``lang,
    level``; the row with ``whole`` is over all languages. The levels are
    whole numbers, so a language has a bounded number of them."""
    levels = held.groupBy("lang", "level").agg(F.count(F.lit(1)).alias("n")).withColumn("whole", F.lit(False))
    every = levels.groupBy("level").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "level", "n", F.lit(True).alias("whole"))
    by = Window.partitionBy("whole", "lang")
    ranked = levels.unionByName(every).withColumn("upto", F.sum("n").over(by.orderBy("level"))).withColumn("all", F.sum("n").over(by))
    return (ranked.where(F.col("upto") >= F.ceil(F.col("all") * quantile)).groupBy(F.col("lang").alias("of_lang"), "whole")
            .agg((F.min("level") * (1 + margin)).alias("threshold")))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             blocks: int | None = None) -> DataFrame:
    """One row per input row: ``id_col, lang, n_symbols, perplexity,
    threshold, kept``; perplexity per symbol, the threshold as perplexity.

    Trusted are ids labelled quality 1 and toxic 0, and never otherwise.
    Null, empty and white texts have no perplexity and are not kept. A null
    id is never trusted. A null language, and one without held-out trusted
    documents, uses the threshold over all languages; without any, everything
    with a text is kept. Repeated rows are scored one by one, and counted one
    by one if trusted. An empty table gives an empty result.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    blocks = blocks or max(1, plain.rdd.getNumPartitions())
    good = F.min(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0))
    trusted = cut(labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(good.alias("good"))
                  .where("good = 1").select("id", held_out(F.col("id")).alias("held")))
    scored = cut(score(plain, trusted.where("not held").select("id"), blocks)
                 .withColumn("level", F.when(F.col("n") > 0, F.round(F.col("bits") * 1000 / F.col("n"))).cast("long")))
    limits = cut(thresholds(scored.where("level is not null").join(trusted.where("held"), "id").select("lang", "level")))
    every = limits.where("whole").select("threshold").first()
    own = limits.where("not whole and of_lang is not null").select("of_lang", "threshold")
    limit = F.coalesce(F.col("threshold"), F.lit(every[0] if every else None).cast("double"))
    return (scored.join(own, F.col("lang") == F.col("of_lang"), "left")
            .select(F.col("id").alias(id_col), "lang", F.col("n").alias("n_symbols"), F.pow(F.lit(2.0), F.col("level") / 1000).alias("perplexity"),
                    F.pow(F.lit(2.0), limit / 1000).alias("threshold"),
                    F.coalesce(F.col("level") <= limit + ALLOWANCE * 1000 / F.col("n"), F.col("level").isNotNull()).alias("kept")))
