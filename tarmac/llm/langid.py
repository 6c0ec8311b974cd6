"""Language identification: multinomial naive Bayes over hashed character
n-grams.

Text is lower-cased, every run of non-letters becomes one space, and the 1-,
2- and 3-grams of code points are hashed into ``BUCKETS`` columns. Training
sums (lang, bucket) counts over all labelled texts: every task folds its
texts into one count matrix and emits its non-zero cells, Spark adds them.
The matrix of log-probabilities has languages x BUCKETS cells (checked:
at most ``MAX_LANGS`` languages, 32 MB) and is broadcast; scoring looks the
n-grams of a batch up in it and sums them per text with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
MAX_LANGS = 256
ALPHA = 0.5          # additive smoothing of the bucket counts
UNKNOWN = "und"
PIECE = 1 << 18      # code points of one text handled at a time
_MIX = np.uint64(0x9E3779B97F4A7C15)  # odd multiplier: 2^64 over the golden ratio


@cache
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def folded(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of non-letters one
    space, one space at either end."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    known = letters()[raw]
    keep = known.copy()
    keep[0] = True
    keep[1:] |= known[:-1]
    return np.where(known, raw, np.uint32(32))[keep]


def grams(points: np.ndarray) -> np.ndarray:
    """Bucket of every n-gram of the folded text, all orders."""
    x, out = points.astype(np.uint64), []
    for n in ORDERS:
        if len(x) < n:
            break
        h = np.full(len(x) - n + 1, n, np.uint64)
        for i in range(n):
            h = (h ^ x[i:len(x) - n + 1 + i]) * _MIX
            h ^= h >> np.uint64(29)
        out.append((h >> np.uint64(49)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def pieces(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of a whole text, a bounded piece at a time; the pieces depend
    on the text alone. Nothing for a null text or one without letters."""
    if not text or not any(map(str.isalpha, text)):
        return
    points = folded(text)
    over = max(ORDERS) - 1
    for at in range(0, len(points), PIECE):
        piece = grams(points[at:at + PIECE + over])
        if at + PIECE + over < len(points) or at == 0:
            yield piece
        elif at < len(points) - over:
            yield piece


@dataclass(frozen=True)
class Model:
    langs: list[str]
    log_prior: np.ndarray    # languages
    log_prob: np.ndarray     # languages x BUCKETS


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on all rows with a language; None if there is none with letters."""
    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in it:
            for text, lang in zip(b.column(0), b.column(1)):
                for k, p in enumerate(pieces(text.as_py())):
                    cell = sums.setdefault(lang.as_py(), np.zeros(BUCKETS + 1, np.int64))
                    cell[:BUCKETS] += np.bincount(p, minlength=BUCKETS)
                    cell[BUCKETS] += k == 0
        for lang, cell in sums.items():
            at = np.flatnonzero(cell)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()),
                                              "bucket": pa.array(at.astype(np.int32)), "n": pa.array(cell[at])})

    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(text_col), F.col(lang_col).cast("string"))
    counted = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = (counted.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("ns"))
              .limit(MAX_LANGS + 1).collect())   # a row of at most BUCKETS + 1 cells each
    if len(packed) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages: the model would have no proven size")
    if not packed:
        return None
    packed.sort(key=lambda r: r["lang"])
    cells = np.zeros((len(packed), BUCKETS + 1))
    for i, r in enumerate(packed):
        cells[i, r["buckets"]] = r["ns"]
    smooth = cells[:, :BUCKETS] + ALPHA
    return Model([r["lang"] for r in packed], np.log(cells[:, BUCKETS] / cells[:, BUCKETS].sum()),
                 np.log(smooth / smooth.sum(axis=1, keepdims=True)))


def classify(model: Model | None, text: str | None) -> tuple[str, float]:
    """Most probable language (ties: the first by name) and its posterior."""
    total, seen = None, False
    for p in pieces(text):
        seen = True
        if model is None:
            break
        part = np.array([row[p].sum() for row in model.log_prob])
        total = part if total is None else total + part
    if not seen or model is None:
        return UNKNOWN, 0.0
    total = total + model.log_prior
    best = int(np.argmax(total))
    return model.langs[best], float(1.0 / np.exp(total - total[best]).sum())


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` appended (columns of these
    names are replaced). Only the text is looked at.

    ``und`` and 0 for a null text or one without a letter, and for every
    text when nothing could be learned. Very long texts are summed piece by
    piece, so memory stays bounded. Empty tables stay empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    plain = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text_col)

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [classify(sent.value, t.as_py()) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=[*kept, "lang_pred", "score"])

    schema = StructType([*plain.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return plain.mapInArrow(score, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text divisible by 5. A
    null id has no remainder and counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the rows that are not held out, predict all:
    ``id_col, held_out, lang_pred, score``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = train(rows.where(~held_out()))
    out = predict(rows.select("doc_id", "text", held_out().alias("held_out")), model)
    return out.select(F.col("doc_id").alias(id_col), "held_out", "lang_pred", "score")
