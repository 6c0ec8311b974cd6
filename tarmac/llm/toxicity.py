"""Toxicity by nearest labelled examples.

Examples are labelled texts outside the held-out fifth, at most
``MAX_EXAMPLES`` different ones (smallest hash of the text first). A text is a
vector over a learnt vocabulary: its words and the beginnings of its words
(four to six letters, so inflections of a stem meet), weighted
(1 + ln tf) * ln(N / df) and scaled to length one. The vocabulary holds the
``MAX_TERMS`` terms that are most over-represented among toxic examples; terms
of more than a twentieth of the examples must be so by ``MIN_SCORE`` standard
deviations, for their postings are long and their weights small.

The index is inverted and cut into blocks of ``BLOCK`` examples (sorted by
their heaviest terms, so that a block's examples are alike): a term's postings
lie block by block, and its largest weight in every block is kept. A text's
weights times those maxima bound the cosine of every example of a block.
Blocks are scored from the highest bound down, until the next bound is below
the k-th best cosine so far: the k nearest are exact, ties by example number.

The vote is the similarity-weighted share of toxic ones among the ``NEAREST``
examples. Votes become probabilities by isotonic regression on the votes that
every example gets from the others. Texts that share no term with any example have a
probability of their own. The evidence are the nearest examples themselves.

The index is broadcast: MAX_EXAMPLES * MAX_TERMS postings of 12 bytes at the
very most (400 MB, each example holding every term); measured 1.5 MB. Block maxima
take MAX_TERMS * MAX_EXAMPLES / BLOCK * 8 bytes = 4 MB.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import cut

MAX_EXAMPLES = 16384    # the bounded sample of labelled rows
MAX_TERMS = 2048
MIN_DOCS = 5            # examples that hold a term of the vocabulary
MAX_SHARE, MIN_SCORE = 0.05, 10.0   # more frequent terms need a toxic count so many standard deviations above chance
PREFIXES = (4, 5, 6)
NEAREST = 16
BLOCK = 64
EVIDENCE = 3
CACHE_PIECES, CACHE_LETTERS = 100_000, 40    # short pieces whose terms a task remembers; it starts anew beyond
SLACK = 1e-9            # rounding of bounds and of equal cosines
LETTERS = re.compile(r"[^\W\d_]+")
NO_TERMS, NO_WEIGHTS = np.zeros(0, np.int64), np.zeros(0)


def held_out(id_col: str | Column = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5 (null id: false)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def word_terms(word: str) -> list[str]:
    """A word's terms: itself, and its longer-than-n beginnings."""
    return [word] + [word[:n] + "*" for n in PREFIXES if len(word) > n]


def pieces(text: str | None) -> Counter:
    """Lower-cased stretches between white space with their counts; a word (of
    letters only) never spans two of them, so words are cut once per stretch."""
    return Counter((text or "").lower().split())


def piece_terms(piece: str) -> list[str]:
    return [t for w in LETTERS.findall(piece) for t in word_terms(w)]


def examples(docs: DataFrame, labels: DataFrame, most: int = MAX_EXAMPLES) -> DataFrame:
    """``example (doc_id), text, toxic``: the sample of different labelled
    texts. Copies of a text are one example with the mean of their labels and
    the smallest id. Rows without an id, label or text give none."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
             .groupBy(F.col("doc_id").alias("example")).agg(F.max("toxic").cast("double").alias("label")))
    digest = F.sha2(F.col("text").cast("binary"), 256)
    chosen = (docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("example"), digest.alias("digest"))
              .join(known, "example").groupBy("digest").agg(F.min("example").alias("example"), F.avg("label").alias("toxic"))
              .orderBy("digest").limit(most))
    # the texts come back by id through the small table, so only digests are
    # shuffled; repeated rows of an id are one
    return (docs.select(F.col("doc_id").alias("example"), "text").join(F.broadcast(chosen), "example")
            .where(digest == F.col("digest")).groupBy("digest", "example")
            .agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")).select("example", "text", "toxic"))


def vocabulary(sample: DataFrame, most: int = MAX_TERMS) -> tuple[dict[str, float], int]:
    """({term: idf}, number of examples). Counts are partial per batch and
    summed by term; ties of the score go by term."""
    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            df: Counter = Counter()
            toxic: Counter = Counter()
            for text, label in zip(b.column(0), b.column(1).to_pylist()):
                terms = {t for p in pieces(text.as_py()) for t in piece_terms(p)}
                df.update(terms)
                if label:
                    for t in terms:
                        toxic[t] += label
            yield pa.RecordBatch.from_arrays([pa.array(df.keys(), pa.string()), pa.array(df.values(), pa.int64()),
                                              pa.array([float(toxic[t]) for t in df], pa.float64())], names=["term", "df", "toxic"])

    total, share = sample.agg(F.count(F.lit(1)), F.avg("toxic")).first()
    if not total or not 0 < share < 1:
        return {}, total
    counted = sample.select("text", "toxic").mapInArrow(count, "term string, df long, toxic double")
    score = (F.col("toxic") - F.col("df") * share) / F.sqrt(F.col("df") * (share * (1 - share)))
    best = (counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("toxic").alias("toxic"))
            .where((F.col("df") >= MIN_DOCS) & (F.col("df") < total)).select("term", "df", F.round(score, 9).alias("score"))
            .where((F.col("score") > 0) & ((F.col("df") <= MAX_SHARE * total) | (F.col("score") >= MIN_SCORE))).orderBy(F.desc("score"), "term").limit(most).collect())
    return {r.term: math.log(total / r.df) for r in best}, total


class Vectors:
    """Text -> (term numbers, weights of a unit vector)."""

    def __init__(self, idf: dict[str, float]):
        self.number = {t: i for i, t in enumerate(idf)}
        self.idf = np.array(list(idf.values()))
        self.heads = {t.rstrip("*")[:PREFIXES[0]] for t in idf}      # most words have another head, so no term
        self.known: dict[str, tuple[int, ...]] = {}

    def terms(self, piece: str) -> tuple[int, ...]:
        words = [piece] if piece.isalpha() else LETTERS.findall(piece)
        words = [w for w in words if w[:PREFIXES[0]] in self.heads]
        return tuple(self.number[t] for w in words for t in word_terms(w) if t in self.number) if words else ()

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        tf: dict[int, int] = {}
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        known = self.known
        for piece, n in pieces(text).items():
            terms = known.get(piece)
            if terms is None:
                terms = self.terms(piece)
                if len(piece) <= CACHE_LETTERS:
                    known[piece] = terms
            for t in terms:
                tf[t] = tf.get(t, 0) + n
        if not tf:
            return NO_TERMS, NO_WEIGHTS
        terms = np.array(sorted(tf), np.int64)
        weights = (1 + np.log([tf[t] for t in terms.tolist()])) * self.idf[terms]
        norm = math.sqrt(float(weights @ weights))
        return terms, weights / norm


@dataclass
class Index:
    """Block-max inverted index. Postings are ordered by (term, block,
    example); those of term t in block b are at ``begin[t, b]:begin[t, b + 1]``."""

    begin: np.ndarray       # (terms, blocks + 1)
    example: np.ndarray
    weight: np.ndarray
    ceiling: np.ndarray     # (terms, blocks): largest weight
    size: int

    @staticmethod
    def build(vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> Index:
        blocks = -(-len(vectors) // BLOCK)
        lengths = [len(t) for t, _ in vectors]
        example = np.repeat(np.arange(len(vectors)), lengths)
        term = np.concatenate([t for t, _ in vectors] or [np.zeros(0, np.int64)])
        weight = np.concatenate([w for _, w in vectors] or [np.zeros(0)])
        order = np.lexsort((example, term))
        example, term, weight = example[order], term[order], weight[order]
        cell = term * blocks + example // BLOCK
        counts = np.bincount(cell, minlength=n_terms * blocks)
        ends = np.cumsum(counts).reshape(n_terms, blocks)
        begin = np.concatenate(([[0]] * n_terms, ends), axis=1) if n_terms else np.zeros((0, blocks + 1), np.int64)
        begin[1:, 0] = ends[:-1, -1] if blocks else 0
        ceiling = np.zeros(n_terms * blocks)
        np.maximum.at(ceiling, cell, weight)
        return Index(begin, example.astype(np.int32), weight, ceiling.reshape(n_terms, blocks), len(vectors))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest with a cosine above 0, nearest
        first, without example ``but``."""
        if not len(terms) or not self.size:
            return NO_TERMS, NO_WEIGHTS
        bound = weights @ self.ceiling[terms]
        order = np.argsort(-bound, kind="stable")
        order = order[:np.count_nonzero(bound)]
        found, cosines, at, round_ = NO_TERMS, NO_WEIGHTS, 0, 8
        while at < len(order):
            if len(cosines) == k and bound[order[at]] < cosines[-1] - SLACK:
                break
            blocks = order[at:at + round_]
            if len(cosines) == k:
                blocks = blocks[bound[blocks] >= cosines[-1] - SLACK]
            at, round_ = at + round_, round_ * 2
            scores = self._scores(terms, weights, blocks)
            scores[np.abs(scores) < SLACK] = 0
            hit = np.flatnonzero(scores)
            near = blocks[hit // BLOCK] * BLOCK + hit % BLOCK
            here = np.round(scores[hit[near != but]], 9)
            found, cosines = np.concatenate((found, near[near != but])), np.concatenate((cosines, here))
            best = np.lexsort((found, -cosines))[:k]
            found, cosines = found[best], cosines[best]
        return found, cosines

    def _scores(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Cosines of the examples of some blocks, by their postings."""
        lists = self.begin[terms]
        begin, end = lists[:, blocks].ravel(), lists[:, blocks + 1].ravel()
        sizes = end - begin
        total = int(sizes.sum())
        posting = np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(total)
        slot = np.repeat(np.tile(np.arange(len(blocks)), len(terms)), sizes)
        parts = np.repeat(np.repeat(weights, len(blocks)), sizes) * self.weight[posting]
        return np.bincount(slot * BLOCK + self.example[posting] % BLOCK, parts, minlength=len(blocks) * BLOCK)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing least-squares fit by pooling neighbours: (distinct x,
    fitted y)."""
    xs, inverse, n = np.unique(x, return_inverse=True, return_counts=True)
    means = np.bincount(inverse, y, minlength=len(xs)) / n
    pools: list[list[float]] = []
    for m, w in zip(means.tolist(), n.tolist()):
        pools.append([m, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m2, w2, c2 = pools.pop()
            m1, w1, c1 = pools[-1]
            pools[-1] = [(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, c1 + c2]
    return xs, np.repeat([p[0] for p in pools], [p[2] for p in pools])


@dataclass
class Model:
    idf: dict[str, float]
    index: Index
    ids: np.ndarray         # doc_id of each example
    toxic: np.ndarray
    votes: np.ndarray       # calibration: vote -> probability
    chances: np.ndarray
    no_term: float          # probability of a text that shares no term

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> float:
        return float(cosines @ self.toxic[found] / cosines.sum()) if len(found) else -1.0

    def chance(self, vote: float) -> float:
        if vote < 0 or not len(self.votes):
            return self.no_term
        return float(np.interp(vote, self.votes, self.chances))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_EXAMPLES, terms: int = MAX_TERMS) -> Model:
    """Fit on the labelled rows outside the held-out fifth. Without any example,
    or with one class only, every score is the share of toxic ones (0 without
    examples)."""
    sample = cut(examples(docs, labels, most))
    idf, total = vocabulary(sample, terms)

    def vectors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = Vectors(idf)
        for b in it:
            got = [vector(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([t.tolist() for t, _ in got], pa.list_(pa.int32())),
                                              pa.array([w.tolist() for _, w in got], pa.list_(pa.float64()))], names=["example", "toxic", "terms", "weights"])

    kind = sample.schema["example"].dataType.simpleString()
    table = sample.select("example", "text", "toxic").mapInArrow(vectors, f"example {kind}, toxic double, terms array<int>, weights array<double>").toArrow()
    rows = [(i, y, np.array(t, np.int64), np.array(w)) for i, y, t, w in zip(*(table.column(c).to_pylist() for c in range(4)))]
    # alike examples side by side: by their heaviest terms
    rows.sort(key=lambda r: (r[2][np.argsort(-r[3], kind="stable")[:3]].tolist(), r[0]))
    index = Index.build([(t, w) for _, _, t, w in rows], len(idf))
    y = np.array([r[1] for r in rows])
    model = Model(idf, index, np.array([r[0] for r in rows]), y, np.zeros(0), np.zeros(0), float(y.mean()) if total else 0.0)
    votes = np.array([model.vote(*index.nearest(t, w, NEAREST, but=n)) for n, (_, _, t, w) in enumerate(rows)])
    if len(votes):
        model.votes, model.chances = isotonic(votes[votes >= 0], y[votes >= 0])
        # one toxic example more in ten keeps the share of few texts off 0 and 1
        alone = y[votes < 0]
        model.no_term = float((alone.sum() + 10 * model.no_term) / (len(alone) + 10))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score, predicted, evidence`` of every row, by its text alone.
    ``evidence`` are the nearest examples: (doc_id, cosine, toxic). Null and
    empty texts, and texts that share no term with an example, get the
    probability learnt for such texts, without evidence. Texts of any length are read whole;
    repeated rows and rows without an id have their own row each; other columns
    are left out, whatever their names."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    near = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.float64())]))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        vector = Vectors(m.idf)
        for b in it:
            scores, evidence = [], []
            for text in b.column(1):
                found, cosines = m.index.nearest(*vector(text.as_py()), NEAREST)
                scores.append(m.chance(m.vote(found, cosines)))
                evidence.append([{"doc_id": int(m.ids[f]), "cosine": float(c), "toxic": float(m.toxic[f])}
                                 for f, c in zip(found[:EVIDENCE], cosines[:EVIDENCE])])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(evidence, near)], names=["id", "score", "evidence"])

    kind = plain.schema["id"].dataType.simpleString()
    scored = plain.mapInArrow(batches, f"id {kind}, score double, evidence array<struct<doc_id:long,cosine:double,toxic:double>>")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence`` of every document."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", "evidence")
