"""Near-duplicate documents by b-bit MinHash.

1. Every text becomes its set of 5-word shingles (64-bit hashes), ``PERMS``
   minima, one key per band of ``ROWS`` minima, and a signature of the low
   ``BITS`` bits of each minimum, packed.
2. Texts with one shingle set are one class. The search runs on numbers of
   the classes, so rows that share an id (or have none) keep their own sets.
3. Classes that share a band key are candidates. A bucket never becomes all
   its pairs: in ``STARS`` rounds one member of it (another in every band and
   round), the centre, is compared with those of other components, and then
   leaves the bucket. (More rounds save block comparisons but cost rounds of
   small shuffles; the result is the same.) What is still in different components after that is
   compared block by block inside a task (a block has about ``BLOCK`` rows,
   fewer of long texts: ``BLOCK_SHINGLES`` shingles): signatures
   first, then the full sets of the pairs that pass; only links that join
   components come out. Members of a bucket's largest component aren't
   compared with each other.
4. A pair passes if the share of equal signature entries, corrected for
   chance collisions, is within five standard deviations of the threshold,
   and the set sizes allow it. It is a link if the full sets confirm it.
5. Components of the links; pairs inside a component need no more tests.

At the threshold of 0.85 a pair shares none of 24 bands of 5 with probability
8e-7, and its estimate fails with 3e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import cut, text_or_empty
from tarmac.llm.components import components

WIDTH = 5                     # words in a shingle
PERCENT = 85                  # 100 * intersection >= PERCENT * union
ROWS, BANDS, BITS = 5, 24, 4
PERMS = ROWS * BANDS
STARS = 1
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20   # rows, and shingles (8 MB of hashes), that a block holds about
LAST_ID = 2 ** 63 - 1         # stands for a null id
_WORDS_KEPT = 200_000

_seed = np.random.Generator(np.random.PCG64(85))
_A = _seed.integers(0, 2 ** 63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _seed.integers(0, 2 ** 63, PERMS, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)  # odd multiplier: 2^64 over the golden ratio


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text. Fewer than 5 words: the
    whole sequence as one. No word: empty."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    width = min(WIDTH, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for i in range(width):
        h = (h ^ w[i:len(w) - width + 1 + i]) * _P
        h ^= h >> np.uint64(31)
    return np.unique(h)


def minima(found: np.ndarray) -> np.ndarray:
    """Least value of each permutation over the set."""
    least = np.full(PERMS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 2048):
        part = found[at:at + 2048]
        np.minimum(least, (_A[:, None] * part + _B[:, None]).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> list[int]:
    return [xxhash.xxh3_64_intdigest(least[i * ROWS:(i + 1) * ROWS].tobytes(), seed=i) - 2 ** 63 for i in range(BANDS)]


def packed(least: np.ndarray) -> bytes:
    low = (least & np.uint64(15)).astype(np.uint8)
    return (low[::2] << 4 | low[1::2]).tobytes()


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures (last axis), collision-corrected."""
    x = a ^ b
    equal = ((x & 15) == 0).sum(axis=-1) + ((x & 240) == 0).sum(axis=-1)
    chance = 2.0 ** -BITS
    return (equal / PERMS - chance) / (1 - chance)


def least_estimate(percent: int = PERCENT) -> float:
    chance, j = 2.0 ** -BITS, percent / 100
    p = j + (1 - j) * chance
    return j - 5 * (p * (1 - p) / PERMS) ** 0.5 / (1 - chance)


def signatures(docs: DataFrame) -> DataFrame:
    """``id, tie, n, class, bands, sig`` of ``docs`` (id, text, tie);
    ``class`` is a 128-bit digest of the shingle set, null without one."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n, digest, bands, sig = [], [], [], []
            for t in b.column(1):
                found = shingles(t.as_py())
                n.append(len(found))
                if len(found):
                    least = minima(found)
                    digest.append(xxhash.xxh3_128_digest(found.tobytes()))
                    bands.append(band_keys(least))
                    sig.append(packed(least))
                else:
                    digest.append(None)
                    bands.append([])
                    sig.append(None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                 pa.array(sig, pa.binary())], names=["id", "tie", "n", "class", "bands", "sig"])

    return docs.mapInArrow(batches, "id long, tie long, n long, class binary, bands array<long>, sig binary")


def _sets(docs: DataFrame) -> DataFrame:
    """``class, set`` of ``docs`` (id, text)."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(0, b.num_rows, 64):
                sets = [shingles(t.as_py()).tobytes() for t in b.column(1).slice(i, 64)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())], names=["class", "set"])

    return docs.mapInArrow(batches, "class binary, set binary")


def _passing(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures allow a link."""
    side = [reps.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}")) for x in "ab"]
    both = pairs.join(side[0], "a").join(side[1], "b").where(
        F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b", "sa", "sb")
    least = least_estimate(percent)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            if len(p):
                sig = [np.frombuffer(b"".join(p[c]), np.uint8).reshape(len(p), -1) for c in ("sa", "sb")]
                yield p.loc[estimate(*sig) >= least, ["a", "b"]]

    return both.mapInPandas(batches, "a long, b long")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets confirm the link."""
    both = (pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in it:
            ok = []
            for x, y in zip(p.column(2), p.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([p.column(0), p.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "set_a", "set_b").mapInArrow(batches, "a long, b long")


def _pair(x: str | Column, y: str | Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _stars(members: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """One member of each bucket, the centre, paired with those of other
    components; and the buckets without their centres, which have then met
    all others. The mask makes the least member a different one in every
    bucket and round."""
    mask = F.xxhash64(F.col("key"), F.lit(turn))
    centre = (members.groupBy("key").agg(F.min(F.col("id").bitwiseXOR(mask)).alias("x"))
              .select("key", F.col("x").bitwiseXOR(mask).alias("centre")))
    met = members.join(centre, "key")
    own = met.where("id = centre").select("key", F.col("comp").alias("of"))
    pairs = met.where("id != centre").join(own, "key").where("comp != of").select(*_pair("id", "centre")).distinct()
    return pairs, met.where("id != centre").select("key", "id")


def _open_buckets(members: DataFrame) -> DataFrame:
    """Members of buckets that still hold several components."""
    several = members.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 != c1").select("key")
    return members.join(several, "key")


def _block_links(members: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components of a bucket, found block by block: of the
    pairs that pass, those that the full sets confirm and that join two
    components not joined before in the block. The bucket's largest component
    (role 0) meets only the others."""
    sizes = (members.join(reps.select("id", "n"), "id").groupBy("key", "comp")
             .agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles")))
    largest = (sizes.groupBy("key").agg(F.max(F.struct("size", "comp", "shingles")).alias("big"), F.sum("size").alias("all"), F.sum("shingles").alias("held"))
               .select("key", F.col("big.comp").alias("big"), F.col("big.size").alias("n0"), (F.col("all") - F.col("big.size")).alias("n1"),
                       F.col("big.shingles").alias("s0"), (F.col("held") - F.col("big.shingles")).alias("s1")))
    role = F.when(F.col("comp") == F.col("big"), 0).otherwise(1)
    blocks = [F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(s) / BLOCK_SHINGLES)).cast("int") for n, s in (("n0", "s0"), ("n1", "s1"))]
    here = F.pmod(F.xxhash64("id"), F.when(F.col("role") == 0, blocks[0]).otherwise(blocks[1])).cast("int")
    # a block of the others meets every block: the largest component's, its own, and each later one of the others
    meets = F.when(F.col("role") == 0, F.transform(F.sequence(F.lit(0), blocks[1] - 1), lambda j: F.struct(F.lit(0).alias("r"), F.col("block").alias("i"), j.alias("j"))))\
        .otherwise(F.concat(F.transform(F.sequence(F.lit(0), blocks[0] - 1), lambda i: F.struct(F.lit(0).alias("r"), i.alias("i"), F.col("block").alias("j"))),
                            F.transform(F.sequence(F.lit(0), blocks[1] - 1), lambda k: F.struct(
                                F.lit(1).alias("r"), F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))))
    dealt = (members.join(largest, "key").withColumn("role", role).withColumn("block", here)
             .join(reps.select("id", "n", "sig").join(sets, "id"), "id")
             .select("key", F.explode(meets).alias("m"), "role", "block", "id", "comp", "n", "sig", "set")
             .select("key", "m.r", "m.i", "m.j", "role", "block", "id", "comp", "n", "sig", "set"))
    least = least_estimate(percent)

    def compare(p: pd.DataFrame) -> pd.DataFrame:
        r, i, j = p[["r", "i", "j"]].iloc[0]
        first = p[(p.role == r) & (p.block == i)]
        second = first if r == 1 and i == j else p[(p.role == 1) & (p.block == j)]
        if not len(first) or not len(second):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        sig = np.frombuffer(b"".join(second.sig), np.uint8).reshape(len(second), -1)
        ids, root, ns = (second[c].to_numpy().copy() for c in ("id", "comp", "n"))
        flat = np.frombuffer(b"".join(second.set), np.uint64)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], np.repeat(np.arange(len(second)), ns)[order]
        joined: dict[int, int] = {}
        out = []
        for x, c, n, s, have in zip(first.id, first.comp, first.n, first.sig, first.set):
            while c in joined:
                c = joined[c]
            ok = np.flatnonzero((root != c) & (np.minimum(ns, n) * 100 >= np.maximum(ns, n) * percent))
            ok = ok[estimate(sig[ok], np.frombuffer(s, np.uint8)) >= least] if len(ok) else ok
            if not len(ok):
                continue
            have = np.frombuffer(have, np.uint64)
            start, many = np.searchsorted(flat, have), np.searchsorted(flat, have, "right")
            many = many - start
            places = np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())
            common = np.bincount(owner[places], minlength=len(second))[ok]
            for y in ok[100 * common >= percent * (n + ns[ok] - common)]:
                if root[y] != c:
                    out.append((min(x, ids[y]), max(x, ids[y])))
                    joined[int(root[y])] = c
                    root[root == root[y]] = c
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("key", "r", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: ``id, tie, n, component, kept``; ``tie`` is a
    hash of the text, a null id is ``LAST_ID``. A component has the smallest
    id in it; of the shingle sets with that id the one with the least digest
    is kept."""
    plain = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), F.col(text_col).alias("text"))
    printed = cut(signatures(plain.withColumn("tie", F.xxhash64(text_or_empty("text")))))
    # a number per class; the cut keeps them as they are
    classes = cut(printed.where("class is not null").groupBy("class").agg(F.min("id").alias("first"))
                  .withColumn("node", F.monotonically_increasing_id()))
    reps = (printed.join(classes.select("class", F.col("first").alias("id"), "node"), ["class", "id"])
            .select(F.col("node").alias("id"), "n", "bands", "sig").dropDuplicates(["id"]))
    rows = reps.select("id", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo != hi").select("key")
    members = cut(rows.join(shared, "key").select("key", "id").distinct())
    involved = members.select("id").distinct()
    sets = None
    if not involved.isEmpty():
        wanted = classes.join(involved.withColumnRenamed("id", "node"), "node", "left_semi")
        sets = cut(_sets(plain.join(wanted.select(F.col("first").alias("id")).distinct(), "id", "left_semi"))
                   .dropDuplicates(["class"]).join(wanted, "class").select(F.col("node").alias("id"), "set"))
    reps = cut(reps.join(involved, "id", "left_semi").select("id", "n", "sig"))

    links, tested, comp = None, None, None

    def add(confirmed: DataFrame) -> None:
        nonlocal links, comp
        links = confirmed if links is None else links.unionByName(confirmed)
        comp = components(links)

    def placed(rows: DataFrame) -> DataFrame:
        """Members of buckets that hold several components, with theirs."""
        known = rows.withColumn("comp", F.col("id")) if comp is None else (
            rows.join(comp.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp")))
        return cut(_open_buckets(known))

    if sets is not None:
        left = placed(members)
        for turn in range(STARS):
            pairs, rest = _stars(left, turn)
            new = pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
            new = cut(_passing(new, reps, percent))
            tested = new if tested is None else tested.unionByName(new)
            add(cut(_links(new, sets, percent)))
            left = placed(rest)
            if left.isEmpty():
                break
        else:
            add(cut(_block_links(left, reps, sets, percent)))
        placed_classes = classes.join(comp.withColumnRenamed("node", "of"), F.col("node") == F.col("of"))
        best = placed_classes.groupBy("component").agg(F.min(F.struct("first", "class")).alias("best"))
        ends = placed_classes.join(best, "component").select("class", F.col("best.first").alias("found"), (F.col("class") == F.col("best.class")).alias("head"))
        classes = classes.select("class", "first").join(ends, "class", "left")
    else:
        classes = classes.select("class", "first", F.lit(None).cast("long").alias("found"), F.lit(None).cast("boolean").alias("head"))
    # a null class joins with nothing
    return printed.select("id", "tie", "n", "class").join(classes, "class", "left").select(
        "id", "tie", "n", F.coalesce("found", "first", "id").alias("component"),
        (F.coalesce("head", F.lit(True)) & (F.col("id") == F.coalesce("first", "id"))).alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: ``id_col, n_shingles, component_id, kept``.

    Null, empty and wordless texts have no shingles and are linked with
    nothing. Rows with the same id and shingle set are one document; rows with
    the same id and other sets are documents of their own. A null id comes
    after all others; a component of null ids alone has a null
    ``component_id``, and one of its documents is kept. An empty table gives
    an empty result; other columns aren't read.
    """
    null = F.lit(None).cast("long")
    return judged(docs, id_col, text_col, percent).select(
        F.when(F.col("id") != LAST_ID, F.col("id")).otherwise(null).alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("component") != LAST_ID, F.col("component")).otherwise(null).alias("component_id"), "kept")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose document is kept, told by id and text."""
    gone = judged(docs, id_col, text_col, percent).where("not kept").select(F.col("id").alias("gone id"), F.col("tie").alias("gone tie")).distinct()
    key = [F.coalesce(docs[id_col].cast("long"), F.lit(LAST_ID)), F.xxhash64(text_or_empty(docs[text_col]))]
    return docs.join(gone, (key[0] == gone["gone id"]) & (key[1] == gone["gone tie"]), "left_anti")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ')
                              ELSE array_to_string(words[i:i + 4], ' ') END AS shingle
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a),
m AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN m ON m.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
