"""Tree attributions and importance tables.

Tree SHAP (path-dependent, Lundberg et al. 2018, "Consistent individualized
feature attribution for tree ensembles", Algorithm 2) on MLlib boosted trees:

* the node table of the saved model (``data/`` Parquet: one row per node) is
  read by Spark; its size is trees x nodes, independent of the data rows, so
  it is shipped to the executors once;
* rows are scored in ``mapInPandas``: for every leaf the path polynomial is
  evaluated for a whole Arrow batch at once (numpy over rows), so the Python
  cost per row is a few vector operations per leaf, not a recursion;
* output is long form ``(row_id, feature, value)`` (non-zero values only).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# --------------------------------------------------------------- node table
def tree_nodes(spark: SparkSession, gbt_path: str) -> DataFrame:
    """Node table of a saved MLlib GBT model with the tree weights."""
    data = spark.read.parquet(f"{gbt_path}/data")
    meta = spark.read.parquet(f"{gbt_path}/treesMetadata")
    # stored as a tuple (treeID, metadata json, weight): select by position
    meta = meta.select(F.col(meta.columns[0]).alias("treeID"), F.col(meta.columns[-1]).alias("tree_weight"))
    n = F.col("nodeData")

    def f(name):
        return n.getField(name)

    split = f("split")
    return data.join(meta, "treeID").select(
        "treeID", "tree_weight", f("id").alias("id"), f("prediction").alias("prediction"),
        F.when(f("rawCount") > 0, f("rawCount").cast("double")).otherwise(f("impurityStats")[0]).alias("cover"),
        f("gain").alias("gain"), f("leftChild").alias("left"), f("rightChild").alias("right"),
        split.getField("featureIndex").alias("feature"),
        split.getField("leftCategoriesOrThreshold").alias("thr"),
        split.getField("numCategories").alias("ncat"))


def tree_gain(nodes: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """H4: split count and total gain per feature index."""
    g = (nodes.where(F.col("left") >= 0).groupBy("feature")
              .agg(F.count(F.lit(1)).alias("n_splits"), F.sum("gain").alias("total_gain")))
    if names is not None:
        g = g.join(F.broadcast(names), "feature", "left")
    return g


def _compile(nodes_pdf: pd.DataFrame) -> list:
    """Per tree: (weight, [(leaf_value, [(feature, is_left, thr_or_cats, ncat, ratio), ...]), ...])."""
    trees = []
    for tid, t in nodes_pdf.groupby("treeID"):
        node = {r.id: r for r in t.itertuples(index=False)}
        weight = float(t["tree_weight"].iloc[0])
        leaves = []

        def walk(nid, path):
            r = node[nid]
            if r.left < 0:
                leaves.append((float(r.prediction), path))
                return
            for child, is_left in ((r.left, True), (r.right, False)):
                ratio = float(node[child].cover) / float(r.cover)
                walk(child, path + [(int(r.feature), is_left, list(r.thr), int(r.ncat), ratio)])

        walk(min(node), [])
        trees.append((weight, leaves))
    return trees


def expected_value(trees: list) -> float:
    """Cover-weighted mean prediction of the ensemble (the SHAP base value)."""
    tot = 0.0
    for w, leaves in trees:
        tot += w * sum(v * float(np.prod([s[4] for s in path])) for v, path in leaves)
    return tot


def _follows(X: np.ndarray, feat: int, is_left: bool, thr: list, ncat: int) -> np.ndarray:
    x = X[:, feat]
    go_left = np.isin(x, thr) if ncat > 0 else (x <= thr[0])
    return go_left if is_left else ~go_left


def shap_matrix(X: np.ndarray, trees: list) -> np.ndarray:
    """Path-dependent Tree SHAP for all rows of X at once (n x p)."""
    n, p = X.shape
    phi = np.zeros((n, p))
    for w, leaves in trees:
        for value, path in leaves:
            if not path:
                continue
            feats, zs, os = [], [], []
            for feat, is_left, thr, ncat, ratio in path:      # merge repeated features
                o = _follows(X, feat, is_left, thr, ncat)
                if feat in feats:
                    k = feats.index(feat)
                    zs[k] *= ratio
                    os[k] = os[k] & o
                else:
                    feats.append(feat)
                    zs.append(ratio)
                    os.append(o)
            d = len(feats)
            Z = [1.0] + zs
            O = [np.ones(n)] + [o.astype(float) for o in os]
            pw = np.zeros((n, d + 1))
            pw[:, 0] = 1.0
            for l in range(1, d + 1):                         # EXTEND
                for i in range(l - 1, -1, -1):
                    pw[:, i + 1] += O[l] * pw[:, i] * (i + 1) / (l + 1)
                    pw[:, i] = Z[l] * pw[:, i] * (l - i) / (l + 1)
            for j in range(1, d + 1):                         # UNWIND and credit
                one, zero = O[j], Z[j]
                one_safe = np.where(one != 0, one, 1.0)
                nxt = pw[:, d].copy()
                tot1 = np.zeros(n)
                for i in range(d - 1, -1, -1):
                    tmp = nxt / ((i + 1) * one_safe)
                    tot1 += tmp
                    nxt = pw[:, i] - tmp * zero * (d - i)
                tot0 = np.zeros(n)
                for i in range(d - 1, -1, -1):
                    tot0 += pw[:, i] / (zero * (d - i))
                wsum = np.where(one != 0, tot1, tot0) * (d + 1)
                phi[:, feats[j - 1]] += w * wsum * (one - zero) * value
    return phi


def compile_vectorised(trees: list) -> list | None:
    """Per tree, leaves grouped by their number of distinct path features d:
    (weight, [(d, feat[L,d], lo[L,d], hi[L,d], zero[L,d], value[L], sums)]).
    A leaf follows its path iff lo < x_f <= hi for each feature f on it.
    ``sums`` says per path position how to add leaves up by feature: leaf
    order, start of each feature's leaves, features. All is per leaf and path
    position, whatever the number of features: under 200 MB for 326 trees of
    depth 10.
    A split on a two-valued slot (0 or 1, as one-hot vectors have) is an
    interval too; None when a tree has a categorical split of more values."""
    out = []
    for weight, leaves in trees:
        groups: dict[int, list] = {}
        for value, path in leaves:
            if not path:
                continue
            feats, lo, hi, zero = [], [], [], []
            for feat, is_left, thr, ncat, ratio in path:
                if ncat > 0:
                    if ncat > 2 or not set(thr) <= {0.0, 1.0} or len(thr) != 1:
                        return None
                    is_left, thr = is_left == (thr[0] == 0.0), [0.5]
                if feat not in feats:
                    feats.append(feat)
                    lo.append(-np.inf)
                    hi.append(np.inf)
                    zero.append(1.0)
                k = feats.index(feat)
                if is_left:
                    hi[k] = min(hi[k], thr[0])
                else:
                    lo[k] = max(lo[k], thr[0])
                zero[k] *= ratio
            groups.setdefault(len(feats), []).append((feats, lo, hi, zero, value))
        compiled = []
        for d, items in groups.items():
            feat = np.array([it[0] for it in items], dtype=np.int64)
            sums = []
            for j in range(d):
                order = np.argsort(feat[:, j], kind="stable").astype(np.int32)
                used, start = np.unique(feat[order, j], return_index=True)
                sums.append((order, start, used))
            compiled.append((d, feat, np.array([it[1] for it in items]), np.array([it[2] for it in items]),
                             np.array([it[3] for it in items]), np.array([it[4] for it in items]), sums))
        out.append((weight, compiled))
    return out


def shap_matrix_vectorised(X: np.ndarray, compiled: list, chunk: int = 256) -> np.ndarray:
    """Same values as ``shap_matrix`` in time linear in the depth. A leaf's
    conditional expectation is a product over its path features, each zero_i
    where i is unknown and one_i (0 or 1) where it is known, so feature j's
    Shapley value is

        value * (one_j - zero_j) * integral over t in [0, 1] of prod_{i != j} (zero_i + (one_i - zero_i) t).

    The integrand is a polynomial of degree d - 1: Gauss-Legendre quadrature with
    ceil(d / 2) points is exact, and the product without j is the whole product
    divided by j's factor, which is positive inside (0, 1). All leaves of equal path length
    are taken together as (rows x leaves) arrays, rows in bounded chunks."""
    n, p = X.shape
    phi = np.zeros((n, p))
    for r0 in range(0, n, chunk):
        Xc = X[r0:r0 + chunk]
        m = Xc.shape[0]
        acc = np.zeros((m, p))
        for weight, groups in compiled:
            for d, feat, lo, hi, Z, V, sums in groups:
                points, shares = np.polynomial.legendre.leggauss((d + 1) // 2)
                differ = [((Xc[:, feat[:, j]] > lo[:, j]) & (Xc[:, feat[:, j]] <= hi[:, j])) - Z[:, j] for j in range(d)]
                found = [np.zeros((m, len(V))) for _ in range(d)]
                for t, share in zip((points + 1) / 2, shares / 2):
                    factors = [Z[:, j] + differ[j] * t for j in range(d)]
                    whole = np.full((m, len(V)), share)
                    for f in factors:
                        whole *= f
                    for j, f in enumerate(factors):
                        found[j] += whole / f
                for j, (order, start, used) in enumerate(sums):
                    acc[:, used] += np.add.reduceat((found[j] * differ[j] * (weight * V))[:, order], start, axis=1)
        phi[r0:r0 + chunk] = acc
    return phi


def shap_values(df: DataFrame, nodes: DataFrame, id_col: str = "row_id", features_col: str = "features",
                scale: float = 1.0) -> tuple[DataFrame, float]:
    """H1: long-form attributions ``(row_id, feature_index, value)`` and the
    base value. ``scale=2`` turns an MLlib classifier margin into log-odds."""
    nodes_pdf = nodes.toPandas()      # trees x nodes: independent of the data size
    trees = _compile(nodes_pdf)
    base = expected_value(trees) * scale
    fast = compile_vectorised(trees)
    sc = df.sparkSession.sparkContext.broadcast((trees, fast))

    def run(it):
        tr, fv = sc.value
        for pdf in it:
            if pdf.empty:
                continue
            X = np.vstack(pdf["x"].to_numpy())
            phi = (shap_matrix_vectorised(X, fv) if fv is not None else shap_matrix(X, tr)) * scale
            r, c = np.nonzero(phi)
            yield pd.DataFrame({id_col: pdf[id_col].to_numpy()[r], "feature_index": c.astype("int32"),
                                "value": phi[r, c]})

    src = df.select(F.col(id_col), vector_to_array(F.col(features_col)).alias("x"))
    # a row takes a millisecond but only some hundred bytes: by their bytes
    # alone, thousands of rows would be one task
    src = src.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)
    out = src.mapInPandas(run, f"{id_col} long, feature_index int, value double")
    return out, base


def margin(df: DataFrame, scale: float = 1.0, raw_col: str = "rawPrediction", pred_col: str = "prediction") -> F.Column:
    """Model margin per row: classifier rawPrediction[1] (times scale),
    regressor prediction."""
    if raw_col in df.columns:
        return vector_to_array(F.col(raw_col))[1] * scale
    return F.col(pred_col)


# --------------------------------------------------------------- importance
def mean_abs_importance(attr: DataFrame, id_col: str = "row_id", feature_col: str = "feature",
                        value_col: str = "value", n_rows: int | None = None) -> DataFrame:
    """Mean |value| per feature over all rows (absent = 0). ``n_rows`` is
    the number of explained rows, those without any attribution included;
    without it the distinct ids of a landed attribution table are counted."""
    n_rows = F.lit(n_rows) if n_rows is not None else attr.select(F.countDistinct(id_col)).scalar()
    return (attr.groupBy(feature_col).agg(F.sum(F.abs(value_col)).alias("_s"))
                .select(F.col(feature_col).alias("feature"), (F.col("_s") / n_rows).alias("importance")))


def top_k(imp: DataFrame, k: int = 20) -> DataFrame:
    """K largest importances (ties by feature name)."""
    return imp.orderBy(F.col("importance").desc(), F.col("feature")).limit(k)


def compare(clf: DataFrame, reg: DataFrame) -> DataFrame:
    """Union of both feature sets, 0 for the absent side."""
    a = clf.select("feature", F.col("importance").alias("clf_importance"))
    b = reg.select("feature", F.col("importance").alias("reg_importance"))
    return (a.join(b, "feature", "full")
             .select("feature", F.coalesce("clf_importance", F.lit(0.0)).alias("clf_importance"),
                     F.coalesce("reg_importance", F.lit(0.0)).alias("reg_importance"))
             .orderBy(F.col("clf_importance").desc(), F.col("reg_importance").desc(), F.col("feature")))


def overview(cmp: DataFrame) -> DataFrame:
    """Top feature and score on each side, count positive on both."""
    return cmp.agg(
        F.max_by("feature", F.struct(F.col("clf_importance"), F.col("feature"))).alias("clf_top_feature"),
        F.max("clf_importance").alias("clf_top_score"),
        F.max_by("feature", F.struct(F.col("reg_importance"), F.col("feature"))).alias("reg_top_feature"),
        F.max("reg_importance").alias("reg_top_score"),
        F.count_if((F.col("clf_importance") > 0) & (F.col("reg_importance") > 0)).alias("consensus_features"))


def pick_one(df: DataFrame, id_col: str = "row_id", seed: int = 42) -> DataFrame:
    """One reproducible 'random' row: smallest xxhash64(id, seed)."""
    return df.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col)).limit(1)
