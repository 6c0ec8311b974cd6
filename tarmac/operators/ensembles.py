"""Tree ensembles as SQL expressions.

A fitted ensemble becomes one nested ``CASE`` per tree over plain columns, and
its margin a sum of them. Scoring is then a projection: no vectors are
assembled, no Python and no model object runs on the executors, and the same
text runs in another SQL engine. Expressions are bounded by the model, not the
data.

The trees are added up chunk by chunk of ``CHUNK_LEAVES`` leaves. A projection
of thousands of leaves must not become one generated method: no JIT compiler
takes it. Spark gives every larger subexpression a method of its own in a
projection that stays out of whole-stage generation, as one with a
higher-order function does. What stands inside such a function is interpreted
node by node, so only the last tree does.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac import schema as S
from tarmac.operators.encode import one_hot_labels
from tarmac.operators.explain import tree_nodes
from tarmac.session import scratch_path

CHUNK_LEAVES = 64
BLOCK_CHUNKS = 64       # chunks added in one row: bounds the nesting of the sum


@dataclass(frozen=True)
class Node:
    """A leaf (``condition`` is None) or a split: rows where the condition
    holds go left, all others, null outcomes too, go right."""
    value: float = 0.0
    condition: str | None = None
    left: Node | None = None
    right: Node | None = None

    @property
    def leaves(self) -> int:
        return 1 if self.condition is None else self.left.leaves + self.right.leaves


def number(x: float) -> str:
    """A double literal that Spark and DuckDB read alike, to the last bit."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def text(x: str) -> str:
    if "\\" in x:
        raise ValueError(f"a category with a backslash has no common literal: {x!r}")
    return "'" + x.replace("'", "''") + "'"


def case_sql(node: Node, scale: float = 1.0) -> str:
    if node.condition is None:
        return number(node.value * scale)
    return f"CASE WHEN {node.condition} THEN {case_sql(node.left, scale)} ELSE {case_sql(node.right, scale)} END"


def chunks(trees: list[Node], most: int = CHUNK_LEAVES) -> list[list[Node]]:
    """Neighbouring trees with at most ``most`` leaves together (a larger tree
    alone)."""
    out: list[list[Node]] = []
    size = most + 1
    for t in trees:
        if size + t.leaves > most:
            out.append([])
            size = 0
        out[-1].append(t)
        size += t.leaves
    return out


def margin_sql(trees: list[Node], base: float = 0.0) -> str:
    """Plain sum in tree order; any engine."""
    return " + ".join([number(base), *[case_sql(t) for t in trees]])


def margin_column(trees: list[Node], base: float = 0.0) -> Column:
    """The same value for Spark, chunk by chunk; the last tree's value comes
    through a fold, which adds nothing (see the module's text)."""
    if not trees:
        return F.lit(float(base))
    *before, last = [F.expr(" + ".join(case_sql(t) for t in c)) for c in [*chunks(trees[:-1]), trees[-1:]]]
    folded = F.aggregate(F.array(last), F.lit(0.0), lambda a, x: a + x)
    blocks = [reduce(Column.__add__, before[i:i + BLOCK_CHUNKS]) for i in range(BLOCK_CHUNKS, len(before), BLOCK_CHUNKS)]
    return reduce(Column.__add__, [*before[:BLOCK_CHUNKS], *blocks, folded], F.lit(float(base)))


# ------------------------------------------------- fitted MLlib pipelines
def _conditions(model: PipelineModel, features: list[str]):
    """Function (row of the node table) -> condition over ``{column}__z`` of
    the scaler stage and the raw categorical columns."""
    numeric, categorical = S.numeric_part(features), S.categorical_part(features)
    slots = [(c, v) for c, values in zip(categorical, one_hot_labels(model)) for v in values]

    def condition(row) -> str:
        if row.feature < len(numeric):
            # a null reaches MLlib's trees as NaN, which is above any threshold
            return f"{numeric[row.feature]}__z <= {number(row.thr[0])} AND NOT isnan({numeric[row.feature]}__z)"
        # a slot of a one-hot vector holds 1 for its value and 0 for any other
        goes_left = tuple(x in row.thr if row.ncat > 0 else x <= row.thr[0] for x in (0.0, 1.0))
        column, value = slots[row.feature - len(numeric)]
        is_value = f"coalesce(CAST({column} AS STRING) = {text(value)}, false)"
        return {(True, True): "1 = 1", (False, False): "1 = 0", (True, False): f"NOT {is_value}", (False, True): is_value}[goes_left]
    return condition


def trees_of(nodes: DataFrame, condition) -> list[Node]:
    """The boosted trees of a node table (``explain.tree_nodes``: trees x nodes,
    whatever the data), each leaf times its tree's weight."""
    trees: dict[int, dict[int, object]] = {}
    for r in nodes.collect():
        trees.setdefault(r.treeID, {})[r.id] = r

    def walk(tree: dict, i: int) -> Node:
        r = tree[i]
        if r.left < 0:
            return Node(value=r.prediction * r.tree_weight)
        return Node(condition=condition(r), left=walk(tree, r.left), right=walk(tree, r.right))
    return [walk(tree, min(tree)) for _, tree in sorted(trees.items())]


@dataclass
class Compiled:
    """A fitted boosted pipeline without its objects: the scaler's statement
    and the trees."""
    kind: str
    prepare: str
    trees: list[Node]

    @staticmethod
    def of(model: PipelineModel, features: list[str], kind: str) -> Compiled:
        scaler = next(s for s in model.stages if isinstance(s, SQLTransformer))
        spark = SparkSession.getActiveSession()
        path = scratch_path(spark, f"trees_{kind}")
        model.stages[-1].write().overwrite().save(path)
        return Compiled(kind, scaler.getStatement(), trees_of(tree_nodes(spark, path), _conditions(model, features)))

    def score(self, df: DataFrame, col: str) -> DataFrame:
        """``df`` with the probability of class 1, or the predicted value."""
        scaled = SQLTransformer(statement=self.prepare).transform(df)
        margin = margin_column(self.trees)
        out = 1.0 / (1.0 + F.exp(-2.0 * margin)) if self.kind == "classifier" else margin
        return scaled.select(*[F.col(f"`{c}`") for c in df.columns], out.alias(col))

    def sql(self, table: str, keys: list[str], col: str) -> str:
        """The score as one statement for another engine over ``table``."""
        scaled = self.prepare.replace("`", '"').replace("__THIS__", table)
        margin = margin_sql(self.trees)
        out = f"1.0 / (1.0 + exp(-2.0 * ({margin})))" if self.kind == "classifier" else margin
        return f"SELECT {', '.join(keys)}, {out} AS {col} FROM ({scaled}) t"
